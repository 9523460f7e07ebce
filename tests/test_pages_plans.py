import json
import re

from pyspark.sql import functions as F

from laconic import queries
from laconic.operators import pages
from laconic.plans.compress import register

DATA = "/root/testdata/sf0.001"


def facts(spark):
    return spark.range(200).select(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 3600).alias("ts"), F.when(F.col("id") % 3 > 0, "f").alias("filter_id"), F.concat(F.lit("t"), F.col("id") % 30).alias("command_type"), F.lit(100).alias("original"), F.lit(40).alias("compressed"))


def test_pages(spark, tmp_path):
    rows = pages.stats_page(facts(spark)).collect()
    assert tuple(rows[0]) == ("totals", "messages", 200, 12000, "60.0") and [r.name for r in rows if r.section == "filters"] == ["f", "none"] and sum(r.section == "commands" for r in rows) == 20
    got = [r.bucket for r in pages.recent(facts(spark), "hour").collect()]
    assert len(got) == 48 and got == sorted(got) and pages.recent(facts(spark), "day").count() == 10
    pages.write_tsv(pages.stats_page(facts(spark)), str(tmp_path / "t"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "t")).count() == len(rows)


def test_table_function(spark):
    register(spark)
    spark.createDataFrame([(1, json.dumps({"messages": [{"role": "user", "content": "a"}, {"role": "tool", "content": "b"}]})), (2, "no")], "id long, body string").createOrReplaceTempView("reqs")
    assert [tuple(r) for r in spark.sql("select id, kind, text from reqs, lateral explode_messages(body) order by pos").collect()] == [(1, "user", "a"), (1, "tool", "b")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    p = plan(queries.savings_by_source(spark, DATA))
    assert len(re.findall(r"\bExchange ", p)) == 1 and "ReadSchema: struct<text:string,source:string>" in p and "IsNotNull(text)" in p and "Python" not in p
    p = plan(queries.output_pipeline(spark, DATA))
    assert "Exchange" not in p and p.count("ArrowEvalPython") == 1 and "ReadSchema: struct<doc_id:bigint,text:string>" in p
    p = plan(queries.timeseries_all(spark, DATA))
    assert "Python" not in p and "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>" in p
    for name in ("run_dedup_lines", "condense_user_full", "smart_truncate_head_tail", "safe_clean_baseline"):
        assert "Exchange" not in (p := plan(queries.QUERIES[name](spark, DATA))) and "Python" not in p
    p = plan(queries.top_commands(spark, DATA))
    assert "TakeOrderedAndProject" in p
