from pyspark.sql import functions as F

from laconic.operators import hints, stats
from laconic.streaming import series, state


def play(spark, df, parts, make, tmp_path, mode="append", **options):
    """Run a streaming query over df, written as `parts` files, one to a batch; its rows."""
    src, out = str(tmp_path / "in"), []
    df.repartition(parts).sortWithinPartitions("ts").write.parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = make(stream).writeStream.outputMode(mode).foreachBatch(lambda b, i: out.append((i, b.collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    q.stop()
    return [r for _, rows in out for r in rows] if mode == "append" else out[-1][1]


def events(spark, n=300):
    return spark.range(n).select((F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 97)).alias("ts"), F.col("id").alias("pos"), (F.col("id") % 7).alias("session_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("c"), F.col("id").cast("string"))).alias("command"), (F.col("id") % 50).alias("original"), (F.col("id") % 31).alias("compressed"))


def test_series(spark, tmp_path):
    df = events(spark)
    got = play(spark, df.select("ts", "original", "compressed"), 1, lambda s: series.series(s, "hour"), tmp_path / "h")
    want = {r.bucket: tuple(r)[1:] for r in stats.series(df, "hour").collect()}
    closed = {r.bucket.strftime("%Y-%m-%dT%H"): tuple(r)[1:] for r in got}
    assert closed and all(want[k] == v for k, v in closed.items())
    got = play(spark, df.select("ts", "original", "compressed"), 4, lambda s: series.series(s, "month"), tmp_path / "m", "complete")
    assert [tuple(r)[1:] for r in got] == [tuple(r)[1:] for r in stats.series(df, "month").collect()]
    got = play(spark, df.select("ts", "original", "compressed"), 4, series.totals, tmp_path / "t", "complete")
    s = stats.summary(df).first()
    assert tuple(got[0]) == (s.messages, s.original, s.compressed, s.saved)


def test_session_commands_like_batch(spark, tmp_path):
    df = events(spark).select("session_id", "ts", "pos", "command")
    got = {r.pos: r.known for r in play(spark, df, 1, lambda s: state.session_commands(s, 1500), tmp_path)}
    e = df.withColumn("t", F.unix_timestamp("ts"))
    want = {r.pos: r.command_as_of for r in hints.as_of(e, ["session_id"], "t", "command", 1500, "pos").collect()}
    assert got == want and None in want.values() and len(set(want.values())) > 5


def test_cache_like_batch(spark, tmp_path):
    df = events(spark).select(F.col("session_id").alias("key"), "ts")
    got = sorted((r.key, r.ts, r.is_hit) for r in play(spark, df, 1, lambda s: state.cache_hits(s, 679), tmp_path))
    e = df.withColumn("t", F.unix_timestamp("ts"))
    assert got == sorted((r.key, r.ts, r.is_hit) for r in stats.cache_hits(e, ["key"], "t", 679).collect()) and any(x[2] for x in got)
