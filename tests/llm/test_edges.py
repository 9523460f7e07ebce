"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables, columns with clashing names: for every operator and stage."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from laconic.llm import chat, decontaminate, fingerprints, jaccard, langid, licenses, line_dedup, mixing, sharding, toxicity

LONG = " ".join(f"word{i % 977} tail{i % 13}" for i in range(150_000))
#: Names that operators use for what they add.
EXTRA = ("size", "n_words", "digest", "score", "predicted", "lang_pred", "shard", "slot", "component_id", "n_lines", "passages", "licenses", "position", "fingerprint", "contaminated", "node", "a", "b", "key")
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "s1", 59), (1, "the quick brown fox jumps over the lazy dog again and again", "en", "s1", 59), (2, None, None, None, None), (3, "", "en", "s1", 0), (4, " \n\t ", "de", None, 4),
    (5, LONG, "en", "s2", len(LONG)), (6, LONG + " x", None, "s2", None), (None, "a row without an id, in some words", "fr", "s3", 3), (None, None, None, None, None), (7, "idiot moron scum idiot moron scum", "en", "s1", 33), (8, "日本語 の 文章 です", "ja", "é", 11), (9, "a", "en", "s1", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return df.select("*", *[F.lit(k).alias(k) for k in EXTRA]).cache()


@pytest.fixture(scope="module")
def side(spark):
    labels = spark.createDataFrame([(7, 1, 1), (1, 0, 0), (1, 1, 0), (5, 1, None), (None, 1, 1), (9, None, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "Brown fox JUMPS over"), (2, None), (None, "a"), (3, ""), (3, "word5 tail5")], "item_id long, text string")
    return labels, items


def operators(labels, items):
    return {
        "licences": lambda d: licenses.scan(d),
        "mixing": lambda d: mixing.planned(d),
        "language": lambda d: langid.identify(d, langid.fit(d)),
        "line dedup": lambda d: line_dedup.without_repeats(d, min_words=5),
        "sharding": lambda d: sharding.sharded(d),
        "fingerprints": lambda d: fingerprints.fingerprints(d),
        "jaccard": lambda d: jaccard.near_duplicates(d, n=4, percent=85),
        "decontamination": lambda d: decontaminate.contamination(d, items),
        "toxicity": lambda d: toxicity.toxicity(d, toxicity.fit(d, labels), passages=True),
    }


NAMES = list(operators(None, None))


@pytest.mark.parametrize("name", NAMES)
def test_one_row_for_each(docs, side, name):
    out = operators(*side)[name](docs).collect()
    assert len(out) == len(ROWS)


@pytest.mark.parametrize("name", NAMES)
def test_empty_and_all_null(spark, docs, side, name):
    f = operators(*side)[name]
    assert f(docs.limit(0)).collect() == []
    nothing = docs.select(*[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes]).limit(2)
    assert len(f(nothing).collect()) == 2


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, docs, side, tmp_path, k):
    labels, items = side
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, str(tmp_path))
    rows = out.collect()
    if name != "sharding":
        assert out.columns == docs.columns
    if name != "sharding":
        assert all(r[k] == k for r in rows for k in EXTRA)
    kept = {r.doc_id for r in rows}
    if name == "near_duplicates":
        assert kept == {r[0] for r in ROWS} - {6} and sum(r.doc_id is None for r in rows) == 2 and len(rows) == 10
    if name == "decontamination":
        assert kept == {2, 3, 4, 7, 8, None} and sum(r.doc_id is None for r in rows) == 1
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_chat_nulls(spark):
    df = spark.createDataFrame([(None, None, None, None, 1), (1, 0, "a", "x", 1), (1, 0, "a", "x", 1), (1, None, None, "", 1)], "conv_id long, turn long, role string, text string, perspective int")
    assert len(chat.rotations(df).collect()) == 7
