from collections import Counter

import corpus_pipeline
import pytest
from test_decontaminate import brute as hits
from test_jaccard import brute as groups
from test_native_ops import targets_by_hand

from laconic.llm import toxicity
from laconic.llm.common import remainder
from laconic.llm.mixing import planned

DATA = "/root/testdata/sf0.001"


def test_each_stage_like_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    outs = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        outs.append(docs)
    assert all(o.columns == columns for o in outs[:-1])
    kept = [[r.doc_id for r in o.select("doc_id").collect()] for o in outs]
    # toxicity: what the fitted model predicts, row by row
    source = spark.read.parquet(f"{DATA}/documents.parquet")
    model = toxicity.fit(source, spark.read.parquet(f"{DATA}/labels.parquet").where(remainder("doc_id", 5) != 0))
    toxic = {r.doc_id for r in toxicity.toxicity(source, model).where("predicted = 1").collect()}
    assert sorted(kept[0]) == sorted(set(texts) - toxic)
    # near duplicates
    of = groups([(i, texts[i]) for i in kept[0]], 5, 80)
    assert sorted(kept[1]) == sorted(i for i in kept[0] if of[i][0] == 0 or of[i][1] == i)
    # benchmark
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    found = hits([(i, texts[i]) for i in kept[1]], items)
    assert sorted(kept[2]) == sorted(i for i in kept[1] if not found[i][4])
    # mixing
    plan = planned(outs[2]).collect()
    sizes, target = Counter(), {}
    for r in plan:
        sizes[r.source] += r._size
        target[r.source] = r._target
    for s, t in targets_by_hand(sizes).items():
        assert target[s] == pytest.approx(t)
    assert Counter(kept[3]) == {r.doc_id: r._copies for r in plan if r._copies}
    # shards
    assert Counter(kept[4]) == Counter(kept[3])
    counts = Counter(r.shard for r in outs[4].collect())
    assert max(counts.values()) - min(counts[s] for s in range(8)) <= 1


def test_run(spark):
    rows = corpus_pipeline.run(spark, DATA)
    assert {"shard", "slot", "text"} <= set(rows.columns) and rows.count() > 0
