"""Each stage of the pipeline on its own input, against a plain version; and the whole."""

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from hopmill.llm.common import stash, word_count

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(100001, None, "en", "src1", 0), (100002, "123 ###", None, None, 7), (None, "Il était une fois dans la forêt", "fr", None, 9), (100004, "", "en", "src0", 0)], docs.schema)
    inputs = [docs.unionByName(odd)]
    for _, stage in P.STAGES:
        inputs.append(stash(stage(spark, inputs[-1], SF), "test"))
    return [df.collect() for df in inputs]


def test_language_stage_keeps_what_has_letters(stages):
    assert sorted(str(r.doc_id) for r in stages[1]) == sorted(str(r.doc_id) for r in stages[0] if any(c.isalpha() for c in r.text or ""))


def test_near_dedup_keeps_one_of_each_group(stages):
    want = brute.near([(r.doc_id, r.text) for r in stages[1] if r.doc_id is not None], 5)
    assert sorted(r.doc_id for r in stages[2] if r.doc_id is not None) == sorted(i for i, (_, c) in want.items() if c == i)
    assert sum(r.doc_id is None for r in stages[2]) == 1


def test_decontamination_drops_documents_with_an_item(spark, stages):
    spell = lambda t: " " + " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split()) + " "
    items = [spell(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(str(r.doc_id) for r in stages[3]) == sorted(str(r.doc_id) for r in stages[2] if not any(t in spell(r.text) for t in items))
    assert len(stages[3]) < len(stages[2])


def test_decontamination_with_long_runs_of_names(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("text is not null").orderBy("item_id").first().text
    rows = [(1, "Reention. " * 20_000, "en", "src0", 0), (2, "Reention. " * 20_000 + item, "en", "src0", 0), (3, "1" + ".5" * 20_000, None, None, 0), (4, "1" + ".5" * 20_000 + " " + item, None, None, 0)]
    assert sorted(r.doc_id for r in P.decontamination(spark, spark.createDataFrame(rows, docs.schema), SF).collect()) == [1, 3]


def test_mixture_meets_the_targets(stages):
    size = lambda r: len(brute.words(r.text))
    names = sorted({r.source for r in stages[3] if r.source is not None}, key=str.encode) + [None] * any(r.source is None for r in stages[3])
    sizes = [sum(size(r) for r in stages[3] if r.source == s) for s in names]
    targets = brute.water_fill(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))])
    for s, t in zip(names, targets, strict=True):
        largest = max(size(r) for r in stages[3] if r.source == s)
        assert abs(sum(size(r) for r in stages[4] if r.source == s) - t) <= largest
    times = [sum(r.doc_id == d.doc_id for r in stages[4]) for d in stages[3]]
    assert max(times) <= 3 and set(times) > {0}


def test_shards_are_even(stages):
    rows = stages[5]
    assert len(rows) == len(stages[4]) and {r.shard for r in rows} <= set(range(P.SHARDS))
    total, largest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    for s in range(P.SHARDS):
        mine = [r for r in rows if r.shard == s]
        assert abs(sum(r["size"] for r in mine) - total / P.SHARDS) <= largest
        assert sorted(r.slot for r in mine) == list(range(len(mine)))


def test_run_equals_its_stages(spark):
    rows = P.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in P.STAGES:
        docs = stash(stage(spark, docs, SF), "test")
    key = lambda r: (r.doc_id, r.shard, r.slot, r["size"])
    assert sorted(map(key, rows.collect())) == sorted(map(key, docs.collect()))
    assert docs.count() > 0 and word_count(F.lit(None)) is not None


def test_empty_input_passes_every_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stash(stage(spark, docs, SF), "test")
    assert docs.count() == 0
