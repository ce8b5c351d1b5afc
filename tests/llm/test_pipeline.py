"""The pipeline against its stages worked out by hand."""

from __future__ import annotations

import collections

from test_operators import SF, brute_components

import corpus_pipeline
from logspark.llm import mixing, packing, quality


def test_stages_add_up(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r["doc_id"] for r in quality.quality_verdicts(docs).filter("kept").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect() if r["doc_id"] in good}
    last = {}
    for i in sorted(texts):
        last[texts[i]] = i
    texts = {i: texts[i] for i in last.values()}
    stay = {i for i, (component, _) in brute_components(texts).items() if component == i}
    packed = collections.Counter()
    for r in corpus_pipeline.run(spark, SF).collect():
        assert r["doc_ids"] == [p["doc_id"] for p in r["pieces"]] and r["fill"] == sum(p["length"] for p in r["pieces"])
        for p in r["pieces"]:
            packed[p["doc_id"]] += p["length"]
    assert packed == {i: len(texts[i].encode().split()) for i in stay}


def test_bins_follow_the_mix(spark):
    """Removing or reweighting the mix changes the bins; documents of a bin are near each other in the mix."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(20 + i % 7)), "en", "abc"[min(i % 10, 2)]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(7)

    def bins(options=None):
        spots = mixing.with_spots(docs, **(options or {}))
        out = packing.packed_sequences(spots, order=["mix_slot", "mix_place"], capacity=100, group_rows=50).orderBy("place").collect()
        assert sorted(i for r in out for i in r["doc_ids"]) == list(range(400))
        return [tuple(r["doc_ids"]) for r in out], {r["doc_id"]: (r["mix_slot"], r["mix_place"]) for r in spots.collect()}

    got, spots = bins()
    rank = {i: n for n, i in enumerate(sorted(spots, key=spots.get))}
    assert len(set(spots.values())) == 400
    assert all(len({rank[i] // 50 for i in b}) == 1 for b in got)
    firsts = [min(rank[i] for i in b) for b in got]
    assert firsts == sorted(firsts)
    plan = {r["doc_id"]: (r["slot"], r["place"]) for r in mixing.mix_plan(docs).collect()}
    assert spots == plan
    weighed, _ = bins({"targets": {"a": 1.0, "b": 1.0, "c": 20.0}})
    unmixed = packing.packed_sequences(docs, capacity=100, group_rows=50).collect()
    assert weighed != got and {frozenset(b) for b in weighed} != {frozenset(b) for b in got}
    assert {frozenset(r["doc_ids"]) for r in unmixed} != {frozenset(b) for b in got}


def test_pipeline_bins_have_places(spark):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(100)
    spots = stages["source mix"](spark, docs, SF)
    places = [r["place"] for r in stages["best-fit packing"](spark, spots, SF).collect()]
    assert places and None not in places and all(0 <= p < 100 for p in places)


def test_stages_on_odd_rows(spark, odd):
    """Nulls, repeats, empty and very long texts go through all stages, and so does an empty table."""
    for docs in (odd, odd.limit(0)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns[: len(columns)] == columns, name
        bins = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
        assert sum(p["length"] for r in bins for p in r["pieces"]) == sum(len(t.encode().split()) for (t,) in docs.select("text").collect())
