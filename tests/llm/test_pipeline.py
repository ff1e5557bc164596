"""Queries of the text operators against their SQL twins, and the pipeline stage by stage."""

import re

import pytest
from compare import connect, difference

import corpus_pipeline
from test_join_and_dedup import shingles
from tickloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, small, name):
    assert difference(QUERIES[name](spark, small).toPandas(), connect(small).sql(ORACLES[name]).df()) is None


def test_one_query_per_operator():
    import __spark_entry__ as entry

    names = entry.queries()
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 14))
    assert "pipeline" in names and set(QUERIES) <= set(names)


def test_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, left = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == columns
        left[name] = docs.collect()
    flagged = {r.doc_id for r in QUERIES["op5_toxicity"](spark, small).where("predicted = 1").collect()}
    everything = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    clean = {r.doc_id for r in left["toxicity"]}
    assert clean == set(everything) - flagged
    plain = {}
    for i in sorted(clean):
        plain.setdefault(re.sub("[\x20\x09-\x0d]+", " ", everything[i] or ""), i)
    assert {r.doc_id for r in left["exact dedup"]} == set(plain.values())
    sets = {r.doc_id: shingles(r.text) for r in left["exact dedup"]}
    kept = {r.doc_id for r in left["n-gram join"]}
    for i in set(sets) - kept:
        assert any(100 * len(sets[i] & s) >= 80 * len(sets[i] | s) for j, s in sets.items() if j != i and s)
    ids = sorted(kept)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            assert not x or 100 * len(x & y) < 80 * len(x | y)
    assert {r.doc_id for r in left["mixing"]} <= kept
    assert {r.doc_id for r in left["packing"]} == {r.doc_id for r in left["mixing"]}


def test_near_copies_are_dropped_by_row(spark):
    """Clashing and null ids: clean rows stay, and one row of each group of near copies."""
    def text(prefix, *at):
        return " ".join(f"edit{i}" if i in at else f"{prefix}{i}" for i in range(100))

    rows = [
        (1, text("a"), "a1"), (5, text("a", 50), "a2"), (5, text("clean"), "clean"),  # a near copy and a clean row share an id
        (7, text("b"), "b1"), (7, text("b", 50), "b2"),  # two near copies share the smallest id
        (1, text("c"), "c"),  # its id also names another component
        (None, text("a", 20), "a3"), (None, text("d"), "d1"), (None, text("d", 30), "d2"), (None, text("alone"), "alone"),
        (9, text("e"), "e1"), (9, text("e"), "e1"), (None, text("f"), "f1"), (None, text("f"), "f1"), (8, None, "null"), (8, None, "null"), (None, " ", "white"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(4)
    out = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert out.columns == docs.columns
    kept = sorted(r.key[:1] if r.key[:1] in "bd" and len(r.key) == 2 else r.key for r in out.collect())
    assert kept == sorted(["a1", "clean", "b", "c", "d", "alone", "e1", "f1", "null", "null", "white"])


def test_stages_bound_batches_by_bytes(spark):
    """Long texts make batches of fewer rows, not larger ones; a bound that the session names stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    try:
        spark.conf.unset(key)
        docs = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat('abcd ', 2000) AS text", "'s' AS source")
        corpus_pipeline.mix_sources(spark, docs, "")
        most = docs.mapInPandas(lambda batches: (b.assign(n=b["text"].str.len().sum())[["n"]].head(1) for b in batches), "n long").groupBy().max("n").first()[0]
        assert most <= 8 << 20
        spark.conf.set(key, "1m")
        corpus_pipeline.mix_sources(spark, docs, "")
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
