"""Near-duplicate join, components and exact duplicates against brute force."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.llm import components as components_module
from tickloom.llm import exact_dedup, ngram_join
from tickloom.llm.components import components

_SMALL = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(_SMALL))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """(doc_id, n_shingles, component_id) of every row, from all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def linked(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link(df).collect()), key=str)


def test_odd_rows(odd, odd_rows):
    assert linked(odd) == brute([(r[0], r[1]) for r in odd_rows])


def test_null_ids_link_and_bridge(spark, odd_rows):
    """Near copies with null ids only: one links two documents that are not alike, two are alike with nobody else."""
    def edited(prefix, *at):
        return " ".join(f"edit{i}" if i in at else f"{prefix}{i}" for i in range(200))

    near, far = edited("bridge", 20, 60, 100), edited("bridge", 20, 60, 100, 140, 160, 180)
    rows = [(r[0], r[1]) for r in odd_rows]
    rows += [(21, edited("bridge")), (None, near), (None, near), (22, far), (None, edited("lone")), (None, edited("lone", 7)), (None, None), (23, edited("lone2"))]
    want = brute(rows)
    assert (22, 196, 21) in want and want.count((None, 196, 21)) == 2 and want.count((None, 196, None)) == 2
    assert linked(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == want


def test_empty_table(empty):
    assert linked(empty) == []
    assert exact_dedup.with_groups(empty).count() == 0


def test_chains_hot_passages_and_groups_of_copies(spark, monkeypatch):
    """Edited copies of one text, all holding a passage that strangers share; small blocks and few frequent shingles."""
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 3000)
    monkeypatch.setattr(ngram_join, "LEAF", 4)
    monkeypatch.setattr(ngram_join, "FREQUENT", 50)
    rng = random.Random(5)
    passage = [f"shared{i}" for i in range(60)]
    rows = []
    for family in range(3):
        base = [f"f{family}w{i}" for i in range(120)] + passage
        for _ in range(40):
            text = list(base)
            for k in rng.sample(range(len(text)), rng.randrange(0, 7)):
                text[k] = f"e{rng.randrange(10**9)}"
            base = text if rng.random() < 0.5 else base
            rows.append((len(rows), " ".join(text)))
    rows += [(1000 + i, " ".join([f"x{i}y{k}" for k in range(rng.randrange(3, 200))] + passage)) for i in range(40)]
    rows += [(2000 + i, rows[3][1]) for i in range(30)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    want = brute(rows)
    assert linked(df) == want
    assert len({c for _, _, c in want}) > 41


def test_threshold_is_exact(spark):
    # 40 and 50 shingles: 40 / 50 links; one shingle more does not
    long_, short, longer = (" ".join(f"t{i}" for i in range(n + 4)) for n in (50, 40, 51))
    df = spark.createDataFrame([(1, long_), (2, short), (3, longer + " z")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.link(df).collect()} == {1: 1, 2: 1, 3: 1}
    df = spark.createDataFrame([(2, short), (3, longer)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.link(df).collect()} == {2: 2, 3: 3}


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 400), min_size=1, max_size=120), st.sets(st.integers(0, 400), min_size=1, max_size=120))
def test_bound_never_below_overlap(a, b):
    h = [ngram_join.mix(np.array(sorted(x), np.uint64)) for x in (a, b)]
    n = np.array([len(x) for x in h])
    points = ngram_join.vectors([ngram_join.count_vector(x) for x in h], n)
    assert np.minimum(points[0], points[1]).sum() >= len(a & b)
    if 100 * len(a & b) >= 80 * len(a | b):
        i, j, _ = ngram_join.close_pairs(points, n, np.array([0, 1]))
        assert {int(i[0]), int(j[0])} == {0, 1}
        first = [set(ngram_join.Frequent(h[0][:3][::-1]).in_order(np.sort(x))[0][: ngram_join.prefix_length(len(x))].tolist()) for x in h]
        assert first[0] & first[1]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sets(st.integers(0, 60), max_size=30), min_size=1, max_size=12))
def test_overlaps(sets):
    got = ngram_join.overlaps([np.array(sorted(s), np.uint64) for s in sets])
    assert got.tolist() == [[len(a & b) if i != j else got[i, i] for j, b in enumerate(sets)] for i, a in enumerate(sets)]


def test_full_counters_bound_nothing():
    wide = np.full(2000, 7, np.uint64)  # one group, beyond a byte
    point = ngram_join.vectors([ngram_join.count_vector(wide)], np.array([2000]))
    assert point.sum() >= 2000


def test_components_of_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {k: 100 for k in range(101, 140)}


def jobs_of(spark, run):
    """What ``run`` returns, and the number of Spark jobs that it starts."""
    group = f"jobs-{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_components_of_a_chain_take_few_jobs(spark):
    """The driver keeps threads, plans and hash tables of every job; what fits into one task needs no steps."""
    ids = random.Random(5).sample(range(10_000), 500)
    edges = spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long")
    got, jobs = jobs_of(spark, lambda: {r.node: r.root for r in components(edges).collect()})
    assert got == {i: min(ids) for i in ids if i != min(ids)}
    assert jobs <= 8


def test_components_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(components_module, "TASK_EDGES", 60)
    rng = random.Random(6)
    ids = rng.sample(range(10_000), 150)
    edges = list(zip(ids, ids[1:])) + [(20_000, k) for k in range(20_001, 20_060)] + [(30_000 + rng.randrange(60), 30_000 + rng.randrange(60)) for _ in range(60)]
    edges += edges[:20]
    parent = {n: n for e in edges for n in e}
    for a, b in edges:
        a, b = ngram_join._find(parent, a), ngram_join._find(parent, b)
        parent[max(a, b)] = min(a, b)
    want = {n: ngram_join._find(parent, n) for n in parent}
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(rows) == len({r.node for r in rows})
    assert {r.node: r.root for r in rows} == {n: r for n, r in want.items() if n != r}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([(7, 7)], "a long, b long")).count() == 0
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("hot_share", [exact_dedup.HOT_SHARE, 1])
def test_exact_groups(spark, monkeypatch, hot_share):
    if hot_share == 1:
        monkeypatch.setattr(exact_dedup, "HOT_LEAST", 3)
    rows = [(i, "a  b\n c" if i % 3 else "a b c", i) for i in range(100, 160)] + [(1, None, 0), (2, "", 0), (3, " ", 0), (4, "\t\n", 0), (5, "x", 0), (5, "x", 0), (None, "x", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __digest int")
    df = df.withColumnRenamed("__digest", "keep_id")
    got = exact_dedup.with_groups(df, hot_share=1_000_000 if hot_share == 1 else hot_share).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(re.sub("[\x20\x09-\x0d]+", " ", r.text or ""), []).append(r)
    for group in by.values():
        ids = [r.doc_id for r in group if r.doc_id is not None]
        assert {r.keep_id for r in group} == {min(ids)} and {r.group_size for r in group} == {len(group)}
        assert [r.doc_id for r in group if r.kept] == [min(ids)]


def test_odd_rows_exact(odd, odd_rows):
    got = exact_dedup.with_groups(odd).collect()
    assert len(got) == len(odd_rows)
    assert sum(r.kept for r in got) == len({re.sub("[\x20\x09-\x0d]+", " ", r[1] or "") for r in odd_rows})
    assert got[0].asDict().keys() == {*odd.columns, "group_size", "text_sha256"}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(1, 60), st.booleans(), st.integers(0, 2)), min_size=1, max_size=30))
def test_bucket_rows_without_a_possible_link_are_dropped(rows):
    rows = sorted((t, 256 * ngram_join.size_class_of(n) + 128 * s + (7 if salt == 2 else 0), n) for t, n, s, salt in rows)
    token, kind, n = (np.array(x, np.int64) for x in zip(*rows, strict=True))
    kept = ngram_join.with_possible_link(token, kind)
    cls, short = kind >> 8, kind >> 7 & 1
    for i in range(len(rows)):
        near = [j for j in range(len(rows)) if j != i and token[j] == token[i]]
        want = any(short[i] and cls[j] - cls[i] in (0, 1) or short[j] and cls[i] - cls[j] in (0, 1) for j in near)
        assert kept[i] == (want or kind[i] & 127 > 0)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 400), min_size=1, max_size=120), st.sets(st.integers(0, 400), max_size=8), st.sets(st.integers(0, 400), max_size=8))
def test_linked_sets_stay_in_a_bucket(a, more, less):
    b = (a | more) - less
    if not b or 100 * len(a & b) < 80 * len(a | b):
        return
    small, large = sorted((a, b), key=len)
    assert ngram_join.size_class_of(len(large)) - ngram_join.size_class_of(len(small)) in (0, 1)
    x, y = (ngram_join.mix(np.array(sorted(s), np.uint64)) for s in (small, large))
    order = ngram_join.Frequent(x[:3][::-1])
    first = order.in_order(np.sort(x))[0][: ngram_join.short_prefix_length(len(x))], order.in_order(np.sort(y))[0][: ngram_join.prefix_length(len(y))]
    assert set(first[0].tolist()) & set(first[1].tolist())


def test_texts_travel_only_of_compared_nodes(spark, monkeypatch):
    """Strangers that share passages have buckets in common, but their texts are never fetched; neither is a text twice."""
    sent = []
    plain = ngram_join._texts
    monkeypatch.setattr(ngram_join, "_texts", lambda *x: sent.append(plain(*x)) or sent[-1])
    rng = random.Random(3)
    passage = " ".join(f"shared{i}" for i in range(12))
    rows = [(i, " ".join(f"s{i}w{k}" for k in range(40)) + " " + passage) for i in range(60)]
    near = [f"n{k}" for k in range(80)]
    rows += [(100, " ".join(near)), (101, " ".join(near[:-1] + ["other"])), (100, "another text"), (101, " ".join(near[:-1] + ["other"]))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert linked(df) == brute(rows)
    assert [s.count() for s in sent] == [2, 0]
