"""Collocations against plain counting and against SQL."""

import re
from collections import Counter

import numpy as np
import pytest
from compare import connect, difference
from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.llm import collocations
from tickloom.llm.queries import ORACLES, QUERIES


def brute(docs, least, top):
    counts, totals = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            ws = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(ws)
            counts.update((lang, tuple(ws[i : i + k])) for k in range(1, 5) for i in range(len(ws) - k + 1))
    own = {x: a for x, a in counts.items() if len(x[1]) >= 2 and a >= least}
    longer, out = {}, []
    for (lang, q), b in own.items():
        for k in range(2, len(q)):
            for i in range(len(q) - k + 1):
                longer.setdefault((lang, q[i : i + k]), []).append(b)
    for (lang, p), a in own.items():
        score, k = min((2000000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k) for k in range(1, len(p)))
        if not any(100 * b >= 80 * a for b in longer.get((lang, p), [])):
            out.append((lang, -score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    rows, rank = [], Counter()
    for lang, score, a, phrase, left, right in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            rows.append((lang, rank[lang], phrase.decode(), -a, left, right, totals[lang], -score))
    return rows


def rows(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=4), max_size=40), st.integers(1, 6), st.sampled_from([1, 2, 4]))
def test_partition_sizes_are_counts(pointers, least, whole):
    keys = np.zeros((len(pointers), 4), np.int64)
    for i, p in enumerate(pointers):
        keys[i, : len(p)] = p
    weights = np.arange(len(pointers)) % 3 + 1
    want = Counter()
    for p, n in zip(pointers, weights, strict=True):
        want.update({tuple(p[:k]): int(n) for k in range(1, len(p) + 1)})
    found = collocations.multikey_quicksort(keys, weights, least, whole)
    got = {tuple(keys[r, :d].tolist()): c for r, d, c in found}
    assert len(got) == len(found) and got == {p: c for p, c in want.items() if c >= least or len(p) < whole and all(want[p[:k]] >= least or k < whole for k in range(1, len(p)))}


def skewed(n=1500):
    """One word and one pair lead a third of all pointers, with odd marks and spaces in between."""
    rng = np.random.default_rng(3)
    marks = [" ", " ", " ", "  ", "\t", ", ", ". ", "\n", " ! ", " ", ":"]
    out = []
    for i in range(n):
        words = [f"W{x}" for x in rng.zipf(1.4, 12) % 40]
        for k in range(0, 12, 3):
            words[k : k + 2] = ["The", "hot"]
        text = "".join(w + marks[rng.integers(0, len(marks))] for w in words)
        out.append((i, text, ["en", "en", "en", None, "und", "fr"][i % 6]))
    return out


@pytest.mark.parametrize("bits", [1 << 27, 1 << 15])
@pytest.mark.parametrize("width", [3, 40])
def test_hot_words_and_full_filters(spark, monkeypatch, bits, width):
    monkeypatch.setattr(collocations, "FILTER_BITS", bits)
    monkeypatch.setattr(collocations, "BLOCK_ROWS", 300)
    monkeypatch.setattr(collocations, "SLICE", 2000)
    docs = skewed()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", width)
    try:
        got = rows(collocations.collocations(spark.createDataFrame(docs, "doc_id long, text string, lang string"), 30, 50))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = brute([d[1:] for d in docs], 30, 50)
    assert got == want and len(want) > 20


def test_odd_rows(spark, odd, odd_rows, empty):
    twice = odd.unionByName(odd).selectExpr("*", "1 AS a", "2 AS phrase", "3 AS rank")
    assert rows(collocations.collocations(twice, 2, 100_000)) == brute([r[1:3] for r in odd_rows] * 2, 2, 100_000)
    assert collocations.collocations(empty).count() == 0


def test_products_beyond_64_bits(spark, monkeypatch):
    """a is so large that 2,000,000 a does not fit a long."""
    monkeypatch.setattr(collocations, "phrase_counts", lambda docs, least: spark.createDataFrame([("en", "a b", 10**16), ("en", "a", 10**16), ("en", "b", 10**16 + 1), ("en", "", 10**17)], "lang string, phrase string, n long"))
    assert rows(collocations.collocations(spark.range(1)))[0][-1] == 2000000 * 10**16 // (2 * 10**16 + 1)


def test_very_long_text(spark):
    docs = [(1, "alpha beta gamma " * 150_000 + "x" * 1_000_000, "en"), (2, "alpha beta", "en")]
    got = rows(collocations.collocations(spark.createDataFrame(docs, "doc_id long, text string, lang string")))
    assert got == brute([d[1:] for d in docs], 30, 2000)


def test_query_equals_sql(spark, small):
    assert difference(QUERIES["op11_collocations"](spark, small).toPandas(), connect(small).sql(ORACLES["op11_collocations"]).df()) is None
