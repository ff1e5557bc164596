"""Ranked search against a plain scan and against SQL."""

import math
import re

import numpy as np
import pytest
from compare import connect, difference

from tickloom.llm import lexical_search
from tickloom.llm.queries import ORACLES, QUERIES


def terms_of(text):
    return re.findall(lexical_search.TERM, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    bags = [(doc_id, terms_of(text)) for doc_id, text in docs]
    n_docs, n_words = sum(1 for _, t in bags if t), sum(len(t) for _, t in bags)
    df = {}
    for _, t in bags:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    by_item = {}
    for item_id, text in items:
        by_item.setdefault(item_id, set()).update(terms_of(text))
    out = []
    for item_id, own in by_item.items():
        found = []
        for doc_id, t in bags:
            m = 100 - 90 + (90 * len(t) * n_docs) // max(1, n_words)
            score = 0
            for x in own & set(t):
                tf = t.count(x)
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((1000000000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0, doc_id, score))
        out += [(item_id, r + 1, d, s) for r, (_, _, _, d, s) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def rows(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


ITEMS = [(1, "Hello WORLD tok5 tok150 other"), (2, None), (3, ""), (4, "Null id, café! ñandú 你好 😀"), (5, "nowhere-to-be-found"), (6, "one two three one"), (6, "tok7"), (None, "three word1x1"), (8, "a A A b c d 12345")]


def items_frame(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 AS rank", "2 AS score", "3 AS doc_id", "'x' AS term")


def test_odd_rows(spark, odd, odd_rows, empty):
    docs = [(r[0], r[1]) for r in odd_rows]
    for k in (1, 2, 10):
        assert rows(lexical_search.search(odd, items_frame(spark), k)) == brute(docs, ITEMS, k)
    assert lexical_search.search(empty, items_frame(spark)).count() == 0
    none = lexical_search.search(odd, items_frame(spark).where("item_id < -1"))
    assert none.count() == 0 and none.columns == ["item_id", "rank", "doc_id", "score"]


def test_groups_of_copies_and_blocks(spark, monkeypatch):
    """A third of all rows are copies in other orders of words; bags pass through small memories and several blocks."""
    monkeypatch.setattr(lexical_search, "HELD_BYTES", 500)
    monkeypatch.setattr(lexical_search, "CELLS", 8)
    rng = np.random.default_rng(5)
    docs = []
    for i in range(900):
        own = ["alpha", "beta", "gamma", "beta"] if i % 3 == 0 else [f"w{x}" for x in rng.zipf(1.5, 30) % 50]
        rng.shuffle(own)
        docs.append((int(rng.integers(0, 500)), " ".join(own)))
    items = [(i, " ".join(f"w{x}" for x in rng.integers(0, 50, 6)) + (" beta" if i % 4 == 0 else "")) for i in range(25)]
    got = lexical_search.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"), block_terms=30)
    assert rows(got) == brute(docs, items)


def test_sums_are_whole_numbers():
    """Scores of more than 53 bits."""
    vocabulary = lexical_search.Vocabulary([(0, f"t{i}") for i in range(300)])
    bag = np.stack((np.arange(300), np.full(300, 7)), axis=1).astype("<u4").tobytes()
    weights = np.full(300, 10**9 + 7, np.int64)
    (_, _, scores), = lexical_search.scores_of([bag], np.array([3]), weights, vocabulary)
    assert scores.tolist() == [[300 * (10**9 + 7) * (7 * 10**9 // 7024)]] and scores[0, 0] > 1 << 53


def test_equal_hashes_are_compared():
    vocabulary = lexical_search.Vocabulary([(1, "abc"), (1, "de"), (2, "abc")])

    class Same:
        def find(self, hashes):
            return np.zeros(len(hashes), np.int32)

    data = np.frombuffer(b"abc abd ab", np.uint8)
    got = vocabulary.find(Same(), data, np.array([0, 4, 8]), np.array([3, 7, 10]), np.zeros(3, np.uint64))
    assert got.tolist() == [0, -1, -1]


def test_very_long_text(spark):
    docs = [(1, "needle " + "hay é " * 900_000), (2, "needle hay")]
    items = [(1, "needle"), (2, "hay stack")]
    got = lexical_search.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert rows(got) == brute(docs, items)


@pytest.mark.parametrize("name", ["op13_lexical_search"])
def test_query_equals_sql(spark, small, name):
    assert difference(QUERIES[name](spark, small).toPandas(), connect(small).sql(ORACLES[name]).df()) is None
