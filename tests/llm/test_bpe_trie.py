"""BPE by a trie against the tokenizers library."""

import hashlib

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.llm import bpe_trie
from tickloom.llm.queries import QUERIES
from tickloom.llm.text_bytes import utf8

ALPHABET = "abeinst'.,<|>/w&1 2\n \u0085\x1c\x00ÀéßİIKſ̸́̇ñ×÷😀漢²"


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain(path):
    return pytest.importorskip("tokenizers").Tokenizer.from_file(path)


@pytest.fixture(scope="module")
def encoder(path):
    return bpe_trie.Words(path)


def encoded(encoder, texts):
    data, offs = utf8(pa.array(texts))
    ids, upto = encoder.encode(data, offs)
    return [ids[a:b].tolist() for a, b in zip(upto[:-1], upto[1:], strict=True)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=25) | st.text(max_size=12), min_size=1, max_size=6))
def test_texts_equal_the_library(encoder, plain, texts):
    assert encoded(encoder, texts) == [plain.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", "a", " ", "é", "1", "don't", "\n", "I'LL"]), max_size=9).map("".join))
def test_special_tokens_count_as_written(encoder, plain, text):
    assert encoded(encoder, [text, text[:7], text]) == [plain.encode(t, add_special_tokens=False).ids for t in (text, text[:7], text)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=14) | st.text(alphabet="theandring", min_size=1, max_size=14).map(str.encode), min_size=1, max_size=20, unique=True))
def test_trie_equals_the_merge_rules(encoder, batch):
    rules, batch = encoder.rules, sorted(batch)
    want = [rules.merged([*(rules.inner[b] for b in w[:-1]), rules.final[w[-1]]]) for w in batch]
    assert bpe_trie.PrefixTrie(rules).encode(batch) == want == encoder.trie.encode(batch)


def test_full_tables_are_emptied(path, plain, monkeypatch):
    monkeypatch.setattr(bpe_trie, "CACHE_WORDS", 5)
    monkeypatch.setattr(bpe_trie, "TRIE_NODES", 7)
    monkeypatch.setattr(bpe_trie, "PAIRS", 3)
    small = bpe_trie.Words(path)
    for text in ("the cat sat on the mat", "another sentence, with other words", "the cat again"):
        assert encoded(small, [text]) == [plain.encode(text, add_special_tokens=False).ids]


def test_operator_on_odd_rows(spark, odd, odd_rows, empty, path, plain):
    rows = bpe_trie.decode(bpe_trie.encode(odd, path, into="n"), path, ids="n", into="token").collect()
    assert sorted(rows[0].asDict()) == sorted(odd.columns)  # clashing columns are replaced, the others stay
    want = sorted((r[0] is None, r[0] or 0, (ids := plain.encode(r[1] or "", add_special_tokens=False).ids), plain.decode(ids, skip_special_tokens=False)) for r in odd_rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, list(r.n), r.token) for r in rows) == want
    assert bpe_trie.decode(bpe_trie.encode(empty, path), path).count() == 0


def test_decoding_of_unknown_ids(spark, path, plain):
    df = spark.createDataFrame([([1, None, 10_000_000, -5, 2],), (None,), ([],), ([49407],)], "ids array<int>")
    got = [r.text for r in bpe_trie.decode(df, path).collect()]
    assert got == [plain.decode([1, 2], skip_special_tokens=False), "", "", "<|endoftext|>"]


def test_very_long_text(spark, path, plain):
    text = "".join(f"wörd{i % 3001}, ünd " for i in range(300_000)) + "theandring" * 30_000
    assert len(text.encode()) > 4 << 20
    got = bpe_trie.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), path).first()
    assert list(got.ids) == plain.encode(text, add_special_tokens=False).ids


def test_query_digests(spark, small, plain):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in QUERIES["op12_bpe"](spark, small).collect():
        ids = plain.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(plain.decode(ids, skip_special_tokens=False)))
