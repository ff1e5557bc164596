"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.llm import bpe_trie, collocations, exact_dedup, fingerprint, language_id, lexical_search, mixing, ngram_join, packing, pii, toxicity, url_filter, warc
from tickloom.llm.registry import ORACLES, QUERIES, query, table
from tickloom.session import scratch_path

__all__ = ["ORACLES", "QUERIES"]


def vocabulary() -> str:
    """Path of the public vocabulary file; it lies on every machine and is never copied here."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op10_packing")
def op10_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


@query("op9_language_id")
def op9_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs)
    known = language_id.predict(docs.select("doc_id", "text"), model)
    return known.select("doc_id", language_id.held_out(known).alias("held_out"), "lang_pred", "score")


@query(
    "op6_exact_dedup",
    r"""
    WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
    SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
    FROM d WINDOW g AS (PARTITION BY text_sha256)
    """,
)
def op6_exact_dedup(spark, sf_dir):
    return exact_dedup.with_groups(table(spark, sf_dir, "documents")).select("doc_id", *exact_dedup.DECISIONS)


@query(
    "op3_warc",
    """
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
    h AS (SELECT page_id, payload, octet_length(payload) AS payload_bytes, upper(sha1(payload)) AS digits, min(page_id) OVER (PARTITION BY payload) AS first_id FROM p),
    b AS (
        SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(digits, 1 + 5 * (k // 4), 5))::BIGINT >> (5 * (3 - k % 4))) & 31), 1), '' ORDER BY k) AS payload_digest
        FROM h, range(32) r(k) GROUP BY page_id
    )
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first_id THEN first_id END AS refers_to
    FROM h JOIN b USING (page_id)
    """,
)
def op3_warc(spark, sf_dir):
    path = scratch_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read_records(spark, path)


@query("op5_toxicity")
def op5_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    known = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return known.select("doc_id", toxicity.held_out(known).alias("held_out"), "score", "predicted", F.size("segments").alias("n_segments"))


@query("op7_fingerprint")
def op7_fingerprint(spark, sf_dir):
    rows = fingerprint.with_next(table(spark, sf_dir, "documents"))
    prints = rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint.fingerprint(F.col("text")).alias("fingerprint"),
        fingerprint.fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint",
    )
    own = F.col("fingerprint")
    return prints.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        fingerprint.likeness(own, F.col("edited_fingerprint")).alias("near_edited"), fingerprint.likeness(own, F.col("next_fingerprint")).alias("near_next"),
    )


@query(
    "op8_mixing",
    """
    WITH s AS (SELECT source, sum(greatest(1, coalesce(length(text), 0))) AS size FROM documents GROUP BY source),
    w AS (SELECT source, size, pow(size, 0.7) / sum(pow(size, 0.7)) OVER () * sum(size) OVER () / size AS rate FROM s),
    k AS (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT + 1)) AS k FROM w),
    p AS (SELECT source, k, exp(-rate + k * ln(rate) - sum(ln(greatest(k, 1))) OVER (PARTITION BY source ORDER BY k)) AS p FROM k),
    c AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS upto FROM p),
    u AS (SELECT doc_id, source, ('0x' || substr(md5('mix-1|' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
    n AS (SELECT doc_id, u.source, count(*) FILTER (upto <= u) AS copies FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source GROUP BY ALL)
    SELECT doc_id, source, unnest(range(1, copies + 1))::INTEGER AS copy, copies::INTEGER AS copies FROM n WHERE copies > 0
    """,
)
def op8_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "copy", "copies")


@query("op1_ngram_join")
def op1_ngram_join(spark, sf_dir):
    return ngram_join.link(table(spark, sf_dir, "documents"))


@query("op2_pii")
def op2_pii(spark, sf_dir):
    found = pii.find(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[f"n_{k}" for k in pii.KINDS], F.sha2(pii.as_text(F.col("base")), 256).alias("base_sha256"),
        pii.as_text(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_terms"),
    )

URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


@query("op4_url_filter")
def op4_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


@query("op12_bpe")
def op12_bpe(spark, sf_dir):
    encoded = bpe_trie.encode(table(spark, sf_dir, "documents"), vocabulary(), keep=["doc_id"], decoded="decoded")
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query(
    "op13_lexical_search",
    r"""
    WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
    c AS (SELECT count(*) FILTER (len(terms) > 0) AS n_docs, sum(len(terms))::BIGINT AS n_words FROM d),
    t AS (SELECT row_id, doc_id, len(terms) AS n, unnest(terms) AS term FROM d),
    f AS (SELECT row_id, doc_id, n, term, count(*) AS tf FROM t GROUP BY ALL),
    q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
    w AS (SELECT term, floor(1000 * ln((2 * max(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f, c GROUP BY term),
    s AS (
        SELECT item_id, row_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_words))))::BIGINT AS score
        FROM q JOIN f USING (term) JOIN w USING (term), c GROUP BY ALL
    ),
    r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
    SELECT * FROM r WHERE rank <= 10
    """,
)
def op13_lexical_search(spark, sf_dir):
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "op11_collocations",
    r"""
    WITH p AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents
    ),
    w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
    i AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
    o AS (SELECT lang, array_to_string(ws[i : i + k - 1], ' ') AS phrase, k FROM i, range(1, 5) v(k) WHERE i + k - 1 <= len(ws)),
    f AS (SELECT lang, phrase, k, count(*) AS a FROM o GROUP BY ALL),
    t AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
    c AS (SELECT lang, phrase, k AS size, a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2 AND a >= 30),
    k AS (SELECT *, unnest(range(1, size)) AS j FROM c),
    s AS (
        SELECT k.lang, k.phrase, k.a, x.a AS l, y.a AS r, ((2000000::HUGEINT * k.a) // (x.a + y.a))::BIGINT AS score, j
        FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(ws[1 : j], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(ws[j + 1 : size], ' ')
        QUALIFY row_number() OVER (PARTITION BY k.lang, k.phrase ORDER BY score, j) = 1
    ),
    m AS (SELECT lang, ws, size, a, unnest(range(2, size)) AS m FROM c WHERE size > 2),
    h AS (SELECT lang, ws, a, m, unnest(range(1, size - m + 2)) AS i FROM m),
    e AS (SELECT lang, array_to_string(ws[i : i + m - 1], ' ') AS phrase, max(a) AS longer FROM h GROUP BY ALL)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, s.a DESC, phrase) AS rank, phrase, s.a, l, r, n, score
    FROM s LEFT JOIN e USING (lang, phrase) JOIN t USING (lang) WHERE longer IS NULL OR 100 * longer < 80 * s.a
    QUALIFY rank <= 2000
    """,
)
def op11_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))
