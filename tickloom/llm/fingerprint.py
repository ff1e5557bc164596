"""Merkle fingerprints of documents, in DataFrame operations only.

A text is a tree: sections (which end with a blank line) of paragraphs (which end with a line) of leaves (at most
``WORDS`` words of at most ``LETTERS`` characters, which end with a sentence). The leaves joined are the text. A node's
hash is the hash of its stored children joined, so equal roots mean equal texts, and where roots differ the differing
branches show the place. The rule is the same for texts of any length. The fingerprint is the text

    root:sections:paragraphs:leaves

with sections and paragraphs comma-joined, the leaves of a paragraph joined (``DIGITS`` characters each), and a semicolon
between the children of two sections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.scan import neighbour, range_chunks

WORDS, LETTERS = 4, 24
DIGITS = 8
_FIRST = -(1 << 63)


def _hash(value: Column) -> Column:
    return F.lpad(F.hex(F.xxhash64(value)), 16, "0")


def _leaf_hash(value: Column) -> Column:
    """The first ``DIGITS`` digits of the hash; the added bit keeps leading zeros, which costs less than padding."""
    return F.substring(F.hex(F.shiftrightunsigned(F.xxhash64(value), 32) + F.lit(1 << 32)), 2, DIGITS)


def leaves(text: Column) -> Column:
    """All of a text in pieces of a few words that end with a sentence or a line."""
    stop = r"[\x20\n.!?]"
    word = r"[^\x20\n.!?]{1,%d}+\x20*+" % LETTERS
    return F.regexp_extract_all(text, F.lit(r"(?:%s){1,%d}+%s*+|%s++" % (word, WORDS, stop, stop)), F.lit(0))


def fingerprint(text: Column) -> Column:
    """Fingerprint of a text; null counts as empty, whose tree is one section of one paragraph without leaves."""
    sections = F.split(F.coalesce(text, F.lit("")), r"(?<=\n\n)(?=[^\n])")

    def paragraphs(section: Column) -> Column:
        return F.transform(F.split(section, r"(?<=\n)(?=[^\n])"), lambda p: F.array_join(F.transform(leaves(p), lambda x: _leaf_hash(x)), ""))

    # level by level from the leaves, each bound once as the argument of a lambda
    def node(section: Column) -> Column:
        def named(leaf: Column) -> Column:
            return F.struct(F.array_join(F.transform(leaf, lambda x: _hash(x)), ",").alias("paragraphs"), F.array_join(leaf, ",").alias("leaves"))

        return F.element_at(F.transform(F.array(paragraphs(section)), named), 1)

    def whole(nodes: Column) -> Column:
        inner = F.array_join(F.transform(nodes, lambda n: _hash(n["paragraphs"])), ",")
        return F.struct(inner.alias("sections"), F.array_join(F.transform(nodes, lambda n: n["paragraphs"]), ";").alias("paragraphs"), F.array_join(F.transform(nodes, lambda n: n["leaves"]), ";").alias("leaves"))

    def joined(tree: Column) -> Column:
        return F.concat_ws(":", _hash(tree["sections"]), tree["sections"], tree["paragraphs"], tree["leaves"])

    trees = F.transform(F.array(F.transform(sections, node)), whole)
    return F.element_at(F.transform(trees, joined), 1)


def _leaves(print_: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.element_at(F.split(print_, ":"), 4), F.lit("[^,;]{%d}" % DIGITS), F.lit(0)))


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of two fingerprints' distinct leaves; 1 for equal roots, whose branches need no look.

    Equal branches have equal leaves, so each counts with all its leaves wherever it stands.
    """
    value = F.element_at(
        F.transform(
            F.array(F.struct(_leaves(a).alias("x"), _leaves(b).alias("y"))),
            lambda s: 2.0 * F.size(F.array_intersect(s["x"], s["y"])) / F.greatest(F.size(s["x"]) + F.size(s["y"]), F.lit(1)),
        ), 1,
    )
    return F.when(F.substring_index(a, ":", 1) == F.substring_index(b, ":", 1), F.lit(1.0)).otherwise(value)


def changed_paragraphs(a: Column, b: Column) -> Column:
    """Numbers (from 1) of the paragraphs of ``a`` that differ from those of ``b``, by their places in the trees.

    Equal branches at both ends are left out. Between them, as many paragraphs on both sides are compared one by one
    (so moved and swapped ones are found); of unequal numbers all of ``a`` count as changed.
    """
    def level(print_: Column) -> Column:
        return F.split(F.element_at(F.split(print_, ":"), 3), "[,;]")

    def equal_ends(x: Column, y: Column) -> Column:
        differ = F.filter(F.transform(F.arrays_zip(x.alias("x"), y.alias("y")), lambda s, i: F.when(~s["x"].eqNullSafe(s["y"]), i)), lambda i: i.isNotNull())
        return F.coalesce(F.array_min(differ), F.size(x))

    def places(s: Column) -> Column:
        x, y = s["x"], s["y"]
        before = equal_ends(x, y)
        after = F.least(equal_ends(F.reverse(x), F.reverse(y)), F.least(F.size(x), F.size(y)) - before)
        middle = F.sequence(before + 1, F.greatest(F.size(x) - after, before + 1))
        inside = F.filter(middle, lambda i: i <= F.size(x) - after)
        return F.filter(inside, lambda i: (F.size(x) != F.size(y)) | (F.get(x, i - 1) != F.get(y, i - 1)))

    return F.element_at(F.transform(F.array(F.struct(level(a).alias("x"), level(b).alias("y"))), places), 1)


def with_next(docs: DataFrame) -> DataFrame:
    """Edited text and next document's fingerprint of each row.

    The next document is the one with the next larger doc_id, after the last the first; a null id comes
    first. Where rows share a doc_id, the one with the smallest text hash stands for it as a next document.
    Returns doc_id, text, ``edited`` (the last quarter of the code points replaced by the beginning of the
    next document) and ``next_fingerprint``; one row per input row.
    """
    # Both joins below read the very same rows by the same key, so the texts are shuffled once and read twice.
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("__id"), F.coalesce("text", F.lit("")).alias("text"))
    quarter = F.floor(F.length("text") / 4)
    ids = rows.groupBy("__id").agg(F.min(F.xxhash64("text")).alias("__hash"), F.max(quarter).cast("int").alias("__need"))
    chunked = range_chunks(ids, [], ["__id"])
    first = chunked.agg(F.min("__id")).first()[0]  # the last document is followed by the first
    near = neighbour(chunked, [], ["__id"], {"__next": "__id"}, following=True)
    links = near.select(F.coalesce("__next", F.lit(first).cast("long")).alias("__next"), F.col("__id").alias("__prev"), "__need")
    links = links.join(chunked.select(F.col("__id").alias("__next"), "__hash"), "__next")
    ahead = (
        rows.join(links, (F.col("__id") == F.col("__next")) & (F.xxhash64("text") - F.col("__hash") == 0))  # not a second key
        .select("__prev", F.expr("substring(text, 1, __need)").alias("__start"), fingerprint(F.col("text")).alias("next_fingerprint"))
        .dropDuplicates(["__prev"])
    )
    n = F.length("text")
    kept, new = F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 4) as int))"), F.expr("substring(__start, 1, cast(floor(length(text) / 4) as int))")
    doc_id = F.when(F.col("__id") != _FIRST, F.col("__id")).alias("doc_id")
    return rows.join(ahead, F.col("__id") == F.col("__prev")).select(doc_id, "text", n.cast("long").alias("n_chars"), F.concat(kept, new).alias("edited"), "next_fingerprint")
