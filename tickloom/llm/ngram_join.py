"""Near-duplicate join on word shingles with count-vector R-trees.

A document is the set of its distinct ``WIDTH``-word shingles; two documents link when 100 * overlap is at
least ``PERCENT`` * union. Documents with equal sets are one node.

* Count vectors: the shingles of a node are hashed into 16 to 4,096 groups (a power of two that follows the
  set's size, so vectors fold into shorter ones; trees use a quarter of the groups, single pairs all) and the counts of the groups are the node's point. The
  overlap of two sets is at most the sum of the smaller of each two counts.
* Buckets: shingles have a fixed total order, frequent ones last. Two linked nodes share one of the first
  n - ceil(PERCENT/100 n) + 1 shingles of either, so every pair to be looked at meets in the bucket of such a
  shingle; a bucket splits into classes of like size and large classes into blocks that meet pairwise. Of the smaller node
  that shingle is among its first ones by a stricter count; rows that no other row of the bucket can be linked to by size and these places are dropped.
* R-trees: in each block the points are packed into leaves with bounding boxes. Two leaves whose boxes' summed
  coordinate minima are below the least overlap are skipped whole, then single pairs are.
* Verification: what is left is compared on the whole shingle sets.

Two passes keep groups of copies from being expanded into pairs. The first takes a spanning forest of the pairs that
pass the bound, in the buckets of a few shingles a node, and verifies those pairs. The second goes over all buckets
whose nodes are still in several components: the R-trees name the rows that have a partner in another component, the
texts of these rows are brought to their blocks, and each block compares all its pairs exactly and returns a spanning
forest of the links. So no link between components is missed, and no table of pairs grows with the square of a group.
Texts travel only of nodes that a pass compares.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.components import components
from tickloom.llm.text_bytes import LOWER, Hasher, mix, slices, words
from tickloom.session import pin, shuffle_width

WIDTH = 5
PERCENT = 80
FREQUENT = 1 << 20  # length of the list of frequent shingles; it orders them, nothing is left out by it
SALTED = 65_536  # of the list: the rows of so many shingles are spread by salt
LEAF = 16
FILTER_BITS = 1 << 27  # of the filter that keeps the texts of nodes without a partner out of a shuffle
BLOCK_SHINGLES = 400_000  # of all sets of a block together
FIRST_TOKENS = 4
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_CLASS_BASE = 1.01 * 100 / PERCENT


class Shingler:
    """Distinct shingle hashes, ascending, of each text of a slice."""

    def __init__(self, width: int = WIDTH) -> None:
        self.width, self.hasher = width, Hasher()
        self.factors = [_FACTORS[i % 5] * np.uint64(2 * (i // 5) + 1) for i in range(width)]

    def sets(self, data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
        data = LOWER[data]
        starts, ends, at = words(data, offs)
        h = self.hasher.ranges(data, starts, ends)
        n = len(h)
        full = np.zeros(max(0, n - self.width + 1), np.uint64)
        for i, f in enumerate(self.factors):
            full += h[i : i + len(full)] * f
        full = mix(full)
        out = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= self.width:
                out.append(np.unique(full[a : b - self.width + 1]))
            elif b > a:
                with np.errstate(over="ignore"):
                    short = sum((h[a + i] * self.factors[i] for i in range(b - a)), np.uint64(0)) + np.uint64(b - a)
                out.append(mix(np.array([short], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def node_id(tokens: np.ndarray) -> int:
    """A number that equal sets share; sets of unlike size or content differ but for a chance of 2 ** -64."""
    total = np.array([mix(tokens).sum(dtype=np.uint64)], np.uint64) * np.uint64(3) + np.uint64(len(tokens))
    return int(mix(total).astype(np.int64)[0])


def groups_of(n: int) -> int:
    return min(4096, max(16, 1 << math.ceil(math.log2(max(1, n)))))


def count_vector(tokens: np.ndarray) -> bytes:
    """The counts of the groups, a byte each, deflated: most are 0 or 1, and they travel to every bucket of their node."""
    d = groups_of(len(tokens))
    counts = np.bincount((tokens & np.uint64(d - 1)).astype(np.int64), minlength=d)
    return zlib.compress(np.minimum(counts, 255).astype(np.uint8).tobytes(), 1)


def vectors(packed: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """The points of some nodes, folded to the shortest of their lengths."""
    d = min(groups_of(int(n)) for n in sizes)
    out = np.zeros((len(packed), d), np.int32)
    for i, p in enumerate(packed):
        v = np.frombuffer(zlib.decompress(p), np.uint8).astype(np.int32)
        v[v == 255] = 1 << 20  # a full counter bounds nothing
        out[i] = v.reshape(-1, d).sum(axis=0)
    return out


def least_overlap(total):
    """Smallest overlap of two linked sets of that size together."""
    return -(-PERCENT * total // (100 + PERCENT))


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


def short_prefix_length(n: int) -> int:
    """Of the smaller of two linked sets, or either of equal ones, a shared shingle is among so many first ones."""
    return n - least_overlap(2 * n) + 1


def size_class_of(n: int) -> int:
    """Linked sets are in one class or in neighbouring ones."""
    return int(math.log(n) / math.log(_CLASS_BASE))


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document rows (key, size, node, vector), and rows of (token, hits) for tokens of several documents of a task."""
    shingler, kept, held = Shingler(), [], 0
    names = ["doc_id", "key", "n", "node", "vector", "token", "hits"]

    def frequent() -> pa.RecordBatch:
        nonlocal held
        tokens, hits = np.unique(np.concatenate(kept), return_counts=True)
        tokens, hits = tokens[hits > 2], hits[hits > 2]
        kept.clear()
        held = 0
        empty = [None] * len(tokens)
        return pa.RecordBatch.from_arrays(
            [*[pa.array(empty, pa.int64())] * 4, pa.array(empty, pa.binary()), pa.array(tokens.astype(np.int64)), pa.array(hits.astype(np.int64))],
            names=names,
        )

    for batch in batches:
        ids = batch.column(0)
        for lo, hi, data, offs in slices(batch.column(1)):
            sets = shingler.sets(data, offs)
            none = [None] * (hi - lo)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array([node_id(s) for s in sets], pa.int64()),
                    pa.array([count_vector(s) for s in sets], pa.binary()), pa.array(none, pa.int64()), pa.array(none, pa.int64()),
                ],
                names=names,
            )
            kept += sets
            held += sum(len(s) for s in sets)
            if held > 3_000_000:
                yield frequent()
    if kept:
        yield frequent()


class Frequent:
    """The list of frequent shingles, and the place of each in it, 0 for the most frequent."""

    def __init__(self, most_first: np.ndarray) -> None:
        order = np.argsort(most_first, kind="stable")
        self.tokens, self.place = most_first[order], order.astype(np.int32)

    def places(self, tokens: np.ndarray) -> np.ndarray:
        """-1 for a shingle that is not in the list."""
        if not len(self.tokens):
            return np.full(len(tokens), -1, np.int32)
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        return np.where(self.tokens[at] == tokens, self.place[at], -1)

    def in_order(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of a set in the total order, and their places: those that are not in the list by value, then the others, the most frequent last."""
        place = self.places(tokens)
        early = place < 0
        late = np.flatnonzero(~early)
        order = np.concatenate((np.flatnonzero(early), late[np.argsort(-place[late])]))
        return tokens[order], place[order]


def _prefixes(batches: Iterator[pa.RecordBatch], frequent: Frequent) -> Iterator[pa.RecordBatch]:
    """Rows (token, node, kind) of the prefixes.

    A kind is (2 * size class + whether the token is in the short prefix) * 128 + salt; the rows of a frequent token are spread by salt (1 to 64).
    """
    shingler, done = Shingler(), set()
    for batch in batches:
        for _, _, data, offs in slices(batch.column(0)):
            tokens, nodes, places, kinds = [], [], [], []
            for s in shingler.sets(data, offs):
                if not len(s) or (node := node_id(s)) in done:
                    continue
                if len(done) < 500_000:  # copies met again in this task need no second set of rows
                    done.add(node)
                first, place = (x[: prefix_length(len(s))] for x in frequent.in_order(s))
                tokens.append(first)
                places.append(place)
                nodes.append(np.full(len(first), node, np.int64))
                kinds.append(2 * size_class_of(len(s)) + (np.arange(len(first)) < short_prefix_length(len(s))))
            if not tokens:
                continue
            token, node = np.concatenate(tokens), np.concatenate(nodes)
            place = np.concatenate(places)
            kind = (np.concatenate(kinds) * 128 + np.where((place >= 0) & (place < SALTED), 1 + (node & 63), 0)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(token.astype(np.int64)), pa.array(node), pa.array(kind)], names=["token", "node", "kind"])


def with_possible_link(token: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Of distinct nodes in order of (token, kind): those that may be linked to another node of their token.

    The smaller of the two has the token in its short prefix, and the other is of its size class or the next. Rows of frequent tokens are all kept.
    """
    cls, short = kind >> 8, (kind >> 7 & 1).astype(bool)
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])
    first = np.flatnonzero(new)
    if not len(first):
        return new
    rows, shorts = np.diff(np.append(first, len(token))), np.add.reduceat(short.astype(np.int64), first)
    follows = (token[first[1:]] == token[first[:-1]]) & (cls[first[1:]] == cls[first[:-1]] + 1)
    above, below = np.zeros(len(first), bool), np.zeros(len(first), bool)
    above[:-1] = follows
    below[1:] = follows & (shorts[:-1] > 0)
    at = np.cumsum(new) - 1
    as_smaller = short & ((rows[at] > 1) | above[at])
    as_larger = (shorts[at] - short > 0) | below[at]
    return as_smaller | as_larger | (kind & 127 > 0)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of (token, kind, node): the distinct ones that may be linked to another node of their token."""
    rest: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def chosen(token: np.ndarray, node: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
        token, node, kind = token[new], node[new], kind[new]
        some = with_possible_link(token, kind)
        return pa.RecordBatch.from_arrays([pa.array(token[some]), pa.array(node[some])], names=["token", "node"])

    for batch in batches:
        cols = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if rest is not None:
            cols = tuple(np.concatenate(x) for x in zip(rest, cols, strict=True))
        if not len(cols[0]):
            continue
        cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last token may go on in the next batch
        yield chosen(*(c[:cut] for c in cols))
        rest = tuple(c[cut:] for c in cols)
    if rest is not None:
        yield chosen(*rest)


def _find(parent: dict[int, int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def close_pairs(points: np.ndarray, sizes: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j) of unlike ``groups`` whose overlap bound suffices, with the bound, from a packed R-tree.

    Leaves hold ``LEAF`` points neighbouring in (size, group); a pair of leaves is opened only if the summed
    minima of the upper corners of their boxes reach the least overlap of their smallest sizes.
    """
    fine, points = points, points.reshape(len(points), -1, 4).sum(axis=2)
    order = np.lexsort((groups, sizes))
    firsts = np.arange(0, len(order), LEAF)
    top = np.maximum.reduceat(points[order], firsts, axis=0)
    low = np.minimum.reduceat(sizes[order], firsts)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a in range(len(firsts)):
        box = np.minimum(top[a], top[a:]).sum(axis=1) >= least_overlap(low[a] + low[a:])
        mine = order[firsts[a] : firsts[a] + LEAF]
        for b in (a + np.flatnonzero(box)).tolist():
            other = order[firsts[b] : firsts[b] + LEAF]
            bound = np.minimum(points[mine][:, None, :], points[other][None, :, :]).sum(axis=2)
            good = (bound >= least_overlap(sizes[mine][:, None] + sizes[other][None, :])) & (groups[mine][:, None] != groups[other][None, :])
            if a == b:
                good &= np.arange(len(mine))[:, None] < np.arange(len(other))[None, :]
            i, j = np.nonzero(good)
            i, j = mine[i], other[j]
            bound = np.minimum(fine[i], fine[j]).sum(axis=1)
            close = bound >= least_overlap(sizes[i] + sizes[j])
            if close.any():
                found.append((i[close], j[close], bound[close]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _met(rows: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Pairs that this block is for: not two guests of the next class, and of unlike blocks where two blocks meet."""
    return ~(rows["guest"][i] & rows["guest"][j]) & ((rows["side"][i] != rows["side"][j]) | (rows["side"][i] == 2))


def _bounded_pairs(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = rows["n"]
    i, j, bound = close_pairs(vectors(rows["vector"].tolist(), n), n, rows["comp"])
    keep = _met(rows, i, j)
    i, j, bound = i[keep], j[keep], bound[keep]
    return i, j, bound / np.maximum(1, n[i] + n[j] - bound)


def _forest(rows: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, likeness: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of some pairs those that join components first, the most alike in front."""
    parent = {c: c for c in rows["comp"].tolist()}
    kept = []
    for k in np.argsort(-likeness, kind="stable").tolist():
        x, y = _find(parent, int(rows["comp"][i[k]])), _find(parent, int(rows["comp"][j[k]]))
        if x != y:
            parent[x] = y
            kept.append(k)
    return i[kept], j[kept]


def _pairs_of(rows: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    a, b = rows["node"][i].astype(np.int64), rows["node"][j].astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of some sets, by products of incidence matrices."""
    tokens, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    often = np.bincount(column, minlength=len(tokens)) > 1
    column, row = (np.cumsum(often) - 1)[column[often[column]]], row[often[column]]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for first in range(0, int(often.sum()), 2048):
        lo, hi = np.searchsorted(column, (first, first + 2048))
        part = np.zeros((len(sets), 2048), np.float32)
        part[row[lo:hi], column[lo:hi] - first] = 1
        out += part @ part.T
    return out


def _linked_pairs(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links between components of a block: of the pairs that pass the bound, compared on whole sets.

    Few pairs are compared one by one, and not at all once links found before join their components; where
    most rows are alike the products of ``overlaps`` are cheaper. Both ways find the same components.
    """
    shingler, sets = Shingler(), []
    for _, _, data, offs in slices(pa.array(rows["text"].tolist(), pa.large_string())):
        sets += shingler.sets(data, offs)
    rows = {**rows, "vector": np.array([*(count_vector(x) for x in sets), None], object)[:-1]}
    i, j, alike = _bounded_pairs(rows)
    n = rows["n"]
    if len(i) * 3e-5 > len(sets) ** 2 * n.sum() * 5e-11:
        both = overlaps(sets)[i, j]
        good = (100 * both >= PERCENT * (n[i] + n[j] - both)).nonzero()[0]
        return i[good], j[good], both[good] / np.maximum(1, n[i] + n[j] - both)[good]
    parent = {c: c for c in rows["comp"].tolist()}
    found = []
    for k in np.argsort(-alike, kind="stable").tolist():
        x, y = _find(parent, int(rows["comp"][i[k]])), _find(parent, int(rows["comp"][j[k]]))
        if x == y:
            continue
        a, b = sets[i[k]], sets[j[k]]
        if len(a) > len(b):
            a, b = b, a
        both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
        if 100 * both >= PERCENT * (len(a) + len(b) - both):
            parent[x] = y
            found.append(k)
    return i[found], j[found], alike[found]


def _candidate_forest(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
    i, j, likeness = _bounded_pairs(rows)
    return _pairs_of(rows, *_forest(rows, i, j, likeness))


def _with_partner(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
    """The rows of a block that have a partner by the bound."""
    i, j, _ = _bounded_pairs(rows)
    some = np.union1d(i, j).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(rows[c][some], k) for c, k in zip(_BLOCK_COLUMNS, _BLOCK_TYPES, strict=True)], names=list(_BLOCK_COLUMNS))


def _link_forest(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
    i, j, likeness = _linked_pairs(rows)
    return _pairs_of(rows, *_forest(rows, i, j, likeness))


_BLOCK_KEY = ["token", "size_class", "first", "second"]
_BLOCK_COLUMNS = (*_BLOCK_KEY, "node", "n", "comp", "side", "guest")
_BLOCK_TYPES = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_())
_BLOCK_SCHEMA = "token long, size_class int, first int, second int, node long, n long, comp long, side int, guest boolean"


def _by_block(batches: Iterator[pa.RecordBatch], content: str, work) -> Iterator[pa.RecordBatch]:
    """``work`` on every block that has several components, of rows in order of the blocks; holds a block at a time."""
    rest: dict[str, np.ndarray] | None = None

    def done(rows: dict[str, np.ndarray], upto: int) -> Iterator[pa.RecordBatch]:
        change = np.zeros(max(0, upto - 1), bool)
        for c in _BLOCK_KEY:
            change |= rows[c][1:upto] != rows[c][: max(0, upto - 1)]
        edges = np.concatenate(([0], np.flatnonzero(change) + 1, [upto])) if upto else np.zeros(1, int)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b - a > 1 and (rows["comp"][a:b] != rows["comp"][a]).any():
                out = work({c: v[a:b] for c, v in rows.items()})
                if out.num_rows:
                    yield out

    for batch in batches:
        rows = {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(_BLOCK_COLUMNS)}
        rows[content] = np.array([*batch.column(len(_BLOCK_COLUMNS)).to_pylist(), None], object)[:-1]
        if rest is not None:
            rows = {c: np.concatenate((rest[c], rows[c])) for c in rows}
        if not len(rows["token"]):
            continue
        last = np.ones(len(rows["token"]), bool)
        for c in _BLOCK_KEY:
            last &= rows[c] == rows[c][-1]
        cut = int(np.flatnonzero(last)[0])
        yield from done(rows, cut)
        rest = {c: v[cut:] for c, v in rows.items()}
    if rest is not None:
        yield from done(rest, len(rest["token"]))


def _blocks(buckets: DataFrame) -> DataFrame:
    """Bucket rows (token, node, n, comp) placed in the blocks of their classes of like size."""
    size_class = F.floor(F.log(F.col("n").cast("double")) / math.log(_CLASS_BASE)).cast("int")
    cells = buckets.withColumn("own", size_class)
    cells = cells.withColumn("size_class", F.explode(F.array(F.col("own"), F.col("own") - 1))).withColumn("guest", F.col("own") != F.col("size_class")).drop("own")
    cell = ["token", "size_class"]
    counts = cells.groupBy(*cell).agg(
        F.sum("n").alias("shingles"), F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.min("guest").alias("only_guests")
    ).where("c1 <> c2 and not only_guests").select(*cell, F.ceil(F.col("shingles") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    placed = cells.join(counts, cell).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    partner = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("partner")
    return placed.select(*cell, "node", "n", "comp", "guest", "block", partner).select(
        *cell, F.least("block", "partner").alias("first"), F.greatest("block", "partner").alias("second"), "node", "n", "comp",
        # 2: the pair is a block with itself, else which of the two blocks the row comes from
        F.when(F.col("block") == F.col("partner"), 2).otherwise((F.col("block") > F.col("partner")).cast("int")).alias("side"), "guest",
    )


def _in_blocks(blocks: DataFrame, side: DataFrame, content: str, work, schema: str) -> DataFrame:
    """``work`` on blocks whose rows have got their nodes' ``content``."""
    full = blocks.join(side.select("node", content), "node").select(*_BLOCK_COLUMNS, content)
    ordered = full.repartition(shuffle_width(blocks.sparkSession), *_BLOCK_KEY).sortWithinPartitions(*_BLOCK_KEY)
    return ordered.mapInArrow(lambda b: _by_block(b, content, work), schema)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, text of a, text of b) to the links among them."""
    shingler = Shingler()
    for batch in batches:
        a, b = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        good = np.zeros(len(a), bool)
        for lo, hi, data, offs in slices(batch.column(2)):
            left = shingler.sets(data, offs)
            for lo2, _, data2, offs2 in slices(batch.column(3).slice(lo, hi - lo)):
                for k, y in enumerate(shingler.sets(data2, offs2)):
                    x, row = left[lo2 + k], lo + lo2 + k
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good[row] = 100 * both >= PERCENT * (len(x) + len(y) - both)
        yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], names=["a", "b"])


def _marked(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def _texts_of_marked(batches: Iterator[pa.RecordBatch], bits: np.ndarray, shift: int) -> Iterator[pa.RecordBatch]:
    """Of rows (doc_id, place, text) whose place, or node for a null id, is marked: (node, text), one per node that the task has met, as long as it can remember them."""
    shingler, done = Shingler(), set()
    for batch in batches:
        lone = batch.column(0).is_null().to_numpy(zero_copy_only=False)
        some = np.flatnonzero(lone | _marked(bits, batch.column(1).to_numpy(zero_copy_only=False)))
        texts, lone = batch.column(2).take(pa.array(some)), lone[some]
        for lo, hi, data, offs in slices(texts):
            nodes = np.array([node_id(s) for s in shingler.sets(data, offs)], np.int64)
            good = ~lone[lo:hi] | _marked(bits, (nodes.view(np.uint64) >> np.uint64(shift)).astype(np.int64))
            for k, node in enumerate(nodes.tolist()):
                good[k] &= node not in done
                if good[k] and len(done) < 500_000:
                    done.add(node)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[good]), texts.slice(lo, hi - lo).filter(pa.array(good))], names=["node", "text"])


def _texts(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (node, text) of the nodes in ``wanted``, one each.

    Documents pass a bit filter of fixed size over the nodes' doc_ids (their sets where all rows of a node have a null id) before they are
    shuffled; the join drops its false hits, and other texts of a doc_id. One Python step a task: each step of a chain has a worker of its own.
    """
    shift = 64 - (FILTER_BITS - 1).bit_length()
    chosen = pin(nodes.select("node", "doc_id").join(wanted.select("node").distinct(), "node", "left_semi"))
    hashed = F.shiftrightunsigned(F.xxhash64("doc_id"), shift)
    places = chosen.select((F.when(F.col("doc_id").isNotNull(), hashed).otherwise(F.shiftrightunsigned("node", shift)) + 1).alias("place"))  # Spark's bitmaps count from 1
    parts = places.groupBy(F.bitmap_bucket_number("place").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in parts.collect():  # FILTER_BITS / 8 bytes at most
        bits[4096 * (r["part"] - 1) : 4096 * r["part"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    found = docs.select("doc_id", hashed.alias("place"), "text").mapInArrow(lambda b: _texts_of_marked(b, shared.value, shift), "node long, text string")
    return found.join(chosen.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    left, right = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    full = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return full.mapInArrow(_verified, "a long, b long").distinct()


def row_key(text: Column) -> Column:
    """With the doc_id, what tells rows apart; rows that share both are equal as far as links go."""
    return F.xxhash64(text.cast("string"))


def link(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, ``n_shingles`` and ``component_id``.

    ``component_id`` is the smallest doc_id reachable by links, the row's own included. A row without words
    (null, empty or white text) has no shingles and is a component by itself; rows that share a doc_id are
    separate rows; null ids are never the smallest. An empty table gives an empty table.
    """
    return _linked(docs).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """Exactly one row of each component, all rows without words, with the columns of ``docs``.

    The row with the smallest (doc_id, hash of the text) stays, null ids last, so which rows share a doc_id does not matter.
    """
    rows = pin(_linked(docs).where("n > 0").select("doc_id", "key", "first"))
    gone = rows.groupBy("doc_id", "key").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("rows")).where("not first or rows > 1")
    gone = pin(gone.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), F.col("first").alias("__first")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (row_key(F.col("text")) == F.col("__key"))
    # Of equal rows that stand for their component one stays.
    equal = docs.join(gone.where("__first"), same).dropDuplicates(["__id", "__key"])
    return docs.join(gone, same, "left_anti").unionByName(equal.select(*docs.columns))


def _linked(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, key, n, component_id, and whether the row is the ``first`` of its component."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_key(F.col("text")).alias("key"))
    described = pin(docs.mapInArrow(_described, "doc_id long, key long, n long, node long, vector binary, token long, hits long"))
    rows = described.where("n is not null").select("doc_id", "key", "n", "node", "vector")
    hits = described.where("token is not null").groupBy("token").agg(F.sum("hits").alias("hits"))
    top = hits.orderBy(F.desc("hits"), "token").limit(FREQUENT).select("token").toPandas()["token"]
    shared_list = spark.sparkContext.broadcast(Frequent(top.to_numpy(np.int64).astype(np.uint64)))
    prefixes = docs.select("text").mapInArrow(lambda b: _prefixes(b, shared_list.value), "token long, node long, kind int")
    ordered = prefixes.repartition(shuffle_width(spark), "token", F.col("kind").bitwiseAND(127)).sortWithinPartitions("token", "kind", "node")
    shared = pin(ordered.mapInArrow(_shared, "token long, node long"))

    nodes = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("vector").alias("vector"))
    nodes = pin(nodes.join(shared.select("node").distinct(), "node", "left_semi"))

    candidates = pin(_in_blocks(_blocks(_few_tokens(shared, nodes)), nodes, "vector", _candidate_forest, "a long, b long").distinct())
    compared = candidates.select(F.explode(F.array("a", "b")).alias("node"))
    edges = pin(_links(candidates, pin(_texts(docs, nodes, compared))))
    open_ = _blocks(pin(_open_buckets(shared, nodes, components(edges))))
    alike = pin(_in_blocks(open_, nodes, "vector", _with_partner, _BLOCK_SCHEMA))
    edges = edges.unionByName(_in_blocks(alike, _texts(docs, nodes, alike), "text", _link_forest, "a long, b long"))
    roots = components(edges).withColumnRenamed("root", "found")
    order = F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "key")
    member = rows.groupBy("node").agg(F.min(order).alias("least")).join(roots, "node", "left").withColumn("root", F.coalesce("found", "node"))
    smallest = member.groupBy("root").agg(F.min("least").alias("least"))
    label = member.drop("least").join(smallest, "root").select("node", "least")
    filled = rows.where("n > 0").select("doc_id", "key", "n", "node").join(label, "node")
    filled = filled.select("doc_id", "key", "n", F.col("least.doc_id").alias("component_id"), (order == F.col("least")).alias("first"))
    return filled.unionByName(rows.where("n = 0").select("doc_id", "key", "n", F.col("doc_id").alias("component_id"), F.lit(True).alias("first")))


def _few_tokens(shared: DataFrame, nodes: DataFrame) -> DataFrame:
    """Bucket rows of each node's first shared tokens; every node is still its own component."""
    first = shared.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy("token"))).where(F.col("rank") <= FIRST_TOKENS)
    return first.join(nodes.select("node", "n"), "node").select("token", "node", "n", F.col("node").alias("comp"))


def _open_buckets(shared: DataFrame, nodes: DataFrame, comps: DataFrame) -> DataFrame:
    """Bucket rows of all tokens whose nodes are in several components, one token of those with the same nodes."""
    known = nodes.select("node", "n").join(comps, "node", "left").select("node", "n", F.coalesce("root", "node").alias("comp"))
    rows = shared.join(known, "node")
    alike = F.struct(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("xor"))
    tokens = rows.groupBy("token").agg(alike.alias("alike"), F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 <> c2")
    chosen = tokens.groupBy("alike").agg(F.min("token").alias("token")).select("token")
    return rows.join(chosen, "token").select("token", "node", "n", "comp")
