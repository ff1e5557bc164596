"""Toxic passages by maximum-scoring segments.

* Tokens: a word and its first 4, 5 and 6 bytes, so that all endings of a stem count together; the
  strongest of them weighs.
* Weights: the log-odds of a token between toxic and other documents under a Dirichlet prior that is
  spread as the words of all training documents; ``STRENGTH`` is its size beside the data. Only
  tokens whose log-odds are at least ``Z`` standard errors above zero weigh; a word without one costs ``DRIFT``.
* Passages: all maximal scoring segments of a text's words (Ruzzo and Tompa), found in one pass.
* Calibration: for words drawn as in clean documents, the best segment of n words exceeds s with
  expectation K n exp(-lambda s). A document's passages count together by the sum statistic of their
  normalised scores, and a logistic curve fitted on training rows that gave no weights turns that
  evidence into a probability.

The training rows are a bounded sample of the labels (``TRAIN_ROWS``, drawn by hash); every document
is scored, whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.text_bytes import NOT_LETTER, Hasher, Table, lower, mix, slices, words

TRAIN_ROWS = 60_000
STRENGTH = 0.1
Z = 3.5
DRIFT = 0.1
REJECT = 0.7
STEMS = (4, 5, 6)
SEGMENTS = "array<struct<start:int,end:int,score:double,log_e:double>>"
ADDED = ("score", "predicted", "segments")


def token_hashes(hasher: Hasher, small: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Hashes of the words, and for each length in ``STEMS`` of their beginnings (the word's own where it is no longer)."""
    out = [hasher.ranges(small, starts, ends)]
    for n in STEMS:
        longer = ends - starts > n
        stem = mix(hasher.ranges(small, starts, np.minimum(starts + n, ends)) + np.uint64(n))
        out.append(np.where(longer, stem, out[0]))
    return out


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring runs (first, after the last, sum) of a list of scores, in linear time.

    Each candidate keeps the place of the last one before it with a smaller sum before; only these links are followed,
    and the candidates a link skips are not looked at again.
    """
    found: list[tuple[int, int, float, float, int]] = []  # first, end, sum before, sum after, link
    total = 0.0
    for i, s in enumerate(scores):
        if s <= 0:
            total += s
            continue
        first, end, before, after = i, i + 1, total, total + s
        total = after
        link = len(found) - 1
        while link >= 0 and found[link][2] >= before:
            link = found[link][4]
        while link >= 0 and found[link][3] < after:
            place = link
            first, _, before, _, link = found[place]
            del found[place:]
        found.append((first, end, before, after, link))
    return [(int(a), int(b), after - before) for a, b, before, after, _ in found]


@dataclass
class Model:
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    rate: float = 1.0  # lambda
    log_k: float = 0.0
    intercept: float = -3.0
    slope: float = 0.0

    def __post_init__(self) -> None:
        self.table, self.hasher = Table(self.keys), Hasher()

    def evidence(self, n_words: int, places: list[int], weights: list[float]) -> tuple[float, list[tuple[int, int, float, float]]]:
        """Evidence of one text and its passages (first word, word after the last, score, log of the expectation)."""
        items: list[float] = []
        spans: list[tuple[int, int]] = []
        last = -1
        for p, w in zip(places, weights, strict=True):
            if last >= 0 and p > last + 1:
                items.append(-DRIFT * (p - last - 1))
                spans.append((last + 1, p))
            items.append(w)
            spans.append((p, p + 1))
            last = p
        chance = self.log_k + math.log(max(1, n_words))
        out = [(spans[a][0], spans[b - 1][1], s, chance - self.rate * s) for a, b, s in maximal_segments(items)]
        best, total = 0.0, 0.0
        for r, e in enumerate(sorted(x[3] for x in out), 1):
            total -= e
            if total <= 0:
                break
            # P of r such segments: exp(-T) T^(r-1) / (r! (r-1)!)
            best = max(best, total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r))
        return best, out

    def texts(self, data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, float, list[tuple[int, int, float, float]]]]:
        """Evidence and passages, in bytes of the text, of each text of a slice that has any; and its number of words."""
        starts, ends, at = words(data, offs, NOT_LETTER)
        weight = np.zeros(len(starts))
        if len(self.keys):
            known = np.append(self.weights, 0.0)  # row -1 weighs nothing
            for h in token_hashes(self.hasher, lower(data), starts, ends):
                weight = np.maximum(weight, known[self.table.find(h)])
        hits = np.flatnonzero(weight > 0)
        doc = np.searchsorted(at, hits, "right") - 1
        bounds = np.searchsorted(doc, np.arange(len(offs)))
        for i in range(len(offs) - 1):
            mine = hits[bounds[i] : bounds[i + 1]]
            n = int(at[i + 1] - at[i])
            if not len(mine):
                yield n, 0.0, []
                continue
            x, found = self.evidence(n, (mine - at[i]).tolist(), weight[mine].tolist())
            yield n, x, [(int(starts[at[i] + a] - offs[i]), int(ends[at[i] + b - 1] - offs[i]), s, e) for a, b, s, e in found]

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.intercept + self.slope * evidence))))


def held_out(docs: DataFrame):
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class that hold a token."""
    hasher = Hasher()
    for batch in batches:
        toxic = np.array(batch.column(0).to_pylist(), bool)
        for lo, hi, data, offs in slices(batch.column(1)):
            starts, ends, at = words(data, offs, NOT_LETTER)
            h = np.concatenate(token_hashes(hasher, lower(data), starts, ends))
            doc = np.tile(np.repeat(np.arange(hi - lo), np.diff(at)), 1 + len(STEMS))
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            keys, row = np.unique(h[new], return_inverse=True)
            bad = np.bincount(row, toxic[lo:hi][doc[new]], len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(bad), pa.array(np.bincount(row, minlength=len(keys)) - bad)], names=["word", "toxic", "clean"])


def _weights(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Keys and weights of the significant words, and the share of clean words that are such words."""
    sums = counts.agg(F.sum("toxic").cast("double").alias("t"), F.sum("clean").cast("double").alias("c")).first()
    t, c = (sums["t"] or 0.0), (sums["c"] or 0.0)
    if not t or not c:
        return np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), 0.0
    prior = STRENGTH * (F.col("toxic") + F.col("clean"))
    a0 = STRENGTH * (t + c)
    a, b = F.col("toxic") + prior, F.col("clean") + prior
    delta = F.log(a / (F.lit(t + a0) - a)) - F.log(b / (F.lit(c + a0) - b))
    # No more words can pass than the sample has words seen often enough, so the list is bounded by the sample.
    passed = counts.select("word", "clean", delta.alias("delta"), (delta / F.sqrt(1 / a + 1 / b)).alias("z")).where(F.col("z") >= Z).toPandas()
    chance = (passed["clean"].to_numpy(float) + 0.5) / (c + 1)
    return passed["word"].to_numpy(np.int64).astype(np.uint64), passed["delta"].to_numpy(float), chance, c


def _rate(weights: np.ndarray, chance: np.ndarray) -> float:
    """The positive root of E exp(lambda s) = 1 for words drawn as in clean documents."""
    if not len(weights) or float((weights * chance).sum()) >= DRIFT * (1 - chance.sum()):
        return 0.05
    low, high = 1e-6, 1.0

    def excess(x: float) -> float:
        return float((chance * np.exp(x * weights)).sum() + (1 - chance.sum()) * math.exp(-x * DRIFT)) - 1

    while excess(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return low


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by penalised Newton steps; the slope is not negative."""
    scale = max(1.0, float(np.percentile(x, 99)))
    z = np.column_stack((np.ones(len(x)), np.minimum(x / scale, 10)))
    y = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        hessian = (z * (p * (1 - p))[:, None]).T @ z + np.diag([1e-4, 1e-3])
        beta = beta + np.linalg.solve(hessian, z.T @ (y - p) - np.array([1e-4, 1e-3]) * beta)
    return float(beta[0]), float(max(beta[1], 0.0) / scale)


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Learn from labelled rows outside the held-out part.

    A document with several labels is toxic when one of them says so; rows with a null id, label or text
    are not used. With fewer than two classes every text gets the same low probability.
    """
    rows = labels.where(~held_out(labels) & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    total = rows.count()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    # The list of drawn rows is bounded by ``train_rows`` and may be broadcast; beyond that bound the lowest hashes stay, not any rows.
    drawn = rows.where(draw < min(1.0, 1.05 * train_rows / max(1, total)) * 1_000_000).orderBy(F.xxhash64("doc_id", F.lit(2)), "doc_id").limit(train_rows)
    sample = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(drawn), "doc_id")
    calibrates = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 0
    counts = sample.where(~calibrates).select("toxic", "text").mapInArrow(_counted, "word long, toxic long, clean long")
    counts = counts.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    keys, weights, chance, _ = _weights(counts)
    if not len(keys):
        return Model()
    rate = _rate(weights, chance)
    raw = Model(keys, weights, rate)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for _, _, data, offs in slices(batch.column(1)) for x in raw.texts(data, offs)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _, _ in found], pa.int64()), pa.array([max([s for *_, s, _ in f], default=0.0) for _, _, f in found], pa.float64()), pa.array([[s for *_, s, _ in f] for _, _, f in found], pa.list_(pa.float64()))],
                names=["toxic", "n", "best", "scores"],
            )

    # One small row for each calibrating document of the bounded sample.
    seen = sample.where(calibrates).select("toxic", "text").mapInArrow(scored, "toxic boolean, n long, best double, scores array<double>").toPandas()
    if not len(seen) or seen["toxic"].nunique() < 2:
        return raw
    clean = seen[~seen["toxic"].astype(bool)]
    least = float(weights.min())
    log_k = math.log((0.5 + float((clean["best"] > 0).sum())) / (1 + float(clean["n"].sum()) * math.exp(-rate * least)))
    model = Model(keys, weights, rate, log_k)
    x = np.array([_evidence(model, n, s) for n, s in zip(seen["n"], seen["scores"], strict=True)])
    model.intercept, model.slope = _logistic(x, seen["toxic"].to_numpy(bool))
    return model


def _evidence(model: Model, n: int, scores) -> float:
    """Evidence from the scores of passages alone: far apart, so that none joins another."""
    gap = int(max(scores, default=0.0) / DRIFT) + 2
    return model.evidence(int(n), [i * gap for i in range(len(scores))], list(scores))[0]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (0 to 1), ``predicted`` (1 from ``REJECT`` on) and ``segments``.

    ``segments`` holds the toxic passages: code points from ``start`` to before ``end``, their score and
    the natural log of how often clean text of that length has such a passage. Null and empty texts have
    none and the lowest score. Repeated rows are scored alike, an empty table gives an empty one. Columns of these
    names are replaced; nothing is shuffled.
    """
    names = [c for c in docs.columns if c not in ADDED]
    place = names.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            probabilities, segments = [], []
            for _, _, data, offs in slices(batch.column(place)):
                for i, (_, x, found) in enumerate(known.texts(data, offs)):
                    probabilities.append(known.probability(x))
                    segments.append(_code_points(data[offs[i] : offs[i + 1]], found))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("log_e", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(probabilities, pa.float64()), pa.array([int(p >= REJECT) for p in probabilities], pa.int32()), pa.array(segments, kind)],
                names=[*batch.schema.names, *ADDED],
            )

    kept = docs.select(*[f"`{c}`" for c in names])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(scored, f"{schema}, score double, predicted int, segments {SEGMENTS}")


def _code_points(text: np.ndarray, found: list[tuple[int, int, float, float]]) -> list[dict]:
    if not found:
        return []
    upto = np.concatenate(([0], np.cumsum((text & 0xC0) != 0x80)))
    return [{"start": int(upto[a]), "end": int(upto[b]), "score": s, "log_e": e} for a, b, s, e in found]
