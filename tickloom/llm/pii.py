"""Personal data and the words that give it away, in DataFrame operations only.

Base spans come from patterns and checks (e-mail, IP address, card, phone). On top, words are weighed by what
they tell about a document: over all documents it is counted how often a word stands in one with an entity of a
kind. A word tells log2(P(kind | word) / P(kind)) bits; knowing the entity itself would tell -log2 P(kind). Words
that tell at least ``GENERALISE`` of that are generalised to the kind's name where such an entity stands, words
that tell at least ``REMOVE`` are removed. P(kind | word) is smoothed by ``PRIOR`` documents that behave as all
documents do, so that rare words reach no threshold by chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.session import pin

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
GENERALISE = 0.6
REMOVE = 0.8
PRIOR = 20.0

# Each pattern finds the leftmost matches of the kind's definition. Loops are possessive where what follows cannot
# start inside them, and a run is entered only at its start or where the last match ended, so that time stays
# linear in the text.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A text without this cannot hold the kind.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_OCTET = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)"
_WORD = r"[^\p{L}]+"
_SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = 2 * d
        return total + F.when((n - i) % 2 == 1, F.floor(twice / 10).cast("int") + twice % 10).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike("^" + r"\.".join([_OCTET] * 4) + "$")
    if kind == "card":
        digits = _digits(value)
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def positions(text: Column, pattern: Column, kind: str) -> Column:
    """Valid matches of ``pattern`` with their code points: a text is the parts between matches and the matches in turn.

    Only valid matches are gathered: a list that grows by every number of a long text would be copied each time.
    """
    # One part more than matches: the last step has no value and adds nothing.
    steps = F.zip_with(
        F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)), lambda gap, v: F.struct(F.length(gap).alias("gap"), v.alias("value"))
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc: Column, s: Column) -> Column:
        begin = acc["at"] + s["gap"]
        end = begin + F.length(s["value"])
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), s["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(s["value"].isNotNull() & valid(kind, s["value"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(steps, start, step, lambda acc: acc["out"])


def _may_hold(text: Column, kind: str) -> Column:
    return text.contains(NEEDS[kind]) if NEEDS[kind] else text.rlike("[0-9][ -]?[0-9]")


def base_spans(text: Column, kind: str) -> Column:
    """Spans (kind, start, end, value) of one kind, ascending; ``end`` is exclusive."""
    return F.when(_may_hold(text, kind), positions(text, F.lit(PATTERNS[kind]), kind)).otherwise(F.array().cast(_SPAN))


def holds(text: Column, kind: str) -> Column:
    """Whether a text has a base span of the kind."""
    found = F.exists(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), lambda v: valid(kind, v))
    return F.when(_may_hold(text, kind), found).otherwise(False)


def _terms(text: Column) -> Column:
    """Distinct lower-case words of at least three letters outside the base patterns."""
    plain = F.regexp_replace(text, F.lit("|".join(PATTERNS[k] for k in KINDS)), F.lit(" "))
    return F.filter(F.array_distinct(F.split(F.lower(plain), _WORD)), lambda w: F.length(w) >= 3)


def disclosing_terms(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, prior: float = PRIOR) -> DataFrame:
    """(term, kind, bits, action) of the words over a threshold, counted over all documents."""
    text = F.coalesce(F.col("text"), F.lit(""))
    flags = docs.select(text.alias("text")).select("text", *[holds(F.col("text"), k).cast("long").alias(k) for k in KINDS])
    terms = flags.select(*KINDS, F.explode(_terms(F.col("text"))).alias("term"))
    counts = terms.groupBy("term").agg(F.count(F.lit(1)).alias("n"), *[F.sum(k).alias(k) for k in KINDS])
    whole = flags.agg(F.count(F.lit(1)).alias("n"), *[F.sum(k).alias(k) for k in KINDS]).first()
    rows = []
    for k in KINDS:
        if not whole[k] or whole[k] == whole["n"]:
            continue  # a kind that is nowhere or everywhere is told by no word
        p = whole[k] / whole["n"]
        bits = F.log2((F.col(k) + F.lit(prior * p)) / (F.col("n") + F.lit(prior)) / F.lit(p))
        share = bits / (-F.log2(F.lit(p)))
        rows.append(F.struct(F.lit(k).alias("kind"), bits.alias("bits"), F.when(share >= remove, "remove").when(share >= generalise, "generalise").alias("action")))
    if not rows:
        return counts.select("term", F.lit("").alias("kind"), F.lit(0.0).alias("bits"), F.lit("").alias("action")).where(F.lit(False))
    return counts.select("term", F.explode(F.array(*rows)).alias("t")).where("t.action is not null").select("term", "t.*")


def find(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, prior: float = PRIOR) -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, ``base`` and ``added`` spans, ``redacted``.

    ``base`` is ordered by kind as in ``KINDS``, then start; ``added`` holds the occurrences of disclosing words in
    documents with an entity of the kind they tell, ordered by start; its ``kind`` is ``term`` and its ``value``
    the replacement: the kind's name for a generalised word, empty for a removed one. ``redacted`` is the text with
    all spans replaced, null where there are none and the text may stay. A null text is empty and has no spans.
    Other columns are ignored; repeated rows are rows of their own.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    spans = docs.select("doc_id", text.alias("text")).select("doc_id", "text", *[base_spans(F.col("text"), k).alias(f"_{k}") for k in KINDS])
    sizes = [F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    base = spans.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text", *sizes, F.concat(*[f"_{k}" for k in KINDS]).alias("base"))
    # Row numbers must be the same for all readers; of texts only those with an entity are kept.
    base = pin(base.withColumn("text", F.when(F.size("base") > 0, F.col("text"))))
    terms = pin(disclosing_terms(docs, generalise, remove, prior))
    present = base.where(F.size("base") > 0).select("_row", *[f"n_{k}" for k in KINDS], F.explode(_terms(F.col("text"))).alias("term"))
    here = F.array(*[F.when(F.col(f"n_{k}") > 0, k) for k in KINDS])
    hits = present.join(terms, "term").where(F.array_contains(here, F.col("kind"))).groupBy("_row", "term").agg(F.max_by(F.struct("action", "kind"), F.struct(F.col("action") == "remove", "bits", "kind")).alias("best"))
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})"), F.col("term"), F.lit(r"(?!\p{L})"))
    placed = hits.join(base.select("_row", "text", "base"), "_row").select("_row", "best", F.explode(positions(F.col("text"), pattern, TERM)).alias("s"), "base")
    outside = ~F.exists("base", lambda b: (b["start"] < F.col("s.end")) & (F.col("s.start") < b["end"]))
    new = F.when(F.col("best.action") == "remove", "").otherwise(F.concat(F.lit("["), F.col("best.kind"), F.lit("]")))
    added = placed.where(outside).groupBy("_row").agg(F.array_sort(F.collect_list(F.struct(F.col("s.start").alias("start"), F.col("s.end").alias("end"), new.alias("value")))).alias("a"))
    added = added.select("_row", F.transform("a", lambda x: F.struct(F.lit(TERM).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"))).alias("added"))
    none = F.array().cast(_SPAN)
    full = base.join(added, "_row", "left").withColumn("added", F.coalesce("added", none))
    return full.select("doc_id", *[f"n_{k}" for k in KINDS], "base", "added", sanitised(F.col("text"), F.col("base"), F.col("added")).alias("redacted"))


def as_text(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def sanitised(text: Column, base: Column, added: Column) -> Column:
    """The text with base spans replaced by their kind in brackets and added spans by their replacement.

    Spans are applied from the last to the first; one that reaches into a span applied before is passed over.
    """
    labelled = F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), s["kind"], F.lit("]")).alias("new")))
    rest = F.transform(added, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("new")))
    ordered = F.reverse(F.array_sort(F.concat(labelled, rest)))
    start = F.struct(text.alias("text"), (F.length(text) + 1).alias("limit"))

    def step(acc: Column, s: Column) -> Column:
        cut = F.concat(F.substring(acc["text"], F.lit(1), s["start"]), s["new"], F.substring(acc["text"], s["end"] + 1, F.length(acc["text"])))
        return F.when(s["end"] <= acc["limit"], F.struct(cut.alias("text"), s["start"].alias("limit"))).otherwise(acc)

    return F.aggregate(ordered, start, step, lambda acc: acc["text"])
