"""Text imports with explicit column mapping, and a quarantine beside the good rows."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.columns import codes, finite, normal_price_base, parse_instant
from tickloom.operators.bars import bar_gaps
from tickloom.operators.dedupe import first_wins, out_of_order
from tickloom.operators.scan import union_all

_NUMBERS = {"price", "quantity", "bid", "ask", "open", "high", "low", "close", "volume"}
_COUNTS = {"event_count", "seq", "revision"}
_TIMES = {"event_time", "available_at", "received_at", "start", "end"}


@dataclass(frozen=True)
class ImportPolicy:
    """How a file is read.

    ``mapping`` goes from our column to the file's; ``defaults`` fills columns the file
    does not have. ``sequence`` names the column that tells the file's own order. Disorder
    is a warning when ``reorder`` is set and an error otherwise; copies are dropped with a
    warning when ``drop_duplicates`` is set, else kept with an error. ``strict`` refuses a
    file with any error.
    """

    mapping: Mapping[str, str]
    defaults: Mapping[str, object] = field(default_factory=dict)
    required: tuple[str, ...] = ("instrument", "event_time", "price")
    identity: tuple[str, ...] = ("event_id",)
    unit: str = "iso8601"
    assume_timezone: str | None = None
    strict: bool = False
    drop_duplicates: bool = True
    reorder: bool = True
    sequence: str | None = None
    delimiter: str = ","


@dataclass(frozen=True)
class Imported:
    rows: DataFrame
    issues: DataFrame
    provenance: DataFrame


class ImportRejected(ValueError):
    pass


def _typed(name: str, raw: Column, policy: ImportPolicy) -> Column:
    if name in _TIMES:
        return parse_instant(raw, policy.unit, policy.assume_timezone)
    if name in _NUMBERS:
        return F.trim(raw).try_cast("double")
    if name in _COUNTS:
        return F.trim(raw).try_cast("bigint")
    if name == "price_base":
        return normal_price_base(raw)
    return F.nullif(F.trim(raw), F.lit(""))


def _convert(raw: DataFrame, policy: ImportPolicy) -> Imported:
    typed, problems = [], []
    for name, source in policy.mapping.items():
        text = F.col(f"`{source}`").cast("string")
        value = _typed(name, text, policy)
        typed.append(value.alias(name))
        filled = F.coalesce(F.trim(text), F.lit("")) != ""
        problems.append((f"parse_error:{name}", filled & value.isNull()))
        if name in policy.required:
            problems.append((f"missing:{name}", ~filled))
        if name in _NUMBERS:
            problems.append((f"non_finite:{name}", value.isNotNull() & ~finite(value)))
    for name, value in policy.defaults.items():
        typed.append(F.lit(value).alias(name))
    keep = [c for c in ("_corrupt", "_file") if c in raw.columns]
    if "_corrupt" in raw.columns:
        problems.append(("malformed_line", F.col("_corrupt").isNotNull()))
    work = raw.select(*typed, codes(problems).alias("issues"), F.to_json(F.struct(*raw.columns)).alias("raw_row"), *keep)
    clean = work.where(F.size("issues") == 0).drop("raw_row", "issues", "_corrupt")
    at = "event_time" if "event_time" in clean.columns else "start"
    found = [work.where(F.size("issues") > 0).select(
        F.explode("issues").alias("code"), F.lit("ERROR").alias("severity"), F.lit(1).cast("bigint").alias("copies"), "raw_row"
    )]

    def note(rows: DataFrame, code: str, severity: str, copies: Column, *show: str) -> None:
        found.append(rows.select(
            F.lit(code).alias("code"), F.lit(severity).alias("severity"), copies.cast("bigint").alias("copies"),
            F.to_json(F.struct(*show)).alias("raw_row"),
        ))

    if policy.sequence is not None:
        keys = ["instrument"] if "instrument" in clean.columns else []
        late = out_of_order(clean, keys, policy.sequence, at).where("out_of_order")
        note(late, "out_of_order", "WARNING" if policy.reorder else "ERROR", F.lit(1), policy.sequence, at)
    good = clean
    if all(c in clean.columns for c in policy.identity):
        order = [c for c in ("event_time", "start", "seq") if c in clean.columns]
        counted = first_wins(clean, list(policy.identity), order + [c for c in clean.columns if c not in order])
        level = "WARNING" if policy.drop_duplicates else "ERROR"
        note(counted.where(F.col("duplicates") > 0), "duplicate", level, F.col("duplicates"), *policy.identity)
        if policy.drop_duplicates:
            good = counted.drop("duplicates")
    if {"start", "end", "tf_seconds", "instrument"} <= set(good.columns):
        note(bar_gaps(good), "gap", "WARNING", F.lit(1), "gap_start", "gap_end")
    issues = union_all(found)
    provenance = work.agg(
        F.count(F.lit(1)).alias("rows_read"), F.count_if(F.size("issues") == 0).alias("rows_accepted"),
        F.count_if(F.size("issues") > 0).alias("rows_rejected"),
    )
    if policy.strict and not issues.where(F.col("severity") == "ERROR").isEmpty():
        raise ImportRejected("strict import: the file has errors")
    return Imported(good, issues, provenance)


def import_csv(spark: SparkSession, path: str, policy: ImportPolicy) -> Imported:
    """Delimited text with a header line; every field is read as text and cast explicitly."""
    header = spark.read.option("header", True).option("delimiter", policy.delimiter).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*header, "_corrupt"]])
    raw = (
        spark.read.option("header", True).option("delimiter", policy.delimiter)
        .option("columnNameOfCorruptRecord", "_corrupt").schema(schema).csv(path)
    )
    return _convert(raw.withColumn("_file", F.col("_metadata.file_name")), policy)


def import_jsonl(spark: SparkSession, path: str, policy: ImportPolicy) -> Imported:
    """One JSON object per line; fields named by the mapping, all read as text."""
    fields = [T.StructField(s, T.StringType()) for s in dict.fromkeys(policy.mapping.values())]
    schema = T.StructType([*fields, T.StructField("_corrupt", T.StringType())])
    raw = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return _convert(raw.withColumn("_file", F.col("_metadata.file_name")), policy)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files as ``value`` with ``file`` (name), ``line`` (its number in the file, from 1) and ``sequence``
    (its number in all files, by path).

    The splits of a file are read in parallel. A line's place in its split is its place among the rows of the task that reads the
    split; the splits before it are known from their line counts, one row a split, which is all that is joined back.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_from"),
        F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("_row"), "value",
    )
    splits = raw.groupBy("_path", "_from").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_lines"))
    files = splits.groupBy("_path").agg(F.sum("_lines").alias("_size"))
    upto = (Window.unboundedPreceding, -1)
    files = files.select("_path", F.coalesce(F.sum("_size").over(Window.partitionBy(F.lit(0)).orderBy("_path").rowsBetween(*upto)), F.lit(0)).alias("_earlier"))
    before = F.coalesce(F.sum("_lines").over(Window.partitionBy("_path").orderBy("_from").rowsBetween(*upto)), F.lit(0))
    splits = splits.withColumn("_before", before).join(files, "_path").drop("_lines")
    line = F.col("_before") + F.col("_row") - F.col("_first") + 1
    return raw.join(splits, ["_path", "_from"]).select("file", line.alias("line"), (F.col("_earlier") + line).alias("sequence"), "value")


def read_fixed_ticks(spark: SparkSession, path: str, instrument: str, *, zero_prices: bool = False) -> Imported:
    """Lines ``yyyyMMdd HHmmssSSS,bid,ask,volume`` on a fixed UTC-5 clock (no DST).

    A line is identified by its file's name and its number there, so equal lines stay apart; ``sequence`` grows through
    the files in path order. The volume is checked but is not a traded volume, so it is not kept. Prices must be positive;
    with ``zero_prices`` a price of zero is a quote too, and only negative ones are refused.
    """
    parts = F.transform(F.split(F.trim("value"), ","), lambda x: F.trim(x))
    fields = {n: F.get(F.col("_parts"), i) for i, n in enumerate(("stamp", "bid", "ask", "volume"))}
    raw = numbered_lines(spark, path).withColumn("_parts", parts).withColumns(fields)
    wall = F.try_to_timestamp("stamp", F.lit("yyyyMMdd HHmmssSSS"))
    bid, ask, vol = (F.col(c).try_cast("decimal(20,10)") for c in ("bid", "ask", "volume"))
    refused = lambda c: F.col(c).isNull() | ((F.col(c) < 0) if zero_prices else (F.col(c) <= 0))
    rows = raw.withColumns({
        "event_time": wall + F.expr("INTERVAL 5 HOURS"), "_bid": bid, "_ask": ask, "_vol": vol,
    })
    issues = codes([
        ("fields_invalid", (F.size("_parts") != 4) | F.exists("_parts", lambda x: x == "")),
        ("timestamp_invalid", F.col("event_time").isNull()),
        ("price_invalid", refused("_bid") | refused("_ask")),
        ("crossed", F.col("_ask") < F.col("_bid")),
        ("volume_invalid", F.col("_vol").isNull() | (F.col("_vol") < 0)),
    ])
    rows = rows.withColumn("issues", issues)
    good = rows.where(F.size("issues") == 0).select(
        F.lit(instrument).alias("instrument"), "event_time", F.col("event_time").alias("available_at"),
        F.col("_bid").alias("bid"), F.col("_ask").alias("ask"),
        F.concat(F.substring(F.sha2("file", 256), 1, 16), F.lit(":"), F.col("line").cast("string")).alias("source_event_id"), "sequence",
        F.date_format("event_time", "yyyy-MM").alias("month"),
    )
    bad = rows.where(F.size("issues") > 0).select(F.explode("issues").alias("code"), F.col("value").alias("raw_row"), F.col("file").alias("_file"), "line")
    provenance = rows.agg(
        F.count(F.lit(1)).alias("rows_read"), F.count_if(F.size("issues") == 0).alias("rows_accepted"),
        F.count_if(F.size("issues") > 0).alias("rows_rejected"),
    )
    return Imported(good, bad, provenance)
