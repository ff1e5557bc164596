"""Session settings and the one place where intermediate tables are pinned."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_SCOPE: ContextVar[str] = ContextVar("tickloom_pins", default="main")


def local_session(cores: str = "8", app: str = "tickloom") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package()
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for pinned tables: the cluster's own setting when there is one.

    A private folder is made only on a local master without that setting (tests, laptops):
    on a cluster executors could not see it, so a missing setting is an error there.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-tickloom-", dir="/tmp")
        spark.conf.set(CHECKPOINT_KEY, root)
    return root.rstrip("/")


def job_folder(spark: SparkSession) -> str:
    """This application's own part of the shared folder."""
    return f"{checkpoint_root(spark)}/tickloom-{spark.sparkContext.applicationId}"


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def drop_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def drop_pinned(spark: SparkSession, scope: str | None = None) -> None:
    """Remove what this application pinned, or pinned in one scope, once its results are stored elsewhere."""
    drop_folder(spark, job_folder(spark) if scope is None else f"{job_folder(spark)}/pinned/{scope}")


@contextmanager
def pins(scope: str) -> Iterator[None]:
    """Tables pinned inside belong to ``scope``, so that they can be dropped without the others."""
    before = _SCOPE.set(scope)
    try:
        yield
    finally:
        _SCOPE.reset(before)


def pin(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where a later stage must see exactly the rows (and partition numbers) an
    earlier stage saw: a lost executor then rereads files instead of re-deriving them.
    Parquet rather than RDD checkpointing keeps column pruning on the way back.
    """
    spark = df.sparkSession
    path = f"{job_folder(spark)}/pinned/{_SCOPE.get()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """Fresh folder for a table that a later step of the same job reads."""
    return f"{job_folder(spark)}/scratch/{name}-{uuid.uuid4().hex}"


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def ship_package() -> None:
    """Send this package's functions to Python workers by value.

    Workers then need not have the package on their own path, which also covers the
    planning worker of stateful streams.
    """
    import tickloom

    if tickloom.__name__ not in cloudpickle.list_registry_pickle_by_value():
        cloudpickle.register_pickle_by_value(tickloom)


def fit_local(spark: SparkSession) -> None:
    """On one machine, bring the untouched default of 200 shuffle partitions down to its cores.

    A cluster's setting, and any value somebody chose, stays as it is.
    """
    local = spark.sparkContext.master.startswith("local")
    if local and spark.conf.get("spark.sql.shuffle.partitions", "200") == "200":
        spark.conf.set("spark.sql.shuffle.partitions", str(max(2, spark.sparkContext.defaultParallelism)))


# A task of a shuffle gets about this much of the stored input, whatever its size.
BYTES_PER_TASK = 16 << 20
ADVISORY_KEY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
_WIDTHS: dict[str, tuple[int, int, dict[str, int]]] = {}


def stored_bytes(spark: SparkSession, path: str) -> int:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(hadoop).getLength()


def fit_input(spark: SparkSession, path: str | None = None) -> None:
    """Widen shuffles with the input, so that a task's share does not grow with the tables.

    Without ``path`` a new query begins and the session's own number of partitions holds again; each table it then reads
    raises the number to its bytes over ``BYTES_PER_TASK``, all tables together. The session's number is never lowered.
    Adaptive execution joins small partitions up to the same size, where the session names none: its own 64 MB of compressed
    rows were 1.4 GB of one task's memory.
    """
    if spark.conf.get(ADVISORY_KEY, None) is None:
        spark.conf.set(ADVISORY_KEY, str(BYTES_PER_TASK))
    app, now = spark.sparkContext.applicationId, shuffle_width(spark)
    own, ours, read = _WIDTHS.get(app, (now, now, {}))
    own = own if now == ours else now
    read = {} if path is None else {**read, path: stored_bytes(spark, path)}
    want = max(own, -(-sum(read.values()) // BYTES_PER_TASK))
    if want != now:
        spark.conf.set("spark.sql.shuffle.partitions", str(want))
    _WIDTHS[app] = own, want, read


ARROW_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
ARROW_BYTES = 4 << 20


def fit_batches(spark: SparkSession) -> None:
    """Bound what a task hands to Python at once by bytes, where the session names no bound.

    Batches of 10,000 rows follow the length of the texts, and each is held several times: by the task, its Arrow buffers, which
    Spark keeps for the next batch, and the worker. Idle workers keep their part while a later stage without Python runs.
    """
    if spark.conf.get(ARROW_KEY, None) is None:
        spark.conf.set(ARROW_KEY, str(ARROW_BYTES))


def use_utc(spark: SparkSession) -> None:
    """All calendar arithmetic here is UTC; the casts of naive columns depend on it."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
