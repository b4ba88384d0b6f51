"""Session, lineage and broadcast policy."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "bitquilt", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    settings.update({k: str(v) for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_local_root: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: `spark.checkpoint.dir`.

    Only a local master may fall back to a temporary folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if context.applicationId not in _local_root:
        _local_root[context.applicationId] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _local_root[context.applicationId]


def new_table_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark's own setting: the shuffle files of a query are deleted when the query has ended, not at a later collection.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Delete the shuffle files of each query that is run inside, at its end; the session's own setting returns after it."""
    before = spark.conf.get(FILE_CLEANUP, None)
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FILE_CLEANUP)
        else:
            spark.conf.set(FILE_CLEANUP, before)


def cut(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write `df` as a table in the shared folder and continue from it.

    The plan of the result starts at the files, so iterative plans stay short
    and a lost executor costs a re-read, not a re-run of earlier passes. The
    write's shuffle files go as soon as it has ended: nothing reads them again.
    """
    path = new_table_path(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored._cut_path = path
    return stored


def discard(*tables: DataFrame) -> None:
    """Delete tables written by `cut` that a loop has replaced."""
    for df in tables:
        path = getattr(df, "_cut_path", None)
        if path:
            context = df.sparkSession.sparkContext
            target = context._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def spread(scan: DataFrame) -> DataFrame:
    """Deal the rows of a plain scan out when it has fewer splits than there are cores.

    Large inputs have far more splits than cores and stay as they are.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def size_bytes(text: str) -> int:
    """Bytes of a Spark size such as 10485760, 256k, 100MB or -1."""
    match = re.fullmatch(r"\s*(-?\d+)\s*([kmgtp]?)i?b?\s*", str(text).lower())
    if not match:
        raise ValueError(f"not a size: {text!r}")
    return int(match[1]) << (10 * " kmgtp".index(match[2] or " "))


def broadcast_limit(spark: SparkSession) -> int:
    return size_bytes(spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760"))


def fits_broadcast(spark: SparkSession, rows: int, row_bytes: int) -> bool:
    return rows * row_bytes <= max(broadcast_limit(spark), 0)


def join_side(rows: DataFrame, side: DataFrame, keys: list[str], side_rows: int, row_bytes: int = 32, how: str = "inner") -> DataFrame:
    """Join exploded rows with a table of known row count.

    The table is broadcast while it fits the session's threshold, else both
    sides are joined by sort and merge. The choice is made here because size
    estimates do not see how far rows were exploded and would send the wrong
    side around.
    """
    fits = fits_broadcast(rows.sparkSession, side_rows, row_bytes)
    return rows.join(side.hint("broadcast" if fits else "merge"), keys, how)
