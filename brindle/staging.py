"""Intermediate tables in the folder that all executors share.

``stage`` cuts a plan's lineage by writing a Parquet table under the folder that the session names in
``spark.checkpoint.dir`` and reading it back, so that a lost executor costs a re-read and not a recomputation.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_STAGED: list[str] = []
_PATHS: dict[int, str] = {}
_LAST: list[SparkSession] = []
#: Tasks that write a short table, and its rows to each from so many tasks on.
FEWEST_TASKS, ROWS_A_TASK = 12, 100_000


@atexit.register
def _drop_at_exit() -> None:
    """Staged tables end with the driver; a driver that is killed leaves them to whoever cleans the shared folder."""
    with contextlib.suppress(Exception):
        if _LAST:
            drop_staged(_LAST[0])


def setting(spark: SparkSession, key: str) -> str | None:
    """A session setting, or None where it is unset."""
    try:
        return spark.conf.get(key)
    except Exception:  # an unknown key raises
        return None


def staging_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; the warehouse's folder where it is unset; in local mode a temporary folder."""
    root = setting(spark, "spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        root = tempfile.mkdtemp(prefix="brindle-")
        spark.conf.set("spark.checkpoint.dir", root)
        return root
    return setting(spark, "spark.sql.warehouse.dir").rstrip("/") + "/_staging"


def stage(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder, with the session's codec or ``codec``, and return the table
    read back."""
    spark = df.sparkSession
    path = f"{staging_root(spark)}/brindle-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path, compression=codec)
    _STAGED.append(path.rsplit("/", 1)[0])
    _LAST[:] = [spark]
    found = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(found)] = _STAGED[-1]
    return found


def stage_counted(df: DataFrame, name: str, *sums: Column) -> tuple[DataFrame, dict]:
    """``stage``, and the number of rows, n, and other named sums of them, which are taken while they are written."""
    seen = Observation()
    return stage(df.observe(seen, F.count(F.lit(1)).alias("n"), *sums), name), seen.get


def short(df: DataFrame, rows: int) -> DataFrame:
    """``df``, at most so many rows of ids and counts, in no more partitions than they are worth."""
    return df.coalesce(max(FEWEST_TASKS, -(-rows // ROWS_A_TASK)))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder, for a stored table that ends with the staged ones."""
    path = f"{staging_root(spark)}/brindle-{uuid.uuid4().hex}"
    _STAGED.append(path)
    _LAST[:] = [spark]
    return f"{path}/{name}"


def unstage(df: DataFrame) -> None:
    """Delete a staged table that nothing will read again: what was made from it is staged itself."""
    path = _PATHS.pop(id(df), None)
    if path in _STAGED:
        _STAGED.remove(path)
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def drop_staged(spark: SparkSession) -> int:
    """Delete the tables that this process staged; call it once their results are written. Returns how many."""
    n = 0
    while _STAGED:
        _delete(spark, _STAGED.pop())
        n += 1
    _PATHS.clear()
    return n


def bounded_batches(spark: SparkSession, rows: int = 512) -> None:
    """Let Arrow batches hold at most ``rows`` rows, so that very long texts don't fill a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(setting(spark, key) or 10_000) <= rows:
        spark.conf.set(key, str(rows))


def spread(df: DataFrame, most: int = 8) -> DataFrame:
    """``df`` dealt out to some cores if it is one small file: a scan of fewer than ``most`` tasks and fewer than the cores.

    A table of more tasks stays as it is, however many cores there are: its texts aren't shuffled.
    """
    cores = min(df.sparkSession.sparkContext.defaultParallelism, most)
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
