"""Session helpers: where to cut lineage, and how.

Iterative operators cut their lineage by writing a table into the folder that all executors share
(``spark.checkpoint.dir``), never by a local checkpoint: a lost executor then costs a re-read, not the
job. A written table is also smaller than a checkpointed RDD (columnar, compressed) and carries the
size statistics that the planner needs.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of the cluster; a folder of our own only where none is configured (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="histolith-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one; it is deleted when the driver exits, if its session is still alive then."""
    path = f"{shared_folder(spark)}/histolith-{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clear)
    _made.append((spark, path))
    return path


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _clear() -> None:
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc is None:
                break
            _delete(spark, path)
        except Exception:
            break


#: Spark's option to delete the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str = "step", by: str | None = None, tidy: bool = False) -> DataFrame:
    """``df`` as a table in the shared folder, partitioned ``by`` a column: a lineage cut that survives the loss of executors.
    ``tidy``: its shuffle files are deleted at once, not when the driver collects its garbage, and it is compressed harder."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    kept = spark.conf.get(CLEANUP, "false")
    try:
        if tidy:
            spark.conf.set(CLEANUP, "true")
            df = df.select("*")  # a plan of its own: no other action reads its shuffle files
        (df.write.partitionBy(by) if by else df.write).option("compression", "zstd" if tidy else spark.conf.get("spark.sql.parquet.compression.codec")).parquet(path)
    finally:
        spark.conf.set(CLEANUP, kept)
    out = spark.read.schema(df.schema).parquet(path)
    out._histolith_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_histolith_path", None)
        if path:
            _delete(df.sparkSession, path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it is read in fewer parts than there are cores (a small table in one file)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
