"""Size checks, durable cuts of the lineage and skew detection."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# A group with fewer rows than this fits in one task.
HOT_GROUP_ROWS = 2_000_000
# Hot keys that are broadcast; more of them are joined by a shuffle.
BROADCAST_KEYS = 10_000
# Input bytes per task of an explicit repartition.
TASK_BYTES = 128 * 1024 * 1024


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's spark.checkpoint.dir.

    A machine-local folder is only accepted for a local master with no setting."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        current = sc._jsc.sc().getCheckpointDir()
        path = current.get() if current.isDefined() else None
    if path is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        path = tempfile.mkdtemp(prefix="run-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(path)
    return path


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage in reliable storage, so a lost executor cannot change rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, computed once however often they are read."""
    path = scratch_path(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def below(root: str) -> str:
    """A fresh path in a shared folder."""
    return f"{root}/{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table this library wrote as an intermediate step and no longer reads."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _leaf_bytes(df: DataFrame, scans_only: bool = False) -> list[int]:
    found = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    leaves = [found.apply(n) for n in range(found.size())]
    if scans_only:
        leaves = [l for l in leaves if l.getClass().getSimpleName() == "LogicalRelation"]
    return [int(str(l.stats().sizeInBytes())) for l in leaves]


def hot_groups(df: DataFrame, by: list[str], floor_rows: int | None = None) -> DataFrame | None:
    """Keys of the groups too large for one task, or None.

    One count, summed in the tasks first, finds them.  The keys stay a table, however many."""
    floor_rows = HOT_GROUP_ROWS if floor_rows is None else floor_rows
    keys = df.groupBy(*by).agg(F.count("*").alias("__n")).filter(F.col("__n") > floor_rows).select(*by)
    rows = keys.limit(BROADCAST_KEYS + 1).collect()
    if not rows:
        return None
    if len(rows) > BROADCAST_KEYS:
        return durable(keys)
    return F.broadcast(df.sparkSession.createDataFrame(rows, keys.schema))


def join_groups(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on group keys that keeps the NULL group, as GROUP BY does."""
    there = right.withColumnsRenamed({c: f"__key_{c}" for c in by})
    condition = F.lit(True)
    for c in by:
        condition = condition & F.col(c).eqNullSafe(F.col(f"__key_{c}"))
    return left.join(there, condition, how).drop(*[f"__key_{c}" for c in by])


def shuffle_partitions(df: DataFrame) -> int:
    """Tasks for an explicit repartition: the session's setting, or more when the input would
    give them over TASK_BYTES each."""
    # only stored tables report a true size
    wanted = -(-sum(_leaf_bytes(df, scans_only=True)) // TASK_BYTES)
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), wanted)
