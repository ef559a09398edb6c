"""Tables that are written once and read again, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths of tables made by written(), by application.
_made: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a local master (tests) gets an own folder; a cluster has to name one."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="terralex-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def guard(spark: SparkSession) -> None:
    """Switches off a rule of Spark 4.1 that takes a union of sides that are shuffled alike for shuffled by itself: where exchanges are reused, it can leave
    out the shuffle of an aggregate over the union and still keep the sides' partitions apart, so that one key has two rows."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def new_path(spark: SparkSession, name: str) -> str:
    """A path for a table or folder that release() removes."""
    path = f"{shared_folder(spark)}/terralex/{name}-{uuid.uuid4().hex[:12]}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it is computed once, and lost executors cost no more than its unread parts."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def remove(df: DataFrame) -> None:
    """Deletes the files of a table made by written() that is no longer needed."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def mark(spark: SparkSession) -> int:
    """A place in the list of written tables, for release()."""
    return len(_made.setdefault(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, since: int = 0, until: int | None = None) -> None:
    """Deletes what was written between two marks. DataFrames that still read it can't be used any more."""
    own = _made.setdefault(spark.sparkContext.applicationId, [])
    until = len(own) if until is None else until
    for path in own[since:until]:
        _delete(spark, path)
    del own[since:until]
