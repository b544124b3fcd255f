"""Tables cut into shared storage, so that lineage ends and lost executors cost no recomputation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .errors import ParameterError

#: Folders of our own, by application.
_OWN: dict[str, str] = {}
#: Tables that were cut: application and path.
_CUT: list[tuple[str, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where it is unset in local mode. On a cluster no machine-local folder will do."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ParameterError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = f"file://{tempfile.mkdtemp(prefix='quern-shared-')}"
        found = _OWN[app]
    return found.rstrip("/")


def cut(df: DataFrame, label: str = "table") -> DataFrame:
    """df written to the shared folder and read back; release() deletes such tables once results that need them are written."""
    path = f"{shared_dir(df.sparkSession)}/quern-{label}-{uuid.uuid4().hex}"
    _CUT.append((df.sparkSession.sparkContext.applicationId, path))
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cuts(spark: SparkSession) -> list[str]:
    """Paths of the tables that this application has cut and not deleted."""
    return [p for a, p in _CUT if a == spark.sparkContext.applicationId]


def release(spark: SparkSession, only: list[str] | None = None, keep: DataFrame | None = None) -> int:
    """Delete tables that this application has cut (all, or `only` these), but for those that `keep` reads; other DataFrames that read them are of no more use."""
    read = "\n".join(keep.inputFiles()) if keep is not None else ""
    gone = [p for p in cuts(spark) if (only is None or p in only) and p.rsplit("/", 1)[-1] not in read]
    for path in gone:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _CUT[:] = [x for x in _CUT if x[1] not in gone]
    return len(gone)
