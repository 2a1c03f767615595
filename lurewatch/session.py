"""Session helpers: defaults, the shared working folder, staged tables."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "lurewatch", cores: str | int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    if "spark__checkpoint__dir" not in conf:
        builder = builder.config("spark.checkpoint.dir", _stand_in())
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a session on one machine may do without: a temporary folder stands in there.  Anywhere
    else a folder that executors do not share would lose data, so that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _stand_in()


@lru_cache(maxsize=1)
def _stand_in() -> str:
    return tempfile.mkdtemp(prefix="lurewatch-")


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one, which ``drop_staged`` removes as well."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    return path


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back.

    Cuts lineage in a way that survives the loss of executors, and unlike a checkpoint keeps
    column pruning and filter push-down for the passes that follow.  ``drop_staged`` removes what
    was staged once the results are no longer needed.
    """
    path = run_dir(df.sparkSession, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> int:
    """Removes the folders that this process has made, and says how many there were."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    dropped = 0
    while _STAGED:
        path = jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        dropped += bool(path.getFileSystem(conf).delete(path, True))
    return dropped


_STAGED: list[str] = []
