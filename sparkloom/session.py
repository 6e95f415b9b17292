"""Session defaults, table access and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.observation import Observation


#: Folders of intermediate tables made by this driver.
made: list[str] = []
#: The temporary folder of a driver without a shared one.
own: dict[str, str] = {}


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench. On a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sparkloom")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables, which Catalyst then prunes and filters at the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder in the shared place that the cluster names in spark.checkpoint.dir.

    Only where that is unset and everything runs on this machine, as in tests, a temporary folder takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or own.get("root")
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-sparkloom-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        own["root"] = root
    made.append(f"{root}/sparkloom-{uuid.uuid4().hex}")
    return made[-1]


def clear_shared(spark: SparkSession) -> int:
    """Removes the folders of intermediate tables that this driver has made so far, and returns how many there were.

    For when the results of all queries built until then are written or read: what reads from these folders fails afterwards.
    """
    gone = 0
    while made:
        path = spark._jvm.org.apache.hadoop.fs.Path(made.pop())
        gone += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return gone


def materialize(df: DataFrame, path: str, **metrics) -> tuple[DataFrame, dict]:
    """Write df once as Parquet in the shared folder and read it back.

    It cuts the lineage, survives lost executors, and later readers prune columns and filter at the scan.
    The metrics, counts by name, are taken while writing and returned beside the table.
    """
    spark, got = df.sparkSession, {}
    if metrics:
        seen = Observation()
        df.observe(seen, *[m.alias(k) for k, m in metrics.items()]).write.parquet(path)
        found = seen.get  # what the optimiser proved empty reports nothing
        got = {k: found.get(k) or 0 for k in metrics}
    else:
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), got
