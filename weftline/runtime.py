"""Session-level helpers: table access, delivery de-duplication, lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: list[str] = []
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, so that they need no path of ours."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="weftline-code-")) / "weftline.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"weftline/{f.relative_to(root)}")
    context.addPyFile(str(target))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table ``name`` of the data folder ``sf_dir``."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach.

    ``spark.checkpoint.dir`` of the running session decides. Only in a local
    session where it is unset (tests) a temporary folder of our own is used,
    which goes when the process ends; on a cluster that is an error.
    """
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="weftline-"))
        atexit.register(shutil.rmtree, _OWN_DIR[0], ignore_errors=True)
    return "file://" + _OWN_DIR[0]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage with a table that survives the loss of executors, compressed,
    so iterative operators neither recompute nor depend on block managers.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/weftline/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delivered_once(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row per distinct non-null ``key``; a repeated delivery has the same content."""
    return df.select(key, *columns).where(F.col(key).isNotNull()).dropDuplicates([key])


def default_parallelism(spark: SparkSession) -> int:
    """Shuffle width that the session is set to."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def local_session(cores: str = "8", **extra: str) -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    conf = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("WEFTLINE_DRIVER_MEMORY", "8g"),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
    } | extra
    builder = SparkSession.builder.master(f"local[{cores}]").appName("weftline")
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
