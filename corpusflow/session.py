"""Session settings and lineage cuts shared by all operators."""

from __future__ import annotations

import tempfile
import zipfile
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings that the operators expect; sizes are left to the cluster.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session on this machine, for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("corpusflow")
    settings = DEFAULTS | {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
    } | conf
    spark = builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _shared_root(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a temporary one only where there is no cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="corpusflow-")
    return root


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the folder in ``spark.checkpoint.dir`` and read from there.

    The files are shared by all executors, so losing one executor loses nothing.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(_shared_root(df.sparkSession))
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once for each application; needed where it isn't installed on them."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="corpusflow-"), "corpusflow_package.zip")
    with zipfile.ZipFile(archive, "w") as target:
        for source in sorted(root.rglob("*.py")):
            target.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


_shipped: set[str] = set()


def _width(df: DataFrame) -> Column:
    """About how many bytes a row takes: eight for a plain value, the length of texts, and that of its JSON for what is nested."""
    parts = [F.lit(8)]
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            parts.append(F.coalesce(F.octet_length(c), F.lit(0)))
        elif kind.startswith(("array", "struct", "map")):
            parts.append(F.coalesce(F.octet_length(F.to_json(c)), F.lit(0)))
        parts.append(F.lit(8))
    return reduce(Column.__add__, parts).cast("long")


def broadcast_if_small(df: DataFrame, limit_rows: int = 100_000, limit_bytes: int = 32 << 20) -> DataFrame:
    """``df``, with a hint to broadcast it if it has no more than ``limit_rows`` rows of ``limit_bytes`` in all; else it is joined by shuffling."""
    df = checkpointed(df)
    n, size = df.limit(limit_rows + 1).agg(F.count("*"), F.coalesce(F.sum(_width(df)), F.lit(0))).first()
    return F.broadcast(df) if n <= limit_rows and size <= limit_bytes else df


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder that all executors share: below ``spark.checkpoint.dir``, or a temporary one where that is unset."""
    return f"{_shared_root(spark)}/{name}"


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if it is read in half as many parts or fewer, as small files are; else as it is.

    For tables whose texts take long to work on. Large tables are read in more parts than there are cores and aren't moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df
