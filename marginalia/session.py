"""Session helpers: a local builder for tests, code shipping and checkpoint set-up for any session."""

from __future__ import annotations

import io
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def local_session(cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("marginalia")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.unionOutputPartitioning", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package's source to the executors once per application, so that Python
    workers import it wherever they run."""
    # a union of inputs partitioned alike may be taken for partitioned itself, and then fail when the
    # adaptive plan gives its inputs other numbers of partitions ("Can't zip RDDs")
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    target = Path(tempfile.mkdtemp(prefix="marginalia-")) / "marginalia_pkg.zip"
    target.write_bytes(buffer.getvalue())
    sc.addPyFile(str(target))  # the driver serves it; executors never read the local path
    _SHIPPED.add(sc.applicationId)


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder the session names in spark.checkpoint.dir.

    The folder is shared on a cluster, so the data survive a lost executor. Only on one machine, as
    in tests, a missing setting gives a folder of our own; a cluster without it is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="marginalia-checkpoint-"))
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table (a file or a folder) of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """At least one partition a core, for costly work on few or unsplittable input files; input that
    is split enough already stays where it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
