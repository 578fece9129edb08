"""Session helpers: shared storage for cut lineage, and code shipping to executors."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCK = threading.Lock()
_OWN: dict[str, str] = {}
_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors can write to.

    It is the cluster's ``spark.checkpoint.dir``; only where that is unset (a local
    session, as in tests) a temporary folder of this process stands in.
    """
    sc = spark.sparkContext
    set_one = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if set_one:
        return set_one.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    with _LOCK:
        if sc.applicationId not in _OWN:
            _OWN[sc.applicationId] = tempfile.mkdtemp(prefix="chronoweave-")
            sc.setCheckpointDir(_OWN[sc.applicationId])
        return _OWN[sc.applicationId]


def cut(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    The result depends on stored files alone, so a lost executor costs no recomputation
    of what came before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame | None) -> None:
    """Delete stored tables that nothing will read again; those must be cut()'s own results."""
    for df in tables:
        if df is None:
            continue
        spark = df.sparkSession
        for name in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
            # a table's folder is the one right under the shared folder
            root = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark)).toUri().getPath().rstrip("/")
            while path is not None and path.getParent() is not None and path.getParent().toUri().getPath().rstrip("/") != root:
                path = path.getParent()
            if path is not None and path.getParent() is not None:
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ensure_shipped(spark: SparkSession) -> None:
    """Make this package importable on the executors, once per application."""
    sc = spark.sparkContext
    with _LOCK:
        if sc.applicationId in _SHIPPED:
            return
        root = Path(__file__).resolve().parent
        target = os.path.join(tempfile.mkdtemp(prefix="chronoweave-src-"), "chronoweave.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent).as_posix())
        sc.addPyFile(target)
        _SHIPPED.add(sc.applicationId)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
