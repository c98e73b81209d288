"""Session helpers.

The library never creates a session behind the caller's back; these helpers are
for tests, the bench and command-line use.  On a cluster the session comes from
the platform and only ``scratch_dir`` is consulted, which reads
``spark.checkpoint.dir`` from the session and only invents a local folder when
the setting is absent (local test runs).
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # HotSpot does not JIT-compile methods above 8000 bytes of bytecode; wide
    # projections (dozens of daily feature columns) otherwise run a huge
    # generated method in the bytecode interpreter.  Above the limit Spark
    # falls back to split, compilable expression code.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  driver_memory: str = "8g", app: str = "gridframe") -> SparkSession:
    """A local[N] session configured the way the library expects (UTC, AQE)."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", driver_memory))
    for k, v in _LOCAL_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder.

    Uses the directory already registered on the context, else
    ``spark.checkpoint.dir`` from the session / context configuration, and only
    when neither exists (local tests) creates a local temporary folder."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
        d = tempfile.mkdtemp(prefix="gridframe-ckpt-")
        if _settable(spark):
            spark.conf.set("spark.checkpoint.dir", d)
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def _settable(spark: SparkSession) -> bool:
    try:
        return spark.conf.isModifiable("spark.checkpoint.dir")
    except Exception:  # pragma: no cover - conservative
        return False


def scratch_dir(spark: SparkSession, name: str = "tables") -> str:
    """A fresh folder for written tables under the shared checkpoint location."""
    base = ensure_checkpoint_dir(spark)
    path = os.path.join(base, f"gridframe-{name}-{uuid.uuid4().hex[:12]}")
    return path


def write_scratch(df, name: str = "tables"):
    """Write ``df`` as a table under the shared checkpoint location; the table read back, and its folder."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove_scratch(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``write_scratch`` made, once nothing reads it any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
