"""Session helpers: a local session for tests and the shared checkpoint folder."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable, Hashable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession


T = TypeVar("T")


def per_process(kind: str, key: Hashable, make: Callable[[], T]) -> T:
    """What ``make`` gives, made once per Python process for a key; of each kind the latest is kept.

    Functions travel to the workers by value, so a module's own variables begin
    anew with every task; this box outlives them.
    """
    box = sys.__dict__.setdefault("_vaultweave_kept", {})
    if kind not in box or box[kind][0] != key:
        box[kind] = (key, make())
    return box[kind][1]


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "vaultweave") -> SparkSession:
    """A local session with the settings the engine expects of any cluster (UTC, AQE)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    A cluster names a folder all executors share in ``spark.checkpoint.dir``;
    only where neither that nor a context-level folder is set and the master is
    local (tests on one machine) a local one is made.  A cluster without a
    shared folder is refused, since its executors could not read each other's rows.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not named and not is_local(sc.master):
        raise ValueError("name a folder all executors share in spark.checkpoint.dir")
    folder = named or tempfile.mkdtemp(prefix="vaultweave-ckpt-")
    sc.setCheckpointDir(folder)
    return folder


def is_local(master: str) -> bool:
    """Whether a master runs everything in one process."""
    return master == "local" or master.startswith("local[")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str = "cut") -> DataFrame:
    """``df`` written as parquet into the shared checkpoint folder and read back, lineage cut.

    Columnar and compressed, so iterative operators keep less on disk than with
    ``checkpoint()``; a lost executor re-reads it from the shared folder.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fits(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; reads no more than needed to tell."""
    return df.limit(max_rows + 1).count() <= max_rows


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever file system the cluster shares."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
