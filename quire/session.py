"""Session construction and cluster-aware settings.

Everything here only *reads* cluster settings that an operator of the cluster
already chose; local defaults are applied only where a value is unset (tests,
bench on one machine).
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

# Settings every job in this package relies on.  They are the Spark defaults a
# cluster admin would pick anyway; set only when the session does not already
# carry a value.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def get_spark(master: str | None = None, app: str = "quire",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or return) a session.  ``master`` is only honoured for local runs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = (builder
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    apply_defaults(spark)
    return spark


def apply_defaults(spark: SparkSession) -> SparkSession:
    conf = spark.conf
    for key, value in _DEFAULTS.items():
        if conf.get(key, None) in (None, ""):
            conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    On a cluster this must be set by the operator (a shared file system path),
    else this fails: executors could not see a folder of the driver's machine.
    Only a local master (tests, one-machine runs) gets a fresh scratch folder.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="quire-ckpt-")
    sc.setCheckpointDir(local)
    return local


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application: Python functions in plans are
    pickled by module name, and a worker need not start in the folder that holds the package."""
    sc = spark.sparkContext
    if getattr(sc, "_quire_shipped", False):
        return
    here = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="quire-package-"), "quire-package.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    sc.addPyFile(target)
    sc._quire_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str):
    """One driver table (one parquet file or folder) by name."""
    ship_package(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def materialize(df):
    """Cut lineage: write ``df`` once to the cluster's checkpoint folder and
    read it back (reliable ``checkpoint``; never a machine-local one).  Use on
    a narrow intermediate that several branches of one plan reuse."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
