"""Spark session defaults used by tests, the bench and the entry module.

On a cluster the caller owns the session; these helpers only fill in
settings that are unset.  Two are set in any case, as results depend on them:
the session time zone (UTC) and ANSI mode (``REQUIRED_CONF``).
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every operator relies on: UTC timestamps (durations and month keys
# are computed in UTC) and ANSI casts (label coercion must raise on text).
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    # JSON objects that repeat a key are read, the last one counting
    "spark.sql.variant.allowDuplicateKeys": "true",
}

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # post-shuffle partitions of ~128 MB: small enough to sort without heavy spill
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "convlytics", extra: dict | None = None) -> SparkSession:
    """Return the active session, or build one with the library defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        for k, v in REQUIRED_CONF.items():
            active.conf.set(k, v)
        ship_package(active)
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    conf.update(REQUIRED_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and materialised intermediates.

    Reads ``spark.checkpoint.dir`` from the session (the cluster names a
    shared, fault-tolerant folder there).  Only when it is unset on a local
    master -- tests -- a fresh scratch folder is created and registered; on
    any other master that would leave each executor with files of its own, so
    it raises.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", sc.master or ""):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="convlytics-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", d)
        except Exception:  # noqa: BLE001 - core conf may be read-only at runtime
            pass
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that no later read needs."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A unique sub-path of the shared checkpoint folder."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``convlytics`` importable in Python workers (``addPyFile`` of a zip).

    Python UDFs and ``mapInPandas`` functions defined in this package are
    pickled by reference, so executors must be able to import it.  On a
    cluster, install the package on the executors or pass it with
    ``--py-files``; set ``convlytics.shipPackage=false`` to skip this step.
    """
    import os
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED or spark.conf.get("convlytics.shipPackage", "true").lower() == "false":
        return
    is_local = (sc.master or "").startswith("local")
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    # prefer the session's shared folder when it is a local path; otherwise the
    # zip is written on the driver and served to executors by Spark itself
    shared = spark.conf.get("spark.checkpoint.dir", None) or ""
    local_shared = shared.removeprefix("file:") if shared and "://" not in shared.removeprefix("file://") else ""
    if local_shared and os.path.isdir(local_shared):
        zpath = os.path.join(local_shared, f"convlytics-{uuid.uuid4().hex}.zip")
    elif is_local:
        fd, zpath = tempfile.mkstemp(prefix="convlytics-", suffix=".zip")
        os.close(fd)
    else:
        # cluster without a local shared folder: the package must be installed
        # on the executors or passed with --py-files
        return
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as zf:
        for dirpath, _, files in os.walk(pkg_dir):
            if "__pycache__" in dirpath:
                continue
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(key)
