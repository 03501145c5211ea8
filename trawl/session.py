"""SparkSession helpers.

On a cluster the session is configured by the launcher; these helpers only fill in
settings that are unset, so a test run on ``local[*]`` gets sane values without
overriding anything a cluster operator chose.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_LOCAL_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "trawl") -> SparkSession:
    """A local session for tests and benchmarks (the only place a local folder is chosen)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in _LOCAL_DEFAULTS.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("TRAWL_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if not _configured_dir(spark):
        local = tempfile.mkdtemp(prefix="trawl-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.sparkContext.setCheckpointDir(local)
    return spark


def _configured_dir(spark: SparkSession) -> str | None:
    sc_dir = spark.sparkContext.getCheckpointDir()
    if sc_dir:
        return sc_dir
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:
        spark.sparkContext.setCheckpointDir(conf)
        return spark.sparkContext.getCheckpointDir() or conf
    return None


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir`` (lineage cuts, result tables).

    Never invents a folder on a cluster: if nothing is configured there, it raises.
    Only a ``local[...]`` session without a setting (a test run) gets a scratch folder.
    """
    found = _configured_dir(spark)
    if found:
        return found
    if spark.sparkContext.master.startswith("local"):
        local = tempfile.mkdtemp(prefix="trawl-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.sparkContext.setCheckpointDir(local)
        return spark.sparkContext.getCheckpointDir() or local
    raise RuntimeError("spark.checkpoint.dir is not set; configure a shared folder for this session")


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``trawl`` importable in Python workers (``addPyFile`` of a zip of the
    package), once per SparkContext.  Needed whenever the package is not installed on
    the executors, e.g. when the driver runs from another working directory."""
    import shutil

    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    staging = tempfile.mkdtemp(prefix="trawl-pkg-")
    archive = shutil.make_archive(
        os.path.join(staging, "trawl"), "zip", root_dir=os.path.dirname(pkg_dir), base_dir=os.path.basename(pkg_dir)
    )
    sc.addPyFile(archive)
    _SHIPPED.add(key)
