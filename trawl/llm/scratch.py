"""Intermediate tables of one operator call, in the shared folder of the session.

``Scratch`` writes Parquet below ``spark.checkpoint.dir`` (read from the session, see
:func:`trawl.session.checkpoint_dir`) and reads it back: the lineage is cut, a lost
executor re-reads files that all executors share.  Tables that are no longer needed are
dropped at once; the rest goes when the driver program ends, because a lazily returned
result may still read them.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from trawl.session import checkpoint_dir

#: Largest measured size of a table that is broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 64 * 1024 * 1024


class Scratch:
    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/trawl-{name}-{uuid.uuid4().hex}"
        atexit.register(self._at_exit)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        self._delete(f"{self.root}/{name}")

    def _at_exit(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # noqa: BLE001 - the session may be gone already; the folder is only scratch
            pass

    def _delete(self, path: str) -> None:
        jvm = getattr(self.spark.sparkContext, "_jvm", None)
        if jvm is None or self.spark.sparkContext._jsc is None:
            return
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fits_broadcast(rows: int, row_bytes: int) -> bool:
    """The size check in front of every broadcast of a table that grows with the data."""
    return rows * row_bytes <= BROADCAST_BYTES
