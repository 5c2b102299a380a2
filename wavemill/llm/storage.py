"""Intermediate tables in the folder that driver and executors share.

``spark.checkpoint.dir`` names that folder. Only a session of one machine may leave it unset (tests, a
laptop): a temporary folder of this machine then stands in for it; on a cluster that is an error.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: What holds while a table is written: its shuffle files go as soon as it is done, as what it wrote replaces
#: them; and buckets, each of which is one sorted file here, are read as sorted, and grouped by streaming.
WHILE_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
    "spark.sql.execution.replaceHashWithSortAgg": "true",
}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session, ``spark.checkpoint.dir``."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
    return f"{tempfile.gettempdir()}/wavemill-shared"


def unused(stem: str, *names: str) -> str:
    """``stem``, made longer until none of the names begins with it."""
    while any(n.lower().startswith(stem) for n in names):
        stem += "_"
    return stem


class Workspace:
    """Tables of one run: each is written as Parquet, so lost executors never lose more than a stage.

    Everything below the workspace goes when the application ends; ``drop`` frees a table earlier.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        fs, path = self._at(self.root)
        fs.deleteOnExit(path)

    def _at(self, where: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(where)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    @contextmanager
    def _writing(self) -> Iterator[None]:
        conf = self.spark.conf
        before = {k: conf.get(k, None) for k in WHILE_WRITING}
        for k, v in WHILE_WRITING.items():
            conf.set(k, v)
        try:
            yield
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return a DataFrame that reads it back: a cut of the lineage."""
        with self._writing():
            df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def save_bucketed(self, df: DataFrame, name: str, *keys: str, shuffle: bool = True, hashes: bool = False) -> DataFrame:
        """Like ``save``, sorted in buckets of ``keys``: joins and groups by just these keys need no shuffle.

        Without ``shuffle``, ``df`` is dealt by the keys already. Unions of such tables keep the buckets.
        Tables of ``hashes`` hardly compress, so they are written plainly.
        The name that Spark needs to write buckets is gone when this returns, the files stay.
        """
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        table = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
        out = (df.repartition(buckets, *keys) if shuffle else df).write.bucketBy(buckets, *keys).sortBy(*keys)
        with self._writing():
            out = out.format("parquet").option("compression", "snappy" if hashes else "zstd").option("parquet.enable.dictionary", str(not hashes).lower())
            out.option("path", self.path(name)).saveAsTable(table)
        found = self.spark.table(table)
        found.schema  # resolved now, by the files
        self.spark.sql(f"DROP TABLE {table}")
        return found

    def drop(self, *names: str) -> None:
        for name in names:
            fs, path = self._at(self.path(name))
            fs.delete(path, True)

    def drop_all(self) -> None:
        """Free all tables; the workspace can be used again."""
        fs, path = self._at(self.root)
        fs.delete(path, True)
