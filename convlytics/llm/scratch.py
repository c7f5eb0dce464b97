"""Intermediate tables in the shared folder of the session, and their removal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from convlytics.session import scratch_path


#: rows and bytes of an Arrow batch: whole texts are large, some very large, and each task
#: holds a batch on both sides (a longer text is a batch of its own)
BATCH_ROWS, BATCH_BYTES = 250, 16 << 20


def settle(spark: SparkSession) -> SparkSession:
    """Bound the batches that tasks exchange with Python, unless they are smaller already."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
                      ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, str(1 << 30)).lower().removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))
    return spark


class Scratch:
    """Writes intermediate tables below ``spark.checkpoint.dir``.

    A written table cuts the lineage: a lost executor never makes Spark run
    an earlier pass again.  ``drop`` removes tables no later read needs.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.n = spark, scratch_path(spark, name), 0

    def write(self, df: DataFrame) -> tuple[DataFrame, str]:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def save(self, df: DataFrame) -> DataFrame:
        return self.write(df)[0]

    def drop(self, *paths: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for p in paths:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)
