"""Tables kept as changes: a batch appends the rows that it changes, and of the rows of a key that of the latest batch counts.

Rows lie in plain Parquet folders by batch and by a hash of their key. A batch looks up earlier rows in the folders of its own keys only, and
writes nothing but its changes, so its writes follow the batch and not the table. A batch reads the rows *before* itself, which a
replay therefore finds as they were, and overwrites its own folder: a crash at any point, also between the writes of two tables,
is mended by running the batch again. ``rewritten`` folds the history of a long-lived table into a new one of a single batch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


class ChangeTable:
    """Rows of ``schema`` (a DDL string) below ``path``, at most one per key and batch."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets
        self.schema = schema
        self.columns = spark.createDataFrame([], schema).columns

    def _bucket(self) -> Column:
        """A null in a key counts as a value of its own."""
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _exists(self, path: str) -> bool:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)

    def done(self, batch_id: int) -> bool:
        return self._exists(f"{self.path}/batch={batch_id}/_SUCCESS")

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """The changes of a batch; a batch that is run again replaces its own. Rows of a folder are written by one task, or, where
        AQE finds it too large, by several."""
        placed = rows.select(*self.columns, self._bucket().alias("bucket")).hint("rebalance", "bucket")
        placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/batch={batch_id}")

    def history(self, before: int | None = None) -> DataFrame:
        """All rows with their ``batch`` and ``bucket``; later batches are never opened."""
        full = f"{self.schema}, batch bigint, bucket int"
        if not self._exists(self.path):
            return self.spark.createDataFrame([], full)
        rows = self.spark.read.schema(full).option("basePath", self.path).parquet(self.path)
        return rows if before is None else rows.filter(F.col("batch") < before)

    def rows(self, before: int | None = None, of: DataFrame | None = None) -> DataFrame:
        """The latest row of each key; with ``of``, only of the keys in it, read from their folders alone (at most ``buckets``
        numbers come to the driver)."""
        found = self.history(before)
        if of is not None:
            wanted = of.select(*self.keys).distinct()
            touched = [r["b"] for r in wanted.select(self._bucket().alias("b")).distinct().collect()]
            same = F.lit(True)
            for k in self.keys:
                same = same & found[k].eqNullSafe(wanted[k])
            found = found.filter(F.col("bucket").isin(touched)).join(wanted, same, "left_semi")
        rest = [c for c in self.columns if c not in self.keys]
        newest = found.groupBy(*self.keys).agg(F.max_by(F.struct(F.lit(0).alias("_"), *rest), "batch").alias("row"))
        return newest.select(*[F.col(c) if c in self.keys else F.col(f"row.{c}") for c in self.columns])

    def rewritten(self, path: str, batch_id: int) -> ChangeTable:
        """A new table of the rows up to and with a batch, as that batch."""
        made = ChangeTable(self.spark, path, self.schema, self.keys, self.buckets)
        made.write(self.rows(before=batch_id + 1), batch_id)
        return made
