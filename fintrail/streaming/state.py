"""State of keys between micro-batches, as a table that a batch reads and rewrites only where it has rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BUCKETS = 64


class KeyedTable:
    """Rows of state by key, cut into `buckets` by a hash of the key.

    Batch n writes the buckets of its keys to `version=n`, and then one small list that says which version of each
    bucket holds after it. Until that list is there, readers see the state before the batch; a batch that is run again
    reads what earlier batches left and replaces its own version. The state of a key is bounded by what the caller
    keeps of it, so a batch reads state in proportion to the buckets that it touches, never history.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "user_id", buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _held(self, batch_id: int) -> dict[int, int]:
        """Bucket to version, as the batches before this one left it; at most `buckets` rows."""
        lists = f"{self.path}/lists"
        if not self._exists(lists):
            return {}
        rows = self.spark.read.schema("bucket int, version long, batch_id long").parquet(lists).where(F.col("batch_id") < batch_id)
        last = rows.agg(F.max("batch_id")).first()[0]
        return {} if last is None else {r["bucket"]: r["version"] for r in rows.where(F.col("batch_id") == last).collect()}

    def touched(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())

    def read(self, batch_id: int, buckets: list[int], schema: str) -> DataFrame:
        """All rows of these buckets before the batch."""
        held = self._held(batch_id)
        paths = [f"{self.path}/version={held[b]}/bucket={b}" for b in buckets if b in held]
        paths = [p for p in paths if self._exists(p)]          # a bucket whose keys have all expired has no files
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def write(self, batch_id: int, buckets: list[int], rows: DataFrame) -> None:
        """Replaces these buckets by `rows`, which hold no other keys."""
        held = self._held(batch_id) | {b: batch_id for b in buckets}
        # each bucket is one task's work; state of a bucket is bounded by its keys
        (rows.withColumn("bucket", self.bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket")
         .parquet(f"{self.path}/version={batch_id}"))
        listed = self.spark.createDataFrame(sorted(held.items()), "bucket int, version long")
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/lists/batch_id={batch_id}")
        self._drop_old(batch_id, set(held.values()))

    def _drop_old(self, batch_id: int, live: set[int]) -> None:
        """Removes versions that neither this batch nor a repetition of it can read."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        live |= set(self._held(batch_id).values())
        for s in fs.listStatus(p):
            name = s.getPath().getName()
            if name.startswith("version=") and int(name[8:]) < batch_id and int(name[8:]) not in live:
                fs.delete(s.getPath(), True)


def replaced(old: DataFrame, new: DataFrame, key: str = "user_id") -> DataFrame:
    """`new`, and the rows of the keys that it does not have."""
    keys = new.select(F.col(key).alias("_k")).distinct()
    return old.join(keys, F.col(key).eqNullSafe(F.col("_k")), "left_anti").unionByName(new)
