"""Readers of raw sources and stored features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from fintrail.schemas import RAW


def read_source(spark: SparkSession, path: str, source: str, schema: T.StructType | None = None) -> DataFrame:
    """All chunks of one source. Columns a chunk lacks read as null."""
    return spark.read.schema(schema or RAW[source]).parquet(f"{path}/{source}_chunk_*.parquet")


def read_features(spark: SparkSession, path: str, schema: T.StructType | None = None, run_date: str | None = None) -> DataFrame:
    """The feature store, one run or every run, with missing numbers as 0.

    With a schema no file footer is opened while planning; a run date prunes the scan to its folder.
    """
    r = spark.read.schema(schema) if schema else spark.read.option("mergeSchema", "true")
    df = r.parquet(path)
    if run_date is not None:
        df = df.where(F.col("run_date") == F.lit(run_date))
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    return df.fillna(0, subset=numeric)


def recent_transactions(ev: DataFrame, ids: list | DataFrame, n: int, key: str = "user_id") -> DataFrame:
    """Newest n rows of the wanted ids; a list prunes at the scan, a table through a semi-join."""
    hit = ev.where(F.col(key).isin(ids)) if isinstance(ids, list) else ev.join(ids.select(key), key, "left_semi")
    return hit.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def flag(c: Column) -> Column:
    return c.isin("1", "True", "true")
