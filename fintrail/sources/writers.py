"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T


def compact_types(fv: DataFrame) -> DataFrame:
    """Doubles as floats and booleans as ints, the storage types of the feature store."""
    kind = {T.DoubleType: "float", T.BooleanType: "int"}
    return fv.select(*[F.col(f.name).cast(kind[type(f.dataType)]) if type(f.dataType) in kind else F.col(f.name)
                       for f in fv.schema.fields])


def write_features(fv: DataFrame, path: str, run_date: str, files: int | None = None) -> None:
    """Appends one run, partitioned by run date and clustered by user inside it.

    A directory per user would leave millions of tiny files; users are hashed to
    files and sorted, so a user's rows are one row-group range.
    """
    out = compact_types(fv).withColumn("run_date", F.lit(run_date))
    out = out.repartition(files, "user_id") if files else out.repartition("user_id")
    out.sortWithinPartitions("user_id").write.partitionBy("run_date").mode("append").parquet(path)


def write_cohorts(cohorts: DataFrame, path: str) -> None:
    cohorts.write.mode("overwrite").parquet(path)


def write_by_source(ev: DataFrame, path: str) -> None:
    """One directory per source."""
    ev.write.partitionBy("source_provenance").mode("append").parquet(path)
