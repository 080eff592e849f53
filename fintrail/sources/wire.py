"""All-string wire form of typed rows, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def encode_wire(df: DataFrame) -> DataFrame:
    """Every column as text: null is '', booleans 1/0, doubles to four places, times ISO."""
    def text(f: T.StructField) -> Column:
        c = F.col(f.name)
        if isinstance(f.dataType, T.BooleanType):
            c = F.when(c, "1").when(~c, "0")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, 4).cast("string")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, ISO)
        else:
            c = c.cast("string")
        return F.coalesce(c, F.lit("")).alias(f.name)
    return df.select(*[text(f) for f in df.schema.fields])


def decode_wire(df: DataFrame, schema: T.StructType, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows as they came).

    A row is rejected when a required column is blank or any non-blank column
    does not parse.
    """
    def parse(f: T.StructField) -> Column:
        raw = F.nullif(F.col(f.name), F.lit(""))
        if isinstance(f.dataType, T.BooleanType):
            return F.when(raw.isNotNull(), raw.isin("1", "True", "true"))
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            return raw.try_cast("timestamp_ntz")
        if isinstance(f.dataType, T.StringType):
            return raw
        return raw.try_cast(f.dataType)

    bad = F.lit(False)
    for f in schema.fields:
        if f.name in df.columns:
            blank = F.coalesce(F.col(f.name), F.lit("")) == ""
            bad = bad | (~blank & parse(f).isNull())
            if f.name in required:
                bad = bad | blank
    cols = [parse(f).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in schema.fields]
    marked = df.withColumn("_bad", bad)
    return marked.where(~F.col("_bad")).select(*cols), marked.where("_bad").drop("_bad")
