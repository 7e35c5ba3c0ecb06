"""Reading the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def once(df: DataFrame, *keys: str) -> DataFrame:
    """Re-delivered rows repeat a key with the same content and count once; hash aggregation, map-side combined."""
    return df.dropDuplicates(list(keys))


def expect_schema(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """``df`` if it has the expected columns with these types, whatever others; else an error that names what differs."""
    found = dict(df.dtypes)
    wrong = {name: (kind, found.get(name)) for name, kind in expected.items() if found.get(name) != kind}
    if wrong:
        raise ValueError(f"columns expected and found: {wrong}")
    return df
