"""Rules that depend on order, over a total order always: which of equal rows stays, and values that carry on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, keys: list[str], *order: str | Column, stays: Column | None = None) -> DataFrame:
    """Of rows equal in the keys the first by the order; dropDuplicates() would keep any. stays: rows that no other stands for."""
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    first = F.col("__nth") == 1
    return rows.withColumn("__nth", nth).where(first if stays is None else first | stays).drop("__nth")


def carried(value: str, keys: list[str], *order: str | Column) -> Column:
    """The last value that isn't null, up to and with the row."""
    return F.last(value, ignorenulls=True).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))


def placed_anew(rows: DataFrame, key: str = "document_id") -> DataFrame:
    """rows with a text key that Spark does not know to be dealt by.

    Spark 4.1 takes a union of parts that are all dealt by a key to be dealt by it as well, and then fails to line up the parts' partitions
    with another side's where their numbers differ. A part of a union goes through here.
    """
    return rows.withColumn(key, F.concat(key, F.lit("")))
