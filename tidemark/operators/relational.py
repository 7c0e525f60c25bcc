"""Filters, order specifications, pages and joins of the query surface (F, O, J, U)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.shared import shared_dir


def all_of(*conditions: Column | None) -> Column:
    """the conditions that are given, together; none given lets every row by."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def equals(column: str, value: str | None) -> Column | None:
    """A filter by value; blank values and 'All' are no filter."""
    value = value.strip() if isinstance(value, str) else value
    return None if value in (None, "", "All") else F.col(column) == value


def contains_any(columns: list[str], text: str | None) -> Column | None:
    """a substring of any of the columns, whatever the case; its characters stand for themselves."""
    if not text or not text.strip():
        return None
    wanted = F.lit(text.strip().lower())
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(c), wanted), F.lit(False)) for c in columns])


def one_of(column: str, values: list[str], known: list[str]) -> Column:
    """a filter by values of a closed set; others are ignored, and with none left every row stays."""
    wanted = [v for v in values if v in known]
    return F.col(column).isin(wanted) if wanted else F.lit(True)


def numeric_suffix(column: str, prefix: str) -> Column:
    """The number after the prefix, 999999 for other names."""
    return F.when(F.col(column).rlike(f"^{prefix}[0-9]+$"), F.substring(F.col(column), len(prefix) + 1, 18).cast("bigint")).otherwise(999999)


def order_spec(order: str | None, known: dict[str, str], tie: list[Column], default: list[Column]) -> list[Column]:
    """O01: 'name' or 'name_desc' by whitelist; nulls go last; ties go by `tie`."""
    name, down = (order or "").removesuffix("_desc"), (order or "").endswith("_desc")
    if name not in known:
        return default
    c = F.col(known[name])
    return [c.desc_nulls_last() if down else c.asc_nulls_last(), *tie]


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0, most: int = 1000) -> DataFrame:
    """Limit within 0 and `most`, offset 0 or more."""
    return df.orderBy(*order).offset(max(0, offset)).limit(max(0, min(limit, most)))


def placed(df: DataFrame, order: list[Column]) -> DataFrame:
    """The rows with `place`, their number from 1 in the order, which should be total.

    A sort by ranges puts rows in partitions that follow one another; places are those in a partition and the rows of the
    partitions before it, of which there are as many as partitions.  The sorted rows are written once, so that both agree.
    """
    shared_dir(df.sparkSession)
    at = df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    numbered = at.withColumns({"_part": F.shiftrightunsigned("_at", 33), "_at": F.col("_at").bitwiseAND((1 << 33) - 1)})
    counts = numbered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return numbered.join(F.broadcast(before), "_part").withColumn("place", F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def clamped_page(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """The page's rows; a page beyond the last is the last, one before the first is the first."""
    pages = max(1, -(-df.count() // size))
    return df.orderBy(*order).offset((min(max(page, 1), pages) - 1) * size).limit(size)


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def banded(points: DataFrame, x: str, bands: DataFrame, low: str, high: str, width: float) -> DataFrame:
    """A range join by blocks of `width`: rows of points with low <= x < high; long bands are in several blocks."""
    b = bands.withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return points.withColumn("_b", F.floor(F.col(x) / width)).join(b, "_b").where((F.col(x) >= F.col(low)) & (F.col(x) < F.col(high))).drop("_b")
