"""Current state and versioned history of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.schema import SOURCES


def source_of(raw: Column) -> Column:
    """Trimmed and lower-cased; anything unknown is synthetic."""
    clean = F.lower(F.trim(raw))
    return F.when(clean.isin(SOURCES), clean).otherwise("synthetic")


def history(updates: DataFrame, key: list[str], order: list[str], base: DataFrame | None = None) -> DataFrame:
    """A version for every update, going on from the highest of `base` (key, version)."""
    numbered = updates.withColumn("version", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    if base is None:
        return numbered
    highest = base.groupBy(*key).agg(F.max("version").alias("highest"))
    return numbered.join(highest, key, "left").withColumn("version", F.col("version") + F.coalesce("highest", F.lit(0))).drop("highest")


def latest(updates: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last update of each key; max_by aggregates before the shuffle, so hot keys are no hot tasks."""
    rest = [c for c in updates.columns if c not in key]
    best = updates.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return best.select(*key, "row.*")


def upsert(current: DataFrame, updates: DataFrame, key: list[str], values: list[str], stamp: str) -> DataFrame:
    """The current table after the updates (one for each key); `stamp` stays where no value differs."""
    c, u = current.alias("c"), updates.alias("u")
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"c.{v}").eqNullSafe(F.col(f"u.{v}"))
    on = [F.col(f"c.{k}") == F.col(f"u.{k}") for k in key]
    there, new = F.col(f"c.{key[0]}").isNotNull(), F.col(f"u.{key[0]}").isNotNull()
    pick = lambda x: F.when(new, F.col(f"u.{x}")).otherwise(F.col(f"c.{x}"))
    kept = there & (~new | same)
    return c.join(u, on, "full").select(*[F.coalesce(f"c.{k}", f"u.{k}").alias(k) for k in key], *[pick(v).alias(v) for v in values], F.when(kept, F.col(f"c.{stamp}")).otherwise(F.col(f"u.{stamp}")).alias(stamp), F.when(~there, "inserted").when(kept, "unchanged").otherwise("updated").alias("outcome"))


def known_or_null(rows: DataFrame, column: str, dimension: DataFrame, key: str) -> DataFrame:
    """A foreign key that the dimension lacks becomes null."""
    d = dimension.select(F.col(key).alias("_known")).distinct()
    return rows.join(d, F.col(column) == F.col("_known"), "left").withColumn(column, F.col("_known")).drop("_known")


def insert_new(current: DataFrame, updates: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """What is there stays; of new rows of one key the first is taken."""
    rest = [c for c in updates.columns if c not in key]
    first = updates.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row")).select(*key, "row.*").select(*updates.columns)
    return current.select(*updates.columns).union(first.join(current.select(*key), key, "left_anti").select(*updates.columns))


def replace_table(df: DataFrame, path: str) -> None:
    """The whole table in one write, whose files appear when all of it is done."""
    df.write.mode("overwrite").parquet(path)


def keep_existing(old: Column, new: Column) -> Column:
    """Both maps' entries; where both have a key the old one stays."""
    return F.map_concat(old, F.map_filter(new, lambda k, v: ~F.map_contains_key(old, k)))


def keep_existing_deep(old: Column, new: Column) -> Column:
    """The same over two levels: where both have a key, its maps are merged likewise."""
    return F.map_zip_with(old, new, lambda _, a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(keep_existing(a, b)))


def byte_range(header: Column, size: Column) -> Column:
    """struct(first, last) of a header `bytes=a-b`, `bytes=a-` or `bytes=-n` over so many bytes, the end clamped.

    Null where the header is none of these, names several ranges, or asks for nothing that is there.
    """
    part = lambda k: F.nullif(F.regexp_extract(header, "^bytes=([0-9]*)-([0-9]*)$", k), F.lit("")).try_cast("bigint")
    first, last = part(1), part(2)
    begin = F.coalesce(first, F.greatest(size - last, F.lit(0)))
    end = F.when(first.isNull(), size - 1).otherwise(F.least(F.coalesce(last, size - 1), size - 1))
    asked = first.isNotNull() | (last > 0)
    return F.when(asked & (begin <= end), F.struct(begin.alias("first"), end.alias("last")))


def sliced(body: Column, span: Column) -> Column:
    """The bytes of a binary column in a range of `byte_range`."""
    return F.substring(body, (span["first"] + 1).cast("int"), (span["last"] - span["first"] + 1).cast("int"))


def sorted_json(fields: dict[str, Column]) -> Column:
    """A document whose keys are in order."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def _finite(c: Column, kind) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_finite(c.getField(f.name), f.dataType).alias(f.name) for f in kind]))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _finite(x, kind.elementType))
    return F.transform_values(c, lambda _, v: _finite(v, kind.valueType)) if isinstance(kind, T.MapType) else c


def finite(df: DataFrame) -> DataFrame:
    """NaN and infinities are null, in columns and in whatever they hold."""
    return df.select(*[_finite(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])
