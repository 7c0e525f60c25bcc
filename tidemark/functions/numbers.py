"""Small numeric functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.tls import lookup
from tidemark.schema import CATEGORY_CODES, LEVEL_FROM, PROBABILITY_FROM


def level_from(value: Column, table: dict = LEVEL_FROM) -> Column:
    """The first level whose lower bound is reached."""
    names = list(table)
    found = F.when(value >= table[names[0]], names[0])
    for n in names[1:]:
        found = found.when(value >= table[n], n)
    return found.otherwise("Low")


def probability_level(p: Column, table: dict = PROBABILITY_FROM) -> Column:
    return level_from(p, table)


def category_code(name: str, value: Column) -> Column:
    """A table's code, a hash below 32 for other values, -1 for null."""
    hashed = (F.conv(F.substring(F.sha2(value, 256), 1, 8), 16, 10).cast("bigint") % 32).cast("int")
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in CATEGORY_CODES[name].items() for x in kv]), value)
    return F.when(value.isNull(), -1).otherwise(F.coalesce(known, hashed))


def entropy(p: Column) -> Column:
    """Of a Bernoulli variable, with p kept off 0 and 1."""
    q = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))
    return -q * F.log(q) - (1 - q) * F.log(1 - q)


def wilson(p: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper end."""
    d = 1 + z * z / n
    middle, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.greatest(F.lit(0.0), middle - half), F.least(F.lit(1.0), middle + half)


def prior_corrected(p: Column, old: float, new: float) -> Column:
    """A probability under another prior, in logits, kept within .01 and .99."""
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    import math

    shift = math.log(new / (1 - new)) - math.log(old / (1 - old))
    return F.greatest(F.lit(0.01), F.least(F.lit(0.99), 1 / (1 + F.exp(-(F.log(q / (1 - q)) + shift)))))


def hybrid_anomaly(ecod: Column, forest: Column, rarity: Column) -> Column:
    """X60."""
    return 0.5 * F.tanh((ecod - 5) / 3) + 0.3 * F.tanh(forest) + 0.2 * F.tanh(2 * (rarity - 0.5))


def gain(grade: Column) -> Column:
    """X63."""
    return F.pow(F.lit(2.0), grade) - 1


__all__ = ["category_code", "entropy", "gain", "hybrid_anomaly", "level_from", "lookup", "prior_corrected", "probability_level", "wilson"]
