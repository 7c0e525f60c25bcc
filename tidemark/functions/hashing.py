"""Deterministic identifiers and buckets from SHA-256."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_id(content: Column) -> Column:
    """Eight hex digits."""
    return F.substring(F.sha2(content, 256), 1, 8)


def seed32(text: Column) -> Column:
    """The first 32 bits as a number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")


def bucket(text: Column, buckets: int) -> Column:
    """X25."""
    return seed32(text) % buckets


def modulo(text: Column, modulus: int) -> Column:
    """All 256 bits modulo a small number, 32 bits at a time."""
    digest = F.sha2(text, 256)
    step = lambda a, i: (a * F.lit(1 << 32) + F.conv(digest.substr(i, F.lit(8)), 16, 10).cast("bigint")) % modulus
    return F.aggregate(F.sequence(F.lit(1), F.lit(57), F.lit(8)), F.lit(0).cast("bigint"), step)


def composite(*parts: Column) -> Column:
    """The parts joined by bars; null is empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def uniform(*parts: Column) -> Column:
    """In [0, 1): the draws of all samplers."""
    return seed32(F.concat_ws("|", *[p.cast("string") for p in parts])) / F.lit(float(1 << 32))
