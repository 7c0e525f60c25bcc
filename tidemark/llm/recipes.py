"""Exact duplicates by recipes of content-defined chunks (DataFrame functions only).

A text without white space is cut where its own bytes say so, so that equal stretches give equal chunks wherever they stand.
All chunks of all documents are made distinct in one shuffle, combined before it, so a stretch that many documents share
leaves each task once.  A chunk's identifier is a hash of 64 bits that is verified: if two distinct chunks, compared byte
by byte, have the same one, all identifiers are drawn anew with another seed.  So identifiers are equal if and only if chunks
are.  A document is then its recipe, the ordered list of its chunks' identifiers, and from there on only recipes are compared
and moved: texts cross the network once, and are never written.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._arrow import keep, prepare

#: White space that does not count, by code points.
WHITE = [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]
#: Bytes of a chunk at least (but for a text's last) and at most; a cut comes after three bytes in a row of these classes.
LEAST, MOST = 256, 8192
SEEDS = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)
#: A group of more than HEAVY rows and of more than a 1/HEAVY of all rows is dealt to HEAVY tasks; there are fewer than HEAVY such groups.
HEAVY = 512


def cut_class(seed: int) -> str:
    """A character class of about an eighth of all bytes."""
    return "[" + "".join(f"\\x{b:02x}" for b in range(256) if (b * seed & 0xFFFFFFFF) >> 29 == 0) + "]"


CHUNK = "(?s).{%d,%d}?%s|.{1,%d}" % (LEAST - 3, MOST - 3, "".join(map(cut_class, SEEDS)), MOST)


def normalised(text: Column) -> Column:
    """The text without white space; null is the empty text."""
    text = F.coalesce(text, F.lit(""))
    for c in WHITE:
        text = F.replace(text, F.lit(chr(c)), F.lit(""))
    return text


def chunked(text: Column) -> Column:
    """The chunks of a text in order, each byte a character; the same for any script, and linear in the text's length."""
    return F.regexp_extract_all(F.decode(text.cast("binary"), "ISO-8859-1"), F.lit(CHUNK), F.lit(0))


def joined(chunks: Column) -> Column:
    """The normalised text of an array of chunks."""
    return F.decode(F.encode(F.array_join(chunks, ""), "ISO-8859-1"), "UTF-8")


def identifier(chunk: Column, seed: int, bits: int = 64) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), chunk), 64 - bits) if bits < 64 else F.xxhash64(F.lit(seed), chunk)


def chunk_rows(docs: DataFrame, seed: int, bits: int = 64) -> DataFrame:
    """(id, chunk, doc) of the distinct chunks, doc being null, and of each document, id and chunk being null.

    doc: uid, doc_id, n (code points of the whole text), text_sha256 (of the normalised one) and recipe.
    """
    texts = docs.select("doc_id", F.monotonically_increasing_id().alias("uid"), F.length(F.coalesce("text", F.lit(""))).alias("n"), normalised(F.col("text")).alias("text"))
    cut = texts.select("doc_id", "uid", "n", F.sha2("text", 256).alias("text_sha256"), chunked(F.col("text")).alias("chunks"))
    named = cut.select("*", F.transform("chunks", lambda c: F.struct(identifier(c, seed, bits).alias("id"), c.alias("chunk"))).alias("named"))
    doc = F.struct("uid", "doc_id", "n", "text_sha256", F.col("named.id").alias("recipe"))
    kind = named.select(doc.alias("doc")).schema["doc"].dataType
    chunk = F.transform("named", lambda x: F.struct(x["id"].alias("id"), x["chunk"].alias("chunk"), F.lit(None).cast(kind).alias("doc")))
    own = F.array(F.struct(F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("string").alias("chunk"), doc.alias("doc")))
    return named.select(F.explode(F.concat(chunk, own)).alias("x")).select("x.*").distinct()


def recipes(docs: DataFrame, bits: int = 64) -> DataFrame:
    """uid, doc_id, n, text_sha256 and recipe of each document, by identifiers that no two distinct chunks share.

    bits: how many bits the identifiers of the first draw have; tests take few, so that draws are repeated.
    """
    prepare(docs.sparkSession)
    for seed in itertools.count():
        rows = keep(chunk_rows(docs, seed, 64 if seed else bits).select("id", "doc"))
        chunks = rows.where("doc is null").groupBy("id").agg(F.count("*").alias("n"))
        if chunks.where("n > 1").isEmpty():
            return rows.where("doc is not null").select("doc.*")


def groups(docs: DataFrame, bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of docs (doc_id, text).

    Texts are equal if they are without white space; null is the empty text, and so is white space alone.  Of equal texts the
    row with the most code points stays, then that of the smallest doc_id (a null one comes last), then one of the repeated rows.
    Every row, repeated ones too, gives one row.  Other columns are ignored; an empty frame gives an empty frame.
    """
    found = recipes(docs, bits)
    order = F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("unknown"), "doc_id", "uid")
    sums = keep(found.groupBy("recipe").agg(F.count("*").alias("group_size"), F.min(order).alias("first")).withColumn("hash", F.xxhash64("recipe")))
    rows = sums.agg(F.sum("group_size").alias("rows"))
    heavy = F.broadcast(sums.join(F.broadcast(rows), (F.col("group_size") > HEAVY) & (F.col("group_size") * HEAVY > F.col("rows"))).select("hash").distinct().withColumn("heavy", F.lit(True)))
    # a heavy group's rows are dealt by uid, and each of their tasks gets the group's sums
    dealt = found.withColumn("hash", F.xxhash64("recipe")).join(heavy, "hash", "left").withColumn("deal", F.when(F.col("heavy"), F.pmod(F.xxhash64("uid"), F.lit(HEAVY))).otherwise(F.lit(0)))
    shares = sums.join(heavy, "hash", "left").withColumn("deal", F.explode(F.sequence(F.lit(0), F.when(F.col("heavy"), HEAVY - 1).otherwise(0)).cast("array<bigint>")))
    met = dealt.join(shares.select("recipe", "deal", "group_size", "first"), ["recipe", "deal"])
    return met.select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("first.uid")).alias("kept"), "text_sha256")
