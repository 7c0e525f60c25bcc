"""Text sources: pipe tables, manifests, grade sheets, document fixtures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark import schema


def pipe_table(lines: DataFrame, first: str, least: int, most: int = 50) -> DataFrame:
    """(nr, cells) of the rows of the table whose header begins with `first`, from (file, nr, line).

    Rows follow the header's rule line up to the first line that is none of the table; shorter rows are left out.
    """
    from pyspark.sql import Window

    trimmed = F.trim("line")
    cells = F.transform(F.slice(F.split(trimmed, r"\|"), 2, F.greatest(F.size(F.split(trimmed, r"\|")) - 2, F.lit(0))), lambda x: F.trim(x))
    marked = lines.withColumns({"in_table": trimmed.startswith("|"), "cells": cells})
    start = marked.where(F.col("in_table") & (F.try_element_at("cells", F.lit(1)) == first)).groupBy("file").agg(F.min("nr").alias("header"))
    after = marked.join(start, "file").where(F.col("nr") > F.col("header"))
    stop = after.where("not in_table").groupBy("file").agg(F.min("nr").alias("stop"))
    body = after.join(stop, "file", "left").where(F.col("in_table") & (F.col("stop").isNull() | (F.col("nr") < F.col("stop"))) & ~F.trim("line").rlike(r"^\|[\s:|-]+$") & (F.size("cells") >= least))
    return body.withColumn("_r", F.row_number().over(Window.partitionBy("file").orderBy("nr"))).where(F.col("_r") <= most).select("file", "nr", "cells")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, nr, line) of text files; each file is read whole."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("nr", "line"))


def manifest(text: DataFrame, value: str) -> DataFrame:
    """(family, entry) of JSON maps in the column `text`; `value` is the entries' schema."""
    return text.select(F.explode(F.from_json("text", f"map<string,{value}>")).alias("family", "entry"))


def documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(verdicts that hold, documents that don't with the reason): keys, types, vocabularies, ranges, opaque certificates."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    parsed = raw.withColumn("d", F.from_json("text", schema.VERDICT, {"mode": "PERMISSIVE"})).select("file", "text", "d.*")
    reason = F.coalesce(strange_keys(F.col("text")), violation())
    judged = parsed.withColumn("reason", F.when(F.col("flow_id").isNull(), "no document").otherwise(reason))
    return judged.where("reason is null").drop("text", "reason"), judged.where("reason is not null").select("file", "text", "reason")


def strange_keys(text: Column) -> Column:
    """the first keys of a document, or of one of its objects, that the schema doesn't have, or null."""
    kind = StructType.fromDDL(schema.VERDICT)
    parts = [("$", kind), *[(f"$.{f.name}", f.dataType) for f in kind if isinstance(f.dataType, StructType)]]
    told = [F.array_except(F.json_object_keys(F.get_json_object(text, path)), F.array(*map(F.lit, part.names))) for path, part in parts]
    return F.coalesce(*[F.when(F.size(k) > 0, F.concat(F.lit("unknown key "), k[0])) for k in told])


def violation():
    """The first rule of the closed schema that a verdict breaks, or null."""
    c = F.col
    closed = {"app_protocol": schema.PROTOCOLS, "starttls_mode": schema.MODES, "tls.version": schema.VERSIONS, "tls.cipher_strength": schema.STRENGTHS, "tls.kex": schema.EXCHANGES, "assessment.risk_level": schema.LEVELS}
    ranges = {"coverage_ratio": (0, 1), "tls.ja4_rarity": (0, 1), "assessment.risk_score": (0, 100), "assessment.posture_score": (0, 100), "assessment.calibrated_prob": (0, 1)}
    found = F.when(F.lit(False), "")
    for name, values in closed.items():
        found = found.when(~c(name).isin(values), f"{name} outside vocabulary")
    for name, (low, high) in ranges.items():
        found = found.when(~c(name).between(low, high), f"{name} outside range")
    detail = ["not_before", "not_after", "days_to_expiry", "is_expired", "is_self_signed", "chain_length", "chain_valid", "san_match", "pubkey_algo", "pubkey_bits", "sigalg", "sigalg_weak", "keysize_weak", "ocsp_must_staple", "crl_unknown_reason"]
    told = F.coalesce(*[c(f"cert.{d}").cast("string") for d in detail]).isNotNull() | c("cert.leaf_present")
    return found.when(c("cert.is_tls13_opaque") & told, "opaque certificate with details")


def csv_rows(spark: SparkSession, path: str, schema) -> DataFrame:
    """A CSV file with a header line; columns are taken by the schema."""
    return spark.read.csv(path, schema=schema, header=True)


def documents_of(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """Adds `doc` from JSON text; text that is a JSON string of a document is read once more, what is malformed goes."""
    once = F.when(F.startswith(F.col(column), F.lit('"')), F.get_json_object(F.concat(F.lit('{"x":'), F.col(column), F.lit("}")), "$.x")).otherwise(F.col(column))
    parsed = rows.withColumn("doc", F.from_json(once, f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return parsed.where("doc is not null and doc._bad is null").withColumn("doc", F.col("doc").dropFields("_bad"))


def ingested(spark: SparkSession, path: str, first: dict[str, int], other: int = 5) -> DataFrame:
    """(file, nr, doc) of JSON files: an object is one document, a list its first few: as many as `first` says for the
    pattern that the file's path matches, else `other`.  Files that are no JSON give nothing."""
    raw = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.input_file_name().alias("file"), F.trim("value").alias("value"))
    most = F.lit(other)
    for pattern, n in reversed(first.items()):
        most = F.when(F.col("file").rlike(pattern), n).otherwise(most)
    listed = F.when(F.startswith("value", F.lit("[")), F.from_json("value", "array<string>")).otherwise(F.when(F.get_json_object("value", "$").isNotNull(), F.array("value")))
    return raw.select("file", F.posexplode(F.slice(listed, 1, most)).alias("nr", "doc"))


def discovered(spark: SparkSession, path: str, folders: list[str], without: str = "jitter") -> DataFrame:
    """(stem, folder, path, place) of the capture files below `folders`: of those of one stem the one of the first folder, without
    names that contain `without`; place: by the number at the stem's end, those without one last, then by name.  File contents are not read.
    """
    from pyspark.sql import Window

    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    named = found.select("path", F.regexp_extract("path", r"/([^/]+)/([^/]+)\.(pcap|pcapng|cap)$", 1).alias("folder"), F.regexp_extract("path", r"/([^/]+)\.(pcap|pcapng|cap)$", 1).alias("stem"))
    rank = F.array_position(F.array(*map(F.lit, folders)), F.col("folder"))
    kept_ = named.where((F.col("stem") != "") & (rank > 0) & ~F.contains("stem", F.lit(without)))
    first = kept_.groupBy("stem").agg(F.min_by(F.struct("folder", "path"), F.struct(rank, "path")).alias("x")).select("stem", "x.*")
    number = F.regexp_extract("stem", "([0-9]+)$", 1).try_cast("bigint")
    # a row for each file, of which a directory listing is one anyway
    return first.withColumn("place", F.row_number().over(Window.orderBy(number.asc_nulls_last(), "stem")))
