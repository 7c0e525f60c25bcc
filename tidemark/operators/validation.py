"""Rules that hold over whole tables: manifests and taxonomies, splits of environments, policy records.

Each validator gives one frame of violations, (entity, rule, detail), a row for each thing that breaks a rule; an empty one is
a table that holds. Rules over rows are expressions of one pass; rules over pairs and sets are aggregations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.schema import CIPHER_NAMES, EXCHANGES

# fixed values: versions and modes of manifests, and the suites of TLS 1.3
VERSIONS, MODES, BARE = ["TLS1.0", "TLS1.1", "TLS1.2", "TLS1.3", "none"], ["upgrade", "implicit", "cleartext"], ["1.0", "1.1", "1.2", "1.3"]
NEWEST = [0x1301, 0x1302, 0x1303]
NONE_CODES = ["", "-", "—", "none"]


def is_jitter(entry: str = "") -> Column:
    """entries that are variants of others, by a flag, their id or their environment."""
    c = lambda n: F.col(f"{entry}{n}")
    held = [c("is_jitter_augmentation"), c("flag") == "jitter", F.contains(c("family"), F.lit("jitter")), F.contains(c("environment_id"), F.lit("jitter"))]
    return F.coalesce(held[0], F.lit(False)) | F.coalesce(held[1], F.lit(False)) | F.coalesce(held[2], F.lit(False)) | F.coalesce(held[3], F.lit(False))


def broken(rows: DataFrame, entity: str, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """The rows' violations: rules by name, each a condition (null is none) and the detail."""
    told = [F.when(F.coalesce(condition, F.lit(False)), F.struct(F.lit(name).alias("rule"), detail.cast("string").alias("detail"))) for name, (condition, detail) in rules.items()]
    return rows.select(F.col(entity).alias("entity"), F.explode(F.filter(F.array(*told), lambda x: x.isNotNull())).alias("x")).select("entity", "x.*")


def repeated(rows: DataFrame, entity: str, key: list[str], rule: str) -> DataFrame:
    """A violation for each row whose key an earlier one (by entity) has, with that one as detail; a key's rows are counted before they meet."""
    first = rows.groupBy(*key).agg(F.min(entity).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    on = [F.col(f"r.{k}").eqNullSafe(F.col(f"f.{k}")) for k in key]
    met = rows.alias("r").join(first.alias("f"), on).where(F.col(f"r.{entity}") > F.col("_first"))
    return met.select(F.col(f"r.{entity}").alias("entity"), F.lit(rule).alias("rule"), F.col("_first").alias("detail"))


def sized(rows: DataFrame, expected: int | None, what: str) -> DataFrame:
    """One violation if the rows are not as many as expected."""
    n = rows.agg(F.count("*").alias("n"))
    return n.where(F.col("n") != (F.lit(expected) if expected is not None else F.col("n"))).select(F.lit(what).alias("entity"), F.lit("count").alias("rule"), F.format_string(f"%d, not {expected}", "n").alias("detail"))


def _known() -> tuple[Column, Column]:
    """The code of a suite's name, null for names that are unknown; whether it is one of TLS 1.3."""
    code = F.try_element_at(F.create_map(*[F.lit(x) for k, v in CIPHER_NAMES.items() for x in (v, k)]), F.col("cipher"))
    return code, F.coalesce(code.isin(NEWEST), F.lit(False))


def _coherence() -> dict[str, tuple[Column, Column]]:
    """Rules that hold for rows of a taxonomy and of a manifest alike."""
    c = F.col
    code, newest = _known()
    both = F.concat_ws(" ", "tls", "cipher")
    return {
        "version": (~c("tls").isin(VERSIONS), c("tls")),
        "reserved suite": (c("cipher").startswith("UNKNOWN") | F.lower(c("cipher")).rlike("^(0x)?([0-9a-f])a\\2a$"), c("cipher")),
        "version and suite": (code.isNotNull() & c("tls").isin(VERSIONS[:4]) & ((c("tls") == "TLS1.3") != newest), both),
        "exchange": (~c("kex").isin(EXCHANGES), c("kex")),
    }


TUPLE = ["tls", "cipher", "kex", "cert", "starttls", "port"]


def taxonomy(rows: DataFrame, expected: int | None = None) -> DataFrame:
    """violations of (family, tls, cipher, iana, kex, cert, starttls, port), iana being the suite's code in hexadecimal or none."""
    c = F.col
    code, _ = _known()
    told = F.when(F.lower(c("iana")).rlike("^0x[0-9a-f]{1,4}$"), F.conv(F.substring(c("iana"), 3, 4), 16, 10).cast("int"))
    bare = F.coalesce(c("iana").isin(NONE_CODES), F.lit(True))
    rules = {
        "name": (~c("family").startswith("family-"), c("family")), **_coherence(), "suite": (code.isNull() & (c("cipher") != "none"), c("cipher")),
        "code of none": ((c("cipher") == "none") & ~bare, c("iana")), "code missing": (code.isNotNull() & bare, c("cipher")), "code unreadable": (code.isNotNull() & ~bare & told.isNull(), c("iana")),
        "code of another": (code.isNotNull() & (told != code), c("iana")), "mode": (~c("starttls").isin(MODES), c("starttls")),
    }
    return broken(rows, "family", rules).unionByName(repeated(rows, "family", TUPLE, "repeated")).unionByName(sized(rows, expected, "families"))


def manifest(rows: DataFrame, expected: int | None = None) -> DataFrame:
    """violations of (family, tls, cipher, kex, cert, starttls, port, environment_id, flag, is_jitter_augmentation); variants are left out.

    A version without TLS before it is told as such, and taken as if it had it where entries are compared.
    """
    c = F.col
    proper = rows.where(~is_jitter())
    _, newest = _known()
    rules = {"not normalised": (c("tls").isin(BARE), c("tls")), **_coherence(), "exchange of TLS 1.3": (((c("tls") == "TLS1.3") | newest) & (F.coalesce(c("kex"), F.lit("unknown")) != "ECDHE"), F.concat_ws(" ", "tls", "cipher", "kex"))}
    rules["version"] = (rules["version"][0] & ~c("tls").isin(BARE), c("tls"))
    plain = proper.withColumn("tls", F.when(c("tls").isin(BARE), F.concat(F.lit("TLS"), "tls")).otherwise(c("tls")))
    return broken(proper, "family", rules).unionByName(repeated(plain, "family", TUPLE, "repeated")).unionByName(sized(proper, expected, "families")).unionByName(sized(plain.select(*TUPLE).distinct(), expected, "tuples"))


def splits(members: DataFrame, prints: DataFrame, sizes: dict[str, int], whole: str, apart: list[tuple[str, str]]) -> DataFrame:
    """violations of sets of environments, members (set_name, env), given each one's fingerprint, prints (env, print).

    Rules: each set's size; an environment stands once in a set, is of `whole` and no variant; sets of `apart` share neither
    environments nor fingerprints, as variants have names of their own and the fingerprint of another.
    """
    distinct = members.groupBy("set_name", "env").agg(F.count("*").alias("n"))
    counted = members.groupBy("set_name").agg(F.count("*").alias("n")).withColumn("wanted", F.try_element_at(F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]), F.col("set_name")))
    found = counted.where("n <> wanted").select(F.col("set_name").alias("entity"), F.lit("size").alias("rule"), F.concat_ws(", not ", "n", "wanted").alias("detail"))
    missing = [k for k in sizes if sizes[k]]
    empty = members.sparkSession.createDataFrame([(k, "size", f"0, not {sizes[k]}") for k in missing], "entity string, rule string, detail string").join(members.select(F.col("set_name").alias("entity")).distinct(), "entity", "left_anti")
    all_ = distinct.where(F.col("set_name") == whole).select("env", F.lit(True).alias("_in"))
    judged = distinct.join(all_, "env", "left")
    rules = {"repeated": (F.col("n") > 1, F.col("env")), "variant": (F.contains("env", F.lit("jitter")), F.col("env")), "unknown": (F.col("_in").isNull() & (F.col("set_name") != whole), F.col("env"))}
    found = found.unionByName(empty).unionByName(broken(judged, "set_name", rules))
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in apart])
    for rule, keyed in (("shared environment", distinct.select("set_name", F.col("env").alias("key"))), ("shared fingerprint", distinct.join(prints, "env").select("set_name", F.col("print").alias("key")).distinct())):
        # a key's sets are a few names at most
        sets = keyed.groupBy("key").agg(F.collect_set("set_name").alias("sets"))
        shared = sets.select("key", F.explode(F.filter(pairs, lambda p: F.array_contains("sets", p["a"]) & F.array_contains("sets", p["b"]))).alias("p"))
        found = found.unionByName(shared.select(F.concat_ws(" and ", "p.a", "p.b").alias("entity"), F.lit(rule).alias("rule"), F.col("key").cast("string").alias("detail")))
    return found


POLICY = "version string, mode string, mx array<string>, max_age int, id string"
RECORD = "usage int, selector int, matching_type int, cert_data string"


def policies(text: DataFrame) -> DataFrame:
    """(host, mode, max_age) of policy documents (text): a row for each host of a policy that can be read; without version STSv1 it is none."""
    parsed = text.select(F.from_json("text", POLICY, {"mode": "PERMISSIVE"}).alias("p")).where("p.version = 'STSv1'")
    return parsed.select(F.explode("p.mx").alias("host"), F.col("p.mode").alias("mode"), F.col("p.max_age").alias("max_age"))


def associations(text: DataFrame) -> DataFrame:
    """(host, port, usage, selector, matching_type, holds) of documents (text) that are maps of _port._tcp.host to a record.

    holds: the values are of their ranges and the data hexadecimal, and of a hash's length where it is one.  Other keys are left out.
    """
    entries = text.select(F.explode(F.from_json("text", f"map<string, struct<{RECORD}>>")).alias("key", "r")).where(F.col("key").rlike("^_[0-9]+[.]_tcp[.].+"))
    data = F.col("r.cert_data")
    size = F.when(F.col("r.matching_type") == 1, F.length(data) == 64).when(F.col("r.matching_type") == 2, F.length(data) == 128).otherwise(F.length(data) > 0)
    holds = F.coalesce(F.col("r.usage").between(0, 3) & F.col("r.selector").between(0, 1) & F.col("r.matching_type").between(0, 2) & data.rlike("^([0-9A-Fa-f]{2})+$") & size, F.lit(False))
    return entries.select(F.regexp_extract("key", "^_[0-9]+[.]_tcp[.](.+)$", 1).alias("host"), F.regexp_extract("key", "^_([0-9]+)", 1).cast("int").alias("port"), "r.usage", "r.selector", "r.matching_type", holds.alias("holds"))


def policy_evidence(hosts: DataFrame, policies_: DataFrame, associations_: DataFrame) -> DataFrame:
    """Hosts (host) with mode (none without a policy, whose hosts may be *.domain), dane (any record that holds) and evidence."""
    exact = policies_.groupBy("host").agg(F.max_by("mode", "max_age").alias("mode"))
    wild = exact.where(F.startswith("host", F.lit("*."))).select(F.substring("host", 3, 1 << 20).alias("domain"), F.col("mode").alias("wild"))
    known = associations_.where("holds").select("host").distinct().withColumn("dane", F.lit(True))
    met = hosts.withColumn("domain", F.regexp_replace("host", r"^[^.]*\.", "")).join(exact, "host", "left").join(wild, "domain", "left").join(known, "host", "left").drop("domain")
    mode, dane = F.coalesce("mode", "wild", F.lit("none")), F.coalesce("dane", F.lit(False))
    return met.select(*hosts.columns, mode.alias("mode"), dane.alias("dane"), F.concat(F.lit("MTA-STS "), mode, F.lit(", DANE "), F.when(dane, "present").otherwise("absent")).alias("evidence"))
