"""What names, banners and certificates tell, and postures by deduction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.tls import host_matches, lookup

# fixed values: well-known ports of mail protocols, greetings in the order in which they count, deductions from a posture
PORTS = {25: "smtp", 587: "smtp", 465: "smtp", 993: "imap", 143: "imap", 995: "pop3", 110: "pop3"}
GREETINGS = ["220", "* OK", "+OK"]
MODES = ["implicit", "stripped"]


def banner(line: Column) -> Column:
    """The greeting that a line holds, null for none."""
    return F.coalesce(*[F.when(F.contains(line, F.lit(g)), g) for g in GREETINGS])


def upgrade_keyword(line: Column) -> Column:
    """X19."""
    return F.contains(line, F.lit("STARTTLS")) | F.contains(line, F.lit("STLS"))


def protocol_of_port(port: Column) -> Column:
    """Null for other ports."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in PORTS.items() for x in kv]), port)


def mode_in(name: Column) -> Column:
    """The mode that a name tells, null for none."""
    return F.coalesce(*[F.when(F.contains(name, F.lit(m)), m) for m in MODES])


def buffer_size(name: Column) -> Column:
    """X22."""
    return F.regexp_extract(name, "buf([0-9]+)", 1).try_cast("int")


def name_severity(sans: Column, common_name: Column, host: Column) -> Column:
    """Null where an alternative name matches, High where none does; without any a common name that matches is Medium."""
    by_common = F.when(host_matches(common_name, host), "Medium").otherwise("High")
    return F.when(F.size(sans) == 0, by_common).when(~F.exists(sans, lambda x: host_matches(x, host)), "High")


def has_srv(sans: Column) -> Column:
    """X34."""
    return F.exists(sans, lambda x: F.startswith(x, F.lit("_")))


def with_rarity(prints: DataFrame, shares: DataFrame) -> DataFrame:
    """1 less a print's share, within 0 and 1; null for prints that the table lacks."""
    return prints.join(F.broadcast(shares), "print", "left").withColumn("rarity", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("share"))), 9)).withColumn("rarity", F.when(F.col("share").isNotNull(), F.col("rarity"))).drop("share")


def posture(flows: DataFrame) -> Column:
    """100 less what is wrong with a flow, 5 at least."""
    c = F.col
    off = lambda condition, n: F.when(condition, n).otherwise(0)
    lost = [off(c("deprecated"), 30), F.coalesce(lookup({"weak": 25, "medium": 10}, c("strength")), F.lit(0)), off(~c("fs"), 15), off(c("expired"), 30), off(~c("san_match"), 15), off(c("self_signed"), 10), off(c("starttls_mode") == "stripped", 25)]
    return F.greatest(F.lit(5), 100 - sum(lost[1:], lost[0]))
