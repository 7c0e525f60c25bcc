"""The upgrade transcript's state machine (W06, X15, X16): which packet asked, which agreed, and when."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: patterns of upgrade lines
ADVERTISED = [r"(?i)^250[-\s].*starttls", r"(?i)^\*\s+capability.*starttls", r"(?i)^stls$"]
COMMAND = [r"(?i)(^|\s)starttls(\s|$)", r"(?i)^stls(\s|$)"]
GO_AHEAD = [r"(?i)^220[-\s].*(ready|start tls|go ahead)", r"(?i)ok\b.*begin\b.*tls"]


def any_of(line: Column, patterns: list[str]) -> Column:
    found = line.rlike(patterns[0])
    for p in patterns[1:]:
        found = found | line.rlike(p)
    return found


def lines(packets: DataFrame) -> DataFrame:
    """(conv, packet_no, nr, direction, line): text cut at line ends, blank lines left out."""
    cut = packets.select("conv", "packet_no", "direction", F.posexplode(F.split("text", r"\r?\n")).alias("nr", "line"))
    return cut.where(F.trim("line") != "")


def upgrade(rows: DataFrame, command: list[str] = COMMAND, go: list[str] = GO_AHEAD, advertised: list[str] = ADVERTISED) -> DataFrame:
    """Per conversation: advertised, command_at, go_ahead_at, upgraded_at.

    The go-ahead is the first server line that agrees once a command was seen, in the same packet or later; a line that says
    begin needs no command.  Two aggregations, no fold over rows.
    """
    server, line = F.col("direction") == "server_to_client", F.col("line")
    marked = rows.select("conv", "packet_no", (server & any_of(line, advertised)).alias("adv"), (~server & any_of(line, command)).alias("cmd"), (server & any_of(line, go)).alias("go"), line.rlike("(?i)begin").alias("begin"))
    asked = marked.groupBy("conv").agg(F.bool_or("adv").alias("advertised"), F.min(F.when(F.col("cmd"), F.col("packet_no"))).alias("command_at"), F.min(F.when(F.col("go") & F.col("begin"), F.col("packet_no"))).alias("begin_at"))
    agreed = marked.where("go").join(asked.select("conv", "command_at"), "conv").where(F.col("packet_no") >= F.col("command_at")).groupBy("conv").agg(F.min("packet_no").alias("after_at"))
    return asked.join(agreed, "conv", "left").select("conv", "advertised", "command_at", F.least("after_at", "begin_at").alias("go_ahead_at"))
