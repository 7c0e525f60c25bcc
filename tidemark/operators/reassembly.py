"""TCP reassembly as windows over byte ranges (W01, W02, W07, J16, A08, A10); numbers that wrap are counted on first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unwrapped(segments: DataFrame, flow: str = "flow", width: int = 1 << 32) -> DataFrame:
    """The segments (flow, pkt_no, seq) with `seq` counted on where it wraps at `width`.

    In the order of arrival, a step down by more than half of the width is a wrap, and one up by as much a late segment from
    before it; the running sum of both is what a number has to be raised by.  One shuffle by flow, which later windows use too.
    """
    arrived = Window.partitionBy(flow).orderBy("pkt_no")
    step = F.col("seq") - F.coalesce(F.lag("seq").over(arrived), F.col("seq"))
    turned = segments.withColumn("turn", F.when(step < -(width // 2), 1).when(step > width // 2, -1).otherwise(0))
    return turned.withColumn("seq", F.col("seq") + F.lit(width) * F.sum("turn").over(arrived)).drop("turn")


def walk(segments: DataFrame, by_arrival: bool = False) -> DataFrame:
    """Each segment (flow, pkt_no, seq, len) with new_bytes, gap and overlap.

    Segments are taken by sequence number, arrival deciding between equals, or by arrival.  What was reached before
    is the running maximum of ends.  A flow's segments are sorted once, and one shuffle by flow serves all columns.
    """
    order = ["pkt_no"] if by_arrival else ["seq", "pkt_no"]
    before = Window.partitionBy("flow").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    reached = F.max(F.col("seq") + F.col("len")).over(before)
    df = segments.withColumn("reached", F.coalesce(reached, F.col("seq")))
    end = F.col("seq") + F.col("len")
    return df.withColumns({"new_bytes": F.greatest(F.lit(0), end - F.greatest("seq", "reached")), "gap": F.greatest(F.lit(0), F.col("seq") - F.col("reached")), "overlap": F.col("seq") < F.col("reached")}).drop("reached")


def coverage(walked: DataFrame) -> DataFrame:
    """Per flow: packets, total, reassembled and gap bytes, flags, and coverage (1.0 of nothing), to four digits."""
    total, new = F.sum("len"), F.sum("new_bytes")
    return walked.groupBy("flow").agg(F.count("*").alias("packets"), total.alias("total_bytes"), new.alias("reassembled"), F.sum("gap").alias("gap_bytes"), F.bool_or("overlap").alias("has_overlap"), F.bool_or(F.col("gap") > 0).alias("has_gap"), F.round(F.coalesce(F.try_divide(new, total), F.lit(1.0)), 4).alias("coverage"))


def payloads(walked: DataFrame, payload: str) -> DataFrame:
    """(flow, bytes, content) of the new bytes of each flow in order; a flow's payload is put together in one task."""
    part = F.when(F.col("new_bytes") > 0, F.substring(F.col(payload), -F.col("new_bytes").cast("int"), F.col("new_bytes").cast("int"))).otherwise("")
    ordered = F.array_sort(F.collect_list(F.struct("seq", "pkt_no", part.alias("part"))))
    return walked.groupBy("flow").agg(F.sum("new_bytes").alias("bytes"), F.array_join(F.transform(ordered, lambda x: x["part"]), "").alias("content"))


def primary(covered: DataFrame) -> DataFrame:
    """The flow of most bytes, the first of equals."""
    return covered.agg(F.max_by("flow", F.struct("total_bytes", (-F.col("flow")).alias("back"))).alias("flow"), F.max("total_bytes").alias("total_bytes"))


def offsets(packets: DataFrame, key: str, order: str, size) -> DataFrame:
    """Start and end of each packet in its conversation's bytes."""
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return packets.withColumn("start", F.coalesce(F.sum(size).over(upto), F.lit(0))).withColumn("end", F.col("start") + size)


def owners(points: DataFrame, ranges: DataFrame, key: str, block: int = 4096) -> DataFrame:
    """The range [start, end) of the same key that each point's `offset` lies in, the last one beyond all.

    Ranges are cut into blocks of offsets, so the join is an equality on key and block with a filter.
    """
    cut = ranges.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor(F.greatest(F.col("start"), F.col("end") - 1) / block))))
    hit = points.withColumn("block", F.floor(F.col("offset") / block)).join(cut, [key, "block"], "left").where(F.col("start").isNull() | ((F.col("offset") >= F.col("start")) & (F.col("offset") < F.col("end"))))
    found = points.join(hit.where("start is not null").select(key, "offset", "packet"), [key, "offset"], "left")
    last = ranges.groupBy(key).agg(F.max_by("packet", "start").alias("last_packet"))
    return found.join(last, key, "left").withColumn("packet", F.coalesce("packet", "last_packet")).drop("last_packet")
