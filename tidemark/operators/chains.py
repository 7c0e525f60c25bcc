"""Certificate chains: paths from a leaf to an anchor, each link verified.

Links are found by joins of issuer names (and authority key identifiers, where both have them) to subjects, within what was
presented together and with the trust store.  A link's signature is verified once however many bundles hold it.  Then a search in
breadth, at most DEPTH steps, finds the shortest path; for path length constraints the shortest is the best, so one visit of a
certificate is enough.

Signatures that are verified: RSA with PKCS #1 v1.5 padding, and ECDSA over P-256 and P-384, with SHA-2; others make a link
invalid.  Name constraints and other critical extensions that aren't evaluated make a certificate unfit as an issuer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.tls import host_matches
from tidemark.sources import certificates
from tidemark.sources.shared import kept

#: Certificates of a path at most, the leaf and the anchor included; certificates up to which a trust store is broadcast.
DEPTH, STORE = 6, 20_000
SERVER = "1.3.6.1.5.5.7.3.1"
# fixed values: what precedes a digest in PKCS #1 v1.5, and the curves y^2 = x^3 - 3x + b
PREFIX = {"sha256": "3031300d060960864801650304020105000420", "sha384": "3041300d060960864801650304020205000430", "sha512": "3051300d060960864801650304020305000440", "sha224": "302d300d06096086480165030402040500041c"}
P256 = {
    "p": 0xFFFFFFFF00000001000000000000000000000000FFFFFFFFFFFFFFFFFFFFFFFF, "n": 0xFFFFFFFF00000000FFFFFFFFFFFFFFFFBCE6FAADA7179E84F3B9CAC2FC632551, "b": 0x5AC635D8AA3A93E7B3EBBD55769886BC651D06B0CC53B0F63BCE3C3E27D2604B,
    "g": (0x6B17D1F2E12C4247F8BCE6E563A440F277037D812DEB33A0F4A13945D898C296, 0x4FE342E2FE1A7F9B8EE7EB4A7C0F9E162BCE33576B315ECECBB6406837BF51F5),
}
P384 = {
    "p": 0xFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFEFFFFFFFF0000000000000000FFFFFFFF, "n": 0xFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFC7634D81F4372DDF581A0DB248B0A77AECEC196ACCC52973,
    "b": 0xB3312FA7E23EE7E4988E056BE3F82D19181D9C6EFE8141120314088F5013875AC656398D8A2ED19D2A85C8EDD3EC2AEF,
    "g": (0xAA87CA22BE8B05378EB1C71EF320AD746E1D3B628BA79B9859F741E082542A385502F25DBF55296C3A545E3872760AB7, 0x3617DE4A96262C6F5D9E98BF9292DC29F8F41DBD289A147CE9DA3113B5F0B8C00A60B1CE1D7E819D7A431D7C90EA0E5F),
}
CURVES = {"1.2.840.10045.3.1.7": P256, "1.3.132.0.34": P384}

Point = tuple[int, int] | None


def plus(curve: dict, a: Point, b: Point) -> Point:
    """The sum of two points; None is the one at infinity."""
    p = curve["p"]
    if a is None or b is None:
        return a or b
    if a[0] == b[0]:
        if (a[1] + b[1]) % p == 0:
            return None
        slope = (3 * a[0] * a[0] - 3) * pow(2 * a[1], -1, p)
    else:
        slope = (b[1] - a[1]) * pow(b[0] - a[0], -1, p)
    x = (slope * slope - a[0] - b[0]) % p
    return x, (slope * (a[0] - x) - a[1]) % p


def times(curve: dict, k: int, point: Point) -> Point:
    total = None
    while k:
        if k & 1:
            total = plus(curve, total, point)
        point, k = plus(curve, point, point), k >> 1
    return total


def verifies(spki: bytes, hash_name: str, tbs: bytes, signature: bytes) -> bool:
    """Whether the key signed the bytes; never raises."""
    try:
        algorithm, _, numbers = certificates.public_key(spki)
        if hash_name not in PREFIX:
            return False
        digest = hashlib.new(hash_name, tbs).digest()
        if algorithm == "RSA":
            n, e = numbers
            size = (n.bit_length() + 7) // 8
            tail = bytes.fromhex(PREFIX[hash_name]) + digest
            return len(signature) == size and pow(int.from_bytes(signature), e, n) == int.from_bytes(b"\0\1" + b"\xff" * (size - len(tail) - 3) + b"\0" + tail)
        if algorithm == "EC" and (curve := CURVES.get(numbers[0])):
            p, n, body = curve["p"], curve["n"], numbers[1]
            size = (p.bit_length() + 7) // 8
            x, y = int.from_bytes(body[1 : 1 + size]), int.from_bytes(body[1 + size :])
            r, s = (int.from_bytes(f.body) for f in certificates.one(signature).parts()[:2])
            if body[:1] != b"\4" or len(body) != 1 + 2 * size or (y * y - x * x * x + 3 * x - curve["b"]) % p or not (0 < r < n and 0 < s < n):
                return False
            z = int.from_bytes(digest[: (n.bit_length() + 7) // 8])
            w = pow(s, -1, n)
            found = plus(curve, times(curve, z * w % n, curve["g"]), times(curve, r * w % n, (x, y)))
            return found is not None and found[0] % n == r
    except (ValueError, IndexError):
        pass
    return False


def signed(links: DataFrame) -> DataFrame:
    """The (child, parent) of links (child, parent, spki, sigalg, tbs, signature) whose signatures hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[batch.column(k).to_pylist() for k in range(2, 6)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([verifies(*r) for r in rows], pa.bool_())], ["child", "parent", "holds"])

    return links.select("child", "parent", "spki", "sigalg", "tbs", "signature").mapInArrow(run, "child string, parent string, holds boolean").where("holds").select("child", "parent")


def issues(c: dict[str, Column], time: Column, least_bits: int) -> Column:
    """Whether a certificate may issue others at that time."""
    strong = (c["pubkey_algo"] == "EC") & (c["pubkey_bits"] >= 256) | (c["pubkey_algo"] == "RSA") & (c["pubkey_bits"] >= least_bits)
    return c["is_ca"] & F.coalesce(c["signs"], F.lit(True)) & ~c["unknown_critical"] & time.between(c["not_before"], c["not_after"]) & strong


def validate(presented: DataFrame, store: DataFrame, hostname: str | Column, time: str, least_bits: int = 2048) -> DataFrame:
    """A row for each bundle of presented certificates (bundle, nr, der), nr 0 being the leaf's, against the anchors of store (der).

    bundle, leaf_present, chain_length (of the path found, else of what was presented), chain_valid, san_match, used_cn, ocsp_must_staple, is_expired, is_not_yet_valid,
    is_self_signed, days_to_expiry (floor), pubkey_algo, pubkey_bits, sigalg, malformed.  hostname: the name asked for, a column of presented or a text; time: ISO 8601.

    A chain holds if a path of at most DEPTH certificates leads to an anchor, each signature verifies, each date holds, each issuer is an
    authority that may sign with so many above it as its path length says, and the leaf is for servers and matches the name by its
    subject alternative names.  A leaf that can't be read gives a row with the reason and no chain; what else is malformed is
    left out.  A bundle without nr 0 has no leaf.  Repeated certificates of a bundle count once in paths; an empty frame gives an empty frame.
    """
    at = F.to_timestamp(F.lit(time))
    asked = F.lit(hostname) if isinstance(hostname, str) else hostname
    rows = kept(certificates.parse(presented.select("bundle", "nr", "der", asked.alias("asked")), "bundle", "nr", "asked"))
    anchors = kept(certificates.parse(store.select(F.lit(0).alias("nr"), "der"), "nr").drop("nr").where("malformed is null").dropDuplicates(["digest"]))
    near = F.broadcast(anchors) if anchors.count() <= STORE else anchors
    good = rows.where("malformed is null")

    fit = {n: F.col(f"p.{n}") for n, _, _ in certificates.FIELDS}
    keyed = F.col("c.authority_key").isNull() | F.col("p.key_id").isNull() | (F.col("c.authority_key") == F.col("p.key_id"))
    may = keyed & issues(fit, at, least_bits)
    shape = [F.col("c.bundle").alias("bundle"), F.col("c.digest").alias("child"), F.col("p.digest").alias("parent"), F.col("p.path_len").alias("path_len"), F.col("p.spki").alias("spki"), F.col("c.sigalg").alias("sigalg"), F.col("c.tbs").alias("tbs"), F.col("c.signature").alias("signature")]
    child, once = good.dropDuplicates(["bundle", "digest"]).alias("c"), good.dropDuplicates(["bundle", "digest"]).alias("p")
    inner = child.join(once, (F.col("c.bundle") == F.col("p.bundle")) & (F.col("c.issuer") == F.col("p.subject")) & (F.col("c.digest") != F.col("p.digest"))).where(may).select(*shape, F.lit(False).alias("anchor"))
    outer = child.join(near.alias("p"), F.col("c.issuer") == F.col("p.subject")).where(may).select(*shape, F.lit(True).alias("anchor"))
    links = kept(inner.unionByName(outer))
    holds = kept(signed(links.dropDuplicates(["child", "parent"])))
    # an authority's link may stand in a third of all bundles: its side of the join has one row, so Spark splits the other
    found = kept(links.drop("spki", "sigalg", "tbs", "signature").join(holds, ["child", "parent"]))

    leaf = good.where("nr = 0").select("bundle", F.col("digest").alias("child"))
    front = visited = leaf
    ends = None
    for depth in range(1, DEPTH):
        # so many authorities lie between the leaf and the parent
        step = kept(front.join(found, ["bundle", "child"]).where(F.col("path_len").isNull() | (F.col("path_len") >= depth - 1)))
        end = step.where("anchor").select("bundle", F.lit(depth + 1).alias("length"))
        ends = end if ends is None else ends.unionByName(end)
        front = step.where("not anchor").select("bundle", F.col("parent").alias("child")).distinct().join(visited, ["bundle", "child"], "left_anti")
        visited = visited.unionByName(front)
        if front.isEmpty():
            break
    own = good.where("nr = 0").join(near.select("digest"), "digest", "left_semi").select("bundle", F.lit(1).alias("length"))  # a leaf that is an anchor itself
    paths = ends.unionByName(own).groupBy("bundle").agg(F.min("length").alias("length"))

    sizes = rows.groupBy("bundle").agg(F.count("*").cast("int").alias("presented"))
    leaves = rows.where("nr = 0").dropDuplicates(["bundle"])
    names = F.col("sans").isNotNull()
    matched = F.when(names, F.exists("sans", lambda s: host_matches(s, F.col("asked")))).otherwise(False)
    serves = matched & F.coalesce(F.array_contains("usages", SERVER), F.lit(True)) & ~F.col("unknown_critical") & at.between(F.col("not_before"), F.col("not_after")) & ((F.col("pubkey_algo") != "RSA") | (F.col("pubkey_bits") >= least_bits))
    judged = sizes.join(leaves, "bundle", "left").join(paths, "bundle", "left")
    valid = F.coalesce(serves, F.lit(False)) & F.col("length").isNotNull()
    read = F.col("digest").isNotNull() & F.col("malformed").isNull()
    return judged.select(
        "bundle", read.alias("leaf_present"), F.when(valid, F.col("length")).otherwise(F.col("presented")).alias("chain_length"), valid.alias("chain_valid"),
        F.coalesce(matched, F.lit(False)).alias("san_match"), (read & ~names & F.col("cn").isNotNull()).alias("used_cn"), F.col("must_staple").alias("ocsp_must_staple"), (F.col("not_after") < at).alias("is_expired"), (F.col("not_before") > at).alias("is_not_yet_valid"),
        (F.col("issuer") == F.col("subject")).alias("is_self_signed"), F.floor((F.unix_timestamp("not_after") - F.unix_timestamp(at)) / 86400).cast("int").alias("days_to_expiry"), "pubkey_algo", "pubkey_bits", "sigalg", "malformed",
    )
