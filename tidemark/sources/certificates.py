"""Certificates and stapled responses: from DER to columns (S18, X35, X36, H25), on Arrow batches.

A reader of DER fields by their tags, no regular expressions over bytes.  What can't be read gives a row with the reason.
"""

from __future__ import annotations

import datetime
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

# fixed values: object identifiers
RSA, EC, DSA, DH = "1.2.840.113549.1.1.1", "1.2.840.10045.2.1", "1.2.840.10040.4.1", ("1.2.840.10046.2.1", "1.2.840.113549.1.3.1")
CURVES = {"1.2.840.10045.3.1.7": 256, "1.3.132.0.34": 384, "1.3.132.0.35": 521, "1.3.132.0.33": 224, "1.2.840.10045.3.1.1": 192}
SIGNATURES = {
    "1.2.840.113549.1.1.2": "md2", "1.2.840.113549.1.1.4": "md5", "1.2.840.113549.1.1.5": "sha1", "1.2.840.113549.1.1.14": "sha224", "1.2.840.113549.1.1.11": "sha256", "1.2.840.113549.1.1.12": "sha384", "1.2.840.113549.1.1.13": "sha512",
    "1.2.840.10045.4.1": "sha1", "1.2.840.10045.4.3.1": "sha224", "1.2.840.10045.4.3.2": "sha256", "1.2.840.10045.4.3.3": "sha384", "1.2.840.10045.4.3.4": "sha512",
}
COMMON_NAME, SUBJECT_KEY, KEY_USAGE, ALT_NAME, CONSTRAINTS, AUTHORITY_KEY, EXTENDED_USAGE, FEATURE = "2.5.4.3", "2.5.29.14", "2.5.29.15", "2.5.29.17", "2.5.29.19", "2.5.29.35", "2.5.29.37", "1.3.6.1.5.5.7.1.24"
HARMLESS = {"2.5.29.32", "2.5.29.31", "1.3.6.1.5.5.7.1.1"}  # policies, revocation lists and authority information don't narrow a chain here
STATUS_REQUEST = 5

FIELDS = [
    ("digest", pa.string(), "string"), ("subject", pa.string(), "string"), ("issuer", pa.string(), "string"), ("cn", pa.string(), "string"), ("sans", pa.list_(pa.string()), "array<string>"), ("not_before", pa.timestamp("us", "UTC"), "timestamp"), ("not_after", pa.timestamp("us", "UTC"), "timestamp"),
    ("pubkey_algo", pa.string(), "string"), ("pubkey_bits", pa.int32(), "int"), ("sig_oid", pa.string(), "string"), ("sigalg", pa.string(), "string"), ("is_ca", pa.bool_(), "boolean"), ("path_len", pa.int32(), "int"), ("signs", pa.bool_(), "boolean"), ("usages", pa.list_(pa.string()), "array<string>"),
    ("must_staple", pa.bool_(), "boolean"), ("unknown_critical", pa.bool_(), "boolean"), ("key_id", pa.string(), "string"), ("authority_key", pa.string(), "string"), ("spki", pa.binary(), "binary"), ("tbs", pa.binary(), "binary"), ("signature", pa.binary(), "binary"), ("malformed", pa.string(), "string"),
]
SCHEMA = ", ".join(f"{n} {t}" for n, _, t in FIELDS)


class Field:
    """A tagged field; `whole` are its bytes with tag and length, `body` those without."""

    __slots__ = ("tag", "whole", "body")

    def __init__(self, tag: int, whole: bytes, body: bytes):
        self.tag, self.whole, self.body = tag, whole, body

    def parts(self) -> list[Field]:
        return list(fields_of(self.body))


def fields_of(data: bytes) -> Iterator[Field]:
    at = 0
    while at < len(data):
        if at + 2 > len(data):
            raise ValueError("a field is cut off")
        tag, size, start = data[at], data[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or start + n > len(data):
                raise ValueError("a length is not definite")
            size, start = int.from_bytes(data[start : start + n]), start + n
        if tag & 0x1F == 0x1F or start + size > len(data):
            raise ValueError("a field is cut off")
        yield Field(tag, data[at : start + size], data[start : start + size])
        at = start + size


def one(data: bytes, tag: int = 0x30) -> Field:
    """The field that the data begin with, of the tag that is asked for."""
    found = next(fields_of(data), None)
    if found is None or found.tag != tag:
        raise ValueError(f"no field {tag:#x}")
    return found


def oid(body: bytes) -> str:
    numbers, n = [], 0
    for b in body:
        n = n << 7 | b & 0x7F
        if not b & 0x80:
            numbers.append(n)
            n = 0
    if not numbers:
        raise ValueError("an empty identifier")
    top = min(numbers[0] // 40, 2)
    return ".".join(map(str, [top, numbers[0] - 40 * top, *numbers[1:]]))


def moment(field: Field) -> datetime.datetime:
    text = field.body.decode("ascii")
    if field.tag == 0x17:
        text = ("19" if text[:2] >= "50" else "20") + text
    elif field.tag != 0x18:
        raise ValueError("no time")
    return datetime.datetime.strptime(text, "%Y%m%d%H%M%SZ").replace(tzinfo=datetime.timezone.utc)


def bits(field: Field) -> bytes:
    if field.tag != 3 or not field.body:
        raise ValueError("no bit string")
    return field.body[1:]


def text(field: Field) -> str:
    if field.tag == 0x1E:
        return field.body.decode("utf-16-be", "replace")
    return field.body.decode("utf-8" if field.tag == 0x0C else "latin-1", "replace")


def public_key(spki: bytes) -> tuple[str, int | None, tuple]:
    """(algorithm, bits, numbers): n and e of RSA, curve and point of EC."""
    algorithm, key = one(spki).parts()[:2]
    kind = algorithm.parts()
    name = oid(kind[0].body)
    if name == RSA:
        n, e = (int.from_bytes(p.body) for p in one(bits(key)).parts()[:2])
        return "RSA", n.bit_length(), (n, e)
    if name == EC:
        curve = oid(kind[1].body)
        return "EC", CURVES.get(curve), (curve, bits(key))
    if name == DSA or name in DH:
        size = int.from_bytes(kind[1].parts()[0].body).bit_length() if len(kind) > 1 else None
        return "DSA" if name == DSA else "DH", size, ()
    return name, None, ()


def parsed(der: bytes) -> dict:
    """The fields of a certificate; ValueError if it isn't one."""
    body, algorithm, signature = one(der).parts()[:3]
    parts = body.parts()
    if parts[0].tag == 0xA0:
        parts = parts[1:]
    _, _, issuer, validity, subject, spki = parts[:6]
    begin, end = validity.parts()[:2]
    algo, size, _ = public_key(spki.whole)
    sig_oid = oid(algorithm.parts()[0].body)
    names = [p.parts() for relative in subject.parts() for p in relative.parts()]
    found = {
        "digest": hashlib.sha256(der).hexdigest(), "subject": subject.whole.hex(), "issuer": issuer.whole.hex(), "cn": next((text(v) for k, v in names if oid(k.body) == COMMON_NAME), None), "not_before": moment(begin), "not_after": moment(end),
        "pubkey_algo": algo, "pubkey_bits": size, "sig_oid": sig_oid, "sigalg": SIGNATURES.get(sig_oid, "unknown"), "must_staple": False, "unknown_critical": False, "spki": spki.whole, "tbs": body.whole, "signature": bits(signature),
    }
    for holder in parts[6:]:
        if holder.tag != 0xA3:
            continue
        for extension in one(holder.body).parts():
            e = extension.parts()
            name, critical, value = oid(e[0].body), len(e) > 2 and e[1].body != b"\0", e[-1].body
            if name == ALT_NAME:
                found["sans"] = [p.body.decode("latin-1") for p in one(value).parts() if p.tag == 0x82]
            elif name == CONSTRAINTS:
                c = one(value).parts()
                found["is_ca"] = bool(c) and c[0].tag == 1 and c[0].body != b"\0"
                found["path_len"] = next((int.from_bytes(p.body) for p in c if p.tag == 2), None)
            elif name == KEY_USAGE:
                used = bits(one(value, 3))
                found["signs"] = bool(used) and bool(used[0] & 0x04)
            elif name == EXTENDED_USAGE:
                found["usages"] = [oid(p.body) for p in one(value).parts()]
            elif name == FEATURE:
                found["must_staple"] = any(int.from_bytes(p.body) == STATUS_REQUEST for p in one(value).parts())
            elif name == SUBJECT_KEY:
                found["key_id"] = one(value, 4).body.hex()
            elif name == AUTHORITY_KEY:
                found["authority_key"] = next((p.body.hex() for p in one(value).parts() if p.tag == 0x80), None)
            elif critical and name not in HARMLESS:
                found["unknown_critical"] = True
    return found


@lru_cache(1024)
def fields_or_reason(der: bytes) -> dict:
    """An authority's certificate comes with many leaves, so a task keeps those that it met last."""
    try:
        return parsed(der)
    except (ValueError, IndexError, UnicodeDecodeError) as e:
        return {"digest": hashlib.sha256(der).hexdigest(), "malformed": str(e) or "cut off"}


def parse(rows: DataFrame, *keys: str) -> DataFrame:
    """The keys of rows (keys, der) and the certificate's fields.  Null is an empty certificate, which is malformed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fields_or_reason(d or b"") for d in batch.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *[pa.array([f.get(n) for f in found], t) for n, t, _ in FIELDS]], [*keys, *[n for n, _, _ in FIELDS]])

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.select(*keys, "der").mapInArrow(run, f"{kinds}, {SCHEMA}")


def staple(der: bytes) -> dict:
    """Status (good, revoked, unknown), this_update and next_update of an OCSP response's first answer."""
    outer = one(der).parts()
    if int.from_bytes(outer[0].body) != 0 or len(outer) < 2:
        return {"status": "unknown"}
    basic = one(one(outer[1].body).parts()[1].body)
    data = [p for p in basic.parts()[0].parts() if p.tag == 0x30][-1]  # the responses come last but for extensions, which have a tag of their own
    answer = data.parts()[0].parts()
    after = next((moment(one(p.body, 0x18)) for p in answer[3:] if p.tag == 0xA0), None)
    return {"status": {0: "good", 1: "revoked"}.get(answer[1].tag & 0x1F, "unknown"), "this_update": moment(answer[2]), "next_update": after}


def stapled_in(payload: bytes) -> bytes | None:
    """The OCSP response of the first CertificateStatus message (type 22) in a server's bytes; records are walked by their lengths."""
    at = payload.find(b"\x16\x03")
    messages = b""
    while 0 <= at and at + 5 <= len(payload) and payload[at] == 0x16:
        size = int.from_bytes(payload[at + 3 : at + 5])
        messages += payload[at + 5 : at + 5 + size]
        at += 5 + size
    at = 0
    while at + 4 <= len(messages):
        size = int.from_bytes(messages[at + 1 : at + 4])
        if messages[at] == 22 and size >= 4 and messages[at + 4] == 1:
            return messages[at + 8 : at + 8 + int.from_bytes(messages[at + 5 : at + 8])]
        at += 4 + size
    return None


def staples(rows: DataFrame, key: str, opaque: str) -> DataFrame:
    """(key, ocsp_stapled_status, this_update, next_update) of rows (key, payload, opaque).

    opaque: whether the handshake hides its certificates (TLS 1.3), and so the staple.  No staple, or one that can't be read, is unknown.
    """

    def told(payload: bytes | None, hidden: bool | None) -> dict:
        if hidden:
            return {"status": "opaque"}
        try:
            der = stapled_in(payload or b"")
            return staple(der) if der else {"status": "unknown"}
        except (ValueError, IndexError):
            return {"status": "unknown"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moment_ = pa.timestamp("us", "UTC")
        for batch in batches:
            found = [told(p, h) for p, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f["status"] for f in found], pa.string()), *[pa.array([f.get(n) for f in found], moment_) for n in ("this_update", "next_update")]], [key, "ocsp_stapled_status", "this_update", "next_update"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "payload", opaque).mapInArrow(run, f"{key} {kind}, ocsp_stapled_status string, this_update timestamp, next_update timestamp")
