"""Feature vectors of verdicts: 28, 8 and 5 numbers, raw or scaled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import category_code
from tidemark.functions.tls import lookup

# fixed values: names in the order of the vectors, ports by protocol, codes of why a certificate is missing, and scales
CATEGORIES = ["version", "cipher_strength", "kex", "starttls_mode", "port", "cert_missing_reason"]
FLAGS = ["is_deprecated", "is_aead", "fs_flag", "handshake_success", "alert_after_starttls"]
DETAILS = ["chain_valid", "san_match", "days_to_expiry", "chain_length", "pubkey_bits", "sigalg_weak", "is_expired", "is_self_signed", "keysize_weak"]
MISSING = ["chain_valid", "san_match", "days_to_expiry", "pubkey_bits", "sigalg", "chain_length", "ja4_rarity"]
ALL_28 = [*CATEGORIES, *FLAGS, "ja4_rarity", *DETAILS, *[f"miss_indicator_{m}" for m in MISSING]]
TOP_8 = ["version", "cipher_strength", "kex", "chain_valid", "days_to_expiry", "fs_flag", "starttls_mode", "miss_indicator_days_to_expiry"]
TOP_5 = TOP_8[:5]
PORTS, REASONS = {"smtp": "25", "imap": "993", "pop3": "995"}, {"none": 0, "opaque": 1, "missing": 2, "private": 3}
CODES, DAYS, BITS = 32.0, 3650.0, 4096.0


def has(df: DataFrame, path: str) -> Column:
    """A field by its path, or null where the frame has none."""
    kind = df.schema
    for name in path.split("."):
        field = next((f for f in kind if f.name == name), None) if hasattr(kind, "fields") else None
        if field is None:
            return F.lit(None)
        kind = field.dataType
    return F.col(path)


def numbers_of(df: DataFrame, scaled: bool = False) -> dict[str, Column]:
    """The 28 numbers of a verdict by name; a number that is missing is -1 (a rarity 0.5), so none is null.

    scaled: codes, days (within 0 and ten years) and bits are brought between 0 and 1.  An opaque certificate has no details;
    a port that isn't told is that of the protocol.
    """
    tls, opaque = (lambda n: has(df, f"tls.{n}")), F.coalesce(has(df, "cert.is_tls13_opaque").cast("boolean"), F.lit(False))
    cert = lambda n: F.when(~opaque, has(df, f"cert.{n}"))
    whole = lambda c, other: F.coalesce(c.cast("string"), F.lit(other))
    there = F.coalesce(cert("leaf_present").cast("boolean"), F.lit(False))
    alone = F.coalesce(cert("is_self_signed").cast("boolean"), F.lit(False)) & cert("chain_valid").isNull()
    reason = F.when(opaque, "opaque").when(~there, "missing").when(alone, "private").otherwise("none")
    port = F.coalesce(has(df, "port").cast("string"), lookup(PORTS, has(df, "app_protocol").cast("string")), F.lit("25"))
    told = {"version": whole(tls("version"), "unknown"), "cipher_strength": whole(tls("cipher_strength"), "unknown"), "kex": whole(tls("kex"), "unknown"), "starttls_mode": whole(has(df, "starttls_mode"), "none"), "port": port}
    out = {n: category_code(n, c) for n, c in told.items()} | {"cert_missing_reason": lookup(REASONS, reason)}
    out = {n: F.greatest(c / CODES, F.lit(0.0)) if scaled else c for n, c in out.items()}
    out |= {n: F.coalesce(tls(n).cast("boolean"), F.lit(False)) for n in FLAGS}
    out["ja4_rarity"] = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(tls("ja4_rarity").cast("double"), F.lit(0.5))))
    details = {n: cert(n) for n in DETAILS}
    value = {n: c.cast("double") for n, c in details.items()}
    if scaled:
        value["days_to_expiry"] = F.greatest(F.lit(0.0), F.least(F.lit(DAYS), value["days_to_expiry"])) / DAYS
        value["days_to_expiry"] = F.when(details["days_to_expiry"].isNotNull(), value["days_to_expiry"])
        value["pubkey_bits"] = value["pubkey_bits"] / BITS
    out |= {n: F.coalesce(c, F.lit(-1.0)) for n, c in value.items()}
    gone = {n: details[n].isNull() for n in MISSING if n in details} | {"sigalg": details["sigalg_weak"].isNull() & cert("sigalg").isNull(), "ja4_rarity": tls("ja4_rarity").isNull()}
    return {n: c.cast("double") for n, c in (out | {f"miss_indicator_{n}": gone[n] for n in MISSING}).items()}


def vector(df: DataFrame, names: list[str] = ALL_28, scaled: bool = False) -> Column:
    """The numbers of the names as an array, in their order."""
    made = numbers_of(df, scaled)
    return F.array(*[made[n] for n in names])
