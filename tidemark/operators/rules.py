"""The check registry, findings, score and policy (R, A11-A13, X41, X43, F17, P07).

All checks are one projection: an array of structs in the order of the registry, without those that don't fire.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import level_from
from tidemark.functions.tls import lookup
from tidemark.schema import SEVERITY_RANK, SEVERITY_WEIGHT, WIRE_ACTION


def yes(c: Column) -> Column:
    """True only; null is no."""
    return F.coalesce(c, F.lit(False))


def no(c: Column) -> Column:
    """False only; null is no answer."""
    return c.eqNullSafe(F.lit(False))


#: When flows are assessed, unless a caller says otherwise: results must not depend on the day of the run.
AS_OF = "2025-01-01T00:00:00Z"


@dataclass
class Check:
    name: str
    spec: str
    cases: list[tuple[Column, str, str | Column]]  # condition, severity, evidence; the first that holds counts
    remedy: str


# fixed values: what lines of a transcript say of an upgrade that was taken out
REMOVED = "stripp|250[- ]starttls removed|ehlo response modified"


def hinted(transcript: Column) -> Column:
    """Whether any line of a transcript (array of structs with `line`) tells that the upgrade was taken out."""
    return F.coalesce(F.exists(transcript, lambda x: F.lower(x["line"]).rlike(REMOVED)), F.lit(False))


def registry(escalated: Column | None = None, private_ca: bool = False, as_of: str = AS_OF, transcript: Column | None = None, policy: Column | None = None) -> list[Check]:
    """escalated: whether two of the last flows of the protocol had been upgraded; as_of: the time of the assessment; transcript: the flow's
    lines, whose hints count; policy: evidence of the host's policy records, as validation.policy_evidence gives it."""
    c = F.col
    ver = F.coalesce(F.when(c("tls.version") == "none", "unknown").otherwise(c("tls.version")), F.lit("unknown"))
    mode = F.coalesce(F.when(c("starttls_mode") == "cleartext", "none").otherwise(c("starttls_mode")), F.lit("none"))
    cipher, kex, app = F.upper(F.coalesce(c("tls.cipher_suite"), F.lit(""))), F.coalesce(c("tls.kex"), F.lit("unknown")), F.coalesce(c("app_protocol"), F.lit("smtp"))
    fs, aead, shook = yes(c("tls.fs_flag")), yes(c("tls.is_aead")), yes(c("tls.handshake_success"))
    old, unnamed = ver.isin("TLS1.0", "TLS1.1"), cipher.startswith("UNKNOWN-")
    bits, algo = c("cert.pubkey_bits"), F.upper(F.coalesce(c("cert.pubkey_algo"), F.lit("")))
    factored = algo.startswith("RSA") | (algo == "DH") | (algo == "")
    sig = F.lower(F.coalesce(c("cert.sigalg"), F.lit("")))
    stripped = (mode == "stripped") | (yes(c("starttls_advertised")) & (mode == "none") & (ver == "unknown") & ~shook)
    if transcript is not None:
        stripped = stripped | (hinted(transcript) & ~mode.isin("upgrade", "implicit"))
    records = F.lit("policy records") if policy is None else F.coalesce(policy, F.lit("no policy records"))
    pre, early = c("pre_tls_buffer_len"), yes(c("tls.early_data_offered"))
    chain, broken = "High" if not private_ca else "Medium", no(c("cert.chain_valid"))
    early_cert = no(c("cert.is_expired")) & yes(F.try_to_timestamp(c("cert.not_before")) > F.lit(as_of).cast("timestamp"))
    leaf, always = yes(c("cert.leaf_present")), F.lit(True)
    escalated = F.lit(False) if escalated is None else escalated
    return [
        Check("TLS version deprecated", "RFC8996", [(old, "Critical", "deprecated protocol version")], "Move to TLS 1.2 or later"),
        Check("TLS version outdated", "NIST SP 800-52r2", [(ver == "TLS1.2", "Medium", "TLS 1.2 only")], "Plan for TLS 1.3"),
        Check("Weak cipher (RC4/NULL/EXPORT/DES)", "RFC7465", [(cipher.rlike("RC4|NULL|EXPORT") | (cipher == "DES-CBC-SHA"), "Critical", "broken cipher")], "Use AES-GCM or ChaCha20-Poly1305"),
        Check("3DES SWEET32", "CVE-2016-2183", [(cipher.rlike("DES-CBC3|3DES"), "High", "64-bit blocks")], "Disable 3DES"),
        Check("CBC without AEAD", "RFC5116", [(~aead & ~ver.isin("TLS1.3", "unknown") & ~cipher.isin("NONE", "") & ~unnamed & old, "High", "no AEAD"), (~aead & ~ver.isin("TLS1.3", "unknown") & ~cipher.isin("NONE", "") & ~unnamed, "Medium", "no AEAD")], "Use AEAD suites only"),
        Check("KEX unrecognized", "IANA TLS registry", [((kex == "unknown") | unnamed, "Info", "unknown key exchange")], "Extend the cipher table"),
        Check("Weak KEX (no FS)", "RFC7525", [(~((kex == "unknown") | unnamed) & ((kex == "RSA") | (~fs & (ver != "TLS1.3"))), "High", "no forward secrecy")], "Use ECDHE"),
        Check("Weak pubkey (<1024)", "NIST SP 800-131A", [(yes(factored & (bits < 1024)), "Critical", "key below 1024 bits")], "Use RSA 2048 or P-256"),
        Check("Weak pubkey (<2048 / <P-256)", "NIST SP 800-131A", [(yes((factored & (bits >= 1024) & (bits < 2048)) | (algo.startswith("EC") & (bits < 256))) | (bits.isNull() & yes(c("cert.keysize_weak"))), "High", "short key")], "Use RSA 2048 or P-256"),
        Check("Weak sigalg (SHA1/MD5)", "RFC9155", [(yes(c("cert.sigalg_weak")) | sig.contains("sha1") | sig.contains("md5"), "High", "weak signature")], "Reissue with SHA-256"),
        Check("Certificate expired", "RFC5280", [(yes(c("cert.is_expired")), "Critical", "expired")], "Renew"),
        Check("Certificate not yet valid", "RFC5280", [(early_cert, "High", "valid only later")], "Correct the clock or reissue"),
        Check("Chain incomplete/self-signed", "RFC5280", [(broken | yes(c("cert.is_self_signed")), chain, "chain not valid or self-signed")], "Serve the whole chain"),
        Check("Hostname mismatch", "RFC7817", [(no(c("cert.san_match")), "High", "name not in certificate")], "Correct the SAN"),
        Check("No forward secrecy", "RFC8446", [(~fs & (kex != "unknown") & (ver == "TLS1.3"), "Medium", "no forward secrecy"), (~fs & (kex != "unknown"), "High", "no forward secrecy")], "Use ECDHE"),
        Check("STARTTLS not offered", "RFC3207", [(mode.isin("none", "stripped") & ~shook & (ver == "unknown"), "High", "no upgrade")], "Require STARTTLS or implicit TLS"),
        Check("STARTTLS stripping suspected", "RFC3207", [(stripped & escalated, "Critical", "upgraded before, stripped now"), (stripped, "High", "downgrade possible (low conf)")], "Compare with earlier sessions"),
        Check("Pre-TLS injection possible", "CVE-2011-0411", [(yes((pre > 0) & c("pre_tls_buffer_injection_possible")), "High", "bytes before the handshake"), (yes(pre != 0), "Info", "no injection seen")], "Discard buffered bytes"),
        Check("Implicit TLS absent", "RFC8314", [((mode != "implicit") & app.isin("imap", "pop3"), "Info", "no implicit TLS")], "Offer 993 or 995"),
        Check("MX/MTA-STS/DANE", "RFC8461", [(always, "Info", records)], "Publish MTA-STS or DANE"),
        Check("0-RTT / ECH", "RFC8446", [(yes(c("tls.ech_outer_present")), "Info", "outer hello"), (early & yes(c("tls.psk_offered")) & yes(c("tls.ticket_age") > 0), "Medium", "early data may be replayed"), (early & ~yes(c("tls.early_data_accepted")), "Info", "early data offered and not accepted"), (always, "Info", "nothing to replay")], "Bound ticket age"),
        Check("Certificate expiry <30d", "CABF BR", [(yes(c("cert.days_to_expiry") < 30) & ~yes(c("cert.is_expired")), "Medium", "expires soon")], "Renew"),
        Check("KeyUsage missing", "RFC5280", [(leaf & broken, "High", "key usage"), (always, "Info", "not evaluated")], "Add key usage"),
        Check("ExtendedKeyUsage not serverAuth", "RFC5280", [(leaf & no(c("cert.san_match")), "High", "extended key usage"), (always, "Info", "not evaluated")], "Add serverAuth"),
        Check("pathLen violation", "RFC5280", [(broken & yes(c("cert.chain_length") > 3), "High", "path too long"), (no(c("cert.leaf_present")) & ~yes(c("cert.is_tls13_opaque")), "Info", "no leaf")], "Reissue intermediates"),
    ]


def findings(checks: list[Check]) -> Column:
    """The findings as an array of structs, in the order of the registry."""
    made = []
    for k in checks:
        case = F.lit(None)
        for condition, severity, evidence in reversed(k.cases):
            told = F.struct(F.lit(k.name).alias("check"), F.lit(severity).alias("severity"), F.lit(k.spec).alias("spec"), (evidence if isinstance(evidence, Column) else F.lit(evidence)).alias("evidence"), F.lit(k.remedy).alias("remediation"))
            case = F.when(condition, told).otherwise(case)
        made.append(case)
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def exploded(assessed: DataFrame, keep, *columns: str) -> DataFrame:
    """The columns and a row for each finding, as f, that `keep` holds for.

    Findings are filtered within the array: a filter over exploded rows would have the optimizer derive constraints from
    the whole registry's conditions, which takes longer than the query.
    """
    return assessed.select(*columns, F.explode(F.filter("findings", keep)).alias("f"))


def serious(finding: Column) -> Column:
    return finding["severity"].isin("Critical", "High")


def escalation() -> Column:
    """Two or more of the last ten earlier flows of the client and protocol were upgraded with success."""
    before = Window.partitionBy("custkey", "app_protocol").orderBy("seen_at", "k").rowsBetween(-10, -1)
    return F.coalesce(F.sum(((F.col("starttls_mode") == "upgrade") & F.col("tls.handshake_success")).cast("int")).over(before), F.lit(0)) >= 2


def risk_score(found: Column) -> Column:
    """Weights added up, at most 100."""
    return F.least(F.lit(100), F.aggregate(found, F.lit(0), lambda a, x: a + F.coalesce(lookup(SEVERITY_WEIGHT, x["severity"]), F.lit(0))))


def top_finding(found: Column) -> Column:
    """The most severe, the first of equals."""
    ranked = F.transform(found, lambda x, i: F.struct(lookup(SEVERITY_RANK, x["severity"]).alias("rank"), (-i).alias("back"), x.alias("finding")))
    return F.array_max(ranked)["finding"]


def severity_for(check: str) -> Column:
    """The severity of the first finding whose check or specification this is; null for none."""
    hit = F.filter("findings", lambda x: (x["check"] == check) | x["spec"].contains(check))
    return F.try_element_at(hit, F.lit(1))["severity"]


def low_confidence(found: Column) -> Column:
    """A13."""
    return F.exists(found, lambda x: F.lower(x["evidence"]).contains("low conf"))


def secure_strong() -> Column:
    """F17."""
    t, x = F.col("tls"), F.col("cert")
    return yes(t["cipher_strength"] == "strong") & no(t["is_deprecated"]) & yes(t["fs_flag"]) & yes(x["leaf_present"]) & yes(x["chain_valid"]) & yes(x["san_match"]) & no(x["is_expired"]) & ~yes(x["sigalg_weak"]) & ~yes(x["keysize_weak"]) & (F.coalesce(x["pubkey_bits"], F.lit(2048)) >= 2048) & ~yes(x["is_tls13_opaque"])


def assess(verdicts: DataFrame, history: bool = False) -> DataFrame:
    """Adds findings, risk_score, risk_level, posture_score. With history, stripping is escalated by earlier flows."""
    if history:
        verdicts = verdicts.withColumn("escalated", escalation())
    found = verdicts.withColumn("findings", findings(registry(F.col("escalated") if history else None)))
    return found.withColumn("risk_score", risk_score(F.col("findings"))).withColumns({"risk_level": level_from(F.col("risk_score")), "posture_score": 100 - F.col("risk_score")})


def decide(assessed: DataFrame) -> DataFrame:
    """Adds action, wire_action, banner, siem_severity, disposition and the level after adjustments."""
    c = F.col
    worst = F.exists(c("findings"), lambda x: x["severity"].isin("High", "Critical"))
    lenient = secure_strong() | (yes(c("cert.is_tls13_opaque")) & ~worst)
    low = low_confidence(c("findings")) & ~secure_strong()
    score = F.when(lenient, F.least(c("risk_score"), F.lit(6))).otherwise(c("risk_score"))
    level = F.when(lenient, "Low").when(low & (c("risk_level") == "Critical"), "High").otherwise(c("risk_level"))
    out = assessed.withColumns({"policy_score": score, "policy_level": level, "low_conf": low})
    action = F.when(c("policy_level") == "Low", "allow").when(c("policy_level") == "Medium", "flag").when((c("policy_level") == "High") & c("low_conf"), "flag").when(c("policy_level") == "High", "quarantine").otherwise("block")
    banner = F.when(c("action").isin("flag", "quarantine"), "yellow").when(c("action") == "block", "red")
    top = F.when(secure_strong(), "Posture Info").otherwise(top_finding(c("findings"))["check"])
    told = F.concat(c("policy_level"), F.lit(" risk_score "), c("policy_score").cast("string"), F.lit(" top "), F.coalesce(top, F.lit("none")), F.when(c("low_conf"), " low conf").otherwise(""))
    return out.withColumn("action", action).withColumns({"wire_action": lookup(WIRE_ACTION, c("action")), "banner": banner, "siem_severity": c("policy_level"), "disposition": told})
