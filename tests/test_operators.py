"""Operators on literal rows, and against plain walks over random ones."""

import io
import random
import struct
import zipfile

from pyspark.sql import functions as F

from tidemark.functions import hashing, numbers, tls
from tidemark.operators import reassembly, relational, rules, store, transcript
from tidemark.schema import VERDICT
from tidemark.sources import captures

STRONG = dict(
    flow_id="family-1", app_protocol="smtp", starttls_mode="upgrade", pre_tls_buffer_len=0, starttls_advertised=True, pre_tls_buffer_injection_possible=False,
    tls=dict(version="TLS1.2", is_deprecated=False, cipher_suite="ECDHE-RSA-AES128-GCM-SHA256", cipher_strength="strong", is_aead=True, kex="ECDHE", fs_flag=True, handshake_success=True),
    cert=dict(leaf_present=True, is_tls13_opaque=False, is_expired=False, is_self_signed=False, chain_valid=True, chain_length=2, san_match=True, pubkey_algo="RSA", pubkey_bits=2048, days_to_expiry=200, sigalg="sha256WithRSAEncryption", sigalg_weak=False),
)


def verdict(**changes):
    made = {k: dict(v) if isinstance(v, dict) else v for k, v in STRONG.items()}
    for k, v in changes.items():
        if isinstance(v, dict):
            made[k].update(v)
        else:
            made[k] = v
    return made


def judge(spark, *verdicts):
    rows = spark.createDataFrame([verdict(**v) for v in verdicts], VERDICT)
    return rules.decide(rules.assess(rows)).collect()


def checks(row):
    return {f.check: f.severity for f in row.findings}


def test_rules_fire_one_by_one(spark):
    cases = [
        ({}, "TLS version outdated", "Medium"), (dict(tls=dict(version="TLS1.0")), "TLS version deprecated", "Critical"), (dict(tls=dict(cipher_suite="RC4-SHA")), "Weak cipher (RC4/NULL/EXPORT/DES)", "Critical"),
        (dict(tls=dict(cipher_suite="DES-CBC3-SHA")), "3DES SWEET32", "High"), (dict(tls=dict(is_aead=False)), "CBC without AEAD", "Medium"), (dict(tls=dict(kex="unknown")), "KEX unrecognized", "Info"), (dict(tls=dict(kex="RSA")), "Weak KEX (no FS)", "High"),
        (dict(cert=dict(pubkey_bits=512)), "Weak pubkey (<1024)", "Critical"), (dict(cert=dict(pubkey_bits=1024)), "Weak pubkey (<2048 / <P-256)", "High"), (dict(cert=dict(sigalg="md5WithRSA")), "Weak sigalg (SHA1/MD5)", "High"), (dict(cert=dict(is_expired=True)), "Certificate expired", "Critical"),
        (dict(cert=dict(chain_valid=False)), "Chain incomplete/self-signed", "High"), (dict(cert=dict(san_match=False)), "Hostname mismatch", "High"), (dict(tls=dict(fs_flag=False)), "No forward secrecy", "High"), (dict(starttls_mode="stripped"), "STARTTLS stripping suspected", "High"),
        (dict(pre_tls_buffer_len=9, pre_tls_buffer_injection_possible=True), "Pre-TLS injection possible", "High"), (dict(pre_tls_buffer_len=9), "Pre-TLS injection possible", "Info"), (dict(app_protocol="imap"), "Implicit TLS absent", "Info"), (dict(cert=dict(days_to_expiry=5)), "Certificate expiry <30d", "Medium"),
    ]
    for (change, name, severity), row in zip(cases, judge(spark, *[c for c, _, _ in cases])):
        assert checks(row).get(name) == severity, (change, name)


def test_nulls_are_not_false(spark):
    blank = {k: None for k in STRONG["cert"]}
    (row,) = judge(spark, dict(cert=blank, pre_tls_buffer_len=None))
    assert not {"Certificate expired", "Hostname mismatch", "Chain incomplete/self-signed", "Pre-TLS injection possible", "Certificate expiry <30d"} & set(checks(row))
    assert 0 <= row.risk_score <= 100 and row.posture_score == 100 - row.risk_score


def test_policy(spark):
    strong, opaque, stripped, bad = judge(spark, {}, dict(tls=dict(version="TLS1.3"), cert=dict(leaf_present=False, is_tls13_opaque=True, is_expired=None, chain_valid=None, san_match=None)), dict(starttls_mode="stripped", cert=dict(leaf_present=False)), dict(tls=dict(version="TLS1.0", cipher_suite="RC4-SHA", cipher_strength="weak")))
    assert (strong.action, strong.wire_action, strong.banner) == ("allow", "deliver", None) and strong.policy_score <= 6
    assert opaque.action == "allow"
    assert stripped.low_conf and stripped.action == "flag" and stripped.disposition.endswith("low conf")
    assert (bad.action, bad.wire_action, bad.risk_level) == ("block", "hold_incident", "Critical")


def test_history_escalates(spark):
    rows = [verdict(flow_id=f"h-{i}", starttls_mode=m) | {"custkey": 1, "k": i, "seen_at": i} for i, m in enumerate(["upgrade", "upgrade", "stripped"])]
    df = spark.createDataFrame(rows, VERDICT + ", custkey int, k int, seen_at int")
    last = [r for r in rules.assess(df, history=True).collect() if r.flow_id == "h-2"][0]
    alone = rules.assess(df.where("k = 2"), history=True).first()
    assert checks(last)["STARTTLS stripping suspected"] == "Critical" and checks(alone)["STARTTLS stripping suspected"] == "High"


def walk(segments, by_arrival):
    reached, new, gap, overlap = None, 0, 0, False
    for _, seq, n in segments if by_arrival else sorted(segments, key=lambda s: (s[1], s[0])):
        reached = seq if reached is None else reached
        overlap |= seq < reached
        gap += max(0, seq - reached)
        new += max(0, seq + n - max(seq, reached))
        reached = max(reached, seq + n)
    return new, gap, overlap


def test_reassembly_is_the_walk(spark):
    random.seed(7)
    flows = {f: [(i, random.randint(0, 60), random.randint(0, 12)) for i in range(random.randint(1, 25))] for f in range(40)}
    df = spark.createDataFrame([(f, *s) for f, ss in flows.items() for s in ss], "flow int, pkt_no int, seq bigint, len bigint")
    for by_arrival in (False, True):
        for r in reassembly.coverage(reassembly.walk(df, by_arrival)).collect():
            assert (r.reassembled, r.gap_bytes, r.has_overlap) == walk(flows[r.flow], by_arrival)
            total = sum(n for _, _, n in flows[r.flow])
            assert r.coverage == (round(r.reassembled / total, 4) if total else 1.0)


def test_transcript(spark):
    c, s = "client_to_server", "server_to_client"
    rows = [("a", 1, s, "220 mail ready"), ("a", 2, c, "EHLO x"), ("a", 3, s, "250-mail\r\n250-STARTTLS\r\n"), ("a", 4, c, "STARTTLS"), ("a", 5, s, "220 Ready to start TLS"), ("b", 1, s, "a2 OK Begin TLS negotiation"), ("c", 1, c, "QUIT\r\n\r\n")]
    got = {r.conv: (r.advertised, r.command_at, r.go_ahead_at) for r in transcript.upgrade(transcript.lines(spark.createDataFrame(rows, "conv string, packet_no int, direction string, text string"))).collect()}
    assert got == {"a": (True, 4, 5), "b": (False, None, 1), "c": (False, None, None)}


def test_store(spark):
    current = spark.createDataFrame([("a", 1, 10), ("b", None, 10), ("c", 3, 10)], "k string, v int, at int")
    updates = spark.createDataFrame([("a", 1, 20), ("b", 2, 20), ("d", 4, 20)], "k string, v int, at int")
    got = {r.k: (r.v, r.at, r.outcome) for r in store.upsert(current, updates, ["k"], ["v"], "at").collect()}
    assert got == {"a": (1, 10, "unchanged"), "b": (2, 20, "updated"), "c": (3, 10, "unchanged"), "d": (4, 20, "inserted")}
    base = spark.createDataFrame([("a", 7)], "k string, version int")
    assert {(r.k, r.version) for r in store.history(updates, ["k"], ["at"], base).collect()} == {("a", 8), ("b", 1), ("d", 1)}


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert [value(tls.cipher_name(F.lit(c).cast("int"))) for c in (0x1301, 0x1A1A, None)] == ["TLS_AES_128_GCM_SHA256", "UNKNOWN-1a1a", "none"]
    assert [value(tls.key_exchange(F.lit(s), F.lit(False))) for s in ("UNKNOWN-1a1a", "ECDHE-X", "DHE-X", "RSA-X", "TLS_X", "RC4-SHA", "none")] == ["unknown", "ECDHE", "DHE", "RSA", "ECDHE", "RSA", "unknown"]
    assert value(tls.without_grease(F.array(*map(F.lit, (0x0A0A, 1, 0xFAFA, 0x0A1A, 1))))) == [1, 0x0A1A, 1]
    assert [value(tls.host_matches(F.lit(p), F.lit(h))) for p, h in (("*.a.com", "x.A.com."), ("*.a.com", "x.y.a.com"), ("*.a.com", "a.com"), ("A.com", "a.com"))] == [True, False, False, True]
    assert [value(tls.direction(F.lit(a), F.lit(b))) for a, b in ((25, 50000), (50000, 587), (1000, 2000), (3000, 2000))] == ["server_to_client", "client_to_server", "server_to_client", "client_to_server"]
    import hashlib

    assert value(hashing.modulo(F.lit("abc"), 132)) == int(hashlib.sha256(b"abc").hexdigest(), 16) % 132
    assert [value(numbers.level_from(F.lit(x))) for x in (40, 39, 10, 9)] == ["Critical", "High", "Medium", "Low"]
    assert value(numbers.category_code("version", F.lit(None).cast("string"))) == -1 and value(numbers.category_code("kex", F.lit("DHE"))) == 2
    assert value(tls.rarity(F.lit(1.5))) == 0.0 and value(tls.rarity(F.lit(None).cast("double"))) is None


def test_banded_join(spark):
    p = spark.createDataFrame([(float(x),) for x in (0, 5, 9.99, 10, 25)], "x double")
    b = spark.createDataFrame([("a", 0.0, 10.0), ("b", 5.0, 26.0)], "n string, low double, high double")
    assert sorted((r.n, r.x) for r in relational.banded(p, "x", b, "low", "high", 7.0).collect()) == [("a", 0.0), ("a", 5.0), ("a", 9.99), ("b", 5.0), ("b", 9.99), ("b", 10.0), ("b", 25.0)]


def hello():
    block = lambda n, b: len(b).to_bytes(n) + b
    ext = lambda k, b: k.to_bytes(2) + block(2, b)
    extensions = ext(0, b"x") + ext(10, block(2, b"\x00\x1d")) + ext(13, block(2, b"\x04\x03\x08\x04")) + ext(43, block(1, b"\x03\x04"))
    body = b"\x03\x03" + bytes(32) + block(1, b"") + block(2, b"\x13\x01\xc0\x2f") + block(1, b"\x00") + block(2, extensions)
    return b"\x16\x03\x01" + block(2, b"\x01" + block(3, body))


def pcap(payloads):
    out = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for i, body in enumerate(payloads):
        tcp = struct.pack(">HHIIBBHHH", 50000, 587, 100 + i, 0, 0x50, 0x18, 100, 0, 0) + body
        ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(tcp), 0, 0, 64, 6, 0, bytes([10, 0, 0, 1]), bytes([10, 0, 0, 2])) + tcp
        frame = bytes(12) + b"\x08\x00" + ip
        out += struct.pack("<IIII", i, 5, len(frame), len(frame)) + frame
    return out


def test_captures(spark, tmp_path):
    body = pcap([b"EHLO x\r\n", b"", hello()])
    (tmp_path / "one.pcap").write_bytes(body)
    (tmp_path / "cut.pcap").write_bytes(body[:-20])
    (tmp_path / "text.txt").write_bytes(b"no capture at all")
    with zipfile.ZipFile(tmp_path / "two.zip", "w") as z:
        z.writestr("in/two.pcap", body)
    files = captures.files(spark, str(tmp_path))
    assert {r.name.rsplit("/", 1)[-1]: r.malformed for r in files.collect()} == {"one.pcap": False, "cut.pcap": False, "text.txt": True, "two.pcap": False}
    packets = captures.packets(files.where("not malformed"))
    one = [r for r in packets.collect() if r.capture.endswith("one.pcap")]
    assert [(r.pkt_no, r.src, r.dport, r.seq, r.payload) for r in one] == [(1, "10.0.0.1", 587, 100, b"EHLO x\r\n"), (3, "10.0.0.1", 587, 102, hello())]
    found = {r.capture.rsplit("/", 1)[-1]: r for r in captures.hellos(packets).collect()}["one.pcap"]
    assert (found.pkt_no, found.legacy, found.ciphers, found.groups, found.supported) == (3, 0x0303, [0x1301, 0xC02F], [0x1D], [0x0304])
    assert captures.parse_hello(hello()[:30]) is not None and captures.parse_hello(b"") is None


def test_pre_tls_buffer(spark):
    cases = [(b"220 mail\r\nPIPELINED\x16\x03\x01", 9), (b"220 mail\r\n\x16\x03\x01", 0), (b"", 0), (b"220 no tls\r\n", 0)]
    df = spark.createDataFrame([(i, bytearray(b)) for i, (b, _) in enumerate(cases)], "i int, b binary")
    got = {r.i: r.n for r in df.select("i", captures.pre_tls_buffer(F.hex("b")).alias("n")).collect()}
    assert got == {i: n for i, (_, n) in enumerate(cases)}


def test_pem(spark):
    text = "x\n-----BEGIN CERTIFICATE-----\nAAEC\n-----END CERTIFICATE-----\n-----BEGIN CERTIFICATE-----\nAwQ=\n-----END CERTIFICATE-----"
    got = captures.certificates(spark.createDataFrame([("f", text), ("g", None)], "name string, text string")).collect()
    assert [(r.name, r.nr, bytes(r.der)) for r in got] == [("f", 0, b"\x00\x01\x02"), ("f", 1, b"\x03\x04")]
    assert io.BytesIO(bytes(got[0].der)).read() == b"\x00\x01\x02"


def test_hints_policies_and_early_data_in_findings(spark, sf):
    from pyspark.sql import functions as F

    from tidemark.operators import rules
    from tidemark.sources.tables import verdicts

    flows = verdicts(spark, sf).where("starttls_mode = 'none' and tls.version <> 'unknown'").limit(3)
    lines = F.array(F.struct(F.lit("250-STARTTLS removed by a middlebox").alias("line")))
    checks = lambda **more: flows.select("flow_id", rules.findings(rules.registry(**more)).alias("f")).collect()
    named = lambda rows, check: [[x.evidence for x in r.f if x.check == check] for r in rows]
    assert flows.count() == 3 and named(checks(), "STARTTLS stripping suspected") == [[]] * 3
    assert all(e and "low conf" in e[0] for e in named(checks(transcript=lines), "STARTTLS stripping suspected"))
    assert named(checks(policy=F.lit("MTA-STS enforce, DANE present")), "MX/MTA-STS/DANE") == [["MTA-STS enforce, DANE present"]] * 3
    early = flows.withColumn("tls", F.col("tls").withField("early_data_offered", F.lit(True)).withField("early_data_accepted", F.lit(False)).withField("psk_offered", F.lit(False)).withField("ech_outer_present", F.lit(False)))
    assert named(early.select("flow_id", rules.findings(rules.registry()).alias("f")).collect(), "0-RTT / ECH") == [["early data offered and not accepted"]] * 3


def test_vectors_of_verdicts_that_lack_fields(spark):
    from tidemark.functions import vectors

    rows = spark.createDataFrame([("imap", None), (None, True)], "app_protocol string, opaque boolean").selectExpr("app_protocol", "named_struct('is_tls13_opaque', opaque, 'leaf_present', true, 'is_self_signed', true, 'days_to_expiry', 9000) as cert")
    got = [dict(zip(vectors.ALL_28, r[0])) for r in rows.select(vectors.vector(rows)).collect()]
    assert len(vectors.ALL_28) == 28 and all(len(g) == 28 and None not in g.values() for g in got)
    assert got[0]["port"] == 2 and got[0]["cert_missing_reason"] == 3 and got[0]["days_to_expiry"] == 9000 and got[0]["ja4_rarity"] == 0.5 and got[0]["version"] == 4
    assert got[1]["cert_missing_reason"] == 1 and got[1]["days_to_expiry"] == -1 and got[1]["miss_indicator_days_to_expiry"] == 1 and got[1]["port"] == 0
    scaled = rows.select(vectors.vector(rows, vectors.TOP_5, True)).first()[0]
    assert len(scaled) == 5 and scaled[4] == 1.0 and all(-1 <= v <= 1 for v in scaled)
