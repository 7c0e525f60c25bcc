"""Certificates: fields against another reader, chains against another verifier and case by case, staples."""

import datetime
import shutil
import ssl
import subprocess

import pytest
from pyspark.sql import functions as F

from tidemark.operators import chains
from tidemark.plans import authority as ca
from tidemark.plans import certificates as plan
from tidemark.sources import certificates

BEGIN, END, NOW = datetime.datetime(2025, 1, 1), datetime.datetime(2027, 1, 1), "2026-01-15T00:00:00Z"
HOST = "mail.lab.example"


@pytest.fixture(scope="module")
def keys():
    return plan.keys() | {"p384": ca.EcKey("wide", "1.3.132.0.34"), **{f"k{i}": ca.EcKey(f"k{i}") for i in range(8)}}


def leaf(keys, issuer, signer, **more):
    return ca.issue("leaf", issuer, keys["leaf"].spki, keys[signer], BEGIN, END, **{"sans": [HOST]} | more)


def authority(keys, subject, issuer, own, signer, **more):
    return ca.issue(subject, issuer, keys[own].spki, keys[signer], BEGIN, END, **{"ca": True} | more)


def judge(spark, bundles, anchors, host=HOST, time=NOW):
    rows = [(name, nr, der) for name, ders in bundles.items() for nr, der in enumerate(ders)]
    presented = spark.createDataFrame(rows, "bundle string, nr int, der binary").repartition(3)
    store = spark.createDataFrame([(a,) for a in anchors], "der binary")
    return {r.bundle: r for r in chains.validate(presented, store, host, time).collect()}


def test_fields_against_another_reader(tmp_path, keys):
    der = ca.issue("a name é", "root", keys["leaf"].spki, keys["root"], BEGIN, END, 77, sans=["a.example", "*.b.example"], staple=True, ca=False)
    f = certificates.parsed(der)
    path = tmp_path / "c.pem"
    path.write_text(ca.pem(der))
    other = ssl._ssl._test_decode_cert(str(path))
    assert f["sans"] == [n for _, n in other["subjectAltName"]] and f["cn"] == other["subject"][0][0][1]
    assert f["not_after"].timestamp() == ssl.cert_time_to_seconds(other["notAfter"])
    assert f["must_staple"] and f["is_ca"] is False and f["pubkey_algo"] == "EC" and f["pubkey_bits"] == 256 and f["sigalg"] == "sha256"


def test_signatures_against_another_verifier(tmp_path, keys):
    if not shutil.which("openssl"):
        pytest.skip("no other verifier here")
    cases = {"rsa": leaf(keys, "rsa", "rsa"), "ec": leaf(keys, "ec", "ec"), "bad": leaf(keys, "rsa", "stranger")}
    (tmp_path / "root.pem").write_text(ca.pem(plan.authorities()["root"]))
    (tmp_path / "between.pem").write_text("\n".join(ca.pem(plan.authorities()[n]) for n in ("rsa", "ec")))
    for name, der in cases.items():
        (tmp_path / "leaf.pem").write_text(ca.pem(der))
        command = ["openssl", "verify", "-attime", str(int(datetime.datetime(2026, 1, 15).timestamp())), "-CAfile", tmp_path / "root.pem", "-untrusted", tmp_path / "between.pem", tmp_path / "leaf.pem"]
        assert (subprocess.run(command, capture_output=True).returncode == 0) == (name != "bad")
    for own in ("root", "leaf", "p384"):
        for hash_name in ("sha256", "sha384"):
            s = keys[own].sign(b"text", hash_name)
            assert chains.verifies(keys[own].spki, hash_name, b"text", s) and not chains.verifies(keys[own].spki, hash_name, b"texts", s) and not chains.verifies(keys["stranger"].spki, hash_name, b"text", s)
    assert not chains.verifies(b"", "sha256", b"", b"") and not chains.verifies(keys["root"].spki, "md5", b"text", b"")


def test_chains_case_by_case(spark, keys):
    a = plan.authorities()
    own_root = authority(keys, "other root", "other root", "k0", "k0")
    cross = authority(keys, "rsa", "other root", "rsa", "k0")  # the same authority under a root that is not trusted
    long = [authority(keys, f"c{i}", f"c{i + 1}", f"k{i}", f"k{i + 1}") for i in range(6)]
    bundles = {
        "rsa": [leaf(keys, "rsa", "rsa"), a["rsa"]], "ec": [leaf(keys, "ec", "ec"), a["ec"]], "with the root": [leaf(keys, "rsa", "rsa"), a["rsa"], a["root"]], "any order": [leaf(keys, "rsa", "rsa"), a["root"], a["ec"], a["rsa"], a["rsa"]],
        "withheld": [leaf(keys, "rsa", "rsa")], "expired": [ca.issue("leaf", "rsa", keys["leaf"].spki, keys["rsa"], BEGIN, datetime.datetime(2025, 12, 1), sans=[HOST]), a["rsa"]],
        "self-signed": [ca.issue("leaf", "leaf", keys["leaf"].spki, keys["leaf"], BEGIN, END, sans=[HOST])], "weak": [ca.issue("leaf", "rsa", ca.rsa_key(ca.draw("w", 1024) | 1), keys["rsa"], BEGIN, END, sans=[HOST]), a["rsa"]],
        "forged": [leaf(keys, "rsa", "stranger"), a["rsa"]], "no authority": [leaf(keys, "plain", "ec"), a["plain"]], "too deep for its authority": [leaf(keys, "low", "low"), a["low"], a["rsa"]],
        "cross-signed": [leaf(keys, "rsa", "rsa"), cross, a["rsa"]], "cross-signed only": [leaf(keys, "rsa", "rsa"), cross, own_root], "other name": [leaf(keys, "rsa", "rsa", sans=["a.example"]), a["rsa"]], "no names": [leaf(keys, "rsa", "rsa", sans=None), a["rsa"]],
        "six": [ca.issue("leaf", "c1", keys["leaf"].spki, keys["k1"], BEGIN, END, sans=[HOST]), *long[1:5]], "seven": [ca.issue("leaf", "c0", keys["leaf"].spki, keys["k0"], BEGIN, END, sans=[HOST]), *long[:5]],
        "cut off": [leaf(keys, "rsa", "rsa")[:100], a["rsa"]], "empty": [b""], "null": [None], "critical": [leaf(keys, "rsa", "rsa", more=ca.extension("1.2.3.4", b"\5\0", True)), a["rsa"]],
        "ring": [leaf(keys, "x", "k2"), authority(keys, "x", "y", "k2", "k3"), authority(keys, "y", "x", "k3", "k2")],
    }
    top = authority(keys, "c5", "c5", "k5", "k5")
    got = judge(spark, bundles, [a["root"], top])
    assert set(got) == set(bundles)
    assert {n for n, r in got.items() if r.chain_valid} == {"rsa", "ec", "with the root", "any order", "cross-signed", "six"}
    lengths = {n: r.chain_length for n, r in got.items()}
    assert lengths["rsa"] == lengths["with the root"] == lengths["any order"] == 3 and lengths["six"] == 6 and lengths["withheld"] == 1 and lengths["forged"] == 2 and lengths["seven"] == 6
    assert got["expired"].is_expired and got["self-signed"].is_self_signed and got["no names"].used_cn and not got["no names"].san_match and not got["other name"].san_match
    assert not got["cut off"].leaf_present and got["cut off"].malformed and not got["null"].leaf_present and got["empty"].chain_length == 1
    assert judge(spark, {"a": bundles["rsa"]}, [])["a"].chain_valid is False
    assert not judge(spark, {"a": bundles["rsa"]}, [a["root"]], time="2030-01-01T00:00:00Z")["a"].chain_valid
    nothing = spark.createDataFrame([], "bundle string, nr int, der binary")
    assert chains.validate(nothing, spark.createDataFrame([(a["root"],)], "der binary"), HOST, NOW).count() == 0


def test_an_authority_of_most_bundles(spark, keys):
    a = plan.authorities()
    der = leaf(keys, "ec", "ec")
    rows = spark.range(2000).select(F.col("id").alias("bundle"), F.explode(F.array(F.struct(F.lit(0).alias("nr"), F.lit(der).alias("der")), F.struct(F.lit(1).alias("nr"), F.lit(a["ec"]).alias("der")))).alias("x")).select("bundle", "x.*")
    got = chains.validate(rows, spark.createDataFrame([(a["root"],)], "der binary"), HOST, NOW)
    assert got.where("chain_valid and chain_length = 3").count() == 2000


def test_staples(spark):
    good, revoked = (ca.answer(k, BEGIN, END if k else None) for k in (0, 1))
    rows = [(1, ca.status_message(good), False), (2, ca.status_message(revoked), False), (3, ca.status_message(good), True), (4, b"", False), (5, None, None), (6, ca.status_message(good)[:60], False), (7, b"\x16\x03\x03\xff\xff\x16", False)]
    got = {r.k: r for r in certificates.staples(spark.createDataFrame(rows, "k int, payload binary, opaque boolean"), "k", "opaque").collect()}
    assert [got[k].ocsp_stapled_status for k in range(1, 8)] == ["good", "revoked", "opaque", "unknown", "unknown", "unknown", "unknown"]
    assert got[1].next_update is None and got[2].next_update == datetime.datetime(2027, 1, 1) and got[2].this_update == datetime.datetime(2025, 1, 1)
