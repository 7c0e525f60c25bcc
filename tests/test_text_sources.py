import json

from tidemark.sources import text

TABLE = """# Families
| Family | Group | TLS |
|---|---|---|
| family-01 | a | TLS1.2 |
| family-02 | b |  |
| short |
after
| Family | late | row |
"""


def test_pipe_table(spark, tmp_path):
    (tmp_path / "t.md").write_text(TABLE)
    got = text.pipe_table(text.numbered_lines(spark, str(tmp_path)), "Family", 3).orderBy("nr").collect()
    assert [r.cells for r in got] == [["family-01", "a", "TLS1.2"], ["family-02", "b", ""]]


def test_manifest(spark):
    df = spark.createDataFrame([('{"family-01": {"port": 25}, "family-02": {"port": null}}',), (None,)], "text string")
    assert {(r.family, r.entry.port) for r in text.manifest(df, "struct<port:int>").collect()} == {("family-01", 25), ("family-02", None)}


def test_documents_are_judged(spark, tmp_path):
    good = {"flow_id": "family-01", "app_protocol": "smtp", "tls": {"version": "TLS1.2"}, "cert": {"leaf_present": True, "is_tls13_opaque": False}}
    cases = {"good": good, "word": good | {"app_protocol": "http"}, "range": good | {"coverage_ratio": 1.5}, "opaque": good | {"cert": {"leaf_present": False, "is_tls13_opaque": True, "chain_length": 2}}, "extra": good | {"more": 1}, "inner": good | {"tls": {"version": "TLS1.2", "ja5": "x"}}}
    for name, d in cases.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(d))
    (tmp_path / "broken.json").write_text("{nothing")
    held, refused = text.documents(spark, str(tmp_path))
    assert [r.flow_id for r in held.collect()] == ["family-01"]
    assert {r.file.rsplit("/", 1)[-1].split(".")[0]: r.reason for r in refused.collect()} == {"word": "app_protocol outside vocabulary", "range": "coverage_ratio outside range", "opaque": "opaque certificate with details", "broken": "no document", "extra": "unknown key more", "inner": "unknown key ja5"}
