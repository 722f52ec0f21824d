"""Addresses, hashes and records, on rows that the tables do not hold."""

import hashlib
import hmac

from pyspark.sql import functions as F

from tidegauge.functions import net
from tidegauge.sources import records as R


def values(spark, rows, column, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], schema).select(column).collect()]


def test_addresses_of_both_families(spark):
    texts = ["8.8.8.8", "10.1.2.3", "2a00:1450::1", "::1", "fe80::1", "256.1.1.1", "", None]
    assert values(spark, texts, net.dialled_scope(F.col("x"))) == [True, False, True, False, False, None, None, None]
    assert values(spark, texts[:5], net.source_bucket(F.col("x"))) == ["8.8.8.8", "10.1.2.3", "2a00:1450::/64", "::/64", "fe80::/64"]
    assert values(spark, texts, net.routable_ipv4(F.col("x"))) == [True, False] + [None] * 6


def test_keyed_hash_is_hmac(spark):
    texts = ["", "a", "Straße 中", "x" * 1000]
    for key in (b"", b"k", b"long" * 40):
        assert values(spark, texts, net.keyed_hash(key, F.col("x"))) == [hmac.new(key, t.encode(), hashlib.sha256).hexdigest() for t in texts]
    assert values(spark, [None], net.keyed_hash(b"k", F.col("x"))) == [None]


def test_last_value_of_nothing_is_null(spark):
    rows = [{"players": []}, {"Players": ["1", "2"]}, {}, None]
    assert values(spark, rows, R.last_value(F.col("x"), "PLAYERS"), "x map<string,array<string>>") == [None, "2", None, None]


def test_a_session_is_decoded_in_one_way(spark):
    rows = [("u", "é".encode()), ("u", None), ("l", b"\xe9"), ("l", "é".encode()), (None, b"a\0b"), ("e", b"")]
    got = R.decoded(spark.createDataFrame(rows, "session string, payload binary"), "session", "payload").collect()
    assert sorted(((r.session, r.text) for r in got), key=repr) == sorted([("u", "é"), ("u", None), ("l", "é"), ("l", "Ã©"), (None, "ab"), ("e", "")], key=repr)


def test_files_of_records(spark, tmp_path):
    (tmp_path / "list.json").write_text('{"name": "a", "services": {"WHO": "0"}}\n{"name": "b", "services": {"who": "3"}}\n{"name": "c"}\n')
    assert {r.name: r.answers_who for r in R.gateway(spark, str(tmp_path / "list.json")).collect()} == {"a": False, "b": True, "c": False}
    (tmp_path / "seeds.txt").write_text("# none\nOne.example:23\none.example 23\nbad host name : x\ntwo.example:99999\n")
    assert [tuple(r) for r in R.seeds(spark, str(tmp_path / "seeds.txt")).collect()] == [("one.example", 23)]
    (tmp_path / "doc.md").write_text("---\ntitle: A: b\nplain\n---\nBody\n---\n")
    (tmp_path / "bare.md").write_text("Body")
    got = {r.path.rsplit("/")[-1]: (r.meta, r.body) for r in R.front_matter(spark, f"{tmp_path}/*.md").collect()}
    assert got == {"doc.md": ({"title": "A: b"}, "Body\n---\n"), "bare.md": ({}, "Body")}


def test_many_documents_in_one_file(spark, tmp_path):
    (tmp_path / "all.md").write_text("---\ntitle: A\n---\nOne\n\nmore\x1e---\ntitle: B\n---\nTwo\x1eBare", newline="")
    got = sorted((r.meta.get("title") or "", r.body) for r in R.front_matter(spark, str(tmp_path / "all.md"), R.SEPARATOR).collect())
    assert got == [("", "Bare"), ("A", "One\n\nmore"), ("B", "Two")]


def test_documents_are_not_a_file_each(spark):
    from tidegauge.plans import QUERIES

    found = QUERIES["records_read"](spark, "/root/testdata/sf0.001")
    assert 0 < len([f for f in found.inputFiles() if "/documents/" in f]) <= 4
