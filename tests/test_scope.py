"""Addresses against the standard library, and opt-outs as names and reports word them."""

import ipaddress
import random
import re

import pytest
from pyspark.sql import functions as F

from tidegauge.functions import net
from tidegauge.operators import scope as S

SPELT = ["::", "::1", "1::", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8", "1::8", "::ffff:1.2.3.4", "64:ff9b::192.0.2.33", "FE80::ABCD", "1:2:3:4:5:6:1.2.3.4", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "8000::"]
BAD = [":::", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "12345::", "g::", "1.2.3", "1.2.3.4.5", "::1.2.3.256", "1:2:3:4:5:6:7:8::", ":1", "1:", "", " ::1", "::ffff:1.2.3.4:5", None]


def column(spark, texts, made):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "x string").select(made(F.col("x"))).collect()]


def random_addresses():
    r = random.Random(3)
    six = [ipaddress.IPv6Address(r.getrandbits(128) & r.choice([-1, (1 << 64) - 1, ~((1 << 80) - 1), 0xFFFF << 48])) for _ in range(300)]
    return [*map(str, six), *[a.exploded for a in six], *[str(ipaddress.IPv4Address(r.getrandbits(32))) for _ in range(200)]]


def test_halves_equal_the_library(spark):
    texts = [t for t in [*SPELT, *random_addresses()] if ":" in t]
    for text, got in zip(texts, column(spark, texts, net.ipv6_halves)):
        n = int(ipaddress.IPv6Address(text))
        assert (got.hi & (1 << 64) - 1, got.lo & (1 << 64) - 1) == (n >> 64, n & (1 << 64) - 1), text
    assert column(spark, BAD, net.ipv6_halves) == [None] * len(BAD)
    assert column(spark, BAD, net.dialled_scope) == [None] * len(BAD)


def test_scope_and_buckets_equal_the_library(spark):
    blocks = [ipaddress.ip_network(b) for b in net.OUT_OF_SCOPE]
    texts = [*SPELT, *random_addresses(), "224.0.0.1", "255.255.255.255", "100.64.0.1", "172.32.0.1", "febf::", "fec0::1", "ff02::1", "::ffff:10.0.0.1", "::ffff:8.8.8.8"]
    scoped, buckets = column(spark, texts, net.dialled_scope), column(spark, texts, net.source_bucket)
    for text, inside, bucket in zip(texts, scoped, buckets):
        ip = ipaddress.ip_address(text)
        seen = getattr(ip, "ipv4_mapped", None) or ip
        assert inside == (not any(seen in b for b in blocks if b.version == seen.version)), text
        assert bucket == (text if ip.version == 4 else str(ipaddress.ip_network((ip, 64), strict=False))), text


def test_longest_block_without_a_nested_loop(spark):
    texts = random_addresses() + BAD + ["10.0.0.1", "10.0.0.1"]
    names = ["10.0.0.0/8", "10.0.0.0/30", "0.0.0.0/1", "128.0.0.0/3", "::/1", "8000::/1", "::/64", "::/0"]
    blocks = spark.createDataFrame([(b, *r) for b, r in zip(names, net.block_rows(names))], "block string, family int, length int, hi long, lo long")
    found = S.in_blocks(spark.createDataFrame([(t,) for t in texts], "address string"), blocks)
    rows = found.collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = None
        if r.address not in BAD:
            ip = ipaddress.ip_address(r.address)
            ip = getattr(ip, "ipv4_mapped", None) or ip
            nets = [n for n in map(ipaddress.ip_network, names) if n.version == ip.version and ip in n]
            want = str(max(nets, key=lambda n: n.prefixlen)) if nets else None
        assert r.block == want, r.address
    assert not re.search("NestedLoop|Cartesian", found._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize(
    ("record", "scope"),
    [("opt-out", None), ("OptOut", None), ("v=one; opt-out", None), ("opt-out=4201", 4201), ("opt-out:4201", 4201), ("opt-out=4200,4201,4202", 4201), ("opt-out=all", None), ("opt-out=*", None), ("opt-out=4200 opt-out=4201", 4201)],
)
def test_records_that_ask(spark, record, scope):
    got = spark.createDataFrame([(["v=spf1", record],)], "r array<string>").select(S.record_opt_out(F.col("r"), F.lit(4201)).alias("o")).first().o
    assert (got.scope, got.record) == (scope, record)


@pytest.mark.parametrize("records", [["opt-out=4202"], ["opted-out"], ["noopt-out"], ["opt-outs"], ["opt-out=,"], [""], [], None])
def test_records_that_do_not(spark, records):
    assert spark.createDataFrame([(records,)], "r array<string>").select(S.record_opt_out(F.col("r"), F.lit(4201)).alias("o")).first().o is None


def test_reports(spark):
    rows = [({"CRAWL_OPT_OUT": ["1"]},), ({"TIDEGAUGE OPT-OUT": [" No "], "TIDEGAUGE_OPT_OUT": ["yes"]},), ({"TIDEGAUGE OPT-OUT": ["off"]},), ({"TIDEGAUGE OPT-OUT": []},), ({},), (None,)]
    got = [r[0] and tuple(r[0]) for r in spark.createDataFrame(rows, "m map<string, array<string>>").select(S.report_opt_out(F.col("m"), "tidegauge")).collect()]
    assert got == [("CRAWL_OPT_OUT", "1"), ("TIDEGAUGE_OPT_OUT", "yes"), None, None, None, None]


def test_the_gate_keeps_what_was_not_answered(spark):
    targets = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 1), ("d", 1), ("e", 1)], "host string, port int")
    outs = [("a", 1, "request", 5, None), ("a", None, "dns_txt", 1, None), ("b", None, "dns_txt", 1, None), ("c", 1, "dns_txt", 1, None), ("d", 1, "mssp", 1, 9)]
    made = spark.createDataFrame(outs, "host string, port int, source string, r int, w int").selectExpr("host", "port", "source", "CAST(timestamp_seconds(r) AS TIMESTAMP_NTZ) AS recorded_at", "CAST(timestamp_seconds(w) AS TIMESTAMP_NTZ) AS withdrawn_at")
    answers = spark.createDataFrame([("a", True, []), ("b", False, None), ("c", True, ["nothing"]), ("d", True, ["opt-out"])], "host string, answered boolean, records array<string>")
    got = {(r.host, r.port): (r.ruling, r.may_dial) for r in S.gate(targets, made, answers).collect()}
    assert got == {
        ("a", 1): ("withdrawn_other_stands", False), ("a", 2): ("withdrawn", True), ("b", 1): ("unanswered_standing", False), ("c", 1): ("withdrawn", True),
        ("d", 1): ("recorded", False), ("e", 1): ("unanswered_free", True),
    }
