import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import time
import tracemalloc
import urllib.parse
import zlib

import pytest
import zstandard

from tidegauge.llm import secrets as S

SECRET = "password=hunter2hunter2"


def spans(text):
    return S._written(S.all_spans(text, S.base_spans(text))).split(",")


def b64(raw):
    return base64.b64encode(raw if isinstance(raw, bytes) else raw.encode()).decode()


def brute_base(text):
    """The contract, kind by kind, with plain patterns."""
    kinds = [
        ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        ("access", r"AKIA[A-Z0-9]+", 0, 20),
        ("hex", r"[0-9a-f]+", 0, 24),
    ]
    found = [(m.start(), k, m.end()) for k, (_, p, g, least) in enumerate(kinds) for m in re.finditer(p, text) if len(m.group(g)) >= least]
    return ",".join(f"{kinds[k][0]}:{a}:{b}" for a, k, b in sorted(found))


@pytest.mark.parametrize(
    "text",
    [
        "", "é password = 'abcdef' token:abc secret:token:abcdefgh", "PaSSwd\"  :  \"x.y=z/+-", "api_key=abcdef apikey=abcdef api__key=abcdef",
        "AKIA" + "A" * 15, "AKIA" + "A" * 16, "xAKIAAKIA" + "B" * 20, "0123456789abcdef01234567", "0123456789abcdef0123456", "paſſword=abcdef toKen=abcdef",
        "password=" + "a" * 30 + "b", "token= \n abcdef", "secret" + " " * 50 + "=" + " " * 50 + "abcdefg",
    ],
)
def test_base_spans(text):
    assert S._written(S.base_spans(text)) == brute_base(text)


@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.compress, lambda x: gzip.compress(bz2.compress(x))])
def test_compressed_layers(pack):
    text = f"see {b64(pack(SECRET.encode() * 3))} end"
    assert f"assign:4:{len(text) - 4}" in spans(text)


def test_nested_layers_map_back():
    inner = urllib.parse.quote(SECRET, safe="").replace("p", "%70")
    text = "ü " + inner + " tail"
    assert spans(text) == [f"assign:2:{2 + len(inner)}"]
    twice = "a " + urllib.parse.quote(inner)
    assert spans(twice) == [f"assign:2:{len(twice)}"]
    escaped = "".join(f"\\u{ord(c):04x}" for c in SECRET)
    assert spans("zz " + escaped) == [f"assign:3:{3 + len(escaped)}"]
    refs = "".join(f"&#{ord(c)};" for c in SECRET)
    assert spans("zz " + refs) == [f"assign:3:{3 + len(refs)}"]
    deep = b64("x " + b64("y " + urllib.parse.quote(urllib.parse.quote(SECRET, safe=""), safe="") + " y") + " x")
    assert f"assign:2:{2 + len(deep)}" in spans("- " + deep + " -")
    both = f"{b64(SECRET)} and {b64(SECRET)}"
    n = len(b64(SECRET))
    assert spans(both) == [f"assign:0:{n}", f"assign:{n + 5}:{2 * n + 5}"]
    assert "assign:0:4" not in spans("%2525252525252525252541 \\ud83d\\ude00 %ff %e4%b8%ad &#99999999;")


def test_a_mixed_span_keeps_its_plain_part():
    text = "pass%77ord=abcdefgh and more"
    assert spans(text) == ["assign:0:19"]


def test_cycle_ends(monkeypatch):
    # data that decompress to themselves
    monkeypatch.setattr(S, "_inflated", lambda raw: iter([raw]) if raw[:2] == b"\x1f\x8b" else None)
    assert S.all_spans(b64(b"\x1f\x8b" + b"\xff" * 40), []) == []


def test_long_text_and_windows():
    filler = "wörd " * 100_000
    text = filler + SECRET
    assert spans(text) == [f"assign:{len(filler)}:{len(text)}"]
    big = b64(gzip.compress(("lorem ipsum " * 400_000 + SECRET).encode()))
    assert f"assign:0:{len(big)}" in spans(big)


def test_query(spark):
    rows = [(1, SECRET, "x"), (1, SECRET, "x"), (None, None, None), (3, "", "y"), (4, b64(SECRET), "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {(r.doc_id, r.n_assign, r.base_sha256, r.spans) for r in S.secrets_digest(docs).collect()}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == {(1, 1, digest("assign:0:23"), "assign:0:23"), (None, 0, digest(""), ""), (3, 0, digest(""), ""), (4, 0, digest(""), "assign:0:32")}
    assert S.secrets_digest(docs).count() == 5
    assert S.secrets_digest(docs.limit(0)).count() == 0


PACKS = [gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.compress]


@pytest.mark.parametrize("pack", PACKS)
def test_all_members_of_a_stream(pack):
    for raw in (pack(b"first " * 9) + pack(b"second") + pack(SECRET.encode()), pack(b"first " * 9) + bytes(512) + gzip.compress(SECRET.encode())):
        text = b64(raw)
        assert f"assign:0:{len(text)}" in spans(text)
    cut = b64(pack(SECRET.encode() * 40) + b"no compressed data")
    assert f"assign:0:{len(cut)}" in spans(cut)


@pytest.mark.parametrize("pack", PACKS)
def test_streams_over_a_window(pack):
    noise = random.Random(5).randbytes(3 << 20)
    deep = b64(gzip.compress(pack(noise + SECRET.encode() + noise[:99]), 1))
    assert f"assign:0:{len(deep)}" in spans(deep)


def test_base64_runs_over_a_window():
    rng = random.Random(6)
    inner = base64.encodebytes(gzip.compress(rng.randbytes(90_000) + SECRET.encode(), 1)).strip()
    long = b64(bz2.compress(rng.randbytes(6 << 20) + SECRET.encode(), 1)).encode()
    for at in range(S.WINDOW - len(inner) + 900, S.WINDOW, 40_000):
        text = b64(gzip.compress(b"x " * (at // 2) + inner + b" end", 1))
        assert f"assign:0:{len(text)}" in spans(text)
    text = b64(gzip.compress(b"x " * 9_999 + long + b"\nend", 1))
    assert f"assign:0:{len(text)}" in spans(text)


@pytest.mark.parametrize("prefix", ["backup/", "io/d/", "payload_", "a/b/c/", "x-", "some-longer-name_of_it/"])
def test_base64_behind_a_path_or_name(prefix):
    for raw in [SECRET.encode(), *[pack(SECRET.encode()) for pack in PACKS]]:
        text = f"see {prefix}{b64(raw)} end"
        assert f"assign:4:{len(text) - 4}" in spans(text)


def test_secrets_in_decoded_records():
    for raw in (b"\0\x01" + SECRET.encode() + b"\0", b"\xff\xfe" + SECRET.encode() + b"\x80", b"\0" + b64(b"\0" + SECRET.encode()).encode()):
        text = b64(raw)
        assert spans(text) == [f"assign:0:{len(text)}"]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_last_line_of_a_wrapped_run(end):
    for n in range(57, 120):
        raw = ("é" * 99 + " " * n)[-n:].encode()[-n:] + SECRET.encode()
        wrapped = end.join(re.findall(".{1,76}", b64(raw)))
        text = f"{wrapped} end"
        assert spans(text) == [f"assign:0:{len(wrapped)}"]


def test_thousands_of_nested_layers():
    raw = SECRET.encode()
    for k in range(2000):
        raw = [gzip.compress, zlib.compress][k % 2](raw)
    text = b64(raw)
    began = time.monotonic()
    assert f"assign:0:{len(text)}" in spans(text)
    assert time.monotonic() - began < 20
    turns = SECRET
    for _ in range(12):
        turns = b64(gzip.compress(turns.encode()))
    assert f"assign:0:{len(turns)}" in spans(turns)


def test_what_inflates_much_takes_little_memory():
    text = b64(gzip.compress(b"lorem ipsum " * 8_000_000 + SECRET.encode()))
    nested = b64(gzip.compress(gzip.compress(b"lorem ipsum " * 8_000_000 + SECRET.encode())))
    for value in (text, nested):
        tracemalloc.start()
        assert f"assign:0:{len(value)}" in spans(value)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 60 << 20  # of 96 MB inflated
