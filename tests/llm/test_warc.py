import gzip
import hashlib
from pathlib import Path

import pytest

from tidegauge.llm import warc

SCHEMA = "page_id long, url string, html string, payload string, digest int, shard int"


def rows():
    big, other = "é" * 700, "x" * 1000
    return [
        (5, "http://a/é\r\nX: 1", big), (9, "http://b", big), (2, None, big), (7, "u", other), (8, "u", "x" * 999), (1, "u", "x" * 999), (3, "u", None), (4, "u", ""),
        (6, "u", other + "\r\n\r\nWARC/1.1"), (7, "u", other), (10**15, "u", "ends"), (-4, "u", other), (None, "u", other), (20, "u", "long " * 200_000),
    ]


def frame(spark, data, parts=3):
    return spark.createDataFrame([(*r, "p", 1, 2) for r in data], SCHEMA).repartition(parts)


def brute(data):
    out, done = [], set()
    for page_id, _, html in data:
        raw = (html or "").encode()
        same = [p for p, _, h in data if (h or "").encode() == raw and p is not None]
        top = max(same, default=None)
        revisit = page_id is not None and len(raw) >= 1000 and len(same) > 1 and (page_id != top or (page_id, raw) in done)
        done.add((page_id, raw))
        out.append((page_id, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize(("shard", "file"), [(256 << 20, 64 << 20), (2500, 700), (1, 1)])
def test_round_trip(spark, monkeypatch, shard, file):
    monkeypatch.setattr(warc, "SHARD_BYTES", shard)
    monkeypatch.setattr(warc, "PLACES", 4 if shard < 10_000 else 4096)
    monkeypatch.setattr(warc, "FILE_BYTES", file)
    assert sorted((tuple(r) for r in warc.round_trip(frame(spark, rows())).collect()), key=str) == brute(rows())


def test_same_bytes_whatever_the_partitions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SHARD_BYTES", 2500)
    seen = []
    for k, parts in enumerate((1, 5)):
        folder = tmp_path / str(k)
        manifest = warc.write_warc(frame(spark, rows(), parts), folder.as_uri())
        seen.append({p.name: p.read_bytes() for p in folder.glob("*.warc.gz")})
        listed = {r.name: r for r in manifest.collect()}
        assert set(listed) == set(seen[-1]) and not any((folder / "_temporary").iterdir())
        assert all(hashlib.sha256(raw).hexdigest() == listed[n].sha256 and len(raw) == listed[n].bytes for n, raw in seen[-1].items())
    assert seen[0] == seen[1] and len(seen[0]) > 1
    back = {r.page_id: r for r in warc.read_warc(manifest, folder.as_uri()).where("record_type = 'response'").collect()}
    assert back[5 + 4].payload.decode() == "é" * 700 and back[3].payload == b""
    assert sum(gzip.decompress(raw).count(b"WARC/1.1\r\nWARC-Type") for raw in seen[0].values()) == len(rows())


def test_a_lost_file_is_noticed(spark, tmp_path):
    manifest = warc.write_warc(frame(spark, rows()), tmp_path.as_uri())
    name = manifest.first().name
    path = Path(tmp_path / name)
    raw = path.read_bytes()
    member = gzip.compress(gzip.decompress(raw).replace(b"xxxx", b"yyyy"))
    path.write_bytes(member)
    with pytest.raises(Exception, match="damaged|content-length|invalid"):
        warc.read_warc(manifest, tmp_path.as_uri()).collect()


def test_empty(spark):
    assert warc.round_trip(frame(spark, rows()).limit(0)).count() == 0
