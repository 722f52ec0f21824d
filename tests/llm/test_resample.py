import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidegauge.llm.resample import gains, resample, ring

SCHEMA = "doc_id long, text string, score int, rank int"


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def features_of(text, longest):
    words = words_of(text)
    return [zlib.crc32(" ".join(words[i : i + n]).encode()) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(rows, targets, longest=2, buckets=10_000, share=25):
    source, target = Counter(), Counter()
    for _, text in rows:
        source.update(f % buckets for f in features_of(text, longest))
    for text in targets:
        target.update(f % buckets for f in features_of(text, longest))
    total, wanted = sum(source.values()), sum(target.values())
    out = []
    for i, text in rows:
        found = [f % buckets for f in features_of(text, longest)]
        gain = [math.floor(1000 * math.log((target[b] + 1) * (total + buckets) / ((source[b] + 1) * (wanted + buckets)))) for b in found]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(text)) >= 20])
    drawn = sorted((r for r in out if r[5]), key=lambda r: (-r[3], math.inf if r[0] is None else r[0], r[1], r[2]))
    for k, r in enumerate(drawn[: share * len(drawn) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def found(spark, rows, targets, **how):
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], SCHEMA).repartition(5)
    target = spark.createDataFrame([(t,) for t in targets], "text string")
    out = resample(docs, target, **how)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def sample_rows(n=300):
    r = random.Random(9)
    vocabulary = ["Tide", "GAUGE", "öl", "naïve", "x2", "日本", "k", "İ", "été", *[f"w{i}" for i in range(60)]]
    rows = [(i * 3, " ".join(r.choices(vocabulary, k=r.randint(0, 60))) + r.choice(["", ".", "\n--"])) for i in range(n)]
    return rows + [(5, None), (6, ""), (7, "._-"), (None, "word " * 30), (9, rows[0][1]), (9, rows[0][1]), (10, "lone"), (12, "very long " * 50_000), (13, "same words " * 15), (16, "same words " * 15)]


@pytest.mark.parametrize("how", [{}, {"longest": 4, "buckets": 97}, {"longest": 1, "buckets": 70_000, "share": 60}])
def test_equals_brute_force(spark, how):
    rows, targets = sample_rows(), ["tide gauge öl w1 w2", None, "", "W3 w3 w3 same words"]
    assert found(spark, rows, targets, **how) == brute(rows, targets, **how)


def test_empty_tables(spark):
    assert found(spark, [], ["some words"]) == []
    rows = sample_rows(40)
    assert found(spark, rows, []) == brute(rows, [])
    assert found(spark, [(1, None), (2, "few")], [None]) == brute([(1, None), (2, "few")], [])


def test_ring_runs():
    n, buckets = ring("A b  Cé b".encode(), 3, 10_000)
    want = ["a", "b", "a b", "cé", "b cé", "a b cé", "b", "cé b", "b cé b"]
    assert n == 4 and list(buckets) == [zlib.crc32(w.encode()) % 10_000 for w in want]


def test_gains_at_scale():
    big = np.full(4, 10**15, np.int64)
    assert list(gains(big, big)) == [0, 0, 0, 0] or set(gains(big, big)) <= {0, -1}
