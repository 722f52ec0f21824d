import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import simhash
from tidegauge.llm._shared import connected_components

DOCS = "doc_id long, text string, extra int, fp string, component_id int"


def brute(pairs):
    """Component by comparing everything with everything: {row: smallest id reachable}."""
    n = len(pairs)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if ((pairs[i][1] ^ pairs[j][1]) & (2**64 - 1)).bit_count() <= simhash.MAX_DISTANCE:
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(pairs):
        r = find(i)
        if key is not None:
            least[r] = min(key, least.get(r, key))
    return [least.get(find(i)) for i in range(n)]


def test_every_half_has_an_anchor_within_the_covering_radius():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 2**63, 500).astype(np.int64)
    cell, row = simhash.anchors(words)
    halves = np.where(cell >> 32 & 1, words[row].view(np.uint64) >> np.uint64(32), words[row].view(np.uint64) & np.uint64(2**32 - 1))
    distance = np.bitwise_count(halves ^ (cell.view(np.uint64) & np.uint64(2**32 - 1)))
    assert distance.max() == simhash.COVERING_RADIUS + 1
    for half in (0, 1):
        for k in range(500):
            assert distance[(row == k) & (cell >> 32 == half)].min() <= simhash.COVERING_RADIUS


@pytest.mark.parametrize("limit", [20_000, 5])
def test_components_equal_brute_force(spark, limit):
    rng = np.random.default_rng(2)
    fps = [0, -1]
    for _ in range(40):
        centre = int(rng.integers(-(2**63), 2**63))
        fps.append(centre)
        for _ in range(int(rng.integers(0, 12))):
            x = centre
            for bit in rng.integers(0, 64, int(rng.integers(0, 7))):
                x ^= (1 << int(bit)) if bit < 63 else -(2**63)
            fps.append(x)
    fps = sorted(set(fps))
    frame = spark.createDataFrame([(x,) for x in fps], "fp long").repartition(3)
    roots = {r.node: r.root for r in connected_components(simhash.links(frame, cell_limit=limit)).collect()}
    got = [roots.get(x, x) for x in fps]
    assert got == brute([(x, x) for x in fps])


def test_documents(spark):
    base = "one two three four five six seven eight nine ten eleven twelve"
    rows = [
        (5, base), (3, base.upper()), (9, base + " "), (9, base), (None, base), (1, None), (2, ""), (4, " \t\n"),
        (7, "Lone"), (8, "lone"), (10, "é É"), (11, "other words " * 5000), (12, "other words " * 5000), (None, "nothing like it"),
    ]
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], DOCS)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.classes(docs).collect()), key=str)
    fps = [simhash.fingerprint(t.encode() if t else None) for _, t in rows]
    want = sorted(((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, brute([(i, f) for (i, _), f in zip(rows, fps)]))), key=str)
    assert got == want
    assert simhash.fingerprint(None) == 0 and simhash.fingerprint(b"A b") == simhash.fingerprint(b"a  B\x0b")
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted({c for _, _, c in got} - {None})
    assert kept.where("doc_id is null").count() == 2


def test_hash_is_sparks_own(spark):
    import xxhash

    row = spark.createDataFrame([("ein zwei drei vier",)], "t string").select(F.xxhash64("t").alias("h")).first()
    assert row.h % 2**64 == xxhash.xxh64_intdigest("ein zwei drei vier".encode(), simhash.SEED)


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert simhash.classes(docs).count() == 0 and simhash.keep_first(docs).count() == 0


def test_rows_that_share_a_doc_id_stay_by_class(spark):
    texts = [" ".join(f"{c}{k}" for k in range(60)) for c in "abc"]
    rows = [(1, texts[0]), (2, texts[0]), (2, texts[1]), (3, texts[1]), (5, texts[2]), (5, texts[2]), (1, " ".join(f"d{k}" for k in range(60)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in simhash.keep_first(docs).collect())
    assert got == sorted({rows[0], rows[2], rows[4], rows[6]})
