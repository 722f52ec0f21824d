import math

import numpy as np
import pytest

from tidegauge.llm import lattice

SCHEMA = "vec_id long, embedding array<float>, label int, kept string"


def brute(rows):
    good = {i: np.array(v, np.float32).astype(float) for i, (k, v, y) in enumerate(rows) if k is not None and y is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    near = {i: [] for i in range(len(rows))}
    for i, v in good.items():
        for j, w in good.items():
            if i != j and rows[i][2] == rows[j][2] and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= lattice.COSINE:
                near[i].append(j)
    out = []
    for i, (k, _, _) in enumerate(rows):
        seen, work = {i}, [i]
        while work:
            for j in near[work.pop()]:
                if j not in seen:
                    seen.add(j)
                    work.append(j)
        least = min(rows[j][0] for j in seen) if k is not None else None
        out.append((k, len(near[i]), least, k == least))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(k, v, y, "x") for k, v, y in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in lattice.near_vectors(df).collect()), key=str)


def make(seed, groups, size, spread):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        centre = rng.normal(size=size)
        centre /= np.linalg.norm(centre)
        for _ in range(int(rng.integers(1, 9))):
            v = centre + spread * rng.normal(size=size) / np.sqrt(size)
            rows.append((len(rows), [float(np.float32(x)) for x in v * rng.uniform(0.5, 2)], g % 3))
    return rows


@pytest.mark.parametrize("limit", [2048, 3])
def test_equals_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(lattice, "GROUP_LIMIT", limit)
    rows = make(1, 25, 64, 0.15)
    v = rows[0][1]
    rows += [(900 + i, v, 0) for i in range(5)] + [(900, v, 0), (950, v, 2), (951, v, None), (None, v, 0)]
    rows += [(960, None, 0), (961, [0.0] * 64, 0), (962, [float("nan")] * 64, 0), (963, [None] * 64, 0), (964, [], 0), (965, [1.0, 2.0], 0), (966, [2.0, 4.0], 0)]
    assert run(spark, rows) == brute(rows)


def test_recall_near_the_threshold(spark):
    rows = make(2, 120, 64, 0.27)
    got, want = ({r[0]: r for r in x} for x in (run(spark, rows), brute(rows)))
    assert all(got[k][1] <= want[k][1] for k in want)
    assert sum(r[1] for r in got.values()) >= 0.98 * sum(r[1] for r in want.values()) > 300


def test_decoder_finds_the_nearest_point():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 8)) * 3
    own = lattice.nearest_e8(x)
    assert (((x - own) ** 2).sum(1) <= 1 + 1e-9).all()  # the covering radius
    others = own[:, None, :] + lattice.NEIGHBOURS[None, :, :]
    assert (((x[:, None, :] - others) ** 2).sum(2).min(1) >= ((x - own) ** 2).sum(1) - 1e-9).all()
    assert len(lattice.NEIGHBOURS) == 240 and np.allclose((lattice.NEIGHBOURS**2).sum(1), 2)


def test_empty(spark):
    assert run(spark, []) == []
