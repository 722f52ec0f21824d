import math
import random
import re
from collections import Counter

import pytest

from tidegauge.llm import ranked

DOCS, ITEMS = "doc_id long, text string, score int, item int", "item_id long, text string, rank int"


def terms(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def brute(docs, items, k=10):
    counted = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n_docs, total = sum(n > 0 for *_, n in counted), sum(n for *_, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in counted:
            if n:
                m = 100 - 75 + 75 * n * n_docs // total
                score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
                if score > 0:
                    scores.append((-score, math.inf if i is None else i))
        out += [(item, r + 1, None if i == math.inf else i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def found(spark, docs, items, k=10, proofs=None):
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], DOCS).repartition(3)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS)
    out = ranked.search(d, q, k, proofs)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def tables(n=400):
    r = random.Random(4)
    common, rare = ["the", "of", "a", "tide"], [f"w{i}" for i in range(500)] + ["ÉTÉ", "été", "日本", "x9", "ß"]
    docs = [(i, " ".join([*r.choices(common, k=r.randint(0, 40)), *r.choices(rare, k=r.randint(0, 30))])) for i in range(n)]
    passage = " ".join(r.choices(rare, k=12)) + " the tide"
    docs += [(1000 + i, passage) for i in range(25)] + [(2000 + i, passage.upper() + " and more") for i in range(4)]
    docs += [(5, None), (6, ""), (7, "-- .."), (None, passage), (None, "w1 w2"), (8, docs[3][1]), (8, docs[3][1]), (9, "the " * 20_000), (-3, "w7 w7 w7")]
    items = [(1, passage), (1, passage), (2, "the"), (3, "unknown words"), (4, None), (5, ""), (None, "w1 w2 w2"), (6, "The THE the tide of"), (7, docs[11][1]), (8, "w7"), (9, "日本 x9 ß")]
    return docs, items + [(10 + i, " ".join([*r.choices(common, k=5), *r.choices(rare, k=8)])) for i in range(40)]


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(ranked, "GROUP_DOCS", 11)
        monkeypatch.setattr(ranked, "ITEMS", 7)
    docs, items = tables()
    proofs = []
    assert found(spark, docs, items, proofs=proofs) == brute(docs, items)
    assert len(proofs) > 1 and sum(p > 0 for p in proofs) > 1  # some items are proven early, some fall through


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(ranked, "TERMS", 30)
    docs, items = tables(60)
    monkeypatch.setattr(ranked.item_blocks, "__defaults__", (30,))
    assert found(spark, docs, items[:20], k=3) == brute(docs, items[:20], k=3)


def test_empty_tables_and_few_documents(spark):
    docs, items = tables(20)
    assert found(spark, [], items) == []
    assert found(spark, docs, []) == []
    assert found(spark, [(1, None), (2, "")], items) == []
    few = [(1, "one two"), (2, "two three"), (3, "one")]
    assert found(spark, few, items + [(99, "one two two")]) == brute(few, items + [(99, "one two two")])
