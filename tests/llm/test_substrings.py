import random
from itertools import pairwise

from tidegauge.llm import substrings
from tidegauge.llm.chunks import least_limits

SCHEMA = "doc_id long, text string, start string, words int"


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstuéö") for _ in range(rng.randint(1, 10)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(55) for _ in range(20)]
    line = prose(12)
    rows = {}
    for i in range(100):
        rows[i] = prose(rng.randint(1, 300))
        if i % 5 == 0:
            rows[i] += " " + passages[i // 5] + " " + prose(40)
        if i % 5 == 1:
            rows[i] = prose(rng.randint(0, 9)) + " " + passages[i // 5] + " " + rows[i]
        if i % 3 == 0:
            rows[i] += "\n" + line
    rows[200] = rows[7]
    return rows, passages


def brute(rows):
    """Runs of chunks that occurred before, by plain dictionaries."""
    first = {}
    for i in sorted(rows):
        raw = (rows[i] or "").encode()
        for a, b in pairwise(least_limits(raw, substrings.REACH)):
            first.setdefault(raw[a:b], (i, a))
    out = []
    for i in sorted(rows):
        raw = (rows[i] or "").encode()
        run = None
        for a, b in [*pairwise(least_limits(raw, substrings.REACH)), (0, 0)]:
            at = first.get(raw[a:b])
            if b and at != (i, a):
                words = sum(c in b" \n\t\r" for c in raw[a:b])
                run = [a, b, words, at[0]] if run is None else [run[0], b, run[2] + words, min(run[3], at[0])]
            elif run is not None:
                if run[2] >= substrings.LEAST_WORDS:
                    out.append((i, *run))
                run = None
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1) for i, t in rows], SCHEMA).repartition(4)


def test_equals_brute_force_and_finds_passages(spark):
    rows, passages = corpus()
    got = sorted(tuple(r) for r in substrings.repeats(frame(spark, rows.items())).collect())
    assert got == brute(rows)
    assert {r[0] for r in got} == {i for i in range(100) if i % 5 == 1} | {200}
    assert all(r[4] == r[0] - 1 for r in got if r[0] < 100)
    docs = frame(spark, [*rows.items(), (None, passages[0])])
    left = substrings.remove_repeats(docs)
    assert left.columns == docs.columns
    texts = {r.doc_id: r.text for r in left.collect()}
    assert texts[None] == passages[0] and len(texts[200]) < 100 and texts[0] == rows[0]
    assert all(len(texts[i]) < len(rows[i]) - 150 for i in range(100) if i % 5 == 1)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a"), (4, "word " * 20_000), (5, "word " * 20_000), (5, "word " * 20_000), (None, "x " * 400), (None, "x " * 400)]
    got = substrings.repeats(frame(spark, rows)).collect()
    assert {r.doc_id for r in got} <= {4, 5}
    assert substrings.remove_repeats(frame(spark, rows)).count() == len(rows)
    assert substrings.repeats(frame(spark, rows).limit(0)).count() == 0


def test_passages_of_just_over_fifty_words_to_their_ends(spark):
    """Against plain words: every planted passage, wherever the chunks fall, and nothing shorter."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstuéö") for _ in range(rng.randint(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    rows, planted = {}, {}
    for i in range(0, 400, 2):
        passage = prose(51 if i % 4 else 40)
        for k in (i, i + 1):
            head = prose(60) + f" {k}# "
            rows[k] = head + passage + f" #{k} " + prose(60)
            planted[k] = (len(head.encode()), len((head + passage).encode()), passage)
    got = {}
    for r in substrings.passages(frame(spark, rows.items())).collect():
        assert r.doc_id not in got
        got[r.doc_id] = r
    assert set(got) == {k for k in rows if k % 4 == 3}
    for k, r in got.items():
        raw, before = rows[k].encode(), rows[k - 1].encode()
        low, high, _ = planted[k]
        assert r.start <= low and r.end >= high and raw[r.start : r.end] in before
        assert raw[r.start - 1 : r.end] not in before and raw[r.start : r.end + 1] not in before
        assert r.words == sum(c in b" \n\t\r" for c in raw[r.start : r.end]) and r.first_doc_id == k - 1
