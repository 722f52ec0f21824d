import random
import re

import pytest

from tidegauge.llm import lines

SCHEMA = "doc_id long, text string, n_lines string, tokens int, goes string"


def brute(rows):
    """Every line against every earlier one."""
    placed = sorted((i, k, frozenset(w for w in re.split(r"[ \t\r]+", line) if w)) for i, t in rows if i is not None and t is not None for k, line in enumerate(t.split("\n")))
    gone = set()
    for y in placed:
        for x in placed:
            if x[:2] >= y[:2]:
                break
            if y[2] and 5 * len(x[2] & y[2]) >= 4 * len(x[2] | y[2]):
                gone.add(y[:2])
                break
    return gone


def corpus(seed):
    rng = random.Random(seed)
    common = ["the", "of", "and", "to", "in"]
    vocabulary = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    base = [[rng.choice(common if rng.random() < 0.4 else vocabulary) for _ in range(rng.randint(1, 25))] for _ in range(40)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rng.randint(0, 8)):
            line = list(rng.choice(base))
            for _ in range(rng.randint(0, 4)):
                line[rng.randrange(len(line))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                rng.shuffle(line)
            text.append(rng.choice(["", " ", ""]) + " ".join(line) + rng.choice(["", "\t", "\r", "  the"]))
            if rng.random() < 0.2:
                text.append(rng.choice(["", "  ", "\t"]))
        rows.append((i * 3, "\n".join(text)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "a", 1, "b") for i, t in rows], SCHEMA).repartition(4)


def test_equals_brute_force(spark):
    rows = corpus(1) + corpus(2)[:0] + [(500, None), (501, ""), (None, "the of and to"), (502, "x " * 5000 + "\n" + "x"), (-5, "the of and to\nthe of and to"), (503, "a b c d"), (504, "d c b a e"), (505, "a b c d")]
    docs = frame(spark, rows)
    gone = brute(rows)
    got = [(r.doc_id, r.line_no) for r in lines.later_matches(docs).collect()]
    assert sorted(got) == sorted(gone) and len(gone) > 50
    kept = lines.remove_later_matches(docs)
    assert kept.columns == docs.columns
    want = {(i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)) for i, t in rows}
    assert {(r.doc_id, r.text) for r in kept.collect()} == want
    assert {(r.doc_id, r.n_removed) for r in lines.line_digest(docs).collect() if r.n_removed} == {(i, sum(x == i for x, _ in gone)) for i, _ in gone}


def test_a_chain_that_the_first_line_does_not_settle(spark):
    words = [f"w{k}" for k in range(20)]
    steps = [words[:20], words[2:20], words[3:19], words[5:19]]  # each matches the one before, few match the first
    rows = [(k, " ".join(w)) for k, w in enumerate(steps)]
    assert {(r.doc_id, r.line_no) for r in lines.later_matches(frame(spark, rows)).collect()} == brute(rows)


def test_repeated_rows_and_empty(spark):
    rows = [(1, "one two three"), (1, "one two three"), (2, "one two three")]
    got = lines.with_removals(frame(spark, rows).select("doc_id", "text")).collect()
    assert sorted((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got) == [(1, "one two three", 1, 0)] * 2 + [(2, "", 1, 1)]
    assert lines.line_digest(frame(spark, rows).limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = lines.line_digest(frame(spark, [(1, "a b")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_long_lists(spark, monkeypatch):
    """The same result where nearly all lists count as long, and where a group of near copies is in long lists."""
    monkeypatch.setattr(lines, "LIST_BITS", (1, 1))
    monkeypatch.setattr(lines, "PART_BITS", 2)
    rng = random.Random(5)
    base = [f"w{k}" for k in range(30)]
    near = [(1000 + i, " ".join(w if rng.random() > 0.06 else f"v{rng.randrange(500)}" for w in base)) for i in range(80)]
    rows = corpus(3) + near
    assert {(r.doc_id, r.line_no) for r in lines.later_matches(frame(spark, rows)).collect()} == brute(rows)


@pytest.mark.parametrize("apart", [" ", "\t", "\r", " \t "])
def test_common_words_have_long_lists_whatever_parts_them(spark, apart):
    """Tables in text: four of six words of a line are among twelve common ones."""
    rng = random.Random(9)
    common = [f"c{k}" for k in range(12)]
    rows = [(i, apart.join([*rng.sample(common, 4), f"a{i}", f"b{i}"])) for i in range(600)]
    docs = frame(spark, rows)
    texts = lines._texts(docs)
    rarity, long = lines._rarity(texts), lines._long_from(texts)
    listed = lines._listed(lines._distinct(lines._lines(texts), rarity, long)).where(lines.F.col("token") < long)
    assert listed.groupBy("token").count().agg({"count": "max"}).first()[0] < 1 << lines.LIST_BITS[0] + 1
    assert {(r.doc_id, r.line_no) for r in lines.later_matches(docs).collect()} == brute(rows)


@pytest.mark.parametrize("bits", [0, 6])
def test_groups_of_frequent_words(spark, monkeypatch, bits):
    """All words frequent, lengths about the powers of two, copies less or more up to a ninth: the same result, with groups' lists long or short."""
    monkeypatch.setattr(lines, "LIST_BITS", (1, 1))
    monkeypatch.setattr(lines, "GROUP_LIST_BITS", bits)
    monkeypatch.setattr(lines, "PART_BITS", 1)
    rng = random.Random(11)
    words = [f"w{k}" for k in range(90)]
    rows = []
    for n in [*range(1, 20), 26, 31, 32, 33, 39, 40, 60, 64, 66, 80]:
        base = rng.sample(words, n)
        for _ in range(4):
            line = [w for w in base if rng.random() > 0.08] + [w for w in words if w not in base and rng.random() < n / 1500]
            rng.shuffle(line)
            rows.append((len(rows), " ".join(line)))
    gone = brute(rows)
    assert {(r.doc_id, r.line_no) for r in lines.later_matches(frame(spark, rows)).collect()} == gone and len(gone) > 40


def test_unrelated_long_lines_make_no_pairs(spark):
    """Lines of 200 words, each in some 30 lines: they share many lists, and 64 bits of parity do not tell them apart."""
    rng = random.Random(13)
    words = [f"w{k}" for k in range(2000)]
    docs = frame(spark, [(i, " ".join(rng.sample(words, 200))) for i in range(300)])
    texts = lines._texts(docs)
    rarity, long = lines._rarity(texts), lines._long_from(texts)
    found = lines.durable_table(lines._distinct(lines._lines(texts), lines.durable_table(rarity, "test-rarity"), long), "test-lines")
    listed = lines._with_sizes(lines._listed(found), lines.durable_table(lines._group_sizes(found), "test-sizes"))
    assert lines._in_short_lists(listed).count() + lines._with_heads(listed).count() < 300  # 44,850 pairs there are


def test_words_are_as_frequent_as_different_lines_have_them(spark):
    """300 copies of a line are one line: its words do not count as frequent; magnitudes take a byte each."""
    texts = lines._texts(frame(spark, [(i, "a b a c\n" + " ".join(["d", f"e{i}"])) for i in range(300)]))
    rarity = lines._rarity(texts)
    assert rarity.schema["sizes"].dataType.elementType.simpleString() == "tinyint"
    sizes = sorted(rarity.first()["sizes"])
    assert sizes[-2:] == [1, 9] or sizes[-2:] == [2, 9]  # d alone is in 300 lines; two words may share a slot


def test_prefixes_are_made_without_texts(spark):
    """Lines are split into words once, when they are first read; a prefix is made of the hashes."""
    texts = lines._texts(frame(spark, [(1, "a b\tc  a"), (2, "\t \r"), (3, " b ")]))
    found = lines._lines(texts)
    assert "line" not in found.columns
    assert {(r.doc_id, len(r.words)) for r in found.collect()} == {(1, 3), (3, 1)}
