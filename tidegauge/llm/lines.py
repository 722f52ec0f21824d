"""Line dedup: an exact set-similarity join of lines, in DataFrame functions alone.

A line's tokens are its distinct words. Two lines match if the Jaccard similarity of their tokens
is at least 4/5, and a line goes if it matches one that stands earlier, by (doc_id, line number).

Equal lines are one first, which stands where they occur first; each such line is stored once, with
its prefix. Tokens are ordered by rarity: by the order of magnitude of how often they occur in all
texts, then by hash. Counts are kept over hash slots, a fixed number, as a table of all words would
have to be joined to every word; any such order is right, and rare tokens first keep the lists
short. A line of n tokens is listed under its first n - ceil(4n/5) + 1 tokens; lines that match
share one of them.

A list whose token's magnitude says that it is not long is compared whole. Lines with long ones in
their prefix (poor lines) are listed under their short tokens and, for pairs that share none of those,
under groups: their other tokens are dealt by hash into some n/3 segments, and what is in a segment is
one token of a second kind. Two lines of n and m tokens that match differ in (n + m)/9 tokens at most,
so in no more groups, and the prefix rule holds for groups as for tokens: with groups ordered by
rarity, each line is listed under one more than may differ. Two or three frequent words that stand
alone in a segment are far rarer than each of them, so a list's length does not grow with the tables,
as a frequent word's does. The number of segments hangs on the length's power of two; a line that may
match one over the next power is listed for both. Lines under 8 tokens are listed under all of their
tokens, and less each one.

The groups' lists are short or long by counts over slots, too. A long one is of near copies, or of
words that often stand together; it is dealt out in
parts of about 2 ** PART_BITS lines, in which a line is compared with the part's earliest line, its
head, and with the BEFORE lines before it. Where copies vary, that finds
nearly all in a few comparisons per line, so a group of copies never becomes all of its pairs. Lines
not settled so are then joined with all that stands earlier in their long lists, whatever the parts;
Spark splits lists there that are very long. Filters come before texts are looked up: length,
position in the list, and the parity of tokens over 64 or 128 hash slots (a bit that differs is a token that
differs). The similarity is computed on 64-bit hashes of all words, first for each line's pair
with most lists in common.

Lists carry numbers only; the lines of pairs that passed all filters are looked up once for all of
them.

Defined cases: null text stays null; lines without words never go; rows without doc_id take no
part and stay as they are; rows that share a doc_id are read as one document, of which lines
with the same number are not later than one another and go only together; other columns pass through, but for
``n_lines`` and ``n_removed``, which :func:`with_removals` replaces in either case.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm._shared import discard, durable_table, masked, without

SLOT_BITS = 18
#: Of words, of which there are more than of other keys.
WORD_SLOT_BITS = 20
#: Hashes of words repeat, so a file's dictionary may be larger than Parquet's 1 MB before plain numbers take its place.
DICTIONARY = {"parquet.dictionary.page.size": str(16 << 20)}
HASH_BITS = 37
#: Tokens have long lists from a 2 ** -SHARE_BITS share of all words on, but never under the first nor over the second of these powers of two.
SHARE_BITS, LIST_BITS = 15, (6, 9)
#: Groups have long lists from this power of two of lines on.
GROUP_LIST_BITS = 6
#: Keys of groups are above all tokens: this bit, 8 bits of rarity, and a hash.
GROUP, GROUP_HASH_BITS = 1 << 62, 54
#: Each token more makes a group so many powers of two rarer, as an estimate that only orders them.
STEP = 8
#: Parity has 128 bits from so many tokens on; 64 tell shorter lines apart.
WIDE = 96
#: Lines under so many tokens match others only if their tokens are the same, or the same less one.
TINY = 8
PART_BITS = 6
BEFORE = 3
HAS_WORDS = r"[^ \t\r]"
LINE = ["doc_id", "line_no"]


def _tabs(text: str) -> Column:
    """Whether other white space than spaces parts words."""
    return F.contains(F.col(text), F.lit("\t")) | F.contains(F.col(text), F.lit("\r"))


def words_of(line: str) -> Column:
    """The words of a line, and empty ones where white space stands together; only lines with other white space than spaces are rewritten first."""
    return F.split(F.when(_tabs(line), F.translate(line, "\t\r", "  ")).otherwise(F.col(line)), " ")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text")


def _placed(texts: DataFrame) -> DataFrame:
    """``(doc_id, line_no, line)`` of all lines with words."""
    return texts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.col("line").rlike(HAS_WORDS))


def _lines(texts: DataFrame) -> DataFrame:
    """``(doc_id, line_no, words)`` of each different line, where it stands first: 64-bit hashes of its distinct words.

    Texts are split into words here alone; whatever follows reads the hashes.
    """
    hashed = _placed(texts).select(*LINE, "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), F.col("line")).alias("h2"))
    once = hashed.groupBy("h1", "h2").agg(F.min(F.struct(*LINE)).alias("at"), F.first("line").alias("line")).select("at.*", "line")
    words = F.array_distinct(F.transform(words_of("line"), lambda w: F.xxhash64(w)))
    return once.select(*LINE, F.array_remove(words, F.xxhash64(F.lit(""))).alias("words"))


def _slot(key: Column) -> Column:
    return F.hash(key).bitwiseAND(F.lit((1 << SLOT_BITS) - 1))


def _word_slot(word: Column) -> Column:
    """Of a word's hash, whose lowest bits do."""
    return word.bitwiseAND(F.lit((1 << WORD_SLOT_BITS) - 1).cast("long")).cast("int")


def _sizes(slots: DataFrame, bits: int) -> DataFrame:
    """One row, one array of bytes: for each of ``2 ** bits`` slots, the order of magnitude of how often it is in ``slots(slot)``."""
    every = slots.sparkSession.range(1 << bits).select(F.col("id").cast("int").alias("slot"), F.lit(0).alias("one"))
    counts = slots.select("slot", F.lit(1).alias("one")).union(every).groupBy("slot").agg(F.sum("one").alias("n"))
    magnitude = F.when(F.col("n") > 0, F.floor(F.log2("n")).cast("long") + 1).otherwise(F.lit(0).cast("long"))
    placed = counts.select(F.shiftleft(F.col("slot").cast("long"), 8).bitwiseOR(magnitude).alias("x"))
    return placed.agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x.bitwiseAND(F.lit(127).cast("long")).cast("byte")).alias("sizes"))


def _size(sizes: Column, slot: Column) -> Column:
    return F.coalesce(F.get(sizes, slot), F.lit(0).cast("byte")).cast("long")


def _frequencies(lines: DataFrame) -> DataFrame:
    """The magnitudes of words' slots: how many different lines have them."""
    return _sizes(lines.select(F.explode("words").alias("w")).select(_word_slot(F.col("w")).alias("slot")), WORD_SLOT_BITS)


def _rarity(texts: DataFrame) -> DataFrame:
    return _frequencies(_lines(texts))


def _long_from(texts: DataFrame) -> int:
    """The token from which on lists are long, by the number of words in all texts, taken as an eighth of their bytes."""
    words = (texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0) // 8
    bits = min(max(words.bit_length() - 1 - SHARE_BITS, LIST_BITS[0]), LIST_BITS[1])
    return (bits + 1) << HASH_BITS


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _groups(tokens: Column, top: Column, wanted: Column) -> Column:
    """Keys of the ``wanted`` rarest groups of a line's long ``tokens``, for lines of fewer than ``top`` tokens."""
    segments = F.least(F.floor(1.5 * (F.floor((2 * top - 2) / 9) + 1)), F.lit(1 << 20)).cast("long")
    bits = HASH_BITS + 7  # of a token
    none = F.array().cast("array<long>")

    def keyed(rarity: Column, *what: Column) -> Column:
        return F.shiftleft(rarity, GROUP_HASH_BITS).bitwiseOR(F.shiftrightunsigned(F.xxhash64(*what), 64 - GROUP_HASH_BITS)).bitwiseOR(F.lit(GROUP))

    def of_dealt(dealt: Column) -> Column:
        segment = lambda i: F.shiftrightunsigned(F.get(dealt, i), bits)
        last = F.size(dealt)
        starts = F.filter(F.sequence(F.lit(0), last - 1), lambda i: (i == 0) | (segment(i) != segment(i - 1)))

        def of_starts(starts: Column) -> Column:
            def key(start: Column, k: Column) -> Column:
                n = F.coalesce(F.get(starts, k + 1), last) - start
                magnitude = F.shiftright(F.get(dealt, start).bitwiseAND(F.lit((1 << bits) - 1)), HASH_BITS)
                rarity = F.greatest(F.lit(0).cast("long"), 128 + magnitude - STEP * (n - 1))
                return F.coalesce(keyed(rarity, segments, F.slice(dealt, start + 1, n)), F.lit(GROUP))

            found = F.slice(F.sort_array(F.transform(starts, key)), F.lit(1), wanted)
            empty = F.array_except(F.sequence(F.lit(0).cast("long"), segments - 1), F.transform(starts, segment))
            more = F.transform(F.slice(empty, F.lit(1), F.greatest(wanted - F.size(starts), F.lit(0))), lambda k: keyed(F.lit(255).cast("long"), segments, k))
            return F.when(F.size(starts) >= wanted, found).otherwise(F.concat(found, more))

        return _once(starts, of_starts)

    dealt = F.sort_array(F.transform(tokens, lambda t: F.shiftleft(F.pmod(t, segments), bits).bitwiseOR(t)))
    return F.when((wanted > 0) & (F.size(tokens) > 0), _once(dealt, of_dealt)).otherwise(none)


def _tiny(tokens: Column, n: Column) -> Column:
    """Keys of a line under or of TINY tokens: all of them, and all but each one."""
    key = lambda t: F.shiftrightunsigned(F.xxhash64(F.lit("tiny"), t), 2).bitwiseOR(F.lit(GROUP))
    less = F.when((n > 4) & (n <= TINY), F.transform(tokens, lambda t: key(F.array_remove(tokens, t))))
    return F.concat(F.when(n < TINY, F.array(key(tokens))).otherwise(F.array().cast("array<long>")), F.coalesce(less, F.array().cast("array<long>")))


def _distinct(lines: DataFrame, rarity: DataFrame, long: int) -> DataFrame:
    """``(doc_id, line_no, n, p, q, prefix)`` of each different line.

    A token is a number of 44 bits, as many as lists need: its magnitude, then its hash. The array of
    magnitudes is a scalar, not a column of each row. ``prefix`` has tokens with short lists, then keys
    of groups if it would have had others; ``p`` is the parity of all over 64 slots, ``q`` of half of them.
    """

    def key(w: Column) -> Column:
        size = F.get(F.col("sizes"), _word_slot(w)).cast("long")
        return F.coalesce(F.shiftleft(size, HASH_BITS).bitwiseOR(F.shiftrightunsigned(w, 64 - HASH_BITS)), F.lit(0).cast("long"))  # never null, so keys sort as plain numbers

    tokens = lines.withColumn("sizes", rarity.scalar()).select(*LINE, F.sort_array(F.transform("words", key)).alias("tokens"))
    tokens = tokens.withColumn("n", F.size("tokens"))
    every = F.expr("aggregate(tokens, 0L, (a, t) -> a ^ shiftleft(1L, cast(t & 63L as int)))")
    half = F.expr("aggregate(tokens, 0L, (a, t) -> a ^ shiftleft(shiftright(t, 6) & 1L, cast(t & 63L as int)))")
    size = F.col("n") - F.floor((4 * F.col("n") + 4) / 5).cast("int") + 1
    known = F.filter(F.slice("tokens", 1, size), lambda t: t < long)
    listed = tokens.select(*LINE, "tokens", "n", every.alias("p"), F.when(F.col("n") >= WIDE, half).alias("q"), size.alias("size"), known.alias("known"))
    n, short = F.col("n"), F.size("known")
    top = F.expr("shiftleft(1, length(bin(n)))")  # the next power of two
    longest = F.floor(5 * n / 4).cast("int")  # that may match
    differ = lambda m: F.floor((n + m) / 9).cast("int")
    others = F.slice("tokens", short + 1, n - short)
    groups = F.concat(
        F.when(n >= TINY, _groups(others, top, differ(F.least(longest, top - 1)) - short + 1)).otherwise(F.array().cast("array<long>")),
        F.when((n >= TINY) & (longest >= top), _groups(others, 2 * top, differ(longest) - short + 1)).otherwise(F.array().cast("array<long>")),
        F.when(n <= TINY, _tiny(F.col("tokens"), n)).otherwise(F.array().cast("array<long>")),
    )
    return listed.select(*LINE, "n", "p", "q", F.when(short < F.col("size"), F.concat("known", groups)).otherwise(F.col("known")).alias("prefix"))


def _listed(lines: DataFrame) -> DataFrame:
    """A row for each token or group that a line is listed under."""
    return lines.select(*LINE, "n", "p", "q", F.posexplode("prefix").alias("i", "token"))


def _group_sizes(lines: DataFrame) -> DataFrame:
    """The magnitudes of groups' slots."""
    return _sizes(lines.select(F.explode("prefix").alias("w")).where(F.col("w") >= GROUP).select(_slot(F.col("w")).alias("slot")), SLOT_BITS)


def _with_sizes(listed: DataFrame, sizes: DataFrame) -> DataFrame:
    """``size``: the magnitude of a group's list, and 0 of a token's."""
    size = F.when(F.col("token") >= GROUP, _size(F.col("sizes"), _slot(F.col("token")))).otherwise(F.lit(0).cast("long"))
    return listed.withColumn("sizes", sizes.scalar()).select(*listed.columns, size.cast("int").alias("size"))


def _pairs(rows: DataFrame) -> DataFrame:
    """Distinct pairs of a line ``x`` and an earlier one ``a``, with the number of lists that both are in.

    Filters on length, position (the i-th tokens are the first in common) and parity.
    """
    n, m, i, j = F.col("x.n"), F.col("a.n"), F.col("x.i"), F.col("a.i")
    earlier = (F.col("a.doc_id") < F.col("x.doc_id")) | ((F.col("a.doc_id") == F.col("x.doc_id")) & (F.col("a.line_no") < F.col("x.line_no")))
    length = 5 * F.least(n, m) >= 4 * F.greatest(n, m)
    position = (F.col("x.token") >= GROUP) | (9 * F.least(n - i, m - j) >= 4 * (n + m))
    p, q = F.col("x.p").bitwiseXOR(F.col("a.p")), F.col("x.q").bitwiseXOR(F.col("a.q"))
    parity = 9 * F.coalesce(F.bit_count(p.bitwiseXOR(q)) + F.bit_count(q), F.bit_count(p)) <= n + m
    key = [F.col(f"x.{c}").alias(c) for c in LINE] + [F.col("a.doc_id").alias("a_doc"), F.col("a.line_no").alias("a_line")]
    return rows.where(earlier & length & position & parity).groupBy(*key).agg(F.count("*").alias("shared"))


def _in_short_lists(listed: DataFrame) -> DataFrame:
    """Pairs in lists that are not long. Both sides are one and the same shuffle."""
    short = listed.where(F.col("size") <= GROUP_LIST_BITS).drop("size")
    return _pairs(short.alias("x").join(short.alias("a"), F.col("x.token") == F.col("a.token")))


def _with_heads(listed: DataFrame) -> DataFrame:
    """Pairs in parts of long lists: of a line with the part's head, and with the few lines just before it there."""
    part = F.expr(f"pmod(xxhash64(token, doc_id, line_no), shiftleft(1L, greatest(size - {PART_BITS}, 0)))")
    in_part = Window.partitionBy("token", "part").orderBy(*LINE)
    entry = F.struct(*LINE, "n", "i", "p", "q")
    head = F.first(entry).over(in_part.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    others = F.array(head, *[F.lag(entry, k).over(in_part) for k in range(1, BEFORE + 1)])
    return _pairs(listed.where(F.col("size") > GROUP_LIST_BITS).withColumn("part", part).withColumn("others", others).withColumn("a", F.explode("others")).where("a is not null").alias("x"))


def _in_long_lists(listed: DataFrame, settled: DataFrame) -> DataFrame:
    """Pairs of an unsettled line and any earlier one in one of its long lists."""
    long = listed.where(F.col("size") > GROUP_LIST_BITS).drop("size")
    x, a = long.join(settled, LINE, "left_anti").alias("x"), long.alias("a")
    return _pairs(x.join(a, F.col("x.token") == F.col("a.token")))


def _verified(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines ``(doc_id, line_no)`` with an earlier one ``(a_doc, a_line)`` that is similar enough.

    Each line's likeliest pair is tried first, and the others only if that one fails.
    """
    wanted = durable_table(pairs.select(*LINE).union(pairs.select(F.col("a_doc"), F.col("a_line"))).distinct(), "lines-wanted")
    place = F.xxhash64(*LINE)
    marks = durable_table(_sizes(wanted.select(_slot(place).alias("slot")), SLOT_BITS), "lines-marks")  # most lines are not wanted, and need not move
    marked = lines.withColumn("sizes", marks.scalar()).where(_size(F.col("sizes"), _slot(place)) > 0)
    found = durable_table(marked.join(wanted, LINE, "left_semi").select(*LINE, F.col("words").alias("a")), "lines-compared")
    other = found.select(F.col("doc_id").alias("a_doc"), F.col("line_no").alias("a_line"), F.col("a").alias("b"))
    similar = 9 * F.size(F.array_intersect("a", "b")) >= 4 * (F.size("a") + F.size("b"))

    def matched(pairs: DataFrame) -> DataFrame:
        both = pairs.join(found, LINE).join(other, ["a_doc", "a_line"])
        return durable_table(both.where(similar).select(*LINE).distinct(), "lines-matched")

    likeliest = pairs.groupBy(*LINE).agg(F.max(F.struct("shared", "a_doc", "a_line")).alias("a")).select(*LINE, "a.a_doc", "a.a_line")
    first = matched(likeliest)
    rest = matched(pairs.join(first, LINE, "left_anti"))
    discard(found, wanted, marks)
    return first.union(rest)


def kept_lines(texts: DataFrame) -> DataFrame:
    """``(doc_id, line_no)`` of the lines with words that match no earlier one."""
    lines = durable_table(_lines(texts), "lines-words", **DICTIONARY)
    rarity = durable_table(_frequencies(lines), "lines-rarity")
    prefixes = durable_table(_distinct(lines, rarity, _long_from(texts)), "lines-prefixes")
    sizes = durable_table(_group_sizes(prefixes), "lines-sizes")
    listed = _with_sizes(_listed(prefixes), sizes)
    long = durable_table(listed.where(F.col("size") > GROUP_LIST_BITS), "lines-long")
    near = _in_short_lists(listed).union(_with_heads(long)).groupBy(*LINE, "a_doc", "a_line").agg(F.sum("shared").alias("shared"))
    near = durable_table(near, "lines-near")
    settled = _verified(near, lines)
    rest = durable_table(_in_long_lists(long, settled), "lines-rest")
    more = _verified(rest, lines)
    kept = durable_table(lines.select(*LINE).join(settled.union(more), LINE, "left_anti").distinct(), "lines-kept")
    discard(rarity, lines, prefixes, sizes, long, near, rest)
    return kept


def later_matches(docs: DataFrame) -> DataFrame:
    """``(doc_id, line_no)`` of the lines that match an earlier one."""
    texts = _texts(docs)
    return _placed(texts).select(*LINE).distinct().join(kept_lines(texts), LINE, "left_anti")


def with_removals(docs: DataFrame) -> DataFrame:
    """``docs`` less the lines that go, with ``n_lines`` before and ``n_removed``."""
    docs = without(docs, "n_lines", "n_removed")
    hidden = masked(docs, "doc_id", "text")
    kept = kept_lines(_texts(hidden)).groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set("line_no").alias("__kept"))
    out = hidden.withColumn("__id", F.col("doc_id").cast("long")).join(kept, "__id", "left").withColumn("__parts", F.split("text", "\n"))
    with_words = F.array_compact(F.transform("__parts", lambda x, i: F.when(x.rlike(HAS_WORDS), i)))
    gone = F.array_except(with_words, F.coalesce("__kept", F.array().cast("array<int>")))
    out = out.withColumn("__gone", F.when(F.col("__id").isNotNull(), gone))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__parts") - 1), F.col("__gone"))
    less = F.array_join(F.transform(stay, lambda i: F.get(F.col("__parts"), i)), "\n")
    return out.select(
        *[F.when(F.size("__gone") > 0, less).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in hidden.columns],
        F.coalesce(F.size("__parts"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"),
    ).toDF(*docs.columns, "n_lines", "n_removed")


def remove_later_matches(docs: DataFrame) -> DataFrame:
    """``docs`` with the lines that match earlier ones taken out of their texts."""
    hidden = masked(docs, "doc_id", "text")
    return with_removals(hidden).select(*hidden.columns).toDF(*docs.columns)


def line_digest(docs: DataFrame) -> DataFrame:
    """One row per document: its lines, how many went, and the SHA-256 of what stays."""
    out = with_removals(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
