"""Text columns: names, slugs, hosts, addresses, banners and what they state. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegauge.functions.net import once

SLUG_LENGTH = 64
# Latin letters and what a slug writes for them.
SINGLE_FOLDS = {
    "a": "ÀÁÂÃÄÅàáâãäå", "c": "Çç", "d": "Ðð", "e": "ÈÉÊËèéêë", "i": "ÌÍÎÏìíîï", "n": "Ññ",
    "o": "ÒÓÔÕÖØòóôõöø", "u": "ÙÚÛÜùúûü", "y": "Ýýÿ",
}
DOUBLE_FOLDS = {"ae": "Ææ", "th": "Þþ", "ss": "ß"}
# Words that qualify a version and are no part of a name.
QUALIFIERS = ["alpha", "beta", "rc", "dev", "development", "snapshot", "nightly", "unstable", "version"]
# Other names of capabilities.
ALIASES = {"mccp2": "MCCP", "ssl": "TLS"}

_VERSION = r"^[vV]?[0-9][0-9A-Za-z._+()\[\]/-]*$"


def slug(name: Column) -> Column:
    """Lower-case ASCII words joined by hyphens, at most SLUG_LENGTH long."""
    out = name
    for to, letters in DOUBLE_FOLDS.items():
        out = F.regexp_replace(out, f"[{letters}]", to)
    out = F.translate(out, "".join(SINGLE_FOLDS.values()), "".join(k * len(v) for k, v in SINGLE_FOLDS.items()))
    joined = F.regexp_replace(F.lower(out), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(joined, "^-|-$", ""), 1, SLUG_LENGTH)


def canonical_host(host: Column) -> Column:
    """Trimmed, out of brackets, without root dots, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(host), r"^\[(.*)\]$", "$1"), r"\.+$", ""))


def address(text: Column) -> Column:
    """``host:port``, ``[v6]:port`` or ``host port`` as (host, port); a bare host has a null port."""
    pattern = r"^\s*(\[[0-9A-Fa-f:.]+\]|[^\s:\[\]]+)(?:[:\s]\s*([0-9]{1,5}))?\s*$"
    port = F.nullif(F.regexp_extract(text, pattern, 2), F.lit("")).cast("int")
    host = F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    return F.when(host.isNotNull() & (port.isNull() | port.between(1, 65535)), F.struct(canonical_host(host).alias("host"), port.alias("port")))


def referrals(text: Column) -> Column:
    """Addresses in a list separated by new lines, bars, semicolons or commas."""
    parts = F.filter(F.split(text, r"[\n\r|;,]+"), lambda x: F.trim(x) != "")
    return F.array_distinct(F.array_compact(F.transform(parts, address)))


def normal_url(url: Column) -> Column:
    """An absolute http(s) address with a host, without user data, of at most 500 characters; else null."""
    trimmed = F.trim(url)
    good = F.lower(trimmed).rlike(r"^https?://[^/@?#\s]+([/?#]\S*)?$") & (F.length(trimmed) <= 500)
    return F.when(good, trimmed)


def folded_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def flattened(banner: Column) -> Column:
    """Without markup tags, terminal escapes and controls, and with single spaces."""
    out = F.regexp_replace(banner, r"<!?/?[A-Za-z][^<>\x1b]*>", "")
    out = F.regexp_replace(out, r"\x1b\[[^@-~]*[@-~]?|\x1b\][^\x07\x1b]*(?:\x07|\x1b\\)?|\x1b.?", "")
    out = F.regexp_replace(out, r"\s+", " ")
    return F.trim(F.regexp_replace(out, r"[\x00-\x1f\x7f-\x9f]", ""))


def fingerprint(banner: Column, least: int = 40) -> Column:
    """SHA-256 of the flattened banner, if it is long enough to tell."""
    flat = flattened(banner)
    return F.when(F.length(flat) >= least, F.sha2(flat, 256))


def codebase_family(codebase: Column) -> Column:
    """The name part of a code base: words up to a version, less qualifiers and separators at the end."""
    words = F.filter(F.split(F.trim(codebase), " +"), lambda w: w != "")
    joined = lambda w: F.regexp_extract(w, r"^(.+?)-[vV]?[0-9][0-9A-Za-z_+()\[\]/-]*\.[0-9A-Za-z._+()\[\]/-]*$", 1)
    stops = F.transform(words, lambda w, i: ((i > 0) & w.rlike(_VERSION)) | (joined(w) != ""))
    at = F.array_position(stops, F.lit(True))
    last = F.element_at(words, F.when(at > 0, at).otherwise(1).cast("int"))
    cut = joined(last)
    head = F.when(at == 0, words).when(cut != "", F.concat(F.slice(words, 1, F.greatest(at - 1, F.lit(0)).cast("int")), F.array(cut))).otherwise(F.slice(words, 1, F.greatest(at - 1, F.lit(0)).cast("int")))
    qualifies = lambda w: w.rlike(r"^[(\[].*[)\]]$") | F.lower(F.regexp_replace(w, r"^[()\[\]]+|[()\[\]]+$", "")).isin(QUALIFIERS) | ~w.rlike(r"[\p{L}\p{N}]")
    keep = F.aggregate(F.reverse(F.transform(head, lambda w, i: F.when((i == 0) | ~qualifies(w), i + 1).otherwise(0))), F.lit(0), lambda a, x: F.greatest(a, x))
    return F.nullif(F.array_join(F.slice(head, 1, keep), " "), F.lit(""))


def capability(name: Column) -> Column:
    """Canonical capability name: hyphens for underscores and spaces, aliases resolved."""
    plain = F.upper(F.translate(F.trim(name), "_ ", "--"))
    for other, known in ALIASES.items():
        plain = F.when(plain == other.upper(), known).otherwise(plain)
    return plain


def relative_age(seconds: Column) -> Column:
    """How long ago, in the unit a reader expects."""
    rungs = [(90, 1, "s"), (90 * 60, 60, "min"), (48 * 3600, 3600, "h"), (14 * 86400, 86400, "d"), (70 * 86400, 7 * 86400, "w"), (730 * 86400, 30 * 86400, "mo")]
    out = F.concat(F.floor(seconds / (365 * 86400)).cast("string"), F.lit("y"))
    for below, unit, mark in reversed(rungs):
        out = F.when(seconds < below, F.concat(F.floor(seconds / unit).cast("string"), F.lit(mark))).otherwise(out)
    return out


# The words that a reader of counts goes by.
NUMBER_WORDS = [
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen",
]
TENS = ["twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
ADVERBS = ["currently", "now", "presently", "only", "just", "about"]
PAST = ["registered", "deleted", "allowed", "created"]
NOUNS = ["player", "players", "user", "users", "character", "characters", "people", "person", "persons", "adventurer", "adventurers", "mortal", "mortals"]
STATES = ["connected", "online", "playing", "active", "logged"]
STAFF = ["staff", "wizard", "wizards", "admin", "admins", "immortal", "immortals"]
LIMITS = ["max", "maximum", "record", "peak", "most", "limit", "of"]
TABLE_WORDS = ["name", "idle", "on", "for", "total", "there", "are", "is", "no", "nobody", "and"]
REACH = 7  # words from a number to its noun
MOST = 10_000


def _words(line: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.lower(line), "on-line", "online"), r"\bno[- ]?one\b", "nobody")
    return F.regexp_extract_all(plain, F.lit("[a-z]+|[0-9]+"), F.lit(0))


def _number(word: Column) -> Column:
    """What a word counts, or null: digits, a number in words, or none at all."""
    known = {w: n for n, w in enumerate(NUMBER_WORDS)} | {w: 10 * n for n, w in enumerate(TENS, 2)} | {"no": 0, "nobody": 0, "none": 0}
    spelled = F.try_element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), word)
    return F.when(word.rlike("^[0-9]{1,9}$"), word.try_cast("int")).otherwise(spelled)


def _has(words: Column, vocabulary: list[str]) -> Column:
    return F.arrays_overlap(words, F.array(*[F.lit(w) for w in vocabulary]))


def stated_counts(line: Column) -> Column:
    """The numbers of people that a line states, in order.

    A number counts if a noun for people follows within REACH words (or, as in ``players: 5``, stands
    just before it), if the line says that they are there, and if it is no limit or record. They are there if the line has
    a word for it, if it begins with ``there are``, if the noun is followed by a bare ``on``, or if number and
    noun stand in brackets. Who logged out, and who was once registered, is not there. Tens and units in words are one number, and
    of ``one of three players`` the three count.
    """
    return once(_words(line), lambda words: once(_signs(line, words), lambda signs: _counts(words, signs)))


def _signs(line: Column, words: Column) -> Column:
    """What holds of a line as a whole, whichever of its numbers is looked at."""
    return F.struct(
        line.rlike("[:=]").alias("colon"), line.rlike(r"\[\s*[0-9]+\s+[A-Za-z]+\s*[;,\]]").alias("bracket"), _has(words, STATES).alias("state"),
        line.rlike(rf"(?i)\b(?:{'|'.join(NOUNS)}) on(?: (?:now|right now|currently|at the moment))?\s*(?:[.,;!\])]|$)").alias("on"),
        (line.rlike(r"(?i)\blogged (?:off|out)\b") | _has(words, PAST)).alias("gone"),
    )


def _counts(words: Column, signs: Column) -> Column:
    word = lambda i, k=0: F.get(words, i + k)
    is_in = lambda w, vocabulary: F.coalesce(w.isin(vocabulary), F.lit(False))
    following = lambda i: F.slice(words, i + 2, REACH)
    labelled = lambda i: (is_in(word(i, -1), NOUNS) | (is_in(word(i, -1), STATES) & is_in(word(i, -2), NOUNS)) | (is_in(word(i, -1), ["on"]) & is_in(word(i, -2), NOUNS))) & signs["colon"]
    late = lambda i: F.when(is_in(word(i, -1), ADVERBS), 1).otherwise(0)
    there = lambda i: is_in(F.get(words, i - 2 - late(i)), ["there"]) & is_in(F.get(words, i - 1 - late(i)), ["are", "is"])
    bracketed = lambda i: signs["bracket"] & is_in(word(i, 1), NOUNS)
    about = lambda i: labelled(i) | ((_has(following(i), NOUNS) | is_in(word(i), ["nobody"])) & (signs["state"] | there(i) | signs["on"] | bracketed(i)) & ~signs["gone"])
    part = lambda i: is_in(word(i), ["one"]) & is_in(word(i, 1), ["of"])
    unit = lambda i: is_in(word(i), NUMBER_WORDS[1:10])
    joined = lambda i: unit(i) & is_in(word(i, -1), TENS)
    bound = lambda i: is_in(word(i, -1), LIMITS) & ~(is_in(word(i, -1), ["of"]) & is_in(word(i, -2), ["one"]))
    places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: _number(word(i)).isNotNull() & about(i) & ~bound(i) & ~part(i) & ~joined(i))
    value = lambda i: _number(word(i)) + F.when(is_in(word(i), TENS) & unit(i + 1), _number(word(i, 1))).otherwise(0)
    return F.when(F.size(words) > 0, F.transform(places, value)).otherwise(F.array().cast("array<int>"))


def named_people(text: Column) -> Column:
    """How many names a list of people who are there has, or null: ``Connected players: Ann, Bob``, also over several lines."""
    flat = F.regexp_replace(text, r",[ \t]*\r?\n[ \t]*", ", ")
    heads = r"(?:(?:connected|online|active) (?:players|users|people)|(?:players|users|people) (?:are )?(?:connected|online|logged (?:on|in)))"
    names = F.regexp_extract(flat, rf"(?im)^.{{0,20}}\b{heads}\s*:\s*([A-Za-z][A-Za-z'-]*(?:,\s*[A-Za-z][A-Za-z'-]*)+)\s*\.?\s*$", 1)
    return F.when(names != "", F.size(F.split(names, ",")))


def _lines(text: Column) -> Column:
    plain = F.regexp_replace(text, r"\x1b\[[0-9;?]*[A-Za-z]", "")
    return F.filter(F.split(plain, r"\r\n|\r|\n"), lambda x: x.rlike(r"\S"))


def banner_count(banner: Column) -> Column:
    """Players a banner states; null if it states none, too many to believe, or two different numbers. Lines on staff alone do not count."""
    lines = F.filter(_lines(banner), lambda x: once(_words(x), lambda w: ~_has(w, STAFF) | _has(w, NOUNS)))
    found = F.array_distinct(F.flatten(F.transform(lines, stated_counts)))
    return once(found, lambda f: F.when((F.size(f) == 1) & (F.element_at(f, 1) <= MOST), F.element_at(f, 1)))


def who_reading(text: Column, near_end: int = 6) -> Column:
    """``(confidence, cnt)`` of a WHO listing.

    The last count stated in its last lines; else, below a heading of names and idle times, the rows
    of the table. A listing that ends in a prompt for a name or password counts only if it is not zero.
    """

    def read(lines: Column) -> Column:
        last = F.slice(lines, F.greatest(F.size(lines) - near_end + 1, F.lit(1)), F.lit(near_end))
        stated = F.filter(F.transform(last, lambda x: F.get(stated_counts(x), F.lit(0))), lambda n: n.isNotNull())
        count = F.coalesce(once(stated, lambda s: F.when(F.size(s) > 0, F.element_at(s, -1))), named_people(text))
        prompt = F.when(F.size(lines) > 0, F.element_at(lines, -1).rlike(r"(?i)\b(name|password|login|account)\b[^:]{0,20}[:?]\s*$|\([yY]/[nN]\)\s*[?:]?\s*$")).otherwise(False)
        heading = F.array_position(F.transform(lines, lambda x: once(_words(x), lambda w: _has(w, ["name", "player"]) & _has(w, ["idle", "on"]))), F.lit(True))
        return once(F.struct(count.alias("count"), prompt.alias("prompt"), heading.alias("heading")), lambda seen: once(kind(seen), lambda k: reading(lines, seen, k)))

    def kind(seen: Column) -> Column:
        count, prompt = seen["count"], seen["prompt"]
        return (
            F.when(count.isNotNull() & ((count > 0) | ~prompt), "count").when(prompt, "login_prompt")
            .when(seen["heading"] > 0, "per_player").otherwise("unreadable")
        )

    def reading(lines: Column, seen: Column, kind: Column) -> Column:
        body = F.filter(F.slice(lines, seen["heading"].cast("int") + 1, F.size(lines)), lambda x: ~x.rlike(r"^[-=+ \t]+$"))
        rows = F.size(F.filter(body, lambda x: F.size(stated_counts(x)) == 0))
        return F.struct(kind.alias("confidence"), F.when(kind == "count", seen["count"]).when(kind == "per_player", rows).alias("cnt"))

    return once(_lines(F.coalesce(text, F.lit(""))), read)


def redacted(text: Column) -> Column:
    """Letters and digits masked (``X``, ``x``, ``9``), but for words and numbers that a count is read from."""
    kept = NUMBER_WORDS + TENS + NOUNS + STATES + STAFF + LIMITS + TABLE_WORDS

    def masked(line: Column) -> Column:
        parts = F.regexp_extract_all(line, F.lit(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+"), F.lit(0))
        hidden = lambda w: F.regexp_replace(F.regexp_replace(F.regexp_replace(w, r"\p{Lu}", "X"), r"\p{Ll}", "x"), r"[0-9]", "9")
        shown = lambda x, w: F.when(F.lower(w).isin(kept) | (x["states"] & w.rlike("^[0-9]+$")), w).otherwise(hidden(w))
        read = F.struct(parts.alias("parts"), (F.size(stated_counts(line)) > 0).alias("states"))
        return once(read, lambda x: F.array_join(F.transform(x["parts"], lambda w: shown(x, w)), ""))

    return F.array_join(F.transform(F.split(text, "\n"), masked), "\n")
