"""Texts against vocabularies: lineages of engines, credits on a screen, placeholder names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.net import once
from tidegauge.functions.text import codebase_family, flattened

# Engines by lineage.
LINEAGES = {
    "MUSH": ["TinyMUSH", "PennMUSH", "TinyMUX", "MUX", "RhostMUSH", "Rhost", "CobraMUSH", "AresMUSH"],
    "MUCK": ["TinyMUCK", "MUCK", "Fuzzball", "ProtoMUCK", "GlowMUCK"],
    "MOO": ["MOO", "LambdaMOO", "Stunt", "ToastStunt"],
    "DikuMUD": [
        "Diku", "DikuMUD", "Merc", "ROM", "ROT", "SMAUG", "CircleMUD", "tbaMUD", "LuminariMUD", "Envy", "GodWars", "Anatolia", "EmlenMud", "NarutoMUD", "LastOutpost",
        "PizzaMUD", "Galaxy Engine", "EmpireMUD", "JediMUD", "MUME",
    ],
    "LPMud": [
        "LPMud", "MudOS", "FluffOS", "LDMud", "DGD", "Midnight Sun", "CD", "Epiphany", "TMI-2", "Dead Souls", "Discworld lib", "UNIlib", "3Scapes mudlib", "TD-MUDLIB",
        "MorgenGrauen", "Aldebaran", "RoleMUD", "Moral Decay", "PD/NM III",
    ],
    "AberMUD": ["AberMUD"],
}
# What names an engine on a screen, in order; engines count only where a sentence gives credit, authors anywhere.
CREDITS = [
    ("evennia", "Evennia", "engine"), ("coffeemud", "CoffeeMUD", "engine"), ("aresmush", "AresMUSH", "engine"), ("ranvier", "Ranvier", "engine"), ("rapture runtime", "Rapture", "engine"),
    ("pennmush", "PennMUSH", "engine"), ("rhostmush", "RhostMUSH", "engine"), ("cobramush", "CobraMUSH", "engine"), ("tinymux", "TinyMUX", "engine"), ("tinymush", "TinyMUSH", "engine"),
    ("protomuck", "ProtoMUCK", "engine"), ("glowmuck", "GlowMUCK", "engine"), ("fuzzball", "Fuzzball MUCK", "engine"), ("tinymuck", "TinyMUCK", "engine"), ("tbamud", "tbaMUD", "engine"),
    ("smaug", "SMAUG", "engine"), ("thoric", "SMAUG", "author"), ("derek snider", "SMAUG", "author"), ("russ taylor", "ROM", "author"), ("circlemud", "CircleMUD", "engine"),
    ("circle mud", "CircleMUD", "engine"), ("jeremy elson", "CircleMUD", "author"), ("hatchet", "Merc", "author"), ("dikumud", "DikuMUD", "engine"), ("diku", "DikuMUD", "engine"),
    ("staerfeldt", "DikuMUD", "author"), ("stærfeldt", "DikuMUD", "author"), ("nyboe", "DikuMUD", "author"), ("michael seifert", "DikuMUD", "author"), ("sebastian hammer", "DikuMUD", "author"),
    ("fluffos", "FluffOS", "engine"), ("mudos", "MudOS", "engine"), ("ldmud", "LDMud", "engine"), ("dgd", "DGD", "engine"), ("lpmud", "LPMud", "engine"), ("mudlib", "LPMud", "engine"),
]
# Phrases that give credit.
ATTRIBUTIONS = [
    "based on", "based upon", "derivative of", "derived from", "powered by", "running", "running on", "built on", "built with", "code by", "coded by", "coded in", "created by", "written by",
    "copyright", "original",
]
# Names that are not a listing's own.
ENGINE_NAMES = [
    "PennMUSH", "TinyMUSH", "TinyMUX", "MUX", "RhostMUSH", "Rhost", "CobraMUSH", "AresMUSH", "Evennia", "CoffeeMud", "CircleMUD", "tbaMUD", "ROM", "SMAUG", "Diku", "DikuMUD",
    "MudOS", "FluffOS", "LPMud", "LDMud", "MOO", "LambdaMOO", "TinyMUCK", "MUCK", "Fuzzball",
]
TEMPLATES = [
    "Unknown", "Unnamed", "Untitled", "N/A", "None", "TBD", "Change Me", "ChangeMe", "Your MUD Name", "Your MUD", "MUD Name", "My Server", "Example", "Test", "localhost", "0", "-1",
]

_CREDIT_PHRASE = "(?i)\\b(?:" + "|".join(p.replace(" ", "\\s+") for p in ATTRIBUTIONS) + ")\\b|\\(c\\)|©"


def names_word(text: Column, word: str) -> Column:
    """Whether a text names a word or phrase: no letter or digit before it and no letter after it, in either case."""
    return text.rlike(rf"(?iu)(?<![\p{{L}}\p{{N}}])\Q{word}\E(?!\p{{L}})") if word else F.lit(False)


def lineage(codebase: Column) -> Column:
    """The lineage of a code base: that of its family, else the one that its words name, with or without digits at their end; null if they name none or several."""
    known = F.create_map(*[F.lit(x) for line, names in LINEAGES.items() for name in names for x in (name.lower(), line)])
    of = lambda word: F.try_element_at(known, word)

    def found(family: Column) -> Column:
        words = F.filter(F.split(F.lower(family), r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"), lambda w: w != "")
        named = F.array_distinct(F.array_compact(F.transform(words, lambda w: F.coalesce(of(w), of(F.regexp_replace(w, "[0-9]+$", ""))))))
        return F.coalesce(of(F.lower(family)), once(named, lambda n: F.when(F.size(n) == 1, F.get(n, F.lit(0)))))

    return once(codebase_family(codebase), found)


def phrases(text: Column) -> Column:
    """The words of a text, and its pairs of words parted by one space, in lower case; digits at the end of one do not matter."""
    word = r"(?<![\p{L}\p{N}])"
    single = F.regexp_extract_all(text, F.lit(word + r"\p{L}++"), F.lit(0))
    pairs = F.regexp_extract_all(text, F.lit(word + r"(?=(\p{L}++ \p{L}++))"), F.lit(1))
    return F.transform(F.array_distinct(F.concat(single, pairs)), F.lower)


def credits(banners: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, family)`` of the screens that credit an engine: the first of :data:`CREDITS` that a sentence names.

    The phrases of each sentence are met with the vocabulary, and only those in it leave their row; these are joined to
    their places in the order.
    """
    table = banners.sparkSession.createDataFrame([(n, *c) for n, c in enumerate(CREDITS)], "place int, phrase string, family string, tier string")
    vocabulary = F.array(*[F.lit(marker) for marker, _, _ in CREDITS])
    sentences = banners.select(key, F.explode(F.split(flattened(F.col(text)), r"(?<=[.!?;])\s+")).alias("sentence"))
    hits = sentences.select(key, F.col("sentence").rlike(_CREDIT_PHRASE).alias("credited"), F.explode(F.array_intersect(phrases(F.col("sentence")), vocabulary)).alias("phrase"))
    good = hits.join(table, "phrase").where((F.col("tier") == "author") | F.col("credited"))
    return good.groupBy(key).agg(F.min_by("family", "place").alias("family"))


def is_template(value: Column) -> Column:
    plain = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return (plain == "") | plain.isin(*[t.lower() for t in TEMPLATES])


def is_placeholder(value: Column) -> Column:
    """Nothing, a template's text, or the name of an engine."""
    return is_template(value) | F.lower(F.trim(value)).isin(*[n.lower() for n in ENGINE_NAMES])


def meaningful_name(name: Column, codebase: Column) -> Column:
    """A name that is a listing's own, trimmed: no placeholder, not its code base, nor the first word of it."""
    plain, base = F.lower(F.trim(name)), F.lower(F.trim(F.coalesce(codebase, F.lit(""))))
    engine = (base != "") & ((plain == base) | (plain == F.split(base, " ")[0]))
    return F.when(~is_placeholder(name) & ~engine, F.trim(name))
