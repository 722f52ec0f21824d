"""Vocabulary matches: boundaries of words, order of preference, and what gives credit."""

from pyspark.sql import functions as F

from tidegauge.functions import vocabulary as V


def column(spark, texts, made):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "x string").select(made(F.col("x"))).collect()]


def test_word_boundaries(spark):
    texts = ["MudOS", "the mudos22.", "xmudos", "mudosx", "1mudos", "(MudOS)", "xmudos mudos", "émudos", "mudosé", "", None]
    assert column(spark, texts, lambda x: V.names_word(x, "mudos")) == [True, True, False, False, False, True, True, False, False, False, None]


def test_lineages(spark):
    texts = {
        "PennMUSH 1.8": "MUSH", "rom24b6": None, "ROM24": "DikuMUD", "my own ROM based SMAUG": "DikuMUD", "ROM LPMud": None, "TMI-2": "LPMud", "Dead Souls": "LPMud", "Evennia": None,
        "": None, None: None, "ToastStunt": "MOO", "romance": None,
    }
    assert dict(zip(texts, column(spark, list(texts), V.lineage))) == texts


def test_credits(spark):
    screens = {
        1: "Powered by FluffOS. A DikuMUD derivative of old.", 2: "The DikuMUD tavern. Copyright us.", 3: "Based on Merc by Hatchet.", 4: "Michael Seifert was here", 5: "michael  seifert", 6: "circle  mud, running",
        7: "<b>Running</b> Circle MUD", 8: "© DGD", 9: "runningdgd", 10: None, 11: "", 12: "built on nothing by stærfeldt", 13: "code by Derek Snider; based on DikuMUD",
    }
    rows = spark.createDataFrame(list(screens.items()), "id int, screen string")
    got = {r.id: r.family for r in V.credits(rows, "id", "screen").collect()}
    assert got == {1: "DikuMUD", 3: "Merc", 4: "DikuMUD", 5: "DikuMUD", 6: "CircleMUD", 7: "CircleMUD", 8: "DGD", 12: "DikuMUD", 13: "SMAUG"}


def test_placeholder_names(spark):
    rows = [("Corvid", None), (" Corvid ", "Penn 1"), ("PennMUSH", None), ("n/a", None), ("", None), (None, "x"), ("Circle", "circle 3.1"), ("Circle 3.1", "circle 3.1"), ("Circle", "ROM"), ("-1", None)]
    got = [r[0] for r in spark.createDataFrame(rows, "n string, c string").select(V.meaningful_name(F.col("n"), F.col("c"))).collect()]
    assert got == ["Corvid", "Corvid", None, None, None, None, None, None, "Circle", None]
