"""What listings and banners state, line by line."""

from pyspark.sql import functions as F

from tidegauge.functions import text
from tidegauge.operators.identity import reachable_from, unique_slugs

LINES = {
    "There are 16 players connected.": [16], "There are no players connected.": [0], "Nobody is connected": [0],
    "16 of 50 players connected": [16], "Maximum of 50 players connected": [], "Three people are playing": [3],
    "Players: 12": [12], "There are 4 adventurers.": [4], "Founded 1992 by 3 players": [], "": [], "5 players left": [],
}
LISTINGS = {
    "a\n8 rows\nThere are 8 players connected.": ("count", 8), "No players connected\nPassword:": ("login_prompt", None),
    "Name  Idle\n----\nA 1\nB 2\nC 3": ("per_player", 3), "": ("unreadable", None), None: ("unreadable", None),
}
MORE = {
    "There are currently nine players on.": [9], "No-one is playing at the moment.": [0], "one of three players are active.": [3], "[0 users; 0d 00h]": [0], "fifteen people connected": [15],
    "17 players on.": [17], "Number of players on:   8": [8], "Number of connected players: 2": [2], "There are twenty-one users online": [21], "Twenty players logged in.": [20], "thirty people are online": [30],
    "There are currently 11 out of 200 users playing.": [11], "three out of 40 players are online": [3], "There are 7 out of a maximum of 64 users logged in.": [7], "5 players on the run": [],
    "There are 6 players logged out today.": [], "There are no players logged off since noon.": [], "There are 20 new players registered today.": [], "3 characters were deleted last night.": [],
    "There is nobody playing right now!": [0], "There is currently nobody in the realm.": [0], "There are currently 3 people in the realm.": [3], "There are 3 messages on the board.": [],
    "Your name must be between 6 and 12 characters long.": [], "Many players are online.": [],
}
LISTS = {
    "Connected players: Ann, Bob, Cid": ("count", 3), "Connected players: Aaaa, Aaa, Aaaaaaa,\nAaaa, Aaaaa\nType WHO for more.": ("count", 5),
    "Connected players: see the web site, or ask a wizard for help": ("unreadable", None), "The following people are logged on: Aaaa, Aaa, Aa'aa, Aaaa, Aaaaa.": ("count", 5),
    "Did I get that right, Who (Y/N)?": ("login_prompt", None), "Hello\n--[Sat Aug 19 03:14:07 2696]----[0 users; 0d 00h]--": ("count", 0),
}
BANNERS = {
    "3 players online\n4 users connected": None, "3 players online\n3 users connected": 3, "2 wizards connected": None,
    "wizards and 5 players connected": 5, "20000 players connected": None, None: None, "": None,
}


def test_lines_listings_and_banners(spark):
    rows = spark.createDataFrame([(x,) for x in LINES], "x string").select("x", text.stated_counts(F.col("x")).alias("n"))
    assert {r.x: r.n for r in rows.collect()} == LINES
    rows = spark.createDataFrame([(x,) for x in MORE], "x string").select("x", text.stated_counts(F.col("x")).alias("n"))
    assert {r.x: r.n for r in rows.collect()} == MORE
    rows = spark.createDataFrame([(x,) for x in LISTS], "x string").select("x", text.who_reading(F.col("x")).alias("r"))
    assert {r.x: (r.r.confidence, r.r.cnt) for r in rows.collect()} == LISTS
    rows = spark.createDataFrame([(x,) for x in LISTINGS], "x string").select("x", text.who_reading(F.col("x")).alias("r"))
    assert {r.x: (r.r.confidence, r.r.cnt) for r in rows.collect()} == LISTINGS
    rows = spark.createDataFrame([(x,) for x in BANNERS], "x string").select("x", text.banner_count(F.col("x")).alias("n"))
    assert {r.x: r.n for r in rows.collect()} == BANNERS


def test_redaction_keeps_what_a_count_is_read_from(spark):
    line = "Zoë has 12 friends\nThere are 12 players connected"
    out = spark.createDataFrame([(line,)], "x string").select(text.redacted(F.col("x")).alias("m")).first().m
    assert out == "Xxx xxx 99 xxxxxxx\nThere are 12 players connected"


def test_slugs_never_collide(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a-2"), (4, "a"), (5, "b"), (6, "b")], "id long, name string")
    taken = spark.createDataFrame([("b",), ("b-3",)], "slug string")
    got = {r.id: r.slug for r in unique_slugs(rows, F.col("name"), taken).collect()}
    assert got == {1: "a", 2: "a-3", 3: "a-2", 4: "a-4", 5: "b-2", 6: "b-4"}


def test_reach(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 8)], "from_id long, to_id long")
    assert sorted(tuple(r) for r in reachable_from(edges, 1).collect()) == [(1, 0), (2, 1), (3, 2), (4, 3)]


def test_a_line_is_read_once_however_often_its_words_are_asked_for(spark):
    rows = spark.createDataFrame([("5 players online",)], "x string")
    for column, most in ((text.redacted(F.col("x")), 2), (text.banner_count(F.col("x")), 2), (text.who_reading(F.col("x")), 3)):
        plan = rows.select(column.alias("y"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all(") <= most
