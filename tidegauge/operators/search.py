"""Faceted search: filters with polarity, facet counts with lifted selections, sorts and pages.

Facet counting reads the rows once: a row carries which facets it fails, and a facet's values
count the rows that fail no other facet.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP_VALUES = 20
UNKNOWN = "~unknown"


@dataclass(frozen=True)
class Choice:
    """A selected value of a facet; None is the unknown bucket, and ``exclude`` turns it round."""

    value: str | None
    exclude: bool = False

    @classmethod
    def parse(cls, token: str) -> Choice:
        """``!`` excludes, ``!!`` is a literal mark, ``~unknown`` is the unknown bucket."""
        if token.startswith("!!"):
            return cls(token[1:])
        exclude = token.startswith("!")
        body = token[1:] if exclude else token
        return cls(None if body.lower() == UNKNOWN else body, exclude)


def admits(token: Column, choice: Choice) -> Column:
    """Covered or not, other than as asked; exclusion keeps rows whose value is unknown."""
    covered = token.isNull() if choice.value is None else F.coalesce(F.lower(token) == choice.value.lower(), F.lit(False))
    return ~covered if choice.exclude else covered


def text_matches(needle: str | None, *columns: str) -> Column:
    """Contained in any column, whatever the case; blank asks nothing. User text is no pattern."""
    wanted = (needle or "").strip().lower()
    if not wanted:
        return F.lit(True)
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c)).contains(wanted), F.lit(False))
    return hit


def offers_all(protocols: Column, wanted: list[str]) -> Column:
    need = F.array(*[F.lit(w.lower()) for w in wanted])
    return F.size(F.array_except(need, F.transform(F.coalesce(protocols, F.array().cast("array<string>")), F.lower))) == 0


def search(rows: DataFrame, choices: dict[str, Choice], needle: str | None = None, columns: tuple[str, ...] = ("name", "codebase")) -> DataFrame:
    out = rows.where(text_matches(needle, *columns))
    for facet, choice in choices.items():
        out = out.where(admits(F.col(facet), choice))
    return out


def facet_counts(rows: DataFrame, facets: list[str], choices: dict[str, Choice]) -> DataFrame:
    """``(facet, value, n)``: each against the rows that pass all selections but its own; one scan."""
    fails = F.array_compact(F.array(*[F.when(~admits(F.col(f), choices[f]), F.lit(f)) for f in choices])) if choices else F.array().cast("array<string>")
    wide = rows.select(fails.alias("fails"), F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).alias("value")) for f in facets])).alias("x"))
    fits = (F.size("fails") == 0) | ((F.size("fails") == 1) & (F.element_at("fails", 1) == F.col("x.facet")))
    return wide.where(F.size("fails") <= 1).groupBy(F.col("x.facet").alias("facet"), F.col("x.value").alias("value")).agg(F.count_if(fits).alias("n"))


#: Fixed value: with fewer results than this, a selection to drop is suggested.
LOOSEN_BELOW = 10


def loosened(rows: DataFrame, choices: dict[str, Choice], below: int = LOOSEN_BELOW) -> DataFrame:
    """``(facet, matching, without)``: the selection that holds most results back, if there are fewer than ``below``; no row if none does.

    Rows that fail just one selection are what its removal would add, so one scan answers for all of them.
    """
    fails = F.array_compact(F.array(*[F.when(~admits(F.col(f), c), F.lit(f)) for f, c in choices.items()]))
    tally = rows.select(fails.alias("fails")).where(F.size("fails") <= 1).groupBy(F.get("fails", F.lit(0)).alias("facet")).agg(F.count("*").alias("n"))
    matching = F.coalesce(F.sum(F.when(F.col("facet").isNull(), F.col("n"))), F.lit(0))
    best = F.min_by(F.when(F.col("facet").isNotNull(), F.struct("facet", "n")), F.when(F.col("facet").isNotNull(), F.struct(-F.col("n"), F.col("facet"))))
    out = tally.agg(matching.alias("matching"), best.alias("best")).where((F.col("matching") < below) & F.col("best").isNotNull())
    return out.select("best.facet", "matching", (F.col("matching") + F.col("best.n")).alias("without"))


def open_vocabulary(counts: DataFrame, facet: str, chosen: str | None = None, top: int = TOP_VALUES) -> DataFrame:
    """The most frequent values, the chosen one first and kept at zero, and always the unknown bucket."""
    mine = counts.where((F.col("facet") == facet) & (F.col("n") > 0))
    picked = F.coalesce(F.lower("value") == (chosen.lower() if chosen else ""), F.lit(False))
    known = mine.where("value IS NOT NULL").withColumn("selected", picked)
    best = known.orderBy(F.desc("selected"), F.desc("n"), "value").limit(top)
    unknown = mine.where("value IS NULL").withColumn("selected", F.lit(False))
    out = best.unionByName(unknown)
    if chosen:
        zero = counts.sparkSession.createDataFrame([(facet, chosen, 0, True)], "facet string, value string, n long, selected boolean")
        out = out.unionByName(zero.join(known.where("selected"), "facet", "left_anti").select("facet", "value", "n", "selected"))
    return out.select("facet", "value", "n", "selected")


def bounded_vocabulary(counts: DataFrame, rows: DataFrame, facet: str, vocabulary: list[str]) -> DataFrame:
    """Declared values in declared order: zero counts stay if the value occurs at all."""
    words = counts.sparkSession.createDataFrame(list(enumerate(vocabulary)), "place int, value string")
    ever = rows.select(F.col(facet).alias("value")).distinct()
    found = counts.where(F.col("facet") == facet).select("value", "n")
    return F.broadcast(words).join(ever, "value").join(found, "value", "left").select("place", "value", F.coalesce("n", F.lit(0)).alias("n"))


def presence_counts(results: DataFrame, values: DataFrame, key: str = "id") -> DataFrame:
    """Protocols offered by the results, counted on the results themselves."""
    return values.join(results.select(key), key, "left_semi").groupBy(F.lower("protocol").alias("value")).agg(F.countDistinct(key).alias("n"))


def ranked(rows: DataFrame, metric: Column, can_rank: Column, limit: int, offset: int = 0) -> DataFrame:
    """Rows without a rank last, then the metric from high to low, then name; with their place."""
    out = rows.withColumn("metric", F.when(can_rank, metric))
    order = [F.col("metric").isNull(), F.desc("metric"), F.lower("name"), F.col("id")]
    page = out.orderBy(*order).offset(offset).limit(limit)
    return page.withColumn("place", F.row_number().over(Window.orderBy(*order)) + offset)  # over one page


def page_bounds(limit: int | None, offset: int | None) -> tuple[int, int]:
    """The default page is 100 rows, and none has over 500."""
    return min(max(100 if limit is None else limit, 1), 500), max(offset or 0, 0)


def adult(genre: Column, flag: Column) -> Column:
    return (F.coalesce(F.lower(F.trim(genre)) == "adult", F.lit(False))) | F.coalesce(F.lower(F.trim(flag)).isin("1", "true", "yes"), F.lit(False))


def commonest(rows: DataFrame, value: str) -> DataFrame:
    """The most frequent spelling of each case-folded value, first in order among equals; and the group's size."""
    spelt = rows.where(F.col(value).isNotNull()).groupBy(F.lower(value).alias("folded"), F.col(value).alias("spelling")).agg(F.count("*").alias("n"))
    best = F.min_by("spelling", F.struct(-F.col("n"), F.col("spelling")))
    return spelt.groupBy("folded").agg(best.alias("spelling"), F.sum("n").alias("n"))
