"""What may be dialled: opt-outs by host and port, and the scope of the addresses that a host has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import net

#: What a report calls the wish not to be crawled, in order, after the name of the crawler that is meant; and values that say the opposite.
OPT_OUT_ENDINGS = [" OPT-OUT", "_OPT_OUT", " OPTOUT"]
FOR_ALL = "CRAWL_OPT_OUT"
NEGATIVES = ["0", "no", "false", "off", "opt-in", "optin"]
#: Fixed value: how a token of a name record that asks not to be crawled reads.
_TOKEN = r"^(?i:opt-?out)(?:[=:](.*))?$"


def report_opt_out(report: Column, crawler: str) -> Column:
    """The first variable that asks this crawler, or all, with its value, of a report ``map<string, array<string>>`` with upper-case names; else null."""
    first = lambda v: F.trim(F.get(F.try_element_at(report, F.lit(v)), F.lit(0)))
    asks = [F.when((first(v) != "") & ~F.lower(first(v)).isin(*NEGATIVES), F.struct(F.lit(v).alias("variable"), first(v).alias("value"))) for v in [*[crawler.upper() + end for end in OPT_OUT_ENDINGS], FOR_ALL]]
    return F.coalesce(*asks)


def record_opt_out(records: Column, port: Column) -> Column:
    """``(scope, record)`` of the first token in text records that asks for this port; a null scope is the whole host. Else null.

    A token names ports, or none for all. A qualifier that is no list of numbers reads as the whole host:
    who asked in words that are not known is not dialled either.
    """

    def token(word: Column, record: Column) -> Column:
        qualifier = F.regexp_extract(word, _TOKEN, 1)
        ports = F.filter(F.split(qualifier, ","), lambda p: p != "")
        numbers = F.transform(ports, lambda p: F.trim(p).try_cast("int"))
        whole = (qualifier == "") | F.exists(numbers, lambda n: n.isNull())
        named = F.exists(numbers, lambda n: n == port)
        asked = word.rlike(_TOKEN) & (whole | named)
        return F.when(asked, F.struct(F.when(~whole, port).alias("scope"), F.trim(record).alias("record")))

    asked = F.flatten(F.transform(records, lambda r: F.transform(F.filter(F.split(r, "[ \t;]+"), lambda w: w != ""), lambda w: token(w, r))))
    return F.get(F.filter(asked, lambda a: a.isNotNull()), F.lit(0))


def standing(targets: DataFrame, opt_outs: DataFrame) -> DataFrame:
    """``targets(host, port, …)`` with ``opt_out``, the first that stands for them, or null.

    ``opt_outs(host, port, source, recorded_at, withdrawn_at)``; a null port is every port of the host. Two equality
    joins, one on host and port and one on the host alone; each side has one row per key by then.
    """
    found = F.struct("recorded_at", F.coalesce("port", F.lit(-1)).alias("at_port"), "source", "port")
    live = opt_outs.where("withdrawn_at IS NULL").groupBy("host", "port").agg(F.min(found).alias("found"))
    exact = live.where("port IS NOT NULL").select("host", "port", F.col("found").alias("exact"))
    whole = live.where("port IS NULL").select("host", F.col("found").alias("whole"))
    both = targets.join(exact, ["host", "port"], "left").join(whole, "host", "left").withColumn("first", F.least("exact", "whole"))
    shown = F.when(F.col("first").isNotNull(), F.struct("first.source", "first.port", "first.recorded_at"))
    return both.select(*targets.columns, shown.alias("opt_out"))


def gate(targets: DataFrame, opt_outs: DataFrame, answers: DataFrame) -> DataFrame:
    """``targets`` with ``ruling`` and ``may_dial`` after their names were asked.

    ``answers(host, answered, records)``. An opt-out by report or request is final and no name is asked.
    No answer leaves things as they stand. An answer without the record withdraws what the name once
    asked, and then any other opt-out that stands still holds; a host without a row was not answered.
    """
    now = standing(targets, opt_outs)
    others = standing(targets.select("host", "port").distinct(), opt_outs.where("source <> 'dns_txt'")).select("host", "port", F.col("opt_out").alias("other"))
    asked = now.join(answers.select("host", "answered", "records"), "host", "left").join(others, ["host", "port"], "left")
    final = F.col("opt_out.source").isNotNull() & (F.col("opt_out.source") != "dns_txt")
    heard = F.coalesce("answered", F.lit(False))
    record = record_opt_out(F.col("records"), F.col("port"))
    ruling = (
        F.when(final, "standing").when(~heard, F.when(F.col("opt_out").isNotNull(), "unanswered_standing").otherwise("unanswered_free"))
        .when(record.isNotNull(), F.when(F.col("opt_out").isNull(), "recorded").otherwise("confirmed"))
        .when(F.col("opt_out").isNull(), "free").when(F.col("other").isNotNull(), "withdrawn_other_stands").otherwise("withdrawn")
    )
    return asked.select(*targets.columns, ruling.alias("ruling"), ruling.isin("unanswered_free", "free", "withdrawn").alias("may_dial"))


def scope_ruling(is_operator_seed: Column, addresses: Column) -> Column:
    """``allowed``, ``refused_non_global`` or ``unresolvable``: one address out of scope refuses a host; an operator's own seed is not asked about."""
    inside = F.transform(addresses, net.dialled_scope)
    return (
        F.when(is_operator_seed, "allowed").when(addresses.isNull() | (F.size(addresses) == 0), "unresolvable")
        .when(F.exists(inside, lambda x: ~F.coalesce(x, F.lit(False))), "refused_non_global").otherwise("allowed")
    )


def in_blocks(addresses: DataFrame, blocks: DataFrame, text: str = "address") -> DataFrame:
    """``addresses`` with ``block``, the longest of ``blocks(block, family, length, hi, lo)`` they lie in, or null.

    A range join as equality joins: each address is looked up once per prefix length that blocks of its family have (161 at most).
    """
    lengths = blocks.groupBy("family").agg(F.collect_set("length").alias("lengths"))
    parsed = addresses.select(F.col(text).alias("_text")).distinct().withColumn("at", net.address(F.col("_text")))
    tried = parsed.where("at IS NOT NULL").select("_text", "at.*").join(F.broadcast(lengths), "family").select("_text", "family", "hi", "lo", F.explode("lengths").alias("length"))
    keyed = tried.withColumn("bits", net.prefix(F.col("hi"), F.col("lo"), F.col("length"))).select("_text", "family", "length", "bits.hi", "bits.lo")
    best = keyed.join(blocks, ["family", "length", "hi", "lo"]).groupBy(F.col("_text").alias(text)).agg(F.max_by("block", F.struct("length", "block")).alias("block"))
    return addresses.join(best, text, "left").select(*addresses.columns, "block")
