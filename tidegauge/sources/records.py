"""Records from outside: probe results, gateway lists, text records, seeds and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.text import address

PROBE = """host string, port int, observed_at timestamp, outcome string, offered_options array<string>, banner string, info string,
 version string, who struct<confidence:string,count:int>, mssp map<string,array<string>>, mssp_outcome string,
 banner_player_count int, failure struct<cause:string,detail:string>"""
#: Fixed value: the control character that parts documents of one file, as in ASCII.
SEPARATOR = "\x1e"
GATEWAY = "name string, host string, port int, status string, services map<string,string>, driver string, mudlib string, mud_type string"


def probes(spark: SparkSession, path: str) -> DataFrame:
    """Probe records as NDJSON; the schema is given, never inferred."""
    return spark.read.schema(PROBE).json(path)


def gateway(spark: SparkSession, path: str) -> DataFrame:
    """The inter-mud list, with whether each entry answers who requests (a positive number, or true)."""
    rows = spark.read.schema(GATEWAY).json(path)
    asked = F.lower(F.element_at("services", "who"))
    return rows.withColumn("answers_who", F.coalesce((asked == "true") | (asked.try_cast("double") > 0), F.lit(False)))


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """``host:port`` lines; what is no address, or a comment, is left out."""
    lines = spark.read.text(path).where("value NOT LIKE '#%'")
    return lines.select(address(F.col("value")).alias("a")).where("a IS NOT NULL").select("a.*").distinct()


def front_matter(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """Markdown documents as ``(path, meta, body)``; meta is a map of the lines between the marks.

    A file is one document, or, where a ``separator`` is given, the documents that end in it: many small documents need not be as many files.
    """
    read = spark.read.text(path, wholetext=True) if separator is None else spark.read.text(path, lineSep=separator)
    docs = read.select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    head = F.regexp_extract("value", r"(?s)^---\r?\n(.*?)\r?\n---\r?\n", 1)
    lines = F.filter(F.split(head, r"\r?\n"), lambda x: x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v")))
    return docs.select("path", F.map_from_entries(pairs).alias("meta"), F.regexp_replace("value", r"(?s)^---\r?\n.*?\r?\n---\r?\n", "").alias("body"))


def last_value(report: Column, name: str) -> Column:
    """The last value of a variable of a report, whatever the case of its name."""
    hits = F.map_filter(report, lambda k, _: F.lower(k) == name.lower())
    return F.try_element_at(F.flatten(F.map_values(hits)), F.lit(-1))


def field_observations(rows: DataFrame) -> DataFrame:
    """A probe record as facts: measured options, declared variables, and what was parsed."""
    options = F.transform(F.coalesce("offered_options", F.array().cast("array<string>")), lambda o: F.struct(F.concat(F.lit("capability."), F.lower(o), F.lit(".measured")).alias("field"), F.lit("handshake").alias("source"), F.lit("true").alias("value")))
    declared = F.transform(F.map_entries(F.coalesce("mssp", F.create_map().cast("map<string,array<string>>"))), lambda e: F.struct(F.upper(e["key"]).alias("field"), F.lit("mssp").alias("source"), F.try_element_at(e["value"], F.lit(-1)).alias("value")))
    version = F.array_compact(F.array(F.when(F.col("version").isNotNull(), F.struct(F.lit("VERSION").alias("field"), F.lit("info").alias("source"), F.col("version").alias("value")))))
    return rows.select("host", "port", "observed_at", F.explode(F.concat(options, declared, version)).alias("f")).select("host", "port", "observed_at", "f.*").where("value <> ''")


def decoded(payloads: DataFrame, session: str, payload: str, name: str = "text") -> DataFrame:
    """``payloads`` with their text: UTF-8 if all of a session's payloads are valid in it, else Latin-1; NUL characters go. Null stays null."""
    raw = F.col(payload)
    proof = payloads.groupBy(session).agg(F.coalesce(F.bool_and(F.is_valid_utf8(raw.cast("string"))), F.lit(True)).alias("__valid"))
    text = F.when(F.col("__valid"), raw.cast("string")).otherwise(F.decode(raw, "ISO-8859-1"))
    joined = payloads.join(proof.withColumnRenamed(session, "__session"), F.col(session).eqNullSafe(F.col("__session")))
    return joined.withColumn(name, F.replace(text, F.lit("\0"), F.lit(""))).drop("__valid", "__session")
