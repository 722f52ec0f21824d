"""The pipeline's stages keep the columns of documents, and each takes out only what its operator says."""

from pyspark.sql import functions as F

import corpus_pipeline
from tidegauge.llm._shared import durable_table
from tidegauge.llm.queries import table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, ids = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
        docs = durable_table(stage(spark, docs, SF), f"test-{name.replace(' ', '-')}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert docs.columns == [*columns, "ids", "decoded"]
    raw, clean, lines, once, mixed = ids
    assert clean <= raw  # 200 rows may be too few labels to call any document toxic
    assert lines == clean
    assert once < lines  # copies go
    assert mixed == once  # documents repeat, none goes
    marks = {r.doc_id: r.toxic for r in table(spark, SF, "labels").collect()}
    ordinary = {i for i in raw if marks.get(i) == 0}
    assert len(ordinary & clean) >= 0.97 * len(ordinary)
    assert {r.doc_id for r in docs.select("doc_id").collect()} == mixed
    assert docs.where("length(ids) % 4 <> 0 or (length(trim(text)) > 0 and length(ids) = 0)").count() == 0


def staged(spark, docs):
    """What each stage gives, in turn, on the smallest tables' labels."""
    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = durable_table(stage(spark, docs, SF), f"test-{name.replace(' ', '-')}")
        out.append(docs)
    return out


def test_stages_on_rows_that_are_not_plain(spark):
    """Null, empty, very long and repeated rows, rows without doc_id, and columns named as the operators' own."""
    own = ["score", "label", "toxic", "n", "h", "rate", "line", "raw", "tokens", "component_id", "domain", "copies", "place", "Key", "digest"]
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    words = " ".join(f"word{i}" for i in range(60_000))
    odd = [(None, "a text of its own without an id at all"), (None, None), (900_001, None), (900_002, ""), (900_003, "   \n\t"), (900_004, words), (900_005, "twice the very same row here"), (900_005, "twice the very same row here")]
    docs = docs.unionByName(spark.createDataFrame([(i, t, None, None, None) for i, t in odd], docs.schema))
    docs = docs.select("*", *[F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in own])
    before = {r.doc_id: r for r in docs.collect()}
    *kept, last = staged(spark, docs)
    for stage in kept:
        assert stage.columns == docs.columns
    assert last.columns[: len(docs.columns)] == docs.columns
    rows = last.collect()
    for r in rows:  # what passes through is the row's own
        assert [r[c] for c in own] == [before[r.doc_id][c] for c in own]
    found = {r.doc_id: r for r in rows}
    assert 900_004 in found and len(found[900_004].text) == len(words)
    assert sum(r.doc_id == 900_005 for r in kept[2].collect()) <= 1  # one of a group of copies stays
    assert all(r.ids is not None for r in rows)


def test_stages_on_an_empty_table(spark):
    docs = table(spark, SF, "documents")
    for stage in staged(spark, docs.where("false")):
        assert stage.count() == 0 and stage.columns[: len(docs.columns)] == docs.columns
