"""Nested documents: children without rows, without a parent, and the shape of the plan."""

import json
import re

from tidegauge.operators import documents as D
from tidegauge.plans import QUERIES

DATA = "/root/testdata/sf0.001"


def test_children_come_in_order_and_empty_where_there_are_none(spark):
    parents = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "game_id long, name string")
    ports = spark.createDataFrame([(1, 23, "x"), (1, 5, None), (9, 1, "orphan"), (None, 2, "none")], "game_id long, port int, kind string")
    tags = spark.createDataFrame([(2, "t")], "game_id long, tag string")
    found = {r.game_id: r for r in D.assembled(parents, {"ports": ports, "tags": tags}).collect()}
    assert set(found) == {1, 2, 3}
    assert [tuple(p) for p in found[1].ports] == [(5, None), (23, "x")] and found[1].tags == []
    assert found[2].ports == [] and [t.tag for t in found[2].tags] == ["t"] and found[3].name is None


def test_no_children_rows_at_all(spark):
    parents = spark.createDataFrame([(1, "a")], "game_id long, name string")
    none = spark.createDataFrame([], "game_id long, port int")
    assert [tuple(r) for r in D.assembled(parents, {"ports": none}).collect()] == [(1, "a", [])]
    assert D.assembled(parents.where("false"), {"ports": none}).collect() == []


def test_plan_has_no_join_of_children_and_one_exchange_for_each(spark):
    documents = QUERIES["game_document"](spark, DATA)
    documents.collect()
    plan = documents._jdf.queryExecution().executedPlan().toString()
    plan = plan[plan.index("Final Plan") : plan.index("Initial Plan")]
    assert len(re.findall(r"SortMergeJoin|ShuffledHashJoin", plan)) <= 2  # names of neighbours, merged listings
    assert len(re.findall(r"(?<!Reused)(?<!Broadcast)Exchange hashpartitioning", plan)) <= 7 + 4  # seven children; games, merges, names and the grouping
    document = json.loads(documents.first().document)
    assert list(document)[:6] == ["id", "slug", "name", "state", "archived", "claimed"] and document["presence"]["zone"] == "UTC"
