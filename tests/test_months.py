"""Month-partitioned tables: what is read, what is rewritten, and passes over them."""

import os
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import maintenance as M
from tidegauge.operators import presence as P
from tidegauge.sources.months import MonthTable, month_after

SAMPLES = "game_id long, sampled_at timestamp_ntz, cnt int"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(*at):
    return [(i % 2, datetime.fromisoformat(t), i) for i, t in enumerate(at)]


def stamps(table):
    """File names of each month: they change when a month is rewritten."""
    return {m: sorted(os.listdir(f"{table.path.removeprefix('file:')}/month={m}")) for m in table.months()}


@pytest.fixture
def samples(spark):
    table = MonthTable(spark, SAMPLES, "sampled_at", name="samples")
    table.append(spark.createDataFrame(rows("2023-11-30 23:59:59", "2023-12-01 00:00:00", "2023-12-31 22:10:00", "2024-01-01 00:30:00", "2024-01-31 10:00:00", "2024-02-01 01:15:00"), SAMPLES))
    return table


def test_reads_only_the_months_of_a_span(samples):
    span = samples.read(datetime(2023, 12, 1), datetime(2024, 1, 1))
    assert sorted(r.cnt for r in span.collect()) == [1, 2]
    plan = plan_of(span)
    filters = plan[plan.index("PartitionFilters") :].split("]")[0]
    assert "month" in filters and "2023-12-01" in plan and "PushedFilters: [IsNotNull(sampled_at)" in plan
    assert {r[0].split("month=")[1][:10] for r in span.select(F.input_file_name()).collect()} == {"2023-12-01"}


def test_overwrites_just_the_months_it_is_given(spark, samples):
    before = stamps(samples)
    samples.overwrite(samples.read(datetime(2023, 12, 1), datetime(2024, 1, 1)).withColumn("cnt", F.col("cnt") + 100))
    after = stamps(samples)
    assert [m for m in before if before[m] != after[m]] == [date(2023, 12, 1)]
    assert sorted(r.cnt for r in samples.read().collect()) == [0, 3, 4, 5, 101, 102]


def test_two_passes_rewrite_only_touched_months(spark, samples):
    rolled = MonthTable(spark, M.ROLLED, "bucket", name="rolled")
    mark = M.roll_months(rolled, samples, "hour", None, datetime(2024, 1, 20, 12, 30))
    assert mark == datetime(2024, 1, 20, 12) and rolled.months() == [date(2023, 11, 1), date(2023, 12, 1), date(2024, 1, 1)]
    before = stamps(rolled)
    mark = M.roll_months(rolled, samples, "hour", mark, datetime(2024, 2, 2))
    after = stamps(rolled)
    assert [m for m in after if before.get(m) != after[m]] == [date(2024, 1, 1), date(2024, 2, 1)]
    want = sorted(map(tuple, P.rollup(samples.read(), "hour").collect()))
    assert sorted(map(tuple, rolled.read().collect())) == want
    again = M.roll_months(rolled, samples, "hour", mark, datetime(2024, 2, 2))  # the same pass changes nothing
    assert again == mark and sorted(map(tuple, rolled.read().collect())) == want


def test_no_samples_and_no_ended_hour(spark):
    empty, rolled = MonthTable(spark, SAMPLES, "sampled_at"), MonthTable(spark, M.ROLLED, "bucket")
    assert M.roll_months(rolled, empty, "day", None, datetime(2024, 1, 1)) is None
    assert empty.read().count() == 0 and empty.months() == []
    with pytest.raises(Exception, match="sampled_at is null"):
        empty.append(spark.createDataFrame([(1, None, 2)], SAMPLES))


def test_months_come_and_go_as_folders(samples):
    samples.create(date(2024, 3, 1))
    samples.drop(date(2023, 11, 1), date(2023, 12, 1))
    assert samples.months() == [date(2024, 1, 1), date(2024, 2, 1), date(2024, 3, 1)]
    assert sorted(r.cnt for r in samples.read().collect()) == [3, 4, 5]
    assert month_after(date(2023, 12, 1)) == date(2024, 1, 1) and month_after(date(2024, 1, 1)) == date(2024, 2, 1)
