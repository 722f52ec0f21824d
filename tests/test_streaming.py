"""Streams of several batches, with rows out of order, and the bounds of a maintenance pass."""

from datetime import datetime, timedelta

import pandas as pd
import pytest

from tidegauge import streaming as S
from tidegauge.operators import maintenance as M
from tidegauge.streaming import expiring as X

START = datetime(2024, 1, 1)
SCHEMA = "key long, at timestamp, tie long, value string, cnt int"


def minutes(n):
    return START + timedelta(minutes=n)


def stream(spark, folder, batches):
    """Each batch is a file; files are read one after another."""
    for n, rows in enumerate(batches):
        made = spark.createDataFrame([(k, minutes(m), t, v, c) for k, m, t, v, c in rows], SCHEMA)
        made.coalesce(1).write.mode("append").parquet(f"{folder}/{n}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{folder}/*")


def test_runs_take_rows_in_order_of_time_whatever_batch_they_come_in(spark, tmp_path):
    batches = [
        [(1, 0, 0, "up", 1), (1, 60, 1, "down", 1), (2, 0, 2, "up", 1)],
        [(1, 30, 3, "slow", 1), (2, 10, 4, "up", 1), (None, 5, 5, "up", 1), (2, 20, 6, None, 1)],
        [(1, 60, 7, "up", 1), (3, 1000, 8, "up", 1)],
        [(3, 1001, 9, "up", 1)],
        [(1, 40, 9, "late", 1)],
    ]
    rows = stream(spark, str(tmp_path), batches)
    got = S.finished(S.closed_runs(rows, "key", "at", "tie", "value"), "t").collect()
    day = 1704067200  # START
    want = {(1, "up", 0, 30, "slow"), (1, "slow", 30, 60, "down"), (1, "down", 60, 60, "up")}
    assert {(r[0], r[1], (r[2] // 10**6 - day) // 60, (r[3] // 10**6 - day) // 60, r[4]) for r in got} == want


def test_rollup_gives_each_bucket_once_and_leaves_out_what_is_too_late(spark, tmp_path):
    batches = [[(1, 0, 0, "", 4), (1, 70, 1, "", None)], [(1, 10, 2, "", 6), (1, 400, 3, "", 1)], [(1, 900, 5, "", 1)], [(1, 20, 4, "", 99)]]
    rows = stream(spark, str(tmp_path), batches).selectExpr("key AS game_id", "at AS sampled_at", "cnt")
    got = {(r.bucket, r.counted_samples, r.unmeasurable_samples, r.sum_count) for r in S.finished(S.rollup(rows), "t").collect()}
    assert got == {(minutes(0), 2, 0, 10), (minutes(60), 0, 1, None), (minutes(360), 1, 0, 1)}


def test_repeats_go_across_batches(spark, tmp_path):
    rows = stream(spark, str(tmp_path), [[(1, 0, 0, "", 4), (1, 0, 0, "", 4)], [(1, 0, 0, "", 4), (1, 1, 1, "", 4)]])
    assert S.finished(S.deduplicated(rows, ["key", "at"], "at"), "t").count() == 2


def test_no_rows_give_no_rows(spark, tmp_path):
    rows = stream(spark, str(tmp_path), [[]])
    assert S.finished(S.closed_runs(rows, "key", "at", "tie", "value"), "t").collect() == []


def test_span_of_a_pass():
    now = datetime(2024, 1, 2, 10, 40)
    assert M.span_to_roll("hour", None, None, now) is None
    assert M.span_to_roll("hour", datetime(2024, 1, 2, 8), None, now) == (datetime(2024, 1, 2, 5), datetime(2024, 1, 2, 10))
    assert M.span_to_roll("day", datetime(2024, 1, 2, 2), None, now) == (datetime(2024, 1, 1), datetime(2024, 1, 2, 10))
    assert M.span_to_roll("hour", datetime(2024, 1, 2, 14), None, now) is None


def test_a_pass_run_again_changes_nothing_and_never_moves_back(spark):
    rows = spark.createDataFrame([(1, minutes(5), 3), (1, minutes(65), None)], "game_id long, sampled_at timestamp_ntz, cnt int")
    empty = M.P.rollup(rows.where("false"), "hour")
    once, mark = M.roll(empty, rows, "hour", None, minutes(150))
    twice, again = M.roll(once, rows, "hour", mark, minutes(150))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) and mark == again == minutes(120)
    assert M.roll(empty, rows.where("false"), "hour", None, minutes(150))[1] is None
    assert M.roll(once, rows, "hour", minutes(600), minutes(450))[1] == minutes(600)


def test_nothing_goes_before_it_is_rolled_up(spark):
    marks = spark.createDataFrame([("hour", START)], "grain string, rolled_up_through timestamp_ntz")
    got = {r.kind: r.boundary for r in M.boundaries(marks, "timestamp_ntz'2025-01-01 00:00:00'", 90, 90, 365).collect()}
    assert got == {"raw": None, "hour": None, "day": datetime(2024, 1, 2)}
    with pytest.raises(ValueError):
        M.boundaries(marks, "timestamp_ntz'2025-01-01 00:00:00'", raw_days=55)


def micros(minute):
    return int((minutes(minute) - datetime(1970, 1, 1)).total_seconds()) * 1_000_000


def test_silence_and_return_over_several_batches(spark, tmp_path):
    """Gap of an hour, delay of ten minutes: nothing is said of a time that the watermark has not passed."""
    batches = [
        [(1, 0, 0, "x", 1), (2, 0, 0, "x", 1), (1, 30, 0, "x", 1)],
        [(2, 40, 0, "x", 1), (1, 25, 0, "x", 1), (3, 45, 0, "x", 1)],  # out of order, within the delay of nothing passed yet
        [(2, 200, 0, "x", 1), (None, 210, 0, "x", 1)],
        [(1, 215, 0, "x", 1)],
        [(3, 500, 0, "x", 1)],
    ]
    rows = stream(spark, tmp_path / "in", batches).select("key", "at")
    got = X.finished(X.silences(rows, "key", "at", 1, "10 minutes"), "silences").collect()
    want = [(1, "silent", 30, 90), (1, "back", 30, 215), (1, "silent", 215, 275), (2, "silent", 40, 100), (2, "back", 40, 200), (2, "silent", 200, 260), (3, "silent", 45, 105)]
    assert sorted(map(tuple, got)) == sorted((k, kind, micros(a), micros(b)) for k, kind, a, b in want)


def test_days_go_when_their_time_has_run_out(spark, tmp_path):
    day = 24 * 60
    batches = [[(1, 5, 0, "x", 1), (1, 10, 0, "x", 1), (2, 20, 0, "x", 1)], [(1, day + 5, 0, "x", 1)], [(2, 3 * day + 30, 0, "x", 1)], [(2, 4 * day + 30, 0, "x", 1)]]
    rows = stream(spark, tmp_path / "in", batches).select("key", "at")
    got = X.finished(X.expired_days(rows, "key", "at", 2, "10 minutes"), "expired").collect()
    first = (START - datetime(1970, 1, 1)).days
    assert sorted(map(tuple, got)) == [(1, first, 2), (1, first + 1, 1), (2, first, 1)]


def test_payloads_are_new_again_after_their_time(spark, tmp_path):
    day = 24 * 60
    batches = [[(1, 0, 0, "a", 1), (1, 1, 0, "a", 1), (2, 0, 0, "a", 1)], [(1, day, 0, "a", 1), (1, day, 0, "b", 1), (None, day, 0, "a", 1)], [(1, 3 * day, 0, "a", 1), (1, 3 * day, 0, None, 1)]]
    rows = stream(spark, tmp_path / "in", batches)
    got = X.finished(X.first_payloads(rows, "key", "at", "value", 2, "10 minutes"), "payloads").collect()
    assert sorted(map(tuple, got)) == [(1, "a", micros(0)), (1, "a", micros(3 * day)), (1, "b", micros(day)), (2, "a", micros(0))]


class Held:
    """A state store of one key that counts its calls."""

    def __init__(self):
        self.value, self.calls, self.timers = None, 0, []

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return 0

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.update(None)


@pytest.mark.parametrize("processor", [X._Silence(3_600_000_000), X._Retention(7), X._Fresh(3_600_000_000)])
def test_many_rows_of_a_key_are_few_calls_to_the_store(processor):
    held = Held()
    processor.init(held)
    rows = [pd.DataFrame({"at_us": [micros(m) for m in range(n, 9000, 3)], "day": [m // 1440 for m in range(n, 9000, 3)]}) for n in range(3)]
    list(processor.handleInputRows((1, "a"), iter(rows), held))
    assert held.value is not None and held.calls <= 4 and len(held.timers) == 1


def test_a_span_that_the_watermark_is_inside_of_is_no_silence(spark, tmp_path):
    batches = [[(1, 0, 0, "x", 1), (1, 50, 0, "x", 1), (1, 100, 0, "x", 1)], [(2, 85, 0, "x", 1)], [(1, 80, 0, "x", 1), (2, 125, 0, "x", 1)], [(1, 170, 0, "x", 1)], [(2, 400, 0, "x", 1)]]
    rows = stream(spark, tmp_path / "in", batches).select("key", "at")
    got = X.finished(X.silences(rows, "key", "at", 1, "30 minutes"), "silences").collect()
    want = [(1, "silent", 100, 160), (1, "back", 100, 170), (1, "silent", 170, 230), (2, "silent", 125, 185)]
    assert sorted(map(tuple, got)) == sorted((k, kind, micros(a), micros(b)) for k, kind, a, b in want)
