"""The trailing-window rule against brute force."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from caudal.operators.rolling import busy_instants, counts_per_instant

START = dt.datetime(2024, 1, 1, 22, 0)


def busy(spark, events, *, more_than=3, within_seconds=3600):
    df = spark.createDataFrame(events, "k string, at timestamp_ntz")
    found = busy_instants(
        counts_per_instant(df, "k", "at"), "k", "at",
        more_than=more_than, within_seconds=within_seconds,
    )
    rows = [(r.k, r["at"]) for r in found.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def brute(events, *, more_than=3, within_seconds=3600):
    span = dt.timedelta(seconds=within_seconds)
    return {
        (k, at) for k, at in events
        if sum(1 for k2, at2 in events if k2 == k and at - span < at2 <= at) > more_than
    }


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def test_exactly_one_hour_drops_the_first(spark):
    assert busy(spark, [("a", at(s)) for s in (0, 1200, 2400, 3600)]) == set()


def test_just_inside_one_hour(spark):
    events = [("a", at(s)) for s in (0, 1200, 2400, 3599)]
    assert busy(spark, events) == {("a", at(3599))}


def test_equal_timestamps_count_together(spark):
    events = [("a", at(0)), ("a", at(10)), ("a", at(20)), ("a", at(20))]
    assert busy(spark, events) == {("a", at(20))}
    assert busy(spark, [("a", at(5))] * 4) == {("a", at(5))}


def test_window_over_midnight(spark):
    events = [("a", at(7200 + s)) for s in (-1500, -1000, -500, 100)]
    assert busy(spark, events) == {("a", at(7300))}


@pytest.mark.parametrize("more_than,within", [(3, 3600), (1, 60), (5, 3 * 86400), (0, 10), (40, 7200), (90, 86400)])
def test_random_events(spark, more_than, within):
    rng = random.Random(more_than * 1000 + within)
    events = [
        (rng.choice("aab"), at(rng.randrange(0, max(within, 3600) * 4))) for _ in range(300)
    ]
    events += rng.choices(events, k=60)
    limits = {"more_than": more_than, "within_seconds": within}
    assert busy(spark, events, **limits) == brute(events, **limits)


def test_the_plan_does_not_grow_with_the_limit(spark):
    events = spark.createDataFrame([("a", at(0))], "k string, at timestamp_ntz")
    counted = counts_per_instant(events, "k", "at")
    plans = [
        busy_instants(counted, "k", "at", more_than=limit, within_seconds=3600)
        ._jdf.queryExecution().optimizedPlan().toString()
        for limit in (3, 1000)
    ]
    assert len(plans[0].splitlines()) == len(plans[1].splitlines())
    assert abs(len(plans[0]) - len(plans[1])) < 50


def test_a_thousand_in_a_window(spark):
    events = [("a", at(s)) for s in range(0, 3600, 3)]
    assert busy(spark, events, more_than=1000) == brute(events, more_than=1000)
    assert len(brute(events, more_than=1000)) == 200
