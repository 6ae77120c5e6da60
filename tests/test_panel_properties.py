"""Panels of random events with one hot area against a plain Python roll-up."""

import datetime as dt
import random
from collections import Counter

import pytest

from riskpanel.functions.dates import next_period_end
from riskpanel.operators.panel import EventSource, build_panel, period_values

AREAS = list(range(6))


def month_end(day):
    return next_period_end(dt.date(day.year, day.month, 1) - dt.timedelta(days=1), "month")


def make(seed):
    rng = random.Random(seed)

    def event():
        area = 0 if rng.random() < 0.4 else rng.choice(AREAS + [99, None])
        day = None if rng.random() < 0.02 else dt.date(2010, 1, 1) + dt.timedelta(days=rng.randrange(200))
        return day, area

    calls = [(*event(), rng.choice(["1a", "2b", "3c", "3c", "4d", None])) for _ in range(800)]
    visits = [
        (*event(), rng.choice(["x", "y", None]), rng.choice(["A :: B", "B", " :: A", None]), rng.randrange(1000) / 100)
        for _ in range(900)
    ]
    return calls, visits


def expected_panel(calls, visits):
    calls = [c for c in calls if c[0] and c[1] is not None]
    visits = [v for v in visits if v[0] and v[1] is not None]
    first = {}
    for day, area, code in calls:
        if code and code.startswith("1"):
            key = (month_end(day), area)
            first[key] = min(day, first.get(key, day))
    counts = Counter()
    for day, area, code in calls:
        key = (month_end(day), area)
        if code and not code.startswith("1") and day <= first.get(key, key[0]):
            counts[(*key, f"call__{code}")] += 1
    for day, area, what, labels, amount in visits:
        key = (month_end(day), area)
        if day <= first.get(key, key[0]):
            if what:
                counts[(*key, f"visit__{what}")] += 1
            for label in {x for x in (labels or "").split(" :: ") if x}:
                counts[(*key, f"visit__{label}")] += 1
            counts[(*key, "visit__amount")] += round(amount * 100)
    days = [month_end(c[0]) for c in calls]
    periods = period_values([(min(days), max(days))], "month")
    return {
        (p, a): (int((p, a) in first), {c: counts[p, a, c] for c in NAMES}) for p in periods for a in AREAS
    }


NAMES = ["call__2b", "call__3c", "call__4d", "visit__x", "visit__y", "visit__A", "visit__B", "visit__amount"]


@pytest.mark.parametrize("seed,ratio", [(1, None), (2, 0.0)])
def test_panel_equals_plain_python(spark, seed, ratio):
    calls, visits = make(seed)
    areas = spark.createDataFrame([(a,) for a in AREAS], "area int")
    call_df = spark.createDataFrame(calls, "day date, area int, code string").repartition(5)
    visit_df = spark.createDataFrame(visits, "day date, area int, what string, labels string, amount double")
    sources = [
        EventSource("call", call_df, "day", one_hot=["code"], target=call_df["code"].startswith("1")),
        EventSource("visit", visit_df.repartition(3), "day", one_hot=["what"], labels=["labels"], sums=["amount"]),
    ]
    result = build_panel(areas, sources, ["area"], "month", min_ratio=ratio)
    got = {}
    for r in result.panel.collect():
        values = {c: round(r[c] * 100) if c == "visit__amount" else r[c] for c in NAMES}
        assert (r["period"], r["area"]) not in got
        got[r["period"], r["area"]] = (r["target"], values)
    assert got == expected_panel(calls, visits)
    assert sorted(result.features) == sorted(NAMES)


def test_no_target_source_is_an_error(spark):
    df = spark.createDataFrame([(dt.date(2010, 1, 1), 1)], "day date, area int")
    with pytest.raises(ValueError):
        build_panel(df.select("area"), [EventSource("e", df, "day")], ["area"])


def test_source_without_values_is_counted(spark):
    df = spark.createDataFrame([(dt.date(2010, 1, 1), 1, 0), (dt.date(2010, 1, 2), 1, 0)], "day date, area int, t int")
    source = EventSource("e", df, "day", target=df["t"] == 1)
    assert build_panel(df.select("area"), [source], ["area"]).panel.first()["e__all"] == 2
