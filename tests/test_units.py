import math
import random

import numpy as np
import pytest

from lodestone.operators.units import changepoints, judged_units, number, scales_of, stated, times_100, to_common_units


@pytest.mark.parametrize(
    "common, value, unit, raw, expected",
    [
        ("%", 642.7, "‰", None, 6427), ("%", None, None, "44,80%", 4480), ("%", None, None, "0.551ratio (0-1)", 5510), ("%", 0.7, "n/a", "about 0.7 fraction (mean of three)", 7000), ("%", 81.3, None, "81.3", None), ("%", 5.0, "% ", None, 500),
        ("min", None, None, "4.788 × 10^4 sec", 79800), ("min", 402.0, "min", "about 4.02e2 min", 40200), ("min", 0.5, "d", None, 72000), ("degC", 341.64, "K", None, 6849), ("degC", 72.5, "degF", None, 2250), ("degC", None, None, "≈50,5 degC", 5050),
        ("nm", 4.66, "μm", None, 466000), ("nm", 1715.0, "Å", None, 17150), ("mM", None, None, "≈293.2 mol m-3", 29320), ("mM", 0.412, "mol/L", None, 41200), ("U/mg", 111.0, "nkat/mg", None, 666), ("U/mg", 0.2054, "U/µg", None, 20540), ("mg/g", 4.39, "wt%", None, 4390),
        ("mg", None, None, "about 2290.9 mg. (mean of three)", 229090), ("mg", 0.001029, "kg", None, 102900), ("cycle", None, None, "≈10 cycles", 1000), ("mg", None, None, "n.d.", None), ("mg", 5.0, "a.u.", None, None), ("mg", None, "mg", None, None), ("mg", float("nan"), "mg", "7 mg", 700),
    ],
)
def test_stated(common, value, unit, raw, expected):
    found = stated(common, value, unit, raw)
    assert (times_100(*found) if found else None) == expected


def test_numbers():
    assert float(number("ca. 1,234.5 mg")[0]) == 1234.5 and float(number("5.7 × 10² nm")[0]) == 570 and number("see text") is None and number(None) is None


def brute(values, penalty):
    n = len(values)
    best, last = [-penalty] + [math.inf] * n, [0] * (n + 1)
    for t in range(1, n + 1):
        for s in range(t):
            part = values[s:t]
            cost = best[s] + ((part - part.mean()) ** 2).sum() + penalty
            if cost < best[t] - 1e-12:
                best[t], last[t] = cost, s
    ends, t = [], n
    while t:
        ends.append(t)
        t = last[t]
    return ends[::-1]


def test_changepoints_are_exact():
    draw = np.random.default_rng(3)
    for _ in range(20):
        values = np.concatenate([draw.normal(m, 1, draw.integers(1, 15)) for m in draw.choice([0, 4, 9], 4)])
        assert changepoints(values, 6.0) == brute(values, 6.0)


def totals(values, stated_as):
    logs = np.log(values[stated_as >= 0])
    return len(logs), float(logs.sum()), float((logs**2).sum())


def test_history_tells_the_unit():
    draw = random.Random(1)
    values = np.array([draw.uniform(400, 600) for _ in range(20)] + [draw.uniform(0.4, 0.6) for _ in range(10)])
    mg = scales_of("mg").index((1, 0))
    as_stated = np.array([mg] * 20 + [-1] * 10)
    found = judged_units("mg", values, as_stated, totals(values, as_stated), (math.nan, 1.0))
    assert set(found) == set(range(20, 30)) and all(float(s[0]) == 1000 for s in found.values())
    assert judged_units("mg", values, np.full(30, -1), (0, 0.0, 0.0), (math.nan, 1.0)) == {}


@pytest.mark.parametrize("wrong, reversed_", [(10, True), (4, False), (25, False)])
def test_a_level_shift_contradicts_the_unit_stated(wrong, reversed_):
    """Grams written down as milligrams: found in a long enough run that is the minority of its source."""
    draw = random.Random(2)
    values = np.array([draw.uniform(400, 600) for _ in range(20)] + [draw.uniform(0.4, 0.6) for _ in range(wrong)])
    as_stated = np.full(len(values), scales_of("mg").index((1, 0)))
    found = judged_units("mg", values, as_stated, totals(values, as_stated), (math.nan, 1.0))
    assert {i: float(s[0]) for i, s in found.items() if i >= 20} == ({i: 1000.0 for i in range(20, 20 + wrong)} if reversed_ else {})
    drifting = np.array([draw.uniform(400, 600) for _ in range(20)] + [draw.uniform(40, 60) for _ in range(10)])  # no unit is ten times another
    stated_mg = np.full(30, scales_of("mg").index((1, 0)))
    assert judged_units("mg", drifting, stated_mg, totals(drifting, stated_mg), (math.nan, 1.0)) == {}


def test_rows(spark):
    rows = [("f", f"k{i}", 0, "mass", "lab", i * 10**9, 500.0 + i % 7, "mg", None) for i in range(30)] + [("f", f"u{i}", 0, "mass", "lab", (100 + i) * 10**9, 0.5, None, "0.5") for i in range(6)]
    rows += [("f", "k0", 0, "mass", "lab", 10**15, 500.0, "mg", None), ("f", "n", 0, "mass", None, None, None, None, None), ("f", "x", 0, "other", "lab", 0, 1.0, "mg", None), ("f", "g", 1, "mass", None, 5, 2.0, "gram", None)]
    kind = "field_name string, item_key string, pos int, quantity string, source string, seq bigint, value double, unit string, raw string"
    common = spark.createDataFrame([("f", "mass", "mg")], "field_name string, quantity string, common_unit string")
    df = spark.createDataFrame(rows, kind).selectExpr("*", "'clash' AS common_unit", "1 AS win", "2 AS level")
    got = {r.item_key: r for r in to_common_units(df, common).collect()}
    assert len(got) == 38 and "x" not in got
    assert got["k0"].exact and got["k0"].how == "stated" and got["g"].value_x100 == 200000 and not got["g"].exact
    assert got["u3"].how == "history" and got["u3"].value_x100 == 50000
    assert got["n"].how == "unresolved" and got["n"].value_x100 is None
    assert to_common_units(df.limit(0), common).count() == 0
    cut = {r.item_key: r for r in to_common_units(df, common, span=9).collect()}
    assert cut == got


def test_wrong_units_are_reversed(spark):
    rows = [("f", f"k{i}", 0, "mass", None, i, 500.0 + i % 7, "mg", None) for i in range(30)] + [("f", f"w{i}", 0, "mass", None, 100 + i, 0.5, "mg", "0.5 mg") for i in range(8)]
    common = spark.createDataFrame([("f", "mass", "mg")], "field_name string, quantity string, common_unit string")
    df = spark.createDataFrame(rows, "field_name string, item_key string, pos int, quantity string, source string, seq bigint, value double, unit string, raw string")
    got = {r.item_key: (r.how, r.value_x100) for r in to_common_units(df, common).collect()}
    assert {got[f"w{i}"] for i in range(8)} == {("reversed", 50000)} and got["k0"] == ("stated", 50000) and len(got) == 38


def test_long_history_without_change():
    draw = np.random.default_rng(5)
    values = np.concatenate([draw.normal(0, 1, 12_000), draw.normal(5, 1, 8_000)])
    assert changepoints(values, 2 * math.log(len(values) + 1)) == [12_000, 20_000]
    assert changepoints(np.zeros(0), 1.0) == [] and changepoints(np.full(5, 2.0), 1.0) == [5]


@pytest.mark.parametrize("apart", [1, 86_400])
def test_a_source_keeps_its_level_over_months_and_many_readings(spark, apart):
    """Units stated in the first months, or the first 4,096 readings, tell those that are dropped later."""
    stated_first = 4096 if apart == 1 else 60
    rows = [("f", f"o{i}", 0, "mass", f"lab{i % 40}", i * 10**9, 500.0 + i % 7, "mg", None) for i in range(9000)]
    rows += [("f", f"l{i}", 0, "mass", "low", i * apart * 10**6, 0.5 + i % 5 / 100, "mg", None) for i in range(stated_first)]
    rows += [("f", f"u{i}", 0, "mass", "low", (stated_first + 60 * (apart > 1) + i) * apart * 10**6, 0.52, None, None) for i in range(10)]
    df = spark.createDataFrame(rows, "field_name string, item_key string, pos int, quantity string, source string, seq bigint, value double, unit string, raw string")
    common = spark.createDataFrame([("f", "mass", "mg")], "field_name string, quantity string, common_unit string")
    got = {r.item_key: (r.how, r.value_x100) for r in to_common_units(df, common).collect()}
    assert len(got) == len(rows) and {got[f"u{i}"] for i in range(10)} == {("history", 52)}
