"""Several regressors, rolling origins and activations against refitting and look-ups in numpy."""

import math

import numpy as np
import pytest

from shelfscope.plans import backtest as BT
from shelfscope.plans import forecast as FC
from shelfscope.plans import regression as REG

X = ("tpr", "display", "trend")


def series(seed, n=60, dupe=False, flat=False, skip=()):
    r = np.random.default_rng(seed)
    rows = []
    for t in range(n):
        if t in skip:
            continue
        tpr, display = float(r.integers(0, 2)), float(r.uniform())
        if dupe:
            display = 2 * tpr
        if flat:
            display = 0.5
        y = 100 + 10 * (t % 12) + 30 * tpr + 15 * display + 0.7 * t + r.normal(0, 3)
        rows.append((24000 + t, t % 12 + 1, float(y), tpr, display, float(t)))
    return rows


CASES = {"plain": series(1), "dupe": series(2, dupe=True), "flat": series(3, flat=True), "gaps": series(4, skip=(3, 17, 30)),
         "short": series(5, n=14), "one": series(6, n=1)}
SCHEMA = "series string, period_no int, season int, y double, tpr double, display double, trend double"


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame([(s, *r) for s, rows in CASES.items() for r in rows], SCHEMA).cache()


def least_squares(rows, columns):
    """Dense dummies and the columns; those that add no rank are left out, in order."""
    seasons = sorted({r[1] for r in rows})
    design = [[float(r[1] == s) for s in seasons] for r in rows]
    a, used = np.array(design), []
    for c in columns:
        more = np.column_stack([a, [r[c] for r in rows]])
        if np.linalg.matrix_rank(more, 1e-7) > np.linalg.matrix_rank(a, 1e-7):
            a, used = more, [*used, c]
    y = np.array([r[2] for r in rows])
    coef = np.linalg.lstsq(a, y, rcond=None)[0]
    resid = y - a @ coef
    dof = len(y) - a.shape[1]
    se = None
    if dof > 0:
        s2 = resid @ resid / dof
        se = np.sqrt(s2 * np.diag(np.linalg.inv(a.T @ a)))[len(seasons):]
    return dict(zip(used, coef[len(seasons):])), se, math.sqrt(resid @ resid / dof) if dof > 0 else None, resid, dict(zip(seasons, coef))


def test_fit_equals_least_squares_with_dummies(points):
    got = {r["series"]: r for r in REG.fit(points, X).collect()}
    assert set(got) == set(CASES)
    for name, rows in CASES.items():
        coef, se, resid_se, resid, _ = least_squares(rows, (3, 4, 5))
        r = got[name]
        assert r["n"] == len(rows) and r["used"] == len(coef)
        for c, x in zip((3, 4, 5), X):
            assert r[f"coef_{x}"] == pytest.approx(coef.get(c, 0.0), abs=1e-6)
            if se is not None and c in coef:
                assert r[f"se_{x}"] == pytest.approx(se[list(coef).index(c)], rel=1e-6)
            else:
                assert r[f"se_{x}"] is None
        if resid_se is None:
            assert r["resid_se"] is None
        else:
            assert r["resid_se"] == pytest.approx(resid_se, rel=1e-6)
        y = np.array([x[2] for x in rows])
        if len(rows) > 1:
            assert r["r2"] == pytest.approx(1 - resid @ resid / ((y - y.mean()) @ (y - y.mean())), abs=1e-9)
    assert (got["dupe"]["used"], got["flat"]["used"], got["one"]["used"]) == (2, 2, 0)


def test_one_regressor_is_the_plain_model(points):
    p = points.withColumnRenamed("tpr", "promo")
    one = {r["series"]: r for r in REG.fit(p, ("promo",)).collect()}
    for r in FC.ols_fit(p.withColumn("year", p.period_no / 12)).collect():
        assert one[r["series"]]["coef_promo"] == pytest.approx(r["promo_slope"], abs=1e-7)


def test_organic_forecast_sets_promotions_to_zero_and_goes_on_with_the_trend(points):
    got = {(r["series"], r["step"]): r for r in REG.organic_forecast(points, ("tpr", "display")).collect()}
    assert len(got) == len(CASES) * 13
    for name in ("plain", "gaps"):
        coef, _, resid_se, _, level = least_squares(CASES[name], (3, 4, 5))
        last = max(r[0] for r in CASES[name])
        for step in range(1, 14):
            no = last + step
            want = level[no % 12 + 1] + coef[5] * (no - 24000)
            r = got[name, step]
            assert r["forecast_median"] == pytest.approx(want, abs=1e-5)
            assert r["forecast_high"] - r["forecast_median"] == pytest.approx(REG.Z90 * resid_se, rel=1e-6)
    assert got["one", 1]["forecast_median"] is None and got["one", 12]["forecast_median"] is not None


def test_flags_and_points(spark):
    codes = spark.createDataFrame([("a", "TPR"), ("a", "DSP"), ("b", "DSP"), ("c", "OTHER")], "global_code string, promo_code string")
    flags = REG.promo_flags(codes, {"tpr": "TPR", "display": "DSP"})
    assert sorted(map(tuple, flags.collect())) == [("a", 1.0, 1.0), ("b", 0.0, 1.0), ("c", 0.0, 0.0)]
    lines = spark.createDataFrame([("s", "2000-01-03", 2.0, 1.0), ("s", "2000-01-09", 3.0, None), ("s", "2000-03-01", 1.0, 0.0)],
                                  "k string, d string, q double, f double").selectExpr("k", "cast(d as date) d", "q", "f")
    got = REG.regressor_points(lines, "k", "d", "q", ("f",)).orderBy("period_no").collect()
    assert [(r["season"], r["y"], r["f"], r["trend"]) for r in got] == [(1, 5.0, 0.5, 0.0), (3, 1.0, 0.0, 2.0)]


@pytest.mark.parametrize("horizon", [1, 12])
def test_backtest_equals_refitting(points, horizon):
    p = points.withColumnRenamed("tpr", "promo")
    got = {(r["series"], r["origin"], r["period_no"]): r["y_hat"] for r in BT.predictions(p, horizon).collect()}
    want = {}
    for name, rows in CASES.items():
        for o in rows:
            known = [r for r in rows if r[0] <= o[0]]
            seasons = {r[1] for r in known}
            if len(known) < 24 or len(known) - len(seasons) <= 1:
                continue
            coef, _, _, _, level = least_squares(known, (3,))
            for r in rows:
                if 0 < r[0] - o[0] <= horizon and r[1] in seasons:
                    want[name, o[0], r[0]] = level[r[1]] + coef.get(3, 0.0) * r[3]
    assert set(got) == set(want) and len(got) > 100 // (13 - horizon)
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_backtest_measures(points):
    p = points.withColumnRenamed("tpr", "promo")
    rows = BT.predictions(p).where("series = 'gaps'").collect()
    got = {r["origin"]: r for r in BT.backtest(p).where("series = 'gaps'").collect()}
    for origin in {r["origin"] for r in rows}:
        mine = [(r["y"], r["y_hat"]) for r in rows if r["origin"] == origin]
        r = got[f"{origin // 12:04d}-{origin % 12 + 1:02d}"]
        y, f = map(np.array, zip(*mine))
        assert r["targets"] == len(mine)
        assert r["mape_pct"] == pytest.approx(100 * np.mean(np.abs(y - f) / y))
        if len(mine) > 1:
            assert r["r2"] == pytest.approx(1 - ((y - f) ** 2).sum() / ((y - y.mean()) ** 2).sum(), abs=1e-6)
        else:
            assert r["r2"] is None
    with pytest.raises(ValueError):
        BT.predictions(p, 13)


def test_activations(spark):
    y = [("a", 0, 10.0, 0.0), ("a", 1, 30.0, 1.0), ("a", 2, 40.0, 1.0), ("a", 4, 20.0, 0.0), ("a", 5, 25.0, 1.0),
         ("b", 0, 9.0, 1.0), ("b", 3, 6.0, 0.0), ("c", 0, 1.0, 1.0), ("d", 0, 0.0, 0.0), ("d", 1, 5.0, 1.0), ("e", 1, 5.0, 0.0)]
    p = spark.createDataFrame(y, "series string, period_no int, y double, promo double")
    got = {(r["series"], r["period"]): (r["baseline"], r["gap_before"], r["gap_after"], r["lift_pct"]) for r in BT.activations(p).collect()}
    assert got == {("a", "0000-02"): (12.5, 1, 3, pytest.approx(140.0)), ("a", "0000-03"): (15.0, 2, 2, pytest.approx(166.66666667)),
                   ("a", "0000-06"): (20.0, 1, None, 25.0), ("b", "0000-01"): (6.0, None, 3, 50.0),
                   ("c", "0000-01"): (None, None, None, None), ("d", "0000-02"): (0.0, 1, None, None)}
    lift = {r["series"]: (r["activations"], r["mean_lift_pct"], r["pooled_lift_pct"]) for r in BT.activation_lift(p).collect()}
    assert lift["a"] == (3, pytest.approx((140 + 500 / 3 + 25) / 3), pytest.approx(100 * (95 / 47.5 - 1)))
    assert lift["c"] == (1, None, None) and "e" not in lift


def test_t_quantiles_are_the_tabled_ones(spark):
    from shelfscope.functions.quantiles import t_column
    # fixed values: two-sided 90 % and 95 % quantiles of Student's t
    tabled = {0.9: {1: 6.313751515, 2: 2.919985580, 5: 2.015048373, 10: 1.812461123, 30: 1.697260887, 120: 1.657650899},
              0.95: {1: 12.706204736, 4: 2.776445105, 20: 2.085963447, 60: 2.000297822}}
    rows = spark.createDataFrame([(v,) for v in (0, 1, 2, 4, 5, 10, 20, 30, 60, 120, 200, 201, 100_000)], "v int")
    for c, want in tabled.items():
        got = {r["v"]: r["t"] for r in rows.select("v", t_column(rows.v, c).alias("t")).collect()}
        assert got[0] is None
        assert all(got[v] == pytest.approx(t, abs=1e-8) for v, t in want.items())
        assert 0 < got[200] - got[201] < 1e-4 and got[100_000] == pytest.approx({0.9: 1.6448536, 0.95: 1.9599640}[c], abs=3e-5)


def test_small_sample_bands_are_prediction_intervals(points):
    from shelfscope.functions.quantiles import t_quantile
    got = {(r["series"], r["step"]): r for r in REG.organic_forecast(points, ("tpr", "display"), confidence=0.9).collect()}
    for name in ("plain", "gaps", "dupe"):
        rows = CASES[name]
        used = (3, 5) if name == "dupe" else (3, 4, 5)
        seasons = sorted({r[1] for r in rows})
        a = np.array([[*(float(r[1] == s) for s in seasons), *(r[c] for c in used)] for r in rows])
        _, _, se, _, _ = least_squares(rows, used)
        inverse = np.linalg.inv(a.T @ a)
        last = max(r[0] for r in rows)
        for step in (1, 7, 13):
            no = last + step
            x = np.array([*(float(no % 12 + 1 == s) for s in seasons), *(0.0 if c < 5 else no - 24000 for c in used)])
            r = got[name, step]
            want = t_quantile(0.95, len(rows) - a.shape[1]) * se * math.sqrt(1 + x @ inverse @ x)
            assert r["forecast_high"] - r["forecast_median"] == pytest.approx(want, rel=1e-6)
    assert got["one", 12]["forecast_median"] is not None and got["one", 12]["forecast_high"] is None
