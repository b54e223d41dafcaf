import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from isocline.config import config
from isocline.functions import climate as C
from isocline.operators import evidence as E
from isocline.operators import metric as M
from isocline.operators import models as D
from isocline.operators import ranges as R
from isocline.operators import spatial as S
from isocline.operators import timeseries as T
from isocline.operators.graph import patches
from isocline.operators.occurrence import certain, valid_coordinates, wild
from isocline.operators.ordering import ranked, running_totals, weighted_quantiles


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_coordinate_rules(spark):
    rows = [(10.5, 20.25, True), (None, 1.5, False), (91.0, 1.5, False), (0.0, 0.00001, False), (5.5, 5.5, False), (10.0, 20.0, False), (10.0, 20.5, True), (5.5, 181.0, False)]
    df = spark.createDataFrame(rows, "lat double, lon double, want boolean")
    assert [r.got == r.want for r in df.withColumn("got", valid_coordinates(F.col("lat"), F.col("lon"))).collect()] == [True] * 8
    df = spark.createDataFrame([(50.0, "NATIVE", True, True), (20000.0, "Introduced (x)", False, False), (None, None, True, True), (1.0, "managed", True, False)], "u double, e string, a boolean, b boolean")
    assert all(r.x == r.a and r.y == r.b for r in df.select("a", "b", certain(F.col("u")).alias("x"), wild(F.col("e")).alias("y")).collect())


def test_self_match_is_at_distance_zero(spark):
    rng = np.random.default_rng(0)
    pool = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(300)], "near long, vec array<double>")
    out = M.nearest_rows(pool.withColumnRenamed("near", "target").where("target < 40"), pool, exclude_same=False).collect()
    assert len(out) == 40 and all(r.target == r.near and r.distance == 0 for r in out)


def test_nearest_and_spaced_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 7)
    monkeypatch.setattr(M, "SLICE", 50)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 4))
    m = rng.normal(size=(4, 4))
    pool = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "near long, vec array<double>")
    targets = spark.createDataFrame([(i, x[i].tolist(), m.ravel().tolist()) for i in range(20)], "target long, vec array<double>, m array<double>")
    got = {}
    for r in M.nearest_rows(targets, pool, k=30).collect():
        got.setdefault(r.target, {})[r.place] = r.near
    for i in range(20):
        d = np.linalg.norm((x - x[i]) @ m, axis=1)
        d[i] = np.inf
        assert [got[i][k] for k in range(1, 31)] == np.argsort(d, kind="stable")[:30].tolist()
    near = spark.createDataFrame([(1, k, float(k), k * 1.0, 0.0) for k in range(12)], "target long, near long, distance double, lat double, lon double")
    assert [r.near for r in M.spaced_sites(near, "target", 3, 300.0).orderBy("pick").collect()] == [0, 3, 6]


def test_within_radius_over_date_line_and_poles(spark):
    rng = np.random.default_rng(5)
    pts = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(np.r_[rng.uniform(-90, 90, 150), [89.9, -89.95, 90.0, 0.1, 0.2]], np.r_[rng.uniform(-180, 180, 150), [10.0, 170.0, -100.0, 179.95, -179.95]], strict=True))]
    df = spark.createDataFrame(pts, "id long, lat double, lon double")
    got = {(r.id, r.r_id) for r in S.within_radius(df, df, 700.0).collect()}
    want = set()
    for i, a, b in pts:
        for j, c, d in pts:
            h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
            if 2 * 6371.0088 * math.asin(math.sqrt(min(1, h))) <= 700:
                want.add((i, j))
    assert got == want


def test_running_mean_crossing_and_reference_invariance(spark):
    rows = [("up", y, 14 + max(0, y - 1900) * 0.03) for y in range(1850, 2101)] + [("flat", y, 14 + max(0, y - 1900) * 0.002) for y in range(1850, 2101)] + [("spike", y, 14.0 + (6.0 if y in (1950, 1951) else 0.0)) for y in range(1850, 2101)]
    df = spark.createDataFrame(rows, "k string, y int, v double")
    cross = lambda d: {(r.k, r.level): r.crossed for r in T.first_crossings(d, ["k"], "y", "v", F.col("y").between(1850, 1900), [1.5, 2.0]).collect()}
    got = cross(df)
    assert 1945 <= got[("up", 1.5)] <= 1956 and got[("flat", 1.5)] == 0 and got[("spike", 1.5)] == 0
    assert got == cross(df.withColumn("v", F.col("v") + 100))


def test_longest_run_and_december(spark):
    df = spark.createDataFrame([(1, d, d in (2, 3, 4, 8, 9)) for d in range(12)] + [(2, 1, None)], "k int, d int, t boolean")
    assert {r.k: r.longest for r in T.longest_run(df, ["k"], "d", F.col("t")).collect()} == {1: 3, 2: 0}
    rows = [(1, y, m, float(y * 100 + m)) for y in (2000, 2001) for m in range(1, 13)]
    out = {(r.season_year, r.season): r.value for r in T.december_shift(spark.createDataFrame(rows, "k int, y int, m int, v double"), ["k"], "y", "m", "v").collect()}
    assert out == {(2001, 0): 200012.0 + 200101 + 200102, (2001, 1): 3 * 200104.0, (2001, 2): 3 * 200107.0, (2001, 3): 3 * 200110.0}


def test_totals_ranks_and_quantiles(spark):
    rng = np.random.default_rng(2)
    v = rng.integers(0, 300, 3000) / 7
    df = spark.createDataFrame(pd.DataFrame({"id": range(3000), "v": v, "w": rng.random(3000)}))
    t = {r.v: (r.n_before, r.n_upto) for r in running_totals(df, "v", {"n": F.count("*")}).collect()}
    assert all(t[x] == ((v < x).sum(), (v <= x).sum()) for x in t)
    got = {r.id: r["rank"] for r in ranked(df, "v").collect()}
    want = pd.Series(v).rank()
    assert all(got[i] == want[i] for i in range(3000))
    q = weighted_quantiles(df, "v", "w", (0.05, 0.5)).first()
    order = np.argsort(v, kind="stable")
    w = df.toPandas().w.to_numpy()
    share = np.cumsum(w[order]) / w.sum()
    assert q.q1 == v[order][np.searchsorted(share, 0.5)]


def test_skill_measures(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.3, 0), (0.1, 0)], "s double, y int")
    assert D.auc(df, "s", F.col("y") == 1).first().auc == 1.0
    assert D.auc(df.withColumn("s", -F.col("s")), "s", F.col("y") == 1).first().auc == 0.0
    assert D.auc(df.withColumn("s", F.lit(1.0)), "s", F.col("y") == 1).first().auc == 0.5
    assert D.auc(df.where("y = 1"), "s", F.col("y") == 1).first().auc is None
    best = D.best_threshold(df, "s", F.col("y") == 1).first()
    assert (best.threshold, best.tss) == (0.8, 1.0)
    assert D.boyce(df, "s", F.col("y") == 1).first().boyce is None
    rng = np.random.default_rng(0)
    s = rng.random(3000)
    up = spark.createDataFrame(pd.DataFrame({"s": s, "y": (rng.random(3000) < s).astype(int)}))
    assert D.boyce(up, "s", F.col("y") == 1).first().boyce > 0.9


def test_ranges_recover_a_known_shift(spark):
    rows = [(1, int(lat), lat + 0.5, lon + 0.5, math.cos(math.radians(lat + 0.5)), 35 <= lat < 45, 37 <= lat < 47) for lat in range(25, 60) for lon in range(-100, -82)]
    df = spark.createDataFrame(rows, "g int, cluster int, lat double, lon double, km2 double, now boolean, later boolean")
    c = R.change_summary(df, ["g"]).first()
    assert 200 < c.shift_km < 240 and (c.bearing < 5 or c.bearing > 355) and c.gain > 0 and c.loss > 0
    b = R.resampled_shift(df, "g").first()
    assert b.km == pytest.approx(c.shift_km, rel=1e-6) and b.low < b.km < b.high
    e = R.latitude_edges(df, ["g"], "now").first()
    assert (e.edge_low, e.edge_high) == (35.5, 44.5)
    same = R.agreement(df, ["g"], "now", "now").first()
    assert (same.sens, same.spec, same.tss, same.sorensen, same.commission, same.omission) == (1, 1, 1, 1, 0, 0)


def test_quantised_threshold_and_classes(spark):
    got = [r[0] for r in spark.createDataFrame([(0.0,), (0.4999,), (0.5,), (1.0,), (None,)], "s double").select(C.quantised(F.col("s"), F.lit(0.5))).collect()]
    assert got == [0, 43, 44, 127, 0]
    assert one(spark, C.lite_class(F.lit(128 + 127))) == 131


def test_complete_koppen_is_null_for_missing_months(spark):
    a = F.array(*[F.lit(20.0)] * 11, F.lit(None).cast("double"))
    b = F.array(*[F.lit(20.0)] * 12)
    assert one(spark, C.koppen(a, b, b)) is None and one(spark, C.koppen(b, b, F.array(*[F.lit(100.0)] * 12))) == "Af"
    assert one(spark, C.koppen(F.array(*[F.lit(-5.0)] * 12), F.array(*[F.lit(-15.0)] * 12), b)) == "EF"


def test_flags_and_verdicts(spark):
    f = lambda *x: F.array(*[F.lit(v).cast("string") for v in x])
    assert one(spark, E.combined_flag(f("high", "ok", None), False)) == "high"
    assert one(spark, E.combined_flag(f("high", "ok", None), True)) == "ok"
    assert one(spark, E.combined_flag(f("moderate", None), True)) == "moderate"
    assert one(spark, E.combined_flag(f(None, None), False)) is None
    assert E.binomial_tail(8, 10) == pytest.approx(0.0546875)
    assert one(spark, E.place_key(F.lit(-0.00001), F.lit(12.34567))) == "0.0000,12.3457"


def test_binomial_tails_of_any_size():
    exact = lambda k, n: sum(math.comb(n, i) for i in range(k, n + 1)) / 2**n
    for k, n in ((0, 5), (3, 5), (6, 5), (480, 1000), (520, 1000), (810, 1667), (850, 1667)):
        assert E.binomial_tail(k, n) == pytest.approx(exact(k, n), abs=1e-12)
    assert E.binomial_tail(8, 10, 0.75) == pytest.approx(sum(math.comb(10, i) * 0.75**i * 0.25 ** (10 - i) for i in (8, 9, 10)))
    assert E.binomial_tail(50_200, 100_000) == pytest.approx(0.1035, abs=1e-4) and math.isnan(E.binomial_tail(0, 0))


def test_large_groups_have_verdicts(spark):
    from isocline.plans.wider import QUERIES

    assert {(r.survey, r.n) for r in QUERIES["group_verdicts"](spark, "/root/testdata/sf0.1").collect()} == {(k, 1667 if k < 8 else 1666) for k in range(12)}


@pytest.mark.parametrize("side", [2, 512])
def test_patches_wrap_no_corners(spark, monkeypatch, side):
    import isocline.operators.graph as module

    monkeypatch.setattr(module, "SIDE", side)
    snake = [(10, c) for c in range(30)] + [(11, 29), *((12, c) for c in range(30)), (13, 0), *((14, c) for c in range(30))]
    labels = {r.patch for r in patches(spark.createDataFrame(snake, "grid_row int, grid_col int")).collect()}
    assert labels == {10 << 20}
    cells = [(0, 0), (0, 1), (1, 1), (5, 5), (6, 6), (2, 1), (2, 2), (2, 3)]
    out = {(r.grid_row, r.grid_col): r.patch for r in patches(spark.createDataFrame(cells, "grid_row int, grid_col int")).collect()}
    assert len(set(out.values())) == 3 and out[(2, 3)] == out[(0, 0)] and out[(5, 5)] != out[(6, 6)]


def test_first_fit_and_config():
    assert D.first_fit([("a", 5), ("b", 6), ("c", 4), ("d", 5)], 10) == [("b", 1), ("a", 2), ("d", 2), ("c", 1)]
    assert config({"grid": {"min_lat": -50.0}})["grid"]["min_lat"] == -50.0 and config()["grid"]["min_lat"] == -60.0


def test_model_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.random((400, 2))
    df = spark.createDataFrame(pd.DataFrame({"cell": range(400), "a": x[:, 0], "b": x[:, 1], "present": (x[:, 0] > 0.5).astype(int)}))
    model = D.fit(df, "glm", ["a", "b"], "present")
    D.save(model, str(tmp_path / "m"))
    one_, two = (sorted((r.cell, round(r.raw, 9)) for r in D.score(m, df).collect()) for m in (model, D.load(str(tmp_path / "m"))))
    assert one_ == two


def test_species_of_large_groups_have_tiers(spark):
    from isocline.plans.wider import QUERIES

    got = QUERIES["species_verdicts"](spark, "/root/testdata/sf0.1").groupBy("tier").count().collect()
    assert sum(r["count"] for r in got) == 20_000 and {r.tier for r in got} <= {"Tier 1", "Tier 2", "Tier 3"}


def test_species_of_groups_without_known_directions_have_tiers(spark, sf):
    from isocline.plans.wider import species_results

    lost = species_results(spark, sf).withColumn("direction_agree", F.when(F.col("survey") != 3, F.col("direction_agree")))
    groups = E.group_verdict(lost, ["survey"], 10)
    assert {r.survey: r.direction for r in groups.collect()}[3] is False
    tiers = E.species_verdict(lost.join(groups.select("survey", "status"), "survey"))
    assert tiers.count() == lost.count() and tiers.where("survey = 3 and tier = 'Tier 1'").isEmpty()


def _scattered(spark, n, seed, places):
    """Points of which many share a position, some near a pole or the date line, some without a position."""
    rng = np.random.default_rng(seed)
    at = [(float(a), float(b)) for a, b in zip(np.degrees(np.arcsin(rng.uniform(-1, 1, places))).round(1), rng.uniform(-180, 180, places).round(1), strict=True)]
    at += [(89.9, 10.0), (-90.0, 0.0), (10.0, 180.0), (10.2, -179.9), (10.1, 179.9), (90.0, 77.0)]
    rows = [(int(k), *at[rng.integers(len(at))], float(rng.integers(1, 9)), float(rng.random())) for k in rng.permutation(n)]
    return [*rows, (n, None, 1.0, 1.0, 1.0)], "key long, lat double, lon double, v double, land double"


@pytest.mark.parametrize("km,k,few", [(60.0, 1, 10**7), (70.0, 2, 10**7), (3000.0, 5, 10), (3000.0, 5, 10**7), (25_000.0, 3, 10), (2000.0, 1, 10**7), (2000.0, 1, 10)])
def test_nearest_rows_equal_all_pairs(spark, monkeypatch, km, k, few):
    from isocline.functions.geo import EARTH_KM

    monkeypatch.setattr(S, "FEW_PAIRS", few)
    (a, schema), (b, _) = _scattered(spark, 400, 1, 60), _scattered(spark, 300, 2, 50)
    met = []
    within = S.within_radius
    monkeypatch.setattr(S, "within_radius", lambda x, y, r: met.append((x.count(), y.count())) or within(x, y, r))
    got = {}
    for r in S.nearest(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "key", "key", km, k).collect():
        got.setdefault(r.key, []).append((round(r.km, 6), r.near))
    want = {}
    for i, x, y, *_ in a[:-1]:
        p, q = np.radians([x, y]), np.radians([[r[1], r[2]] for r in b[:-1]])
        h = np.sin((q[:, 0] - p[0]) / 2) ** 2 + np.cos(p[0]) * np.cos(q[:, 0]) * np.sin((q[:, 1] - p[1]) / 2) ** 2
        d = 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(1, h)))
        near = sorted((round(float(v), 6), r[0]) for v, r in zip(d, b[:-1], strict=True) if v <= km)[:k]
        if near:
            want[i] = near
    assert {i: sorted(v) for i, v in got.items()} == want
    assert all(x <= len({r[1:3] for r in a}) and y <= len({r[1:3] for r in b}) for x, y in met)


def test_kernel_means_equal_all_pairs_and_meet_positions_once(spark, monkeypatch):
    from isocline.functions.geo import EARTH_KM

    (a, schema), (b, _) = _scattered(spark, 300, 3, 40), _scattered(spark, 300, 4, 40)
    b = [(*r[:4], 0.0 if r[1] and r[1] > 0 else r[4]) for r in b[:-1]] + [(301, b[0][1], b[0][2], None, 0.5), (302, b[1][1], b[1][2], 3.0, None), b[-1]]
    met = []
    within = S.within_radius
    monkeypatch.setattr(S, "within_radius", lambda x, y, r: met.append((x.count(), y.count())) or within(x, y, r))
    got = {r.key: r["mean"] for r in S.kernel_mean(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "key", "v", "land", 600.0).collect()}
    want = {}
    for i, x, y, *_ in a[:-1]:
        wl = w = vl = v = 0.0
        for _, p, q, value, land in b[:-1]:
            c = [math.radians(t) for t in (x, y, p, q)]
            h = math.sin((c[2] - c[0]) / 2) ** 2 + math.cos(c[0]) * math.cos(c[2]) * math.sin((c[3] - c[1]) / 2) ** 2
            d = 2 * EARTH_KM * math.asin(math.sqrt(min(1.0, h)))
            if d <= 1200:
                g = math.exp(-0.5 * (d / 600) ** 2)
                w += g
                wl += g * (land or 0)
                vl += g * (land or 0) * (value or 0)
                v += g * (value or 0)
        if w:
            want[i] = vl / wl if wl / w > 0.05 else v / w
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)
    assert met == [(len({r[1:3] for r in a if r[1] is not None}), len({r[1:3] for r in b if r[1] is not None}))]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("query", ["inverse_distance_five", "nearest_place"])
def test_copies_in_buckets_are_never_broadcast(spark, sf, monkeypatch, query):
    from isocline.plans import space

    plans, within = [], S.within_radius
    monkeypatch.setattr(S, "within_radius", lambda *a: plans.append(_plan(out := within(*a))) or out)
    assert space.QUERIES[query](spark, sf).count() > 0
    assert plans and all("SortMergeJoin" in p and "Broadcast" not in p for p in plans)


def test_a_key_at_two_positions_has_the_nearest_of_both(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0), (1, 0.0, 5.0), (2, 0.0, 9.0)], "key long, lat double, lon double")
    b = spark.createDataFrame([(7, 0.0, 0.1), (8, 0.0, 5.2), (9, 0.0, 5.3), (6, 0.0, 5.3)], "near_id long, lat double, lon double")
    assert sorted((r.key, r.near) for r in S.nearest(a, b, "key", "near_id", 500.0, 3).collect()) == [(1, 6), (1, 7), (1, 8), (2, 6), (2, 8), (2, 9)]
    assert sorted((r.key, r.near) for r in S.nearest(a, b, "key", "near_id", 500.0).collect()) == [(1, 7), (2, 6)]
