"""Look-ups, training samples, folds and resumed fits, against plain computations."""

import math

import pytest
from pyspark.sql import functions as F

from isocline.operators import lookup as L
from isocline.operators import models as D


def test_usable_rows_are_finite_land_beyond_the_latitude(spark):
    rows = [(1, 0.3, 10.0, 1.0), (2, 0.2, 10.0, 1.0), (3, 0.3, -60.0, 1.0), (4, 0.3, 10.0, float("nan")), (5, 0.3, 10.0, None), (6, None, 10.0, 1.0), (7, 0.25, 10.0, float("inf"))]
    df = spark.createDataFrame(rows, "k int, land double, lat double, v double")
    assert [r.k for r in L.usable(df, F.col("land"), F.col("lat"), ["v"], 0.25, -60).collect()] == [1]


def test_levels_need_enough_models(spark):
    rows = [("p", m, w / 2, float(10 * m + w)) for m in range(4) for w in range(0, 3 + m)]
    got = {r.level: (r.models, r["median"]) for r in L.levels_reached(spark.createDataFrame(rows, "place string, model int, warming double, value double"), ["place"], [1.0, 1.5, 2.5]).collect()}
    assert got == {1.0: (4, 17.0), 1.5: (3, 23.0)}


def test_first_source_refuses_other_periods_and_nulls(spark):
    rows = [(1, "b", "mid", 2.0), (1, "a", "late", 1.0), (2, "a", "mid", None), (2, "c", "mid", 3.0), (3, "x", "mid", 4.0)]
    got = L.first_source(spark.createDataFrame(rows, "k int, source string, period string, value double"), ["k"], ["a", "b", "c"], "mid").collect()
    assert sorted(map(tuple, got)) == [(1, "b", 2.0), (2, "c", 3.0)]


def test_names_meet_whatever_their_case_and_blanks_meet_nothing(spark):
    a = spark.createDataFrame([(1, " House Sparrow"), (2, ""), (3, None)], "i int, name string")
    b = spark.createDataFrame([(9, "house sparrow "), (8, " "), (7, None)], "j int, name string")
    assert [(r.i, r.j) for r in L.by_common_name(a, b, "name").collect()] == [(1, 9)]


def test_polygons_hold_or_are_near(spark):
    def ring(name, corners):
        return [(name, *p, *q) for p, q in zip(corners, corners[1:] + corners[:1], strict=True)]

    edges = ring("u", [(0.0, 0.0), (6.0, 0.0), (6.0, 6.0), (4.0, 6.0), (4.0, 2.0), (2.0, 2.0), (2.0, 6.0), (0.0, 6.0)]) + ring("v", [(10.0, 0.0), (12.0, 0.0), (11.0, 3.5)])
    points = [(1, 1.0, 5.0), (2, 3.0, 4.0), (3, 5.0, 5.5), (4, 11.0, 1.0), (5, 12.5, 0.3), (6, 6.5, 6.5), (7, 20.0, 20.0), (8, 3.0, 1.0)]
    got = L.polygons_of_points(spark.createDataFrame(points, "k int, x double, y double"), spark.createDataFrame(edges, "polygon string, x0 double, y0 double, x1 double, y1 double"), "k").collect()
    assert {r.k: (r.polygon, r.inside) for r in got} == {1: ("u", True), 2: (None, False), 3: ("u", True), 4: ("v", True), 5: ("v", False), 6: ("u", False), 7: (None, False), 8: ("u", True)}


def test_correlated_predictors_go(spark):
    rows = [(float(i), float(i**2), float((i * 37) % 101), float(-((i * 37) % 101)) + 0.1 * (i % 3), float((i * 53) % 97)) for i in range(100)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    told = D.prune_correlated(df, ["a", "b", "c", "d", "e"])
    assert told.values.tolist() == [["a", True, None], ["b", False, "a"], ["c", True, None], ["d", False, "c"], ["e", True, None]]
    assert D.prune_correlated(df, ["a", "b", "c", "d", "e"], keep=2).instead.tolist() == [None, "a", None, "c", "no room"]


def test_folds_balance_whole_blocks(spark):
    rows = [(float(i % 10), float(i // 10 % 10), int(i % 10 < 3)) for i in range(1000)]
    out = D.block_folds(spark.createDataFrame(rows, "x double, y double, p int"), "x", "y", 2.0, F.col("p") == 1, folds=3).collect()
    of_block = {}
    for r in out:
        of_block.setdefault((math.floor(r.x / 2), math.floor(r.y / 2)), set()).add(r.fold)
    load = [sum(r.p for r in out if r.fold == f) for f in range(3)]
    assert all(len(f) == 1 for f in of_block.values()) and sum(load) == 300 and max(load) - min(load) <= 40 and len(out) == 1000


def test_training_samples_are_bounded_and_do_not_change(spark):
    df = spark.range(5000).select("id", (F.col("id") % 5 == 0).cast("int").alias("y"))
    one = D.training_sample(df, "y", "id", 100, (50, 200)).collect()
    two = D.training_sample(df.repartition(7), "y", "id", 100, (50, 200)).collect()
    assert sum(r.y for r in one) == 100 and len(one) == 300 and sorted(one) == sorted(two)


def test_a_finished_fit_is_taken_up_again(spark, tmp_path):
    df = spark.range(200).select((F.col("id") / 200).alias("a"), (F.col("id") % 200 > 90).cast("int").alias("y"))
    calls = []

    def make():
        calls.append(1)
        return D.fit(df, "glm", ["a"], "y")

    first = D.resumed(spark, f"{tmp_path}/m", make)
    again = D.resumed(spark, f"{tmp_path}/m", make)
    assert len(calls) == 1
    a, b = (sorted(round(r.raw, 9) for r in D.score(m, df).collect()) for m in (first, again))
    assert a == b


def test_nearest_few_in_order(spark):
    from isocline.operators import spatial as S

    left = spark.createDataFrame([(1, 0.0, 0.0)], "k int, lat double, lon double")
    right = spark.createDataFrame([(i, 0.0, 0.1 * ((i * 7) % 20)) for i in range(20)], "r int, lat double, lon double")
    got = sorted((round(r.km, 6), r.near) for r in S.nearest(left, right, "k", "r", 500.0, 4).collect())
    assert [n for _, n in got] == [0, 3, 6, 9] and got[1][0] == pytest.approx(11.119, abs=0.02)


def test_a_broken_module_of_the_library_is_an_error(monkeypatch):
    import builtins

    import __spark_entry__ as entry

    real = builtins.__import__

    def missing(name):
        def load(*args, **kw):
            if args[0] == "corpus_pipeline":
                raise ImportError("broken", name=name)
            return real(*args, **kw)

        return load

    if not entry._there("corpus_pipeline") or not entry._there("isocline.llm"):
        return
    monkeypatch.setattr(builtins, "__import__", missing("isocline.llm.gone"))
    with pytest.raises(ImportError):
        entry.queries()
    monkeypatch.setattr(builtins, "__import__", missing("another_library"))
    assert "analog_nearest" in entry.queries()
