"""Skill, thresholds, novelty, folds, predictors and fitted models of presence and background."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import ranked, running_totals


def auc(df: DataFrame, score: str, positive: Column, by: Sequence[str] = ()) -> DataFrame:
    """by, auc: by rank sums, ties counting half; null without both kinds."""
    by = list(by)
    r = ranked(df.withColumn("_pos", positive), score, by)
    n = F.sum(F.when(F.col("_pos"), 1).otherwise(0))
    m = F.count("*") - n
    ranks = F.sum(F.when(F.col("_pos"), F.col("rank")))
    return r.where(F.col(score).isNotNull()).groupBy(*by).agg(F.when((n > 0) & (m > 0), F.try_divide(ranks - n * (n + 1) / 2, n * m)).alias("auc"))


def best_threshold(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """threshold, sens, spec, tss of the score with the largest true skill; the smallest on ties."""
    hit = F.when(positive, 1).otherwise(0)
    t = running_totals(df, score, {"p": F.sum(hit), "q": F.sum(1 - hit)})
    ends = df.where(F.col(score).isNotNull()).agg(F.sum(hit).alias("np"), F.sum(1 - hit).alias("nq"))
    s = t.join(F.broadcast(ends)).select(F.col(score).alias("threshold"), ((F.col("np") - F.col("p_before")) / F.col("np")).alias("sens"), (F.col("q_before") / F.col("nq")).alias("spec"))
    s = s.withColumn("tss", F.col("sens") + F.col("spec") - 1)
    return s.orderBy(F.round("tss", 12).desc(), "threshold").limit(1)


def boyce(df: DataFrame, score: str, present: Column, windows: int = 100, width: float = 0.1) -> DataFrame:
    """boyce: the rank correlation of predicted to expected frequency with the score, over moving windows of it.

    Null with fewer than 5 presences or 5 windows that hold cells, or if the ratio never varies.
    """
    low = F.col("w") * ((1 - width) / (windows - 1))
    hit = F.when(present, 1).otherwise(0)
    totals = running_totals(df, score, {"e": F.count("*"), "p": F.sum(hit)})
    # Each distinct score adds to the windows that hold it.
    first = F.ceil((F.col(score) - width) / ((1 - width) / (windows - 1)) - 1).cast("int")
    spread = totals.withColumn("w", F.explode(F.sequence(F.greatest(first, F.lit(0)), F.least(F.ceil(F.col(score) / ((1 - width) / (windows - 1)) + 1).cast("int"), F.lit(windows - 1)))))
    inside = spread.where((F.col(score) >= low) & (F.col(score) <= low + width))
    whole = df.where(F.col(score).isNotNull()).agg(F.count("*").alias("ne"), F.sum(hit).alias("np"))
    ratio = inside.groupBy("w").agg(F.sum("p").alias("p"), F.sum("e").alias("e")).join(F.broadcast(whole)).select("w", "np", F.try_divide(F.col("p") / F.col("e") * F.col("ne"), F.col("np")).alias("f"))
    # The table has at most as many rows as there are windows.
    rank = lambda c: F.rank().over(Window.orderBy(c)) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2
    r = ratio.withColumn("f", F.round("f", 12)).select("np", rank("f").alias("rf"), rank("w").alias("rw"))
    return r.agg(F.when((F.max("np") >= 5) & (F.count("*") >= 5) & (F.stddev_pop("rf") > 0), F.corr("rf", "rw")).alias("boyce"))


def percentile_of(df: DataFrame, reference: DataFrame, score: str, by: Sequence[str] = ()) -> DataFrame:
    """A column `percentile`: the share of reference scores not above a row's."""
    by = list(by)
    both = df.select(*by, score, F.lit(0).alias("_r")).unionByName(reference.select(*by, score, F.lit(1).alias("_r")))
    totals = running_totals(both, score, {"_n": F.sum("_r")}, by)
    whole = reference.where(F.col(score).isNotNull()).groupBy(*by).agg(F.count("*").alias("_all"))
    totals = totals.join(whole, by) if by else totals.join(F.broadcast(whole))
    return df.join(totals.select(*by, score, (F.col("_n_upto") / F.col("_all")).alias("percentile")), [*by, score], "left")


def similarity(df: DataFrame, reference: DataFrame, predictors: Sequence[str], key: str) -> DataFrame:
    """key, mess, worst: the least univariate similarity to the reference in per cent (negative: novel), and its predictor.

    Predictors are rows of one table, so that one pass ranks them all. key names a row.
    """
    stacked = lambda t, *more: t.select(*more, F.explode(F.array(*[F.struct(F.lit(p).alias("_p"), F.col(p).cast("double").alias("_x")) for p in predictors])).alias("_v")).select(*more, "_v.*")
    known = stacked(reference)
    ends = known.groupBy("_p").agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    placed = percentile_of(stacked(df, key), known, "_x", ["_p"]).join(F.broadcast(ends), "_p", "left")
    x, lo, hi, f = F.col("_x"), F.col("_lo"), F.col("_hi"), F.col("percentile") * 100
    wide = F.greatest(hi - lo, F.lit(1e-12))
    s = F.when(x < lo, (x - lo) / wide * 100).when(x > hi, (hi - x) / wide * 100).when(f <= 50, 2 * f).otherwise(2 * (100 - f))
    return placed.groupBy(key).agg(F.min(F.struct(s.alias("s"), F.col("_p").alias("p"))).alias("_w")).select(key, F.col("_w.s").alias("mess"), F.col("_w.p").alias("worst"))


def outside(df: DataFrame, reference: DataFrame, predictors: Sequence[str]) -> DataFrame:
    """A column `novel`: whether any predictor lies outside the reference's range."""
    ends = reference.agg(*[f(p).alias(f"_{n}_{p}") for p in predictors for n, f in (("lo", F.min), ("hi", F.max))])
    test = F.lit(False)
    for p in predictors:
        test = test | (F.col(p) < F.col(f"_lo_{p}")) | (F.col(p) > F.col(f"_hi_{p}"))
    return df.join(F.broadcast(ends)).withColumn("novel", test).select(*df.columns, "novel")


def prune_correlated(df: DataFrame, predictors: Sequence[str], most: float = 0.7, keep: int = 5) -> pd.DataFrame:
    """predictor, kept, instead: a predictor stays unless its rank correlation with an earlier one that stays is beyond most.

    instead names the strongest such one, or says "no room" beyond keep predictors. Only one small matrix is gathered.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    vectors = VectorAssembler(inputCols=list(predictors), outputCol="_v", handleInvalid="skip").transform(df).select("_v")
    strength = pd.DataFrame(np.abs(Correlation.corr(vectors, "_v", "spearman").head()[0].toArray()), predictors, predictors)
    open_ones, stays = pd.Series(True, predictors), []
    while open_ones.any() and len(stays) < keep:
        stays.append(open_ones.idxmax())
        open_ones &= strength[stays[-1]] <= most
        open_ones[stays[-1]] = False

    def instead(name: str) -> str | None:
        earlier = strength.loc[name, [p for p in stays if strength.index.get_loc(p) < strength.index.get_loc(name)]]
        return None if name in stays else earlier.idxmax() if len(earlier) and earlier.max() > most else "no room"

    return pd.DataFrame({"predictor": list(predictors), "kept": [p in stays for p in predictors], "instead": list(map(instead, predictors))})


def block_folds(df: DataFrame, x: str, y: str, size: float, positive: Column, folds: int = 5) -> DataFrame:
    """A column `fold`: square blocks with their positive rows, the heaviest first, each to the fold that is lightest by then.

    Of equally light folds the one with fewer blocks is next, then the first. One task deals the blocks, which are as many as the
    study area has, whatever the number of rows.
    """
    block = [F.floor(F.col(c) / size).cast("long").alias(n) for c, n in ((x, "_bx"), (y, "_by"))]
    weights = df.groupBy(*block).agg(F.count_if(positive).alias("w"))

    def deal(blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values(["w", "_bx", "_by"], ascending=[False, True, True])
        lightest = [(0, 0, fold) for fold in range(folds)]
        dealt = []
        for w in blocks.w.tolist():
            load, held, fold = heapq.heappop(lightest)
            heapq.heappush(lightest, (load + w, held + 1, fold))
            dealt.append(fold)
        return blocks.assign(fold=dealt)[["_bx", "_by", "fold"]]

    table = weights.groupBy(F.lit(0).alias("_all")).applyInPandas(deal, "_bx long, _by long, fold int")
    return df.select("*", *block).join(table, ["_bx", "_by"], "left").withColumn("fold", F.coalesce("fold", F.lit(-1))).drop("_bx", "_by")


def training_sample(df: DataFrame, label: str, key: str, most: int, background: tuple[int, int] = (10_000, 50_000)) -> DataFrame:
    """At most so many presences and, within bounds, three times as many background rows: those of the smallest hashes of key."""
    order = F.xxhash64(key)
    present = df.where(F.col(label) == 1).orderBy(order, key).limit(most)
    wanted = min(background[1], max(background[0], 3 * present.count()))
    return present.unionByName(df.where(F.col(label) == 0).orderBy(order, key).limit(wanted))


def balanced_weight(label: str, df: DataFrame) -> Column:
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    n = sum(counts.values())
    return F.create_map(*[F.lit(v) for k, c in counts.items() for v in (k, n / (2.0 * c))])[F.col(label)]


#: Fitted models by name; `raw` scores are probabilities of presence.
def make_model(name: str, features: Sequence[str], label: str, seed: int = 0):
    """A pipeline of pyspark.ml for gbm, rf, glm (with squares), gam (spline-like hinges) or maxent (L1 hinges)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import PolynomialExpansion, SQLTransformer, StandardScaler, VectorAssembler

    join = VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="skip")
    common = {"featuresCol": "_f", "labelCol": label, "weightCol": "_weight"}
    if name in ("gbm", "rf"):
        join.setOutputCol("_f")
        trees = GBTClassifier(maxIter=30, maxDepth=3, stepSize=0.1, subsamplingRate=0.7, seed=seed, **common) if name == "gbm" else RandomForestClassifier(numTrees=60, minInstancesPerNode=10, seed=seed, **common)
        return Pipeline(stages=[join, trees])
    if name == "glm":
        widen, inputs = PolynomialExpansion(degree=2, inputCol="_s", outputCol="_f"), join
        return Pipeline(stages=[inputs, StandardScaler(inputCol="_x", outputCol="_s", withMean=True), widen, LogisticRegression(maxIter=50, regParam=1e-3, **common)])
    knots = (0.2, 0.35, 0.5, 0.65, 0.8) if name == "gam" else (0.1, 0.25, 0.4, 0.5, 0.6, 0.75, 0.9)
    hinges = ", ".join(f"greatest(0D, {f} - {k}D) AS {f}_h{i}" for f in features for i, k in enumerate(knots))
    names = [*features, *[f"{f}_h{i}" for f in features for i in range(len(knots))]]
    wide = VectorAssembler(inputCols=names, outputCol="_f", handleInvalid="skip")
    penalty = {"regParam": 0.02, "elasticNetParam": 0.0} if name == "gam" else {"regParam": 0.005, "elasticNetParam": 1.0}
    return Pipeline(stages=[SQLTransformer(statement=f"SELECT *, {hinges} FROM __THIS__"), wide, LogisticRegression(maxIter=50, **penalty, **common)])


def fit(df: DataFrame, name: str, features: Sequence[str], label: str, seed: int = 0):
    """A model of the family; df is a bounded training_sample(), which is held while trees grow."""
    train = df.select(*features, label).cache()
    try:
        return make_model(name, features, label, seed).fit(train.withColumn("_weight", balanced_weight(label, train)))
    finally:
        train.unpersist()


def resumed(spark, path: str, make):
    """The fitted pipeline of a path if an earlier run finished it there, else make()'s, saved with its mark last."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/metadata/_SUCCESS")
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.done")
    system = mark.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(done):
        return load(path)
    model = make()
    save(model, path)
    system.create(done, True).close()
    return model


def save(model, path: str) -> None:
    """Keep a fitted pipeline; an existing one of that name is replaced."""
    model.write().overwrite().save(path)


def load(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def score(model, df: DataFrame) -> DataFrame:
    """df with a column `raw`."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(df.withColumn("_weight", F.lit(1.0)))
    return out.withColumn("raw", vector_to_array("probability")[1]).select(*df.columns, "raw")


def cross_validated(df: DataFrame, name: str, features: Sequence[str], label: str, fold: str, least: tuple[int, int, int] = (3, 10, 3), train: DataFrame | None = None) -> DataFrame:
    """Out-of-fold scores: df with `raw`, of the folds with enough held-out and training rows.

    train: the bounded rows to learn from, with folds of the same blocks; df itself if not given. A model never sees the block that
    it scores, nor, where df holds a later window of the blocks, that window.
    """
    source = df if train is None else train
    held = {r[fold]: r for r in source.groupBy(fold).agg(F.sum(label).alias("p"), F.count("*").alias("n")).collect()}
    every = sum(r.p for r in held.values())
    parts = [score(fit(source.where(F.col(fold) != f), name, features, label), df.where(F.col(fold) == f)) for f, r in sorted(held.items()) if r.p >= least[0] and r.n - r.p >= least[2] and every - r.p >= least[1]]
    if not parts:
        raise ValueError("no fold has enough rows")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def boosted_folds(df: DataFrame, features: Sequence[str], label: str, fold: str, key: str, by: str | None = None, least: tuple[int, int, int] = (3, 10, 3), **settings) -> DataFrame:
    """Out-of-fold scores of boosted trees: by, fold, key, label, raw. Every fold of every group is a task of its own.

    Training rows are copied once for each fold, so a group is to be a bounded sample of presences and background.
    """
    from ..functions.boost import BoostedTrees

    folds = [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]
    group = [by] if by else []
    rows = df.select(*group, key, fold, label, *features)
    copies = rows.withColumn("_held", F.explode(F.array(*map(F.lit, folds))))
    kinds = dict(df.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in (*group, fold, key, label)) + ", raw double"

    def run(part: pd.DataFrame) -> pd.DataFrame:
        inside = part[fold] == part["_held"]
        test, train = part[inside], part[~inside]
        if test[label].sum() < least[0] or (1 - test[label]).sum() < least[2] or train[label].sum() < least[1]:
            return test.head(0)[[*group, fold, key, label]].assign(raw=0.0)
        model = BoostedTrees(**settings).fit(train[list(features)].to_numpy(float), train[label].to_numpy())
        return test[[*group, fold, key, label]].assign(raw=model.raw(test[list(features)].to_numpy(float)))

    return copies.groupBy(*group, "_held").applyInPandas(run, schema)


def model_vote(df: DataFrame, by: Sequence[str], code: str, novel: Column, at: int = 44, share: float = 0.5) -> DataFrame:
    """by, median code, agreement in fifteenths, novelty vote over the models of a cell."""
    n = F.count("*")
    agree = F.sum(F.when(F.col(code) >= at, 1).otherwise(0))
    votes = F.sum(F.when(novel, 1).otherwise(0))
    return df.groupBy(*by).agg(F.rint(F.median(code)).cast("int").alias("code"), F.rint(15.0 * agree / n).cast("int").alias("agreement"), (votes >= F.greatest(F.lit(1), F.ceil(n * share))).alias("novel"))


def weighted_draw(df: DataFrame, weight: str, n: int, floor: float, key: str, seed: int = 0) -> DataFrame:
    """n rows without replacement, in proportion to weight mixed with a uniform floor, by exponential keys of a hash."""
    total = df.agg(F.sum(weight).alias("_sum"), F.count("*").alias("_count"))
    p = (1 - floor) * F.try_divide(F.col(weight), F.col("_sum")) + floor / F.col("_count")
    u = (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)) + 1) / float(1 << 52)
    drawn = df.join(F.broadcast(total)).withColumn("_key", -F.log(u) / p)
    return drawn.orderBy("_key", key).limit(n).select(*df.columns)


def first_fit(sizes: Sequence[tuple[str, int]], capacity: int) -> list[tuple[str, int]]:
    """(name, bin) by first fit, largest first: a plan of a few downloads, made on the driver."""
    left: list[int] = []
    out = []
    for name, size in sorted(sizes, key=lambda s: (-s[1], s[0])):
        at = next((i for i, room in enumerate(left) if size <= room), len(left))
        if at == len(left):
            left.append(capacity)
        left[at] -= size
        out.append((name, at + 1))
    return out
