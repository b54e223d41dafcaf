import numpy as np
import pytest

from isocline.llm.mixing import flight, landing, mix


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """The contract's rule, step by step."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * unit > most * sizes[s]}
        if not full:
            return out | {s: weight[s] * unit for s in free}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= full
    return out


def table(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(900):
        source = None if i % 37 == 0 else ["b", "B", "a", "zz", "é"][min(4, int(rng.exponential(1.2)))]
        text = None if i % 41 == 0 else " \t".join(["w"] * int(rng.lognormal(3, 1.2)))
        rows.append((i, text, source, "clash", 1.0))
    rows += [(5000, "x y z", "a", "clash", 1.0)] * 20
    return spark.createDataFrame(rows, "doc_id long, text string, source string, rate string, p double")


def test_targets_and_takings(spark):
    df = table(spark)
    rows = mix(df).collect()
    source = {r.doc_id: r.source for r in df.collect()}
    sizes, taken, target = {}, {}, {}
    for r in rows:
        s = source[r.doc_id]
        sizes[s] = sizes.get(s, 0) + r.size
        taken[s] = taken.get(s, 0) + r.taken
        target[s] = r.target
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
    assert all(r.source_size == sizes[source[r.doc_id]] for r in rows)
    want = targets(sizes)
    assert target == pytest.approx(want)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(6, 0.01 * target[s])
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_reruns_agree(spark):
    df = table(spark)
    key = lambda r: (r.doc_id, r.taken)
    assert sorted(map(key, mix(df).collect())) == sorted(map(key, mix(df.repartition(7)).collect()))


def test_chunks_are_gathered_level_by_level(spark, monkeypatch):
    import isocline.llm.mixing as module

    monkeypatch.setattr(module, "CHUNK", 40)
    df = spark.createDataFrame([(i, "w " * (1 + i % 23), "one" if i % 3 else "two") for i in range(2000)], "doc_id long, text string, source string")
    for source in ("one", "two"):
        rows = [r for r in mix(df).collect() if (r.doc_id % 3 > 0) == (source == "one")]
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= 12


def test_without_words_or_rows(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r.doc_id, r.size, r.target, r.taken) for r in mix(df).orderBy("doc_id").collect()] == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
    assert mix(df.where("false")).collect() == []


def test_flight_keeps_its_totals_and_landing_comes_near():
    rng = np.random.default_rng(0)
    size = np.exp(rng.normal(5, 1.3, 800)).astype(np.int64)
    p = rng.random(800)
    out = flight(size, p, np.random.default_rng(1))
    assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 12
    assert out.sum() == pytest.approx(p.sum()) and (out * size).sum() == pytest.approx((p * size).sum())
    assert abs((landing(size, out) * size).sum() - (p * size).sum()) < 20
    same = flight(np.full(9, 4), np.full(9, 0.5), np.random.default_rng(1))
    assert same.sum() == pytest.approx(4.5)


def test_registered_sizes_and_takings(spark, sf):
    import brute

    from isocline.llm.queries import QUERIES

    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op1_mix_sources"](spark, sf).collect()
    assert {r.doc_id: r.size for r in rows} == {i: len(brute.words(d.text)) for i, d in docs.items()}
    sizes, taken = {}, {}
    for r in rows:
        source = docs[r.doc_id].source
        sizes[source] = sizes.get(source, 0) + r.size
        taken[source] = taken.get(source, 0) + r.taken
    want = targets(sizes)
    assert {docs[r.doc_id].source: r.target for r in rows} == pytest.approx(want)
    assert all(abs(taken[s] - want[s]) <= max(6, 0.01 * want[s]) for s in want)


def test_a_text_of_megabytes_and_words_of_other_space(spark):
    rows = [(1, "w " * 1_500_000, "a"), (2, "x\u00a0y\u2003z a\x0bb\x0cc", "a"), (3, "\x1cq", None)]
    got = {r.doc_id: r.size for r in mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {1: 1_500_000, 2: 4, 3: 1}
