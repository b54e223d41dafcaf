import math

import numpy as np

from isocline.llm.pivots import near_vectors
from isocline.llm.topk import search, top_inner_products


def rows(seed=0, n=400):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 8))
    for k in range(0, n, 3):
        x[k] = x[(k * 7) % n] * rng.uniform(0.5, 2) + rng.normal(size=8) * 0.02
    out = [(i, v.astype(np.float32).tolist(), int(i % 3), "c") for i, v in enumerate(x)]
    out += [(1000, None, 1, "c"), (1020, [1.0, None] + [0.0] * 6, 1, "c"), (1040, [float("nan")] * 8, 1, "c"), (1060, [float("inf")] * 8, 1, "c"), (1080, [0.0] * 8, 1, "c"), (1100, [0.5] * 4, 1, "c"), (1120, [], 1, "c")]
    out += [(20, out[20][1], out[20][2], "c"), (1140, out[5][1], None, "c"), (1160, out[5][1], out[5][2], "c"), (None, out[5][1], out[5][2], "c")]
    return out


SCHEMA = "vec_id long, embedding array<float>, label int, rank string"


def usable(v):
    return v and all(x is not None and math.isfinite(x) for x in v)


def test_top_k_equals_brute_force(spark):
    table = rows()
    got = {}
    for r in top_inner_products(spark.createDataFrame(table, SCHEMA), k=5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v, _, _ in table if usable(v)]
    want = {}
    for k, (i, v) in enumerate(whole):
        if i is not None and i % 20 == 0:
            found = [(-sum(a * b for a, b in zip(v, w, strict=True)), j if j is not None else 2**63, j) for m, (j, w) in enumerate(whole) if m != k and len(w) == len(v)]
            want.setdefault(i, []).extend((n + 1, j, -s) for n, (s, _, j) in enumerate(sorted(found, key=lambda t: t[:2])[:5]))
    key = lambda t: (t[0], str(t[1]), t[2])
    assert {i: sorted(v, key=key) for i, v in got.items()} == {i: sorted(v, key=key) for i, v in want.items() if v}
    assert top_inner_products(spark.createDataFrame([], SCHEMA)).collect() == []


def test_pruned_search_is_exact():
    rng = np.random.default_rng(1)
    vectors = np.floor(rng.normal(size=(6000, 16)) * np.exp(rng.normal(size=(6000, 1))) * 20)
    vectors[:3000] = np.floor(vectors[:1] * rng.uniform(0.1, 1, (3000, 1)) + rng.normal(size=(3000, 16)))
    q = np.arange(0, 6000, 20)
    ids = rng.permutation(6000)
    names = np.stack([ids, np.ones(6000, int)], axis=1)
    query, vector, score = search(vectors[q], names[q], vectors, ids, names, 10)
    products = vectors[q] @ vectors.T
    for k in range(len(q)):
        products[k, q[k]] = -np.inf
        best = np.lexsort((ids, -products[k]))[:10]
        assert vector[query == k].tolist() == best.tolist() and score[query == k].tolist() == products[k, best].tolist()
    big = search(vectors[:3] * 2.0**40, names[:3], vectors[:50] * 2.0**40, ids[:50], names[:50], 4)
    assert len(big[2]) == 12


def test_pruned_search_with_a_negative_heavy_coordinate():
    """Over one bucket of vectors, ruled by one negative coordinate: rows beyond the query's own share are candidates."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(12_000, 64)) * 0.05
    x[:, 0] = -1
    x[:2000] = rng.normal(size=(2000, 64)) * 0.2
    x[:2000, 0] = -1
    length = np.r_[rng.uniform(1.0, 1.3, 2000), rng.uniform(0.7, 1.0, 10_000)]
    x = np.floor(x / np.linalg.norm(x, axis=1)[:, None] * length[:, None] * 640)
    q, ids = np.arange(0, 12_000, 20), np.arange(12_000)
    names = np.stack([ids, np.ones(12_000, int)], axis=1)
    query, vector, score = search(x[q], names[q], x, ids, names, 20)
    products = x[q] @ x.T
    products[np.arange(len(q)), q] = -np.inf
    for k in range(len(q)):
        best = np.lexsort((ids, -products[k]))[:20]
        assert vector[query == k].tolist() == best.tolist() and score[query == k].tolist() == products[k, best].tolist()


def test_short_vectors_are_not_sent_where_long_ones_decide(spark, monkeypatch):
    """Bands of spread lengths: most are pruned before the shuffle, and the rows are those of brute force."""
    import isocline.llm.topk as module

    monkeypatch.setattr(module, "SLICE", 50)
    monkeypatch.setattr(module, "QUERIES", 7)
    sent = []
    staged = module.staged
    monkeypatch.setattr(module, "staged", lambda df, name: [out := staged(df, name), sent.append((name, out))][0])
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1200, 12)) * np.exp(2 * rng.normal(size=(1200, 1)))
    x[:100] = x[0]  # one vector is a twelfth of all rows
    x[600:800] = np.floor(x[600:800] * 64) / 64 * 0 + rng.choice([-1, 1], (200, 12))  # equal lengths
    table = [(i, v.tolist(), 1, "c") for i, v in enumerate(x)]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_inner_products(spark.createDataFrame(table, SCHEMA.replace("float", "double")), k=5).collect())
    whole = np.floor(64 * x)
    products = whole @ whole.T
    want = []
    for q in range(0, 1200, 20):
        products[q, q] = -np.inf
        best = np.lexsort((np.arange(1200), -products[q]))[:5]
        want += [(q, n + 1, int(j), int(products[q, j])) for n, j in enumerate(best)]
    assert got == want
    needs = [r.need for r in dict(sent)["asked"].collect()]
    assert len(needs) == 60 and sum(needs) < 0.6 * 60 * 24


def brute_links(table, least=0.98):
    n = len(table)
    ok = [usable(v) and any(v) and label is not None for _, v, label, _ in table]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if o else None for o, (_, v, _, _) in zip(ok, table, strict=True)]
    links = {i: set() for i in range(n)}
    for a in range(n):
        for b in range(a):
            if ok[a] and ok[b] and table[a][2] == table[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least:
                links[a].add(b)
                links[b].add(a)
    return links


def test_near_vectors_equal_brute_force(spark, monkeypatch):
    import isocline.llm.pivots as module

    monkeypatch.setattr(module, "BLOCK", 40)
    table = rows(4)
    links = brute_links(table)
    component = {}
    for i in range(len(table)):
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        ids = [table[k][0] for k in seen if table[k][0] is not None]
        component[i] = min(ids) if ids else None
    want = sorted(((v[0], len(links[i]), component[i], v[0] == component[i]) for i, v in enumerate(table)), key=str)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(spark.createDataFrame(table, SCHEMA)).collect()), key=str)
    assert sum(n for _, n, _, _ in got) >= 0.98 * sum(n for _, n, _, _ in want)
    assert got == want
    assert near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


def test_shared_pivots_prune_between_clusters_and_lose_nothing():
    from isocline.llm.pivots import links, spread

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 64))
    x = centres[rng.integers(0, 60, 3000)] + rng.normal(size=(3000, 64)) * 0.12
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    reach = math.sqrt(2 - 2 * 0.98) + 1e-9
    copies = rng.integers(1, 4, 3000)
    same = unit @ unit.T >= 0.98
    np.fill_diagonal(same, False)
    rows = np.arange(3000)
    counts, edges, taken = links(unit, copies, rows, rows, 0.98, spread(unit, 256, reach), reach)
    assert counts.tolist() == (same @ copies).tolist() and all(same[i, j] for i, j in edges) and same.sum() > 1000
    assert taken < 0.3 * 3000 * 1500
    counts, _, taken = links(unit, copies, rows[:1500], rows[1500:], 0.98, spread(unit, 256, reach), reach)
    same[:1500, :1500] = same[1500:, 1500:] = False
    assert counts.tolist() == (same @ copies).tolist() and taken < 0.3 * 1500 * 1500


def test_recall_on_the_check_table(spark):
    """Links that the index finds, against brute force, on clustered vectors of one label."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 64))
    x = np.repeat(centres, 25, axis=0) + rng.normal(size=(1000, 64)) * 0.09
    table = [(i, v.tolist(), 1, "c") for i, v in enumerate(x)]
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    same = unit.astype(np.float32).astype(float) @ unit.T
    want = int((np.triu(same >= 0.98, 1)).sum())
    got = sum(r.n_links for r in near_vectors(spark.createDataFrame(table, SCHEMA)).collect()) // 2
    assert want > 1000 and got >= 0.97 * want


def test_dense_cluster_keeps_its_links(spark):
    """A third of 120,000 vectors in one cluster, over many pivots: every link of sampled rows is counted."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    centre, n = rng.normal(size=64), 120_000
    x = rng.normal(size=(n, 64))
    x[: n // 3] = centre / np.linalg.norm(centre) + rng.normal(size=(n // 3, 64)) * 0.0179
    x = x[rng.permutation(n)].astype(np.float32)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * 64), pa.array(x.reshape(-1)))
    table = spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(n)), "embedding": lists, "label": pa.array(np.ones(n, np.int32))}))
    got = {r.vec_id: r.n_links for r in near_vectors(table).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    want = {i: int((unit @ unit[i] >= 0.98).sum()) - 1 for i in range(300)}
    assert sum(want.values()) > 100_000 and {i: got[i] for i in want} == want


def test_huge_and_tiny_components(spark):
    table = [(0, [1e300, 1.0], 1, "c"), (20, [2e300, 2.0], 1, "c"), (3, [1e-200, 1e-200], 1, "c"), (40, [1.0, 1.0], 1, "c")]
    df = spark.createDataFrame(table, SCHEMA.replace("float", "double"))
    assert {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(df).collect()} == {0: (1, 0), 20: (1, 0), 3: (1, 3), 40: (1, 3)}
    best = {r.query_id: (r.vec_id, r.score) for r in top_inner_products(df, k=1).collect()}
    assert best[0] == (20, 2**63 - 1) and best[40][0] in (0, 20)
