import random

import brute
import pytest

from isocline.llm import shingles
from isocline.llm.components import connected_components
from isocline.llm.near_dup import near_duplicates


def varied(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus():
    """Unrelated texts, groups of copies with more and more changes, texts that share a passage, odd ones."""
    rng = random.Random(5)
    docs = [" ".join(varied(rng, rng.randrange(1, 120))) for _ in range(60)]
    for group in range(6):
        base = varied(rng, 80)
        for k in range(12):
            text = list(base)
            for _ in range(k if group % 2 else rng.randrange(4)):
                text[rng.randrange(len(text))] = "x%d" % rng.randrange(10**6)
            docs.append((" " if k % 2 else "\n").join(text).upper() if k % 3 == 0 else " ".join(text))
    passage = " ".join(varied(rng, 60))
    docs += [passage + " " + " ".join(varied(rng, rng.randrange(5, 90))) for _ in range(30)]
    docs += ["", None, "   \t\n", "one", "ONE", "one two three", "One  two\nthree", "é ñ", "\u00a0", "a\u00a0b c d e", "x" * 5000]
    return list(enumerate(docs))


@pytest.mark.parametrize("n", [4, 5])
def test_equals_brute_force(spark, n):
    docs = corpus()
    df = spark.createDataFrame([(i, t, "node", "u", 1) for i, t in docs], "doc_id long, text string, node string, u string, rows int").repartition(5)
    rows = near_duplicates(df, words=n).collect()
    want = brute.near_duplicates(docs, n)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_registered_query_equals_brute_force(spark, sf):
    from isocline.llm.queries import QUERIES

    rows = QUERIES["op10_near_duplicates"](spark, sf).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute.near_duplicates(docs, 4)


def test_repeated_rows_null_ids_and_empty_table(spark):
    text = "a b c d e f g"
    df = spark.createDataFrame([(7, text), (7, text), (None, text), (3, None), (None, None), (None, "z y x w")], "doc_id long, text string")
    rows = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect()), key=str)
    assert rows == sorted([(7, 3, 7, True), (7, 3, 7, True), (None, 3, 7, False), (3, 0, 3, True), (None, 0, None, True), (None, 1, None, True)], key=str)
    assert near_duplicates(df.where("false")).collect() == []


def test_crowded_regions_are_cut_where_neighbours_share_least_and_bridged(monkeypatch):
    import numpy as np

    import isocline.llm.near_dup as module

    monkeypatch.setattr(module, "REGION", 8)
    monkeypatch.setattr(module, "OVERLAP", 2)
    shared = np.array([-1, 5, 5, 5, 5, 1, 5, 5, 5, 5, 5, 5, 5, 5, 5, 5, 5, 2, 5, 5])
    runs, rest = module.deepened(shared, 0, 20, True)
    assert runs == [(0, 7), (5, 15), (13, 20)] and rest == 13
    runs, rest = module.deepened(shared, 0, 20, False)
    assert rest < 20 and all(b - a <= 10 for a, b in runs)


def test_walk_of_sorted_keys_keeps_every_region_whatever_the_batches(monkeypatch):
    import numpy as np
    import pyarrow as pa

    import isocline.llm.near_dup as module

    class Context:
        partitionId = staticmethod(lambda: 3)

    monkeypatch.setattr(module, "TaskContext", type("T", (), {"get": staticmethod(Context)}))
    rng = np.random.default_rng(3)
    keys = np.zeros((600, module._KEY), np.uint8)
    keys[:, 1] = np.sort(rng.integers(0, 90, 600))
    nodes = rng.integers(0, 256, (600, 16), dtype=np.uint8)
    want = {tuple(map(bytes, nodes[keys[:, 1] == v])) for v in range(90) if (keys[:, 1] == v).sum() > 1}
    for size in (1, 7, 600):
        batches = [pa.RecordBatch.from_arrays([module.binaries(keys[i : i + size]), module.binaries(nodes[i : i + size])], ["key", "node"]) for i in range(0, 600, size)]
        rows = [r for b in module._regions(iter(batches)) for r in b.to_pylist()]
        found = {}
        for r in rows:
            if r["key"] is None:
                found.setdefault(r["run"], []).append(r["node"])
        assert {tuple(x) for x in found.values()} == want
        assert [r["node"] for r in rows if r["tail"] is False] == list(map(bytes, nodes[:64])) and [r["node"] for r in rows if r["tail"]] == list(map(bytes, nodes[-64:]))


@pytest.mark.parametrize("partitions", [4, 40])
def test_group_larger_than_a_run_and_a_block(spark, partitions):
    rng = random.Random(1)
    base = varied(rng, 60)
    docs = []
    for i in range(1400):
        text = list(base)
        for _ in range(1 + i % 2):
            text[rng.randrange(60)] = f"y{rng.randrange(10**6)}"
        docs.append((i, " ".join(text)))
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), words=4).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute.near_duplicates(docs, 4)


def test_texts_of_several_megabytes(spark):
    rng = random.Random(8)
    long = varied(rng, 600_000, 10**6)
    other = list(long)
    for _ in range(20_000):
        other[rng.randrange(len(other))] = "z"
    docs = [(1, " ".join(long)), (2, " ".join(other)), (3, " ".join(long[:300_000])), (4, "short text of words"), (5, "x" * (4 << 20))]
    rows = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute.near_duplicates(docs, 5)


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 100 + k) for k in range(1, 30)] + [(200, 200), (300, 301), (301, 300), (None, 5)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.root for r in connected_components(df, "a", "b").collect()}
    want = {i: 0 for i in range(51)} | {100 + k: 100 for k in range(30)} | {300: 300, 301: 300}
    assert got == want
    assert connected_components(df.where("false"), "a", "b").collect() == []


def test_components_across_chunks_and_hot_nodes(spark, monkeypatch):
    import isocline.llm.common as common

    monkeypatch.setattr(common, "HOT_ROWS", 3)
    monkeypatch.setattr(common, "HOT_KEYS", 10)
    rng = random.Random(4)
    links = [(0, k) for k in range(1, 300)] + [(k, k + 1) for k in range(1000, 1200)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(300)]
    rng.shuffle(links)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long").repartition(12), "a", "b").collect()}
    assert got == {i: r for i, r in brute.components({i for x in links for i in x if x[0] != x[1]}, links).items()}


def test_hot_keys_join_as_others(spark, monkeypatch):
    import isocline.llm.common as common

    monkeypatch.setattr(common, "HOT_ROWS", 3)
    monkeypatch.setattr(common, "HOT_KEYS", 4)
    keys = [None, "a", "a", "a", "a", "b", "c", "a", None, "d"]
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, k string")
    side = spark.createDataFrame([("a", 5, "A"), ("b", 1, "B"), ("d", 1, "D"), ("e", 1, "E")], "k string, n int, v string")
    for how in ("inner", "left"):
        want = sorted(map(str, rows.join(side.drop("n"), "k", how).collect()))
        assert sorted(map(str, common.join_hot(rows, side, "k", "n", how).collect())) == want
        assert sorted(map(str, common.join_hot(rows, side, "k", "n", how, 100).collect())) == want


def test_word_hashes_ignore_blocks(monkeypatch):
    import numpy as np
    import pyarrow as pa

    texts = pa.array(["the quick  brown\tfox", None, "", "fox\x0bTHE x", "é\u00a0é quick"])
    raw, offsets = shingles.text_buffers(texts)
    one, at = shingles.word_hashes(raw, offsets)
    monkeypatch.setattr(shingles, "_BLOCK", 3)
    two, again = shingles.word_hashes(raw, offsets)
    assert np.array_equal(one, two) and np.array_equal(at, again)
    assert at.tolist() == [0, 4, 4, 4, 7, 9] and one[0] == one[5] and one[3] == one[4] and one[1] == one[8]
