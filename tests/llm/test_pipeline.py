import brute

import corpus_pipeline as pipeline
from isocline.llm import vocab

SF = "/root/testdata/sf0.001"


def stage(spark, name, docs):
    return dict(pipeline.STAGES)[name](spark, docs, SF)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_run_keeps_each_stage_s_rules(spark):
    docs = documents(spark)
    columns = docs.columns
    rows = docs.collect()
    ranked = stage(spark, "quality classifier", docs)
    scores = {r.doc_id: r.predicted for r in pipeline.quality_scores(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert ranked.columns == columns and sorted(r.doc_id for r in ranked.collect()) == sorted(r.doc_id for r in rows if scores[r.doc_id])

    single = stage(spark, "minhash near-dedup", docs)
    want = sorted(i for i, (_, c) in brute.near_duplicates([(r.doc_id, r.text) for r in rows], 5).items() if i == c)
    assert single.columns == columns and sorted(r.doc_id for r in single.collect()) == want

    clean = {r.doc_id: r for r in stage(spark, "secret scan", docs).collect()}
    for r in rows:
        if brute.base_spans(r.text):
            assert not brute.base_spans(clean[r.doc_id].text) and clean[r.doc_id].n_chars == len(clean[r.doc_id].text)
        elif "[SECRET]" not in (clean[r.doc_id].text or ""):
            assert clean[r.doc_id] == r

    mixed = stage(spark, "source mix", docs)
    taken = sum(len(brute.words(r.text)) for r in mixed.collect())
    assert mixed.columns == columns and abs(taken - 1.5 * sum(len(brute.words(r.text)) for r in rows)) < 0.02 * taken


def test_whole_run(spark):
    docs = documents(spark)
    for name, f in pipeline.STAGES[:-1]:
        docs = f(spark, docs, SF)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocab.public_path("word_bpe_49k.json"))
    tokens = sum(len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    out = pipeline.run(spark, SF).collect()
    assert sum(r.length for r in out) == tokens
    assert len({r.sequence_id for r in out}) <= -(-tokens // 4096) + 1


def test_repeated_rows_nulls_and_clashing_columns(spark):
    text = "a b c d e f g h token=0123456789abcdef01"
    rows = [(1, text, "en", "s", 10, "k")] * 3 + [(1, "other words entirely here now", "en", "s", 9, "k"), (2, text, "en", None, 10, "k"), (None, None, None, None, None, None), (3, "", "en", "s", 0, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, found string")
    kept = sorted((str(r.doc_id), r.text or "") for r in stage(spark, "minhash near-dedup", df).collect())
    assert kept == sorted([("1", text), ("1", "other words entirely here now"), ("None", ""), ("3", "")])
    clean = stage(spark, "secret scan", df).collect()
    assert len(clean) == 7 and all("[SECRET]" in r.text for r in clean if r.text and "token" in text and r.text.startswith("a b"))
    assert stage(spark, "source mix", df).columns == df.columns
    for name, f in pipeline.STAGES:
        assert f(spark, df.where("false"), SF).collect() == []


CLASHES = ("_copies", "_rows", "_found", "_of", "_of_key", "_row_key", "_ROW_KEY_", "_value", "_new", "_kept", "found", "node", "size", "copies", "key", "kept")


def test_columns_with_the_names_of_inner_ones(spark):
    """Whatever further columns are called, they come through, and the same documents stay."""
    docs = documents(spark)
    more = docs
    for k, name in enumerate(CLASHES):
        more = more.withColumn(name, docs.doc_id + k)
    for name, f in pipeline.STAGES[:-1]:
        out = f(spark, more, SF)
        assert out.columns == more.columns
        rows = out.collect()
        assert all(r[c] == r.doc_id + k for r in rows for k, c in enumerate(CLASHES))
        assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in f(spark, docs, SF).collect()) or name == "source mix"
    assert len(pipeline.STAGES[-1][1](spark, more, SF).collect()) >= docs.count()


def test_run_leaves_only_what_its_result_reads(spark):
    import os

    from isocline.llm import common

    common.clear_stages(spark)
    out = pipeline.run(spark, SF)
    left = [p for p in common._STAGED if os.path.exists(p.removeprefix("file:"))]
    assert len(left) == len(common._STAGED) <= 2 and out.count() > 0


def test_a_cluster_without_a_shared_folder_is_an_error():
    import pytest

    from isocline.llm.common import shared_folder

    class Session:
        conf = {}

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError):
        shared_folder(Session)


def test_secret_stage_learns_from_every_text(spark, monkeypatch):
    """More labelled credentials and texts than a sample of 2,000 would hold."""
    from isocline.llm import secrets

    models = []
    learned = secrets.learned
    monkeypatch.setattr(secrets, "learned", lambda strings: models.append(learned(strings)) or models[-1])
    rows = [(i, f"every text says lonely{i:05d}end and token = abc{i:05d}", "en", "s", 9) for i in range(3_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    clean = stage(spark, "secret scan", docs).collect()
    assert len(clean) == 3_000 and not any("token = abc" in r.text for r in clean)
    assert [sum(a.ends) for a, _ in models[0].kinds] == [3_000]
