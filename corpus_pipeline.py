"""A training corpus from documents: ranked, deduplicated, freed of secrets, mixed and packed.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run() writes each stage's result as
Parquet and reads it again as the next one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isocline.llm import vocab
from isocline.llm.common import clear_stages, free_names, small_side, stage_mark, staged
from isocline.llm.mixing import mix
from isocline.llm.near_dup import near_duplicates
from isocline.llm.packing import pack
from isocline.llm.quality import quality_scores
from isocline.llm.secrets import redacted, scan_secrets

#: Bytes of a broadcast row of doc_id and key in a hashed relation.
KEY_BYTES = 128


class _Rows:
    """The rows of a stage's input with a hash of all columns beside doc_id, which tells rows of one doc_id apart.

    All names that a stage adds are free in the input, whatever columns that has.
    """

    def __init__(self, docs: DataFrame):
        self.columns = docs.columns
        self.key, self.of, self.of_key, self.rows, self.value, self.new = free_names(docs, "_row_key", "_of", "_of_key", "_rows", "_value", "_new")
        self.table = docs.withColumn(self.key, F.xxhash64(*docs.columns))

    def decisions(self, made: DataFrame, name: str, value, having: str, row_bytes: int = KEY_BYTES) -> DataFrame:
        """One staged row of doc_id, key, number of rows and value for each doc_id and key of made whose value is so; {0} names the value."""
        each = made.groupBy(F.col("doc_id").alias(self.of), F.col(self.key).alias(self.of_key)).agg(F.count("*").alias(self.rows), value.alias(self.value))
        return small_side(staged(each.where(having.format(f"`{self.value}`")), name), row_bytes)

    def join(self, made: DataFrame, how: str) -> DataFrame:
        return self.table.join(made, self.table.doc_id.eqNullSafe(made[self.of]) & (self.table[self.key] == made[self.of_key]), how)

    def alone_and_one_of_equals(self, joined: DataFrame) -> DataFrame:
        """Equal rows share a decision: one of them stands for all."""
        n = F.col(self.rows)
        return joined.where(n == 1).unionByName(joined.where(n > 1).dropDuplicates(["doc_id", self.key]))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking rejects go."""
    rows = _Rows(docs)
    scores = quality_scores(rows.table, spark.read.parquet(f"{sf_dir}/labels.parquet"), key=rows.key)
    rejected = rows.decisions(scores.where("predicted = 0"), "rejected", F.min("predicted"), "{0} = 0")
    return rows.join(rejected, "left_anti").select(*rows.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near and exact copies stays, the one with the smallest doc_id.

    Texts without words link with nothing and all stay.
    """
    rows = _Rows(docs)
    classes = near_duplicates(rows.table, key=rows.key)
    # 0: goes; 1: the one that stays, or one of its equal rows; 2: has no words.
    stays = F.when(F.col("n_shingles") == 0, 2).when(F.col("kept"), 1).otherwise(0)
    touched = rows.decisions(classes, "decided", F.max(stays), f"{{0}} = 0 or {{0}} = 1 and `{rows.rows}` > 1")
    joined = rows.join(touched, "left")
    value = F.col(rows.value)
    again = joined.where(value == 1).dropDuplicates(["doc_id", rows.key])
    return joined.where(value.isNull()).unionByName(again).select(*rows.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; documents without any stay as they are."""
    rows = _Rows(docs)
    made = scan_secrets(rows.table, key=rows.key)
    found = rows.decisions(made.where(F.size("found") > 0), "found", F.first("found"), "{0} is not null", 4 * KEY_BYTES)
    spans, new = F.col(rows.value), F.col(rows.new)
    joined = rows.join(found, "left").withColumn(rows.new, F.when(spans.isNotNull(), redacted(F.col("text"), spans)).otherwise(F.col("text")))
    length = F.when(spans.isNotNull(), F.length(new).cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars"))
    return joined.withColumn("n_chars", length).withColumn("text", new).select(*rows.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out, so that the sources' words come near their targets."""
    rows = _Rows(docs)
    taken = rows.decisions(mix(rows.table, key=rows.key), "taken", F.sum("copies"), "{0} > 0")
    kept = rows.alone_and_one_of_equals(rows.join(taken, "inner"))
    return kept.withColumn(rows.new, F.explode(F.sequence(F.lit(1).cast("long"), F.col(rows.value)))).select(*rows.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 4096 tokens."""
    return pack(docs, vocab.public_path("word_bpe_49k.json"), length=4096, end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("minhash near-dedup", near_dedup),
    ("secret scan", secret_scan),
    ("source mix", source_mix),
    ("best-fit packing", best_fit_packing),
]

#: No stage's rows can be told by SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of sf_dir's documents. What a finished stage wrote besides its result is deleted."""
    docs, mark = spark.read.parquet(f"{sf_dir}/documents.parquet"), stage_mark()
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        clear_stages(spark, mark, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
