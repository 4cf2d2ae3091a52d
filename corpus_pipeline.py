"""From raw documents to token ids: classify, de-duplicate, mix, encode.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor
kept; ``run`` writes each stage's result as Parquet to the session's shared
folder and reads it again, so a lost executor repeats one stage at most. All
stages but the last return the columns they were given, extra ones included.

Defined cases, besides those of the operators: an empty table passes through
every stage; a row with a null id is classified, never taken for a duplicate,
mixed and encoded; rows that repeat an id are documents of their own, so each
is kept or not by its own text and played as often as the mix plays it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transitlake.llm import bpe, catalog, minhash, mixing, quality_model, suffixes
from transitlake.llm.common import crc_mod, cut, prepare, scratch, table

TOKENIZER = "word_bpe_49k.json"
LEAST_SCORE = 0.5


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores ``LEAST_SCORE`` or more."""
    prepare(spark)
    labels = table(spark, sf_dir, "labels").filter(crc_mod("doc_id", 3) != 1)
    weights = quality_model.fit(docs, labels)
    scored = quality_model.score(docs, weights, keep=[c for c in docs.columns if c != "doc_id"], score_col="_score")
    return scored.filter(F.col("_score") >= LEAST_SCORE).select(*docs.columns)


def _repeat(docs: DataFrame, *columns: str) -> bool:
    return not docs.groupBy(*columns).count().filter("count > 1").isEmpty()


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every near-duplicate group (five-word shingles, similarity 0.8)."""
    prepare(spark)
    rows, key = docs, "doc_id"
    if _repeat(docs.filter("doc_id IS NOT NULL"), "doc_id"):
        # Row numbers in order of id stand for ids that repeat.
        text = F.xxhash64("text")
        rows, key = docs.repartitionByRange("doc_id", text).sortWithinPartitions("doc_id", text), "_row"
        rows = cut(rows.withColumn(key, F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())))
    gone = minhash.groups(rows, id_col=key).filter("NOT kept").select(F.col("doc_id").alias(key))
    return rows.join(gone, key, "left_anti").select(*docs.columns)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that an earlier document holds."""
    prepare(spark)
    out = suffixes.without(docs, suffixes.repeats(docs))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix plays them."""
    prepare(spark)
    again = F.explode(F.array_repeat(F.lit(0), F.col("_times")))
    if _repeat(docs, "doc_id", "source"):
        rows = cut(docs.withColumn("_row", F.monotonically_increasing_id()))
        plays = mixing.mix(rows, keep=["_row"]).filter("times > 0").select("_row", F.col("times").alias("_times"))
        return rows.join(plays, "_row").select(*docs.columns, again.alias("_play")).select(*docs.columns)
    plays = mixing.mix(docs, keep=["source"]).filter("times > 0").select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("times").alias("_times"))
    same = docs["doc_id"].eqNullSafe(plays["_id"]) & docs["source"].eqNullSafe(plays["_source"])
    return docs.join(plays, same).select(*docs.columns, again.alias("_play")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document with digests of ids and decoded text."""
    prepare(spark)
    return bpe.encode(docs, catalog.tokenizer(TOKENIZER), decoded=False)


STAGES = [
    ("quality_classifier", classify),
    ("minhash_near_dedup", near_dedup),
    ("suffix_array_dedup", cut_passages),
    ("source_mix", mix_sources),
    ("bpe_encode", encode),
]

#: No SQL form: the classifier's weights and the tokenizer's merges are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    path = scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
