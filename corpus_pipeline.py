"""A corpus pipeline: from raw documents to a weighted mix without toxic, near-duplicate, contaminated or personal text.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of documents, whatever these are.

* toxicity drops documents that the classifier rejects (probability of label 1
  of 0.5 or more). It is fitted on the labelled documents among docs.
* near-duplicates keeps one row of each group of linked ones: of the smallest
  id, and of rows that share it the one of the least hash. Rows that share an id
  are documents of their own: each is kept or dropped with its own group. Rows
  with a null id belong to no group and stay, as do rows without a word.
* decontamination drops documents that contain a benchmark item.
* pii replaces personal data in the texts by its kind in brackets.
* mixing tells how often each document is taken to meet its source's target.

Null and empty texts pass every stage. Texts are read whole, however long.
Columns that docs has beside those of documents pass all stages but the last,
whatever their names. An empty table stays empty; without labels or benchmark
items nothing is dropped by them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm import decontamination, mixing, ngram_join, pii, toxicity
from quirework.llm.store import Scratch, released


def _unused(docs: DataFrame, name: str) -> str:
    """name, or a longer one if docs has such a column."""
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs.select("doc_id", "text"), labels)
    score = _unused(docs, "toxicity")
    return toxicity.score(docs, model, out_col=score).filter(F.col(score) < 0.5).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key, other = _unused(docs, "row_key"), _unused(docs, "other_key")
    of_row = ngram_join.row_key(docs)
    groups = ngram_join.join(docs.select("doc_id", "text"), key=of_row)
    gone = groups.filter("NOT is_first").select(F.col("key").alias(other)).distinct()
    kept = docs.withColumn(key, of_row).join(gone, F.col(key) == F.col(other), "left_anti")
    copies = groups.filter("is_first AND n_shingles > 0").groupBy("key").count().filter("count > 1").select(F.col("key").alias(other))
    if copies.isEmpty():
        return kept.drop(key)
    # Rows equal in id and text share their key; of such a group one row stays.
    alone = kept.join(copies, F.col(key) == F.col(other), "left_anti")
    several = kept.join(copies, F.col(key) == F.col(other), "left_semi")
    return alone.union(several.dropDuplicates([key])).drop(key)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.find(docs, redacted=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact),
    ("mixing", mix_sources),
]

#: The first stage is a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents, each written as Parquet and read again by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        with released():
            docs = scratch.write(stage(spark, docs, sf_dir), f"{i}-{name}")
        if i:
            scratch.drop(f"{i - 1}-{STAGES[i - 1][0]}")
    return docs
