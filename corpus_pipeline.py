"""From raw documents to token ids: five stages, each working on all that the one before kept.

1. quality rules: documents that the word rules or the perplexity bands reject go;
2. exact dedup: of equal texts the row with the smallest id stays;
3. n-gram Jaccard join: one document of each group of near copies stays (five words, similarity 0.8);
4. mixing: documents are dropped or repeated (up to three times) until each source has its target share;
5. BPE: every row becomes token ids, with a digest of its decoded text.

Between stages the rows are Parquet in the shared folder. Null and empty texts fail the first stage. Extra columns are carried
to the fourth stage's result. An empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from clipmill.llm import bpe, exact_dedup, jaccard_join, mixing, quality
from clipmill.session import stored

#: Near copies share at least 0.8 of their five-word shingles.
NEAR_COPIES = jaccard_join.Rule(size=5, num=80, den=100)
TOKENIZER = str(public_tokenizers.path("word_bpe_49k.json"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str, rule: jaccard_join.Rule = NEAR_COPIES) -> DataFrame:
    return jaccard_join.keep_one(docs, rule=rule)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(docs, TOKENIZER, with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_copies),
    ("ngram_jaccard_join", near_copies),
    ("mix_sources", mix_sources),
    ("bpe_encode_decode", token_ids),
]

#: The perplexity model and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
