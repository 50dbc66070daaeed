"""From raw documents to packed sequences: the stages of a corpus, in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import contamination, jaccard, queries, substring_automaton, toxicity
from tidemark.shared import stage

#: Near duplicates: five-word shingles, a Jaccard similarity of 0.8.
NEAR = jaccard.Rule(k=5, share=80, over=100)
#: Words of a span that may not be in two places.
SPAN_WORDS = 20


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold of their language."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.reject_toxic(docs, toxicity.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates."""
    return jaccard.without_near_duplicates(docs, NEAR)


def cut_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the spans that occur earlier."""
    return substring_automaton.without_repeated_spans(docs, SPAN_WORDS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item, with up to a fifth of its words edited."""
    return contamination.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    return queries.pack(docs)


#: (name, function) in order; a function takes (spark, docs, sf_dir).
STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("substring_dedup", cut_repeated_spans),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack),
]
#: No SQL can score, embed or tokenize; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on all documents; what each returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
