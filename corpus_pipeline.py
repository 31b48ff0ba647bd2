"""From raw documents to token ids: the stages, each over all that the one before it kept."""

from __future__ import annotations

from typing import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import bpe, decontaminate, language_id, ngram_join, suffix_dedup
from pagemill.llm.common import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Strings that stand in the corpus once: the bytes of some 40 words.
REPEATED_BYTES = 256


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; those without a letter or far from all languages go.

    Null and empty texts go; very long ones are read whole; repeated rows are judged alike and all stay or go. Rows with
    a null `lang` teach nothing. With no labelled row, and on an empty table, nothing stays.
    """
    return language_id.known(docs, language_id.fit(docs))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of near copies; an id may have several texts.

    Null, empty and wordless texts are near nothing and stay, exact repeats of a row (id and text) as one; rows with a null
    id all stay. Very long texts count whole. An empty table gives an empty one.
    """
    return ngram_join.one_of_each_group(docs)


def first_of_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the long strings that an earlier place has; the documents themselves all stay.

    Null texts stay null, empty ones empty; very long texts are cut whole, with strings inside them too. Null ids come
    first; rows that repeat id and text count as one place and all stay. An empty table gives an empty one.
    """
    cut = suffix_dedup.without_repeats(docs, REPEATED_BYTES, keep="first")
    return cut.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast("bigint")).select(*docs.columns)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word in a benchmark window.

    Null and empty texts have no word and stay; very long ones are scanned whole; repeated rows all stay or all go. An
    empty table of documents or of items takes nothing away.
    """
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """`doc_id`, `lang`, `source`, the text's token `ids`, `n_tokens`, and the digest of what the ids decode to.

    Null and empty texts have no ids; very long ones are encoded whole; repeated rows are rows each. Other columns are
    left out. An empty table gives an empty one.
    """
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = docs.select("doc_id", "lang", "source", "text")
    both = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    n_tokens = F.size("ids").cast("bigint").alias("n_tokens")
    return both.select("doc_id", "lang", "source", "ids", n_tokens, F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("language", known_language),
    ("near_copies", one_of_near_copies),
    ("repeats", first_of_repeats),
    ("benchmark", benchmark_free),
    ("token_ids", token_ids),
]

#: Training, components of links, suffix order and byte pair merges are beyond SQL; tests hold the stages against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
