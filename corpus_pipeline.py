"""The corpus pipeline: documents to token ids, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pcq.llm import decontaminate, idfiles, langid, mixing, nearcopies
from pcq.llm.common import Scratch, table
from pcq.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows (operator 9)."""
    return langid.keep_known(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (operator 5): shingles of five words, similarity 0.8 or more."""
    return nearcopies.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark (operator 4)."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights (operator 8): a document comes as often as it is taken."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in range-coded files, read back (operator 6): doc_id, start, n_tokens, ids_crc32."""
    path = f"{Scratch(spark, 'corpus').root}/ids"
    idfiles.write(docs, path, tokenizer_path())
    return idfiles.digest(idfiles.read(spark, path))


STAGES = [("language ID", language), ("near copies", near_copies), ("benchmark", benchmark), ("mixture", mixture), ("token ids", token_ids)]

#: Language models, SimHash and tokenizers are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tmp = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = tmp.save(stage(spark, docs, sf_dir), f"stage{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
