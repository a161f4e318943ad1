"""A corpus pipeline: quality rules, near duplicates, decontamination, mixing, token ids.

Each stage works on all that the one before kept. All but the last return the columns of ``documents``; the last gives
doc_id, start, n_tokens and ids_crc32 of every document of the mix, read from the token files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from popspark.llm import decontaminate, jaccard_join, mixing, quality, token_ids
from popspark.llm.common import new_path, table, written

#: Near duplicates share 80 % of their five-word shingles.
NEAR = jaccard_join.Params(n=5, num=80, den=100)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs, NEAR)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "token-ids")
    token_ids.write_ids(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_ids.read_index(spark, path)


STAGES = [("quality", drop_low_quality), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_benchmark_leaks), ("mixing", mix_sources), ("token_ids", write_token_ids)]

#: The robust estimates, near-duplicate components, mix and tokenizer can't be said in SQL. Tests hold the
#: groups, ids and counts that the stages give against brute force and the tokenizers library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
