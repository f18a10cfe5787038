"""A corpus pipeline: quality, near duplicates, benchmark leaks, source mix, token files.

Every stage reads what the last one kept, written as Parquet. All but the last return the columns of
`documents`; the last returns what the token files hold. Null and empty texts pass the first stages
(nothing speaks against them; of several, one stays) and end as documents of the end id alone.
"""

from pyspark.sql import DataFrame, SparkSession

from quillgrid.llm import common, decontaminate, mixing, nearjoin, quality, tokens
from quillgrid.llm.queries import table, tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each class of near duplicates."""
    return nearjoin.keep_first(docs)


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    return mixing.resample(docs, weights=(3, 1, 2), scale=1.5, cap=2)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every copy in the token files."""
    return tokens.token_output(docs, tokenizer_path())


STAGES = [("quality", quality_stage), ("near_duplicates", near_stage), ("decontamination", leak_stage), ("mix", mix_stage), ("tokens", token_stage)]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to `documents`."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.cut(docs, f"pipeline-{name}")
    return docs
