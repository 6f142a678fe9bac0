"""The corpus pipeline: documents through five stages, each a table in the shared folder that the next one reads.

quality       documents that the compression classifier gives less than 0.5 go
language      documents go that have no letter, or that no learned language codes in fewer than 8 bits a byte
near_dup      of each group of near-duplicates (five-word shingles, 80 percent) the least doc_id stays
decontaminate documents that hold a benchmark item go
pack          what is left, cut and packed into sequences of 2048 tokens

Defined results: null texts count as empty; an empty text has a quality score and, having no letter, goes at the second
stage; rows of a null doc_id are judged like others, but are no one's near-duplicate; repeated rows of one doc_id are
one document from the third stage on; further columns pass through all but the last stage; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import written
from palimpsest.llm.decontaminate import without_leaks
from palimpsest.llm.language_id import UND, fit_languages, identify
from palimpsest.llm.near_dup import without_near_duplicates
from palimpsest.llm.packing import pack
from palimpsest.llm.quality import fit_quality, score_quality
from palimpsest.session import table


def _free(docs: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, made longer where docs has such columns."""
    return tuple(n + "_" * (1 + max((len(c) for c in docs.columns if c.lower().startswith(n)), default=-1)) for n in names)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labelled = table(spark, sf_dir, "labels").filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    (score,) = _free(docs, "score")
    return score_quality(docs, fit_quality(labelled, docs), score).filter(F.col(score) >= 0.5).select(docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    known = docs.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).select("doc_id", "text", "lang")
    found, score, bits = _free(docs, "lang_pred", "score", "bits_per_byte")
    told = identify(docs, fit_languages(known), (found, score, bits))
    return told.filter((F.col(found) != UND) & (F.col(bits) < 8)).select(docs.columns)


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [("quality", quality), ("language", language), ("near_dup", near_dup), ("decontaminate", decontaminate), ("pack", packed)]
#: SQL can't express these stages; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
