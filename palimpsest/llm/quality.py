"""Quality classifier: zstandard dictionaries of good and of bad labelled text, and how much better one compresses a text.

A text is cut into blocks of BLOCK bytes, all of it; each block is compressed with either dictionary. The difference of
the compressed sizes, normalised by the bytes compressed, is above zero where the good dictionary fits better. Two
figures come of it (over the whole text, and of the block that looks worst), and a logistic regression on labelled
texts that no dictionary holds turns them, with the text's length, into a probability.

Learning takes a bounded sample: at most `per_class` labelled rows a class, in the order of a hash of their id, of
texts up to `longest` characters; half of them make the dictionaries and half the calibration. Scoring covers every
whole text, row by row, with no shuffle.

Defined results: a null text scores as an empty one, which has a score too (what the length alone says); labels other
than 0 and 1 are not learned; with fewer than two learnable texts of either class every score is the share of good labels,
or 0.5 if there are none; very long texts are scored whole, block by block; repeated rows get equal scores; other columns pass through untouched, one of the result's name is
replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import map_batches
from palimpsest.session import table

BLOCK, LEVEL, DICTIONARY_BYTES = 512, 3, 112_640


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    prior: float


def _compressors(model: QualityModel) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
    made = []
    for content in (model.good, model.bad):
        dictionary = zstandard.ZstdCompressionDict(content)
        dictionary.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False))
    return tuple(made)


def features(text: bytes, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> tuple[float, ...]:
    total, worst = 0, 1.0
    for start in range(0, len(text), BLOCK):
        block = text[start : start + BLOCK]
        more = len(bad.compress(block)) - len(good.compress(block))
        total += more
        worst = min(worst, more / max(len(block), BLOCK / 2))
    size = len(text)
    return (1.0, total / max(1, size), worst if size else 0.0, 1 / (1 + size / 64), total / (size + BLOCK))


def _logistic(rows: np.ndarray, labels: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    weights = np.zeros(rows.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(rows @ weights, -30, 30)))
        slope = rows.T @ (p - labels) + ridge * weights
        curve = (rows * (p * (1 - p) + 1e-9)[:, None]).T @ rows + ridge * np.eye(len(weights))
        weights -= np.linalg.solve(curve, slope)
    return weights


def fit_quality(labelled: DataFrame, docs: DataFrame, per_class: int = 2000, longest: int = 32_768) -> QualityModel:
    """labelled(doc_id, quality): the rows that may be learned from; docs(doc_id, text): where their texts are."""
    known = labelled.filter("quality in (0, 1) and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("quality"))
    drawn = None
    for quality in (0, 1):
        some = known.filter(F.col("quality") == quality).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        drawn = some if drawn is None else drawn.unionByName(some)
    texts = docs.filter(F.length("text").between(1, longest)).select("doc_id", "text")
    rows = texts.join(F.broadcast(drawn), "doc_id").orderBy(F.xxhash64("doc_id"), "text").limit(2 * per_class).collect()  # 2 * per_class ids at most
    by = {q: [r.text.encode() for r in rows if r.quality == q] for q in (0, 1)}
    prior = len(by[1]) / len(rows) if rows else 0.5
    if min(map(len, by.values())) < 2:  # one text for the dictionary, one for the calibration
        return QualityModel(b"", b"", (), prior)
    made = {}
    for q, texts_of in by.items():
        blocks = [t[i : i + BLOCK] for t in texts_of[::2] for i in range(0, len(t), BLOCK)]
        try:
            made[q] = zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, blocks)) // 8)), blocks).as_bytes()
        except zstandard.ZstdError:  # too few or too short: the text itself serves as a dictionary
            made[q] = b"".join(blocks)[-DICTIONARY_BYTES:]
    model = QualityModel(made[1], made[0], (), prior)
    good, bad = _compressors(model)
    held = [(features(t, good, bad), q) for q in (0, 1) for t in by[q][1::2]]
    labels = np.array([q for _, q in held], float)
    weights = _logistic(np.array([x for x, _ in held]), labels)
    share = known.agg(F.avg("quality")).first()[0]  # the sample is balanced, the labels need not be
    drawn_share = labels.mean()
    weights[0] += np.log(share / (1 - share)) - np.log(drawn_share / (1 - drawn_share))
    return QualityModel(made[1], made[0], tuple(weights), prior)


def score_quality(docs: DataFrame, model: QualityModel, name: str = "score") -> DataFrame:
    """docs with the probability of label 1 as column `name`; the texts go to Python, nothing is shuffled."""
    docs = docs.drop(name)
    columns = docs.columns
    if not model.weights:
        return docs.withColumn(name, F.lit(float(model.prior)))
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    at = columns.index("text")

    def scored(batch: pa.RecordBatch) -> pa.RecordBatch:
        tools = _compressors(model)
        weights = np.array(model.weights)
        rows = np.array([features((t or "").encode("utf-8", "surrogatepass"), *tools) for t in batch.column(at).to_pylist()])
        p = 1 / (1 + np.exp(-np.clip(rows @ weights, -30, 30)))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*columns, name])

    return map_batches(docs, scored, schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality; rows whose crc32(doc_id as text) mod 3 is 1 are held out of learning."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    labelled = table(spark, sf_dir, "labels").filter(~held).select("doc_id", "quality")
    scored = score_quality(docs, fit_quality(labelled, docs))
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
