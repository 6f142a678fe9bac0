"""Importance resampling towards a target: word n-grams hashed by CRC into buckets, gains of the buckets, and a weighted draw.

1. One pass counts the hash buckets of all n-grams of the documents and, on its own, of the target's texts. A task turns
   a few megabytes of texts at a time into their distinct n-grams, lays those of equal length as rows of a byte matrix
   and updates the CRCs of all rows column by column; the results are scattered back to where the n-grams stand.
   Only sums of `buckets` numbers leave a task.
2. A bucket's gain is the logarithm of its smoothed share in the target over that in the documents; there are as many
   gains as buckets, whatever the corpus, and they go to the tasks of a second pass, which averages them by document.
3. A score is that weight plus Gumbel noise from the document's id, so the highest scores are a draw without
   replacement. Ranks come from a range-partitioned sort, whose partitions are counted; no task holds all scores.

Defined results: a null or empty text has no words and a weight of 0; a null doc_id has a null score and takes no part
in the draw, nor in the number of documents that the share is taken of; repeated rows are documents of their own, ties
in score and doc_id go to the one with fewer features; a word of any length is one word; an empty target leaves only
the documents' side of the gains; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import sliced_by_bytes, written
from palimpsest.session import numbered, table

BUCKETS = 10_000
#: Bytes of text that are turned into features at a time.
SLICE = 4 << 20
#: Features of more bytes have no matrix: zlib takes them one at a time.
LONGEST = 256

_WORD = np.zeros(256, bool)
_WORD[ord("0") : ord("9") + 1] = _WORD[ord("a") : ord("z") + 1] = _WORD[128:] = True


def _crc_table() -> np.ndarray:
    """What one byte does to a CRC-32, by the reflected polynomial."""
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(0xEDB88320), crc >> 1).astype(np.uint32)
    return crc


_CRC = _crc_table()


def updated(crc: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CRC registers after the bytes data[start : start + length] of each row: rows of one length are laid as a matrix and updated column by column."""
    out, clipped = np.empty(len(crc), np.uint32), np.minimum(lengths, LONGEST + 1).astype(np.uint16)
    order = np.argsort(clipped, kind="stable")
    edges = np.concatenate([[0], np.cumsum(np.bincount(clipped, minlength=LONGEST + 2))])
    for size in np.flatnonzero(np.diff(edges)):
        rows = order[edges[size] : edges[size + 1]]
        if size > LONGEST:
            for row in rows:
                out[row] = ~np.uint32(zlib.crc32(data[starts[row] : starts[row] + lengths[row]].data, int(~crc[row])))
            continue
        now, first = crc[rows], starts[rows]
        matrix = data[first + np.arange(size, dtype=first.dtype)[:, None]]  # transposed: what one update reads lies together
        for column in matrix:
            now = _CRC[(now ^ column) & 0xFF] ^ (now >> 8)
        out[rows] = now
    return out


def hashed_features(texts: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the words and of the pairs of words of all texts, text after text, and where each text's begin (one more entry than texts)."""
    data = np.frombuffer(b" ".join([b"", *texts, b""]).lower(), np.uint8)  # bytes.lower() is A-Z only
    mask = _WORD[data]
    begins, ends = np.flatnonzero(~mask[:-1] & mask[1:]) + 1, np.flatnonzero(mask[:-1] & ~mask[1:]) + 1
    edges = np.searchsorted(begins, np.cumsum([1] + [len(t) + 1 for t in texts]))
    lengths = ends - begins
    kept = np.ascontiguousarray(data[mask])
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(kept)]).dictionary_encode()
    number = words.indices.to_numpy()
    kinds = words.dictionary
    places = np.frombuffer(kinds.buffers()[1], np.int32)[kinds.offset : kinds.offset + len(kinds) + 1]
    sizes, places = np.diff(places), places[:-1]
    source = np.frombuffer(kinds.buffers()[2], np.uint8) if len(kinds) else np.zeros(0, np.uint8)
    state = updated(np.full(len(kinds), 0xFFFFFFFF, np.uint32), source, places, sizes)
    one = (~state % np.uint32(buckets)).astype(np.int32)[number]
    inside = np.ones(max(0, len(number) - 1), bool)
    inside[edges[1:-1][(edges[1:-1] > 0) & (edges[1:-1] < len(number))] - 1] = False  # no pair over the end of a text
    at = np.flatnonzero(inside)
    pairs = pa.array(number[at].astype(np.int64) * max(1, len(kinds)) + number[at + 1]).dictionary_encode()
    left, right = np.divmod(pairs.dictionary.to_numpy(), max(1, len(kinds)))
    spaced = _CRC[(state ^ 0x20) & 0xFF] ^ (state >> 8)  # a pair goes on where its first word and a space have led
    two = updated(spaced[left], source, places[right], sizes[right])
    return one, edges, (~two % np.uint32(buckets)).astype(np.int32)[pairs.indices.to_numpy()], np.searchsorted(at, edges)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of texts(text) each bucket has: sums of tasks, as many numbers as buckets."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for part in sliced_by_bytes(batches, "text", SLICE):
            one, _, two, _ = hashed_features([(t or "").encode() for t in part.column("text").to_pylist()], buckets)
            sums += np.bincount(one, minlength=buckets) + np.bincount(two, minlength=buckets)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some), "n": pa.array(sums[some])})

    out = np.zeros(buckets, np.int64)
    for r in texts.select("text").mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # `buckets` rows at most
        out[r.bucket] = r.n
    return out


@dataclass(frozen=True)
class Gains:
    """A whole number for each bucket: 1000 times the logarithm of how much likelier the target is to hold it."""

    of: np.ndarray

    @classmethod
    def fit(cls, docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> Gains:
        s, t = (bucket_counts(x, buckets).astype(np.float64) for x in (docs, target))
        return cls(np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64))


def weighed(docs: DataFrame, gains: Gains) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean of the gains of a document's features."""
    of = gains.of

    def summed(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(of[values])])[edges])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced_by_bytes(batches, "text", SLICE):
            one, at_one, two, at_two = hashed_features([(t or "").encode() for t in part.column("text").to_pylist()], len(of))
            words, n = np.diff(at_one), np.diff(at_one) + np.diff(at_two)
            weight = (summed(one, at_one) + summed(two, at_two)) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, (words, n, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, n_words long, n_features long, weight long")


def resampled(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): all of docs(doc_id, text); the drawn ones, `percent` in a hundred of those with enough words, have a rank from 1 on."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / float(1 << 32)))).cast("long")
    scored = written(weighed(docs, Gains.fit(docs, target, buckets)).withColumn("score", F.col("weight") + noise), "scored")
    may = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    drawn = scored.filter(may).count() * percent // 100
    ranked = numbered(scored.filter(may).orderBy(F.desc("score"), "doc_id", "n_features"), "place")
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    out = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*out, rank.alias("rank")).unionByName(scored.filter(~may).select(*out, F.lit(None).cast("long").alias("rank")))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents, drawn towards the benchmark's texts."""
    return resampled(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))


_AZ = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SQL = f"""
WITH RECURSIVE t AS (
  SELECT row_number() OVER () AS r, doc_id, kind, regexp_extract_all(translate(coalesce(text, ''), '{_AZ[0]}', '{_AZ[1]}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM (SELECT doc_id, text, 0 AS kind FROM documents UNION ALL SELECT NULL, text, 1 FROM benchmark)
), f AS (SELECT r, kind, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM t),
d AS (SELECT row_number() OVER () AS k, f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM f)),
b(i, c, n) AS (SELECT CAST(range AS BIGINT), CAST(range AS BIGINT), 0 FROM range(256) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n + 1 FROM b WHERE n < 8),
one AS (SELECT i, c FROM b WHERE n = 8),
crc(k, x, c) AS (SELECT k, x, CAST(4294967295 AS BIGINT) FROM d UNION ALL SELECT crc.k, substr(x, 3), xor(crc.c >> 8, one.c) FROM crc JOIN one ON one.i = xor(crc.c & 255, CAST('0x' || substr(x, 1, 2) AS BIGINT)) WHERE x <> ''),
h AS (SELECT f, xor(c, 4294967295) % 10000 AS bucket FROM crc JOIN d USING (k) WHERE crc.x = ''),
g AS (SELECT r, kind, bucket FROM f JOIN h USING (f)),
s AS (SELECT bucket, count(*) FILTER (WHERE kind = 0) AS s, count(*) FILTER (WHERE kind = 1) AS t FROM g GROUP BY 1),
gain AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM s) + 10000)::DOUBLE))) AS gain FROM s),
w AS (SELECT r, count(*) AS n, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM g JOIN gain USING (bucket) WHERE kind = 0 GROUP BY 1),
v AS (SELECT t.doc_id, len(t.w) AS words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
  CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || t.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM t LEFT JOIN w USING (r) WHERE kind = 0),
p AS (SELECT doc_id, n_features, weight, score, row_number() OVER (ORDER BY score DESC, doc_id, n_features) AS place, count(*) OVER () AS n FROM v WHERE words >= 20 AND doc_id IS NOT NULL)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank FROM p
UNION ALL SELECT doc_id, n_features, weight, score, NULL FROM v WHERE NOT (words >= 20 AND doc_id IS NOT NULL)
"""
