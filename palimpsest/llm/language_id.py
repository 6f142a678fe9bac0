"""Language identification by partial matching: variable-order byte contexts of each language, under frozen statistics.

Each language has a tree of the byte contexts (up to ORDER bytes) of its learning texts. A byte's code length is
-log2 of its share under the longest known context, or, where that context never saw the byte, of the escape share and
then of the byte under the next shorter context, down to a flat 1/256 (escape method C, no exclusion). A text's code
length in a language is the exact sum over all its bytes; the shortest wins.

The trees of all languages are laid out together: for each (context, byte) that any language saw there is one row of
finished code lengths, a column a language, so that a text costs one table lookup a byte and a few more where no
language saw the byte. Learning takes a bounded sample: at most `per_language` texts a language, in the order of a
hash of their id, of up to `longest` characters. Scoring covers every whole text, with no shuffle.

Defined results: a text that is null or has no letter is `und` with score 0 and no code length; with no learnable row
at all every text is `und`; equal code lengths go to the first language by name; repeated rows get equal results;
columns of other names pass through, and columns of the results' names are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import map_batches
from palimpsest.session import table

ORDER = 4
SEGMENT = 1 << 19
#: Neighbouring bytes tell much the same; this share of the bits counts as independent evidence in the score.
EVIDENCE = 0.1
UND = "und"


class KeyTable:
    """Row numbers by 64-bit key, open addressing, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(10, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        size = 1 << self.bits
        self.keys, self.rows = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        left, slot = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(left):
            at = slot & (size - 1)
            free = self.rows[at] < 0
            won = np.zeros(len(left), bool)
            first = np.unique(at[free], return_index=True)[1]
            won[np.flatnonzero(free)[first]] = True
            self.rows[at[won]], self.keys[at[won]] = left[won], keys[left[won]]
            left, slot = left[~won], slot[~won] + 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where there is none."""
        slot = self._slot(keys)
        found = self.rows[slot]
        wrong = np.flatnonzero((found >= 0) & (self.keys[slot] != keys))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & ((1 << self.bits) - 1)
            found[wrong] = self.rows[slot[wrong]]
            wrong = wrong[(found[wrong] >= 0) & (self.keys[slot[wrong]] != keys[wrong])]
        return found


@dataclass
class LanguageModel:
    languages: list[str]
    grams: list[np.ndarray] = field(default_factory=list)  # by order: keys of context and byte
    lengths: list[np.ndarray] = field(default_factory=list)  # their code lengths, a column a language
    contexts: list[np.ndarray] = field(default_factory=list)  # by order: keys of contexts
    escapes: list[np.ndarray] = field(default_factory=list)

    def tables(self) -> tuple[list[KeyTable], list[KeyTable]]:
        return [KeyTable(k) for k in self.grams], [KeyTable(k) for k in self.contexts]


def _mask(n_bytes: int) -> np.uint64:
    return np.uint64((1 << (8 * n_bytes)) - 1)


def _padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one array, ORDER zero bytes before each; their first and last positions."""
    pad = bytes(ORDER)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes + ORDER)
    return np.frombuffer(b"".join(x for t in texts for x in (pad, t)), np.uint8), ends - sizes, ends


def _keys(data: np.ndarray) -> np.ndarray:
    """At each place the last ORDER + 1 bytes, the latest lowest."""
    keys = data.astype(np.uint64)
    for back in range(1, ORDER + 1):
        keys[back:] |= data[: len(data) - back].astype(np.uint64) << np.uint64(8 * back)
    return keys


def train(texts: dict[str, list[bytes]], least: int = 2) -> LanguageModel:
    """The joint tables of the languages' trees; a context of full ORDER needs `least` occurrences in a language to be kept."""
    languages = sorted(texts)
    model, seen = LanguageModel(languages), []
    for name in languages:
        data, starts, ends = _padded(texts[name])
        inside = np.concatenate([np.arange(a, b) for a, b in zip(starts, ends)]) if len(starts) else np.zeros(0, np.int64)
        seen.append(_keys(data)[inside])
    for order in range(ORDER + 1):
        counts = []
        for keys in seen:
            grams, n = np.unique(keys & _mask(order + 1), return_counts=True)
            context, inverse = np.unique(grams >> np.uint64(8), return_inverse=True)
            total = np.bincount(inverse, n, len(context))
            distinct = np.bincount(inverse, minlength=len(context))
            if order > 1:
                keep = total >= least
                gram_keep = keep[inverse]
                inverse = (np.cumsum(keep) - 1)[inverse[gram_keep]]
                grams, n, context, total, distinct = grams[gram_keep], n[gram_keep], context[keep], total[keep], distinct[keep]
            counts.append((grams, n, inverse, context, total, distinct))
        all_grams = np.unique(np.concatenate([c[0] for c in counts]))
        all_contexts = np.unique(np.concatenate([c[3] for c in counts]))
        escapes = np.zeros((len(all_contexts), len(languages)), np.float32)
        for col, (_, _, _, context, total, distinct) in enumerate(counts):
            escapes[np.searchsorted(all_contexts, context), col] = -np.log2(distinct / (total + distinct))
        if order:
            shorter = _lengths_below(model, all_grams, order - 1)
        else:
            shorter = np.full((len(all_grams), len(languages)), 8, np.float32)
        lengths = shorter + escapes[np.searchsorted(all_contexts, all_grams >> np.uint64(8))]
        for col, (grams, n, inverse, _, total, distinct) in enumerate(counts):
            lengths[np.searchsorted(all_grams, grams), col] = -np.log2(n / (total + distinct)[inverse])
        for part, value in ((model.grams, all_grams), (model.lengths, lengths), (model.contexts, all_contexts), (model.escapes, escapes)):
            part.append(value)
    return model


def _lengths_below(model: LanguageModel, keys: np.ndarray, order: int) -> np.ndarray:
    """Code lengths of the keys' last bytes under contexts of `order` bytes at most (exact, by sorted search)."""
    out = np.zeros((len(keys), len(model.languages)), np.float32)
    left = np.arange(len(keys))
    for k in range(order, -1, -1):
        gram = keys[left] & _mask(k + 1)
        at = np.minimum(np.searchsorted(model.grams[k], gram), len(model.grams[k]) - 1)
        hit = model.grams[k][at] == gram
        out[left[hit]] += model.lengths[k][at[hit]]
        left, context = left[~hit], gram[~hit] >> np.uint64(8)
        at = np.minimum(np.searchsorted(model.contexts[k], context), len(model.contexts[k]) - 1)
        known = model.contexts[k][at] == context
        out[left[known]] += model.escapes[k][at[known]]
    out[left] += 8
    return out


def code_lengths(model: LanguageModel, tables: tuple[list[KeyTable], list[KeyTable]], texts: list[bytes]) -> np.ndarray:
    """Bits of each whole text in each language."""
    data, starts, ends = _padded(texts)
    bits = np.zeros((len(texts), len(model.languages)))
    grams, contexts = tables
    for begin in range(0, len(data), SEGMENT):
        end = min(begin + SEGMENT, len(data))
        back = max(0, begin - ORDER)
        keys = _keys(data[back:end])[begin - back :]
        row = grams[ORDER].find(keys)
        cost = model.lengths[ORDER][row]
        left = np.flatnonzero(row < 0)
        cost[left] = 0
        for k in range(ORDER, -1, -1):
            if k < ORDER:
                row = grams[k].find(keys[left] & _mask(k + 1))
                hit = row >= 0
                cost[left[hit]] += model.lengths[k][row[hit]]
                left = left[~hit]
            if not len(left):
                break
            row = contexts[k].find((keys[left] & _mask(k + 1)) >> np.uint64(8))
            known = row >= 0
            cost[left[known]] += model.escapes[k][row[known]]
        cost[left] += 8
        first, last = np.searchsorted(ends, begin, "right"), np.searchsorted(starts, end, "left")
        if first < last:
            a, b = np.maximum(starts[first:last], begin), np.minimum(ends[first:last], end)
            some = np.flatnonzero(b > a)
            if len(some):
                edges = np.stack([a[some], b[some]], 1).ravel() - begin
                padded = np.concatenate([cost, np.zeros((1, cost.shape[1]), np.float32)])
                bits[first + some] += np.add.reduceat(padded, edges, axis=0, dtype=np.float64)[::2]
    return bits


def fit_languages(known: DataFrame, per_language: int = 500, longest: int = 16_384) -> LanguageModel:
    """known(doc_id, text, lang): the rows that may be learned from.

    One count of the languages (no text is read for it) bounds the hashes that each language's sample lies under, so the
    texts are read once, whatever the number of languages.
    """
    known = known.filter(F.col("lang").isNotNull()).withColumn("h", F.xxhash64("doc_id"))
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not sizes:
        return LanguageModel([])
    wanted = per_language + 6 * int(per_language**0.5) + 6
    bounds = [x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(int((1 << 64) * min(1.0, wanted / n)) - (1 << 63) - (n <= wanted)).cast("long"))]
    sound = known.filter("text is not null and text <> ''").select("lang", "h", F.substring("text", 1, longest).alias("text"))
    under = sound.filter(F.col("h") <= F.element_at(F.create_map(*bounds), F.col("lang")))
    texts = _by_language(under.dropDuplicates(["lang", "h"]).collect(), per_language)
    for lang in sizes.keys() - texts.keys():  # its few texts lie above the bound
        texts |= _by_language(sound.filter(F.col("lang") == lang).orderBy("h").limit(per_language).collect(), per_language)
    return train(texts) if texts else LanguageModel([])


def _by_language(rows: list, most: int) -> dict[str, list[bytes]]:
    texts: dict[str, list[bytes]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.h)):
        own = texts.setdefault(r.lang, [])
        if len(own) < most:
            own.append(r.text.encode("utf-8", "surrogatepass"))
    return texts


def identify(docs: DataFrame, model: LanguageModel, outs: tuple[str, str, str] = ("lang_pred", "score", "bits_per_byte")) -> DataFrame:
    """docs with the language found, a score (0 to 1) and the bits a byte takes in that language, in columns named by outs."""
    docs = docs.drop(*outs)
    names, at = docs.columns, docs.columns.index("text")
    added = [T.StructField(n, kind) for n, kind in zip(outs, (T.StringType(), T.DoubleType(), T.DoubleType()))]
    if not model.languages:
        return docs.withColumns(dict(zip(outs, (F.lit(UND), F.lit(0.0), F.lit(None).cast("double")))))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def found(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        tables = getattr(model, "built", None)
        if tables is None:
            tables = model.built = model.tables()
        plain = batch.column(at).to_pylist()
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in plain]
        bits = code_lengths(model, tables, texts)
        best = bits.argmin(1)
        least = bits[np.arange(len(bits)), best]
        score = 1 / np.exp((least[:, None] - bits) * (np.log(2) * EVIDENCE)).sum(1)
        worded = np.array([any(map(str.isalpha, t)) if t else False for t in plain], bool)
        pred = np.where(worded, np.array(model.languages, object)[best], UND)
        rate = least / np.maximum(1, [len(t) for t in texts])
        added = [pa.array(pred, pa.string()), pa.array(np.where(worded, score, 0.0)), pa.array(rate, mask=~worded)]
        return pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*names, *outs])

    return map_batches(docs, found, T.StructType([*docs.schema.fields, *added]))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language; rows whose crc32(doc_id as text) mod 5 is 0 are held out of learning."""
    docs = table(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = fit_languages(docs.filter(~held).select("doc_id", "text", "lang"))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")
