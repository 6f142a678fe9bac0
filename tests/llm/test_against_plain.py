"""Queries against their SQL in DuckDB, and quality scores against a plain computation from the model."""

from __future__ import annotations

import math
import zlib
from pathlib import Path

import duckdb
import pytest
import zstandard

from palimpsest.llm import catalog, quality

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, name):
    if not Path(SF_DIR).exists():
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark", "labels", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    ran = c.execute(catalog.SQL[name])
    names = [d[0] for d in ran.description]
    assert sorted(names) == columns
    order = sorted(range(len(names)), key=names.__getitem__)
    assert sorted(tuple(str(r[x]) for x in columns) for r in df.collect()) == sorted(tuple(str(r[k]) for k in order) for r in ran.fetchall())


def plain_score(text, model):
    """Block by block: how many bytes more the bad dictionary needs than the good one, in all and at worst, then the logistic."""
    size = lambda block, content: len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(content), write_content_size=False, write_checksum=False, write_dict_id=False).compress(block))
    data = (text or "").encode()
    blocks = [data[k : k + 512] for k in range(0, len(data), 512)]
    more = [size(b, model.bad) - size(b, model.good) for b in blocks]
    worst = min([1.0, *(m / max(len(b), 256) for m, b in zip(more, blocks))]) if blocks else 0.0
    x = (1.0, sum(more) / max(1, len(data)), worst, 1 / (1 + len(data) / 64), sum(more) / (len(data) + 512))
    z = sum(a * w for a, w in zip(x, model.weights))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def test_quality_scores_are_those_of_the_model(spark):
    if not Path(SF_DIR).exists():
        pytest.skip("no test tables here")
    docs, labels = spark.read.parquet(f"{SF_DIR}/documents.parquet"), spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()
    may = [(r.doc_id, r.quality) for r in labels if zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    model = quality.fit_quality(spark.createDataFrame(may, "doc_id long, quality int"), docs.select("doc_id", "text"))
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "x"), (-4, "é" * 5000)], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(odd)
    want = {r.doc_id: plain_score(r.text, model) for r in every.collect()}
    got = {r.doc_id: r.score for r in quality.score_quality(every, model).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    query = {r.doc_id: r for r in quality.op1_quality(spark, SF_DIR).collect()}
    assert all(abs(r.score - want[k]) < 1e-9 and r.predicted == int(want[k] >= 0.5) and r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in query.items())
