"""Queries and operators beyond the sizes and forms of the given tables."""

from __future__ import annotations

from palimpsest import catalog
from palimpsest.operators import branches


def test_path_parents_of_deep_paths(spark, tmp_path):
    spark.createDataFrame([(1, "http://A.org/a/b/c/d?x")], "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted((r.n, r.folder) for r in catalog.QUERIES["path_parents"](spark, str(tmp_path)).collect())
    assert got == [(1, "a"), (2, "a/b"), (3, "a/b/c")]


def test_nested_paths_of_a_long_chain(spark):
    rows = [(k, f"s{k}", f"s{k - 1}" if k else None) for k in range(1200)] + [(2000, "x", "y"), (2001, "y", "x"), (2002, "z", "nowhere")]
    got = {r.id: r.path for r in branches.nested_paths(spark.createDataFrame(rows, "id long, slug string, up string")).collect()}
    assert len(got) == 1200 and got[2] == "/0-s0/1-s1/2-s2/index.md" and got[1199] == "".join(f"/{k}-s{k}" for k in range(1200)) + "/index.md"
