"""Texts by lines: difference and three-way merge of columns, a small helper in Arrow batches."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _lines(text: str | None) -> list[str]:
    return text.split("\n") if text else []


def diff_lines(a: list[str], b: list[str]) -> list[str]:
    """Lines of both, marked with a space (kept), - (only in a) or + (only in b)."""
    out = []
    for kind, i, j, k, m in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        out += [" " + x for x in a[i:j]] if kind == "equal" else ["-" + x for x in a[i:j]] + ["+" + x for x in b[k:m]]
    return out


def merge_lines(base: list[str], ours: list[str], theirs: list[str]) -> tuple[list[str], bool]:
    """(lines, conflict): changes of either side; where both change one place otherwise, both stand between markers.

    The base is cut at the lines that both sides keep; each piece between two cuts is decided on its own.
    """
    kept = [{i + n: j + n for i, j, size in SequenceMatcher(None, base, side, autojunk=False).get_matching_blocks() for n in range(size)} for side in (ours, theirs)]
    cuts = [(-1, -1, -1), *((i, kept[0][i], kept[1][i]) for i in range(len(base)) if i in kept[0] and i in kept[1]), (len(base), len(ours), len(theirs))]
    out, conflict = [], False
    for (i, j, k), (i2, j2, k2) in zip(cuts, cuts[1:]):
        b, o, t = base[i + 1 : i2], ours[j + 1 : j2], theirs[k + 1 : k2]
        if o == t or t == b:
            out += o
        elif o == b:
            out += t
        else:
            out += ["<<<<<<< ours", *o, "=======", *t, ">>>>>>> theirs"]
            conflict = True
        out += base[i2 : i2 + 1]
    return out, conflict


def line_diff(a: Column, b: Column) -> Column:
    @F.pandas_udf(T.StringType())
    def made(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(["\n".join(diff_lines(_lines(x), _lines(y))) for x, y in zip(a, b)])

    return made(a, b)


def line_merge(base: Column, ours: Column, theirs: Column) -> Column:
    """struct<text, conflict>; nulls count as empty texts."""

    @F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("conflict", T.BooleanType())]))
    def made(base: pd.Series, ours: pd.Series, theirs: pd.Series) -> pd.DataFrame:
        rows = [merge_lines(*map(_lines, x)) for x in zip(base, ours, theirs)]
        return pd.DataFrame({"text": ["\n".join(r) for r, _ in rows], "conflict": [c for _, c in rows]})

    return made(base, ours, theirs)
