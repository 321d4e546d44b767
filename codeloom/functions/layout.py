"""Object types laid out over lines, by an Arrow function: each text is read once from its start."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from codeloom.workers import ship_code

_PART = re.compile(r"""(?P<quoted>"(?:\\.|[^"\\])*(?:"|\\?$)|'(?:\\.|[^'\\])*(?:'|\\?$)|`[^`]*(?:`|$))|(?P<mark>[{}()\[\]<>;,])|(?P<plain>[^{}()\[\]<>;,"'`]+)""", re.S)
_PAIRS = {"}": "{", ")": "(", "]": "[", ">": "<"}


def laid_out(text: str | None) -> str | None:
    """The lines of a type in braces; None for other texts and for braces that don't match.

    A line ends behind an opening brace, a semicolon and a comma between the
    outermost properties, unless only a closing brace follows, and before a
    closing one. Space that stood there stays.
    """
    whole = (text or "").strip()
    parts = [(m.lastgroup, m[0], m.end()) for m in _PART.finditer(whole)]
    if not (whole.startswith("{") and whole.endswith("}")) or not _matched([p for kind, p, _ in parts if kind == "mark"]):
        return None
    depth = dict.fromkeys(_PAIRS.values(), 0)
    out, indent = "", 0
    for kind, part, end in parts:
        following = whole[end : end + 1] if not whole[end : end + 1].isspace() else whole[end:].lstrip()[:1]
        breaks = kind == "mark" and following not in ("", "}") and (part in "{;" or (part == "," and depth == {"{": 1, "(": 0, "[": 0, "<": 0}))
        if kind == "mark" and part == "}":
            indent = max(0, indent - 1)
            out += "" if out.endswith("\n") else "\n" + "  " * indent
        out += part
        if kind == "mark" and part in depth:
            depth[part] += 1
        elif kind == "mark" and part in _PAIRS:
            depth[_PAIRS[part]] = max(0, depth[_PAIRS[part]] - 1)
        if breaks:
            indent += part == "{"
            out += "\n" + "  " * indent
    return out.strip()


def _matched(marks: list[str]) -> bool:
    level = 0
    for mark in marks:
        level += (mark == "{") - (mark == "}")
        if level < 0:
            return False
    return level == 0


def object_layout(spark: SparkSession, type_text: Column) -> Column:
    """laid_out for a column; null stays null."""
    ship_code(spark)

    @F.pandas_udf("string")
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(laid_out, na_action="ignore")

    return apply(type_text)
