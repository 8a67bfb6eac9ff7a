"""Values of records as cells of a table: any JSON value as one line of text, and text back to a value of a declared type."""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")
_BASES = {"0x": 16, "0o": 8, "0b": 2}


def number_text(x: float) -> str:
    """A number in its shortest form: whole ones without a point, exponents from 1e21 and below 1e-6."""
    if isinstance(x, int) or (x.is_integer() and abs(x) < 1e21):
        return str(int(x))
    digits, _, power = repr(x).partition("e")
    if not power:
        return digits if abs(x) >= 1e-6 else f"{x:e}"
    if 1e-6 <= abs(x) < 1e-4:
        return f"{x:.{-int(power) + len(digits.replace('.', '').replace('-', '')) - 1}f}"
    return f"{digits}e{int(power):+d}"


def _plain(value: object) -> object:
    """Whole numbers without a point, as they are shown inside objects too."""
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return int(value) if isinstance(value, float) and value.is_integer() and abs(value) < 1e21 else value


def cell_text(value: object) -> str:
    """Nothing for null, Yes or No, items of lists joined by commas (lists in lists as well), objects as JSON."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "Yes" if value else "No"
    if isinstance(value, list):
        return ", ".join(map(cell_text, value))
    if isinstance(value, int | float):
        return number_text(value)
    return value if isinstance(value, str) else json.dumps(_plain(value), ensure_ascii=False, separators=(",", ":"))


def cell_value(text: str, kind: str) -> object:
    """What a text stands for in a field of a declared type; a text that is no number stays a text."""
    text = text.strip()
    if kind in ("integer", "number"):
        base = _BASES.get(text[:2].lower())
        if base and re.fullmatch(r"[0-9a-zA-Z]+", text[2:]):
            try:
                return int(text[2:], base)
            except ValueError:
                return text
        if not text:
            return 0
        if not _NUMBER.fullmatch(text):
            return text
        x = float(text)
        return None if math.isinf(x) else int(x) if x.is_integer() and abs(x) < 1e21 else x
    if kind == "boolean":
        return text == "true"
    if kind == "array":
        return [part for part in map(str.strip, text.split(",")) if part]
    return text


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def record_cells(records: pd.Series) -> pd.Series:
    """Cells of a JSON object by key, in the object's order; null for what is no object."""

    def cells(record: str | None) -> dict | None:
        try:
            found = json.loads(record) if record else None
        except ValueError:
            return None
        return {k: cell_text(v) for k, v in found.items()} if isinstance(found, dict) else None

    return records.map(cells)


@F.pandas_udf(T.StringType())
def _json_values(texts: pd.Series, kinds: pd.Series) -> pd.Series:
    pairs = zip(texts, kinds, strict=True)
    return pd.Series([None if t is None or k is None else json.dumps(cell_value(t, k), ensure_ascii=False, separators=(",", ":")) for t, k in pairs], dtype=object)


def patch_value(text: Column, kind: Column) -> Column:
    """The JSON text of what was typed into a cell, for a patch."""
    return _json_values(text, kind)
