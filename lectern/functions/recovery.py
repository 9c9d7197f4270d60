"""JSON objects out of replies that are fenced, wrapped in prose, several, or cut off."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FENCE = re.compile(r"\A\s*```[A-Za-z]*\s*|\s*```\s*\Z")
_MARK = re.compile(r'[{}"\\]')
# The lists whose complete elements are kept of a reply that is cut off.
LISTS = ("points", "response")


def _object(text: str) -> dict | None:
    try:
        found = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def closed_objects(text: str, start: int = 0) -> list[str]:
    """The outermost pieces in braces that close, strings and escapes within them respected. One pass over the marks."""
    out, depth, begun, quoted, skip = [], 0, 0, False, -1
    for m in _MARK.finditer(text, start):
        mark, at = m.group(), m.start()
        if at == skip:
            continue
        if mark == "\\":
            skip = at + 1 if quoted else -1
        elif mark == '"':
            quoted = not quoted
        elif quoted:
            continue
        elif mark == "{":
            begun = at if depth == 0 else begun
            depth += 1
        elif depth:
            depth -= 1
            if depth == 0:
                out.append(text[begun : at + 1])
    return out


def recover(reply: str | None) -> list[dict]:
    """Every JSON object of a reply, in order.

    The reply is one object; or has one a line; or objects among other text; or it is cut off, and then the
    elements that are complete of its list of points make one object, marked as such. Nothing is guessed.
    """
    text = _FENCE.sub("", reply or "").strip()
    if not text:
        return []
    try:
        json.loads(text)
        whole = True
    except (ValueError, RecursionError):
        whole = False
    if whole:
        return [x] if (x := _object(text)) is not None else []
    lines = (line.strip().rstrip(",") for line in text.splitlines())
    if found := [x for line in lines if line.startswith("{") and (x := _object(line)) is not None]:
        return found
    if found := [x for piece in closed_objects(text) if (x := _object(piece)) is not None]:
        return found
    for name in LISTS:
        if (at := text.find(f'"{name}"')) >= 0 and (begin := text.find("[", at)) >= 0:
            items = [x for piece in closed_objects(text, begin) if (x := _object(piece)) is not None]
            return [{name: items, "cut_off": True}] if items else []
    return []


@F.pandas_udf(T.ArrayType(T.StringType()))
def recovered(replies: pd.Series) -> pd.Series:
    """The objects of each reply as JSON texts, keys in order."""
    return replies.map(lambda r: [json.dumps(x, sort_keys=True, ensure_ascii=False) for x in recover(r)])
