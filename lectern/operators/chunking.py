"""Lossless chunks of a text as a fold over its units, within a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def units_of(text: str) -> Column:
    """Paragraphs if there are several, flattened (no-break blanks too) and each but the last with a blank after it; else sentences with their blanks."""
    flat = F.filter(F.transform(F.split(F.col(text), r"\n{2,}"), lambda p: F.trim(F.regexp_replace(p, r"[\s\u00a0]+", " "))), lambda p: p != "")
    spaced = F.transform(flat, lambda p, i: F.when(i < F.size(flat) - 1, F.concat(p, F.lit(" "))).otherwise(p))
    sentences = F.regexp_extract_all(F.col(text), F.lit(r"([^.!?]*[.!?]+\s*|[^.!?]+$)"), F.lit(1))
    return F.when(F.size(flat) > 1, spaced).otherwise(sentences)


def split_text(text: str, limit: int, overlap: int, least: int) -> Column:
    """Pieces of at most `limit` characters: units are added while they fit; a piece begins with the last `overlap`
    characters of the one before if they fit with its first unit; a unit beyond the limit is cut at fixed width;
    a piece shorter than `least` joins the one before."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))

    def step(acc: Column, u: Column) -> Column:
        flushed = F.when(acc["cur"] != "", F.concat(acc["out"], F.array(acc["cur"]))).otherwise(acc["out"])
        wide = F.transform(F.sequence(F.lit(0), F.floor((F.length(u) - 1) / limit).cast("int")), lambda i: F.substring(u, i * limit + 1, F.lit(limit)))
        tail = F.concat(F.substring(acc["cur"], F.greatest(F.length(acc["cur"]) - overlap + 1, F.lit(1)), F.lit(overlap)), u)
        long, fits = F.length(u) > limit, F.length(acc["cur"]) + F.length(u) <= limit
        out = F.when(long, F.concat(flushed, wide)).when(fits, acc["out"]).otherwise(flushed)
        cur = F.when(long, F.lit("")).when(fits, F.concat(acc["cur"], u)).when(F.length(tail) <= limit, tail).otherwise(u)
        return F.struct(out.alias("out"), cur.alias("cur"))

    def done(acc: Column) -> Column:
        last = F.try_element_at(acc["out"], F.lit(-1))
        short = (F.length(acc["cur"]) < least) & (F.size(acc["out"]) > 0)
        merged = F.concat(F.slice(acc["out"], F.lit(1), F.greatest(F.size(acc["out"]) - 1, F.lit(0))), F.array(F.concat(last, acc["cur"])))
        return F.when(acc["cur"] == "", acc["out"]).when(short, merged).otherwise(F.concat(acc["out"], F.array(acc["cur"])))

    folded = F.aggregate(units_of(text), start, step, done)
    return F.when(F.length(text) <= limit, F.array(F.col(text))).otherwise(folded)
