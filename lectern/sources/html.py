"""Turns from pages with irregular mark-up."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class _Blocks(HTMLParser):
    """Text blocks of a page with what stands in bold, skipping what isn't shown. Unclosed marks end with their block."""

    BREAKS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr", "br", "section", "article", "body"}
    HIDDEN = {"script", "style", "nav", "head", "noscript"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str, str]] = []
        self.kind, self.bold, self.text, self.strong, self.hidden = "", False, [], [], 0

    def flush(self, kind: str) -> None:
        text, strong = (" ".join("".join(x).split()) for x in (self.text, self.strong))
        if text or strong:
            self.blocks.append((self.kind, strong, text))
        self.kind, self.bold, self.text, self.strong = kind, False, [], []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.HIDDEN:
            self.hidden += 1
        elif tag in self.BREAKS:
            self.flush(tag)
        elif tag in ("b", "strong"):
            self.bold = True

    def handle_endtag(self, tag: str) -> None:
        if tag in self.HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in self.BREAKS:
            self.flush("")
        elif tag in ("b", "strong"):
            self.bold = False

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            (self.strong if self.bold else self.text).append(data)


def turns_of(html: str | None, between: str = "\n") -> list[tuple[str | None, str | None, str]]:
    """(time, speaker, body): a block that begins in bold opens a turn, others go on with it; headings are times. Blocks of
    a turn have `between` among them: two line breaks keep them as paragraphs."""
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser.flush("")
    time, out = None, []
    for kind, strong, text in parser.blocks:
        if kind.startswith("h"):
            time = text or strong or None
            continue
        body = text.lstrip(": ").strip()
        if strong or not out:
            out.append([time, strong.rstrip(": ") or None, [body] if body else []])
        elif body:
            out[-1][2].append(body)
    return [(t, s, between.join(b)) for t, s, b in out if b or s]


def page_turns(pages: DataFrame, key: str, html: str, between: str = "\n") -> DataFrame:
    """key, i, time, speaker, body of every turn of every page; a null or empty page has none."""
    schema = T.StructType([pages.schema[key], T.StructField("i", T.IntegerType()), *(T.StructField(c, T.StringType()) for c in ("time", "speaker", "body"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(n, i, *t) for n, page in enumerate(batch.column(1).to_pylist()) for i, t in enumerate(turns_of(page, between))]
            cols = list(zip(*found)) or [()] * 5
            rest = [pa.array(c, pa.int32() if n == 0 else pa.string()) for n, c in enumerate(cols[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), *rest], schema.names)

    return pages.select(F.col(key), F.col(html)).mapInArrow(run, schema)
