"""One form for texts that look the same.

A transducer over grapheme clusters rewrites widths, ligatures, composed and decomposed letters,
invisible characters, look-alike letters, typographic marks and blanks in one pass. Its mapping is
made from the Unicode character data by rule; a check at its making proves that no image is mapped again.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from itertools import permutations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.keys import key_form
from lectern.llm.domain import by_draft, holding
from lectern.sources import checkpointed

# Letters of other alphabets and the Latin letters of the same shape.
LOOK_ALIKES = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "ϲ": "c", "Ϲ": "C", "ϳ": "j", "Ϳ": "J",
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ԛ": "Q", "Ԝ": "W", "Ғ": "F",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ѵ": "v", "ӏ": "l", "к": "k", "ԍ": "g",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭼ": "E", "Ꮋ": "H", "Ꮖ": "I", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    "Օ": "O", "Ս": "U", "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "ɡ": "g", "ı": "i", "ɑ": "a", "ℓ": "l",
}
# Typographic forms of quotes, dashes and dots.
MARKS = {
    "‘": "'", "’": "'", "‚": "'", "‛": "'", "′": "'", "ʼ": "'", "ʹ": "'", "´": "'", "`": "'", "‹": "'", "›": "'",
    "“": '"', "”": '"', "„": '"', "‟": '"', "″": '"', "«": '"', "»": '"', "〝": '"', "〞": '"', "〟": '"',
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "−": "-", "﹘": "-", "⁃": "-",
    "․": ".", "‥": "..", "…": "...", "⋯": "...",
}
#: Kinds of compatibility decomposition that don't show: the others (raised, circled and so on) do.
UNSEEN = ("<wide>", "<narrow>", "<noBreak>", "<compat>")


def invisible(ch: str) -> bool:
    """Format characters, variation selectors and fillers, which show nothing."""
    return unicodedata.category(ch) == "Cf" and not "؀" <= ch <= "࣢" or ch in "͏ᅟᅠ឴឵ㅤﾠ" or "︀" <= ch <= "️" or "᠋" <= ch <= "᠏" or "\U000e0100" <= ch <= "\U000e01ef"


def blank(ch: str) -> bool:
    """Blanks and line breaks of any kind."""
    return ch.isspace() or ch in "⠀"


def _char_class(chars: set[str]) -> str:
    """The inside of a regular expression's character class, with runs as ranges."""
    out, points = [], sorted(map(ord, chars))
    while points:
        first = last = points.pop(0)
        while points and points[0] == last + 1:
            last = points.pop(0)
        out.append(re.escape(chr(first)) + (f"-{re.escape(chr(last))}" if last > first else ""))
    return "".join(out)


class Transducer:
    """Longest match over grapheme clusters, rewriting each in one pass.

    `single` holds the image of every character that has one, `clusters` that of every way to write a
    composed character as a letter and marks. Both are made from the character data when the transducer is
    compiled, and checked against each other. A letter with marks that make no composed character together
    goes by the longest part that does. A run of blanks is one cluster and gives one space, none at the ends
    of the text.
    """

    def __init__(self) -> None:
        self.single: dict[str, str] = {}
        marks: set[str] = set()
        blanks: set[str] = set()
        hidden: set[str] = set()
        for ch in map(chr, range(0x20000)):
            if "\ud800" <= ch <= "\udfff":
                continue
            if blank(ch):
                blanks.add(ch)
            elif invisible(ch):
                hidden.add(ch)
            elif unicodedata.combining(ch):
                marks.add(ch)
            if (d := unicodedata.decomposition(ch)) and not d.startswith("<"):
                marks.update(chr(int(x, 16)) for x in d.split()[1:])
        for ch in map(chr, [*range(0x80, 0x20000), *range(0x2F800, 0x2FA20)]):
            if "\ud800" <= ch <= "\udfff" or ch in blanks or ch in hidden or ch in marks:
                continue
            if (image := self._image(ch)) != ch:
                self.single[ch] = image
        self.single["`"] = MARKS["`"]
        self.blanks, self.hidden = blanks, hidden
        b, h, m = map(_char_class, (blanks, hidden, marks))
        self.pattern = re.compile(f"[{b}][{b}{h}]*|[^{b}{h}{m}](?:[{h}]*[{m}])+|[{h}]+|[{_char_class(set(self.single))}]")
        self.clusters = self._compositions(marks)
        self.cache: dict[str, str] = {}
        self.check()

    def _compositions(self, marks: set[str]) -> dict[str, str]:
        """The image of each sequence of a letter and marks that is canonically one character, marks in any order
        that canonical ordering makes equal."""
        out: dict[str, str] = {}
        for ch in map(chr, range(0xC0, 0x20000)):
            if "\ud800" <= ch <= "\udfff" or "\uac00" <= ch <= "\ud7a3" or ch in marks:
                continue
            full = unicodedata.normalize("NFD", ch)
            if len(full) == 1 or unicodedata.normalize("NFC", full) != ch or any(x not in marks for x in full[1:]):
                continue
            image = self.single.get(ch, ch)
            for order in set(permutations(full[1:])):
                if unicodedata.normalize("NFC", s := full[0] + "".join(order)) == ch:
                    self._agree(out, s, image)
            for k in range(1, len(full) - 1):  # a part composed already
                if len(part := unicodedata.normalize("NFC", full[: k + 1])) == 1:
                    self._agree(out, part + full[k + 1 :], image)
        for look, latin in LOOK_ALIKES.items():  # letters of the same shape with the same marks
            for s, image in [(s, i) for s, i in out.items() if s[0] == latin]:
                if s.replace(latin, look, 1) not in out:
                    out[s.replace(latin, look, 1)] = image
        return out

    @staticmethod
    def _agree(table: dict[str, str], key: str, image: str) -> None:
        if table.setdefault(key, image) != image:
            raise ValueError(f"{[f'U+{ord(x):04X}' for x in key]} has two images, {table[key]!r} and {image!r}")

    @staticmethod
    def _image(ch: str) -> str:
        """What one visible character becomes; applied until nothing changes."""
        seen = {ch}
        text = ch
        while True:
            out = ""
            for x in text:
                d = unicodedata.decomposition(x).split()
                if x in LOOK_ALIKES:
                    out += LOOK_ALIKES[x]
                elif x in MARKS:
                    out += MARKS[x]
                elif d and d[0] in UNSEEN and "0020" not in d:
                    out += "".join(chr(int(y, 16)) for y in d[1:])
                elif d and not d[0].startswith("<"):
                    out += "".join(LOOK_ALIKES.get(y, y) for y in unicodedata.normalize("NFD", x))
                else:
                    out += x
            out = unicodedata.normalize("NFC", out)
            if out == text or out in seen:
                return out
            seen.add(out)
            text = out

    def check(self) -> None:
        """No image holds a mapped character, and every image is its own image: one pass is enough."""
        for ch, image in self.single.items():
            if again := [x for x in image if x in self.single]:
                raise ValueError(f"U+{ord(ch):04X} is mapped to {again}, which is mapped again")
            if self(image) != image.strip():
                raise ValueError(f"the image of U+{ord(ch):04X} isn't its own image")
        for key, image in self.clusters.items():
            if self(image) != image:
                raise ValueError(f"the image of {key!r} isn't its own image")
            whole = unicodedata.normalize("NFC", key)
            if len(whole) == 1 and self.single.get(whole, whole) != image:
                raise ValueError(f"{key!r} and {whole!r}, the same character, have two images")

    def _cluster(self, found: re.Match[str]) -> str:
        text = found.group()
        image = self.cache.get(text)
        if image is None:
            if text[0] in self.blanks:
                image = " "
            else:
                image = self._longest("".join(x for x in text if x not in self.hidden))
            if len(self.cache) < 100_000:  # a memo of clusters, not of texts
                self.cache[text] = image
        return image

    def _longest(self, text: str) -> str:
        """The image of a letter with marks: of the longest beginning that the tables hold, and of each mark behind it."""
        if len(text) < 2:
            return self.single.get(text, text)
        if (image := self.clusters.get(text)) is not None:
            return image
        text = unicodedata.normalize("NFC", text)  # marks in canonical order
        n = next((n for n in range(len(text), 1, -1) if text[:n] in self.clusters), 1)
        head = self.clusters[text[:n]] if n > 1 else self.single.get(text[0], text[0])
        out = head + "".join(self.single.get(x, x) for x in text[n:])
        again = unicodedata.normalize("NFC", out)
        return again if again in (out, text) else self._longest(again)

    def __call__(self, text: str) -> str:
        if text.isascii() and "`" not in text:
            return " ".join(text.split())
        return self.pattern.sub(self._cluster, text).strip(" ")


@lru_cache(1)
def transducer() -> Transducer:
    return Transducer()


@lru_cache(1)
def _flat() -> tuple[dict[int, str], re.Pattern[str], re.Pattern[str]]:
    t = transducer()
    one = {ord(k): v[0] for k, v in t.single.items()} | {ord(b): " " for b in t.blanks if b not in "\n\r"} | {ord("\r"): "\n", 0x2028: "\n", 0x2029: "\n", 0x85: "\n"}
    for k in "“”„‟″«»〝〞〟":
        one.pop(ord(k), None)
    one[0xFF02] = '"'
    return one, re.compile(f"[{_char_class(t.hidden)}]"), re.compile(f"[{_char_class(set(map(chr, one)) - {' '})}]")


def flat_form(text: str) -> tuple[str, list[int] | None]:
    """`text` with each character folded to one, invisible ones left out, and the old place of each if that differs.

    Double quotes keep their direction, and line breaks stay line breaks.
    """
    if text.isascii():
        return text, None
    one, hidden, folded = _flat()
    at = None
    if hidden.search(text):
        at = [i for i, ch in enumerate(text) if not hidden.match(ch)]
        text = "".join(text[i] for i in at)
    return text.translate(one) if folded.search(text) else text, at


@F.pandas_udf(T.StringType())
def look_form(texts: pd.Series) -> pd.Series:
    """The form in which texts that look the same are equal; null for null."""
    f = transducer()
    return texts.map(lambda t: None if t is None else f(t))


@F.pandas_udf(T.BinaryType())
def look_key(texts: pd.Series) -> pd.Series:
    """128 bits of the look form; null for null."""
    import xxhash

    f = transducer()
    return texts.map(lambda t: None if t is None else xxhash.xxh3_128_digest(f(t).encode("utf-8", "surrogatepass")))


@F.pandas_udf(T.BooleanType())
def looks_inside(inner: pd.Series, outer: pd.Series) -> pd.Series:
    """Whether the look form of `inner` occurs in that of `outer`."""
    f = transducer()
    return pd.Series([None if a is None or b is None else f(a) in f(b) for a, b in zip(inner, outer)])


def look_classes(turns: DataFrame) -> DataFrame:
    """__report, look, t, n, key: the different texts (md5 t) of one look in a report, how many turns have each, and
    the least of their keys.

    `turns` has __report, key, text, one row a key. Null texts look like nothing; an empty text looks like a
    blank one. Only looks of several texts are given.
    """
    return _several(_looked(turns))


def _looked(turns: DataFrame) -> DataFrame:
    # keys and hashes only, written once: the look form is the costly part and is wanted several times
    return checkpointed(turns.where("text IS NOT NULL").select("__report", "key", F.md5("text").alias("t"), look_key("text").alias("look")))


def _several(looked: DataFrame) -> DataFrame:
    texts = looked.groupBy("__report", "look", "t").agg(F.count("*").alias("n"), F.min("key").alias("key"))
    several = texts.groupBy("__report", "look").agg(F.count("*").alias("k")).where("k > 1").select("__report", "look")
    return texts.join(several, ["__report", "look"], "left_semi")


def same_look_turns(turns: DataFrame) -> DataFrame:
    """key_a, key_b of turns of one report whose texts differ but look the same.

    The classes of `look_classes` are paired as texts, and only then given the keys of their turns, so that
    equal texts, however many, meet nowhere but in the result.
    """
    looked = _looked(turns)
    two = _several(looked).select("__report", "look", "t")
    pairs = two.withColumnRenamed("t", "ta").join(two.withColumnRenamed("t", "tb"), ["__report", "look"]).where("ta < tb").drop("look")
    # a text's hash within a report decides its look
    a = looked.select("__report", F.col("t").alias("ta"), F.col("key").alias("a"))
    b = looked.select("__report", F.col("t").alias("tb"), F.col("key").alias("b"))
    return pairs.join(a, ["__report", "ta"]).join(b, ["__report", "tb"]).select(F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b"))


def same_look_quotes(turns: DataFrame, chunks: DataFrame) -> DataFrame:
    """key_a, key_b of a turn and a chunk that refers to it and quotes it in other characters.

    Only chunks that don't occur in the stored text are brought to their look form. Null texts are no
    quotes; an empty quote occurs in every text.
    """
    c = chunks.where("cite_text IS NOT NULL").select(F.col("id"), key_form("turn_key").alias("__key"), "cite_text")
    other = c.join(turns.where("text IS NOT NULL").select("__key", "key", "text"), "__key").where(~F.contains("text", "cite_text"))
    return other.where(looks_inside("cite_text", "text")).select(F.least("key", "id").alias("key_a"), F.greatest("key", "id").alias("key_b"))


def same_look(turns: DataFrame, chunks: DataFrame, reports: DataFrame) -> DataFrame:
    """Turns said again, and quotes of a turn, in other characters: key_a < key_b, without draft reports."""
    own = holding(turns.select("key", "report_id", "text", "loaded_at"), "key")
    own = by_draft(own, reports, draft=False).withColumn("__report", key_form("report_id"))
    return same_look_turns(own).unionByName(same_look_quotes(own, chunks)).distinct()


