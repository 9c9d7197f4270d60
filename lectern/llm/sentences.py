"""Sentence units of texts in several languages.

Candidate ends are end marks with their closing quotes, and line breaks. Ordered rules decide each
candidate: a rule is a pair of regular expressions for what stands before and after it, and says whether
it is a break; the first rule that matches decides. The rules stand in tables, one for each language or
script, which cascade: first what is no end in any language, then the tables of the scripts found in a
text, then the general one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.domain import by_draft, holding
from lectern.llm.glyphs import flat_form


class Rule(NamedTuple):
    """A decision for a candidate end: `before` must match the word up to it, `after` what follows it.

    The word goes back to the last blank, LOOK_BACK characters at most; an empty pattern matches all.
    """

    breaks: bool
    before: str
    after: str


# Abbreviations. Titles and shortened words never end a sentence, the second kind doesn't before a number.
TITLES = "Mr Mrs Ms Mdm Mx Dr Drs Prof Assoc Er Hon Rev St Sr Jr Messrs Gen Col Capt Lt Sgt Insp Supt"
SHORT = "i.e e.g vs cf viz approx incl esp Pte Mt Ave Rd Blk c.f a.k.a"
NUMBERED = "No Nos no nos Vol Vols vol vols Art art Sec sec s ss Para para paras p pp Fig fig Ch ch cl Cl reg Reg Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec"
MALAY_TITLES = "En Pn Cik Tn Dato Datuk Hj Hjh Ir Ust Yb"
MALAY_SHORT = "Sdn dll dsb spt"
MALAY_NUMBERED = "Bil bil"
TAMIL_TITLES = "திரு திருமதி முனைவர் டாக்டர் பேராசிரியர் செல்வி செல்வன் மாண்புமிகு"
HINDI_TITLES = "डॉ प्रो श्री श्रीमती पं"
ARABIC_TITLES = "د أ م"
THAI_FINALS = "ครับ ค่ะ คะ นะครับ นะคะ จ้ะ"
# Marks that end a sentence whatever follows them.
FULL = "。।॥؟۔။។៕።፧"

_HAN = "一-鿿㐀-䶿"
_THAI = "ก-๎"
_OPEN = r"(?:.*[(\[“\"'/-])?"
_CLOSE = r"[\"”')\]]*"


def _any(words: str) -> str:
    return "|".join(re.escape(w) for w in words.split())


#: No end in any language: within a word or number, and before a quotation that begins after no Han character.
WITHIN = [
    Rule(False, rf"(?:.*[^.!?{FULL}\"”')\]])?[.!?]+{_CLOSE}", rf"(?![\s{_HAN}\"“])."),
    Rule(False, rf"(?:.*[^{_HAN}.!?{FULL}])?[.!?]+{_CLOSE}", r"[\"“]"),
]
ENGLISH = [
    Rule(False, rf"{_OPEN}(?i:{_any(TITLES)})\.", r"\s"),
    Rule(False, rf"{_OPEN}(?i:{_any(SHORT)})\.", r""),
    Rule(False, rf"{_OPEN}(?:{_any(NUMBERED)})\.", r"\s*\d"),
    Rule(False, rf"{_OPEN}(?:[A-Z]\.)+", r"\s+[A-Z]"),
]
MALAY = [
    Rule(False, rf"{_OPEN}(?i:{_any(MALAY_TITLES)})\.", r"\s"),
    Rule(False, rf"{_OPEN}(?i:{_any(MALAY_SHORT)})\.", r""),
    Rule(False, rf"{_OPEN}(?:{_any(MALAY_NUMBERED)})\.", r"\s*\d"),
]
TAMIL = [
    Rule(False, rf"{_OPEN}(?:{_any(TAMIL_TITLES)})\.", r"\s"),
    Rule(False, r".*[\"”']", r"\s*(?:என்று|என்றும்|என்ற|எனவும்|என)(?![஀-௿])"),
]
MANDARIN = [
    # a question or exclamation quoted before its reporting clause
    Rule(False, r".*[!?.][\"”']", rf"[{_HAN}][^。!?,;:“”\"\n]{{0,24}}?(?:说|问|道|答|喊|表示|指出|认为|写)"),
    Rule(True, rf".*(?:[。!?]|[{_HAN}]\.)[\"”')\]]*", ""),
]
HINDI = [Rule(False, rf"{_OPEN}(?:{_any(HINDI_TITLES)})\.", r"\s"), Rule(True, rf".*[।॥]{_CLOSE}", "")]
ARABIC = [Rule(False, rf"{_OPEN}(?:{_any(ARABIC_TITLES)})\.", r"\s"), Rule(True, rf".*[؟۔]{_CLOSE}", "")]
BURMESE = [Rule(True, rf".*။{_CLOSE}", "")]
KHMER = [Rule(False, r".*។", r"ល។"), Rule(True, rf".*[។៕]{_CLOSE}", "")]
ETHIOPIC = [Rule(True, rf".*[።፧]{_CLOSE}", "")]
#: A blank between Thai letters ends a sentence only after a closing particle.
THAI = [Rule(True, rf".*(?:{_any(THAI_FINALS)})", r"[ ]"), Rule(False, rf".*[{_THAI}]", r"[ ]")]
GENERAL = [
    # small letters go on with a sentence, but for words with a capital inside
    Rule(False, "", r"[^\S\n]+[\"“'(\[]?(?![^\W\d_]+[A-Z])[a-zß-öø-ÿ]"),
    Rule(True, "", ""),
]
#: The tables by language, with the characters whose presence in a text calls for them.
TABLES = {
    "tamil": ("஀-௿", TAMIL), "mandarin": (_HAN, MANDARIN), "hindi": ("ऀ-ॿ", HINDI), "arabic": ("؀-ۿ", ARABIC), "burmese": ("က-႟", BURMESE), "khmer": ("ក-៿", KHMER),
    "ethiopic": ("ሀ-፿", ETHIOPIC), "thai": (_THAI, THAI), "english": ("A-Za-z", ENGLISH), "malay": ("A-Za-z", MALAY),
}

Compiled = tuple[bool, re.Pattern[str] | None, re.Pattern[str]]


def _compiled(rules: list[Rule]) -> list[Compiled]:
    """Rules as patterns. Among neighbours that decide alike the order doesn't matter: those with the same `after` are one."""
    merged: list[Rule] = []
    begin = 0
    for r in rules:
        if merged and merged[-1].breaks != r.breaks:
            begin = len(merged)
        i = next((i for i in range(begin, len(merged)) if r.before and merged[i].before and merged[i].after == r.after), None)
        if i is None:
            merged.append(r)
        else:
            merged[i] = merged[i]._replace(before=f"{merged[i].before}|{r.before}")
    return [(r.breaks, re.compile(r.before) if r.before else None, re.compile(r.after)) for r in merged]


@lru_cache(64)
def cascade(scripts: tuple[str, ...]) -> list[Compiled]:
    """The rules for a text with these scripts, in order."""
    return _compiled(WITHIN + [r for s in scripts for r in TABLES[s][1]] + GENERAL)


_SCRIPTS = {name: re.compile(f"[{chars}]") for name, (chars, _) in TABLES.items()}
#: An end mark with what closes behind it, or a line break; with Thai, the end of a word before a blank too.
_CANDIDATE = re.compile(rf"[.!?{FULL}]+{_CLOSE}|\n")
_CANDIDATE_THAI = re.compile(rf"{_CANDIDATE.pattern}|(?<=[{_THAI}])(?= +[{_THAI}])")
_OTHER = re.compile("[\u0590-\u1aff]")
#: How far a rule looks back.
LOOK_BACK = 24
_QUOTE = re.compile(r"[\"“”\n]")


def scripts_of(flat: str) -> tuple[str, ...]:
    """The languages whose tables a text calls for."""
    if flat.isascii():
        return "english", "malay"
    other = _OTHER.search(flat) is not None
    return tuple(s for s, p in _SCRIPTS.items() if (other or s in _COMMON) and p.search(flat))


#: Languages of scripts outside the range of _OTHER.
_COMMON = ("mandarin", "english", "malay")


def _opening(text: str, inside: bool) -> tuple[set[int], bool]:
    """The places of straight double quotes that open a quotation, and whether one is open at the end."""
    opens = set()
    for m in _QUOTE.finditer(text):
        if m.group() == '"':
            if not inside:
                opens.add(m.start())
            inside = not inside
        else:
            inside = m.group() == "“"
    return opens, inside


def _break_ends(flat: str, opens: set[int]) -> list[int]:
    """The ends of units in a flat text, in order."""
    scripts = scripts_of(flat)
    rules = cascade(scripts)
    ends = []
    for m in (_CANDIDATE_THAI if "thai" in scripts else _CANDIDATE).finditer(flat):
        end = m.end()
        if flat[end - 1] != "\n":
            if opens:
                end = next((i for i in range(m.start(), end) if i in opens), end)
            low = max(0, end - LOOK_BACK)
            start = max(flat.rfind(" ", low, end), flat.rfind("\n", low, end)) + 1 or low
            for breaks, before, after in rules:
                if after.match(flat, end) and (before is None or before.fullmatch(flat, start, end)):
                    break
            if not breaks:
                continue
        ends.append(end)
    return ends


def _spans(flat: str, at: list[int] | None, ends: list[int]) -> list[tuple[int, int]]:
    """What lies between ends, without blanks at the borders, in places of the original text."""
    out, start = [], 0
    for end in [*ends, len(flat)]:
        part = flat[start:end]
        s = start + len(part) - len(part.lstrip())
        e = start + len(part.rstrip())
        if e > s:
            out.append((s, e) if at is None else (at[s], at[e - 1] + 1))
        start = max(start, end)
    return out


def units(text: str | None, inside: bool = False) -> list[tuple[int, int]]:
    """The sentence units of a text as (start, end) in code points; none for a null, empty or blank text.

    The units cover everything but blanks. A line break ends a unit. `inside` says that a quotation is
    open where the text begins, if it is a part of another.
    """
    if not text:
        return []
    flat, at = flat_form(text)
    opens = _opening(flat, inside)[0] if '"' in flat and _SCRIPTS["mandarin"].search(flat) else set()
    return _spans(flat, at, _break_ends(flat, opens))


def quote_states(text: str) -> tuple[bool, bool]:
    """Whether a quotation is open after `text`, if none was before it, and if one was."""
    flat = flat_form(text)[0]
    return _opening(flat, False)[1], _opening(flat, True)[1]


def sentence_units(turns: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """turn_key, char_start, char_end: one row for each sentence unit of each row of `turns`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [units(t) for t in batch.column(1).to_pylist()]
            rows = pa.array([i for i, u in enumerate(found) for _ in u], pa.int64())
            starts = pa.array([s for u in found for s, _ in u], pa.int32())
            ends = pa.array([e for u in found for _, e in u], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), starts, ends], ["turn_key", "char_start", "char_end"])

    schema = T.StructType([T.StructField("turn_key", T.StringType()), T.StructField("char_start", T.IntegerType()), T.StructField("char_end", T.IntegerType())])
    return turns.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def turn_units(turns: DataFrame, reports: DataFrame) -> DataFrame:
    """The sentence units of the rows that hold of turns outside draft reports."""
    own = holding(turns.select("key", "report_id", "text", "loaded_at"), "key")
    return sentence_units(by_draft(own, reports, draft=False))
