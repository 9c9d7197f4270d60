"""Clean speaker turns from uncorrected transcripts.

A parsing-expression grammar reads each row: notes in nested brackets, clock stamps, remarks on the
language, labels and hesitation sounds; what is left are words. The parse trees become speeches, each
with the label in force. Labels are read as members of the roster by the operator for typed names, and
speeches in order become turns.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.domain import by_draft, holding
from lectern.llm.glyphs import flat_form
from lectern.llm.names import HONORIFICS, OFFICE, resolve_labels
from lectern.sources import checkpointed

Node = tuple[str, object]
Parser = Callable[[str, int], "tuple[int, list[Node]] | None"]


def terminal(pattern: str, kind: str = "", flags: int = 0) -> Parser:
    """Matches a regular expression; gives a node of this kind, or none."""
    match = re.compile(pattern, flags).match

    def parse(text: str, at: int) -> tuple[int, list[Node]] | None:
        m = match(text, at)
        return None if m is None else (m.end(), [(kind, m.group())] if kind else [])

    return parse


def sequence(*parts: Parser) -> Parser:
    def parse(text: str, at: int) -> tuple[int, list[Node]] | None:
        nodes: list[Node] = []
        for p in parts:
            if (r := p(text, at)) is None:
                return None
            at = r[0]
            nodes += r[1]
        return at, nodes

    return parse


def choice(*parts: Parser) -> Parser:
    """The first that matches."""

    def parse(text: str, at: int) -> tuple[int, list[Node]] | None:
        for p in parts:
            if (r := p(text, at)) is not None:
                return r
        return None

    return parse


def many(part: Parser) -> Parser:
    def parse(text: str, at: int) -> tuple[int, list[Node]] | None:
        nodes: list[Node] = []
        while (r := part(text, at)) is not None and r[0] > at:
            at = r[0]
            nodes += r[1]
        return at, nodes

    return parse


def named(kind: str, part: Parser) -> Parser:
    """One node over what `part` matches, its nodes below it."""

    def parse(text: str, at: int) -> tuple[int, list[Node]] | None:
        r = part(text, at)
        return None if r is None else (r[0], [(kind, (text[at : r[0]], r[1]))])

    return parse


def where(test: Callable[[str, int], bool], part: Parser) -> Parser:
    """`part`, only at places that pass the test."""
    return lambda text, at: part(text, at) if test(text, at) else None


# Hesitation sounds, words of notes in round brackets, lines that only record proceedings.
HESITATION = r"(?:u+h*m+|u+h+|e+r+m*|a+h+|m{2,}|h+m+|e+h+)"
SOUNDS = (
    r"laugh|chuckl|giggl|cough|sneez|applau|cheer|clap|thump|bang|crosstalk|cross-talk|interject|interrupt|inaudible|indistinct|unclear|microphone|\bmic\b|pause|silence|noise|shout|jeer|heckl|hear, "
    r"hear|murmur|sigh|gavel|desk|bell rings|music|phone rings|off-mic|overlapping"
)
PROCEEDINGS = (
    r"(?:\(proc text\)\s*)?(?:Question put,? and (?:agreed to|negatived)|Amendment, by leave, withdrawn|The House divided|Sitting "
    r"(?:suspended|resumed)[^.]*|Debate (?:resumed|adjourned)|Bill accordingly read a[^.]*|Clauses? [\w ,-]* ordered to stand part[^.]*|Order "
    r"(?:read|for)[^.]*|Adjourned accordingly[^.]*)\.?(?:\s*\(proc text\))?"
)
LANGUAGES = r"English|Mandarin|Chinese|Malay|Tamil|Indonesian|Hindi|Hokkien|Teochew|Cantonese|vernacular"
CLOCK = r"\d{1,2}(?::\d{2}){1,2}(?:\s*[ap]\.?\s?m\.?)?|\d{1,2}[.:]\d{2}\s*[ap]\.?\s?m\.?"

_blank = terminal(r"\s+", "blank")
_gap = terminal(r"\s*")


def balanced(opens: str, closes: str) -> Parser:
    """The rule `note <- opens (text / note)* closes`, memoised for a text as a whole: all its places are found in
    one pass with a stack, so that neither deep nor unclosed brackets cost more than their characters."""
    bracket = re.compile(f"[{re.escape(opens + closes)}]")

    @lru_cache(2)
    def ends(text: str) -> dict[int, int]:
        stack: list[int] = []
        out: dict[int, int] = {}
        for m in bracket.finditer(text):
            if m.group() == opens:
                stack.append(m.start())
            elif stack:
                out[stack.pop()] = m.end()
        return out

    def parse(text: str, at: int) -> tuple[int, list[Node]] | None:
        if not text.startswith(opens, at) or (end := ends(text).get(at)) is None:
            return None
        return end, []

    return parse


_stamp = named("stamp", choice(*(terminal(rf"{re.escape(a)}\s*(?:{CLOCK})\s*{re.escape(b)}", flags=re.I) for a, b in ("[]", "()", "<>", "{}"))))
_language = terminal(rf"\(\s*(?:(?:speaking|spoke|spoken|speaks)\s+)?(?:in\s+)?(?:{LANGUAGES})\s*\)\s*:?", "language", re.I)
_sound = terminal(rf"\((?=[^()]*(?:{SOUNDS}))[^()]*\)", "note", re.I)
_note = choice(named("note", choice(balanced("[", "]"), balanced("{", "}"), balanced("<", ">"), terminal(r"\*[^*\n]+\*"))), _sound)
_hesitation = where(
    lambda text, at: not (at and (text[at - 1].isalnum() or text[at - 1] in "-'/")),
    terminal(rf"(?!Er\s+(?:Dr|Prof|[A-Z]))(?!ER\s+(?:DR|PROF))(?i:{HESITATION})(?:\.\.\.|…|,)?(?=\s|\Z|[\])\"])\s*", "hesitation"),
)
_word = terminal(r"[^\s\[\](){}<>*]+|[\[\](){}<>*]", "word")

# labels: a title and names, names in capitals, an office or whoever presides, brackets among them, then a colon;
# or a dash, if all is in capitals
_PLACE = re.compile(r"(?:\A|\n|[.!?…][\"”')\]]*\s|[\])>}*:]\s?)\s*\Z")
_TITLE = "|".join(sorted(map(re.escape, HONORIFICS), key=len, reverse=True))
_PLAIN = r"\s:\[\]{}<>\"“”()!?\d"
#: Letters and digits that a label has at most.
LABEL_LENGTH = 160


def optional(part: Parser) -> Parser:
    return lambda text, at: part(text, at) or (at, [])


def capital(text: str, at: int) -> bool:
    return text[at : at + 1].isupper()


_space = terminal(r"[^\S\n]+")
_no_dash = r"(?![-–—]+(?:\s|\Z))"
_closed = terminal(rf"\((?:[^{_PLAIN}]+|[^\S\n]+|\([^{_PLAIN}]*(?:[^\S\n]+[^{_PLAIN}]+)*\))*\)")
_title = terminal(rf"(?i:{_TITLE})(?:\.(?!\s+[a-z]))?(?=[\s(])")
_joining = terminal(r"(?i:bin|binte|binti|bte|bt|bnt|[sd]/o|a/[lp]|ibni|ibn|son|daughter|of)[.,]?(?=[\s:(])")
# a full stop ends a name's word only after a title or a single letter
_name_word = terminal(rf"{_no_dash}(?:(?i:{_TITLE})\.|[^{_PLAIN}]\.|[^{_PLAIN}]*[^{_PLAIN}.])(?!\.\s+[a-z])(?=[\s:(]|\Z)")
_big_word = choice(_joining, where(capital, _name_word))


def words_of(word: Parser, least: int) -> Parser:
    """At least so many words with blanks between them, brackets anywhere among them."""
    rest = many(sequence(optional(_space), choice(_closed, word)))
    return sequence(many(sequence(_closed, optional(_space))), word, *[sequence(many(sequence(optional(_space), _closed)), _space, word)] * (least - 1), rest)


_presiding = terminal(r"(?i:(?:(?:mr|mdm|mrs|ms|madam|mdme|the|hon|honourable)\.?\s+)*(?:acting\s+|deputy\s+|temporary\s+|assistant\s+)*(?:speaker|chair(?:man|woman|person)?|presiding officer))(?=[\s:(])")
_office_named = terminal(rf"(?=(?:[^:()\n]|\([^()\n]*\))*?{OFFICE.pattern})", flags=re.I)
_chair_label = sequence(_presiding, many(sequence(optional(_space), choice(_closed, sequence(terminal(r"of\s"), words_of(_name_word, 1))))))
_office_label = where(capital, sequence(_office_named, words_of(_name_word, 1)))
_name_label = choice(sequence(_title, _space, words_of(_name_word, 1)), words_of(_big_word, 2))
_colon = terminal(r"\s*:(?=\s|\Z)")
_dash = terminal(r"\s+[-–—]+(?=\s)")
_label = choice(*(sequence(named("label", body), end) for end in (_colon, _dash) for body in (_chair_label, _office_label, _name_label)))


def _labelled(text: str, at: int) -> tuple[int, list[Node]] | None:
    """A label, where a speech may begin. Only a label in capitals may end in a dash."""
    if not text[at : at + 1].isalpha() or _ending(text, at, at + LABEL_LENGTH) is None or at and not _PLACE.search(text[max(0, at - 12) : at]):
        return None
    r = _label(text, at)
    if r is None or r[0] - at > LABEL_LENGTH:
        return None
    label = r[1][0][1][0]
    return (r[0], [("label", label)]) if text[r[0] - 1] == ":" or label.isupper() else None


_ending = re.compile(r"[:\-–—]").search
row_grammar = many(choice(_blank, _stamp, _language, _note, _labelled, _hesitation, _word))
_whole_note = re.compile(rf"\s*(?:\(\s*(?:{PROCEEDINGS})\s*\)|{PROCEEDINGS})\s*\Z", re.I)
_in_round = re.compile(r"\s*\(([^()]|\([^()]*\))*\)\s*\Z")
_before_mark = re.compile(r"\s+(?=[.,!?;:])")


def speeches(speaker: str | None, text: str | None) -> list[tuple[str | None, bool, str]]:
    """(label, whether it stands in the text, clean text) of each speech in a row, empty ones left out.

    The first speech has the row's speaker as its label, or none. A row that is a note as a whole has no
    speech. A label at the very end of a text stays, with an empty speech, for what follows.
    """
    out: list[tuple[str | None, bool, str]] = []
    label, inside, said = (flat_form(speaker)[0].strip() or None if speaker else None), False, []
    if text and text.strip():
        flat = flat_form(text)[0]
        bare = re.sub(rf"^\s*[\[(<]\s*(?:{CLOCK})\s*[\])>]\s*", "", flat, flags=re.I)
        if _whole_note.match(bare) or _in_round.match(bare):
            return []
        nodes = row_grammar(flat, 0)[1]
        for kind, value in [*nodes, ("label", None)]:
            if kind == "label":
                clean = _before_mark.sub("", " ".join("".join(said).split()))
                if clean or (value is None and inside and nodes[-1][0] in ("label", "blank")):
                    out.append((label, inside, clean))
                label, inside, said = value, True, []
            elif kind in ("word", "blank"):
                said.append(value)
            elif kind != "hesitation":
                said.append(" ")
    return out


_SPEECH = T.StructType([T.StructField("report_id", T.StringType()), T.StructField("turn", T.IntegerType()), T.StructField("i", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("inside", T.BooleanType()), T.StructField("said", T.StringType())])


def row_speeches(rows: DataFrame) -> DataFrame:
    """report_id, turn, i, label, inside, said: the speeches of each row with report_id, turn, speaker, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(r, t, i, *s) for r, t, who, text in zip(*(c.to_pylist() for c in batch.columns)) for i, s in enumerate(speeches(who, text))]
            cols = list(zip(*found)) or [()] * 6
            types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], _SPEECH.names)

    return rows.select("report_id", F.col("turn").cast("int"), "speaker", "text").mapInArrow(run, _SPEECH)


#: Rows of a report that are ordered in one task.
BLOCK = 1024


def carried(rows: DataFrame, value: Column, out: str, before: bool = False) -> DataFrame:
    """The last non-null value up to each speech of a report, in order (or up to the one before).

    A report is worked on in blocks of BLOCK rows; what a block leaves to the next is one row.
    """
    order = F.struct("turn", "i")
    rows = rows.withColumn("__v", value)
    last = rows.groupBy("report_id", "block").agg(F.max(F.when(F.col("__v").isNotNull(), F.struct(order.alias("o"), F.col("__v").alias("v"))))["v"].alias("__last"))
    w = Window.partitionBy("report_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = last.select("report_id", "block", F.last("__last", ignorenulls=True).over(w).alias("__base"))
    inner = Window.partitionBy("report_id", "block").orderBy("turn", "i").rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    return rows.join(base, ["report_id", "block"]).withColumn(out, F.coalesce(F.last("__v", ignorenulls=True).over(inner), F.col("__base"))).drop("__v", "__base")


def clean_turns(turns: DataFrame, reports: DataFrame, roster: DataFrame) -> DataFrame:
    """report_id, first_turn, nth, speaker_id, text, n_words of each turn of draft reports.

    A speech without label goes on with the one before, and so does one labelled with the same speaker.
    A text label that names nobody is part of the speech; a row's speaker that names nobody gives a turn
    with null speaker_id. Speech before any label has null speaker_id too. Rows with null or empty text
    have no speech.
    """
    # drafts first: a redelivered row stays with its report, and the texts of all others need not be ordered
    own = holding(by_draft(turns.select("key", "report_id", "turn", "speaker", "text", "loaded_at"), reports, draft=True), "key")
    said = checkpointed(row_speeches(own))
    known = resolve_labels(said.select("label"), roster)
    who = F.when(F.col("kind") == "chair", F.lit("chair")).otherwise(F.col("member_id"))
    rows = said.join(known, "label", "left").withColumn("who", who)
    nobody = F.col("label").isNotNull() & F.col("who").isNull()
    rows = rows.select(
        "report_id", "turn", "i", F.floor(F.col("turn") / BLOCK).alias("block"),
        F.when(nobody & ~F.col("inside"), F.concat(F.lit("?"), F.col("label"))).otherwise(F.col("who")).alias("who"),
        F.when(nobody & F.col("inside"), F.concat_ws(" ", F.concat("label", F.lit(":")), F.when(F.col("said") != "", F.col("said")))).otherwise(F.col("said")).alias("said"),
    )
    rows = checkpointed(rows)
    heads = carried(rows, F.col("who"), "by").where("said <> ''").drop("who")
    heads = carried(heads.withColumn("by", F.coalesce("by", F.lit("?"))), F.col("by"), "prior", before=True)
    begins = F.col("prior").isNull() | (F.col("prior") != F.col("by"))
    nth = F.sum(begins.cast("int")).over(Window.partitionBy("report_id", "turn").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)) - 1
    heads = heads.withColumn("nth", nth)
    started = carried(heads, F.when(begins, F.struct("turn", "i", "nth")), "start")
    words = F.size(F.split("said", " "))
    out = started.groupBy("report_id", F.col("start.turn").alias("first_turn"), F.col("start.nth").cast("int").alias("nth"), "by").agg(
        F.sum(words).cast("int").alias("n_words"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "i", "said"))), lambda x: x["said"]), " ").alias("text")
    )
    return out.select("report_id", "first_turn", "nth", F.when(~F.col("by").startswith("?"), F.col("by")).alias("speaker_id"), "text", "n_words")
