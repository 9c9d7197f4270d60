"""Which member of a roster a typed name means.

A label's words and the roster's words meet in a symmetric-delete index: each word stands there under
every string that is left of it when few letters are deleted, so that words a small edit distance apart
share one. Of a label one word that must be read, the one that is near the fewest members, finds the
members that can be meant; the label's words are then assigned to each one's at least cost.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import accumulate, combinations
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.glyphs import transducer
from lectern.sources import checkpointed

# Titles, words that join a name to a father's, offices, and short forms of names.
HONORIFICS = set("mr mrs ms mdm mdme madam miss mx dr drs prof professor assoc associate asst er ir hon honourable rev sir dame datuk dato encik en puan pn cik tuan tn haji hj hajah hjh bg ltc col brig gen adj".split())
CONNECTORS = {"bin", "binte", "binti", "bte", "bt", "bnt", "s/o", "d/o", "a/l", "a/p", "ibni", "ibn"}
PHRASES = {"son of": "s/o", "daughter of": "d/o", "s / o": "s/o", "d / o": "d/o", "a / l": "a/l", "a / p": "a/p"}
SHORT_FORMS = {
    "alexander": "alex alec sandy xander", "andrew": "andy drew", "anthony": "tony", "benjamin": "ben benny benji", "catherine": "cathy kate katie kathy", "charles": "charlie chuck",
    "christopher": "chris kit topher", "christina": "chris tina chrissy", "daniel": "dan danny", "david": "dave davy", "deborah": "debbie deb", "edward": "ed eddie ted ned", "elizabeth": "liz lizzie beth betty eliza lisa",
    "frances": "fran fanny", "francis": "frank", "frederick": "fred freddie", "gabriel": "gabe", "gerald": "gerry jerry", "gregory": "greg", "henry": "harry hank", "jacob": "jake", "james": "jim jimmy jamie",
    "jennifer": "jen jenny", "john": "johnny jack", "jonathan": "jon jonny nathan", "joseph": "joe joey", "joshua": "josh", "katherine": "kathy kate katie kat kay kitty", "kenneth": "ken kenny", "lawrence": "larry laurie",
    "leonard": "leo len lenny", "margaret": "maggie meg peggy marge margie greta rita", "matthew": "matt", "michael": "mike mick micky", "nathaniel": "nat nate", "nicholas": "nick nicky", "patricia": "pat patty patsy tricia trish",
    "patrick": "pat paddy", "peter": "pete", "philip": "phil pip", "raymond": "ray", "rebecca": "becky becca", "richard": "rich rick dick ricky richie", "robert": "bob rob bobby robbie bert", "ronald": "ron ronnie",
    "samuel": "sam sammy", "stephen": "steve", "steven": "steve", "susan": "sue susie", "theodore": "ted teddy theo", "thomas": "tom tommy", "timothy": "tim", "victoria": "vicky tori", "vincent": "vince vinny",
    "william": "will bill billy liam willie", "muhammad": "mohd md mohamed mohammad mohammed muhamad muhd mohamad m'd",
}
_SHORT = {s: {k for k, v in SHORT_FORMS.items() if s in v.split()} for f in SHORT_FORMS.values() for s in f.split()}
CHAIR = re.compile(r"(?:(?:mr|mdm|mrs|ms|madam|mdme|the|hon|honourable)\.?\s+)*(?:acting\s+|deputy\s+|temporary\s+|assistant\s+)*(?:speaker|chair(?:man|woman|person)?|presiding officer)(?:\s+of\s+.*)?", re.I)
OFFICE = re.compile(r"\b(?:minister|ministers|secretary|secretaries|attorney-general|leader of|clerk|serjeant|whip|mayor|members|hon members|house|president|government|opposition|committee)\b", re.I)
_CLOCK = r"\d{1,2}[:.]\d{2}(?:[:.]\d{2})?\s*(?:[ap]\.?m\.?)?"
_STAMP = re.compile(rf"[\[(<]\s*{_CLOCK}\s*[\])>]|^\s*{_CLOCK}\s+(?=[A-Za-z])", re.I)
_PAREN = re.compile(r"\(([^()]*(?:\([^()]*\)[^()]*)*)\)")

_PARSED = T.StructType([T.StructField("kind", T.StringType()), T.StructField("words", T.ArrayType(T.StringType())), T.StructField("nick", T.ArrayType(T.StringType())), T.StructField("seat", T.StringType()), T.StructField("need", T.ArrayType(T.StructType([T.StructField("i", T.IntegerType()), T.StructField("w", T.StringType())])))])


def name_words(text: str) -> list[str]:
    """A name's words in small letters, without titles in front; the words that join names stay."""
    text = text.lower().replace("’", "'")
    for phrase, short in PHRASES.items():
        text = re.sub(rf"\b{phrase}\b", short, text)
    words = []
    for w in re.split(r"[\s,;]+", re.sub(r"\.(?=\S)", ". ", text)):
        if w in CONNECTORS or w.strip(".") in CONNECTORS:
            words.append(w.strip("."))
        else:
            words += [x for x in re.split(r"[^\w'/]+", w) if x.strip("'/")]
    # "Tan" and "Sri" are names too: a title only where the one precedes the other, or Sri follows a title
    while len(words) > 1:
        if words[0] in HONORIFICS:
            n = 2 if words[0] in ("dato", "datuk") and words[1] == "sri" and len(words) > 2 else 1
        elif words[:2] == ["tan", "sri"] and len(words) > 2:
            n = 2
        else:
            break
        del words[:n]
    return words


def parse_label(label: str | None) -> tuple[str, list[str], list[str], str | None]:
    """kind (`chair`, `name` or `none`), the name's words, those of bracketed short forms, and a bracketed rest.

    A name in brackets behind an office is the name; `(for …)` says for whom someone speaks.
    """
    if not label or not label.strip():
        return "none", [], [], None
    text = _STAMP.sub(" ", transducer()(label)).strip().rstrip(":").strip()
    inner = [x.strip() for x in _PAREN.findall(text) if x.strip()]
    outer = re.sub(r"\s+", " ", _PAREN.sub(" ", text)).strip(" ,:")
    inner = [x for x in inner if not re.match(r"for\b", x, re.I)]
    if CHAIR.fullmatch(outer):
        return "chair", [], [], None
    if not outer or text.startswith("["):
        return "none", [], [], None
    if OFFICE.search(outer):
        if not inner:
            return "none", [], [], None
        outer, inner = inner[0], inner[1:]
        if OFFICE.search(outer) or CHAIR.fullmatch(outer):
            return "none", [], [], None
    words = name_words(outer)
    nick = [w for x in inner if len(ws := name_words(x)) == 1 for w in ws]
    return ("name", words, nick, "|".join(" ".join(x.lower().split()) for x in inner)) if words else ("none", [], [], None)


def reach(word: str) -> int:
    """The edit distance within which a word of this length may be a typing error."""
    return 0 if len(word) < 3 else 1 if len(word) < 7 else 2


@lru_cache(100_000)
def deletes(word: str, n: int) -> frozenset[str]:
    """`word` and what is left of it without up to n letters."""
    return frozenset("".join(word[i] for i in range(len(word)) if i not in gone) for k in range(min(n, len(word) - 1) + 1) for gone in combinations(range(len(word)), k))


@lru_cache(200_000)
def distance(a: str, b: str) -> int:
    """Edits, with swapped neighbours as one."""
    prev2: list[int] = []
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, prev2[j - 2] + 1)
            row.append(v)
        prev2, prev = prev, row
    return prev[-1]


#: Costs of an assignment: a typing error, a short form, an initial, joined or split words, a word left out, words parted.
TYPO, SHORT, INITIAL, JOINED, LEFT_OUT, PARTED = 1.0, 0.2, 0.4, 0.3, 2.0, 0.5
NEVER = 99.0


class Reading(NamedTuple):
    """A way to write a name: its blocks of words that stay together, whether they may change places, whether a
    joining word may stand among them, what the way costs, whether its words must be written whole, and what
    each two words cost that follow each other but not in the name."""

    blocks: tuple[tuple[str, ...], ...]
    moves: bool = True
    joined: bool = False
    extra: float = 0.0
    whole: bool = False
    parted: float = 0.0


@lru_cache(100_000)
def member_readings(full_name: str) -> tuple[Reading, ...]:
    """The ways in which a name is written.

    Names with a joining word have two parts, either of which may lead. Otherwise a family name may lead or
    end, a first name of another language before it may stand anywhere or be left out, and a first name
    may stand alone with the family name; given names keep their order. The words of longer names may change
    places at a cost.
    """
    words = tuple(name_words(full_name))
    at = next((i for i, w in enumerate(words) if w in CONNECTORS), None)
    if at is not None:
        return (Reading(tuple(b for b in (words[:at], words[at + 1 :]) if b), joined=True),)
    if len(words) == 4:
        w, s, g = words[:1], words[1:2], words[2:]
        return Reading((w, s, g)), Reading((s, g), extra=LEFT_OUT), Reading((w, s), False, extra=LEFT_OUT + 0.5, whole=True), Reading((g[:1], s), False, extra=LEFT_OUT + 1, whole=True)
    if len(words) == 3:
        s, g = words[:1], words[1:]
        return Reading((s, g)), Reading((g[:1], s), False, extra=LEFT_OUT + 1, whole=True)
    return (Reading(tuple((w,) for w in words), parted=PARTED if len(words) > 2 else 0.0),) if words else ()


def word_cost(typed: str, real: str, known: frozenset[str]) -> float:
    """What it costs to read a typed word as a real one; a word of the roster is never an error for another."""
    if typed == real:
        return 0.0
    if len(typed) == 1:
        return INITIAL if real.startswith(typed) else NEVER
    if real in _SHORT.get(typed, ()):
        return SHORT
    if typed in known:
        return NEVER
    n = min(reach(typed) if len(typed) > len(real) else reach(real), 2)
    if abs(len(typed) - len(real)) > n:
        return NEVER
    d = distance(typed, real)
    return TYPO * d if d <= n else NEVER


def like_connector(word: str) -> bool:
    """Whether a word may be a joining word, typed rightly or not."""
    return word in CONNECTORS or word == "b" or len(word) > 2 and min(distance(word, x) for x in ("bin", "binte", "s/o", "d/o")) <= 1


def assign(words: list[str], reading: Reading, known: frozenset[str], left_out: frozenset[str] = frozenset()) -> tuple[float, int]:
    """The least cost of assigning `words` to a name's words, and how many of those were read whole.

    Every typed word must be read: as one real word, as two, as half of one with the next, or as a joining
    word where the name has one. Every real word but those of `left_out` must be given exactly once. The
    optimum is exact: over the typed words in turn, the least cost is kept for each set of real words given
    so far and the last of them, on which depends what the next one costs by its place.
    """
    blocks = [b for b in (tuple(w for w in b if w not in left_out) for b in reading.blocks) if b]
    real = [w for b in blocks for w in b]
    last = {e - 1 for e in accumulate(map(len, blocks))}
    first = {0} | {e + 1 for e in last}
    n, m = len(words), len(real)
    if not m or n > 2 * m + (2 if reading.joined else 0) or 2 * n < m:
        return NEVER, 0
    follow = [[(0.0 if b == a + 1 else reading.parted if reading.moves and a in last and b in first else NEVER) for b in range(m)] for a in range(m)]
    begin = [0.0 if b == 0 or reading.moves and b in first else NEVER for b in range(m)]
    full = (1 << m) - 1
    states: list[dict[tuple[int, int], tuple[float, int]]] = [{} for _ in range(n + 1)]
    states[0][0, -1] = (0.0, 0)

    def reach_(i: int, key: tuple[int, int], cost: float, whole: int) -> None:
        if cost < NEVER:
            old = states[i].get(key)
            if old is None or (cost, -whole) < (old[0], -old[1]):
                states[i][key] = (cost, whole)

    for i in range(n):
        if not states[i]:
            continue
        w = words[i]
        single = [word_cost(w, x, known) for x in real]
        new = w not in known
        split = [i + 1 < n and new and len(x) > 3 and words[i + 1] not in known and w + words[i + 1] == x for x in real]
        joins = reading.joined and (w in CONNECTORS or new and like_connector(w))
        for (used, at), (cost, whole) in states[i].items():
            if joins and used:
                reach_(i + 1, (used, at), cost + (0.0 if w in CONNECTORS else 0.1), whole)
            for b in range(m):
                place = begin[b] if at < 0 else follow[at][b]
                if used >> b & 1 or place >= NEVER:
                    continue
                taken, so_far = used | 1 << b, cost + place
                reach_(i + 1, (taken, b), so_far + single[b], whole + (len(w) > 1))
                if split[b]:
                    reach_(i + 2, (taken, b), so_far + JOINED, whole + 1)
                if new and len(w) > 3:
                    for c in range(m):
                        if not taken >> c & 1 and follow[b][c] < NEVER and abs(len(real[b]) + len(real[c]) - len(w)) < 2 and (d := distance(w, real[b] + real[c])) <= 1:
                            reach_(i + 1, (taken | 1 << c, c), so_far + follow[b][c] + JOINED + TYPO * d, whole + 2)
    return min((v for (used, _), v in states[n].items() if used == full), key=lambda v: (v[0], -v[1]), default=(NEVER, 0))


def label_cost(words: list[str], nick: list[str], full_name: str, known: frozenset[str]) -> float | None:
    """The least cost of a label for a member; None if it can't mean this member.

    A word of the name may be left out if a bracketed word stands for it.
    """
    best = NEVER
    for reading in member_readings(full_name):
        size = sum(map(len, reading.blocks))
        said = [w for b in reading.blocks for w in b if any(w in _SHORT.get(x, ()) or w == x for x in nick)]
        for out in [frozenset(), *({frozenset(said)} if said else ())]:
            cost, whole = assign(words, reading, known, out)
            if cost < NEVER and whole >= (size - len(out) if reading.whole else 1):
                best = min(best, cost + reading.extra + LEFT_OUT * len(out))
    return None if best >= NEVER else best


def needed_forms(words: list[str]) -> list[tuple[int, str]]:
    """(place, form) of what a label's words are looked up as, for each place that must be read.

    Whatever member a label means, each of these places is near a word of the name by one of its forms: so
    any one of them finds all members that can be meant. Initials and joining words, mistyped ones too, need
    not be read by themselves; if nothing else is there, all other words make one place. A form that must be
    met letter by letter begins with "=": two neighbours as one word, and what a word is short for.
    """

    def forms(i: int) -> set[str]:
        joined = [a + b for a, b in zip(words[max(0, i - 1) : i + 1], words[max(1, i) : i + 2])]
        return {words[i], *(f"={x}" for x in (*joined, *_SHORT.get(words[i], ())))}

    long = [i for i, w in enumerate(words) if len(w) > 1 and w not in CONNECTORS]
    must = [i for i in long if not like_connector(words[i])]
    return sorted((i, x) for i in must for x in forms(i)) if must else sorted((0, x) for i in long for x in forms(i))


def roster_forms(full_name: str) -> list[str]:
    """A member's words, and each two that may follow each other as one."""
    out: set[str] = set()
    for reading in member_readings(full_name):
        flat = [(k, w) for k, b in enumerate(reading.blocks) for w in b]
        out |= {w for _, w in flat}
        out |= {a + b for i, (_, a) in enumerate(flat) for j, (_, b) in enumerate(flat) if i != j and (j == i + 1 or reading.moves)}
    return sorted(x for x in out if len(x) > 1)


@F.pandas_udf(_PARSED)
def parsed_label(labels: pd.Series) -> pd.DataFrame:
    out = []
    for x in labels:
        kind, words, nick, seat = parse_label(x)
        need = needed_forms(words) if kind == "name" else []
        out.append((kind, words, nick, seat, [{"i": i, "w": w} for i, w in need]))
    return pd.DataFrame(out, columns=_PARSED.names)


@F.pandas_udf(T.ArrayType(T.StringType()))
def delete_keys(words: pd.Series) -> pd.Series:
    """The keys of a form in the index: its deletions, or itself where it begins with "="."""
    return pd.Series([[w] if w.startswith("=") else sorted(deletes(w, reach(w))) for w in words])


@F.pandas_udf(T.BooleanType())
def close(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether words that share a key are as near as a typing error."""
    return pd.Series([x.startswith("=") or distance(x, y) <= max(reach(x), reach(y)) for x, y in zip(a, b)], dtype="bool")


_PERSON = T.StructType([T.StructField("own", T.ArrayType(T.StringType())), T.StructField("forms", T.ArrayType(T.StringType()))])


@F.pandas_udf(_PERSON)
def person_forms(names: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(name_words(n), roster_forms(n)) for n in names], columns=_PERSON.names)


@F.pandas_udf(T.DoubleType())
def costs(words: pd.Series, nick: pd.Series, names: pd.Series, known: pd.Series) -> pd.Series:
    return pd.Series([label_cost(list(w), list(n), name, frozenset(k)) for w, n, name, k in zip(words, nick, names, known)], dtype="float64")


def near_forms(typed: DataFrame, people: DataFrame) -> DataFrame:
    """w, r, n: the roster's forms near each form that labels are looked up by, and how many members have them.

    A word of the roster is near itself alone. Distinct forms meet, not labels or members.
    """
    real = people.select("member_id", F.explode("forms").alias("r"), "own")
    real = real.groupBy("r").agg(F.countDistinct("member_id").alias("n"), F.bool_or(F.array_contains("own", F.col("r"))).alias("single"))
    keys = real.select("r", "n", "single", F.explode(F.array_append(delete_keys("r"), F.concat(F.lit("="), F.col("r")))).alias("d"))
    asked = typed.select("w").distinct().select("w", F.explode(delete_keys("w")).alias("d"))
    met = asked.join(keys, "d").select("w", "r", "n", "single").distinct().where(close("w", "r"))
    itself = F.bool_or(F.col("single") & (F.col("w") == F.col("r"))).over(Window.partitionBy("w"))
    return met.withColumn("itself", itself).where(~F.col("itself") | (F.col("w") == F.col("r"))).select("w", "r", "n")


def resolve_labels(labels: DataFrame, roster: DataFrame) -> DataFrame:
    """speaker_label, kind and member_id of each distinct label: `chair`, a member, or neither (null).

    `labels` has one column. A label means the member to whose name it is assigned at least cost; if several
    are, the one whose seat it names; if that leaves several, none. Null and blank labels mean nobody. Of
    roster rows with one member_id the one with the greatest name holds.
    """
    name = labels.columns[0]
    parsed = labels.select(F.col(name).alias("label")).where("label IS NOT NULL").distinct().withColumn("p", parsed_label("label")).select("label", "p.*")
    # tables that are used several times are written once: else every use would parse again
    empty = F.array().cast("array<string>")
    parsed = checkpointed(parsed.withColumns({"words": F.coalesce("words", empty), "nick": F.coalesce("nick", empty)}))
    people = roster.where("full_name IS NOT NULL AND member_id IS NOT NULL").groupBy("member_id").agg(F.max(F.struct("full_name", F.lower("constituency").alias("place"))).alias("x"))
    people = checkpointed(people.select("member_id", "x.*").withColumn("p", person_forms("full_name")).select("member_id", "full_name", "place", "p.*"))
    asked = parsed.where("kind = 'name'")
    typed = asked.select("label", F.explode("need").alias("f")).select("label", "f.i", "f.w")
    near = checkpointed(near_forms(typed, people))
    # the place of a label that is near the fewest members; a place near nobody's name means that nobody is meant
    places = typed.join(near, "w", "left").repartition("label").groupBy("label", "i").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.collect_set("r").alias("r"))
    rarest = places.groupBy("label").agg(F.min(F.struct("n", "i", "r")).alias("x")).where("x.n > 0").select("label", F.explode("x.r").alias("r"))
    pairs = rarest.join(people.select("member_id", F.explode("forms").alias("r")), "r").select("label", "member_id").distinct()
    vocabulary = people.select(F.explode("own").alias("w")).distinct()
    known = asked.select("label", F.explode("words").alias("w")).join(vocabulary, "w").groupBy("label").agg(F.collect_set("w").alias("known"))
    named = pairs.join(asked.select("label", "words", "nick", "seat"), "label").join(people.select("member_id", "full_name", "place"), "member_id")
    named = named.join(known, "label", "left").withColumn("known", F.coalesce("known", empty))
    fits = named.withColumn("cost", costs("words", "nick", "full_name", "known")).where("cost IS NOT NULL")
    fits = fits.withColumn("cost", F.round("cost", 3) - F.when(F.coalesce(F.expr("instr(seat, place) > 0"), F.lit(False)), 0.05).otherwise(0.0))
    ties = fits.repartition("label").groupBy("label", F.round("cost", 3).alias("cost")).agg(F.min("member_id").alias("member_id"), F.count("*").alias("n"))
    best = ties.groupBy("label").agg(F.min(F.struct("cost", "n", "member_id")).alias("x")).where("x.n = 1").select("label", "x.member_id")
    return parsed.select("label", "kind").join(best, "label", "left")


def speaker_members(turns: DataFrame, roster: DataFrame) -> DataFrame:
    """speaker, member_id of each distinct label of turns that names a member of the roster."""
    found = resolve_labels(turns.select("speaker"), roster)
    return found.where("member_id IS NOT NULL").select(F.col("label").alias("speaker"), "member_id")
