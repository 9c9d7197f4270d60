"""Rules over sentences, turns and labels: significance, selection, corrections, members, questions, divisions, dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import significance as G
from lectern.functions import text as X
from lectern.operators.current import Tables, current_sql
from lectern.plans.registry import Registry
from lectern.sources import load

R = Registry()


def q(pattern: str) -> str:
    """A pattern as an SQL literal."""
    return "'" + pattern.replace("'", "''") + "'"


def _hit(s: str, pattern: str) -> str:
    return f"regexp_matches({s}, {q(pattern)})"


# significance

_S = X.STRIPPED_SQL
_REST = f"regexp_replace(regexp_replace({_S}, {q(G.RESTATEMENT)}, ''), '^[ ,:;-]+', '')"
SUBSTANTIVE_SQL = f"({_hit(_REST, G.COMMITMENT)} OR {_hit(_REST, G.SUBSTANCE)})"
CORRECTS_SQL = f"({_hit(_S, G.SELF_CORRECTION)} AND NOT {SUBSTANTIVE_SQL})"
RESTATES_SQL = _hit(_S, G.RESTATEMENT)
_HOUSE = f"(coalesce({_hit('trim(speaker)', G.CHAIR)}, true) AND ({_hit(_S, G.FLOOR)} OR {_hit(_S, G.QUESTION_READ)} OR {_hit(_S, G.CONSENT)}))"
# the formats take the sentence as {0}; patterns have braces of their own, so it is put in by hand
_at = lambda sql, s="s": sql.replace("{0}", s)
REASON_SQL = _at(f"CASE WHEN {_HOUSE} THEN 'chair_housekeeping' WHEN {CORRECTS_SQL} THEN 'self_correction' WHEN {RESTATES_SQL} AND NOT {SUBSTANTIVE_SQL} THEN 'restatement' END")
_WORDS_SQL = X.WORD_COUNT_SQL.format("s")
SCREEN_SQL = f"CASE WHEN {_WORDS_SQL} < {G.LEAST_WORDS} THEN 'too_short' WHEN {_hit('s', G.NOISE)} THEN 'courtesy' WHEN {_hit('s', G.PROCEDURE)} THEN 'procedural' ELSE {REASON_SQL} END"
# letters outside ASCII are letters at the border of a word too, which this engine's \b doesn't know
_LETTERS_SQL = r"regexp_replace(s, '[\x{C0}-\x{24F}\x{370}-\x{1FFF}\x{3040}-\x{FFDC}]', 'q', 'g')"
_SALIENCE_SQL = (
    f"CAST(2.0 * least(len(regexp_extract_all({_LETTERS_SQL}, {q(G.CUES)})), 4) + CASE WHEN {_hit(_LETTERS_SQL, G.MONEY)} THEN 3.0 ELSE 0 END + CASE WHEN {_hit(_LETTERS_SQL, G.PROMISE)} THEN 2.5 ELSE 0 END"
    f" + 2.0 * (1.0 - <position>) + CASE WHEN {_WORDS_SQL} BETWEEN 12 AND 40 THEN 1.0 ELSE 0 END - CASE WHEN {_WORDS_SQL} > 50 THEN 1.0 ELSE 0 END AS DOUBLE)"
)


def salience_sql(position: str) -> str:
    return _SALIENCE_SQL.replace("<position>", position)


def turn_sentences(turns: DataFrame, *keep: str) -> DataFrame:
    return turns.where("text IS NOT NULL").select(*keep, F.posexplode(X.sentences("text")).alias("i", "s"))


@R.query("significance_single", current_sql(X.SENT_SQL + f" SELECT key, CAST(i AS INTEGER) AS i, {REASON_SQL} AS reason FROM sent_"))
def significance_single(spark: SparkSession, d: str) -> DataFrame:
    return turn_sentences(Tables(spark, d).turn, "key", "speaker").select("key", "i", G.reason("s", "speaker").alias("reason"))


def pairs_of(turns: DataFrame) -> DataFrame:
    """key, i, corrects, restates, reason, before, after of each sentence of turns (key, speaker, text): whether it
    takes something back, points back, and whether its neighbours take something back."""
    w = Window.partitionBy("key").orderBy("i")
    s = turn_sentences(turns, "key", "speaker").select("key", "i", G.corrects_itself("s").alias("corrects"), G.restates("s").alias("restates"), G.reason("s", "speaker").alias("reason"))
    near = lambda f: F.coalesce(f("corrects").over(w), F.lit(False))
    return s.withColumns({"before": near(F.lag), "after": near(F.lead)})


def turn_reasons(turns: DataFrame) -> DataFrame:
    """key, i, reason of each sentence of turns, with what stands around it.

    A sentence that points back, next to one of the same turn in which the speaker takes something back, is
    what is taken back, and belongs to it whatever figures it has. And in a turn whose text takes something
    back anywhere, by the finer split, every sentence that points back does.
    """
    back = turns.where("text IS NOT NULL").select("key", F.exists(G.minimal_sentences("text"), G.corrects_itself).alias("back")).where("back")
    s = pairs_of(turns).join(back, "key", "left")
    paired = F.col("corrects") | (F.col("restates") & (F.col("before") | F.col("after")))
    late = F.coalesce("back", F.lit(False)) & F.col("restates")
    return s.select("key", "i", F.when(paired, "self_correction").when(F.col("reason").isNotNull(), F.col("reason")).when(late, "self_correction").alias("reason"))


_PAIRS_SQL = _at(
    f""", c AS (SELECT key, i, {CORRECTS_SQL} AS corrects, {RESTATES_SQL} AS restates, {REASON_SQL} AS reason FROM sent_),
n AS (SELECT *, coalesce(lag(corrects) OVER w, false) AS before_, coalesce(lead(corrects) OVER w, false) AS after_ FROM c WINDOW w AS (PARTITION BY key ORDER BY i))"""
)
_BACK_SQL = f""", f AS (SELECT key, unnest(string_split(regexp_replace({_at(_S, 'text')}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS s FROM turn_ WHERE text IS NOT NULL), b AS (SELECT DISTINCT key FROM f WHERE {_at(CORRECTS_SQL)})"""


@R.query(
    "significance_turn",
    current_sql(
        X.SENT_SQL
        + _PAIRS_SQL
        + _BACK_SQL
        + """ SELECT n.key, CAST(n.i AS INTEGER) AS i, CASE WHEN corrects OR (restates AND (before_ OR after_)) THEN 'self_correction' WHEN reason IS NOT NULL THEN reason
WHEN b.key IS NOT NULL AND restates THEN 'self_correction' END AS reason FROM n LEFT JOIN b ON b.key = n.key"""
    ),
)
def significance_turn(spark: SparkSession, d: str) -> DataFrame:
    return turn_reasons(Tables(spark, d).turn)


@R.query(
    "correction_pairs",
    current_sql(X.SENT_SQL + _PAIRS_SQL +
        " SELECT key, CAST(i AS INTEGER) AS i, CAST(a AS INTEGER) AS anchor FROM (SELECT key, i, corrects, restates, unnest([CASE WHEN before_ THEN i - 1 END, "
        "CASE WHEN after_ THEN i + 1 END]) AS a FROM n) WHERE restates AND NOT corrects AND a IS NOT NULL"),
)
def correction_pairs(spark: SparkSession, d: str) -> DataFrame:
    """What is taken back: a sentence that points back, and the self-correction before or after it."""
    anchors = F.array_compact(F.array(F.when(F.col("before"), F.col("i") - 1), F.when(F.col("after"), F.col("i") + 1)))
    return pairs_of(Tables(spark, d).turn).where("restates AND NOT corrects").select("key", "i", F.explode(anchors).alias("anchor"))


# selection


@R.query("salience_score", current_sql(X.SENT_SQL + f" SELECT key, CAST(i AS INTEGER) AS i, {salience_sql('0.0')} AS score FROM sent_"))
def salience_score(spark: SparkSession, d: str) -> DataFrame:
    return turn_sentences(Tables(spark, d).turn, "key").select("key", "i", G.salience("s").alias("score"))


@R.query("procedural_screen", current_sql(X.SENT_SQL + f" SELECT key, CAST(i AS INTEGER) AS i, coalesce({SCREEN_SQL}, 'kept') AS screen FROM sent_"))
def procedural_screen(spark: SparkSession, d: str) -> DataFrame:
    return turn_sentences(Tables(spark, d).turn, "key", "speaker").select("key", "i", F.coalesce(G.screen("s", "speaker"), F.lit("kept")).alias("screen"))


#: Sentences that are selected of a report.
SELECTED = 24
_SELECT_SQL = f""", own AS (SELECT key, report_id, turn, text, last_value(nullif(trim(speaker), '') IGNORE NULLS) OVER (PARTITION BY report_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS speaker, is_procedural FROM turn_),
se AS (SELECT key, report_id, turn, speaker, unnest(x) AS s, generate_subscripts(x, 1) - 1 AS i FROM (SELECT *, {X.SENTENCES_SQL.format('text')} AS x FROM own WHERE text IS NOT NULL AND NOT coalesce(is_procedural, false) AND NOT {_hit('text', G.PROCEDURE)})),
k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY i) - 1 AS j, count(*) OVER (PARTITION BY key) AS n FROM se WHERE {SCREEN_SQL} IS NULL),
sc AS (SELECT report_id, key, turn, i, s, round({salience_sql('j * 1.0 / n')}, 6) AS score FROM k),
f AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, i) = 1), a AS (SELECT *, 0 AS pass FROM f WHERE score > 2),
p AS (SELECT report_id, key, turn, i, score, pass, turn AS o FROM a UNION ALL SELECT report_id, key, turn, i, score, 1, 0 FROM sc WHERE score > 3 AND NOT EXISTS (SELECT 1 FROM a WHERE a.report_id = sc.report_id AND a.s = sc.s))
SELECT report_id, key, CAST(i AS INTEGER) AS i, pass, score FROM p QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY pass, o, score DESC, turn, i) <= {SELECTED}"""


@R.query("select_two_pass", current_sql(_SELECT_SQL))
def select_two_pass(spark: SparkSession, d: str) -> DataFrame:
    """The best sentence above 2 of each turn, in the order of turns, then others above 3 by score, of other words than
    those; so many a report. Procedural turns and screened sentences don't count; a turn without speaker goes on with
    the one before."""
    from lectern.operators.sequences import carried_forward

    t = Tables(spark, d).turn.select("key", "report_id", "turn", "is_procedural", "text", F.nullif(F.trim("speaker"), F.lit("")).alias("speaker"))
    t = carried_forward(t, "report_id", "turn", ["speaker"]).where(F.col("text").isNotNull() & ~F.coalesce("is_procedural", F.lit(False)) & ~F.col("text").rlike(G.PROCEDURE))
    s = turn_sentences(t, "report_id", "key", "turn", "speaker").where(G.screen("s", "speaker").isNull())
    w = Window.partitionBy("key")
    s = s.withColumns({"j": F.row_number().over(w.orderBy("i")) - 1, "n": F.count("*").over(w)})
    s = s.select("report_id", "key", "turn", "i", F.md5("s").alias("s"), F.round(G.salience("s", F.col("j") / F.col("n")), 6).alias("score"))
    best = F.row_number().over(w.orderBy(F.desc("score"), "i")) == 1
    s = s.withColumn("first", best & (F.col("score") > 2)).where("first OR score > 3")
    # words that the first pass has of a report, wherever they stand
    taken = s.where("first").select("report_id", "s").distinct().withColumn("taken", F.lit(True))
    s = s.join(taken, ["report_id", "s"], "left").where("first OR taken IS NULL").withColumn("pass", F.when(F.col("first"), 0).otherwise(1))
    rank = F.row_number().over(Window.partitionBy("report_id").orderBy("pass", F.when(F.col("first"), F.col("turn")).otherwise(0), F.desc("score"), "turn", "i"))
    return s.withColumn("pos", rank).where(F.col("pos") <= SELECTED).select("report_id", "key", "i", "pass", "score")


# divisions

# Words for numbers, and how the result of a division is declared.
NUMBER_WORDS = "no none zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
DECLARED = r'(?i)There\s+(?:are|is)\s+([A-Za-z0-9,]+)\s*"?Ayes?"?\s*,\s*([A-Za-z0-9,]+)\s*"?Noes?"?\s*(?:,?\s*(?:and\s+)?([A-Za-z0-9,]+)\s*"?Abstentions?"?)?'
_VALUES = {w: max(0, i - 2) for i, w in enumerate(NUMBER_WORDS)}


def number_of(c: Column) -> Column:
    """Digits or a number word as a number; null where it is neither."""
    words = F.create_map(*(F.lit(x) for kv in _VALUES.items() for x in kv))
    t = F.lower(F.regexp_replace(F.trim(c), "^,+|,+$", ""))
    return F.coalesce(F.try_element_at(words, t), F.when(t.rlike("^[0-9]+$"), t.try_cast("int")))


def declared_divisions(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, ayes, noes, abstentions of each declaration whose ayes and noes can be read; an abstention that isn't
    stated is null, not zero. Null texts have none."""
    parts = [F.regexp_extract_all(text, F.lit(DECLARED), F.lit(i)) for i in (1, 2, 3)]
    x = rows.where(F.col(text).isNotNull()).select(key, F.posexplode(F.arrays_zip(*(p.alias(n) for p, n in zip(parts, "abc")))).alias("pos", "x"))
    return x.select(key, "pos", number_of(F.col("x.a")).alias("ayes"), number_of(F.col("x.b")).alias("noes"), number_of(F.nullif(F.col("x.c"), F.lit(""))).alias("abstentions")).where("ayes IS NOT NULL AND noes IS NOT NULL")


_TOKEN_SQL = "lower(regexp_replace(trim({0}), '^,+|,+$', '', 'g'))"
_NUMBER_SQL = "coalesce(MAP {{" + ", ".join(f"'{k}': {v}" for k, v in _VALUES.items()) + "}}[" + _TOKEN_SQL + "], CASE WHEN regexp_matches(" + _TOKEN_SQL + ", '^[0-9]+$') THEN try_cast(" + _TOKEN_SQL + " AS INTEGER) END)"
_DIV_SQL = (
    f", m AS (SELECT key, report_id, turn, unnest(regexp_extract_all(text, {q(DECLARED)}, 1)) AS a, unnest(regexp_extract_all(text, {q(DECLARED)}, 2)) AS b, unnest(regexp_extract_all(text, {q(DECLARED)}, 3)) AS c,"
    f" generate_subscripts(regexp_extract_all(text, {q(DECLARED)}, 1), 1) - 1 AS pos FROM turn_ WHERE text IS NOT NULL),"
    f" n AS (SELECT key, report_id, turn, pos, {_NUMBER_SQL.format('a')} AS ayes, {_NUMBER_SQL.format('b')} AS noes, {_NUMBER_SQL.format('c')} AS abstentions FROM m)"
)


@R.query("divisions_extract", current_sql(_DIV_SQL + " SELECT key, CAST(pos AS INTEGER) AS pos, ayes, noes, abstentions FROM n WHERE ayes IS NOT NULL AND noes IS NOT NULL"))
def divisions_extract(spark: SparkSession, d: str) -> DataFrame:
    return declared_divisions(Tables(spark, d).turn, "key", "text")


@R.query("divisions_dedup", current_sql(_DIV_SQL +
    " SELECT report_id, min((turn, key, pos))[2] AS key, ayes, noes, abstentions, count(*) AS n FROM n WHERE ayes IS NOT NULL AND noes IS NOT NULL GROUP BY "
    "report_id, ayes, noes, abstentions"))
def divisions_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The different results that a report declares, and where each is first."""
    t = Tables(spark, d).turn.select("key", "report_id", "turn", "text")
    found = declared_divisions(t.select(F.struct("report_id", "turn", "key").alias("k"), "text"), "k", "text")
    g = found.groupBy(F.col("k.report_id").alias("report_id"), "ayes", "noes", "abstentions")
    return g.agg(F.min(F.struct("k.turn", "k.key", "pos"))["key"].alias("key"), F.count("*").alias("n"))


# announced dates

# How sittings are announced.
_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
SITTING_RANGE = rf"(?i)sitting from\s+(\d{{1,2}}\s+(?:{_MONTHS}))(?:\s+(\d{{4}}))?\s+to\s+(\d{{1,2}}\s+(?:{_MONTHS}))\s+(\d{{4}})"
SITTING_ON = rf"(?i)sitting (?:on|from)\s+(\d{{1,2}}\s+(?:{_MONTHS})\s+\d{{4}})"
ADJOURNED_TO = rf"(?i)adjourned to\s+(\d{{1,2}}\s+(?:{_MONTHS})\s+\d{{4}})"
ADJOURNED_OPEN = r"(?i)adjourned to a date to be fixed"
ANNOUNCES = r"(?i)sitting (?:on|from)\s+\d|adjourned to"


def _day(c: Column) -> Column:
    return F.try_to_date(F.initcap(F.regexp_replace(c, r"\s+", " ")), "d MMMM yyyy")


def announced_days(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, day, note: the weekdays of the first range that a text announces; without one every single day named; without
    those the day to which is adjourned. A range whose beginning has no year has that of its end, or, if it would
    begin after it, the year before. A text that announces something but no day that can be read has one row with a
    note and no day: not knowing isn't the same as no sitting. Others have none."""
    part = lambda i: F.nullif(F.regexp_extract(text, SITTING_RANGE, i), F.lit(""))
    end = _day(F.concat_ws(" ", part(3), part(4)))
    year = lambda y: _day(F.concat_ws(" ", part(1), y))
    same = year(part(4))
    begin = F.when(part(2).isNotNull(), year(part(2))).when(same > end, year((part(4).cast("int") - 1).cast("string"))).otherwise(same)
    days = F.when(begin <= end, F.filter(F.sequence(begin, end), lambda x: F.weekday(x) < 5))
    each = lambda p: F.array_compact(F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), _day))
    some = lambda a: F.when(F.size(a) > 0, a)
    found = F.array_distinct(F.coalesce(some(days), some(each(SITTING_ON)), some(F.slice(each(ADJOURNED_TO), 1, 1)), F.array().cast("array<date>")))
    note = F.when(F.col(text).rlike(ADJOURNED_OPEN), "to_be_fixed").otherwise("not_read")
    x = rows.where(F.col(text).rlike(ANNOUNCES)).select(key, found.alias("days"), note.alias("note"))
    x = x.select(key, F.explode_outer("days").alias("day"), "note")
    return x.select(key, F.date_format("day", "yyyy-MM-dd").alias("day"), F.when(F.col("day").isNull(), F.col("note")).alias("note"))


_DAY_SQL = "CAST(try_strptime(regexp_replace({0}, '\\s+', ' ', 'g'), '%d %B %Y') AS DATE)"


def _announced_sql() -> str:
    part = lambda i: f"regexp_extract(text, {q(SITTING_RANGE)}, {i})"
    day = _DAY_SQL.format
    same = day(f"{part(1)} || ' ' || {part(4)}")
    before = day(f"{part(1)} || ' ' || CAST(try_cast({part(4)} AS INTEGER) - 1 AS VARCHAR)")
    own = day(f"{part(1)} || ' ' || {part(2)}")
    return f""", x AS (SELECT key, text, {day(f"{part(3)} || ' ' || {part(4)}")} AS z, {same} AS a1, {before} AS a2, {own} AS a3, {part(2)} <> '' AS dated FROM turn_ WHERE {_hit('text', ANNOUNCES)}),
r AS (SELECT key, text, z, CASE WHEN dated THEN a3 WHEN a1 > z THEN a2 ELSE a1 END AS a FROM x),
l AS (SELECT key, text, list_transform(list_filter(generate_series(a, z, INTERVAL 1 DAY), lambda v: dayofweek(v) BETWEEN 1 AND 5), lambda v: CAST(v AS DATE)) AS d1,
list_filter(list_transform(regexp_extract_all(text, {q(SITTING_ON)}, 1), lambda v: {day('v')}), lambda v: v IS NOT NULL) AS d2, list_filter(list_transform(regexp_extract_all(text, {q(ADJOURNED_TO)}, 1), lambda v: {day('v')}), lambda v: v IS NOT NULL)[1:1] AS d3 FROM r),
y AS (SELECT key, text, CASE WHEN len(d1) > 0 THEN d1 WHEN len(d2) > 0 THEN d2 WHEN len(d3) > 0 THEN d3 ELSE [CAST(NULL AS DATE)] END AS ds FROM l),
u AS (SELECT DISTINCT key, text, unnest(ds) AS v FROM y)
SELECT key, strftime(v, '%Y-%m-%d') AS day, CASE WHEN v IS NULL THEN CASE WHEN {_hit('text', ADJOURNED_OPEN)} THEN 'to_be_fixed' ELSE 'not_read' END END AS note FROM u"""


@R.query("announce_dates", current_sql(_announced_sql()))
def announce_dates(spark: SparkSession, d: str) -> DataFrame:
    return announced_days(Tables(spark, d).turn, "key", "text")


# replies


@R.query("json_recover")
def json_recover(spark: SparkSession, d: str) -> DataFrame:
    """The JSON objects of each payload, as far as they can be recovered."""
    from lectern.functions.recovery import recovered

    found = load(spark, d, "events").select("event_id", recovered("props").alias("x"))
    return found.select("event_id", F.size("x").alias("objects"), F.from_json(F.try_element_at("x", F.lit(1)), "k bigint")["k"].alias("k"))


# members

# Titles, labels of no person, and invisible marks.
_TITLES = r"(?i)\b(Mr|Mrs|Ms|Miss|Mdm|Madam|Dr|Professor|Prof|Asst Prof|Assoc Prof|Er Dr|Er)\b\.?"
_OFFICER = r"(?i)^(the\s+)?(mr|mdm|madam|miss|ms)?\s*(deputy\s+)?(speaker|chairman|deputy\s+chairman|chair)\b"
_COLLECTIVE = r"(?i)^(hon|honourable|some hon|an hon)\b"
_BRACKETED = r"^[\[(].*[\])]$"
_INVISIBLE = "[﻿​‌‍‎‏⁠]"


def name_form(c: Column) -> Column:
    """Small letters without a bracket at the end, titles and marks."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(c), r"\([^()]*\)\s*$", ""), _TITLES, " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[^a-z0-9\s'-]", " "), r"\s+", " "))


_NAME_SQL = f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({{0}}), '\\([^()]*\\)\\s*$', ''), {q(_TITLES)}, ' ', 'g'), '[^a-z0-9\\s''-]', ' ', 'g'), '\\s+', ' ', 'g'))"
_CLEAN_SQL = f"trim(regexp_replace(speaker, '{_INVISIBLE}', '', 'g'))"


@R.query(
    "resolve_members",
    f"""WITH s AS (SELECT speaker, {_CLEAN_SQL} AS c FROM (SELECT DISTINCT speaker FROM turn WHERE speaker IS NOT NULL)),
k AS (SELECT speaker, c, CASE WHEN c = '' THEN 'UNRESOLVED' WHEN {_hit('c', _BRACKETED)} THEN 'NON_PERSON' WHEN {_hit('c', _OFFICER)} THEN 'OFFICER' WHEN {_hit(_NAME_SQL.format('c'), _COLLECTIVE)} THEN 'NON_PERSON' END AS kind FROM s),
m AS (SELECT {_NAME_SQL.format('full_name')} AS n, min((CASE WHEN status = 'current' THEN 0 ELSE 1 END, full_name, member_id))[3] AS member_id FROM roster WHERE full_name IS NOT NULL GROUP BY 1),
c AS (SELECT speaker, unnest(x) AS t, generate_subscripts(x, 1) AS p FROM (SELECT speaker, list_concat([c], regexp_extract_all(c, '\\(([^()]*)\\)', 1), CASE WHEN contains(c, '(') THEN [split_part(c, '(', 1)] ELSE [] END) AS x FROM k WHERE kind IS NULL)),
f AS (SELECT c.speaker, min((c.p, m.member_id))[2] AS member_id FROM c JOIN m ON m.n = {_NAME_SQL.format('c.t')} WHERE m.n <> '' GROUP BY 1),
e AS (SELECT split_part(n, ' ', 1) AS a, regexp_extract(n, '([^ ]+)$', 1) AS b, min(member_id) AS member_id FROM m WHERE contains(n, ' ') GROUP BY 1, 2 HAVING count(*) = 1),
g AS (SELECT k.speaker, e.member_id FROM k JOIN e ON e.a = split_part({_NAME_SQL.format('k.c')}, ' ', 1) AND e.b = regexp_extract({_NAME_SQL.format('k.c')}, '([^ ]+)$', 1) WHERE k.kind IS NULL AND contains({_NAME_SQL.format('k.c')}, ' '))
SELECT k.speaker, CASE WHEN k.kind IS NOT NULL THEN k.kind WHEN coalesce(f.member_id, g.member_id) IS NULL THEN 'UNRESOLVED' ELSE 'MEMBER' END AS kind, CASE WHEN k.kind IS NULL THEN coalesce(f.member_id, g.member_id) END AS member_id
FROM k LEFT JOIN f ON f.speaker = k.speaker LEFT JOIN g ON g.speaker = k.speaker""",
)
def resolve_members(spark: SparkSession, d: str) -> DataFrame:
    """One ladder: bracketed, presiding and collective labels; then the label, its brackets and what is before them as a
    member's name, current members first; then its first and last word, if they are those of one name; else
    unresolved."""
    s = load(spark, d, "turn").select("speaker").where("speaker IS NOT NULL").distinct().withColumn("c", F.trim(F.regexp_replace("speaker", _INVISIBLE, "")))
    c = F.col("c")
    kind = F.when(c == "", "UNRESOLVED").when(c.rlike(_BRACKETED), "NON_PERSON").when(c.rlike(_OFFICER), "OFFICER").when(name_form(c).rlike(_COLLECTIVE), "NON_PERSON")
    s = s.withColumn("kind", kind)
    best = F.min(F.struct(F.when(F.col("status") == "current", 0).otherwise(1), "full_name", "member_id"))["member_id"]
    m = load(spark, d, "roster").where("full_name IS NOT NULL").groupBy(name_form(F.col("full_name")).alias("n")).agg(best.alias("member_id")).where("n <> ''")
    open_ = s.where("kind IS NULL")
    tries = F.concat(F.array(c), F.regexp_extract_all(c, F.lit(r"\(([^()]*)\)"), F.lit(1)), F.when(F.contains(c, F.lit("(")), F.array(F.split_part(c, F.lit("("), F.lit(1)))).otherwise(F.array().cast("array<string>")))
    named = open_.select("speaker", F.posexplode(tries).alias("p", "t")).withColumn("n", name_form(F.col("t"))).join(m, "n")
    named = named.groupBy("speaker").agg(F.min(F.struct("p", "member_id"))["member_id"].alias("member_id"))
    ends = lambda n: {"a": F.split_part(n, F.lit(" "), F.lit(1)), "b": F.regexp_extract(n, "([^ ]+)$", 1)}
    only = m.where("contains(n, ' ')").withColumns(ends(F.col("n"))).groupBy("a", "b").agg(F.min("member_id").alias("other"), F.count("*").alias("k")).where("k = 1").drop("k")
    other = open_.withColumn("n", name_form(c)).where("contains(n, ' ')").withColumns(ends(F.col("n"))).join(only, ["a", "b"]).select("speaker", "other")
    j = s.join(named, "speaker", "left").join(other, "speaker", "left").withColumn("m", F.coalesce("member_id", "other"))
    return j.select("speaker", F.coalesce("kind", F.when(F.col("m").isNull(), "UNRESOLVED").otherwise("MEMBER")).alias("kind"), F.when(F.col("kind").isNull(), F.col("m")).alias("member_id"))


# questions and sponsors

# Formal questions, motions, and labels of offices.
QUESTION_OPEN = r"(?i)^\W*asked\s+the\s+\S"
FORMAL_QUESTION = r"(?i)^\s*asked\s+the\s+"
BEG_TO_MOVE = r"(?i)\bbeg to move\b"
OFFICE = r"(?i)^(?:The\s+)?(?:Acting\s+|Senior\s+|Second\s+|Deputy\s+|Associate\s+)*(?:Minister|Parliamentary\s+Secretary|Prime\s+Minister|Speaker)\b"
FOR_OFFICE = r"(?i)\(for\s+the\s+"
PERMISSION = r"(?i)may I (?:please )?(?:have|seek) (?:your )?permission|address oral Question|answer Question Nos?|may I please address"


@R.query("question_open", current_sql(
    f", f AS (SELECT report_id, key, turn, text FROM turn_ WHERE speaker IS NOT NULL QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY turn) = 1) "
    f"SELECT report_id, key, {_hit('text', QUESTION_OPEN)} AS is_question FROM f"))
def question_open(spark: SparkSession, d: str) -> DataFrame:
    f = Tables(spark, d).turn.where("speaker IS NOT NULL").groupBy("report_id").agg(F.min(F.struct("turn", "key", F.col("text").rlike(QUESTION_OPEN).alias("is_question"))).alias("f"))
    return f.select("report_id", "f.key", "f.is_question")


@R.query(
    "sponsor_of",
    current_sql(f""", s AS (SELECT report_id, speaker, turn FROM turn_ WHERE speaker IS NOT NULL AND {_hit('text', BEG_TO_MOVE)} QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY turn) = 1)
SELECT r.report_id, CASE WHEN r.report_type = 'Bills Introduced' THEN nullif(trim(split_part(r.mp_names, ',', 1)), '') ELSE s.speaker END AS sponsor FROM report_ r LEFT JOIN s ON s.report_id = r.report_id WHERE r.group_name IN ('bill', 'motion')"""),
)
def sponsor_of(spark: SparkSession, d: str) -> DataFrame:
    """Of a bill that is introduced the first name of its record; of others whoever first begs to move."""
    t = Tables(spark, d)
    s = t.turn.where(F.col("speaker").isNotNull() & F.col("text").rlike(BEG_TO_MOVE)).groupBy("report_id").agg(F.min(F.struct("turn", "speaker"))["speaker"].alias("s"))
    r = t.report.where("group_name IN ('bill', 'motion')").select("report_id", "report_type", "mp_names").join(s, "report_id", "left")
    return r.select("report_id", F.when(F.col("report_type") == "Bills Introduced", F.nullif(F.trim(F.split_part("mp_names", F.lit(","), F.lit(1))), F.lit(""))).otherwise(F.col("s")).alias("sponsor"))


_SHORT_SQL = r"""coalesce(list_filter(list_transform(regexp_extract_all(speaker, '\(([^()]*)\)', 1), lambda g: trim(g)), lambda g: regexp_matches(g, '(?i)^(Mr|Ms|Mrs|Mdm|Dr|Prof|Assoc\s+Prof|Associate\s+Prof|Encik|Haji|Puan|Datuk)\b'))[-1], nullif(trim(regexp_replace(speaker, '\s*\([^()]*\)', '', 'g')), ''), trim(speaker))"""


@R.query(
    "qa_mapping",
    current_sql(f""", t AS (SELECT report_id, turn, key, words, speaker, {_SHORT_SQL} AS who, coalesce({_hit('speaker', OFFICE)} OR {_hit('speaker', FOR_OFFICE)}, false) AS role, coalesce({_hit('text', FORMAL_QUESTION)}, false) AS formal, coalesce({_hit('text', PERMISSION)}, false) AS asks_leave
FROM turn_ WHERE NOT coalesce({_hit('speaker', G.CHAIR)}, false) AND report_id IN (SELECT report_id FROM report_ WHERE group_name = 'oral')),
a AS (SELECT report_id, min(who) AS answerer FROM t WHERE role GROUP BY 1 HAVING count(DISTINCT who) = 1),
j AS (SELECT t.*, answerer, role OR who IS NOT DISTINCT FROM answerer AS answers FROM t JOIN a USING (report_id)),
x AS (SELECT report_id, answerer, coalesce(min(CASE WHEN formal THEN (turn, key) END), min(CASE WHEN speaker IS NOT NULL AND NOT role AND words > 25 THEN (turn, key) END)) AS q, min(CASE WHEN answers AND words >= 8 AND NOT (words < 20 AND asks_leave) THEN (turn, key) END) AS r FROM j GROUP BY 1, 2)
SELECT x.report_id, x.answerer, x.q[2] AS question, x.r[2] AS response, count(*) FILTER (WHERE j.speaker IS NOT NULL AND j.words >= 8 AND j.turn > greatest(x.q[1], x.r[1]) AND j.answers) AS more_answers,
count(*) FILTER (WHERE j.speaker IS NOT NULL AND j.words >= 8 AND j.turn > greatest(x.q[1], x.r[1]) AND NOT j.answers) AS more_questions FROM x JOIN j ON j.report_id = x.report_id WHERE x.q IS NOT NULL AND x.r IS NOT NULL GROUP BY 1, 2, 3, 4"""),
)
def qa_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Of each oral report in which one person alone speaks for an office: the formal question, or else the first long turn
    of another; the first answer that isn't a request for leave; and what follows on both sides."""
    t = Tables(spark, d)
    who, text = F.col("speaker"), F.col("text")
    flag = lambda c: F.coalesce(c, F.lit(False))
    own = t.turn.join(t.report.where("group_name = 'oral'").select("report_id"), "report_id", "left_semi").where(~flag(who.rlike(G.CHAIR)))
    x = own.select("report_id", "turn", "key", "words", "speaker", X.short_speaker("speaker").alias("who"), flag(who.rlike(OFFICE) | who.rlike(FOR_OFFICE)).alias("role"), flag(text.rlike(FORMAL_QUESTION)).alias("formal"), flag(text.rlike(PERMISSION)).alias("leave"))
    a = x.where("role").groupBy("report_id").agg(F.min("who").alias("answerer"), F.countDistinct("who").alias("n")).where("n = 1").drop("n")
    j = x.join(a, "report_id").withColumn("answers", F.col("role") | F.col("who").eqNullSafe(F.col("answerer")))
    first = lambda c: F.min(F.when(c, F.struct("turn", "key")))
    question = F.coalesce(first(F.col("formal")), first(F.col("speaker").isNotNull() & ~F.col("role") & (F.col("words") > 25)))
    response = first(F.col("answers") & (F.col("words") >= 8) & ~((F.col("words") < 20) & F.col("leave")))
    g = j.groupBy("report_id", "answerer").agg(question.alias("q"), response.alias("r")).where("q IS NOT NULL AND r IS NOT NULL")
    after = (F.col("turn") > F.greatest("q.turn", "r.turn")) & F.col("speaker").isNotNull() & (F.col("words") >= 8)
    out = g.join(j.drop("answerer"), "report_id").groupBy("report_id", "answerer", F.col("q.key").alias("question"), F.col("r.key").alias("response"))
    return out.agg(F.count_if(after & F.col("answers")).alias("more_answers"), F.count_if(after & ~F.col("answers")).alias("more_questions"))
