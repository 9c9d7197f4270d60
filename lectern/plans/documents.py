"""Chunks, packs, citations, briefs, gates and incremental plans over the domain's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators.bloom import bloom_segments, maybe_in, segments_for
from lectern.operators.current import Tables, current_sql
from lectern.operators.gates import gate
from lectern.operators.sequences import kept_spans, neighbours, packed, running_total
from lectern.plans.registry import Registry
from lectern.plans.texts import sentence_rows
from lectern.sources import checkpointed, load

R = Registry()


# chunks and packs

CHUNK, OVERLAP, LEAST = 6000, 800, 40


_SPLIT_SQL = rf""", b AS (SELECT key, report_id, speaker, text FROM turn_ WHERE text <> ''),
p AS (SELECT key, text, list_filter(list_transform(regexp_split_to_array(text, '\n{{2,}}'), lambda v: trim(regexp_replace(v, '[\s\x{{A0}}]+', ' ', 'g'))), lambda v: v <> '') AS ps FROM b WHERE length(text) > {CHUNK}),
u AS (SELECT key, unnest(us) AS u, generate_subscripts(us, 1) AS i FROM (SELECT key, CASE WHEN len(ps) > 1 THEN list_concat(list_transform(ps[:-2], lambda v: v || ' '), ps[-1:]) ELSE regexp_extract_all(text, '[^.!?]*[.!?]+\s*|[^.!?]+$') END AS us FROM p)),
n AS (SELECT key, max(i) AS n FROM u GROUP BY 1),
r AS (WITH RECURSIVE f AS (SELECT key, CAST(0 AS BIGINT) AS i, '' AS cur, CAST([] AS VARCHAR[]) AS out FROM n UNION ALL
SELECT f.key, u.i, CASE WHEN length(u.u) > {CHUNK} THEN '' WHEN length(f.cur) + length(u.u) <= {CHUNK} THEN f.cur || u.u WHEN length(right(f.cur, {OVERLAP}) || u.u) <= {CHUNK} THEN right(f.cur, {OVERLAP}) || u.u ELSE u.u END,
CASE WHEN length(u.u) <= {CHUNK} AND length(f.cur) + length(u.u) <= {CHUNK} THEN f.out ELSE list_concat(f.out, CASE WHEN f.cur = '' THEN [] ELSE [f.cur] END, CASE WHEN length(u.u) > {CHUNK} THEN list_transform(generate_series(0, (length(u.u) - 1) // {CHUNK}), lambda k: substr(u.u, k * {CHUNK} + 1, {CHUNK})) ELSE [] END) END
FROM f JOIN u ON u.key = f.key AND u.i = f.i + 1) SELECT f.key, f.cur, f.out FROM f JOIN n ON n.key = f.key AND n.n = f.i),
c AS (SELECT key, CASE WHEN cur = '' THEN out WHEN length(cur) < {LEAST} AND len(out) > 0 THEN list_concat(out[:-2], [out[-1] || cur]) ELSE list_concat(out, [cur]) END AS x FROM r UNION ALL SELECT key, [text] FROM b WHERE length(text) <= {CHUNK}),
s AS (SELECT key, unnest(x) AS piece, generate_subscripts(x, 1) - 1 AS part, len(x) AS n_parts FROM c)"""


@R.query("chunk_split", current_sql(_SPLIT_SQL + " SELECT key, CAST(part AS INTEGER) AS part, CAST(length(piece) AS INTEGER) AS n, md5(piece) AS piece_md5 FROM s"))
def chunk_split(spark: SparkSession, d: str) -> DataFrame:
    """Turns cut into pieces of whole sentences with a raw overlap; see `lectern.operators.chunking`."""
    from lectern.operators.chunking import split_text

    t = Tables(spark, d).turn.where("text <> ''").select("key", F.posexplode(split_text("text", CHUNK, OVERLAP, LEAST)).alias("part", "piece"))
    return t.select("key", "part", F.length("piece").alias("n"), F.md5("piece").alias("piece_md5"))


@R.query(
    "chunk_plan",
    current_sql(
        _SPLIT_SQL
        + """, e AS (SELECT t.report_id, count(*) AS turns, count(*) FILTER (WHERE coalesce(trim(t.text), '') = '') AS empty, count(*) FILTER (WHERE length(t.text) BETWEEN 1 AND 39) AS short FROM turn_ t GROUP BY 1),
g AS (SELECT b.report_id, count(*) AS pieces, count(*) FILTER (WHERE n_parts > 1) AS partial, max(length(piece)) AS longest, CAST(sum(length('[' || coalesce(speaker, '') || '] ' || piece)) AS BIGINT) AS embed_chars FROM s JOIN b USING (key) GROUP BY 1)
SELECT e.report_id, e.turns, e.empty, e.short, coalesce(pieces, 0) AS pieces, coalesce(partial, 0) AS partial, CAST(coalesce(longest, 0) AS INTEGER) AS longest, coalesce(embed_chars, 0) AS embed_chars FROM e LEFT JOIN g USING (report_id)"""
    ),
)
def chunk_plan(spark: SparkSession, d: str) -> DataFrame:
    """Pieces by report with the record of what they cover: turns, empty and short ones, how many pieces are parts of a
    turn, how long pieces are, and the text to embed."""
    from lectern.operators.chunking import split_text

    empty = F.coalesce(F.trim("text"), F.lit("")) == ""
    t = Tables(spark, d).turn.select("report_id", empty.alias("empty"), F.length("text").alias("long"), F.coalesce("speaker", F.lit("")).alias("who"), F.when(F.col("text") != "", split_text("text", CHUNK, OVERLAP, LEAST)).alias("x"))
    sizes = F.transform("x", F.length)
    n = F.coalesce(F.size("x"), F.lit(0))
    own = t.select("report_id", "empty", F.col("long").between(1, 39).alias("short"), F.greatest(n, F.lit(0)).alias("n"), F.array_max(sizes).alias("longest"), (F.aggregate(sizes, F.lit(0), lambda a, v: a + v) + n * (F.length("who") + 3)).alias("chars"))
    return own.groupBy("report_id").agg(
        F.count("*").alias("turns"), F.count_if("empty").alias("empty"), F.count_if("short").alias("short"), F.sum("n").alias("pieces"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("partial"),
        F.coalesce(F.max("longest"), F.lit(0)).alias("longest"), F.coalesce(F.sum("chars"), F.lit(0)).alias("embed_chars"),
    )


def _packs(t: DataFrame, cost: Column, limit: int) -> DataFrame:
    bins = packed(t.select("report_id", "turn", "key", cost.alias("n")), "report_id", ["turn", "key"], "n", limit)
    return bins.groupBy("report_id", "bin").agg(F.count("*").alias("n"), F.sum("n").alias("cost"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


def _pack_sql(cost: str, limit: int) -> str:
    return current_sql(f""", o AS (SELECT report_id, turn, coalesce({cost}, 0) AS n, row_number() OVER (PARTITION BY report_id ORDER BY turn, key) AS rn FROM turn_),
p AS (WITH RECURSIVE r AS (SELECT report_id, turn, n, rn, 0 AS bin, n AS used FROM o WHERE rn = 1 UNION ALL
SELECT o.report_id, o.turn, o.n, o.rn, CASE WHEN r.used > 0 AND r.used + o.n > {limit} THEN r.bin + 1 ELSE r.bin END, CASE WHEN r.used > 0 AND r.used + o.n > {limit} THEN o.n ELSE r.used + o.n END FROM r JOIN o ON o.report_id = r.report_id AND o.rn = r.rn + 1) SELECT * FROM r)
SELECT report_id, bin, count(*) AS n, CAST(sum(n) AS BIGINT) AS cost, min(turn) AS first_turn, max(turn) AS last_turn FROM p GROUP BY 1, 2""")


@R.query("pack_turns", _pack_sql("length(text) + 10", 6000))
def pack_turns(spark: SparkSession, d: str) -> DataFrame:
    """A report's turns in order, in packs of a size limit. A pack ends with the turn before the one that doesn't fit."""
    return _packs(Tables(spark, d).turn, F.length("text") + 10, 6000)


@R.query("pack_sids", _pack_sql("length(text) + length(coalesce(speaker, '')) + 8", 24000))
def pack_sids(spark: SparkSession, d: str) -> DataFrame:
    return _packs(Tables(spark, d).turn, F.length("text") + F.length(F.coalesce("speaker", F.lit(""))) + 8, 24000)


@R.query(
    "render_excerpt",
    current_sql(""", s AS (SELECT report_id, turn, key, speaker, text, lag(speaker) OVER w AS before_, sum(length(text)) OVER (PARTITION BY report_id ORDER BY turn) AS used FROM turn_ WHERE text IS NOT NULL WINDOW w AS (PARTITION BY report_id ORDER BY turn))
SELECT report_id, count(*) AS turns, md5(string_agg(CASE WHEN speaker IS NOT NULL AND speaker IS DISTINCT FROM before_ THEN '[' || speaker || '] ' ELSE '' END || text, chr(10) ORDER BY turn)) AS excerpt_md5 FROM s WHERE used <= 6000 GROUP BY 1"""),
)
def render_excerpt(spark: SparkSession, d: str) -> DataFrame:
    """A report's beginning within a budget, each speaker named once in a row."""
    t = Tables(spark, d).turn.where("text IS NOT NULL").select("report_id", "turn", "speaker", "text")
    # lengths first: only the turns within the budget are looked at with their texts
    s = running_total(t, "report_id", "turn", F.length("text"), "used").where("used <= 6000")
    s = s.withColumn("before", F.lag("speaker").over(Window.partitionBy("report_id").orderBy("turn")))
    label = F.when(F.col("speaker").isNotNull() & ~F.col("speaker").eqNullSafe(F.col("before")), F.concat(F.lit("["), "speaker", F.lit("] "))).otherwise("")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat(label, F.col("text")).alias("l")))), lambda x: x["l"])
    return s.groupBy("report_id").agg(F.count("*").alias("turns"), F.md5(F.array_join(lines, "\n")).alias("excerpt_md5"))


#: Characters that may be left out between pieces, beyond which it is a gap.
SLACK = 50


@R.query(
    "chunk_gap_check",
    current_sql(f""", c AS (SELECT c.turn_key, c.part, c.cite_text, t.text, row_number() OVER (PARTITION BY c.turn_key ORDER BY c.part, c.id) AS rn FROM chunk_ c JOIN turn_ t ON t.key = c.turn_key WHERE t.text IS NOT NULL AND c.cite_text <> ''),
f AS (WITH RECURSIVE r AS (SELECT turn_key, CAST(0 AS BIGINT) AS rn, CAST(1 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS upto, 0 AS pieces, 0 AS gaps, 0 AS strange FROM c WHERE rn = 1 UNION ALL
SELECT turn_key, rn, CASE WHEN pl > 0 THEN pl + 1 ELSE pos END, CASE WHEN pl > 0 THEN greatest(upto, pl - 1 + n) ELSE upto END, pieces + CASE WHEN pl > 0 THEN 1 ELSE 0 END, gaps + CASE WHEN pl > 0 AND pl - 1 > upto + {SLACK} THEN 1 ELSE 0 END, strange + CASE WHEN pl = 0 THEN 1 ELSE 0 END
FROM (SELECT c.turn_key, c.rn, r.pos, r.upto, r.pieces, r.gaps, r.strange, length(c.cite_text) AS n, CASE WHEN instr(substr(c.text, r.pos), c.cite_text) > 0 THEN instr(substr(c.text, r.pos), c.cite_text) + r.pos - 1 ELSE 0 END AS pl FROM r JOIN c ON c.turn_key = r.turn_key AND c.rn = r.rn + 1)) SELECT * FROM r),
z AS (SELECT turn_key, max(rn) AS rn, max(length(text)) AS n FROM c GROUP BY 1)
SELECT f.turn_key, pieces, gaps, strange, z.n - upto AS tail FROM f JOIN z ON z.turn_key = f.turn_key AND z.rn = f.rn"""),
)
def chunk_gap_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether a turn's pieces, in order, leave a part of its text out: each is looked for behind the beginning of the one
    before, so that a passage that comes again isn't taken for the first. Pieces that aren't there are counted."""
    t = Tables(spark, d)
    pieces = t.chunk.where("cite_text <> ''").groupBy("turn_key").agg(F.array_sort(F.collect_list(F.struct("part", "id", "cite_text"))).alias("x"))
    j = pieces.join(t.turn.where("text IS NOT NULL").select(F.col("key").alias("turn_key"), "text"), "turn_key")
    zero = F.lit(0)
    start = F.struct(F.lit(1).alias("pos"), zero.alias("upto"), zero.alias("pieces"), zero.alias("gaps"), zero.alias("strange"))

    def step(acc: Column, p: Column) -> Column:
        at = F.position(p["cite_text"], F.col("text"), acc["pos"])
        there = at > 0
        end = at - 1 + F.length(p["cite_text"])
        return F.struct(
            F.when(there, at + 1).otherwise(acc["pos"]).alias("pos"), F.when(there, F.greatest(acc["upto"], end)).otherwise(acc["upto"]).alias("upto"), (acc["pieces"] + there.cast("int")).alias("pieces"),
            (acc["gaps"] + (there & (at - 1 > acc["upto"] + SLACK)).cast("int")).alias("gaps"), (acc["strange"] + (~there).cast("int")).alias("strange"),
        )

    a = j.select("turn_key", F.length("text").alias("n"), F.aggregate("x", start, step).alias("a"))
    return a.select("turn_key", "a.pieces", "a.gaps", "a.strange", (F.col("n") - F.col("a.upto")).cast("long").alias("tail"))


# citations


@R.query(
    "citation_gate",
    current_sql("""SELECT c.id, CASE WHEN t.key IS NULL THEN 'no_turn' WHEN trim(c.cite_text) = '' THEN 'blank' WHEN coalesce(c.speaker, '') <> coalesce(t.speaker, '') THEN 'speaker' WHEN NOT contains(t.text, c.cite_text) THEN 'not_verbatim' ELSE 'ok' END AS verdict
FROM chunk_ c LEFT JOIN turn_ t ON t.key = c.turn_key"""),
)
def citation_gate(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    turns = t.turn.select(F.col("key").alias("turn_key"), F.coalesce("speaker", F.lit("")).alias("who"), "text", F.lit(True).alias("hit"))
    j = t.chunk.select("id", "turn_key", F.coalesce("speaker", F.lit("")).alias("s"), "cite_text").join(turns, "turn_key", "left")
    verdict = F.when(F.col("hit").isNull(), "no_turn").when(F.trim("cite_text") == "", "blank").when(F.col("s") != F.col("who"), "speaker").when(~F.contains("text", "cite_text"), "not_verbatim").otherwise("ok")
    return j.select("id", verdict.alias("verdict"))


@R.query("verify_quotes", current_sql("SELECT c.id, length(c.cite_text) >= 12 AND contains(" + X.CASED_NORM_SQL.format("t.text") + ", " + X.CASED_NORM_SQL.format("c.cite_text") + ") AS verified FROM chunk_ c JOIN turn_ t ON t.key = c.turn_key"))
def verify_quotes(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    j = t.chunk.select("id", "turn_key", "cite_text").join(t.turn.select(F.col("key").alias("turn_key"), "text"), "turn_key")
    return j.select("id", ((F.length("cite_text") >= 12) & F.contains(X.cased_norm("text"), X.cased_norm("cite_text"))).alias("verified"))


_GRAM, _TRIED = 4, 3
_WORD = r"(\p{IsHan}|[^ \p{IsHan}]+)"


def _form(c: str) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.col(c), X.MARKS_FROM, X.MARKS_TO), r"\s+", " "))


def _words(form: Column) -> Column:
    """Hashes of a text's words; of Chinese, of its characters."""
    return F.transform(F.regexp_extract_all(form, F.lit(_WORD), F.lit(1)), lambda w: F.xxhash64(w))


def _grams(x: str) -> Column:
    """Hashes of the report with each few words in a row, from the hashes of the words."""
    some = F.transform(F.sequence(F.lit(0), F.size(x) - _GRAM), lambda i: F.xxhash64("report_id", *(F.get(x, i + k) for k in range(_GRAM))))
    return F.when(F.size(x) >= _GRAM, F.array_distinct(some)).otherwise(F.array().cast("array<bigint>"))


_FORM_SQL = f"trim(regexp_replace(translate({{0}}, '{X.MARKS_FROM}', '{X.MARKS_TO.replace(chr(39), chr(39) * 2)}'), '\\s+', ' ', 'g'))"


@R.query(
    "anchor_spans",
    current_sql(
        X.SENT_SQL
        + f""", probe AS (SELECT DISTINCT report_id, s, {_FORM_SQL.format('s')} AS form FROM (SELECT report_id, s FROM sent_ UNION ALL SELECT report_id, cite_text FROM chunk_ WHERE cite_text IS NOT NULL)),
turns AS (SELECT report_id, key, text, {_FORM_SQL.format('text')} AS t FROM turn_ WHERE text IS NOT NULL),
hit AS (SELECT p.report_id, p.s, p.form, t.key, t.text, t.t, instr(t.text, p.s) AS pos FROM probe p JOIN turns t ON t.report_id = p.report_id AND p.form <> '' AND contains(t.t, p.form)),
one AS (SELECT report_id, s, count(*) AS hits, min(key) AS key, min(form) AS form, min(text) AS text, min(t) AS t, min(pos) AS pos FROM hit GROUP BY 1, 2),
ch AS (SELECT report_id, s, i, substr(flat, i, 1) AS c, substr(flat, i - 1, 1) AS before FROM (SELECT report_id, s, regexp_replace(translate(text, '{X.MARKS_FROM}', '{X.MARKS_TO.replace(chr(39), chr(39) * 2)}'), '\\s', ' ', 'g') AS flat, unnest(generate_series(1, length(text))) AS i FROM one WHERE hits = 1 AND pos = 0)),
kept AS (SELECT report_id, s, i, row_number() OVER (PARTITION BY report_id, s ORDER BY i) AS n FROM ch WHERE NOT (c = ' ' AND (i = 1 OR before = ' '))),
place AS (SELECT o.report_id, o.s, min(k.i) FILTER (WHERE k.n = instr(o.t, o.form)) - 1 AS a, max(k.i) FILTER (WHERE k.n = instr(o.t, o.form) + length(o.form) - 1) AS z FROM one o JOIN kept k ON k.report_id = o.report_id AND k.s = o.s GROUP BY 1, 2)
SELECT p.report_id, md5(p.s) AS probe_md5, coalesce(o.hits, 0) AS hits, CASE WHEN o.hits = 1 THEN o.key END AS key,
CASE WHEN o.hits = 1 THEN CASE WHEN o.pos > 0 THEN o.pos - 1 ELSE place.a END END AS char_start, CASE WHEN o.hits = 1 THEN CASE WHEN o.pos > 0 THEN o.pos - 1 + length(p.s) ELSE place.z END END AS char_end,
CASE WHEN o.hits IS NULL THEN 'unresolved' WHEN o.hits > 1 THEN 'ambiguous' WHEN o.pos > 0 THEN 'exact' ELSE 'normalised' END AS method
FROM probe p LEFT JOIN one o ON o.report_id = p.report_id AND o.s = p.s LEFT JOIN place ON place.report_id = p.report_id AND place.s = p.s"""
    ),
)
def anchor_spans(spark: SparkSession, d: str) -> DataFrame:
    """Where a report's sentences and its chunks' texts stand in its turns: `exact` (verbatim in one turn, at its first place),
    `normalised` (in one turn in normal form only; the offsets are of the original), `ambiguous` (in several turns)
    or `unresolved` (in none). Turns are counted in normal form, that of `norm_map` without blanks at the ends.

    A sentence is in its own turn, which needs no search. Other turns are found by four words in a row from within the
    probe, the rarest in the report of a few, of which turns hold those that a Bloom filter lets pass; then
    containment decides. Probes and turns are numbers by a hash until their texts are compared. Probes that are too
    short for that meet all turns of their report.
    """
    t = Tables(spark, d)
    turns = checkpointed(t.turn.where("text IS NOT NULL").select("report_id", F.xxhash64("key").alias("id"), "key", "text"))
    pid = F.xxhash64("report_id", "s").alias("pid")
    said = turns.select("report_id", "id", "key", "text", F.explode(X.sentences("text")).alias("s"))
    own = said.where(_form("s") != "").select(pid, "id", "key", (F.position(F.col("s"), F.col("text")) - 1).alias("at"), F.length("s").alias("long"))
    own = own.select("pid", "id", "key", F.col("at").alias("s"), (F.col("at") + F.col("long")).alias("e"), F.lit("exact").alias("method")).distinct()
    probe = said.select("report_id", "s").unionByName(t.chunk.where("cite_text IS NOT NULL").select("report_id", F.col("cite_text").alias("s")))
    probe = probe.groupBy("report_id", pid).agg(F.first("s").alias("s")).withColumn("form", _form("s")).withColumn("x", _words(F.col("form")))
    inner = probe.withColumn("x", F.slice("x", F.lit(2), F.greatest(F.size("x") - 2, F.lit(0))))  # the outer words may be parts of longer ones
    probe = checkpointed(inner.select("report_id", "pid", "s", F.nullif("form", "s").alias("form"), F.slice(F.array_sort(_grams("x")), 1, _TRIED).alias("grams")))
    tried = probe.select("pid", F.explode("grams").alias("g"))
    n_segments = segments_for(_TRIED * probe.count())
    held = turns.select("report_id", "id", _words(_form("text")).alias("x")).select("id", F.explode(_grams("x")).alias("g"))
    held = maybe_in(held, "g", bloom_segments(tried.select("g").distinct(), "g", n_segments), n_segments).where("maybe").select("id", "g").repartition("g")
    often = held.groupBy("g").agg(F.count("*").alias("n"))
    rarest = tried.join(often, "g", "left").groupBy("pid").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g"))["g"].alias("g"))
    met = rarest.join(held, "g").select("pid", "id")
    short = probe.where("size(grams) = 0 AND coalesce(form, s) <> ''").select("report_id", "pid").join(turns.select("report_id", "id"), "report_id").select("pid", "id")
    other = met.unionByName(short).join(own.select("pid", "id"), ["pid", "id"], "left_anti")
    texts = turns.select("id", "key", "text", F.nullif(_form("text"), F.col("text")).alias("t"))
    form, plain = F.coalesce("form", "s"), F.coalesce("t", "text")
    hit = other.join(probe.select("pid", "s", "form"), "pid").join(texts, "id").where(F.contains(plain, form)).withColumns({"form": form, "t": plain})
    at = F.position(F.col("s"), F.col("text"))
    hit = hit.withColumns({"at": F.when(at > 0, at - 1), "first": F.position(F.col("form"), F.col("t"))})
    # the characters of the normal form with their places, only where they are needed
    chars = F.transform(F.split(F.when(F.col("at").isNull(), F.col("text")), ""), lambda c, i: F.struct(F.regexp_replace(F.translate(c, X.MARKS_FROM, X.MARKS_TO), r"\s", " ").alias("c"), i.alias("i")))
    hit = hit.select("pid", "id", "key", "at", "first", F.length("form").alias("n"), F.length("s").alias("long"), chars.alias("f"))
    kept = F.filter("f", lambda x: ~((x["c"] == " ") & F.coalesce(F.get("f", x["i"] - 1)["c"] == " ", F.lit(True))))
    hit = hit.select("pid", "id", "key", "at", "first", "n", "long", kept.alias("k"))
    start = F.coalesce("at", F.get("k", F.col("first") - 1)["i"])
    end = F.coalesce(F.col("at") + F.col("long"), F.get("k", F.col("first") + F.col("n") - 2)["i"] + 1)
    hit = hit.select("pid", "id", "key", start.alias("s"), end.alias("e"), F.when(F.col("at").isNotNull(), "exact").otherwise("normalised").alias("method"))
    g = own.unionByName(hit).groupBy("pid").agg(F.count("*").alias("hits"), F.min(F.struct("key", "s", "e", "method")).alias("x"))
    j = probe.select("report_id", "pid", F.md5("s").alias("probe_md5")).join(g, "pid", "left").withColumn("hits", F.coalesce("hits", F.lit(0).cast("long")))
    one = F.col("hits") == 1
    method = F.when(one, F.col("x.method")).when(F.col("hits") == 0, "unresolved").otherwise("ambiguous")
    return j.select("report_id", "probe_md5", "hits", F.when(one, F.col("x.key")).alias("key"), F.when(one, F.col("x.s")).cast("long").alias("char_start"), F.when(one, F.col("x.e")).cast("long").alias("char_end"), method.alias("method"))


@R.query("anchor_ref", current_sql(
    r"SELECT c.id, t.date, regexp_replace(c.id, '#c\d+$', '') AS turn_key, instr(t.text, c.cite_text) - 1 AS char_start, length(c.cite_text) AS n FROM "
    r"chunk_ c JOIN turn_ t ON t.key = regexp_replace(c.id, '#c\d+$', '') WHERE contains(t.text, c.cite_text)"))
def anchor_ref(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    c = t.chunk.select("id", F.regexp_replace("id", r"#c\d+$", "").alias("turn_key"), "cite_text")
    j = c.join(t.turn.select(F.col("key").alias("turn_key"), "date", "text"), "turn_key").where(F.contains("text", "cite_text"))
    return j.select("id", "date", "turn_key", (F.position(F.col("cite_text"), F.col("text")) - 1).cast("long").alias("char_start"), F.length("cite_text").cast("long").alias("n"))


_NUM = r"[0-9][0-9.,]*[0-9]|[0-9]"


@R.query("number_grounding", current_sql(
    f"SELECT c.id, len(list_filter(regexp_extract_all(c.cite_text, '{_NUM}'), lambda x: NOT list_contains(regexp_extract_all(t.text, '{_NUM}'), x))) AS "
    f"ungrounded FROM chunk_ c JOIN turn_ t ON t.key = c.turn_key WHERE c.cite_text IS NOT NULL AND t.text IS NOT NULL"))
def number_grounding(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    numbers = lambda c: F.regexp_extract_all(c, F.lit(f"({_NUM})"), F.lit(1))
    j = t.chunk.where("cite_text IS NOT NULL").select("id", "turn_key", numbers("cite_text").alias("x")).join(t.turn.where("text IS NOT NULL").select(F.col("key").alias("turn_key"), numbers("text").alias("y")), "turn_key")
    return j.select("id", F.size(F.filter("x", lambda v: ~F.array_contains("y", v))).cast("long").alias("ungrounded"))


@R.query("suggestion_grounding", current_sql("SELECT c.id, r.report_id IS NOT NULL AND c.title IS NOT DISTINCT FROM r.title AS grounded FROM chunk_ c LEFT JOIN report_ r ON r.report_id = c.report_id"))
def suggestion_grounding(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    j = t.chunk.select("id", "report_id", "title").join(t.report.select("report_id", F.col("title").alias("stored"), F.lit(True).alias("hit")), "report_id", "left")
    return j.select("id", (F.col("hit").isNotNull() & F.col("title").eqNullSafe(F.col("stored"))).alias("grounded"))


@R.query("provenance_check", current_sql(
    "SELECT c.id, instr(t.text, c.cite_text) AS at, sha256(substr(t.text, instr(t.text, c.cite_text), length(c.cite_text))) = sha256(c.cite_text) AS same "
    "FROM chunk_ c JOIN turn_ t ON t.key = c.turn_key WHERE contains(t.text, c.cite_text)"))
def provenance_check(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    j = t.chunk.select("id", "turn_key", "cite_text").join(t.turn.select(F.col("key").alias("turn_key"), "text"), "turn_key").where(F.contains("text", "cite_text"))
    at = F.position(F.col("cite_text"), F.col("text"))
    return j.select("id", at.cast("long").alias("at"), (F.sha2(F.substring(F.col("text"), at, F.length("cite_text")), 256) == F.sha2("cite_text", 256)).alias("same"))


# spans


def _mark_sql() -> str:
    return """, m AS (SELECT key, lower(text) AS low, length(text) AS n, unnest(['rebate', 'permit', 'caregivers', 'grant', 'service standard']) AS w FROM turn_ WHERE text IS NOT NULL),
sp AS (SELECT key, s, s + 20 AS e, n FROM (SELECT key, n, unnest(list_filter(generate_series(0, n - length(w)), lambda i: substr(low, i + 1, length(w)) = w)) AS s FROM m WHERE contains(low, w)))"""


def marks(t: Tables, word: bool = False) -> DataFrame:
    """Spans of twenty characters from every place of each of some words, with the word if it is wanted."""
    m = t.turn.where("text IS NOT NULL").select("key", "text", F.explode(F.array(*map(F.lit, ["rebate", "permit", "caregivers", "grant", "service standard"]))).alias("w")).where(F.contains(F.lower("text"), F.col("w")))
    m = m.select("key", "w", F.length("text").alias("n"), F.length("w").alias("long"), F.split(F.lower("text"), F.col("w"), -1).alias("x"))
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("pos"))
    step = lambda acc, p: F.struct(F.concat(acc["out"], F.array(acc["pos"] + F.length(p))).alias("out"), (acc["pos"] + F.length(p) + F.col("long")).alias("pos"))
    at = F.aggregate(F.slice("x", F.lit(1), F.size("x") - 1), start, step)["out"]
    return m.select("key", "n", "w", F.explode(at).alias("s")).select("key", "s", (F.col("s") + 20).alias("e"), "n", *(["w"] if word else []))


@R.query(
    "runs_from_spans",
    current_sql(_mark_sql() + """, o AS (SELECT key, s, e, row_number() OVER (PARTITION BY key ORDER BY s, e) AS rn FROM sp WHERE e <= n),
f AS (WITH RECURSIVE r AS (SELECT key, s, e, rn, true AS kept, e AS pos FROM o WHERE rn = 1 UNION ALL SELECT o.key, o.s, o.e, o.rn, o.s >= r.pos, CASE WHEN o.s >= r.pos THEN o.e ELSE r.pos END FROM r JOIN o ON o.key = r.key AND o.rn = r.rn + 1) SELECT * FROM r)
SELECT key, CAST(s AS INTEGER) AS s, CAST(e AS INTEGER) AS e FROM f WHERE kept"""),
)
def runs_from_spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans in order without those that begin within the last one kept; a dropped span doesn't push the next."""
    g = marks(Tables(spark, d)).where("e <= n").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("x"))
    return g.select("key", F.explode(kept_spans(F.col("x"))).alias("v")).select("key", "v.s", "v.e")


@R.query(
    "cited_overlay",
    current_sql(_mark_sql() + """, c AS (SELECT key, unnest(generate_series(s, e - 1)) AS i FROM sp WHERE e <= n), d AS (SELECT DISTINCT key, i FROM c), g AS (SELECT key, i, i - row_number() OVER (PARTITION BY key ORDER BY i) AS island FROM d)
SELECT key, CAST(min(i) AS INTEGER) AS s, CAST(max(i) + 1 AS INTEGER) AS e FROM g GROUP BY key, island"""),
)
def cited_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping marks as the runs of characters that they cover: a run begins where no earlier mark reaches."""
    m = marks(Tables(spark, d)).where("e <= n").select("key", "s", "e").distinct()
    w = Window.partitionBy("key").orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    m = m.withColumn("new", F.when(F.col("s") > reach, 1).otherwise(0)).withColumn("run", F.sum("new").over(w))
    return m.groupBy("key", "run").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("run")


@R.query("page_stats", current_sql(X.SENT_SQL +
    ", n AS (SELECT report_id, count(*) AS sentences, count(*) FILTER (WHERE length(s) > 120) AS shown FROM sent_ GROUP BY 1) SELECT report_id, sentences, "
    "shown, sentences - shown AS folded, round(shown * 100.0 / sentences, 2) AS percent FROM n"))
def page_stats(spark: SparkSession, d: str) -> DataFrame:
    n = sentence_rows(Tables(spark, d)).groupBy("report_id").agg(F.count("*").alias("sentences"), F.count_if(F.length("s") > 120).alias("shown"))
    return n.select("report_id", "sentences", "shown", (F.col("sentences") - F.col("shown")).alias("folded"), F.round(F.col("shown") * 100.0 / F.col("sentences"), 2).alias("percent"))


# briefs


@R.query("map_documents", current_sql(
    ", t AS (SELECT report_id, count(*) AS turns, CAST(sum(words) AS BIGINT) AS words, min_by(speaker, turn) AS first_speaker FROM turn_ GROUP BY 1) SELECT "
    "r.report_id AS doc_id, coalesce(nullif(trim(r.title), ''), r.report_type) AS title, r.date, t.turns, t.words, CASE WHEN t.report_id IS NULL THEN "
    "'no_turns' WHEN t.words = 0 THEN 'empty' END AS skipped FROM report_ r LEFT JOIN t ON t.report_id = r.report_id"))
def map_documents(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    g = t.turn.groupBy("report_id").agg(F.count("*").alias("turns"), F.sum("words").alias("words"), F.lit(True).alias("hit"))
    j = t.report.select("report_id", "title", "report_type", "date").join(g, "report_id", "left")
    return j.select(F.col("report_id").alias("doc_id"), F.coalesce(F.nullif(F.trim("title"), F.lit("")), "report_type").alias("title"), "date", "turns", "words", F.when(F.col("hit").isNull(), "no_turns").when(F.col("words") == 0, "empty").alias("skipped"))


@R.query(
    "assemble_brief",
    current_sql(""", s AS (SELECT report_id, key, turn, CASE WHEN turn - lag(turn) OVER (PARTITION BY report_id ORDER BY turn) > 2 THEN 1 ELSE 0 END AS brk FROM turn_ WHERE words >= 100), g AS (SELECT *, sum(brk) OVER (PARTITION BY report_id ORDER BY turn) AS section FROM s),
n AS (SELECT report_id, section, string_agg(key, ',' ORDER BY turn) AS keys, count(*) AS n FROM g GROUP BY 1, 2) SELECT report_id, count(*) AS sections, CAST(sum(n) AS BIGINT) AS cited, md5(string_agg(keys, '|' ORDER BY section)) AS body_md5 FROM n GROUP BY 1"""),
)
def assemble_brief(spark: SparkSession, d: str) -> DataFrame:
    """Nested sections of cited turns, in order at both levels: a gap of more than two turns begins a section."""
    s = Tables(spark, d).turn.where("words >= 100").select("report_id", "key", "turn", F.col("turn").alias("at"))
    s = neighbours(s, "report_id", "turn", ["at"], before=True)
    s = running_total(s, "report_id", "turn", F.coalesce((F.col("turn") - F.col("__at") > 2).cast("int"), F.lit(0)), "section")
    n = s.groupBy("report_id", "section").agg(F.array_sort(F.collect_list(F.struct("turn", "key"))).alias("cites"))
    b = n.groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct("section", "cites"))).alias("sections"))
    body = F.array_join(F.transform("sections", lambda x: F.array_join(F.transform(x["cites"], lambda c: c["key"]), ",")), "|")
    return b.select("report_id", F.size("sections").cast("long").alias("sections"), F.aggregate("sections", F.lit(0).cast("long"), lambda a, x: a + F.size(x["cites"])).alias("cited"), F.md5(body).alias("body_md5"))


@R.query("brief_gate", current_sql(
    ", c AS (SELECT report_id, count(*) AS turns, count(*) FILTER (WHERE words >= 100) AS cited, count(*) FILTER (WHERE words >= 100 AND (text IS NULL OR "
    "trim(text) = '')) AS blank FROM turn_ GROUP BY 1) SELECT report_id, cited > 0 AND blank = 0 AND (cited * 1.0 / turns >= 0.15 OR turns <= 1) AS passed, "
    "round(cited * 1.0 / turns, 4) AS coverage FROM c"))
def brief_gate(spark: SparkSession, d: str) -> DataFrame:
    picked = F.col("words") >= 100
    c = Tables(spark, d).turn.groupBy("report_id").agg(F.count("*").alias("turns"), F.count_if(picked).alias("cited"), F.count_if(picked & (F.col("text").isNull() | (F.trim("text") == ""))).alias("blank"))
    share = F.col("cited") / F.col("turns")
    return c.select("report_id", ((F.col("cited") > 0) & (F.col("blank") == 0) & ((share >= 0.15) | (F.col("turns") <= 1))).alias("passed"), F.round(share, 4).alias("coverage"))


@R.query("greedy_cover")
def greedy_cover(spark: SparkSession, d: str) -> DataFrame:
    """Of each item's reports, those that add most new speakers, in turn, until none adds any."""
    from lectern.operators.cover import greedy

    t = Tables(spark, d)
    rows = t.link.select("item_id", "report_id").distinct().join(t.turn.where("speaker IS NOT NULL").select("report_id", "speaker").distinct(), "report_id")
    return greedy(rows, "item_id", "report_id", "speaker", 6)


@R.query("skipped_sentences", current_sql(
    ", big AS (SELECT report_id, key FROM turn_ WHERE words >= 150) SELECT t.report_id, count(*) AS n, md5(string_agg(t.key, ',' ORDER BY t.turn)) AS "
    "keys_md5 FROM turn_ t ANTI JOIN big b ON b.key = t.key GROUP BY 1"))
def skipped_sentences(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d).turn
    left = t.select("report_id", "turn", "key").join(t.where("words >= 150").select("key"), "key", "left_anti")
    return left.groupBy("report_id").agg(F.count("*").alias("n"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "key"))), lambda x: x["key"]), ",")).alias("keys_md5"))


@R.query("archive_lead", current_sql(
    ", w AS (SELECT report_id, sum(words) AS words FROM turn_ GROUP BY 1), r AS (SELECT r.date, r.title, w.words, l.item_id FROM report_ r JOIN w ON "
    "w.report_id = r.report_id LEFT JOIN (SELECT report_id, min(item_id) AS item_id FROM link_ GROUP BY 1) l ON l.report_id = r.report_id) SELECT date, "
    "min(item_id) AS item_id, max((words, title))[2] AS longest FROM r GROUP BY 1"))
def archive_lead(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    w = t.turn.groupBy("report_id").agg(F.sum("words").alias("words"))
    r = t.report.select("report_id", "date", "title").join(w, "report_id").join(t.link.groupBy("report_id").agg(F.min("item_id").alias("item_id")), "report_id", "left")
    return r.groupBy("date").agg(F.min("item_id").alias("item_id"), F.max(F.struct("words", "title"))["title"].alias("longest"))


@R.query("year_blocks", current_sql("SELECT year, count(DISTINCT date) AS sittings, CAST(sum(words) AS BIGINT) AS words FROM turn_ GROUP BY 1"))
def year_blocks(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).turn.groupBy("year").agg(F.countDistinct("date").alias("sittings"), F.sum("words").alias("words")).orderBy(F.desc("year"))


# The order in which groups are shown.
GROUP_ORDER = ["motion", "budget", "bill", "statement", "oral", "written", "adjournment", "correction", "tribute", "petition", "other"]
_ORDER_SQL = "list_position([" + ", ".join(f"'{g}'" for g in GROUP_ORDER) + "], group_name)"


@R.query("custom_order", current_sql(
    f", g AS (SELECT group_name, count(*) AS n FROM report_ GROUP BY 1) SELECT group_name, n, row_number() OVER (ORDER BY coalesce(nullif({_ORDER_SQL}, 0), "
    f"99), n DESC, group_name) AS place FROM g"))
def custom_order(spark: SparkSession, d: str) -> DataFrame:
    place = F.array_position(F.array(*map(F.lit, GROUP_ORDER)), F.col("group_name"))
    g = Tables(spark, d).report.groupBy("group_name").agg(F.count("*").alias("n"))
    w = Window.orderBy(F.coalesce(F.nullif(place, F.lit(0)), F.lit(99)), F.desc("n"), "group_name")  # a dozen groups
    return g.select("group_name", "n", F.row_number().over(w).alias("place"))


@R.query("share_of_total", current_sql(
    ", g AS (SELECT group_name, sum(words) AS words FROM turn_ GROUP BY 1) SELECT group_name, CAST(words AS BIGINT) AS words, round(CASE WHEN sum(words) "
    "OVER () = 0 THEN 0 ELSE words * 100.0 / sum(words) OVER () END, 4) AS percent FROM g"))
def share_of_total(spark: SparkSession, d: str) -> DataFrame:
    g = Tables(spark, d).turn.groupBy("group_name").agg(F.sum("words").alias("words"))
    total = F.sum("words").over(Window.partitionBy())  # over the groups, not the rows
    return g.select("group_name", "words", F.round(F.when(total == 0, 0.0).otherwise(F.col("words") * 100.0 / total), 4).alias("percent"))


@R.query("reading_time", current_sql(
    ", w AS (SELECT report_id, sum(words) / 200.0 AS m FROM turn_ GROUP BY 1) SELECT report_id, CAST(CASE WHEN m < 5 THEN 5 WHEN m < 55 THEN greatest(5, "
    "floor(m / 10 + 0.5) * 10) ELSE floor(m / 30 + 0.5) * 30 END AS BIGINT) AS minutes FROM w"))
def reading_time(spark: SparkSession, d: str) -> DataFrame:
    w = Tables(spark, d).turn.groupBy("report_id").agg((F.sum("words") / 200).alias("m"))
    m = F.col("m")
    minutes = F.when(m < 5, 5).when(m < 55, F.greatest(F.lit(5), F.floor(m / 10 + 0.5) * 10)).otherwise(F.floor(m / 30 + 0.5) * 30)
    return w.select("report_id", minutes.cast("long").alias("minutes"))


@R.query(
    "section_speakers",
    current_sql(
        ", f AS (SELECT report_id, speaker, min(turn) AS pos FROM turn_ WHERE speaker IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION "
        "BY report_id ORDER BY pos) AS rn, count(*) OVER (PARTITION BY report_id) AS n FROM f) SELECT report_id, string_agg(speaker, ', ' ORDER BY rn) FILTER "
        "(WHERE rn <= 4) || CASE WHEN max(n) > 4 THEN ' +' || CAST(max(n) - 4 AS VARCHAR) || ' more' ELSE '' END AS speakers FROM r GROUP BY 1"),
)
def section_speakers(spark: SparkSession, d: str) -> DataFrame:
    f = Tables(spark, d).turn.where("speaker IS NOT NULL").groupBy("report_id", "speaker").agg(F.min("turn").alias("pos"))
    g = f.groupBy("report_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "speaker"))), lambda x: x["speaker"]).alias("x"))
    more = F.when(F.size("x") > 4, F.concat(F.lit(" +"), (F.size("x") - 4).cast("string"), F.lit(" more"))).otherwise("")
    return g.select("report_id", F.concat(F.array_join(F.slice("x", 1, 4), ", "), more).alias("speakers"))


# evaluation


#: Of each group's sample so many are drawn at random, are the longest, the thinnest, and cut in several parts; the
#: rest is drawn at random.
SHARES, SAMPLE = {"random": 8, "longest": 4, "thinnest": 4, "multi": 2}, 20


@R.query(
    "stratified_sample",
    current_sql(
        f""", t AS (SELECT group_name, key, words, n_chunks, md5('42' || key) AS h FROM turn_), a AS (SELECT *, row_number() OVER (PARTITION BY group_name ORDER BY h, key) AS n FROM t),
b AS (SELECT *, row_number() OVER (PARTITION BY group_name ORDER BY words DESC, key) AS n FROM t ANTI JOIN (SELECT key FROM a WHERE n <= {SHARES['random']}) x USING (key)),
c AS (SELECT *, row_number() OVER (PARTITION BY group_name ORDER BY words, key) AS n FROM t ANTI JOIN (SELECT key FROM a WHERE n <= {SHARES['random']} UNION ALL SELECT key FROM b WHERE n <= {SHARES['longest']}) x USING (key)),
d AS (SELECT *, row_number() OVER (PARTITION BY group_name ORDER BY h, key) AS n FROM t ANTI JOIN (SELECT key FROM a WHERE n <= {SHARES['random']} UNION ALL SELECT key FROM b WHERE n <= {SHARES['longest']} UNION ALL SELECT key FROM c WHERE n <= {SHARES['thinnest']}) x USING (key) WHERE n_chunks > 1),
p AS (SELECT group_name, key, 'random' AS slice FROM a WHERE n <= {SHARES['random']} UNION ALL SELECT group_name, key, 'longest' FROM b WHERE n <= {SHARES['longest']} UNION ALL SELECT group_name, key, 'thinnest' FROM c WHERE n <= {SHARES['thinnest']} UNION ALL SELECT group_name, key, 'multi' FROM d WHERE n <= {SHARES['multi']}),
k AS (SELECT group_name, count(*) AS n FROM p GROUP BY 1),
e AS (SELECT t.group_name, t.key, row_number() OVER (PARTITION BY t.group_name ORDER BY h, t.key) AS n FROM t ANTI JOIN p USING (key))
SELECT * FROM p UNION ALL SELECT e.group_name, e.key, 'rest' FROM e JOIN k ON k.group_name IS NOT DISTINCT FROM e.group_name WHERE e.n <= {SAMPLE} - k.n"""
    ),
)
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sample of each group that stays the same: two fifths by a hash, a fifth the longest, a fifth the thinnest, a tenth of
    those in several parts, and the rest by the hash again; none twice. Each slice keeps only what can be in it, the
    first of each group after those taken before, which are never more than the sample."""
    t = Tables(spark, d).turn.select("group_name", "key", "words", "n_chunks", F.md5(F.concat(F.lit("42"), "key")).alias("h"))
    w = Window.partitionBy("group_name")

    def first(rows: DataFrame, order: list, n: int) -> DataFrame:
        return rows.withColumn("rn", F.row_number().over(w.orderBy(*order))).where(F.col("rn") <= n).drop("rn")

    by_hash, longest, thinnest = ["h", "key"], [F.desc("words"), "key"], ["words", "key"]
    # what can be taken at all: the first SAMPLE of each order, as no more are ever taken before it
    few = first(t, by_hash, SAMPLE).unionByName(first(t, longest, SAMPLE)).unionByName(first(t, thinnest, SAMPLE)).unionByName(first(t.where("n_chunks > 1"), by_hash, SAMPLE)).distinct()
    few = checkpointed(few)
    taken = few.limit(0).withColumn("slice", F.lit(""))
    for name, rows, order in (("random", few, by_hash), ("longest", few, longest), ("thinnest", few, thinnest), ("multi", few.where("n_chunks > 1"), by_hash)):
        left = rows.join(taken.select("key"), "key", "left_anti") if name != "random" else rows
        taken = taken.unionByName(first(left, order, SHARES[name]).withColumn("slice", F.lit(name)))
    taken = checkpointed(taken.select("group_name", "key", "slice"))
    size = taken.groupBy(F.col("group_name").alias("g")).agg(F.count("*").alias("n"))
    rest = few.join(taken.select("key"), "key", "left_anti").withColumn("rn", F.row_number().over(w.orderBy(*by_hash)))
    rest = rest.join(size, F.col("g").eqNullSafe(F.col("group_name"))).where(F.col("rn") <= SAMPLE - F.col("n"))
    return taken.unionByName(rest.select("group_name", "key", F.lit("rest").alias("slice")))


_W4 = "regexp_extract_all(lower({0}), '[a-z]{{4,}}')"


@R.query("flag_falsify", current_sql(
    f", j AS (SELECT c.id, c.cite_text, t.text, list_distinct({_W4.format('c.cite_text')}) AS w, list_distinct({_W4.format('t.text')}) AS v FROM chunk_ c "
    f"JOIN turn_ t ON t.key = c.turn_key WHERE c.cite_text IS NOT NULL AND t.text IS NOT NULL) SELECT id, CASE WHEN contains(lower(text), lower(cite_text)) "
    f"THEN 'substring' WHEN len(w) = len(list_intersect(w, v)) THEN 'all_words' WHEN len(list_intersect(w, v)) >= 0.8 * len(w) THEN 'most_words' ELSE "
    f"'stands' END AS outcome FROM j"))
def flag_falsify(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z]{4,})"), F.lit(1)))
    j = t.chunk.where("cite_text IS NOT NULL").select("id", "turn_key", "cite_text").join(t.turn.where("text IS NOT NULL").select(F.col("key").alias("turn_key"), "text"), "turn_key")
    w = words("cite_text")
    both = F.size(F.array_intersect(w, words("text")))
    return j.select("id", F.when(F.contains(F.lower("text"), F.lower("cite_text")), "substring").when(F.size(w) == both, "all_words").when(both >= 0.8 * F.size(w), "most_words").otherwise("stands").alias("outcome"))


@R.query("evidence_missing", current_sql(
    f"SELECT c.id, len(list_filter(list_distinct({_W4.format('c.cite_text')}), lambda x: NOT list_contains({_W4.format('t.text')}, x))) AS missing FROM "
    f"chunk_ c JOIN turn_ t ON t.key = c.turn_key WHERE c.cite_text IS NOT NULL AND t.text IS NOT NULL"))
def evidence_missing(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z]{4,})"), F.lit(1)))
    j = t.chunk.where("cite_text IS NOT NULL").select("id", "turn_key", "cite_text").join(t.turn.where("text IS NOT NULL").select(F.col("key").alias("turn_key"), "text"), "turn_key")
    return j.select("id", F.size(F.array_except(words("cite_text"), words("text"))).cast("long").alias("missing"))


_GROUPS = [["rebate", "voucher"], ["caregivers", "seniors"], ["review", "pilot"]]


@R.query("fact_group_coverage", current_sql("SELECT report_id, " + ", ".join(f"bool_or({' OR '.join(f'contains(lower(text), {chr(39)}{w}{chr(39)})' for w in g)}) AS g{i}" for i, g in enumerate(_GROUPS)) + " FROM turn_ WHERE text IS NOT NULL GROUP BY 1"))
def fact_group_coverage(spark: SparkSession, d: str) -> DataFrame:
    low = F.lower("text")
    hit = lambda g: F.bool_or(F.exists(F.array(*map(F.lit, g)), lambda w: F.contains(low, w)))
    return Tables(spark, d).turn.where("text IS NOT NULL").groupBy("report_id").agg(*(hit(g).alias(f"g{i}") for i, g in enumerate(_GROUPS)))


@R.query("class_d_check", current_sql("SELECT count(*) FILTER (WHERE " + " AND ".join("(" + " OR ".join(f"text ILIKE '%{w}%'" for w in g) + ")" for g in _GROUPS) + ") AS n_all_groups, count(*) AS n FROM turn_ WHERE text IS NOT NULL"))
def class_d_check(spark: SparkSession, d: str) -> DataFrame:
    has = F.lit(True)
    for g in _GROUPS:
        one = F.lit(False)
        for w in g:
            one = one | F.col("text").ilike(f"%{w}%")
        has = has & one
    return Tables(spark, d).turn.where("text IS NOT NULL").agg(F.count_if(has).alias("n_all_groups"), F.count("*").alias("n"))


_BARE_SQL = r"trim(regexp_replace(trim(regexp_replace(coalesce({0}, ''), '\[[^\]]{{0,200}}\]', ' ', 'g')), '\s+', ' ', 'g'))"


@R.query(
    "turn_diff",
    f"""WITH o AS (SELECT * FROM turn QUALIFY row_number() OVER (PARTITION BY key ORDER BY loaded_at) = 1), n AS (SELECT * FROM turn QUALIFY row_number() OVER (PARTITION BY key ORDER BY loaded_at DESC) = 1),
j AS (SELECT o.key, o.text AS a, n.text AS b, o.speaker IS DISTINCT FROM n.speaker AS who, {_BARE_SQL.format('o.text')} AS x, {_BARE_SQL.format('n.text')} AS y FROM o JOIN n ON n.key = o.key)
SELECT key, CASE WHEN a IS NOT DISTINCT FROM b THEN 'same' WHEN x = y THEN 'asides' WHEN contains(y, x) THEN 'longer' WHEN contains(x, y) THEN 'shorter' ELSE 'other' END AS text_diff, who AS speaker_diff FROM j WHERE a IS DISTINCT FROM b OR who""",
)
def turn_diff(spark: SparkSession, d: str) -> DataFrame:
    """What the last delivery of a turn changed against the first: only asides and blanks, more of it, less of it, or other
    words; and whether another speaker."""
    v = F.struct("loaded_at", "text", "speaker")
    g = load(spark, d, "turn").groupBy("key").agg(F.min_by(v, "loaded_at").alias("o"), F.max_by(v, "loaded_at").alias("n"))
    changed, who = ~F.col("o.text").eqNullSafe(F.col("n.text")), ~F.col("o.speaker").eqNullSafe(F.col("n.speaker"))
    bare = lambda c: F.trim(F.regexp_replace(X.strip_asides(F.coalesce(c, F.lit(""))), r"\s+", " "))
    x, y = bare(F.col("o.text")), bare(F.col("n.text"))
    kind = F.when(~changed, "same").when(x == y, "asides").when(F.contains(y, x), "longer").when(F.contains(x, y), "shorter").otherwise("other")
    return g.where(changed | who).select("key", kind.alias("text_diff"), who.alias("speaker_diff"))


@R.query("empty_placeholder_rows", current_sql(
    ", t AS (SELECT report_id, sum(words) AS words FROM turn_ GROUP BY 1) SELECT r.date, count(*) AS n, min(r.report_id) AS first_report FROM report_ r "
    "LEFT JOIN t ON t.report_id = r.report_id WHERE coalesce(t.words, 0) = 0 OR r.n_turns = 0 GROUP BY 1"))
def empty_placeholder_rows(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    j = t.report.select("report_id", "date", "n_turns").join(t.turn.groupBy("report_id").agg(F.sum("words").alias("words")), "report_id", "left")
    return j.where((F.coalesce("words", F.lit(0)) == 0) | (F.col("n_turns") == 0)).groupBy("date").agg(F.count("*").alias("n"), F.min("report_id").alias("first_report"))


@R.query("suite_verdict", current_sql(
    ", c AS (SELECT year, count(*) AS n, count(*) FILTER (WHERE n_sentences IS NULL) AS open_, count(*) FILTER (WHERE selection_share < 0.1) AS bad FROM "
    "item_ GROUP BY 1) SELECT year, n, CASE WHEN n = 0 OR bad > 0 THEN 'fail' WHEN open_ > 0 THEN 'needs_review' ELSE 'pass' END AS verdict FROM c"))
def suite_verdict(spark: SparkSession, d: str) -> DataFrame:
    c = Tables(spark, d).item.groupBy("year").agg(F.count("*").alias("n"), F.count_if(F.col("n_sentences").isNull()).alias("o"), F.count_if(F.col("selection_share") < 0.1).alias("b"))
    return c.select("year", "n", F.when((F.col("n") == 0) | (F.col("b") > 0), "fail").when(F.col("o") > 0, "needs_review").otherwise("pass").alias("verdict"))


@R.query("recent_scope", current_sql("SELECT date, count(*) AS reports FROM report_ WHERE year <= 2020 GROUP BY 1 ORDER BY date DESC LIMIT 10"))
def recent_scope(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).report.where("year <= 2020").groupBy("date").agg(F.count("*").alias("reports")).orderBy(F.desc("date")).limit(10)


# incremental


#: Working days after a sitting within which its report is to be published.
PUBLISH_DAYS = 7
_WORKING_SQL = "len(list_filter(generate_series({0} + INTERVAL 1 DAY, CAST({1} AS DATE), INTERVAL 1 DAY), lambda x: dayofweek(x) BETWEEN 1 AND 5))"


def working_days_between(a: Column, b: Column) -> Column:
    """Weekdays after a up to b; 0 if b isn't later."""
    # whole weeks, and what is left of one, counted by the weekday (0 is Monday) on which a falls
    n = F.greatest(F.datediff(b, a), F.lit(0))
    rest = F.filter(F.sequence(F.lit(1), F.lit(6)), lambda k: (k <= n % 7) & ((F.weekday(a) + k) % 7 < 5))
    return F.floor(n / 7).cast("int") * 5 + F.size(rest)


@R.query(
    "late_pending_status",
    current_sql(f""", t AS (SELECT report_id, min(loaded_at) AS seen FROM turn GROUP BY 1), n AS (SELECT max(loaded_at) AS now FROM turn), r AS (SELECT r.report_id, CAST(r.date AS DATE) AS day, t.seen, n.now FROM report_ r LEFT JOIN t USING (report_id), n),
w AS (SELECT report_id, seen, {_WORKING_SQL.format('day', 'coalesce(seen, now)')} AS days FROM r) SELECT report_id, CAST(days AS INTEGER) AS days, CASE WHEN seen IS NOT NULL THEN CASE WHEN days <= {PUBLISH_DAYS} THEN 'on_time' ELSE 'late' END WHEN days <= {PUBLISH_DAYS} THEN 'pending' ELSE 'overdue' END AS status FROM w"""),
)
def late_pending_status(spark: SparkSession, d: str) -> DataFrame:
    """How many working days after a sitting its turns came. Where none have yet, they are pending within the days that
    publishing takes, and overdue after them; that there was no sitting is never said."""
    turns = load(spark, d, "turn")
    first = turns.groupBy("report_id").agg(F.min("loaded_at").alias("at"))
    r = Tables(spark, d).report.select("report_id", F.to_date("date").alias("day")).join(first, "report_id", "left")
    r = r.withColumn("now", turns.agg(F.max("loaded_at")).scalar()).select("report_id", "day", "at", F.coalesce("at", "now").alias("seen"))
    r = r.withColumn("days", working_days_between(F.col("day"), F.to_date("seen")))
    soon = F.col("days") <= PUBLISH_DAYS
    return r.select("report_id", "days", F.when(F.col("at").isNotNull(), F.when(soon, "on_time").otherwise("late")).when(soon, "pending").otherwise("overdue").alias("status"))


@R.query("incremental_anti_join", "SELECT DISTINCT key FROM turn t WHERE NOT EXISTS (SELECT 1 FROM chunk c WHERE c.turn_key = t.key)")
def incremental_anti_join(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "turn").select("key").distinct().join(load(spark, d, "chunk").select(F.col("turn_key").alias("key")), "key", "left_anti")


@R.query("latest_verdict", "SELECT user_id, event_type AS verdict, event_id FROM events WHERE event_type <> 'view' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_verdict(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").where("event_type <> 'view'")
    last = e.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("m"))
    return last.select("user_id", F.col("m.event_type").alias("verdict"), "m.event_id")


@R.query(
    "hash_change_detect",
    """WITH h AS (SELECT snapshot_no, report_id, md5(coalesce(title, '') || '|' || array_to_string(turn_hashes, ',')) AS h FROM report_snapshot QUALIFY row_number() OVER (PARTITION BY snapshot_no, report_id ORDER BY delivered_at DESC) = 1)
SELECT b.snapshot_no, b.report_id, CASE WHEN a.h IS NULL THEN 'new' WHEN a.h <> b.h THEN 'changed' ELSE 'same' END AS status FROM h b LEFT JOIN h a ON a.report_id = b.report_id AND a.snapshot_no = b.snapshot_no - 1""",
)
def hash_change_detect(spark: SparkSession, d: str) -> DataFrame:
    h = F.md5(F.concat(F.coalesce("title", F.lit("")), F.lit("|"), F.array_join("turn_hashes", ",")))
    s = load(spark, d, "report_snapshot").groupBy("snapshot_no", "report_id").agg(F.max(F.struct("delivered_at", h.alias("h")))["h"].alias("h"))
    before = s.select((F.col("snapshot_no") + 1).alias("snapshot_no"), "report_id", F.col("h").alias("b"))
    status = F.when(F.col("b").isNull(), "new").when(F.col("b") != F.col("h"), "changed").otherwise("same")
    return s.join(before, ["snapshot_no", "report_id"], "left").select("snapshot_no", "report_id", status.alias("status"))


@R.query(
    "sessionize_events",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g)
SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS events FROM s GROUP BY user_id, n""",
)
def sessionize_events(spark: SparkSession, d: str) -> DataFrame:
    """Sessions with gaps under half an hour (an addition of this engine)."""
    e = load(spark, d, "events")
    g = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("events"))
    return g.drop("w")


# gates


@R.query(
    "gate_chunks",
    current_sql("""SELECT 'blank' AS check_name, count(*) FILTER (WHERE trim(coalesce(cite_text, '')) = '') AS n_bad, count(*) AS n FROM chunk_
UNION ALL SELECT 'too_long', count(*) FILTER (WHERE length(cite_text) > 9000), count(*) FROM chunk_ UNION ALL SELECT 'partial_flag', count(*) FILTER (WHERE is_partial <> (n_parts > 1)), count(*) FROM chunk_
UNION ALL SELECT 'part_range', count(*) FILTER (WHERE part < 0 OR part >= n_parts), count(*) FROM chunk_ UNION ALL SELECT 'embed_form', count(*) FILTER (WHERE NOT contains(embed_text, cite_text)), count(*) FROM chunk_"""),
)
def gate_chunks(spark: SparkSession, d: str) -> DataFrame:
    return gate(
        Tables(spark, d).chunk,
        {
            "blank": F.trim(F.coalesce("cite_text", F.lit(""))) == "",
            "too_long": F.length("cite_text") > 9000,
            "partial_flag": F.col("is_partial") != (F.col("n_parts") > 1),
            "part_range": (F.col("part") < 0) | (F.col("part") >= F.col("n_parts")),
            "embed_form": ~F.contains("embed_text", "cite_text"),
        },
    )


@R.query(
    "gate_integrity",
    current_sql("""SELECT 'turn_without_report' AS check_name, count(*) FILTER (WHERE r.report_id IS NULL) AS n_bad, count(*) AS n FROM turn_ t LEFT JOIN report_ r ON r.report_id = t.report_id
UNION ALL SELECT 'no_date', count(*) FILTER (WHERE t.date IS NULL OR t.date = ''), count(*) FROM turn_ t UNION ALL SELECT 'year_of_date', count(*) FILTER (WHERE CAST(substr(t.date, 1, 4) AS INTEGER) <> t.year), count(*) FROM turn_ t
UNION ALL SELECT 'key_form', count(*) FILTER (WHERE t.key <> t.report_id || '#t' || CAST(t.turn AS VARCHAR)), count(*) FROM turn_ t"""),
)
def gate_integrity(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    j = t.turn.select("key", "report_id", "turn", "date", "year").join(t.report.select("report_id", F.lit(True).alias("hit")), "report_id", "left")
    return gate(
        j,
        {
            "turn_without_report": F.col("hit").isNull(),
            "no_date": F.col("date").isNull() | (F.col("date") == ""),
            "year_of_date": F.substring("date", 1, 4).try_cast("int") != F.col("year"),
            "key_form": F.col("key") != F.concat("report_id", F.lit("#t"), F.col("turn").cast("string")),
        },
    )


@R.query(
    "gate_selection",
    current_sql("""SELECT 'nothing_selected' AS check_name, count(*) FILTER (WHERE sentences_selected <= 0) AS n_bad, count(*) AS n FROM item_ UNION ALL SELECT 'share', count(*) FILTER (WHERE abs(selection_share - sentences_selected * 1.0 / n_sentences) > 0.01), count(*) FROM item_
UNION ALL SELECT 'more_than_there_are', count(*) FILTER (WHERE sentences_selected > n_sentences), count(*) FROM item_ UNION ALL SELECT 'unknown_tier', count(*) FILTER (WHERE tier NOT IN ('small', 'heavy')), count(*) FROM item_"""),
)
def gate_selection(spark: SparkSession, d: str) -> DataFrame:
    return gate(
        Tables(spark, d).item,
        {
            "nothing_selected": F.col("sentences_selected") <= 0,
            "share": F.abs(F.col("selection_share") - F.try_divide("sentences_selected", "n_sentences")) > 0.01,
            "more_than_there_are": F.col("sentences_selected") > F.col("n_sentences"),
            "unknown_tier": ~F.col("tier").isin("small", "heavy"),
        },
    )


@R.query(
    "gate_referential",
    """SELECT 'item_report' AS check_name, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM report r WHERE r.report_id = l.report_id)) AS n_bad, count(*) AS n FROM summary_item_report l
UNION ALL SELECT 'item', count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM summary_item i WHERE i.item_id = l.item_id)), count(*) FROM summary_item_report l
UNION ALL SELECT 'announce_turn', count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM turn t WHERE t.key = p.announce_turn)), count(*) FROM supersession p""",
)
def gate_referential(spark: SparkSession, d: str) -> DataFrame:
    link, pair = load(spark, d, "summary_item_report"), load(spark, d, "supersession")

    def one(name: str, child: DataFrame, ref: str, parent: DataFrame, key: str) -> DataFrame:
        keys = parent.select(F.col(key).alias("__k"), F.lit(True).alias("hit")).distinct()
        return gate(child.join(keys, F.col(ref) == F.col("__k"), "left"), {name: F.col("hit").isNull()})

    a = one("item_report", link, "report_id", load(spark, d, "report"), "report_id")
    b = one("item", link, "item_id", load(spark, d, "summary_item"), "item_id")
    return a.unionByName(b).unionByName(one("announce_turn", pair, "announce_turn", load(spark, d, "turn"), "key"))
