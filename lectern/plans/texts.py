"""Text functions, ranking and retrieval over the domain's texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators.current import Tables, current_sql
from lectern.operators.ranking import bm25, cosine, fuse, postings, top_rank
from lectern.operators.repeats import repeated_sets
from lectern.plans.aggregates import _CLOCK_SQL, _MINUTES_SQL, clock_minutes
from lectern.plans.registry import Registry
from lectern.sources import load

R = Registry()


def sentence_rows(t: Tables) -> DataFrame:
    """key, report_id, turn, speaker, year, i, s: one row for each sentence of each turn."""
    return t.turn.where("text IS NOT NULL").select("key", "report_id", "turn", "speaker", "year", F.posexplode(X.sentences("text")).alias("i", "s"))


# scalar functions


@R.query("norm_text", current_sql(f"SELECT key, md5({X.CASED_NORM_SQL.format('lower(text)')}) AS norm_md5 FROM turn_"))
def norm_text(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).turn.select("key", F.md5(X.norm_text("text")).alias("norm_md5"))


@R.query("strip_asides", current_sql(r"SELECT key, md5(trim(regexp_replace(text, '\[[^\]]{0,200}\]', ' ', 'g'))) AS bare_md5 FROM turn_ WHERE text LIKE '%[%'"))
def strip_asides(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).turn.where(F.col("text").contains("[")).select("key", F.md5(X.strip_asides("text")).alias("bare_md5"))


@R.query("tokenise", current_sql(f", t AS (SELECT key, {X.TOKENS_SQL.format('text')} AS ts FROM turn_ WHERE text IS NOT NULL) SELECT key, len(ts) AS n, md5(array_to_string(ts, ' ')) AS tokens_md5 FROM t"))
def tokenise(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d).turn.where("text IS NOT NULL").select("key", X.tokens("text").alias("ts"))
    return t.select("key", F.size("ts").cast("long").alias("n"), F.md5(F.array_join("ts", " ")).alias("tokens_md5"))


@R.query("sentences_lossless", current_sql(
    r", t AS (SELECT key, text, regexp_extract_all(text, '[^.!?]*[.!?]+\s*|[^.!?]+$') AS x FROM turn_ WHERE text IS NOT NULL) SELECT key, len(x) AS n, "
    r"md5(array_to_string(x, '')) = md5(text) AS lossless FROM t"))
def sentences_lossless(spark: SparkSession, d: str) -> DataFrame:
    x = F.regexp_extract_all("text", F.lit(r"([^.!?]*[.!?]+\s*|[^.!?]+$)"), F.lit(1))
    return Tables(spark, d).turn.where("text IS NOT NULL").select("key", F.size(x).cast("long").alias("n"), (F.md5(F.array_join(x, "")) == F.md5("text")).alias("lossless"))


# Words whose full stop doesn't end a sentence.
ABBREVIATIONS = "mr mrs ms dr prof hon sr jr st no nos vol sec pp p al eg ie etc vs cf".split()
_BOUNDARY = r"([.!?][\"')\]”’]*)(\s+)([A-Z\"'“‘(])"
_BOUNDARY_SQL = _BOUNDARY.replace("'", "''")


@R.query(
    "sentence_spans",
    current_sql(
        rf""", p AS (SELECT key, unnest(string_split(regexp_replace(text, '{_BOUNDARY_SQL}', '\1' || chr(1) || '\2\3', 'g'), chr(1))) AS part, generate_subscripts(string_split(regexp_replace(text, '{_BOUNDARY_SQL}', '\1' || chr(1) || '\2\3', 'g'), chr(1)), 1) AS i FROM turn_ WHERE text IS NOT NULL),
b AS (SELECT *, CASE WHEN lag(regexp_extract(lower(part), '([a-z]+)[^a-z]*$', 1)) OVER w IN ({", ".join(f"'{a}'" for a in ABBREVIATIONS)}) THEN 0 ELSE 1 END AS opens, sum(length(part)) OVER (PARTITION BY key ORDER BY i) AS upto FROM p WINDOW w AS (PARTITION BY key ORDER BY i)),
g AS (SELECT *, sum(opens) OVER (PARTITION BY key ORDER BY i) AS n FROM b)
SELECT key, CAST(min(upto - length(part)) AS BIGINT) AS char_start, CAST(max(upto) AS BIGINT) AS char_end FROM g GROUP BY key, n HAVING trim(string_agg(part, '')) <> ''"""
    ),
)
def sentence_spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans by the rule that under-splits: candidate ends, joined again after an abbreviation. All within a row."""
    parts = F.split(F.regexp_replace("text", _BOUNDARY, "$1\x01$2$3"), "\x01")
    start = F.struct(F.array().cast("array<struct<s:int,e:int>>").alias("out"), F.lit(0).alias("pos"), F.lit(False).alias("joins"))

    def step(acc, p):  # noqa: ANN001, ANN202
        word = F.regexp_extract(F.lower(p), r"([a-z]+)[^a-z]*$", 1)
        end = acc["pos"] + F.length(p)
        last = F.element_at(acc["out"], -1)
        merged = F.concat(F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1), F.array(F.struct(last["s"].alias("s"), end.alias("e"))))
        added = F.concat(acc["out"], F.array(F.struct(acc["pos"].alias("s"), end.alias("e"))))
        return F.struct(F.when(acc["joins"], merged).otherwise(added).alias("out"), end.alias("pos"), word.isin(*ABBREVIATIONS).alias("joins"))

    t = Tables(spark, d).turn.where("text IS NOT NULL").select("key", "text", F.aggregate(parts, start, step)["out"].alias("x"))
    spans = t.select("key", "text", F.explode("x").alias("x")).where(F.trim(F.substring(F.col("text"), F.col("x.s") + 1, F.col("x.e") - F.col("x.s"))) != "")
    return spans.select("key", F.col("x.s").cast("long").alias("char_start"), F.col("x.e").cast("long").alias("char_end"))


@R.query("dataset_sentences", current_sql(X.SENT_SQL + f" SELECT key, CAST(i AS INTEGER) AS i, md5(s) AS s_md5, CAST({X.WORD_COUNT_SQL.format('s')} AS INTEGER) AS words FROM sent_"))
def dataset_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentence_rows(Tables(spark, d)).select("key", "i", F.md5("s").alias("s_md5"), X.word_count("s").alias("words"))


@R.query("paragraphs", current_sql(
    r", p AS (SELECT key, CASE WHEN contains(text, chr(10) || chr(10)) THEN regexp_split_to_array(text, '\n{2,}') ELSE string_split(text, chr(10)) END AS x "
    r"FROM turn_ WHERE text IS NOT NULL) SELECT key, len(x) AS n, md5(array_to_string(x, '|')) AS md5 FROM p"))
def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    x = F.when(F.contains("text", F.lit("\n\n")), F.split("text", r"\n{2,}")).otherwise(F.split("text", r"\n"))
    return Tables(spark, d).turn.where("text IS NOT NULL").select("key", F.size(x).cast("long").alias("n"), F.md5(F.array_join(x, "|")).alias("md5"))


@R.query("norm_map")
def norm_map(spark: SparkSession, d: str) -> DataFrame:
    """The normal form of a text with the original place of each of its characters, as an array."""
    chars = F.split("text", "")
    t = Tables(spark, d).turn.where("text <> ''").select("key", "text", chars.alias("x"))
    flat = F.transform("x", lambda c, i: F.struct(F.regexp_replace(F.translate(c, X.MARKS_FROM, X.MARKS_TO), r"\s", " ").alias("c"), i.alias("i")))
    t = t.select("key", "text", flat.alias("f"))
    kept = F.filter("f", lambda x: ~((x["c"] == " ") & F.coalesce(F.get("f", x["i"] - 1)["c"] == " ", F.lit(True))))
    t = t.select("key", kept.alias("k"))
    return t.select("key", F.md5(F.array_join(F.transform("k", lambda x: x["c"]), "")).alias("norm_md5"), F.size("k").alias("n"), F.try_element_at("k", F.lit(-1))["i"].alias("last_at"))


@R.query(
    "pronoun_neutral",
    current_sql(
        r"SELECT key, md5(trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[^a-z0-9_\s$%]', ' ', 'g'), "
        r"'\b(i|we|our|ours|us|my|mine|its|it|they|their|theirs|them|he|she|his|her|him|you|your|yours)\b', ' ', 'g'), '\s+', ' ', 'g'))) AS neutral_md5 FROM "
        r"turn_ WHERE text IS NOT NULL"),
)
def pronoun_neutral(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).turn.where("text IS NOT NULL").select("key", F.md5(X.pronoun_neutral("text")).alias("neutral_md5"))


@R.query("member_slug",
    "SELECT member_id, 'sg-mp:' || regexp_replace(regexp_replace(replace(lower(translate(full_name, 'áàâäãåéèêëíìîïóòôöõúùûüçñ', "
    "'aaaaaaeeeeiiiiooooouuuucn')), '/', ''), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM roster")
def member_slug(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "roster").select("member_id", F.concat(F.lit("sg-mp:"), X.slug(F.replace("full_name", F.lit("/"), F.lit("")))).alias("slug"))


@R.query(
    "short_speaker",
    r"""WITH s AS (SELECT DISTINCT speaker, list_filter(list_transform(regexp_extract_all(speaker, '\(([^()]*)\)', 1), lambda g: trim(g)), lambda g: regexp_matches(g, '(?i)^(Mr|Ms|Mrs|Mdm|Dr|Prof|Assoc\s+Prof|Associate\s+Prof|Encik|Haji|Puan|Datuk)\b')) AS t FROM turn WHERE speaker IS NOT NULL)
SELECT speaker, coalesce(t[-1], nullif(trim(regexp_replace(speaker, '\s*\([^()]*\)', '', 'g')), ''), trim(speaker)) AS short FROM s""",
)
def short_speaker(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "turn").select("speaker").where("speaker IS NOT NULL").distinct().select("speaker", X.short_speaker("speaker").alias("short"))


# What a last bracket begins with that is no constituency.
_NO_SEAT = r"(?i)^(for\s+the\b|for\s+Mr\b|for\s+Ms\b|for\s+Dr\b|In\b|To\b|on\b|as\b|and\b|the\b|(Mr|Ms|Mrs|Mdm|Dr|Prof|Assoc\s+Prof|Associate\s+Prof|Encik|Haji|Puan|Datuk)\b)"


@R.query(
    "constituency",
    rf"""WITH s AS (SELECT DISTINCT speaker, trim(regexp_extract_all(speaker, '\(([^()]*)\)', 1)[-1]) AS last FROM turn WHERE speaker IS NOT NULL)
SELECT speaker, CASE WHEN last IS NULL OR last = '' THEN '' WHEN starts_with(last, 'Nominated') OR starts_with(last, 'Non-Constituency') THEN last WHEN regexp_matches(last, '{_NO_SEAT}') THEN '' WHEN regexp_matches(last, '^[A-Z][A-Za-z'' -]{{2,40}}$') THEN last ELSE '' END AS seat FROM s""",
)
def constituency(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "turn").select("speaker").where("speaker IS NOT NULL").distinct()
    last = F.trim(F.try_element_at(F.regexp_extract_all("speaker", F.lit(r"\(([^()]*)\)"), F.lit(1)), F.lit(-1)))
    s = s.withColumn("last", F.coalesce(last, F.lit("")))
    seat = F.when(F.col("last").startswith("Nominated") | F.col("last").startswith("Non-Constituency"), F.col("last")).when(F.col("last").rlike(_NO_SEAT), "").when(F.col("last").rlike("^[A-Z][A-Za-z' -]{2,40}$"), F.col("last")).otherwise("")
    return s.select("speaker", seat.alias("seat"))


@R.query("split_names", current_sql(
    r", n AS (SELECT report_id, unnest(string_split(regexp_replace(regexp_replace(mp_names, '(\([^()]*\))|,', '\1' || chr(1), 'g'), '(\([^()]*\))' || "
    r"chr(1), '\1', 'g'), chr(1))) AS name FROM report_ WHERE mp_names IS NOT NULL) SELECT report_id, trim(name) AS name, count(*) AS n FROM n WHERE "
    r"trim(name) <> '' GROUP BY 1, 2"))
def split_names(spark: SparkSession, d: str) -> DataFrame:
    """Names divided by commas outside brackets."""
    n = Tables(spark, d).report.where("mp_names IS NOT NULL").select("report_id", F.explode(F.split("mp_names", r",(?![^()]*\))")).alias("name"))
    return n.select("report_id", F.trim("name").alias("name")).where("name <> ''").groupBy("report_id", "name").agg(F.count("*").alias("n"))


@R.query("figure_context", current_sql("SELECT key, instr(text, '%') AS at, substr(text, greatest(1, instr(text, '%') - 40), 60) AS context FROM turn_ WHERE contains(text, '%')"))
def figure_context(spark: SparkSession, d: str) -> DataFrame:
    at = F.instr("text", F.lit("%"))
    return Tables(spark, d).turn.where(F.contains("text", F.lit("%"))).select("key", at.cast("long").alias("at"), F.substring(F.col("text"), F.greatest(F.lit(1), at - 40), F.lit(60)).alias("context"))


@R.query("trim_words", current_sql(
    r"SELECT key, CASE WHEN length(trim(text)) <= 120 THEN trim(text) ELSE regexp_replace(regexp_replace(substr(trim(text), 1, 120), ' [^ ]*$', ''), "
    r"'[,;:]+$', '') || ' …' END AS short FROM turn_ WHERE text IS NOT NULL"))
def trim_words(spark: SparkSession, d: str) -> DataFrame:
    t = F.trim("text")
    cut = F.concat(F.regexp_replace(F.regexp_replace(F.substring(t, 1, 120), " [^ ]*$", ""), "[,;:]+$", ""), F.lit(" …"))
    return Tables(spark, d).turn.where("text IS NOT NULL").select("key", F.when(F.length(t) <= 120, t).otherwise(cut).alias("short"))


_PAGE_SQL = "'<h6>' || coalesce(time, '') || '</h6><p><strong>' || coalesce(speaker, '') || '</strong>: ' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), chr(10), '</p><p>') || '</p>'"


def pages(t: Tables) -> DataFrame:
    """Each turn as the page that its transcript was read from."""
    return t.turn.where("text IS NOT NULL").select("key", F.expr(_PAGE_SQL.replace("chr(10)", "'\\n'")).alias("html"))


@R.query("html_to_text", current_sql(
    f", p AS (SELECT key, {_PAGE_SQL} AS html FROM turn_ WHERE text IS NOT NULL) SELECT key, "
    f"md5(trim(regexp_replace({X.UNESCAPED_SQL.format('regexp_replace(html, ' + chr(39) + '<[^>]+>' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}, "
    f"'\\s+', ' ', 'g'))) AS text_md5 FROM p"))
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    return pages(Tables(spark, d)).select("key", F.md5(F.trim(F.regexp_replace(X.unescaped(F.regexp_replace("html", "<[^>]+>", " ")), r"\s+", " "))).alias("text_md5"))


@R.query("html_paragraphs", current_sql(
    f", p AS (SELECT key, regexp_extract_all({_PAGE_SQL}, '(?s)<p>(.*?)</p>', 1) AS x FROM turn_ WHERE text IS NOT NULL) SELECT key, len(x) AS n, "
    f"md5(array_to_string(x, chr(10))) AS md5 FROM p"))
def html_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    x = F.regexp_extract_all("html", F.lit("(?s)<p>(.*?)</p>"), F.lit(1))
    return pages(Tables(spark, d)).select("key", F.size(x).cast("long").alias("n"), F.md5(F.array_join(x, "\n")).alias("md5"))


@R.query("html_turns")
def html_turns(spark: SparkSession, d: str) -> DataFrame:
    """Pages with irregular mark-up as turns: (time, speaker, body)."""
    from lectern.sources.html import page_turns

    return page_turns(pages(Tables(spark, d)), "key", "html")


@R.query("id_parts", current_sql(
    r"SELECT id, regexp_extract(id, '^(.*)#t(\d+)#c(\d+)$', 1) AS report, TRY_CAST(regexp_extract(id, '^(.*)#t(\d+)#c(\d+)$', 2) AS INTEGER) AS turn, "
    r"TRY_CAST(regexp_extract(id, '^(.*)#t(\d+)#c(\d+)$', 3) AS INTEGER) AS part FROM chunk_"))
def id_parts(spark: SparkSession, d: str) -> DataFrame:
    part = lambda i: F.regexp_extract("id", r"^(.*)#t(\d+)#c(\d+)$", i)
    return Tables(spark, d).chunk.select("id", part(1).alias("report"), part(2).try_cast("int").alias("turn"), part(3).try_cast("int").alias("part"))


@R.query("token_estimate", current_sql(
    r"SELECT key, len(regexp_extract_all(text, '[A-Za-z0-9]+|[.,;:!?''\x22()%-]+')) + 2 AS tokens, length(text) // 4 AS quarter, length(text) // 4 > 2048 AS "
    r"over FROM turn_ WHERE text IS NOT NULL"))
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    n = F.size(F.regexp_extract_all("text", F.lit(r"([A-Za-z0-9]+|[.,;:!?'\x22()%-]+)"), F.lit(1))) + 2
    quarter = F.floor(F.length("text") / 4)
    return Tables(spark, d).turn.where("text IS NOT NULL").select("key", n.cast("long").alias("tokens"), quarter.alias("quarter"), (quarter > 2048).alias("over"))


# Section groups by type label or id prefix.
SECTION_GROUPS = {
    "Oral Answers to Questions": "oral", "Written Answers to Questions": "written", "Bills": "bill", "Bills Introduced": "bill", "Bill": "bill", "Second Reading Bills": "bill", "Budget": "budget", "Committee of Supply": "budget",
    "Motions": "motion", "Motion": "motion", "Ministerial Statements": "statement", "Ministerial Statement": "statement", "Matter Raised On Adjournment Motion": "adjournment", "Correction by Written Statement": "correction", "Tributes": "tribute", "Petitions": "petition",
    "oral-answer": "oral", "written-answer": "written", "written-answer-na": "written", "bill": "bill", "bill-intro": "bill", "budget": "budget", "president-address": "budget", "motion": "motion", "ministerial-statement": "statement", "matter-adj": "adjournment", "written-statement": "correction", "tribute": "tribute", "petition": "petition",
}
_GROUPS_SQL = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in SECTION_GROUPS.items()) + "}"


@R.query("group_for", current_sql(rf"SELECT report_id, coalesce({_GROUPS_SQL}[report_type], {_GROUPS_SQL}[regexp_replace(report_id, '-\d+$', '')], 'other') AS section FROM report_"))
def group_for(spark: SparkSession, d: str) -> DataFrame:
    groups = F.create_map(*(F.lit(x) for kv in SECTION_GROUPS.items() for x in kv))
    section = F.coalesce(F.try_element_at(groups, F.col("report_type")), F.try_element_at(groups, F.regexp_replace("report_id", r"-\d+$", "")), F.lit("other"))
    return Tables(spark, d).report.select("report_id", section.alias("section"))


# dates and numbers


@R.query("iso_date", current_sql("SELECT report_id, strftime(try_strptime(sitting_date, '%-d-%-m-%Y'), '%Y-%m-%d') AS iso, strftime(try_strptime(sitting_date, '%-d-%-m-%Y'), '%Y-%m-%d') = date AS agrees FROM report_"))
def iso_date(spark: SparkSession, d: str) -> DataFrame:
    iso = F.date_format(F.try_to_date("sitting_date", "d-M-yyyy"), "yyyy-MM-dd")
    return Tables(spark, d).report.select("report_id", iso.alias("iso"), (iso == F.col("date")).alias("agrees"))


@R.query("clock_minutes", current_sql(f"SELECT key, time, CASE WHEN {_CLOCK_SQL.format(3)} <> '' THEN {_MINUTES_SQL.replace('CAST(', 'TRY_CAST(')} END AS minutes FROM turn_ WHERE time IS NOT NULL"))
def clock_minutes_query(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).turn.where("time IS NOT NULL").select("key", "time", clock_minutes("time").alias("minutes"))


@R.query("selection_target", current_sql(X.SENT_SQL +
    " SELECT report_id, count(*) AS n, CAST(least(greatest(8, CAST(round(0.14 * count(*) - 0.000001) AS BIGINT)), greatest(1, CAST(round(0.6 * count(*) - "
    "0.000001) AS BIGINT))) AS BIGINT) AS target FROM sent_ GROUP BY 1"))
def selection_target(spark: SparkSession, d: str) -> DataFrame:
    part = lambda p: F.round(F.lit(p) * F.col("n") - 0.000001).cast("long")
    n = sentence_rows(Tables(spark, d)).groupBy("report_id").agg(F.count("*").alias("n"))
    return n.select("report_id", "n", F.least(F.greatest(F.lit(8), part(0.14)), F.greatest(F.lit(1), part(0.6))).alias("target"))


# ranking

QUERY = ["rebate", "caregivers", "polyclinic", "rebate", "waiting"]
_QUERY_SQL = "(VALUES " + ", ".join(f"('{t}', {QUERY.count(t)})" for t in dict.fromkeys(QUERY)) + ") q(term, w)"


def bm25_sql(docs: str, key: str, text: str) -> str:
    """Common table expressions up to `scored` (key, score)."""
    return f"""t AS (SELECT {key} AS k, {X.TOKENS_SQL.format(text)} AS ts FROM {docs} WHERE {text} IS NOT NULL), n AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM t),
tf AS (SELECT k, len(ts) AS dl, term, w, len(list_filter(ts, lambda x: x = term)) AS tf FROM t, {_QUERY_SQL} WHERE list_contains(ts, term)), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
scored AS (SELECT k, sum(w * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN df USING (term), n GROUP BY 1)"""


@R.query("bm25_topk", f"WITH {bm25_sql('documents', 'doc_id', 'text')} SELECT k AS doc_id, round(score, 6) AS score FROM scored ORDER BY round(score, 6) DESC, k LIMIT 20")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").where("text IS NOT NULL")
    scored = bm25(docs, "doc_id", "text", QUERY).withColumn("score", F.round("score", 6))
    return scored.orderBy(F.desc("score"), "doc_id").limit(20)


@R.query("bm25_stats",
    f"WITH t AS (SELECT doc_id, {X.TOKENS_SQL.format('text')} AS ts FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, unnest(ts) AS term FROM t) "
    f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM p GROUP BY 1")
def bm25_stats(spark: SparkSession, d: str) -> DataFrame:
    p = postings(load(spark, d, "documents").where("text IS NOT NULL"), "doc_id", "text")
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


_COS_SQL = (
    "q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)), c AS (SELECT label, vec_id, "
    "list_dot_product(CAST(embedding AS DOUBLE[]), q) / greatest(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * "
    "sqrt(list_dot_product(q, q)), 1e-12) AS cos FROM embeddings, q)"
)


def query_cosines(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    q = e.agg(F.min_by("e", "vec_id")).scalar()
    return e.withColumn("q", q).select("vec_id", "label", cosine(F.col("e"), F.col("q")).alias("cos"))


@R.query("vector_maxpool_rank", f"WITH {_COS_SQL} SELECT label, round(max(cos), 6) AS score FROM c GROUP BY 1")
def vector_maxpool_rank(spark: SparkSession, d: str) -> DataFrame:
    return query_cosines(spark, d).groupBy("label").agg(F.round(F.max("cos"), 6).alias("score"))


@R.query(
    "rrf_fusion",
    f"""WITH {_COS_SQL}, a AS (SELECT vec_id, row_number() OVER (ORDER BY round(cos, 6) DESC, vec_id) AS rank FROM c QUALIFY rank <= 50), b AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id DESC) AS rank FROM c WHERE label % 2 = 0 QUALIFY rank <= 50)
SELECT vec_id, round(sum(1.0 / (60 + rank)), 8) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1""",
)
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    c = query_cosines(spark, d)
    a = top_rank(c.withColumn("cos", F.round("cos", 6)), "vec_id", "cos", 50)
    b = top_rank(c.where("label % 2 = 0").withColumn("newest", F.col("vec_id")), "vec_id", "newest", 50)
    return fuse([a, b], "vec_id").select("vec_id", F.round("score", 8).alias("score"))


@R.query("derive_constraints")
def derive_constraints(spark: SparkSession, d: str) -> DataFrame:
    """Years (ranges expanded) and the subject that a text names; no years and '' where it names none."""
    q = load(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text")
    pairs = F.regexp_extract_all("text", F.lit(r"etween ((?:19|20)\d\d) and (?:(?:19|20)\d\d)"), F.lit(1))
    ends = F.regexp_extract_all("text", F.lit(r"etween (?:(?:19|20)\d\d) and ((?:19|20)\d\d)"), F.lit(1))
    ranges = F.flatten(F.transform(F.arrays_zip(pairs.alias("a"), ends.alias("b")), lambda x: F.sequence(F.least(x["a"].cast("int"), x["b"].cast("int")), F.greatest(x["a"].cast("int"), x["b"].cast("int")))))
    years = F.transform(F.regexp_extract_all("text", F.lit(r"\b((?:19|20)\d\d)\b"), F.lit(1)), lambda y: y.cast("int"))
    subject = F.regexp_extract(F.lower("text"), r"\b(take-up rate|waiting list|service standard|rebate|permit|grant)\b", 1)
    return q.select("doc_id", F.array_sort(F.array_distinct(F.concat(ranges, years))).alias("years"), subject.alias("subject"))


@R.query("overlap_pairs", current_sql(X.SENT_SQL + """, w AS (SELECT key, i, list_sort(list_distinct(regexp_extract_all(lower(s), '[a-z]{4,}'))) AS ws FROM sent_), j AS (SELECT a.key, a.i, a.ws AS x, b.ws AS y FROM w a JOIN w b ON b.key = a.key AND b.i = a.i + 1 WHERE len(a.ws) > 0 AND len(b.ws) > 0)
SELECT key, CAST(i AS INTEGER) AS i, round(len(list_intersect(x, y)) * 1.0 / least(len(x), len(y)), 6) AS overlap FROM j"""))
def overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    """How much of the shorter of two neighbouring sentences is in the other."""
    w = sentence_rows(Tables(spark, d)).select("key", "i", F.array_distinct(F.regexp_extract_all(F.lower("s"), F.lit("([a-z]{4,})"), F.lit(1))).alias("x"))
    n = w.withColumn("y", F.lead("x").over(Window.partitionBy("key").orderBy("i"))).where("size(x) > 0 AND size(y) > 0")
    return n.select("key", "i", F.round(F.size(F.array_intersect("x", "y")) / F.least(F.size("x"), F.size("y")), 6).alias("overlap"))


_ND_SQL = """, w AS (SELECT report_id, key, turn, i, list_sort(list_distinct(regexp_extract_all(lower(s), '[a-z]{4,}'))) AS ws FROM sent_), g AS (SELECT report_id, ws, min((turn, i, key)) AS f, count(*) AS copies FROM w WHERE len(ws) >= 3 GROUP BY 1, 2),
h AS (SELECT DISTINCT b.report_id, b.ws FROM g a JOIN g b ON b.report_id = a.report_id AND a.f < b.f WHERE len(list_intersect(a.ws, b.ws)) >= 0.75 * least(len(a.ws), len(b.ws)))
SELECT g.report_id, g.f[3] AS key, CAST(g.f[2] AS INTEGER) AS i, g.copies, h.report_id IS NOT NULL AS repeats_earlier FROM g LEFT JOIN h ON h.report_id = g.report_id AND h.ws = g.ws"""


@R.query("near_duplicates", current_sql(X.SENT_SQL + _ND_SQL))
def near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Of each report's sentences with different words, which repeats an earlier one: three quarters of the
    words of the shorter are in both. Copies are one class with their number."""
    t = Tables(spark, d)
    s = t.turn.where("text IS NOT NULL").select("report_id", "turn", "key", F.posexplode(X.unstripped_sentences("text")).alias("i", "s"))
    words = F.array_join(F.sort_array(F.array_distinct(F.regexp_extract_all(F.lower("s"), F.lit("([a-z]{4,})"), F.lit(1)))), " ")
    three = F.filter(F.array(words), lambda ws: ws.like("% % %"))  # exploded, so that words are looked for once, not in a filter too
    w = s.select("report_id", "turn", "i", "key", F.explode(three).alias("ws"))
    return repeated_sets(w, t.raw("turn").groupBy("report_id").agg(F.sum(F.length("text")).alias("chars")))


# extraction


@R.query("figures_topk", current_sql(r""", f AS (SELECT report_id, turn, key, unnest(regexp_extract_all(text, 'S?\$[0-9][0-9.,]*\s?(?:billion|million)|[0-9][0-9.,]*\s?(?:per cent|%)')) AS v FROM turn_ WHERE lang = 'English' AND words >= 8),
k AS (SELECT *, replace(lower(regexp_replace(v, '[,.;:]+$', '')), ' ', '') AS norm FROM f), d AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY norm ORDER BY report_id, turn, v) = 1),
m AS (SELECT *, CAST(replace(regexp_extract(norm, '([0-9][0-9.,]*[0-9]|[0-9])', 1), ',', '') AS DOUBLE) * CASE WHEN norm LIKE '%billion' THEN 1e9 WHEN norm LIKE '%million' THEN 1e6 WHEN norm LIKE '%\%' ESCAPE '\' OR norm LIKE '%percent' THEN 1e3 ELSE 1 END AS magnitude FROM d)
SELECT norm, key, magnitude FROM m ORDER BY magnitude DESC, norm LIMIT 14"""))
def figures_topk(spark: SparkSession, d: str) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit(r"(S?\$[0-9][0-9.,]*\s?(?:billion|million)|[0-9][0-9.,]*\s?(?:per cent|%))"), F.lit(1))
    f = Tables(spark, d).turn.where("lang = 'English' AND words >= 8").select("report_id", "turn", "key", F.explode(found).alias("v"))
    k = f.withColumn("norm", F.replace(F.lower(F.regexp_replace("v", "[,.;:]+$", "")), F.lit(" "), F.lit("")))
    d1 = k.groupBy("norm").agg(F.min(F.struct("report_id", "turn", "v", "key"))["key"].alias("key"))
    unit = F.when(F.col("norm").endswith("billion"), 1e9).when(F.col("norm").endswith("million"), 1e6).when(F.col("norm").endswith("%") | F.col("norm").endswith("percent"), 1e3).otherwise(1.0)
    n = F.replace(F.regexp_extract("norm", "([0-9][0-9.,]*[0-9]|[0-9])", 1), F.lit(","), F.lit("")).cast("double")
    return d1.select("norm", "key", (n * unit).alias("magnitude")).orderBy(F.desc("magnitude"), "norm").limit(14)


# rules

# Phrases of formal corrections, of the speaker's own words, and of corrections as an instrument of policy.
_HIGH = r"(?i)factual correction|should read as follows|correction to the (reply|answer|statement)"
_SELF = (
    r"(?i)to the reply given|to what i said|my reply should read|my (statement|answer) should read|i wish to (make|correct)|i would like to correct|to "
    r"(my|the) (earlier|previous) (reply|statement)|at the sitting on|at the sitting of"
)
_MECHANISM = r"(?i)pofma|protection from online falsehoods|falsehood|false claim|issue a correction|correction direction|publisher"


@R.query(
    "supersession_links",
    current_sql(f"""SELECT a.key AS announce_turn, b.key AS supersede_turn, regexp_extract(a.text, '{_HIGH}') AS evidence, CASE WHEN b.key IS NOT NULL THEN coalesce(a.speaker, '') = coalesce(b.speaker, '') END AS same_speaker
FROM turn_ a LEFT JOIN turn_ b ON b.report_id = a.report_id AND b.turn = a.turn + 1 WHERE regexp_matches(a.text, '{_HIGH}') AND regexp_matches(a.text, '{_SELF}') AND NOT regexp_matches(a.text, '{_MECHANISM}')"""),
)
def supersession_links(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d).turn.select("key", "report_id", "turn", "speaker", "text")
    a = t.where(F.col("text").rlike(_HIGH) & F.col("text").rlike(_SELF) & ~F.col("text").rlike(_MECHANISM)).select(F.col("key").alias("announce_turn"), "report_id", (F.col("turn") + 1).alias("turn"), F.col("speaker").alias("s"), F.regexp_extract("text", f"({_HIGH})", 1).alias("evidence"))
    b = t.select("report_id", "turn", F.col("key").alias("supersede_turn"), F.coalesce("speaker", F.lit("")).alias("s2"))
    j = a.join(b, ["report_id", "turn"], "left")
    return j.select("announce_turn", "supersede_turn", "evidence", F.when(F.col("supersede_turn").isNotNull(), F.coalesce("s", F.lit("")) == F.col("s2")).alias("same_speaker"))


@R.query(
    "resolve_fallback",
    r"""WITH r AS (SELECT member_id, lower(split_part(full_name, ' ', 1)) AS a, lower(regexp_extract(full_name, '([^ ]+)$', 1)) AS b FROM roster), u AS (SELECT a, b, min(member_id) AS member_id FROM r GROUP BY 1, 2 HAVING count(*) = 1),
s AS (SELECT DISTINCT speaker, lower(regexp_extract(n, '^([^ ]+)', 1)) AS a, lower(regexp_extract(n, '([^ ]+)$', 1)) AS b FROM (SELECT speaker, trim(regexp_replace(regexp_replace(speaker, '\s*\([^()]*\)\s*$', ''), '^((Mr|Mrs|Ms|Mdm|Dr|Assoc Prof|Er Dr)\.?\s+)+', '')) AS n FROM turn WHERE speaker IS NOT NULL))
SELECT s.speaker, u.member_id FROM s JOIN u USING (a, b)""",
)
def resolve_fallback(spark: SparkSession, d: str) -> DataFrame:
    """By first and last word of a name, where only one member has both."""
    r = load(spark, d, "roster").select("member_id", F.lower(F.split_part("full_name", F.lit(" "), F.lit(1))).alias("a"), F.lower(F.regexp_extract("full_name", "([^ ]+)$", 1)).alias("b"))
    u = r.groupBy("a", "b").agg(F.min("member_id").alias("member_id"), F.count("*").alias("n")).where("n = 1").drop("n")
    n = F.trim(F.regexp_replace(F.regexp_replace("speaker", r"\s*\([^()]*\)\s*$", ""), r"^((Mr|Mrs|Ms|Mdm|Dr|Assoc Prof|Er Dr)\.?\s+)+", ""))
    s = load(spark, d, "turn").select("speaker").where("speaker IS NOT NULL").distinct().withColumn("n", n)
    return s.select("speaker", F.lower(F.regexp_extract("n", "^([^ ]+)", 1)).alias("a"), F.lower(F.regexp_extract("n", "([^ ]+)$", 1)).alias("b")).join(u, ["a", "b"]).select("speaker", "member_id")
