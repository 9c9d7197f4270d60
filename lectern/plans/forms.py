"""Text forms, labels, orders and small joins that stand beside the larger plans."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import significance as G
from lectern.functions import text as X
from lectern.functions.significance import minimal_sentences
from lectern.operators.current import Tables, current_sql
from lectern.operators.sequences import carried_forward, neighbours, packed, running_total
from lectern.plans.documents import marks
from lectern.plans.registry import Registry
from lectern.plans.retrieval import QUESTIONS, retrieve
from lectern.plans.rules import SCREEN_SQL, _hit, salience_sql
from lectern.sources import checkpointed, load

R = Registry()

# text forms


@R.query("split_minimal", current_sql(
    f", p AS (SELECT key, list_filter(string_split(regexp_replace({X.STRIPPED_SQL.format('text')}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda v: "
    f"v <> '') AS x FROM turn_ WHERE text IS NOT NULL) SELECT key, len(x) AS n, md5(array_to_string(x, '|')) AS md5 FROM p"))
def split_minimal(spark: SparkSession, d: str) -> DataFrame:
    """A split at every end mark before a blank."""
    x = minimal_sentences("text")
    return Tables(spark, d).turn.where("text IS NOT NULL").select("key", F.size(x).cast("long").alias("n"), F.md5(F.array_join(x, "|")).alias("md5"))


@F.pandas_udf(T.StringType())
def compare_form(texts: pd.Series) -> pd.Series:
    """Compatibility forms unified and runs of blanks as one; null counts as empty."""
    return texts.map(lambda t: " ".join(unicodedata.normalize("NFKC", t or "").split()))


@R.query("compare_forms")
def compare_forms(spark: SparkSession, d: str) -> DataFrame:
    """Whether a chunk's text is in its turn as stored, or only in the form in which texts are compared."""
    t = Tables(spark, d)
    j = t.chunk.select("id", "turn_key", "cite_text").join(t.turn.select(F.col("key").alias("turn_key"), "text"), "turn_key")
    exact = F.coalesce(F.contains("text", "cite_text"), F.lit(False))
    return j.select("id", F.when(exact, "exact").when(F.contains(compare_form("text"), compare_form("cite_text")), "blanks_or_forms").otherwise("different").alias("found"))


_INVISIBLE = "[﻿​‌‍‎‏⁠]"


@R.query("invisible_strip", f"SELECT DISTINCT speaker, trim(regexp_replace(speaker, '{_INVISIBLE}', '', 'g')) AS clean FROM turn WHERE speaker IS NOT NULL")
def invisible_strip(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "turn").select("speaker").where("speaker IS NOT NULL").distinct()
    return s.select("speaker", F.trim(F.regexp_replace("speaker", _INVISIBLE, "")).alias("clean"))


@R.query("html_escape", current_sql(
    "SELECT key, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS html_md5 "
    "FROM turn_ WHERE text IS NOT NULL"))
def html_escape(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("text")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return Tables(spark, d).turn.where("text IS NOT NULL").select("key", F.md5(c).alias("html_md5"))


#: Characters that a text keeps, and the shares that its beginning and its end have of them.
BUDGET, HEAD, TAIL = 4000, 0.7, 0.25
_GAP = "\n\n[...]\n\n"


@R.query("head_tail", current_sql(
    f"SELECT key, length(text) > {BUDGET} AS cut, md5(CASE WHEN length(text) > {BUDGET} THEN left(text, {int(BUDGET * HEAD)}) || chr(10) || chr(10) || "
    f"'[...]' || chr(10) || chr(10) || right(text, {int(BUDGET * TAIL)}) ELSE text END) AS kept_md5 FROM turn_ WHERE text IS NOT NULL"))
def head_tail(spark: SparkSession, d: str) -> DataFrame:
    """A text beyond the budget without its middle."""
    long = F.length("text") > BUDGET
    cut = F.concat(F.left("text", F.lit(int(BUDGET * HEAD))), F.lit(_GAP), F.right("text", F.lit(int(BUDGET * TAIL))))
    return Tables(spark, d).turn.where("text IS NOT NULL").select("key", long.alias("cut"), F.md5(F.when(long, cut).otherwise(F.col("text"))).alias("kept_md5"))


@R.query("empty_when_cleaned", current_sql(r"SELECT key, length(text) AS n FROM turn_ WHERE text <> '' AND regexp_replace(regexp_replace(text, '\[[^\]]{0,200}\]', ' ', 'g'), '[\s\x{A0}]+', '', 'g') = ''"))
def empty_when_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Texts of which nothing is left without asides and blanks."""
    bare = F.regexp_replace(X.strip_asides("text"), r"[\s ]+", "")
    return Tables(spark, d).turn.where("text <> ''").where(bare == "").select("key", F.length("text").cast("long").alias("n"))


@R.query(
    "short_ids",
    current_sql("""
, i AS (SELECT DISTINCT date, report_id FROM report_), m AS (SELECT date, min(report_id) AS lo, max(report_id) AS hi FROM i GROUP BY 1),
p AS (SELECT date, lo, hi, len(list_filter(generate_series(1, length(lo)), lambda k: left(lo, k) = left(hi, k))) AS n FROM m),
c AS (SELECT i.date, i.report_id, lo <> hi AS several, greatest(0, CASE WHEN contains(left(report_id, n), '-') THEN n - strpos(reverse(left(report_id, n)), '-') + 1 ELSE 0 END, CASE WHEN contains(left(report_id, n), '+') THEN n - strpos(reverse(left(report_id, n)), '+') + 1 ELSE 0 END) AS cut FROM i JOIN p USING (date))
SELECT date, report_id, CASE WHEN NOT several OR length(trim(substr(report_id, cut + 1), '+-')) < 2 THEN report_id ELSE trim(substr(report_id, cut + 1), '+-') END AS short FROM c WHERE date IS NOT NULL"""),
)
def short_ids(spark: SparkSession, d: str) -> DataFrame:
    """A day's report ids without what all begin with, cut behind a separator; the whole id where less than two letters
    would be left. What the first and the last in order share at the beginning, all do."""
    i = Tables(spark, d).report.where("date IS NOT NULL").select("date", "report_id").distinct()
    m = i.groupBy("date").agg(F.min("report_id").alias("lo"), F.max("report_id").alias("hi"))
    n = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.length("lo"), F.lit(1))), lambda k: F.substring(F.col("lo"), F.lit(1), k) == F.substring(F.col("hi"), F.lit(1), k)))
    j = i.join(m.select("date", n.alias("n"), (F.col("lo") != F.col("hi")).alias("several")), "date")
    shared = F.substring(F.col("report_id"), F.lit(1), F.col("n"))
    cut = F.greatest(*(F.when(F.contains(shared, F.lit(s)), F.length(shared) - F.instr(F.reverse(shared), F.lit(s)) + 1).otherwise(0) for s in "-+"))
    rest = F.regexp_replace(F.substring(F.col("report_id"), cut + 1, F.length("report_id")), "^[+-]+|[+-]+$", "")
    return j.select("date", "report_id", F.when(~F.col("several") | (F.length(rest) < 2), F.col("report_id")).otherwise(rest).alias("short"))


# dates, defaults, arrays


@R.query("year_of_date", current_sql("SELECT key, try_cast(substr(date, 1, 4) AS INTEGER) AS year_of, try_cast(substr(date, 1, 4) AS INTEGER) IS NOT DISTINCT FROM year AS agrees FROM turn_"))
def year_of_date(spark: SparkSession, d: str) -> DataFrame:
    y = F.substring("date", 1, 4).try_cast("int")
    return Tables(spark, d).turn.select("key", y.alias("year_of"), y.eqNullSafe(F.col("year")).alias("agrees"))


@R.query("day_label", current_sql("SELECT DISTINCT date, coalesce(strftime(try_cast(date AS DATE), '%-d %B %Y'), date, '') AS label FROM report_"))
def day_label(spark: SparkSession, d: str) -> DataFrame:
    label = F.coalesce(F.date_format(F.try_to_date("date", "yyyy-MM-dd"), "d MMMM yyyy"), "date", F.lit(""))
    return Tables(spark, d).report.select("date").distinct().select("date", label.alias("label"))


@R.query("runaway_cap", current_sql(X.SENT_SQL + " SELECT report_id, count(*) AS sentences, greatest(120, CAST(round(0.25 * count(*) - 0.000001) AS BIGINT)) AS cap FROM sent_ GROUP BY 1"))
def runaway_cap(spark: SparkSession, d: str) -> DataFrame:
    """How many points a report may have at most before something has gone wrong."""
    n = Tables(spark, d).turn.where("text IS NOT NULL").select("report_id", F.size(X.sentences("text")).alias("n")).groupBy("report_id").agg(F.sum("n").alias("sentences")).where("sentences > 0")
    return n.select("report_id", "sentences", F.greatest(F.lit(120), F.round(F.lit(0.25) * F.col("sentences") - 0.000001).cast("long")).alias("cap"))


@R.query("nested_defaults", current_sql(
    "SELECT report_id, coalesce(nullif(trim(title), ''), nullif(trim(report_type), ''), 'untitled') AS name, coalesce(group_name, regexp_extract(report_id, "
    "'^([a-z][a-z0-9-]*?)-[0-9]+$', 1), '') AS section FROM report_"))
def nested_defaults(spark: SparkSession, d: str) -> DataFrame:
    """Fields of a nested record with what stands in where they are missing."""
    r = Tables(spark, d).report.select("report_id", F.struct("title", "report_type", F.struct("group_name").alias("meta")).alias("r"))
    given = lambda c: F.nullif(F.trim(c), F.lit(""))
    section = F.coalesce("r.meta.group_name", F.regexp_extract("report_id", "^([a-z][a-z0-9-]*?)-[0-9]+$", 1), F.lit(""))
    return r.select("report_id", F.coalesce(given("r.title"), given("r.report_type"), F.lit("untitled")).alias("name"), section.alias("section"))


@R.query("array_ops",
    "SELECT DISTINCT snapshot_no, report_id, array_to_string(list_sort(list_distinct(turn_hashes)), ',') AS sorted_set, list_position(turn_hashes, "
    "list_min(turn_hashes)) AS least_at, list_contains(turn_hashes, 'none') AS has_none FROM report_snapshot WHERE len(turn_hashes) > 0")
def array_ops(spark: SparkSession, d: str) -> DataFrame:
    """Sets, membership and places in arrays."""
    s = load(spark, d, "report_snapshot").where("size(turn_hashes) > 0")
    h = F.col("turn_hashes")
    return s.select("snapshot_no", "report_id", F.array_join(F.array_sort(F.array_distinct(h)), ",").alias("sorted_set"), F.array_position(h, F.array_min(h)).alias("least_at"), F.array_contains(h, "none").alias("has_none")).distinct()


# orders and runs


@R.query("longest_per_date", current_sql(
    ", w AS (SELECT date, report_id, CAST(sum(words) AS BIGINT) AS words FROM turn_ GROUP BY 1, 2) SELECT date, report_id, words FROM w QUALIFY "
    "row_number() OVER (PARTITION BY date ORDER BY words DESC NULLS LAST, report_id) = 1"))
def longest_per_date(spark: SparkSession, d: str) -> DataFrame:
    w = Tables(spark, d).turn.groupBy("date", "report_id").agg(F.sum("words").alias("words"))
    best = F.min(F.struct((-F.coalesce("words", F.lit(-1))).alias("m"), "report_id", "words")).alias("b")
    return w.groupBy("date").agg(best).select("date", "b.report_id", "b.words")


@R.query("newest_items", current_sql("SELECT year, item_id, title FROM item_ ORDER BY year DESC NULLS LAST, item_id LIMIT 50"))
def newest_items(spark: SparkSession, d: str) -> DataFrame:
    """The fifty newest items, newest first."""
    return Tables(spark, d).item.select("year", "item_id", "title").orderBy(F.desc_nulls_last("year"), "item_id").limit(50)


@R.query("suggestions")
def suggestions(spark: SparkSession, d: str) -> DataFrame:
    """The reports of a question's turns, each once, in the order of time."""
    t = Tables(spark, d)
    found = F.broadcast(retrieve(t.chunk, t.pair, QUESTIONS[0]).where("turn_key IS NOT NULL").select(F.col("turn_key").alias("key")))  # a top-k
    return t.turn.select("key", "report_id", "date", "title").join(found, "key").select("date", "report_id", "title").distinct().orderBy("date", "report_id")


#: Rows after which a name is shown again.
AGAIN = 6


@R.query(
    "names_again",
    current_sql(f""", s AS (SELECT report_id, turn, key, speaker, CASE WHEN turn = min(turn) OVER (PARTITION BY report_id) OR speaker IS DISTINCT FROM lag(speaker) OVER w THEN 1 ELSE 0 END AS new_ FROM turn_ WINDOW w AS (PARTITION BY report_id ORDER BY turn)),
r AS (SELECT *, sum(new_) OVER (PARTITION BY report_id ORDER BY turn) AS run FROM s) SELECT key, CAST(row_number() OVER (PARTITION BY report_id, run ORDER BY turn) - 1 AS BIGINT) AS since, (row_number() OVER (PARTITION BY report_id, run ORDER BY turn) - 1) % {AGAIN} = 0 AS shown FROM r"""),
)
def names_again(spark: SparkSession, d: str) -> DataFrame:
    """How many rows ago a speaker began, and whether the name is shown: where it changes, and after some rows again."""
    t = Tables(spark, d).turn.select("report_id", "turn", "key", "speaker", F.lit(True).alias("there"))
    t = neighbours(t, "report_id", "turn", ["speaker", "there"], before=True)
    t = t.withColumn("new", F.col("__there").isNull() | ~F.col("speaker").eqNullSafe(F.col("__speaker")))
    t = running_total(t.select("report_id", "turn", "key", "new"), "report_id", "turn", F.lit(1), "n")
    t = carried_forward(t.withColumn("began", F.when(F.col("new"), F.col("n"))), "report_id", "turn", ["began"])
    since = (F.col("n") - F.col("began")).cast("long")
    return t.select("key", since.alias("since"), (since % AGAIN == 0).alias("shown"))


@R.query(
    "overlay_runs",
    current_sql("""
, w AS (SELECT key, lower(text) AS low, length(text) AS n, unnest(['rebate', 'permit', 'caregivers', 'grant', 'service standard']) AS w FROM turn_ WHERE text IS NOT NULL),
sp AS (SELECT key, s, s + 20 AS e, CASE WHEN w IN ('rebate', 'permit') THEN 2 ELSE 1 END AS kind FROM (SELECT key, n, w, unnest(list_filter(generate_series(0, n - length(w)), lambda i: substr(low, i + 1, length(w)) = w)) AS s FROM w WHERE contains(low, w)) WHERE s + 20 <= n),
c AS (SELECT key, i, max(kind) AS kind FROM (SELECT key, kind, unnest(generate_series(s, e - 1)) AS i FROM sp UNION ALL SELECT key, 0, unnest(generate_series(0, length(text) - 1)) FROM turn_ WHERE text <> '' AND key IN (SELECT key FROM sp)) GROUP BY 1, 2),
g AS (SELECT key, kind, i, i - row_number() OVER (PARTITION BY key, kind ORDER BY i) AS island FROM c)
SELECT key, CAST(min(i) AS INTEGER) AS s, CAST(max(i) + 1 AS INTEGER) AS e, CASE kind WHEN 2 THEN 'cited' WHEN 1 THEN 'marked' ELSE 'plain' END AS kind FROM g GROUP BY key, kind, island"""),
)
def overlay_runs(spark: SparkSession, d: str) -> DataFrame:
    """A text with marks as runs of characters, cited before marked before plain; joined, the runs are the text. Texts are
    split at the borders of marks, so what is ordered are borders, not characters."""
    m = marks(Tables(spark, d), word=True).where("e <= n").select("key", "s", "e", F.when(F.col("w").isin("rebate", "permit"), 2).otherwise(1).alias("kind"), "n").distinct()
    borders = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0), F.max("n")), F.flatten(F.collect_list(F.array("s", "e"))))))
    t = m.groupBy("key").agg(borders.alias("b"), F.collect_list(F.struct("s", "e", "kind")).alias("x"))
    pieces = F.transform(F.slice("b", F.lit(1), F.size("b") - 1), lambda a, i: F.struct(a.alias("s"), F.col("b")[i + 1].alias("e")))
    t = t.select("key", "x", F.explode(pieces).alias("p"))
    kind = F.coalesce(F.array_max(F.transform(F.filter("x", lambda v: (v["s"] <= F.col("p.s")) & (v["e"] >= F.col("p.e"))), lambda v: v["kind"])), F.lit(0))
    t = t.select("key", "p.s", "p.e", kind.alias("kind"))
    w = Window.partitionBy("key").orderBy("s")
    t = t.withColumn("run", F.sum(F.coalesce((F.col("kind") != F.lag("kind").over(w)).cast("int"), F.lit(0))).over(w))
    name = F.when(F.col("kind") == 2, "cited").when(F.col("kind") == 1, "marked").otherwise("plain")
    return t.groupBy("key", "run", name.alias("kind")).agg(F.min("s").alias("s"), F.max("e").alias("e")).select("key", "s", "e", "kind")


# joins


@R.query("item_reports", current_sql("SELECT l.item_id, l.ordinal, r.report_id, r.date, r.title FROM link_ l JOIN report_ r ON r.report_id = l.report_id"))
def item_reports(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return t.link.select("item_id", "ordinal", "report_id").join(t.report.select("report_id", "date", "title"), "report_id").select("item_id", "ordinal", "report_id", "date", "title")


@R.query("probe_selection", current_sql(
    "SELECT c.id, t.key, r.date FROM chunk_ c JOIN turn_ t ON t.key = c.turn_key JOIN report_ r ON r.report_id = t.report_id WHERE c.cite_text LIKE "
    "'%rebate%' AND t.words BETWEEN 40 AND 200"))
def probe_selection(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with a word, of turns of a middle length, with the date of their report."""
    t = Tables(spark, d)
    c = t.chunk.where(F.col("cite_text").contains("rebate")).select("id", F.col("turn_key").alias("key"))
    return c.join(t.turn.where(F.col("words").between(40, 200)).select("key", "report_id"), "key").join(t.report.select("report_id", "date"), "report_id").select("id", "key", "date")


@R.query("paragraph_match", current_sql(
    f"SELECT c.id, t.key IS NOT NULL AS matched FROM chunk_ c LEFT JOIN turn_ t ON t.key = c.turn_key AND md5({X.CASED_NORM_SQL.format('t.text')}) = "
    f"md5({X.CASED_NORM_SQL.format('c.cite_text')}) WHERE c.cite_text IS NOT NULL"))
def paragraph_match(spark: SparkSession, d: str) -> DataFrame:
    """Whether a stored text is its turn's whole text in normal form: two keys, compared by hash."""
    t = Tables(spark, d)
    stored = t.turn.where("text IS NOT NULL").select(F.col("key").alias("turn_key"), F.md5(X.cased_norm("text")).alias("h"), F.lit(True).alias("hit"))
    c = t.chunk.where("cite_text IS NOT NULL").select("id", "turn_key", F.md5(X.cased_norm("cite_text")).alias("h"))
    return c.join(stored, ["turn_key", "h"], "left").select("id", F.col("hit").isNotNull().alias("matched"))


@R.query(
    "pull_divergence",
    """WITH s AS (SELECT DISTINCT snapshot_no, trim(lower(report_id)) AS r FROM report_snapshot WHERE report_id IS NOT NULL), n AS (SELECT DISTINCT snapshot_no FROM s), f AS (SELECT r, min(snapshot_no) AS first FROM s GROUP BY 1)
SELECT n.snapshot_no, (SELECT count(*) FROM s WHERE s.snapshot_no = n.snapshot_no) AS held, (SELECT count(*) FROM s a WHERE a.snapshot_no = n.snapshot_no AND NOT EXISTS (SELECT 1 FROM s b WHERE b.snapshot_no = n.snapshot_no - 1 AND b.r = a.r)) AS only_here,
(SELECT count(*) FROM s a WHERE a.snapshot_no = n.snapshot_no - 1 AND NOT EXISTS (SELECT 1 FROM s b WHERE b.snapshot_no = n.snapshot_no AND b.r = a.r)) AS only_before, (SELECT count(*) FROM f WHERE first <= n.snapshot_no) AS ever FROM n""",
)
def pull_divergence(spark: SparkSession, d: str) -> DataFrame:
    """What two pulls of the same thing don't share, and how many records any pull so far had: the least there are."""
    s = load(spark, d, "report_snapshot").where("report_id IS NOT NULL").select("snapshot_no", F.trim(F.lower("report_id")).alias("r")).distinct()
    cells = s.select("snapshot_no", "r", F.lit(1).alias("here"), F.lit(0).alias("before")).unionByName(s.select((F.col("snapshot_no") + 1).alias("snapshot_no"), "r", F.lit(0).alias("here"), F.lit(1).alias("before")))
    both = cells.groupBy("snapshot_no", "r").agg(F.max("here").alias("here"), F.max("before").alias("before"))
    g = both.groupBy("snapshot_no").agg(F.sum("here").alias("held"), F.count_if((F.col("here") == 1) & (F.col("before") == 0)).alias("only_here"), F.count_if((F.col("here") == 0) & (F.col("before") == 1)).alias("only_before")).where("held > 0")
    new = s.groupBy("r").agg(F.min("snapshot_no").alias("snapshot_no")).groupBy("snapshot_no").agg(F.count("*").alias("new"))
    ever = F.coalesce(F.sum("new").over(Window.orderBy("snapshot_no")), F.lit(0))  # one row a pull
    return g.join(new, "snapshot_no", "left").select("snapshot_no", "held", "only_here", "only_before", ever.alias("ever"))


@R.query("page_paragraphs")
def page_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Pages read again with their paragraphs kept, a blank line between them."""
    from lectern.plans.texts import pages
    from lectern.sources.html import page_turns

    t = page_turns(pages(Tables(spark, d)), "key", "html", between="\n\n")
    return t.select("key", "i", "speaker", F.size(F.split("body", "\n\n")).alias("paragraphs"), F.md5("body").alias("body_md5"))


@R.query(
    "one_per_turn",
    current_sql(
        "SELECT c.id, count(t.key) AS turns, count(t.key) = 1 AS only_one FROM chunk_ c LEFT JOIN (SELECT DISTINCT report_id, key, md5(text) AS h FROM turn_ "
        "WHERE text IS NOT NULL) t ON t.report_id = c.report_id AND t.h = md5(c.cite_text) WHERE c.n_parts = 1 AND c.cite_text IS NOT NULL GROUP BY 1"),
)
def one_per_turn(spark: SparkSession, d: str) -> DataFrame:
    """In how many turns of its report a chunk that is a whole turn stands, and whether it names one alone."""
    t = Tables(spark, d)
    held = t.turn.where("text IS NOT NULL").select("report_id", "key", F.md5("text").alias("h")).distinct()
    c = t.chunk.where("n_parts = 1 AND cite_text IS NOT NULL").select("id", "report_id", F.md5("cite_text").alias("h"))
    n = c.join(held, ["report_id", "h"], "left").groupBy("id").agg(F.count("key").alias("turns"))
    return n.select("id", "turns", (F.col("turns") == 1).alias("only_one"))


# Words with which a sentence points back; characters of a chunk of which sentences are picked.
POINTS_BACK = r"(?i)^\s*(This|That|These|Those|It|They|He|She|We|I|There|Such|However|Therefore|Thus|Hence|So|And|But|Also|Then|Now|Certainly)\b"
CHUNK_CHARS = 24000


@R.query(
    "selection_pipeline",
    current_sql(
        f""", u AS (SELECT report_id, key, turn, speaker, text, length(text) + length(coalesce(speaker, '')) + 8 AS n, row_number() OVER (PARTITION BY report_id ORDER BY turn, key) AS rn FROM turn_ WHERE text IS NOT NULL),
b AS (WITH RECURSIVE r AS (SELECT report_id, key, rn, 0 AS bin, n AS used FROM u WHERE rn = 1 UNION ALL SELECT u.report_id, u.key, u.rn, CASE WHEN r.used > 0 AND r.used + u.n > {CHUNK_CHARS} THEN r.bin + 1 ELSE r.bin END,
CASE WHEN r.used > 0 AND r.used + u.n > {CHUNK_CHARS} THEN u.n ELSE r.used + u.n END FROM r JOIN u ON u.report_id = r.report_id AND u.rn = r.rn + 1) SELECT key, bin FROM r),
se AS (SELECT report_id, key, turn, speaker, unnest(x) AS s, generate_subscripts(x, 1) - 1 AS i FROM (SELECT *, {X.SENTENCES_SQL.format('text')} AS x FROM u)),
k AS (SELECT report_id, key, turn, i, s, bin, row_number() OVER (PARTITION BY report_id ORDER BY turn, key, i) AS place, count(*) OVER (PARTITION BY report_id) AS n, {SCREEN_SQL} IS NULL AND {salience_sql('0.0')} > 4 AS wanted FROM se JOIN b USING (key)),
c AS (SELECT report_id, place, n, bin, row_number() OVER (PARTITION BY report_id, bin ORDER BY place) AS rn FROM k WHERE wanted),
d AS (SELECT report_id, place FROM (SELECT report_id, place, n, row_number() OVER (PARTITION BY report_id ORDER BY rn, bin) AS pos FROM c) WHERE pos <= least(greatest(8, round(0.14 * n - 0.000001)), greatest(1, round(0.6 * n - 0.000001)))),
m AS (SELECT k.*, d.place IS NOT NULL AS kept FROM k LEFT JOIN d ON d.report_id = k.report_id AND d.place = k.place),
e AS (SELECT *, lead(kept) OVER w AND lead({_hit('s', POINTS_BACK)}) OVER w AS needed FROM m WINDOW w AS (PARTITION BY report_id ORDER BY place))
SELECT report_id, key, CAST(i AS INTEGER) AS i, NOT kept AS repaired FROM e WHERE kept OR coalesce(needed, false)"""
    ),
)
def selection_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """What is kept of a report: its telling sentences, chunk by chunk in turn and in the order of the text, up to the target
    that follows from the number of its sentences; then, beyond that, the sentence before each that points back."""
    turns = Tables(spark, d).turn.where("text IS NOT NULL").select("report_id", "key", "turn", "speaker", "text")
    bins = packed(turns.withColumn("n", F.length("text") + F.length(F.coalesce("speaker", F.lit(""))) + 8), "report_id", ["turn", "key"], "n", CHUNK_CHARS)
    s = turns.select("report_id", "key", "turn", "speaker", F.posexplode(X.sentences("text")).alias("i", "s"))
    wanted = G.screen("s", "speaker").isNull() & (G.salience("s") > 4)
    s = s.select("report_id", "key", "turn", "i", wanted.alias("wanted"), F.col("s").rlike(POINTS_BACK).alias("back"))
    # sentences by one number, turns in blocks of 64
    s = s.withColumn("at", F.shiftleft(F.col("turn").cast("long"), 20) + F.col("i")).join(bins.select("key", "bin"), "key")
    s = checkpointed(s)
    n = s.groupBy("report_id").agg(F.count("*").alias("n"))
    part = lambda p: F.round(F.lit(p) * F.col("n") - 0.000001)
    target = n.select("report_id", F.least(F.greatest(F.lit(8.0), part(0.14)), F.greatest(F.lit(1.0), part(0.6))).alias("target"))
    # in turn: all first ones of the chunks, then all second ones; how many are before a level is a small table
    c = s.where("wanted").withColumn("rn", F.row_number().over(Window.partitionBy("report_id", "bin").orderBy("at")))
    levels = c.groupBy("report_id", "rn").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("report_id").orderBy("rn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    levels = levels.select("report_id", "rn", before.alias("before"))
    c = c.join(levels, ["report_id", "rn"]).withColumn("pos", F.col("before") + F.row_number().over(Window.partitionBy("report_id", "rn").orderBy("bin")))
    kept = c.join(target, "report_id").where("pos <= target").select("report_id", "at", F.lit(True).alias("kept"))
    m = s.join(kept, ["report_id", "at"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    m = neighbours(m, "report_id", "at", ["kept", "back"], before=False, block=1 << 26)
    needed = F.coalesce(F.col("__kept") & F.col("__back"), F.lit(False))
    return m.where(F.col("kept") | needed).select("report_id", "key", "i", (~F.col("kept")).alias("repaired"))
