"""Aggregations, windows and rankings over the domain's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.ids import content_hash
from lectern.operators.current import Tables, current_sql, first_wins
from lectern.operators.sequences import block_numbered, carried_forward, islands, neighbours, numbered, ranked_by_range, running_total
from lectern.plans.registry import Registry
from lectern.sources import load

R = Registry()


@R.query(
    "rollup_sitting",
    current_sql("SELECT date, count(DISTINCT report_id) AS reports, count(*) AS turns, CAST(sum(words) AS BIGINT) AS words FROM turn_ GROUP BY 1"),
)
def rollup_sitting(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).turn.groupBy("date").agg(F.countDistinct("report_id").alias("reports"), F.count("*").alias("turns"), F.sum("words").alias("words"))


@R.query(
    "rollup_report",
    current_sql("SELECT report_id, count(DISTINCT turn_key) AS turns, count(*) AS chunks, CAST(sum(tokens) AS BIGINT) AS tokens FROM chunk_ GROUP BY 1"),
)
def rollup_report(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).chunk.groupBy("report_id").agg(F.countDistinct("turn_key").alias("turns"), F.count("*").alias("chunks"), F.sum("tokens").alias("tokens"))


@R.query("words_by_group", current_sql("SELECT group_name, count(*) AS n, CAST(sum(words) AS BIGINT) AS words FROM turn_ GROUP BY 1"))
def words_by_group(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).turn.groupBy("group_name").agg(F.count("*").alias("n"), F.sum("words").alias("words"))


@R.query(
    "coverage_stats",
    current_sql("""SELECT report_id, count(*) AS turns, count(speaker) AS attributed,
round(count(speaker) FILTER (WHERE NOT coalesce(is_procedural, false)) * 1.0 / nullif(count(*) FILTER (WHERE NOT coalesce(is_procedural, false)), 0), 3) AS attribution,
coalesce(count(speaker) * 1.0 / count(*) < 0.95, false) AS low FROM turn_ GROUP BY 1"""),
)
def coverage_stats(spark: SparkSession, d: str) -> DataFrame:
    said = ~F.coalesce("is_procedural", F.lit(False))
    rate = F.round(F.try_divide(F.count(F.when(said, F.col("speaker"))), F.count_if(said)), 3)
    return Tables(spark, d).turn.groupBy("report_id").agg(F.count("*").alias("turns"), F.count("speaker").alias("attributed"), rate.alias("attribution"), (F.count("speaker") / F.count("*") < 0.95).alias("low"))


@R.query("dup_keys_having", "SELECT report_id, turn, content_hash, count(*) AS n FROM turn GROUP BY 1, 2, 3 HAVING count(*) > 1")
def dup_keys_having(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "turn").groupBy("report_id", "turn", "content_hash").agg(F.count("*").alias("n")).where("n > 1")


@R.query("uniqueness_check", "SELECT count(*) AS n, count(DISTINCT key) AS n_keys, count(*) = count(DISTINCT key) AS is_unique FROM turn")
def uniqueness_check(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "turn").agg(F.count("*").alias("n"), F.countDistinct("key").alias("n_keys"), (F.count("*") == F.countDistinct("key")).alias("is_unique"))


@R.query(
    "anchor_coverage",
    current_sql(
        "SELECT c.group_name, count(*) AS n, count(*) FILTER (WHERE contains(t.text, c.cite_text)) AS exact, count(*) FILTER (WHERE t.key IS NULL) AS "
        "unresolved FROM chunk_ c LEFT JOIN turn_ t ON t.key = c.turn_key GROUP BY 1"),
)
def anchor_coverage(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    j = t.chunk.select("group_name", "turn_key", "cite_text").join(t.turn.select(F.col("key").alias("turn_key"), "text", F.lit(True).alias("hit")), "turn_key", "left")
    return j.groupBy("group_name").agg(F.count("*").alias("n"), F.count_if(F.contains("text", "cite_text")).alias("exact"), F.count_if(F.col("hit").isNull()).alias("unresolved"))


@R.query(
    "counter_mismatch",
    current_sql("SELECT r.report_id, r.n_turns AS stored, count(t.key) AS counted FROM report_ r LEFT JOIN turn_ t ON t.report_id = r.report_id GROUP BY 1, 2 HAVING r.n_turns <> count(t.key)"),
)
def counter_mismatch(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    n = t.turn.groupBy("report_id").agg(F.count("*").alias("c"))
    out = t.report.select("report_id", F.col("n_turns").alias("stored")).join(n, "report_id", "left").withColumn("counted", F.coalesce("c", F.lit(0)))
    return out.where("stored <> counted").select("report_id", "stored", "counted")


@R.query("term_year_histogram", current_sql("SELECT year, count(*) AS n FROM report_ WHERE title ILIKE '%waiting list%' GROUP BY 1"))
def term_year_histogram(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).report.where(F.col("title").ilike("%waiting list%")).groupBy("year").agg(F.count("*").alias("n"))


@R.query(
    "sitting_name_argmax",
    current_sql(""", w AS (SELECT date, title, coalesce(group_name IN ('written', 'other'), false) AS minor, sum(words) AS words FROM turn_ WHERE title IS NOT NULL GROUP BY 1, 2, 3)
SELECT date, title AS name FROM w QUALIFY row_number() OVER (PARTITION BY date ORDER BY minor, words DESC, title DESC) = 1"""),
)
def sitting_name_argmax(spark: SparkSession, d: str) -> DataFrame:
    """The title with most words; written and other reports only where there is nothing else."""
    minor = F.coalesce(F.col("group_name").isin("written", "other"), F.lit(False))
    w = Tables(spark, d).turn.where("title IS NOT NULL").groupBy("date", "title", minor.alias("minor")).agg(F.sum("words").alias("words"))
    return w.groupBy("date").agg(F.max(F.struct((~F.col("minor")).alias("major"), "words", "title"))["title"].alias("name"))


@R.query(
    "speaker_airtime_topk",
    current_sql(r""", s AS (SELECT trim(regexp_replace(speaker, '\s*\([^()]*\)', '', 'g')) AS who, words, report_id FROM turn_ WHERE speaker IS NOT NULL AND NOT coalesce(is_procedural, false) AND NOT regexp_matches(lower(speaker), '(speaker|chairman)'))
SELECT who, CAST(sum(words) AS BIGINT) AS words, min(report_id) AS first_report FROM s GROUP BY 1 ORDER BY words DESC, who LIMIT 12"""),
)
def speaker_airtime_topk(spark: SparkSession, d: str) -> DataFrame:
    who = F.trim(F.regexp_replace("speaker", r"\s*\([^()]*\)", ""))
    t = Tables(spark, d).turn.where(F.col("speaker").isNotNull() & ~F.coalesce("is_procedural", F.lit(False)) & ~F.lower("speaker").rlike("(speaker|chairman)"))
    return t.groupBy(who.alias("who")).agg(F.sum("words").alias("words"), F.min("report_id").alias("first_report")).orderBy(F.desc("words"), "who").limit(12)


@R.query(
    "chunk_size_profile",
    current_sql(""", s AS (SELECT group_name, list_sort(list(tokens)) AS x FROM chunk_ WHERE tokens IS NOT NULL GROUP BY 1)
SELECT group_name, len(x) AS n, x[1] AS least, x[CAST(floor(len(x) * 0.5) AS INTEGER) + 1] AS p50, x[CAST(floor(len(x) * 0.9) AS INTEGER) + 1] AS p90, x[len(x)] AS most FROM s"""),
)
def chunk_size_profile(spark: SparkSession, d: str) -> DataFrame:
    """Values at index int(n * p) of the sorted sizes. Sizes are counted first, so a group is as large as its distinct sizes."""
    c = Tables(spark, d).chunk.where("tokens IS NOT NULL").groupBy("group_name", "tokens").agg(F.count("*").alias("k"))
    w = Window.partitionBy("group_name").orderBy("tokens")
    n = F.sum("k").over(Window.partitionBy("group_name"))
    c = c.withColumn("upto", F.sum("k").over(w)).withColumn("n", n)
    at = lambda p: F.min(F.when(F.col("upto") > F.floor(F.col("n") * p), F.col("tokens")))
    return c.groupBy("group_name", "n").agg(F.min("tokens").alias("least"), at(0.5).alias("p50"), at(0.9).alias("p90"), F.max("tokens").alias("most"))


@R.query("coverage_median", current_sql("SELECT tier, count(*) AS n, median(selection_share) AS med, min(selection_share) AS least, max(selection_share) AS most FROM item_ GROUP BY 1"))
def coverage_median(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).item.groupBy("tier").agg(F.count("*").alias("n"), F.median("selection_share").alias("med"), F.min("selection_share").alias("least"), F.max("selection_share").alias("most"))


_PRICES = [("click", 2), ("view", 1), ("purchase", 30), ("signup", 8)]
_PRICE_SQL = "price AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v})" for k, v in _PRICES) + ") p(event_type, unit))"


@R.query(
    "usage_by_model",
        f"WITH {_PRICE_SQL} SELECT e.event_type, count(*) AS calls, CAST(sum(length(e.props) // 4) AS BIGINT) AS tokens, count(*) * coalesce(p.unit, 5) AS cost, "
        f"bool_or(p.unit IS NULL) AS estimated FROM events e LEFT JOIN price p USING (event_type) GROUP BY e.event_type, p.unit",
)
def usage_by_model(spark: SparkSession, d: str) -> DataFrame:
    """Calls, estimated tokens and cost by kind; a kind without price is charged a default and marked."""
    price = F.broadcast(spark.createDataFrame(_PRICES, "event_type string, unit int"))
    e = load(spark, d, "events").join(price, "event_type", "left")
    return e.groupBy("event_type", "unit").agg(F.count("*").alias("calls"), F.sum(F.floor(F.length("props") / 4)).alias("tokens"), F.bool_or(F.col("unit").isNull()).alias("estimated")).select(
        "event_type", "calls", "tokens", (F.col("calls") * F.coalesce("unit", F.lit(5))).alias("cost"), "estimated"
    )


@R.query(
    "cost_projection",
    current_sql(
        ", y AS (SELECT year, count(*) AS items, CAST(sum(sentences_selected) AS BIGINT) AS picked FROM item_ GROUP BY 1) SELECT year, items, round(picked * "
        "1.0 / items, 4) AS per_item, round((SELECT sum(picked) * 1.0 / sum(items) FROM y) * items, 2) AS projected FROM y"),
)
def cost_projection(spark: SparkSession, d: str) -> DataFrame:
    y = Tables(spark, d).item.groupBy("year").agg(F.count("*").alias("items"), F.sum("sentences_selected").alias("picked"))
    mean = y.agg(F.sum("picked") / F.sum("items")).scalar()
    return y.select("year", "items", F.round(F.col("picked") / F.col("items"), 4).alias("per_item"), F.round(mean * F.col("items"), 2).alias("projected"))


@R.query(
    "status_by_year",
    current_sql(
        "SELECT r.year, count(*) AS total, count(*) FILTER (WHERE l.report_id IS NOT NULL) AS done, CAST(sum(r.n_turns) AS BIGINT) AS turns, CAST(sum(CASE WHEN "
        "l.report_id IS NOT NULL THEN r.n_turns ELSE 0 END) AS BIGINT) AS done_turns FROM report_ r LEFT JOIN (SELECT DISTINCT report_id FROM link_) l ON "
        "l.report_id = r.report_id GROUP BY 1"),
)
def status_by_year(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    j = t.report.select("report_id", "year", "n_turns").join(t.link.select("report_id").distinct().withColumn("hit", F.lit(True)), "report_id", "left")
    done = F.col("hit").isNotNull()
    return j.groupBy("year").agg(F.count("*").alias("total"), F.count_if(done).alias("done"), F.sum("n_turns").alias("turns"), F.sum(F.when(done, F.col("n_turns")).otherwise(0)).alias("done_turns"))


@R.query("tier_pivot", current_sql("SELECT group_name, count(*) FILTER (WHERE tier = 'small') AS small, count(*) FILTER (WHERE tier = 'heavy') AS heavy FROM item_ GROUP BY 1"))
def tier_pivot(spark: SparkSession, d: str) -> DataFrame:
    p = Tables(spark, d).item.groupBy("group_name").pivot("tier", ["small", "heavy"]).agg(F.count(F.lit(1)))
    return p.select("group_name", F.coalesce("small", F.lit(0)).alias("small"), F.coalesce("heavy", F.lit(0)).alias("heavy"))


@R.query("corpus_metrics", current_sql(
    "SELECT count(*) AS turns, count(DISTINCT report_id) AS reports, CAST(sum(words) AS BIGINT) AS words, CAST(sum(length(text)) AS BIGINT) AS chars, "
    "count(DISTINCT date) AS sittings FROM turn_"))
def corpus_metrics(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).turn.agg(F.count("*").alias("turns"), F.countDistinct("report_id").alias("reports"), F.sum("words").alias("words"), F.sum(F.length("text")).alias("chars"), F.countDistinct("date").alias("sittings"))


_W4_SQL = "list_distinct(regexp_extract_all(lower({0}), '[a-z]{{4,}}'))"


@R.query(
    "verdict_fractions",
    current_sql(f""", j AS (SELECT t.text, c.cite_text, {_W4_SQL.format('c.cite_text')} AS w, {_W4_SQL.format('t.text')} AS v FROM chunk_ c LEFT JOIN turn_ t ON t.key = c.turn_key),
v AS (SELECT CASE WHEN text IS NULL OR cite_text IS NULL THEN 'unjudged' WHEN contains(text, cite_text) THEN 'supported' WHEN len(list_intersect(w, v)) = len(w) THEN 'words_supported' WHEN len(list_intersect(w, v)) >= 0.8 * len(w) THEN 'partial' ELSE 'unsupported' END AS verdict FROM j)
SELECT verdict, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS share, CASE WHEN verdict <> 'unjudged' THEN round(count(*) * 1.0 / sum(CASE WHEN verdict <> 'unjudged' THEN count(*) END) OVER (), 6) END AS share_of_judged FROM v GROUP BY 1"""),
)
def verdict_fractions(spark: SparkSession, d: str) -> DataFrame:
    """Citations by what their turn says of them, as shares of all and of those that could be judged."""
    t = Tables(spark, d)
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z]{4,})"), F.lit(1)))
    j = t.chunk.select("turn_key", "cite_text").join(t.turn.select(F.col("key").alias("turn_key"), "text"), "turn_key", "left")
    w = words("cite_text")
    both = F.size(F.array_intersect(w, words("text")))
    unjudged = F.col("text").isNull() | F.col("cite_text").isNull()
    v = F.when(unjudged, "unjudged").when(F.contains("text", "cite_text"), "supported").when(both == F.size(w), "words_supported").when(both >= 0.8 * F.size(w), "partial").otherwise("unsupported")
    n = j.groupBy(v.alias("verdict")).agg(F.count("*").alias("n"))
    over = Window.partitionBy()  # over the verdicts, not the rows
    judged = F.col("verdict") != "unjudged"
    return n.select("verdict", "n", F.round(F.col("n") / F.sum("n").over(over), 6).alias("share"), F.when(judged, F.round(F.col("n") / F.sum(F.when(judged, F.col("n"))).over(over), 6)).alias("share_of_judged"))


_REASON = "CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN coalesce(is_procedural, false) THEN 'procedural' WHEN words < 8 THEN 'too_short' WHEN words > 600 THEN 'too_long' ELSE 'kept' END"


@R.query("excluded_by_reason", current_sql(f"SELECT {_REASON} AS reason, count(*) AS n, CAST(sum(words) AS BIGINT) AS words FROM turn_ GROUP BY 1"))
def excluded_by_reason(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).turn.groupBy(F.expr(_REASON).alias("reason")).agg(F.count("*").alias("n"), F.sum("words").alias("words"))


@R.query(
    "refresh_progress",
    current_sql(
        ", want AS (SELECT DISTINCT item_id, report_id FROM link_) SELECT w.item_id, count(*) AS wanted, count(r.report_id) AS done, count(*) = "
        "count(r.report_id) AS complete FROM want w LEFT JOIN report_ r ON r.report_id = w.report_id GROUP BY 1"),
)
def refresh_progress(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    j = t.link.select("item_id", "report_id").distinct().join(t.report.select("report_id", F.lit(1).alias("hit")), "report_id", "left")
    return j.groupBy("item_id").agg(F.count("*").alias("wanted"), F.count("hit").alias("done"), (F.count("*") == F.count("hit")).alias("complete"))


@R.query("mode_tiebreak", current_sql(
    ", c AS (SELECT report_id, speaker, count(*) AS n FROM turn_ WHERE speaker IS NOT NULL GROUP BY 1, 2) SELECT report_id, speaker, n FROM c QUALIFY "
    "row_number() OVER (PARTITION BY report_id ORDER BY n DESC, speaker) = 1"))
def mode_tiebreak(spark: SparkSession, d: str) -> DataFrame:
    c = Tables(spark, d).turn.where("speaker IS NOT NULL").groupBy("report_id", "speaker").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("m"), "speaker"))
    return c.groupBy("report_id").agg(best.alias("b")).select("report_id", "b.speaker", (-F.col("b.m")).alias("n"))


@R.query("alias_sets", current_sql(r""", a AS (SELECT DISTINCT lower(trim(regexp_replace(speaker, '\s*\([^()]*\)', '', 'g'))) AS person, speaker FROM turn_ WHERE speaker IS NOT NULL) SELECT person, count(*) AS n, string_agg(speaker, '|' ORDER BY speaker) AS aliases FROM a GROUP BY 1"""))
def alias_sets(spark: SparkSession, d: str) -> DataFrame:
    person = F.lower(F.trim(F.regexp_replace("speaker", r"\s*\([^()]*\)", "")))
    a = Tables(spark, d).turn.where("speaker IS NOT NULL").groupBy(person.alias("person")).agg(F.array_sort(F.collect_set("speaker")).alias("x"))
    return a.select("person", F.size("x").cast("long").alias("n"), F.array_join("x", "|").alias("aliases"))


_CLOCK_SQL = r"regexp_extract(time, '^(\d{{1,2}})[.:](\d{{2}})\s*([ap])\.?m', {0})"
_MINUTES_SQL = f"(CAST({_CLOCK_SQL.format(1)} AS INTEGER) % 12 + CASE WHEN {_CLOCK_SQL.format(3)} = 'p' THEN 12 ELSE 0 END) * 60 + CAST({_CLOCK_SQL.format(2)} AS INTEGER)"


def clock_minutes(c: str):
    """Minutes since midnight of a stamp like `2.03 pm`; null for others."""
    part = lambda i: F.regexp_extract(c, r"^(\d{1,2})[.:](\d{2})\s*([ap])\.?m", i)
    m = (part(1).cast("int") % 12 + F.when(part(3) == "p", 12).otherwise(0)) * 60 + part(2).cast("int")
    return F.when(part(3) != "", m)


@R.query(
    "sitting_duration",
    current_sql(f""", m AS (SELECT date, {_MINUTES_SQL} AS m FROM turn_ WHERE time IS NOT NULL AND {_CLOCK_SQL.format(3)} <> '')
SELECT date, count(*) AS stamps, min(m) AS start_min, max(m) AS end_min, CASE WHEN max(m) - min(m) BETWEEN 0 AND 960 AND count(*) > 1 THEN max(m) - min(m) END AS minutes FROM m GROUP BY 1"""),
)
def sitting_duration(spark: SparkSession, d: str) -> DataFrame:
    m = Tables(spark, d).turn.where("time IS NOT NULL").select("date", clock_minutes("time").alias("m")).where("m IS NOT NULL")
    span = F.max("m") - F.min("m")
    return m.groupBy("date").agg(F.count("*").alias("stamps"), F.min("m").alias("start_min"), F.max("m").alias("end_min"), F.when(span.between(0, 960) & (F.count("*") > 1), span).alias("minutes"))


@R.query(
    "reading_budget",
    current_sql(
        ", t AS (SELECT report_id, sum(words) AS w FROM turn_ GROUP BY 1) SELECT i.item_id, CAST(sum(t.w) AS BIGINT) AS source_words, i.sentences_selected * 20 "
        "AS kept_words, round(1 - i.sentences_selected * 20.0 / sum(t.w), 4) AS reduction FROM item_ i JOIN link_ l ON l.item_id = i.item_id JOIN t ON "
        "t.report_id = l.report_id GROUP BY i.item_id, i.sentences_selected"),
)
def reading_budget(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    words = t.turn.groupBy("report_id").agg(F.sum("words").alias("w"))
    g = t.item.select("item_id", "sentences_selected").join(t.link.select("item_id", "report_id"), "item_id").join(words, "report_id").groupBy("item_id", "sentences_selected").agg(F.sum("w").alias("source_words"))
    kept = F.col("sentences_selected") * 20
    return g.select("item_id", "source_words", kept.alias("kept_words"), F.round(1 - kept / F.col("source_words"), 4).alias("reduction"))


# sequences


@R.query(
    "turn_assembly",
    current_sql(""", p AS (SELECT report_id, turn, text, words, sum(CASE WHEN speaker IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY report_id ORDER BY turn) AS speech, speaker FROM turn_)
SELECT report_id, CAST(speech AS BIGINT) AS speech, max(speaker) AS speaker, count(*) AS paragraphs, CAST(sum(words) AS BIGINT) AS words, md5(string_agg(text, chr(10) ORDER BY turn)) AS body_md5 FROM p GROUP BY 1, 2"""),
)
def turn_assembly(spark: SparkSession, d: str) -> DataFrame:
    """A paragraph with a speaker opens a speech, others go on with it. The speeches of a report are numbered by blocks;
    a speech is put together in one task."""
    p = Tables(spark, d).turn.select("report_id", "turn", "text", "words", "speaker")
    p = running_total(p, "report_id", "turn", F.col("speaker").isNotNull().cast("int"), "speech")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
    return p.groupBy("report_id", "speech").agg(F.max("speaker").alias("speaker"), F.count("*").alias("paragraphs"), F.sum("words").alias("words"), F.md5(body).alias("body_md5"))


@R.query(
    "carry_forward",
    current_sql(
        "SELECT key, last_value(time IGNORE NULLS) OVER w AS time, last_value(speaker IGNORE NULLS) OVER w AS speaker, speaker IS NOT NULL AS attributed FROM "
        "turn_ WINDOW w AS (PARTITION BY report_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"),
)
def carry_forward(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d).turn.select("key", "report_id", "turn", "time", "speaker", F.col("speaker").isNotNull().alias("attributed"))
    return carried_forward(t, "report_id", "turn", ["time", "speaker"]).select("key", "time", "speaker", "attributed")


_TITLE_SQL = "trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'))"


@R.query(
    "cluster_gap_days",
    current_sql(f""", k AS (SELECT report_id, {_TITLE_SQL} AS k, CAST(date AS DATE) AS day, title, n_turns FROM report_ WHERE {_TITLE_SQL} <> ''),
b AS (SELECT *, CASE WHEN day - lag(day) OVER w > 120 THEN 1 ELSE 0 END AS brk FROM k WINDOW w AS (PARTITION BY k ORDER BY day, report_id)),
c AS (SELECT *, sum(brk) OVER (PARTITION BY k ORDER BY day, report_id) AS cluster FROM b)
SELECT k AS title_key, CAST(cluster AS BIGINT) AS cluster, count(*) AS reports, CAST(sum(n_turns) AS BIGINT) AS turns, strftime(min(day), '%Y-%m-%d') AS first_day, strftime(max(day), '%Y-%m-%d') AS last_day, string_agg(report_id, '+' ORDER BY day, report_id) AS ids FROM c GROUP BY 1, 2"""),
)
def cluster_gap_days(spark: SparkSession, d: str) -> DataFrame:
    key = F.trim(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", " "))
    k = Tables(spark, d).report.select("report_id", key.alias("k"), F.to_date("date").alias("day"), "n_turns").where("k <> ''")
    w = Window.partitionBy("k").orderBy("day", "report_id")
    c = islands(k, w, F.datediff("day", F.lag("day").over(w)) > 120, "cluster")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("day", "report_id"))), lambda x: x["report_id"]), "+")
    return c.groupBy(F.col("k").alias("title_key"), "cluster").agg(
        F.count("*").alias("reports"), F.sum("n_turns").alias("turns"), F.date_format(F.min("day"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max("day"), "yyyy-MM-dd").alias("last_day"), ids.alias("ids")
    )


@R.query(
    "section_gap_groups",
    current_sql(""", s AS (SELECT report_id, turn FROM turn_ WHERE words >= 120), b AS (SELECT *, CASE WHEN turn - lag(turn) OVER (PARTITION BY report_id ORDER BY turn) > 2 THEN 1 ELSE 0 END AS brk FROM s),
g AS (SELECT *, sum(brk) OVER (PARTITION BY report_id ORDER BY turn) AS section FROM b) SELECT g.report_id, CAST(g.section AS BIGINT) AS section, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n, CAST(g.section // 6 AS BIGINT) AS batch FROM g GROUP BY g.report_id, g.section"""),
)
def section_gap_groups(spark: SparkSession, d: str) -> DataFrame:
    s = Tables(spark, d).turn.where("words >= 120").select("report_id", "turn")
    w = Window.partitionBy("report_id").orderBy("turn")
    g = islands(s, w, F.col("turn") - F.lag("turn").over(w) > 2, "section")
    return g.groupBy("report_id", "section").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("n")).withColumn("batch", F.floor(F.col("section") / 6))


@R.query(
    "run_segments",
    current_sql(""", s AS (SELECT report_id, turn, coalesce(is_procedural, false) AS hidden, turn - row_number() OVER (PARTITION BY report_id, coalesce(is_procedural, false) ORDER BY turn) AS island FROM turn_)
SELECT report_id, hidden, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n FROM s GROUP BY report_id, hidden, island"""),
)
def run_segments(spark: SparkSession, d: str) -> DataFrame:
    hidden = F.coalesce("is_procedural", F.lit(False))
    s = Tables(spark, d).turn.select("report_id", "turn", hidden.alias("hidden"))
    s = running_total(s.withColumn("g", F.struct("report_id", "hidden")), "g", "turn", F.lit(1), "rn").withColumn("island", F.col("turn") - F.col("rn"))
    return s.groupBy("report_id", "hidden", "island").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("n")).drop("island")


@R.query("content_repeat_index", current_sql("SELECT key, row_number() OVER (PARTITION BY report_id, content_hash ORDER BY turn) - 1 AS repeat FROM turn_"))
def content_repeat_index(spark: SparkSession, d: str) -> DataFrame:
    return numbered(Tables(spark, d).turn, ["report_id", "content_hash"], ["turn"], "repeat").select("key", "repeat")


@R.query("content_hash", current_sql(
    r"SELECT key, substr(sha1(report_id || chr(31) || text), 1, 16) AS hash, content_hash = substr(sha1(report_id || chr(31) || text), 1, 16) AS agrees FROM "
    r"turn_ WHERE text IS NOT NULL"))
def content_hash_query(spark: SparkSession, d: str) -> DataFrame:
    h = content_hash("report_id", "text")
    return Tables(spark, d).turn.where("text IS NOT NULL").select("key", h.alias("hash"), (F.col("content_hash") == h).alias("agrees"))


@R.query("sid_numbering", current_sql("SELECT key, printf('s%05d', row_number() OVER (PARTITION BY report_id ORDER BY turn)) AS sid FROM turn_"))
def sid_numbering(spark: SparkSession, d: str) -> DataFrame:
    return block_numbered(Tables(spark, d).turn.select("key", "report_id", "turn"), "report_id", "turn", "n").select("key", F.format_string("s%05d", "n").alias("sid"))


# Words with which a sentence points back.
_DANGLING = r"(?i)^\s*(This|That|These|Those|It|They|He|She|We|I|There|Such|However|Therefore|Thus|Hence|So|And|But|Also|Then|Now|Certainly)\b"


@R.query(
    "antecedent_repair",
    current_sql(rf""", t AS (SELECT report_id, turn, words >= 150 AS picked, regexp_matches(text, '{_DANGLING}') AS dangling FROM turn_)
SELECT DISTINCT report_id, turn, repaired FROM (SELECT report_id, turn, false AS repaired FROM t WHERE picked
UNION ALL SELECT a.report_id, a.turn, true FROM t a JOIN t b ON b.report_id = a.report_id AND b.turn = a.turn + 1 WHERE b.picked AND b.dangling AND NOT a.picked)"""),
)
def antecedent_repair(spark: SparkSession, d: str) -> DataFrame:
    """A picked passage that opens with a word pointing back draws in the one before it."""
    t = Tables(spark, d).turn.select("report_id", "turn", (F.col("words") >= 150).alias("picked"), F.col("text").rlike(_DANGLING).alias("dangling"))
    t = neighbours(t.withColumn("at", F.col("turn")), "report_id", "turn", ["at", "picked", "dangling"], before=False)
    t = t.withColumn("needed", (F.col("__at") == F.col("turn") + 1) & F.col("__picked") & F.col("__dangling"))
    return t.where(F.col("picked") | F.coalesce("needed", F.lit(False))).select("report_id", "turn", (~F.col("picked")).alias("repaired"))


@R.query(
    "round_robin_cap",
    current_sql(""", r AS (SELECT year, report_id, key, row_number() OVER (PARTITION BY report_id ORDER BY words DESC, key) AS rn FROM turn_), q AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY rn, report_id) AS pos FROM r)
SELECT year, report_id, key, rn, pos FROM q WHERE pos <= 25"""),
)
def round_robin_cap(spark: SparkSession, d: str) -> DataFrame:
    # a report has at most all 25 places of its year: of more rows none is ordered
    first = F.row_number().over(Window.partitionBy("report_id").orderBy(F.desc("words"), "key"))
    r = Tables(spark, d).turn.select("year", "report_id", "key", "words").withColumn("rn", first).where("rn <= 25")
    return r.withColumn("pos", F.row_number().over(Window.partitionBy("year").orderBy("rn", "report_id"))).where("pos <= 25").select("year", "report_id", "key", "rn", "pos")


@R.query("dedup_first_wins", current_sql("SELECT report_id, content_hash, key FROM turn_ QUALIFY row_number() OVER (PARTITION BY report_id, content_hash ORDER BY turn) = 1"))
def dedup_first_wins(spark: SparkSession, d: str) -> DataFrame:
    return first_wins(Tables(spark, d).turn, ["report_id", "content_hash"], ["turn"]).select("report_id", "content_hash", "key")


@R.query(
    "promote_correction",
    current_sql(""", ranked AS (SELECT key, report_id, row_number() OVER (PARTITION BY report_id ORDER BY words DESC, key) AS rank FROM turn_),
p AS (SELECT announce_turn, min(supersede_turn) AS supersede_turn FROM pair_ WHERE supersede_turn IS NOT NULL GROUP BY 1),
j AS (SELECT r.key, r.report_id, r.rank, a.rank AS announcer_rank FROM ranked r LEFT JOIN p ON p.supersede_turn = r.key LEFT JOIN ranked a ON a.key = p.announce_turn AND a.report_id = r.report_id)
SELECT key, report_id, row_number() OVER (PARTITION BY report_id ORDER BY least(rank, coalesce(announcer_rank, rank)), CASE WHEN announcer_rank < rank THEN 0 ELSE 1 END, rank) AS place FROM j"""),
)
def promote_correction(spark: SparkSession, d: str) -> DataFrame:
    """A corrected passage that ranks below its announcement moves directly above it."""
    t = Tables(spark, d)
    ranked = ranked_by_range(t.turn.select("key", "report_id", "words"), "report_id", [F.desc("words"), F.asc("key")], "rank").drop("words")
    p = t.pair.where("supersede_turn IS NOT NULL").groupBy("announce_turn").agg(F.min("supersede_turn").alias("key"))
    a = ranked.select(F.col("key").alias("announce_turn"), F.col("report_id"), F.col("rank").alias("above"))
    moved = p.join(a, "announce_turn").select("key", "report_id", "above")
    j = ranked.join(moved, ["key", "report_id"], "left")
    j = j.withColumns({"o": F.least("rank", F.coalesce("above", "rank")), "late": F.when(F.col("above") < F.col("rank"), 0).otherwise(1)})
    return ranked_by_range(j, "report_id", [F.asc("o"), F.asc("late"), F.asc("rank")], "place").select("key", "report_id", "place")


@R.query("working_days", current_sql(
    "SELECT report_id, len(list_filter(generate_series(CAST(date AS DATE), CAST(loaded_at AS DATE), INTERVAL 1 DAY), lambda x: dayofweek(x) BETWEEN 1 AND "
    "5)) - CASE WHEN dayofweek(CAST(date AS DATE)) BETWEEN 1 AND 5 THEN 1 ELSE 0 END AS days FROM report_ WHERE loaded_at >= CAST(date AS DATE)"))
def working_days(spark: SparkSession, d: str) -> DataFrame:
    r = Tables(spark, d).report.where("loaded_at >= to_date(date)").select("report_id", F.to_date("date").alias("a"), F.to_date("loaded_at").alias("b"))
    n = F.size(F.filter(F.sequence("a", "b"), lambda x: F.weekday(x) < 5)) - (F.weekday("a") < 5).cast("int")
    return r.select("report_id", n.cast("long").alias("days"))


@R.query(
    "lead_section",
    current_sql(
        ", m AS (SELECT turn_key, part, length(cite_text) AS n FROM chunk_ WHERE cite_text IS NOT NULL) SELECT turn_key, part AS lead_part, n FROM m QUALIFY "
        "row_number() OVER (PARTITION BY turn_key ORDER BY n DESC, part) = 1"),
)
def lead_section(spark: SparkSession, d: str) -> DataFrame:
    m = Tables(spark, d).chunk.where("cite_text IS NOT NULL").select("turn_key", "part", F.length("cite_text").cast("long").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("m"), "part"))
    return m.groupBy("turn_key").agg(best.alias("b")).select("turn_key", F.col("b.part").alias("lead_part"), (-F.col("b.m")).alias("n"))
