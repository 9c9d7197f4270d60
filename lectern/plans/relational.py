"""Scans, filters, joins and set operations over the domain's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.operators.current import Tables, current_sql, first_wins, latest
from lectern.plans.registry import Registry
from lectern.sources import load

R = Registry()


@R.query("scan_partitioned", "SELECT key, report_id, year, words FROM turn WHERE year IN (2014, 2018, 2022)")
def scan_partitioned(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "turn").where(F.col("year").isin(2014, 2018, 2022)).select("key", "report_id", "year", "words")


@R.query(
    "union_sweeps_dedup",
    current_sql("""
, sweeps AS (
  SELECT report_id, title, 0 AS sweep FROM report_ WHERE group_name IN ('oral', 'bill', 'budget')
  UNION ALL SELECT report_id, title, 1 FROM report_ WHERE n_turns > 5
  UNION ALL SELECT report_id, title, 2 FROM report_ WHERE year >= 2018
), kept AS (SELECT * FROM sweeps QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY sweep) = 1)
SELECT k.report_id, k.title, k.sweep, round(count(*) OVER () * 1.0 / (SELECT count(*) FROM report_), 4) AS coverage FROM kept k"""),
)
def union_sweeps_dedup(spark: SparkSession, d: str) -> DataFrame:
    r = Tables(spark, d).report
    sweep = lambda c, n: r.where(c).select("report_id", "title", F.lit(n).alias("sweep"))
    all_ = sweep(F.col("group_name").isin("oral", "bill", "budget"), 0).unionByName(sweep("n_turns > 5", 1)).unionByName(sweep("year >= 2018", 2))
    kept = first_wins(all_, ["report_id"], ["sweep"])
    ratio = kept.agg(F.count("*")).scalar() / r.agg(F.count("*")).scalar()
    return kept.withColumn("coverage", F.round(ratio, 4))


@R.query(
    "calendar_weekdays",
    current_sql("""
, day AS (SELECT CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT min(try_cast(date AS DATE)) AS a, max(try_cast(date AS DATE)) AS z FROM report_))
SELECT strftime(day, '%Y-%m-%d') AS day, n AS n_reports, n IS NULL AS unknown
FROM day LEFT JOIN (SELECT date, count(*) AS n FROM report_ GROUP BY 1) r ON r.date = strftime(day, '%Y-%m-%d')
WHERE dayofweek(day) BETWEEN 1 AND 5"""),
)
def calendar_weekdays(spark: SparkSession, d: str) -> DataFrame:
    """Every weekday from the first sitting to the last; a day that nothing is known of isn't one without a sitting."""
    r = Tables(spark, d).report
    span = r.agg(F.min(F.try_to_date("date")).alias("a"), F.max(F.try_to_date("date")).alias("z"))
    days = span.select(F.explode(F.sequence("a", "z")).alias("day")).where(F.weekday("day") < 5)
    counts = r.groupBy("date").agg(F.count("*").alias("n_reports"))
    out = days.select(F.date_format("day", "yyyy-MM-dd").alias("day")).join(counts, F.col("day") == F.col("date"), "left")
    return out.select("day", "n_reports", F.col("n_reports").isNull().alias("unknown"))


@R.query(
    "json_list_or_object",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 2 = 0 "
    "UNION ALL SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) FROM events WHERE event_id % 2 = 1",
)
def json_list_or_object(spark: SparkSession, d: str) -> DataFrame:
    """Payloads that are a list of rows, or an object with the rows under "0", "1" and so on."""
    e = load(spark, d, "events")
    payload = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("["), "props", F.lit("]"))).otherwise(F.concat(F.lit('{"0":'), "props", F.lit("}")))
    as_list = F.from_json("payload", "array<struct<k:bigint>>")
    as_map = F.map_values(F.from_json("payload", "map<string,struct<k:bigint>>"))
    e = e.withColumn("payload", payload).withColumn("rows", F.when(F.col("payload").startswith("["), as_list).otherwise(as_map))
    return e.select("event_id", F.explode("rows").alias("row")).select("event_id", "row.k")


@R.query("upsert_latest", current_sql("SELECT key, loaded_at, md5(text) AS text_md5 FROM turn_"))
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    return latest(load(spark, d, "turn").select("key", "loaded_at", F.md5("text").alias("text_md5")), "key")


@R.query("insert_or_ignore", "SELECT report_id, min(loaded_at) AS loaded_at FROM report GROUP BY 1")
def insert_or_ignore(spark: SparkSession, d: str) -> DataFrame:
    return first_wins(load(spark, d, "report").select("report_id", "loaded_at"), ["report_id"], [F.col("loaded_at").asc()])


@R.query(
    "two_way_except",
    """SELECT report_id, 'only_report' AS side FROM (SELECT report_id FROM report EXCEPT SELECT report_id FROM documents)
UNION ALL SELECT report_id, 'only_documents' FROM (SELECT report_id FROM documents WHERE report_id IS NOT NULL EXCEPT SELECT report_id FROM report)""",
)
def two_way_except(spark: SparkSession, d: str) -> DataFrame:
    a, b = load(spark, d, "report").select("report_id"), load(spark, d, "documents").select("report_id").where("report_id IS NOT NULL")
    return a.subtract(b).withColumn("side", F.lit("only_report")).unionByName(b.subtract(a).withColumn("side", F.lit("only_documents")))


@R.query(
    "route_status",
    current_sql("SELECT item_id, CASE WHEN n_sentences IS NULL THEN 'stale' WHEN selection_share >= 0.15 AND n_sections > 0 THEN 'publish' ELSE 'withheld' END AS status FROM item_"),
)
def route_status(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("n_sentences").isNull(), "stale").when((F.col("selection_share") >= 0.15) & (F.col("n_sections") > 0), "publish").otherwise("withheld")
    return Tables(spark, d).item.select("item_id", status.alias("status"))


@R.query(
    "dict_encode_roundtrip",
    current_sql("""
, first_seen AS (SELECT report_id, speaker, min(turn) AS pos FROM turn_ WHERE speaker IS NOT NULL GROUP BY 1, 2),
dict AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY pos) - 1 AS idx FROM first_seen)
SELECT t.report_id, t.turn, CAST(d.idx AS INTEGER) AS idx, d.speaker AS decoded FROM turn_ t LEFT JOIN dict d ON d.report_id = t.report_id AND d.speaker = t.speaker"""),
)
def dict_encode_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Turns as arrays with a dictionary of speakers, encoded by report and read back."""
    t = Tables(spark, d).turn.select("report_id", "turn", "speaker")
    seen = t.where("speaker IS NOT NULL").groupBy("report_id", "speaker").agg(F.min("turn").alias("pos"))
    names = seen.groupBy("report_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "speaker"))), lambda x: x["speaker"]).alias("speakers"))
    rows = t.groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct("turn", "speaker"))).alias("x"))
    coded = rows.join(names, "report_id", "left").select(
        "report_id", "speakers", F.transform("x", lambda r: r["turn"]).alias("turns"), F.transform("x", lambda r: (F.array_position("speakers", r["speaker"]) - 1).cast("int")).alias("ids")
    )
    back = coded.select("report_id", "speakers", F.inline(F.arrays_zip("turns", "ids")))
    return back.select("report_id", F.col("turns").alias("turn"), F.col("ids").alias("idx"), F.get("speakers", F.col("ids")).alias("decoded"))


# filters


@R.query("filter_year_in", current_sql("SELECT id, report_id, year FROM chunk_ WHERE year IN (2015, 2020) AND group_name = 'oral'"))
def filter_year_in(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).chunk.where(F.col("year").isin(2015, 2020) & (F.col("group_name") == "oral")).select("id", "report_id", "year")


@R.query("filter_content_term", current_sql("SELECT id FROM chunk_ WHERE cite_text ILIKE '%service standard%'"))
def filter_content_term(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).chunk.where(F.col("cite_text").ilike("%service standard%")).select("id")


@R.query("filter_text_year_any", current_sql("SELECT id FROM chunk_ WHERE cite_text LIKE '%2012%' OR cite_text LIKE '%2013%' OR cite_text LIKE '%2014%'"))
def filter_text_year_any(spark: SparkSession, d: str) -> DataFrame:
    hit = F.col("cite_text").contains("2012") | F.col("cite_text").contains("2013") | F.col("cite_text").contains("2014")
    return Tables(spark, d).chunk.where(hit).select("id")


_PROBES = {"year": "year IN (2016, 2031)", "text_year": "cite_text LIKE '%2016%'", "term": "cite_text ILIKE '%waiting list%'", "absent": "cite_text ILIKE '%moon landing%'"}


@R.query("constraint_probe", current_sql("SELECT " + ", ".join(f"count(*) FILTER (WHERE {c}) AS n_{k}" for k, c in _PROBES.items()) + ", count(*) AS n_all FROM chunk_"))
def constraint_probe(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).chunk.agg(*(F.count_if(F.expr(c)).alias(f"n_{k}") for k, c in _PROBES.items()), F.count("*").alias("n_all"))


@R.query(
    "refusal_conjunction",
    current_sql("""
, n AS (SELECT count(*) FILTER (WHERE year = 2012) AS a, count(*) FILTER (WHERE cite_text ILIKE '%old quarry%') AS b, count(*) FILTER (WHERE year = 2012 AND cite_text ILIKE '%old quarry%' AND cite_text ILIKE '%ferry terminal%' AND lang = 'Tamil') AS both_ FROM chunk_)
SELECT CASE WHEN a = 0 OR b = 0 THEN 'dropped' WHEN both_ = 0 THEN 'refused_conjunction' ELSE 'answered' END AS status, a AS n_year, b AS n_term, both_ AS n_both FROM n"""),
)
def refusal_conjunction(spark: SparkSession, d: str) -> DataFrame:
    """Each constraint holds alone; if no row meets all, the answer is refused, as a status."""
    year, term = "year = 2012", "cite_text ILIKE '%old quarry%'"
    n = Tables(spark, d).chunk.agg(
        F.count_if(F.expr(year)).alias("n_year"), F.count_if(F.expr(term)).alias("n_term"), F.count_if(F.expr(f"{year} AND {term} AND cite_text ILIKE '%ferry terminal%' AND lang = 'Tamil'")).alias("n_both")
    )
    status = F.when((F.col("n_year") == 0) | (F.col("n_term") == 0), "dropped").when(F.col("n_both") == 0, "refused_conjunction").otherwise("answered")
    return n.select(status.alias("status"), "n_year", "n_term", "n_both")


_TERMS = ["caregivers", "polyclinic", "rebate", "fishermen"]


@R.query(
    "term_hits",
    current_sql("SELECT turn_key, max(" + " + ".join(f"CAST(contains(lower(cite_text), '{t}') AS INTEGER)" for t in _TERMS) + ") AS hits FROM chunk_ WHERE cite_text IS NOT NULL GROUP BY 1"),
)
def term_hits(spark: SparkSession, d: str) -> DataFrame:
    terms = F.array(*map(F.lit, _TERMS))
    hits = F.size(F.filter(terms, lambda t: F.contains(F.lower("cite_text"), t)))
    return Tables(spark, d).chunk.where("cite_text IS NOT NULL").groupBy("turn_key").agg(F.max(hits).alias("hits"))


@R.query("filter_summarisable", current_sql(
    ", w AS (SELECT report_id, CAST(sum(words) AS BIGINT) AS words FROM turn_ GROUP BY 1) SELECT r.report_id, w.words FROM report_ r JOIN w USING "
    "(report_id) WHERE r.group_name IN ('bill', 'budget', 'motion', 'statement') AND w.words >= 150"))
def filter_summarisable(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    words = t.turn.groupBy("report_id").agg(F.sum("words").alias("words")).where("words >= 150")
    return t.report.where(F.col("group_name").isin("bill", "budget", "motion", "statement")).select("report_id").join(words, "report_id")


@R.query("filter_nested_gate", current_sql("SELECT item_id, n_sections FROM item_ WHERE selection_share >= 0.15 AND sentences_selected > 0"))
def filter_nested_gate(spark: SparkSession, d: str) -> DataFrame:
    """Only records whose nested gate has passed."""
    gate = F.struct(((F.col("selection_share") >= 0.15) & (F.col("sentences_selected") > 0)).alias("passed"))
    items = Tables(spark, d).item.withColumn("_meta", F.struct(gate.alias("gate")))
    return items.where("_meta.gate.passed").select("item_id", "n_sections")


_FIELDS = ["title", "group_name", "mp_names", "volume_no"]


@R.query("missing_fields", current_sql("SELECT report_id, concat_ws(',', " + ", ".join(f"CASE WHEN {f} IS NULL OR trim({f}) = '' THEN '{f}' END" for f in _FIELDS) + ") AS missing FROM report_"))
def missing_fields(spark: SparkSession, d: str) -> DataFrame:
    present = F.array_compact(F.array(*(F.when(F.trim(f) != "", F.lit(f)) for f in _FIELDS)))
    return Tables(spark, d).report.select("report_id", F.array_join(F.array_except(F.array(*map(F.lit, _FIELDS)), present), ",").alias("missing"))


@R.query("span_slice", current_sql("SELECT key, substr(text, 11, 40) AS slice, length(text) AS n FROM turn_ WHERE length(text) >= 50"))
def span_slice(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).turn.where(F.length("text") >= 50).select("key", F.substring("text", 11, 40).alias("slice"), F.length("text").cast("long").alias("n"))


@R.query("citation_string", current_sql("SELECT key, concat_ws(' — ', speaker, title, date, time) AS citation FROM turn_"))
def citation_string(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).turn.select("key", F.concat_ws(" — ", "speaker", "title", "date", "time").alias("citation"))


@R.query("reader_url", current_sql("SELECT key, concat('/read/', date, '#', replace(key, '#', '-')) AS url FROM turn_"))
def reader_url(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).turn.select("key", F.concat(F.lit("/read/"), "date", F.lit("#"), F.replace("key", F.lit("#"), F.lit("-"))).alias("url"))


# joins


@R.query(
    "orphans_anti_join",
    """SELECT 'chunk_turn' AS edge, id AS child FROM chunk c WHERE NOT EXISTS (SELECT 1 FROM turn t WHERE t.key = c.turn_key)
UNION ALL SELECT 'chunk_report', id FROM chunk c WHERE NOT EXISTS (SELECT 1 FROM report r WHERE r.report_id = c.report_id)
UNION ALL SELECT 'turn_report', key FROM turn t WHERE NOT EXISTS (SELECT 1 FROM report r WHERE r.report_id = t.report_id)""",
)
def orphans_anti_join(spark: SparkSession, d: str) -> DataFrame:
    chunk, turn, report = (load(spark, d, n) for n in ("chunk", "turn", "report"))
    edge = lambda name, child, key, a, b: child.join(a, b, "left_anti").select(F.lit(name).alias("edge"), F.col(key).alias("child"))
    a = edge("chunk_turn", chunk, "id", turn.select(F.col("key").alias("turn_key")), "turn_key")
    b = edge("chunk_report", chunk, "id", report.select("report_id"), "report_id")
    return a.unionByName(b).unionByName(edge("turn_report", turn, "key", report.select("report_id"), "report_id"))


@R.query(
    "sitting_index",
    current_sql("""
, words AS (SELECT date, CAST(sum(words) AS BIGINT) AS words, count(*) AS turns FROM turn_ GROUP BY 1),
items AS (SELECT r.date, count(DISTINCT l.item_id) AS items FROM link_ l JOIN report_ r ON r.report_id = l.report_id GROUP BY 1),
sittings AS (SELECT date, count(*) AS reports FROM report_ GROUP BY 1)
SELECT s.date, s.reports, w.words, w.turns, coalesce(i.items, 0) AS items FROM sittings s LEFT JOIN words w ON w.date = s.date LEFT JOIN items i ON i.date = s.date"""),
)
def sitting_index(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    words = t.turn.groupBy("date").agg(F.sum("words").alias("words"), F.count("*").alias("turns"))
    items = t.link.join(t.report.select("report_id", "date"), "report_id").groupBy("date").agg(F.countDistinct("item_id").alias("items"))
    sittings = t.report.groupBy("date").agg(F.count("*").alias("reports"))
    return sittings.join(words, "date", "left").join(items, "date", "left").select("date", "reports", "words", "turns", F.coalesce("items", F.lit(0)).alias("items"))


@R.query(
    "section_sentences",
    current_sql("SELECT c.id, t.turn, r.title AS report_title, r.sitting_date FROM chunk_ c LEFT JOIN turn_ t ON t.key = c.turn_key LEFT JOIN report_ r ON r.report_id = t.report_id"),
)
def section_sentences(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    turns = t.turn.select(F.col("key").alias("turn_key"), "turn", "report_id")
    reports = t.report.select("report_id", F.col("title").alias("report_title"), "sitting_date")
    return t.chunk.select("id", "turn_key").join(turns, "turn_key", "left").join(reports, "report_id", "left").select("id", "turn", "report_title", "sitting_date")


_DAY = "(SELECT max(date) FROM turn WHERE report_id = 'budget-1001')"


@R.query(
    "union_turn_set",
    current_sql(f"""
, of_items AS (SELECT DISTINCT l2.report_id FROM link_ l1 JOIN report_ r ON r.report_id = l1.report_id AND r.date = {_DAY} JOIN link_ l2 ON l2.item_id = l1.item_id)
SELECT key, date, report_id, turn FROM turn_ WHERE date = {_DAY} OR report_id IN (SELECT report_id FROM of_items)"""),
)
def union_turn_set(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    day = F.broadcast(t.raw("turn").where("report_id = 'budget-1001'").agg(F.max("date").alias("date")))  # one row
    cols = ["key", "date", "report_id", "turn"]
    items = t.link.join(t.report.join(day, "date").select("report_id"), "report_id").select("item_id").distinct()
    reports = t.link.join(items, "item_id", "left_semi").select("report_id").distinct()
    return t.turn.join(day, "date", "left_semi").select(cols).union(t.turn.join(reports, "report_id", "left_semi").select(cols)).distinct()


@R.query(
    "marks_for_date",
    current_sql("SELECT c.id, c.part, l.item_id, i.tier, r.date FROM chunk_ c JOIN link_ l ON l.report_id = c.report_id JOIN item_ i ON i.item_id = l.item_id JOIN report_ r ON r.report_id = l.report_id"),
)
def marks_for_date(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    dims = t.link.join(t.item.select("item_id", "tier"), "item_id").join(t.report.select("report_id", "date"), "report_id").select("report_id", "item_id", "tier", "date")
    return t.chunk.select("id", "part", "report_id").join(dims, "report_id").select("id", "part", "item_id", "tier", "date")


@R.query(
    "citation_chain",
    current_sql("""SELECT p.announce_turn, a.speaker AS announcer, s.key AS corrected, c.id AS chunk_id, r.title, r.date, l.item_id
FROM pair_ p JOIN turn_ a ON a.key = p.announce_turn JOIN turn_ s ON s.key = p.supersede_turn JOIN chunk_ c ON c.turn_key = s.key
JOIN report_ r ON r.report_id = s.report_id LEFT JOIN link_ l ON l.report_id = r.report_id"""),
)
def citation_chain(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    a = t.turn.select(F.col("key").alias("announce_turn"), F.col("speaker").alias("announcer"))
    s = t.turn.select(F.col("key").alias("supersede_turn"), "report_id")
    c = t.chunk.select(F.col("turn_key").alias("supersede_turn"), F.col("id").alias("chunk_id"))
    out = t.pair.select("announce_turn", "supersede_turn").join(a, "announce_turn").join(s, "supersede_turn").join(c, "supersede_turn")
    out = out.join(t.report.select("report_id", "title", "date"), "report_id").join(t.link.select("report_id", "item_id"), "report_id", "left")
    return out.select("announce_turn", "announcer", F.col("supersede_turn").alias("corrected"), "chunk_id", "title", "date", "item_id")


#: Citations of a point at most.
CITES = 6


@R.query(
    "resolve_citations",
    current_sql(f""", c AS (SELECT DISTINCT l.item_id, c.report_id, c.speaker, c.turn_key FROM link_ l JOIN chunk_ c ON c.report_id = l.report_id WHERE c.turn_key IS NOT NULL),
k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY item_id, report_id, speaker ORDER BY turn_key) <= {CITES}),
p AS (SELECT k.item_id, k.report_id, k.speaker, count(*) AS cites, count(t.key) AS found, md5(string_agg(k.turn_key, ',' ORDER BY k.turn_key)) AS evidence FROM k LEFT JOIN turn_ t ON t.key = k.turn_key GROUP BY 1, 2, 3)
SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY item_id, evidence ORDER BY report_id, speaker NULLS FIRST) = 1"""),
)
def resolve_citations(spark: SparkSession, d: str) -> DataFrame:
    """What a speaker says in an item's report as a point with at most six citations, in order, and how many of them are
    turns; of points with the same evidence one."""
    t = Tables(spark, d)
    c = t.link.select("item_id", "report_id").join(t.chunk.where("turn_key IS NOT NULL").select("report_id", "speaker", "turn_key"), "report_id").distinct()
    rank = F.row_number().over(Window.partitionBy("item_id", "report_id", "speaker").orderBy("turn_key"))
    c = c.withColumn("rn", rank).where(F.col("rn") <= CITES).join(t.turn.select(F.col("key").alias("turn_key"), F.lit(1).alias("hit")), "turn_key", "left")
    p = c.groupBy("item_id", "report_id", "speaker").agg(F.count("*").alias("cites"), F.count("hit").alias("found"), F.md5(F.array_join(F.array_sort(F.collect_list("turn_key")), ",")).alias("evidence"))
    first = F.row_number().over(Window.partitionBy("item_id", "evidence").orderBy("report_id", F.asc_nulls_first("speaker")))
    return p.withColumn("rn", first).where("rn = 1").drop("rn")


@R.query(
    "align_pos_vs_content",
    current_sql("""SELECT t.key, p.key IS NOT NULL AS by_position, coalesce(h.n, 0) AS by_content
FROM turn_ t LEFT JOIN (SELECT DISTINCT turn_key AS key, cite_text FROM chunk_ WHERE n_parts = 1) p ON p.key = t.key AND p.cite_text = t.text
LEFT JOIN (SELECT report_id, substr(cite_text, 1, 100) AS head, count(*) AS n FROM chunk_ WHERE n_parts = 1 GROUP BY 1, 2) h ON h.report_id = t.report_id AND h.head = substr(t.text, 1, 100)"""),
)
def align_pos_vs_content(spark: SparkSession, d: str) -> DataFrame:
    """Turns that their own chunk repeats, and in how many chunks of their report their beginning occurs."""
    t = Tables(spark, d)
    one = t.chunk.where("n_parts = 1")
    pos = one.select(F.col("turn_key").alias("key"), F.col("cite_text").alias("text"), F.lit(True).alias("hit")).distinct()
    heads = one.groupBy("report_id", F.substring("cite_text", 1, 100).alias("head")).agg(F.count("*").alias("n"))
    turns = t.turn.select("key", "report_id", "text", F.substring("text", 1, 100).alias("head"))
    out = turns.join(pos, ["key", "text"], "left").join(heads, ["report_id", "head"], "left")
    return out.select("key", F.coalesce("hit", F.lit(False)).alias("by_position"), F.coalesce("n", F.lit(0)).alias("by_content"))


@R.query(
    "reconcile_full_outer",
    current_sql(""", stored AS (SELECT report_id, n_turns AS n FROM report_ WHERE deleted_at IS NULL), fresh AS (SELECT report_id, count(*) AS n FROM turn_ WHERE deleted_at IS NULL GROUP BY 1)
SELECT coalesce(s.report_id, f.report_id) AS report_id, CASE WHEN f.report_id IS NULL AND s.n = 0 THEN 'empty_placeholder' WHEN f.report_id IS NULL THEN 'gone' WHEN s.report_id IS NULL THEN 'never_collected' WHEN s.n <> f.n THEN 'changed' ELSE 'same' END AS status
FROM stored s FULL JOIN fresh f ON s.report_id = f.report_id"""),
)
def reconcile_full_outer(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    stored = t.report.where("deleted_at IS NULL").select("report_id", F.col("n_turns").alias("s"), F.lit(True).alias("in_s"))
    fresh = t.turn.where("deleted_at IS NULL").groupBy("report_id").agg(F.count("*").alias("f"))
    status = F.when(F.col("f").isNull() & (F.col("s") == 0), "empty_placeholder").when(F.col("f").isNull(), "gone").when(F.col("in_s").isNull(), "never_collected").when(F.col("s") != F.col("f"), "changed").otherwise("same")
    return stored.join(fresh, "report_id", "full_outer").select("report_id", status.alias("status"))


@R.query(
    "intersect_ids",
    "SELECT report_id FROM report INTERSECT SELECT report_id FROM summary_item_report",
)
def intersect_ids(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "report").select("report_id").intersect(load(spark, d, "summary_item_report").select("report_id"))


@R.query(
    "partition_check",
    current_sql(""", routed AS (SELECT report_id, CASE WHEN group_name IN ('bill', 'motion') THEN 'legislation' WHEN group_name IS NULL THEN 'unknown' ELSE 'other' END AS part FROM report_)
SELECT count(*) AS n_parts_rows, count(DISTINCT report_id) AS n_distinct, (SELECT count(*) FROM report_) AS n_all, count(*) = count(DISTINCT report_id) AND count(*) = (SELECT count(*) FROM report_) AS is_partition FROM routed"""),
)
def partition_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether routed parts are disjoint and cover everything."""
    r = Tables(spark, d).report.select("report_id", "group_name")
    parts = [r.where(F.col("group_name").isin("bill", "motion")), r.where("group_name IS NULL"), r.where(~F.col("group_name").isin("bill", "motion"))]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2])
    n = union.agg(F.count("*").alias("n_parts_rows"), F.countDistinct("report_id").alias("n_distinct")).withColumn("n_all", r.agg(F.count("*")).scalar())
    return n.withColumn("is_partition", (F.col("n_parts_rows") == F.col("n_distinct")) & (F.col("n_parts_rows") == F.col("n_all")))


@R.query("partition_route", current_sql("SELECT CASE WHEN group_name IN ('bill', 'motion') THEN 'legislation' ELSE 'debates' END AS route, count(*) AS n FROM report_ GROUP BY 1"))
def partition_route(spark: SparkSession, d: str) -> DataFrame:
    route = F.when(F.col("group_name").isin("bill", "motion"), "legislation").otherwise("debates")
    return Tables(spark, d).report.groupBy(route.alias("route")).agg(F.count("*").alias("n"))


@R.query(
    "stable_key",
    current_sql(r""", ids AS (SELECT item_id, report_id, regexp_extract(report_id, '^([a-z][a-z0-9-]*)-(\d+)$', 1) AS prefix, try_cast(regexp_extract(report_id, '^([a-z][a-z0-9-]*)-(\d+)$', 2) AS BIGINT) AS n FROM (SELECT DISTINCT item_id, report_id FROM link_))
SELECT item_id, CASE WHEN count(DISTINCT prefix) = 1 AND min(prefix) <> '' AND count(n) = count(*) THEN min(prefix) || '-' || string_agg(CAST(n AS VARCHAR), '+' ORDER BY n) ELSE string_agg(report_id, '+' ORDER BY report_id) END AS stable_key FROM ids GROUP BY 1"""),
)
def stable_key(spark: SparkSession, d: str) -> DataFrame:
    """One prefix: the numbers in order; else the whole ids in order."""
    ids = Tables(spark, d).link.select("item_id", "report_id").distinct()
    shape = r"^([a-z][a-z0-9-]*)-(\d+)$"
    ids = ids.withColumn("prefix", F.regexp_extract("report_id", shape, 1)).withColumn("n", F.expr(rf"try_cast(regexp_extract(report_id, '^([a-z][a-z0-9-]*)-(\\d+)$', 2) AS BIGINT)"))
    a = ids.groupBy("item_id").agg(F.countDistinct("prefix").alias("k"), F.min("prefix").alias("p"), F.count("n").alias("with_n"), F.count("*").alias("all"), F.array_sort(F.collect_list("n")).alias("ns"), F.array_sort(F.collect_list("report_id")).alias("rs"))
    one = (F.col("k") == 1) & (F.col("p") != "") & (F.col("with_n") == F.col("all"))
    return a.select("item_id", F.when(one, F.concat("p", F.lit("-"), F.array_join(F.col("ns").cast("array<string>"), "+"))).otherwise(F.array_join("rs", "+")).alias("stable_key"))
