"""Retrieval under constraints with refusal as data, context packing, and how good a ranking is."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators.current import Tables, current_sql
from lectern.operators.ranking import bm25, cosine
from lectern.plans.registry import Registry
from lectern.sources import checkpointed, load

R = Registry()

# Words of a question that say nothing of what is asked for.
ASKING = set(
    """a an the of to in on at by for with from is are was were be been being
do does did how what which who whom whose when where why many much and or but if then
than that this these those it its as into over under about between during after before
did say said have has had will would can could should may might must not no nor so such
mr mrs ms dr prof hon speaker sir madam members member parliament singapore""".split()
)
#: Subjects that are known by name.
SUBJECTS = ["take-up rate", "waiting list", "service standard", "rebate", "permit", "grant"]
#: Turns that are returned, chunks of a turn and of all that are packed.
TURNS, PER_TURN, PACKED = 30, 3, 30
#: Questions of each outcome: under years and subject, a year only in the text, a constraint that nothing meets, a premise
#: that is false, none at all, and none of the words anywhere.
QUESTIONS = [
    "How did the rebate for caregivers and polyclinic patients change between 2015 and 2017?",
    "What was said about the permit in 2041 and who was waiting?",
    "Was the grant for fishermen discussed in 1905?",
    "What did the take-up rate of 2013 and 2041 do to the service standard of kilns?",
    "Why do caregivers wait for the polyclinic?",
    "Did zebras outrun quasars?",
]


class Constraints:
    """What a question asks for: years, ranges written out; a known subject; query tokens; distinctive words."""

    def __init__(self, question: str):
        low = question.lower()
        years = {int(y) for y in re.findall(r"\b((?:19|20)\d\d)\b", low)}
        for a, b in re.findall(r"between (\d{4}) and (\d{4})", low):
            years.update(range(int(a), int(b) + 1))
        self.years = sorted(years)
        self.subject = next((s for s in SUBJECTS if re.search(rf"\b{re.escape(s)}\b", low)), None)
        self.tokens = [t for t in re.findall(X.TOKEN, low) if len(t) > 1 and t not in X.STOPWORDS]
        self.terms = [w for w in re.findall(r"[a-z0-9$%.,]+", low) if w not in ASKING and len(w) > 2]


def _any(columns: list[Column]) -> Column:
    return reduce(or_, columns, F.lit(False))


def retrieve(chunks: DataFrame, pairs: DataFrame, question: str, k: int = TURNS) -> DataFrame:
    """status, place, turn_key, score of at most k turns; a refusal is one row without a turn.

    A year is a constraint on the sitting if there is one, else on the text if any names it, else it is
    dropped, as is a subject in no text. If each constraint can be met but not all together, the premise is
    false: `refused_conjunction`. Statistics and ranks are those of the turns that are left; if none has any
    of the question's distinctive words: `refused_no_terms`. Without any constraint all turns are searched:
    `fell_back`. A turn that corrects one above it moves directly above that. chunks has turn_key, part, year,
    cite_text, pairs announce_turn and supersede_turn.
    """
    c = Constraints(question)
    text = F.col("cite_text")
    counts = [F.count_if(F.col("year") == y).alias(f"y{y}") for y in c.years] + [F.count_if(F.contains(text, F.lit(str(y)))).alias(f"t{y}") for y in c.years]
    has_subject = F.contains(F.lower(text), F.lit(c.subject)) if c.subject else F.lit(False)
    found = chunks.agg(*counts, F.count_if(has_subject).alias("subject")).first()  # one row: which constraints hold
    sitting = [y for y in c.years if found[f"y{y}"]]
    named = [y for y in c.years if not found[f"y{y}"] and found[f"t{y}"]]
    where = [F.col("year").isin(sitting)] if sitting else []
    where += [_any([F.contains(text, F.lit(str(y))) for y in named])] if named else []
    where += [has_subject] if found["subject"] else []
    rows = reduce(DataFrame.where, where, chunks.where("cite_text IS NOT NULL"))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "cite_text"))), lambda x: x["cite_text"]), " ")
    pool = rows.groupBy("turn_key").agg(texts.alias("text"))
    scored = bm25(pool, "turn_key", "text", c.tokens).withColumn("score", F.round("score", 6))
    # turns without a word of the question follow with 0, by key; of those no more than k can be wanted
    none = pool.select("turn_key", F.lit(0.0).alias("score")).orderBy("turn_key").limit(2 * k)
    scored = scored.unionByName(none).groupBy("turn_key").agg(F.max("score").alias("score"))
    best = scored.orderBy(F.desc("score"), "turn_key").limit(k).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "turn_key")))  # k rows
    mend = pairs.where("supersede_turn IS NOT NULL").groupBy("announce_turn").agg(F.min("supersede_turn").alias("turn_key"))
    above = best.select(F.col("turn_key").alias("announce_turn"), F.col("rank").alias("above")).join(mend, "announce_turn").groupBy("turn_key").agg(F.min("above").alias("above"))
    best = best.join(above, "turn_key", "left")
    order = [F.least("rank", F.coalesce("above", "rank")), F.when(F.col("above") < F.col("rank"), 0).otherwise(1), F.col("rank")]
    best = best.select(F.row_number().over(Window.orderBy(*order)).alias("place"), "turn_key", "score")
    low = F.lower("text")
    hits = sum((F.contains(low, F.lit(t)).cast("int") for t in c.terms), F.lit(0))
    total = pool.agg(F.count("*").alias("n"), F.coalesce(F.max(hits), F.lit(0)).alias("hits"))
    status = F.when((F.col("n") == 0) & F.lit(bool(where)), "refused_conjunction").when((F.col("hits") == 0) & F.lit(bool(c.terms)), "refused_no_terms").otherwise("answered" if where else "fell_back")
    total = total.select(status.alias("status"))
    return total.join(best, ~F.col("status").startswith("refused"), "left").select("status", "place", "turn_key", "score")


def _retrieve_sql(n: int, question: str, k: int = TURNS) -> str:
    """The same as common table expressions named by n, the last of them a{n}."""
    c = Constraints(question)
    years, subject = c.years, c.subject or "\x01"
    count = [f"count(*) FILTER (WHERE year = {y}) AS y{y}, count(*) FILTER (WHERE contains(cite_text, '{y}')) AS t{y}" for y in years]
    sit = " OR ".join(f"(y{y} > 0 AND year = {y})" for y in years) or "false"
    any_sit = " OR ".join(f"y{y} > 0" for y in years) or "false"
    say = " OR ".join(f"(y{y} = 0 AND t{y} > 0 AND contains(cite_text, '{y}'))" for y in years) or "false"
    any_say = " OR ".join(f"(y{y} = 0 AND t{y} > 0)" for y in years) or "false"
    query = "(VALUES " + ", ".join(f"('{t}', {c.tokens.count(t)})" for t in dict.fromkeys(c.tokens)) + ") q(term, w)"
    hits = " + ".join(f"CAST(contains(lower(text), '{t}') AS INTEGER)" for t in c.terms)
    return f"""p{n} AS (SELECT {", ".join([*count, f"count(*) FILTER (WHERE contains(lower(cite_text), '{subject}')) AS subject"])} FROM chunk_),
d{n} AS (SELECT turn_key, string_agg(cite_text, ' ' ORDER BY part, cite_text) AS text FROM chunk_, p{n} WHERE cite_text IS NOT NULL AND (NOT ({any_sit}) OR {sit}) AND (NOT ({any_say}) OR {say}) AND (subject = 0 OR contains(lower(cite_text), '{subject}')) GROUP BY 1),
k{n} AS (SELECT turn_key AS k, {X.TOKENS_SQL.format('text')} AS ts FROM d{n}), n{n} AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM k{n}),
f{n} AS (SELECT k, len(ts) AS dl, term, w, len(list_filter(ts, lambda x: x = term)) AS tf FROM k{n}, {query} WHERE list_contains(ts, term)), g{n} AS (SELECT term, count(*) AS df FROM f{n} GROUP BY 1),
s{n} AS (SELECT k, sum(w * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM f{n} JOIN g{n} USING (term), n{n} GROUP BY 1),
r{n} AS (SELECT turn_key, round(coalesce(score, 0), 6) AS score, row_number() OVER (ORDER BY round(coalesce(score, 0), 6) DESC, turn_key) AS rank FROM d{n} LEFT JOIN s{n} ON k = turn_key QUALIFY rank <= {k}),
m{n} AS (SELECT supersede_turn AS turn_key, min(rank) AS above FROM (SELECT announce_turn, min(supersede_turn) AS supersede_turn FROM pair_ WHERE supersede_turn IS NOT NULL GROUP BY 1) JOIN r{n} ON turn_key = announce_turn GROUP BY 1),
o{n} AS (SELECT row_number() OVER (ORDER BY least(rank, coalesce(above, rank)), CASE WHEN above < rank THEN 0 ELSE 1 END, rank) AS place, r{n}.turn_key, score FROM r{n} LEFT JOIN m{n} ON m{n}.turn_key = r{n}.turn_key),
h{n} AS (SELECT CASE WHEN n = 0 AND limited THEN 'refused_conjunction' WHEN hits = 0 THEN 'refused_no_terms' WHEN limited THEN 'answered' ELSE 'fell_back' END AS status
FROM (SELECT count(*) AS n, coalesce(max({hits}), 0) AS hits FROM d{n}), (SELECT ({any_sit}) OR ({any_say}) OR subject > 0 AS limited FROM p{n})),
a{n} AS (SELECT {n} AS question, status, CAST(place AS INTEGER) AS place, turn_key, score FROM h{n} LEFT JOIN o{n} ON status NOT LIKE 'refused%')"""


_ALL_SQL = ", " + ",\n".join(_retrieve_sql(n, x) for n, x in enumerate(QUESTIONS))


@R.query("constrained_retrieve", current_sql(_ALL_SQL + " " + " UNION ALL ".join(f"SELECT * FROM a{n}" for n in range(len(QUESTIONS)))))
def constrained_retrieve(spark: SparkSession, d: str) -> DataFrame:
    """Each question's turns or its refusal; see `retrieve`."""
    t = Tables(spark, d)
    chunks = checkpointed(t.chunk.select("turn_key", "part", "year", "cite_text").repartition("turn_key"))  # for all questions
    return reduce(DataFrame.unionByName, [retrieve(chunks, t.pair, x).select(F.lit(n).alias("question"), "*") for n, x in enumerate(QUESTIONS)])


@R.query(
    "context_pack",
    current_sql(
        ", "
        + _retrieve_sql(0, QUESTIONS[0])
        + f""", j AS (SELECT c.id, c.turn_key, c.part, a0.place FROM a0 JOIN chunk_ c ON c.turn_key = a0.turn_key QUALIFY row_number() OVER (PARTITION BY c.turn_key ORDER BY c.part, c.id) <= {PER_TURN}),
l AS (SELECT *, row_number() OVER (ORDER BY place, part, id) AS n FROM j QUALIFY n <= {PACKED})
SELECT n, id, turn_key, part, CASE WHEN turn_key IN (SELECT announce_turn FROM pair_ WHERE supersede_turn IS NOT NULL) THEN 'corrected later' WHEN turn_key IN (SELECT supersede_turn FROM pair_) THEN 'correction' END AS note FROM l"""
    ),
)
def context_pack(spark: SparkSession, d: str) -> DataFrame:
    """The first chunks of the turns of a question, in the turns' order, with a note where a turn was corrected later or
    is a correction."""
    t = Tables(spark, d)
    found = F.broadcast(retrieve(t.chunk, t.pair, QUESTIONS[0]).where("turn_key IS NOT NULL").select("turn_key", "place"))  # at most TURNS rows
    j = t.chunk.select("id", "turn_key", "part").join(found, "turn_key")
    j = j.withColumn("rn", F.row_number().over(Window.partitionBy("turn_key").orderBy("part", "id"))).where(F.col("rn") <= PER_TURN)
    packed = j.orderBy("place", "part", "id").limit(PACKED)
    packed = packed.select(F.row_number().over(Window.orderBy("place", "part", "id")).alias("n"), "id", "turn_key", "part")
    pairs = t.pair.where("supersede_turn IS NOT NULL")
    old = pairs.select(F.col("announce_turn").alias("turn_key"), F.lit(True).alias("old")).distinct()
    new = pairs.select(F.col("supersede_turn").alias("turn_key"), F.lit(True).alias("new")).distinct()
    note = F.when(F.col("old"), "corrected later").when(F.col("new"), "correction")
    return packed.join(old, "turn_key", "left").join(new, "turn_key", "left").select("n", "id", "turn_key", "part", note.alias("note"))


#: How many neighbours count in recall, and how many must have one of the query's label for it to pass.
NEAREST, PASSES = 10, 3
_SCORES_SQL = {"cosine": "round(list_dot_product(q.e, e.e) / greatest(sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(e.e, e.e)), 1e-12), 6)", "product": "round(list_dot_product(q.e, e.e), 6)"}


def _ranked_sql(run: str) -> str:
    return f"""SELECT '{run}' AS run, q.vec_id AS query_id, q.label, e.label AS found, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_SCORES_SQL[run]} DESC, e.vec_id) AS rank FROM e q JOIN e ON e.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0 QUALIFY rank <= {NEAREST}"""


_EVAL_SQL = f"""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), r AS ({_ranked_sql('cosine')} UNION ALL {_ranked_sql('product')}),
h AS (SELECT run, query_id, label, count(*) FILTER (WHERE found = label) AS hits, min(CASE WHEN found = label THEN rank END) AS first FROM r GROUP BY 1, 2, 3)"""


def evaluated(spark: SparkSession, d: str) -> DataFrame:
    """run, query_id, own, hits, first: of each query's nearest, by cosine and by plain product, how many have its label,
    and the rank of the first that has. Queries are the rows whose id is divisible by 100, against all rows."""
    e = load(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"), F.col("e").alias("q"))
    product = F.aggregate(F.zip_with("q", "e", lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    scores = F.array(F.struct(F.lit("cosine").alias("run"), F.round(cosine(F.col("q"), F.col("e")), 6).alias("score")), F.struct(F.lit("product").alias("run"), F.round(product, 6).alias("score")))
    near = e.join(q, F.col("vec_id") != F.col("query_id")).select("query_id", "own", "vec_id", "label", F.explode(scores).alias("x")).select("query_id", "own", "vec_id", "label", "x.*")
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("run", "query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= NEAREST)
    right = F.col("label") == F.col("own")
    return near.groupBy("run", "query_id", "own").agg(F.count_if(right).alias("hits"), F.min(F.when(right, F.col("rank"))).alias("first"))


@R.query(
    "recall_at_k",
    _EVAL_SQL
    + f""", n AS (SELECT label, count(*) AS n FROM e GROUP BY 1)
SELECT label, count(*) AS queries, round(avg(CASE WHEN n.n > 1 THEN hits * 1.0 / least({NEAREST}, n.n - 1) END), 6) AS recall, round(avg(coalesce(1.0 / first, 0)), 6) AS reciprocal_rank FROM h JOIN n USING (label) WHERE run = 'cosine' GROUP BY 1""",
)
def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    """How many of the rows of a query's label are among its nearest by cosine, and how early the first is."""
    n = load(spark, d, "embeddings").groupBy(F.col("label").alias("own")).agg(F.count("*").alias("n"))
    share = F.when(F.col("n") > 1, F.col("hits") / F.least(F.lit(NEAREST), F.col("n") - 1))
    g = evaluated(spark, d).where("run = 'cosine'").join(n, "own").groupBy(F.col("own").alias("label"))
    return g.agg(F.count("*").alias("queries"), F.round(F.avg(share), 6).alias("recall"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("reciprocal_rank"))


@R.query("eval_by_class", _EVAL_SQL +
    f", s AS (SELECT label, run, count(*) AS n, count(*) FILTER (WHERE first <= {PASSES}) AS passed FROM h GROUP BY 1, 2) SELECT label, max(n) AS n, "
    f"min(passed) AS least, max(passed) AS most FROM s GROUP BY 1")
def eval_by_class(spark: SparkSession, d: str) -> DataFrame:
    """How many queries of each label pass, over the runs."""
    s = evaluated(spark, d).groupBy(F.col("own").alias("label"), "run").agg(F.count("*").alias("n"), F.count_if(F.col("first") <= PASSES).alias("passed"))
    return s.groupBy("label").agg(F.max("n").alias("n"), F.min("passed").alias("least"), F.max("passed").alias("most"))


@R.query("eval_flips", _EVAL_SQL +
    f", p AS (SELECT query_id, run, coalesce(first <= {PASSES}, false) AS passed FROM h) SELECT query_id, count(*) AS runs, count(*) FILTER (WHERE passed) "
    f"AS passed FROM p GROUP BY 1 HAVING count(DISTINCT passed) > 1")
def eval_flips(spark: SparkSession, d: str) -> DataFrame:
    """Queries that pass in one run and not in another."""
    p = evaluated(spark, d).select("query_id", F.coalesce(F.col("first") <= PASSES, F.lit(False)).alias("passed"))
    g = p.groupBy("query_id").agg(F.count("*").alias("runs"), F.count_if("passed").alias("passed"))
    return g.where("passed > 0 AND passed < runs")
