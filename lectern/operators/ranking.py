"""BM25, cosine and rank fusion as plans of built-in operators."""

from __future__ import annotations

from functools import partial, reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import tokens

K1, B, FUSION = 1.2, 0.75, 60


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf, dl: how often a term occurs in a document, and the document's length in terms."""
    t = docs.select(F.col(key), tokens(text).alias("ts")).withColumn("dl", F.size("ts"))
    return t.select(key, "dl", F.explode("ts").alias("term")).groupBy(key, "dl", "term").agg(F.count("*").alias("tf"))


def _is(term: str, x: Column) -> Column:
    return x == term


def bm25(docs: DataFrame, key: str, text: str, query: list[str]) -> DataFrame:
    """key, score of the documents with a query term; a term asked twice counts twice.

    Statistics come from one pass over all documents, scores from another, which takes apart only texts in
    which a term occurs as letters. Words are found once a pass: the array of them is generated, a barrier
    behind which filters don't repeat it.
    """
    weights = {t: query.count(t) for t in dict.fromkeys(query)}

    def counted(rows: DataFrame) -> DataFrame:
        ts = rows.select(F.col(key), F.explode(F.array(tokens(text))).alias("ts"))
        counts = [F.size(F.filter("ts", partial(_is, t))).alias(f"tf{i}") for i, t in enumerate(weights)]
        return ts.select(key, F.size("ts").alias("dl"), *counts)

    totals = counted(docs).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(weights))))
    low = F.lower(F.col(text))
    some = docs.where(reduce(or_, [F.contains(low, F.lit(t)) for t in weights], F.lit(False)))
    hits = counted(some).where(F.greatest(F.lit(0), F.lit(0), *(F.col(f"tf{i}") for i in range(len(weights)))) > 0)
    j = hits.withColumn("t", totals.select(F.struct("*")).scalar())
    score: Column = F.lit(0.0)
    for i, w in enumerate(weights.values()):
        tf, df = F.col(f"tf{i}"), F.col(f"t.df{i}")
        idf = F.log(1 + (F.col("t.n") - df + 0.5) / (df + 0.5))
        score = score + F.when(tf > 0, w * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("t.avgdl")))).otherwise(0.0)
    return j.select(key, score.alias("score"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(1e-12))


def top_rank(scored: DataFrame, key: str, score: str, k: int) -> DataFrame:
    """The k best, ties by key, with their ranks from 1; ranks are given after the limit."""
    best = scored.orderBy(F.desc(score), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)))


def fuse(rankings: list[DataFrame], key: str) -> DataFrame:
    """key, score: the sum of 1 / (60 + rank) over the rankings a key is in."""
    all_ = rankings[0].select(key, "rank")
    for r in rankings[1:]:
        all_ = all_.unionByName(r.select(key, "rank"))
    return all_.groupBy(key).agg(F.sum(1 / (FUSION + F.col("rank"))).alias("score"))
