"""The queries of the text operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import domain, glyphs, languages, names, packing, pieces, sentences, tokens, transcripts
from lectern.plans.registry import Registry
from lectern.sources import load, scratch_folder

R = Registry()


@R.query("p2_found")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glyphs.same_look(load(spark, sf_dir, "turn"), load(spark, sf_dir, "chunk"), load(spark, sf_dir, "report"))


@R.query("p2_classes")
def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of a report that look the same: classes of equal texts with their number and a representative."""
    turns = domain.holding(load(spark, sf_dir, "turn").select("key", "report_id", "text", "loaded_at"), "key")
    return glyphs.look_classes(turns.withColumn("__report", F.col("report_id"))).select(F.col("__report").alias("report_id"), F.hex("look").alias("look"), F.col("t").alias("text_md5"), "n", "key")


@R.query("p3_found")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.turn_units(load(spark, sf_dir, "turn"), load(spark, sf_dir, "report"))


@R.query("p8_ids")
def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_ids(load(spark, sf_dir, "documents"))


@R.query("p9_packed")
def p9_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(load(spark, sf_dir, "documents"))


@R.query("p9_fill")
def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers by how full they are, in sixteenths of the capacity."""
    used = p9_packed(spark, sf_dir).where("container IS NOT NULL").groupBy("container").agg(F.sum("n").alias("used"))
    sixteenth = F.floor(F.col("used") * 16 / packing.CAPACITY).cast("int").alias("sixteenths")
    return used.groupBy(sixteenth).agg(F.count("*").alias("containers"), F.sum("used").alias("used"))


@R.query("p6_found")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.faulty_splits(load(spark, sf_dir, "turn"), load(spark, sf_dir, "chunk"), load(spark, sf_dir, "report"))


@R.query("p6_pieces")
def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every turn of more than the limit, with their hash."""
    turns = load(spark, sf_dir, "turn").select("key", "text", "loaded_at")
    own = domain.holding(turns, "key").where(F.length("text") > pieces.LIMIT)
    return pieces.cut_pieces(pieces.text_ranges(own, "key", "text")).withColumn("md5", F.md5("piece"))


@R.query("p6_files")
def p6_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts of documents, written as text files to the shared folder and cut there by byte ranges: the pieces of
    each file, numbered by its name, with their hash."""
    folder = scratch_folder(spark, "files")
    load(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.translate("text", "\r", "\n").alias("value")).write.text(folder)
    cut = pieces.cut_files(spark, folder)
    file = F.regexp_extract("key", r"part-(\d+)", 1).cast("int").alias("file")
    return cut.select(file, "part", "n_parts", "char_start", "char_end", "natural", F.md5("piece").alias("md5"))


@R.query("p5_found")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.speaker_members(load(spark, sf_dir, "turn"), load(spark, sf_dir, "roster"))


@R.query("p1_turns")
def p1_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.clean_turns(load(spark, sf_dir, "turn"), load(spark, sf_dir, "report"), load(spark, sf_dir, "roster"))


@R.query("p1_found")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_turns(spark, sf_dir).where("speaker_id IS NOT NULL").select("report_id", "first_turn", "nth", "speaker_id", "n_words")


@R.query("p10_found")
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return languages.wrong_labels(docs, languages.train(docs))


@R.query("p10_documents")
def p10_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, with the languages of its sentences, their shares and a confidence."""
    docs = load(spark, sf_dir, "documents")
    found = languages.document_languages(docs, languages.train(docs))
    return found.select("doc_id", "labelled", "lang", F.array_join("langs", ",").alias("langs"), F.array_join(F.transform("shares", lambda x: x.cast("string")), ",").alias("shares"), "confidence")


@R.query("p10_segments")
def p10_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return languages.language_segments(docs, languages.train(docs))
