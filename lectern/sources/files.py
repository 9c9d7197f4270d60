"""Files in and out: year-sharded JSON, JSON lines, logs, and tables that appear as a whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"

SITTING = T.StructType(
    [
        T.StructField("date", T.StringType()),
        T.StructField("coverage", T.StructType([T.StructField("collected", T.IntegerType()), T.StructField("max_result", T.IntegerType()), T.StructField("ratio", T.DoubleType())])),
        T.StructField(
            "reports",
            T.ArrayType(
                T.StructType(
                    [
                        *(T.StructField(c, T.StringType()) for c in ("report_id", "report_type", "title")),
                        T.StructField("turns", T.ArrayType(T.StructType([*(T.StructField(c, T.StringType()) for c in ("speaker", "text", "lang", "time")), T.StructField("is_procedural", T.BooleanType())]))),
                    ]
                )
            ),
        ),
    ]
)


def read_sittings(spark: SparkSession, path: str, years: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Good documents and bad ones of folders `year=YYYY` with one JSON document a file.

    The schema is given, not guessed; only the folders of `years` are read. A file that can't be read goes
    to the second table with its path, and stops nothing.
    """
    schema = T.StructType([*SITTING.fields, T.StructField(CORRUPT, T.StringType())])
    reader = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("recursiveFileLookup", True)
    rows = reader.json(path if years is None else [f"{path}/year={y}" for y in years]).withColumn("path", F.input_file_name())
    rows = rows.withColumn("year", F.regexp_extract("path", r"year=(\d{4})", 1).try_cast("int"))
    return rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT), rows.where(F.col(CORRUPT).isNotNull() & F.col("date").isNull()).select("path", CORRUPT)


def sitting_turns(sittings: DataFrame) -> DataFrame:
    """One row for each turn: key, report_id, turn, date, speaker, text, lang, time, is_procedural."""
    r = sittings.select("date", F.explode("reports").alias("r"))
    t = r.select("date", F.col("r.report_id").alias("report_id"), F.posexplode("r.turns").alias("turn", "t"))
    return t.select(F.concat("report_id", F.lit("#t"), F.col("turn").cast("string")).alias("key"), "report_id", "turn", "date", "t.*")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Adds rows; each write is committed as a whole."""
    rows.write.mode("append").parquet(path)


def _file_system(spark: SparkSession, path: str):  # noqa: ANN202
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    return hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop.Path


def swap_steps(spark: SparkSession, staged: str, path: str, old: str) -> list[Callable[[], object]]:
    """The steps that put the folder `staged` in the place of `path`, which is kept as `old` until the end.

    After any of them `recover` gives the old table or the new one.
    """
    fs, at = _file_system(spark, path)
    return [
        lambda: fs.mkdirs(at(old).getParent()),
        lambda: fs.exists(at(path)) and fs.rename(at(path), at(old)),
        lambda: fs.mkdirs(at(path).getParent()),
        lambda: fs.rename(at(staged), at(path)),
        lambda: fs.delete(at(old), True),
    ]


def recover(spark: SparkSession, path: str) -> None:
    """Ends a replacement that was interrupted: where the new table, or a bucket of it, isn't in place yet, the old one
    comes back. Nothing is lost at any step; what was staged is written again by who replaces next."""
    fs, at = _file_system(spark, path)
    old = f"{path}.old"
    if not fs.exists(at(old)):
        return
    buckets = [f.getPath().getName() for f in fs.listStatus(at(old)) if f.isDirectory() and f.getPath().getName().startswith(f"{BUCKET}=")]
    for place, kept in [(f"{path}/{b}", f"{old}/{b}") for b in buckets] or [(path, old)]:
        if not fs.exists(at(place)):
            fs.mkdirs(at(place).getParent())
            fs.rename(at(kept), at(place))
    fs.delete(at(old), True)


def replace_table(rows: DataFrame, path: str) -> None:
    """Writes beside `path`, then puts the new table in its place. A reader sees the old table or the new one, or, for
    the moment between two renames, none; never a part. After a crash `recover`, which the next replacement and
    `read_table` call first, brings back the old table if the new one isn't in place."""
    spark = rows.sparkSession
    recover(spark, path)
    rows.write.mode("overwrite").parquet(f"{path}.staged")
    for step in swap_steps(spark, f"{path}.staged", path, f"{path}.old"):
        step()


def cached_table(spark: SparkSession, path: str, compute: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
    """What `compute` gives, written at the first use with the time of it (probed_at) and read from then on; anew with
    `refresh`."""
    recover(spark, path)
    fs, at = _file_system(spark, path)
    if refresh or not fs.exists(at(path)):
        replace_table(compute().withColumn("probed_at", F.current_timestamp()), path)
    return spark.read.parquet(path)


#: The column by which a table that is merged into is divided.
BUCKET = "bucket"


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table that is replaced or merged into, after a crash too; empty if there is none yet."""
    recover(spark, path)
    fs, at = _file_system(spark, path)
    if not fs.exists(at(path)):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def merge_steps(rows: DataFrame, path: str, key: str, at: str, buckets: int = 64) -> list[Callable[[], object]]:
    """The steps that bring a table to the latest row of each key with `rows` added.

    The table is divided by a hash of the key; only buckets that `rows` has keys of are read and written, and
    each is put in place as `replace_table` does. The number of buckets stays that of the first merge.
    """
    spark = rows.sparkSession
    recover(spark, path)
    fs, place = _file_system(spark, path)
    held = [f.getPath().getName() for f in fs.listStatus(place(path)) if f.getPath().getName().startswith(f"{BUCKET}=")] if fs.exists(place(path)) else []
    new = rows.withColumn(BUCKET, F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int"))
    touched = [r[0] for r in new.select(BUCKET).distinct().collect()]  # numbers of buckets
    old = [f"{path}/{BUCKET}={b}" for b in touched if f"{BUCKET}={b}" in held]
    if old:
        new = new.unionByName(spark.read.schema(rows.schema).option("basePath", path).parquet(*old).withColumn(BUCKET, F.col(BUCKET).cast("int")))
    last = Window.partitionBy(BUCKET, key).orderBy(F.col(at).desc_nulls_last(), F.xxhash64(*rows.columns))
    kept = new.withColumn("__rn", F.row_number().over(last)).where("__rn = 1").drop("__rn")
    steps: list[Callable[[], object]] = [lambda: kept.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{path}.staged")]
    for b in sorted(touched):
        steps += swap_steps(spark, f"{path}.staged/{BUCKET}={b}", f"{path}/{BUCKET}={b}", f"{path}.old/{BUCKET}={b}")
    return steps


def merge_table(rows: DataFrame, path: str, key: str, at: str, buckets: int = 64) -> None:
    """Keeps a table at the latest row of each key. Run again with the same rows, it changes nothing."""
    for step in merge_steps(rows, path, key, at, buckets):
        step()


def migration_plan(rows: DataFrame, by: str) -> DataFrame:
    """What `migrate_partitioned` would write: the rows of each folder. Nothing is written."""
    return rows.groupBy(by).agg(F.count("*").alias("rows"))


def _fingerprint(rows: DataFrame) -> tuple:
    """Number of rows and a sum of row hashes, which doesn't depend on their order."""
    h = F.xxhash64(*(F.col(c).cast("string") for c in sorted(rows.columns)))
    return tuple(rows.agg(F.count("*"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first())


def migrate_partitioned(rows: DataFrame, path: str, by: str, delete: str | None = None) -> int:
    """Writes a flat table in folders by a column and compares what arrived by number and hash; raises if it isn't what
    was sent. Only then the folder `delete`, the flat table, is deleted, if one is named."""
    rows.write.mode("overwrite").partitionBy(by).parquet(path)
    spark = rows.sparkSession
    sent, there = _fingerprint(rows), _fingerprint(spark.read.schema(rows.schema).parquet(path))
    if sent != there:
        raise ValueError(f"{there[0]} rows, other than the {sent[0]} sent, arrived in {path}")
    if delete is not None:
        fs, at = _file_system(spark, delete)
        fs.delete(at(delete), True)
    return there[0]
