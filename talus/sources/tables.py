"""Text tables: CSV and JSON lines with explicit schemas, and their sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_csv(spark: SparkSession, path: str | list[str], columns: list[str]) -> DataFrame:
    """Every cell a string, blank for missing; quotes are doubled, and a quoted cell may hold line ends."""
    reader = spark.read.schema(text_schema(columns)).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    return reader.csv(path).na.fill("")


def read_csvs(spark: SparkSession, paths: list[str], columns: list[str], key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of several files, the first per key in order of files and lines; and the keys of those left out."""
    from functools import reduce

    from talus.operators.dedupe import keep_first, later_duplicates

    parts = [read_csv(spark, p, columns).withColumns({"__file": F.lit(i), "__line": F.monotonically_increasing_id()}) for i, p in enumerate(paths)]
    rows = reduce(DataFrame.unionByName, parts)
    return keep_first(rows, [key], "__file", "__line").drop("__file", "__line"), later_duplicates(rows, [key], "__file", "__line").select(key)


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, *, required: list[str] | None = None, tag: str | None = None) -> DataFrame:
    """JSON lines without blank ones, undecodable bytes replaced; with required keys, lines that lack one are an error.

    ``tag`` names a column for the file a row comes from.
    """
    lines = spark.read.text(path).select(F.make_valid_utf8("value").alias("value"), F.col("_metadata.file_path").alias("__file")).filter(F.trim("value") != "")
    if required:
        missing = lines.filter(F.size(F.array_except(F.array(*[F.lit(c) for c in required]), F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>")))) > 0)
        if bad := missing.limit(3).collect():
            raise ValueError("missing columns: " + "; ".join(f"{r['__file']}: {r['value'][:200]}" for r in bad))
    rows = lines.select(F.from_json("value", schema).alias("r"), "__file")
    return rows.select("r.*", *([F.col("__file").alias(tag)] if tag else []))


def file_system(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def log_runs(spark: SparkSession, path: str) -> list[int]:
    """Numbers of a log's finished runs, in order; a run that has failed left no mark of success."""
    fs, folder = file_system(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    numbers = sorted(int(n.partition("=")[2]) for n in names if n.startswith("run="))
    return [n for n in numbers if fs.exists(file_system(spark, f"{path}/run={n:012d}/_SUCCESS")[1])]


def append_jsonl(df: DataFrame, path: str) -> int:
    """Appends rows to a log as a run of its own and returns its number, one more than any before.

    The number is claimed by making a file that is not there yet, which a store does for one writer only; so appends at the
    same time have an order too. A run that fails stays unread and its number unused.
    """
    spark = df.sparkSession
    fs, claims = file_system(spark, f"{path}/_claims")
    taken = [int(f.getPath().getName()) for f in fs.listStatus(claims)] if fs.exists(claims) else []
    run = max([*taken, *log_runs(spark, path)], default=-1) + 1
    while not fs.createNewFile(file_system(spark, f"{path}/_claims/{run:012d}")[1]):
        run += 1
    write_jsonl(df, f"{path}/run={run:012d}", "errorifexists")
    return run


def read_jsonl_cache(spark: SparkSession, path: str, schema: str | T.StructType, key: str) -> DataFrame:
    """A progress log's last line per key: of the latest run, there of the last file part, there the last line.

    ``path`` is a log that ``append_jsonl`` wrote, or a file or folder of lines, which counts as one run.
    """
    runs = log_runs(spark, path)
    files = [f"{path}/run={n:012d}" for n in runs] or path
    name, number = F.col("_metadata.file_path"), lambda pattern: F.nullif(F.regexp_extract("_metadata.file_path", pattern, 1), F.lit("")).cast("long")
    # a large file is read in blocks, each by one task from its beginning
    at = F.struct(number(r"/run=(\d+)/[^/]*$").alias("run"), number(r"/part-(\d+)[^/]*$").alias("part"), name.alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(files).select("value", at.alias("__at")).filter(F.trim("value") != "")
    rows = lines.select(F.from_json("value", schema).alias("r"), "__at").filter(f"r.{key} is not null")
    return rows.groupBy(F.col(f"r.{key}").alias("__key")).agg(F.max_by("r", "__at").alias("r")).select("r.*")


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).filter(F.trim("value") != "").count()


def write_csv(df: DataFrame, path: str, columns: list[str], *, strict: bool = False) -> None:
    """Given columns in their order, blank where missing; with ``strict``, any other column is an error."""
    if strict and (extra := [c for c in df.columns if c not in columns]):
        raise ValueError(f"unexpected columns: {extra}")
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns]
    df.select(*cells).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def json_lines(df: DataFrame) -> DataFrame:
    """The column ``value``: one object a row, non-ASCII as it is, nulls kept."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    json_lines(df).write.mode(mode).text(path)


def write_partitioned(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def to_markdown(df: DataFrame, limit: int = 1000) -> str:
    """A table as Markdown. A report has ``limit`` rows at most; if there are more, its last line says so."""
    from talus.functions.text import escape_cell

    cells = df.select(*[escape_cell(F.col(f"`{c}`")).alias(c) for c in df.columns]).limit(limit + 1).collect()
    rows = [df.columns, ["---"] * len(df.columns), *[[*r] for r in cells[:limit]]]
    more = [f"\nOnly the first {limit} rows are shown."] if len(cells) > limit else []
    return "\n".join(["| " + " | ".join(row) + " |" for row in rows] + more)


def summary_json(row: DataFrame) -> str:
    return row.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).first()["j"]


def read_splits(spark: SparkSession, paths: dict[str, str], schema: str | T.StructType) -> DataFrame:
    """JSON lines of several splits as one table with the column ``split``."""
    from functools import reduce

    return reduce(DataFrame.unionByName, [read_jsonl(spark, path, schema).withColumn("split", F.lit(name)) for name, path in paths.items()])


def read_keyed(spark: SparkSession, path: str, columns: list[str], key: str) -> dict[str, dict[str, str]]:
    """A summary table of one row per key, as a dictionary; of repeated keys the last line counts. Summaries are small by kind."""
    return {r[key]: r.asDict() for r in read_csv(spark, path, columns).collect()}


def load_payloads(spark: SparkSession, path: str, manifest: DataFrame, key: str, wanted: list[str]) -> tuple[DataFrame, DataFrame]:
    """Manifest rows with their payload columns, and an issue row (key, code, message) for each payload that cannot be used.

    A payload that is absent, or lacks an array, is an issue and no error; its columns are null.
    """
    payloads = spark.read.parquet(path)
    lacking = [c for c in wanted if c not in payloads.columns]
    payloads = payloads.withColumns({c: F.lit(None).cast("array<double>") for c in lacking}).select(F.col(key), *wanted, F.lit(True).alias("__found"))
    rows = manifest.join(payloads, key, "left")
    absent = F.when(F.col("__found").isNull(), F.struct(F.lit("load_error").alias("code"), F.lit("payload is absent").alias("message")))
    blank = [F.when(F.col("__found") & F.col(c).isNull(), F.struct(F.lit("missing_array").alias("code"), F.lit(c).alias("message"))) for c in wanted]
    issues = rows.select(F.col(key).cast("string").alias("key"), F.explode(F.array_compact(F.array(absent, *blank))).alias("i")).select("key", "i.*")
    return rows.drop("__found"), issues
