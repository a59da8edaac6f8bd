"""Tables and files as DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from fnmatch import fnmatch
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readable(read: Callable[[], DataFrame]) -> DataFrame | None:
    """What is read, or None where the path does not exist: a missing source is empty, not an error."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """(source_document, text), one row per file of a path; the document is the path's own name."""
    rows = readable(lambda: spark.read.text(path, wholetext=True))
    if rows is None:
        return spark.createDataFrame([], "source_document string, text string")
    return rows.select(F.lit(path.rstrip("/").rsplit("/", 1)[-1]).alias("source_document"), F.col("value").alias("text"))


def manifest(spark: SparkSession, sources: list[tuple[str, str]]) -> DataFrame:
    """ord, source_document, source_type, text: Markdown files with their source types, in the order of the list. Entries are
    read by their whole paths, so equal names in two folders stay apart; missing ones give nothing."""
    found = [markdown(spark, path).select(F.lit(n).alias("ord"), "source_document", F.lit(kind).alias("source_type"), "text") for n, (path, kind) in enumerate(sources)]
    return reduce(DataFrame.unionByName, found)


def items(raw: DataFrame, column: str, element: T.DataType, keys: tuple[str, ...] = ("items", "data", "results", "cards")) -> DataFrame:
    """Records of a JSON envelope: a bare list, or the first list under one of the keys; else none."""
    bare = F.from_json(column, T.ArrayType(element))
    wrapped = [F.from_json(F.get_json_object(column, f"$.{k}"), T.ArrayType(element)) for k in keys]
    chosen = F.when(F.trim(column).startswith("["), bare).otherwise(F.coalesce(*wrapped))
    return raw.withColumn("item", F.explode(chosen))


def questions(spark: SparkSession, path: str, with_reference: bool = False) -> DataFrame:
    """Evaluation questions from a list or a `questions` envelope; optionally those with a reference only."""
    item = T.StructType.fromDDL("id string, question string, canonical_answer string, source string, rule_reference string, tags array<string>, difficulty string")
    rows = items(spark.read.text(path, wholetext=True), "value", item, ("questions",)).select("item.*")
    return rows.filter(F.col("rule_reference").isNotNull()) if with_reference else rows


def latest_file(spark: SparkSession, pattern: str) -> str | None:
    """The greatest name that matches a pattern of files or folders, or None. Names are listed, no file is read."""
    rows = readable(lambda: spark.read.format("binaryFile").option("recursiveFileLookup", True).load(pattern).select("path"))
    greatest = None if rows is None else rows.agg(F.max("path")).first()[0]
    if greatest is None or fnmatch(greatest.rsplit("/", 1)[-1], pattern.rsplit("/", 1)[-1]):
        return greatest
    return greatest.rsplit("/", 1)[0]


def state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A checkpoint of JSON records, or nothing where there is none."""
    rows = readable(lambda: spark.read.schema(schema).json(path))
    return spark.createDataFrame([], schema) if rows is None else rows


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("escape", '"').csv(path, header=True)


def section_texts(files: DataFrame) -> DataFrame:
    """name, text of the `## ` sections of files (ord, text), in order; a name that occurs again keeps its last text."""
    parts = files.select("ord", F.posexplode(F.filter(F.split("text", r"(?m)(?=^## )"), lambda p: p.startswith("## "))).alias("pos", "part"))
    name = F.trim(F.regexp_extract("part", r"\A## (.+)", 1))
    text = F.regexp_replace("part", r"\A\s+|\s+\z", "")
    return parts.groupBy(name.alias("name")).agg(F.max_by(text, F.struct("ord", "pos")).alias("text"))


def embedded_json(html: str | Column, schema: T.DataType, script_id: str = "__NEXT_DATA__") -> Column:
    """The JSON of a page's data script, parsed."""
    body = F.regexp_extract(html, rf'(?s)<script[^>]*id="{script_id}"[^>]*>(.*?)</script>', 1)
    return F.from_json(body, schema)


def events_of(body: str | Column) -> Column:
    """Frames of a server-sent event text: array of (event, data); frames without data are left out."""
    column = F.col(body) if isinstance(body, str) else body
    frames = F.filter(F.split(column, "\n\n"), lambda f: f.contains("data: "))

    def frame(f: Column) -> Column:
        event = F.nullif(F.regexp_extract(f, r"(?m)^event: (.*)$", 1), F.lit(""))
        return F.struct(F.coalesce(event, F.lit("message")).alias("event"), F.regexp_extract(f, r"(?m)^data: (.*)$", 1).alias("data"))

    return F.transform(frames, frame)

