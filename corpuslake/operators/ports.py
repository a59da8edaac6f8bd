"""Model ports: where a user's models come in, with deterministic stand-ins for tests.

A port is a function of columns. The stand-ins say nothing about quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.functions.text import tokens

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def embed(text: str | Column) -> Column:
    """Stand-in embedding: how often each letter occurs; a text without letters, or null, gives zeros."""
    low = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    return F.transform(F.array(*[F.lit(x) for x in LETTERS]), lambda x: (F.length(low) - F.length(F.replace(low, x, F.lit("")))).cast("double"))


def relevance(query: str | Column, text: str | Column) -> Column:
    """Stand-in reranker: the share of the query's distinct tokens that the text has; null without tokens."""
    q = F.array_distinct(tokens(query))
    return F.try_divide(F.size(F.array_intersect(q, tokens(text))).cast("double"), F.size(q).cast("double"))


def judge(question: Column, expected: Column, answer: Column) -> Column:
    """Stand-in judge: a reply with a JSON verdict, correct where the answer holds the expected text."""
    ok = (expected != "") & answer.contains(expected)
    said = F.when(ok, "holds").otherwise("lacks")
    return F.concat(F.lit('{"verdict": "'), F.when(ok, "correct").otherwise("wrong"), F.lit('", "justification": "the answer '), said, F.lit(' the expected text"}'))


def generate(question: Column, context: Column) -> Column:
    """Stand-in generator: the first sentence of the context, cited, under the heading that answers have."""
    sentence = F.regexp_extract(context, r"^([^.!?]*[.!?]?)", 1)
    return F.when(F.length(F.trim(sentence)) > 0, F.concat(F.lit("Answer: "), sentence, F.lit(" [#1]"))).otherwise("Answer: ")


def memo(questions: DataFrame, passage: Column, path: str) -> DataFrame:
    """question, passage: a port's answer to each distinct question, made once and kept at a path, so that a model that
    answers differently each time gives all its readers one answer."""
    questions.select("question").distinct().withColumn("passage", passage).write.parquet(path)
    return questions.sparkSession.read.parquet(path)


def hypothetical(question: Column) -> Column:
    """Stand-in for a generated passage: the second half of a question of even length; none for others, so that only these are searched."""
    length = F.length(question)
    return F.when(length % 2 == 0, F.substring(question, (length / 2 + 1).cast("int"), length)).otherwise("")
