"""What happens to an answer after it was generated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslake.functions.text import strip_citations

#: Replies that say that nothing was found, as a suffix of an answer or as all of it.
NO_INFO = ("No information was found.", "I could not find this.")
LEAKS = r"(?i)system\s+prompt|my instructions|internal rules|hidden context|<context>"
#: What is answered in place of a text that leaks.
FALLBACK = "This cannot be answered. Please ask in another way."


def leaks(answer: Column) -> Column:
    return answer.rlike(LEAKS)


def guarded(tokens: Column) -> Column:
    """(sent, leaked, answer) of the tokens of one answer: sent are those before the one with which the text first leaks.

    The text is searched once; the token is found by the lengths of those before it."""
    text = F.array_join(tokens, "")
    start = F.regexp_instr(text, F.lit(LEAKS))
    end = start + F.length(F.regexp_extract(text, f"({LEAKS})", 1)) - 1
    places = F.aggregate(tokens, F.struct(F.lit(0).alias("length"), F.lit(0).alias("n")), lambda s, t: F.struct((s["length"] + F.length(t)).alias("length"), (s["n"] + (s["length"] + F.length(t) < end).cast("int")).alias("n")), lambda s: s["n"])
    return F.struct(F.when(start > 0, places).otherwise(F.size(tokens)).cast("long").alias("sent"), (start > 0).alias("leaked"), F.when(start > 0, FALLBACK).otherwise(text).alias("answer"))


def displayed(answer: Column) -> Column:
    """An answer as it is shown: without citation marks and section labels, breaks of three lines or more as two."""
    plain = F.regexp_replace(F.regexp_replace(answer, r"\[:?#[\d,\s]+\]", ""), r"(?i)\brelevant sections?\s*:\s*[,\s]*", "")
    return F.regexp_replace(F.regexp_replace(plain, r"\n{3,}", "\n\n"), r"\A\s+|\s+\z", "")


def is_empty(answer: Column, heading: str = "Answer:") -> Column:
    """Whether nothing but markup follows the last heading."""
    tail = F.element_at(F.split(answer, heading), -1)
    return answer.contains(heading) & (F.regexp_replace(tail, r"[\s*_#>`~-]+|\[#?\d+\]", "") == "")


def cleaned(answer: Column) -> Column:
    """Without citation marks, and without a trailing no-information reply that follows something else."""
    text = strip_citations(answer)
    for suffix in NO_INFO:
        cut = F.regexp_replace(F.substring(text, F.lit(1), F.length(text) - len(suffix)), r"[ \n.,;]+$", "")
        text = F.when(text.endswith(suffix) & (F.length(text) > len(suffix)), cut).otherwise(text)
    return text


def degraded(confidence: Column, answer: Column) -> Column:
    return (confidence == 0) | answer.isin(*NO_INFO)


def rejected(question: Column, mentions: Column, language: Column, session: Column) -> Column:
    """The first reason to reject a request, or null."""
    size = F.length(F.trim(question))
    return (
        F.when(size < 3, "short").when(size > 500, "long").when(F.size(mentions) > 10, "mentions")
        .when(F.exists(mentions, lambda m: F.length(m) > 100), "mention").when(~language.isin("en", "es"), "language")
        .when(F.length(session) > 64, "session").when(question.rlike(r"(?i)<\s*script|javascript:|on\w+\s*="), "markup")
    )


def error_kind(message: Column) -> Column:
    limited = message.rlike(r"(?i)\b429\b|quota|rate.?limit")
    return F.when(limited & message.rlike(r"(?i)per.?day|daily"), "daily").when(limited, "rate").when(message.rlike(r"(?i)time[d]?.?out"), "timeout").otherwise("other")


def retry_delay(message: Column) -> Column:
    """Seconds that a message asks to wait, plus one; else a minute."""
    asked = F.regexp_extract(message, r"(?i)retry in (\d+)", 1).try_cast("int")
    return F.coalesce(asked + 1, F.lit(60))


def section_label(answer: Column) -> Column:
    """(label, rest): a leading reasoning or answer heading, and what follows it."""
    pattern = r"(?i)\A[\s*_#>-]*(reasoning|answer)[\s*_]*:[\s*_]*"
    label = F.lower(F.regexp_extract(answer, pattern, 1))
    return F.struct(F.nullif(label, F.lit("")).alias("label"), F.regexp_replace(answer, pattern, "").alias("rest"))
