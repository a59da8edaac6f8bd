"""Text columns. All are built-in expressions; patterns are Unicode-aware where words matter."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

CODE = r"\b\d{3}(?:\.(?:\d+|[a-z]))*\b"
#: The most frequent English words, most frequent first: what a keyword search leaves out unless told otherwise.
FREQUENT_WORDS = tuple("the be to of and a in that have i it for not on with he as you do at".split())


def _c(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def whole_word(column: str | Column, term: str) -> Column:
    """Whether the term occurs as a whole word, in any case."""
    return _c(column).rlike(rf"(?iU)\b{re.escape(term)}\b")


def tokens(column: str | Column) -> Column:
    """Lower-case runs of letters and digits: no stemming, no stop words."""
    return F.regexp_extract_all(F.lower(_c(column)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def keywords(column: str | Column, least: int = 3, stops: tuple[str, ...] = FREQUENT_WORDS) -> Column:
    """Distinct ASCII words of a query in order, without short words and those of `stops`."""
    found = F.regexp_extract_all(F.lower(_c(column)), F.lit("[a-z]+"), F.lit(0))
    return F.array_except(F.array_distinct(F.filter(found, lambda w: F.length(w) >= least)), F.array(*[F.lit(w) for w in stops]))


def rule_codes(column: str | Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(_c(column), F.lit(CODE), F.lit(0)))


def numeric_base(column: str | Column) -> Column:
    return F.nullif(F.regexp_extract(_c(column), r"^(\d{3})", 1), F.lit(""))


def references(column: str | Column) -> Column:
    """Comma-separated references, trimmed, blanks dropped; null gives none."""
    parts = F.transform(F.split(F.coalesce(_c(column), F.lit("")), ","), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def tags(column: str | Column) -> Column:
    """Lower-case @tags in order."""
    return F.transform(F.regexp_extract_all(_c(column), F.lit(r"(?U)@(\w+)"), F.lit(1)), F.lower)


def without_tags(column: str | Column) -> Column:
    return F.trim(F.regexp_replace(_c(column), r"(?U)@\w+", ""))


def name_tokens(column: str | Column) -> Column:
    """Words of a name longer than two characters, without its trailing variant."""
    plain = F.regexp_replace(_c(column), r"\s*\([^)]*\)\s*$", "")
    return F.filter(F.split(F.lower(plain), r"(?U)[^\p{L}\p{N}]+"), lambda t: F.length(t) > 2)


def printing_key(column: str | Column) -> Column:
    """The name that a `**Name**:` line gives, without its variant, lower-case; null without such a line."""
    name = F.regexp_extract(_c(column), r"\*\*Name\*\*: ([^|*\n]+)", 1)
    return F.nullif(F.lower(F.trim(F.regexp_replace(name, r"\s*\([^)]*\)\s*$", ""))), F.lit(""))


def preview(column: str | Column, size: int = 200) -> Column:
    return F.substring(_c(column), 1, size)


def newlines(column: str | Column) -> Column:
    """Line feeds only, one at the end."""
    return F.concat(F.rtrim(F.regexp_replace(F.regexp_replace(_c(column), "\r\n?", "\n"), r"\s+$", "")), F.lit("\n"))


def floor_tokens(column: str | Column) -> Column:
    return F.floor(F.length(_c(column)) / 4)


def ceil_tokens(column: str | Column) -> Column:
    return F.ceil(F.length(_c(column)) / 4)


def strip_citations(column: str | Column) -> Column:
    """Answers without [#1, 2] marks, and without the space these leave before punctuation."""
    return F.regexp_replace(F.regexp_replace(_c(column), r"\s*\[#?\d+(?:\s*,\s*#?\d+)*\]", ""), r"\s+([.,;:!?])", "$1")


def normal_separators(column: str | Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(_c(column)), r"[\s\-–—]+", " "))


def card_slug(column: str | Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(_c(column))), r"\s+", "-")


def confidence_band(column: str | Column) -> Column:
    c = _c(column)
    return F.when(c.isNull(), None).when(c >= 0.75, "high").when(c >= 0.55, "medium").otherwise("low")


def rule_section(column: str | Column) -> Column:
    """Whether a section's name opens with a rule number."""
    return _c(column).rlike(r"^\d{3,}\. ")


def first_bold(column: str | Column) -> Column:
    return F.nullif(F.regexp_extract(_c(column), r"\*\*([^*]+)\*\*", 1), F.lit(""))


def card_name(column: str | Column) -> Column:
    """The name that a `**Name**:` line gives, as written but for its variant; null without such a line."""
    name = F.regexp_extract(_c(column), r"\*\*Name\*\*: ([^|*\n]+)", 1)
    return F.nullif(F.trim(F.regexp_replace(name, r"\s*\([^)]*\)\s*$", "")), F.lit(""))


def mention_at_cursor(column: str | Column) -> Column:
    """(sigil, typed) of the mark that a text ends in; null without one."""
    c = _c(column)
    sigil = F.regexp_extract(c, r"([#@])([\w-]*)$", 1)
    return F.when(sigil != "", F.struct(sigil.alias("sigil"), F.regexp_extract(c, r"([#@])([\w-]*)$", 2).alias("typed")))


def sent_question(column: str | Column) -> Column:
    """A question as it is sent: without the signs that open mentions."""
    return F.replace(_c(column), F.lit("@"), F.lit(""))


def estimated_usage(prompt: Column, output: Column) -> Column:
    """Token counts guessed from lengths, marked as such."""
    of_prompt, of_output = ceil_tokens(prompt).cast("long"), ceil_tokens(output).cast("long")
    return F.struct(of_prompt.alias("prompt_tokens"), of_output.alias("output_tokens"), (of_prompt + of_output).alias("total_tokens"), F.lit(True).alias("estimated"))


def context_line(raw: str | Column, prefix: str = "Context:", least: int = 10, most: int = 300) -> Column:
    """A generated line made fit for use: no fences, pair of outer quotes or rule codes; one space for several; `least` to `most`
    characters behind the prefix; a full stop where there is room. Null where nothing fit is left.

    Quotes go only as a pair around the whole: a quote that ends a text belongs to a word of it."""
    text = F.regexp_replace(F.regexp_replace(_c(raw), r"\A\s+|\s+\z", ""), r"```[a-z]*", "")
    text = F.regexp_replace(F.regexp_replace(text, r"\A\s+|\s+\z", ""), r"""(?s)\A(["'])(.*)\1\z""", "$2")
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, CODE, ""), r"\s+", " "), r"\A[ .]+|[ .]+\z", "")
    text = F.when(text.startswith(prefix), F.regexp_replace(F.substring(text, len(prefix) + 1, 1 << 30), r"\A[ :]+|[ :]+\z", "")).otherwise(text)
    line = F.concat(F.lit(prefix + " "), text)
    ended = F.when(~line.rlike(r"[.?!]\z") & (F.length(line) < most), F.concat(line, F.lit("."))).otherwise(line)
    return F.when(F.length(text) >= least, F.substring(ended, 1, most))
