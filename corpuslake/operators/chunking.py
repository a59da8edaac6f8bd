"""Documents to sections, units and chunks. Folds over one document's own array; no shuffle.

Inside a lambda Spark evaluates whatever does not depend on its variables anew for each element, so units are marked by
built-in expressions that see one unit only, and what is carried from unit to unit is a loop in an Arrow task: linear in the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.functions.text import first_bold

BUDGET = 512
RULE_BUDGET = 128
UNIT_START = r"(?m)(?=^\d{3,}\.)"
INLINE_RULE = r"(?=\b\d{3,}\.\s)"
TITLE = r"^(\d{3,})\.\s+\*\*(.+?)\*\*"


def approx_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("int")


def sections(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per H1 to H3 heading: ord, level, header, content up to the next. What precedes the first is dropped."""
    parts = F.filter(F.split(text, r"(?m)(?=^#{1,3}\s+\S)"), lambda p: p.rlike(r"\A#{1,3}\s+\S"))
    rows = docs.select("*", F.posexplode(parts).alias("ord", "part")).drop(text)
    return rows.select(
        *[c for c in rows.columns if c not in ("part",)],
        F.length(F.regexp_extract("part", r"\A(#{1,3})", 1)).alias("level"),
        F.trim(F.regexp_extract("part", r"\A#{1,3}\s+(.+)", 1)).alias("header"),
        F.regexp_replace("part", r"\A\s+|\s+\z", "").alias("content"),
    )


def body(content: Column) -> Column:
    """Content without its first heading line and the blank lines around."""
    return F.regexp_replace(F.regexp_replace(content, r"\A\s*#{1,6}\s+[^\n]*\n*", ""), r"\A\s+|\s+\z", "")


def trimmed(parts: Column) -> Column:
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"\A\s+|\s+\z", "")), lambda p: p != "")


def rule_units(text: Column, budget: int = RULE_BUDGET) -> Column:
    """Units that start with a rule number; those over budget are cut again at numbers within the line."""
    units = trimmed(F.split(text, UNIT_START))
    return F.flatten(F.transform(units, lambda u: F.when(approx_tokens(u) > budget, trimmed(F.split(u, INLINE_RULE))).otherwise(F.array(u))))


def rule_title(unit: Column) -> Column:
    """`NNN. Title` of a unit that opens a family, else null."""
    line = F.split(unit, "\n")[0]
    number = F.regexp_extract(line, TITLE, 1)
    return F.when(number != "", F.concat(number, F.lit(". "), F.regexp_extract(line, TITLE, 2)))


def breadcrumb(u: Column) -> Column:
    """`Rule NNN: Title` of a unit that opens with a bare rule number, else null."""
    return F.when(
        u.rlike(r"^\d{3}\.\s"),
        F.concat(F.lit("Rule "), F.substring(u, 1, 3), F.coalesce(F.concat(F.lit(": "), F.trim(first_bold(u))), F.lit(""))),
    )


def in_force(own: Iterable[str | None]) -> list[str | None]:
    """At each place the last value at or before it."""
    found, last = [], None
    for value in own:
        last = last if value is None else value
        found.append(last)
    return found


def _per_row(fold: Callable, kind: str) -> Callable[..., Column]:
    """A loop over a row's arrays as a column; null where the first of them is null."""

    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if row[0] is None else fold(*row) for row in zip(*columns, strict=True)], dtype=object)

    def one(first: pd.Series) -> pd.Series:
        return run(first)

    def two(first: pd.Series, second: pd.Series) -> pd.Series:
        return run(first, second)

    return lambda *columns: F.pandas_udf(one if len(columns) == 1 else two, kind)(*columns)


def breadcrumbs(units: Column) -> Column:
    """For each unit the breadcrumb in force: of the last unit at or above it that has one; else null."""
    return _per_row(in_force, "array<string>")(F.transform(units, breadcrumb))


def packed_units(units: list[dict], header: str, budget: int, title_flush: bool) -> list[dict]:
    """The groups of one section's units (text, mark: its title or its breadcrumb)."""
    crumbs = [] if title_flush else in_force(u["mark"] for u in units)
    starts, labels, size, label = [], [], 0, header
    for at, unit in enumerate(units):
        title = unit["mark"] if title_flush else None
        grown = size + len(unit["text"]) + 1
        opens = size == 0 or title is not None or (grown + len(label) + 4) // 4 > budget  # `### label` and line ends
        if title is not None:
            label = title
        elif opens and not title_flush:
            label = header if crumbs[at] is None else f"{header} — {crumbs[at]}"
        if opens:
            starts.append(at)
            labels.append(label)
        size = len(unit["text"]) + 1 if opens else grown
    texts = [u["text"] for u in units]
    return [{"label": name, "content": "\n".join([f"### {name}", *texts[a:b]])} for name, a, b in zip(labels, starts, [*starts[1:], *([len(units)] if starts else [])], strict=True)]


def pack_rules(units: Column, header: Column, budget: int = RULE_BUDGET, title_flush: bool = True) -> Column:
    """Groups of units as array of (label, content): a unit that would break the budget opens a group; so does a title,
    which is the label from there on. Without `title_flush` the label is the header with the breadcrumb of the group's first unit."""
    marked = F.transform(units, lambda u: F.struct(u.alias("text"), (rule_title(u) if title_flush else breadcrumb(u)).alias("mark")))
    fold = lambda rows, name: packed_units(rows, name, budget, title_flush)
    return _per_row(fold, "array<struct<label:string,content:string>>")(marked, header)


def pack_paragraphs(paragraphs: Column, budget: int = BUDGET) -> Column:
    """Chunks of paragraphs up to the budget; each further chunk starts with the last paragraph of the one before."""
    kind = "struct<done:array<string>,held:array<string>,tokens:int>"
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("held"), F.lit(0).alias("tokens")).cast(kind)

    def step(state: Column, paragraph: Column) -> Column:
        size = approx_tokens(paragraph)
        full = (state["tokens"] + size > budget) & (F.size(state["held"]) > 0)
        last = F.slice(state["held"], -1, 1)
        return F.struct(
            F.when(full, F.concat(state["done"], F.array(F.array_join(state["held"], "\n\n")))).otherwise(state["done"]).alias("done"),
            F.concat(F.when(full, last).otherwise(state["held"]), F.array(paragraph)).alias("held"),
            (F.when(full, approx_tokens(F.try_element_at(last, F.lit(1)))).otherwise(state["tokens"]) + size).cast("int").alias("tokens"),
        ).cast(kind)

    def finish(state: Column) -> Column:
        return F.when(F.size(state["held"]) > 0, F.concat(state["done"], F.array(F.array_join(state["held"], "\n\n")))).otherwise(state["done"])

    return F.aggregate(paragraphs, empty, step, finish)


def chunks(docs: DataFrame, source_type: str, budget: int = BUDGET, rule_budget: int = RULE_BUDGET, title_flush: bool = True) -> DataFrame:
    """section, parent_section, content rows of Markdown documents.

    A heading alone gives nothing; a rulebook section with numbered rules is packed by rule; a
    section within the budget is one chunk; else its paragraphs (or, of one huge paragraph, its
    rules) are packed with overlap."""
    rows = sections(docs).withColumn("body", body(F.col("content"))).filter("body <> ''")
    numbered = F.lit(source_type == "rulebook") & F.col("body").rlike(r"(?m)^\d{3,}\.")
    paragraphs = trimmed(F.split("content", "\n\n"))
    pieces = F.when(F.size(paragraphs) <= 1, trimmed(F.split("content", INLINE_RULE))).otherwise(paragraphs)
    plain = F.when(approx_tokens(F.col("content")) <= budget, F.array("content")).otherwise(pack_paragraphs(pieces, budget))
    labelled = F.transform(plain, lambda c: F.struct(F.col("header").alias("label"), c.alias("content")))
    packed = F.when(~numbered, labelled)
    if source_type == "rulebook":
        packed = F.coalesce(packed, pack_rules(F.when(numbered, rule_units(F.col("body"), rule_budget)), F.col("header"), rule_budget, title_flush))
    parent = F.concat(F.lit("Level "), F.col("level"), F.lit(" — "), F.col("header"))
    out = rows.select(*docs.drop("text").columns, "ord", parent.alias("parent_section"), packed.alias("chunks"))
    out = out.select(*docs.drop("text").columns, "ord", "parent_section", F.posexplode("chunks").alias("part", "chunk"))
    return out.select(*docs.drop("text").columns, "ord", "part", F.col("chunk.label").alias("section"), "parent_section", F.col("chunk.content").alias("content"))
