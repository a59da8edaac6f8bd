"""Sources that are structured by their lines: errata, keyword chapters, headings, articles, spans, clauses.

Lines are rows of (doc_id, pos, line). What a line means is carried forward to the lines below it by
windows over one document; nothing here looks across documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed values of the formats.
FENCE = r"^```[a-zA-Z]*\s*$"
CHANGES = ("NEW RULE:", "NEW SYSTEM:", "CLARIFIED:", "REMOVAL:", "EDIT:", "NEW:", "ADDED:")
NAVIGATION = ("CARD GALLERY", "NEWS", "FIND A STORE", "EVENTS", "How to Play", "Rules Hub", "Support")
ARTICLE_START, FOOTER, LABEL = "CARD GALLERY", "Related Articles", "Rules and Releases"
DATE = r"^\d{1,2}/\d{1,2}/\d{4}$"
CLAUSE = r"(^|\s)(\d{1,3}(?:\.(?:\d+|[a-z]))*\.)(\s+)(?=\S)"


def lines_of(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split(text, "\n")).alias("pos", "line"))


def squeezed(column: Column) -> Column:
    return F.regexp_replace(column, r"^\s+|\s+$", "")


def running(*keys: str) -> Window:
    return Window.partitionBy("doc_id", *keys).orderBy("pos")


def carried(value: Column, *keys: str) -> Column:
    """The last value above or at a line."""
    return F.last(value, ignorenulls=True).over(running(*keys))


def joined(order: str, line: str) -> Column:
    """The lines of a group, in order, as one text."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(line)))), lambda x: x[line]), "\n")


def set_of_heading(heading: Column, sets: tuple[str, ...]) -> Column:
    """The set that a first-level heading over cards names, else null."""
    low = F.lower(heading)
    named = F.coalesce(*[F.when(low.contains(s), s) for s in sets])
    return F.when(low.contains("card"), named)


def errata(lines: DataFrame, sets: tuple[str, ...], default_set: str = "core") -> DataFrame:
    """doc_id, pos, card, set, new_text, old_text: cards that have a new text.

    A first-level heading may set the set; a second-level one opens a card; third-level ones open its new or
    old text, or neither. Of texts of one kind in a card the last that has a line counts."""
    trimmed = squeezed(F.col("line"))
    level = F.when(trimmed.startswith("### "), 3).when(trimmed.startswith("## "), 2).when(trimmed.startswith("# "), 1)
    rows = lines.withColumn("level", level).withColumn("title", squeezed(F.regexp_replace(trimmed, "^#+ ", "")))
    low = F.lower("title")
    kind = F.when(low.startswith("new text"), "new").when(low.startswith("old text"), "old").otherwise("none")
    rows = rows.withColumn("set", F.coalesce(carried(F.when(F.col("level") == 1, set_of_heading(F.col("title"), sets))), F.lit(default_set)))
    rows = rows.withColumn("opened", carried(F.when(F.col("level") < 3, F.struct("level", F.col("pos").alias("at"), F.col("title").alias("card")))))
    rows = rows.withColumn("part", carried(F.when(F.col("level").isNotNull(), F.struct(F.col("pos").alias("at"), F.when(F.col("level") == 3, kind).otherwise("none").alias("kind")))))
    body = rows.filter("level is null and opened.level = 2 and part.kind <> 'none'")
    plain = body.withColumn("kept", F.when(~trimmed.rlike(FENCE), F.col("line")))
    texts = plain.groupBy("doc_id", F.col("opened.at").alias("pos"), F.col("opened.card").alias("card"), "set", F.col("part.at").alias("at"), F.col("part.kind").alias("kind")).agg(
        joined("pos", "kept").alias("text")
    )
    texts = texts.withColumn("text", F.regexp_replace(squeezed(F.col("text")), r"\n{3,}", "\n\n"))
    last = [F.max_by("text", F.when(F.col("kind") == k, F.col("at"))).alias(f"{k}_text") for k in ("new", "old")]
    return texts.groupBy("doc_id", "pos", "card", "set").agg(*last).filter("new_text <> ''")


def keyword_chapters(lines: DataFrame, first: int, last: int) -> DataFrame:
    """doc_id, number, name, content: chapters `NNN. Name` with numbers first to last, each up to the next line that
    opens with a rule number. Of chapters of one number the last counts."""
    rows = lines.withColumn("head", F.when(F.col("line").rlike(r"^\d{3,}\. "), F.struct(F.col("pos").alias("at"), F.col("line").alias("title"))))
    rows = rows.withColumn("head", carried(F.col("head"))).filter("head is not null")
    number = F.regexp_extract("head.title", r"^(\d{3})\. .+$", 1).try_cast("int")
    rows = rows.withColumn("number", number).filter(F.col("number").between(first, last))
    chapters = rows.groupBy("doc_id", "number", F.col("head.at").alias("at"), F.col("head.title").alias("title")).agg(joined("pos", "line").alias("content"))
    best = chapters.groupBy("doc_id", "number").agg(F.max_by(F.struct("title", "content"), "at").alias("c"))
    return best.select("doc_id", "number", squeezed(F.regexp_extract("c.title", r"^\d{3}\. (.+)$", 1)).alias("name"), F.col("c.content").alias("content"))


def merged_headings(lines: DataFrame) -> DataFrame:
    """Lines in which a heading of a bare number has taken in the heading of the same level that follows it, past blank
    lines; these and the second heading are gone."""
    full = lines.filter(squeezed(F.col("line")) != "")
    hashes = lambda c: F.regexp_extract(c, r"^(#{1,3}) \d+\.$", 1)
    ahead = full.withColumn("next", F.lead("line").over(running())).withColumn("marks", hashes(F.col("line")))
    fits = F.col("next").startswith(F.concat("marks", F.lit(" "))) & (F.length("next") > F.length("marks") + 1)
    tail = F.substring(F.col("next"), F.length("marks") + 2, F.length("next"))
    takes = (F.col("marks") != "") & F.coalesce(fits & ~squeezed(tail).rlike(r"^\d+\.$"), F.lit(False))
    merged = ahead.withColumn("takes", takes).withColumn("taken", F.coalesce(F.lag("takes").over(running()), F.lit(False)))
    merged = merged.select("doc_id", "pos", F.when(F.col("takes"), F.concat("line", F.lit(" "), tail)).otherwise(F.col("line")).alias("line"), "takes", "taken")
    blank = lines.filter(squeezed(F.col("line")) == "").select("doc_id", "pos", "line", F.lit(None).cast("boolean").alias("takes"), F.lit(False).alias("taken"))
    every = merged.unionByName(blank).withColumn("inside", F.coalesce(carried(F.col("takes")), F.lit(False)) & F.col("takes").isNull())
    return every.filter("not taken and not inside").select("doc_id", "pos", "line")


def contents(lines: DataFrame) -> DataFrame:
    """doc_id, pos, depth, text, id: headings with their anchors; an anchor that occurs again is numbered."""
    heads = lines.filter(F.col("line").rlike(r"^#{1,3}\s+.")).select(
        "doc_id", "pos", F.length(F.regexp_extract("line", r"^(#{1,3})\s", 1)).alias("depth"), squeezed(F.regexp_extract("line", r"^#{1,3}\s+(.+)", 1)).alias("text")
    )
    heads = heads.withColumn("slug", anchor(F.col("text")))
    n = F.row_number().over(Window.partitionBy("doc_id", "slug").orderBy("pos")) - 1
    heads = heads.withColumn("n", n)
    return heads.select("doc_id", "pos", "depth", "text", F.when(F.col("n") > 0, F.concat_ws("-", "slug", F.col("n").cast("string"))).otherwise(F.col("slug")).alias("id"))


def anchor(heading: Column) -> Column:
    """Lower case, ASCII word signs only, white space and hyphens as one hyphen, none at the ends."""
    kept = F.regexp_replace(F.lower(heading), r"[^A-Za-z0-9_\s-]", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(kept, r"\s+", "-"), "-+", "-"), "^-|-$", "")


def grouped_contents(entries: DataFrame) -> DataFrame:
    """Entries under the last first-level entry above them (`head`, its pos); those above the first are dropped."""
    return entries.withColumn("head", carried(F.when(F.col("depth") == 1, F.col("pos")))).filter("head is not null and depth > 1")


def articles(docs: DataFrame, title_prefix: str) -> DataFrame:
    """doc_id, article, title, markdown: articles of a scraped page, cleaned.

    An article begins at the first navigation line. Navigation lines and all from the footer on go; the title is the
    first line that begins with the prefix; label, date and blank lines after it go too. Of the rest, short lines
    after a blank one that do not read as a sentence, a date or a change are headings."""
    parts = docs.select("doc_id", F.posexplode(F.split("text", f"(?={ARTICLE_START})")).alias("article", "part")).filter(squeezed(F.col("part")) != "")
    lines = parts.select("doc_id", "article", F.posexplode(F.split("part", "\n")).alias("pos", "line")).withColumn("bare", squeezed(F.col("line")))
    lines = lines.withColumn("footed", carried(F.when(F.col("bare") == FOOTER, F.lit(True)), "article"))
    lines = lines.filter(F.col("footed").isNull() & ~F.col("bare").isin(*NAVIGATION))
    lines = lines.withColumn("title", F.first(F.when(F.col("bare").startswith(title_prefix), F.struct("pos", "bare")), ignorenulls=True).over(Window.partitionBy("doc_id", "article").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    after = lines.filter("pos > title.pos")
    skipped = (F.col("bare") == "") | (F.col("bare") == LABEL) | F.col("bare").rlike(DATE)
    body = after.withColumn("begun", carried(F.when(~skipped, F.lit(True)), "article")).filter("begun")
    body = body.withColumn("before", F.coalesce(F.lag("bare").over(running("article")), F.lit("")))
    change = F.col("bare").rlike("^(?:" + "|".join(CHANGES) + ")")
    heading = (
        (F.col("bare") != "") & ~change & (F.col("before") == "") & (F.length("bare") < 90) & F.col("bare").rlike(r"^\p{Lu}")
        & (F.size(F.split("bare", r"\s+")) <= 14) & ~F.col("bare").endswith(".") & ~F.col("bare").rlike(DATE) & (F.col("bare") != LABEL)
    )
    shown = body.withColumn("shown", F.when(heading, F.concat(F.lit("## "), "bare")).when(F.col("bare") == "", "").otherwise(F.col("line")))
    texts = shown.groupBy("doc_id", "article").agg(joined("pos", "shown").alias("body"))
    titles = lines.filter("title is not null").groupBy("doc_id", "article").agg(F.first("title.bare").alias("title"))
    out = titles.join(texts, ["doc_id", "article"], "left")
    return out.select("doc_id", "article", "title", F.concat(F.lit("# "), "title", F.lit("\n\n"), F.coalesce("body", F.lit(""))).alias("markdown"))


def span_markdown(spans: DataFrame) -> DataFrame:
    """doc_id, pos, line: Markdown lines of spans (doc_id, pos, text, size).

    The body's size is the most common one of the document (of equal ones the first seen); larger spans are headings by
    their ratio to it. Body spans are merged, but for those that open with a rule number, which begin a line."""
    sizes = spans.groupBy("doc_id", "size").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    body = sizes.groupBy("doc_id").agg(F.max_by("size", F.struct("n", -F.col("first"))).alias("body"))
    ratio = F.col("size") / F.col("body")
    level = F.when(ratio > 2.0, "# ").when(ratio > 1.4, "## ").when(ratio > 1.2, "### ").otherwise("")
    rows = spans.join(body, "doc_id").withColumn("marks", level)
    before = F.lag("marks").over(running())
    opens = (F.col("marks") != "") | before.isNull() | (before != "") | F.col("text").rlike(r"^\d{3,}\.")
    rows = rows.withColumn("island", F.sum(opens.cast("int")).over(running()))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ")
    return rows.groupBy("doc_id", "island").agg(F.min("pos").alias("pos"), F.concat(F.first("marks"), texts).alias("line")).select("doc_id", "pos", "line")


def clauses(line: Column) -> Column:
    """The clauses of a run-on line: a break before rule numbers, unless the word rule or rules is before them, and before
    `Example:`. Headings, and lines without a break, stay as they are."""
    marked = F.regexp_replace(F.regexp_replace(line, CLAUSE, "$1\u0001$2$3"), "(?i)(rules?\\s)\u0001", "$1")
    broken = marked.contains("\u0001") | line.rlike(r"\sExample:")
    marked = F.regexp_replace(marked, r"(^|\s)(Example:)", "$1\u0001$2")
    pieces = F.filter(F.transform(F.split(marked, "\u0001"), squeezed), lambda p: p != "")
    return F.when(broken & ~line.rlike(r"^(?:#|\[//\])"), pieces).otherwise(F.array(line))


def clause_number(clause: Column) -> Column:
    """(num, depth, rest) of a clause that opens with a number; null without one."""
    pattern = r"^(\d{1,3}(?:\.(?:\d+|[a-z]))*)\.\s+"
    number = F.regexp_extract(clause, pattern, 1)
    return F.when(number != "", F.struct(number.alias("num"), F.size(F.split(number, "[.]")).alias("depth"), F.regexp_replace(clause, pattern, "").alias("rest")))


def errata_entries(text: Column) -> Column:
    """Entries (name, new_text, old_text) of a marked text: what precedes the first name goes, so do entries without a name or new text."""
    found = F.filter(F.split(text, r"\n(?=\S[^\n]*\n\[NEW TEXT\])"), lambda e: e.contains("[NEW TEXT]"))

    def entry(e: Column) -> Column:
        parts = F.transform(F.split(e, r"\[NEW TEXT\]|\[OLD TEXT\]|▲"), squeezed)
        name = F.element_at(F.split(parts[0], "\n"), -1)
        return F.when(F.size(parts) >= 3, F.struct(name.alias("name"), F.get(parts, F.lit(1)).alias("new_text"), F.get(parts, F.lit(2)).alias("old_text")))

    return F.filter(F.transform(found, entry), lambda e: (e["name"] != "") & (e["new_text"] != ""))
