"""Queries of line-structured sources: each document's lines, with the marks of a format put between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.operators import chunking, markup, parsing
from corpuslake.plans.retrieval import _printings
from corpuslake.sources.tables import table

SETS = ("origins", "spiritforged", "unleashed")


def _lines(spark: SparkSession, sf: str, mark: str) -> DataFrame:
    """Lines of all documents, changed by an expression of doc_id, pos and line."""
    rows = parsing.lines_of(table(spark, sf, "documents"))
    return rows.select("doc_id", "pos", F.expr(mark).alias("line"))


#: Both engines read these expressions.
ERRATA = """CASE pos % 8 WHEN 0 THEN CASE (doc_id + pos) % 3 WHEN 0 THEN '# Unleashed Card Errata' WHEN 1 THEN '# Origins cards' ELSE '# Overview' END
  WHEN 1 THEN concat('## ', left(line, 20)) WHEN 2 THEN CASE WHEN (doc_id + pos) % 5 = 0 THEN '### Notes' ELSE '### New Text' END WHEN 3 THEN '```text'
  WHEN 5 THEN CASE WHEN doc_id % 3 = 0 THEN '### New text again' ELSE '### Old Text' END WHEN 7 THEN '' ELSE line END"""
CHAPTERS = "CASE WHEN pos % 4 = 0 THEN concat(CAST(795 + (doc_id * 7 + pos) % 45 AS STRING), '. ', left(line, 12)) WHEN pos % 11 = 5 THEN concat('805.1. ', line) ELSE line END"
HEADINGS = """CASE pos % 5 WHEN 0 THEN CASE WHEN doc_id % 2 = 0 THEN concat('# ', CAST(100 + pos AS STRING), '.') ELSE concat('# ', left(line, 4)) END WHEN 1 THEN CASE WHEN doc_id % 3 = 0 THEN '' ELSE '# 7.' END
  WHEN 2 THEN CASE WHEN doc_id % 7 = 0 THEN concat('## ', left(line, 12)) ELSE concat('# ', left(line, 12)) END WHEN 3 THEN concat('### ', left(line, 3)) ELSE line END"""
ARTICLES = """CASE pos % 10 WHEN 0 THEN 'CARD GALLERY' WHEN 1 THEN 'Support' WHEN 2 THEN CASE WHEN doc_id % 9 = 0 THEN left(line, 8) ELSE concat('Corpus Update ', left(line, 10)) END WHEN 3 THEN 'Rules and Releases'
  WHEN 4 THEN '10/27/2025' WHEN 5 THEN '' WHEN 6 THEN left(line, 30) WHEN 7 THEN concat('NEW RULE: ', left(line, 20)) WHEN 8 THEN CASE WHEN doc_id % 2 = 0 THEN '' ELSE line END
  ELSE CASE WHEN doc_id % 4 = 0 THEN 'Related Articles' ELSE left(line, 40) END END"""
SPAN_SIZE = "CAST(CASE length(line) % 7 WHEN 0 THEN 21.0 WHEN 1 THEN 15.0 WHEN 2 THEN 12.5 ELSE 10.0 END AS DOUBLE)"
SPAN_TEXT = "CASE WHEN pos % 4 = 0 THEN concat(CAST(300 + pos AS STRING), '. ', line) ELSE line END"


def errata_parse(spark: SparkSession, sf: str) -> DataFrame:
    found = parsing.errata(_lines(spark, sf, ERRATA), SETS)
    return found.select("doc_id", "pos", "card", "set", F.md5("new_text").alias("new_text"), F.md5("old_text").alias("old_text"))


def keyword_collect(spark: SparkSession, sf: str) -> DataFrame:
    found = parsing.keyword_chapters(_lines(spark, sf, CHAPTERS), 805, 826)
    return found.select("doc_id", "number", "name", F.md5("content").alias("content"))


def merge_headings(spark: SparkSession, sf: str) -> DataFrame:
    return parsing.merged_headings(_lines(spark, sf, HEADINGS)).select("doc_id", "pos", F.md5("line").alias("line"))


def toc_ids(spark: SparkSession, sf: str) -> DataFrame:
    return parsing.contents(parsing.merged_headings(_lines(spark, sf, HEADINGS)))


def toc_group(spark: SparkSession, sf: str) -> DataFrame:
    """Entries under their first-level heading: how many, and of which text."""
    entries = parsing.grouped_contents(parsing.contents(_lines(spark, sf, HEADINGS)))
    return entries.groupBy("doc_id", "head").agg(F.count(F.lit(1)).alias("children"), F.min("id").alias("least"))


def patch_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Articles of a scraped page: its title, and the text with its headings."""
    marked = _lines(spark, sf, ARTICLES).groupBy("doc_id").agg(parsing.joined("pos", "line").alias("text"))
    found = parsing.articles(marked, "Corpus")
    return found.select("doc_id", "article", "title", F.md5("markdown").alias("markdown"))


def span_merge(spark: SparkSession, sf: str) -> DataFrame:
    spans = _lines(spark, sf, "line").filter("trim(line) <> ''").select("doc_id", "pos", F.expr(SPAN_TEXT).alias("text"), F.expr(SPAN_SIZE).alias("size"))
    return parsing.span_markdown(spans).select("doc_id", "pos", F.md5("line").alias("line"))


def clause_split(spark: SparkSession, sf: str) -> DataFrame:
    """Clauses of run-on lines: their number, its depth and the rest."""
    run_on = F.regexp_replace(F.regexp_replace("line", "([,;]) ", "$1 see rule 428. "), "([.]) ", "$1 133.4.a. as in Example: ")
    rows = _lines(spark, sf, "line").select("doc_id", "pos", F.posexplode(parsing.clauses(run_on)).alias("part", "clause"))
    rows = rows.withColumn("parsed", parsing.clause_number(F.col("clause")))
    return rows.select("doc_id", "pos", "part", F.col("parsed.num").alias("num"), F.col("parsed.depth").alias("depth"), F.md5(F.coalesce("parsed.rest", "clause")).alias("rest"))


def errata_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of marked texts of up to 500 records of a brand and size: name, new and old text."""
    part = table(spark, sf, "part")
    entry = F.concat(F.lit("\n"), "p_name", F.lit("\n[NEW TEXT] "), F.when(F.col("p_partkey") % 5 != 0, F.col("p_type")).otherwise(""), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("\n▲ "), F.col("p_partkey").cast("string"))).otherwise(F.concat(F.lit("\n[OLD TEXT] "), F.col("p_partkey").cast("string"), F.lit("\n"))))
    texts = part.groupBy("p_brand", "p_size", F.expr("p_partkey DIV 500")).agg(F.concat(F.lit("Intro."), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", entry.alias("e")))), lambda x: x["e"]), "")).alias("text"))
    rows = texts.select("p_brand", "p_size", F.explode(parsing.errata_entries(F.col("text"))).alias("e"))
    return rows.select("p_brand", "p_size", "e.name", "e.new_text", "e.old_text")


def _markdown(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as Markdown: every sixth line a heading, others numbered rules, some with a title."""
    return _lines(spark, sf, MARKDOWN).groupBy("doc_id").agg(parsing.joined("pos", "line").alias("text"))


MARKDOWN = """CASE WHEN pos % 6 = 0 THEN concat('## ', left(line, 24)) WHEN pos % 6 = 2 THEN concat(CAST(pos + 300 AS STRING), '. ', line)
  WHEN pos % 6 = 4 THEN concat(CAST(pos + 800 AS STRING), '. **', left(line, 9), '** ', line, ' ', CAST(pos + 801 AS STRING), '. ', left(line, 500)) ELSE concat(line, chr(10)) END"""


def md_sections(spark: SparkSession, sf: str) -> DataFrame:
    rows = chunking.sections(_markdown(spark, sf))
    return rows.select("doc_id", "ord", "level", "header", F.length("content").alias("chars"), (chunking.body(F.col("content")) == "").alias("header_only"))


def _packed(chunks: DataFrame) -> DataFrame:
    return chunks.select("doc_id", "ord", "part", "section", "parent_section", F.md5("content").alias("content"))


def chunk_pack_rules(spark: SparkSession, sf: str) -> DataFrame:
    return _packed(chunking.chunks(_markdown(spark, sf), "rulebook", rule_budget=60))


def chunk_pack_lineage(spark: SparkSession, sf: str) -> DataFrame:
    """Rules packed without regard to titles, under the breadcrumb of each chunk's first rule."""
    return _packed(chunking.chunks(_markdown(spark, sf), "rulebook", rule_budget=60, title_flush=False))


def chunk_pack_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("# "), F.col("source"), F.lit("\n\n"), F.regexp_replace("text", "\n", "\n\n")).alias("text"))
    return _packed(chunking.chunks(docs, "faq", 200))


def rule_units(spark: SparkSession, sf: str) -> DataFrame:
    """Units of a rulebook with the rule in force at each."""
    units = chunking.rule_units(F.col("text"), 60)
    rows = _markdown(spark, sf).select("doc_id", units.alias("units")).select("doc_id", F.posexplode(F.arrays_zip("units", chunking.breadcrumbs(F.col("units")).alias("crumbs"))).alias("pos", "u"))
    return rows.select("doc_id", "pos", F.length("u.units").alias("chars"), F.col("u.crumbs").alias("breadcrumb"), chunking.rule_title(F.col("u.units")).alias("title"))


def rule_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Sections by whether a rule number opens them; the names and first bold terms of rendered records."""
    from corpuslake.functions import text as X

    section = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.col("p_size") + 780, F.lit(". "), "p_name")).otherwise(F.col("p_name"))
    rows = _printings(spark, sf).join(table(spark, sf, "part").select("p_partkey", section.alias("section")), "p_partkey")
    return rows.select("p_partkey", X.rule_section("section").alias("is_rule"), X.card_name("content").alias("name"), X.first_bold("content").alias("bold"))


def html_to_md(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", markup.markdown("html").alias("markdown"))


def faq_split(spark: SparkSession, sf: str) -> DataFrame:
    """Question blocks of pages."""
    rows = table(spark, sf, "pages").select("page_id", F.posexplode(markup.blocks("html")).alias("ord", "block"))
    return rows.select("page_id", "ord", F.regexp_extract("block", r"\A(?:#{1,4} |\*\*)([^\n*]+)", 1).alias("title"), F.length("block").alias("chars"))


def _escaped(column: str) -> F.Column:
    return F.replace(F.replace(F.replace(column, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def html_to_md_turns(spark: SparkSession, sf: str) -> DataFrame:
    """A page of each turn, of known shape: heading, paragraph, list, table and quote, with what is to be left out; as Markdown."""
    turn, conv = F.col("turn").cast("string"), F.col("conv_id").cast("string")
    html = F.concat(
        F.lit("<html><head><title>no</title></head><body><nav>no</nav><h2>Turn "), turn, F.lit("</h2><p>"), _escaped("text"), F.lit("<script>no()</script></p><ul><li>one "), conv,
        F.lit("<li><b>two</b> &amp; <em>more</em></ul><table><tr><th>k<th>v<tr><td>"), turn, F.lit("<td>"), F.col("role"), F.lit("</table><blockquote><p>said<br>so</p></blockquote>"),
    )
    return table(spark, sf, "conversations").select("conv_id", "turn", markup.markdown(html).alias("m")).select("conv_id", "turn", F.md5("m").alias("markdown"), F.length("m").alias("chars"))


def faq_split_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Question blocks of a page of each turn, of known shape."""
    html = F.concat(F.lit("<p>intro<h2>Q "), F.col("turn").cast("string"), F.lit("</h2><div>"), _escaped("text"), F.lit("</div><p><b>bold</b></p><h2>Last</h2><ol><li>a<li>b</ol>"))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(markup.blocks(html)).alias("ord", "block"))
    return rows.select("conv_id", "turn", "ord", F.regexp_extract("block", r"\A(?:#{1,4} |\*\*)([^\n*]+)", 1).alias("title"), F.md5("block").alias("block"))


QUERIES = {
    f.__name__: f
    for f in (
        errata_parse, keyword_collect, merge_headings, toc_ids, toc_group, patch_sections, span_merge, clause_split, errata_entries,
        md_sections, chunk_pack_rules, chunk_pack_lineage, chunk_pack_paragraphs, rule_units, rule_sections, html_to_md, faq_split,
        html_to_md_turns, faq_split_turns,
    )
}


def _sql(mark: str) -> str:
    """l: lines of all documents, changed by the same expression."""
    line = mark.replace("STRING", "VARCHAR")
    return f"""d AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS pos FROM documents),
  l AS (SELECT doc_id, pos, {line} AS line FROM d)"""


BY = "OVER (PARTITION BY doc_id ORDER BY pos)"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def strip(x: str) -> str:
    return _STRIP.format(x)


SQL_MERGED = rf"""f AS (SELECT *, lead(line) {BY} AS nxt, regexp_extract(line, '^(#{{1,3}}) \d+\.$', 1) AS marks FROM l WHERE {strip("line")} <> ''),
  g AS (SELECT *, marks <> '' AND coalesce(starts_with(nxt, marks || ' ') AND length(nxt) > length(marks) + 1 AND NOT regexp_matches(trim(substr(nxt, length(marks) + 2)), '^\d+\.$'), false) AS takes FROM f),
  h AS (SELECT doc_id, pos, CASE WHEN takes THEN line || ' ' || substr(nxt, length(marks) + 2) ELSE line END AS line, takes, coalesce(lag(takes) {BY}, false) AS taken FROM g
    UNION ALL SELECT doc_id, pos, line, NULL, false FROM l WHERE {strip("line")} = ''),
  merged AS (SELECT doc_id, pos, line FROM (SELECT *, coalesce(last_value(takes IGNORE NULLS) {BY}, false) AND takes IS NULL AS inside FROM h) WHERE NOT taken AND NOT inside)"""


def _sql_contents(source: str) -> str:
    return rf"""e AS (SELECT doc_id, pos, length(regexp_extract(line, '^(#{{1,3}})\s', 1)) AS depth, {strip(r"regexp_extract(line, '^#{1,3}\s+(.+)', 1)")} AS text FROM {source} WHERE regexp_matches(line, '^#{{1,3}}\s+.')),
  s AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '[^A-Za-z0-9_\s-]', '', 'g'), '\s+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM e),
  toc AS (SELECT doc_id, pos, CAST(depth AS INTEGER) AS depth, text, CASE WHEN n > 0 THEN slug || '-' || n ELSE slug END AS id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, slug ORDER BY pos) - 1 AS n FROM s))"""


#: Sections of Markdown texts m(doc_id, text), and their bodies.
SQL_SECTIONS = rf"""x AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '(?m)^(#{{1,3}}\s+\S)', chr(1) || '\1', 'g'), chr(1)), lambda p: regexp_matches(p, '^#{{1,3}}\s+\S')) AS p FROM m),
  y AS (SELECT doc_id, unnest(p) AS part, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS ord FROM x),
  sections AS (SELECT doc_id, ord, CAST(length(regexp_extract(part, '^(#{{1,3}})', 1)) AS INTEGER) AS level, trim(regexp_extract(part, '^#{{1,3}}\s+(.+)', 1)) AS header, {strip("part")} AS content FROM y),
  bodies AS (SELECT *, {strip(r"regexp_replace(content, '^\s*#{1,6}\s+[^\n]*\n*', '')")} AS body, 'Level ' || level || ' — ' || header AS parent_section FROM sections)"""
SQL_MARKDOWN = f"{_sql(MARKDOWN)}, m AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM l GROUP BY 1)"


def _sql_units(text: str, budget: int) -> str:
    """A list of rule units of a text."""
    cut = lambda x, pattern: f"list_filter(list_transform(string_split(regexp_replace({x}, '{pattern}', chr(1) || '\\1', 'g'), chr(1)), lambda z: {strip('z')}), lambda z: z <> '')"
    return f"flatten(list_transform({cut(text, r'(?m)^(\d{3,}\.)')}, lambda u: CASE WHEN length(u) // 4 > {budget} THEN {cut('u', r'(\b\d{3,}\.\s)')} ELSE [u] END))"


SQL_PLAIN = "SELECT doc_id, ord, 0 AS part, header AS section, parent_section, content FROM bodies WHERE body <> '' AND NOT ({numbered}) AND length(content) // 4 <= {budget}"


def _sql_paragraphs(numbered: str, budget: int) -> str:
    """para: chunks of sections over the budget, by a walk over their paragraphs (i) that keeps the first of the open chunk (s) and its tokens (t)."""
    pieces = f"list_filter(list_transform(string_split(content, chr(10) || chr(10)), lambda z: {strip('z')}), lambda z: z <> '')"
    rules = rf"list_filter(list_transform(string_split(regexp_replace(content, '(\b\d{{3,}}\.\s)', chr(1) || '\1', 'g'), chr(1)), lambda z: {strip('z')}), lambda z: z <> '')"
    return f"""over AS (SELECT doc_id, ord, header, parent_section, CASE WHEN len({pieces}) <= 1 THEN {rules} ELSE {pieces} END AS p FROM bodies WHERE body <> '' AND NOT ({numbered}) AND length(content) // 4 > {budget}),
  walk AS (SELECT doc_id, ord, p, 1 AS i, 1 AS s, 0 AS part, length(p[1]) // 4 AS t, NULL::INTEGER AS done_from, NULL::INTEGER AS done_to FROM over
    UNION ALL SELECT doc_id, ord, p, i + 1, CASE WHEN full_ THEN i ELSE s END, CASE WHEN full_ THEN part + 1 ELSE part END, CASE WHEN full_ THEN length(p[i]) // 4 ELSE t END + length(p[i + 1]) // 4,
      CASE WHEN full_ THEN s END, CASE WHEN full_ THEN i END FROM (SELECT *, t + length(p[i + 1]) // 4 > {budget} AS full_ FROM walk WHERE i < len(p))),
  closed AS (SELECT doc_id, ord, part - 1 AS part, done_from AS a, done_to AS b, p FROM walk WHERE done_from IS NOT NULL UNION ALL SELECT doc_id, ord, part, s, i, p FROM walk WHERE i = len(p)),
  para AS (SELECT c.doc_id, c.ord, c.part, header AS section, parent_section, array_to_string(list_slice(c.p, a, b), chr(10) || chr(10)) AS content FROM closed c JOIN over o ON o.doc_id = c.doc_id AND o.ord = c.ord)"""


def _sql_rules(numbered: str, budget: int, title_flush: bool) -> str:
    """rules: groups of units, by a walk over the units (i) that keeps the first of the open group (s), its length (n) and its label."""
    title = r"CASE WHEN regexp_matches(string_split(x, chr(10))[1], '^(\d{3,})\.\s+\*\*(.+?)\*\*') THEN regexp_extract(string_split(x, chr(10))[1], '^(\d{3,})\.\s+\*\*(.+?)\*\*', 1) || '. ' || regexp_extract(string_split(x, chr(10))[1], '^(\d{3,})\.\s+\*\*(.+?)\*\*', 2) END"
    crumb = r"CASE WHEN regexp_matches(x, '^\d{3}\.\s') THEN 'Rule ' || left(x, 3) || coalesce(': ' || trim(nullif(regexp_extract(x, '\*\*([^*]+)\*\*', 1), '')), '') END"
    label = "coalesce(titles[i + 1], label)" if title_flush else "CASE WHEN opens THEN header || coalesce(' — ' || crumbs[i + 1], '') ELSE label END"
    first = "coalesce(titles[1], header)" if title_flush else "header || coalesce(' — ' || crumbs[1], '')"
    opens = f"(n + length(u[i + 1]) + 1 + length(label) + 4) // 4 > {budget}" + (" OR titles[i + 1] IS NOT NULL" if title_flush else "")
    return f"""numbered AS (SELECT doc_id, ord, header, parent_section, {_sql_units("body", budget)} AS u FROM bodies WHERE body <> '' AND {numbered}),
  marked AS (SELECT *, list_transform(u, lambda x: {title}) AS titles, list_transform(u, lambda x: {crumb}) AS own FROM numbered),
  crumbed AS (SELECT *, list_transform(own, lambda x, i: list_filter(list_slice(own, 1, i), lambda c: c IS NOT NULL)[-1]) AS crumbs FROM marked),
  fold AS (SELECT *, 1 AS i, 1 AS s, 0 AS part, length(u[1]) + 1 AS n, {first} AS label, NULL::INTEGER AS done_from, NULL::VARCHAR AS done_label FROM crumbed
    UNION ALL SELECT doc_id, ord, header, parent_section, u, titles, own, crumbs, i + 1, CASE WHEN opens THEN i + 1 ELSE s END, CASE WHEN opens THEN part + 1 ELSE part END, CASE WHEN opens THEN 0 ELSE n END + length(u[i + 1]) + 1,
      {label}, CASE WHEN opens THEN s END, CASE WHEN opens THEN label END FROM (SELECT *, {opens} AS opens FROM fold WHERE i < len(u))),
  groups_ AS (SELECT doc_id, ord, part - 1 AS part, done_from AS a, i - 1 AS b, done_label AS label, u, parent_section FROM fold WHERE done_from IS NOT NULL UNION ALL SELECT doc_id, ord, part, s, i, label, u, parent_section FROM fold WHERE i = len(u)),
  rules AS (SELECT doc_id, ord, part, label AS section, parent_section, '### ' || label || chr(10) || array_to_string(list_slice(u, a, b), chr(10)) AS content FROM groups_)"""


_NUMBERED = r"regexp_matches(body, '(?m)^\d{3,}\.')"
_CHUNK = "SELECT doc_id, ord, CAST(part AS INTEGER) AS part, section, parent_section, md5(content) AS content"


def _sql_rulebook(title_flush: bool) -> str:
    return f"""WITH RECURSIVE {SQL_MARKDOWN}, {SQL_SECTIONS}, {_sql_paragraphs(_NUMBERED, 512)}, {_sql_rules(_NUMBERED, 60, title_flush)}
      {_CHUNK} FROM rules UNION ALL {_CHUNK} FROM para UNION ALL {_CHUNK} FROM ({SQL_PLAIN.format(numbered=_NUMBERED, budget=512)})"""


#: A text as a page shows it: one space for several, none at the ends, no empty marks.
SQL_SHOWN = r"trim(regexp_replace(replace(regexp_replace(text, '\s+', ' ', 'g'), '****', ''), ' +', ' ', 'g'))"

ORACLE = {
    "errata_parse": rf"""WITH {_sql(ERRATA)}, t AS (SELECT *, {strip("line")} AS b FROM l),
      v AS (SELECT *, CASE WHEN starts_with(b, '### ') THEN 3 WHEN starts_with(b, '## ') THEN 2 WHEN starts_with(b, '# ') THEN 1 END AS level, {strip("regexp_replace(b, '^#+ ', '')")} AS title FROM t),
      c AS (SELECT *, coalesce(last_value(CASE WHEN level = 1 AND contains(lower(title), 'card') THEN CASE WHEN contains(lower(title), 'origins') THEN 'origins' WHEN contains(lower(title), 'unleashed') THEN 'unleashed' END END IGNORE NULLS) {BY}, 'core') AS "set",
        last_value(CASE WHEN level < 3 THEN pos END IGNORE NULLS) {BY} AS card_at, last_value(level IGNORE NULLS) {BY} AS part_level, last_value(CASE WHEN level IS NOT NULL THEN pos END IGNORE NULLS) {BY} AS part_at,
        last_value(CASE WHEN level IS NOT NULL THEN lower(title) END IGNORE NULLS) {BY} AS part_title FROM v),
      k AS (SELECT c.*, h.title AS card, CASE WHEN part_level = 3 AND starts_with(part_title, 'new text') THEN 'new' WHEN part_level = 3 AND starts_with(part_title, 'old text') THEN 'old' END AS kind
        FROM c JOIN v h ON h.doc_id = c.doc_id AND h.pos = c.card_at WHERE c.level IS NULL AND h.level = 2),
      p AS (SELECT doc_id, card_at AS pos, card, "set", kind, part_at, regexp_replace({strip("coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT regexp_matches(b, '^```[a-zA-Z]*\\s*$')), '')")}, '\n{{3,}}', chr(10) || chr(10), 'g') AS text FROM k WHERE kind IS NOT NULL GROUP BY ALL),
      o AS (SELECT doc_id, pos, card, "set", arg_max(text, part_at) FILTER (kind = 'new') AS n, arg_max(text, part_at) FILTER (kind = 'old') AS o FROM p GROUP BY ALL)
      SELECT doc_id, pos, card, "set", md5(n) AS new_text, md5(o) AS old_text FROM o WHERE n <> ''""".replace("\\\\s", "\\s"),
    "keyword_collect": rf"""WITH {_sql(CHAPTERS)}, h AS (SELECT *, last_value(CASE WHEN regexp_matches(line, '^\d{{3,}}\. ') THEN pos END IGNORE NULLS) {BY} AS start_ FROM l),
      c AS (SELECT doc_id, start_, arg_min(line, pos) AS title, string_agg(line, chr(10) ORDER BY pos) AS content FROM h WHERE start_ IS NOT NULL GROUP BY 1, 2),
      n AS (SELECT *, TRY_CAST(regexp_extract(title, '^(\d{{3}})\. .+$', 1) AS INTEGER) AS number FROM c)
      SELECT doc_id, number, {strip(r"regexp_extract(arg_max(title, start_), '^\d{3}\. (.+)$', 1)")} AS name, md5(arg_max(content, start_)) AS content FROM n WHERE number BETWEEN 805 AND 826 GROUP BY 1, 2""",
    "merge_headings": f"WITH {_sql(HEADINGS)}, {SQL_MERGED} SELECT doc_id, pos, md5(line) AS line FROM merged",
    "toc_ids": f"WITH {_sql(HEADINGS)}, {SQL_MERGED}, {_sql_contents('merged')} SELECT * FROM toc",
    "toc_group": f"""WITH {_sql(HEADINGS)}, {_sql_contents("l")}, g AS (SELECT *, last_value(CASE WHEN depth = 1 THEN pos END IGNORE NULLS) {BY} AS head FROM toc)
      SELECT doc_id, head, count(*) AS children, min(id) AS "least" FROM g WHERE head IS NOT NULL AND depth > 1 GROUP BY 1, 2""",
    "patch_sections": rf"""WITH {_sql(ARTICLES)}, n AS (SELECT *, sum(CASE WHEN line = 'CARD GALLERY' THEN 1 ELSE 0 END) {BY} - 1 AS article FROM l),
      a AS (SELECT *, {strip("line")} AS bare FROM (SELECT * FROM n UNION ALL SELECT doc_id, pos - 0.5, '', article - 1 FROM n WHERE line = 'CARD GALLERY' AND article > 0)),
      f AS (SELECT * FROM (SELECT *, bool_or(bare = 'Related Articles') OVER (PARTITION BY doc_id, article ORDER BY pos) AS footed FROM a) WHERE NOT footed AND bare NOT IN ('CARD GALLERY', 'NEWS', 'FIND A STORE', 'EVENTS', 'How to Play', 'Rules Hub', 'Support')),
      t AS (SELECT doc_id, article, min(pos) AS start_, arg_min(bare, pos) AS title FROM f WHERE starts_with(bare, 'Corpus') GROUP BY 1, 2),
      r AS (SELECT f.*, bool_or(NOT (bare = '' OR bare = 'Rules and Releases' OR regexp_matches(bare, '^\d{{1,2}}/\d{{1,2}}/\d{{4}}$'))) OVER (PARTITION BY doc_id, article ORDER BY pos) AS begun FROM f JOIN t USING (doc_id, article) WHERE pos > start_),
      b AS (SELECT *, coalesce(lag(bare) OVER (PARTITION BY doc_id, article ORDER BY pos), '') AS before FROM r WHERE begun),
      s AS (SELECT doc_id, article, string_agg(CASE WHEN bare = '' THEN '' WHEN before = '' AND NOT regexp_matches(bare, '^(NEW RULE:|NEW SYSTEM:|CLARIFIED:|REMOVAL:|EDIT:|NEW:|ADDED:)') AND length(bare) < 90 AND regexp_matches(bare, '^\p{{Lu}}')
        AND len(regexp_split_to_array(bare, '\s+')) <= 14 AND NOT ends_with(bare, '.') AND NOT regexp_matches(bare, '^\d{{1,2}}/\d{{1,2}}/\d{{4}}$') AND bare <> 'Rules and Releases' THEN '## ' || bare ELSE line END, chr(10) ORDER BY pos) AS body FROM b GROUP BY 1, 2)
      SELECT doc_id, CAST(article AS INTEGER) AS article, title, md5('# ' || title || chr(10) || chr(10) || coalesce(body, '')) AS markdown FROM t LEFT JOIN s USING (doc_id, article)""",
    "span_merge": f"""WITH {_sql("line")}, n AS (SELECT doc_id, pos, {SPAN_TEXT.replace("STRING", "VARCHAR")} AS text, {SPAN_SIZE} AS size FROM l WHERE trim(line) <> ''),
      m AS (SELECT doc_id, arg_min(size, r) AS body FROM (SELECT doc_id, size, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(pos)) AS r FROM n GROUP BY 1, 2) GROUP BY 1),
      k AS (SELECT n.*, CASE WHEN size / body > 2.0 THEN '# ' WHEN size / body > 1.4 THEN '## ' WHEN size / body > 1.2 THEN '### ' ELSE '' END AS marks FROM n JOIN m USING (doc_id)),
      o AS (SELECT *, CASE WHEN marks = '' AND coalesce(lag(marks) {BY}, 'x') = '' AND NOT regexp_matches(text, '^\\d{{3,}}\\.') THEN 0 ELSE 1 END AS opens FROM k),
      i AS (SELECT *, sum(opens) {BY} AS island FROM o)
      SELECT doc_id, min(pos) AS pos, md5(min(marks) || string_agg(text, ' ' ORDER BY pos)) AS line FROM i GROUP BY doc_id, island""".replace("\\\\", "\\"),
    "clause_split": rf"""WITH {_sql("line")}, r AS (SELECT doc_id, pos, regexp_replace(regexp_replace(line, '([,;]) ', '\1 see rule 428. ', 'g'), '([.]) ', '\1 133.4.a. as in Example: ', 'g') AS line FROM l),
      k AS (SELECT *, regexp_replace(regexp_replace(line, '(^|\s)(\d{{1,3}}(?:\.(?:\d+|[a-z]))*\.)(\s+)(\S)', '\1' || chr(1) || '\2\3\4', 'g'), '(?i)(rules?\s)' || chr(1), '\1', 'g') AS marked FROM r),
      c AS (SELECT doc_id, pos, CASE WHEN (contains(marked, chr(1)) OR regexp_matches(line, '\sExample:')) AND NOT regexp_matches(line, '^(?:#|\[//\])')
        THEN list_filter(list_transform(string_split(regexp_replace(marked, '(^|\s)(Example:)', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda z: {strip("z")}), lambda z: z <> '') ELSE [line] END AS p FROM k),
      u AS (SELECT doc_id, pos, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS part, unnest(p) AS clause FROM c),
      n AS (SELECT *, nullif(regexp_extract(clause, '^(\d{{1,3}}(?:\.(?:\d+|[a-z]))*)\.\s+', 1), '') AS num FROM u)
      SELECT doc_id, pos, part, num, CAST(len(string_split(num, '.')) AS INTEGER) AS depth, md5(CASE WHEN num IS NULL THEN clause ELSE regexp_replace(clause, '^(\d{{1,3}}(?:\.(?:\d+|[a-z]))*)\.\s+', '') END) AS rest FROM n""",
    "errata_entries": "SELECT p_brand, p_size, p_name AS name, p_type AS new_text, CAST(p_partkey AS VARCHAR) AS old_text FROM part WHERE p_partkey % 5 <> 0",
    "md_sections": f"WITH {SQL_MARKDOWN}, {SQL_SECTIONS} SELECT doc_id, ord, level, header, CAST(length(content) AS INTEGER) AS chars, body = '' AS header_only FROM bodies",
    "chunk_pack_rules": _sql_rulebook(True),
    "chunk_pack_lineage": _sql_rulebook(False),
    "chunk_pack_paragraphs": f"""WITH RECURSIVE m AS (SELECT doc_id, '# ' || source || chr(10) || chr(10) || replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents), {SQL_SECTIONS}, {_sql_paragraphs("false", 200)}
      {_CHUNK} FROM para UNION ALL {_CHUNK} FROM ({SQL_PLAIN.format(numbered="false", budget=200)})""",
    "rule_units": rf"""WITH {SQL_MARKDOWN}, n AS (SELECT doc_id, {_sql_units("text", 60)} AS u FROM m), x AS (SELECT doc_id, unnest(u) AS u, CAST(generate_subscripts(u, 1) - 1 AS INTEGER) AS pos FROM n)
      SELECT doc_id, pos, CAST(length(u) AS INTEGER) AS chars, last_value(CASE WHEN regexp_matches(u, '^\d{{3}}\.\s') THEN 'Rule ' || left(u, 3) || coalesce(': ' || trim(nullif(regexp_extract(u, '\*\*([^*]+)\*\*', 1), '')), '') END IGNORE NULLS) {BY} AS breadcrumb,
        CASE WHEN regexp_matches(u, '^(\d{{3,}})\.\s+\*\*(.+?)\*\*') THEN regexp_extract(u, '^(\d{{3,}})\.', 1) || '. ' || regexp_extract(u, '^(\d{{3,}})\.\s+\*\*(.+?)\*\*', 2) END AS title FROM x""",
    "rule_sections": """SELECT p_partkey, p_partkey % 3 = 0 AS is_rule, CASE WHEN p_partkey % 11 <> 0 THEN array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') END AS name, CASE WHEN p_partkey % 11 <> 0 THEN 'Name' END AS bold FROM part""",
    "html_to_md_turns": f"""WITH t AS (SELECT conv_id, turn, role, {SQL_SHOWN} AS t FROM conversations),
      m AS (SELECT conv_id, turn, '## Turn ' || turn || chr(10) || chr(10) || CASE WHEN t <> '' THEN t || chr(10) || chr(10) ELSE '' END || '- one ' || conv_id || chr(10) || '- **two** & *more*' || chr(10) || chr(10)
        || '| k | v |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || turn || ' | ' || role || ' |' || chr(10) || chr(10) || '> said' || chr(10) || '> so' AS m FROM t)
      SELECT conv_id, turn, md5(m) AS markdown, CAST(length(m) AS INTEGER) AS chars FROM m""",
    "faq_split_turns": f"""WITH t AS (SELECT conv_id, turn, {SQL_SHOWN} AS t FROM conversations),
      b AS (SELECT conv_id, turn, 0 AS ord, 'intro' AS b FROM t UNION ALL SELECT conv_id, turn, 1, '## Q ' || turn || chr(10) || chr(10) || CASE WHEN t <> '' THEN t || chr(10) || chr(10) ELSE '' END || '**bold**' FROM t
        UNION ALL SELECT conv_id, turn, 2, '## Last' || chr(10) || chr(10) || '1. a' || chr(10) || '1. b' FROM t)
      SELECT conv_id, turn, ord, CASE ord WHEN 0 THEN '' WHEN 1 THEN 'Q ' || turn ELSE 'Last' END AS title, md5(b) AS block FROM b""",
}
