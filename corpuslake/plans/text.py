"""Line cleaning, segmenting, references, calendars, usage records and model ports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslake.functions import text as X
from corpuslake.functions import vectors as V
from corpuslake.operators import answers, fusion, lookup, ports
from corpuslake.plans.context import WORDS
from corpuslake.session import fresh_folder
from corpuslake.sources.tables import table


def sanitize_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Generated context lines made fit for use, of all documents: short ones none, long ones cut, each with its prefix."""
    raw = F.concat(F.lit("```md\n\"Context: rule 702.1.a "), "text", F.lit("\"\n```"))
    rows = table(spark, sf, "documents").select("doc_id", X.context_line(F.when(F.col("doc_id") % 10 == 0, F.substring("text", 1, 8)).otherwise(raw)).alias("line"))
    return rows.select("doc_id", F.md5("line").alias("line_md5"), F.length("line").cast("long").alias("chars"))


def strip_fences(spark: SparkSession, sf: str) -> DataFrame:
    """Code fences dropped, line ends made one kind, three or more breaks made two."""
    raw = F.concat(F.lit("```md\r\n"), F.regexp_replace("text", "\n", "\r\n\n\n\n"), F.lit("\r\n```\n"))
    plain = F.regexp_replace(F.regexp_replace(X.newlines(raw), r"(?m)^```.*\n?", ""), r"\n{3,}", "\n\n")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(F.regexp_replace(plain, r"\A\s+|\s+\z", "")).alias("md5"))


def segment_keywords(spark: SparkSession, sf: str) -> DataFrame:
    """Texts cut into plain and keyword segments; in order they give the text again (`whole`)."""
    mark = r"(?i)(?<![\p{L}\p{N}])(" + "|".join(WORDS) + r")(?![\p{L}\p{N}])"
    cut = F.split(F.regexp_replace("text", mark, "\u0001$1\u0001"), "\u0001")
    rows = table(spark, sf, "documents").select("doc_id", "text", cut.alias("pieces")).withColumn("whole", F.array_join("pieces", "") == F.col("text"))
    rows = rows.select("doc_id", "whole", F.posexplode("pieces").alias("pos", "segment")).filter("segment <> ''")
    return rows.select("doc_id", "pos", F.md5("segment").alias("segment"), (F.col("pos") % 2 == 1).alias("is_keyword"), "whole")


def segment_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """:rb_x: tokens of a text with what they mean; unknown ones are plain text."""
    known = F.create_map(*[F.lit(x) for x in ("energy_1", "cost", "might", "stat", "exhaust", "action")])
    text = F.concat(F.lit("pay :rb_energy_1: then :rb_"), F.element_at(F.array(F.lit("might"), F.lit("exhaust"), F.lit("zzz")), (F.col("p_partkey") % 3 + 1).cast("int")), F.lit(": for "), F.col("p_name"))
    rows = table(spark, sf, "part").select("p_partkey", F.posexplode(F.regexp_extract_all(text, F.lit(r":rb_(\w+):"), F.lit(1))).alias("pos", "token"))
    return rows.select("p_partkey", "pos", "token", F.coalesce(F.try_element_at(known, F.col("token")), F.lit("text")).alias("kind"))


def tag_token_join(spark: SparkSession, sf: str) -> DataFrame:
    """#terms are keywords; @names are parts, by name, slug or beginning; what is neither stays plain text."""
    marks = F.concat(F.lit("see #the or #zzz and @"), F.regexp_replace("p_name", " ", "-"), F.lit(" not @nobody, @"), F.substring("p_name", 1, 4))
    rows = table(spark, sf, "part").select("p_partkey", F.explode(F.regexp_extract_all(marks, F.lit(r"([#@][\w-]+)"), F.lit(1))).alias("mark"))
    words = spark.createDataFrame([(f"#{w}", w) for w in WORDS], "mark string, keyword string")
    index = table(spark, sf, "part").groupBy(F.lower("p_name").alias("name")).agg(F.min("p_partkey").alias("pos"))
    asked = rows.select("mark").distinct().filter(F.col("mark").startswith("@")).select(F.substring("mark", 2, 1000).alias("asked"))
    names = lookup.cascade(asked, index).select(F.concat(F.lit("@"), "asked").alias("mark"), "found")
    found = rows.join(F.broadcast(words), "mark", "left").join(names, "mark", "left")
    return found.select("p_partkey", "mark", F.coalesce("keyword", "found", F.lit("text")).alias("target"))


def rule_reference_links(spark: SparkSession, sf: str) -> DataFrame:
    """References in text with the page their number falls on: the greatest chapter start at or below it."""
    text = F.concat(F.lit("see "), (F.col("p_size") * 37 + 100).cast("string"), F.lit(".2.a or 105.1"))
    refs = table(spark, sf, "part").select("p_partkey", F.explode(F.regexp_extract_all(text, F.lit(r"(\b\d{3,}\.\d[\d.a-z]*)"), F.lit(1))).alias("ref"))
    number = F.split("ref", "[.]")[0].cast("int")
    pages = F.lit("front")
    for start, page in ((200, "turns"), (500, "combat"), (900, "keywords"), (1500, "modes")):
        pages = F.when(number >= start, page).otherwise(pages)
    return refs.select("p_partkey", "ref", pages.alias("page"))


def utc_calendar(spark: SparkSession, sf: str) -> DataFrame:
    """Day, next midnight and whole seconds to it (one at least); and back-off delays, with a jitter that is the same for an id each time."""
    events = table(spark, sf, "events")
    ts = F.col("ts").cast("timestamp")
    reset = F.date_trunc("DAY", ts) + F.expr("INTERVAL 1 DAY")
    left = F.greatest(F.lit(1), F.floor((F.unix_micros(reset) - F.unix_micros(ts)) / 1_000_000))
    jitter = F.conv(F.substring(F.md5(F.col("event_id").cast("string")), 1, 4), 16, 10).cast("double") / 65536 * 0.25
    delay = F.round(F.least(F.lit(0.5) * F.pow(F.lit(2.0), F.col("user_id") % 6), F.lit(4.0)) + jitter, 6)
    return events.select("event_id", F.date_format(ts, "yyyyMMdd").alias("day"), left.cast("long").alias("seconds"), delay.alias("delay"))


def usage_normalise(spark: SparkSession, sf: str) -> DataFrame:
    """Usage records of providers: the total falls back to the sum, the output to what the total leaves; none without a total."""
    rows = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 3 > 0, F.col("user_id")).alias("prompt"), F.when(F.col("event_id") % 4 > 0, F.floor("value").cast("long")).alias("output"), F.when(F.col("event_id") % 5 > 1, F.floor(F.col("value") * 3).cast("long")).alias("total"))
    total = F.coalesce("total", F.coalesce("prompt", F.lit(0)) + F.coalesce("output", F.lit(0)))
    output = F.greatest(F.coalesce("output", total - F.coalesce("prompt", F.lit(0))), F.lit(0))
    return rows.select("event_id", total.alias("total_tokens"), output.alias("output_tokens")).filter("total_tokens > 0")


def id_list_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a list of ids, in the list's order; unknown ids are ignored."""
    wanted = spark.createDataFrame([(i, (i * 37) % 1200) for i in range(40)], "ord int, doc_id long")
    return table(spark, sf, "documents").join(F.broadcast(wanted), "doc_id").select("ord", "doc_id", X.preview("text", 30).alias("head"))


def confidence_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Bands of confidences, and how many fell by more than 0.2."""
    rows = table(spark, sf, "part").select((F.col("p_size") / 50).alias("before"), ((F.col("p_size") * 7) % 50 / 50).alias("after"))
    rows = rows.withColumn("band", X.confidence_band(F.when(F.col("after") > 0, F.col("after"))))
    return rows.groupBy(F.coalesce("band", F.lit("none")).alias("band")).agg(F.count("*").alias("n"), F.count_if(F.round(F.col("before") - F.col("after"), 6) > 0.2).alias("review"))


def heading_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Heading levels by the ratio of a span's size to the body's."""
    ratio = F.round(F.col("p_size") / 20.0, 1)
    level = F.when(ratio > 2.0, "h1").when(ratio > 1.4, "h2").when(ratio > 1.2, "h3").otherwise("body")
    return table(spark, sf, "part").groupBy(level.alias("level")).agg(F.count("*").alias("spans"))


def dry_run(spark: SparkSession, sf: str) -> DataFrame:
    """What an ingest would write: rows by source, without writing any; and the first three of each as a preview."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")
    order = Window.partitionBy("source").orderBy("doc_id")
    head = docs.select("source", "doc_id", F.row_number().over(order).alias("n")).filter("n <= 3").groupBy("source").agg(F.array_join(F.array_sort(F.collect_list("doc_id")), ",").alias("head"))
    counts = docs.groupBy("source").agg(F.count("*").alias("chunks"), F.min("doc_id").alias("first"), F.sum(X.floor_tokens("text")).alias("tokens"))
    return counts.join(head, "source")


def usage_estimate(spark: SparkSession, sf: str) -> DataFrame:
    """Usage of answers without counts of their own, guessed from the lengths of prompt and output."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", X.estimated_usage(F.col("text"), X.preview("text", 37)).alias("u"))
    return rows.select("conv_id", "turn", "u.prompt_tokens", "u.output_tokens", "u.total_tokens", "u.estimated")


def generated_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers of the generator's port over contexts, cleaned; and whether they are empty."""
    docs = table(spark, sf, "documents").select("doc_id", ports.generate(F.lit("what?"), F.when(F.col("doc_id") % 6 > 0, F.col("text")).otherwise("")).alias("answer"))
    return docs.select("doc_id", answers.is_empty(F.col("answer")).alias("empty"), F.md5(answers.cleaned(F.col("answer"))).alias("answer"))


def hyde_memo(spark: SparkSession, sf: str) -> DataFrame:
    """Passages made once for each distinct question and kept, so that all arms of an experiment read the same ones."""
    asked = table(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", "text")
    memo = ports.memo(asked.select(F.col("text").alias("question")), ports.hypothetical(F.col("question")), fresh_folder(spark, "memo"))
    arms = [asked.join(memo, F.col("text") == F.col("question")).select("conv_id", "turn", F.lit(arm).alias("arm"), F.md5("passage").alias("passage")) for arm in ("a", "b")]
    return arms[0].unionByName(arms[1])


def _stood_in(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Documents and questions with their embeddings, which a model makes once: documents' are written, and read by every arm."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text", ports.embed("text").alias("embedding"))
    path = fresh_folder(spark, "embedded")
    docs.write.parquet(path)
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), ports.embed("text").alias("embedding"))
    return spark.read.schema(docs.schema).parquet(path), asked


def hyde_fuse(spark: SparkSession, sf: str) -> DataFrame:
    """The question's arm fused with that of a generated passage; without a passage the question stands alone."""
    docs, asked = _stood_in(spark, sf)
    kinds = docs.select("chunk_id", F.lit("rulebook").alias("source_type"))
    raw = V.nearest(docs, asked, 15).select("query_id", "chunk_id", "rank").join(kinds, "chunk_id")
    passages = asked.withColumn("passage", ports.hypothetical(F.col("question"))).filter("passage <> ''").select("query_id", ports.embed("passage").alias("embedding"))
    second = V.nearest(docs, passages, 15).select("query_id", "chunk_id", "rank").join(kinds, "chunk_id")
    return fusion.fuse(raw, second, 5)


def rerank_stub(spark: SparkSession, sf: str) -> DataFrame:
    """The semantic pool re-ordered by the reranker's port, then cut."""
    docs, asked = _stood_in(spark, sf)
    pool = V.nearest(docs, asked, 15).join(docs.select("chunk_id", "text"), "chunk_id").join(asked.select("query_id", "question"), "query_id")
    ranked = fusion.rerank(pool, ports.relevance("question", "text"), 5)
    return ranked.select("query_id", "chunk_id", "new_rank")


QUERIES = {
    f.__name__: f
    for f in (
        sanitize_lines, strip_fences, segment_keywords, segment_tokens, tag_token_join, rule_reference_links, utc_calendar, usage_normalise,
        id_list_filter, confidence_bands, heading_levels, dry_run, usage_estimate, generated_answers, hyde_memo, hyde_fuse, rerank_stub,
    )
}

SQL_LETTERS = "list_transform([" + ", ".join(f"'{x}'" for x in ports.LETTERS) + "], lambda x: CAST(length(lower({0})) - length(replace(lower({0}), x, '')) AS DOUBLE))"
SQL_PORTS = f"""e AS (SELECT doc_id AS chunk_id, text, {SQL_LETTERS.format("text")} AS e FROM documents),
  q AS (SELECT item_id AS query_id, text AS question, {SQL_LETTERS.format("text")} AS e FROM benchmark),
  h AS (SELECT query_id, {SQL_LETTERS.format("substr(question, length(question) // 2 + 1)")} AS e FROM q WHERE length(question) % 2 = 0),
  first AS (SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank FROM (
    SELECT query_id, chunk_id, coalesce(round(nullif(list_cosine_similarity(q.e, e.e), 'nan'), 9), 0) AS s FROM q, e)) WHERE rank <= 15),
  second AS (SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank FROM (
    SELECT query_id, chunk_id, coalesce(round(nullif(list_cosine_similarity(h.e, e.e), 'nan'), 9), 0) AS s FROM h, e)) WHERE rank <= 15)"""

ORACLE = {
    "hyde_fuse": f"""WITH {SQL_PORTS}, s AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(arm) AS arm, min(CASE WHEN arm = 0 THEN rank END) AS r0, min(CASE WHEN arm = 1 THEN rank END) AS r1
        FROM (SELECT *, 0 AS arm FROM first UNION ALL SELECT *, 1 FROM second) GROUP BY 1, 2)
      SELECT query_id, chunk_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s.score DESC, arm, r0 NULLS LAST, r1 NULLS LAST, chunk_id) AS INTEGER) AS rank FROM s) WHERE rank <= 5""",
    "rerank_stub": rf"""WITH {SQL_PORTS}, w AS (SELECT query_id, chunk_id, rank, list_distinct(regexp_extract_all(lower(question), '[\p{{L}}\p{{N}}]+')) AS qt, list_distinct(regexp_extract_all(lower(e.text), '[\p{{L}}\p{{N}}]+')) AS dt FROM first JOIN q USING (query_id) JOIN e USING (chunk_id))
      SELECT query_id, chunk_id, new_rank FROM (SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY len(list_intersect(qt, dt))::DOUBLE / len(qt) DESC, rank) AS INTEGER) AS new_rank FROM w) WHERE new_rank <= 5""",
    "sanitize_lines": r"""
      WITH r AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN left(text, 8) ELSE 'Context: rule 702.1.a ' || text END AS t FROM documents),
      q AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN regexp_replace(t, '^\s+|\s+$', '', 'g') ELSE t END AS t FROM r),
      c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(t, '\b\d{3}(?:\.(?:\d+|[a-z]))*\b', '', 'g'), '\s+', ' ', 'g'), ' .') AS t FROM q),
      b AS (SELECT doc_id, CASE WHEN starts_with(t, 'Context:') THEN trim(substr(t, 9), ' :') ELSE t END AS t FROM c),
      l AS (SELECT doc_id, CASE WHEN length(t) >= 10 THEN 'Context: ' || t END AS l FROM b),
      s AS (SELECT doc_id, left(CASE WHEN NOT regexp_matches(l, '[.?!]$') AND length(l) < 300 THEN l || '.' ELSE l END, 300) AS l FROM l)
      SELECT doc_id, md5(l) AS line_md5, length(l) AS chars FROM s""",
    "strip_fences": r"""SELECT conv_id, turn, md5(regexp_replace(regexp_replace(replace(text, chr(10), chr(10) || chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '\A\s+|\s+\z', '', 'g')) AS md5 FROM conversations""",
    "segment_tokens": """WITH t AS (SELECT p_partkey, 0 AS pos, 'energy_1' AS token FROM part UNION ALL SELECT p_partkey, 1, ['might', 'exhaust', 'zzz'][p_partkey % 3 + 1] FROM part)
      SELECT p_partkey, pos, token, CASE token WHEN 'energy_1' THEN 'cost' WHEN 'might' THEN 'stat' WHEN 'exhaust' THEN 'action' ELSE 'text' END AS kind FROM t""",
    "tag_token_join": """WITH i AS (SELECT lower(p_name) AS name, min(p_partkey) AS pos FROM part GROUP BY 1), p AS (SELECT * FROM part),
      a AS (SELECT DISTINCT regexp_extract(left(p_name, 4), '^[A-Za-z0-9_-]+') AS q FROM part), h AS (SELECT q, arg_min(name, CASE WHEN name = q THEN -1 ELSE pos END) AS hit FROM a JOIN i ON starts_with(name, q) GROUP BY 1)
      SELECT p_partkey, '#the' AS mark, 'the' AS target FROM p UNION ALL SELECT p_partkey, '#zzz', 'text' FROM p UNION ALL SELECT p_partkey, '@nobody', 'text' FROM p
      UNION ALL SELECT p_partkey, '@' || replace(p_name, ' ', '-'), lower(p_name) FROM p
      UNION ALL SELECT p_partkey, '@' || q, hit FROM p JOIN h ON q = regexp_extract(left(p_name, 4), '^[A-Za-z0-9_-]+')""",
    "rule_reference_links": """WITH r AS (SELECT p_partkey, p_size * 37 + 100 AS n, '.2.a' AS s FROM part UNION ALL SELECT p_partkey, 105, '.1' FROM part)
      SELECT p_partkey, n || s AS ref, CASE WHEN n >= 1500 THEN 'modes' WHEN n >= 900 THEN 'keywords' WHEN n >= 500 THEN 'combat' WHEN n >= 200 THEN 'turns' ELSE 'front' END AS page FROM r""",
    "utc_calendar": """SELECT event_id, strftime(ts, '%Y%m%d') AS day, greatest(1, (epoch_us(date_trunc('day', ts) + INTERVAL 1 DAY) - epoch_us(ts)) // 1000000) AS seconds,
      round(least(0.5 * pow(2.0, user_id % 6), 4.0) + CAST('0x' || md5(CAST(event_id AS VARCHAR))[1:4] AS INTEGER)::DOUBLE / 65536 * 0.25, 6) AS delay FROM events""",
    "usage_normalise": """WITH r AS (SELECT event_id, CASE WHEN event_id % 3 > 0 THEN user_id END AS p, CASE WHEN event_id % 4 > 0 THEN CAST(floor(value) AS BIGINT) END AS o, CASE WHEN event_id % 5 > 1 THEN CAST(floor(value * 3) AS BIGINT) END AS t FROM events),
      n AS (SELECT event_id, p, o, coalesce(t, coalesce(p, 0) + coalesce(o, 0)) AS total FROM r)
      SELECT event_id, total AS total_tokens, greatest(coalesce(o, total - coalesce(p, 0)), 0) AS output_tokens FROM n WHERE total > 0""",
    "id_list_filter": "SELECT CAST(i AS INTEGER) AS ord, doc_id, left(text, 30) AS head FROM range(40) r(i) JOIN documents ON doc_id = (i * 37) % 1200",
    "confidence_bands": """WITH r AS (SELECT p_size / 50.0 AS b, (p_size * 7) % 50 / 50.0 AS a FROM part)
      SELECT CASE WHEN a = 0 THEN 'none' WHEN a >= 0.75 THEN 'high' WHEN a >= 0.55 THEN 'medium' ELSE 'low' END AS band, count(*) AS n, count(*) FILTER (round(b - a, 6) > 0.2) AS review FROM r GROUP BY 1""",
    "heading_levels": """WITH r AS (SELECT round(p_size / 20.0, 1) AS r FROM part)
      SELECT CASE WHEN r > 2.0 THEN 'h1' WHEN r > 1.4 THEN 'h2' WHEN r > 1.2 THEN 'h3' ELSE 'body' END AS level, count(*) AS spans FROM r GROUP BY 1""",
    "dry_run": """WITH d AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
      SELECT source, count(*) AS chunks, min(doc_id) AS first, CAST(sum(length(text) // 4) AS BIGINT) AS tokens, string_agg(doc_id, ',' ORDER BY doc_id) FILTER (n <= 3) AS head FROM d GROUP BY 1""",
    "usage_estimate": """SELECT conv_id, turn, CAST(ceil(length(text) / 4) AS BIGINT) AS prompt_tokens, CAST(ceil(length(left(text, 37)) / 4) AS BIGINT) AS output_tokens,
      CAST(ceil(length(text) / 4) + ceil(length(left(text, 37)) / 4) AS BIGINT) AS total_tokens, true AS estimated FROM conversations""",
    "generated_answers": r"""WITH s AS (SELECT doc_id, CASE WHEN doc_id % 6 > 0 THEN regexp_extract(text, '^([^.!?]*[.!?]?)', 1) ELSE '' END AS s FROM documents),
      a AS (SELECT doc_id, CASE WHEN length(trim(s)) > 0 THEN 'Answer: ' || s || ' [#1]' ELSE 'Answer: ' END AS a FROM s)
      SELECT doc_id, regexp_replace(substr(a, 8), '[\s*_#>`~-]+|\[#?\d+\]', '', 'g') = '' AS empty, md5(regexp_replace(regexp_replace(a, '\s*\[#?\d+(?:\s*,\s*#?\d+)*\]', '', 'g'), '\s+([.,;:!?])', '\1', 'g')) AS answer FROM a""",
    "hyde_memo": """WITH p AS (SELECT conv_id, turn, md5(CASE WHEN length(text) % 2 = 0 THEN substr(text, length(text) // 2 + 1) ELSE '' END) AS passage FROM conversations WHERE role = 'user')
      SELECT conv_id, turn, 'a' AS arm, passage FROM p UNION ALL SELECT conv_id, turn, 'b', passage FROM p""",
    "segment_keywords": rf"""WITH k AS (SELECT doc_id, text, regexp_replace(' ' || replace(text, ' ', '  ') || ' ', '(?i)([^\p{{L}}\p{{N}}])({"|".join(WORDS)})([^\p{{L}}\p{{N}}])', '\1' || chr(1) || '\2' || chr(1) || '\3', 'g') AS t FROM documents),
      n AS (SELECT doc_id, text, string_split(replace(substr(regexp_replace(t, '(?i)([^\p{{L}}\p{{N}}\x01])({"|".join(WORDS)})([^\p{{L}}\p{{N}}\x01])', '\1' || chr(1) || '\2' || chr(1) || '\3', 'g'), 2), '  ', ' '), chr(1)) AS p FROM k),
      m AS (SELECT doc_id, text, list_transform(p, lambda x, i: CASE WHEN i = len(p) THEN left(x, greatest(length(x) - 1, 0)) ELSE x END) AS p FROM n),
      u AS (SELECT doc_id, text = array_to_string(p, '') AS whole, unnest(p) AS segment, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS pos FROM m)
      SELECT doc_id, pos, md5(segment) AS segment, pos % 2 = 1 AS is_keyword, whole FROM u WHERE segment <> ''""",
}
