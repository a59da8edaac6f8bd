"""Queries of sources and sinks: written under the shared folder, and read back."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpuslake.functions import text as X
from corpuslake.operators import lifecycle
from corpuslake.operators.observed import Observer
from corpuslake.plans.corpus import card_render
from corpuslake.plans.evaluation import SQL_RESULTS, _results
from corpuslake.plans.serving import SQL_METERED, _metered, _stream
from corpuslake.session import fresh_folder
from corpuslake.sources import paged, sinks, tables
from corpuslake.sources.tables import table
from corpuslake.streaming import ledger


def manifest_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Files of a manifest, one of them missing and two of one name in different folders: characters of each entry, in order."""
    base, docs = fresh_folder(spark, "manifest"), table(spark, sf, "documents")
    entries = [("a/one.md", "en", "rulebook"), ("a/two.md", "fr", "rules_faq"), ("a/none.md", None, "errata"), ("b/one.md", "es", "patch_notes")]
    for name, lang, _ in entries:
        if lang:
            docs.filter(F.col("lang") == lang).select("text").write.text(f"{base}/{name}")
    found = tables.manifest(spark, [(f"{base}/{name}", kind) for name, _, kind in entries])
    return found.groupBy("ord", "source_document", "source_type").agg(F.sum(F.length("text")).alias("chars"))


def section_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """Sections of files by name: of names that occur again the last."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), F.concat(F.lit("head\n## "), "source", F.lit("\nfirst\n## "), "lang", F.lit("/"), "source", F.lit("\n"), X.preview("text", 30)).alias("text"))
    return tables.section_texts(docs).select("name", F.md5("text").alias("text"))


def csv_restore(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors and texts exported as CSV and restored: arrays as JSON, line breaks and quotes in fields."""
    base = fresh_folder(spark, "csv")
    rows = table(spark, sf, "documents").join(table(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id").select("doc_id", F.concat(F.lit('say "'), "text", F.lit('", twice')).alias("text"), "embedding")
    sinks.csv(rows, base)
    back = tables.csv(spark, base, "doc_id long, text string, embedding string").withColumn("embedding", F.from_json("embedding", "array<float>"))
    return back.select("doc_id", F.md5("text").alias("text"), F.size("embedding").cast("long").alias("numbers"), F.round(F.element_at("embedding", -1).cast("double"), 6).alias("last"))


def json_results(spark: SparkSession, sf: str) -> DataFrame:
    """Results of an evaluation written as JSON under dated names; the latest is read, and its recall reported."""
    base, rows = fresh_folder(spark, "results"), _results(spark, sf)
    for day, part in (("20240102", rows), ("20240101", rows.limit(0)), ("20231231", rows.filter("hit"))):
        sinks.json(part, f"{base}/eval_results_{day}.json")
    latest = tables.latest_file(spark, f"{base}/eval_results_*.json")
    back = tables.state(spark, latest, "difficulty string, source string, verdict string, has_ref boolean, hit boolean")
    return back.groupBy("source").agg(F.count_if("has_ref").alias("evaluable"), F.count_if(F.col("has_ref") & F.col("hit")).alias("hits"), F.count("difficulty").alias("rated"))


def eval_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Questions of JSON files, bare lists or envelopes; of those with a reference, each reference."""
    base = fresh_folder(spark, "questions")
    item = F.struct(F.col("item_id").cast("string").alias("id"), X.preview("text", 40).alias("question"), F.when(F.col("item_id") % 4 > 0, F.concat(F.lit("702.1, "), (F.col("item_id") + 300).cast("string"), F.lit(" ,"))).alias("rule_reference"))
    groups = table(spark, sf, "benchmark").groupBy(F.expr("item_id DIV 10").alias("g")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    body = F.when(F.col("g") % 2 == 0, F.concat(F.lit('{"version": 1, "questions": '), F.to_json("items"), F.lit("}"))).otherwise(F.to_json("items"))
    groups.select(body.alias("value")).repartition(F.col("value")).write.option("lineSep", "\n").text(base)
    read = tables.items(spark.read.text(base), "value", T.StructType.fromDDL("id string, question string, rule_reference string"), ("questions",)).select("item.*")
    return read.filter("rule_reference is not null").select(F.col("id").cast("long").alias("item_id"), F.posexplode(X.references("rule_reference")).alias("pos", "ref"))


def version_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A corpus partitioned by version: one version replaced, one deleted, one re-labelled; a pruned scan of two of them."""
    base, docs = fresh_folder(spark, "versions"), table(spark, sf, "documents").select("doc_id", "source", F.length("text").alias("chars"))
    name = F.concat(F.lit("v"), (F.col("doc_id") % 4).cast("string"))
    sinks.version(docs.withColumn("corpus_version", name), base)
    sinks.version(docs.filter("doc_id % 8 = 1").withColumn("corpus_version", F.lit("v1")), base)
    sinks.delete_version(spark, base, "v2")
    sinks.version(lifecycle.relabelled(sinks.scan(spark, base, "v3"), "v3", "v4"), base)
    found = [sinks.scan(spark, base, v) for v in ("v1", "v2", "v4")]
    return found[0].unionByName(found[1]).unionByName(found[2]).select("doc_id", "source", "chars", F.col("corpus_version").cast("string").alias("corpus_version"))


def ledger_append(spark: SparkSession, sf: str) -> DataFrame:
    """A ledger of served responses, appended to twice: cached ones with no tokens; what the cache saved, per user."""
    base, rows = fresh_folder(spark, "ledger"), _metered(spark, sf).withColumn("cached", F.col("event_type") == "view")
    entries = rows.select("event_id", "user_id", "ts", "cached", F.when(F.col("cached"), 0).otherwise(F.col("tokens")).cast("long").alias("total_tokens"), F.when(F.col("cached"), F.col("tokens")).alias("saved"))
    for half in (0, 1):
        sinks.ledger(entries.filter(F.col("event_id") % 2 == half), base)
    back = spark.read.parquet(base)
    return back.groupBy("user_id").agg(F.count("*").alias("rows"), F.sum("total_tokens").alias("tokens"), F.count_if("cached").alias("cached"), F.sum("saved").alias("saved"))


def resume_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Costly rows made in batches: a run that stops at its quota, then one that takes up what is left. Each row is made once (`run`).
    A row's reply is its text in quotes, so that quotes of the text itself stay."""
    base, todo = fresh_folder(spark, "resume"), table(spark, sf, "documents").select("doc_id", "text")
    made = lambda run: lambda rows: rows.select("doc_id", X.context_line(F.concat(F.lit('"'), "text", F.lit('"'))).alias("line"), F.lit(run).alias("run"))
    sinks.resumable(todo, "doc_id", made("first"), base, 4, stop=lambda n: n == 2)
    back = sinks.resumable(todo, "doc_id", made("second"), base, 4)
    return back.groupBy("doc_id").agg(F.count(F.lit(1)).alias("times"), F.md5(F.max("line")).alias("line"))


def markdown_files(spark: SparkSession, sf: str) -> DataFrame:
    """Rendered records written as Markdown in a total order: lines read back, by kind."""
    base = fresh_folder(spark, "markdown")
    sinks.lines(card_render(spark, sf).filter("text <> ''").withColumn("text", F.concat("text", F.lit("\n\n---"))), "text", base, ["p_partkey"])
    back = spark.read.text(base)
    return back.groupBy(F.regexp_extract("value", r"^(?:\*\*(\w+)\*\*|(-+))", 0).alias("kind")).agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("value")).alias("chars"))


def code_module(spark: SparkSession, sf: str) -> DataFrame:
    """The name index as the source of a typed module, read back line by line."""
    base = fresh_folder(spark, "module")
    names = table(spark, sf, "part").groupBy(F.lower("p_name").alias("clean_name")).agg(F.min("p_brand").alias("set_label"))
    sinks.code_module(names, ["clean_name", "set_label"], "CARD_INDEX", base)
    back = spark.read.text(base)
    return back.select(F.col("value").alias("line"))


def section_map(spark: SparkSession, sf: str) -> DataFrame:
    """Headings written as a map of keys to slugs; references looked up in it, null where there is none."""
    base = fresh_folder(spark, "sections")
    heads = table(spark, sf, "supplier").select(F.when(F.col("s_suppkey") % 3 > 0, F.concat((F.col("s_suppkey") + 300).cast("string"), F.lit(". "), "s_name")).otherwise(F.concat(F.lit("On "), F.col("s_name"))).alias("heading"))
    sinks.json(heads.select(sinks.section_map(F.col("heading")).alias("m")).select("m.*"), base)
    known = tables.state(spark, base, "key string, slug string")
    asked = table(spark, sf, "part").select("p_partkey", F.concat(F.col("p_size") + 300, F.lit(".1.a")).alias("section"))
    return asked.withColumn("key", X.numeric_base("section")).join(known, "key", "left").select("p_partkey", "key", "slug")


def page_blades(spark: SparkSession, sf: str) -> DataFrame:
    """Rich-text blocks out of the JSON that a page carries in a script."""
    rows = table(spark, sf, "conversations")
    blade = F.struct(F.when(F.col("turn") % 2 == 0, "articleRichText").otherwise("hero").alias("type"), F.col("turn").alias("turn"), F.struct(F.col("text").alias("body")).alias("richText"))
    data = rows.groupBy("conv_id").agg(F.to_json(F.struct(F.struct(F.array_sort(F.collect_list(F.struct(F.col("turn").alias("at"), blade.alias("b")))).alias("blades")).alias("props"))).alias("json"))
    html = data.select("conv_id", F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">'), "json", F.lit("</script></html>")).alias("html"))
    schema = T.StructType.fromDDL("props struct<blades: array<struct<at: long, b: struct<type: string, turn: long, richText: struct<body: string>>>>>")
    blades = html.select("conv_id", F.explode(tables.embedded_json(F.col("html"), schema)["props"]["blades"]).alias("x"))
    return blades.filter("x.b.type = 'articleRichText'").select("conv_id", F.col("x.b.turn").alias("turn"), F.md5("x.b.richText.body").alias("body"))


def paged_read(spark: SparkSession, sf: str) -> DataFrame:
    """Records of a paged service joined to what is known of them."""
    spark.dataSource.register(paged.PagedSource)
    read = spark.read.format("paged").schema("id long, name string").option("fetch", "corpuslake.sources.paged:numbered")
    return read.load("cards/1-250,cards/1000-1100").join(table(spark, sf, "part"), F.col("id") == F.col("p_partkey")).select("id", "name", "p_name")


def partition_layout(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks laid out for the reads that are made of them: partitioned by version and kind, sorted by section within files."""
    base = fresh_folder(spark, "layout")
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", F.concat(F.lit("v"), (F.col("doc_id") % 2).cast("string")).alias("corpus_version"), F.length("text").alias("chars"))
    docs.repartition("corpus_version", "lang").sortWithinPartitions("source").write.partitionBy("corpus_version", "lang").parquet(base)
    back = spark.read.parquet(base).filter((F.col("corpus_version") == "v1") & F.col("lang").isin("en", "fr") & (F.col("source") == "src3"))
    return back.groupBy("lang").agg(F.count(F.lit(1)).alias("chunks"), F.sum("chars").alias("chars"))


def paged_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The paged service as a stream that is stopped after each of its runs and taken up again: each record comes once."""
    spark.dataSource.register(paged.PagedSource)
    base = fresh_folder(spark, "paged")
    rows = spark.readStream.format("paged").schema("id long, name string").option("fetch", "corpuslake.sources.paged:numbered")
    for pages in ("1", "2"):  # other sizes of batch each time
        query = rows.option("pages", pages).load("cards/1-250,cards/1000-1100").writeStream.format("parquet").option("checkpointLocation", f"{base}/state").start(f"{base}/rows")
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    back = spark.read.schema("id long, name string").parquet(f"{base}/rows")
    return back.join(table(spark, sf, "part"), F.col("id") == F.col("p_partkey")).select("id", "name", "p_name")


def ledger_limits(spark: SparkSession, sf: str) -> DataFrame:
    """Rate limits and the personal quota out of a bucketed ledger: no shuffle before their windows."""
    base = fresh_folder(spark, "bucketed")
    rows = _metered(spark, sf).select("event_id", "ts", "user_id", "tokens", "day")
    return limits(sinks.bucketed_ledger(rows, f"ledger_{base.rsplit('-', 1)[-1]}", base, buckets=8))


def limits(requests: DataFrame) -> DataFrame:
    order = ["ts", "event_id"]
    day = Window.partitionBy("user_id", "day").orderBy(*order)
    hour = Window.partitionBy("user_id", "day", F.date_trunc("HOUR", "ts")).orderBy(*order)
    verdict = F.when(F.row_number().over(hour) > 1, "hour").when(F.row_number().over(day) > 3, "day").otherwise("pass")
    used = F.coalesce(F.sum("tokens").over(day.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return requests.select("event_id", verdict.alias("verdict"), used.alias("asked_before"))


def stream_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """A stream into the ledger that fails after its first write, and is started again: each request is there once."""
    base = fresh_folder(spark, "ledger-stream")
    rows = _stream(spark, sf).select("event_id", "user_id", F.ceil(F.col("value") * 4).cast("long").alias("tokens"))
    failed = []

    def then(batch: int) -> None:
        if not failed:
            failed.append(batch)
            raise RuntimeError("the first try fails after its write")

    for _ in range(2):
        query = ledger.appended(rows, f"{base}/rows", "requests", f"{base}/state", then)
        try:
            query.awaitTermination()
        except StreamingQueryException:
            continue
    back = ledger.recorded(spark, f"{base}/rows", "event_id long, user_id long, tokens long")
    return back.groupBy("user_id").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("event_id").alias("requests"), F.sum("tokens").alias("tokens"))


def corpus_upsert_stored(spark: SparkSession, sf: str) -> DataFrame:
    """A stored corpus, upserted into twice: some rows by key, then one alone, whose partition only is written."""
    base, docs = fresh_folder(spark, "corpus"), table(spark, sf, "documents")
    rows = docs.select(F.col("doc_id").alias("id"), F.col("n_chars").alias("content"), F.col("source").alias("section"), F.lit("v1").alias("corpus_version"))
    sinks.corpus(rows.filter("id % 3 <> 0"), base, parts=16)
    changed = rows.select("id", (F.col("content") + 1).alias("content"), F.concat(F.col("section"), F.lit("-new")).alias("section"), F.lit("v2").alias("corpus_version"))
    sinks.upserted(spark, base, changed.filter("id % 2 = 0"), parts=16)
    sinks.upserted(spark, base, changed.filter("id = 1").withColumn("corpus_version", F.lit("v3")), parts=16)
    return spark.read.parquet(base).select("id", "content", "section", "corpus_version")


def observed_counts(spark: SparkSession, sf: str) -> DataFrame:
    """What an observer saw of a write as it passed, beside what was written."""
    base, seen = fresh_folder(spark, "observed"), Observer()
    docs = seen.watch(table(spark, sf, "documents").select("doc_id", "lang", "text"), "documents", n=F.count(F.lit(1)), chars=F.sum(F.length("text")), least=F.min("doc_id"))
    docs.write.parquet(base)
    values = seen.values("documents")
    back = spark.read.parquet(base).groupBy("lang").agg(F.count(F.lit(1)).alias("written"))
    return back.select("lang", "written", *[F.lit(values[k]).cast("long").alias(k) for k in ("n", "chars", "least")])


QUERIES = {
    f.__name__: f
    for f in (
        manifest_chunks, section_dictionary, csv_restore, json_results, eval_questions, version_scan, ledger_append, resume_batches, markdown_files, code_module, section_map,
        page_blades, paged_read, partition_layout, paged_stream, ledger_limits, stream_ledger, corpus_upsert_stored, observed_counts,
    )
}

ORACLE = {
    "manifest_chunks": """SELECT CAST(ord AS INTEGER) AS ord, source_document, source_type, CAST(sum(length(text) + 1) AS BIGINT) AS chars
      FROM (VALUES (0, 'one.md', 'rulebook', 'en'), (1, 'two.md', 'rules_faq', 'fr'), (3, 'one.md', 'patch_notes', 'es')) m(ord, source_document, source_type, lang) JOIN documents USING (lang) GROUP BY 1, 2, 3""",
    "section_dictionary": r"""WITH s AS (SELECT source AS name, '## ' || source || chr(10) || 'first' AS text, doc_id FROM documents UNION ALL SELECT lang || '/' || source, '## ' || lang || '/' || source || chr(10) || left(text, 30), doc_id FROM documents)
      SELECT name, md5(regexp_replace(arg_max(text, doc_id), '^\s+|\s+$', '', 'g')) AS text FROM s GROUP BY 1""",
    "csv_restore": """SELECT doc_id, md5('say "' || text || '", twice') AS text, len(embedding) AS numbers, round(embedding[-1]::DOUBLE, 6) AS last FROM documents JOIN embeddings ON vec_id = doc_id""",
    "json_results": f"""WITH {SQL_RESULTS} SELECT source, count(*) FILTER (has_ref) AS evaluable, count(*) FILTER (has_ref AND hit) AS hits, count(difficulty) AS rated FROM results GROUP BY 1""",
    "eval_questions": """SELECT item_id, 0 AS pos, '702.1' AS ref FROM benchmark WHERE item_id % 4 > 0 UNION ALL SELECT item_id, 1, CAST(item_id + 300 AS VARCHAR) FROM benchmark WHERE item_id % 4 > 0""",
    "version_scan": """SELECT doc_id, source, CAST(length(text) AS INTEGER) AS chars, CASE WHEN doc_id % 8 = 1 THEN 'v1' ELSE 'v4' END AS corpus_version FROM documents WHERE doc_id % 8 = 1 OR doc_id % 4 = 3""",
    "ledger_append": f"""WITH {SQL_METERED} SELECT user_id, count(*) AS "rows", CAST(sum(CASE WHEN event_type = 'view' THEN 0 ELSE tokens END) AS BIGINT) AS tokens, count(*) FILTER (event_type = 'view') AS cached,
      CAST(sum(tokens) FILTER (event_type = 'view') AS BIGINT) AS saved FROM m GROUP BY 1""",
    "resume_batches": r"""WITH s AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\b\d{3}(?:\.(?:\d+|[a-z]))*\b', '', 'g'), '\s+', ' ', 'g'), ' .') AS t FROM documents),
      l AS (SELECT doc_id, CASE WHEN length(t) >= 10 THEN 'Context: ' || t END AS l FROM s)
      SELECT doc_id, CAST(1 AS BIGINT) AS times, md5(left(CASE WHEN NOT regexp_matches(l, '[.?!]$') AND length(l) < 300 THEN l || '.' ELSE l END, 300)) AS line FROM l""",
    "markdown_files": """WITH p AS (SELECT * FROM part WHERE p_type <> 'SMALL'), l AS (SELECT unnest(['**Name**: ' || p_name, '**Type**: ' || p_type, CASE WHEN p_size > 10 THEN '**Size**: ' || p_size END, '**Brand**: ' || p_brand, '', '---']) AS v FROM p)
      SELECT regexp_extract(v, '^(\\*\\*\\w+\\*\\*|-+)') AS kind, count(*) AS lines, CAST(sum(length(v)) AS BIGINT) AS chars FROM l WHERE v IS NOT NULL GROUP BY 1""".replace("\\\\", "\\"),
    "code_module": """SELECT 'export const CARD_INDEX: { clean_name: string; set_label: string }[] = [' AS line UNION ALL SELECT '];'
      UNION ALL SELECT '  {"clean_name":"' || lower(p_name) || '","set_label":"' || min(p_brand) || '"},' FROM part GROUP BY lower(p_name)""",
    "section_map": r"""WITH m AS (SELECT CAST(s_suppkey + 300 AS VARCHAR) AS key, trim(regexp_replace(regexp_replace(lower((s_suppkey + 300) || '. ' || s_name), '[^A-Za-z0-9_\s-]', '', 'g'), '[\s-]+', '-', 'g'), '-') AS slug FROM supplier WHERE s_suppkey % 3 > 0)
      SELECT p_partkey, CAST(p_size + 300 AS VARCHAR) AS key, slug FROM part LEFT JOIN m ON m.key = CAST(p_size + 300 AS VARCHAR)""",
    "page_blades": "SELECT conv_id, turn, md5(text) AS body FROM conversations WHERE turn % 2 = 0",
    "paged_read": "SELECT p_partkey AS id, 'card ' || p_partkey AS name, p_name FROM part WHERE p_partkey BETWEEN 1 AND 250 OR p_partkey BETWEEN 1000 AND 1100",
    "partition_layout": "SELECT lang, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents WHERE doc_id % 2 = 1 AND lang IN ('en', 'fr') AND source = 'src3' GROUP BY 1",
    "paged_stream": "SELECT p_partkey AS id, 'card ' || p_partkey AS name, p_name FROM part WHERE p_partkey BETWEEN 1 AND 250 OR p_partkey BETWEEN 1000 AND 1100",
    "ledger_limits": f"""WITH {SQL_METERED} SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) > 1 THEN 'hour'
        WHEN row_number() OVER (PARTITION BY user_id, day ORDER BY ts, event_id) > 3 THEN 'day' ELSE 'pass' END AS verdict,
      CAST(coalesce(sum(tokens) OVER (PARTITION BY user_id, day ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS asked_before FROM m""",
    "stream_ledger": f"""WITH {SQL_METERED} SELECT user_id, count(*) AS "rows", count(DISTINCT event_id) AS requests, CAST(sum(tokens) AS BIGINT) AS tokens FROM m GROUP BY 1""",
    "corpus_upsert_stored": """WITH b AS (SELECT doc_id AS id, n_chars AS content, source AS section FROM documents)
      SELECT id, CASE WHEN id % 2 = 0 OR id = 1 THEN content + 1 ELSE content END AS content, CASE WHEN id % 3 <> 0 THEN section ELSE section || '-new' END AS section,
        CASE WHEN id = 1 THEN 'v3' WHEN id % 2 = 0 THEN 'v2' ELSE 'v1' END AS corpus_version FROM b WHERE id % 3 <> 0 OR id % 2 = 0""",
    "observed_counts": """SELECT lang, count(*) AS written, CAST((SELECT count(*) FROM documents) AS BIGINT) AS n, CAST((SELECT sum(length(text)) FROM documents) AS BIGINT) AS chars,
      (SELECT min(doc_id) FROM documents) AS least FROM documents GROUP BY 1""",
}
