"""Corpus queries: parsing, chunking, identity, versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslake.functions import ids
from corpuslake.functions import text as X
from corpuslake.operators import lifecycle
from corpuslake.sources.tables import table


def chunk_ids(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", ids.chunk_id(F.lit("v2.1.0"), F.col("source"), F.col("text")).alias("id"), ids.content_key(F.col("source"), F.col("text")).alias("content_key"))


def _sql_uuid(name: str) -> str:
    h = f"sha1(unhex('{ids.NAMESPACE_URL}') || encode({name}))"
    return f"""(SELECT h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', (strpos('0123456789abcdef', h[17]) - 1) % 4 + 1, 1) || h[18:20] || '-' || h[21:32] FROM (SELECT {h} AS h))"""


def cache_keys(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "benchmark").withColumn("mentions", F.array(F.lit("zed"), F.concat(F.lit("m"), (F.col("item_id") % 7).cast("string"))))
    namespace = F.concat(F.lit("p3"), F.when(F.col("item_id") % 2 == 0, "+hard-routing").otherwise(""))
    return rows.select("item_id", ids.cache_key(F.lit("v2.1.0"), F.col("mentions"), namespace, F.col("text")).alias("key"))


def detect_set(spark: SparkSession, sf: str) -> DataFrame:
    """The set of a document: by the stem of its source, else core; counts of each."""
    name = F.when(F.col("source").endswith("1"), "origins").when(F.col("source").rlike("[23]$"), "spirit").when(F.col("source").startswith("src4"), "unleashed").otherwise("core")
    return table(spark, sf, "documents").groupBy(name.alias("set")).agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("chars"))


def context_lines_join(spark: SparkSession, sf: str) -> DataFrame:
    """Context lines put before the chunks that have one; how many had none, per source."""
    docs = table(spark, sf, "documents")
    lines = table(spark, sf, "labels").select("doc_id", F.concat(F.lit("quality "), F.col("quality")).alias("line"))
    rows = docs.join(lines, "doc_id", "left").withColumn("content", F.concat_ws("\n", "line", "text"))
    return rows.groupBy("source").agg(F.count("line").alias("applied"), F.count_if(F.col("line").isNull()).alias("missing"), F.sum(F.length("content")).alias("chars"))


def _versions(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    version = F.concat(F.lit("v2."), (F.year("o_orderdate") - 1990).cast("string"), F.lit("."), F.month("o_orderdate").cast("string"))
    return orders.select("o_orderkey", "o_orderpriority", version.alias("corpus_version"))


def corpus_version_latest(spark: SparkSession, sf: str) -> DataFrame:
    """The greatest version as text (so v2.9 comes after v2.10), and by number."""
    number = F.transform(F.split(F.substring("corpus_version", 2, 20), "[.]"), lambda x: x.cast("int"))
    return _versions(spark, sf).agg(F.max("corpus_version").alias("latest"), F.concat(F.lit("v"), F.array_join(F.max(number), ".")).alias("latest_by_number"))


def corpus_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.groupBy("lang", "source").agg(F.count("*").alias("chunks"), F.count_distinct(F.substring("text", 1, 10)).alias("heads"))


def corpus_upsert(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    base = docs.select(F.col("doc_id").alias("id"), F.col("n_chars").alias("content"), F.col("source").alias("section"), F.lit("v1").alias("corpus_version"))
    old = base.filter("id % 3 <> 0")
    new = base.filter("id % 2 = 0").select("id", (F.col("content") + 1).alias("content"), F.concat(F.col("section"), F.lit("-new")).alias("section"), F.lit("v2").alias("corpus_version"))
    return lifecycle.upsert(old, new)


def corpus_copy_version(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "v1.1").otherwise("v1.0").alias("corpus_version"), F.col("lang").alias("source_type"), F.pmod("doc_id", F.lit(300)).alias("content_key"))
    return lifecycle.copy_version(docs, "v1.0", "v1.1", "content_key", "fr").groupBy("source_type", "corpus_version").agg(F.count("*").alias("copied"))


def corpus_update_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    fresh = lifecycle.only_new(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")
    return fresh.select("doc_id", F.length("text").alias("to_embed"))


def errata_latest_wins(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("date"), "o_orderkey", "o_totalprice")
    return lifecycle.latest(rows, ["o_custkey"], "date", "o_orderkey")


def card_filter_first(spark: SparkSession, sf: str) -> DataFrame:
    """Without alternates and rows without an id; the first row of each id."""
    part = table(spark, sf, "part").withColumn("id", F.when(F.col("p_size") % 9 != 0, F.concat_ws("-", "p_name", "p_brand"))).filter("id is not null and p_type <> 'PROMO'")
    by = Window.partitionBy("id").orderBy("p_partkey")
    return part.withColumn("n", F.row_number().over(by)).filter("n = 1").select("id", "p_partkey")


def card_index_best(spark: SparkSession, sf: str) -> DataFrame:
    """The shortest name of each image, then the first image of each name."""
    part = table(spark, sf, "part").select("p_partkey", F.concat_ws("/", "p_brand", "p_size").alias("image"), F.lower("p_name").alias("name"))
    short = Window.partitionBy("image").orderBy(F.length("name"), "p_partkey")
    first = Window.partitionBy("name").orderBy("p_partkey")
    best = part.withColumn("n", F.row_number().over(short)).filter("n = 1")
    return best.withColumn("n", F.row_number().over(first)).filter("n = 1").select("name", "image", "p_partkey")


def card_render(spark: SparkSession, sf: str) -> DataFrame:
    """Text of a record in a fixed order; missing fields leave no trace; empty without a name or type."""
    field = lambda label, value: F.concat(F.lit(f"**{label}**: "), value)
    part = table(spark, sf, "part").withColumn("size", F.when(F.col("p_size") > 10, F.col("p_size").cast("string")))
    text = F.concat_ws("\n", field("Name", F.col("p_name")), field("Type", F.col("p_type")), field("Size", F.col("size")), field("Brand", F.col("p_brand")))
    return part.select("p_partkey", F.when(F.col("p_type") == "SMALL", "").otherwise(text).alias("text"))


def rule_codes(spark: SparkSession, sf: str) -> DataFrame:
    prices = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("see "), F.col("p_size") + 300, F.lit(".2.a and "), F.col("p_retailprice").cast("string"), F.lit(" or 1234.5, rule 702.")).alias("text"))
    return prices.select("p_partkey", F.array_join(F.array_sort(X.rule_codes("text")), ",").alias("codes"), X.numeric_base(F.element_at(X.rule_codes("text"), 1)).alias("base"))


QUERIES = {
    f.__name__: f
    for f in (
        chunk_ids, cache_keys, detect_set, context_lines_join, corpus_version_latest,
        corpus_counts, corpus_upsert, corpus_copy_version, corpus_update_antijoin, errata_latest_wins, card_filter_first, card_index_best, card_render,
        rule_codes,
    )
}

ORACLE = {
    "chunk_ids": f"SELECT doc_id, {_sql_uuid("'v2.1.0:' || source || ':' || text")} AS id, {_sql_uuid("source || ':' || text")} AS content_key FROM documents",
    "cache_keys": """SELECT item_id, sha256('{"cv": "v2.1.0", "m": ["m' || (item_id % 7) || '", "zed"], "pv": "p3' || CASE WHEN item_id % 2 = 0 THEN '+hard-routing' ELSE '' END
      || '", "q": "' || lower(trim(text)) || '"}') AS key FROM benchmark""",
    "detect_set": """SELECT CASE WHEN source LIKE '%1' THEN 'origins' WHEN regexp_matches(source, '[23]$') THEN 'spirit' WHEN source LIKE 'src4%' THEN 'unleashed' ELSE 'core' END AS "set",
      count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1""",
    "context_lines_join": """SELECT source, count(quality) AS applied, count(*) - count(quality) AS missing, CAST(sum(length(text) + CASE WHEN quality IS NULL THEN 0 ELSE 10 END) AS BIGINT) AS chars
      FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""",
    "corpus_version_latest": """WITH v AS (SELECT 'v2.' || (year(o_orderdate) - 1990) || '.' || month(o_orderdate) AS v, [2, year(o_orderdate) - 1990, month(o_orderdate)] AS n FROM orders)
      SELECT max(v) AS latest, 'v' || array_to_string(max(n), '.') AS latest_by_number FROM v""",
    "corpus_counts": "SELECT lang, source, count(*) AS chunks, count(DISTINCT left(text, 10)) AS heads FROM documents GROUP BY 1, 2",
    "corpus_upsert": """WITH b AS (SELECT doc_id AS id, n_chars AS content, source AS section FROM documents)
      SELECT id, CASE WHEN id % 2 = 0 THEN content + 1 ELSE content END AS content, CASE WHEN id % 3 <> 0 THEN section ELSE section || '-new' END AS section,
        CASE WHEN id % 2 = 0 THEN 'v2' ELSE 'v1' END AS corpus_version FROM b WHERE id % 3 <> 0 OR id % 2 = 0""",
    "corpus_copy_version": """WITH d AS (SELECT doc_id % 300 AS k, lang, doc_id % 5 = 0 AS target FROM documents)
      SELECT lang AS source_type, 'v1.1' AS corpus_version, count(*) AS copied FROM d WHERE NOT target AND lang <> 'fr' AND k NOT IN (SELECT k FROM d WHERE target) GROUP BY 1""",
    "corpus_update_antijoin": "SELECT doc_id, CAST(length(text) AS INTEGER) AS to_embed FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "errata_latest_wins": """SELECT o_custkey, date, o_orderkey, o_totalprice FROM (SELECT *, strftime(o_orderdate, '%Y-%m') AS date,
      row_number() OVER (PARTITION BY o_custkey ORDER BY strftime(o_orderdate, '%Y-%m') DESC, o_orderkey) AS n FROM orders) WHERE n = 1""",
    "card_filter_first": "SELECT p_name || '-' || p_brand AS id, min(p_partkey) AS p_partkey FROM part WHERE p_size % 9 <> 0 AND p_type <> 'PROMO' GROUP BY 1",
    "card_index_best": """WITH b AS (SELECT * FROM (SELECT p_partkey, p_brand || '/' || p_size AS image, lower(p_name) AS name,
      row_number() OVER (PARTITION BY p_brand, p_size ORDER BY length(p_name), p_partkey) AS n FROM part) WHERE n = 1)
      SELECT name, arg_min(image, p_partkey) AS image, min(p_partkey) AS p_partkey FROM b GROUP BY name""",
    "card_render": """SELECT p_partkey, CASE WHEN p_type = 'SMALL' THEN '' ELSE concat_ws(chr(10), '**Name**: ' || p_name, '**Type**: ' || p_type,
      CASE WHEN p_size > 10 THEN '**Size**: ' || p_size END, '**Brand**: ' || p_brand) END AS text FROM part""",
    "rule_codes": r"""WITH t AS (SELECT p_partkey, regexp_extract_all('see ' || (p_size + 300) || '.2.a and ' || p_retailprice || ' or 1234.5, rule 702.', '\b\d{3}(?:\.(?:\d+|[a-z]))*\b') AS c FROM part)
      SELECT p_partkey, array_to_string(list_sort(list_distinct(c)), ',') AS codes, nullif(regexp_extract(c[1], '^(\d{3})', 1), '') AS base FROM t""",
}
