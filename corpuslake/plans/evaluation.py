"""Evaluation queries over derived questions, ranks and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslake.functions import text as X
from corpuslake.operators import asof, context, lookup, ports
from corpuslake.operators import evaluation as E
from corpuslake.sources.tables import table


def _codes(spark: SparkSession, sf: str) -> DataFrame:
    """Ranked chunks with a code each: five per order."""
    lines = table(spark, sf, "lineitem")
    code = F.concat_ws(".", (F.col("l_partkey") % 20 + 300).cast("string"), (F.col("l_suppkey") % 4).cast("string"), F.when(F.col("l_linenumber") % 2 == 0, F.lit("a")))
    return lines.select(F.col("l_orderkey").alias("question_id"), F.col("l_linenumber").alias("rank"), code.alias("code"))


def _refs(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").filter("o_orderkey % 8 < 6")
    base = (F.col("o_orderkey") % 20 + 300).cast("string")
    refs = F.array_distinct(F.array(base, F.concat(base, F.lit("."), (F.col("o_orderkey") % 3).cast("string")), F.lit("305.1")))
    return orders.select(F.col("o_orderkey").alias("question_id"), F.explode(refs).alias("ref"))


SQL_COVER = """
  codes AS (SELECT l_orderkey AS question_id, l_linenumber AS rank, (l_partkey % 20 + 300) || '.' || (l_suppkey % 4) || CASE WHEN l_linenumber % 2 = 0 THEN '.a' ELSE '' END AS code FROM lineitem),
  refs AS (SELECT DISTINCT o_orderkey AS question_id, unnest([CAST(o_orderkey % 20 + 300 AS VARCHAR), (o_orderkey % 20 + 300) || '.' || (o_orderkey % 3), '305.1']) AS ref FROM orders WHERE o_orderkey % 8 < 6),
  cover AS (SELECT r.question_id, r.ref, min(c.rank) AS rank FROM refs r LEFT JOIN codes c ON c.question_id = r.question_id AND (c.code = r.ref OR starts_with(c.code, r.ref || '.')) GROUP BY 1, 2)"""


def coverage_join(spark: SparkSession, sf: str) -> DataFrame:
    return E.first_covering(_refs(spark, sf), _codes(spark, sf))


def recall_at_k(spark: SparkSession, sf: str) -> DataFrame:
    ranks = coverage_join(spark, sf).groupBy("question_id").agg(F.min("rank").alias("rank"))
    return ranks.agg(*[F.round(E.recall_at(F.col("rank"), k), 6).alias(f"recall_{k}") for k in (1, 3, 5)], F.count("*").alias("questions"))


def strict_recall(spark: SparkSession, sf: str) -> DataFrame:
    per = coverage_join(spark, sf).groupBy("question_id").agg(E.strict_hit(F.col("rank"), 3).alias("hit"), (E.strict_hit(F.col("rank"), 1 << 30) & (F.count("*") > 0)).alias("full"))
    return per.agg(F.round(F.avg(F.col("hit").cast("int")), 6).alias("strict_recall_3"), F.count_if("full").alias("fully_covered"), F.count_if(~F.col("full")).alias("not_covered"))


def fully_covered(spark: SparkSession, sf: str) -> DataFrame:
    """Questions parted by whether a chunk covers each of their references: how many, with their references and first covering ranks."""
    per = coverage_join(spark, sf).groupBy("question_id").agg(E.strict_hit(F.col("rank"), 1 << 30).alias("covered"), F.count(F.lit(1)).alias("refs"), F.min("rank").alias("first"))
    none = table(spark, sf, "orders").select(F.col("o_orderkey").alias("question_id")).join(per.select("question_id"), "question_id", "left_anti")
    every = per.unionByName(none.select("question_id", F.lit(False).alias("covered"), F.lit(0).cast("long").alias("refs"), F.lit(None).cast("int").alias("first")))
    return every.groupBy("covered").agg(F.count(F.lit(1)).alias("questions"), F.sum("refs").alias("refs"), F.sum("first").alias("first_ranks"))


def specific_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Questions with a given tag; and of them those to be evaluated: with a reference and not routed elsewhere."""
    tags = F.array(F.col("source"), F.when(F.col("doc_id") % 3 == 0, "specific-card").otherwise("general"))
    rows = _results(spark, sf).withColumn("tags", tags).filter(F.array_contains("tags", "specific-card"))
    routed = context.is_hard((F.col("doc_id") % 4), (F.col("n_chars") % 3))
    return rows.select("doc_id", (F.col("has_ref") & ~context.routed(F.lit(True), routed)).alias("evaluable"))


def rejudge(spark: SparkSession, sf: str) -> DataFrame:
    """Answers judged by the judge's port, its replies parsed, and verdicts counted by language."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    reply = ports.judge(F.col("text"), F.substring("text", 1, 5), X.preview("text", 60))
    body = E.verdict(F.when(F.col("doc_id") % 9 == 0, F.lit("not a verdict")).otherwise(reply))
    return docs.select("lang", body.alias("v")).groupBy("lang", F.col("v.verdict").alias("verdict")).agg(F.count(F.lit(1)).alias("answers"), F.max(F.length("v.justification")).cast("long").alias("longest"))


def source_distribution(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").filter("l_linenumber <= 3")
    return lines.groupBy(F.concat("l_returnflag", "l_linestatus").alias("source_type")).agg(F.count("*").alias("chunks")).orderBy(F.desc("chunks"), "source_type").limit(5)


def classify_miss(spark: SparkSession, sf: str) -> DataFrame:
    """Why references outside the top 2 were missed: ranked lower, only a sibling there, or nothing near."""
    cover = coverage_join(spark, sf).withColumn("base", F.substring("ref", 1, 3))
    bases = _codes(spark, sf).select("question_id", F.substring("code", 1, 3).alias("base")).distinct().withColumn("near", F.lit(True))
    missed = cover.filter("rank is null or rank > 2").join(bases, ["question_id", "base"], "left")
    kind = E.miss_kind(F.col("rank").isNotNull(), F.coalesce("near", F.lit(False)))
    return missed.groupBy(kind.alias("kind")).agg(F.count("*").alias("refs"), F.count_distinct("question_id").alias("questions"))


def _results(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    verdict = F.when(F.col("quality") == 1, F.when(F.col("doc_id") % 5 == 0, "partial").otherwise("correct")).when(F.col("quality") == 0, "wrong")
    return docs.select("doc_id", F.when(F.col("lang") != "es", F.col("lang")).alias("difficulty"), "source", verdict.alias("verdict"), (F.col("doc_id") % 4 > 0).alias("has_ref"), (F.col("doc_id") % 3 > 0).alias("hit"), "n_chars")


def eval_recall(spark: SparkSession, sf: str) -> DataFrame:
    rows = _results(spark, sf)
    hits, evaluable = F.count_if(F.col("has_ref") & F.col("hit")), F.count_if("has_ref")
    return rows.groupBy("source").agg(
        hits.alias("hits"), evaluable.alias("evaluable"), F.count_if(~F.col("has_ref")).alias("null_ref"),
        F.round(F.coalesce(F.try_divide(hits, evaluable), F.lit(0.0)), 6).alias("recall"), F.round(F.avg("n_chars"), 4).alias("mean_latency"),
    )


def eval_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return E.verdict_rollup(_results(spark, sf), "difficulty", "source")


def parse_verdict(spark: SparkSession, sf: str) -> DataFrame:
    """Judges' replies: the JSON object in them, a known verdict, a justification of at most 500 characters; else an error."""
    events = table(spark, sf, "events")
    reply = F.when(F.col("event_id") % 7 == 0, "no json here").otherwise(F.concat(F.lit("Verdict:\n{\"verdict\": \""), F.element_at(F.array(F.lit("correct"), F.lit("wrong"), F.lit("maybe")), (F.col("event_id") % 3 + 1).cast("int")), F.lit("\", \"justification\": \"because of "), F.repeat("event_type", (F.col("event_id") % 150).cast("int")), F.lit("\"} done")))
    return events.select("event_id", E.verdict(reply).alias("v")).select("event_id", "v.verdict", F.md5("v.justification").alias("justification"))


def ab_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Two arms paired by question: wins, losses, and what the gate says."""
    labels = table(spark, sf, "labels")
    pairs = labels.select("doc_id", (F.col("quality") == 1).alias("a"), ((F.col("quality") == 1) != (F.col("doc_id") % 11 == 0)).alias("b"))
    out = pairs.agg(F.count_if(~F.col("a") & F.col("b")).alias("wins"), F.count_if(F.col("a") & ~F.col("b")).alias("losses"), F.count("*").alias("pairs"))
    return out.withColumn("gate", F.when(F.col("pairs") == 0, "dead").when(F.col("losses") > 0, "kill").when(F.col("wins") == 0, "dead").otherwise("pass"))


def refs_gained_lost(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    sets = lines.groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_linenumber") <= 3, F.col("l_suppkey") % 7)).alias("a"), F.collect_set(F.when(F.col("l_linenumber") >= 2, F.col("l_suppkey") % 7)).alias("b"))
    joined = lambda x, y: F.array_join(F.array_sort(F.array_except(x, y)), ",")
    return sets.select("l_orderkey", joined("b", "a").alias("gained"), joined("a", "b").alias("lost"))


def delivery_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Of the parts an order needs, how many were delivered."""
    lines = table(spark, sf, "lineitem")
    per = lines.groupBy("l_orderkey").agg(F.count_distinct("l_partkey").alias("detected"), F.count_distinct(F.when(F.col("l_linestatus") == "F", F.col("l_partkey"))).alias("present"))
    return per.agg(F.sum("detected").alias("detected"), F.sum("present").alias("present"), F.round(F.coalesce(F.try_divide(F.sum("present"), F.sum("detected")), F.lit(0.0)), 6).alias("rate"), F.count_if(F.col("present") == 0).alias("none"))


def eviction(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("base"), F.count_if(F.col("l_quantity") > 10).alias("kept"))
    lost = F.col("base") - F.col("kept")
    return orders.groupBy("base").agg(F.count("*").alias("fires"), F.count_if(lost > 0).alias("evicts"), F.sum(lost).alias("lost"), F.count_if(F.col("kept") > 5).alias("overflow"))


def failure_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """By difficulty: a row for each count (total, failed, errors), and one for each failed id, by what failed."""
    rows = _results(spark, sf).withColumn("difficulty", F.coalesce("difficulty", F.lit("unknown")))
    failed = F.coalesce(F.col("verdict") == "wrong", F.lit(False))
    counts = rows.groupBy("difficulty").agg(F.count("*").alias("total"), F.count_if(failed).alias("failed"), F.count_if(F.col("verdict").isNull()).alias("errors"))
    counts = counts.unpivot("difficulty", ["total", "failed", "errors"], "bucket", "value")
    kind = F.when(~F.col("has_ref"), "unknown").when(F.col("hit"), "reasoning").otherwise("retrieval")
    return counts.unionByName(rows.filter(failed).select("difficulty", kind.alias("bucket"), F.col("doc_id").alias("value")))


def tag_counts(spark: SparkSession, sf: str) -> DataFrame:
    tags = F.array(F.col("source"), F.coalesce("difficulty", F.lit("unknown")), F.concat(F.lit("len"), F.floor(F.col("n_chars") / 1000).cast("string")))
    rows = _results(spark, sf).filter("verdict = 'wrong'").select(F.explode(tags).alias("tag"))
    return rows.groupBy("tag").agg(F.count("*").alias("failures")).orderBy(F.desc("failures"), "tag").limit(12)


def majority_vote(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    return events.groupBy("user_id", "event_type").agg(F.count("*").alias("samples"), (F.sum((F.col("value") > 10).cast("int")) > F.count("*") / 2).alias("covered"))


def persistent_regression(spark: SparkSession, sf: str) -> DataFrame:
    """Questions that the first arm answers and the second misses, in two runs: sets of ids, as tables."""
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    hits = [labels.filter(c).select("doc_id") for c in (F.col("quality") == 1, F.col("doc_id") % 3 > 0, F.col("doc_id") % 4 > 0)]
    return E.persistent(*hits, key="doc_id")


def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return E.stratified(docs, 37, "lang", "doc_id")


def confusion(spark: SparkSession, sf: str) -> DataFrame:
    """How a routing prediction agrees with what was routed."""
    docs = table(spark, sf, "documents").withColumn("predicted", F.col("n_chars") % 3 == 0).withColumn("routed", F.col("n_chars") % 2 == 0)
    kind = F.when(F.col("doc_id") % 50 == 0, "unavailable").when(F.col("predicted") == F.col("routed"), "agree").when(F.col("predicted"), "false_positive").otherwise("false_negative")
    return docs.groupBy(kind.alias("kind")).agg(F.count("*").alias("questions"))


def floor_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The greatest anchor at or below each number: anchors and numbers in one order, carried forward."""
    anchors = table(spark, sf, "supplier").select((F.col("s_suppkey") * 17 % 1500).alias("k"), "s_name").groupBy("k").agg(F.min("s_name").alias("page"))
    numbers = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    return asof.floored(numbers, anchors, "k").select("o_orderkey", F.coalesce("page", F.lit("default")).alias("page"))


def prefix_search(spark: SparkSession, sf: str) -> DataFrame:
    """The first eight names, in order, of each typed prefix; the empty one lists the first eight of all.

    Names are cut to the lengths that were typed, so that prefixes meet by equality."""
    words = ("", "b", "red", "small ", "q")
    typed = spark.createDataFrame([(w,) for w in words], "typed string")
    names = table(spark, sf, "part").select(F.lower("p_name").alias("name")).distinct()
    cuts = F.array_distinct(F.array(*[F.substring("name", 1, n) for n in sorted({len(w) for w in words})]))
    hits = names.select("name", F.explode(cuts).alias("typed")).join(typed, "typed").select("typed", "name")
    by = Window.partitionBy("typed").orderBy("name")
    return hits.withColumn("n", F.row_number().over(by)).filter("n <= 8")


def lookup_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """A name by exact match, else by slug, else the first that starts with it: of given words, and of a part of each record's name."""
    part = table(spark, sf, "part")
    index = part.select("p_partkey", F.lower("p_name").alias("name")).groupBy("name").agg(F.min("p_partkey").alias("pos"))
    given = spark.createDataFrame([("Red Widget",), ("small-ring",), ("bl",), ("zzz",), ("  hot gear ",)], "asked string")
    parts = part.select(F.expr("CASE WHEN p_partkey % 2 = 0 THEN substring(p_name, 1, p_partkey % 7 + 2) ELSE replace(p_name, ' ', '-') END").alias("asked"))
    return lookup.cascade(given.union(parts).distinct(), index)


QUERIES = {
    f.__name__: f
    for f in (
        coverage_join, recall_at_k, strict_recall, fully_covered, specific_questions, rejudge, source_distribution, classify_miss, eval_recall, eval_rollup, parse_verdict, ab_gate, refs_gained_lost,
        delivery_rate, eviction, failure_buckets, tag_counts, majority_vote, persistent_regression, stratified_sample, confusion, floor_lookup, prefix_search, lookup_cascade,
    )
}

SQL_RESULTS = """results AS (SELECT doc_id, CASE WHEN lang <> 'es' THEN lang END AS difficulty, source, n_chars, doc_id % 4 > 0 AS has_ref, doc_id % 3 > 0 AS hit,
  CASE WHEN quality = 1 THEN CASE WHEN doc_id % 5 = 0 THEN 'partial' ELSE 'correct' END WHEN quality = 0 THEN 'wrong' END AS verdict FROM documents LEFT JOIN labels USING (doc_id))"""

ORACLE = {
    "coverage_join": f"WITH {SQL_COVER} SELECT * FROM cover",
    "recall_at_k": f"""WITH {SQL_COVER}, q AS (SELECT question_id, min(rank) AS rank FROM cover GROUP BY 1)
      SELECT {", ".join(f"round(avg(CASE WHEN rank <= {k} THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS recall_{k}" for k in (1, 3, 5))}, count(*) AS questions FROM q""",
    "strict_recall": f"""WITH {SQL_COVER}, q AS (SELECT question_id, bool_and(coalesce(rank <= 3, false)) AS hit, bool_and(rank IS NOT NULL) AS covered FROM cover GROUP BY 1)
      SELECT round(avg(CASE WHEN hit THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS strict_recall_3, count(*) FILTER (covered) AS fully_covered, count(*) FILTER (NOT covered) AS not_covered FROM q""",
    "fully_covered": f"""WITH {SQL_COVER}, q AS (SELECT question_id, bool_and(rank IS NOT NULL) AS covered, count(*) AS refs, min(rank) AS first FROM cover GROUP BY 1)
      SELECT coalesce(covered, false) AS covered, count(*) AS questions, CAST(coalesce(sum(refs), 0) AS BIGINT) AS refs, CAST(sum(first) AS BIGINT) AS first_ranks FROM orders LEFT JOIN q ON question_id = o_orderkey GROUP BY 1""",
    "specific_questions": f"""WITH {SQL_RESULTS} SELECT doc_id, has_ref AND NOT (doc_id % 4 >= 2 OR (doc_id % 4 >= 1 AND n_chars % 3 >= 2)) AS evaluable FROM results WHERE doc_id % 3 = 0""",
    "rejudge": """WITH d AS (SELECT lang, doc_id, text, left(text, 5) AS gold, left(text, 60) AS answer FROM documents JOIN labels USING (doc_id)),
      v AS (SELECT lang, doc_id % 9 = 0 AS bad, CASE WHEN gold <> '' AND contains(answer, gold) THEN 'correct' ELSE 'wrong' END AS verdict, 'the answer ' || CASE WHEN gold <> '' AND contains(answer, gold) THEN 'holds' ELSE 'lacks' END || ' the expected text' AS j FROM d)
      SELECT lang, CASE WHEN bad THEN 'error' ELSE verdict END AS verdict, count(*) AS answers, max(CASE WHEN bad THEN 0 ELSE length(j) END) AS longest FROM v GROUP BY 1, 2""",
    "source_distribution": "SELECT l_returnflag || l_linestatus AS source_type, count(*) AS chunks FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
    "classify_miss": f"""WITH {SQL_COVER}, b AS (SELECT DISTINCT question_id, left(code, 3) AS base FROM codes)
      SELECT CASE WHEN rank IS NOT NULL THEN 'C:ranking' WHEN b.base IS NOT NULL THEN 'A:granularity' ELSE 'B:semantic_gap' END AS kind, count(*) AS refs, count(DISTINCT c.question_id) AS questions
      FROM cover c LEFT JOIN b ON b.question_id = c.question_id AND b.base = left(ref, 3) WHERE rank IS NULL OR rank > 2 GROUP BY 1""",
    "eval_recall": f"""WITH {SQL_RESULTS} SELECT source, count(*) FILTER (has_ref AND hit) AS hits, count(*) FILTER (has_ref) AS evaluable, count(*) FILTER (NOT has_ref) AS null_ref,
      round(coalesce(count(*) FILTER (has_ref AND hit)::DOUBLE / nullif(count(*) FILTER (has_ref), 0), 0), 6) AS recall, round(avg(n_chars), 4) AS mean_latency FROM results GROUP BY 1""",
    "eval_rollup": f"""WITH {SQL_RESULTS}, f AS (SELECT coalesce(difficulty, 'unknown') AS difficulty, coalesce(source, 'unknown') AS source, coalesce(verdict, 'error') AS verdict FROM results)
      SELECT difficulty, source, {", ".join(f"count(*) FILTER (verdict = '{v}') AS {v}" for v in ("correct", "partial", "wrong", "error"))}, count(*) AS total FROM f GROUP BY GROUPING SETS ((difficulty), (source))""",
    "parse_verdict": """SELECT event_id, CASE WHEN event_id % 7 <> 0 AND event_id % 3 < 2 THEN ['correct', 'wrong'][event_id % 3 + 1] ELSE 'error' END AS verdict,
      md5(CASE WHEN event_id % 7 <> 0 AND event_id % 3 < 2 THEN left('because of ' || repeat(event_type, event_id % 150), 500) ELSE '' END) AS justification FROM events""",
    "ab_gate": """WITH p AS (SELECT quality = 1 AS a, (quality = 1) <> (doc_id % 11 = 0) AS b FROM labels), o AS (SELECT count(*) FILTER (NOT a AND b) AS wins, count(*) FILTER (a AND NOT b) AS losses, count(*) AS pairs FROM p)
      SELECT *, CASE WHEN pairs = 0 THEN 'dead' WHEN losses > 0 THEN 'kill' WHEN wins = 0 THEN 'dead' ELSE 'pass' END AS gate FROM o""",
    "refs_gained_lost": """WITH s AS (SELECT l_orderkey, coalesce(list(DISTINCT l_suppkey % 7) FILTER (l_linenumber <= 3), []) AS a, coalesce(list(DISTINCT l_suppkey % 7) FILTER (l_linenumber >= 2), []) AS b FROM lineitem GROUP BY 1)
      SELECT l_orderkey, array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(a, x))), ',') AS gained, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS lost FROM s""",
    "delivery_rate": """WITH p AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS d, count(DISTINCT CASE WHEN l_linestatus = 'F' THEN l_partkey END) AS p FROM lineitem GROUP BY 1)
      SELECT CAST(sum(d) AS BIGINT) AS detected, CAST(sum(p) AS BIGINT) AS present, round(sum(p)::DOUBLE / sum(d), 6) AS rate, count(*) FILTER (p = 0) AS none FROM p""",
    "eviction": """WITH o AS (SELECT l_orderkey, count(*) AS base, count(*) FILTER (l_quantity > 10) AS kept FROM lineitem GROUP BY 1)
      SELECT base, count(*) AS fires, count(*) FILTER (base > kept) AS evicts, CAST(sum(base - kept) AS BIGINT) AS lost, count(*) FILTER (kept > 5) AS overflow FROM o GROUP BY 1""",
    "failure_buckets": f"""WITH {SQL_RESULTS}, f AS (SELECT *, coalesce(verdict = 'wrong', false) AS failed FROM results)
      , c AS (SELECT coalesce(difficulty, 'unknown') AS difficulty, count(*) AS total, count(*) FILTER (failed) AS failed, count(*) FILTER (verdict IS NULL) AS errors FROM f GROUP BY 1)
      SELECT difficulty, 'total' AS bucket, total AS "value" FROM c UNION ALL SELECT difficulty, 'failed', failed FROM c UNION ALL SELECT difficulty, 'errors', errors FROM c
      UNION ALL SELECT coalesce(difficulty, 'unknown'), CASE WHEN NOT has_ref THEN 'unknown' WHEN hit THEN 'reasoning' ELSE 'retrieval' END, doc_id FROM f WHERE failed""",
    "tag_counts": f"""WITH {SQL_RESULTS}, t AS (SELECT unnest([source, coalesce(difficulty, 'unknown'), 'len' || (n_chars // 1000)]) AS tag FROM results WHERE verdict = 'wrong')
      SELECT tag, count(*) AS failures FROM t GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12""",
    "majority_vote": "SELECT user_id, event_type, count(*) AS samples, count(*) FILTER (value > 10) > count(*) / 2 AS covered FROM events GROUP BY 1, 2",
    "persistent_regression": "SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND doc_id % 12 = 0",
    "stratified_sample": """WITH s AS (SELECT lang, count(*) AS m, least(37, sum(count(*)) OVER ()) * count(*)::DOUBLE / sum(count(*)) OVER () AS raw FROM documents GROUP BY 1),
      b AS (SELECT lang, floor(round(raw, 9)) AS base, round(raw - floor(round(raw, 9)), 9) AS rest FROM s),
      a AS (SELECT lang, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, lang) <= 37 - sum(base) OVER () THEN 1 ELSE 0 END AS n FROM b)
      SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS r FROM documents) JOIN a USING (lang) WHERE r <= n""",
    "confusion": """SELECT CASE WHEN doc_id % 50 = 0 THEN 'unavailable' WHEN (n_chars % 3 = 0) = (n_chars % 2 = 0) THEN 'agree' WHEN n_chars % 3 = 0 THEN 'false_positive' ELSE 'false_negative' END AS kind,
      count(*) AS questions FROM documents GROUP BY 1""",
    "floor_lookup": """WITH a AS (SELECT s_suppkey * 17 % 1500 AS k, min(s_name) AS page FROM supplier GROUP BY 1)
      SELECT o_orderkey, coalesce(page, 'default') AS page FROM orders ASOF LEFT JOIN a ON o_custkey >= k""",
    "prefix_search": """SELECT typed, name, CAST(n AS INTEGER) AS n FROM (SELECT typed, name, row_number() OVER (PARTITION BY typed ORDER BY name) AS n
      FROM (SELECT DISTINCT lower(p_name) AS name FROM part), (VALUES (''), ('b'), ('red'), ('small '), ('q')) t(typed) WHERE starts_with(name, typed)) WHERE n <= 8""",
    "lookup_cascade": """WITH i AS (SELECT lower(p_name) AS name, min(p_partkey) AS pos FROM part GROUP BY 1), q AS (SELECT DISTINCT asked, lower(trim(asked)) AS p FROM (
        SELECT * FROM (VALUES ('Red Widget'), ('small-ring'), ('bl'), ('zzz'), ('  hot gear ')) t(asked) UNION ALL SELECT CASE WHEN p_partkey % 2 = 0 THEN left(p_name, CAST(p_partkey % 7 + 2 AS BIGINT)) ELSE replace(p_name, ' ', '-') END FROM part))
      SELECT asked, (SELECT name FROM i WHERE name = p OR replace(name, ' ', '-') = p OR starts_with(name, p) OR starts_with(replace(name, ' ', '-'), p)
        ORDER BY CASE WHEN name = p THEN 0 WHEN replace(name, ' ', '-') = p THEN 1 ELSE 2 END, pos LIMIT 1) AS found FROM q""",
}
