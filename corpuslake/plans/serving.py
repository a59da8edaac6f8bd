"""Answers, requests, metering, event streams; and the streaming forms run to the end of their input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslake.functions import text as X
from corpuslake.operators import answers, metering
from corpuslake.session import fresh_folder
from corpuslake.sources.sinks import event_frame
from corpuslake.sources.tables import events_of, table
from corpuslake.streaming import flows, stateful


def answer_postprocess(spark: SparkSession, sf: str) -> DataFrame:
    marked = F.concat(F.regexp_replace("text", r"\. ", " [#1, 2]. "), F.when(F.col("turn") % 2 == 0, F.lit(" " + answers.NO_INFO[0])).otherwise(""))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", marked.alias("answer"))
    return rows.select("conv_id", "turn", F.md5(answers.cleaned(F.col("answer"))).alias("cleaned"), answers.leaks(F.col("answer")).alias("leaks"))


def empty_answer_retry(spark: SparkSession, sf: str) -> DataFrame:
    """The first attempt that is not empty, else a fixed reply; the usage of all attempts adds up."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.length("text") % 3 == 0, "Answer: **").otherwise(F.concat(F.lit("Answer: "), "text")).alias("text"), F.length("text").alias("tokens"))
    by = Window.partitionBy("conv_id").orderBy("turn")
    two = turns.withColumn("attempt", F.row_number().over(by)).filter("attempt <= 2").withColumn("empty", answers.is_empty(F.col("text")))
    first = F.min_by(F.when(~F.col("empty"), F.col("text")), F.when(~F.col("empty"), F.col("attempt")))
    tried = F.when(F.min_by("empty", "attempt"), F.sum("tokens")).otherwise(F.min_by("tokens", "attempt"))
    return two.groupBy("conv_id").agg(F.coalesce(first, F.lit(answers.NO_INFO[0])).alias("answer"), tried.cast("long").alias("tokens"))


def answer_client_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Labels and marks taken off for display; a leading heading told apart."""
    head = F.when(F.col("turn") % 3 == 0, "**Answer:** ").when(F.col("turn") % 3 == 1, "### Reasoning : ").otherwise("Relevant section: , ")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.concat(head, "text", F.lit(" [#1, 2] relevant sections:\n\n\n\nend ")).alias("answer"))
    split = answers.section_label(answers.displayed(F.col("answer")))
    return rows.select("conv_id", "turn", split["label"].alias("label"), F.md5(split["rest"]).alias("shown"))


def request_validate(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").withColumn("mentions", F.array_repeat(F.lit("m"), (F.col("turn") * 4).cast("int")))
    language = F.element_at(F.array(F.lit("en"), F.lit("es"), F.lit("fr")), (F.col("conv_id") % 3 + 1).cast("int"))
    session = F.repeat(F.lit("s"), (F.col("conv_id") % 70).cast("int"))
    return rows.select("conv_id", "turn", F.coalesce(answers.rejected(F.col("text"), F.col("mentions"), language, session), F.lit("ok")).alias("reason"))


def identity_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Error kinds and waits of messages, and which ids are well formed."""
    events = table(spark, sf, "events")
    message = F.when(F.col("event_id") % 4 == 0, "429 quota exceeded per day").when(F.col("event_id") % 4 == 1, F.concat(F.lit("Rate limit, retry in "), F.col("user_id"), F.lit(" s"))).when(F.col("event_id") % 4 == 2, "request timed out").otherwise("boom")
    who = F.concat(F.when(F.col("user_id") % 3 == 0, "auth:").when(F.col("user_id") % 3 == 1, "anon:").otherwise("x:"), F.repeat(F.lit("u"), (F.col("user_id") % 140).cast("int")))
    valid = who.rlike("^(?:auth|anon):.") & (F.length(who) <= 128)
    return events.groupBy(answers.error_kind(message).alias("kind"), valid.alias("valid")).agg(F.count("*").alias("events"), F.sum(answers.retry_delay(message)).alias("wait"))


def json_field_get(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf, "events").groupBy((k % 10).alias("k")).agg(F.count("*").alias("events"), F.sum(k).alias("total"))


def _metered(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", F.ceil(F.col("value") * 4).cast("long").alias("tokens"), F.to_date("ts").alias("day"))


SQL_METERED = "m AS (SELECT event_id, ts, user_id, event_type, CAST(ceil(value * 4) AS BIGINT) AS tokens, CAST(ts AS DATE) AS day FROM events)"


def usage_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return metering.usage(_metered(spark, sf)).select(F.date_format("day", "yyyyMMdd").alias("day"), "user_id", "tokens", "requests")


def quota_gate(spark: SparkSession, sf: str) -> DataFrame:
    out = metering.quota_gate(_metered(spark, sf), personal=100, everyone=9_000)
    return out.select("event_id", "used", "verdict")


def rate_limit_fixed(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", "user_id", "ts")
    hour = metering.within_limit(rows, "user_id", "ts", "event_id", "HOUR", 1)
    day = metering.within_limit(rows, "user_id", "ts", "event_id", "DAY", 3)
    return rows.select("event_id", F.when(~hour, "hour").when(~day, "day").otherwise("pass").alias("verdict"))


def _requests(events: DataFrame) -> DataFrame:
    """Cache requests, some of which have degraded answers."""
    bad = answers.degraded(F.round(F.col("event_id") % 10 / 10, 1), F.when(F.col("event_id") % 10 == 5, answers.NO_INFO[1]).otherwise("text"))
    return events.withColumn("key", F.concat_ws(":", "user_id", "event_type")).withColumn("bad", bad)


def cache_replay(spark: SparkSession, sf: str) -> DataFrame:
    hits = metering.replay_cache(_requests(table(spark, sf, "events")), "key", degraded="bad")
    return hits.select(F.col("id").alias("event_id"), "hit")


def _frames(events: DataFrame) -> DataFrame:
    """Answer streams of twenty events a query, some with restarts, errors and late tokens."""
    kind = F.when(F.col("event_type") == "signup", "restart").when((F.col("event_type") == "purchase") & (F.col("event_id") % 3 == 0), "final").when((F.col("event_type") == "error") & (F.col("event_id") % 5 == 0), "error").otherwise("token")
    data = F.when(kind == "final", F.concat(F.lit("F"), F.col("event_id").cast("string"))).otherwise(F.concat(F.substring("event_type", 1, 1), (F.col("event_id") % 10).cast("string")))
    return events.select(F.expr("event_id DIV 20").alias("query_id"), "ts", F.col("event_id").alias("seq"), kind.alias("event"), data.alias("data"))


def sse_fold(spark: SparkSession, sf: str) -> DataFrame:
    """The answer of each stream: what follows the last restart, up to the first final or error."""
    rows = _frames(table(spark, sf, "events"))
    by = Window.partitionBy("query_id")
    end = F.min(F.when(F.col("event").isin("final", "error"), F.col("seq"))).over(by)
    live = rows.withColumn("end", end).filter("end is null or seq <= end")
    live = live.withColumn("since", F.coalesce(F.max(F.when(F.col("event") == "restart", F.col("seq"))).over(by), F.lit(-1)))
    tokens = F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("event") == "token") & (F.col("seq") > F.col("since")), F.struct("seq", "data")))), lambda x: x["data"]), "")
    out = live.groupBy("query_id").agg(tokens.alias("text"), F.max(F.when(F.col("event") == "final", F.col("data"))).alias("final"), F.max(F.when(F.col("event").isin("final", "error"), F.col("event"))).alias("state"))
    return out.select("query_id", F.coalesce("final", "text").alias("answer"), F.coalesce("state", F.lit("open")).alias("state"))


def _spoken(events: DataFrame) -> DataFrame:
    """Frames in which some answers come to quote what they must not, over several tokens."""
    said = F.when(F.col("seq") % 53 == 3, " System").when(F.col("seq") % 53 == 4, "  pro").when(F.col("seq") % 53 == 5, "mpt ").otherwise(F.col("data"))
    return _frames(events).withColumn("data", F.when(F.col("event") == "token", said).otherwise(F.col("data")))


def sse_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of each stream that were sent before its text came to leak; of a leak the answer is a fixed one."""
    tokens = _spoken(table(spark, sf, "events")).filter("event = 'token'")
    grouped = tokens.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "data"))), lambda x: x["data"]).alias("tokens"))
    return grouped.select("query_id", answers.guarded(F.col("tokens")).alias("g")).select("query_id", "g.sent", "g.leaked", "g.answer")


SQL_FRAMES = """f AS (SELECT event_id // 20 AS query_id, event_id AS seq, CASE WHEN event_type = 'signup' THEN 'restart' WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 'final'
    WHEN event_type = 'error' AND event_id % 5 = 0 THEN 'error' ELSE 'token' END AS event, event_type, event_id FROM events),
  g AS (SELECT *, CASE WHEN event = 'final' THEN 'F' || event_id ELSE left(event_type, 1) || (event_id % 10) END AS data, min(CASE WHEN event IN ('final', 'error') THEN seq END) OVER (PARTITION BY query_id) AS e FROM f),
  h AS (SELECT *, coalesce(max(CASE WHEN event = 'restart' THEN seq END) OVER (PARTITION BY query_id), -1) AS s FROM g WHERE e IS NULL OR seq <= e),
  folded AS (SELECT query_id, coalesce(max(CASE WHEN event = 'final' THEN data END), string_agg(data, '' ORDER BY seq) FILTER (event = 'token' AND seq > s), '') AS answer,
    coalesce(max(CASE WHEN event IN ('final', 'error') THEN event END), 'open') AS state FROM h GROUP BY 1)"""


def sse_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Events written as frames and read back: two frames a body, one with an event and one without data."""
    events = table(spark, sf, "events")
    body = F.concat(event_frame("event_type", F.struct(F.col("user_id").alias("u"))), F.lit("event: ping\n\n"), F.lit("data: {\"u\": 1}\n\n"))
    frames = events.select("event_id", F.explode(events_of(body)).alias("f"))
    return frames.groupBy(F.col("f.event").alias("event")).agg(F.count("*").alias("frames"), F.sum(F.get_json_object("f.data", "$.u").cast("long")).alias("users"))


def usage_last_count(spark: SparkSession, sf: str) -> DataFrame:
    """A stream's usage is its last cumulative count, reported once."""
    rows = _metered(spark, sf).withColumn("query_id", F.expr("event_id DIV 20"))
    return rows.groupBy("query_id").agg(F.max_by("tokens", "event_id").alias("tokens"), F.max_by("event_type", "event_id").alias("model"))


def _drained(frame: DataFrame) -> DataFrame:
    """All that a stream appends for the input there is now, by a checkpointed run into Parquet under the shared folder."""
    spark = frame.sparkSession
    folder = fresh_folder(spark, "stream")
    stateful.rocks(spark)
    query = frame.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).outputMode("append").format("parquet").start(f"{folder}/rows")
    query.awaitTermination()
    return spark.read.schema(frame.schema).parquet(f"{folder}/rows")


def _stream(spark: SparkSession, sf: str, name: str = "events") -> DataFrame:
    """A stream reads a folder or a pattern: this one is met by the table's own file or folder, and by nothing else."""
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{name}.parque[t]")


def stream_usage_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Days that the stream has closed: all but those within the lateness of its newest row."""
    rows = _stream(spark, sf).select("ts", "user_id", F.ceil(F.col("value") * 4).cast("long").alias("tokens"))
    return _drained(flows.daily_usage(rows)).select(F.date_format("day", "yyyyMMdd").alias("day"), "user_id", "tokens", "requests")


def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    rows = _stream(spark, sf).select("ts", "user_id")
    return _drained(flows.sessions(rows, "30 minutes")).groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("events").alias("events"))


def stream_sse_fold(spark: SparkSession, sf: str) -> DataFrame:
    """Answers as they end; those that stay silent end as idle, and give up their state."""
    return _drained(stateful.fold_answers(_frames(_stream(spark, sf))))


def stream_sse_guard(spark: SparkSession, sf: str) -> DataFrame:
    """As the fold, but a text that comes to leak ends its stream with a fixed answer."""
    return _drained(stateful.fold_answers(_spoken(_stream(spark, sf)), answers.LEAKS, answers.FALLBACK)).filter("state <> 'idle'")


def stream_cache(spark: SparkSession, sf: str) -> DataFrame:
    """The write-once cache as requests come."""
    return _drained(stateful.cache(_requests(_stream(spark, sf)).withColumnRenamed("event_id", "id").select("key", "ts", "id", F.col("bad").alias("degraded")), metering.TTL)).select(F.col("id").alias("event_id"), "hit")


def stream_quota_gate(spark: SparkSession, sf: str) -> DataFrame:
    """The personal quota, then the one for all, as requests come."""
    rows = _stream(spark, sf).select("event_id", "ts", "user_id", F.ceil(F.col("value") * 4).cast("long").alias("tokens"))
    return _drained(stateful.quota_gates(rows, personal=100, everyone=9_000))


def stream_rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    """Requests of an hour, then of a day, as they come."""
    return _drained(stateful.rate_limits(_stream(spark, sf).select("event_id", "ts", "user_id"), 1, 3))


QUERIES = {
    f.__name__: f
    for f in (
        answer_postprocess, empty_answer_retry, answer_client_clean, request_validate, identity_errors, json_field_get, usage_rollup, quota_gate, rate_limit_fixed,
        cache_replay, sse_fold, sse_guard, sse_parse, usage_last_count, stream_usage_daily, stream_sessions, stream_sse_fold, stream_sse_guard,
        stream_cache, stream_quota_gate, stream_rate_limit,
    )
}

#: Tokens as they are said; a text leaks at the token that ends its first leak. `since` is the last restart before a token.
SQL_SAID = "CASE seq % 53 WHEN 3 THEN ' System' WHEN 4 THEN '  pro' WHEN 5 THEN 'mpt ' ELSE data END"
SQL_PREFIXES = "regexp_matches(string_agg(said, '') OVER (PARTITION BY query_id{0} ORDER BY seq), '(?i)system\\s+prompt|my instructions|internal rules|hidden context|<context>')"
SQL_SPOKEN = f"""t AS (SELECT query_id, seq, {SQL_SAID} AS said FROM g WHERE event = 'token'), p AS (SELECT *, {SQL_PREFIXES.format("")} AS leak FROM t)"""
SQL_SPOKEN_LIVE = f"""r AS (SELECT *, max(CASE WHEN event = 'restart' THEN seq END) OVER (PARTITION BY query_id ORDER BY seq) AS since FROM g),
  t AS (SELECT query_id, seq, since, {SQL_SAID} AS said FROM r WHERE event = 'token'), p AS (SELECT *, {SQL_PREFIXES.format(", since")} AS leak FROM t)"""

_NO_INFO = answers.NO_INFO[0]
ORACLE = {
    "answer_postprocess": rf"""
      WITH m AS (SELECT conv_id, turn, regexp_replace(text, '\. ', ' [#1, 2]. ', 'g') || CASE WHEN turn % 2 = 0 THEN ' {_NO_INFO}' ELSE '' END AS a FROM conversations),
      c AS (SELECT *, regexp_replace(regexp_replace(a, '\s*\[#?\d+(?:\s*,\s*#?\d+)*\]', '', 'g'), '\s+([.,;:!?])', '\1', 'g') AS t FROM m)
      SELECT conv_id, turn, md5(CASE WHEN ends_with(t, '{_NO_INFO}') AND length(t) > {len(_NO_INFO)} THEN regexp_replace(left(t, length(t) - {len(_NO_INFO)}), '[ \n.,;]+$', '') ELSE t END) AS cleaned, false AS leaks FROM c""",
    "empty_answer_retry": f"""
      WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, length(text) % 3 = 0 AS empty, 'Answer: ' || text AS text, length(text) AS n FROM conversations)
      SELECT conv_id, coalesce(arg_min(text, k) FILTER (NOT empty), '{_NO_INFO}') AS answer, CAST(CASE WHEN arg_min(empty, k) THEN sum(n) ELSE arg_min(n, k) END AS BIGINT) AS tokens FROM t WHERE k <= 2 GROUP BY 1""",
    "answer_client_clean": r"""
      WITH m AS (SELECT conv_id, turn, ['**Answer:** ', '### Reasoning : ', 'Relevant section: , '][turn % 3 + 1] || text || ' [#1, 2] relevant sections:' || repeat(chr(10), 4) || 'end ' AS a FROM conversations),
      c AS (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(a, '\[:?#[\d,\s]+\]', '', 'g'), '(?i)\brelevant sections?\s*:\s*[,\s]*', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS a FROM m)
      SELECT conv_id, turn, nullif(lower(regexp_extract(a, '(?i)^[\s*_#>-]*(reasoning|answer)[\s*_]*:[\s*_]*', 1)), '') AS label, md5(regexp_replace(a, '(?i)^[\s*_#>-]*(reasoning|answer)[\s*_]*:[\s*_]*', '')) AS shown FROM c""",
    "request_validate": """
      SELECT conv_id, turn, CASE WHEN length(trim(text)) < 3 THEN 'short' WHEN length(trim(text)) > 500 THEN 'long' WHEN turn * 4 > 10 THEN 'mentions' WHEN conv_id % 3 = 2 THEN 'language'
        WHEN conv_id % 70 > 64 THEN 'session' WHEN regexp_matches(text, '(?i)<\\s*script|javascript:|on\\w+\\s*=') THEN 'markup' ELSE 'ok' END AS reason FROM conversations""".replace("\\\\", "\\"),
    "identity_errors": """
      WITH e AS (SELECT event_id % 4 AS k, user_id, user_id % 3 < 2 AND user_id % 140 > 0 AND user_id % 140 + 5 <= 128 AS valid FROM events)
      SELECT ['daily', 'rate', 'timeout', 'other'][k + 1] AS kind, valid, count(*) AS events, CAST(sum(CASE WHEN k = 1 THEN user_id + 1 ELSE 60 END) AS BIGINT) AS wait FROM e GROUP BY 1, 2""",
    "json_field_get": "SELECT CAST(props->>'$.k' AS BIGINT) % 10 AS k, count(*) AS events, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1",
    "usage_rollup": f"WITH {SQL_METERED} SELECT strftime(day, '%Y%m%d') AS day, user_id, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS requests FROM m GROUP BY GROUPING SETS ((day, user_id), (day))",
    "quota_gate": f"""
      WITH {SQL_METERED}, a AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY user_id, day ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 100 AS ok FROM m),
      b AS (SELECT *, coalesce(sum(CASE WHEN ok THEN tokens ELSE 0 END) OVER (PARTITION BY day ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 9000 AS open FROM a),
      c AS (SELECT *, CAST(coalesce(sum(CASE WHEN ok AND open THEN tokens ELSE 0 END) OVER (PARTITION BY user_id, day ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS used FROM b)
      SELECT event_id, used, CASE WHEN used >= 100 THEN 'personal' WHEN NOT open THEN 'global' ELSE 'pass' END AS verdict FROM c""",
    "rate_limit_fixed": """
      SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) > 1 THEN 'hour'
        WHEN row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) > 3 THEN 'day' ELSE 'pass' END AS verdict FROM events""",
    "cache_replay": """
      WITH RECURSIVE r AS (SELECT event_id, user_id || ':' || event_type AS key, ts, event_id % 5 = 0 AS bad, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
      w AS (SELECT key, n, event_id, false AS hit, CASE WHEN NOT bad THEN ts END AS written FROM r WHERE n = 1
        UNION ALL SELECT r.key, r.n, r.event_id, coalesce(r.ts < w.written + INTERVAL 1 DAY, false),
          CASE WHEN coalesce(r.ts < w.written + INTERVAL 1 DAY, false) THEN w.written WHEN NOT r.bad THEN r.ts END FROM w JOIN r ON r.key = w.key AND r.n = w.n + 1)
      SELECT event_id, hit FROM w""",
    "sse_fold": f"WITH {SQL_FRAMES} SELECT * FROM folded",
    "sse_guard": f"""WITH {SQL_FRAMES}, {SQL_SPOKEN}, u AS (SELECT query_id, min(seq) FILTER (leak) AS cut FROM p GROUP BY 1)
      SELECT query_id, count(*) FILTER (cut IS NULL OR seq < cut) AS sent, cut IS NOT NULL AS leaked, CASE WHEN cut IS NOT NULL THEN '{answers.FALLBACK}' ELSE string_agg(said, '' ORDER BY seq) END AS answer FROM p JOIN u USING (query_id) GROUP BY query_id, cut""",
    "stream_sse_guard": f"""WITH {SQL_FRAMES}, {SQL_SPOKEN_LIVE}, cuts AS (SELECT query_id, min(seq) FILTER (leak) AS cut FROM p GROUP BY 1),
      o AS (SELECT f.query_id, min(CASE WHEN event IN ('final', 'error') THEN seq END) AS fin, arg_min(event, seq) FILTER (event IN ('final', 'error')) AS state, arg_min(event_id, seq) FILTER (event = 'final') AS last FROM f GROUP BY 1)
      SELECT query_id, CASE WHEN cut < coalesce(fin, 4000000000000000000) THEN '{answers.FALLBACK}' WHEN state = 'final' THEN 'F' || last ELSE coalesce((SELECT string_agg(said, '' ORDER BY seq) FROM p WHERE p.query_id = o.query_id AND seq < fin AND seq > coalesce((SELECT max(seq) FROM f WHERE f.query_id = o.query_id AND event = 'restart' AND seq < fin), -1)), '') END AS answer,
        CASE WHEN cut < coalesce(fin, 4000000000000000000) THEN 'leaked' ELSE state END AS state FROM o LEFT JOIN cuts USING (query_id) WHERE cut IS NOT NULL OR state IS NOT NULL""",
    "sse_parse": "SELECT event_type AS event, count(*) AS frames, CAST(sum(user_id) AS BIGINT) AS users FROM events GROUP BY 1 UNION ALL SELECT 'message', count(*), count(*) FROM events",
    "usage_last_count": f"WITH {SQL_METERED} SELECT event_id // 20 AS query_id, arg_max(tokens, event_id) AS tokens, arg_max(event_type, event_id) AS model FROM m GROUP BY 1",
    "stream_usage_daily": f"""WITH {SQL_METERED} SELECT strftime(day, '%Y%m%d') AS day, user_id, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS requests FROM m
      WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2""",
    "stream_sessions": """
      WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM events),
      s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g),
      o AS (SELECT user_id, s, count(*) AS events, max(ts) AS last FROM s GROUP BY 1, 2)
      SELECT user_id, count(*) AS sessions, CAST(sum(events) AS BIGINT) AS events FROM o WHERE last + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1""",
    "stream_sse_fold": f"""WITH {SQL_FRAMES}, last AS (SELECT event_id // 20 AS query_id, max(ts) AS ts FROM events GROUP BY 1)
      SELECT query_id, answer, CASE state WHEN 'open' THEN 'idle' ELSE state END AS state FROM folded JOIN last USING (query_id) WHERE state <> 'open' OR ts + INTERVAL 60 SECOND < (SELECT max(ts) FROM events)""",
}
ORACLE |= {f"stream_{new}": ORACLE[old] for new, old in (("cache", "cache_replay"), ("quota_gate", "quota_gate"), ("rate_limit", "rate_limit_fixed"))}
