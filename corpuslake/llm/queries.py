"""Queries of the operators in this subpackage, over whole tables, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.llm import (
    decontamination,
    embedding_dedup,
    html_text,
    language_id,
    lexical_search,
    ngram_join,
    packing,
    periodic_runs,
    quality_classifier,
    quality_rules,
    secret_scan,
    sharding,
    token_attribution,
)
from corpuslake.llm.runtime import documents, tune


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.filter(F.col("quality") == 1).select("doc_id")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(documents(spark, sf_dir), trusted(spark, sf_dir))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_attribution.counted(documents(spark, sf_dir), *token_attribution.default_vocabulary())


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(documents(spark, sf_dir))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), packing.default_tokenizer())


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    weights = quality_classifier.fitted(docs, labels.filter(~quality_classifier.is_held_out("doc_id")))
    return quality_classifier.scored(docs, weights)


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.clustered(documents(spark, sf_dir), 4, 85)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return html_text.extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identified(documents(spark, sf_dir))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scanned(documents(spark, sf_dir))


def op11_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.searched(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digested(periodic_runs.detected(periodic_runs.looped(documents(spark, sf_dir))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_token_counts": op2_token_counts,
    "op3_sharding": op3_sharding,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_html_extraction": op8_html_extraction,
    "op9_language_id": op9_language_id,
    "op10_secret_scan": op10_secret_scan,
    "op11_ranked_lexical_search": op11_ranked_lexical_search,
    "op12_embedding_near_dedup": op12_embedding_near_dedup,
    "op13_periodic_runs": op13_periodic_runs,
}

def _mixed(x: str, shift: int, factor: int) -> str:
    """One step of the splitmix64 finaliser on an unsigned 64-bit expression."""
    return f"CAST((CAST(xor({x}, {x} >> {shift}) AS UHUGEINT) * {factor}) % 18446744073709551616 AS UBIGINT)"


def _crc_table() -> list[int]:
    """The table of the reflected CRC-32 polynomial."""
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    return table


def _crc_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    return f"xor(list_reduce([4294967295::BIGINT] || {octets}, lambda c, b: xor(c >> 8, ([{', '.join(map(str, _crc_table()))}]::BIGINT[])[(xor(c, b) & 255) + 1])), 4294967295)"


ORACLE: dict[str, str] = {
    "op3_sharding": f"""
      WITH RECURSIVE d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
        {_crc_sql("coalesce(text, '')")} AS text_crc32 FROM documents),
      k0 AS (SELECT DISTINCT doc_id, CAST(doc_id AS UBIGINT) AS k FROM documents), k1 AS (SELECT doc_id, {_mixed("k", 30, 0xBF58476D1CE4E5B9)} AS k FROM k0),
      k2 AS (SELECT doc_id, {_mixed("k", 27, 0x94D049BB133111EB)} AS k FROM k1), k3 AS (SELECT doc_id, xor(k, k >> 31) AS k FROM k2),
      j AS (SELECT doc_id, n, k, -1::BIGINT AS b, 0::BIGINT AS c FROM k3, (VALUES (16), (17)) v(n)
        UNION ALL SELECT doc_id, n, m, c, CAST(floor((c + 1) * (2147483648::DOUBLE / ((m >> 33) + 1)::DOUBLE)) AS BIGINT)
        FROM (SELECT *, CAST((CAST(k AS UHUGEINT) * 2862933555777941757 + 1) % 18446744073709551616 AS UBIGINT) AS m FROM j WHERE c < n)),
      s AS (SELECT doc_id, CAST(max(CASE WHEN n = 16 THEN b END) AS INTEGER) AS shard, CAST(max(CASE WHEN n = 17 THEN b END) AS INTEGER) AS grown_shard FROM j WHERE c >= n GROUP BY 1)
      SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, size, text_crc32) - 1 AS slot, grown_shard FROM d JOIN s USING (doc_id)""",
    "op7_ngram_jaccard_join": r"""
      WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
      s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS g FROM w),
      n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
      p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
      l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
      r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
      SELECT r.a AS doc_id, coalesce(max(n.n), 0) AS n_shingles, min(b) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY 1""",
    "op11_ranked_lexical_search": r"""
      WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
      a AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM t WHERE len(w) > 0),
      i AS (SELECT row_number() OVER () AS k, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
      q AS (SELECT DISTINCT k, item_id, unnest(w) AS term FROM i),
      f AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
      g AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM f, a GROUP BY term, n_docs),
      s AS (SELECT k, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // n_terms))))) AS BIGINT) AS score FROM q JOIN f USING (term) JOIN g USING (term), a GROUP BY ALL),
      o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
      SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 50""",
    "op12_embedding_near_dedup": """
      WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e, label FROM embeddings),
      g AS (SELECT r, vec_id, label, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS u FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND list_count(e) = len(e)
        AND len(list_filter(e, lambda x: isfinite(x))) = len(e) AND len(list_filter(e, lambda x: x <> 0)) > 0),
      l AS (SELECT a.r AS a, b.r AS b FROM g a JOIN g b ON a.label = b.label AND a.r <> b.r AND len(a.u) = len(b.u) AND list_inner_product(a.u, b.u) >= 0.93),
      reach AS (SELECT r AS a, r AS b FROM v UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
      c AS (SELECT a, min(vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY 1), n AS (SELECT a, count(*) AS n_links FROM l GROUP BY 1)
      SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept, 1.0::DOUBLE AS recall FROM v JOIN c ON c.a = v.r LEFT JOIN n ON n.a = v.r""",
    "op13_periodic_runs": rf"""
      WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {_crc_sql("CAST(doc_id AS VARCHAR)")} AS h FROM documents),
      p AS (SELECT r, doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS loops, h // 10 AS g FROM d),
      q AS (SELECT *, CASE WHEN loops THEN g % n END AS a, CASE WHEN loops THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM p),
      x AS (SELECT r, i, w[1 + CASE WHEN loops AND i >= a THEN a + (i - a) % p ELSE i END] AS word, n FROM (SELECT *, unnest(range(n)) AS i FROM q)),
      m AS (SELECT a.r, b.i - a.i AS q, a.i FROM x a JOIN x b ON a.r = b.r AND a.word = b.word AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
      s AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM m) GROUP BY r, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
      runs AS (SELECT r, start, length, min(q) AS period FROM s GROUP BY 1, 2, 3),
      best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY length::DOUBLE / period DESC, start, period) AS k FROM runs) WHERE k = 1),
      said AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS said FROM runs GROUP BY 1),
      gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
      left_over AS (SELECT x.r, string_agg(word, ' ' ORDER BY x.i) AS words FROM x ANTI JOIN gone ON gone.r = x.r AND gone.i = x.i GROUP BY 1)
      SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start, best.length, best.period, 1000 * best.length // best.period AS exponent_milli,
        sha256(coalesce(said, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
      FROM d LEFT JOIN said USING (r) LEFT JOIN best USING (r) LEFT JOIN left_over USING (r)""",
}
