"""Retrieval queries: vector and lexical arms, fusion, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslake.functions import cells, stems
from corpuslake.functions import text as X
from corpuslake.functions import vectors as V
from corpuslake.functions.cells import CellIndex
from corpuslake.operators import fusion, substring, text_index
from corpuslake.operators.text_index import TextIndex
from corpuslake.sources.tables import table


def kind() -> F.Column:
    return F.when(F.col("label") == 0, "errata").when(F.col("label") == 1, "patch_notes").otherwise("rulebook")


SQL_KIND = "CASE label WHEN 0 THEN 'errata' WHEN 1 THEN 'patch_notes' ELSE 'rulebook' END"
SQL_BOOST = "CASE source_type WHEN 'errata' THEN 1.02::DOUBLE WHEN 'patch_notes' THEN 1.01::DOUBLE ELSE 1.0::DOUBLE END"


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def asked(corpus: DataFrame, every: int = 50) -> DataFrame:
    return corpus.filter(F.col("chunk_id") % every == 0).withColumnRenamed("chunk_id", "query_id")


def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    corpus = vectors(spark, sf)
    return V.nearest(corpus, asked(corpus), 15).withColumn("similarity", F.round("similarity", 6))


def _ranked_sql(k: int, filters: str = "TRUE", joins: str = "") -> str:
    return f"""
    SELECT query_id, chunk_id, rank, similarity FROM (
      SELECT q.vec_id AS query_id, c.vec_id AS chunk_id,
             round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS similarity,
             CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY
               round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) DESC, c.vec_id) AS INTEGER) AS rank
      FROM embeddings q, embeddings c {joins} WHERE q.vec_id % 50 = 0 AND {filters}) WHERE rank <= {k}"""


def vector_topk_set_filter(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("tag"))
    corpus = vectors(spark, sf).join(docs, "chunk_id")
    return V.nearest(corpus, asked(corpus), 5, allowed="en").withColumn("similarity", F.round("similarity", 6))


def vector_normalize_dot(spark: SparkSession, sf: str) -> DataFrame:
    corpus = vectors(spark, sf).withColumn("embedding", V.normalised("embedding"))
    return V.nearest(corpus, asked(corpus), 10, digits=6).withColumnRenamed("similarity", "score")


_CELLS: dict[tuple[str, str], CellIndex] = {}


def _cells(spark: SparkSession, sf: str) -> CellIndex:
    """The inverted-file index of the vectors, written by the first search of a session and read by all."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _CELLS:
        _CELLS[key] = cells.built(vectors(spark, sf), k=10)
    return _CELLS[key]


def ann_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Recall at 10 of the inverted-file index against exact search, and the shares of rows whose codes and whose vectors it read, per query."""
    corpus, index = vectors(spark, sf), _cells(spark, sf)
    queries = asked(corpus)
    approx = cells.searched(spark, index, queries).select("query_id", "chunk_id", F.lit(1).alias("hit"))
    exact = V.nearest(corpus, queries, 10).select("query_id", "chunk_id")
    recall = exact.join(approx, ["query_id", "chunk_id"], "left").groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    return recall.join(cells.looked(spark, index, queries), "query_id")


def ann_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the index passes: mean recall at 10 of 0.9 or more over all queries, with no more than half of the vectors read."""
    found = ann_recall(spark, sf)
    return found.agg(F.count(F.lit(1)).alias("queries"), (F.avg("recall") >= 0.9).alias("recalled"), (F.avg("vectors") <= 0.5).alias("sparing"))


def ann_exact(spark: SparkSession, sf: str) -> DataFrame:
    """The index's exact way: all cells and all codes."""
    return cells.searched(spark, _cells(spark, sf), asked(vectors(spark, sf)), 10, probes=0, candidates=0).withColumn("similarity", F.round("similarity", 6))


def ann_added(spark: SparkSession, sf: str) -> DataFrame:
    """An index of a half of the rows that the other half is added to: every row is in one cell, and is its own nearest row."""
    corpus = vectors(spark, sf)
    index = cells.added(cells.built(corpus.filter("chunk_id % 2 = 0"), k=1, cells=4), corpus.filter("chunk_id % 2 = 1"))
    found = cells.searched(spark, index, asked(corpus), 1, probes=2, candidates=40)
    rows = index.table(spark).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("cells"))
    return rows.join(found.select(F.col("query_id").alias("chunk_id"), F.col("chunk_id").alias("nearest")), "chunk_id", "left")


_INDEXES: dict[tuple[str, str, str], TextIndex] = {}


def _index(spark: SparkSession, sf: str, by: str = "tokens") -> TextIndex:
    """The index of the documents, by tokens or by their English stems, written by the first search of a session and read by all."""
    key = (spark.sparkContext.applicationId, sf, by)
    if key not in _INDEXES:
        terms = X.tokens if by == "tokens" else lambda text: stems.stems(X.tokens(text))
        _INDEXES[key] = TextIndex.new(spark).put(table(spark, sf, "documents").select("doc_id", "text"), "v1", terms)
    return _INDEXES[key]


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", F.array_distinct(X.tokens("text")).alias("words"))


SQL_TERMS = r"""
  terms AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents)"""


def fts_and_match(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy("doc_id")
    hits = text_index.all_words(_index(spark, sf), _items(spark, sf), "v1").select("item_id", "doc_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter("rank <= 5")


def fts_or_keywords(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "benchmark").select("item_id", F.explode(X.keywords("text")).alias("term"))
    return text_index.most_words(_index(spark, sf), asked, 5, "v1")


def fts_versions(spark: SparkSession, sf: str) -> DataFrame:
    """An index of three versions: one replaced, one dropped. Documents that hold all of some frequent words, by version."""
    docs, base = table(spark, sf, "documents").select("doc_id", "text"), TextIndex.new(spark, 8)
    for version in (0, 1, 2):
        base.put(docs.filter(F.col("doc_id") % 3 == version), f"v{version}")
    base.put(docs.filter(F.col("doc_id") % 6 == 1), "v1")
    base.drop("v2")
    words = table(spark, sf, "region").select(F.col("r_regionkey").alias("item_id"), F.array(*[F.get(F.array(*[F.lit(w) for w in X.FREQUENT_WORDS]), (F.col("r_regionkey") + n) % 6) for n in (0, 1)]).alias("words"))
    found = [text_index.all_words(base, words, v).select("item_id", "doc_id", F.lit(v).alias("version")) for v in ("v0", "v1", "v2")]
    return found[0].unionByName(found[1]).unionByName(found[2])


def fts_or_english(spark: SparkSession, sf: str) -> DataFrame:
    """As fts_or_keywords, by English stems, so that inflected words meet."""
    asked = table(spark, sf, "benchmark").select("item_id", F.explode(F.array_distinct(stems.stems(X.keywords("text")))).alias("term"))
    return text_index.most_words(_index(spark, sf, "stems"), asked, 5, "v1")


SQL_ITEM_WORDS = r"""
  words AS (SELECT item_id, list_filter(w, lambda x, i: list_position(w, x) = i) AS words FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark)),
  one AS (SELECT item_id, len(words) AS needed, unnest(words) AS term FROM words)"""

STOPS = ", ".join(f"'{w}'" for w in X.FREQUENT_WORDS)
def fts_rank_cd(spark: SparkSession, sf: str) -> DataFrame:
    """The five documents of greatest cover density for all words of an item."""
    best = Window.partitionBy("item_id").orderBy(F.desc("density"), "doc_id")
    return text_index.cover_density(_index(spark, sf), _items(spark, sf), "v1").withColumn("rank", F.row_number().over(best)).filter("rank <= 5")


def _arms(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Nearest by cosine; and, as a second opinion, the nearest among rows of the query's label."""
    corpus = vectors(spark, sf)
    kinds = corpus.select("chunk_id", kind().alias("source_type"))
    first = V.nearest(corpus, asked(corpus), 15).select("query_id", "chunk_id", "rank").join(kinds, "chunk_id")
    tagged = corpus.withColumn("tag", F.col("label").cast("string"))
    second = V.nearest(tagged, asked(tagged), 15, allowed="none").select("query_id", "chunk_id", "rank").join(kinds, "chunk_id")
    return first, second


SQL_ARMS = f"""
  kinds AS (SELECT vec_id AS chunk_id, {SQL_KIND} AS source_type FROM embeddings),
  first AS (SELECT r.query_id, r.chunk_id, r.rank, source_type FROM ({_ranked_sql(15)}) r JOIN kinds USING (chunk_id)),
  second AS (SELECT r.query_id, r.chunk_id, r.rank, source_type FROM ({_ranked_sql(15, "q.label = c.label")}) r JOIN kinds USING (chunk_id))"""


def _fused_sql(k: int, w0: str = "1.0", w1: str = "1.0", boost: str = SQL_BOOST) -> str:
    return f"""
  WITH {SQL_ARMS},
  scored AS (SELECT query_id, chunk_id, round(sum(w * {boost} / (60 + rank)), 9) AS score, min(arm) AS arm,
      min(CASE WHEN arm = 0 THEN rank END) AS rank_0, min(CASE WHEN arm = 1 THEN rank END) AS rank_1
    FROM (SELECT *, 0 AS arm, {w0}::DOUBLE AS w FROM first UNION ALL SELECT *, 1 AS arm, {w1}::DOUBLE AS w FROM second) GROUP BY 1, 2)
  SELECT query_id, chunk_id, score, rank FROM (SELECT query_id, chunk_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id
    ORDER BY scored.score DESC, arm, rank_0 NULLS LAST, rank_1 NULLS LAST, chunk_id) AS INTEGER) AS rank FROM scored) WHERE rank <= {k}"""


def rrf_fuse(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.fuse(*_arms(spark, sf), k=5).withColumn("score", F.round("score", 6))


def rrf_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.fuse(*_arms(spark, sf), k=5, second_weight=0.3, boosted=False).withColumn("score", F.round("score", 6))


CONFIGS = {"raw": (1.0, 1.0), "strong": (1.10, 1.05), "medium": (1.05, 1.025), "mild": (1.02, 1.01)}


def authority_rerank_sweep(spark: SparkSession, sf: str) -> DataFrame:
    first, _ = _arms(spark, sf)
    configs = spark.createDataFrame([(n, *b) for n, b in CONFIGS.items()], "config string, errata double, patch_notes double")
    rows = first.crossJoin(F.broadcast(configs))
    factor = F.when(F.col("source_type") == "errata", F.col("errata")).when(F.col("source_type") == "patch_notes", F.col("patch_notes")).otherwise(1.0)
    rows = rows.withColumn("score", F.round(factor / (fusion.RRF_K + F.col("rank")), 9))
    order = Window.partitionBy("config", "query_id").orderBy(F.desc("score"), "rank")
    ranked = rows.withColumn("new_rank", F.row_number().over(order)).filter("new_rank <= 5")
    return ranked.select("config", "query_id", "chunk_id", "new_rank")


SQL_SWEEP = f"""
  WITH {SQL_ARMS}, configs AS (SELECT * FROM (VALUES {", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE)" for n, (a, b) in CONFIGS.items())}) t(config, errata, patch_notes))
  SELECT config, query_id, chunk_id, new_rank FROM (SELECT config, query_id, chunk_id, CAST(row_number() OVER (PARTITION BY config, query_id ORDER BY
    round(CASE source_type WHEN 'errata' THEN errata WHEN 'patch_notes' THEN patch_notes ELSE 1.0 END / (60 + rank), 9) DESC, rank) AS INTEGER) AS new_rank
    FROM first, configs) WHERE new_rank <= 5"""


def _printings(spark: SparkSession, sf: str) -> DataFrame:
    content = F.concat(F.lit("**Name**: "), F.initcap("p_name"), F.lit(" ("), F.col("p_brand"), F.lit(") | **Type**: "), F.col("p_type"))
    return table(spark, sf, "part").select("p_partkey", "p_type", F.when(F.col("p_partkey") % 11 != 0, content).otherwise(F.col("p_name")).alias("content"))


def dedup_printings(spark: SparkSession, sf: str) -> DataFrame:
    rows = _printings(spark, sf).withColumn("key", F.coalesce(X.printing_key("content"), F.col("p_partkey").cast("string")))
    return fusion.keep_first(rows, ["p_type"], "key", ["p_partkey"]).select("p_type", "key", "p_partkey")


SQL_DEDUP = r"""
  WITH rows AS (SELECT p_partkey, p_type, CASE WHEN p_partkey % 11 <> 0 THEN p_name ELSE CAST(p_partkey AS VARCHAR) END AS key FROM part)
  SELECT p_type, key, min(p_partkey) AS p_partkey FROM rows GROUP BY 1, 2"""

TAGS = ("small ring", "red", "b_lt", "gear", "BLUE", "zzz")


def tagged_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """At most two rows per tag, cards first; a row that several tags find stays with the first. `_` and `%` in a tag are wildcards."""
    tags = spark.createDataFrame(list(enumerate(TAGS)), "ord int, pattern string")
    rows = table(spark, sf, "part").select("p_partkey", "p_name", F.col("p_type").alias("source_type"))
    hits = substring.containing(rows, tags, "p_partkey", "p_name").withColumnRenamed("pattern", "tag")
    order = Window.partitionBy("ord").orderBy(F.desc(F.col("source_type") == "PROMO"), F.desc(F.col("source_type") == "SMALL"), "p_partkey")
    two = hits.withColumn("n", F.row_number().over(order)).filter("n <= 2")
    return fusion.keep_first(two, [], "p_partkey", ["ord"]).select("ord", "tag", "n", "p_partkey")


def substring_search(spark: SparkSession, sf: str) -> DataFrame:
    """Names that hold a part of some nation's or region's name, with wildcards in some: how many, and the least."""
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("ord"), F.concat(F.substring("n_name", 2, 2), F.when(F.col("n_nationkey") % 3 == 0, "%").otherwise("")).alias("pattern"))
    regions = table(spark, sf, "region").select((F.col("r_regionkey") + 100).alias("ord"), F.when(F.col("r_regionkey") == 0, "__%_").otherwise(F.concat(F.substring("r_name", 1, 1), F.lit("_"), F.substring("r_name", 3, 1))).alias("pattern"))
    customers = table(spark, sf, "part").select("p_partkey", "p_name")
    found = substring.containing(customers, nations.unionByName(regions), "p_partkey", "p_name")
    return found.groupBy("ord", "pattern").agg(F.count(F.lit(1)).alias("names"), F.min("p_partkey").alias("least"))


SQL_TAGGED = f"""
  WITH tags AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{t}')" for i, t in enumerate(TAGS))}) t(ord, tag)),
  two AS (SELECT * FROM (SELECT ord, tag, p_partkey, CAST(row_number() OVER (PARTITION BY ord ORDER BY (p_type = 'PROMO') DESC, (p_type = 'SMALL') DESC, p_partkey) AS INTEGER) AS n
    FROM part, tags WHERE lower(p_name) ILIKE '%' || tag || '%') WHERE n <= 2)
  SELECT ord, tag, n, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY ord) AS k FROM two) WHERE k = 1"""


def family_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """All rows of the sections that some documents name, ordered by section and text."""
    docs = table(spark, sf, "documents")
    wanted = docs.filter("doc_id in (3, 17, 23)").select("source").distinct()
    return docs.join(wanted, "source", "left_semi").select("source", "doc_id", X.preview("text", 20).alias("head"))


def sibling_expand(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that share a parent with a seen row, less the seen ones, and what they would add in tokens."""
    docs = table(spark, sf, "documents").withColumn("parent", F.concat_ws("/", "lang", "source"))
    seen = docs.filter("doc_id % 97 = 0")
    siblings = docs.join(seen.select("parent").distinct(), "parent", "left_semi").join(seen.select("doc_id"), "doc_id", "left_anti")
    return siblings.groupBy("parent").agg(F.count("*").alias("siblings"), F.floor(F.sum(F.length("text")) / 4).cast("long").alias("tokens"))


def retrieve(spark: SparkSession, sf: str) -> DataFrame:
    """The retrieval core: two arms, boosted fusion, one row per printing, citations with previews."""
    fused = fusion.fuse(*_arms(spark, sf), k=15)
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "source", "lang", X.preview("text", 80).alias("content_preview"))
    rows = fused.join(docs, "chunk_id").withColumn("key", F.concat_ws("/", "source", "lang"))
    first = fusion.keep_first(rows, ["query_id"], "key", ["rank"])
    order = Window.partitionBy("query_id").orderBy("rank")
    top = first.withColumn("position", F.row_number().over(order)).filter("position <= 5")
    return top.select("query_id", "position", "chunk_id", "source", "content_preview")


SQL_RETRIEVE = f"""
  WITH fused AS ({_fused_sql(15)}),
  first AS (SELECT * FROM (SELECT f.*, d.source, d.lang, left(d.text, 80) AS content_preview,
      row_number() OVER (PARTITION BY query_id, source, lang ORDER BY rank) AS n FROM fused f JOIN documents d ON d.doc_id = f.chunk_id) WHERE n = 1)
  SELECT query_id, position, chunk_id, source, content_preview FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS position FROM first) WHERE position <= 5"""

QUERIES = {
    f.__name__: f
    for f in (
        vector_topk, vector_topk_set_filter, vector_normalize_dot, ann_recall, ann_gate, ann_exact, ann_added, fts_and_match, fts_or_keywords, fts_or_english, fts_rank_cd, fts_versions, rrf_fuse, rrf_weighted,
        authority_rerank_sweep, dedup_printings, tagged_lookup, substring_search, family_lookup, sibling_expand, retrieve,
    )
}

ORACLE = {
    "vector_topk": f"SELECT query_id, chunk_id, rank, round(similarity, 6) AS similarity FROM ({_ranked_sql(15)})",
    "ann_gate": "SELECT count(*) AS queries, true AS recalled, true AS sparing FROM embeddings WHERE vec_id % 50 = 0",
    "ann_exact": f"SELECT query_id, chunk_id, rank, round(similarity, 6) AS similarity FROM ({_ranked_sql(10)})",
    "ann_added": "SELECT vec_id AS chunk_id, CAST(1 AS BIGINT) AS cells, CASE WHEN vec_id % 50 = 0 THEN vec_id END AS nearest FROM embeddings",
    "vector_topk_set_filter": f"""SELECT query_id, chunk_id, rank, round(similarity, 6) AS similarity FROM (
      {_ranked_sql(5, "dq.doc_id = q.vec_id AND dc.doc_id = c.vec_id AND (dc.lang = dq.lang OR dc.lang = 'en')", ", documents dq, documents dc")})""",
    "vector_normalize_dot": """
      WITH unit AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings),
      scored AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_inner_product(q.u, c.u), 6) AS score FROM unit q, unit c WHERE q.vec_id % 50 = 0)
      SELECT query_id, chunk_id, rank, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM scored) WHERE rank <= 10""",
    "fts_and_match": f"""
      WITH {SQL_TERMS}, {SQL_ITEM_WORDS}, hits AS (SELECT item_id, doc_id FROM one JOIN terms USING (term) GROUP BY item_id, needed, doc_id HAVING count(*) = needed)
      SELECT item_id, doc_id, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS INTEGER) AS rank FROM hits) WHERE rank <= 5""",
    "fts_or_keywords": f"""
      WITH {SQL_TERMS}, q AS (SELECT item_id, list_filter(w, lambda x, i: list_position(w, x) = i) AS words FROM (
        SELECT item_id, list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) >= 3 AND x NOT IN ({STOPS})) AS w FROM benchmark)),
      one AS (SELECT item_id, unnest(words) AS term FROM q),
      hits AS (SELECT item_id, doc_id, count(*) AS hits FROM one JOIN terms USING (term) GROUP BY item_id, doc_id)
      SELECT item_id, doc_id, hits, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, doc_id) AS INTEGER) AS rank FROM hits) WHERE rank <= 5""",
    "fts_rank_cd": f"""
      WITH {SQL_TERMS}, {SQL_ITEM_WORDS}, hits AS (SELECT item_id, doc_id, needed FROM one JOIN terms USING (term) GROUP BY item_id, needed, doc_id HAVING count(*) = needed),
      w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents WHERE doc_id IN (SELECT doc_id FROM hits)),
      p AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM w),
      spots AS (SELECT h.item_id, h.doc_id, h.needed, pos, term FROM hits h JOIN one USING (item_id) JOIN p USING (doc_id, term)),
      ends AS (SELECT a.item_id, a.doc_id, a.needed, a.pos AS fin, b.term, max(b.pos) AS last FROM spots a JOIN spots b ON a.item_id = b.item_id AND a.doc_id = b.doc_id AND b.pos <= a.pos GROUP BY 1, 2, 3, 4, 5),
      spans AS (SELECT item_id, doc_id, fin, min(last) AS begin FROM ends GROUP BY item_id, doc_id, needed, fin HAVING count(*) = needed),
      covers AS (SELECT item_id, doc_id, begin, min(fin) AS fin FROM spans GROUP BY 1, 2, 3),
      sized AS (SELECT c.item_id, c.doc_id, c.begin, c.fin, count(*) AS inside FROM covers c JOIN spots s ON s.item_id = c.item_id AND s.doc_id = c.doc_id AND s.pos BETWEEN c.begin AND c.fin GROUP BY 1, 2, 3, 4),
      d AS (SELECT item_id, doc_id, round(sum({text_index.COVER_WEIGHT}::DOUBLE / (fin - begin - inside + 2)), 6) AS density FROM sized GROUP BY 1, 2)
      SELECT item_id, doc_id, density, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY density DESC, doc_id) AS INTEGER) AS rank FROM d) WHERE rank <= 5""".replace("\\\\", "\\"),
    "fts_versions": f"""
      WITH {SQL_TERMS}, f AS (SELECT [{", ".join(f"'{w}'" for w in X.FREQUENT_WORDS)}] AS f), one AS (SELECT r_regionkey AS item_id, unnest([f[r_regionkey % 6 + 1], f[(r_regionkey + 1) % 6 + 1]]) AS term FROM region, f)
      SELECT item_id, doc_id, CASE WHEN doc_id % 3 = 0 THEN 'v0' ELSE 'v1' END AS version FROM one JOIN terms USING (term) WHERE doc_id % 3 = 0 OR doc_id % 6 = 1 GROUP BY 1, 2, 3 HAVING count(*) = 2""",
    "rrf_fuse": _fused_sql(5),
    "rrf_weighted": _fused_sql(5, w1="0.3", boost="1.0::DOUBLE"),
    "authority_rerank_sweep": SQL_SWEEP,
    "dedup_printings": SQL_DEDUP,
    "tagged_lookup": SQL_TAGGED,
    "substring_search": """
      WITH p AS (SELECT n_nationkey AS ord, substring(n_name, 2, 2) || CASE WHEN n_nationkey % 3 = 0 THEN '%' ELSE '' END AS pattern FROM nation
        UNION ALL SELECT r_regionkey + 100, CASE WHEN r_regionkey = 0 THEN '__%_' ELSE substring(r_name, 1, 1) || '_' || substring(r_name, 3, 1) END FROM region)
      SELECT ord, pattern, count(*) AS names, min(p_partkey) AS least FROM p JOIN part ON lower(p_name) ILIKE '%' || pattern || '%' GROUP BY 1, 2""",
    "family_lookup": "SELECT source, doc_id, left(text, 20) AS head FROM documents WHERE source IN (SELECT source FROM documents WHERE doc_id IN (3, 17, 23))",
    "sibling_expand": """
      WITH d AS (SELECT *, lang || '/' || source AS parent FROM documents), seen AS (SELECT * FROM d WHERE doc_id % 97 = 0)
      SELECT parent, count(*) AS siblings, CAST(sum(length(text)) // 4 AS BIGINT) AS tokens FROM d
      WHERE parent IN (SELECT parent FROM seen) AND doc_id NOT IN (SELECT doc_id FROM seen) GROUP BY parent""",
    "retrieve": SQL_RETRIEVE,
}
