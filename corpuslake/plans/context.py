"""Entities, context assembly, routing, citations and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslake.functions import text as X
from corpuslake.functions import vectors as V
from corpuslake.operators import context, entities, lookup
from corpuslake.plans.retrieval import _ranked_sql, asked, vectors
from corpuslake.sources.tables import table

WORDS = ("anther", "are", "for", "from", "her", "not", "that", "the", "was", "with")
ALIASES = {"of": "that", "and": "zeal"}


def with_keywords(rows: DataFrame, column: str = "text") -> DataFrame:
    """`keywords` of each text: known words in order, then what aliases stand for. A text is read once, into its known
    words and aliases."""
    marks = F.array(*[F.lit(w) for w in (*WORDS, *ALIASES)])
    rows = rows.withColumn("__seen", F.array_intersect(marks, F.split(F.lower(column), "[^a-z]+")))
    direct = F.array_intersect(F.array(*[F.lit(w) for w in WORDS]), "__seen")
    meant = F.array_compact(F.array(*[F.when(F.array_contains("__seen", a), F.lit(c)) for a, c in ALIASES.items()]))
    return rows.withColumn("keywords", F.array_union(direct, meant)).drop("__seen")


#: The one name that each derived question asks for.
SQL_ASKED = """asked AS (SELECT p_partkey AS id, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') AS n FROM part)"""

SQL_SEEN = "list_distinct(regexp_split_to_array(lower(text), '[^a-z]+'))"
SQL_KEYWORDS = f"""(list_filter([{", ".join(f"'{w}'" for w in WORDS)}], lambda w: list_contains(seen, w)) || list_filter(
   [{", ".join(f"CASE WHEN list_contains(seen, '{a}') THEN '{c}' END" for a, c in ALIASES.items())}],
   lambda c: c IS NOT NULL AND NOT (list_contains([{", ".join(f"'{w}'" for w in WORDS)}], c) AND list_contains(seen, c))))"""


def keyword_detect(spark: SparkSession, sf: str) -> DataFrame:
    docs = with_keywords(table(spark, sf, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.array_join("keywords", ",").alias("keywords"))


#: Keywords with their groups and what their aliases are: a dimension of fixed size.
KEYWORDS = [(w, "long" if len(w) > 3 else "short", None) for w in WORDS] + [(a, "alias", c) for a, c in ALIASES.items()]


def keyword_join(spark: SparkSession, sf: str) -> DataFrame:
    """The keyword dimension joined to the words of texts: how many texts name each keyword, itself or by an alias, by language."""
    dimension = spark.createDataFrame(KEYWORDS, "word string, kind string, canonical string")
    words = table(spark, sf, "documents").select("lang", "doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))).alias("word"))
    found = words.join(F.broadcast(dimension), "word").select("lang", "doc_id", F.coalesce("canonical", "word").alias("keyword"), "kind")
    return found.groupBy("lang", "keyword", "kind").agg(F.count(F.lit(1)).alias("texts"))


def separator_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Names as written with assorted separators, met by their normal form."""
    part = table(spark, sf, "part")
    written = F.concat(F.lit(" "), F.initcap(F.replace("p_name", F.lit(" "), F.when(F.col("p_partkey") % 2 == 0, " – ").otherwise("-"))), F.lit(" - "))
    index = part.groupBy(X.normal_separators("p_name").alias("key")).agg(F.min("p_partkey").alias("first"))
    return part.select("p_partkey", X.normal_separators(written).alias("key")).join(index, "key", "left").select("p_partkey", "first")


def tags_extract(spark: SparkSession, sf: str) -> DataFrame:
    """@tags, the text without them, and what is left of known words after the tags."""
    marked = table(spark, sf, "conversations").select("conv_id", "turn", F.regexp_replace("text", r"(^|\s)([A-Za-z]{3,})\.", "$1@$2-x ").alias("text"))
    tags = X.tags("text")
    return marked.select(
        "conv_id", "turn", F.array_join(F.array_distinct(tags), ",").alias("tags"), F.length(X.without_tags("text")).cast("long").alias("clean_chars"),
        F.array_join(F.array_except(F.array(*[F.lit(w) for w in WORDS]), tags), ",").alias("auto_only"),
    )


def _names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.initcap("p_name").alias("name")).distinct()


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    """Questions that name parts, whole and scattered."""
    part = table(spark, sf, "part")
    words = F.split(F.initcap("p_name"), " ")
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("How does "), F.initcap("p_name"), F.lit("'s ring work with red "), F.element_at(words, 1), F.lit("?")))
    text = text.when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("Is "), F.element_at(words, 2), F.lit(" the "), F.element_at(words, 1), F.lit(" stronger?")))
    return part.select(F.col("p_partkey").alias("id"), text.otherwise(F.concat(F.lit("what about "), F.col("p_name"))).alias("text"))


def card_mentions_exact(spark: SparkSession, sf: str) -> DataFrame:
    found = entities.mentions(_questions(spark, sf), _names(spark, sf), frozenset(WORDS))
    return found.select("id", F.array_join("names", ",").alias("names"))


def card_mentions_window(spark: SparkSession, sf: str) -> DataFrame:
    """How often each name is found, exactly or within a window of four words."""
    found = entities.mentions(_questions(spark, sf), _names(spark, sf))
    return found.select(F.explode("names").alias("name")).groupBy("name").count()


def champion_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """Tags found in questions by their spans: one of a single name resolves, one of several only counts as ambiguous."""
    nation = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("tag"))
    owners = table(spark, sf, "supplier").filter("s_nationkey % 3 > 0 or s_suppkey < 12").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("tag", F.col("s_name").alias("name"))
    first, second = (nation.select(F.col("n_nationkey").alias(k), F.col("tag").alias(t)) for k, t in (("k1", "t1"), ("k2", "t2")))
    customer = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("k1"), ((F.col("c_nationkey") + F.col("c_custkey")) % 25).cast("int").alias("k2"))
    text = F.concat(F.lit("Can "), "t1", F.lit("'s legend stop "), "t2", F.lit("?"))
    questions = customer.join(first, "k1").join(second, "k2").select(F.col("c_custkey").alias("id"), text.alias("text"))
    out = entities.resolved(entities.mentions(questions, nation.select(F.col("tag").alias("name")), cap=None), owners)
    return out.select(F.col("id").alias("c_custkey"), F.array_join("names", ",").alias("resolved"), "ambiguous")


def segment_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols, names, keywords and plain pieces of texts; brackets against keywords dropped."""
    part = table(spark, sf, "part")
    text = F.concat(F.lit("Pay :rb_energy_2: for "), F.initcap(F.regexp_replace("p_name", " ", " - ")), F.lit(", then [THE] or :rb_zzz: Not, from "), F.col("p_partkey").cast("string"))
    rows = entities.segmented(part.select(F.col("p_partkey").alias("id"), text.alias("text")), part.select(F.col("p_name").alias("name")), list(WORDS), bare=True)
    return rows.withColumnRenamed("id", "p_partkey")


def card_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Names of questions: detected and mentioned ones, once each, and those that could be several."""
    orders = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_linenumber") < 4, F.col("l_suppkey") % 9)).alias("autos"), F.collect_set(F.when(F.col("l_linenumber") > 2, F.col("l_suppkey") % 9)).alias("mentions"))
    return orders.select("l_orderkey", context.card_count(F.col("autos"), F.col("mentions"), F.col("l_orderkey") % 2).cast("long").alias("cards"))


def mention_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions in texts as users type them: the first ten that are names, and the mark at the end of what is typed so far."""
    part = table(spark, sf, "part")
    index = part.select("p_partkey", F.lower("p_name").alias("name")).groupBy("name").agg(F.min("p_partkey").alias("pos"))
    slug = F.regexp_replace("p_name", " ", "-")
    text = F.concat(F.lit("does @"), slug, F.lit(" or @"), F.substring("p_name", 1, 3), F.lit(" beat @nobody-x, @"), slug, F.lit(" #"), F.substring("p_type", 1, 3))
    rows = part.select("p_partkey", text.alias("text"))
    typed = rows.select("p_partkey", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?i)@([a-z0-9-]+)"), F.lit(1))).alias("pos", "asked"))
    found = typed.join(lookup.cascade(typed.select("asked").distinct(), index), "asked").filter("found is not null")
    first = found.groupBy("p_partkey", "found").agg(F.min("pos").alias("pos"))
    names = first.groupBy("p_partkey").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("pos", "found"))), lambda x: x["found"]), 1, 10).alias("names"))
    at = X.mention_at_cursor("text")
    return rows.join(names, "p_partkey", "left").select("p_partkey", F.array_join("names", ",").alias("names"), at["sigil"].alias("sigil"), at["typed"].alias("typed"), F.md5(X.sent_question("text")).alias("sent"))


def _lists(spark: SparkSession, sf: str) -> DataFrame:
    """Four ranked lists per query, from the nearest rows by cosine."""
    corpus = vectors(spark, sf)
    near = V.nearest(corpus, asked(corpus), 12).select("query_id", F.struct("rank", "chunk_id").alias("r"))
    ids = F.transform(F.array_sort(F.collect_list("r")), lambda r: r["chunk_id"])
    grouped = near.groupBy("query_id").agg(ids.alias("ids"))
    return grouped.select(
        "query_id", "ids",
        F.filter("ids", lambda x: x % 5 == 0).alias("explicit"), F.slice("ids", 2, 7).alias("semantic"),
        F.filter("ids", lambda x: x % 7 == 0).alias("rules"), F.reverse("ids").alias("autos"),
    )


SQL_LISTS = f"""lists AS (SELECT query_id, ids, list_filter(ids, lambda x: x % 5 = 0) AS e, list_slice(ids, 2, 8) AS s, list_filter(ids, lambda x: x % 7 = 0) AS r, list_reverse(ids) AS a
  FROM (SELECT query_id, list(chunk_id ORDER BY rank) AS ids FROM ({_ranked_sql(12)}) GROUP BY 1))"""


def _sql_assemble(k: int) -> str:
    """The same budget by ranking all candidates: a phase's rows count only up to its limit."""
    step = lambda n, prev, more, limit: f"""
      s{n} AS (SELECT *, c || list_slice(list_filter({more}, lambda x: NOT list_contains(c, x)), 1, greatest({limit} - len(c), 0)) AS c2 FROM {prev}),
      t{n} AS (SELECT * EXCLUDE (c, c2), c2 AS c FROM s{n})"""  # noqa: E731
    wait = f"CASE WHEN len(list_filter(r, lambda x: NOT list_contains(c, x))) > 0 THEN {k - 1} ELSE {k} END"
    return (
        f"t0 AS (SELECT *, list_slice(e, 1, CASE WHEN len(s) > 0 THEN {k - 1} ELSE {k} END) AS c FROM lists),"
        + ",".join([step(1, "t0", "s", wait), step(2, "t1", "r", k), step(3, "t2", "s", k), step(4, "t3", "a", k)])
    )


def context_assemble(spark: SparkSession, sf: str) -> DataFrame:
    chosen = context.assemble(F.col("explicit"), F.col("semantic"), F.col("rules"), F.col("autos"), 5)
    return _lists(spark, sf).select("query_id", F.array_join(chosen, ",").alias("context"))


def family_complete(spark: SparkSession, sf: str) -> DataFrame:
    """Up to three rows of the first context row's source that the context lacks."""
    rows = _lists(spark, sf).select("query_id", F.slice("ids", 1, 5).alias("context"))
    docs = table(spark, sf, "documents").select("doc_id", "source")
    firsts = rows.withColumn("doc_id", F.element_at("context", 1)).join(docs, "doc_id").select("query_id", "context", "source")
    # Five of a source's rows may be in the context, so that the first three others are among its first eight.
    heads = docs.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).filter("n <= 8")
    family = heads.join(firsts, "source").groupBy("query_id", "context").agg(F.array_sort(F.collect_list("doc_id")).alias("family"))
    return family.select("query_id", F.array_join(context.complete_family(F.col("context"), F.col("family"), 3), ",").alias("context"))


def exact_match_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Confidence of each query: 1 where a context row's section names its tag as a whole word."""
    corpus = vectors(spark, sf)
    near = V.nearest(corpus, asked(corpus), 5)
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.concat_ws(" ", "lang", "source").alias("section"))
    tags = F.concat(F.lit("src"), (F.col("query_id") % 13).cast("string"))
    rows = near.join(docs, "chunk_id").withColumn("hit", F.array_contains(F.split("section", " "), tags))
    out = rows.groupBy("query_id").agg(F.max("similarity").alias("best"), F.count("*").alias("cited"), F.bool_or("hit").alias("exact"))
    return out.select("query_id", "exact", F.round(context.confidence(F.col("best"), F.col("cited"), F.coalesce("exact", F.lit(False))), 4).alias("confidence"))


def route_hard(spark: SparkSession, sf: str) -> DataFrame:
    docs = with_keywords(table(spark, sf, "documents").select("doc_id", "text"))
    sized = docs.select("doc_id", "text", F.size("keywords").cast("long").alias("keywords"), (F.size(F.split("text", "[.]")) % 4).cast("long").alias("cards"))
    hard = context.routed(F.col("doc_id") % 7 > 0, context.is_hard(F.col("cards"), F.col("keywords")))
    return sized.select("doc_id", "keywords", "cards", hard.alias("hard"), context.needs_scaffold(F.col("text"), F.col("cards")).alias("scaffold"))


def stuffed_context(spark: SparkSession, sf: str) -> DataFrame:
    """Sections of detected names, then of extra names, one text each; the whole book last."""
    part = table(spark, sf, "part")
    sections = part.groupBy(F.lower("p_name").alias("name")).agg(F.max_by("p_type", "p_partkey").alias("section"))
    asked = table(spark, sf, "benchmark").select("item_id", F.array(F.lit("Small Ring"), F.element_at(F.array(F.lit(" RED bolt"), F.lit("hot gear"), F.lit("small ring")), (F.col("item_id") % 3 + 1).cast("int"))).alias("names"))
    wanted = asked.select("item_id", F.posexplode(F.array_distinct(F.transform("names", lambda n: F.lower(F.trim(n))))).alias("pos", "name"))
    found = wanted.join(sections, "name").select("item_id", F.col("pos").cast("int").alias("pos"), "name", "section")
    book = asked.select("item_id", F.lit(99).alias("pos"), F.lit("rulebook").alias("name"), F.lit("all").alias("section"))
    return found.unionByName(book)


def citations_build(spark: SparkSession, sf: str) -> DataFrame:
    """Citations that the context holds, by similarity, with previews and codes; whether any was dropped."""
    corpus = vectors(spark, sf)
    near = V.nearest(corpus, asked(corpus), 6)
    cited = near.withColumn("valid", F.col("chunk_id") % 4 != 1)
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "lang", X.preview("text").alias("preview"), F.array_join(F.array_sort(X.rule_codes("text")), ",").alias("codes"))
    dropped = Window.partitionBy("query_id")
    rows = cited.withColumn("any_dropped", F.bool_or(~F.col("valid")).over(dropped)).filter("valid").join(docs, "chunk_id")
    by = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "rank")
    return rows.select("query_id", "chunk_id", F.row_number().over(by).alias("position"), "lang", "preview", "codes", "any_dropped")


def prompt_render(spark: SparkSession, sf: str) -> DataFrame:
    """Numbered context blocks between fixed delimiters, then the question; items share 40 contexts."""
    docs = table(spark, sf, "documents").select(F.pmod("doc_id", F.lit(40)).alias("part"), "doc_id", X.preview("text", 40).alias("head"))
    by = Window.partitionBy("part").orderBy("doc_id")
    top = docs.withColumn("n", F.row_number().over(by)).filter("n <= 3")
    block = F.concat(F.lit("[#"), F.col("n").cast("string"), F.lit("] "), F.col("head"))
    blocks = top.groupBy("part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", block.alias("b")))), lambda x: x["b"]), "\n").alias("context"))
    asked = table(spark, sf, "benchmark").withColumn("part", F.pmod("item_id", F.lit(40)))
    prompt = F.concat(F.lit("<context>\n"), F.coalesce("context", F.lit("")), F.lit("\n</context>\nQuestion: "), F.col("text"))
    return asked.join(blocks, "part", "left").select("item_id", F.sha2(prompt, 256).alias("prompt_sha"), F.length(prompt).cast("long").alias("chars"))


QUERIES = {
    f.__name__: f
    for f in (
        keyword_detect, keyword_join, separator_keys, tags_extract, card_mentions_exact, card_mentions_window, champion_resolve, segment_entities, card_counts, mention_lookup, context_assemble, family_complete,
        exact_match_confidence, route_hard, stuffed_context, citations_build, prompt_render,
    )
}

ORACLE = {
    "keyword_detect": f"SELECT doc_id, array_to_string({SQL_KEYWORDS}, ',') AS keywords FROM (SELECT doc_id, {SQL_SEEN} AS seen FROM documents)",
    "card_mentions_exact": f"""
      WITH {SQL_ASKED} SELECT id, n AS names FROM asked""",
    "card_mentions_window": f"""
      WITH {SQL_ASKED} SELECT n AS name, count(*) AS count FROM asked GROUP BY 1""",
    "segment_entities": """
      WITH p AS (SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' - ') AS n FROM part),
      s AS (SELECT p_partkey, [['text', 'Pay '], ['rune', ':rb_energy_2:'], ['text', ' '], ['keyword', 'for'], ['text', ' '], ['name', n], ['text', ', then '], ['keyword', 'THE'], ['text', ' or :rb_zzz: '], ['keyword', 'Not'], ['text', ', '], ['keyword', 'from'], ['text', ' ' || p_partkey]] AS s FROM p)
      SELECT p_partkey, CAST(i - 1 AS INTEGER) AS pos, s[i][1] AS kind, s[i][2] AS segment FROM (SELECT p_partkey, s, unnest(range(1, 14)) AS i FROM s)""",
    "card_counts": """
      SELECT l_orderkey, count(DISTINCT l_suppkey % 9) FILTER (l_linenumber < 4 OR l_linenumber > 2) + l_orderkey % 2 AS cards FROM lineitem GROUP BY 1""",
    "mention_lookup": """
      WITH i AS (SELECT lower(p_name) AS name, min(p_partkey) AS pos FROM part GROUP BY 1),
      a AS (SELECT DISTINCT left(p_name, 3) AS q FROM part), f AS (SELECT q, arg_min(name, pos) AS hit FROM a JOIN i ON starts_with(name, lower(trim(regexp_extract(q, '^[A-Za-z0-9-]+')))) GROUP BY 1)
      SELECT p_partkey, CASE WHEN hit = lower(p_name) THEN hit ELSE lower(p_name) || ',' || hit END AS names, '#' AS sigil, left(p_type, 3) AS typed,
        md5('does ' || replace(p_name, ' ', '-') || ' or ' || left(p_name, 3) || ' beat nobody-x, ' || replace(p_name, ' ', '-') || ' #' || left(p_type, 3)) AS sent
      FROM part JOIN f ON q = left(p_name, 3)""",
    "keyword_join": f"""WITH k AS (SELECT * FROM (VALUES {", ".join(f"('{w}', '{k}', {repr(c) if c else 'NULL'})" for w, k, c in KEYWORDS)}) t(word, kind, canonical)),
      w AS (SELECT DISTINCT lang, doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM documents)
      SELECT lang, coalesce(canonical, word) AS keyword, kind, count(*) AS texts FROM w JOIN k USING (word) GROUP BY 1, 2, 3""",
    "separator_keys": "SELECT p_partkey, min(p_partkey) OVER (PARTITION BY lower(p_name)) AS first FROM part",
    "tags_extract": rf"""
      WITH m AS (SELECT conv_id, turn, regexp_replace(text, '(^|\s)([A-Za-z]{{3,}})\.', '\1@\2-x ', 'g') AS text FROM conversations),
      t AS (SELECT *, list_transform(regexp_extract_all(text, '@([0-9A-Za-z_\p{{L}}]+)', 1), lambda x: lower(x)) AS tags FROM m)
      SELECT conv_id, turn, array_to_string(list_filter(tags, lambda x, i: list_position(tags, x) = i), ',') AS tags,
        length(trim(regexp_replace(text, '@[0-9A-Za-z_\p{{L}}]+', '', 'g'))) AS clean_chars,
        array_to_string(list_filter([{", ".join(f"'{w}'" for w in WORDS)}], lambda w: NOT list_contains(tags, w)), ',') AS auto_only FROM t""",
    "champion_resolve": """
      WITH t AS (SELECT s_nationkey AS k, count(DISTINCT s_name) AS n, min(s_name) AS name FROM supplier WHERE s_nationkey % 3 > 0 OR s_suppkey < 12 GROUP BY 1),
      q AS (SELECT c_custkey, c_nationkey AS k, 0 AS o FROM customer UNION ALL SELECT c_custkey, (c_nationkey + c_custkey) % 25, 1 FROM customer WHERE c_custkey % 25 <> 0)
      SELECT c_custkey, coalesce(string_agg(CASE WHEN n = 1 THEN name END, ',' ORDER BY o), '') AS resolved, count(*) FILTER (n > 1) AS ambiguous FROM q LEFT JOIN t USING (k) GROUP BY 1""",
    "context_assemble": f"WITH {SQL_LISTS}, {_sql_assemble(5)} SELECT query_id, array_to_string(c, ',') AS context FROM t4",
    "family_complete": f"""
      WITH {SQL_LISTS}, f AS (SELECT query_id, list_slice(ids, 1, 5) AS c, source FROM lists JOIN documents ON doc_id = ids[1]),
      g AS (SELECT query_id, c, list(doc_id ORDER BY doc_id) AS fam FROM f JOIN documents d USING (source) GROUP BY 1, 2)
      SELECT query_id, array_to_string(c || list_slice(list_filter(fam, lambda x: NOT list_contains(c, x)), 1, 3), ',') AS context FROM g""",
    "exact_match_confidence": f"""
      SELECT query_id, bool_or('src' || (query_id % 13) = source) AS exact,
        CASE WHEN bool_or('src' || (query_id % 13) = source) THEN 1.0::DOUBLE ELSE round(max(similarity), 4) END AS confidence
      FROM ({_ranked_sql(5)}) JOIN documents ON doc_id = chunk_id GROUP BY 1""",
    "route_hard": f"""
      WITH k AS (SELECT doc_id, text, len({SQL_KEYWORDS}) AS keywords, len(regexp_split_to_array(text, '[.]')) % 4 AS cards
        FROM (SELECT doc_id, text, {SQL_SEEN} AS seen FROM documents))
      SELECT doc_id, keywords, cards, doc_id % 7 > 0 AND (cards >= 2 OR (cards >= 1 AND keywords >= 2)) AS hard,
        cards >= 2 OR regexp_matches(text, '(?i)(^|[^0-9A-Za-z_\\p{{L}}])(if|then|simultaneously|whenever|at the same time)($|[^0-9A-Za-z_\\p{{L}}])') AS scaffold FROM k""".replace("\\\\", "\\"),
    "stuffed_context": """
      WITH s AS (SELECT lower(p_name) AS name, arg_max(p_type, p_partkey) AS section FROM part GROUP BY 1),
      q AS (SELECT item_id, 0 AS pos, 'small ring' AS name FROM benchmark UNION ALL
        SELECT item_id, 1, ['red bolt', 'hot gear', 'small ring'][item_id % 3 + 1] FROM benchmark WHERE item_id % 3 <> 2)
      SELECT item_id, pos, name, section FROM q JOIN s USING (name) UNION ALL SELECT item_id, 99, 'rulebook', 'all' FROM benchmark""",
    "citations_build": rf"""
      WITH n AS (SELECT *, bool_or(chunk_id % 4 = 1) OVER (PARTITION BY query_id) AS any_dropped FROM ({_ranked_sql(6)}))
      SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, rank) AS INTEGER) AS position, lang, left(text, 200) AS preview,
        array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\b\d{{3}}(?:\.(?:\d+|[a-z]))*\b'))), ',') AS codes, any_dropped
      FROM n JOIN documents ON doc_id = chunk_id WHERE chunk_id % 4 <> 1""",
    "prompt_render": """
      WITH t AS (SELECT doc_id % 40 AS part, left(text, 40) AS head, row_number() OVER (PARTITION BY doc_id % 40 ORDER BY doc_id) AS n FROM documents),
      b AS (SELECT part, string_agg('[#' || n || '] ' || head, chr(10) ORDER BY n) AS context FROM t WHERE n <= 3 GROUP BY 1),
      p AS (SELECT item_id, '<context>' || chr(10) || coalesce(context, '') || chr(10) || '</context>' || chr(10) || 'Question: ' || text AS prompt FROM benchmark LEFT JOIN b ON part = item_id % 40)
      SELECT item_id, sha256(prompt) AS prompt_sha, length(prompt) AS chars FROM p""",
}
