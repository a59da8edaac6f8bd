"""Small hand-made cases of what the reference pins down."""

import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from corpuslake.functions import ids, text, vectors
from corpuslake.operators import answers, chunking, context, entities, evaluation, fusion, lifecycle, metering
from corpuslake.sources import sinks, tables


def one(spark, column, **values):
    row = spark.range(1)
    for name, value in values.items():
        row = row.withColumn(name, F.lit(value) if not isinstance(value, list) else F.array(*[F.lit(v) for v in value]).cast("array<string>"))
    return row.select(column.alias("x")).first()["x"]


def test_fusion_ties_and_boosts(spark):
    arm = "query_id long, chunk_id long, rank int, source_type string"
    first = spark.createDataFrame([(1, 10, 1, "rulebook"), (1, 11, 2, "rulebook")], arm)
    second = spark.createDataFrame([(1, 20, 1, "rulebook"), (1, 11, 2, "rulebook"), (1, 30, 3, "errata")], arm)
    got = [r.chunk_id for r in fusion.fuse(first, second, 4).orderBy("rank").collect()]
    assert got == [11, 10, 20, 30]
    assert [r.chunk_id for r in fusion.fuse(first, second.limit(0), 5).orderBy("rank").collect()] == [10, 11]
    close = spark.createDataFrame([(1, 1, 1, "rulebook"), (1, 2, 2, "errata"), (1, 3, 40, "errata")], arm)
    assert [r.chunk_id for r in fusion.fuse(close, second.limit(0), 3).orderBy("rank").collect()] == [2, 1, 3]


def assembled(explicit, semantic, rules, autos, k):
    explicit, semantic, rules, autos = list(dict.fromkeys(explicit)), semantic, rules, autos
    out = explicit[: k - 1 if semantic and k > 1 else k]
    waiting = [x for x in rules if x not in out]
    limit = k - 1 if waiting and k > 1 else k
    for more, most in ((semantic, limit), (rules, k), (semantic, k), (autos, k)):
        for x in dict.fromkeys(more):
            if x not in out and len(out) < most:
                out.append(x)
    return out


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_context_budget(spark, k):
    cases = [(["a", "b", "c", "d", "e"], ["s", "t"], ["r"], ["z"]), ([], ["s", "t", "u", "v", "w"], ["r"], ["z"]), ([], ["s", "t"], ["s"], ["z", "t"]), (["a", "a"], [], [], ["z"]), ([], [], [], []), ([], ["s"], [], ["z", "y", "x", "w", "v"])]
    for e, s, r, a in cases:
        got = one(spark, context.assemble(F.col("e"), F.col("s"), F.col("r"), F.col("a"), k), e=e, s=s, r=r, a=a)
        assert got == assembled(e, s, r, a, k)
    assert one(spark, context.complete_family(F.col("c"), F.col("f"), 2), c=["a", "b"], f=["b", "x", "y", "z"]) == ["a", "b", "x", "y"]


def test_names_claim_their_spans():
    names = entities.Names(["Jade Blade Dancer", "Jade", "Guardian Angel", "Charm", "Iron Will (Foil)", "go"], frozenset({"charm"}))
    assert names.found("Does Jade Blade Dancer beat Guardian Angel?") == ["Jade Blade Dancer", "Guardian Angel"]
    assert names.found("an Angel Guardian appears") == ["Guardian Angel"]
    assert names.found("Guardian one two three four five Angel") == []
    assert names.found("jade is lower case, Charm is a keyword, go") == []
    assert names.found("Jade's Blade met the Dancer") == ["Jade Blade Dancer"]
    assert names.found("") == []


def test_whole_words_and_codes(spark):
    assert one(spark, text.whole_word("t", "ready"), t="I am READY.") and not one(spark, text.whole_word("t", "ready"), t="already")
    assert one(spark, text.rule_codes("t"), t="see 383.3.d, 702 and 1234 or 383.3.d") == ["383.3.d", "702"]
    assert one(spark, text.rule_codes("t"), t="") == []
    assert one(spark, text.tags("t"), t="use @Foo and @bar-x") == ["foo", "bar"]
    assert one(spark, text.without_tags("t"), t="use @bar-x") == "use -x"
    assert one(spark, text.references("t"), t=" 1.2, ,3 ") == ["1.2", "3"]
    assert one(spark, text.printing_key("t"), t="**Name**: Jade (Foil) | x") == "jade"
    assert one(spark, text.printing_key("t"), t="no name") is None
    assert one(spark, text.strip_citations("t"), t="a [#1, 2] . b [3]") == "a. b"
    assert (one(spark, text.floor_tokens("t"), t="abcdefg"), one(spark, text.ceil_tokens("t"), t="abcdefg")) == (1, 2)


def test_a_reference_is_covered_by_itself_and_deeper_codes_only(spark):
    refs = spark.createDataFrame([(1, "383.3"), (1, "383.30"), (2, "1"), (3, "9.9")], "question_id long, ref string")
    codes = spark.createDataFrame([(1, 2, "383"), (1, 5, "383.3.d"), (1, 7, "383.3"), (2, 1, "1"), (3, 1, "9")], "question_id long, rank int, code string")
    got = {(r.question_id, r.ref): r["rank"] for r in evaluation.first_covering(refs, codes).collect()}
    assert got == {(1, "383.3"): 5, (1, "383.30"): None, (2, "1"): 1, (3, "9.9"): None}
    per = evaluation.first_covering(refs, codes).groupBy("question_id").agg(evaluation.strict_hit(F.col("rank"), 5).alias("all"), evaluation.recall_at(F.col("rank"), 5).alias("any"))
    assert {r.question_id: (r["all"], r["any"]) for r in per.collect()} == {1: (False, 0.5), 2: (True, 1.0), 3: (False, 0.0)}


def test_stratified_sample_takes_the_limit(spark):
    rows = spark.createDataFrame([(i, "abc"[0 if i < 6 else 1 if i < 9 else 2]) for i in range(10)], "id long, s string")
    got = evaluation.stratified(rows, 5, "s", "id").groupBy("s").count().collect()
    assert {r.s: r["count"] for r in got} == {"a": 3, "b": 2}  # 3, 1.5 and 0.5: of equal rests the first by name
    assert evaluation.stratified(rows, 50, "s", "id").count() == 10


BOOK = "intro\n# Top\n\n## Only heading\n\n## Rules\n801. **Deflect** costs more.\n801.1. It is paid.\n802. **Equip** moves.\n802.1. long " + "word " * 120 + "\n### Tail\ntext"


def test_sections_and_rule_packing(spark):
    docs = spark.createDataFrame([(1, BOOK), (2, ""), (3, None), (4, "no heading")], "doc_id long, text string")
    sections = chunking.sections(docs).orderBy("ord").collect()
    assert [(s.level, s.header) for s in sections] == [(1, "Top"), (2, "Only heading"), (2, "Rules"), (3, "Tail")]
    chunks = chunking.chunks(docs, "rulebook").orderBy("ord", "part").collect()
    assert [c.section for c in chunks] == ["801. Deflect", "802. Equip", "802. Equip", "Tail"]
    assert chunks[0].content == "### 801. Deflect\n801. **Deflect** costs more.\n801.1. It is paid."
    assert chunks[1].parent_section == "Level 2 — Rules"


def test_paragraph_packing_keeps_the_last_as_overlap(spark):
    paragraphs = [c * 400 for c in "abcdefgh"]
    out = one(spark, chunking.pack_paragraphs(F.split("t", "\n\n"), 250), t="\n\n".join(paragraphs))
    expected, held, tokens = [], [], 0
    for p in paragraphs:
        if tokens + 100 > 250 and held:
            expected.append("\n\n".join(held))
            held, tokens = held[-1:], 100
        held, tokens = [*held, p], tokens + 100
    assert out == [*expected, "\n\n".join(held)]


def test_version_5_ids(spark):
    for name in ("v1:doc:text", "é", ""):
        assert one(spark, ids.uuid5(F.col("t")), t=name) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))
    key = lambda m, q: one(spark, ids.cache_key(F.lit("v"), F.col("m"), F.lit("p"), F.col("q")), m=m, q=q)
    assert key(["b", "a"], " Hi ") == key(["a", "b"], "hi") == hashlib.sha256(b'{"cv": "v", "m": ["a", "b"], "pv": "p", "q": "hi"}').hexdigest()


def test_upsert_keeps_what_it_does_not_update(spark):
    schema = "id long, content string, section string, corpus_version string"
    old = spark.createDataFrame([(1, "a", "s", "v1"), (2, "b", "s", "v1")], schema)
    new = spark.createDataFrame([(2, "B", "S", "v2"), (3, "C", "S", "v2")], schema)
    assert sorted(map(tuple, lifecycle.upsert(old, new).collect())) == [(1, "a", "s", "v1"), (2, "B", "s", "v2"), (3, "C", "S", "v2")]


def test_latest_wins_and_first_of_equals(spark):
    rows = spark.createDataFrame([("x", "2024-01", 2), ("x", "2024-03", 3), ("x", "2024-03", 1), ("y", "2023-01", 9)], "k string, d string, n int")
    assert sorted((r.k, r.n) for r in lifecycle.latest(rows, ["k"], "d", "n").collect()) == [("x", 1), ("y", 9)]


def test_quota_gate_is_the_loop(spark):
    import random

    rng = random.Random(4)
    rows = [(i, f"2024-01-0{1 + i // 100} 00:{i % 60:02d}:00", rng.randrange(5), rng.choice([0, 5, 20])) for i in range(200)]
    rows.sort(key=lambda r: (r[1], r[0]))
    expected, mine, everyone = {}, {}, {}
    for i, ts, user, tokens in rows:
        day = ts[:10]
        if mine.get((user, day), 0) >= 60:
            expected[i] = "personal"
        elif everyone.get(day, 0) >= 200:
            expected[i] = "global"
        else:
            expected[i] = "pass"
            mine[user, day] = mine.get((user, day), 0) + tokens
            everyone[day] = everyone.get(day, 0) + tokens
    frame = spark.createDataFrame(rows, "event_id long, ts string, user_id long, tokens long").withColumn("ts", F.to_timestamp("ts")).withColumn("day", F.to_date("ts"))
    assert {r.event_id: r.verdict for r in metering.quota_gate(frame, 60, 200).collect()} == expected


def test_cache_hits_do_not_refresh(spark):
    rows = spark.createDataFrame([(1, "k", 0, False), (2, "k", 9, False), (3, "k", 10, False), (4, "k", 19, False), (5, "z", 0, True), (6, "z", 1, False), (7, "z", 2, False)], "event_id long, key string, s long, bad boolean")
    rows = rows.withColumn("ts", F.timestamp_seconds("s"))
    got = {r.id: r.hit for r in metering.replay_cache(rows, "key", ttl=10, degraded="bad").collect()}
    assert got == {1: False, 2: True, 3: False, 4: True, 5: False, 6: False, 7: True}


def test_answers(spark):
    assert one(spark, answers.is_empty(F.col("t")), t="Answer: x Answer: ** [#1]") and not one(spark, answers.is_empty(F.col("t")), t="no heading")
    assert one(spark, answers.cleaned(F.col("t")), t="Yes [1].\n" + answers.NO_INFO[0]) == "Yes"
    assert one(spark, answers.cleaned(F.col("t")), t=answers.NO_INFO[0]) == answers.NO_INFO[0]
    assert one(spark, answers.retry_delay(F.col("t")), t="please retry in 7s") == 8 and one(spark, answers.retry_delay(F.col("t")), t="x") == 60


def test_nearest_in_blocks_and_by_tag(spark, monkeypatch):
    import numpy as np

    v = np.random.RandomState(0).normal(size=(60, 8))
    corpus = spark.createDataFrame([(i, v[i].tolist(), "ab"[i % 2]) for i in range(60)], "chunk_id long, embedding array<float>, tag string").repartition(3)
    asked = corpus.filter("chunk_id < 5").withColumnRenamed("chunk_id", "query_id")
    unit = v.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    exact = {q: sorted(range(60), key=lambda i: (-round(unit[q] @ unit[i], 9), i))[:4] for q in range(5)}
    for block in (20_000, 2):
        monkeypatch.setattr(vectors, "BLOCK_QUERIES", block)
        rows = vectors.nearest(corpus, asked, 4).orderBy("query_id", "rank").collect()
        assert {q: [r.chunk_id for r in rows if r.query_id == q] for q in range(5)} == exact
    tagged = vectors.nearest(corpus, asked, 4, allowed="none").collect()
    assert all(r.query_id % 2 == r.chunk_id % 2 for r in tagged)


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\nx")
    assert [tuple(r) for r in tables.manifest(spark, [(f"{tmp_path}/a.md", "faq"), (f"{tmp_path}/none.md", "errata")]).select("source_document", "source_type", "text").collect()] == [("a.md", "faq", "# A\nx")]
    assert tables.markdown(spark, [f"{tmp_path}/none.md"]).count() == 0
    (tmp_path / "q.json").write_text('{"questions": [{"id": "1", "rule_reference": null}, {"id": "2", "rule_reference": "3.4"}]}')
    assert [r.id for r in tables.questions(spark, f"{tmp_path}/q.json", with_reference=True).collect()] == ["2"]
    (tmp_path / "q.json").write_text('[{"id": "3"}]')
    assert [r.id for r in tables.questions(spark, f"{tmp_path}/q.json").collect()] == ["3"]
    assert tables.latest_file(spark, f"{tmp_path}/*.json").endswith("q.json") and tables.latest_file(spark, f"{tmp_path}/*.zzz") is None
    frame = spark.createDataFrame([(1, "a\n\"b\"", [1, 2])], "id int, t string, v array<int>")
    sinks.csv(frame, f"{tmp_path}/csv")
    assert [tuple(r) for r in tables.csv(spark, f"{tmp_path}/csv", "id int, t string, v string").collect()] == [(1, 'a\n"b"', "[1,2]")]
    sinks.version(frame.withColumn("corpus_version", F.lit("v1")), f"{tmp_path}/p")
    sinks.version(frame.withColumn("corpus_version", F.lit("v2")), f"{tmp_path}/p")
    sinks.version(frame.withColumn("corpus_version", F.lit("v2")), f"{tmp_path}/p")
    assert spark.read.parquet(f"{tmp_path}/p").count() == 2
    body = "event: token\ndata: {\"a\": 1}\n\ndata: x\n\nevent: end\n\n"
    assert [tuple(e) for e in one(spark, tables.events_of("t"), t=body)] == [("token", '{"a": 1}'), ("message", "x")]
    assert one(spark, sinks.slug("t"), t=" It's a -- Test! ") == "its-a-test"
    page = '<script id="__NEXT_DATA__" type="x">{"a": {"b": 5}}</script>'
    assert one(spark, tables.embedded_json(F.col("t"), "struct<a:struct<b:int>>"), t=page).a.b == 5
