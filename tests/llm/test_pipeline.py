import corpus_pipeline
from corpuslake.llm import quality_rules, secret_scan
from tests.llm.test_decontamination import dec
from tests.llm.test_ngram_join import brute


def test_stages_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet").filter("quality = 1").select("doc_id")
    verdict = {r.doc_id: r.kept for r in quality_rules.judged(docs, labels).collect()}
    kept = {r.doc_id: r.text for r in docs.collect() if verdict[r.doc_id]}
    stages = dict(corpus_pipeline.STAGES)
    out = stages["quality rules"](spark, docs, small)
    assert {r.doc_id for r in out.collect()} == set(kept) and out.schema == docs.schema

    rows = sorted(kept.items())
    first = {c for _, _, c in brute(rows, 5, 80)}
    unique = stages["n-gram Jaccard join"](spark, out, small)
    assert sorted(r.doc_id for r in unique.collect()) == sorted(first)

    items = [dec.normal(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    exact = {d for d in first if any(i and i in dec.normal(kept[d]) for i in items)}
    clean = {r.doc_id: r.text for r in stages["benchmark decontamination"](spark, unique, small).collect()}
    assert not exact & set(clean) and len(first) - len(clean) <= len(exact) + 3

    texts = docs.filter(docs.doc_id.isin(list(clean)))
    masked = stages["secret scans"](spark, texts, small).collect()
    assert {r.doc_id for r in masked} == set(clean)
    assert all(not secret_scan.scan(r.text)[0] and r.n_chars == len(r.text) for r in masked)

    final = corpus_pipeline.run(spark, small).toPandas()
    assert set(final.doc_id) == set(clean)
    assert final.groupby("sequence_id").length.sum().max() <= 4096


def test_registered():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries() and len(corpus_pipeline.STAGES) == 5


def test_every_stage_takes_odd_rows_and_an_empty_table(spark, small, odd, empty):
    counts = {}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, small).count() == 0
        out = stage(spark, odd, small)
        counts[name] = out.count()
        if name != "best-fit packing":
            assert out.columns == odd.columns
    rows = odd.collect()
    assert counts["secret scans"] == counts["benchmark decontamination"] == len(rows)
    # Of the copies of one text two ids stay apart from none: the least id, the near copy's component, and all without words.
    assert counts["n-gram Jaccard join"] == len({c for _, _, c in brute([(r.doc_id, r.text) for r in rows if r.text and r.text.split()], 5, 80)}) + sum(not (r.text or "").split() for r in rows)
    assert counts["best-fit packing"] >= len(rows)
