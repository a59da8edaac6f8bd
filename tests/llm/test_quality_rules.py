import re
from collections import Counter

import numpy as np
import pyarrow as pa

from corpuslake.llm import queries, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered |= set(range(i, i + 8))
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def rows(df):
    return [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in df.collect()]


def test_base_measures_of_all_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    got = rows(queries.op1_quality_rules(spark, small))
    assert sorted(got) == sorted((d.doc_id, *brute(d.text)) for d in docs)


def test_odd_rows(spark, odd, empty):
    trusted = spark.createDataFrame([(5,), (None,), (77,)], "doc_id long")
    got = rows(quality_rules.judged(odd, trusted))
    expected = [(r.doc_id, *brute(r.text)) for r in odd.collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert quality_rules.judged(empty, trusted).count() == 0
    none = quality_rules.judged(odd, trusted.limit(0)).collect()
    assert {r.llr for r in none} == {0.0}
    assert quality_rules.accepted(odd, trusted).schema == odd.schema


def test_ratio_is_the_mean_log_ratio_of_grams():
    ratios = np.random.RandomState(1).normal(size=64)
    texts = ["a b a b c", "", "x"]
    got = quality_rules.measure(pa.array(texts, pa.large_string()), ratios, 0.0)
    cells, n = quality_rules.gram_cells(quality_rules.Texts(pa.array(texts, pa.large_string())), 64)
    assert n.tolist() == [9, 0, 1]
    assert np.allclose(got["llr"], [ratios[cells[:9]].mean(), 0, ratios[cells[9]]])


def test_counts_do_not_depend_on_partitions(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    trusted = queries.trusted(spark, tiny)
    one = {r.cell: (r.raw, r.target) for r in quality_rules.counted_cells(docs.coalesce(1), trusted, 256).collect()}
    many = {r.cell: (r.raw, r.target) for r in quality_rules.counted_cells(docs.repartition(5), trusted, 256).collect()}
    assert one == many


def test_good_documents_stay_and_junk_goes(spark, small):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    got = {r.doc_id: r for r in queries.op1_quality_rules(spark, small).collect()}
    good = [got[d] for d, q in labels.items() if q == 1 and not got[d].base_failed]
    bad = [got[d] for d, q in labels.items() if q == 0]
    assert all(r.kept for r in good)
    assert sum(r.kept for r in bad) <= 0.05 * len(bad)


def test_written_collisions_are_not_repeats():
    from tests.llm.test_ngram_join import morse

    a, b = morse(10)
    texts = [f"{a}\n{b}", " ".join([a, *"cdefghi", b, *"cdefghi"]), f"{a}\n{b}\n{a}\n{b}", "x" * 2_000_000 + "\n" + "x" * 2_000_000, " ".join([b] * 20)]
    got = quality_rules.measure(pa.array(texts, pa.large_string()), np.zeros(64), 0.0)
    expected = [brute(t) for t in texts]
    for i, name in enumerate(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")):
        assert got[name].tolist() == [e[i] for e in expected]
