import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpuslake.llm import language_id, quality_classifier, queries


def test_quality_on_held_out_rows(spark, small):
    got = {r.doc_id: r for r in queries.op5_quality_classifier(spark, small).collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.values())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    held = [(got[d], q) for d, q in labels.items() if got[d].held_out]
    assert sum(r.predicted == q for r, q in held) >= 0.9 * len(held)
    assert len(got) == 1000


def test_quality_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(5, 1), (12, 0), (None, 1), (9, None), (99, 1)], "doc_id long, label int")
    weights = quality_classifier.fitted(odd, labels, cells=1 << 10)
    got = quality_classifier.scored(odd, weights).collect()
    assert len(got) == odd.count()
    assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    assert quality_classifier.scored(empty, weights).count() == 0
    blank = quality_classifier.fitted(odd, labels.limit(0), cells=1 << 10)
    assert {r.score for r in quality_classifier.scored(odd, blank).collect()} == {0.5}


def test_quality_sample_is_bounded(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "doc_id")
    assert quality_classifier.some(rows, 30_000).count() == 20_000
    assert 800 < quality_classifier.some(rows, 1000).count() < 1200


def test_score_does_not_depend_on_neighbours():
    texts = ["a b c", "", "the the the", "X!! Y!!"]
    alone = [quality_classifier.features(quality_classifier.Texts(pa.array([t], pa.large_string())), 512)[0].tolist() for t in texts]
    cells, n = quality_classifier.features(quality_classifier.Texts(pa.array(texts, pa.large_string())), 512)
    ends = n.cumsum()
    assert [cells[e - k : e].tolist() for e, k in zip(ends, n, strict=True)] == alone


def test_language_on_held_out_rows(spark, small):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = queries.op9_language_id(spark, small).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)


def test_language_odd_rows(spark, odd, empty):
    got = {r.doc_id: r for r in language_id.predicted(odd, *language_id.fitted(odd)).collect()}
    assert {got[d].lang_pred for d in (1, 2, 3, 12)} == {"und"}
    assert got[5].lang_pred == "en" and got[5].score == 1.0
    assert language_id.identified(empty).count() == 0
    nothing = language_id.predicted(odd, *language_id.fitted(empty)).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def test_languages_are_separated_within_their_family():
    found = language_id.classifiers(["en", "de", "fr", "es", "xx"])
    assert ("de", "en") in found and ("es", "fr") in found and ("de", "fr") not in found
    assert [c for c in found if c[0] == "family"] == [("family", x) for x in ("germanic", "romance", "xx")]
    assert language_id.classifiers(["en", "fr"]) == [("family", "germanic")]
    assert language_id.classifiers(["en"]) == language_id.classifiers([]) == []
    many = [f"l{i}" for i in range(150)]
    assert len(language_id.classifiers(many)) == 150  # every language is kept


def test_decisions_by_hand():
    langs = ["de", "en", "fr"]  # classifiers: germanic against romance, de against en
    names, score = language_id.decide(np.array([[2.0, 1.0], [2.0, -1.0], [-2.0, 9.0], [0.0, 0.0]]), langs)
    p = lambda x: 1 / (1 + math.exp(-x))
    assert names.tolist() == ["de", "en", "fr", "de"]  # of equal ones the first by name
    assert np.allclose(score, [p(2) * p(1), p(2) * p(1), p(2), 0.25])


def plain_ftrl(examples, passes):
    """z, n and weights by feature, one number at a time."""
    z, n = {}, {}
    c = quality_classifier

    def weight(i):
        if abs(z.get(i, 0.0)) <= c.L1:
            return 0.0
        return -(z[i] - math.copysign(c.L1, z[i])) / ((c.BETA + math.sqrt(n[i])) / c.ALPHA + c.L2)

    for turn in range(passes):
        for k in np.random.RandomState(turn).permutation(len(examples)):
            values, label = examples[k]
            w = {i: weight(i) for i in values}
            error = 1 / (1 + math.exp(-sum(w[i] * x for i, x in values.items()))) - label
            for i, x in values.items():
                g = error * x
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / c.ALPHA * w[i]
                n[i] = old + g * g
    return {i: weight(i) for i in z}


def test_weights_against_a_plain_loop(spark):
    texts = {1: "good text with some words", 2: "BUY now!! 99 99", 3: "good words again", 4: "buy BUY buy", 5: "plain words with text"}
    labels = {1: 1, 2: 0, 3: 1, 4: 0, 5: 1}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    given = spark.createDataFrame(list(labels.items()), "doc_id long, label int")
    got = quality_classifier.fitted(docs, given, cells=64, passes=3)
    order = [r.doc_id for r in docs.select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(2))).collect()]
    examples = []
    for d in order:
        found, n = quality_classifier.features(quality_classifier.Texts(pa.array([texts[d]], pa.large_string())), 64)
        values = {int(i): float(np.float32(k / n[0])) for i, k in zip(*np.unique(found, return_counts=True), strict=True)}
        examples.append((values | {64: 1.0}, labels[d]))
    expected = plain_ftrl(examples, 3)
    assert np.allclose([got[i] for i in expected], list(expected.values()), atol=1e-6)


def test_svm_against_a_plain_loop():
    rng = np.random.RandomState(3)
    rows = [(np.sort(rng.choice(20, 6, replace=False)), rng.rand(6), int(rng.choice([-1, 1]))) for _ in range(200)]
    model = language_id.Svm(20)
    for at, values, sign in rows:
        model.learn(at, values, sign)
    w, g2, total = [0.0] * 20, [1e-8] * 20, [0.0] * 20
    for at, values, sign in rows:
        w = [x * (1 - language_id.RATE * language_id.PENALTY) for x in w]
        if sign * sum(w[i] * x for i, x in zip(at, values, strict=True)) < 1:
            for i, x in zip(at, values, strict=True):
                g2[i] += x * x
                w[i] += language_id.RATE * sign * x / math.sqrt(g2[i])
        total = [t + x for t, x in zip(total, w, strict=True)]
    assert np.allclose(model.average(), np.array(total) / len(rows))


def test_no_language_is_without_a_row(spark):
    """A language of one text beyond the bound of bytes, and one whose rows share an id."""
    rows = [(i, f"the plain words of text {i} and more", "en") for i in range(40)] + [(100, "ovo je jedan tekst na hrvatskom jeziku " * 40, "hr")] + [(7, f"mot de la langue {i % 2}", "fr") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, table = language_id.fitted(docs, cells=512, sample_rows=4, sample_bytes=150)
    assert langs == ["en", "fr", "hr"] and all(np.abs(w).sum() > 0 for w in table)
    got = {r.doc_id: r.lang_pred for r in language_id.predicted(docs, langs, table, 512).collect()}
    assert got[100] == "hr" and got[7] == "fr" and got[3] == "en"


def test_classifiers_do_not_depend_on_their_tasks(spark, monkeypatch):
    words = {"en": "the of and", "de": "der und das", "nl": "het een van", "fr": "le la de", "es": "el los de", "xx": "qo zu"}
    docs = spark.createDataFrame([(i, f"{w} {i} {w[i % 3 :]}", lang) for i in range(12) for lang, w in words.items()], "doc_id long, text string, lang string")
    whole = language_id.fitted(docs, cells=256)
    monkeypatch.setattr(language_id, "TASK_CLASSIFIERS", 2)
    parts = language_id.fitted(docs, cells=256)
    assert whole[0] == parts[0] and np.array_equal(whole[1], parts[1])


def test_equal_margins_take_the_first_by_name():
    names, _ = language_id.decide(np.zeros((1, len(language_id.classifiers(["de", "en", "es", "fr", "xx"])))), ["de", "en", "es", "fr", "xx"])
    assert names.tolist() == ["de"]


def test_samples_are_bounded(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("mot "), F.col("id")).alias("text"), F.when(F.col("id") % 2 == 0, "fr").otherwise("es").alias("lang"))
    langs, table = language_id.fitted(rows, cells=256, sample_rows=50, sample_bytes=1000)
    assert langs == ["es", "fr"] and table.shape == (1, 257)
    labels = rows.select("doc_id", (F.col("doc_id") % 2).alias("label"))
    assert np.isfinite(quality_classifier.fitted(rows, labels, cells=256, sample_rows=500, sample_cells=300, passes=1)).all()
