import random

from corpuslake.llm import decontamination as dec
from corpuslake.llm import queries


def least_distance(item, passage):
    """Least edit distance of the item to any substring: the textbook table."""
    row = [0] * (len(passage) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(passage, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_bit_parallel_distance_is_the_table_distance():
    rng = random.Random(5)
    for _ in range(300):
        item = "".join(rng.choices("abc ", k=rng.randint(1, 90)))
        passage = "".join(rng.choices("abc ", k=rng.randint(0, 120)))
        assert dec.best_match(dec.Item(item, 0.1), passage)[0] == least_distance(item, passage)


def edited(rng, text, edits):
    chars = list(text)
    for _ in range(edits):
        i = rng.randrange(len(chars))
        kind = rng.random()
        if kind < 0.4:
            chars[i] = rng.choice("qz")
        elif kind < 0.7:
            del chars[i]
        else:
            chars.insert(i, rng.choice("qz"))
    return "".join(chars)


def test_every_passage_within_budget_is_found_and_no_other(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 9)))
    items = [(i, " ".join(word() for _ in range(rng.randint(8, 40)))) for i in range(12)] + [(12, "short one"), (13, None), (14, "  "), (15, "")]
    items.append((16, items[0][1].upper()))
    docs, expected = [], {}
    for d in range(60):
        i, text = rng.choice(items[:12])
        body = edited(rng, text, rng.randint(0, int(len(text) * 0.14)))
        docs.append((d, " ".join(word() for _ in range(20)) + "\n\n" + body.title() + " " + " ".join(word() for _ in range(20))))
    docs += [(60, None), (61, ""), (62, "a short one here"), (63, "ashort one"), (60, None)]
    for d, text in docs:
        for i, item in items:
            clean, t = dec.normal(item), dec.normal(text)
            k = dec.budget(clean)
            if clean and len(clean) >= dec.LEAST_CHARS and (n := least_distance(clean, t)) <= k:
                expected[d, i] = n
    expected[62, 12] = 0
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    queries_frame = spark.createDataFrame(items, "item_id long, text string")
    got = dec.contaminated(frame, queries_frame).collect()
    assert {(r.doc_id, r.item_id): r.distance for r in got} == expected
    assert 5 < len(expected) < 60
    blocks = dec.contaminated(frame, queries_frame, block_chars=300).collect()
    assert {(r.doc_id, r.item_id): r.distance for r in blocks} == expected
    clean = {r.doc_id for r in dec.cleaned(frame, queries_frame, block_chars=300).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in expected}


def test_planted_items_are_found(spark, small):
    items = {r.item_id: " ".join(r.text.lower().split()) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    docs = {r.doc_id: " ".join(r.text.lower().split()) for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    exact = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    got = {(r.doc_id, r.item_id) for r in queries.op6_benchmark_decontamination(spark, small).collect()}
    assert exact and exact <= got


def test_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, "brown fox jumps over the lazy dog while seven bright")], "item_id long, text string")
    got = dec.contaminated(odd, items)
    assert {r.doc_id for r in got.collect()} == {5, 6, 7, 8, 10, None}
    assert dec.cleaned(odd, items).schema == odd.schema
    assert dec.contaminated(empty, items).count() == 0
    assert dec.contaminated(odd, items.limit(0)).count() == 0
    assert dec.cleaned(odd, items.limit(0)).count() == odd.count()
