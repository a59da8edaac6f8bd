"""Search against plain loops, with small blocks, copies and odd rows."""

import math
import random
from collections import Counter

import pytest

from corpuslake.llm import lexical_search as L


def brute(docs, items, top):
    held = [(k, Counter(L.terms_of(t)), len(L.terms_of(t))) for k, t in docs]
    documents, terms = sum(n > 0 for *_, n in held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, tf, n in held:
            m = 100 - 50 + 50 * n * documents // terms if terms else 0
            score = sum(math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 20 * m)) for t in set(L.terms_of(text)) if tf[t])
            if score > 0:
                scores.append((-score, doc_id is not None, doc_id or 0, doc_id))
        out += [(item_id, i + 1, s[3], -s[0]) for i, s in enumerate(sorted(scores)[:top])]
    return out


def corpus(n=300):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(words, k=rng.choice([1, 5, 40, 300]))) for _ in range(n)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(n + i, texts[0]) for i in range(20)] + [(3, texts[3]), (3, texts[3]), (None, texts[5]), (None, None)]
    docs += [(9001, "Éa-ßb é_É 日本 x1" * 3), (9002, "W1 w1 W2,w2;w1 " * 200), (9003, "")]
    items = [(i, " ".join(rng.choices(words, k=12))) for i in range(15)] + [(50, "É日本 ßb x1é"), (51, None), (52, "!!"), (53, "none of these"), (0, "w1 w1 w2"), (54, texts[0])]
    return docs, items


@pytest.mark.parametrize(("block", "top"), [(256, 50), (4, 3)])
def test_results_are_those_of_plain_loops(spark, monkeypatch, block, top):
    monkeypatch.setattr(L, "BLOCK_ITEMS", block)
    docs, items = corpus()
    tables = [spark.createDataFrame(rows, schema).repartition(3) for rows, schema in ((docs, "doc_id long, text string"), (items, "item_id long, text string"))]
    found = [tuple(r) for r in L.searched(*tables, top=top).collect()]
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(found, key=key) == sorted(brute(docs, items, top), key=key)


def test_odd_rows_and_empty_tables(odd, empty, spark):
    items = spark.createDataFrame([(1, "quick brown fox"), (None, "dog"), (2, None)], "item_id long, text string")
    found = L.searched(odd, items)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    expected = brute([(r["doc_id"], r["text"]) for r in odd.collect()], [(1, "quick brown fox"), (None, "dog")], 50)
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, expected))
    assert L.searched(empty, items).count() == 0 and L.searched(odd, items.limit(0)).count() == 0
    assert L.searched(odd.filter("text is null"), items).count() == 0
