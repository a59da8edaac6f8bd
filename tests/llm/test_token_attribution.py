import random

from corpuslake.llm import queries
from corpuslake.llm import token_attribution as ta


def brute(text, bounds):
    """Tokens of each (start, end) in code points, token by token."""
    path, pattern = ta.default_vocabulary()
    coder, sizes = ta.encoding(path, pattern)
    raw, at, counts = text.encode(), 0, [0] * len(bounds)
    places = [(len(text[:a].encode()), len(text[:b].encode())) for a, b in bounds]
    for token in coder.encode_ordinary(text):
        end = at + int(sizes[token])
        held = [max(0, min(b, end) - max(a, at)) for a, b in places]
        counts[held.index(max(held))] += 1
        at = end
    assert at == len(raw)
    return counts


def _split(text):
    parts = text.split("\n")
    return [p + "\n" for p in parts[:-1]] + ([parts[-1]] if parts[-1] else [])


def bounds(text):
    out, at = [], 0
    for line in _split(text):
        out.append((at, at + len(line)))
        at += len(line)
    return out


def test_all_documents(spark, tiny):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    got = queries.op2_token_counts(spark, tiny).toPandas()
    for doc_id, text in texts.items():
        mine = got[got.doc_id == doc_id].sort_values("section")
        where = bounds(text)
        assert list(zip(mine.start, mine.end, strict=True)) == where
        assert mine.n_tokens.tolist() == brute(text, where)


def test_given_sections_with_gaps_and_overlaps(spark, odd, empty):
    rng = random.Random(2)
    text = "The quick  brown fox's tail, été 日本語!\n\nnext line here"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "x"), (3, "x"), (None, "y z")], "doc_id long, text string")
    cuts = sorted(rng.sample(range(1, len(text)), 6))
    sections = [(1, 0, cuts[0], cuts[2]), (1, 1, cuts[1], cuts[3]), (1, 2, cuts[4], cuts[5]), (1, 3, 5, 5), (9, 0, 0, 3), (None, 0, 0, 1), (1, None, 0, 2), (3, 7, 0, 99)]
    got = ta.counted(docs, *ta.default_vocabulary(), spark.createDataFrame(sections, "doc_id long, section int, start long, end long"))
    rows = sorted(got.filter("doc_id = 1").collect(), key=lambda r: r.start)
    where = [(r.start, r.end) for r in rows]
    assert where[0][0] == 0 and where[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(where, where[1:], strict=False))
    assert [r.n_tokens for r in rows] == brute(text, where)
    assert [(r.section, r.n_tokens) for r in got.filter("doc_id = 3").collect()] == [(7, 1), (7, 1)]
    assert [r.section for r in got.filter("doc_id is null").collect()] == [ta.OUTSIDE]
    assert ta.counted(odd, *ta.default_vocabulary()).filter("doc_id in (1, 2)").count() == 0
    assert ta.counted(empty, *ta.default_vocabulary()).count() == 0
