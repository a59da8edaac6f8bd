import zlib

import numpy as np
import pytest

from corpuslake.llm import packing, queries


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


def bin_by_bin(counts, capacity):
    """Best-two-fit for one bin at a time."""
    left, out = packing._Left(counts.copy()), []
    while left.longest(capacity):
        gap, inside = capacity, []
        while gap and (n := left.longest(gap)):
            inside.append(n)
            left.counts[n] -= 1
            gap -= n
        while gap and len(inside) > 1:
            a, b = left.best_two(gap + inside[-1])
            if a + b <= inside[-1]:
                break
            left.counts[inside[-1]] += 1
            left.counts[a] -= 1
            left.counts[b] -= 1
            gap += inside[-1] - a - b
            inside = sorted([*inside[:-1], a, b], reverse=True)
        out.append(tuple(inside))
    return out


@pytest.mark.parametrize("seed", range(25))
def test_plan_is_that_of_packing_bin_by_bin(seed):
    random = np.random.RandomState(seed)
    capacity = random.randint(5, 60)
    counts = np.zeros(capacity + 1, np.int64)
    for n in random.randint(1, capacity + 1, random.randint(1, 12)):
        counts[n] += random.randint(1, 60)
    bins = packing.plan(counts, capacity)
    assert [tuple(n for n, k in inside.items() for _ in range(k)) for inside, times in bins for _ in range(times)] == bin_by_bin(counts, capacity)


def test_best_two_is_the_best_pair():
    random = np.random.RandomState(3)
    for _ in range(200):
        counts = random.randint(0, 3, 30) * (random.rand(30) < 0.4)
        counts[0] = 0
        limit = random.randint(1, 29)
        pairs = [a + b for a in range(1, 30) for b in range(a, 30) if a + b <= limit and counts[a] and counts[b] and (a != b or counts[a] > 1)]
        assert sum(packing._Left(counts).best_two(limit)) == max(pairs, default=0)


def check(rows, texts, tokenizer, capacity):
    """rows: packed pieces; texts: (doc_id, text) of every document."""
    expected = []
    for doc_id, text in texts:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            expected.append((doc_id, piece, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == sorted(expected, key=str)
    end = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == end.get(r.sequence_id, 0)
        end[r.sequence_id] = r.offset + r.length
    assert max(end.values(), default=0) <= capacity
    return len(end), sum(end.values())


def test_all_documents(spark, small, tokenizer):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    sequences, tokens = check(queries.op4_best_fit_packing(spark, small).collect(), texts, tokenizer, 4096)
    assert sequences <= -(-tokens // 4096) + 1


def test_odd_rows(odd, empty, tokenizer):
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    check(packing.packed(odd, packing.default_tokenizer(), 50).collect(), texts, tokenizer, 50)
    assert packing.packed(empty, packing.default_tokenizer()).count() == 0


def test_word_by_word_ids_are_those_of_the_whole_text(tokenizer):
    words = packing.WordIds(packing.default_tokenizer(), 5)
    for text in ["It's a\x0btest<|endoftext|>x", "ÉTÉ é \x1c y z Σας ΟΔΟΣ", "a' s's 'S 12,345 ***", "İI q", "  ", "word " * 50]:
        assert np.frombuffer(words.of(text.encode()), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_long_words_are_encoded_but_not_remembered(tokenizer):
    words, text = packing.WordIds(packing.default_tokenizer()), "ab" * 5000 + " short"
    assert np.frombuffer(words.of(text.encode()), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert list(words) == [b"short"]
