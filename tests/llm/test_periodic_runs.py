"""Runs against brute force, planted tails, and the cases of the docstring."""

import hashlib
import random
import re
import zlib

import pyarrow as pa
import pytest

from corpuslake.llm import periodic_runs as P
from corpuslake.llm.textbatch import Texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=6, times=4):
    """Stretches on which words q apart are equal, as far as they go; those of a smaller period are left out."""
    out, n = [], len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, times * q):
                here = words[i : i + size]
                if not any(here[d:] == here[: size - d] for d in range(1, q)):
                    out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    return words


def digest(doc_id, text):
    words = planted(doc_id, text)
    runs = brute(words)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    milli = best and 1000 * best[1] // best[2]
    return (doc_id, len(runs), *(best or (None,) * 3), milli, sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def made(rng):
    words = []
    while len(words) < rng.choice([0, 5, 30, 120]):
        if rng.random() < 0.5:
            unit = [rng.choice("abcde"[: rng.choice([1, 2, 5])]) for _ in range(rng.randint(1, 9))]
            words += (unit * rng.randint(1, 7))[: rng.randint(1, 50)]
        else:
            words.append(rng.choice("abcdefgh"))
    return words


@pytest.mark.parametrize(("least", "times"), [(6, 4), (8, 3), (30, 4), (3, 3), (1, 5)])
def test_all_runs_and_no_others(least, times):
    rng = random.Random(11)
    for _ in range(300):
        words = made(rng)
        found = P.runs_in(Texts(pa.array(["x " + " ".join(words), " ".join(words)], pa.large_string())), least, times)
        assert found.get(1, []) == brute(words, least, times)


@pytest.mark.parametrize("words", [["a"] * 60_000, [w for i in range(9_000) for w in ["a"] * 6 + [f"x{i}"]], [f"w{i % 7000}" for i in range(60_000)], ["a", "b"] * 20_000 + ["c"] * 20_000])
def test_long_repetitions_take_little_time(words):
    found = P.runs_in(Texts(pa.array([" ".join(words)], pa.large_string())), 6, 4)[0]
    assert len(found) in (1, 2, 9_000)
    assert all(words[s : s + size - q] == words[s + q : s + size] for s, size, q in found[:50])


def test_query_against_brute_force(spark, odd):
    rng = random.Random(3)
    rows = [(i, " ".join(made(rng))) for i in range(400)] + [(None, "a b " * 9), (7, "z " * 30), (7, "z " * 30)]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    given = [(r["doc_id"], r["text"]) for r in docs.collect() if len(r["text"] or "") < 10_000]
    kept = docs.filter("text is null or length(text) < 10000")
    found = P.digested(P.detected(P.looped(kept)))
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(str(digest(*r)) for r in given)


def test_odd_rows_and_empty_tables(odd, empty):
    found = P.detected(odd)
    assert found.count() == odd.count() and found.columns == ["doc_id", "n_words", "runs", "collapsed"]
    assert P.digested(P.detected(P.looped(empty))).count() == 0


def test_a_run_needs_three_periods_or_more(odd):
    with pytest.raises(ValueError, match="three"):
        P.detected(odd, 6, 2)
