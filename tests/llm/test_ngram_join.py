import re
from collections import Counter, defaultdict

from corpuslake.llm import ngram_join, queries
from corpuslake.llm.components import components
from tests.llm.conftest import BASE

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if 0 < len(words) < n:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else frozenset()


def brute(rows, n, percent):
    """Size and component of each row."""
    sets, holders = [shingles(t, n) for _, t in rows], defaultdict(list)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in holders[x])
        for j, k in common.items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for x in s:
            holders[x].append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def held(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_all_documents(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert held(queries.op7_ngram_jaccard_join(spark, small)) == sorted(brute(rows, 4, 85), key=str)


def test_odd_rows(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert held(ngram_join.clustered(odd, 4, 85)) == sorted(brute(rows, 4, 85), key=str)
    assert ngram_join.clustered(empty, 4, 85).count() == 0


def near_copies(spark, percent):
    """A large group of near copies whose distances straddle the threshold, and a passage that many share."""
    import random

    rng = random.Random(percent)
    base = [f"b{i}" for i in range(60)]
    passage = [f"p{i}" for i in range(20)]
    rows = []
    for d in range(300):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(60)] = f"x{rng.randrange(40)}"
        rows.append((d, " ".join(words)))
    for d in range(300, 420):
        rows.append((d, " ".join([f"d{d}w{i}" for i in range(rng.randint(1, 40))] + passage)))
    for d in range(420, 460):
        rows.append((d, " ".join(passage + [f"t{d}"] * rng.randint(0, 2))))
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def test_large_groups_lose_no_link(spark, monkeypatch):
    for percent in (60, 80):
        rows, docs = near_copies(spark, percent)
        assert held(ngram_join.clustered(docs, 3, percent)) == sorted(brute(rows, 3, percent), key=str)
    monkeypatch.setattr(ngram_join.cross_pairs, "__defaults__", (7,))  # many blocks for one shingle
    assert held(ngram_join.clustered(docs, 3, percent)) == sorted(brute(rows, 3, percent), key=str)


def test_one_of_each_component_stays(spark, small, odd):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected = sorted({c for _, _, c in brute(rows, 5, 80)})
    got = ngram_join.one_of_each(docs, 5, 80)
    assert sorted(r.doc_id for r in got.collect()) == expected
    assert got.schema == docs.schema
    left = ngram_join.one_of_each(odd, 4, 85).collect()
    assert Counter(r.doc_id for r in left if r.doc_id in (5, 6, 7, 8)) == {5: 1}
    assert {1, 2, 3, 4, 9} <= {r.doc_id for r in left}


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (5, 5), (20, 21), (21, 22), (22, 20), (2, 1), *[(100 + i, 101 + i) for i in range(40)]]
    got = {r.class_id: r.root for r in components(spark.createDataFrame(links, "left long, right long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 6: 6, 7: 6, 8: 6, 9: 6, 20: 20, 21: 20, 22: 20, **{i: 100 for i in range(100, 141)}}


def morse(k):
    """Two different texts that polynomial hashes modulo 2^64 cannot tell apart: no spaces, 2^k letters."""
    a = "a"
    for _ in range(k):
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_written_collisions_do_not_link(spark):
    a, b = morse(10)
    shared = " ".join(f"s{i}" for i in range(12))
    texts = [a, b, f"{a} x y z", f"{b} x y z", f"{shared} {a}", f"{shared} {b}", a]
    rows = list(enumerate(texts))
    got = held(ngram_join.clustered(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85))
    assert got == sorted(brute(rows, 4, 85), key=str)
    assert {d: c for d, _, c in got} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 0}


def test_frequent_shingles_are_salted(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT_ROWS", 0)
    monkeypatch.setattr(ngram_join, "HOT_CELL", 0)
    rows, docs = near_copies(spark, 80)
    assert held(ngram_join.clustered(docs, 3, 80)) == sorted(brute(rows, 3, 80), key=str)


def test_columns_with_the_names_of_the_operators_own(spark):
    rows = [(1, BASE, 5, 6, 7), (2, BASE, 5, 6, 7), (3, "other", 5, 6, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, high long, _low long, ID_ long")
    for names in (("high", "_low", "ID_"), ("class_id", "component_id", "low"), ("_high", "high", "id")):
        named = docs.toDF("doc_id", "text", *names)
        got = ngram_join.one_of_each(named, 4, 85)
        assert got.columns == named.columns and sorted(r.doc_id for r in got.collect()) == [1, 3]


def test_long_single_words(spark):
    rows = [(1, "x" * 3_000_000), (2, "x" * 2_999_999), (3, "x" * 3_000_000), (4, "y" * 3_000_000 + " z")]
    got = held(ngram_join.clustered(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85))
    assert got == [(1, 1, 1), (2, 1, 2), (3, 1, 1), (4, 1, 4)]


def rows_of_tables(spark, since):
    """Rows of the settled tables that have been written since, where there are any."""
    from pathlib import Path

    from corpuslake.session import shared_folder

    folders = {p for p in Path(shared_folder(spark).removeprefix("file:")).glob("settled-*")} - since
    found = {p: spark.read.parquet(str(p)).drop("none") for p in folders if list(p.glob("*.parquet"))}
    return {p: t.columns for p, t in found.items() if t.columns and t.count()}


def test_tables_without_a_reader_are_empty(spark, small):
    from pathlib import Path

    from corpuslake.session import shared_folder

    since = set(Path(shared_folder(spark).removeprefix("file:")).glob("settled-*"))
    result = queries.op7_ngram_jaccard_join(spark, small)
    left = rows_of_tables(spark, since)
    assert sorted(len(c) for c in left.values()) == [3, 8]  # the classes' components, and the signatures
    assert result.count() == 1000


def test_repeated_rows_are_one_and_spread(spark):
    """A row that makes up most of a table, in several tasks, with an id of its own and without one."""
    docs = spark.createDataFrame([(1, BASE), (None, BASE + " tail of its own that is long enough to be another text altogether"), (2, "other words that no one has written here before today"), (3, None), (3, "")], "doc_id long, text string")
    many = docs.unionByName(docs.filter("doc_id = 1 or doc_id is null").join(spark.range(400).repartition(6), how="cross").select("doc_id", "text"))
    got = ngram_join.one_of_each(many, 5, 80)
    assert sorted((str(r.doc_id) for r in got.collect())) == ["1", "2", "3", "3", "None"]
    assert ngram_join.clustered(many, 4, 85).count() == many.count()


def test_a_pivot_of_the_greatest_number(spark):
    """Every other node has a link to it: each task of the second join gets a part."""
    links = spark.range(20_000).selectExpr("id AS left", "1000000L AS right").unionByName(spark.createDataFrame([(1_000_001, 1_000_002)], "left long, right long"))
    got = {r.class_id: r.root for r in components(links).collect()}
    assert len(got) == 20_003 and set(got.values()) == {0, 1_000_001} and got[1_000_002] == 1_000_001
