"""Sources parsed by their formats, on small invented texts."""

import pytest
from pyspark.sql import functions as F

from corpuslake.operators import chunking, entities, lookup, markup, parsing
from tests.test_operators import one

SETS = ("origins", "unleashed")


def lines(spark, text, doc=1):
    return parsing.lines_of(spark.createDataFrame([(doc, text)], "doc_id long, text string"))


def test_errata(spark):
    text = """intro
# Origins cards
## Overview
no text here
## Jade Blade
### New Text
```text
line one


 
line two
```
### Notes
dropped
### Old Text
old
# Nothing set
## Second
### old text
only old
# Unleashed Card Errata
## Third
### New Text
first
### New text, corrected
second
## Fourth
### New Text
```
```
"""
    got = {r.card: (r["set"], r.new_text, r.old_text) for r in parsing.errata(lines(spark, text), SETS).collect()}
    assert got == {"Jade Blade": ("origins", "line one\n\n\n \nline two".replace("\n\n\n", "\n\n"), "old"), "Third": ("unleashed", "second", None)}
    assert parsing.errata(lines(spark, ""), SETS).count() == 0
    assert parsing.errata(lines(spark, None), SETS).count() == 0


def test_keyword_chapters(spark):
    text = "804. Before\nx\n805. Accelerate\n805.1. pay\nmore\n806. Assault\n827. After\ny\n805. Accelerate again\nz\n806.\n"
    got = {r.number: (r.name, r.content) for r in parsing.keyword_chapters(lines(spark, text), 805, 826).collect()}
    assert got == {805: ("Accelerate again", "805. Accelerate again\nz\n806.\n"), 806: ("Assault", "806. Assault")}


def test_number_headings_take_in_the_next(spark):
    text = "# 100.\n\n# Game Concepts\n## 1.\n# Other level\n# 2.\n# 3.\n# Third\ntext\n# 9.\nplain"
    got = [r.line for r in parsing.merged_headings(lines(spark, text)).orderBy("pos").collect()]
    assert got == ["# 100. Game Concepts", "## 1.", "# Other level", "# 2.", "# 3. Third", "text", "# 9.", "plain"]


def test_contents(spark):
    text = "## Orphan\n# A b!\n## Child\n# A  B\n### x\n# a-b"
    entries = parsing.contents(lines(spark, text))
    assert [(r.depth, r.id) for r in entries.orderBy("pos").collect()] == [(2, "orphan"), (1, "a-b"), (2, "child"), (1, "a-b-1"), (3, "x"), (1, "a-b-2")]
    assert [(r.head, r.id) for r in parsing.grouped_contents(entries).orderBy("pos").collect()] == [(1, "child"), (3, "x")]


def test_articles(spark):
    text = "CARD GALLERY\nNEWS\nCorpus One\nRules and Releases\n10/27/2025\n\nA Section\nplain text.\n\nNEW RULE: not a section\n\nA sentence.\nRelated Articles\nfooter\nCARD GALLERY\nno title here"
    got = parsing.articles(spark.createDataFrame([(1, text)], "doc_id long, text string"), "Corpus").collect()
    assert [(r.article, r.title, r.markdown) for r in got] == [(0, "Corpus One", "# Corpus One\n\n## A Section\nplain text.\n\nNEW RULE: not a section\n\nA sentence.")]


def test_spans(spark):
    rows = [(1, 0, "Title", 21.0), (1, 1, "body", 10.0), (1, 2, "goes on", 10.0), (1, 3, "101. rule", 10.0), (1, 4, "Part", 15.0), (1, 5, "Small", 12.5), (1, 6, "end", 10.0)]
    got = [r.line for r in parsing.span_markdown(spark.createDataFrame(rows, "doc_id long, pos int, text string, size double")).orderBy("pos").collect()]
    assert got == ["# Title", "body goes on", "101. rule", "## Part", "### Small", "end"]
    tie = spark.createDataFrame([(1, 0, "a", 12.0), (1, 1, "b", 8.0)], "doc_id long, pos int, text string, size double")
    assert [r.line for r in parsing.span_markdown(tie).orderBy("pos").collect()] == ["a b"]  # the first size seen is the body


@pytest.mark.parametrize(("line", "expected"), [
    ("133. First 133.1. second Example: x", ["133. First", "133.1. second", "Example: x"]),
    ("See rule 428. and rules 5. stay", ["See rule 428. and rules 5. stay"]),
    ("# 133. heading 134. same", ["# 133. heading 134. same"]),
    ("plain 1234. no", ["plain 1234. no"]),
    ("", [""]),
    ("a 135.2.e.5.a. deep", ["a", "135.2.e.5.a. deep"]),
])
def test_clauses(spark, line, expected):
    assert one(spark, parsing.clauses(F.col("t")), t=line) == expected


def test_clause_numbers(spark):
    assert tuple(one(spark, parsing.clause_number(F.col("t")), t="133.4.a. text")) == ("133.4.a", 3, "text")
    assert one(spark, parsing.clause_number(F.col("t")), t="no number") is None


def test_errata_entries(spark):
    text = "Intro\nJade\n[NEW TEXT] a b\n▲ old\nGuard\n[NEW TEXT]\n[OLD TEXT] x\nLast\n[NEW TEXT] only"
    got = one(spark, parsing.errata_entries(F.col("t")), t=text)
    assert [tuple(e) for e in got] == [("Jade", "a b", "old")]


def test_html_blocks():
    page = """<html><head><title>t</title></head><body><nav>no</nav><h1>Top</h1><p>a <b>bold</b> <i>it</i>&nbsp; x</p><script>no</script>
    <ul><li>one<li>two <b>b</b></ul><ol><li>n</ol><blockquote>said<br>twice</blockquote>
    <table><tr><th>Before<th>After<tr><td>x</td><td>y <b>z</b></td></tr></table><div><figure><table><tr><td>702.1</td><td>rule <b>text</b></td></tr></table></figure></div>
    <h2>Q</h2><p>answer</p></body>"""
    assert markup.blocks_of(page) == [
        "# Top", "a **bold** *it* x", "- one\n- two **b**", "1. n", "> said\n> twice", "| Before | After |\n| --- | --- |\n| x | y **z** |", "> **702.1** rule text", "## Q", "answer",
    ]
    assert [p.split("\n")[0] for p in markup.parts_of(page)] == ["# Top", "## Q"]
    assert markup.parts_of("<p><b>First?</b></p><p>yes</p><p><strong>Second?</strong><p>no <b>x</b>") == ["**First?**\n\nyes", "**Second?**\n\nno **x**"]
    assert markup.blocks_of(None) == markup.blocks_of("") == []
    assert markup.blocks_of("<table><tr><td>open") == ["| open |\n| --- |"]
    deep = markup.blocks_of("<div>" * 50_000 + "x" + "<table><tr><td>" * 1000 + "y")
    assert deep[0] == "x" and "y" in deep[1]


def test_every_word_of_the_pages_is_kept(spark, small):
    from html.parser import HTMLParser

    class Words(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.off = [], 0

        def handle_starttag(self, tag, attrs):
            self.off += tag in markup.LEFT_OUT

        def handle_endtag(self, tag):
            self.off -= tag in markup.LEFT_OUT

        def handle_data(self, data):
            if not self.off:
                self.out.append(data)

    letters = lambda t: "".join(c for c in t if c.isalpha())
    for r in spark.read.parquet(f"{small}/pages.parquet").collect():
        words = Words()
        words.feed(r.html)
        assert letters("".join(markup.blocks_of(r.html))) == letters("".join(words.out))


def test_lineage_keeps_the_rule_in_force(spark):
    units = ["100. **First** rule", "100.1. sub " + "w" * 60, "101. no bold", "101.1. x"]
    got = spark.createDataFrame([(units,)], "u array<string>").select(chunking.pack_rules(F.col("u"), F.lit("Head"), 20, title_flush=False).alias("c")).first().c
    assert [c.label for c in got] == ["Head — Rule 100: First", "Head — Rule 100: First", "Head — Rule 101"]
    assert got[2].content == "### Head — Rule 101\n101. no bold\n101.1. x"
    assert one(spark, chunking.pack_rules(F.col("u"), F.lit("h")), u=[]) == []


def test_segments_give_the_text_again():
    cut = entities.Segments(["Jhin Virtuoso", "Jhin Virtuoso Prime", "Eclipse"], ["hidden", "deflect"])
    text = "Pay :rb_might: [Hidden] for jhin - virtuoso prime, Eclipse DEFLECTs; :rb_no: deflect"
    got = cut.cut(text)
    assert "".join(x for _, x in got) == text
    assert [(k, x) for k, x in got if k != "text"] == [("rune", ":rb_might:"), ("keyword", "Hidden"), ("name", "jhin - virtuoso prime"), ("keyword", "deflect")]
    assert [x for _, x in cut.cut("a [hidden] b", bare=True)] == ["a ", "hidden", " b"]
    assert cut.cut("") == [] and entities.Segments([], []).cut("x") == [("text", "x")]


def test_vocabularies_of_any_size_give_one_result(spark):
    names = ["Jade Blade Dancer", "Jade", "Guardian Angel", "Iron Will (Foil)", "Élan Vital"]
    texts = ["Does Jade Blade Dancer beat Guardian Angel?", "an Angel Guardian appears", "Jade's Blade met the Dancer", "", None, "ÉLAN VITAL is here", "Will of Iron"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    vocabulary = spark.createDataFrame([(n,) for n in names], "name string")
    whole = {r.id: r.names for r in entities.mentions(rows, vocabulary).collect()}
    assert {r.id: r.names for r in entities.mentions(rows, vocabulary, at_once=2).collect()} == whole
    twice = rows.unionByName(rows).unionByName(rows.filter("id = 0"))
    for at_once in (1, 2, 100):
        got = entities.mentions(twice, vocabulary, at_once=at_once).collect()
        assert len(got) == twice.count() and all(r.names == whole[r.id] for r in got)
    assert whole[0] == ["Jade Blade Dancer", "Guardian Angel"] and whole[5] == ["Élan Vital"] and whole[6] == ["Iron Will (Foil)"]


def test_segments_do_not_depend_on_blocks(spark):
    names = ["Jade Blade", "Jade Blade Dancer", "Blade Dancer", "Dancer Of Blades", "Iron Will", "One Two (Three)"]
    texts = ["Jade - Blade  Dancer of blades", "x:rb_might:jade blade:rb_calm:Dancer", "Jade Blade, Blade Dancer; iron–will", "", None, "one two (three)s one two (three) end", "JADE BLADE DANCE"]
    rows, vocabulary = spark.createDataFrame(list(enumerate(texts)), "id long, text string"), spark.createDataFrame([(n,) for n in names], "name string")
    pick = lambda n: sorted(map(tuple, entities.segmented(rows, vocabulary, ["dance", "will"], at_once=n).collect()))
    whole = pick(100)
    assert pick(1) == pick(2) == whole
    assert [(r[2], r[3]) for r in whole if r[0] == 0] == [("name", "Jade - Blade  Dancer"), ("text", " of blades")]
    assert [r[3] for r in whole if r[2] == "name"] == ["Jade - Blade  Dancer", "jade blade", "Jade Blade", "Blade Dancer", "iron–will", "one two (three)", "JADE BLADE"]
    for i, text in enumerate(texts):
        assert "".join(r[3] for r in whole if r[0] == i) == (text or "")


def test_a_million_names(spark):
    """Names of few first words; a block's trie stays small."""
    import tracemalloc

    names = spark.range(1_000_000).select(F.format_string("Knight n%07d Of Ward %d", "id", F.col("id") % 1000).alias("name"))
    rows = spark.createDataFrame([(i, f"Knight N{i:07d} of ward {i % 1000} met Knight n{i:07d} of Ward {(i + 1) % 1000}, Ward Knight") for i in range(0, 1_000_000, 50_000)], "id long, text string").coalesce(1)
    got = {r.id: r.names for r in entities.mentions(rows, names).collect()}
    assert got == {i: [f"Knight n{i:07d} Of Ward {i % 1000}"] for i in range(0, 1_000_000, 50_000)}
    block = [f"Knight n{i:07d} Of Ward {i % 1000}" for i in range(entities.BLOCK_NAMES)]
    tracemalloc.start()
    entities.Names(block)
    assert tracemalloc.get_traced_memory()[0] < 80 << 20
    tracemalloc.stop()


def test_cascade(spark):
    index = spark.createDataFrame([("jhin virtuoso", 3), ("jhin", 9), ("jade blade", 1), ("jade-blade x", 0)], "name string, pos int")
    asked = spark.createDataFrame([("Jhin",), ("jhin-virtuoso",), ("ji",), ("jade-b",), ("ja",), (" ",)], "asked string")
    got = {r.asked: r.found for r in lookup.cascade(asked, index).collect()}
    assert got == {"Jhin": "jhin", "jhin-virtuoso": "jhin virtuoso", "ji": None, "jade-b": "jade-blade x", "ja": "jade-blade x", " ": None}


STEMS = "consigned consign consolatory consolatori knightly knight skies sky dying die relational relat hopping hop hoping hope flies fli ties tie gas gas happy happi say say by by agreed agre feed feed sized size falling fall conditional condit vietnamization vietnam sensibility sensibl replacement replac adoption adopt effective effect rate rate cease ceas controll control generously generous communism communism inning inning"


def test_stems(spark):
    from corpuslake.functions.stems import stem, stems

    words = STEMS.split()
    assert [stem(w) for w in words[::2]] == words[1::2]
    rows = spark.createDataFrame([(["agreed", "x", ""],), ([],), (None,)], "w array<string>")
    assert [r[0] for r in rows.select(stems("w")).collect()] == [["agre", "x", ""], [], None]


def test_inflected_words_meet(spark, tmp_path):
    from corpuslake.plans import catalogue

    docs = [(1, "The hopping knights"), (2, "nothing here"), (3, "hopped")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "a knight hops")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = catalogue.QUERIES["fts_or_english"](spark, str(tmp_path)).collect()
    assert [(r.doc_id, r.hits) for r in sorted(got)] == [(1, 2), (3, 1)]
