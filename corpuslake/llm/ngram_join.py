"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A document's set is its distinct n-word shingles (A-Z lower-cased), as 64-bit digests under a key
drawn for each run, so that no text can be written to collide. Documents with equal sets (equal
128-bit digests of them) are one class with a number of its own; the join works on classes.
Shingles are ordered rare first by approximate corpus frequency (counts of cells over all
documents), ties by digest. Two classes
with Jaccard of `percent`/100 or more share a shingle of their prefixes, so pairs come from an
equi-join on prefix shingles. They pass the length filter, the positional filter (what may still
overlap after the shared place) and the suffix filter (sets cut into hash ranges: the differences
in range sizes bound the overlap); what is left is verified once per pair on the whole sets.

Large groups of near copies would make all their pairs. Links are therefore found in two rounds.
Round one pairs each prefix shingle's classes with one pivot, the class with the fewest rarer
shingles. Round two joins all classes of a shingle, but only across the components that round one
left, so its pairs are those that could still change the result. No link between components is
lost, and no cap is set.

Cases: a null text, or one without words, has an empty set and is alone; with fewer words than n
the whole sequence is one shingle; repeated rows and equal sets are linked; null ids take part and
never become a component's id unless all its ids are null; an empty table gives an empty result.
"""

from __future__ import annotations

import secrets
import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslake.llm.components import components
from corpuslake.llm.runtime import as_text, dropped, hot_keys, returning, salted_join, schema_with, settled
from corpuslake.llm.textbatch import Texts, slices

#: Cells of the frequency table (4 bytes each, broadcast), and how many are sent as one row.
FREQUENCY_CELLS = 1 << 22
BLOCK_CELLS = 1 << 16
#: Sets are cut into 2^RANGE_BITS hash ranges for the suffix filter.
RANGE_BITS = 5
#: Bits of the bounded filter that keeps texts of no candidate class from being read into sets.
FILTER_CELLS = 1 << 22
#: A cell of over HOT_CELL times the mean (and HOT_ROWS) may hold a shingle of many classes: such shingles are salted.
HOT_CELL, HOT_ROWS, SALTS = 4, 100, 64
#: Classes of one shingle that face as many others at once in round two.
BLOCK = 256
#: Bytes of text whose words a task holds at once.
SLICE = 1 << 19
U = np.uint64


def new_key() -> int:
    """The key of a run, a base of 60 bits. Results do not depend on it."""
    return secrets.randbits(60) | 1 << 59


def shingle_sets(column: pa.Array, n: int, key: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle digests of each text."""
    texts = Texts(column, lower_ascii=True)
    words = texts.digests(key)
    hashes, place = texts.grams(words, n)
    owner = texts.owner[place]
    ends = np.searchsorted(owner, np.arange(texts.n), "right")
    start = 0
    for i, end in enumerate(ends):
        if end > start:
            yield np.unique(hashes[start:end])
        elif texts.counts[i]:  # shorter than a shingle: one digest for all its words
            few = words[texts.first[i] : texts.first[i + 1]].tobytes()
            yield np.frombuffer(blake2b(few, digest_size=8, key=key.to_bytes(16)).digest(), U)
        else:
            yield np.zeros(0, U)
        start = end


def digest_of(found: np.ndarray, key: int) -> tuple[int, int]:
    """The two halves of a set's 128-bit digest."""
    high, low = np.frombuffer(blake2b(found.tobytes(), digest_size=16, key=key.to_bytes(16)).digest(), np.int64)
    return int(high), int(low)


def least_overlap(a: Column, b: Column, percent: int) -> Column:
    """The least intersection of sets of sizes a and b with Jaccard of percent/100: ceil(p (a+b) / (100+p))."""
    return F.floor((F.lit(percent) * (a + b) + F.lit(99 + percent)) / F.lit(100 + percent))


def frequencies(docs: DataFrame, n: int, key: int, cells: int = FREQUENCY_CELLS) -> np.ndarray:
    """Shingles of all documents by digest cell: a table of fixed size.

    Each task sends its counts as compressed blocks of BLOCK_CELLS cells (of 16 bits; a count that
    does not fit stays at the largest), which are added up block by block."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int32)
        for batch in batches:
            for _, part in slices(batch.column("text"), SLICE):
                texts = Texts(part, lower_ascii=True)
                hashes, _ = texts.grams(texts.digests(key), n)
                np.add.at(total, (hashes & U(cells - 1)).astype(np.int64), 1)
        for i, block in enumerate(total.reshape(-1, min(BLOCK_CELLS, cells))):
            small = zlib.compress(np.minimum(block, 65_535).astype(np.uint16).tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([small], pa.binary())], ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                block = np.frombuffer(zlib.decompress(counts), np.uint16)
                totals[i] = totals.get(i, 0) + block.astype(np.int64)
        for i, block in totals.items():
            held = np.minimum(block, (1 << 31) - 1).astype(np.int32).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([held], pa.binary())], ["block", "counts"])

    sent = docs.select("text").mapInArrow(returning(count), "block int, counts binary").repartition("block")
    out = np.zeros(cells, np.int32).reshape(-1, min(BLOCK_CELLS, cells))
    for row in sent.mapInArrow(returning(add), "block int, counts binary").collect():  # 4 bytes a cell in all
        out[row["block"]] = np.frombuffer(row["counts"], np.int32)
    return out.reshape(-1)


def signatures(docs: DataFrame, n: int, percent: int, key: int, frequency: np.ndarray) -> DataFrame:
    """One row per document: doc_id, n_shingles, high and low (digest of the set), prefix (shingles, rare
    first), rare (how many of them lie in cells that are not frequent) and ranges (shingles by digest range)."""
    shared = docs.sparkSession.sparkContext.broadcast(frequency)
    often = max(HOT_ROWS, HOT_CELL * float(frequency.mean()))
    names = ["doc_id", "n_shingles", "high", "low", "rare", "prefix", "ranges"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for first, part in slices(batch.column("text"), SLICE):
                sizes, highs, lows, rare, prefixes, ranges = [], [], [], [], [], []
                for found in shingle_sets(part, n, key):
                    size = len(found)
                    keep = size - (percent * size + 99) // 100 + 1 if size else 0
                    rank = table[(found & U(len(table) - 1)).astype(np.int64)]
                    order = np.argsort(rank, kind="stable")[:keep]
                    high, low = digest_of(found, key)
                    sizes.append(size)
                    highs.append(high)
                    lows.append(low)
                    prefixes.append(found[order].view(np.int64))
                    rare.append(int((rank[order] <= often).sum()))
                    ranges.append(np.bincount((found >> U(64 - RANGE_BITS)).astype(np.int64), minlength=1 << RANGE_BITS).astype(np.int32))
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(prefixes)))
                ids = batch.column("doc_id").slice(first, len(part))
                numbers = [pa.array(x, pa.int64()) for x in (sizes, highs, lows, rare)]
                yield pa.RecordBatch.from_arrays([ids, *numbers, lists, pa.array(ranges, pa.list_(pa.int32()))], names)

    schema = "doc_id long, n_shingles long, high long, low long, rare long, prefix array<long>, ranges array<int>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(returning(sign), schema)


def classes_of(signed: DataFrame) -> DataFrame:
    """Distinct sets: class_id (a number), high, low, size, rare, prefix, ranges, least (doc_id). Copies are
    merged before the shuffle, so a group of them sends one row from each task."""
    same = [F.first(c).alias(c) for c in ("rare", "prefix", "ranges")]
    rows = signed.filter("n_shingles > 0").groupBy("high", "low").agg(F.first("n_shingles").cast("int").alias("size"), *same, F.min("doc_id").alias("least"))
    return rows.withColumn("class_id", F.monotonically_increasing_id())


def shared_places(classes: DataFrame) -> DataFrame:
    """token, class_id, size, pos and the token's pivot, for prefix shingles that two or more classes have.

    Tokens of frequent cells, which many classes may share, are counted before they are shuffled, and
    their places are dealt over SALTS tasks; all others need one shuffle."""
    places = classes.select("class_id", "size", "rare", F.posexplode("prefix").alias("pos", "token"))
    # Few rarer shingles come first, ties by class: one number, so that the aggregate stays hash-based.
    rank = F.col("pos").cast("long") * F.lit(1 << 40) + F.pmod("class_id", F.lit(1 << 40))

    def with_pivots(rows: DataFrame, keys: list[str]) -> DataFrame:
        tokens = rows.groupBy("token").agg(
            F.count(F.lit(1)).alias("classes"), F.min_by("class_id", rank).alias("pivot"), F.min_by("size", rank).alias("pivot_size"), F.min_by("pos", rank).alias("pivot_pos")
        )
        tokens = tokens.filter("classes > 1")
        if len(keys) > 1:
            tokens = tokens.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return rows.join(tokens, keys).select("token", "class_id", "size", "pos", "classes", "pivot", "pivot_size", "pivot_pos")

    # One shuffle serves both the grouping and the join.
    few = with_pivots(places.filter("pos < rare").repartition("token"), ["token"])
    many = with_pivots(places.filter("pos >= rare").withColumn("salt", F.pmod(F.xxhash64("class_id"), F.lit(SALTS)).cast("int")), ["token", "salt"])
    return few.unionByName(many)


def may_link(a: str, b: str, percent: int) -> Column:
    """Length and positional filters for columns size and pos with the given prefixes.

    The shorter set need share one of its indexing prefix only, the longer one of its probing prefix."""
    size_a, size_b, pos_a, pos_b = (F.col(f"{x}{c}") for c in ("size", "pos") for x in (a, b))
    short, long = F.least(size_a, size_b), F.greatest(size_a, size_b)
    overlap = least_overlap(size_a, size_b, percent)
    after = F.least(size_a - pos_a, size_b - pos_b)
    return (short * 100 >= long * percent) & (after >= overlap)


def sets_of(pairs: DataFrame, docs: DataFrame, n: int, key: int) -> DataFrame:
    """high, low, shingles (sorted digests): the sets of the pairs' classes, once each, and of few others.

    They are made anew from the texts; a bounded bit table keeps nearly all other sets in their task."""
    wanted = pairs.select(F.explode(F.array("left_low", "right_low")).alias("low"))
    cells = wanted.select(F.pmod("low", F.lit(FILTER_CELLS)).cast("int").alias("cell")).distinct().toPandas()["cell"]
    table = np.zeros(FILTER_CELLS, bool)
    table[cells] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(table))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value)
        for batch in batches:
            for _, part in slices(batch.column("text"), SLICE):
                rows = [(*d, s.tobytes()) for s in shingle_sets(part, n, key) if len(s) and bits[(d := digest_of(s, key))[1] % FILTER_CELLS]]
                columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, ["high", "low", "shingles"])

    rows = docs.select("text").mapInArrow(returning(collect), "high long, low long, shingles binary")
    return rows.groupBy("high", "low").agg(F.first("shingles").alias("shingles"))  # copies are merged before the shuffle


#: The columns that name the classes of a pair.
LEFT, RIGHT = ["left_high", "left_low"], ["right_high", "right_low"]


def close(pairs: DataFrame, total: int, classes: DataFrame, percent: int) -> DataFrame:
    """Suffix filter: what two sets share in a digest range is at most the smaller of their counts there. The pairs
    that pass, with the digests of their sets."""

    def side(name: str) -> DataFrame:
        return classes.select(F.col("class_id").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("high", "low", "size", "ranges")])

    hot = hot_keys(pairs, ["left"], ["right"], total=total)
    sized = salted_join(salted_join(pairs, side("left"), ["left"], hot[0]), side("right"), ["right"], hot[1])
    shared = F.aggregate(F.zip_with("left_ranges", "right_ranges", lambda a, b: F.least(a, b)), F.lit(0), lambda total, x: total + x)
    return sized.filter(shared >= least_overlap(F.col("left_size"), F.col("right_size"), percent)).select("left", "right", *LEFT, *RIGHT)


def verified(pairs: DataFrame, total: int, docs: DataFrame, n: int, percent: int, key: int) -> DataFrame:
    """The pairs (left, right) of classes whose Jaccard is percent/100 or more, by their whole sets.

    Sets lie by their digests after the shuffle that merges copies, and are met there; a pair then takes its left set
    to its right one."""
    sets = sets_of(pairs, docs, n, key)

    def side(name: str) -> DataFrame:
        return sets.select(F.col("high").alias(f"{name}_high"), F.col("low").alias(f"{name}_low"), F.col("shingles").alias(f"{name}_shingles"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for a, b in zip(batch.column("left_shingles"), batch.column("right_shingles"), strict=True):
                x, y = np.frombuffer(a.as_buffer(), U), np.frombuffer(b.as_buffer(), U)
                common = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["left", "right"]).filter(pa.array(linked, pa.bool_()))

    hot = hot_keys(pairs, LEFT, RIGHT, total=total)
    both = salted_join(salted_join(pairs, side("left"), LEFT, hot[0]), side("right"), RIGHT, hot[1])
    return both.select("left", "right", "left_shingles", "right_shingles").mapInArrow(returning(compare), "left long, right long")


def pivot_pairs(places: DataFrame, percent: int) -> DataFrame:
    """Round one: each class of a token with the token's pivot."""
    rows = places.filter(F.col("class_id") != F.col("pivot")).withColumnsRenamed({"pivot_size": "p_size", "pivot_pos": "p_pos"})
    rows = rows.select("class_id", "pivot", F.col("size").alias("c_size"), F.col("pos").alias("c_pos"), "p_size", "p_pos")
    rows = rows.filter(may_link("c_", "p_", percent))
    return rows.select(F.least("class_id", "pivot").alias("left"), F.greatest("class_id", "pivot").alias("right")).distinct()


def cross_pairs(places: DataFrame, roots: DataFrame, percent: int, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Round two: classes of a token that lie in different components; and the table that they are made from.

    Tokens within one component are left out, and so are those of two classes, which round one compared.
    Of any two components one at least is not that of the token's pivot, its home; so the classes away
    from home, in blocks, meet all classes, in blocks, and each pair of blocks is a task's key. What is compared is
    the classes away from home times all, not all times all. Only pairs that pass the filters leave the join."""
    rows = places.filter("classes > 2").select("token", "class_id", "size", "pos", "classes", "pivot").join(roots.hint("merge"), "class_id", "left")
    parts = F.ceil(F.col("classes") / block).cast("int")
    rows = rows.withColumn("root", F.coalesce("root", "class_id")).withColumn("block", F.pmod(F.xxhash64("class_id"), parts).cast("int"))
    home = F.max(F.when(F.col("class_id") == F.col("pivot"), F.col("root")))
    tokens = rows.groupBy("token").agg(F.min("root").alias("a"), F.max("root").alias("b"), home.alias("home"), F.first(parts).alias("parts")).filter("a <> b")
    spread = tokens.select("token", "home", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block"))
    rows = settled(rows.select("token", "class_id", "size", "pos", "root", "block").join(spread, ["token", "block"]))
    away = rows.filter("root <> home")
    groups = away.groupBy("token", "parts").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("groups"))
    spread = groups.select("token", "groups", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block"))
    values = ("class_id", "size", "pos", "root")
    left = away.join(spread, ["token", "block"]).select("token", F.pmod(F.xxhash64("class_id", F.lit(1)), "groups").cast("int").alias("group"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block"), *[F.col(c).alias(f"l_{c}") for c in values])
    right = rows.join(spread, ["token", "block"]).select("token", "block", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), *[F.col(c).alias(f"r_{c}") for c in values])
    pairs = left.join(right, ["token", "group", "block"]).filter((F.col("l_root") != F.col("r_root")) & may_link("l_", "r_", percent))
    return pairs.select(F.least("l_class_id", "r_class_id").alias("left"), F.greatest("l_class_id", "r_class_id").alias("right")).distinct(), rows


def checked(pairs: DataFrame, classes: DataFrame, docs: DataFrame, n: int, percent: int, key: int) -> tuple[DataFrame, DataFrame]:
    """The pairs, and those of them that link. A class of many pairs is spread over tasks."""
    number = F.count(F.lit(1)).alias("pairs")
    pairs, seen = settled(pairs, number)
    near, left = settled(close(pairs, seen["pairs"], classes, percent), number)
    linked = settled(verified(near, left["pairs"], docs, n, percent, key))
    dropped(near)
    return pairs, linked


def joined(docs: DataFrame, n: int, percent: int, key: int) -> DataFrame:
    """doc_id, n_shingles, high, low, component_id: one row per document.

    Documents link when 100 * intersection >= percent * union; component_id is the least doc_id
    that links reach. Texts are read for frequencies, for prefixes and for the sets of both rounds' candidates, once for
    each side of the pairs where Spark does not reuse the exchange, and never shuffled. Tables that the result does not
    read are emptied."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    signed = settled(signatures(docs, n, percent, key, frequencies(docs, n, key)).withColumn("row", F.monotonically_increasing_id()))
    classes = settled(classes_of(signed))
    places = settled(shared_places(classes))
    tried, links = checked(pivot_pairs(places, percent), classes, docs, n, percent, key)
    roots = components(links)
    across, rows = cross_pairs(places, roots, percent)
    pairs, extra = checked(across.join(tried, ["left", "right"], "left_anti"), classes, docs, n, percent, key)
    dropped(places, tried, links, rows, pairs)
    if not extra.isEmpty():
        star = roots.select(F.col("class_id").alias("left"), F.col("root").alias("right")).filter(F.col("left") != F.col("right"))
        first, roots = roots, components(star.unionByName(extra))
        dropped(first)
    dropped(extra)
    return named(signed, classes, roots)


def named(signed: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """Documents with the least doc_id of their class's component."""
    linked = settled(roots.join(classes.select("class_id", "least").hint("merge"), "class_id"))
    dropped(roots)
    of_root = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    merged = salted_join(linked, of_root, ["root"], hot_keys(linked, ["root"])[0]).select("class_id", "component_id")
    merged = classes.select("class_id", "high", "low", "least").join(merged.hint("merge"), "class_id", "left")
    merged = settled(merged.select("high", "low", F.coalesce("component_id", "least").alias("component_id")))
    dropped(linked, classes)
    rows = signed.select("doc_id", "n_shingles", "high", "low", "row")  # `row` spreads repeated rows of a hot set
    out = salted_join(rows, merged, ["high", "low"], hot_keys(rows, ["high", "low"])[0], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", "high", "low", component.alias("component_id"))


def clustered(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per document."""
    return joined(docs, n, percent, new_key()).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The documents less all but one of each component: the one with the least doc_id stays.

    Documents without words all stay. Of rows that repeat the same id and set, one stays. All
    columns stay, whatever their names; texts are shuffled once, by id, so that copies spread."""
    key = new_key()
    found = joined(docs, n, percent, key).filter("n_shingles > 0")
    high, low, known, number = same = [unused(docs, x) for x in ("high", "low", "known", "number")]
    first = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    chosen = found.groupBy("component_id").agg(F.min(F.struct(first, "n_shingles", "doc_id", "high", "low")).alias("one"))
    chosen = settled(chosen.select(F.col("one.high").alias(high), F.col("one.low").alias(low), *numbers(F.col("one.doc_id"), known, number)))
    schema = schema_with(docs, T.StructField(high, T.LongType()), T.StructField(low, T.LongType()))

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows with their sets' digests. A task sends one row of those that repeat id and set; it remembers some 100 bytes a row."""
        seen: set[bytes] = set()
        for batch in batches:
            for start, part in slices(batch.column("text"), SLICE):
                keys = [digest_of(s, key) if len(s) else (None, None) for s in shingle_sets(part, n, key)]
                halves = [pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)]
                rows = pa.RecordBatch.from_arrays([*batch.slice(start, len(part)).columns, *halves], [*batch.schema.names, high, low])
                first = []
                for doc_id, (a, b) in zip(rows.column("doc_id").to_pylist(), keys, strict=True):
                    name = f"{doc_id},{a},{b}".encode()
                    first.append(a is not None and name not in seen)
                    seen.add(name)
                yield rows.filter(pa.array(first, pa.bool_()))

    rows = docs.mapInArrow(returning(classed), schema).select("*", *numbers(F.col("doc_id"), known, number))
    # The join and the removal of repeated rows go by the same columns, so one shuffle serves both.
    kept = rows.join(chosen.hint("merge"), same, "left_semi").dropDuplicates(same).drop(*same)
    wordless = docs.filter(~as_text("text").rlike(r"[^\x20\x09-\x0D]"))
    return kept.unionByName(wordless)


def numbers(column: Column, known: str, number: str) -> list[Column]:
    """Two columns without nulls that tell an id, or its absence, apart from all others."""
    return [column.isNotNull().alias(known), F.coalesce(column.cast("long"), F.lit(0)).alias(number)]


def unused(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as make it new to the columns."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name
