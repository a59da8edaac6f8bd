import zlib
from collections import Counter

import numpy as np

from corpuslake.llm import queries, sharding


def brute(key, shards):
    mask = (1 << 64) - 1
    key &= mask
    key = ((key ^ (key >> 30)) * 0xBF58476D1CE4E5B9) & mask
    key = ((key ^ (key >> 27)) * 0x94D049BB133111EB) & mask
    key ^= key >> 31
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & mask
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_is_the_published_loop_and_moves_little():
    keys = np.arange(4000, dtype=np.uint64)
    for n in (1, 2, 16, 17):
        assert sharding.jump(keys, n).tolist() == [brute(k, n) for k in range(4000)]
    before, after = sharding.jump(keys, 16), sharding.jump(keys, 17)
    assert set(after[before != after]) == {16}
    assert abs((before != after).mean() - 1 / 17) < 0.02


def test_all_documents(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = queries.op3_sharding(spark, small).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        raw = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert (r.shard, r.grown_shard) == (brute(r.doc_id, 16), brute(r.doc_id, 17))
    sizes = Counter(r.shard for r in got)
    assert sorted((r.shard, r.slot) for r in got) == sorted((s, i) for s, n in sizes.items() for i in range(n))


def test_odd_rows(odd, empty):
    got = sharding.sharded(odd).collect()
    assert len(got) == odd.count()
    sizes = Counter(r.shard for r in got)
    assert sorted((r.shard, r.slot) for r in got) == sorted((s, i) for s, n in sizes.items() for i in range(n))
    assert {r["size"] for r in got if r.doc_id == 1} == {1}
    assert sharding.sharded(empty).count() == 0


def test_one_key_holds_most_rows(spark):
    docs = spark.range(6000).selectExpr("if(id % 3 > 0, 7L, id) as doc_id", "'same' as text").repartition(6)
    got = sharding.sharded(docs).toPandas()
    for _, group in got.groupby("shard"):
        assert sorted(group.slot) == list(range(len(group)))
