"""Links and components against all pairs: cliques beyond a list, pairs, copies, odd rows."""

import numpy as np
import pytest

from corpuslake.llm import embedding_dedup as E

SCHEMA = "vec_id long, embedding array<float>, label int, kept int, n_links string"


def brute(rows, threshold=0.93):
    def good(v, label):
        return label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)

    out, n = [], len(rows)
    links = [set() for _ in rows]
    units = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if good(v, label) else None for _, v, label, *_ in rows]
    for i in range(n):
        for j in range(i):
            if units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold:
                links[i].add(j)
                links[j].add(i)
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        component = min(ids) if ids else None
        out.append((rows[i][0], len(links[i]), component, rows[i][0] == component))
    return out


def near(rng, centre, spread):
    return [float(x) for x in np.float32(centre + spread * rng.standard_normal(len(centre)) / np.sqrt(len(centre)))]


def vectors():
    rng = np.random.default_rng(8)
    rows = [(i, near(rng, rng.standard_normal(24), 0), i % 3) for i in range(600)]
    for label, size in ((0, 150), (1, 40), (2, 17)):  # beyond a list, and one that just fills it
        centre = rng.standard_normal(24)
        centre /= np.linalg.norm(centre)
        rows += [(len(rows) + i, near(rng, centre, 0.08), label) for i in range(size)]
    for _ in range(40):
        centre = rng.standard_normal(24)
        centre /= np.linalg.norm(centre)
        rows += [(len(rows) + i, near(rng, centre, 0.1), 1) for i in range(2)]
    rows += [(5000 + i, rows[0][1], 0) for i in range(30)] + [(6000, rows[0][1], 1), (6001, [3 * x for x in rows[0][1]], 0)]
    rows += [(7000, None, 1), (7001, [0.0] * 24, 1), (7002, [1.0, None] * 12, 1), (7003, [float("nan")] * 24, 1), (7004, rows[1][1], None), (7005, [1.0, 2.0], 1), (7006, [], 1), (None, rows[2][1], 2), (2, rows[2][1], 2)]
    return [(*r, None, "x") for r in rows]


def test_links_and_components_are_those_of_all_pairs(spark, monkeypatch):
    rows = vectors()
    monkeypatch.setattr(E, "TILE", 64)
    found = E.clustered(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert found.columns == ["vec_id", "n_links", "component_id", "kept", "recall"]
    got = [tuple(r)[:4] for r in found.collect()]
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    assert found.first()["recall"] >= E.RECALL


def test_more_orders_come_until_the_audit_is_content(spark):
    """One order of few nodes misses links; the audit asks for more."""
    rows = vectors()
    found = E.clustered(spark.createDataFrame(rows, SCHEMA), tables=1, floor=0.9)
    expected = {r[0]: r for r in brute(rows)}
    share = np.mean([r["n_links"] / expected[r["vec_id"]][1] for r in found.collect() if r["vec_id"] is not None and expected[r["vec_id"]][1]])
    assert share >= 0.95


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)], [(1, [1.0, 0.0], 4, None, None)]])
def test_small_tables(spark, rows):
    found = E.clustered(spark.createDataFrame(rows, SCHEMA))
    assert [tuple(r)[:4] for r in found.collect()] == [(1, 0, 1, True)] * len(rows)


def test_labels_do_not_meet(spark):
    rows = [(i, [1.0, 0.1 * i], i % 2, None, None) for i in range(6)]
    assert sorted(tuple(r)[:4] for r in E.clustered(spark.createDataFrame(rows, SCHEMA)).collect()) == sorted(brute(rows))
