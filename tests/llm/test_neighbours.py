"""Neighbour search on few vectors, extreme lengths and lonely queries, and its tuning."""

import numpy as np
import pytest

from lurewatch.llm import neighbours


def table(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")


def answers(spark, rows, k=20):
    got = {}
    for r in neighbours.search(table(spark, rows), "vec_id % 20 = 0", k=k).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: [(i, s) for _, i, s in sorted(found)] for q, found in got.items()}


def exact(rows, q, k=20):
    vectors = dict(rows)
    scored = [(i, float((np.array(vectors[q], float) * np.array(v, float)).sum())) for i, v in rows if i != q]
    return sorted(scored, key=lambda s: (-s[1], s[0]))[:k]


@pytest.mark.parametrize("n", [1, 2, 15, 20, 21, 22, 60])
def test_few_vectors_are_all_candidates(spark, n):
    rng = np.random.default_rng(n)
    rows = list(enumerate(rng.standard_normal((n, 64))))
    got = answers(spark, rows)
    for q in range(0, n, 20):
        want = exact(rows, q)
        assert len(got.get(q, [])) == min(20, n - 1)
        assert [i for i, _ in got.get(q, [])] == [i for i, _ in want]
        assert [s for _, s in got.get(q, [])] == pytest.approx([s for _, s in want])


def test_extreme_lengths_take_part(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((25, 16))
    rows = [(i, v * 1e150) for i, v in enumerate(base)] + [(30 + i, v * 1e-160) for i, v in enumerate(base)]
    rows += [(60, np.full(16, 1e155)), (61, np.full(16, 1e-170)), (62, np.zeros(16)), (80, np.full(16, 5e-324))]
    got = answers(spark, rows)
    assert set(got) == {0, 20, 40, 60, 80}
    assert all(len(found) == 20 and 62 not in dict(found) for found in got.values())
    # Products of a length of 1e150 with any other are finite and decide as in plain arithmetic.
    plain = [r for r in rows if r[0] not in (60, 61, 62, 80)]
    for q in (0, 20):
        best = [i for i, _ in exact(plain, q)][:5]
        assert [i for i, _ in got[q] if i in dict(plain)][:5] == best


def test_a_query_that_points_away_finds_all(spark):
    rng = np.random.default_rng(2)
    cluster = np.eye(32)[0] + 0.01 * rng.standard_normal((1500, 32))
    rows = [(2 * i + 1, v) for i, v in enumerate(cluster)] + [(0, -np.eye(32)[0])]
    got = answers(spark, rows)
    assert [i for i, _ in got[0]] == [i for i, _ in exact(rows, 0)]


@pytest.mark.parametrize("clusters", [0, 40])
def test_recall_with_hashes(spark, clusters):
    rng = np.random.default_rng(3)
    rows = rng.standard_normal((4000, 32))
    if clusters:
        rows = rng.standard_normal((clusters, 32))[rng.integers(0, clusters, 4000)] + 0.2 * rows
    rows = list(enumerate(rows))
    got, hits = answers(spark, rows), 0
    for q in range(0, 4000, 20):
        hits += len({i for i, _ in got[q]} & {i for i, _ in exact(rows, q)})
        assert len(got[q]) == 20
    assert hits / (200 * 20) >= 0.93


def test_plan_grows_with_the_table():
    rng = np.random.default_rng(4)
    queries = rng.standard_normal((20, 64))
    queries /= np.linalg.norm(queries, axis=1, keepdims=True)
    owner = np.repeat(np.arange(20), 5)
    near = queries[owner] + 0.05 * rng.standard_normal((100, 64))
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    hashes = [neighbours.plan(n, queries, near, owner)[0] for n in (1000, 100_000, 10**8, 10**11)]
    assert hashes[0] == 0 and hashes == sorted(hashes) and hashes[-1] >= 3
    assert neighbours.plan(10**6, queries, near[:0], owner[:0])[1] == 1


def test_a_query_goes_to_a_cell_once(spark):
    """However many buckets it looks into; a row a bucket, with the vector in each, filled executors."""
    rng = np.random.default_rng(5)
    rows = neighbours.usable(table(spark, list(enumerate(rng.standard_normal((40, 32))))), "vec_id", "embedding")
    bands = {(32, 5): (0.0, False, 2, 300, 100_000)}
    looks = neighbours._keyed(rows, bands, 4, "query", "same", "string").collect()
    assert len(looks) == 40
    for row in looks:
        found = [(at.tbl, at.cell, code) for at in row.looks for code in at.codes]
        assert len({(tbl, code) for tbl, _, code in found}) == len(found) == 4 * 300
        assert len({(tbl, cell) for tbl, cell, _ in found}) == len(row.looks) <= 4 * neighbours.CELLS


@pytest.mark.parametrize("at_once", [8, 64, 1 << 19])
def test_the_best_of_a_cell(monkeypatch, at_once):
    """Ranked in one go or in many; an id with several vectors counts with its best one."""
    import pyarrow as pa

    monkeypatch.setattr(neighbours, "AT_ONCE", at_once)
    rng = np.random.default_rng(6)
    q, v = rng.integers(-2, 3, (9, 4)).astype(float), rng.integers(-2, 3, (60, 4)).astype(float)
    ids, codes = rng.integers(0, 40, 60), rng.integers(0, 5, 60)
    asked = [sorted(rng.choice(6, rng.integers(1, 6), replace=False).tolist()) for _ in q]
    asking = pa.table({"same": [f"q{i}" for i in range(9)], "vector": list(q), "codes": asked})
    held = pa.table({"vec_id": ids, "vector": list(v), "codes": [[int(c)] for c in codes]})
    got = {r["same"]: list(zip(r["vec_ids"], r["scores"], strict=True)) for r in neighbours._nearest(asking, held, 6).to_pylist()}
    for i, buckets in enumerate(asked):
        best = {}
        for j in np.flatnonzero(np.isin(codes, buckets)):
            best[int(ids[j])] = max(best.get(int(ids[j]), -np.inf), float(q[i] @ v[j]))
        assert got.get(f"q{i}", []) == sorted(best.items(), key=lambda x: (-x[1], x[0]))[:6]
