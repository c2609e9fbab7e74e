"""Nearest rows against a full sort, and the error bounds of the int8 products."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.llm import vector_search as vs

SCHEMA = "vec_id long, embedding array<float>, label int, rid string, block string, v int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "y", 2) for i, v in rows], SCHEMA)


def brute(rows, k, every):
    """(query position, query id) -> [(id, score)], in plain Python."""
    kept = [(at, i, [float(np.float32(x)) for x in v]) for at, (i, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for at, i, v in kept:
        if i is None or i % every:
            continue
        found = []
        for other, j, w in kept:
            if other != at and len(w) == len(v):
                score = 0.0
                for a, b in zip(v, w):
                    score += a * b
                found.append((-score, j is None, j or 0, j))
        found.sort()
        out.append((i, [(j, -s) for s, _, _, j in found[:k]]))
    return sorted(out, key=repr)


def found(df):
    out = {}
    for n, r in enumerate(sorted(df.collect(), key=lambda r: (r.query_id, r["rank"]))):
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


def random_rows(seed, n, width=16):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(4)]
    return [(i, [float(np.float32(x + rng.gauss(0, 0.05))) for x in rng.choice(centres)]) for i in range(n)]


@pytest.mark.parametrize("block_rows, least_rows", [(32768, 2048), (16, 8)])
def test_nearest_match_a_full_sort(spark, block_rows, least_rows):
    rows = random_rows(block_rows, 200)
    # A third of all rows are equal, others differ in the last bits.
    rows += [(1000 + i, rows[0][1]) for i in range(100)] + [(2000 + i, [x * (1 + 1e-6 * i) for x in rows[0][1]]) for i in range(30)]
    rows += [(3000, None), (3001, []), (3020, [0.0] * 16), (3040, [None] + [1.0] * 15), (3060, [float("nan")] * 16), (3080, [float("inf")] * 16)]
    rows += [(4000, [1.0, 2.0]), (4001, [2.0, 1.0]), (None, rows[0][1]), (None, rows[7][1]), (5000, rows[0][1])]
    random.Random(2).shuffle(rows)
    got = found(vs.nearest_rows(vectors(spark, rows).repartition(3), F.col("vec_id") % 20 == 0, k=7, block_rows=block_rows, least_rows=least_rows))
    want = brute(rows, 7, 20)
    assert sorted(got) == [i for i, _ in sorted(want)]
    for i, best in want:
        assert got[i] == [(n, j, s) for n, (j, s) in enumerate(best, 1)]


def test_rows_of_equal_id_are_rows_of_their_own(spark):
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (7, [0.5, 0.0]), (8, [0.5, 0.0])]
    got = vs.nearest_rows(vectors(spark, rows), F.col("vec_id") % 20 == 0, k=3).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in got) == [(1, 20, 1.0)] * 2 + [(2, 7, 0.5)] * 2 + [(3, 8, 0.5)] * 2


def test_fewer_candidates_and_empty_tables(spark):
    one = vs.nearest_rows(vectors(spark, [(0, [1.0])]), F.col("vec_id") % 20 == 0)
    assert one.count() == 0
    two = vs.nearest_rows(vectors(spark, [(0, [1.0]), (20, [-1.0])]), F.col("vec_id") % 20 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in two) == [(0, 1, 20, -1.0), (20, 1, 0, -1.0)]
    none = vs.nearest_rows(vectors(spark, []), F.col("vec_id") % 20 == 0)
    assert none.count() == 0 and none.columns == ["query_id", "rank", "vec_id", "score"]
    nobody = vs.nearest_rows(vectors(spark, [(1, [1.0]), (2, [1.0])]), F.col("vec_id") % 20 == 0)
    assert nobody.count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(9)
    for scale in (1e-30, 1.0, 1e6):
        a, b = rng.normal(size=(30, 24)) * scale, rng.normal(size=(50, 24)) * scale
        about, off = vs.product_bounds(vs.Rounded(a), 0, 30, vs.Rounded(b))
        assert (np.abs(a @ b.T - about) <= off).all()
        # Tight enough to leave most pairs out.
        assert (off < 0.05 * np.abs(a @ b.T).max()).all()


def test_doubles_and_whole_numbers(spark):
    rows = [(0, [1, 2]), (1, [2, 1]), (2, [3, 3])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<int>")
    got = vs.nearest_rows(df, F.col("vec_id") == 0).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(2, 9.0), (1, 4.0)]
