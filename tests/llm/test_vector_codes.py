"""Product codes against plain Lloyd rounds, and the cover trees' invariants."""

import math
import random

import numpy as np
import pytest

from skyledger.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, v string, trees int, entry string"


def vectors(spark, rows):
    """(id, vector, label) with extra columns whose names the operator uses itself."""
    return spark.createDataFrame([(*r, "x", 1, None) for r in rows], SCHEMA)


def lloyd(rows, entries, parts, rounds):
    """The contract in plain Python: rows of (id, vector, label), in any order."""
    kept = [(i, [math.floor(1024 * np.float32(x).astype(float)) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]

    def best(x, book):
        far = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in book]
        return min(range(len(far)), key=lambda k: (far[k], k)), min(far)

    for _ in range(rounds):
        for p, book in enumerate(books):
            held = [[] for _ in book]
            for _, v, _ in kept:
                held[best(cut(v, p), book)[0]].append(cut(v, p))
            books[p] = [[sum(c) // len(h) for c in zip(*h)] if h else e for h, e in zip(held, book)]
    out = []
    for i, v, label in kept:
        found = [best(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for k, _ in found), sum(d for _, d in found), label))
    return out, books


def random_rows(seed, n, width=8):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(5)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        v = [float(np.float32(x + rng.gauss(0, 0.1))) for x in c]
        if rng.random() < 0.3:
            v = [float(np.float32(x)) for x in centres[0]]
        rows.append((i * 3 - 40, v, rng.choice([None, 1, 2])))
    return rows


@pytest.mark.parametrize("block_rows", [7, 64, 4096])
def test_codes_match_plain_rounds(spark, block_rows):
    rows = random_rows(block_rows, 150)
    rows += [(1, None, 1), (2, [1.0, None] * 4, 1), (4, [float("nan")] * 8, 2), (5, [float("inf")] + [0.0] * 7, 2), (7, [], None), (8, [1.0, 2.0], 1)]
    rows.append((1000, rows[3][1], 2))
    random.Random(1).shuffle(rows)
    coded, books = vc.compress(vectors(spark, rows).repartition(3), entries=20, parts=4, rounds=4, block_rows=block_rows)
    want, want_books = lloyd([r for r in rows if r[1] and len(r[1]) == 8], 20, 4, 4)
    got = [(r.vec_id, r.code, r.error, r.label) for r in coded.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert [b.tolist() for b in books] == want_books


def test_ties_repeats_and_null_ids(spark):
    same = [0.5] * 8
    rows = [(None, same, None), (3, same, 1), (3, [0.25] * 8, 1), (9, [0.75] * 8, None), (9, [0.75] * 8, None), (11, [0.375] * 8, 1)]
    coded, books = vc.compress(vectors(spark, rows), entries=4, rounds=1)
    # Equal ids are ordered by their numbers, null ids come last; of equal entries the lowest index wins.
    codes = {}
    for r in coded.collect():
        codes.setdefault((r.vec_id, r.label), set()).add(r.code)
    assert codes[(None, None)] == {"01" * 4}
    assert codes[(9, None)] == {"02" * 4} and codes[(3, 1)] == {"00" * 4, "01" * 4}
    assert codes[(11, 1)] == {"00" * 4}
    totals = {r.of_label: r.label_error for r in vc.label_errors(coded).collect()}
    assert set(totals) == {None, 1} and len(books[0]) == 4


def test_empty_tables_and_uneven_parts(spark):
    coded, books = vc.compress(vectors(spark, []))
    assert coded.count() == 0 and books == [] and coded.columns == ["vec_id", "label", "code", "error"]
    assert vc.compress(vectors(spark, [(1, None, 1)]))[0].count() == 0
    coded, books = vc.compress(vectors(spark, [(i, [float(i)] * 7, i) for i in range(5)]))
    assert [b.shape[1] for b in books] == [1, 2, 2, 2] and coded.count() == 5


def test_large_components_saturate(spark):
    coded, _ = vc.compress(vectors(spark, [(1, [1e30] * 8, 1), (2, [-1e30] * 8, 1), (3, [0.0] * 8, 1)]), entries=1, rounds=0)
    errors = {r.vec_id: r.error for r in coded.collect()}
    assert errors[1] == 0 < errors[3] < errors[2] < 2**63


def test_cover_tree_invariants():
    rng = np.random.default_rng(3)
    points = np.unique(rng.integers(-300, 300, (400, 6)), axis=0)
    order, nodes, radii = vc.cover_tree(points)
    own = points[order]
    assert sorted(order.tolist()) == list(range(len(points)))
    for (centre, low, high, child, children), radius in zip(nodes.tolist(), radii):
        far = np.sqrt(((own[low:high] - own[centre]) ** 2).sum(1))
        assert (far <= radius).all()
        inner = nodes[child : child + children]
        if children:
            assert inner[0][1] == low and inner[-1][2] == high and (inner[1:, 1] == inner[:-1, 2]).all()
            for i, a in enumerate(inner):
                for b in inner[:i]:
                    assert np.sqrt(((own[a[0]] - own[b[0]]) ** 2).sum()) > radius / 2 - 0.01
        else:
            assert high - low <= vc.LEAF


def test_whole_subtrees_are_given_away():
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.integers(-20, 20, (500, 4)), rng.integers(5000, 5040, (500, 4))])
    tree = vc.Tree.of(points)
    entries = np.array([[0, 0, 0, 0], [5020, 5020, 5020, 5020], [0, 0, 0, 0]])
    given: list = []
    tree.owners(entries, given)
    whole = sum(int((high - low).sum()) for low, high, _ in given if len(low) and (high - low).max() > 1)
    assert whole == len(tree.points)
    sums = np.zeros((3, 5), np.int64)
    tree.add_sums(entries, sums)
    assert sums[0].tolist() == [500, *points[:500].sum(0)] and sums[1].tolist() == [500, *points[500:].sum(0)] and not sums[2].any()


def test_distances_are_exact_in_both_forms():
    rng = np.random.default_rng(6)
    for most in (1000, 1 << 27):
        a, b = rng.integers(-most, most, (40, 9)), rng.integers(-most, most, (11, 9))
        want = [[sum((int(x) - int(y)) ** 2 for x, y in zip(p, e)) for e in b] for p in a]
        assert vc.squared_distances(a, b).astype(np.int64).tolist() == want
