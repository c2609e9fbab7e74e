import random

import numpy as np
from pyspark.sql import functions as F

from skyledger.llm.mixing import MOST_TIMES, Mix, mix_report, mixed_documents, permuted, shard_counts, slot_totals, targets
from tests.llm.helpers import ODD_TEXTS, frame, words


def test_targets():
    assert targets([100, 100, 100]) == [187.5, 75.0, 37.5]
    # The first stops at three times its size, the rest goes 2 : 1.
    got = targets([10, 100, 100])
    assert got[0] == 30.0 and abs(got[1] - 120) < 1e-9 and abs(got[2] - 60) < 1e-9
    assert targets([]) == [] and targets([0, 0]) == [0.0, 0.0]
    assert abs(sum(targets([5, 7, 900, 3, 1])) - 916) < 1e-6


def test_permutation_is_one():
    for n in (1, 2, 3, 17, 64, 1000):
        for key in (0, 5):
            assert sorted(permuted(np.arange(n), n, key).tolist()) == list(range(n))
    assert permuted(np.arange(1000), 1000, 1).tolist() != permuted(np.arange(1000), 1000, 2).tolist()


def test_shards_sum_to_the_totals():
    slots = [1000, 37, 0, 512]
    shards = [shard_counts(i, slots, 100, 7) for i in range(-(-sum(slots) // 100))]
    assert [sum(s[0][k] for s in shards) for k in range(4)] == slots
    assert [sum(s[0]) for s in shards] == [100] * 15 + [49]
    at = [0] * 4
    for counts, first in shards:
        assert first == at
        at = [a + c for a, c in zip(at, counts)]
    # Draws vary from shard to shard.
    assert len({s[0][0] for s in shards[:-1]}) > 3


def _docs(spark, n=300):
    rng = random.Random(8)
    texts = ODD_TEXTS + [words(rng, rng.randrange(1, 400)) for _ in range(n)]
    sources = [rng.choice(["b", "b", "b", "a", "c", None, "é"]) for _ in texts]
    return frame(spark, texts, sources=sources), texts, sources


def test_report_against_brute_force(spark):
    docs, texts, sources = _docs(spark)
    size = [len((t or "").encode().split()) for t in texts]
    names = sorted({s for s in sources if s is not None}, key=lambda s: [ord(c) for c in s]) + [None]
    sizes = [sum(n for n, s in zip(size, sources) if s == x) for x in names]
    wanted = dict(zip(names, targets(sizes)))
    got = {r.doc_id: r for r in mix_report(docs).collect()}
    assert len(got) == len(texts)
    for i, r in got.items():
        assert (r.size, r.source_size) == (size[i], sizes[names.index(sources[i])])
        assert abs(r.target - wanted[sources[i]]) < 1e-6
        assert 0 <= r.taken <= MOST_TIMES * r.size
    for s in names:
        taken = sum(r.taken for i, r in got.items() if sources[i] == s)
        assert abs(taken - wanted[s]) <= 0.02 * wanted[s] + 128
    again = {r.doc_id: r.taken for r in mix_report(docs.repartition(7)).collect()}
    assert again == {i: r.taken for i, r in got.items()}


def test_spans_tile_and_slots_cover(spark):
    docs, texts, _ = _docs(spark, 60)
    sized = docs.select(F.col("doc_id").alias("rid"), "doc_id", "source", F.lit(0).alias("x"), "text")
    from skyledger.llm.mixing import word_count

    mix = Mix(sized.select("rid", "doc_id", "source", word_count(F.col("text")).alias("size")), block=16, shard_slots=32)
    blocks = {}
    by_doc = {}
    for r in mix.spans().collect():
        by_doc.setdefault(r.rid, []).append((r.first, r.last))
        blocks[(r.source_no, r.block)] = blocks.get((r.source_no, r.block), 0) + r.last - r.first
    for i, spans in by_doc.items():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] == len((texts[i] or "").encode().split())
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert all(n == 16 or b == mix.blocks[s] - 1 for (s, b), n in blocks.items())
    times = {}
    for r in mix.shards().collect():
        times[(r.source_no, r.epoch, r.block)] = times.get((r.source_no, r.epoch, r.block), 0) + 1
    assert set(times.values()) <= {1} and max(e for _, e, _ in times) < MOST_TIMES
    assert {(s, b) for s, _, b in times} <= set(blocks)


def test_documents_hold_the_taken_words(spark):
    docs, texts, sources = _docs(spark, 80)
    taken = {r.doc_id: r.taken for r in mix_report(docs).collect()}
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    got = {}
    for r in out.collect():
        assert r.n_chars == len(r.text)
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.encode().split())
        own = (texts[r.doc_id] or "").encode().split()
        assert r.text == texts[r.doc_id] or len(r.text.encode().split()) <= len(own)
    # Streams are ordered by id, so both runs take the same words.
    assert got == {i: n for i, n in taken.items() if n}


def test_slot_totals():
    assert slot_totals([100, 0, 64], [300.0, 0.0, 64.0], 64) == ([2, 0, 1], [6, 0, 1])


def test_empty_table(spark):
    empty = frame(spark, ["a"]).where(F.lit(False))
    assert mix_report(empty).count() == 0
    assert mixed_documents(empty).count() == 0
    assert mix_report(frame(spark, [None, ""])).count() == 2
