import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyledger.llm.common import mapped
from skyledger.llm.packing import WordIds, best_fit, complete_bins, fillings, lower_bound, packed_documents, pieces, solution_bins, tokenizer_path
from tests.llm.helpers import ODD_TEXTS, frame, words

ODD = [
    "",
    "Don't stop, it's 3.14!! we'll we've I'd",
    "ÀÉÎ straße İstanbul ŒUVRE ÿ×÷ ½ ²",
    "e\u0301 cafe\u0301 \u0301x",
    "日本語 テスト\u3000全角 \u00a0nbsp\x85nel",
    "a<|endoftext|>b <|startoftext|> <|endoftext|>x",
    "tab\tnew\nline\x0bvt\x0cff\rcr \x1c\x1f",
    "ΣΑΣ ς ὈΔΥΣΣΕΎΣ",
    "x" * 3000,
    "a'S 'RE 're's",
]


def _plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_ids_equal_the_tokenizer():
    rng = random.Random(1)
    alphabet = "abcXYZ 019'.,é ßİ\u0301日\n<|>\u00a0"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(60)) for _ in range(500)]
    tokenizer = _plain()
    for limit in (5, 100_000):
        encoder = WordIds(tokenizer_path(), limit)
        for at in range(0, len(texts), 37):
            own = texts[at : at + 37]
            for text, ids in zip(own, encoder.encode([t.encode() for t in own])):
                assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def optimum(lengths, size):
    """Fewest bins by trying all placements."""
    best = len(lengths)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= lengths[i]}.values():
            rooms[k] -= lengths[i]
            place(i + 1, rooms)
            rooms[k] += lengths[i]
        place(i + 1, rooms + [size - lengths[i]])

    place(0, [])
    return best


def check(solution, counts, size):
    bins = list(solution_bins(solution))
    assert all(0 < sum(b) <= size for b in bins)
    flat = sorted(itertools.chain.from_iterable(bins))
    assert flat == sorted(x for x, n in counts.items() for _ in range(n))
    return len(bins)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_search_finds_the_optimum(lengths):
    counts = {x: lengths.count(x) for x in lengths}
    fewest = optimum(sorted(lengths, reverse=True), 20)
    assert lower_bound(counts, 20) <= fewest
    assert check(best_fit(counts, 20), counts, 20) >= fewest
    assert check(complete_bins(counts, 20), counts, 20) == fewest


def test_search_beats_best_fit_where_it_can():
    counts = {6: 2, 5: 2, 4: 2, 3: 2, 2: 2}
    assert check(complete_bins(counts, 10), counts, 10) == 4


def test_undominated_fillings():
    assert fillings({4: 1, 2: 3}, 4, 4) == [(4,)]
    got = fillings({3: 2, 2: 3}, 5, 5)
    assert got[0] == (3, 2)
    assert all(sum(x) <= 5 for x in got)


def test_large_histogram_is_near_the_bound():
    rng = np.random.default_rng(3)
    lengths, n = np.unique(np.minimum(2048, rng.lognormal(5.5, 1.2, 200_000).astype(int) + 1), return_counts=True)
    counts = dict(zip(lengths.tolist(), n.tolist()))
    bins = sum(k for _, k in complete_bins(counts))
    assert bins <= lower_bound(counts, 2048) + 2


def test_pieces_and_places(spark):
    rng = random.Random(2)
    texts = ODD_TEXTS + ODD + [words(rng, n) for n in (2047, 2048, 700, 5000)] + [words(rng, rng.randrange(300)) for _ in range(60)]
    ids = list(range(len(texts)))
    ids[-1] = None
    tokenizer = _plain()
    rows = packed_documents(frame(spark, texts, ids)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == set(ids)
    for doc_id, text in zip(ids, texts):
        want = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(by[doc_id], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(want) // 2048)))
        for r in own:
            assert r.start == 2048 * r.piece
            part = want[r.start : r.start + 2048]
            assert (r.length, r.ids_crc32) == (len(part), zlib.crc32(part.tobytes()))
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        places.sort()
        at = 0
        for offset, length in places:
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in rows)
    assert -(-total // 2048) <= len(sequences) <= -(-total // 2048) + 2


def test_ids_column_and_empty_table(spark):
    got = pieces(frame(spark, ["one two"]), tokenizer_path(), with_ids=True).first()
    assert list(got.ids) == [*_plain().encode("one two", add_special_tokens=False).ids, 0]
    assert packed_documents(frame(spark, ["a"]).where(F.lit(False))).count() == 0


def test_repeated_rows_are_packed_each(spark):
    rows = packed_documents(frame(spark, ["one two three"] * 9, [1] * 9)).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 9


@pytest.mark.parametrize("counts", [{}, {2048: 3}, {1: 5000}])
def test_plain_histograms(counts):
    check(complete_bins(counts), counts, 2048)


def test_the_search_holds_the_remaining_lengths_once():
    """Open siblings must not each hold a histogram: the search runs in the driver."""
    import tracemalloc

    counts = {x: 3 for x in range(300, 900, 3)}
    tracemalloc.start()
    found = complete_bins(counts, 2048, nodes=60)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    used = {}
    for pattern, bins in found:
        assert sum(x * k for x, k in pattern) <= 2048
        for x, k in pattern:
            used[x] = used.get(x, 0) + k * bins
    assert used == counts
    # 1.2 MB when every sibling had its own.
    assert peak < 0.8e6


def test_workers_are_left_as_they_were(spark):
    """A task that holds the cycle collector off hands its worker on with it on."""
    docs = spark.range(64, numPartitions=8).selectExpr("id AS doc_id", "'some words' AS text")
    assert pieces(docs, tokenizer_path()).count() == 64

    def told(batches):
        import gc

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([gc.isenabled()] * batch.num_rows)], ["on"])

    assert {r.on for r in mapped(spark.range(64, numPartitions=8), told, "on boolean").collect()} == {True}
