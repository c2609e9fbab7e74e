import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.llm.line_dedup import line_report, merged, stretches, without_copied_runs
from tests.llm.helpers import ODD_TEXTS, frame


def brute(rows, least):
    """Every line of every run with `least` words that stands earlier, by trying all runs."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    docs = {i: [x for x in (rows[i][1] or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")] for i in order}
    seen, gone = set(), {i: set() for i in order}
    for i in order:
        lines = docs[i]
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                run = tuple(lines[a:b])
                if sum(len(x.split()) for x in run) >= least and run in seen:
                    gone[i] |= set(range(a, b))
                seen.add(run)
    # Runs that overlap their own earlier start count as well; positions only grow, so one pass over starts is enough.
    return {i: (len(docs[i]), gone[i]) for i in order}


@pytest.mark.parametrize("least", [1, 4, 9])
def test_runs_match_brute_force(spark, least):
    rng = random.Random(least)
    lines = ["a", "b b", "c c c", "d d d d d", "e e e e e e e e e e", "", " "]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randrange(12))) for _ in range(40)]
    texts += ["u1\nb b\nc c c\nu2", "b b\nc c c", *ODD_TEXTS]
    rows = list(zip(range(len(texts)), texts))
    want = brute(rows, least)
    got = {r.doc_id: r for r in line_report(frame(spark, texts), least_words=least).collect()}
    for i, (n, gone) in want.items():
        spans = [tuple(map(int, x.split("-"))) for x in got[i].deleted.split(",") if x]
        assert got[i].n_lines == n
        assert {k for a, b in spans for k in range(a, b + 1)} == gone, (i, texts[i])


def test_stretches_against_all_runs():
    rng = random.Random(3)
    pos = np.cumsum([rng.choice([1, 1, 1, 2]) for _ in range(60)])
    words = np.array([rng.randrange(1, 6) for _ in range(60)])
    first, lines = stretches(pos, words, 7)
    got = set(zip(first.tolist(), lines.tolist()))
    want = set()
    for a in range(60):
        for b in range(a + 1, 61):
            if pos[b - 1] - pos[a] != b - 1 - a:
                break
            total = words[a:b].sum()
            if total >= 7 and (words[a : b - 1].sum() < 7 or words[a + 1 : b].sum() < 7):
                want.add((a, b - a))
    assert got == want


def test_documents_keep_columns_and_only_copies_go(spark):
    passage = "one two three\nfour five six"
    texts = [passage, "own line\n" + passage, passage, None, "own line"]
    docs = frame(spark, texts)
    got = {r.doc_id: r.asDict() for r in without_copied_runs(docs, least_words=5).collect()}
    assert set(got) == {0, 1, 3, 4}
    assert got[1]["text"] == "own line" and got[1]["n_chars"] == 8
    assert got[0]["text"] == passage and got[3]["text"] is None
    assert without_copied_runs(docs).columns == docs.columns


def test_first_in_id_order_stays(spark):
    got = {r.doc_id: r.n_deleted for r in line_report(frame(spark, ["x y z"] * 3, [9, None, 4]), least_words=2).collect()}
    assert got == {4: 0, 9: 1, None: 1}


def test_merged():
    assert merged([(0, 2), (1, 3), (4, 1), (7, 2)]) == [(0, 5), (7, 9)]


def test_empty_table(spark):
    assert line_report(frame(spark, ["a"]).where(F.lit(False))).count() == 0
    assert without_copied_runs(frame(spark, ["a"]).where(F.lit(False))).count() == 0
