import random

from pyspark.sql import functions as F

from skyledger.llm.quality import judge, kept_documents, repeat_words, text_counts
from tests.llm.helpers import ODD_TEXTS, frame, words

SPACE = " \t\n\x0b\x0c\r"


def brute(text):
    own = (text or "").encode().split()
    own = [w.decode() for w in own]
    windows = [tuple(own[i : i + 3]) for i in range(len(own) - 2)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(SPACE):
            again += line in seen
            seen.add(line)
    return len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text or ""), again, len(hit)


def _texts():
    rng = random.Random(7)
    out = list(ODD_TEXTS) + ["a a a a", "a b c a b c", "#*$ |<>%&", "x y\nx y\nx y \n\n", "é é é é é"]
    out += [words(rng, rng.randrange(80), 4) for _ in range(60)]
    out += ["\n".join(words(rng, rng.randrange(4), 2) for _ in range(20)) for _ in range(20)]
    return out


def test_counts_match_brute_force():
    texts = _texts()
    got = list(zip(*[c.tolist() for c in text_counts([(t or "").encode() for t in texts])]))
    assert got == [brute(t) for t in texts]


def test_many_distinct_words_take_the_exact_path():
    import numpy as np

    ids = np.array([0, 1, 2, 9, 0, 1, 2])
    for distinct in (10, 1 << 22):
        assert repeat_words(ids, np.zeros(7, int), distinct, 1).tolist() == [6]


def test_judge_rows(spark):
    texts = _texts()
    got = {r.doc_id: r for r in judge(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        n, *rest = brute(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *rest)
        assert r.base_failed == (n < 50 or 100 * rest[-1] > 50 * n)
        assert not (r.kept and r.base_failed)


def test_bad_host_is_rejected_and_small_hosts_are_shrunk(spark):
    rng = random.Random(1)
    good = [words(rng, 80, 500) for _ in range(300)]
    bad = [" ".join(f"{w}#$%" for w in words(rng, 80, 500).split()) for _ in range(60)]
    texts = good + bad + [bad[0] + " x"]
    sources = [f"good{i % 10}" for i in range(300)] + ["bad"] * 60 + ["good0"]
    got = {r.doc_id: r.kept for r in judge(frame(spark, texts, sources=sources)).collect()}
    assert all(got[i] for i in range(300))
    assert not any(got[i] for i in range(300, 360))
    assert got[360]  # its host is fine
    kept = kept_documents(frame(spark, texts, sources=sources))
    assert {r.doc_id for r in kept.collect()} == {i for i, k in got.items() if k}
    assert kept.columns == frame(spark, ["a"]).columns


def test_null_host_and_empty_table(spark):
    text = words(random.Random(2), 60, 900)
    assert {r.doc_id: r.kept for r in judge(frame(spark, [text, None], sources=[None, None])).collect()} == {0: True, 1: False}
    empty = frame(spark, ["a"]).where(F.lit(False))
    assert judge(empty).count() == 0 and kept_documents(empty).count() == 0
