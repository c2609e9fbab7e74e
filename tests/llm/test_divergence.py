"""The audit against plain counting, and the packed buckets against a dictionary."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from skyledger.llm import divergence as dv

SCHEMA = "doc_id long, text string, lang string, source string, term string, n int, task string"
TERMS = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def docs(spark, rows):
    return spark.createDataFrame([(i, *r, "x", 3, None) for i, r in enumerate(rows)], SCHEMA)


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, least, top):
    """The contract in plain Python over (text, lang, source)."""
    n, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        own = TERMS.findall(lowered(text))
        groups.add((lang or "", source or ""))
        n[lang or "", source or ""].update(own)
        df[lang or ""].update(set(own))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, c in df[lang].items() if c >= least)
        sources = sorted(s for g, s in groups if g == lang)
        count = {s: {t: n[lang, s][t] for t in kept} for s in sources}
        whole = {t: sum(count[s][t] for s in sources) for t in kept}

        def p(c, t):
            return 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))

        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(o, sum(f(p(count[s], t), p(count[o], t)) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p(count[s], t), p(whole, t))) for t in kept if count[s][t] and p(count[s], t) > p(whole, t)]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, rank) for rank, (item, value) in enumerate(items[:most], 1)]
    return sorted(out)


def random_docs(seed, n):
    rng = random.Random(seed)
    pool = ["a", "Bb", "ccc", "Straße", "naïve", "über", "日本語", "sixteenbyteslong", "exactly8", "seventeenbyteslng", "Ünïcödé" * 4, "z" * 130, "Q" * 300, "q" * 300]
    pool += ["".join(rng.choice("abcdeéß") for _ in range(rng.randrange(1, 30))) for _ in range(40)]
    rows = []
    for _ in range(n):
        lang, source = rng.choice(["en", "en", "de", None, "xx"]), rng.choice(["s1", "s1", "s2", "s3", None, "é"])
        own = pool[:20] if source == "s1" else pool
        text = rng.choice([" ", "1", "-", "\n", "\x00"]).join(rng.choice(own) for _ in range(rng.randrange(0, 30)))
        rows.append((text if rng.random() > 0.05 else None, lang, source))
    return rows + [("only here", "qq", "s1"), (None, "qq", "s2"), ("", "ww", "alone")] + rows[:5]


@pytest.mark.parametrize("square, square_rows, buffer_terms", [(128, 200_000, 2_000_000), (2, 7, 50)])
def test_audit_matches_plain_counting(spark, square, square_rows, buffer_terms):
    rows = random_docs(square, 300)
    got = dv.divergence(docs(spark, rows).repartition(3), least_documents=4, top=5, square=square, square_rows=square_rows, buffer_terms=buffer_terms)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 4, 5)


def test_no_kept_terms_and_empty_tables(spark):
    rows = [("a b", "en", "x"), ("c", "en", "y"), (None, None, None)]
    got = sorted(tuple(r) for r in dv.divergence(docs(spark, rows)).collect())
    assert got == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]
    empty = dv.divergence(docs(spark, []))
    assert empty.count() == 0 and empty.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_counts_of_whole_long_texts(spark):
    long = "Wort " * 400_000 + "x" * 1_000_000
    rows = [(long, "de", "a"), ("wort", "de", "b")]
    got = {(r.source, r.term): (r.n, r.docs) for r in dv.term_counts(docs(spark, rows)).collect()}
    assert got == {("a", "wort"): (400_000, 1), ("b", "wort"): (1, 1), ("a", "x" * 1_000_000): (1, 1)}


def test_buckets_match_a_dictionary():
    rng = random.Random(7)
    alphabet = "abAB é日1 "
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 200))) for _ in range(60)] + ["y" * 8, "y" * 9, "y" * 16, "y" * 17, "y" * 129, "y" * 500]
    groups = [rng.randrange(3) for _ in texts]
    raws = [t.encode() for t in texts]
    buckets = dv.Buckets()
    for low in range(0, len(raws), 10):
        part = raws[low : low + 10]
        raw = dv._LOWER[np.frombuffer(b"".join(part) + bytes(8), np.uint8)]
        buckets.add(raw, np.cumsum([len(x) for x in part]), np.array(groups[low : low + 10]), low)
    got = {}
    for group, terms, n, held in buckets.counted():
        for g, t, c, d in zip(group.tolist(), terms, n.tolist(), held.tolist()):
            assert (g, t) not in got
            got[g, t] = (c, d)
    want = defaultdict(lambda: [0, 0])
    for g, t in zip(groups, texts):
        own = Counter(x.encode() for x in TERMS.findall(lowered(t)))
        for term, c in own.items():
            want[g, term][0] += c
            want[g, term][1] += 1
    assert got == {k: tuple(v) for k, v in want.items()}


def test_radix_order_is_stable():
    rng = np.random.default_rng(2)
    keys = [rng.integers(0, 3, 5000).astype(np.uint64), rng.integers(0, 2**63, 5000).astype(np.uint64) >> np.uint64(40)]
    order = dv.radix_order(keys)
    assert np.array_equal(order, np.lexsort((np.arange(5000), keys[1], keys[0])))


def test_shares_of_large_counts(spark):
    """Counts whose product with a billion passes a long."""
    df = spark.createDataFrame([(10**13, 3 * 10**13, 1000)], "n long, total long, v long")
    from pyspark.sql import functions as F

    got = df.select(dv.share(F.col("n"), F.col("total"), F.col("v")).alias("p")).first().p
    assert got == 1 + 10**9 * (10**13 + 2) // (3 * 10**13 + 2000)
