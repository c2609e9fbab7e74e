import random
import re

from pyspark.sql import functions as F

from skyledger.llm.licenses import NOTICES, PHRASES, Matcher, joined_words, notice_spans, scan, seeds
from tests.llm.helpers import ODD_TEXTS, frame


def brute(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places = []
    for phrase, label in PHRASES.items():
        want = phrase.split()
        places += [(i, label) for i in range(len(own)) if own[i : i + len(want)] == want]
    return own, places


TEXTS = ODD_TEXTS + [
    "Licensed under CC BY-NC 4.0.",
    "cc by cc by, CC--BY ccby cc\x00by",
    "ALL RIGHTS RESERVED. all rights reserved",
    "the GNU General  Public\nLicense, version 3.",
    "éall rights reserved x",
    "Licenced under the Apache Lisense, Version 2.0",
    "released undr the MIT licence",
    "nothing to see",
]


def test_rows_match_brute_force(spark):
    got = {r.doc_id: r for r in scan(frame(spark, TEXTS)).collect()}
    for i, text in enumerate(TEXTS):
        own, places = brute(text)
        r = got[i]
        at = [p for p, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(own), len(places), min(at, default=None), max(at, default=None)), text
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    assert got[len(TEXTS) - 3].labels == "apache" and 0.8 < got[len(TEXTS) - 3].score < 1
    assert got[len(TEXTS) - 2].labels == "mit"
    assert got[len(TEXTS) - 1].labels == "" and got[len(TEXTS) - 1].score == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_every_edited_notice_is_found():
    rng = random.Random(2)
    matcher = Matcher()
    for notice, label in NOTICES.items():
        edits = len(notice) // 9
        for _ in range(40):
            own = list(notice)
            for _ in range(rng.randrange(edits + 1)):
                at = rng.randrange(len(own))
                rng.choice([lambda: own.pop(at), lambda: own.insert(at, "q"), lambda: own.__setitem__(at, "z")])()
            text = "".join(own)
            if distance(text, notice) <= edits and "  " not in text:
                found = matcher.find(f"some words {text} and more".encode())
                assert label in {f[0] for f in found}, text


def test_an_earlier_notice_with_more_edits_is_found():
    found = Matcher().find(b"all rights reservd all rights reserved")
    assert sorted((a, b, e) for label, a, b, e, _ in found if label == "reserved") == [(0, 18, 1), (19, 38, 0)]


def test_seeds_tile_the_notice():
    for notice in NOTICES:
        for k in range(6):
            assert "".join(s for _, s in seeds(notice, k)) == notice


def test_spans(spark):
    docs = frame(spark, ["Foo bar. All rights reservd!", "é é Released under the MIT License x"])
    got = {r.doc_id: r for r in notice_spans(docs).collect()}
    assert (got[0].label, got[0].first_word, got[0].last_word, got[0].edits) == ("reserved", 2, 4, 1)
    assert (got[1].label, got[1].first_word, got[1].edits) == ("mit", 2, 0)


def test_words_and_empty_table(spark):
    assert joined_words("A-b\x7fÉ1".encode()) == (3, "a b É1".encode())
    assert scan(frame(spark, ["a"]).where(F.lit(False))).count() == 0
