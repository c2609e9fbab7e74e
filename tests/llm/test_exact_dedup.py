import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from skyledger.llm.exact_dedup import exact_groups
from tests.llm.helpers import ODD_TEXTS, frame


def brute(rows):
    def norm(t):
        return re.sub(r"[\x20\x09-\x0D]", "", t or "")

    groups = {}
    for doc_id, t in rows:
        groups.setdefault(norm(t), []).append((doc_id, t or ""))
    out = []
    for body, own in groups.items():
        keep = min(own, key=lambda r: (-len(r[1]), r[0] is None, r[0]))[0]
        for doc_id, _ in own:
            out.append((doc_id, keep, len(own), hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("first,factor", [(1, 2), (32, 4)])
def test_groups_match_brute_force(spark, first, factor):
    rng = random.Random(5)
    texts = ODD_TEXTS + ["".join(rng.choice("ab \n") for _ in range(rng.randrange(12))) for _ in range(300)]
    texts += ["p" * n + tail for n in (31, 32, 33, 160, 161) for tail in ("", "x", "x", " x")]
    ids = list(range(len(texts)))
    ids[3] = None
    got = exact_groups(frame(spark, texts, ids), first=first, factor=factor).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == brute(list(zip(ids, texts)))
    for r in got:
        assert r.kept == (r.doc_id == r.keep_id)


def test_one_of_repeated_rows_stays(spark):
    got = exact_groups(frame(spark, ["same"] * 5, [1] * 5)).collect()
    assert [r.group_size for r in got] == [5] * 5
    assert sum(r.kept for r in got) == 1


def test_null_id_stays_only_without_another(spark):
    got = exact_groups(frame(spark, ["a", "a", "b"], [None, 4, None])).collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in got} == {(None, 4, False), (4, 4, True), (None, None, True)}


def test_empty_table(spark):
    assert exact_groups(frame(spark, ["a"]).where(F.lit(False))).count() == 0
