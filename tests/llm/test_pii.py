import hashlib
import itertools
import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from skyledger.llm.pii import KINDS, SemiCrf, base_spans, candidates, find_personal_data, joined, luhn, zones
from tests.llm.helpers import ODD_TEXTS, frame

# The contract's expressions as they stand.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for k, kind in enumerate(KINDS):
        for m in re.finditer(PLAIN[kind], text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_matches_plain_expressions():
    rng = random.Random(1)
    alphabet = "a1.@-+ ()_é9 0@.\n5"
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))
        assert base_spans(text) == brute(text), repr(text)
    for text in ("4111 1111 1111 1111 x 4111-1111-1111-1112", "a@b.c@d.e x@y.z", "1.2.3.4.5.6.7.8 256.1.1.1", "+1 (017) 555-7713 +49 30 1234567", "a@b a@b.c", "٣.1.1.1.1"):
        assert base_spans(text) == brute(text)


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "1." * 200_000, "+1" * 200_000, "a" * 300_000 + "@", "@" * 200_000, "a.b@" * 100_000):
        start = time.time()
        base_spans(text)
        assert time.time() - start < 5


def test_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    n, pairs = 4, [(0, 0), (0, 1), (1, 2), (2, 3), (3, 3), (0, 3)]
    scores = rng.normal(size=(len(pairs), len(KINDS)))
    total, mass = 0.0, np.zeros_like(scores)
    for size in range(n + 1):
        for chosen in itertools.combinations(range(len(pairs)), size):
            own = sorted(pairs[x] for x in chosen)
            if any(a[1] >= b[0] for a, b in zip(own, own[1:])):
                continue
            for kinds in itertools.product(range(len(KINDS)), repeat=size):
                weight = np.exp(sum(scores[x, k] for x, k in zip(chosen, kinds)))
                total += weight
                for x, k in zip(chosen, kinds):
                    mass[x, k] += weight
    assert np.allclose(SemiCrf.marginals(n, pairs, scores), mass / total)


def _sentences(rng, n):
    out = []
    for _ in range(n):
        phone = f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}"
        mail = f"ab.{rng.randrange(99)}@mail{rng.randrange(9)}.example.com"
        ip = ".".join(str(rng.randrange(256)) for _ in range(4))
        out.append(rng.choice([f"call {phone} now", f"write {mail} or", f"host {ip} is", f"version {rng.randrange(9)}.{rng.randrange(9)} of {rng.randrange(2000)}"]))
    return out


def _examples(texts):
    out = []
    for t in texts:
        spans = base_spans(t)
        for start, zone in zones(t):
            out.append((zone, [(a - start, k, b - start) for a, k, b in spans if a >= start and b <= start + len(zone)]))
    return out


def test_held_out_accuracy():
    rng = random.Random(4)
    model = SemiCrf().fit(_examples(_sentences(rng, 200)))
    right = total = 0
    for zone, gold in _examples(_sentences(rng, 200)):
        got = model.best(zone)
        total += len(gold)
        right += len(set(got) & set(gold))
        assert not (not gold and got), zone
    assert right >= 0.95 * total


def test_candidates_hold_the_base_spans():
    for text in _sentences(random.Random(9), 100):
        for start, zone in zones(text):
            tokens, pairs = candidates(zone)
            bounds = {(tokens[i][0], tokens[j][1]) for i, j in pairs}
            for a, _, b in base_spans(text):
                assert (a - start, b - start) in bounds


def test_query_rows(spark):
    texts = ODD_TEXTS + _sentences(random.Random(6), 60)
    got = find_personal_data(frame(spark, texts)).collect()
    assert len(got) == len(texts)
    for r in got:
        base = brute(texts[r.doc_id] or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in base) for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        assert set(filter(None, joined(base).split(","))) <= set(r.spans.split(","))


def test_empty_table(spark):
    assert find_personal_data(frame(spark, ["a"]).where(F.lit(False))).count() == 0
