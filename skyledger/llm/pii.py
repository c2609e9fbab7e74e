"""Personal data: fixed patterns, and a semi-Markov conditional random field.

The patterns give the base spans of each text.  Around digits and at signs a text is cut
into zones of tokens; a semi-Markov CRF scores whole candidate segments of a zone
(digits, signs, shape, checksum, neighbours), and dynamic programming over segments of
at most `MOST_TOKENS` tokens and `MOST_CHARS` characters between word bounds jointly picks
boundaries and kinds.  Segments that it is sure of and that touch no base span are added
to the base spans.  Zones of more than `ZONE_CHARS` characters are cut into pieces that
overlap by the longest segment, so that no segment is lost at a cut.

The CRF is trained here, by gradient steps on the exact likelihood (forward and backward
over segments), on at most `ZONES_EACH` zones, taken by hash, of each of at most
`SAMPLE_ZONES` documents in hash order.  Its labels are the base spans and variants of them
that the patterns miss (`VARIANTS`): phone numbers without plus or country code, cards with
other separators, addresses broken up to be unreadable for machines.  Texts are read once:
the first pass keeps base spans and zones, the second reads the zones alone.

Patterns and zones take time linear in the text, also on long runs of digits or of digits
and letters.

Defined cases: null and empty texts have no spans; very long texts are searched whole;
repeated rows are judged each; with no zone to learn from the model adds nothing; an empty
table gives an empty result; columns of other names are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm.common import mapped, settle, table

KINDS = ("email", "ip", "card", "phone")
MOST_TOKENS, MOST_CHARS, ZONE_CHARS = 14, 64, 400
SAMPLE_ZONES, ZONES_EACH = 1000, 4
ROUNDS = 6
STEP = 0.5
# Log odds of a segment against the same tokens read as plain text.
MARGIN = 4.0

Span = tuple[int, int, int]  # start, kind number, end

# The kinds' patterns, in forms that run in linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    free, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > free and (c := text[start - 1]) < "\x7f" and (c.isalnum() or c in "._%+-"):
                start -= 1
            if start < at:
                yield start, 0, domain.end()
                free = domain.end()
        else:
            # No match can hold this sign, and none can reach over it.
            free = max(free, at + 1)
        at = text.find("@", at + 1)


def _ips(text: str) -> Iterator[Span]:
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m[0].split(".")):
            yield m.start(), 1, m.end()


def _cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield m.start(), 2, m.end()


def _phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            yield m.start(), 3, m.end()


def base_spans(text: str) -> list[Span]:
    """All base spans by start, then kind as listed."""
    out: list[Span] = []
    if "@" in text:
        out.extend(_emails(text))
    if _DIGIT.search(text):
        out.extend(_ips(text))
        out.extend(_cards(text))
        if "+" in text:
            out.extend(_phones(text))
    return sorted(out)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


# -- zones and features ---------------------------------------------------------------

_DIGIT = re.compile(r"[0-9]")
# Chunks without white space that hold a digit or an at sign, and such neighbours one blank apart.
_CHUNK = re.compile(r"[^\s]+")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]|\s")
_LEFT_OPEN, _RIGHT_CLOSE = "+(", ")"


def zones(text: str) -> Iterator[tuple[int, str]]:
    """(start, text) of the runs of chunks with digits or at signs, in pieces of bounded length."""
    if not ("@" in text or _DIGIT.search(text)):
        return
    start = end = -1
    for m in _CHUNK.finditer(text):
        chunk = m[0]
        if "@" in chunk or _DIGIT.search(chunk):
            if start >= 0 and m.start() == end + 1:
                end = m.end()
                continue
            if start >= 0:
                yield from _cut(text, start, end)
            start, end = m.span()
    if start >= 0:
        yield from _cut(text, start, end)


def _cut(text: str, start: int, end: int) -> Iterator[tuple[int, str]]:
    while end - start > ZONE_CHARS:
        yield start, text[start : start + ZONE_CHARS]
        # One character more on both sides shows whether a segment ends at a word's bound.
        start += ZONE_CHARS - MOST_CHARS - 2
    yield start, text[start:end]


def _bucket(n: int, bounds: tuple) -> int:
    return next((i for i, b in enumerate(bounds) if n <= b), len(bounds))


def span_features(zone: str, a: int, b: int) -> list[str]:
    """Features of the whole segment zone[a:b]."""
    body = zone[a:b]
    digits = _NOT_DIGIT.sub("", body)
    letters = sum(c.isalpha() for c in body)
    before = zone[a - 1] if a else " "
    after = zone[b] if b < len(zone) else " "
    dots, signs = body.count("."), body.count("@")
    groups = [g for g in re.split(r"[^0-9]+", body) if g]
    shape = re.sub(r"[0-9]+", "9", re.sub(r"[A-Za-z]+", "a", body))
    out = [
        "bias",
        f"digits{_bucket(len(digits), (0, 3, 6, 9, 10, 13, 15, 16, 19))}",
        f"letters{_bucket(letters, (0, 2, 8))}",
        f"dots{min(dots, 4)}",
        f"at{min(signs, 2)}",
        f"groups{min(len(groups), 6)}",
        f"shape{shape[:12]}",
        f"first{'9' if body[0].isdigit() else 'a' if body[0].isalpha() else body[0]}",
        f"last{'9' if body[-1].isdigit() else 'a' if body[-1].isalpha() else body[-1]}",
        f"before{'9' if before.isdigit() else 'a' if before.isalpha() else before}",
        f"after{'9' if after.isdigit() else 'a' if after.isalpha() else after}",
    ]
    if len(digits) >= 12:
        out.append(f"luhn{luhn(digits[:32])}")
    if dots == 3 and len(groups) == 4 and not letters:
        out.append(f"octets{all(len(g) <= 3 and int(g) <= 255 for g in groups)}")
    if body[0] == "+":
        out.append(f"plus{_bucket(len(digits), (9, 15))}")
    if signs == 1:
        local, _, domain = body.partition("@")
        out.append(f"mail{bool(local)}{'.' in domain.strip('.')}{' ' in body}")
    return out


def candidates(zone: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Token bounds of a zone, and the (first, last) token pairs that may be a segment."""
    tokens = [m.span() for m in _TOKEN.finditer(zone)]
    kinds = [zone[a] for a, _ in tokens]
    word = [c.isalnum() for c in kinds]
    heavy = list(accumulate((c in "0123456789@" for c in kinds), initial=0))
    pairs = []
    for i, (a, _) in enumerate(tokens):
        # A segment begins and ends with a word's bound, so a long run of letters and digits has few.
        if not (word[i] and not (i and word[i - 1]) or kinds[i] in _LEFT_OPEN):
            continue
        for j in range(i, min(len(tokens), i + MOST_TOKENS)):
            if tokens[j][1] - a > MOST_CHARS:
                break
            if (word[j] or kinds[j] in _RIGHT_CLOSE) and not (j + 1 < len(tokens) and word[j] and word[j + 1]) and heavy[j + 1] > heavy[i]:
                pairs.append((i, j))
    return tokens, pairs


# The forms of a base span that the patterns miss and the model learns.
def _grouped(digits: str, sizes: tuple, sign: str) -> str:
    out, at = [], 0
    for n in sizes:
        out.append(digits[at : at + n])
        at += n
    return sign.join([x for x in (*out, digits[at:]) if x])


def _phone_forms(body: str) -> list[str]:
    digits = _NOT_DIGIT.sub("", body)
    own = digits[-10:]
    return [body[1:], _grouped(own, (3, 3), "-"), _grouped(own, (3, 3), "."), f"({own[:3]}) {own[3:6]}-{own[6:]}", _grouped(own, (3, 3), " ")]


def _card_forms(body: str) -> list[str]:
    digits = _NOT_DIGIT.sub("", body)
    return [_grouped(digits, (4, 4, 4), sign) for sign in (".", "/", "_")]


VARIANTS = {
    0: lambda body: [body.replace("@", " @ "), body.replace("@", "[@]")],
    1: lambda body: [body.replace(".", "[.]"), body.replace(".", " . ")],
    2: _card_forms,
    3: _phone_forms,
}


def variants(zone: str, spans: list[Span]) -> Iterator[tuple[str, list[Span]]]:
    """The zone with one base span in another form, for each span and one of its forms, taken by hash."""
    for n, (a, k, b) in enumerate(spans):
        forms = VARIANTS[k](zone[a:b])
        body = forms[int(hashlib.sha256(zone[a:b].encode()).hexdigest()[:8], 16) % len(forms)]
        by = len(body) - (b - a)
        rest = [(x + by, kind, y + by) for x, kind, y in spans[n + 1 :]]
        yield zone[:a] + body + zone[b:], [*spans[:n], (a, k, a + len(body)), *rest]


class SemiCrf:
    """Segments of at most MOST_TOKENS tokens with a kind, other tokens plain; weights per (feature, kind)."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.weights = np.zeros((0, len(KINDS)))

    def _rows(self, zone: str, pairs: list, tokens: list, grow: bool) -> list[np.ndarray]:
        rows = []
        for i, j in pairs:
            names = span_features(zone, tokens[i][0], tokens[j][1])
            if grow:
                rows.append(np.array([self.index.setdefault(n, len(self.index)) for n in names]))
            else:
                rows.append(np.array([self.index[n] for n in names if n in self.index], dtype=np.int64))
        return rows

    def fit(self, examples: list[tuple[str, list[Span]]], rounds: int = ROUNDS, step: float = STEP) -> SemiCrf:
        """Gradient steps on the log likelihood of the given segmentations."""
        ready = []
        for zone, spans in examples:
            tokens, pairs = candidates(zone)
            rows = self._rows(zone, pairs, tokens, True)
            gold = {(a, b): k for a, k, b in spans}
            truth = [gold.get((tokens[i][0], tokens[j][1])) for i, j in pairs]
            if pairs:
                ready.append((len(tokens), pairs, rows, truth))
        self.weights = np.zeros((len(self.index), len(KINDS)))
        seen = np.full(self.weights.shape, 1e-3)
        for _ in range(rounds):
            for n, pairs, rows, truth in ready:
                scores = np.array([self.weights[r].sum(0) for r in rows])
                chance = self.marginals(n, pairs, scores)
                change = np.zeros_like(self.weights)
                for r, p, k in zip(rows, chance, truth):
                    p = -p
                    if k is not None:
                        p[k] += 1
                    np.add.at(change, r, p)
                seen += change**2
                self.weights += step * change / np.sqrt(seen)
        return self

    @staticmethod
    def marginals(n: int, pairs: list, scores: np.ndarray) -> np.ndarray:
        """Probability of each (segment, kind), by forward and backward sums."""
        total = np.logaddexp.reduce(scores, axis=1)
        ends: list[list[int]] = [[] for _ in range(n)]
        begins: list[list[int]] = [[] for _ in range(n)]
        for x, (i, j) in enumerate(pairs):
            ends[j].append(x)
            begins[i].append(x)
        ahead, behind = np.zeros(n + 1), np.zeros(n + 1)
        for t in range(n):
            value = ahead[t]
            for x in ends[t]:
                value = np.logaddexp(value, ahead[pairs[x][0]] + total[x])
            ahead[t + 1] = value
        for t in range(n - 1, -1, -1):
            value = behind[t + 1]
            for x in begins[t]:
                value = np.logaddexp(value, behind[pairs[x][1] + 1] + total[x])
            behind[t] = value
        base = np.array([ahead[i] + behind[j + 1] for i, j in pairs]) - ahead[n]
        return np.exp(scores + base[:, None])

    def best(self, zone: str, margin: float = MARGIN) -> list[Span]:
        """The best segmentation's segments that beat plain text by `margin`."""
        if not len(self.weights):
            return []
        tokens, pairs = candidates(zone)
        if not pairs:
            return []
        scores = np.array([self.weights[r].sum(0) for r in self._rows(zone, pairs, tokens, False)])
        kind, value = scores.argmax(1), scores.max(1)
        ends: list[list[int]] = [[] for _ in tokens]
        for x, (_, j) in enumerate(pairs):
            ends[j].append(x)
        top, back = [0.0], [-1]
        for t in range(len(tokens)):
            score, choice = top[t], -1
            for x in ends[t]:
                if top[pairs[x][0]] + value[x] > score:
                    score, choice = top[pairs[x][0]] + value[x], x
            top.append(score)
            back.append(choice)
        out, t = [], len(tokens)
        while t:
            x = back[t]
            if x < 0:
                t -= 1
                continue
            i, j = pairs[x]
            if value[x] >= margin:
                out.append((tokens[i][0], int(kind[x]), tokens[j][1]))
            t = i
        return out[::-1]


# -- jobs -----------------------------------------------------------------------------

FOUND = "doc_id long, base array<int>, starts array<int>, zones array<string>"


def _finder(batches):
    names = [x.split()[0] for x in FOUND.split(", ")]
    kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()))
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            spans = base_spans(text or "")
            own = list(zones(text or ""))
            rows.append((doc_id, [x for s in spans for x in s], [z[0] for z in own], [z[1] for z in own]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _triples(flat: list[int]) -> list[Span]:
    return [tuple(flat[i : i + 3]) for i in range(0, len(flat), 3)]


def _examples(rows: list) -> list[tuple[str, list[Span]]]:
    """Zones with the base spans that lie inside them and do not overlap, and their variants."""
    out = []
    for row in rows:
        spans = _triples(row["base"])
        for start, zone in row["drawn"]:
            inside, end = [], 0
            for a, k, b in spans:
                if a - start >= end and b <= start + len(zone):
                    inside.append((a - start, k, b - start))
                    end = b - start
            out.append((zone, inside))
            out.extend(variants(zone, inside))
    return out


def train(found: DataFrame, most: int = SAMPLE_ZONES, each: int = ZONES_EACH) -> SemiCrf:
    """A CRF fitted to at most `each` zones of each of at most `most` documents, half of them with base spans."""
    order = F.xxhash64("doc_id", "zones")
    own = F.transform(F.arrays_zip("starts", "zones"), lambda z: F.struct(F.xxhash64(z["zones"]).alias("h"), z["starts"].alias("at"), z["zones"].alias("zone")))
    drawn = F.transform(F.slice(F.array_sort(own), 1, each), lambda z: F.struct(z["at"], z["zone"]))
    rows = []
    for has in ("size(base) > 0", "size(base) = 0 and size(zones) > 0"):
        rows += found.where(has).orderBy(order).limit(most // 2).select("base", drawn.alias("drawn")).collect()
    return SemiCrf().fit(_examples([r.asDict() for r in rows]))


OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _adder(model: SemiCrf):
    names = [x.split()[0] for x in OUT.split(", ")]
    kinds = (pa.int64(),) * 5 + (pa.string(), pa.string())

    def add(batches):
        for batch in batches:
            rows = []
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for doc_id, flat, starts, own in zip(*columns):
                base = _triples(flat)
                spans = list(base)
                taken = sorted((a, b) for a, _, b in base)
                for start, zone in zip(starts, own):
                    for a, k, b in model.best(zone):
                        # Pieces of a zone overlap; the first of two segments that touch stays.
                        at = bisect_left(taken, (a + start, b + start))
                        clash = (at and taken[at - 1][1] > a + start) or (at < len(taken) and taken[at][0] < b + start)
                        if not clash:
                            taken.insert(at, (a + start, b + start))
                            spans.append((a + start, k, b + start))
                counts = [sum(s[1] == k for s in base) for k in range(len(KINDS))]
                rows.append((doc_id, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return add


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE_ZONES, each: int = ZONES_EACH) -> DataFrame:
    """Counts and digest of the base spans, and all spans, of every document."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = settle(mapped(own, _finder, FOUND), "pii-zones")
    return mapped(found, _adder(train(found, sample, each)), OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))
