"""License notices: exact phrases, and short notices with a bounded number of edits.

A text is lower-cased (A-Z) and cut into words; words joined by single blanks are the
searched form.  A notice of n characters may differ in `n // EDIT_EVERY` = k edits; cut
into k + 1 seeds, at least one seed of any such occurrence is unchanged, so exact
search of the seeds finds every candidate place, and the `regex` library's
bounded-error matching verifies a window around each and reports span and edits.  Places
are taken from left to right and do not overlap.

Everything happens per row, so nothing is shuffled and no text is cut; the time is
linear in the text, also when it consists of near notices.

Defined cases: null and empty texts have no words, no labels and score 0; very long texts
are searched whole; repeated rows are judged each; an empty table gives an empty result;
columns of other names are ignored.
"""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm.common import as_bytes, mapped, table

# The phrases that count as base matches, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Short notices as their words stand, and their labels.
NOTICES = {
    "all rights reserved": "reserved",
    "creative commons attribution": "cc-by",
    "licensed under cc by": "cc-by",
    "licensed under the apache license version 2 0": "apache",
    "licensed under the gnu general public license": "gpl",
    "mozilla public license version 2 0": "mpl",
    "permission is hereby granted free of charge to any person": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "released under the mit license": "mit",
}
EDIT_EVERY = 9
# Windows whose match a task remembers.
KNOWN_WINDOWS = 50_000

# A-Z to a-z; 0-9, a-z and non-ASCII stay; every other byte is a blank.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
SPANS = "doc_id long, label string, first_char long, last_char long, first_word long, last_word long, edits int"


def seeds(notice: str, edits: int) -> list[tuple[int, str]]:
    """(offset, seed) of edits + 1 parts of nearly equal length."""
    n = len(notice)
    cuts = [n * i // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


class Matcher:
    """Fuzzy search of a fixed list of notices."""

    def __init__(self, notices: dict[str, str] = NOTICES, edit_every: int = EDIT_EVERY):
        self.notices, self.known = [], {}
        for text, label in notices.items():
            edits = len(text) // edit_every
            pattern = regex.compile(f"(?:{regex.escape(text)}){{e<={edits}}}", regex.BESTMATCH)
            self.notices.append((text, label, edits, pattern, [(o, s, s.encode()) for o, s in seeds(text, edits)]))

    def _match(self, pattern, window: str) -> tuple[int, int, int] | None:
        """Start, end and edits of the best match in a window; windows repeat, so a bounded number is remembered."""
        key = (pattern, window)
        if key not in self.known:
            if len(self.known) >= KNOWN_WINDOWS:
                self.known.clear()
            m = pattern.search(window)
            self.known[key] = (m.start(), m.end(), sum(m.fuzzy_counts)) if m else None
        return self.known[key]

    def find(self, joined: bytes) -> list[tuple[str, int, int, int, int]]:
        """(label, start, end, edits, notice length) of every verified place, in characters of the joined words."""
        out = []
        text = None
        for notice, label, edits, pattern, parts in self.notices:
            hit = [(o, s) for o, s, raw in parts if raw in joined]
            if not hit:
                continue
            text = joined.decode() if text is None else text
            places = set()
            for offset, seed in hit:
                at = text.find(seed)
                while at >= 0:
                    places.add(at - offset)
                    at = text.find(seed, at + 1)
            # Each seed has a window of its own, no longer than the notice and its edits on both sides.
            free = 0
            for place in sorted(places):
                low, high = max(free, place - edits, 0), min(place + len(notice) + edits, len(text))
                if high - low < len(notice) - edits:
                    continue
                found = self._match(pattern, text[low:high])
                if found:
                    start, end, wrong = found
                    out.append((label, low + start, low + end, wrong, len(notice)))
                    free = low + end
        return out


def base_places(joined: bytes, phrases: dict[str, str] = PHRASES) -> list[tuple[int, str]]:
    """(word number, label) of every place where a phrase's words stand."""
    padded = b" " + joined + b" "
    out = []
    for phrase, label in phrases.items():
        wanted = b" " + phrase.encode() + b" "
        at = padded.find(wanted)
        word, counted = 0, 0
        while at >= 0:
            word += padded.count(b" ", counted, at)
            counted = at
            out.append((word, label))
            at = padded.find(wanted, at + 1)
    return out


def joined_words(raw: bytes) -> tuple[int, bytes]:
    words = raw.translate(_WORDS).split()
    return len(words), b" ".join(words)


def _scorer():
    matcher = Matcher()
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def score(batches):
        for batch in batches:
            rows = []
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text"))):
                n, joined = joined_words(raw)
                base = base_places(joined)
                fuzzy = matcher.find(joined)
                places = [w for w, _ in base]
                own = {label for _, label in base}
                best = max([1 - e / n for _, _, _, e, n in fuzzy], default=0.0)
                rows.append((doc_id, n, len(base), min(places, default=None), max(places, default=None), ",".join(sorted(own)), ",".join(sorted(own | {f[0] for f in fuzzy})), 1.0 if base else best))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return score


def _reporter():
    matcher = Matcher()
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
    names = [x.split()[0] for x in SPANS.split(", ")]

    def report(batches):
        for batch in batches:
            rows = []
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text"))):
                joined = joined_words(raw)[1]
                found = matcher.find(joined)
                text, at, word = joined.decode() if found else "", 0, 0
                for label, a, b, edits, _ in sorted(found, key=lambda f: f[1]):
                    # Words are counted on from the place before.
                    word, at = word + text.count(" ", at, a), a
                    rows.append((doc_id, label, a, b, word, word + text.count(" ", a, b), edits))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return report


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, labels and score of every document."""
    return mapped(_own(docs, id_col, text_col), _scorer(), SCHEMA)


def notice_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every verified notice: span in the joined words, its words and its edits."""
    return mapped(_own(docs, id_col, text_col), _reporter(), SPANS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
