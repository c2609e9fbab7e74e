"""Packing documents into fixed-length token sequences by bin completion.

Documents are tokenised once; only those longer than a sequence are cut.  How full sequences are made depends on piece lengths alone, so the
search runs on the histogram of lengths (at most `size` rows, whatever the corpus):
best-fit decreasing on whole classes of equal lengths gives the first incumbent, then
branch and bound completes the bin of the largest remaining length with undominated
fillings, prunes by the waste that a better solution may still have, and keeps every
better solution as the incumbent.  It stops at the lower bound or after `nodes` nodes
(a search effort, no limit on data).

The answer is a list of patterns with multiplicities.  Every piece gets its rank among
the pieces of its length by a two-level running count, and rank and length give its
sequence and offset from the pattern table, which has at most 2 * size patterns of at
most sqrt(2 * size) different lengths.

Defined cases: null and empty texts are the end token alone; a null id stays null; very
long texts are tokenised whole and cut into full sequences; repeated rows are packed each;
an empty table gives an empty result; columns of other names are ignored.
"""

from __future__ import annotations

import gc
import os
import re
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate, chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm.common import as_bytes, mapped, running_start, settle, table

SIZE = 2048
END_ID = 0
NODES = 20_000
FILLINGS = 64
# Steps of one enumeration of fillings.
STEPS = 4096
CACHE_WORDS = 500_000

Pattern = tuple[tuple[int, int], ...]  # (length, how often), lengths falling
Solution = list[tuple[Pattern, int]]  # patterns with the number of bins


# -- tokens ---------------------------------------------------------------------------

# Fixed values of the tokenizer's format: its split pattern, for lower-case text of the letters below.
_LETTER = "a-zß-öø-ɏ"
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|\n|[^\n{_LETTER}0-9]+")


def plain_signs() -> str:
    """Signs, digits and letters whose normal form and lower case do not depend on neighbours and stay among them."""
    own = [chr(c) for c in range(0x21, 0x250) if not 0x7F <= c < 0xC0 and c not in (0xD7, 0xF7)]
    low = re.compile(f"[!-~{_LETTER}]")
    return "".join(c for c in own if low.fullmatch(c.lower()))


_SIGNS = re.escape(plain_signs())
_PLAIN = re.compile(f"[{_SIGNS}]+")
_ALL_PLAIN = re.compile(f"[\n{_SIGNS}]*")


def byte_letters() -> dict[int, int]:
    """The letters that byte-level models write for bytes: visible ones stand for themselves (a fixed rule of the format)."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in visible]
    return {b: b for b in visible} | {b: 256 + i for i, b in enumerate(other)}


class WordIds:
    """Token ids of a text, word by word, with bounded caches of words and word parts.

    The tokenizer drops white space and never merges across it, so a text's ids are
    those of its words.  Plain words are cut further at the tokenizer's own split
    pattern, and its model gives the ids of each part; other words go through the whole
    tokenizer.
    """

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        none = np.zeros(0, np.int64)
        self.words: dict[bytes, int] = {}
        self.flat, self.starts, self.lengths = none, none, none
        # Part 0 is the line end between words and has no ids.
        self.parts: dict[str, int] = {"\n": 0}
        self.part_flat, self.part_starts, self.part_lengths = array("q"), array("q", [0]), array("q", [0])

    def _new_parts(self, parts: list[str]) -> None:
        tokenize, letters = self.model.tokenize, self.letters
        texts = [p if p.isascii() else p.encode().decode("latin-1").translate(letters) for p in parts]
        found = [[t.id for t in tokenize(text)] for text in texts]
        lengths = array("q", map(len, found))
        first, at = len(self.part_starts), len(self.part_flat)
        self.parts.update(zip(parts, range(first, first + len(parts))))
        self.part_starts.extend(accumulate(lengths[:-1], initial=at))
        self.part_lengths.extend(lengths)
        self.part_flat.extend(chain.from_iterable(found))

    def _add(self, words: list[bytes], flat: np.ndarray, lengths: np.ndarray) -> None:
        first, at = len(self.starts), len(self.flat)
        self.words.update(zip(words, range(first, first + len(words))))
        self.flat = np.concatenate([self.flat, flat])
        self.starts = np.concatenate([self.starts, at + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])

    def _learn(self, words: list[bytes]) -> None:
        text = b"\n".join(words).decode()
        if not _ALL_PLAIN.fullmatch(text) or any(x in text for x in self.special):
            texts = [w.decode() for w in words]
            odd = [not _PLAIN.fullmatch(t) or any(x in t for x in self.special) for t in texts]
            whole = [w for w, o in zip(words, odd) if o]
            found = self.tokenizer.encode_batch_fast([t for t, o in zip(texts, odd) if o], add_special_tokens=False)
            ids = [f.ids for f in found]
            self._add(whole, np.array([i for own in ids for i in own], np.int64), np.array([len(own) for own in ids], np.int64))
            words = [w for w, o in zip(words, odd) if not o]
            if not words:
                return
            text = b"\n".join(words).decode()
        sequence = _PARTS.findall(text.lower())
        new = list(set(sequence).difference(self.parts))
        if new:
            self._new_parts(new)
        number = np.fromiter(map(self.parts.__getitem__, sequence), np.int64, len(sequence))
        lengths = np.array(self.part_lengths)[number]
        flat = np.array(self.part_flat)[_ranges(np.array(self.part_starts)[number], lengths)]
        ends = np.append(np.cumsum(lengths)[np.flatnonzero(number == 0)], len(flat))
        self._add(words, flat, np.diff(ends, prepend=0))

    def encode(self, raws: list[bytes]) -> list[np.ndarray]:
        """Ids of each text."""
        if max(len(self.words), len(self.parts)) > self.limit:
            self.clear()
        words = [raw.split() for raw in raws]
        counts = np.array([len(w) for w in words], np.int64)
        flat = list(chain.from_iterable(words))
        number = np.fromiter(map(self.words.get, flat, repeat(-1)), np.int64, len(flat))
        unknown = np.flatnonzero(number < 0)
        if len(unknown):
            missing = [flat[i] for i in unknown.tolist()]
            self._learn(list(dict.fromkeys(missing)))
            number[unknown] = np.fromiter(map(self.words.__getitem__, missing), np.int64, len(missing))
        lengths = self.lengths[number]
        ids = self.flat[_ranges(self.starts[number], lengths)].astype(np.uint32)
        bounds = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every (start, length), one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


_ENCODERS: dict[str, WordIds] = {}


def _piece_maker(path: str, size: int, with_ids: bool):
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids

    def cut(batches):
        encoder = _ENCODERS.setdefault(path, None) or WordIds(path)
        _ENCODERS[path] = encoder
        # Millions of small objects and no cycles: the cycle collector would only walk the caches.
        gc.disable()
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(as_bytes(batch.column("text")))):
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), size)):
                    own = ids[start : start + size]
                    rows.append((doc_id, piece, start, len(own), zlib.crc32(own.tobytes())) + ((own.astype(np.int32),) if with_ids else ()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return cut


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and the ids) of every document's pieces."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return mapped(own, _piece_maker(tokenizer, size, with_ids), schema)


# -- search on the histogram ----------------------------------------------------------


def lower_bound(counts: dict[int, int], size: int) -> int:
    """The best of the bounds that count large lengths apart, over all thresholds."""
    have = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        have[length] = n
    number, mass = np.cumsum(have), np.cumsum(have * np.arange(size + 1))
    half = size // 2
    k = np.arange(0, half + 1)
    low = np.maximum(k - 1, 0)
    alone = number[size] - number[size - k]
    big, big_mass = number[size - k] - number[half], mass[size - k] - mass[half]
    small_mass = mass[half] - np.where(k > 0, mass[low], 0)
    more = np.maximum(0, -(-(small_mass - (big * size - big_mass)) // size))
    return int((alone + big + more).max())


def best_fit(counts: dict[int, int], size: int) -> Solution:
    """Best-fit decreasing on classes of equal lengths and of equal bins."""
    open_: dict[int, list[list]] = {}  # gap -> [pattern, bins]
    done: Solution = []
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            gap = min((g for g in open_ if g >= length), default=None)
            if gap is None:
                fit = size // length
                whole, rest = divmod(left, fit)
                fresh = [(((length, fit),), whole)] * bool(whole) + [(((length, rest),), 1)] * bool(rest)
                for pattern, n in fresh:
                    open_.setdefault(size - length * pattern[0][1], []).append([pattern, n])
                break
            entry = open_[gap][-1]
            pattern, bins = entry
            each = min(gap // length, left)
            n = min(bins, left // each)
            left -= n * each
            entry[1] -= n
            if not entry[1]:
                open_[gap].pop()
                if not open_[gap]:
                    del open_[gap]
            rest = gap - each * length
            grown = pattern + ((length, each),)
            if rest:
                open_.setdefault(rest, []).append([grown, n])
            else:
                done.append((grown, n))
    return done + [(p, n) for entries in open_.values() for p, n in entries]


def _dominates(a: tuple, b: tuple) -> bool:
    """Whether the items of b can be dealt into bins of the sizes of a."""

    def deal(items: tuple, room: list[int]) -> bool:
        if not items:
            return True
        tried = set()
        for i, r in enumerate(room):
            if r >= items[0] and r not in tried:
                tried.add(r)
                room[i] -= items[0]
                if deal(items[1:], room):
                    return True
                room[i] += items[0]
        return False

    return deal(b, list(a))


def _within(lengths: list[int], counts: dict[int, int], gap: int, waste: int, limit: int, steps: int) -> list[tuple[int, ...]]:
    """Item lists that fill `gap` up to `waste`, longest items first, as far as the effort goes."""
    mass = [0] * (len(lengths) + 1)
    for i in range(len(lengths) - 1, -1, -1):
        mass[i] = mass[i + 1] + lengths[i] * counts[lengths[i]]
    falling = [-x for x in lengths]
    found: list[tuple[int, ...]] = []
    todo: list[tuple[int, int, tuple]] = [(0, gap, ())]
    while todo and len(found) < limit and steps:
        i, room, items = todo.pop()
        steps -= 1
        i = max(i, bisect_left(falling, -room))
        if i == len(lengths) or room == 0:
            if room <= waste:
                found.append(items)
        elif room - min(room, mass[i]) <= waste:
            most = min(room // lengths[i], counts[lengths[i]])
            todo += [(i + 1, room - n * lengths[i], items + (lengths[i],) * n) for n in range(most + 1)]
    return found


def fillings(counts: dict[int, int], gap: int, slack: int, limit: int = FILLINGS, steps: int = STEPS) -> list[tuple[int, ...]]:
    """Undominated item lists that fill `gap` up to at most `slack` waste, least waste first.

    A quarter of the effort looks for full bins, the rest for all allowed waste.  When it ends
    with none, the best-fit filling stands in if its waste is allowed.
    """
    if counts.get(gap, 0) > 0:
        return [(gap,)]
    lengths = sorted((x for x, n in counts.items() if n and x <= gap), reverse=True)
    found = _within(lengths, counts, gap, 0, limit, steps // 4) if slack else []
    if len(found) < limit:
        found += _within(lengths, counts, gap, slack, limit - len(found), steps - steps // 4)
    if not found:
        room, items = gap, ()
        for x in lengths:
            n = min(room // x, counts[x])
            room, items = room - n * x, items + (x,) * n
        found = [items] if room <= slack else []
    kept: list[tuple[int, ...]] = []
    for items in sorted(set(found), key=lambda x: (-sum(x), len(x), x)):
        if not any(_dominates(k, items) for k in kept if len(items) <= 8 and sum(k) >= sum(items)):
            kept.append(items)
    return kept


def _pattern(items: tuple[int, ...]) -> Pattern:
    out: dict[int, int] = {}
    for x in sorted(items, reverse=True):
        out[x] = out.get(x, 0) + 1
    return tuple(out.items())


def complete_bins(counts: dict[int, int], size: int = SIZE, nodes: int = NODES) -> Solution:
    """Patterns and multiplicities that hold all lengths in as few bins as the search finds.

    The remaining lengths are held once and taken back on the way up, so memory is the path and
    its open siblings and not a histogram for each of them.
    """
    left = {x: n for x, n in counts.items() if n}
    if not left:
        return []
    best = best_fit(left, size)
    bins = sum(n for _, n in best)
    least = lower_bound(left, size)
    total = sum(x * n for x, n in left.items())
    path: Solution = []
    stack: list[tuple] = [(0, None, 0, 0, 0)]  # length of the path before, pattern, times, bins, waste
    while stack and bins > least and nodes > 0:
        nodes -= 1
        depth, pattern, times, used, waste = stack.pop()
        while len(path) > depth:
            for x, k in path[-1][0]:
                left[x] = left.get(x, 0) + k * path[-1][1]
            path.pop()
        if pattern:
            path.append((pattern, times))
            for x, k in pattern:
                left[x] -= k * times
                if not left[x]:
                    del left[x]
        if not left:
            if used < bins:
                bins, best = used, path[::-1]
            continue
        slack = (bins - 1) * size - total - waste
        if slack < 0 or used + lower_bound(left, size) >= bins:
            continue
        largest = max(left)
        rest = dict(left)
        rest[largest] -= 1
        for items in reversed(fillings(rest, size - largest, slack)):
            pattern = _pattern((largest,) + items)
            loss = size - sum(x * k for x, k in pattern)
            times = min(left[x] // k for x, k in pattern)
            if loss:
                times = min(times, slack // loss)
            stack.append((len(path), pattern, times, used + times, waste + loss * times))
    return best


# -- places ---------------------------------------------------------------------------


def pattern_table(solution: Solution) -> dict[int, np.ndarray]:
    """Per length, rows (first rank, first sequence, how often a bin has it, offset)."""
    rows: dict[int, list[tuple]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for pattern, bins in solution:
        offset = 0
        for length, each in pattern:
            rank = ranks.get(length, 0)
            rows.setdefault(length, []).append((rank, sequence, each, offset))
            ranks[length] = rank + bins * each
            offset += length * each
        sequence += bins
    return {length: np.array(r, np.int64) for length, r in rows.items()}


def _placer(patterns: dict[int, np.ndarray], keep: int):
    def place(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for x in np.unique(length):
                own = length == x
                rows = patterns[int(x)]
                row = rows[np.searchsorted(rows[:, 0], rank[own], "right") - 1]
                nth = rank[own] - row[:, 0]
                sequence[own] = row[:, 1] + nth // row[:, 2]
                offset[own] = row[:, 3] + nth % row[:, 2] * x
            columns = [batch.column(i) for i in range(keep)] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:keep] + ["sequence_id", "offset"])

    return place


def pack(cut: DataFrame, size: int = SIZE, nodes: int = NODES) -> DataFrame:
    """Add sequence_id and offset to written pieces (doc_id, piece, start, length, ids_crc32, ...)."""
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    patterns = pattern_table(complete_bins(counts, size, nodes))
    order = [F.col("doc_id").asc_nulls_last(), F.col("piece"), F.col("ids_crc32")]
    ranked = running_start(cut.withColumnRenamed("start", "__at"), "length", ["doc_id", "piece"], order, F.lit(1))
    ranked = ranked.select(*[F.col("__at").alias("start") if c == "start" else F.col(c) for c in cut.columns], F.col("start").cast("long").alias("rank"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    return mapped(ranked, _placer(patterns, len(cut.columns)), schema)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def packed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Every piece of every document with its place."""
    return pack(settle(pieces(docs, tokenizer or tokenizer_path(), id_col=id_col, text_col=text_col), "pack-pieces"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))


def solution_bins(solution: Solution) -> Iterator[list[int]]:
    """Every bin of a solution as its lengths."""
    for pattern, bins in solution:
        for _ in range(bins):
            yield [x for x, k in pattern for _ in range(k)]
