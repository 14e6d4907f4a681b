"""Benchmark passages in documents: the q-gram lemma filters, banded alignment verifies.

An item of m characters that occurs with at most k edits shares at least
m - q + 1 - k q of its q-grams with the text, at as many places of the text and
all of them on diagonals (text position less item position) that lie within k of
each other.  Places with a shared q-gram are counted in overlapping bands of
diagonals; bands that reach the bound are aligned with the item.  Where an item
repeats a q-gram its places form runs, so a repetitive text costs as much as any.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Q = 8
#: Edits allowed, as a share of the item's characters.
EDITS = 0.08
#: Characters of text that are filtered at once, and characters of benchmark items in one broadcast part.
AT_ONCE, PART_CHARS = 1_000_000, 4_000_000
#: Runs of shared q-grams that are counted at once, and characters of the regions whose alignments are remembered.
RUNS, MEMO = 1_000_000, 4_000_000
_TABLE_BITS = 21


def _folded() -> np.ndarray:
    """Lower case of the code points that keep their length, and a space for white space; NUL parts texts."""
    table = np.arange(592, dtype=np.uint32)
    for c in range(592):
        low = chr(c).lower()
        table[c] = 32 if chr(c).isspace() or c == 0 else ord(low) if len(low) == 1 and ord(low) < 592 else c
    return table


_FOLDED = _folded()


def codes(text: str | None) -> np.ndarray:
    """Folded code points, one for each character of the text."""
    raw = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(raw < len(_FOLDED), _FOLDED[np.minimum(raw, len(_FOLDED) - 1)], raw)


def budget(length: int, edits: float = EDITS) -> int:
    """Edits allowed for an item: a share of its length, and no more than leave one shared q-gram sure."""
    return max(0, min(int(edits * length), (length - Q) // Q))


def gram_hashes(x: np.ndarray) -> np.ndarray:
    """Hash of the Q characters from each place on; built up from hashes of 1, 2, 4 and 8."""
    h, size = x.astype(np.uint64), 1
    parts, base = [], 0x9E3779B97F4A7C15
    power = base
    while True:
        if Q & size:
            parts.append((size, h))
        if 2 * size > Q:
            break
        h = h[: len(h) - size] * np.uint64(power) + h[size:]
        power = power * power % 2**64
        size *= 2
    out, done = None, 0
    for size, h in parts:
        if out is None:
            out, done = h, size
        else:
            n = len(x) - done - size + 1
            out = out[:n] * np.uint64(pow(base, size, 2**64)) + h[done : done + n]
            done += size
    return out ^ (out >> np.uint64(29))


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """Least edits of ``item`` against any stretch of ``text`` whose diagonals stay in [low, high], with its start and end; None above ``most``.

    A row for each item character, a column for each diagonal; value and start
    are one number, so that among equal edits the first start wins.
    """
    m, width = len(item), high - low + 1
    unit = 1 << 32
    padded = np.full(m + width + 1, 0xFFFFFFFF, dtype=np.uint32)
    a, b = max(low, 0), min(high + m, len(text))
    if a < b:
        padded[a - low : b - low] = text[a:b]
    place = np.arange(width, dtype=np.int64)
    starts = place + low
    none = np.int64(m + 1) * unit
    row = np.where((starts >= 0) & (starts <= len(text)), starts, none)
    ramp = place * unit
    for i in range(m):
        step = row + (padded[i : i + width] != item[i]) * np.int64(unit)
        step[:-1] = np.minimum(step[:-1], row[1:] + unit)
        row = np.minimum.accumulate(step - ramp) + ramp
    ends = place + low + m
    row = np.where(ends <= len(text), row, none)
    at = int(np.argmin(row >> 32))
    edits = int(row[at] >> 32)
    return (edits, int(row[at] & (unit - 1)), int(ends[at])) if edits <= most else None


def _summed(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the values of each key, keys rising, sums of 0 left out."""
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    total = np.add.reduceat(value, first) if len(key) else value
    return key[first][total != 0], total[total != 0]


def apart(found: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(row, item, start, end, edits), without what overlaps a better one of the same row and item: fewer edits, then the first start."""
    out, own, starts, ends = [], None, [], []
    for hit in sorted(set(found), key=lambda f: (f[0], f[1], f[4], f[2], f[3])):
        row, item, start, end, _ = hit
        if (row, item) != own:
            own, starts, ends = (row, item), [], []
        k = bisect_left(starts, start)
        if (k == 0 or ends[k - 1] <= start) and (k == len(starts) or starts[k] >= end):
            starts.insert(k, start)
            ends.insert(k, end)
            out.append(hit)
    return sorted(out)


@dataclass
class Index:
    """The q-grams of benchmark items, with the runs of their places."""

    ids: list[int]
    items: list[np.ndarray]
    memo: dict = field(default_factory=dict, repr=False)
    held: int = 0

    def __post_init__(self) -> None:
        self.budgets = np.array([budget(len(x)) for x in self.items], dtype=np.int64)
        self.wide = self.budgets + 1
        self.need = np.array([len(x) - Q + 1 - k * Q for x, k in zip(self.items, self.budgets.tolist(), strict=True)], dtype=np.int64)
        self.short = [k for k, x in enumerate(self.items) if 0 < len(x) < Q]
        long = [k for k, x in enumerate(self.items) if len(x) >= Q]
        grams = [gram_hashes(self.items[k]) for k in long]
        flat = np.concatenate([*grams, np.zeros(0, np.uint64)])
        owner = np.repeat(np.array(long, dtype=np.int64), [len(g) for g in grams])
        place = np.concatenate([*(np.arange(len(g)) for g in grams), np.zeros(0, np.int64)])
        order = np.argsort(flat, kind="stable")
        flat, owner, place = flat[order], owner[order], place[order]
        # places of a gram no farther apart than a band is wide are one run: a band that meets the run meets a place
        starts = np.ones(len(flat), dtype=bool)
        starts[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1]) | (np.diff(place) > 2 * self.wide[owner[1:]])
        begin = np.flatnonzero(starts)
        self.owner, self.low, self.high = owner[begin], place[begin], place[np.append(begin[1:], len(flat))[: len(begin)] - 1]
        self.grams, self.first = np.unique(flat[begin], return_index=True)
        self.times = np.diff([*self.first, len(begin)])
        self.table = np.zeros(1 << _TABLE_BITS, dtype=bool)
        self.table[self.grams >> np.uint64(64 - _TABLE_BITS)] = True
        self.least = int(self.need[long].min()) if long else 0
        self.reach = max((len(self.items[k]) + 2 * int(self.budgets[k]) for k in long), default=0)
        self.longest = max(map(len, self.items), default=0)

    def _steps(self, at: np.ndarray, slot: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
        """Where, along (item, band), the number of places with a shared q-gram changes, and by how much."""
        keys, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        ends = np.cumsum(self.times[slot])
        low = 0
        while low < len(at):
            done = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, done + RUNS, side="right")))
            times = self.times[slot[low:high]]
            run = np.repeat(self.first[slot[low:high]] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            item, place = self.owner[run], np.repeat(at[low:high], times)
            key = item * 2 * span + span
            steps = [key + (place - self.high[run]) // self.wide[item] - 1, key + (place - self.low[run]) // self.wide[item] + 1]
            key, value = _summed(np.concatenate(steps), np.repeat([1, -1], len(run)))
            keys.append(key)
            values.append(value)
            low = high
        return _summed(np.concatenate(keys), np.concatenate(values))

    def bands(self, x: np.ndarray) -> np.ndarray:
        """(item, first diagonal) of the bands of a folded text that hold enough places with a shared q-gram."""
        none = np.zeros((0, 2), dtype=np.int64)
        if len(x) < Q or not len(self.grams):
            return none
        h = gram_hashes(x)
        at = np.nonzero(self.table[h >> np.uint64(64 - _TABLE_BITS)])[0]
        slot = np.minimum(np.searchsorted(self.grams, h[at]), len(self.grams) - 1)
        hit = self.grams[slot] == h[at]
        at, slot = at[hit], slot[hit]
        # only stretches that hold as many hits as the least demanding item needs
        lag = self.least - 1
        if len(at) <= lag:
            return none
        dense = np.nonzero(at[lag:] - at[: len(at) - lag] <= self.reach)[0]
        change = np.zeros(len(at) + 1, dtype=np.int64)
        np.add.at(change, dense, 1)
        np.add.at(change, dense + lag + 1, -1)
        near = np.cumsum(change[:-1]) > 0
        at, slot = at[near], slot[near]
        if not len(at):
            return none
        span = len(x) + self.longest + 3
        key, step = self._steps(at, slot, span)
        enough = np.flatnonzero(np.cumsum(step) >= self.need[key // (2 * span)])
        # from each step to the next one the count is the same
        size = key[enough + 1] - key[enough]
        key = np.repeat(key[enough] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        item = key // (2 * span)
        return np.stack([item, (key % (2 * span) - span) * self.wide[item]], axis=1)

    def aligned(self, item: int, region: np.ndarray, low: int, high: int) -> tuple[int, int, int] | None:
        key = (item, low, high, region.tobytes())
        if key not in self.memo:
            if self.held > MEMO:
                self.memo.clear()
                self.held = 0
            self.held += len(region)
            self.memo[key] = align(self.items[item], region, low, high, int(self.budgets[item]))
        return self.memo[key]

    def matches(self, x: np.ndarray) -> set[tuple[int, int, int, int]]:
        """(item, start, end, edits) of the occurrences in a folded text that the bands and the short items show."""
        found = set()
        for item, first in self.bands(x).tolist():
            m, k = len(self.items[item]), int(self.budgets[item])
            low = max(0, first - k)  # an alignment leaves its own q-grams' diagonals by k at most
            high = min(len(x), first + 2 * (k + 1) + k + m)
            hit = self.aligned(item, x[low:high], first - k - low, first + 2 * (k + 1) + k - low)
            if hit:
                found.add((item, hit[1] + low, hit[2] + low, hit[0]))
        for item in self.short:
            text, part = x.tobytes(), self.items[item].tobytes()
            at = text.find(part)
            while at >= 0:
                if at % 4 == 0:
                    found.add((item, at // 4, at // 4 + len(self.items[item]), 0))
                at = text.find(part, at + 1)
        return found

    def search(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(row, item, start, end, edits) over many texts, the best of those of an item that overlap; long texts are cut into pieces that overlap by more than the longest match."""
        out, overlap = [], self.longest + 4 * int(self.budgets.max(initial=0)) + Q
        held: list[tuple[int, int, np.ndarray]] = []
        total = 0

        def flush() -> None:
            if not held:
                return
            # one filter over all pieces, parted by NULs, then each piece that it leaves alone
            gap = np.zeros(Q, dtype=np.uint32)
            whole = np.concatenate([y for _, _, x in held for y in (x, gap)])
            begin = np.cumsum([0, *(len(x) + Q for _, _, x in held)])[:-1]
            keep = np.arange(len(held))
            if not self.short:
                # a band may begin before its text and end after it
                first = np.unique(self.bands(whole)[:, 1])
                low = np.maximum(np.searchsorted(begin, first - self.longest, side="right") - 1, 0)
                high = np.searchsorted(begin, first + 2 * self.longest, side="right") - 1
                near = np.zeros(len(held) + 1, dtype=np.int64)
                np.add.at(near, low, 1)
                np.add.at(near, high + 1, -1)
                keep = np.flatnonzero(np.cumsum(near[:-1]) > 0)
            for k in keep.tolist():
                row, offset, x = held[k]
                out.extend((row, item, start + offset, end + offset, edits) for item, start, end, edits in self.matches(x))
            held.clear()

        for row, text in enumerate(texts):
            x = codes(text)
            for low in range(0, max(1, len(x) - overlap), AT_ONCE):
                part = x[low : low + AT_ONCE + overlap]
                held.append((row, low, part))
                total += len(part)
                if total >= AT_ONCE:
                    flush()
                    total = 0
        flush()
        return apart(out)


def _parts(benchmark: DataFrame) -> tuple[DataFrame, int]:
    rows = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    total = rows.agg(F.sum(F.char_length("text"))).first()[0] or 0
    return rows, max(1, -(-total // PART_CHARS))


def _broadcast(docs: DataFrame, items: DataFrame, part: int, parts: int):
    here = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").collect()
    return docs.sparkSession.sparkContext.broadcast(([r["item_id"] for r in here], [codes(r["text"]) for r in here]))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, item_id, start, end, edits)``: occurrences of benchmark items in the texts, in code points, end exclusive.

    An item may differ by up to ``EDITS`` of its characters; case and the kind
    of white space do not count.  Items shorter than ``Q`` characters must occur
    exactly, empty ones never do; of overlapping occurrences of an item the one
    with the fewest edits stays.  Benchmarks go in parts of about ``PART_CHARS``
    characters by a hash of the item, each collected, broadcast and searched
    with one pass over the documents.  Null and empty texts hold nothing;
    repeated rows give repeated occurrences, repeated items count once, an empty
    table on either side gives none, and other columns are left aside.  Long
    texts go in pieces of ``AT_ONCE`` characters, whose memory does not depend on
    how often a text repeats an item's q-grams.
    """
    items, parts = _parts(benchmark)
    rows = docs.select(docs[id_col].cast("string").alias("id"), docs[text_col].alias("text"))
    out = None
    for part in range(parts):
        sent = _broadcast(docs, items, part, parts)

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            index = Index(*sent.value)
            for batch in batches:
                found = index.search(list(batch["text"]))
                row = [f[0] for f in found]
                yield pd.DataFrame({"id": batch["id"].to_numpy()[row], "item_id": [index.ids[f[1]] for f in found], "start": [f[2] for f in found], "end": [f[3] for f in found], "edits": [f[4] for f in found]})

        kind = benchmark.schema["item_id"].dataType.simpleString()
        found = rows.mapInPandas(run, f"id string, item_id {kind}, start bigint, end bigint, edits int")
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias("doc_id"), "item_id", "start", "end", "edits")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item, as ``contaminated`` finds them.

    One filter over the rows for each part of the benchmark, and no shuffle.
    Rows with a null or empty text stay, so do repeated rows and columns of any
    name; without items all rows stay.
    """
    items, parts = _parts(benchmark)
    for part in range(parts):
        docs = docs.filter(_clean(_broadcast(docs, items, part, parts))(docs[text_col]))
    return docs


def _clean(sent):
    @F.pandas_udf("boolean")
    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Index(*sent.value)
        for batch in texts:
            flags = np.ones(len(batch), dtype=bool)
            flags[[f[0] for f in index.search(list(batch))]] = False
            yield pd.Series(flags)

    return clean
