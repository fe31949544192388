"""Benchmark decontamination by a prefix-filtered set join.

An item's windows (runs of item words) must lie in a document whole, so every shingle of a
window is necessary and one shingle is a sufficient prefix: the one that is rarest in the
corpus. Documents meet windows on that shingle only; its offset in the window gives the
start, the ends of the document bound it (length and position), and what is left is
verified word by word. Windows whose rarest shingle occurs nowhere are gone before the join.

The benchmark is cut into blocks of bounded bytes, so what a worker holds does not grow
with it; the corpus streams past one block after the other, without a shuffle of texts.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phasewise.llm.staging import carried, stage
from phasewise.llm.words import ALPHANUMERIC, Words, slices, utf8

WINDOW = 10
SHINGLE = 3
#: Bytes of item texts in a block. Windows take some twenty times as much in a worker.
BLOCK_BYTES = 8_000_000


class Block:
    """The windows of some items, found by one of their shingles."""

    def __init__(self, items: list[Row], window: int):
        texts = [row["text"].encode().lower() for row in items]
        self.ids = [row["item_id"] for row in items]
        words = Words(texts, ALPHANUMERIC)
        found: dict[bytes, set[int]] = defaultdict(set)
        for i in range(len(texts)):
            begin, end = int(words.bounds[i]), int(words.bounds[i + 1])
            size = min(window, end - begin)
            for start in range(begin, end - size + 1 if size else begin):
                found[words.run(start, size)].add(i)
        self.windows = sorted(found)
        self.items = [sorted(found[w]) for w in self.windows]
        self.sizes = np.array([w.count(b" ") + 1 for w in self.windows], dtype=np.int64)
        own = Words(self.windows, ALPHANUMERIC)
        self.shingles: list[np.ndarray] = []
        self.hashes = np.zeros(len(self.windows), dtype=np.uint64)
        runs = {n: own.run_hashes(n) for n in {*range(1, SHINGLE + 1), *self.sizes.tolist()}}
        for w, size in enumerate(self.sizes.tolist()):
            begin, k = int(own.bounds[w]), min(SHINGLE, size)
            self.shingles.append(runs[k][begin : begin + size - k + 1])
            self.hashes[w] = runs[size][begin]

    def lengths(self) -> list[int]:
        """Shingle lengths in use."""
        return sorted({min(SHINGLE, s) for s in self.sizes.tolist()})

    def vocabulary(self) -> np.ndarray:
        return np.unique(np.concatenate([*self.shingles, np.empty(0, np.uint64)]))

    def choose_prefixes(self, counts: dict[int, int]) -> None:
        """Keep each window under its rarest shingle; drop windows that cannot occur."""
        entries = []
        for w, shingles in enumerate(self.shingles):
            rarity = [(counts.get(int(s), 0), int(s), o) for o, s in enumerate(shingles)]
            count, shingle, offset = min(rarity)
            if count:
                entries.append((min(SHINGLE, int(self.sizes[w])), shingle, offset, w))
        self.prefixes = {}
        for k in self.lengths():
            own = sorted(e[1:] for e in entries if e[0] == k)
            keys = np.array([e[0] for e in own], dtype=np.uint64)
            self.prefixes[k] = (keys, np.array([e[1] for e in own], dtype=np.int64),
                                np.array([e[2] for e in own], dtype=np.int64))
        self.shingles = []


class _Members:
    """Membership in sorted hashes: a bit table first, then a binary search."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = np.zeros(1 << 20, dtype=bool)
        self.bits[self._slot(keys)] = True

    @staticmethod
    def _slot(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(44)).astype(np.int64)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of hashes that are members."""
        near = np.flatnonzero(self.bits[self._slot(hashes)])
        if not len(near) or not len(self.keys):
            return near[:0]
        at = np.minimum(np.searchsorted(self.keys, hashes[near]), len(self.keys) - 1)
        return near[self.keys[at] == hashes[near]]


def _lowered(batch: pa.RecordBatch) -> list[bytes]:
    return [t.lower() for t in utf8(batch.column("text"))]


def _shingle_counts(docs: DataFrame, block: Block) -> dict[int, int]:
    """How often each shingle of the block occurs in all documents."""
    vocabulary, lengths = block.vocabulary(), block.lengths()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        member = _Members(vocabulary)
        counts = np.zeros(len(vocabulary), dtype=np.int64)
        for batch in batches:
            texts = _lowered(batch)
            for a, b in slices(texts):
                words = Words(texts[a:b], ALPHANUMERIC)
                for k in lengths:
                    hashes = words.run_hashes(k)[words.run_inside(k)]
                    hit = hashes[member.places(hashes)]
                    np.add.at(counts, np.searchsorted(vocabulary, hit), 1)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(vocabulary[seen].view(np.int64)), pa.array(counts[seen])],
            ["shingle", "n"])

    parts = docs.select("text").mapInArrow(run, "shingle long, n long")
    sums = parts.groupBy("shingle").agg(F.sum("n").alias("n"))
    return {r["shingle"] & (1 << 64) - 1: r["n"] for r in sums.collect()}


def _search(words: Words, block: Block, members: dict[int, _Members]):
    """Mask of hit words, and pairs (text, window) of occurrences."""
    change = np.zeros(len(words.hashes) + 1, dtype=np.int64)
    pairs: set[tuple[int, int]] = set()
    text_of = words.text_of_word()
    runs: dict[int, np.ndarray] = {}
    for k, (keys, offsets, windows) in block.prefixes.items():
        hashes = words.run_hashes(k)
        places = members[k].places(hashes)
        first = np.searchsorted(keys, hashes[places], "left")
        count = np.searchsorted(keys, hashes[places], "right") - first
        place = np.repeat(places, count)
        entry = np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count)
        entry = entry + np.arange(len(entry))
        start, window = place - offsets[entry], windows[entry]
        size = block.sizes[window]
        # The window must begin and end within the text its shingle was found in.
        text = text_of[place]
        fits = (start >= words.bounds[text]) & (start + size <= words.bounds[text + 1])
        start, window, size, text = start[fits], window[fits], size[fits], text[fits]
        for n in np.unique(size).tolist():
            if n not in runs:
                runs[n] = words.run_hashes(n)
            own = np.flatnonzero(size == n)
            own = own[runs[n][start[own]] == block.hashes[window[own]]]
            for s, w, t in zip(start[own].tolist(), window[own].tolist(), text[own].tolist()):
                if words.run(s, n) == block.windows[w]:
                    change[s] += 1
                    change[s + n] -= 1
                    pairs.add((t, w))
    return np.cumsum(change[:-1]) > 0, pairs


def _pass(docs: DataFrame, block: Block, carry: bool, last: bool) -> DataFrame:
    """Add the hits of one block; ``hit`` has a bit per word, ``items`` the item ids."""
    broadcast = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = broadcast.value
        members = {k: _Members(keys) for k, (keys, _, _) in own.prefixes.items()}
        for batch in batches:
            texts = _lowered(batch)
            before = zip(batch.column("hit").to_pylist(), batch.column("items").to_pylist())
            n_words, n_hit, hits, items = [], [], [], []
            for a, b in slices(texts):
                words = Words(texts[a:b], ALPHANUMERIC)
                mask, pairs = _search(words, own, members)
                new: dict[int, set[str]] = defaultdict(set)
                for t, w in pairs:
                    new[t].update(own.ids[i] for i in own.items[w])
                for t, (old_hit, old_items) in zip(range(b - a), before):
                    hit = mask[words.bounds[t] : words.bounds[t + 1]]
                    if old_hit is not None:
                        bits = np.unpackbits(np.frombuffer(old_hit, np.uint8), count=len(hit))
                        hit = hit | bits.astype(bool)
                    n_words.append(len(hit))
                    n_hit.append(int(hit.sum()))
                    hits.append(np.packbits(hit).tobytes())
                    items.append(sorted(new[t].union(old_items or ())))
            columns = {"doc_id": batch.column("doc_id"), "n_words": pa.array(n_words, pa.int64()),
                       "n_hit": pa.array(n_hit, pa.int64()), "hit": pa.array(hits, pa.binary()),
                       "items": pa.array(items, pa.list_(pa.string()))}
            for name in names:
                columns[name] = batch.column(name)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = T.StructType.fromDDL(
        f"doc_id {kind}, n_words long, n_hit long, hit binary, items array<string>")
    names = ["carried"] * carry + ["text"] * (not last)
    for name in names:
        schema.add(docs.schema[name])
    columns = ["doc_id", "text", "hit", "items"] + ["carried"] * carry
    return docs.select(*columns).mapInArrow(run, schema)


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[Row]]:
    """Items in groups of about ``block_bytes``, one group on the driver at a time."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").dropna()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) if n else F.lit(0)
    for i in range(n):
        rows = items.filter(part == i).distinct().collect()
        if rows:
            yield rows


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                       block_bytes: int = BLOCK_BYTES, carry: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): the words that benchmark windows cover.

    Columns: doc_id, n_words, n_hit, hit (a bit per word, first word in the highest bit of
    the first byte) and items (item ids with an occurring window, as sorted strings). Words
    are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lowered.
    Null and empty texts have no words. Items without id, text or words take no part; rows
    of the same item count as one item; an item shorter than a window is one window.
    Repeated rows and null doc_ids pass through. With ``carry``, a struct ``carried`` holds
    all columns of the row; else other columns are not read. An empty benchmark hits nothing.
    """
    state = docs.select("doc_id", "text", F.lit(None).cast("binary").alias("hit"),
                        F.lit(None).cast("array<string>").alias("items"),
                        *([carried(docs)] if carry else []))
    source = docs
    waiting: Block | None = None
    for rows in blocks(benchmark, block_bytes):
        if waiting is not None:
            state = stage(_pass(state, waiting, carry, last=False), "decontaminate")
            source = state
        waiting = Block(rows, window)
        waiting.choose_prefixes(_shingle_counts(source, waiting) if waiting.windows else {})
    if waiting is None:
        waiting = Block([], window)
        waiting.choose_prefixes({})
    return _pass(state, waiting, carry, last=True)
