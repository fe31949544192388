"""Removal of word passages that repeat across documents, with a count-min prefilter.

A window's smallest ten-word gram stands for it in the sketch: equal windows have equal
smallest grams, so the count of that gram never falls below the count of the window.
Every partition counts its documents' grams in the sketch's rows, the partial sketches are
added up cell by cell, and windows whose smallest gram is estimated to be in fewer than two
documents are done. Cells are rows of a table, so the sketch has no memory limit and is
never sent to anyone whole.

A second pass hashes the remaining windows in full (96 bits) and groups them exactly. A
batch settles what it can by itself and sends a window once per smallest document, so the
group of a hot passage has one row per batch; groups are streamed in sorted order and
nothing but the current window and its smallest document is held.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasewise.llm.staging import stage
from phasewise.llm.words import BLANK_SEPARATED, Words, mix, slices, utf8

WINDOW = 50
#: Words of the grams that stand for windows, at most.
GRAM = 10
#: Rows of the sketch, and cells of a row per gram entry counted: the width follows the data.
DEPTH, CELLS_PER_GRAM = 2, 8
#: A fixed width of the rows instead, if set.
WIDTH: int | None = None
_U = np.uint64


def _smallest_grams(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of the windows that lie inside a text, and their smallest gram."""
    gram = min(GRAM, window)
    hashes = words.run_hashes(gram)
    span, reach = window - gram + 1, 1
    least = hashes
    while reach * 2 <= span:
        least = np.minimum(least[: len(least) - reach], least[reach:])
        reach *= 2
    if span > reach and len(least):
        least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
    inside = np.flatnonzero(words.run_inside(window))
    return inside, least[inside] if len(inside) else inside.astype(np.uint64)


def _rows(docs: DataFrame) -> DataFrame:
    """doc, text, and ``row``, which tells rows of one document apart by their text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
    return rows.withColumn("row", F.xxhash64("doc", "text"))


def _document_grams(rows: DataFrame, window: int) -> DataFrame:
    """row, grams: the distinct smallest grams of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = utf8(batch.column("text")), batch.column("row")
            found = []
            for a, b in slices(texts):
                words = Words(texts[a:b], BLANK_SEPARATED)
                starts, grams = _smallest_grams(words, window)
                cuts = np.searchsorted(starts, words.bounds).tolist()
                found += [np.unique(grams[x:y]).view(np.int64)
                          for x, y in zip(cuts[:-1], cuts[1:])]
            full = [i for i, grams in enumerate(found) if len(grams)]
            if full:
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(full)), pa.array([found[i] for i in full])],
                    ["row", "grams"])

    return rows.select("row", "text").mapInArrow(run, "row long, grams array<long>")


def _cell(level: int, width: int):
    return F.pmod(F.xxhash64("gram", F.lit(level)), F.lit(width))


def sketch_width(grams: DataFrame) -> int:
    """``WIDTH`` if set, else a power of two of at least CELLS_PER_GRAM cells per entry."""
    if WIDTH:
        return WIDTH
    entries = grams.agg(F.sum(F.size("grams"))).first()[0] or 0
    return 1 << max(10, math.ceil(math.log2(max(1, entries * CELLS_PER_GRAM))))


def repeated_grams(grams: DataFrame) -> DataFrame:
    """row, grams that the sketch estimates to be in at least two documents.

    The width grows with the grams counted, so the share of crowded cells stays the same at
    every size: about one in CELLS_PER_GRAM per row of the sketch.
    """
    width = sketch_width(grams)
    each = grams.select("row", F.explode("grams").alias("gram"))
    levels = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), _cell(i, width).alias("cell"))
                                 for i in range(DEPTH)])).alias("at")
    # Partial sums are the partitions' sketches; the final sums merge them.
    sketch = each.select(levels).groupBy("at.level", "at.cell").agg(F.count(F.lit(1)).alias("n"))
    high = stage(sketch.filter("n >= 2").select("level", "cell"), "sketch")
    for i in range(DEPTH):
        level = high.filter(F.col("level") == i).select("cell")
        each = each.withColumn("cell", _cell(i, width)).join(level, "cell", "left_semi").drop("cell")
    return each.groupBy("row").agg(F.collect_set("gram").alias("grams"))


def _first_of_runs(*keys: np.ndarray) -> np.ndarray:
    first = np.zeros(len(keys[0]), dtype=bool)
    first[:1] = True
    for key in keys:
        first[1:] |= key[1:] != key[:-1]
    return first


def _send_windows(rows: DataFrame, window: int) -> DataFrame:
    """Windows left by the sketch: (a, b, doc, row); b has 32 hash bits and the first word.

    Rows without doc are settled: a smaller document of the same batch has the window.
    """
    low = _U(0xFFFFFFFF)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, wanted = utf8(batch.column("text")), batch.column("grams")
            docs, ids = (batch.column(c).to_numpy() for c in ("doc", "row"))
            parts = []
            for a, b in slices(texts):
                words = Words(texts[a:b], BLANK_SEPARATED)
                starts, grams = _smallest_grams(words, window)
                if not len(starts):
                    continue
                cuts = np.searchsorted(starts, words.bounds).tolist()
                keep = np.concatenate([
                    x + np.flatnonzero(np.isin(
                        grams[x:y].view(np.int64), wanted[a + i].values.to_numpy()))
                    for i, (x, y) in enumerate(zip(cuts[:-1], cuts[1:]))])
                at = starts[keep.astype(np.int64)]
                text = words.text_of_word()[at]
                pos = (at - words.bounds[text]).astype(np.uint64)
                parts.append((words.run_hashes(window)[at],
                              (words.run_hashes(window, second=True)[at] & ~low) | pos,
                              docs[a + text], ids[a + text]))
            if not parts:
                continue
            h1, h2, doc, row = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((doc, h2 >> _U(32), h1))
            h1, h2, doc, row = h1[order], h2[order], doc[order], row[order]
            first = _first_of_runs(h1, h2 >> _U(32))
            least = doc[first][np.cumsum(first) - 1] if len(doc) else doc
            settled = doc > least
            h1 = np.where(settled, mix(h2 ^ row.view(np.uint64)), h1)
            for i in range(0, len(h1), 100_000):
                part = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1[part].view(np.int64)), pa.array(h2[part].view(np.int64)),
                     pa.array(doc[part], mask=settled[part]), pa.array(row[part])],
                    ["a", "b", "doc", "row"])

    return rows.select("doc", "row", "text", "grams").mapInArrow(
        run, "a long, b long, doc long, row long")


def _settle(windows: DataFrame) -> DataFrame:
    """(row, pos) of windows that a smaller document has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, least = None, None
        for batch in batches:
            a, b, row = (batch.column(c).to_numpy() for c in ("a", "b", "row"))
            settled = batch.column("doc").is_null().to_numpy(zero_copy_only=False)
            doc = batch.column("doc").fill_null(0).to_numpy()
            drop = settled.copy()
            open_ = np.flatnonzero(~settled)
            if len(open_):
                x, y, d = a[open_], b[open_] >> 32, doc[open_]
                first = _first_of_runs(x, y)
                smallest = d[first]
                if last == (x[0], y[0]):
                    smallest[0] = least
                smallest = smallest[np.cumsum(first) - 1]
                drop[open_] = d > smallest
                last, least = (x[-1], y[-1]), smallest[-1]
            if drop.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row[drop]), pa.array((b[drop] & 0xFFFFFFFF).astype(np.int32))],
                    ["row", "pos"])

    ordered = windows.repartition("a").sortWithinPartitions("a", F.shiftright("b", 32), "doc")
    return ordered.mapInArrow(run, "row long, pos int")


def _keep(rows: DataFrame, window: int, id_type: str, keep_text: bool) -> DataFrame:
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * keep_text
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names[1:]]
            for text, starts in zip(utf8(batch.column("text")), batch.column("starts")):
                words, removed = text.split(), 0
                n = len(words)
                if starts.is_valid:
                    change = np.zeros(n + 1, dtype=np.int32)
                    at = np.unique(starts.values.to_numpy())
                    change[at] += 1
                    change[at + window] -= 1
                    words = [words[i] for i in np.flatnonzero(np.cumsum(change[:n]) == 0).tolist()]
                    removed = n - len(words)
                kept = b" ".join(words)
                values = [n, removed, hashlib.sha256(kept).hexdigest()]
                for column, value in zip(out, values + [kept] * keep_text):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * keep_text
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), *(pa.array(c, k) for c, k in zip(out, kinds))], names)

    done = rows.select("doc", "text", "starts").mapInArrow(
        run, schema + ", kept binary" * keep_text)
    done = done.withColumn("doc_id", F.col("doc_id").cast(id_type))
    if keep_text:
        done = done.withColumn("kept", F.decode("kept", "utf-8"))
    return done


def remove_repeats(docs: DataFrame, window: int = WINDOW, keep_text: bool = True) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): the text without passages of smaller documents.

    Columns: doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept (the words left,
    joined by one space). A word goes if a window over it (``window`` consecutive words) also
    starts in a document with a smaller doc_id; windows are those of the input. Words are
    blank-separated and unchanged; null, empty and short texts have no window and stay.
    ``doc_id`` is integral; a row without it takes no part and stays whole. Rows that repeat
    a doc_id are parts of one document and do not remove from each other. Other columns are
    not read. Window hashes have 96 bits.
    """
    rows = _rows(docs)
    with_id = rows.filter("doc is not null")
    grams = stage(_document_grams(with_id, window), "grams")
    flagged = stage(repeated_grams(grams), "flagged")
    # Both joins read the same exchange of the texts; rows without doc are never flagged.
    left = rows.join(flagged, "row")
    starts = _settle(_send_windows(left, window)).groupBy("row").agg(
        F.collect_set("pos").alias("starts"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _keep(rows.join(starts, "row", "left"), window, kind, keep_text)
