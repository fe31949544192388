"""Toxicity classifier with counterfactual regularisation.

Features say which words, and which word beginnings, occur in a text. A logistic model is
fitted on a bounded sample of labelled rows. For every sampled text that mentions a group,
the identity terms are swapped for others of the same kind; the fit penalises the squared
change of the score, so weight cannot settle on the mention itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasewise.llm.words import Words, byte_table, slices, utf8

#: Labelled rows used for the fit, about; a hash of the id picks them.
SAMPLE_ROWS = 20_000
FEATURE_BITS = 20
#: Lengths in bytes of the word beginnings used besides whole words.
BEGINNINGS = (4, 5, 6)
#: A feature takes part if its rates under the two labels differ by so many deviations.
MIN_DEVIATIONS = 6.0
#: Weight of the squared score change under a swap, and of the squared weights.
SWAP_PENALTY, WEIGHT_PENALTY = 1.0, 3e-5
STEPS, STEP_SIZE = 600, 0.1
#: Terms that name a group, by kind. A term is swapped for the next of its kind.
IDENTITY_TERMS = {
    "gender": "woman man girl boy women men girls boys mujer hombre mujeres hombres "
              "femme homme femmes hommes frau mann frauen männer",
    "belief": "muslim christian jewish hindu buddhist atheist muslims christians jews hindus "
              "buddhists atheists musulmán cristiano judío musulman chrétien juif",
    "origin": "african asian european american arab latino indian chinese mexican african-american "
              "africans asians europeans americans arabs latinos indians mexicans",
    "colour": "black white brown negro blanco noir blanc schwarze weiße",
    "orientation": "gay lesbian straight bisexual homosexual heterosexual queer",
    "status": "immigrant refugee citizen foreigner immigrants refugees citizens foreigners",
    "body": "disabled deaf blind old young elderly",
}
_LETTERS = byte_table(lambda b: 97 <= b <= 122 or b >= 128)
_SHIFT = np.uint64(64 - FEATURE_BITS)


def _feature_slots(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (words, their feature slots), for whole words and for each beginning."""
    every = np.arange(len(words.hashes))
    yield every, (words.hashes >> _SHIFT).astype(np.int64)
    for size in BEGINNINGS:
        own, hashes = words.beginnings(size)
        yield own, (hashes >> _SHIFT).astype(np.int64)


def features(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct feature slots of each text."""
    raw = [t.lower().encode() for t in texts]
    out = []
    for a, b in slices(raw):
        words = Words(raw[a:b], _LETTERS)
        text_of = words.text_of_word()
        pairs = np.concatenate([(text_of[own] << FEATURE_BITS) | slots
                                for own, slots in _feature_slots(words)])
        pairs = np.unique(pairs)
        cuts = np.searchsorted(pairs >> FEATURE_BITS, np.arange(b - a + 1))
        slots = (pairs & (1 << FEATURE_BITS) - 1).astype(np.int32)
        out += [slots[x:y] for x, y in zip(cuts[:-1], cuts[1:])]
    return out


class Swap:
    """Replaces every identity term by the next one of its kind."""

    def __init__(self, terms: dict[str, str]):
        kinds = [words.lower().split() for words in terms.values()]
        self.next = {w: kind[(i + 1) % len(kind)] for kind in kinds for i, w in enumerate(kind)}
        # The longest term first; terms are whole words.
        names = sorted(self.next, key=len, reverse=True)
        self.pattern = regex.compile(r"(?<!\p{L})(?:\L<names>)(?!\p{L})", names=names) if names else None

    def __call__(self, text: str) -> str | None:
        """The lower-cased text with terms swapped; None if it names no group."""
        if self.pattern is None:
            return None
        swapped, n = self.pattern.subn(lambda m: self.next[m[0]], text.lower())
        return swapped if n else None


class Model:
    """Weights by feature slot, and the intercept."""

    def __init__(self, slots: np.ndarray, weights: np.ndarray, intercept: float):
        self.slots, self.weights, self.intercept = slots, weights, intercept

    def table(self) -> np.ndarray:
        out = np.zeros(1 << FEATURE_BITS)
        out[self.slots] = self.weights
        return out


def _sparse(rows: list[np.ndarray], place: np.ndarray):
    """Row numbers and columns of the chosen features."""
    columns = place[np.concatenate([*rows, np.empty(0, np.int32)]).astype(np.int64)]
    numbers = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    return numbers[columns >= 0], columns[columns >= 0]


def fit(rows: list[np.ndarray], swapped: list[np.ndarray | None], labels: np.ndarray) -> Model:
    """Select features by their rates under the labels, then fit by Adam on the whole sample.

    The loss is the mean log loss with both labels weighing the same, plus the swap penalty
    over texts that name a group and the weight penalty.
    """
    n, positive = len(rows), labels.sum()
    if not 0 < positive < n:
        return Model(np.empty(0, np.int64), np.empty(0), 40.0 if n and positive else -40.0)
    size = 1 << FEATURE_BITS
    seen = np.concatenate(rows)
    held = np.repeat(labels, [len(r) for r in rows])
    ones, all_ = np.bincount(seen[held == 1], minlength=size), np.bincount(seen, minlength=size)
    rate1, rate0 = ones / positive, (all_ - ones) / (n - positive)
    rate = (all_ + 1) / (n + 2)
    spread = np.sqrt(rate * (1 - rate) * (1 / positive + 1 / (n - positive)))
    slots = np.flatnonzero(np.abs(rate1 - rate0) > MIN_DEVIATIONS * spread)
    place = np.full(size, -1)
    place[slots] = np.arange(len(slots))
    row, column = _sparse(rows, place)
    pairs = [i for i, s in enumerate(swapped) if s is not None]
    before = _sparse([rows[i] for i in pairs], place)
    after = _sparse([swapped[i] for i in pairs], place)
    share = np.where(labels == 1, 0.5 / positive, 0.5 / (n - positive))
    w = np.zeros(len(slots) + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        score = np.bincount(row, w[column], n) + w[-1]
        miss = (1 / (1 + np.exp(-score)) - labels) * share
        grad = np.append(np.bincount(column, miss[row], len(slots)), miss.sum())
        if pairs:
            change = (np.bincount(before[0], w[before[1]], len(pairs))
                      - np.bincount(after[0], w[after[1]], len(pairs)))
            pull = 2 * SWAP_PENALTY / len(pairs) * change
            grad[:-1] += np.bincount(before[1], pull[before[0]], len(slots))
            grad[:-1] -= np.bincount(after[1], pull[after[0]], len(slots))
        grad[:-1] += 2 * WEIGHT_PENALTY * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= STEP_SIZE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return Model(slots, w[:-1], float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS,
          terms: dict[str, str] = IDENTITY_TERMS) -> Model:
    """Fit on about ``sample_rows`` of the rows of ``docs`` (doc_id, text) with a label.

    ``labels`` (doc_id, toxic); null ids and labels take no part, any label but 0 is toxic.
    """
    known = labels.select("doc_id", (F.col("toxic") != 0).cast("int").alias("toxic")).dropna()
    total = known.count()
    parts = 1 << 20
    share = min(parts, -(-sample_rows * parts // max(total, 1)))
    picked = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) < share)
    # The sample is bounded by its size, whatever the tables hold.
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        swap = Swap(terms)
        for batch in batches:
            texts = [t.decode() for t in utf8(batch.column("text"))]
            others = [swap(t) for t in texts]
            changed = iter(features([t for t in others if t is not None]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array(features(texts), pa.list_(pa.int32())),
                 pa.array([None if t is None else next(changed) for t in others],
                          pa.list_(pa.int32()))], ["toxic", "slots", "swapped"])

    found = rows.select("toxic", "text").mapInArrow(
        run, "toxic int, slots array<int>, swapped array<int>").toArrow()
    slots = [s.values.to_numpy() for s in found.column("slots")]
    swapped = [s.values.to_numpy() if s.is_valid else None for s in found.column("swapped")]
    return fit(slots, swapped, found.column("toxic").to_numpy())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id and score, from 0 to 1.

    Whole texts are scored; a null or empty one gets the score of no features. Repeated rows
    and null doc_ids pass through; other columns are not read. No shuffle.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, intercept = broadcast.value.table(), broadcast.value.intercept
        used = table != 0
        for batch in batches:
            texts = [t.decode().lower().encode() for t in utf8(batch.column("text"))]
            total = np.full(len(texts), intercept)
            for a, b in slices(texts):
                words = Words(texts[a:b], _LETTERS)
                text_of = words.text_of_word()
                hits = []
                for own, slots in _feature_slots(words):
                    hit = used[slots]
                    hits.append((text_of[own[hit]] << FEATURE_BITS) | slots[hit])
                hits = np.unique(np.concatenate(hits))
                total[a:b] += np.bincount(
                    hits >> FEATURE_BITS, table[hits & (1 << FEATURE_BITS) - 1], b - a)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(total, -60, 60))))],
                ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
