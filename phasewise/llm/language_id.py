"""Language identification as inference over a mixture of languages.

Training counts letter n-grams per language over all labelled rows. A document is read as
words, each drawn from one of several languages; expectation-maximisation estimates the
document's language proportions from the n-gram likelihood of its words. Starting from all
languages, the weakest is removed as long as the likelihood, penalised per language, does
not fall, so a document gets the set of languages it needs and no more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasewise.llm.staging import carried, with_carried
from phasewise.llm.words import Words, byte_table, utf8

#: N-gram lengths and hash buckets; the model is buckets x languages of 4-byte numbers.
GRAMS = (1, 2, 3, 4)
BUCKETS = 1 << 17
#: Expectation-maximisation rounds with all languages, and after each removal.
ROUNDS, MORE_ROUNDS = 6, 3
#: Weight of the penalty of half the logarithm of the word count per language.
PENALTY = 2.0
#: Characters whose distinct words are worked out together.
LETTERS_AT_A_TIME = 1 << 19
#: Bytes of words: ASCII lower-case letters and all characters beyond ASCII.
LETTERS = byte_table(lambda b: 97 <= b <= 122 or b >= 128)
_DRAW = np.random.Generator(np.random.PCG64(6)).integers(
    1, 1 << 63, max(GRAMS) + 1, dtype=np.uint64) | np.uint64(1)


class Grams:
    """The words of consecutive texts, and the n-gram buckets of each distinct word.

    Words are runs of ASCII letters and characters beyond ASCII, lower-cased; a run without
    any letter is no word. Texts repeat most words, so n-grams are taken once per distinct
    word of a slice.
    """

    def __init__(self, texts: list[str]):
        words = Words([t.lower().encode() for t in texts], LETTERS)
        _, first, kind = np.unique(words.hashes, return_index=True, return_inverse=True)
        data = words.data
        spans = zip(words.starts[first].tolist(), words.ends[first].tolist())
        distinct = [data[a:b] for a, b in spans]
        lettered = np.array([w[0] < 128 or any(map(str.isalpha, w.decode())) for w in distinct],
                            dtype=bool)
        place = np.cumsum(lettered) - 1
        held = lettered[kind] if len(kind) else np.empty(0, bool)
        #: Distinct word of each word; words ``bounds[i]`` on belong to text i.
        self.kinds = place[kind[held]]
        self.bounds = np.concatenate(([0], np.cumsum(held)))[words.bounds]
        self.n_kinds = int(lettered.sum())
        self._index([w for w, good in zip(distinct, lettered.tolist()) if good])

    def _index(self, distinct: list[bytes]) -> None:
        """``buckets`` of all n-grams, borders included, and the distinct word of each."""
        text = b" ".join([b"", *distinct, b""]).decode()
        c = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        letter = c != 32
        word_at = np.cumsum(~letter) - 1
        buckets, words = [], []
        value = np.zeros(len(c), dtype=np.uint64)
        for n in range(1, max(GRAMS) + 1):
            size = len(c) - n + 1
            if size <= 0:
                break
            value = value[:size] + c[n - 1 :] * _DRAW[n]
            if n not in GRAMS:
                continue
            # The blank before or after a word may be part of a gram, not one in between.
            inner = letter[:size].copy() if n == 1 else letter[:size] | letter[1 : size + 1]
            for i in range(1, n - 1):
                inner &= letter[i : size + i]
            at = np.flatnonzero(inner)
            h = (value[at] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            buckets.append(((h >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int32))
            words.append(word_at[at])
        self.buckets = np.concatenate(buckets) if buckets else np.empty(0, np.int32)
        self.words = np.concatenate(words) if words else np.empty(0, np.int64)

    def bucket_counts(self) -> np.ndarray:
        """How often each bucket occurs in the texts."""
        often = np.bincount(self.kinds, minlength=self.n_kinds)
        return np.bincount(self.buckets, often[self.words], BUCKETS).astype(np.int64)


def _text_slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``LETTERS_AT_A_TIME`` characters each."""
    begin, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > LETTERS_AT_A_TIME:
            yield begin, i
            begin, held = i, 0
        held += len(text) + 1
    if begin < len(texts):
        yield begin, len(texts)


class Model:
    """Log probabilities of n-gram buckets by language, and the languages' names."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smooth = counts + 0.5
        logs = np.log(smooth / smooth.sum(axis=0, keepdims=True))
        self.logs = np.ascontiguousarray(logs.T, dtype=np.float32)

    def word_logs(self, grams: Grams) -> np.ndarray:
        """Log likelihood of each word by language: its n-grams' sum over the n-gram lengths,
        so that a letter, which is in one n-gram per length and offset, counts about once."""
        out = np.empty((len(self.languages), grams.n_kinds), dtype=np.float32)
        for row, logs in zip(out, self.logs):
            row[:] = np.bincount(grams.words, logs[grams.buckets], grams.n_kinds)
        return (out / len(GRAMS))[:, grams.kinds]


def train(docs: DataFrame) -> Model:
    """Count n-grams of all rows of ``docs`` (text, lang) with both columns present.

    The counts of a language are summed on the cluster; the driver gets at most one number
    per bucket and language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for lang in set(langs):
                own = [t for t, g in zip(texts, langs) if g == lang]
                total = counts.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                for a, b in _text_slices(own):
                    total += Grams(own[a:b]).bucket_counts()
        for lang, total in counts.items():
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(seen), pa.string()), pa.array(seen.astype(np.int32)),
                 pa.array(total[seen])], ["lang", "bucket", "n"])

    rows = docs.select("text", "lang").dropna()
    parts = rows.mapInArrow(run, "lang string, bucket int, n long")
    sums = parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = np.array(sums.column("lang").to_pylist(), dtype=object)
    languages = sorted(set(langs.tolist()))
    counts = np.zeros((BUCKETS, len(languages)))
    for i, lang in enumerate(languages):
        own = langs == lang
        counts[sums.column("bucket").to_numpy()[own], i] = sums.column("n").to_numpy()[own]
    return Model(languages, counts)


def mixtures(logs: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Language proportions of each text (a column each) from its words' log likelihoods.

    ``logs`` has a row per language; ``bounds`` are the first words of the texts that have
    words, and the end.
    """
    n_langs, n_texts = len(logs), len(bounds) - 1
    sizes = np.diff(bounds)
    top = logs.max(axis=0)
    likely = np.exp(np.maximum(logs - top, -60))
    tops = np.add.reduceat(top, bounds[:-1])

    def refine(share: np.ndarray, texts: np.ndarray, rounds: int):
        n = sizes[texts]
        begin = np.concatenate(([0], np.cumsum(n)[:-1]))
        own = np.repeat(np.arange(len(texts)), n)
        rows = likely
        if len(texts) < n_texts:
            rows = likely[:, np.repeat(bounds[texts] - begin, n) + np.arange(len(own))]
        for _ in range(rounds):
            joint = rows * share[:, own]
            joint /= np.maximum(joint.sum(axis=0), 1e-30)
            share = (np.add.reduceat(joint, begin, axis=1) / n).astype(np.float32)
        total = np.log(np.maximum((rows * share[:, own]).sum(axis=0), 1e-30))
        return share, np.add.reduceat(total, begin) + tops[texts]

    even = np.full((n_langs, n_texts), 1 / n_langs, dtype=np.float32)
    share, fit = refine(even, np.arange(n_texts), ROUNDS)
    active = np.arange(n_texts)
    for _ in range(n_langs - 1):
        reduced = share[:, active]
        weakest = np.where(reduced > 0, reduced, np.inf).argmin(axis=0)
        reduced[weakest, np.arange(len(active))] = 0
        # Floating point may leave nothing else; then the text keeps its set.
        rest = reduced.sum(axis=0)
        active, reduced = active[rest > 0], (reduced / np.maximum(rest, 1e-30))[:, rest > 0]
        if not len(active):
            break
        reduced, new_fit = refine(reduced, active, MORE_ROUNDS)
        better = fit[active] - new_fit <= PENALTY * 0.5 * np.log(sizes[active] + 1)
        active = active[better]
        share[:, active], fit[active] = reduced[:, better], new_fit[better]
    return share


def identify(docs: DataFrame, model: Model, carry: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): the languages of the text.

    Columns: doc_id, lang_pred (the language with the largest share, ties to the first name;
    ``und`` if the text is null, empty or without letters, or nothing was learned), score
    (its share, 0 for ``und``), langs and shares (the selected set). With ``carry``, a struct ``carried``
    holds all columns of the row; else other columns are not read. Repeated rows and null
    doc_ids pass through. Rows are scored one by one, without a shuffle.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = broadcast.value
        names = own.languages
        for batch in batches:
            texts = [t.decode() for t in utf8(batch.column("text"))]
            best, score, langs, shares = [], [], [], []
            for a, b in _text_slices(texts):
                grams = Grams(texts[a:b])
                full = np.flatnonzero(np.diff(grams.bounds) > 0) if names else np.empty(0, int)
                found = {}
                if len(full):
                    bounds = np.append(grams.bounds[full], grams.bounds[full[-1] + 1])
                    found = dict(zip(full.tolist(), mixtures(own.word_logs(grams), bounds).T))
                for t in range(b - a):
                    share = found.get(t)
                    if share is None:
                        best.append("und"), score.append(0.0), langs.append([]), shares.append([])
                        continue
                    used = np.flatnonzero(share > 0)
                    best.append(names[int(share.argmax())])
                    score.append(float(min(1.0, share.max())))
                    langs.append([names[i] for i in used])
                    shares.append(share[used].tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(best, pa.string()), pa.array(score, pa.float64()),
                 pa.array(langs, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64())),
                 *([batch.column("carried")] if carry else [])],
                ["doc_id", "lang_pred", "score", "langs", "shares"] + ["carried"] * carry)

    columns = ["doc_id", "text"] + [carried(docs)] * carry
    schema = (f"doc_id {kind}, lang_pred string, score double, langs array<string>, "
              "shares array<double>")
    return docs.select(*columns).mapInArrow(run, with_carried(schema, docs, carry))


def fold(modulus: int):
    """Remainder of the CRC-32 of the id's decimal text; null ids have none."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))
