"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a piece there is exactly one token that can end its encoding: the one
that forms a stable pair with the last token of what precedes it. ``PrefixTable`` stores
that token per prefix. Appending bytes only extends the table, an edit keeps the table up
to the edit, and walking back from the end yields the ids. The result equals merging by
rank, without redoing merges.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct pieces in each of the two generations a worker remembers.
CACHED_PIECES = 120_000
#: Pairs of neighbouring tokens whose stability a worker remembers.
CACHED_PAIRS = 200_000
#: Letters of texts whose new pieces are encoded together.
GROUP = 1 << 19


class Vocabulary:
    """Ranks of a byte-level vocabulary and how each token came out of two shorter ones."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.known_pairs: dict[int, bool] = {}
        # A single byte is its own pair of parts. Tokens that merging never produces have no
        # parts; they are used only where they are a whole piece.
        self.parts: dict[int, tuple[int, int]] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.parts[rank] = (rank, rank)
                continue
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left in self.parts and right in self.parts and self.stable(left, right, rank):
                    self.parts[rank] = (left, right)
                    break
        #: Every end of a token that merging produces, with its rank or -1 if it is none.
        self.ends = {token[i:]: -1 for token, rank in ranks.items() if rank in self.parts
                     for i in range(len(token))}
        self.ends |= {token: rank for token, rank in ranks.items() if rank in self.parts}

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            return cls({base64.b64decode(token): int(rank) for token, rank in pairs})

    def fits(self, left: int, right: int) -> bool:
        """``stable`` without a limit, remembered."""
        pair = left << 32 | right
        known = self.known_pairs.get(pair)
        if known is None:
            if len(self.known_pairs) >= CACHED_PAIRS:
                self.known_pairs.clear()
            known = self.known_pairs[pair] = self.stable(left, right)
        return known

    def stable(self, left: int, right: int, limit: float = float("inf")) -> bool:
        """Whether two neighbouring tokens stay apart under all merges ranked below ``limit``.

        Undoes merges next to the border, latest first; at every step the two tokens then at
        the border must have no merge that would have come before the one undone.
        """
        ranks, tokens, parts = self.ranks, self.tokens, self.parts
        while True:
            joined = ranks.get(tokens[left] + tokens[right])
            if joined is not None and joined < limit:
                return False
            left_rank = left if len(tokens[left]) > 1 else -1
            right_rank = right if len(tokens[right]) > 1 else -1
            if left_rank < 0 and right_rank < 0:
                return True
            # Of two equal merges the left one comes first, so the right one is undone first.
            if left_rank > right_rank:
                limit, left = left_rank, parts[left][1]
            else:
                limit, right = right_rank + 1, parts[right][0]


class PrefixTable:
    """The last token of every prefix of a piece, open to appends and edits."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        vocabulary, last = self.vocabulary, self.last
        rank, known, fits = vocabulary.ends.get, vocabulary.known_pairs.get, vocabulary.fits
        begin = len(self.data)
        self.data = data = self.data + more
        for end in range(begin + 1, len(data) + 1):
            for start in range(end - 1, -1, -1):
                token = rank(data[start:end])
                if token is None:
                    raise ValueError("the vocabulary lacks a single byte")
                if token < 0:
                    continue
                if not start:
                    break
                good = known(last[start] << 32 | token)
                if good or good is None and fits(last[start], token):
                    break
            last.append(token)

    def replace(self, start: int, end: int, new: bytes) -> None:
        """Exchange bytes ``start`` to ``end``; what lies before is not worked out again."""
        tail = self.data[end:]
        self.data, self.last = self.data[:start], self.last[: start + 1]
        self.append(new + tail)

    def ids(self) -> list[int]:
        if self.data in self.vocabulary.ranks:
            return [self.vocabulary.ranks[self.data]]
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end])
            end -= len(self.vocabulary.tokens[out[-1]])
        return out[::-1]


class Encoder:
    """Pieces of texts to ids, packed as little-endian unsigned 32-bit integers.

    New pieces of a group of texts are encoded in sorted order over one prefix table: each
    keeps what the table holds of the beginning it shares with the one before.
    """

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.pieces = vocabulary, regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        size = max(vocabulary.tokens) + 1
        self.token_list = [vocabulary.tokens.get(i, b"") for i in range(size)]

    def _learn(self, pieces: set[str]) -> None:
        if len(self.known) >= CACHED_PIECES:
            self.older, self.known = self.known, {}
        known, older, ranks = self.known, self.older.get, self.vocabulary.ranks.get
        new = []
        for piece in pieces.difference(known):
            packed = older(piece)
            if packed is None:
                data = piece.encode()
                rank = ranks(data)
                if rank is None:
                    new.append((data, piece))
                    continue
                packed = struct.pack("<I", rank)
            known[piece] = packed
        table = PrefixTable(self.vocabulary)
        for data, piece in sorted(new):
            before = table.data
            shared, most = 0, min(len(before), len(data))
            while shared < most and before[shared] == data[shared]:
                shared += 1
            table.replace(shared, len(before), data[shared:])
            ids = table.ids()
            known[piece] = struct.pack(f"<{len(ids)}I", *ids)

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """Packed ids of each text; texts are split in groups of about ``GROUP`` letters."""
        begin, held = 0, 0
        for i, text in enumerate(texts):
            held += len(text)
            if held >= GROUP or i == len(texts) - 1:
                yield from self._encode_group(texts[begin : i + 1])
                begin, held = i + 1, 0

    def _encode_group(self, texts: list[str]) -> Iterator[bytes]:
        if len(texts) == 1 and len(texts[0]) > 4 * GROUP:
            # A very long text goes through in parts of its own.
            yield b"".join(self._long(texts[0]))
            return
        pieces = [self.pieces.findall(text) for text in texts]
        self._learn(set(chain.from_iterable(pieces)))
        packed = self.known.__getitem__
        for own in pieces:
            yield b"".join(map(packed, own))

    def _long(self, text: str) -> Iterator[bytes]:
        matches = self.pieces.finditer(text)
        while own := [m[0] for m in islice(matches, GROUP // 4)]:
            self._learn(set(own))
            yield b"".join(map(self.known.__getitem__, own))

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))

    def decode(self, packed: bytes) -> bytes:
        tokens = self.token_list
        return b"".join([tokens[i] for i in np.frombuffer(packed, dtype="<u4").tolist()])

    def forget(self) -> None:
        """Give up the remembered pieces, so that an idle worker holds none."""
        self.known, self.older = {}, {}


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder per worker process, with its cache, for a vocabulary and a pattern."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(Vocabulary.read(path), pattern)
    return _encoders[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, keep_ids: bool = True) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): ids and checks of the round trip.

    Columns: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (binary,
    little-endian unsigned 32-bit). A null text counts as empty: no ids. Repeated rows and
    null doc_ids pass through, other columns are not read. Works partition by partition
    without a shuffle; memory is a batch of texts and a bounded cache of pieces.
    """
    fields = [("doc_id", docs.schema["doc_id"].dataType.simpleString()), ("n_tokens", "long"),
              ("ids_sha256", "string"), ("decoded_sha256", "string")]
    if keep_ids:
        fields.append(("ids", "binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            counts, id_hashes, text_hashes, packed = [], [], [], []
            texts = [text or "" for text in batch.column("text").to_pylist()]
            for ids in own.encode_all(texts):
                counts.append(len(ids) // 4)
                id_hashes.append(hashlib.sha256(ids).hexdigest())
                text_hashes.append(hashlib.sha256(own.decode(ids)).hexdigest())
                if keep_ids:
                    packed.append(ids)
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()),
                       pa.array(id_hashes, pa.string()), pa.array(text_hashes, pa.string())]
            if keep_ids:
                columns.append(pa.array(packed, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, [name for name, _ in fields])
        own.forget()

    schema = ", ".join(f"{name} {kind}" for name, kind in fields)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Texts of encoded rows (doc_id, ids): doc_id, text. Null ids give a null text."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            packed = batch.column("ids").to_pylist()
            texts = [None if p is None else own.decode(p) for p in packed]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.binary())], ["doc_id", "bytes"])

    decoded = encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, bytes binary")
    return decoded.select("doc_id", F.decode("bytes", "utf-8").alias("text"))
