"""Extendible hashing against its definition."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pytest

from phasewise.llm import sharding
from tests.llm.hard_rows import documents, texts


def shards(rows, limit):
    """Split buckets on the next bit, one at a time."""
    def digits(i, t):
        text = ("" if i is None else str(i)) + "\x1f" + (t or "")
        return f"{int(hashlib.md5(text.encode()).hexdigest()[:15], 16):060b}"

    waiting, done = {"": [(digits(*r), r) for r in rows]}, Counter()
    while waiting:
        prefix, held = waiting.popitem()
        size = sum(len((t or "").encode()) for _, (_, t) in held)
        if size <= limit or len({d for d, _ in held}) == 1:
            for _, (i, _) in held:
                done[i, prefix, len(prefix), size, len(held)] += 1
            continue
        parts = defaultdict(list)
        for d, r in held:
            parts[d[: len(prefix) + 1]].append((d, r))
        waiting |= parts
    return done


@pytest.mark.parametrize("limit,bits", [(1 << 20, 8), (3000, 8), (700, 8), (300, 2), (0, 7)])
def test_shards(spark, monkeypatch, limit, bits):
    monkeypatch.setattr(sharding, "ROUND_BITS", bits)
    rows = texts() + [(500, "equal rows " * 40)] * 30
    found = sharding.assign_shards(documents(spark, rows), limit)
    columns = ("doc_id", "shard", "depth", "shard_bytes", "shard_docs")
    assert Counter(tuple(r[c] for c in columns) for r in found.collect()) == shards(rows, limit)


def test_empty(spark):
    assert sharding.assign_shards(documents(spark, [])).count() == 0


def test_written_shards(spark, tmp_path):
    rows = [r for r in dict(texts()).items() if r[0] is not None]
    docs = documents(spark, rows)
    sharding.write_shards(docs, str(tmp_path / "out"), 4000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter(r["doc_id"] for r in back.collect()) == Counter(i for i, _ in rows)
    assert back.select("shard").distinct().count() > 1


@pytest.mark.parametrize("limit,bits", [(1 << 20, 8), (700, 8), (300, 2)])
def test_written_shards_hold_every_row_once(spark, monkeypatch, tmp_path, limit, bits):
    monkeypatch.setattr(sharding, "ROUND_BITS", bits)
    rows = texts() + [(500, "equal rows " * 40)] * 30 + [(None, "no id either")] * 3
    docs = documents(spark, rows)
    sharding.write_shards(docs, str(tmp_path / "out"), limit)
    back = Counter()
    for folder in (tmp_path / "out").glob("shard=*"):
        shard = folder.name.removeprefix("shard=").replace("__HIVE_DEFAULT_PARTITION__", "")
        held = spark.read.parquet(str(folder))
        assert held.columns == docs.columns
        back.update((r["doc_id"], r["text"], shard) for r in held.collect())
    expected = shards([(i, t or "") for i, t in rows], limit)
    assert Counter(r[:2] for r in back.elements()) == Counter(rows)
    placed = Counter()
    for (i, shard, *_), n in expected.items():
        placed[i, shard] += n
    assert Counter((i, s) for i, _, s in back.elements()) == placed
