"""Operators on document texts against brute force, over hard rows."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from pyspark.sql import functions as F

from phasewise.llm import byte_bpe, decontaminate, jaccard_join, line_dedup, substring_dedup
from tests.llm.hard_rows import documents, texts

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK = r"[^\x20\x09-\x0D]+"


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def rows_of(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


# Decontamination

ITEMS = [(1, "an other text under a used id and more of it"), (2, "Two words"), (3, None),
         (None, "one"), (4, ""), (10, "one"), (10, "same same same"), (5, "same " * 12),
         (6, "... !!"), (7, " ".join(texts()[20][1].split()[5:40]))]


def contamination(items, window):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for item, text in items:
        words = pattern.findall((text or "").translate(UPPER))
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if size and item is not None else 0):
            windows[tuple(words[i : i + size])].add(str(item))

    def judge(text):
        words = pattern.findall((text or "").translate(UPPER))
        hit, found = set(), set()
        for window_words, ids in windows.items():
            n = len(window_words)
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) == window_words:
                    hit.update(range(i, i + n))
                    found |= ids
        return len(words), len(hit), ",".join(sorted(found))

    return judge


@pytest.mark.parametrize("block_bytes", [8_000_000, 60])
@pytest.mark.parametrize("window", [10, 2])
def test_decontamination(spark, block_bytes, window):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontaminate.find_contamination(documents(spark), items, window, block_bytes)
    judge = contamination(ITEMS, window)
    expected = Counter((i, *judge(t)) for i, t in texts())
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["items"]))
                   for r in found.collect()) == expected
    assert any(key[2] for key in expected)


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    found = decontaminate.find_contamination(documents(spark), none)
    assert all(r["n_hit"] == 0 and r["items"] == [] for r in found.collect())
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.find_contamination(documents(spark, []), items).count() == 0


def test_contamination_carries_columns(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = documents(spark)
    for block_bytes in (8_000_000, 60):
        found = decontaminate.find_contamination(docs, items, 10, block_bytes, carry=True)
        carried = found.select("carried.*")
        assert carried.columns == docs.columns
        assert Counter(map(tuple, carried.collect())) == Counter(map(tuple, docs.collect()))


# Line dedup

def lines_left(rows):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(UPPER)

    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                holders[key(line)].add(i)
    out = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(key(x)) < 10
                or len(holders[key(x)]) < 2 or min(holders[key(x)]) == i]
        out[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


@pytest.mark.parametrize("batches,fanout", [(4, 2), (1, 2), (5, 3)])
def test_line_dedup(spark, batches, fanout):
    found = line_dedup.dedup_lines(documents(spark), batches, fanout)
    assert rows_of(found, "doc_id", "n_lines", "n_dropped", "kept") == lines_left(texts())


def test_line_dedup_with_colliding_row_hashes(spark, monkeypatch):
    # Every row gets the same first 64 bits; doc_id and the second half still tell them apart.
    keys = line_dedup.row_keys
    monkeypatch.setattr(line_dedup, "row_keys", lambda d, t: (F.lit(7).cast("long"), keys(d, t)[1]))
    found = line_dedup.dedup_lines(documents(spark), 2, 2)
    assert rows_of(found, "doc_id", "n_lines", "n_dropped", "kept") == lines_left(texts())


def test_line_dedup_of_empty_and_null_ids(spark):
    assert line_dedup.dedup_lines(documents(spark, [])).count() == 0
    rows = [(None, "a line of many letters"), (None, "a line of many letters")]
    found = line_dedup.dedup_lines(documents(spark, rows))
    assert {r["n_dropped"] for r in found.collect()} == {0}


def test_runs_are_compacted(spark):
    runs = line_dedup.SortedRuns(spark, fanout=2)
    for i in range(5):
        runs.add(spark.range(i * 3, i * 3 + 3).selectExpr("id as h1", "id as h2"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    held = sorted(r["h1"] for t in runs.tables() for r in t.collect())
    assert held == list(range(15))
    plan = runs.tables()[0].hint("merge").join(runs.tables()[1], ["h1", "h2"])._jdf.queryExecution()
    assert "Exchange" not in plan.executedPlan().toString()
    runs.close()


def test_line_dedup_has_no_python(spark):
    plan = line_dedup.dedup_lines(documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# Substring removal

def substrings_left(rows, window):
    first = {}
    words = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in sorted((x for x in words if x[0] is not None), key=lambda x: x[0]):
        for at in range(len(w) - window + 1):
            first.setdefault(tuple(w[at : at + window]), i)
    out = Counter()
    for i, w in words:
        gone = set()
        for at in range(len(w) - window + 1 if i is not None else 0):
            if first[tuple(w[at : at + window])] < i:
                gone.update(range(at, at + window))
        kept = b" ".join(x for at, x in enumerate(w) if at not in gone)
        out[i, len(w), len(gone), sha(kept)] += 1
    return out


@pytest.mark.parametrize("window", [50, 1, 7])
def test_substring_removal(spark, window):
    found = substring_dedup.remove_repeats(documents(spark), window)
    rows = found.collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"])
                   for r in rows) == substrings_left(texts(), window)
    assert all(sha(r["kept"].encode()) == r["kept_sha256"] for r in rows)


def test_substring_removal_with_a_crowded_sketch(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "WIDTH", 4)
    found = substring_dedup.remove_repeats(documents(spark), keep_text=False)
    assert rows_of(found, "doc_id", "n_words", "n_removed", "kept_sha256") == substrings_left(
        texts(), 50)


def test_sketch_width_follows_the_grams(spark):
    def grams(n):
        return spark.createDataFrame([(i, list(range(10))) for i in range(n)], "row long, grams array<long>")

    assert substring_dedup.sketch_width(grams(10)) == 1 << 10
    assert substring_dedup.sketch_width(grams(1000)) == 1 << 17
    assert substring_dedup.sketch_width(grams(0).limit(0)) == 1 << 10


def test_substring_removal_of_empty(spark):
    assert substring_dedup.remove_repeats(documents(spark, [])).count() == 0


# Jaccard join

def shingles(text, size):
    words = re.findall(BLANK, (text or "").translate(UPPER))
    k = min(size, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if k else frozenset()


def components(rows, size, num, den):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t, size)) for i, t in rows]
    live = [(i, s) for i, s in sets if s and i is not None]
    for x, (i, a) in enumerate(live):
        for j, b in live[:x]:
            if len(a & b) * den >= num * len(a | b):
                low, high = sorted((find(i), find(j)))
                parent[high] = low
    return Counter((i, len(s), None if i is None else find(i) if s else i) for i, s in sets)


@pytest.mark.parametrize("size,threshold,block", [
    (4, (85, 100), 500), (4, (85, 100), 2), (1, (7, 10), 500)])
def test_jaccard_components(spark, monkeypatch, size, threshold, block):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", block)
    rows = [r for r in texts() if r != (40, "an other text under a used id")]
    found = jaccard_join.jaccard_components(documents(spark, rows), size, threshold)
    assert rows_of(found, "doc_id", "n_shingles", "component_id") == components(
        rows, size, *threshold)


def test_rows_of_one_id_join_their_groups(spark):
    rows = [(1, "a b c d e"), (2, "a b c d e"), (2, "v w x y z"), (3, "v w x y z")]
    found = jaccard_join.jaccard_components(documents(spark, rows))
    assert {r["component_id"] for r in found.collect()} == {1}


def test_jaccard_of_empty(spark):
    assert jaccard_join.jaccard_components(documents(spark, [])).count() == 0
    found = jaccard_join.jaccard_components(documents(spark, [(1, None), (2, ""), (None, "a")]))
    assert rows_of(found, "doc_id", "component_id") == Counter([(1, 1), (2, 2), (None, None)])


def link_counts(rows, size, num, den):
    sets = [(i, shingles(t, size)) for i, t in rows]
    live = [s for i, s in sets if s and i is not None]
    return Counter((i, len(s), None if i is None else sum(
        len(s & x) * den >= num * len(s | x) for x in live) - 1 if s else 0) for i, s in sets)


@pytest.mark.parametrize("size,threshold,block", [
    (4, (85, 100), 1000), (4, (85, 100), 3), (1, (7, 10), 1000), (1, (7, 10), 2)])
def test_jaccard_links(spark, monkeypatch, size, threshold, block):
    monkeypatch.setattr(jaccard_join, "COUNT_SETS", block)
    monkeypatch.setattr(jaccard_join, "SEND_BYTES", 5000)
    base = [f"w{i}" for i in range(200)]
    near = [" ".join(base[:i] + ["edit"] + base[i + 1 :]) for i in range(0, 200, 20)]
    rows = texts() + [(200 + i, t) for i, t in enumerate(near)]
    rows += [(300 + i, near[0]) for i in range(9)] + [(400, near[1])] * 3 + [(None, near[2])]
    found = jaccard_join.jaccard_components(documents(spark, rows), size, threshold)
    expected = link_counts(rows, size, *threshold)
    assert rows_of(found, "doc_id", "n_shingles", "n_links") == expected
    assert max(k[2] or 0 for k in expected) > 20


def test_a_repeated_row_goes_to_its_group_once_a_task(spark, monkeypatch):
    base = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(base))] * 500 + [(2, " ".join(base[:-1] + ["edit"]))]
    most, link_groups = [], jaccard_join._link_groups

    def spy(sent, threshold):
        most.append(max(r["count"] for r in sent.groupBy("group", "label").count().collect()))
        return link_groups(sent, threshold)

    monkeypatch.setattr(jaccard_join, "_link_groups", spy)
    found = jaccard_join.jaccard_components(documents(spark, rows))
    assert most and max(most) <= 3  # the table has three parts
    expected = link_counts(rows, 4, 85, 100)
    assert rows_of(found, "doc_id", "n_shingles", "n_links") == expected
    assert {r["component_id"] for r in found.collect()} == {1}


def test_linked_sets_share_a_tile():
    draw = np.random.Generator(np.random.PCG64(3))
    for num, den in ((85, 100), (1, 2)):
        bands = jaccard_join.Bands((num, den))
        for _ in range(400):
            size = int(draw.integers(1, 120))
            a = np.unique(draw.integers(0, 1 << 63, size, dtype=np.uint64))
            b = np.setdiff1d(a, draw.choice(a, int(draw.integers(0, 12))))
            b = np.union1d(b, draw.integers(0, 1 << 63, int(draw.integers(0, 12)), dtype=np.uint64))
            shared = len(np.intersect1d(a, b))
            if len(b) and shared * den >= num * (len(a) + len(b) - shared) and len(a) + len(b) > 2 * shared:
                assert np.intersect1d(jaccard_join.tile_hashes(a, bands),
                                      jaccard_join.tile_hashes(b, bands)).size


# Byte-level BPE

@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_encoding_equals_the_library(spark, name):
    path = public_tokenizers.path(name)
    own = byte_bpe.encoder(path, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN,
                                mergeable_ranks=own.vocabulary.ranks, special_tokens={})
    rows = texts() + [(90, "<|endoftext|> it's  \n\n 123456789 " + "a" * 4000 + " " * 300)]
    found = byte_bpe.encode_documents(documents(spark, rows), path, public_tokenizers.PATTERN)
    expected = Counter()
    for i, t in rows:
        ids = np.array(library.encode_ordinary(t or ""), dtype="<u4").tobytes()
        expected[i, len(ids) // 4, sha(ids), sha((t or "").encode()), ids] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"],
                    bytes(r["ids"])) for r in found.collect()) == expected
    back = byte_bpe.decode_documents(found, path, public_tokenizers.PATTERN)
    assert rows_of(back, "doc_id", "text") == Counter((i, t or "") for i, t in rows)


def test_appends_and_edits_equal_encoding_anew():
    vocabulary = byte_bpe.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"),
                                  public_tokenizers.PATTERN).vocabulary
    draw = np.random.Generator(np.random.PCG64(2))
    for _ in range(200):
        letters = [bytes(draw.choice(list(b"thensiorag"), int(draw.integers(0, 12)))) for _ in "abc"]
        grown = byte_bpe.PrefixTable(vocabulary, letters[0])
        grown.append(letters[1])
        assert grown.ids() == byte_bpe.PrefixTable(vocabulary, letters[0] + letters[1]).ids()
        end = len(letters[0]) + len(letters[1]) // 2
        grown.replace(len(letters[0]) // 2, end, letters[2])
        whole = letters[0][: len(letters[0]) // 2] + letters[2] + (letters[0] + letters[1])[end:]
        assert grown.ids() == byte_bpe.PrefixTable(vocabulary, whole).ids()


def test_encoding_of_empty(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    assert byte_bpe.encode_documents(documents(spark, []), path, public_tokenizers.PATTERN).count() == 0
