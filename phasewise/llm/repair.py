"""Conversation structure repair: weighted CYK parsing over spans of turns.

A conversation is repaired into the shape ``(s?(ua)+)?`` of role initials: an optional system
turn, then pairs of user and assistant turns, or nothing. The edits and their costs:

- keep a row (0), rerole it to user or assistant (3), delete it (4);
- insert an empty user or assistant row anywhere (3);
- a row that stays (kept or rerolled) and is truncated adds 3;
- a blank or duplicate row must be deleted.

The repair grammar is in Chomsky normal form over the automaton of the target shape: its
nonterminals are pairs of states ``(p, q)``, a row derives ``(p, q)`` by one edit that moves the
automaton from p to q, and ``(p, q) -> (p, r) (r, q)``. A cell of the CYK table holds, for each
nonterminal, the least (cost, audit) of its span; audits are the edits' initials (D, I, K, R)
in order, and equal costs go to the ASCII-least audit. Inserted rows derive the empty span, so
every cell is closed under insertions on both sides. Cells are combined bottom-up by span
length. Audits of equal cost are never prefixes of one another (the longer one would hold
more insertions, each costing 3), so the least audit of a span is part of the least of every
span around it and the table is exact.

Every nonterminal is a pair of states, so a span's cell does not depend on where the span was
split. That lets a conversation of any length be cut: rows are parsed by full CYK in blocks of
``BLOCK`` consecutive rows, and the cells of whole blocks are combined in order, ``FAN_IN`` at a
time, level by level, so no group holds more than ``max(BLOCK, FAN_IN)`` rows of one
conversation. The damage, the faults, the counts and the rendering of the repaired text are
DataFrame operations; only the cells are computed in Python.
"""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phasewise.llm.staging import stage

# Fixed values of the repair contract: edit costs, damage codes and the target shape.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
DAMAGE_MODULUS = 20
DROP, EMPTY, UNPUNCTUATE, REPEAT, MAKE_USER = 0, 1, 2, 3, 4
BLANKS = "[\\x20\\x09-\\x0D]"
ENDS = "[.!?]"
LEGAL_PAIRS = ("su", "ua", "au")

#: Rows parsed by full CYK at a time, and cells of blocks combined at a time.
BLOCK = 8
FAN_IN = 64
#: Rows handed to one Python call, about.
BUCKET_ROWS = 4096

# Automaton of (s?(ua)+)?: 0 start, 1 after system, 2 after user, 3 after assistant.
_STATES = 4
_STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_ACCEPTING = (0, 3)

Cell = list  # 16 entries (p * 4 + q) of (cost, audit) or None


def _join(left: Cell, right: Cell) -> Cell:
    """Cell of a span made of two adjacent spans: (p, q) -> (p, r) (r, q), least kept."""
    out: Cell = [None] * 16
    for pr, a in enumerate(left):
        if a is None:
            continue
        p4, r4 = pr - pr % 4, (pr % 4) * 4
        for q in range(_STATES):
            b = right[r4 + q]
            if b is None:
                continue
            c = (a[0] + b[0], a[1] + b[1])
            k = p4 + q
            if out[k] is None or c < out[k]:
                out[k] = c
    return out


def _least(x: Cell, y: Cell) -> Cell:
    return [b if a is None or (b is not None and b < a) else a for a, b in zip(x, y)]


def _insertions() -> Cell:
    """Cell of the empty span: inserted user and assistant rows only."""
    step: Cell = [None] * 16
    for (p, role), q in _STEP.items():
        if role in "ua":
            step[p * 4 + q] = (INSERT, "I")
    cell: Cell = [(0, "") if p == q else None for p in range(_STATES) for q in range(_STATES)]
    while True:
        wider = _least(cell, _join(cell, step))
        if wider == cell:
            return cell
        cell = wider


_EMPTY = _insertions()


@functools.lru_cache(maxsize=None)
def _row_cell(initial: str, fault: str) -> tuple:
    return tuple(_row(initial, fault))


def _row(initial: str, fault: str) -> Cell:
    """Cell of one row, closed under insertions on both sides.

    ``fault`` is ``b`` (blank), ``d`` (duplicate), ``t`` (truncated) or empty.
    """
    edits: Cell = [None] * 16
    for p in range(_STATES):
        edits[p * 4 + p] = (DELETE, "D")
    if fault not in ("b", "d"):
        extra = TRUNCATED if fault == "t" else 0
        for p in range(_STATES):
            if (p, initial) in _STEP:
                edits = _least(edits, _one(p, _STEP[p, initial], (KEEP + extra, "K")))
            for role in "ua":
                if (p, role) in _STEP:
                    edits = _least(edits, _one(p, _STEP[p, role], (REROLE + extra, "R")))
    return _join(_join(_EMPTY, edits), _EMPTY)


def _one(p: int, q: int, value: tuple) -> Cell:
    cell: Cell = [None] * 16
    cell[p * 4 + q] = value
    return cell


def parse(rows: list[tuple[str, str]]) -> Cell:
    """CYK over ``rows`` (role initial, fault): the cell of the whole span.

    No rows give the cell of the empty span. Bottom-up by span length; every split of a span
    is tried.
    """
    n = len(rows)
    if n == 0:
        return list(_EMPTY)
    table = {(i, i + 1): list(_row_cell(*rows[i])) for i in range(n)}
    for length in range(2, n + 1):
        for i in range(0, n - length + 1):
            j = i + length
            best: Cell = [None] * 16
            for k in range(i + 1, j):
                best = _least(best, _join(table[i, k], table[k, j]))
            table[i, j] = best
    return table[0, n]


def combine(cells: list[Cell]) -> Cell:
    """Cells of adjacent spans, in order, as the cell of their union."""
    out = list(_EMPTY)
    for cell in cells:
        out = _join(out, cell)
    return out


def finish(cell: Cell) -> tuple[int, str]:
    """Least (cost, audit) from the start to an accepting state."""
    return min(cell[0 * 4 + q] for q in _ACCEPTING if cell[q] is not None)


_CELL_SCHEMA = "ck string, block long, costs array<long>, audits array<string>"


def _cells_out(ck, block, cell: Cell) -> dict:
    return {"ck": ck, "block": block, "costs": [None if c is None else c[0] for c in cell],
            "audits": [None if c is None else c[1] for c in cell]}


def _cells_in(costs, audits) -> Cell:
    return [None if c is None or pd.isna(c) else (int(c), a) for c, a in zip(costs, audits)]


def _runs(frame: pd.DataFrame, keys: list[str], order: str):
    """(key values, row numbers) of each group of ``frame`` by ``keys``, rows in ``order``."""
    frame = frame.sort_values([*keys, order], kind="stable").reset_index(drop=True)
    values = list(zip(*(frame[k].tolist() for k in keys)))
    begin = 0
    for end in range(1, len(values) + 1):
        if end == len(values) or values[end] != values[begin]:
            yield frame, values[begin], range(begin, end)
            begin = end


def _parse_blocks(bucket: pd.DataFrame) -> pd.DataFrame:
    """The cell of every block in a bucket of blocks."""
    out = []
    for frame, (ck, block), rows in _runs(bucket, ["ck", "block"], "pos"):
        initials, faults = frame["initial"], frame["fault"]
        out.append(_cells_out(ck, int(block), parse([(initials[i], faults[i]) for i in rows])))
    return pd.DataFrame(out, columns=["ck", "block", "costs", "audits"])


def _combine_blocks(bucket: pd.DataFrame) -> pd.DataFrame:
    """Cells of up to FAN_IN consecutive blocks combined, for every group in a bucket."""
    out = []
    for frame, (ck, group), rows in _runs(bucket, ["ck", "group"], "block"):
        costs, audits = frame["costs"], frame["audits"]
        cells = [_cells_in(costs[i], audits[i]) for i in rows]
        out.append(_cells_out(ck, int(group), combine(cells)))
    return pd.DataFrame(out, columns=["ck", "block", "costs", "audits"])


def _key() -> Column:
    """conv_id as text; the empty text stands for null, which no id prints as."""
    return F.coalesce(F.col("conv_id").cast("string"), F.lit(""))


def damage(conversations: DataFrame) -> DataFrame:
    """Rows after damage, with ``ck`` (conv_id as text), ``copy`` and ``initial``.

    Nulls are one space: in the key ``conv_id:turn``, in role and in text. The code
    crc32(key) % 20 drops a row (0), empties its text (1), removes its ``[.!?]`` (2), repeats
    it with the same turn (3) or makes its role user (4).
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), space))
    code = F.pmod(F.crc32(key.cast("binary")), F.lit(DAMAGE_MODULUS))
    text = F.coalesce(F.col("text"), space)
    role = F.coalesce(F.col("role"), space)
    rows = conversations.select(
        _key().alias("ck"), F.col("turn").cast("long").alias("turn"),
        role.alias("role"), text.alias("text"), code.alias("code"))
    return (rows.filter(F.col("code") != DROP)
            .withColumn("copy", F.explode(F.when(F.col("code") == REPEAT, F.array(F.lit(0), F.lit(1)))
                                          .otherwise(F.array(F.lit(0)))))
            .withColumn("text", F.when(F.col("code") == EMPTY, F.lit(""))
                        .when(F.col("code") == UNPUNCTUATE, F.regexp_replace("text", ENDS, ""))
                        .otherwise(F.col("text")))
            .withColumn("role", F.when(F.col("code") == MAKE_USER, F.lit("user"))
                        .otherwise(F.col("role")))
            .withColumn("initial", F.substring("role", 1, 1))
            .drop("code"))


def faults(damaged: DataFrame) -> DataFrame:
    """Rows in order (``pos`` from 0 by turn, nulls first, then role, text) with their fault.

    A row's first fault counts: ``b`` blank (no character outside ``[\\x20\\x09-\\x0D]``), ``d``
    duplicate (role and text equal to an earlier row's), ``t`` truncated (its last such
    character is not ``[.!?]``); empty for none. ``legal`` says whether the role initials of
    the row before and this one are su, ua or au (null for the first row).
    """
    order = Window.partitionBy("ck").orderBy(F.col("turn").asc_nulls_first(), "role", "text", "copy")
    same = Window.partitionBy("ck", "role", "text").orderBy(F.col("turn").asc_nulls_first(), "copy")
    blank = ~F.col("text").rlike(f"[^{BLANKS[1:-1]}]")
    last = F.regexp_extract("text", f"([^{BLANKS[1:-1]}]){BLANKS}*$", 1)
    return (damaged
            .withColumn("pos", F.row_number().over(order) - 1)
            .withColumn("seen", F.row_number().over(same) > 1)
            .withColumn("fault", F.when(blank, "b").when(F.col("seen"), "d")
                        .when(~last.rlike(f"^{ENDS}$"), "t").otherwise(""))
            .withColumn("legal", F.concat(F.lag("initial").over(order), F.col("initial"))
                        .isin(*LEGAL_PAIRS))
            .drop("seen"))


def _counts(rows: DataFrame) -> DataFrame:
    turns = F.count_distinct("turn")
    span = F.max("turn") - F.min("turn") + 1 - turns
    return rows.groupBy("ck").agg(
        F.coalesce(span, F.lit(0)).cast("long").alias("gaps"),
        F.count(F.when(F.col("fault") == "b", 1)).cast("long").alias("blank"),
        F.count(F.when(F.col("fault") == "d", 1)).cast("long").alias("duplicate"),
        F.count(F.when(F.col("fault") == "t", 1)).cast("long").alias("truncated"),
        F.count(F.when(~F.col("legal"), 1)).cast("long").alias("illegal"))


def least_repairs(rows: DataFrame) -> DataFrame:
    """Per conversation with rows (``ck``): least ``cost`` and its ``audit``.

    Blocks of ``BLOCK`` rows are parsed, then their cells are combined ``FAN_IN`` at a time
    until one is left per conversation; every level is staged, so a lost executor repeats
    one level only. Python is called once per bucket of about ``BUCKET_ROWS`` rows: buckets
    are hashes of (conversation, block), so the blocks of a long conversation spread.
    """
    blocked = rows.select("ck", F.floor(F.col("pos") / BLOCK).cast("long").alias("block"),
                          "pos", "initial", "fault")
    n_rows = rows.count()
    bucket = F.pmod(F.xxhash64("ck", "block"), F.lit(max(1, n_rows // BUCKET_ROWS)))
    cells = stage(blocked.groupBy(bucket.alias("bucket")).applyInPandas(
        _parse_blocks, _CELL_SCHEMA), "repair-cells")
    most = cells.agg(F.max("block")).first()[0] or 0
    while most > 0:
        grouped = cells.withColumn("group", F.floor(F.col("block") / FAN_IN))
        bucket = F.pmod(F.xxhash64("ck", "group"),
                        F.lit(max(1, n_rows // (BLOCK * BUCKET_ROWS))))
        cells = stage(grouped.groupBy(bucket.alias("bucket")).applyInPandas(
            _combine_blocks, _CELL_SCHEMA), "repair-cells")
        most //= FAN_IN

    def at(k: int, name: str) -> Column:
        return F.col(name)[k]

    ends = [F.struct(at(q, "costs").alias("cost"), at(q, "audits").alias("audit"))
            for q in _ACCEPTING]
    # Block 0 of each conversation now holds the whole conversation (a single block too).
    single = cells.select("ck", F.array(*[
        F.when(e["cost"].isNotNull(), e) for e in ends]).alias("ends"))
    best = F.array_min(F.filter("ends", lambda e: e.isNotNull()))
    return single.select("ck", best["cost"].alias("cost"), best["audit"].alias("audit"))


def _rendered(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """Repaired ``role:text`` lines per conversation from its audit, and their digest.

    The j-th audit letter that is not I edits row j; D drops it, K keeps its role, R and I
    take the role that the shape asks for at their place: after a first system row user comes
    at odd places, else at even ones. Inserted rows have empty text.
    """
    letters = repairs.filter(F.length("audit") > 0).select(
        "ck", F.posexplode(F.split("audit", "")).alias("i", "letter"))
    upto = Window.partitionBy("ck").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    letters = (letters
               .withColumn("pos", F.col("i") - F.sum((F.col("letter") == "I").cast("long")).over(upto))
               .withColumn("t", F.sum((F.col("letter") != "D").cast("long")).over(upto) - 1)
               .filter(F.col("letter") != "D"))
    joined = letters.join(rows.select("ck", "pos", "role", "text"), ["ck", "pos"], "left")
    first_system = (F.col("letter") == "K") & (F.col("t") == 0) & (F.col("role").startswith("s"))
    has_system = F.max(first_system.cast("int")).over(Window.partitionBy("ck"))
    shaped = F.when(F.pmod(F.col("t") + has_system, F.lit(2)) == 0, "user").otherwise("assistant")
    line = F.concat(F.when(F.col("letter") == "K", F.col("role")).otherwise(shaped), F.lit(":"),
                    F.when(F.col("letter") == "I", F.lit("")).otherwise(F.col("text")))
    lines = joined.select("ck", "t", line.alias("line"))
    return lines.groupBy("ck").agg(F.sha2(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("t", "line"))), lambda x: x["line"]), "\n"),
        256).alias("repaired_sha256"))


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """Per original conv_id (null ones as one group): faults, least repair and its digest.

    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost (longs), audit,
    repaired_sha256. Reads conv_id, turn, role and text; other columns, however named, are
    not read. Repeated rows are separate rows (the later one a duplicate); rows of equal turn
    are ordered by role and text. A conversation without rows after damage has zeros, an
    empty audit and the digest of the empty string; an empty table gives no rows. Texts of any
    length are parsed by their fault only; their length matters for the digest alone.
    """
    rows = stage(faults(damage(conversations)), "repair-rows")
    repairs = least_repairs(rows)
    out = (conversations.select(_key().alias("ck")).distinct()
           .join(_counts(rows), "ck", "left")
           .join(repairs, "ck", "left")
           .join(_rendered(rows, repairs), "ck", "left"))
    zero = F.lit(0).cast("long")
    return out.select(
        F.when(F.col("ck") != "", F.col("ck").cast("long")).alias("conv_id"),
        *[F.coalesce(name, zero).alias(name) for name in
          ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
