"""Which drug-cell texts mention which drug names: a hashed posting index.

The condition is "text contains name", ignoring case, with the name read as a regular
expression (Python's ``re.search``) or literally. Instead of testing every name against
every text, texts are indexed once by short letter sequences ("grams"):

- Each distinct text gets an id. Postings (gram hash, text id) are written once, for the
  grams that some name needs; no text travels through an exchange but in the final fetch.
- Every name has runs of letters of which each match holds one (one run per alternative).
  A run's candidates are the postings of its rarest gram; when that gram is heavy (more
  postings than ``HEAVY``), the texts must also hold the run's next-rarest gram, so the
  candidates are the intersection of two posting lists.
- Postings of a gram with more than ``SPLIT`` entries are dealt over several salts by text
  id, and the names asking for that gram go to every salt, so no task holds a whole heavy
  gram.
- Candidates are verified in the JVM: literal names with ``contains`` on lower-cased text,
  patterns with ``rlike`` (flags i, U and d: case, Unicode classes, only ``\\n`` ends a
  line), for the patterns whose syntax reads alike in both engines (``portable``). Other
  valid patterns, rare in drug names, are verified with Python's ``re`` on their candidates.

Runs come from the parse tree of the pattern, so optional parts such as ``(ab)?`` in
``(ab)?c`` do not hide the compulsory ``c``. A pattern that can match the empty string
without anchors matches every text and needs no test. Only patterns without any compulsory
letter, such as ``[0-9]+``, are tested against every text, through a partitioned join.
"""

from __future__ import annotations

import re
import re._parser as _sre  # the standard library's own reader of patterns

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phasewise.session import materialise

# Longest letter sequence used as index; longer ones are rarer but repeat more text.
GRAM = 8
#: Postings beyond which a gram takes a second gram along, and postings a salt holds.
HEAVY = 1 << 14
SPLIT = 1 << 16
#: Rows of a stored table that one task takes.
ROWS = 1 << 20
RUN = ["drug", "portable", "single", "run"]

_SPECIAL = r"[\\.^$*+?{}\[\]|()]"
# Syntax that Python and Java read alike: letters and digits, the usual operators,
# classes without nesting or intersection, counted repeats, escaped punctuation and \d \w \b.
_PORTABLE = re.compile(
    r"(?:[^\\\[\]{}()]|\\[^A-Za-z0-9]|\\[dwDWbB]|\((?!\?)|\(\?:|\)"
    r"|\[\^?(?:[^\]\[\\&]|\\[^A-Za-z0-9]|\\[dwDW])*\]|\{\d+(?:,\d*)?\})*")

_ANALYSIS = T.StructType([
    T.StructField("kind", T.StringType()),  # invalid, every (matches every text), runs, scan
    T.StructField("runs", T.ArrayType(T.StringType())),
    T.StructField("portable", T.BooleanType()),
])


def _runs_of(items) -> list[str] | None:
    """Lower-case literal strings of which every match of ``items`` holds one; None if none."""
    best: list[str] | None = None
    run = ""

    def better(found, held):
        if found is None:
            return held
        if held is None:
            return found
        return found if min(map(len, found)) >= min(map(len, held)) else held

    def close():
        nonlocal run, best
        if run:
            best = better([run], best)
        run = ""

    for op, arg in _flat(items):
        if op is _sre.LITERAL and arg < 128:
            run += chr(arg).lower()
            continue
        close()
        if op in (_sre.MAX_REPEAT, _sre.MIN_REPEAT, _sre.POSSESSIVE_REPEAT) and arg[0] >= 1:
            best = better(_runs_of(arg[2]), best)
        elif op is _sre.BRANCH:
            branches = [_runs_of(branch) for branch in arg[1]]
            if all(b is not None for b in branches):
                best = better(sorted({r for b in branches for r in b}), best)
        elif op is _sre.SUBPATTERN:
            best = better(_runs_of(arg[3]), best)
        elif op is _sre.ATOMIC_GROUP:
            best = better(_runs_of(arg), best)
    close()
    return best


def _flat(items):
    """Items with groups that hold neither alternatives nor flags inlined, so runs cross them."""
    for op, arg in items:
        if op is _sre.SUBPATTERN and not arg[1] and not arg[2] and not any(
                o is _sre.BRANCH for o, _ in arg[3]):
            yield from _flat(arg[3])
        else:
            yield op, arg


def _anchored(items) -> bool:
    """Whether a match depends on its place: anchors, look-arounds or back references."""
    for op, arg in items:
        if op in (_sre.AT, _sre.ASSERT, _sre.ASSERT_NOT, _sre.GROUPREF, _sre.GROUPREF_EXISTS):
            return True
        parts = [arg] if isinstance(arg, _sre.SubPattern) else (
            list(arg) if isinstance(arg, (list, tuple)) else [])
        for part in parts:
            inner = part if isinstance(part, list) else [part]
            if any(isinstance(p, _sre.SubPattern) and _anchored(p) for p in inner):
                return True
    return False


def analyse(pattern: str) -> tuple[str, list[str], bool]:
    """(kind, runs, portable) of a pattern read with ``re.IGNORECASE``."""
    try:
        parsed = _sre.parse(pattern, re.IGNORECASE)
        re.compile(pattern, re.IGNORECASE)
    except (re.error, RecursionError, OverflowError):
        return "invalid", [], False
    portable = _PORTABLE.fullmatch(pattern) is not None
    if parsed.getwidth()[0] == 0 and not _anchored(parsed):
        return "every", [], portable
    runs = _runs_of(parsed)
    return ("runs", runs, portable) if runs else ("scan", [], portable)


def _analysed(name: Column) -> Column:
    @F.pandas_udf(_ANALYSIS)
    def run(names: pd.Series) -> pd.DataFrame:
        rows = [analyse(n) for n in names]
        return pd.DataFrame(rows, columns=["kind", "runs", "portable"])

    return run(name)


def _python_found(name: Column, text: Column) -> Column:
    @F.pandas_udf(T.BooleanType())
    def found(names: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([re.search(n, t, re.IGNORECASE) is not None
                          for n, t in zip(names, texts)], dtype=bool)

    return found(name, text)


def is_special(name: Column) -> Column:
    return F.rlike(name, F.lit(_SPECIAL))


def invalid_names(names: DataFrame) -> DataFrame:
    """Names that are not valid regular expressions and so cannot be matched."""
    special = names.filter(is_special(F.col("drug")))
    return special.filter(_analysed(F.col("drug"))["kind"] == "invalid")


def _grams(text: Column, size: Column) -> Column:
    """The distinct substrings of the given size; empty for shorter texts."""
    last = F.length(text) - size + 1
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, size)))


def match_drugs(names: DataFrame, texts: DataFrame, regex: bool = True) -> DataFrame:
    """Pairs of ``drug`` and ``primary_drugs`` where the text mentions the drug.

    Both inputs hold distinct strings; nulls take no part. Invalid patterns match nothing;
    ``invalid_names`` lists them. The empty name, and patterns that match the empty string
    anywhere, are paired with every text.
    """
    texts = spread(materialise(texts.filter(F.col("primary_drugs").isNotNull()).select(
        F.monotonically_increasing_id().alias("tid"), "primary_drugs"), "match-texts"))
    named = names.filter(F.col("drug").isNotNull()).select("drug")
    special = is_special(F.col("drug")) if regex else F.lit(False)
    plain = named.filter(~special).select(
        "drug", F.when(F.col("drug") == "", "every").otherwise("runs").alias("kind"),
        F.array(F.lower("drug")).alias("runs"), F.lit(True).alias("portable"))
    if regex:
        # Only names with special characters go to Python.
        analysed = named.filter(special).withColumn("a", _analysed(F.col("drug")))
        plain = plain.unionByName(analysed.select("drug", "a.kind", "a.runs", "a.portable"))
    named = materialise(plain, "match-names")

    runs = named.filter("kind = 'runs'").select(
        "drug", "portable", (F.size("runs") == 1).alias("single"), F.explode("runs").alias("run"))
    # Pairs are stored, then dealt out by their number: they pack so well that partitions
    # sized by packed bytes would hold far more of them than a task should sort.
    candidates = materialise(_candidates(runs, texts).unionByName(
        _every_text(named.filter("kind = 'scan'").select("drug", "portable"), texts)),
        "match-candidates")
    tasks = tasks_for(candidates)
    fetched = candidates.repartition(tasks, "tid").join(texts.repartition(tasks, "tid"), "tid")
    literal = F.contains(F.lower("primary_drugs"), F.lower("drug"))
    checked = fetched.filter(~special & literal)
    if regex:
        jvm = F.expr("primary_drugs rlike concat('(?iUd)', drug)")
        checked = fetched.filter(
            F.when(~special, literal).when(F.col("portable"), jvm).otherwise(False)
        ).unionByName(
            candidates.filter(special & ~F.col("portable")).join(texts, "tid")
            .select(*fetched.columns)
            .filter(_python_found(F.col("drug"), F.col("primary_drugs"))))
    every = _paired_with_all(named.filter("kind = 'every'"), texts)
    return checked.select("drug", "primary_drugs").unionByName(every)


def tasks_for(table: DataFrame) -> int:
    """How many tasks take ``ROWS`` rows of a stored table each; no fewer than cores."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return max(cores, -(-table.count() // ROWS))


def spread(table: DataFrame) -> DataFrame:
    """A stored table over as many tasks as its rows need, however small its files are."""
    return table.repartition(tasks_for(table))


def _candidates(runs: DataFrame, texts: DataFrame) -> DataFrame:
    """(drug, portable, tid) of texts that hold the rarest gram of a run, and its next one if
    heavy."""
    size = F.least(F.lit(GRAM), F.length("run"))
    run_grams = runs.select("drug", "portable", "single", "run",
                            F.explode(_grams(F.col("run"), size)).alias("gram"))
    run_grams = run_grams.select(*RUN, F.xxhash64("gram").alias("h")).distinct()
    # Texts are indexed by the sizes that runs shorter than a full gram have, too.
    sizes = sorted({r[0] for r in runs.select(size.alias("n")).distinct().collect()})
    lower = F.lower("primary_drugs")
    all_grams = F.concat(*[_grams(lower, F.lit(n)) for n in sizes]) if sizes else F.array()
    hashes = F.array_distinct(F.transform(all_grams, lambda gram: F.xxhash64(gram)))
    used = run_grams.select("h").distinct()
    postings = materialise(
        texts.select("tid", F.explode(hashes).alias("h")).join(used, "h", "left_semi"),
        "match-postings")
    frequency = postings.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    ranked = (run_grams.join(frequency, "h", "left").fillna(0, ["n"])
              .groupBy(*RUN)
              .agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "h"))), 1, 2).alias("two")))
    first, second = F.col("two")[0], F.get(F.col("two"), 1)
    asked = ranked.select("drug", "portable", "single", first["h"].alias("h"), first["n"].alias("n"),
                          F.when(first["n"] > HEAVY, second["h"]).alias("h2"))
    asked = asked.filter(F.col("n") > 0)
    salts = F.greatest(F.lit(1), F.ceil(F.col("n") / SPLIT)).cast("long")
    asked = asked.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))
    # Grams that need salts are few, at most one per ``SPLIT`` postings; the others have salt 0.
    split = F.broadcast(frequency.filter(F.col("n") > SPLIT))
    salted = postings.join(split, "h", "left").withColumn(
        "salt", F.pmod(F.col("tid"), F.coalesce(F.ceil(F.col("n") / SPLIT), F.lit(1)).cast("long")))
    found = asked.drop("n").join(salted.select("h", "salt", "tid"), ["h", "salt"]).drop("h", "salt")
    alone = found.filter(F.col("h2").isNull()).drop("h2")
    both = (found.filter(F.col("h2").isNotNull())
            .join(postings.withColumnRenamed("h", "h2"), ["h2", "tid"], "left_semi")
            .drop("h2"))
    pairs = alone.unionByName(both)
    # A text can come once per run, so only names with several runs repeat theirs.
    kept = ["drug", "portable", "tid"]
    return pairs.filter("single").select(*kept).unionByName(
        pairs.filter("not single").select(*kept).distinct())


def _every_text(names: DataFrame, texts: DataFrame) -> DataFrame:
    """(drug, portable, tid) for patterns without a compulsory letter: each to all texts.

    Groups are joined apart from each other, one per shuffle partition, so neither side has
    to fit into the memory of a task.
    """
    groups = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copies = names.select("drug", "portable", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"))
    parts = texts.select("tid", F.pmod(F.col("tid"), F.lit(groups)).cast("int").alias("part"))
    return parts.join(copies, "part").select("drug", "portable", "tid")


def _paired_with_all(names: DataFrame, texts: DataFrame) -> DataFrame:
    """Every text with each of ``names``: these names match everywhere."""
    return _every_text(names.select("drug", "portable"), texts).join(texts, "tid").select(
        "drug", "primary_drugs")
