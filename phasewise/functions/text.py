"""Text clean-up as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from phasewise.constants import OTHER_DESIGN, OTHER_STATUS, RARE_DESIGNS, RARE_STATUSES

# The characters that count as white space.
WHITE_SPACE = (
    " \t\n\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Remove white space of every kind at both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def replace_each(text: Column, terms: Iterable[str], replacement: str) -> Column:
    """Replace each term wherever it occurs, one after the other."""
    for term in terms:
        text = F.replace(text, F.lit(term), F.lit(replacement))
    return text


def collapse_status(status: Column) -> Column:
    return replace_each(status, RARE_STATUSES, OTHER_STATUS)


def collapse_design(design: Column) -> Column:
    return replace_each(design, RARE_DESIGNS, OTHER_DESIGN)


def phase_label(phase: Column, value: Column) -> Column:
    """``"<phase> <value>"``; null as soon as either side is null."""
    return F.concat(phase, F.lit(" "), value)


def base_name(drug_name: Column) -> Column:
    """The part of a drug name before its first dash."""
    return F.substring_index(drug_name, "-", 1)


def drug_tokens(primary_drugs: Column) -> Column:
    """The drugs of one trial, stripped; repeats and empty names are kept."""
    return F.transform(F.split(primary_drugs, ","), strip)


def design_tokens(trial_design: Column) -> Column:
    """The designs of one trial, rare ones collapsed; a lone design is not stripped."""
    parts = F.split(trial_design, ",")
    stripped = F.when(F.array_size(parts) > 1, F.transform(parts, strip)).otherwise(parts)
    return F.transform(stripped, collapse_design)


def count_parts(cell: Column) -> Column:
    """Number of ``;``-separated parts; a null cell has no count, an empty one counts 1."""
    return F.when(cell.isNotNull(), F.array_size(F.split(cell, ";")))


def occurrences(items: Column, value: str) -> Column:
    """How often an array holds a value; null for a null array."""
    return F.array_size(items) - F.array_size(F.array_remove(items, value))
