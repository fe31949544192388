"""Small literal frames."""

from phasewise.sources.readers import conform
from phasewise.sources.schemas import TRIALS


def trials(spark, rows):
    """Trials from dicts; columns that a row does not name are null."""
    names = sorted({name for row in rows for name in row})
    schema = ", ".join(
        f"{n} {'double' if n == 'planned_subject_number' else 'string'}" for n in names
    )
    data = [tuple(row.get(n) for n in names) for row in rows]
    return conform(spark.createDataFrame(data, schema), TRIALS)


def trial(drugs, phase, start="01 Jan 2010", end="01 Jan 2011", **more):
    return {
        "primary_drugs": drugs, "phase_of_trial": phase, "trial_initiation_date": start,
        "trial_end_date": end, **more,
    }


def by_drug(df):
    return {row["drug"]: row.asDict() for row in df.collect()}
