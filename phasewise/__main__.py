"""Command line: extract the features, then fit the models on the stored phase tables."""

from __future__ import annotations

import argparse

from phasewise.constants import CUTOFF_DATE, FOLDS
from phasewise.models.training import TASKS
from phasewise.plans import feature_extraction, sweeps
from phasewise.session import build_session
from phasewise.sources.readers import read_trials


def parse(arguments: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="phasewise", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    extract = commands.add_parser("extract", help="trials to feature tables")
    extract.add_argument("trials")
    extract.add_argument("features", help="folder for the wide table, CSV")
    extract.add_argument("phases", help="folder for the phase tables, Parquet")
    extract.add_argument("--format", default="parquet", help="format of the trials")
    extract.add_argument("--cutoff", default=CUTOFF_DATE)
    fit = commands.add_parser("fit", help="models on stored phase tables")
    fit.add_argument("phases")
    fit.add_argument("scores", help="folder the scores are appended to, Parquet")
    fit.add_argument("--task", choices=list(TASKS), default="pass")
    fit.add_argument("--models", nargs="+", default=["logistic_regression", "random_forest"])
    fit.add_argument("--folds", type=int, default=FOLDS)
    fit.add_argument("--sample-points", type=int, help="search a sample of so many grid points")
    return parser.parse_args(arguments)


def main(arguments: list[str] | None = None) -> None:
    options = parse(arguments)
    spark = build_session()
    if options.command == "extract":
        trials = read_trials(spark, options.trials, options.format)
        feature_extraction.run(trials, options.features, options.phases, cutoff=options.cutoff)
    else:
        sweeps.sweep(
            spark, options.phases, options.task, options.models, score_path=options.scores,
            folds=options.folds, max_points=options.sample_points,
        )


if __name__ == "__main__":
    main()
