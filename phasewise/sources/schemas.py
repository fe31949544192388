"""Input schemas. Source headers map to snake case by one rule."""

from __future__ import annotations

import re

from pyspark.sql import types as T

# Source headers of the trials table.
TRIAL_HEADERS = [
    "Trial ID",
    "Mechanism of action",
    "Drug class (therapeutic effect)",
    "Drug class (chemical)",
    "Indication",
    "Organisations",
    "Trial Design",
    "Location",
    "Phase of Trial",
    "Subject Age",
    "Planned Subject Number",
    "Trial Centre Details",
    "Lead Centre",
    "Trial Initiation date",
    "Trial End date",
    "Trial Status",
    "Trial History",
    "Diseases treated",
    "Primary Drugs",
]

# Source headers of the drugs table.
DRUG_HEADERS = [
    "Drug ID",
    "Drug Name",
    "CAS Number",
    "Chemical Name",
    "New Molecular Entity",
    "Drug Interactions",
    "Comparative Efficacy",
    "Highest Development Phase",
    "Indication",
    "Molecular Formula",
    "Mechanism Of Action",
    "Organisation",
    "Pharmacodynamic Characteristics",
    "Route Of Administration",
    "Route Of Elimination",
    "Pharmacokinetic Characteristics",
    "Adverse Events",
    "Therapeutic Class (EphMRA)",
    "Therapeutic Class (WHO)",
    "Synonyms/Brand Names",
    "Antimicrobial Activity",
    "Immunogenicity",
    "Last Significant Update Date",
    "Therapeutic Area",
    "Orphan Designation",
    "License Availability",
    "Brands",
    "On Fastrack",
    "Fastrack country",
    "On PRIME",
    "PRIME country",
    "Biomarkers-Inclusion",
    "Biomarkers-Exclusion",
    "Biomarkers-Outcome Measure",
    "Biomarkers-Safety",
    "Biomarkers-not specified",
]


# Cells go through CSV unchanged: quotes doubled, blanks at the ends kept.
CSV_OPTIONS = {
    "header": "true",
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def snake_case(header: str) -> str:
    return re.sub(r"[^0-9a-z]+", "_", header.lower()).strip("_")


def _table_schema(headers: list[str], doubles: set[str]) -> T.StructType:
    names = [snake_case(header) for header in headers]
    return T.StructType(
        [T.StructField(n, T.DoubleType() if n in doubles else T.StringType()) for n in names]
    )


TRIALS = _table_schema(TRIAL_HEADERS, {"planned_subject_number"})
DRUGS = _table_schema(DRUG_HEADERS, set())
