"""Fixed values of the analysis: domains, word lists and default parameters."""

# The phase domain, in reporting order.
PHASES = [
    "Phase 0",
    "Phase I",
    "Phase I/II",
    "Phase II",
    "Phase II/III",
    "Phase III",
    "Phase IV",
    "Clinical Phase Unknown",
]

# The phases that get a modelling table of their own.
MODEL_PHASES = ["Phase I", "Phase II", "Phase III"]

# Phase -> the later phase whose subjects prove that it was passed.
NEXT_PHASE = {
    "Phase I": "Phase II",
    "Phase II": "Phase III",
    "Phase I/II": "Phase III",
    "Phase III": "Phase IV",
    "Phase II/III": "Phase IV",
}

# Rare trial states, replaced as substrings in this order.
RARE_STATUSES = [
    "Active, no longer recruiting",
    "Withdrawn prior to enrolment",
    "Recruiting",
    "Suspended",
]
OTHER_STATUS = "Other Trial Status"

# Rare trial designs, replaced as substrings in this order.
RARE_DESIGNS = [
    "case control",
    "survey",
    "epidemiological",
    "cross-sectional",
    "postmarketing surveillance",
    "sequential",
    "single-blind",
]
OTHER_DESIGN = "Other Design Status"

# Month names accepted in free-text dates, and their numbers.
MONTHS = {
    "jan": 1, "january": 1,
    "feb": 2, "february": 2,
    "mar": 3, "march": 3,
    "apr": 4, "april": 4,
    "may": 5,
    "jun": 6, "june": 6,
    "jul": 7, "july": 7,
    "aug": 8, "august": 8,
    "sep": 9, "sept": 9, "september": 9,
    "oct": 10, "october": 10,
    "nov": 11, "november": 11,
    "dec": 12, "december": 12,
}

# Default parameters.
CUTOFF_DATE = "2019-01-01"
FUZZY_THRESHOLD = 50
TIME_BIN_EDGES = (547.5, 1095.0)
SPLIT_SEED = 42
TEST_SHARE = 0.2
FOLDS = 6
LENGTH_BINS = 50
ORGANISATION_BINS = 10
PROBABILITY_FLOOR = 1e-15
DEVELOPMENT_COST_BILLIONS = 2.6

# Suffixes of the wide feature columns.
SUBJECT_MEAN = "subject mean"
TRIAL_LENGTH = "trial length"
CENTER_COUNT = "center count"
PASS = "Pass"
ORGANISATION_COUNT = "Number of Organizations"

# Patterns of the columns that give the label away.
LEAKY_FOR_PASS = "Completed|Discontinued|Other Trial Status"
LEAKY_FOR_TIME = "Completed|Discontinued|Other Trial Status|Pass"
