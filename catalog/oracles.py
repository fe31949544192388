"""The same results in plain SQL for another engine, over the same test tables."""

from __future__ import annotations

from catalog.fixtures import CUTOFF, DESIGNS, STATUSES
from phasewise.models.training import CLASSIFIERS, REGRESSORS
from phasewise.constants import (
    MODEL_PHASES,
    NEXT_PHASE,
    ORGANISATION_COUNT,
    PHASES,
    RARE_DESIGNS,
    RARE_STATUSES,
)

_FORMATS = "['%d %b %Y', '%d %B %Y', '%b %Y', '%B %Y', '%Y']"


def _replaced(column: str, terms: list[str], other: str) -> str:
    for term in terms:
        column = f"replace({column}, '{term}', '{other}')"
    return column


def _date(column: str) -> str:
    run = rf"trim(regexp_extract({column}, '^[\d\s\w]*'))"
    return f"try_strptime({run}, {_FORMATS})::date"


STATUS = _replaced("trial_status", RARE_STATUSES, "Other Trial Status")
DESIGN = _replaced("raw_design", RARE_DESIGNS, "Other Design Status")

# The trials, as a star of orders with parts and suppliers; see FIXTURES.md.
_TRIALS = """
li as (select distinct l_orderkey k, l_partkey, l_suppkey from lineitem),
agg as (select k, string_agg('drug '||l_partkey, ', ' order by 'drug '||l_partkey) drugs, string_agg(p_name, ', ' order by p_name) orgs, string_agg('c'||l_suppkey||'|x', ';' order by 'c'||l_suppkey||'|x') centres from li join part on l_partkey=p_partkey group by k),
des as (select k, string_agg(d, ', ' order by d) design from (select distinct k, case p_type when 'ECONOMY' then 'randomised' when 'LARGE' then 'open' when 'MEDIUM' then 'case control' when 'PROMO' then 'double-blind' when 'SMALL' then 'sequential' else 'multicentre' end d from li join part on l_partkey=p_partkey) q group by k),
sh as (select l_orderkey k, max(l_shipdate) e, sum(l_quantity) n from lineitem group by l_orderkey),
trials as (select o_orderkey trial_id, drugs primary_drugs,
 case when o_orderkey%40<8 then 'Phase I' when o_orderkey%40<20 then 'Phase II' when o_orderkey%40<26 then 'Phase III' when o_orderkey%40<29 then 'Phase IV' when o_orderkey%40<33 then 'Phase I/II' when o_orderkey%40<35 then 'Phase II/III' when o_orderkey%40<37 then 'Phase 0' else 'Clinical Phase Unknown' end phase_of_trial,
 case when o_orderkey%13=0 then '' when o_orderkey%7=0 then strftime(o_orderdate, '%b %Y') when o_orderkey%5=0 then strftime(o_orderdate, '%Y') else strftime(o_orderdate, '%d %b %Y') end || case when o_orderkey%11=0 then ' (planned)' else ' - first' end trial_initiation_date,
 strftime(e, '%d %b %Y') || case when o_orderkey%29=0 then ' (planned)' else '' end trial_end_date,
 case when o_orderkey%3=0 then null when o_orderkey%19=0 then 0 else n end planned_subject_number,
 case when o_orderkey%17=0 then null else centres end trial_centre_details, case when o_orderkey%31=0 then null else orgs end organisations,
 case when o_orderkey%23=0 then null else design end trial_design,
 case when o_orderkey%37=0 then 'Suspended' when o_orderkey%41=0 then 'Active, no longer recruiting' when o_orderkey%43=0 then 'Withdrawn prior to enrolment' when o_orderstatus='F' then 'Completed' when o_orderstatus='P' then 'Discontinued' else 'Recruiting' end trial_status
from orders left join agg on agg.k=o_orderkey left join des on des.k=o_orderkey left join sh on sh.k=o_orderkey),
"""

_CLEAN = f"""
settled as (select *, {_date('trial_initiation_date')} trial_start, {_date('trial_end_date')} trial_end
 from trials where primary_drugs is not null and not contains(trial_initiation_date, 'planned') and not contains(trial_end_date, 'planned')),
clean as (select *, datediff('day', trial_start, trial_end) time_diff from settled
 where trial_start < date '{CUTOFF}' and trial_end < date '{CUTOFF}'),
exploded as (select *, phase_of_trial phase, len(string_split(trial_centre_details, ';')) centers, {STATUS} status
 from (select *, trim(unnest(string_split(primary_drugs, ','))) drug from clean) q),
"""

_LONG = """
long as (select drug, phase, count(*) n, avg(planned_subject_number) subject_mean,
  floor(avg(case when time_diff > 0 then time_diff end))::double trial_length,
  (coalesce(sum(centers), 0) + (count(*) - count(centers)) * (select avg(centers) from exploded)) / count(*) center_count
 from exploded group by drug, phase),
"""


def _cells(value: str, suffix: str) -> list[tuple[str, str]]:
    """(name, expression) per phase over ``long``, absent phases zero."""
    cells = []
    for phase in PHASES:
        here = f"filter (where phase = '{phase}')"
        if value == "trial_length":
            cell = f"coalesce(max({value}) {here}, 0.0::double)"
        else:
            cell = f"case when count(*) {here} = 0 then 0.0::double else max({value}) {here} end"
        cells.append((f"{phase} {suffix}" if suffix else phase, cell))
    return cells


_WIDE_CELLS = [
    *_cells("subject_mean", "subject mean"),
    *_cells("trial_length", "trial length"),
    *_cells("center_count", "center count"),
]
_WIDE_NAMES = [name for name, _ in _WIDE_CELLS]


def _flag(phase: str, suffix: str = " subject mean") -> str:
    subjects = f'"{NEXT_PHASE[phase]}{suffix}"'
    return f'({subjects} is null or {subjects} <> 0) "{phase} Pass"'


_FLAG_NAMES = [f"{phase} Pass" for phase in NEXT_PHASE]

_WIDE = f"""
plain as (select drug, {', '.join(f'{cell} "{name}"' for name, cell in _WIDE_CELLS)} from long group by drug),
wide as (select *, {', '.join(_flag(phase) for phase in NEXT_PHASE)} from plain),
"""

_COUNTS = f"""
designs as (select trial_id, drug, phase, {DESIGN} design from (
  select trial_id, drug, phase, unnest(list_transform(string_split(trial_design, ','), lambda d: case when contains(trial_design, ',') then trim(d) else d end)) raw_design from exploded) q),
statuswide as (select drug, {', '.join(f'''count(*) filter (where phase = '{p}' and status = '{s}') "{p} {s}"''' for p in PHASES for s in STATUSES)} from exploded where status is not null group by drug),
designwide as (select drug, {', '.join(f'''count(*) filter (where phase = '{p}' and design = '{d}') "{p} {d}"''' for p in PHASES for d in DESIGNS)} from designs group by drug),
"""

_ORGS = """
cells as (select distinct organisations cell from trials where organisations is not null),
names as (select cell, unnest(string_split(cell, ',')) name, generate_subscripts(string_split(cell, ','), 1) k from cells),
pairs as (select distinct a.name x, b.name y from names a join names b on a.cell = b.cell and a.k < b.k),
lcs as (select x, y, list_reduce(
   list_transform(range(1, length(x) + 1), lambda i: [i]),
   lambda prev, i: list_reduce(
     list_transform(range(1, length(y) + 1), lambda j: [j]),
     lambda line, j: list_append(line, case when x[i[1]] = y[j[1]] then prev[j[1]] + 1 else greatest(prev[j[1] + 1], line[j[1]]) end),
     [0::bigint]),
   list_resize([0::bigint], length(y) + 1, 0))[length(y) + 1] common from pairs),
alike as (select x, y from lcs where x = y or round_even(200.0 * common / (length(x) + length(y)), 0) > 50),
dropped as (select distinct b.cell, b.k from names a join names b on a.cell = b.cell and a.k < b.k join alike on a.name = x and b.name = y),
kept as (select names.cell, string_agg(trim(name), '|' order by names.k) orgs, count(*) n
 from names left join dropped on names.cell = dropped.cell and names.k = dropped.k where dropped.k is null group by names.cell),
orgmax as (select drug, max(coalesce(kept.n, 0)) orgs from exploded left join kept on organisations = cell group by drug),
"""

_FEATURES = f"""
features as (select wide.*, statuswide.* exclude (drug), orgs "{ORGANISATION_COUNT}", designwide.* exclude (drug)
 from wide left join statuswide on wide.drug = statuswide.drug left join orgmax on wide.drug = orgmax.drug
 left join designwide on wide.drug = designwide.drug),
"""

_STATUS_NAMES = [f"{p} {s}" for p in PHASES for s in STATUSES]
_DESIGN_NAMES = [f"{p} {d}" for p in PHASES for d in DESIGNS]

_ALL = _TRIALS + _CLEAN + _LONG + _WIDE + _COUNTS + _ORGS + _FEATURES


def _sql(body: str, extra: str = "", parts: str = _ALL) -> str:
    ctes = (parts + extra).strip().rstrip(",")
    return f"with {ctes}\n{body}"


def _columns(names: list[str], rounded: bool = True) -> str:
    return ", ".join(f'round("{n}", 6) "{n}"' if rounded else f'"{n}"' for n in names)


_FEATURE_LIST = (
    f"drug, {_columns(_WIDE_NAMES)}, {_columns(_FLAG_NAMES, False)}, "
    f'{_columns(_STATUS_NAMES, False)}, "{ORGANISATION_COUNT}", {_columns(_DESIGN_NAMES, False)}'
)


def _phase_columns(phase: str) -> tuple[list[str], list[str]]:
    """Columns of a phase table: those to round, and the others."""
    prefix = f"{phase} "
    rounded = [n for n in _WIDE_NAMES if n.startswith(prefix)]
    others = [n for n in _FLAG_NAMES + _STATUS_NAMES + _DESIGN_NAMES if n.startswith(prefix)]
    return rounded, others + [ORGANISATION_COUNT]


def _phase_sql(phase: str) -> str:
    rounded, others = _phase_columns(phase)
    return _sql(f"select drug, {_columns(rounded)}, {_columns(others, False)} from features")


def _matrix_names(kind: str, phase: str) -> list[str]:
    """Feature columns of a model input, still with the phase in their names."""
    rounded, others = _phase_columns(phase)
    gone = {
        "pass": [f"{phase} Pass"] + [f"{phase} {s}" for s in STATUSES],
        "time": [f"{phase} Pass", f"{phase} trial length"] + [f"{phase} {s}" for s in STATUSES],
        "length": [f"{phase} Pass", f"{phase} trial length"],
    }[kind]
    return [n for n in rounded + others if n not in gone]


def _short(phase: str, names: list[str]) -> list[str]:
    return [n.removeprefix(f"{phase} ") for n in names]


def _matrix(kind: str, phase: str) -> str:
    """CTE ``matrix``: the model input of a phase, all doubles, nulls zero, short names."""
    length = f"{phase} trial length"
    if kind == "pass":
        label = f'"{phase} Pass"::int::double'
    elif kind == "time":
        label = f'(case when "{length}" < 547.5 then 0 when "{length}" < 1095 then 1 else 2 end)::double'
    else:
        label = f'coalesce("{length}", 0)::double'
    names = _matrix_names(kind, phase)
    cells = ", ".join(
        f'coalesce("{n}", 0)::double "{short}"' for n, short in zip(names, _short(phase, names)))
    return f"matrix as (select drug, {cells}, {label} as label from features),"


def _short_phase_sql(phase: str) -> str:
    """A phase table with names that don't hold the phase."""
    rounded, others = _phase_columns(phase)
    cells = [f'round("{n}", 6) "{s}"' for n, s in zip(rounded, _short(phase, rounded))]
    cells += [f'"{n}" "{s}"' for n, s in zip(others, _short(phase, others))]
    return _sql(f"select drug, {', '.join(cells)} from features")


def _each_phase(sql_of) -> str:
    """The same query for every modelled phase, with the phase as a column."""
    return " union all by name ".join(
        f"select '{phase}' as phase, * from ({sql_of(phase)}) of_phase" for phase in MODEL_PHASES)


def _on_matrix(kind: str, body: str, more: str = "") -> str:
    return _each_phase(lambda phase: _sql(body, _matrix(kind, phase) + more))


def _matrix_sql(kind: str) -> str:
    def one(phase: str) -> str:
        names = _short(phase, _matrix_names(kind, phase))
        return _sql(f"select drug, {_columns(names)}, round(label, 6) as label from matrix",
                    _matrix(kind, phase))

    return _each_phase(one)


def _scaled_sql(phase: str) -> str:
    cells = ", ".join(
        f"""round(("{c}" - avg("{c}") over ()) / case when stddev_pop("{c}") over () > 0
          then stddev_pop("{c}") over () else 1 end, 6) "{c}" """
        for c in _short(phase, _matrix_names("pass", phase)))
    return _sql(f"select drug, {cells}, label from matrix", _matrix("pass", phase))


_SPLIT = """
hashed as (select *, md5('42|' || drug) h, row_number() over (order by md5('42|' || drug)) r, count(*) over () c from matrix),
split as (select *, case when r <= ceil(0.2::double * c) then 'test' else 'train' end split from hashed),
"""


def _split_sql(kind: str, body: str) -> str:
    return _on_matrix(kind, body, _SPLIT)


_CLIP = "greatest(least({}, 1 - 1e-15::double), 1e-15::double)"
_NAIVE_CONFIDENCE = f"select round(exp(avg(ln({_CLIP.format('case when label = 1 then m else 1 - m end')}))), 6) naive_confidence from split, (select avg(label) m from split where split = 'train') q where split = 'test'"

# Scores that a fitted model of the pass task is logged with.
_PASS_METRICS = ["accuracy", "precision", "recall", "f1", "confidence", "naive_accuracy",
                 "naive_confidence", "cv_score"]
_NAIVE_ACCURACY = ("select round(avg((label = (select round_even(avg(label), 0) from split "
                   "where split = 'train'))::int), 6) naive_accuracy from split where split = 'test'")


def _model_sql() -> dict[str, str]:
    """What is known of fitted models: the rows predicted and the kinds of values."""
    found = {}
    for task, models in (("pass", CLASSIFIERS), ("time", CLASSIFIERS), ("length", REGRESSORS)):
        extra = "" if task == "length" else ", true a_probability_per_class, true sums_to_one"
        for model in models:
            found[f"fit_{model}_{task}"] = _sql(
                f"select drug, label, true predicted{extra} from split where split = 'test'",
                _matrix(task, "Phase I") + _SPLIT)
    found["odds_coefficients"] = _sql(
        "select distinct feature, true positive from (unpivot (select * exclude (drug, label) "
        "from matrix) on columns(*) into name short value v) q, (select unnest("
        + str(_matrix_names("pass", "Phase I")) + ") feature) f where "
        "feature = short or feature = 'Phase I ' || short", _matrix("pass", "Phase I"))
    found["grid_search_lr"] = _sql(
        f"""select 'pass' task, 'logistic_regression' model, metric,
          case metric when 'naive_accuracy' then ({_NAIVE_ACCURACY})
            when 'naive_confidence' then ({_NAIVE_CONFIDENCE}) end as value, true in_range
          from (select unnest({_PASS_METRICS}) metric) m""", _matrix("pass", "Phase I") + _SPLIT)
    found["model_sweep"] = f"""select phase, 'pass' task, model, metric, 0 points_left_out, true in_range
      from (select unnest({MODEL_PHASES}) phase) p,
      (select unnest(['gaussian_naive_bayes', 'multinomial_naive_bayes']) model) m,
      (select unnest({_PASS_METRICS}) metric) x"""
    return found


_BINARY = """
predictions as (select doc_id id, quality as label, (n_chars > 500)::int prediction, (doc_id % 100 + 0.5::double) / 100 p1
 from documents join labels using (doc_id)),
"""
_TERNARY = """
raw as (select o_orderkey id, o_custkey % 3 as label, o_orderkey % 3 prediction, (o_orderkey % 5)::double k from orders),
predictions as (select *, [(1 + k) / (10 + k), 4 / (10 + k), 5 / (10 + k)] probability from raw),
"""


def _prf(k: int) -> str:
    hits = f"(count(*) filter (where label = {k} and prediction = {k}))::double"
    predicted = f"count(*) filter (where prediction = {k})"
    actual = f"count(*) filter (where label = {k})"
    return (
        f"coalesce({hits} / nullif({predicted}, 0), 0) p{k}, "
        f"coalesce({hits} / nullif({actual}, 0), 0) r{k}, "
        f"coalesce(2 * {hits} / nullif({predicted} + {actual}, 0), 0) f{k}, {actual} n{k}"
    )


def _weighted(letter: str) -> str:
    return (
        f"round((n0 * {letter}0 + n1 * {letter}1 + n2 * {letter}2) / nullif(n0 + n1 + n2, 0), 6)"
    )



_FUNNEL = """
tokens as (select drug, count(*) num_of_trials from (select unnest(string_split(primary_drugs, ', ')) drug from clean) q group by drug),
texts as (select distinct primary_drugs from clean),
mentions as (select drug, primary_drugs from tokens join texts on contains(lower(primary_drugs), lower(drug))),
owned as (select drug, phase_of_trial phase, trial_start from mentions join clean using (primary_drugs)),
"""


def _has(phase: str) -> str:
    return f"coalesce(bool_or(phase = '{phase}'), false)"


def _flags() -> str:
    pairs = {
        "phase_1_success": ("Phase I", "Phase II"),
        "phase_2_success": ("Phase II", "Phase III"),
        "phase_3_success": ("Phase III", "Phase IV"),
        "phase_1_2_success": ("Phase I/II", "Phase III"),
        "phase_2_3_success": ("Phase II/III", "Phase IV"),
    }
    return ", ".join(f"({_has(a)} and {_has(b)}) {name}" for name, (a, b) in pairs.items())


def _times(source: str) -> str:
    """CTE ``times`` over a table of drug, phase and trial_start."""
    names = ["phase_1_start", "phase_1_first_end", "phase_1_last_end",
             "phase_2_start", "phase_2_first_end", "phase_2_last_end"]
    complete = " and ".join(f"{n} is not null" for n in names)
    cells = ", ".join(f"case when {complete} then {n}::varchar end {n}" for n in names)
    return f"""
firsts as (select drug, min(trial_start) filter (where phase = 'Phase I') phase_1_start,
  max(trial_start) filter (where phase = 'Phase I') phase_1_last_end,
  min(trial_start) filter (where phase = 'Phase II') phase_2_start,
  max(trial_start) filter (where phase = 'Phase II') phase_2_last_end from {source} group by drug),
nexts as (select o.drug, min(trial_start) filter (where phase = 'Phase II' and trial_start > phase_1_start) phase_1_first_end,
  min(trial_start) filter (where phase = 'Phase III' and trial_start > phase_2_start) phase_2_first_end
  from {source} o join firsts on o.drug = firsts.drug group by o.drug),
times as (select firsts.drug, {cells} from firsts join nexts on firsts.drug = nexts.drug),
flags as (select drug, {_flags()} from {source} group by drug),
"""


_FUNNEL_ROWS = """
funnel as (select tokens.drug, num_of_trials, phase_1_success,
  phase_1_success and phase_2_success phase_2_success, phase_1_success and phase_3_success phase_3_success,
  phase_1_success and phase_1_2_success phase_1_2_success, phase_1_success and phase_2_3_success phase_2_3_success,
  case when phase_1_success then phase_1_start end phase_1_start, case when phase_1_success then phase_1_first_end end phase_1_first_end,
  case when phase_1_success then phase_1_last_end end phase_1_last_end, case when phase_1_success then phase_2_start end phase_2_start,
  case when phase_1_success then phase_2_first_end end phase_2_first_end, case when phase_1_success then phase_2_last_end end phase_2_last_end
 from tokens join flags on tokens.drug = flags.drug join times on tokens.drug = times.drug),
"""

_PER_PHASE = " union all ".join(
    f"""select drug, '{p}' phase, "{p} trial length" as days, "{p} Pass" as passed from wide"""
    for p in MODEL_PHASES
)
_BINNED = f"""
perphase as ({_PER_PHASE}),
binned as (select drug, phase, days, case when days < 547.5 then 0 when days < 1095 then 1 else 2 end::bigint time_bin from perphase),
balance as (select phase, time_bin, count(*) n, count(*) / sum(count(*)) over (partition by phase) share from binned group by phase, time_bin),
rates as (select phase, count(*) drugs, count(*) filter (where passed) passed, (count(*) filter (where passed))::double / count(*) rate from perphase group by phase),
"""


def _histogram(source: str, value: str, bins: int, by: str) -> str:
    keys = f"{by}, " if by else ""
    over = f"over (partition by {by})" if by else "over ()"
    return f"""
spread as (select {keys}{value} v, min({value}) {over} lo, max({value}) {over} hi from {source}),
edges as (select {keys}v, case when hi > lo then lo else lo - 0.5 end lo, case when hi > lo then hi else hi + 0.5 end hi from spread),
bins as (select {keys}least(floor((v - lo) * {bins}::double / (hi - lo)) + 1, {bins})::bigint bin, count(*) n from edges group by all),
"""


_HISTORY = """
entries as (select l_orderkey trial_id, strftime(l_shipdate, '%Y-%m-%d') || '|' || l_returnflag || '|' || l_linestatus || case when l_linenumber = 7 then '|extra' else '' end entry from lineitem),
"""

_DRUGS = """
drugs as (select p_partkey drug_id, 'drug '||p_partkey||'-'||p_brand drug_name, case p_size%5 when 0 then 'Phase I' when 1 then 'Phase II' when 2 then 'Phase III' when 3 then 'Marketed' else null end highest_development_phase from part),
"""

_NULL_TEXT = "null::varchar"


def all_oracles() -> dict[str, str]:
    trials, cleaned = _TRIALS, _TRIALS + _CLEAN
    source_columns = {
        "trial_id": "trial_id::varchar",
        **{n: n for n in (
            "organisations", "trial_design", "phase_of_trial", "planned_subject_number",
            "trial_centre_details", "trial_initiation_date", "trial_end_date", "trial_status",
            "primary_drugs", "trial_history",
        )},
        **{n: _NULL_TEXT for n in (
            "mechanism_of_action", "drug_class_therapeutic_effect", "drug_class_chemical",
            "indication", "location", "subject_age", "lead_centre", "diseases_treated",
        )},
    }
    profile = ["trial_id", "primary_drugs", "phase_of_trial", "trial_initiation_date",
               "trial_end_date", "planned_subject_number", "trial_centre_details",
               "organisations", "trial_design", "trial_status"]
    start, end = _date("trial_initiation_date"), _date("trial_end_date")
    run = r"trim(regexp_extract({}, '^[\d\s\w]*'))"
    oracles = {
        "load_clean": _sql("select trial_id, primary_drugs, trial_start::varchar trial_start, trial_end::varchar trial_end from clean", parts=cleaned),
        "load_audit": _sql(f"""select count(*) trials, count(*) filter (where o = 'no_drugs') no_drugs, count(*) filter (where o = 'planned') planned,
          count(*) filter (where o = 'blank_date') blank_date, count(*) filter (where o = 'unreadable_date') unreadable_date,
          count(*) filter (where o = 'after_cutoff') after_cutoff, count(*) filter (where o = 'kept') kept from (
          select case when primary_drugs is null then 'no_drugs'
           when contains(trial_initiation_date, 'planned') or contains(trial_end_date, 'planned') then 'planned'
           when trial_initiation_date is null or trial_end_date is null or {run.format('trial_initiation_date')} = '' or {run.format('trial_end_date')} = '' then 'blank_date'
           when {start} is null or {end} is null then 'unreadable_date'
           when {start} < date '{CUTOFF}' and {end} < date '{CUTOFF}' then 'kept' else 'after_cutoff' end o from trials) q""", parts=trials),
        "date_parse": _sql(f"""select trial_id, {run.format('trial_initiation_date')} start_text,
          case when not contains(trial_initiation_date, 'planned') then {start} end::varchar trial_start,
          case when not contains(trial_end_date, 'planned') then {end} end::varchar trial_end from trials""", parts=trials),
        "planned_filter": _sql("select trial_id, trial_initiation_date, trial_end_date from settled", parts=cleaned),
        "trial_columns": _sql("select " + ", ".join(f"{e} {n}" for n, e in source_columns.items()) + """ from trials
          left join (select trial_id of_trial, string_agg(entry, ';' order by entry) trial_history from entries group by trial_id) h
          on trial_id = of_trial""", parts=trials + _HISTORY),
        "phase_filter": _sql("""select trial_id, 'II' kind from trials where phase_of_trial = 'Phase II'
          union all select trial_id, 'III' from trials where phase_of_trial = 'Phase III'
          union all select trial_id, 'I-III' from trials where phase_of_trial in ('Phase I', 'Phase II', 'Phase III')""", parts=trials),
        "drug_trials": _sql("select trial_id, primary_drugs, phase_of_trial from trials where primary_drugs = 'drug 1'", parts=trials),
        "drug_base_names": _sql("select drug_id, drug_name, split_part(drug_name, '-', 1) drug from drugs", parts=_DRUGS),
        "status_collapse": _sql(f"select trial_id, {STATUS} status, phase_of_trial || ' ' || {STATUS} as label from trials", parts=trials),
        "design_collapse": _sql(f"select trial_id, {DESIGN} design from (select trial_id, trial_design raw_design from trials) q", parts=trials),
        "center_counts": _sql("select trial_id, len(string_split(trial_centre_details, ';')) number_of_centers from trials", parts=trials),
        "trial_durations": _sql("select trial_id, time_diff from clean where time_diff > 0", parts=cleaned),
        "onehot_phase": _sql("select trial_id, phase_of_trial, " + ", ".join(f"""(phase_of_trial = '{p}')::bigint "{p}" """ for p in MODEL_PHASES) + " from trials", parts=trials),
        "drug_explode": _sql("select trial_id, drug, phase_of_trial from exploded", parts=cleaned),
        "design_explode": _sql("select trial_id, drug, design from designs"),
        "drug_token_counts": _sql("select drug, num_of_trials from tokens", _FUNNEL, cleaned),
        "history_rows": _sql("select trial_id, split_part(entry, '|', 1) date, split_part(entry, '|', 2) status, split_part(entry, '|', 3) notes from entries where len(string_split(entry, '|')) = 3", parts=_HISTORY),
        "history_rejects": _sql("select trial_id, entry, len(string_split(entry, '|')) field_count from entries where len(string_split(entry, '|')) <> 3", parts=_HISTORY),
        "org_dedupe": _sql("select trial_id, coalesce(orgs, '') unique_organizations, coalesce(n, 0) number_of_organizations from trials left join kept on organisations = cell"),
        "subject_mean_long": _sql("select drug, phase, round(subject_mean, 6) subject_mean from long"),
        "center_count_mean": _sql("select drug, phase, round(center_count, 6) center_count from long"),
        "trial_length_days": _sql("select drug, phase, trial_length from long where trial_length is not null"),
        "drug_phase_features": _sql("select drug, phase, n, round(subject_mean, 6) subject_mean, trial_length, round(center_count, 6) center_count from long"),
        "drug_phase_template": _sql("select distinct drug, " + ", ".join(f'0.0::double "{p}"' for p in PHASES) + " from exploded", parts=cleaned),
        "subject_mean_wide": _sql(f"select drug, {_columns([f'{p} subject mean' for p in PHASES])} from wide"),
        "features_by_phase": _sql(f"select drug, {_columns(_WIDE_NAMES)} from wide"),
        "phase_pass_flags": _sql(f"select drug, {_columns(_FLAG_NAMES, False)} from wide"),
        "active_drugs": _sql("select drug, " + ", ".join(f'round("{p} subject mean", 6) "{p}"' for p in PHASES if p != "Phase 0") + f", {_columns(_FLAG_NAMES, False)} from wide where " + " or ".join(f'"{p} subject mean" is null or "{p} subject mean" <> 0' for p in ("Phase I", "Phase II", "Phase I/II"))),
        "status_counts_wide": _sql(f"select drug, {_columns(_STATUS_NAMES, False)} from statuswide"),
        "design_counts_wide": _sql(f"select drug, {_columns(_DESIGN_NAMES, False)} from designwide"),
        "org_count_max": _sql(f'select drug, orgs "{ORGANISATION_COUNT}" from orgmax'),
        "feature_table": _sql(f"select {_FEATURE_LIST} from features"),
        "feature_table_by_joins": _sql(f"select {_FEATURE_LIST} from features"),
        "feature_table_filled": _sql("select drug, " + ", ".join(f'coalesce(round("{n}", 6), 0) "{n}"' for n in _WIDE_NAMES) + f", {_columns(_FLAG_NAMES, False)}, " + ", ".join(f'coalesce("{n}", 0) "{n}"' for n in _STATUS_NAMES + [ORGANISATION_COUNT] + _DESIGN_NAMES) + " from features"),
        "phase_table_1": _phase_sql("Phase I"),
        "phase_table_2": _phase_sql("Phase II"),
        "phase_table_3": _phase_sql("Phase III"),
        "right_join_lengths": _sql(f"""select wide.drug, early.orgs "{ORGANISATION_COUNT}", {_columns([f'{p} trial length' for p in PHASES])} from (
          select drug, max(coalesce(kept.n, 0)) orgs from exploded left join kept on organisations = cell where phase in ('Phase I', 'Phase II', 'Phase I/II') group by drug) early
          right join wide on early.drug = wide.drug"""),
        "phase_store_round_trip": _each_phase(_short_phase_sql),
        "drug_match_join": _sql("select drug, primary_drugs from mentions", _FUNNEL, cleaned),
        "drug_match_literal": _sql("select drug, primary_drugs from mentions", _FUNNEL, cleaned),
        "copresence_flags": _sql(f"select drug, {_flags()} from exploded group by drug", parts=cleaned),
        "phase_times": _sql("select * from times", _times("exploded"), cleaned),
        "p1_subjects": _sql("select drug, case when count(*) = count(planned_subject_number) then sum(planned_subject_number) end subjects from exploded where phase = 'Phase I' group by drug", parts=cleaned),
        "drug_funnel": _sql("select * from funnel", _FUNNEL + _times("owned") + _FUNNEL_ROWS, cleaned),
        "funnel_exceptions": _sql("select drug, num_of_trials from tokens where drug like '%(%' and drug not like '%)%'", _FUNNEL, cleaned),
        "funnel_rates": _sql("""select count(*) drugs, round((count(*) filter (where phase_1_success))::double / nullif(count(*), 0), 6) phase_1_rate,
          round((count(*) filter (where phase_2_success))::double / nullif(count(*) filter (where phase_1_success), 0), 6) phase_2_rate,
          round((count(*) filter (where phase_3_success))::double / nullif(count(*) filter (where phase_2_success), 0), 6) phase_3_rate from funnel""", _FUNNEL + _times("owned") + _FUNNEL_ROWS, cleaned),
        "phase1_span": _sql(f"select primary_drugs, min({start})::varchar first_start, max({start})::varchar last_start from trials where phase_of_trial = 'Phase I' and {run.format('trial_initiation_date')} <> '' group by primary_drugs", parts=trials),
        "value_counts": _sql("select highest_development_phase, count(*) n from drugs where highest_development_phase is not null group by all", parts=_DRUGS),
        "distinct_values": _sql("select distinct drug, phase_of_trial from exploded", parts=cleaned),
        "shortest_trials": _sql("select trial_id, trial_start::varchar trial_start, trial_end::varchar trial_end, time_diff, primary_drugs from clean order by time_diff, trial_id limit 5", parts=cleaned),
        "pass_counts": _sql("select phase, passed, count(*) drugs from perphase group by all", _BINNED),
        "pass_rate": _sql("select phase, drugs, passed, round(rate, 6) rate from rates", _BINNED),
        "length_hist50": _sql("select phase, bin, n from bins", _BINNED + _histogram("perphase", "days", 50, "phase")),
        "org_hist10": _sql("select bin, n from bins", _histogram("orgmax", "orgs", 10, "")),
        "time_bins": _sql("select drug, phase, round(days, 6) as days, time_bin from binned", _BINNED),
        "time_bins_entered": _sql("select binned.drug, binned.phase, round(days, 6) as days, time_bin from binned join long on binned.drug = long.drug and binned.phase = long.phase", _BINNED),
        "class_balance": _sql("select phase, time_bin, n, round(share, 6) share from balance", _BINNED),
        "approval_product": _sql("""select task, round(naive, 6) naive, round(model, 6) model, round(historical, 6) historical,
          round((model - naive) / case when task = 'pass' then model else naive end, 6) lift,
          round(2.6 * ((model - naive) / case when task = 'pass' then model else naive end), 6) value_billions from (
          select 'pass' task, product(rate * rate + (1 - rate) * (1 - rate)) naive, product(greatest(rate, 1 - rate)) model, product(rate) historical from rates
          union all select 'time', product(s2), product(top), null from (select phase, sum(share * share) s2, max(share) top from balance group by phase) q) z""", _BINNED),
        "table_profile": _sql("select count(*) as rows, 10::bigint as columns, " + ", ".join(f"count(*) filter (where {c} is null) null_{c}" for c in profile) + " from trials", parts=trials),
        "pass_matrix": _matrix_sql("pass"),
        "time_matrix": _matrix_sql("time"),
        "length_matrix": _matrix_sql("length"),
        "split_80_20": _split_sql("pass", "select drug, label, split from split"),
        "split_by_threshold": _on_matrix("pass", "select drug, label, case when ('0x' || substr(md5('42|' || drug), 1, 8))::bigint < floor(0.2::double * 4294967296) then 'test' else 'train' end split from matrix"),
        "fold_assign": _on_matrix("time", "select drug, label, ntile(6) over (partition by label order by md5('42|' || drug)) - 1 fold from matrix"),
        "fold_assign_plain": _on_matrix("length", "select drug, label, ntile(6) over (order by md5('42|' || drug)) - 1 fold from matrix"),
        "class_weights": _on_matrix("time", "select label, count(*) n, round((select count(*) from matrix)::double / ((select count(distinct label) from matrix) * count(*)), 6) weight from matrix group by label"),
        "scaled_features": _each_phase(_scaled_sql),
        "accuracy": _sql("select round(avg((label = prediction)::int), 6) accuracy from predictions", parts=_BINARY),
        "binary_prf": _sql(f"""select round(acc, 6) accuracy, round(p1, 6) "precision", round(r1, 6) recall, round(f1, 6) f1, round(conf, 6) confidence from (
          select avg((label = prediction)::int) acc, {_prf(1)}, exp(avg(ln({_CLIP.format('case when label = 1 then predictions.p1 else 1 - predictions.p1 end')}))) conf from predictions) q""", parts=_BINARY),
        "weighted_prf": _sql(f"select {_weighted('p')} weighted_precision, {_weighted('r')} weighted_recall, {_weighted('f')} weighted_f1 from (select {_prf(0)}, {_prf(1)}, {_prf(2)} from predictions) q", parts=_TERNARY),
        "multiclass_scores": _sql(f"""select round(acc, 6) accuracy, {_weighted('p')} "precision", {_weighted('r')} recall, {_weighted('f')} f1, round(conf, 6) confidence from (
          select avg((label = prediction)::int) acc, {_prf(0)}, {_prf(1)}, {_prf(2)}, exp(avg(ln({_CLIP.format('probability[label + 1]')}))) conf from predictions) q""", parts=_TERNARY),
        "confidence": _sql(f"select round(exp(avg(ln({_CLIP.format('probability[label + 1]')}))), 6) confidence from predictions", parts=_TERNARY),
        "naive_accuracy": _split_sql("pass", _NAIVE_ACCURACY),
        "naive_confidence": _split_sql("pass", _NAIVE_CONFIDENCE),
        "naive_probs3": _split_sql("time", "select k as label, round((select count(*) from split where split = 'train' and label = k)::double / (select count(*) from split where split = 'train'), 6) share from (select unnest([0, 1, 2])::bigint k) q"),
        "naive_confidence3": _split_sql("time", f"""select round(exp(avg(ln({_CLIP.format('coalesce(s, 0)')}))), 6) naive_confidence from split t left join (
          select label l, count(*)::double / sum(count(*)) over () s from split where split = 'train' group by label) q on t.label = q.l where t.split = 'test'"""),
        "rmse": _sql("select round(sqrt(avg(pow(label - prediction, 2))), 6) rmse from predictions", parts=_TERNARY),
    }
    oracles["read_trials_csv"] = oracles["trial_columns"]
    oracles["read_drugs_csv"] = _sql(
        "select drug_id::varchar drug_id, drug_name, highest_development_phase from drugs",
        parts=_DRUGS,
    )
    oracles["csv_round_trip"] = _sql(
        "select drug, " + _columns(_WIDE_NAMES) + ", " + _columns(_FLAG_NAMES, False) + ", "
        + ", ".join(f'"{n}"::double "{n}"' for n in _STATUS_NAMES + [ORGANISATION_COUNT] + _DESIGN_NAMES)
        + " from features"
    )
    oracles |= _model_sql()
    return oracles
