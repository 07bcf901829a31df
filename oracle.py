"""DuckDB oracle SQL for every registered query (the driver's correctness gate).

Built from shared CTE fragments: the candidate fixture (FIXTURES.md B), the
enrichment, the classifier and the queue ranking, written independently of
the Spark code as plain SQL over the pre-registered driver views. Literals
are cast to double so DuckDB never switches to decimal arithmetic; rounded
columns use sign(x)*floor(|x|*1e6+0.5)/1e6 exactly like the Spark side.
"""

from __future__ import annotations

import math

FIXTURE = """select concat('K', cast(l_orderkey as string), '.', cast(l_linenumber as string), '-', cast(l_partkey as string), '-', cast(l_suppkey as string)) as object_id,
  l_orderkey as star_id,
  cast(case when l_partkey % 13 = 0 then null when l_partkey % 13 = 1 then -l_quantity else l_quantity * 0.4 * (1 + l_linenumber) end as double) as koi_period,
  cast(case when l_suppkey % 12 = 0 then null when l_suppkey % 12 = 1 then l_quantity when l_suppkey % 12 = 2 then -1.0 else l_extendedprice / 8000 end as double) as koi_prad,
  cast(case when l_suppkey % 5 = 0 then 0.05 * l_quantity end as double) as koi_sma,
  cast(case when l_partkey % 7 = 0 then null else 0.5 + l_tax * 10 end as double) as koi_smass,
  cast(case when l_partkey % 17 = 0 then null when l_partkey % 17 = 1 then 0.0 else 0.5 + l_discount * 10 end as double) as koi_srad,
  cast(case when l_partkey % 19 = 0 then null else 3.5 + l_tax * 20 end as double) as koi_slogg,
  cast(case when l_suppkey % 9 = 0 then null when l_suppkey % 9 = 1 then 1500.0 when l_suppkey % 9 = 2 then 11000.0 else 3500 + l_quantity * 60 end as double) as koi_steff,
  cast(case when l_linenumber in (1, 2) then 50 + (50 - l_quantity) * 8 end as double) as koi_teq,
  cast(case when l_linenumber in (1, 4) then l_quantity * 0.1 end as double) as koi_insol,
  cast(case when l_partkey % 3 = 0 then null else l_quantity * 30 end as double) as koi_duration,
  cast(case when l_partkey % 4 = 0 then null when l_partkey % 4 = 1 then 1.2 else l_discount * 5 end as double) as koi_impact,
  case when l_returnflag = 'R' and l_linestatus = 'O' then 'CONFIRMED' when l_returnflag = 'R' then 'FALSE POSITIVE'
       when l_returnflag = 'N' and l_linestatus = 'O' then 'CANDIDATE' when l_returnflag = 'N' then ' candidate '
       when l_linestatus = 'F' then null else '' end as koi_disposition,
  case l_linenumber % 5 when 0 then 'F' when 1 then 'G' when 2 then 'K' when 3 then 'M' end as stellar_type,
  cast(case when l_partkey % 6 = 0 then null else l_tax * 20 - 0.2 end as double) as uncertainty,
  l_shipdate as discovery_date
from lineitem"""


def d(x: float) -> str:
    """A double literal DuckDB reads exactly as Python's float."""
    if math.isinf(x):
        return "'inf'::double" if x > 0 else "'-inf'::double"
    return f"{x!r}::double"


def r6(x: str) -> str:
    return f"(sign({x}) * floor(abs({x}) * 1000000.0::double + 0.5::double) / 1000000.0::double)"


def m1(p="koi_period", m="koi_smass") -> str:
    py = f"({p} / 365.25::double)"
    return f"(case when {p} > 0 and {m} > 0 then pow({py} * {py} * {m}, 1.0::double / 3.0::double) end)"


def m2(a: str, albedo: float = 0.3) -> str:
    k = d((1.0 - albedo) ** 0.25)
    return (f"(case when koi_steff is not null and koi_srad > 0 and {a} > 0 then "
            f"koi_steff * sqrt(koi_srad / (2.0::double * {a})) * {k} end)")


def m3(a: str) -> str:
    r = "(koi_steff / 5772.0::double)"
    return (f"(case when koi_steff is not null and koi_srad > 0 and {a} > 0 then "
            f"(koi_srad * koi_srad) * (({r} * {r}) * ({r} * {r})) / ({a} * {a}) end)")


M4 = ("(case when koi_prad > 0 and koi_srad > 0 then (koi_prad / (koi_srad * 109.0::double)) * "
      "(koi_prad / (koi_srad * 109.0::double)) end)")


def m5(a: str) -> str:
    b = "coalesce(koi_impact, 0.5::double)"
    return (f"(case when koi_period > 0 and koi_srad > 0 and {a} > 0 then "
            f"(koi_period / {d(math.pi)}) * sqrt(greatest(0.0::double, 1.0::double - {b} * {b})) * (koi_srad / {a}) "
            f"* 24.0::double end)")


def m6(exp: str) -> str:
    return f"(case when koi_duration is not null and {exp} > 0 then koi_duration / {exp} end)"


SOFT = ("concat_ws(';', case when koi_prad <= 0 then 'SOFT_NEGATIVE_RADIUS' end, "
        "case when koi_srad <= 0 then 'SOFT_NEGATIVE_STELLAR_RADIUS' end, "
        "case when koi_period <= 0 then 'SOFT_NEGATIVE_PERIOD' end, "
        "case when koi_steff < 2000 or koi_steff > 10000 then 'SOFT_STELLAR_TEFF_OUT_OF_RANGE' end)")


def enrich_ctes(src: str = "koi", out: str = "enr", albedo: float = 0.3, auto: bool = True) -> str:
    a_expr = f"coalesce(koi_sma, {m1()})" if auto else "koi_sma"
    teq = f"coalesce(koi_teq, {m2('a_', albedo)})" if auto else "koi_teq"
    ins = f"coalesce(koi_insol, {m3('a_')})" if auto else "koi_insol"
    return (
        f"{out}_a as (select *, {a_expr} as a_ from {src}),\n"
        f"{out}_b as (select * exclude (a_) replace (a_ as koi_sma, {teq} as koi_teq, {ins} as koi_insol), "
        f"{M4} as transit_depth, {m5('a_')} as expected_duration_hours, {SOFT} as soft_flags from {out}_a),\n"
        f"{out} as (select *, {m6('expected_duration_hours')} as duration_ratio from {out}_b)"
    )


DEFAULT_TH = dict(rocky=2.0, super_=6.0, hot_min=8.0, pmax=10.0, hot_teq=1000.0, hab_t=(180.0, 310.0),
                  hab_i=(0.5, 2.0), max_radius=30.0, max_depth=0.05, low=0.5, high=1.8, teq_low=80.0)


def classify_ctes(src: str = "enr", out: str = "cls", **th) -> str:
    t = {**DEFAULT_TH, **th}
    flags_rule = ", ".join(
        [
            "case when f_rad then 'FLAG_RADIUS_TOO_LARGE' end",
            "case when f_depth then 'FLAG_ANOMALOUS_DEPTH' end",
            "case when f_short then 'FLAG_DURATION_TOO_SHORT' end",
            "case when f_long then 'FLAG_DURATION_TOO_LONG' end",
            "case when f_cold then 'FLAG_COLD_DEEP_TRANSIT' end",
            "case when koi_prad is null then 'FLAG_MISSING_PRAD' end",
            "case when koi_period is null then 'FLAG_MISSING_PERIOD' end",
            "case when koi_teq is null then 'FLAG_MISSING_TEQ' end",
        ]
    )
    return f"""{out}_c as (select *,
    (koi_prad is null and koi_period is null and koi_teq is null and koi_insol is null) as gate_,
    coalesce(upper(trim(koi_disposition)) = 'CONFIRMED', false) as conf_,
    coalesce(upper(trim(koi_disposition)) = 'FALSE POSITIVE', false) as fp_,
    coalesce(koi_prad > {d(t['max_radius'])}, false) as f_rad,
    coalesce(transit_depth > {d(t['max_depth'])}, false) as f_depth,
    coalesce(duration_ratio < {d(t['low'])}, false) as f_short,
    coalesce(duration_ratio > {d(t['high'])}, false) as f_long,
    coalesce(koi_teq < {d(t['teq_low'])} and transit_depth > 0.01::double, false) as f_cold,
    coalesce(koi_teq between {d(t['hab_t'][0])} and {d(t['hab_t'][1])}, false) as hab_t,
    coalesce(koi_insol between {d(t['hab_i'][0])} and {d(t['hab_i'][1])}, false) as hab_i,
    coalesce(koi_prad < {d(t['rocky'])}, false) as rocky_,
    coalesce(koi_prad >= {d(t['rocky'])} and koi_prad < {d(t['super_'])}, false) as super_,
    coalesce(koi_prad >= {d(t['super_'])} and koi_prad >= {d(t['hot_min'])}, false)
      and not coalesce(koi_prad < {d(t['rocky'])}, false)
      and (coalesce(koi_period <= {d(t['pmax'])}, false) or coalesce(koi_teq >= {d(t['hot_teq'])}, false)) as hot_
  from {src}),
{out}_d as (select *, cast(f_rad as int) + cast(f_depth as int) + cast(f_cold as int) as hits_,
    case when hab_t and hab_i then 0.7::double when hab_t or hab_i then 0.55::double else 0.0::double end as s_hab
  from {out}_c),
{out}_e as (select *,
    case when gate_ then 'no_result' when conf_ then 'confirmed_planet' when fp_ then 'likely_false_positive'
         when hits_ >= 1 then 'anomalous_signal' when rocky_ then 'rocky_candidate'
         when super_ then 'super_earth_or_mini_neptune' when hot_ then 'hot_jupiter_candidate'
         when hab_t or hab_i then 'habitable_zone_candidate' else 'candidate' end as category,
    greatest(0.0::double, least(1.0::double,
    case when gate_ then 0.0::double when conf_ then 0.95::double when fp_ then 0.9::double
         when hits_ >= 3 then 0.9::double when hits_ = 2 then 0.8::double when hits_ = 1 then 0.7::double
         when rocky_ then greatest(s_hab, 0.6::double) when super_ then greatest(s_hab, 0.55::double)
         when hot_ then greatest(s_hab, 0.65::double) when hab_t or hab_i then s_hab else 0.5::double end)) as score,
    case when gate_ then 'FLAG_NO_FEATURES' when conf_ or fp_ then '' else concat_ws(';', {flags_rule}) end as flags,
    case when upper(trim(koi_disposition)) = 'CONFIRMED' then 'confirmed_planet'
         when upper(trim(koi_disposition)) = 'CANDIDATE' then 'candidate'
         when upper(trim(koi_disposition)) = 'FALSE POSITIVE' then 'likely_false_positive' end as disp_cat_
  from {out}_d),
{out} as (select *,
    case when koi_disposition is null or trim(koi_disposition) = '' then 'missing'
         when disp_cat_ = category then 'match' else 'mismatch' end as disposition_compare,
    case when koi_disposition is null or trim(koi_disposition) = '' then cast(null as boolean)
         else coalesce(disp_cat_ = category, false) end as is_disposition_match,
    case when koi_disposition is null or trim(koi_disposition) = '' then 'green'
         when disp_cat_ = category then 'black' else 'red' end as color_hint
  from {out}_e)"""


REPORT_COLS = (f"object_id, koi_period, koi_prad, {r6('koi_teq')} as koi_teq, {r6('koi_insol')} as koi_insol, "
               "koi_disposition, category, score, flags, disposition_compare, is_disposition_match, color_hint")
KOI = f"koi_full as ({FIXTURE}),\nkoi as (select * exclude (discovery_date) from koi_full)"
BASE = f"with {KOI},\n{enrich_ctes()},\n{classify_ctes()}"


def base(albedo: float = 0.3, auto: bool = True, **th) -> str:
    return f"with {KOI},\n{enrich_ctes(albedo=albedo, auto=auto)},\n{classify_ctes(**th)}"


def report_cte(albedo: float = 0.3) -> str:
    return f"{base(albedo)},\nrpt as (select {REPORT_COLS} from cls)"


ENRICH_VIEW = ("object_id, koi_period, koi_prad, koi_srad, koi_steff, " + ", ".join(
    f"{r6(c)} as {c}" for c in ("koi_sma", "koi_teq", "koi_insol")) +
    ", transit_depth, " + f"{r6('expected_duration_hours')} as expected_duration_hours, "
    f"{r6('duration_ratio')} as duration_ratio, soft_flags")

# ---------------------------------------------------------------- labelling
WEIGHTS = ("case trim(coalesce(category, '')) when 'anomalous_signal' then 5.0::double when 'candidate' then 3.0::double "
           "when 'habitable_zone_candidate' then 2.5::double when 'rocky_candidate' then 2.0::double "
           "when 'hot_jupiter_candidate' then 1.5::double when 'likely_false_positive' then -1.0::double "
           "when 'no_result' then -2.0::double else 0.0::double end")
INTERESTING = ("len(list_filter(string_split(coalesce(trim(flags), ''), ';'), lambda x: x in ('FLAG_ANOMALOUS_PERIOD', "
               "'FLAG_ANOMALOUS_DEPTH', 'FLAG_DURATION_INCONSISTENT', 'FLAG_MISSING_PRAD', 'FLAG_ASSUMED_ALBEDO')))")
BOOST_SCORE = "((1.0::double - abs(0.5::double - coalesce(score, 0.0::double)) * 2.0::double) * 2.0::double)"
LSCORE = f"({WEIGHTS} + cast({INTERESTING} as double) * 0.5::double + {BOOST_SCORE})"
PRIORITY = ("case (case when coalesce(category, '') = '' then 'candidate' else category end) "
            "when 'anomalous_signal' then 0 when 'candidate' then 1 when 'habitable_zone_candidate' then 2 "
            "when 'rocky_candidate' then 3 else 4 end")
ITEMS = (f"items as (select object_id, case when coalesce(category, '') = '' then 'candidate' else category end as suggested_label, "
         f"coalesce(score, 0.0::double) as score_model, {LSCORE} as score_labeling, "
         f"array_to_string(list_filter(string_split(coalesce(trim(flags), ''), ';'), lambda x: x <> ''), ';') as flags, "
         f"{PRIORITY} as priority_idx from rpt "
         f"where lower(coalesce(koi_disposition, '')) not in ('confirmed_planet', 'likely_false_positive'))")


def queue_sql(order: str, limit: int | None = 50) -> str:
    lim = f" limit {limit}" if limit else ""
    return (f"{report_cte()},\n{ITEMS}\nselect object_id, suggested_label, score_model, score_labeling, flags, "
            f"row_number() over (order by {order}) - 1 as queue_pos from items order by {order}{lim}")


PRIORITY_ORDER = "priority_idx, score_labeling desc, object_id, score_model"
UNCERTAINTY_ORDER = "priority_idx, abs(0.5::double - score_model), object_id, score_model"


RANDOM_ORDER = ("priority_idx, (('0x' || substr(md5('42:' || object_id), 1, 8))::bigint / 4294967296.0::double), "
                "object_id, score_model")


def ranked(name: str, order: str, where: str = "true") -> str:
    return (f"{name} as (select *, row_number() over (order by {order}) - 1 as queue_pos from items where {where})")


LABEL_LOG = """label_log as (
  select concat('K', cast(l_orderkey as string), '.', cast(l_linenumber as string), '-', cast(l_partkey as string), '-', cast(l_suppkey as string)) as object_id,
         'candidate' as label, 1 as seq from lineitem where l_partkey % 50 = 0
  union all
  select concat('K', cast(l_orderkey as string), '.', cast(l_linenumber as string), '-', cast(l_partkey as string), '-', cast(l_suppkey as string)) as object_id,
         'rocky_candidate' as label, 2 as seq from lineitem where l_partkey % 100 = 0)"""

# ---------------------------------------------------------------- features
NUMERIC_FEATURES = ("koi_period", "koi_sma", "koi_prad", "koi_teq", "koi_insol", "koi_smass", "koi_srad", "koi_slogg",
                    "transit_depth", "density_est")
DEFAULT_SPEC = {
    "koi_period": ("median", "log1p"), "koi_sma": ("median", "log1p"), "koi_prad": ("median", "standardize"),
    "koi_teq": ("median", "standardize"), "koi_insol": ("median", "log1p"), "koi_smass": ("median", "standardize"),
    "koi_srad": ("median", "standardize"), "koi_slogg": ("median", "standardize"),
    "transit_depth": ("zero", "none"), "density_est": ("median", "standardize"),
}
FINITE = "({x} is not null and not isnan({x}) and abs({x}) <> 'inf'::double)"


def features_sql(spec: dict[str, tuple[str, str]], onehot: bool, mode_raw: bool = False) -> str:
    src = f"{base()},\nsrc as materialized (select *, cast(null as double) as density_est from enr)"
    stats = []
    for c, (imp, _) in spec.items():
        if imp == "median":
            stats.append(f"median({c}) as med_{c}")
        elif imp == "mean":
            stats.append(f"avg({c}) as mean_{c}")
    st = f"st as (select {', '.join(stats)} from src)" if stats else "st as (select 1 as dummy)"

    def fill(c, imp):
        if imp in ("zero", "constant"):
            return "0.0::double"
        stat = f"med_{c}" if imp == "median" else f"mean_{c}"
        return f"(case when {FINITE.format(x=stat)} then {stat} else 0.0::double end)"

    imp_cols = "".join(f"coalesce({c}, {fill(c, imp)}) as {c}, " for c, (imp, _) in spec.items())
    mode = ("md as (select stellar_type as mode_v from src where stellar_type is not null "
            "group by stellar_type order by count(*) desc, stellar_type limit 1)")
    imputed = (f"imp as materialized (select object_id, {imp_cols}coalesce(stellar_type, (select mode_v from md), 'UNK') as stellar_type "
               f"from src, st)")
    std_cols = [c for c, (_, t) in spec.items() if t == "standardize"]
    std_stats = ", ".join(
        f"avg(case when {FINITE.format(x=c)} then {c} end) as m_{c}, stddev_samp(case when {FINITE.format(x=c)} then {c} end) as s_{c}"
        for c in std_cols)
    st2 = f"st2 as (select {std_stats} from imp)" if std_stats else "st2 as (select 1 as dummy)"
    outs = []
    for c, (_, t) in spec.items():
        if t == "log1p":
            e = f"case when {FINITE.format(x=c)} and {c} >= 0 then ln(1 + {c}) end"
            e = f"case when {FINITE.format(x=c)} and {c} >= 0 then log1p_({c}) end"
        elif t == "standardize":
            sd = f"(case when {FINITE.format(x='s_' + c)} and s_{c} <> 0 then s_{c} else 1.0::double end)"
            e = f"case when {FINITE.format(x=c)} then ({c} - m_{c}) / {sd} end"
        else:
            e = c
        outs.append(f"{r6(f'({e})')} as {c}")
    cat = ""
    if onehot:
        cat = ", " + ", ".join(f"coalesce(stellar_type = '{v}', false) as stellar_type_{v}" for v in ("F", "G", "K", "M"))
    if mode_raw:
        cat = ", stellar_type"
    sel = ", ".join(["object_id"] + outs) + cat
    return f"{src},\n{st},\n{mode},\n{imputed},\n{st2}\nselect {sel} from imp, st2"


def finalize(sql: str) -> str:
    return sql.replace("log1p_(", "ln(1.0::double + ")


# ---------------------------------------------------------------- text fixture
TEXT_COLS = ("star_id", "koi_period", "koi_prad", "koi_sma", "koi_smass", "koi_srad", "koi_slogg", "koi_steff",
             "koi_teq", "koi_insol", "koi_duration", "koi_impact", "uncertainty")
KOI_ORDER = ("object_id", "star_id", "koi_period", "koi_prad", "koi_sma", "koi_smass", "koi_srad", "koi_slogg",
             "koi_steff", "koi_teq", "koi_insol", "koi_duration", "koi_impact", "koi_disposition", "stellar_type",
             "uncertainty")


def text_typed() -> str:
    cols = []
    for i, c in enumerate(KOI_ORDER):
        if c in ("object_id", "stellar_type"):
            cols.append(c)
        elif c == "koi_disposition":
            cols.append("case when trim(koi_disposition) in ('', 'NA', 'NaN', 'null', 'NULL', 'None') then null else koi_disposition end as koi_disposition")
        else:
            key = f"(star_id + {i})"
            cols.append(f"case when {key} % 10 = 0 or {key} % 97 = 3 then null else {c} end as {c}")
    cols.append(
        "case star_id % 4 when 0 then concat('seen \"twice\", by ', object_id) when 1 then concat('a;b|c', chr(9), 'd,') "
        "when 2 then null else '\"' end as remark"
    )
    return f"with {KOI},\ntxt as (select {', '.join(cols)} from koi)"


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    q["koi_fixture"] = f"with {KOI} select * from koi"
    q["normalize_columns"] = (
        f"with {KOI} select object_id, star_id, koi_period, koi_prad, koi_sma, koi_smass, koi_srad, koi_slogg, "
        "koi_steff, koi_teq, koi_insol, koi_duration, koi_impact, koi_disposition, stellar_type, uncertainty, "
        "concat('R', cast(star_id as string)) as rowid, star_id % 10 as my_extra from koi")
    mapping = [
        ("kepoi_name", "object_id", "alias", "object_id"), ("star_id", "star_id", "unknown", "star_id"),
        ("Orbital Period", "koi_period", "alias", "koi_period"), ("pl_rade", "koi_prad", "alias", "koi_prad"),
        ("koi_sma", "koi_sma", "ok", "koi_sma"), ("Stellar-Mass", "koi_smass", "alias", "koi_smass"),
        ("koi_srad", "koi_srad", "ok", "koi_srad"), ("koi_slogg", "koi_slogg", "ok", "koi_slogg"),
        ("koi_steff", "koi_steff", "ok", "koi_steff"), ("TEQ", "koi_teq", "alias", "koi_teq"),
        ("koi_insol", "koi_insol", "ok", "koi_insol"), ("koi_duration", "koi_duration", "unknown", "koi_duration"),
        ("koi_impact", "koi_impact", "unknown", "koi_impact"),
        ("disposition", "koi_disposition", "alias", "koi_disposition"),
        ("stellar_type", "stellar_type", "unknown", "stellar_type"),
        ("uncertainty", "uncertainty", "unknown", "uncertainty"),
        ("rowid", "rowid", "shadowed", "concat('R', cast(star_id as string))"),
        ("my_extra", "my_extra", "unknown", "star_id % 10"),
    ]
    q["mapping_suggest"] = f"with {KOI} " + " union all ".join(
        f"select '{det}' as detected, '{to}' as mapped_to, '{st}' as status, count({expr}) as non_null from koi"
        for det, to, st, expr in mapping)

    a = f"coalesce(koi_sma, {m1()})"
    q["semi_major_axis"] = f"with {KOI} select object_id, {r6(m1())} as semi_major_axis from koi"
    q["equilibrium_temp"] = f"with {KOI} select object_id, {r6(m2(a))} as equilibrium_temp from koi"
    q["insolation"] = f"with {KOI} select object_id, {r6(m3(a))} as insolation from koi"
    q["transit_depth"] = f"with {KOI} select object_id, {M4} as transit_depth from koi"
    q["expected_duration"] = f"with {KOI} select object_id, {r6(m5(a))} as expected_duration from koi"
    q["duration_ratio"] = f"with {KOI} select object_id, {r6(m6(m5(a)))} as duration_ratio from koi"
    q["enrich"] = f"with {KOI},\n{enrich_ctes()}\nselect {ENRICH_VIEW} from enr"
    q["enrich_no_derive"] = f"with {KOI},\n{enrich_ctes(auto=False)}\nselect {ENRICH_VIEW} from enr"
    q["enrich_albedo_05"] = f"with {KOI},\n{enrich_ctes(albedo=0.5)}\nselect {ENRICH_VIEW} from enr"
    q["soft_flags"] = f"with {KOI},\n{enrich_ctes()}\nselect object_id, soft_flags from enr"
    q["habitability_flag"] = (f"with {KOI},\n{enrich_ctes()}\nselect object_id, "
                              "cast(koi_teq between 200.0::double and 300.0::double as int) as habitability_flag from enr")
    q["anomaly_flags"] = (f"{BASE}\nselect object_id, f_rad as radius_too_large, f_depth as anomalous_depth, "
                          "f_short as duration_too_short, f_long as duration_too_long, f_cold as cold_deep_transit, "
                          "hits_ as strong_hits from cls")
    q["missing_flags"] = (f"with {KOI},\n{enrich_ctes()}\nselect object_id, koi_prad is null as missing_prad, "
                          "koi_period is null as missing_period, koi_teq is null as missing_teq from enr")
    q["classify"] = f"{BASE}\nselect {REPORT_COLS} from cls"
    custom = dict(rocky=1.5, super_=5.0, hot_min=7.0, pmax=5.0, hab_t=(200.0, 320.0), hot_teq=900.0,
                  max_depth=0.03, high=2.5, teq_low=100.0)
    q["classify_custom_thresholds"] = f"{base(**custom)}\nselect {REPORT_COLS} from cls"
    q["disposition_compare"] = (f"{BASE}\nselect object_id, koi_disposition, disp_cat_ as disposition_category, category, "
                                "disposition_compare, is_disposition_match, color_hint from cls")
    norm = "regexp_replace(lower(trim({x})), '\\s+', '_', 'g')"
    q["color_hint_fallback"] = (
        f"{BASE},\nh as (select object_id, case when star_id % 2 = 0 then color_hint end as given, "
        f"coalesce({norm.format(x='koi_disposition')}, '') as nd, coalesce({norm.format(x='category')}, '') as nc from cls)\n"
        "select object_id, case when lower(given) in ('green', 'black', 'red') then lower(given) "
        "when nd = '' then 'green' when nd = nc then 'black' else 'red' end as color_hint from h")
    q["category_summary"] = f"{BASE}\nselect category, disposition_compare, count(*) as n from cls group by all"
    q["exclude_rows"] = (f"{BASE}\nselect object_id, category, koi_disposition from cls "
                         "where coalesce(category, '') not in ('no_result') "
                         "and coalesce(disp_cat_, '') not in ('confirmed_planet', 'likely_false_positive')")
    q["search_id_regex"] = f"{BASE}\nselect object_id, category from cls where regexp_matches(object_id, '(?i)k1[0-9]*7\\.1-')"
    q["search_id_literal"] = f"{BASE}\nselect object_id, category from cls where contains(lower(object_id), 'k12')"
    q["filter_category"] = f"{BASE}\nselect {REPORT_COLS} from cls where category = 'habitable_zone_candidate'"
    q["lookup_object"] = (f"{report_cte()}\nselect * from rpt where object_id = (select min(object_id) from rpt) "
                          f"order by all limit 1")
    q["page_results"] = f"{report_cte()}\nselect * from rpt order by all nulls first limit 50 offset 100"
    q["newest_first"] = (f"with {KOI} select object_id, strftime(discovery_date, '%Y-%m-%d') as discovery_day from koi_full "
                         "order by discovery_date desc, object_id limit 25")
    def fixed(x, k):
        scale = 10 ** k
        kk = f"cast(floor(abs({x}) * {float(scale)!r}::double + 0.5::double) as bigint)"
        sign = f"(case when {x} < 0 then '-' else '' end)"
        if k == 0:
            return f"({sign} || cast({kk} as varchar))"
        return (f"({sign} || cast({kk} // {scale} as varchar) || '.' || "
                f"lpad(cast({kk} % {scale} as varchar), {k}, '0'))")

    def disp(x):
        return (f"case when {x} is null then '—' when abs({x}) >= 100 then {fixed(x, 0)} "
                f"when abs({x}) >= 10 then {fixed(x, 1)} else {fixed(x, 2)} end as {x}")

    disp_cols = ", ".join(disp(c) for c in ("koi_period", "koi_prad", "koi_teq", "koi_insol"))
    q["display_rounding"] = (
        f"{report_cte()}\nselect coalesce(object_id, '—') as object_id, coalesce(koi_disposition, '') as koi_disposition, "
        "coalesce(category, '') as category, case when score is null then '—' else "
        f"{fixed('score', 2)} end as score, case when coalesce(flags, '') = '' then '—' else replace(flags, ';', '; ') end as flags, "
        f"{disp_cols} from rpt")
    q["split_flags"] = (f"{report_cte()}\nselect object_id, flag from (select object_id, "
                        "unnest(list_filter(string_split(coalesce(trim(flags), ''), ';'), lambda x: x <> '')) as flag from rpt)")
    q["flag_counts"] = (f"{report_cte()}\nselect flag, count(*) as n from (select "
                        "unnest(list_filter(string_split(coalesce(trim(flags), ''), ';'), lambda x: x <> '')) as flag from rpt) "
                        "group by flag")
    q["uncertainty_boost"] = (
        f"{BASE}\nselect object_id, case when uncertainty is not null then greatest(0.0::double, least(1.0::double, "
        f"uncertainty)) * 2.0::double else {BOOST_SCORE} end as boost from cls")
    q["labeling_score"] = f"{report_cte()}\nselect object_id, {LSCORE} as score_labeling from rpt"
    q["label_queue_priority"] = queue_sql(PRIORITY_ORDER)
    q["label_queue_uncertainty"] = queue_sql(UNCERTAINTY_ORDER)
    q["label_queue_random"] = queue_sql(RANDOM_ORDER)
    q["queue_merge"] = (
        f"{report_cte()},\n{ITEMS},\n"
        f"{ranked('old_q', PRIORITY_ORDER, 'suggested_label in (' + chr(39) + 'anomalous_signal' + chr(39) + ', ' + chr(39) + 'candidate' + chr(39) + ')')},\n"
        f"{ranked('new_q', UNCERTAINTY_ORDER)},\n"
        "both_q as (select object_id, suggested_label, 0 as src, queue_pos as pos from old_q "
        "union all select object_id, suggested_label, 1 as src, queue_pos as pos from new_q),\n"
        "dedup as (select object_id, arg_min(suggested_label, src * 1000000000 + pos) as suggested_label, "
        "min(src * 1000000000 + pos) as k from both_q group by object_id)\n"
        "select object_id, suggested_label, row_number() over (order by k) - 1 as queue_pos from dedup")
    q["queue_apply"] = (f"{report_cte()},\n{ITEMS},\n{ranked('q', PRIORITY_ORDER)},\n{LABEL_LOG}\n"
                        "select object_id, queue_pos from q where object_id not in (select object_id from label_log)")
    q["queue_enqueue"] = (
        f"{report_cte()},\n{ITEMS},\n{ranked('q', PRIORITY_ORDER)}\n"
        "select object_id, queue_pos from q where queue_pos < 50 union all "
        "select object_id, 49 + row_number() over (order by object_id) as queue_pos from rpt "
        "where category = 'hot_jupiter_candidate'")
    # features
    med = {c: ("median", "none") for c in NUMERIC_FEATURES}
    q["impute_median"] = finalize(features_sql(med, onehot=False))
    q["impute_mean"] = finalize(features_sql({c: ("mean", "none") for c in NUMERIC_FEATURES}, onehot=False))
    q["impute_zero"] = finalize(features_sql({c: ("zero", "none") for c in NUMERIC_FEATURES}, onehot=False))
    q["impute_mode"] = finalize(features_sql({}, onehot=False, mode_raw=True))
    q["log1p_transform"] = finalize(features_sql({c: ("median", "log1p") for c in NUMERIC_FEATURES}, onehot=False))
    q["standardize"] = finalize(features_sql({c: ("median", "standardize") for c in NUMERIC_FEATURES}, onehot=False))
    q["onehot"] = finalize(features_sql({}, onehot=True))
    q["feature_table"] = finalize(features_sql(DEFAULT_SPEC, onehot=True))
    q["latest_label_join"] = finalize(
        f"with ft as ({features_sql(DEFAULT_SPEC, onehot=True)}),\n{LABEL_LOG},\n"
        "ll as (select object_id, arg_max(label, seq) as label from label_log group by object_id)\n"
        "select ft.object_id, ft.koi_period, ft.koi_prad, ll.label from ft left join ll using (object_id)")
    # reports and sources
    # CSV cannot tell '' from NULL: an empty disposition reads back as NULL.
    q["report_roundtrip"] = (f"{BASE}\nselect object_id, nullif(koi_disposition, '') as koi_disposition, category, disposition_compare, "
                             "is_disposition_match, color_hint, score, flags, koi_period, koi_prad, "
                             f"{r6('koi_teq')} as koi_teq, {r6('koi_insol')} as koi_insol from cls")
    q["latest_run"] = (f"{base(0.5)}\nselect object_id, koi_disposition, category, disposition_compare, "
                       "is_disposition_match, color_hint, score, flags, koi_period, koi_prad, "
                       f"{r6('koi_teq')} as koi_teq, {r6('koi_insol')} as koi_insol, '20240201_000000' as run_ts from cls")
    q["csv_null_tokens"] = f"{text_typed()}\nselect * from txt"
    q["delimiter_vote"] = f"{text_typed()}\nselect * from txt"
    x = ("case when l_partkey % 3 = 0 then null when l_partkey % 3 = 1 then null else l_quantity end")
    y = "case when l_partkey % 4 = 0 then null else l_tax end"
    q["nonfinite_to_null"] = (f"select l_orderkey, l_linenumber, {x} as x, {x} as arr0, {y} as arr1, {x} as map_a, "
                              f"{y} as map_b, {x} as struct_v, {y} as struct_w from lineitem")
    txt_enr = f"{text_typed()},\n{enrich_ctes(src='txt')},\n{classify_ctes()}"
    q["file_drop_stream"] = f"{txt_enr}\nselect {REPORT_COLS} from cls"
    # splits and evaluation
    q["split_filter"] = (f"{BASE}\nselect object_id, category as label, koi_period, koi_prad from cls "
                         "where koi_period is not null and koi_prad is not null "
                         "and koi_period between 0.1::double and 10000.0::double "
                         "and koi_prad between 0.1::double and 1000.0::double "
                         "and coalesce(category, '') not in ('no_result') "
                         "and coalesce(disp_cat_, '') not in ('confirmed_planet')")
    bucket = "(('0x' || substr(md5('1337:' || cast(star_id as string)), 1, 8))::bigint / 4294967296.0::double)"
    split = f"case when {bucket} < 0.7::double then 'train' when {bucket} < {d(0.7 + 0.15)} then 'val' else 'test' end"
    q["grouped_split"] = f"{BASE}\nselect object_id, star_id, {split} as split from cls"
    q["split_class_counts"] = (
        f"{BASE},\nf as (select *, category as label from cls where koi_period is not null and koi_prad is not null "
        "and koi_period between 0.1::double and 10000.0::double and koi_prad between 0.1::double and 1000.0::double "
        "and coalesce(category, '') not in ('no_result') and coalesce(disp_cat_, '') not in ('confirmed_planet')),\n"
        f"s as (select label, {split} as split from f)\n"
        "select split, label, count(*) as n, case split when 'train' then 10 when 'val' then 3 when 'test' then 3 else 0 end "
        "as min_required, count(*) >= (case split when 'train' then 10 when 'val' then 3 when 'test' then 3 else 0 end) "
        "as meets_min from s group by split, label")
    fbucket = "(('0x' || substr(md5('1337:fold' || cast(star_id as string)), 1, 8))::bigint / 4294967296.0::double)"
    q["kfold"] = f"{BASE}\nselect object_id, star_id, cast(floor({fbucket} * 5.0::double) as int) as fold from cls"
    q["temporal_split"] = (f"with {KOI} select object_id, case when cast(discovery_date as date) <= date '2014-12-31' "
                           "then 'train' when cast(discovery_date as date) <= date '2016-12-31' then 'val' else 'test' end "
                           "as split from koi_full")
    q["class_weights"] = (f"{BASE},\nc as (select category as label, count(*) as n_class from cls group by category),\n"
                          "t as (select sum(n_class) as n, count(*) as k from c)\n"
                          f"select label, n_class, {r6('(cast(t.n as double) / (cast(t.k as double) * n_class))')} "
                          "as weight from c, t")
    q["oversample"] = (f"{BASE},\ns as (select object_id, category as label, {split} as split from cls)\n"
                       "select object_id, label, split, unnest(range(0, case when split = 'train' and label in "
                       "('anomalous_signal', 'no_result') then 3 else 1 end)) as copy from s")
    q["keep_together"] = (f"{BASE},\ns as (select object_id, category as label, {split} as split from cls)\n"
                          "select object_id, label, case when label in ('anomalous_signal', 'no_result') then 'train' "
                          "else split end as split, cast(0 as bigint) as copy from s")
    under = "(('0x' || substr(md5('1337:under' || object_id), 1, 8))::bigint / 4294967296.0::double)"
    q["undersample"] = (f"{BASE},\ns as (select object_id, category as label, {split} as split from cls),\n"
                        "c as (select label, count(*) as n from s where split = 'train' group by label),\n"
                        "f as (select label, greatest((select min(n) from c)::double / n, 0.2::double) as share from c)\n"
                        f"select object_id, s.label, split from s left join f on s.label = f.label "
                        f"where split <> 'train' or {under} < share")
    q["stratified_split"] = (
        f"{BASE},\nr as (select object_id, star_id, category as label from cls),\n"
        "c as (select star_id, label, count(*) as n from r group by star_id, label),\n"
        f"g as (select star_id, arg_min(label, label) filter (where n = m) as class, sum(n) as rows_, any_value({bucket}) as b "
        "from (select *, max(n) over (partition by star_id) as m from c) group by star_id),\n"
        "h as (select star_id, (sum(rows_) over (partition by class order by b, star_id) - rows_)::double "
        "/ sum(rows_) over (partition by class) as share from g)\n"
        f"select object_id, star_id, label, case when share < 0.7::double then 'train' when share < {d(0.7 + 0.15)} "
        "then 'val' else 'test' end as split from r join h using (star_id)")
    q["split_index"] = (
        f"{BASE}\nselect {split} as split, object_id from cls where koi_period is not null and koi_prad is not null "
        "and koi_period between 0.1::double and 10000.0::double and koi_prad between 0.1::double and 1000.0::double "
        "and coalesce(category, '') not in ('no_result') and coalesce(disp_cat_, '') not in ('confirmed_planet')")
    q["ordinal_ids"] = ("select count(*) as n, count(*) as n_ids, cast(0 as bigint) as first, count(*) - 1 as last from lineitem")
    q["baseline_test_rows"] = (
        f"{report_cte()},\nt as (select case when upper(trim(koi_disposition)) = 'CONFIRMED' then 'confirmed_planet' "
        "when upper(trim(koi_disposition)) = 'CANDIDATE' then 'candidate' "
        "when upper(trim(koi_disposition)) = 'FALSE POSITIVE' then 'likely_false_positive' end as label, "
        f"{split} as split from cls)\n"
        "select algorithm, label, cast(count(*) as bigint) as n from t, "
        "(select unnest(['logistic_regression', 'random_forest', 'gradient_boosting']) as algorithm) "
        "where label is not null and split = 'test' group by algorithm, label")
    cm = (f"{report_cte()},\ncm as (select case when upper(trim(koi_disposition)) = 'CONFIRMED' then 'confirmed_planet' "
          "when upper(trim(koi_disposition)) = 'CANDIDATE' then 'candidate' "
          "when upper(trim(koi_disposition)) = 'FALSE POSITIVE' then 'likely_false_positive' end as label, "
          "category as prediction from rpt)")
    q["confusion_matrix"] = (f"{cm}\nselect label, prediction, count(*) as n from cm "
                             "where label is not null and prediction is not null group by label, prediction")
    q["macro_metrics"] = (
        f"{cm},\nm as (select label, prediction, count(*) as n from cm where label is not null and prediction is not null "
        "group by label, prediction),\n"
        "cls_ as (select label as c from m union select prediction from m),\n"
        "pc as (select c, coalesce((select sum(n) from m where label = c and prediction = c), 0) as tp, "
        "coalesce((select sum(n) from m where label = c), 0) as actual, "
        "coalesce((select sum(n) from m where prediction = c), 0) as predicted from cls_),\n"
        "pr as (select *, case when predicted > 0 then tp / predicted else 0.0 end as p, "
        "case when actual > 0 then tp / actual else 0.0 end as r from pc)\n"
        f"select {r6('(sum(tp) / sum(actual))')} as accuracy, {r6('avg(p)')} as macro_precision, "
        f"{r6('avg(r)')} as macro_recall, "
        f"{r6('avg(case when p + r > 0 then 2 * p * r / (p + r) else 0.0 end)')} as macro_f1, "
        "count(*) as n_classes from pr")
    return q



TRICKY = ' "},{"rows": [{'
OID = ("concat('K', cast(l_orderkey as string), '.', cast(l_linenumber as string), '-', cast(l_partkey as string), '-', "
       "cast(l_suppkey as string))")
STREAM_EVENTS = [(50, 0, "candidate", 0, 1), (100, 0, "rocky_candidate", 1, 2), (200, 0, "candidate", 0, 1),
                 (50, 0, "anomalous_signal", -5, 3), (150, 25, "candidate", -5, 3)]
BAYES_FEATURES = ("koi_period", "koi_prad", "koi_teq", "koi_insol", "koi_srad", "koi_smass")


def stream_labels() -> str:
    """The newest label by time, number and label, over all events of the three appends."""
    events = " union all ".join(
        f"select {OID} as object_id, '{label}' as label, {days} * 24 + l_linenumber as hours, {seq} as seq "
        f"from lineitem where l_partkey % {every} = {rest}" for every, rest, label, days, seq in STREAM_EVENTS)
    return (f"events as ({events}),\nnewest as (select object_id, max({{'h': hours, 's': seq, 'l': label}}) as e "
            "from events group by object_id)")


def bayes_ctes(split: str) -> str:
    """Gaussian naive Bayes in long form: grouped moments of the train rows, log densities of the test rows."""
    long = ", ".join(BAYES_FEATURES)
    return f"""{BASE},
named as (select row_number() over () as rid, object_id, {long}, {split} as split, disp_cat_ as label from cls where disp_cat_ is not null),
tr as (select label, f, x from (select label, {long} from named where split = 'train') unpivot (x for f in ({long}))),
wide as (select max(v) as v from (select var_pop(x) as v from tr group by f)),
mom as (select label as c, f, avg(x) as m, var_pop(x) + 1e-9::double * (select v from wide) as s from tr group by label, f),
prior as (select label as c, ln(count(*)::double / (select count(*) from named where split = 'train')) as lp
  from named where split = 'train' group by label),
te as (select rid, f, x from (select rid, {long} from named where split = 'test') unpivot (x for f in ({long}))),
dens as (select rid, c, sum(-0.5::double * (ln(2.0::double * pi() * s) + (x - m) * (x - m) / s)) as ld from te join mom using (f) group by rid, c),
scored as (select n.rid, p.c, p.lp + coalesce(d.ld, 0.0::double) as lp from named n, prior p
  left join dens d on d.rid = n.rid and d.c = p.c where n.split = 'test'),
best as (select rid, max({{'p': lp, 'c': c}}).c as prediction from scored group by rid),
pred as (select object_id, label, prediction from named join best using (rid))"""


def build_stores(q: dict[str, str]) -> None:
    n = "(select count(*) from cls)"
    few = "(select count(*) from cls where category = 'candidate')"
    q["report_catalogue"] = (
        f"{BASE}\nselect '20240101_000000' as run_ts, {n} as csv_rows, {n} as json_rows, 'paired' as state, true as csv_has_bytes, "
        f"true as json_has_bytes union all select '20240201_000000', null, {n}, 'json only', null, true "
        f"union all select '20240301_000000', {few}, {few}, 'paired', true, true")
    columns = ("object_id", "koi_period", "koi_prad", "koi_teq", "koi_insol", "koi_disposition", "category", "score", "flags",
               "disposition_compare", "is_disposition_match", "color_hint")
    teq_nulls = "count_if(koi_teq is null and right(object_id, 1) not in ('7', '3'))"
    lost = "count_if(right(object_id, 1) in ('7', '3'))"
    q["report_write_counts"] = f"{report_cte()}\n" + " union all ".join(
        f"select '{c}' as column, count(*) as rows, {teq_nulls if c == 'koi_teq' else f'count_if({c} is null)'} as nulls, "
        f"{lost if c == 'koi_teq' else '0'} as non_finite from rpt" for c in columns)
    q["stream_report_sink"] = q["file_drop_stream"]
    ids = ("select object_id, koi_period, koi_prad, koi_teq, koi_insol, koi_disposition, category, score, "
           f"case when category = 'candidate' then flags || '{TRICKY}' else flags end as flags, disposition_compare, "
           "is_disposition_match, color_hint")
    q["report_documents"] = f"{report_cte()}\n{ids}, '20240101_00000' || cast(('0x' || substr(md5(object_id), 1, 1))::bigint % 4 as varchar) as run_ts from rpt"
    q["label_stream_latest"] = f"with {stream_labels()}\nselect object_id, e.l as label, cast(e.s as bigint) as seq from newest"
    q["label_stream_open_queue"] = (f"{report_cte()},\n{ITEMS},\n{ranked('q', PRIORITY_ORDER)},\n{stream_labels()}\n"
                                    "select object_id, queue_pos from q where object_id not in (select object_id from newest)")
    q["feature_table_incremental"] = q["feature_table"]
    q["search_id_index"] = (
        f"with {KOI},\nneedles as (select '-' || p_partkey || '-' as needle from part where p_partkey % 40 = 0 "
        "union select 'k' || n_nationkey from nation where n_nationkey >= 23 union select 'k' || r_regionkey from region "
        "where r_regionkey = 4)\nselect distinct needle, object_id from koi join needles on contains(lower(object_id), needle)")
    q["lookup_many_ids"] = (f"{report_cte()}\nselect * from rpt where object_id in (select {OID} from lineitem "
                            "where l_orderkey % 20 = 0 and l_linenumber = 1)")
    q["page_by_index"] = (
        f"with {KOI},\nu as (select distinct object_id from koi),\n"
        "r as (select object_id, (row_number() over (order by object_id) - 1) // 5 + 1 as page from u)\n"
        "select page, object_id from r where page in (1, 77, 1000)")
    q["queue_merge_kept"] = q["queue_merge"]
    bucket = "(('0x' || substr(md5('1337:' || cast(star_id as string)), 1, 8))::bigint / 4294967296.0::double)"
    bayes = bayes_ctes(f"case when {bucket} < 0.7::double then 'train' when {bucket} < {d(0.7 + 0.15)} then 'val' else 'test' end")
    q["naive_bayes_predictions"] = f"{bayes}\nselect object_id, label, prediction from pred"
    q["naive_bayes_confusion"] = f"{bayes}\nselect label, prediction, count(*) as n from pred group by label, prediction"
    tail = q["macro_metrics"]
    q["naive_bayes_metrics"] = bayes + ",\ncm as (select label, prediction from pred)" + tail[tail.index(",\nm as ("):]


def build_sources(q: dict[str, str]) -> None:
    q["upload_resolution"] = (
        "select 'id' as ref, 'csv' as format, count(*) as rows from part union all select 'path', 'parquet', count(*) from supplier "
        "union all select 'name', 'parquet', count(*) from supplier")
    q["upload_listing"] = (
        "select unnest(['f_20240201_000000_b', 'f_20240101_000000_a']) as file_id, unnest(['gone.csv', 'parts.csv']) as name, "
        "true as allowed, (select count(*) from part) as parts")
    q["scan_metadata"] = (
        "select 'csv' as format, count(*) as rows, 17 as cols, '|' as delimiter, true as koi_disposition_present from lineitem "
        "union all select 'parquet', count(*), 15, null, false from lineitem "
        "union all select 'preview', count(*), 15, null, false from lineitem")
    q["load_formats"] = (
        "select f.format, s.by_suffix, cast(p_partkey as bigint) as p_partkey, p_name, p_brand from part, "
        "(select unnest(['csv', 'json', 'parquet', 'orc']) as format) f, (select unnest([true, false]) as by_suffix) s")
    q["csv_encoding"] = "select cast(p_partkey as varchar) as p_partkey, 'é' || p_name || 'ÿ' as p_name from part"
    raw = ("' ._' || s_name || '/ü#' || s_suppkey || (case s_suppkey % 5 when 0 then '.CSV' when 1 then '.parquet' when 2 then '.exe' "
           "when 3 then '' else '.csv. ' end)")
    q["safe_filenames"] = (
        f"select s_suppkey, regexp_replace(regexp_replace({raw}, '[^-_.() A-Za-z0-9]', '_', 'g'), '^[._ ]+|[._ ]+$', '', 'g') as name, "
        "s_suppkey % 5 in (0, 1) as allowed from supplier")
    table_sql = q["feature_table"]
    q["feature_store_page"] = (
        f"with ft as ({table_sql}), m as (select * from ft where regexp_matches(object_id, '(?i)7\\.1-'))\n"
        "select object_id, koi_period, koi_prad, stellar_type_G, (select count(*) from m) as total from m order by object_id limit 30 offset 30")
    q["feature_store_replay"] = table_sql
    q["feature_store_lookup"] = (f"with ft as ({table_sql})\nselect * from ft where object_id = (select min(object_id) from ft) "
                                 "order by all limit 1")
    names = ",".join(NUMERIC_FEATURES) + "," + ",".join(f"stellar_type_{v}" for v in ("F", "G", "K", "M"))
    q["feature_manifest"] = (
        f"select 'v1' as feature_version, 'spark' as engine_loaded, count(*) as rows_loaded, 0.3::double as albedo, '{names}' as feature_names, "
        f"{len(NUMERIC_FEATURES)} as numeric, 6 as aliases from lineitem")
    q["sparse_onehot"] = (
        f"with {KOI} select object_id, case coalesce(stellar_type, 'K') when 'F' then 0 when 'G' then 1 when 'K' then 2 else 3 end as place, "
        '5 as width, 4 as "values" from koi')
    q["ui_order"] = f"{report_cte()}\nselect * from rpt order by object_id limit 25"
    q["page_after"] = (
        f"{report_cte()},\nl as (select min(object_id) as id from rpt where category = 'rocky_candidate')\n"
        "select rpt.* from rpt, l where score > 0.6::double or (score = 0.6::double and object_id > l.id) "
        "order by score nulls first, object_id limit 40")
    q["column_subset"] = f"{report_cte()}\nselect category, object_id, 12 as all_columns from rpt"
    q["queue_counts"] = (f"{report_cte()},\n{ITEMS},\n{LABEL_LOG}\nselect count(*) as queued, "
                         "count(*) filter (object_id not in (select object_id from label_log)) as open from items")
    q["label_append"] = f"with {LABEL_LOG}\nselect object_id, arg_max(label, seq) as label from label_log group by object_id"


ORACLE = build()
build_stores(ORACLE)
build_sources(ORACLE)
