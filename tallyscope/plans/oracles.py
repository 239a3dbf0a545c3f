"""SQL counterparts of the registered queries, for an independent engine on the same tables."""

from __future__ import annotations

from tallyscope import fixed_values as V
from tallyscope.operators import diagnostic as D
from tallyscope.operators import intelligence as I
from tallyscope.operators import predictive as P
from tallyscope.operators import prescriptive as X
from tallyscope.operators import quality as Q
from tallyscope.operators import report as R

BUSINESS = """
business as (
  select l_orderkey order_id, o_orderdate order_date, r_name region, n_name nation,
    c_mktsegment segment, o_orderpriority priority, o_orderstatus status,
    p_brand product_brand, p_type product_type,
    cast(l_quantity as decimal(18,4)) quantity,
    cast(l_discount * 100 as decimal(18,4)) discount_pct,
    cast(l_extendedprice * (1 - l_discount) as decimal(18,4)) net_revenue,
    cast(l_extendedprice * (1 - l_discount) - l_quantity * p_retailprice as decimal(18,4)) profit,
    l_linenumber line_no
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
    join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
    join part on l_partkey = p_partkey)"""

DIRTY = BUSINESS + """,
marked as (
  select order_id, line_no, order_date,
    case when order_id % 17 = 0 then null when order_id % 19 = 0 then '   '
      else ' ' || segment || ' ' end segment,
    case when order_id % 23 = 0 then 'n/a'
      else cast(cast(round(quantity) as bigint) as varchar) end quantity_text,
    strftime(order_date, '%m/%d/%Y') order_day,
    case when order_id % 29 = 0 then null else net_revenue end net_revenue,
    discount_pct, profit, region
  from business),
dirty as (select * from marked union all select * from marked where order_id % 50 = 0)"""

EVENTS = """
events_view as (select event_type, ts, cast(value as decimal(18,4)) as value from events)"""

# name, kind for the two wide views, in schema order
BUSINESS_COLUMNS = (
    ("order_id", "numeric"), ("order_date", "datetime"), ("region", "text"), ("nation", "text"),
    ("segment", "text"), ("priority", "text"), ("status", "text"), ("product_brand", "text"),
    ("product_type", "text"), ("quantity", "numeric"), ("discount_pct", "numeric"),
    ("net_revenue", "numeric"), ("profit", "numeric"), ("line_no", "numeric"),
)
DIRTY_COLUMNS = (
    ("order_id", "numeric"), ("line_no", "numeric"), ("order_date", "datetime"),
    ("segment", "text"), ("quantity_text", "text"), ("order_day", "text"),
    ("net_revenue", "numeric"), ("discount_pct", "numeric"), ("profit", "numeric"),
    ("region", "text"),
)


def f2(x: str) -> str:
    return f"printf('%.2f', {x})"


def round2(x: str) -> str:
    return f"cast(printf('%.2f', {x}) as double)"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def message(template: str, *args: str) -> str:
    """printf over text arguments; whole numbers are passed as text too."""
    if not args:
        return quote(template.replace("%%", "%"))
    return f"printf({quote(template.replace('%d', '%s'))}, {', '.join(f'cast({a} as varchar)' for a in args)})"


def words(name: str, values) -> str:
    return f"regexp_matches({name}, '{'|'.join(values)}')"


# --- columns and intelligence ----------------------------------------------------------------


def stats_cte(view: str, columns) -> str:
    parts = []
    for i, (c, kind) in enumerate(columns):
        text = kind == "text"
        parsed = f"try_strptime(trim({c}), '%m/%d/%Y')" if text else c if kind == "datetime" else "null::timestamp"
        clean = f"nullif(trim({c}), '')" if text else c
        number = (
            f"count(*) filter (regexp_matches(trim({c}), '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$'))"
            if text
            else f"count({c})" if kind == "numeric" else "0"
        )
        bucket = (
            "datetime"
            if kind == "datetime" or c == "order_day"
            else "numeric" if kind == "numeric" else "categorical"
        )
        parts.append(
            f"""select {i} ordinal, '{c}' column_name, '{c}' norm_name, '{bucket}' bucket,
            count(*) n_rows, count({c}) non_null, count({clean}) non_empty,
            count(distinct {c}) n_distinct,
            count(distinct case when {clean} is not null then {c} end) n_distinct_non_empty,
            count(distinct {clean}) n_distinct_clean, {number} numeric_ok, count({parsed}) date_ok,
            min({parsed}) min_at, max({parsed}) max_at,
            coalesce(date_sub('day', min({parsed}), max({parsed})), 0) depth_days,
            count(distinct {parsed}) n_times, count(distinct cast({parsed} as date)) n_days,
            count(distinct date_trunc('month', {parsed})) n_months from {view}"""
        )
    return "stats as (" + " union all ".join(parts) + ")"


STATS_SELECT = """
select cast(ordinal as bigint) ordinal, column_name, norm_name, bucket, cast(n_rows as bigint) n_rows,
  non_null, non_empty, n_distinct, n_distinct_non_empty, n_distinct_clean,
  cast(numeric_ok as bigint) numeric_ok, date_ok, min_at, max_at,
  cast(depth_days as bigint) depth_days, n_times, n_days, n_months from stats"""


def metric_rule(business_words) -> str:
    unique = "(n_distinct::double / greatest(non_null, 1))"
    name, lucky = "norm_name", words("norm_name", business_words)
    exact = ", ".join(quote(n) for n in V.IDENTIFIER_NAMES)
    identifier = (
        f"({name} in ({exact}) or {name} like '%\\_id' escape '\\' or "
        f"({words(name, V.IDENTIFIER_PARTS)} and not {lucky}) or "
        f"(n_rows >= 20 and {unique} >= 0.98 and not {lucky}))"
    )
    return (
        f"(bucket = 'numeric' and non_null::double / n_rows >= 0.6 and n_distinct >= 2"
        f" and not {identifier} and ({lucky} or {unique} < 0.95))"
    )


DIMENSION_RULE = (
    "(bucket = 'categorical' and non_empty > 0 and non_empty::double / n_rows >= 0.5"
    " and n_distinct_clean between 2 and least(24, greatest(n_rows // 2, 2))"
    " and n_distinct_clean::double / non_empty < 0.95)"
)
TREND_RULE = "(bucket = 'datetime' and date_ok::double / n_rows >= 0.75 and n_times >= 2)"
FORECAST_DATE_RULE = "(bucket = 'datetime' and date_ok::double / n_rows >= 0.8 and n_times >= 6)"
PRIORITY = (
    "case "
    + " ".join(
        f"when contains(norm_name, '{w}') then {i}" for i, w in enumerate(V.FORECAST_PRIORITY)
    )
    + f" else {len(V.FORECAST_PRIORITY)} end"
)
USABLE_NUMERIC = "(bucket = 'numeric' and non_null::double / n_rows >= 0.6 and n_distinct >= 2)"
PERIODS = "(case when depth_days >= 45 then n_months else n_days end)"
RATE = "(case when non_empty > 0 then date_ok::double / non_empty else 0 end)"
USABLE_DIMENSION = (
    "((bucket = 'categorical' and non_empty::double / n_rows >= 0.6 and n_distinct_non_empty between 2"
    " and greatest(25, floor(n_rows * 0.5)) and n_distinct_non_empty::double / non_empty <= 0.9)"
    f" or (bucket = 'datetime' and {RATE} >= 0.75 and {PERIODS} >= 2))"
)


def listed(rule: str, order: str = "ordinal") -> str:
    return f"(select coalesce(list(column_name order by {order}), []::varchar[]) from stats where {rule})"


def any_column(rule: str) -> str:
    return f"(select coalesce(bool_or({rule}), false) from stats)"


def facts_cte() -> str:
    numeric = "bucket = 'numeric'"
    dates_last = "case when bucket = 'datetime' then 1 else 0 end, ordinal"
    candidate = f"(bucket = 'datetime' or {words('norm_name', V.DATE_WORDS)})"
    target = f"({numeric} and {words('norm_name', V.OUTCOME_WORDS)})"
    points = V.TYPE_POINTS
    fired = {
        "date": "date_column_present", "revenue": "revenue_like_column_detected",
        "id": "id_column_detected", "category": "category_dimension_detected",
        "target": "target_like_numeric_outcome_detected",
        "customer_words": any_column(words("norm_name", V.CUSTOMER_TYPE_WORDS)),
        "support_words": any_column(words("norm_name", V.SUPPORT_TYPE_WORDS)),
        "marketing_words": any_column(words("norm_name", V.MARKETING_TYPE_WORDS)),
        "single_date": (
            "((select count(*) from stats where bucket = 'datetime') = 1 and"
            " (select count(*) from stats where bucket = 'numeric') <= 2)"
        ),
        "categories_and_revenue": (
            "((select count(*) from stats where bucket = 'categorical') >= 2 and"
            " revenue_like_column_detected)"
        ),
        "baseline": "true",
    }
    scores = ", ".join(
        "(" + " + ".join(
            f"case when {fired[r]} then {p[i]} else 0 end" for r, p in points.items() if p[i]
        ) + f") {t}_score"
        for i, t in enumerate(V.DATASET_TYPES)
    )
    return f"""
time_best as (
  select column_name, {RATE} rate, {PERIODS} periods, depth_days from stats
  where {candidate} and ({RATE} > 0 or {PERIODS} > 0 or depth_days > 0)
  order by rate desc, periods desc, depth_days desc, case when bucket = 'datetime' then 0 else 1 end,
    ordinal limit 1),
target_best as (
  select column_name, non_null, non_null::double / n_rows ratio, {USABLE_NUMERIC} usable from stats
  where {target} and non_null > 0 order by non_null desc, ratio desc, ordinal limit 1),
e1 as (select
  (select max(n_rows) from stats) row_count, (select count(*) from stats) column_count,
  {listed(USABLE_NUMERIC)} usable_numeric, {listed(USABLE_DIMENSION, dates_last)} usable_dimensions,
  {listed(USABLE_DIMENSION + ' and ' + words('norm_name', V.ACTIONABLE_WORDS), dates_last)} actionable,
  {listed(metric_rule(V.BUSINESS_WORDS))} diagnostic_metrics, {listed(DIMENSION_RULE)} diagnostic_dimensions,
  {listed(TREND_RULE)} trend_dates,
  {listed(metric_rule(V.FORECAST_WORDS), PRIORITY + ', norm_name')} forecast_metrics,
  {listed(FORECAST_DATE_RULE)} forecast_dates,
  {any_column(candidate)} date_column_present,
  {any_column(numeric + ' and ' + words('norm_name', V.REVENUE_SIGNAL_WORDS))} revenue_like_column_detected,
  {any_column(words('norm_name', V.ID_SIGNAL_WORDS))} id_column_detected,
  {any_column(words('norm_name', V.CATEGORY_SIGNAL_WORDS))} category_dimension_detected,
  {any_column(numeric + ' and ' + words('norm_name', V.TARGET_SIGNAL_WORDS))}
    target_like_numeric_outcome_detected,
  (select count(*) from stats where {target}) target_candidates,
  (select column_name from time_best) time_column,
  coalesce((select rate from time_best), 0) time_rate,
  coalesce((select periods from time_best), 0) time_periods,
  coalesce((select depth_days from time_best), 0) time_depth,
  (select column_name from target_best) target_column,
  coalesce((select non_null from target_best), 0) target_rows,
  coalesce((select ratio from target_best), 0) target_ratio,
  coalesce((select usable from target_best), false) target_usable),
e2 as (select *, greatest(len(usable_numeric) - cast(target_usable as int), 0) + len(usable_dimensions)
  features from e1),
e3 as (select *,
  (date_column_present and time_rate >= 0.9 and time_periods >= 6 and time_depth >= 120
    and row_count >= 120) time_strong,
  (target_candidates > 0 and target_rows >= 40 and features >= 1) target_candidate,
  (target_column is not null and row_count >= 120 and target_rows >= 80 and target_ratio >= 0.75
    and features >= 3) target_strong from e2),
e4 as (select *, (len(actionable) > 0 and target_candidate) decision_candidate,
  (len(actionable) >= 2 and target_strong and target_rows >= 80 and row_count >= 120) decision_strong,
  case when len(usable_numeric) > 0 and len(usable_dimensions) > 0 then 'Ready'
    when len(usable_numeric) > 0 or len(usable_dimensions) > 0 then 'Conditional'
    else 'Not Ready' end diagnostic_status, {scores} from e3),
e5 as (select *, case when diagnostic_status = 'Not Ready' then 'Not Ready'
    when time_strong or target_strong then 'Ready'
    when row_count >= 60 and diagnostic_status = 'Ready'
      and (date_column_present or target_candidates > 0 or features >= 2) then 'Conditional'
    when row_count >= 60 and (date_column_present or target_candidates > 0) then 'Conditional'
    else 'Not Ready' end predictive_status from e4),
e as (select *, case when diagnostic_status = 'Not Ready' then 'Not Ready'
    when predictive_status = 'Ready' and decision_strong then 'Ready'
    when diagnostic_status = 'Ready' and decision_candidate then 'Conditional'
    else 'Not Ready' end prescriptive_status,
  (diagnostic_status <> 'Not Ready' and len(diagnostic_metrics) > 0 and len(diagnostic_dimensions) > 0)
    diagnostic_on,
  (predictive_status <> 'Not Ready' and len(forecast_metrics) > 0 and len(forecast_dates) > 0)
    forecast_on from e5)"""


PERCENT = "printf('%.0f%%', time_rate * 100)"
# the reasons below cover the states the wide view can reach (a strong time column)
REASONS = {
    "descriptive": message(I.DESCRIPTIVE_READY, "row_count", "column_count"),
    "diagnostic": message(I.DIAGNOSTIC_READY, "len(usable_numeric)", "len(usable_dimensions)"),
    "predictive": message(
        I.PREDICTIVE_READY_TIME, "time_column", PERCENT, "time_periods", "time_depth"
    ),
    "prescriptive": message(I.PRESCRIPTIVE_READY, "len(actionable)"),
}


# tables profiled together: name, columns with their kinds in schema order
TABLE_COLUMNS = {
    "region": "r_regionkey numeric, r_name text",
    "nation": "n_nationkey numeric, n_name text, n_regionkey numeric",
    "supplier": "s_suppkey numeric, s_name text, s_nationkey numeric, s_acctbal numeric",
    "customer": "c_custkey numeric, c_name text, c_nationkey numeric, c_acctbal numeric, c_mktsegment text",
    "part": "p_partkey numeric, p_name text, p_brand text, p_type text, p_size numeric, p_retailprice numeric",
    "orders": "o_orderkey numeric, o_custkey numeric, o_orderstatus text, o_totalprice numeric,"
    " o_orderdate datetime, o_orderpriority text",
    "lineitem": "l_orderkey numeric, l_partkey numeric, l_suppkey numeric, l_linenumber numeric, l_quantity numeric,"
    " l_extendedprice numeric, l_discount numeric, l_tax numeric, l_returnflag text, l_linestatus text,"
    " l_shipdate datetime",
    "events": "event_id numeric, ts datetime, user_id numeric, event_type text, value numeric, props text",
    "labels": "doc_id numeric, quality numeric, toxic numeric",
}

# The texts of every state, written out here so that a changed text in the library shows.
_GAPS = f"""array_to_string(list_filter([
  case when row_count < 60 then 'only ' || row_count || ' rows are available for pre-modeling checks' end,
  case when diagnostic_status <> 'Ready'
    then 'measurable fields and slice dimensions are not both established yet' end,
  case when not date_column_present then 'no reliable datetime structure was confirmed'
    when not time_strong then 'time depth is not strong enough yet for trustworthy forecasting-style readiness' end,
  case when target_candidates = 0 then 'no plausible target-like outcome column was detected'
    when not target_strong then 'the best outcome candidate has ' || target_rows || ' valid rows with ' || features
      || ' supporting feature(s)' end], lambda x: x is not null), ', ')"""
_SIGNALS = f"""coalesce(nullif(array_to_string(list_filter([
  case when date_column_present then 'datetime evidence is partial (' || {PERCENT} || ' parse success across '
    || time_periods || ' time periods)' end,
  case when target_candidates > 0 then target_candidates || ' plausible target-like column(s) were detected' end],
  lambda x: x is not null), '; '), ''), 'some early modeling signals exist')"""
_CAUTION = """case when predictive_status <> 'Ready'
  then ', predictive evidence is still being treated conservatively' else '' end"""
STATE_REASONS = {
    "descriptive": """'The dataset is valid tabular data with ' || row_count || ' rows and ' || column_count
  || ' columns, so descriptive summaries and KPI reporting can be trusted.'""",
    "diagnostic": """case
  when len(usable_numeric) > 0 and len(usable_dimensions) > 0 then 'The dataset has ' || len(usable_numeric)
    || ' measurable field(s) and ' || len(usable_dimensions)
    || ' usable dimension(s), which supports slice-and-compare diagnostics.'
  when len(usable_numeric) > 0 then 'The dataset has ' || len(usable_numeric)
    || ' measurable field(s), but it still needs a reliable dimension for meaningful drill-down analysis.'
  when len(usable_dimensions) > 0 then 'The dataset has ' || len(usable_dimensions)
    || ' usable dimension(s), but it still needs at least one measurable field for diagnostic comparisons.'
  else 'Diagnostic readiness is not established because measurable fields and explanatory dimensions were not'
    || ' confirmed.' end""",
    "predictive": f"""case
  when predictive_status = 'Ready' and time_strong then 'Predictive readiness is Ready because `' || time_column
    || '` parsed at ' || {PERCENT} || ', covers ' || time_periods || ' time periods, and spans ' || time_depth || ' days.'
  when predictive_status = 'Ready' then 'Predictive readiness is Ready because `' || target_column
    || '` looks like a plausible outcome with ' || target_rows || ' valid rows and ' || features
    || ' supporting feature(s).'
  when predictive_status = 'Conditional' then 'Predictive readiness is Conditional because ' || {_SIGNALS} || ', but '
    || {_GAPS} || '.'
  else 'Predictive readiness is Not Ready because ' || {_GAPS} || '.' end""",
    "prescriptive": f"""case prescriptive_status
  when 'Ready' then 'Prescriptive readiness is Ready because the dataset already shows strong outcome evidence plus '
    || len(actionable) || ' actionable decision dimension(s) for future rule logic.'
  when 'Conditional' then 'Prescriptive readiness is Conditional because ' || len(actionable)
    || ' actionable dimension(s) were detected, ' || target_rows || ' valid outcome row(s) are available' || {_CAUTION}
    || ', but stronger decision logic signals should be confirmed before anything is forced.'
  else 'Prescriptive readiness is Not Ready because ' || case when category_dimension_detected
    then 'category-style dimensions exist, but there is not yet enough trustworthy outcome evidence or actionable structure.'
    else 'the dataset does not yet show enough actionable dimensions or dependable outcome support.' end end""",
}


def on_tables(select: str) -> str:
    """The select over the facts ``e`` of each profiled table in turn."""
    parts = []
    for name, columns in TABLE_COLUMNS.items():
        pairs = [tuple(c.split()) for c in columns.split(", ")]
        parts.append(f"select '{name}' dataset, * from (with {stats_cte(name, pairs)}, {facts_cte()} {select})")
    return " union all ".join(parts)


def on_stats(select: str) -> str:
    return f"with {BUSINESS}, {stats_cte('business', BUSINESS_COLUMNS)} {select}"


def on_facts(select: str) -> str:
    return f"with {BUSINESS}, {stats_cte('business', BUSINESS_COLUMNS)}, {facts_cte()} {select}"


# --- diagnostic ------------------------------------------------------------------------------


def keys(by: tuple[str, ...], alias: str = "") -> str:
    return "".join(f"{alias}{b}, " for b in by)


def over(by: tuple[str, ...]) -> str:
    return f"partition by {', '.join(by)}" if by else ""


def groups_cte(view: str, metric: str, dimension: str, by=()) -> str:
    """tot: per group, null group included; g: usable groups with totals per key."""
    k, p = keys(by), over(by)
    return f"""
tot as (select {k}nullif(trim({dimension}), '') grp, sum({metric}) s, count({metric}) rc
  from {view} group by all),
g as (select {k}grp, s, cast(s as double) mv, rc, cast(s as double) / rc av,
  cast(sum(s) over ({p}) as double) whole, count(*) over ({p}) n
  from tot where grp is not null and rc > 0),
gs as (select *, case when whole = 0 then 0 else {round2('mv / whole * 100')} end share,
  whole / n mean_total, row_number() over ({p} order by mv desc, grp) r,
  row_number() over ({p} order by mv, grp desc) rb,
  row_number() over ({p} order by av desc, grp) re,
  row_number() over ({p} order by av, grp) rw,
  avg(av) over ({p}) mean_av from g)"""


GROUP_OUT = (
    f'grp "group", mv metric_value, rc row_count, av average_value, share share_pct,'
    f" {round2('av')} efficiency_index"
)
NUMBER = {"quantity_text": "try_cast(quantity_text as double)"}


def grouped(view_cte: str, view: str, metric: str, dimension: str, by=(), tail="", extra="") -> str:
    return (
        f"with {view_cte}, {groups_cte(view, NUMBER.get(metric, metric), dimension, by)}"
        f" select {keys(by)}{GROUP_OUT}{extra} from gs {tail}"
    )


def summary_cte(by=()) -> str:
    k = keys(by)
    group = f"group by {', '.join(by)}" if by else ""
    return f"""
sm as (select {k}any_value(whole) whole, any_value(n) n, any_value(mean_total) mean_total,
  any_value(mean_av) mean_av,
  max(grp) filter (r = 1) top, max(mv) filter (r = 1) topv, max(share) filter (r = 1) tops,
  max(grp) filter (rb = 1) bot, max(mv) filter (rb = 1) botv,
  max(grp) filter (re = 1) eff, max(av) filter (re = 1) effv,
  max(grp) filter (rw = 1) weak, max(av) filter (rw = 1) weakv from gs {group}),
al as (select {k}cast(sum(s) as double) / sum(rc) row_average from tot {group}),
su as (select *, case when botv <= 0 or topv / botv >= 2.5 then 'wide' when topv / botv >= 1.5
    then 'moderate' else 'narrow' end spread,
  case when tops >= 50 then 'high' when tops >= 30 then 'moderate' else 'low' end conc
  from sm {'join al using (' + ', '.join(by) + ')' if by else ', al'})"""


def summary_sql(metric: str, dimension: str, by=()) -> str:
    return f"""with {BUSINESS}, {groups_cte('business', metric, dimension, by)}, {summary_cte(by)}
select {keys(by)}whole total_metric_value, n group_count, top top_group, topv top_group_value,
  bot bottom_group, botv bottom_group_value, topv - botv difference_top_to_bottom,
  '{D.LOWEST_LABEL}' lowest_group_label, spread spread_classification,
  conc concentration_classification, n > 5 show_split_top_bottom, row_average,
  mean_total mean_group_total from su"""


def quantile(values: str, share: float) -> str:
    """Of a sorted list, linear between neighbours."""
    rank = f"({share} * (len({values}) - 1))::double"
    low, high = (f"{values}[{f}({rank})::int + 1]" for f in ("floor", "ceil"))
    part = f"({rank} - floor({rank}))"
    return f"case when {part} = 0 then {low} else (1 - {part}) * {low} + {part} * {high} end"


def margin_cte(dimension: str, by=()) -> str:
    k, p = keys(by), over(by)
    group = f"group by {', '.join(by)}" if by else ""
    join = f"join mc using ({', '.join(by)})" if by else ", mc"
    return f"""
mg as (select {k}nullif(trim({dimension}), '') grp, cast(sum(discount_pct) as double) / count(*) ad,
  cast(sum(profit) as double) tp from business
  where discount_pct is not null and profit is not null and nullif(trim({dimension}), '') is not null
  group by all),
msort as (select {k}list(ad order by ad) al, list(tp order by tp) tl, count(*) mn from mg {group}),
mc as (select {k}{quantile("al", 0.75)} dc, {quantile("tl", 0.5)} pc, mn from msort),
mf as (select {k}grp, ad, tp, dc, pc, row_number() over ({p} order by grp) mr from mg {join}
  where mn >= 2 and ad >= dc and tp <= pc)"""


def margin_sql(dimension: str, by=()) -> str:
    return f"""with {BUSINESS}, {margin_cte(dimension, by)}
select {keys(by)}grp "group", ad average_discount, tp total_profit, round(dc, 6) discount_cutoff,
  round(pc, 6) profit_cutoff from mf"""


def findings_cte(metric: str, dimension: str, by=()) -> str:
    """One row per key with nine texts, some null."""
    k, m = keys(by), quote(metric)
    group = f"group by {', '.join(by)}" if by else ""
    left = f"left join {{}} using ({', '.join(by)})" if by else "left join {} on true"
    gap, share = f2("topv - botv"), "printf('%.1f', tops)"
    return f"""
wk0 as (select {k}grp, r, row_number() over ({over(by)} order by r) wr from gs
  where mv < mean_total * 0.6),
wk as (select {k}string_agg(grp, ', ' order by r) weak_names from wk0 where wr <= 5 {group}),
ml as (select {k}string_agg(grp, ', ' order by mr) margin_names from mf where mr <= 3 {group}),
fi as (select {k}su.* exclude ({', '.join(by) if by else 'row_average'}), {'' if by else 'row_average, '}
  margin_names,
  {message(D.FINDING_TOP.replace('%%', '%%'), 'top', share, m, f2('topv'))} t1,
  {message(D.FINDING_LOWEST, 'bot', f2('botv'), gap)} t2,
  {message(D.FINDING_SPREAD, 'spread', gap)} t3,
  {message(D.FINDING_CONCENTRATION, 'conc', share, m)} t4,
  case when weak_names is not null then {message(D.FINDING_UNDER, 'weak_names', m)} end t5,
  {message(D.FINDING_AVERAGES, f2('mean_total'), m, f2('row_average'))} t6,
  case when n >= 2 then case when top = eff then {message(D.FINDING_ALIGNED, 'top', m)}
    else {message(D.FINDING_SPLIT, 'top', m, 'eff')} end end t7,
  case when margin_names is not null then {message(D.FINDING_MARGIN, 'margin_names')} end t8,
  case when whole <= 0 then {message(D.FINDING_WEAK_TOTAL, f2('whole'))} end t9
  from su {left.format('wk')} {left.format('ml')})"""


def unnested(frame: str, columns: int, prefix: str, by, order: str, text: str) -> str:
    """Numbered rows of the texts that are not null."""
    k = keys(by)
    items = ", ".join(f"{prefix}{i}" for i in range(1, columns + 1))
    return f"""
select {k}cast(unnest(generate_series(1, len(items))) as bigint) {order}, unnest(items) {text}
from (select {k}list_filter([{items}], lambda x: x is not null) items from {frame})"""


def findings_sql(metric: str, dimension: str, by=()) -> str:
    return (
        f"with {BUSINESS}, {groups_cte('business', metric, dimension, by)}, {summary_cte(by)},"
        f" {margin_cte(dimension, by)}, {findings_cte(metric, dimension, by)}"
        + unnested("fi", 9, "t", by, "finding_order", "finding")
    )


def trend_sql(view_cte: str, view: str, metric: str, date: str, by=(), group: str | None = None, most: int = 8) -> str:
    k, g = keys(by), f'{group} "group", ' if group else ""
    depth = f"date_sub('day', min(moment) over ({over(by)}), max(moment) over ({over(by)}))"
    limit = ""
    if group:
        limit = f"where (select count(distinct {group}) from {view}) between 2 and {most}"
    return f"""with {view_cte},
rows_ as (select {k}{group + ', ' if group else ''}{NUMBER.get(metric, metric)} m, {date} moment from {view}),
dated as (select *, {depth} depth from rows_ where m is not null and moment is not null),
grained as (select *, case when depth >= 180 then 'M' when depth >= 60 then 'W' else 'D' end frequency
  from dated)
select {k}frequency, cast(case frequency when 'M' then date_trunc('month', moment) when 'W' then
  date_trunc('week', moment) else date_trunc('day', moment) end as timestamp) period, {g}
  cast(sum(m) as double) metric_value from grained {limit} group by all"""


# --- predictive ------------------------------------------------------------------------------


def series_ctes(view: str, metric: str, date: str, by=(), complete: bool = False) -> str:
    k = keys(by)
    group = f"group by {', '.join(by)}" if by else ""
    join = f"join si using ({', '.join(by)})" if by else ", si"
    last = "where period < last_period" if complete else ""
    return f"""
si as (select {k}count({date})::double / count(*) parse_rate, count({metric})::double / count(*) metric_ratio,
  date_sub('day', min({date}), max({date})) depth,
  case when date_sub('day', min({date}), max({date})) >= 365 then 'M'
    when date_sub('day', min({date}), max({date})) >= 90 then 'W' else 'D' end grain
  from {view} {group}),
h0 as (select {k}grain, cast(case grain when 'M' then date_trunc('month', {date}) when 'W' then
    date_trunc('week', {date}) else date_trunc('day', {date}) end as timestamp) period,
  cast(sum({metric}) as double) mv from {view} {join}
  where {date} is not null and {metric} is not null group by all),
h1 as (select *, max(period) over ({over(by)}) last_period from h0),
hi as (select * exclude (last_period) from h1 {last})"""


def state_ctes(by=(), horizon: int = 6, conditional: bool = False) -> str:
    k, p = keys(by), over(by)
    group = f"group by {', '.join(by)}" if by else ""
    join = f"join si using ({', '.join(by)})" if by else ", si"
    same = " and ".join(f"st.{b} = c.{b}" for b in by) or "true"
    add = (
        "cast(case st.grain when 'M' then lp + to_months(step) when 'W' then lp + to_days(7 * step)"
        " else lp + to_days(step) end as timestamp)"
    )
    return f"""
ob as (select *, row_number() over ({p} order by period desc) b, count(*) over ({p}) n,
  min(mv) over ({p}) lowest, mv / nullif(lag(mv) over ({p} order by period), 0) - 1 change from hi),
ag as (select {k}max(n) n, min(lowest) lowest, max(period) lp, max(mv) filter (b = 1) la,
  avg(mv order by b desc) filter (b <= 5) ma, regr_slope(mv, -b) filter (b <= 5) sl, avg(mv order by b desc) filter (b <= 4) r4,
  count(*) filter (b <= 6) rn, count(change) filter (b <= 5) cc,
  stddev_samp(change) filter (b <= 5) vol,
  stddev_samp(mv) filter (b <= 6) / abs(avg(mv) filter (b <= 6)) rel from ob {group}),
st as (select *, case when vol >= 0.35 then 'volatile' when vol >= 0.15 then 'moderately variable'
    else 'stable' end label,
  (n >= 6 and {horizon} <= greatest(3, n // 2) and parse_rate >= 0.8 and metric_ratio >= 0.6) usable
  from ag {join}),
pt as (select {keys(by, 'st.')}st.grain, cast(step as bigint) step, {add} period,
  {round2("case when lowest >= 0 then greatest(ma * 0.65 + (la + sl * step) * 0.35, 0) else ma * 0.65 + (la + sl * step) * 0.35 end")} v
  from st, (select unnest(generate_series(1, {horizon})) step) where usable),
pc as (select {k}max(v) filter (step = 1) fv, avg(v) mean_v from pt {group}),
ca as (select st.*, coalesce(c.fv, 0) fv, coalesce(c.mean_v, 0) mean_v,
  case when not usable then 'Blocked'
    when abs(c.fv - la) <= greatest(abs(la) * 0.02, 1.0) then 'Flat' when c.fv > la then 'Up'
    else 'Down' end direction,
  case when not usable then 'Not Ready' else '{'Conditional' if conditional else 'Ready'}' end status
  from st left join pc c on {same})"""


def on_series(select: str, by=(), horizon=6, events=False, conditional=False) -> str:
    if events:
        head = f"{EVENTS}, {series_ctes('events_view', 'value', 'ts', by)}"
    else:
        head = f"{BUSINESS}, {series_ctes('business', 'net_revenue', 'order_date', by)}"
    return f"with {head}, {state_ctes(by, horizon, conditional)} {select}"


def volatility_reason() -> str:
    ratio = f2("rel")
    return (
        f"case when cc = 0 then {quote(P.REASON_TOO_FEW)}"
        f" when label = 'volatile' then {message(P.REASON_VOLATILE, 'rn', ratio)}"
        f" when label = 'moderately variable' then {message(P.REASON_VARIABLE, 'rn', ratio)}"
        f" else {message(P.REASON_STABLE, 'rn', ratio)} end"
    )


def forecast_texts(conditional: bool) -> str:
    """A frame ft with six texts per key."""
    caution = quote(P.FINDING_CONDITIONAL) if conditional else "null"
    return f"""
ft as (select *,
  case when usable then {message(P.FINDING_DIRECTION, 'lower(direction)', f2('fv'), f2('la'), f2('r4'))}
    else {quote(P.FINDING_BLOCKED)} end p1,
  case when usable then {message(P.FINDING_AVERAGE, f2('mean_v'), f2('la'))} end p2,
  case when usable then {message(P.FINDING_VOLATILITY, 'label', volatility_reason())} end p3,
  case when usable then {caution} end p4,
  case when usable and n < 9 then {message(P.FINDING_SHORT, 'n')} end p5,
  case when usable and parse_rate < 0.95 then
    {message(P.FINDING_PARSE, "printf('%.0f%%', parse_rate * 100)")} end p6 from ca)"""


def forecast_findings_sql(by=(), events=False, conditional=False) -> str:
    tail = unnested("ft", 6, "p", by, "finding_order", "finding")
    return on_series(", " + forecast_texts(conditional) + tail, by, 6, events, conditional)


PROJECTION = "step, period, strftime(period, '%Y-%m-%d') label, v metric_value from pt"
CARDS = (
    "status, n historical_periods_used, cast(6 as bigint) forecast_horizon, la latest_actual_value,"
    " fv first_forecast_value, round(mean_v, 6) projected_average_forecast_value,"
    " direction projected_direction from ca"
)
VOLATILITY = (
    "rn recent_periods, round(vol, 6) volatility_score, round(rel, 6) relative_std, label volatility from st"
)


# --- prescriptive ----------------------------------------------------------------------------

RULE_METRIC, RULE_DIMENSION, RULE_FORECAST = "quantity", "region", "net_revenue"


def rules_ctes(by=()) -> str:
    """re: the fired rules of the wide view (quantity by region, forecast of net_revenue)."""
    m, dim, fm = quote(RULE_METRIC), quote(RULE_DIMENSION), quote(RULE_FORECAST)
    share, gap = "printf('%.1f', tops)", f2("topv - botv")
    up, down = "direction = 'Up'", "direction = 'Down'"
    join = f"join ft using ({', '.join(by)})" if by else ", ft"
    specs = [
        ("concentration_high", "conc = 'high'", X.RISK, "'High'", "top", X.FROM_DIAGNOSTIC,
         ("top", share, m), ("top", dim)),
        ("concentration_moderate", "conc = 'moderate'", X.RISK, "'Medium'", "top", X.FROM_DIAGNOSTIC,
         ("top", dim, share, m), (dim,)),
        ("spread_wide", "spread = 'wide'", X.GROWTH, "'High'", "bot", X.FROM_DIAGNOSTIC, (gap, m),
         ("bot",)),
        ("spread_moderate", "spread = 'moderate'", X.GROWTH, "'Medium'", "bot", X.FROM_DIAGNOSTIC,
         ("bot", gap, m), (dim, "bot")),
        ("weak_mean", "weakv < mean_av * 0.75", X.EFFICIENCY, "'Medium'", "weak", X.FROM_DIAGNOSTIC,
         ("weak", f2("weakv"), f2("mean_av")), ("weak",)),
        ("efficient_follower", "eff <> top", X.GROWTH, "'Medium'", "eff", X.FROM_DIAGNOSTIC,
         ("eff", f2("effv")), ("eff",)),
        ("margin", "margin_names is not null", X.EFFICIENCY, "'High'", "margin_names",
         X.FROM_DIAGNOSTIC, "t8", ()),
        ("outlook_weak", f"usable and ({down} or direction = 'Flat')", X.RISK,
         f"case when {down} then 'High' else 'Medium' end", quote(X.WHOLE_SERIES), X.FROM_FORECAST,
         ("lower(direction)", f2("fv"), f2("la")), (fm,)),
        ("outlook_up", f"usable and {up}", X.GROWTH, "'Medium'", quote(X.WHOLE_SERIES),
         X.FROM_FORECAST, (f2("fv"), f2("la")), (fm,)),
        ("unstable", "usable and label = 'volatile'", X.MONITORING, "'Medium'",
         quote(X.WHOLE_SERIES), X.FROM_FORECAST, "p3", (fm,)),
        ("dominant_down", f"conc = 'high' and usable and {down}", X.RISK, "'High'", "top",
         X.FROM_BOTH, ("top",), ()),
        ("concentrated_unstable", "conc in ('high', 'moderate') and usable and label = 'volatile'",
         X.RISK, "case when conc = 'high' then 'High' else 'Medium' end", "top", X.FROM_BOTH,
         ("top",), ()),
        ("uneven_growth", f"spread = 'wide' and {up}", X.GROWTH, "'Medium'", "bot", X.FROM_BOTH,
         ("bot",), ("bot",)),
    ]
    selects = []
    for i, (key, fires, category, priority, affected, basis, evidence, action) in enumerate(specs):
        shown = evidence if isinstance(evidence, str) else message(X.EVIDENCE[key], *evidence)
        selects.append(
            f"select {keys(by)}{i} rule_order, {quote(category)} category, {priority} priority,"
            f" {quote(X.ISSUES[key])} issue_detected, {affected} affected_group,"
            f" {shown} supporting_evidence, {message(X.ACTIONS[key], *action)} suggested_action,"
            f" {quote(basis)} recommendation_basis from ev where {fires}"
        )
    rank = "case priority when 'High' then 1 when 'Medium' then 2 else 3 end"
    return f"""
ev as (select * from (select {keys(by)}top, topv, tops, bot, botv, eff, effv, weak, weakv, mean_av, conc, spread,
    margin_names, t1, t2, t3, t8 from fi) {join}),
fired as ({' union all '.join(selects)}),
re as (select *, row_number() over ({over(by)} order by {rank}, rule_order) rr from fired)"""


def rules_head(by=()) -> str:
    return (
        f"with {BUSINESS}, {groups_cte('business', RULE_METRIC, RULE_DIMENSION, by)}, {summary_cte(by)},"
        f" {margin_cte(RULE_DIMENSION, by)}, {findings_cte(RULE_METRIC, RULE_DIMENSION, by)},"
        f" {series_ctes('business', 'net_revenue', 'order_date', by)}, {state_ctes(by)},"
        f" {forecast_texts(False)}, {rules_ctes(by)}"
    )


def rules_sql(by=()) -> str:
    return rules_head(by) + (
        f" select {keys(by)}cast(rr as bigint) as position, category, priority, issue_detected, affected_group,"
        " supporting_evidence, suggested_action, recommendation_basis from re"
    )


def rules_summary_sql() -> str:
    counts = ", ".join(
        f"count(*) filter (category = {quote(c)}) {c.lower().replace(' ', '_')}"
        for c in (X.RISK, X.GROWTH, X.EFFICIENCY, X.MONITORING)
    ) + ", " + ", ".join(
        f"count(*) filter (recommendation_basis = {quote(b)}) {b.replace('-', '_')}"
        for b in (X.FROM_DIAGNOSTIC, X.FROM_FORECAST, X.FROM_BOTH)
    )
    return rules_head() + (
        " select count(*) total_recommendations, max(issue_detected) filter (rr = 1)"
        f" highest_priority_issue, {counts} from re"
    )


def rules_findings_sql() -> str:
    return rules_head() + f""",
pf as (select
  {quote(X.FINDING_READINESS % 'ready')} x1,
  {message(X.FINDING_ISSUE, "lower((select issue_detected from re where rr = 1))")} x2,
  {message(X.FINDING_COVERAGE, "(select string_agg(c, ', ' order by c) from (select distinct category c from re))")} x3,
  (select case when count(*) > 0 then {message(X.FINDING_COMBINED, 'count(*)')} end from re
    where recommendation_basis = '{X.FROM_BOTH}') x4,
  case when usable then {message(X.FINDING_OUTLOOK, 'lower(direction)')} else {quote(X.FINDING_LIMITED)} end x5
  from ft)""" + unnested("pf", 5, "x", (), "finding_order", "finding")


# --- report ----------------------------------------------------------------------------------


def report_ctes(by=()) -> str:
    """rl: the report rows per key (section order, item order, item), built after the rules."""
    k = keys(by)
    flat = [
        (1, 1, "'Duplicate rows detected: ' || (select count(*) - count(distinct b) from business b)"),
        (1, 2, "'Columns with missing values: 0'"),
        *[(1, 3 + i, quote(a)) for i, a in enumerate(Q.SHORT_ACTIONS[:3])],
        (2, 1, "'Numeric columns: 6'"), (2, 2, "'Categorical columns: 7'"),
        (2, 3, "'Datetime columns: 1'"),
        (2, 4, "'Example numeric fields: order_id, quantity, discount_pct, net_revenue, profit'"),
        (3, 1, "'Detected dataset type: Transactional'"),
        (3, 2, "'Readiness states: Descriptive=Ready, Diagnostic=Ready, Predictive=Ready, Prescriptive=Ready'"),
        (3, 3, quote("Business signals: " + ", ".join(I.SIGNAL_LABELS.values()))),
        (4, 1, "'Total rows: ' || (select count(*) from business)"), (4, 2, "'Total columns: 14'"),
        (4, 3, "'Dataset name: business'"), (4, 4, "'File size: Unknown'"),
        (5, 1, f"'Primary metric reviewed: {RULE_METRIC}'"),
        (5, 2, f"'Primary dimension reviewed: {RULE_DIMENSION}'"),
        (5, 3, "'Leading group: ' || top"), (5, 4, "'Lowest-contributing group: ' || bot"),
        (5, 5, "t1"), (5, 6, "t2"), (5, 7, "t3"),
        (6, 1, "'Forecast status: ' || status"), (6, 2, f"'Forecast metric: {RULE_FORECAST}'"),
        (6, 3, "'Projected direction: ' || direction || ' (directional only when readiness is conditional)'"),
        (6, 4, "'Historical periods used: ' || n"), (6, 5, "p1"), (6, 6, "p2"), (6, 7, "p3"),
    ]
    match = " and ".join(f"re.{b} = ev.{b}" for b in by) or "true"
    fired = f"(select {{}} from re where {match})"
    flat += [
        (7, 1, "'Prescriptive status: Ready'"),
        (7, 2, "'Recommendations triggered: ' || " + fired.format("count(*)")),
        (7, 3, "'Highest-priority issue: ' || " + fired.format("max(issue_detected) filter (rr = 1)")),
        (7, 4, quote(X.FINDING_READINESS % "ready")),
        (7, 5, message(X.FINDING_ISSUE, "lower(" + fired.format("max(issue_detected) filter (rr = 1)") + ")")),
        (7, 6, message(X.FINDING_COVERAGE, fired.format("string_agg(distinct category, ', ' order by category)"))),
    ]
    titles = "case s " + " ".join(f"when {i + 1} then {quote(t)}" for i, t in enumerate(R.TITLES)) + " end"
    rows = " union all ".join(f"select {k}{s} s, {i} i, {x} item from ev" for s, i, x in flat)
    return f"""
rl0 as ({rows} union all select {k}8, rr, 'Category: ' || category || ' | Priority: ' || priority ||
  ' | Issue: ' || issue_detected || ' | Action: ' || suggested_action from re where rr <= 5),
rl as (select {k}cast(s as bigint) section_order, {titles} section, cast(i as bigint) item_order, item
  from rl0)"""


def report_text_sql(by=(), generated: str = "'2001-08-01 00:00:00'") -> str:
    k = keys(by)
    return rules_head(by) + f", {report_ctes(by)}" + f""",
se as (select {k}section_order, any_value(section) || chr(10) || repeat('-', length(any_value(section))) || chr(10)
  || string_agg('- ' || item, chr(10) order by item_order) body from rl group by {k}section_order)
select {k}'{R.DEFAULT_TITLE}' || chr(10) || 'Dataset: business' || chr(10)
  || 'Generated: ' || {generated} || chr(10) || chr(10)
  || string_agg(body, chr(10) || chr(10) order by section_order) || chr(10) report from se""" + (
        f" group by {', '.join(by)}" if by else ""
    )


def facts_told(by=()) -> str:
    """fa: the few facts per key, numbered."""
    k = keys(by)
    outlook = message(R.OUTLOOK_LINE, "direction", f2("fv"), f2("la"))
    rows = [
        ("Dataset type", "'transactional'"),
        ("KPI", "'Rows: ' || (select count(*) from business)"), ("KPI", "'Columns: 14'"),
        ("KPI", "'Duplicate rows: ' || (select count(*) - count(distinct b) from business b)"),
        ("Diagnostic", "t1"), ("Diagnostic", "t2"), ("Diagnostic", "t3"),
        ("Predictive direction", outlook),
    ]
    selects = " union all ".join(
        f"select {k}cast({i + 1} as bigint) fact_order, {quote(kind)} kind, {x} fact from ev"
        for i, (kind, x) in enumerate(rows)
    )
    return rules_head(by) + (
        f", fa as ({selects} union all select {k}cast({len(rows)} + rr as bigint), 'Recommendation', priority ||"
        " ' priority: ' || issue_detected || '. Action: ' || suggested_action from re where rr <= 2)"
    )


def summaries(by=()) -> str:
    """fs: the same facts as one text per key."""
    group = f" group by {', '.join(by)}" if by else ""
    return facts_told(by) + f""",
fs as (select {keys(by)}'Compact fallback summary' || chr(10) || chr(10)
  || string_agg('- ' || kind || ': ' || fact, chr(10) order by fact_order) summary from fa{group})"""


# --- narrative -------------------------------------------------------------------------------

STORIES = r"""
parts as (select doc_id, string_split(text, chr(10)) l from documents),
story as (select doc_id, concat_ws(chr(10),
  'ExecutiveSummary:', '- ' || l[1], '- ' || l[1], '', 'Key Insights :',
  case when len(l) >= 2 then '* ' || array_to_string(l[2:5], chr(10) || '* ') end, '## Risks',
  case when len(l) >= 6 then '1. ' || array_to_string(l[6:8], chr(10) || '2.  ') end,
  'RecommendedActions:',
  case when len(l) >= 9 then '- ' || array_to_string(l[9:], ' ..' || chr(10) || '-') end) narrative
  from parts),"""

# story (doc_id, narrative) to kept items
NARRATIVE_STEPS = r"""
c1 as (select doc_id, regexp_replace(regexp_replace(replace(replace(narrative, chr(13) || chr(10), chr(10)),
  chr(13), chr(10)), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g') t from story),
c2 as (select doc_id, regexp_replace(regexp_replace(t, '(?m)^[-*•]\s*', '- ', 'g'),
  '(?m)^([A-Z])([a-z]+)([A-Z][a-z]+):\s*$', '\1\2 \3:', 'g') t from c1),
raw as (select doc_id, unnest(generate_series(1, len(string_split(t, chr(10))))) pos,
  trim(unnest(string_split(t, chr(10)))) line from c2),
tidy as (select doc_id, pos, regexp_replace(regexp_replace(line, '\s+([,.;:])', '\1', 'g'),
  '([:;,.!?]){2,}', '\1', 'g') line from raw),
fixed as (select doc_id, pos, case lower(rtrim(line, ':')) when 'executivesummary' then 'Executive Summary:'
  when 'keyinsights' then 'Key Insights:' when 'recommendedactions' then 'Recommended Actions:'
  when 'risks' then 'Risks:' else line end line from tidy),
marks as (select *, case lower(rtrim(trim(trim(trim(trim(line), '#'), '-')), ':'))
  when 'executive summary' then 1 when 'key insights' then 2 when 'risks' then 3
  when 'recommended actions' then 4 end heading from fixed where line <> ''),
placed as (select *, coalesce(last_value(heading ignore nulls) over (partition by doc_id order by pos
  rows between unbounded preceding and current row), 2) sec from marks),
content as (select doc_id, pos, sec, trim(regexp_replace(regexp_replace(regexp_replace(
  trim(ltrim(line, '-* ')), '^\d+\.\s*', ''),
  '(?i)^(executive summary|key insights|risks|recommended actions)\s*:\s*', ''), '\s+', ' ', 'g'), ' -') c
  from placed where heading is null),
upped as (select doc_id, pos, sec, upper(c[1]) || c[2:] c,
  trim(regexp_replace(lower(c), '[^a-z0-9]+', ' ', 'g')) norm from content where c <> ''),
firsts as (select * from upped where norm <> ''
  qualify row_number() over (partition by doc_id, sec, norm order by pos) = 1),
capped as (select *, row_number() over (partition by doc_id, sec order by pos) k from firsts
  qualify k <= case sec when 1 then 1 when 2 then 3 when 3 then 2 else 3 end),
names as (select unnest([1, 2, 3, 4]) sec, unnest(['Executive Summary', 'Key Insights', 'Risks',
  'Recommended Actions']) title),
flat as (select doc_id, sec, 0 k, title item from (select distinct doc_id, sec from capped) join names using (sec)
  union all select doc_id, sec, k, c from capped),
items as (select doc_id, row_number() over (partition by doc_id order by sec, k) as position, item from flat),
told as (select doc_id, position, item from items where item not in (select title from names)),
uniq as (select *, trim(regexp_replace(lower(item), '[^a-z0-9]+', ' ', 'g')) norm from told
  qualify row_number() over (partition by doc_id, norm order by position) = 1)"""

NARRATIVE = STORIES + NARRATIVE_STEPS

# the counts behind the verdict on each text
NARRATIVE_QUALITY = """,
judged as (select doc_id, len(regexp_extract_all(item, '\\p{L}'))::double / length(item) < 0.45
  or length(item) < 8 or exists (select 1 from generate_series(1, length(item) - 4) g(i)
    where item[i:i+4] = repeat(item[i:i], 5)) bad from uniq),
counted as (select d.doc_id, count(j.doc_id) u, count(*) filter (bad) m
  from story d left join judged j on d.doc_id = j.doc_id group by d.doc_id)
"""

QUALITY_SELECT = """ select doc_id, u unique_count, m malformed_count, u >= 2 and m < greatest(2, u // 2) passes,
  case when u = 0 then 'No usable AI content was produced.'
    when u < 2 then 'AI output is too thin to include in the report.'
    when m >= greatest(2, u // 2) then 'AI output looks malformed after cleanup.' else '' end reason
from counted"""


def oracle_sql() -> dict[str, str]:
    nation, region = ("nation",), ("region",)
    columns_out = "select cast(ordinal as bigint) ordinal, column_name from stats where "
    ranked = ", cast(r as bigint) rank"
    top, bottom = ", cast(r as bigint) as position", ", cast(rb as bigint) as position"
    text = "cast({0} as varchar) {0}"
    csv_columns = ", ".join(
        text.format(c) for c in ("order_id", "line_no", "segment", "order_day", "net_revenue",
                                 "discount_pct", "profit", "region")
    )
    csv_types = {"order_id": "bigint", "line_no": "bigint", "order_date": "string", "segment": "string",
                 "quantity_text": "bigint", "order_day": "string", "net_revenue": "double",
                 "discount_pct": "double", "profit": "double", "region": "string"}
    csv_union = " union all ".join(
        f"select cast({i} as bigint) ordinal, '{c}' column_name, '{t}' data_type, "
        + ("count(nullif(quantity_text, 'n/a'))" if c == "quantity_text" else f"count({c})")
        + " non_null from dirty"
        for i, (c, t) in enumerate(csv_types.items())
    )
    distinct = "(select count(*) from (select distinct * from dirty))"
    missing = " union all ".join(
        f"select '{c}' column_name, count(*) - count({c}) missing_count, count(*) n from dirty"
        for c, _ in DIRTY_COLUMNS
    )
    gaps = f"(select count(*) from ({missing}) where missing_count > 0)"
    log = [
        quote(Q.LOG_LOADED), message(Q.LOG_DUPLICATES, f"(select count(*) - {distinct} from dirty)"),
        message(Q.LOG_MISSING, gaps), quote(Q.LOG_PROFILED), message(Q.LOG_DATES, "2"),
        quote(Q.LOG_UNCHANGED),
    ]
    signals = ", ".join(
        f"case when {flag} then {quote(label)} end" for flag, label in I.SIGNAL_LABELS.items()
    )
    narrative = f"with {NARRATIVE}"
    out = {
        "csv_scan": f"""with {DIRTY} select {csv_columns},
          strftime(order_date, '%Y-%m-%d %H:%M:%S') order_date,
          nullif(quantity_text, 'n/a') quantity_text from dirty""",
        "csv_infer": f"with {DIRTY} {csv_union}",
        "csv_grouped": grouped(DIRTY, "dirty", "quantity_text", "segment"),
        "preview": f"""with {BUSINESS} select order_id, line_no, order_date, region, segment,
          cast(net_revenue as double) net_revenue from business
          order by order_id, line_no, net_revenue limit 10""",
        "dataset_summary": f"with {DIRTY} select count(*) row_count, cast(10 as bigint) column_count from dirty",
        "duplicate_rows": f"with {DIRTY} select count(*) - {distinct} duplicate_rows from dirty",
        "repeated_rows": f"""with {DIRTY},
          sets as (select count(*) copies from dirty group by {', '.join(c for c, _ in DIRTY_COLUMNS)})
          select count(*) different_rows, cast(sum(copies) as bigint) copies from sets where copies > 1""",
        "missing_summary": f"""with {DIRTY} select column_name, missing_count,
          {round2('missing_count::double / n * 100')} missing_percentage
          from ({missing}) where missing_count > 0""",
        "kpi_overview": f"""with {DIRTY} select count(*) total_rows, cast(10 as bigint) total_columns,
          count(*) - {distinct} duplicate_rows, {gaps} columns_with_missing_values from dirty""",
        "preprocessing_summary": f"""with {DIRTY} select count(*) input_rows,
          cast(10 as bigint) input_columns, count(*) - {distinct} duplicate_rows_detected,
          {gaps} columns_with_missing_values, {quote(' '.join(Q.SHORT_ACTIONS))} profiling_actions
          from dirty""",
        "quality_log": f"with {DIRTY} " + " union all ".join(
            f"select cast({i + 1} as bigint) message_order, {m} message" for i, m in enumerate(log)
        ),
        "column_profile": f"""with {DIRTY}, {stats_cte('dirty', DIRTY_COLUMNS)}
          select cast(ordinal as bigint) ordinal, column_name, norm_name, bucket from stats""",
        "column_profile_of_all": f"""with {DIRTY}, {stats_cte('dirty', DIRTY_COLUMNS)}
          select cast(ordinal as bigint) ordinal, column_name, norm_name, bucket from stats""",
        "column_stats_estimated": f"""with {DIRTY}, {stats_cte('dirty', DIRTY_COLUMNS)}
          select cast(ordinal as bigint) ordinal, column_name, bucket, cast(n_rows as bigint) n_rows, non_null, non_empty,
            cast(numeric_ok as bigint) numeric_ok, date_ok, min_at, max_at, cast(depth_days as bigint) depth_days, n_days, n_months,
            true n_distinct_close, true n_distinct_non_empty_close, true n_distinct_clean_close, true n_times_close
          from stats""",
        "column_stats": f"with {DIRTY}, {stats_cte('dirty', DIRTY_COLUMNS)} {STATS_SELECT}",
        "column_stats_business": on_stats(STATS_SELECT),
        "diagnostic_metric_columns": on_stats(columns_out + metric_rule(V.BUSINESS_WORDS)),
        "forecast_metric_columns": on_stats(
            f"select cast(ordinal as bigint) ordinal, column_name, cast({PRIORITY} as bigint) priority"
            f" from stats where {metric_rule(V.FORECAST_WORDS)}"
        ),
        "dimension_columns": on_stats(columns_out + DIMENSION_RULE),
        "trend_date_columns": on_stats(columns_out + TREND_RULE),
        "forecast_date_columns": on_stats(columns_out + FORECAST_DATE_RULE),
        "signal_flags": on_facts(f"select {', '.join(I.SIGNAL_LABELS)} from e"),
        "business_signals": on_facts(
            f""", b as (select list_filter([{signals}], lambda x: x is not null) s from e)
            select cast(unnest(generate_series(1, len(s))) as bigint) signal_order, unnest(s) signal from b"""
        ),
        "type_scores": on_facts(
            " union all ".join(
                f"select {quote(t)} dataset_type, cast({t}_score as bigint) score from e"
                for t in V.DATASET_TYPES
            )
        ),
        "dataset_type": on_facts(
            "select case when max(score) <= 2 then 'generic_tabular' else arg_min(t, -score * 10 + i) end"
            " dataset_type from ("
            + " union all ".join(
                f"select {i} i, {quote(t)} t, {t}_score score from e" for i, t in enumerate(V.DATASET_TYPES)
            )
            + ")"
        ),
        "datetime_support": on_facts(
            "select date_column_present candidate_present, time_column best_column, time_rate"
            " parse_success_rate, cast(time_periods as bigint) unique_periods,"
            " cast(time_depth as bigint) time_depth_days, time_strong strong from e"
        ),
        "target_support": on_facts(
            "select target_candidates candidate_count, target_column best_target_column,"
            " cast(target_rows as bigint) best_target_valid_rows, target_ratio best_target_valid_ratio,"
            " cast(features as bigint) feature_support_count, target_candidate candidate,"
            " target_strong strong from e"
        ),
        "decision_support": on_facts(
            "select array_to_string(actionable, ', ') actionable_dimensions, cast(target_rows as bigint)"
            " valid_outcome_rows, decision_candidate candidate, decision_strong strong from e"
        ),
        "readiness_by_table": on_tables(
            " union all ".join(
                f"select cast({i + 1} as bigint) layer_order, '{layer}' layer, "
                + ("'Ready'" if layer == "descriptive" else f"{layer}_status")
                + f" status, {reason} reason from e"
                for i, (layer, reason) in enumerate(STATE_REASONS.items())
            )
        ),
        "forecast_options_by_table": on_tables(
            "select forecast_on enabled, len(forecast_metrics) > 0 and len(forecast_dates) > 0"
            " time_series_support, array_to_string(forecast_metrics, ', ') metric_columns,"
            " forecast_metrics[1] default_metric_column, array_to_string(forecast_dates, ', ')"
            " datetime_columns, case when len(forecast_dates) = 1 then forecast_dates[1] end"
            " default_datetime_column, 'Auto, Daily, Weekly, Monthly' grain_options,"
            " '3, 6, 9, 12' horizon_options, predictive_status readiness_status,"
            f" {STATE_REASONS['predictive']} readiness_reason from e"
        ),
        "prescriptive_options_by_table": on_tables(
            "select prescriptive_status <> 'Not Ready' and (diagnostic_on or forecast_on) enabled,"
            f" prescriptive_status readiness_status, {STATE_REASONS['prescriptive']} readiness_reason,"
            " diagnostic_on diagnostic_enabled, forecast_on forecast_enabled from e"
        ),
        "dataset_type_by_table": on_tables(
            "select case when greatest(" + ", ".join(f"{t}_score" for t in V.DATASET_TYPES) + ") <= 2 then"
            " 'generic_tabular' " + " ".join(
                f"when {t}_score = greatest(" + ", ".join(f"{u}_score" for u in V.DATASET_TYPES) + f") then '{t}'"
                for t in V.DATASET_TYPES
            ) + " end dataset_type from e"
        ),
        "readiness": on_facts(
            " union all ".join(
                f"select cast({i + 1} as bigint) layer_order, '{layer}' layer, "
                + ("'Ready'" if layer == "descriptive" else f"{layer}_status")
                + f" status, {reason} reason from e"
                for i, (layer, reason) in enumerate(REASONS.items())
            )
        ),
        "diagnostic_options": on_facts(
            "select diagnostic_on enabled, array_to_string(diagnostic_metrics, ', ') metric_columns,"
            " array_to_string(diagnostic_dimensions, ', ') dimension_columns,"
            " array_to_string(trend_dates, ', ') datetime_columns,"
            " case when len(trend_dates) = 1 then trend_dates[1] end default_date_column,"
            " diagnostic_status readiness_status from e"
        ),
        "forecast_options": on_facts(
            "select forecast_on enabled, len(forecast_metrics) > 0 and len(forecast_dates) > 0"
            " time_series_support, array_to_string(forecast_metrics, ', ') metric_columns,"
            " forecast_metrics[1] default_metric_column, array_to_string(forecast_dates, ', ')"
            " datetime_columns, case when len(forecast_dates) = 1 then forecast_dates[1] end"
            " default_datetime_column, 'Auto, Daily, Weekly, Monthly' grain_options,"
            " '3, 6, 9, 12' horizon_options, predictive_status readiness_status,"
            f" {REASONS['predictive']} readiness_reason from e"
        ),
        "prescriptive_options": on_facts(
            "select prescriptive_status <> 'Not Ready' and (diagnostic_on or forecast_on) enabled,"
            f" prescriptive_status readiness_status, {REASONS['prescriptive']} readiness_reason,"
            " diagnostic_on diagnostic_enabled, forecast_on forecast_enabled from e"
        ),
        "grouped_comparison": grouped(BUSINESS, "business", "net_revenue", "segment"),
        "grouped_comparison_dirty": grouped(DIRTY, "dirty", "quantity_text", "segment"),
        "grouped_comparison_by_region": grouped(BUSINESS, "business", "net_revenue", "segment", region),
        "ranked_groups": grouped(BUSINESS, "business", "net_revenue", "nation", extra=ranked),
        "ranked_groups_by_region": grouped(
            BUSINESS, "business", "profit", "nation", region, extra=ranked
        ),
        "top_groups": grouped(
            BUSINESS, "business", "net_revenue", "nation", tail="where r <= 5", extra=top
        ),
        "top_groups_by_region": grouped(
            BUSINESS, "business", "net_revenue", "nation", region, "where r <= 2", top
        ),
        "bottom_groups": grouped(
            BUSINESS, "business", "net_revenue", "nation", tail="where rb <= 5", extra=bottom
        ),
        "diagnostic_summary": summary_sql("net_revenue", "segment"),
        "diagnostic_summary_by_region": summary_sql("net_revenue", "status", region),
        "underperformers": f"""with {BUSINESS}, {groups_cte('business', 'net_revenue', 'status')}
          select grp "group", mv metric_value, mean_total mean_group_total from gs
          where mv < mean_total * 0.6""",
        "underperformers_orders": f"""with {BUSINESS}, {groups_cte('business', 'net_revenue', 'order_id::varchar')}
          select grp "group", mv metric_value, mean_total mean_group_total from gs
          where mv < mean_total * 0.6""",
        "underperformers_orders_by_region": f"""with {BUSINESS},
          {groups_cte('business', 'net_revenue', 'order_id::varchar', region)}
          select region, grp "group", mv metric_value, mean_total mean_group_total from gs
          where mv < mean_total * 0.6""",
        "underperformers_by_region": f"""with {BUSINESS},
          {groups_cte('business', 'net_revenue', 'status', region)}
          select region, grp "group", mv metric_value, mean_total mean_group_total from gs
          where mv < mean_total * 0.6""",
        "efficiency_split": f"""with {BUSINESS}, {groups_cte('business', 'net_revenue', 'segment')},
          {summary_cte()} select top volume_leader, eff efficiency_leader,
          effv efficiency_leader_average, top = eff aligned from su where n >= 2""",
        "efficiency_split_by_region": f"""with {BUSINESS},
          {groups_cte('business', 'net_revenue', 'segment', region)}, {summary_cte(region)}
          select region, top volume_leader, eff efficiency_leader,
          effv efficiency_leader_average, top = eff aligned from su where n >= 2""",
        "margin_flags": margin_sql("nation"),
        "margin_flags_by_region": margin_sql("nation", region),
        "trend_summary": trend_sql(BUSINESS, "business", "net_revenue", "order_date"),
        "trend_summary_by_region": trend_sql(BUSINESS, "business", "net_revenue", "order_date", region),
        "trend_summary_text_dates": trend_sql(
            DIRTY, "dirty", "quantity_text", "try_strptime(order_day, '%m/%d/%Y')"
        ),
        "trend_by_dimension": trend_sql(
            BUSINESS, "business", "net_revenue", "order_date", (), "region"
        ),
        "trend_by_nation": trend_sql(
            BUSINESS, "business", "net_revenue", "order_date", (), "nation", 25
        ),
        "margin_flags_orders": margin_sql("order_id::varchar"),
        "trend_by_dimension_too_many": trend_sql(
            BUSINESS, "business", "net_revenue", "order_date", (), "nation"
        ),
        "diagnostic_findings": findings_sql("net_revenue", "nation"),
        "diagnostic_findings_by_region": findings_sql("net_revenue", "status", region),
        "forecast_history": f"""with {BUSINESS}, {series_ctes('business', 'net_revenue', 'order_date')}
          select grain, period, mv metric_value from hi""",
        "forecast_history_by_nation": f"""with {BUSINESS},
          {series_ctes('business', 'net_revenue', 'order_date', nation)}
          select nation, grain, period, mv metric_value from hi""",
        "forecast_history_complete": f"""with {BUSINESS},
          {series_ctes('business', 'net_revenue', 'order_date', (), True)}
          select grain, period, mv metric_value from hi""",
        "forecast_inputs": on_series(
            "select 'net_revenue' metric_column, 'order_date' datetime_column, grain aggregation_grain,"
            " case grain when 'M' then 'Monthly' when 'W' then 'Weekly' else 'Daily' end"
            " aggregation_grain_label, cast(6 as bigint) forecast_horizon, parse_rate"
            " datetime_parse_success_rate, metric_ratio metric_valid_ratio, n historical_periods,"
            f" '{V.FORECAST_METHOD}' forecast_method_label from st"
        ),
        "forecast_projection": on_series(f"select {PROJECTION}"),
        "forecast_projection_by_nation": on_series(f"select nation, {PROJECTION}", nation),
        "forecast_projection_events": on_series(
            f"select event_type, {PROJECTION}", ("event_type",), events=True
        ),
        "forecast_cards": on_series(f"select {CARDS}"),
        "forecast_cards_by_nation": on_series(f"select nation, {CARDS}", nation),
        "forecast_volatility": on_series(f"select {VOLATILITY}"),
        "forecast_volatility_events": on_series(
            f"select event_type, {VOLATILITY}", ("event_type",), events=True
        ),
        "forecast_validation": on_series(
            f"select event_type, cast(1 as bigint) message_order, {quote(P.MESSAGE_HORIZON)} message"
            " from st where 30 > greatest(3, n // 2)", ("event_type",), 30, True,
        ),
        "forecast_chart": on_series(
            "select period, mv metric_value, 'Actual' series_type from hi"
            " union all select period, v, 'Forecast' from pt"
        ),
        "forecast_findings": forecast_findings_sql(),
        "forecast_findings_events": forecast_findings_sql(("event_type",), True, True),
        "forecast_reasons": on_series(
            f"""select cast(1 as bigint) reason_order,
              {message(P.READY_PARSE, "printf('%.0f%%', parse_rate * 100)")} reason from st
            union all select 2, {message(P.READY_PERIODS, 'n')} from st
            union all select 3, {message(P.READY_GRAIN, "case grain when 'M' then 'Monthly' when 'W' then 'Weekly' else 'Daily' end")} from st
            union all select 4, {quote(P.READY_STATUS % 'ready')} from st"""
        ),
        "recommendations": rules_sql(),
        "recommendations_by_region": rules_sql(region),
        "prescriptive_summary": rules_summary_sql(),
        "prescriptive_findings": rules_findings_sql(),
        "prescriptive_limitations": (
            "select cast(1 as bigint) limitation_order, cast('' as varchar) limitation where false"
        ),
        # an order has one day, so its series is shorter than a forecast needs
        "prescriptive_limitations_orders": f"""with {BUSINESS},
          days as (select order_id, count(distinct cast(order_date as date)) n from business group by order_id),
          told as (select order_id, [
            'Predictive support is limited or unavailable, so recommendations lean more heavily on current-state diagnostic evidence.',
            'Only ' || n || ' unique time periods are available after aggregation, which is below the minimum of 6.',
            'Only ' || n || ' aggregated observations are available, so the series is too short for a cautious forecast.'
            ] t from days where n < 6)
          select order_id, cast(unnest([1, 2, 3]) as bigint) limitation_order, unnest(t) limitation from told""",
        "prescriptive_limitations_lineitem": (
            f"with {stats_cte('lineitem', [tuple(c.split()) for c in TABLE_COLUMNS['lineitem'].split(', ')])}, {facts_cte()}"
            " select cast(1 as bigint) limitation_order, 'Recommendations are conditional because the evidence base is still maturing.' limitation from e"
            " where prescriptive_status = 'Conditional' and forecast_on"
        ),
        "report_lines": rules_head(region) + f", {report_ctes(region)} select * from rl",
        "report_text": report_text_sql(),
        "insight_facts": facts_told() + " select * from fa",
        "fallback_summary_by_region": summaries(region) + " select * from fs",
        "report_written": report_text_sql(
            region, "case region when 'ASIA' then '2001-09-01 00:00:00' else '2001-08-01 00:00:00' end"
        ),
        "report_narrative": summaries(region) + f""",
          story as (select region doc_id, summary narrative from fs), {NARRATIVE_STEPS}{NARRATIVE_QUALITY},
          good as (select doc_id, u >= 2 and m < greatest(2, u // 2) passes from counted),
          short as (select doc_id, row_number() over (partition by doc_id order by position) as position, item from told)
          select doc_id region, cast(9 as bigint) section_order, 'AI Insight Summary' section,
            cast(position as bigint) item_order, item
          from (select * from items where doc_id in (select doc_id from good where passes)
            union all select * from short where position <= 4 and doc_id in (select doc_id from good where not passes))""",
        "narrative_lines": f"""{narrative}, numbered as (select doc_id, pos, line from fixed)
          select doc_id, cast(pos as bigint) as position, line from numbered where line <> ''""",
        "narrative_sections": f"""{narrative} select doc_id, cast(sec as bigint) section_order,
          title section, k item_order, c item from capped join names using (sec)""",
        "narrative_items": f"{narrative} select doc_id, position, item from items",
        "narrative_quality": narrative + NARRATIVE_QUALITY + QUALITY_SELECT,
        "narrative_short": f"""{narrative} select doc_id, k as position, item from (select *,
          row_number() over (partition by doc_id order by position) k from told) where k <= 4""",
    }
    return out | {"readiness_estimated": out["readiness"]}
