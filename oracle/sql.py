"""Oracle SQL text.  Fractional literals carry ``::double`` so DuckDB does
not fall back to decimal arithmetic; integer results are cast to BIGINT or
INTEGER to match Spark's types; aggregate doubles are rounded to 6 places.
"""


def rnd(expr: str, d: int) -> str:
    """Half-up rounding of a double's shortest decimal form (Spark's rule)."""
    return f"cast(round(cast(cast(({expr}) as varchar) as decimal(38,20)), {d}) as double)"


def pyrnd(expr: str, d: int) -> str:
    """Python's round(x, d) on doubles: half-even on the exact binary value.

    p = x * 10^d and its exact error e (Dekker split of x; 10^d splits
    exactly) decide the rare .5 ties; everything else rounds to nearest.
    """
    s = f"{float(10 ** d)}::double"
    x = f"({expr})"
    p = f"({x} * {s})"
    big = f"({x} * 134217729.0::double)"
    hi = f"({big} - ({big} - {x}))"
    err = f"((({hi} * {s}) - {p}) + (({x} - {hi}) * {s}))"
    k = f"floor({p})"
    return (f"(case when {x} is null then null else ({k} + case when {p} - {k} > 0.5::double then 1 "
            f"when {p} - {k} < 0.5::double then 0 when {err} > 0 then 1 when {err} < 0 then 0 "
            f"else cast(cast({k} as bigint) % 2 as integer) end) / {s} end)")


# The canonical lineitem -> points mapping (CTEs raw, points, override_log).
MAPPING_SQL = """
with raw as (
  select concat('PT-', cast(l_orderkey as varchar), '-', cast(l_linenumber as varchar)) as id_number,
    l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax,
    case when l_partkey % 97 = 0 then null
         else cast(3*cast(round(l_discount*100) as int) + cast(round(l_tax*100) as int) as double) / 100.0::double
    end as average_corrosion_rate,
    case when l_suppkey % 89 = 0 then null
         else cast(20 + 2*cast(l_quantity as int) as double) / 10.0::double end as thickness_mm,
    case cast(l_partkey % 9 as int) when 0 then 'Crude Oil' when 1 then 'Natural Gas' when 2 then 'Steam'
      when 3 then 'Fuel Gas' when 4 then 'Potable Water' when 5 then 'Process Water' when 6 then 'Condensate'
      when 7 then 'Refined Product' else 'Gas' end as commodity,
    case cast(l_suppkey % 9 as int) when 0 then 'Pipe' when 1 then 'Elbow' when 2 then 'Tee' when 3 then 'Reducer'
      when 4 then 'Flange' when 5 then 'Nozzle' when 6 then 'Header' when 7 then 'Bend' else 'Weld' end as feature_type,
    case cast(l_orderkey % 3 as int) when 0 then 'Internal' when 1 then 'External' else 'Both' end as cml_shape,
    case when l_partkey % 53 = 0 then null else cast(l_shipdate as date) end as last_inspection_date,
    cast(cast(round(l_extendedprice*100) as bigint) % 1000 as double) / 1000.0::double as elimination_probability,
    l_returnflag, l_linestatus
  from lineitem),
points as (
  select * exclude (rn) from (
    select *, row_number() over (partition by id_number
      order by l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax,
               l_returnflag, l_linestatus) as rn
    from raw) q
  where rn = 1),
override_log as (
  select id_number,
    case when l_linestatus = 'F' then 'KEEP' else 'ELIMINATE' end as sme_decision,
    concat('reason ', l_returnflag, l_linestatus) as reason,
    concat('sme-', cast(l_suppkey % 7 as varchar)) as sme_name,
    l_shipdate as override_date,
    case when l_partkey % 5 = 0 then null
         when elimination_probability > 0.5::double then 'ELIMINATE' else 'KEEP' end as original_prediction,
    cast(null as double) as original_probability
  from raw where l_returnflag = 'R')
"""

# Profile-B forecast over points (CTE fb).
_FB = """,
fb0 as (
  select id_number, thickness_mm as t, average_corrosion_rate as r, last_inspection_date,
    commodity, feature_type,
    case when thickness_mm is null or average_corrosion_rate is null then null
         when thickness_mm - {minimum}::double <= 0 then 0.0::double
         when average_corrosion_rate <= 0 then 50.0::double
         else least((thickness_mm - {minimum}::double) / average_corrosion_rate, 50.0::double) end as life
  from points),
fb1 as (
  select *, floor(life / {sf}::double * 12.0::double) as m0 from fb0),
fb2 as (
  select *, case when life is null then null else
      least(greatest(case when r > 0.20::double then floor(m0 * 0.7::double)
                          when r < 0.05::double then floor(m0 * 1.3::double)
                          else m0 end, {lo}::double), {hi}::double) end as months
  from fb1),
fb as (
  select id_number, commodity, feature_type,
    {r_life} as remaining_life_years,
    case when months is null then null else
      cast(coalesce(last_inspection_date, DATE '2002-01-01') + cast(floor(months * 3044 / 100) as integer) as date)
    end as next_inspection_date,
    cast(months as integer) as recommended_inspection_frequency_months,
    {r_thick} as estimated_thickness_at_next_inspection,
    case when life is null or r is null or t is null then null
         when life < 1 or t < 5 then 'CRITICAL'
         when life < 3 or r > 0.25::double then 'HIGH'
         when life < 7 or r > 0.15::double then 'MEDIUM'
         else 'LOW' end as risk_level,
    t as current_thickness_mm, r as corrosion_rate_mm_per_year
  from fb2)
"""

_FB_R = dict(
    r_life=pyrnd("life", 1),
    r_thick=pyrnd("case when t - r * (months / 12.0::double) < 0 then 0.0::double "
                "else t - r * (months / 12.0::double) end", 2),
)
FB_DEFAULT = _FB.format(minimum=3.0, sf=1.5, lo=12, hi=72, **_FB_R)
FB_PARAM = _FB.format(minimum=2.0, sf=2.0, lo=6, hi=60, **_FB_R)

# Profile-A schedule over accepted points (CTE fa).
FA = (""",
fa0 as (
  select id_number, thickness_mm as t, average_corrosion_rate as r,
    case when thickness_mm - 3.0::double <= 0 then 0.0::double
         when average_corrosion_rate <= 0 then 50.0::double
         else least((thickness_mm - 3.0::double) / average_corrosion_rate, 50.0::double) end as life
  from points
  where thickness_mm is not null and average_corrosion_rate is not null
    and thickness_mm > 0 and average_corrosion_rate >= 0),
fa1 as (
  select *, case when life = 0 then 0.5::double
                 else greatest(1.0::double, least(life / 1.5::double, 6.0::double)) end as years
  from fa0),
fa as (
  select id_number,
    {r_life} as remaining_life_years,
    cast(DATE '2002-01-01' + cast(floor(years * 365) as integer) as date) as next_inspection_date,
    {r_thick_a} as estimated_thickness_at_next_inspection,
    cast(floor(years * 12.0::double) as integer) as recommended_inspection_frequency_months,
    case when life < 2 then 'CRITICAL' when life < 5 then 'HIGH' when life < 10 then 'MEDIUM'
         else 'LOW' end as risk_level
  from fa1)
""").replace("{r_life}", pyrnd("life", 1)).replace("{r_thick_a}", pyrnd("t - r * years", 2))

ORACLE_SQL: dict[str, str] = {}


def _q(name: str, body: str) -> None:
    """Register mapping + body; ``R6[expr]`` marks an aggregate rounded to 6 places."""
    import re

    body = re.sub(r"R6\[(.+?)\]", lambda m: rnd(m.group(1), 6), body)
    ORACLE_SQL[name] = MAPPING_SQL + body


# ----------------------------------------------------------------- forecasts
_q("forecast_risk_summary", FB_DEFAULT + """
select risk_level, count(*) as n_points,
  R6[avg(remaining_life_years)] as avg_remaining_life_years,
  min(remaining_life_years) as min_remaining_life_years,
  max(recommended_inspection_frequency_months) as max_interval_months
from fb group by risk_level
""")

_q("forecast_points_b", FB_DEFAULT + """
select id_number, remaining_life_years, next_inspection_date, recommended_inspection_frequency_months,
  estimated_thickness_at_next_inspection, risk_level, current_thickness_mm, corrosion_rate_mm_per_year
from fb
""")

_q("forecast_points_b_param", FB_PARAM + """
select id_number, remaining_life_years, next_inspection_date, recommended_inspection_frequency_months,
  estimated_thickness_at_next_inspection, risk_level
from fb
""")

_q("forecast_summary", FB_DEFAULT + """
select count(*) as total_cmls,
  cast(count(*) filter (where risk_level = 'CRITICAL') as bigint) as n_critical,
  cast(count(*) filter (where risk_level = 'HIGH') as bigint) as n_high,
  cast(count(*) filter (where risk_level = 'MEDIUM') as bigint) as n_medium,
  cast(count(*) filter (where risk_level = 'LOW') as bigint) as n_low,
  R6[avg(remaining_life_years)] as avg_remaining_life_years,
  min(remaining_life_years) as min_remaining_life_years,
  cast(count(*) filter (where risk_level = 'CRITICAL') as bigint) as critical_cmls,
  cast(count(*) filter (where risk_level = 'HIGH') as bigint) as high_risk_cmls,
  cast(count(*) filter (where next_inspection_date <= DATE '2002-01-01' + 365) as bigint)
    as inspections_needed_next_12_months
from fb
""")

_q("top_priority_inspections", FB_DEFAULT + """
select id_number, remaining_life_years, next_inspection_date, risk_level
from fb where remaining_life_years is not null
order by remaining_life_years, id_number limit 10
""")

_q("inspections_due", FB_DEFAULT + """
select id_number, next_inspection_date, risk_level, remaining_life_years
from fb where next_inspection_date <= DATE '2002-01-01' + 365
""")

_q("forecast_points_a", FA + """
select * from fa
""")

_q("forecast_a_rejects", """
select id_number,
  case when thickness_mm is null then 'thickness missing'
       when average_corrosion_rate is null then 'corrosion rate missing'
       when thickness_mm <= 0 then 'thickness must be positive'
       when average_corrosion_rate < 0 then 'corrosion rate must be non-negative' end as reject_reason
from points
where not (thickness_mm is not null and average_corrosion_rate is not null
           and thickness_mm > 0 and average_corrosion_rate >= 0)
""")

_q("risk_distribution_a", FA + """
select risk_level, count(*) as n_points,
  cast(min(recommended_inspection_frequency_months) as integer) as min_months,
  cast(max(recommended_inspection_frequency_months) as integer) as max_months
from fa group by risk_level
""")


# ------------------------------------------------------- bands and portfolio
AN = """,
an0 as (
  select *, (thickness_mm - 3.0::double)
      / case when average_corrosion_rate is null then null else greatest(average_corrosion_rate, 0.01::double) end
      as raw_life
  from points),
an1 as (
  select *, case when raw_life is null then null
                 else least(greatest(raw_life, 0.0::double), 50.0::double) end as life
  from an0),
an as (
  select *,
    case when life > 0 and life <= 2 then 'CRITICAL' when life > 2 and life <= 5 then 'HIGH'
         when life > 5 and life <= 10 then 'MEDIUM' when life > 10 then 'LOW' end as band4,
    case when life > 0 then least(life / 1.5::double, 6.0::double) else 0.5::double end * 12.0::double
      as imonths
  from an1)
"""

_q("risk_bands", AN + """
select id_number, life as remaining_life_years, band4 as risk_band_4,
  case when life > 0 and life <= 2 then 'CRITICAL' when life > 2 and life <= 5 then 'HIGH'
       when life > 5 and life <= 10 then 'MEDIUM' when life > 10 and life <= 20 then 'LOW'
       when life > 20 then 'MINIMAL' end as risk_band_5,
  case when average_corrosion_rate > 0 and average_corrosion_rate <= 0.05::double then '<0.05'
       when average_corrosion_rate > 0.05::double and average_corrosion_rate <= 0.10::double then '0.05-0.10'
       when average_corrosion_rate > 0.10::double and average_corrosion_rate <= 0.15::double then '0.10-0.15'
       when average_corrosion_rate > 0.15::double and average_corrosion_rate <= 0.20::double then '0.15-0.20'
       when average_corrosion_rate > 0.20::double then '>0.20' end as corrosion_bin,
  case when thickness_mm > 0 and thickness_mm <= 5 then '<5mm' when thickness_mm > 5 and thickness_mm <= 7 then '5-7mm'
       when thickness_mm > 7 and thickness_mm <= 9 then '7-9mm' when thickness_mm > 9 and thickness_mm <= 11 then '9-11mm'
       when thickness_mm > 11 then '>11mm' end as thickness_bin,
  imonths as inspection_months,
  case when imonths > 0 and imonths <= 6 then '0-6mo' when imonths > 6 and imonths <= 12 then '6-12mo'
       when imonths > 12 and imonths <= 24 then '1-2yr' when imonths > 24 and imonths <= 36 then '2-3yr'
       when imonths > 36 and imonths <= 72 then '3-6yr' when imonths > 72 then '>6yr' end as inspection_time_bucket
from an
""")

_RM = """,
tb(thickness_order, thickness_bin) as (values (1, '<5mm'), (2, '5-7mm'), (3, '7-9mm'), (4, '9-11mm'), (5, '>11mm')),
cb(corrosion_order, corrosion_bin) as (values (1, '<0.05'), (2, '0.05-0.10'), (3, '0.10-0.15'), (4, '0.15-0.20'),
                                              (5, '>0.20')),
binned as (
  select
    case when thickness_mm > 0 and thickness_mm <= 5 then '<5mm' when thickness_mm > 5 and thickness_mm <= 7 then '5-7mm'
         when thickness_mm > 7 and thickness_mm <= 9 then '7-9mm' when thickness_mm > 9 and thickness_mm <= 11 then '9-11mm'
         when thickness_mm > 11 then '>11mm' end as tbin,
    case when average_corrosion_rate > 0 and average_corrosion_rate <= 0.05::double then '<0.05'
         when average_corrosion_rate > 0.05::double and average_corrosion_rate <= 0.10::double then '0.05-0.10'
         when average_corrosion_rate > 0.10::double and average_corrosion_rate <= 0.15::double then '0.10-0.15'
         when average_corrosion_rate > 0.15::double and average_corrosion_rate <= 0.20::double then '0.15-0.20'
         when average_corrosion_rate > 0.20::double then '>0.20' end as cbin
  from points),
cells as (
  select tb.thickness_order, tb.thickness_bin, cb.corrosion_order, cb.corrosion_bin,
    (select count(*) from binned b where b.tbin = tb.thickness_bin and b.cbin = cb.corrosion_bin) as n_points
  from tb, cb)
"""

_q("risk_matrix", _RM + """
select * from cells
""")

_q("risk_matrix_wide", _RM + """
select thickness_order, thickness_bin,
  cast(sum(n_points) filter (where corrosion_bin = '<0.05') as bigint) as "<0.05",
  cast(sum(n_points) filter (where corrosion_bin = '0.05-0.10') as bigint) as "0.05-0.10",
  cast(sum(n_points) filter (where corrosion_bin = '0.10-0.15') as bigint) as "0.10-0.15",
  cast(sum(n_points) filter (where corrosion_bin = '0.15-0.20') as bigint) as "0.15-0.20",
  cast(sum(n_points) filter (where corrosion_bin = '>0.20') as bigint) as ">0.20"
from cells group by thickness_order, thickness_bin
""")

_q("life_histogram", AN + """,
vals as (select least(raw_life, 50.0::double) as x from an where raw_life is not null),
dim as (
  select -1 as bin_index, cast(null as double) as bin_lo, 0.0::double as bin_hi
  union all
  select cast(i as integer), i * 2.5::double, (i + 1) * 2.5::double from range(0, 20) t(i)),
cnt as (
  select case when x < 0 then -1 else cast(least(floor(x / 2.5::double), 19) as integer) end as bin_index,
    count(*) as n
  from vals group by 1)
select dim.bin_index, bin_lo, bin_hi, coalesce(n, 0) as n_points,
  R6[(select avg(x) from vals)] as mean_life
from dim left join cnt on dim.bin_index = cnt.bin_index
""")

_q("corrosion_by_commodity", """,
g as (
  select commodity, count(average_corrosion_rate) as n_points,
    min(average_corrosion_rate) as min_rate, max(average_corrosion_rate) as max_rate,
    quantile_cont(average_corrosion_rate, 0.25) as q1, quantile_cont(average_corrosion_rate, 0.5) as med,
    quantile_cont(average_corrosion_rate, 0.75) as q3, avg(average_corrosion_rate) as mean_rate
  from points where commodity is not null and average_corrosion_rate is not null
  group by commodity)
select commodity, n_points, min_rate, max_rate, R6[q1] as q1, R6[med] as median_rate, R6[q3] as q3,
  R6[mean_rate] as mean_rate, R6[q1 - 1.5::double * (q3 - q1)] as lower_fence,
  R6[q3 + 1.5::double * (q3 - q1)] as upper_fence,
  cast(row_number() over (order by med desc, commodity) as integer) as median_rank
from g
""")

_q("inspection_priority_points", AN + """
select id_number, commodity, feature_type, average_corrosion_rate, thickness_mm, life as remaining_life_years,
  band4 as risk_category, thickness_mm < 3.0::double as below_min_thickness
from an
""")

_q("feature_commodity_hierarchy", """
select * from (
  select feature_type, commodity, cast(grouping(feature_type, commodity) as integer) as level, count(*) as n_points
  from points group by rollup (feature_type, commodity)) q
where level < 3
""")

_q("portfolio_health", AN + """,
one as (
  select avg(life) as avg_life,
    count(*) filter (where life < 2) * 100.0::double / count(*) as critical_pct,
    avg(average_corrosion_rate) as avg_rate
  from an)
select R6[avg_life] as avg_remaining_life_years, R6[critical_pct] as critical_pct,
  R6[avg_rate] as avg_corrosion_rate,
  case when avg_life is null then null when avg_life < 5 then 0 when avg_life < 15 then 1
       when avg_life < 30 then 2 else 3 end as life_band,
  case when critical_pct is null then null when critical_pct < 5 then 0 when critical_pct < 15 then 1
       else 2 end as critical_band,
  case when avg_rate is null then null when avg_rate < 0.1::double then 0 when avg_rate < 0.2::double then 1
       else 2 end as rate_band,
  critical_pct > 10 as critical_alert
from one
""")

_q("life_statistics", AN + """
select R6[avg(life)] as life_mean, R6[median(life)] as life_median, R6[stddev_samp(life)] as life_std,
  R6[min(life)] as life_min, R6[max(life)] as life_max,
  R6[quantile_cont(life, 0.1)] as life_p10, R6[quantile_cont(life, 0.25)] as life_p25,
  R6[quantile_cont(life, 0.75)] as life_p75, R6[quantile_cont(life, 0.9)] as life_p90
from an
""")

_q("corrosion_statistics", """
select R6[avg(average_corrosion_rate)] as rate_mean, R6[median(average_corrosion_rate)] as rate_median,
  R6[stddev_samp(average_corrosion_rate)] as rate_std, max(average_corrosion_rate) as rate_max,
  count(*) filter (where average_corrosion_rate > 0.15::double) as high_corrosion_count
from points
""")

_q("thickness_statistics", """
select R6[avg(thickness_mm)] as thickness_mean, min(thickness_mm) as thickness_min,
  count(*) filter (where thickness_mm < 3.0::double) as below_min_count,
  count(*) filter (where thickness_mm < 5.0::double) as thin_wall_count
from points
""")

_q("risk_distribution", AN + """
select count(*) filter (where band4 = 'CRITICAL') as critical, count(*) filter (where band4 = 'HIGH') as high,
  count(*) filter (where band4 = 'MEDIUM') as medium, count(*) filter (where band4 = 'LOW') as low
from an
""")

_q("inspection_scheduling", AN + """
select count(*) filter (where life < 1) as immediate_attention, count(*) filter (where life < 2) as next_6_months,
  count(*) filter (where life < 3) as next_12_months, R6[avg(imonths)] as avg_interval_months
from an
""")

_q("commodity_risk", AN + """
select commodity, count(*) as n_points, R6[avg(average_corrosion_rate)] as avg_corrosion,
  count(*) filter (where raw_life < 2) as critical_count
from an where commodity is not null group by commodity
""")

_q("inspection_timeline", AN + """,
dim(bucket_order, bucket) as (values (1, '0-6mo'), (2, '6-12mo'), (3, '1-2yr'), (4, '2-3yr'), (5, '3-6yr'),
                                     (6, '>6yr')),
b as (
  select case when imonths > 0 and imonths <= 6 then '0-6mo' when imonths > 6 and imonths <= 12 then '6-12mo'
       when imonths > 12 and imonths <= 24 then '1-2yr' when imonths > 24 and imonths <= 36 then '2-3yr'
       when imonths > 36 and imonths <= 72 then '3-6yr' when imonths > 72 then '>6yr' end as bucket
  from an)
select dim.bucket_order, dim.bucket, count(b.bucket) as n_points
from dim left join b on dim.bucket = b.bucket group by dim.bucket_order, dim.bucket
""")

_q("report_metrics", AN + """
select count(*) as total_assets, R6[avg(life)] as avg_remaining_life_years,
  count(*) filter (where average_corrosion_rate > 0.2::double) as high_corrosion_cmls,
  count(*) filter (where thickness_mm < 5.0::double) as thin_wall_cmls
from an
""")

_q("corrosion_vs_thickness", """
select id_number, average_corrosion_rate, thickness_mm, commodity,
  case when average_corrosion_rate is null or thickness_mm is null then null
       else least(greatest(average_corrosion_rate * 20.0::double + (10.0::double - thickness_mm) * 5.0::double,
                           0.0::double), 100.0::double) end as marker_size
from points
""")


# ---------------------------------------------------------------- validation
def _examples_sql(src: str, k: int) -> str:
    return (f"(select string_agg(id_number, ', ' order by id_number) from "
            f"(select id_number from {src} where id_number is not null order by id_number limit {k}) e)")


_q("duplicate_ids", """,
c as (select id_number, count(*) as c from raw group by id_number),
d as (select id_number from c where c > 1)
select cast(coalesce(sum(c - 1), 0) as bigint) as n_duplicates,
  case when coalesce(sum(c - 1), 0) > 0 then """ + _examples_sql("d", 5) + """ end as examples
from c
""")

_q("null_counts", """,
u as (
  select 'id_number' as column_name, count(*) filter (where id_number is null) as null_count from raw
  union all select 'average_corrosion_rate', count(*) filter (where average_corrosion_rate is null) from raw
  union all select 'thickness_mm', count(*) filter (where thickness_mm is null) from raw
  union all select 'commodity', count(*) filter (where commodity is null) from raw
  union all select 'feature_type', count(*) filter (where feature_type is null) from raw
  union all select 'cml_shape', count(*) filter (where cml_shape is null) from raw)
select column_name, null_count from u where null_count > 0
""")


def _range_sql(cond: str) -> str:
    return f""",
hits as (select id_number from raw where {cond})
select (select count(*) from hits) as n_violations,
  case when (select count(*) from hits) > 0 then {_examples_sql('hits', 3)} end as examples
"""


_q("corrosion_range_violations",
   _range_sql("average_corrosion_rate < 0.0::double or average_corrosion_rate > 5.0::double"))
_q("corrosion_range_violations_narrow",
   _range_sql("average_corrosion_rate < 0.0::double or average_corrosion_rate > 0.30::double"))
_q("thickness_range_violations", _range_sql("thickness_mm <= 0.0::double or thickness_mm > 50.0::double"))
_q("thickness_range_violations_narrow", _range_sql("thickness_mm <= 3.0::double or thickness_mm > 10.0::double"))

_q("dataset_profile", """
select count(*) as total_records, count(distinct id_number) as unique_cmls,
  R6[avg(average_corrosion_rate)] as avg_corrosion_rate, R6[avg(thickness_mm)] as avg_thickness,
  min(average_corrosion_rate) as min_corrosion_rate, max(average_corrosion_rate) as max_corrosion_rate,
  min(thickness_mm) as min_thickness, max(thickness_mm) as max_thickness
from raw
""")

_q("commodity_distribution", """
select commodity, count(*) as n_points from raw where commodity is not null group by commodity
""")

_q("feature_type_distribution", """
select feature_type, count(*) as n_points from raw where feature_type is not null group by feature_type
""")

_POINT_REASONS = """
  concat_ws('; ',
    case when id_number is null then 'id_number missing' end,
    case when average_corrosion_rate is null then 'average_corrosion_rate missing' end,
    case when average_corrosion_rate < 0.0::double or average_corrosion_rate > 5.0::double
         then 'average_corrosion_rate out of range' end,
    case when thickness_mm is null then 'thickness_mm missing' end,
    case when thickness_mm <= 0.0::double or thickness_mm > 50.0::double then 'thickness_mm out of range' end,
    case when commodity is null or length(commodity) < 1 then 'commodity empty' end,
    case when feature_type is null then 'feature_type missing' end,
    case when cml_shape is null then 'cml_shape missing' end)
"""

_q("row_contract_split", """,
r as (select id_number, case when id_number is null or average_corrosion_rate is null
        or average_corrosion_rate < 0.0::double or average_corrosion_rate > 5.0::double or thickness_mm is null
        or thickness_mm <= 0.0::double or thickness_mm > 50.0::double or commodity is null or length(commodity) < 1
        or feature_type is null or cml_shape is null then """ + _POINT_REASONS + """ end as reasons
      from points)
select id_number, reasons is null as is_valid, reasons from r
""")


def _override_split(min_len: int) -> str:
    bad = f"""(id_number is null or coalesce(not regexp_full_match(sme_decision, '(KEEP|ELIMINATE)'), true)
        or coalesce(length(reason) < {min_len}, true) or sme_name is null
        or original_probability < 0.0::double or original_probability > 1.0::double)"""
    return f""",
r as (select id_number, sme_decision, override_date,
  case when {bad} then concat_ws('; ',
    case when id_number is null then 'id_number missing' end,
    case when coalesce(not regexp_full_match(sme_decision, '(KEEP|ELIMINATE)'), true) then 'sme_decision invalid' end,
    case when coalesce(length(reason) < {min_len}, true) then 'reason too short' end,
    case when sme_name is null then 'sme_name missing' end,
    case when original_probability < 0.0::double or original_probability > 1.0::double
         then 'original_probability out of range' end) end as reasons
  from override_log)
select id_number, sme_decision, override_date, reasons is null as is_valid, reasons from r
"""


_q("override_contract_split", _override_split(10))
_q("override_contract_split_len9", _override_split(9))

_q("domain_check", """,
u as (
  select 'feature_type' as column_name, feature_type as value from raw
  where feature_type not in ('Pipe', 'Elbow', 'Tee', 'Reducer', 'Flange', 'Nozzle', 'Header', 'Bend', 'Weld')
  union all
  select 'cml_shape', cml_shape from raw where cml_shape not in ('Internal', 'External', 'Both'))
select column_name, value, count(*) as n_points from u group by column_name, value
""")


def _report_sql(rate_cond: str, thick_cond: str) -> str:
    return """,
c as (select id_number, count(*) as c from raw group by id_number),
d as (select id_number from c where c > 1),
rh as (select id_number from raw where """ + rate_cond + """),
th as (select id_number from raw where """ + thick_cond + """),
w as (
  select 'warning' as severity, 'duplicate_ids' as check_name, cast(coalesce(sum(c - 1), 0) as bigint) as n,
    """ + _examples_sql("d", 5) + """ as detail from c
  union all select 'warning', 'nulls:id_number', count(*) filter (where id_number is null), null from raw
  union all select 'warning', 'nulls:average_corrosion_rate', count(*) filter (where average_corrosion_rate is null),
    null from raw
  union all select 'warning', 'nulls:thickness_mm', count(*) filter (where thickness_mm is null), null from raw
  union all select 'warning', 'nulls:commodity', count(*) filter (where commodity is null), null from raw
  union all select 'warning', 'nulls:feature_type', count(*) filter (where feature_type is null), null from raw
  union all select 'warning', 'nulls:cml_shape', count(*) filter (where cml_shape is null), null from raw
  union all select 'warning', 'corrosion_range', (select count(*) from rh), """ + _examples_sql("rh", 3) + """
  union all select 'warning', 'thickness_range', (select count(*) from th), """ + _examples_sql("th", 3) + """)
select * from w where n > 0
union all select 'info', 'valid', 1, null
union all select 'info', 'total_records', count(*), null from raw
union all select 'info', 'unique_cmls', count(distinct id_number), null from raw
union all select 'info', 'avg_corrosion_rate', null, printf('%.6f', R6[avg(average_corrosion_rate)]) from raw
union all select 'info', 'avg_thickness', null, printf('%.6f', R6[avg(thickness_mm)]) from raw
union all select 'info', 'min_corrosion_rate', null, printf('%.6f', R6[min(average_corrosion_rate)]) from raw
union all select 'info', 'max_corrosion_rate', null, printf('%.6f', R6[max(average_corrosion_rate)]) from raw
union all select 'info', 'min_thickness', null, printf('%.6f', R6[min(thickness_mm)]) from raw
union all select 'info', 'max_thickness', null, printf('%.6f', R6[max(thickness_mm)]) from raw
union all select 'info', 'commodity:' || commodity, count(*), null from raw where commodity is not null group by commodity
union all select 'info', 'feature_type:' || feature_type, count(*), null from raw where feature_type is not null
  group by feature_type
"""


_q("validation_report", _report_sql(
    "average_corrosion_rate < 0.0::double or average_corrosion_rate > 5.0::double",
    "thickness_mm <= 0.0::double or thickness_mm > 50.0::double"))
_q("validation_report_narrow", _report_sql(
    "average_corrosion_rate < 0.0::double or average_corrosion_rate > 0.30::double",
    "thickness_mm <= 3.0::double or thickness_mm > 10.0::double"))

_q("forecast_contract_split", FB_DEFAULT + """,
r as (select id_number,
  case when corrosion_rate_mm_per_year is null or corrosion_rate_mm_per_year < 0
         or current_thickness_mm is null or current_thickness_mm <= 0
         or remaining_life_years is null or remaining_life_years < 0
         or recommended_inspection_frequency_months is null or recommended_inspection_frequency_months < 1
  then concat_ws('; ',
    case when corrosion_rate_mm_per_year is null or corrosion_rate_mm_per_year < 0
         then 'corrosion rate must be >= 0' end,
    case when current_thickness_mm is null or current_thickness_mm <= 0 then 'thickness must be > 0' end,
    case when remaining_life_years is null or remaining_life_years < 0 then 'remaining life must be >= 0' end,
    case when recommended_inspection_frequency_months is null or recommended_inspection_frequency_months < 1
         then 'frequency must be >= 1' end) end as reasons
  from fb)
select id_number, reasons is null as is_valid, reasons from r
""")

# ------------------------------------------------------------------ features
_q("training_features", """
select id_number,
  case when thickness_mm = 0 then null else average_corrosion_rate / thickness_mm end as corrosion_thickness_ratio,
  case when average_corrosion_rate > 0.15::double then 1 else 0 end as high_corrosion,
  case when thickness_mm < 8.0::double then 1 else 0 end as thin_wall,
  (case when average_corrosion_rate > 0.15::double then 1 else 0 end)
    * (case when thickness_mm < 8.0::double then 1 else 0 end) as risk_interaction,
  cast(datediff('day', last_inspection_date, DATE '2002-01-01') as integer) as days_since_inspection
from points
""")

_SCORING = """
  average_corrosion_rate, thickness_mm, commodity, feature_type, cml_shape,
  case when average_corrosion_rate = 0 or average_corrosion_rate is null or thickness_mm is null then null
       else greatest((thickness_mm - 3.0::double) / average_corrosion_rate, 0.0::double) end as remaining_life_years,
  case when thickness_mm = 0 then null else average_corrosion_rate / thickness_mm end as corrosion_thickness_ratio,
  case when average_corrosion_rate is null or thickness_mm is null then null
       else least(greatest(average_corrosion_rate * 20.0::double + (10.0::double - thickness_mm) * 5.0::double,
                           0.0::double), 100.0::double) end as risk_score,
"""

_q("scoring_features", """
select id_number, """ + _SCORING + """
  coalesce(cast(datediff('day', last_inspection_date, DATE '2002-01-01') as integer), 365) as days_since_inspection
from points
""")

_q("scoring_features_median_fill", """,
dd as (select *, cast(datediff('day', last_inspection_date, DATE '2002-01-01') as integer) as d from points)
select id_number, """ + _SCORING + """
  coalesce(cast(d as double), (select median(d) from dd)) as days_since_inspection
from dd
""")


# ------------------------------------------------- decisions, overrides, report
DEC = """,
dec as (
  select *,
    case when elimination_probability > 0.5::double then 1 else 0 end as predicted_elimination_flag,
    case when elimination_probability > 0.5::double then 1 else 0 end as predicted_elimination,
    case when elimination_probability > 0.5::double then 'ELIMINATE' else 'KEEP' end as recommendation,
    case when abs(elimination_probability - 0.5::double) > 0.3::double then 'HIGH' else 'MODERATE' end
      as confidence,
    1.0::double - elimination_probability as keep_probability,
    greatest(elimination_probability, 1.0::double - elimination_probability) as confidence_score,
    case when greatest(elimination_probability, 1.0::double - elimination_probability) > 0.8::double then 'HIGH'
         when greatest(elimination_probability, 1.0::double - elimination_probability) > 0.6::double then 'MEDIUM'
         else 'LOW' end as confidence_level
  from points)
"""

CUR = """,
cur as (
  select id_number, sme_decision, reason, sme_name, override_date, original_prediction, original_probability
  from (select *, row_number() over (partition by id_number
          order by override_date desc nulls last, sme_name nulls first, sme_decision nulls first,
                   reason nulls first, original_prediction nulls last) as rn
        from override_log) q
  where rn = 1)
"""

_q("decisions_basic", DEC + """
select id_number, elimination_probability, predicted_elimination_flag, recommendation, confidence from dec
""")

_q("decisions_enhanced", DEC + """
select id_number, elimination_probability, predicted_elimination, keep_probability, recommendation,
  confidence_score as confidence, confidence_level
from dec
""")

_q("score_summary", DEC + """
select count(*) as total_cmls,
  count(*) filter (where predicted_elimination = 1) as recommended_eliminations,
  count(*) filter (where predicted_elimination = 0) as recommended_keep,
  R6[(count(*) filter (where predicted_elimination = 1)) / count(*)] as elimination_rate,
  count(*) filter (where predicted_elimination = 1 and confidence_level = 'HIGH') as high_confidence_eliminations
from dec
""")

_q("limited_results", DEC + """
select id_number, elimination_probability, predicted_elimination_flag, recommendation, confidence,
  (select count(*) from dec) as total_results
from dec order by id_number limit 100
""")

_q("decision_breakdown", DEC + """,
u as (
  select 'recommendation' as dimension, recommendation as value, count(*) as n from dec group by recommendation
  union all
  select 'confidence', confidence, count(*) from dec group by confidence)
select dimension, value, n, R6[n * 100.0::double / (select count(*) from dec)] as pct from u
""")

_q("probability_stats", """
select R6[avg(elimination_probability)] as mean_probability,
  R6[median(elimination_probability)] as median_probability,
  R6[stddev_samp(elimination_probability)] as std_probability,
  count(*) filter (where elimination_probability > 0.8::double) as n_above_0_8,
  count(*) filter (where elimination_probability < 0.2::double) as n_below_0_2
from points
""")

_q("top_candidates", DEC + """
(select 'eliminate' as side, id_number, elimination_probability, confidence from dec
 where elimination_probability is not null
 order by elimination_probability desc, id_number limit 10)
union all
(select 'keep' as side, id_number, elimination_probability, confidence from dec
 where elimination_probability is not null
 order by elimination_probability asc, id_number limit 10)
""")

_q("cost_savings", DEC + """
select count(*) filter (where predicted_elimination_flag = 1) as eliminated_cmls,
  count(*) filter (where predicted_elimination_flag = 1) * 1000 as annual_savings,
  count(*) filter (where predicted_elimination_flag = 1) * 1000 * 5 as savings_5_years,
  count(*) filter (where predicted_elimination_flag = 1) * 1000 * 10 as savings_10_years
from dec
""")

_q("dashboard_decision_counts", DEC + """
select count(*) filter (where predicted_elimination_flag = 1) as elimination_candidates,
  count(*) filter (where predicted_elimination_flag = 0) as monitoring_points
from dec
""")

_q("current_overrides", CUR + """
select * from cur
""")

_q("get_overrides", CUR + """
select * from cur where id_number in (select id_number from points where feature_type = 'Weld')
""")

_q("remove_overrides", CUR + """
select * from cur where id_number not in (select id_number from points where commodity = 'Steam')
""")

_q("apply_overrides", DEC + CUR + """
select d.id_number, d.recommendation, c.sme_decision is not null as has_sme_override, c.sme_decision,
  c.reason as sme_reason, c.sme_name, c.override_date as sme_override_date,
  c.sme_decision as overridden_decision, coalesce(c.sme_decision, d.recommendation) as final_decision
from dec d left join cur c on d.id_number = c.id_number
""")

_q("override_statistics", CUR + """
select count(*) as total_overrides,
  count(*) filter (where sme_decision = 'KEEP') as keep_overrides,
  count(*) filter (where sme_decision = 'ELIMINATE') as eliminate_overrides,
  count(*) filter (where sme_decision is distinct from original_prediction) as disagreements_with_ml,
  case when count(*) > 0 then """ + pyrnd("(count(*) - count(*) filter (where sme_decision is distinct from "
                                      "original_prediction)) * 100.0::double / count(*)", 1) + """ end as agreement_rate
from cur
""")

_q("recent_overrides", CUR + """
select id_number, sme_decision, sme_name, override_date from cur
order by override_date desc nulls last, id_number limit 10
""")

_q("overrides_by_sme", CUR + """
select sme_name, count(*) as n_overrides from cur group by sme_name
""")

SCORED = DEC + CUR + """,
sc as (
  select d.*, coalesce(c.sme_decision, d.recommendation) as final_decision
  from dec d left join cur c on d.id_number = c.id_number)
"""

_q("report_summary", SCORED + """
select count(*) as total_cmls,
  count(*) filter (where predicted_elimination = 1) as recommended_eliminations,
  count(*) filter (where predicted_elimination = 0) as recommended_keep,
  """ + pyrnd("(count(*) filter (where predicted_elimination = 1)) * 100.0::double / count(*)", 1) + """
    as elimination_rate, cast(null as varchar) as error
from sc
""")

_q("report_summary_final", SCORED + """
select count(*) as total_cmls,
  count(*) filter (where final_decision = 'ELIMINATE') as recommended_eliminations,
  count(*) filter (where final_decision = 'KEEP') as recommended_keep,
  """ + pyrnd("(count(*) filter (where final_decision = 'ELIMINATE')) * 100.0::double / count(*)", 1) + """
    as elimination_rate, cast(null as varchar) as error
from sc
""")

_q("confidence_distribution", SCORED + """
select confidence_level, count(*) as n_points from sc where confidence_level is not null group by confidence_level
""")

_q("eliminations_by_commodity", SCORED + """
select commodity, count(*) as n_eliminations from sc
where predicted_elimination = 1 and commodity is not null group by commodity
""")

_q("eliminations_by_feature", SCORED + """
select feature_type, count(*) as n_eliminations from sc
where predicted_elimination = 1 and feature_type is not null group by feature_type
""")

_q("top_elimination_candidates", SCORED + """
select id_number, elimination_probability, average_corrosion_rate, thickness_mm from sc
where predicted_elimination = 1 order by elimination_probability desc, id_number limit 20
""")

_q("marginal_cases", SCORED + """
select id_number, elimination_probability, recommendation from sc
where elimination_probability > 0.4::double and elimination_probability < 0.6::double
""")

_q("full_report", SCORED + """
select 'summary' as section, 'total_cmls' as key, cast(count(*) as double) as value from sc
union all select 'summary', 'recommended_eliminations', cast(count(*) filter (where predicted_elimination = 1)
  as double) from sc
union all select 'summary', 'recommended_keep', cast(count(*) filter (where predicted_elimination = 0) as double)
  from sc
union all select 'summary', 'elimination_rate',
  """ + pyrnd("(count(*) filter (where predicted_elimination = 1)) * 100.0::double / count(*)", 1) + """ from sc
union all select 'confidence_distribution', confidence_level, cast(count(*) as double) from sc
  where confidence_level is not null group by confidence_level
union all select 'elimination_by_commodity', commodity, cast(count(*) as double) from sc
  where predicted_elimination = 1 and commodity is not null group by commodity
union all select 'elimination_by_feature', feature_type, cast(count(*) as double) from sc
  where predicted_elimination = 1 and feature_type is not null group by feature_type
union all select 'sizes', 'marginal_cases', cast(count(*) filter (where elimination_probability > 0.4::double
  and elimination_probability < 0.6::double) as double) from sc
""")

_q("eliminations_by_commodity_final", SCORED + """
select commodity, count(*) as n_eliminations from sc
where final_decision = 'ELIMINATE' and commodity is not null group by commodity
""")

_q("eliminations_by_feature_final", SCORED + """
select feature_type, count(*) as n_eliminations from sc
where final_decision = 'ELIMINATE' and feature_type is not null group by feature_type
""")

_q("top_candidates_final", SCORED + """
select id_number, elimination_probability, average_corrosion_rate, thickness_mm from sc
where final_decision = 'ELIMINATE' order by elimination_probability desc, id_number limit 20
""")

_q("full_report_final", SCORED + """
select 'summary' as section, 'total_cmls' as key, cast(count(*) as double) as value from sc
union all select 'summary', 'recommended_eliminations', cast(count(*) filter (where final_decision = 'ELIMINATE')
  as double) from sc
union all select 'summary', 'recommended_keep', cast(count(*) filter (where final_decision = 'KEEP') as double)
  from sc
union all select 'summary', 'elimination_rate',
  """ + pyrnd("(count(*) filter (where final_decision = 'ELIMINATE')) * 100.0::double / count(*)", 1) + """ from sc
union all select 'confidence_distribution', confidence_level, cast(count(*) as double) from sc
  where confidence_level is not null group by confidence_level
union all select 'elimination_by_commodity', commodity, cast(count(*) as double) from sc
  where final_decision = 'ELIMINATE' and commodity is not null group by commodity
union all select 'elimination_by_feature', feature_type, cast(count(*) as double) from sc
  where final_decision = 'ELIMINATE' and feature_type is not null group by feature_type
union all select 'sizes', 'marginal_cases', cast(count(*) filter (where elimination_probability > 0.4::double
  and elimination_probability < 0.6::double) as double) from sc
""")


# ------------------------------------------------------------ synthetic data
def _slice(i: int) -> str:
    """Draw i of a point: 8 hex digits of md5('42:key:g<i // 4>') as a uniform in [0, 1)."""
    return (f"cast(('0x' || substr(h{i // 4}, {1 + 8 * (i % 4)}, 8)) as bigint) / 4294967296.0::double")


SYN = """,
gk as (
  select cast(l_orderkey as varchar) || '-' || cast(l_linenumber as varchar) as k from lineitem),
gh as (
  select k, md5(concat_ws(':', '42', k, 'g0')) as h0, md5(concat_ws(':', '42', k, 'g1')) as h1 from gk),
g0 as (
  select k,
    """ + _slice(0) + """ as uc, """ + _slice(1) + """ as uf, """ + _slice(2) + """ as us,
    """ + _slice(3) + """ as ur, """ + _slice(4) + """ as ut, """ + _slice(5) + """ as ud,
    """ + _slice(6) + """ as ui, """ + _slice(7) + """ as ul
  from gh),
g1 as (
  select k, ul,
    ['Crude Oil', 'Natural Gas', 'Steam', 'Fuel Gas', 'Potable Water', 'Process Water', 'Condensate',
     'Refined Product', 'Gas'][cast(floor(uc * 9.0::double) as integer) + 1] as commodity,
    ['Pipe', 'Elbow', 'Tee', 'Reducer', 'Flange', 'Nozzle', 'Header', 'Bend', 'Weld']
      [cast(floor(uf * 9.0::double) as integer) + 1] as feature_type,
    ['Internal', 'External', 'Both'][cast(floor(us * 3.0::double) as integer) + 1] as cml_shape,
    ur, ut,
    365 + cast(floor(ud * 1096.0::double) as integer) as days_ago,
    365 + cast(floor(ui * 731.0::double) as integer) as intv
  from g0),
g2 as (
  select *,
    case when commodity in ('Crude Oil', 'Condensate') then 0.05::double + ur * (0.20::double - 0.05::double)
         when commodity in ('Natural Gas', 'Fuel Gas', 'Gas') then 0.03::double + ur * (0.15::double - 0.03::double)
         when commodity = 'Steam' then 0.08::double + ur * (0.25::double - 0.08::double)
         else 0.02::double + ur * (0.12::double - 0.02::double) end as rate,
    case when feature_type in ('Header', 'Pipe') then 8.0::double + ut * (12.0::double - 8.0::double)
         when feature_type in ('Flange', 'Reducer') then 9.0::double + ut * (11.5::double - 9.0::double)
         else 6.0::double + ut * (10.5::double - 6.0::double) end as thick
  from g1),
g3 as (
  select *, case when rate > 0 then least((thick - 3.0::double) / rate, 300.0::double) else 300.0::double end
    as life
  from g2),
g4 as (
  select *, least(
      (case when rate > 0.15::double then 40 when rate > 0.10::double then 25 else 10 end)
    + (case when thick < 8.0::double then 30 when thick < 9.5::double then 15 else 0 end)
    + (case when life < 20.0::double then 30 when life < 50.0::double then 15 else 0 end), 100) as risk
  from g3),
syn as (
  select 'CML-' || k as id_number, commodity, feature_type, cml_shape,
    """ + pyrnd("rate", 2) + """ as average_corrosion_rate,
    """ + pyrnd("thick", 1) + """ as thickness_mm,
    cast(DATE '2002-01-01' - days_ago as date) as last_inspection_date,
    cast(DATE '2002-01-01' - days_ago + intv as date) as next_inspection_date,
    """ + pyrnd("life", 1) + """ as remaining_life_years,
    cast(intv - days_ago as integer) as days_to_next_inspection,
    cast(risk as integer) as risk_score,
    case when rate < 0.08::double and thick > 9.5::double then case when ul > 0.3::double then 1 else 0 end
         when rate < 0.05::double then case when ul > 0.2::double then 1 else 0 end
         when risk > 70 then 0
         when risk > 50 then case when ul > 0.8::double then 1 else 0 end
         else case when ul > 0.7::double then 1 else 0 end end as elimination_flag
  from g4)
"""

_q("synthetic_points", SYN + """
select * from syn
""")

_q("synthetic_summary", SYN + """
select count(*) as total_records, R6[avg(elimination_flag)] as elimination_rate,
  count(distinct commodity) as unique_commodities, count(distinct feature_type) as unique_feature_types,
  min(average_corrosion_rate) as min_rate, max(average_corrosion_rate) as max_rate,
  min(thickness_mm) as min_thickness, max(thickness_mm) as max_thickness,
  min(risk_score) as min_risk_score, max(risk_score) as max_risk_score
from syn
""")


# -------------------------------------------------------------------- model
def _uid(tag: str) -> str:
    return (f"cast(('0x' || substr(md5(concat_ws(':', '42', id_number, '{tag}')), 1, 8)) as bigint)"
            f" / 4294967296.0::double")


PAIRS = DEC + CUR + """,
pairs as (
  select case when c.sme_decision = 'ELIMINATE' then 1 else 0 end as l, d.predicted_elimination_flag as p
  from dec d join cur c on d.id_number = c.id_number),
per as (
  select cls, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn, sum(support) as support from (
    select l as cls, case when l = p then 1 else 0 end as tp, 0 as fp, case when l <> p then 1 else 0 end as fn,
      1 as support from pairs
    union all
    select p, 0, case when l <> p then 1 else 0 end, 0, 0 from pairs) x
  group by cls),
per2 as (
  select cast(cls as varchar) as class_name, tp, support,
    case when tp + fp > 0 then tp / (tp + fp) else 0.0::double end as precision,
    case when tp + fn > 0 then tp / (tp + fn) else 0.0::double end as recall
  from per),
per3 as (
  select *, case when precision + recall > 0 then 2.0::double * precision * recall / (precision + recall)
                 else 0.0::double end as f1
  from per2)
"""

_q("classification_report", PAIRS + """
select class_name, R6[precision] as precision, R6[recall] as recall, R6[f1] as f1, cast(support as bigint) as support
from per3
union all
select 'macro avg', R6[avg(precision)], R6[avg(recall)], R6[avg(f1)], cast(sum(support) as bigint) from per3
union all
select 'weighted avg', R6[sum(precision * support) / sum(support)], R6[sum(recall * support) / sum(support)],
  R6[sum(f1 * support) / sum(support)], cast(sum(support) as bigint) from per3
union all
select 'accuracy', null, null, R6[sum(tp) / sum(support)], cast(sum(support) as bigint) from per3
""")

_q("confusion_matrix", PAIRS + """,
dim(label, prediction) as (values (0, 0), (0, 1), (1, 0), (1, 1))
select dim.label, dim.prediction, count(pairs.l) as n
from dim left join pairs on pairs.l = dim.label and pairs.p = dim.prediction
group by dim.label, dim.prediction
""")


# ------------------------------------------------- labelled points (ML)
LAB = CUR + """,
lab as (
  select p.*, case when c.sme_decision = 'ELIMINATE' then 1 else 0 end as elimination_flag
  from points p join cur c on p.id_number = c.id_number)
"""


def _ranked(tag: str) -> str:
    return LAB + """,
u as (select id_number, elimination_flag, """ + _uid(tag) + """ as u from lab),
rk as (select *, row_number() over (partition by elimination_flag order by u, id_number) - 1 as r,
         count(*) over (partition by elimination_flag) as n from u)
"""


_q("train_test_split", _ranked("split") + """
select id_number, elimination_flag, r >= round(n * 0.2::double) as is_train from rk
""")

_q("stratified_folds", _ranked("fold") + """
select id_number, elimination_flag, cast(r % 5 as integer) as fold from rk
""")

_q("class_weights", LAB + """,
c as (select elimination_flag, count(*) as n_class from lab group by elimination_flag)
select elimination_flag, n_class,
  R6[(select sum(n_class) from c) / ((select count(*) from c) * n_class)] as class_weight
from c
""")

# Rank-sum AUC: the positives' mid-ranks, instead of counts below each value.
_q("model_metrics", LAB + """,
s as (select elimination_flag as y, elimination_probability as p, cast(elimination_probability > 0.5::double as integer) as g
      from lab),
rk as (select y, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2.0::double as mid
       from s where p is not null),
t as (select sum(mid) filter (where y = 1) as ranks, cast(count(*) filter (where y = 1) as double) as n1,
        cast(count(*) filter (where y = 0) as double) as n0 from rk)
select R6[avg(cast(y = g as integer))] as test_accuracy,
  (select R6[(ranks - n1 * (n1 + 1) / 2) / (n1 * n0)] from t) as roc_auc,
  R6[2.0::double * sum(y * g) / (sum(y) + sum(g))] as f1_score
from s where g is not null
""")

_q("bootstrap_class_weights", LAB + """,
h as (select elimination_flag as label,
        cast(('0x' || substr(md5(concat_ws(':', '42', id_number)), 1, 8)) as bigint) % 2147483647 as h from lab),
x as (select tree, label, (h + (tree + 1) * 1640531527) % 2147483647 as x from h, range(300) t(tree)),
u as (select tree, label, ((x * x % 2147483647) * (x * x % 2147483647) % 2147483647) * x % 2147483647 as u from x),
c as (select tree, label, len(list_filter([790015083, 1580030167, 1975037709, 2106706890, 2139624185, 2146207644,
        2147304887, 2147461637, 2147481230], lambda t: u >= t)) as c from u),
per as (select tree, label, count(*) filter (where c > 0) as n_rows, sum(c) as drawn from c group by tree, label)
select cast(tree as integer) as tree, label, n_rows, cast(drawn as bigint) as drawn,
  R6[(sum(drawn) over (partition by tree)) / ((count(*) over (partition by tree)) * drawn)] as class_weight
from per
""")

_q("additive_risk_labels", """,
g1 as (select id_number, average_corrosion_rate as rate, thickness_mm as thick,
    coalesce(case when average_corrosion_rate <> 0 then (thickness_mm - 3.0::double) / average_corrosion_rate end,
             300.0::double) as life, """ + _uid("label") + """ as ul
  from points where average_corrosion_rate is not null and thickness_mm is not null),
g2 as (select *, least(
      (case when rate > 0.15::double then 40 when rate > 0.10::double then 25 else 10 end)
    + (case when thick < 8.0::double then 30 when thick < 9.5::double then 15 else 0 end)
    + (case when life < 20.0::double then 30 when life < 50.0::double then 15 else 0 end), 100) as risk from g1)
select id_number, cast(risk as integer) as risk_score,
  case when rate < 0.08::double and thick > 9.5::double then case when ul > 0.3::double then 1 else 0 end
       when rate < 0.05::double then case when ul > 0.2::double then 1 else 0 end
       when risk > 70 then 0
       when risk > 50 then case when ul > 0.8::double then 1 else 0 end
       else case when ul > 0.7::double then 1 else 0 end end as elimination_flag
from g2
""")


# --------------------------------------- missing values, own columns, contracts
# Points with some measurements missing (NaN on the Spark side), in place of ``points``.
_NAN = """,
pn as (
  select * replace (
    case when l_partkey % 7 = 0 then null else average_corrosion_rate end as average_corrosion_rate,
    case when l_suppkey % 11 = 0 then null else thickness_mm end as thickness_mm)
  from points)
"""

_q("forecast_points_nan", _NAN + FB_DEFAULT.replace("from points)", "from pn)") + """
select id_number, remaining_life_years, next_inspection_date, recommended_inspection_frequency_months,
  estimated_thickness_at_next_inspection, risk_level, current_thickness_mm, corrosion_rate_mm_per_year
from fb
""")

_q("null_counts_nan", _NAN + """,
u as (
  select 'average_corrosion_rate' as column_name, count(*) filter (where average_corrosion_rate is null) as null_count from pn
  union all select 'thickness_mm', count(*) filter (where thickness_mm is null) from pn)
select column_name, null_count from u where null_count > 0
""")

_OWN = FB_DEFAULT + """,
own as (
  select p.id_number, p.average_corrosion_rate, p.thickness_mm,
    case when l_partkey % 31 <> 0 then cast(l_partkey % 400 as double) / 10.0::double end as i_life,
    case when l_partkey % 13 = 0 then null
         else cast(l_shipdate as date) + cast(l_suppkey % 3000 as integer) end as i_date,
    case when cast(l_partkey % 400 as double) / 10.0::double < 5 then 'HIGH' else 'LOW' end as i_risk,
    cast(l_suppkey % 72 as integer) as i_months,
    fb.remaining_life_years as f_life, fb.next_inspection_date as f_date, fb.risk_level as f_risk,
    fb.recommended_inspection_frequency_months as f_months
  from points p join fb on p.id_number = fb.id_number)
"""

for _source, _x in (("forecast", "f"), ("input", "i")):
    _q(f"forecast_summary_own_{_source}", _OWN + f"""
select count(*) as total_cmls,
  count(*) filter (where {_x}_risk = 'CRITICAL') as n_critical, count(*) filter (where {_x}_risk = 'HIGH') as n_high,
  count(*) filter (where {_x}_risk = 'MEDIUM') as n_medium, count(*) filter (where {_x}_risk = 'LOW') as n_low,
  R6[avg({_x}_life)] as avg_remaining_life_years, min({_x}_life) as min_remaining_life_years,
  count(*) filter (where {_x}_risk = 'CRITICAL') as critical_cmls, count(*) filter (where {_x}_risk = 'HIGH') as high_risk_cmls,
  count(*) filter (where {_x}_date <= DATE '2002-01-01' + 365) as inspections_needed_next_12_months
from own
""")
    _q(f"inspections_due_own_{_source}", _OWN + f"""
select id_number, cast({_x}_date as date) as next_inspection_date, {_x}_risk as risk_level, {_x}_life as remaining_life_years
from own where {_x}_date <= DATE '2002-01-01' + 365
""")
    _q(f"top_priority_own_{_source}", _OWN + f"""
select id_number, {_x}_life as remaining_life_years, cast({_x}_date as date) as next_inspection_date, {_x}_risk as risk_level
from own where {_x}_life is not null order by {_x}_life, id_number limit 10
""")
    _q(f"forecast_contract_own_{_source}", _OWN + f""",
r as (select id_number, nullif(concat_ws('; ',
    case when average_corrosion_rate is null or average_corrosion_rate < 0 then 'corrosion rate must be >= 0' end,
    case when thickness_mm is null or thickness_mm <= 0 then 'thickness must be > 0' end,
    case when {_x}_life is null or {_x}_life < 0 then 'remaining life must be >= 0' end,
    case when {_x}_months is null or {_x}_months < 1 then 'frequency must be >= 1' end), '') as reasons from own)
select id_number, reasons is null as is_valid, reasons from r
""")

_VARIED = """,
v as (
  select case when l_orderkey % 37 <> 0 then id_number end as id_number,
    case when l_orderkey % 41 = 0 then 'MAYBE' when l_orderkey % 43 = 0 then null
         when l_linestatus = 'F' then 'KEEP' else 'ELIMINATE' end as sme_decision,
    'reason' || repeat('!', cast(l_partkey % 9 as integer)) as reason,
    case when l_suppkey % 17 <> 0 then 'sme-' || cast(l_suppkey % 7 as varchar) end as sme_name,
    l_shipdate as override_date,
    case when l_partkey % 5 <> 0 then cast(l_orderkey % 130 - 10 as double) / 100.0::double end as original_probability
  from (select r.*, li.l_orderkey from raw r join (select distinct l_orderkey,
          'PT-' || cast(l_orderkey as varchar) || '-' || cast(l_linenumber as varchar) as k from lineitem) li on li.k = r.id_number)
  where l_returnflag = 'R')"""

_q("override_contract_split_varied", _VARIED + """,
r as (select *, nullif(concat_ws('; ',
    case when id_number is null then 'id_number missing' end,
    case when coalesce(not regexp_full_match(sme_decision, '(KEEP|ELIMINATE)'), true) then 'sme_decision invalid' end,
    case when length(reason) < 10 then 'reason too short' end,
    case when sme_name is null then 'sme_name missing' end,
    case when original_probability < 0.0::double or original_probability > 1.0::double
         then 'original_probability out of range' end), '') as reasons from v)
select id_number, sme_decision, override_date, reasons is null as is_valid, reasons from r
""")

_RULES_SQL = [  # contract, rule, column, severity, table, condition
    *[("points", f"{c} missing", c, "error", "s", f"{c} is null") for c in ("id_number", "average_corrosion_rate", "thickness_mm")],
    ("points", "average_corrosion_rate low", "average_corrosion_rate", "error", "s", "average_corrosion_rate < 0"),
    ("points", "average_corrosion_rate high", "average_corrosion_rate", "error", "s", "average_corrosion_rate > 5"),
    ("points", "thickness_mm low", "thickness_mm", "error", "s", "thickness_mm <= 0"),
    ("points", "thickness_mm high", "thickness_mm", "error", "s", "thickness_mm > 50"),
    ("points", "commodity empty", "commodity", "error", "s", "commodity is null or commodity = ''"),
    ("points", "feature_type unknown", "feature_type", "warning", "s", "coalesce(feature_type, '') not in ('Pipe', 'Elbow', 'Tee', "
     "'Reducer', 'Flange', 'Nozzle', 'Header', 'Bend', 'Weld')"),
    ("points", "cml_shape unknown", "cml_shape", "warning", "s", "coalesce(cml_shape, '') not in ('Internal', 'External', 'Both')"),
    ("points", "last_inspection_date malformed", "last_inspection_date", "warning", "s",
     "last_inspection_date is not null and not regexp_full_match(last_inspection_date, '[0-9]{4}-[0-9]{2}-[0-9]{2}')"),
    ("overrides", "id_number missing", "id_number", "error", "v", "id_number is null"),
    ("overrides", "sme_decision invalid", "sme_decision", "error", "v", "sme_decision is null or sme_decision not in ('KEEP', 'ELIMINATE')"),
    ("overrides", "reason too short", "reason", "error", "v", "reason is null or length(reason) < 10"),
    ("overrides", "sme_name missing", "sme_name", "error", "v", "sme_name is null"),
    ("overrides", "original_probability low", "original_probability", "error", "v", "original_probability < 0"),
    ("overrides", "original_probability high", "original_probability", "error", "v", "original_probability > 1"),
    *[(k, f"{c} present", c, "error", "s", "true" if c == "elimination_flag" else "false") for k, names in (
        ("points", "id_number average_corrosion_rate thickness_mm commodity feature_type cml_shape"),
        ("training", "id_number average_corrosion_rate thickness_mm commodity feature_type cml_shape elimination_flag last_inspection_date"),
        ("forecast", "id_number average_corrosion_rate thickness_mm commodity feature_type")) for c in names.split()],
]
_q("forecast_risk_by_profile", " " + " union all ".join(
    f"select 'p{k:02d}' as profile, risk_level, count(*) as n_points, R6[avg(remaining_life_years)] as avg_remaining_life_years, "
    f"max(recommended_inspection_frequency_months) as max_interval_months from (with "
    + _FB.format(minimum=2.0 + k / 10, sf=1.0 + k % 4 / 4, lo=6 + k, hi=60 + 2 * k, **_FB_R).lstrip(",\n") + " select * from fb) group by risk_level"
    for k in range(20)))

_q("contract_report", _VARIED + """,
n as (select *, cast(('0x' || substr(md5(id_number), 1, 8)) as bigint) as n from points),
s as (select id_number, commodity, feature_type,
    average_corrosion_rate + case when n % 11 = 0 then 5.0::double when n % 13 = 0 then -1.0::double else 0.0::double end
      as average_corrosion_rate,
    thickness_mm * case when n % 17 = 0 then 0.0::double when n % 19 = 0 then 9.0::double else 1.0::double end as thickness_mm,
    case when n % 23 = 0 then 'Spiral' else cml_shape end as cml_shape,
    case when n % 29 = 0 then 'soon' else cast(last_inspection_date as varchar) end as last_inspection_date from n)
""" + " union all ".join(
    f"select '{k}' as contract, '{r}' as rule, '{c}' as column_name, '{sev}' as severity, "
    f"count(*) as n_violations, min(id_number) as example from {t} where {cond}" for k, r, c, sev, t, cond in _RULES_SQL))


_q("row_contract_split_narrow", """,
r as (select id_number, nullif(""" + _POINT_REASONS.replace("> 5.0", "> 0.2").replace("> 50.0", "> 9.0") + """, '') as reasons
      from points)
select id_number, reasons is null as is_valid, reasons from r
""")

_q("domain_check_narrow", """,
u as (
  select 'feature_type' as column_name, feature_type as value from raw where feature_type not in ('Pipe', 'Elbow', 'Tee')
  union all select 'cml_shape', cml_shape from raw where cml_shape not in ('Internal', 'External'))
select column_name, value, count(*) as n_points from u group by column_name, value
""")

_q("low_remaining_life", """,
l as (select id_number, case when average_corrosion_rate = 0 or average_corrosion_rate is null or thickness_mm is null then null
       else greatest((thickness_mm - 3.0::double) / average_corrosion_rate, 0.0::double) end as remaining_life_years from points)
select id_number, remaining_life_years, case when remaining_life_years < 10.0::double then 1 else 0 end as low_remaining_life
from l
""")

_q("remove_overrides_logged", CUR + """
select * from cur where id_number not in (select id_number from points where commodity = 'Steam')
""")

_q("advanced_statistics_commodity_risk", AN + """
select commodity, count(*) as n_points, R6[avg(average_corrosion_rate)] as avg_corrosion,
  count(*) filter (where raw_life < 2) as critical_count
from an where commodity is not null group by commodity
""")


# ---------------------------------------------------------------- sources
_q("dataset_preview", """
select id_number, average_corrosion_rate, thickness_mm, commodity, feature_type, cml_shape, last_inspection_date,
  (select count(*) from points) as total_rows
from points order by id_number limit 5
""")

_q("advanced_statistics_flat", AN + """
select count(*) as total_cmls,
  R6[avg(life)] as life_mean, R6[median(life)] as life_median, R6[stddev_samp(life)] as life_std,
  R6[min(life)] as life_min, R6[max(life)] as life_max,
  R6[quantile_cont(life, 0.1)] as life_p10, R6[quantile_cont(life, 0.25)] as life_p25,
  R6[quantile_cont(life, 0.75)] as life_p75, R6[quantile_cont(life, 0.9)] as life_p90,
  R6[avg(average_corrosion_rate)] as rate_mean, R6[median(average_corrosion_rate)] as rate_median,
  R6[stddev_samp(average_corrosion_rate)] as rate_std, max(average_corrosion_rate) as rate_max,
  count(*) filter (where average_corrosion_rate > 0.15::double) as high_corrosion_count,
  R6[avg(thickness_mm)] as thickness_mean, min(thickness_mm) as thickness_min,
  count(*) filter (where thickness_mm < 3.0::double) as below_min_count,
  count(*) filter (where thickness_mm < 5.0::double) as thin_wall_count,
  count(*) filter (where band4 = 'CRITICAL') as critical, count(*) filter (where band4 = 'HIGH') as high,
  count(*) filter (where band4 = 'MEDIUM') as medium, count(*) filter (where band4 = 'LOW') as low,
  count(*) filter (where life < 1) as immediate_attention, count(*) filter (where life < 2) as next_6_months,
  count(*) filter (where life < 3) as next_12_months, R6[avg(imonths)] as avg_interval_months
from an
""")


# ------------------------------------------------- kept up in batches, merged from parts
# Points whose latest reading deletes them are left out.
for _name in ("risk_matrix", "life_histogram", "portfolio_health", "commodity_risk"):
    ORACLE_SQL[f"incremental_{_name}"] = ORACLE_SQL[_name].replace("where rn = 1)", "where rn = 1 and l_returnflag <> 'A')", 1)

ORACLE_SQL["merged_profile"] = ORACLE_SQL["dataset_profile"]
ORACLE_SQL["merged_duplicate_ids"] = ORACLE_SQL["duplicate_ids"]
ORACLE_SQL["merged_null_counts"] = ORACLE_SQL["null_counts"]
