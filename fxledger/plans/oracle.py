"""DuckDB SQL for every registered query (the independent oracle).

The fixture views are written once as CTE text; each query appends its own
SELECT.  The tables (lineitem, orders, ...) are views the checker registers.
"""

from __future__ import annotations

CCY = ("case n_regionkey when 0 then 'GBP' when 1 then 'USD' when 2 then 'JPY' "
       "when 3 then 'EUR' else 'GBp' end")

FX_SYMBOL = ("case when {c} is null then null when {c} in ('GBP', 'GBp') then '-' "
             "when {c} = 'USD' then 'GBP=X' else {c} || 'GBP=X' end")

V_PX = f"""v_px as (
  select 'S' || cast(l_suppkey as varchar) as ticker, case when l_linenumber <> 7 then l_extendedprice / l_quantity end as old_price,
         cast(l_shipdate as date) as date, 'EQUITY' as type, {CCY} as currency,
         row_number() over (partition by l_suppkey, l_shipdate
                            order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) as ord
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey)"""

V_FX = """v_fx as (
  select * from (
    select case n_regionkey when 1 then 'GBP=X' when 2 then 'JPYGBP=X' else 'EURGBP=X' end as ticker,
           o_totalprice / 250000.0 as old_price,
           cast(o_orderdate as date) + (case when n_regionkey = 2 then 150 else 0 end) as date,
           'CURRENCY' as type, 'GBP' as currency,
           row_number() over (partition by n_regionkey, o_orderdate order by o_orderkey) as ord
    from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
    where n_regionkey in (1, 2, 3))
  where isodow(date) < 6)"""

V_RAW = "v_raw as (select * from v_px union all select * from v_fx)"

V_INST = f"""v_inst as (
  select 'S' || cast(s_suppkey as varchar) as ticker, s_suppkey,
         case when s_suppkey % 11 = 10 then null when s_suppkey % 5 = 0 then 'ETF' else 'EQUITY' end
           as quote_type,
         case when s_suppkey % 13 = 12 then null else {CCY} end as currency,
         case when s_suppkey % 4 = 3 then null
              else 788918400 + (s_suppkey % 40) * 90 * 86400 end as first_trade_epoch,
         case when s_acctbal < 500 then null else s_acctbal end as bid
  from supplier join nation on s_nationkey = n_nationkey)"""

V_REQ = """v_req as (
  select s_suppkey as pos, case when s_suppkey % 3 = 0 then lower(ticker) else ticker end as symbol
  from v_inst where s_suppkey % 2 = 0
  union all select 1000000 + s_suppkey, ticker from v_inst where s_suppkey % 10 = 0
  union all select 2000000 + n_nationkey, 'X' || cast(n_nationkey as varchar) from nation)"""

# Normalised instruments (INSTRUMENT), securities and FX pairs.
N_INST = """n_inst as (
  select upper(ticker) as ticker,
         make_timestamp(cast(first_trade_epoch as bigint) * 1000000) as earliest_ts,
         coalesce(quote_type, 'Unknown') as type, coalesce(currency, 'Unknown') as currency,
         case when isnan(bid) then null else bid end as bid
  from v_inst where ticker is not null)"""

N_FX_INST = """n_fx_inst as (
  select distinct ticker, cast(null as timestamp) as earliest_ts, 'CURRENCY' as type,
         'GBP' as currency, cast(null as double) as bid from v_fx)"""

# Deduplicated input of the conversion (keep the last arrival per symbol-day).
D_RAW = """d_raw as (
  select ticker, date, max_by(old_price, ord) as old_price, max_by(type, ord) as type,
         max_by(currency, ord) as currency, max(ord) as ord
  from v_raw where old_price is not null group by ticker, date)"""

RATES = """rates as (
  select ticker as fx_ticker, date, min_by(old_price, ord) as rate
  from {fx} where old_price is not null and not isnan(old_price) group by ticker, date)"""

SEC = f"""sec as (
  select *, {FX_SYMBOL.format(c='currency')} as fx_ticker,
         case when currency = 'GBP' then 1.0 when currency = 'GBp' then 0.01 end as fixed_rate
  from {{src}} where type is distinct from 'CURRENCY' and old_price is not null
    and not isnan(old_price) and date is not null and ticker is not null)"""

FXROWS = """fxrows as (
  select * from {src} where type = 'CURRENCY' and old_price is not null
    and not isnan(old_price) and date is not null and ticker is not null)"""

# As-of (backward, same day allowed) on the distinct pairs, then the back fill.
ASOF = """dom as (select distinct fx_ticker, date from sec
          where fixed_rate is null and fx_ticker is not null and fx_ticker <> '-'),
asofr as (select d.fx_ticker, d.date, r.rate from dom d
         asof left join rates r on d.fx_ticker = r.fx_ticker and d.date >= r.date),
filled as (select fx_ticker, date, rate as asof_rate,
                  coalesce(rate, first_value(rate ignore nulls) over (
                      partition by fx_ticker order by date
                      rows between current row and unbounded following)) as rate
           from asofr),
rated as (select s.*, coalesce(s.fixed_rate, f.rate) as rate from sec s
          left join filled f on s.fx_ticker = f.fx_ticker and s.date = f.date)"""


def with_views(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


def conversion_ctes(src: str = "d_raw", fx: str = "fxrows") -> list[str]:
    return [SEC.format(src=src), FXROWS.format(src=src), RATES.format(fx=fx), ASOF]


TEXT_PRICES = """t as (
  select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
         case when l_linenumber = 7 then 'n/a' when l_linenumber = 6 then ''
              else cast(l_extendedprice as varchar) end as price_text
  from lineitem)"""

EV = """ev as (
  select 'U' || cast(user_id as varchar) as ticker, value as old_price, cast(ts as date) as date,
         event_id as ord, ts, event_id from events)"""

D_PX = """d_px as (
  select ticker, date, max_by(old_price, ord) as old_price from v_px where old_price is not null
  group by ticker, date)"""

REQ = """req as (
  select upper(symbol) as ticker, min(pos) as pos from v_req where symbol is not null
  group by upper(symbol))"""

VALID = """valid as (
  select * from {inst} where length(ticker) > 0 and type <> 'Unknown' and currency <> 'Unknown'),
validated as (select r.pos, v.ticker, v.earliest_ts, v.type, v.currency, v.bid
              from req r join valid v on r.ticker = v.ticker)"""

NEED = f"""need as (
  select distinct fx_ticker from (select {FX_SYMBOL.format(c='currency')} as fx_ticker from validated)
  where fx_ticker is not null and fx_ticker <> '-'
    and fx_ticker not in (select ticker from validated))"""

N_ALL = "n_all as (select * from n_inst union all select * from n_fx_inst)"

BUSINESS_DAY = "isodow(x) < 6 and strftime(x, '%m-%d') not in ('01-01', '12-25', '12-26')"


def roll_fwd(d: str) -> str:
    return (f"list_min(list_filter(list_transform(range(0, 8), lambda k: ({d}) + cast(k as integer)),"
            f" lambda x: {BUSINESS_DAY}))")


def roll_back(d: str) -> str:
    return (f"list_max(list_filter(list_transform(range(0, 8), lambda k: ({d}) - cast(k as integer)),"
            f" lambda x: {BUSINESS_DAY}))")


def weekdays(a: str, b: str) -> str:
    return (f"cast(len(list_filter(generate_series({a}, {b}, interval 1 day), "
            f"lambda x: isodow(x) < 6)) as integer)")


def gaps(src: str, as_of: str) -> str:
    """Interval difference of (ticker, s, e, f, l) rows, as three branches."""
    return f"""gaps as (
  select * from (
    select ticker, s as gap_start, e as gap_end from {src} where s <= e and (f is null or l is null)
    union all
    select ticker, s, least(e, least(f, l) - 1) from {src}
    where s <= e and f is not null and l is not null and s < least(f, l)
      and s <= least(e, least(f, l) - 1)
    union all
    select ticker, greatest(s, greatest(f, l) + 1), e from {src}
    where s <= e and f is not null and l is not null and e > greatest(f, l)
      and greatest(s, greatest(f, l) + 1) <= e)
  where gap_start <> date '{as_of}')"""


def fill_ctes(src: str) -> str:
    """Calendar fill of the '=X' symbols of ``src(ticker, date, old_price)``."""
    return f"""fxspan as (select ticker, min(date) as lo, max(date) as hi from {src}
               where upper(ticker) like '%=X%' group by ticker),
grid as (select ticker, cast(unnest(generate_series(lo, hi, interval 1 day)) as date) as date
         from fxspan),
joined as (select g.ticker, g.date, h.old_price, h.ticker is null as filled
           from grid g left join {src} h on g.ticker = h.ticker and g.date = h.date),
fxfill as (select ticker, date, last_value(old_price ignore nulls) over (
               partition by ticker order by date rows between unbounded preceding and current row)
             as old_price, filled from joined)"""


CONV = """conv as (
  select ticker, old_price * rate as price, date from rated where rate is not null
  union all select ticker, old_price as price, date from fxrows)"""

V_RAW_NO_EUR = ("v_raw as (select * from v_px union all "
                "select * from v_fx where ticker <> 'EURGBP=X')")

COMPLETE = "old_price is not null and not isnan(old_price) and date is not null"


def convert_query(tail: str, eur: bool = True, extra: tuple[str, ...] = ()) -> str:
    return with_views(V_PX, V_FX, V_RAW if eur else V_RAW_NO_EUR, D_RAW,
                      *conversion_ctes(), *extra) + tail


CONVERT_PRICES = convert_query("""
select ticker, old_price * rate as price, date from rated where rate is not null
union all select ticker, old_price as price, date from fxrows""")

COERCED = ("case when isnan(try_cast(price_text as double)) then null "
           "else try_cast(price_text as double) end")

BOOK_WINDOW = f"""win as (
  select {roll_fwd("date '2001-11-01' - cast(round_even(0.5 * 365.25, 0) as integer)")} as wstart,
         {roll_back("date '2001-11-01'")} as wend)"""

_BOOK_CTES = (
    V_PX, V_FX, V_RAW, V_INST, V_REQ, N_INST, N_FX_INST, N_ALL, REQ, VALID.format(inst="n_all"),
    NEED,
    """full_set as (
  select ticker, earliest_ts, type, currency, bid from validated
  union all select v.ticker, v.earliest_ts, v.type, v.currency, v.bid
  from need n join valid v on n.fx_ticker = v.ticker)""",
    BOOK_WINDOW,
    """targets as (
  select f.ticker,
         cast(greatest(cast((select wstart from win) as timestamp),
                       coalesce(f.earliest_ts, cast((select wstart from win) as timestamp)))
              as date) as fetch_start,
         (select wend from win) as fetch_end
  from full_set f
  where f.earliest_ts is null or f.earliest_ts <= cast((select wend from win) as timestamp))""",
    """store as (select ticker, date, max_by(old_price, ord) as old_price, max(ord) as ord
          from v_raw where date <= date '2001-06-30' and old_price is not null group by ticker, date)""",
    "stored as (select * from store where ticker in (select ticker from targets))",
    "cov as (select ticker, min(date) as f, max(date) as l from stored group by ticker)",
    """rng as (select t.ticker, t.fetch_start as s, t.fetch_end as e, c.f, c.l
        from targets t left join cov c on t.ticker = c.ticker)""",
    gaps("rng", "2001-11-01"),
    """fetched as (select r.ticker, r.old_price, r.date, r.ord from v_raw r
            join gaps g on r.ticker = g.ticker and r.date between g.gap_start and g.gap_end)""",
    f"""u as (select ticker, old_price, date, ord, 0 as src from stored where {COMPLETE}
       union all select ticker, old_price, date, ord, 1 from fetched where {COMPLETE})""",
    """hist as (select ticker, date, max_by(old_price, row(src, ord)) as old_price
         from u group by ticker, date)""",
    fill_ctes("hist"),
    """bars as (select ticker, old_price, date from fxfill
         union all select ticker, old_price, date from hist where upper(ticker) not like '%=X%')""",
    "lastd as (select ticker, max(date) as ld from bars group by ticker)",
    """quotes as (select l.ticker, f.bid as old_price, date '2001-11-01' as date
           from lastd l join full_set f on l.ticker = f.ticker
           where l.ld < date '2001-11-01' and f.bid is not null and not isnan(f.bid) and f.bid > 0)""",
    """enriched as (
  select a.ticker, a.old_price, a.date, f.type, f.currency, 0 as ord
  from (select * from bars union all select * from quotes) a
  left join full_set f on a.ticker = f.ticker)""",
    *conversion_ctes(src="enriched"),
    CONV,
)

PRICE_BOOK = with_views(*_BOOK_CTES) + """select c.ticker, c.price, strftime(c.date, '%d/%m/%Y') as date
from conv c where c.date >= (select wstart from win)"""


_NO_EUR_CTES = tuple(c.replace("from v_fx)", "from v_fx where ticker <> 'EURGBP=X')")
                     if c is N_FX_INST else c for c in _BOOK_CTES)

BOOK_UNRESOLVED = with_views(*_NO_EUR_CTES) + """select ticker, date, currency, fx_ticker
from rated where rate is null and date >= (select wstart from win)"""


def oracle_sql() -> dict[str, str]:
    return {
        "bar_normalise": f"""
select 'U' || cast(user_id as varchar) as ticker, value as old_price, cast(ts as date) as date
from events where value is not null and not isnan(value) and ts is not null""",
        "coerce_numeric": with_views(TEXT_PRICES) + f"""
select l_orderkey, l_linenumber, l_partkey, {COERCED} as old_price from t""",
        "coerce_day": """
select l_orderkey, l_linenumber, l_partkey,
       cast(coalesce(try_strptime(txt, '%d/%m/%Y'), try_cast(txt as timestamp)) as date) as date
from (select *, case when l_linenumber = 7 then 'n/a'
                     when l_linenumber = 6 then strftime(l_shipdate, '%Y-%m-%d')
                     else strftime(l_shipdate, '%d/%m/%Y') end as txt from lineitem)""",
        "normalise_epoch": """
select event_id, v as epoch_value,
       cast(case when abs(v) < 10000000000 then make_timestamp(abs(v) * 1000000)
                 else make_timestamp(abs(v) * 1000) end as date) as date
from (select event_id,
             case event_id % 3 when 0 then datediff('second', timestamp '1970-01-01', ts)
                               when 1 then datediff('millisecond', timestamp '1970-01-01', ts)
                               else -datediff('second', timestamp '1970-01-01', ts) end as v
      from events)""",
        "drop_incomplete": with_views(TEXT_PRICES) + f"""
select * from (
  select l_orderkey, l_linenumber, l_partkey, 'S' || cast(l_suppkey as varchar) as ticker,
         {COERCED} as old_price, cast(l_shipdate as date) as date from t)
where old_price is not null and date is not null and ticker is not null""",
        "dedupe_last": with_views(V_PX) + """
select ticker, date, max_by(old_price, ord) as old_price, max_by(type, ord) as type,
       max_by(currency, ord) as currency
from v_px where old_price is not null group by ticker, date""",
        "split_by_type": with_views(V_PX, V_FX, V_INST) + """
select ticker, date, old_price, type,
       case when type is not distinct from 'CURRENCY' then 'fx' else 'security' end as side
from (select p.ticker, p.date, p.old_price, i.quote_type as type
      from v_px p left join v_inst i on p.ticker = i.ticker
      union all select ticker, date, old_price, type from v_fx)""",
        "first_rate": with_views(V_FX, RATES.format(fx="v_fx")) + "select * from rates",
        "fx_symbol": with_views(V_INST) + f"""
select ticker, currency, {FX_SYMBOL.format(c='currency')} as fx_ticker from v_inst""",
        "enrich_prices": with_views(V_PX, V_INST, N_INST) + """
select p.ticker, p.old_price, p.date, n.type, n.currency
from v_px p left join n_inst n on p.ticker = n.ticker""",
        "asof_rates": convert_query("""
select s.ticker, s.date, s.fx_ticker, a.rate
from sec s left join asofr a on s.fx_ticker = a.fx_ticker and s.date = a.date"""),
        "backfill_rates": convert_query("""
select s.ticker, s.date, s.fx_ticker, f.rate,
       case when f.fx_ticker is not null then f.asof_rate is null and f.rate is not null end
         as backfilled
from sec s left join filled f on s.fx_ticker = f.fx_ticker and s.date = f.date"""),
        "convert_prices": CONVERT_PRICES,
        "unresolved_rates": convert_query("""
select ticker, date, currency, fx_ticker from rated where rate is null""", eur=False),
        "conversion_check": convert_query("""
select ticker, date, price, rate * old_price as expected
from (select *, old_price * rate * (case when day(date) = 13 then 1.25::double else 1.0::double end)
             as price
      from rated where rate is not null)
where abs(rate * old_price - price) > 1e-6"""),
        "conversion_summary": convert_query("""
select count(*) as n_rows,
       count(*) filter (where (fx_ticker is null or fx_ticker <> '-') and rate is not null)
         as n_fx_converted,
       count(*) filter (where fx_ticker = '-') as n_home,
       count(*) filter (where rate is null) as n_unresolved
from rated"""),
        "date_coverage": convert_query("""
select count(*) filter (where s = 1) as n_security_days,
       count(*) filter (where f = 1) as n_fx_days,
       count(*) filter (where s = 1 and f = 1) as n_common_days,
       count(*) filter (where s = 1 and f = 0) as n_security_only_days,
       count(*) filter (where s = 0 and f = 1) as n_fx_only_days
from (select date, max(s) as s, max(f) as f
      from (select date, 1 as s, 0 as f from sec union all select date, 0, 1 from fxrows)
      group by date)"""),
        "business_day_roll": f"""
select d as day, {roll_fwd('d')} as rolled_start, {roll_back('d')} as rolled_end
from (select distinct cast(o_orderdate as date) as d from orders)""",
        "business_day_count": with_views(V_PX, D_PX) + f"""
select ticker, first_date, last_date, {weekdays('first_date', 'last_date')} as n_business_days
from (select ticker, min(date) as first_date, max(date) as last_date from d_px group by ticker)""",
        "collection_window": f"""
with w as (select distinct cast(o_orderdate as date) as as_of,
                  cast(round_even(0.16 * 365.25, 0) as integer) as n_days from orders),
r as (select as_of, n_days, {roll_fwd('as_of - n_days')} as start_date,
             {roll_back('as_of')} as end_date from w)
select as_of, n_days, start_date, end_date, {weekdays('start_date', 'end_date')} as n_business_days
from r""",
        "fx_calendar_fill": with_views(
            V_FX, "d as (select ticker, date, max_by(old_price, ord) as old_price from v_fx "
                  "group by ticker, date)", fill_ctes("d")) + "select * from fxfill",
        "fx_fill_summary": with_views(
            V_FX, "d as (select ticker, date, max_by(old_price, ord) as old_price from v_fx "
                  "group by ticker, date)", fill_ctes("d")) + """
select ticker, count(*) as n_days, count(*) filter (where filled) as n_filled
from fxfill group by ticker""",
        "append_provisional": with_views(V_PX, V_INST, N_INST, D_PX, """q as (
  select l.ticker, n.bid as old_price, date '2001-11-01' as date
  from (select ticker, max(date) as last_date from d_px group by ticker) l
  join n_inst n on l.ticker = n.ticker
  where l.last_date < date '2001-11-01' and n.bid is not null and not isnan(n.bid)
    and n.bid > 0)""") + """
select ticker, old_price, date, false as provisional from d_px
union all select ticker, old_price, date, true as provisional from q""",
        "instrument_normalise": with_views(V_INST, N_INST) + "select * from n_inst",
        "validate_instruments": with_views(V_INST, V_REQ, N_INST, REQ, VALID.format(inst="n_inst"))
        + "select * from validated",
        "request_rejects": with_views(V_INST, V_REQ, N_INST, REQ) + """
select * from (
  select r.pos, r.ticker,
         case when n.type is null then 'unknown symbol' when length(r.ticker) = 0 then 'empty symbol'
              when n.type = 'Unknown' then 'missing type'
              when n.currency = 'Unknown' then 'missing currency' end as reason
  from req r left join n_inst n on r.ticker = n.ticker)
where reason is not null""",
        "required_fx": with_views(V_INST, V_REQ, N_INST, REQ, VALID.format(inst="n_inst"), NEED)
        + "select fx_ticker from need",
        "full_instrument_set": with_views(V_FX, V_INST, V_REQ, N_INST, N_FX_INST, N_ALL, REQ,
                                          VALID.format(inst="n_all"), NEED) + """
select pos, ticker, earliest_ts, type, currency, bid from validated
union all
select cast(null as bigint) as pos, v.ticker, v.earliest_ts, v.type, v.currency, v.bid
from need n join valid v on n.fx_ticker = v.ticker""",
        "store_coverage": with_views(V_PX, D_PX) + """
select ticker, min(date) as first_date, max(date) as last_date, count(*) as n_days
from d_px group by ticker""",
        "store_status": with_views(V_INST, V_REQ, REQ, TEXT_PRICES, f"""raw as (
  select 'S' || cast(l_suppkey as varchar) as ticker, {COERCED} as p,
         cast(l_shipdate as date) as date from t)""", """st as (
  select ticker, count(distinct date) as n_days, min(date) as first_date, max(date) as last_date,
         bool_or(strftime(date, '%Y-%m') = '2001-11') as lost
  from raw where date is not null and p is not null group by ticker)""") + """
select r.ticker,
       case when s.ticker is null then 'not_found' when s.lost then 'empty' else 'loaded' end as status,
       case when not s.lost then s.first_date end as first_date,
       case when not s.lost then s.last_date end as last_date,
       case when not s.lost then s.n_days else 0 end as n_days
from req r left join st s on r.ticker = s.ticker""",
        "history_summary": with_views(V_PX, D_PX) + """
select count(*) as n_rows, count(distinct ticker) as n_symbols from d_px""",
        "clip_to_listing": with_views(V_INST, N_INST) + """
select ticker,
       cast(greatest(timestamp '1996-01-01', coalesce(earliest_ts, timestamp '1996-01-01'))
            as date) as fetch_start,
       date '2000-06-30' as fetch_end
from n_inst where earliest_ts is null or earliest_ts <= timestamp '2000-06-30'""",
        "missing_ranges": with_views(
            EV,
            """sd as (select ticker, date, max_by(old_price, ord) as old_price from ev
        where date <= date '2024-01-20' and date >= date '2024-01-06'
        group by ticker, date)""",
            "cov as (select ticker, min(date) as f, max(date) as l from sd group by ticker)",
            """rng as (select t.ticker, date '2024-01-01' as s, date '2024-01-30' as e, c.f, c.l
        from (select distinct ticker from ev) t left join cov c on t.ticker = c.ticker)""",
            gaps("rng", "2024-01-21")) + "select ticker, gap_start, gap_end from gaps",
        "history_range_scan": with_views(V_PX, D_PX, V_INST, N_INST, """clip as (
  select ticker,
         cast(greatest(timestamp '1996-01-01', coalesce(earliest_ts, timestamp '1996-01-01'))
              as date) as fetch_start,
         date '2000-06-30' as fetch_end
  from n_inst where earliest_ts is null or earliest_ts <= timestamp '2000-06-30')""") + """
select p.ticker, p.date, p.old_price from d_px p
join clip c on p.ticker = c.ticker and p.date between c.fetch_start and c.fetch_end""",
        "upsert_prices": with_views(EV, f"""u as (
  select ticker, old_price, date, ord, 0 as src from ev
  where date <= date '2024-01-20' and {COMPLETE}
  union all
  select ticker, old_price * cast(1.01 as double), date, ord, 1 from ev
  where date >= date '2024-01-18' and {COMPLETE})""") + """
select ticker, date, max_by(old_price, row(src, ord)) as old_price from u group by ticker, date""",
        "store_roundtrip": with_views(EV) + f"""
select ticker, max_by(old_price, ord) as old_price, date from ev where {COMPLETE}
group by ticker, date""",
        "store_expiry": with_views(
            EV, "st as (select * from ev)",
            "d as (select ticker, date, max_by(old_price, ord) as old_price from st "
            "group by ticker, date)",
            "w as (select ticker, max(ts) as last_write from st group by ticker)") + """
select d.ticker, d.date, d.old_price from d join w on d.ticker = w.ticker
where w.last_write >= timestamp '2024-02-09 18:00:00' - interval 20 day""",
        "export_rows": convert_query("""
select row_number() over (order by date desc, ticker) as pos, ticker, price,
       strftime(date, '%d/%m/%Y') as date
from conv where date >= date '2001-06-01'""", extra=(CONV,)),
        "convert_sorted": convert_query("""
select row_number() over (order by date, ticker) as pos, ticker, price, date from conv""", extra=(CONV,)),
        "export_csv": convert_query("""
select row_number() over (order by date desc, ticker) as pos, ticker, price, date,
       cast(null as varchar) as corrupt
from conv where date >= date '2001-06-01'""", extra=(CONV,)),
        "bar_rejects": with_views(TEXT_PRICES, f"""raw as (
  select l_orderkey, l_linenumber, l_partkey,
         case when not (l_linenumber = 5 and l_orderkey % 2 = 1)
              then 'S' || cast(l_suppkey as varchar) end as ticker,
         case when l_linenumber = 4 and l_orderkey % 2 = 1 then null
              else cast(l_shipdate as date) end as date,
         case when l_linenumber = 3 and l_orderkey % 2 = 1 then 'NaN' else price_text end as said
  from t)""") + """
select ticker, try_cast(nullif(said, 'NaN') as double) as old_price, date, l_orderkey, l_linenumber,
       l_partkey, reason
from (select *, case when ticker is null then 'no symbol' when date is null then 'bad day'
                     when said is null or trim(said) = '' or lower(trim(said)) = 'nan' then 'no price'
                     when try_cast(said as double) is null then 'bad price' end as reason
      from raw)
where reason is not null""",
        "store_gaps": with_views(
            EV,
            f"""sd as (select distinct ticker, date from ev
        where {COMPLETE} and ((date between date '2024-01-06' and date '2024-01-18' and ord % 2 = 1)
          or (date between date '2024-01-18' and date '2024-01-20' and ord % 2 = 0)))""",
            "cov as (select ticker, min(date) as f, max(date) as l, count(*) as n_days from sd group by ticker)",
            """rng as (select t.ticker, date '2024-01-01' as s, date '2024-01-30' as e, c.f, c.l
        from (select distinct ticker from ev) t left join cov c on t.ticker = c.ticker)""",
            gaps("rng", "2024-01-21")) + """
select g.ticker, g.gap_start, g.gap_end, c.n_days, case when c.ticker is not null then true end as as_recounted
from gaps g left join cov c on g.ticker = c.ticker""",
        "price_book": PRICE_BOOK,
        "book_unresolved": BOOK_UNRESOLVED,
        "book_rejects": with_views(V_FX, V_INST, V_REQ, N_INST, N_FX_INST, N_ALL, REQ) + """
select * from (
  select r.pos, r.ticker,
         case when n.type is null then 'unknown symbol' when length(r.ticker) = 0 then 'empty symbol'
              when n.type = 'Unknown' then 'missing type'
              when n.currency = 'Unknown' then 'missing currency' end as reason
  from req r left join n_all n on r.ticker = n.ticker)
where reason is not null""",
        "price_book_stored": PRICE_BOOK,
    }
