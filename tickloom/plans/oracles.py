"""DuckDB SQL with the rows of the market queries."""

from __future__ import annotations

from ..schemas import FEATURE_CATEGORIES

TICKS = "t as (select event_type symbol, ts as time, 100 + value price, cast(value as decimal(18,2)) size, event_id seq from events)"
BARS = f"""{TICKS},
    b as (select symbol, time_bucket(interval '1 hour', time) as time, first(price order by time, seq) open, max(price) high, min(price) low,
                 last(price order by time, seq) close, cast(sum(size) as double) volume, count(*)::integer trades from t group by 1, 2),
    bi as (select *, row_number() over (partition by symbol order by time) - 1 idx from b)"""


def _w(n: int) -> str:
    return f"(partition by symbol order by time rows between {n - 1} preceding and current row)"


def full(agg: str, x: str, n: int) -> str:
    """agg(x) over the last n rows, where x is there in all of them."""
    return f"(case when count({x}) over {_w(n)} = {n} then {agg}({x}) over {_w(n)} end)"


def z(x: str, n: int) -> str:
    return f"(({x} - {full('avg', x, n)}) / {full('stddev_samp', x, n)})"


def out(columns: dict[str, str], digits: int = 6, scale: dict[str, float] | None = None) -> str:
    parts = []
    for name, x in columns.items():
        x = f"({x}) * {scale[name]}" if scale and name in scale else x
        parts.append(f"case when isfinite({x}) then round({x}, {digits}) + 0.0 end as {name}")
    return ", ".join(parts)


LAG = lambda x, k=1: f"lag({x}, {k}) over (partition by symbol order by time)"
R = f"r as (select *, {', '.join(f'ln(close / {LAG('close', k)}) as ret_{k}' for k in (1, 5, 15, 30, 60, 240))} from b)"

RETURNS = f"""with {BARS}, {R}, q as (select *, {LAG('ret_1')} as before from r)
select symbol, time, {out({f'ret_{k}': f'ret_{k}' for k in (1, 5, 15, 30, 60, 240)} | {
    'ret_co': 'ln(close / open)', 'wick_up': 'ln(high / greatest(open, close))', 'wick_dn': 'ln(least(open, close) / low)',
    'price_pos_60': f"(close - {full('min', 'low', 60)}) / ({full('max', 'high', 60)} - {full('min', 'low', 60)})", 'ret_accel': 'ret_1 - before'})} from q"""

VOLATILITY = f"""with {BARS}, {R},
    q as (select *, pow(ln(high / low), 2) hl, 0.5 * pow(ln(high / low), 2) - (2 * ln(2) - 1) * pow(ln(close / open), 2) gk, pow(ret_1, 2) sq, pow(case when ret_1 < 0 then ret_1 else 0.0 end, 2) dn from r),
    v as (select *, sqrt({full('sum', 'sq', 30)}) rv from q)
select symbol, time, {out({'realized_vol_30': 'rv', 'parkinson_30': f"sqrt({full('avg', 'hl', 30)} / (4 * ln(2)))", 'garman_klass_30': f"sqrt({full('avg', 'gk', 30)})", 'downside_vol_30': f"sqrt({full('avg', 'dn', 30)})", 'vol_of_vol_60': full('stddev_samp', 'rv', 60)})} from v"""

VOLUME = f"""with {BARS} select symbol, time, {out({'volume_log': 'ln(1 + volume)', 'volume_z_60': z('volume', 60), 'volume_ratio_5_30': f"{full('avg', 'volume', 5)} / {full('avg', 'volume', 30)}", 'trade_count_log': 'ln(1 + trades)'})} from b"""

_PAIR = lambda f, x, y, n: f"(case when count({x} * {y}) over {_w(n)} = {n} then {f}({x}, {y}) over {_w(n)} end)"
MICRO = f"""with {BARS}, {R},
    q as (select *, {LAG('ret_1')} as rl, sign(ret_1) * close * volume flow, case when ret_1 > 0 then volume when ret_1 < 0 then -volume else 0 end side from r),
    c as (select *, {_PAIR('covar_pop', 'ret_1', 'rl', 30)} cov from q)
select symbol, time, {out({'amihud_illiq': 'abs(ret_1) / (close * volume)', 'kyle_lambda': f"{_PAIR('covar_pop', 'ret_1', 'flow', 30)} / {full('var_pop', 'flow', 30)}", 'vpin_50': f"abs({full('sum', 'side', 50)}) / {full('sum', 'volume', 50)}", 'roll_spread': '2 * sqrt(case when cov < 0 then -cov else 0.0 end)'}, 6, {'amihud_illiq': 1e6, 'kyle_lambda': 1e6})} from c"""

BANDS = f"""with {BARS}, q as (select *, {full('avg', 'close', 20)} m, {full('stddev_pop', 'close', 20)} s, {full('min', 'low', 14)} lo, {full('max', 'high', 14)} hi from b)
select symbol, time, {out({'bb_pctb_20': 'case when s > 0 then (close - m + 2 * s) / (4 * s) when s = 0 then 0.5 end', 'stoch_k_14': 'case when hi > lo then (close - lo) / (hi - lo) * 100 when hi <= lo then 50.0 end'})} from q"""

TEMPORAL = f"""with {BARS} select symbol, time, {out({'hour_sin': 'sin(2 * pi() * hour(time) / 24)', 'hour_cos': 'cos(2 * pi() * hour(time) / 24)', 'dow_sin': 'sin(2 * pi() * isodow(time) / 7)', 'dow_cos': 'cos(2 * pi() * isodow(time) / 7)'})} from b"""

ASOF = """with v as (select event_id, user_id, ts as time from events where event_type = 'view'), c as (select user_id, ts as time, value click_value, event_id click_id from events where event_type = 'click')
select v.event_id, v.user_id, v.time, c.click_value, c.click_id from v asof left join c on v.user_id = c.user_id and v.time >= c.time"""

FUNDING = f"""with {BARS}, f as (select symbol, time, cast(size as double) / 1e4 funding_rate, price * 1000 open_interest, seq from t),
    last as (select * from f qualify row_number() over (partition by symbol, time order by seq desc) = 1),
    j as (select b.symbol, b.time, f.funding_rate, f.open_interest from b asof left join last f on b.symbol = f.symbol and b.time >= f.time), k as (select *, {LAG('open_interest')} as was from j)
select symbol, time, {out({'funding_rate': 'funding_rate', 'funding_z_60': z('funding_rate', 60), 'oi_log': 'ln(1 + open_interest)', 'oi_change': 'ln(open_interest / was)'}, 6, {'funding_rate': 1e4})} from k"""

_SZ = lambda side, i: f"coalesce({side}_sz[{i + 1}], 0)"
_TOP = lambda side, n: f"coalesce(list_sum({side}_sz[1:{n}]), 0)"
_STATES = {
    "obi_l1": f"({_SZ('bid', 0)} - {_SZ('ask', 0)}) / ({_SZ('bid', 0)} + {_SZ('ask', 0)})", "obi_l5": f"({_TOP('bid', 5)} - {_TOP('ask', 5)}) / ({_TOP('bid', 5)} + {_TOP('ask', 5)})", "obi_l10": f"({_TOP('bid', 10)} - {_TOP('ask', 10)}) / ({_TOP('bid', 10)} + {_TOP('ask', 10)})",
    "bid_depth_5_log": f"ln(1 + {_TOP('bid', 5)})", "ask_depth_5_log": f"ln(1 + {_TOP('ask', 5)})", "depth_ratio_5": f"{_TOP('bid', 5)} / {_TOP('ask', 5)}",
    "obi_weighted": f"({' + '.join(f'({_SZ("bid", i)} - {_SZ("ask", i)}) / {i + 1}.0::double' for i in range(5))}) / ({' + '.join(f'({_SZ("bid", i)} + {_SZ("ask", i)}) / {i + 1}.0::double' for i in range(5))})",
    "microprice_dev": f"((bid_px[1] * {_SZ('ask', 0)} + ask_px[1] * {_SZ('bid', 0)}) / ({_SZ('bid', 0)} + {_SZ('ask', 0)}) - mid) / mid",
    "bid_slope": f"{_TOP('bid', 5)} / (bid_px[1] - bid_px[5])", "ask_slope": f"{_TOP('ask', 5)} / (ask_px[5] - ask_px[1])", "spread_bps": "(ask_px[1] - bid_px[1]) / mid * 1e4",
}
BOOK = f"""with {TICKS},
    k as (select symbol, time, (seq % 7 + 2)::integer n, price, cast(size as double) s from t),
    o as (select symbol, time, [price - 0.5 * (i + 1) for i in range(n)] bid_px, [s + i for i in range(n)] bid_sz, [price + 0.5 * (i + 1) for i in range(n)] ask_px, [s + 2 * i + 1 for i in range(n)] ask_sz from k),
    m as (select *, time_bucket(interval '1 hour', time) bar, (bid_px[1] + ask_px[1]) / 2 mid, lead(time) over w nxt, lag(bid_px[1]) over w bpp, lag(ask_px[1]) over w app, lag(bid_sz[1]) over w bsp, lag(ask_sz[1]) over w asp
          from o window w as (partition by symbol order by time)),
    s as (select symbol, bar, greatest((epoch_us(least(coalesce(nxt, bar + interval '1 hour'), bar + interval '1 hour')) - epoch_us(time)) / 1e6, 0) dwell, {', '.join(f'{x} as {n}' for n, x in _STATES.items())},
                 (case when bid_px[1] >= bpp then bid_sz[1] else 0 end - case when bid_px[1] <= bpp then bsp else 0 end) - (case when ask_px[1] <= app then ask_sz[1] else 0 end - case when ask_px[1] >= app then asp else 0 end) inc from m),
    g as (select symbol, bar as time, {', '.join(f'coalesce(sum({n} * dwell), 0) / sum(dwell) as {n}' for n in _STATES)}, coalesce(sum(inc), 0) ofi from s group by 1, 2)
select symbol, time, {out({n: n for n in _STATES} | {'spread_z_60': z('spread_bps', 60), 'spread_vol_30': full('stddev_samp', 'spread_bps', 30), 'ofi': 'ofi'})} from g"""

CROSS = f"""with {BARS}, {R}, n as (select min(symbol) a from b), o as (select distinct symbol, case when symbol = a then (select min(symbol) from b where symbol > a) else a end other from b, n),
    m as (select x.symbol, x.time, x.ret_1 u, y.ret_1 v from r x join o on x.symbol = o.symbol join r y on y.symbol = o.other and y.time = x.time)
select symbol, time, {out({'cross_corr_60': f"{_PAIR('covar_pop', 'u', 'v', 60)} / sqrt((case when count(u * v) over {_w(60)} = 60 then var_pop(u) over {_w(60)} end) * (case when count(u * v) over {_w(60)} = 60 then var_pop(v) over {_w(60)} end))", 'cross_beta_60': f"{_PAIR('covar_pop', 'u', 'v', 60)} / {full('var_pop', 'v', 60)}", 'cross_ret_spread': 'u - v'})} from m"""

_EMA = lambda name, x, span: f"{2 / (span + 1)!r} * {x} + {1 - 2 / (span + 1)!r} * s.{name}"
_RMA = lambda name, x, at: f"case when n.idx < {at} then s.{name} + {x} when n.idx = {at} then (s.{name} + {x}) / 14 else (s.{name} * 13 + {x}) / 14 end"
_D = 1 - 2 / 101
RECURSIVE = f"""with recursive {BARS},
    p as (select *, lag(close) over (partition by symbol order by idx) pc from bi),
    q as (select symbol, time, idx, close, high - low hl, case when pc is null then high - low else greatest(high - low, abs(high - pc), abs(low - pc)) end tr, greatest(close - pc, 0) up, greatest(pc - close, 0) dn, ln(close / pc) r from p),
    s as (select symbol, time, idx, close, close e12, close e26, 0.0::double sg, 0.0::double u, 0.0::double d, tr a, 0.0::double x, 0.0::double xx, 0.0::double s1, 0.0::double s2 from q where idx = 0
          union all
          select n.symbol, n.time, n.idx, n.close, {_EMA('e12', 'n.close', 12)}, {_EMA('e26', 'n.close', 26)}, 0.2 * (({_EMA('e12', 'n.close', 12)}) - ({_EMA('e26', 'n.close', 26)})) + 0.8 * s.sg,
                 {_RMA('u', 'n.up', 14)}, {_RMA('d', 'n.dn', 14)}, {_RMA('a', 'n.tr', 13)}, n.r + {_D!r} * s.x, n.r * n.r + {_D!r} * s.xx, 1 + {_D!r} * s.s1, 1 + {_D * _D!r} * s.s2
          from s join q n on n.symbol = s.symbol and n.idx = s.idx + 1)
select symbol, time, {out({
    'sigma_ewma': 'case when idx >= 2 then sqrt(greatest(xx / s1 - (x / s1) * (x / s1), 0) * s1 * s1 / (s1 * s1 - s2)) end',
    'rsi_14': 'case when idx >= 14 then case when d = 0 then case when u > 0 then 100.0 else 50.0 end else 100 - 100 / (1 + u / d) end end',
    'macd_line': 'e12 - e26', 'macd_signal': 'sg', 'macd_hist': 'e12 - e26 - sg', 'atr_14': 'case when idx >= 13 then a / close end'})} from s"""

ADX = f"""with recursive {BARS},
    p as (select symbol, time, idx, high - lag(high) over w u, lag(low) over w - low d from bi window w as (partition by symbol order by idx)),
    q as (select symbol, time, idx, case when u > d and u > 0 then u else 0.0 end plus, case when d > u and d > 0 then d else 0.0 end minus from p),
    s as (select symbol, time, idx, 0.0::double p, 0.0::double m, 0.0::double a from q where idx = 0
          union all
          select symbol, time, idx, p, m, case when idx < 14 then 0.0 when idx < 27 then a + dx when idx = 27 then (a + dx) / 14 else (a * 13 + dx) / 14 end
          from (select *, case when p + m = 0 then 0.0 else 100 * abs(p - m) / (p + m) end dx
                from (select n.symbol, n.time, n.idx, {_RMA('p', 'n.plus', 14)} p, {_RMA('m', 'n.minus', 14)} m, s.a from s join q n on n.symbol = s.symbol and n.idx = s.idx + 1)))
select symbol, time, {out({'adx_14': 'case when idx >= 27 then a end'})} from s"""

#: The parts of features_all that have a row for each bar, and those that may not.
_WHOLE = (RETURNS, VOLATILITY, VOLUME, MICRO, BANDS, TEMPORAL, RECURSIVE, ADX, FUNDING)
ALL = "select * from " + " join ".join(f"({q}) as part{k}" if not k else f"({q}) as part{k} using (symbol, time)" for k, q in enumerate(_WHOLE)) + f" left join ({BOOK}) as book using (symbol, time) left join ({CROSS}) as cross_ using (symbol, time)"


def _filled(category: str, query: str) -> str:
    cells = f"(select count(*) from (unpivot (select * exclude (symbol, time) from ({query})) on columns(*) into name k value v))"
    return f"select '{category}' as category, round({cells}::double / (select count(*) * {len(FEATURE_CATEGORIES[category]) - (category == 'volatility')} from ({query})), 6) rate"


FILLED = " union all ".join(_filled(c, q) for c, q in (("price_return", RETURNS), ("volatility", VOLATILITY), ("volume", VOLUME)))

LOGRET = f"{BARS}, lr as (select *, ln(close / lag(close) over (partition by symbol order by idx)) r from bi)"
CUSUM = f"""with recursive {LOGRET},
    s as (select symbol, idx, 0.0::double up, 0.0::double dn, false fired from lr where idx = 0
          union all
          select n.symbol, n.idx, case when least(0, s.dn + n.r) >= -0.15 and greatest(0, s.up + n.r) > 0.15 then 0.0 else greatest(0, s.up + n.r) end, case when least(0, s.dn + n.r) < -0.15 then 0.0 else least(0, s.dn + n.r) end,
                 least(0, s.dn + n.r) < -0.15 or greatest(0, s.up + n.r) > 0.15
          from s join lr n on n.symbol = s.symbol and n.idx = s.idx + 1)
select symbol, idx from s where fired"""


def barrier_sql(pt: float, sl: float, horizon: int) -> str:
    """CTEs ending in `lab`: labels of every bar at volatility 0.02."""
    return f"""{BARS}, z as (select symbol, max(idx) n from bi group by symbol),
    e as (select bi.symbol, idx, time, close c0, close * exp({pt} * 0.02 * sqrt({horizon})) pt_level, close * exp(-{sl} * 0.02 * sqrt({horizon})) sl_level from bi join z on bi.symbol = z.symbol where idx + {horizon} <= n),
    h as (select e.symbol, e.idx, min(case when y.low <= sl_level or y.high >= pt_level then y.idx end) hit, max(y.idx) last from e join bi y on y.symbol = e.symbol and y.idx between e.idx + 1 and e.idx + {horizon} group by 1, 2),
    lab as (select e.*, coalesce(hit, last) touch_idx, k.time touch_time, f.time t1, case when hit is null then 0 when k.low <= sl_level then -1 else 1 end::smallint label, ln(f.close / c0) drift
            from e join h using (symbol, idx) join bi k on k.symbol = e.symbol and k.idx = coalesce(hit, last) join bi f on f.symbol = e.symbol and f.idx = last)"""


BARRIERS = f"""with {barrier_sql(1.3, 0.7, 12)},
    open as (select y.symbol, y.idx, count(l.idx) c from bi y left join lab l on l.symbol = y.symbol and y.idx between l.idx and l.touch_idx group by 1, 2),
    w as (select l.symbol, l.idx, avg(1.0::double / c) sample_weight from lab l join open o on o.symbol = l.symbol and o.idx between l.idx and l.touch_idx group by 1, 2)
select l.symbol, l.time, label, case label when 1 then 'pt' when -1 then 'sl' else 'vertical' end touch_barrier, t1, touch_time,
       {out({'ret': 'case label when 1 then 1.3 * 0.02 * sqrt(12) when -1 then -0.7 * 0.02 * sqrt(12) else drift end', 'pt_level': 'pt_level', 'sl_level': 'sl_level', 'sample_weight': 'least(sample_weight, 1.0)'})}
from lab l join w using (symbol, idx)"""

_WIDE = "sigma * sqrt(12)"
LABELS = f"""with recursive {LOGRET},
    sg as (select symbol, idx, 0.0::double x, 0.0::double xx, 0.0::double s1, 0.0::double s2 from lr where idx = 0
           union all
           select n.symbol, n.idx, n.r + {_D!r} * s.x, n.r * n.r + {_D!r} * s.xx, 1 + {_D!r} * s.s1, 1 + {_D * _D!r} * s.s2 from sg s join lr n on n.symbol = s.symbol and n.idx = s.idx + 1),
    v as (select lr.*, case when idx >= 2 then sqrt(greatest(xx / s1 - (x / s1) * (x / s1), 0) * s1 * s1 / (s1 * s1 - s2)) end sigma from lr join sg using (symbol, idx)),
    cs as (select symbol, idx, 0.0::double up, 0.0::double dn, false fired from v where idx = 0
           union all
           select symbol, idx, case when d >= -bar and u > bar then 0.0 else u end, case when d < -bar then 0.0 else d end, d < -bar or u > bar
           from (select n.symbol, n.idx, greatest(0, s.up + n.r) u, least(0, s.dn + n.r) d, case when sigma > 0 then {_WIDE} else 1e300 end bar from cs s join v n on n.symbol = s.symbol and n.idx = s.idx + 1)),
    z as (select symbol, max(idx) n from v group by symbol),
    e as (select v.symbol, v.idx, time, close c0, sigma, close * exp({_WIDE}) pt_level, close * exp(-{_WIDE}) sl_level from cs join v using (symbol, idx) join z on v.symbol = z.symbol where fired and v.idx + 12 <= n and sigma > 0),
    h as (select e.symbol, e.idx, min(case when y.low <= sl_level or y.high >= pt_level then y.idx end) hit, max(y.idx) last from e join v y on y.symbol = e.symbol and y.idx between e.idx + 1 and e.idx + 12 group by 1, 2),
    lab as (select e.*, coalesce(hit, last) touch_idx, k.time touch_time, f.time t1, case when hit is null then 0 when k.low <= sl_level then -1 else 1 end::smallint label, ln(f.close / c0) drift
            from e join h using (symbol, idx) join v k on k.symbol = e.symbol and k.idx = coalesce(hit, last) join v f on f.symbol = e.symbol and f.idx = last),
    open as (select y.symbol, y.idx, count(l.idx) c from v y left join lab l on l.symbol = y.symbol and y.idx between l.idx and l.touch_idx group by 1, 2),
    w as (select l.symbol, l.idx, avg(1.0::double / c) sample_weight from lab l join open o on o.symbol = l.symbol and o.idx between l.idx and l.touch_idx group by 1, 2)
select l.symbol, l.time, label, 1.0::double pt_mult, 1.0::double sl_mult, 12 horizon_bars, t1, touch_time, case label when 1 then 'pt' when -1 then 'sl' else 'vertical' end touch_barrier,
       {out({'ret': f'case label when 1 then {_WIDE} when -1 then -{_WIDE} else drift end', 'sigma': 'sigma', 'pt_level': 'pt_level', 'sl_level': 'sl_level', 'sample_weight': 'least(sample_weight, 1.0)'})}
from lab l join w using (symbol, idx)"""

TOY = f"""{barrier_sql(1.0, 1.0, 12)},
    f as (select symbol, time, idx, ln(close / {LAG('close')}) ret_1, ln(close / open) ret_co, {full('avg', 'volume', 5)} / {full('avg', 'volume', 30)} volume_ratio_5_30 from bi),
    ok as (select *, coalesce(isfinite(ret_1) and isfinite(ret_co) and isfinite(volume_ratio_5_30), false) fin from f),
    win as (select *, sum(fin::integer) over {_w(40)} n from ok),
    smp as (select l.symbol, w.idx e_idx, l.time t0, l.t1, (l.label + 1)::integer y, 1.0::double w from lab l join win w on w.symbol = l.symbol and w.time = l.time where n = 40)"""
SPLIT = f"""{TOY}, st as (select t0, row_number() over (order by t0) - 1 rn, count(*) over () n from smp),
    ed as (select k, t0 edge from range(0, 7) g(k) join st on rn = least(round_even(k / 6.0::double * n, 0), n - 1)),
    fo as (select a.k fold, a.edge s, b.edge e from ed a join ed b on b.k = a.k + 1 where a.k between 1 and 5),
    sp as (select *, case when t0 >= s and (t0 < e or (fold = 5 and t0 <= e)) then 'test' when t0 < s and t1 < s - interval '720 minutes' then 'train' end as role from smp, fo),
    va as (select fold from sp where role is not null group by fold having count(distinct role) = 2), rl as (select * from sp where role is not null and fold in (select fold from va))"""
SAMPLES = f"with {TOY} select * from smp"
FOLDS = f"with {SPLIT} select fold, role, count(*) n, min(t0) as first, max(t0) as last, max(t1) as last_t1 from rl group by all"
NORMALISER = f"""with {SPLIT}, cu as (select fold, min(t0) - interval '720 minutes' cutoff from rl where role = 'test' group by fold),
    ro as (select fold, ret_1, ret_co, volume_ratio_5_30 from ok join cu on ok.time < cutoff where fin), un as (unpivot ro on ret_1, ret_co, volume_ratio_5_30 into name name value v),
    ms as (select fold, name, avg(v) mean, case when stddev_pop(v) < 1e-12 then 1.0 else stddev_pop(v) end std from un group by all)
select fold, name, {out({'mean': 'mean', 'std': 'std'}, 8)} from ms"""
NORMALISED = f"""with {BARS}, {R} select symbol, time, {out({'ret_1': 'least(greatest(ret_1 / 0.01, case when ret_1 is null then null else -5 end), case when ret_1 is null then null else 5 end)', 'ret_co': 'least(greatest((ln(close / open) - 0.001) / 0.02, -5), 5)'})} from r""".replace(
    "least(greatest(ret_1 / 0.01, case when ret_1 is null then null else -5 end), case when ret_1 is null then null else 5 end)", "case when ret_1 is not null then least(greatest(ret_1 / 0.01, -5), 5) end"
)

CW = "cw as (select k y, greatest(coalesce(c, 1), 1) n from range(0, 3) g(k) left join (select quality, count(*) c from labels group by 1) on quality = k)"
CLASS_WEIGHTS = f"with {CW} select y::integer y, round((select sum(n) from cw) / (3 * n), 6)::double weight from cw"
CONFUSION = "select k::integer y, count(*) filter (toxic = 0) p0, count(*) filter (toxic = 1) p1, count(*) filter (toxic = 2) p2 from range(0, 3) g(k) left join labels on quality = k group by 1"
SCORES = """with m as (select k::integer y, (select count(*) from labels where quality = k and toxic = k) t, (select count(*) from labels where quality = k) a, (select count(*) from labels where toxic = k) p from range(0, 3) g(k)),
    s as (select y, case when p > 0 then t / p else 0 end pr, case when a > 0 then t / a else 0 end re, case when a + p > 0 then 2 * t / (a + p) else 0 end f from m)
select y, round(pr, 6)::double as precision, round(re, 6)::double recall, round(f, 6)::double f1, round((select avg((quality = toxic)::integer) from labels), 6) accuracy, round((select sum(f) / 3 from s), 6) macro_f1 from s"""
CROSS_ENTROPY = f"""with {CW}, d as (select quality y, (doc_id % 5 + 1)::double w, case quality when 0 then 0.2 when 1 then 0.5 + toxic * 0.1 else 0.3 - toxic * 0.1 end p from labels)
select round(sum(-ln(p) * ((select sum(n) from cw) / (3 * cw.n)) * w) / greatest(sum(w), 1e-8), 6) loss from d join cw on d.y = cw.y"""
SOFTMAX = """with e as (select vec_id, list_transform(embedding, lambda x: x::double) z from embeddings), x as (select vec_id, z, list_transform(z, lambda v: exp(v - list_max(z))) w from e), p as (select vec_id, z, list_transform(w, lambda v: v / list_sum(w)) q from x)
select vec_id, round(q[1], 6) p0, round(q[2], 6) p1, round(q[3], 6) p2, round(list_max(q), 6) most, (list_position(z, list_max(z)) - 1)::integer best from p"""

PLANS = """with c as (select c_custkey as key, c_mktsegment as symbol, (c_custkey * 37 % 100) / 100.0::double dn, (c_custkey * 53 % 100) / 100.0::double up, (c_custkey % 11) / 500.0::double sigma, (c_custkey % 13) * 50.0::double mark, ((c_custkey % 5) - 2)::double pos, c_acctbal equity from customer),
    s as (select *, case when up >= 0.5 and up >= dn then 1 when dn >= 0.5 and dn > up then -1 else 0 end::integer signal, sign(pos) ps, sigma * sqrt(48) wide from c),
    a as (select *, case when signal = 0 or ps = signal then 'hold' when ps = 0 then 'enter_' || case when signal > 0 then 'long' else 'short' end else 'reverse_' || case when signal > 0 then 'long' else 'short' end end as action,
                 case when mark > 0 and sigma > 0 and equity > 0 and mark * (1 - exp(-wide)) > 0 then equity * 0.01 / (mark * (1 - exp(-wide))) else 0 end size, case when signal > 0 then 'buy' else 'sell' end side, case when signal > 0 then 'sell' else 'buy' end back, case when signal > 0 then 1 else -1 end w from s),
    o as (select key, signal, action, 0 k, case when pos > 0 then 'sell' else 'buy' end side, 'stop_loss' intent, 'market' order_type, abs(pos) size, null::double price from a where action like 'reverse%' and mark > 0 and pos <> 0
          union all select key, signal, action, 1, side, 'entry', 'limit', size, mark from a where action <> 'hold' and mark > 0 and size > 0
          union all select key, signal, action, 2, back, 'take_profit', 'limit', size, mark * exp(w * wide) from a where action <> 'hold' and mark > 0 and size > 0
          union all select key, signal, action, 3, back, 'stop_loss', 'market', size, mark * exp(-w * wide) from a where action <> 'hold' and mark > 0 and size > 0)
select a.key, a.signal, a.action, case when o.key is not null then (row_number() over (partition by a.key order by k) - 1)::integer end place, o.side, o.intent, o.order_type, round(o.size, 6) size, round(o.price, 6) price from a left join o on o.key = a.key"""

RISK = """with l as (select distinct l_orderkey, l_linenumber, l_partkey k, l_quantity, l_discount, l_extendedprice from lineitem),
    d as (select case when k % 2 = 0 then 'buy' when k % 97 = 1 then 'hold' else 'sell' end side, ['entry', 'take_profit', 'stop_loss', 'other'][(floor((l_orderkey % 16) / 5.0) + 1)::integer] intent, case when l_orderkey % 16 < 10 then 'limit' else 'market' end ot, l_quantity - 1 size, 1000 + l_discount * 1000 price,
                 case when k % 50 <> 3 then 1000.0 end mark, (l_linenumber - 4)::double pos, abs(l_linenumber - 4) * 1000.0 + (k % 8) * 10000.0 ex, case when k % 40 <> 7 then 20000.0 else 0 end eq, (k % 30) * -50.0 pnl, k % 22 oo, k % 61 = 5 ks from l),
    e as (select *, abs(pos + case when side = 'buy' then size else -size end) * mark nn, ex - abs(pos) * mark + abs(pos + case when side = 'buy' then size else -size end) * mark tt from d),
    r as (select *, case when side not in ('buy', 'sell') then 'invalid side: ' || side when intent not in ('entry', 'take_profit', 'stop_loss') then 'invalid intent: ' || intent when size <= 0 then 'size must be > 0' when size < 1e-4 then 'size below 0.0001' when size > 100 then 'size above 100.0'
                 when not ((intent in ('entry', 'take_profit') and ot = 'limit') or (intent = 'stop_loss' and ot = 'market')) then 'intent and order type do not fit: ' || intent || '/' || ot
                 when ot = 'limit' and price <= 0 then 'limit order requires a positive price' when ot = 'limit' and mark > 0 and abs(price - mark) / mark > 0.05 then 'price deviation # above limit' when intent <> 'entry' then 'ok (exit allowed)'
                 when ks then 'kill switch active' when pnl <= -1000 then 'daily loss limit hit' when oo >= 20 then 'open orders at limit: ' || oo when mark is null then 'no mark price for BTC' when eq <= 0 then 'equity is not positive'
                 when nn > 50000 then 'position notional # above limit' when tt > 100000 then 'total notional # above limit' when tt / eq > 5 then 'leverage # above limit' else 'ok' end reason from e)
select intent, side, case when reason like 'ok%' then 'open' else 'rejected' end status, reason like 'ok%' risk_passed, reason, count(*) n from r group by all"""

LATEST_WINDOWS = f"""with {BARS}, f as (select symbol, time, ln(close / {LAG('close')}) ret_1, ln(close / open) ret_co, {full('avg', 'volume', 5)} / {full('avg', 'volume', 30)} volume_ratio_5_30 from b),
    l as (select *, coalesce(isfinite(ret_1) and isfinite(ret_co) and isfinite(volume_ratio_5_30), false) fin from f qualify row_number() over (partition by symbol order by time desc) <= 40),
    g as (select symbol, max(time) as time, count(*) = 40 and bool_and(fin) ok, max_by(ret_1, time) r from l group by symbol)
select symbol, time, case when ok then 40 else 0 end::integer n, case when ok then round(r::float::double, 5) + 0.0 end last_ret from g"""
LABELLED_EVENTS = f"with {TOY} select l.symbol, f.idx e_idx, l.time, l.t1, l.label, 1.0::double weight from lab l join f on f.symbol = l.symbol and f.time = l.time"
RISK_STATE = """with h as (select c_nationkey account, c_mktsegment as symbol, sum(c_acctbal::decimal(18,2))::double / 1000 pos from customer group by all), m as (select distinct c_mktsegment as symbol, length(c_mktsegment)::double mark from customer where c_mktsegment <> 'BUILDING'),
    e as (select account, sum(abs(pos) * mark) x from h join m using (symbol) group by 1), o as (select s_suppkey as key, s_nationkey account, ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY', 'NONE'][s_suppkey % 6 + 1] as symbol from supplier)
select o.key, o.account, o.symbol, m.mark, n_nationkey * 1000.0::double equity, n_regionkey open_orders, n_nationkey = 3 kill_switch, round(coalesce(h.pos, 0), 6) + 0.0 as position, round(coalesce(x, 0), 6) + 0.0 exposure
from o join nation on n_nationkey = o.account left join h on h.account = o.account and h.symbol = o.symbol left join m on m.symbol = o.symbol left join e on e.account = o.account"""

CUTOFFS = f"with {SPLIT} select fold, min(t0) - interval '720 minutes' cutoff from rl where role = 'test' group by fold"
FINAL_SPLIT = f"""with {TOY}, st as (select t0, row_number() over (order by t0) - 1 rn, count(*) over () n from smp), v as (select t0 vs from st where rn = n - round(n * 0.15::double)),
    ro as (select *, case when t0 >= vs then 'val' when t1 < vs - interval '720 minutes' then 'train' end as role from smp, v)
select symbol, role, count(*) n, min(t0) as first, max(t0) as last, max(t1) last_t1 from ro where role is not null group by all"""
PENDING = RISK.rsplit("\nselect", 1)[0] + " select 'BTC' as symbol, intent, ot order_type, case when reason like 'ok%' then 'pending' else 'rejected' end status, reason like 'ok%' risk_passed, count(*) n, round(sum(size::decimal(18,2)), 2)::double size from r group by all"
PREDICTIONS = LATEST_WINDOWS.rsplit(",\n    g as", 1)[0] + f""",
    g as (select symbol, max(time) as time, 1000 * avg(ret_1::float::double) z from l group by symbol having count(*) = 40 and bool_and(fin)), e as (select *, exp(-z - abs(z)) dn, exp(-abs(z)) fl, exp(z - abs(z)) u from g)
select symbol, time, 'drift' model_version, case when dn >= fl and dn >= u then -1 when fl >= u then 0 else 1 end::smallint signal, {out({'prob_down': 'dn / (dn + fl + u)', 'prob_flat': 'fl / (dn + fl + u)', 'prob_up': 'u / (dn + fl + u)'}, 4)} from e"""

ORACLES: dict[str, str] = {
    "fold_cutoffs": CUTOFFS, "final_split": FINAL_SPLIT, "pending_orders": PENDING, "latest_predictions": PREDICTIONS,
    "labels": LABELS, "latest_windows": LATEST_WINDOWS, "labelled_events": LABELLED_EVENTS, "risk_state": RISK_STATE,
    "numbered_orders": "select o_orderdate::timestamp as time, o_orderpriority as symbol, lpad(o_orderkey::varchar, 12, '0') intent, row_number() over (order by o_orderdate, o_orderpriority, lpad(o_orderkey::varchar, 12, '0')) + 1000 order_id from orders",
    "bars": f"with {BARS} select * from b", "features_returns": RETURNS, "features_volatility": VOLATILITY, "features_volume": VOLUME, "features_microstructure": MICRO, "features_bands": BANDS, "features_temporal": TEMPORAL,
    "features_recursive": RECURSIVE, "features_adx": ADX, "features_all": ALL, "filled_rates": FILLED, "features_book": BOOK, "features_funding": FUNDING, "features_cross": CROSS, "asof_join": ASOF, "cusum_events": CUSUM, "triple_barrier": BARRIERS,
    "book_levels": """with l as (select l_orderkey, list(l_extendedprice order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) px, list(l_quantity order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) sz from lineitem group by 1)
        select l_orderkey, len(px)::integer n_levels, list_sum(sz[1:5]) depth_5, list_sum(sz[1:10]) depth_10, px[5] px_5, case when isfinite(list_sum(sz[1:5]) / (px[1] - px[5])) then round(list_sum(sz[1:5]) / (px[1] - px[5]), 6) end slope from l""",
    "samples": SAMPLES, "walk_forward": FOLDS, "normaliser": NORMALISER, "normalised": NORMALISED, "class_weights": CLASS_WEIGHTS, "confusion": CONFUSION, "classification_scores": SCORES, "weighted_cross_entropy": CROSS_ENTROPY, "softmax_argmax": SOFTMAX,
    "order_plans": PLANS, "risk_gate": RISK,
    "latest_per_key": "select o_orderpriority as symbol, o_orderdate as time, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_orderpriority order by o_orderdate desc, o_orderkey desc) <= 3",
    "top_latest": "select o_orderstatus as symbol, o_orderdate as time, o_orderkey from orders where o_orderstatus = 'F' order by o_orderdate desc, o_orderkey limit 50",
    "candles": f"with {BARS} select epoch(time)::bigint as time, open, high, low, close from b where symbol = 'click' order by b.time desc limit 200",
    "monitoring": f"""with {TICKS}, s as (select symbol, max(time) last_write_at, min(time) oldest_at, count(*) filter (time > timestamp '2024-01-30 22:00:00') rows_last_1h, count(*) rows_total from t group by 1)
        select n.symbol, last_write_at, round((epoch_us(timestamp '2024-01-30 23:00:00') - epoch_us(last_write_at)) / 1e6)::bigint seconds_since_last_write, coalesce(rows_last_1h, 0) rows_last_1h, coalesce(rows_total, 0) rows_total, oldest_at,
               round((epoch_us(last_write_at) - epoch_us(oldest_at)) / 1e6)::bigint span_seconds, case when last_write_at is null or (epoch_us(timestamp '2024-01-30 23:00:00') - epoch_us(last_write_at)) / 1e6 > 420 then 'STALE' else 'OK' end state
        from (values ('click'), ('view'), ('none')) n(symbol) left join s on s.symbol = n.symbol""",
    "positions": """with s as (select o_custkey c, max_by(o_totalprice, (o_orderdate, o_orderkey)) p from orders where o_orderstatus = 'O' group by 1), e as (select o_custkey c, max(o_orderdate) d from orders where o_orderstatus <> 'O' group by 1),
        h as (select cast(c_custkey as varchar) as symbol, c_acctbal b, p, d, coalesce(greatest(floor((epoch(timestamp '2002-01-01') - epoch(d)) / 300), 0), 0)::integer n from customer left join s on s.c = c_custkey left join e on e.c = c_custkey)
        select symbol, case when b > 0 then 'long' when b < 0 then 'short' else 'flat' end side, p sl_level, d entry_time, n bars_held, round(least(n / 48.0::double, 1.0), 6) held_share from h""",
    "last_by_key": "select o_custkey, o_orderdate, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1",
    "bars_held": "select o_orderkey, greatest(floor((epoch(timestamp '1999-01-01') - epoch(o_orderdate)) / 86400), 0)::integer held from orders",
    "decode_candles": f"""with {TICKS} select case symbol when 'click' then 'BTC' else 'ETH' end as symbol, make_timestamp(epoch_us(time) // 1000 * 1000) as time, round(price, 2) open, round(price, 2) high, round(price, 2) low, round(price, 2) close, cast(size as double) volume, 1 trades
        from t where symbol in ('click', 'view') and seq % 10 <> 3 and seq % 7 <> 5""",
    "decode_numbers": "select user_id, sum(cast(json_extract_string(props, '$.k') as double)) k_sum, count(json_extract_string(props, '$.k')) k_n from events group by 1",
    "validation": """with o as (select case when o_orderkey % 9 = 0 then 'symbol' end a, case when o_orderkey % 2 <> 0 then 'side' end b, case when not ((o_orderkey % 3 = 0 and o_orderstatus = 'F') or (o_orderkey % 3 <> 0 and o_orderstatus <> 'F')) then 'asymmetry' end c from orders)
        select array_to_string(list_sort(list_filter([a, b, c], lambda x: x is not null)), ',') broken, count(*) n from o group by 1""",
    "table_stats": f"with {TICKS} select count(*) n_rows, min(time) oldest, max(time) newest from t",
}
