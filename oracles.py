"""SQL counterparts of the registered queries.

Each query is a final SELECT over named steps; ``_with`` pulls in the steps a statement
mentions. The steps restate the rules independently of the Spark plans.
"""

from __future__ import annotations

import re

_STEPS: dict[str, str] = {}

# ------------------------------------------------------------------ adapters and bars
_STEPS["bars"] = """
  select *, close as adj_close, (high + low + close) / 3.0 as vwap, close * volume as dollar_volume
  from (
    select (l_suppkey + 10)::varchar || '.AX' as symbol, l_shipdate::date as date,
           first(price order by l_orderkey, l_linenumber, price) as open, max(price) as high,
           min(price) as low, last(price order by l_orderkey, l_linenumber, price) as close,
           sum(l_quantity) as volume
    from (select *, l_extendedprice / l_quantity as price from lineitem)
    group by all)
"""
_STEPS["bars_x"] = """
  select *, case when bar_no >= 5 then stddev_samp(ret) over w63 * sqrt(252.0) end as volatility
  from (
    select *,
      row_number() over w as bar_no, count(*) over (partition by symbol) as n_bars,
      close / nullif(lag(close) over w, 0) - 1 as ret,
      avg(dollar_volume) over w63 as adv_dollars, avg(volume) over w63 as adv_shares,
      avg((high - low) / nullif(close, 0)) over (w rows between 20 preceding and current row) * 2500 as spread_proxy_bps,
      case when row_number() over w >= 5 then volume / nullif(avg(volume) over w63, 0) end as volume_shock,
      close / nullif(lag(close, 21) over w, 0) - 1 as mom_1m,
      close / nullif(lag(close, 63) over w, 0) - 1 as mom_3m,
      close / nullif(lag(close, 126) over w, 0) - 1 as mom_6m,
      close / nullif(lag(close, 252) over w, 0) - 1 as mom_12m,
      lag(close, 20) over w as close_m20, lag(close, 1) over w as close_m1,
      lead(date) over w as next_date, lead(open) over w as next_open, lead(close) over w as next_close,
      lead(vwap) over w as next_vwap, lead(close, 1) over w as close_p1, lead(close, 3) over w as close_p3,
      lead(close, 5) over w as close_p5, lead(close, 10) over w as close_p10,
      lag(close, 15) over w as close_m15, lag(close, 5) over w as close_m5, lag(close, 3) over w as close_m3,
      lag(date, 5) over w as date_m5, lag(date, 3) over w as date_m3, lag(date, 1) over w as date_m1,
      lead(date, 10) over w as date_p10
    from bars
    window w as (partition by symbol order by date),
           w63 as (partition by symbol order by date rows between 62 preceding and current row))
  window w63 as (partition by symbol order by date rows between 62 preceding and current row)
"""
_STEPS["positions"] = "select symbol, date, close, row_number() over (partition by symbol order by date) as bar_no from bars"
_STEPS["bars_y"] = """
  select *, lead(adv_dollars) over (partition by symbol order by date) as entry_adv,
         case when bar_no > 6 then lag(adv_dollars, 6) over (partition by symbol order by date)
              else first_value(dollar_volume) over (partition by symbol order by date) end as adv_before
  from bars_x
"""
_STEPS["bench"] = "select date, avg(close) as close from bars group by date"
_STEPS["ann"] = """
  select o_orderpriority as provider, 'Index ' || o_orderpriority[1] as index_name,
         case when o_custkey % 97 = 0 then 'ZZZ.AX'
              else (floor(o_custkey / 15)::bigint + 10)::varchar || '.AX' end as asx_ticker,
         'Company ' || o_custkey as company_name,
         case o_orderstatus when 'F' then 'ADD' when 'O' then 'DELETE' else 'RECONSTITUTION' end as action,
         o_orderdate::date as announcement_date,
         case when o_orderkey % 7 <> 0 then o_orderdate::date + (10 + o_orderkey % 11)::int end as effective_date,
         'order:' || o_orderkey as source_url, 0.3 + (o_orderkey % 7) / 10.0 as confidence,
         o_orderkey % 5 = 0 as needs_verification, o_orderkey
  from orders
"""
_STEPS["holdings"] = """
  select upper(h.product) as product_ticker, h.as_of_date,
         case h.l_suppkey % 6 when 0 then code || '.AX' when 1 then code || ' AU' when 2 then 'ASX:' || code
              when 3 then code || '-AU' when 4 then code || ' AU Equity' else code || ' LN' end as constituent_ticker,
         'Stock ' || h.l_suppkey as constituent_name, h.value / f.total as weight_pct, h.shares,
         h.value as market_value, h.l_suppkey, code
  from (
    select p_brand as product, last_day(date_trunc('quarter', l_shipdate)::date + interval 2 month) as as_of_date,
           l_suppkey, (l_suppkey + 10)::varchar as code, sum(l_quantity) as shares, sum(l_extendedprice) as value
    from lineitem join part on l_partkey = p_partkey group by all) h
  join (
    select p_brand as product, last_day(date_trunc('quarter', l_shipdate)::date + interval 2 month) as as_of_date,
           sum(l_extendedprice) as total
    from lineitem join part on l_partkey = p_partkey group by all) f
  on h.product = f.product and h.as_of_date = f.as_of_date
"""
_STEPS["registry_rows"] = """
  select 'etf' as record_type, upper(p_brand) as product_ticker, p_brand || ' Fund' as product_name,
         case when n % 2 = 0 then 'Issuer A' end as issuer,
         case when n % 3 = 0 then p_brand || ' Index' end as benchmark_index_name,
         ['S&P Dow Jones Indices', 'MSCI', 'MarketVector', 'Solactive'][n % 4 + 1] as index_provider,
         theme, case when n % 5 <> 0 then total * 10000.0 end as aum, parts::double as number_of_holdings,
         case n % 3 when 1 then 'manual' when 2 then 'discovery' else 'seed' end as source
  from (
    select p_brand, regexp_extract(p_brand, '(\\d+)', 1)::int as n, sum(p_retailprice) as total,
           min(p_type) as theme, count(*) as parts
    from part group by p_brand)
"""
_STEPS["registry"] = """
  select *, round(case source when 'manual' then least(1.0, base + 0.15) when 'seed' then least(base, 0.45)
                  else base end, 3) as confidence_score
  from (
    select *, 0.10::double + case when issuer is not null then 0.10::double else 0 end
              + case when benchmark_index_name is not null then 0.10::double else 0 end + 0.05::double
              + 0.05::double + case when aum is not null then 0.05::double else 0 end as base
    from registry_rows)
"""
_STEPS["caps"] = """
  select asx_ticker as symbol, announcement_date as date, max(o_totalprice) * 2000.0 as market_cap
  from ann join orders using (o_orderkey) where asx_ticker <> 'ZZZ.AX' group by all
"""
_STEPS["profiles"] = """
  select (s_suppkey + 10)::varchar || '.AX' as symbol, s_name as company_name, r_name as sector,
         n_name as industry, abs(s_acctbal) * 100000.0 as market_cap, 1.0 + s_suppkey % 50 as price
  from supplier left join nation on s_nationkey = n_nationkey left join region on n_regionkey = r_regionkey
"""
_STEPS["changes"] = """
  select distinct
    case o_orderpriority[1] when '1' then 'Large 500' when '2' then 'Growth 100' when '3' then 'Local 200' when '4' then 'Small 600'
         else 'Local 300' end as index_name,
    case when o_orderpriority[1] in ('3', '5') then 'ASX' else 'US' end as market,
    case o_orderstatus when 'F' then 'ADD' else 'DEL' end as action, asx_ticker as ticker,
    announcement_date as effective_date, 'Security ' || asx_ticker as security, 'priority ' || o_orderpriority[1] as reason
  from ann join orders using (o_orderkey)
  where o_orderstatus in ('F', 'O')
"""
_STEPS["fund_edges"] = """
  select h.product_ticker as etf, h.code || '.AX' as asx_ticker, h.constituent_name as name, h.shares,
         h.market_value, h.weight_pct * 100.0 / 100.0 * r.aum * 0.05 as inflow
  from holdings h
  join (select product_ticker, max(as_of_date) as as_of_date from holdings group by 1) m
    on h.product_ticker = m.product_ticker and h.as_of_date = m.as_of_date
  left join registry_rows r on h.product_ticker = r.product_ticker
  where h.code::int % 2 = 0 or h.code::int % 7 <> 0
"""

# ------------------------------------------------------------------ snapshots and events
_STEPS["snaps"] = """
  select product_ticker, as_of_date, row_number() over w as snap_no, lag(as_of_date) over w as prev_date,
         lead(as_of_date) over w as next_date, count(*) over (partition by product_ticker) as n_snaps
  from (select distinct product_ticker, as_of_date from holdings)
  window w as (partition by product_ticker order by as_of_date)
"""
_STEPS["pairs"] = """
  select coalesce(c.product_ticker, p.product_ticker) as product_ticker,
         coalesce(c.prev_date, p.as_of_date) as prev_date, coalesce(c.as_of_date, p.next_date) as as_of_date,
         coalesce(c.constituent_ticker, p.constituent_ticker) as constituent_ticker,
         coalesce(c.constituent_name, p.constituent_name) as constituent_name,
         c.constituent_ticker is not null as in_new, p.constituent_ticker is not null as in_old,
         p.weight_pct as old_weight, c.weight_pct as new_weight, p.shares as old_shares, c.shares as new_shares
  from (select h.*, s.prev_date from holdings h join snaps s using (product_ticker, as_of_date) where s.prev_date is not null) c
  full outer join
       (select h.*, s.next_date from holdings h join snaps s using (product_ticker, as_of_date) where s.next_date is not null) p
  on c.product_ticker = p.product_ticker and c.prev_date = p.as_of_date and c.constituent_ticker = p.constituent_ticker
"""
_STEPS["diffs"] = """
  select * from (
    select *,
      case when in_new and not in_old then 'NEW_POSITION' when in_old and not in_new then 'DELETED'
           when new_weight - old_weight > 1e-4 then 'WEIGHT_INCREASE'
           when new_weight - old_weight < -1e-4 then 'WEIGHT_DECREASE'
           when new_shares > old_shares then 'WEIGHT_INCREASE' when new_shares < old_shares then 'WEIGHT_DECREASE'
           else 'UNCHANGED' end as change_type,
      case when in_new and in_old then new_weight - old_weight when in_new then new_weight else -old_weight end as weight_delta,
      case when in_new and in_old then new_shares - old_shares when in_new then new_shares else -old_shares end as shares_delta
    from pairs)
  where change_type <> 'UNCHANGED'
"""
_STEPS["ev_hold"] = """
  select substr(sha1('holdings|' || d.product_ticker || '|' || sym || '|' || etype || '|' || d.as_of_date), 1, 12) as event_id,
         'holdings_diff' as source_type, index_provider as provider, issuer, product_name as etf_index_name,
         benchmark_index_name as benchmark, sym as asx_ticker, constituent_name as company_name, etype as event_type,
         d.as_of_date as announcement_date, d.as_of_date as detected_date, null::date as effective_date,
         old_weight, new_weight, confidence_score, null::varchar as source_url_or_file, null::varchar as notes,
         d.product_ticker, shares_delta, weight_delta, aum, theme, number_of_holdings as n_holdings
  from (
    select *, regexp_extract(constituent_ticker, '(\\d+)', 1) || '.AX' as sym,
           case change_type when 'NEW_POSITION' then 'ETF_HOLDINGS_NEW_POSITION'
                when 'WEIGHT_INCREASE' then 'ETF_HOLDINGS_WEIGHT_INCREASE'
                when 'WEIGHT_DECREASE' then 'ETF_HOLDINGS_WEIGHT_DECREASE' end as etype
    from diffs where constituent_ticker not like '% LN') d
  left join registry r on d.product_ticker = r.product_ticker
  where etype is not null
"""
_STEPS["ev_ann"] = """
  select substr(sha1('ann|' || provider || '|' || index_name || '|' || asx_ticker || '|' || etype || '|' || announcement_date), 1, 12) as event_id,
         'announcement' as source_type, provider, null::varchar as issuer, index_name as etf_index_name,
         index_name as benchmark, asx_ticker, company_name, etype as event_type, announcement_date,
         announcement_date as detected_date, effective_date, null::double as old_weight, null::double as new_weight,
         confidence::double as confidence_score, source_url as source_url_or_file,
         case when needs_verification then 'needs_verification' else '' end as notes, null::varchar as product_ticker,
         null::double as shares_delta, null::double as weight_delta, null::double as aum, null::varchar as theme,
         null::double as n_holdings
  from (select *, case action when 'ADD' then 'OFFICIAL_INDEX_ADD' when 'DELETE' then 'OFFICIAL_INDEX_DELETE'
                  else 'RECONSTITUTION' end as etype from ann)
"""
_STEPS["ev_custom"] = """
  select distinct substr(sha1('custom|' || (user_id + 10) || '.AX|CUSTOM_MANUAL_EVENT|' || day), 1, 12) as event_id,
         'custom_manual' as source_type, 'MarketVector' as provider, null::varchar as issuer,
         null::varchar as etf_index_name, null::varchar as benchmark, (user_id + 10)::varchar || '.AX' as asx_ticker,
         null::varchar as company_name, 'CUSTOM_MANUAL_EVENT' as event_type, day as announcement_date,
         day as detected_date, day + 9 as effective_date, null::double as old_weight, null::double as new_weight,
         0.8::double as confidence_score, null::varchar as source_url_or_file, 'signup' as notes,
         null::varchar as product_ticker, null::double as shares_delta, null::double as weight_delta,
         null::double as aum, null::varchar as theme, null::double as n_holdings
  from (select user_id, (ts::date - interval 300 month)::date as day from events where event_type = 'signup')
"""
# The survivor of a shared id is the smallest row, NULL first.
_STEPS["ev"] = """
  select * exclude (src, rn) from (
    select *, row_number() over (partition by event_id order by src, company_name nulls first,
             effective_date nulls first, confidence_score nulls first, source_url_or_file nulls first) as rn
    from (select 0 as src, * from ev_hold union all by name select 1 as src, * from ev_ann
          union all by name select 2 as src, * from ev_custom))
  where rn = 1
"""

# ------------------------------------------------------------------ flow, study, features
_STEPS["ev_bars"] = """
  select e.*, a.date as a_date, a.bar_no as a_no, a.n_bars as a_n, a.close as a_close, a.close_m20, a.close_m1,
         a.next_date, a.next_open, a.next_close, a.next_vwap, a.close_p3 as a_p3, a.close_p10 as a_p10,
         a.adv_dollars, a.entry_adv, a.dollar_volume, a.spread_proxy_bps, a.volatility, a.volume_shock,
         a.mom_1m, a.mom_3m, a.mom_6m, a.mom_12m,
         f.bar_no as e_no, f.n_bars as e_n, f.date as e_date, f.open as e_open, f.close as e_close,
         f.close_p1 as e_p1, f.close_p3 as e_p3, f.close_p5 as e_p5, f.close_p10 as e_p10
  from ev e
  asof left join bars_y a on e.asx_ticker = a.symbol and e.announcement_date >= a.date
  asof left join bars_y f on e.asx_ticker = f.symbol and e.effective_date >= f.date
"""
_STEPS["flow_asof"] = """
  select *, size / nullif(adv_dollars, 0) as flow_pressure,
         case when event_type in ('OFFICIAL_INDEX_DELETE', 'ETF_HOLDINGS_WEIGHT_DECREASE') then -size else size end as signed,
         case when coalesce(greatest(0, least(1, confidence_score)), 0) = 0 then 0.5 else least(1, confidence_score) end as prob_real,
         case when adv_dollars is null then 0.0 when adv_dollars <= 0 then 1.0 else 5e6 / (5e6 + adv_dollars) end as tight
  from (select *, abs(coalesce(shares_delta * a_close, weight_delta * aum)) as size from ev_bars)
"""
_STEPS["study"] = """
  select *, imm as immediate_reaction, dly as delayed_return, dly / greatest(abs(coalesce(imm, 0)), 0.005) as under,
         coalesce(next_close >= 0.02 and entry_adv >= 50000, false) as tradeable,
         case when effective_date is not null and e_no is not null then e_no < e_n or e_date = effective_date end as reached,
         abs(flow_pressure) * prob_real * tight / greatest(1.0, abs(coalesce(imm, 0)) * 100.0) as score
  from (
    select *, nullif(next_open, 0) / nullif(a_close, 0) - 1 as imm,
      case when nullif(a_close, 0) is not null then nullif(close_m1, 0) / nullif(close_m20, 0) - 1 end as w_pre,
      nullif(next_close, 0) / nullif(a_close, 0) - 1 as w_nc, nullif(a_p3, 0) / nullif(next_open, 0) - 1 as w_p3,
      nullif(e_close, 0) / nullif(next_open, 0) - 1 as w_eff,
      case when a_no is not null then nullif(e_close, 0) / nullif(e_open, 0) - 1 end as w_day,
      case when a_no is not null then nullif(e_p1, 0) / nullif(e_close, 0) - 1 end as w_e1,
      case when a_no is not null then nullif(e_p3, 0) / nullif(e_close, 0) - 1 end as w_e3,
      case when a_no is not null then nullif(e_p5, 0) / nullif(e_close, 0) - 1 end as w_e5,
      case when a_no is not null then nullif(e_p10, 0) / nullif(e_close, 0) - 1 end as w_e10,
      coalesce(nullif(e_close, 0) / nullif(next_open, 0) - 1, nullif(a_p10, 0) / nullif(next_open, 0) - 1) as dly
    from flow_asof)
"""
_STEPS["per_ticker"] = "select asx_ticker, count(distinct event_id) as n_events from ev group by 1"
_STEPS["stacks"] = """
  select d.asx_ticker, d.day, count(distinct s.src) as stack_count
  from (select distinct asx_ticker, announcement_date as day from ev) d
  join (select distinct asx_ticker, announcement_date as day, coalesce(product_ticker, event_id) as src from ev) s
    on s.asx_ticker = d.asx_ticker and s.day between d.day - 30 and d.day
  group by all
"""
_STEPS["feat"] = """
  select s.*, c.market_cap, p.sector, p.industry, t.n_events, k.stack_count,
         date_diff('day', coalesce(s.next_date, s.announcement_date), s.effective_date) as days_to_effective,
         round(case when confidence_score is null then base else least(1.0, base + 0.2::double * (1 - confidence_score)) end, 3) as obscurity
  from (select *, case when regexp_matches(upper(coalesce(provider, '')), 'S&P|MSCI|FTSE|DOW|NASDAQ|RUSSELL') then 0.15::double
                       when source_type = 'holdings_diff' then 0.75::double else 0.5::double end as base from study) s
  asof left join caps c on s.asx_ticker = c.symbol and s.announcement_date >= c.date
  left join profiles p on s.asx_ticker = p.symbol
  left join per_ticker t on s.asx_ticker = t.asx_ticker
  left join stacks k on s.asx_ticker = k.asx_ticker and s.announcement_date = k.day
"""

# ------------------------------------------------------------------ trades, ledger, metrics
_LONG = (
    "event_type in ('OFFICIAL_INDEX_ADD', 'ETF_HOLDINGS_NEW_POSITION', 'ETF_HOLDINGS_WEIGHT_INCREASE',"
    " 'RECONSTITUTION', 'REBALANCE', 'CUSTOM_MANUAL_EVENT')"
)
_RULES = {
    "DelayedAnnouncementReaction": (
        "(abs(imm) <= 0.03 or imm is null) and (flow_pressure >= 0.5 or flow_pressure is null)"
        " and (confidence_score >= 0.4 or confidence_score is null)",
        "effective", 25,
    ),
    "HighFlowLowLiquidity": (
        "flow_pressure >= 1.0 and (adv_dollars <= 2e6 or adv_dollars is null)", "eff_close_plus:3", 30,
    ),
    "HoldingsDiffSignal": (
        "source_type = 'holdings_diff' and (new_weight >= 0.001 or new_weight is null)"
        " and (abs(imm) <= 0.04 or imm is null)",
        "plus:5", 30,
    ),
    "RebalanceCalendarTrade": (
        "event_type in ('REBALANCE', 'RECONSTITUTION', 'OFFICIAL_INDEX_ADD') and confidence_score >= 0.7",
        "effective", 30,
    ),
    "MultiETFStackedFlow": ("stack_count >= 2", "eff_close_plus:5", 30),
    "ForgottenSmallCapAdd": (
        "(adv_dollars <= 1e6 or adv_dollars is null) and (market_cap <= 5e8 or market_cap is null)"
        " and (abs(imm) <= 0.02 or imm is null) and (flow_pressure >= 0.75 or flow_pressure is null)"
        " and (obscurity >= 0.5 or obscurity is null)",
        "eff_close_plus:10", 30,
    ),
}


def _trades(names) -> str:
    return " union all ".join(
        f"select '{n}' as strategy, event_id, asx_ticker, 1 as direction, 'next_open' as entry_ref, "
        f"'{_RULES[n][1]}' as exit_spec, {_RULES[n][2]} as max_hold_days, '{n}' as selection_notes "
        f"from feat where tradeable and {_LONG} and {_RULES[n][0]}"
        for n in names
    )


_ENABLED = [n for n in _RULES if n != "RebalanceCalendarTrade"]
_STEPS["trades"] = _trades(_ENABLED)


def _ledger(trades: str, events: str) -> str:
    return f"""
  select *, case when rejected then null else gross - bps / 1e4 end as net_return,
         case when rejected then null else gross - hbps / 1e4 end as harsh_net_return
  from (
    select *, reject_reason <> '' as rejected, direction * (xclose / next_open - 1) as gross,
           2 * (8.0 + 25.0 + part * 1000.0) as bps, 2 * (8.0 + 2 * (25.0 + part * 1000.0)) as hbps
    from (
      select q.*, x.close as xclose, x.date as xdate,
             case when q.entry_adv > 0 then least(100000.0 / q.entry_adv, 0.1) end as part,
             case when not listed then 'no_prices' when a_no is null then 'no_bar_at_announcement'
                  when q.next_open is null or q.next_open <= 0 then 'no_entry_bar' when x.close is null then 'no_exit_bar'
                  when q.entry_adv is null or q.entry_adv <= 0 then 'no_liquidity' else '' end as reject_reason
      from (
        select *, case when planned > a_no + 1 then planned else least(a_no + 1 + max_hold_days, a_n) end as exit_no
        from (
          select t.strategy, t.event_id, t.asx_ticker, t.direction, t.max_hold_days, e.provider, e.theme, e.market_cap,
                 e.imm, e.flow_pressure, a_no, a_n, next_date, next_open, entry_adv, e_no,
                 t.asx_ticker in (select symbol from bars) as listed,
                 case when t.exit_spec like 'plus:%' then a_no + 1 + split_part(t.exit_spec, ':', 2)::int
                      when e_no is null then a_no + 1 + t.max_hold_days
                      when t.exit_spec like 'eff_close_plus:%' then e_no + split_part(t.exit_spec, ':', 2)::int
                      else e_no end as planned
          from {trades} t join {events} e on t.event_id = e.event_id)) q
      left join bars_x x on q.asx_ticker = x.symbol and q.exit_no = x.bar_no))
"""


_STEPS["ledger"] = _ledger("trades", "feat")
_STEPS["ex"] = """
  select strategy, event_id, xdate as exit_date, net_return, gross as gross_return, harsh_net_return,
         exit_no - (a_no + 1) as exposure_days, net_return * 100000.0 as pnl_net, part as participation,
         100000.0 / entry_adv > 0.1 as capped, year(next_date)::varchar as year, theme, provider, market_cap,
         entry_adv as adv_dollars, imm, flow_pressure
  from ledger where not rejected
"""
_METRICS = """
  count(net_return) as n_trades, round(avg(net_return), 6) as avg_return, round(median(net_return), 6) as median_return,
  round(avg((net_return > 0)::int), 6) as hit_rate,
  round(avg(case when net_return > 0 then net_return end) / nullif(abs(avg(case when net_return < 0 then net_return end)), 0), 6) as payoff_ratio,
  round(min(net_return), 6) as worst_trade, round(max(net_return), 6) as best_trade,
  round(avg(exposure_days), 6) as avg_exposure_days, round(sum(exposure_days)::double, 6) as total_exposure_days,
  round(avg(gross_return), 6) as avg_gross_return, round(avg(net_return), 6) as avg_return_after_costs,
  round(avg(harsh_net_return), 6) as avg_return_after_harsh_costs, round(sum(pnl_net), 0) as total_pnl_net,
  round(median(participation), 6) as median_participation, round(avg(capped::int), 6) as pct_capped
"""
_STEPS["legs"] = """
  select strategy, substr(sha1(strategy || '|' || ticker || '|' || effective_date), 1, 12) as event_id,
         ticker as asx_ticker, direction, direction * gross as gross_return,
         direction * gross - case market when 'US' then 0.001 else 0.004 end as net_return,
         direction * gross - case market when 'US' then 0.003 else 0.01 end as harsh_net_return,
         adv_before as adv_dollars, exposure as exposure_days, effective_date as exit_date,
         year(effective_date) as year, index_name as theme, market as provider
  from (
    select z.*, case when strategy like 'S1x%' then raw - (b1.close / nullif(b0.close, 0) - 1) else raw end as gross
    from (
      select e.*, unnest([
          {'strategy': 'S1_ADD_runup_T-5', 'raw': case when action = 'ADD' then close / nullif(close_m5, 0) - 1 end, 'direction': 1, 'exposure': 5, 'd0': null},
          {'strategy': 'S1x_ADD_excess_T-5', 'raw': case when action = 'ADD' then close / nullif(close_m5, 0) - 1 end, 'direction': 1, 'exposure': 5, 'd0': date_m5},
          {'strategy': 'S1_ADD_runup_T-3', 'raw': case when action = 'ADD' then close / nullif(close_m3, 0) - 1 end, 'direction': 1, 'exposure': 3, 'd0': null},
          {'strategy': 'S1x_ADD_excess_T-3', 'raw': case when action = 'ADD' then close / nullif(close_m3, 0) - 1 end, 'direction': 1, 'exposure': 3, 'd0': date_m3},
          {'strategy': 'S1_ADD_runup_T-1', 'raw': case when action = 'ADD' then close / nullif(close_m1, 0) - 1 end, 'direction': 1, 'exposure': 1, 'd0': null},
          {'strategy': 'S1x_ADD_excess_T-1', 'raw': case when action = 'ADD' then close / nullif(close_m1, 0) - 1 end, 'direction': 1, 'exposure': 1, 'd0': date_m1},
          {'strategy': 'S2_ADD_postdrift_eff_+10', 'raw': case when action = 'ADD' then nullif(close_p10, 0) / nullif(close, 0) - 1 end, 'direction': 1, 'exposure': 10, 'd0': null},
          {'strategy': 'S3_DEL_short_eff_+10', 'raw': case when action = 'DEL' then nullif(close_p10, 0) / nullif(close, 0) - 1 end, 'direction': -1, 'exposure': 10, 'd0': null},
          {'strategy': 'S4_DEL_long_eff_+10', 'raw': case when action = 'DEL' then nullif(close_p10, 0) / nullif(close, 0) - 1 end, 'direction': 1, 'exposure': 10, 'd0': null}
        ], recursive := true)
      from (select c.*, b.date as eff_date, b.close, b.close_m1, b.close_m3, b.close_m5, b.close_p10, b.date_m1, b.date_m3,
                   b.date_m5, b.adv_before
            from changes c asof join bars_y b on c.ticker = b.symbol and c.effective_date >= b.date) e) z
    left join bench b0 on z.d0 = b0.date left join bench b1 on z.eff_date = b1.date
    where raw is not null)
  where gross is not null
"""

# ------------------------------------------------------------------ screens
_STEPS["latest"] = "select * from bars_x where bar_no = n_bars"


def _owned(edges: str) -> str:
    return f"""
  select asx_ticker, min(name) as company, count(distinct etf) as n_etfs, string_agg(distinct etf, ',' order by etf) as etfs,
         coalesce(sum(shares), 0) as etf_shares, coalesce(sum(market_value), 0) as etf_value_usd,
         coalesce(sum(inflow), 0) as inflow5_usd
  from {edges} group by 1
"""


_STEPS["owned"] = _owned("fund_edges")


def _scored(owned: str) -> str:
    ranks = ", ".join(
        f"case when {c} is not null then (rank() over (order by {c} nulls last) + (count(*) over (partition by {c}) - 1) / 2.0)"
        f" / count({c}) over () end as r{i}"
        for i, c in enumerate(
            ("etf_pct_float", "days_to_exit_20pct_adv", "inflow5_buy_days", "n_etfs")
        )
    )
    total = " + ".join(f"coalesce(r{i}, 0)" for i in range(4))
    known = " + ".join(f"(r{i} is not null)::int" for i in range(4))
    return f"""
  select *, ({total}) / nullif({known}, 0) as forced_flow_score from (
    select *, {ranks} from (
      select o.*, b.close as last_close_aud, b.adv_shares as adv_shares_63d, b.adv_dollars as adv_dollars_63d,
             nullif(p.market_cap, 0) / nullif(p.price, 0) as shares_outstanding,
             etf_shares / nullif(nullif(p.market_cap, 0) / nullif(p.price, 0), 0) as etf_pct_float,
             etf_shares / nullif(0.2 * b.adv_shares, 0) as days_to_exit_20pct_adv,
             inflow5_usd / nullif(b.adv_dollars, 0) as inflow5_buy_days
      from {owned} o left join latest b on o.asx_ticker = b.symbol left join profiles p on o.asx_ticker = p.symbol))
"""


_STEPS["scored"] = _scored("owned")
# As delivered there are cash lines, and every 25th stock is a listed fund; neither is a stock.
_STEPS["vendor_edges"] = """
  select etf, asx_ticker, name, shares, market_value, inflow from fund_edges
  union all select etf, 'USD.AX', 'Cash', sum(market_value) / 100, sum(market_value) / 100, 0.0 from fund_edges group by etf
"""
_STEPS["stock_edges"] = """
  select * from vendor_edges
  where split_part(asx_ticker, '.', 1) not in ('AUD', 'USD', 'NZD', 'CASH')
    and asx_ticker not in (select (s_suppkey + 10)::varchar || '.AX' from supplier where s_suppkey % 25 = 0)
    and asx_ticker not in (select product_ticker from registry_rows)
"""
_STEPS["stock_owned"] = _owned("stock_edges").replace(
    "string_agg(distinct etf, ',' order by etf)", "array_to_string(list_sort(list(distinct etf))[1:12], ',')"
)
_STEPS["stock_scored"] = _scored("stock_owned")

# ------------------------------------------------------------------ bootstrap
_M = 2147483647


def _stream(unit: str, replicate: str) -> str:
    h0 = f"(({unit} + {replicate} * 1566083941 + {7 * 7919}) % {_M})"
    h1 = f"(({h0} * 48271) % {_M})"
    return h1


# k rows of one value draw one Poisson(k) weight a replicate: cumulative probabilities for each k.
_STEPS["boot_values"] = """
  select strategy, floor(net_return * 1e9 + 0.5)::bigint as unit, count(*) as k, avg(net_return) as v,
         sum(count(*)) over (partition by strategy) as n
  from ex where net_return is not null group by 1, 2
"""
_STEPS["boot_steps"] = """
  select k, list(c order by w) as steps from (
    select k, w, sum(exp(w * ln(k) - k - lgamma(w + 1))) over (partition by k order by w) as c
    from (select k, unnest(range(ceil(k + 12 * sqrt(k) + 12)::bigint)) as w from (select distinct k from boot_values where k <= 256)))
  group by k
"""
_STEPS["boot_draws"] = f"""
  select *, (xor(h2, h2 >> 13) * 16807) % {_M} as h3, (xor(g2, g2 >> 13) * 16807) % {_M} as g3 from (
    select *, (xor(h1, h1 >> 16) * 69621) % {_M} as h2, (xor(g1, g1 >> 16) * 69621) % {_M} as g2 from (
      select strategy, v, k, r.b as b, {_stream("u0", "r.b")} as h1, {_stream("(u0 + 7919)", "r.b")} as g1
      from (select *, (unit % {_M} + {_M}) % {_M} as u0 from boot_values where n >= 3), range(2000) r(b)))
"""
_STEPS["boot_means"] = f"""
  select strategy, b, sum(w * v) / nullif(sum(w), 0) as m from (
    select strategy, b, v,
           case when d.k <= 256 then len(list_filter(steps, lambda c: c <= h3 / {_M}.0::double))::double
                else greatest(0, floor(d.k + sqrt(d.k) * sqrt(-2 * ln((h3 + 1) / {_M + 1}.0::double)) * cos(2 * pi() * g3 / {_M}.0::double) + 0.5)) end as w
    from boot_draws d left join boot_steps s on d.k = s.k)
  group by all
"""
_STEPS["ci"] = """
  select strategy, quantile_cont(m, 0.025) as ci_low, quantile_cont(m, 0.975) as ci_high from boot_means group by 1
"""


def _plain_round(sql: str) -> str:
    """Write ``round(x, d)`` as floor arithmetic: both engines then break ties alike."""
    out, i = [], 0
    for m in re.finditer(r"(?<![\w.])round\(", sql):
        if m.start() < i:
            continue
        depth, j, comma = 1, m.end(), 0
        while depth:
            ch = sql[j]
            depth += (ch == "(") - (ch == ")")
            if ch == "," and depth == 1:
                comma = j
            j += 1
        inner, digits = _plain_round(sql[m.end():comma]), int(sql[comma + 1:j - 1])
        out.append(sql[i:m.start()] + f"(floor(({inner})::double * 1e{digits} + 0.50001) / 1e{digits})")
        i = j
    return "".join(out) + sql[i:]


def _with(sql: str) -> str:
    """Prefix the steps a statement mentions, in dependency order."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in _STEPS:
            if name not in order and re.search(rf"\b(?:from|join)\s+\(?\s*{name}\b|,\s*{name}\s+[a-z]\b", text):
                need(_STEPS[name])
                if name not in order:
                    order.append(name)

    need(sql)
    if not order:
        return sql
    return "with " + ",\n".join(f"{n} as ({_STEPS[n]})" for n in order) + "\n" + sql


_Q: dict[str, str] = {}
_Q["ohlcv_bars"] = """
  select symbol, date, round(open, 6) as open, round(high, 6) as high, round(low, 6) as low, round(close, 6) as close,
         round(adj_close, 6) as adj_close, volume, round(vwap, 6) as vwap, round(dollar_volume, 3) as dollar_volume from bars
"""
_Q["adv_trailing"] = """
  select symbol, date, bar_no, n_bars, round(adv_dollars, 3) as adv_dollars, round(adv_shares, 6) as adv_shares from bars_x
"""
_Q["spread_vol_momentum"] = """
  select symbol, date, round(spread_proxy_bps, 5) as spread_proxy_bps, round(volatility, 5) as volatility,
         round(volume_shock, 5) as volume_shock, round(mom_1m, 5) as mom_1m, round(mom_3m, 5) as mom_3m,
         round(mom_6m, 5) as mom_6m, round(mom_12m, 5) as mom_12m from bars_x
"""
_Q["latest_bars"] = "select symbol, date, round(close, 6) as close, round(adv_dollars, 3) as adv_dollars, n_bars from latest"
_Q["tradeable_bars"] = """
  select symbol, date, close >= 0.02 and adv_dollars >= 50000 as tradeable,
         round(5e6 / (5e6 + adv_dollars), 6) as tightness from bars_x
"""
for _name, _op in (
    ("asof_backward", ">="), ("asof_backward_strict", ">"), ("asof_forward", "<="), ("asof_forward_strict", "<"),
    ("asof_slotted", ">="),
):
    _Q[_name] = f"""
  select source_url, asx_ticker as symbol, announcement_date, b.date as bar_date, round(b.close, 6) as bar_close
  from ann asof left join bars b on ann.asx_ticker = b.symbol and ann.announcement_date {_op} b.date
"""
# Without as-of joins: bars and days in one ordered list, and a running maximum of the bar numbers.
_STEPS["shift_days"] = """
  select symbol, day, kind, max(no) over (partition by symbol order by day, kind rows between unbounded preceding and current row) as seen
  from (
    select symbol, date as day, bar_no as no, 1 as kind from positions
    union all select distinct asx_ticker, announcement_date, null::bigint, 0 from ann)
"""
_Q["shift_bars"] = """
  select source_url, asx_ticker as symbol, n.date as shifted_date, round(n.close, 6) as shifted_close
  from ann left join (select symbol as s, day, coalesce(seen, 0) + 6 as no from shift_days where kind = 0) w on s = asx_ticker and day = announcement_date
  left join positions n on n.symbol = s and n.bar_no = no
"""
_Q["return_between"] = """
  select source_url, asx_ticker as symbol, round(b.close / nullif(a.close, 0) - 1, 6) as ret
  from ann asof left join bars a on ann.asx_ticker = a.symbol and ann.announcement_date <= a.date
  asof left join bars b on ann.asx_ticker = b.symbol and ann.effective_date >= b.date
"""
_Q["market_excess_return"] = """
  select source_url, round(m1.close / nullif(m0.close, 0) - 1, 6) as bench_return,
         round(s1.close / nullif(s0.close, 0) - 1 - (m1.close / nullif(m0.close, 0) - 1), 6) as excess_return
  from ann asof left join bench m0 on ann.announcement_date >= m0.date
  asof left join bench m1 on ann.effective_date >= m1.date
  asof left join bars s0 on ann.asx_ticker = s0.symbol and ann.announcement_date >= s0.date
  asof left join bars s1 on ann.asx_ticker = s1.symbol and ann.effective_date >= s1.date
"""
_Q["market_cap_asof"] = """
  select source_url, asx_ticker, round(coalesce(c.market_cap, p.market_cap), 2) as market_cap, sector, industry
  from ann asof left join caps c on ann.asx_ticker = c.symbol and ann.announcement_date >= c.date
  left join profiles p on ann.asx_ticker = p.symbol
"""
_Q["snapshot_collapse"] = """
  select product_ticker, as_of_date, constituent_ticker as constituent_key, constituent_name,
         round(weight_pct, 8) as weight_pct, shares from holdings
"""
_Q["snapshot_dates"] = "select product_ticker, as_of_date, snap_no, prev_date, n_snaps from snaps"
_Q["snapshot_diff"] = """
  select product_ticker, prev_date, as_of_date, constituent_ticker, constituent_name, change_type,
         round(old_weight, 8) as old_weight, round(new_weight, 8) as new_weight, round(weight_delta, 8) as weight_delta,
         old_shares, new_shares, shares_delta from diffs
"""
_KEYS = "event_id, source_type, provider, etf_index_name, asx_ticker, event_type, announcement_date, effective_date"
_Q["holdings_events"] = f"""
  select {_KEYS}, shares_delta, round(weight_delta, 8) as weight_delta, round(aum, 2) as aum, theme, confidence_score from ev_hold
"""
_Q["announcement_events"] = f"""
  select {_KEYS}, round(confidence_score, 6) as confidence_score, notes, source_url_or_file from ev_ann
"""
_Q["custom_events"] = f"select {_KEYS}, confidence_score from ev_custom"
_Q["build_events"] = f"""
  select {_KEYS}, company_name, round(confidence_score, 6) as confidence_score, shares_delta from ev
"""
_Q["override_patch"] = """
  select e.event_id, coalesce(o.eff, e.effective_date) as effective_date,
         round(coalesce(o.conf, e.confidence_score), 6) as confidence_score, coalesce(o.note, e.notes) as notes
  from (select * from (select *, row_number() over (partition by event_id order by company_name nulls first,
             effective_date nulls first, confidence_score, source_url_or_file) as rn from ev_ann) where rn = 1) e
  left join (
    select event_id, max(case when k % 100 = 0 then date '1999-12-31' end) as eff,
           arg_max(0.5 + (k % 4) / 10.0, k) as conf, max(case when k % 200 = 50 then 'confirmed' end) as note
    from (select event_id, split_part(source_url_or_file, ':', 2)::bigint as k from ev_ann) where k % 50 = 0 and (k >= 50 )
    group by 1) o on e.event_id = o.event_id
"""
_Q["event_counts"] = "select source_type, event_type, count(*) as n_events from ev group by all"
_Q["events_per_ticker_top"] = """
  select asx_ticker, count(distinct event_id) as n_events from ev group by 1 order by n_events desc, asx_ticker limit 15
"""
_Q["accumulation"] = """
  select a.*, round(b.adv_shares, 6) as adv_shares_63d, round(net_shares / nullif(b.adv_shares, 0), 6) as buy_days_of_volume
  from (
    select regexp_extract(constituent_ticker, '(\\d+)', 1) || '.AX' as asx_ticker, sum(shares_delta) as net_shares,
           count(distinct d.product_ticker) as n_etfs_trading,
           string_agg(distinct d.product_ticker, ',' order by d.product_ticker) as etfs, max(d.as_of_date) as window_to
    from diffs d join snaps s on d.product_ticker = s.product_ticker and d.as_of_date = s.as_of_date and s.snap_no = s.n_snaps
    where constituent_ticker not like '% LN' and shares_delta is not null group by 1) a
  left join latest b on a.asx_ticker = b.symbol
"""
_Q["stack_counts"] = """
  select event_id, e.asx_ticker, stack_count
  from ev e left join stacks s on e.asx_ticker = s.asx_ticker and e.announcement_date = s.day
"""
_Q["flow_pressure"] = """
  select event_id, round(signed, 3) as estimated_buy_sell_dollars, round(adv_dollars, 3) as adv_dollars,
         round(flow_pressure, 6) as flow_pressure, round(prob_real, 6) as prob_real, round(tight, 6) as liquidity_tightness,
         round(greatest(0, least(1, 1 - date_diff('day', detected_date, date '2000-06-30') / 7.0)), 6) as expected_remaining_flow,
         size is not null as flow_estimable
  from flow_asof
"""
_Q["event_study"] = """
  select event_id, next_date as entry_date, round(w_pre, 5) as "es_pre_ann_m20_m1", round(imm, 5) as es_ann_close_to_next_open,
         round(w_nc, 5) as es_ann_close_to_next_close, round(w_p3, 5) as es_next_open_to_plus3,
         round(w_eff, 5) as es_next_open_to_effective, round(w_day, 5) as es_effective_open_to_close,
         round(w_e1, 5) as es_eff_close_plus1, round(w_e3, 5) as es_eff_close_plus3, round(w_e5, 5) as es_eff_close_plus5,
         round(w_e10, 5) as es_eff_close_plus10, round(imm, 5) as immediate_reaction, round(dly, 5) as delayed_return,
         round(under, 5) as underreaction_score, tradeable as tradeable_flag, reached as eff_is_reached
  from study
"""
_Q["opportunity_score"] = "select event_id, asx_ticker, round(score, 6) as score from study where score is not null"
_Q["features"] = """
  select event_id, round(market_cap, 2) as market_cap, round(adv_dollars, 3) as adv_dollars,
         round(dollar_volume, 3) as dollar_volume, round(spread_proxy_bps, 5) as spread_proxy_bps,
         round(volatility, 5) as volatility, round(mom_1m, 5) as mom_1m, round(mom_3m, 5) as mom_3m,
         round(mom_6m, 5) as mom_6m, round(mom_12m, 5) as mom_12m, round(mom_1m, 5) as recent_runup_1m,
         round(volume_shock, 5) as volume_shock, sector, industry, theme, round(aum, 2) as fund_aum,
         round(n_holdings, 5) as number_of_holdings, round(signed, 3) as expected_buy_dollars,
         round(flow_pressure, 5) as flow_pressure, n_events as n_products_holding, n_events as peer_inclusion_count,
         round(imm, 5) as immediate_reaction, days_to_effective, obscurity as source_obscurity_score
  from feat
"""
_Q["labels"] = """
  select event_id, case when imm is not null then (abs(imm) <= 0.03)::int end as label_underreaction,
         case when dly is not null then (dly > 0.0066)::int end as label_delayed_positive,
         round(dly, 5) as label_delayed_return,
         case when dly is not null then (tradeable and dly > 0.0066)::int end as label_tradeable_winner
  from study
"""
_Q["study_summary"] = """
  select measure, round(avg(v), 5) as mean, round(median(v), 5) as median, sum((v > 0)::int)::bigint as n_positive, count(*) as n
  from (
    select unnest([{'measure': 'es_pre_ann_-20_-1', 'v': w_pre}, {'measure': 'es_ann_close_to_next_open', 'v': imm},
      {'measure': 'es_ann_close_to_next_close', 'v': w_nc}, {'measure': 'es_next_open_to_plus3', 'v': w_p3},
      {'measure': 'es_next_open_to_effective', 'v': w_eff}, {'measure': 'es_effective_open_to_close', 'v': w_day},
      {'measure': 'es_eff_close_plus1', 'v': w_e1}, {'measure': 'es_eff_close_plus3', 'v': w_e3},
      {'measure': 'es_eff_close_plus5', 'v': w_e5}, {'measure': 'es_eff_close_plus10', 'v': w_e10}], recursive := true)
    from study)
  where v is not null group by 1
"""
for _n in _RULES:
    _Q[f"trades_{_n}"] = _trades([_n])
_Q["trades_all"] = _trades(_RULES)


def _ledger_out(source: str, extra: str) -> str:
    def done(c: str) -> str:
        return f"case when not rejected then {c} end"

    return f"""
  select strategy, event_id, asx_ticker, direction, {done('next_date')} as entry_date,
         {done('round(next_open, 5)')} as entry_price, {done('xdate')} as exit_date, {done('round(xclose, 5)')} as exit_price,
         {done('round(gross, 6)')} as gross_return, {done('round(entry_adv, 3)')} as adv_dollars,
         {done('round(part, 6)')} as participation, {done('100000.0 / entry_adv > 0.1')} as capped,
         {done('round(part * entry_adv, 2)')} as executable_value, {done('round(bps, 4)')} as cost_bps_roundtrip,
         round(net_return, 6) as net_return, round(harsh_net_return, 6) as harsh_net_return,
         {done('exit_no - (a_no + 1)')} as exposure_days, 100000.0::double as capital, round(net_return * 100000.0, 2) as pnl_net,
         rejected, reject_reason, {done('year(next_date)')} as year, provider{extra}
  from {source}
"""


_Q["backtest_ledger"] = _ledger_out("ledger", ", theme, round(market_cap, 2) as market_cap")
_Q["cost_model"] = """
  select symbol, date, round(part, 6) as participation, round(2 * (8 + 25 + part * 1000), 4) as base_bps,
         round(2 * (8 + 2 * (25 + part * 1000)), 4) as harsh_bps, 100000.0 / adv_dollars > 0.1 as capped
  from (select *, least(100000.0 / adv_dollars, 0.1) as part from bars_x)
"""


def _falls(rows: str, keys: str, row_id: str) -> str:
    """Worst fall of the compounded curve from its peak, per group."""
    order = f"partition by {keys} order by exit_date, {row_id} rows unbounded preceding"
    return f"""
  select {keys}, round(case when min(net_return) <= -1 then -1.0 else exp(min(level - peak)) - 1 end, 5) as max_drawdown from (
    select *, max(level) over ({order}) as peak from (
      select {keys}, exit_date, {row_id}, net_return,
             sum(case when net_return > -1 then ln(1 + net_return) else 0 end) over ({order}) as level
      from {rows} where net_return is not null))
  group by {keys}
"""


_Q["metrics_by_strategy"] = f"""
  select m.*, max_drawdown from (select strategy, {_METRICS} from ex group by 1) m
  left join ({_falls("ex", "strategy", "event_id")}) f on m.strategy = f.strategy
"""
_Q["max_drawdown"] = _falls("ex", "strategy", "event_id")
_Q["bootstrap_ci"] = "select strategy, round(ci_low, 6) as ci_low, round(ci_high, 6) as ci_high from ci"
_BUCKETED = """
  select unnest([
      {'dimension': 'year', 'bucket': year}, {'dimension': 'theme', 'bucket': theme}, {'dimension': 'provider', 'bucket': provider},
      {'dimension': 'strategy', 'bucket': strategy},
      {'dimension': 'market_cap_bucket', 'bucket': case when market_cap > -1 and market_cap <= 1e8 then '<100m' when market_cap <= 5e8 then '100-500m' when market_cap <= 2e9 then '500m-2b' when market_cap <= 1e11 then '>2b' end},
      {'dimension': 'liquidity_bucket', 'bucket': case when adv_dollars > -1 and adv_dollars <= 2.5e5 then '<250k' when adv_dollars <= 1e6 then '250k-1m' when adv_dollars <= 5e6 then '1-5m' when adv_dollars <= 1e12 then '>5m' end},
      {'dimension': 'immediate_reaction_bucket', 'bucket': case when abs(imm) <= 0.005 then '<0.5%' when abs(imm) <= 0.02 then '0.5-2%' when abs(imm) <= 0.05 then '2-5%' when abs(imm) <= 1 then '>5%' end},
      {'dimension': 'flow_pressure_bucket', 'bucket': case when flow_pressure <= 0.5 then '<0.5x' when flow_pressure <= 1 then '0.5-1x' when flow_pressure <= 3 then '1-3x' when flow_pressure <= 1e9 then '>3x' end}
    ], recursive := true), net_return, gross_return, harsh_net_return, exposure_days, pnl_net, participation, capped,
    exit_date, event_id || ':' || strategy as trade_id
  from ex
"""
_STEPS["bucketed"] = f"select * from ({_BUCKETED}) where bucket is not null"
_Q["breakdown_buckets"] = f"""
  select m.*, max_drawdown from (select dimension, bucket, {_METRICS} from bucketed group by all) m
  left join ({_falls("bucketed", "dimension, bucket", "trade_id")}) f on m.dimension = f.dimension and m.bucket = f.bucket
"""


def _gate(source: str) -> str:
    return f"""
  select *, survives_costs and survives_harsh_costs and enough_events and multi_event and no_single_trade_dominates
            and liquidity_ok and coalesce(oos_positive, true) as passed from (
    select strategy, avg(net_return) > 0 as survives_costs, avg(harsh_net_return) > 0 as survives_harsh_costs,
           count(net_return) >= 5 as enough_events, count(distinct event_id) >= 2 as multi_event,
           coalesce(sum(case when pnl_net > 0 then pnl_net else 0 end) <= 0
             or max(pnl_net) / nullif(sum(case when pnl_net > 0 then pnl_net else 0 end), 0) <= 0.5, false) as no_single_trade_dominates,
           avg(coalesce(capped, false)::int) < 0.5 as liquidity_ok,
           case when max(floor(n * 0.7)) >= 2 and max(n - floor(n * 0.7)) >= 2
                then avg(case when pos >= floor(n * 0.7) then net_return end) > 0 end as oos_positive
    from (select *, row_number() over (partition by strategy order by exit_date, event_id) - 1 as pos,
                 count(*) over (partition by strategy) as n from {source})
    group by 1)
"""


_Q["claims_gate"] = f"""
  select g.* exclude (passed), round(ci_low, 6) as ci_low, round(ci_high, 6) as ci_high,
         coalesce(ci_low > 0, false) as bootstrap_ci_positive, passed and coalesce(ci_low > 0, false) as claim_alpha
  from ({_gate('ex')}) g left join ci c on g.strategy = c.strategy
"""
for _by in ("provider", "theme"):
    _Q[f"{_by}_inefficiency"] = f"""
  select {_by}, count(distinct event_id) as n_events, round(avg(imm), 6) as avg_immediate_reaction,
         round(avg(dly), 6) as avg_delayed_return, round(median(dly), 6) as median_delayed_return,
         round(avg(under), 6) as avg_underreaction_score, round(avg(score), 6) as avg_opportunity_score
  from study where {_by} is not null group by 1
"""
_STEPS["leg_rows"] = """
  select * replace (event_id || ':' || theme as event_id), net_return * 100000.0 as pnl_net, false as capped from legs
"""
_STEPS["leg_ex"] = "select * from leg_rows"
for _step in ("boot_values", "boot_steps", "boot_draws", "boot_means", "ci"):
    _STEPS[f"leg_{_step}"] = re.sub(r"\b(from|join) (ex|boot_values|boot_steps|boot_draws|boot_means)\b", r"\1 leg_\2", _STEPS[_step])
_Q["strategy_summary"] = f"""
  select s.*, round_even(c.ci_low * 100, 3) as ci95_net_low_pct, round_even(c.ci_high * 100, 3) as ci95_net_high_pct,
         g.passed and coalesce(c.ci_low > 0, false) as claim_alpha from (
    select strategy, count(net_return) as n, round_even(avg(gross_return) * 100, 3) as avg_gross_pct,
           round_even(avg(net_return) * 100, 3) as avg_net_pct, round_even(avg(harsh_net_return) * 100, 3) as avg_harsh_pct,
           round_even(median(net_return) * 100, 3) as median_net_pct, round_even(avg((net_return > 0)::int), 3) as hit_rate,
           round_even(case when count(*) > 2 then avg(net_return) / nullif(stddev_samp(net_return) / sqrt(count(*)), 0) end, 2) as t_stat
    from leg_rows group by 1) s
  join ({_gate('leg_rows')}) g on s.strategy = g.strategy
  left join leg_ci c on s.strategy = c.strategy
"""
_Q["run_up_breakdowns"] = """
  select dimension, bucket, count(*) as n, round_even(avg(net_return) * 100, 3) as avg_net_pct,
         round_even(avg((net_return > 0)::int), 3) as hit
  from (
    select net_return, unnest([{'dimension': 'index', 'bucket': theme}, {'dimension': 'year', 'bucket': year::varchar},
      {'dimension': 'liquidity', 'bucket': case when m > 0 and m <= 5 then '<$5m' when m <= 20 then '$5-20m' when m <= 50 then '$20-50m' when m <= 150 then '$50-150m' when m <= 1e9 then '>$150m' end}], recursive := true)
    from (select *, adv_dollars / 1e6 as m from legs) where strategy = 'S1_ADD_runup_T-5')
  where bucket is not null group by all
"""
_Q["membership_backtest"] = """
  select strategy, event_id, asx_ticker, direction, round(gross_return, 6) as gross_return, round(net_return, 6) as net_return,
         round(harsh_net_return, 6) as harsh_net_return, round(adv_dollars, 3) as adv_dollars, exposure_days::bigint as exposure_days,
         exit_date, year, theme, provider from legs
"""
_STEPS["caar_rows"] = """
  select e.action, e.k, e.id, y.close / nullif(lag_close, 0) - 1 as sret, m.close as bench
  from (select c.*, b.bar_no, b.n_bars, row_number() over () as id, unnest(range(-20, 21)) as k
        from changes c asof join bars_x b on c.ticker = b.symbol and c.effective_date >= b.date) e
  join (select *, close_m1 as lag_close from bars_x) y on y.symbol = e.ticker and y.bar_no = e.bar_no + e.k
  left join bench m on y.date = m.date
  where e.bar_no > 21 and e.bar_no + 20 <= e.n_bars
"""
_Q["caar_path"] = """
  select action, k::int as day_rel_effective,
         round(sum(mean_ab) over (partition by action order by k rows unbounded preceding) * 100, 4) as caar_pct, n_events
  from (
    select action, k, avg(sret - coalesce(bret, 0)) as mean_ab, count(sret) as n_events
    from (select *, f / nullif(lag(f) over (partition by id order by k), 0) - 1 as bret
          from (select *, last_value(bench ignore nulls) over (partition by id order by k rows unbounded preceding) as f from caar_rows))
    group by all)
"""
_Q["review_windows"] = """
  select ticker, index_name, action, effective_date, round(close_m5 / nullif(close_m15, 0) - 1, 5) as pre_announcement,
         round(close / nullif(close_m5, 0) - 1, 5) as front_run,
         round(close / nullif(close_m5, 0) - 1 - coalesce(m0.close_b / nullif(m5.close_b, 0) - 1, 0), 5) as abnormal_front_run,
         round(close_p5 / nullif(close, 0) - 1, 5) as after_5, round(close_p10 / nullif(close, 0) - 1, 5) as after_10,
         round(close_p10 / nullif(close, 0) - 1 - coalesce(p10.close_b / nullif(m0.close_b, 0) - 1, 0), 5) as abnormal_after_10
  from (select c.*, b.* from changes c asof join bars_x b on c.ticker = b.symbol and c.effective_date >= b.date
        where b.bar_no >= 17 and b.bar_no + 10 <= b.n_bars) e
  left join (select date as d, close as close_b from bench) m5 on e.date_m5 = m5.d
  left join (select date as d, close as close_b from bench) m0 on e.date = m0.d
  left join (select date as d, close as close_b from bench) p10 on e.date_p10 = p10.d
"""
_STEPS["incl"] = """
  select distinct substr(sha1('membership|' || index_name || '|' || ticker || '|' || effective_date), 1, 12) as event_id,
         index_name as provider, ticker as asx_ticker, effective_date,
         f + ((4 - (isodow(f) - 1) + 7) % 7)::int as announcement_date
  from (select *, date_trunc('month', effective_date)::date as f from changes where action = 'ADD')
"""
_STEPS["incl_days"] = """
  select symbol, day, kind, max(no) over (partition by symbol order by day, kind desc rows between unbounded preceding and current row) as seen
  from (
    select symbol, date as day, bar_no as no, 1 as kind from positions
    union all select asx_ticker, announcement_date, null::bigint, 0 from incl
    union select asx_ticker, effective_date, null::bigint, 0 from incl)
"""
_STEPS["incl_seen"] = "select symbol, day, seen from incl_days where kind = 0"
_STEPS["incl_x"] = """
  select e.*, a.bar_no as a_no, a.n_bars as a_n, a.next_date, a.next_open, a.entry_adv, f.seen as e_no,
         null::varchar as theme, null::double as market_cap, null::double as imm, null::double as flow_pressure
  from incl e left join incl_seen s on e.asx_ticker = s.symbol and e.announcement_date = s.day
  left join bars_y a on a.symbol = s.symbol and a.bar_no = s.seen
  left join incl_seen f on e.asx_ticker = f.symbol and e.effective_date = f.day
"""
_STEPS["incl_trades"] = """
  select 'IndexInclusionDrift' as strategy, event_id, asx_ticker, 1 as direction, 'effective' as exit_spec, 30 as max_hold_days from incl
"""
_STEPS["incl_ledger"] = _ledger("incl_trades", "incl_x")
_Q["inclusion_study"] = _ledger_out("incl_ledger", "")
_Q["ownership_map"] = """
  select asx_ticker, company, n_etfs, etfs, etf_shares, round(etf_value_usd, 2) as etf_value_usd,
         round(last_close_aud, 5) as last_close_aud, round(adv_shares_63d, 5) as adv_shares_63d,
         round(adv_dollars_63d, 3) as adv_dollars_63d, round(shares_outstanding, 2) as shares_outstanding,
         round(etf_pct_float, 9) as etf_pct_of_shares_out,
         round(etf_shares / nullif(adv_shares_63d, 0), 5) as days_to_exit_at_100pct_adv,
         round(days_to_exit_20pct_adv, 5) as days_to_exit_at_20pct_adv
  from scored
"""
for _name, _source in (("forced_flow_score", "scored"), ("universal_map", "stock_scored")):
    _Q[_name] = f"""
  select asx_ticker, n_etfs, etfs, etf_shares, round(etf_value_usd, 2) as etf_value_usd, round(inflow5_usd, 2) as inflow5_usd,
         round(last_close_aud, 5) as last_close_aud, round(adv_shares_63d, 5) as adv_shares_63d,
         round(adv_dollars_63d, 3) as adv_dollars_63d, round(shares_outstanding, 2) as shares_outstanding,
         round(etf_pct_float, 9) as etf_pct_float, round(days_to_exit_20pct_adv, 5) as days_to_exit_20pct_adv,
         round(inflow5_buy_days, 5) as inflow5_buy_days, round(forced_flow_score, 6) as forced_flow_score
  from {_source}
"""
_Q["fund_universe"] = """
  select r.product_ticker as etf, product_name as etf_name, round_even(aum / 1e6, 1) as aum_musd,
         coalesce(n_asx, 0) as n_asx, coalesce(n_thin, 0) as n_thin_asx
  from registry_rows r left join (
    select etf, count(*) as n_asx, count(distinct case when adv_dollars < 2e6 then asx_ticker end) as n_thin
    from fund_edges e left join latest b on e.asx_ticker = b.symbol group by 1) c on r.product_ticker = c.etf
"""
_Q["deletion_rebounds"] = """
  select ticker, index_name, security as removed_security, reason, effective_date, n - no as bars_since_effective, greatest(0, 10 - (n - no)) as days_left_in_window,
         round_even((l.close / nullif(eclose, 0) - 1) * 100, 2) as ret_since_effective_pct, n - no <= 10 as live
  from (select c.*, b.close as eclose, b.no, b.n from changes c asof join (
          select *, row_number() over (partition by symbol order by date) as no, count(*) over (partition by symbol) as n
          from bars where date <= date '2000-06-30') b on c.ticker = b.symbol and c.effective_date >= b.date
        where c.action = 'DEL' and c.effective_date between date '2000-05-26' and date '2000-06-30') e
  join (select symbol, arg_max(close, date) as close from bars where date <= date '2000-06-30' group by 1) l on e.ticker = l.symbol
"""
_Q["not_rallied"] = """
  select asx_ticker, n_etfs, round_even(etf_pct_float * 100, 1) as etf_pct_float_pct,
         round_even(days_to_exit_20pct_adv, 0) as days_to_exit_20pct_adv, round_even(adv_dollars_63d / 1e6, 2) as adv_musd,
         mom_1m_pct, mom_3m_pct, round_even(forced_flow_score, 3) as forced_flow_score, mom_1m_pct <= 3.0 as not_rallied
  from (
    select s.*, round_even(b.mom_1m * 100, 1) as mom_1m_pct, round_even(b.mom_3m * 100, 1) as mom_3m_pct
    from (select * from scored order by forced_flow_score desc nulls last, asx_ticker limit 60) s
    join latest b on s.asx_ticker = b.symbol where b.n_bars >= 70)
  order by mom_1m_pct <= 3.0 desc, round_even(forced_flow_score, 3) desc, asx_ticker limit 25
"""
_Q["size_rule_candidates"] = """
  select w.asx_ticker, company_name as company, round_even(market_cap / 1e6, 0) as mcap_aud_m, h.asx_ticker is not null as already_held,
         market_cap * 0.66 between 30e6 and 3e9 as fits_size_rule,
         h.asx_ticker is null and market_cap * 0.66 between 30e6 and 3e9 as candidate
  from (select distinct asx_ticker from ann) w join profiles p on w.asx_ticker = p.symbol and p.market_cap <> 0
  left join (select distinct asx_ticker from fund_edges where etf in ('BRAND#1', 'BRAND#2', 'BRAND#3')) h on w.asx_ticker = h.asx_ticker
"""
_Q["watchlist"] = """
  select event_id, asx_ticker, event_type, effective_date, round(score, 6) as score from study
  where tradeable and score is not null and (effective_date is null or effective_date >= date '2000-06-30')
  order by study.score desc, event_id limit 50
"""
_STEPS["months"] = """
  select y, m, make_date(y, m, 1) as f, last_day(make_date(y, m, 1)) as l
  from (select distinct year(o_orderdate)::int as y from orders) years, (select unnest(range(1, 13))::int as m) ms
"""
_STEPS["weekdays"] = """
  select d, row_number() over (order by d) as no from (
    select unnest(generate_series((select make_date(min(y) - 1, 1, 1) from months), (select make_date(max(y) + 2, 12, 31) from months), interval 1 day))::date as d)
  where isodow(d) <= 5
"""
_STEPS["month_days"] = """
  select y, m, min(case when isodow(d) = 5 then d end) as friday_1, min(case when isodow(d) = 5 then d end) + 14 as friday_3,
         max(d) as last_day_open, min(d) as first_day_open
  from (select months.*, w.d from months join weekdays w on w.d between f and l) group by all
"""
_Q["review_calendar"] = """
  select family, event_type, review_label, announcement_date_est, effective_date from (
    select 'S&P/ASX' as family, 'REBALANCE' as event_type, y || '-Q' || (m // 3) as review_label, friday_1 as announcement_date_est, friday_3 as effective_date
    from month_days where m in (3, 6, 9, 12)
    union all
    select 'FTSE Russell', 'RECONSTITUTION', y || '-Q' || (m // 3), b.d, friday_3
    from month_days x join weekdays a on a.d = x.friday_3 join weekdays b on b.no = a.no - 10 where m in (3, 6, 9, 12)
    union all
    select 'MSCI', 'RECONSTITUTION', y || '-' || case m when 2 then 'QIR-Feb' when 5 then 'SAIR-May' when 8 then 'QIR-Aug' else 'SAIR-Nov' end, b.d, last_day_open
    from month_days x join weekdays a on a.d = x.last_day_open join weekdays b on b.no = a.no - 9 where m in (2, 5, 8, 11))
"""
_STEPS["fridays"] = """
  select y, m, f, f + ((12 - isodow(f)) % 7)::int + 14 as friday_3,
         f + case isodow(f) when 6 then 2 when 7 then 1 else 0 end as first_open
  from (select y, m, make_date(y, m, 1) as f from (select unnest(range(1990, 2010))::int as y) a, (select unnest(range(1, 13))::int as m) b)
"""
_Q["next_effective"] = """
  select product_ticker, as_of_date as as_of, next_effective, date_diff('day', as_of_date, next_effective) as days_until,
         next_effective - lead_days as watch_pro_forma_from
  from (
    select s.product_ticker, s.as_of_date, 5 + s.n % 4 as lead_days,
           min(case when s.n % 3 = 0 then x.first_open else x.friday_3 + 3 end) as next_effective
    from (select *, regexp_extract(product_ticker, '(\\d+)', 1)::int as n from snaps) s join fridays x
      on x.y between year(s.as_of_date) and year(s.as_of_date) + 1
     and case s.n % 3 when 0 then x.m in (2, 8) when 1 then x.m in (3, 6, 9, 12) else x.m in (6, 12) end
     and case when s.n % 3 = 0 then x.first_open else x.friday_3 + 3 end >= s.as_of_date
    group by all)
"""
_Q["next_quarterly"] = """
  select day, min(friday_3) as next_review
  from (select distinct o_orderdate::date as day from orders) d join fridays x on x.m in (3, 6, 9, 12) and x.friday_3 >= d.day group by 1
"""
_Q["registry_confidence"] = "select product_ticker, source, confidence_score from registry"
_Q["registry_priority"] = """
  select product_ticker, 'etf' as record_type, product_name, case when source in ('manual', 'discovery') then issuer end as issuer,
         case when source = 'seed' then (case when product_ticker like '%#1%' then 'small' when product_ticker like '%#2%' then 'other' end)
              else theme end as theme,
         case when source = 'seed' then 'discovery' else source end as source, round(aum, 2) as aum,
         case when source = 'seed' then round(0.10::double + case when aum is not null then 0.05::double else 0 end, 3) else confidence_score end as confidence_score
  from registry
"""
_Q["registry_coverage"] = """
  select record_type, source, count(*) as n_products, round(avg(confidence_score), 6) as avg_confidence,
         round(stddev_samp(confidence_score), 6) as std_confidence, round(min(confidence_score), 6) as min_confidence,
         round(quantile_cont(confidence_score, 0.25), 6) as q25_confidence, round(quantile_cont(confidence_score, 0.5), 6) as q50_confidence,
         round(quantile_cont(confidence_score, 0.75), 6) as q75_confidence, round(max(confidence_score), 6) as max_confidence
  from registry group by all
"""
_Q["ticker_normalise"] = """
  select constituent_ticker, case when constituent_ticker like '% LN' then null else code || '.AX' end as normalised,
         l_suppkey % 6 in (0, 1, 3) as looks_asx, case when constituent_ticker like '% LN' then null else code || '.AX' end as symbol
  from (select distinct constituent_ticker, code, l_suppkey from holdings)
"""
_Q["price_universe"] = "select symbol from profiles union select asx_ticker as symbol from ev"
_Q["valid_symbols"] = "select event_id, asx_ticker from ev where asx_ticker in (select symbol from profiles)"
_Q["acquisition_gaps"] = """
  select product_ticker from registry where product_ticker not in (
    select product_ticker from holdings where regexp_matches(product_ticker, '[02468]$'))
"""
_Q["percentile_ranks"] = """
  select c_custkey, 'c_acctbal' as measure, round((rank() over (order by c_acctbal) + (count(*) over (partition by c_acctbal) - 1) / 2.0) / count(*) over (), 9) as pct_rank from customer
  union all
  select c_custkey, 'c_nationkey', round((rank() over (order by c_nationkey) + (count(*) over (partition by c_nationkey) - 1) / 2.0) / count(*) over (), 9) from customer
"""
_Q["grouped_quantiles"] = """
  select l_returnflag, measure, prob, round(quantile, 6) as quantile from (
    select l_returnflag, measure, unnest([0.025::double, 0.5::double, 0.975::double]) as prob, unnest(q) as quantile from (
      select l_returnflag, 'l_extendedprice' as measure, quantile_cont(l_extendedprice, [0.025, 0.5, 0.975]) as q from lineitem group by 1
      union all select l_returnflag, 'l_quantity', quantile_cont(l_quantity, [0.025, 0.5, 0.975]) from lineitem group by 1))
"""
_Q["date_parsing"] = """
  select o_orderkey, case when o_orderkey % 4 < 3 then o_orderdate::date end as parsed,
         substr(sha1('order|' || o_orderkey || '|' || o_orderdate::date || '|'), 1, 12) as order_id from orders
"""
_Q["announcement_candidates"] = """
  select doc_id, code || '.AX' as asx_ticker, action, day as announcement_date, null::date as effective_date,
         0.2::double as confidence, true as needs_verification
  from (
    select doc_id, case when doc_id % 4 in (0, 1) then date '2024-01-01' + (doc_id % 365)::int end as day,
           unnest(case doc_id % 4 when 0 then [{'code': lpad((doc_id % 900)::varchar, 3, '0'), 'action': 'ADD'}]
                  when 1 then [{'code': lpad((doc_id % 900)::varchar, 3, '0'), 'action': 'DELETE'}, {'code': 'ABX', 'action': 'DELETE'}]
                  when 2 then [{'code': lpad((doc_id % 900)::varchar, 3, '0'), 'action': 'ADD'}] else [] end, recursive := true)
    from documents)
"""
_Q["rule_extraction"] = """
  select doc_id, 'capped ' || (doc_id % 20 + 1) || '%' as max_weight_rules,
         case when doc_id % 2 = 0 then 'rebalanced quarterly' else 'Rebalancing semi-annually' end as rebalance_frequency,
         case when doc_id % 3 = 0 then 'Reconstitution annually' end as reconstitution_frequency,
         case when doc_id % 5 = 0 then 'Free-float adjusted' else 'equal-weighted' end as weighting_scheme,
         'Market capitalisation US$' || (doc_id % 90 + 10) || ' million' as market_cap_rules,
         'Average daily value traded $' || (doc_id % 9 + 1) || ' million' as liquidity_rules,
         length(text || chr(10) || 'Constituents are capped at ' || (doc_id % 20 + 1) || '%. '
           || case when doc_id % 2 = 0 then 'The index is rebalanced quarterly. ' else 'Rebalancing happens semi-annually. ' end
           || case when doc_id % 3 = 0 then 'Reconstitution is annually done. ' else '' end
           || case when doc_id % 5 = 0 then 'Free-float adjusted weights. ' else 'An equal-weighted index. ' end
           || 'Market capitalisation above US$' || (doc_id % 90 + 10) || ' million. '
           || 'Average daily value traded of $' || (doc_id % 9 + 1) || ' million.') as chars_extracted
  from documents
"""
_Q["page_links"] = """
  select page_id, unnest([{'kind': 'benchmark', 'value': 'Tracks the Metals ' || (page_id % 7) || ' Index'},
    {'kind': 'holdings_link', 'value': '/files/holdings-' || page_id || '.csv'},
    {'kind': 'holdings_link', 'value': '/x/constituents.json'}], recursive := true)
  from pages
"""
_Q["page_text"] = """
  select page_id, length(t) as n_chars, md5(t) as digest from (select page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') as t from pages)
"""
_Q["candidate_dataset"] = """
  select is_added, count(*) as n_rows, count(distinct asx_ticker) as n_stocks from (
    select 1 as is_added, asx_ticker from ev where event_type in ('OFFICIAL_INDEX_ADD', 'ETF_HOLDINGS_NEW_POSITION')
    union all select 0, symbol from profiles) group by 1
"""
_Q["stream_daily_bars"] = """
  select user_id::varchar as symbol, ts::date as date, first(value order by ts, value) as open, max(value) as high,
         min(value) as low, last(value order by ts, value) as close, count(*)::double as volume
  from events where event_type = 'purchase' group by all
"""
_Q["stream_distinct_events"] = "select ts::date as day, count(distinct event_id) as n_events from events group by 1"
_Q["stream_snapshot_changes"] = """
  select product_ticker, change_type, count(*) as n_changes, sum(shares_delta) as net_shares from diffs group by all
"""
_Q["stream_watchlist"] = """
  select event_id, asx_ticker, effective_date, round(score, 6) as score from study
  where tradeable and score is not null and (effective_date is null or effective_date >= date '2000-06-30')
"""


# The first research round is the same chain over four variants of one strategy.
_VARIANTS = {
    "baseline": (0.03, 0.5, "effective"),
    "round 1: tighter reaction": (0.021, 0.5, "effective"),
    "round 1: higher pressure": (0.03, 0.75, "effective"),
    "round 1: later exit": (0.03, 0.5, "eff_close_plus:5"),
}


def _variant_trades(variants: dict[str, tuple]) -> str:
    return " union all ".join(
        f"select '{n}' as strategy, event_id, asx_ticker, 1 as direction, '{out}' as exit_spec, 25 as max_hold_days from feat"
        f" where tradeable and {_LONG} and (abs(imm) <= {imm} or imm is null)"
        f" and (flow_pressure >= {fp} or flow_pressure is null) and (confidence_score >= 0.4 or confidence_score is null)"
        for n, (imm, fp, out) in variants.items()
    )


def _variant_steps(prefix: str, variants: dict[str, tuple]) -> None:
    """The ledger, interval and gate chain over some variants, under names of its own."""
    _STEPS[f"{prefix}_trades"] = _variant_trades(variants)
    _STEPS[f"{prefix}_ledger"] = _ledger(f"{prefix}_trades", "feat")
    for step in ("ex", "boot_values", "boot_steps", "boot_draws", "boot_means", "ci"):
        _STEPS[f"{prefix}_{step}"] = re.sub(
            r"\b(from|join) (ledger|ex|boot_values|boot_steps|boot_draws|boot_means)\b", rf"\1 {prefix}_\2", _STEPS[step]
        )


_OBJECTIVE = """case when coalesce(n, 0) < 3 then -9.0 + coalesce(n, 0)
                    else coalesce(harsh - case when net <= 0 then 0.05 else 0 end + case when ci_low > 0 then 0.02 else 0 end, -5.0) end"""


def _variant_scores(prefix: str, variants: dict[str, tuple]) -> str:
    return f"""(select unnest([{", ".join(f"'{n}'" for n in variants)}]) as strategy) v
  left join (select strategy, count(net_return) as n, avg(net_return) as net, avg(harsh_net_return) as harsh from {prefix}_ex group by 1) m
    on v.strategy = m.strategy
  left join {prefix}_ci c on v.strategy = c.strategy"""


_variant_steps("sw", _VARIANTS)
_Q["param_sweep"] = f"""
  select v.strategy, coalesce(n, 0) as n_trades, round(net, 6) as avg_net, round(harsh, 6) as avg_harsh,
         round({_OBJECTIVE}, 6) as objective,
         coalesce(g.passed and coalesce(c.ci_low > 0, false), false) as claim_alpha
  from {_variant_scores("sw", _VARIANTS)}
  left join ({_gate('sw_ex')}) g on v.strategy = g.strategy
"""


def _rounded_often(value: float, factor: float, times: int, digits: int, floor: float = 0.0) -> float:
    for _ in range(times):
        value = round(max(floor, value * factor), digits)
    return value


# Every parameter set five rounds can reach: a times tighter, b times higher, c times later.
_SETS = {
    f"{a}-{b}-{c}": (_rounded_often(0.03, 0.7, a, 4, 0.005), _rounded_often(0.5, 1.5, b, 3), "eff_close_plus:5" if c else "effective")
    for a in range(6) for b in range(6) for c in range(2) if a + b + c <= 5
}
_variant_steps("rh", _SETS)
_STEPS["rh_scores"] = f"""
  select split_part(v.strategy, '-', 1)::int as a, split_part(v.strategy, '-', 2)::int as b, split_part(v.strategy, '-', 3)::int as c,
         coalesce(n, 0) as n, {_OBJECTIVE} as score
  from {_variant_scores("rh", _SETS)}
"""
_STEPS["rh_walk0"] = "select 0 as round, a, b, c, score as best, true as going from rh_scores where a = 0 and b = 0 and c = 0"
for _round in range(1, 6):
    _STEPS[f"rh_try{_round}"] = f"""
  select {_round} as round, w.a, w.b, w.c, w.best, x.n as n1, x.score as s1, y.n as n2, y.score as s2, z.n as n3, z.score as s3,
         case when greatest(x.score, y.score, z.score) <= w.best + 1e-6 then 0
              when x.score >= greatest(y.score, z.score) then 1 when y.score >= z.score then 2 else 3 end as winner
  from rh_walk{_round - 1} w join rh_scores x on x.a = w.a + 1 and x.b = w.b and x.c = w.c
  join rh_scores y on y.a = w.a and y.b = w.b + 1 and y.c = w.c join rh_scores z on z.a = w.a and z.b = w.b and z.c = 1
  where w.going
"""
    _STEPS[f"rh_walk{_round}"] = f"""
  select round, a + (winner = 1)::int as a, b + (winner = 2)::int as b, case when winner = 3 then 1 else c end as c,
         case winner when 1 then s1 when 2 then s2 when 3 then s3 else best end as best, winner > 0 as going
  from rh_try{_round}
"""
_Q["research_history"] = "select 0 as round, 'baseline' as trial, n as n_trades, round(score, 6) as objective, true as adopted from rh_scores where a = 0 and b = 0 and c = 0" + "".join(
    f" union all select round, '{label}', n{k}, round(s{k}, 6), winner = {k} from rh_try{r}"
    for r in range(1, 6)
    for k, label in enumerate(("tighter reaction", "higher pressure", "later exit"), 1)
)


# ------------------------------------------------------------------ landed files
_BARS_OUT = """
  select symbol, date, round(open, 6) as open, round(high, 6) as high, round(low, 6) as low, round(close, 6) as close,
         round(adj_close, 6) as adj_close, volume, round(vwap, 6) as vwap, round(dollar_volume, 3) as dollar_volume from bars
"""
_Q["csv_bars"] = _Q["json_bars"] = _BARS_OUT
_Q["bars_between"] = _BARS_OUT + "  where date between date '1995-06-01' and date '1997-03-31'"
_Q["saved_snapshots"] = """
  select product_ticker, as_of_date, constituent_ticker, constituent_name, round(weight_pct, 8) as weight_pct, shares,
         round(market_value, 2) as market_value from holdings
"""
_Q["payload_profiles"] = """
  select symbol, company_name, sector, industry, round(market_cap, 6) as market_cap, round(price, 6) as price from profiles
"""
_Q["payload_market_caps"] = "select symbol, date, round(market_cap, 6) as market_cap from caps"
_Q["payload_fund_holdings"] = """
  select h.product_ticker as etf, case when code::int % 2 = 0 then code || '.AX' else code end as asset,
         case when code::int % 7 = 0 then 'GB000' else 'AU000' || code end as isin, constituent_name as name,
         round(weight_pct * 100.0, 8) as weight_pct, shares, round(market_value, 2) as market_value
  from holdings h join (select product_ticker, max(as_of_date) as as_of_date from holdings group by 1) m
    on h.product_ticker = m.product_ticker and h.as_of_date = m.as_of_date
"""
_Q["payload_changes"] = "select distinct index_name as reason, action, ticker, effective_date from changes"
_Q["announcement_files"] = """
  select case when confidence >= 0.6 then provider end as provider, index_name, asx_ticker,
         case when confidence >= 0.6 then company_name end as company_name, announcement_date, effective_date, source_url,
         round(case when confidence >= 0.6 then 0.9 else confidence end, 6) as confidence
  from ann
"""
_Q["saved_registry"] = """
  select product_ticker, record_type, product_name, source, round(aum, 2) as aum, round(confidence_score, 6) as confidence_score from registry
"""
_Q["manual_registry"] = """
  select 'etf' as record_type, product_ticker, product_name, issuer, theme, round(aum, 2) as aum,
         regexp_extract(product_name, '(\\d+)', 1)::int % 2 = 1 as asx_exposure_flag, 'manual' as source, '3,6,12' as months
  from registry_rows
  union all
  select case when aum is not null then 'benchmark' else 'index' end, product_ticker, benchmark_index_name, null, 'a "quoted", ' || theme,
         null, null, 'manual', ''
  from registry_rows where benchmark_index_name is not null
"""
_Q["hand_entered_events"] = """
  select event_id, max(case when k % 100 = 0 then date '1999-12-31' end) as effective_date, max(case when k % 200 = 50 then 'confirmed' end) as notes
  from (select event_id, split_part(source_url_or_file, ':', 2)::bigint as k from ev_ann) where k % 50 = 0 and k >= 50
  group by 1
"""
_Q["scoreboard"] = "select strategy, count(net_return) as n_trades, round(avg(net_return), 6) as avg_return from ex group by 1"


def oracle_sql() -> dict[str, str]:
    """Complete statements by query name."""
    return {name: _plain_round(_with(sql)) for name, sql in _Q.items()}
