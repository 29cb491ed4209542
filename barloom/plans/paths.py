"""DuckDB SQL of the path-dependent operators: candidates of all starting points at once, then a recursive walk over them."""

from __future__ import annotations

#: Rows of a pair with their number, z and fresh crosses; needs `rows` of the catalogue.
SIGNALS = """zs AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY ts_ms) - 1 AS i, count(*) OVER (PARTITION BY pair) - 1 AS last, ts_ms - lag(ts_ms) OVER (PARTITION BY pair ORDER BY ts_ms) AS gap,
  CASE WHEN count(spread) OVER w >= 24 AND stddev_samp(spread) OVER w > 0 THEN (spread - avg(spread) OVER w) / stddev_samp(spread) OVER w END AS z FROM rows WINDOW w AS (PARTITION BY pair ORDER BY ts_ms ROWS 23 PRECEDING)),
zl AS (SELECT *, lag(z) OVER (PARTITION BY pair ORDER BY ts_ms) AS zp FROM zs),
sg AS MATERIALIZED (SELECT *, 0.5::DOUBLE AS beta, 24 AS hold, CASE WHEN z < -1.5 AND zp >= -1.5 THEN 1 WHEN z > 1.5 AND zp <= 1.5 THEN -1 ELSE 0 END AS signal FROM zl),
step AS (SELECT pair, CAST(floor(median(gap)) AS BIGINT) AS bar_ms FROM zs GROUP BY pair)"""

_REASON = "CASE WHEN side * r.z >= -0.5 THEN 'take_profit' WHEN side * r.z <= -4.0 THEN 'stop_z' WHEN r.i - fill + 1 >= c0.hold THEN 'time_stop' END"

#: The walk from trade to trade over candidates (pair, t, free): the next start at or after free.
_CHAIN = """nx AS MATERIALIZED (SELECT a.pair, a.t, min(b.t) AS nxt FROM cand a JOIN cand b ON a.pair = b.pair AND b.t >= a.free GROUP BY ALL),
chain AS (SELECT pair, min(t) AS t FROM cand GROUP BY pair UNION ALL SELECT c.pair, nx.nxt FROM chain c JOIN nx USING (pair, t))"""

_TRADE = """pair, side, round(beta, 6) AS beta, round(1 / (1 + abs(beta)), 6) AS w1, round(abs(beta) / (1 + abs(beta)), 6) AS w2, t AS signal_idx, fill AS entry_idx, {dec} AS exit_decision_idx, out AS exit_idx, entry_ts, exit_ts, e1 AS entry_p1, e2 AS entry_p2, x1 AS exit_p1, x2 AS exit_p2,
round(ez, 6) AS entry_z, round(side / (1 + abs(beta)) * (x1 / e1 - 1) - side * abs(beta) / (1 + abs(beta)) * (x2 / e2 - 1), 6) AS gross_ret, round((exit_ts - entry_ts) / 60000.0, 6) AS hold_minutes, reason AS exit_reason,
vol_e1 AS entry_vol1_usd, vol_e2 AS entry_vol2_usd, vol_x1 AS exit_vol1_usd, vol_x2 AS exit_vol2_usd, {flags}"""

_TAKER = (
    f"""c0 AS (SELECT pair, i AS t, i + 1 AS fill, signal AS side, z AS ez, last, beta, hold FROM sg WHERE signal <> 0 AND z IS NOT NULL AND i + 1 <= last),
m AS (SELECT c0.pair, t, r.i, {_REASON} AS reason FROM c0 JOIN sg r ON r.pair = c0.pair AND r.i >= fill),
x AS (SELECT pair, t, min(i) AS dec, arg_min(reason, i) AS reason FROM m WHERE reason IS NOT NULL GROUP BY ALL),
cand AS MATERIALIZED (SELECT c0.*, dec, reason AS why, coalesce(dec + 1, last + 1) AS free FROM c0 LEFT JOIN x USING (pair, t)), {_CHAIN},
taken AS (SELECT c.*, a.ts_ms AS entry_ts, a.open1 AS e1, a.open2 AS e2, a.volume1 * a.close1 AS vol_e1, a.volume2 * a.close2 AS vol_e2, b.i AS out, b.volume1 * b.close1 AS vol_x1, b.volume2 * b.close2 AS vol_x2,
  CASE WHEN dec < c.last THEN b.open1 ELSE b.close1 END AS x1, CASE WHEN dec < c.last THEN b.open2 ELSE b.close2 END AS x2, CASE WHEN dec < c.last THEN b.ts_ms ELSE b.ts_ms + bar_ms END AS exit_ts,
  CASE WHEN dec IS NULL THEN 'end_of_window' WHEN dec < c.last THEN why ELSE why || '_at_window_end' END AS reason
  FROM chain JOIN cand c USING (pair, t) JOIN sg a ON a.pair = c.pair AND a.i = fill JOIN sg b ON b.pair = c.pair AND b.i = CASE WHEN dec < c.last THEN dec + 1 ELSE c.last END JOIN step ON step.pair = c.pair)"""
)
TAKER = f"{SIGNALS}, {_TAKER}"
TAKER_TRADES = f"SELECT {_TRADE.format(dec='NULL::INTEGER', flags='NULL::BOOLEAN AS entry_maker1, NULL::BOOLEAN AS entry_maker2, NULL::BOOLEAN AS exit_maker1, NULL::BOOLEAN AS exit_maker2')} FROM taken"

#: The baseline window by window, keyed by window and pair: hedges and half-lives of the training span, trades of the test span.
BASELINE = f"""wd(k, a, b, c) AS (VALUES {{WINDOWS}}),
tl AS (SELECT k, pair, ts_ms, ln(close1) AS x1, ln(close2) AS x2 FROM legs JOIN wd ON ts_ms >= a AND ts_ms < b),
fit AS (SELECT k, pair, regr_intercept(x1, x2) AS alpha, regr_slope(x1, x2) AS beta FROM tl GROUP BY k, pair),
te AS (SELECT k, pair, ts_ms, x1 - beta * x2 - alpha AS e FROM tl JOIN fit USING (k, pair)), td AS (SELECT k, pair, e - lag(e) OVER w AS d, lag(e) OVER w AS e0 FROM te WINDOW w AS (PARTITION BY k, pair ORDER BY ts_ms)),
hl AS (SELECT k, pair, CASE WHEN regr_slope(d, e0) < 0 THEN -ln(2) / regr_slope(d, e0) * 60 ELSE 'inf'::DOUBLE END AS hl FROM td WHERE e0 IS NOT NULL GROUP BY k, pair),
br AS (SELECT wd.k || '|' || legs.pair AS pair, ts_ms, open1, close1, volume1, open2, close2, volume2, beta, b AS start, greatest(1, CAST(floor(least(hl * 3, 4320) / 60) AS INTEGER)) AS hold, ln(close1) - beta * ln(close2) - alpha AS spread
  FROM legs JOIN wd ON ts_ms >= b - 172800000 AND ts_ms < c JOIN fit ON fit.k = wd.k AND fit.pair = legs.pair JOIN hl ON hl.k = wd.k AND hl.pair = legs.pair),
zs AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY ts_ms) - 1 AS i, count(*) OVER (PARTITION BY pair) - 1 AS last, ts_ms - lag(ts_ms) OVER (PARTITION BY pair ORDER BY ts_ms) AS gap,
  CASE WHEN count(spread) OVER w >= 24 AND stddev_samp(spread) OVER w > 0 THEN (spread - avg(spread) OVER w) / stddev_samp(spread) OVER w END AS z FROM br WINDOW w AS (PARTITION BY pair ORDER BY ts_ms ROWS 23 PRECEDING)),
zl AS (SELECT *, lag(z) OVER (PARTITION BY pair ORDER BY ts_ms) AS zp FROM zs),
sg AS MATERIALIZED (SELECT *, CASE WHEN ts_ms < start THEN 0 WHEN z < -1.5 AND zp >= -1.5 THEN 1 WHEN z > 1.5 AND zp <= 1.5 THEN -1 ELSE 0 END AS signal FROM zl),
step AS (SELECT pair, CAST(floor(median(gap)) AS BIGINT) AS bar_ms FROM zs GROUP BY pair), {_TAKER} SELECT * REPLACE (split_part(pair, '|', 2) AS pair), split_part(pair, '|', 1)::INTEGER AS "window" FROM ({TAKER_TRADES})"""


def _through(leg: int, buy: str, limit: str) -> str:
    return f"CASE WHEN {buy} THEN r.low{leg} < {limit} * (1 - 1.0 / 1e4) ELSE r.high{leg} > {limit} * (1 + 1.0 / 1e4) END"


MAKER = (
    SIGNALS
    + f""", q AS (SELECT pair, i AS t, signal AS side, z AS ez, last, beta, hold, close1 AS l1, close2 AS l2 FROM sg WHERE signal <> 0 AND z IS NOT NULL AND i + 4 <= last),
f AS (SELECT q.pair, t, min(CASE WHEN {_through(1, 'side > 0', 'l1')} THEN r.i END) AS f1, min(CASE WHEN {_through(2, 'side < 0', 'l2')} THEN r.i END) AS f2 FROM q JOIN sg r ON r.pair = q.pair AND r.i BETWEEN t + 1 AND t + 3 GROUP BY ALL),
c0 AS (SELECT q.*, f1, f2, CASE WHEN f1 IS NULL AND f2 IS NULL THEN NULL WHEN f1 IS NOT NULL AND f2 IS NOT NULL THEN greatest(f1, f2) ELSE t + 4 END AS fill FROM q JOIN f USING (pair, t)),
m AS (SELECT c0.pair, t, r.i, {_REASON} AS reason FROM c0 JOIN sg r ON r.pair = c0.pair AND r.i >= fill),
x AS (SELECT pair, t, min(i) AS dec, arg_min(reason, i) AS why FROM m WHERE reason IS NOT NULL GROUP BY ALL),
d AS (SELECT c0.*, dec, why, d.close1 AS k1, d.close2 AS k2 FROM c0 LEFT JOIN x USING (pair, t) LEFT JOIN sg d ON d.pair = c0.pair AND d.i = dec),
g AS (SELECT d.pair, t, min(CASE WHEN {_through(1, 'side < 0', 'k1')} THEN r.i END) AS g1, min(CASE WHEN {_through(2, 'side > 0', 'k2')} THEN r.i END) AS g2 FROM d JOIN sg r ON r.pair = d.pair AND r.i BETWEEN dec + 1 AND dec + 3 WHERE why = 'take_profit' GROUP BY ALL),
h AS (SELECT d.*, g1, g2, g1 IS NOT NULL AND g2 IS NOT NULL AS passive, CASE WHEN dec IS NULL THEN last + 1 WHEN g1 IS NOT NULL AND g2 IS NOT NULL THEN greatest(g1, g2) WHEN why = 'take_profit' THEN dec + 4 ELSE dec + 1 END AS want FROM d LEFT JOIN g USING (pair, t)),
cand AS MATERIALIZED (SELECT *, least(want, last) AS out, CASE WHEN fill IS NULL THEN t + 3 ELSE greatest(least(want, last), coalesce(dec, last) + 1) END AS free FROM h), {_CHAIN},
taken AS (SELECT c.*, a.ts_ms AS entry_ts, CASE WHEN f1 IS NULL THEN a.open1 ELSE l1 END AS e1, CASE WHEN f2 IS NULL THEN a.open2 ELSE l2 END AS e2, a.volume1 * a.close1 AS vol_e1, a.volume2 * a.close2 AS vol_e2, b.volume1 * b.close1 AS vol_x1, b.volume2 * b.close2 AS vol_x2,
  CASE WHEN g1 IS NOT NULL THEN k1 WHEN want <= c.last THEN b.open1 ELSE b.close1 END AS x1, CASE WHEN g2 IS NOT NULL THEN k2 WHEN want <= c.last THEN b.open2 ELSE b.close2 END AS x2,
  CASE WHEN passive THEN b.ts_ms + bar_ms - 1 WHEN want <= c.last THEN b.ts_ms ELSE b.ts_ms + bar_ms END AS exit_ts,
  CASE WHEN dec IS NULL THEN 'end_of_window' WHEN want <= c.last THEN why ELSE why || '_at_window_end' END AS reason
  FROM chain JOIN cand c USING (pair, t) JOIN sg a ON a.pair = c.pair AND a.i = fill JOIN sg b ON b.pair = c.pair AND b.i = out JOIN step ON step.pair = c.pair)"""
)
MAKER_TRADES = f"SELECT {_TRADE.format(dec='coalesce(dec, last)', flags='f1 IS NOT NULL AS entry_maker1, f2 IS NOT NULL AS entry_maker2, g1 IS NOT NULL AS exit_maker1, g2 IS NOT NULL AS exit_maker2')} FROM taken"

#: Decisions of the live engine: every entry and, if there is one, its exit.
DECISIONS = f"""WITH RECURSIVE {{pairs}}, {TAKER.replace('AND i + 1 <= last)', ')', 1)}
SELECT pair, ts_ms, 'enter' AS action, side, round(ez, 6) AS z, NULL AS reason, 0 AS held FROM chain JOIN cand USING (pair, t) JOIN sg USING (pair) WHERE sg.i = t
UNION ALL SELECT c.pair, s.ts_ms, 'exit', side, round(s.z, 6), why, dec - t FROM chain JOIN cand c USING (pair, t) JOIN sg s ON s.pair = c.pair AND s.i = dec"""

#: The portfolio: candidates in order of entry, with equity and open positions as the state of the walk.
PORTFOLIO = (
    TAKER
    + """, fund AS (SELECT symbol, ts_ms, n_ticks * 1e-5 AS rate FROM bars),
tr AS MATERIALIZED (SELECT k.*, p.asset1, p.asset2, (SELECT coalesce(sum(rate), 0) FROM fund WHERE symbol = asset1 AND ts_ms > entry_ts AND ts_ms <= exit_ts) AS rates1, (SELECT coalesce(sum(rate), 0) FROM fund WHERE symbol = asset2 AND ts_ms > entry_ts AND ts_ms <= exit_ts) AS rates2,
  row_number() OVER (ORDER BY entry_ts, k.pair) - 1 AS k, side / 1.5 * (x1 / e1 - 1) - side * 0.5 / 1.5 * (x2 / e2 - 1) AS ret FROM taken k JOIN prs p ON p.pair = k.pair),
pf AS (
  SELECT -1::BIGINT AS k, 1000.0::DOUBLE AS equity, []::STRUCT(until BIGINT, p VARCHAR, net DOUBLE, gross DOUBLE)[] AS held, false AS accepted, 0.0::DOUBLE AS size, 0.0::DOUBLE AS paid, 0.0::DOUBLE AS carried, 0.0::DOUBLE AS net
  UNION ALL
  SELECT k, eq, CASE WHEN ok THEN list_append(now, {'until': exit_ts, 'p': pair, 'net': size * ret - paid - carried, 'gross': size}) ELSE now END, ok, size, paid, carried, size * ret - paid - carried
  FROM (SELECT *, ok_size > 1e-9 AND eq > 0 AND len(now) < 4 AND NOT list_contains(list_transform(now, lambda h: h.p), pair) AS ok, ok_size AS size,
      (ok_size / 1.5) * (0.00065 + CASE WHEN vol_e1 > 0 THEN 0.001 * sqrt(ok_size / 1.5 / vol_e1) ELSE 0 END) + (ok_size * 0.5 / 1.5) * (0.00065 + CASE WHEN vol_e2 > 0 THEN 0.001 * sqrt(ok_size * 0.5 / 1.5 / vol_e2) ELSE 0 END)
      + (ok_size / 1.5 * x1 / e1) * (0.00065 + CASE WHEN vol_x1 > 0 THEN 0.001 * sqrt(ok_size / 1.5 * x1 / e1 / vol_x1) ELSE 0 END) + (ok_size * 0.5 / 1.5 * x2 / e2) * (0.00065 + CASE WHEN vol_x2 > 0 THEN 0.001 * sqrt(ok_size * 0.5 / 1.5 * x2 / e2 / vol_x2) ELSE 0 END) AS paid,
      side * (ok_size / 1.5 * rates1 - ok_size * 0.5 / 1.5 * rates2) AS carried
    FROM (SELECT *, greatest(least(0.25 * eq, eq - coalesce(list_sum(list_transform(now, lambda h: h.gross)), 0)), 0) AS ok_size
      FROM (SELECT tr.*, list_filter(pf.held, lambda h: h.until > tr.entry_ts) AS now, pf.equity + coalesce(list_sum(list_transform(list_filter(pf.held, lambda h: h.until <= tr.entry_ts), lambda h: h.net)), 0) AS eq FROM pf JOIN tr ON tr.k = pf.k + 1)))
), done AS (SELECT tr.k, row_number() OVER (ORDER BY exit_ts, pair) - 1 AS seq, 1000 + sum(net) OVER (ORDER BY exit_ts, pair) AS equity_after FROM pf JOIN tr USING (k) WHERE accepted)
SELECT 'taker' AS label, pair, entry_ts, exit_ts, accepted, CASE WHEN accepted THEN round(size, 4) END AS gross_notional, CASE WHEN accepted THEN round(size * ret, 4) END AS gross_pnl, CASE WHEN accepted THEN round(paid, 4) END AS execution_cost,
CASE WHEN accepted THEN round(carried, 4) + 0 END AS funding_cost, CASE WHEN accepted THEN round(net, 4) END AS net_pnl, CASE WHEN accepted THEN round(equity, 4) END AS equity_at_entry, round(equity_after, 4) AS equity_after, seq
FROM pf JOIN tr USING (k) LEFT JOIN done USING (k)"""
)

#: The daily account of weights w(d_idx, symbol, w) on days reb(d_idx) over the panel, until ruin.
DAILY = """pn AS MATERIALIZED (SELECT p.d_idx, p.symbol, p.close, coalesce(w.w, 0) AS w, reb.d_idx IS NOT NULL AS reb, CASE WHEN p.close IS NOT NULL AND lead(p.close) OVER q IS NOT NULL THEN lead(p.close) OVER q / p.close - 1 ELSE 0 END AS move, lead(p.funding) OVER q AS next_f
  FROM panel p LEFT JOIN w USING (d_idx, symbol) LEFT JOIN reb USING (d_idx) WINDOW q AS (PARTITION BY p.symbol ORDER BY p.d_idx)),
acc AS (
  SELECT 0 AS d_idx, symbol, 0.0::DOUBLE AS held, 0.0::DOUBLE AS aim, 0.0::DOUBLE AS was, 0.0::DOUBLE AS gross, 0.0::DOUBLE AS paid, 0.0::DOUBLE AS turn, false AS ruined FROM names
  UNION ALL
  SELECT d_idx + 1, symbol, CASE WHEN gross > -1 THEN aim * (1 + move) / (1 + gross) ELSE 0 END, aim, was, gross, paid, turn, gross - paid - turn * 0.00065 <= -1 OR gross <= -1 OR sum(abs(aim * (1 + move) / (1 + gross))) OVER () > 20
  FROM (SELECT *, sum(aim * move) OVER () AS gross, sum(aim * next_f) OVER () AS paid, sum(abs(aim - was)) OVER () AS turn
    FROM (SELECT pn.d_idx, pn.symbol, move, next_f, acc.held AS was, CASE WHEN close IS NULL THEN 0.0 WHEN reb THEN w ELSE acc.held END AS aim FROM acc JOIN pn USING (d_idx, symbol) WHERE NOT acc.ruined AND pn.d_idx < 79))
), days AS (SELECT d_idx, max(gross) AS gross, max(paid) AS funding, max(turn) AS turnover, sum(abs(aim)) AS exposure, bool_or(ruined) AS ruined FROM acc WHERE d_idx > 0 GROUP BY d_idx)"""

#: Candidates and daily state of the funding harvest; needs `panel` and `names` of the catalogue.
HARVEST = """spots AS (SELECT d_idx, symbol, count(CASE WHEN s_idx % 2 = 0 THEN close END) OVER (PARTITION BY symbol ORDER BY d_idx ROWS 3 PRECEDING) = 4 AS ok FROM panel),
hu AS (SELECT *, count(close) OVER w = 4 AS live, avg(quote_volume) OVER w AS adv, round(sum(funding) OVER (PARTITION BY symbol ORDER BY d_idx ROWS 2 PRECEDING), 9) AS f7 FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY d_idx ROWS 3 PRECEDING)),
hr AS (SELECT *, row_number() OVER (PARTITION BY d_idx ORDER BY adv DESC, s_idx) AS rank FROM hu WHERE live AND d_idx >= 4),
hc AS (SELECT hr.* FROM hr JOIN spots USING (d_idx, symbol) WHERE rank <= 20 AND spots.ok),
hd AS MATERIALIZED (SELECT d.d_idx, coalesce(list({'s': symbol, 'f': f7} ORDER BY f7 DESC, s_idx) FILTER (symbol IS NOT NULL), []) AS today FROM (SELECT unnest(range(0, {DAYS}))::INTEGER AS d_idx) d LEFT JOIN hc USING (d_idx) GROUP BY d.d_idx),
hv AS (
  SELECT -1 AS d_idx, []::STRUCT(s VARCHAR, since INTEGER)[] AS held, []::STRUCT(s VARCHAR, since INTEGER)[] AS gone, false AS changed
  UNION ALL
  SELECT d_idx, list_concat(kept, fresh), gone, len(gone) + len(fresh) > 0 FROM (SELECT *, list_transform(list_filter(today, lambda c: c.f >= 0.0004 AND NOT list_contains(list_transform(kept, lambda h: h.s), c.s))[1:greatest(0, 5 - len(kept))], lambda c: {'s': c.s, 'since': d_idx}) AS fresh
    FROM (SELECT hd.d_idx, today, list_filter(hv.held, lambda h: len(list_filter(today, lambda c: c.s = h.s AND c.f >= 0.0001)) > 0) AS kept, list_filter(hv.held, lambda h: len(list_filter(today, lambda c: c.s = h.s AND c.f >= 0.0001)) = 0) AS gone FROM hv JOIN hd ON hd.d_idx = hv.d_idx + 1))
)"""
HARVEST_ROWS = """SELECT 'harvest' AS label, 'weight' AS kind, d_idx, sym AS symbol, w, NULL::INTEGER AS until FROM (SELECT d_idx, unnest(held).s AS s FROM hv), LATERAL (SELECT unnest([s, 'SPOT:' || s]) AS sym, unnest([-1.0 / 15, 1.0 / 15]) AS w)
UNION ALL SELECT 'harvest', 'rebalance', d_idx, '', 0.0, NULL FROM hv WHERE changed
UNION ALL SELECT 'harvest', 'episode', g.since, g.s, 0.0, d_idx FROM (SELECT d_idx, unnest(gone) AS g FROM hv)
UNION ALL SELECT 'harvest', 'episode', h.since, h.s, 0.0, {DAYS} FROM (SELECT unnest(held) AS h FROM hv WHERE d_idx = {DAYS} - 1)"""

#: The sized variant: the closes at the last hedge are the state.
SIZED = """sd AS MATERIALIZED (SELECT hv.d_idx, changed, coalesce(list({'s': p.symbol, 'c': p.close} ORDER BY s_idx) FILTER (p.symbol IS NOT NULL), []) AS now FROM (SELECT d_idx, changed, unnest(CASE WHEN len(held) = 0 THEN [NULL] ELSE list_transform(held, lambda h: h.s) END) AS s FROM hv WHERE d_idx >= 0) hv LEFT JOIN panel p ON p.d_idx = hv.d_idx AND p.symbol = s GROUP BY ALL),
sz AS (
  SELECT -1 AS d_idx, false AS reb, []::STRUCT(s VARCHAR, c DOUBLE)[] AS ref, []::STRUCT(s VARCHAR, c DOUBLE)[] AS now
  UNION ALL
  SELECT d_idx, CASE WHEN len(now) = 0 THEN changed ELSE changed OR up END, CASE WHEN len(now) = 0 THEN [] WHEN changed OR up OR list_sort(list_transform(ref, lambda r: r.s)) <> list_sort(list_transform(now, lambda r: r.s)) THEN now ELSE ref END, now
  FROM (SELECT sd.*, sz.ref AS ref, len(list_filter(sd.now, lambda n: len(list_filter(sz.ref, lambda r: r.s = n.s AND n.c >= 1.5 * r.c)) > 0)) > 0 AS up FROM sz JOIN sd ON sd.d_idx = sz.d_idx + 1)
)
SELECT 'sized' AS label, d_idx, CASE WHEN len(now) = 0 THEN NULL ELSE sym END AS symbol, w, reb, CASE WHEN len(now) = 0 THEN 0.0 ELSE 2 * least(0.25, 1 / (2.0 * len(now))) * len(now) END AS tied
FROM (SELECT d_idx, reb, now, unnest(CASE WHEN len(now) = 0 THEN [''] ELSE list_transform(now, lambda n: n.s) END) AS s FROM sz WHERE d_idx >= 0),
LATERAL (SELECT unnest(CASE WHEN len(now) = 0 THEN [s] ELSE [s, 'SPOT:' || s] END) AS sym, unnest(CASE WHEN len(now) = 0 THEN [0.0] ELSE [-least(0.25, 1 / (2.0 * len(now))), least(0.25, 1 / (2.0 * len(now)))] END) AS w)"""

#: Listings: events in order, admitted while fewer than four are open.
LISTINGS = """first AS (SELECT symbol, min(d_idx) AS d_idx FROM panel WHERE close IS NOT NULL AND symbol <> '{HEDGE}' GROUP BY symbol),
ev AS (SELECT symbol, d_idx + 1 AS entry, least(d_idx + 6, 80) AS stop FROM first WHERE d_idx + 1 < 79),
en AS (SELECT ev.symbol, entry, coalesce(min(CASE WHEN close IS NULL THEN p.d_idx END), any_value(stop)) AS until FROM ev JOIN panel p ON p.symbol = ev.symbol AND p.d_idx >= entry AND p.d_idx < stop GROUP BY ev.symbol, entry),
eo AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY entry, symbol) AS k FROM en WHERE until > entry),
ad AS (SELECT 0::BIGINT AS k, []::INTEGER[] AS ends, false AS ok UNION ALL
  SELECT eo.k, CASE WHEN len(list_filter(ad.ends, lambda x: x > entry)) < 4 THEN list_append(list_filter(ad.ends, lambda x: x > entry), until) ELSE list_filter(ad.ends, lambda x: x > entry) END, len(list_filter(ad.ends, lambda x: x > entry)) < 4 FROM ad JOIN eo ON eo.k = ad.k + 1),
le AS (SELECT symbol, unnest(range(entry, until))::INTEGER AS d_idx FROM eo JOIN ad USING (k) WHERE ok)
SELECT d_idx, symbol, round(sum(w), 9) AS w, 'listing' AS label FROM (SELECT d_idx, symbol, -0.1 AS w FROM le UNION ALL SELECT d_idx, '{HEDGE}', 0.1 FROM le) GROUP BY d_idx, symbol"""

#: The greedy choice of four pairs, at most two an asset, over rows st(pair, asset1, asset2, p).
GREEDY = """o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY p, asset1, asset2) AS k FROM st),
gr AS (SELECT 0::BIGINT AS k, []::VARCHAR[] AS used, []::VARCHAR[] AS chosen UNION ALL
  SELECT o.k, CASE WHEN ok THEN list_concat(used, [asset1, asset2]) ELSE used END, CASE WHEN ok THEN list_append(chosen, pair) ELSE chosen END
  FROM (SELECT o.*, used, chosen, len(chosen) < 4 AND len(list_filter(used, lambda u: u = asset1)) < 2 AND len(list_filter(used, lambda u: u = asset2)) < 2 AS ok FROM gr JOIN o ON o.k = gr.k + 1) AS o),
ch AS (SELECT unnest(chosen) AS pair, unnest(range(0, len(chosen))) AS rank FROM gr WHERE k = (SELECT max(k) FROM gr))"""


def cdf(x: str) -> str:
    """SQL of the normal distribution function: its power series, whose terms are all positive."""
    total = f"list_sum(list_transform(range(0, 120), lambda k: exp((2 * k + 1) * ln(greatest(abs({x}), 1e-300)) - (k + 1) * ln(2) - lgamma(k + 1.5) + ln(pi()) / 2)))"
    upper = f"least(1, 0.5 + exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * {total})"
    return f"(CASE WHEN abs({x}) > 8 THEN CASE WHEN {x} > 0 THEN 1.0 ELSE 0.0 END WHEN {x} >= 0 THEN {upper} ELSE 1 - {upper} END)"
