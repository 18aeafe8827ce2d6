"""The lens views as SQL text, for the oracle side. Same definitions as ``lens.py``."""

from __future__ import annotations

from tidemark.sources.lens_columns import (
    EVENT_SIGNAL, NO_TRADE_MOD, PORTFOLIO_MOD, REGION_OF, REVIEW, TIER_OF_SUPPLIER, UNIVERSE, WATERFALL, sql_case,
)

_close = ("cast(sum(cast(l_extendedprice as decimal(18,2))) as double) / "
          "cast(sum(cast(l_quantity as decimal(18,2))) as double)")

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "prices": ((), f"""
        SELECT l_suppkey AS ticker, cast(l_shipdate AS date) AS date, {_close} AS close,
               cast(sum(cast(l_quantity as decimal(18,2))) as double) AS volume
        FROM lineitem GROUP BY 1, 2"""),
    "bars": (("prices",), """
        SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS bar_no FROM prices"""),
    "bench": ((), f"""
        SELECT cast(l_shipdate AS date) AS date, {_close} AS close FROM lineitem GROUP BY 1"""),
    "regional_bench": ((), f"""
        SELECT n_regionkey AS regionkey, cast(l_shipdate AS date) AS date, {_close} AS close
        FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
        JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2"""),
    "monthly": (("prices",), """
        SELECT ticker, cast(date_trunc('month', date) AS date) AS month, max_by(close, date) AS close
        FROM prices GROUP BY 1, 2"""),
    "mret": (("monthly",), """
        SELECT ticker, month, close / lag(close) OVER (PARTITION BY ticker ORDER BY month) - 1 AS ret
        FROM monthly"""),
    "dims": ((), f"""
        SELECT s_suppkey AS ticker, {sql_case('s_suppkey % 5', TIER_OF_SUPPLIER)} AS tier,
               {sql_case('n_regionkey', REGION_OF)} AS region, n_name AS sector, n_regionkey AS regionkey
        FROM supplier JOIN nation ON n_nationkey = s_nationkey"""),
    "signals": ((), """
        SELECT ticker, date, CASE o_orderstatus WHEN 'F' THEN 'B' WHEN 'O' THEN 'H' ELSE 'S' END AS signal,
               okey % 101 AS conviction, okey, custkey
        FROM (SELECT l_suppkey AS ticker, cast(o_orderdate AS date) AS date, o_orderkey AS okey,
                     o_orderstatus, o_custkey AS custkey,
                     row_number() OVER (PARTITION BY l_suppkey, cast(o_orderdate AS date)
                                        ORDER BY o_orderkey DESC) AS rn
              FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)
              JOIN orders ON o_orderkey = l_orderkey)
        WHERE rn = 1"""),
    "priced": (("signals", "prices"), """
        SELECT s.*, p.close AS asof_close, CASE WHEN okey % 10 = 0 THEN NULL ELSE p.close END AS logged_price
        FROM signals s ASOF LEFT JOIN prices p ON s.ticker = p.ticker AND s.date >= p.date"""),
    "log": ((), f"""
        SELECT user_id AS ticker, ts, cast(ts AS date) AS date,
               {sql_case('event_type', EVENT_SIGNAL, quote=True)} AS signal, value,
               cast(json_extract_string(props, '$.k') AS bigint) AS score, event_id
        FROM events"""),
    "daily_log": (("log",), """
        SELECT ticker, date, max_by(signal, ts) AS signal, max_by(value, ts) AS value,
               max_by(score, ts) AS score FROM log GROUP BY 1, 2"""),
    "universe": ((), "SELECT " + ", ".join(f"{e} AS {n}" for n, e in UNIVERSE) + " FROM part"),
    "portfolio": (("universe",), f"""
        SELECT ticker, k, cap, cap_value, upside, buy_pct, beta, sector, price,
               (k * 17 % 23 + 1) * 100.0 / sum(k * 17 % 23 + 1) OVER () AS pct
        FROM universe WHERE k % {PORTFOLIO_MOD} = 0"""),
    "no_trade": (("universe",), f"SELECT ticker FROM universe WHERE k % {NO_TRADE_MOD} = 0"),
    "holders": ((), """
        SELECT o_custkey AS investor, cast(date_trunc('month', o_orderdate) AS date) AS month,
               l_suppkey AS ticker,
               cast(sum(cast(l_extendedprice as decimal(18,2))) as double) AS spend
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2, 3"""),
    "census": (("holders",), """
        SELECT month AS date, ticker, count(DISTINCT investor) AS holders, sum(spend) AS spend
        FROM holders GROUP BY 1, 2"""),
    "fwd": (("bars", "bench", "priced"), """
        SELECT s.ticker, s.date, s.signal, s.conviction, s.okey, h.h AS horizon, s.asof_close AS price,
               f.close AS future_price, f.date AS future_date,
               (f.close - s.asof_close) / s.asof_close * 100 AS ret,
               (f.close - s.asof_close) / s.asof_close * 100
                 - (bf.close - bb.close) / bb.close * 100 AS alpha,
               (bf.close - bb.close) / bb.close * 100 AS bench_ret
        FROM (SELECT p.*, b.bar_no AS base FROM priced p
              ASOF JOIN bars b ON p.ticker = b.ticker AND p.date <= b.date) s
        CROSS JOIN (VALUES (7), (30), (60), (90), (180), (250)) h(h)
        JOIN bars f ON f.ticker = s.ticker AND f.bar_no = s.base + h.h
        LEFT JOIN (SELECT d.date AS d0, b.* FROM (SELECT DISTINCT date FROM signals) d
                   ASOF JOIN (SELECT *, row_number() OVER (ORDER BY date) AS n FROM bench) b
                   ON d.date <= b.date) bb ON bb.d0 = s.date
        LEFT JOIN (SELECT *, row_number() OVER (ORDER BY date) AS n FROM bench) bf ON bf.n = bb.n + h.h
        WHERE s.asof_close > 0"""),
    "fwd_dims": (("fwd", "dims"), """
        SELECT f.*, d.tier, d.region, d.sector FROM fwd f JOIN dims d ON d.ticker = f.ticker"""),
    "market": ((), f"""
        SELECT cast(l_shipdate AS date) AS date, {_close} AS spy,
               10 + 400 * (cast(sum(cast(l_discount as decimal(18,2))) as double) / count(*)) AS vix,
               10 + 500 * (cast(sum(cast(l_tax as decimal(18,2))) as double) / count(*)) AS vix3m
        FROM lineitem GROUP BY 1"""),
    "reviews": (("signals",), "SELECT " + ", ".join(f"{e} AS {n}" for n, e in REVIEW) + " FROM signals"),
    "waterfall": (("reviews",), " UNION ALL ".join(
        f"SELECT ticker, date, okey, '{n}' AS name, cast({e} as bigint) AS points FROM reviews" for n, e in WATERFALL)),
    "panel": ((), """
        SELECT label AS date, vec_id AS name, embedding FROM embeddings"""),
}


def _order(names, seen):
    for n in names:
        deps, _ = CTES[n]
        _order(deps, seen)
        if n not in seen:
            seen.append(n)
    return seen


def with_clause(names, sql: str) -> str:
    """Put the named lens CTEs (dependencies first) before ``sql``; CTEs of its own may start with RECURSIVE."""
    body = sql.strip()
    kind = "WITH "
    if body.startswith("RECURSIVE "):
        kind, body = "WITH RECURSIVE ", body.removeprefix("RECURSIVE ").strip()
    parts = [f"{n} AS ({CTES[n][1].strip()})" for n in _order(names, [])]
    starts_plain = body[:6].upper() == "SELECT"
    if not parts and starts_plain:
        return body
    sep = "\n" if starts_plain else (",\n" if parts else "")
    return kind + ",\n".join(parts) + sep + body
