"""The same domain tables as DuckDB common table expressions, for the SQL that queries are held against."""

_PANEL = """
panel AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS instrument_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS business_date,
         avg(l_discount) - 0.05 AS price_return, avg(l_tax) / 100 AS gross_dividend, 0.85 * (avg(l_tax) / 100) AS net_dividend,
         sum(l_extendedprice) AS market_cap, avg(l_quantity) AS quantity,
         sum(l_extendedprice * l_discount) / sum(l_extendedprice) AS margin
  FROM lineitem GROUP BY 1, 2)"""
_INSTRUMENTS = """
instruments AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS instrument_id, n_name AS country, r_name AS industry, s_acctbal AS account_balance
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
_CONSTITUENTS = """
tilted AS (
  SELECT *, market_cap * CASE WHEN quantity >= 25 THEN 0.5 + 10 * margin ELSE 0.0 END AS t FROM panel WHERE month(business_date) = 12),
constituents AS (
  SELECT CAST(business_date + INTERVAL 1 MONTH AS DATE) AS effective_date, business_date AS reference_date, t.instrument_id, market_cap, margin AS quality, quantity,
         market_cap / sum(market_cap) OVER (PARTITION BY business_date) AS benchmark_weight, t / sum(t) OVER (PARTITION BY business_date) AS index_weight,
         country, industry, account_balance
  FROM tilted t JOIN instruments USING (instrument_id))"""
_SERIES = "\nseries AS (SELECT business_date, " + ", ".join(
    f"sum({w} * (price_return + {d})) / sum({w}) AS {n}_{k}_return"
    for n, w in (("index", "market_cap * quantity"), ("benchmark", "market_cap"))
    for k, d in (("price", "0.0"), ("gross_total", "gross_dividend"), ("net_total", "net_dividend"))
) + " FROM panel GROUP BY business_date)"
_BRANDS = """
brands AS (SELECT p_brand AS series, CAST(date_trunc('month', l_shipdate) AS DATE) AS business_date, avg(l_discount) - 0.05 AS ret
           FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
_EVENTS = """
event_dates AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS event_date FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 450000)"""
_REGIMES = """
urgent AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS business_date, count(*) FILTER (o_orderpriority = '1-URGENT') AS n FROM orders GROUP BY 1),
moves AS (SELECT business_date, lag(n, 1) OVER (ORDER BY business_date) > lag(n, 2) OVER (ORDER BY business_date) AS up FROM urgent),
regimes AS (SELECT business_date, CASE WHEN up THEN 'expansion' ELSE 'contraction' END AS regime FROM moves WHERE up IS NOT NULL)"""

_NEEDS = {
    "panel": [_PANEL], "instruments": [_INSTRUMENTS], "constituents": [_PANEL, _INSTRUMENTS, _CONSTITUENTS],
    "series": [_PANEL, _SERIES], "brands": [_BRANDS], "event_dates": [_EVENTS], "regimes": [_REGIMES],
}


def over(*views: str, then: str, dates: bool | str = True) -> str:
    """SQL that defines ``views`` and goes on with ``then``: further ``name AS (...)`` and the final SELECT.

    ``dates``: columns named ``*_date`` come out as text, as registered
    queries give them; ``"all"``: every column is one.
    """
    parts: list[str] = []
    for v in views:
        parts += [p for p in _NEEDS[v] if p not in parts]
    then = then.strip()
    recursive = "RECURSIVE " if then.startswith("WITH RECURSIVE ") else ""
    then = then.replace("WITH RECURSIVE ", "WITH ", 1) if recursive else then
    if parts:
        then = f"WITH {recursive}" + ",".join(parts) + (f", {then[5:]}" if then.startswith("WITH ") else f" {then}")
    if dates == "all":
        return f"SELECT CAST(COLUMNS(*) AS VARCHAR) FROM ({then})"
    return f"SELECT COLUMNS(lambda c: NOT suffix(c, '_date')), CAST(COLUMNS('_date$') AS VARCHAR) FROM ({then})" if dates else then
