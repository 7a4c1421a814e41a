"""SQL twins of ``strata.plans.fixtures`` for the DuckDB oracle.

``with_ctes(["position"], body)`` prepends the named relations and everything
they depend on as CTEs, in dependency order.
"""

from __future__ import annotations

from strata.plans.fixtures import (CAPACITY, CUSTOMER_TYPES, EVENT_CODES, EXPORT_TYPES, RUN_LAGS, STATUS_CODES,
                                   UNKNOWN_EXPORT_TYPES)

AS_OF = "DATE '2001-08-01'"


def _values(rows) -> str:
    def lit(v):
        return f"'{v}'" if isinstance(v, str) else repr(v)
    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


CTE = {
    "runs": ([], f"""runs AS (
  SELECT l.run, CAST(d.d - l.lag AS DATE) AS date, CAST(d.d + 2 AS DATE) AS run_day
  FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) d
  CROSS JOIN (VALUES {_values(RUN_LAGS)}) l(run, lag))"""),
    "intervals": (["runs"], f"""tops AS (
  SELECT run, max(date) AS max_date, max(run_day) AS run_day FROM runs WHERE date_diff('day', {AS_OF}, run_day) < 2 GROUP BY run),
intervals AS (
  -- a run begins where the next smaller top ends, the smallest on a fixed day
  SELECT run, coalesce((SELECT max(o.max_date) + 1 FROM tops o WHERE row(o.max_date, o.run) < row(t.max_date, t.run))::DATE, DATE '1900-01-01') AS min_date,
         max_date, (run_day - 1)::DATE AS run_date
  FROM tops t)"""),
    "periods": ([], """periods AS (
  SELECT o_orderkey AS pk, o_custkey AS id, CAST(o_orderdate AS DATE) AS start_date,
         o_orderstatus AS status, o_orderpriority AS priority,
         LEAD(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey
              ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS end_date
  FROM orders)"""),
    "rule_periods": (["periods"], """rule_periods AS (
  SELECT *,
         CASE WHEN pk % 9 = 0 THEN CAST(start_date + CAST(pk % 500 AS INTEGER) AS DATE) END AS disc_date,
         CASE WHEN pk % 4 = 1 THEN 'D' ELSE 'E' END AS energ,
         CASE WHEN pk % 4 = 1 THEN CAST(start_date + CAST(pk % 300 AS INTEGER) AS DATE) END AS deenerg_date
  FROM periods)"""),
    "reads": ([], """reads AS (
  SELECT o_custkey AS id, l_shipdate AS ts, l_returnflag AS code,
         CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_linestatus END AS note,
         l_orderkey, l_linenumber
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""),
    "checkpoints": ([], """checkpoints AS (
  SELECT o_custkey AS id, MAX(CAST(o_orderdate AS DATE)) AS cp_date
  FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey)"""),
    "contracts": ([], """contracts AS (
  SELECT o_custkey AS id, MAX(CAST(o_orderdate AS DATE)) AS contract_end
  FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY o_custkey)"""),
    "position": (["periods", "intervals"], """picked AS (
  SELECT id, pk, start_date, end_date FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY md5(CAST(pk AS VARCHAR)), pk) AS rn
    FROM periods) x WHERE rn = 1),
position AS (
  SELECT c_custkey AS id,
         CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_mktsegment END AS name,
         CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE CAST(n_regionkey AS VARCHAR) END AS meter_type,
         n_name AS area, c_acctbal AS value, p.pk, p.start_date, p.end_date, i.run
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  JOIN picked p ON p.id = c_custkey
  LEFT JOIN intervals i ON p.start_date BETWEEN i.min_date AND i.max_date)"""),
    "cases": ([], """cases AS (
  SELECT o_orderkey AS id,
         CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'agent' || CAST(o_custkey % 7 AS VARCHAR) END AS owner,
         o_orderpriority AS team,
         CASE WHEN o_orderstatus = 'F' THEN 'Closed' ELSE 'Open' END AS status,
         CASE WHEN o_orderkey % 4 = 0 THEN 'LoneCase' WHEN o_orderkey % 4 = 2 THEN 'ParentCase'
              ELSE 'ChildCase' END AS kind,
         CASE WHEN o_orderkey % 4 IN (1, 3) THEN o_orderkey - o_orderkey % 4 + 2 END AS parent_id,
         CASE WHEN o_orderkey % 11 = 0 THEN 'Complex query' ELSE 'Routine query' END AS subject
  FROM orders)"""),
    "capacity": ([], f"""capacity AS (
  SELECT * FROM (VALUES {_values(CAPACITY)}) v(owner, hours))"""),
    "status_codes": ([], f"""status_codes AS (
  SELECT * FROM (VALUES {_values(STATUS_CODES)}) v(code, description))"""),
    "profit": ([], """profit AS (
  SELECT p_partkey AS id,
         CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))))
              - CAST(p_retailprice AS DECIMAL(18,2)) * SUM(CAST(l_quantity AS DECIMAL(18,2)))
              AS DOUBLE) AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey
  GROUP BY p_partkey, p_retailprice)"""),
    "events_described": (["reads"], f"""events_described AS (
  SELECT DISTINCT r.*, e.description, if(r.code = 'N', 'Non-Auditable', 'Auditable') AS audit_status
  FROM reads r JOIN (VALUES {_values(EVENT_CODES)}) e(code, description) USING (code))"""),
    "lookups": ([], f"""details AS (
  SELECT o_orderkey AS pk, 'Brand#' || (o_orderkey % 25 + 1) AS distributor, o_custkey % 10 + 1 AS line_class,
         if(o_custkey % 10 = 0, 'n/a', c_nationkey::VARCHAR) AS profile_class, c_mktsegment AS config_id, n_name AS area,
         'Z' || c_nationkey || ' ' || (o_custkey % 90 + 10) AS postcode, o_orderpriority[1] AS service_flag
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
exports AS (
  SELECT p_brand AS participant, p_size % 10 + 1 AS class_id, arg_min(row(if(p_type IN {UNKNOWN_EXPORT_TYPES + ('',)}, NULL, p_type IN {EXPORT_TYPES + ('',)})), p_partkey)[1] AS export_indicator
  FROM part GROUP BY p_brand, p_size % 10),
meters AS (
  SELECT l_orderkey AS link, max(row(l_shipdate, l_linenumber, l_returnflag))[3] AS meter_type FROM lineitem GROUP BY l_orderkey),
handlers AS (
  SELECT n_name AS area, max(row(s_acctbal, s_suppkey, s_name))[3] AS handler FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY n_name),
holders AS (
  SELECT c_custkey AS id, coalesce((MAP {CUSTOMER_TYPES})[c_mktsegment], 'Domestic') AS customer_type,
         nullif(if(c_custkey % 17 = 0, '', n_name), '') AS customer_name, c_name AS customer_number,
         array_to_string(list_filter([c_name, if(c_custkey % 7 > 0, c_mktsegment, ''), if(c_custkey % 5 > 0, n_name, ''), r_name], lambda x: x <> ''), ', ') AS address
  FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
own_volumes AS (
  SELECT o_custkey AS id, sum(l_extendedprice::DECIMAL(18,2)) AS v FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  WHERE l_returnflag = 'R' AND l_shipdate >= TIMESTAMP '2000-01-01 00:00:00' GROUP BY o_custkey),
cents AS (
  SELECT c_nationkey, c_mktsegment, sum((c_acctbal::DECIMAL(18,2) * 100)::BIGINT)::BIGINT AS s, count(*) AS n FROM customer GROUP BY ALL),
default_volumes AS (
  -- half a cent goes away from zero
  SELECT c_nationkey::VARCHAR AS profile_class, c_mktsegment AS config_id, (sign(s) * ((2 * abs(s) + n) // (2 * n)))::DOUBLE / 100 AS v FROM cents)"""),
    "messages": ([], """messages AS (
  SELECT conv_id AS id, turn, text FROM conversations)"""),
}


def with_ctes(names, body: str, extra: list[str] | None = None) -> str:
    """``WITH <fixtures + extra CTEs> <body>``."""
    order: list[str] = []

    def visit(n):
        deps, _ = CTE[n]
        for d in deps:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    parts = [CTE[n][1] for n in order] + list(extra or [])
    if not parts:
        return body
    return "WITH " + ",\n".join(parts) + "\n" + body
