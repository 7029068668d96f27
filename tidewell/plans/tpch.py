"""Decision-support queries over the star schema.

The 22 shapes of the public TPC-H set, adapted where these tables lack a column:
another date, flag or key takes the place of the missing one, with the shape
(joins, semi and anti joins, correlated subqueries, grouping) kept. Four need
the part-supplier table, which is derived here from line items: one row per
part and supplier that occur together, with least price and total quantity.

Joins are written from the filtered side outward; sizes and broadcasts are left
to Catalyst and adaptive execution.
"""

from __future__ import annotations

from tidewell.plans.suite import suite

_TS = "[[timestamp_ntz|TIMESTAMP]]"

#: Supply relation of parts and suppliers.
PARTSUPP = """supply AS (
  SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, min(l_extendedprice / l_quantity) AS ps_cost, sum(l_quantity) AS ps_qty
  FROM lineitem GROUP BY l_partkey, l_suppkey
)"""

QUERIES = {
    "tpch_q1": f"""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
  round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
  round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
  round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= {_TS} '2001-08-02 00:00:00'
GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""",
    "tpch_q2": f"""
WITH {PARTSUPP}, offered AS (
  SELECT p_partkey, s_acctbal, s_name, n_name, ps_cost, min(ps_cost) OVER (PARTITION BY p_partkey) AS least
  FROM part JOIN supply ON p_partkey = ps_partkey JOIN supplier ON s_suppkey = ps_suppkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE p_size = 15 AND p_type LIKE 'P%' AND r_regionkey = 3
)
SELECT round(s_acctbal, 2) AS s_acctbal, s_name, n_name, p_partkey, round(ps_cost, 4) AS ps_cost FROM offered WHERE ps_cost = least
ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""",
    "tpch_q3": f"""
SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < {_TS} '1997-03-15 00:00:00' AND l_shipdate > {_TS} '1997-03-15 00:00:00'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""",
    "tpch_q4": f"""
SELECT o_orderpriority, count(*) AS order_count FROM orders
WHERE o_orderdate >= {_TS} '1997-07-01 00:00:00' AND o_orderdate < {_TS} '1997-10-01 00:00:00'
  AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL '60' DAY)
GROUP BY o_orderpriority ORDER BY o_orderpriority""",
    "tpch_q5": f"""
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey
  JOIN lineitem ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey AND c_nationkey = s_nationkey
WHERE r_regionkey = 2 AND o_orderdate >= {_TS} '1996-01-01 00:00:00' AND o_orderdate < {_TS} '1998-01-01 00:00:00'
GROUP BY n_name ORDER BY revenue DESC, n_name""",
    "tpch_q6": f"""
SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem
WHERE l_shipdate >= {_TS} '1996-01-01 00:00:00' AND l_shipdate < {_TS} '1997-01-01 00:00:00' AND l_discount BETWEEN 0.0499 AND 0.0701 AND l_quantity < 24""",
    "tpch_q7": f"""
SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(year(l_shipdate) AS INT) AS l_year, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM supplier JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN lineitem ON s_suppkey = l_suppkey
  JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation n2 ON c_nationkey = n2.n_nationkey
WHERE (n1.n_nationkey IN (1, 2, 3) AND n2.n_nationkey IN (4, 5, 6) OR n1.n_nationkey IN (4, 5, 6) AND n2.n_nationkey IN (1, 2, 3))
  AND l_shipdate BETWEEN {_TS} '1996-01-01 00:00:00' AND {_TS} '1997-12-31 00:00:00'
GROUP BY n1.n_name, n2.n_name, CAST(year(l_shipdate) AS INT) ORDER BY supp_nation, cust_nation, l_year""",
    "tpch_q8": f"""
SELECT o_year, round(sum(CASE WHEN nation_key = 7 THEN volume ELSE 0 END) / sum(volume), 6) AS mkt_share FROM (
  SELECT CAST(year(o_orderdate) AS INT) AS o_year, l_extendedprice * (1 - l_discount) AS volume, s_nationkey AS nation_key
  FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE r_regionkey IN (1, 2) AND p_type = 'PROMO' AND o_orderdate BETWEEN {_TS} '1996-01-01 00:00:00' AND {_TS} '1999-12-31 00:00:00'
) v GROUP BY o_year ORDER BY o_year""",
    "tpch_q9": f"""
WITH {PARTSUPP}
SELECT n_name, CAST(year(o_orderdate) AS INT) AS o_year, round(sum(l_extendedprice * (1 - l_discount) - ps_cost * l_quantity), 2) AS profit
FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supply ON ps_partkey = l_partkey AND ps_suppkey = l_suppkey
  JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN nation ON s_nationkey = n_nationkey
WHERE p_brand LIKE '%1%' GROUP BY n_name, CAST(year(o_orderdate) AS INT) ORDER BY n_name, o_year DESC""",
    "tpch_q10": f"""
SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, c_acctbal, n_name
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderdate >= {_TS} '1997-10-01 00:00:00' AND o_orderdate < {_TS} '1998-01-01 00:00:00' AND l_returnflag = 'R'
GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
    "tpch_q11": f"""
WITH {PARTSUPP}, stock AS (
  SELECT ps_partkey, sum(ps_cost * ps_qty) AS worth FROM supply JOIN supplier ON ps_suppkey = s_suppkey WHERE s_nationkey IN (4, 5, 6, 7) GROUP BY ps_partkey
)
SELECT ps_partkey, round(worth, 0) AS worth FROM stock WHERE worth > (SELECT sum(worth) * 0.0005 FROM stock) ORDER BY worth DESC, ps_partkey""",
    "tpch_q12": f"""
SELECT l_returnflag, CAST(sum(CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
  CAST(sum(CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 0 ELSE 1 END) AS BIGINT) AS low_line_count
FROM orders JOIN lineitem ON o_orderkey = l_orderkey
WHERE l_returnflag IN ('A', 'R') AND l_shipdate >= {_TS} '1997-01-01 00:00:00' AND l_shipdate < {_TS} '1998-01-01 00:00:00' AND o_orderdate < l_shipdate
GROUP BY l_returnflag ORDER BY l_returnflag""",
    "tpch_q13": """
SELECT c_count, count(*) AS custdist FROM (
  SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus <> 'P' GROUP BY c_custkey
) c GROUP BY c_count ORDER BY custdist DESC, c_count DESC""",
    "tpch_q14": f"""
SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo_revenue
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= {_TS} '1997-09-01 00:00:00' AND l_shipdate < {_TS} '1997-10-01 00:00:00'""",
    "tpch_q15": f"""
WITH revenue AS (
  SELECT l_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS total FROM lineitem
  WHERE l_shipdate >= {_TS} '1997-01-01 00:00:00' AND l_shipdate < {_TS} '1997-04-01 00:00:00' GROUP BY l_suppkey
)
SELECT s_suppkey, s_name, total FROM supplier JOIN revenue ON s_suppkey = l_suppkey WHERE total = (SELECT max(total) FROM revenue) ORDER BY s_suppkey""",
    "tpch_q16": f"""
WITH {PARTSUPP}
SELECT p_brand, p_type, p_size, count(DISTINCT ps_suppkey) AS supplier_cnt FROM supply JOIN part ON p_partkey = ps_partkey
WHERE p_brand <> 'Brand#5' AND p_type NOT LIKE 'PROMO%' AND p_size IN (3, 9, 14, 19, 23, 36, 45, 49)
  AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)
GROUP BY p_brand, p_type, p_size ORDER BY supplier_cnt DESC, p_brand, p_type, p_size""",
    "tpch_q17": """
SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE p_brand = 'Brand#3' AND l_quantity < (SELECT 0.4 * avg(i.l_quantity) FROM lineitem i WHERE i.l_partkey = p_partkey)""",
    "tpch_q18": """
SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, sum(l_quantity) AS sum_qty
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 250)
GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100""",
    "tpch_q19": """
SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 5
  OR p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 10
  OR p_brand = 'Brand#4' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 15""",
    "tpch_q20": f"""
WITH {PARTSUPP}
SELECT s_name, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
WHERE n_regionkey = 3 AND s_suppkey IN (
  SELECT ps_suppkey FROM supply WHERE ps_partkey IN (SELECT p_partkey FROM part WHERE p_brand LIKE 'Brand#1%')
    AND ps_qty > (SELECT 0.5 * sum(l_quantity) FROM lineitem WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey AND l_shipdate >= {_TS} '1997-01-01 00:00:00'))
ORDER BY s_name, s_suppkey""",
    "tpch_q21": """
SELECT s_name, count(*) AS numwait FROM supplier JOIN lineitem l1 ON s_suppkey = l1.l_suppkey JOIN orders ON o_orderkey = l1.l_orderkey
WHERE o_orderstatus = 'F' AND l1.l_returnflag = 'R'
  AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
  AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R')
GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""",
    "tpch_q22": """
SELECT c_nationkey, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM customer
WHERE c_nationkey IN (1, 3, 5, 7, 9, 11, 13) AND c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0 AND c_nationkey IN (1, 3, 5, 7, 9, 11, 13))
  AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')
GROUP BY c_nationkey ORDER BY c_nationkey""",
}

_SPARK, _DUCK = suite(QUERIES)


def queries():
    return _SPARK


def oracle_sql():
    return _DUCK
