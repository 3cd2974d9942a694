"""The snapshot of ``platter.sources.retail`` written as SQL common tables."""

MODEL = """
m_users AS (
  SELECT c_custkey AS user_id,
         'SRN' || CAST(c_custkey AS VARCHAR) AS srn,
         c_name AS name,
         CASE WHEN c_nationkey = 13 THEN 'c' || CAST(c_custkey AS VARCHAR) || '@example'
              ELSE 'c' || CAST(c_custkey AS VARCHAR) || '@example.com' END AS email,
         CASE WHEN c_mktsegment = 'FURNITURE' THEN NULL
              WHEN c_nationkey = 7 THEN '12345'
              ELSE lpad(CAST(c_custkey AS VARCHAR), 10, '0') END AS phone,
         CASE c_mktsegment WHEN 'BUILDING' THEN 'faculty' WHEN 'MACHINERY' THEN 'staff' ELSE 'student' END AS user_type,
         CAST(CAST(c_acctbal AS DECIMAL(10,2)) * 100 AS DECIMAL(10,2)) AS wallet_balance,
         TIMESTAMP '1994-01-01 00:00:00' + to_days(c_nationkey) AS created_at,
         TIMESTAMP '1994-01-01 00:00:00' + to_days(c_nationkey) AS updated_at
  FROM customer
  UNION ALL
  SELECT 1000000000000 + s_suppkey, 'SUP' || CAST(s_suppkey AS VARCHAR), s_name,
         'supplier' || CAST(s_suppkey AS VARCHAR) || '@example.com', lpad(CAST(s_suppkey AS VARCHAR), 10, '9'), 'staff',
         CAST(CAST(s_acctbal AS DECIMAL(10,2)) * 100 AS DECIMAL(10,2)),
         TIMESTAMP '1994-01-01 00:00:00' + to_days(s_nationkey), TIMESTAMP '1994-01-01 00:00:00' + to_days(s_nationkey)
  FROM supplier),
m_categories AS (
  SELECT CAST('0x' || substr(md5(p_type), 1, 15) AS BIGINT) AS category_id,
         p_type AS category_name,
         CAST(NULL AS VARCHAR) AS description,
         p_type <> 'ECONOMY' AS is_active,
         TIMESTAMP '1994-01-01 00:00:00' AS created_at
  FROM (SELECT DISTINCT p_type FROM part) kinds),
m_menu AS (
  SELECT p_partkey AS item_id,
         CAST('0x' || substr(md5(p_type), 1, 15) AS BIGINT) AS category_id,
         p_name AS item_name,
         p_brand AS description,
         CAST(p_retailprice AS DECIMAL(8,2)) AS price,
         p_size - 2 AS stock,
         (p_size > 2 AND p_brand <> 'Brand#10') AS is_available,
         p_size AS preparation_time_minutes,
         CAST(NULL AS VARCHAR) AS image_url,
         CAST(NULL AS VARCHAR) AS nutritional_info,
         TIMESTAMP '1994-06-01 00:00:00' + to_days(p_size) AS created_at,
         TIMESTAMP '1998-01-01 00:00:00' + to_days(p_size * 7) AS updated_at
  FROM part
  UNION ALL
  SELECT 1000000000000 + s_suppkey,
         CAST('0x' || substr(md5(CASE WHEN s_nationkey < 10 THEN 'SMALL' ELSE 'LARGE' END), 1, 15) AS BIGINT),
         s_name, NULL, CAST(abs(CAST(s_acctbal AS DECIMAL(10,2))) + CAST(1 AS DECIMAL(8,2)) AS DECIMAL(8,2)),
         s_nationkey - 2, s_nationkey > 4, s_nationkey + 1, NULL, NULL,
         TIMESTAMP '1994-06-01 00:00:00' + to_days(s_nationkey), TIMESTAMP '1998-01-01 00:00:00' + to_days(s_nationkey)
  FROM supplier),
m_orders AS (
  SELECT o_orderkey AS order_id,
         o_custkey AS user_id,
         CAST(o_orderdate + to_seconds(o_orderkey * 37 % 86400) AS TIMESTAMP) AS order_date,
         CAST(o_totalprice AS DECIMAL(10,2)) AS total_amount,
         CASE o_orderstatus
              WHEN 'F' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'completed' ELSE 'cancelled' END
              WHEN 'O' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'pending' ELSE 'confirmed' END
              ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'preparing' ELSE 'ready' END END AS order_status,
         CASE WHEN o_orderpriority IN ('1-URGENT', '5-LOW') THEN 'wallet'
              WHEN o_orderpriority = '2-HIGH' THEN 'cash'
              WHEN o_orderpriority = '3-MEDIUM' THEN 'upi'
              ELSE 'card' END AS payment_method,
         CASE o_orderkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' WHEN 2 THEN 'refunded'
              ELSE 'completed' END AS payment_status,
         CAST(NULL AS TIMESTAMP) AS estimated_ready_time,
         CAST(NULL AS VARCHAR) AS special_instructions,
         CAST(o_orderdate + to_seconds(o_orderkey * 37 % 86400) AS TIMESTAMP) AS created_at,
         CAST(o_orderdate + to_seconds(o_orderkey * 37 % 86400) AS TIMESTAMP) AS updated_at
  FROM orders),
m_lines AS (
  SELECT l_orderkey * 8 + l_linenumber AS order_item_id,
         l_orderkey AS order_id,
         l_partkey AS item_id,
         CAST(l_quantity AS INTEGER) AS quantity,
         CAST(CAST(CAST(CAST(l_extendedprice AS DECIMAL(10,2)) * 100 AS BIGINT) // CAST(l_quantity AS BIGINT)
              AS DECIMAL(12,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(8,2)) AS unit_price,
         CAST(l_extendedprice AS DECIMAL(10,2)) AS subtotal,
         CASE WHEN l_returnflag = 'R' THEN 'no onions' END AS special_requests
  FROM lineitem),
m_summary AS (
  SELECT o.order_id, u.name AS customer_name, u.srn, o.order_date, o.total_amount, o.order_status,
         o.payment_method, o.payment_status
  FROM m_orders o JOIN m_users u ON o.user_id = u.user_id),
m_popular AS (
  SELECT m.item_id, m.item_name, c.category_name, COUNT(*) AS order_count,
         CAST(SUM(l.quantity) AS BIGINT) AS total_quantity_sold, m.price
  FROM m_menu m JOIN m_lines l ON m.item_id = l.item_id JOIN m_categories c ON m.category_id = c.category_id
  GROUP BY m.item_id, m.item_name, c.category_name, m.price)
"""


def over_model(body: str, *extra: str, recursive: bool = False) -> str:
    """A statement over the model tables, with further common tables if given."""
    tables = ",\n".join([MODEL.strip(), *(e.strip() for e in extra)])
    return f"WITH {'RECURSIVE ' if recursive else ''}{tables}\n{body.strip()}"
