"""DuckDB oracle SQL for the registered queries (the correctness gate).

Each statement starts from the driver's tables (pre-registered DuckDB views) and builds
the same six inventory tables as ``shelfwise.sources.derived`` in SQL, then states the
report the way the reference's own SQL does: join first, then group. The as-of day is
1998-06-01 and "now" is 1998-06-01 10:00:00. Decimal outputs are compared as DOUBLE.
"""

from __future__ import annotations

AS_OF = "DATE '1998-06-01'"
NOW = "TIMESTAMP '1998-06-01 10:00:00'"

FIXTURE = f"""
products AS (
  SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category,
         CAST(p_retailprice AS DECIMAL(10,2)) AS price,
         CAST(p_size * 7 AS INTEGER) AS current_stock,
         CASE WHEN p_partkey % 50 <> 9
              THEN DATE '1997-06-01' + CAST((p_partkey * 7) % 900 AS INTEGER) - 730 END AS manufactured_date,
         CASE WHEN p_partkey % 50 <> 7
              THEN DATE '1997-06-01' + CAST((p_partkey * 7) % 900 AS INTEGER) END AS expiry_date,
         p_partkey % 50 = 9 AS manufactured_date_zero, p_partkey % 50 = 7 AS expiry_date_zero,
         p_brand AS how_to_use, p_name AS side_effects, {NOW} AS created_at, {NOW} AS updated_at,
         CAST(p_size * 2 AS INTEGER) AS reorder_level,
         CAST(p_size * 6 AS INTEGER) AS reorder_quantity
  FROM part),
b0 AS (
  SELECT l_partkey AS product_id, l_suppkey AS supp_id, CAST(l_shipdate AS DATE) AS received_date,
         CAST(SUM(l_quantity) AS INTEGER) AS original_quantity,
         CAST(MIN(l_extendedprice) AS DECIMAL(10,2)) AS purchase_price
  FROM lineitem
  WHERE l_shipdate <= TIMESTAMP '1998-06-01 00:00:00'
  GROUP BY 1, 2, 3),
b1 AS (
  SELECT *,
         CAST(CASE WHEN (product_id + supp_id) % 4 = 0 THEN 0
                   ELSE FLOOR(original_quantity * ((product_id + 2 * supp_id) % 10) / 10.0) END AS INTEGER) AS quantity,
         received_date + CAST(730 + 90 * (product_id % 5) + 30 * (supp_id % 6) AS INTEGER) AS expiry_date,
         'BTH-' || CAST(product_id AS VARCHAR) || '-' || CAST(supp_id AS VARCHAR) || '-'
                || strftime(received_date, '%Y-%m-%d') AS batch_id,
         'LOT-' || CAST(supp_id AS VARCHAR) || '-' || strftime(received_date, '%Y-%m-%d') AS batch_number
  FROM b0),
product_batches AS (
  SELECT b1.batch_id, b1.product_id, b1.batch_number, b1.quantity, b1.original_quantity,
         b1.received_date - 30 AS manufactured_date, b1.expiry_date, s.s_name AS supplier_name,
         b1.purchase_price, b1.received_date,
         CASE WHEN b1.quantity = 0 THEN 'depleted'
              WHEN b1.expiry_date < {AS_OF} THEN 'expired'
              WHEN b1.quantity <= 10 THEN 'low_stock'
              ELSE 'available' END AS status,
         b1.supp_id, FALSE AS expiry_date_zero, FALSE AS manufactured_date_zero,
         CAST(b1.received_date AS TIMESTAMP) AS created_at, {NOW} AS updated_at
  FROM b1 LEFT JOIN supplier s ON s.s_suppkey = b1.supp_id),
batch_movements AS (
  SELECT batch_id || ':restock' AS movement_id, batch_id, CAST(NULL AS VARCHAR) AS sale_item_id, 'restock' AS movement_type,
         original_quantity AS quantity, original_quantity AS remaining_quantity,
         CAST(received_date AS TIMESTAMP) AS movement_date,
         'New batch added: ' || batch_number AS notes, supp_id AS performed_by
  FROM product_batches
  UNION ALL
  SELECT batch_id || ':' || kind, batch_id, NULL, kind, quantity - original_quantity, quantity,
         CAST(received_date + 30 AS TIMESTAMP), NULL, NULL
  FROM (SELECT *, CASE (product_id + supp_id) % 3 WHEN 0 THEN 'expiry' WHEN 1 THEN 'damage'
                       ELSE 'sale' END AS kind FROM product_batches)
  WHERE quantity <> original_quantity),
sales AS (
  SELECT o_orderkey AS sale_id, o_custkey AS user_id, CAST(o_totalprice AS DECIMAL(10,2)) AS total_amount,
         CASE WHEN o_orderstatus = 'F' THEN 'gcash' ELSE 'cash' END AS payment_method,
         CAST(o_orderdate AS TIMESTAMP) AS sale_date
  FROM orders),
sale_items AS (
  SELECT CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR) || ':'
           || CAST(l_partkey AS VARCHAR) || ':' || CAST(l_suppkey AS VARCHAR) || ':'
           || strftime(CAST(l_shipdate AS DATE), '%Y-%m-%d') AS sale_item_id,
         l_orderkey AS sale_id, l_linenumber AS line_no, l_partkey AS product_id, l_suppkey AS supp_id,
         CAST(l_quantity AS INTEGER) AS quantity, CAST(l_extendedprice AS DECIMAL(10,2)) AS subtotal,
         CAST(l_extendedprice / l_quantity AS DECIMAL(10,2)) AS unit_price, CAST(l_shipdate AS TIMESTAMP) AS created_at,
         CAST(l_shipdate AS DATE) AS demand_date
  FROM lineitem),
users AS (
  SELECT c_custkey AS id, c_name AS username,
         CASE WHEN c_custkey % 10 = 0 THEN 'admin' ELSE 'staff' END AS role, 'active' AS status
  FROM customer)"""


def q(body: str, ctes: str = "") -> str:
    """WITH <six tables>[, extra CTEs] <body>."""
    extra = f",\n{ctes}" if ctes.strip() else ""
    return f"WITH {FIXTURE}{extra}\n{body}"


# Per-product stock under a rule, the reference's way: products LEFT JOIN batches, GROUP BY.
def _stock_cte(name: str, cond: str, extra_cols: str = "") -> str:
    return f"""{name} AS (
  SELECT p.product_id, p.product_name, p.category, p.price, p.current_stock, p.reorder_level,
         p.reorder_quantity, p.expiry_date, p.manufactured_date{extra_cols},
         CAST(COALESCE(SUM(CASE WHEN {cond} THEN pb.quantity ELSE 0 END), 0) AS BIGINT) AS stock
  FROM products p LEFT JOIN product_batches pb ON p.product_id = pb.product_id
  GROUP BY ALL)"""


FRESH = f"pb.status = 'available' AND pb.expiry_date > {AS_OF} AND (pb.expiry_date - {AS_OF}) > 365"
UNEXPIRED = f"pb.status = 'available' AND pb.expiry_date > {AS_OF}"
ALLOCATABLE = f"pb.status IN ('available', 'low_stock') AND pb.expiry_date > {AS_OF}"
ACTIVE360 = (f"pb.quantity > 0 AND pb.status = 'available' AND pb.expiry_date > {AS_OF} "
             f"AND (pb.expiry_date - {AS_OF}) / 30.0 >= 12")


def _catalog_sql(where: str = "", having: str = "", status: str = "") -> str:
    ctes = f"""cat0 AS (
  SELECT p.product_id, p.product_name, p.category, p.current_stock, p.price, p.expiry_date,
         p.manufactured_date, p.reorder_level, p.how_to_use, p.side_effects, p.expiry_date_zero,
         CAST(COALESCE(SUM(CASE WHEN {FRESH} THEN pb.quantity ELSE 0 END), 0) AS BIGINT) AS total_stock,
         COUNT(CASE WHEN pb.status = 'available' AND (pb.expiry_date - {AS_OF}) > 365 THEN pb.batch_id END) AS batch_count,
         MIN(CASE WHEN pb.status = 'available' AND (pb.expiry_date - {AS_OF}) > 365 THEN pb.expiry_date END) AS nearest_expiry,
         MIN(CASE WHEN pb.quantity > 0 THEN pb.expiry_date END) AS earliest,
         COUNT(CASE WHEN pb.quantity > 0 THEN 1 END) AS on_hand_batches
  FROM products p LEFT JOIN product_batches pb ON p.product_id = pb.product_id
  WHERE 1 = 1 {where}
  GROUP BY ALL
  {having}),
cat1 AS (
  SELECT *, COALESCE(nearest_expiry, expiry_date) AS sd, nearest_expiry IS NULL AND expiry_date_zero AS sz,
         earliest - 1 AS e1 FROM cat0),
cat2 AS (
  SELECT *,
    CASE WHEN sz THEN 'expired'
         WHEN sd IS NULL THEN 'fresh'
         WHEN {NOW} > CAST(sd AS TIMESTAMP) THEN 'expired'
         WHEN FLOOR((epoch(CAST(sd AS TIMESTAMP)) - epoch({NOW})) / 86400) <= 180 THEN 'expiring'
         ELSE 'fresh' END AS status,
    (year(e1) * 12 + month(e1)) - (1998 * 12 + 6) - CASE WHEN day(e1) < 1 THEN 1 ELSE 0 END AS full_months
  FROM cat1)"""
    body = f"""
SELECT product_id, product_name, category, current_stock, CAST(price AS DOUBLE) AS price, expiry_date,
       manufactured_date, how_to_use, side_effects, reorder_level, total_stock, batch_count, nearest_expiry, status,
       CASE WHEN total_stock > reorder_level THEN 'status-green'
            WHEN total_stock > 0 THEN 'status-orange' ELSE 'status-red' END AS stock_class,
       on_hand_batches,
       CASE WHEN earliest IS NULL THEN 'fresh'
            WHEN {NOW} > CAST(earliest AS TIMESTAMP) THEN 'expired'
            WHEN full_months + date_diff('day', CAST({AS_OF} + to_months(CAST(full_months AS INTEGER)) AS DATE), e1) / 30.0 < 12
              THEN 'near-expiry'
            ELSE 'fresh' END AS badge
FROM cat2 WHERE 1 = 1 {status}"""
    return q(body, ctes)


ORACLE: dict[str, str] = {}

# R-1: batches are summed up per product, then joined to it.
ORACLE["product_total_stock"] = q("""
SELECT product_id, product_name, category, CAST(price AS DOUBLE) AS price, current_stock AS legacy_stock,
       CAST(COALESCE(units, 0) AS BIGINT) AS batch_total_stock, COALESCE(active, 0) AS active_batches,
       nearest AS nearest_expiry, COALESCE(zero, FALSE) AS nearest_expiry_zero, reorder_level, reorder_quantity
FROM products LEFT JOIN per_product USING (product_id)""", f"""per_product AS (
  SELECT product_id, SUM(quantity) FILTER (WHERE expiry_date > {AS_OF}) AS units, COUNT(*) AS active,
         MIN(expiry_date) AS nearest, BOOL_OR(expiry_date_zero) AS zero
  FROM product_batches WHERE status = 'available' GROUP BY 1)""")

# R-2: urgency is the first limit that the days left do not pass.
ORACLE["expiring_batches"] = q("""
SELECT batch_id, batch_number, product_id, product_name, category, quantity, soon.expiry_date,
       soon.expiry_date_zero, supplier_name, days AS days_until_expiry,
       (SELECT label FROM (VALUES (-1, 'EXPIRED'), (7, 'CRITICAL'), (30, 'URGENT'), (90, 'WARNING')) limits(top, label)
        WHERE days <= top ORDER BY top LIMIT 1) AS urgency_level
FROM soon JOIN products USING (product_id)""", f"""soon AS (
  SELECT *, CAST(expiry_date - {AS_OF} AS INTEGER) AS days FROM product_batches
  WHERE quantity > 0 AND status <> 'depleted' AND expiry_date <= {AS_OF} + 90)""")

# R-3
ORACLE["reorder_list"] = q(f"""
SELECT product_id, product_name, category, stock AS current_stock, reorder_level, reorder_quantity,
       CAST(reorder_quantity - stock AS BIGINT) AS quantity_needed
FROM s WHERE stock <= reorder_level""", _stock_cte("s", UNEXPIRED))

# R-4
ORACLE["available_stock"] = q("""
SELECT product_id, stock AS available FROM s""", _stock_cte("s", ALLOCATABLE))

ORACLE["available_stock_sql"] = ORACLE["available_stock"]     # the same figures through the SQL function

# R-5 + R-6
ORACLE["inventory_kpis"] = q(f"""
SELECT *,
       CASE WHEN to_dispose > 0 OR out_of_stock > 0 THEN 'Critical'
            WHEN expiring_soon > 0 OR low_stock > 0 THEN 'Warning' ELSE 'Good' END AS inventory_status,
       CASE WHEN to_dispose > 0 OR out_of_stock > 0 THEN 'red'
            WHEN expiring_soon > 0 OR low_stock > 0 THEN 'orange' ELSE 'green' END AS inventory_colour
FROM (SELECT
  (SELECT COUNT(*) FROM s WHERE stock < reorder_level) AS needs_reorder,
  (SELECT COUNT(*) FROM s WHERE stock = 0) AS out_of_stock,
  (SELECT COUNT(*) FROM s WHERE stock BETWEEN 1 AND 50) AS low_stock,
  (SELECT COUNT(*) FROM product_batches WHERE quantity > 0
     AND (expiry_date < {AS_OF} OR expiry_date - {AS_OF} <= 365)) AS to_dispose,
  (SELECT COUNT(DISTINCT product_id) FROM product_batches WHERE quantity > 0
     AND expiry_date - {AS_OF} BETWEEN 365 AND 545) AS expiring_soon)""", _stock_cte("s", FRESH))

# R-7, R-8
_REPURCHASE = """
SELECT product_id, product_name, category, reorder_level, reorder_quantity, stock AS current_stock,
       CAST(reorder_quantity - stock AS BIGINT) AS stocks_needed,
       CASE WHEN stock = 0 THEN 'red' ELSE 'orange' END AS colour
FROM s WHERE stock <= reorder_level AND reorder_quantity - stock > 0 {extra}"""
ORACLE["repurchase_list"] = q(_REPURCHASE.format(extra=""), _stock_cte("s", FRESH))
ORACLE["repurchase_search"] = q(
    _REPURCHASE.format(extra="AND (product_name ILIKE '%blue%' OR category ILIKE '%blue%')"),
    _stock_cte("s", FRESH))
ORACLE["repurchase_totals"] = q(f"""
SELECT COUNT(*) AS total_items, CAST(COALESCE(SUM(stocks_needed), 0) AS BIGINT) AS total_units_needed
FROM ({_REPURCHASE.format(extra="")})""", _stock_cte("s", FRESH))

ORACLE["report_files"] = q(f"""
SELECT row_number() OVER (ORDER BY stocks_needed DESC, product_id) AS position, product_id, stocks_needed
FROM ({_REPURCHASE.format(extra="")})""", _stock_cte("s", FRESH))
ORACLE["search_accents"] = q("""
SELECT product_id, product_name, category
FROM (SELECT product_id, CASE WHEN product_id % 2 = 0 THEN translate(product_name, 'aeiouAEIOU', 'áéïôùÂÈÍÖÛ') ELSE product_name END
               AS product_name,
             CASE WHEN product_id % 2 = 0 THEN translate(category, 'aeiouAEIOU', 'áéïôùÂÈÍÖÛ') ELSE category END AS category
      FROM products)
WHERE (strip_accents(lower(product_name)) LIKE '%bl_e%' OR strip_accents(lower(category)) LIKE '%bl_e%')
  AND strip_accents(lower(category)) = 'promo'""")
ORACLE["text_dates"] = q("""
SELECT product_id, CASE WHEN product_id % 11 <> 0 AND product_id % 17 <> 0 AND product_id % 19 <> 0 THEN expiry_date END AS expiry_date,
       expiry_date_zero,
       CASE WHEN expiry_date_zero THEN NULL
            WHEN product_id % 11 = 0 THEN 'expiry_date: ' || strftime(expiry_date, '%d/%m/%Y')
            WHEN product_id % 17 = 0 THEN 'expiry_date: 1998-02-30' END AS reject_reason
FROM products""")

# R-9 with each filter, R-10
ORACLE["catalog_all"] = _catalog_sql()
ORACLE["catalog_search"] = _catalog_sql(
    where="AND (p.product_name ILIKE '%blue%' OR p.category ILIKE '%blue%')")
ORACLE["catalog_category"] = _catalog_sql(where="AND p.category = 'PROMO'")
ORACLE["catalog_good"] = _catalog_sql(having="HAVING total_stock > 50")
ORACLE["catalog_low"] = _catalog_sql(having="HAVING total_stock BETWEEN 1 AND 50")
ORACLE["catalog_out"] = _catalog_sql(having="HAVING total_stock = 0")
ORACLE["catalog_expiring"] = _catalog_sql(status="AND status = 'expiring'")
ORACLE["catalog_expired"] = _catalog_sql(status="AND status = 'expired'")
ORACLE["stock_listing"] = (
    "SELECT *, COALESCE(strftime(nearest_expiry, '%b %d, %Y'), 'N/A') AS next_expiry, "
    "printf('PRD-%03d', product_id) AS product_code FROM ("
    + _catalog_sql() + ")")

# R-11
ORACLE["batch_drilldown"] = q(f"""
SELECT b.batch_id, b.batch_number, b.product_id, b.quantity, b.expiry_date, b.expiry_date_zero, b.status,
       b.manufactured_date, b.supplier_name, CAST(b.expiry_date - {AS_OF} AS INTEGER) AS days_left,
       COALESCE(iu.rn = 1, FALSE) AS in_use,
       CASE WHEN b.expiry_date - {AS_OF} < 0 THEN 'Expired'
            WHEN (b.expiry_date - {AS_OF}) / 30.0 < 12 THEN 'Near Expiry'
            WHEN iu.rn = 1 THEN 'In Use' ELSE 'Available' END AS card_status,
       (b.expiry_date - {AS_OF}) < 360 AS disposable
FROM product_batches b
LEFT JOIN (SELECT batch_id, ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY expiry_date, batch_id) AS rn
           FROM product_batches WHERE quantity > 0 AND expiry_date - {AS_OF} >= 360) iu
  ON iu.batch_id = b.batch_id AND iu.rn = 1
WHERE b.quantity > 0""")

# R-12
ORACLE["drilldown_totals"] = q(f"""
SELECT p.product_id,
       CAST(COALESCE(SUM(CASE WHEN {ACTIVE360} THEN pb.quantity ELSE 0 END), 0) AS BIGINT) AS total_stock,
       COUNT(CASE WHEN {ACTIVE360} THEN 1 END) AS active_count,
       CASE WHEN COALESCE(SUM(CASE WHEN {ACTIVE360} THEN pb.quantity ELSE 0 END), 0) > 200 THEN 'Good Stock'
            WHEN COALESCE(SUM(CASE WHEN {ACTIVE360} THEN pb.quantity ELSE 0 END), 0) >= 50 THEN 'Low in Stock'
            ELSE 'Critical Stock' END AS label
FROM products p LEFT JOIN product_batches pb ON p.product_id = pb.product_id
GROUP BY p.product_id""")

# R-16
ORACLE["batch_counts"] = q("""
SELECT p.product_id, COUNT(pb.batch_id) AS batch_count
FROM products p LEFT JOIN product_batches pb ON p.product_id = pb.product_id
GROUP BY p.product_id""")

# R-13
_DAY = "sale_date >= TIMESTAMP '1998-06-01 00:00:00' AND sale_date < TIMESTAMP '1998-06-02 00:00:00'"
ORACLE["sales_today"] = q(f"""
SELECT CAST(COALESCE(SUM(total_amount), 0) AS DOUBLE) AS total_sales, COUNT(*) AS sales_count,
       '₱' || format('{{:,.2f}}', COALESCE(SUM(total_amount), 0)) AS total_sales_text
FROM sales WHERE {_DAY}""")

# R-14
ORACLE["sales_history"] = q(f"""
SELECT s.sale_id, s.sale_date, CAST(s.total_amount AS DOUBLE) AS total_amount, s.payment_method,
       COUNT(si.sale_item_id) AS item_count, printf('TXN-%03d', s.sale_id) AS txn_id,
       strftime(s.sale_date, '%I:%M %p') AS time_text,
       '₱' || format('{{:,.2f}}', s.total_amount) AS amount_text,
       upper(substr(s.payment_method, 1, 1)) || substr(s.payment_method, 2) AS payment_label
FROM sales s LEFT JOIN sale_items si ON s.sale_id = si.sale_id
WHERE s.{_DAY}
GROUP BY s.sale_id, s.sale_date, s.total_amount, s.payment_method
ORDER BY s.sale_date DESC, s.sale_id DESC LIMIT 10""")

# C-20
ORACLE["sales_by_daypart"] = q(f"""
SELECT CASE WHEN hour(sale_date) BETWEEN 5 AND 11 THEN 'morning'
            WHEN hour(sale_date) BETWEEN 12 AND 17 THEN 'afternoon' ELSE 'evening' END AS daypart,
       COUNT(*) AS sales_count, CAST(SUM(total_amount) AS DOUBLE) AS total_amount
FROM sales WHERE sale_date <= {NOW} GROUP BY 1""")

# R-15: one CTE a branch; items are counted before the join, labels come from a small table.
ORACLE["activity_feed"] = q(f"""
SELECT f.* EXCLUDE (key, seconds), acts.action,
       CASE WHEN seconds < 3600 THEN CAST(seconds // 60 AS VARCHAR) || ' mins ago'
            WHEN seconds < 86400 THEN CAST(seconds // 3600 AS VARCHAR) || ' hrs ago'
            ELSE CAST(seconds // 86400 AS VARCHAR) || ' days ago' END AS time_ago,
       CASE WHEN sale_id IS NULL AND COALESCE(username, '') = '' THEN 'admin' ELSE username END AS "user",
       ABS(quantity) AS abs_quantity, '₱' || format('{{:,.2f}}', total_amount) AS amount_text,
       upper(payment_method[1]) || payment_method[2:] AS payment_label
FROM (SELECT *, CAST(epoch({NOW}) - epoch(movement_date) AS BIGINT) AS seconds
      FROM (FROM moved UNION ALL BY NAME FROM sold)
      ORDER BY movement_date DESC, activity_type, key, sale_id LIMIT 4) f
JOIN (VALUES ('restock', 'Updated Stock'), ('expiry', 'Disposed Expired Batch'),
             ('damage', 'Disposed Damaged Batch'), ('sale', 'Processed Sale')) acts(kind, action)
  ON acts.kind = COALESCE(f.movement_type, 'sale')""", f"""moved AS (
  SELECT 'batch' AS activity_type, movement_type, m.quantity, movement_date, m.notes, product_name, category,
         batch_number, username, movement_id AS key
  FROM (FROM batch_movements WHERE movement_type IN ('restock', 'expiry', 'damage') AND movement_date <= {NOW}) m
  JOIN (SELECT batch_id, batch_number, product_id FROM product_batches) USING (batch_id)
  JOIN (SELECT product_id, product_name, category FROM products) USING (product_id)
  LEFT JOIN users ON id = performed_by),
items AS (SELECT sale_id, COUNT(*) AS items_count FROM sale_items GROUP BY 1),
sold AS (
  SELECT 'sale' AS activity_type, sale_date AS movement_date, username, sale_id,
         CAST(total_amount AS DOUBLE) AS total_amount, items_count, payment_method
  FROM sales JOIN items USING (sale_id) JOIN users ON id = user_id WHERE sale_date <= {NOW})""")

# M-2: supply and demand intervals, then the interval-overlap join.
_FEFO_CTES = f"""sup AS (
  SELECT product_id, batch_id, quantity AS s_qty,
         SUM(quantity) OVER (PARTITION BY product_id ORDER BY expiry_date, received_date, batch_id
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s_hi
  FROM product_batches
  WHERE status IN ('available', 'low_stock') AND expiry_date > {AS_OF} AND quantity > 0),
tags AS (
  SELECT sale_id, product_id, sale_item_id AS tag_item FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY sale_id, product_id ORDER BY line_no DESC, sale_item_id DESC) AS rn
    FROM sale_items) WHERE rn = 1),
lines AS (
  SELECT si.*, t.tag_item FROM sale_items si LEFT JOIN tags t USING (sale_id, product_id))"""


def _fefo_alloc(lines_rel: str) -> str:
    return f"""dem AS (
  SELECT *, SUM(quantity) OVER (PARTITION BY product_id ORDER BY demand_date, sale_id, line_no, supp_id, sale_item_id
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS d_hi
  FROM {lines_rel} WHERE quantity > 0),
alloc AS (
  SELECT d.product_id, d.sale_item_id, d.sale_id, d.tag_item, CAST(NULL AS BIGINT) AS user_id, s.batch_id,
         CAST(LEAST(s.s_hi, d.d_hi) - GREATEST(s.s_hi - s.s_qty, d.d_hi - d.quantity) AS INTEGER) AS taken,
         CAST(s.s_hi - LEAST(s.s_hi, d.d_hi) AS INTEGER) AS remaining_after
  FROM dem d JOIN sup s
    ON s.product_id = d.product_id AND s.s_hi - s.s_qty < d.d_hi AND d.d_hi - d.quantity < s.s_hi)"""


ORACLE["fefo_allocations"] = q("SELECT * FROM alloc", _FEFO_CTES + ",\n" + _fefo_alloc("lines"))
ORACLE["fefo_batches_after"] = q(f"""
SELECT b.batch_id, b.product_id, CAST(b.quantity - COALESCE(t.taken, 0) AS INTEGER) AS quantity,
       CASE WHEN t.taken IS NULL THEN b.status
            WHEN b.quantity - t.taken = 0 THEN 'depleted'
            WHEN b.expiry_date < {AS_OF} THEN 'expired'
            WHEN b.quantity - t.taken <= 10 THEN 'low_stock' ELSE 'available' END AS status
FROM product_batches b LEFT JOIN (SELECT batch_id, SUM(taken) AS taken FROM alloc GROUP BY 1) t
  ON t.batch_id = b.batch_id""", _FEFO_CTES + ",\n" + _fefo_alloc("lines"))
ORACLE["fefo_shortfalls"] = q("""
SELECT l.sale_item_id, l.sale_id, l.product_id, l.quantity AS requested,
       CAST(COALESCE(a.allocated, 0) AS BIGINT) AS allocated,
       CAST(l.quantity - COALESCE(a.allocated, 0) AS BIGINT) AS short
FROM lines l LEFT JOIN (SELECT sale_item_id, SUM(taken) AS allocated FROM alloc GROUP BY 1) a
  ON a.sale_item_id = l.sale_item_id
WHERE l.quantity - COALESCE(a.allocated, 0) > 0""", _FEFO_CTES + ",\n" + _fefo_alloc("lines"))

# M-2 strict: sequential acceptance by a recursive CTE over each product's ordered lines.
_STRICT = f"""num AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY demand_date, sale_id, line_no, supp_id, sale_item_id) AS rn
  FROM lines WHERE quantity > 0),
tot AS (SELECT product_id, CAST(SUM(s_qty) AS BIGINT) AS s_total FROM sup GROUP BY 1),
acc(product_id, rn, used, sale_item_id, accepted) AS (
  SELECT n.product_id, n.rn,
         CAST(CASE WHEN n.quantity <= COALESCE(t.s_total, 0) THEN n.quantity ELSE 0 END AS BIGINT),
         n.sale_item_id, n.quantity <= COALESCE(t.s_total, 0)
  FROM num n LEFT JOIN tot t ON t.product_id = n.product_id WHERE n.rn = 1
  UNION ALL
  SELECT n.product_id, n.rn,
         CAST(CASE WHEN a.used + n.quantity <= COALESCE(t.s_total, 0) THEN a.used + n.quantity ELSE a.used END AS BIGINT),
         n.sale_item_id, a.used + n.quantity <= COALESCE(t.s_total, 0)
  FROM acc a JOIN num n ON n.product_id = a.product_id AND n.rn = a.rn + 1
  LEFT JOIN tot t ON t.product_id = n.product_id),
accepted_lines AS (
  SELECT l.* FROM lines l JOIN acc a ON a.sale_item_id = l.sale_item_id AND a.accepted)"""
ORACLE["fefo_strict"] = ("WITH RECURSIVE " + q(
    "SELECT * FROM alloc", _FEFO_CTES + ",\n" + _STRICT + ",\n" + _fefo_alloc("accepted_lines"))[len("WITH "):])

# M-2 day by day: each product's lines one after another. A line starts after the units used so far
# and after those of batches that have expired by its day.
def _by_day(mode: str) -> str:
    takes = "n.quantity" if mode == "partial" else "CASE WHEN n.quantity <= n.total - GREATEST(a.pos, n.gone) THEN n.quantity ELSE 0 END"
    return q(f"""
SELECT n.product_id, n.sale_item_id, n.sale_id, n.tag_item, CAST(NULL AS BIGINT) AS user_id, s.batch_id,
       n.demand_date AS day,
       CAST(LEAST(s.s_hi, a.pos) - GREATEST(s.s_hi - s.s_qty, a.pos - a.took) AS INTEGER) AS taken,
       CAST(s.s_hi - LEAST(s.s_hi, a.pos) AS INTEGER) AS remaining_after
FROM acc a JOIN num n ON n.product_id = a.product_id AND n.rn = a.rn
JOIN queue s ON s.product_id = a.product_id AND s.s_hi > a.pos - a.took AND s.s_hi - s.s_qty < a.pos
WHERE a.took > 0""", _FEFO_CTES + f""",
queue AS (
  SELECT product_id, batch_id, expiry_date, quantity AS s_qty,
         SUM(quantity) OVER (PARTITION BY product_id ORDER BY expiry_date, received_date, batch_id
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s_hi
  FROM product_batches WHERE status IN ('available', 'low_stock') AND quantity > 0),
gone AS (
  SELECT l.sale_item_id, MAX(s.s_hi) AS gone FROM lines l
  JOIN queue s ON s.product_id = l.product_id AND s.expiry_date <= l.demand_date GROUP BY 1),
num AS (
  SELECT l.*, CAST(COALESCE(g.gone, 0) AS BIGINT) AS gone, CAST(COALESCE(t.total, 0) AS BIGINT) AS total,
         ROW_NUMBER() OVER (PARTITION BY l.product_id
                            ORDER BY l.demand_date, l.sale_id, l.line_no, l.supp_id, l.sale_item_id) AS rn
  FROM lines l LEFT JOIN gone g ON g.sale_item_id = l.sale_item_id
  LEFT JOIN (SELECT product_id, MAX(s_hi) AS total FROM queue GROUP BY 1) t ON t.product_id = l.product_id
  WHERE l.quantity > 0),
acc(product_id, rn, pos, took) AS (
  SELECT DISTINCT product_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM num
  UNION ALL
  SELECT n.product_id, n.rn, CAST(GREATEST(a.pos, n.gone) + {takes} AS BIGINT), CAST({takes} AS BIGINT)
  FROM acc a JOIN num n ON n.product_id = a.product_id AND n.rn = a.rn + 1)""").replace("WITH ", "WITH RECURSIVE ", 1)


ORACLE["fefo_by_day"] = _by_day("partial")
ORACLE["fefo_by_day_strict"] = _by_day("strict")

# ---- state-change jobs ---------------------------------------------------------------
_RECEIVE_REQ = f"""rq0 AS (
  SELECT l_returnflag, l_partkey, l_suppkey, CAST(l_shipdate AS DATE) AS ship,
         CAST(SUM(l_quantity) AS INTEGER) AS units, CAST(MIN(l_extendedprice) AS DECIMAL(10,2)) AS purchase_price
  FROM lineitem
  GROUP BY ALL),
rq AS (
  SELECT rq0.*, 'LOT-' || CAST(l_suppkey AS VARCHAR) || '-' || strftime(ship, '%Y-%m-%d') AS num, s.s_name
  FROM rq0 LEFT JOIN supplier s ON s.s_suppkey = rq0.l_suppkey),
req AS (
  SELECT l_returnflag || ':' || CAST(l_partkey AS VARCHAR) || ':' || num AS request_id, l_partkey AS product_id, trim(' ' || num || ' ') AS bn,
         CASE WHEN (l_partkey + l_suppkey) % 11 = 0 THEN 0 ELSE units END AS quantity,
         ship - 30 AS manufactured_date, ship + 800 AS expiry_date, trim(s_name) AS supplier_name,
         purchase_price, l_suppkey AS user_id
  FROM rq),
pre AS (
  SELECT req.*, CASE
      WHEN NOT (product_id > 0) THEN 'invalid_product_id'
      WHEN NOT (quantity > 0) THEN 'invalid_quantity'
      WHEN length(bn) = 0 THEN 'empty_batch_number'
      WHEN product_id NOT IN (SELECT product_id FROM products) THEN 'unknown_product'
      WHEN EXISTS (SELECT 1 FROM product_batches b WHERE b.product_id = req.product_id AND b.batch_number = req.bn)
        THEN 'duplicate_batch' END AS r0
  FROM req),
rec AS (
  SELECT *, CASE WHEN r0 IS NOT NULL THEN r0
                 WHEN request_id <> MIN(CASE WHEN r0 IS NULL THEN request_id END) OVER (PARTITION BY product_id, bn)
                   THEN 'duplicate_in_request' END AS reject_reason
  FROM pre)"""
ORACLE["receive_batches"] = q(f"""
SELECT CAST(product_id AS VARCHAR) || ':' || bn AS batch_id, product_id, bn AS batch_number, quantity, quantity AS original_quantity,
       {AS_OF} AS received_date, expiry_date, manufactured_date, supplier_name, 'available' AS status
FROM rec WHERE reject_reason IS NULL""", _RECEIVE_REQ)
ORACLE["receive_rejects"] = q("SELECT request_id, reject_reason FROM rec WHERE reject_reason IS NOT NULL",
                              _RECEIVE_REQ)
ORACLE["receive_stock"] = q("""
SELECT p.product_id, CAST(p.current_stock + COALESCE(a.units, 0) AS BIGINT) AS current_stock
FROM products p LEFT JOIN (SELECT product_id, SUM(quantity) AS units FROM rec WHERE reject_reason IS NULL GROUP BY 1) a
  ON a.product_id = p.product_id""", _RECEIVE_REQ)
ORACLE["state_after_receipt"] = q("""
SELECT b.batch_id, b.product_id, b.quantity, b.status, CAST(p.current_stock + COALESCE(a.units, 0) AS INTEGER) AS current_stock
FROM (SELECT batch_id, product_id, quantity, status FROM product_batches
      UNION ALL
      SELECT CAST(product_id AS VARCHAR) || ':' || bn, product_id, quantity, 'available' FROM rec WHERE reject_reason IS NULL) b
LEFT JOIN products p ON p.product_id = b.product_id
LEFT JOIN (SELECT product_id, SUM(quantity) AS units FROM rec WHERE reject_reason IS NULL GROUP BY 1) a
  ON a.product_id = b.product_id""", _RECEIVE_REQ)
ORACLE["next_batch_number"] = q("""
SELECT r.request_id, r.product_id,
       COALESCE(c.n, 0) + ROW_NUMBER() OVER (PARTITION BY r.product_id ORDER BY r.request_id) AS sequence,
       'BTH-' || CAST(r.product_id AS VARCHAR)
         || printf('%03d', COALESCE(c.n, 0) + ROW_NUMBER() OVER (PARTITION BY r.product_id ORDER BY r.request_id)) AS batch_number
FROM req r LEFT JOIN (SELECT product_id, COUNT(*) AS n FROM product_batches GROUP BY 1) c ON c.product_id = r.product_id""",
                                 _RECEIVE_REQ)

_DISPOSE_REQ = f"""dreq AS (
  SELECT 'D:' || batch_id AS request_id, batch_id,
         CASE WHEN quantity % 2 = 0 THEN 'damage' WHEN quantity % 3 = 0 THEN 'lost' END AS reason,
         CAST(NULL AS BIGINT) AS user_id
  FROM product_batches WHERE expiry_date <= DATE '1999-06-01'
  UNION ALL
  SELECT 'G:' || bid, bid, NULL, NULL FROM (
    SELECT DISTINCT 'RET-' || CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) || '-'
                    || strftime(CAST(l_shipdate AS DATE), '%Y-%m-%d') AS bid
    FROM lineitem WHERE l_returnflag = 'R')),
dfound AS (
  SELECT r.*, b.quantity AS qty, b.batch_number, b.product_id
  FROM dreq r JOIN product_batches b ON b.batch_id = r.batch_id JOIN products p ON p.product_id = b.product_id
  WHERE r.reason IS DISTINCT FROM 'lost')"""
ORACLE["dispose_batches"] = q(f"""
SELECT batch_id || ':' || COALESCE(reason, 'expiry') || ':' || request_id AS movement_id, batch_id,
       COALESCE(reason, 'expiry') AS movement_type, -qty AS quantity, 0 AS remaining_quantity,
       {NOW} AS movement_date, 'Batch disposed: ' || batch_number AS notes, user_id AS performed_by
FROM dfound WHERE qty > 0""", _DISPOSE_REQ)
ORACLE["dispose_replay"] = q(f"""
SELECT batch_id || ':' || COALESCE(reason, 'expiry') || ':' || request_id AS movement_id, batch_id,
       COALESCE(reason, 'expiry') AS movement_type, -qty AS quantity, 0 AS remaining_quantity,
       {NOW} AS movement_date, 'Batch disposed: ' || batch_number AS notes, user_id AS performed_by
FROM (SELECT * FROM dfound UNION ALL SELECT * REPLACE ('Z' || request_id AS request_id, 0 AS qty) FROM dfound)""",
                             _DISPOSE_REQ)
ORACLE["dispose_rejects"] = q("""
SELECT request_id, 'invalid_reason' AS reject_reason FROM dreq WHERE reason = 'lost'
UNION ALL
SELECT request_id, 'batch_not_found' FROM dreq
WHERE reason IS DISTINCT FROM 'lost' AND request_id NOT IN (SELECT request_id FROM dfound)
UNION ALL
SELECT request_id, 'nothing_to_dispose' FROM dfound WHERE qty = 0""", _DISPOSE_REQ)
ORACLE["dispose_state"] = q("""
SELECT b.batch_id, b.product_id,
       CASE WHEN d.batch_id IS NULL THEN b.quantity ELSE 0 END AS quantity,
       CASE WHEN d.batch_id IS NULL THEN b.status ELSE 'depleted' END AS status,
       CAST(CASE WHEN o.units IS NULL THEN p.current_stock ELSE GREATEST(0, p.current_stock - o.units) END AS BIGINT)
         AS current_stock
FROM product_batches b
LEFT JOIN (SELECT DISTINCT batch_id FROM dfound WHERE qty > 0) d ON d.batch_id = b.batch_id
LEFT JOIN products p ON p.product_id = b.product_id
LEFT JOIN (SELECT product_id, SUM(qty) AS units FROM dfound WHERE qty > 0 GROUP BY 1) o ON o.product_id = b.product_id""",
                              _DISPOSE_REQ)

_ADJUST_REQ = """areq AS (
  SELECT 'A:' || batch_id AS request_id, product_id, batch_id, original_quantity % 9 + 1 AS added_stock
  FROM product_batches
  UNION ALL
  SELECT 'P:' || batch_id, product_id, NULL, 5
  FROM product_batches)"""
ORACLE["adjust_stock"] = q(f"""
SELECT r.batch_id || ':restock:' || r.request_id AS movement_id, r.batch_id, 'restock' AS movement_type,
       r.added_stock AS quantity,
       CAST(b.quantity + SUM(r.added_stock) OVER (PARTITION BY r.batch_id ORDER BY r.request_id
                                                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER)
         AS remaining_quantity,
       {NOW} AS movement_date, 'Stock updated via inventory management' AS notes,
       CAST(NULL AS BIGINT) AS performed_by
FROM areq r JOIN product_batches b ON b.batch_id = r.batch_id""", _ADJUST_REQ)
ORACLE["adjust_state"] = q(f"""
SELECT b.batch_id, b.product_id, CAST(b.quantity + COALESCE(t.added, 0) AS BIGINT) AS quantity,
       CASE WHEN t.added IS NULL THEN b.status
            WHEN b.quantity + t.added = 0 THEN 'depleted'
            WHEN b.expiry_date < {AS_OF} THEN 'expired'
            WHEN b.quantity + t.added <= 10 THEN 'low_stock' ELSE 'available' END AS status,
       CAST(p.current_stock + COALESCE(pa.added, 0) AS BIGINT) AS current_stock
FROM product_batches b
LEFT JOIN (SELECT batch_id, SUM(added_stock) AS added FROM areq WHERE batch_id IS NOT NULL GROUP BY 1) t
  ON t.batch_id = b.batch_id
LEFT JOIN products p ON p.product_id = b.product_id
LEFT JOIN (SELECT product_id, SUM(added_stock) AS added FROM areq GROUP BY 1) pa ON pa.product_id = b.product_id""",
                             _ADJUST_REQ)

ORACLE["reclassify_status"] = q("""
SELECT batch_id, quantity,
       CASE WHEN quantity = 0 THEN 'depleted' WHEN expiry_date < DATE '1998-11-28' THEN 'expired'
            WHEN quantity <= 10 THEN 'low_stock' ELSE 'available' END AS status
FROM product_batches""")

ORACLE["reclassify_updated"] = q("""
SELECT batch_id, quantity,
       CASE WHEN expiry_date > DATE '1999-06-01' THEN status
            WHEN quantity = 0 THEN 'depleted' WHEN expiry_date < DATE '1998-11-28' THEN 'expired'
            WHEN quantity <= 10 THEN 'low_stock' ELSE 'available' END AS status
FROM product_batches""")

_NEW_REQ = """nreq AS (
  SELECT s_suppkey AS request_id, trim('  ' || s_name || ' kit ') AS product_name,
         'Medical Supplies & Equipment' AS category, CAST(s_acctbal AS DECIMAL(10,2)) AS price
  FROM supplier)"""
ORACLE["add_products"] = q("""
SELECT (SELECT MAX(product_id) FROM products) + ROW_NUMBER() OVER (ORDER BY request_id) AS product_id,
       product_name, category, CAST(price AS DOUBLE) AS price, 0 AS current_stock,
       50 AS reorder_level, 100 AS reorder_quantity
FROM nreq WHERE length(product_name) > 0 AND length(category) > 0 AND price > 0""", _NEW_REQ)
ORACLE["add_product_rejects"] = q("""
SELECT request_id, CASE WHEN length(product_name) = 0 THEN 'empty_name'
                        WHEN length(category) = 0 THEN 'empty_category' ELSE 'invalid_price' END AS reject_reason
FROM nreq WHERE NOT (length(product_name) > 0 AND length(category) > 0 AND price > 0)""", _NEW_REQ)

ORACLE["update_products"] = q("""
SELECT p.product_id,
       CASE WHEN p.product_id > 0 THEN trim(pt.p_brand || ' ' || pt.p_name) ELSE p.product_name END AS product_name,
       CASE WHEN p.product_id > 0 THEN trim(pt.p_type) ELSE p.category END AS category,
       CAST(CASE WHEN p.product_id > 0 THEN CAST(pt.p_retailprice + pt.p_size AS DECIMAL(10,2)) ELSE p.price END
            AS DOUBLE) AS price,
       p.current_stock, p.reorder_level, p.reorder_quantity
FROM products p JOIN part pt ON pt.p_partkey = p.product_id""")

_DELETE_REQ = """xreq AS (
  SELECT CAST(p_partkey AS VARCHAR) AS request_id, p_partkey AS product_id FROM part
  UNION ALL
  SELECT 'c' || CAST(c_custkey AS VARCHAR), c_custkey + 1000000000 FROM customer),
xout AS (
  SELECT request_id, product_id,
         CASE WHEN product_id NOT IN (SELECT product_id FROM products) THEN 'not_found'
              WHEN product_id IN (SELECT product_id FROM sale_items) THEN 'has_sales'
              ELSE 'deleted' END AS outcome
  FROM xreq)"""
ORACLE["delete_products"] = q("SELECT * FROM xout", _DELETE_REQ)
ORACLE["delete_cascade"] = q("""
SELECT 'products' AS table_name, COUNT(*) AS rows_left FROM products
  WHERE product_id NOT IN (SELECT product_id FROM xout WHERE outcome = 'deleted')
UNION ALL
SELECT 'product_batches', COUNT(*) FROM product_batches
  WHERE product_id NOT IN (SELECT product_id FROM xout WHERE outcome = 'deleted')
UNION ALL
SELECT 'batch_movements', COUNT(*) FROM batch_movements m
  WHERE m.batch_id NOT IN (SELECT batch_id FROM product_batches
                           WHERE product_id IN (SELECT product_id FROM xout WHERE outcome = 'deleted'))""",
                                _DELETE_REQ)

ORACLE["rebuild_legacy"] = q("""
SELECT p.product_id, p.current_stock AS legacy_stock, CAST(COALESCE(SUM(pb.quantity), 0) AS BIGINT) AS batch_stock,
       CAST(p.current_stock - COALESCE(SUM(pb.quantity), 0) AS BIGINT) AS difference
FROM products p LEFT JOIN product_batches pb ON pb.product_id = p.product_id
GROUP BY p.product_id, p.current_stock""")

# ---- integrity checks, on the tables with planted faults ---------------------------------
_FAULTS = """f_products AS (
  SELECT * REPLACE (CASE WHEN product_id % 7 <> 0 THEN product_name END AS product_name,
                    CASE WHEN product_id % 11 <> 0 THEN price END AS price,
                    CASE WHEN product_id % 5 = 0 THEN category ELSE 'Health & Personal Care' END AS category,
                    CASE WHEN product_id % 9 = 0 THEN expiry_date + 1 ELSE manufactured_date END AS manufactured_date)
  FROM (SELECT * FROM products UNION ALL SELECT * FROM products WHERE product_id % 19 = 0)),
f_product_batches AS (
  SELECT * REPLACE (CASE WHEN product_id % 7 = 0 THEN 'lost' ELSE status END AS status,
                    CASE WHEN product_id % 11 <> 0 THEN received_date END AS received_date,
                    CASE WHEN product_id % 13 = 0 THEN product_id + 1000000000 ELSE product_id END AS product_id,
                    CASE WHEN product_id % 17 = 0 THEN quantity + 1 ELSE quantity END AS quantity,
                    CASE WHEN product_id % 31 = 0 THEN expiry_date + 1 ELSE manufactured_date END AS manufactured_date,
                    CASE WHEN product_id % 19 <> 0 AND product_id % 23 <> 0 THEN expiry_date END AS expiry_date,
                    product_id % 19 = 0 AS expiry_date_zero)
  FROM (SELECT * FROM product_batches UNION ALL SELECT * FROM product_batches WHERE product_id % 29 = 0)),
f_batch_movements AS (
  SELECT * REPLACE (CASE WHEN performed_by % 7 = 0 THEN 'gift' ELSE movement_type END AS movement_type,
                    CASE WHEN performed_by % 11 = 0 THEN remaining_quantity + 1 ELSE remaining_quantity END
                      AS remaining_quantity,
                    CASE WHEN performed_by % 13 = 0 THEN 'none-' || batch_id ELSE batch_id END AS batch_id,
                    CASE WHEN performed_by % 17 = 0 THEN NULL ELSE quantity END AS quantity,
                    CASE WHEN performed_by % 3 = 0 THEN 'none' ELSE sale_item_id END AS sale_item_id,
                    CASE WHEN performed_by % 19 = 0 THEN performed_by + 1000000000 ELSE performed_by END AS performed_by)
  FROM (SELECT * FROM batch_movements UNION ALL SELECT * FROM batch_movements WHERE performed_by % 23 = 0)),
f_sales AS (
  SELECT * REPLACE (CASE WHEN sale_id % 7 = 0 THEN 'card' ELSE payment_method END AS payment_method,
                    CASE WHEN sale_id % 11 <> 0 THEN total_amount END AS total_amount,
                    CASE WHEN sale_id % 13 = 0 THEN user_id + 1000000000 ELSE user_id END AS user_id)
  FROM (SELECT * FROM sales UNION ALL SELECT * FROM sales WHERE sale_id % 17 = 0)),
f_sale_items AS (
  SELECT * REPLACE (CASE WHEN sale_id % 7 = 0 THEN product_id + 1000000000 ELSE product_id END AS product_id,
                    CASE WHEN sale_id % 13 <> 0 THEN subtotal END AS subtotal,
                    CASE WHEN sale_id % 17 <> 0 THEN unit_price END AS unit_price,
                    CASE WHEN sale_id % 11 = 0 THEN sale_id + 1000000000 ELSE sale_id END AS sale_id)
  FROM (SELECT * FROM sale_items UNION ALL SELECT * FROM sale_items WHERE sale_id % 19 = 0)),
f_users AS (
  SELECT * REPLACE (CASE WHEN id % 7 = 0 THEN 'guest' ELSE role END AS role,
                    CASE WHEN id % 11 = 0 THEN 'gone' ELSE status END AS status,
                    CASE WHEN id % 17 = 0 THEN 'shared' WHEN id % 13 <> 0 THEN username END AS username)
  FROM (SELECT * FROM users UNION ALL SELECT * FROM users WHERE id % 19 = 0))"""

_UNIQUE = [("products", "product_id"), ("product_batches", "batch_id"), ("product_batches", "product_id,batch_number"),
           ("batch_movements", "movement_id"), ("sales", "sale_id"), ("sale_items", "sale_item_id"),
           ("users", "id"), ("users", "username")]
ORACLE["check_unique"] = q("\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, '{k}' AS key_columns, "
    f"(SELECT COUNT(*) FROM (SELECT {k} FROM f_{t} GROUP BY {k} HAVING COUNT(*) > 1)) AS duplicate_keys"
    for t, k in _UNIQUE), _FAULTS)
_FKS = [("batch_movements", "batch_id", "product_batches", "batch_id"),
        ("batch_movements", "sale_item_id", "sale_items", "sale_item_id"),
        ("batch_movements", "performed_by", "users", "id"),
        ("product_batches", "product_id", "products", "product_id"),
        ("sales", "user_id", "users", "id"),
        ("sale_items", "product_id", "products", "product_id"),
        ("sale_items", "sale_id", "sales", "sale_id")]
ORACLE["check_foreign_keys"] = q("\nUNION ALL\n".join(
    f"SELECT '{c}' AS child_table, '{cc}' AS child_column, '{p}' AS parent_table, "
    f"(SELECT COUNT(*) FROM f_{c} x WHERE x.{cc} IS NOT NULL AND NOT EXISTS "
    f"(SELECT 1 FROM f_{p} y WHERE y.{pc} = x.{cc})) AS orphans"
    for c, cc, p, pc in _FKS), _FAULTS)
_DOMAINS = [("batch_movements", "movement_type", "'sale','restock','adjustment','return','expiry','damage'"),
            ("products", "category", "'Prescription Medicines','Over-the-Counter (OTC) Products',"
                                     "'Health & Personal Care','Medical Supplies & Equipment'"),
            ("product_batches", "status", "'available','low_stock','expired','depleted'"),
            ("sales", "payment_method", "'cash','gcash'"),
            ("users", "role", "'admin','staff'"),
            ("users", "status", "'active','inactive'")]
ORACLE["check_domains"] = q("\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, "
    f"(SELECT COUNT(*) FROM f_{t} WHERE {c} IS NOT NULL AND {c} NOT IN ({d})) AS violations"
    for t, c, d in _DOMAINS), _FAULTS)
_NOT_NULL = {
    "products": ["product_id", "product_name", "category", "price", "current_stock", "manufactured_date",
                 "expiry_date", "created_at", "updated_at"],
    "product_batches": ["batch_id", "product_id", "batch_number", "quantity", "original_quantity",
                        "manufactured_date", "expiry_date", "received_date", "created_at", "updated_at"],
    "batch_movements": ["movement_id", "batch_id", "movement_type", "quantity", "remaining_quantity",
                        "movement_date"],
    "sales": ["sale_id", "user_id", "total_amount", "sale_date"],
    "sale_items": ["sale_item_id", "sale_id", "product_id", "quantity", "unit_price", "subtotal", "created_at"],
    "users": ["id", "username"],
}
_ZERO_DATES = ("manufactured_date", "expiry_date")
ORACLE["check_nulls"] = q("\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, "
    f"(SELECT COUNT(*) FROM f_{t} WHERE {c} IS NULL{f' AND NOT {c}_zero' if c in _ZERO_DATES else ''}) AS nulls"
    for t, cols in _NOT_NULL.items() for c in cols), _FAULTS)
ORACLE["check_ledger"] = q("""
SELECT 'sum_vs_quantity' AS check_name, COUNT(*) AS mismatches
FROM f_product_batches b LEFT JOIN (SELECT batch_id, SUM(quantity) AS s FROM f_batch_movements GROUP BY 1) m
  ON m.batch_id = b.batch_id
WHERE COALESCE(m.s, 0) <> b.quantity
UNION ALL
SELECT 'running_balance', COUNT(*) FROM (
  SELECT remaining_quantity, SUM(quantity) OVER (PARTITION BY batch_id ORDER BY movement_date, movement_id
                                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bal
  FROM f_batch_movements) WHERE bal <> remaining_quantity
UNION ALL
SELECT 'orphan_movements', COUNT(DISTINCT batch_id) FROM f_batch_movements
WHERE batch_id NOT IN (SELECT batch_id FROM f_product_batches)""", _FAULTS)
ORACLE["check_ledger_by_parts"] = ORACLE["check_ledger"]
ORACLE["check_status"] = q(f"""
SELECT COUNT(*) AS batches,
       COUNT(CASE WHEN status IS DISTINCT FROM (CASE WHEN quantity = 0 THEN 'depleted'
            WHEN expiry_date_zero OR expiry_date < {AS_OF} THEN 'expired' WHEN quantity <= 10 THEN 'low_stock'
            ELSE 'available' END) THEN 1 END) AS mismatches
FROM f_product_batches""", _FAULTS)
ORACLE["check_dates"] = q("""
SELECT 'products' AS table_name, 'manufactured_after_expiry' AS check_name,
       COUNT(CASE WHEN manufactured_date > expiry_date THEN 1 END) AS n FROM f_products
UNION ALL SELECT 'products', 'zero_expiry', COUNT(CASE WHEN expiry_date_zero THEN 1 END) FROM f_products
UNION ALL SELECT 'products', 'zero_manufactured', COUNT(CASE WHEN manufactured_date_zero THEN 1 END) FROM f_products
UNION ALL
SELECT 'product_batches', 'manufactured_after_expiry', COUNT(CASE WHEN manufactured_date > expiry_date THEN 1 END)
FROM f_product_batches
UNION ALL SELECT 'product_batches', 'zero_expiry', COUNT(CASE WHEN expiry_date_zero THEN 1 END) FROM f_product_batches
UNION ALL SELECT 'product_batches', 'zero_manufactured', COUNT(CASE WHEN manufactured_date_zero THEN 1 END)
FROM f_product_batches""", _FAULTS)

# ---- streams: the batch equivalents over the events table ------------------------------
ORACLE["stream_daily_sales"] = """
SELECT CAST(ts AS DATE) AS day, SUM(value) AS total_sales, COUNT(*) AS sales_count
FROM events WHERE event_type = 'purchase' GROUP BY 1"""
ORACLE["stream_batch_stock"] = """
SELECT user_id, CAST(SUM(CASE WHEN event_type = 'purchase' THEN -1 ELSE 1 END) AS BIGINT) AS stock,
       COUNT(*) AS moves
FROM events WHERE event_type IN ('purchase', 'signup') GROUP BY 1"""
ORACLE["stream_activity"] = """
SELECT e.event_id, e.ts, e.user_id, e.event_type, e.value, c.c_name AS username
FROM events e JOIN customer c ON c.c_custkey = e.user_id
WHERE e.event_type IN ('purchase', 'error')
ORDER BY e.ts DESC, e.event_id DESC LIMIT 10"""

ORACLE["stream_feed"] = ORACLE["activity_feed"]     # the stream's last state is the report

# O-1 .. O-3: the reports in their order (tests compare the sequence).
ORDERED = {"repurchase_ordered": ("repurchase_list", "stocks_needed DESC, product_id"),
           "reorder_ordered": ("reorder_list", "current_stock, product_id"),
           "expiring_ordered": ("expiring_batches", "expiry_date_zero DESC, expiry_date, batch_id")}
for _name, (_report, _order) in ORDERED.items():
    ORACLE[_name] = f"SELECT * FROM ({ORACLE[_report]}) ORDER BY {_order}"

# S-3: documents flattened, pages of 4 batches.
ORACLE["batch_documents"] = q(f"""
SELECT d.product_id, CAST((d.pos - 1) // 4 AS BIGINT) AS page, t.total_stock, t.active_count, t.label,
       d.pos, d.batch_id, d.batch_number, d.quantity, d.expiry_date, d.status, d.manufactured_date, d.supplier_name
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY expiry_date, batch_id) AS pos
      FROM product_batches WHERE quantity > 0) d
LEFT JOIN (
  SELECT p.product_id,
         CAST(COALESCE(SUM(CASE WHEN {ACTIVE360} THEN pb.quantity ELSE 0 END), 0) AS BIGINT) AS total_stock,
         COUNT(CASE WHEN {ACTIVE360} THEN 1 END) AS active_count,
         CASE WHEN COALESCE(SUM(CASE WHEN {ACTIVE360} THEN pb.quantity ELSE 0 END), 0) > 200 THEN 'Good Stock'
              WHEN COALESCE(SUM(CASE WHEN {ACTIVE360} THEN pb.quantity ELSE 0 END), 0) >= 50 THEN 'Low in Stock'
              ELSE 'Critical Stock' END AS label
  FROM products p LEFT JOIN product_batches pb ON p.product_id = pb.product_id
  GROUP BY p.product_id) t ON t.product_id = d.product_id""")
ORACLE["stream_ledger_stock"] = q("""
SELECT batch_id, CAST(SUM(quantity) AS BIGINT) AS stock, COUNT(*) AS movements
FROM batch_movements GROUP BY batch_id""")

# C-5 on its own
ORACLE["batch_badges"] = q(f"""
SELECT product_id, earliest AS earliest_expiry, on_hand_batches,
       CASE WHEN earliest IS NULL THEN 'fresh'
            WHEN {NOW} > CAST(earliest AS TIMESTAMP) THEN 'expired'
            WHEN full_months + date_diff('day', CAST({AS_OF} + to_months(CAST(full_months AS INTEGER)) AS DATE), e1) / 30.0 < 12
              THEN 'near-expiry'
            ELSE 'fresh' END AS badge
FROM (SELECT *, (year(e1) * 12 + month(e1)) - (1998 * 12 + 6) - CASE WHEN day(e1) < 1 THEN 1 ELSE 0 END AS full_months
      FROM (SELECT p.product_id, MIN(CASE WHEN pb.quantity > 0 THEN pb.expiry_date END) AS earliest,
                   MIN(CASE WHEN pb.quantity > 0 THEN pb.expiry_date END) - 1 AS e1,
                   COUNT(CASE WHEN pb.quantity > 0 THEN 1 END) AS on_hand_batches
            FROM products p LEFT JOIN product_batches pb ON p.product_id = pb.product_id
            GROUP BY p.product_id))""")
