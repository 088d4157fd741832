"""The registered queries once more as plain SQL for DuckDB, to check results against.

The table expressions mirror ``shelfwise.sources.retail``. Sums are cast, because
the two engines choose different result types.
"""

from __future__ import annotations

KIND = "CASE {0} % 5 WHEN 0 THEN 'RESTOCK' WHEN 1 THEN 'RETURN' ELSE 'SALE' END"
START = "TIMESTAMP '1995-01-01 00:00:00'"

TABLES = {
    "users": f"""
        SELECT c_custkey AS UserID, c_name AS Username, lower(c_name) || '@example.com' AS Email,
               CASE c_custkey % 10 WHEN 0 THEN 'ADMIN' WHEN 1 THEN 'MANAGER' WHEN 2 THEN 'MANAGER'
                    ELSE 'STAFF' END AS Role,
               CAST(c_custkey % 8 <> 0 AS INTEGER) AS Is_Active, {START} AS Created_At
        FROM customer""",
    "category": f"""
        SELECT id AS CategoryID, name AS Name, CAST(NULL AS VARCHAR) AS Description,
               CAST(id % 5 <> 0 AS INTEGER) AS IS_ACTIVE, {START} AS Created_At
        FROM (SELECT CAST(substr(p_brand, 7) AS BIGINT) AS id, p_brand AS name FROM part GROUP BY ALL
              UNION ALL SELECT CAST(99 AS BIGINT), 'Brand#99')""",
    "suppliers": f"""
        SELECT s_suppkey AS SupplierID, s_name AS Name, 'N' || s_nationkey AS Contact,
               lower(s_name) || '@example.com' AS Email, CAST(NULL AS VARCHAR) AS Address,
               CAST(s_suppkey % 9 <> 0 AS INTEGER) AS Is_Active, {START} AS Created_At
        FROM supplier""",
    "products": f"""
        SELECT p_partkey AS ProductID, p_name AS Name, CAST(substr(p_brand, 7) AS BIGINT) AS CategoryID,
               p_partkey % (SELECT count(*) FROM supplier) AS SupplierID,
               CAST(p_retailprice AS DECIMAL(10,2)) AS Unit_Price,
               CAST(p_partkey % 23 <> 0 AS INTEGER) AS Is_Active, {START} AS Created_At
        FROM part""",
    "stock": f"""
        SELECT p_partkey AS StockID, p_partkey AS ProductID,
               CAST(CASE WHEN p_partkey % 29 = 0 THEN 0 ELSE p_size END AS BIGINT) AS Quantity,
               p_partkey % 40 AS Restock_Level, {START} AS Last_Updated
        FROM part""",
    "headers": f"""
        SELECT o_orderkey AS TransactionID, o_custkey - CAST(o_custkey % 7 = 5 AS BIGINT) AS UserID,
               {KIND.format('o_orderkey')} AS Trans_Type, o_orderdate AS Trans_Date,
               CAST(CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_totalprice END AS DECIMAL(12,2)) AS Total_Amount,
               CASE WHEN o_orderkey % 3 <> 0 THEN 'Order ' || o_orderkey END AS Notes
        FROM orders""",
    "items": """
        SELECT l_orderkey * 8 + l_linenumber AS ItemID, l_orderkey AS TransactionID,
               l_partkey - CAST(l_partkey % 11 = 5 AS BIGINT) AS ProductID, CAST(l_quantity AS BIGINT) AS Quantity,
               CAST(CASE WHEN l_orderkey % 5 = 0 THEN 0 ELSE l_extendedprice END AS DECIMAL(10,2)) AS Unit_Price,
               CAST(CAST(CASE WHEN l_orderkey % 5 = 0 THEN 0 ELSE l_extendedprice END AS DECIMAL(10,2))
                    * CAST(l_quantity AS BIGINT) AS DECIMAL(12,2)) AS Subtotal
        FROM lineitem""",
    "reports": """
        SELECT event_id AS ReportID,
               (['DAILY_SALES', 'STOCK_ALERT', 'RESTOCK_SUMMARY', 'CATEGORY_SUMMARY'])[event_id % 4 + 1]
                   AS Report_Type,
               user_id AS Generated_By, ts AS Generated_At, props AS Report_Data
        FROM events""",
    "audit_log": """
        SELECT event_id AS LogID,
               CASE event_type WHEN 'purchase' THEN 'TRANSACTIONS' WHEN 'view' THEN 'PRODUCTS'
                    WHEN 'click' THEN 'CATEGORY' WHEN 'error' THEN 'STOCK_MANAGEMENT' ELSE 'USERS' END AS Table_Name,
               CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'view' THEN 'SELECT' WHEN 'error' THEN 'DELETE'
                    ELSE 'UPDATE' END AS Operation,
               user_id AS Record_ID, 'U' || user_id AS Changed_By, ts AS Change_Date,
               CASE WHEN event_id % 4 <> 0 THEN 'Qty=' || event_id % 50 END AS Old_Value,
               'Qty=' || event_id % 60 AS New_Value, props AS Description
        FROM events""",
    # products with their category and stock
    "shelf": """
        SELECT p.ProductID, p.Name AS Product, p.SupplierID, p.Unit_Price, p.CategoryID, c.Name AS Category,
               c.IS_ACTIVE AS Cat_Active, s.Quantity, s.Restock_Level,
               s.Quantity < s.Restock_Level AS low
        FROM products p JOIN category c USING (CategoryID) JOIN stock s USING (ProductID)""",
    "sold": "SELECT i.* FROM items i SEMI JOIN (FROM headers WHERE Trans_Type = 'SALE') USING (TransactionID)",
    "lines": """
        SELECT i.*, h.UserID, h.Trans_Type, h.Trans_Date, p.Name AS Product, p.CategoryID
        FROM items i JOIN headers h USING (TransactionID) JOIN products p USING (ProductID)""",
    "cmds": f"""
        SELECT l_orderkey * 8 + l_linenumber AS cmd_id, o_orderdate AS event_ts,
               CASE WHEN l_orderkey % 97 = 3 THEN -1 ELSE o_custkey END AS user_id,
               CASE WHEN l_orderkey % 101 = 4 THEN -5 ELSE l_partkey END AS product_id,
               CASE WHEN l_orderkey % 89 = 2 THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS quantity,
               CASE WHEN l_orderkey % 83 = 1 THEN 'GIFT' ELSE {KIND.format('l_orderkey')} END AS cmd_type,
               CASE WHEN l_orderkey % 2 <> 0 THEN 'Line ' || l_linenumber END AS notes,
               'U' || o_custkey AS actor
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "facts": """
        SELECT cmds.*, p.ProductID IS NOT NULL AND p.Is_Active = 1 AS usable, c.IS_ACTIVE AS flag,
               p.Name AS product_name, c.Name AS category_name, p.Unit_Price, s.Quantity AS opening,
               u.UserID IS NOT NULL AS user_known
        FROM cmds LEFT JOIN products p ON product_id = p.ProductID LEFT JOIN category c USING (CategoryID)
             LEFT JOIN stock s ON product_id = s.ProductID LEFT JOIN users u ON user_id = u.UserID""",
    "judged": """
        SELECT *,
               CASE WHEN cmd_type NOT IN ('SALE', 'RETURN', 'RESTOCK') THEN '-20004'
                    WHEN NOT usable THEN CASE cmd_type WHEN 'SALE' THEN '-20030' WHEN 'RETURN' THEN '-20032'
                                              ELSE '-20024' END
                    WHEN cmd_type = 'RESTOCK' AND flag = 0 THEN '-20025' END AS code,
               CASE WHEN quantity <= 0 THEN 'CHK_QTY' WHEN NOT user_known THEN 'FK_USER' END AS late_code
        FROM facts""",
    "judged_by_procedure": """
        SELECT *,
               CASE WHEN cmd_type = 'RESTOCK' AND NOT usable THEN '-20005' WHEN NOT usable THEN '-20001'
                    WHEN cmd_type = 'RESTOCK' AND flag = 0 THEN '-20006'
                    WHEN cmd_type NOT IN ('SALE', 'RETURN', 'RESTOCK') THEN '-20004' END AS code,
               CASE WHEN quantity <= 0 THEN 'CHK_QTY' WHEN NOT user_known THEN 'FK_USER' END AS late_code
        FROM facts""",
}

NEEDS = {
    "shelf": ("products", "category", "stock"),
    "sold": ("items", "headers"),
    "lines": ("items", "headers", "products"),
    "facts": ("cmds", "products", "category", "stock", "users"),
    "judged": ("facts",),
    "judged_by_procedure": ("facts",),
}


def _closure(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for name in names:
        for n in (*_closure(NEEDS.get(name, ())), name):
            if n not in out:
                out.append(n)
    return out


def sql(body: str, *tables: str, extra: str = "", recursive: bool = False) -> str:
    """The body after the table expressions it needs; ``extra`` adds further ones."""
    ctes = [f"{name} AS ({TABLES[name].strip()})" for name in _closure(tables)]
    if extra:
        ctes.append(extra.strip())
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n" + body.strip()


def mean(amount: str, count: str) -> str:
    """Exact amount / count, half up to cents, for amounts of at most two decimals that are not negative."""
    cents = f"CAST({amount} * 100 AS HUGEINT)"
    return f"CAST(CAST((2 * {cents} + {count}) // (2 * {count}) AS DECIMAL(18,0)) / 100 AS DECIMAL(18,2))"


def number(value: str) -> str:
    plain = f"regexp_replace(CAST(CAST({value} AS DECIMAL(38,2)) AS VARCHAR), '\\.?0+$', '')"
    return f"regexp_replace({plain}, '^(-?)0\\.', '\\1.')"


def fold(judged: str = "judged", rules: str = "package") -> str:
    """CTEs up to ``decided``: the recursion takes each product's commands one by one."""
    short = "-20031" if rules == "package" else "-20003"
    return f"""
    placed AS (
        SELECT *, CASE WHEN code IS NOT NULL OR late_code IS NOT NULL OR opening IS NULL THEN 0
                       WHEN cmd_type = 'SALE' THEN -quantity ELSE quantity END AS effect,
               row_number() OVER (PARTITION BY product_id ORDER BY event_ts, cmd_id, quantity) AS rn
        FROM {judged}),
    moves AS (SELECT product_id, rn, effect, opening FROM placed WHERE opening IS NOT NULL),
    walk AS (
        SELECT product_id, rn, opening AS before, effect FROM moves WHERE rn = 1
        UNION ALL
        SELECT m.product_id, m.rn,
               CASE WHEN w.effect > 0 OR w.before + w.effect >= 0 THEN w.before + w.effect ELSE w.before END,
               m.effect
        FROM walk w JOIN moves m ON m.product_id = w.product_id AND m.rn = w.rn + 1),
    decided AS (
        SELECT p.* EXCLUDE (code, effect), w.before AS stock_before, v.code, v.code IS NULL AS accepted,
               CASE WHEN v.code IS NULL THEN p.effect ELSE 0 END AS effect,
               w.before + CASE WHEN v.code IS NULL THEN p.effect ELSE 0 END AS stock_after
        FROM placed p LEFT JOIN walk w USING (product_id, rn),
             LATERAL (SELECT coalesce(p.code, CASE WHEN p.cmd_type = 'SALE' AND w.before < p.quantity
                                                   THEN '{short}' END, p.late_code) AS code) v)"""
