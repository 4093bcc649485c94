"""Independent DuckDB SQL for every registered query.

Each text starts with the same CTE prelude that maps the driver's tables to
the ticketing tables (FIXTURES.md §2), written separately from the Spark
adapter, then states the reference's report SQL over those CTEs. Mapped
names carry an ``m_`` prefix because the driver already has views named
``customer`` and ``events``.
"""

from __future__ import annotations

import sys

# The form's phone rule, stated here on its own: ten characters, each a digit.
PHONE_PATTERN = "^[" + "".join(f"\\x{{{c:X}}}" for c in range(sys.maxunicode + 1) if chr(c).isdigit()) + "]{10}$"

# Fixed values shared with marquee.functions.semantics (same meaning).
NUMERIC_PREFIX = r"^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)"


def lenient(x: str) -> str:
    p = f"regexp_extract({x}, '{NUMERIC_PREFIX}', 1)"
    return (f"CAST(CASE WHEN {x} IS NULL THEN NULL "
            f"WHEN {p} = '' THEN 0 "
            f"WHEN TRY_CAST({p} AS DOUBLE) >= 9999999999.5 THEN 9999999999 "
            f"WHEN TRY_CAST({p} AS DOUBLE) <= -9999999999.5 THEN -9999999999 "
            f"ELSE TRY_CAST({p} AS DECIMAL(38,20)) END AS DECIMAL(10,0))")


def ci(x: str) -> str:
    return f"lower(strip_accents({x}))"


def name(first: str, last: str) -> str:
    return f"({first} || ' ' || {last})"


def _one_by_one(table: str, columns: list[str], renames: str) -> str:
    """Key changes applied one by one in the order of ``seq``."""
    rest = ", ".join(f"t.{c}" for c in columns)
    return f"""
SELECT coalesce(m.k, t.ID) AS ID, {rest} FROM {table} t LEFT JOIN (
  {_rename_steps(table, renames)}
  SELECT u.x.k AS k, u.x.was AS was FROM (SELECT unnest(live) AS x FROM s WHERE n = (SELECT max(n) FROM s)) u
) m ON m.was = t.ID"""


def _one_by_one_rejects(table: str, renames: str) -> str:
    return f"""
SELECT bad AS seq, 'key change' AS reason FROM (
  {_rename_steps(table, renames)} SELECT bad FROM s WHERE bad IS NOT NULL) b"""


def _rename_steps(table: str, renames: str) -> str:
    """The state after every change: the list of (key now, key at the start)
    of the rows whose key may change, and the change if it failed."""
    return f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (ORDER BY seq) AS n FROM ({renames})),
  start AS (SELECT coalesce(list({{'k': ID, 'was': ID}}), []) AS live FROM {table}
            WHERE ID IN (SELECT old_id FROM r UNION SELECT new_id FROM r)),
  s AS (
    SELECT CAST(0 AS BIGINT) AS n, live, CAST(NULL AS BIGINT) AS bad FROM start
    UNION ALL
    SELECT r.n, CASE WHEN len(list_filter(s.live, lambda x: x.k = r.old_id)) > 0
                      AND r.new_id IS NOT NULL
                      AND len(list_filter(s.live, lambda x: x.k = r.new_id)) = 0
      THEN list_transform(s.live, lambda x: CASE WHEN x.k = r.old_id THEN {{'k': r.new_id, 'was': x.was}} ELSE x END)
      ELSE s.live END,
      CASE WHEN len(list_filter(s.live, lambda x: x.k = r.old_id)) > 0 AND r.new_id <> r.old_id
                AND len(list_filter(s.live, lambda x: x.k = r.new_id)) > 0 THEN CAST(r.seq AS BIGINT) END
    FROM s JOIN r ON r.n = s.n + 1)"""


PRELUDE = f"""
WITH
m_company AS (
  SELECT CAST(s.s_suppkey AS BIGINT) AS ID, s.s_name AS name, n.n_name AS location
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey),
m_distributer AS (
  SELECT CAST(n.n_nationkey AS BIGINT) AS ID, n.n_name AS name, r.r_name AS location
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey),
m_event AS (
  SELECT CAST(p_partkey AS BIGINT) AS ID, p_name AS name,
         CASE WHEN p_partkey % 7 = 3 THEN lower(p_type) ELSE p_type END AS type, p_brand AS location,
         TIMESTAMP '2024-01-01' + to_days(CAST(p_partkey AS INTEGER)) AS datetime,
         CAST(p_retailprice AS DECIMAL(10,2)) AS general_price,
         CAST(CAST(p_retailprice AS DECIMAL(10,2)) * 2 AS DECIMAL(10,2)) AS vip_price,
         CASE WHEN p_partkey % 89 = 0 THEN NULL
              WHEN p_partkey % 97 = 0 THEN 'N/A'
              WHEN p_partkey % 11 = 0
                THEN CAST(CAST(p_retailprice AS DECIMAL(10,2)) AS VARCHAR) || ' USD'
              ELSE CAST(CAST(p_retailprice AS DECIMAL(10,2)) * p_size AS VARCHAR) END AS income,
         CASE WHEN p_partkey % 13 <> 0 THEN CAST(p_size * 100 AS VARCHAR) || ' USD' END AS expense,
         CASE WHEN p_partkey % 5 <> 0 THEN p_name || ', ' || p_brand END AS details,
         CAST(CASE WHEN (p_partkey * p_size) % (SELECT count(*) FROM supplier) % 10 = 7 THEN NULL
              ELSE (p_partkey * p_size) % (SELECT count(*) FROM supplier) END AS BIGINT)
           AS company_id
  FROM part),
m_customer AS (
  SELECT CAST(c_custkey AS BIGINT) AS ID,
         split_part(c_name, '#', 1) AS first_name,
         split_part(c_name, '#', 2) AS last_name,
         'c' || CAST(c_custkey AS VARCHAR) || '@mail.'
           || CASE WHEN c_custkey % 40 = 0 THEN 'org' ELSE 'com' END AS e_mail,
         CASE WHEN c_custkey % 50 = 0 THEN '12345'
              ELSE lpad(CAST(c_custkey AS VARCHAR), 10, '5') END AS phone_num
  FROM customer),
m_ticket AS (
  SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS ID,
         CASE min(l_returnflag) WHEN 'R' THEN 'VIP' WHEN 'A' THEN 'General' ELSE 'vip' END AS type,
         CAST(100 AS INTEGER) AS tickets_available,
         CAST(1 AS INTEGER) AS tickets_sold,
         CAST(min(l_extendedprice) AS DECIMAL(10,2)) AS price,
         CAST(min(l_partkey) AS BIGINT) AS event_id,
         CAST(min(l_suppkey) % 24 + 1 AS BIGINT) AS distributer_id
  FROM lineitem GROUP BY l_orderkey, l_linenumber),
m_purchase AS (
  SELECT t.ID AS purchase_id, CAST(o.o_custkey AS BIGINT) AS customer_id, t.ID AS ticket_id,
         CASE WHEN substr(o.o_orderpriority, 1, 1) IN ('1', '2') THEN 'Credit Card'
              ELSE 'Cash' END AS payment_type,
         CAST(o.o_orderdate AS TIMESTAMP) AS purchase_date
  FROM m_ticket t JOIN orders o ON t.ID // 10 = o.o_orderkey),
m_cust_of AS (
  SELECT DISTINCT e.company_id, p.customer_id
  FROM m_purchase p JOIN m_ticket t ON p.ticket_id = t.ID JOIN m_event e ON t.event_id = e.ID
  WHERE e.company_id IS NOT NULL),
m_request AS (
  SELECT e.event_id AS request_id, CAST(e.ts AS TIMESTAMP) AS requested_at,
         c.first_name, c.last_name,
         CASE WHEN e.event_id % 5 = 0 THEN 'r' || CAST(e.user_id AS VARCHAR) || '@mail.com'
              WHEN e.event_id % 7 = 0 THEN upper(substr(c.e_mail, 1, 1)) || substr(c.e_mail, 2)
              ELSE c.e_mail END AS e_mail,
         c.phone_num,
         CAST(e.event_id % (SELECT count(*) FROM part) AS BIGINT) AS event_id,
         CASE e.event_id % 3 WHEN 0 THEN 'General' WHEN 1 THEN 'VIP'
              ELSE 'Select Ticket Type' END AS ticket_type,
         CASE (e.event_id // 3) % 3 WHEN 0 THEN 'Credit Card' WHEN 1 THEN 'Cash'
              ELSE 'Select Payment Type' END AS payment_type
  FROM events e LEFT JOIN m_customer c ON e.user_id = c.ID
  WHERE e.event_type = 'purchase')
"""


def q(body: str) -> str:
    return PRELUDE + body


REPORTS = {
    "event_type_popularity": f"""
SELECT min(e.type) AS EventType, CAST(count(t.event_id) AS BIGINT) AS TotalTicketsSold
FROM m_event e JOIN m_ticket t ON e.ID = t.event_id
GROUP BY {ci('e.type')}
ORDER BY TotalTicketsSold DESC NULLS LAST, EventType""",
    "top_customer_by_class": f"""
SELECT c.ID AS CustomerID, {name('c.first_name', 'c.last_name')} AS CustomerName,
       CAST(SUM(CASE WHEN {ci('t.type')} = 'vip' THEN e.vip_price ELSE e.general_price END)
            AS DECIMAL(38,2)) AS TotalSpent
FROM m_purchase p JOIN m_ticket t ON p.ticket_id = t.ID
JOIN m_event e ON t.event_id = e.ID JOIN m_customer c ON p.customer_id = c.ID
GROUP BY c.ID, {name('c.first_name', 'c.last_name')}
ORDER BY TotalSpent DESC NULLS LAST, CustomerID LIMIT 1""",
    "top_customer_price_count": f"""
SELECT c.ID AS CustomerID, {name('c.first_name', 'c.last_name')} AS CustomerName,
       CAST(SUM(t.price) * COUNT(p.purchase_id) AS DECIMAL(38,2)) AS TotalSpent
FROM m_purchase p JOIN m_ticket t ON p.ticket_id = t.ID JOIN m_customer c ON p.customer_id = c.ID
GROUP BY c.ID, {name('c.first_name', 'c.last_name')}
ORDER BY TotalSpent DESC NULLS LAST, CustomerID LIMIT 1""",
    "event_revenue": f"""
SELECT ID, name AS EventName, {lenient('income')} AS TotalRevenue
FROM m_event ORDER BY TotalRevenue DESC NULLS LAST, ID""",
    "event_revenue_names": f"""
SELECT name AS EventName, {lenient('income')} AS TotalRevenue
FROM m_event ORDER BY TotalRevenue DESC NULLS LAST""",
    "company_most_events": """
SELECT c.ID AS CompanyID, c.name AS CompanyName, COUNT(e.type) AS EventTypeCount
FROM m_company c JOIN m_event e ON c.ID = e.company_id
GROUP BY c.ID, c.name ORDER BY EventTypeCount DESC NULLS LAST, CompanyID LIMIT 1""",
    "company_most_tickets": """
SELECT c.ID AS CompanyID, c.name AS CompanyName, COUNT(t.event_id) AS TotalTicketsSold
FROM m_company c JOIN m_event e ON c.ID = e.company_id JOIN m_ticket t ON e.ID = t.event_id
GROUP BY c.ID, c.name ORDER BY TotalTicketsSold DESC NULLS LAST, CompanyID LIMIT 1""",
    "company_sales_ranking": f"""
SELECT c.ID AS CompanyID, c.name AS CompanyName,
       CAST(SUM({lenient('e.income')}) AS DECIMAL(38,0)) AS TotalRevenue
FROM m_company c LEFT JOIN m_event e ON c.ID = e.company_id
GROUP BY c.ID, c.name ORDER BY TotalRevenue DESC NULLS LAST, CompanyID""",
    "customer_loyalty": f"""
SELECT c.ID AS CustomerID, {name('c.first_name', 'c.last_name')} AS CustomerName,
       co.ID AS CompanyID, co.name AS CompanyName, COUNT(p.purchase_id) AS PurchaseCount
FROM m_purchase p JOIN m_customer c ON p.customer_id = c.ID
JOIN m_ticket t ON p.ticket_id = t.ID JOIN m_event e ON t.event_id = e.ID
JOIN m_company co ON e.company_id = co.ID
GROUP BY c.ID, {name('c.first_name', 'c.last_name')}, co.ID, co.name
ORDER BY CustomerID, CompanyID""",
    "event_listing": """
SELECT e.ID, e.name, e.type, e.location, e.datetime, e.general_price, e.vip_price, e.income,
       e.expense, e.details, c.name AS company_name
FROM m_event e JOIN m_company c ON e.company_id = c.ID""",
}

LISTINGS = {
    "scan_event_catalog": "SELECT * FROM m_event",
    "scan_company": "SELECT * FROM m_company",
    "scan_distributer": "SELECT * FROM m_distributer",
    "scan_customer": "SELECT * FROM m_customer",
    "scan_ticket": "SELECT * FROM m_ticket",
    "scan_purchase": "SELECT * FROM m_purchase",
    "scan_cust_of": "SELECT * FROM m_cust_of",
    "ticket_narrow": "SELECT ID, type, price, event_id, distributer_id FROM m_ticket",
    "cust_of_pairs": "SELECT company_id, customer_id FROM m_cust_of",
    "event_cards": ("SELECT name, location, type, datetime, general_price, vip_price, details "
                    "FROM m_event"),
    "event_picker": "SELECT ID, name FROM m_event",
    "distributer_picker": "SELECT ID, name FROM m_distributer",
}

LOOKUPS = {
    "customer_by_email": f"""
SELECT r.request_id, r.e_mail, m.customer_id
FROM m_request r LEFT JOIN (
  SELECT {ci('e_mail')} AS k, min(ID) AS customer_id FROM m_customer
  WHERE e_mail IS NOT NULL GROUP BY {ci('e_mail')}) m ON {ci('r.e_mail')} = m.k""",
    "latest_ticket_id": "SELECT max(ID) AS latest_ticket_id FROM m_ticket",
    "customer_profile": """
SELECT v.visit_id, v.customer_id,
       coalesce(c.first_name, '') AS first_name, coalesce(c.last_name, '') AS last_name,
       coalesce(c.e_mail, '') AS e_mail, coalesce(c.phone_num, '') AS phone_num
FROM (SELECT event_id AS visit_id,
             CASE WHEN event_type = 'view' THEN NULL ELSE user_id * 11 END AS customer_id
      FROM events) v
LEFT JOIN m_customer c ON v.customer_id = c.ID""",
    "match_contacts": f"""
SELECT r.request_id, r.e_mail, r.phone_num, m.customer_id
FROM m_request r LEFT JOIN (
  SELECT {ci('e_mail')} AS mk, {ci('phone_num')} AS pk, min(ID) AS customer_id FROM m_customer
  WHERE e_mail IS NOT NULL AND phone_num IS NOT NULL
  GROUP BY {ci('e_mail')}, {ci('phone_num')}) m
  ON {ci('r.e_mail')} = m.mk AND {ci('r.phone_num')} = m.pk""",
}




INTAKE_CTES = f""",
m_validated AS (
  SELECT r.*,
         CASE WHEN NOT coalesce(regexp_matches(r.phone_num, '{PHONE_PATTERN}'), false)
                THEN 'Invalid Phone Number!'
              WHEN NOT coalesce(ends_with(r.e_mail, '.com'), false) THEN 'Invalid Email!'
         END AS reject_reason
  FROM m_request r),
m_valid AS (SELECT * EXCLUDE (reject_reason) FROM m_validated WHERE reject_reason IS NULL),
m_known AS (
  SELECT {ci('e_mail')} AS k, min(ID) AS customer_id FROM m_customer
  WHERE e_mail IS NOT NULL GROUP BY {ci('e_mail')}),
m_first AS (
  SELECT * FROM (
    SELECT v.*, {ci('v.e_mail')} AS k,
           row_number() OVER (PARTITION BY {ci('v.e_mail')} ORDER BY v.request_id) AS rn
    FROM m_valid v
    WHERE NOT EXISTS (SELECT 1 FROM m_known m WHERE m.k = {ci('v.e_mail')})) WHERE rn = 1),
m_new_customer AS (
  SELECT (SELECT coalesce(max(ID), 0) FROM m_customer)
           + row_number() OVER (ORDER BY request_id) AS ID,
         first_name, last_name, e_mail, phone_num, k
  FROM m_first),
m_with_customer AS (
  SELECT v.*, coalesce(m.customer_id, n.ID) AS customer_id
  FROM m_valid v LEFT JOIN m_known m ON {ci('v.e_mail')} = m.k
  LEFT JOIN m_new_customer n ON {ci('v.e_mail')} = n.k),
m_quote AS (
  SELECT w.*, e.company_id,
         CASE WHEN w.ticket_type = 'General' THEN e.general_price ELSE e.vip_price END AS price,
         CASE WHEN e.ID IS NULL THEN 'Unknown event' END AS reject_reason
  FROM m_with_customer w LEFT JOIN m_event e ON w.event_id = e.ID),
m_accepted AS (
  SELECT * EXCLUDE (reject_reason), row_number() OVER (ORDER BY request_id) AS pos
  FROM m_quote WHERE reject_reason IS NULL),
m_new_ticket AS (
  SELECT (SELECT coalesce(max(ID), 0) FROM m_ticket) + pos AS ID, ticket_type AS type,
         CAST(100 AS INTEGER) AS tickets_available, CAST(1 AS INTEGER) AS tickets_sold,
         CAST(price AS DECIMAL(10,2)) AS price, event_id,
         CAST((request_id % 24 + 24) % 24 + 1 AS BIGINT) AS distributer_id
  FROM m_accepted),
m_new_purchase AS (
  SELECT (SELECT coalesce(max(purchase_id), 0) FROM m_purchase) + pos AS purchase_id,
         customer_id, (SELECT coalesce(max(ID), 0) FROM m_ticket) + pos AS ticket_id,
         payment_type, requested_at AS purchase_date
  FROM m_accepted),
m_new_cust_of AS (
  SELECT DISTINCT a.company_id, a.customer_id FROM m_accepted a
  WHERE a.company_id IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM m_cust_of c WHERE c.company_id = a.company_id AND c.customer_id = a.customer_id)),
m_reject AS (
  SELECT request_id, reject_reason FROM m_validated WHERE reject_reason IS NOT NULL
  UNION ALL
  SELECT request_id, reject_reason FROM m_quote WHERE reject_reason IS NOT NULL)
"""

INTAKE = {
    "validate_requests": "SELECT * FROM m_validated",
    "new_customers": "SELECT ID, first_name, last_name, e_mail, phone_num FROM m_new_customer",
    "quote_tickets": "SELECT * FROM m_quote",
    "new_cust_of": "SELECT company_id, customer_id FROM m_new_cust_of",
    "book_tickets": "SELECT * FROM m_new_ticket",
    "new_purchases": "SELECT * FROM m_new_purchase",
    "intake_rejects": "SELECT * FROM m_reject",
}


def money(x: str) -> str:
    return f"TRY_CAST(trim(regexp_replace({x}, '[,$]', '', 'g')) AS DECIMAL(38,10))"


# Ticket insert forms from signups, read as the form's statement would read them.
TICKET_FORMS = """
SELECT CASE WHEN e % 7 <> 0 THEN e END AS seq, key_text, TRY_CAST(key_text AS BIGINT) AS ID,
       CASE WHEN e % 2 = 0 THEN 'VIP' ELSE 'General' END AS type,
       CAST(1000 + e % 1000 AS INTEGER) AS tickets_available,
       CAST(CASE WHEN e % 11 <> 0 THEN e % 90 END AS INTEGER) AS tickets_sold,
       CAST(e % 500 + 0.25 AS DECIMAL(10,2)) AS price, CAST(e % 1000 AS BIGINT) AS event_id,
       CAST(user_id % 24 + 1 AS BIGINT) AS distributer_id
FROM (SELECT event_id AS e, user_id,
             CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 17 = 0 THEN 'none'
                  ELSE CAST(user_id * 10 + 1 AS VARCHAR) END AS key_text
      FROM events WHERE event_type = 'signup')"""


def _signup_forms(factor: int, columns: str, bad: str) -> str:
    """Insert forms of the signups, typed, with the reason of a reject."""
    return f"""
SELECT CASE WHEN e % 7 <> 0 THEN e END AS seq, TRY_CAST(key_text AS BIGINT) AS form_key, {columns},
       CASE WHEN key_text IS NULL THEN 'missing key'
            WHEN TRY_CAST(key_text AS BIGINT) IS NULL OR {bad} THEN 'invalid value' END AS reason
FROM (SELECT event_id AS e, user_id AS u,
             CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 17 = 0 THEN 'none'
                  ELSE CAST(user_id * {factor} + 1 AS VARCHAR) END AS key_text
      FROM events WHERE event_type = 'signup')"""


EVENT_FORMS = _signup_forms(2, """
       'Ev' || e AS name, CASE WHEN e % 3 = 0 THEN 'Concert' ELSE 'concert' END AS type, 'Hall ' || (e % 9) AS location,
       make_timestamp(2025, 3, CAST(e % 28 + 1 AS INTEGER), 20, 30, 0) AS datetime,
       CAST(1000 + e % 1000 + 0.5 AS DECIMAL(10,2)) AS general_price, CAST(e % 700 + 0.25 AS DECIMAL(10,2)) AS vip_price,
       (e % 5000) || ' USD' AS income, CAST(NULL AS VARCHAR) AS expense,
       CASE WHEN e % 2 = 0 THEN 'seats ' || e END AS details,
       CAST(CASE WHEN e % 4 <> 0 THEN e % 50 END AS BIGINT) AS company_id""", "e % 11 = 0 OR e % 19 = 0")
CUSTOMER_FORMS = _signup_forms(3, """
       'First' || e AS first_name, CASE WHEN e % 5 <> 0 THEN 'Last' || u END AS last_name,
       'u' || e || '@example.org' AS e_mail, lpad(CAST(e AS VARCHAR), 10, '5') AS phone_num""", "false")
PURCHASE_FORMS = _signup_forms(10, """
       CAST(e % 1500 AS BIGINT) AS customer_id, CAST(e * 10 + 1 AS BIGINT) AS ticket_id,
       CASE WHEN e % 2 = 0 THEN 'Cash' ELSE 'Credit Card' END AS payment_type,
       make_timestamp(2025, 4, CAST(e % 28 + 1 AS INTEGER), 9, 15, 0) AS purchase_date""", "e % 11 = 0 OR e % 23 = 0")


def _inserted(table: str, key: str, columns: str, forms: str) -> str:
    return f"""
SELECT {key}, {columns} FROM {table}
UNION ALL
SELECT form_key AS {key}, {columns} FROM ({forms})
WHERE reason IS NULL AND form_key NOT IN (SELECT {key} FROM {table})
QUALIFY row_number() OVER (PARTITION BY form_key ORDER BY seq NULLS LAST, {columns}) = 1"""


def _rejected(forms: str) -> str:
    return f"SELECT seq, reason FROM ({forms}) WHERE reason IS NOT NULL"


def _per_key(log: str) -> str:
    """A log applied edit by edit to each key on its own (no key changes)."""
    return f"""{log}_n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS rn FROM {log}),
{log}_len AS (SELECT key, max(rn) AS n FROM {log}_n GROUP BY key),
{log}_sim AS (
  SELECT k.key, CAST(0 AS BIGINT) AS rn, c.ID IS NOT NULL AS live,
         c.first_name, c.last_name, c.e_mail, c.phone_num
  FROM {log}_len k LEFT JOIN m_customer c ON c.ID = k.key
  UNION ALL
  SELECT s.key, l.rn,
         CASE WHEN l.op = 'insert' THEN true WHEN l.op = 'delete' THEN false ELSE s.live END,
         CASE WHEN l.op = 'insert' AND NOT s.live THEN l.ins_first
              WHEN l.op = 'update' AND s.live AND l.property = 'first_name' THEN l.new_value
              ELSE s.first_name END,
         CASE WHEN l.op = 'insert' AND NOT s.live THEN l.ins_last
              WHEN l.op = 'update' AND s.live AND l.property = 'last_name' THEN l.new_value
              ELSE s.last_name END,
         CASE WHEN l.op = 'insert' AND NOT s.live THEN l.ins_mail
              WHEN l.op = 'update' AND s.live AND l.property = 'e_mail' THEN l.new_value
              ELSE s.e_mail END,
         CASE WHEN l.op = 'insert' AND NOT s.live THEN l.ins_phone
              WHEN l.op = 'update' AND s.live AND l.property = 'phone_num' THEN l.new_value
              ELSE s.phone_num END
  FROM {log}_sim s JOIN {log}_n l ON l.key = s.key AND l.rn = s.rn + 1),"""


CHANGE_CTES = f""",
m_clog AS (
  SELECT event_id AS seq,
         CASE WHEN event_type = 'signup' THEN 'insert'
              WHEN event_type IN ('click', 'view') THEN 'update' ELSE 'delete' END AS op,
         CAST(user_id AS BIGINT) AS key,
         CASE WHEN event_type IN ('click', 'view')
              THEN ['first_name', 'last_name', 'e_mail', 'phone_num'][event_id % 4 + 1] END
           AS property,
         CASE WHEN event_type IN ('click', 'view') THEN
           CASE event_id % 4 WHEN 2 THEN 'u' || CAST(event_id AS VARCHAR) || '@mail.com'
                             WHEN 3 THEN lpad(CAST(event_id AS VARCHAR), 10, '7')
                             ELSE 'v' || CAST(event_id AS VARCHAR) END END AS new_value,
         'New' AS ins_first, CAST(event_id AS VARCHAR) AS ins_last,
         'n' || CAST(event_id AS VARCHAR) || '@mail.com' AS ins_mail,
         lpad(CAST(event_id AS VARCHAR), 10, '6') AS ins_phone
  FROM events WHERE event_type <> 'purchase'),
{_per_key('m_clog')}
m_elog AS (
  SELECT event_id AS seq, CAST(event_id % (SELECT count(*) FROM part) AS BIGINT) AS key,
         ['name', 'type', 'general_price', 'vip_price', 'company_id', 'income',
          'datetime'][event_id % 7 + 1] AS property,
         value, user_id
  FROM events WHERE event_type = 'click'),
m_echeck AS (
  SELECT seq, key, property, new_value,
         CASE WHEN property IN ('general_price', 'vip_price')
                   AND TRY_CAST({money('new_value')} AS DECIMAL(10,2)) IS NULL
                THEN 'invalid value'
              WHEN property = 'company_id'
                   AND TRY_CAST(round({money('new_value')}, 0) AS BIGINT) IS NULL
                THEN 'invalid value'
              WHEN property = 'datetime' AND TRY_CAST(trim(new_value) AS TIMESTAMP) IS NULL
                THEN 'invalid value' END AS reason
  FROM (
    SELECT seq, key, property,
           CASE WHEN property IN ('general_price', 'vip_price') THEN
                  CASE WHEN seq % 13 = 0 THEN 'n/a'
                       ELSE '$1,' || CAST(CAST(value AS DECIMAL(10,2)) AS VARCHAR) END
                WHEN property = 'company_id' THEN CAST(user_id % 100 AS VARCHAR)
                WHEN property = 'income' THEN CAST(CAST(value AS DECIMAL(10,2)) AS VARCHAR) || ' USD'
                WHEN property = 'datetime' THEN '2025-06-01 20:00:00'
                WHEN property = 'type' THEN CASE WHEN seq % 2 = 0 THEN 'Concert' ELSE 'concert' END
                ELSE 'Show ' || CAST(seq AS VARCHAR) END AS new_value
    FROM m_elog)),
m_epiv AS (
  SELECT key,
         arg_max(new_value, seq) FILTER (WHERE property = 'name') AS name,
         arg_max(new_value, seq) FILTER (WHERE property = 'type') AS type,
         arg_max(new_value, seq) FILTER (WHERE property = 'general_price') AS general_price,
         arg_max(new_value, seq) FILTER (WHERE property = 'vip_price') AS vip_price,
         arg_max(new_value, seq) FILTER (WHERE property = 'company_id') AS company_id,
         arg_max(new_value, seq) FILTER (WHERE property = 'income') AS income,
         arg_max(new_value, seq) FILTER (WHERE property = 'datetime') AS datetime
  FROM m_echeck WHERE reason IS NULL GROUP BY key),
m_pairs AS (
  SELECT event_id AS seq,
         CAST(user_id * 7 % (SELECT count(*) FROM supplier) AS VARCHAR) || ','
           || CAST(user_id AS VARCHAR) || CASE WHEN event_id % 17 = 0 THEN ',9' ELSE '' END
           AS pair_text
  FROM events WHERE event_type = 'signup'),
m_pairs_ok AS (
  SELECT CAST(split_part(pair_text, ',', 1) AS BIGINT) AS company_id,
         CAST(split_part(pair_text, ',', 2) AS BIGINT) AS customer_id
  FROM m_pairs WHERE len(string_split(pair_text, ',')) = 2),
m_pdel AS (
  SELECT event_id * 10 + 1 AS purchase_id FROM events WHERE event_type = 'error'),
m_tedit AS (
  SELECT seq, key, property,
         CASE property
           WHEN 'type' THEN CASE WHEN seq % 2 = 0 THEN 'VIP' ELSE 'General' END
           WHEN 'tickets_available' THEN '1,' || lpad(CAST(seq % 1000 AS VARCHAR), 3, '0')
           WHEN 'tickets_sold' THEN CASE WHEN seq % 11 = 0 THEN 'many'
                                         ELSE CAST(seq % 90 AS VARCHAR) END
           WHEN 'price' THEN '$' || CAST(CAST(value AS DECIMAL(10,2)) AS VARCHAR)
           WHEN 'event_id' THEN CAST((SELECT count(*) FROM part) + user_id * 13 AS VARCHAR)
           ELSE CAST(user_id % 24 + 1 AS VARCHAR) || '.0' END AS v
  FROM (
    SELECT event_id AS seq, CAST(event_id * 10 + 1 AS BIGINT) AS key,
           ['type', 'tickets_available', 'tickets_sold', 'price', 'event_id',
            'distributer_id'][event_id % 6 + 1] AS property,
           value, user_id
    FROM events WHERE event_type = 'purchase'))
"""

# Customer edits with key changes: keys that a key change names are simulated
# together, edit by edit in the order of seq, the others each on its own.
KEY_CHANGE_CTES = f""",
m_klog AS (
  SELECT seq, CASE WHEN op = 'delete' AND seq % 40 = 0 THEN 'update' ELSE op END AS op,
         CASE WHEN op = 'insert' AND seq % 90 = 0 THEN NULL
              WHEN (op = 'delete' AND seq % 80 = 40) OR (op = 'update' AND seq % 30 = 7)
                THEN 900000000 + key // 3 ELSE key END AS key,
         CASE WHEN op = 'delete' AND seq % 40 = 0 THEN 'ID' ELSE property END AS property,
         CASE WHEN op = 'delete' AND seq % 40 = 0 THEN
           CASE WHEN seq % 600 = 0 THEN 'none' WHEN seq % 80 = 40 THEN CAST(key AS VARCHAR)
                WHEN seq % 240 = 0 THEN CAST(key + 1 AS VARCHAR)
                ELSE CAST(900000000 + key // 3 AS VARCHAR) END ELSE new_value END AS new_value,
         ins_first, ins_last, ins_mail, ins_phone
  FROM m_clog),
m_linked AS (
  SELECT key AS k FROM m_klog WHERE property = 'ID' AND TRY_CAST(new_value AS BIGINT) IS NOT NULL
  UNION
  SELECT TRY_CAST(new_value AS BIGINT) FROM m_klog
  WHERE property = 'ID' AND TRY_CAST(new_value AS BIGINT) IS NOT NULL),
m_apart AS (SELECT * FROM m_klog WHERE key IS NOT NULL AND key NOT IN (SELECT k FROM m_linked)),
{_per_key('m_apart')}
m_steps AS (
  SELECT *, CASE WHEN property = 'ID' THEN TRY_CAST(new_value AS BIGINT) END AS new_id,
         row_number() OVER (ORDER BY seq) AS n
  FROM m_klog WHERE key IN (SELECT k FROM m_linked)),
m_begin AS (
  SELECT coalesce(list({{'k': ID, 'f': first_name, 'l': last_name, 'm': e_mail, 'p': phone_num}}), []) AS live
  FROM m_customer WHERE ID IN (SELECT k FROM m_linked)),
m_state AS (
  SELECT CAST(0 AS BIGINT) AS n, live, CAST(NULL AS BIGINT) AS bad FROM m_begin
  UNION ALL
  SELECT r.n,
         CASE WHEN r.op = 'insert' AND len(list_filter(s.live, lambda x: x.k = r.key)) = 0
                THEN list_append(s.live, {{'k': r.key, 'f': r.ins_first, 'l': r.ins_last, 'm': r.ins_mail, 'p': r.ins_phone}})
              WHEN r.op = 'delete' THEN list_filter(s.live, lambda x: x.k <> r.key)
              WHEN r.op = 'update' AND r.property = 'ID' THEN
                CASE WHEN r.new_id IS NOT NULL AND len(list_filter(s.live, lambda x: x.k = r.new_id)) = 0
                  THEN list_transform(s.live, lambda x: {{'k': CASE WHEN x.k = r.key THEN r.new_id ELSE x.k END,
                                                        'f': x.f, 'l': x.l, 'm': x.m, 'p': x.p}})
                  ELSE s.live END
              WHEN r.op = 'update' THEN list_transform(s.live, lambda x: {{'k': x.k,
                'f': CASE WHEN x.k = r.key AND r.property = 'first_name' THEN r.new_value ELSE x.f END,
                'l': CASE WHEN x.k = r.key AND r.property = 'last_name' THEN r.new_value ELSE x.l END,
                'm': CASE WHEN x.k = r.key AND r.property = 'e_mail' THEN r.new_value ELSE x.m END,
                'p': CASE WHEN x.k = r.key AND r.property = 'phone_num' THEN r.new_value ELSE x.p END}})
              ELSE s.live END,
         CASE WHEN r.new_id <> r.key AND len(list_filter(s.live, lambda x: x.k = r.key)) > 0
                   AND len(list_filter(s.live, lambda x: x.k = r.new_id)) > 0 THEN CAST(r.seq AS BIGINT) END
  FROM m_state s JOIN m_steps r ON r.n = s.n + 1)
"""

KEY_CHANGES = {
    "apply_customer_key_changes": """
SELECT * FROM m_customer
WHERE ID NOT IN (SELECT key FROM m_apart) AND ID NOT IN (SELECT k FROM m_linked)
UNION ALL
SELECT s.key AS ID, s.first_name, s.last_name, s.e_mail, s.phone_num
FROM m_apart_sim s JOIN m_apart_len k ON s.key = k.key AND s.rn = k.n
WHERE s.live
UNION ALL
SELECT u.x.k, u.x.f, u.x.l, u.x.m, u.x.p
FROM (SELECT unnest(live) AS x FROM m_state WHERE n = (SELECT max(n) FROM m_state)) u""",
    "customer_change_rejects": """
SELECT seq, 'missing key' AS reason FROM m_klog WHERE key IS NULL
UNION ALL
SELECT seq, 'invalid value' FROM m_klog WHERE property = 'ID' AND TRY_CAST(new_value AS BIGINT) IS NULL
UNION ALL
SELECT bad, 'key change' FROM m_state WHERE bad IS NOT NULL""",
}


CHANGES = {
    "apply_customer_changes": """
SELECT * FROM m_customer WHERE ID NOT IN (SELECT key FROM m_clog)
UNION ALL
SELECT s.key AS ID, s.first_name, s.last_name, s.e_mail, s.phone_num
FROM m_clog_sim s JOIN m_clog_len k ON s.key = k.key AND s.rn = k.n
WHERE s.live""",
    "update_event_properties": f"""
SELECT e.ID, coalesce(p.name, e.name) AS name, coalesce(p.type, e.type) AS type, e.location,
       coalesce(TRY_CAST(trim(p.datetime) AS TIMESTAMP), e.datetime) AS datetime,
       coalesce(CAST({money('p.general_price')} AS DECIMAL(10,2)), e.general_price)
         AS general_price,
       coalesce(CAST({money('p.vip_price')} AS DECIMAL(10,2)), e.vip_price) AS vip_price,
       coalesce(p.income, e.income) AS income, e.expense, e.details,
       coalesce(CAST(round({money('p.company_id')}, 0) AS BIGINT), e.company_id) AS company_id
FROM m_event e LEFT JOIN m_epiv p ON e.ID = p.key""",
    "event_update_rejects": "SELECT seq, reason FROM m_echeck WHERE reason IS NOT NULL",
    "insert_companies": """
SELECT * FROM m_company
UNION ALL
SELECT ID, name, location
FROM (SELECT CASE WHEN event_id % 7 <> 0 THEN event_id END AS seq, CAST(user_id AS BIGINT) AS ID,
             'Co' || CAST(event_id AS VARCHAR) AS name,
             'Loc' || CAST(event_id % 5 AS VARCHAR) AS location
      FROM events WHERE event_type = 'signup') i
WHERE ID NOT IN (SELECT ID FROM m_company)
QUALIFY row_number() OVER (PARTITION BY ID ORDER BY seq NULLS LAST, name, location) = 1""",
    "insert_tickets": f"""
SELECT ID, type, tickets_available, tickets_sold, price, event_id, distributer_id FROM m_ticket
UNION ALL
SELECT ID, type, tickets_available, tickets_sold, price, event_id, distributer_id
FROM ({TICKET_FORMS}) WHERE key_text IS NOT NULL AND ID IS NOT NULL AND tickets_sold IS NOT NULL
  AND ID NOT IN (SELECT ID FROM m_ticket)
QUALIFY row_number() OVER (PARTITION BY ID ORDER BY seq NULLS LAST, type, tickets_available, tickets_sold, price, event_id,
  distributer_id) = 1""",
    "insert_ticket_rejects": f"""
SELECT seq, CASE WHEN key_text IS NULL THEN 'missing key' ELSE 'invalid value' END AS reason
FROM ({TICKET_FORMS}) WHERE key_text IS NULL OR ID IS NULL OR tickets_sold IS NULL""",
    "insert_events": _inserted("m_event", "ID", "name, type, location, datetime, general_price, vip_price, income, "
                               "expense, details, company_id", EVENT_FORMS),
    "insert_event_rejects": _rejected(EVENT_FORMS),
    "insert_customers": _inserted("m_customer", "ID", "first_name, last_name, e_mail, phone_num", CUSTOMER_FORMS),
    "insert_customer_rejects": _rejected(CUSTOMER_FORMS),
    "insert_purchases": _inserted("m_purchase", "purchase_id", "customer_id, ticket_id, payment_type, purchase_date",
                                  PURCHASE_FORMS),
    "insert_purchase_rejects": _rejected(PURCHASE_FORMS),
    "insert_company_links": """
SELECT company_id, customer_id FROM m_cust_of
UNION
SELECT CAST(user_id * 7 % (SELECT count(*) FROM supplier) AS BIGINT), CAST(user_id AS BIGINT)
FROM events WHERE event_type = 'click'""",
    "delete_companies": """
SELECT * FROM m_company
WHERE ID NOT IN (SELECT event_id FROM events WHERE event_type = 'error')""",
    "update_customers": """
SELECT c.ID,
       CASE WHEN u.ID IS NULL THEN c.first_name ELSE u.first_name END AS first_name,
       CASE WHEN u.ID IS NULL THEN c.last_name ELSE u.last_name END AS last_name,
       CASE WHEN u.ID IS NULL THEN c.e_mail ELSE u.e_mail END AS e_mail,
       CASE WHEN u.ID IS NULL THEN c.phone_num ELSE u.phone_num END AS phone_num
FROM m_customer c LEFT JOIN (
  SELECT CAST(user_id AS BIGINT) AS ID,
         arg_max('P' || CAST(event_id AS VARCHAR), event_id) AS first_name,
         arg_max('Q' || CAST(event_id AS VARCHAR), event_id) AS last_name,
         arg_max('p' || CAST(event_id AS VARCHAR) || '@mail.com', event_id) AS e_mail,
         arg_max(lpad(CAST(event_id AS VARCHAR), 10, '8'), event_id) AS phone_num
  FROM events WHERE event_type = 'view' GROUP BY user_id) u ON c.ID = u.ID""",
    "update_distributer_properties": """
SELECT d.ID, coalesce(u.name, d.name) AS name, coalesce(u.location, d.location) AS location
FROM m_distributer d LEFT JOIN (
  SELECT user_id % 25 AS ID,
         arg_max('D' || CAST(event_id AS VARCHAR), event_id) FILTER (WHERE event_id % 2 = 0)
           AS name,
         arg_max('D' || CAST(event_id AS VARCHAR), event_id) FILTER (WHERE event_id % 2 = 1)
           AS location
  FROM events WHERE event_type = 'view' GROUP BY user_id % 25) u ON d.ID = u.ID""",
    "rename_distributers": _one_by_one("m_distributer", ["name", "location"], """
    SELECT event_id AS seq, user_id % 25 AS old_id, 25 + event_id % 40 AS new_id
    FROM events WHERE event_type = 'error'"""),
    "rename_rejects": _one_by_one_rejects("m_distributer", """
    SELECT event_id AS seq, user_id % 25 AS old_id, 25 + event_id % 40 AS new_id
    FROM events WHERE event_type = 'error'"""),
    "update_company_properties": """
SELECT d.ID, coalesce(u.name, d.name) AS name, coalesce(u.location, d.location) AS location
FROM m_company d LEFT JOIN (
  SELECT user_id AS ID,
         arg_max('K' || CAST(event_id AS VARCHAR), event_id) FILTER (WHERE event_id % 2 = 0) AS name,
         arg_max('K' || CAST(event_id AS VARCHAR), event_id) FILTER (WHERE event_id % 2 = 1) AS location
  FROM events WHERE event_type = 'click' GROUP BY user_id) u ON d.ID = u.ID""",
    "ticket_edit_rejects": f"""
SELECT seq, 'invalid value' AS reason FROM m_tedit
WHERE (property = 'price' AND TRY_CAST({money('v')} AS DECIMAL(10,2)) IS NULL)
   OR (property IN ('tickets_available', 'tickets_sold') AND TRY_CAST(round({money('v')}, 0) AS INTEGER) IS NULL)
   OR (property IN ('event_id', 'distributer_id') AND TRY_CAST(round({money('v')}, 0) AS BIGINT) IS NULL)""",
    "cust_of_delete_rejects": """
SELECT seq, pair_text, 'invalid pair' AS reason FROM m_pairs WHERE len(string_split(pair_text, ',')) <> 2""",
    "update_ticket_properties": f"""
SELECT t.ID, coalesce(u.type, t.type) AS type,
       coalesce(CAST(round({money('u.tickets_available')}, 0) AS INTEGER), t.tickets_available)
         AS tickets_available,
       coalesce(CAST(round({money('u.tickets_sold')}, 0) AS INTEGER), t.tickets_sold)
         AS tickets_sold,
       coalesce(CAST({money('u.price')} AS DECIMAL(10,2)), t.price) AS price,
       coalesce(CAST(round({money('u.event_id')}, 0) AS BIGINT), t.event_id) AS event_id,
       coalesce(CAST(round({money('u.distributer_id')}, 0) AS BIGINT), t.distributer_id)
         AS distributer_id
FROM m_ticket t LEFT JOIN (
  SELECT key,
         arg_max(v, seq) FILTER (WHERE property = 'type') AS type,
         arg_max(v, seq) FILTER (WHERE property = 'tickets_available') AS tickets_available,
         arg_max(v, seq) FILTER (WHERE property = 'tickets_sold') AS tickets_sold,
         arg_max(v, seq) FILTER (WHERE property = 'price') AS price,
         arg_max(v, seq) FILTER (WHERE property = 'event_id') AS event_id,
         arg_max(v, seq) FILTER (WHERE property = 'distributer_id') AS distributer_id
  FROM m_tedit
  WHERE property = 'type'
     OR (property = 'price' AND TRY_CAST({money('v')} AS DECIMAL(10,2)) IS NOT NULL)
     OR (property IN ('tickets_available', 'tickets_sold')
         AND TRY_CAST(round({money('v')}, 0) AS INTEGER) IS NOT NULL)
     OR (property IN ('event_id', 'distributer_id')
         AND TRY_CAST(round({money('v')}, 0) AS BIGINT) IS NOT NULL)
  GROUP BY key) u ON t.ID = u.key""",
    "rekey_events": _one_by_one("m_event", ["name", "type", "location", "datetime", "general_price", "vip_price",
                                            "income", "expense", "details", "company_id"], f"""
    SELECT seq, key AS old_id, TRY_CAST(round({money('v')}, 0) AS BIGINT) AS new_id
    FROM m_tedit WHERE property = 'event_id'"""),
    "delete_purchases": """
SELECT * FROM m_purchase WHERE purchase_id NOT IN (SELECT purchase_id FROM m_pdel)""",
    "delete_purchase_tickets": """
SELECT * FROM m_ticket WHERE ID NOT IN (
  SELECT ticket_id FROM m_purchase
  WHERE purchase_id IN (SELECT purchase_id FROM m_pdel) AND ticket_id IS NOT NULL)""",
    "delete_cust_of": """
SELECT * FROM m_cust_of c WHERE NOT EXISTS (
  SELECT 1 FROM m_pairs_ok p WHERE p.company_id = c.company_id AND p.customer_id = c.customer_id)""",
    "delete_cust_of_customers": """
SELECT * FROM m_customer WHERE ID NOT IN (SELECT customer_id FROM m_pairs_ok)""",
}


TABLE_COLUMNS = {
    "event_catalog": ("m_event", "ID name type location datetime general_price vip_price income expense details "
                      "company_id"),
    "company": ("m_company", "ID name location"),
    "distributer": ("m_distributer", "ID name location"),
    "customer": ("m_customer", "ID first_name last_name e_mail phone_num"),
    "ticket": ("m_ticket", "ID type tickets_available tickets_sold price event_id distributer_id"),
    "purchase": ("m_purchase", "purchase_id customer_id ticket_id payment_type purchase_date"),
    "cust_of": ("m_cust_of", "company_id customer_id"),
}
LISTED = {name: (f"SELECT * FROM {table}", columns) for name, (table, columns) in TABLE_COLUMNS.items()}


def _page(parts: dict[str, tuple[str, str]]) -> str:
    """A page's reports as (report, line) rows: the columns' texts joined."""
    def line(columns: str) -> str:
        return "concat_ws('|', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '-')" for c in columns.split()) + ")"
    return "\nUNION ALL\n".join(f"SELECT '{name}' AS report, {line(columns)} AS line FROM ({body})"
                                for name, (body, columns) in parts.items())


BUNDLES = {
    "admin_bundle": _page({
        "most_spending_customer": (REPORTS["top_customer_price_count"], "CustomerID CustomerName TotalSpent"),
        "top_revenue_events": (REPORTS["event_revenue"], "ID EventName TotalRevenue"),
        "company_most_event_types": (REPORTS["company_most_events"], "CompanyID CompanyName EventTypeCount"),
        "company_most_customers": (REPORTS["company_most_tickets"], "CompanyID CompanyName TotalTicketsSold"),
        "company_sales_ranking": (REPORTS["company_sales_ranking"], "CompanyID CompanyName TotalRevenue"),
        "customer_loyalty": (REPORTS["customer_loyalty"], "CustomerID CustomerName CompanyID CompanyName PurchaseCount"),
        "event_type_popularity": (REPORTS["event_type_popularity"], "EventType TotalTicketsSold"),
    } | LISTED),
    "manager_bundle": _page({
        "top_revenue_events": (REPORTS["event_revenue_names"], "EventName TotalRevenue"),
        "company_most_event_types": (REPORTS["company_most_events"], "CompanyName EventTypeCount"),
        "company_sales_ranking": (REPORTS["company_sales_ranking"], "CompanyName TotalRevenue"),
        "customer_loyalty": (REPORTS["customer_loyalty"], "CustomerName CompanyName PurchaseCount"),
        "event_type_popularity": (REPORTS["event_type_popularity"], "EventType TotalTicketsSold"),
        "events": (REPORTS["event_listing"], "ID name type location datetime general_price vip_price income expense "
                   "details company_name"),
        "distributers": LISTED["distributer"],
    }),
    "public_bundle": _page({
        "events": (LISTINGS["event_cards"], "name location type datetime general_price vip_price details"),
        "event_types_ranked": (REPORTS["event_type_popularity"], "EventType TotalTicketsSold"),
    }),
}


def _moves(prop: str) -> str:
    return f"""
    SELECT seq, key AS old_id, TRY_CAST(round({money('v')}, 0) AS BIGINT) AS new_id
    FROM m_tedit WHERE property = '{prop}'"""


PARENT_MOVES = """
    SELECT event_id AS seq, event_id % (SELECT count(*) FROM part) AS old_id,
           CASE WHEN event_id % 37 <> 0 THEN (SELECT count(*) FROM part) + user_id % 200 END AS new_id
    FROM events WHERE event_type = 'purchase' AND event_id % 3 = 0"""
CHANGES["rekey_rejects"] = _one_by_one_rejects("m_event", PARENT_MOVES) + f"""
UNION ALL SELECT seq, 'invalid value' AS reason FROM ({PARENT_MOVES}) WHERE new_id IS NULL"""

# Cascades in one log: the last edit of a pair by seq decides; tickets of deleted
# purchases go whatever was edited; parents move one by one.
CASCADES = _page({
    "purchase": (CHANGES["delete_purchases"], TABLE_COLUMNS["purchase"][1]),
    "ticket": (f"""SELECT * FROM ({CHANGES["update_ticket_properties"]}) WHERE ID IN (
      SELECT ID FROM ({CHANGES["delete_purchase_tickets"]}))""", TABLE_COLUMNS["ticket"][1]),
    "cust_of": ("""
WITH edits AS (
  SELECT seq, CAST(split_part(pair_text, ',', 1) AS BIGINT) AS company_id,
         CAST(split_part(pair_text, ',', 2) AS BIGINT) AS customer_id, false AS linked
  FROM m_pairs WHERE len(string_split(pair_text, ',')) = 2
  UNION ALL
  SELECT event_id, CAST(user_id * 7 % (SELECT count(*) FROM supplier) AS BIGINT), CAST(user_id AS BIGINT), true
  FROM events WHERE event_type = 'click'),
last_edit AS (SELECT company_id, customer_id, arg_max(linked, seq) AS linked FROM edits GROUP BY company_id, customer_id)
SELECT company_id, customer_id FROM m_cust_of ANTI JOIN last_edit USING (company_id, customer_id)
UNION ALL SELECT company_id, customer_id FROM last_edit WHERE linked""", TABLE_COLUMNS["cust_of"][1]),
    "customer": (CHANGES["delete_cust_of_customers"], TABLE_COLUMNS["customer"][1]),
    "event_catalog": (CHANGES["rekey_events"], TABLE_COLUMNS["event_catalog"][1]),
    "distributer": (_one_by_one("m_distributer", ["name", "location"], _moves("distributer_id")),
                    TABLE_COLUMNS["distributer"][1]),
    "rejects": (f"""
{CHANGES["ticket_edit_rejects"]}
UNION ALL SELECT seq, reason FROM ({CHANGES["cust_of_delete_rejects"]})
UNION ALL {_one_by_one_rejects("m_event", _moves("event_id"))}
UNION ALL {_one_by_one_rejects("m_distributer", _moves("distributer_id"))}""", "seq reason"),
})


def all_sql() -> dict[str, str]:
    out = {}
    for group in (REPORTS, LISTINGS, LOOKUPS, BUNDLES):
        for k, body in group.items():
            out[k] = q(body)
    for k, body in INTAKE.items():
        out[k] = PRELUDE + INTAKE_CTES + body
    recursive = PRELUDE.replace("WITH\n", "WITH RECURSIVE\n", 1)
    for k, body in CHANGES.items():
        out[k] = recursive + CHANGE_CTES + body
    for k, body in KEY_CHANGES.items():
        out[k] = recursive + CHANGE_CTES + KEY_CHANGE_CTES + body
    out["table_cascades_stream"] = recursive + CHANGE_CTES + CASCADES
    # The streams deliver what their batch counterparts compute.
    out["purchase_intake_stream"] = out["new_purchases"]
    out["table_changes_stream"] = out["apply_customer_changes"]
    return out
