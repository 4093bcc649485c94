"""Explicit schemas of the seven ticketing tables and of the request and
change rows. Nothing is inferred at read time."""

from pyspark.sql.types import (DecimalType, IntegerType, LongType, StringType,
                               StructField, StructType, TimestampNTZType)

MONEY = DecimalType(10, 2)


def _s(*fields):
    return StructType([StructField(n, t, True) for n, t in fields])


EVENT_CATALOG = _s(("ID", LongType()), ("name", StringType()), ("type", StringType()),
                   ("location", StringType()), ("datetime", TimestampNTZType()),
                   ("general_price", MONEY), ("vip_price", MONEY),
                   ("income", StringType()), ("expense", StringType()),
                   ("details", StringType()), ("company_id", LongType()))
COMPANY = _s(("ID", LongType()), ("name", StringType()), ("location", StringType()))
DISTRIBUTER = _s(("ID", LongType()), ("name", StringType()), ("location", StringType()))
CUSTOMER = _s(("ID", LongType()), ("first_name", StringType()), ("last_name", StringType()),
              ("e_mail", StringType()), ("phone_num", StringType()))
TICKET = _s(("ID", LongType()), ("type", StringType()), ("tickets_available", IntegerType()),
            ("tickets_sold", IntegerType()), ("price", MONEY), ("event_id", LongType()),
            ("distributer_id", LongType()))
PURCHASE = _s(("purchase_id", LongType()), ("customer_id", LongType()), ("ticket_id", LongType()),
              ("payment_type", StringType()), ("purchase_date", TimestampNTZType()))
CUST_OF = _s(("company_id", LongType()), ("customer_id", LongType()))

TABLE_SCHEMAS = {
    "event_catalog": EVENT_CATALOG,
    "company": COMPANY,
    "distributer": DISTRIBUTER,
    "customer": CUSTOMER,
    "ticket": TICKET,
    "purchase": PURCHASE,
    "cust_of": CUST_OF,
}

# Primary key column of each table (cust_of is keyed by both columns).
TABLE_KEYS = {
    "event_catalog": ["ID"],
    "company": ["ID"],
    "distributer": ["ID"],
    "customer": ["ID"],
    "ticket": ["ID"],
    "purchase": ["purchase_id"],
    "cust_of": ["company_id", "customer_id"],
}

# One purchase form submission.
PURCHASE_REQUEST = _s(("request_id", LongType()), ("requested_at", TimestampNTZType()),
                      ("first_name", StringType()), ("last_name", StringType()),
                      ("e_mail", StringType()), ("phone_num", StringType()),
                      ("event_id", LongType()), ("ticket_type", StringType()),
                      ("payment_type", StringType()))

# One edit of several tables at once (see ``changes.cascade_marks``).
CASCADE_CHANGE = _s(("seq", LongType()), ("op", StringType()), ("key", LongType()), ("property", StringType()),
                    ("new_value", StringType()))

# One row edit. ``key`` is the target row's key as text, ``row`` the full row
# for inserts (a struct shaped like the table), ``property``/``new_value``
# for updates.
def change_schema(table_schema: StructType) -> StructType:
    return StructType([
        StructField("seq", LongType(), True),
        StructField("op", StringType(), True),
        StructField("key", LongType(), True),
        StructField("property", StringType(), True),
        StructField("new_value", StringType(), True),
        StructField("row", table_schema, True),
    ])
