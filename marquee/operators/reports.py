"""The seven dashboard reports (nine texts) and the enriched event listing.

Plan shape shared by all of them: where grouping shrinks the fact side
(tickets per event, income per company) aggregate it on its join key first
-- partial aggregation runs map-side, so a hot event collapses to one row
per task before any shuffle -- then join the small result to the dimension
on a unique key, and attach display names last. Join strategy is left to AQE, which broadcasts a side only when its
measured shuffle output is below ``spark.sql.adaptive.autoBroadcastJoinThreshold``
and otherwise keeps a sort-merge join (with skew splitting).
Top-k reports end in ``orderBy(...).limit(k)``, planned as
TakeOrderedAndProject (per-partition top-k, then a k*partitions merge).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions.semantics import ci_key, full_name, report_price, with_lenient_decimal
from marquee.tables import Tables


def _events(t: Tables, *cols: str) -> DataFrame:
    return t.event_catalog.select(F.col("ID").alias("event_id"), *cols)


def tickets_per_event(t: Tables) -> DataFrame:
    """COUNT(T.event_id) per event, computed before any join (shared by R1
    and R7)."""
    return (t.ticket.where(F.col("event_id").isNotNull())
            .groupBy("event_id").agg(F.count("event_id").alias("n_tickets")))


def purchase_tickets(t: Tables) -> DataFrame:
    """Purchase ⋈ TICKET with the ticket columns the reports need (shared
    by R2, R3 and R9)."""
    return _purchase_tickets(t, "type", "price", "event_id")


def _shared(shared: dict | None, name: str, build):
    if shared is not None and name in shared:
        return shared[name]
    return build()


def _customer_names(t: Tables) -> DataFrame:
    return t.customer.select(F.col("ID").alias("CustomerID"),
                             full_name("first_name", "last_name").alias("CustomerName"))


def _company_names(t: Tables) -> DataFrame:
    return t.company.select(F.col("ID").alias("CompanyID"), F.col("name").alias("CompanyName"))


def _purchase_tickets(t: Tables, *ticket_cols: str) -> DataFrame:
    """Purchase ⋈ TICKET on ticket_id = ID (inner: orphans drop out)."""
    return (t.purchase.select("purchase_id", "customer_id", "ticket_id")
            .join(t.ticket.select(F.col("ID").alias("ticket_id"), *ticket_cols), "ticket_id"))


def event_type_popularity(t: Tables, shared: dict | None = None) -> DataFrame:
    """Ticket rows per event type (types compared case/accent-
    insensitively, label = smallest spelling), most first."""
    per_event = (_shared(shared, "tickets_per_event", lambda: tickets_per_event(t))
                 .join(_events(t, "type"), "event_id"))
    # Sum per exact spelling first (hash aggregation on the text), then fold
    # the few spellings by the collated key; the string min runs on those.
    per_spelling = per_event.groupBy("type").agg(F.sum("n_tickets").alias("n"))
    return (per_spelling.groupBy(ci_key("type").alias("_type_key"))
            .agg(F.min("type").alias("EventType"),
                 F.sum("n").cast("bigint").alias("TotalTicketsSold"))
            .select("EventType", "TotalTicketsSold")
            .orderBy(F.col("TotalTicketsSold").desc_nulls_last(), F.col("EventType").asc_nulls_first()))


def top_customer_by_class(t: Tables, k: int = 1, shared: dict | None = None) -> DataFrame:
    """R2: top spender, each purchase valued at its event's VIP price when
    the ticket type is ``vip`` (any case), else the general price."""
    priced = (_shared(shared, "purchase_tickets", lambda: _purchase_tickets(t, "type", "event_id"))
              .join(_events(t, "general_price", "vip_price"), "event_id")
              .select(F.col("customer_id").alias("CustomerID"),
                      report_price("type", "general_price", "vip_price").alias("p")))
    spent = priced.groupBy("CustomerID").agg(F.sum("p").cast("decimal(38,2)").alias("TotalSpent"))
    return (spent.join(_customer_names(t), "CustomerID")
            .select("CustomerID", "CustomerName", "TotalSpent")
            .orderBy(F.col("TotalSpent").desc_nulls_last(), F.col("CustomerID").asc())
            .limit(k))


def top_customer_price_count(t: Tables, k: int = 1, shared: dict | None = None) -> DataFrame:
    """Top spender by SUM(ticket price) * COUNT(purchases) per customer
    (the reference's formula, kept as is)."""
    per_customer = (_shared(shared, "purchase_tickets", lambda: _purchase_tickets(t, "price"))
                    .groupBy(F.col("customer_id").alias("CustomerID"))
                    .agg(F.sum("price").alias("s"), F.count("purchase_id").alias("c")))
    return (per_customer.join(_customer_names(t), "CustomerID")
            .select("CustomerID", "CustomerName",
                    (F.col("s") * F.col("c")).cast("decimal(38,2)").alias("TotalSpent"))
            .orderBy(F.col("TotalSpent").desc_nulls_last(), F.col("CustomerID").asc())
            .limit(k))


def _revenue(t: Tables) -> DataFrame:
    return with_lenient_decimal(t.event_catalog.select("ID", F.col("name").alias("EventName"),
                                                       "income"),
                                "income", "TotalRevenue")


def event_revenue(t: Tables) -> DataFrame:
    """Every event with its income read as a number, highest first."""
    return (_revenue(t).select("ID", "EventName", "TotalRevenue")
            .orderBy(F.col("TotalRevenue").desc_nulls_last(), F.col("ID").asc()))


def event_revenue_names(t: Tables) -> DataFrame:
    """R4 without the ID column (manager pages)."""
    return (_revenue(t)
            .orderBy(F.col("TotalRevenue").desc_nulls_last(), F.col("ID").asc())
            .select("EventName", "TotalRevenue"))


def company_most_events(t: Tables, k: int = 1) -> DataFrame:
    """Company with the most events; COUNT(type) counts non-NULL types,
    not distinct ones."""
    per_company = (t.event_catalog.where(F.col("company_id").isNotNull())
                   .groupBy(F.col("company_id").alias("CompanyID"))
                   .agg(F.count("type").alias("EventTypeCount")))
    return (per_company.join(_company_names(t), "CompanyID")
            .select("CompanyID", "CompanyName", "EventTypeCount")
            .orderBy(F.col("EventTypeCount").desc_nulls_last(), F.col("CompanyID").asc())
            .limit(k))


def company_most_tickets(t: Tables, k: int = 1, shared: dict | None = None) -> DataFrame:
    """Company with the most ticket rows over its events."""
    per_company = (_shared(shared, "tickets_per_event", lambda: tickets_per_event(t))
                   .join(_events(t, "company_id").where(F.col("company_id").isNotNull()), "event_id")
                   .groupBy(F.col("company_id").alias("CompanyID"))
                   .agg(F.sum("n_tickets").cast("bigint").alias("TotalTicketsSold")))
    return (per_company.join(_company_names(t), "CompanyID")
            .select("CompanyID", "CompanyName", "TotalTicketsSold")
            .orderBy(F.col("TotalTicketsSold").desc_nulls_last(), F.col("CompanyID").asc())
            .limit(k))


def company_sales_ranking(t: Tables) -> DataFrame:
    """Every company with the sum of its events' numeric income; NULL
    for companies without events, ranked last."""
    incomes = with_lenient_decimal(
        t.event_catalog.where(F.col("company_id").isNotNull()).select("company_id", "income"),
        "income", "_rev")
    per_company = (incomes.groupBy(F.col("company_id").alias("CompanyID"))
                   .agg(F.sum("_rev").alias("rev")))
    return (_company_names(t).join(per_company, "CompanyID", "left")
            .select("CompanyID", "CompanyName",
                    F.col("rev").cast("decimal(38,0)").alias("TotalRevenue"))
            .orderBy(F.col("TotalRevenue").desc_nulls_last(), F.col("CompanyID").asc()))


def customer_loyalty(t: Tables, shared: dict | None = None) -> DataFrame:
    """Purchases per (customer, company), counted on ids first and
    named last (ids are unique keys, so this equals grouping by names).
    The purchase rows meet the event's company first and are then counted
    with map-side partial aggregation; a separate (customer, event)
    pre-count would cost a full extra shuffle for little reduction, since
    repeat purchases of one event by one customer are rare."""
    pt = _shared(shared, "purchase_tickets", lambda: _purchase_tickets(t, "event_id"))
    per_company = (pt.select("purchase_id", "customer_id", "event_id")
                   .join(_events(t, "company_id").where(F.col("company_id").isNotNull()), "event_id")
                   .groupBy(F.col("customer_id").alias("CustomerID"),
                            F.col("company_id").alias("CompanyID"))
                   .agg(F.count("purchase_id").alias("PurchaseCount")))
    return (per_company.join(_customer_names(t), "CustomerID")
            .join(_company_names(t), "CompanyID")
            .select("CustomerID", "CustomerName", "CompanyID", "CompanyName", "PurchaseCount")
            .orderBy("CustomerID", "CompanyID"))


def event_listing(t: Tables) -> DataFrame:
    """Events with the company name in place of company_id; events
    without a (known) company drop out."""
    comp = t.company.select(F.col("ID").alias("company_id"), F.col("name").alias("company_name"))
    return (t.event_catalog.join(comp, "company_id")
            .select("ID", "name", "type", "location", "datetime", "general_price", "vip_price",
                    "income", "expense", "details", "company_name"))
