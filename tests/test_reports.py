"""Report semantics on hand-written tables with known answers, plus the
"""

import datetime as dt
from decimal import Decimal

import pytest

from marquee import schemas as S
from marquee.operators import reports
from marquee.sources import testdata as td
from marquee.tables import Tables

SF = "/root/testdata/sf0.01"
T0 = dt.datetime(2024, 1, 1)


def make_tables(spark, events=(), companies=(), customers=(), tickets=(), purchases=(),
                distributers=(), cust_of=()):
    return Tables(
        event_catalog=spark.createDataFrame(list(events), S.EVENT_CATALOG),
        company=spark.createDataFrame(list(companies), S.COMPANY),
        distributer=spark.createDataFrame(list(distributers), S.DISTRIBUTER),
        customer=spark.createDataFrame(list(customers), S.CUSTOMER),
        ticket=spark.createDataFrame(list(tickets), S.TICKET),
        purchase=spark.createDataFrame(list(purchases), S.PURCHASE),
        cust_of=spark.createDataFrame(list(cust_of), S.CUST_OF),
    )


def ev(i, type_="Concert", income=None, company=None, gp="10.00", vp="20.00"):
    return (i, f"e{i}", type_, "loc", T0, Decimal(gp), Decimal(vp), income, None, None, company)


def tk(i, event, type_="General", price="10.00"):
    return (i, type_, 100, 1, Decimal(price), event, 1)


def pu(i, customer, ticket):
    return (i, customer, ticket, "Cash", T0)


@pytest.fixture(scope="module")
def small(spark):
    return make_tables(
        spark,
        events=[ev(1, "Concert", "12.5", 10), ev(2, "concert", "N/A", 10),
                ev(3, "Opera", "100 USD", 20), ev(4, "Opera", None, 20), ev(5, "Opera", "7", 20)],
        companies=[(10, "Alpha", "X"), (20, "Beta", "Y"), (30, "Gamma", "Z")],
        customers=[(1, "Ann", "Lee", "a@x.com", "5550000001"),
                   (2, "Bob", None, "b@x.com", "5550000002")],
        tickets=[tk(100, 1, "VIP", "10.00"), tk(101, 2, "vip", "20.00"), tk(102, 3)],
        purchases=[pu(1, 1, 100), pu(2, 1, 101), pu(3, 2, 102), pu(4, 2, 999)],
    )


def test_r1_groups_types_case_insensitively(small):
    rows = reports.event_type_popularity(small).collect()
    assert [(r.EventType, r.TotalTicketsSold) for r in rows] == [("Concert", 2), ("Opera", 1)]


def test_r2_values_by_class_and_drops_orphans(small):
    row = reports.top_customer_by_class(small).collect()[0]
    # Ann: two vip tickets at vip price 20 each; Bob: one general ticket (10), orphan ignored
    assert (row.CustomerID, row.CustomerName, row.TotalSpent) == (1, "Ann Lee", Decimal("40.00"))


def test_r3_is_sum_times_count(small):
    row = reports.top_customer_price_count(small).collect()[0]
    assert (row.CustomerID, row.TotalSpent) == (1, Decimal("60.00"))  # (10 + 20) * 2


def test_r3_null_name_t5(spark):
    t = make_tables(spark, events=[ev(1)], customers=[(2, "Bob", None, "b@x.com", "1")],
                    tickets=[tk(100, 1)], purchases=[pu(1, 2, 100)])
    row = reports.top_customer_price_count(t).collect()[0]
    assert row.CustomerName is None


def test_r4_lenient_income_sorted(small):
    rows = reports.event_revenue(small).collect()
    assert [(r.ID, r.TotalRevenue) for r in rows] == [
        (3, 100), (1, 13), (5, 7), (2, 0), (4, None)]


def test_r6_counts_rows_not_distinct_types_and_ties_to_lower_id(spark):
    t = make_tables(spark, events=[ev(1, "Opera", company=20), ev(2, "Opera", company=20),
                                   ev(3, "Opera", company=20), ev(4, "A", company=10),
                                   ev(5, "B", company=10), ev(6, "C", company=10)],
                    companies=[(10, "Alpha", "X"), (20, "Beta", "Y")])
    row = reports.company_most_events(t).collect()[0]
    assert (row.CompanyID, row.EventTypeCount) == (10, 3)  # tie 3-3 -> lower id (T6)


def test_r7_counts_ticket_rows(small):
    row = reports.company_most_tickets(small).collect()[0]
    assert (row.CompanyID, row.CompanyName, row.TotalTicketsSold) == (10, "Alpha", 2)


def test_r8_null_for_company_without_events_last(small):
    rows = reports.company_sales_ranking(small).collect()
    assert [(r.CompanyID, r.TotalRevenue) for r in rows] == [(20, 107), (10, 13), (30, None)]


def test_r9_counts_per_customer_company(small):
    rows = reports.customer_loyalty(small).collect()
    assert [(r.CustomerID, r.CompanyID, r.PurchaseCount) for r in rows] == [(1, 10, 2), (2, 20, 1)]
    assert rows[1].CustomerName is None


def test_e1_drops_events_without_company(spark):
    t = make_tables(spark, events=[ev(1, company=10), ev(2, company=None), ev(3, company=99)],
                    companies=[(10, "Alpha", "X")])
    rows = reports.event_listing(t).collect()
    assert [(r.ID, r.company_name) for r in rows] == [(1, "Alpha")]


def test_properties_on_driver_data(spark):
    t = td.load_tables(spark, SF)
    r1_total = reports.event_type_popularity(t).groupBy().sum("TotalTicketsSold").collect()[0][0]
    live_tickets = t.ticket.join(t.event_catalog.selectExpr("ID AS event_id"), "event_id").count()
    assert r1_total == live_tickets
    r9_total = reports.customer_loyalty(t).groupBy().sum("PurchaseCount").collect()[0][0]
    full = (t.purchase.join(t.customer.selectExpr("ID AS customer_id"), "customer_id")
            .join(t.ticket.selectExpr("ID AS ticket_id", "event_id"), "ticket_id")
            .join(t.event_catalog.selectExpr("ID AS event_id", "company_id"), "event_id")
            .join(t.company.selectExpr("ID AS company_id"), "company_id").count())
    assert r9_total == full
    assert reports.company_sales_ranking(t).count() == t.company.count()


def test_customer_profile_blanks_f5(spark, small):
    from marquee.operators import lookups
    ids = spark.createDataFrame([(1, 1), (2, 42), (3, None)], "visit_id int, customer_id bigint")
    got = {r.visit_id: (r.first_name, r.last_name, r.e_mail, r.phone_num)
           for r in lookups.customer_profile(ids, small.customer).collect()}
    assert got[1] == ("Ann", "Lee", "a@x.com", "5550000001")
    assert got[2] == ("", "", "", "") and got[3] == ("", "", "", "")
