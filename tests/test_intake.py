"""Purchase intake: known answers and conservation properties."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from marquee import schemas as S
from marquee.functions.semantics import EMAIL_ERROR, PHONE_ERROR, UNKNOWN_EVENT_ERROR
from marquee.operators import intake
from marquee.operators.keys import dense_rank_by
from marquee.sources import testdata as td
from test_reports import ev, make_tables, pu, tk

SF = "/root/testdata/sf0.01"
T0 = dt.datetime(2024, 5, 1)


def req(i, first, last, mail, phone, event, ticket_type="General", pay="Cash"):
    return (i, T0 + dt.timedelta(minutes=i), first, last, mail, phone, event, ticket_type, pay)


def base(spark):
    return make_tables(
        spark,
        events=[ev(1, company=10, gp="10.00", vp="25.00"), ev(2, company=None)],
        companies=[(10, "Alpha", "X")],
        customers=[(5, "Old", "Name", "known@x.com", "5550000005")],
        tickets=[tk(40, 1)], purchases=[pu(70, 5, 40)], cust_of=[(10, 5)])


def test_intake_known_answers(spark):
    t = base(spark)
    requests = spark.createDataFrame([
        req(1, "New", "Name", "KNOWN@x.com", "5551112222", 1, "VIP"),      # known e-mail, other case
        req(2, "Zed", "Z", "zed@x.com", "5551112223", 1, "General"),
        req(3, "Zed2", "Z", "ZED@x.com", "5551112224", 2, "Select Ticket Type"),  # same new mail
        req(4, "Bad", "Phone", "p@x.com", "12345", 1),
        req(5, "Bad", "Mail", "m@x.org", "5551112225", 1),
        req(6, "Lost", "Event", "lost@x.com", "5551112226", 42),          # unknown event
    ], S.PURCHASE_REQUEST)
    res = intake.purchase_intake(requests, t)
    rejects = {r.request_id: r.reject_reason for r in res.rejects.collect()}
    assert rejects == {4: PHONE_ERROR, 5: EMAIL_ERROR, 6: UNKNOWN_EVENT_ERROR}
    # one new customer per new e-mail, named from its first request; the
    # unknown-event request still creates its customer
    new_c = sorted((r.ID, r.first_name, r.e_mail) for r in res.new_customers.collect())
    assert new_c == [(6, "Zed", "zed@x.com"), (7, "Lost", "lost@x.com")]
    tickets = sorted((r.ID, r.type, r.price, r.event_id, r.distributer_id)
                     for r in res.new_tickets.collect())
    assert tickets == [(41, "VIP", Decimal("25.00"), 1, 2), (42, "General", Decimal("10.00"), 1, 3),
                       (43, "Select Ticket Type", Decimal("20.00"), 2, 4)]
    purchases = sorted((r.purchase_id, r.customer_id, r.ticket_id, r.purchase_date)
                       for r in res.new_purchases.collect())
    assert [p[:3] for p in purchases] == [(71, 5, 41), (72, 6, 42), (73, 6, 43)]
    assert purchases[0][3] == T0 + dt.timedelta(minutes=1)
    # known customer keeps id and name; (10, 5) already linked; event 2 has no company
    assert sorted((r.company_id, r.customer_id) for r in res.new_cust_of.collect()) == [(10, 6)]


def test_conservation_on_driver_data(spark):
    t = td.load_tables(spark, SF)
    requests = td.purchase_requests(spark, SF)
    res = intake.purchase_intake(requests, t, persist=True)
    try:
        n_req = requests.count()
        n_rej = res.rejects.count()
        n_pur = res.new_purchases.count()
        assert n_req == n_rej + n_pur
        assert res.new_tickets.count() == n_pur
        # ids are dense and continue after the current maxima
        stats = res.new_tickets.agg(F.min("ID"), F.max("ID"), F.countDistinct("ID")).collect()[0]
        base_max = t.ticket.agg(F.max("ID")).collect()[0][0]
        assert (stats[0], stats[1], stats[2]) == (base_max + 1, base_max + n_pur, n_pur)
        # every purchase points at its own new ticket and at a live customer
        after = intake.apply_intake(t, res)
        assert res.new_purchases.join(after.customer.selectExpr("ID AS customer_id"),
                                      "customer_id", "left_anti").count() == 0
        assert res.new_purchases.join(res.new_tickets.selectExpr("ID AS ticket_id"),
                                      "ticket_id", "left_anti").count() == 0
        # every new customer brings an e-mail that was not known before
        def n_mails(df):
            return df.where("e_mail IS NOT NULL").select(F.lower("e_mail")).distinct().count()
        assert n_mails(after.customer) == n_mails(t.customer) + res.new_customers.count()
    finally:
        res.release()


def test_dense_rank_matches_global_order(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 100003).alias("k"))
    ranked = dense_rank_by(df, "k", n_buckets=16)
    rows = sorted((r.k, r._pos) for r in ranked.collect())
    assert [p for _, p in rows] == list(range(1, 5001))


def test_dense_rank_with_hot_values(spark):
    # a third of the rows share one key: ranks stay a permutation of 1..n
    df = spark.range(0, 3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id")).alias("k"), "id")
    ranked = dense_rank_by(df, "k", n_buckets=8)
    pos = sorted(r._pos for r in ranked.collect())
    assert pos == list(range(1, 3001))


def test_heavy_order_keys_are_split(spark):
    """A third of the rows on one key and a fifth on NULL: no range above twice
    its share, and the numbers of one sort by (key, place, row)."""
    from pyspark.sql import functions as F

    from marquee.operators.keys import _range_of, cut_points
    n, buckets = 60_000, 60
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, 30_000).when(F.col("id") % 5 == 0, None)
                               .otherwise(F.col("id")).alias("k"), (F.col("id") * 31 % n).alias("v"))
    cuts = cut_points(df, "k", buckets)
    nulls = df.where("k IS NULL").count()
    assert cuts.ways == {30_000: (n // 3) * buckets // n, None: nulls * buckets // n}
    bucket, part, place = _range_of(F.col("k"), F.xxhash64("v"), cuts)
    sizes = df.groupBy(bucket, part).count().agg(F.max("count")).first()[0]
    assert sizes <= 2 * n / buckets
    rows = [tuple(r) for r in dense_rank_by(df, "k", cuts=cuts).select("_pos", "k", "v", place).collect()]
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[3], r[2]))
    assert [r[0] for r in order] == list(range(1, n + 1))


def test_assign_ids_continue_after_existing_max(spark):
    from marquee.operators.keys import assign_ids
    existing = spark.createDataFrame([(5,), (9,)], "ID bigint")
    new = spark.createDataFrame([(30, "c"), (10, "a"), (20, "b")], "request_id bigint, v string")
    got = sorted((r.request_id, r.ID) for r in
                 assign_ids(new, "request_id", existing, "ID", "ID", n_buckets=2).collect())
    assert got == [(10, 10), (20, 11), (30, 12)]
    empty = spark.createDataFrame([], "ID bigint")
    got = sorted(r.ID for r in assign_ids(new, "request_id", empty, "ID", "ID").collect())
    assert got == [1, 2, 3]


def test_buckets_of_a_large_numbering_are_balanced(spark):
    """Thousands of ranges: dense ranks, no range far above its share."""
    from pyspark.sql import functions as F

    from marquee.operators.keys import bucket_expr, cut_points
    n, buckets = 400_000, 2_000
    df = spark.range(n).select((F.col("id") * 7919 % n * 3).alias("k"))
    cuts = cut_points(df, "k", buckets)
    sizes = df.groupBy(bucket_expr(F.col("k"), cuts).alias("b")).count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] < 2 * n / buckets and sizes[1] > 0.9 * buckets
    ranked = dense_rank_by(df, "k", cuts=cuts)
    assert ranked.where(F.col("_pos") != F.col("k") / 3 + 1).count() == 0 and ranked.count() == n


def test_bucket_count_follows_the_rows(spark):
    from marquee.operators.keys import BUCKET_ROWS, cut_points
    assert cut_points(spark.range(100), "id") == []
    assert len(cut_points(spark.range(3 * BUCKET_ROWS), "id")) == 2


def test_null_order_keys_are_numbered_first(spark):
    df = spark.createDataFrame([(None, "b"), (5, "x"), (None, "a"), (1, "y"), (3, "z")], "k int, v string")
    got = {r.v: r._pos for r in dense_rank_by(df, "k", n_buckets=3).collect()}
    assert got == {"a": 1, "b": 2, "y": 3, "z": 4, "x": 5}
