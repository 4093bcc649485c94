"""Change-apply jobs: known answers and log-folding properties."""

import pytest
from pyspark.sql import functions as F

from marquee import schemas as S
from marquee.operators import changes as ch
from marquee.sources import testdata as td

SF = "/root/testdata/sf0.01"


def rows(df, key="ID"):
    return sorted(tuple(r) for r in df.orderBy(key).collect())


@pytest.fixture(scope="module")
def distributers(spark):
    return spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", "z")], S.DISTRIBUTER)


def log_df(spark, entries, schema=S.DISTRIBUTER):
    return spark.createDataFrame(entries, S.change_schema(schema))


def test_insert_of_live_key_is_noop_m1(spark, distributers):
    new = spark.createDataFrame([(1, 2, "dup", "dup"), (2, 4, "d", "w"), (3, 4, "later", "w")],
                                "seq bigint, ID bigint, name string, location string")
    out = ch.insert_rows(distributers, new)
    assert rows(out) == [(1, "a", "x"), (2, "b", "y"), (3, "c", "z"), (4, "d", "w")]


def test_delete_then_insert_m8(spark, distributers):
    log = log_df(spark, [(1, "delete", 2, None, None, None),
                         (2, "insert", 2, None, None, (2, "new", "n"))])
    out, rejects = ch.apply_changes(distributers, log)
    assert rows(out) == [(1, "a", "x"), (2, "new", "n"), (3, "c", "z")]
    assert rejects.count() == 0


def test_fold_rules(spark, distributers):
    log = log_df(spark, [
        (1, "update", 1, "name", "A1", None),
        (2, "delete", 2, None, None, None),
        (3, "insert", 2, None, None, (2, "B2", "yy")),
        (4, "update", 2, "name", "B3", None),
        (5, "insert", 1, None, None, (1, "dup", "dup")),
        (6, "update", 9, "name", "nope", None),
        (7, "insert", 9, None, None, (9, "n9", "l9")),
        (8, "update", 9, "location", "L9", None),
        (9, "delete", 3, None, None, None),
        (10, "update", 3, "name", "gone", None),
        (11, "update", 1, "ID", "5", None),
        (12, "update", 1, "colour", "red", None),
        (13, "launch", 1, None, None, None),
    ])
    out, rejects = ch.apply_changes(distributers, log)
    assert rows(out) == [(2, "B3", "yy"), (5, "A1", "x"), (9, "n9", "L9")]
    assert sorted((r.seq, r.reason) for r in rejects.collect()) == [
        (12, ch.UNKNOWN_PROPERTY_ERROR), (13, "unknown op")]


def test_fold_with_key_changes(spark, distributers):
    log = log_df(spark, [
        (1, "update", 1, "name", "A1", None),
        (2, "update", 1, "ID", "7", None),                  # moves the edited row 1 to 7
        (3, "update", 2, "ID", "3", None),                  # 3 is live: duplicate key, no-op
        (4, "insert", 8, None, None, (8, "h", "w")),
        (5, "update", 8, "ID", "9", None),                  # insert then move
        (6, "update", 4, "ID", "5", None),                  # 4 does not exist: no-op
        (7, "insert", 10, None, None, (10, "t", "u")),
        (8, "update", 10, "ID", "11", None),                # chain 10 -> 11 -> 12
        (9, "update", 11, "ID", "12", None),
    ])
    out, rejects = ch.apply_changes(distributers, log)
    assert rows(out) == [(2, "b", "y"), (3, "c", "z"), (7, "A1", "x"), (9, "h", "w"),
                         (12, "t", "u")]
    assert [(r.seq, r.reason) for r in rejects.collect()] == [(3, ch.KEY_CHANGE_ERROR)]


def test_fold_in_two_batches_equals_one(spark):
    customer = td.customer(spark, SF)
    log = td.customer_changes(spark, SF)
    once, _ = ch.apply_changes(customer, log, schema=S.CUSTOMER)
    cut = log.approxQuantile("seq", [0.5], 0.0)[0]
    first, _ = ch.apply_changes(customer, log.where(F.col("seq") <= cut), schema=S.CUSTOMER)
    twice, _ = ch.apply_changes(first, log.where(F.col("seq") > cut), schema=S.CUSTOMER)
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0


def test_update_property_money_and_rejects_m7(spark):
    from decimal import Decimal
    import datetime as dt
    events = spark.createDataFrame(
        [(1, "e1", "Opera", "l", dt.datetime(2024, 1, 1), Decimal("10.00"), Decimal("20.00"),
          "5", None, None, 10)], S.EVENT_CATALOG)
    changes = spark.createDataFrame([
        (1, "update", 1, "general_price", "$1,234.50"),
        (2, "update", 1, "vip_price", "abc"),
        (3, "update", 1, "company_id", "7.5"),
        (4, "update", 1, "income", "99 USD"),
        (5, "update", 1, "general_price", "oops"),
        (6, "update", 1, "datetime", "2025-06-01T20:00"),
    ], "seq bigint, op string, key bigint, property string, new_value string")
    out, rejects = ch.update_property(events, changes, schema=S.EVENT_CATALOG)
    r = out.collect()[0]
    assert r.general_price == Decimal("1234.50")   # later invalid value has no effect
    assert r.vip_price == Decimal("20.00")
    assert r.company_id == 8                       # rounds half away from zero
    assert r.income == "99 USD"
    assert r.datetime == dt.datetime(2025, 6, 1, 20, 0)
    assert sorted(x.seq for x in rejects.collect()) == [2, 5]


def test_rename_keys(spark, distributers):
    renames = spark.createDataFrame([(1, 1, "7"), (2, 2, "3"), (3, 1, "8")],
                                    "seq bigint, key bigint, new_value string")
    out, rejects = ch.rename_keys(distributers, renames)
    assert rows(out) == [(2, "b", "y"), (3, "c", "z"), (7, "a", "x")]  # 2 -> 3 clashes
    assert [r.seq for r in rejects.collect()] == [2]


def test_renames_equal_one_by_one(spark):
    """Chains, retries after a failure, two renames onto one key, swaps, NULLs."""
    import random
    rnd = random.Random(6)
    for case in range(12):
        keys = list(range(rnd.randint(1, 6)))
        log = [(i, rnd.choice([*range(9), None] if case % 3 == 0 else range(9)), rnd.choice(["x", None, *map(str, range(9))]))
               for i in range(rnd.randint(0, 14))]
        live, expected_rejects = {k: k for k in keys}, []
        for seq, old, new in log:
            target = int(new) if new and new.isdigit() else None
            if old is None or target is None:
                expected_rejects.append(seq)
            elif old in live and target != old:
                if target in live:
                    expected_rejects.append(seq)
                else:
                    live[target] = live.pop(old)
        snap = spark.createDataFrame([(k, f"n{k}", "l") for k in keys], S.DISTRIBUTER)
        out, rejects = ch.rename_keys(snap, spark.createDataFrame(log, "seq bigint, key bigint, new_value string"))
        assert {r[0]: r[1] for r in out.collect()} == {k: f"n{was}" for k, was in live.items()}, log
        assert sorted(r.seq for r in rejects.collect()) == expected_rejects, log


def test_first_rekey_of_a_parent_wins(spark, distributers):
    kind = "seq bigint, op string, key bigint, property string, new_value string"
    out = ch.rekey_parents(distributers, spark.createDataFrame(
        [(1, "update", 2, "event_id", "50"), (2, "update", 2, "event_id", "60")], kind))
    assert rows(out) == [(1, "a", "x"), (3, "c", "z"), (50, "b", "y")]


def test_log_rows_without_a_key_are_rejected(spark, distributers):
    kind = S.change_schema(S.DISTRIBUTER) if hasattr(S, "change_schema") else None
    log = spark.createDataFrame([(1, "update", None, "name", "q", None), (2, "delete", None, None, None, None)], kind)
    out, rejects = ch.apply_changes(distributers, log, schema=S.DISTRIBUTER)
    assert rows(out) == rows(distributers)
    assert sorted(map(tuple, rejects.collect())) == [(1, "missing key"), (2, "missing key")]


def test_update_customers_m3(spark):
    cust = spark.createDataFrame([(1, "A", "B", "a@x.com", "1"), (2, "C", "D", "c@x.com", "2")],
                                 S.CUSTOMER)
    upd = spark.createDataFrame([(1, 1, "N", "M", "n@x.com", "9"), (2, 1, "Z", "Y", "z@x.com", "8"),
                                 (3, 5, "Q", "Q", "q@x.com", "7")],
                                "seq bigint, ID bigint, first_name string, last_name string, "
                                "e_mail string, phone_num string")
    assert rows(ch.update_customers(cust, upd)) == [(1, "Z", "Y", "z@x.com", "8"),
                                                     (2, "C", "D", "c@x.com", "2")]


def test_delete_purchase_cascades_to_ticket_m9(spark):
    import datetime as dt
    from decimal import Decimal
    p = spark.createDataFrame([(1, 5, 0, "Cash", dt.datetime(2024, 1, 1)),
                               (2, 5, 11, "Cash", dt.datetime(2024, 1, 1))], S.PURCHASE)
    t = spark.createDataFrame([(0, "vip", 100, 1, Decimal("1.00"), 1, 1),
                               (11, "vip", 100, 1, Decimal("1.00"), 1, 1)], S.TICKET)
    ids = spark.createDataFrame([(1,), (99,)], "purchase_id bigint")
    p2, t2 = ch.delete_purchases(p, t, ids)
    assert [r.purchase_id for r in p2.collect()] == [2]
    assert [r.ID for r in t2.collect()] == [11]     # ticket id 0 is deleted too


def test_delete_cust_of_removes_customer_m10(spark):
    co = spark.createDataFrame([(3, 7), (3, 9)], S.CUST_OF)
    cust = spark.createDataFrame([(7, "a", "b", "a@x.com", "1"), (8, "c", "d", "c@x.com", "2"),
                                  (9, "e", "f", "e@x.com", "3")], S.CUSTOMER)
    texts = spark.createDataFrame([(1, "3,7"), (2, "3,8"), (3, "3,9,1")], "seq bigint, pair_text string")
    co2, cust2, rejects = ch.delete_cust_of(co, cust, texts)
    assert rows(co2, "company_id") == [(3, 9)]
    assert [r.ID for r in cust2.orderBy("ID").collect()] == [9]   # 7 and 8 both gone
    assert [r.seq for r in rejects.collect()] == [3]


def test_rekey_parents_m11(spark, distributers):
    changes = spark.createDataFrame([(1, "update", 2, "event_id", "40")],
                                    "seq bigint, op string, key bigint, property string, new_value string")
    out = ch.rekey_parents(distributers, changes)
    assert rows(out) == [(1, "a", "x"), (3, "c", "z"), (40, "b", "y")]


def test_insert_without_order_keeps_smallest_row(spark, distributers):
    new = spark.createDataFrame([(4, "z", "w"), (4, "d", "w"), (5, "e", "v")], S.DISTRIBUTER)
    out = ch.insert_rows(distributers, new, seq_col=None)
    assert rows(out)[-2:] == [(4, "d", "w"), (5, "e", "v")]
