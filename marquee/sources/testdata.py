"""Adapter from the driver's TPC-H-like tables to the seven ticketing tables
(mapping written down in FIXTURES.md §2), plus request and change streams
derived from the driver's ``events`` table.

Everything here is a lazy DataFrame over the parquet files: Catalyst prunes
columns and pushes filters into the scans, and nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.schemas import CUSTOMER, EVENT_CATALOG
from marquee.tables import Tables

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events")


def read_driver(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _money(col):
    return col.cast("decimal(10,2)")


def event_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_driver(spark, sf_dir, "part")
    n_companies = read_driver(spark, sf_dir, "supplier").agg(F.count(F.lit(1))).scalar()
    k = F.col("p_partkey")
    general = _money(F.col("p_retailprice"))
    raw_company = (k * F.col("p_size")) % n_companies
    income = (F.when(k % 89 == 0, F.lit(None).cast("string"))
              .when(k % 97 == 0, F.lit("N/A"))
              .when(k % 11 == 0, F.concat(general.cast("string"), F.lit(" USD")))
              .otherwise((general * F.col("p_size")).cast("string")))
    return part.select(
        k.alias("ID"),
        F.col("p_name").alias("name"),
        F.when(k % 7 == 3, F.lower("p_type")).otherwise(F.col("p_type")).alias("type"),
        F.col("p_brand").alias("location"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(k.cast("int")))
        .alias("datetime"),
        general.alias("general_price"),
        _money(general * 2).alias("vip_price"),
        income.alias("income"),
        F.when(k % 13 != 0, F.concat((F.col("p_size") * 100).cast("string"), F.lit(" USD"))).alias("expense"),
        F.when(k % 5 != 0, F.concat(F.col("p_name"), F.lit(", "), F.col("p_brand"))).alias("details"),
        F.when(raw_company % 10 == 7, F.lit(None).cast("bigint"))
        .otherwise(raw_company).alias("company_id"),
    ).select(*[F.col(f.name).cast(f.dataType) for f in EVENT_CATALOG.fields])


def company(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_driver(spark, sf_dir, "supplier")
    n = read_driver(spark, sf_dir, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(
        s.s_suppkey.cast("bigint").alias("ID"), s.s_name.alias("name"), n.n_name.alias("location"))


def distributer(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read_driver(spark, sf_dir, "nation")
    r = read_driver(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        n.n_nationkey.cast("bigint").alias("ID"), n.n_name.alias("name"), r.r_name.alias("location"))


def _customer_cols(key, name):
    key_txt = key.cast("string")
    return [
        key.cast("bigint").alias("ID"),
        F.split_part(name, F.lit("#"), F.lit(1)).alias("first_name"),
        F.split_part(name, F.lit("#"), F.lit(2)).alias("last_name"),
        F.concat(F.lit("c"), key_txt, F.lit("@mail."),
                 F.when(key % 40 == 0, F.lit("org")).otherwise(F.lit("com"))).alias("e_mail"),
        F.when(key % 50 == 0, F.lit("12345")).otherwise(F.lpad(key_txt, 10, "5")).alias("phone_num"),
    ]


def customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_driver(spark, sf_dir, "customer")
    return c.select(*_customer_cols(F.col("c_custkey"), F.col("c_name")))


#: Rows a task should hold of a table that is dealt by a key.
TASK_ROWS = 500_000


def _tasks(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Over how many tasks the rows of a driver table are dealt (the count comes
    from the files' footers). Partitions that are merged by their packed size hold
    ever more rows the better these pack; a number of their own keeps them even."""
    return max(1, -(-read_driver(spark, sf_dir, name).count() // TASK_ROWS))


def _ticket_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (l_orderkey, l_linenumber) -- lineitem has no unique key,
    so every attribute is the group's minimum. Dealt by l_orderkey, which serves
    the grouping and the join with orders."""
    li = read_driver(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice", "l_partkey", "l_suppkey") \
        .repartition(_tasks(spark, sf_dir, "lineitem"), "l_orderkey")
    f = F.col("l_returnflag")
    # min(l_returnflag) is 'A' iff an 'A' is present and nothing sorts below
    # it (likewise 'R'); boolean aggregates keep this a hash aggregation
    # (a string min would force a sort-based aggregate over all of lineitem).
    agg = li.groupBy("l_orderkey", "l_linenumber").agg(
        F.bool_or(f == "A").alias("has_a"), F.bool_or(f < "A").alias("below_a"),
        F.bool_or(f == "R").alias("has_r"), F.bool_or(f < "R").alias("below_r"),
        F.min("l_extendedprice").alias("px"),
        F.min("l_partkey").alias("pk"),
        F.min("l_suppkey").alias("sk"))
    min_is = lambda has, below: F.coalesce(F.col(has) & ~F.col(below), F.lit(False))
    return agg.select(
        "l_orderkey", "l_linenumber",
        F.when(min_is("has_r", "below_r"), F.lit("R")).when(min_is("has_a", "below_a"), F.lit("A"))
        .otherwise(F.lit("other")).alias("rf"),
        "px", "pk", "sk")


def _ticket_cols():
    return [
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint").alias("ID"),
        F.when(F.col("rf") == "R", F.lit("VIP")).when(F.col("rf") == "A", F.lit("General"))
        .otherwise(F.lit("vip")).alias("type"),
        F.lit(100).cast("int").alias("tickets_available"),
        F.lit(1).cast("int").alias("tickets_sold"),
        _money(F.col("px")).alias("price"),
        F.col("pk").cast("bigint").alias("event_id"),
        (F.col("sk") % 24 + 1).cast("bigint").alias("distributer_id"),
    ]


def ticket(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    lines = lines if lines is not None else _ticket_lines(spark, sf_dir)
    return lines.select(*_ticket_cols())


def purchase(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    # TICKET joined to orders on ID div 10 = o_orderkey; since ID is
    # l_orderkey*10 + l_linenumber with l_linenumber in 1..7 this is the
    # l_orderkey equi-join, which keeps the lineitem grouping's partitioning.
    lines = lines if lines is not None else _ticket_lines(spark, sf_dir)
    o = read_driver(spark, sf_dir, "orders")
    tid = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint")
    joined = lines.join(o, F.col("l_orderkey") == o.o_orderkey)
    return joined.select(
        tid.alias("purchase_id"),
        o.o_custkey.cast("bigint").alias("customer_id"),
        tid.alias("ticket_id"),
        F.when(F.substring(o.o_orderpriority, 1, 1).isin("1", "2"), F.lit("Credit Card"))
        .otherwise(F.lit("Cash")).alias("payment_type"),
        o.o_orderdate.cast("timestamp_ntz").alias("purchase_date"))


def cust_of(spark: SparkSession, sf_dir: str, tickets: DataFrame | None = None,
            purchases: DataFrame | None = None, events: DataFrame | None = None) -> DataFrame:
    t = tickets if tickets is not None else ticket(spark, sf_dir)
    p = purchases if purchases is not None else purchase(spark, sf_dir)
    e = events if events is not None else event_catalog(spark, sf_dir)
    n = _tasks(spark, sf_dir, "lineitem")
    return (p.select("ticket_id", "customer_id").repartition(n, "ticket_id")
            .join(t.select(F.col("ID").alias("ticket_id"), "event_id").repartition(n, "ticket_id"), "ticket_id")
            .join(e.where(F.col("company_id").isNotNull())
                  .select(F.col("ID").alias("event_id"), "company_id"), "event_id")
            .select("company_id", "customer_id")
            .repartition(n, "company_id", "customer_id").distinct())


def load_tables(spark: SparkSession, sf_dir: str, persist: bool = False) -> Tables:
    """The seven tables over one sf folder. TICKET, Purchase and cust_of all
    derive from one lineitem grouping; with ``persist`` that grouping is
    kept (memory, spilling to disk) so writing every table computes it once;
    ``Tables.release()`` drops it."""
    lines = _ticket_lines(spark, sf_dir)
    if persist:
        from pyspark import StorageLevel
        lines = lines.persist(StorageLevel.MEMORY_AND_DISK)
    ev = event_catalog(spark, sf_dir)
    tk = ticket(spark, sf_dir, lines)
    pu = purchase(spark, sf_dir, lines)
    return Tables(
        event_catalog=ev,
        company=company(spark, sf_dir),
        distributer=distributer(spark, sf_dir),
        customer=customer(spark, sf_dir),
        ticket=tk,
        purchase=pu,
        cust_of=cust_of(spark, sf_dir, tk, pu, ev),
        cached=(lines,) if persist else (),
    )


# ---------------------------------------------------------------- requests

def _driver_events(spark, sf_dir, kind: str | None = None) -> DataFrame:
    ev = read_driver(spark, sf_dir, "events")
    return ev.where(F.col("event_type") == kind) if kind else ev


def purchase_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchase form submissions: driver ``events`` rows of type purchase.
    Identity comes from the mapped Customer of ``user_id``; every fifth
    request uses a new e-mail shared by the user's requests (new customers,
    deduplicated in the batch) and every seventh otherwise upper-cases the
    first letter of a known e-mail (case-insensitive match)."""
    ev = _driver_events(spark, sf_dir, "purchase")
    cust = customer(spark, sf_dir).select(
        F.col("ID").alias("user_id"), "first_name", "last_name",
        F.col("e_mail").alias("known_mail"), "phone_num")
    n_events = read_driver(spark, sf_dir, "part").agg(F.count(F.lit(1))).scalar()
    eid = F.col("event_id")
    mail = (F.when(eid % 5 == 0, F.concat(F.lit("r"), F.col("user_id").cast("string"),
                                           F.lit("@mail.com")))
            .when(eid % 7 == 0, F.concat(F.upper(F.substring("known_mail", 1, 1)),
                                         F.expr("substring(known_mail, 2)")))
            .otherwise(F.col("known_mail")))
    return ev.join(cust, "user_id", "left").select(
        eid.alias("request_id"),
        F.col("ts").cast("timestamp_ntz").alias("requested_at"),
        "first_name", "last_name",
        mail.alias("e_mail"),
        "phone_num",
        (eid % n_events).cast("bigint").alias("event_id"),
        F.when(eid % 3 == 0, F.lit("General")).when(eid % 3 == 1, F.lit("VIP"))
        .otherwise(F.lit("Select Ticket Type")).alias("ticket_type"),
        F.when((eid / 3).cast("bigint") % 3 == 0, F.lit("Credit Card"))
        .when((eid / 3).cast("bigint") % 3 == 1, F.lit("Cash"))
        .otherwise(F.lit("Select Payment Type")).alias("payment_type"))


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile lookups: every driver event is a page visit by a session
    customer id (``user_id * 11``, so some ids are unknown); views are
    anonymous (NULL id)."""
    ev = _driver_events(spark, sf_dir)
    return ev.select(
        F.col("event_id").alias("visit_id"),
        F.when(F.col("event_type") == "view", F.lit(None).cast("bigint"))
        .otherwise(F.col("user_id") * 11).alias("customer_id"))


# ---------------------------------------------------------------- change logs

def customer_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered Customer edits keyed by ``user_id``: signups insert, clicks and
    views update one property, errors delete; purchases carry no edit."""
    ev = _driver_events(spark, sf_dir).where(F.col("event_type") != "purchase")
    eid = F.col("event_id")
    eid_txt = eid.cast("string")
    kind = F.col("event_type")
    prop = F.element_at(F.array(*[F.lit(p) for p in ("first_name", "last_name", "e_mail",
                                                      "phone_num")]),
                        (eid % 4 + 1).cast("int"))
    new_value = (F.when(prop == "e_mail", F.concat(F.lit("u"), eid_txt, F.lit("@mail.com")))
                 .when(prop == "phone_num", F.lpad(eid_txt, 10, "7"))
                 .otherwise(F.concat(F.lit("v"), eid_txt)))
    row = F.struct(F.col("user_id").cast("bigint").alias("ID"),
                   F.lit("New").alias("first_name"),
                   eid_txt.alias("last_name"),
                   F.concat(F.lit("n"), eid_txt, F.lit("@mail.com")).alias("e_mail"),
                   F.lpad(eid_txt, 10, "6").alias("phone_num"))
    op = (F.when(kind == "signup", F.lit("insert"))
          .when(kind.isin("click", "view"), F.lit("update"))
          .otherwise(F.lit("delete")))
    is_upd = op == "update"
    return ev.select(
        eid.alias("seq"), op.alias("op"), F.col("user_id").cast("bigint").alias("key"),
        F.when(is_upd, prop).alias("property"),
        F.when(is_upd, new_value).alias("new_value"),
        F.when(op == "insert", row).cast(CUSTOMER.simpleString()).alias("row"))


def customer_key_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Customer edits with key changes among them: every 40th event that
    deletes moves the row instead, to a key that three users share, to the
    next user's or back; some edits name the shared key; some inserts have no
    key, some targets are no number."""
    seq, key, op = F.col("seq"), F.col("key"), F.col("op")
    shared = (F.lit(900000000) + F.floor(key / 3)).cast("bigint")
    moves = (op == "delete") & (seq % 40 == 0)
    target = (F.when(seq % 600 == 0, F.lit("none"))
              .when(seq % 80 == 40, key.cast("string"))
              .when(seq % 240 == 0, (key + 1).cast("string"))
              .otherwise(shared.cast("string")))
    return customer_changes(spark, sf_dir).select(
        "seq", F.when(moves, F.lit("update")).otherwise(op).alias("op"),
        F.when((op == "insert") & (seq % 90 == 0), F.lit(None).cast("bigint"))
        .when((moves & (seq % 80 == 40)) | ((op == "update") & (seq % 30 == 7)), shared).otherwise(key).alias("key"),
        F.when(moves, F.lit("ID")).otherwise(F.col("property")).alias("property"),
        F.when(moves, target).otherwise(F.col("new_value")).alias("new_value"), "row")


def company_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company name and location edits from click events, keyed by ``user_id``."""
    ev = _driver_events(spark, sf_dir, "click")
    eid = F.col("event_id")
    return ev.select(eid.alias("seq"), F.lit("update").alias("op"), F.col("user_id").cast("bigint").alias("key"),
                     F.when(eid % 2 == 0, F.lit("name")).otherwise(F.lit("location")).alias("property"),
                     F.concat(F.lit("K"), eid.cast("string")).alias("new_value"))


def event_property_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event edits from click events: one property per edit, keyed by
    ``event_id mod |events|``; money edits arrive as form text with ``$`` and
    ``,`` and some are not numbers."""
    ev = _driver_events(spark, sf_dir, "click")
    n_events = read_driver(spark, sf_dir, "part").agg(F.count(F.lit(1))).scalar()
    eid = F.col("event_id")
    props = ("name", "type", "general_price", "vip_price", "company_id", "income", "datetime")
    prop = F.element_at(F.array(*[F.lit(p) for p in props]), (eid % len(props) + 1).cast("int"))
    val = F.col("value")
    new_value = (F.when(prop.isin("general_price", "vip_price"),
                        F.when(eid % 13 == 0, F.lit("n/a"))
                        .otherwise(F.concat(F.lit("$1,"), val.cast("decimal(10,2)").cast("string"))))
                 .when(prop == "company_id", (F.col("user_id") % 100).cast("string"))
                 .when(prop == "income", F.concat(val.cast("decimal(10,2)").cast("string"),
                                                  F.lit(" USD")))
                 .when(prop == "datetime", F.lit("2025-06-01 20:00:00"))
                 .when(prop == "type", F.when(eid % 2 == 0, F.lit("Concert"))
                       .otherwise(F.lit("concert")))
                 .otherwise(F.concat(F.lit("Show "), eid.cast("string"))))
    return ev.select(eid.alias("seq"), F.lit("update").alias("op"),
                     (eid % n_events).cast("bigint").alias("key"),
                     prop.alias("property"), new_value.alias("new_value"))


def deleted_company_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company deletes: error events name company ``event_id`` (most such
    ids are not live, which makes those deletes no-ops)."""
    ev = _driver_events(spark, sf_dir, "error")
    return ev.select(F.col("event_id").cast("bigint").alias("ID"))


def deleted_purchase_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchase deletes: error events name purchase ``event_id*10 + 1``
    (line 1 of order ``event_id``; absent ids are no-ops)."""
    ev = _driver_events(spark, sf_dir, "error")
    return ev.select((F.col("event_id") * 10 + 1).cast("bigint").alias("purchase_id"))


def cust_of_delete_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cust_of deletes as the form's ``"company,customer"`` text; signups
    name pairs, a few texts are malformed."""
    ev = _driver_events(spark, sf_dir, "signup")
    n = read_driver(spark, sf_dir, "supplier").agg(F.count(F.lit(1))).scalar()
    eid = F.col("event_id")
    pair = F.concat((F.col("user_id") * 7 % n).cast("string"), F.lit(","),
                    F.col("user_id").cast("string"))
    text = F.when(eid % 17 == 0, F.concat(pair, F.lit(",9"))).otherwise(pair)
    return ev.select(eid.alias("seq"), text.alias("pair_text"))


def company_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company insert forms from signups: key ``user_id`` (live keys make
    the insert a no-op), name and location from the event; every seventh form
    has no ``seq`` and comes last."""
    ev = _driver_events(spark, sf_dir, "signup")
    eid = F.col("event_id")
    return ev.select(F.when(eid % 7 != 0, eid).alias("seq"), F.col("user_id").cast("bigint").alias("ID"),
                     F.concat(F.lit("Co"), eid.cast("string")).alias("name"),
                     F.concat(F.lit("Loc"), (eid % 5).cast("string")).alias("location"))


def ticket_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TICKET insert forms, all text, from signups: key ``user_id*10 + 1``
    (live and repeated keys are no-ops), some keys empty or not a number, some
    counts that do not parse, some forms without ``seq``."""
    ev = _driver_events(spark, sf_dir, "signup")
    eid, user = F.col("event_id"), F.col("user_id")
    key = F.when(eid % 13 == 0, F.lit(None)).when(eid % 17 == 0, F.lit("none")).otherwise((user * 10 + 1).cast("string"))
    return ev.select(
        F.when(eid % 7 != 0, eid).alias("seq"), key.alias("ID"),
        F.when(eid % 2 == 0, F.lit("VIP")).otherwise(F.lit("General")).alias("type"),
        F.concat(F.lit("1,"), F.lpad((eid % 1000).cast("string"), 3, "0")).alias("tickets_available"),
        F.when(eid % 11 == 0, F.lit("many")).otherwise((eid % 90).cast("string")).alias("tickets_sold"),
        F.concat(F.lit("$"), (eid % 500).cast("string"), F.lit(".25")).alias("price"),
        (eid % 1000).cast("string").alias("event_id"),
        F.concat((user % 24 + 1).cast("string"), F.lit(".0")).alias("distributer_id"))


def _form_base(spark: SparkSession, sf_dir: str, factor: int):
    """Signups with the text key of an insert form (``user_id * factor + 1``;
    some empty, some not a number) and its ``seq`` (some forms have none)."""
    eid = F.col("event_id")
    key = (F.when(eid % 13 == 0, F.lit(None)).when(eid % 17 == 0, F.lit("none"))
           .otherwise((F.col("user_id") * factor + 1).cast("string")))
    return _driver_events(spark, sf_dir, "signup").select(
        F.when(eid % 7 != 0, eid).alias("seq"), key.alias("form_key"), eid.alias("e"), F.col("user_id").alias("u"))


def event_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event insert forms, all text: prices with ``$`` and ``,``, dates that do
    not parse, events without a company."""
    e, text = F.col("e"), (lambda c: c.cast("string"))
    return _form_base(spark, sf_dir, 2).select(
        "seq", F.col("form_key").alias("ID"), F.concat(F.lit("Ev"), text(e)).alias("name"),
        F.when(e % 3 == 0, F.lit("Concert")).otherwise(F.lit("concert")).alias("type"),
        F.concat(F.lit("Hall "), text(e % 9)).alias("location"),
        F.when(e % 11 == 0, F.lit("next week")).otherwise(
            F.concat(F.lit(" 2025-03-"), F.lpad(text(e % 28 + 1), 2, "0"), F.lit(" 20:30:00"))).alias("datetime"),
        F.concat(F.lit("$1,"), F.lpad(text(e % 1000), 3, "0"), F.lit(".50")).alias("general_price"),
        F.when(e % 19 == 0, F.lit("free")).otherwise(F.concat(text(e % 700), F.lit(".25"))).alias("vip_price"),
        F.concat(text(e % 5000), F.lit(" USD")).alias("income"), F.lit(None).cast("string").alias("expense"),
        F.when(e % 2 == 0, F.concat(F.lit("seats "), text(e))).alias("details"),
        F.when(e % 4 != 0, text(e % 50)).alias("company_id"))


def customer_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer insert forms: the key alone is typed, phone numbers stay text."""
    e, text = F.col("e"), (lambda c: c.cast("string"))
    return _form_base(spark, sf_dir, 3).select(
        "seq", F.col("form_key").alias("ID"), F.concat(F.lit("First"), text(e)).alias("first_name"),
        F.when(e % 5 != 0, F.concat(F.lit("Last"), text(F.col("u")))).alias("last_name"),
        F.concat(F.lit("u"), text(e), F.lit("@example.org")).alias("e_mail"),
        F.lpad(text(e), 10, "5").alias("phone_num"))


def purchase_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchase insert forms; some customer ids and dates do not parse."""
    e, text = F.col("e"), (lambda c: c.cast("string"))
    return _form_base(spark, sf_dir, 10).select(
        "seq", F.col("form_key").alias("purchase_id"),
        F.when(e % 23 == 0, F.lit("guest")).otherwise(F.concat(text(e % 1500), F.lit(".0"))).alias("customer_id"),
        text(e * 10 + 1).alias("ticket_id"),
        F.when(e % 2 == 0, F.lit("Cash")).otherwise(F.lit("Credit Card")).alias("payment_type"),
        F.when(e % 11 == 0, F.lit("soon")).otherwise(
            F.concat(F.lit("2025-04-"), F.lpad(text(e % 28 + 1), 2, "0"), F.lit(" 09:15:00"))).alias("purchase_date"))


def link_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company-customer links added by clicks; live and repeated pairs are no-ops."""
    ev = _driver_events(spark, sf_dir, "click")
    n = read_driver(spark, sf_dir, "supplier").agg(F.count(F.lit(1))).scalar()
    return ev.select(F.col("event_id").alias("seq"), (F.col("user_id") * 7 % n).cast("bigint").alias("company_id"),
                     F.col("user_id").cast("bigint").alias("customer_id"))


def profile_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer dashboard submissions (all four fields) from view events."""
    ev = _driver_events(spark, sf_dir, "view")
    eid = F.col("event_id")
    t = eid.cast("string")
    return ev.select(eid.alias("seq"), F.col("user_id").cast("bigint").alias("ID"),
                     F.concat(F.lit("P"), t).alias("first_name"),
                     F.concat(F.lit("Q"), t).alias("last_name"),
                     F.concat(F.lit("p"), t, F.lit("@mail.com")).alias("e_mail"),
                     F.lpad(t, 10, "8").alias("phone_num"))


def distributer_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distributer name/location edits from view events, keyed by
    ``user_id mod 25``."""
    ev = _driver_events(spark, sf_dir, "view")
    eid = F.col("event_id")
    return ev.select(eid.alias("seq"), F.lit("update").alias("op"),
                     (F.col("user_id") % 25).cast("bigint").alias("key"),
                     F.when(eid % 2 == 0, F.lit("name")).otherwise(F.lit("location"))
                     .alias("property"),
                     F.concat(F.lit("D"), eid.cast("string")).alias("new_value"))


def distributer_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distributer id changes from error events: ``user_id mod 25`` becomes
    ``25 + event_id mod 40`` (form text; several may target one id)."""
    ev = _driver_events(spark, sf_dir, "error")
    return ev.select(F.col("event_id").alias("seq"),
                     (F.col("user_id") % 25).cast("bigint").alias("key"),
                     (F.lit(25) + F.col("event_id") % 40).cast("string").alias("new_value"))


def ticket_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TICKET edits from purchase events, keyed by ticket ``event_id*10 + 1``
    (line 1 of order ``event_id``; absent tickets are no-ops). Numbers arrive
    as form text: thousands separators, ``$``, float text like ``3.0``, and
    some words that do not parse. New event ids lie past the catalog
    (``|events| + user_id*13``), so the literal re-keying of M11 moves the
    events whose id equals an edited ticket's id."""
    ev = _driver_events(spark, sf_dir, "purchase")
    n_events = read_driver(spark, sf_dir, "part").agg(F.count(F.lit(1))).scalar()
    eid = F.col("event_id")
    props = ("type", "tickets_available", "tickets_sold", "price", "event_id", "distributer_id")
    prop = F.element_at(F.array(*[F.lit(p) for p in props]), (eid % len(props) + 1).cast("int"))
    value = (F.when(prop == "type", F.when(eid % 2 == 0, F.lit("VIP")).otherwise(F.lit("General")))
             .when(prop == "tickets_available", F.concat(F.lit("1,"), F.lpad((eid % 1000)
                                                                             .cast("string"), 3, "0")))
             .when(prop == "tickets_sold", F.when(eid % 11 == 0, F.lit("many"))
                   .otherwise((eid % 90).cast("string")))
             .when(prop == "price", F.concat(F.lit("$"), F.col("value").cast("decimal(10,2)")
                                             .cast("string")))
             .when(prop == "event_id", (n_events + F.col("user_id") * 13).cast("string"))
             .otherwise(F.concat((F.col("user_id") % 24 + 1).cast("string"), F.lit(".0"))))
    return ev.select(eid.alias("seq"), F.lit("update").alias("op"),
                     (eid * 10 + 1).cast("bigint").alias("key"), prop.alias("property"),
                     value.alias("new_value"))


def parent_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticket edits whose ticket id is also an event's id, so that M11 moves
    that event; several want one new id, some values are no number."""
    n_events = read_driver(spark, sf_dir, "part").agg(F.count(F.lit(1))).scalar()
    eid = F.col("event_id")
    return _driver_events(spark, sf_dir, "purchase").where(eid % 3 == 0).select(
        eid.alias("seq"), (eid % n_events).cast("bigint").alias("key"), F.lit("event_id").alias("property"),
        F.when(eid % 37 == 0, F.lit("none")).otherwise((n_events + F.col("user_id") % 200).cast("string")).alias("new_value"))


def cascade_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ordered log over several tables: purchase deletes (errors), pair
    deletes (signups), pair inserts (clicks) and ticket edits (purchases)."""
    def part(df: DataFrame, op: str, **columns) -> DataFrame:
        given = {"key": F.lit(None), "property": F.lit(None), "new_value": F.lit(None)} | columns
        return df.select("seq", F.lit(op).alias("op"), given["key"].cast("bigint").alias("key"),
                         given["property"].cast("string").alias("property"), given["new_value"].cast("string").alias("new_value"))

    gone = _driver_events(spark, sf_dir, "error").select(F.col("event_id").alias("seq"))
    links = link_inserts(spark, sf_dir)
    return (part(gone, "delete_purchase", key=F.col("seq") * 10 + 1)
            .unionByName(part(cust_of_delete_texts(spark, sf_dir), "delete_pair", new_value=F.col("pair_text")))
            .unionByName(part(links, "insert_pair", new_value=F.concat_ws(",", F.col("company_id").cast("string"),
                                                                          F.col("customer_id").cast("string"))))
            .unionByName(part(ticket_edits(spark, sf_dir), "update_ticket", key=F.col("key"), property=F.col("property"),
                              new_value=F.col("new_value"))))
