"""Named queries over a driver scale-factor folder: ``name -> f(spark, sf_dir)``.
Each builds the ticketing tables from the driver's parquet (lazy plans) and
runs one operator over them; operators with several outputs expose each
output under its own name."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.operators import changes, intake, listings, lookups, reports
from marquee.operators.keys import cut_points
from marquee.plans import bundles
from marquee.schemas import TABLE_KEYS, TABLE_SCHEMAS
from marquee.sources import testdata as td

Query = Callable[[SparkSession, str], DataFrame]


def _on_tables(fn) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(td.load_tables(spark, sf_dir))
    run.__name__ = getattr(fn, "__name__", "query")
    return run


def _scan(name: str) -> Query:
    return _on_tables(lambda t: listings.scan(t, name))


REPORTS = {
    "event_type_popularity": reports.event_type_popularity,
    "top_customer_by_class": reports.top_customer_by_class,
    "top_customer_price_count": reports.top_customer_price_count,
    "event_revenue": reports.event_revenue,
    "event_revenue_names": reports.event_revenue_names,
    "company_most_events": reports.company_most_events,
    "company_most_tickets": reports.company_most_tickets,
    "company_sales_ranking": reports.company_sales_ranking,
    "customer_loyalty": reports.customer_loyalty,
    "event_listing": reports.event_listing,
}

LISTINGS = {
    "ticket_narrow": listings.ticket_narrow,
    "cust_of_pairs": listings.cust_of_pairs,
    "event_cards": listings.event_cards,
    "event_picker": listings.event_picker,
    "distributer_picker": listings.distributer_picker,
}

LOOKUPS: dict[str, Query] = {
    "customer_by_email": lambda s, d: lookups.customer_by_email(td.purchase_requests(s, d),
                                                                td.customer(s, d)),
    "latest_ticket_id": lambda s, d: lookups.latest_ticket_id(td.ticket(s, d)),
    "customer_profile": lambda s, d: lookups.customer_profile(td.visits(s, d), td.customer(s, d)),
    "match_contacts": lambda s, d: lookups.match_contacts(td.purchase_requests(s, d),
                                                          td.customer(s, d)),
}

INTAKE_OUTPUTS = {
    "new_customers": "new_customers",
    "quote_tickets": "quotes",
    "new_cust_of": "new_cust_of",
    "book_tickets": "new_tickets",
    "new_purchases": "new_purchases",
    "intake_rejects": "rejects",
}


def _intake_output(attr: str) -> Query:
    def run(spark, sf_dir):
        res = intake.purchase_intake(td.purchase_requests(spark, sf_dir),
                                     td.load_tables(spark, sf_dir))
        return getattr(res, attr)
    run.__name__ = attr
    return run


def _apply_customer_changes(spark, sf_dir):
    return changes.apply_changes(td.customer(spark, sf_dir), td.customer_changes(spark, sf_dir),
                                 schema=TABLE_SCHEMAS["customer"])[0]


def _customer_key_changes(spark, sf_dir):
    return changes.apply_changes(td.customer(spark, sf_dir), td.customer_key_changes(spark, sf_dir),
                                 schema=TABLE_SCHEMAS["customer"])


def _ticket_updates(spark, sf_dir):
    return changes.update_property(td.ticket(spark, sf_dir), td.ticket_edits(spark, sf_dir),
                                   schema=TABLE_SCHEMAS["ticket"])


def _ticket_forms(spark, sf_dir):
    return changes.insert_forms(td.ticket(spark, sf_dir), td.ticket_forms(spark, sf_dir), TABLE_SCHEMAS["ticket"])


def _event_forms(spark, sf_dir):
    return changes.insert_forms(td.event_catalog(spark, sf_dir), td.event_forms(spark, sf_dir),
                                TABLE_SCHEMAS["event_catalog"])


def _customer_forms(spark, sf_dir):
    return changes.insert_forms(td.customer(spark, sf_dir), td.customer_forms(spark, sf_dir), TABLE_SCHEMAS["customer"])


def _purchase_forms(spark, sf_dir):
    return changes.insert_forms(td.purchase(spark, sf_dir), td.purchase_forms(spark, sf_dir), TABLE_SCHEMAS["purchase"],
                                TABLE_KEYS["purchase"])


def _event_updates(spark, sf_dir):
    return changes.update_property(td.event_catalog(spark, sf_dir),
                                   td.event_property_changes(spark, sf_dir),
                                   schema=TABLE_SCHEMAS["event_catalog"])


def _delete_purchases(spark, sf_dir):
    return changes.delete_purchases(td.purchase(spark, sf_dir), td.ticket(spark, sf_dir),
                                    td.deleted_purchase_ids(spark, sf_dir))


def _delete_cust_of(spark, sf_dir):
    t = td.load_tables(spark, sf_dir)
    return changes.delete_cust_of(t.cust_of, t.customer, td.cust_of_delete_texts(spark, sf_dir))


CHANGES: dict[str, Query] = {
    "apply_customer_changes": _apply_customer_changes,
    "apply_customer_key_changes": lambda s, d: _customer_key_changes(s, d)[0],
    "customer_change_rejects": lambda s, d: _customer_key_changes(s, d)[1],
    "update_event_properties": lambda s, d: _event_updates(s, d)[0],
    "event_update_rejects": lambda s, d: _event_updates(s, d)[1],
    "insert_companies": lambda s, d: changes.insert_rows(td.company(s, d),
                                                         td.company_inserts(s, d)),
    "insert_tickets": lambda s, d: _ticket_forms(s, d)[0],
    "insert_ticket_rejects": lambda s, d: _ticket_forms(s, d)[1],
    "insert_events": lambda s, d: _event_forms(s, d)[0],
    "insert_event_rejects": lambda s, d: _event_forms(s, d)[1],
    "insert_customers": lambda s, d: _customer_forms(s, d)[0],
    "insert_customer_rejects": lambda s, d: _customer_forms(s, d)[1],
    "insert_purchases": lambda s, d: _purchase_forms(s, d)[0],
    "insert_purchase_rejects": lambda s, d: _purchase_forms(s, d)[1],
    "insert_company_links": lambda s, d: changes.insert_rows(
        td.cust_of(s, d), td.link_inserts(s, d), TABLE_KEYS["cust_of"]),
    "delete_companies": lambda s, d: changes.delete_rows(td.company(s, d),
                                                         td.deleted_company_ids(s, d)),
    "update_customers": lambda s, d: changes.update_customers(td.customer(s, d),
                                                              td.profile_updates(s, d)),
    "update_distributer_properties": lambda s, d: changes.update_property(
        td.distributer(s, d), td.distributer_edits(s, d), schema=TABLE_SCHEMAS["distributer"])[0],
    "rename_distributers": lambda s, d: changes.rename_keys(
        td.distributer(s, d), td.distributer_renames(s, d))[0],
    "rename_rejects": lambda s, d: changes.rename_keys(
        td.distributer(s, d), td.distributer_renames(s, d))[1],
    "update_company_properties": lambda s, d: changes.update_property(
        td.company(s, d), td.company_edits(s, d), schema=TABLE_SCHEMAS["company"])[0],
    "update_ticket_properties": lambda s, d: _ticket_updates(s, d)[0],
    "ticket_edit_rejects": lambda s, d: _ticket_updates(s, d)[1],
    "rekey_events": lambda s, d: changes.rekey_parents(td.event_catalog(s, d),
                                                       td.ticket_edits(s, d)),
    "rekey_rejects": lambda s, d: changes.rekey_parent_keys(td.event_catalog(s, d), td.parent_moves(s, d))[1],
    "delete_purchases": lambda s, d: _delete_purchases(s, d)[0],
    "delete_purchase_tickets": lambda s, d: _delete_purchases(s, d)[1],
    "delete_cust_of": lambda s, d: _delete_cust_of(s, d)[0],
    "delete_cust_of_customers": lambda s, d: _delete_cust_of(s, d)[1],
    "cust_of_delete_rejects": lambda s, d: _delete_cust_of(s, d)[2],
}


# ------------------------------------------------------------------ bundles

def _bundle(make, keep: bool = False) -> Query:
    """A page's reports, written as its tables and read back as lines of text
    tagged with the report's name. With ``keep`` the lineitem grouping under TICKET,
    Purchase and cust_of is kept meanwhile: for pages that read it many times."""
    def run(spark, sf_dir):
        from marquee.session import scratch_dir
        tables = td.load_tables(spark, sf_dir, persist=keep)
        page = make(tables)
        schemas = {name: df.schema for name, df in page.reports.items()}
        try:
            paths = page.write(scratch_dir(spark, "bundle"), parallelism=4)
        finally:
            tables.release()
        return _lines({name: spark.read.schema(schemas[name]).parquet(path) for name, path in paths.items()})
    return run


def _lines(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, [
        df.select(F.lit(name).alias("report"),
                  F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in df.columns]).alias("line"))
        for name, df in tables.items()])


BUNDLES: dict[str, Query] = {
    "admin_bundle": _bundle(bundles.admin_bundle, keep=True),
    "manager_bundle": _bundle(bundles.manager_bundle),
    "public_bundle": _bundle(bundles.public_bundle),
}


# ------------------------------------------------------------------ streams

def _arrivals(df: DataFrame, order_col: str, parts: int = 3) -> list[DataFrame]:
    """Consecutive parts of ``df`` in ``order_col`` order, about equally large
    (NULLs come with the first)."""
    at, cuts = F.col(order_col), cut_points(df, order_col, parts)
    out = []
    for lo, hi in zip([None, *cuts], [*cuts, None], strict=True):
        after = F.lit(True) if lo is None else at > lo
        upto = F.lit(True) if hi is None else (at <= hi) | at.isNull()
        out.append(df.where(after & upto))
    return out


def _intake_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I8 end to end: the derived requests land as files in three arrivals,
    the stream, restarted on its checkpoint each time, books them against a
    base snapshot; the last micro-batch is replayed, as after a crash before
    its commit. Returns the purchases booked."""
    from marquee.session import scratch_dir
    from marquee.sources import snapshots
    from marquee.streaming import streams
    work = scratch_dir(spark, "intake-stream")
    in_dir, root, ckpt = f"{work}/requests", f"{work}/store", f"{work}/checkpoint"
    tables = td.load_tables(spark, sf_dir, persist=True)
    try:
        snapshots.write_snapshot(tables, root, streams.BASE_VERSION, publish=False)
    finally:
        tables.release()
    arrivals = _arrivals(td.purchase_requests(spark, sf_dir), "request_id")
    for part in arrivals:
        part.write.mode("append").parquet(in_dir)
        streams.purchase_intake_stream(spark, in_dir, root, ckpt).awaitTermination()
    streams.run_intake_batch(arrivals[-1], len(arrivals) - 1, root)
    return streams.read_deltas(spark, root, "purchase")


def _changes_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I9 end to end: the derived Customer edits land as files in three
    arrivals, the stream adds the marks of each as a new Customer version, with
    a compaction between two of them; the last micro-batch is replayed. Returns
    the final version."""
    from marquee.session import scratch_dir
    from marquee.streaming import streams
    work = scratch_dir(spark, "changes-stream")
    in_dir, root, ckpt = f"{work}/changes", f"{work}/store", f"{work}/checkpoint"
    streams.init_change_table(td.customer(spark, sf_dir), root, "customer")
    arrivals = _arrivals(td.customer_changes(spark, sf_dir), "seq")
    for n, part in enumerate(arrivals):
        part.write.mode("append").parquet(in_dir)
        streams.table_changes_stream(spark, in_dir, root, "customer", ckpt).awaitTermination()
        if n == 1:
            streams.compact_change_table(spark, root, "customer")
    streams.run_change_batch(arrivals[-1], len(arrivals) - 1, root, "customer")
    return streams.read_change_table(spark, root, "customer")


def _cascades_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I9 over several tables end to end: cascading deletes, pair edits and
    ticket edits with M11 land as files in three arrivals; a table is compacted
    between two of them and the last micro-batch is replayed. Returns the
    touched tables and all rejects as tagged lines."""
    from marquee.session import scratch_dir
    from marquee.sources import snapshots
    from marquee.streaming import streams
    work = scratch_dir(spark, "cascades-stream")
    in_dir, root, ckpt = f"{work}/changes", f"{work}/store", f"{work}/checkpoint"
    tables = td.load_tables(spark, sf_dir, persist=True)
    try:
        snapshots.write_snapshot(tables, root, streams.BASE_VERSION, publish=False)
    finally:
        tables.release()
    arrivals = _arrivals(td.cascade_log(spark, sf_dir), "seq")
    for n, part in enumerate(arrivals):
        part.write.mode("append").parquet(in_dir)
        streams.table_cascades_stream(spark, in_dir, root, ckpt, rekey=True).awaitTermination()
        if n == 1:
            streams.compact(spark, root, "ticket")
    streams.run_cascade_batch(arrivals[-1], len(arrivals) - 1, root, rekey=True)
    t = snapshots.read_snapshot(spark, root)
    parts = {name: t.get(name) for name in ("purchase", "ticket", "cust_of", "customer", "event_catalog", "distributer")}
    parts["rejects"] = snapshots.read_rejects(spark, root, streams.CHANGE_REJECTS)
    return _lines(parts)


STREAMS: dict[str, Query] = {
    "purchase_intake_stream": _intake_stream,
    "table_changes_stream": _changes_stream,
    "table_cascades_stream": _cascades_stream,
}


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {k: _on_tables(f) for k, f in REPORTS.items()}
    for name in TABLE_SCHEMAS:
        q[f"scan_{name}"] = _scan(name)
    q.update({k: _on_tables(f) for k, f in LISTINGS.items()})
    q.update(LOOKUPS)
    q["validate_requests"] = lambda s, d: intake.validate_requests(td.purchase_requests(s, d))
    q.update({k: _intake_output(a) for k, a in INTAKE_OUTPUTS.items()})
    q.update(CHANGES)
    q.update(BUNDLES)
    q.update(STREAMS)
    return q
