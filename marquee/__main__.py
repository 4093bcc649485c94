"""Command line: ``python -m marquee <command> ...``.

  load-testdata  --sf-dir D --root R [--version V]
                 map a driver scale-factor folder to the seven tables, store
                 them as a snapshot version and publish it
  load-jdbc      --url U --root R [--version V] [--partitions N] [--prop k=v ...]
                 copy the seven tables from the source database
  report         --root R --name NAME --out O [--version V]
                 one report (R1-R9, E1) or listing, written as parquet
  bundle         --root R --page admin|admin-class|manager|public --out O
                 a page's report set, one parquet table per report
  intake         --root R --requests P --out O [--format parquet|json|csv]
                 a batch of purchase requests (PURCHASE_REQUEST shape; json =
                 one form post per line): new rows and rejects under O, and
                 the tables with the new rows as the next published version
  apply-changes  --root R --table T --changes P [--key ID] [--marks]
                 fold a change log (parquet, change_schema of T) into the
                 next published snapshot version; rejects under R/rejects.
                 With --marks only the rows of changed keys are written and
                 merged when read; compact folds them into the table
  insert-forms   --root R --table T --requests P [--format parquet|json|csv]
                 rows as forms post them (seq and every column of T as text):
                 one more folder of new rows; rejects under R/rejects
  delete-purchases --root R --requests P [--format parquet|json|csv]
                 purchases by purchase_id, each with its ticket, into the next
                 version
  delete-cust-of --root R --requests P [--format parquet|json|csv]
                 (seq, pair_text "company,customer"): the links and their
                 customers; malformed texts under R/rejects
  lookup         --root R --name customer_by_email|match_contacts|customer_profile
                 --requests P --out O [--format parquet|json|csv]
                 lookups for a file of requests (request_id, e_mail,
                 phone_num) or visits (visit_id, customer_id)
  compact        --root R --table T
                 rewrite a table's folders (base, appended rows, marks) as
                 one folder in the next version

Jobs that change a root may run side by side: each publishes the version after
the one it read, on top of versions that changed other tables, and fails if a
table it read or wrote has changed meanwhile.
"""

from __future__ import annotations

import argparse
import sys

from marquee.operators import changes, intake, listings, lookups, reports
from marquee.plans import bundles
from marquee.schemas import PURCHASE_REQUEST, TABLE_KEYS, TABLE_SCHEMAS, change_schema
from marquee.session import build_session
from marquee.sources import snapshots
from marquee.sources import testdata as td

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
    "ticket_narrow": listings.ticket_narrow,
    "cust_of_pairs": listings.cust_of_pairs,
    "event_cards": listings.event_cards,
    "event_picker": listings.event_picker,
    "distributer_picker": listings.distributer_picker,
}


def _next_version(spark, root: str) -> str:
    try:
        return snapshots.version_name(int(snapshots.current_version(spark, root)) + 1)
    except FileNotFoundError:
        return snapshots.version_name(0)


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="marquee", description=__doc__,
                                 formatter_class=argparse.RawDescriptionHelpFormatter)
    ap.add_argument("command", choices=["load-testdata", "load-jdbc", "report", "bundle", "intake",
                                        "apply-changes", "compact", "lookup", "insert-forms",
                                        "delete-purchases", "delete-cust-of"])
    ap.add_argument("--root")
    ap.add_argument("--version")
    ap.add_argument("--sf-dir")
    ap.add_argument("--url")
    ap.add_argument("--partitions", type=int, default=32)
    ap.add_argument("--prop", action="append", default=[])
    ap.add_argument("--name")
    ap.add_argument("--page")
    ap.add_argument("--out")
    ap.add_argument("--requests")
    ap.add_argument("--format", default="parquet", help="request/change file format")
    ap.add_argument("--table")
    ap.add_argument("--changes")
    ap.add_argument("--key", default="ID")
    ap.add_argument("--marks", action="store_true")
    ap.add_argument("--master")
    a = ap.parse_args(argv)
    spark = build_session(master=a.master)
    if a.version and a.command in ("intake", "apply-changes", "compact", "insert-forms", "delete-purchases", "delete-cust-of") \
            and a.version != snapshots.current_version(spark, a.root):
        ap.error(f"{a.command} writes on top of the current version, {a.version} is not it")

    if a.command == "load-testdata":
        t = td.load_tables(spark, a.sf_dir, persist=True)
        try:
            snapshots.write_snapshot(t, a.root, a.version or _next_version(spark, a.root),
                                     parallelism=4)
        finally:
            t.release()
    elif a.command == "load-jdbc":
        props = dict(p.split("=", 1) for p in a.prop)
        t = snapshots.read_jdbc_tables(spark, a.url, props, a.partitions)
        snapshots.write_snapshot(t, a.root, a.version or _next_version(spark, a.root),
                                 parallelism=4, check_keys=True)
    elif a.command == "report":
        t = snapshots.read_snapshot(spark, a.root, a.version)
        REPORTS[a.name](t).write.mode("errorifexists").parquet(a.out)
    elif a.command == "bundle":
        t = snapshots.read_snapshot(spark, a.root, a.version)
        make = {"admin": lambda: bundles.admin_bundle(t),
                "admin-class": lambda: bundles.admin_bundle(t, class_spend=True),
                "manager": lambda: bundles.manager_bundle(t),
                "public": lambda: bundles.public_bundle(t)}[a.page]
        make().write(a.out, parallelism=4)
    elif a.command == "intake":
        base = a.version or snapshots.current_version(spark, a.root)
        t = snapshots.read_snapshot(spark, a.root, base)
        reader = spark.read.schema(PURCHASE_REQUEST).format(a.format)
        if a.format == "csv":
            reader = reader.option("header", "true")
        reqs = reader.load(a.requests)
        bases = {k: v for k, v in snapshots.max_ids(spark, a.root, base).items()
                 if v is not None and k in snapshots.NUMBERED_TABLES}
        res = intake.purchase_intake(reqs, t, persist=True, id_bases=bases)
        try:
            for name in ("new_customers", "new_cust_of", "new_tickets", "new_purchases", "rejects"):
                getattr(res, name).write.mode("errorifexists").parquet(f"{a.out}/{name}")
        finally:
            res.release()
        # the next version lists one more folder per grown table (new rows
        # only, read back from what was just written); nothing is copied
        grown = {"customer": "new_customers", "cust_of": "new_cust_of",
                 "ticket": "new_tickets", "purchase": "new_purchases"}
        new_rows = t
        for n, d in grown.items():
            new_rows = new_rows.with_table(
                n, spark.read.schema(TABLE_SCHEMAS[n]).parquet(f"{a.out}/{d}"))
        snapshots.commit(spark, a.root, base, append={n: new_rows.get(n) for n in grown}, reads={"event_catalog"})
    elif a.command == "apply-changes":
        base = a.version or snapshots.current_version(spark, a.root)
        t = snapshots.read_snapshot(spark, a.root, base)
        log = spark.read.schema(change_schema(TABLE_SCHEMAS[a.table])).format(a.format) \
            .load(a.changes)
        if a.marks:
            marks, rejects = changes.change_marks(t.get(a.table), log, a.key, TABLE_SCHEMAS[a.table])
            snapshots.commit(spark, a.root, base, marks={a.table: marks}, rejects=rejects)
        else:
            out, rejects = changes.apply_changes(t.get(a.table), log, a.key, TABLE_SCHEMAS[a.table])
            snapshots.commit(spark, a.root, base, rewrite={a.table: out}, rejects=rejects)
    elif a.command == "insert-forms":
        base = a.version or snapshots.current_version(spark, a.root)
        t = snapshots.read_snapshot(spark, a.root, base)
        schema = TABLE_SCHEMAS[a.table]
        reader = spark.read.format(a.format).schema(", ".join(["seq bigint", *[f"`{n}` string" for n in schema.names]]))
        if a.format == "csv":
            reader = reader.option("header", "true")
        fresh, rejects = changes.fresh_forms(t.get(a.table), reader.load(a.requests), schema, TABLE_KEYS[a.table])
        snapshots.commit(spark, a.root, base, append={a.table: fresh}, rejects=rejects)
    elif a.command in ("delete-purchases", "delete-cust-of"):
        base = a.version or snapshots.current_version(spark, a.root)
        t = snapshots.read_snapshot(spark, a.root, base)
        pairs = a.command == "delete-cust-of"
        reader = spark.read.format(a.format).schema("seq bigint, pair_text string" if pairs else "purchase_id bigint")
        if a.format == "csv":
            reader = reader.option("header", "true")
        given, rejects = reader.load(a.requests), None
        if pairs:
            links, customers, rejects = changes.delete_cust_of(t.cust_of, t.customer, given)
            cut = {"cust_of": links, "customer": customers}
        else:
            purchases, tickets = changes.delete_purchases(t.purchase, t.ticket, given)
            cut = {"purchase": purchases, "ticket": tickets}
        snapshots.commit(spark, a.root, base, rewrite=cut, rejects=rejects)
    elif a.command == "lookup":
        t = snapshots.read_snapshot(spark, a.root, a.version)
        reader = spark.read.format(a.format)
        if a.format == "csv":
            reader = reader.option("header", "true").option("inferSchema", "false")
        given = reader.load(a.requests)
        if a.name == "customer_profile":
            out = lookups.customer_profile(
                given.select("visit_id", given["customer_id"].cast("bigint")), t.customer)
        else:
            fn = {"customer_by_email": lookups.customer_by_email,
                  "match_contacts": lookups.match_contacts}[a.name]
            out = fn(given.withColumn("request_id", given["request_id"].cast("bigint")),
                     t.customer)
        out.write.mode("errorifexists").parquet(a.out)
    elif a.command == "compact":
        base = a.version or snapshots.current_version(spark, a.root)
        t = snapshots.read_snapshot(spark, a.root, base)
        snapshots.commit(spark, a.root, base, rewrite={a.table: t.get(a.table)})
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
