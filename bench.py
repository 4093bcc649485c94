"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Steps (each timed):
  load_snapshot  map the driver tables to the seven ticketing tables and
                 store them as a parquet snapshot (what a deployment keeps);
  <query>        every report, lookup, intake output and change fold over
                 that snapshot, fully executed through the ``noop`` sink
                 (nothing is collected to the driver);
  admin_bundle   the admin page set with its shared persisted joins.
A tiny sf0.001 pass first warms the JVM (not counted). The workload then
runs ``BENCH_REPEAT`` times (default 2, each into a fresh folder) and every
step reports its best time; ``value`` is the sum of those. Prints one JSON
line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from marquee.operators import changes, intake, lookups, reports  # noqa: E402
from marquee.plans import bundles  # noqa: E402
from marquee.session import build_session, scratch_dir  # noqa: E402
from marquee.sources import snapshots  # noqa: E402
from marquee.sources import testdata as td  # noqa: E402
from marquee.schemas import TABLE_SCHEMAS  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
WARMUP_DIR = "/root/testdata/sf0.001"
REPEAT = max(1, int(os.environ.get("BENCH_REPEAT", "2")))


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def workload(spark, sf_dir: str, root: str, timings: dict | None) -> None:
    def timed(name, fn):
        t0 = time.perf_counter()
        fn()
        if timings is not None:
            timings[name] = round(time.perf_counter() - t0, 3)

    def load():
        tables = td.load_tables(spark, sf_dir, persist=True)
        try:
            snapshots.write_snapshot(tables, root, "0", parallelism=4)
        finally:
            tables.release()
    timed("load_snapshot", load)
    t = snapshots.read_snapshot(spark, root)
    requests = td.purchase_requests(spark, sf_dir)
    for name, fn in [
        ("event_type_popularity", reports.event_type_popularity),
        ("top_customer_by_class", reports.top_customer_by_class),
        ("top_customer_price_count", reports.top_customer_price_count),
        ("event_revenue", reports.event_revenue),
        ("company_most_events", reports.company_most_events),
        ("company_most_tickets", reports.company_most_tickets),
        ("company_sales_ranking", reports.company_sales_ranking),
        ("customer_loyalty", reports.customer_loyalty),
        ("event_listing", reports.event_listing),
    ]:
        timed(name, lambda fn=fn: run(fn(t)))
    timed("customer_by_email", lambda: run(lookups.customer_by_email(requests, t.customer)))
    timed("customer_profile",
          lambda: run(lookups.customer_profile(td.visits(spark, sf_dir), t.customer)))

    def do_intake():
        res = intake.purchase_intake(requests, t, persist=True)
        try:
            for df in (res.new_customers, res.new_cust_of, res.new_tickets, res.new_purchases,
                       res.rejects):
                run(df)
        finally:
            res.release()
    timed("purchase_intake", do_intake)
    timed("apply_customer_changes", lambda: run(changes.apply_changes(
        t.customer, td.customer_changes(spark, sf_dir), schema=TABLE_SCHEMAS["customer"])[0]))
    timed("update_event_properties", lambda: run(changes.update_property(
        t.event_catalog, td.event_property_changes(spark, sf_dir),
        schema=TABLE_SCHEMAS["event_catalog"])[0]))
    timed("delete_purchases", lambda: [run(x) for x in changes.delete_purchases(
        t.purchase, t.ticket, td.deleted_purchase_ids(spark, sf_dir))])

    def do_bundle():
        b = bundles.admin_bundle(t, class_spend=False, with_listings=False)
        try:
            b.run(lambda name, df: run(df), parallelism=4)
        finally:
            b.release()
    timed("admin_bundle", do_bundle)


def main() -> None:
    extra = {"spark.driver.memory": os.environ.get("BENCH_MEM", "16g")}
    if os.environ.get("BENCH_EVENTLOG"):
        # stage/task times for tools/stage_times.py, written to a scratch folder
        import tempfile
        log_dir = tempfile.mkdtemp(prefix="bench-events-", dir=os.environ.get("TMPDIR", "/tmp"))
        extra.update({"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir})
        print(f"event log: {log_dir}", file=sys.stderr)
    spark = build_session(master=f"local[{CPUS}]", shuffle_partitions=CPUS,
                          app_name="marquee-bench", extra=extra)
    if os.path.isdir(WARMUP_DIR) and os.path.abspath(SF_DIR) != os.path.abspath(WARMUP_DIR):
        workload(spark, WARMUP_DIR, scratch_dir(spark, "bench-warmup"), None)
    best: dict = {}
    walls = []
    for _ in range(REPEAT):
        timings: dict = {}
        t0 = time.perf_counter()
        workload(spark, SF_DIR, scratch_dir(spark, "bench"), timings)
        walls.append(round(time.perf_counter() - t0, 3))
        for k, v in timings.items():
            best[k] = min(v, best.get(k, v))
    sf = os.path.basename(os.path.normpath(SF_DIR)).replace("sf", "")
    print(json.dumps({"metric": "sum_of_best_step_sec", "value": round(sum(best.values()), 3),
                      "unit": "sec", "queries": best, "sf": sf, "cpus": CPUS,
                      "repeat": REPEAT, "wall_per_repeat": walls}))
    spark.stop()


if __name__ == "__main__":
    main()
