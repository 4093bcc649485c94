"""Randomised checks against brute-force Python models of the same rules."""

import re
from decimal import ROUND_HALF_UP, Decimal, localcontext

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from marquee import schemas as S
from marquee.functions.semantics import lenient_decimal
from marquee.operators import changes as ch
from marquee.operators.keys import dense_rank_by

PREFIX = re.compile(r"^[ \t\n\r\f\v]*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)", re.ASCII)
LIMIT = Decimal(9999999999)
SETTINGS = settings(max_examples=10, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture,
                                           HealthCheck.too_slow])


def model_lenient(s):
    """The database's CAST(text AS DECIMAL): numeric prefix, half away from
    zero, clamped."""
    if s is None:
        return None
    m = PREFIX.match(s)
    if not m:
        return Decimal(0)
    with localcontext() as ctx:
        ctx.prec = 200
        ctx.Emax = 10 ** 6
        ctx.Emin = -10 ** 6
        try:
            d = Decimal(m.group(1))
        except Exception:
            return Decimal(0)
        if abs(d) >= LIMIT + Decimal("0.5"):
            return LIMIT if d > 0 else -LIMIT
        return d.quantize(Decimal(1), rounding=ROUND_HALF_UP)


texts = st.one_of(st.none(), st.text(alphabet="0123456789.+-eE $,USD/ \t", max_size=14))


@SETTINGS
@given(st.lists(texts, min_size=1, max_size=40))
def test_lenient_decimal_matches_model(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    got = {r.i: r.d for r in df.select("i", lenient_decimal("s").alias("d")).collect()}
    for i, v in enumerate(values):
        want = model_lenient(v)
        assert (got[i] is None and want is None) or got[i] == want, (v, got[i], want)


def model_fold(snapshot: dict, log: list) -> dict:
    """Sequential single-row statements: insert of a live key, update or
    delete of an absent key are no-ops."""
    state = {k: dict(v) for k, v in snapshot.items()}
    for seq, op, key, prop, value, row in sorted(log, key=lambda e: e[0]):
        if op == "insert" and key not in state:
            state[key] = {"name": row[1], "location": row[2]}
        elif op == "delete":
            state.pop(key, None)
        elif op == "update" and key in state and prop in ("name", "location"):
            state[key][prop] = value
    return state


entries = st.tuples(st.sampled_from(["insert", "update", "delete"]), st.integers(0, 5),
                    st.sampled_from(["name", "location"]), st.sampled_from(["a", "b", "c", "d"]))


@SETTINGS
@given(st.sets(st.integers(0, 5)), st.lists(entries, max_size=25))
def test_fold_matches_sequential_model(spark, live, raw_log):
    snapshot = {k: {"name": f"n{k}", "location": f"l{k}"} for k in live}
    log = []
    for seq, (op, key, prop, value) in enumerate(raw_log):
        if op == "insert":
            log.append((seq, op, key, None, None, (key, f"i{seq}", value)))
        elif op == "update":
            log.append((seq, op, key, prop, value, None))
        else:
            log.append((seq, op, key, None, None, None))
    snap_df = spark.createDataFrame([(k, v["name"], v["location"]) for k, v in snapshot.items()],
                                    S.DISTRIBUTER)
    log_df = spark.createDataFrame(log, S.change_schema(S.DISTRIBUTER))
    out, _ = ch.apply_changes(snap_df, log_df, schema=S.DISTRIBUTER)
    got = {r.ID: {"name": r.name, "location": r.location} for r in out.collect()}
    assert got == model_fold(snapshot, log)


@SETTINGS
@given(st.lists(st.integers(-10 ** 12, 10 ** 12), unique=True, max_size=300),
       st.integers(1, 12))
def test_dense_rank_is_the_sorted_position(spark, keys, n_buckets):
    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    got = {r.k: r._pos for r in dense_rank_by(df, "k", n_buckets=n_buckets).collect()}
    assert got == {k: i + 1 for i, k in enumerate(sorted(keys))}


# ---------------------------------------------------------------- intake model

import datetime as _dt  # noqa: E402

from marquee.operators import intake as _intake  # noqa: E402
from marquee.tables import Tables  # noqa: E402

_T0 = _dt.datetime(2024, 5, 1)
_EVENTS = {1: (10, Decimal("10.00"), Decimal("25.00")), 2: (None, Decimal("5.00"), Decimal("9.00")),
           3: (20, Decimal("7.50"), Decimal("8.00"))}
_CUSTOMERS = [(3, "Al", "A", "a@x.com", "5550000003"), (7, "Ed", "E", "e@x.com", "5550000007")]


def model_intake(requests):
    """The reference's form handler, one request after another."""
    customers = [list(c) for c in _CUSTOMERS]
    cust_of = {(10, 3)}
    max_t, max_p = 40, 70
    out = {"customers": [], "tickets": [], "purchases": [], "cust_of": set(), "rejects": {}}
    for rid, first, mail, phone, event, ttype in sorted(requests):
        if not (len(phone) == 10 and phone.isdigit()):
            out["rejects"][rid] = "Invalid Phone Number!"
            continue
        if not mail.endswith(".com"):
            out["rejects"][rid] = "Invalid Email!"
            continue
        same = [c[0] for c in customers if c[3].lower() == mail.lower()]
        if same:
            cid = min(same)
        else:
            cid = max(c[0] for c in customers) + 1
            customers.append([cid, first, "L", mail, phone])
            out["customers"].append((cid, first, mail))
        if event not in _EVENTS:
            out["rejects"][rid] = "Unknown event"
            continue
        company, general, vip = _EVENTS[event]
        if company is not None and (company, cid) not in cust_of:
            cust_of.add((company, cid))
            out["cust_of"].add((company, cid))
        price = general if ttype == "General" else vip
        max_t += 1
        max_p += 1
        out["tickets"].append((max_t, ttype, price, event, rid % 24 + 1))
        out["purchases"].append((max_p, cid, max_t))
    return out


_req = st.tuples(st.sampled_from(["Ann", "Bo", "Cy"]),
                 st.sampled_from(["a@x.com", "A@X.com", "b@x.com", "B@x.com", "c@x.org",
                                  "d@x.com", "e@X.COM"]),
                 st.sampled_from(["5551234567", "123", "5550000000", "555000000a"]),
                 st.sampled_from([1, 2, 3, 99]),
                 st.sampled_from(["General", "VIP", "general", "Select Ticket Type"]))


@settings(max_examples=6, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(st.lists(_req, max_size=25), st.randoms(use_true_random=False))
def test_intake_matches_sequential_model(spark, raw, rnd):
    ids = rnd.sample(range(1, 10_000), len(raw))
    requests = [(rid,) + r for rid, r in zip(ids, raw)]
    t0 = _dt.datetime(2024, 1, 1)
    events = spark.createDataFrame(
        [(k, f"e{k}", "T", "L", t0, g, v, None, None, None, c) for k, (c, g, v) in _EVENTS.items()],
        S.EVENT_CATALOG)
    t = Tables(
        event_catalog=events,
        company=spark.createDataFrame([(10, "C10", "X"), (20, "C20", "Y")], S.COMPANY),
        distributer=spark.createDataFrame([], S.DISTRIBUTER),
        customer=spark.createDataFrame(_CUSTOMERS, S.CUSTOMER),
        ticket=spark.createDataFrame([(40, "vip", 100, 1, Decimal("1.00"), 1, 1)], S.TICKET),
        purchase=spark.createDataFrame([(70, 3, 40, "Cash", t0)], S.PURCHASE),
        cust_of=spark.createDataFrame([(10, 3)], S.CUST_OF))
    req_df = spark.createDataFrame(
        [(rid, _T0, first, "L", mail, phone, event, ttype, "Cash")
         for rid, first, mail, phone, event, ttype in requests], S.PURCHASE_REQUEST)
    res = _intake.purchase_intake(req_df, t)
    want = model_intake(requests)
    assert sorted((r.ID, r.first_name, r.e_mail) for r in res.new_customers.collect()) == \
        sorted(want["customers"])
    assert sorted((r.ID, r.type, r.price, r.event_id, r.distributer_id)
                  for r in res.new_tickets.collect()) == want["tickets"]
    assert sorted((r.purchase_id, r.customer_id, r.ticket_id)
                  for r in res.new_purchases.collect()) == want["purchases"]
    assert {(r.company_id, r.customer_id) for r in res.new_cust_of.collect()} == want["cust_of"]
    assert {r.request_id: r.reject_reason for r in res.rejects.collect()} == want["rejects"]


# ---------------------------------------------------------------- fold with key changes

import random  # noqa: E402


def model_fold_with_renames(snapshot: dict, log: list) -> tuple[dict, list]:
    """Sequential statements including ``UPDATE ... SET ID = new``: a rename
    moves a live row to a free key, fails on a live one and does nothing
    without a row. Returns (rows, seqs that failed)."""
    state, failed = {k: dict(v) for k, v in snapshot.items()}, []
    for seq, op, key, prop, value, row in sorted(log, key=lambda e: e[0]):
        if key is None or (prop == "ID" and not value.isdigit()):
            failed.append(seq)
        elif op == "update" and prop == "ID":
            new = int(value)
            if key in state and new not in state:
                state[new] = state.pop(key)
            elif key in state and new != key:
                failed.append(seq)
        elif op == "insert" and key not in state:
            state[key] = {"name": row[1], "location": row[2]}
        elif op == "delete":
            state.pop(key, None)
        elif op == "update" and key in state and prop in ("name", "location"):
            state[key][prop] = value
    return state, failed


def test_fold_with_key_changes_equals_one_by_one(spark):
    """200 random logs over keys of their own, interleaved in one batch:
    chains, edits after a rename, retries, swaps, deletes and re-inserts
    around renames, NULL keys and unreadable targets."""
    rnd = random.Random(11)
    snapshot, log = {}, []
    for case in range(200):
        base = case * 10
        for k in range(7):
            if rnd.random() < 0.5:
                snapshot[base + k] = {"name": f"n{base + k}", "location": f"l{base + k}"}
        for _ in range(rnd.randint(0, 14)):
            seq, key = len(log), base + rnd.randint(0, 6)
            op = rnd.choice(["insert", "update", "delete", "rename", "rename"])
            if rnd.random() < 0.03:
                key = None
            if op == "insert":
                log.append((op, key, None, None, (key, f"i{rnd.random()}", "new")))
            elif op == "update":
                log.append((op, key, rnd.choice(["name", "location"]), f"u{rnd.random()}", None))
            elif op == "rename":
                log.append(("update", key, "ID", "x" if rnd.random() < 0.05 else str(base + rnd.randint(0, 7)), None))
            else:
                log.append((op, key, None, None, None))
    order = sorted(range(len(log)), key=lambda _: rnd.random())
    log = [(seq, *entry) for seq, entry in zip(order, log)]
    snap_df = spark.createDataFrame([(k, v["name"], v["location"]) for k, v in snapshot.items()], S.DISTRIBUTER)
    out, rejects = ch.apply_changes(snap_df, spark.createDataFrame(log, S.change_schema(S.DISTRIBUTER)),
                                    schema=S.DISTRIBUTER)
    want, failed = model_fold_with_renames(snapshot, log)
    assert {r.ID: {"name": r.name, "location": r.location} for r in out.collect()} == want
    assert sorted(r.seq for r in rejects.collect()) == sorted(failed)
