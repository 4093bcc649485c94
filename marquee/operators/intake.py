"""Purchase intake (I1-I7): a batch of purchase form submissions becomes new
Customer, cust_of, TICKET and Purchase rows plus a rejects table.

The reference handles one submission per HTTP request with ten separate
statements; here a whole batch is a handful of joins:

* validate (phone rule first, then e-mail rule);
* resolve each e-mail to an existing customer (smallest id) or a new one --
  one new customer per normalised e-mail, named from its first request;
* look up the event (unknown event: rejected, its customer is still
  created, as in the reference where the customer insert precedes the
  failing lookup);
* one ticket and one purchase per accepted request, ids dense in request
  order, the purchase linked to its own ticket (no "newest ticket" re-read);
* distributer = ``pmod(request_id, 24) + 1`` (deterministic stand-in for the
  reference's random pick), purchase time = the request's own timestamp.

No effect on ``tickets_available`` or ``income``: the reference has none.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions.semantics import UNKNOWN_EVENT_ERROR, ci_key, reject_reason, sale_price
from marquee.operators.keys import cut_points, dense_rank_by, next_ids_base
from marquee.operators.lookups import customer_ids_by_email, quote_events
from marquee.tables import Tables

# Fixed values of the booking step.
TICKETS_AVAILABLE = 100
TICKETS_SOLD = 1
N_DISTRIBUTERS = 24


@dataclass(frozen=True)
class IntakeResult:
    validated: DataFrame
    new_customers: DataFrame
    quotes: DataFrame
    new_cust_of: DataFrame
    new_tickets: DataFrame
    new_purchases: DataFrame
    rejects: DataFrame
    cached: list = field(default_factory=list)

    def release(self) -> None:
        for df in self.cached:
            df.unpersist()
        self.cached.clear()


def validate_requests(requests: DataFrame) -> DataFrame:
    """Every request with ``reject_reason`` (NULL when valid)."""
    return requests.withColumn("reject_reason", reject_reason("phone_num", "e_mail"))


def _valid(validated: DataFrame) -> DataFrame:
    return validated.where(F.col("reject_reason").isNull()).drop("reject_reason")


def new_customers(valid: DataFrame, customer: DataFrame,
                  known: DataFrame | None = None, id_base=None,
                  cuts: list | None = None) -> DataFrame:
    """One new Customer per normalised e-mail that is not known yet,
    named from its first request; ids continue after ``max(Customer.ID)``
    (or a given ``id_base``) in order of that first request."""
    keyed = valid if "_mail_key" in valid.columns else \
        valid.withColumn("_mail_key", ci_key("e_mail"))
    known = known if known is not None else customer_ids_by_email(customer, keyed)
    unknown = keyed.join(known, "_mail_key", "left_anti")
    firsts = (unknown.groupBy("_mail_key")
              .agg(F.min_by(F.struct("request_id", "first_name", "last_name", "e_mail",
                                     "phone_num"), "request_id").alias("r"))
              .select("_mail_key", "r.*"))
    ranked = dense_rank_by(firsts, "request_id", cuts=cuts)
    base = id_base if id_base is not None else next_ids_base(customer, "ID")
    return ranked.select(
        (base + F.col("_pos")).alias("ID"),
        "first_name", "last_name", "e_mail", "phone_num", "_mail_key", "request_id")


def resolve_customers(valid: DataFrame, known: DataFrame, created: DataFrame) -> DataFrame:
    """Customer id of every valid request: known e-mail -> existing id,
    otherwise the id created for it in this batch."""
    keyed = valid if "_mail_key" in valid.columns else \
        valid.withColumn("_mail_key", ci_key("e_mail"))
    ids = known.unionByName(created.select("_mail_key", F.col("ID").alias("customer_id")))
    return keyed.join(ids, "_mail_key", "left").drop("_mail_key")


def quote_tickets(valid_with_customer: DataFrame, event_catalog: DataFrame) -> DataFrame:
    """Company and price of each valid request (``General`` pays the
    general price, anything else the VIP price); unknown events are
    flagged with a reject reason."""
    quoted = quote_events(valid_with_customer, event_catalog)
    return quoted.select(
        *valid_with_customer.columns,
        "company_id",
        sale_price("ticket_type", "general_price", "vip_price").alias("price"),
        F.when(F.col("_event_known").isNull(), F.lit(UNKNOWN_EVENT_ERROR)).alias("reject_reason"))


def new_cust_of(accepted: DataFrame, cust_of: DataFrame) -> DataFrame:
    """I4: (company, customer) pairs not linked yet; NULL companies skip."""
    pairs = accepted.where(F.col("company_id").isNotNull()).select("company_id", "customer_id")
    return pairs.distinct().join(cust_of.select("company_id", "customer_id"),
                                 ["company_id", "customer_id"], "left_anti")


def book(accepted: DataFrame, t: Tables, id_bases: dict | None = None,
         cuts: list | None = None) -> tuple[DataFrame, DataFrame]:
    """I5 + I6: one TICKET and one Purchase per accepted request; both ids
    are dense in request order after the tables' current maxima (or the
    given ``id_bases``)."""
    bases = id_bases or {}
    ranked = dense_rank_by(accepted, "request_id", cuts=cuts)
    ticket_base = bases.get("ticket")
    purchase_base = bases.get("purchase")
    ticket_id = (ticket_base if ticket_base is not None else next_ids_base(t.ticket, "ID")) \
        + F.col("_pos")
    purchase_id = (purchase_base if purchase_base is not None
                   else next_ids_base(t.purchase, "purchase_id")) + F.col("_pos")
    booked = ranked.select("*", ticket_id.alias("_ticket_id"), purchase_id.alias("_purchase_id"))
    tickets = booked.select(
        F.col("_ticket_id").alias("ID"),
        F.col("ticket_type").alias("type"),
        F.lit(TICKETS_AVAILABLE).cast("int").alias("tickets_available"),
        F.lit(TICKETS_SOLD).cast("int").alias("tickets_sold"),
        F.col("price").cast("decimal(10,2)").alias("price"),
        "event_id",
        (F.pmod(F.col("request_id"), F.lit(N_DISTRIBUTERS)) + 1).cast("bigint")
        .alias("distributer_id"))
    purchases = booked.select(
        F.col("_purchase_id").alias("purchase_id"),
        "customer_id",
        F.col("_ticket_id").alias("ticket_id"),
        "payment_type",
        F.col("requested_at").alias("purchase_date"))
    return tickets, purchases


def purchase_intake(requests: DataFrame, t: Tables, persist: bool = False,
                    id_bases: dict | None = None) -> IntakeResult:
    """The whole pipeline over one batch of requests.

    With ``persist`` the validated requests, the new customers and the
    quoted requests are kept (memory, spilling to disk) so that writing all
    outputs runs the joins once; call ``release()`` afterwards. ``id_bases`` (``customer``,
    ``ticket``, ``purchase`` -> Column or int) replaces the ``max(ID)``
    scans of the three tables, e.g. with a stream's running high-water
    marks."""
    id_bases = {k: (F.lit(v).cast("bigint") if isinstance(v, int) else v)
                for k, v in (id_bases or {}).items()}
    cached = []

    def keep(df: DataFrame) -> DataFrame:
        if not persist:
            return df
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        cached.append(df)
        return df

    # the request batch feeds about ten branches (keys, dedup, resolution,
    # quotes, rank buckets): keep it once instead of re-deriving it
    validated = keep(validate_requests(requests))
    valid = _valid(validated).withColumn("_mail_key", ci_key("e_mail"))
    known = customer_ids_by_email(t.customer, valid)
    # one quantile pass over the batch's request ids serves both numberings
    cuts = cut_points(valid, "request_id")
    created = keep(new_customers(valid, t.customer, known, id_bases.get("customer"), cuts))
    with_customer = resolve_customers(valid, known, created)
    quotes = keep(quote_tickets(with_customer, t.event_catalog))
    accepted = quotes.where(F.col("reject_reason").isNull()).drop("reject_reason")
    tickets, purchases = book(accepted, t, id_bases, cuts)
    rejects = (validated.where(F.col("reject_reason").isNotNull())
               .select("request_id", "reject_reason")
               .unionByName(quotes.where(F.col("reject_reason").isNotNull())
                            .select("request_id", "reject_reason")))
    return IntakeResult(
        validated=validated,
        new_customers=created.drop("_mail_key", "request_id"),
        quotes=quotes,
        new_cust_of=new_cust_of(accepted, t.cust_of),
        new_tickets=tickets,
        new_purchases=purchases,
        rejects=rejects,
        cached=cached,
    )


def apply_intake(t: Tables, result: IntakeResult) -> Tables:
    """Tables after the batch: the four delta tables appended."""
    return (t.with_table("customer", t.customer.unionByName(result.new_customers))
            .with_table("cust_of", t.cust_of.unionByName(result.new_cust_of))
            .with_table("ticket", t.ticket.unionByName(result.new_tickets))
            .with_table("purchase", t.purchase.unionByName(result.new_purchases)))
