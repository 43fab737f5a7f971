"""Change-driven work (F1-F6), batch form.

F1 replaces a row trigger: "when an invoice's charge status changes to
'paid', settle it".  A record fires if its status reads 'paid' in lower case
and its raw text differs from the record before (for the first one: from the
invoice's status), as the trigger tests it; an invoice may fire more than
once.  Records are numbered within their invoice by a distributed sort and
joined with the record before on (invoice, number), so an invoice with a huge
status history is spread over many tasks.  The streaming forms in
:mod:`tipflow.streaming.settlement` give the same transitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipflow.sources.mart import Mart

# Fixed values of the reference: the bank movement that a settlement writes.
MOVEMENT_OPERATION, MOVEMENT_ACTOR = "P", "Webhook"
MOVEMENT_INFO = "Baixa automatica boleto paid - nota "


def settlement_fires(feed: DataFrame, start: DataFrame, once: bool = False) -> DataFrame:
    """Transitions into 'paid': (not_id, fire_at, fire_seq), one row each.

    ``feed``: (not_id, new_status, changed_at, seq), only the records to consider; ``start``:
    (not_id, start_status), the status before them.  ``once`` keeps the first of each invoice, which
    deviates from the trigger: a second payment then writes no second movement.
    """
    from tipflow.operators.ids import number_within
    f = number_within(feed.join(start, "not_id"), ["not_id"], ["changed_at", "seq"], "_n", sizes=feed)
    before = f.select("not_id", (F.col("_n") + 1).alias("_n"), F.col("new_status").alias("_before"))
    f = f.join(before, ["not_id", "_n"], "left")
    old = F.when(F.col("_n") == 1, F.col("start_status")).otherwise(F.col("_before"))
    fires = f.filter((F.lower("new_status") == "paid") & ~F.col("new_status").eqNullSafe(old)).select(
        "not_id", F.col("changed_at").alias("fire_at"), F.col("seq").alias("fire_seq"))
    return first_fires(fires) if once else fires


def first_fires(fires: DataFrame) -> DataFrame:
    """The first transition of each invoice."""
    return (fires.groupBy("not_id").agg(F.min(F.struct("fire_at", "fire_seq")).alias("f"))
            .select("not_id", "f.fire_at", "f.fire_seq"))


def movements_of(fires: DataFrame, invoice: DataFrame) -> DataFrame:
    """A bank movement for each transition: the paid value (else the invoice's), on the settlement
    date, which the first transition sets (``settled_at``: its time)."""
    return (fires.join(invoice, "not_id").select(
        F.col("not_id").alias("doc"), F.coalesce("paid_value", "invoice_value").cast("decimal(18,2)").alias("mov_value"),
        F.coalesce("settled_on", F.to_date("settled_at")).alias("mov_date"), "not_id",
        F.lit(MOVEMENT_OPERATION).alias("operation"), "ctb_id", F.lit(MOVEMENT_ACTOR).alias("actor"),
        F.concat(F.lit(MOVEMENT_INFO), F.col("not_id").cast("string")).alias("info")))


def new_feed_records(m: Mart, feed: DataFrame | None = None) -> DataFrame:
    """Feed records for existing invoices newer than the invoice's last status time."""
    feed = m.status_feed if feed is None else feed
    inv = m.invoice.select("not_id", "status_updated_at")
    return (feed.join(inv, "not_id")
            .filter(F.col("status_updated_at").isNull() | (F.col("changed_at") > F.col("status_updated_at")))
            .select("not_id", "new_status", "changed_at", "seq"))


def settle_paid_invoices(m: Mart, feed: DataFrame | None = None, once: bool = False) -> dict:
    """F1 batch form: invoice, bank movement, credit and batch effects of paid transitions.

    Settled invoices: situation 'BT', paid value COALESCE(paid, invoice value),
    settlement date COALESCE(existing, date of the first transition).  One bank
    movement 'P' per transition (``once``: per invoice).  Credits of the invoice not in
    status 1 become 1; batches 'C' holding those credits are reopened (NULL).  The
    invoice's charge status takes the newest record.  Re-running over the same feed
    changes nothing, because records not newer than the stored status time are ignored.
    """
    recs = new_feed_records(m, feed)
    start = m.invoice.select("not_id", F.col("charge_status").alias("start_status"))
    every = settlement_fires(recs, start, once)
    fires = first_fires(every)
    latest = (recs.groupBy("not_id").agg(F.max(F.struct("changed_at", "seq", "new_status")).alias("r"))
              .select("not_id", F.col("r.new_status").alias("last_status"), F.col("r.changed_at").alias("last_at"),
                      F.lit(True).alias("_new")))
    fired = F.col("fire_at").isNotNull()
    invoice = (m.invoice.join(fires, "not_id", "left").join(latest, "not_id", "left")
               .withColumn("situation", F.when(fired, F.lit("BT")).otherwise(F.col("situation")))
               .withColumn("paid_value", F.when(fired, F.coalesce("paid_value", "invoice_value"))
                           .otherwise(F.col("paid_value")))
               .withColumn("settled_on", F.when(fired, F.coalesce("settled_on", F.to_date("fire_at")))
                           .otherwise(F.col("settled_on")))
               .withColumn("charge_status", F.when(F.col("_new"), F.col("last_status")).otherwise(F.col("charge_status")))
               .withColumn("status_updated_at", F.coalesce("last_at", "status_updated_at"))
               .drop("last_status", "last_at", "fire_seq", "_new"))
    movements = movements_of(every.join(fires.select("not_id", F.col("fire_at").alias("settled_at")), "not_id"), m.invoice)
    hit = fires.select("not_id", F.lit(True).alias("_hit"))
    credit = (m.credit.join(hit, "not_id", "left")
              .withColumn("sit_id", F.when(F.col("_hit") & (F.col("sit_id") != 1), F.lit(1)).otherwise(F.col("sit_id")))
              .drop("_hit"))
    reopen = (m.credit.filter(F.col("batch_id").isNotNull()).select("batch_id", "not_id")
              .join(hit, "not_id").select("batch_id").distinct().withColumn("_hit", F.lit(True)))
    batch = (m.batch.join(reopen, "batch_id", "left")
             .withColumn("batch_status", F.when(F.col("_hit") & (F.col("batch_status") == "C"), F.lit(None))
                         .otherwise(F.col("batch_status")))
             .drop("_hit"))
    return {"invoice": invoice.drop("fire_at"), "movements": movements, "credit": credit, "batch": batch,
            "fires": fires}


def settlement_effects(m: Mart, fires: DataFrame) -> DataFrame:
    """F1 effect counts per settled invoice: credits released and batches reopened."""
    released = (m.credit.filter(F.col("sit_id") != 1).join(fires.select("not_id"), "not_id")
                .groupBy("not_id").agg(F.count(F.lit(1)).alias("credits_released")))
    reopened = (m.credit.select("batch_id", "not_id").join(fires.select("not_id"), "not_id").distinct()
                .join(m.batch.filter(F.col("batch_status") == "C").select("batch_id"), "batch_id")
                .groupBy("not_id").agg(F.count(F.lit(1)).alias("batches_reopened")))
    return (fires.select("not_id", "fire_at").join(released, "not_id", "left").join(reopened, "not_id", "left")
            .select("not_id", "fire_at", F.coalesce("credits_released", F.lit(0)).alias("credits_released"),
                    F.coalesce("batches_reopened", F.lit(0)).alias("batches_reopened")))


def lower_pix_limit(m: Mart, changes: DataFrame) -> DataFrame:
    """collaborators whose day/night value exceeds a lowered tenant limit, clamped.

    Only limits that went down (both sides non-NULL, new < old) act; NULL
    values stay NULL.  Returns the changed collaborator rows.
    """
    lowered = (changes.filter(F.col("old_limit").isNotNull() & F.col("new_limit").isNotNull()
                              & (F.col("new_limit") < F.col("old_limit")))
               .select("cli_id", "new_limit"))
    return clamped(m.collaborator.join(lowered, "cli_id"))


def clamped(u: DataFrame) -> DataFrame:
    """Rows of ``u (usr_id, cli_id, day_value, night_value, new_limit)`` above their limit, cut to it."""
    day_hit = F.col("day_value").isNotNull() & (F.col("day_value") > F.col("new_limit"))
    night_hit = F.col("night_value").isNotNull() & (F.col("night_value") > F.col("new_limit"))
    return (u.filter(day_hit | night_hit)
            .select("usr_id", "cli_id",
                    F.when(day_hit, F.col("new_limit")).otherwise(F.col("day_value")).cast("decimal(18,2)").alias("day_value"),
                    F.when(night_hit, F.col("new_limit")).otherwise(F.col("night_value")).cast("decimal(18,2)").alias("night_value")))


def lowered_limits(feed: DataFrame, tenant: DataFrame) -> DataFrame:
    """F2 over a history: (cli_id, new_limit, changed_at, seq) of the records that lower their tenant's limit.

    ``feed (cli_id, new_limit, changed_at, seq)``: each record is compared with the one before it, the
    first with ``tenant.pix_limit``; a missing limit on either side lowers nothing.
    """
    from tipflow.operators.ids import number_within
    known = feed.join(tenant.select("cli_id", F.col("pix_limit").alias("_start")), "cli_id")
    f = number_within(known, ["cli_id"], ["changed_at", "seq"], "_n", sizes=feed)
    before = f.select("cli_id", (F.col("_n") + 1).alias("_n"), F.col("new_limit").alias("_before"))
    f = f.join(before, ["cli_id", "_n"], "left")
    old = F.when(F.col("_n") == 1, F.col("_start")).otherwise(F.col("_before"))
    return f.filter(F.col("new_limit") < old).select("cli_id", "new_limit", "changed_at", "seq")


def pix_limit_trigger(m: Mart, feed: DataFrame | None = None) -> DataFrame:
    """F2 batch form over a history of limits: the collaborators it changes, with their values after it.

    Cutting to several limits in a row is cutting to the least of them, so the order of a
    tenant's changes matters only for which of them lower the limit.
    """
    feed = m.limit_feed if feed is None else feed
    least = lowered_limits(feed, m.tenant).groupBy("cli_id").agg(F.min("new_limit").alias("new_limit"))
    return clamped(m.collaborator.join(least, "cli_id"))


def _grain(col, grain: str):
    return F.to_date(col) if grain == "day" else F.year(col)


def backfill_pairs(m: Mart, grain: str = "day") -> DataFrame:
    """batches with unlinked credits paired with open invoices of the same tenant and day.

    Both sides are numbered per (tenant, day) in id order and paired on equal
    numbers; ``grain='year'`` pairs per tenant and year.  Each row carries the
    number of unlinked credits of the batch.  Numbering uses
    :func:`number_within`, so a tenant with a huge number of batches in one
    period is still numbered by many tasks.
    """
    from tipflow.operators.ids import number_within
    unlinked = (m.credit.filter(F.col("not_id").isNull() & F.col("batch_id").isNotNull())
                .groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_credits")))
    rb = number_within(m.batch.join(unlinked, "batch_id")
                       .select("batch_id", "cli_id", "n_credits", _grain("imported_at", grain).alias("g")),
                       ["cli_id", "g"], ["batch_id"], "rn", sizes=m.batch.select("cli_id", _grain("imported_at", grain).alias("g")))
    nb = number_within(m.invoice.filter(F.col("situation") == "A")
                       .select("not_id", "cli_id", _grain("issue_date", grain).alias("g")),
                       ["cli_id", "g"], ["not_id"], "rn", sizes=m.invoice.select("cli_id", _grain("issue_date", grain).alias("g")))
    return (rb.join(nb, ["cli_id", "g", "rn"])
            .select("batch_id", "cli_id", F.col("g").cast("string").alias("period"), "not_id", "n_credits"))


def backfill_apply(m: Mart, pairs: DataFrame) -> DataFrame:
    """credit table with the paired invoice written where the link is NULL."""
    p = pairs.select("batch_id", F.col("not_id").alias("_paired"))
    return (m.credit.join(p, "batch_id", "left")
            .withColumn("not_id", F.coalesce("not_id", "_paired")).drop("_paired"))


def credits_without_invoice(credit: DataFrame) -> DataFrame:
    """credits still without invoice per tenant, batch and import day."""
    return (credit.filter(F.col("not_id").isNull() & F.col("batch_id").isNotNull())
            .groupBy("cli_id", "batch_id", "import_date").agg(F.count(F.lit(1)).alias("n_credits")))


# Fixed values of the reference: request limits per client address.
RATE_RULES = [
    ("general", None, "1 minute", 200),
    ("login", "login", "15 minutes", 15),
    ("reset", "reset", "15 minutes", 3),
]


def rate_limit_breaches(log: DataFrame, rules=RATE_RULES) -> DataFrame:
    """fixed (epoch-aligned) windows per client whose request count exceeds a rule's limit."""
    out = None
    for name, route, width, limit in rules:
        src = log if route is None else log.filter(F.col("route") == route)
        b = (src.groupBy("client_id", F.window("req_at", width).alias("w"))
             .agg(F.count(F.lit(1)).alias("n"))
             .filter(F.col("n") > limit)
             .select("client_id", F.lit(name).alias("rule"), F.col("w.start").alias("window_start"),
                     F.col("w.end").alias("window_end"), "n"))
        out = b if out is None else out.unionByName(b)
    return out
