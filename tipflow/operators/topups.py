"""Top-ups, invoices and batches.

Read queries aggregate credits per (batch, invoice) first and join the
invoice once, deriving "live invoice" columns with ``when(situation <> 'C')``
instead of joining the invoice table twice.  Table-changing jobs return a
dict of new-state frames (unchanged rows included) plus a decision frame;
:func:`tipflow.sources.sinks.write_state` stages and swaps them.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tipflow.functions.columns import (MONEY, MONEY_SUM, badge_status, cents, digits, div_round2, distinct_from,
                                       fee_split, fee_type_default, in_period,
                                       js_trim, leading_number, list_status, lower_in, pct, share_cents, sql_digits)
from tipflow.functions import messages as M
from tipflow.sources.mart import Mart

# Fixed values of the reference: field widths and statuses that a feed no longer changes.
TITLE_CHARS, ACTOR_CHARS = 40, 20
FINAL_CHARGE_STATUSES = ["paid", "settled", "canceled", "cancelled", "expired"]


def _tenant_filter(df, cli_id):
    return df if cli_id is None else df.filter(F.col("cli_id") == cli_id)


def _live(col):
    return F.when(distinct_from("situation", "C"), F.col(col))


def topup_history(m: Mart, start=None, end=None, cli_id=None) -> DataFrame:
    """Per batch x live invoice: credit count, gross, tenant fee, invoice values.

    Invoice values come from any invoice of the batch's credits, charge
    fields only from non-cancelled ones; a batch whose credits point to two
    live invoices yields two rows (S10).  Import-date bounds: >= start and
    <= end + 1 day.
    """
    b = _tenant_filter(m.batch, cli_id)
    if start is not None:
        b = b.filter(in_period("imported_at", start, end, "next_midnight", kind="timestamp"))
    parts = (m.credit.groupBy("batch_id", "not_id")
             .agg(F.count(F.lit(1)).alias("n"), F.sum("credit_value").alias("s")))
    # sums and values by (batch, live invoice); what describes either joins after
    inv = m.invoice.select("not_id", "situation", "invoice_value", "movement_value")
    sums = (parts.join(inv, "not_id", "left").withColumn("live_not_id", _live("not_id")).groupBy("batch_id", "live_not_id")
            .agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("invoice_value").alias("invoice_value"),
                 F.max("movement_value").alias("movement_value")))
    live = m.invoice.select(F.col("not_id").alias("live_not_id"), "charge_status", "pix_qrcode", "barcode_line")
    t = m.tenant.select("cli_id", "trade_name", "fee_rate", "fee_type")
    return (b.join(t, "cli_id").join(sums, "batch_id", "left").join(live, "live_not_id", "left")
            .select("batch_id", "cli_id", "imported_at", "created_by", "batch_status", "title",
                    "trade_name", F.coalesce("fee_rate", F.lit(0).cast("decimal(9,4)")).alias("fee_rate"),
                    fee_type_default("fee_type").alias("fee_type"),
                    F.coalesce("n", F.lit(0)).alias("n_credits"),
                    F.coalesce("s", F.lit(0)).cast(MONEY_SUM).alias("gross"), F.col("live_not_id").alias("not_id"),
                    "invoice_value", "movement_value", "charge_status", "pix_qrcode", "barcode_line"))


def topup_history_count(m: Mart, start=None, end=None, cli_id=None) -> DataFrame:
    """D1 companion: number of batches per tenant under the same date filter."""
    b = _tenant_filter(m.batch, cli_id)
    if start is not None:
        b = b.filter(in_period("imported_at", start, end, "next_midnight", kind="timestamp"))
    return b.groupBy("cli_id").agg(F.count(F.lit(1)).alias("n_batches"))


def page(df: DataFrame, order_cols, limit: int = 50, offset: int = 0, per: str | None = "cli_id") -> DataFrame:
    """One page; ``limit`` and ``offset`` must be a positive and a non-negative number.

    ``per='cli_id'`` pages every tenant at once (row_number between bounds);
    ``per=None`` is the single global page (``orderBy().offset().limit()``).  The reference's screens
    cut larger sizes silently; :func:`clamped_page` is that rule for callers that want it.
    """
    if int(limit) < 1 or int(offset) < 0:
        raise ValueError(f"page size {limit} at {offset}")
    if per is None:
        return df.orderBy(*order_cols).offset(offset).limit(limit)
    w = Window.partitionBy(per).orderBy(*order_cols)
    return (df.withColumn("_rn", F.row_number().over(w))
            .filter((F.col("_rn") > offset) & (F.col("_rn") <= offset + limit)).drop("_rn"))


def clamped_page(limit=None, offset=None, default: int = 50, most: int = 500) -> tuple[int, int]:
    """Page size and offset as the reference's screens bound them."""
    return min(max(int(limit or default), 1), most), max(int(offset or 0), 0)


def topup_detail(m: Mart, cli_id=None, batch_id=None) -> DataFrame:
    """One row per credit with collaborator, tenant, batch and invoice columns."""
    c = _tenant_filter(m.credit, cli_id)
    if batch_id is not None:
        c = c.filter(F.col("batch_id") == batch_id)
    u = m.collaborator.select("usr_id", "usr_name", F.col("cpf").alias("usr_cpf"))
    t = m.tenant.select("cli_id", "trade_name", "fee_rate", "fee_type")
    b = m.batch.select("batch_id", "created_by", "imported_at", "batch_status", "title")
    inv = m.invoice.select("not_id", "situation", "invoice_value", "service_value", "movement_value",
                           "charge_id", "barcode", "barcode_line", "pix_qrcode", "pdf_url",
                           "qrcode_url", "charge_status")
    return (c.select("cre_id", "usr_id", "cli_id", "batch_id", "not_id", "credit_value", "credit_date")
            .join(u, "usr_id").join(t, "cli_id").join(b, "batch_id")
            .join(inv, "not_id", "left")
            .select("cre_id", "usr_id", "usr_name", F.col("usr_cpf").alias("cpf"),
                    F.col("credit_value").alias("gross"), "credit_date",
                    F.coalesce("fee_rate", F.lit(0).cast("decimal(9,4)")).alias("fee_rate"),
                    fee_type_default("fee_type").alias("fee_type"),
                    "created_by", "imported_at", "batch_status", "trade_name", "title", "cli_id", "batch_id",
                    _live("not_id").alias("live_not_id"), "invoice_value", "service_value", "movement_value",
                    *[_live(x).alias(x) for x in ["charge_id", "barcode", "barcode_line", "pix_qrcode",
                                                  "pdf_url", "qrcode_url", "charge_status"]]))


def batch_totals(m: Mart, cli_id=None) -> DataFrame:
    """D3 totals per batch: gross; stored charge/service/movement when an invoice exists.

    With an invoice the type is inferred ('A' when charge > gross + 0.005) and
    the rate is service / gross in percent; without one, the tenant's current
    rate and type apply through :func:`fee_split`.  The invoice of a batch is
    the highest invoice id its credits reference.
    """
    c = _tenant_filter(m.credit, cli_id)
    g = c.groupBy("batch_id", "cli_id").agg(F.sum("credit_value").cast("decimal(20,2)").alias("gross"),
                                            F.max("not_id").alias("not_id"))
    inv = m.invoice.select("not_id", "invoice_value", "service_value", "movement_value")
    t = m.tenant.select("cli_id", "fee_rate", "fee_type")
    cur_service, cur_charge, cur_move = fee_split("gross", "fee_rate", "fee_type")
    has = F.col("invoice_value").isNotNull()
    return (g.join(inv, "not_id", "left").join(t, "cli_id")
            .select("batch_id", "cli_id", "gross", has.alias("has_invoice"),
                    F.when(has, F.col("invoice_value")).otherwise(cur_charge).cast(MONEY).alias("charge_value"),
                    F.when(has, F.col("service_value")).otherwise(cur_service).cast(MONEY).alias("service_value"),
                    F.when(has, F.col("movement_value")).otherwise(cur_move).cast(MONEY).alias("net_total"),
                    F.when(has, F.when(F.col("invoice_value") > F.col("gross") + F.lit(Decimal("0.005")), "A").otherwise("D"))
                    .otherwise(F.when(F.col("fee_type") == "A", "A").otherwise("D")).alias("fee_type"),
                    F.when(has, F.when(F.col("gross") > 0,
                                       div_round2(F.col("service_value") * 100, F.col("gross"))).otherwise(0))
                    .otherwise(F.coalesce("fee_rate", F.lit(0))).cast("decimal(9,2)").alias("fee_rate")))


def net_basis(totals: DataFrame, *keep: str) -> DataFrame:
    """What the nets of a batch's lines need, in cents: (batch_id, gross_c, net_c, keep...)."""
    return totals.select("batch_id", cents("gross").alias("gross_c"), cents("net_total").alias("net_c"), *keep)


def line_net_cents(credit_value="credit_value"):
    """Net of one line in cents: gross_line x (movement / gross of the batch), rounded; beside ``net_basis``."""
    line = cents(credit_value)
    return F.when(F.col("gross_c") > 0, share_cents(line, "net_c", "gross_c")).otherwise(line)


def detail_totals(m: Mart, cli_id=None) -> DataFrame:
    """D3: :func:`batch_totals` plus ``net_sum`` (per-line nets, each rounded, summed)
    and ``cent_drift`` = net_sum - net_total."""
    tot = batch_totals(m, cli_id)
    lines = _tenant_filter(m.credit, cli_id).select("batch_id", "credit_value").join(net_basis(tot), "batch_id")
    # sums of cents by batch alone; the other totals join after
    sums = lines.groupBy("batch_id").agg(F.sum(line_net_cents()).alias("_net"))
    nets = tot.join(sums, "batch_id").withColumn(
        "net_sum", (F.col("_net").cast("decimal(20,0)") * F.lit(Decimal("0.01"))).cast(MONEY_SUM)).drop("_net")
    return (nets.withColumn("cent_drift", (F.col("net_sum") - F.col("net_total")).cast(MONEY_SUM))
            .withColumn("gross", F.col("gross").cast(MONEY_SUM)))


def batch_fee_split(m: Mart, cli_id=None) -> DataFrame:
    """Per batch, service/charge/movement from the tenant's current rate and type."""
    g = (_tenant_filter(m.credit, cli_id).groupBy("batch_id", "cli_id")
         .agg(F.sum("credit_value").cast("decimal(20,2)").alias("gross")))
    t = m.tenant.select("cli_id", "fee_rate", "fee_type")
    service, charge, movement = fee_split("gross", "fee_rate", "fee_type")
    return (g.join(t, "cli_id")
            .select("batch_id", "cli_id", F.col("gross").cast(MONEY).alias("gross"),
                    fee_type_default("fee_type").alias("fee_type"),
                    service.alias("service_value"), charge.alias("charge_value"),
                    movement.alias("movement_value")))


def fee_preview(m: Mart, cli_id=None) -> DataFrame:
    """Screen preview: fee and net rounded per line, then summed; drift vs D4."""
    t = m.tenant.select("cli_id", F.coalesce("fee_rate", F.lit(0).cast("decimal(9,4)")).alias("rate"),
                        "fee_type", (F.col("fee_type") == "A").alias("is_a"))
    c = _tenant_filter(m.credit, cli_id).join(t, "cli_id")
    fee_i = F.when(F.col("rate") > 0, F.round(F.col("credit_value") * F.col("rate") * pct(), 2)).otherwise(0)
    net_i = F.when((F.col("rate") > 0) & ~F.col("is_a"),
                   F.round(F.col("credit_value") - F.col("credit_value") * F.col("rate") * pct(), 2)
                   ).otherwise(F.col("credit_value"))
    s = (c.groupBy("batch_id", "cli_id", "is_a", "rate", "fee_type")
         .agg(F.sum("credit_value").alias("gross"), F.sum(fee_i).alias("fee"), F.sum(net_i).alias("net")))
    service, _, _ = fee_split("gross", "rate", "fee_type")
    return (s.withColumn("service_value", service)
            .select("batch_id", "cli_id", F.col("gross").cast(MONEY_SUM).alias("gross"),
                    F.col("fee").cast(MONEY_SUM).alias("fee_total"), F.col("net").cast(MONEY_SUM).alias("net_total"),
                    F.when(F.col("is_a"), F.col("gross") + F.col("fee")).otherwise(F.col("gross"))
                    .cast(MONEY_SUM).alias("charge_value"),
                    (F.col("fee") - F.col("service_value")).cast(MONEY_SUM).alias("cent_drift")))


def list_net_and_charge(m: Mart, cli_id=None) -> DataFrame:
    """Net paid out and charge per listed batch from the current tenant rate."""
    h = topup_history(m, cli_id=cli_id)
    r = F.col("fee_rate")
    g = F.col("gross")
    fee = g * r * pct()
    return h.select("batch_id", "cli_id", "not_id", g.alias("gross"),
                    F.when((r > 0) & (F.col("fee_type") != "A"), F.round(g - fee, 2)).otherwise(g)
                    .cast(MONEY_SUM).alias("net_value"),
                    F.when((r > 0) & (F.col("fee_type") == "A"), F.round(g + fee, 2)).otherwise(g)
                    .cast(MONEY_SUM).alias("charge_value"))


def list_status_view(m: Mart, cli_id=None) -> DataFrame:
    """The list category and the detail badge of every listed batch row."""
    h = topup_history(m, cli_id=cli_id)
    has = F.col("not_id").isNotNull()
    return h.select("batch_id", "cli_id", "not_id", "batch_status", "charge_status",
                    list_status("charge_status", "batch_status", has).alias("list_status"),
                    badge_status("charge_status", "batch_status", has).alias("badge"))


def topup_search(m: Mart, term: str, status: str = "todos", cli_id=None) -> DataFrame:
    """Status filter plus case-insensitive substring over date, id, tenant, operator, title."""
    h = topup_history(m, cli_id=cli_id)
    has = F.col("not_id").isNotNull()
    h = h.withColumn("list_status", list_status("charge_status", "batch_status", has))
    if status != "todos":
        h = h.filter(F.col("list_status") == status)
    t = term.lower().strip()
    if t:
        fields = [F.date_format("imported_at", "dd/MM/yyyy"), F.col("batch_id").cast("string"),
                  F.lower(F.coalesce("trade_name", F.lit(""))), F.lower(F.coalesce("created_by", F.lit(""))),
                  F.lower(F.coalesce("title", F.lit("")))]
        cond = None
        for f in fields:
            e = f.contains(t)
            cond = e if cond is None else cond | e
        h = h.filter(cond)
    return h.select("batch_id", "cli_id", "not_id", "imported_at", "trade_name", "created_by", "title",
                    "gross", "list_status")


def live_invoice_of_batch(m: Mart, cli_id=None) -> DataFrame:
    """Per batch, the newest (highest id) invoice that is not cancelled.

    A max over a struct is a plain aggregate (partial + final), so a batch
    with many credits costs no more than its partial rows.
    """
    c = _tenant_filter(m.credit, cli_id).select("batch_id", "cli_id", "not_id").filter(F.col("not_id").isNotNull())
    inv = m.invoice.filter(distinct_from("situation", "C")).select("not_id", "charge_id", "charge_status")
    best = (c.join(inv, "not_id")
            .groupBy("batch_id", "cli_id")
            .agg(F.max(F.struct("not_id", "charge_id", "charge_status")).alias("b")))
    return best.select("batch_id", "cli_id", "b.not_id", "b.charge_id", "b.charge_status")


def invoice_owner(m: Mart) -> DataFrame:
    """Tenant of each invoice through its credits (lowest when several)."""
    return (m.credit.filter(F.col("not_id").isNotNull()).groupBy("not_id")
            .agg(F.min("cli_id").alias("cli_id")))


def overdue_open_batches(m: Mart, as_of: str) -> DataFrame:
    """Distinct (batch, open invoice) pairs whose due date passed and charge is not closed.

    Batch not 'C' (NULL-safe), invoice 'A', due < as_of, charge status NULL or
    not in paid/settled/canceled/cancelled ('expired' stays in, S17).
    """
    inv = m.invoice.filter(
        (F.col("situation") == "A") & (F.col("due_date") < F.to_date(F.lit(as_of)))
        & (F.col("charge_status").isNull()
           | ~lower_in("charge_status", ["paid", "settled", "canceled", "cancelled"])))
    pairs = m.credit.select("batch_id", "not_id").join(inv.select("not_id"), "not_id", "left_semi").distinct()
    b = m.batch.filter(distinct_from("batch_status", "C")).select("batch_id", "cli_id")
    return (pairs.join(b, "batch_id")
            .join(inv.select("not_id", "due_date", "charge_status"), "not_id")
            .select("batch_id", "cli_id", "not_id", "due_date", "charge_status"))


def latest_charge(m: Mart) -> DataFrame:
    """Newest charge record per invoice from the status feed (max by time, then sequence)."""
    return (m.status_feed.groupBy("not_id")
            .agg(F.max(F.struct("changed_at", "seq", "new_status")).alias("r"))
            .select("not_id", F.col("r.new_status").alias("hub_status"), F.col("r.changed_at").alias("hub_at")))


def cancel_batches(m: Mart, requests: DataFrame, as_of: str, actor_col: str = "actor") -> dict:
    """Cancel batches unless their charge is paid or cannot be confirmed.

    For each request (batch_id, cli_id, actor) the live invoice (D9) is looked
    up; the hub's current status is the newest feed record for it.  Outcomes:
    ``not_found`` (no such batch in the tenant), ``unconfirmed`` (an issued
    charge with no feed record), ``paid`` (feed says paid/settled), else
    ``cancelled``: credits -> 3, invoice -> 'C' with date and <=20-char actor,
    batch -> 'C'.  Returns new-state frames and the decision frame.
    """
    live = live_invoice_of_batch(m).select("batch_id", "cli_id", "not_id", "charge_id")
    hub = latest_charge(m)
    req = requests.select("batch_id", "cli_id", F.col(actor_col).alias("actor"))
    exists = m.batch.select("batch_id", "cli_id", F.lit(True).alias("found"))
    d = (req.join(exists, ["batch_id", "cli_id"], "left")
         .join(live, ["batch_id", "cli_id"], "left")
         .join(hub, "not_id", "left"))
    outcome = (F.when(F.col("found").isNull(), "not_found")
               .when(F.col("not_id").isNotNull() & F.col("hub_status").isNull() & F.col("charge_id").isNotNull(),
                     "unconfirmed")
               .when(F.col("hub_status").isin("paid", "settled"), "paid")
               .otherwise("cancelled"))
    decisions = d.select("batch_id", "cli_id", "not_id", "hub_status", "actor",
                         outcome.alias("outcome"),
                         (F.col("not_id").isNotNull() & F.col("hub_status").isin("waiting", "active"))
                         .alias("hub_cancel"))
    ok = decisions.filter(F.col("outcome") == "cancelled")
    ok_b = ok.select("batch_id", "cli_id", F.lit(True).alias("_hit"))
    credit = (m.credit.join(ok_b, ["batch_id", "cli_id"], "left")
              .withColumn("sit_id", F.when(F.col("_hit"), F.lit(3)).otherwise(F.col("sit_id"))).drop("_hit"))
    inv_hit = ok.filter(F.col("not_id").isNotNull()).select(
        "not_id", F.substring("actor", 1, ACTOR_CHARS).alias("_actor"), F.lit(True).alias("_hit"))
    invoice = (m.invoice.join(inv_hit, "not_id", "left")
               .withColumn("situation", F.when(F.col("_hit"), F.lit("C")).otherwise(F.col("situation")))
               .withColumn("cancelled_on", F.when(F.col("_hit"), F.to_date(F.lit(as_of)))
                           .otherwise(F.col("cancelled_on")))
               .withColumn("cancelled_by", F.when(F.col("_hit"), F.col("_actor")).otherwise(F.col("cancelled_by")))
               .drop("_hit", "_actor"))
    batch = (m.batch.join(ok_b, ["batch_id", "cli_id"], "left")
             .withColumn("batch_status", F.when(F.col("_hit"), F.lit("C")).otherwise(F.col("batch_status")))
             .drop("_hit"))
    return {"credit": credit, "invoice": invoice, "batch": batch, "decisions": decisions}


def cancel_overdue(m: Mart, as_of: str, actor: str = "JOB_VENCIDO") -> dict:
    """The nightly job: D11's batches through D14 with the job's actor, plus counts."""
    reqs = overdue_open_batches(m, as_of).select("batch_id", "cli_id").distinct().withColumn("actor", F.lit(actor))
    out = cancel_batches(m, reqs, as_of)
    d = out["decisions"]
    out["counts"] = d.agg(F.count(F.lit(1)).alias("total"),
                          F.count_if(F.col("outcome") == "cancelled").alias("cancelled"),
                          F.count_if(F.col("outcome") != "cancelled").alias("failed"))
    return out


def apply_charge_updates(m: Mart) -> DataFrame:
    """Newest feed record per invoice applied to its status; final statuses kept.

    Returns the invoice new state with a ``changed`` flag.
    """
    hub = latest_charge(m)
    inv = m.invoice.join(hub, "not_id", "left")
    final = lower_in("charge_status", FINAL_CHARGE_STATUSES)
    take = (~F.coalesce(final, F.lit(False)) & F.col("hub_status").isNotNull()
            & ~F.col("charge_status").eqNullSafe(F.col("hub_status")))
    return inv.select(
        *[c for c in m.invoice.columns if c not in ("charge_status", "status_updated_at")],
        F.when(take, F.col("hub_status")).otherwise(F.col("charge_status")).alias("charge_status"),
        F.when(take, F.col("hub_at")).otherwise(F.col("status_updated_at")).alias("status_updated_at"),
        take.alias("changed"))


def apply_charge_records(m: Mart, records: DataFrame | None = None) -> DataFrame:
    """Invoice new state after writing the newest normalized charge record (D17) of each invoice.

    Charge id, bar code, digit line, PIX code, PDF link and status all come from the record, also
    where it holds nothing; the QR image link is not in the reply and becomes NULL; the status time is
    the record's.  Invoices without a record stay as they are.
    """
    r = charge_record_normalize(m) if records is None else records
    fields = ["charge_id", "barcode", "barcode_line", "pix_qrcode", "pdf_url", "status"]
    newest = (r.groupBy("not_id").agg(F.max(F.struct("fetched_at", "seq", F.struct(*fields).alias("r"))).alias("n"))
              .select(F.col("not_id").alias("_not"), F.col("n.fetched_at").alias("_at"), F.col("n.r").alias("_r")))
    hit = F.col("_not").isNotNull()
    new = {c: F.col(f"_r.{c}") for c in fields[:-1]} | {
        "charge_status": F.col("_r.status"), "status_updated_at": F.col("_at"), "qrcode_url": F.lit(None).cast("string")}
    joined = m.invoice.join(newest, F.col("not_id") == F.col("_not"), "left")
    return joined.select(*[F.when(hit, new[c].cast(m.invoice.schema[c].dataType)).otherwise(F.col(c)).alias(c)
                           if c in new else F.col(c) for c in m.invoice.columns], hit.alias("changed"))


CHARGE_SCHEMA = ("data STRUCT<charge_id: BIGINT, status: STRING, payment: STRUCT<banking_billet: "
                 "STRUCT<barcode: STRING, pix: STRUCT<qrcode: STRING>, pdf: STRUCT<charge: STRING>, "
                 "billet_link: STRING>>>")


def charge_record_normalize(m: Mart) -> DataFrame:
    """Nested gateway reply -> flat charge record (missing data -> no record)."""
    j = m.charge_reply.select("not_id", "fetched_at", "seq", F.from_json("reply", CHARGE_SCHEMA).alias("j"))
    bb = F.col("j.data.payment.banking_billet")
    return (j.filter(F.col("j.data.charge_id").isNotNull())
            .select("not_id", "fetched_at", "seq",
                    F.col("j.data.charge_id").alias("charge_id"), F.col("j.data.status").alias("status"),
                    bb.getField("barcode").alias("barcode_line"),
                    digits(bb.getField("barcode")).alias("barcode"),
                    bb.getField("pix").getField("qrcode").alias("pix_qrcode"),
                    F.coalesce(bb.getField("pdf").getField("charge"), bb.getField("billet_link")).alias("pdf_url")))


def reissue_plan(m: Mart, cli_id=None, requests: DataFrame | None = None) -> DataFrame:
    """Action per requested batch, whatever its status: error without invoice, clear when a
    charge exists, apply a charge found in the gateway feed, else issue.

    ``requests (batch_id, cli_id)`` names the batches; all of them when it is not given.
    """
    b = _tenant_filter(m.batch, cli_id).select("batch_id", "cli_id")
    if requests is not None:
        b = b.join(requests.select("batch_id", "cli_id").distinct(), ["batch_id", "cli_id"], "left_semi")
    live = live_invoice_of_batch(m).select("batch_id", "cli_id", "not_id", "charge_id")
    found = charge_record_normalize(m).select("not_id").distinct().withColumn("in_feed", F.lit(True))
    p = b.join(live, ["batch_id", "cli_id"], "left").join(found, "not_id", "left")
    action = (F.when(F.col("not_id").isNull(), "error_no_invoice")
              .when(F.col("charge_id").isNotNull(), "clear_error")
              .when(F.col("in_feed"), "apply_feed")
              .otherwise("issue"))
    return p.select("batch_id", "cli_id", "not_id", action.alias("action"))


def set_batch_status(m: Mart, changes: DataFrame) -> DataFrame:
    """New batch state after setting status by (batch, tenant) keys.

    ``changes`` holds (batch_id, cli_id, new_status); a NULL new status is a
    real value (clears the status), told apart from "no change" by a flag.
    """
    ch = changes.select("batch_id", "cli_id", "new_status", F.lit(True).alias("_hit"))
    return (m.batch.join(ch, ["batch_id", "cli_id"], "left")
            .withColumn("batch_status", F.when(F.col("_hit"), F.col("new_status")).otherwise(F.col("batch_status")))
            .drop("new_status", "_hit"))


MAX_VALUE = 1000000


def validate_credit_request(m: Mart, requests: DataFrame | None = None, max_lines: int | None = None) -> DataFrame:
    """One verdict per credit request (lines grouped by ``request_id``).

    ``max_lines`` rejects longer requests whole (the reference's web form allows 5000); a batch
    job has no such limit unless it is asked for.  If any line lacks an id (NULL or <= 0) the whole request is
    in CPF mode and every line needs an 11-digit CPF, otherwise every line
    needs a positive id; every value must parse (leading number) to
    0 < v <= 1,000,000.  The first failing line (by position) gives the
    error, as the reference stops at the first one; then the date must parse.
    Title is trimmed to its field width.  The failing line's position is the
    count of the request's lines up to it (aggregates only, no per-request
    numbering).
    """
    r = m.credit_request if requests is None else requests
    v = leading_number("valor")
    bad_id = F.col("ref_id").isNull() | (F.col("ref_id") <= 0)
    val_err = F.when(v.isNull() | F.isnan(v) | (v <= 0) | (v > MAX_VALUE), M.REQUEST_LINE_VALUE)
    lines = r.select("request_id", "cli_id", "line_no", "titulo", "data", bad_id.alias("bad_id"), val_err.alias("val_err"),
                     F.when(F.length(digits(F.coalesce("cpf", F.lit("")))) != 11, M.REQUEST_LINE_CPF).alias("cpf_err"))

    def first_error(ref_err):
        """The first failing line and its message, if the references of all lines are checked this way."""
        return F.min(F.when(ref_err.isNotNull() | F.col("val_err").isNotNull(),
                            F.struct("line_no", F.coalesce(ref_err, "val_err").alias("msg"))))

    # whether a request goes by CPF shows only in all its lines, so both ways are aggregated
    head = (lines.groupBy("request_id", "cli_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.max("bad_id").alias("cpf_mode"),
        F.max("titulo").alias("titulo"), F.max("data").alias("data"),
        first_error(F.col("cpf_err")).alias("_cpf"),
        first_error(F.when(F.col("bad_id"), M.REQUEST_LINE_ID)).alias("_id"))
        .withColumn("_bad", F.when(F.col("cpf_mode"), F.col("_cpf")).otherwise(F.col("_id"))))
    first = head.filter(F.col("_bad").isNotNull()).select(
        "request_id", F.col("_bad.line_no").alias("bad_line"), F.col("_bad.msg").alias("msg"))
    head = head.drop("_cpf", "_id", "_bad")
    # position of the first failing line = lines of the request up to it (an aggregate, no numbering)
    pos = (lines.select("request_id", "line_no").join(first, "request_id")
           .filter(F.col("line_no") <= F.col("bad_line"))
           .groupBy("request_id", "msg").agg(F.count(F.lit(1)).alias("pos")))
    first_bad = pos.select("request_id", F.concat(F.lit(M.REQUEST_LINE), F.col("pos").cast("string"), F.lit(": "),
                                                  F.col("msg")).alias("line_error"))
    date_ok = F.to_date(F.try_to_date("data", "yyyy-MM-dd"))
    out = head.join(first_bad, "request_id", "left")
    too_many = F.col("n_lines") > max_lines if max_lines is not None else F.lit(False)
    error = (F.when(too_many, F.concat(F.lit(M.REQUEST_TOO_MANY[0]), F.lit(str(max_lines)), F.lit(M.REQUEST_TOO_MANY[1])))
             .when(F.col("line_error").isNotNull(), F.col("line_error"))
             .when(F.col("data").isNotNull() & (F.col("data") != "") & date_ok.isNull(),
                   F.lit(M.REQUEST_DATE_INVALID)))
    return out.select(
        "request_id", "cli_id", "n_lines", "cpf_mode", error.alias("error"), error.isNull().alias("is_valid"),
        F.when(F.col("titulo").isNotNull() & (F.col("titulo") != ""),
               F.substring(js_trim("titulo"), 1, TITLE_CHARS)).alias("titulo"),
        F.when(F.col("data").isNotNull() & (F.col("data") != ""), date_ok).alias("credit_date"))


def resolve_request_lines(m: Mart, requests: DataFrame | None = None):
    """D13 step 1: lines of valid requests resolved to active collaborators of the tenant.

    By id, or by digits-only CPF when the request is in CPF mode (the lowest
    id wins on a duplicated CPF, S15).  Adds the parsed value ``v`` and a
    ``reason`` for lines that will be ignored.  Returns (valid request
    heads, resolved lines).
    """
    r = m.credit_request if requests is None else requests
    ok = validate_credit_request(m, r).filter("is_valid").select(
        "request_id", "cpf_mode", F.col("titulo").alias("req_title"), "credit_date")
    lines = r.join(ok, "request_id").withColumns({
        "_cpf": F.when(F.col("cpf_mode"), pad_cpf_digits("cpf")), "_id": F.when(~F.col("cpf_mode"), F.col("ref_id"))})
    active = m.collaborator.filter(F.col("sit_id") == 1).select("usr_id", "cli_id", "cpf")
    # the lowest id of a CPF, so each line meets at most one collaborator either way
    by_cpf = (active.select("cli_id", sql_digits("cpf").alias("_cpf"), "usr_id").groupBy("cli_id", "_cpf")
              .agg(F.min("usr_id").alias("_by_cpf")))
    by_id = active.select("cli_id", F.col("usr_id").alias("_id"), F.col("usr_id").alias("_by_id"))
    resolved = (lines.join(by_cpf, ["cli_id", "_cpf"], "left").join(by_id, ["cli_id", "_id"], "left")
                .withColumn("usr_id", F.coalesce("_by_cpf", "_by_id")).drop("_cpf", "_id", "_by_cpf", "_by_id")
                .withColumn("v", leading_number("valor")))
    reason = (F.when(F.col("usr_id").isNull(), F.lit(M.LINE_NOT_FOUND))
              .when(F.col("v").isNull() | F.isnan("v") | (F.col("v") <= 0), F.lit(M.LINE_VALUE_NOT_POSITIVE)))
    return ok, resolved.withColumn("reason", reason)


def ignored_request_lines(resolved: DataFrame) -> DataFrame:
    """Lines left out, with the reason."""
    return resolved.filter(F.col("reason").isNotNull()).select(
        "request_id", "cli_id", "line_no", "ref_id", "cpf", "nome", "usr_id", "reason")


def generate_credits(m: Mart, as_of: str, login: str = "sistema", requests: DataFrame | None = None,
                     credit_ids: bool = True, ledger: str | None = None) -> dict:
    """Credits, batches and invoices for every valid request (D12), in one pass.

    Lines resolve to active collaborators of the request's tenant — by id, or
    by digits-only CPF when the request is in CPF mode (the lowest id wins on
    a duplicated CPF, S15).  Unmatched lines and values <= 0 are ignored
    with a reason.  Each valid request gets a batch; each batch with credits
    gets one open invoice (due as_of + 10) with the tenant's fee split (D4).
    Credits: product 201, status 2, date = requested date or as_of, CPF
    unmasked and padded.  New ids continue from the current maxima in request
    / line order (:func:`dense_ids`, which ``ledger`` is for); ``credit_ids=False`` skips the credit-id
    allocation when only the summary is wanted.  Returns the new rows per
    table plus the ignored lines and a per-request summary.
    """
    from tipflow.operators.ids import dense_ids
    r = m.credit_request if requests is None else requests
    _, resolved = resolve_request_lines(m, r)
    # validation + resolution run once: the id allocations below would otherwise each
    # re-evaluate them (their checkpoints are eager)
    resolved = resolved.checkpoint(eager=True)
    ignored = ignored_request_lines(resolved)
    good = resolved.filter(F.col("reason").isNull())

    # every valid request has at least one line, so its head comes from its lines: one aggregate gives the
    # heads, their totals and counts, and both kinds of ids are given to it
    is_good = F.col("reason").isNull()
    heads = (resolved.groupBy("request_id").agg(
        F.first("cli_id").alias("cli_id"), F.first("req_title").alias("req_title"),
        F.sum(F.when(is_good, F.col("v").cast(MONEY))).cast("decimal(20,2)").alias("gross"),
        F.count_if(is_good).alias("n_credits"), F.count_if(~is_good).alias("n_ignored")).checkpoint(eager=True))
    max_batch = m.batch.agg(F.coalesce(F.max("batch_id"), F.lit(0)).alias("m"))
    batches = dense_ids(heads, ["request_id"], max_batch, "batch_id", stored=True, ledger=ledger)
    as_of_ts = F.to_timestamp(F.lit(as_of))
    batch = batches.select("batch_id", "cli_id", as_of_ts.alias("imported_at"), F.lit(login).alias("created_by"),
                           F.lit(None).cast("string").alias("batch_status"), F.col("req_title").alias("title"),
                           "request_id")

    t = m.tenant.select("cli_id", "fee_rate", "fee_type")
    service, charge, movement = fee_split("gross", "fee_rate", "fee_type")
    max_not = m.invoice.agg(F.coalesce(F.max("not_id"), F.lit(0)).alias("m"))
    paying = heads.filter(F.col("n_credits") > 0)
    inv0 = (dense_ids(paying, ["request_id"], max_not, "not_id", stored=True, ledger=ledger).join(t, "cli_id")
            .join(batches.select("request_id", "batch_id"), "request_id"))
    as_of_d = F.to_date(F.lit(as_of))
    invoice = inv0.select("not_id", "cli_id", as_of_d.alias("issue_date"), F.date_add(as_of_d, 10).alias("due_date"),
                          F.col("gross").cast(MONEY).alias("gross_value"), charge.alias("invoice_value"),
                          service.alias("service_value"), movement.alias("movement_value"),
                          F.lit("A").alias("situation"), "batch_id", "request_id")
    lines = good.drop("cli_id").join(invoice.select("request_id", "batch_id", "not_id", "cli_id"), "request_id")
    if credit_ids:
        max_cre = m.credit.agg(F.coalesce(F.max("cre_id"), F.lit(0)).alias("m"))
        cre = dense_ids(lines, ["request_id", "line_no"], max_cre, "cre_id", ledger=ledger)
    else:  # callers that only need the per-request summary skip the credit-id allocation
        cre = lines.withColumn("cre_id", F.lit(None).cast("long"))
    credit = (cre.join(m.collaborator.select("usr_id", F.col("cpf").alias("usr_cpf")), "usr_id")
              .select("cre_id", "usr_id", "batch_id", "cli_id", F.col("v").cast(MONEY).alias("credit_value"),
                      F.coalesce("credit_date", as_of_d).alias("credit_date"), F.lit(2).alias("sit_id"), "not_id",
                      as_of_d.alias("import_date"), pad_cpf_digits("usr_cpf", sql_style=True).alias("cpf"),
                      F.lit(201).alias("product_id"), F.lit(login).alias("created_by"), "request_id", "line_no"))
    summary = (batches.select("request_id", "cli_id", "batch_id", "n_credits", "n_ignored")
               .join(invoice.select("request_id", "not_id", "gross_value", "service_value", "invoice_value",
                                    "movement_value"), "request_id", "left")
               .select("request_id", "cli_id", "batch_id", "not_id", "n_credits", "n_ignored",
                       "gross_value", "service_value", "invoice_value", "movement_value"))
    return {"batch": batch, "credit": credit, "invoice": invoice, "ignored": ignored, "summary": summary}


def pad_cpf_digits(col, sql_style: bool = False):
    """Digits of a CPF (all non-digits, or only '.'/'-' with ``sql_style``), left-padded to 11."""
    from tipflow.functions.columns import pad_cpf
    return pad_cpf(sql_digits(col) if sql_style else digits(col))
