"""Reports (C1-C10): batch top-ups by period, collaborator register and history.

Batch-level reports pre-aggregate credits per (batch, invoice) before
joining invoices, so the fact table is reduced by a map-side partial
aggregate before any shuffle; MAX over invoice attributes is unaffected by
how many credits point to the same invoice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tipflow.functions.columns import (MONEY_SUM, NO_CATEGORY, PAID_STATUSES, batch_status, cents,
                                       in_period, lower_in, money_of, month_label_pt, sql_digits, status_label,
                                       text_order)
from tipflow.sources.mart import Mart
from tipflow.sources.sinks import write_csv  # noqa: F401  (A4 sink used by report exports)


def _credit_invoice_parts(m: Mart) -> DataFrame:
    """Credits summed per (batch, invoice id) — one row per pair."""
    return (m.credit.groupBy("batch_id", "not_id")
            .agg(F.count(F.lit(1)).alias("n_credits"), F.sum("credit_value").alias("credit_sum")))


def batch_report_rows(m: Mart, start=None, end=None, cli_id=None) -> DataFrame:
    """C1 core: one row per batch imported in [start, end + 1 day).

    value = COALESCE(max value of an open invoice, max invoice value, sum of
    credits, 0); charge status prefers the open invoice; payment time is the
    latest status time among paid/settled invoices.
    """
    b = m.batch
    if cli_id is not None:
        b = b.filter(F.col("cli_id") == cli_id)
    if start is not None:
        b = b.filter(in_period("imported_at", start, end, "half_open", kind="timestamp"))
    inv = m.invoice.select("not_id", "situation", "invoice_value", "due_date",
                           "charge_status", "status_updated_at")
    parts = _credit_invoice_parts(m).join(inv, "not_id", "left")
    is_open = F.col("situation") == "A"
    agg = parts.groupBy("batch_id").agg(
        F.max(F.when(is_open, F.col("invoice_value"))).alias("open_value"),
        F.max("invoice_value").alias("any_value"),
        F.sum("credit_sum").alias("credit_sum"),
        F.max("due_date").alias("due_date"),
        F.max(F.when(is_open, F.col("charge_status"))).alias("open_status"),
        F.max("charge_status").alias("any_status"),
        F.max(F.when(lower_in("charge_status", PAID_STATUSES), F.col("status_updated_at"))).alias("paid_at"))
    out = (b.join(agg, "batch_id", "left")
           .select("batch_id", "cli_id", "imported_at", "batch_status",
                   F.coalesce("open_value", "any_value", "credit_sum", F.lit(0)).cast(MONEY_SUM).alias("value"),
                   "due_date",
                   F.coalesce("open_status", "any_status").alias("charge_status"),
                   "paid_at"))
    status = batch_status("charge_status", "batch_status")
    return out.withColumn("status", status).withColumn("status_label", status_label(status))


def topups_by_period(m: Mart, start, end, cli_id=None, paid_only: bool = True) -> DataFrame:
    """Batches of the period; the reference keeps only 'pago' rows."""
    rows = batch_report_rows(m, start, end, cli_id)
    return rows.filter(F.col("status") == "pago") if paid_only else rows


def batch_statuses(m: Mart, cli_id=None) -> DataFrame:
    """Consolidated status and label of every batch."""
    return batch_report_rows(m, cli_id=cli_id).select(
        "batch_id", "cli_id", "batch_status", "charge_status", "status", "status_label")


def topups_period_summary(m: Mart, start, end, cli_id=None, paid_only: bool = True) -> DataFrame:
    """Per tenant, counts and sums per bucket (paid / cancelled+error / pending+expired).

    With ``paid_only`` (the reference) the filter runs first, so the last two
    buckets are always zero (S8).
    """
    rows = topups_by_period(m, start, end, cli_id, paid_only)
    st = F.col("status")
    paid = st == "pago"
    canc = st.isin("cancelado", "erro")
    pend = st.isin("pendente", "vencido")

    def vsum(cond):
        return F.coalesce(F.sum(F.when(cond, F.col("value"))), F.lit(0)).cast(MONEY_SUM)

    s = rows.groupBy("cli_id").agg(
        vsum(paid).alias("paid_value"), vsum(canc).alias("cancelled_value"), vsum(pend).alias("pending_value"),
        F.count(F.lit(1)).alias("n_batches"), F.count_if(paid).alias("n_paid"),
        F.count_if(canc).alias("n_cancelled"), F.count_if(pend).alias("n_pending"))
    t = m.tenant.select("cli_id", "trade_name", "cnpj")
    if cli_id is not None:
        t = t.filter(F.col("cli_id") == cli_id)
    z = F.lit(0)
    return t.join(s, "cli_id", "left").select(
        "cli_id", "trade_name", "cnpj",
        F.coalesce("paid_value", z).cast(MONEY_SUM).alias("total_value"),
        F.coalesce("paid_value", z).cast(MONEY_SUM).alias("paid_value"),
        F.coalesce("cancelled_value", z).cast(MONEY_SUM).alias("cancelled_value"),
        F.coalesce("pending_value", z).cast(MONEY_SUM).alias("pending_value"),
        F.coalesce("n_batches", z).alias("n_batches"), F.coalesce("n_paid", z).alias("n_paid"),
        F.coalesce("n_cancelled", z).alias("n_cancelled"), F.coalesce("n_pending", z).alias("n_pending"))


def category_names(m: Mart) -> DataFrame:
    """Per collaborator: category names joined by ', ' in name order."""
    names = m.collab_category.join(m.category.select("set_id", "set_name"), "set_id")
    return names.groupBy("usr_id").agg(
        F.array_join(F.array_sort(F.collect_list("set_name")), ", ").alias("categories"))


def collaborator_register(m: Mart, cli_id=None) -> DataFrame:
    """C4: every collaborator with birth date, categories ('Sem categoria'), status text."""
    u = m.collaborator if cli_id is None else m.collaborator.filter(F.col("cli_id") == cli_id)
    return (u.join(category_names(m), "usr_id", "left")
            .select("cli_id", "usr_id", "usr_name", "cpf", F.col("phone"),
                    F.coalesce("birth_date", "birth_date_legacy").alias("birth_date"),
                    F.coalesce("categories", F.lit(NO_CATEGORY)).alias("categories"),
                    "created_at", "sit_id",
                    F.when(F.col("sit_id") == 1, "Ativo").otherwise("Inativo").alias("status")))


def collaborator_register_counts(m: Mart, cli_id=None) -> DataFrame:
    """Active / inactive counts per tenant."""
    u = m.collaborator if cli_id is None else m.collaborator.filter(F.col("cli_id") == cli_id)
    return u.groupBy("cli_id").agg(F.count_if(F.col("sit_id") == 1).alias("total_active"),
                                   F.count_if(F.col("sit_id") != 1).alias("total_inactive"))


def paid_batches(m: Mart) -> DataFrame:
    """Batches with at least one credit whose invoice charge is paid/settled."""
    paid_inv = m.invoice.filter(lower_in("charge_status", PAID_STATUSES)).select("not_id")
    return m.credit.select("batch_id", "not_id").join(paid_inv, "not_id", "left_semi").select("batch_id").distinct()


def collaborator_history(m: Mart, start, end, cli_id=None, usr_id=None) -> DataFrame:
    """Credits in [start, end + 1 day) of batches that have a paid invoice."""
    c = m.credit.filter(in_period("credit_date", start, end, "half_open"))
    if cli_id is not None:
        c = c.filter(F.col("cli_id") == cli_id)
    if usr_id is not None:
        c = c.filter(F.col("usr_id") == usr_id)
    return (c.join(paid_batches(m), "batch_id", "left_semi")
            .select("cli_id", "usr_id", "batch_id", "credit_date", "credit_value"))


def collaborator_history_monthly(m: Mart, start, end, cli_id=None, usr_id=None,
                                 nested: bool = False) -> DataFrame:
    """Per collaborator and month: Portuguese label, total and credit count.

    ``nested=True`` adds the month's credits as ``array<struct>`` (newest
    first), which is what the report renders.  ``user_total`` is the grand
    total of the collaborator over the period.
    """
    h = collaborator_history(m, start, end, cli_id, usr_id)
    month = F.date_format("credit_date", "yyyy-MM")
    aggs = [F.sum("credit_value").cast(MONEY_SUM).alias("month_total"),
            F.count(F.lit(1)).alias("n_credits")]
    if nested:
        aggs.append(F.sort_array(F.collect_list(F.struct("credit_date", "credit_value", "batch_id")),
                                 asc=False).alias("credits"))
    g = (h.groupBy("cli_id", "usr_id", month.alias("month_key"),
                   month_label_pt("credit_date").alias("label")).agg(*aggs))
    w = Window.partitionBy("usr_id")
    return (g.withColumn("user_total", F.sum("month_total").over(w).cast(MONEY_SUM))
            .orderBy("usr_id", F.desc("month_key")))


def collaborator_history_nested(m: Mart, start, end, cli_id=None, usr_id=None) -> DataFrame:
    """The month lists of :func:`collaborator_history_monthly`, one row a credit with its place in the list."""
    months = collaborator_history_monthly(m, start, end, cli_id, usr_id, nested=True)
    return months.select("cli_id", "usr_id", "month_key", "month_total", F.posexplode("credits").alias("pos", "credit")).select(
        "cli_id", "usr_id", "month_key", "month_total", "pos", "credit.credit_date", "credit.credit_value", "credit.batch_id")


def collaborator_lookup(m: Mart, term: str = "", cli_id=None, k: int = 50, collation: str | None = None) -> DataFrame:
    """Active collaborators matching a search term, first ``k`` by name per tenant.

    A term with digits matches name ILIKE or digits-only CPF LIKE; a term
    without digits matches the name only.  ``%``/``_`` in the term act as
    wildcards, as in the reference.
    """
    u = m.collaborator.filter(F.col("sit_id") == 1)
    if cli_id is not None:
        u = u.filter(F.col("cli_id") == cli_id)
    if term.strip():
        only_digits = "".join(ch for ch in term if ch.isdigit())
        cond = F.col("usr_name").ilike(f"%{term}%")
        if only_digits:
            cond = cond | sql_digits("cpf").like(f"%{only_digits}%")
        u = u.filter(cond)
    w = Window.partitionBy("cli_id").orderBy(text_order("usr_name", collation), "usr_name", "usr_id")
    return (u.withColumn("pos", F.row_number().over(w).cast("long")).filter(F.col("pos") <= k)
            .select("cli_id", "pos", "usr_id", "usr_name", "cpf"))


def report_export_topups(m: Mart, start, end, cli_id=None) -> DataFrame:
    """Top-up export rows ('#id', dates dd/MM/yyyy, status label, value) plus one
    'TOTAL EFETUADO' row per tenant."""
    rows = topups_by_period(m, start, end, cli_id).select(
        "cli_id", F.lit("item").alias("line_type"),
        F.concat(F.lit("#"), F.col("batch_id").cast("string")).alias("remessa"),
        F.date_format("imported_at", "dd/MM/yyyy").alias("topup_date"),
        F.coalesce(F.date_format("due_date", "dd/MM/yyyy"), F.lit("")).alias("due_date"),
        F.coalesce(F.date_format("paid_at", "dd/MM/yyyy"), F.lit("")).alias("paid_date"),
        F.col("status_label").alias("status"), "value")
    totals = rows.groupBy("cli_id").agg(F.sum("value").cast(MONEY_SUM).alias("value")).select(
        "cli_id", F.lit("total").alias("line_type"), F.lit("").alias("remessa"), F.lit("").alias("topup_date"),
        F.lit("").alias("due_date"), F.lit("").alias("paid_date"), F.lit("TOTAL EFETUADO").alias("status"), "value")
    return rows.unionByName(totals)


def report_export_register(m: Mart, cli_id=None) -> DataFrame:
    """Collaborator register export: 'Ativos' and 'Inativos' sheets with display formats."""
    from tipflow.operators.text import format_cpf, format_phone
    r = collaborator_register(m, cli_id)
    return r.select(
        "cli_id", F.when(F.col("sit_id") == 1, "Ativos").otherwise("Inativos").alias("sheet"), "usr_id",
        F.coalesce("usr_name", F.lit("")).alias("nome"), F.coalesce(format_cpf("cpf"), F.lit("")).alias("cpf"),
        F.coalesce(format_phone("phone"), F.lit("")).alias("telefone"),
        F.coalesce(F.date_format("birth_date", "dd/MM/yyyy"), F.lit("")).alias("data_nascimento"),
        F.col("categories").alias("categoria"),
        F.coalesce(F.date_format("created_at", "dd/MM/yyyy HH:mm"), F.lit("")).alias("criado_em"), "status")


def report_export_history(m: Mart, start, end, cli_id=None) -> DataFrame:
    """History export: one 'Gorjeta' row per credit and a 'Total do mês' row per month."""
    h = collaborator_history(m, start, end, cli_id)
    label = month_label_pt("credit_date")
    items = (h.withColumn("_label", label)
             .select("cli_id", "usr_id", F.date_format("credit_date", "yyyy-MM").alias("month_key"),
                     F.concat(F.upper(F.substring("_label", 1, 1)), F.expr("substring(_label, 2)")).alias("mes"),
                     F.lit("Gorjeta").alias("tipo"), F.col("credit_value").cast(MONEY_SUM).alias("valor")))
    totals = (items.groupBy("cli_id", "usr_id", "month_key", "mes")
              .agg(F.sum("valor").cast(MONEY_SUM).alias("valor"))
              .select("cli_id", "usr_id", "month_key", "mes", F.lit("Total do mês").alias("tipo"), "valor"))
    return items.unionByName(totals)


def batch_statement(m: Mart, cli_id=None) -> DataFrame:
    """Numbered statement lines per batch (gross, discount, net) plus a totals line.

    Net per line is gross x (movement / gross total of the batch), rounded to
    cents; discount = gross - net.  The totals line holds the batch's own gross, service fee and
    movement, not the sums of rounded lines.  CPFs are in display form ('-' when missing).
    ``show_discount`` is true when the fee rate is positive and the type is 'D'.  Line numbers come from
    :func:`number_within`, so a very large batch is numbered by many tasks.
    """
    from tipflow.operators.ids import number_within
    from tipflow.operators.text import format_cpf
    from tipflow.operators.topups import batch_totals, line_net_cents, net_basis
    show = ((F.col("fee_rate") > 0) & (F.col("fee_type") == "D")).alias("show_discount")
    every = batch_totals(m, cli_id).select("cli_id", "batch_id", "gross", "service_value", "net_total", show)
    tot = net_basis(every, "show_discount")
    c = m.credit if cli_id is None else m.credit.filter(F.col("cli_id") == cli_id)
    lines = (c.select("cli_id", "batch_id", "usr_id", "credit_value", "credit_date")
             .join(m.collaborator.select("usr_id", "usr_name", "cpf"), "usr_id")
             .join(tot, "batch_id"))
    # rows are numbered as they are; what is shown of them is made after
    items = number_within(lines, ["batch_id"], ["usr_name", "usr_id", "credit_value", "credit_date"], "line",
                          sizes=c.select("batch_id"))
    items = (items.withColumn("_net", line_net_cents())
             .withColumns({"cpf": F.coalesce(F.nullif(format_cpf("cpf"), F.lit("")), F.lit("-")),
                           "gross": F.col("credit_value").cast(MONEY_SUM),
                           "discount": money_of(cents("credit_value") - F.col("_net")).cast(MONEY_SUM),
                           "net": money_of("_net").cast(MONEY_SUM)}))
    items = items.select("cli_id", "batch_id", "line", "usr_name", "cpf", "gross", "discount", "net", "show_discount")
    totals = every.select(
        "cli_id", "batch_id", F.lit(None).cast("int").alias("line"), F.lit("TOTAL").alias("usr_name"),
        F.lit(None).cast("string").alias("cpf"), F.col("gross").cast(MONEY_SUM).alias("gross"),
        F.col("service_value").cast(MONEY_SUM).alias("discount"), F.col("net_total").cast(MONEY_SUM).alias("net"),
        "show_discount")
    return items.unionByName(totals)
