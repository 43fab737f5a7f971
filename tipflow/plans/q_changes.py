"""Registered change-driven jobs (F1-F6, batch form) with DuckDB oracle SQL.

The oracle for F1 uses the literal trigger formulation (LAG over each
invoice's status history) — an independent check of the aggregate
formulation used by the Spark job.
"""

from __future__ import annotations

from tipflow.operators import changes as ch
from tipflow.plans.registry import register

FIRES_SQL = """
, fi AS (SELECT f.not_id, f.new_status, f.changed_at, f.seq, i.charge_status AS initial,
                ROW_NUMBER() OVER w AS n, LAG(f.new_status) OVER w AS prev
         FROM status_feed f JOIN invoice i ON i.not_id = f.not_id
         WHERE i.status_updated_at IS NULL OR f.changed_at > i.status_updated_at
         WINDOW w AS (PARTITION BY f.not_id ORDER BY f.changed_at, f.seq)),
every_fire AS (SELECT not_id, changed_at AS fire_at, seq FROM fi
               WHERE lower(new_status) = 'paid' AND new_status IS DISTINCT FROM CASE WHEN n = 1 THEN initial ELSE prev END),
fires AS (SELECT not_id, MIN(fire_at) AS fire_at FROM every_fire GROUP BY not_id)
"""
_F1 = ["status_feed", "invoice", "credit", "batch"]


@register("settle_paid_invoices", _F1, FIRES_SQL + """
SELECT i.not_id AS doc, CAST(COALESCE(i.paid_value, i.invoice_value) AS DECIMAL(18,2)) AS mov_value,
       COALESCE(i.settled_on, CAST(f.fire_at AS DATE)) AS mov_date, i.not_id, 'P' AS operation, i.ctb_id,
       'Webhook' AS actor, 'Baixa automatica boleto paid - nota ' || CAST(i.not_id AS VARCHAR) AS info
FROM every_fire e JOIN fires f ON f.not_id = e.not_id JOIN invoice i ON i.not_id = f.not_id""")
def settle_paid_invoices(m):
    """bank movements written by settling invoices whose charge turned 'paid'."""
    return ch.settle_paid_invoices(m)["movements"]


@register("settle_paid_effects", _F1, FIRES_SQL + """
SELECT f.not_id, f.fire_at,
       (SELECT COUNT(*) FROM credit c WHERE c.not_id = f.not_id AND c.sit_id <> 1) AS credits_released,
       (SELECT COUNT(*) FROM batch b WHERE b.batch_status = 'C'
          AND b.batch_id IN (SELECT c.batch_id FROM credit c WHERE c.not_id = f.not_id)) AS batches_reopened
FROM fires f""")
def settle_paid_effects(m):
    """per settled invoice, transition time, credits released and batches reopened."""
    return ch.settlement_effects(m, ch.settle_paid_invoices(m)["fires"])


@register("settle_paid_invoice_state", _F1, FIRES_SQL + """
, last AS (SELECT not_id, new_status AS last_status, changed_at AS last_at FROM (
             SELECT *, ROW_NUMBER() OVER (PARTITION BY not_id ORDER BY changed_at DESC, seq DESC) AS rn FROM fi) x
           WHERE rn = 1)
SELECT i.not_id, i.cli_id,
       CASE WHEN f.not_id IS NOT NULL THEN 'BT' ELSE i.situation END AS situation,
       CASE WHEN f.not_id IS NOT NULL THEN COALESCE(i.paid_value, i.invoice_value) ELSE i.paid_value END AS paid_value,
       CASE WHEN f.not_id IS NOT NULL THEN COALESCE(i.settled_on, CAST(f.fire_at AS DATE)) ELSE i.settled_on END AS settled_on,
       CASE WHEN l.not_id IS NOT NULL THEN l.last_status ELSE i.charge_status END AS charge_status,
       COALESCE(l.last_at, i.status_updated_at) AS status_updated_at
FROM invoice i LEFT JOIN fires f ON f.not_id = i.not_id LEFT JOIN last l ON l.not_id = i.not_id""")
def settle_paid_invoice_state(m):
    """invoice table after the settlement job (situation, paid value/date, charge status)."""
    inv = ch.settle_paid_invoices(m)["invoice"]
    return inv.select("not_id", "cli_id", "situation", "paid_value", "settled_on", "charge_status", "status_updated_at")


@register("lower_pix_limit", ["collaborator", "limit_change"], """
SELECT u.usr_id, u.cli_id,
       CAST(CASE WHEN u.day_value IS NOT NULL AND u.day_value > l.new_limit THEN l.new_limit ELSE u.day_value END AS DECIMAL(18,2)) AS day_value,
       CAST(CASE WHEN u.night_value IS NOT NULL AND u.night_value > l.new_limit THEN l.new_limit ELSE u.night_value END AS DECIMAL(18,2)) AS night_value
FROM collaborator u JOIN limit_change l ON l.cli_id = u.cli_id
WHERE l.old_limit IS NOT NULL AND l.new_limit IS NOT NULL AND l.new_limit < l.old_limit
  AND ((u.day_value IS NOT NULL AND u.day_value > l.new_limit) OR (u.night_value IS NOT NULL AND u.night_value > l.new_limit))""")
def lower_pix_limit(m):
    """collaborator day/night values clamped to lowered tenant limits (changed rows)."""
    return ch.lower_pix_limit(m, m.limit_change)


@register("pix_limit_trigger", ["collaborator", "tenant", "limit_feed"], """
, steps AS (SELECT f.cli_id, f.new_limit, ROW_NUMBER() OVER w AS n, LAG(f.new_limit) OVER w AS before, t.pix_limit
            FROM limit_feed f JOIN tenant t ON t.cli_id = f.cli_id
            WINDOW w AS (PARTITION BY f.cli_id ORDER BY f.changed_at, f.seq)),
lows AS (SELECT cli_id, MIN(new_limit) AS low FROM steps
         WHERE new_limit < CASE WHEN n = 1 THEN pix_limit ELSE before END GROUP BY cli_id)
SELECT u.usr_id, u.cli_id, CAST(CASE WHEN day_value > low THEN low ELSE day_value END AS DECIMAL(18,2)) AS day_value,
       CAST(CASE WHEN night_value > low THEN low ELSE night_value END AS DECIMAL(18,2)) AS night_value
FROM collaborator u JOIN lows ON lows.cli_id = u.cli_id WHERE day_value > low OR night_value > low""")
def pix_limit_trigger(m):
    """F2 over a feed of limit changes: collaborators whose values the lowered limits cut, after all changes."""
    return ch.pix_limit_trigger(m)


def pairs_sql(grain: str) -> str:
    gb = "CAST(r.imported_at AS DATE)" if grain == "day" else "year(r.imported_at)"
    gn = "nf.issue_date" if grain == "day" else "year(nf.issue_date)"
    return f"""
, unl AS (SELECT batch_id, COUNT(*) AS n_credits FROM credit WHERE not_id IS NULL AND batch_id IS NOT NULL GROUP BY batch_id),
rb AS (SELECT r.batch_id, r.cli_id, u.n_credits, {gb} AS g,
              ROW_NUMBER() OVER (PARTITION BY r.cli_id, {gb} ORDER BY r.batch_id) AS rn
       FROM batch r JOIN unl u ON u.batch_id = r.batch_id),
nb AS (SELECT nf.not_id, nf.cli_id, {gn} AS g,
              ROW_NUMBER() OVER (PARTITION BY nf.cli_id, {gn} ORDER BY nf.not_id) AS rn
       FROM invoice nf WHERE nf.situation = 'A'),
pairs AS (SELECT rb.batch_id, rb.cli_id, CAST(rb.g AS VARCHAR) AS period, nb.not_id, rb.n_credits
          FROM rb JOIN nb ON nb.cli_id = rb.cli_id AND nb.g = rb.g AND nb.rn = rb.rn)
"""


_F3 = ["credit", "batch", "invoice"]


@register("invoice_backfill_preview", _F3, pairs_sql("day") + "SELECT * FROM pairs")
def invoice_backfill_preview(m):
    """(batch, open invoice) pairs per tenant and day with the credits each would link."""
    return ch.backfill_pairs(m, "day")


@register("invoice_backfill_preview_yearly", _F3, pairs_sql("year") + "SELECT * FROM pairs")
def invoice_backfill_preview_yearly(m):
    """F3 at year grain: pairs per tenant and year."""
    return ch.backfill_pairs(m, "year")


@register("invoice_backfill_apply", _F3, pairs_sql("year") + """
SELECT c.batch_id, c.cli_id, COALESCE(c.not_id, p.not_id) AS not_id, COUNT(*) AS n_credits
FROM credit c LEFT JOIN pairs p ON p.batch_id = c.batch_id
GROUP BY c.batch_id, c.cli_id, COALESCE(c.not_id, p.not_id)""")
def invoice_backfill_apply(m):
    """credit links after writing the paired invoice where NULL (year pairing), per batch and invoice."""
    from pyspark.sql import functions as F
    cred = ch.backfill_apply(m, ch.backfill_pairs(m, "year"))
    return cred.groupBy("batch_id", "cli_id", "not_id").agg(F.count(F.lit(1)).alias("n_credits"))


@register("credits_without_invoice", ["credit"], """
SELECT cli_id, batch_id, import_date, COUNT(*) AS n_credits FROM credit
WHERE not_id IS NULL AND batch_id IS NOT NULL GROUP BY cli_id, batch_id, import_date""")
def credits_without_invoice(m):
    """credits without invoice per tenant, batch and import day."""
    return ch.credits_without_invoice(m.credit)


def breaches_sql(rules) -> str:
    parts = []
    for name, route, width, limit in rules:
        n, unit = width.split()
        where = f"WHERE route = '{route}'" if route else ""
        parts.append(f"""
SELECT client_id, '{name}' AS rule, time_bucket(INTERVAL '{n} {unit}', req_at) AS window_start,
       time_bucket(INTERVAL '{n} {unit}', req_at) + INTERVAL '{n} {unit}' AS window_end, COUNT(*) AS n
FROM request_log {where}
GROUP BY client_id, time_bucket(INTERVAL '{n} {unit}', req_at) HAVING COUNT(*) > {limit}""")
    return "\nUNION ALL\n".join(parts)


DAILY_RULES = [("daily", None, "1 day", 5)]


@register("rate_limit_breaches", ["request_log"], breaches_sql(ch.RATE_RULES))
def rate_limit_breaches(m):
    """request-rate breaches per client under the reference's limits."""
    return ch.rate_limit_breaches(m.request_log)


@register("rate_limit_breaches_daily", ["request_log"], breaches_sql(DAILY_RULES))
def rate_limit_breaches_daily(m):
    """F6 with a 5-per-day rule (the test data is too sparse to break the per-minute limits)."""
    return ch.rate_limit_breaches(m.request_log, DAILY_RULES)
