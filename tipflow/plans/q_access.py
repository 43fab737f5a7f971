"""Registered portal-user, tenant and access queries (G1-G8) with DuckDB oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tipflow.operators import access as a
from tipflow.plans.registry import AS_OF, register

HITS_SQL = """
, la AS (SELECT attempt_id, lower(identifier) AS key FROM login_attempt),
hits AS (SELECT DISTINCT la.attempt_id, u.usr_code FROM la
         JOIN portal_user u ON la.key = lower(u.login) OR la.key = lower(u.email))
"""


@register("portal_users", ["login_attempt", "portal_user", "tenant"], HITS_SQL + """
SELECT h.attempt_id, u.usr_code, u.login, u.user_name, u.email, u.is_admin, u.legacy_cli_id, t.trade_name, t.cnpj
FROM hits h JOIN portal_user u ON u.usr_code = h.usr_code LEFT JOIN tenant t ON t.cli_id = u.legacy_cli_id""")
def portal_users(m):
    """G1: portal users matched to login attempts by login or e-mail, case-insensitive."""
    return a.portal_users(m, m.login_attempt)


@register("user_tenants", ["portal_user", "user_role", "tenant"], """
, roles AS (SELECT r.usr_code, r.cli_id, t.trade_name, 'role' AS source
            FROM user_role r JOIN tenant t ON t.cli_id = r.cli_id WHERE r.cli_id IS NOT NULL),
legacy AS (SELECT u.usr_code, t.cli_id, t.trade_name, 'legacy' AS source
           FROM portal_user u JOIN tenant t ON t.cli_id = u.legacy_cli_id
           WHERE u.usr_code NOT IN (SELECT usr_code FROM roles)),
adm AS (SELECT u.usr_code, CAST(NULL AS BIGINT) AS cli_id, CAST(NULL AS VARCHAR) AS trade_name, 'admin_all' AS source
        FROM portal_user u WHERE u.is_admin = 'S' AND u.usr_code NOT IN (SELECT usr_code FROM roles)
          AND u.usr_code NOT IN (SELECT usr_code FROM legacy))
SELECT *, source = 'admin_all' AS all_tenants FROM (
  SELECT * FROM roles UNION ALL SELECT * FROM legacy UNION ALL SELECT * FROM adm) x""")
def user_tenants(m):
    """Tenants each portal user may act for (roles, else legacy tenant, else admin-all)."""
    return a.user_tenants(m)


AUDIT_SQL = """
, own AS (SELECT not_id, MIN(cli_id) AS owner FROM credit WHERE not_id IS NOT NULL GROUP BY not_id),
ar AS (SELECT q.*, u.legacy_cli_id AS token, COALESCE(u.is_admin = 'S', false) AS admin, o.owner
       FROM request_log q LEFT JOIN portal_user u ON u.usr_code = q.usr_code
       LEFT JOIN own o ON o.not_id = q.asked_not_id),
audit AS (SELECT req_id, usr_code, route, asked_cli_id, asked_not_id,
          CASE WHEN NOT (asked_cli_id IS NULL OR admin OR COALESCE(asked_cli_id = token, false)) THEN 'deny_tenant'
               WHEN asked_not_id IS NOT NULL AND owner IS NULL THEN 'not_found'
               WHEN asked_not_id IS NOT NULL AND NOT (admin OR COALESCE(owner = token, false)) THEN 'deny_invoice'
               ELSE 'allow' END AS decision
          FROM ar)
"""


@register("tenant_access_audit", ["request_log", "portal_user", "credit"], AUDIT_SQL + "SELECT * FROM audit")
def tenant_access_audit(m):
    """allow/deny decision for every logged request (tenant and invoice ownership checks)."""
    return a.tenant_access_audit(m)


@register("access_denied_counts", ["request_log", "portal_user", "credit"], AUDIT_SQL + """
SELECT usr_code, COUNT(*) AS n_requests, COUNT(*) FILTER (WHERE decision <> 'allow') AS n_denied
FROM audit GROUP BY usr_code""")
def access_denied_counts(m):
    """Requests and denials per portal user."""
    return a.access_denied_counts(m)


@register("portal_user_status", ["portal_user", "status_lookup"], """
SELECT u.sit_id, u.usr_code, u.login, st.sit_name FROM (
  SELECT usr_code, login, CASE WHEN can_access = 'S' THEN 1 ELSE 2 END AS sit_id FROM portal_user) u
LEFT JOIN status_lookup st ON st.sit_id = u.sit_id""")
def portal_user_status(m):
    """Derived portal-user status and label."""
    return a.portal_user_status(m)


@register("tenant_listing", ["tenant", "status_lookup"], """
SELECT t.sit_id, t.cli_id, t.trade_name, t.cnpj, s.sit_name
FROM tenant t LEFT JOIN status_lookup s ON s.sit_id = t.sit_id ORDER BY t.trade_name""")
def tenant_listing(m):
    """Tenants with status label by trade name."""
    return a.tenant_listing(m)


TERMS_SQL = HITS_SQL + """
, acc AS (SELECT h.usr_code, MIN(l.attempted_at) AS at FROM hits h
          JOIN login_attempt l ON l.attempt_id = h.attempt_id GROUP BY h.usr_code),
terms AS (SELECT u.usr_code, u.legacy_cli_id,
                 (COALESCE(u.terms_accepted, false) OR acc.at IS NOT NULL) AS terms_accepted,
                 CASE WHEN COALESCE(u.terms_accepted, false) THEN u.terms_accepted_at ELSE acc.at END AS terms_accepted_at
          FROM portal_user u LEFT JOIN acc ON acc.usr_code = u.usr_code)
"""


def _accepting(m):
    hits = a.portal_users(m, m.login_attempt).select("attempt_id", "usr_code")
    return (hits.join(m.login_attempt.select("attempt_id", "attempted_at"), "attempt_id")
            .select("usr_code", F.col("attempted_at").alias("accepted_at")))


@register("terms_acceptance", ["login_attempt", "portal_user"], TERMS_SQL + "SELECT * FROM terms")
def terms_acceptance(m):
    """Portal users after recording acceptance at their first matched login (idempotent)."""
    return a.terms_acceptance(m, _accepting(m))


@register("terms_acceptance_rate", ["login_attempt", "portal_user"], TERMS_SQL + """
SELECT legacy_cli_id, COUNT(*) AS n_users, COUNT(*) FILTER (WHERE terms_accepted) AS n_accepted
FROM terms GROUP BY legacy_cli_id""")
def terms_acceptance_rate(m):
    """Accepted users per legacy tenant after the acceptance job."""
    return a.acceptance_rate(a.terms_acceptance(m, _accepting(m)))


@register("tenant_cnpj_duplicates", ["tenant"], """
SELECT d.cnpj_digits, t.cli_id, d.n FROM (
  SELECT regexp_replace(cnpj, '[^0-9]', '', 'g') AS cnpj_digits, COUNT(*) AS n
  FROM tenant GROUP BY 1 HAVING COUNT(*) > 1) d
JOIN tenant t ON regexp_replace(t.cnpj, '[^0-9]', '', 'g') = d.cnpj_digits""")
def tenant_cnpj_duplicates(m):
    """Tenants sharing a CNPJ with another tenant."""
    return a.tenant_cnpj_duplicates(m)


@register("password_expiry_due", ["portal_user"], f"""
SELECT usr_code, pwd_expiry_type, expires_on, COALESCE(expires_on < DATE '{AS_OF}', false) AS due FROM (
  SELECT usr_code, pwd_expiry_type,
         CASE WHEN pwd_expiry_type = 'D' THEN pwd_start + pwd_days WHEN pwd_expiry_type = 'F' THEN pwd_until END AS expires_on
  FROM portal_user) x""")
def password_expiry_due(m):
    """Password expiry date by type and whether it is due at AS_OF."""
    return a.password_expiry_due(m, AS_OF)
