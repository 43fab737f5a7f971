"""Portal users, tenants and access."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipflow.functions.columns import digits
from tipflow.operators.topups import invoice_owner
from tipflow.sources.mart import Mart

SECRET_COLUMNS = ("pwd_hash",)


def portal_users(m: Mart, attempts: DataFrame) -> DataFrame:
    """G1: portal user (secret columns dropped) matched by lower(login) or lower(email).

    The OR match is two equi-joins (login, email) unioned and de-duplicated,
    so both sides stay hash/broadcast joins; tenant via LEFT JOIN.
    """
    u = m.portal_user.drop(*SECRET_COLUMNS)
    a = attempts.select("attempt_id", F.lower("identifier").alias("key"))
    by_login = a.join(u.withColumn("key", F.lower("login")), "key")
    by_email = a.join(u.withColumn("key", F.lower("email")), "key")
    hits = by_login.unionByName(by_email).drop("key").dropDuplicates(["attempt_id", "usr_code"])
    t = m.tenant.select(F.col("cli_id").alias("legacy_cli_id"), "trade_name", "cnpj")
    return hits.join(t, "legacy_cli_id", "left").select(
        "attempt_id", "usr_code", "login", "user_name", "email", "is_admin", "legacy_cli_id", "trade_name", "cnpj")


def user_tenants(m: Mart) -> DataFrame:
    """Tenants a portal user may act for.

    Role rows first; without roles the legacy tenant column; without either,
    an admin ('S') may act for every tenant.  That last case is one row with
    ``all_tenants = true`` (and no tenant id) instead of a user x tenant
    product.
    """
    u = m.portal_user.select("usr_code", "legacy_cli_id", "is_admin")
    t = m.tenant.select("cli_id", "trade_name")
    roles = (m.user_role.filter(F.col("cli_id").isNotNull()).join(t, "cli_id")
             .select("usr_code", "cli_id", "trade_name", F.lit("role").alias("source")))
    no_roles = u.join(roles.select("usr_code").distinct(), "usr_code", "left_anti")
    legacy = (no_roles.filter(F.col("legacy_cli_id").isNotNull())
              .join(t, F.col("legacy_cli_id") == F.col("cli_id"))
              .select("usr_code", "cli_id", "trade_name", F.lit("legacy").alias("source")))
    admin_all = (no_roles.join(legacy.select("usr_code"), "usr_code", "left_anti")
                 .filter(F.col("is_admin") == "S")
                 .select("usr_code", F.lit(None).cast("long").alias("cli_id"),
                         F.lit(None).cast("string").alias("trade_name"), F.lit("admin_all").alias("source")))
    return (roles.unionByName(legacy).unionByName(admin_all)
            .withColumn("all_tenants", F.col("source") == "admin_all"))


def tenant_access_audit(m: Mart) -> DataFrame:
    """allow/deny per logged request.

    Tenant check: no tenant asked -> allow; admin -> allow; asked tenant equal
    to the token's tenant -> allow; else deny.  Invoice requests also need the
    invoice's owner (D10): unknown invoice -> not_found; admin or owner equal
    to the token's tenant -> allow; else deny.  Requests without an invoice
    (most of the log) skip the owner join: their NULL key would bring them all
    into one task.
    """
    u = m.portal_user.select("usr_code", F.col("legacy_cli_id").alias("token_cli_id"),
                             (F.col("is_admin") == "S").alias("admin"))
    own = invoice_owner(m).select(F.col("not_id").alias("asked_not_id"), F.col("cli_id").alias("owner_cli_id"))
    log = m.request_log.select("req_id", "usr_code", "route", "asked_cli_id", "asked_not_id")
    asks = F.col("asked_not_id").isNotNull()
    r = (log.filter(asks).join(own, "asked_not_id", "left")
         .unionByName(log.filter(~asks), allowMissingColumns=True).join(u, "usr_code", "left"))
    admin = F.coalesce("admin", F.lit(False))
    tenant_ok = (F.col("asked_cli_id").isNull() | admin
                 | F.coalesce(F.col("asked_cli_id") == F.col("token_cli_id"), F.lit(False)))
    inv_state = (F.when(F.col("asked_not_id").isNull(), "none")
                 .when(F.col("owner_cli_id").isNull(), "not_found")
                 .when(admin | F.coalesce(F.col("owner_cli_id") == F.col("token_cli_id"), F.lit(False)), "ok")
                 .otherwise("deny"))
    decision = (F.when(~tenant_ok, "deny_tenant")
                .when(inv_state == "not_found", "not_found")
                .when(inv_state == "deny", "deny_invoice")
                .otherwise("allow"))
    return r.select("req_id", "usr_code", "route", "asked_cli_id", "asked_not_id", decision.alias("decision"))


def access_denied_counts(m: Mart) -> DataFrame:
    """Denied requests per user."""
    a = tenant_access_audit(m)
    return a.groupBy("usr_code").agg(F.count(F.lit(1)).alias("n_requests"),
                                     F.count_if(F.col("decision") != "allow").alias("n_denied"))


def portal_user_status(m: Mart) -> DataFrame:
    """Derived user status (access 'S' -> 1 else 2) with its label."""
    st = m.status_lookup.select("sit_id", "sit_name")
    return (m.portal_user.select("usr_code", "login", F.when(F.col("can_access") == "S", 1).otherwise(2).alias("sit_id"))
            .join(st, "sit_id", "left"))


def tenant_listing(m: Mart) -> DataFrame:
    """Tenants with status label ordered by trade name."""
    st = m.status_lookup.select("sit_id", "sit_name")
    return (m.tenant.select("cli_id", "trade_name", "cnpj", "sit_id").join(st, "sit_id", "left")
            .orderBy("trade_name"))


def terms_acceptance(m: Mart, accepting: DataFrame) -> DataFrame:
    """User table after registering acceptance; idempotent (an earlier acceptance keeps its time)."""
    acc = accepting.groupBy("usr_code").agg(F.min("accepted_at").alias("_at"))
    u = m.portal_user.join(acc, "usr_code", "left")
    hit = F.col("_at").isNotNull()
    return u.select("usr_code", "legacy_cli_id",
                    (F.coalesce("terms_accepted", F.lit(False)) | hit).alias("terms_accepted"),
                    F.when(F.coalesce("terms_accepted", F.lit(False)), F.col("terms_accepted_at"))
                    .otherwise(F.col("_at")).alias("terms_accepted_at"))


def acceptance_rate(users: DataFrame) -> DataFrame:
    """Accepted users per legacy tenant."""
    return users.groupBy("legacy_cli_id").agg(F.count(F.lit(1)).alias("n_users"),
                                              F.count_if("terms_accepted").alias("n_accepted"))


def tenant_cnpj_duplicates(m: Mart) -> DataFrame:
    """Tenants whose CNPJ (digits) is used by more than one tenant.

    One row per (CNPJ, tenant) with the group size: the count is an
    aggregate and the tenants come back through a join, so no group is
    gathered into a list.
    """
    t = m.tenant.select("cli_id", digits("cnpj").alias("cnpj_digits"))
    dup = t.groupBy("cnpj_digits").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    return t.join(dup, "cnpj_digits").select("cnpj_digits", "cli_id", "n")


def password_expiry_due(m: Mart, as_of: str) -> DataFrame:
    """Password expiry by type: days ('D': start + days), fixed date ('F'), never ('N')."""
    exp = (F.when(F.col("pwd_expiry_type") == "D", F.date_add("pwd_start", F.col("pwd_days")))
           .when(F.col("pwd_expiry_type") == "F", F.col("pwd_until")))
    return m.portal_user.select("usr_code", "pwd_expiry_type", exp.alias("expires_on"),
                                F.coalesce(exp < F.to_date(F.lit(as_of)), F.lit(False)).alias("due"))
