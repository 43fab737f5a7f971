"""Collaborators, categories and sheet imports.

Searches and lookups run for every tenant at once; pages are per tenant
(``row_number`` between bounds).  Lookups by a key list are joins against a
key frame (Spark broadcasts it only when its measured size is small).
Import and category jobs return new-state frames; nothing is updated in
place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tipflow.functions.columns import (EMAIL_PATTERN, NO_CATEGORY, cpf_valid, digits, js_trim, leading_number,
                                       pad_cpf, parse_birth_date, sql_digits, text_order)
from tipflow.functions import messages as M
from tipflow.operators.ids import dense_ids
from tipflow.session import checkpoint_dir
from tipflow.sources.mart import Mart


def _with_lookups(m: Mart, u: DataFrame) -> DataFrame:
    t = m.tenant.select("cli_id", "trade_name", "fee_rate")
    st = m.status_lookup.select("sit_id", "sit_name")
    k = m.category.select("set_id", F.col("set_name").alias("own_category"))
    return u.join(t, "cli_id").join(st, "sit_id").join(k, "set_id", "left")


def collaborators_active(m: Mart, term: str = "", category: str | None = None,
                         limit: int | None = 50, offset: int = 0, cli_id=None, collation: str | None = None) -> DataFrame:
    """Active collaborators: name ILIKE or CPF LIKE the term; optional category.

    The category filter keeps a collaborator when a link row points to a
    category of that name OR their own category column does (an existence
    join under OR); the page is per tenant, ordered by name (:func:`text_order`).  Page sizes below 1
    and offsets below 0 raise ValueError; ``topups.clamped_page`` is the bound of the reference's screens.
    """
    u = m.collaborator.filter(F.col("sit_id") == 1)
    if cli_id is not None:
        u = u.filter(F.col("cli_id") == cli_id)
    pat = f"%{term}%"
    u = u.filter(F.col("usr_name").ilike(pat) | F.col("cpf").like(pat))
    if category is not None:
        wanted = m.category.filter(F.col("set_name") == category).select("set_id", "cli_id")
        linked = (m.collab_category.join(wanted.select("set_id"), "set_id", "left_semi")
                  .select("usr_id").distinct().withColumn("_linked", F.lit(True)))
        own = wanted.select(F.col("set_id").alias("_own_set"), F.lit(True).alias("_own"))
        u = (u.join(linked, "usr_id", "left")
             .join(own, F.col("set_id") == F.col("_own_set"), "left")
             .filter(F.coalesce("_linked", F.lit(False)) | F.coalesce("_own", F.lit(False)))
             .drop("_linked", "_own", "_own_set"))
    rows = _with_lookups(m, u).select(
        "cli_id", "usr_id", "usr_name", "cpf", "trade_name",
        F.coalesce("own_category", F.lit(NO_CATEGORY)).alias("category"),
        F.coalesce("set_id", F.lit(0)).cast("long").alias("set_id"),
        F.col("sit_name").alias("status"),
        F.coalesce("fee_rate", F.lit(0).cast("decimal(9,4)")).alias("fee_rate"))
    if limit is None:
        return rows
    if int(limit) < 1 or int(offset) < 0:
        raise ValueError(f"page size {limit} at {offset}")
    w = Window.partitionBy("cli_id").orderBy(text_order("usr_name", collation), "usr_name", "usr_id")
    return (rows.withColumn("pos", F.row_number().over(w).cast("long"))
            .filter((F.col("pos") > offset) & (F.col("pos") <= offset + limit)))


def collaborators_active_count(m: Mart, term: str = "", category: str | None = None, cli_id=None) -> DataFrame:
    """E1 companion: how many collaborators match, per tenant (the page's total)."""
    return (collaborators_active(m, term, category, limit=None, cli_id=cli_id)
            .groupBy("cli_id").agg(F.count(F.lit(1)).alias("total")))


def collaborators_by_cpfs(m: Mart, keys: DataFrame) -> DataFrame:
    """Active collaborators of the key's tenant whose digits-only CPF is in the key frame.

    ``keys`` holds (cli_id, key, cpf) with an 11-digit CPF; every match is returned.
    """
    u = (m.collaborator.filter(F.col("sit_id") == 1)
         .withColumn("cpf_digits", sql_digits("cpf")))
    k = m.category.select("set_id", F.col("set_name").alias("category"))
    t = m.tenant.select("cli_id", "fee_rate")
    return (keys.join(u, (keys.cli_id == u.cli_id) & (keys.cpf == u.cpf_digits))
            .drop(u.cli_id).drop(keys.cpf)
            .join(k, "set_id", "left").join(t, "cli_id")
            .select("cli_id", "key", "usr_id", "usr_name", "cpf",
                    F.coalesce("category", F.lit(NO_CATEGORY)).alias("category"),
                    F.coalesce("fee_rate", F.lit(0).cast("decimal(9,4)")).alias("fee_rate")))


def collaborators_by_ids(m: Mart, keys: DataFrame) -> DataFrame:
    """Active collaborators of the key's tenant whose id is in the key frame ((cli_id, key, usr_id))."""
    u = m.collaborator.filter(F.col("sit_id") == 1).select("usr_id", "cli_id", "usr_name", "cpf", "set_id")
    k = m.category.select("set_id", F.col("set_name").alias("category"))
    t = m.tenant.select("cli_id", "trade_name", "fee_rate")
    return (keys.join(u, ["cli_id", "usr_id"]).join(k, "set_id", "left").join(t, "cli_id")
            .select("cli_id", "key", "usr_id", "usr_name", "cpf", "trade_name",
                    F.coalesce("category", F.lit(NO_CATEGORY)).alias("category"),
                    F.coalesce("set_id", F.lit(0)).cast("long").alias("set_id"),
                    F.coalesce("fee_rate", F.lit(0).cast("decimal(9,4)")).alias("fee_rate")))


def sheet_cpf_keys(m: Mart) -> DataFrame:
    """Key frame of a credit sheet: (tenant, line, padded digits CPF)."""
    return m.credit_sheet.select("cli_id", F.col("line").alias("key"),
                                 pad_cpf(digits(js_trim("cpf"))).alias("cpf"))


def categories(m: Mart, collation: str | None = None) -> DataFrame:
    """Categories of every tenant ordered by name."""
    return m.category.select("cli_id", "set_id", "set_name").orderBy("cli_id", text_order("set_name", collation), "set_name")


def restaurants(m: Mart) -> DataFrame:
    """Tenants ordered by trade name."""
    return m.tenant.select("cli_id", "trade_name").orderBy("trade_name")


def statuses(m: Mart) -> DataFrame:
    """Status list ordered by id, with the number of collaborators holding each status."""
    n = m.collaborator.groupBy("sit_id").agg(F.count(F.lit(1)).alias("n_collaborators"))
    return (m.status_lookup.join(n, "sit_id", "left")
            .select("sit_id", "sit_name", F.coalesce("n_collaborators", F.lit(0)).alias("n_collaborators"))
            .orderBy("sit_id"))


def import_template(m: Mart) -> DataFrame:
    """Distinct (name, CPF) of active collaborators without a schedule; empty value column."""
    return (m.collaborator.filter(F.col("sit_id") == 1)
            .join(m.schedule.select("usr_id"), "usr_id", "left_anti")
            .select("cli_id", "usr_name", "cpf").distinct()
            .withColumn("valor", F.lit("")))


def tenant_fee(m: Mart) -> DataFrame:
    """E5: tenant fee rate (default 0) and type ('A' else 'D')."""
    return m.tenant.select("cli_id", F.coalesce("fee_rate", F.lit(0).cast("decimal(9,4)")).alias("fee_rate"),
                           F.when(F.col("fee_type") == "A", "A").otherwise("D").alias("fee_type"))


def _matching(m: Mart, term: str, legacy_digits: bool) -> DataFrame:
    pat = f"%{term}%"
    dig = "".join(ch for ch in term if ch.isdigit())
    cond = (F.col("usr_name").ilike(pat) | F.col("cpf").ilike(pat)
            | F.col("sit_name").ilike(pat) | F.col("trade_name").ilike(pat))
    if dig or legacy_digits:
        cond = cond | sql_digits("cpf").like(f"%{dig}%")
    return _with_lookups(m, m.collaborator).filter(cond)


def collaborators_all(m: Mart, term: str, legacy_digits: bool = False, limit: int = 100,
                      offset: int = 0, collation: str | None = None) -> DataFrame:
    """All statuses; term over name, digits CPF, CPF, status name and tenant name; a page per tenant.

    A term without digits makes the digits pattern ``%%``, which matches every
    collaborator in the reference (S9); that branch is only kept with
    ``legacy_digits=True``.
    """
    w = Window.partitionBy("cli_id").orderBy(text_order("usr_name", collation), "usr_name", "usr_id")
    return (_matching(m, term, legacy_digits)
            .select("cli_id", "usr_id", "usr_name", "cpf", "trade_name", F.col("sit_name").alias("status"), "sit_id")
            .withColumn("pos", F.row_number().over(w).cast("long"))
            .filter((F.col("pos") > offset) & (F.col("pos") <= offset + limit)))


def collaborators_all_count(m: Mart, term: str, legacy_digits: bool = False) -> DataFrame:
    """The page total: collaborators matching the term per tenant."""
    return _matching(m, term, legacy_digits).groupBy("cli_id").agg(F.count(F.lit(1)).alias("total"))


def collaborator_full(m: Mart, nested: bool = False) -> DataFrame:
    """Full collaborator record with its categories sorted by name.

    ``nested=True`` gives ``array<struct<set_id, set_name>>``; the flat form
    joins ids and names as text.
    """
    links = m.collab_category.join(m.category.select("set_id", "set_name"), "set_id")
    cats = links.groupBy("usr_id").agg(
        F.array_sort(F.collect_list(F.struct("set_name", "set_id"))).alias("cats"))
    u = m.collaborator.join(cats, "usr_id", "left")
    base = ["cli_id", "usr_id", "usr_name", "cpf", "email", "phone",
            F.coalesce("birth_date", "birth_date_legacy").alias("birth_date"), "sex", "sit_id",
            "closed_arrangement", "open_arrangement", "day_value", "night_value"]
    if nested:
        return u.select(*base, F.transform(F.coalesce("cats", F.array()),
                                           lambda s: F.struct(s["set_id"], s["set_name"])).alias("categories"))
    return u.select(*base,
                    F.array_join(F.transform("cats", lambda s: s["set_id"].cast("string")), ",").alias("category_ids"),
                    F.array_join(F.transform("cats", lambda s: s["set_name"]), ", ").alias("category_names"))


def collaborator_search_client(m: Mart, term: str) -> DataFrame:
    """Screen search: the term in the name, the CPF as written or its digits, the tenant's trade
    name, or the status as the screen shows it ('ativo', 'inativo' for blocked ones, else its own name).

    An empty term keeps everyone.
    """
    t = term.lower().strip()
    dig = "".join(ch for ch in term if ch in "0123456789")
    name = F.upper(F.coalesce("sit_name", F.lit("")))
    display = (F.when(name.isin("ATIVO", "ACTIVE"), "ativo").when(name.isin("BLOQUEADO", "BLOCKED", "INATIVO"), "inativo")
               .otherwise(F.lower(F.coalesce("sit_name", F.lit("")))))
    u = (m.collaborator.join(m.tenant.select("cli_id", "trade_name"), "cli_id")
         .join(m.status_lookup.select("sit_id", "sit_name"), "sit_id", "left").withColumn("status_display", display))
    if t:
        cond = F.lit(False)
        for field in (F.lower("usr_name"), F.lower("cpf"), F.lower("trade_name"), F.col("status_display")):
            cond = cond | F.coalesce(F.contains(field, F.lit(t)), F.lit(False))
        if dig:
            cond = cond | F.coalesce(F.contains(digits("cpf"), F.lit(dig)), F.lit(False))
        u = u.filter(cond)
    return u.select("cli_id", "usr_id", "usr_name", "cpf", "trade_name", "status_display")


def tenant_picker(m: Mart, term: str) -> DataFrame:
    """Tenant picker: trade name contains the term, or CNPJ digits contain its digits."""
    t = term.lower().strip()
    dig = "".join(ch for ch in term if ch.isdigit())
    cond = F.lower("trade_name").contains(t)
    if dig:
        cond = cond | digits("cnpj").contains(dig)
    return m.tenant.filter(cond).select("cli_id", "trade_name", "cnpj")


def selection_totals(m: Mart) -> DataFrame:
    """Count and total value of the selected lines, per batch."""
    return m.credit.groupBy("batch_id", "cli_id").agg(
        F.count(F.lit(1)).alias("n_selected"), F.sum("credit_value").cast("decimal(38,2)").alias("total_value"))


def upsert_collaborators(m: Mart, changes: DataFrame, as_of: str) -> DataFrame:
    """Collaborator new state after updates and status changes by (id, tenant).

    An update names every field, so a missing e-mail, phone, birth date, sex or CPF clears it; a
    new tenant moves the collaborator.  Checks, the first failing one is the reason and nothing is
    written: name present, CPF check digits, e-mail form, birth date yyyy-mm-dd not after
    ``as_of`` (each if given).  Text is normalized: name upper + trim, CPF digits padded to 11,
    e-mail lower + trim, phone digits only.  A change for an id outside its tenant has no effect.
    """
    given = {c: js_trim(c) for c in ("new_name", "new_cpf", "new_email", "new_birth")}
    birth = F.when(F.col("new_birth").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date("new_birth", "yyyy-MM-dd"))
    reason = F.when(F.col("op") == "update", (
        F.when(F.coalesce(given["new_name"], F.lit("")) == "", F.lit(M.SHEET_NAME_REQUIRED))
        .when((given["new_cpf"] != "") & ~cpf_valid("new_cpf"), F.lit(M.CPF_INVALID))
        .when((given["new_email"] != "") & ~given["new_email"].rlike(EMAIL_PATTERN), F.lit(M.EMAIL_INVALID))
        .when((given["new_birth"] != "") & ~F.coalesce(birth <= F.to_date(F.lit(as_of)), F.lit(False)),
              F.lit(M.BIRTH_DATE_INVALID))))
    ch = changes.select("usr_id", "cli_id", "op", "new_sit_id", "new_name", "new_cpf", "new_email", "new_phone",
                        "new_sex", "new_cli_id", birth.alias("_birth"), reason.alias("reason"))
    u = m.collaborator.join(ch, ["usr_id", "cli_id"], "left")
    upd = F.coalesce((F.col("op") == "update") & F.col("reason").isNull(), F.lit(False))
    sts = F.coalesce(F.col("op") == "status", F.lit(False))

    def put(new, old):
        return F.when(upd, new).otherwise(F.col(old)).alias(old)

    return u.select(
        "usr_id", put(F.coalesce("new_cli_id", "cli_id"), "cli_id"), put(F.upper(given["new_name"]), "usr_name"),
        put(pad_cpf(digits("new_cpf")), "cpf"), put(F.nullif(F.lower(given["new_email"]), F.lit("")), "email"),
        put(F.when(F.col("new_phone") != "", digits("new_phone")), "phone"), put(F.col("_birth"), "birth_date"),
        put(F.nullif(F.col("new_sex"), F.lit("")), "sex"),
        F.when(sts, F.col("new_sit_id")).otherwise(F.col("sit_id")).alias("sit_id"),
        (upd | sts).alias("changed"), "reason")


def validate_credit_sheet(m: Mart) -> DataFrame:
    """Per sheet line: normalized fields, reasons list and validity.

    name 1..255 after trim; CPF digits padded to 11 and exactly 11; value =
    leading number of the text, 0 < value <= 1,000,000; category default
    'Sem categoria'.  The sheet line is the reference's index + 2.
    """
    s = m.credit_sheet
    nome = js_trim("nome")
    cpf_d = pad_cpf(digits(js_trim("cpf")))
    valor = F.when(F.col("valor").isNotNull() & (F.col("valor") != ""), leading_number("valor"))
    cat = F.when(js_trim("categoria") != "", js_trim("categoria"))
    r = s.select("cli_id", "line", nome.alias("nome"), cpf_d.alias("cpf"), valor.alias("valor"), cat.alias("categoria"))
    v = F.col("valor")
    reasons = F.filter(F.array(
        F.when(F.col("nome").isNull() | (F.length("nome") == 0), F.lit(M.SHEET_NAME_REQUIRED))
        .when(F.length("nome") > 255, F.lit(M.SHEET_NAME_TOO_LONG)),
        F.when(F.col("cpf").isNull() | (F.col("cpf") == ""), F.lit(M.SHEET_CPF_REQUIRED))
        .when(F.length("cpf") != 11, F.lit(M.SHEET_CPF_LENGTH)),
        F.when(v.isNull() | F.isnan(v) | (v <= 0), F.lit(M.SHEET_VALUE_POSITIVE))
        .when(v > 1000000, F.lit(M.SHEET_VALUE_MAX))), lambda x: x.isNotNull())
    return (r.withColumn("reasons", reasons)
            .withColumn("is_valid", F.size("reasons") == 0)
            .withColumn("categoria", F.when(F.col("is_valid"), F.coalesce("categoria", F.lit(NO_CATEGORY)))
                        .otherwise(F.col("categoria"))))


def validate_collaborator_sheet(m: Mart, as_of: str) -> DataFrame:
    """Per sheet line: CPF check digits, birth date (serial / dd/mm/yyyy /
    d/m/yy), not after ``as_of``, email pattern, sex M/F; normalized output."""
    s = m.collab_sheet
    nome = js_trim(F.coalesce("nome", F.lit("")))
    cpf_d = pad_cpf(digits(js_trim(F.coalesce("cpf", F.lit("")))))
    raw_birth = js_trim(F.coalesce("nascimento", F.lit("")))
    birth = parse_birth_date(raw_birth)
    sexo = F.upper(js_trim(F.coalesce("sexo", F.lit(""))))
    email = js_trim(F.coalesce("email", F.lit("")))
    phone = js_trim(F.coalesce("celular", F.lit("")))
    r = s.select("cli_id", "line", nome.alias("nome"), cpf_d.alias("cpf"), raw_birth.alias("raw_birth"),
                 birth.alias("birth_date"), sexo.alias("sexo"), email.alias("email_raw"), phone.alias("phone_raw"))
    reasons = F.filter(F.array(
        F.when(F.col("nome") == "", F.lit(M.SHEET_NAME_REQUIRED)),
        F.when(F.col("cpf") == "", F.lit(M.SHEET_CPF_REQUIRED))
        .when(~cpf_valid("cpf"), F.lit(M.CPF_CHECK_DIGITS)),
        F.when((F.col("raw_birth") != "")
               & (F.col("birth_date").isNull() | (F.col("birth_date") > F.to_date(F.lit(as_of)))),
               F.lit(M.BIRTH_DATE_INVALID)),
        F.when((F.col("email_raw") != "") & ~F.col("email_raw").rlike(EMAIL_PATTERN), F.lit(M.EMAIL_INVALID)),
        F.when((F.col("sexo") != "") & ~F.col("sexo").isin("M", "F"), F.lit(M.SEX_INVALID))),
        lambda x: x.isNotNull())
    return (r.withColumn("reasons", reasons)
            .select("cli_id", "line", F.upper("nome").alias("nome"), "cpf",
                    F.when(F.col("raw_birth") != "", F.col("birth_date")).alias("birth_date"),
                    F.when(F.col("sexo") != "", F.col("sexo")).alias("sex"),
                    F.lower("email_raw").alias("email"), digits("phone_raw").alias("phone"),
                    "reasons", (F.size("reasons") == 0).alias("is_valid")))


def bulk_import_collaborators(m: Mart, rows: DataFrame, ledger: str | None = None) -> DataFrame:
    """Per valid sheet row: 'existente' (CPF already in the tenant, or an
    earlier line of the same file) or 'criado' with a new id.

    The first line per (tenant, CPF) is found with an aggregate (min line),
    not a per-key window, so a CPF repeated on many lines is still a
    two-level aggregate.  New ids are MAX(usr_id)+1.. in (tenant, line)
    order via :func:`dense_ids`.
    """
    existing = (m.collaborator.select("cli_id", sql_digits("cpf").alias("cpf"), "usr_id")
                .groupBy("cli_id", "cpf").agg(F.min("usr_id").alias("existing_id")))
    first = rows.groupBy("cli_id", "cpf").agg(F.min("line").alias("first_line"))
    # the sheet is validated once: the id allocation and the result both read this checkpoint
    checkpoint_dir(rows.sparkSession)
    r = rows.join(existing, ["cli_id", "cpf"], "left").join(first, ["cli_id", "cpf"]).checkpoint(eager=True)
    fresh = r.filter(F.col("existing_id").isNull() & (F.col("line") == F.col("first_line")))
    current_max = m.collaborator.agg(F.coalesce(F.max("usr_id"), F.lit(0)).alias("m"))
    new_ids = dense_ids(fresh.select("cli_id", "cpf", "line"), ["cli_id", "line"], current_max, "new_id", stored=True,
                        ledger=ledger)
    return (r.join(new_ids.select("cli_id", "cpf", "new_id"), ["cli_id", "cpf"], "left")
            .select("cli_id", "line", "nome", "cpf",
                    F.when(F.col("existing_id").isNull() & (F.col("line") == F.col("first_line")), "criado")
                    .otherwise("existente").alias("status"),
                    F.coalesce("existing_id", "new_id").alias("usr_id")))


def cpf_validity(m: Mart) -> DataFrame:
    """Check-digit validity of every collaborator CPF."""
    return m.collaborator.select("cli_id", "usr_id", "cpf", cpf_valid("cpf").alias("cpf_valid"))


def cpf_quality(m: Mart) -> DataFrame:
    """Per tenant: collaborators and how many CPFs pass both check digits."""
    return (cpf_validity(m).groupBy("cli_id")
            .agg(F.count(F.lit(1)).alias("n"), F.count_if("cpf_valid").alias("n_valid")))


def link_categories(m: Mart, change: DataFrame) -> DataFrame:
    """Link table after replacing all links of the changed collaborators.

    Links of collaborators in ``change`` are dropped (anti join), the new
    pairs are added and duplicates removed (ON CONFLICT DO NOTHING).
    """
    kept = m.collab_category.join(change.select("usr_id").distinct(), "usr_id", "left_anti")
    return kept.unionByName(change.select("usr_id", "set_id")).dropDuplicates(["usr_id", "set_id"])


def orphan_categories(m: Mart, change: DataFrame) -> DataFrame:
    """Link count per category after E15; categories that lost a link and
    now have none are flagged for deletion."""
    new_links = link_categories(m, change)
    removed = (m.collab_category.join(change.select("usr_id").distinct(), "usr_id", "left_semi")
               .join(change.select("usr_id", "set_id"), ["usr_id", "set_id"], "left_anti")
               .select("set_id").distinct().withColumn("lost", F.lit(True)))
    counts = new_links.groupBy("set_id").agg(F.count(F.lit(1)).alias("n_links"))
    return (m.category.join(counts, "set_id", "left").join(removed, "set_id", "left")
            .select("set_id", "cli_id", "set_name", F.coalesce("n_links", F.lit(0)).alias("n_links"),
                    (F.coalesce("lost", F.lit(False)) & F.col("n_links").isNull()).alias("deleted")))


def collaborator_names_page(m: Mart, collation: str | None = "pt", limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of names per tenant in the order of a collation, with their places."""
    w = Window.partitionBy("cli_id").orderBy(text_order("usr_name", collation), "usr_name", "usr_id")
    return (m.collaborator_pt.select("cli_id", "usr_id", "usr_name").withColumn("pos", F.row_number().over(w).cast("long"))
            .filter((F.col("pos") > offset) & (F.col("pos") <= offset + limit)))


def create_with_categories(m: Mart, inserts: DataFrame, as_of: str, ledger: str | None = None) -> dict:
    """E10 + E15 as one job: collaborators as :func:`insert_collaborators` decides, linked to the categories given.

    ``inserts`` has a further column ``categorias`` (array of category ids, or null).  Returns the
    decisions and the link table after it: ids that are no category of the collaborator's tenant
    link to nothing, and a pair is linked once.  Rejected requests link nothing.
    """
    checkpoint_dir(inserts.sparkSession)
    decided = insert_collaborators(m, inserts, as_of, ledger).checkpoint(eager=True)
    asked = inserts.select("ord", F.explode("categorias").alias("set_id"))
    links = (decided.filter(F.col("status") == "criado").select("ord", "usr_id", "cli_id").join(asked, "ord")
             .join(m.category.select("set_id", "cli_id"), ["set_id", "cli_id"], "left_semi").select("usr_id", "set_id"))
    return {"decisions": decided, "collab_category": m.collab_category.select("usr_id", "set_id").unionByName(links)
            .dropDuplicates(["usr_id", "set_id"]), "links": links.distinct()}


def create_categories(m: Mart) -> DataFrame:
    """Category table after adding the sheet categories (upper-case names, B10 ids)."""
    from tipflow.operators.ids import new_category_ids
    return m.category.select("set_id", "set_name", "cli_id").unionByName(
        new_category_ids(m).select("set_id", "set_name", "cli_id"))


def delete_categories(m: Mart, deleted: DataFrame) -> dict:
    """Category and link tables after deleting categories (links cascade)."""
    gone = deleted.select("set_id").distinct()
    return {"category": m.category.join(gone, "set_id", "left_anti"),
            "collab_category": m.collab_category.join(gone, "set_id", "left_anti")}


INSERT_REASONS = (M.SHEET_NAME_REQUIRED, M.SHEET_CPF_REQUIRED, M.TENANT_REQUIRED, M.CPF_INVALID,
                  M.EMAIL_INVALID, M.BIRTH_DATE_INVALID, M.CPF_DUPLICATE)


def insert_collaborators(m: Mart, inserts: DataFrame, as_of: str, ledger: str | None = None) -> DataFrame:
    """E10 insert path: one decision per requested collaborator, in arrival order ``ord``.

    Checks in the reference's order (the first failing one is the reason):
    name, CPF present, tenant present, CPF check digits, e-mail pattern when
    given, birth date yyyy-mm-dd not after ``as_of`` when given.  A valid
    request whose digits-only CPF already exists in the tenant, or appeared
    in an earlier valid request of the same tenant, is rejected as a
    duplicate (first occurrence found with a MIN aggregate).  Accepted rows
    are normalized (name trimmed upper case, CPF digits padded to 11, e-mail
    trimmed lower case or NULL, phone digits, status 1, arrangement flags
    true/false) and get ids MAX(usr_id)+1.. in ``ord`` order.
    """
    cpf_d = pad_cpf(digits(F.coalesce("cpf", F.lit(""))))
    birth_txt = F.coalesce("nascimento", F.lit(""))
    birth = F.when(birth_txt.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(birth_txt, "yyyy-MM-dd"))
    email_t = js_trim(F.coalesce("email", F.lit("")))
    reason = (F.when(F.col("nome").isNull() | (F.length(js_trim("nome")) == 0), F.lit(INSERT_REASONS[0]))
              .when(F.col("cpf").isNull() | (F.length(js_trim("cpf")) == 0), F.lit(INSERT_REASONS[1]))
              .when(F.col("cli_id").isNull(), F.lit(INSERT_REASONS[2]))
              .when(~cpf_valid("cpf"), F.lit(INSERT_REASONS[3]))
              .when((F.length(email_t) > 0) & ~email_t.rlike(EMAIL_PATTERN), F.lit(INSERT_REASONS[4]))
              .when((F.length(js_trim(birth_txt)) > 0)
                    & (birth.isNull() | (birth > F.to_date(F.lit(as_of)))), F.lit(INSERT_REASONS[5])))
    req = inserts.select("ord", "cli_id", "nome", "cpf", "email", "celular", "nascimento", "sexo",
                         cpf_d.alias("cpf_digits"), reason.alias("reason"), birth.alias("birth_date"))
    existing = (m.collaborator.select("cli_id", sql_digits("cpf").alias("cpf_digits"))
                .distinct().withColumn("_exists", F.lit(True)))
    first = (req.filter(F.col("reason").isNull()).groupBy("cli_id", "cpf_digits")
             .agg(F.min("ord").alias("_first")))
    checked = (req.join(existing, ["cli_id", "cpf_digits"], "left").join(first, ["cli_id", "cpf_digits"], "left")
               .withColumn("reason", F.when(F.col("reason").isNull()
                                            & (F.coalesce("_exists", F.lit(False)) | (F.col("ord") != F.col("_first"))),
                                            F.lit(INSERT_REASONS[6])).otherwise(F.col("reason"))))
    ok = checked.filter(F.col("reason").isNull())
    current_max = m.collaborator.agg(F.coalesce(F.max("usr_id"), F.lit(0)).alias("m"))
    ids = dense_ids(ok.select("ord"), ["ord"], current_max, "usr_id", ledger=ledger)
    return (checked.join(ids, "ord", "left")
            .select("ord", "cli_id",
                    F.when(F.col("reason").isNull(), "criado").otherwise("rejeitado").alias("status"),
                    "reason", "usr_id",
                    F.upper(js_trim("nome")).alias("usr_name"), F.col("cpf_digits").alias("cpf"),
                    F.when(F.length(email_t) > 0, F.lower(email_t)).alias("email"),
                    F.when(F.col("celular").isNotNull() & (F.col("celular") != ""), digits("celular")).alias("phone"),
                    F.when(F.length(js_trim(birth_txt)) > 0, F.col("birth_date")).alias("birth_date"),
                    F.when(F.col("sexo") != "", F.col("sexo")).alias("sex"),
                    F.lit(1).alias("sit_id"), F.lit(True).alias("closed_arrangement"),
                    F.lit(False).alias("open_arrangement")))
