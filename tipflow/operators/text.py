"""Column jobs (H1-H5): masking, phone normalization, ASCII folding and display formats.

The reference runs these per value in JavaScript; here each is a column
expression applied to whole tables (no UDF), so they stay in whole-stage
codegen and scale with the table.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tipflow.functions.columns import c, digits
from tipflow.sources.mart import Mart

# Fixed values of the reference (SMS text normalization).
SINGLE_QUOTES = "\u2018\u2019"
DOUBLE_QUOTES = "\u201c\u201d"
ELLIPSIS = "\u2026"
NBSP = "\u00a0"


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str]:
    """One-to-one map applied by a single ``translate``.

    Every BMP character whose canonical decomposition (NFD) starts with a
    printable ASCII character maps to that character (built from the
    Unicode database by rule), the dash range maps to '-', curly quotes to
    straight ones.  Combining marks need no entry: the final printable-ASCII
    filter drops them, as it drops every other non-ASCII character.
    """
    src, dst = [], []
    for cp in range(0x80, 0x10000):
        ch = chr(cp)
        nfd = unicodedata.normalize("NFD", ch)
        if nfd == ch:
            continue
        base = nfd[0]
        if 0x20 <= ord(base) <= 0x7E:
            src.append(ch)
            dst.append(base)
    for cp in range(0x2010, 0x2016):
        src.append(chr(cp))
        dst.append("-")
    src.append(SINGLE_QUOTES + DOUBLE_QUOTES)
    dst.append("''\"\"")
    return "".join(src), "".join(dst)


def ascii_fold(col) -> Column:
    """H3: NFD + strip accents, dashes -> '-', curly quotes -> straight,
    ellipsis -> '...', then drop everything outside printable ASCII.

    One ``translate`` (accents, dashes, quotes), one ``replace`` (ellipsis)
    and one ``regexp_replace`` (the final filter) per text.
    """
    src, dst = _fold_table()
    x = F.translate(c(col), src, dst)
    x = F.replace(x, F.lit(ELLIPSIS), F.lit("..."))
    return F.regexp_replace(x, r"[^\x20-\x7E]", "")


def mask_email(col) -> Column:
    """H1: first letter + stars (at least one) + '@' + domain; no domain -> NULL."""
    parts = F.split(c(col), "@")
    user = F.try_element_at(parts, F.lit(1))
    domain = F.try_element_at(parts, F.lit(2))
    masked = F.concat(F.substring(user, 1, 1), F.repeat(F.lit("*"), F.greatest(F.lit(1), F.length(user) - 1)),
                      F.lit("@"), domain)
    return F.when(c(col).isNotNull() & domain.isNotNull() & (domain != ""), masked)


def mask_phone(col) -> Column:
    """H1: stars + last four digits; fewer than four digits -> NULL."""
    d = digits(col)
    return F.when(F.length(d) >= 4,
                  F.concat(F.repeat(F.lit("*"), F.greatest(F.lit(1), F.length(d) - 4)), F.substring(d, -4, 4)))


def phone_e164(col):
    """H2: digits; 12-13 kept, 10-11 get '55'; the result must have 13 digits.

    Returns (number, reason) with reason NULL when valid.
    """
    d = digits(col)
    n = F.length(d)
    num = F.when(n.isin(12, 13), d).when(n.isin(10, 11), F.concat(F.lit("55"), d))
    reason = (F.when(num.isNull(), F.lit("invalid_length"))
              .when(F.length(num) != 13, F.lit("not_mobile")))
    return F.when(reason.isNull(), num), reason


def format_cpf(col) -> Column:
    d = digits(col)
    return F.when(F.length(d) == 11, F.regexp_replace(d, r"^(\d{3})(\d{3})(\d{3})(\d{2})$", "$1.$2.$3-$4")).otherwise(c(col))


def format_cnpj(col) -> Column:
    d = digits(col)
    return F.when(F.length(d) == 14,
                  F.regexp_replace(d, r"^(\d{2})(\d{3})(\d{3})(\d{4})(\d{2})$", "$1.$2.$3/$4-$5")).otherwise(c(col))


def format_phone(col) -> Column:
    d = digits(col)
    return (F.when(F.length(d) == 11, F.regexp_replace(d, r"^(\d{2})(\d)(\d{4})(\d{4})$", "($1) $2 $3-$4"))
            .when(F.length(d) == 10, F.regexp_replace(d, r"^(\d{2})(\d{4})(\d{4})$", "($1) $2-$3"))
            .otherwise(c(col)))


def format_brl(col) -> Column:
    """H5: pt-BR currency text, e.g. 'R$ 1.234,56' ('-R$ ...' when negative)."""
    x = c(col)
    num = F.translate(F.format_number(F.abs(x), 2), ",.", ".,")
    return F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), F.lit("R$" + NBSP), num)


def initials(col) -> Column:
    """H5: first letters of the first two space-separated words, upper case ('U' when NULL)."""
    words = F.slice(F.split(c(col), " "), 1, 2)
    return F.when(c(col).isNull() | (c(col) == ""), F.lit("U")).otherwise(
        F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")))


def pii_mask(m: Mart) -> DataFrame:
    """H1 over the collaborator table."""
    return m.collaborator.select("usr_id", mask_email("email").alias("email_masked"),
                                 mask_phone("phone").alias("phone_masked"))


def phone_normalize(m: Mart) -> DataFrame:
    """H2 over the phones of a collaborator sheet."""
    num, reason = phone_e164("celular")
    return m.collab_sheet.select("cli_id", "line", "celular", num.alias("phone"), reason.alias("reason"))


def fold_documents(m: Mart) -> DataFrame:
    """H3 over the whole text of every document."""
    return m.driver("documents").select("doc_id", ascii_fold("text").alias("text_ascii"))


def format_ids(m: Mart) -> DataFrame:
    """H4: CPF, phone and the tenant CNPJ as displayed in exports."""
    t = m.tenant.select("cli_id", "cnpj")
    return m.collaborator.join(t, "cli_id").select(
        "usr_id", "cli_id", format_cpf("cpf").alias("cpf_fmt"), format_phone("phone").alias("phone_fmt"),
        format_cnpj("cnpj").alias("cnpj_fmt"))


def format_money_date(m: Mart) -> DataFrame:
    """H5: money, date and date-time texts and name initials for every credit line."""
    u = m.collaborator.select("usr_id", "usr_name")
    b = m.batch.select("batch_id", "imported_at")
    return (m.credit.select("batch_id", "usr_id", "credit_value", "credit_date")
            .join(u, "usr_id").join(b, "batch_id")
            .select("batch_id", "usr_id", format_brl("credit_value").alias("value_brl"),
                    F.date_format("credit_date", "dd/MM/yyyy").alias("credit_date_br"),
                    F.date_format("imported_at", "dd/MM/yyyy HH:mm").alias("imported_at_br"),
                    initials("usr_name").alias("initials")))
