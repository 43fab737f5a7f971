"""Registered column jobs (H1-H5) with DuckDB oracle SQL."""

from __future__ import annotations

from tipflow.operators import text as t
from tipflow.plans.registry import register

D = "regexp_replace({x}, '[^0-9]', '', 'g')"


@register("pii_mask", ["collaborator"], f"""
SELECT usr_id,
       CASE WHEN email IS NOT NULL AND string_split(email, '@')[2] IS NOT NULL AND string_split(email, '@')[2] <> ''
            THEN substr(string_split(email, '@')[1], 1, 1)
                 || repeat('*', greatest(1, length(string_split(email, '@')[1]) - 1))
                 || '@' || string_split(email, '@')[2] END AS email_masked,
       CASE WHEN length({D.format(x='phone')}) >= 4
            THEN repeat('*', greatest(1, length({D.format(x='phone')}) - 4)) || right({D.format(x='phone')}, 4)
       END AS phone_masked
FROM collaborator""")
def pii_mask(m):
    """H1: masked e-mail and phone of every collaborator."""
    return t.pii_mask(m)


@register("phone_normalize", ["collab_sheet"], f"""
SELECT cli_id, line, celular, CASE WHEN reason IS NULL THEN num END AS phone, reason FROM (
  SELECT *, CASE WHEN num IS NULL THEN 'invalid_length' WHEN length(num) <> 13 THEN 'not_mobile' END AS reason FROM (
    SELECT cli_id, line, celular,
           CASE WHEN length({D.format(x='celular')}) IN (12, 13) THEN {D.format(x='celular')}
                WHEN length({D.format(x='celular')}) IN (10, 11) THEN '55' || {D.format(x='celular')} END AS num
    FROM collab_sheet) a) b""")
def phone_normalize(m):
    """H2: sheet phones normalized to 13-digit mobile numbers with a reject reason."""
    return t.phone_normalize(m)


@register("ascii_fold", [], """
SELECT doc_id,
       regexp_replace(replace(translate(regexp_replace(strip_accents(text), '[‐-―]', '-', 'g'),
                                        '‘’“”', '''''""'), '…', '...'),
                      '[^\\x20-\\x7E]', '', 'g') AS text_ascii
FROM documents""")
def ascii_fold(m):
    """H3: whole document texts folded to printable ASCII."""
    return t.fold_documents(m)


@register("format_ids", ["collaborator", "tenant"], f"""
SELECT u.usr_id, u.cli_id,
       CASE WHEN length({D.format(x='u.cpf')}) = 11
            THEN regexp_replace({D.format(x='u.cpf')}, '^(\\d{{3}})(\\d{{3}})(\\d{{3}})(\\d{{2}})$', '\\1.\\2.\\3-\\4')
            ELSE u.cpf END AS cpf_fmt,
       CASE WHEN length({D.format(x='u.phone')}) = 11
            THEN regexp_replace({D.format(x='u.phone')}, '^(\\d{{2}})(\\d)(\\d{{4}})(\\d{{4}})$', '(\\1) \\2 \\3-\\4')
            WHEN length({D.format(x='u.phone')}) = 10
            THEN regexp_replace({D.format(x='u.phone')}, '^(\\d{{2}})(\\d{{4}})(\\d{{4}})$', '(\\1) \\2-\\3')
            ELSE u.phone END AS phone_fmt,
       CASE WHEN length({D.format(x='t.cnpj')}) = 14
            THEN regexp_replace({D.format(x='t.cnpj')}, '^(\\d{{2}})(\\d{{3}})(\\d{{3}})(\\d{{4}})(\\d{{2}})$', '\\1.\\2.\\3/\\4-\\5')
            ELSE t.cnpj END AS cnpj_fmt
FROM collaborator u JOIN tenant t ON t.cli_id = u.cli_id""")
def format_ids(m):
    """H4: display formats of CPF, phone and CNPJ."""
    return t.format_ids(m)


@register("format_money_date", ["credit", "collaborator", "batch"], """
SELECT c.batch_id, c.usr_id,
       CASE WHEN c.credit_value < 0 THEN '-' ELSE '' END || 'R$' || chr(160)
         || translate(format('{:,.2f}', abs(c.credit_value)), ',.', '.,') AS value_brl,
       strftime(c.credit_date, '%d/%m/%Y') AS credit_date_br,
       strftime(b.imported_at, '%d/%m/%Y %H:%M') AS imported_at_br,
       CASE WHEN u.usr_name IS NULL OR u.usr_name = '' THEN 'U'
            ELSE upper(coalesce(substr(string_split(u.usr_name, ' ')[1], 1, 1), '')
                       || coalesce(substr(string_split(u.usr_name, ' ')[2], 1, 1), ''))
       END AS initials
FROM credit c JOIN collaborator u ON u.usr_id = c.usr_id JOIN batch b ON b.batch_id = c.batch_id""")
def format_money_date(m):
    """H5: BRL money, dates, date-times and initials of every credit line."""
    return t.format_money_date(m)
