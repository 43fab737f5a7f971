"""Pure Column helpers: every rule here is a JVM-side expression (no UDF).

Most stay inside whole-stage codegen; rules that bind a value with :func:`let` are
evaluated outside it (higher-order functions have no generated code)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the reference (report status rules and labels, month names).
PAID_STATUSES = ["paid", "settled"]
CANCELLED_STATUSES = ["canceled", "cancelled"]
PENDING_STATUSES = ["waiting", "active", "pending"]
STATUS_LABEL = {
    "pago": "Pago",
    "cancelado": "Cancelada",
    "erro": "Erro no boleto",
    "vencido": "Vencido",
    "pendente": "Aguardando pagamento",
}
MONTH_NAMES_PT = ["janeiro", "fevereiro", "março", "abril", "maio", "junho",
                  "julho", "agosto", "setembro", "outubro", "novembro", "dezembro"]
NO_CATEGORY = "Sem categoria"
NO_CHARGE = "Sem boleto"
MONEY = "decimal(18,2)"
MONEY_SUM = "decimal(38,2)"


def pct() -> Column:
    """1% as an exact decimal; a Python float literal would turn decimal math into double."""
    return F.lit(Decimal("0.01")).cast("decimal(3,2)")


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def in_period(col, start: str, end: str, bound: str = "closed", kind: str = "date") -> Column:
    """Date-range predicate in the three forms the reference writes.

    ``closed``: BETWEEN start AND end (a timestamp column is compared with
    midnight of ``end``); ``next_midnight``: start <= x <= end + 1 day;
    ``half_open``: start <= x < end + 1 day.  Bounds are literals of the
    column's own type so the comparison can be pushed into the scan.
    """
    x = c(col)
    lo = F.to_date(F.lit(start))
    hi = F.to_date(F.lit(end))
    if bound != "closed":
        hi = F.date_add(hi, 1)
    if kind == "timestamp":
        lo, hi = lo.cast("timestamp"), hi.cast("timestamp")
    if bound == "half_open":
        return (x >= lo) & (x < hi)
    return (x >= lo) & (x <= hi)


def distinct_from(col, value) -> Column:
    """``x IS DISTINCT FROM value`` (NULL-safe inequality)."""
    return ~c(col).eqNullSafe(F.lit(value))


def lower_in(col, values) -> Column:
    return F.lower(c(col)).isin(list(values))


def batch_status(charge_status, batch_status_col) -> Column:
    """Consolidated report status (C2): a paid charge wins over a cancelled batch."""
    bs = F.lower(F.coalesce(c(charge_status), F.lit("")))
    rs = c(batch_status_col)
    return (F.when(bs.isin(PAID_STATUSES), "pago")
            .when(rs == "C", "cancelado")
            .when(rs == "E", "erro")
            .when(bs.isin(CANCELLED_STATUSES), "cancelado")
            .when(bs == "expired", "vencido")
            .otherwise("pendente"))


def status_label(status) -> Column:
    m = F.create_map(*[F.lit(x) for kv in STATUS_LABEL.items() for x in kv])
    return m[c(status)]


def list_status(charge_status, batch_status_col, has_invoice) -> Column:
    """Recharge-list category (D7): expired and 'no invoice' fold into cancelled, 'E' ignored."""
    bs = F.lower(F.coalesce(c(charge_status), F.lit("")))
    return (F.when(bs.isin(PAID_STATUSES), "pago")
            .when(c(batch_status_col) == "C", "cancelado")
            .when(bs.isin(CANCELLED_STATUSES + ["expired"]), "cancelado")
            .when(bs.isin(PENDING_STATUSES), "pendente")
            .when(~c(has_invoice), "cancelado")
            .otherwise("pendente"))


def badge_status(charge_status, batch_status_col, has_invoice) -> Column:
    """Detail badge (D7): paid, then the batch's own status, then an expired or open charge.

    Any other charge status (a cancelled one too) reads as waiting while there is an invoice,
    and 'Sem boleto' without one.
    """
    cs = F.lower(F.coalesce(c(charge_status), F.lit("")))
    rs = c(batch_status_col)
    waiting = cs.isin(PENDING_STATUSES) | c(has_invoice)
    return (F.when(cs.isin(PAID_STATUSES), STATUS_LABEL["pago"]).when(rs == "C", STATUS_LABEL["cancelado"])
            .when(rs == "E", STATUS_LABEL["erro"]).when(cs == "expired", STATUS_LABEL["vencido"])
            .when(waiting, STATUS_LABEL["pendente"]).otherwise(NO_CHARGE))


# JS trim(): white space of every kind, line breaks, no-break spaces and the byte order mark
_JS_SPACE = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]+"


def js_trim(col) -> Column:
    """``trim()`` as JavaScript does it, not only spaces."""
    return F.regexp_replace(c(col), f"^{_JS_SPACE}|{_JS_SPACE}$", "")


def text_order(col, collation: str | None = None) -> Column:
    """Sort key of a text: binary without a collation, else as the named one orders it (``pt``: Portuguese,
    accents and case after the letters, as the reference's database sorts its lists)."""
    return c(col) if collation is None else F.collate(c(col), collation)


def digits(col) -> Column:
    """Digits only (JS ``replace(/\\D/g, '')``)."""
    return F.regexp_replace(c(col), r"[^0-9]", "")


def sql_digits(col) -> Column:
    """Digits the way the SQL does it: only '.' and '-' removed."""
    return F.replace(F.replace(c(col), F.lit("."), F.lit("")), F.lit("-"), F.lit(""))


def let(value, fn) -> Column:
    """Evaluate ``value`` once and hand it to ``fn`` as a lambda variable.

    Long rule expressions reference their input many times; when Catalyst
    pushes a filter through the projection that computed the input, the
    input expression would be copied into every reference.  Binding it to a
    lambda variable keeps it a single evaluation.
    """
    return F.element_at(F.transform(F.array(value), fn), 1)


def pad_cpf(col) -> Column:
    """``padStart(11, '0')`` on a non-empty digit string; never shortens."""
    return let(c(col), lambda d: F.when((F.length(d) > 0) & (F.length(d) < 11), F.lpad(d, 11, "0")).otherwise(d))


def _cpf_check(s) -> Column:
    dig = [F.substring(s, i + 1, 1).try_cast("int") for i in range(11)]
    s1 = sum(dig[i] * (10 - i) for i in range(9))
    s2 = sum(dig[i] * (11 - i) for i in range(10))
    r1 = (s1 * 10) % 11
    r2 = (s2 * 10) % 11
    r1 = F.when(r1 == 10, 0).otherwise(r1)
    r2 = F.when(r2 == 10, 0).otherwise(r2)
    return F.coalesce(
        (F.length(s) == 11) & s.rlike(r"^[0-9]{11}$") & (s != F.repeat(F.substring(s, 1, 1), 11))
        & (r1 == dig[9]) & (r2 == dig[10]), F.lit(False))


def cpf_valid(col) -> Column:
    """Two mod-11 check digits over a CPF given with or without mask.

    All-equal digit strings are rejected.  Pure column arithmetic over the
    padded digits, which are computed once (see :func:`let`).
    """
    return F.coalesce(let(pad_cpf(digits(col)), _cpf_check), F.lit(False))


NUMBER_PREFIX = r"^([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)"


def leading_number(col) -> Column:
    """``parseFloat``: the leading decimal number of a text, else NULL."""
    m = F.regexp_extract(js_trim(col), NUMBER_PREFIX, 1)
    return F.when(m == "", F.lit(None)).otherwise(m).cast("double")


def fee_split(gross, rate, fee_type):
    """Service fee and the three invoice values (D4), all decimal(18,2).

    service = round(gross * rate / 100, 2) HALF_UP; type 'A' adds the fee to
    the charge, any other type takes it from the amount distributed.
    """
    g = c(gross).cast("decimal(20,2)")
    r = F.coalesce(c(rate), F.lit(0).cast("decimal(9,4)"))
    service = F.round(g * r * pct(), 2).cast(MONEY)
    is_a = c(fee_type) == "A"
    charge = F.when(is_a, g + service).otherwise(g).cast(MONEY)
    movement = F.when(is_a, g).otherwise(g - service).cast(MONEY)
    return service, charge, movement


def div_round2(p, q) -> Column:
    """round(p / q, 2) HALF_UP without intermediate rounding.

    Decimal division keeps a limited scale (6 digits once precision runs
    out), so rounding that quotient again to cents can round twice.  Here
    both sides are scaled to integers (``p`` has at most 4 decimals, ``q`` at
    most 2; both >= 0, q > 0) and the half-up cent count is an exact integer
    division.
    """
    a = (c(p) * 10000).cast("decimal(38,0)")
    b = (c(q) * 100).cast("decimal(38,0)")
    cents = F.call_function("div", a * 2 + b, b * 2)
    return (cents.cast("decimal(20,0)") * F.lit(Decimal("0.01"))).cast(MONEY)


def cents(col) -> Column:
    """A money value as a whole number of cents."""
    return (c(col) * 100).cast("long")


def share_cents(x, y, q) -> Column:
    """round(x * y / q, 2) HALF_UP in cents, of whole numbers of cents (>= 0, q > 0).

    In 64-bit arithmetic where the product surely fits, else in exact decimals.
    """
    x, y, q = c(x), c(y), c(q)
    small = (x < 10 ** 8) & (y < 10 ** 10) & (q < 10 ** 18)
    wide = [v.cast("decimal(20,0)") for v in (x, y, q)]
    a, b = (wide[0] * wide[1]).cast("decimal(38,0)"), wide[2].cast("decimal(38,0)")
    return F.when(small, F.call_function("div", x * y * 2 + q, q * 2)).otherwise(
        F.call_function("div", a * 2 + b, b * 2).cast("long"))


def money_of(cents_col) -> Column:
    """Cents as money."""
    return (c(cents_col).cast("decimal(20,0)") * F.lit(Decimal("0.01"))).cast(MONEY)


def fee_type_default(col) -> Column:
    """COALESCE(NULLIF(type, ''), 'D')."""
    return F.coalesce(F.nullif(c(col), F.lit("")), F.lit("D"))


def month_label_pt(col) -> Column:
    names = F.array(*[F.lit(n) for n in MONTH_NAMES_PT])
    return F.concat(F.element_at(names, F.month(c(col))), F.lit(" de "), F.year(c(col)).cast("string"))


# Fixed value of the reference: accepted e-mail form.
EMAIL_PATTERN = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"


def parse_birth_date(col) -> Column:
    """Sheet birth date: Excel serial number, dd/mm/yyyy, d/m/yy[yy] or yyyy-mm-dd.

    Two-digit years above 50 are 19xx, else 20xx.  The normalized text must
    read yyyy-mm-dd and be a real calendar date, otherwise NULL.
    """
    def parse(t):
        parts = F.split(t, "/")
        d = F.lpad(F.try_element_at(parts, F.lit(1)), 2, "0")
        mth = F.lpad(F.try_element_at(parts, F.lit(2)), 2, "0")
        y = F.try_element_at(parts, F.lit(3))
        y = F.when(F.length(y) == 2,
                   F.concat(F.when(y.try_cast("int") > 50, F.lit("19")).otherwise(F.lit("20")), y)).otherwise(y)
        slashed = t.rlike(r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$") | t.rlike(r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}$")
        text = F.when(slashed, F.concat_ws("-", y, mth, d)).otherwise(t)
        serial = F.date_add(F.to_date(F.lit("1899-12-30")), t.try_cast("int"))
        return (F.when(t.rlike(r"^[0-9]+$"), serial)
                .when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(text, "yyyy-MM-dd")))

    return let(js_trim(col), parse)
