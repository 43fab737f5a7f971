"""Invariants of the table-changing jobs and the id allocator."""

import datetime as dt
from collections import Counter
from decimal import Decimal
from types import SimpleNamespace

from pyspark.sql import functions as F

from tipflow.operators import access
from tipflow.operators import changes as ch
from tipflow.operators import ids, people, topups
from tipflow.plans.registry import AS_OF
from tipflow.sources.mart import mart

from .conftest import SF_SMALL


def test_dense_ids_are_dense_and_ordered(spark):
    df = spark.range(0, 2000).select((F.col("id") * 7 % 2000).alias("k"), F.lit("x").alias("v"))
    base = spark.createDataFrame([(100,)], "m long")
    for one_task in (10_000, 250):  # in one window, and in eight ranges
        out = ids.dense_ids(df, ["k"], base, "new_id", one_task=one_task).orderBy("k").collect()
        assert [(r.k, r.new_id) for r in out] == [(k, 101 + k) for k in range(2000)]
    pairs = sorted((r.k, r.new_id) for r in out)
    assert [p[1] for p in pairs] == list(range(101, 2101))


def test_settlement_is_idempotent(spark):
    m = mart(spark, SF_SMALL)
    first = ch.settle_paid_invoices(m)
    assert first["movements"].select("not_id").distinct().count() == first["fires"].count()
    once = ch.settle_paid_invoices(m, once=True)["movements"]
    assert once.count() == first["fires"].count() <= first["movements"].count()
    # with the new invoice state, the same feed has no record left to apply
    again_inv = first["invoice"].cache()
    recs = (m.status_feed.join(again_inv.select("not_id", "status_updated_at"), "not_id")
            .filter(F.col("status_updated_at").isNull() | (F.col("changed_at") > F.col("status_updated_at"))))
    assert recs.count() == 0
    bt = again_inv.join(first["fires"], "not_id").filter(
        (F.col("situation") != "BT") | F.col("paid_value").isNull() | F.col("settled_on").isNull())
    assert bt.count() == 0


def test_settlement_releases_credits_and_reopens(spark):
    m = mart(spark, SF_SMALL)
    out = ch.settle_paid_invoices(m)
    fired = out["fires"].select("not_id")
    assert out["credit"].join(fired, "not_id").filter(F.col("sit_id") != 1).count() == 0
    reopened = m.credit.join(fired, "not_id").select("batch_id").distinct()
    assert out["batch"].join(reopened, "batch_id").filter(F.col("batch_status") == "C").count() == 0
    assert out["credit"].count() == m.credit.count() and out["batch"].count() == m.batch.count()


def test_credit_sheet_split_is_complete(spark):
    m = mart(spark, SF_SMALL)
    v = people.validate_credit_sheet(m)
    valid = v.filter("is_valid").count()
    errors = v.filter(~F.col("is_valid")).count()
    assert valid + errors == m.credit_sheet.count()
    assert v.filter("is_valid").filter(F.length("cpf") != 11).count() == 0


def test_backfill_pairs_one_to_one(spark):
    m = mart(spark, SF_SMALL)
    p = ch.backfill_pairs(m, "year")
    assert p.count() == p.select("batch_id").distinct().count() == p.select("not_id").distinct().count()
    applied = ch.backfill_apply(m, p)
    assert applied.count() == m.credit.count()
    before = ch.credits_without_invoice(m.credit).agg(F.sum("n_credits")).first()[0] or 0
    after = ch.credits_without_invoice(applied).agg(F.sum("n_credits")).first()[0] or 0
    moved = p.agg(F.sum("n_credits")).first()[0] or 0
    assert before - after == moved


def test_cancel_batches_outcomes(spark):
    m = mart(spark, SF_SMALL)
    out = topups.cancel_batches(m, m.cancel_request, AS_OF)
    d = out["decisions"]
    assert d.count() == m.cancel_request.count()
    ok = d.filter(F.col("outcome") == "cancelled").select("batch_id")
    assert out["batch"].join(ok, "batch_id").filter(F.col("batch_status") != "C").count() == 0
    assert out["credit"].join(ok, "batch_id").filter(F.col("sit_id") != 3).count() == 0
    assert d.filter((F.col("outcome") == "cancelled") & F.col("hub_status").isin("paid", "settled")).count() == 0


def test_bulk_import_first_line_creates(spark):
    rows = spark.createDataFrame(
        [(0, 2, "A", "52998224725"), (0, 3, "A2", "52998224725"), (0, 4, "B", "11144477735"),
         (1, 2, "C", "52998224725")], "cli_id long, line long, nome string, cpf string")
    m = mart(spark, SF_SMALL)
    got = {(r.cli_id, r.line): (r.status, r.usr_id) for r in people.bulk_import_collaborators(m, rows).collect()}
    assert got[(0, 2)][0] == "criado" and got[(0, 3)] == ("existente", got[(0, 2)][1])
    assert got[(0, 4)][0] == "criado" and got[(1, 2)][0] == "criado"
    new_ids = sorted(v[1] for v in got.values() if v[0] == "criado")
    top = m.collaborator.agg(F.max("usr_id")).first()[0]
    assert new_ids == [top + 1, top + 2, top + 3]


def test_lower_limit_only_when_lowered(spark):
    m = mart(spark, SF_SMALL)
    changes = spark.createDataFrame([(0, "100.00", "50.00"), (1, "100.00", "150.00"), (2, None, "10.00")],
                                    "cli_id long, old_limit string, new_limit string").select(
        "cli_id", F.col("old_limit").cast("decimal(18,2)").alias("old_limit"),
        F.col("new_limit").cast("decimal(18,2)").alias("new_limit"))
    out = ch.lower_pix_limit(m, changes)
    assert out.filter(F.col("cli_id") != 0).count() == 0
    assert out.filter((F.col("day_value") > 50) | (F.col("night_value") > 50)).count() == 0


def test_number_within_hot_group(spark):
    # one group holds most rows: it must be numbered 1..n without gaps, like row_number()
    df = spark.range(0, 5000).select(F.when(F.col("id") % 10 < 8, F.lit(0)).otherwise(F.col("id") % 7).alias("g"),
                                     (F.col("id") * 13 % 5000).alias("k"))
    from pyspark.sql import Window
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("k"))).select("g", "k", "rn").collect()
    for one_task in (10_000, 500, 60):
        got = ids.number_within(df, ["g"], ["k"], "rn", one_task=one_task)
        assert sorted(got.collect()) == sorted(want)
    # null groups, and a larger table that is cheaper to count
    nulls = df.withColumn("g", F.when(F.col("g") != 0, F.col("g")))
    got = ids.number_within(nulls, ["g"], ["k"], "rn", sizes=nulls.select("g").unionAll(nulls.select("g")), one_task=500)
    assert sorted((r.g or 0, r.k, r.rn) for r in got.collect()) == sorted(tuple(r) for r in want)


def test_large_groups_are_numbered_without_a_second_shuffle(spark):
    df = spark.range(0, 5000).select((F.col("id") % 3).alias("g"), F.col("id").alias("k"))
    got = ids.number_within(df, ["g"], ["k"], "rn", one_task=100)
    plan = got._jdf.queryExecution().executedPlan().toString()
    # what is shuffled after the checkpoint: the small groups (none here) and the runs, one row each
    assert plan.count("BroadcastHashJoin") >= 2 and "SortMergeJoin" not in plan


def test_parallel_runs_reserve_disjoint_ranges(spark, scratch):
    """Two runs that read the same maximum: each range is dense, none overlaps, whoever commits first."""
    import threading
    base = spark.createDataFrame([(100,)], "m long")
    got: dict = {}

    def run(name, n):
        df = spark.range(n).select(F.col("id").alias("k"))
        got[name] = sorted(r.new_id for r in ids.dense_ids(df, ["k"], base, "new_id", ledger=f"{scratch}/ids").collect())

    threads = [threading.Thread(target=run, args=(f"run{i}", 50 + i)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(x for ids_ in got.values() for x in ids_) == list(range(101, 101 + 206))
    for ids_ in got.values():
        assert ids_ == list(range(ids_[0], ids_[0] + len(ids_)))
    # a writer that was overtaken between reading and committing starts anew
    from tipflow.sources.commits import Log
    log = Log(spark, f"{scratch}/other", lambda state, r: r)
    version, _ = log.state()
    assert log.append(version + 1, {"last": 10}) and not log.append(version + 1, {"last": 20})
    assert ids.reserve(spark, scratch, "other", 5, 3) == 10 and ids.reserve(spark, scratch, "other", 5, 40) == 40


def test_category_names_with_odd_white_space(spark):
    """A name with a tab or a no-break space around it is the category without them."""
    class Small:
        category = spark.createDataFrame([(7, 1, "BAR")], "set_id long, cli_id long, set_name string")
        credit_sheet = spark.createDataFrame(
            [(1, "\tBar\u00a0"), (1, "\u2003sala"), (1, "Sala\n"), (1, "\u00a0"), (2, "bar"), (1, None)], "cli_id long, categoria string")

    got = ids.new_category_ids(Small).orderBy("set_id").collect()
    assert [tuple(r) for r in got] == [(1, "SALA", 8), (2, "BAR", 9)]


def test_insert_collaborators_rules(spark):
    m = mart(spark, SF_SMALL)
    existing = m.collaborator.filter(F.col("cli_id") == 0).select("cpf").first().cpf
    rows = [
        (1, 0, " ana ", "529.982.247-25", " Ana@X.com ", "(11) 98765-4321", "1990-01-05", "F"),   # created
        (2, 0, "bia", "52998224725", None, None, None, None),                                     # same CPF later
        (3, 0, "  ", "52998224725", None, None, None, None),                                       # name first
        (4, 0, "caio", "52998224724", None, None, None, None),                                     # check digit
        (5, 0, "dani", "111.444.777-35", "bad", None, None, None),                                 # e-mail
        (6, 0, "edu", "111.444.777-35", None, None, "2999-01-01", None),                           # future birth
        (7, 1, "fabi", "529.982.247-25", None, None, None, None),                                  # other tenant: ok
        (8, 0, "gil", existing, None, None, None, None),                                           # already in tenant
    ]
    df = spark.createDataFrame(rows, "ord long, cli_id long, nome string, cpf string, email string, "
                                     "celular string, nascimento string, sexo string")
    got = {r.ord: r for r in people.insert_collaborators(m, df, AS_OF).collect()}
    assert got[1].status == "criado" and got[1].usr_name == "ANA" and got[1].email == "ana@x.com"
    assert got[1].cpf == "52998224725" and got[1].phone == "11987654321"
    assert got[2].reason == "CPF já cadastrado para este cliente"
    assert got[3].reason == "Nome é obrigatório"
    assert got[4].reason == "CPF inválido"
    assert got[5].reason == "Email inválido"
    assert got[6].reason == "Data de nascimento inválida ou no futuro"
    assert got[7].status == "criado"
    if people.cpf_validity(m).filter(F.col("cpf") == existing).first().cpf_valid:
        assert got[8].reason == "CPF já cadastrado para este cliente"
    top = m.collaborator.agg(F.max("usr_id")).first()[0]
    assert (got[1].usr_id, got[7].usr_id) == (top + 1, top + 2)


def test_statement_total_is_the_batch_total(spark):
    """Three lines of 10.00 at a net of 29.90: the lines round to 9.97, the totals line keeps 29.90."""
    from types import SimpleNamespace

    from tipflow.operators.reports import batch_statement
    credit = spark.createDataFrame([(1, u, 10, 5, 900, Decimal("10.00"), dt.date(2024, 1, 1)) for u in (1, 2, 3)],
                                   "cre_id long, usr_id long, cli_id long, batch_id long, not_id long, "
                                   "credit_value decimal(18,2), credit_date date")
    people_ = spark.createDataFrame([(1, "A", "52998224725"), (2, "B", None), (3, "C", "")],
                                    "usr_id long, usr_name string, cpf string")
    invoice = spark.createDataFrame([(900, Decimal("30.00"), Decimal("0.10"), Decimal("29.90"))],
                                    "not_id long, invoice_value decimal(18,2), service_value decimal(18,2), "
                                    "movement_value decimal(18,2)")
    tenant = spark.createDataFrame([(10, Decimal("1.0000"), "D")], "cli_id long, fee_rate decimal(9,4), fee_type string")
    m = SimpleNamespace(credit=credit, collaborator=people_, invoice=invoice, tenant=tenant)
    got = {r.usr_name: (r.cpf, r.gross, r.discount, r.net) for r in batch_statement(m).collect()}
    d = Decimal
    assert got == {"A": ("529.982.247-25", d("10.00"), d("0.03"), d("9.97")), "B": ("-", d("10.00"), d("0.03"), d("9.97")),
                   "C": ("-", d("10.00"), d("0.03"), d("9.97")), "TOTAL": (None, d("30.00"), d("0.10"), d("29.90"))}


def test_long_requests_keep_every_line(spark):
    """No line limit unless it is asked for."""
    from types import SimpleNamespace

    from tipflow.operators.topups import validate_credit_request
    lines = spark.range(1, 20_001).select(
        F.lit(1).cast("long").alias("request_id"), F.lit(1).cast("long").alias("cli_id"), F.col("id").alias("line_no"),
        F.col("id").alias("ref_id"), F.lit(None).cast("string").alias("cpf"), F.lit("x").alias("nome"),
        F.lit("1.00").alias("valor"), F.lit("  t \t").alias("titulo"), F.lit(None).cast("string").alias("data"))
    m = SimpleNamespace(credit_request=lines)
    r = validate_credit_request(m).first()
    assert (r.is_valid, r.n_lines, r.titulo) == (True, 20_000, "t")
    r = validate_credit_request(m, max_lines=5000).first()
    assert not r.is_valid and r.error == "Máximo 5000 colaboradores permitidos"


def test_collaborator_update_writes_every_field(spark):
    """Missing fields are cleared, a new tenant moves the row, a failed check writes nothing."""
    from types import SimpleNamespace
    cols = "usr_id long, cli_id long, usr_name string, cpf string, email string, phone string, birth_date date, sex string, sit_id int"
    old = [(i, 1, "OLD", "1", "o@x.yz", "11", dt.date(1980, 1, 1), "M", 1) for i in range(1, 7)]
    new = "usr_id long, cli_id long, op string, new_sit_id int, new_name string, new_cpf string, new_email string, " \
          "new_phone string, new_birth string, new_sex string, new_cli_id long"
    changes = [(1, 1, "update", None, "\tana ", "529.982.247-25", " A@B.co ", "(11) 9", "1990-02-03", "F", 2),
               (2, 1, "update", None, "bia", None, None, None, None, None, None),
               (3, 1, "update", None, "x", "111.111.111-11", None, None, None, None, None),
               (4, 1, "status", 2, None, None, None, None, None, None, None),
               (5, 9, "update", None, "other tenant", None, None, None, None, None, None),
               (6, 1, "update", None, "x", None, "nope", None, "2999-01-01", None, None)]
    m = SimpleNamespace(collaborator=spark.createDataFrame(old, cols))
    got = {r[0]: tuple(r[1:]) for r in people.upsert_collaborators(m, spark.createDataFrame(changes, new), "2000-01-01").collect()}
    keep = (1, "OLD", "1", "o@x.yz", "11", dt.date(1980, 1, 1), "M", 1, False)
    assert got[1] == (2, "ANA", "52998224725", "a@b.co", "119", dt.date(1990, 2, 3), "F", 1, True, None)
    assert got[2] == (1, "BIA", None, None, None, None, None, 1, True, None)
    assert got[3] == (*keep, "CPF inválido") and got[6] == (*keep, "Email inválido") and got[5] == (*keep, None)
    assert got[4] == (1, "OLD", "1", "o@x.yz", "11", dt.date(1980, 1, 1), "M", 2, True, None)


def test_portuguese_order_of_names(spark):
    """Accents and case come after the letters; without a collation the order is binary."""
    from tipflow.functions.columns import text_order
    names = ["Zé", "Ábaco", "abaco", "Abel", "ábaco", "Éden", "eden", "A b", "Ab", "ção", "Cao", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    by = lambda c: [r.n for r in df.orderBy(text_order("n", c), "n").collect()]
    assert by("pt") == [None, "A b", "Ab", "abaco", "ábaco", "Ábaco", "Abel", "Cao", "ção", "eden", "Éden", "Zé"]
    assert by(None) == [None, *sorted(n for n in names if n)]
    m = mart(spark, SF_SMALL)
    binary, pt = ([r.usr_name for r in people.collaborator_names_page(m, c, limit=1000).where("cli_id = 3").orderBy("pos").collect()]
                  for c in (None, "pt"))
    assert sorted(binary) == sorted(pt) and binary != pt and binary == sorted(binary)
    for listing in (people.collaborators_active(m, collation="pt"), people.collaborators_all(m, "", collation="pt")):
        assert listing.where("pos < 1 or pos > 100").count() == 0 and listing.count() > 0


def test_pages_do_not_clamp(spark):
    import pytest
    m = mart(spark, SF_SMALL)
    total = m.collaborator.filter("sit_id = 1").count()
    assert people.collaborators_active(m, limit=10_000).count() == total
    for bad in ({"limit": 0}, {"limit": -1}, {"limit": 5, "offset": -1}):
        with pytest.raises(ValueError):
            people.collaborators_active(m, **bad)


def test_sketches_add_up_from_days_to_any_span(spark):
    from tipflow.operators import dashboard as d
    from tipflow.plans.registry import END, START
    m = mart(spark, "/root/testdata/sf0.01")
    daily = d.daily_topup_sketches(m, START, END)
    half = daily.where("credit_date < '1998-06-01'").unionByName(daily.where("credit_date >= '1998-06-01'"))
    year = half.groupBy("cli_id", F.year("credit_date").alias("y")).agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("est"))
    exact = d.released_credits(m, START, END).groupBy("cli_id", F.year("credit_date").alias("y")).agg(
        F.countDistinct("usr_id").alias("n"))
    rows = year.join(exact, ["cli_id", "y"]).collect()
    assert rows and all(abs(r.est - r.n) <= max(1, d.SKETCH_ERROR * r.n) for r in rows)


def test_collaborators_are_created_with_their_categories(spark, scratch):
    m = mart(spark, SF_SMALL)
    existing = m.category.where("cli_id = 1").select("set_id").orderBy("set_id").limit(2).collect()
    a, b = (r.set_id for r in existing)
    other = m.category.where("cli_id = 2").first().set_id
    asked = [[a, b, a], None, [a], [other, -5], []]
    cpfs = ["529.982.247-25", "111.444.777-35", "000.000.000-00", "123.456.789-09", "987.654.321-00"]
    df = spark.createDataFrame([(i, 1, f"n{i}", cpfs[i], None, None, None, None, asked[i]) for i in range(5)],
                               "ord long, cli_id long, nome string, cpf string, email string, celular string, "
                               "nascimento string, sexo string, categorias array<long>")
    out = people.create_with_categories(m, df, AS_OF, ledger=f"{scratch}/ids")
    made = {r.ord: r.usr_id for r in out["decisions"].collect() if r.status == "criado"}
    assert set(made) == {0, 1, 3, 4}
    assert {tuple(r) for r in out["links"].collect()} == {(made[0], a), (made[0], b)}
    assert out["collab_category"].count() == m.collab_category.count() + 2


def test_requests_without_invoice_do_not_meet_in_one_task(spark):
    log = [(i, None if i % 100 == 99 else i % 500, "api", i % 3 or None, i % 7 if i % 10 == 0 else None) for i in range(4000)]
    m = SimpleNamespace(
        request_log=spark.createDataFrame(log, "req_id long, usr_code long, route string, asked_cli_id long, asked_not_id long"),
        portal_user=spark.createDataFrame([(u, 1 + u % 2, "S" if u % 50 == 0 else "N") for u in range(500)],
                                          "usr_code long, legacy_cli_id long, is_admin string"),
        credit=spark.createDataFrame([(n, 1 + n % 2) for n in range(5)], "not_id long, cli_id long"))
    want = {}
    for req, usr, _, cli, inv in log:
        own, admin = (None, False) if usr is None else (1 + usr % 2, usr % 50 == 0)
        owner = 1 + inv % 2 if inv is not None and inv < 5 else None
        want[req] = ("deny_tenant" if not (cli is None or admin or cli == own)
                     else "allow" if inv is None
                     else "not_found" if owner is None
                     else "allow" if admin or owner == own else "deny_invoice")
    set_to = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in set_to}
    for k, v in set_to.items():
        spark.conf.set(k, v)
    try:
        got = access.tenant_access_audit(m).select("req_id", "decision", F.spark_partition_id().alias("p")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.req_id: r.decision for r in got} == want and len(got) == len(log)
    assert set(want.values()) == {"allow", "deny_tenant", "deny_invoice", "not_found"}
    assert max(Counter(r.p for r in got).values()) < len(log) / 2
