"""Sheet source (A2) and committed-state sink."""

import os

import pytest
from pyspark.sql import functions as F

from tipflow.operators import people
from tipflow.sources.mart import mart
from tipflow.sources.sheets import COLLABORATOR_HEADERS, CREDIT_HEADERS, read_sheets
from tipflow.sources.sinks import read_state, write_state

from .conftest import SF_SMALL


def test_credit_sheets_lines_and_rejections(spark, scratch):
    m = mart(spark, SF_SMALL)
    sheet = m.credit_sheet.orderBy("line").select("nome", "cpf", "valor", "categoria")
    (sheet.limit(40).coalesce(1).write.option("header", True)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{scratch}/in/a"))
    big = spark.range(0, 5001).select(F.lit("X").alias("nome"), F.lit("52998224725").alias("cpf"),
                                      F.lit("10").alias("valor"), F.lit("A").alias("categoria"))
    big.coalesce(1).write.option("header", True).csv(f"{scratch}/in/b")
    os.makedirs(f"{scratch}/in/c")
    with open(f"{scratch}/in/c/empty.csv", "w") as fh:
        fh.write("nome,cpf,valor,categoria\n")
    rows, files = read_sheets(spark, f"{scratch}/in/*/*.csv", CREDIT_HEADERS)
    assert files.filter("status = 'ok'").count() == 2 and rows.count() == 5041   # no limit unless asked for
    rows, files = read_sheets(spark, f"{scratch}/in/*/*.csv", CREDIT_HEADERS, max_rows=5000)
    st = {os.path.basename(os.path.dirname(r.file.replace("file:", ""))): r.status for r in files.collect()}
    assert st == {"a": "ok", "b": "too_many_rows", "c": "empty"}
    got = rows.orderBy("line").collect()
    assert len(got) == 40 and [r.line for r in got] == list(range(2, 42))
    want = sheet.limit(40).collect()
    # an empty cell reads back as NULL; the validators treat both alike
    assert [(r.nome or None, r.cpf) for r in got] == [(r.nome or None, r.cpf) for r in want]


def test_collaborator_header_aliases(spark, scratch):
    df = spark.createDataFrame([("Ana", "529.982.247-25", "05/01/1990", "f", "a@b.co", "(11) 98765-4321")],
                               "Nome string, Cpf string, `Data Nascimento` string, Sexo string, Email string, Celular string")
    df.coalesce(1).write.option("header", True).csv(f"{scratch}/s")
    rows, files = read_sheets(spark, f"{scratch}/s/*.csv", COLLABORATOR_HEADERS)
    r = rows.first()
    assert (r.nome, r.cpf, r.nascimento, r.sexo, r.line) == ("Ana", "529.982.247-25", "05/01/1990", "f", 2)


def test_write_state_commits_last(spark, scratch):
    m = mart(spark, SF_SMALL)
    out = people.upsert_collaborators(m, m.collab_change, "2000-01-01")
    write_state({"collaborator": out}, f"{scratch}/state", run_id=1)
    write_state({"collaborator": out.filter("changed")}, f"{scratch}/state", run_id=2)
    assert read_state(spark, f"{scratch}/state", "collaborator").count() == out.filter("changed").count()
    # a retried run replaces its own partition instead of appending
    write_state({"collaborator": out.filter("changed")}, f"{scratch}/state", run_id=2)
    assert read_state(spark, f"{scratch}/state", "collaborator").count() == out.filter("changed").count()


def test_write_state_empty_frames(spark, scratch):
    df = spark.createDataFrame([(1, "a")], "id long, name string")
    write_state({"t": df.where("false")}, f"{scratch}/s", run_id=1)
    back = read_state(spark, f"{scratch}/s", "t")
    assert back.schema == df.schema and back.count() == 0
    # an empty retry hides what the first attempt of the run wrote
    write_state({"t": df}, f"{scratch}/s", run_id=2)
    write_state({"t": df.where("false")}, f"{scratch}/s", run_id=2)
    assert read_state(spark, f"{scratch}/s", "t").count() == 0
    # a run that fails before its commit stays invisible
    write_state({"t": df}, f"{scratch}/s", run_id=3)
    broken = df.select("id", F.raise_error(F.lit("no")).cast("string").alias("name"))
    with pytest.raises(Exception):
        write_state({"t": broken}, f"{scratch}/s", run_id=4)
    assert read_state(spark, f"{scratch}/s", "t").count() == 1


def test_sheet_lines_over_several_splits(spark, scratch):
    with open(f"{scratch}/one.csv", "w") as fh:
        fh.write("nome,cpf,valor,categoria\n" + "".join(f"n{i},1,{i},A\n" for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        rows, _ = read_sheets(spark, f"{scratch}/one.csv", CREDIT_HEADERS)
        assert spark.read.text(f"{scratch}/one.csv").rdd.getNumPartitions() > 1
        assert rows.filter("line <> cast(valor as int) + 2").count() == 0
        assert rows.count() == 20_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_csv_export_partitioned(spark, scratch):
    from tipflow.operators.reports import report_export_topups
    from tipflow.plans.registry import END, START
    from tipflow.sources.sinks import write_csv
    m = mart(spark, SF_SMALL)
    out = report_export_topups(m, START, END)
    write_csv(out, f"{scratch}/export", partition_by=["cli_id"])
    back = spark.read.option("header", True).csv(f"{scratch}/export")
    assert back.count() == out.count()
    assert set(back.columns) == set(out.columns)
    assert back.filter(F.col("line_type") == "total").count() == out.select("cli_id").distinct().count()


def test_nested_forms_agree_with_flat(spark):
    from tipflow.operators.reports import collaborator_history_monthly
    from tipflow.plans.registry import END, START
    m = mart(spark, SF_SMALL)
    nested = collaborator_history_monthly(m, START, END, nested=True)
    flat = collaborator_history_monthly(m, START, END)
    rows = nested.select("usr_id", "month_key", "month_total", "n_credits",
                         F.size("credits").alias("k"),
                         F.aggregate("credits", F.lit(0).cast("decimal(38,2)"),
                                     lambda acc, c: acc + c["credit_value"]).alias("s")).collect()
    assert all(r.k == r.n_credits and r.s == r.month_total for r in rows)
    assert len(rows) == flat.count()
    full = people.collaborator_full(m, nested=True).select("usr_id", F.size("categories").alias("k"))
    flat_full = people.collaborator_full(m).select("usr_id", "category_ids")
    j = full.join(flat_full, "usr_id").collect()
    assert all((r.k == 0 and r.category_ids is None) or r.k == len(r.category_ids.split(",")) for r in j)


def test_ten_thousand_runs_are_one_scan(spark, scratch):
    """The manifest keeps the log short to read; all folders of a table are read in one scan."""
    from tipflow.sources import commits, sinks
    df = spark.createDataFrame([(1, "a")], "id long, name string")
    root = f"{scratch}/t"
    sinks.write_attempts({"t": df}, root, 0)
    log = sinks._log(spark, root)
    (first, _, path, schema), = sinks.committed(spark, root, "t")
    # the log of many runs, as write_attempts leaves it (their rows in ten folders)
    state = {"t": [[i, i, f"{path}-{i % 10}", schema] for i in range(10_000)]}
    for i in range(10):
        df.select(F.lit(i).cast("long").alias("id"), "name").write.parquet(f"{path}-{i}")
    log.folder.create("manifest-000000010000.json", __import__("json").dumps(state))
    for i in range(30):
        sinks.write_attempts({"t": df.where("false")}, root, 10_000 + i) if i == 29 else log.append(
            10_001 + i, {"t": [10_000 + i, 10_000 + i, f"{path}-0", schema]})
    parts = sinks.committed(spark, root, "t")
    assert len(parts) == 10_030 and parts[-1][0] == 10_029
    out = sinks.read_runs(spark, parts)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Union" not in plan
    assert commits.MANIFEST <= 100 and len([n for n in log.folder.names() if n.startswith("manifest")]) == 1


def test_merged_runs_and_retries(spark, scratch):
    from tipflow.sources import commits, sinks
    root = f"{scratch}/t"

    def rows(n):
        return spark.range(n).selectExpr("id", "'x' AS name")

    for run in range(6):
        sinks.write_attempts({"t": rows(run)}, root, run)
    sinks.merge_runs(spark, root, "t", before=5)
    parts = sinks.committed(spark, root, "t")
    assert [p[:2] for p in parts] == [[0, 4], [5, 5]]
    assert sinks.read_runs(spark, parts).count() == 15
    sinks.write_attempts({"t": rows(1)}, root, 5)   # a retry of the newest run replaces it, whatever the clock says
    assert sinks.read_runs(spark, sinks.committed(spark, root, "t")).count() == 11
    with pytest.raises(ValueError, match="merged"):
        sinks.write_attempts({"t": rows(1)}, root, 3)
    # a later schema adds a column
    sinks.write_attempts({"t": rows(2).withColumn("more", F.lit(1))}, root, 6)
    out = sinks.read_runs(spark, sinks.committed(spark, root, "t"))
    assert out.count() == 13 and out.columns == ["id", "name", "more"]
    # manifests fold the same state as the single records
    log = commits.Log(spark, f"{scratch}/log", lambda state, r: {"sum": state.get("sum", 0) + r["x"]})
    for i in range(250):
        log.commit(lambda state, i=i: {"x": i})
    assert log.state() == (250, {"sum": sum(range(250))})
    assert sorted(n for n in log.folder.names() if n.startswith("m")) == ["manifest-000000000100.json", "manifest-000000000200.json"]


def test_each_sheet_by_its_own_header(spark, scratch):
    """Three spellings, other column orders, a missing column, a repeated field and a quoted header in one folder."""
    sheets = {
        "a.csv": "nome,cpf,celular,sexo\nAna,1,11,F\n\nBia,2,12,F\n",
        "b.csv": "NOME,CPF,SEXO\nCaio,3,M\n",
        "c.csv": "Sexo,Data Nascimento,Nome,Cpf,Email,extra\nM,01/02/1990,Davi,4,d@x.co,zzz\nF,,\"Eva, a\",5\n",
        "d.csv": "\ufeff\"CPF\",\"nome\",NOME,data_nascimento\n6,outro,,1990\n7,segundo,PRIMEIRO,1991\n",
        "e.csv": "only\nx\n",
        "f.csv": "",
        "g.csv": "nome,cpf\n",
    }
    for name, text in sheets.items():
        with open(f"{scratch}/{name}", "w", encoding="utf-8") as fh:
            fh.write(text)
    rows, files = read_sheets(spark, f"{scratch}/*.csv", COLLABORATOR_HEADERS)
    got = {(os.path.basename(r.file), r.line): (r.nome, r.cpf, r.nascimento, r.sexo, r.email, r.celular) for r in rows.collect()}
    assert got == {
        ("a.csv", 2): ("Ana", "1", None, "F", None, "11"), ("a.csv", 3): ("Bia", "2", None, "F", None, "12"),
        ("b.csv", 2): ("Caio", "3", None, "M", None, None),
        ("c.csv", 2): ("Davi", "4", "01/02/1990", "M", "d@x.co", None), ("c.csv", 3): ("Eva, a", "5", None, "F", None, None),
        ("d.csv", 2): ("outro", "6", "1990", None, None, None), ("d.csv", 3): ("PRIMEIRO", "7", "1991", None, None, None),
        ("e.csv", 2): (None,) * 6}
    assert {os.path.basename(r.file): (r.n_rows, r.status) for r in files.collect()} == {
        "a.csv": (2, "ok"), "b.csv": (1, "ok"), "c.csv": (2, "ok"), "d.csv": (2, "ok"), "e.csv": (1, "ok"), "f.csv": (0, "empty"),
        "g.csv": (0, "empty")}
    # credit sheets whose columns stand in another order keep their values
    for name, text in {"x.csv": "nome,cpf,valor,categoria\nAna,1,10.5,Bar\n", "y.csv": "cpf;nome;categoria;valor\n", "z.csv": "cpf,nome,categoria,valor\n2,Bia,Sala,7\n"}.items():
        os.makedirs(f"{scratch}/k", exist_ok=True)
        with open(f"{scratch}/k/{name}", "w", encoding="utf-8") as fh:
            fh.write(text)
    rows, _ = read_sheets(spark, f"{scratch}/k/*.csv", CREDIT_HEADERS)
    assert sorted((r.nome, r.cpf, r.valor, r.categoria) for r in rows.collect()) == [("Ana", "1", "10.5", "Bar"), ("Bia", "2", "7", "Sala")]


def test_hot_sheet_over_many_splits_keeps_its_header(spark, scratch):
    with open(f"{scratch}/one.csv", "w") as fh:
        fh.write("cpf,categoria,valor,nome\n" + "".join(f"{i},B,{i},n{i}\n" for i in range(20_000)))
    with open(f"{scratch}/two.csv", "w") as fh:
        fh.write("valor,nome\n" + "".join(f"{i},m{i}\n" for i in range(300)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
    try:
        rows, files = read_sheets(spark, f"{scratch}/*.csv", CREDIT_HEADERS)
        assert rows.filter("line <> cast(valor as int) + 2 or nome not rlike concat('^[nm]', valor, '$')").count() == 0
        assert sorted(r.n_rows for r in files.collect()) == [300, 20_000] and rows.where("cpf is null").count() == 300
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
