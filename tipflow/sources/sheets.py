"""Sheet sources (A2): delimited exports of credit and collaborator sheets.

The reference reads one uploaded spreadsheet per request; here any number
of sheet files are read in one job, each by its own header: files of one folder may spell,
order and leave out columns as they like.  All cells are text (no inference).
Each row gets its sheet line (file row index + 2, as the reference reports it) and each file a
status: empty files are rejected, and files over ``max_rows`` when a limit is given (the
reference's web upload allows 5,000).

The files are read once, as lines that are stored with their file, split and place; a split's
first place, number of lines and the header of its file make a small table (one row a split), and
lines meet it by (file, split).  A file that holds a third of all rows is many splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tipflow.session import checkpoint_dir

# Fixed values of the reference: accepted header spellings per field.
CREDIT_HEADERS = {"nome": ["nome"], "cpf": ["cpf"], "valor": ["valor"], "categoria": ["categoria"]}
COLLABORATOR_HEADERS = {
    "nome": ["NOME", "nome", "Nome"],
    "cpf": ["CPF", "cpf", "Cpf"],
    "nascimento": ["DATA_NASCIMENTO", "data_nascimento", "Data Nascimento", "data nascimento"],
    "sexo": ["SEXO", "sexo", "Sexo"],
    "email": ["EMAIL", "email", "Email"],
    "celular": ["CELULAR", "celular", "Celular"],
}


def read_sheets(spark: SparkSession, path: str, headers: dict, sep: str = ",",
                max_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Read header CSV sheets under ``path``.

    Returns (rows, files): rows with canonical columns plus ``file`` and ``line``; files with
    ``n_rows`` and ``status`` ('ok', 'empty', 'too_many_rows').  Rows of rejected files are
    excluded.  A field takes the first of its spellings that the file has and whose cell is not
    empty; a field the file lacks is null.  Blank lines are no rows; further columns are not read.
    """
    checkpoint_dir(spark)
    lines = (spark.read.text(path).where(F.trim("value") != "")
             .select(F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("_block"),
                     F.monotonically_increasing_id().alias("_pos"), "value").checkpoint(eager=True))
    splits = lines.groupBy("file", "_block").agg(F.count(F.lit(1)).alias("_lines"), F.min("_pos").alias("_first"),
                                                 F.min_by("value", "_pos").alias("_top"))
    of_file = Window.partitionBy("file").orderBy("_block")
    splits = (splits.withColumn("_before", F.coalesce(F.sum("_lines").over(
        of_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_head", F.regexp_replace(F.first("_top").over(of_file), "^\ufeff", "")).drop("_top").checkpoint(eager=True))
    width = splits.agg(F.max(F.size(F.split("_head", F.lit(f"\\Q{sep}\\E"))))).first()[0] or 1
    schema = ", ".join(f"_{i} string" for i in range(width))
    options = {"sep": sep, "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    cells = F.array(*[F.col(f"_cells._{i}") for i in range(width)])

    def named(field_aliases):
        """The first filled cell under one of the spellings, which a header of the file may lack."""
        return F.coalesce(*[F.element_at(cells, F.nullif(F.array_position("_names", F.lit(a)), F.lit(0)).cast("int"))
                            for a in field_aliases])

    heads = splits.withColumn("_cells", F.from_csv("_head", F.lit(schema), options)).withColumn("_names", cells).drop("_cells", "_head")
    rows = (lines.join(heads, ["file", "_block"])
            .withColumn("line", (F.col("_pos") - F.col("_first") + F.col("_before") + 1).cast("int"))
            .where("line > 1")  # the first line of the file is its header
            .withColumn("_cells", F.from_csv("value", F.lit(schema), options))
            .select("file", *[named(aliases).alias(canon) for canon, aliases in headers.items()], "line"))
    counts = splits.groupBy("file").agg((F.sum("_lines") - 1).alias("n_rows"))
    # the names that Spark's file index holds on the driver anyway; a scan would skip files of no bytes
    listed = spark.createDataFrame([(name,) for name in spark.read.text(path).inputFiles()], "file string")
    files = (listed.join(counts, "file", "left")
             .withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
             .withColumn("status", F.when(F.col("n_rows") == 0, "empty")
                         .when(F.col("n_rows") > max_rows if max_rows is not None else F.lit(False), "too_many_rows")
                         .otherwise("ok")))
    if max_rows is None:
        return rows, files
    ok = files.filter(F.col("status") == "ok").select("file")
    return rows.join(ok, "file", "left_semi"), files
