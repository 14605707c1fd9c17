"""Fixture tables derived from the driver tables, as SQL text.

The same SQL text runs on Spark and on DuckDB (only integer division is
spelled differently), so the DuckDB oracle and the Spark job read identical
inputs.  ``notices`` is a controlled dedup input whose expected labels are a
plain CASE; it grows with ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPARK_DIV = "div"
DUCK_DIV = "//"

# The planted notice texts of the controlled fixture.
HEADER_SQL = ("concat('Tribunal Regional Processo ', cs, "
              "' Vara 3 Publicacao Intimado(s)/Citado(s):')")

NOTICES_SQL = """
SELECT row_id, dia, processo, jornal, mode, v, intimacao FROM (
  SELECT row_id, dia, mode, v,
    CASE WHEN v = 9 THEN concat('S', row_id) ELSE concat('P', cs) END AS processo,
    CASE WHEN cs % 5 = 0 OR row_id % 3 = 0 THEN 'DJSP' ELSE 'D J E N - TRT2' END AS jornal,
    CASE
      WHEN v = 9 THEN concat(h, ' UNICO')
      WHEN mode = 0 AND v IN (0, 1) THEN concat(h, ' ANA SOUZA decide juntar autos')
      WHEN mode = 0 AND v = 2 THEN concat(h, ' JOSE LIMA decide juntar autos')
      WHEN mode = 0 AND v IN (3, 7) THEN concat(h, ' RUI ALVES decide juntar autos')
      WHEN mode = 0 AND v = 4 THEN concat(h, ' JOSE LIMA decide juntar autos cumprase')
      WHEN mode = 0 AND v = 5 THEN concat('Edital retificado ', h, ' JOSE LIMA decide anular tudo')
      WHEN mode = 0 AND v = 6 THEN concat('Edital  retificado ', h, ' JOSE LIMA decide anular tudo')
      WHEN mode = 0 AND v = 8 THEN concat(h, ' LIA COSTA decide juntar autos')
      WHEN mode = 1 AND v <= 6 THEN concat(h, ' ANA', repeat(' x', cast(v AS int)))
      WHEN mode = 1 THEN concat(h, ' ANA', repeat(' x', 7))
      WHEN mode = 2 AND v = 0 THEN h
      ELSE concat(h, ' NOME', v, ' decide')
    END AS intimacao
  FROM (
    SELECT row_id, cs, dia, v, cs % 3 AS mode, {header} AS h
    FROM (
      SELECT doc_id AS row_id, doc_id {div} 20 AS cs, (doc_id {div} 10) % 2 AS dia,
             doc_id % 10 AS v
      FROM {documents}
    ) b
  ) c
) n
"""

# Expected `similar` of every notice, by planted pattern (as the v of the
# representative; -1 = undecided).
EXPECTED_V_SQL = """
CASE
  WHEN v = 9 THEN 9
  WHEN mode = 0 THEN CASE v WHEN 1 THEN 0 WHEN 7 THEN 3 WHEN 8 THEN 2 ELSE v END
  WHEN mode = 1 THEN CASE WHEN v >= 7 THEN 7 ELSE -1 END
  ELSE CASE WHEN v = 0 THEN 0 ELSE 1 END
END
"""


def notices_sql(div: str = SPARK_DIV, documents: str = "documents", prose: bool = False) -> str:
    """The notices; with ``prose`` each ends with a document's whole text, the
    same for all notices of a case (which changes no expected label)."""
    sql = NOTICES_SQL.format(div=div, header=HEADER_SQL, documents=documents)
    if not prose:
        return sql
    return f"""
SELECT n.row_id, n.dia, n.processo, n.jornal, n.mode, n.v, concat(n.intimacao, ' ', coalesce(t.text, '')) AS intimacao
FROM ({sql}) n LEFT JOIN {documents} t ON t.doc_id = (n.row_id {div} 20) * 20
"""


def expected_labels_sql(div: str = SPARK_DIV, documents: str = "documents", prose: bool = False) -> str:
    """Notices with their known `noccur` and `sim` = expected `similar` (the fixture answer)."""
    return f"""
SELECT row_id, dia, processo, jornal, mode, v, intimacao,
       CASE WHEN v = 9 THEN 1 ELSE 9 END AS noccur,
       CASE WHEN ev = -1 THEN -1 ELSE row_id - v + ev END AS sim
FROM (SELECT *, {EXPECTED_V_SQL} AS ev FROM ({notices_sql(div, documents, prose)}) q) x
"""


def run_sql(spark: SparkSession, sql: str, **frames: DataFrame) -> DataFrame:
    """``spark.sql`` with DataFrames bound to ``{name}`` placeholders (no
    session-wide temp views); other braces in the text are kept literally."""
    text = sql.replace("{", "{{").replace("}", "}}")
    for name in frames:
        text = text.replace("{{" + name + "}}", "{" + name + "}")
    return spark.sql(text, **frames)


def documents_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The controlled notice fixture built from ``documents``."""
    return run_sql(spark, notices_sql(SPARK_DIV, "{documents}"), documents=documents_ids(spark, sf_dir))


def prose_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notices with the texts of ``documents``."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return run_sql(spark, notices_sql(SPARK_DIV, "{documents}", prose=True), documents=documents)


def expected_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture's known answer (column ``sim`` = expected ``similar``)."""
    return run_sql(spark, expected_labels_sql(SPARK_DIV, "{documents}"), documents=documents_ids(spark, sf_dir))


# Judge answers as a table: valid JSON unless the planted deviations apply.
VERDICT_RESPONSE_SQL = """
CASE
  WHEN c.v = 5 THEN 'I cannot tell whether these notices match.'
  WHEN c.v = 6 THEN '{"same_story": true, "same_goal": true'
  WHEN c.v = 4 THEN '{"same_story": true}'
  WHEN p.v >= c.v THEN concat('{"same_story": true, "same_goal": true, "same_litigation": true, "litigation-id": "', c.processo, '"}')
  ELSE concat('{"same_story": true, "same_goal": false, "same_litigation": true, "litigation-id": "', c.processo, '"}')
END
"""
