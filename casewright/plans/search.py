"""Session search: predicate trees, keyed joins, date ranges, path selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.operators.positions import numbered
from casewright.operators.predicates import compile_constraints
from casewright.sources.tables import table

QUERIES = {}
ORACLES = {}


def search_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constraint tree, keyed left join to subjects, inclusive date range, numbered preview."""
    sessions = table(spark, sf_dir, "orders").where(
        compile_constraints([("o_orderstatus", "=", "F"), "OR", ("o_orderstatus", "=", "O")])
    )
    subjects = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("subject_id"), F.col("c_mktsegment").alias("procedure")
    )
    found = (
        sessions.select(
            F.col("o_orderkey").alias("expt_id"),
            F.col("o_custkey").alias("subject_id"),
            F.to_date("o_orderdate").alias("operation_date"),
            F.date_format("o_orderdate", "HH:mm").alias("upload_time"),
        )
        .where(F.col("operation_date").between(F.lit("1996-01-01").cast("date"), F.lit("1996-12-31").cast("date")))
        .join(subjects, "subject_id", "left")
    )
    return numbered(found, "row_num", F.col("operation_date"), "operation_date", "expt_id").select(
        "row_num", "expt_id", "procedure", F.col("operation_date").cast("string").alias("operation_date"), "upload_time"
    )


QUERIES["search_preview"] = search_preview
ORACLES["search_preview"] = """
SELECT row_number() OVER (ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS row_num,
       o_orderkey AS expt_id, c_mktsegment AS procedure,
       CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS operation_date,
       strftime(o_orderdate, '%H:%M') AS upload_time
FROM orders LEFT JOIN customer ON c_custkey = o_custkey
WHERE (o_orderstatus = 'F' OR o_orderstatus = 'O')
  AND CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'
"""
