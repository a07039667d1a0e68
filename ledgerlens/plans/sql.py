"""SQL path: the two tables as temp views, with the SQLite date function the
analyses' SQL uses, so statements written for the stored tables run through
``spark.sql`` unchanged and get the same Catalyst plans as the DataFrame code.

``julianday(x)`` is a SQL function (inlined into generated code, no Python):
``'now'`` is the current UTC instant, anything else is read as a naive
timestamp; the result is the Julian day number as a double, independent of
the session time zone. Note that Spark reads ``100.0`` as a decimal literal
(SQLite: a double), so ``100.0 * a / b`` comes back as a decimal of the same
value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

JULIANDAY = """
CREATE OR REPLACE TEMPORARY FUNCTION julianday(x STRING) RETURNS DOUBLE RETURN
  2440587.5D + CAST(CASE WHEN lower(trim(x)) = 'now' THEN unix_micros(current_timestamp())
      ELSE timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(x AS TIMESTAMP_NTZ)) END
      AS DOUBLE) / 86400000000.0D
"""


def register(spark: SparkSession, transactions: DataFrame, support_tickets: DataFrame) -> None:
    """Temp views ``transactions`` and ``support_tickets`` plus ``julianday``."""
    transactions.createOrReplaceTempView("transactions")
    support_tickets.createOrReplaceTempView("support_tickets")
    spark.sql(JULIANDAY)
