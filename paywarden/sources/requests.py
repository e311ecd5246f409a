"""Scoring requests: JSON bodies to typed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRANSACTION_BODY = (
    T.StructType()
    .add("amount", T.DecimalType(12, 2))
    .add("channel", T.StringType())
    .add("pin_attempts", T.IntegerType())
    .add("historical_average_amount", T.DoubleType())
    .add("amount_deviation", T.DoubleType())
)


def parse_requests(df: DataFrame, body: str = "body", transaction: T.StructType = TRANSACTION_BODY) -> DataFrame:
    """Typed payment columns; a baseline amount fills the history features the body lacks."""
    schema = T.StructType(
        [T.StructField("transaction", transaction), T.StructField("baseline_amount", T.DoubleType())]
    )
    out = df.withColumn("_p", F.from_json(F.col(body), schema))
    out = out.select("*", "_p.transaction.*", "_p.baseline_amount").drop("_p")
    amount = F.coalesce(F.col("amount").cast("double"), F.lit(0.0))
    return out.withColumns(
        {
            "historical_average_amount": F.coalesce("historical_average_amount", "baseline_amount"),
            "amount_deviation": F.coalesce("amount_deviation", F.abs(amount - F.col("baseline_amount"))),
        }
    )
