"""The life of a book as a table of moves: which changes of status a history has made that are not allowed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The statuses of a book, and the moves between them.
MOVES = (
    ("PENDING", "PROCESSING"),
    ("PROCESSING", "ANALYZED"),
    ("PROCESSING", "FAILED"),
    ("ANALYZED", "GENERATING"),
    ("GENERATING", "DONE"),
    ("GENERATING", "FAILED"),
)
#: A failed or finished book may be taken up again.
AGAIN = (("FAILED", "PROCESSING"), ("FAILED", "GENERATING"), ("ANALYZED", "PROCESSING"), ("DONE", "PROCESSING"), ("DONE", "GENERATING"))
FIRST = "PENDING"


def allowed_moves(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*MOVES, *AGAIN], "previous string, status string")


def moves(history: DataFrame, allowed: DataFrame, key: str = "book_id", order: tuple[str, ...] = ("at", "event_id"), first: str = FIRST) -> DataFrame:
    """history with previous and legal: whether the move from a book's last status, or from its birth, is allowed. A repeated
    status is no move and legal; a null status is never legal, and the next one is judged by the last that is known."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    told = history.withColumn("previous", F.last("status", ignorenulls=True).over(before))
    # The moves are a fixed few.
    judged = told.join(F.broadcast(allowed.select("previous", "status", F.lit(True).alias("fits"))), ["previous", "status"], "left")
    birth = F.col("previous").isNull() & (F.col("status") == first)
    legal = F.coalesce(F.col("fits") | F.lit(False), F.lit(False)) | birth | F.col("status").eqNullSafe(F.col("previous")) & F.col("status").isNotNull()
    return judged.select(*history.columns, "previous", F.coalesce(legal, F.lit(False)).alias("legal"))


def illegal_moves(history: DataFrame, allowed: DataFrame, key: str = "book_id") -> DataFrame:
    return moves(history, allowed, key).where("not legal").drop("legal")
