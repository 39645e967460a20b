"""Analysis requests in JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailweave.operators.cleaning import sanitise
from mailweave.sources.schemas import REQUEST

#: A request may hold so many mails.
MAX_MAILS = 500


def parse_requests(lines: DataFrame, column: str = "value") -> DataFrame:
    """(request_id, mail_ord, status, ...mail fields) from JSON texts; one row per mail, one per request refused.

    status is 200, 400 for a request without mails or that isn't JSON, 413 for one with more than MAX_MAILS. Texts are
    sanitised; a date that can't be read is NULL. lines needs request_id.
    """
    r = lines.select("request_id", F.from_json(column, REQUEST).alias("r")).select("request_id", "r.emails")
    n = F.coalesce(F.size("emails"), F.lit(0))
    status = F.when(n <= 0, 400).when(n > MAX_MAILS, 413).otherwise(200)
    x = r.withColumn("status", status).select("request_id", "status", F.posexplode_outer(F.when(F.col("status") == 200, F.col("emails"))).alias("mail_ord", "m"))
    clean = lambda c: sanitise(F.coalesce(F.col(f"m.{c}"), F.lit("")))
    return x.select(
        "request_id", "status", "mail_ord", F.col("m.message_id").alias("message_id"), clean("sender_name").alias("sender_name"), F.col("m.sender_email").alias("sender_address"), F.col("m.recipients").alias("recipients"),
        F.col("m.cc").alias("cc"), F.coalesce(F.try_to_timestamp("m.date_str"), F.try_to_timestamp("m.date_str", F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))).alias("date"), F.col("m.date_str").alias("date_str"), clean("subject").alias("subject"), clean("body").alias("body"),
    )


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Requests of a folder of files, one JSON text per file; request_id is the file's name."""
    return parse_requests(spark.read.text(path, wholetext=True).withColumn("request_id", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)))
