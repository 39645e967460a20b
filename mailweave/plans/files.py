"""Queries of sources and sinks: files and requests are made from the tables, read back by the readers, and compared by SQL."""

from __future__ import annotations

import base64
import io
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailweave.functions.arrow import flat_map
from mailweave.operators.cleaning import CONTROLS
from mailweave.plans.reference import lit, steps
from mailweave.sinks.reports import SECTIONS, read_docx, read_xlsx, write_docx, write_json, write_xlsx
from mailweave.sources.crm import from_tables
from mailweave.sources.mailfiles import parsed_mails
from mailweave.sources.requests import parse_requests
from mailweave.sources.schemas import CRM_MESSAGE
from mailweave.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
_ADDRESS, _PLAIN_NAME = r"^[^<>\",;:\s()\[\]\\@]+@[A-Za-z0-9.\-]+$", r"^[A-Za-z]+( [A-Za-z]+)*$"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _archive(spark: SparkSession, root: str) -> DataFrame:
    """(name, content, length): each delivery as a mail file, with the headers that can be written without loss."""

    def make() -> object:
        word = lambda t: "=?utf-8?B?" + base64.b64encode(t.encode("utf-8", "replace")).decode() + "?="

        def one(delivery: int, ident: str | None, name: str | None, address: str | None, to: list, cc: list, day: str | None, subject: str, body: str) -> list[tuple]:
            head = [f"Message-ID: {ident}"] if ident else []
            if address:
                head.append(f'From: "{name}" <{address}>' if name else f"From: {address}")
            head += [f"{k}: {', '.join(v)}" for k, v in (("To", to), ("Cc", cc)) if v] + ([f"Date: {day}"] if day else []) + ([f"Subject: {word(subject)}"] if subject else [])
            head += ['Content-Type: text/plain; charset="utf-8"', "Content-Transfer-Encoding: base64"]
            data = ("\r\n".join(head) + "\r\n\r\n").encode() + base64.encodebytes(body.encode("utf-8", "replace"))
            return [(f"{delivery}.eml", data, len(data))]

        return one

    plain = lambda c: F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda a: a.rlike(_ADDRESS))
    m = table(spark, root, "messages").select(
        "delivery_id", F.when(F.col("message_id").rlike(r"^[!-~]+$"), F.col("message_id")).alias("ident"), F.when(F.col("sender_name").rlike(_PLAIN_NAME), F.col("sender_name")).alias("name"),
        F.when(F.col("sender_address").rlike(_ADDRESS), F.col("sender_address")).alias("address"), plain("recipients").alias("to"), plain("cc").alias("cc"), F.date_format("date", "dd MMM yyyy HH:mm:ss '+0000'").alias("day"),
        F.coalesce("subject", F.lit("")).alias("subject"), F.coalesce("body", F.lit("")).alias("body"),
    )
    return flat_map(m, make, "name string, content binary, length long")


@query
def s2_mail_files(spark: SparkSession, root: str) -> DataFrame:
    x = parsed_mails(_archive(spark, root))
    return x.select("source_file", "message_id", "sender_name", "sender_address", F.array_join("recipients", ", ").alias("recipients"), F.array_join("cc", ", ").alias("cc"), F.date_format("date_local", "yyyy-MM-dd HH:mm:ss").alias("date"), "date_str", "subject", "body")


_OK = lambda c: f"CASE WHEN regexp_matches({c}, {lit(_ADDRESS)}) THEN {c} END"
_LIST = lambda c: f"array_to_string(list_filter(coalesce({c}, []), lambda a: regexp_matches(a, {lit(_ADDRESS)})), ', ')"
SQL["s2_mail_files"] = f"""WITH a AS (SELECT *, coalesce({_OK('sender_address')}, '') AS addr, coalesce(subject, '') AS sub, strftime(date, '%d %b %Y %H:%M:%S +0000') AS day FROM messages)
    SELECT delivery_id || '.eml' AS source_file, CASE WHEN regexp_matches(message_id, '^[!-~]+$') THEN message_id ELSE sha256(addr || '_' || sub || '_' || coalesce(day, 'None')) END AS message_id,
    CASE WHEN addr <> '' AND regexp_matches(sender_name, {lit(_PLAIN_NAME)}) THEN sender_name ELSE split_part(addr, '@', 1) END AS sender_name, addr AS sender_address, {_LIST('recipients')} AS recipients, {_LIST('cc')} AS cc,
    strftime(date, '%Y-%m-%d %H:%M:%S') AS date, coalesce(strftime(date, '%b %d'), '') AS date_str, sub AS subject, coalesce(body, '') AS body FROM a"""


@query
def s7_requests(spark: SparkSession, root: str) -> DataFrame:
    """Each delivery as a request of one mail; those with neither subject nor body as requests without mails."""
    m = table(spark, root, "messages")
    mail = F.struct("message_id", "subject", "body", "sender_name", F.col("sender_address").alias("sender_email"), "recipients", "cc", "date_str")
    mails = F.when(F.coalesce("subject", "body").isNotNull(), F.array(mail)).otherwise(F.slice(F.array(mail), 1, 0))
    lines = m.select(F.col("delivery_id").cast("string").alias("request_id"), F.to_json(F.struct(mails.alias("emails"))).alias("value"))
    x = parse_requests(lines)
    return x.select("request_id", "status", "message_id", "sender_name", "sender_address", F.array_join("recipients", ", ").alias("recipients"), "date_str", "subject", "body")


_CLEAN = lambda c: f"CASE WHEN gone THEN '' ELSE {steps(f'coalesce({c}, {lit(chr(0))[:1]}{chr(39)})', CONTROLS)} END"
_HELD = lambda c: f"CASE WHEN NOT gone THEN {c} END"
SQL["s7_requests"] = f"""SELECT delivery_id::VARCHAR AS request_id, CASE WHEN gone THEN 400 ELSE 200 END AS status, {_HELD('message_id')} AS message_id, {_CLEAN('sender_name')} AS sender_name, {_HELD('sender_address')} AS sender_address,
    {_HELD("array_to_string(recipients, ', ')")} AS recipients, {_HELD('date_str')} AS date_str, {_CLEAN('subject')} AS subject, {_CLEAN('body')} AS body FROM (SELECT *, subject IS NULL AND body IS NULL AS gone FROM messages)"""


def _crm(spark: SparkSession, root: str, by: str) -> DataFrame:
    m = table(spark, root, "messages")
    name = m.agg(F.min("thread_id")).first()[0]
    key, column = ("parent_id", "case_number") if by == "case" else ("related_to_id", "name")
    given = {"id": F.col("delivery_id").cast("string"), key: F.col("thread_id"), "from_name": F.col("sender_name"), "from_address": F.col("sender_address"), "to_address": F.array_join("recipients", " ; "), "cc_address": F.array_join("cc", ";"), "message_date": F.col("date").cast("timestamp"), "text_body": F.col("body"), "html_body": F.lit("<p>none</p>"), "subject": F.col("subject")}
    kinds = dict(f.split(" ") for f in CRM_MESSAGE.split(", "))
    messages = m.select(*[given.get(f, F.lit(None)).cast(k).alias(f) for f, k in kinds.items()])
    parents = m.select(F.col("thread_id").alias("id"), F.col("thread_id").alias(column)).distinct()
    x = from_tables(messages, parents, name, by)
    return x.select("message_id", "sender_name", F.array_join("recipients", ", ").alias("recipients"), F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"), "subject", F.md5("body").alias("body_md5"), "source_file")


@query
def s5_crm_case(spark: SparkSession, root: str) -> DataFrame:
    return _crm(spark, root, "case")


@query
def s6_crm_opportunity(spark: SparkSession, root: str) -> DataFrame:
    return _crm(spark, root, "opportunity")


for _name, _prefix in (("s5_crm_case", "SF-Case-"), ("s6_crm_opportunity", "SF-Opp-")):
    SQL[_name] = f"SELECT delivery_id::VARCHAR AS message_id, sender_name, array_to_string(list_filter(list_transform(coalesce(recipients, []), lambda a: trim(a)), lambda a: a <> ''), ', ') AS recipients, strftime(date, '%Y-%m-%d %H:%M:%S') AS date, subject, md5(CASE WHEN length(body) > 0 THEN body ELSE '<p>none</p>' END) AS body_md5, '{_prefix}' || thread_id AS source_file FROM messages WHERE thread_id = (SELECT min(thread_id) FROM messages)"


def _people(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {"People": table(spark, root, "people")}


@query
def k1_workbook(spark: SparkSession, root: str) -> DataFrame:
    """The people's sheet of a workbook, written and read."""
    held = io.BytesIO()
    write_xlsx(held, _people(spark, root))
    head, *rows = read_xlsx(held)["People"]
    return spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"{c} string" for c in head))


@query
def k2_document(spark: SparkSession, root: str) -> DataFrame:
    """The people's table of a document, written and read."""
    held = io.BytesIO()
    write_docx(held, _people(spark, root))
    head, *rows = read_docx(held)[0]
    return spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"{c} string" for c in head))


@query
def k5_json_file(spark: SparkSession, root: str) -> DataFrame:
    """The people's list of a JSON file, written and read."""
    import tempfile

    with tempfile.NamedTemporaryFile("r", suffix=".json", encoding="utf-8") as f:  # a file of the driver, read by nobody else
        write_json(f.name, _people(spark, root))
        rows = json.load(f)["People"]
    return spark.createDataFrame([tuple(r[c] or "" for c in SECTIONS["People"]) for r in rows], ", ".join(f"{c} string" for c in SECTIONS["People"]))


for _name in ("k1_workbook", "k2_document", "k5_json_file"):
    SQL[_name] = "SELECT " + ", ".join(f"coalesce({c}, '') AS {c}" for c in SECTIONS["People"]) + " FROM people"
