"""Mail files as DataFrames: .eml, and .msg where the optional reader is installed.

Files are read as binary and parsed in Arrow batches on the executors; a file that can't be parsed becomes a row with
`error`, which the default mode drops and FAILFAST raises.
"""

from __future__ import annotations

import email
import email.header
import email.message
import email.utils
import hashlib
import os
import re
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from mailweave.functions.arrow import flat_map
from mailweave.operators.cleaning import html_to_text
from mailweave.sources.schemas import MAIL

#: Larger uploads are refused; folders have no limit.
MAX_BYTES = 50 * 1024 * 1024
# Date formats tried after the standard one.
DATE_FORMATS = ["%d %b %Y %H:%M:%S", "%Y-%m-%d %H:%M:%S", "%d/%m/%Y %H:%M:%S", "%d/%m/%Y %H:%M"]


def parse_date(text: str | None) -> tuple[datetime | None, datetime | None]:
    """(instant in UTC, wall clock of the header) of a date header; NULLs if it can't be read. No zone means UTC."""
    if not text:
        return None, None
    try:
        d = email.utils.parsedate_to_datetime(text)
    except (ValueError, TypeError, IndexError):
        d = None
        for f in DATE_FORMATS:
            try:
                d = datetime.strptime(text.strip(), f)
                break
            except ValueError:
                continue
    if d is None:
        return None, None
    wall = d.replace(tzinfo=None)
    return (d.astimezone(timezone.utc) if d.tzinfo else d.replace(tzinfo=timezone.utc)), wall


def addresses(header: str | None) -> list[str]:
    """ "Name <address>" or the address for each entry; entries without address are dropped."""
    pairs = email.utils.getaddresses([str(header)]) if header else []
    return [f"{n} <{a}>" if n else a for n, a in pairs if a]


def _text(part: email.message.Message) -> str:
    raw = part.get_payload(decode=True) or b""
    try:
        return raw.decode(part.get_content_charset() or "utf-8", "replace")
    except LookupError:
        return raw.decode("utf-8", "replace")


def body_of(msg: email.message.Message) -> tuple[str, bool]:
    """(text, whether it is HTML): the first plain part that isn't empty or an attachment, else the first HTML part."""
    if not msg.is_multipart():
        return _text(msg), msg.get_content_type() == "text/html"
    page = None
    for part in msg.walk():
        if part.is_multipart() or "attachment" in str(part.get("Content-Disposition", "")).lower():
            continue
        if part.get_content_type() == "text/plain" and (t := _text(part)).strip():
            return t, False
        if part.get_content_type() == "text/html" and page is None:
            page = _text(part)
    return (page, True) if page is not None else ("", False)


def attachments_of(msg: email.message.Message) -> list[str]:
    if not msg.is_multipart():
        return []
    return [p.get_filename() or f"[unnamed {p.get_content_type()}]" for p in msg.walk() if "attachment" in str(p.get("Content-Disposition", "")).lower()]


def parse_eml(content: bytes, name: str) -> tuple:
    msg = email.message_from_bytes(content)
    who, address = email.utils.parseaddr(str(msg.get("From", "")))
    text, page = body_of(msg)
    date, wall = parse_date(msg.get("Date"))
    subject = str(email.header.make_header(email.header.decode_header(msg.get("Subject", "")))) if msg.get("Subject") else ""
    ident = msg.get("Message-ID") or hashlib.sha256(f"{address}_{subject}_{msg.get('Date')}".encode()).hexdigest()
    return (ident.strip(), who or address.split("@")[0], address, addresses(msg.get("To")), addresses(msg.get("Cc")), date, wall, wall.strftime("%b %d") if wall else "", subject, text, name, attachments_of(msg), "html" if page else None)


def parse_msg(content: bytes, name: str) -> tuple:
    import extract_msg  # optional; a missing reader is an error of the row

    m = extract_msg.openMsg(content)
    sender = str(m.sender or "")
    split = lambda s: [x.strip() for x in str(s or "").split(";") if x.strip()]
    address = re.search(r"<([^>]+)>", sender)
    date, wall = parse_date(str(m.date) if m.date else None)
    ident = hashlib.sha256(f"{sender}_{m.subject}_{m.date}".encode()).hexdigest()
    return (ident, sender.split("<")[0].strip(), address[1] if address else sender, split(m.to), split(m.cc), date, wall, wall.strftime("%b %d") if wall else "", m.subject or "", m.body or "", name, [], None)


def read_mail_files(spark: SparkSession, folder: str, kind: str = "eml", mode: str = "DROPMALFORMED", max_bytes: int | None = None, in_order: bool = False) -> DataFrame:
    """The mails of a folder (not its subfolders) in the MAIL schema; in_order sorts them by file name.

    mode DROPMALFORMED leaves out files that can't be parsed, PERMISSIVE keeps them with error, FAILFAST raises. Files
    larger than max_bytes are malformed; without it no size is. An empty folder gives no rows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{kind}").option("recursiveFileLookup", "false").load(folder)
    mails = parsed_mails(files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "content", "length"), kind, mode, max_bytes)
    return mails.orderBy("source_file") if in_order else mails


def parsed_mails(files: DataFrame, kind: str = "eml", mode: str = "DROPMALFORMED", max_bytes: int | None = None) -> DataFrame:
    """The same from rows (name, content binary, length) of any origin: an archive's table, a stream of files."""
    parse = {"eml": parse_eml, "msg": parse_msg}[kind]
    too_large = F.lit(False) if max_bytes is None else F.col("length") > max_bytes
    x = files.select("name", F.when(~too_large, F.col("content")).alias("content"), F.col("length").cast("long").alias("length"))

    def make() -> object:
        def one(name: str, content: bytes | None, length: int) -> list[tuple]:
            try:
                if content is None:
                    raise ValueError(f"{length} bytes are more than {max_bytes}")
                return [parse(content, name)]
            except Exception as e:  # noqa: BLE001
                if mode == "FAILFAST":
                    raise
                return [(None, None, None, [], [], None, None, None, None, None, name, [], f"{type(e).__name__}: {e}")]

        return one

    mails = flat_map(x, make, MAIL)
    page = F.col("error").eqNullSafe("html")
    mails = mails.withColumn("body", F.when(page, html_to_text(F.col("body"))).otherwise(F.col("body"))).withColumn("error", F.when(~page, F.col("error")))
    return mails if mode == "PERMISSIVE" else mails.where("error IS NULL")


def read_uploads(spark: SparkSession, folder: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """All mail files of a folder of uploads, each error captured in its row."""
    return read_mail_files(spark, folder, "eml", "PERMISSIVE", max_bytes).unionByName(read_mail_files(spark, folder, "msg", "PERMISSIVE", max_bytes))


class MailFileReader(DataSourceReader):
    """One partition a file."""

    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        folder, kind = self.options["path"], self.options.get("kind", "eml")
        return [InputPartition(os.path.join(folder, n)) for n in sorted(os.listdir(folder)) if n.endswith(f".{kind}")] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is not None:
            parse = parse_msg if partition.value.endswith(".msg") else parse_eml
            with open(partition.value, "rb") as f:
                yield parse(f.read(), os.path.basename(partition.value))


class MailFileSource(DataSource):
    """spark.dataSource.register(MailFileSource); spark.read.format("mail").option("kind", "eml").load(folder): the rows of parse_eml,
    for folders that all executors see; HTML bodies stay HTML, with "html" in error. A file that can't be parsed ends the read."""

    @classmethod
    def name(cls) -> str:
        return "mail"

    def schema(self) -> str:
        return MAIL

    def reader(self, schema: object) -> MailFileReader:
        return MailFileReader(dict(self.options))
