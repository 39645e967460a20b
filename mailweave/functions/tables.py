"""Table functions for SQL: SELECT m.mail_id, s.* FROM mails m, LATERAL mail_specs(m.body) s."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from mailweave.operators.specs import matches_of
from mailweave.sources.mailfiles import parse_eml


@udtf(returnType="match_ord int, category string, raw_match string, value string, unit string, context string", useArrow=True)
class MailSpecs:
    """Matches of one text; NULL has none."""

    def eval(self, text: str) -> Iterator[tuple]:
        if text:
            yield from matches_of(text)


@udtf(returnType="message_id string, sender_name string, sender_address string, recipients array<string>, subject string, body string")
class ParsedMail:
    """One mail file's content as a row; content that can't be parsed gives none."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        try:
            m = parse_eml(bytes(content), "")
        except Exception:  # noqa: BLE001
            return
        yield m[0], m[1], m[2], m[3], m[8], m[9]


def register(spark: SparkSession) -> None:
    spark.udtf.register("mail_specs", MailSpecs)
    spark.udtf.register("parsed_mail", ParsedMail)
