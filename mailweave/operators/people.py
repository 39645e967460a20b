"""People of a thread, from senders, recipients and copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailweave.functions.text import capitalise, strip
from mailweave.words import PROVIDERS, ROLE_KEYWORDS


def address_of(text: Column) -> Column:
    """The address of "Name <address>", or the text itself if it has an @, in lower case; "" if there is none."""
    inner = F.regexp_extract(text, "<([^>]+)>", 1)
    return F.coalesce(F.when(inner != "", F.lower(inner)).when(text.contains("@"), F.lower(strip(text))), F.lit(""))


def name_of(text: Column) -> Column:
    """The name before <, else the local part of the address in words, else the text."""
    before = F.regexp_replace(strip(F.split_part(text, F.lit("<"), F.lit(1))), "^\"+|\"+$", "")
    before = F.regexp_replace(before, "^'+|'+$", "")
    address = address_of(text)
    local = F.array_join(F.transform(F.split(F.split_part(address, F.lit("@"), F.lit(1)), "[._]"), capitalise), " ")
    return F.when(text.contains("<") & (before != ""), before).when(address != "", local).otherwise(strip(text))


def company_of(address: Column) -> Column:
    """The last label but one of the domain (the first for mail providers), capitalised; "" without @."""
    domain = F.lower(F.split_part(address, F.lit("@"), F.lit(2)))
    labels = F.split(domain, r"\.")
    label = F.when(domain.isin(PROVIDERS), F.get(labels, F.lit(0))).when(F.size(labels) >= 2, F.get(labels, F.size(labels) - 2)).otherwise(domain)
    return F.when(address.contains("@"), capitalise(label)).otherwise("")


def role_of(text: Column, roles: list[str] = ROLE_KEYWORDS) -> Column:
    """The first line with the first role word of the list that text has, if it is short, else the word; "" if there is none."""
    low = F.lower(text)
    lines = F.split(text, "\n", -1)

    def first_line(k: str) -> Column:
        named = F.transform(F.filter(lines, lambda l: F.lower(l).contains(k)), lambda l: strip(F.regexp_replace(strip(l), r"^[-|:]+|[-|:]+$", "")))
        return F.get(F.filter(named, lambda l: F.length(l) < 80), F.lit(0))

    out = F.lit("")
    for r in reversed(roles):
        k = r.lower()
        out = F.when(low.contains(k), F.coalesce(first_line(k), F.lit(k[:1].upper() + k[1:]))).otherwise(out)
    return F.coalesce(out, F.lit(""))


def mentions(mails: DataFrame) -> DataFrame:
    """(thread_id, mail_ord, mail_id, slot, text, is_sender): sender, recipients and copies of each mail in order.

    mails needs thread_id, mail_ord, mail_id, sender_name, sender_address, recipients and cc; NULLs are nobody.
    """
    none = F.array().cast("array<string>")
    others = F.concat(F.coalesce("recipients", none), F.coalesce("cc", none))
    sender = mails.select("thread_id", "mail_ord", "mail_id", F.lit(-1).alias("slot"), F.col("sender_address").alias("text"), F.lit(True).alias("is_sender"), "sender_name")
    rest = mails.select("thread_id", "mail_ord", "mail_id", F.posexplode(others).alias("slot", "text")).withColumns({"is_sender": F.lit(False), "sender_name": F.lit(None).cast("string")})
    x = sender.unionByName(rest).where(F.length("text") > 0)
    a = address_of(F.col("text"))
    return x.withColumn("address", F.when(a != "", a).otherwise(F.lower("text")))


def people_table(mails: DataFrame, specs: DataFrame | None = None) -> DataFrame:
    """(thread_id, address, name, company, role, mails_sent, specs_mentioned): a thread's people by address.

    The first mention decides name and role, so who is first seen as recipient has no role. specs needs mail_id and
    raw_match; without it nobody mentioned anything. All by grouped minima and counts, combined before the shuffle.
    """
    x = mentions(mails)
    first = x.groupBy("thread_id", "address").agg(F.min_by(F.struct("text", "is_sender", "sender_name", "mail_id"), F.struct("mail_ord", "mail_id", "slot")).alias("f"), F.min(F.struct("mail_ord", "mail_id", "slot")).alias("o"), F.count_if("is_sender").alias("mails_sent"))
    roles = mails.select("mail_id", role_of(F.coalesce("body", F.lit(""))).alias("role"))
    y = first.select("thread_id", "address", "o", "mails_sent", F.col("f.mail_id").alias("mail_id"), "f.is_sender", F.when(F.col("f.is_sender") & (F.length("f.sender_name") > 0), F.col("f.sender_name")).otherwise(name_of(F.col("f.text"))).alias("name"))
    y = y.join(roles, "mail_id", "left").withColumn("role", F.when(F.col("is_sender"), F.coalesce("role", F.lit(""))).otherwise(""))
    y = y.withColumn("company", company_of(F.col("address")))
    if specs is None:
        y = y.withColumn("specs_mentioned", F.lit(0).cast("bigint"))
    else:
        n = x.where("is_sender").select("thread_id", "address", "mail_id").join(specs.groupBy("mail_id").agg(F.count("*").alias("n")), "mail_id").groupBy("thread_id", "address").agg(F.sum("n").alias("specs_mentioned"))
        y = y.join(n, ["thread_id", "address"], "left").na.fill(0, ["specs_mentioned"])
    return y.select("thread_id", "address", "name", "company", "role", "mails_sent", "specs_mentioned")


def specs_of_people(mails: DataFrame, specs: DataFrame) -> DataFrame:
    """(thread_id, address, mail_ord, mail_id, match_ord, raw_match): what each sender mentioned, repetitions included; the list
    of a person is in order of the last four columns. Rows, not arrays: one person may have written a third of all mails.

    specs needs mail_id, match_ord and raw_match.
    """
    senders = mentions(mails).where("is_sender").select("thread_id", "address", "mail_ord", "mail_id")
    return senders.join(specs.select("mail_id", "match_ord", "raw_match"), "mail_id").select("thread_id", "address", "mail_ord", "mail_id", "match_ord", "raw_match")
