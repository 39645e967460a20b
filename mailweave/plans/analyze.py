"""The whole pipeline: mails in, sections of the report out as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailweave.operators import cleaning, paragraphs, people, records, sentences, specs, summary
from mailweave.session import cut_lineage
from mailweave.sources.config import DEFAULTS


def ordered(mails: DataFrame, thread: str | Column = "all") -> DataFrame:
    """Mails of the MAIL schema with thread_id, mail_id (the file; in a CRM the record and the message) and mail_ord (the instant; mails without date come first)."""
    t = F.lit(thread) if isinstance(thread, str) else thread
    ident = F.when(F.col("source_file").startswith("SF-"), F.concat_ws("|", "source_file", "message_id")).otherwise(F.col("source_file"))
    return mails.select("*", t.alias("thread_id"), ident.alias("mail_id"), F.coalesce(F.unix_micros(F.col("date").cast("timestamp")), F.lit(-(2**62))).alias("mail_ord"))


def with_token_windows(found: DataFrame, mails: DataFrame) -> DataFrame:
    """found and the token windows' quantities whose category, value and unit it doesn't have, after it in each mail; their context is the mail's
    first sentence that holds the number, their subject the model's or the nearest subject word."""
    more = specs.hybrid(found, specs.model_matches(mails), extra=["token_ord", "subject"]).where("origin = 'tokens'")
    split = mails.select("mail_id", sentences.split_sentences(F.col("body")).alias("s"))
    more = more.join(split, "mail_id").withColumn("context", F.coalesce(F.get(F.filter("s", lambda s: s.contains(F.col("value"))), F.lit(0)), F.lit("")))
    subject = F.when(F.length("subject") > 0, F.col("subject")).otherwise(specs.subject_of(F.col("context"), F.col("value")))
    return found.unionByName(more.select("mail_id", (F.col("token_ord") + 500_000).cast("int").alias("match_ord"), "category", "raw_match", "value", "unit", "context", subject.alias("subject")))


def analyze(mails: DataFrame, config: dict | None = None, whole_words: bool = False, extractor: str = "regex") -> dict[str, DataFrame]:
    """Sections by name: Mails (cleaned), People, Specifications, Eng Sentences, Unresolved, Timeline, Conflicts, Summary.

    mails needs thread_id, mail_ord, mail_id (unique), sender_name, sender_address, recipients, cc, subject, body, date_str and
    source_file. Bodies are cleaned, then lose paragraphs that their thread had before and similar ones within the mail. No
    mails give empty sections. extractor "hybrid" adds the quantities that the token windows find beside those of the patterns,
    with the subject of the language model where one is installed. The cleaned mails and the specifications have several readers and are checkpointed.
    """
    c = {**DEFAULTS, **(config or {})}
    body = cleaning.clean_body(F.coalesce("body", F.lit("")), c["signature_markers"], c["disclaimer_phrases"])
    cleaned = mails.withColumn("body", body)
    kept = paragraphs.fuzzy_within_mail(paragraphs.first_occurrences(paragraphs.paragraphs(cleaned)))
    m = cut_lineage(cleaned.drop("body").join(paragraphs.rebuilt_bodies(cleaned, kept), "mail_id"))  # six readers
    who = m.select("mail_id", "thread_id", "mail_ord", F.col("sender_name").alias("mentioned_by"), F.col("sender_address").alias("mentioned_address"), F.coalesce("date_str", F.lit("")).alias("date_str"), "source_file")
    place = lambda n: F.format_string("%020d|%s|%06d", F.col("mail_ord") + F.lit(2**62), "mail_id", n)
    found = specs.extract_specs(m, materials=c["materials"], whole_words=whole_words)
    if extractor == "hybrid":
        found = with_token_windows(cut_lineage(found), m)
    found = cut_lineage(found.join(who, "mail_id").withColumn("spec_id", place("match_ord")))
    tagged = sentences.tag_sentences(m, keywords=c["engineering_keywords"], markers=c["unresolved_markers"]).join(who, "mail_id").withColumn("sentence_id", place("sent_ord"))
    open_ = sentences.open_items(m, markers=c["unresolved_markers"], keywords=c["engineering_keywords"]).join(who, "mail_id")
    open_ = open_.withColumn("ord", place("sent_ord")).withColumn("trigger_keywords", F.array("marker")).withColumn("is_unresolved", F.lit(True))
    persons = people.people_table(m, found)
    return {
        "Mails": m, "People": persons, "Specifications": found, "Eng Sentences": tagged, "Unresolved": open_, "Timeline": records.timeline(found, tagged), "Conflicts": records.conflicts(found),
        "Summary": summary.thread_summary(m, found, open_, persons, events=tagged),
    }
