"""Summaries of threads as text, one row per thread."""

from __future__ import annotations

import json
import urllib.request

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailweave.operators.records import timeline_span, value_sets, values_by_category
from mailweave.operators.sentences import sentence_category


def _lines(df: DataFrame, order: str, text: str, name: str, k: int | None = None) -> DataFrame:
    """The texts of each thread, or the first k, joined by line feeds, with the thread's number of texts."""
    x = df.select("thread_id", F.col(order).alias("_r"), F.col(text).alias("t"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "t"))), lambda s: s["t"]), "\n").alias(name)
    if k is None:
        return x.groupBy("thread_id").agg(joined, F.count("*").alias(f"n_{name}"))  # df is computed once
    top = x.withColumn("_r", F.row_number().over(Window.partitionBy("thread_id").orderBy("_r"))).where(F.col("_r") <= k)
    return top.groupBy("thread_id").agg(joined).join(x.groupBy("thread_id").agg(F.count("*").alias(f"n_{name}")), "thread_id")


def thread_summary(mails: DataFrame, specs: DataFrame, tagged: DataFrame, people: DataFrame, items: int = 5, events: DataFrame | None = None) -> DataFrame:
    """(thread_id, summary): overview, organisations, specifications by category, participants, open items, span of dates.

    All categories and all who sent mails are listed, with role and number of specifications; of the open items the first
    `items`, with their flags and the number of the others. Dates and events are those of the timeline over specs and events
    (tagged if none are given).

    Sets are sorted, so the text doesn't depend on the run. A thread without mails has no row; missing parts are left out,
    and without open items the summary says so.
    """
    head = mails.groupBy("thread_id").agg(F.count("*").alias("n_mails"), F.countDistinct(F.when(F.length("subject") > 0, F.col("subject"))).alias("n_subjects"), F.min(F.when(F.length("subject") > 0, F.col("subject"))).alias("subject"))
    n_specs = specs.groupBy("thread_id").agg(F.count("*").alias("n_specs"))
    n_people = people.groupBy("thread_id").agg(F.count("*").alias("n_persons"))
    orgs = people.where("length(company) > 0").select("thread_id", "company").distinct().groupBy("thread_id").agg(F.array_join(F.array_sort(F.collect_list("company")), ", ").alias("orgs"))  # distinct companies
    cats = _lines(values_by_category(specs).withColumn("line", F.concat(F.lit("- **"), F.col("category"), F.lit(":** "), F.col("values"))), "category", "line", "cats")
    for c, nothing in (("role", F.lit("")), ("specs_mentioned", F.lit(0))):
        if c not in people.columns:
            people = people.withColumn(c, nothing)
    part = lambda c, text: F.when(c, text).otherwise("")
    line = F.concat(
        F.lit("- **"), F.coalesce("name", F.lit("Unknown")), F.lit("**"), part(F.length("company") > 0, F.concat(F.lit(" ("), "company", F.lit(")"))), part(F.length("role") > 0, F.concat(F.lit(" — "), "role")),
        F.lit(" — "), F.col("mails_sent").cast("string"), F.lit(" mail(s)"), part(F.col("specs_mentioned") > 0, F.concat(F.lit(", mentioned "), F.col("specs_mentioned").cast("string"), F.lit(" spec(s)"))),
    )
    who = _lines(people.where("mails_sent > 0").select("thread_id", F.format_string("%012d%s", 999999999999 - F.col("mails_sent"), "address").alias("o"), line.alias("line")), "o", "line", "people")
    short = F.when(F.length("sentence") > 150, F.concat(F.left("sentence", F.lit(150)), F.lit("..."))).otherwise(F.col("sentence"))
    flags = F.coalesce(F.concat(F.lit(" — flags: "), F.nullif(F.array_join("trigger_keywords", ", "), F.lit(""))), F.lit("")) if "trigger_keywords" in tagged.columns else F.lit("")
    open_ = _lines(tagged.where("is_unresolved").select("thread_id", "ord", F.concat(F.lit("- "), short, F.lit(" ("), F.coalesce("mentioned_by", F.lit("")), F.lit(")"), flags).alias("line")), "ord", "line", "open", items)
    dates = timeline_span(specs, tagged if events is None else events)
    x = head
    for side in (n_specs, n_people, orgs, cats, who, open_, dates):
        x = x.join(side, "thread_id", "left")
    num = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    topic = F.when(F.col("n_subjects") == 1, F.col("subject")).otherwise(F.concat(F.col("n_subjects").cast("string"), F.lit(" topics")))
    more = F.when(F.col("n_open") > items, F.concat(F.lit("\n... and "), (F.col("n_open") - items).cast("string"), F.lit(" more"))).otherwise("")
    text = F.concat_ws(
        "\n",
        F.lit("## Executive Summary"), F.concat(F.lit("**Thread:** "), topic, F.lit(" | **Mails:** "), num("n_mails"), F.lit(" | **Participants:** "), num("n_persons"), F.lit(" | **Specs:** "), num("n_specs"), F.lit(" | **Open:** "), num("n_open")),
        F.concat(F.lit("**Organizations:** "), "orgs"), F.concat(F.lit("### Key Specifications\n"), "cats"), F.concat(F.lit("### Participants\n"), "people"),
        F.when(F.col("open").isNotNull(), F.concat(F.lit("### Action Items ("), num("n_open"), F.lit(")\n"), "open", more)).otherwise("### No Open Items\nAll items appear resolved."),
        F.when(F.col("first").isNotNull(), F.concat(F.lit("### Timeline ("), F.col("n_events").cast("string"), F.lit(" events)\n"), "first", F.lit(" to "), "last")),
    )
    return x.select("thread_id", text.alias("summary"))


def extractive_summary(mails: DataFrame, specs: DataFrame, tagged: DataFrame, people: DataFrame, chosen: DataFrame, items: int = 3) -> DataFrame:
    """(thread_id, summary): header with participants and up to three organisations, the values of the first six categories, two
    decisions among the thread's best sentences, three open items with the number of the others.

    chosen has the thread's best sentences (thread_id, sent_id, sentence), as ranking.diverse_top gives them. Sets are sorted.
    Missing parts are left out; a thread with none says so. A thread without mails has no row.
    """
    head = mails.groupBy("thread_id").agg(F.count("*").alias("n_mails"))
    n_people = people.groupBy("thread_id").agg(F.count("*").alias("n_people"))
    orgs = people.where("length(company) > 0 AND company <> 'Unknown'").select("thread_id", "company").distinct().groupBy("thread_id").agg(F.count("*").alias("n_orgs"), F.array_sort(F.collect_list("company")).alias("o"))
    orgs = orgs.select("thread_id", F.concat(F.lit(" across "), F.col("n_orgs").cast("string"), F.lit(" organization(s) ("), F.array_join(F.slice("o", 1, 3), ", "), F.lit(")")).alias("orgs"))
    cats = _lines(value_sets(specs).withColumn("line", F.concat(F.lit("- **"), "category", F.lit(":** "), "line")), "ord", "line", "cats")
    best = _lines(decisions(chosen).withColumn("line", F.concat(F.lit('- "'), "sentence", F.lit('"'))), "ord", "line", "best")
    bare = F.regexp_replace("sentence", r"^[>\s]+", "")
    open_ = _lines(tagged.where("is_unresolved").select("thread_id", "ord", F.concat(F.lit("- "), bare, F.lit(" *(Asked by "), F.coalesce(F.nullif("mentioned_by", F.lit("")), F.lit("Unknown")), F.lit(")*")).alias("line")), "ord", "line", "open", items)
    some = specs.select("thread_id").distinct().withColumn("has_specs", F.lit(True))
    x = head
    for side in (n_people, orgs, cats, best, open_, some):
        x = x.join(side, "thread_id", "left")
    more = F.when(F.col("n_open") > items, F.concat(F.lit("\n- *...and "), (F.col("n_open") - items).cast("string"), F.lit(" more unresolved item(s).*"))).otherwise("")
    text = F.concat_ws(
        "\n",
        F.lit("### Executive Engineering Summary"),
        F.concat(F.lit("This thread contains **"), F.col("n_mails").cast("string"), F.lit(" mails** with **"), F.coalesce("n_people", F.lit(0)).cast("string"), F.lit(" participants**"), F.coalesce("orgs", F.lit("")), F.lit(".")),
        F.concat(F.lit("**Finalized / Proposed Specifications:**\n"), "cats"), F.concat(F.lit("**Key Agreements & Statements:**\n"), "best"), F.concat(F.lit("**Pending Action Items & Questions:**\n"), "open", more),
        F.when(F.col("has_specs").isNull() & F.col("open").isNull() & F.col("best").isNull(), "*No specific engineering parameters or action items were identified in this thread.*"),
    )
    return x.select("thread_id", text.alias("summary"))


def decisions(top: DataFrame, k: int = 2) -> DataFrame:
    """(thread_id, ord, sentence): the first k decision sentences among a thread's best, without quote marks, cut to 200."""
    w = Window.partitionBy("thread_id").orderBy("sent_id")
    bare = F.regexp_replace("sentence", r"^[>\s]+", "")
    cut = F.when(F.length(bare) > 200, F.concat(F.left(bare, F.lit(200)), F.lit("..."))).otherwise(bare)
    return top.where(sentence_category(F.col("sentence")) == "decision").withColumn("ord", F.row_number().over(w)).where(F.col("ord") <= k).select("thread_id", "ord", cut.alias("sentence"))


#: What the prompt holds of a thread: so many mails, cut to so many characters.
PROMPT_MAILS, PROMPT_CHARS = 15, 1500


def prompts(mails: DataFrame) -> DataFrame:
    """(thread_id, prompt): the thread's first mails as text for a language model. mails needs mail_ord and mail_id."""
    one = F.concat(F.lit("From: "), F.coalesce("sender_name", F.lit("Unknown")), F.lit("\nSubject: "), F.coalesce("subject", F.lit("Unknown")), F.lit("\nBody:\n"), F.left(F.coalesce("body", F.lit("")), F.lit(PROMPT_CHARS)), F.lit("..."))
    w = Window.partitionBy("thread_id").orderBy("mail_ord", "mail_id")
    top = mails.withColumn("r", F.row_number().over(w)).where(F.col("r") <= PROMPT_MAILS)
    return top.groupBy("thread_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", one.alias("t")))), lambda s: s["t"]), "\n---\n").alias("prompt"))


def split_thinking(answer: object) -> tuple[object, object]:
    """(thinking, answer without it) of a model's text with <think>...</think>."""
    return F.regexp_extract(answer, r"(?s)<think>(.*?)</think>", 1), F.trim(F.regexp_replace(answer, r"(?s)<think>.*?</think>", ""))


class OfflineModel:
    """The interface of a language model; this one isn't reachable and says so."""

    def complete(self, prompt: str) -> str:
        return "The local model isn't reachable."


class LocalModel:
    """A model server on this network: POST {model, prompt} to /api/generate. It is asked first whether it is there; what goes wrong
    is told in the answer instead of ending the job."""

    def __init__(self, url: str = "http://localhost:11434", model: str = "llama3", probe_seconds: float = 2, seconds: float = 36_000) -> None:
        self.url, self.model, self.probe_seconds, self.seconds = url, model, probe_seconds, seconds

    def reachable(self) -> bool:
        try:
            with urllib.request.urlopen(self.url, timeout=self.probe_seconds) as r:
                return r.status == 200
        except (OSError, ValueError):
            return False

    def complete(self, prompt: str) -> str:
        if not self.reachable():
            return f"The local model isn't reachable at {self.url}."
        body = json.dumps({"model": self.model, "prompt": prompt, "stream": False}).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(f"{self.url}/api/generate", body, {"Content-Type": "application/json"}), timeout=self.seconds) as r:
                return json.loads(r.read()).get("response", "The model gave no response.")
        except TimeoutError:
            return "The local model took too long to respond."
        except (OSError, ValueError) as e:
            return f"The local model failed: {e}"


def model_summaries(mails: DataFrame, model: object | None = None) -> DataFrame:
    """(thread_id, answer): a model's answer to each thread's prompt; `model` needs complete(prompt) and must pickle."""
    from mailweave.functions.arrow import flat_map

    m = model or OfflineModel()
    return flat_map(prompts(mails), lambda: lambda t, p: [(t, m.complete(p))], "thread_id string, answer string")
