"""Streaming counterparts: the same operators on unbounded input, with state bounded by watermarks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from mailweave.operators.cleaning import PARAGRAPH_BREAK, drop_quoted_lines
from mailweave.operators.delivery_dedup import normal_id
from mailweave.operators.paragraphs import FEW_WORDS, FUZZY, SHORT, normalised, paragraph_hash, word_set
from mailweave.operators.people import address_of


def stream_table(spark: SparkSession, folder: str, schema: object, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def first_paragraphs(mails: DataFrame, ts: str, delay: str = "7 days") -> DataFrame:
    """(thread_id, h, ts): paragraphs of a stream that their thread hasn't had within the delay, by hash.

    mails needs thread_id, mail_id, body and ts. Paragraphs later than the watermark are dropped; those too short to count
    as repeated have no hash and aren't listed.
    """
    p = F.explode(F.split(drop_quoted_lines(F.col("body")), PARAGRAPH_BREAK, -1))
    x = mails.select("thread_id", ts, p.alias("paragraph")).withColumn("h", paragraph_hash(F.col("paragraph"))).where("h IS NOT NULL")
    return x.select("thread_id", "h", ts).withWatermark(ts, delay).dropDuplicatesWithinWatermark(["thread_id", "h"])


def deliveries_once(deliveries: DataFrame, ts: str = "received_at", delay: str = "30 days") -> DataFrame:
    """Each message of a stream of deliveries once, remembered for the delay; deliveries without identifier pass unchanged."""
    x = deliveries.withColumn("_mw_id", F.coalesce(normal_id(F.col("message_id")), F.concat(F.lit("#"), F.col("delivery_id").cast("string"))))
    return x.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["_mw_id"]).drop("_mw_id")


def first_mentions(mails: DataFrame, ts: str, delay: str = "7 days") -> DataFrame:
    """(thread_id, address, mail_id, text, is_sender, ts): each person of a thread once, by the first mention within the delay.

    mails needs the columns of people.mentions and ts. Of mentions that arrive in one batch any may be the first.
    """
    none = F.array().cast("array<struct<text:string,is_sender:boolean>>")
    others = F.transform(F.concat(F.coalesce("recipients", F.array().cast("array<string>")), F.coalesce("cc", F.array().cast("array<string>"))), lambda a: F.struct(a.alias("text"), F.lit(False).alias("is_sender")))
    sender = F.when(F.length("sender_address") > 0, F.array(F.struct(F.col("sender_address").alias("text"), F.lit(True).alias("is_sender")))).otherwise(none)
    x = mails.select("thread_id", "mail_id", ts, F.explode(F.concat(sender, others)).alias("m")).select("thread_id", "mail_id", ts, "m.text", "m.is_sender").where("length(text) > 0")
    a = address_of(F.col("text"))
    x = x.withColumn("address", F.when(a != "", a).otherwise(F.lower("text")))
    return x.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["thread_id", "address"])


def _stateful(df: DataFrame, key: str, ts: str, output: str, state: str, delay: str, step: Callable[[tuple, pd.DataFrame, tuple | None], tuple[pd.DataFrame, tuple, int]]) -> DataFrame:
    """df grouped by key through `step` (key, a batch's rows in order of time, state) -> (rows, state, milliseconds until which the state is needed)."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        rows = pd.concat(list(batches), ignore_index=True).sort_values(ts, kind="stable")
        out, new, until = step(key, rows, held.get if held.exists else None)
        held.update(new)
        held.setTimeoutTimestamp(max(until, held.getCurrentWatermarkMs() + 1))
        yield out

    return df.withWatermark(ts, delay).groupBy(key).applyInPandasWithState(run, output, state, "append", "EventTimeTimeout")


def rate_limited_stream(requests: DataFrame, key: str, ts: str, limit: int = 100, seconds: int = 60, delay: str = "1 minute") -> DataFrame:
    """requests with accepted, as records.rate_limited gives them, on a stream: exact for requests in order of batches.

    A client's state is its last `limit` accepted times, and is dropped when the watermark has passed them by `seconds`.
    """
    cols = requests.columns

    def step(k: tuple, rows: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple, int]:
        queue, out = list(state[0]) if state else [], []
        for t in rows[ts]:
            if pd.isna(t):
                out.append(False)
                continue
            now = int(t.value // 1000)
            queue = [q for q in queue if now - q < seconds * 1_000_000]
            out.append(len(queue) < limit)
            if out[-1]:
                queue.append(now)
        last = max(queue, default=0)
        return rows.assign(accepted=out)[[*cols, "accepted"]], (queue,), last // 1000 + seconds * 1000

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields)
    return _stateful(requests, key, ts, f"{kinds}, accepted boolean", "times array<bigint>", delay, step)


def distinct_paragraphs(mails: DataFrame, ts: str, threshold: float = FUZZY, delay: str = "7 days") -> DataFrame:
    """(thread_id, mail_id, paragraph, ts): paragraphs of a stream that aren't similar to one kept before in their thread, greedily in
    order of time; those too short to be compared are kept.

    A thread's state is the word sets of what it kept; it is dropped when the thread has been silent for the delay.
    """
    p = F.posexplode(F.split(drop_quoted_lines(F.col("body")), PARAGRAPH_BREAK, -1)).alias("para_ord", "paragraph")
    x = mails.select("thread_id", "mail_id", ts, p).where(F.length(F.trim("paragraph")) > 0)
    x = x.select("thread_id", "mail_id", "para_ord", "paragraph", ts, F.length(normalised(F.col("paragraph"))).alias("n"), F.array_join(F.array_sort(word_set(F.col("paragraph"))), " ").alias("words"))
    days = int(delay.split(" ")[0]) * {"day": 86_400_000, "hour": 3_600_000, "minute": 60_000}[delay.split(" ")[1].rstrip("s")]

    def step(k: tuple, rows: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple, int]:
        kept, keep = list(state[0]) if state else [], []
        sets = [set(w.split()) for w in kept]
        for n, words in zip(rows["n"], rows["words"]):
            w = set(words.split())
            small = n < SHORT
            similar = not small and len(w) >= FEW_WORDS and any(len(w & s) >= threshold * len(w | s) for s in sets)
            keep.append(not similar)
            if not similar and not small:
                kept.append(words)
                sets.append(w)
        return rows[keep][["thread_id", "mail_id", "paragraph", ts]], (kept,), int(rows[ts].max().value // 1_000_000) + days

    kind = mails.schema["mail_id"].dataType.simpleString()
    return _stateful(x, "thread_id", ts, f"thread_id string, mail_id {kind}, paragraph string, {ts} timestamp", "words array<string>", delay, step)


def window_counts(events: DataFrame, ts: str = "ts", window: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) in tumbling or sliding windows; works on batches and streams alike."""
    x = events.withWatermark(ts, delay) if events.isStreaming else events
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return x.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def session_counts(events: DataFrame, ts: str = "ts", gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n) of sessions that a gap ends."""
    x = events.withWatermark(ts, delay) if events.isStreaming else events
    return x.groupBy("user_id", F.session_window(ts, gap).alias("s")).agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def write_once(stream: DataFrame, path: str, checkpoint: str) -> object:
    """Append a stream to Parquet, all that is available, then stop; the checkpoint makes it exactly once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
