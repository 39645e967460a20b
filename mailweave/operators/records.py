"""Tables derived from specification and sentence records: timeline, conflicts, counts, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailweave.functions.text import capitalise, strip
from mailweave.session import cut_lineage


def number_of(value: Column) -> Column:
    """The value as a number without grouping commas; NULL if it isn't one."""
    return F.replace(value, F.lit(","), F.lit("")).try_cast("double")


def dated(specs: DataFrame, tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the timeline is made of: dated specifications, and dated unresolved sentences."""
    return specs.where(F.length("date_str") > 0), tagged.where((F.length("date_str") > 0) & F.col("is_unresolved"))


def timeline_span(specs: DataFrame, tagged: DataFrame) -> DataFrame:
    """(thread_id, first, last, n_events): the first and last date of each thread's timeline, in the timeline's order, and its length."""
    a, b = dated(specs, tagged)
    return a.select("thread_id", "date_str").unionByName(b.select("thread_id", "date_str")).groupBy("thread_id").agg(F.min("date_str").alias("first"), F.max("date_str").alias("last"), F.count("*").alias("n_events"))


def timeline(specs: DataFrame, tagged: DataFrame, chronological: bool = False) -> DataFrame:
    """(date, sentence, mentioned_by, kind, ord): dated specifications and dated unresolved sentences (cut to 120 characters).

    Ordered by the date's text, as displayed ("Apr 01" before "Mar 30"), or by month and day if chronological.
    """
    a, b = dated(specs, tagged)
    a = a.select(F.col("date_str").alias("date"), F.concat(F.lit("["), F.col("category"), F.lit("] "), F.col("raw_match")).alias("sentence"), "mentioned_by", F.lit("spec").alias("kind"), F.col("spec_id").alias("ord"))
    b = b.select(F.col("date_str").alias("date"), F.left("sentence", F.lit(120)).alias("sentence"), "mentioned_by", F.lit("tagged").alias("kind"), F.col("sentence_id").alias("ord"))
    x = a.unionByName(b)
    if chronological:
        months = F.create_map(*[F.lit(v) for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()) for v in (m, i + 1)])
        return x.orderBy(F.try_element_at(months, F.left("date", F.lit(3))), F.split_part("date", F.lit(" "), F.lit(2)).try_cast("int"), "kind", "ord")
    return x.orderBy("date", "kind", "ord")


def conflict_classes(specs: DataFrame) -> DataFrame:
    """(thread_id, subject, category, norm, num, unit, by, first_id, n): records that say the same, once, with their number.

    The key of a class is the normalised value, the unit and the person; a group's repetitions are combined before the shuffle.
    """
    v = F.coalesce(F.col("value"), F.lit(""))
    num = number_of(v)
    x = specs.where(F.length(strip(F.coalesce("subject", F.lit("")))) > 0).select(
        "thread_id", F.lower(strip(F.col("subject"))).alias("subject"), "category", F.when(num.isNotNull(), F.lit("")).otherwise(F.lower(strip(v))).alias("norm"), num.alias("num"),
        F.lower(strip(F.coalesce("unit", F.lit("")))).alias("unit"), F.coalesce("mentioned_by", F.lit("")).alias("by"), F.col("spec_id").alias("id"), v.alias("value"), F.coalesce("date_str", F.lit("")).alias("date"),
    )
    g = x.groupBy("thread_id", "subject", "category", "norm", "num", "unit", "by").agg(F.min(F.struct("id", "value", "date")).alias("f"), F.count("*").alias("n"))
    return g.select("thread_id", "subject", "category", "norm", "num", "unit", "by", F.col("f.id").alias("first_id"), F.col("f.value").alias("value"), F.col("f.date").alias("date"), "n")


def conflicts(specs: DataFrame) -> DataFrame:
    """Pairs of classes of one thread, subject and category that contradict each other, with severity.

    Values must differ (as numbers, else as text) and units agree or one be blank. The pair of (value, person) is reported
    once per thread, for its first group. Pairs are between classes, never between all records.
    """
    c = conflict_classes(specs)
    group = ["thread_id", "subject", "category"]
    c = c.join(c.groupBy(*group).agg(F.min("first_id").alias("group_ord")), group)
    a, b = c.select([F.col(x).alias(f"a_{x}") for x in c.columns]), c.select([F.col(x).alias(f"b_{x}") for x in c.columns])
    same = (F.col("a_thread_id") == F.col("b_thread_id")) & (F.col("a_subject") == F.col("b_subject")) & (F.col("a_category") == F.col("b_category")) & (F.col("a_first_id") < F.col("b_first_id"))
    differ = ~(F.col("a_num").eqNullSafe(F.col("b_num")) & (F.col("a_norm") == F.col("b_norm")))
    units = (F.col("a_unit") == "") | (F.col("b_unit") == "") | (F.col("a_unit") == F.col("b_unit"))
    p = a.join(b, same).where(differ & units)
    side = lambda s: F.concat(F.when(F.col(f"{s}_num").isNotNull(), F.concat(F.lit("#"), F.col(f"{s}_num").cast("string"))).otherwise(F.col(f"{s}_norm")), F.lit("_"), F.col(f"{s}_by"))
    p = p.withColumn("key", F.concat_ws("|", F.array_sort(F.array(side("a"), side("b")))))
    first = p.groupBy(F.col("a_thread_id").alias("thread_id"), "key").agg(F.min(F.struct("a_group_ord", "a_first_id", "b_first_id", F.struct(*[c for c in p.columns if c != "key"]).alias("row"))).alias("m")).select("m.row.*")
    pct = F.abs(F.col("a_num") - F.col("b_num")) / F.greatest(F.abs("a_num"), F.abs("b_num"), F.lit(1.0)) * 100
    severity = F.when(F.col("a_num").isNull() | F.col("b_num").isNull(), "medium").when(pct > 20, "high").when(pct < 5, "low").otherwise("medium")
    return first.select(
        F.col("a_thread_id").alias("thread_id"), F.col("a_category").alias("category"), capitalise(F.col("a_subject")).alias("subject"), F.col("a_first_id").alias("spec_a"), F.col("b_first_id").alias("spec_b"),
        F.col("a_value").alias("a_value"), F.col("a_unit").alias("a_unit"), F.col("a_by").alias("a_by"), F.col("a_date").alias("a_date"), F.col("b_value").alias("b_value"), F.col("b_unit").alias("b_unit"), F.col("b_by").alias("b_by"), F.col("b_date").alias("b_date"), severity.alias("severity"),
    )


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "n") -> DataFrame:
    """df with the row's number within its keys, from 1, in order; for keys that may hold a third of all rows.

    Rows are sorted by ranges, so one key may lie in many partitions; a row's number is its place in its partition and the
    counts of the key's earlier partitions, of which there are as many as partitions.
    """
    x = df.repartitionByRange(*keys, *order).withColumn("_mw_part", F.spark_partition_id())
    x = cut_lineage(x)  # which range a row falls into must not be sampled twice
    before = x.groupBy(*keys, "_mw_part").agg(F.count("*").alias("_mw_count"))
    before = before.withColumn("_mw_before", F.sum("_mw_count").over(Window.partitionBy(*keys).orderBy("_mw_part")) - F.col("_mw_count")).select(*[F.col(k).alias(f"_mw_k{i}") for i, k in enumerate(keys)], F.col("_mw_part").alias("_mw_p"), "_mw_before")
    x = x.withColumn(name, F.row_number().over(Window.partitionBy(*keys, "_mw_part").orderBy(*order)))
    same = F.col("_mw_part") == F.col("_mw_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_mw_k{i}"))
    return x.join(before, same).select(*df.columns, (F.col(name) + F.col("_mw_before")).alias(name))


def conflict_lines(found: DataFrame) -> DataFrame:
    """(thread_id, n, line): conflicts as numbered lines, the severe first."""
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    show = lambda s: strip(F.concat_ws(" ", f"{s}_value", f"{s}_unit"))
    line = F.format_string("[%s] %s (%s): %s by %s vs %s by %s", F.upper("severity"), "subject", "category", show("a"), "a_by", show("b"), "b_by")
    x = numbered(found.select("thread_id", rank.alias("rank"), "spec_a", "spec_b", line.alias("line")), ["thread_id"], ["rank", "spec_a", "spec_b"])
    return x.select("thread_id", "n", "line")


def category_counts(specs: DataFrame) -> DataFrame:
    return specs.groupBy("category").agg(F.count("*").alias("n"))


def specs_per_person(specs: DataFrame) -> DataFrame:
    return specs.where(F.length("mentioned_by") > 0).groupBy("mentioned_by").agg(F.count("*").alias("n"))


def values_by_category(specs: DataFrame) -> DataFrame:
    """(thread_id, category, values): the distinct "subject: value unit" of a thread's category in order of first mention.

    Distinct labels are found before they are gathered; the text of a category is as long as the report asks for.
    """
    val = strip(F.concat_ws(" ", F.coalesce("value", F.lit("")), F.coalesce("unit", F.lit(""))))
    label = F.when(F.length("subject") > 0, F.concat("subject", F.lit(": "), val)).otherwise(val)
    d = specs.select("thread_id", "category", "spec_id", label.alias("label")).groupBy("thread_id", "category", F.lower("label").alias("k")).agg(F.min(F.struct("spec_id", "label")).alias("f"))
    return d.groupBy("thread_id", "category").agg(F.array_join(F.transform(F.array_sort(F.collect_list("f")), lambda s: s["label"]), " · ").alias("values"), F.count("*").alias("n"))


def value_sets(specs: DataFrame, k: int = 6) -> DataFrame:
    """(thread_id, ord, category, line): the distinct values with units of each thread's first k categories, sorted and joined by " | ".

    Categories come in order of their first record. A record without value adds nothing, a category with no values no line,
    but it counts as one of the k.
    """
    val = strip(F.concat(F.coalesce("value", F.lit("")), F.lit(" "), F.coalesce("unit", F.lit(""))))
    d = specs.select("thread_id", "category", "spec_id", F.when(F.length("value") > 0, val).alias("val")).groupBy("thread_id", "category", "val").agg(F.min("spec_id").alias("id"))
    c = d.groupBy("thread_id", "category").agg(F.min("id").alias("id"), F.array_join(F.array_sort(F.collect_list("val")), " | ").alias("line"))  # distinct values, as long as the report
    w = Window.partitionBy("thread_id").orderBy("id", "category")  # a thread's categories, of which there are some twenty
    return c.withColumn("ord", F.row_number().over(w)).where((F.col("ord") <= k) & (F.length("line") > 0)).select("thread_id", "ord", "category", "line")


def counters(mails: DataFrame, specs: DataFrame, tagged: DataFrame) -> DataFrame:
    """One row of totals."""
    a = mails.agg(F.count("*").alias("n_mails"), F.countDistinct("thread_id").alias("n_threads"))
    b = specs.agg(F.count("*").alias("n_specs"), F.countDistinct("category").alias("n_categories"))
    c = tagged.agg(F.count("*").alias("n_tagged"), F.count_if("is_unresolved").alias("n_open"))
    return a.join(b, F.lit(True)).join(c, F.lit(True))  # three single rows


def filter_specs(specs: DataFrame, category: str | None = None, person: str | None = None, search: str | None = None) -> DataFrame:
    """Records of a category and person whose value, subject or category has the search text; None asks nothing."""
    x = specs
    if category:
        x = x.where(F.col("category") == category)
    if person:
        x = x.where(F.col("mentioned_by") == person)
    if search:
        s = search.lower()
        x = x.where(F.lower(F.coalesce("value", F.lit(""))).contains(s) | F.lower(F.coalesce("subject", F.lit(""))).contains(s) | F.lower("category").contains(s))
    return x


def top_open_items(tagged: DataFrame, k: int = 5, width: int = 150) -> DataFrame:
    """(mentioned_by, n, sentence): the first k unresolved sentences of each person, cut with an ellipsis."""
    w = Window.partitionBy("mentioned_by").orderBy("sentence_id")
    short = F.when(F.length("sentence") > width, F.concat(F.left("sentence", F.lit(width)), F.lit("..."))).otherwise(F.col("sentence"))
    return tagged.where("is_unresolved AND mentioned_by IS NOT NULL").withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).select("mentioned_by", "n", short.alias("sentence"))


def rate_limited(requests: DataFrame, key: str, ts: str, limit: int = 100, seconds: int = 60) -> DataFrame:
    """requests with accepted: at most `limit` accepted ones per key in any span of `seconds`; rejected ones don't count.

    Exact and sequential per key: rows are sorted by key and time within partitions and a bounded queue of `limit` times
    is carried along, so a hot key costs time of one task, not memory. NULL times are rejected.
    """
    from collections import deque
    from collections.abc import Iterator

    import pandas as pd

    cols = requests.columns
    x = requests.repartition(F.col(key)).sortWithinPartitions(key, F.col(ts).asc_nulls_last(), *[c for c in cols if c not in (key, ts)][:1])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, queue = object(), deque()
        for pdf in batches:
            out = []
            for k, t in zip(pdf[key].tolist(), pdf[ts].tolist()):
                if k != now:
                    now, queue = k, deque()
                if t is None or pd.isna(t):
                    out.append(False)
                    continue
                while queue and (t - queue[0]).total_seconds() >= seconds:
                    queue.popleft()
                ok = len(queue) < limit
                if ok:
                    queue.append(t)
                out.append(ok)
            yield pdf.assign(accepted=out)

    return x.mapInPandas(run, _with(requests, "accepted", "boolean"))


def _with(df: DataFrame, name: str, kind: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"`{name}` {kind}"])
