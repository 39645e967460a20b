"""One UTC instant out of mixed timestamp texts (problem 3).

A text matches at most one family of formats; within the family of numeric dates the three orders of day, month and
year are the mixture's components. Expectation-maximisation per source learns their weights: a value adds its likelihood
under each of its valid parses, the declared order of the source is the prior. The posterior picks the parse; if none is
clear the value is marked ambiguous instead of guessed silently.

The prior is worth a multiple of the source's own values, not a fixed number of them: the same shares give the same
weights at every size, and a declared order keeps the upper hand. What speaks against it lowers the posterior instead.

All of it runs in the JVM. A source's values enter the EM only as counts by "which orders are valid"
(seven numbers per source), so a source that holds a third of all rows costs one partial aggregate.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Offsets in minutes of the zone abbreviations in use.
ZONE_MINUTES = {
    "UTC": 0, "GMT": 0, "UT": 0, "Z": 0, "WET": 0, "BST": 60, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120,
    "EEST": 180, "MSK": 180, "IST": 330, "JST": 540, "AEST": 600, "AEDT": 660, "BRT": -180, "BRST": -120,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9})\d*)?)?"
_ZONE = r"(Z|[+-]\d{2}(?::?\d{2})?|[A-Za-z]{2,5}|[A-Za-z]+/[A-Za-z_]+(?:/[A-Za-z_]+)?)?"
_NOTE = r"(?:\s*\([^)]*\))?"
#: family -> (pattern, template of "first|second|third|hour|minute|second|fraction|half|zone")
FAMILIES = {
    "rfc": (rf"^(?:[A-Za-z]{{3,9}},?\s+)?(\d{{1,2}})[ -]([A-Za-z]{{3}})[a-z]*\.?[ -](\d{{4}}|\d{{2}})\s+{_TIME}\s*{_ZONE}{_NOTE}$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    "iso": (rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})[T ]{_TIME}\s*{_ZONE}{_NOTE}$", "$3|$2|$1|$4|$5|$6|$7||$8"),
    "named": (rf"^(?:[A-Za-z]{{3,9}},?\s+)?([A-Za-z]{{3}})[a-z]*\.? (\d{{1,2}}),? (\d{{4}}),?\s+{_TIME}\s*([AaPp][Mm])?\s*{_ZONE}{_NOTE}$", "$2|$1|$3|$4|$5|$6|$7|$8|$9"),
    "slash": (rf"^(\d{{1,4}})/(\d{{1,2}})/(\d{{1,4}}),?\s+{_TIME}\s*([AaPp][Mm])?\s*{_ZONE}{_NOTE}$", "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    "dots": (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}|\d{{2}}),?\s+{_TIME}\s*{_ZONE}{_NOTE}$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    "compact": (r"^(\d{4})(\d{2})(\d{2})T?(\d{2})(\d{2})(\d{2})?(Z|[+-]\d{2}:?\d{2})?$", "$3|$2|$1|$4|$5|$6|||$7"),
}


def _zone_minutes(zone: Column) -> Column:
    """Minutes of a numeric or lettered offset; NULL for a region name or none."""
    letters = F.create_map(*[F.lit(x) for kv in ZONE_MINUTES.items() for x in kv])
    sign = F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1)
    digits = F.rpad(F.regexp_replace(zone, "[^0-9]", ""), 4, "0")
    numeric = sign * (F.substring(digits, 1, 2).cast("int") * 60 + F.substring(digits, 3, 2).cast("int"))
    return F.when(zone.rlike(r"^[+-]\d{2}"), numeric).otherwise(F.try_element_at(letters, F.upper(zone)))


def _valid(day: Column, month: Column) -> Column:
    return day.between(1, 31) & month.between(1, 12)


def parsed_fields(df: DataFrame, text: str) -> DataFrame:
    """df with _mw_family and _mw_p, the array of the nine matched pieces (both NULL where no family matches)."""
    bare = F.regexp_replace(F.col(text), r"^(?U)[\s]+|[\s]+$", "")
    digits = F.when(bare.rlike(r"^\d{9,11}$"), "epoch_s").when(bare.rlike(r"^\d{13}$"), "epoch_ms").when(bare.rlike(r"^\d{16}$"), "epoch_us")
    family, shape = digits, F.when(digits.isNotNull(), bare)
    for name, (pattern, template) in FAMILIES.items():
        hit = bare.rlike(pattern)
        family = F.coalesce(family, F.when(hit, name))
        shape = F.coalesce(shape, F.when(hit, F.regexp_replace(bare, pattern, template)))
    return df.withColumn("_mw_shape", shape).withColumn("_mw_family", family).withColumn("_mw_p", F.split("_mw_shape", r"\|")).drop("_mw_shape")


#: A directory of at most so many sources (some 100 bytes each) is sent to the rows; a larger one is joined by shuffle.
BROADCAST_SOURCES = 100_000
#: Orders of numeric dates: name -> places of day, month and year among the three numbers.
ORDERS = {"dmy": (0, 1, 2), "mdy": (1, 0, 2), "ymd": (2, 1, 0)}


def order_valid(pieces: Column) -> dict[str, Column]:
    """For each order whether the first three pieces can be read in it: day and month in range, a year of two or four digits."""
    piece = lambda i: F.get(pieces, F.lit(i))
    out = {}
    for name, (d, m, y) in ORDERS.items():
        short = (F.length(piece(d)) <= 2) & (F.length(piece(m)) <= 2) & F.length(piece(y)).isin(2, 4)
        out[name] = F.coalesce(short & _valid(piece(d).try_cast("int"), piece(m).try_cast("int")), F.lit(False))
    return out


def order_weights(parsed: DataFrame, source: str, directory: DataFrame, order_col: str, prior: float = 9.0, rounds: int = 500) -> DataFrame:
    """(source, _mw_w): weights of the orders of numeric dates of each source of the directory, by EM.

    The statistics are the numbers of values by the set of orders in which they are valid. The declared order is worth
    `prior` times the source's values; a source without declaration starts even, with one value's worth for each order.
    Rounds end when no weight moves any more (the last rounds then change nothing), after `rounds` at most.
    """
    valid = order_valid(F.col("_mw_p"))
    masks = [[k for i, k in enumerate(ORDERS) if n >> i & 1] for n in range(1, 8)]
    which = sum((F.when(valid[k], 1 << i).otherwise(0) for i, k in enumerate(ORDERS)), F.lit(0))
    numeric = parsed.where("_mw_family = 'slash'").select(source, which.alias("_mw_mask"))
    counts = numeric.groupBy(source).agg(*[F.count_if(F.col("_mw_mask") == n).alias("n_" + "_".join(m)) for n, m in enumerate(masks, 1)])
    names = ["n_" + "_".join(m) for m in masks]
    both = directory.select(F.col(source), F.col(order_col).alias("_mw_order")).join(counts, source, "left").na.fill(0, names)
    n = sum((F.col(c) for c in names), F.lit(0.0))
    declared = F.col("_mw_order").isin(*ORDERS)
    pseudo = {k: F.when(F.col("_mw_order") == k, prior * (n + 1)).when(declared, 0.0).otherwise(1.0) for k in ORDERS}
    total = sum(pseudo.values(), n)
    start = F.struct(*[((pseudo[k] + 1) / (sum(pseudo.values(), F.lit(0.0)) + 3)).alias(k) for k in ORDERS])

    def step(w: Column, _: Column) -> Column:
        # E: a value counts for each order in which it is valid by the order's share of the weight; M: a weight is the mean of its counts
        share = {m: F.col(c) / F.greatest(sum((w[k] for k in mask), F.lit(0.0)), F.lit(1e-300)) for m, (c, mask) in enumerate(zip(names, masks))}
        return F.struct(*[((pseudo[k] + w[k] * sum((share[m] for m, mask in enumerate(masks) if k in mask), F.lit(0.0))) / total).alias(k) for k in ORDERS])

    # rounds go in one array function; those past the fixed point keep the weights as they are
    settled = lambda a, b: F.greatest(*[F.abs(a[k] - b[k]) for k in ORDERS]) < 1e-12
    fit = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(start.alias("w"), F.lit(False).alias("done")), lambda s, i: F.when(s["done"], s).otherwise(F.get(F.transform(F.array(step(s["w"], i)), lambda new: F.struct(new.alias("w"), settled(new, s["w"]).alias("done"))), F.lit(0))))
    return both.select(source, fit["w"].alias("_mw_w"))


@lru_cache(maxsize=1)
def _regions(spark: SparkSession) -> frozenset[str]:
    """Names of the time zones that the JVM knows."""
    return frozenset(spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds())


def normalise_timestamps(
    df: DataFrame, directory: DataFrame, text: str = "date_str", source: str = "mailbox", zone_col: str = "tz_name",
    order_col: str = "date_order", clear: float = 0.95, prior: float = 9.0,
) -> DataFrame:
    """df with instant_utc (TIMESTAMP_NTZ, UTC wall clock), time_format, time_posterior and time_ambiguous.

    Texts without zone are read in the source's zone; a local time that occurs twice means the first, one that
    a clock change skips is read with the offset before it. NULL, blank or unreadable texts, texts without year
    or time of day, impossible dates, and zones that nobody knows (in the text or the directory) give a NULL instant and no format.
    A source missing from the directory is read as UTC with even prior. Columns of df keep their names; helper columns start with _mw_.
    """
    parsed = parsed_fields(df, text)
    one = directory.groupBy(source).agg(F.min(F.struct(F.col(zone_col).alias("z"), F.col(order_col).alias("o"))).alias("d")).select(source, F.col("d.z").alias("_mw_zone"), F.col("d.o").alias(order_col))
    weights = order_weights(parsed.select(source, "_mw_family", "_mw_p"), source, one, order_col, prior)
    side = one.select(source, "_mw_zone").join(weights, source)
    if directory.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        side = F.broadcast(side)
    x = parsed.join(side, source, "left")
    p = lambda i: F.get("_mw_p", F.lit(i))
    num = lambda c: c.try_cast("int")
    slash = F.col("_mw_family") == "slash"
    valid = order_valid(F.col("_mw_p"))
    x = x.withColumns({f"_mw_l{k}": F.when(slash & valid[k], F.coalesce(F.col(f"_mw_w.{k}"), F.lit(1 / 3))).otherwise(0.0) for k in ORDERS})
    likely = {k: F.col(f"_mw_l{k}") for k in ORDERS}
    best = F.greatest(*likely.values())
    x = x.withColumn("_mw_post", F.when(slash, F.try_divide(best, sum(likely.values(), F.lit(0.0)))).otherwise(1.0))
    chosen = F.lit(None).cast("string")
    for k in reversed(ORDERS):  # the first of equals, which the posterior marks
        chosen = F.when((likely[k] == best) & (best > 0), k).otherwise(chosen)
    x = x.withColumn("_mw_chosen", F.when(slash, chosen).otherwise("dmy"))
    places = F.create_map(*[x for k, at in ORDERS.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in at]))])
    x = x.withColumn("_mw_at", F.try_element_at(places, F.col("_mw_chosen")))
    x = x.withColumns({f"_mw_n{part}": F.get("_mw_p", F.get("_mw_at", F.lit(part))) for part in range(3)})
    pick = lambda part: F.col(f"_mw_n{part}")
    names = F.create_map(*[F.lit(v) for i, n in enumerate(MONTHS) for v in (n, i + 1)])
    month = F.coalesce(num(pick(1)), F.try_element_at(names, F.lower(pick(1))))
    day, year = num(pick(0)), num(pick(2))
    year = F.when(year < 100, year + 2000).otherwise(year)
    hour = num(p(3))
    hour = F.when(F.length(p(7)) == 0, hour).otherwise(hour % 12 + F.when(F.lower(p(7)) == "pm", 12).otherwise(0))
    second = F.coalesce(F.concat(F.when(F.length(p(5)) > 0, p(5)).otherwise("0"), F.lit("."), F.rpad(p(6), 6, "0")).try_cast("decimal(16,6)"), F.lit(0).cast("decimal(16,6)"))
    local = F.col("_mw_family").isNotNull() & ~F.col("_mw_family").startswith("epoch")
    x = x.withColumns({"_mw_y": year, "_mw_mo": month, "_mw_d": day, "_mw_h": hour, "_mw_mi": num(p(4)), "_mw_s": second, "_mw_z": p(8), "_mw_local": local})
    wall = F.when(F.col("_mw_local"), F.expr("try_make_timestamp_ntz(_mw_y, _mw_mo, _mw_d, _mw_h, _mw_mi, _mw_s)"))
    minutes = _zone_minutes(F.col("_mw_z"))
    region = F.when(F.length("_mw_z") > 0, F.col("_mw_z")).otherwise(F.coalesce("_mw_zone", F.lit("UTC")))
    x = x.withColumns({"_mw_wall": wall, "_mw_min": minutes, "_mw_region": region})
    scale = F.when(F.col("_mw_family") == "epoch_s", 1000000).when(F.col("_mw_family") == "epoch_ms", 1000).otherwise(1)
    micros = F.when(F.col("_mw_family").startswith("epoch"), F.get("_mw_p", F.lit(0)).try_cast("bigint") * scale)
    epoch = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")
    x = x.withColumn("_mw_us", micros)
    instant = (
        F.when(F.col("_mw_us").isNotNull(), epoch + F.expr("make_dt_interval(0, 0, 0, cast(_mw_us as decimal(22,0)) / 1000000)"))
        .when(F.col("_mw_min").isNotNull(), F.col("_mw_wall") - F.expr("make_dt_interval(0, 0, _mw_min)"))
        .when(F.col("_mw_region").isin(*sorted(_regions(df.sparkSession))), F.expr("convert_timezone(_mw_region, 'UTC', _mw_wall)"))
    )
    form = F.when(F.col("_mw_family") == "slash", F.concat(F.lit("slash_"), "_mw_chosen")).otherwise(F.col("_mw_family"))
    x = x.withColumn("instant_utc", instant).withColumn("time_format", F.when(F.col("instant_utc").isNotNull(), form))
    x = x.withColumn("time_posterior", F.when(F.col("instant_utc").isNotNull(), F.col("_mw_post"))).withColumn("time_ambiguous", F.coalesce(F.col("time_posterior") < clear, F.lit(False)))
    return x.drop(*[c for c in x.columns if c.startswith("_mw_")])


def wrong_stored_dates(messages: DataFrame, mailboxes: DataFrame, seconds: float = 1.0) -> DataFrame:
    """delivery_id of rows whose stored `date` differs by `seconds` or more from the instant of date_str.

    The weights are those of all rows, also of the rows without stored date, so a text is read as everywhere else.
    """
    x = normalise_timestamps(messages.select("delivery_id", "mailbox", "date", "date_str"), mailboxes.select("mailbox", "tz_name", "date_order"))
    gap = F.abs(F.expr("timestampdiff(MICROSECOND, instant_utc, cast(date AS TIMESTAMP_NTZ))"))
    # a generator, as a filter would be pushed down through the projections with all their expressions written out in it
    return x.select(F.explode(F.when(gap >= seconds * 1e6, F.array("delivery_id"))).alias("delivery_id"))
