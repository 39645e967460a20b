"""Queries of the problems tagged general: name -> (spark, data directory) -> DataFrame, with their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailweave.operators.delivery_dedup import exactly_once, surplus_deliveries
from mailweave.operators.timestamps import FAMILIES, MONTHS, ORDERS, ZONE_MINUTES, normalise_timestamps, wrong_stored_dates
from mailweave.operators.units import normalise_quantities, same_quantities
from mailweave.sources.tables import table


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return wrong_stored_dates(table(spark, root, "messages"), table(spark, root, "mailboxes"))


def p3_instants(spark: SparkSession, root: str) -> DataFrame:
    m = table(spark, root, "messages").select("delivery_id", "mailbox", "date_str")
    x = normalise_timestamps(m, table(spark, root, "mailboxes"))
    return x.select("delivery_id", F.date_format("instant_utc", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("instant_utc"), "time_format", "time_ambiguous")


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return surplus_deliveries(table(spark, root, "messages"))


def p5_kept(spark: SparkSession, root: str) -> DataFrame:
    return exactly_once(table(spark, root, "messages").select("delivery_id", "message_id", "source_file", "batch_no")).select("delivery_id", "source_file", "batch_no")


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return same_quantities(table(spark, root, "specs"))


def p6_common_units(spark: SparkSession, root: str) -> DataFrame:
    return normalise_quantities(table(spark, root, "specs"))


QUERIES = {f.__name__: f for f in (p3_found, p3_instants, p5_found, p5_kept, p6_found, p6_common_units)}



def _instants_sql() -> str:
    """CTE `inst` from the definitions: what a text says is read in the declared order where it is valid in it, without any weights."""
    lit = lambda t: "'" + t.replace("'", "''") + "'"
    family = " ".join(f"WHEN regexp_matches(x, {lit(p)}) THEN {lit(n)}" for n, (p, _) in FAMILIES.items())
    pieces = " ".join(f"WHEN {lit(n)} THEN [" + ", ".join(f"regexp_extract(x, {lit(p)}, {k[1:]})" if k else "''" for k in t.split("|")) + "]" for n, (p, t) in FAMILIES.items())
    zones = f"[{', '.join(lit(z) for z in ZONE_MINUTES)}]", f"[{', '.join(str(v) for v in ZONE_MINUTES.values())}]"
    ok = lambda k: "(length(p[{0}]) <= 2 AND length(p[{1}]) <= 2 AND length(p[{2}]) IN (2, 4) AND try_cast(p[{0}] AS INT) BETWEEN 1 AND 31 AND try_cast(p[{1}] AS INT) BETWEEN 1 AND 12)".format(*[i + 1 for i in ORDERS[k]])
    order = "CASE " + " ".join(f"WHEN o = {lit(k)} AND {ok(k)} THEN {lit(k)}" for k in ORDERS) + " " + " ".join(f"WHEN {ok(k)} THEN {lit(k)}" for k in ORDERS) + " END"
    part = lambda i: "CASE chosen " + " ".join(f"WHEN {lit(k)} THEN p[{at[i] + 1}]" for k, at in ORDERS.items()) + " END"
    return rf"""b AS (SELECT delivery_id, mailbox, date, regexp_replace(date_str, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS x FROM messages),
    fa AS (SELECT *, CASE WHEN regexp_matches(x, '^\d{{9,11}}$') THEN 'epoch_s' WHEN regexp_matches(x, '^\d{{13}}$') THEN 'epoch_ms' WHEN regexp_matches(x, '^\d{{16}}$') THEN 'epoch_us' {family} END AS fam FROM b),
    pi AS (SELECT fa.*, CASE fam {pieces} END AS p, mb.tz_name AS tz, mb.date_order AS o FROM fa LEFT JOIN mailboxes mb ON mb.mailbox = fa.mailbox),
    oc AS (SELECT *, CASE WHEN fam = 'slash' THEN {order} ELSE 'dmy' END AS chosen FROM pi),
    va AS (SELECT *, try_cast({part(0)} AS INT) AS d, coalesce(try_cast({part(1)} AS INT), list_position([{', '.join(lit(m) for m in MONTHS)}], lower({part(1)}))) AS mo, try_cast({part(2)} AS INT) AS y, try_cast(p[4] AS INT) AS h, p[9] AS z FROM oc),
    wa AS (SELECT *, try_cast(printf('%04d-%02d-%02d %02d:%s:%s.%s', CASE WHEN y < 100 THEN y + 2000 ELSE y END, mo, d, CASE WHEN length(p[8]) = 0 THEN h ELSE h % 12 + CASE WHEN lower(p[8]) = 'pm' THEN 12 ELSE 0 END END, p[5], CASE WHEN length(p[6]) > 0 THEN p[6] ELSE '00' END, rpad(p[7], 6, '0')) AS TIMESTAMP) AS wall,
        CASE WHEN regexp_matches(z, '^[+-]\d{{2}}') THEN (CASE WHEN z[1] = '-' THEN -1 ELSE 1 END) * (rpad(regexp_replace(z, '[^0-9]', '', 'g'), 4, '0')[1:2]::INT * 60 + rpad(regexp_replace(z, '[^0-9]', '', 'g'), 4, '0')[3:4]::INT) ELSE ({zones[1]})[list_position({zones[0]}, upper(z))] END AS mins FROM va),
    re AS (SELECT *, CASE WHEN length(z) > 0 THEN z ELSE coalesce(tz, 'UTC') END AS region FROM wa), kn AS (SELECT name FROM pg_timezone_names()),
    lo AS (SELECT *, CASE WHEN region IN (SELECT name FROM kn) AND fam IS NOT NULL THEN timezone(region, wall) END AS t FROM (SELECT * REPLACE (CASE WHEN region IN (SELECT name FROM kn) THEN region ELSE 'UTC' END AS region), region IN (SELECT name FROM kn) AS known FROM re)),
    inst AS (SELECT delivery_id, date, CASE WHEN fam = 'epoch_s' THEN make_timestamp(x::BIGINT * 1000000) WHEN fam = 'epoch_ms' THEN make_timestamp(x::BIGINT * 1000) WHEN fam = 'epoch_us' THEN make_timestamp(x::BIGINT) WHEN mins IS NOT NULL THEN wall - to_minutes(mins::BIGINT) WHEN known THEN timezone('UTC', CASE WHEN timezone(region, t - INTERVAL 1 HOUR) = wall THEN t - INTERVAL 1 HOUR ELSE t END) END AS instant, CASE WHEN fam = 'slash' THEN 'slash_' || chosen ELSE fam END AS form FROM lo)"""


_BARE_ID = r"lower(regexp_replace(message_id, '^[\s<>]+|[\s<>]+$', '', 'g'))"
SQL = {
    "p3_instants": f"WITH {_instants_sql()} SELECT delivery_id, strftime(instant, '%Y-%m-%d %H:%M:%S.%f') AS instant_utc, CASE WHEN instant IS NOT NULL THEN form END AS time_format, false AS time_ambiguous FROM inst",
    "p3_found": f"WITH {_instants_sql()} SELECT delivery_id FROM inst WHERE abs(datediff('microsecond', instant, date)) >= 1000000",
    "p5_found": f"SELECT delivery_id FROM (SELECT delivery_id, row_number() OVER (PARTITION BY {_BARE_ID} ORDER BY delivery_id) AS n FROM messages WHERE length({_BARE_ID}) > 0) t WHERE n > 1",
    "p5_kept": f"SELECT delivery_id, source_file, batch_no FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(nullif({_BARE_ID}, ''), 'none-' || delivery_id) ORDER BY delivery_id) AS n FROM messages) t WHERE n = 1",
}
