"""Exactly-once delivery by exact quotient hash tables (problem 5).

An identifier is normalised, laid out as bytes of a fixed width (its own length class) and permuted by
invertible mixing steps, so two different identifiers never share a permuted value. The first 64 bits of
the permuted value are the quotient, which picks the shard; everything else, with the true length, is the
remainder and is stored whole. Inserting is "group by (quotient, remainder)": a shard holds each identifier
once and, as nothing was thrown away, there are no false matches.

Spark does the sharding: the partial aggregate inserts into a table per task before the shuffle, so an
identifier that holds a third of all rows crosses the network once per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Identifiers are padded to a multiple of this many bytes.
WIDTH = 16


def normal_id(raw: Column) -> Column:
    """The identifier without surrounding blanks and angle brackets, in lower case; NULL if nothing is left."""
    bare = F.lower(F.regexp_replace(raw, r"^(?U)[\s<>]+|[\s<>]+$", ""))
    return F.when(F.length(bare) > 0, bare)


def _mixed(x: Column) -> Column:
    """Bijective on 64 bits: xor-shifts only (a multiplication would overflow under ANSI)."""
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 33))
    x = x.bitwiseXOR(F.shiftleft(x, 21))
    return x.bitwiseXOR(F.shiftrightunsigned(x, 17))


def quotient_key(ident: Column) -> tuple[Column, Column]:
    """(quotient, remainder) of a normalised identifier; the pair determines the identifier.

    (head, tail) -> (mix(head xor hash(tail)), tail) is one Feistel round: with the tail at hand it can be undone.
    """
    raw = F.encode(ident, "UTF-8")
    size = F.octet_length(raw)
    wide = F.rpad(raw, F.ceil(size / F.lit(WIDTH)).cast("int") * WIDTH, F.lit(b"\0"))
    tail = F.concat(F.substring(wide, 9, 2**31 - 1), F.encode(F.lpad(F.hex(size), 8, "0"), "UTF-8"))
    head = F.conv(F.hex(F.substring(wide, 1, 8)), 16, -10).cast("bigint")
    return _mixed(head.bitwiseXOR(F.xxhash64(tail))), tail


def kept_deliveries(deliveries: DataFrame, id_col: str = "message_id", order_col: str = "delivery_id") -> DataFrame:
    """One row (order_col) per identifier: the lowest order_col that carries it. Rows without identifier aren't listed."""
    q, r = quotient_key(F.col("_mw_id"))
    return (
        deliveries.select(F.col(order_col).alias("_mw_ord"), normal_id(F.col(id_col)).alias("_mw_id"))
        .where("_mw_id IS NOT NULL AND _mw_ord IS NOT NULL")
        .select("_mw_ord", q.alias("_mw_q"), r.alias("_mw_r"))
        .groupBy("_mw_q", "_mw_r")
        .agg(F.min("_mw_ord").alias(order_col))
        .select(order_col)
    )


def surplus_deliveries(deliveries: DataFrame, id_col: str = "message_id", order_col: str = "delivery_id") -> DataFrame:
    """order_col of every row whose identifier a row with a lower order_col carries already.

    NULL and blank identifiers identify nothing: such rows are never surplus. Fields other than the
    identifier don't matter. An empty table gives an empty result. order_col must be unique; rows that
    repeat one order_col count as one delivery, and a NULL order_col is never surplus. The anti-join is on
    order_col, not on the identifier, so no task sees all copies of a hot message.
    """
    carried = deliveries.select(order_col, id_col).where(normal_id(F.col(id_col)).isNotNull()).where(F.col(order_col).isNotNull())
    return carried.select(order_col).join(kept_deliveries(deliveries, id_col, order_col), order_col, "left_anti").distinct()


def exactly_once(deliveries: DataFrame, id_col: str = "message_id", order_col: str = "delivery_id") -> DataFrame:
    """deliveries without the surplus rows; rows without identifier or without order_col stay. One join, on order_col."""
    alone = normal_id(F.col(id_col)).isNull() | F.col(order_col).isNull()
    return deliveries.where(~alone).join(kept_deliveries(deliveries, id_col, order_col), order_col, "left_semi").select(*deliveries.columns).unionByName(deliveries.where(alone))
