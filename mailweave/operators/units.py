"""Quantities in common units (problem 6).

A hidden Markov model per device (message, category, subject): the hidden state is the unit in which a reading was
taken and the notation of its number; the emission is what the record says of them, and may be wrong at a cost; the
transition compares log values with a smooth underlying level, so a switch of units that keeps the level is cheap and a
jump of the level isn't. Viterbi decodes the states, and each value is converted by its state's unit.

Long devices are cut into blocks without loss: a block's cheapest ways from each first to each last state are a matrix,
matrices of neighbouring blocks combine by min-plus products, and what they choose at the cuts fixes each block's ends.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailweave.session import cut_lineage

# Unit -> (quantity, factor to the common unit, offset added before the factor); spellings below.
UNITS = {
    "mm": ("length", 1.0, 0.0), "cm": ("length", 10.0, 0.0), "m": ("length", 1000.0, 0.0), "inch": ("length", 25.4, 0.0), "ft": ("length", 304.8, 0.0), "um": ("length", 0.001, 0.0), "km": ("length", 1e6, 0.0),
    "Nm": ("torque", 1.0, 0.0), "kNm": ("torque", 1000.0, 0.0), "lb-ft": ("torque", 1.3558179483314004, 0.0), "in-lb": ("torque", 0.1129848290276167, 0.0), "kgf-m": ("torque", 9.80665, 0.0), "oz-in": ("torque", 0.00706155181422604, 0.0), "Ncm": ("torque", 0.01, 0.0),
    "rpm": ("speed", 1.0, 0.0), "rev/s": ("speed", 60.0, 0.0), "rad/s": ("speed", 60 / (2 * math.pi), 0.0),
    "W": ("power", 1.0, 0.0), "kW": ("power", 1000.0, 0.0), "MW": ("power", 1e6, 0.0), "mW": ("power", 0.001, 0.0), "hp": ("power", 745.6998715822702, 0.0),
    "Pa": ("pressure", 1.0, 0.0), "kPa": ("pressure", 1000.0, 0.0), "MPa": ("pressure", 1e6, 0.0), "bar": ("pressure", 1e5, 0.0), "mbar": ("pressure", 100.0, 0.0), "psi": ("pressure", 6894.757293168361, 0.0), "atm": ("pressure", 101325.0, 0.0),
    "K": ("temperature", 1.0, 0.0), "C": ("temperature", 1.0, 273.15), "F": ("temperature", 5 / 9, 459.67),
    "V": ("voltage", 1.0, 0.0), "kV": ("voltage", 1000.0, 0.0), "mV": ("voltage", 0.001, 0.0),
    "A": ("current", 1.0, 0.0), "kA": ("current", 1000.0, 0.0), "mA": ("current", 0.001, 0.0),
    "kg": ("mass", 1.0, 0.0), "g": ("mass", 0.001, 0.0), "mg": ("mass", 1e-6, 0.0), "lb": ("mass", 0.45359237, 0.0), "t": ("mass", 1000.0, 0.0), "oz": ("mass", 0.028349523125, 0.0),
}
# Spellings of the units without blanks, hyphens and full stops.
SPELLINGS = {
    "mm": "mm millimetre millimetres millimeter millimeters", "cm": "cm centimetre centimetres centimeter centimeters", "m": "m metre metres meter meters", "inch": 'inch inches in " ″ ”', "ft": "ft feet foot ′ '", "um": "µm um micron microns", "km": "km",
    "Nm": "nm n·m newtonmetre newtonmetres newtonmeter newtonmeters", "kNm": "knm kn·m kilonewtonmetre kilonewtonmetres kilonewtonmeters", "lb-ft": "lbft lbfft ftlb ftlbs poundfoot poundfeet footpounds lbsft", "in-lb": "inlb inlbs inchpound inchpounds lbin lbfin", "kgf-m": "kgfm kgf·m kpm", "oz-in": "ozin", "Ncm": "ncm",
    "rpm": "rpm r/min rev/min min⁻¹ min^1 1/min revspermin revsperminute u/min", "rev/s": "rev/s r/s revspersecond revpersecond rps", "rad/s": "rad/s radianspersecond radpersecond",
    "W": "w watt watts", "kW": "kw kilowatt kilowatts", "MW": "megawatt megawatts", "mW": "milliwatt milliwatts", "hp": "hp bhp horsepower ps",
    "Pa": "pa pascal pascals", "kPa": "kpa kilopascal kilopascals", "MPa": "megapascal megapascals n/mm²  n/mm2", "bar": "bar bars", "mbar": "mbar", "psi": "psi lbf/in² lbf/in2 psig psia", "atm": "atm atmosphere atmospheres",
    "K": "k kelvin kelvins", "C": "°c ℃ degc degreecelsius degreescelsius celsius c", "F": "°f ℉ degf degreefahrenheit degreesfahrenheit fahrenheit f",
    "V": "v vac vdc volt volts", "kV": "kv kilovolt kilovolts", "mV": "millivolt millivolts", "A": "a amp amps ampere amperes", "kA": "ka kiloamp kiloamps kiloampere", "mA": "ma milliamp milliamps milliampere milliamperes",
    "kg": "kg kgs kilogram kilograms kilo kilos", "g": "g gram grams gramme grammes", "mg": "mg", "lb": "lb lbs pound pounds", "t": "t ton tons tonne tonnes", "oz": "oz ounce ounces",
}
# Quantity and common unit of the categories.
CATEGORY = {
    "dimensions": ("length", "mm"), "torque": ("torque", "Nm"), "speed/rpm": ("speed", "rpm"), "power": ("power", "W"), "pressure": ("pressure", "Pa"),
    "temperature": ("temperature", "K"), "voltage": ("voltage", "V"), "current": ("current", "A"), "weight/mass": ("mass", "kg"),
}
#: Spellings in which case decides the prefix.
_CASED = {"MW": "MW", "mW": "mW", "MPa": "MPa", "mV": "mV", "MV": "MV", "mA": "mA", "Mg": "t"}
_LOOKUP = {s: u for u, line in SPELLINGS.items() for s in line.split()}
_UPPER = {"mw": {"power": "MW"}, "mpa": {"pressure": "MPa"}, "mv": {"voltage": "mV"}}

#: A device of more readings is decoded in blocks of so many neighbouring record numbers, which bounds what a task holds.
BLOCK = 65_536
#: Costs (negative log probabilities). A unit that stands beside the number isn't the one meant; the same for one that only
#: the unit's own field has; the rarer reading of an ambiguous comma; the scale and the most of a level jump. A misread unit
#: costs more than one jump and less than two: only a reading that leaves the level and comes back can be misread.
MISREAD, MISREAD_FIELD, RARE_COMMA, JUMP_SCALE, JUMP_MOST = 10.0, 8.0, 2.5, 0.02, 6.0

_NUM = re.compile(r"(?<![\w.,/])(?:[-−–]\s?)?(?:\d+\s+\d+/\d+|\d+/\d+|\d+(?:[.,'’   ]\d+)*)")
_NOT_ONE = re.compile(r"±|\+/-|\d\s*(?:-|–|—|to|bis|\.\.\.?|…|~)\s*\d|^[~≈<>≤≥]|\bapprox|\bca\.|\bM\d|\bIP\d|\d\s*[x×]\s*\d", re.I)


@lru_cache(maxsize=100_000)
def unit_of(text: str, quantity: str) -> str | None:
    """The unit that a spelling means for a quantity, or None."""
    bare = text.strip().strip("[]()=:;,").strip()
    if bare in _CASED and UNITS.get(_CASED[bare], ("",))[0] == quantity:
        return _CASED[bare]
    key = re.sub(r"[\s \-‑.]+", "", bare).lower()
    unit = _UPPER.get(key, {}).get(quantity) or _LOOKUP.get(key)
    return unit if unit and UNITS[unit][0] == quantity else None


@lru_cache(maxsize=200_000)
def readings(text: str) -> tuple[tuple[float, float], ...]:
    """(value, cost) of the ways to read a number's notation: mixed fractions, grouped thousands, decimal point or comma."""
    s = text.replace("−", "-").replace("–", "-").replace(" ", " ").replace(" ", " ").replace("’", "'").strip()
    sign = -1.0 if s.startswith("-") else 1.0
    s = s.lstrip("-").strip()
    m = re.fullmatch(r"(?:(\d+)\s+)?(\d+)/(\d+)", s)
    if m:
        return ((sign * (int(m[1] or 0) + int(m[2]) / int(m[3])), 0.0),) if int(m[3]) else ()
    s = re.sub(r"(?<=\d)[' ](?=\d{3}(?!\d))", "", s)
    if re.search(r"[' ]", s):
        return ()
    try:
        if "," in s and "." in s:
            last = max(s.rfind(","), s.rfind("."))
            return ((sign * float(re.sub(r"[.,]", "", s[:last]) + "." + s[last + 1 :]), 0.0),)
        for mark in ",.":
            if s.count(mark) > 1:
                return ((sign * float(s.replace(mark, "")), 0.0),)
        if re.fullmatch(r"[1-9]\d{0,2},\d{3}", s):
            return ((sign * float(s.replace(",", ".")), 0.0), (sign * float(s.replace(",", "")), RARE_COMMA))
        return ((sign * float(s.replace(",", ".")), 0.0),)
    except ValueError:
        return ()


State = tuple[str, float, float, bool]


@lru_cache(maxsize=200_000)
def states(category: str, raw: str, value: str, unit: str) -> tuple[State, ...]:
    """(unit, value in the common unit, emission cost, whether the unit is stated) of the hidden states of a record, stated ones first.

    None unless the record states one number. Every unit of the quantity is possible: the stated one at no cost, others as
    misread. A bare number states no unit; a number beside words that are no unit is none of these quantities.
    """
    known = CATEGORY.get((category or "").strip().lower())
    if not known:
        return ()
    quantity = known[0]
    text = raw or f"{value} {unit}"
    if _NOT_ONE.search(text):
        return ()
    numbers = [m for m in _NUM.finditer(text)]
    if len(numbers) > 1 and value:
        numbers = [m for m in numbers if m[0].strip() == value.strip()] or numbers
    if len(numbers) != 1:
        return ()
    m = numbers[0]
    stated = unit_of(text[m.end() :], quantity) if text[m.end() :].strip() else None
    if stated is None:
        before = re.search(r"(?:\(([^()]+)\)\s*=|\[([^\[\]]+)\]|\bin\s+([^:]+):)\s*$", text[: m.start()])
        if before:
            stated = unit_of(next(g for g in before.groups() if g), quantity)
    misread = MISREAD
    if stated is None and unit:
        stated, misread = unit_of(unit, quantity), MISREAD_FIELD
    ways = readings(m[0])
    units = [u for u, x in UNITS.items() if x[0] == quantity]
    if stated:
        allowed = [(stated, 0.0)] + [(u, misread) for u in units if u != stated]
    elif not text[m.end() :].strip() and text[: m.start()].strip() == "" and not unit:
        allowed = [(u, math.log(len(units))) for u in units]
    else:
        allowed = []
    return tuple((u, (v + UNITS[u][2]) * UNITS[u][1], cost + extra, u == stated) for u, cost in allowed for v, extra in ways)


def _levels(s: tuple[State, ...]) -> np.ndarray:
    return np.log(np.abs([x[1] for x in s]) + 1e-12)


def _steps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Costs of the transitions from states of levels a to states of levels b."""
    return np.minimum(JUMP_MOST, np.abs(b[None, :] - a[:, None]) / JUMP_SCALE)


def _costs(s: tuple[State, ...]) -> np.ndarray:
    return np.array([x[2] for x in s])


def viterbi(chain: list[tuple[State, ...]], first: int | None = None, last: int | None = None) -> list[int]:
    """The cheapest states of a device's readings (the first of equals); first and last fix the states at the ends."""
    if len(chain) < 3 and first is None:
        # a misread unit saves one jump here and costs more, so stated readings keep their units
        chain = [tuple(x for x in s if x[3]) or s for s in chain]
        if len(chain) == 1:
            return [min(range(len(chain[0])), key=lambda k: chain[0][k][2])]
    best, at = _costs(chain[0]), _levels(chain[0])
    if first is not None:
        best = np.where(np.arange(len(best)) == first, best, np.inf)
    back = []
    for s in chain[1:]:
        to = _levels(s)
        ways = best[:, None] + _steps(at, to)
        back.append(ways.argmin(axis=0))
        best, at = ways.min(axis=0) + _costs(s), to
    path = [int(best.argmin()) if last is None else last]
    for from_ in reversed(back):
        path.append(int(from_[path[-1]]))
    return path[::-1]


def block_matrix(chain: list[tuple[State, ...]]) -> np.ndarray:
    """Cheapest cost from each first state (row) to each last state (column) of a block, emissions included."""
    m = np.full((len(chain[0]),) * 2, np.inf)
    np.fill_diagonal(m, _costs(chain[0]))
    at = _levels(chain[0])
    for s in chain[1:]:
        to = _levels(s)
        m = (m[:, :, None] + _steps(at, to)[None]).min(axis=1) + _costs(s)[None, :]
        at = to
    return m


def block_ends(blocks: list[tuple[list[float], list[float], list[float]]]) -> list[tuple[int, int]]:
    """(first, last) states of each block on the cheapest way through all, from (levels of the first states, of the last states, matrix row by row)."""
    entries, sums = [], []
    for k, (first, last, cells) in enumerate(blocks):
        m = np.array(cells).reshape(len(first), len(last))
        entry = np.zeros(len(first)) if k == 0 else (sums[-1][:, None] + _steps(np.array(blocks[k - 1][1]), np.array(first))).min(axis=0)
        entries.append(entry)
        sums.append((entry[:, None] + m).min(axis=0))
    out, end = [], int(sums[-1].argmin())
    for k in range(len(blocks) - 1, -1, -1):
        first, last, cells = blocks[k]
        start = int((entries[k] + np.array(cells).reshape(len(first), len(last))[:, end]).argmin())
        out.append((start, end))
        if k:
            end = int((sums[k - 1] + _steps(np.array(blocks[k - 1][1]), np.array(first))[:, start]).argmin())
    return out[::-1]


DEVICE = ["message_id", "category", "subject"]
_OUT = "spec_id long, message_id string, category string, subject string, unit_read string, common_unit string, common_value double, stated boolean"
_FIELDS = ["spec_id", *DEVICE, "raw_match", "value", "unit"]


def _chains(batches: Iterator[pd.DataFrame], extra: list[str]) -> Iterator[tuple[tuple, list]]:
    """(device and the columns of extra, its readings with their states) of rows that are sorted by these."""
    key, held = None, []
    for pdf in batches:
        for sid, mid, cat, sub, raw, val, unit, *more in zip(*[pdf[c].tolist() for c in [*_FIELDS, *extra]]):
            k = (mid, cat, sub, *more)
            if k != key:
                if held:
                    yield key, held
                key, held = k, []
            s = states(cat, raw or "", val or "", unit or "")
            if s:
                held.append((sid, s))
    if held:
        yield key, held


def _read(key: tuple, held: list, path: list[int]) -> list[tuple]:
    mid, cat, sub = key[:3]
    if not any(s[0][3] for _, s in held) and len(key) == 3:
        return []  # nothing tells the unit
    full = [s if len(held) > 2 or len(key) > 3 else tuple(x for x in s if x[3]) or s for _, s in held]
    common = CATEGORY[cat.strip().lower()][1]
    return [(sid, mid, cat, sub, s[i][0], common, s[i][1], s[i][3]) for (sid, _), s, i in zip(held, full, path)]


def _frames(rows: Iterator[list[tuple]], names: list[str]) -> Iterator[pd.DataFrame]:
    out: list[tuple] = []
    for r in rows:
        out += r
        if len(out) >= 8192:
            yield pd.DataFrame(out, columns=names)
            out = []
    yield pd.DataFrame(out, columns=names)


def normalise_quantities(specs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(spec_id, message_id, category, subject, unit_read, common_unit, common_value, stated) for records that state one number.

    stated: the unit is the one that the record states. Ranges, tolerances, ratings, designations, unknown categories and
    NULLs give no row, nor do the numbers of a device of which no reading states a unit. A device's readings come in
    order of spec_id. Devices of more than `block` readings are decoded block by block by many tasks, with the same result.
    """
    x = specs.select(*_FIELDS).where("spec_id IS NOT NULL AND category IS NOT NULL AND coalesce(raw_match, value) IS NOT NULL").withColumn("_mw_device", F.xxhash64(*DEVICE))
    hot = x.groupBy("_mw_device").agg(F.count("*").alias("n")).where(F.col("n") > block).select("_mw_device")
    names = [f.split(" ")[0] for f in _OUT.split(", ")]

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _frames((_read(key, held, viterbi([s for _, s in held])) for key, held in _chains(batches, [])), names)

    hot = cut_lineage(hot)
    if hot.isEmpty():
        return x.repartition("_mw_device").sortWithinPartitions("_mw_device", *DEVICE, "spec_id").select(*_FIELDS).mapInPandas(decode, _OUT)
    few = x.join(hot, "_mw_device", "left_anti").repartition("_mw_device").sortWithinPartitions("_mw_device", *DEVICE, "spec_id").select(*_FIELDS).mapInPandas(decode, _OUT)
    return few.unionByName(_in_blocks(x.join(hot, "_mw_device", "left_semi"), block, names))


def _in_blocks(x: DataFrame, block: int, names: list[str]) -> DataFrame:
    """The same for long devices: matrices of the blocks, their ends by one pass over a device's matrices, then each block alone."""
    x = x.withColumn("block", F.expr(f"spec_id div {block}"))
    cols = [*_FIELDS, "block"]
    parts = x.select(*cols).repartition("message_id", "category", "subject", "block").sortWithinPartitions(*DEVICE, "block", "spec_id")
    lists = ["first", "last", "cells"]

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(key: tuple, held: list) -> list[tuple]:
            chain = [s for _, s in held]
            return [(*key, any(s[0][3] for s in chain), _levels(chain[0]).tolist(), _levels(chain[-1]).tolist(), block_matrix(chain).ravel().tolist())]

        return _frames((one(key, held) for key, held in _chains(batches, ["block"])), [*DEVICE, "block", "tells", *lists])

    schema = "message_id string, category string, subject string, block long, tells boolean, first array<double>, last array<double>, cells array<double>"
    sums = parts.mapInPandas(summarise, schema)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        if not pdf["tells"].any():
            pdf = pdf.iloc[:0]
        ends = block_ends(list(zip(*[pdf[c].tolist() for c in lists]))) if len(pdf) else []
        return pdf[[*DEVICE, "block"]].assign(at_first=[e[0] for e in ends], at_last=[e[1] for e in ends])

    # a group here is one matrix per block of a device: 65,536 readings are a few kilobytes
    ends = sums.groupBy(*DEVICE).applyInPandas(choose, "message_id string, category string, subject string, block long, at_first int, at_last int")
    ends = ends.select(*[F.col(c).alias(f"_{c}") for c in [*DEVICE, "block"]], "at_first", "at_last")
    same = F.lit(True)
    for c in [*DEVICE, "block"]:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    y = x.join(ends, same).select(*cols, "at_first", "at_last").repartition("message_id", "category", "subject", "block").sortWithinPartitions(*DEVICE, "block", "spec_id")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _frames((_read(key, held, viterbi([s for _, s in held], int(key[4]), int(key[5]))) for key, held in _chains(batches, ["block", "at_first", "at_last"])), names)

    return y.mapInPandas(decode, _OUT)


def same_quantities(specs: DataFrame, relative: float = 0.005, kelvin: float = 0.5) -> DataFrame:
    """(spec_id_a, spec_id_b), a < b: records of one message, category and subject that mean the same in different units.

    Records that say the same value in the same unit are a class; only classes are compared. The join is on the key and a
    bucket of the value as wide as the tolerance (logarithmic; linear for temperatures), with one side in its neighbouring
    buckets too: only classes that are close meet, never all of a key. Pairs of records come from the classes' members.
    """
    q = cut_lineage(normalise_quantities(specs).where("message_id IS NOT NULL AND subject IS NOT NULL AND common_value IS NOT NULL"))
    heat = F.col("common_unit") == "K"
    width = -math.log(1 - relative)
    bucket = F.when(heat, F.floor(F.col("common_value") / kelvin)).when(F.col("common_value") == 0, F.lit(-(10**9))).otherwise(F.floor(F.log(F.abs("common_value")) / width)).cast("long")
    same = [*DEVICE, "unit_read", "common_unit", "common_value"]
    c = q.groupBy(*same).agg(F.min("spec_id").alias("id")).withColumn("bucket", bucket)
    a = c.select(*DEVICE, F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"), F.col("id").alias("id_a"), F.col("unit_read").alias("unit_a"), F.col("common_value").alias("va"), "common_unit")
    b = c.select(*DEVICE, "bucket", F.col("id").alias("id_b"), F.col("unit_read").alias("unit_b"), F.col("common_value").alias("vb"))
    gap = F.abs(F.col("va") - F.col("vb"))
    near = F.when(F.col("common_unit") == "K", gap <= kelvin + 1e-9).otherwise(gap <= relative * F.greatest(F.abs("va"), F.abs("vb")) * (1 + 1e-12))
    close = a.join(b, [*DEVICE, "bucket"]).where((F.col("id_a") < F.col("id_b")) & (F.col("unit_a") != F.col("unit_b")) & near).select(*DEVICE, "id_a", "unit_a", "va", "id_b", "unit_b", "vb")
    members = lambda s: q.select(*DEVICE, F.col("unit_read").alias(f"unit_{s}"), F.col("common_value").alias(f"v{s}"), F.col("spec_id").alias(f"spec_{s}"))
    pairs = close.join(members("a"), [*DEVICE, "unit_a", "va"]).join(members("b"), [*DEVICE, "unit_b", "vb"])
    return pairs.select(F.least("spec_a", "spec_b").alias("spec_id_a"), F.greatest("spec_a", "spec_b").alias("spec_id_b")).distinct()
