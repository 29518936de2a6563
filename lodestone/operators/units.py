"""Readings in common units.

A reading states its unit in ``unit`` or in its raw text, or states none. The readings of one source
and quantity, in order and as stated, are one history. It is segmented by exact penalised changepoint
search on log values; a segment whose level is off the source's by the shift of a known unit was
recorded in that unit: unstated readings get it, and stated ones are reversed to it.
"""

from __future__ import annotations

import math
import re
import unicodedata
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# For each common unit the units that convert to it as value * factor + offset, by the
# names under which they are written.
UNITS: dict[str, list[tuple[str, str, str]]] = {
    "%": [("1", "0", "% pct percent per cent per_cent prozent %"), ("0.1", "0", "‰ per mille permille"), ("100", "0", "fraction ratio ratio (0-1) ratio(0-1) fraction (0-1)")],
    "U/mg": [("1", "0", "U/mg U mg-1 U·mg⁻¹ IU/mg U per mg µmol/min/mg umol/min/mg µmol min-1 mg-1 kU/g units/mg"), ("0.001", "0", "mU/mg U/g U g-1 U·g⁻¹ U per g"), ("1000", "0", "U/µg U/ug kU/mg"), ("0.06", "0", "nkat/mg"), ("60", "0", "µkat/mg ukat/mg")],
    "mg/g": [("1", "0", "mg/g mg g-1 mg·g⁻¹ mg per g µg/mg ug/mg g/kg"), ("10", "0", "% w/w wt% wt.% % (w/w) %w/w"), ("1000", "0", "g/g mg/mg kg/kg"), ("0.001", "0", "µg/g ug/g mg/kg")],
    "degC": [("1", "0", "degC °C C Celsius deg. C deg C degrees Celsius degree C º C"), ("1", "-273.15", "K kelvin"), ("5/9", "-160/9", "°F degF F Fahrenheit deg. F deg F")],
    "min": [("1", "0", "min minutes minute mins min."), ("60", "0", "h hr hours hour hrs h."), ("1440", "0", "d days day"), ("1/60", "0", "s sec seconds second secs s.")],
    "nm": [("1", "0", "nm nanometre nanometer nanometres nanometers"), ("1000", "0", "µm um micron microns micrometre micrometer"), ("1000000", "0", "mm millimetre millimeter"), ("0.1", "0", "Å A angstrom ångström"), ("0.001", "0", "pm")],
    "mM": [("1", "0", "mM mmol/L mmol L-1 millimolar mmol/l mmol·dm⁻³ mmol dm-3 mol m-3 mol/m3 mol·m⁻³"), ("1000", "0", "M mol/L mol L-1 mol/l molar mol·dm⁻³"), ("0.001", "0", "µM uM µmol/L umol/L micromolar")],
    "cycle": [("1", "0", "cycle cycles run runs batch batches use uses")],
    "mg": [("1", "0", "mg milligram milligrams mgs mg."), ("1000", "0", "g gram grams g. gm"), ("1000000", "0", "kg kilogram kilograms kg."), ("0.001", "0", "µg ug microgram micrograms mcg µg."), ("0.000001", "0", "ng nanogram")],
}
# Number with decimal point or comma, optionally times a power of ten.
NUMBER = re.compile(r"[-+−]?(?:\d{1,3}(?:,\d{3})+(?=\.\d)|\d+)(?:[.,]\d+)?(?:\s*[×x·*]\s*10\s*(?:\^\s*[-+−]?\d+|[⁻⁺]?[⁰¹²³⁴⁵⁶⁷⁸⁹]+)|[eE][-+−]?\d+)?")
SUPERSCRIPT = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺", "0123456789-+")


def _fraction(text: str) -> Decimal:
    over = [Decimal(p) for p in text.split("/")]
    return over[0] / over[1] if len(over) == 2 else over[0]


def plain_unit(text: str | None) -> str:
    """A unit's name without the accidents of writing: spaces, micro and degree signs, superscripts, case of words."""
    text = unicodedata.normalize("NFC", (text or "").strip()).replace("μ", "µ").replace("℃", "°C").replace("℉", "°F").replace("K", "K").replace("Å", "Å")
    text = re.sub(r"\s+", " ", text.translate(SUPERSCRIPT).replace("·", " ").replace("⋅", " ").replace("−", "-"))
    return text.lower() if re.fullmatch(r"[A-Za-z. ]{4,}", text) and not re.search(r"[a-z][A-Z]", text) else text


def _names(text: str) -> list[str]:
    """The names in a row of :data:`UNITS`; words that belong together are joined by the longest match below."""
    words, out = text.split(" "), []
    joined = ("per cent", "per mille", "ratio (0-1)", "fraction (0-1)", "U mg-1", "U per mg", "µmol min-1 mg-1", "U g-1", "U per g", "mg g-1", "mg per g", "% w/w", "% (w/w)", "deg. C", "deg C", "degrees Celsius", "degree C", "º C", "deg. F", "deg F", "mmol L-1", "mmol dm-3", "mol m-3", "mol L-1")
    i = 0
    while i < len(words):
        n = next((n for n in (3, 2) if " ".join(words[i : i + n]) in joined), 1)
        out.append(" ".join(words[i : i + n]))
        i += n
    return out


TABLE: dict[str, dict[str, tuple[Decimal, Decimal]]] = {common: {plain_unit(name): (_fraction(f), _fraction(o)) for f, o, names in rows for name in _names(names)} for common, rows in UNITS.items()}


def number(text: str | None) -> tuple[Decimal, str] | None:
    """The first number in ``text`` and what follows it, or None."""
    match = NUMBER.search(text or "")
    if not match:
        return None
    found = match.group().translate(SUPERSCRIPT).replace("−", "-")
    base, *power = re.split(r"\s*[×x·*]\s*10\s*\^?\s*|[eE]", found)
    base = base.replace(",", "") if "." in base else base.replace(",", ".")
    return Decimal(base).scaleb(int(power[0]) if power else 0), text[match.end() :]


@lru_cache(200_000)
def _scale(common: str, unit: str | None) -> tuple[Decimal, Decimal] | None:
    return TABLE.get(common, {plain_unit(common): (Decimal(1), Decimal(0))}).get(plain_unit(unit))


@lru_cache(64)
def scales_of(common: str) -> list[tuple[Decimal, Decimal]]:
    """The scales (factor, offset) that convert to ``common``, in order."""
    return sorted(set(TABLE.get(common, {plain_unit(common): (Decimal(1), Decimal(0))}).values()))


def stated(common: str, value: float | None, unit: str | None, raw: str | None) -> tuple[Decimal, Decimal, Decimal] | None:
    """(number, factor, offset) if the reading itself tells its number and a unit that converts to ``common``, else None."""
    scale = _scale(common, unit) if unit else None
    told = number(raw)
    if scale is None and told:
        rest = told[1]
        scale = _scale(common, rest) or _scale(common, re.sub(r"\s*\((?!0-1)[^()]*\)\s*$", "", rest))
    if scale is None:
        return None
    amount = Decimal(repr(value)) if value is not None and math.isfinite(value) else told[0] if told else None
    return None if amount is None else (amount, *scale)


def times_100(amount: Decimal, factor: Decimal, offset: Decimal) -> int:
    return int(((amount * factor + offset) * 100).quantize(Decimal("0.000001")).quantize(Decimal(1), ROUND_HALF_UP))


def changepoints(values: np.ndarray, penalty: float) -> list[int]:
    """Ends of the segments that minimise the squared deviation from the segment means plus ``penalty`` a segment.

    Exact, by functional pruning: for each level that the running segment can have only its best start
    is kept, so long histories without any change stay near linear (where PELT keeps every start).
    """
    n = len(values)
    if not n:
        return []
    centred = values - values.mean()
    total, square = np.concatenate([[0.0], np.cumsum(centred)]).tolist(), np.concatenate([[0.0], np.cumsum(centred**2)]).tolist()
    lowest, highest = float(centred.min()) - 1, float(centred.max()) + 1
    last = np.zeros(n + 1, np.int64)
    pieces = [(lowest, highest, 0, 0.0)]  # for the levels from, to: the best start, and the cost up to it with the penalty
    for t in range(1, n + 1):
        least, best, seen = math.inf, 0, []
        for low, high, start, base in pieces:
            length, moved = t - start, total[t] - total[start]
            centre = moved / length
            floor = base + (square[t] - square[start]) - moved * centre
            away = low - centre if centre < low else centre - high if centre > high else 0.0
            cost = floor + length * away * away
            if cost < least:
                least, best = cost, start
            seen.append((low, high, start, base, length, centre, floor))
        last[t] = best
        limit, edge, pieces = least + penalty, lowest, []
        for low, high, start, base, length, centre, floor in seen:
            if floor < limit:
                reach = math.sqrt((limit - floor) / length)
                low, high = max(low, centre - reach), min(high, centre + reach)
                if low < high:
                    if low > edge:
                        pieces.append((edge, low, t, limit))
                    pieces.append((low, high, start, base))
                    edge = high
        if edge < highest:
            pieces.append((edge, highest, t, limit))
    ends, t = [], n
    while t > 0:
        ends.append(t)
        t = int(last[t])
    return ends[::-1]


#: A segment's level tells a scale if it then lies within TOLERANCE spreads (of HALF at least) of the source's, and under any other scale APART further off.
TOLERANCE, HALF, APART = 0.7, 0.5, 1.0
#: Stated readings are reversed only in segments of so many, all of one scale, whose level is so many spreads off that of the source's other stated readings, which are at least as many.
REVERSED_LEAST, REVERSED_SPREADS = 5, 4.0


def fitting(common: str, recorded: float, mean: float, spread: float) -> tuple[Decimal, Decimal] | None:
    """The one scale under which the number ``recorded`` lies at the level ``mean`` (of logs), if there is one."""
    off = []
    for factor, offset in scales_of(common):
        moved = recorded * float(factor) + float(offset)
        off.append((abs(math.log(moved) - mean) if moved > 0 else math.inf, (factor, offset)))
    off.sort(key=lambda x: x[0])
    return off[0][1] if off and off[0][0] <= TOLERANCE * max(spread, HALF) and (len(off) == 1 or off[1][0] > off[0][0] + APART) else None


def judged_units(common: str, values: np.ndarray, stated_as: np.ndarray, totals: tuple[float, float, float], level: tuple[float, float]) -> dict[int, tuple[Decimal, Decimal]]:
    """The scale that its segment's level tells, by reading: for those that state none, and for those whose stated one it contradicts.

    ``values``: in the common unit as stated, as recorded elsewhere, in order; ``stated_as``: the place
    of the stated scale in :func:`scales_of`, -1 for none. ``totals``: number, sum and sum of squares of
    the logs of all stated readings of the source; ``level``: mean and spread of those of the quantity
    in all sources, for sources with under three of their own.
    """
    out: dict[int, tuple[Decimal, Decimal]] = {}
    usable = np.flatnonzero(np.isfinite(values) & (values > 0))
    if len(usable) == 0:
        return out
    logs, scale = np.log(values[usable]), stated_as[usable]
    count, total, squares = totals
    mean, spread = (total / count, max(math.sqrt(max(squares / count - (total / count) ** 2, 0.0)), 0.1)) if count >= 3 else level
    if not math.isfinite(mean):
        return out
    start = 0
    for end in changepoints(logs, 2 * spread**2 * math.log(len(logs) + 1)):
        inside, start = np.arange(start, end), end
        bare = inside[scale[inside] < 0]
        if len(bare) and (found := fitting(common, float(np.exp(logs[bare].mean())), mean, spread)):
            out |= {int(usable[i]): found for i in bare}
        known = inside[scale[inside] >= 0]
        own = logs[known]
        others = count - len(known)
        if len(known) >= REVERSED_LEAST and others >= len(known) and (scale[known] == scale[known[0]]).all():
            rest = (total - own.sum()) / others
            apart = max(math.sqrt(max((squares - (own**2).sum()) / others - rest**2, 0.0)), 0.1)
            if abs(own.mean() - rest) > max(APART, REVERSED_SPREADS * apart):
                factor, offset = scales_of(common)[int(scale[known[0]])]
                found = fitting(common, (float(np.exp(own.mean())) - float(offset)) / float(factor), float(rest), apart)
                if found and found != (factor, offset):
                    out |= {int(usable[i]): found for i in known}
    return out


#: Readings of a history that one task segments; longer histories are cut into spans of equal time, each segmented exactly, all under the level of the whole history.
SPAN = 1 << 18


def to_common_units(readings: DataFrame, common: DataFrame, span: int = SPAN) -> DataFrame:
    """Every reading in its common unit.

    ``readings``: field_name, item_key, pos, quantity, source, seq (microseconds), value, unit, raw;
    ``common``: the rows of ``common_units`` (one a quantity, so it is broadcast). Result: field_name,
    item_key, pos, quantity, how, exact, value_common, value_x100. ``how`` is ``stated`` (nothing in
    the history speaks against the unit stated), ``reversed`` (the history contradicts it, and tells
    another), ``history`` (none is stated, the history tells one) or ``unresolved`` (then the values
    are null); ``exact``: the stored value is in the common unit.

    Quantities without a common unit give no rows; a repeated (field_name, item_key, pos) counts
    once; null sources are one history; equal ``seq`` are ordered by key and place; non-finite
    values count as null. A history of more than ``span`` readings is cut (:data:`SPAN`).
    """
    from lodestone.session import cut_lineage

    units = F.broadcast(common.select("field_name", "quantity", "common_unit").dropDuplicates(["field_name", "quantity"]))
    own = readings.select("field_name", "item_key", "pos", "quantity", "source", "seq", "value", "unit", "raw").join(units, ["field_name", "quantity"])
    kinds = {f.name: f.dataType for f in own.schema}
    place = ["field_name", "source", "quantity", "seq", "item_key", "pos"]
    told = T.StructType([T.StructField(c, kinds[c]) for c in place] + [T.StructField("common_unit", T.StringType()), T.StructField("reading", T.DoubleType()), T.StructField("amount", T.StringType()), T.StructField("scale", T.IntegerType()), T.StructField("exact", T.BooleanType())])
    result = T.StructType([T.StructField(c, kinds[c]) for c in ("field_name", "item_key", "pos", "quantity")] + [T.StructField("how", T.StringType()), T.StructField("exact", T.BooleanType()), T.StructField("value_common", T.DoubleType()), T.StructField("value_x100", T.LongType())])
    told_kind, result_kind = to_arrow_schema(told), to_arrow_schema(result)

    def read(batches):
        """What each reading tells by itself: its number, and the place of its scale or -1."""
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            readings_, amounts, scales, exacts = [], [], [], []
            for value, unit, raw, goal in zip(*columns[len(place) :]):
                value = value if value is not None and math.isfinite(value) else None
                found = stated(goal, value, unit, raw)
                number_told = None if found or value is not None else number(raw)
                amount = found[0] if found else Decimal(repr(value)) if value is not None else number_told[0] if number_told else None
                amounts.append(None if amount is None else str(amount))
                readings_.append(None if amount is None else float(amount * found[1] + found[2]) if found else float(amount))
                scales.append(scales_of(goal).index(found[1:]) if found else -1)
                exacts.append(value is not None and unit == goal)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(place)], batch.columns[-1], *(pa.array(c, f.type) for c, f in zip((readings_, amounts, scales, exacts), list(told_kind)[len(place) + 1 :]))], schema=told_kind)

    rows = cut_lineage(own.dropDuplicates(["field_name", "item_key", "pos"]).select(*place, "value", "unit", "raw", "common_unit").mapInArrow(read, told))
    history = ["field_name", "source", "quantity"]
    log = F.when((F.col("scale") >= 0) & (F.col("reading") > 0), F.log("reading"))
    whole = rows.groupBy(*history).agg(F.count("*").alias("n"), F.min("seq").alias("since"), F.max("seq").alias("until"), F.count(log).alias("n_stated"), F.sum(log).alias("total"), F.sum(log * log).alias("squares"))
    # the level of a quantity is that of the readings in the common unit; there are as many as common units
    standard = F.when(F.col("exact") & (F.col("reading") > 0), F.log("reading"))
    levels = F.broadcast(rows.groupBy("field_name", "quantity").agg(F.avg(standard).alias("level"), F.stddev_pop(standard).alias("spread")))
    about = whole.join(levels, ["field_name", "quantity"]).select(*[F.col(c).alias(f"_{c}") for c in history], "n", "since", "until", "n_stated", "total", "squares", "level", "spread")
    beside = rows.join(about, (F.col("field_name") == F.col("_field_name")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("quantity") == F.col("_quantity")))
    spans = F.ceil(F.col("n") / span)
    block = F.when(spans > 1, F.floor((F.col("seq") - F.col("since")) * spans / (F.col("until") - F.col("since") + 1))).otherwise(0).cast("int")
    ordered = beside.select(*place, "common_unit", "reading", "amount", "scale", "exact", "n_stated", "total", "squares", "level", "spread", block.alias("block")).repartition(*history, "block").sortWithinPartitions(*history, "block", "seq", "item_key", "pos")

    def judged(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        """The results of one history, or of one span of it."""
        table = pa.Table.from_batches(held)
        row = {name: table.column(name)[0].as_py() for name in ("common_unit", "n_stated", "total", "squares", "level", "spread")}
        values = table.column("reading").to_numpy(zero_copy_only=False).astype(float)
        scale = table.column("scale").to_numpy()
        level = (row["level"] if row["level"] is not None else math.nan, max(row["spread"] or 0.0, 0.1))
        told_by_level = judged_units(row["common_unit"], values, scale, (row["n_stated"], row["total"] or 0.0, row["squares"] or 0.0), level)
        known = scales_of(row["common_unit"])
        how, in_common, times = [], [], []
        for i, (amount, at) in enumerate(zip(table.column("amount").to_pylist(), scale.tolist())):
            found = told_by_level.get(i) or (known[at] if at >= 0 else None)
            triple = (Decimal(amount), *found) if found and amount is not None else None
            how.append("unresolved" if triple is None else "stated" if i not in told_by_level else "reversed" if at >= 0 else "history")
            in_common.append(None if triple is None else float(triple[0] * triple[1] + triple[2]))
            times.append(None if triple is None else times_100(*triple))
        columns = [table.column(c).combine_chunks() for c in ("field_name", "item_key", "pos", "quantity")]
        return pa.RecordBatch.from_arrays([*columns, pa.array(how), table.column("exact").combine_chunks(), pa.array(in_common, pa.float64()), pa.array(times, pa.int64())], schema=result_kind)

    def walk(batches):
        now, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            names = list(zip(*(batch.column(c).to_pylist() for c in (*history, "block"))))
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for a, b in zip(cuts, cuts[1:]):
                if held and names[a] != now:
                    yield judged(held)
                    held = []
                now = names[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield judged(held)

    return ordered.mapInArrow(walk, result)
