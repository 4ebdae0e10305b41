"""Mixed time stamps: one table-driven automaton over the bytes of a whole Arrow column, votes by source, resolution.

The automaton's table is written once from the layouts below: a state is a place in a layout, a class is a set of bytes that no state tells apart.
All stamps of a batch advance by one byte in each step; with the next state, the table names a register and what becomes of it, value * factor + byte's
value, so that digits add up to numbers and letters choose a constant. The accepting state names the layout. Fields are then checked, turned
into days and seconds, and wall times into UTC, as arrays.

Day-first or month-first is settled after that. Stamps that only one order makes possible vote; votes are summed by source (partial sums before the
exchange), and meet the stamps in question by (source, salt), so that a hot source is dealt over `salts` tasks. Only stamps with two slashes take
part; all others are final after one pass over the rows without an exchange. Nothing is broadcast or collected.

Stated cases. Null, empty and other texts: rule "bad", no time. A date without offset whose zone is null or unknown can't be placed: bad, too, and
without a vote. A null source is a source of its own. Repeated rows each vote. Years are 2000 to 2099. White space around a stamp is
`[\\x20\\x09-\\x0D]`. Very long texts are bad once they are longer than any layout. No rows: no rows. Other columns aren't read and may have any names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.words import NOT_SPACE, slices

MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
#: Dates as sequences: # is a digit of the next number, b a month's name, anything else itself. Numbers of a date are told apart by what stands between.
DATES = {"y-m-d": "####-##-##", "ymd": "########", "d.m.y": "##.##.####", "d b y": "## b ####", "slashed": "##/##/####"}
EPOCHS = {"seconds": 10, "milliseconds": 13}
#: One side must have more than this many times the votes of the other.
VOTES_OVER = 10

# Registers: the last one takes what no layout reads.
FIRST, SECOND, THIRD, MONTH, HOUR, MINUTE, SECOND_OF_MINUTE, HALF, SIGN, OFFSET_HOUR, OFFSET_MINUTE, _NONE = range(12)
_DEAD = 0


class Table(NamedTuple):
    #: class of each byte
    classes: np.ndarray
    #: by state * n_classes + class
    next_state: np.ndarray
    register: np.ndarray
    factor: np.ndarray
    value: np.ndarray
    #: by state: index into `layouts`, or -1
    accepts: np.ndarray
    layouts: list[str]
    start: int
    longest: int


class _Builder:
    """Collects arcs (state, byte) -> (state, register, factor, value); states are any hashable names."""

    def __init__(self) -> None:
        self.arcs: dict[tuple, dict[str, tuple]] = {}
        self.accepts: dict[tuple, str] = {}

    def arc(self, state: tuple, chars: str, to: tuple, register: int = _NONE, constant: int | None = None) -> None:
        for c in chars:
            arc = (to, register, 10, int(c)) if constant is None and register != _NONE else (to, register, 0, constant or 0)
            if self.arcs.setdefault(state, {}).setdefault(c, arc) != arc:
                raise ValueError(f"{state} has two ways on {c!r}")

    def digits(self, state: tuple, to: tuple, register: int, n: int = 2) -> None:
        for k in range(n):
            here, there = (state if k == 0 else (*to, k)), (to if k == n - 1 else (*to, k + 1))
            self.arc(here, "0123456789", there, register)


def _times(b: _Builder, layout: str, end: tuple) -> None:
    """The optional time after a date: hours, minutes, seconds, half of the day, offset."""
    at = lambda *name: (layout, *name)
    b.accepts[end] = layout
    b.arc(end, "T ", at("time"))
    b.digits(at("time"), at("hour"), HOUR)
    b.arc(at("hour"), ":", at("colon"))
    b.digits(at("colon"), at("minute"), MINUTE)
    b.arc(at("minute"), ":", at("colon2"))
    b.digits(at("colon2"), at("second"), SECOND_OF_MINUTE)
    for here in (at("minute"), at("second")):
        b.accepts[here] = layout
        b.arc(here, " ", at("space"))
        for state in (here, at("space")):
            b.arc(state, "A", at("half"), HALF, 1)
            b.arc(state, "P", at("half"), HALF, 2)
            _offset(b, at, state)
    b.arc(at("half"), "M", at("halved"))
    b.accepts[at("halved")] = layout
    b.arc(at("halved"), " ", at("space2"))
    _offset(b, at, at("halved"))
    _offset(b, at, at("space2"))
    b.digits(at("sign"), at("offset"), OFFSET_HOUR)
    b.arc(at("offset"), ":", at("colon3"))
    b.digits(at("colon3"), at("placed"), OFFSET_MINUTE)
    b.digits(at("offset"), at("placed"), OFFSET_MINUTE)
    b.accepts[at("placed")] = layout


def _offset(b: _Builder, at, state: tuple) -> None:
    b.arc(state, "Z", at("placed"), SIGN, 1)
    b.arc(state, "+", at("sign"), SIGN, 1)
    b.arc(state, "-", at("sign"), SIGN, 2)


@cache
def table() -> Table:
    b = _Builder()
    # Leading digits are shared: until something else comes, a number may still be a day, a year, a date or an epoch.
    for k in range(max(EPOCHS.values())):
        b.arc(("digits", k), "0123456789", ("digits", k + 1), FIRST)
    for name, n in EPOCHS.items():
        b.accepts[("digits", n)] = name
    for layout, shape in DATES.items():
        lead = len(shape) - len(shape.lstrip("#"))
        state, number = ("digits", lead), FIRST
        for k in range(lead, len(shape)):
            to = (layout, "date", k)
            if shape[k] == "#":
                b.arc(state, "0123456789", to, number)
            elif shape[k] == "b":
                for i, name in enumerate(MONTHS):
                    spelled = [state, *[(layout, name[: j + 1]) for j in range(2)], to]
                    for j, c in enumerate(name):
                        last = j == 2
                        b.arc(spelled[j], c, spelled[j + 1], MONTH if last else _NONE, i + 1 if last else None)
            else:
                number += 1 if shape[k + 1] == "#" else 0
                b.arc(state, shape[k], to)
            state = to
        _times(b, layout, state)
    return _packed(b)


def _packed(b: _Builder) -> Table:
    states = [("dead",), ("digits", 0)]
    known = set(states)
    for state in states:
        for to, *_ in b.arcs.get(state, {}).values():
            if to not in known:
                known.add(to)
                states.append(to)
    number = {s: i for i, s in enumerate(states)}
    used = sorted({c for arcs in b.arcs.values() for c in arcs})
    classes = np.zeros(256, np.intp)  # class 0: bytes that end every stamp
    for i, c in enumerate(used):
        classes[ord(c)] = i + 1
    n = len(used) + 1
    shape = len(states) * n
    next_state, register, factor, value = np.full(shape, _DEAD, np.intp), np.full(shape, _NONE, np.intp), np.zeros(shape, np.int64), np.zeros(shape, np.int64)
    for state, arcs in b.arcs.items():
        for c, (to, r, f, v) in arcs.items():
            key = number[state] * n + int(classes[ord(c)])
            next_state[key], register[key], factor[key], value[key] = number[to], r, f, v
    layouts = [*EPOCHS, *DATES]
    accepts = np.full(len(states), -1)
    for state, layout in b.accepts.items():
        accepts[number[state]] = layouts.index(layout)
    longest = max(len(s) for s in DATES.values()) + 2 + len(" 00:00:00 AM +00:00")
    return Table(classes, next_state, register, factor, value, accepts, layouts, number[("digits", 0)], longest)


def scan(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The layout's number of each stamp (-1: none), and its registers (one row for each register)."""
    t = table()
    n_classes = len(t.accepts) and len(t.next_state) // len(t.accepts)
    layout = np.full(len(column), -1)
    registers = np.zeros((len(column), _NONE + 1), np.int64)
    for part in slices(column):
        solid = np.flatnonzero(NOT_SPACE[part.data])
        first, last = (np.searchsorted(solid, part.offsets[:-1]), np.searchsorted(solid, part.offsets[1:]) - 1) if len(solid) else (np.zeros(0, int), np.zeros(0, int))
        if not len(solid):
            continue
        lengths = np.where(last >= first, solid[np.minimum(last, len(solid) - 1)] - solid[np.minimum(first, len(solid) - 1)] + 1, 0)
        begins = solid[np.minimum(first, len(solid) - 1)]
        alive = np.flatnonzero((lengths > 0) & (lengths <= t.longest))
        alive = alive[np.argsort(lengths[alive], kind="stable")]
        ends = lengths[alive]
        state = np.full(len(alive), t.start, np.intp)
        kept = registers[part.first : part.last].reshape(-1)
        classes = t.classes[part.data]
        for step in range(int(ends[-1]) if len(ends) else 0):
            going = int(np.searchsorted(ends, step, "right"))  # stamps that are longer than the step, as they are sorted by length
            rows = alive[going:]
            key = state[going:] * n_classes + classes[begins[rows] + step]
            at = rows * (_NONE + 1) + t.register[key]
            kept[at] = kept[at] * t.factor[key] + t.value[key]
            state[going:] = t.next_state[key]
        layout[part.first + alive] = t.accepts[state]
    return layout, registers.T


def _days(year: np.ndarray, month: np.ndarray, day: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970-01-01, and whether there is such a date between 2000 and 2099."""
    ok = (year >= 2000) & (year <= 2099) & (month >= 1) & (month <= 12)
    whole = np.where(ok, (year - 1970) * 12 + month - 1, 0).astype("datetime64[M]")
    first = whole.astype("datetime64[D]").astype(np.int64)
    length = (whole + 1).astype("datetime64[D]").astype(np.int64) - first
    ok &= (day >= 1) & (day <= length)
    return first + day - 1, ok


@cache
def _changes(zone: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Of a zone: wall seconds from which each offset counts, and up to which it is in question; the offsets; None if there is no such zone.

    Offsets are looked up day by day from 1999 to 2101, and each change is then found to the second.
    """
    from zoneinfo import ZoneInfo

    try:
        rules = ZoneInfo(zone)
    except (OSError, ValueError, KeyError):
        return None
    epoch = datetime(1970, 1, 1, tzinfo=UTC)
    offset = lambda second: int((epoch + timedelta(seconds=second)).astimezone(rules).utcoffset().total_seconds())
    days = range(int((datetime(1999, 12, 1, tzinfo=UTC) - epoch).total_seconds()), int((datetime(2100, 2, 1, tzinfo=UTC) - epoch).total_seconds()), 86400)
    begins, until, offsets = [-(1 << 62)], [-(1 << 62)], [offset(days[0])]
    for day in days:
        new = offset(day)
        if new != offsets[-1]:
            second = bisect_left(range(day - 86400, day), True, key=lambda s: offset(s) != offsets[-1]) + day - 86400  # noqa: B023
            begins.append(second + min(offsets[-1], new))
            until.append(second + max(offsets[-1], new))
            offsets.append(new)
    return np.array(begins), np.array(until), np.array(offsets), np.array(begins[1:])


def _placed(wall: np.ndarray, zones: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTC seconds of wall seconds, whether the zone skips or repeats them, and whether the zone is known.

    From the earlier wall time of a change on, the offset after it counts; up to the later one the wall time is in question.
    """
    out, unsure, known = wall.copy(), np.zeros(len(wall), bool), np.zeros(len(wall), bool)
    coded = zones.cast(pa.string()).dictionary_encode()
    code = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)
    for i, zone in enumerate(coded.dictionary.to_pylist()):
        changes = _changes(zone)
        if changes is None:
            continue
        begins, until, offsets, _ = changes
        mine = np.flatnonzero(code == i)
        at = np.searchsorted(begins, wall[mine], "right") - 1
        out[mine], unsure[mine], known[mine] = wall[mine] - offsets[at], wall[mine] < until[at], True
    return out, unsure, known


#: What the pass over the rows gives: the time and doubt by each order (equal but for slashed stamps), and what is known of the order.
_PARSED = "utc_first long, unsure_first boolean, utc_second long, unsure_second boolean, state string"


def parse(raw: pa.Array | pa.ChunkedArray, zones: pa.Array | pa.ChunkedArray) -> dict[str, pa.Array]:
    """For each stamp: UTC microseconds with the day first and with the month first, and its state.

    The state is bad, epoch, plain, day (only the day can be first), month (only the month can), or either.
    """
    raw, zones = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (raw, zones))
    layout, r = scan(raw)
    names = table().layouts
    is_a = lambda name: layout == names.index(name)
    epoch = is_a("seconds") | is_a("milliseconds")

    hour = np.where(r[HALF] > 0, r[HOUR] % 12 + 12 * (r[HALF] == 2), r[HOUR])
    clock = np.where(r[HALF] > 0, (r[HOUR] >= 1) & (r[HOUR] <= 12), r[HOUR] < 24) & (r[MINUTE] < 60) & (r[SECOND_OF_MINUTE] < 60)
    clock &= (r[OFFSET_HOUR] <= 14) & (r[OFFSET_MINUTE] < 60) & (layout >= 0) & ~epoch
    of_day = hour * 3600 + r[MINUTE] * 60 + r[SECOND_OF_MINUTE]
    offset = (r[OFFSET_HOUR] * 60 + r[OFFSET_MINUTE]) * 60 * np.where(r[SIGN] == 2, -1, 1)

    ymd, dashed, dotted, named, slashed = (is_a(x) for x in ("ymd", "y-m-d", "d.m.y", "d b y", "slashed"))
    year = np.select([ymd, dashed, named], [r[FIRST] // 10000, r[FIRST], r[SECOND]], r[THIRD])
    month = np.select([ymd, named], [r[FIRST] // 100 % 100, r[MONTH]], r[SECOND])
    day = np.select([ymd, dashed], [r[FIRST] % 100, r[THIRD]], r[FIRST])

    def timed(month: np.ndarray, day: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        days, ok = _days(year, month, day)
        ok &= clock & which
        wall = np.where(ok, days * 86400 + of_day, 0)
        local = ok & (r[SIGN] == 0)
        utc, unsure, known = _placed(wall, zones)
        return np.where(local, utc, wall - offset), unsure & local & known, ok & (known | ~local)

    first, unsure_first, ok_first = timed(month, day, clock)
    second, unsure_second, ok_second = timed(r[FIRST], r[SECOND], slashed)
    both = slashed & ok_first & ok_second
    state = np.select(
        [epoch, both & (first == second) & (r[FIRST] == r[SECOND]), both, slashed & ok_first, slashed & ok_second, ok_first],
        ["epoch", "plain", "either", "day", "month", "plain"],
        "bad",
    )
    count = np.where(is_a("seconds"), r[FIRST] * 1_000_000, r[FIRST] * 1_000)
    utc_first, utc_second = np.where(epoch, count, first * 1_000_000), np.where(ok_second, second * 1_000_000, 0)
    return {
        "utc_first": pa.array(utc_first, pa.int64(), mask=~(ok_first | epoch)),
        "unsure_first": pa.array(unsure_first),
        "utc_second": pa.array(utc_second, pa.int64(), mask=~ok_second),
        "unsure_second": pa.array(unsure_second),
        "state": pa.array(state.astype(object), pa.string()),
    }


def _parsed(rows: DataFrame) -> DataFrame:
    """Rows (id, source, zone, raw) with what parse() tells of them instead of zone and raw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = parse(batch.column("raw"), batch.column("zone"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("source"), *got.values()], ["id", "source", *got])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("id", "source"))
    return rows.mapInArrow(run, f"{kinds}, {_PARSED}")


def normalise_times(
    df: DataFrame, id_col: str = "stamp_id", source_col: str = "source", zone_col: str = "zone", raw_col: str = "raw", votes_over: int = VOTES_OVER, salts: int = 32
) -> DataFrame:
    """(id, utc_us, rule, ambiguous, day_votes, month_votes) for each row; votes are those of the source, null unless they were asked.

    votes_over: how many times the other order's votes an order must exceed. salts: tasks over which one source's slashed stamps are dealt.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(zone_col).cast("string").alias("zone"), F.col(raw_col).cast("string").alias("raw"))
    has_slash = F.coalesce(F.contains("raw", F.lit("/")), F.lit(False))
    nothing = F.lit(None).cast("long")
    others = _parsed(rows.where(~has_slash)).select("*", nothing.alias("day_votes"), nothing.alias("month_votes"))
    slashed = _parsed(rows.where(has_slash))
    votes = slashed.where(F.col("state").isin("day", "month")).groupBy("source").agg(F.count_if(F.col("state") == "day").alias("day_votes"), F.count_if(F.col("state") == "month").alias("month_votes"))
    votes = votes.select(F.col("source").alias("of"), "day_votes", "month_votes", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt_of"))
    # A null source is joined as one; the salt follows the row, so that a repeated task deals alike.
    salted = slashed.withColumn("salt", F.pmod(F.xxhash64("id", "utc_first", "utc_second"), F.lit(salts)).cast("int"))
    joined = salted.join(votes.hint("merge"), F.col("source").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("salt_of")), "left")
    asked = F.col("state") == "either"
    judged = joined.select("id", "source", "utc_first", "unsure_first", "utc_second", "unsure_second", "state", *[F.when(asked, F.coalesce(c, F.lit(0))).alias(c) for c in ("day_votes", "month_votes")])
    every = others.unionByName(judged)
    day_wins, month_wins = F.col("day_votes") > votes_over * F.col("month_votes"), F.col("month_votes") > votes_over * F.col("day_votes")
    second = (F.col("state") == "month") | (asked & month_wins)
    unsure = F.when(second, F.col("unsure_second")).otherwise(F.col("unsure_first"))
    return every.select(
        "id",
        F.when(F.col("state") != "bad", F.when(second, F.col("utc_second")).otherwise(F.col("utc_first"))).alias("utc_us"),
        F.when(F.col("state").isin("bad", "epoch"), F.col("state")).when(asked, F.when(day_wins | month_wins, "votes").otherwise("default")).otherwise("plain").alias("rule"),
        (asked | (unsure & ~F.col("state").isin("bad", "epoch"))).alias("ambiguous"),
        "day_votes", "month_votes",
    )
