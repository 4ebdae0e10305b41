import re
from collections import Counter
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import numpy as np
import pyarrow as pa

from palimpsest.llm.timestamps import MONTHS, normalise_times, scan, table

TIME = r"(?:[T ](\d\d):(\d\d)(?::(\d\d))?(?: ?([AP])M)?(?: ?(Z|[+-]\d\d:?\d\d))?)?"
SHAPES = {
    "y-m-d": r"(20\d\d)-(\d\d)-(\d\d)", "ymd": r"(20\d\d)(\d\d)(\d\d)", "d.m.y": r"(\d\d)\.(\d\d)\.(20\d\d)", "d b y": rf"(\d\d) ({'|'.join(MONTHS)}) (20\d\d)", "slashed": r"(\d\d)/(\d\d)/(20\d\d)",
}
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def plain_place(wall, zone):
    """(UTC seconds, doubtful) of a wall time; None where the zone is none. All UTC times around are tried."""
    try:
        rules = ZoneInfo(zone)
    except Exception:
        return None
    seconds = int((wall - datetime(1970, 1, 1)).total_seconds())
    offset = lambda s: int((EPOCH + timedelta(seconds=s)).astimezone(rules).utcoffset().total_seconds())
    before, after = offset(seconds - 86400), offset(seconds + 86400)
    fits = sorted({s for s in (seconds - before, seconds - after) if s + offset(s) == seconds})
    if len(fits) == 1:
        return fits[0], False
    return seconds - after, True  # skipped or repeated: the offset after the change


def plain(raw, zone):
    """(kind, {order: (utc, doubtful)})"""
    raw = re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", raw or "")
    if re.fullmatch(r"[0-9]{10}|[0-9]{13}", raw):
        return "epoch", {"day": (int(raw) * (10**6 if len(raw) == 10 else 1000), False)}
    for name, shape in SHAPES.items():
        m = re.fullmatch(shape + TIME, raw, re.ASCII)
        if not m:
            continue
        a, b, c, h, mi, s, half, off = m.groups()
        orders = {"day": (a, b, c)} if name in ("y-m-d", "ymd") else {"day": (c, MONTHS.index(b) + 1 if name == "d b y" else b, a)}
        if name == "slashed":
            orders["month"] = (c, a, b)
        hour = int(h or 0)
        if half and not 1 <= hour <= 12:
            return "bad", {}
        hour = hour % 12 + 12 * (half == "P") if half else hour
        if off and off != "Z" and (int(off[1:3]) > 14 or int(off[-2:]) > 59):
            return "bad", {}
        out = {}
        for order, ymd in orders.items():
            try:
                wall = datetime(*map(int, ymd), hour, int(mi or 0), int(s or 0))
            except ValueError:
                continue
            if off:
                shift = 0 if off == "Z" else (int(off[1:3]) * 60 + int(off[-2:])) * 60 * (-1 if off[0] == "-" else 1)
                out[order] = (int((wall - datetime(1970, 1, 1)).total_seconds()) - shift, False)
            elif (placed := plain_place(wall, zone)) is not None:
                out[order] = placed
        out = {k: (u * 10**6, d) for k, (u, d) in out.items()}
        return ("slashed" if name == "slashed" else "plain") if out else "bad", out
    return "bad", {}


def brute(rows):
    read = [(i, source, *plain(raw, zone), raw) for i, source, zone, raw in rows]
    votes = Counter((source, *out) for _, source, kind, out, _ in read if kind == "slashed" and len(out) == 1)
    result = []
    for i, source, kind, out, raw in read:
        if not out:
            result.append((i, None, "bad", False))
        elif kind != "slashed" or len(out) == 1 or out["day"][0] == out["month"][0] and raw.strip()[:2] == raw.strip()[3:5]:
            utc, doubt = next(iter(out.values()))
            result.append((i, utc, "epoch" if kind == "epoch" else "plain", doubt))
        else:
            d, m = votes[source, "day"], votes[source, "month"]
            result.append((i, out["month" if m > 10 * d else "day"][0], "votes" if m > 10 * d or d > 10 * m else "default", True))
    return result


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "stamp_id long, source string, zone string, raw string, id string, state int")
    got = [(r["id"], r["utc_us"], r["rule"], r["ambiguous"]) for r in normalise_times(df, salts=3).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)
    return got


def test_stamps_of_all_shapes(spark):
    dates = ["2024-02-29", "2023-02-29", "20240229", "20241301", "29.02.2024", "31.04.2024", "01 Jan 2024", "31 Sep 2024", "1999-12-31", "2000-01-01", "2099-12-31", "01 jan 2024", "01.13.2024", "00.01.2024", "1/2/2024", "3/31/2024", "05/05/2024", "31/12/2024", "12/31/2024", "04/05/2024", "31/31/2024", "02/30/2024"]
    times = ["", "T00:00", " 23:59:59", " 24:00", " 12:60", " 12:00:60", " 12:00 AM", " 12:30:10PM", " 00:30 AM", " 13:00 PM", "T10:11Z", "T10:11 Z", " 10:11:12+05:30", " 10:11:12 -0800", " 10:11+1500", " 10:11+1459", " 10:11+05:60", " 01:02 PM +01:00", " 01:02PMZ", " 1:02", "T", " 10", " 10:11:", " 10:11 ", " 10:11  Z", " 10:11+5"]
    rows = [(i, "s", "Europe/Berlin", d + t) for i, (d, t) in enumerate((d, t) for d in dates for t in times)]
    odd = [None, "", " \t\n", "0", "1713147865", "1724988567125", "12345678901", "123456789012345678901234567890", "２０２４-01-01", "2024-01-01 ", "\x0b2024-01-01\r", "x" * 100_000, "2024-01-01 10:11" * 5000, "n/a", "//", "Jan", "00 Jan 2024", "01 Jan 2024T10:11", "9" * 10, "0" * 13]
    rows += [(10_000 + i, None, None if i % 2 else "UTC", x) for i, x in enumerate(odd)]
    got = check(spark, rows)
    assert {"bad", "plain", "epoch"} < {r[2] for r in got}


def test_changes_of_offset(spark):
    zones = ["America/New_York", "Europe/Berlin", "Australia/Lord_Howe", "Asia/Kolkata", "America/Sao_Paulo", "Africa/Casablanca", "Pacific/Apia", "UTC", "No/Where", "", None]
    walls = [f"{day} {h:02}:{m}" for day in ("2024-03-10", "2024-11-03", "2024-03-31", "2024-10-27", "2024-04-07", "2024-10-06", "2018-11-04", "2018-02-18", "2011-12-29", "2011-12-30", "2011-12-31", "2024-03-10", "2024-04-14") for h in range(5) for m in ("00", "29", "30", "59")]
    rows = [(i, "s", z, w) for i, (z, w) in enumerate((z, w) for z in zones for w in [*walls, "10/03/2024", "2018-11-04", "2024-03-10T02:30Z"])]
    got = check(spark, rows)
    assert sum(r[3] for r in got) > 50


def test_votes_by_source(spark):
    rows, n = [], 0

    def add(source, raw, times=1, zone="UTC"):
        nonlocal n
        for _ in range(times):
            rows.append((n, source, zone, raw))
            n += 1

    for source, day, month in [("none", 0, 0), ("one", 1, 0), ("ten", 10, 1), ("eleven", 11, 1), ("month", 2, 21), ("month20", 2, 20), (None, 0, 3), ("", 5, 0)]:
        add(source, "31/01/2024 10:00", day)
        add(source, "01/31/2024 10:00", month)
        add(source, "01/02/2024 10:00", 2)
        add(source, "03/03/2024 10:00")
        add(source, "31/01/2024 25:00", 30)  # bad stamps don't vote
        add(source, "01/31/2024", 30, "No/Where")
        add(source, "10/03/2024 02:30", 1, "America/New_York")
    rows.append(rows[0])
    check(spark, rows)
    assert normalise_times(spark.createDataFrame([], "stamp_id long, source string, zone string, raw string")).count() == 0


def test_the_table_takes_what_its_layouts_take():
    t = table()
    texts = ["2024-01-02", "20240102", "02.01.2024", "02 Jan 2024", "02/01/2024", "0123456789", "0123456789012", "2024-01-02 03:04:05 PM -06:07", "01234567890"]
    layout, registers = scan(pa.array(["", None, *texts, "x"]))
    assert [t.layouts[i] if i >= 0 else None for i in layout] == [None, None, "y-m-d", "ymd", "d.m.y", "d b y", "slashed", "seconds", "milliseconds", "y-m-d", None, None]
    assert registers[:11, 9].tolist() == [2024, 1, 2, 0, 3, 4, 5, 2, 2, 6, 7]
    assert max(len(x) for x in ("02 Jan 2024 03:04:05 PM -06:07", "2024-01-02")) <= t.longest
    assert np.array_equal(scan(pa.chunked_array([pa.array(["x", "2024-01-02"]).slice(1)]))[1][:3, 0], [2024, 1, 2])
