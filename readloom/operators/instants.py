"""Mixed date texts to one UTC instant.

Texts are parsed by native expressions into a local wall time, and an offset or zone if the text names one. Wall times that only have a zone are
resolved by an as-of join: for every zone in use the intervals of constant offset are laid out in local time, as the zone files list them and by their
yearly rule beyond, and exploded by the years in use, so that the join is a plain equi-join on (zone, year) that finds all intervals around a wall time. Two intervals that hold it mean an ambiguous hour, none a skipped one, one
gives the offset directly.
"""

from __future__ import annotations

import bisect
import calendar
import datetime as dt
import itertools
import os
import re
import struct
import zoneinfo
from functools import lru_cache
from importlib import resources
from pathlib import Path

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from readloom.functions import staged

#: Fixed offsets of zone abbreviations, in minutes east of Greenwich.
ABBREVIATIONS = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MET": 60, "MEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "NPT": 345, "JST": 540, "KST": 540, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AKST": -540, "AKDT": -480, "HST": -600,
}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
#: Largest offset that a text may state, in minutes.
MAX_OFFSET = 14 * 60
#: Years that are looked up as they are. Before the first no zone has left its first offset. From the second on only the yearly rules at the end of the zone
#: files hold, and these repeat with the calendar, so later years are looked up 400 years, or a multiple, before.
FIRST_YEAR, RULE_YEAR, CYCLE = 1700, 2100, 400
CYCLE_SECONDS = 146_097 * 86_400
#: Pairs of zone and year that are broadcast; beyond it the join is left to the planner.
BROADCAST_PAIRS = 20_000
_EVER = 1 << 60

_EPOCH = dt.date(1970, 1, 1)
_ZONE_NAME = r"(?:<[^>]+>|[A-Za-z]{3,})"
_CLOCK = r"[+-]?\d{1,3}(?::\d{2}){0,2}"
_RULE = re.compile(rf"{_ZONE_NAME}(?P<std>{_CLOCK})(?:{_ZONE_NAME}(?P<dst>{_CLOCK})?(?:,(?P<start>[^,/]+)(?:/(?P<at>{_CLOCK}))?,(?P<end>[^,/]+)(?:/(?P<till>{_CLOCK}))?)?)?")


def _seconds(clock: str) -> int:
    """Seconds of [+-]h[:mm[:ss]]."""
    parts = [int(x) for x in clock.lstrip("+-").split(":")]
    total = sum(x * u for x, u in zip(parts, (3600, 60, 1), strict=False))
    return -total if clock.startswith("-") else total


def _rule_day(rule: str, year: int) -> int:
    """Days since 1970 of the day that a rule (Mm.w.d, Jn or n) names in a year."""
    jan = (dt.date(year, 1, 1) - _EPOCH).days
    if rule[0] == "M":
        month, week, weekday = (int(x) for x in rule[1:].split("."))
        first = (dt.date(year, month, 1) - _EPOCH).days
        day = first + (weekday - first - 4) % 7 + 7 * (week - 1)  # 1970 began on a Thursday
        after = (dt.date(year + month // 12, month % 12 + 1, 1) - _EPOCH).days
        return day - 7 if day >= after else day
    if rule[0] == "J":  # 29 February does not count
        n = int(rule[1:])
        return jan + n - 1 + int(n >= 60 and calendar.isleap(year))
    return jan + int(rule)


def _zone_data(zone: str) -> bytes:
    for root in zoneinfo.TZPATH:
        if os.path.isfile(path := os.path.join(root, *zone.split("/"))):
            return Path(path).read_bytes()
    return resources.files("tzdata").joinpath("zoneinfo", *zone.split("/")).read_bytes()


def read_zone(data: bytes) -> tuple[int, list[tuple[int, int]], str]:
    """(offset before the first change, (UTC second, offset from then on) of every change listed, rule for the time after) of a zone file."""
    at, width, counts = 0, 4, struct.unpack_from(">6l", data, 20)
    sizes = lambda c, w: c[3] * (w + 1) + c[4] * 6 + c[5] + c[2] * (w + 4) + c[1] + c[0]
    if data[4:5] >= b"2":  # the same again with longer numbers
        at = 44 + sizes(counts, 4)
        width, counts = 8, struct.unpack_from(">6l", data, at + 20)
    times, kinds, at = counts[3], counts[4], at + 44
    when = struct.unpack_from(f">{times}{'q' if width == 8 else 'l'}", data, at)
    which = data[at + times * width : at + times * (width + 1)]
    types = [struct.unpack_from(">l?", data, at + times * (width + 1) + 6 * i) for i in range(kinds)]
    first = next((off for off, summer in types if not summer), types[0][0])
    footer = data[at + sizes(counts, width) :].strip(b"\n").decode() if width == 8 else ""
    return first, [(t, types[i][0]) for t, i in zip(when, which, strict=True)], footer


@lru_cache(maxsize=1024)
def zone_intervals(zone: str) -> tuple[tuple[int, int, int], ...]:
    """(first UTC second, end UTC second, offset seconds) of the stretches of constant offset up to RULE_YEAR + CYCLE: the changes that the zone file lists
    and, after the last of them, those by its yearly rule."""
    offset, changes, footer = read_zone(_zone_data(zone))
    last = changes[-1][0] if changes else -_EVER
    if m := _RULE.fullmatch(footer):
        std = -_seconds(m["std"])
        if not m["start"]:
            changes = changes if changes else [(-_EVER, std)]
        else:
            dst = -_seconds(m["dst"]) if m["dst"] else std + 3600
            begin = (_EPOCH + dt.timedelta(days=max(last, 0) // 86400)).year - 1
            by_rule = []
            for year in range(begin, RULE_YEAR + CYCLE + 2):
                by_rule.append((_rule_day(m["start"], year) * 86400 + _seconds(m["at"] or "2") - std, dst))
                by_rule.append((_rule_day(m["end"], year) * 86400 + _seconds(m["till"] or "2") - dst, std))
            changes = changes + [c for c in sorted(by_rule) if c[0] > last]
    out: list[tuple[int, int, int]] = []
    start = -_EVER
    for i, (t, new) in enumerate(changes):
        if new != offset and not (i + 1 < len(changes) and changes[i + 1][0] == t):
            if t > start:
                out.append((start, t, offset))
            start, offset = t, new
    out.append((start, _EVER, offset))
    return tuple(out)


def zone_table(spark, pairs: list[tuple[str, int]]) -> DataFrame:
    """zone, year, spans ARRAY<STRUCT<lo, hi, until, off>>: local seconds [lo, hi) have offset off; [hi, until) is skipped and read with it.

    One row a pair of zone and year of local time, with the few spans that meet the year."""
    rows = []
    for zone, group in itertools.groupby(sorted(pairs), key=lambda p: p[0]):
        utc = zone_intervals(zone)
        spans = []
        for i, (u0, u1, off) in enumerate(utc):
            lo, hi = (u0 if u0 == -_EVER else u0 + off), (u1 if u1 == _EVER else u1 + off)
            spans.append((lo, hi, max(hi, utc[i + 1][0] + utc[i + 1][2]) if i + 1 < len(utc) else hi, off))
        starts, untils = [s[0] for s in spans], list(itertools.accumulate((s[2] for s in spans), max))
        for _, year in group:
            low, high = ((dt.date(y, 1, 1) - _EPOCH).days * 86400 for y in (year, year + 1))
            low = -_EVER if year == FIRST_YEAR else low
            rows.append(Row(zone=zone, year=year, spans=spans[bisect.bisect_right(untils, low) : bisect.bisect_left(starts, high)]))
    return spark.createDataFrame(rows, "zone STRING, year INT, spans ARRAY<STRUCT<lo: BIGINT, hi: BIGINT, until: BIGINT, off: INT>>")


def _int(c: Column) -> Column:
    return F.when(c != "", c.try_cast("int"))


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970 of a date that exists, else null."""
    ok = y.between(1, 9999) & m.between(1, 12) & d.between(1, 31)
    first = F.make_date(F.when(ok, y), F.when(ok, m), F.lit(1))
    return F.when(ok & (d <= F.dayofmonth(F.last_day(first))), F.datediff(first, F.lit("1970-01-01").cast("date")) + d - 1)


_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?: ?([AaPp])\.?[Mm]\.?(?![A-Za-z]))?"
_ZONE = r"(?: ?([+-]\d{2}(?::?\d{2})?))?(?: ?\[?([A-Za-z][A-Za-z0-9_+/-]*)\]?)?"
_LAYOUTS = (  # name, date and time groups; groups 1-3 date, then hour, minute, second, fraction, half, offset, zone
    ("iso", rf"\A(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})(?:(?:[Tt]| +){_TIME})?{_ZONE}\z"),
    ("basic", rf"\A(\d{{4}})(\d{{2}})(\d{{2}})(?:[Tt ](\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d+))?)?()?)?{_ZONE}\z"),
    ("named", rf"\A(?:[A-Za-z]{{3,9}},? )?(\d{{1,2}})[- ]([A-Za-z]{{3,9}})[- ,]+(\d{{4}})(?: +{_TIME})?{_ZONE}\z"),
    ("ynum", rf"\A(\d{{4}})[/.](\d{{1,2}})[/.](\d{{1,2}})(?:(?:[Tt]| +){_TIME})?{_ZONE}\z"),
    ("num", rf"\A(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}})(?:(?:[Tt]| +){_TIME})?{_ZONE}\z"),
)


def parse_wall_time(df: DataFrame, text: str, day_order: str) -> DataFrame:
    """Adds __wall (local seconds since 1970), __micro, __off (seconds, if stated), __zone (if named), __epoch (microseconds, if a bare count).

    __wall and __epoch are null for a text that fixes no instant."""
    t = F.regexp_replace(F.col(text), r"\A\s+|\s+\z", "")
    d = staged(df, __t=t)
    t = F.col("__t")
    digits = t.rlike(r"\A[0-9]{9,17}\z")
    n = F.length(t)
    count = t.try_cast("bigint")
    epoch = F.when(digits, F.when(n <= 11, count * 1_000_000).when(n <= 14, count * 1000).otherwise(count))
    layout = F
    for name, pattern in _LAYOUTS:
        layout = layout.when(t.rlike(pattern), F.lit(name))
    d = staged(d, __epoch=epoch, __layout=F.when(~digits, layout.otherwise(F.lit(None))))
    groups = F
    for name, pattern in _LAYOUTS:
        groups = groups.when(F.col("__layout") == name, F.array(*[F.regexp_extract(t, pattern, i) for i in range(1, 11)]))
    d = staged(d, __g=groups.otherwise(F.lit(None)))
    g = [F.get(F.col("__g"), F.lit(i)) for i in range(10)]
    low = F.lower(g[1])
    month = F.lit(None).cast("int")
    full = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
    for i, (m, long) in enumerate(zip(MONTHS, full, strict=True)):
        month = F.when((low == m) | (low == long) | ((low == "sept") & F.lit(m == "sep")), F.lit(i + 1)).otherwise(month)
    order, lay = F.col(day_order), F.col("__layout")
    a, b, c = (_int(g[i]) for i in range(3))
    y = F.when(lay.isin("iso", "basic", "ynum"), a).when(lay == "named", c).when((lay == "num") & order.isin("mdy", "dmy"), c)
    m = F.when(lay.isin("iso", "basic", "ynum"), b).when(lay == "named", month).when(order == "mdy", a).when(order == "dmy", b)
    day = F.when(lay.isin("iso", "basic", "ynum"), c).when(lay == "named", a).when(order == "mdy", b).when(order == "dmy", a)
    half = F.lower(g[7])
    hour = F.coalesce(_int(g[3]), F.lit(0))
    hour_ok = F.when(half != "", hour.between(1, 12)).otherwise(hour.between(0, 23))
    hour24 = F.when(half == "a", hour % 12).when(half == "p", hour % 12 + 12).otherwise(hour)
    minute, second = F.coalesce(_int(g[4]), F.lit(0)), F.coalesce(_int(g[5]), F.lit(0))
    micro = F.rpad(F.substring(g[6], 1, 6), 6, "0").try_cast("int")
    off_digits = F.replace(g[8], F.lit(":"), F.lit(""))
    off_h, off_m = _int(F.substring(off_digits, 2, 2)), F.coalesce(_int(F.substring(off_digits, 4, 2)), F.lit(0))
    off = F.when(g[8] != "", (off_h * 60 + off_m) * F.when(g[8].startswith("-"), F.lit(-60)).otherwise(F.lit(60)))
    off_ok = (g[8] == "") | ((off_m <= 59) & (off_h * 60 + off_m <= MAX_OFFSET))
    name = g[9]
    fixed = F.lit(None).cast("int")
    for minutes in sorted(set(ABBREVIATIONS.values())):
        fixed = F.when(F.upper(name).isin(*[k for k, v in ABBREVIATIONS.items() if v == minutes]), F.lit(minutes * 60)).otherwise(fixed)
    d = staged(d, __y=y, __m=m, __d=day, __name=name, __off=F.when(off_ok, F.coalesce(off, F.when(name != "", fixed))), __off_ok=off_ok, __micro=F.coalesce(micro, F.lit(0)),
               __clock=F.when(hour_ok & (minute <= 59) & (second <= 59), hour24 * 3600 + minute * 60 + second))
    days = _days(F.col("__y"), F.col("__m"), F.col("__d"))
    d = staged(
        d,
        __wall=F.when(F.col("__off_ok"), days.cast("bigint") * 86400 + F.col("__clock")),
        __zone=F.when(F.col("__off").isNull() & (F.col("__name") != ""), F.col("__name")),
    )
    return d.drop("__g", "__layout", "__t", "__y", "__m", "__d", "__name", "__off_ok", "__clock")


#: ISO 8601 as header dates use it: a date, perhaps a time, perhaps an offset; colons count for nothing.
ISO = r"\A\d{4}-\d{2}-\d{2}(?:T\d{2}:?\d{2}(?::?\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?\z"


def iso_dates(df: DataFrame, text: str, keep: list[str], local_offset: int = 0) -> DataFrame:
    """keep + `iso`: the date as yyyy-MM-ddTHH:mm:ss+0000, null for texts of another form and impossible dates.

    A date without zone is local; local_offset is the offset of local time in seconds."""
    full = F.regexp_replace(F.regexp_replace(F.col(text), r"(T\d{2}):?(\d{2})", "$1:$2"), r"(T\d{2}:\d{2}):?(\d{2})", "$1:$2")
    d = df.select(*keep, F.when(F.col(text).rlike(ISO), full).alias("__text"), F.lit("ymd").alias("__order"))
    p = parse_wall_time(d, "__text", "__order")
    utc = utc_text((F.col("__wall") - F.coalesce("__off", F.lit(local_offset))) * 1_000_000)
    return p.select(*keep, F.concat(F.substring(utc, 1, 19), F.lit("+0000")).alias("iso"))


def utc_text(micros: Column) -> Column:
    """Microseconds since 1970 as yyyy-MM-ddTHH:mm:ss.ffffffZ, whatever the session's zone."""
    rest = F.pmod(micros, F.lit(86_400_000_000))
    day = F.try_divide(micros - rest, F.lit(86_400_000_000)).cast("int")
    part = lambda unit, mod, width: F.lpad((F.floor(rest / unit) % mod).cast("string"), width, "0")
    date = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), day), "yyyy-MM-dd")
    return F.concat(date, F.lit("T"), part(3_600_000_000, 24, 2), F.lit(":"), part(60_000_000, 60, 2), F.lit(":"), part(1_000_000, 60, 2), F.lit("."), part(1, 1_000_000, 6), F.lit("Z"))


def normalise_instants(df: DataFrame, text: str, place_zones: DataFrame, place: str, keep: list[str]) -> DataFrame:
    """keep + `micros` (UTC microseconds, null if the text fixes no instant) + `status`.

    df: text is the raw date, place the key into place_zones(place, zone, day_order); a place listed twice counts once, by the smaller row. Status is
    `stated` (offset or count in the text), `unique`, `ambiguous` (an hour that occurs twice: the earlier instant), `nonexistent` (a skipped hour: read
    with the offset in force before it) or `none`. Null and empty texts, unknown zones and places without zone give `none`. Every row of df comes out once.
    """
    spark = df.sparkSession
    places = place_zones.groupBy(F.col("center").alias("__place")).agg(F.min(F.struct("zone", "day_order")).alias("__home")).where("__place IS NOT NULL")
    rows = df.select(*keep, F.col(text).alias("__text"), F.col(place).alias("__place")).join(places, "__place", "left")
    parsed = parse_wall_time(rows.withColumn("__order", F.col("__home.day_order")), "__text", "__order")
    zoned = staged(parsed, __z=F.when(F.col("__wall").isNotNull() & F.col("__off").isNull(), F.coalesce("__zone", F.col("__home.zone"))))
    year = F.year(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("__wall") / 86400).cast("int")))
    cycles = F.greatest(F.lit(0), F.floor((year - RULE_YEAR) / CYCLE))
    zoned = zoned.withColumn("__y", F.greatest(year - cycles * CYCLE, F.lit(FIRST_YEAR)).cast("int")).withColumn("__w", F.col("__wall") - cycles * CYCLE_SECONDS)
    known = sorted(zoneinfo.available_timezones())
    # at most the zones that exist times the years up to RULE_YEAR + CYCLE, whatever the size of df
    pairs = [(r[0], r[1]) for r in zoned.where(F.col("__z").isin(known)).select("__z", "__y").distinct().collect()]
    spans = zone_table(spark, pairs).withColumnsRenamed({"zone": "__z", "year": "__y"})
    if len(pairs) <= BROADCAST_PAIRS:
        spans = F.broadcast(spans)
    joined = zoned.join(spans, ["__z", "__y"], "left")
    w, folded = F.col("__wall"), F.col("__w")
    holding = F.filter("spans", lambda s: (s["lo"] <= folded) & (folded < s["hi"]))
    before = F.filter("spans", lambda s: (s["hi"] <= folded) & (folded < s["until"]))
    found = F.when(F.size(holding) > 0, holding).otherwise(before)
    by_zone = F.array_min(F.transform(found, lambda s: w - s["off"]))
    seconds = F.when(F.col("__off").isNotNull(), w - F.col("__off")).otherwise(by_zone)
    micros = F.coalesce(F.col("__epoch"), seconds * 1_000_000 + F.col("__micro"))
    status = (
        F.when(micros.isNull(), "none").when(F.col("__epoch").isNotNull() | F.col("__off").isNotNull(), "stated").when(F.size(holding) == 1, "unique").when(F.size(holding) > 1, "ambiguous").otherwise("nonexistent")
    )
    return staged(joined, __us=micros, __st=status).select(*keep, F.col("__us").alias("micros"), F.col("__st").alias("status"))
