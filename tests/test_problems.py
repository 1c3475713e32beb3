"""Problems 1 to 6 against brute force, and their edge cases."""

import bisect
import datetime as dt
import math
import random
import re
import zoneinfo
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from readloom.operators import instants, intervals, orphans, percentiles, rejects, skew
from readloom.plans import general
from tests.conftest import rows


# --- 1 intervals
def brute_periods(items):
    by = defaultdict(list)
    for k, b, e in items:
        if b is not None and e is not None and e > b:
            by[k].append((b, e))
    out = set()
    for k, v in by.items():
        merged = []
        for b, e in sorted(v):
            if merged and b <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([b, e])
        out |= {(k, "period", b, e) for b, e in merged} | {(k, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:], strict=False)}
    return out


@pytest.mark.parametrize("width", [1, 5, 64, 1 << 16])
def test_intervals_brute(spark, width):
    rnd = random.Random(width)
    items = [(rnd.choice(["a", "b", None]), b := rnd.randrange(-50, 3000), b + rnd.choice([0, 1, 2, 3, 7, 90, 400])) for _ in range(500)]
    items += [("a", None, 5), ("a", 5, None), ("hot", 0, 10**12), ("hot", 5, 6), ("hot", 10**12, 10**12 + 5), ("hot", 2 * 10**12, 2 * 10**12 + 1)] + [("b", 7, 9)] * 5
    df = spark.createDataFrame([(k, b, e, 1, "x") for k, b, e in items], "k STRING, b LONG, e LONG, kind INT, __b STRING")
    got = intervals.merge_intervals(df, ["k"], "b", "e", width)
    assert {tuple(r) for r in got.collect()} == brute_periods(items) and got.count() == len(brute_periods(items))


def test_intervals_empty(spark):
    assert intervals.merge_intervals(spark.createDataFrame([], "k INT, b LONG, e LONG"), ["k"], "b", "e").count() == 0


# --- 2 rejects
def brute_reason(line):
    """The statement of TESTDATA.md, line by line."""
    if line is None:
        return "fields"
    f = line.removesuffix("\r").split("\t")
    if len(f) < 11:
        return "fields"
    for i, x in enumerate(f):
        if i != 10 and x.startswith('"'):
            if len(x) < 2 or not x.endswith('"') or '"' in x[1:-1].replace('""', ""):
                return "quoting"
            f[i] = x[1:-1].replace('""', '"')
    num = lambda s, top: bool(re.fullmatch("[0-9]+", s)) and int(s) <= top
    signed = lambda s, lo, hi: bool(re.fullmatch("[+-]?[0-9]+", s)) and lo <= int(s) <= hi
    flt = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
    q, flag, rname, pos, mapq, cig, rnext, pnext, tlen, seq, qual = f[:11]
    if not re.fullmatch("[!-?A-~]{1,254}", q):
        return "qname"
    if not (num(flag, 65535) or re.fullmatch("0x[0-9A-Fa-f]{1,4}", flag)):
        return "flag"
    if not rname:
        return "rname"
    if not num(pos, 2**31 - 1):
        return "pos"
    if not num(mapq, 255):
        return "mapq"
    if cig != "*":
        if not re.fullmatch("(?:[0-9]{1,13}[MIDNSHP=XB])+", cig):
            return "cigar"
        if seq != "*":
            ops = [(int(n), o) for n, o in re.findall("([0-9]+)(.)", cig)]
            p, left, ok = 0, len(seq), True
            for i, (n, o) in enumerate(ops):
                inner = 0 < i < len(ops) - 1
                ok &= not (o == "H" and inner) and not (o == "S" and inner and ops[i - 1][1] != "H" and ops[i + 1][1] != "H")
                ok &= not (p < 0 and o in "MIS=X")
                left -= n * (o in "MIS=X")
                p += n * ((o in "MDN=X") - (o == "B"))
            if not ok or left:
                return "cigar"
    if not rnext:
        return "rnext"
    if not num(pnext, 2**31 - 1):
        return "pnext"
    if not signed(tlen, -(2**31) + 1, 2**31 - 1):
        return "tlen"
    if not re.fullmatch(r"\*|[A-Za-z=.]+", seq):
        return "seq"
    if qual != "*" and not (seq != "*" and re.fullmatch("[!-~]+", qual) and len(qual) == len(seq)):
        return "qual"
    for a in f[11:]:
        m = re.fullmatch("([A-Za-z][A-Za-z0-9]):([AifZHB]):(.*)", a, re.S)
        if not m:
            return "aux"
        t, v = m[2], m[3]
        ok = {
            "A": lambda: re.fullmatch("[!-~]", v), "i": lambda: signed(v, -(2**31), 2**32 - 1), "f": lambda: re.fullmatch(flt, v), "Z": lambda: re.fullmatch("[ -~]*", v),
            "H": lambda: re.fullmatch("(?:[0-9A-Fa-f]{2})*", v),
            "B": lambda: v[:1] in set("cCsSiIf") and v[1:2] == "," and all((re.fullmatch(flt, x) if v[0] == "f" else signed(x, *rejects.INT_RANGES[v[0]])) for x in v[2:].split(",")),
        }[t]()
        if not ok:
            return "aux"
    return None


BASE = ["r1", "99", "chr1", "7", "30", "4M", "=", "37", "39", "ACGT", "IIII", "NM:i:1"]


def mutated():
    for i, values in {
        0: ["", "a@b", "n" * 254, "n" * 255, "é", '"q""x"', '"', '""', '"a"b'], 1: ["65535", "65536", "0x1f", "0xfffff", "0X1", "-1", "00099", "9" * 30], 2: ["", "*"], 3: ["2147483647", "2147483648", "1e5", "+1", " 1", "٣"],
        4: ["255", "256", ""], 5: ["*", "3M", "4Q", "M", "2H4M", "2M2H2M", "1S3M", "1M1S2M", "5B4M", "00000000000004M", "0000000000004M", "1H1S3M", "4M\n"], 6: [""], 8: ["-2147483647", "-2147483648", "+5", "--5", ""],
        9: ["*", "AC=T", "AC.T", "AC-T", ""], 10: ["*", "III", "II I", '"III', "II\"I", ""],
        11: ["XA:A:x", "XA:A:xy", "XI:i:4294967295", "XI:i:4294967296", "XI:i:-2147483649", "XF:f:1.5e-3", "XF:f:.5", "XF:f:nan", "XZ:Z:", "XZ:Z:a b", "XZ:Z:é", "XH:H:1A", "XH:H:1A3", "XB:B:c,-128,127", "XB:B:C,256", "XB:B:S", "XB:B:f,1,2.5", "XB:B:i,,1", "X:Z:a", "1X:Z:a", "XQ:Q:1", "", '"CO:Z:a ""b"""', '"CO:Z:a'],
    }.items():
        for v in values:
            yield "\t".join([*BASE[:i], v, *BASE[i + 1 :]])
    yield from ("", None, "a\tb", "\t".join(BASE) + "\r", "\t".join(BASE) + "\r\r", "\t".join(BASE[:11]), "\t".join([*BASE, "ZZ:Z:" + "x" * 200_000]), "\t".join([*BASE[:5], "1M" * 20_000, *BASE[6:9], "A" * 20_000, "*"]), "\t".join([*BASE, "ZZ:H:" + "ab" * 50_000]))


def test_rejects_brute_cases(spark):
    lines = list(mutated())
    df = spark.createDataFrame(list(enumerate(lines)), "line_id LONG, line STRING")
    got = dict(rejects.reject_lines(df).collect())
    assert {i: r for i, x in enumerate(lines) if (r := brute_reason(x))} == got


def test_rejects_brute_table(spark):
    lines = spark.read.parquet("/root/testdata/sf0.01/sam_lines.parquet").select("line_id", "line")
    assert {r[0]: x for r in lines.collect() if (x := brute_reason(r[1]))} == dict(general.p2_found(spark, "/root/testdata/sf0.01").collect())


def test_load_records_keeps_every_line(spark):
    lines = ["\t".join(BASE), "bad", "\t".join([*BASE[:1], "0x63", *BASE[2:]]), None, "\t".join(BASE)]
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(lines)], "line_id LONG, line STRING, reason STRING")
    good, bad = rejects.load_records(df)
    got = good.orderBy("line_id").collect()
    assert [(r["line_id"], r["flag"], r["pos"], r["mate_rname"], r["mate_pos"], r["qual"]) for r in got] == [(i, 99, 6, "chr1", 36, [40] * 4) for i in (0, 2, 4)]
    assert rows(bad.select("line_id", "reason")) == [(1, "fields"), (3, "fields")]


def test_rejects_empty(spark):
    assert rejects.reject_lines(spark.createDataFrame([], "line_id LONG, line STRING")).count() == 0


# --- 3 instants
CASES = [
    ("2017-05-10", "Tollenwerk", "2017-05-09T22:00:00.000000Z"), ("2017-05-10T21:02:29Z", None, "2017-05-10T21:02:29.000000Z"), ("2017-05-10T21:02:29+0900", "site", "2017-05-10T12:02:29.000000Z"),
    ("2010-10-19T00:00:00.000+00:00", None, "2010-10-19T00:00:00.000000Z"), ("  2016-11-06 01:30:00  ", "York", "2016-11-06T05:30:00.000000Z"), ("2016-03-13 02:30:00", "York", "2016-03-13T07:30:00.000000Z"),
    ("03/04/2020 10:00", "York", "2020-03-04T15:00:00.000000Z"), ("03/04/2020 10:00", "Tollenwerk", "2020-04-03T08:00:00.000000Z"), ("03/04/2020 10:00", "Tokyo", None), ("2020/03/04 10:00", "Tokyo", "2020-03-04T01:00:00.000000Z"),
    ("12:30", "York", None), ("12/31/2020 12:05 AM", "York", "2020-12-31T05:05:00.000000Z"), ("12/31/2020 12:05 PM", "York", "2020-12-31T17:05:00.000000Z"), ("12/31/2020 13:05 PM", "York", None),
    ("20200229", "Tokyo", "2020-02-28T15:00:00.000000Z"), ("20190229", "Tokyo", None), ("1262704026", None, "2010-01-05T15:07:06.000000Z"), ("1270736775632", None, "2010-04-08T14:26:15.632000Z"),
    ("1265777280106050", "x", "2010-02-10T04:48:00.106050Z"), ("2015", "York", None), ("2017-06", "York", None), ("2020-05-04T10:00:00+27:00", "York", None), ("2020-05-04 10:00:00 PST", None, "2020-05-04T18:00:00.000000Z"),
    ("2020-05-04 10:00:00 America/New_York", "Tokyo", "2020-05-04T14:00:00.000000Z"), ("2020-05-04T10:00:00-07:00[America/New_York]", "Tokyo", "2020-05-04T17:00:00.000000Z"), ("2020-05-04 10:00:00 Mars/Olympus", "Tokyo", None),
    ("Wed, 22 Sep 2021 03:51:01 +0100", None, "2021-09-22T02:51:01.000000Z"), ("01-Jan-2012 17:45:46", "Tokyo", "2012-01-01T08:45:46.000000Z"), ("2010-05-05t18:12:15.053051670z", None, "2010-05-05T18:12:15.053051Z"),
    ("2010-02-02T23:38:30,24+00", None, "2010-02-02T23:38:30.240000Z"), ("2019-07-03T25:10:00Z", None, None), ("2019-07-03T24:00:00Z", None, None), ("", "York", None), (None, "York", None), ("??-Mar-2016", "York", None),
    ("2020-05-04T10:00", None, None), ("2020-05-04T10:00", "nowhere", None), ("1969-12-31T23:59:59.5Z", None, "1969-12-31T23:59:59.500000Z"), ("x" * 100_000, "York", None),
]
HOMES = [("Tollenwerk", "Europe/Berlin", "dmy"), ("York", "America/New_York", "mdy"), ("Tokyo", "Asia/Tokyo", "ymd"), ("Tokyo", "Asia/Tokyo", "ymd"), (None, "UTC", "ymd")]


def test_instants(spark):
    df = spark.createDataFrame([(i, t, c, "clash") for i, (t, c, _) in enumerate(CASES)], "row_id LONG, date STRING, center STRING, micros STRING")
    homes = spark.createDataFrame(HOMES, "center STRING, zone STRING, day_order STRING")
    out = instants.normalise_instants(df, "date", homes, "center", ["row_id"])
    got = {r[0]: r[1] for r in out.select("row_id", instants.utc_text(F.col("micros"))).collect()}
    assert [(t, c, got[i]) for i, (t, c, _) in enumerate(CASES)] == CASES and len(got) == len(CASES)
    status = {r["row_id"]: r["status"] for r in out.collect()}
    assert status[4] == "ambiguous" and status[5] == "nonexistent" and status[0] == "unique" and status[1] == "stated" and status[8] == "none"


def test_instants_against_zone_library(spark):
    rnd = random.Random(3)
    zones = ["Australia/Sydney", "America/New_York", "Europe/London", "Pacific/Auckland", "Asia/Kathmandu", "Africa/Casablanca"]
    homes = spark.createDataFrame([(z, z, "ymd") for z in zones], "center STRING, zone STRING, day_order STRING")
    texts = []
    for z in zones:
        edges = [u for u, *_ in instants.zone_intervals(z) if 0 < u < 2_000_000_000]
        for _ in range(60):
            u = rnd.choice(edges) + rnd.randrange(-90_000, 90_000) if edges and rnd.random() < 0.8 else rnd.randrange(0, 2_000_000_000)
            texts.append((z, dt.datetime(1970, 1, 1) + dt.timedelta(seconds=u)))
    df = spark.createDataFrame([(i, t.strftime("%Y-%m-%dT%H:%M:%S"), z) for i, (z, t) in enumerate(texts)], "row_id LONG, date STRING, center STRING")
    got = {r["row_id"]: r["micros"] for r in instants.normalise_instants(df, "date", homes, "center", ["row_id"]).collect()}
    for i, (z, t) in enumerate(texts):
        want = t.replace(tzinfo=zoneinfo.ZoneInfo(z), fold=0).timestamp()  # fold 0: the earlier instant, and the offset before a gap
        assert got[i] == int(want) * 1_000_000, (z, t)


def test_zone_intervals_against_zone_library():
    """Every zone, a second before, at and after every change that its file lists or its rule makes."""
    epoch = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
    for z in sorted(zoneinfo.available_timezones()):
        spans, library = instants.zone_intervals(z), zoneinfo.ZoneInfo(z)
        starts = [s[0] for s in spans]
        listed = [u for u, _ in instants.read_zone(instants._zone_data(z))[1] if u > -62_000_000_000]
        assert not listed or listed[-1] < (dt.date(instants.RULE_YEAR, 1, 1) - dt.date(1970, 1, 1)).days * 86400
        for u in {u + i for u in listed + starts[1:] for i in (-1, 0, 1)}:
            want = (epoch + dt.timedelta(seconds=u)).astimezone(library).utcoffset().total_seconds()
            assert spans[bisect.bisect_right(starts, u) - 1][2] == want, (z, u)


def test_instants_of_any_year(spark):
    texts = [("2200-07-01 12:00", "America/New_York"), ("2000-10-11 12:00", "America/Boa_Vista"), ("2040-10-24 12:00", "Asia/Gaza"), ("0001-01-01 00:00", "Asia/Tokyo"), ("1500-01-01", "America/New_York")]
    for z in ("America/New_York", "Europe/Dublin", "Asia/Gaza", "Africa/Casablanca", "Australia/Lord_Howe", "Antarctica/Troll", "America/Recife", "Africa/Freetown", "Asia/Manila"):
        zone = zoneinfo.ZoneInfo(z)
        for y in (1845, 1900, 1939, 2054, 2072, 2099, 2100, 2151, 2499, 2500, 2501, 9998):
            for month in (1, 3, 4, 7, 10, 12):
                texts += [(f"{y}-{month:02}-{d:02} {h}", z) for d, h in ((1, "00:00"), (31 if month != 4 else 30, "02:30"))]
        for u in [u for u, *_ in instants.zone_intervals(z)[1:]][-60::7]:
            at = (dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=u)).astimezone(zone).replace(tzinfo=None)
            texts += [((at + dt.timedelta(minutes=m, days=y * 146_097)).isoformat(), z) for m in (-90, -30, -1, 0, 30, 90) for y in (0, 1, 5)]
    zones = sorted({z for _, z in texts})
    homes = spark.createDataFrame([(z, z, "ymd") for z in zones], "center STRING, zone STRING, day_order STRING")
    df = spark.createDataFrame([(i, t, z) for i, (t, z) in enumerate(texts)], "row_id LONG, date STRING, center STRING")
    got = {r["row_id"]: r["micros"] for r in instants.normalise_instants(df, "date", homes, "center", ["row_id"]).collect()}
    for i, (t, z) in enumerate(texts):
        local = dt.datetime.fromisoformat(t)
        want = int((local.replace(tzinfo=zoneinfo.ZoneInfo(z), fold=0) - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)).total_seconds())
        assert got[i] == want * 1_000_000, (z, t)
    assert [instants_text(got[i]) for i in range(3)] == ["2200-07-01T16:00", "2000-10-11T15:00", "2040-10-24T09:00"]


def instants_text(us):
    return (dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=us)).isoformat()[:16]


def brute_instant(text, home):
    """The statement of TESTDATA.md with strptime. home: (zone, day order) or None."""
    t = (text or "").strip()
    if re.fullmatch("[0-9]{9,}", t):
        n = int(t)
        us = n * 10**6 if len(t) <= 11 else n * 1000 if len(t) <= 14 else n
        return dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=us)
    off = zone = None
    if m := re.fullmatch(r"(.*?) ?\[?([A-Za-z]+(?:/[A-Za-z_]+)+)\]?", t):
        t, zone = m[1], m[2]
    elif m := re.fullmatch(r"(.*\d) ?([A-Z]{3,4}|[Zz])", t):
        if m[2].upper() not in ("AM", "PM"):
            t, off = m[1], instants.ABBREVIATIONS.get(m[2].upper(), "bad")
    if m := re.fullmatch(r"(.*\d\d(?::?\d\d)+(?:[.,]\d+)?) ?([+-])(\d\d):?(\d\d)?", t):
        if ":" in m[1] or "T" in m[1]:
            minutes = int(m[3]) * 60 + int(m[4] or 0)
            t, off = m[1], "bad" if minutes > 840 or int(m[4] or 0) > 59 else minutes * (-1 if m[2] == "-" else 1)
    if off == "bad":
        return None
    micro = 0
    if m := re.fullmatch(r"(.*:\d\d)[.,](\d+)", t):
        t, micro = m[1], int((m[2] + "000000")[:6])
    order = {"mdy": "%m{0}%d{0}%Y", "dmy": "%d{0}%m{0}%Y"}.get(home[1] if home else None)
    forms = [d + c for d in ("%Y-%m-%d", "%Y%m%d", "%Y/%m/%d") for c in ("", "T%H:%M", "T%H:%M:%S", " %H:%M:%S", " %H:%M", "T%H%M%S", "t%H:%M:%S")] + ["%d-%b-%Y %H:%M:%S", "%a, %d %b %Y %H:%M:%S"]
    forms += [order.format(x) + c for x in "/." for c in (" %H:%M", " %I:%M %p")] if order else []
    for f in forms:
        try:
            wall = dt.datetime.strptime(t, f)
        except ValueError:
            continue
        if f.startswith("%Y%m%d") and len(re.match("[0-9]+", t)[0]) != 8:
            continue
        wall += dt.timedelta(microseconds=micro)
        if off is not None:
            return wall - dt.timedelta(minutes=off)
        name = zone or (home[0] if home else None)
        if name is None or name not in zoneinfo.available_timezones():
            return None
        return (wall.replace(tzinfo=zoneinfo.ZoneInfo(name), fold=0)).astimezone(dt.timezone.utc).replace(tzinfo=None)
    return None


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_instants_brute_table(spark, scale):
    d = f"/root/testdata/{scale}"
    homes = {r["center"]: (r["zone"], r["day_order"]) for r in spark.read.parquet(f"{d}/centers.parquet").collect()}
    want = {r["row_id"]: v.strftime("%Y-%m-%dT%H:%M:%S.%fZ") for r in spark.read.parquet(f"{d}/read_groups.parquet").collect() if (v := brute_instant(r["date"], homes.get(r["center"])))}
    assert dict(general.p3_found(spark, d).collect()) == want


def test_instants_empty(spark):
    df = spark.createDataFrame([], "row_id LONG, date STRING, center STRING")
    assert instants.normalise_instants(df, "date", spark.createDataFrame([], "center STRING, zone STRING, day_order STRING"), "center", ["row_id"]).count() == 0


# --- 4 orphans
def test_orphans(spark):
    t = lambda d, h=0: dt.datetime(2024, 5, d, h)
    parents = [("p", "1", "a", t(2), t(10)), ("p", "1", "a", t(12), None), ("p", "1", "b", t(20), None), ("p", "1", "n", None, None), ("p", None, "z", t(1), None), ("p", "1", None, t(1), None)] + [("p", "1", "a", t(2), t(10))] * 3
    refs = [
        ("x", 1, "f", "p", "1", "a", t(1)), ("x", 2, "f", "p", "1", "a", t(2)), ("x", 3, "f", "p", "1", "a", t(10)), ("x", 4, "f", "p", "1", "a", t(11)), ("x", 5, "f", "p", "1", "a", t(12)), ("x", 6, "f", "p", "1", "b", t(19)),
        ("x", 7, "f", "p", "1", "c", t(5)), ("x", 8, "f", "p", "2", "a", t(5)), ("x", 9, "f", "p", "1", None, t(5)), ("x", 10, "f", "p", "1", "a", None), ("x", 11, "f", "p", "1", "n", t(5)), ("x", 12, "f", "p", None, "z", t(5)),
        ("x", 13, "f", "p", "1", "c", None), ("x", 14, "f", "p", "1", "A", t(5)),
    ]
    r = spark.createDataFrame(refs, "tbl STRING, row_id LONG, field STRING, target STRING, scope STRING, key STRING, t TIMESTAMP")
    p = spark.createDataFrame(parents, "target STRING, scope STRING, key STRING, loaded_at TIMESTAMP, removed_at TIMESTAMP")
    got = {x["row_id"]: (x["status"], x["period"]) for x in orphans.find_orphans(r, p).collect()}
    m = "2024-05"
    assert got == {1: ("late", m), 3: ("deleted", m), 4: ("deleted", m), 6: ("late", m), 7: ("missing", m), 8: ("missing", m), 10: ("deleted", None), 11: ("deleted", m), 12: ("missing", m), 13: ("missing", None), 14: ("missing", m)}
    assert orphans.find_orphans(r.limit(0), p).count() == 0
    assert orphans.find_orphans(r, p.limit(0)).count() == 13


@pytest.mark.parametrize("few", [0, 100_000])
def test_orphans_beyond_broadcast(spark, monkeypatch, few):
    """The bitmap of open pairs and the spread of hot ones give what the broadcast gives."""
    monkeypatch.setattr(orphans, "PAIR_ROWS", 50)
    monkeypatch.setattr(orphans, "FILTER_WORDS", 4)
    r = spark.range(6000).select(F.lit("x").alias("tbl"), F.col("id").alias("row_id"), F.lit("f").alias("field"), F.lit("p").alias("target"), F.lit("").alias("scope"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 400).cast("string")).alias("key"), F.timestamp_seconds(F.col("id") * 3600).alias("t"))
    p = spark.range(300).select(F.lit("p").alias("target"), F.lit("").alias("scope"), F.col("id").cast("string").alias("key"), F.timestamp_seconds(F.col("id") * 20_000).alias("loaded_at"), F.timestamp_seconds(F.col("id") * 50_000 + 900_000).alias("removed_at"))
    got = orphans.find_orphans(r, p, few)
    joined = r.join(p, ["target", "scope", "key"], "left").groupBy("row_id").agg(F.count("loaded_at").alias("n"), F.min(F.col("loaded_at") > F.col("t")).alias("late"), F.max((F.col("loaded_at") <= F.col("t")) & (F.col("removed_at") > F.col("t"))).alias("live"))
    want = joined.where("NOT coalesce(live, false)").select("row_id", F.when(F.col("n") == 0, "missing").when(F.col("late"), "late").otherwise("deleted").alias("status"))
    assert sorted(tuple(x) for x in got.select("row_id", "status").collect()) == sorted(tuple(x) for x in want.collect())


def test_orphans_hot_key(spark):
    r = spark.range(4000).select(F.lit("x").alias("tbl"), F.col("id").alias("row_id"), F.lit("f").alias("field"), F.lit("p").alias("target"), F.lit("").alias("scope"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("key"), F.timestamp_seconds(F.col("id") * 3600).alias("t"))
    p = spark.createDataFrame([("p", "", "hot", dt.datetime(1970, 2, 1), None)], "target STRING, scope STRING, key STRING, loaded_at TIMESTAMP, removed_at TIMESTAMP")
    got = orphans.find_orphans(r, p)
    assert got.where("status = 'late'").count() == 31 * 24 // 3 and got.where("status = 'missing'").count() == 4000 - 1334


# --- 5 skew
def test_skew(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, F.lit(7)).otherwise(F.col("id").cast("int")).alias("k"), F.col("id").alias("v"))
    a, b = (x.select("k", "n", "s") for x in (skew.aggregate_per_key(df, ["k"], F.count("*").alias("n"), F.sum("v").alias("s")), df.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("s"))))
    assert {tuple(r) for r in a.collect()} == {tuple(r) for r in b.collect()} and a.count() == b.count()
    right = spark.createDataFrame([(7, "x"), (7, "y"), (8, "z"), (None, "n")], "k INT, w STRING")
    for how in ("left", "inner"):
        x, y = skew.skew_join(df, right, ["k"], how), df.join(right, ["k"], how)
        assert x.exceptAll(y.select(*x.columns)).count() == 0 == y.select(*x.columns).exceptAll(x).count()
    limit, skew.BROADCAST_ROWS = skew.BROADCAST_ROWS, 1
    try:
        x, y = skew.skew_join(df, right, ["k"]), df.join(right, ["k"], "left")
        assert x.exceptAll(y.select(*x.columns)).count() == 0 and x.count() == y.count()
    finally:
        skew.BROADCAST_ROWS = limit
    assert skew.aggregate_per_key(df.limit(0), ["k"], F.count("*").alias("n")).count() == 0
    with pytest.raises(ValueError, match="no partial form"):
        skew.aggregate_per_key(df, ["k"], F.collect_list("v").alias("x"))
    lists = skew.aggregate_per_key(df, ["k"], F.collect_list("v").alias("x"), merge=[F.flatten(F.collect_list("x")).alias("x")])
    assert {r["k"]: sorted(r["x"]) for r in lists.collect()} == {r["k"]: sorted(r["x"]) for r in df.groupBy("k").agg(F.collect_list("v").alias("x")).collect()}


def test_dominant_keys(spark):
    c = spark.createDataFrame([(1, 1, 30), (1, 2, 70), (2, 1, 29), (2, 2, 71), (3, 1, 0), (3, 2, 0), (4, None, 90), (4, 1, 10), (None, 1, 5)], "o INT, k INT, w LONG")
    assert {tuple(r) for r in skew.dominant_keys(c, "o", "k", "w", 30).collect()} == {(1, 1), (1, 2), (2, 2), (None, 1)}


# --- 6 percentiles
def brute_percentile(values, q):
    import math

    v = sorted(values)
    return v[max(1, math.ceil(round(q * len(v), 6))) - 1]


@pytest.mark.parametrize("finish", [8, 2048])
def test_exact_percentiles(spark, finish):
    rnd = random.Random(finish)
    data = [(g, rnd.choice([0, 1, 5, rnd.randrange(-(10**12), 10**12), rnd.randrange(300)])) for g in ("a", "b", None, "hot", "hot", "hot") for _ in range(100)] + [("one", 5), ("low", -(2**63)), ("low", 2**63 - 1), ("nul", None)]
    df = spark.createDataFrame([(g, v, 1) for g, v in data], "g STRING, v LONG, value INT")
    qs = [0.0, 0.25, 0.5, 0.99, 1.0]
    got = {(r["g"], r["q"]): (r["value"], r["n"]) for r in percentiles.exact_percentiles(percentiles.combine_values(df.select("g", "v"), ["g"], "v"), ["g"], qs, finish).collect()}
    by = defaultdict(list)
    for g, v in data:
        if v is not None:
            by[g].append(v)
    assert got == {(g, q): (brute_percentile(v, q), len(v)) for g, v in by.items() for q in qs}


@pytest.mark.parametrize("kind", ["double", "decimal(12,3)", "float", "int"])
def test_percentiles_keep_the_type(spark, kind):
    rnd = random.Random(8)
    data = [(g, rnd.choice([0.25, 0.75, 0.9, -1.5, 1e6, 3.125, 2.0 * rnd.randrange(40) + 0.125])) for g in ["a"] * 300 + [None] * 40 + ["b"] for _ in (0,)]
    df = spark.createDataFrame([(g, v) for g, v in data] + [("a", None)], "g STRING, x DOUBLE").select("g", F.col("x").cast(kind).alias("x"))
    summary = percentiles.combine_values(df, ["g"], "x")
    quantiles = [0.0, 0.1, 0.5, 0.99, 1.0]
    for targets in (percentiles.BROADCAST_TARGETS, 1):
        before, percentiles.BROADCAST_TARGETS = percentiles.BROADCAST_TARGETS, targets
        try:
            got = {(r["g"], r["q"]): (r["value"], r["n"]) for r in percentiles.exact_percentiles(summary, ["g"], quantiles, finish=2).collect()}
        finally:
            percentiles.BROADCAST_TARGETS = before
        for g in ("a", None, "b"):
            mine = sorted(r["x"] for r in df.where(F.col("g").eqNullSafe(g) & F.col("x").isNotNull()).collect())
            for q in quantiles:
                assert got[(g, q)] == (mine[max(1, math.ceil(round(q * len(mine), 6))) - 1], len(mine)), (g, q)


def test_percentiles_of_fractions(spark):
    df = spark.createDataFrame([(v, 1) for v in (0.25, 0.75, 0.9, float("nan"), float("inf"))], "value DOUBLE, cnt LONG")
    got = percentiles.exact_percentiles(df.withColumn("g", F.lit(1)), ["g"], [0.5, 0.2, 0.8]).collect()
    assert {r["q"]: r["value"] for r in got} == {0.5: 0.9, 0.2: 0.25, 0.8: float("inf")}


def test_summaries_combine(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("day"), F.lit("g").alias("g"), (F.col("id") * F.col("id") - 1000).alias("v"))
    parts = percentiles.log_summary(df, ["day", "g"], "v")
    got = {r["q"]: r["value"] for r in percentiles.summary_percentiles(parts, ["g"], [0.1, 0.5, 0.99]).collect()}
    for q, v in got.items():
        want = brute_percentile([i * i - 1000 for i in range(3000)], q)
        assert abs(v - want) <= percentiles.RELATIVE_ERROR * abs(want) * 1.0001
    assert percentiles.exact_percentiles(percentiles.combine_values(df.limit(0), ["g"], "v"), ["g"], [0.5]).count() == 0
