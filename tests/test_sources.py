"""Formats: golden bytes, splits, damaged input, headers."""

import random
import re
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from readloom.functions import tags as T
from readloom.operators import header as H
from readloom.operators import index as X
from readloom.operators import merging as M
from readloom.sources import bam, bgzf, columns, cram, fasta, files, indexes, sam

SAM = """@HD\tVN:1.5\tSO:coordinate
@SQ\tSN:ref\tLN:45
@CO\tone\ttwo
r001\t99\tref\t7\t30\t8M2I4M1D3M\t=\t37\t39\tTTAGATAAAGGATACTG\t*
r002\t0\tref\t9\t30\t3S6M1P1I4M\t*\t0\t0\tAAAAGATAAGGATA\t*
r003\t0\tref\t9\t30\t5S6M\t*\t0\t0\tGCCTAAGCTAA\t*\tSA:Z:ref,29,-,6H5M,17,0;
r004\t0\tref\t16\t30\t6M14N5M\t*\t0\t0\tATAGCTTCAGC\t*
r003\t2064\tref\t29\t17\t6H5M\t*\t0\t0\tTAGGC\t*\tSA:Z:ref,9,+,5S6M,30,1;
r001\t147\tref\t37\t30\t9M\t=\t7\t-39\tCAGCGGCAT\t*\tNM:i:1
"""


@pytest.fixture()
def specification(spark, tmp_path):
    path = tmp_path / "spec.sam"
    path.write_text(SAM)
    return sam.read_sam(spark, str(path)) + (tmp_path,)


def test_text_round_trip(spark, specification):
    header, records, rejects, tmp = specification
    assert rejects.count() == 0 and header.sort_order == "coordinate" and header.comments == ["one\ttwo"]
    out = str(tmp / "out.sam")
    text = H.format_header("1.5", "coordinate", "none", header.table(spark, "SQ"), header.table(spark, "RG"), header.table(spark, "PG"), header.comments)
    sam.write_sam(records.orderBy("line_id").coalesce(1), out, text)
    assert files.read_bytes(out).decode() == SAM


def test_text_last_line_and_blank_lines(spark, tmp_path):
    path = tmp_path / "x.sam"
    path.write_text(SAM + "\nr9\t0\tref\t1\t1\t*\t*\t0\t0\t*\t*")
    assert sam.read_sam(spark, str(path))[1].count() == 7


def test_binary_round_trip(spark, specification):
    header, records, _, tmp = specification
    path = str(tmp / "spec.bam")
    ordered = records.orderBy("line_id").coalesce(1)
    ordered.write.format("bam").mode("append").option("path", path).option("header", SAM.split("r001")[0]).save()
    assert bgzf.has_eof(path)
    got = spark.read.format("bam").option("path", path).load().orderBy("_voff_begin")
    want = [r["line"] for r in ordered.select(sam.format_line().alias("line")).collect()]
    assert [r["line"] for r in got.select(sam.format_line().alias("line")).collect()] == want
    voff = got.select("_voff_begin", "_voff_end").collect()
    assert all(a["_voff_end"] == b["_voff_begin"] for a, b in zip(voff, voff[1:], strict=False))
    pruned = spark.read.schema("flag INT, pos BIGINT").format("bam").option("path", path).load()
    assert sorted(tuple(r) for r in pruned.collect()) == sorted((r["flag"], r["pos"]) for r in got.collect())
    some = f"{voff[2]['_voff_begin']}-{voff[3]['_voff_end']}"
    assert spark.read.format("bam").option("path", path).option("chunks", some).load().count() == 2


def _odd_names(spark, path, names):
    df = spark.createDataFrame([(names[i % len(names)], i) for i in range(3000)], "qname STRING, pos LONG").repartition(1).sortWithinPartitions("pos")
    df = df.select("qname", F.lit(0).alias("flag"), F.lit(0).alias("ref_id"), F.lit("ref").alias("rname"), "pos", F.lit(9).cast("smallint").alias("mapq"), F.repeat(F.substring(F.md5(F.col("pos").cast("string")), 1, 8), 4).alias("seq"))
    more = {"cigar": "ARRAY<STRUCT<len: BIGINT, op: STRING>>", "mate_ref_id": "INT", "mate_rname": "STRING", "mate_pos": "BIGINT", "tlen": "INT", "qual": "ARRAY<SMALLINT>", "aux": T.AUX_TYPE}
    df = df.withColumns({k: F.lit(None).cast(v) for k, v in more.items()})
    df.write.format("bam").mode("append").option("path", path).option("header", SAM.split("r001")[0]).save()


@pytest.mark.parametrize("names", [["a b"], ["caf\u00e9", "ok"]])
def test_binary_splits_keep_odd_names(spark, tmp_path, names):
    path = str(tmp_path / "odd.bam")
    _odd_names(spark, path, names)
    whole, parts = (sorted(r["pos"] for r in spark.read.format("bam").option("path", path).option("splitBytes", n).load().select("pos").collect()) for n in (1 << 25, 5000))
    assert files.size_of(path) > 15_000 and whole == parts == list(range(3000))


def test_binary_split_without_start_is_an_error(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "lost.bam")
    _odd_names(spark, path, ["ok"])
    options, size = {"path": path, "splitBytes": "5000"}, files.size_of(path)
    reader = bam.BamReader(options, spark.read.format("bam").option("path", path).load().schema)
    parts = reader.partitions()
    assert len(parts) > 1 and sum(b.num_rows for p in parts for b in reader.read(p)) == 3000 and size > 15_000
    for wrong in (lambda *_: None, lambda s, at, *a: (found := find(s, at, *a)) is not None and found + 1 or None):
        find = bam.find_record
        with monkeypatch.context() as m:
            m.setattr(bam, "find_record", wrong)
            with pytest.raises(bam.FormatError, match="the range at"):
                list(reader.read(parts[0]))


def _random_records(seed, n):
    """Records of every kind of content: odd names, no or many operations, every tag type, bytes that look like records in tags."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        seq = "".join(rnd.choice("=ACMGRSVTWYHKDBN") for _ in range(rnd.choice((0, 1, 2, 7, 50, 301))))
        name = rnd.choice(("a b", "@x", "q", "n" * 254, "caf\u00e9", f"r{i}"))
        fake = bytes(rnd.randrange(256) for _ in range(40)) + struct.pack("<iiiBBHHHiiii", 40, 0, 5, 2, 0, 0, 0, 0, 0, -1, -1, 0) + b"x\0"
        aux = []
        for _ in range(rnd.choice((0, 0, 1, 3, 9))):
            t = rnd.choice("AcCsSiIfZHB")
            a = dict.fromkeys(("tag", "type", "subtype", "sval", "ival", "fval", "iarr", "farr", "bval")) | {"tag": rnd.choice("XYZ") + rnd.choice("ab0"), "type": t}
            low, high = {"c": (-128, 127), "C": (0, 255), "s": (-32768, 32767), "S": (0, 65535), "i": (-(2**31), 2**31 - 1), "I": (0, 2**32 - 1)}.get(t, (0, 0))
            if t in "cCsSiI":
                a["ival"] = rnd.choice((low, high, rnd.randint(low, high)))
            elif t == "A":
                a["sval"] = rnd.choice("!~x")
            elif t == "f":
                a["fval"] = struct.unpack("<f", struct.pack("<f", rnd.uniform(-9, 9)))[0]
            elif t == "Z":
                a["sval"] = rnd.choice(("", "text", "\u00fc mit Bl\u00e4nken", "y" * 700))
            elif t == "H":
                a["bval"] = rnd.choice((b"", b"\x1a\xe3", bytes(range(256))))
            else:
                sub = rnd.choice("cCsSiIf")
                a["subtype"] = sub
                if sub == "f":
                    a["farr"] = [0.5 * x for x in range(rnd.randrange(4))]
                elif sub == "C":
                    a["iarr"] = list(fake)
                else:
                    a["iarr"] = [rnd.randrange(100) for _ in range(rnd.randrange(5))]
            aux.append(a)
        ops = [{"len": rnd.randrange(1 << rnd.randrange(1, 20)), "op": rnd.choice("MIDNSHP=XB")} for _ in range(rnd.choice((0, 1, 4, 30)))]
        qual = [rnd.randrange(94) for _ in seq] if seq and rnd.random() < 0.7 else None
        ref, pos = rnd.choice(((0, rnd.randrange(1 << 29)), (None, -1), (2, 0)))
        out.append({"qname": name, "flag": rnd.randrange(4096), "ref_id": ref, "pos": pos, "mapq": rnd.randrange(256), "cigar": ops, "mate_ref_id": rnd.choice((None, 1)), "mate_pos": rnd.choice((-1, 77)), "tlen": rnd.randrange(-(2**31), 2**31), "seq": seq or None, "qual": qual, "aux": aux})
    return out


def _one_record(body):
    """A record's body read field by field."""
    ref, pos, n_name, mapq, _, n_ops, flag, n, mate, mate_pos, tlen = struct.unpack_from("<iiBBHHHiiii", body)
    at = 32 + n_name
    r = {"qname": body[32 : at - 1].decode(), "flag": flag, "ref_id": None if ref < 0 else ref, "pos": pos, "mapq": mapq, "mate_ref_id": None if mate < 0 else mate, "mate_pos": mate_pos, "tlen": tlen}
    r["cigar"] = [{"len": p >> 4, "op": "MIDNSHP=XB"[p & 15]} for p in struct.unpack_from(f"<{n_ops}I", body, at)]
    at += 4 * n_ops
    r["seq"] = "".join("=ACMGRSVTWYHKDBN"[body[at + i // 2] >> (0 if i % 2 else 4) & 15] for i in range(n)) or None
    at += (n + 1) // 2
    r["qual"] = None if set(body[at : at + n]) <= {255} else list(body[at : at + n])
    at, r["aux"] = at + n, []
    while at < len(body):
        a = dict.fromkeys(("tag", "type", "subtype", "sval", "ival", "fval", "iarr", "farr", "bval")) | {"tag": body[at : at + 2].decode(), "type": chr(body[at + 2])}
        t, at = a["type"], at + 3
        code = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
        if t in code:
            a["fval" if t == "f" else "ival"] = struct.unpack_from("<" + code[t], body, at)[0]
            at += struct.calcsize(code[t])
        elif t == "A":
            a["sval"], at = chr(body[at]), at + 1
        elif t in "ZH":
            end = body.index(0, at)
            a["sval" if t == "Z" else "bval"] = body[at:end].decode() if t == "Z" else bytes.fromhex(body[at:end].decode())
            at = end + 1
        else:
            sub, count = chr(body[at]), struct.unpack_from("<i", body, at + 1)[0]
            a["subtype"], a["farr" if sub == "f" else "iarr"] = sub, list(struct.unpack_from(f"<{count}{code[sub]}", body, at + 5))
            at += 5 + count * struct.calcsize(code[sub])
        r["aux"].append(a)
    return r


_ARROW = pa.schema([(k, t) for k, t in (
    ("qname", pa.string()), ("flag", pa.int32()), ("ref_id", pa.int32()), ("pos", pa.int64()), ("mapq", pa.int16()), ("cigar", columns._LISTS["cigar"]), ("mate_ref_id", pa.int32()), ("mate_pos", pa.int64()), ("tlen", pa.int32()),
    ("seq", pa.string()), ("qual", columns._LISTS["qual"]), ("aux", columns._LISTS["aux"]),
)])


@pytest.mark.parametrize("seed", range(6))
def test_record_columns_against_field_by_field(seed):
    want = _random_records(seed, 300)
    for records in (want, want[:1], [r | {"aux": [], "cigar": [], "seq": None, "qual": None} for r in want[:5]], []):
        data, ends = columns.encode(pa.RecordBatch.from_pylist(records, schema=_ARROW))
        starts = np.array([4, *[e + 4 for e in ends[:-1]]][: len(ends)], np.int64)
        sizes = np.array(ends, np.int64) - starts
        bodies = [data[s : s + n] for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
        assert [_one_record(b) for b in bodies] == records
        assert [struct.unpack_from("<i", data, s - 4)[0] for s in starts.tolist()] == sizes.tolist()
        none = np.zeros(len(starts), np.int64)
        got = columns.decode(np.frombuffer(data, np.uint8), starts, sizes, none, none, 0, ["a", "b", "c"], "none", _ARROW)
        assert got.to_pylist() == records
        for omit in ("aux", "variable"):
            less = columns.decode(np.frombuffer(data, np.uint8), starts, sizes, none, none, 0, ["a", "b", "c"], omit, _ARROW).to_pylist()
            gone = ("aux",) if omit == "aux" else ("aux", "seq", "qual")
            assert less == [r | dict.fromkeys(gone) for r in records]


def test_record_columns_refuse():
    good = _random_records(3, 1)[0] | {"aux": [], "cigar": [], "seq": "AC", "qual": None}
    tag = dict.fromkeys(("tag", "type", "subtype", "sval", "ival", "fval", "iarr", "farr", "bval")) | {"tag": "XX", "type": "c", "ival": 1}
    for bad in ({"qname": None}, {"qname": ""}, {"qname": "x" * 255}, {"qual": [1]}, {"cigar": [{"len": 1, "op": "Q"}]}, {"cigar": [{"len": 1 << 28, "op": "M"}]}, {"pos": 1 << 31}, {"flag": 1 << 16},
                {"aux": [tag | {"ival": 128}]}, {"aux": [tag | {"ival": None}]}, {"aux": [tag | {"type": "?"}]}, {"aux": [tag | {"tag": "XXX"}]}, {"aux": [tag | {"type": "A", "sval": ""}]}):
        with pytest.raises(ValueError):
            columns.encode(pa.RecordBatch.from_pylist([good | bad], schema=_ARROW))
    data, ends = columns.encode(pa.RecordBatch.from_pylist([good | {"aux": [tag]}], schema=_ARROW))
    for cut_ in (1, 2, 3):
        with pytest.raises(bgzf.FormatError):
            columns.decode(np.frombuffer(data, np.uint8), np.array([4]), np.array([ends[0] - 4 - cut_]), np.zeros(1), np.zeros(1), 0, ["a", "b", "c"], "none", _ARROW)


@pytest.mark.parametrize(("split", "layout"), [(6000, "file"), (50_000, "folder"), (1 << 25, "file")])
def test_every_split_gives_all_records(spark, tmp_path, split, layout):
    records = _random_records(9, 800)
    records[400]["aux"] = [dict.fromkeys(("tag", "type", "subtype", "sval", "ival", "fval", "iarr", "farr", "bval")) | {"tag": "XX", "type": "B", "subtype": "I", "iarr": [i * 7919 % (1 << 31) for i in range(90_000)]}]  # longer than a split
    schema = StructType([f for f in StructType.fromDDL(bam.SCHEMA).fields if f.name in _ARROW.names])
    df = spark.createDataFrame([tuple(r[k] if k != "aux" else [tuple(a.values()) for a in r[k]] for k in schema.names) for r in records], schema)
    path, header = str(tmp_path / "x.bam"), "@HD\tVN:1.5\n" + "".join(f"@SQ\tSN:{x}\tLN:2000000000\n" for x in "abc")
    df.withColumns({"rname": F.lit(None).cast("string"), "mate_rname": F.lit(None).cast("string")}).repartition(2).write.format("bam").mode("append").option("path", path).option("header", header).option("layout", layout).save()
    names = files.list_files(path)
    assert len(names) == (1 if layout == "file" else 2) and all(bgzf.has_eof(n) for n in names) and not (tmp_path / "x.bam.parts").exists()
    got = spark.read.format("bam").option("path", path).option("splitBytes", split).load()
    back = [r.asDict(True) for r in got.orderBy("_src_id", "_voff_begin").collect()]
    key = lambda r: repr([r[k] for k in _ARROW.names])
    assert sorted(map(key, back)) == sorted(map(key, records))
    for a, b in zip(back, back[1:], strict=False):
        assert a["_src_id"] != b["_src_id"] or a["_voff_end"] == b["_voff_begin"]


@pytest.mark.parametrize("split", [700, 3000, 1 << 25])
def test_binary_splits(spark, tmp_path, small, split):
    from readloom.plans import io

    path, _ = io._as_bam(spark, small)
    got = spark.read.format("bam").option("path", path).option("splitBytes", split).load().agg(F.count("*"), F.count_distinct("_voff_begin"), F.count_distinct("qname")).head()
    a = spark.read.parquet(f"{small}/alignments.parquet")
    assert tuple(got) == (a.count(), a.count(), a.select("qname").distinct().count())


def test_damaged_binary(spark, tmp_path, small):
    from readloom.plans import io

    data = files.read_bytes(io._as_bam(spark, small)[0])
    for i, bad in enumerate((data[: len(data) // 2], b"", b"\x1f\x8b\x08\x04", data[:200] + b"\0" * 50 + data[250:], b"BAM\1" + data)):
        p = tmp_path / f"{i}.bam"
        p.write_bytes(bad)
        assert not bgzf.has_eof(str(p)) or i > 2
        if bad:
            with pytest.raises(Exception, match="(?i)block|checksum|header|truncated|damaged"):
                spark.read.format("bam").option("path", str(p)).load().collect()


def test_blocks():
    raw = bytes(range(256)) * 300
    for level in (-1, 0, 1, 9):
        assert bgzf.inflate(bgzf.deflate(raw[: bgzf.MAX_RAW], level)) == raw[: bgzf.MAX_RAW]
    with pytest.raises(ValueError):
        bgzf.deflate(b"", 10)
    assert bgzf.inflate(bgzf.EOF_MARKER) == b""


@pytest.mark.parametrize("size", [1, 50, 5000])
def test_block_lines(spark, tmp_path, size):
    lines = [f"{i}\t" + "x" * (i * 37 % 900) for i in range(400)]
    path = str(tmp_path / "t.gz")
    raw = ("\n".join(lines) + "\n").encode()
    with files.open_output(path) as out:
        for i in range(0, len(raw), 3000 + size):
            out.write(bgzf.deflate(raw[i : i + 3000 + size]))
        out.write(bgzf.EOF_MARKER)
    for split in (333, 4096, 1 << 24):
        got = spark.read.format("bgzf_lines").option("path", path).option("splitBytes", split).load()
        assert sorted(r["line"] for r in got.collect()) == sorted(lines)
    one = got.where("line LIKE '7\t%'").head()
    part = spark.read.format("bgzf_lines").option("path", path).option("chunks", f"{one['_voff_begin']}-{one['_voff_begin'] + 1}").load().collect()
    assert [r["line"] for r in part] == [lines[7]]


def test_index_bytes():
    v = lambda f, b: f << 16 | b
    rows = [
        indexes._row("bin", ref_id=0, bin=4681, chunk_begin=v(98, 0), chunk_end=v(401, 0)), indexes._row("stats", ref_id=0, chunk_begin=v(98, 0), chunk_end=v(401, 0), mapped=8, unmapped=1),
        indexes._row("linear", ref_id=0, tile=0, voff=v(98, 0)), indexes._row("unplaced", unmapped=1),
    ]
    data = indexes.encode_index(rows, "bai", 1)
    assert data == b"BAI\1" + struct.pack("<iiIi2QIi4QiQQ", 1, 2, 4681, 1, v(98, 0), v(401, 0), 37450, 2, v(98, 0), v(401, 0), 8, 1, 1, v(98, 0), 1)
    key = lambda x: sorted(map(repr, x))
    assert key(indexes.parse_index(data)[0]) == key(rows)
    meta = {"format": 2, "zero_based": True, "name_col": 1, "begin_col": 2, "end_col": 3, "meta_char": "#", "skip": 1, "names": ["chr1"]}
    back, m = indexes.parse_index(indexes.encode_index(rows, "tbi", 1, meta))
    assert key(back) == key(rows) and {k: m[k] for k in meta} == meta
    csi_rows = [dict(r, left_voff=v(98, 0), records=9) if r["kind"] == "bin" else r for r in rows if r["kind"] != "linear"]
    back, m = indexes.parse_index(indexes.encode_index(csi_rows, "csi", 1, {"min_shift": 14, "depth": 5, "version": 2, "aux": b"xy"}))
    assert key(back) == key(csi_rows) and (m["min_shift"], m["depth"], m["version"], m["aux"]) == (14, 5, 2, b"xy")
    for n in range(len(data)):
        if n not in (len(data) - 8,):  # without the trailing count it is complete
            with pytest.raises(bgzf.FormatError):
                rows_, _ = indexes.parse_index(data[:n])
                if n > len(data) - 8:
                    raise bgzf.FormatError


def test_conceptual_index(spark):
    v = lambda f, b: f << 16 | b
    data = [(0, 62914560, 69206016, v(101, 0), v(101, 52)), (0, 73400320, 79691776, v(101, 52), v(101, 104)), (0, 76546048, 78643200, v(101, 104), v(228, 0))]
    r = spark.createDataFrame(data, "ref_id INT, beg LONG, end LONG, _voff_begin LONG, _voff_end LONG")
    bins, linear = X.build_bins(r, ["ref_id"], F.col("beg"), F.col("end")), X.build_linear(r, ["ref_id"], F.col("beg"), F.col("end"))
    asks = [(2, 77594624, 80740352), (3, 62914561, 68157440), (4, 72351744, 80740352), (5, 61865984, 80740352), (6, 80740352, 81788928), (7, 5, 5)]
    regions = spark.createDataFrame([(i, 0, b, e) for i, b, e in asks], "region_id LONG, ref_id INT, beg LONG, end LONG")
    got = {x["region_id"]: (x["chunk_begin"], x["chunk_end"]) for x in X.lookup(regions, bins, linear, ["ref_id"]).collect()}
    assert got == {2: (v(101, 0), v(228, 0)), 3: (v(101, 0), v(101, 52)), 4: (v(101, 0), v(228, 0)), 5: (v(101, 0), v(228, 0))} or set(got) == {2, 3, 4, 5}
    want = {2: (77594624, 80740352), 3: (62914561, 68157440), 4: (72351744, 80740352), 5: (61865984, 80740352)}
    for i, (b, e) in want.items():  # every record that meets the region lies in the chunk
        assert all(got[i][0] <= x[3] and x[4] <= got[i][1] for x in data if x[1] < e and b < x[2])


def test_strategies(spark):
    c = spark.createDataFrame([(1, a << 16, b << 16) for a, b in ((1, 2), (2, 3), (0xFFFF, 0x10000), (0x4FFFF, 0x50000))], "k INT, chunk_begin LONG, chunk_end LONG")
    count = lambda s: s(c, ["k"]).count()
    assert (count(X.identity), count(X.adjacent), count(X.squash), count(X.compressor(0x20000)), count(X.compressor(0x100000))) == (4, 3, 1, 2, 1)


def test_container_file(spark, tmp_path):
    path = tmp_path / "e.cram"
    path.write_bytes(b"CRAM\x03\x00" + bytes(20) + cram.EOF_CONTAINER)
    assert cram.has_eof(str(path))
    r = spark.read.format("cram_blocks").option("path", str(path)).load().head()
    assert (r["ref_id"], r["start"], r["raw_size"], bytes(r["data"]), r["crc32"]) == (-1, 4542278, 6, b"\1\0\1\0\1\0", 0x4B0163EE)
    v, head, length = cram.container_header(cram.EOF_CONTAINER)
    assert v["crc32"] == 0x4FD9BD05 and length == 15
    for i in range(len(cram.EOF_CONTAINER)):
        bad = bytearray(cram.EOF_CONTAINER)
        bad[i] ^= 0xFF
        with pytest.raises(bgzf.FormatError):
            _, head, _ = cram.container_header(bytes(bad))
            cram.block(bytes(bad[head:]), 0)
            if i < 4:
                raise bgzf.FormatError
    import bz2
    import lzma
    import zlib

    for method, packed in ((0, b"abc"), (1, zlib.compress(b"abc")), (2, bz2.compress(b"abc")), (3, lzma.compress(b"abc"))):
        assert cram.expand(method, packed, 3) == b"abc"
    with pytest.raises(NotImplementedError):
        cram.expand(4, b"", 0)


LINE = "A" * 70 + "\n"


@pytest.mark.parametrize(
    ("text", "problem"),
    [
        (">a\n" + LINE + "A" * 30 + "\n>b x\n" + LINE, None), (">\n" + LINE, "missing sequence name"), (">a\n" + LINE + ">a\n" + LINE, "duplicate sequence identifier a"), (">a\nAAA\nAAAA\n", "unexpected long line"),
        (">a\nAAAA\nAA\nAAAA\n", "unexpected short line"), (">a\n" + LINE * 3, None), (">a\nAC", None),
    ],
)
def test_sequence_index(spark, tmp_path, text, problem):
    path = tmp_path / "x.fa"
    path.write_text(text)
    for split in (7, 1 << 20):
        got = [r["problem"] for r in fasta.build_fai(spark, str(path), split).collect() if r["problem"]]
        assert (not got) if problem is None else any(problem in x for x in got)


def test_sequence_ranges(spark, tmp_path):
    path = tmp_path / "x.fa"
    body = "ACGTACGTAC\nGGGGGTTTTT\nCC\n"
    path.write_text(">one first\n" + body + ">two\nAAAA\n")
    fai = fasta.build_fai(spark, str(path))
    fasta.write_fai(fai, str(tmp_path / "x.fai"))
    assert (tmp_path / "x.fai").read_text() == "one\t22\t11\t10\t11\ntwo\t4\t41\t4\t5\n"
    ask = spark.createDataFrame([("one", 0, 22), ("one", 8, 12), ("two", None, None), ("two", 0, 5), ("x", 0, 1), ("one", 3, 3)], "name STRING, beg LONG, end LONG")
    got = fasta.read_ranges(ask, fasta.read_fai(spark, str(tmp_path / "x.fai")), str(path)).collect()
    assert sorted((r["name"], str(r["beg"]), r["seq"], r["error"]) for r in got if r["error"] is None) == [("one", "0", body.replace("\n", ""), None), ("one", "3", "", None), ("one", "8", "ACGG", None), ("two", "None", "AAAA", None)]
    assert {r["error"] for r in got if r["error"]} == {"out of range", "unknown sequence"}


@pytest.mark.parametrize("line", ["@XX\tA:b", "@HD\tSO:coordinate", "@SQ\tSN:a", "@SQ\tLN:5", "@SQ\tSN:a\tLN:0", "@SQ\tSN:a\tLN:5\tM5:xyz", "@RG\tCN:x", "@PG\tID:a\n@PG\tID:a", "@SQ\tSN:a\tLN:5\tSN:b", "@SQ\tSN:a\tLN:5\n@SQ\tSN:a\tLN:6", "@SQ\tSN", "nothing", "@RG\tID:a\tPI:x"])
def test_bad_headers(line):
    with pytest.raises(H.HeaderError, match="line "):
        H.parse_header(line)


def test_header_values(spark):
    h = H.parse_header("@HD\tVN:1\tSO:UNKNOWN\tGO:query\tpb:1\n@SQ\tSN:name\tLN:5\tfu:bar\n@SQ\tSN:name\tLN:5\tAS:x\n@RG\tID:name\tDT:2014-03-25T12:26:51-0700\n@PG\tID:name\tCL:a:b\n")
    assert (h.sort_order, h.group_order, len(h.rows["SQ"]), h.rows["SQ"][0]["assembly"], h.rows["SQ"][0]["other_tags"]) == ("unknown", "query", 1, "x", {"fu": "bar"})
    assert h.table(spark, "PG").head()["command"] == "a:b" and h.rows["RG"][0]["date"].endswith("-0700")


def test_merge_headers(spark):
    two = spark.createDataFrame([(0, 0, "a", 5), (0, 1, "b", 6), (1, 0, "b", 6), (1, 1, "c", 7)], "_src_id INT, ref_id INT, sn STRING, ln INT")
    merged, links = H.merge_references(two)
    assert sorted(tuple(r) for r in merged.collect()) == [(0, "a", 5), (1, "b", 6), (2, "c", 7)]
    assert sorted(tuple(r) for r in links.collect()) == [(0, 0, 0), (0, 1, 1), (1, 0, 1), (1, 1, 2)]
    with pytest.raises(Exception, match="different lengths"):
        H.merge_references(two.withColumn("ln", F.col("ln") + F.col("_src_id")))[0].collect()


def test_dictionary_edits(spark):
    t = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "ref_id INT, sn STRING")
    assert sorted(tuple(r) for r in H.remove_rows(t, ["a"], "ref_id", "sn").collect()) == [(0, "b"), (1, "c")]
    assert sorted(tuple(r) for r in H.add_rows(t, spark.createDataFrame([(9, "b"), (9, "z"), (9, "y")], "ref_id INT, sn STRING"), "ref_id", "sn").collect())[3:] == [(3, "y"), (4, "z")]
    assert {r["sn"] for r in H.rename_row(t, "a", "n", "sn").collect()} == {"n", "b", "c"}
    with pytest.raises(Exception, match="name taken"):
        H.rename_row(t, "a", "b", "sn").collect()


def test_orders(spark):
    data = [("r1", 0, "ref", 6, 0, 0), ("r2", 0, "ref", 8, 0, 1), ("000", None, None, -1, 0, 2), ("r0", 0, "ref", 8, 1, 0)]
    df = spark.createDataFrame(data, "qname STRING, ref_id INT, rname STRING, pos LONG, _src_id INT, _src_ord LONG")
    assert [r["qname"] for r in M.sort_records(df, M.coordinate_order()).collect()] == ["r1", "r2", "r0", "000"]
    assert [r["qname"] for r in M.merge_sources([df], "queryname").collect()] == ["000", "r0", "r1", "r2"]
    assert M.order_violations(df).count() == 0
    assert M.order_violations(df.withColumn("_src_ord", -F.col("_src_ord"))).count() == 1
    with pytest.raises(ValueError, match="sort order"):
        M.merge_sources([df, df], orders=["coordinate", "queryname"])


def test_inferred_references(spark):
    lines = spark.createDataFrame([(1, "a\t0\tc2\t1\t1\t*\tc9"), (0, "a\t0\tc1\t1\t1\t*\t="), (2, "x"), (3, None)], "ord LONG, value STRING")
    assert sorted(tuple(r) for r in sam.inferred_references(lines).collect()) == [(0, "c1", 0), (1, "c2", 0), (2, "c9", 0)]


def test_streams(spark, tmp_path):
    from readloom.streaming import loading

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.sam").write_text(SAM)
    lines = loading.stream_lines(spark, str(tmp_path / "in")).withColumn("id", F.lit(1).cast("bigint"))
    good, bad = loading.stream_records(lines, "id", "value")
    assert loading.run_once(good.select("qname", "pos")).count() == 6 and loading.run_once(bad).count() == 0


def test_merged_references_keep_what_sources_know(spark):
    schema = "_src_id INT, ref_id INT, sn STRING, ln INT, md5 BINARY, assembly STRING, species STRING, uri STRING, other_tags MAP<STRING, STRING>"
    m = lambda c: bytes([c]) * 16
    rows = [(1, 0, "a", 5, m(1), None, "s", None, None), (1, 1, "b", 6, None, "x", None, None, {"k": "v"}), (2, 0, "b", 6, None, "y", "t", None, None), (2, 1, "a", 5, None, "as", None, None, None), (3, 0, "a", 5, m(2), None, None, "u", None), (3, 1, "c", 9, None, None, None, None, {"z": "1"})]
    merged, links = H.merge_references(spark.createDataFrame(rows, schema))
    got = {r["sn"]: (r["new_id"], r["ln"], r["md5"] and bytes(r["md5"]), r["assembly"], r["species"], r["uri"], r["other_tags"]) for r in merged.collect()}
    # what is alike changes nothing; what differs takes the place, with what was known beyond
    assert got == {"a": (0, 5, m(2), None, "s", "u", None), "b": (1, 6, None, "y", "t", None, None), "c": (2, 9, None, None, None, None, {"z": "1"})}
    assert sorted(tuple(r) for r in links.collect()) == [(1, 0, 0), (1, 1, 1), (2, 0, 1), (2, 1, 0), (3, 0, 0), (3, 1, 2)]
    for bad in ((4, 0, "a", 7, None, None, None, None, None), (4, 0, "a", 5, m(9), None, None, None, {"q": "r"})):
        with pytest.raises(Exception, match="different lengths or fields: a"):
            H.merge_references(spark.createDataFrame([*rows, bad], schema))[0].collect()
    groups = spark.createDataFrame([(1, "g"), (2, "h")], "_src_id INT, id STRING")
    _, _, g, p = H.merge_headers(spark.createDataFrame(rows, schema), groups, groups.limit(0))
    assert [r["id"] for r in g.collect()] == ["g"] and p.count() == 0


def test_set_and_new_rows(spark):
    t = spark.createDataFrame([("a", 5, None, {"XX": "1"}), ("b", 6, b"x" * 16, None)], "sn STRING, ln INT, md5 BINARY, other_tags MAP<STRING, STRING>")
    some = lambda v: F.when(F.col("sn") == "a", F.lit(v))
    assert [r["ln"] for r in H.set_tag(t, "SQ", "LN", some("77")).orderBy("sn").collect()] == [77, 6]
    assert [r["other_tags"] for r in H.set_tag(t, "SQ", "XX", F.lit("")).orderBy("sn").collect()] == [{}, {}]
    assert [r["other_tags"] for r in H.set_tag(t, "SQ", "YY", F.lit("2")).orderBy("sn").collect()] == [{"XX": "1", "YY": "2"}, {"YY": "2"}]
    assert H.set_tag(t, "SQ", "M5", F.lit("0" * 32)).select(H.get_tag("SQ", "M5")).distinct().collect()[0][0] == "0" * 32
    for tag, value, why in (("LN", "0", "bad LN"), ("LN", "x", "bad LN"), ("M5", "12", "bad M5"), ("SN", "", "keeps its name"), ("LN", "", "keeps its name")):
        with pytest.raises(Exception, match=why):
            H.set_tag(t, "SQ", tag, some(value)).collect()
    new = H.new_rows(t.withColumn("place", F.lit(9) - F.col("ln")), "SQ", "place").collect()
    assert [(r["ref_id"], r["sn"], r["species"]) for r in new] == [(0, "b", None), (1, "a", None)]
    with pytest.raises(Exception, match="length out of range: a"):
        H.new_rows(t.withColumn("ln", F.when(F.col("sn") == "a", 0).otherwise(F.col("ln"))), "SQ", "sn").collect()
    with pytest.raises(Exception, match="name taken: b"):
        H.add_rows(t.select(F.lit(0).alias("ref_id"), "sn"), spark.createDataFrame([(1, "b"), (2, "c")], "ref_id INT, sn STRING"), "ref_id", "sn", strict=True).collect()
    with pytest.raises(Exception, match="_src_id 4: line 1"):
        H.parse_headers(spark.createDataFrame([(3, "@RG\tID:x\tPI:7"), (4, "@RG\tPI:7")], "_src_id INT, text STRING"), "RG").collect()


def test_new_aux_types(spark):
    one = spark.range(1)
    value = lambda *a, **k: one.select(T.format_aux(T.new_aux("XT", *a, **k))).head()[0]
    got = [value(*x) for x in (("A", F.lit("q")), ("c", F.lit(-128)), ("C", F.lit(255)), ("s", F.lit(-32768)), ("S", F.lit(65535)), ("i", F.lit(-(1 << 31))), ("I", F.lit((1 << 32) - 1)), ("f", F.lit(1.5)), ("Z", F.lit("")), ("H", F.lit(b"\x1a\xe3")))]
    assert got == ["XT:A:q", "XT:i:-128", "XT:i:255", "XT:i:-32768", "XT:i:65535", "XT:i:-2147483648", "XT:i:4294967295", "XT:f:1.5", "XT:Z:", "XT:H:1AE3"]
    assert value("B", F.array(F.lit(-1), F.lit(7)), "c") == "XT:B:c,-1,7" and value("B", F.array(F.lit(0.5)), "f") == "XT:B:f,0.5"
    kind = lambda t, v: one.select(T.new_aux("XT", t, F.lit(v))["type"]).head()[0]
    assert [kind("int", v) for v in (0, 127, 128, -129, 40_000, 1 << 31)] == ["c", "c", "s", "s", "i", None] and [kind("uint", v) for v in (0, 255, 256, 70_000, -1, 1 << 32)] == ["C", "C", "S", "I", None, None]
    assert [one.select(T.new_aux("XT", *x)).head()[0] for x in (("c", F.lit(128)), ("A", F.lit("ab")), ("Z", F.lit("a\tb")), ("B", F.array(F.lit(300)), "C"), ("B", F.expr("CAST(array() AS ARRAY<INT>)"), "C"), ("f", F.lit(None)))] == [None] * 6
    with pytest.raises(ValueError):
        T.new_aux("XT", "Q", F.lit(1))


def test_index_of_long_records_and_many_regions(spark):
    big = 10**12
    r = spark.createDataFrame([(1, 5, big, 10, 20), (1, 40_000, 40_001, 30, 40), (1, 3_000_000, 9_000_000, 25, 30), (2, (1 << 29) + 5, (1 << 29) + 9, 1, 2)], "ref_id INT, beg LONG, end LONG, _voff_begin LONG, _voff_end LONG")
    linear = X.build_linear(r, ["ref_id"], F.col("beg"), F.col("end"))
    tiles = {(t["ref_id"], t["tile"]): t["voff"] for t in linear.collect()}
    assert len(tiles) == X.TILES and set(tiles.values()) == {10} and {k[0] for k in tiles} == {1}
    short = r.where("end < 10000000")
    tiles = {t["tile"]: t["voff"] for t in X.build_linear(short, ["ref_id"], F.col("beg"), F.col("end")).collect()}
    assert tiles == {2: 30} | {t: 25 for t in range(3_000_000 >> 14, (8_999_999 >> 14) + 1)}
    rnd = random.Random(4)
    known = {t: rnd.randrange(1000) for t in rnd.sample(range(X.TILES), 3000)}
    linear = spark.createDataFrame([(1, t, v) for t, v in known.items()], "ref_id INT, tile LONG, voff LONG")
    asked = [(i, 1, b, min(b + rnd.choice((1, 20_000, 5_000_000, 1 << 29)), 1 << 29)) for i in range(100_000) for b in (rnd.randrange(1 << 29),)]
    floors = {f["region_id"]: f["floor"] for f in X.first_offsets(spark.createDataFrame(asked, "region_id LONG, ref_id INT, beg LONG, end LONG"), linear, ["ref_id"]).collect()}
    for i, _, b, e in asked[:2000]:
        assert floors.get(i) == min((v for t, v in known.items() if b >> 14 <= t <= (e - 1) >> 14), default=None)


@pytest.mark.parametrize("name", ["idx09_bai_lookup", "idx10_csi_lookup", "idx11_tabix_lookup"])
def test_opened_regions_are_not_broadcast(spark, small, name):
    """A region has hundreds of bins, a row each, and the planner doesn't count them: no join on bins or nodes may go through the driver."""
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, small)
    assert df.collect()
    ran = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert not re.findall(r"Broadcast\w+Join \[[^\]]*\b(?:bin|node)#", ran) and re.search(r"Join \[[^\]]*\bbin#", ran)


def _far_sources(spark, tmp_path):
    """Indexed sources of large numbers, each with a record that meets its region and one past it; the regions as numbers."""
    keys = [(s, r) for s in (0, 20_505, 20_506, 90_000, (1 << 31) - 1) for r in (0, 7, (1 << 31) - 1)]
    beg = {(s, r): (r * 7919 + s * 104729) % 40 * 1_000_000 for s, r in keys}
    spark.createDataFrame(keys, "_src_id INT, ref_id INT").write.parquet(f"{tmp_path}/index_stats.parquet")
    rows = [(i, s, r, 0, beg[s, r] + at) for i, ((s, r), at) in enumerate((k, at) for k in keys for at in (2_999_990, 3_000_000))]
    records = spark.createDataFrame(rows, "row_id LONG, _src_id INT, ref_id INT, flag INT, pos LONG")
    records.withColumn("cigar", F.expr("array(named_struct('len', 30L, 'op', 'M'))")).write.parquet(f"{tmp_path}/alignments.parquet")
    return str(tmp_path), beg


def test_bins_of_regions_of_many_sources(spark, tmp_path):
    from readloom.plans import records

    d, beg = _far_sources(spark, tmp_path)
    levels = ((0, 29), (1, 26), (9, 23), (73, 20), (585, 17), (4681, 14))
    want = sorted((*k, off + i) for k, b in beg.items() for off, s in levels for i in range(b >> s, ((b + 2_999_999) >> s) + 1))
    assert sorted(tuple(x) for x in records.QUERIES["idx02_overlapping_bins"](spark, d).collect()) == want


@pytest.mark.parametrize("name", ["ivl01_interval_join", "ivl02_interval_join_tiles"])
def test_interval_join_of_many_sources(spark, tmp_path, name):
    from readloom.plans import records

    d, beg = _far_sources(spark, tmp_path)
    assert sorted(tuple(x) for x in records.QUERIES[name](spark, d).select("_src_id", "ref_id", "n", "bases").collect()) == sorted((*k, 1, 10) for k in beg)


def test_strict_lookup(spark):
    bins = spark.createDataFrame([("a", 4681, 10, 20, 10)], "name STRING, bin LONG, chunk_begin LONG, chunk_end LONG, left_voff LONG")
    region = lambda n, b: spark.createDataFrame([(1, n, b, b + 5)], "region_id LONG, name STRING, beg LONG, end LONG")
    assert X.lookup(region("a", 3), bins, None, ["name"], strict=True).count() == 1 and X.lookup(region("x", 3), bins, None, ["name"]).count() == 0
    for n, b, why in (("x", 3, "unknown reference: x"), ("a", 1 << 29, "past the index: a")):
        with pytest.raises(Exception, match=why):
            X.lookup(region(n, b), bins, None, ["name"], strict=True).collect()


def test_checkpoint_folder_of_a_cluster_is_given():
    from readloom.session import checkpoint_dir

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(lambda: {})

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session)


@pytest.mark.parametrize("longest", [50, 5 * 10**12])
def test_interval_join_of_long_intervals(spark, longest):
    rnd = random.Random(longest)
    make = lambda n: [(rnd.choice(("x", "y", None)), b, b + rnd.choice((0, 1, 7, 40, rnd.randrange(1, longest)))) for b in (rnd.choice((rnd.randrange(-300, 300), rnd.randrange(-300, 2000), rnd.randrange(1 << 40))) for _ in range(n))]
    a, b = [(*r, i) for i, r in enumerate(make(150) + [("x", 3, None), ("y", 5, 5)])], [(*r, i) for i, r in enumerate(make(120) + [("x", 0, longest)] * 2)]
    left, right = spark.createDataFrame(a, "k STRING, beg LONG, end LONG, i LONG"), spark.createDataFrame(b, "k STRING, rbeg LONG, rend LONG, j LONG")
    want = sorted((x[3], y[3]) for x in a for y in b if x[0] is not None and x[0] == y[0] and x[2] is not None and x[1] < x[2] and y[1] < y[2] and x[1] < y[2] and y[1] < x[2])
    got = X.interval_join(left, right, ["k"], 16)
    assert got.columns == ["k", "beg", "end", "i", "rbeg", "rend", "j"] and sorted((r["i"], r["j"]) for r in got.collect()) == want and len(want) > 10
