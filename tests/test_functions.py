"""Golden tables of the scalar functions."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from readloom.functions import bins as B
from readloom.functions import cigar as C
from readloom.functions import codecs, records as R, sequences as S, tags as T


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).head())


def table_of(spark, values, schema, column):
    df = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], f"i INT, {schema}")
    return [r[1] for r in df.select("i", column.alias("x")).orderBy("i").collect()]


ENDS = {"20M5B20M": 35, "10M3B11M": 18, "10H3B": 0, "3M10H": 3, "3M10N": 13, "10N3M": 13, "3M10S10H": 3, "10B10N10B10N3M": 3, "10B10N5B10N3M": 8}
VALID = [("*", 0, True), ("20M5B20M", 40, True), ("50M5000B20M", 70, False), ("10M3B11M", 21, True), ("10H3B11M", 11, False), ("10H3B", 0, True), ("3M10H", 3, True), ("3M10H10H", 3, False), ("3M10H10S", 13, False), ("3M10S10H", 13, True), ("10B10N10B10N3M", 3, True)]
LENGTHS = {"151M": (151, 151), "10S10M": (10, 20), "11H11M": (11, 11), "11H1D11M": (12, 11), "5M21N5M": (31, 10), "21N": (21, 0), "0M1I1D": (1, 1), "1000000000M": (10**9, 10**9), "1000000000000M": (10**12, 10**12)}


def test_ends(spark):
    assert table_of(spark, list(ENDS), "c STRING", R.record_end(F.lit(0), F.lit(0), C.parse_cigar(F.col("c")))) == list(ENDS.values())


def test_validity(spark):
    got = table_of(spark, [(c, n) for c, n, _ in VALID], "c STRING, n LONG", C.is_valid(C.parse_cigar(F.col("c")), F.col("n")))
    assert got == [v for *_, v in VALID]


def test_lengths_and_split_operations(spark):
    got = table_of(spark, list(LENGTHS), "c STRING", C.lengths(C.parse_cigar(F.col("c"))))
    assert [tuple(x) for x in got] == list(LENGTHS.values())
    n, top = one(spark, F.size(C.parse_cigar(F.lit("1000000000000M"))), F.array_max(F.transform(C.parse_cigar(F.lit("1000000000000M")), lambda x: x["len"])))
    assert (n, top) == (3726, (1 << 28) - 1)


def test_malformed_operations_are_null(spark):
    assert table_of(spark, ["M", "3", "3Q", "12345678901234M", None, "", "*"], "c STRING", F.size(C.parse_cigar(F.col("c")))) == [None, None, None, None, 0, 0, 0]


def test_null_parts_of_operations(spark):
    df = spark.createDataFrame([([(None, "M"), (3, None), (4, "M")],)], "c ARRAY<STRUCT<len: BIGINT, op: STRING>>")
    assert tuple(df.select(C.reach(F.lit(10), F.col("c")), C.read_length(F.col("c"))).head()) == (14, 4)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 10**6), st.sampled_from(C.OPS)), min_size=1, max_size=6))
def test_format_is_inverse_of_parse(spark, ops):
    text = "".join(f"{n}{o}" for n, o in ops)
    assert one(spark, C.format_cigar(C.parse_cigar(F.lit(text))))[0] == text


def test_packed_operations(spark):
    assert one(spark, C.pack_op(F.lit(5), F.lit("S")), C.unpack_op(F.lit(5 << 4 | 4).cast("bigint"))["op"]) == (5 << 4 | 4, "S")


def test_specification_records(spark):
    data = [("r001", 99, 6, "8M2I4M1D3M", 22, 15), ("r002", 0, 8, "3S6M1P1I4M", 18, 10), ("r003", 0, 8, "5S6M", 14, 6), ("r004", 0, 15, "6M14N5M", 40, 11), ("r003", 2064, 28, "6H5M", 33, 5), ("r001", 147, 36, "9M", 45, 9)]
    df = spark.createDataFrame(data, "q STRING, f INT, p LONG, c STRING, e LONG, o LONG")
    c = C.parse_cigar(F.col("c"))
    assert all(a == e and b == o for a, e, b, o in df.select(R.record_end(F.col("f"), F.col("p"), c), "e", C.overlap(F.col("p"), c, F.lit(0), F.lit(45)), "o").collect())


def test_bins(spark):
    got = table_of(spark, [(62914560, 69206016), (73400320, 79691776), (76546048, 78643200), (-1, 0), (0, 1)], "b LONG, e LONG", B.bin_for(F.col("b"), F.col("e")))
    assert got == [0, 2, 18, 4680, 4681]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, (1 << 29) - 2), st.integers(1, 1 << 22))
def test_bins_cover_overlaps(spark, beg, size):
    a, overlapping = one(spark, B.bin_for(F.lit(beg), F.lit(beg + size)), B.overlapping_bins(F.lit(max(0, beg - 3)), F.lit(beg + 1)))
    assert a in overlapping


def test_sizing():
    assert (B.minimum_shift_for(B.csi_max_pos(14, 5), 5), B.minimum_depth_for(B.csi_max_pos(14, 5), 14), B.minimum_depth_for(B.csi_max_pos(14, 5) + 1, 14)) == (14, 5, 6)


def test_flags(spark):
    assert one(spark, R.flag_letters(F.lit(99)), R.flag_letters(F.lit(98)), R.flag_text(F.lit(99), "hex"), R.flag_text(F.lit(99), "string")) == ("pP---R1-----", "------------", "0x63", "pPR1")
    assert table_of(spark, ["99", "0x63", "017", "0b11", "65536", "x", None], "t STRING", R.parse_flag(F.col("t"))) == [99, 99, 15, 3, None, None, None]
    assert one(spark, R.flag_letters(F.lit(None).cast("int")))[0] == "-" * 12


def test_sequences(spark):
    assert one(spark, F.hex(S.pack_seq(F.lit("TACGTMRSVKDBWYH"))), S.unpack_seq(S.pack_seq(F.lit("acgu0")), F.lit(5))) == ("812483567CDE9AB0", "ACGNA")
    assert one(spark, S.encode_qual(S.decode_qual(F.lit("II#!"), F.lit(4))), S.encode_qual(S.decode_qual(F.lit("*"), F.lit(3))), S.base_at(F.lit("ACG"), F.lit(3))) == ("II#!", "*", None)


def test_tags(spark):
    texts = ["NH:i:2", "NE:i:-100", "MN:i:-1000", "MD:Z:2C0T2T1C13", "jM:B:c,-1", "jI:B:i,629,1095", "fT:f:3.14", "XH:H:1AE3", "XE:Z:", "XI:i:4294967295"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING").select("i", "t", T.parse_aux(F.col("t")).alias("a"))
    got = df.select("t", "a.type", T.format_aux(F.col("a")).alias("back")).orderBy("i").collect()
    assert [r["type"] for r in got] == ["C", "c", "s", "Z", "B", "B", "f", "H", "Z", "I"]
    assert all(r["t"] == r["back"] for r in got)


@pytest.mark.parametrize("v", [0, 1, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28 - 1, 2**28, 0x10000010, 4542278, 2**31 - 1, -1, -(2**31)])
def test_itf8(spark, v):
    raw, back = one(spark, codecs.itf8_encode(F.lit(v)), codecs.itf8_decode(codecs.itf8_encode(F.lit(v))))
    assert back == v and codecs.read_itf8(bytes(raw), 0) == (v, len(raw))


def test_itf8_known():
    assert codecs.read_itf8(bytes.fromhex("ffffffff0f"), 0)[0] == -1 and codecs.read_itf8(bytes.fromhex("e0454f46"), 0)[0] == 4542278


def test_ltf8(spark):
    values = sorted({s * (2**i + d) for i in range(63) for d in (-1, 0, 1) for s in (1, -1)})
    df = spark.createDataFrame([(v,) for v in values], "v LONG").select("v", codecs.ltf8_encode(F.col("v")).alias("b")).select("v", "b", codecs.ltf8_decode(F.col("b")).alias("back"))
    for v, b, back in df.collect():
        assert back == v and codecs.read_ltf8(bytes(b), 0) == (v, len(b))


def test_record_rules(spark):
    schema = "qname STRING, flag INT, ref_id INT, pos LONG, mate_ref_id INT, mate_pos LONG, tlen INT, seq STRING, qual ARRAY<SMALLINT>, c STRING"
    data = [("a", 0, 1, 5, None, -1, 0, "ACGT", None, "4M"), ("a", 0, None, -1, None, -1, 0, "ACGT", None, "4M"), ("a", 6, 1, 5, None, -1, 0, "ACGT", None, "*"), ("", 0, 1, 5, None, -1, 0, "A", None, "1M"), ("a", 0, 1, 5, None, 7, 0, "A", None, "1M"), (None, None, None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(data, schema).withColumn("cigar", C.parse_cigar(F.col("c")))
    r = {k: F.col(k) for k in df.columns}
    got = df.select(R.is_valid_record(r), R.record_error(r)).collect()
    assert [x[0] for x in got] == [True, False, False, True, True, False]
    assert [x[1] for x in got] == [None, None, None, "name length out of range", "mate position without reference", "name length out of range"]


def _float_alignments(spark, tmp_path, small):
    """The small table and records with float fields of every size, as a table of its own."""
    a = spark.read.parquet(f"{small}/alignments.parquet")
    values = [0.1, -0.60428715, 1e-5, 1.5e10, 3.4028235e38, 1.4e-45, 0.0, -0.024252644]
    scalar = [(v, None) for v in values]
    more = spark.createDataFrame([(-1 - i, f, r) for i, (f, r) in enumerate([*scalar, (None, values), (None, [2.5])])], "row_id LONG, f FLOAT, r ARRAY<FLOAT>")
    aux = F.array(F.struct(F.lit("XF").alias("tag"), F.when(F.col("f").isNotNull(), "f").otherwise("B").alias("type"), F.when(F.col("f").isNull(), "f").alias("subtype"), F.lit(None).cast("string").alias("sval"), F.lit(None).cast("bigint").alias("ival"),
                           F.col("f").alias("fval"), F.lit(None).cast("array<bigint>").alias("iarr"), F.col("r").alias("farr"), F.lit(None).cast("binary").alias("bval")))
    a.unionByName(more.select("row_id", aux.alias("aux")), allowMissingColumns=True).write.parquet(f"{tmp_path}/alignments.parquet")
    return str(tmp_path)


def _float_fields(spark, d):
    """Every record, and the values of every float field by row and place."""
    source = {r["row_id"]: r for r in spark.read.parquet(f"{d}/alignments.parquet").select("row_id", "aux", "seq", "qual").collect()}
    floats = {(k, i): [x["fval"]] if x["type"] == "f" else x["farr"] for k, r in source.items() for i, x in enumerate(r["aux"] or [], 1) if "f" in (x["type"], x["subtype"])}
    assert len(floats) > 10 and any(k > 0 for k, _ in floats)
    return source, floats


def _numbers(x, text):
    import numpy as np

    head, value = text[:5], text[5:]
    assert head == f"{x['tag']}:{x['type']}:" and (x["type"] == "f" or value[:2] == "f,")
    return [float(np.float32(v)) for v in ([value] if x["type"] == "f" else value[2:].split(","))]


def test_float_fields_are_in_the_lines(spark, small, tmp_path):
    from readloom.plans import io

    d = _float_alignments(spark, tmp_path, small)
    source, floats = _float_fields(spark, d)
    lines = {r["row_id"]: r["line"] for r in io.sam_texts(spark, d).collect()}
    assert set(lines) == set(source)
    bad = {k for k, r in source.items() if r["qual"] and len(r["qual"]) != len(r["seq"] or "")}
    assert {k for k, v in lines.items() if v is None} == bad
    for (k, i), want in floats.items():
        assert k in bad or _numbers(source[k]["aux"][i - 1], lines[k].split("\t")[10 + i]) == want


def test_float_fields_are_parsed_and_formatted(spark, small, tmp_path):
    from readloom.plans import records

    d = _float_alignments(spark, tmp_path, small)
    source, floats = _float_fields(spark, d)
    parsed = {(r["row_id"], r["i"]): r for r in records.QUERIES["aux01_parse"](spark, d).collect()}
    text = {(r["row_id"], r["i"]): r["text"] for r in records.aux_texts(spark, d).collect()}
    assert set(parsed) == set(text) == {(k, i) for k, r in source.items() for i in range(1, len(r["aux"] or []) + 1)}
    for (k, i), want in floats.items():
        x, p = source[k]["aux"][i - 1], parsed[k, i]
        assert _numbers(x, text[k, i]) == want == ([p["fval"]] if x["type"] == "f" else p["farr"])
