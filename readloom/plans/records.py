
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions import bins as B
from readloom.functions import cigar as C
from readloom.functions import codecs, records as R, sequences as S, tags as T
from readloom.operators import flagstat as FS
from readloom.operators import header as H
from readloom.operators import index as X
from readloom.operators import merging as M
from readloom.operators.instants import iso_dates
from readloom.session import table
from readloom.sources.fasta import byte_offset

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def aln(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "alignments")


def per_row(name: str, sql: str, **columns: Callable[[], Column]) -> None:
    """A query that maps every alignment to row_id and the columns."""
    QUERIES[name] = lambda spark, d: aln(spark, d).select("row_id", *[c().alias(k) for k, c in columns.items()])
    SQL[name] = sql


_L = F.expr

# shared SQL: running reference position of every operation, and the end of every record
_REF = "CASE WHEN o.op IN ('M','D','N','=','X') THEN 1 WHEN o.op = 'B' THEN -1 ELSE 0 END"
_QRY = "CASE WHEN o.op IN ('M','I','S','=','X') THEN 1 ELSE 0 END"
_OPS = f"""
ops AS (SELECT row_id, unnest(cigar) AS o, unnest(range(1, len(cigar) + 1)) AS i, pos, seq, flag FROM alignments WHERE len(cigar) > 0),
steps AS (SELECT row_id, i, o.op AS op, coalesce(o.len, 0) AS len, coalesce(o.len, 0) * ({_REF}) AS r, coalesce(o.len, 0) * ({_QRY}) AS q, pos, seq, flag FROM ops),
walk AS (SELECT *, sum(r) OVER (PARTITION BY row_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS after FROM steps),
ends AS (SELECT a.row_id, a.pos, a.flag, a.mate_ref_id, a.ref_id, a._src_id, a._voff_begin, a._voff_end,
                CAST(CASE WHEN a.flag & 4 <> 0 OR coalesce(len(a.cigar), 0) = 0 THEN a.pos + 1 ELSE a.pos + greatest(0, w.m) END AS BIGINT) AS e
         FROM alignments a LEFT JOIN (SELECT row_id, max(after) AS m FROM walk GROUP BY row_id) w USING (row_id))"""


def _bin_sql(b: str, e: str) -> str:
    whens = " ".join(f"WHEN ({b} >> {s}) = (({e} - 1) >> {s}) THEN {o} + ({b} >> {s})" for s, o in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)))
    return f"CASE {whens} ELSE 0 END"


# --- scalars of a record
QUERIES["scl01_flag_filter"] = lambda s, d: aln(s, d).agg(F.count_if(R.flag_filter(F.col("flag"), 1, 0x904)).alias("n"), F.count_if(R.flag_filter(F.col("flag"), 0, 4)).alias("mapped"))
SQL["scl01_flag_filter"] = "SELECT count(*) FILTER (WHERE flag & 1 = 1 AND flag & 2308 = 0) AS n, count(*) FILTER (WHERE flag & 4 = 0) AS mapped FROM alignments"
per_row("scl02_start_ref", "SELECT row_id, coalesce(pos, -1) AS start, coalesce(ref_id, -1) AS ref FROM alignments", start=lambda: F.coalesce(F.col("pos"), _L("-1L")), ref=lambda: F.coalesce("ref_id", F.lit(-1)))
per_row("scl03_record_end", f"WITH {_OPS} SELECT row_id, e AS \"end\" FROM ends", end=lambda: R.record_end(F.col("flag"), F.col("pos"), F.col("cigar")))
per_row("scl04_record_len", f"WITH {_OPS} SELECT row_id, e - pos AS len FROM ends", len=lambda: R.record_len(F.col("flag"), F.col("pos"), F.col("cigar")))
per_row("scl05_record_bin", f"WITH {_OPS} SELECT row_id, CAST(CASE WHEN flag & 12 = 12 THEN 4680 ELSE ({_bin_sql('pos', 'e')}) & 65535 END AS BIGINT) AS bin FROM ends", bin=lambda: R.record_bin(F.col("flag"), F.col("pos"), F.col("cigar")))
per_row("scl06_strand", "SELECT row_id, CASE WHEN flag & 16 <> 0 THEN -1 ELSE 1 END AS strand FROM alignments", strand=lambda: R.strand(F.col("flag")))
def _cols() -> dict[str, Column]:
    return {k: F.col(k) for k in ("qname", "flag", "ref_id", "pos", "cigar", "mate_ref_id", "mate_pos", "tlen", "seq", "qual")}
per_row(
    "scl07_record_error",
    """SELECT row_id, CASE WHEN NOT coalesce(pos, -1) BETWEEN -1 AND 2147483646 THEN 'position out of range' WHEN NOT coalesce(mate_pos, -1) BETWEEN -1 AND 2147483646 THEN 'mate position out of range'
    WHEN abs(coalesce(tlen, 0)::BIGINT) > 2147483647 THEN 'template length out of range' WHEN qname IS NULL OR NOT strlen(qname) BETWEEN 1 AND 254 THEN 'name length out of range'
    WHEN coalesce(length(seq), 0) < 1 THEN 'no sequence' WHEN coalesce(len(qual), 0) > 0 AND len(qual) <> length(seq) THEN 'sequence/quality length mismatch'
    WHEN ref_id IS NULL AND coalesce(pos, -1) <> -1 THEN 'position without reference' WHEN ref_id IS NOT NULL AND coalesce(pos, -1) = -1 THEN 'reference without position'
    WHEN mate_ref_id IS NULL AND coalesce(mate_pos, -1) <> -1 THEN 'mate position without reference' WHEN mate_ref_id IS NOT NULL AND coalesce(mate_pos, -1) = -1 THEN 'mate reference without position' END AS error
    FROM alignments""",
    error=lambda: R.record_error(_cols()),
)
per_row(
    "scl08_is_valid_record",
    f"""WITH {_OPS}, q AS (SELECT row_id, sum(q) AS q FROM steps GROUP BY row_id)
    SELECT row_id, NOT (((ref_id IS NULL OR coalesce(pos, -1) = -1) AND flag & 4 = 0) OR (flag & 1 = 1 AND (mate_ref_id IS NULL OR coalesce(mate_pos, -1) = -1) AND flag & 8 = 0)
      OR flag & 6 = 6 OR flag & 11 = 11 OR (coalesce(len(qual), 0) <> 0 AND coalesce(len(qual), 0) <> coalesce(length(seq), 0))
      OR (coalesce(length(seq), 0) <> 0 AND coalesce(q.q, 0) <> length(seq))) AS ok FROM alignments LEFT JOIN q USING (row_id)""",
    ok=lambda: R.is_valid_record(_cols()),
)
_TAG = "aux[list_position(list_transform(aux, lambda x: x.tag), '{}')]"
per_row("scl09_tag", f"SELECT row_id, {_TAG.format('NM')}.ival AS nm, {_TAG.format('RG')}.sval AS rg FROM alignments", nm=lambda: R.first_tag(F.col("aux"), "NM")["ival"], rg=lambda: R.first_tag(F.col("aux"), "RG")["sval"])
per_row("scl10_placed_mapped", "SELECT row_id, ref_id IS NOT NULL AND ref_id >= 0 AND coalesce(pos, -1) <> -1 AS placed, flag & 4 = 0 AS mapped FROM alignments", placed=lambda: R.is_placed(F.col("ref_id"), F.col("pos")), mapped=lambda: R.is_mapped(F.col("flag")))
QUERIES["scl11_overlap"] = lambda s, d: aln(s, d).where("pos IS NOT NULL").select("row_id", C.overlap(F.col("pos"), F.col("cigar"), F.col("pos") + 5, F.col("pos") + 30).alias("bases"))
SQL["scl11_overlap"] = f"""WITH {_OPS}, o AS (SELECT row_id, sum(CASE WHEN op IN ('M','=','X') THEN greatest(0, least(pos + after, pos + 30) - greatest(pos + after - r, pos + 5)) ELSE 0 END) AS v FROM walk GROUP BY row_id)
    SELECT row_id, CAST(coalesce(o.v, 0) AS BIGINT) AS bases FROM alignments LEFT JOIN o USING (row_id) WHERE pos IS NOT NULL"""

# --- operations
_CIGTEXT = "CASE WHEN coalesce(len(cigar), 0) = 0 THEN '*' ELSE array_to_string(list_transform(cigar, lambda x: x.len::VARCHAR || x.op), '') END"
per_row("cig01_parse", "SELECT row_id, coalesce(len(cigar), 0)::INT AS n_ops, coalesce(list_sum(list_transform(cigar, lambda x: x.len)), 0)::BIGINT AS total FROM alignments",
        n_ops=lambda: F.size(C.parse_cigar(C.format_cigar(F.col("cigar")))), total=lambda: F.aggregate(C.parse_cigar(C.format_cigar(F.col("cigar"))), _L("0L"), lambda a, x: a + x["len"]))
per_row("cig02_format", f"SELECT row_id, {_CIGTEXT} AS text FROM alignments", text=lambda: C.format_cigar(F.col("cigar")))
per_row(
    "cig03_pack_ops", "SELECT row_id, array_to_string(list_transform(coalesce(cigar, []), lambda x: ((x.len << 4) | (strpos('MIDNSHP=XB', x.op) - 1))::VARCHAR), ',') AS packed FROM alignments",
    packed=lambda: F.array_join(F.transform(C.ops_or_empty(F.col("cigar")), lambda x: C.pack_op(x["len"], x["op"]).cast("string")), ","),
)
QUERIES["cig04_consumes"] = lambda s, d: aln(s, d).select(F.explode("cigar").alias("o")).groupBy(F.col("o.op").alias("op")).agg(
    F.max(C.query_consumption(F.col("o.op"))).alias("query"), F.max(C.ref_consumption(F.col("o.op"))).alias("ref"), F.sum("o.len").alias("total")
)
SQL["cig04_consumes"] = f"SELECT o.op AS op, max({_QRY})::INT AS query, max({_REF})::INT AS ref, sum(o.len)::BIGINT AS total FROM (SELECT unnest(cigar) AS o FROM alignments) GROUP BY 1"
per_row("cig05_lengths", f"WITH {_OPS}, l AS (SELECT row_id, sum(CASE WHEN op = 'B' THEN 0 ELSE r END) AS r, sum(q) AS q FROM steps GROUP BY row_id) SELECT row_id, coalesce(r, 0)::BIGINT AS ref, coalesce(q, 0)::BIGINT AS read FROM alignments LEFT JOIN l USING (row_id)",
        ref=lambda: C.lengths(F.col("cigar"))["ref"], read=lambda: C.lengths(F.col("cigar"))["read"])
per_row(
    "cig06_is_valid",
    f"""WITH {_OPS}, x AS (SELECT *, lag(op) OVER (PARTITION BY row_id ORDER BY i) AS before, lead(op) OVER (PARTITION BY row_id ORDER BY i) AS next FROM walk),
    v AS (SELECT row_id, bool_or((op = 'H' AND before IS NOT NULL AND next IS NOT NULL) OR (op = 'S' AND before IS NOT NULL AND next IS NOT NULL AND before <> 'H' AND next <> 'H')
          OR (after - r < 0 AND op IN ('M','I','S','=','X'))) AS bad, sum(q) AS q FROM x GROUP BY row_id)
    SELECT row_id, NOT coalesce(v.bad, FALSE) AND coalesce(v.q, 0) = coalesce(length(seq), 0) AS ok FROM alignments LEFT JOIN v USING (row_id)""",
    ok=lambda: C.is_valid(F.col("cigar"), F.coalesce(F.length("seq"), F.lit(0)).cast("bigint")),
)

# --- flags
_SHOWN = "CASE WHEN flag & 1 = 1 THEN flag ELSE flag & 3861 END"
_LETTERS = lambda dash: " || ".join(f"CASE WHEN ({_SHOWN}) & {1 << i} <> 0 THEN '{x}' ELSE '{dash}' END" for i, x in enumerate(R.LETTERS))
QUERIES["flg01_bits"] = lambda s, d: aln(s, d).agg(*[F.count_if(R.has(F.col("flag"), f)).alias(f.name.lower()) for f in R.Flag])
SQL["flg01_bits"] = "SELECT " + ", ".join(f"count(*) FILTER (WHERE flag & {int(f)} <> 0) AS {f.name.lower()}" for f in R.Flag) + " FROM alignments"
per_row("flg02_letters", f"SELECT row_id, {_LETTERS('-')} AS letters FROM alignments", letters=lambda: R.flag_letters(F.col("flag")))
per_row("flg03_text", f"SELECT row_id, flag::VARCHAR AS dec, '0x' || lower(to_hex(flag)) AS hex, {_LETTERS('')} AS str FROM alignments", dec=lambda: R.flag_text(F.col("flag")), hex=lambda: R.flag_text(F.col("flag"), "hex"), str=lambda: R.flag_text(F.col("flag"), "string"))

# --- bases and qualities
_NORM = "regexp_replace(translate(upper(seq), '0123', 'ACGT'), '[^=ACMGRSVTWYHKDBN]', 'N', 'g')"
per_row("seq01_pack", f"SELECT row_id, CASE WHEN length(seq) % 2 = 1 THEN translate({_NORM}, '=ACMGRSVTWYHKDBN', '0123456789ABCDEF') || '0' ELSE translate({_NORM}, '=ACMGRSVTWYHKDBN', '0123456789ABCDEF') END AS packed FROM alignments", packed=lambda: F.hex(S.pack_seq(F.col("seq"))))
per_row("seq02_unpack", f"SELECT row_id, {_NORM} AS seq FROM alignments", seq=lambda: S.unpack_seq(S.pack_seq(F.col("seq")), F.length("seq")))
per_row("seq03_base_at", "SELECT row_id, CASE WHEN length(seq) > 10 THEN substr(seq, 11, 1) END AS base FROM alignments", base=lambda: S.base_at(F.col("seq"), F.lit(10)))
per_row("seq04_qual", "SELECT row_id, CASE WHEN qual IS NULL OR len(qual) = 0 OR list_min(qual) = 255 THEN '*' ELSE array_to_string(list_transform(qual, lambda q: chr((q + 33)::INT)), '') END AS qual FROM alignments", qual=lambda: S.encode_qual(F.col("qual")))

# --- optional fields
_AUXTEXT = """x.tag || ':' || CASE WHEN x.type IN ('c','C','s','S','i','I') THEN 'i' ELSE x.type END || ':' || coalesce(CASE WHEN x.type IN ('c','C','s','S','i','I') THEN x.ival::VARCHAR
  WHEN x.type = 'H' THEN hex(x.bval) WHEN x.type = 'B' THEN x.subtype || coalesce(array_to_string(list_transform(x.iarr, lambda v: ',' || v::VARCHAR), ''), '') ELSE x.sval END, '')"""
_AUXROWS = "(SELECT row_id, unnest(aux) AS x, unnest(range(1, len(aux) + 1)) AS i FROM alignments)"
_ELEMENTS = lambda s, d: aln(s, d).select("row_id", F.posexplode("aux").alias("i", "x")).withColumn("i", (F.col("i") + 1).cast("bigint"))
QUERIES["aux01_parse"] = lambda s, d: _ELEMENTS(s, d).select("row_id", "i", T.parse_aux(T.format_aux(F.col("x"))).alias("p")).select("row_id", "i", "p.tag", "p.type", "p.subtype", "p.ival", "p.fval", "p.iarr", "p.farr")
SQL["aux01_parse"] = f"""SELECT row_id, i, x.tag AS tag, CASE WHEN x.type IN ('c','C','s','S','i','I') THEN CASE WHEN x.ival BETWEEN 0 AND 255 THEN 'C' WHEN x.ival BETWEEN 0 AND 65535 THEN 'S' WHEN x.ival >= 0 THEN 'I'
  WHEN x.ival >= -128 THEN 'c' WHEN x.ival >= -32768 THEN 's' ELSE 'i' END ELSE x.type END AS type, x.subtype AS subtype, CASE WHEN x.type IN ('c','C','s','S','i','I') THEN x.ival END AS ival,
  CASE WHEN x.type = 'f' THEN x.fval END AS fval, CASE WHEN x.type = 'B' AND x.subtype <> 'f' THEN x.iarr END AS iarr, CASE WHEN x.type = 'B' AND x.subtype = 'f' THEN x.farr END AS farr FROM {_AUXROWS}"""
per_row("aux02_new_int", "SELECT row_id, CASE WHEN tlen BETWEEN 0 AND 255 THEN 'C' WHEN tlen BETWEEN 0 AND 65535 THEN 'S' WHEN tlen >= 0 THEN 'I' WHEN tlen >= -128 THEN 'c' WHEN tlen >= -32768 THEN 's' WHEN tlen IS NOT NULL THEN 'i' END AS type FROM alignments",
        type=lambda: T.new_int_aux("XT", F.col("tlen"))["type"])
_TYPED = {"c": (-128, 127), "C": (0, 255), "s": (-32768, 32767), "S": (0, 65535), "i": (-(2**31), 2**31 - 1), "I": (0, 2**32 - 1)}
_BARE = "CASE WHEN tlen BETWEEN -128 AND 127 THEN 'c' WHEN tlen BETWEEN -32768 AND 32767 THEN 's' WHEN tlen IS NOT NULL THEN 'i' END"
per_row(
    "aux02_new_typed",
    "SELECT row_id, " + ", ".join(f"CASE WHEN tlen BETWEEN {a} AND {b} THEN tlen::BIGINT END AS {'n' if k.islower() else 'u'}{k.lower()}" for k, (a, b) in _TYPED.items()) + f""", {_BARE} AS smallest, CASE WHEN regexp_full_match(qname, '[ -~]*') THEN 'XT:Z:' || qname END AS z,
    CASE WHEN len(qual) > 0 AND list_min(qual) >= 0 AND list_max(qual) <= 127 THEN 'XB:B:c' || array_to_string(list_transform(qual, lambda q: ',' || q::VARCHAR), '') END AS b, 'XH:H:' || hex(encode(qname)) AS h FROM alignments""",
    **{f"{'n' if k.islower() else 'u'}{k.lower()}": (lambda k=k: T.new_aux("XT", k, F.col("tlen"))["ival"]) for k in _TYPED}, smallest=lambda: T.new_aux("XT", "int", F.col("tlen"))["type"],
    z=lambda: T.format_aux(T.new_aux("XT", "Z", F.col("qname"))), b=lambda: T.format_aux(T.new_aux("XB", "B", F.col("qual"), "c")), h=lambda: T.format_aux(T.new_aux("XH", "H", F.encode(F.col("qname"), "UTF-8"))),
)
QUERIES["aux03_kinds"] = lambda s, d: aln(s, d).select(F.explode("aux").alias("x")).groupBy(F.col("x.tag").alias("tag"), T.kind(F.col("x.type")).alias("kind")).agg(F.count("*").alias("n"))
SQL["aux03_kinds"] = "SELECT x.tag AS tag, CASE WHEN x.type IN ('c','C','s','S','i','I') THEN 'i' ELSE x.type END AS kind, count(*) AS n FROM (SELECT unnest(aux) AS x FROM alignments) GROUP BY 1, 2"
# engines write floats differently, so the text of a float field is compared up to its values, and the values as the numbers they are read as
_REAL = "(x.type = 'f' OR coalesce(x.subtype, '') = 'f')"
_VALUES = lambda text: F.split(F.regexp_extract(text, r"^..:(?:f:|B:f,)(.*)$", 1), ",")


def aux_texts(s: SparkSession, d: str) -> DataFrame:
    return _ELEMENTS(s, d).select("row_id", "i", T.format_aux(F.col("x")).alias("text"))


def _aux_format(s: SparkSession, d: str) -> DataFrame:
    numbers = F.transform(_VALUES(F.col("text")), lambda v: v.try_cast("float").cast("double"))
    t = aux_texts(s, d).withColumn("real", F.col("text").rlike("^..:(f:|B:f)"))
    return t.select("row_id", "i", F.when(F.col("real"), F.regexp_extract("text", "^(..:(?:f|B:f)).*$", 1)).otherwise(F.col("text")).alias("text"), F.when(F.col("real"), F.array_min(numbers)).alias("low"), F.when(F.col("real"), F.array_max(numbers)).alias("high"), F.when(F.col("real"), F.size(F.filter(numbers, lambda v: v.isNotNull()))).alias("n"))


QUERIES["aux04_format"] = _aux_format
SQL["aux04_format"] = f"""SELECT row_id, i, CASE WHEN x.type = 'f' THEN x.tag || ':f' WHEN {_REAL} THEN x.tag || ':B:f' ELSE {_AUXTEXT} END AS text, CASE WHEN {_REAL} THEN list_min(v)::DOUBLE END AS low, CASE WHEN {_REAL} THEN list_max(v)::DOUBLE END AS high,
  CASE WHEN {_REAL} THEN len(v)::INT END AS n FROM (SELECT *, CASE WHEN x.type = 'f' THEN [x.fval] WHEN x.subtype = 'f' THEN x.farr END AS v FROM {_AUXROWS})"""

# --- order
_COORD = "(ref_id IS NULL OR coalesce(pos, -1) = -1), rname NULLS FIRST, pos NULLS FIRST, _src_id, _src_ord, row_id"
QUERIES["srt01_name_order"] = lambda s, d: M.with_ordinals(aln(s, d).select("row_id", "qname", "_src_id", "_src_ord"), [*M.name_order(), F.col("_src_id"), F.col("_src_ord"), F.col("row_id")]).select("row_id", "ord")
SQL["srt01_name_order"] = "SELECT row_id, row_number() OVER (ORDER BY qname NULLS FIRST, _src_id, _src_ord, row_id) - 1 AS ord FROM alignments"
QUERIES["srt02_coordinate_order"] = lambda s, d: M.with_ordinals(aln(s, d).select("row_id", "ref_id", "rname", "pos", "_src_id", "_src_ord"), [*M.coordinate_order(), F.col("_src_id"), F.col("_src_ord"), F.col("row_id")]).select("row_id", "ord")
SQL["srt02_coordinate_order"] = f"SELECT row_id, row_number() OVER (ORDER BY {_COORD}) - 1 AS ord FROM alignments"


def _sources(s: SparkSession, d: str, *columns: str) -> list[DataFrame]:
    """The alignments as two sources that share the files."""
    a = aln(s, d).select("row_id", *columns, "_src_id", "_src_ord")
    return [a.where("_src_id % 2 = 0"), a.where("NOT (_src_id % 2 <=> 0)")]


_TIES = ["_src_id", "_src_ord", "row_id"]


@query("srt03_merge_sources", f"SELECT row_id, row_number() OVER (ORDER BY {_COORD}) - 1 AS ord FROM alignments")
def srt03(s: SparkSession, d: str) -> DataFrame:
    return M.number_rows(M.merge_sources(_sources(s, d, "ref_id", "rname", "pos"), "coordinate", orders=["coordinate", "coordinate"], ties=_TIES)).select("row_id", "ord")


@query("srt04_concatenate", "SELECT row_id, row_number() OVER (ORDER BY _src_id, _src_ord, row_id) - 1 AS ord FROM alignments")
def srt04(s: SparkSession, d: str) -> DataFrame:
    return M.number_rows(M.merge_sources(_sources(s, d), "unsorted", ties=_TIES)).select("row_id", "ord")


@query("srt05_custom_order", "SELECT row_id, row_number() OVER (ORDER BY mapq DESC NULLS LAST, qname NULLS FIRST, _src_id, _src_ord, row_id) - 1 AS ord FROM alignments")
def srt05(s: SparkSession, d: str) -> DataFrame:
    keys = [F.col("mapq").desc_nulls_last(), F.col("qname").asc_nulls_first()]
    return M.number_rows(M.merge_sources(_sources(s, d, "mapq", "qname"), "unknown", keys, ties=_TIES)).select("row_id", "ord")


_LINKS = """refs AS (SELECT DISTINCT _src_id, ref_id, rname AS sn FROM alignments WHERE ref_id IS NOT NULL AND rname IS NOT NULL),
one AS (SELECT _src_id, ref_id, min(sn) AS sn FROM refs GROUP BY ALL),
f AS (SELECT sn, min((_src_id, ref_id)) AS first FROM one GROUP BY sn), m AS (SELECT sn, (row_number() OVER (ORDER BY first) - 1)::INT AS new_id FROM f),
links AS (SELECT _src_id, ref_id AS old_id, new_id FROM one JOIN m USING (sn))"""


def _links(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    refs = aln(s, d).where("ref_id IS NOT NULL AND rname IS NOT NULL").groupBy("_src_id", "ref_id").agg(F.min("rname").alias("sn")).withColumn("ln", F.lit(1))
    return H.merge_references(refs)


@query("srt06_reassign", f"WITH {_LINKS} SELECT row_id, a.new_id AS ref_id, b.new_id AS mate_ref_id FROM alignments x LEFT JOIN links a ON x._src_id = a._src_id AND x.ref_id = a.old_id LEFT JOIN links b ON x._src_id = b._src_id AND x.mate_ref_id = b.old_id")
def srt06(s: SparkSession, d: str) -> DataFrame:
    return M.reassign_references(aln(s, d).select("row_id", "_src_id", "ref_id", "mate_ref_id"), _links(s, d)[1]).select("row_id", "ref_id", "mate_ref_id")


QUERIES["srt07_external_sort"] = lambda s, d: M.with_ordinals(aln(s, d).select("row_id", "ref_id", "pos", "_src_id", "_src_ord"), [*M.coordinate_order("ref_id"), F.col("_src_id"), F.col("_src_ord"), F.col("row_id")]).select("row_id", "ord")
SQL["srt07_external_sort"] = "SELECT row_id, row_number() OVER (ORDER BY (ref_id IS NULL OR coalesce(pos, -1) = -1), ref_id NULLS FIRST, pos NULLS FIRST, _src_id, _src_ord, row_id) - 1 AS ord FROM alignments"
QUERIES["srt08_deduplicate"] = lambda s, d: M.drop_duplicates(aln(s, d).select("row_id", "_src_id", F.col("_src_ord").alias("o"), "qname", "flag", "pos").select("*", F.struct("o", "row_id").alias("_src_ord")), ["qname", "flag", "pos"]).select("row_id")
SQL["srt08_deduplicate"] = "SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY qname, flag, pos ORDER BY _src_id, _src_ord, row_id) AS i FROM alignments) WHERE i = 1"

# --- aggregates
_BIT = lambda n: f"count(*) FILTER (WHERE flag & {n} <> 0)"
_PCT = lambda part: f"CASE WHEN paired = 0 THEN 'N/A' ELSE printf('%.2f%%', ({part}) * 100.0::DOUBLE / paired) END"
QUERIES["agg01_flagstat"] = lambda s, d: FS.flagstat(aln(s, d))
SQL["agg01_flagstat"] = f"""WITH c AS (SELECT flag & 512 <> 0 AS qc_failed, count(*) AS "rows", {', '.join(f'{_BIT(int(b))} AS {n}' for n, b in FS._BITS.items())},
  count(*) FILTER (WHERE flag & 2 <> 0 AND flag & 4 = 0) AS properly_paired, count(*) FILTER (WHERE flag & 12 = 0) AS both_mapped, count(*) FILTER (WHERE flag & 8 <> 0 AND flag & 4 = 0) AS singletons,
  count(*) FILTER (WHERE flag & 12 = 0 AND ref_id <> mate_ref_id) AS mate_other_ref, count(*) FILTER (WHERE flag & 12 = 0 AND ref_id <> mate_ref_id AND mapq > 4) AS mate_other_ref_mapq5 FROM alignments GROUP BY 1)
  SELECT *, paired AS total, paired - unmapped AS mapped, {_PCT('paired - unmapped')} AS mapped_pct, {_PCT('properly_paired')} AS properly_paired_pct, {_PCT('singletons')} AS singletons_pct FROM c"""
QUERIES["agg01_flagstat_all"] = lambda s, d: FS.flagstat_all(aln(s, d))
_PCT_ALL = "CASE WHEN n = 0 THEN 'N/A' ELSE printf('%.2f%%', (n - unmapped) * 100.0::DOUBLE / n) END"
SQL["agg01_flagstat_all"] = SQL["agg01_flagstat"].replace("SELECT *, paired AS total, paired - unmapped AS mapped,", 'SELECT *, "rows" AS total, "rows" - unmapped AS mapped,').replace(_PCT("paired - unmapped") + " AS mapped_pct", _PCT_ALL.replace("n - ", '"rows" - ').replace("/ n)", '/ "rows")').replace("n = 0", '"rows" = 0') + " AS mapped_pct")
QUERIES["agg02_count"] = lambda s, d: aln(s, d).groupBy("_src_id").agg(F.count("*").alias("n"))
SQL["agg02_count"] = "SELECT _src_id, count(*) AS n FROM alignments GROUP BY 1"
QUERIES["agg03_reference_stats"] = lambda s, d: FS.reference_stats(aln(s, d))
_PLACED = "ref_id >= 0 AND coalesce(pos, -1) <> -1"
SQL["agg03_reference_stats"] = f"SELECT _src_id, ref_id, min(_voff_begin) AS begin_voff, max(_voff_end) AS end_voff, count(*) FILTER (WHERE flag & 4 = 0) AS mapped, count(*) FILTER (WHERE flag & 4 <> 0) AS unmapped FROM alignments WHERE {_PLACED} GROUP BY 1, 2"
QUERIES["agg04_unplaced"] = lambda s, d: FS.unplaced_count(aln(s, d))
SQL["agg04_unplaced"] = f"SELECT _src_id, count(*) AS unplaced FROM alignments WHERE NOT coalesce({_PLACED}, FALSE) GROUP BY 1"
QUERIES["agg05_reference_names"] = lambda s, d: table(s, d, "index_stats").groupBy("_src_id").agg(F.count_distinct("ref_id").alias("n_refs"), F.min("ref_id").alias("first_id"), F.max("ref_id").alias("last_id"))
SQL["agg05_reference_names"] = "SELECT _src_id, count(DISTINCT ref_id) AS n_refs, min(ref_id) AS first_id, max(ref_id) AS last_id FROM index_stats GROUP BY 1"

# --- bins and indexes
def _end() -> Column:
    return R.record_end(F.col("flag"), F.col("pos"), F.col("cigar"))


_KEYS = ["_src_id", "ref_id"]


def placed(s: SparkSession, d: str) -> DataFrame:
    a = aln(s, d).where("ref_id >= 0 AND pos >= 0 AND _voff_begin IS NOT NULL AND _voff_end IS NOT NULL")
    return a.select(*_KEYS, F.col("pos").alias("beg"), _end().alias("end"), "_voff_begin", "_voff_end")


def regions(s: SparkSession, d: str) -> DataFrame:
    """A region on every reference of every indexed source, over the middle of the reference."""
    r = table(s, d, "index_stats").where("ref_id IS NOT NULL").select(*_KEYS).distinct()
    beg = (F.col("ref_id").cast("bigint") * 7919 + F.col("_src_id").cast("bigint") * 104729) % 40 * 1_000_000  # past 32 bits from source 20,506 on
    return r.select(F.xxhash64("_src_id", "ref_id").alias("region_id"), *_KEYS, beg.alias("beg"), (beg + 3_000_000).alias("end"))


_P = "p AS (SELECT * FROM ends WHERE ref_id >= 0 AND pos >= 0 AND _voff_begin IS NOT NULL AND _voff_end IS NOT NULL)"
per_row("idx01_bin_for", f"WITH {_OPS} SELECT row_id, CAST({_bin_sql('pos', 'e')} AS BIGINT) AS bin FROM ends", bin=lambda: B.bin_for(F.col("pos"), _end()))
_LEVELS = ((1, 26), (9, 23), (73, 20), (585, 17), (4681, 14))
QUERIES["idx02_overlapping_bins"] = lambda s, d: regions(s, d).select("_src_id", "ref_id", F.explode(B.overlapping_bins(F.col("beg"), F.col("end"))).alias("bin"))
_REGION = "r AS (SELECT DISTINCT _src_id, ref_id, (ref_id::BIGINT * 7919 + _src_id * 104729) % 40 * 1000000 AS b FROM index_stats WHERE ref_id IS NOT NULL)"
_BINS_OF = "list_concat([0::BIGINT], " + ", ".join(f"range({o} + (b >> {s}), {o} + ((b + 2999999) >> {s}) + 1)" for o, s in _LEVELS) + ")"
SQL["idx02_overlapping_bins"] = f"WITH {_REGION} SELECT _src_id, ref_id, unnest({_BINS_OF}) AS bin FROM r"
per_row("idx03_csi_bin_for", f"WITH {_OPS} SELECT row_id, CAST(CASE WHEN (pos >> 12) = ((e - 1) >> 12) THEN 37449 + (pos >> 12) WHEN (pos >> 15) = ((e - 1) >> 15) THEN 4681 + (pos >> 15) WHEN (pos >> 18) = ((e - 1) >> 18) THEN 585 + (pos >> 18) WHEN (pos >> 21) = ((e - 1) >> 21) THEN 73 + (pos >> 21) WHEN (pos >> 24) = ((e - 1) >> 24) THEN 9 + (pos >> 24) WHEN (pos >> 27) = ((e - 1) >> 27) THEN 1 + (pos >> 27) ELSE 0 END AS BIGINT) AS bin FROM ends",
        bin=lambda: B.bin_for(F.col("pos"), _end(), 12, 6))
QUERIES["idx04_csi_sizing"] = lambda s, d: table(s, d, "ref_seqs").select("ref_id", B.minimum_shift_col(F.col("ln").cast("bigint"), 5).alias("shift"), B.minimum_depth_col(F.col("ln").cast("bigint"), 14).alias("depth"))
SQL["idx04_csi_sizing"] = "SELECT ref_id, (SELECT min(s) FROM range(32) t(s) WHERE ln <= (1::BIGINT << (s + 15)::INT) - 2)::INT AS shift, (SELECT min(x) FROM range(15) t(x) WHERE ln <= (1::BIGINT << (14 + 3 * x)::INT) - 2)::INT AS depth FROM ref_seqs WHERE ln IS NOT NULL UNION ALL SELECT ref_id, -1, -1 FROM ref_seqs WHERE ln IS NULL"
per_row("idx05_valid_pos", "SELECT row_id, pos BETWEEN -1 AND 536870910 AS ok FROM alignments", ok=lambda: B.is_valid_index_pos(F.col("pos")))


def _bai(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = placed(s, d)
    return X.build_bins(p, _KEYS, F.col("beg"), F.col("end")), X.build_linear(p, _KEYS, F.col("beg"), F.col("end"))


def _build_sql(bin_sql: str) -> str:
    return f"""WITH {_OPS}, {_P}, c AS (SELECT DISTINCT _src_id, ref_id, CAST({bin_sql} AS BIGINT) AS bin, _voff_begin AS b, _voff_end AS e2, count(*) OVER (PARTITION BY _src_id, ref_id, {bin_sql}, _voff_begin, _voff_end) AS n FROM p),
    x AS (SELECT *, max(e2) OVER (PARTITION BY _src_id, ref_id, bin ORDER BY b, e2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM c),
    y AS (SELECT *, sum(CASE WHEN r IS NULL OR r <= b THEN 1 ELSE 0 END) OVER (PARTITION BY _src_id, ref_id, bin ORDER BY b, e2 ROWS UNBOUNDED PRECEDING) AS i FROM x),
    z AS (SELECT _src_id, ref_id, bin, min(b) AS chunk_begin, max(e2) AS chunk_end, sum(n) AS n FROM y GROUP BY _src_id, ref_id, bin, i),
    bins AS (SELECT _src_id, ref_id, bin, chunk_begin, chunk_end, min(chunk_begin) OVER (PARTITION BY _src_id, ref_id, bin) AS left_voff, CAST(sum(n) OVER (PARTITION BY _src_id, ref_id, bin) AS BIGINT) AS records FROM z)"""


QUERIES["idx06_bai_bins"] = lambda s, d: _bai(s, d)[0]
SQL["idx06_bai_bins"] = _build_sql(_bin_sql("pos", "e")) + " SELECT * FROM bins"
_TILES = "tiles AS (SELECT _src_id, ref_id, t AS tile, min(_voff_begin) AS voff FROM (SELECT *, unnest(range(pos >> 14, (greatest(pos, e - 1) >> 14) + 1)) AS t FROM p) GROUP BY 1, 2, 3)"
QUERIES["idx06_bai_linear"] = lambda s, d: _bai(s, d)[1]
SQL["idx06_bai_linear"] = f"WITH {_OPS}, {_P}, {_TILES} SELECT * FROM tiles"
QUERIES["idx07_csi_build"] = lambda s, d: X.build_bins(placed(s, d), _KEYS, F.col("beg"), F.col("end"), 13, 5)
SQL["idx07_csi_build"] = _build_sql("CASE " + " ".join(f"WHEN (pos >> {sh}) = ((e - 1) >> {sh}) THEN {o} + (pos >> {sh})" for sh, o in ((13, 4681), (16, 585), (19, 73), (22, 9), (25, 1))) + " ELSE 0 END") + " SELECT * FROM bins"


@query("idx08_tabix_names", "WITH f AS (SELECT _src_id, rname, min(_src_ord) AS o FROM alignments WHERE rname IS NOT NULL AND pos >= 0 GROUP BY 1, 2) SELECT _src_id, rname, (row_number() OVER (PARTITION BY _src_id ORDER BY o, rname) - 1)::INT AS id FROM f")
def idx08(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    first = aln(s, d).where("rname IS NOT NULL AND pos >= 0").groupBy("_src_id", "rname").agg(F.min("_src_ord").alias("o"))
    return first.select("_src_id", "rname", (F.row_number().over(Window.partitionBy("_src_id").orderBy("o", "rname")) - 1).cast("int").alias("id"))


def _merge_sql(cond: str, keys: str, src: str) -> str:
    return f"""u AS (SELECT DISTINCT {keys}, chunk_begin AS b, chunk_end AS e2 FROM {src}),
    v AS (SELECT *, max(e2) OVER (PARTITION BY {keys} ORDER BY b, e2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM u),
    w AS (SELECT *, sum(CASE WHEN r IS NULL OR {cond} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY b, e2 ROWS UNBOUNDED PRECEDING) AS i FROM v)
    SELECT {keys}, min(b) AS chunk_begin, max(e2) AS chunk_end FROM w GROUP BY {keys}, i"""


_CAND = f", {_REGION}, cand AS (SELECT _src_id, ref_id, b AS rb, unnest({_BINS_OF}) AS bin FROM r)"
QUERIES["idx09_bai_lookup"] = lambda s, d: X.lookup(regions(s, d), *_bai(s, d), _KEYS).select(*_KEYS, "chunk_begin", "chunk_end")
SQL["idx09_bai_lookup"] = _build_sql(_bin_sql("pos", "e")) + f""", {_TILES} {_CAND}, fl AS (SELECT r._src_id, r.ref_id, min(voff) AS fl FROM r JOIN tiles t ON r._src_id = t._src_id AND r.ref_id = t.ref_id AND t.tile BETWEEN (r.b >> 14) AND ((r.b + 2999999) >> 14) GROUP BY 1, 2),
    hit AS (SELECT c._src_id, c.ref_id, x.chunk_begin, x.chunk_end FROM cand c JOIN bins x ON c._src_id = x._src_id AND c.ref_id = x.ref_id AND c.bin = x.bin JOIN fl ON fl._src_id = c._src_id AND fl.ref_id = c.ref_id WHERE x.chunk_end > fl.fl), """ + _merge_sql("r < b", "_src_id, ref_id", "hit")
QUERIES["idx10_csi_lookup"] = lambda s, d: X.lookup(regions(s, d), _bai(s, d)[0], None, _KEYS).select(*_KEYS, "chunk_begin", "chunk_end")
SQL["idx10_csi_lookup"] = _build_sql(_bin_sql("pos", "e")) + f"{_CAND}, hit AS (SELECT c._src_id, c.ref_id, x.chunk_begin, x.chunk_end FROM cand c JOIN bins x ON c._src_id = x._src_id AND c.ref_id = x.ref_id AND c.bin = x.bin WHERE x.chunk_end > x.left_voff), " + _merge_sql("r < b", "_src_id, ref_id", "hit")


def _by_name(s: SparkSession, d: str) -> DataFrame:
    names = aln(s, d).where("ref_id IS NOT NULL AND rname IS NOT NULL").groupBy(*_KEYS).agg(F.min("rname").alias("rname"))
    bins, linear = (x.join(names, _KEYS).drop("ref_id") for x in _bai(s, d))
    linear = linear.groupBy("_src_id", "rname", "tile").agg(F.min("voff").alias("voff"))
    wanted = regions(s, d).join(names, _KEYS).drop("ref_id")
    return X.lookup(wanted, bins, linear, ["_src_id", "rname"]).select("_src_id", "rname", "chunk_begin", "chunk_end")


QUERIES["idx11_tabix_lookup"] = _by_name
_NAMES = "nm AS (SELECT _src_id, ref_id, min(rname) AS rname FROM alignments WHERE ref_id IS NOT NULL AND rname IS NOT NULL GROUP BY 1, 2)"
SQL["idx11_tabix_lookup"] = _build_sql(_bin_sql("pos", "e")) + f"""{_CAND}, {_NAMES}, nb AS (SELECT rname, x.* FROM bins x JOIN nm USING (_src_id, ref_id)), nc AS (SELECT rname, ref_id AS rid, c._src_id, c.bin FROM cand c JOIN nm USING (_src_id, ref_id)), {_TILES}, nt AS (SELECT t._src_id, rname, tile, min(voff) AS voff FROM tiles t JOIN nm USING (_src_id, ref_id) GROUP BY 1, 2, 3),
    fl AS (SELECT r._src_id, r.ref_id AS rid, min(voff) AS fl FROM r JOIN nm USING (_src_id, ref_id) JOIN nt ON nt._src_id = r._src_id AND nt.rname = nm.rname AND nt.tile BETWEEN (r.b >> 14) AND ((r.b + 2999999) >> 14) GROUP BY 1, 2),
    hit AS (SELECT c._src_id, c.rname, c.rid, x.chunk_begin, x.chunk_end FROM nc c JOIN nb x ON c._src_id = x._src_id AND c.rname = x.rname AND c.bin = x.bin JOIN fl ON fl._src_id = c._src_id AND fl.rid = c.rid WHERE x.chunk_end > fl.fl), res AS (""" + "WITH " + _merge_sql("r < b", "_src_id, rname, rid", "hit") + ") SELECT _src_id, rname, chunk_begin, chunk_end FROM res"
QUERIES["idx12_compact"] = lambda s, d: X.compressor(1 << 16)(_bai(s, d)[0], [*_KEYS, "bin"])
SQL["idx12_compact"] = _build_sql(_bin_sql("pos", "e")) + ", " + _merge_sql("(r >> 16) + 65536 < (b >> 16)", "_src_id, ref_id, bin", "bins")
_CH = "ch AS (SELECT _src_id, begin_voff AS chunk_begin, end_voff AS chunk_end FROM index_stats WHERE begin_voff IS NOT NULL AND end_voff IS NOT NULL)"
_chunks = lambda s, d: table(s, d, "index_stats").where("begin_voff IS NOT NULL AND end_voff IS NOT NULL").select("_src_id", F.col("begin_voff").alias("chunk_begin"), F.col("end_voff").alias("chunk_end"))
QUERIES["str01_identity"] = lambda s, d: X.identity(_chunks(s, d), ["_src_id"])
SQL["str01_identity"] = f"WITH {_CH} SELECT * FROM ch"
QUERIES["str02_adjacent"] = lambda s, d: X.adjacent(_chunks(s, d), ["_src_id"])
SQL["str02_adjacent"] = f"WITH {_CH}, " + _merge_sql("r < b", "_src_id", "ch")
QUERIES["str03_squash"] = lambda s, d: X.squash(_chunks(s, d), ["_src_id"])
SQL["str03_squash"] = f"WITH {_CH} SELECT _src_id, min(chunk_begin) AS chunk_begin, max(chunk_end) AS chunk_end FROM ch GROUP BY 1"
QUERIES["str04_compressor"] = lambda s, d: X.compressor(1)(_chunks(s, d), ["_src_id"])
SQL["str04_compressor"] = f"WITH {_CH}, " + _merge_sql("(r >> 16) + 1 < (b >> 16)", "_src_id", "ch")
per_row("off01_voffset", "SELECT row_id, _voff_begin >> 16 AS file, _voff_begin & 65535 AS block, _voff_begin AS packed FROM alignments", file=lambda: B.voffset_file(F.col("_voff_begin")), block=lambda: B.voffset_block(F.col("_voff_begin")), packed=lambda: B.voffset(B.voffset_file(F.col("_voff_begin")), B.voffset_block(F.col("_voff_begin"))))


def _overlaps(width: int | None):
    def run(s: SparkSession, d: str) -> DataFrame:
        a = aln(s, d).where("ref_id IS NOT NULL AND pos >= 0").select("row_id", *_KEYS, F.col("pos").alias("beg"), _end().alias("end")).where("end > beg")
        r = regions(s, d).select(*_KEYS, F.col("beg").alias("rbeg"), F.col("end").alias("rend"))
        return X.interval_join(a, r, _KEYS, width).groupBy(*_KEYS).agg(F.count("*").alias("n"), F.sum(F.least("end", "rend") - F.greatest("beg", "rbeg")).alias("bases"))

    return run


_OVER = f"WITH {_OPS}, {_REGION} SELECT a._src_id, a.ref_id, count(*) AS n, sum(least(a.e, r.b + 3000000) - greatest(a.pos, r.b))::BIGINT AS bases FROM ends a JOIN r ON a._src_id = r._src_id AND a.ref_id = r.ref_id WHERE a.pos >= 0 AND a.e > a.pos AND a.pos < r.b + 3000000 AND r.b < a.e GROUP BY 1, 2"
QUERIES["ivl01_interval_join"], SQL["ivl01_interval_join"] = _overlaps(None), _OVER
QUERIES["ivl02_interval_join_tiles"], SQL["ivl02_interval_join_tiles"] = _overlaps(1 << 20), _OVER
QUERIES["ord01_violations"] = lambda s, d: M.order_violations(aln(s, d))
SQL["ord01_violations"] = "SELECT _src_id, _src_ord, ref_id, pos FROM (SELECT *, max(ref_id::BIGINT * 4294967296 + pos) OVER (PARTITION BY _src_id ORDER BY _src_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM (SELECT * FROM alignments WHERE ref_id IS NOT NULL AND pos >= 0)) WHERE m > ref_id::BIGINT * 4294967296 + pos"

# --- integers and offsets of the other formats
_U = "(tlen::BIGINT & 4294967295)"
per_row(
    "enc01_itf8",
    f"""SELECT row_id, tlen, CASE WHEN {_U} < 128 THEN lpad(to_hex({_U}), 2, '0') WHEN {_U} < 16384 THEN to_hex({_U} | 32768) WHEN {_U} < 2097152 THEN to_hex({_U} | 12582912)
    WHEN {_U} < 268435456 THEN to_hex({_U} | 3758096384) ELSE to_hex(240 | ({_U} >> 28)) || lpad(to_hex(({_U} >> 4) & 16777215), 6, '0') || lpad(to_hex({_U} & 15), 2, '0') END AS bytes FROM alignments""",
    tlen=lambda: codecs.itf8_decode(codecs.itf8_encode(F.col("tlen"))), bytes=lambda: F.hex(codecs.itf8_encode(F.col("tlen"))),
)
_LTF8 = lambda v: "CASE " + " ".join(f"WHEN {v} >= 0 AND {v} < {1 << 7 * n} THEN lpad(to_hex({v} | {((0xFF << (9 - n)) & 0xFF) << 8 * (n - 1)}), {2 * n}, '0')" for n in range(1, 8)) + f" WHEN {v} >= 0 AND {v} < {1 << 56} THEN 'FE' || lpad(to_hex({v}), 14, '0') WHEN {v} IS NOT NULL THEN 'FF' || lpad(to_hex({v}), 16, '0') END"
per_row(
    "enc02_ltf8", f"SELECT row_id, _voff_begin AS v, pos AS p, {_LTF8('_voff_begin')} AS v_bytes, {_LTF8('pos')} AS p_bytes, {_LTF8('(_voff_begin * 6151)')} AS w_bytes FROM alignments",
    v=lambda: codecs.ltf8_decode(codecs.ltf8_encode(F.col("_voff_begin"))), p=lambda: codecs.ltf8_decode(codecs.ltf8_encode(F.col("pos"))),
    v_bytes=lambda: F.hex(codecs.ltf8_encode(F.col("_voff_begin"))), p_bytes=lambda: F.hex(codecs.ltf8_encode(F.col("pos"))), w_bytes=lambda: F.hex(codecs.ltf8_encode(F.col("_voff_begin") * 6151)),
)
QUERIES["fai01_offset"] = lambda s, d: aln(s, d).where("pos >= 0").select("row_id", byte_offset(F.col("pos"), 12, 70, 71).alias("offset"), byte_offset(F.col("pos") + (1 << 60), 12, 70, 71).alias("far"))
SQL["fai01_offset"] = f"SELECT row_id, 12 + pos // 70 * 71 + pos % 70 AS \"offset\", 12 + (pos + {1 << 60}) // 70 * 71 + (pos + {1 << 60}) % 70 AS far FROM alignments WHERE pos >= 0"

# --- headers
QUERIES["hdr06_other_tags"] = lambda s, d: table(s, d, "read_groups").select("row_id", F.explode("other_tags").alias("tag", "value"))
SQL["hdr06_other_tags"] = "SELECT row_id, e.key AS tag, e.value AS value FROM (SELECT row_id, unnest(map_entries(other_tags)) AS e FROM read_groups)"
QUERIES["hdr06_set_get"] = lambda s, d: H.set_tag(H.set_tag(H.set_tag(table(s, d, "read_groups"), "RG", "LB", F.concat(F.lit("L"), F.col("id"))), "RG", "XY", F.col("center")), "RG", "DS", F.when(F.col("row_id") % 2 == 0, F.lit(""))).select(
    "row_id", *[H.get_tag("RG", t).alias(t.lower()) for t in ("LB", "XY", "DS", "ID", "PI")], F.size("other_tags").alias("n_other")
)
SQL["hdr06_set_get"] = """SELECT row_id, coalesce('L' || id, library) AS lb, CASE WHEN center IS NULL THEN other_tags['XY'] ELSE nullif(center, '') END AS xy, CASE WHEN row_id % 2 <> 0 THEN description END AS ds, id, insert_size::VARCHAR AS pi,
  CASE WHEN center IS NULL THEN cardinality(other_tags) ELSE len(list_filter(coalesce(map_keys(other_tags), []), lambda k: k <> 'XY')) + CASE WHEN center <> '' THEN 1 ELSE 0 END END::INT AS n_other FROM read_groups"""
QUERIES["hdr07_order_names"] = lambda s, d: aln(s, d).groupBy(H.order_name(F.col("flag") % 6, H.SORT_ORDERS).alias("name")).agg(F.count("*").alias("n"))
SQL["hdr07_order_names"] = "SELECT CASE flag % 6 WHEN 1 THEN 'unsorted' WHEN 2 THEN 'queryname' WHEN 3 THEN 'coordinate' ELSE 'unknown' END AS name, count(*) AS n FROM alignments GROUP BY 1"
@query("hdr11_accessors", """WITH r AS (SELECT DISTINCT ON (ref_id) * FROM ref_seqs ORDER BY ref_id)
SELECT row_id, coalesce(r.sn, '*') AS name, coalesce(r.ref_id, -1) AS id, coalesce(r.ln, -1) AS len, coalesce(lower(hex(r.md5)), '') AS md5, coalesce(r.assembly, '') AS assembly, coalesce(r.species, '') AS species, coalesce(r.uri, '') AS uri
FROM alignments a LEFT JOIN r USING (ref_id)""")
def hdr11(s: SparkSession, d: str) -> DataFrame:
    """Reference fields of every record, of the nil reference where it has none."""
    refs = table(s, d, "ref_seqs").dropDuplicates(["ref_id"])
    return aln(s, d).select("row_id", "ref_id").join(refs.select("ref_id", F.struct(*refs.columns).alias("r")), "ref_id", "left").select("row_id", *[c.alias(k) for k, c in H.reference_fields("r").items()])


@query("hdr08_new_references", """WITH p AS (SELECT ref_id, sn, ln, md5, CASE WHEN coalesce(sn, '') = '' THEN 'no name' WHEN NOT coalesce(ln BETWEEN 1 AND 2147483647, FALSE) THEN 'length out of range' WHEN octet_length(md5) <> 16 THEN 'bad md5' END AS problem FROM ref_seqs)
SELECT CASE WHEN problem IS NULL THEN (row_number() OVER (PARTITION BY problem IS NULL ORDER BY ref_id) - 1)::INT END AS new_id, ref_id, problem FROM p""")
def hdr08(s: SparkSession, d: str) -> DataFrame:
    """Valid rows as a new dictionary, the others with their problem."""
    r = table(s, d, "ref_seqs").withColumn("problem", H.row_problem("SQ"))
    good, bad = r.where("problem IS NULL"), r.where("problem IS NOT NULL")
    new = H.new_rows(good.select("sn", "ln", "md5", F.col("ref_id").cast("string").alias("assembly"), F.col("ref_id").alias("place")), "SQ", "place")
    return new.select(F.col("ref_id").alias("new_id"), F.col("assembly").cast("int").alias("ref_id"), F.lit(None).cast("string").alias("problem")).unionByName(bad.select(F.lit(None).cast("int").alias("new_id"), "ref_id", "problem"))


@query("hdr09_remove", "SELECT sn, (row_number() OVER (ORDER BY ref_id) - 1)::INT AS ref_id FROM ref_seqs WHERE sn NOT IN ('qtg000', 'qtg010')")
def hdr09(s: SparkSession, d: str) -> DataFrame:
    return H.remove_rows(table(s, d, "ref_seqs"), ["qtg000", "qtg010"], "ref_id", "sn").select("sn", "ref_id")


@query("hdr10_rename", "SELECT ref_id, CASE WHEN sn = 'qtg000' THEN 'renamed' ELSE sn END AS sn FROM ref_seqs")
def hdr10(s: SparkSession, d: str) -> DataFrame:
    return H.rename_row(table(s, d, "ref_seqs"), "qtg000", "renamed", "sn").select("ref_id", "sn")


@query("hdr12_equal_references", """SELECT a.ref_id, a.sn = b.sn AND a.ln = b.ln AND (a.md5 IS NULL OR b.md5 IS NULL OR a.md5 = b.md5) AND (a.assembly IS NULL OR b.assembly IS NULL OR a.assembly = b.assembly)
  AND (a.species IS NULL OR b.species IS NULL OR a.species = b.species) AND (a.uri IS NULL OR b.uri IS NULL OR a.uri = b.uri) AND list_sort(coalesce(map_entries(a.other_tags), [])) = list_sort(coalesce(map_entries(b.other_tags), [])) AS same
  FROM ref_seqs a JOIN ref_seqs b ON b.ref_id = a.ref_id - a.ref_id % 2""")
def hdr12(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "ref_seqs")
    a = r.select("ref_id", (F.col("ref_id") - F.col("ref_id") % 2).alias("k"), F.struct(*r.columns).alias("a"))
    b = r.select(F.col("ref_id").alias("k"), F.struct(*r.columns).alias("b"))
    return a.join(b, "k").select("ref_id", H.equal_references("a", "b").alias("same"))


_REFS2 = """r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sn ORDER BY ref_id) AS i FROM ref_seqs WHERE sn IS NOT NULL AND ln > 0) WHERE i = 1),
b AS (SELECT sn, ln, CASE WHEN ref_id % 3 = 0 THEN NULL ELSE md5 END AS md5, CASE WHEN ref_id % 5 = 0 THEN 'other' ELSE assembly END AS assembly, species, uri FROM r),
m AS (SELECT r.ref_id, sn, r.ln, coalesce(b.md5, r.md5) AS md5, coalesce(b.assembly, r.assembly) AS assembly, coalesce(b.species, r.species) AS species, coalesce(b.uri, r.uri) AS uri,
      coalesce(r.md5 <> b.md5, FALSE) OR coalesce(r.assembly <> b.assembly, FALSE) OR coalesce(cardinality(r.other_tags), 0) > 0 AS replaced, r.md5 AS m0, r.assembly AS a0, r.species AS s0, r.uri AS u0 FROM r JOIN b USING (sn))"""


def _two_versions(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The reference dictionary, and a second version of it without some checksums and tags and with some assemblies changed."""
    refs = table(s, d, "ref_seqs").where("sn IS NOT NULL AND ln > 0")
    columns = ["ref_id", "ln", "md5", "assembly", "species", "uri", "other_tags"]
    r = refs.groupBy("sn").agg(F.min_by(F.struct(*columns), "ref_id").alias("x")).select("sn", "x.*")
    b = r.withColumns({"md5": F.when(F.col("ref_id") % 3 != 0, F.col("md5")), "assembly": F.when(F.col("ref_id") % 5 == 0, "other").otherwise(F.col("assembly")), "other_tags": F.lit(None).cast("MAP<STRING, STRING>")})
    return r, b


@query("hdr13_merged_references", f"""WITH {_REFS2} SELECT (row_number() OVER (ORDER BY ref_id) - 1)::INT AS new_id, sn, ln, hex(CASE WHEN replaced THEN md5 ELSE m0 END) AS md5, CASE WHEN replaced THEN assembly ELSE a0 END AS assembly,
  CASE WHEN replaced THEN species ELSE s0 END AS species, CASE WHEN replaced THEN uri ELSE u0 END AS uri, 0 AS n_other FROM m""")
def hdr13_merged(s: SparkSession, d: str) -> DataFrame:
    """The dictionaries of two sources that tell different things of the same references."""
    a, b = _two_versions(s, d)
    none = s.createDataFrame([], "_src_id INT")
    merged = H.merge_headers(a.withColumn("_src_id", F.lit(1)).unionByName(b.withColumn("_src_id", F.lit(2))), none, none)[0]
    return merged.select("new_id", "sn", "ln", F.hex("md5").alias("md5"), "assembly", "species", "uri", F.coalesce(F.size("other_tags"), F.lit(0)).alias("n_other"))


@query("hdr09_add_checked", f"""WITH {_REFS2} SELECT (row_number() OVER (ORDER BY ref_id) - 1)::INT AS ref_id, sn, ln, CASE WHEN replaced THEN assembly ELSE a0 END AS assembly FROM m
  UNION ALL SELECT ((SELECT count(*) FROM m) + row_number() OVER (ORDER BY ref_id) - 1)::INT, 'new_' || sn, ln, NULL FROM m WHERE ref_id % 7 = 0""")
def hdr09_add(s: SparkSession, d: str) -> DataFrame:
    a, b = _two_versions(s, d)
    fresh = b.where("ref_id % 7 = 0").withColumns({"sn": F.concat(F.lit("new_"), F.col("sn")), "assembly": F.lit(None).cast("string"), "ref_id": F.col("ref_id") + 1_000_000})
    return H.add_references(a, b.unionByName(fresh).withColumnRenamed("ref_id", "ord")).select("ref_id", "sn", "ln", "assembly")


@query("hdr09_add_groups", """WITH u AS (SELECT uid, min(row_id) AS r FROM programs WHERE uid IS NOT NULL GROUP BY 1), t AS (SELECT uid, (row_number() OVER (ORDER BY uid) - 1)::INT AS pg_id FROM u WHERE r % 2 = 0)
  SELECT uid, pg_id FROM t UNION ALL SELECT uid, ((SELECT count(*) FROM t) + row_number() OVER (ORDER BY uid) - 1)::INT FROM u WHERE r % 2 <> 0""")
def hdr09_groups(s: SparkSession, d: str) -> DataFrame:
    """Program names of all sources: half as a dictionary, all others added to it."""
    u = table(s, d, "programs").where("uid IS NOT NULL").groupBy("uid").agg(F.min("row_id").alias("r"))
    known = H.new_rows(u.where("r % 2 = 0").select("uid", F.col("uid").alias("place")), "PG", "place").select("pg_id", "uid")
    return H.add_rows(known, u.where("r % 2 <> 0").select(F.lit(0).alias("pg_id"), "uid"), "pg_id", "uid", strict=True).select("uid", "pg_id")


@query("hdr10_set_length", "SELECT ref_id, CASE WHEN sn = 'qtg000' THEN 77 ELSE ln END AS ln FROM ref_seqs")
def hdr10_length(s: SparkSession, d: str) -> DataFrame:
    return H.set_length(table(s, d, "ref_seqs"), "qtg000", 77).select("ref_id", "ln")


def _parsed(kind: str, name: str, table_: str, columns: list[str]):
    def run(s: SparkSession, d: str) -> DataFrame:
        """One row a source and name as header lines, one text a source, parsed again."""
        t = table(s, d, table_).where(f"coalesce({name}, '') <> ''")
        one = t.groupBy("_src_id", name).agg(F.min_by(F.struct(*[c for c in t.columns if c not in ("_src_id", name)]), "row_id").alias("x")).select("_src_id", name, "x.*")
        lines = one.select("_src_id", name, H.line_expression(kind).alias("line"))
        texts = lines.groupBy("_src_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(name, "line"))), lambda x: x["line"]), "\n").alias("text"))  # a header a file
        return H.parse_headers(texts, kind).select("_src_id", *columns, F.coalesce(F.size("other_tags"), F.lit(0)).alias("n_other"))

    return run


_RG_COLUMNS = ["rg_id", "id", "center", "description", "date", "flow_order", "key_seq", "library", "program", "insert_size", "platform", "platform_unit", "sample"]
_PG_COLUMNS = ["pg_id", "uid", "name", "command", "previous", "version"]
for _q, _k, _n, _t, _c in (("hdr03_read_groups", "RG", "id", "read_groups", _RG_COLUMNS), ("hdr04_programs", "PG", "uid", "programs", _PG_COLUMNS)):
    QUERIES[_q] = _parsed(_k, _n, _t, _c)
    _values = ", ".join(c if c in (_n, "insert_size") else f"nullif({c}, '') AS {c}" for c in _c[1:])
    SQL[_q] = f"SELECT _src_id, (row_number() OVER (PARTITION BY _src_id ORDER BY {_n}) - 1)::INT AS {_c[0]}, {_values}, coalesce(cardinality(other_tags), 0)::INT AS n_other FROM (SELECT *, row_number() OVER (PARTITION BY _src_id, {_n} ORDER BY row_id) AS i FROM {_t} WHERE {_n} <> '') WHERE i = 1"

QUERIES["hdr13_merge"] = lambda s, d: _links(s, d)[1]
SQL["hdr13_merge"] = f"WITH {_LINKS} SELECT * FROM links"


@query("hdr14_validate", f"""WITH a AS (SELECT row_id, _src_id, {_TAG.format('PG')}.sval AS pg, {_TAG.format('RG')}.sval AS rg, {_TAG.format('LB')}.sval AS lb, {_TAG.format('PU')}.sval AS pu FROM alignments),
  g AS (SELECT _src_id, id, min(library) AS lib, min(platform_unit) AS unit FROM read_groups GROUP BY 1, 2), p AS (SELECT DISTINCT _src_id, uid FROM programs)
  SELECT row_id, problem FROM (SELECT row_id, CASE WHEN a._src_id IN (SELECT _src_id FROM p) AND p.uid IS NULL THEN 'program not found' WHEN a._src_id IN (SELECT _src_id FROM g) AND g.id IS NULL THEN 'read group not found'
  WHEN pu <> unit THEN 'platform unit differs' WHEN lb <> lib THEN 'library differs' END AS problem FROM a LEFT JOIN p ON a._src_id = p._src_id AND pg = p.uid LEFT JOIN g ON a._src_id = g._src_id AND rg = g.id) WHERE problem IS NOT NULL""")
def hdr14(s: SparkSession, d: str) -> DataFrame:
    return H.validate_records(aln(s, d), table(s, d, "read_groups"), table(s, d, "programs"))


QUERIES["hdr15_program_lines"] = lambda s, d: table(s, d, "programs").select("row_id", H.line_expression("PG").alias("line"))
SQL["hdr15_program_lines"] = """SELECT row_id, concat_ws(chr(9), '@PG', CASE WHEN uid <> '' THEN 'ID:' || uid END, CASE WHEN name <> '' THEN 'PN:' || name END, CASE WHEN command <> '' THEN 'CL:' || command END,
  CASE WHEN previous <> '' THEN 'PP:' || previous END, CASE WHEN version <> '' THEN 'VN:' || version END,
  CASE WHEN cardinality(other_tags) > 0 THEN array_to_string(list_transform(list_sort(map_entries(other_tags)), lambda e: e.key || ':' || e.value), chr(9)) END) AS line FROM programs"""


_LINE = lambda tag, col: f"CASE WHEN {col}::VARCHAR <> '' THEN '{tag}:' || {col}::VARCHAR END"
_OTHER = "CASE WHEN cardinality(other_tags) > 0 THEN array_to_string(list_transform(list_sort(map_entries(other_tags)), lambda e: e.key || ':' || e.value), chr(9)) END"
QUERIES["hdr15_reference_lines"] = lambda s, d: table(s, d, "ref_seqs").select("ref_id", H.line_expression("SQ").alias("line"))
SQL["hdr15_reference_lines"] = f"SELECT ref_id, concat_ws(chr(9), '@SQ', {', '.join(_LINE(t, 'lower(hex(md5))' if c == 'md5' else c) for t, c in H.TAGS['SQ'].items())}, {_OTHER}) AS line FROM ref_seqs"
QUERIES["hdr15_group_lines"] = lambda s, d: table(s, d, "read_groups").select("row_id", H.line_expression("RG").alias("line"))
SQL["hdr15_group_lines"] = f"SELECT row_id, concat_ws(chr(9), '@RG', {', '.join(_LINE(t, c) for t, c in H.TAGS['RG'].items())}, {_OTHER}) AS line FROM read_groups"
LINE_SQL = {k: SQL[q].split("SELECT ", 1)[1].split(", ", 1)[1].rsplit(" FROM ", 1)[0] for k, q in (("SQ", "hdr15_reference_lines"), ("RG", "hdr15_group_lines"), ("PG", "hdr15_program_lines"))}
QUERIES["hdr05_iso_dates"] = lambda s, d: iso_dates(table(s, d, "read_groups"), "date", ["row_id"])
SQL["hdr05_iso_dates"] = """WITH m AS (SELECT row_id, date, regexp_extract_all(date, '[0-9]{2}') AS n, regexp_full_match(date, '[0-9]{4}-[0-9]{2}-[0-9]{2}(T[0-9]{2}:?[0-9]{2}(:?[0-9]{2}([.][0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?') AS ok FROM read_groups),
p AS (SELECT row_id, ok, substr(date, 1, 10) AS d, replace(regexp_extract(date, 'T([0-9:]*)', 1), ':', '') AS t, replace(regexp_extract(date, 'T.*([+-][0-9]{2}:?[0-9]{2})$', 1), ':', '') AS z FROM m),
x AS (SELECT row_id, CASE WHEN ok AND coalesce(try_cast(substr(z, 2, 2) AS INT), 0) * 60 + coalesce(try_cast(substr(z, 4, 2) AS INT), 0) <= 840 AND coalesce(try_cast(substr(z, 4, 2) AS INT), 0) < 60 THEN try_cast(d || ' ' || CASE WHEN t = '' THEN '00:00:00' ELSE substr(t, 1, 2) || ':' || substr(t, 3, 2) || ':' || CASE WHEN length(t) >= 6 THEN substr(t, 5, 2) ELSE '00' END END AS TIMESTAMP) END AS ts, z FROM p)
SELECT row_id, strftime(ts - CASE WHEN z = '' OR z IS NULL THEN INTERVAL 0 MINUTE ELSE to_minutes((substr(z, 1, 1) || '1')::INT * (substr(z, 2, 2)::INT * 60 + substr(z, 4, 2)::INT)) END, '%Y-%m-%dT%H:%M:%S') || '+0000' AS iso FROM x"""
