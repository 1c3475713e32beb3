"""Queries p1 to p6 over the alignment tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions.cigar import lengths
from readloom.functions.records import record_end
from readloom.operators.instants import ABBREVIATIONS, normalise_instants, utc_text
from readloom.operators.intervals import merge_intervals
from readloom.operators.orphans import find_orphans
from readloom.operators.percentiles import RELATIVE_ERROR, combine_values, exact_percentiles, log_bucket, summary_percentiles
from readloom.operators.rejects import INT_RANGES, reject_lines
from readloom.operators.skew import aggregate_per_key, dominant_keys, skew_join
from readloom.session import broadcast_if_small, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "alignments").where("ref_id IS NOT NULL AND pos >= 0")
    spans = a.select(F.col("_src_id").alias("src_id"), "ref_id", F.col("pos").alias("b"), record_end(F.col("flag"), F.col("pos"), F.col("cigar")).alias("e"))
    return merge_intervals(spans, ["src_id", "ref_id"], "b", "e")


P1_SQL = """
WITH r AS (SELECT row_id, _src_id AS src_id, ref_id, pos, CASE WHEN coalesce(flag, 0) & 4 <> 0 THEN [] ELSE coalesce(cigar, []) END AS c
           FROM alignments WHERE ref_id IS NOT NULL AND pos >= 0),
o AS (SELECT row_id, unnest(c) AS op, unnest(range(1, len(c) + 1)) AS i FROM r),
s AS (SELECT row_id, sum(coalesce(op.len, 0) * CASE WHEN op.op IN ('M','D','N','=','X') THEN 1 WHEN op.op = 'B' THEN -1 ELSE 0 END) OVER (PARTITION BY row_id ORDER BY i) AS d FROM o),
m AS (SELECT row_id, max(d) AS d FROM s GROUP BY row_id),
v AS (SELECT DISTINCT src_id, ref_id, pos AS b, CAST(CASE WHEN len(c) = 0 THEN pos + 1 ELSE pos + greatest(coalesce(d, 0), 0) END AS BIGINT) AS e FROM r LEFT JOIN m USING (row_id)),
w AS (SELECT *, max(e) OVER (PARTITION BY src_id, ref_id ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM v WHERE e > b),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR b > p THEN 1 ELSE 0 END) OVER (PARTITION BY src_id, ref_id ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS k FROM w),
t AS (SELECT src_id, ref_id, k, min(b) AS b, max(e) AS e FROM g GROUP BY ALL)
SELECT src_id, ref_id, 'period' AS kind, b AS beg_pos, e AS end_pos FROM t
UNION ALL
SELECT src_id, ref_id, 'gap', e, nb FROM (SELECT *, lead(b) OVER (PARTITION BY src_id, ref_id ORDER BY b) AS nb FROM t) WHERE nb IS NOT NULL
"""


def _number(x: str, top: int) -> str:
    return f"(regexp_full_match({x}, '[0-9]+') AND length(ltrim({x}, '0')) <= 10 AND coalesce(try_cast(nullif(ltrim({x}, '0'), '') AS BIGINT), 0) <= {top})"


def _whole(x: str, low: int, high: int) -> str:
    bare = f"ltrim(ltrim({x}, '+-'), '0')"
    sign = f"(CASE WHEN starts_with({x}, '-') THEN -1 ELSE 1 END)"
    return f"(regexp_full_match({x}, '[+-]?[0-9]+') AND length({bare}) <= 18 AND coalesce(try_cast(nullif({bare}, '') AS BIGINT), 0) * {sign} BETWEEN {low} AND {high})"


_FLOAT_SQL = "[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?"
_B_SQL = " ".join(f"WHEN '{k}' THEN {_whole('v', *r)}" for k, r in INT_RANGES.items())
#: (line_id, u, reason) of every line: the statement of the problem in SQL.
P2_CTE = f"""
l AS (SELECT line_id, coalesce(string_split(CASE WHEN ends_with(line, chr(13)) THEN left(line, -1) ELSE line END, chr(9)), []) AS f FROM sam_lines),
q AS (SELECT line_id, f, coalesce(list_bool_or(list_transform(f, lambda x, i: i <> 11 AND starts_with(x, '"') AND (length(x) < 2 OR NOT ends_with(x, '"') OR contains(replace(substr(x, 2, length(x) - 2), '""', ''), '"')))), FALSE) AS bad,
             list_transform(f, lambda x, i: CASE WHEN i <> 11 AND starts_with(x, '"') THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END) AS u FROM l),
n AS (SELECT line_id, u[6] AS c, u[10] AS s FROM q WHERE len(f) >= 11 AND regexp_full_match(u[6], '([0-9]{{1,13}}[MIDNSHP=XB])+') AND u[10] <> '*'),
o AS (SELECT line_id, s, unnest(regexp_extract_all(c, '([0-9]+)([MIDNSHP=XB])', 1))::BIGINT AS len, unnest(regexp_extract_all(c, '([0-9]+)([MIDNSHP=XB])', 2)) AS op, unnest(range(1, len(regexp_extract_all(c, '[MIDNSHP=XB]')) + 1)) AS i FROM n),
w AS (SELECT *, lag(op) OVER t AS before, lead(op) OVER t AS next, coalesce(sum(len * CASE WHEN op IN ('M','D','N','=','X') THEN 1 WHEN op = 'B' THEN -1 ELSE 0 END) OVER (PARTITION BY line_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p
      FROM o WINDOW t AS (PARTITION BY line_id ORDER BY i)),
v AS (SELECT line_id, bool_or((op = 'H' AND before IS NOT NULL AND next IS NOT NULL) OR (op = 'S' AND before IS NOT NULL AND next IS NOT NULL AND before <> 'H' AND next <> 'H') OR (p < 0 AND op IN ('M','I','S','=','X')))
      OR sum(CASE WHEN op IN ('M','I','S','=','X') THEN len ELSE 0 END) <> any_value(length(s)) AS invalid FROM w GROUP BY line_id),
r AS (SELECT q.line_id, u, CASE WHEN len(f) < 11 THEN 'fields' WHEN bad THEN 'quoting'
  WHEN NOT regexp_full_match(u[1], '[!-?A-~]{{1,254}}') THEN 'qname' WHEN NOT ({_number('u[2]', 65535)} OR regexp_full_match(u[2], '0x[0-9A-Fa-f]{{1,4}}')) THEN 'flag' WHEN u[3] = '' THEN 'rname'
  WHEN NOT {_number('u[4]', 2**31 - 1)} THEN 'pos' WHEN NOT {_number('u[5]', 255)} THEN 'mapq' WHEN u[6] <> '*' AND (NOT regexp_full_match(u[6], '([0-9]{{1,13}}[MIDNSHP=XB])+') OR coalesce(v.invalid, FALSE)) THEN 'cigar'
  WHEN u[7] = '' THEN 'rnext' WHEN NOT {_number('u[8]', 2**31 - 1)} THEN 'pnext' WHEN NOT {_whole('u[9]', -(2**31) + 1, 2**31 - 1)} THEN 'tlen' WHEN NOT regexp_full_match(u[10], '[*]|[A-Za-z=.]+') THEN 'seq'
  WHEN NOT (u[11] = '*' OR (u[10] <> '*' AND regexp_full_match(u[11], '[!-~]+') AND length(u[11]) = length(u[10]))) THEN 'qual'
  WHEN NOT coalesce(list_bool_and(list_transform(u[12:], lambda a: regexp_matches(a, '^[A-Za-z][A-Za-z0-9]:[AifZHB]:') AND CASE substr(a, 4, 1) WHEN 'A' THEN regexp_full_match(substr(a, 6), '[!-~]') WHEN 'i' THEN {_whole('substr(a, 6)', -(2**31), 2**32 - 1)}
    WHEN 'f' THEN regexp_full_match(substr(a, 6), '{_FLOAT_SQL}') WHEN 'Z' THEN regexp_full_match(substr(a, 6), '[ -~]*') WHEN 'H' THEN regexp_full_match(substr(a, 6), '([0-9A-Fa-f][0-9A-Fa-f])*')
    WHEN 'B' THEN substr(a, 7, 1) = ',' AND substr(a, 6, 1) IN ('c','C','s','S','i','I','f') AND list_bool_and(list_transform(string_split(substr(a, 8), ','), lambda v: CASE substr(a, 6, 1) {_B_SQL} ELSE regexp_full_match(v, '{_FLOAT_SQL}') END))
    ELSE FALSE END)), TRUE) THEN 'aux' END AS reason FROM q LEFT JOIN v USING (line_id))"""
P2_SQL = f"WITH {P2_CTE} SELECT line_id, reason FROM r WHERE reason IS NOT NULL"


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reject_lines(table(spark, sf_dir, "sam_lines"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normalise_instants(table(spark, sf_dir, "read_groups"), "date", table(spark, sf_dir, "centers"), "center", ["row_id"])
    return rows.where("micros IS NOT NULL").select("row_id", utc_text(F.col("micros")).alias("date_utc"))


_D_NUM, _D_TIME = "([0-9]{{1,2}}){0}([0-9]{{1,2}}){0}([0-9]{{4}})", "([0-9]{1,2}):([0-9]{2})(:([0-9]{2})([.,]([0-9]+))?)?(~([AaPp]))?"
_D_ZONE = r"( ?([+-][0-9]{2}(:?[0-9]{2})?))?( ?\[?([A-Za-z][A-Za-z0-9_+/-]*)\]?)?"
#: Layouts of date texts: name, pattern, order of the first three groups as year, month, day (`num`: by the centre).
_D_LAYOUTS = [
    ("iso", rf"([0-9]{{4}})-([0-9]{{1,2}})-([0-9]{{1,2}})(([Tt]| +){_D_TIME})?{_D_ZONE}"),
    ("basic", rf"([0-9]{{4}})([0-9]{{2}})([0-9]{{2}})(([Tt ])([0-9]{{2}})([0-9]{{2}})(([0-9]{{2}})([.,]([0-9]+))?)?()())?{_D_ZONE}"),
    ("named", rf"(?:[A-Za-z]{{3,9}},? )?([0-9]{{1,2}})[- ]([A-Za-z]{{3,9}})[- ,]+([0-9]{{4}})(( +){_D_TIME})?{_D_ZONE}"),
    ("ynum", rf"([0-9]{{4}})[/.]([0-9]{{1,2}})[/.]([0-9]{{1,2}})(([Tt]| +){_D_TIME})?{_D_ZONE}"),
    ("num", rf"{_D_NUM.format('[-/.]')}(([Tt]| +){_D_TIME})?{_D_ZONE}"),
]
_D_NAMES = "['a','b','c','t','t2','h','mi','x1','s','x2','f','x3','ap','x4','o','x5','x6','zn']"
_D_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_D_LONG = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
P3_SQL = f"""
WITH t AS (SELECT row_id, regexp_replace(regexp_replace(date, '^\\s+|\\s+$', '', 'g'), '([0-9]) ?([AaPp])[.]?[Mm][.]?([^A-Za-z]|$)', '\\1~\\2\\3') AS t, c.zone, c.day_order AS o FROM read_groups LEFT JOIN centers c USING (center)),
l AS (SELECT *, CASE WHEN regexp_full_match(t, '[0-9]{{9,17}}') THEN 'count' {' '.join(f"WHEN regexp_full_match(t, '{p}') THEN '{n}'" for n, p in _D_LAYOUTS)} END AS lay FROM t),
g AS (SELECT *, CASE lay {' '.join(f"WHEN '{n}' THEN regexp_extract(t, '^{p}$', {_D_NAMES})" for n, p in _D_LAYOUTS)} END AS p FROM l WHERE lay IS NOT NULL),
d AS (SELECT *, CASE WHEN lay IN ('iso', 'basic', 'ynum') THEN p.a WHEN lay = 'named' OR o IN ('mdy', 'dmy') THEN p.c END AS y,
    CASE WHEN lay IN ('iso', 'basic', 'ynum') THEN p.b WHEN lay = 'named' THEN coalesce(list_position({_D_MONTHS}, lower(p.b)), list_position({_D_LONG}, lower(p.b)), CASE WHEN lower(p.b) = 'sept' THEN 9 END)::VARCHAR WHEN o = 'mdy' THEN p.a WHEN o = 'dmy' THEN p.b END AS m,
    CASE WHEN lay IN ('iso', 'basic', 'ynum') THEN p.c WHEN lay = 'named' OR o = 'dmy' THEN p.a WHEN o = 'mdy' THEN p.b END AS dd,
    coalesce(try_cast(nullif(p.h, '') AS INT), 0) AS h, coalesce(try_cast(nullif(p.mi, '') AS INT), 0) AS mi, coalesce(try_cast(nullif(p.s, '') AS INT), 0) AS s, lower(p.ap) AS ap, rpad(left(p.f, 6), 6, '0')::INT AS us,
    replace(p.o, ':', '') AS off FROM g),
w AS (SELECT *, CASE WHEN mi <= 59 AND s <= 59 AND CASE WHEN ap <> '' THEN h BETWEEN 1 AND 12 ELSE h <= 23 END THEN
      try_cast(lpad(y, 4, '0') || '-' || lpad(m, 2, '0') || '-' || lpad(dd, 2, '0') AS DATE)::TIMESTAMP + to_hours(CASE ap WHEN 'a' THEN h % 12 WHEN 'p' THEN h % 12 + 12 ELSE h END) + to_minutes(mi) + to_seconds(s) + to_microseconds(us) END AS wall,
    coalesce(substr(off, 2, 2)::INT * 60 + coalesce(nullif(substr(off, 4, 2), '')::INT, 0), 0) AS mins,
    coalesce(nullif(substr(off, 4, 2), '')::INT, 0) AS off_m, list_position({[*ABBREVIATIONS]}, upper(p.zn)) AS ab FROM (SELECT * REPLACE (nullif(off, '') AS off) FROM d WHERE lay <> 'count')),
n AS (SELECT name FROM pg_timezone_names() WHERE contains(name, '/')),
x AS (SELECT row_id, wall, CASE WHEN off IS NOT NULL THEN CASE WHEN off_m <= 59 AND mins <= 840 THEN CASE WHEN off[1] = '-' THEN -mins ELSE mins END END WHEN ab > 0 THEN {[*ABBREVIATIONS.values()]}[ab] END AS minutes,
    off IS NOT NULL AS stated, CASE WHEN p.zn <> '' THEN p.zn ELSE zone END AS z FROM w WHERE wall IS NOT NULL),
r AS (SELECT row_id, wall - to_minutes(minutes) AS u FROM x WHERE minutes IS NOT NULL
      UNION ALL SELECT row_id, u FROM (SELECT row_id, wall, z, timezone(z, wall) AS late FROM x JOIN n ON x.z = n.name WHERE minutes IS NULL AND NOT stated),
        LATERAL (SELECT min(late - to_minutes(k)) AT TIME ZONE 'UTC' AS u FROM (SELECT unnest([0, 20, 30, 40, 60, 120]) AS k) WHERE k = 0 OR timezone(z, late - to_minutes(k)) = wall)
      UNION ALL SELECT row_id, make_timestamp(CASE WHEN length(t) <= 11 THEN t::BIGINT * 1000000 WHEN length(t) <= 14 THEN t::BIGINT * 1000 ELSE t::BIGINT END) FROM g WHERE lay = 'count')
SELECT row_id, strftime(u, '%Y-%m-%dT%H:%M:%S.%fZ') AS date_utc FROM r
"""


def _tag(tag: str) -> Column:
    """sval of the first aux element with the tag. By position in the array of tags, so that the scan reads two of aux's fields only."""
    return F.get(F.col("aux.sval"), (F.array_position(F.col("aux.tag"), tag) - 1).cast("int"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, g = table(spark, sf_dir, "alignments"), table(spark, sf_dir, "read_groups")
    src = F.col("_src_id").cast("string")
    one = lambda field, target, scope, key: F.struct(F.lit(field).alias("field"), F.lit(target).alias("target"), scope.alias("scope"), key.alias("key"))
    of_alignments = a.select(
        "row_id", F.col("loaded_at").alias("t"),
        F.inline(F.array(
            one("ref_id", "ref", F.lit(""), F.col("ref_id").cast("string")), one("mate_ref_id", "ref", F.lit(""), F.col("mate_ref_id").cast("string")),
            one("rg", "rg", src, _tag("RG")), one("pg", "pg", src, _tag("PG")),
        )),
    ).withColumn("tbl", F.lit("alignments"))
    of_groups = g.select(F.lit("read_groups").alias("tbl"), "row_id", F.lit("program").alias("field"), F.lit("pg").alias("target"), src.alias("scope"), F.col("program").alias("key"), F.col("loaded_at").alias("t"))
    life = [F.col("loaded_at"), F.col("removed_at")]
    parents = (
        table(spark, sf_dir, "ref_seqs").select(F.lit("ref").alias("target"), F.lit("").alias("scope"), F.col("ref_id").cast("string").alias("key"), *life)
        .unionByName(g.select(F.lit("rg").alias("target"), src.alias("scope"), F.col("id").alias("key"), *life))
        .unionByName(table(spark, sf_dir, "programs").select(F.lit("pg").alias("target"), src.alias("scope"), F.col("uid").alias("key"), *life))
    )
    return find_orphans(of_alignments.unionByName(of_groups), parents)


P4_SQL = """
WITH a AS (SELECT row_id, loaded_at AS t, _src_id AS s, ref_id, mate_ref_id,
                  aux[list_position(list_transform(aux, lambda x: x.tag), 'RG')].sval AS rg, aux[list_position(list_transform(aux, lambda x: x.tag), 'PG')].sval AS pg FROM alignments),
r AS (SELECT 'alignments' AS tbl, row_id, 'ref_id' AS field, 'ref' AS k, NULL::INT AS s, ref_id::VARCHAR AS v, t FROM a
      UNION ALL SELECT 'alignments', row_id, 'mate_ref_id', 'ref', NULL, mate_ref_id::VARCHAR, t FROM a
      UNION ALL SELECT 'alignments', row_id, 'rg', 'rg', s, rg, t FROM a
      UNION ALL SELECT 'alignments', row_id, 'pg', 'pg', s, pg, t FROM a
      UNION ALL SELECT 'read_groups', row_id, 'program', 'pg', _src_id, program, loaded_at FROM read_groups),
p AS (SELECT 'ref' AS k, NULL::INT AS s, ref_id::VARCHAR AS v, loaded_at, removed_at FROM ref_seqs
      UNION ALL SELECT 'rg', _src_id, id, loaded_at, removed_at FROM read_groups
      UNION ALL SELECT 'pg', _src_id, uid, loaded_at, removed_at FROM programs)
SELECT tbl, row_id, field,
       CASE WHEN count(p.k) = 0 THEN 'missing' WHEN bool_and(p.loaded_at > r.t) THEN 'late' ELSE 'deleted' END AS status,
       strftime(any_value(r.t) AT TIME ZONE 'UTC', '%Y-%m') AS period
FROM r LEFT JOIN p ON r.k = p.k AND r.v = p.v AND r.s IS NOT DISTINCT FROM p.s
WHERE r.v IS NOT NULL
GROUP BY tbl, row_id, field
HAVING NOT coalesce(bool_or(p.loaded_at <= r.t AND (p.removed_at IS NULL OR p.removed_at > r.t)), FALSE)
"""


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "alignments").where("ref_id IS NOT NULL").select(F.col("_src_id").alias("src_id"), "ref_id")
    rows = aggregate_per_key(a, ["src_id", "ref_id"], F.count("*").alias("w"))
    i = table(spark, sf_dir, "index_stats").distinct().select(F.col("_src_id").alias("src_id"), "ref_id", F.coalesce("mapped", F.lit(0).cast("bigint")).alias("mapped"))
    mapped = aggregate_per_key(i, ["src_id", "ref_id"], F.sum("mapped").alias("w"))
    found = [dominant_keys(x, "src_id", "ref_id", "w", 30).select(F.lit(scope).alias("scope"), "src_id", "ref_id") for scope, x in (("alignments", rows), ("index_stats", mapped))]
    return found[0].unionByName(found[1])


P5_SQL = """
WITH c AS (SELECT 'alignments' AS scope, _src_id AS src_id, ref_id, count(*) AS w FROM alignments WHERE ref_id IS NOT NULL GROUP BY ALL
           UNION ALL
           SELECT 'index_stats', _src_id, ref_id, sum(coalesce(mapped, 0)) FROM (SELECT DISTINCT * FROM index_stats) GROUP BY ALL),
t AS (SELECT *, sum(w) OVER (PARTITION BY scope, src_id) AS total FROM c)
SELECT scope, src_id, ref_id FROM t WHERE w > 0 AND w * 100 >= total * 30 AND ref_id IS NOT NULL
"""


def p5_reference_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, mapped rows and aligned bases of every ref_id, with the name and length of its dictionary entry."""
    a = table(spark, sf_dir, "alignments").where("ref_id IS NOT NULL")
    a = a.select("ref_id", F.coalesce("flag", F.lit(0)).bitwiseAND(F.lit(4)).alias("u"), lengths(F.col("cigar"))["ref"].alias("bases"))
    refs = table(spark, sf_dir, "ref_seqs").groupBy("ref_id").agg(F.min("sn").alias("sn"), F.max("ln").alias("ln"))
    joined = skew_join(a, refs, ["ref_id"])
    return aggregate_per_key(joined, ["ref_id", "sn", "ln"], F.count("*").alias("n_rows"), F.count_if(F.col("u") == 0).alias("n_mapped"), F.coalesce(F.sum("bases"), F.lit(0).cast("bigint")).alias("bases"))


P5_PROFILE_SQL = """
WITH r AS (SELECT ref_id, min(sn) AS sn, max(ln) AS ln FROM ref_seqs GROUP BY ref_id)
SELECT a.ref_id, r.sn, r.ln, count(*) AS n_rows, count(*) FILTER (WHERE coalesce(flag, 0) & 4 = 0) AS n_mapped,
       CAST(coalesce(sum(list_sum(list_transform(coalesce(cigar, []), lambda x: CASE WHEN x.op IN ('M','D','N','=','X') THEN coalesce(x.len, 0) ELSE 0 END))), 0) AS BIGINT) AS bases
FROM alignments a LEFT JOIN r ON a.ref_id = r.ref_id WHERE a.ref_id IS NOT NULL GROUP BY ALL
"""

QUANTILES = [0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


def library_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(_src_id, library, measure, value) of every alignment.

    A read group id with several rows counts by its last loaded one; rows without read group, and groups without library, have a null library."""
    g = table(spark, sf_dir, "read_groups").groupBy("_src_id", "id").agg(F.max_by("library", F.struct("loaded_at", "row_id")).alias("library"))
    a = table(spark, sf_dir, "alignments").select("_src_id", _tag("RG").alias("id"), "mapq", "tlen").join(broadcast_if_small(g), ["_src_id", "id"], "left")
    one = lambda name, v: F.struct(F.lit(name).alias("measure"), v.cast("bigint").alias("value"))
    return a.select("_src_id", "library", F.inline(F.array(one("mapq", F.col("mapq")), one("tlen", F.abs(F.col("tlen").cast("bigint"))))))


def _percentiles(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    out = exact_percentiles(combine_values(library_values(spark, sf_dir), ["library", "measure"], "value"), ["library", "measure"], QUANTILES, **how)
    return out.select("library", "measure", "q", "value", "n", F.lit(0).cast("bigint").alias("rank_error"))


def p6_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _percentiles(spark, sf_dir)


def p6_multi_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same to the last value by multi-select rounds."""
    return _percentiles(spark, sf_dir, finish=8)


_P6_VALUES = """
WITH g AS (SELECT _src_id, id, last(library ORDER BY loaded_at, row_id) AS library FROM read_groups GROUP BY ALL),
v AS (SELECT a._src_id, g.library, a.mapq, a.tlen
      FROM (SELECT _src_id, mapq, tlen, aux[list_position(list_transform(aux, lambda x: x.tag), 'RG')].sval AS id FROM alignments) a LEFT JOIN g USING (_src_id, id)),
m AS (SELECT library, 'mapq' AS measure, mapq::BIGINT AS value FROM v WHERE mapq IS NOT NULL
      UNION ALL SELECT library, 'tlen', abs(tlen::BIGINT) FROM v WHERE tlen IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY library, measure ORDER BY value) AS i, count(*) OVER (PARTITION BY library, measure) AS n FROM m)
"""
P6_SQL = _P6_VALUES + """
SELECT library, measure, CAST(q AS DOUBLE) AS q, value, n, CAST(0 AS BIGINT) AS rank_error
FROM r, (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95, 0.99]) AS q) WHERE i = greatest(1, CAST(ceil(q * n) AS BIGINT))
"""


def p6_merged_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same percentiles within 1 per cent, from logarithmic summaries made per source file and then added up."""
    v = library_values(spark, sf_dir).where("value IS NOT NULL")
    per_file = v.groupBy("_src_id", "library", "measure", log_bucket(F.col("value")).alias("bucket")).agg(F.count("*").alias("cnt"))
    out = summary_percentiles(per_file, ["library", "measure"], QUANTILES)
    return out.select("library", "measure", "q", F.round("value", 6).alias("value"), "n", F.lit(RELATIVE_ERROR).alias("relative_error"))


_GAMMA = (1 + RELATIVE_ERROR) / (1 - RELATIVE_ERROR)
P6_MERGED_SQL = _P6_VALUES + f"""
SELECT library, measure, CAST(q AS DOUBLE) AS q, CASE WHEN value = 0 THEN 0 ELSE round(exp(floor(ln(value::DOUBLE) / {math.log(_GAMMA)!r}) * {math.log(_GAMMA)!r}) * {2 * _GAMMA / (1 + _GAMMA)!r}, 6) END AS value, n, {RELATIVE_ERROR}::DOUBLE AS relative_error
FROM r, (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95, 0.99]) AS q) WHERE i = greatest(1, CAST(ceil(q * n) AS BIGINT))
"""


QUERIES = {
    "p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p4_found": p4_found, "p5_found": p5_found, "p5_reference_profile": p5_reference_profile,
    "p6_percentiles": p6_percentiles, "p6_multi_select": p6_multi_select, "p6_merged_summaries": p6_merged_summaries,
}
SQL = {"p1_found": P1_SQL, "p2_found": P2_SQL, "p3_found": P3_SQL, "p4_found": P4_SQL, "p5_found": P5_SQL, "p5_reference_profile": P5_PROFILE_SQL, "p6_percentiles": P6_SQL, "p6_multi_select": P6_SQL, "p6_merged_summaries": P6_MERGED_SQL}
