"""Queries that go through files: every table is written to the shared folder in a format and read again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.functions import cigar as C
from readloom.functions import records as R
from readloom.functions import sequences as S
from readloom.functions import tags as T
from readloom.operators import flagstat as FS
from readloom.operators import index as X
from readloom.operators.header import SCHEMAS, format_header, line_expression, parse_header, parse_headers
from readloom.operators.rejects import load_records
from readloom.plans.general import P2_CTE, P2_SQL
from readloom.plans.records import LINE_SQL, _bin_sql, _OPS
from readloom.session import broadcast_if_small, cut, table
from readloom.sources import bam, cram, fasta, files, indexes, sam
from readloom.sources.bgzf import BlockWriter, has_eof
from readloom.streaming import loading

QUERIES: dict = {}
SQL: dict[str, str] = {}

_DENSE = """ids AS (SELECT DISTINCT ref_id AS id FROM alignments WHERE ref_id IS NOT NULL UNION SELECT DISTINCT mate_ref_id FROM alignments WHERE mate_ref_id IS NOT NULL),
d AS (SELECT id, (row_number() OVER (ORDER BY id) - 1)::INT AS n FROM ids),
f AS (SELECT a.* EXCLUDE (ref_id, mate_ref_id, pos, mate_pos, rname, mate_rname), x.n AS ref_id, y.n AS mate_ref_id, coalesce(pos, -1) AS pos, coalesce(mate_pos, -1) AS mate_pos FROM alignments a LEFT JOIN d x ON a.ref_id = x.id LEFT JOIN d y ON a.mate_ref_id = y.id)"""


def _one_file(s: SparkSession, d: str) -> tuple[DataFrame, str, int]:
    """(records of all sources as of one file, header text, references). Ids are made dense, as a file's dictionary is; its size bounds what is collected."""
    a = table(s, d, "alignments")
    ids = a.select(F.explode(F.array("ref_id", "mate_ref_id")).alias("id")).where("id IS NOT NULL").distinct()
    dense = cut(ids.select("id", (F.row_number().over(Window.orderBy("id")) - 1).cast("int").alias("n")))
    n = dense.count()
    one, two = dense.select(F.col("id").alias("ref_id"), F.col("n").alias("r")), dense.select(F.col("id").alias("mate_ref_id"), F.col("n").alias("m"))
    out = a.join(broadcast_if_small(one), "ref_id", "left").join(broadcast_if_small(two), "mate_ref_id", "left")
    name = lambda c: F.concat(F.lit("seq"), c.cast("string"))
    out = out.select(
        "row_id", "qname", "flag", F.col("r").alias("ref_id"), name(F.col("r")).alias("rname"), F.coalesce("pos", F.lit(-1).cast("bigint")).alias("pos"), "mapq", "cigar", F.col("m").alias("mate_ref_id"), name(F.col("m")).alias("mate_rname"),
        F.coalesce("mate_pos", F.lit(-1).cast("bigint")).alias("mate_pos"), "tlen", "seq", "qual", "aux", "_voff_begin", "_voff_end", "_src_id", "_src_ord",
    )
    header = "@HD\tVN:1.6\tSO:coordinate\n" + "".join(f"@SQ\tSN:seq{i}\tLN:{(1 << 31) - 1}\n" for i in range(n))
    return out, header, n


def _as_bam(s: SparkSession, d: str, layout: str = "file") -> tuple[str, int]:
    indexes.register(s)
    df, header, n = _one_file(s, d)
    path = files.scratch(s, "all.bam")
    ordered = df.orderBy(F.col("ref_id").isNull() | (F.col("pos") < 0), "ref_id", "pos", "row_id").drop("row_id")
    ordered.write.format("bam").mode("append").option("path", path).option("header", header).option("level", 1).option("layout", layout).save()
    return path, n


_CORE = ["qname", "flag", "ref_id", "pos", "mapq", "mate_ref_id", "mate_pos", "tlen", "seq"]
_CORE_SQL = "qname, flag, ref_id, pos, coalesce(mapq, 0)::SMALLINT AS mapq, mate_ref_id, mate_pos, coalesce(tlen, 0) AS tlen"


def src04_bam_round_trip(s: SparkSession, d: str) -> DataFrame:
    """Every record with all it holds through a folder of files, read in small splits. Floats are compared as numbers."""
    df = s.read.format("bam").option("path", _as_bam(s, d, "folder")[0]).option("splitBytes", 1 << 18).load()
    whole, real = (lambda x: (x["type"] != "f") & (F.coalesce(x["subtype"], F.lit("")) != "f")), F.flatten(F.transform("aux", lambda x: F.coalesce(x["farr"], F.array(x["fval"]))))
    return df.select(
        *_CORE, C.format_cigar(F.col("cigar")).alias("cigar"), S.encode_qual(F.col("qual")).alias("qual"), F.array_join(F.transform(F.filter("aux", whole), T.format_aux), " ").alias("tags"),
        F.array_join(F.transform("aux", lambda x: F.concat(x["tag"], x["type"], F.coalesce(x["subtype"], F.lit("")))), " ").alias("types"),
        *[f(F.filter(real, lambda v: v.isNotNull())).cast("double").alias(n) for n, f in (("low", F.array_min), ("high", F.array_max))],
    )


_AUX1 = "x.tag || ':' || CASE WHEN x.type IN ('c','C','s','S','i','I') THEN 'i' ELSE x.type END || ':' || coalesce(CASE WHEN x.type IN ('c','C','s','S','i','I') THEN x.ival::VARCHAR WHEN x.type = 'H' THEN hex(x.bval) WHEN x.type = 'B' THEN x.subtype || coalesce(array_to_string(list_transform(x.iarr, lambda v: ',' || v::VARCHAR), ''), '') ELSE x.sval END, '')"
_CIGAR1 = "CASE WHEN coalesce(len(cigar), 0) = 0 THEN '*' ELSE array_to_string(list_transform(cigar, lambda x: x.len::VARCHAR || x.op), '') END"
_QUAL1 = "CASE WHEN qual IS NULL OR len(qual) = 0 OR list_min(qual) = 255 THEN '*' ELSE array_to_string(list_transform(qual, lambda q: chr((q + 33)::INT)), '') END"
_REALS1 = "flatten(list_transform(coalesce(aux, []), lambda x: CASE WHEN x.type = 'f' THEN [x.fval] WHEN x.subtype = 'f' THEN x.farr ELSE []::FLOAT[] END))"
SQL["src04_bam_round_trip"] = f"""WITH {_DENSE} SELECT {_CORE_SQL}, seq, {_CIGAR1} AS cigar, {_QUAL1} AS qual, array_to_string(list_transform(list_filter(coalesce(aux, []), lambda x: x.type <> 'f' AND coalesce(x.subtype, '') <> 'f'), lambda x: {_AUX1}), ' ') AS tags,
  array_to_string(list_transform(coalesce(aux, []), lambda x: x.tag || x.type || coalesce(x.subtype, '')), ' ') AS types, list_min({_REALS1})::DOUBLE AS low, list_max({_REALS1})::DOUBLE AS high FROM f"""


def src06_bam_omit(s: SparkSession, d: str) -> DataFrame:
    df = s.read.format("bam").option("path", _as_bam(s, d)[0]).option("omit", "variable").load()
    return df.select(*[c for c in _CORE if c != "seq"], (F.col("seq").isNull() & F.col("aux").isNull()).alias("omitted"))


SQL["src06_bam_omit"] = f"WITH {_DENSE} SELECT {_CORE_SQL}, TRUE AS omitted FROM f"


def _file_index(b: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = b.where("ref_id >= 0 AND pos >= 0").select("ref_id", F.col("pos").alias("beg"), R.record_end(F.col("flag"), F.col("pos"), F.col("cigar")).alias("end"), "_voff_begin", "_voff_end")
    return X.build_bins(p, ["ref_id"], F.col("beg"), F.col("end")), X.build_linear(p, ["ref_id"], F.col("beg"), F.col("end")), FS.reference_stats(b)


def src07_region_scan(s: SparkSession, d: str) -> DataFrame:
    """A region on every reference read through the index of the file: chunks of all, restricted scan, exact filter above it."""
    path, n = _as_bam(s, d)
    b = s.read.format("bam").option("path", path).option("omit", "variable").load()
    bins, linear, _ = _file_index(b)
    regions = s.createDataFrame([(i, i, i * 7919 % 40 * 1_000_000) for i in range(n)], "region_id LONG, ref_id INT, beg LONG").withColumn("end", F.col("beg") + 3_000_000)
    chunks = X.lookup(regions, bins, linear, ["ref_id"], X.identity)
    merged = X.adjacent(chunks.withColumn("all", F.lit(1)), ["all"]).orderBy("chunk_begin").collect()  # of one file, merged over its regions
    if not merged:
        return b.where("false").select("qname", "flag", "ref_id", "pos")
    text = ",".join(f"{c['chunk_begin']}-{c['chunk_end']}" for c in merged)
    part = s.read.format("bam").option("path", path).option("omit", "variable").option("chunks", text).load()
    asked = F.broadcast(regions.select("ref_id", "beg", "end"))  # a row a reference of the file
    return part.join(asked, "ref_id").where((F.col("pos") >= 0) & (F.col("pos") < F.col("end")) & (R.record_end(F.col("flag"), F.col("pos"), F.col("cigar")) > F.col("beg"))).select("qname", "flag", "ref_id", "pos")


_REGIONS = "rg AS (SELECT n AS ref_id, n::BIGINT * 7919 % 40 * 1000000 AS b FROM d)"
SQL["src07_region_scan"] = f"WITH {_OPS}, {_DENSE}, {_REGIONS} SELECT f.qname, f.flag, f.ref_id, f.pos FROM f JOIN ends USING (row_id) JOIN rg ON f.ref_id = rg.ref_id WHERE f.pos >= 0 AND f.pos < rg.b + 3000000 AND ends.e > rg.b"


def _index_round_trip(kind: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        """By kind of row: how many places (bins, tiles, references) the index file has, its record counts, and rows that it does not give back as they were."""
        path, n = _as_bam(s, d)
        b = s.read.format("bam").option("path", path).option("omit", "variable").load()
        bins, linear, stats = (cut(x) for x in _file_index(b))
        meta = {"format": 1, "zero_based": False, "name_col": 3, "begin_col": 4, "end_col": 0, "meta_char": "@", "skip": 0, "names": [f"seq{i}" for i in range(n)], "min_shift": 14, "depth": 5, "version": 2}
        target = files.scratch(s, f"all.{kind}")
        tables = indexes.index_rows(bins, None if kind == "csi" else linear, stats)
        indexes.write_index(target, kind, n, bins, None if kind == "csi" else linear, stats, b.where("NOT (ref_id >= 0 AND pos >= 0) OR ref_id IS NULL").count(), meta)
        got = s.read.format("coordinate_index").option("path", target).load().where("kind <> 'linear' OR voff <> 0")
        same = [c for c in tables.columns if kind == "csi" or c not in ("left_voff", "records")]
        key = F.coalesce("bin", F.col("tile").cast("bigint"))
        places = got.groupBy("kind").agg(F.count_distinct("ref_id", F.coalesce(key, F.lit(-1))).alias("places"), F.sum("mapped").alias("mapped"), F.sum("unmapped").alias("unmapped"))
        odd = tables.select(*same).exceptAll(got.select(*same)).unionAll(got.where("kind <> 'unplaced'").select(*same).exceptAll(tables.select(*same))).groupBy("kind").agg(F.count("*").alias("different"))
        return places.join(odd, "kind", "left").select("kind", "places", "mapped", "unmapped", F.coalesce("different", F.lit(0).cast("bigint")).alias("different"))

    return run


_INDEX_SQL = f"""WITH {_OPS}, {_DENSE}, x AS (SELECT f.ref_id, f.pos, ends.e, f.ref_id IS NOT NULL AND f.pos >= 0 AS placed, f.flag & 4 = 0 AS m FROM f JOIN ends USING (row_id))
SELECT 'stats' AS kind, count(DISTINCT ref_id) FILTER (WHERE placed) AS places, count(*) FILTER (WHERE placed AND m) AS mapped, count(*) FILTER (WHERE placed AND NOT m) AS unmapped, 0 AS different FROM x
UNION ALL SELECT 'unplaced', 0, NULL, count(*) FILTER (WHERE NOT placed), 0 FROM x
UNION ALL SELECT 'bin', count(DISTINCT (ref_id, {_bin_sql('pos', 'e')})), NULL, NULL, 0 FROM x WHERE placed"""
_TILE_SQL = " UNION ALL SELECT 'linear', count(DISTINCT (ref_id, t)), NULL, NULL, 0 FROM (SELECT ref_id, unnest(range(pos >> 14, (greatest(pos, e - 1) >> 14) + 1)) AS t FROM x WHERE placed)"
for _n, _k in (("src14_bai_round_trip", "bai"), ("src15_csi_round_trip", "csi"), ("src16_tabix_round_trip", "tbi")):
    QUERIES[_n] = _index_round_trip(_k)
    SQL[_n] = _INDEX_SQL + ("" if _k == "csi" else _TILE_SQL)


def sam_texts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "alignments").select("row_id", sam.format_line().alias("line"))


def snk02_sam_lines(s: SparkSession, d: str) -> DataFrame:
    """The line of every alignment. Engines write floats differently, so float fields are cut out of the line, and their values compared as the numbers they are read as."""
    t = sam_texts(s, d).withColumn("real", F.regexp_extract_all("line", F.lit(r"\t[A-Za-z][A-Za-z0-9]:(?:f:|B:f,)([^\t]*)"), F.lit(1)))
    numbers = F.flatten(F.transform("real", lambda v: F.transform(F.split(v, ","), lambda x: x.try_cast("float").cast("double"))))
    return t.select("row_id", F.regexp_replace("line", r"\t[A-Za-z][A-Za-z0-9]:(?:f:|B:f)[^\t]*", "").alias("line"), *[f(numbers).alias(n) for n, f in (("low", F.array_min), ("high", F.array_max))], F.size(F.filter(numbers, lambda v: v.isNotNull())).alias("n"))


SQL["snk02_sam_lines"] = f"""SELECT row_id, CASE WHEN fits THEN concat_ws(chr(9), coalesce(qname, '*'), coalesce(flag, 0)::VARCHAR, coalesce(rname, '*'), (coalesce(pos, -1) + 1)::VARCHAR, coalesce(mapq, 0)::VARCHAR,
  {_CIGAR1}, CASE WHEN mate_rname IS NULL THEN '*' WHEN mate_rname = rname THEN '=' ELSE mate_rname END,
  (coalesce(mate_pos, -1) + 1)::VARCHAR, coalesce(tlen, 0)::VARCHAR, CASE WHEN coalesce(length(seq), 0) = 0 THEN '*' ELSE seq END, {_QUAL1})
  || coalesce(array_to_string(list_transform(list_filter(aux, lambda x: x.type <> 'f' AND coalesce(x.subtype, '') <> 'f'), lambda x: chr(9) || {_AUX1}), ''), '') END AS line,
  CASE WHEN fits THEN list_min({_REALS1})::DOUBLE END AS low, CASE WHEN fits THEN list_max({_REALS1})::DOUBLE END AS high, CASE WHEN fits THEN len({_REALS1})::INT END AS n
  FROM (SELECT *, coalesce(len(qual), 0) = 0 OR len(qual) = coalesce(length(seq), 0) AS fits FROM alignments)"""


def src01_sam_scan(s: SparkSession, d: str) -> DataFrame:
    """All records as text files with header, read again: outcome counts by reason."""
    indexes.register(s)
    df, header, _ = _one_file(s, d)
    path = files.scratch(s, "all.sam")
    sam.write_sam(df, path, header, layout="folder")
    h, records, rejects = sam.read_sam(s, path)
    good = records.groupBy(F.lit("loaded").alias("outcome")).agg(F.count("*").alias("n"), F.count("ref_id").alias("placed"))
    return good.unionByName(rejects.groupBy(F.col("reason").alias("outcome")).agg(F.count("*").alias("n"), F.lit(0).cast("bigint").alias("placed")))


# what is written is a record to the reader
SQL["src01_sam_scan"] = "SELECT 'loaded' AS outcome, count(*) AS n, count(ref_id) AS placed FROM alignments"


def src02_inferred_references(s: SparkSession, d: str) -> DataFrame:
    return sam.inferred_references(table(s, d, "sam_lines"), "line", "line_id")


SQL["src02_inferred_references"] = """WITH n AS (SELECT line_id, 0 AS i, split_part(line, chr(9), 3) AS sn FROM sam_lines WHERE len(string_split(line, chr(9))) > 2 UNION ALL SELECT line_id, 1, split_part(line, chr(9), 7) FROM sam_lines WHERE len(string_split(line, chr(9))) > 6),
f AS (SELECT sn, min((line_id, i)) AS first FROM n WHERE sn NOT IN ('*', '=', '') GROUP BY sn) SELECT (row_number() OVER (ORDER BY first) - 1)::INT AS ref_id, sn, 0 AS ln FROM f"""


def src03_sam_decode(s: SparkSession, d: str) -> DataFrame:
    records, _ = load_records(table(s, d, "sam_lines"))
    return records.select("line_id", "qname", "flag", "rname", "pos", "mapq", F.size("cigar").alias("n_ops"), "mate_rname", "mate_pos", "tlen", "seq", F.size("aux_text").alias("n_aux"))


SQL["src03_sam_decode"] = f"""WITH {P2_CTE} SELECT line_id, u[1] AS qname, u[2]::INT AS flag, nullif(u[3], '*') AS rname, u[4]::BIGINT - 1 AS pos, u[5]::SMALLINT AS mapq,
  len(regexp_extract_all(u[6], '[MIDNSHP=XB]'))::INT AS n_ops, CASE WHEN u[7] = '=' THEN nullif(u[3], '*') ELSE nullif(u[7], '*') END AS mate_rname, u[8]::BIGINT - 1 AS mate_pos, u[9]::INT AS tlen, nullif(u[10], '*') AS seq, (len(u) - 11)::INT AS n_aux FROM r WHERE reason IS NULL"""


def _as_bgzf(s: SparkSession, d: str) -> str:
    """The lines of sam_lines as block-compressed text, a file a partition."""
    indexes.register(s)
    path = files.scratch(s, "lines.gz")
    text = table(s, d, "sam_lines").where("line IS NOT NULL").select(F.regexp_replace("line", "[\\r\\n]+", " ").alias("line"))

    def parts(batches):
        import pandas as pd
        from pyspark import TaskContext

        name = f"{path}/{TaskContext.get().partitionId():06d}.gz"
        with files.open_output(name) as out:
            w, n = BlockWriter(out), 0
            for b in batches:
                for x in b["line"]:
                    w.write(x.encode() + b"\n")
                    n += 1
            w.close()
        yield pd.DataFrame({"name": [name], "n": [n]})

    cut(text.mapInPandas(parts, "name STRING, n BIGINT"))
    return path


def src19_bgzf_lines(s: SparkSession, d: str) -> DataFrame:
    """Lines of all records through block-compressed text, read by byte ranges."""
    return s.read.format("bgzf_lines").option("path", _as_bgzf(s, d)).option("splitBytes", 1 << 20).load().select("line")


SQL["src19_bgzf_lines"] = "SELECT regexp_replace(line, '[\\r\\n]+', ' ', 'g') AS line FROM sam_lines WHERE line IS NOT NULL"


def src20_line_offsets(s: SparkSession, d: str) -> DataFrame:
    """Lines by their offsets: how many, how many whose end is not where the next begins, and how many are read again alike through the chunks of their offsets."""
    path = _as_bgzf(s, d)
    read = s.read.format("bgzf_lines").option("path", path)
    lines = cut(read.option("splitBytes", 1 << 18).load())
    of_file = Window.partitionBy("_src_id", F.shiftright("_voff_begin", 40))
    after = F.lead("_voff_begin").over(of_file.orderBy("_voff_begin"))
    broken = lines.select(((F.col("_voff_end") != -1) & after.isNotNull() & (after != F.col("_voff_end"))).alias("bad")).agg(F.count("*").alias("lines"), F.count_if("bad").alias("broken"))
    first = lines.where("_src_id = 0").agg(F.min("_voff_begin").alias("b"), F.max("_voff_begin").alias("e")).head()
    if first["b"] is None:
        return broken.select("lines", "broken", F.lit(0).cast("bigint").alias("again"))
    cutting = [r[0] for r in lines.where("_src_id = 0").groupBy(F.shiftright("_voff_begin", 16).alias("block")).agg(F.max("_voff_begin").alias("v")).orderBy("v").select("v").collect()]  # a number a block of one file
    bounds = [first["b"], *cutting[:-1], first["e"] + 1]
    one = files.list_files(path)[0]
    again = s.read.format("bgzf_lines").option("path", one).option("chunks", ",".join(f"{a}-{b}" for a, b in zip(bounds, bounds[1:], strict=False) if a < b)).load()
    same = lines.join(again.select("_src_id", "_voff_begin", "_voff_end", "line"), ["_src_id", "_voff_begin", "_voff_end", "line"]).agg(F.count("*").alias("same"))
    whole = lines.where("_src_id = 0").agg(F.count("*").alias("whole"))
    keyed = [x.withColumn("k", F.lit(1)) for x in (broken, same, whole)]
    return keyed[0].join(keyed[1], "k").join(keyed[2], "k").select("lines", "broken", (F.col("same") - F.col("whole")).alias("again"))


SQL["src20_line_offsets"] = "SELECT count(*) AS lines, 0 AS broken, 0 AS again FROM sam_lines WHERE line IS NOT NULL"


def src21_has_eof(s: SparkSession, d: str) -> DataFrame:
    path, _ = _as_bam(s, d)
    empty = files.scratch(s, "empty.cram")
    with files.open_output(empty) as out:
        out.write(cram.FILE_HEAD + cram.EOF_CONTAINER)
    return s.createDataFrame([("bam", has_eof(path)), ("cram", cram.has_eof(empty))], "kind STRING, complete BOOLEAN")


SQL["src21_has_eof"] = "SELECT * FROM (VALUES ('bam', TRUE), ('cram', TRUE)) t(kind, complete)"


def src10_cram_blocks(s: SparkSession, d: str) -> DataFrame:
    """The lines of sam_lines through containers of blocks of every method, a file a partition."""
    indexes.register(s)
    path = files.scratch(s, "lines.cram")
    text = table(s, d, "sam_lines").where("line IS NOT NULL").select("line_id", F.regexp_replace("line", "[\\r\\n]+", " ").alias("line"))

    def parts(batches):
        import pandas as pd
        from pyspark import TaskContext

        n = 0
        with files.open_output(f"{path}/{TaskContext.get().partitionId():06d}.cram") as out:
            out.write(cram.FILE_HEAD)
            for pdf in batches:
                texts = [f"{i}\t{x}\n" for i, x in zip(pdf["line_id"], pdf["line"], strict=True)]
                for i in range(0, len(texts), 400):  # four blocks a container
                    out.write(cram.encode_container([(m, 4, m, "".join(texts[i + 100 * m : i + 100 * (m + 1)]).encode()) for m in range(4)], ref_id=-2, start=i, n_rec=len(texts[i : i + 400])))
                    n += 1
            out.write(cram.EOF_CONTAINER)
        yield pd.DataFrame({"n": [n]})

    cut(text.mapInPandas(parts, "n BIGINT"))
    blocks = s.read.format("cram_blocks").option("path", path).option("decompress", "true").option("containersPerTask", 8).load().where("block_type = 4")
    rows = blocks.select("method", F.explode(F.split(F.decode("data", "UTF-8"), "\n")).alias("x")).where("x <> ''")
    return rows.select(F.split_part("x", F.lit("\t"), F.lit(1)).cast("bigint").alias("line_id"), F.expr("substring(x, instr(x, '\t') + 1)").alias("line"), (F.col("method") <= 3).alias("known"))


SQL["src10_cram_blocks"] = "SELECT line_id, regexp_replace(line, '[\\r\\n]+', ' ', 'g') AS line, TRUE AS known FROM sam_lines WHERE line IS NOT NULL"


def src11_eof_block(s: SparkSession, d: str) -> DataFrame:
    """The container that ends every file, and its block."""
    indexes.register(s)
    path = files.scratch(s, "empty.cram")
    with files.open_output(path) as out:
        out.write(cram.FILE_HEAD + cram.EOF_CONTAINER)
    return s.read.format("cram_blocks").option("path", path).load().select("container_no", "ref_id", "start", "block_no", "block_type", "raw_size", "crc32")


SQL["src11_eof_block"] = "SELECT 0 AS container_no, -1 AS ref_id, 4542278 AS start, 0 AS block_no, 1::TINYINT AS block_type, 6 AS raw_size, 1258382318::BIGINT AS crc32"


def src11_header_block(s: SparkSession, d: str) -> DataFrame:
    """The reference dictionary as the header block of a container file, read and parsed again."""
    indexes.register(s)
    refs = table(s, d, "ref_seqs").where("sn IS NOT NULL AND ln > 0")
    refs = refs.groupBy("sn").agg(F.min_by(F.struct(*[c for c in refs.columns if c not in ("sn", "loaded_at", "removed_at")]), "ref_id").alias("x")).select("sn", "x.*")
    none = {k: s.createDataFrame([], SCHEMAS[k]) for k in ("RG", "PG")}
    path = files.scratch(s, "header.cram")
    with files.open_output(path) as out:
        out.write(cram.FILE_HEAD + cram.encode_container([(1, 0, 0, cram.header_block(format_header("1.6", "unknown", "none", refs, none["RG"], none["PG"], [])))]) + cram.EOF_CONTAINER)
    texts = s.read.format("cram_blocks").option("path", path).option("decompress", "true").load().where("block_type = 0").select(F.lit(0).alias("_src_id"), cram.header_text_of(F.col("data")).alias("text"))
    return parse_headers(texts, "SQ").select("ref_id", line_expression("SQ").alias("line"))


SQL["src11_header_block"] = f"WITH rs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sn ORDER BY ref_id) AS i FROM ref_seqs WHERE sn IS NOT NULL AND ln > 0) WHERE i = 1) SELECT (row_number() OVER (ORDER BY ref_id) - 1)::INT AS ref_id, {LINE_SQL['SQ']} FROM rs"


def _as_fasta(s: SparkSession, d: str) -> str:
    """Every read's bases as a sequence of its own, 30 to a line."""
    indexes.register(s)
    seqs = table(s, d, "alignments").where("length(seq) > 0").select(F.concat(F.lit(">r"), F.col("row_id"), F.lit(" x\n"), F.regexp_replace("seq", "(.{30})(?=.)", "$1\n")).alias("line"))
    path = files.scratch(s, "reads.fa")
    seqs.write.format("sam_text").mode("append").option("path", path).save()
    return path


def src12_fai_build(s: SparkSession, d: str) -> DataFrame:
    return fasta.build_fai(s, _as_fasta(s, d), 1 << 20).select("name", "length", "bases_per_line", "bytes_per_line", "problem")


SQL["src12_fai_build"] = "SELECT 'r' || row_id AS name, length(seq) AS length, least(30, length(seq))::INT AS bases_per_line, (least(30, length(seq)) + 1)::INT AS bytes_per_line, NULL::VARCHAR AS problem FROM alignments WHERE length(seq) > 0"


def src13_fai_read(s: SparkSession, d: str) -> DataFrame:
    fa = _as_fasta(s, d)
    path = files.scratch(s, "reads.fai")
    fasta.write_fai(fasta.build_fai(s, fa), path)
    return fasta.read_fai(s, path).select("name", "length")


SQL["src13_fai_read"] = "SELECT 'r' || row_id AS name, length(seq) AS length FROM alignments WHERE length(seq) > 0"


def src18_fasta_ranges(s: SparkSession, d: str) -> DataFrame:
    fa = _as_fasta(s, d)
    fai = cut(fasta.build_fai(s, fa))
    ask = fai.select("name", F.lit(5).cast("bigint").alias("beg"), F.least(F.lit(40), F.col("length")).cast("bigint").alias("end"))
    return fasta.read_ranges(ask, fai, fa).select("name", "seq", "error")


SQL["src18_fasta_ranges"] = "SELECT 'r' || row_id AS name, CASE WHEN length(seq) >= 5 THEN substr(seq, 6, least(40, length(seq)) - 5) END AS seq, CASE WHEN length(seq) < 5 THEN 'out of range' END AS error FROM alignments WHERE length(seq) > 0"


def snk04_header_text(s: SparkSession, d: str) -> DataFrame:
    """The dictionaries of all sources as one header text, names made unique by source, parsed again: every line of it."""

    def one(name: str, key: list[str], order: str) -> DataFrame:
        t = table(s, d, name)
        return t.groupBy(*key).agg(F.min_by(F.struct(*[c for c in t.columns if c not in (*key, "loaded_at", "removed_at")]), order).alias("x")).select(*key, "x.*")

    refs = one("ref_seqs", ["sn"], "ref_id").where("sn IS NOT NULL AND ln > 0")
    unique = lambda c: F.concat(F.col("_src_id").cast("string"), F.lit("."), F.col(c))
    groups = one("read_groups", ["_src_id", "id"], "row_id").where("id <> ''").withColumn("id", unique("id"))
    programs = one("programs", ["_src_id", "uid"], "row_id").where("uid <> ''").withColumn("uid", unique("uid"))
    h = parse_header(format_header("1.6", "coordinate", "none", refs, groups, programs, ["whole", "with\ttab"]))
    return reduce(DataFrame.unionAll, [h.table(s, k).select(F.lit(k).alias("kind"), line_expression(k).alias("line")) for k in ("SQ", "RG", "PG")])


_ONE1 = "(SELECT * REPLACE (_src_id || '.' || {1} AS {1}) FROM (SELECT *, row_number() OVER (PARTITION BY _src_id, {1} ORDER BY row_id) AS i FROM {0} WHERE {1} <> '') WHERE i = 1)"
SQL["snk04_header_text"] = "WITH rs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sn ORDER BY ref_id) AS i FROM ref_seqs WHERE sn IS NOT NULL) WHERE i = 1 AND ln > 0) " + " UNION ALL ".join(
    f"SELECT '{k}' AS kind, {q} FROM (SELECT * FROM {t})" for k, q, t in (("SQ", LINE_SQL["SQ"], "rs"), ("RG", LINE_SQL["RG"], _ONE1.format("read_groups", "id")), ("PG", LINE_SQL["PG"], _ONE1.format("programs", "uid")))
)


def stm01_windowed_counts(s: SparkSession, d: str) -> DataFrame:
    """Deliveries a day and source as a stream: the days that the watermark has passed, which are final."""
    a = loading.stream_table(s, d, "alignments", table(s, d, "alignments").schema).select("loaded_at", "_src_id")
    return loading.run_once(loading.windowed_counts(a, "loaded_at", "1 day", ["_src_id"], "30 days")).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "_src_id", "n")


SQL["stm01_windowed_counts"] = "SELECT strftime(loaded_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, _src_id, count(*) AS n FROM alignments WHERE loaded_at IS NOT NULL AND date_trunc('day', loaded_at AT TIME ZONE 'UTC') + INTERVAL 1 DAY <= (SELECT max(loaded_at AT TIME ZONE 'UTC') - INTERVAL 30 DAY FROM alignments) GROUP BY 1, 2"


def stm02_stream_rejects(s: SparkSession, d: str) -> DataFrame:
    lines = loading.stream_table(s, d, "sam_lines", table(s, d, "sam_lines").schema)
    return loading.run_once(loading.stream_records(lines, "line_id", "line")[1].select("line_id", "reason"))


SQL["stm02_stream_rejects"] = P2_SQL


def stm03_first_deliveries(s: SparkSession, d: str) -> DataFrame:
    """Records delivered twice, once: as a stream whose state lives as long as a second delivery may come."""
    a = loading.stream_table(s, d, "alignments", table(s, d, "alignments").schema).where("loaded_at IS NOT NULL").select("loaded_at", "_src_id", "_src_ord")
    return loading.run_once(loading.first_deliveries(a, ["_src_id", "_src_ord"], "loaded_at", "3650 days")).select("_src_id", "_src_ord")


SQL["stm03_first_deliveries"] = "SELECT DISTINCT _src_id, _src_ord FROM alignments WHERE loaded_at IS NOT NULL"

for _f in (src01_sam_scan, src02_inferred_references, src03_sam_decode, src04_bam_round_trip, src06_bam_omit, src07_region_scan, src10_cram_blocks, src11_eof_block, src11_header_block, src20_line_offsets, stm03_first_deliveries, src12_fai_build, src13_fai_read, src18_fasta_ranges, src19_bgzf_lines,
           src21_has_eof, snk02_sam_lines, snk04_header_text, stm01_windowed_counts, stm02_stream_rejects):
    QUERIES[_f.__name__] = _f
