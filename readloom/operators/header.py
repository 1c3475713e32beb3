"""Header dictionaries: text to tables and back, merge, edit, validate.

A header is small (bounded by the file's own dictionary), so its text is parsed where the file is opened; all work between headers is on tables.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.functions.records import first_tag

SORT_ORDERS = ("unknown", "unsorted", "queryname", "coordinate")  # fixed
GROUP_ORDERS = ("none", "query", "reference")  # fixed
#: Fixed tag order of each line, with the column a tag goes to.
TAGS = {
    "SQ": {"SN": "sn", "LN": "ln", "AS": "assembly", "M5": "md5", "SP": "species", "UR": "uri"},
    "RG": {"ID": "id", "CN": "center", "DS": "description", "DT": "date", "FO": "flow_order", "KS": "key_seq", "LB": "library", "PG": "program", "PI": "insert_size", "PL": "platform", "PU": "platform_unit", "SM": "sample"},
    "PG": {"ID": "uid", "PN": "name", "CL": "command", "PP": "previous", "VN": "version"},
}
SCHEMAS = {
    "SQ": "ref_id INT, sn STRING, ln INT, md5 BINARY, assembly STRING, species STRING, uri STRING, other_tags MAP<STRING, STRING>",
    "RG": "rg_id INT, id STRING, center STRING, description STRING, date STRING, flow_order STRING, key_seq STRING, library STRING, program STRING, insert_size INT, platform STRING, platform_unit STRING, sample STRING, other_tags MAP<STRING, STRING>",
    "PG": "pg_id INT, uid STRING, name STRING, command STRING, previous STRING, version STRING, other_tags MAP<STRING, STRING>",
}
_IDS = {"SQ": ("ref_id", "sn"), "RG": ("rg_id", "id"), "PG": ("pg_id", "uid")}


class HeaderError(ValueError):
    """A header line that cannot be read, with its number."""


@dataclass
class Header:
    version: str | None = None
    sort_order: str = "unknown"
    group_order: str = "none"
    other: dict[str, str] = field(default_factory=dict)
    rows: dict[str, list[dict]] = field(default_factory=lambda: {"SQ": [], "RG": [], "PG": []})
    comments: list[str] = field(default_factory=list)

    def table(self, spark: SparkSession, kind: str) -> DataFrame:
        names = [x.strip().split()[0] for x in re.split(r",(?![^<]*>)", SCHEMAS[kind])]
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in self.rows[kind]], SCHEMAS[kind])


def _fields(line: str, number: int) -> list[tuple[str, str]]:
    out = []
    for part in line.split("\t")[1:]:
        if len(part) < 3 or part[2] != ":":
            raise HeaderError(f"line {number}: bad field {part!r}")
        out.append((part[:2], part[3:]))
    if len({t for t, _ in out}) != len(out):
        raise HeaderError(f"line {number}: repeated tag")
    return out


def parse_header(text: str) -> Header:
    """Header text to tables. Unknown sort and group orders become unknown and none; other tags are kept; comments are kept whole."""
    h = Header()
    seen: dict[str, dict[str, dict]] = {k: {} for k in TAGS}
    for number, line in enumerate(text.split("\n"), 1):
        line = line.rstrip("\r")
        if not line:
            continue
        if line[0] != "@" or len(line) < 3:
            raise HeaderError(f"line {number}: not a header line")
        kind = line[1:3]
        if kind == "CO":
            h.comments.append(line[4:])
            continue
        if kind == "HD":
            tags = dict(_fields(line, number))
            if "VN" not in tags:
                raise HeaderError(f"line {number}: no version")
            h.version = tags.pop("VN")
            so, go = tags.pop("SO", "unknown"), tags.pop("GO", "none")
            h.sort_order, h.group_order, h.other = so if so in SORT_ORDERS else "unknown", go if go in GROUP_ORDERS else "none", tags
            continue
        if kind not in TAGS:
            raise HeaderError(f"line {number}: unknown record type @{kind}")
        row: dict = {"other_tags": {}}
        for tag, value in _fields(line, number):
            if tag in TAGS[kind]:
                row[TAGS[kind][tag]] = value
            else:
                row["other_tags"][tag] = value
        id_col, name_col = _IDS[kind]
        if not row.get(name_col):
            raise HeaderError(f"line {number}: no identifier")
        try:
            if kind == "SQ":
                row["ln"] = int(row["ln"])
                if not 1 <= row["ln"] <= (1 << 31) - 1:
                    raise ValueError("length out of range")
                if "md5" in row:
                    row["md5"] = bytes.fromhex(row["md5"])
                    if len(row["md5"]) != 16:
                        raise ValueError("bad md5")
            elif kind == "RG" and "insert_size" in row:
                row["insert_size"] = int(row["insert_size"])
                if not -(1 << 31) <= row["insert_size"] < 1 << 31:
                    raise ValueError("insert size out of range")
        except (KeyError, ValueError) as e:
            raise HeaderError(f"line {number}: {e}") from e
        row["other_tags"] = row["other_tags"] or None
        old = seen[kind].get(row[name_col])
        if old is not None:
            if kind == "SQ" and _compatible(old, row):
                old.update({k: v for k, v in row.items() if v is not None and old.get(k) is None})
                continue
            raise HeaderError(f"line {number}: duplicate {name_col} {row[name_col]!r}")
        row[id_col] = len(h.rows[kind])
        seen[kind][row[name_col]] = row
        h.rows[kind].append(row)
    return h


def _compatible(a: dict, b: dict) -> bool:
    return a["ln"] == b["ln"] and all(a.get(k) is None or b.get(k) is None or a[k] == b[k] for k in ("md5", "assembly", "species", "uri"))


def line_expression(kind: str) -> Column:
    """@SQ, @RG or @PG line of a dictionary row: fixed tag order, empty tags left out, other tags last in key order."""
    parts = [F.lit(f"@{kind}")]
    for tag, name in TAGS[kind].items():
        c = F.lower(F.hex(F.col(name))) if name == "md5" else F.col(name).cast("string")
        parts.append(F.when(c != "", F.concat(F.lit(f"{tag}:"), c)))
    other = F.transform(F.array_sort(F.map_entries("other_tags")), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
    parts.append(F.when(F.size("other_tags") > 0, F.array_join(other, "\t")))
    return F.concat_ws("\t", *parts)


def format_header(version: str | None, sort_order: str, group_order: str, refs: DataFrame, groups: DataFrame, programs: DataFrame, comments: list[str]) -> str:
    """Header text in the order HD, SQ, RG, PG, CO. The tables are one file's dictionaries."""
    lines = []
    if version:
        lines.append("\t".join(["@HD", f"VN:{version}", f"SO:{sort_order}", *([f"GO:{group_order}"] if group_order != "none" else [])]))
    for kind, df in (("SQ", refs), ("RG", groups), ("PG", programs)):
        lines += [r[0] for r in df.orderBy(_IDS[kind][0]).select(line_expression(kind)).collect()]
    lines += [f"@CO\t{c}" for c in comments]
    return "".join(x + "\n" for x in lines)


def order_name(code: Column, names: tuple[str, ...]) -> Column:
    """Name of an order code; out of range is the first name."""
    out = F.lit(names[0])
    for i, n in enumerate(names[1:], 1):
        out = F.when(code == i, F.lit(n)).otherwise(out)
    return out


def equal_references(a: str, b: str) -> Column:
    """Rows a and b (struct columns of references) name the same sequence: name and length equal, other fields equal where both are set."""
    same = (F.col(f"{a}.sn") == F.col(f"{b}.sn")) & (F.col(f"{a}.ln") == F.col(f"{b}.ln"))
    for k in ("md5", "assembly", "species", "uri"):
        same = same & (F.col(f"{a}.{k}").isNull() | F.col(f"{b}.{k}").isNull() | (F.col(f"{a}.{k}") == F.col(f"{b}.{k}")))
    sorted_tags = lambda x: F.coalesce(F.array_sort(F.map_entries(F.col(f"{x}.other_tags"))), F.expr("CAST(array() AS ARRAY<STRUCT<key: STRING, value: STRING>>)"))
    return same & (sorted_tags(a) == sorted_tags(b))


_FIELDS = ("md5", "assembly", "species", "uri")


def _added(er: Column, r: Column) -> Column:
    """The reference that a dictionary holds after r is added to it where er has its name: er if both are alike; r with what er knows beyond if r has the same
    length and no tags of its own kind; else marked as a conflict."""
    differ = er["ln"] != r["ln"]
    for k in _FIELDS:
        differ = differ | (er[k].isNotNull() & r[k].isNotNull() & (er[k] != r[k]))
    alike = ~differ & (er["tags"] == r["tags"])
    # one struct of plain choices, so that the fold stays within its type
    choose = lambda k, new: F.when(alike, er[k]).otherwise(new).alias(k)
    conflict = er["conflict"] | (~alike & ((er["ln"] != r["ln"]) | (F.size(r["tags"]) > 0)))
    return F.struct(choose("ln", r["ln"]), *[choose(k, F.coalesce(r[k], er[k])) for k in _FIELDS], choose("tags", r["tags"]), F.coalesce(conflict, F.lit(False)).alias("conflict"))


def merge_references(refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged, links) of the references of several sources: _src_id, ref_id, sn, ln and, as far as there are such columns, md5, assembly, species, uri and
    other_tags.

    A name that several sources have is added in their order as _added says; a conflict, of different lengths above all, raises when the result is
    computed. Merged ids follow the first source and place that names a reference. links maps (_src_id, old_id) to new_id. Null names are left out.
    The ids are given by one task: a row a name, bounded by what the header of one file may hold."""
    have = set(refs.columns)
    tags = F.array_sort(F.map_entries("other_tags")) if "other_tags" in have else F.lit(None)
    kind = "ARRAY<STRUCT<key: STRING, value: STRING>>"
    fields = [F.col(k) if k in have else F.lit(None).cast("binary" if k == "md5" else "string").alias(k) for k in _FIELDS]
    r = refs.where("sn IS NOT NULL").select("_src_id", "ref_id", "sn", F.col("ln").cast("int").alias("ln"), *fields, F.coalesce(tags.cast(kind), F.expr(f"CAST(array() AS {kind})")).alias("tags"))
    state = F.struct("ln", *_FIELDS, "tags")
    # what the source before said in the same words changes nothing
    changes = r.withColumn("__new", ~F.coalesce(F.lag(state).over(Window.partitionBy("sn").orderBy("_src_id", "ref_id")).eqNullSafe(state), F.lit(False))).where("__new")
    steps = changes.groupBy("sn").agg(F.array_sort(F.collect_list(F.struct("_src_id", "ref_id", *["ln", *_FIELDS, "tags"], F.lit(False).alias("conflict")))).alias("steps"))
    keep = lambda x: F.struct(*[x[k].alias(k) for k in ("ln", *_FIELDS, "tags", "conflict")])
    folded = steps.select(
        "sn", F.struct(F.col("steps")[0]["_src_id"].alias("_src_id"), F.col("steps")[0]["ref_id"].alias("ref_id")).alias("first"),
        F.aggregate(F.slice("steps", 2, F.greatest(F.size("steps") - 1, F.lit(0))), keep(F.col("steps")[0]), _added).alias("x"),
    )
    failure = F.raise_error(F.concat(F.lit("references of one name with different lengths or fields: "), F.col("sn")))
    ln = F.when(F.col("x.conflict"), failure.cast("int")).otherwise(F.col("x.ln")).alias("ln")
    merged = folded.select((F.row_number().over(Window.orderBy("first")) - 1).cast("int").alias("new_id"), "sn", ln, *[f"x.{k}" for k in _FIELDS if k in have], *([F.when(F.size("x.tags") > 0, F.map_from_entries("x.tags")).alias("other_tags")] if "other_tags" in have else []))
    links = refs.join(merged.select("sn", "new_id"), "sn").select("_src_id", F.col("ref_id").alias("old_id"), "new_id")
    return merged, links


def merge_headers(refs: DataFrame, groups: DataFrame, programs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(references, links, groups, programs) of the merged header; sort order and grouping of it are unknown and none. Groups and programs are the first
    source's. All tables have _src_id."""
    merged, links = merge_references(refs)
    first = refs.agg(F.min("_src_id").alias("_src_id"))  # a row
    return merged, links, groups.join(F.broadcast(first), "_src_id"), programs.join(F.broadcast(first), "_src_id")


def add_references(refs: DataFrame, new: DataFrame) -> DataFrame:
    """Reference dictionary (ref_id, sn, ln, ...) with new ones (ord, sn, ln, ...) at the end, in their order. A known name is checked: nothing happens if both are
    alike, fields are filled where compatible, else the result raises when computed."""
    columns = ["sn", "ln", *_FIELDS, "other_tags"]
    old, add = refs.select(F.lit(0).alias("_src_id"), "ref_id", *columns), new.select(F.lit(1).alias("_src_id"), F.col("ord").cast("int").alias("ref_id"), *columns)
    return merge_references(old.unionByName(add))[0].withColumnRenamed("new_id", "ref_id")


def add_rows(table: DataFrame, new: DataFrame, id_col: str, name_col: str, strict: bool = False) -> DataFrame:
    """Dictionary rows (groups, programs) with new ones at the end, in name order; a name that is there already stays as it is, or raises with strict when
    the result is computed. One task numbers the new rows, which one header holds."""
    known = table.select(name_col).distinct().withColumn("__known", F.lit(True))
    marked = new.dropDuplicates([name_col]).join(known, name_col, "left")
    if strict:
        taken = F.raise_error(F.concat(F.lit("name taken: "), F.col(name_col)))
        marked = marked.withColumn(name_col, F.when(F.col("__known"), taken.cast("string")).otherwise(F.col(name_col)))
    fresh = marked.where(F.lit(True) if strict else F.col("__known").isNull())
    start = table.agg(F.coalesce(F.max(id_col) + 1, F.lit(0)).alias("n")).head()["n"]
    numbered = fresh.withColumn(id_col, (F.row_number().over(Window.orderBy(name_col)) - 1 + F.lit(start)).cast("int"))
    return table.unionByName(numbered.select(*table.columns))


def remove_rows(table: DataFrame, names: list[str], id_col: str, name_col: str) -> DataFrame:
    """Dictionary without the names; later ids move down. One task numbers the rows, which one header holds."""
    kept = table.where(~F.col(name_col).isin(names))
    return kept.withColumn(id_col, (F.row_number().over(Window.orderBy(id_col)) - 1).cast("int"))


def rename_row(table: DataFrame, old: str, new: str, name_col: str) -> DataFrame:
    """Raises when computed if the new name is taken by another row."""
    taken = F.max(F.col(name_col) == new).over(Window.partitionBy(F.lit(1)))
    hit = F.col(name_col) == old
    value = F.when(hit & taken & F.lit(old != new), F.raise_error(F.lit(f"name taken: {new}")).cast("string")).when(hit, F.lit(new)).otherwise(F.col(name_col))
    return table.withColumn(name_col, value)


def row_problem(kind: str) -> Column:
    """What keeps a dictionary row from being one, null if nothing does: no name, a length out of 1..2^31-1, an md5 that is not 16 bytes, an insert size
    beyond 32 bits."""
    out = F.when(F.coalesce(F.col(_IDS[kind][1]), F.lit("")) == "", F.lit("no name"))
    if kind == "SQ":
        out = out.when(~F.coalesce(F.col("ln").cast("bigint").between(1, (1 << 31) - 1), F.lit(False)), F.lit("length out of range"))
        out = out.when(F.col("md5").isNotNull() & (F.octet_length("md5") != 16), F.lit("bad md5"))
    elif kind == "RG":
        out = out.when(~F.col("insert_size").cast("bigint").between(-(1 << 31), (1 << 31) - 1), F.lit("insert size out of range"))
    return out


def new_rows(df: DataFrame, kind: str, ord_: str) -> DataFrame:
    """Dictionary of the rows of df in the order of ord_, numbered from 0; columns it lacks are null. Invalid rows raise when computed. One task numbers them."""
    id_col, name = _IDS[kind]
    columns = {x.strip().split()[0]: x.strip().split(None, 1)[1] for x in re.split(r",(?![^<]*>)", SCHEMAS[kind])}
    full = df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns and c != id_col})
    problem = row_problem(kind)
    checked = F.when(problem.isNull(), F.col(name)).otherwise(F.raise_error(F.concat_ws(": ", problem, F.col(name))).cast("string"))
    numbered = full.withColumn(id_col, (F.row_number().over(Window.orderBy(ord_)) - 1).cast("int")).withColumn(name, checked)
    return numbered.select(*[F.col(c).cast(t).alias(c) for c, t in columns.items()])


def get_tag(kind: str, tag: str) -> Column:
    """Text of a tag of a dictionary row, of a known tag or another; null if it has none."""
    name = TAGS[kind].get(tag)
    return F.element_at("other_tags", tag) if name is None else F.lower(F.hex(name)) if name == "md5" else F.col(name).cast("string")


def set_tag(df: DataFrame, kind: str, tag: str, value: Column) -> DataFrame:
    """df with the tag set to the text value, or deleted where it is empty; null leaves it as it is. Values are checked and raise when computed; the name of a row
    is not deleted (see rename_row for a new one)."""
    name = TAGS[kind].get(tag)
    if name is None:
        rest = F.map_filter(F.coalesce("other_tags", F.expr("CAST(map() AS MAP<STRING, STRING>)")), lambda k, _: k != tag)
        new = F.when(value.isNull(), F.col("other_tags")).when(value == "", rest).otherwise(F.map_concat(rest, F.create_map(F.lit(tag), value)))
        return df.withColumn("other_tags", new)
    kind_ = dict(df.dtypes)[name]
    fail = lambda why: F.raise_error(F.concat(F.lit(f"{why}: "), value)).cast(kind_)
    typed = F.unhex(value) if name == "md5" else value.try_cast(kind_)
    ok = F.octet_length(typed) == 16 if name == "md5" else typed.between(1, (1 << 31) - 1) if name == "ln" else typed.isNotNull()
    empty = fail("a row keeps its name and length") if name in (_IDS[kind][1], "ln") else F.lit(None).cast(kind_)
    return df.withColumn(name, F.when(value.isNull(), F.col(name)).when(value == "", empty).when(F.coalesce(ok, F.lit(False)), typed).otherwise(fail(f"bad {tag}")))


def set_length(refs: DataFrame, name: str, length: int) -> DataFrame:
    """Reference dictionary with a new length of one reference."""
    if not 1 <= length < 1 << 31:
        raise HeaderError("length out of range")
    return refs.withColumn("ln", F.when(F.col("sn") == name, F.lit(length)).otherwise(F.col("ln")))


def reference_fields(ref: str) -> dict[str, Column]:
    """Fields of a reference given as a struct column that may be null: name `*`, id and length -1, texts empty."""
    out = {"name": F.coalesce(F.col(f"{ref}.sn"), F.lit("*")), "id": F.coalesce(F.col(f"{ref}.ref_id"), F.lit(-1)), "len": F.coalesce(F.col(f"{ref}.ln"), F.lit(-1))}
    return out | {k: F.coalesce(F.lower(F.hex(f"{ref}.md5")) if k == "md5" else F.col(f"{ref}.{k}"), F.lit("")) for k in _FIELDS}


def parse_headers(texts: DataFrame, kind: str, key: str = "_src_id") -> DataFrame:
    """key and the rows of a kind (SQ, RG, PG) of many headers: a row a header with its whole text in `text`. A bad line raises, with the key and its number."""
    names = [x.strip().split()[0] for x in re.split(r",(?![^<]*>)", SCHEMAS[kind])]
    key_type = dict(texts.dtypes)[key]

    def parse(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for k, text in zip(pdf[key], pdf["text"], strict=True):
                try:
                    rows += [(k, *[r.get(n) for n in names]) for r in parse_header(text or "").rows[kind]]
                except HeaderError as e:
                    raise HeaderError(f"{key} {k}: {e}") from e
            yield pd.DataFrame(rows, columns=[key, *names]).astype({"insert_size": "Int32"} if kind == "RG" else {})

    return texts.select(key, "text").mapInPandas(parse, f"{key} {key_type}, {SCHEMAS[kind]}")


def validate_records(records: DataFrame, groups: DataFrame, programs: DataFrame) -> DataFrame:
    """(row_id, problem) of records whose PG or RG tag is absent or names nothing in their source's header, or whose LB or PU tag differs from their group.

    A source without programs (groups) is not checked for them. Dictionaries are reduced to one row an (source, name) first."""
    tags = {t: first_tag(F.col("aux"), t)["sval"] for t in ("PG", "RG", "LB", "PU")}
    r = records.select("row_id", "_src_id", *[v.alias(f"__{k}") for k, v in tags.items()])
    p = programs.select("_src_id", F.col("uid").alias("__PG")).distinct().withColumn("__p", F.lit(True))
    g = groups.groupBy("_src_id", F.col("id").alias("__RG")).agg(F.min("library").alias("__lib"), F.min("platform_unit").alias("__unit"), F.lit(True).alias("__g"))
    has_p, has_g = p.groupBy("_src_id").agg(F.lit(True).alias("__hp")), g.groupBy("_src_id").agg(F.lit(True).alias("__hg"))
    j = r.join(p, ["_src_id", "__PG"], "left").join(g, ["_src_id", "__RG"], "left").join(has_p, "_src_id", "left").join(has_g, "_src_id", "left")
    problem = (
        F.when(F.col("__hp") & F.col("__p").isNull(), "program not found")
        .when(F.col("__hg") & F.col("__g").isNull(), "read group not found")
        .when(F.col("__PU") != F.col("__unit"), "platform unit differs")
        .when(F.col("__LB") != F.col("__lib"), "library differs")
    )
    return j.select("row_id", problem.alias("problem")).where("problem IS NOT NULL")
