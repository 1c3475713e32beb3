"""Queries p7 to p9 over the corpus tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.mixing import mix_sources, mixture_report
from readloom.llm.packing import pack_documents, packing_report, token_sizes
from readloom.llm.subjects import subject_areas
from readloom.llm.tokens import with_token_counts
from readloom.session import cut, table


def p7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(token_sizes(table(spark, sf_dir, "documents"), with_token_counts), table(spark, sf_dir, "pack_sizes"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_report(p7_packing(spark, sf_dir))


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = with_token_counts(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "source", "n_tokens")
    return mix_sources(docs, table(spark, sf_dir, "source_targets"))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)[0].where(F.col("copies") > 0)


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture_report(*_mixture(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subject_areas(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels"), table(spark, sf_dir, "subjects"))


def p7_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a pack: documents packed, and what must be 0: containers over capacity, documents whose tokens are not all in it once, documents split though they fit."""
    sizes = token_sizes(table(spark, sf_dir, "documents"), with_token_counts)
    packed = cut(pack_documents(sizes, table(spark, sf_dir, "pack_sizes")))
    loads = packed.groupBy("pack_id", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("n"))
    over = loads.groupBy("pack_id").agg(F.count_if((F.col("n") > F.col("capacity_tokens")) & F.col("container_id").isNotNull()).alias("over_capacity"))
    pieces = packed.groupBy("pack_id", "capacity_tokens", "doc_id").agg(F.sum("n_tokens").alias("packed"), F.count("*").alias("pieces"), F.count_distinct("from_token").alias("starts"), F.max(F.col("from_token") + F.col("n_tokens")).alias("top"))
    whole = (F.col("packed") == F.col("n_tokens")) & (F.col("starts") == F.col("pieces")) & (F.col("top") == F.col("n_tokens"))
    docs = pieces.join(sizes, "doc_id").groupBy("pack_id", "capacity_tokens").agg(
        F.count("*").alias("documents"), F.count_if(~whole).alias("incomplete"), F.count_if((F.col("pieces") > 1) & (F.col("n_tokens") <= F.col("capacity_tokens"))).alias("split_needlessly")
    )
    return docs.join(over, "pack_id").select("pack_id", "capacity_tokens", "documents", "over_capacity", "incomplete", "split_needlessly")


P7_CHECK_SQL = "SELECT pack_id, capacity_tokens, (SELECT count(*) FROM documents) AS documents, 0 AS over_capacity, 0 AS incomplete, 0 AS split_needlessly FROM pack_sizes"


def p8_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a listed source: its documents with text, and what must be 0: documents used too often, sources over budget, documents that what is missing had room for."""
    selection, budgets = _mixture(spark, sf_dir)
    selection = cut(selection)
    report = mixture_report(selection, budgets)
    least = selection.groupBy("source").agg(F.min("copies").alias("least"))
    state = report.select("source", "max_repeats", "missing_tokens").join(least, "source")
    often, fits = (F.col("copies") > F.col("max_repeats")) | (F.col("copies") < 0), (F.col("copies") == F.col("least")) & (F.col("copies") < F.col("max_repeats")) & (F.col("n_tokens") <= F.col("missing_tokens"))
    counts = selection.join(state, "source").groupBy("source").agg(F.count_if(often).alias("over_repeats"), F.count_if(fits).alias("had_room"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    return report.join(counts, "source", "left").select(
        "source", "max_repeats", "documents", zero(F.col("over_repeats")).alias("over_repeats"), (F.col("used_tokens") > F.col("budget")).cast("int").alias("over_budget"), zero(F.col("had_room")).alias("had_room")
    )


P8_CHECK_SQL = """SELECT t.source, t.max_repeats, count(d.doc_id) AS documents, 0 AS over_repeats, 0 AS over_budget, 0 AS had_room
FROM source_targets t LEFT JOIN documents d ON d.source = t.source AND length(d.text) > 0 GROUP BY 1, 2"""


def p9_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: result rows of unknown subjects, of unknown or empty documents and repeated ones (all 0), and whether nine in ten hand labels were found, where
    there are the 50 or more labelled documents that learning and calibration take."""
    docs, labels, subjects = (table(spark, sf_dir, n) for n in ("documents", "doc_labels", "subjects"))
    found = cut(subject_areas(docs, labels, subjects))
    names = subjects.select("subject").distinct()
    known = docs.where("length(text) > 0").select("doc_id")
    given = labels.join(known, "doc_id", "left_semi").join(names, "subject", "left_semi").select("doc_id", "subject").distinct()
    one = lambda df, name: df.agg(F.count("*").alias(name))
    share = given.join(found.distinct().withColumn("hit", F.lit(1)), ["doc_id", "subject"], "left").agg(((F.count_distinct("doc_id") < 50) | (F.avg(F.coalesce("hit", F.lit(0))) >= 0.9)).alias("labels_found"))
    parts = [one(found.join(names, "subject", "left_anti"), "unknown_subjects"), one(found.join(known, "doc_id", "left_anti"), "unknown_documents"), one(found.groupBy("doc_id", "subject").count().where("count > 1"), "repeated"), share]
    keyed = [p.withColumn("k", F.lit(1)) for p in parts]  # a row each
    return reduce(lambda a, b: a.join(b, "k"), keyed).drop("k")


P9_CHECK_SQL = "SELECT 0 AS unknown_subjects, 0 AS unknown_documents, 0 AS repeated, TRUE AS labels_found"

QUERIES = {"p7_packing": p7_packing, "p7_report": p7_report, "p8_mixture": p8_mixture, "p8_report": p8_report, "p9_found": p9_found, "p7_check": p7_check, "p8_check": p8_check, "p9_check": p9_check}
SQL: dict[str, str] = {"p7_check": P7_CHECK_SQL, "p8_check": P8_CHECK_SQL, "p9_check": P9_CHECK_SQL}
