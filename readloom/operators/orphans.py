"""References to records that do not exist at the time of the reference.

The bulk of the references is cleared with bitmaps, the rest is decided row by row:

1. References are combined to (target, key, period) with the earliest and latest time before anything is shuffled.
2. Keys are dictionary-encoded: a hash bucket (the key range) and a dense number in it. A bitmap is kept as its non-zero 64-bit words, one row a word.
3. The parent bitmap of a (key range, period) has a bit for every key of which one parent row lives from the earliest to the latest reference.
4. reference AND NOT parent leaves the (key, period) pairs that may hold an orphan. They are decoded through the dictionary.
5. For these pairs alone the referring rows are held against the step function of the key's life: before the first load, live, or removed. Rows of other
   pairs are dropped where they are read: the open pairs are broadcast if they are few, else a bitmap of their hashes is, whose size is fixed, and
   only what passes it is exchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.session import SMALL_ROWS, cut

#: Key ranges of the dictionary a shuffle partition, so that they grow with the cluster; a range is numbered by one task and may hold any number of keys.
KEY_RANGES = 16
#: Referring rows of one surviving (key, period) that go to one task; more are spread.
PAIR_ROWS = 100_000
#: 64-bit words of the bitmap of open pairs: 16 million bits, 2 MB of them.
FILTER_WORDS = 1 << 18
FOREVER, NEVER = "TIMESTAMP '9999-12-31 00:00:00'", "TIMESTAMP '0001-01-01 00:00:00'"


def month_of(t: Column) -> Column:
    """UTC month yyyy-MM, whatever the session's zone."""
    us = F.unix_micros(t)
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.try_divide(us - F.pmod(us, F.lit(86_400_000_000)), F.lit(86_400_000_000)).cast("int")), "yyyy-MM")


def _passing(rows: DataFrame, pairs: DataFrame, key: list[str]) -> DataFrame:
    """The rows whose key is among pairs, and a few more: by a broadcast bitmap of the hashes, of at most FILTER_WORDS words whatever the data."""
    h = F.xxhash64(*key)
    word, bit = F.pmod(F.shiftright(h, 6), F.lit(FILTER_WORDS)).cast("int").alias("__word"), F.pmod(h, F.lit(64)).cast("int").alias("__bit")
    words = pairs.select(word, bit).groupBy("__word").agg(F.expr("bit_or(shiftleft(1L, __bit))").alias("__bits"))
    marked = rows.select("*", word, bit).join(F.broadcast(words), "__word")
    return marked.where(F.expr("shiftrightunsigned(__bits, __bit) & 1 = 1")).drop("__word", "__bit", "__bits")


def find_orphans(refs: DataFrame, parents: DataFrame, few: int = SMALL_ROWS) -> DataFrame:
    """(tbl, row_id, field, status, period) of every reference without a live parent.

    refs: tbl, row_id, field, target, scope, key, t. parents: target, scope, key, loaded_at, removed_at. A parent lives at t if loaded_at <= t and
    removed_at is null or > t. Status: `missing` (no parent row has the key), `late` (all have loaded_at > t), else `deleted`. Rows with a null key
    refer to nothing. A null scope matches no parent. With a null t no parent lives, the status is `missing` or `deleted` and the period null.
    A parent without loaded_at never lives, but its key is not missing. Repeated parents and references are judged alike. Up to `few` open pairs are
    broadcast.
    """
    key = ["target", "scope", "key"]
    ranges = KEY_RANGES * int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = refs.where("key IS NOT NULL").select("tbl", "row_id", "field", "target", F.coalesce("scope", F.lit("?")).alias("scope"), "key", "t", F.coalesce(month_of(F.col("t")), F.lit("")).alias("period"))
    pairs = r.groupBy(*key, "period").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count("*").alias("rows"))
    numbered = pairs.withColumn("range", F.pmod(F.xxhash64(*key), F.lit(ranges)).cast("int")).withColumn(
        "n", (F.dense_rank().over(Window.partitionBy("target", "range").orderBy("scope", "key")) - 1).cast("bigint")
    )
    dictionary = cut(numbered)

    p = parents.where("key IS NOT NULL AND scope IS NOT NULL").select(
        *key,
        F.coalesce("loaded_at", F.expr(NEVER)).alias("loaded"),
        F.when(F.col("loaded_at").isNull(), F.expr(NEVER)).otherwise(F.coalesce("removed_at", F.expr(FOREVER))).alias("removed"),
    )
    p = p.groupBy(*key, "loaded").agg(F.max("removed").alias("removed"))

    word, bit = F.expr("n div 64"), F.expr("shiftleft(1L, CAST(n % 64 AS INT))")
    place = ["target", "range", "period", "word"]
    referenced = dictionary.select("target", "range", "period", word.alias("word"), bit.alias("bit")).groupBy(*place).agg(F.expr("bit_or(bit)").alias("bits"))
    whole = dictionary.join(p, key).where("loaded <= first AND removed > last")
    living = whole.select("target", "range", "period", word.alias("word"), bit.alias("bit")).groupBy(*place).agg(F.expr("bit_or(bit)").alias("live"))
    left = referenced.join(living, place, "left").select(*place, F.expr("bits & ~coalesce(live, 0L)").alias("bits")).where("bits <> 0")
    decoded = left.select("target", "range", "period", F.explode(F.expr("transform(filter(sequence(0, 63), i -> shiftrightunsigned(bits, i) & 1 = 1), i -> word * 64 + i)")).alias("n"))
    open_pairs = cut(dictionary.join(decoded, ["target", "range", "period", "n"], "left_semi").select(*key, "period", "first", "last", "rows"))

    by_load = Window.partitionBy(*key).orderBy("loaded")
    life = p.join(open_pairs, key, "left_semi").select(
        *key,
        F.col("loaded").alias("lo"),
        F.coalesce(F.lead("loaded").over(by_load), F.expr("TIMESTAMP '9999-12-31 00:00:01'")).alias("hi"),
        F.max("removed").over(by_load.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("until"),
    )
    before = life.groupBy(*key).agg(F.min("lo").alias("hi")).where(f"hi > {NEVER}").select(*key, F.expr(NEVER).alias("lo"), "hi", F.expr("CAST(NULL AS TIMESTAMP)").alias("until"))
    steps = life.unionByName(before)
    last = F.coalesce("last", F.expr(FOREVER))
    # no step at all: missing. Only steps that the period's references can meet are joined.
    cases = open_pairs.join(steps, key, "left").where(F.col("lo").isNull() | (F.col("last").isNull() | ((F.col("lo") <= last) & (F.col("hi") > F.col("first")))))
    rows = r.withColumn("at", F.coalesce("t", F.expr(FOREVER)))
    pair = [*key, "period"]
    if (cases := cut(cases.select(*pair, "lo", "hi", "until", "rows"))).limit(few + 1).count() <= few:
        met = rows.join(F.broadcast(cases), pair)
    else:
        # a pair's rows go to as many tasks as they need
        spread = F.ceil(F.col("rows") / PAIR_ROWS).cast("int")
        salted = cases.select("*", F.explode(F.sequence(F.lit(0), spread - 1)).alias("salt"))
        hot = cases.where(F.col("rows") > PAIR_ROWS).groupBy(*pair).agg(F.max(spread).alias("spread"))
        rows = _passing(rows, open_pairs, pair).join(F.broadcast(hot) if hot.limit(few + 1).count() <= few else hot, pair, "left")
        met = rows.withColumn("salt", F.pmod(F.xxhash64("row_id"), F.coalesce("spread", F.lit(1))).cast("int")).join(salted, [*pair, "salt"])
    met = met.where("lo IS NULL OR (lo <= at AND at < hi)").where("until IS NULL OR until <= at")
    status = F.when(F.col("lo").isNull(), "missing").when(F.col("until").isNull(), "late").otherwise("deleted")
    return met.select("tbl", "row_id", "field", status.alias("status"), F.when(F.col("period") != "", F.col("period")).alias("period"))
