"""Mixing sources to target shares of a token budget.

Per source the budget is met by whole passes over its documents as long as they fit, then by a selection for the remaining budget: documents are
counted by exact token length, about the same share of every length is drawn by seed, and a knapsack over the documents left, in seeded order, closes the
rest to the token. Only counts by length go into the planning; the documents are then chosen by seeded rank within their length.
"""

from __future__ import annotations

import math
import random

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.session import broadcast_if_small, cut

#: Tokens that the knapsack may be given if fewer do not close the budget; twice the longest document if that is more. Its work is this many bits a length.
KNAPSACK_TOKENS = 1 << 16
#: Draws for a source whose budget is not met to the token.
DRAWS = 24
#: Slices of a length's documents by seeded hash; ranks are made within a slice, so one length may hold any number of documents.
SLICES = 1024
SEED = 20240901


def subset_sum(lengths: list[int], counts: list[int], budget: int, rnd: random.Random | None = None) -> dict[int, int]:
    """How many of each length to take so that the sum is as near under budget as possible. Bitset dynamic programme over binary splits of the counts, in
    the order of rnd; it ends with the item that reaches the budget, so the order decides which lengths are used."""
    items: list[tuple[int, int]] = []
    for size, count in zip(lengths, counts, strict=True):
        count, part = min(count, budget // size if size else 0), 1
        while count > 0:
            take = min(part, count)
            items.append((size, take))
            count -= take
            part *= 2
    if rnd:
        rnd.shuffle(items)
    reach, mask, news = 1, (1 << (budget + 1)) - 1, []
    for size, take in items:
        new = (reach << (size * take)) & mask & ~reach
        news.append(new)
        reach |= new
        if reach >> budget & 1:
            break
    at, out = reach.bit_length() - 1, {}
    # a sum first reached by an item rests on one that the items before it reach
    for (size, take), new in zip(reversed(items[: len(news)]), reversed(news), strict=True):
        if new >> at & 1:
            out[size] = out.get(size, 0) + take
            at -= size * take
    return out


def draw_lengths(counts: dict[int, int], rest: int, low: int, high: int, rnd: random.Random) -> tuple[dict[int, int], int]:
    """(documents by length, tokens left of rest): the same share of every length by seeded rounding, then single documents in seeded order, added or
    taken back until low to high tokens are left. high - low is at least the longest length. Every length has the same chance."""
    share = max(0, rest - (low + high) // 2) / sum(n * c for n, c in counts.items())
    taken = {n: min(c, int(c * share + rnd.random())) for n, c in counts.items()}
    left = rest - sum(n * c for n, c in taken.items())
    step = 1 if left > high else -1
    while (left > high) if step > 0 else (left < low and any(taken.values())):
        free = {n: c - taken[n] if step > 0 else taken[n] for n, c in counts.items()}
        for n in sorted((n for n, c in free.items() if c), key=lambda n: rnd.expovariate(free[n])):  # as documents in random order, the first of each length
            if low <= left <= high:
                break
            taken[n] += step
            left -= step * n
    return taken, left


def plan_lengths(lengths: list[int], counts: list[int], budget: int, max_repeats: int, knapsack: int = KNAPSACK_TOKENS, seed: int | str = SEED) -> tuple[int, dict[int, int]]:
    """(whole passes, extra documents by length). The extra documents are used once more than the passes say. The knapsack gets one to two times the
    longest document, so that all lengths may take part, and more only while that does not meet the budget."""
    have = dict(zip(lengths, counts, strict=True))
    total = sum(n * c for n, c in have.items())
    if total == 0 or budget <= 0:
        return 0, {}
    passes = min(budget // total, max_repeats)
    rest = budget - passes * total
    if passes == max_repeats or rest == 0:
        return passes, {}
    high = 2 * max(n for n, c in have.items() if c)
    most, best, missing, least = max(knapsack, high), {}, rest + 1, rest % math.gcd(*(n for n, c in have.items() if c))
    for draw in range(DRAWS):
        rnd = random.Random(f"{seed} {draw}")
        taken, left = draw_lengths(have, rest, high // 2, high, rnd)
        spare = {n: c - taken[n] for n, c in have.items() if c > taken[n] and n <= left}
        close = subset_sum(list(spare), list(spare.values()), left, rnd)
        if (miss := left - sum(n * c for n, c in close.items())) < missing:
            missing, best = miss, {n: c + close.get(n, 0) for n, c in taken.items()}
        if missing == least or left == rest:  # all of the rest was the knapsack's, so nothing is nearer
            break
        high = min(2 * high, most)
    return passes, {n: c for n, c in best.items() if c}


def mix_sources(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(selection, budgets). selection: doc_id, source, n_tokens, copies, of every document of a listed source (copies may be 0).

    docs: doc_id, source, n_tokens. targets: source, target_share, max_repeats. total_tokens is the size of the mixture, by default all tokens of
    the listed sources. A source that cannot reach its share within max_repeats gives all it may; what is missing is reported, not made up by others.
    Documents of null or unlisted sources, and documents without tokens, are not used. Rows of a repeated doc_id are documents of their own.
    """
    t = targets.where("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    d = cut(docs.select("doc_id", "source", F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens")).join(broadcast_if_small(t.select("source")), "source"))
    if total_tokens is None:
        total_tokens = d.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("t")).head()["t"]
    budgets = t.withColumn("budget", F.floor(F.col("target_share") * F.lit(total_tokens)).cast("bigint"))
    used = d.where("n_tokens > 0").withColumn("slice", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(SLICES)).cast("int"))
    sliced = cut(used.groupBy("source", "n_tokens", "slice").agg(F.count("*").alias("c")))
    histogram = sliced.groupBy("source", "n_tokens").agg(F.sum("c").alias("c")).join(broadcast_if_small(budgets), "source")

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n_tokens")
        sizes = pdf["n_tokens"].tolist()
        passes, extra = plan_lengths(sizes, pdf["c"].tolist(), int(pdf["budget"].iloc[0]), int(pdf["max_repeats"].iloc[0]), seed=f"{seed} {pdf['source'].iloc[0]}")
        return pd.DataFrame({"source": pdf["source"], "n_tokens": pdf["n_tokens"], "passes": passes, "extra": [extra.get(n, 0) for n in sizes]})

    plans = cut(histogram.groupBy("source").applyInPandas(plan, "source STRING, n_tokens BIGINT, passes INT, extra BIGINT"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("source", "n_tokens").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quotas = sliced.join(plans, ["source", "n_tokens"]).select("source", "n_tokens", "slice", "passes", F.greatest(F.lit(0), F.least("c", F.col("extra") - before)).alias("quota"), "c")
    rank = Window.partitionBy("source", "n_tokens", "slice").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id")
    chosen = used.withColumn("i", F.row_number().over(rank)).join(quotas, ["source", "n_tokens", "slice"])
    selection = chosen.select("doc_id", "source", "n_tokens", (F.col("passes") + (F.col("i") <= F.col("quota")).cast("int")).alias("copies"))
    return selection, budgets


def mixture_report(selection: DataFrame, budgets: DataFrame) -> DataFrame:
    """A row a listed source: target, budget, what it has, what was used, the actual share of the mixture and the most copies of a document."""
    s = selection.groupBy("source").agg(
        F.count("*").alias("documents"), F.sum("n_tokens").alias("source_tokens"), F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"), F.max("copies").alias("most_copies")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    r = budgets.join(s, "source", "left").select("source", "target_share", "max_repeats", "budget", zero("documents"), zero("source_tokens"), zero("used_tokens"), zero("most_copies"))
    total = r.agg(F.coalesce(F.sum("used_tokens"), F.lit(0)).alias("t")).head()["t"]
    return r.select(
        *r.columns, (F.col("used_tokens") / F.lit(max(total, 1))).alias("actual_share"), (F.col("budget") - F.col("used_tokens")).alias("missing_tokens")
    )
