"""Filling fixed-capacity sequences with documents, balanced by cost.

Documents are spread over hash shards of bounded size; each shard packs its documents alone, so nothing is ever global but the number of shards. Only
the last few sequences of a shard stay short. Within a shard, documents in descending order go to the lowest-cost open sequence that still has room for
them; cost is linear in the tokens plus quadratic in each document, as attention within a document is.
"""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.session import cut

#: Documents and tokens that a shard has on average; one shard is one task's work.
SHARD_DOCS, SHARD_TOKENS = 16_384, 32_000_000
#: Capacities that one expression lists; more are laid out in several.
PLANS = 100
#: Capacity from which open sequences are scanned instead of kept by free room. A shard has few of them then, and memory does not grow with the capacity.
WIDE = 1 << 20
#: Cost of a document of n tokens: n + n * n / ATTENTION.
ATTENTION = 4096.0
#: Share of the capacity: sequences that an item fills up to so little are preferred, the cheapest of them first.
SNUG = 0.125


def pack(sizes: np.ndarray, capacity: int, attention: float = ATTENTION, snug: float = SNUG) -> np.ndarray:
    """Sequence number of each item; sizes descending, each in 1..capacity.

    Starts with the fewest sequences that could hold the total and opens another only when an item has room nowhere. Open sequences lie in heaps by
    free room, and a tournament tree over the room finds the cheapest one with enough of it in log(capacity) steps; from WIDE on they are scanned."""
    if capacity >= WIDE:
        return _pack_wide(sizes, capacity, attention, snug)
    n = len(sizes)
    out = np.empty(n, dtype=np.int64)
    if not n:
        return out
    width = 1
    while width < capacity + 1:
        width *= 2
    inf = float("inf")
    heaps: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
    tree = [inf] * (2 * width)

    def refresh(room: int) -> None:
        i = room + width
        tree[i] = heaps[room][0][0] if heaps[room] else inf
        i //= 2
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            v = a if a < b else b
            if tree[i] == v:
                return
            tree[i] = v
            i //= 2

    opened = -(-int(sizes.sum()) // capacity)
    heaps[capacity] = [(0.0, b) for b in range(opened)]
    refresh(capacity)
    def cheapest(least: int, most: int) -> tuple[float, int]:
        lo, hi, best, at = least + width, most + 1 + width, inf, 0
        while lo < hi:
            if lo & 1:
                if tree[lo] < best:
                    best, at = tree[lo], lo
                lo += 1
            if hi & 1:
                hi -= 1
                if tree[hi] < best:
                    best, at = tree[hi], hi
            lo //= 2
            hi //= 2
        return best, at

    slack = int(capacity * snug)
    for i, size in enumerate(sizes.tolist()):
        best, at = cheapest(size, min(size + slack, capacity))
        if at == 0:
            best, at = cheapest(size, capacity)
        if at == 0:
            room, cost, b = capacity, 0.0, opened
            opened += 1
        else:
            while at < width:
                at = 2 * at if tree[2 * at] == best else 2 * at + 1
            room = at - width
            cost, b = heapq.heappop(heaps[room])
            refresh(room)
        out[i] = b
        heapq.heappush(heaps[room - size], (cost + size + size * size / attention, b))
        refresh(room - size)
    return out


def _pack_wide(sizes: np.ndarray, capacity: int, attention: float, snug: float) -> np.ndarray:
    """As pack, by a scan of the open sequences."""
    out = np.empty(len(sizes), dtype=np.int64)
    room, slack = np.full(-(-int(sizes.sum()) // capacity), capacity, np.int64), int(capacity * snug)
    cost = np.zeros(len(room))
    for i, size in enumerate(sizes.tolist()):
        fits = room >= size
        near = fits & (room <= size + slack)
        if near.any():
            fits = near
        elif not fits.any():
            room, cost, fits = np.append(room, capacity), np.append(cost, 0.0), np.append(fits, True)
        b = int(np.where(fits, cost, np.inf).argmin())
        out[i] = b
        room[b] -= size
        cost[b] += size + size * size / attention
    return out


def pack_documents(docs: DataFrame, capacities: DataFrame, shard_docs: int = SHARD_DOCS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(pack_id, capacity_tokens, container_id, doc_id, piece, from_token, n_tokens): every token of every document is in one container of each pack.

    docs: doc_id, n_tokens. capacities: pack_id, capacity_tokens. A document over the capacity is split into full pieces, each a container, and a rest
    that is packed as any other; no other document is split. A document without tokens has one row with a null container. A null size counts as 0, a
    null or non-positive capacity packs nothing, a null pack_id is a pack like any other. Rows of repeated doc_ids are items of their own. container_id is unique within a pack."""
    totals = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("t")).head()
    shards = max(1, -(-totals["n"] // shard_docs), -(-totals["t"] // shard_tokens))
    sized = docs.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"), F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"))
    # every plan packs all documents, so the plans are few; any number of them is served
    plans = sorted(capacities.where("capacity_tokens > 0").select("pack_id", "capacity_tokens").distinct().collect(), key=lambda r: (r[0] is not None, *r))
    each = [F.struct(F.lit(p).cast("int").alias("pack_id"), F.lit(c).cast("int").alias("capacity_tokens")) for p, c in plans]
    none = F.expr("CAST(array() AS ARRAY<STRUCT<pack_id: INT, capacity_tokens: INT>>)")
    blocks = [F.array(*each[i : i + PLANS]) for i in range(0, len(each), PLANS)] or [none]
    items = reduce(DataFrame.unionByName, [sized.select("*", F.inline(b)) for b in blocks])

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pack_id, capacity, shard = key[0], int(key[1]), int(key[2])
        n = pdf["n_tokens"].to_numpy()
        full = n // capacity
        rest = n - full * capacity
        order = np.lexsort((pdf["doc_id"].to_numpy(), -rest))
        order = order[rest[order] > 0]
        bins = pack(rest[order], capacity)
        used = int(bins.max()) + 1 if len(bins) else 0
        which = np.repeat(np.arange(len(n)), full)
        piece = np.arange(len(which)) - np.repeat(np.cumsum(full) - full, full)
        empty = np.flatnonzero(n == 0)
        rows = np.concatenate([order, which, empty])
        base = shard << 32
        container = pd.array(np.concatenate([base + bins, base + used + np.arange(len(which)), np.zeros(len(empty), np.int64)]), dtype="Int64")
        container[len(rows) - len(empty) :] = pd.NA
        pieces = np.concatenate([full[order], piece, np.zeros(len(empty), np.int64)])
        return pd.DataFrame(
            {
                "pack_id": pd.array([pack_id] * len(rows), dtype="Int32"),
                "capacity_tokens": capacity,
                "container_id": container,
                "doc_id": pdf["doc_id"].to_numpy()[rows],
                "piece": pieces.astype(np.int32),
                "from_token": pieces * capacity,
                "n_tokens": np.concatenate([rest[order], np.full(len(which), capacity), np.zeros(len(empty), np.int64)]),
            }
        )

    schema = "pack_id INT, capacity_tokens INT, container_id BIGINT, doc_id BIGINT, piece INT, from_token BIGINT, n_tokens BIGINT"
    return items.groupBy("pack_id", "capacity_tokens", "shard").applyInPandas(fill, schema)


def packing_report(packed: DataFrame, attention: float = ATTENTION) -> DataFrame:
    """A row a pack: containers, tokens, share of unused space, and the mean, the largest and the relative spread (deviation over mean) of container costs."""
    c = packed.where("container_id IS NOT NULL").groupBy("pack_id", "capacity_tokens", "container_id").agg(
        F.sum("n_tokens").alias("used"), F.sum(F.col("n_tokens") + F.col("n_tokens") * F.col("n_tokens") / attention).alias("cost")
    )
    return c.groupBy("pack_id", "capacity_tokens").agg(
        F.count("*").alias("containers"),
        F.sum("used").alias("tokens"),
        (1 - F.sum("used") / (F.count("*") * F.first("capacity_tokens"))).alias("unused_share"),
        F.avg("cost").alias("mean_cost"),
        F.max("cost").alias("max_cost"),
        (F.stddev_pop("cost") / F.avg("cost")).alias("cost_spread"),
    )


def token_sizes(documents: DataFrame, count) -> DataFrame:
    """doc_id, n_tokens of all documents, written once since every pack reads it."""
    return cut(count(documents.select("doc_id", "text")).select("doc_id", "n_tokens"))
