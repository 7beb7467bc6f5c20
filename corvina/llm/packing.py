"""Problem 9: filling fixed-capacity containers with documents measured in tokens.

Cost-balanced packing: the cost of a container is estimated as a linear plus a quadratic part (the attention inside
each of its documents).  Documents are taken in descending order of length and put into the container of lowest cost
among those with room left; one that fits nowhere opens a new container.  A document is split only if it exceeds the
capacity: into full pieces and a rest.

Documents are spread by a hash of their id over shards of about ``shard_items`` items and each shard is packed by one
task, so a task's memory does not grow with the corpus; a shard wastes at most what its last few containers leave open.
Within a shard several numbers of starting containers, from the least possible upwards, are tried and the packing with
the fewest containers (then the least spread of costs) is kept.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from functools import reduce
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.llm.bpe import TOKENIZER_DIR, token_counts
from corvina.session import ship, stage

#: Items packed by one task, and the weights of the linear and the quadratic part of the cost.
SHARD_ITEMS = 8_192
LINEAR, QUADRATIC = 1.0, 1.0 / 1024

#: Numbers of starting containers that are tried, as multiples of the least possible.
STARTS = (1.0, 1.01, 1.03, 1.06, 1.1, 1.2)


def cost(size: int) -> float:
    """Estimated cost of a document of ``size`` tokens."""
    return LINEAR * size + QUADRATIC * size * size


def assign(sizes: Sequence[int], capacity: int, start: int) -> tuple[list[int], list[float]]:
    """Container of each item and cost of each container; ``sizes`` descend and none exceeds ``capacity``.

    Open containers are kept in heaps of (cost, container) by their free room; a tree over the rooms gives the lowest
    cost among all rooms that suffice in logarithmic time.  Entries that no longer hold are dropped when they surface.
    """
    leaves = 1
    while leaves < capacity + 1:
        leaves *= 2
    none = (float("inf"), -1)
    tree = [none] * (2 * leaves)
    heaps: dict[int, list[tuple[float, int]]] = {}
    room: list[int] = []
    costs: list[float] = []

    def settle(r: int) -> None:
        heap = heaps.get(r)
        node = r + leaves
        tree[node] = heap[0] if heap else none
        node //= 2
        while node:
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if a <= b else b
            node //= 2

    def put(bin_: int) -> None:
        heapq.heappush(heaps.setdefault(room[bin_], []), (costs[bin_], bin_))
        settle(room[bin_])

    def lowest(least: int) -> tuple[float, int]:
        best, lo, hi = none, least + leaves, 2 * leaves - 1
        while lo <= hi:
            if lo & 1:
                best = min(best, tree[lo])
                lo += 1
            if not hi & 1:
                best = min(best, tree[hi])
                hi -= 1
            lo //= 2
            hi //= 2
        return best

    for _ in range(start):
        room.append(capacity)
        costs.append(0.0)
    if start:
        heaps[capacity] = [(0.0, b) for b in range(start)]
        settle(capacity)
    out = []
    for size in sizes:
        _, bin_ = lowest(size)
        if bin_ < 0:
            bin_ = len(room)
            room.append(capacity)
            costs.append(0.0)
        else:
            r = room[bin_]
            heapq.heappop(heaps[r])
            settle(r)
        room[bin_] -= size
        costs[bin_] += cost(size)
        put(bin_)
        out.append(bin_)
    return out, costs


def pack(items: Sequence[tuple[int, int, int]], capacity: int) -> list[int]:
    """Container number of each (size, id, part), all sizes within ``capacity``; numbers are dense from 0."""
    if not items:
        return []
    order = sorted(range(len(items)), key=lambda i: (-items[i][0], items[i][1], items[i][2]))
    sizes = [items[i][0] for i in order]
    least = max(1, -(-sum(sizes) // capacity))
    best = None
    for factor in STARTS:
        bins, costs = assign(sizes, capacity, int(least * factor))
        used = sorted(set(bins))
        rank = (len(used), max(costs) - min(costs[b] for b in used))
        if best is None or rank < best[0]:
            best = (rank, bins, {b: k for k, b in enumerate(used)})
        if len(used) == least or len(set(bins)) <= int(least * factor):
            break
    out = [0] * len(items)
    if best:
        for i, b in zip(order, best[1]):
            out[i] = best[2][b]
    return out


_COLUMNS = "capacity_id long, container_id long, doc_id long, part_no long, tokens long, capacity_tokens long"


def pack_sizes(sizes: DataFrame, capacities: DataFrame, *, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(capacity_id, container_id, doc_id, part_no, tokens, capacity_tokens) for (doc_id, tokens) and each capacity.

    ``part_no`` counts the pieces of a document from 0; only documents longer than the capacity have more than one.
    Documents without tokens (null and empty texts) are items of size 0 and take no room.  Repeated rows of a document
    are packed once.  ``container_id`` is unique within its capacity.  Capacities that are null or below 1 are skipped.
    """
    ship(sizes.sparkSession)
    # Read twice below, measured once.
    sizes = stage(sizes.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("tokens").alias("tokens")), "sizes")
    shards = sizes.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / shard_items)).alias("shards"))
    wanted = capacities.where("capacity_tokens >= 1").select(F.col("capacity_id").cast("long"), F.col("capacity_tokens").cast("long")).distinct()
    keyed = sizes.crossJoin(F.broadcast(shards)).crossJoin(F.broadcast(wanted))  # one row; one row per capacity
    keyed = keyed.select("capacity_id", "capacity_tokens", "doc_id", "tokens", F.pmod(F.xxhash64("doc_id"), F.col("shards")).alias("shard"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        capacity, shard = int(frame["capacity_tokens"].iloc[0]), int(frame["shard"].iloc[0])
        items = []
        for doc, tokens in zip(frame["doc_id"].tolist(), frame["tokens"].tolist()):
            full, rest = divmod(tokens, capacity)
            items += [(capacity, doc, k) for k in range(full)]
            if rest or not full:
                items.append((rest, doc, full))
        bins = pack(items, capacity)
        return pd.DataFrame(
            {
                "capacity_id": frame["capacity_id"].iloc[0],
                "container_id": [(shard << 32) + b for b in bins],
                "doc_id": [i[1] for i in items],
                "part_no": [i[2] for i in items],
                "tokens": [i[0] for i in items],
                "capacity_tokens": capacity,
            }
        )

    return keyed.groupBy("capacity_id", "shard").applyInPandas(run, _COLUMNS)


#: Tokenizer of a capacity that names none, and the different ones a table of capacities may name.
TOKENIZER, MOST_TOKENIZERS = "byte_bpe_50k", 16


def containers(documents: DataFrame, capacities: DataFrame, *, tokenizer_dir: str = TOKENIZER_DIR, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Every document assigned to containers of each capacity, sizes in tokens of the capacity's own tokenizer.

    Tokenizers are byte-level vocabularies given as rank files; a null name stands for ``TOKENIZER``.  Raises for a
    tokenizer without such a file and for more than ``MOST_TOKENIZERS`` different ones.
    """
    wanted = capacities.where("capacity_tokens >= 1").withColumn("tokenizer", F.coalesce("tokenizer", F.lit(TOKENIZER)))
    names = sorted(row.tokenizer for row in wanted.select("tokenizer").distinct().limit(MOST_TOKENIZERS + 1).collect())
    if len(names) > MOST_TOKENIZERS:
        raise ValueError(f"more than {MOST_TOKENIZERS} tokenizers")
    for name in names:
        if not Path(tokenizer_dir, f"{name}.tiktoken").exists():
            raise ValueError(f"no rank file of tokenizer {name!r}")
    packed = [pack_sizes(token_counts(documents, tokenizer=name, tokenizer_dir=tokenizer_dir), wanted.where(F.col("tokenizer") == name), shard_items=shard_items) for name in names]
    if not packed:
        return documents.sparkSession.createDataFrame([], _COLUMNS)
    return reduce(DataFrame.unionByName, packed)
