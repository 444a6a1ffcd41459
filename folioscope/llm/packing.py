"""Filling containers of fixed capacity with texts, by a grouping genetic algorithm on islands.

Texts longer than the capacity are cut into full containers and a rest; everything else stays whole. Items are dealt
into blocks of bounded size by hash. Each block is evolved on several islands: a child takes whole well-filled bins of
one parent, bins of the other that share an item with them are dissolved, and the displaced items go where they fit
best. After an epoch the best packing of every island migrates to the next one through a join, and the best island of
a block wins. A block that best fit or an island packs into as few bins as its sizes allow is evolved no further. Bins that stay emptier than GOOD give their items to a second level of blocks, so poor ends meet.

Defined results: empty and null texts have no tokens and still lie in one container; equal sizes and repeated rows are
items of their own; a table without rows gives none; an item of exactly the capacity fills a container.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.plans.materialize import cut

#: Items of a block at most on average; islands of a block; packings of an island; children of an epoch; epochs.
BLOCK, ISLANDS, POPULATION, CHILDREN, EPOCHS = 1200, 2, 5, 14, 2
#: Filling under which a bin is dissolved for the next level, and the number of levels.
GOOD, LEVELS = 0.97, 2
#: Blocks that a task evolves, on average.
PER_TASK = 8
#: Kinds of containers, at most; the table is fixed.
KINDS = 100

Packing = list[list[int]]


class Bins:
    """Bins with free room in order, for best fit."""

    def __init__(self, sizes: list[int], capacity: int, bins: Packing):
        self.sizes, self.capacity, self.bins = sizes, capacity, bins
        self.room = sorted((capacity - sum(sizes[i] for i in b), k) for k, b in enumerate(bins))

    def insert(self, item: int) -> None:
        """Into the fullest bin that has room for it, else into a new one."""
        size = self.sizes[item]
        at = bisect.bisect_left(self.room, (size, -1))
        if at < len(self.room):
            free, k = self.room.pop(at)
            self.bins[k].append(item)
        else:
            free, k = self.capacity, len(self.bins)
            self.bins.append([item])
        bisect.insort(self.room, (free - size, k))


def best_fit(sizes: list[int], capacity: int, order: list[int], bins: Packing | None = None) -> Packing:
    packed = Bins(sizes, capacity, bins if bins is not None else [])
    for item in order:
        packed.insert(item)
    return packed.bins


def fitness(sizes: list[int], capacity: int, bins: Packing) -> float:
    """Mean square filling: few full bins beat many even ones."""
    return float(np.mean([(sum(sizes[i] for i in b) / capacity) ** 2 for b in bins])) if bins else 1.0


def crossed(sizes: list[int], capacity: int, receiver: Packing, giver: Packing, rng: np.random.Generator) -> Packing:
    """The receiver with some of the giver's fullest bins injected whole."""
    fill = np.array([sum(sizes[i] for i in b) for b in giver])
    share = max(1, int(len(giver) * rng.uniform(0.1, 0.4)))
    pool = np.argsort(-fill + rng.uniform(0, capacity * 0.02, len(fill)))[: 2 * share]
    taken = [giver[k] for k in rng.choice(pool, min(share, len(pool)), replace=False)]
    held = {i for b in taken for i in b}
    kept, displaced = [list(b) for b in taken], []
    emptiest = set(np.argsort([sum(sizes[i] for i in b) for b in receiver])[: max(1, len(receiver) // 50)].tolist())
    for k, b in enumerate(receiver):
        if k in emptiest or not held.isdisjoint(b):
            displaced += [i for i in b if i not in held]
        else:
            kept.append(list(b))
    return best_fit(sizes, capacity, sorted(displaced, key=lambda i: -sizes[i]), kept)


def evolve(sizes: list[int], capacity: int, elites: list[Packing], seed: int) -> tuple[Packing, float]:
    """The best packing of an island after an epoch that starts from ``elites``."""
    rng = np.random.default_rng(seed)
    down = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    least = max(1, -(-sum(sizes) // capacity))
    population = [*elites, best_fit(sizes, capacity, down)]
    if min(map(len, population)) > least:
        noise = np.array(sizes) * rng.uniform(0.7, 1.0, (POPULATION, len(sizes)))
        population += [best_fit(sizes, capacity, np.argsort(-noise[k]).tolist()) for k in range(max(0, POPULATION - len(population)))]
        scored = sorted(((fitness(sizes, capacity, p), k, p) for k, p in enumerate(population)), reverse=True)
        for child in range(CHILDREN):
            if len(scored[0][2]) <= least:
                break
            a, b = (scored[min(rng.integers(len(scored)), rng.integers(len(scored)))][2] for _ in range(2))
            new = crossed(sizes, capacity, a, b, rng)
            value = fitness(sizes, capacity, new)
            if value > scored[-1][0]:
                scored[-1] = (value, len(population) + child, new)
                scored.sort(reverse=True)
        population = [scored[0][2]]
    best = max(population, key=lambda p: fitness(sizes, capacity, p))
    return best, fitness(sizes, capacity, best)


ISLAND = "container_kind STRING, capacity INT, block BIGINT, island INT, docs ARRAY<BIGINT>, parts ARRAY<INT>, sizes ARRAY<INT>, bins ARRAY<ARRAY<INT>>, value DOUBLE, solved BOOLEAN"
MEMBER = "container_kind STRING, capacity INT, container_id STRING, fill DOUBLE, doc_id BIGINT, part INT, size INT"


def _epoch(islands: DataFrame, epoch: int) -> DataFrame:
    """The best packing of every island; a block that its first island solves needs no others and stays as it is."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for kind, capacity, block, island, docs, parts, sizes, own, other in zip(*(batch[c] for c in ("container_kind", "capacity", "block", "island", "docs", "parts", "sizes", "bins", "migrant"))):
                plain, capacity = [int(x) for x in sizes], int(capacity)
                elites = [[list(map(int, b)) for b in p] for p in (own, other) if p is not None]
                least = max(1, -(-sum(plain) // capacity))
                for i in (range(ISLANDS) if epoch == 0 else (int(island),)):
                    bins, value = evolve(plain, capacity, elites, hash((int(block), i, epoch)) & 0xFFFFFFFF)
                    solved = len(bins) <= least
                    rows.append((kind, capacity, block, i, docs, parts, sizes, bins, value, solved))
                    if solved:
                        break
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ISLAND.split(", ")])

    return islands.mapInPandas(run, ISLAND)


def _evolved(items: DataFrame, total: int) -> DataFrame:
    """(container_kind, capacity, block, docs, parts, sizes, bins) of items (container_kind, capacity, doc_id, part, size)."""
    blocks = max(1, -(-total // BLOCK))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("doc_id", "part", "container_kind"), F.lit(blocks)))
    rows = dealt.groupBy("container_kind", "capacity", "block").agg(F.array_sort(F.collect_list(F.struct("doc_id", "part", "size"))).alias("all"))
    base = rows.select("container_kind", "capacity", "block", F.col("all.doc_id").alias("docs"), F.col("all.part").alias("parts"), F.col("all.size").alias("sizes"))
    none = F.lit(None).cast("array<array<int>>")
    tasks = max(items.sparkSession.sparkContext.defaultParallelism, min(-(-blocks // PER_TASK), 20_000))
    spread = base.repartition(tasks, "container_kind", "block").select("*", F.lit(0).alias("island"), none.alias("bins"), none.alias("migrant"))
    islands = cut(_epoch(spread, 0))
    done = islands
    for epoch in range(1, EPOCHS):
        # blocks that some island has solved are done; in the others the best packing of every island goes to the next one
        open_ = islands.withColumn("_solved", F.max("solved").over(W.partitionBy("container_kind", "block"))).where("NOT _solved").drop("_solved")
        sent = open_.select("container_kind", "block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("bins").alias("migrant"))
        islands = cut(_epoch(open_.join(sent, ["container_kind", "block", "island"]), epoch))
        done = done.unionByName(islands)
    best = F.max_by(F.struct("docs", "parts", "sizes", "bins"), F.struct("value", -F.col("island"))).alias("best")
    return done.groupBy("container_kind", "capacity", "block").agg(best).select("container_kind", "capacity", "block", "best.*")


def _members(evolved: DataFrame, level: int) -> DataFrame:
    """A row for each item: container, its filling, and the item."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for kind, capacity, block, docs, parts, sizes, bins in zip(*(batch[c] for c in ("container_kind", "capacity", "block", "docs", "parts", "sizes", "bins"))):
                at = np.concatenate([*bins, np.empty(0, int)]).astype(int)
                each = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
                size = np.asarray(sizes)[at]
                fill = np.bincount(each, weights=size, minlength=len(bins)) / capacity
                yield pd.DataFrame({
                    "container_kind": kind, "capacity": capacity, "container_id": [f"{kind}-{level}-{block}-{k}" for k in each], "fill": fill[each], "doc_id": np.asarray(docs)[at], "part": np.asarray(parts)[at], "size": size,
                })

    return evolved.mapInPandas(run, MEMBER)


def pack(lengths: DataFrame, containers: DataFrame) -> DataFrame:
    """(container_kind, container_id, doc_id, part, token_start, tokens) for texts (doc_id, tokens) in every capacity.

    A part holds the tokens from token_start on; only texts longer than the capacity have more than part 0.
    """
    rows = containers.where("capacity > 0").select("container_kind", "capacity").distinct().orderBy("container_kind", "capacity").limit(KINDS + 1).collect()
    if len(rows) > KINDS:
        raise ValueError(f"more than {KINDS} kinds of containers")
    if not rows:
        rows = [(None, 1)]
    kinds = F.explode(F.array(*(F.struct(F.lit(k).cast("string").alias("container_kind"), F.lit(c).cast("int").alias("capacity")) for k, c in rows))).alias("k")
    held = F.coalesce("tokens", F.lit(0))
    full = F.floor(held / F.col("capacity")).cast("int")
    each = lengths.select("doc_id", "tokens", kinds).select("doc_id", "tokens", "k.*").where("container_kind IS NOT NULL")
    cuts = cut(each.select("container_kind", "capacity", "doc_id", held.alias("tokens"), full.alias("full")))
    whole = cuts.where("full > 0").select("container_kind", "capacity", "doc_id", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("part"))
    whole = whole.select("container_kind", "capacity", F.concat_ws("-", "container_kind", F.lit("full"), "doc_id", "part").alias("container_id"), "doc_id", "part", F.col("capacity").alias("size"))
    rest = cuts.where("tokens = 0 OR tokens % capacity > 0").select("container_kind", "capacity", "doc_id", F.col("full").alias("part"), (F.col("tokens") % F.col("capacity")).cast("int").alias("size"))
    placed, left = [], rest
    for level in range(1, LEVELS + 1):
        total = left.groupBy("container_kind").count().agg(F.max("count")).first()[0] or 0
        members = _members(_evolved(left, total), level)
        if level < LEVELS:
            members = cut(members)
            placed.append(members.where(F.col("fill") >= GOOD))
            left = members.where(F.col("fill") < GOOD).select("container_kind", "capacity", "doc_id", "part", "size")
        else:
            placed.append(members)
    out = whole
    for members in placed:
        out = out.unionByName(members.select(out.columns))
    return out.select("container_kind", "container_id", "doc_id", "part", (F.col("part").cast("bigint") * F.col("capacity")).alias("token_start"), F.col("size").alias("tokens"))


def filling(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """Containers used, tokens, and share of the room used, of each kind."""
    used = packed.groupBy("container_kind").agg(F.countDistinct("container_id").alias("used"), F.sum("tokens").alias("tokens"))
    return used.join(F.broadcast(containers), "container_kind").select("container_kind", "capacity", "used", "tokens", (F.col("tokens") / (F.col("used") * F.col("capacity"))).alias("filling"))
