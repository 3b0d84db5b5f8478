"""Filling fixed-capacity containers: a grouping genetic algorithm on islands.

Items (texts, measured in tokens) are dealt at random to shards of about
``SHARD`` items.  Each shard is solved by several islands, each with a population
of packings of its own.  The genes are whole containers: crossover injects
well-filled containers of one parent into the other, drops the containers that
now hold something twice, and puts the displaced items back by best fit, largest
first.  After every epoch each island sends its best packing to the next island of
its shard.  A shard ends early once a packing needs no more containers than the
sum of its sizes does.

Every shard is left with a few containers that are not full.  Their items move up
to a next, far smaller round of shards, until a single shard is left; so the
unused space does not grow with the number of shards.  What counts as full is a share
of the capacity, or less where the items do not fill containers that far: at least
half of a round's containers stay.

Only items longer than the capacity are split: into full pieces, which fill a
container each, and one remainder.  Populations travel as arrays of container
numbers, some tens of bytes per item; the texts never move.

Defined results: NULL and empty texts have size 0 and no container; items of equal
size and repeated rows are separate items; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from random import Random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaloom.llm.tokens import VOCABULARY, token_count
from schemaloom.materialize import discard, materialize

SHARD = 1000
ISLANDS, POPULATION, GENERATIONS, EPOCHS = 3, 5, 12, 2
#: Containers filled to less than this share, and less than the round's median, move up to the next round.
FULL = 0.98
_STATE = "shard bigint, island int, rows array<bigint>, sizes array<int>, packings array<array<int>>, done boolean"


class Packing:
    """Containers as lists of item places, with their fill."""

    def __init__(self, bins: list[list[int]], sizes: list[int], capacity: int):
        self.bins = bins
        self.fill = [sum(sizes[i] for i in b) for b in bins]
        self.fitness = sum((f / capacity) ** 2 for f in self.fill) / max(1, len(bins))

    @classmethod
    def of(cls, numbers: list[int], sizes: list[int], capacity: int) -> Packing:
        bins: list[list[int]] = [[] for _ in range(max(numbers, default=-1) + 1)]
        for item, b in enumerate(numbers):
            bins[b].append(item)
        return cls([b for b in bins if b], sizes, capacity)

    def numbers(self, n: int) -> list[int]:
        out = [0] * n
        for k, b in enumerate(self.bins):
            for i in b:
                out[i] = k
        return out


def best_fit(bins: list[list[int]], items: list[int], sizes: list[int], capacity: int) -> Packing:
    """Put the items, largest first, each into the fullest container that holds it."""
    bins = [list(b) for b in bins]
    room = sorted((capacity - sum(sizes[i] for i in b), k) for k, b in enumerate(bins))
    for i in sorted(items, key=lambda i: -sizes[i]):
        at = bisect_left(room, (sizes[i], -1))
        if at < len(room):
            space, k = room.pop(at)
            bins[k].append(i)
        else:
            space, k = capacity, len(bins)
            bins.append([i])
        if space > sizes[i]:
            insort(room, (space - sizes[i], k))
    return Packing(bins, sizes, capacity)


def first_fit_random(n: int, sizes: list[int], capacity: int, rng: Random) -> Packing:
    """A random packing: next fit with a few open containers."""
    order = list(range(n))
    rng.shuffle(order)
    bins: list[list[int]] = []
    open_bins: list[list] = []
    for i in order:
        for o in open_bins:
            if o[0] >= sizes[i]:
                o[1].append(i)
                o[0] -= sizes[i]
                break
        else:
            open_bins.append([capacity - sizes[i], [i]])
            bins.append(open_bins[-1][1])
            if len(open_bins) > 12:
                open_bins.remove(min(open_bins, key=lambda o: o[0]))
    return Packing(bins, sizes, capacity)


def crossover(taker: Packing, giver: Packing, sizes: list[int], capacity: int, rng: Random) -> Packing:
    """Inject whole well-filled containers, drop those that clash, best-fit what is displaced."""
    ranked = sorted(range(len(giver.bins)), key=lambda k: -giver.fill[k])
    half = ranked[: max(1, len(ranked) // 2)]
    gift = [giver.bins[k] for k in rng.sample(half, max(1, len(half) // 2))]
    given = {i for b in gift for i in b}
    kept, displaced = [], []
    for b in taker.bins:
        if given.isdisjoint(b):
            kept.append(b)
        else:
            displaced += [i for i in b if i not in given]
    return best_fit(kept + gift, displaced, sizes, capacity)


def mutate(p: Packing, sizes: list[int], capacity: int, rng: Random) -> Packing:
    """Empty the worst container and a few others at random."""
    if len(p.bins) < 2:
        return p
    out = {min(range(len(p.bins)), key=lambda k: p.fill[k]), *rng.sample(range(len(p.bins)), min(3, len(p.bins)))}
    return best_fit([b for k, b in enumerate(p.bins) if k not in out], [i for k in out for i in p.bins[k]], sizes, capacity)


def evolve(sizes: list[int], packings: list[list[int]], capacity: int, seed: int, generations: int = GENERATIONS) -> tuple[list[list[int]], bool]:
    """Advance one island; gives its packings, the best first, and whether the best is proven optimal."""
    rng, n = Random(seed), len(sizes)
    least = -(-sum(sizes) // capacity)
    crowd = [Packing.of(p, sizes, capacity) for p in packings]
    while len(crowd) < POPULATION:
        crowd.append(first_fit_random(n, sizes, capacity, rng))
    rank = lambda p: (len(p.bins), -p.fitness)
    for _ in range(generations):
        crowd.sort(key=rank)
        if len(crowd[0].bins) <= least:
            break
        pick = lambda: crowd[min(rng.randrange(len(crowd)), rng.randrange(len(crowd)))]
        child = crossover(pick(), pick(), sizes, capacity, rng)
        other = crossover(pick(), pick(), sizes, capacity, rng)
        crowd[-2:] = [child, mutate(other, sizes, capacity, rng)]
        crowd.append(mutate(crowd[0], sizes, capacity, rng))
        crowd = sorted(crowd, key=rank)[:POPULATION]
    crowd.sort(key=rank)
    return [p.numbers(n) for p in crowd], len(crowd[0].bins) <= least


def _islands(capacity: int, epoch: int):
    def run(parts):
        for pdf in parts:
            found = []
            for r in pdf.itertuples(index=False):
                sizes = [int(s) for s in r.sizes]
                given = [[int(x) for x in p] for p in r.packings]
                found.append((given, True) if r.done else evolve(sizes, given, capacity, hash((int(r.shard), int(r.island), epoch))))
            yield pdf.assign(packings=[f[0] for f in found], done=[bool(f[1]) for f in found])

    return run


def _solve(items: DataFrame, capacity: int, shards: int) -> DataFrame:
    """Best packing per shard, written: (row, size, shard, bin, fill) of ``items`` (row, size)."""
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("row", F.lit(7)), F.lit(shards)))
    whole = dealt.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("row", "size"))).alias("items"))
    state = whole.select("shard", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.col("items.row").alias("rows"), F.col("items.size").cast("array<int>").alias("sizes"), F.array().cast("array<array<int>>").alias("packings"), F.lit(False).alias("done"))
    # a number of its own, since the rows are small and adaptive execution would put all islands into one task
    islands = shards * ISLANDS
    tasks = min(islands, max(items.sparkSession.sparkContext.defaultParallelism, islands // 40))
    stored = None
    for epoch in range(EPOCHS):
        before, stored = stored, materialize(state.repartition(tasks, "shard", "island").mapInPandas(_islands(capacity, epoch), _STATE), "islands")
        if before is not None:
            discard(before)
        state = stored
        if epoch < EPOCHS - 1:
            elites = state.select("shard", ((F.col("island") + 1) % ISLANDS).alias("island"), F.element_at("packings", 1).alias("elite"))
            settled = state.groupBy("shard").agg(F.max("done").alias("settled"))
            moved = F.when(F.col("done"), F.slice("packings", 1, 1)).otherwise(F.concat(F.array("elite"), F.slice("packings", 1, POPULATION - 1)))
            state = state.join(elites, ["shard", "island"]).join(settled, "shard").select("shard", "island", "rows", "sizes", moved.alias("packings"), F.col("settled").alias("done"))
    best = F.element_at("packings", 1)
    rank = F.struct(F.array_max(best).alias("bins"), F.col("island"))
    chosen = state.groupBy("shard").agg(F.min_by(F.struct("rows", "sizes", best.alias("best")), rank).alias("b"))
    flat = chosen.select("shard", F.explode(F.arrays_zip(F.col("b.rows").alias("row"), F.col("b.sizes").alias("size"), F.col("b.best").alias("bin"))).alias("x")).select("shard", "x.row", "x.size", "x.bin")
    fills = flat.groupBy("shard", "bin").agg(F.sum("size").alias("fill"))
    solved = materialize(flat.join(fills, ["shard", "bin"]), "packed")
    discard(stored)
    return solved


def pack(items: DataFrame, capacity: int, *, shard: int = SHARD) -> DataFrame:
    """(row, size, container_id, fill) for ``items`` (row bigint unique, size <= capacity)."""
    n, level, done = items.count(), 0, None
    while n:
        shards = max(1, -(-n // shard))
        solved = _solve(items, capacity, shards)
        numbered = solved.select("row", "size", (F.lit(level << 56) + F.col("shard") * (1 << 20) + F.col("bin")).cast("bigint").alias("container_id"), "fill")
        median = solved.groupBy("shard", "bin").agg(F.first("fill").alias("fill")).agg(F.percentile_approx("fill", 0.5)).first()[0]
        full = F.lit(shards == 1) | (F.col("fill") >= min(FULL * capacity, median))
        kept = numbered.filter(full)
        done = kept if done is None else done.unionByName(kept)
        items = numbered.filter(~full).select("row", "size")
        n, level = items.count(), level + 1
    return items.sparkSession.createDataFrame([], "row bigint, size int, container_id bigint, fill bigint") if done is None else done


def pack_documents(documents: DataFrame, *, capacity: int = 2048, vocabulary: str = VOCABULARY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document piece: its tokens [start_token, start_token + n_tokens), its container and that container's unused space."""
    sized = documents.select(F.col(doc_id).alias("doc_id"), token_count(F.col(text), vocabulary).alias("n"))
    sized = materialize(sized, "sizes").withColumn("at", F.monotonically_increasing_id())
    last = F.greatest(F.lit(0), F.ceil(F.col("n") / capacity) - 1).cast("int")
    pieces = sized.select("doc_id", "n", "at", F.explode(F.sequence(F.lit(0), last)).alias("piece")).withColumn("size", F.least(F.lit(capacity), F.col("n") - F.col("piece").cast("bigint") * capacity).cast("int"))
    pieces = materialize(pieces.select("doc_id", "piece", "size", F.monotonically_increasing_id().alias("row")), "pieces")
    packed = pack(pieces.filter((F.col("size") > 0) & (F.col("size") < capacity)).select("row", "size"), capacity).select("row", "container_id", "fill")
    whole = pieces.filter(F.col("size") == capacity).select("row", (-1 - F.col("row")).alias("container_id"), F.lit(capacity).cast("bigint").alias("fill"))
    return pieces.join(packed.unionByName(whole), "row", "left").select(
        "doc_id", "piece", (F.col("piece").cast("bigint") * capacity).alias("start_token"), F.col("size").alias("n_tokens"), "container_id", (capacity - F.col("fill")).alias("unused_tokens")
    )


def container_report(packed: DataFrame, capacity: int) -> DataFrame:
    """Containers, tokens and unused space of a packing, and the least number of containers possible."""
    used = packed.filter("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.first("unused_tokens").alias("unused"))
    return used.agg(F.count("*").alias("containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("unused"), F.lit(0)).alias("unused_tokens"), F.ceil(F.coalesce(F.sum("used"), F.lit(0)) / capacity).alias("least_containers"))
