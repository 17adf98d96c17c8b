"""Filling fixed-capacity containers: a grouping genetic algorithm on islands with elite migration.

The items are spread over shards of bounded size. On every shard several islands breed packings from different seeds;
between epochs each island receives the best packing of its neighbour. A child takes whole well-filled bins of one parent,
loses bins of the other that share items with them, and what is left over is placed by exchanges that leave bins full and
gather the remaining room in few of them. The bins that a shard leaves with room are dissolved, and their items packed once
more across shards, level by level, until one shard holds the rest.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from genoloom.storage import cut, drop_cut

#: Default vocabulary; its path is a parameter of token_counts. PATTERN divides a text before merging (fixed value).
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class Breeding:
    """shard_items bounds what one task packs at once; the rest is the effort of an island. waste is the part of the
    capacity that containers may leave empty on average, the emptiest of a shard left out, for the shard to count as
    solved; containers with more room than `dissolve` are packed again across shards."""

    capacity: int = 2048
    shard_items: int = 2000
    islands: int = 2
    epochs: int = 2
    population: int = 4
    children: int = 12
    mutation: float = 0.5
    waste: float = 0.0002
    dissolve: float = 0.001


def token_counts(documents: DataFrame, path: str = TOKENIZER, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tokens) of every whole text; null texts have no row, empty ones no tokens. Workers read `path`."""
    chosen = documents.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).where("t IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            counts = [len(own.encode_ordinary(t)) for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("d"), pa.array(counts, pa.int64())], names=["doc_id", "tokens"])

    return chosen.mapInArrow(run, f"doc_id {chosen.schema['d'].dataType.simpleString()}, tokens bigint")


def pieces(counts: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece_no, tokens): texts within the capacity whole, longer ones as full pieces and a rest."""
    n = F.greatest(F.ceil(F.col("tokens") / capacity), F.lit(1))
    part = counts.select("doc_id", "tokens", F.explode(F.sequence(F.lit(1).cast("bigint"), n)).alias("piece_no"))
    return part.select("doc_id", F.col("piece_no").cast("int").alias("piece_no"), F.least(F.lit(capacity), F.col("tokens") - (F.col("piece_no") - 1) * capacity).cast("int").alias("tokens"))


class Island:
    """Packings of one shard's items; a packing is the bin number of every item."""

    def __init__(self, sizes: np.ndarray, how: Breeding, seed: tuple[int, ...]) -> None:
        self.sizes, self.how, self.rng = sizes.astype(np.int64), how, np.random.default_rng(seed)
        self.least = max(1, int(-(-self.sizes.sum() // how.capacity)))  # no packing has fewer bins
        self.born = 0

    def place(self, bins: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Best fit of the items, in their order, into the bins of the others (-1 marks items without a bin)."""
        held = bins >= 0
        used = int(bins.max()) + 1 if held.any() else 0
        free = self.how.capacity - np.bincount(bins[held], self.sizes[held], used).astype(np.int64)
        slots = sorted((f << 32 | b) for b, f in enumerate(free.tolist()))
        size = self.sizes.tolist()
        for i in items.tolist():
            k = bisect_left(slots, size[i] << 32)
            if k == len(slots):
                b, left, used = used, self.how.capacity, used + 1
            else:
                slot = slots.pop(k)
                b, left = slot & 0xFFFFFFFF, slot >> 32
            bins[i] = b
            insort(slots, (left - size[i]) << 32 | b)
        return bins

    def fresh(self, greedy: bool) -> np.ndarray:
        noise = np.zeros(len(self.sizes)) if greedy else self.rng.normal(0, 0.05 * self.how.capacity, len(self.sizes))
        return self.place(np.full(len(self.sizes), -1), np.argsort(-(self.sizes + noise), kind="stable"))

    def waste(self, bins: np.ndarray) -> int:
        """Room left in all bins but the emptiest: what is lost whatever other items are put beside them."""
        fill = np.bincount(bins, self.sizes)
        return int(self.how.capacity * (len(fill) - 1) - fill.sum() + fill.min())

    def fitness(self, bins: np.ndarray) -> tuple[float, float]:
        """Few bins, then little room in all but the emptiest."""
        return -float(bins.max()), -float(self.waste(bins))

    def solved(self, bins: np.ndarray) -> bool:
        count = int(bins.max()) + 1
        return count <= self.least and self.waste(bins) <= self.how.waste * self.how.capacity * count

    def exchange(self, bins: np.ndarray, loose: np.ndarray, rounds: int = 60) -> np.ndarray:
        """Fills the room left in bins by replacing none, one or two of a bin's items with one or two loose ones that are
        larger together, the fullest result first; what is replaced becomes loose. bins is changed. Returns the loose items.
        """
        capacity, sizes = self.how.capacity, self.sizes
        for _ in range(rounds):
            if not len(loose):
                break
            own = loose[np.argsort(sizes[loose], kind="stable")]
            # sums of one or two loose items; of many, neighbours in a random order stand for the pairs
            one = np.stack([own, np.full(len(own), -1)], axis=1)
            if len(own) <= 200:
                i, j = np.triu_indices(len(own), 1)
                two = np.stack([own[i], own[j]], axis=1)
            else:
                mixed = self.rng.permutation(own)
                two = np.concatenate([np.stack([mixed, np.roll(mixed, k)], axis=1) for k in range(1, 80)])
            parts = np.concatenate([one, two])
            sums = sizes[parts[:, 0]] + np.where(parts[:, 1] >= 0, sizes[parts[:, 1]], 0)
            order = np.argsort(sums, kind="stable")
            parts, sums = parts[order], sums[order]

            held = np.flatnonzero(bins >= 0)
            if not len(held):
                break
            held = held[np.argsort(bins[held], kind="stable")]
            fill = np.bincount(bins[held], sizes[held], int(bins.max()) + 1).astype(np.int64)
            room = capacity - fill
            some = np.flatnonzero((room > 0) & (fill > 0))
            if not len(some):
                break
            # what may be taken out of a bin: nothing, one item, two items that follow each other in a random order
            held = held[np.lexsort((self.rng.random(len(held)), bins[held]))]
            held = held[room[bins[held]] > 0]
            after = np.roll(held, -1)
            pair = bins[held] == bins[after] if len(held) > 1 else np.zeros(len(held), bool)
            out = np.concatenate([np.stack([np.full(len(some), -1)] * 2, axis=1), np.stack([held, np.full(len(held), -1)], axis=1), np.stack([held[pair], after[pair]], axis=1)])
            where = np.concatenate([some, bins[held], bins[held[pair]]])
            lost = np.where(out[:, 0] >= 0, sizes[out[:, 0]], 0) + np.where(out[:, 1] >= 0, sizes[out[:, 1]], 0)
            at = np.searchsorted(sums, lost + room[where], side="right") - 1
            gain = np.where(at >= 0, sums[np.maximum(at, 0)] - lost, 0)
            left = room[where] - gain
            good = np.flatnonzero(gain > 0)
            if not len(good):
                break
            good = good[np.lexsort((-gain[good], left[good]))]
            taken: set[int] = set()
            touched: set[int] = set()
            back: list[int] = []
            for k in good.tolist():
                b = int(where[k])
                new = [int(x) for x in parts[at[k]] if x >= 0]
                if b in touched or any(x in taken for x in new):
                    continue
                touched.add(b)
                taken.update(new)
                gone = [int(x) for x in out[k] if x >= 0]
                back += gone
                bins[gone] = -1
                bins[new] = b
            loose = np.array([x for x in loose.tolist() if x not in taken] + back, np.int64)
        return loose

    def concentrate(self, bins: np.ndarray, rounds: int = 40) -> np.ndarray:
        """Gathers the room that bins have left in few of them: one or two items of a bin, or none, are exchanged for one or
        two of another that fill it wholly, so that its room moves to the other. bins is changed."""
        size, capacity = self.sizes.tolist(), self.how.capacity
        for turn in range(rounds):
            order = np.argsort(bins, kind="stable")
            ends = np.searchsorted(bins[order], np.arange(int(bins.max()) + 2))
            room = (capacity - np.bincount(bins, self.sizes)).astype(np.int64).tolist()
            givers = [b for b, r in enumerate(room) if r > 0]
            if len(givers) < 2 or sum(room) - max(room) <= self.how.waste * capacity * len(room):
                break
            if turn % 2 or len(givers) < 12:  # full bins may take room over, which opens other ways
                extra = self.rng.integers(0, len(room), 40).tolist()
                givers = list(dict.fromkeys(givers + extra))
            held: dict[int, list[int]] = {}
            index: dict[int, list[tuple[int, ...]]] = {}
            for b in givers:
                own = order[ends[b] : ends[b + 1]].tolist()
                if len(own) > 6:
                    own = self.rng.choice(own, 6, replace=False).tolist()
                held[b] = own
                for k, x in enumerate(own):
                    index.setdefault(size[x], []).append((b, x))
                    for y in own[:k]:
                        index.setdefault(size[x] + size[y], []).append((b, x, y))
            touched: set[int] = set()
            for b in sorted(givers, key=lambda g: room[g]):
                r = room[b]
                if r == 0 or b in touched:
                    continue
                own = held[b]
                ways = [(r, ())] + [(r + size[x], (x,)) for x in own] + [(r + size[x] + size[y], (x, y)) for k, x in enumerate(own) for y in own[:k]]
                for want, out in ways:
                    hit = next((c for c in index.get(want, ()) if c[0] != b and c[0] not in touched and (room[c[0]] >= r or room[c[0]] == 0 and turn % 2)), None)
                    if hit:
                        other = hit[0]
                        for x in out:
                            bins[x] = other
                        for x in hit[1:]:
                            bins[x] = b
                        touched |= {b, other}
                        break
            if not touched:
                if turn % 2:
                    break
                continue
        return bins

    def _refit(self, bins: np.ndarray, loose: np.ndarray) -> np.ndarray:
        """Numbers the bins anew, fills their room by exchange and best-fits what is loose then, largest first."""
        items = np.flatnonzero(loose)
        bins[items] = -1
        rest = ~loose
        if rest.any():
            bins[rest] = np.unique(bins[rest], return_inverse=True)[1]
            items = self.exchange(bins, items)
        self.place(bins, items[np.argsort(-self.sizes[items], kind="stable")])
        return np.unique(self.concentrate(np.unique(bins, return_inverse=True)[1]), return_inverse=True)[1]

    def cross(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Injects whole well-filled bins of b into a; bins of a with items given twice go, what they lose is placed anew."""
        room = self.how.capacity - np.bincount(b, self.sizes)
        well = room <= np.quantile(room, 0.6)
        taken = (well & (self.rng.random(len(room)) < 0.4))[b]
        broken = np.zeros(int(a.max()) + 1, bool)
        broken[a[taken]] = True
        child = a.copy()
        child[taken] = int(a.max()) + 1 + b[taken]
        return self._refit(child, broken[a] & ~taken)

    def mutate(self, bins: np.ndarray) -> np.ndarray:
        """Dissolves the emptiest bins and a few others."""
        fill = np.bincount(bins, self.sizes)
        gone = fill <= np.partition(fill, min(2, len(fill) - 1))[min(2, len(fill) - 1)]
        gone |= self.rng.random(len(fill)) < 6 / len(fill)
        return self._refit(bins.copy(), gone[bins])

    def breed(self, elites: list[np.ndarray]) -> np.ndarray:
        """The best packing after at most how.children children; `born` counts them."""
        if not len(self.sizes):
            return np.zeros(0, np.int64)
        herd = [e.copy() for e in elites] or [self.fresh(True)]
        best = max(herd, key=self.fitness)
        if self.solved(best):
            return best
        while len(herd) < self.how.population:
            herd.append(self.fresh(False))
        scores = [self.fitness(h) for h in herd]
        for _ in range(self.how.children):
            k = max(range(len(herd)), key=lambda i: scores[i])
            if self.solved(herd[k]):
                break
            # tournament of two for each parent
            pick = lambda: max(self.rng.integers(0, len(herd), 2).tolist(), key=lambda i: scores[i])
            child = self.cross(herd[pick()], herd[pick()])
            self.born += 1
            if not self.solved(child) and self.rng.random() < self.how.mutation:
                child = self.mutate(child)
            worst, own = min(range(len(herd)), key=lambda i: scores[i]), self.fitness(child)
            if own >= scores[worst]:
                herd[worst], scores[worst] = child, own
        return herd[max(range(len(herd)), key=lambda i: scores[i])]


def _evolve(shards: DataFrame, how: Breeding, epoch: int) -> DataFrame:
    """shards: shard, island, sizes, elites. Returns (shard, island, bins, count, waste, children, start): the best packing,
    its number of bins and waste, the children bred so far, and the number of bins of the best-fit start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
        for b in batches:
            out = []
            for row in b.to_pylist():
                island = Island(np.array(row["sizes"]), how, (row["shard"], row["island"], epoch))
                start = row["start"] or int(island.fresh(True).max()) + 1
                best = island.breed([np.array(e) for e in row["elites"] or []])
                out.append((row["shard"], row["island"], best.tolist(), int(best.max()) + 1, island.waste(best), island.born + (row["children"] or 0), start))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=["shard", "island", "bins", "count", "waste", "children", "start"])

    return shards.select("shard", "island", "sizes", "elites", "children", "start").mapInArrow(run, "shard bigint, island int, bins array<int>, count int, waste bigint, children int, start int")


def _pack(items: DataFrame, how: Breeding, level: int, count: int) -> tuple[DataFrame, DataFrame]:
    """The items of `count` shards as (doc_id, piece_no, tokens, shard, bin), and (level, shard, items, start, bins, least,
    children) of the breeding; both from written tables."""
    shard = F.pmod(F.xxhash64("doc_id", "piece_no", F.lit(level)), F.lit(count))
    lists = (
        items.groupBy(shard.alias("shard")).agg(F.sort_array(F.collect_list(F.struct("tokens", "doc_id", "piece_no"))).alias("items"))
        .select("shard", "items", F.col("items.tokens").alias("sizes"))
    )
    lists = cut(lists, "shards")
    tasks = max(1, min(count * how.islands, 4 * int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    islands = lists.select("shard", "sizes", F.explode(F.sequence(F.lit(0), F.lit(how.islands - 1))).alias("island"))
    state: DataFrame | None = None
    for epoch in range(how.epochs):
        if state is None:
            none = F.lit(None).cast("int")
            ready = islands.select("*", F.array().cast("array<array<int>>").alias("elites"), none.alias("children"), none.alias("start"))
        else:  # the neighbour's best moves in
            here = state.select("shard", "island", "bins", "children", "start")
            near = state.select("shard", F.pmod(F.col("island") + 1, F.lit(how.islands)).alias("island"), F.col("bins").alias("other"))
            ready = islands.join(here, ["shard", "island"]).join(near, ["shard", "island"]).withColumn("elites", F.array("bins", "other"))
        old, state = state, cut(_evolve(ready.select("shard", "island", "sizes", "elites", "children", "start").repartition(tasks, "shard", "island"), how, epoch), "islands")
        if old is not None:
            drop_cut(old)
    best = state.groupBy("shard").agg(F.max_by("bins", F.struct(-F.col("count"), -F.col("waste"), -F.col("island"))).alias("bins"), F.min("count").alias("count"), F.sum("children").alias("children"), F.min("start").alias("start"))
    rows = lists.join(best.select("shard", "bins"), "shard").select("shard", F.explode(F.arrays_zip("items", "bins")).alias("x"))
    total = F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x)
    bred = lists.select("shard", F.size("sizes").alias("items"), F.ceil(total / how.capacity).alias("least")).join(best.drop("bins"), "shard")
    packed = cut(rows.select("x.items.doc_id", "x.items.piece_no", "x.items.tokens", "shard", F.col("x.bins").alias("bin")), "packed")
    report = cut(bred.select(F.lit(level).alias("level"), "shard", "items", "start", F.col("count").alias("bins"), "least", "children"), "bred")
    drop_cut(lists, state)
    return packed, report


def breed(counts: DataFrame, how: Breeding = Breeding()) -> tuple[DataFrame, DataFrame]:
    """The containers as `pack` gives them, and the report of the breeding: (level, shard, items, start, bins, least,
    children); start is the number of bins of best fit by decreasing size, bins that of the best packing bred."""
    all_ = cut(pieces(counts.select("doc_id", "tokens").where("tokens IS NOT NULL"), how.capacity), "pieces")
    name = lambda n, *c: F.concat_ws("-", F.lit(n), *c).alias("container_id")
    cols = ["doc_id", "piece_no", "tokens"]
    once = F.row_number().over(W.partitionBy("doc_id", "piece_no").orderBy("tokens"))  # tells repeated full pieces apart
    out = all_.where(F.col("tokens") == how.capacity).select(*cols, once.alias("k")).select(*cols, name("full", "doc_id", "piece_no", "k"))
    left, reports, level = all_.where(F.col("tokens") < how.capacity), [], 0
    size = left.count()
    while True:
        level += 1
        count = max(1, round(size / how.shard_items))
        packed, report = _pack(left, how, level, count)
        reports.append(report)
        if count == 1:  # nothing to be packed across shards
            break
        fill = packed.groupBy("shard", "bin").agg(F.sum("tokens").alias("fill"))
        roomy = fill.where(F.col("fill") < (1 - how.dissolve) * how.capacity)
        left = cut(packed.join(roomy, ["shard", "bin"], "left_semi").select(*cols), "loose")
        before, size = size, left.count()
        if size > before / 2:  # shards this hard gain nothing from another level
            drop_cut(left)
            break
        out = out.unionByName(packed.join(roomy, ["shard", "bin"], "left_anti").select(*cols, name("level", F.lit(level), "shard", "bin")))
    out = out.unionByName(packed.select(*cols, name("level", F.lit(level), "shard", "bin")))
    report = reports[0]
    for r in reports[1:]:
        report = report.unionByName(r)
    return out, report


def pack(counts: DataFrame, how: Breeding = Breeding()) -> DataFrame:
    """(doc_id, piece_no, tokens, container_id): the container of every text, or of every piece of a longer text.

    counts: doc_id, tokens. A text is divided only if it exceeds the capacity: into full pieces, each a container, and a
    rest, numbered from 1. Texts without tokens are put with others; rows with null tokens have no text and are left out;
    a repeated row is packed as often as it stands. An empty table gives an empty one.
    """
    return breed(counts, how)[0]
