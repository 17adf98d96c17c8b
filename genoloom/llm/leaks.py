"""Evaluation texts inside a corpus: spaced-seed hashing, then verified overlaps that tolerate substituted words."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from genoloom.storage import cut

#: Fixed values. Seeds of span 13: 1 must agree, 0 is ignored. Any two positions of 1 to 12 that stand at least six apart
#: are ignored by one of them, so that the first 13 words of every stretch that `overlap` accepts are hit: they begin with
#: a word that agrees, and hold two substitutions at most. The last one also ignores position 0.
MASKS = ("1001111001111", "1001111110011", "1001111111100", "1110011110011", "1110011111100", "0111100111100")
ESCAPES = re.compile(r'\\[nrt"]')
WORDS = re.compile(r"[a-z0-9]+")
#: Words of items up to which their seeds are sent to all workers (72 bytes of keys a word, besides the texts); beyond,
#: the seeds of the corpus are joined with those of the items.
BLOCK_WORDS = 2_000_000
#: Bits of the filter that the seeds of the corpus must pass before that join; its size is fixed, it only saves rows.
FILTER_BITS = 1 << 28
#: Words of corpus text that a worker turns into one array.
CHUNK_WORDS = 100_000


def words(text: str) -> list[str]:
    """Runs of a-z and digits in the lower-cased text; the written-out escapes \\n, \\r, \\t and \\" separate words."""
    return WORDS.findall(ESCAPES.sub(" ", text).lower())


def coefficients(masks: tuple[str, ...] = MASKS) -> list[np.ndarray]:
    """A fixed odd factor for each word that a mask requires, 0 for those that it ignores."""
    rng = np.random.default_rng(20)
    return [np.where(np.array(list(m)) == "1", rng.integers(1, 2**63, len(m), dtype=np.uint64) | np.uint64(1), np.uint64(0)) for m in masks]


def word_code(word: str) -> int:
    """63 bits that stand for a word, never 0."""
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little") >> 1 | 1


@dataclass
class Seeds:
    """Hashed seeds of items."""

    vocabulary: dict[str, int]
    items: list[np.ndarray]
    ids: list
    coefficients: list[np.ndarray]
    keys: np.ndarray
    where: np.ndarray  # (item, position, mask) of each key

    @staticmethod
    def of(items: list[tuple[object, str]], masks: tuple[str, ...] = MASKS) -> Seeds:
        vocabulary: dict[str, int] = {}
        texts = [np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(t)], np.uint64) for _, t in items]
        return Seeds.numbered(vocabulary, texts, [i for i, _ in items], masks)

    @staticmethod
    def numbered(vocabulary: dict[str, int], texts: list[np.ndarray], ids: list, masks: tuple[str, ...] = MASKS) -> Seeds:
        """Seeds of texts whose words are numbered already."""
        seeds = Seeds(vocabulary, texts, ids, coefficients(masks), np.empty(0, np.uint64), np.empty((0, 3), np.int64))
        keys, where = [], []
        for i, t in enumerate(texts):
            for m in range(len(masks)):
                h, at = seeds.hashes(t, m)
                keys.append(h)
                where.append(np.stack([np.full(len(at), i), at, np.full(len(at), m)], axis=1))
        if keys:
            k, w = np.concatenate(keys), np.concatenate(where)
            order = np.argsort(k, kind="stable")
            seeds.keys, seeds.where = k[order], w[order]
        return seeds

    def hashes(self, ids: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the mask at every position of a row of word numbers where all required words are known, and the positions."""
        c = self.coefficients[mask]
        n = len(ids) - len(c) + 1
        if n < 1:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        known = np.ones(n, bool)
        for k in np.flatnonzero(c):
            known &= ids[k : k + n] != 0
        at = np.flatnonzero(known)
        total = np.full(len(at), mask + 1, np.uint64)
        for k in np.flatnonzero(c):
            w = ids[at + k] * np.uint64(0x9E3779B97F4A7C15)
            total += (w ^ (w >> np.uint64(29))) * c[k]
        return total, at

    def hits(self, ids: np.ndarray) -> np.ndarray:
        """Distinct (item, diagonal) of all seed hits; the diagonal is the position in ids less that in the item."""
        out = []
        for m in range(len(self.coefficients)):
            h, at = self.hashes(ids, m)
            if not len(h):
                continue
            left, right = np.searchsorted(self.keys, h, side="left"), np.searchsorted(self.keys, h, side="right")
            some = np.flatnonzero(right > left)
            if len(some):
                many = right[some] - left[some]
                idx = np.repeat(left[some] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
                w = self.where[idx]
                out.append(np.stack([w[:, 0], np.repeat(at[some], many) - w[:, 1]], axis=1))
        return np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 2), np.int64)


def overlap(a: np.ndarray, b: np.ndarray, spacing: int = 6) -> tuple[int, int, int]:
    """Of two aligned rows of words: longest equal run; longest stretch in which substituted words stand at least `spacing`
    apart and the ends agree; substituted words in it. A word that is no item word (0) differs from everything."""
    wrong = np.flatnonzero((a != b) | (a == 0))
    edges = np.concatenate([[-1], wrong, [len(a)]])
    gaps = np.diff(edges)
    run = int(gaps.max() - 1)
    if not len(wrong):
        return run, run, 0
    # a longest stretch reaches from the substitution before a chain of tolerated ones to the one after it
    broken = np.flatnonzero(gaps[1:-1] < spacing)
    first, last = np.concatenate([[0], broken + 1]), np.concatenate([broken, [len(wrong) - 1]])
    # it must neither begin nor end with a substitution
    head, tail = gaps[first] == 1, gaps[last + 1] == 1
    length = edges[last + 2] - edges[first] - 1 - head - tail
    best = int(length.max())
    return (run, best, int((last - first + 1 - head - tail)[length == best].min())) if best > 0 else (0, 0, 0)


def longer(x: tuple[int, int, int], y: tuple[int, int, int]) -> tuple[int, int, int]:
    """Two results of `overlap` as one: the longer run, and the longer stretch, of equal ones that with fewer substitutions."""
    stretch = max((x[1], -x[2]), (y[1], -y[2]))
    return max(x[0], y[0]), stretch[0], -stretch[1]


def leaked(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = 13, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(item_id, doc_id, run_words, overlap_words, substitutions) for every document with an overlap of at least `least` words.

    overlap_words is the longest stretch of the two texts in which single substituted words stand at least six apart, and
    substitutions the number of these in it; run_words is the longest run of equal consecutive words in any alignment with
    an overlap of `least` words, and need not lie in that stretch. One row for each item and document that overlap; every document is searched as a whole, documents
    or items without text or with fewer than `least` words give none, equal texts under several ids each their own rows.
    Only the named columns are read.

    Items of up to BLOCK_WORDS words are hashed once and searched for in one pass over the corpus, which is never shuffled.
    More of them are joined: see `_joined`. No seed is too frequent to be followed up.
    """
    spark = documents.sparkSession
    if least < len(MASKS[0]):
        raise ValueError(f"overlaps of fewer than {len(MASKS[0])} words can't be found with these seeds")
    chosen = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("t IS NOT NULL")
    corpus = documents.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).where("t IS NOT NULL")
    kinds = [x.schema[0].dataType.simpleString() for x in (chosen, corpus)]
    schema = f"i {kinds[0]}, d {kinds[1]}, run_words int, overlap_words int, substitutions int"
    size = chosen.agg(F.sum(F.length("t"))).first()[0] or 0
    if size <= 2 * block_words:  # a word and what divides it from the next have two characters at least
        own = Seeds.of([(r.i, r.t) for r in chosen.orderBy("i", "t").collect()])
        plain = (own.vocabulary, own.items, own.ids, own.coefficients, own.keys, own.where)  # workers may lack the package
        found = corpus.mapInArrow(_search(spark.sparkContext.broadcast(plain), least, to_arrow_type(chosen.schema["i"].dataType)), schema)
    else:
        found = _joined(chosen, corpus, least, schema)
    # an item text given twice under one id is one item
    return found.groupBy("i", "d").agg(F.max("run_words").alias("run_words"), F.max("overlap_words").alias("overlap_words"), F.min_by("substitutions", F.struct(-F.col("overlap_words"), "substitutions")).alias("substitutions")).withColumnsRenamed({"i": item_id, "d": doc_id})


def _seed_rows(key: str):
    """A function that turns (key, t) into (key, h): the hashed seeds of each text; `passes` keeps those that may be wanted."""

    def make(passes=None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seeds = Seeds({}, [], [], coefficients(), np.empty(0, np.uint64), np.empty((0, 3), np.int64))
            codes: dict[str, int] = {}
            bits = None if passes is None else np.frombuffer(passes.value, np.uint8)
            for batch in batches:
                for k, t in zip(batch.column(key), batch.column("t").to_pylist()):
                    if len(codes) > 1_000_000:
                        codes.clear()
                    row = np.array([codes.get(w) or codes.setdefault(w, word_code(w)) for w in words(t)], np.uint64)
                    out = np.unique(np.concatenate([seeds.hashes(row, m)[0] for m in range(len(MASKS))]))
                    if bits is not None:
                        at = (out >> np.uint64(20)) % np.uint64(8 * len(bits))
                        out = out[(bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
                    for i in range(0, len(out), 100_000):
                        part = out[i : i + 100_000].view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(part), batch.schema.field(key).type), pa.array(part)], names=[key, "h"])

        return run

    return make


def _filter(seeds: DataFrame, size: int):
    """The fixed number of bits, as a broadcast, in which every wanted seed has its own set. Tasks set bits in parts of the
    filter, one row each, so that what comes to the driver is the filter and no seed."""
    part = 1 << 20
    at = F.pmod(F.shiftrightunsigned("h", 20), F.lit(size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bits = None, None
        for batch in batches:
            for p, b in zip(batch.column("p").to_pylist(), batch.column("b").to_pylist()):
                if p != now:
                    if now is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([bits.tobytes()])], names=["p", "bits"])
                    now, bits = p, np.zeros(part // 8, np.uint8)
                bits[b >> 3] |= 1 << (b & 7)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([bits.tobytes()])], names=["p", "bits"])

    rows = seeds.select(F.floor(at / part).cast("bigint").alias("p"), (at % part).cast("int").alias("b")).distinct()
    packed = rows.repartition("p").sortWithinPartitions("p").mapInArrow(run, "p bigint, bits binary")
    whole = bytearray(size // 8)
    for r in packed.toLocalIterator():
        whole[r.p * part // 8 : (r.p + 1) * part // 8] = r.bits
    return seeds.sparkSession.sparkContext.broadcast(bytes(whole))


def _joined(chosen: DataFrame, corpus: DataFrame, least: int, schema: str, size: int = FILTER_BITS) -> DataFrame:
    """The overlaps of any number of items: the seeds of the corpus that pass the filter are joined with those of the items,
    and each pair that shares one is compared. The corpus is read twice, whatever the number of items."""
    items = cut(chosen.withColumn("a", F.monotonically_increasing_id()), "items")
    texts = cut(corpus.withColumn("b", F.monotonically_increasing_id()), "texts")
    kinds = [x.schema[c].dataType.simpleString() for x, c in ((items, "a"), (texts, "b"))]
    wanted = cut(items.select("a", "t").mapInArrow(_seed_rows("a")(), f"a {kinds[0]}, h bigint"), "seeds")
    found = texts.select("b", "t").mapInArrow(_seed_rows("b")(_filter(wanted, size)), f"b {kinds[1]}, h bigint")
    pairs = found.join(wanted, "h").select("a", "b").distinct()
    both = pairs.join(items.withColumnRenamed("t", "s"), "a").join(texts, "b").select("i", "s", "d", "t")
    types = to_arrow_type(items.schema["i"].dataType), to_arrow_type(texts.schema["d"].dataType)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, s, d, t in zip(*[batch.column(c).to_pylist() for c in ("i", "s", "d", "t")]):
                seeds = Seeds.of([(i, s)])
                row = np.array([seeds.vocabulary.get(w, 0) for w in words(t)], np.uint64)
                item, best = seeds.items[0], (0, 0, 0)
                for _, diagonal in seeds.hits(row).tolist():
                    lo, hi = max(0, diagonal), min(len(row), diagonal + len(item))
                    got = overlap(row[lo:hi], item[lo - diagonal : hi - diagonal]) if hi - lo >= least else (0, 0, 0)
                    best = longer(best, got) if got[1] >= least else best
                if best[1] >= least:
                    out.append((i, d, *best))
            if out:
                cols = [pa.array([r[c] for r in out], k) for c, k in enumerate((*types, pa.int32(), pa.int32(), pa.int32()))]
                yield pa.RecordBatch.from_arrays(cols, names=["i", "d", "run_words", "overlap_words", "substitutions"])

    return both.mapInArrow(compare, schema)


def _search(shared, least: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = Seeds(*shared.value)
        get, gap = seeds.vocabulary.get, [0] * 64

        def search(docs: list, starts: list[int], ids: list[int]) -> list[tuple]:
            row = np.array(ids, np.uint64)
            begin = np.array(starts)
            best: dict[tuple, tuple[int, int, int]] = {}
            for item, diagonal in seeds.hits(row).tolist():
                t = seeds.items[item]
                # seeds hit inside one document, so the document is the one that holds the middle of the hit
                lo, hi = max(0, diagonal), min(len(row), diagonal + len(t))
                for k in range(int(np.searchsorted(begin, lo, side="right")) - 1, len(starts)):
                    a = max(lo, starts[k] if k >= 0 else 0)
                    if k >= 0 and starts[k] >= hi:
                        break
                    b = min(hi, starts[k + 1] - 64 if k + 1 < len(starts) else len(row))
                    if k < 0 or b - a < least:
                        continue
                    got = overlap(row[a:b], t[a - diagonal : b - diagonal])
                    if got[1] >= least:
                        key = (seeds.ids[item], docs[k])
                        best[key] = longer(best.get(key, got), got)
            return [(*k, *v) for k, v in best.items()]

        for batch in batches:
            docs, starts, ids, out = [], [], [], []
            for d, t in zip(batch.column("d").to_pylist(), batch.column("t").to_pylist()):
                docs.append(d)
                starts.append(len(ids))
                ids += [get(w, 0) for w in words(t)]
                ids += gap
                if len(ids) > CHUNK_WORDS:
                    out += search(docs, starts, ids)
                    docs, starts, ids = [], [], []
            if docs:
                out += search(docs, starts, ids)
            cols = [pa.array([r[0] for r in out], id_type), pa.array([r[1] for r in out], batch.schema.field("d").type)] + [pa.array([r[c] for r in out], pa.int32()) for c in (2, 3, 4)]
            if out:
                yield pa.RecordBatch.from_arrays(cols, names=["i", "d", "run_words", "overlap_words", "substitutions"])

    return run
