"""Subjects of documents by a seeded non-negative factorisation of the document-term matrix.

The counts V are approximated by W H, one component per subject, in the sense of the Kullback-Leibler divergence. With
the rows of H summing to one, W[d, s] is the number of words of document d that component s accounts for. The components
start from seed words and stay anchored by them; the update of W (documents apart from each other) alternates with that
of H (sums over all documents).

H is a table keyed by term and every term of the corpus is in it. The columns of the most frequent terms, a bounded number,
are sent to all workers; those of the others reach their documents by joins.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoloom.storage import cut, drop_cut

CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Letters only, at least three, not next to a digit: parts of hashes and encoded blobs are no words.
WORD = re.compile(r"(?<![^\W_])[^\W\d_]{3,}(?![^\W_])")


@dataclass(frozen=True)
class Settings:
    """head_terms: most frequent terms whose columns of H are broadcast (8 bytes and 4 a subject each), the others are
    joined. max_labelled: labelled documents that seed words are taken from, the bound of the sample. lift: how much more
    often a seed word stands in documents of its subject. rounds: updates of H at most; they end when the words that the
    components account for change by less than `tolerance` of all. least: words in a document that make a subject; one or
    two are mentions in passing."""

    head_terms: int = 200_000
    max_labelled: int = 50_000
    lift: float = 8.0
    rounds: int = 3
    tolerance: float = 1e-3
    inner: int = 6
    last: int = 12
    least: float = 2.4
    default: str = "software"


def term_code(word: str) -> int:
    """64 bits that stand for a word."""
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little", signed=True)


def term_counts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(d, terms, counts): hashed words of each whole text and how often they stand in it. A null text has none."""
    chosen = documents.select(F.col(doc_id).alias("d"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code: dict[str, int] = {}
        for b in batches:
            terms, counts, offsets = [], [], [0]
            for t in b.column("t").to_pylist():
                seen = Counter(WORD.findall(CAMEL.sub(" ", t).lower())) if t else {}
                if len(code) > 500_000:
                    code.clear()
                for w, n in seen.items():
                    c = code.get(w)
                    if c is None:
                        c = code[w] = term_code(w)
                    terms.append(c)
                    counts.append(n)
                offsets.append(len(terms))
            o = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("d"), pa.ListArray.from_arrays(o, pa.array(terms, pa.int64())), pa.ListArray.from_arrays(o, pa.array(counts, pa.int32()))], names=["d", "terms", "counts"]
            )

    kind = chosen.schema["d"].dataType.simpleString()
    return chosen.mapInArrow(run, f"d {kind}, terms array<bigint>, counts array<int>")


def _values(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(start of each row's list, all elements) of a column of lists."""
    offs = column.offsets.to_numpy()
    return offs - offs[0], column.values.slice(offs[0], offs[-1] - offs[0])


def _entries(batch: pa.RecordBatch, terms: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, index or -1, term, count, column of H) of every entry of a batch, rows ascending; the index is that in `terms`,
    the broadcast ones; entries of other terms stand in the list `tail`."""
    starts, code = _values(batch.column("terms"))
    code = code.to_numpy()
    n = _values(batch.column("counts"))[1].to_numpy().astype(np.float32)
    row = np.repeat(np.arange(batch.num_rows), np.diff(starts))
    at = np.minimum(np.searchsorted(terms, code), max(0, len(terms) - 1))
    known = terms[at] == code if len(terms) else np.zeros(len(code), bool)
    row, at, code, n = row[known], at[known], code[known], n[known]
    columns = h[at]
    if "tail" in batch.schema.names:
        offs, rest = _values(batch.column("tail"))
        if len(rest):
            theirs = _values(rest.field("h"))[1].to_numpy().astype(np.float32).reshape(len(rest), -1)
            own = np.repeat(np.arange(batch.num_rows), np.diff(offs))
            row = np.concatenate([row, own])
            at = np.concatenate([at, np.full(len(rest), -1)])
            code = np.concatenate([code, rest.field("t").to_numpy()])
            n = np.concatenate([n, rest.field("n").to_numpy().astype(np.float32)])
            columns = np.concatenate([columns, theirs])
            order = np.argsort(row, kind="stable")
            row, at, code, n, columns = row[order], at[order], code[order], n[order], columns[order]
    return row, at, code, n, columns


def _fold(docs: int, row: np.ndarray, n: np.ndarray, columns: np.ndarray, inner: int) -> tuple[np.ndarray, np.ndarray]:
    """W of a batch by multiplicative updates with H fixed, and the counts that each component accounts for, by entry."""
    k = columns.shape[1]
    w = np.zeros((docs, k), np.float32)
    if not len(row):
        return w, np.zeros((0, k), np.float32)
    first = np.flatnonzero(np.diff(row, prepend=-1))
    place = np.cumsum(np.diff(row, prepend=row[0]) > 0)
    own = np.repeat((np.add.reduceat(n, first) / k)[:, None], k, axis=1).astype(np.float32)
    for _ in range(inner):
        part = own[place] * columns
        part *= (n / np.maximum(part.sum(1), 1e-30))[:, None]
        own = np.maximum(np.add.reduceat(part, first, axis=0), 1e-9)
    w[row[first]] = own
    return w, part


def _pieces(batches: Iterator[pa.RecordBatch], size: int = 512) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, size):
            yield b.slice(i, size)


def _vocabulary(counts: DataFrame) -> DataFrame:
    """(t, df, every) of every term: documents that hold it, its share of all words."""
    pairs = counts.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).select(F.col("x.terms").alias("t"), F.col("x.counts").alias("n"))
    sums = cut(pairs.groupBy("t").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("n")), "vocabulary")
    total = sums.agg(F.sum("n")).first()[0] or 1
    return sums.select("t", "df", (F.col("n") / float(total)).alias("every"))


def _seeded(counts: DataFrame, vocabulary: DataFrame, labels: DataFrame, subjects: list[str], described: dict[str, str], s: Settings) -> DataFrame:
    """The first H, (t, df, every, h): seed words of each subject, and all words for the default one."""
    spark = counts.sparkSession
    k = len(subjects)
    one = labels.where(F.col("subject").isin(subjects)).select("doc_id", "subject").dropna().distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("subject").alias("subject")).where("n = 1")
    sample = cut(one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.max_labelled).select("doc_id", "subject"), "labelled")
    per = {r["subject"]: r["count"] for r in sample.groupBy("subject").count().collect()}
    n = [per.get(x, 0) for x in subjects]
    # every word stands once in a document's list, so this counts documents
    own = counts.join(sample, counts["d"] == sample["doc_id"]).select("subject", F.explode("terms").alias("t")).groupBy("t").agg(*[F.count(F.when(F.col("subject") == x, 1)).alias(f"d{i}") for i, x in enumerate(subjects)])
    own = own.select("t", *[F.when(F.col(f"d{i}") >= 2, F.col(f"d{i}")).otherwise(0).alias(f"d{i}") for i in range(k)])
    words = {(term_code(w), i) for i, x in enumerate(subjects) for w in WORD.findall((described.get(x) or "").lower())}
    told = spark.createDataFrame(sorted(words), "t bigint, i int").groupBy("t").agg(F.collect_set("i").alias("told"))
    seeds = vocabulary.join(own, "t", "left").join(told, "t", "left")  # descriptions are a few sentences
    every = F.col("every")
    d = [F.coalesce(f"d{i}", F.lit(0)) for i in range(k)]
    all_ = sum(d[1:], d[0])

    def column(i: int) -> Column:
        if subjects[i] == s.default:
            return every
        share, other = d[i] / (n[i] + 1), (all_ - d[i] + 0.05) / (sum(n) - n[i] + 1)
        h = F.when((d[i] >= 2) & (share / other > s.lift), share).otherwise(1e-6 * every)
        return F.when(F.coalesce(F.array_contains("told", i), F.lit(False)) & (every < 1e-3), F.greatest(h, F.lit(0.05))).otherwise(h)

    first = cut(seeds.select("t", "df", "every", *[column(i).alias(f"h{i}") for i in range(k)]), "seeds")
    told = first.agg(*[F.sum(f"h{i}") for i in range(k)], *[F.max(F.col(f"h{i}") > 1.5e-6 * every) for i in range(k)]).first()
    # a component without any seed word would be that of all words once more; it accounts for nothing
    parts = [F.col(f"h{i}") / told[i] if told[k + i] else F.lit(0.0) for i in range(k)]
    scaled = cut(first.select("t", "df", "every", F.array(*parts).alias("h")), "h")
    drop_cut(first)
    return scaled


def mixtures(documents: DataFrame, labels: DataFrame, subjects: list[str], described: dict[str, str] | None = None, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, words): for each document the number of its words that each of `subjects` accounts for, in their order.

    Every document comes out, those without text with zeros. Labels: doc_id, subject; repeated ones count once, documents
    with several subjects or unknown ones are no seeds. Only columns named here are read.
    """
    s = settings
    spark = documents.sparkSession
    counts = cut(term_counts(documents).withColumn("k", F.monotonically_increasing_id()), "terms")  # k: ids may be repeated
    vocabulary = _vocabulary(counts)
    state = _seeded(counts, vocabulary, labels, subjects, described or {}, s)
    base, k = subjects.index(s.default), len(subjects)
    names = [f"h{i}" for i in range(k)]
    head = cut(state.orderBy(F.desc("df"), "t").limit(s.head_terms).select("t"), "head")
    rare = state.count() > s.head_terms
    entries = None
    if rare:  # the entries of terms beyond the head, kept for all rounds
        pairs = counts.select("k", F.explode(F.arrays_zip("terms", "counts")).alias("x")).select("k", F.col("x.terms").alias("t"), F.col("x.counts").alias("n"))
        entries = cut(pairs.join(head, "t", "left_anti"), "rare")

    def ready(h: DataFrame):
        """Terms and columns of the head as a broadcast, and the documents with their other entries."""
        rows = h.join(head, "t", "left_semi").select("t", F.col("h").cast("array<float>").alias("h")).toArrow()
        order = np.argsort(rows.column("t").to_numpy())
        table = np.asarray(rows.column("h").combine_chunks().flatten().to_numpy(), np.float32).reshape(-1, k)[order]
        shared = spark.sparkContext.broadcast((rows.column("t").to_numpy()[order], table))
        if entries is None:
            return shared, counts
        lists = entries.join(h.select("t", "h"), "t").groupBy("k").agg(F.collect_list(F.struct("t", "n", "h")).alias("tail"))
        return shared, counts.join(lists, "k", "left").withColumn("tail", F.coalesce("tail", F.array().cast(lists.schema["tail"].dataType)))

    mass: np.ndarray | None = None
    for _ in range(s.rounds):
        shared, rows = ready(state)
        inner = s.inner

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            terms, h = shared.value
            total = np.zeros((len(terms), k))
            names_ = ["t", *[f"h{i}" for i in range(k)]]
            for b in _pieces(batches):
                row, at, code, n, columns = _entries(b, terms, h)
                _, part = _fold(b.num_rows, row, n, columns, inner)
                known = at >= 0
                for i in range(k):
                    total[:, i] += np.bincount(at[known], part[known, i], len(total))
                if not known.all():
                    rest = part[~known].astype(float)
                    yield pa.RecordBatch.from_arrays([pa.array(code[~known]), *[pa.array(rest[:, i]) for i in range(k)]], names=names_)
            some = np.flatnonzero(total.sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(terms[some].astype(np.int64)), *[pa.array(total[some, i]) for i in range(k)]], names=names_)

        sums = cut(rows.mapInArrow(gather, "t bigint, " + ", ".join(f"{c} double" for c in names)).groupBy("t").agg(*[F.sum(c).alias(c) for c in names]), "sums")
        shared.unpersist()
        totals = np.array([x or 0.0 for x in sums.agg(*[F.sum(c) for c in names]).first()])
        new = state.select("t", "df", "every").join(sums, "t", "left").na.fill(0.0, names)
        parts = [F.col(c) / max(float(x), 1e-30) for c, x in zip(names, totals)]
        parts[base] = 0.95 * parts[base] + 0.05 * F.col("every")  # any word may stand in any document
        old, state = state, cut(new.select("t", "df", "every", F.array(*parts).alias("h")), "h")
        drop_cut(old, sums)
        moved = 1.0 if mass is None else float(np.abs(totals - mass).sum()) / max(float(totals.sum()), 1.0)
        mass = totals
        if moved < s.tolerance:
            break

    shared, rows = ready(state)
    last = s.last

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, h = shared.value
        for b in _pieces(batches):
            row, _, _, n, columns = _entries(b, terms, h)
            w, _ = _fold(b.num_rows, row, n, columns.reshape(-1, k), last)
            offsets = pa.array(np.arange(0, w.size + 1, k), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("d"), pa.ListArray.from_arrays(offsets, pa.array(w.ravel().astype(float)))], names=["d", "words"])

    kind = counts.schema["d"].dataType.simpleString()
    return rows.mapInArrow(assign, f"d {kind}, words array<double>").withColumnRenamed("d", "doc_id")


def assign_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, subject): every subject that accounts for at least settings.least words of a document, else the default one.

    subjects: subject, description (a fixed, small table). The default subject may be missing from it.
    """
    rows = subjects.select("subject", "description").where("subject IS NOT NULL").orderBy("subject").collect()
    names = [r.subject for r in rows]
    if settings.default not in names:
        names.append(settings.default)
    words = mixtures(documents, labels, names, {r.subject: r.description for r in rows}, settings)
    own = F.array(*[F.when(F.get("words", F.lit(i)) >= settings.least, F.lit(x)) for i, x in enumerate(names) if x != settings.default])
    own = F.filter(own, lambda x: x.isNotNull())
    return words.select("doc_id", F.explode(F.when(F.size(own) > 0, own).otherwise(F.array(F.lit(settings.default)))).alias("subject"))


__all__ = ["Settings", "assign_subjects", "mixtures", "term_counts"]
