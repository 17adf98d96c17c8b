"""Schemas that drift between files: matching by similarity flooding, one consistent table, a list of every change.

Every file's schema becomes a graph: objects hold fields, a field has a type, words in its name and values with a profile.
The canonical schema is a graph of the same kind; the profiles of its fields are those of the columns, in any file, that
bear one of their names. Scores of pairs of nodes are propagated between pairs that are joined by edges of one label in
both graphs, until they no longer change; then consistent (one to one) pairs are selected.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoloom.storage import cut, drop_cut, salted_join

#: Types from narrow to wide; a column has the widest of its non-null values.
TYPE_NAMES = ("integer", "float", "string")


def leaf(name: str) -> str:
    """The key itself of a name that has the keys of the objects around it in front."""
    return name.rsplit("/", 1)[-1].replace("~1", "/").replace("~0", "~")


def keys(name: Column) -> Column:
    """The keys of a name from the outermost object to the value."""
    return F.transform(F.split(name, "/"), lambda k: F.replace(F.replace(k, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))


@dataclass(frozen=True)
class Target:
    """A canonical field: names it is known under, its type, and whether it is asked for."""

    name: str
    aliases: tuple[str, ...]
    type: str = "float"
    wanted: bool = False


#: What a profile holds, and how far two loads of one column differ at least in it.
PROFILE = {"numeric": 0.15, "negative": 0.1, "whole": 0.15, "unit": 0.15, "log_mean": 0.35, "log_spread": 0.25, "bases": 0.15, "length": 1.0}
#: What a label's edges carry to the fields: words, type, values, object. A name is one more word; values tell most.
LABEL_WEIGHTS = (1.0, 1.0, 1.5, 1.0)
#: Likeness of types: the widest of a column's values may be wider than the canonical one.
TYPE_LIKE = {("integer", "float"): 0.6, ("float", "string"): 0.4, ("integer", "string"): 0.4}


def content_type(kind: str, profile: list[float] | None) -> str:
    """The type of a column's values: numbers that are written as texts count as numbers."""
    return kind if kind != "string" or profile is None or profile[0] < 0.8 else "integer" if profile[2] > 0.95 else "float"


@dataclass(frozen=True)
class Flooding:
    """The canonical schema and the limits of the matching; picklable, used by the workers.

    profiles: (mean, spread) of the profile of each target whose values are known. rounds: limit of the propagation, which
    ends as soon as no score moves by more than `tolerance`. least: part of the best score that a pair must have.
    contradiction: likeness below which values can't be those of a target, unless the column bears one of its names.
    """

    targets: tuple[Target, ...]
    profiles: dict[str, tuple[tuple[float, ...], tuple[float, ...]]] = field(default_factory=dict)
    tolerance: float = 1e-4
    rounds: int = 500
    least: float = 0.02
    contradiction: float = 0.01

    def tokens(self, name: str) -> list[str]:
        parts = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", leaf(name))
        return sorted({p.lower() for p in parts}) or [name.lower()]

    @staticmethod
    def near(a: str, b: str) -> float:
        """Likeness of two names: shared pairs of letters, with the ends marked."""
        if a == b:
            return 1.0
        x, y = ({f"^{s}$"[i : i + 2] for i in range(len(s) + 1)} for s in (a, b))
        return 0.9 * 2 * len(x & y) / (len(x) + len(y))

    def value_likeness(self, profile: list[float] | None) -> list[float]:
        """Likeness of a column's values to those of each target; a tenth, as of most pairs, where nothing is known."""
        out = []
        for t in self.targets:
            known = self.profiles.get(t.name)
            if profile is None or known is None:
                out.append(0.1)
                continue
            d = [(p - m) ** 2 / (s * s + f * f) for p, m, s, f in zip(profile, *known, PROFILE.values())]
            out.append(math.exp(-0.5 * sum(min(x, 25.0) for x in d) / 2))
        return out

    def match(self, columns: list[tuple[str, str, list[float] | None]], memory: dict | None = None) -> dict[str, tuple[str, float]]:
        """columns: (name, type, profile of the values). Returns the column and score selected for each target that has one.
        memory: name likenesses kept from call to call."""
        n, m = len(columns), len(self.targets)
        if not n:
            return {}
        memory = {} if memory is None else memory
        if len(memory) > 50_000:
            memory.clear()

        def remembered(key: tuple, make: Callable[[], list[float]]) -> list[float]:
            if key not in memory:
                memory[key] = make()
            return memory[key]

        plain = lambda s: re.sub(r"[^a-z0-9]", "", s.lower()) or s.lower()

        def named(name: str) -> list[float]:
            own = leaf(name)
            p = plain(own)
            same = lambda a: p == plain(a) or self.tokens(own) == self.tokens(a)  # noqa: E731  the same words in another order or dress
            return [1.0 if own in t.aliases else max(0.95 if same(a) else 0.7 * self.near(p, plain(a)) for a in t.aliases) for t in self.targets]

        def edges(rows: list[list[str]]) -> tuple[list[str], np.ndarray]:
            """Nodes at the other end and the edges to them."""
            names = sorted({w for r in rows for w in r})
            at = {w: k for k, w in enumerate(names)}
            e = np.zeros((len(rows), len(names)))
            for i, r in enumerate(rows):
                e[i, [at[w] for w in r]] = 1.0
            return names, e

        # names and words recur from file to file
        start = np.array([remembered(("name", c[0]), lambda c=c: named(c[0])) for c in columns])
        words, word_here = edges([self.tokens(c[0]) for c in columns])
        there_words, word_there = edges([sorted({w for a in t.aliases for w in self.tokens(a)}) for t in self.targets])
        types, type_here = edges([[content_type(c[1], c[2])] for c in columns])
        there_types, type_there = edges([[t.type] for t in self.targets])
        objects, held_here = edges([[c[0].rpartition("/")[0]] for c in columns])
        like = lambda a, b: 1.0 if a == b else TYPE_LIKE.get((b, a), 0.5 if a == "none" else 0.0)
        labels = [  # edges of one label here and there, first scores of the pairs at their other ends
            (word_here, word_there, np.array([remembered(("word", a), lambda a=a: [1.0 if a == b else 0.5 * self.near(a, b) for b in there_words]) for a in words])),
            (type_here, type_there, np.array([[like(a, b) for b in there_types] for a in types])),
            (np.eye(n), np.eye(m), np.array([self.value_likeness(c[2]) for c in columns])),
            (held_here, np.ones((m, 1)), np.array([[1.0 / (1 + o.count("/") + (o != ""))] for o in objects])),
        ]
        flows = []
        for here, there, first in labels:  # a pair's score is shared among its neighbours of the label
            down = here / here.sum(1, keepdims=True), there / there.sum(1, keepdims=True)
            up = here / here.sum(0, keepdims=True), there / there.sum(0, keepdims=True)
            flows.append((down, up, first))
        x, ends = start.copy(), [f[2].copy() for f in flows]
        for _ in range(self.rounds):
            nx = start + x
            for (_, up, first), y, weight in zip(flows, ends, LABEL_WEIGHTS):
                nx = nx + weight * (up[0] @ (first + y) @ up[1].T)
            ny = [first + y + down[0].T @ (start + x) @ down[1] for (down, _, first), y in zip(flows, ends)]
            # each kind of node is scaled by its own best pair
            nx, ny = nx / max(nx.max(), 1e-12), [y / max(y.max(), 1e-12) for y in ny]
            moved = max(float(np.abs(nx - x).max()), *[float(np.abs(a - b).max()) for a, b in zip(ny, ends)])
            x, ends = nx, ny
            if moved < self.tolerance:
                break
        # pairs are taken from the best downwards; a field with another's values bears a known name or none of that target's
        found: dict[str, tuple[str, float]] = {}
        used: set[int] = set()
        values = labels[2][2]
        total = np.where((start < 1) & (values < self.contradiction), 0.0, x + start)
        for flat in np.argsort(-total, axis=None, kind="stable"):
            i, j = divmod(int(flat), m)
            if i in used or self.targets[j].name in found or total[i, j] <= self.least * total.max():
                continue
            used.add(i)
            found[self.targets[j].name] = (columns[i][0], float(x[i, j]))
        return found


def _numeric(text: Column) -> Column:
    """The number in a text such as 64589, 57,950 or n=77006, else null."""
    return F.regexp_replace(F.trim(text), r"^[A-Za-z]=|(?<=[0-9]),(?=[0-9]{3})", "").try_cast("double")


def number_stats(x: Column) -> list[Column]:
    """What profile_of needs of a column's numbers."""
    size = F.log10(F.when(x != 0, F.abs(x)))
    count = lambda c: F.count(F.when(c, 1))
    return [
        F.count(x).alias("numbers"), count(x < 0).alias("negative"), count(x == F.rint(x)).alias("whole"), count(x.between(0, 1)).alias("unit"),
        F.avg(size).alias("log_mean"), F.stddev_pop(size).alias("log_spread"),
    ]


def profile_of(filled: Column) -> Column:
    """The profile of a column of which `filled` values aren't null, null without any."""
    share = lambda c, of: F.coalesce(F.try_divide(F.col(c), of), F.lit(0.0))
    texts = F.col("numbers") < 0.5 * filled
    profile = F.array(
        share("numbers", filled), *[share(c, F.col("numbers")) for c in ("negative", "whole", "unit")], F.coalesce("log_mean", F.lit(0.0)), F.coalesce("log_spread", F.lit(0.0)),
        share("bases", filled), F.when(texts, F.coalesce("length", F.lit(0.0))).otherwise(0.0),
    )
    return F.when(filled > 0, profile)


def reference_profiles(table: DataFrame, load: str, columns: dict[str, str]) -> DataFrame:
    """(target, profile) of each load of a table whose columns are known: target by name of a column of numbers. All rows
    count, one aggregation over them; values that are null or not finite don't."""
    real = lambda c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double"))
    loads = table.groupBy(load).agg(*[F.struct(*number_stats(real(c))).alias(t) for t, c in columns.items()])
    long = loads.select(F.inline(F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).alias("s")) for t in columns]))).select("target", "s.*")
    stats = long.where("numbers > 0").withColumns({"bases": F.lit(0), "length": F.lit(0.0)})
    return stats.select("target", profile_of(F.col("numbers")).alias("profile"))


def file_columns(records: DataFrame) -> DataFrame:
    """(file_id, name, width, n, profile) of every key of every file; keys of nested objects, however deep, are named
    parent/key, with ~ and / within a key written as ~0 and ~1.

    width is the widest type of the non-null values as a position in TYPE_NAMES, null without any. profile has the places
    of PROFILE, null without any value. Payloads that are null or no JSON object contribute nothing. Whole numbers beyond
    64 bits count as float.
    """
    base = records.where("file_id IS NOT NULL").select("file_id", F.try_parse_json("payload").alias("v"))
    out: DataFrame | None = None
    level = base.select("file_id", F.lit("").alias("prefix"), "v").where("schema_of_variant(v) LIKE 'OBJECT%'")
    while True:
        pairs = level.sparkSession.sql("SELECT d.file_id, concat(d.prefix, replace(replace(e.key, '~', '~0'), '/', '~1')) AS name, e.value AS v FROM {level} d, LATERAL variant_explode(d.v) e", level=level)
        typed = pairs.select("file_id", "name", F.schema_of_variant("v").alias("t"), F.try_variant_get("v", "$", "string").alias("s"))
        typed = typed.withColumn("x", F.when(F.col("t").rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.col("s").try_cast("double")).when(F.col("t") == "STRING", _numeric(F.col("s"))))
        width = F.when(F.col("t") == "VOID", None).when(F.col("t") == "BIGINT", 0).when(F.col("t").rlike("^(DECIMAL|DOUBLE|FLOAT)"), 1).otherwise(2)
        count = lambda c: F.count(F.when(c, 1))
        stats = cut(
            typed.groupBy("file_id", "name").agg(
                F.max(width).alias("width"), F.count(F.lit(1)).alias("n"), count(F.col("t") == "VOID").alias("nulls"),
                count(F.col("t").startswith("OBJECT")).alias("objects"), *number_stats(F.col("x")),
                count(F.upper("s").rlike("^[ACGT]+$")).alias("bases"), F.avg(F.length("s")).alias("length"),
            ),
            "columns",
        )
        out = stats if out is None else out.unionByName(stats)
        if stats.where("objects > 0").isEmpty():
            break
        level = pairs.where("schema_of_variant(v) LIKE 'OBJECT%'").select("file_id", F.concat("name", F.lit("/")).alias("prefix"), "v")
    filled = F.col("n") - F.col("nulls")
    # what is nothing but objects is told by its keys
    return out.where((F.col("objects") == 0) | (F.col("objects") < filled)).select("file_id", "name", "width", "n", profile_of(filled).alias("profile"))


def with_profiles(columns: DataFrame, flooding: Flooding, reference: DataFrame | None = None) -> Flooding:
    """The canonical schema with the profiles of the columns, in any file, that bear one of its names, and of the reference:
    one row a target comes to the driver."""
    names = [(a, t.name) for t in flooding.targets for a in t.aliases]
    lookup = F.create_map(*[F.lit(x) for pair in names for x in pair])
    own = columns.select(F.element_at(lookup, F.element_at(keys(F.col("name")), -1)).alias("target"), "profile").where("target IS NOT NULL AND profile IS NOT NULL")
    own = own if reference is None else own.unionByName(reference)
    at = lambda k: F.get("profile", F.lit(k))
    sums = [f(at(k)).alias(f"{c}{k}") for k in range(len(PROFILE)) for c, f in (("m", F.avg), ("s", F.stddev_pop))]
    rows = own.groupBy("target").agg(*sums).collect()
    k = range(len(PROFILE))
    return replace(flooding, profiles=flooding.profiles | {r.target: (tuple(r[f"m{i}"] for i in k), tuple(r[f"s{i}"] for i in k)) for r in rows})


def correspondences(columns: DataFrame, flooding: Flooding) -> DataFrame:
    """(file_id, field_name, name, score, width) of every wanted target found in a file."""
    files = columns.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("name", F.coalesce("width", F.lit(-1)).alias("width"), "profile"))).alias("cols"))
    wanted = {t.name for t in flooding.targets if t.wanted}
    # rows are few and small, but each takes a while: a fixed number of tasks, which isn't coalesced by size
    files = files.repartition(4 * int(columns.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory: dict = {}
        for batch in batches:
            out = []
            for file_id, cols in zip(batch.file_id, batch.cols):
                seen = [(c["name"], TYPE_NAMES[c["width"]] if c["width"] >= 0 else "none", c["profile"]) for c in cols]
                widths = {c["name"]: c["width"] for c in cols}
                out += [(file_id, f, name, score, widths[name] if widths[name] >= 0 else None) for f, (name, score) in flooding.match(seen, memory).items() if f in wanted]
            yield pd.DataFrame(out, columns=["file_id", "field_name", "name", "score", "width"]).astype({"width": "Int32"})

    kind = columns.schema["file_id"].dataType.simpleString()
    return files.mapInPandas(run, f"file_id {kind}, field_name string, name string, score double, width int")


def changes(files: DataFrame, matched: DataFrame, wanted: list[str]) -> DataFrame:
    """(file_id, field_name, change_kind): added, removed, renamed and retyped against the file before in the feed.

    files: file_id, feed, seq_no (gapless within a feed; rows with a null in these are no part of any feed). The first
    file of a feed has no changes. A field without any non-null value has no type and is never retyped. Of files with one
    number in a feed the one with the largest file_id counts, as sent again.
    """
    order = files.select("file_id", "feed", "seq_no").dropna().groupBy("feed", "seq_no").agg(F.max("file_id").alias("file_id"))
    steps = order.join(order.select("feed", (F.col("seq_no") + 1).alias("seq_no"), F.col("file_id").alias("prev_id")), ["feed", "seq_no"])
    grid = steps.select("file_id", "prev_id", F.explode(F.array(*[F.lit(w) for w in wanted])).alias("field_name"))
    now = matched.select("file_id", "field_name", "name", "width")
    then = matched.select(F.col("file_id").alias("prev_id"), "field_name", F.col("name").alias("name0"), F.col("width").alias("width0"))
    both = grid.join(now, ["file_id", "field_name"], "left").join(then, ["prev_id", "field_name"], "left")
    kinds = F.array(
        F.when(F.col("name").isNotNull() & F.col("name0").isNull(), "added"),
        F.when(F.col("name").isNull() & F.col("name0").isNotNull(), "removed"),
        F.when(F.col("name") != F.col("name0"), "renamed"),
        F.when(F.col("width") != F.col("width0"), "retyped"),
    )
    return both.select("file_id", "field_name", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("change_kind"))


@dataclass
class Drift:
    """changes, the correspondences they follow from, and all records in one table."""

    changes: DataFrame
    matched: DataFrame
    table: DataFrame


def reconcile(records: DataFrame, files: DataFrame, flooding: Flooding, casts: dict[str, str], reference: DataFrame | None = None) -> Drift:
    """Matches every file's schema to the canonical one, lists the changes along each feed, and casts and unites all records.

    records: record_id, file_id, payload (one JSON object); other columns are ignored. casts: type of each wanted field in
    the table. Texts such as 57,950 or n=77006 are read as numbers; what can't be cast becomes null. Every record comes
    out once, repeated ones as often as they stand, those without a readable payload or file with nulls. reference: profiles
    of fields as reference_profiles gives them, beside those that the files' own columns with known names tell.
    """
    columns = file_columns(records)
    matched = cut(correspondences(columns, with_profiles(columns, flooding, reference)), "matched")
    wanted = list(casts)
    names = matched.groupBy("file_id").agg(*[F.max(F.when(F.col("field_name") == w, F.col("name"))).alias(f"__{w}") for w in wanted])
    names = names.select("file_id", *[keys(F.col(f"__{w}")).alias(f"__{w}") for w in wanted])
    flat = salted_join(records.select("record_id", "file_id", "payload"), names, ["file_id"], "left")
    whole = F.try_parse_json("payload")
    flat = flat.withColumn("__map", F.when(F.schema_of_variant(whole).startswith("OBJECT"), F.from_json("payload", "map<string,string>")))

    def value(w: str) -> Column:
        path = F.col(f"__{w}")
        inner = F.aggregate(path, F.col("payload"), lambda json, k: F.try_element_at(F.from_json(json, "map<string,string>"), k))
        x = _numeric(F.when(F.size(path) > 1, inner).otherwise(F.try_element_at("__map", F.get(path, F.lit(0)))))
        return (x.try_cast("bigint") if casts[w] == "bigint" else x).alias(w.lower())

    table = flat.select("record_id", "file_id", *[value(w) for w in wanted])
    return Drift(changes(files, matched, wanted), matched, table)
