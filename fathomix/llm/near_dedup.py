"""Near-duplicate groups by min-max hashing with exact confirmation of links.

A document's set holds its distinct k-word shingles.  Each of 75 permutations gives two signature
values, the minimum and the maximum over the set, so that 150 values cost 75 hash evaluations a
shingle.  30 bands of 5 values find candidates: at the threshold of 0.85 a pair shares no band with a
probability of 2e-8, and less above it.  Links are confirmed on full sets.

Plan.  Documents of equal sets collapse into one class first, so copies never meet.  In each bucket
every class is checked against the smallest id (a star, not all pairs) and components are formed.  Only
buckets that still hold several components are searched for links between different ones: of two linked classes
of different components, one at least is outside the bucket's largest.  Those few are the probes.  A class
goes to one block of its bucket, of bounded size, and each probe to every block, where an inverted index counts
what it shares with the block's members; a task returns no more than one link for each merger of
components.  Stars are searched in the same way, with the smallest id as the one probe.  Shingles are
hashed once for each class; from there on, sets of 64-bit hashes travel in place of texts.  So no link that shares
a band is lost, no group of pairs is written out, and no task holds an unbounded group.

Defined cases: texts without words or null have an empty set and are linked with nothing; fewer than k
words form one shingle; rows that repeat an id are one node, reported row by row; a null id is reported
with a null component; an empty table gives no rows; other columns are ignored in reports.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomix.llm.arrow import map_text
from fathomix.llm.components import connected_components
from fathomix.llm.textbytes import NON_SPACE, Powers, Words, mix64, odd_numbers, shingles, slices
from fathomix.storage import Scratch

SHINGLE = 5
PERCENT = 85
BANDS, ROWS = 30, 5
#: A block of a group: so many classes and shingles at most, on average.
BLOCK_CLASSES, BLOCK_SHINGLES = 512, 4_000_000

SKETCH = [T.StructField("n_shingles", T.LongType()), T.StructField("set_a", T.LongType()), T.StructField("set_b", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]


def distinct_sets(texts: pa.Array, k: int, powers: Powers) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    sh, limits = shingles(Words(texts, NON_SPACE, powers), k)
    out = []
    for a, b in zip(limits[:-1].tolist(), limits[1:].tolist(), strict=True):
        s = np.sort(sh[a:b])
        out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s)
    return out


def sketcher(k: int, bands: int, rows: int):
    """A function from texts to the values of SKETCH."""
    powers = Powers()
    half = (bands + 1) // 2
    times = (odd_numbers(half * rows, 5) >> np.uint64(31)).astype(np.uint32) | np.uint32(1)
    plus = (odd_numbers(half * rows, 6) >> np.uint64(32)).astype(np.uint32)
    weights, salts = odd_numbers(rows, 7), odd_numbers(bands, 8)

    def sketch(texts: pa.Array) -> list:
        sets = distinct_sets(texts, k, powers)
        sig = np.zeros((len(sets), 2, half * rows), np.uint32)
        key = np.zeros((len(sets), 2), np.uint64)
        for i, s in enumerate(sets):
            if not len(s):
                continue
            key[i, 0], key[i, 1] = mix64(s).sum(dtype=np.uint64), mix64(s ^ np.uint64(0x5BF03635)).sum(dtype=np.uint64)
            low, high = np.full(len(times), 0xFFFFFFFF, np.uint32), np.zeros(len(times), np.uint32)
            x = (s >> np.uint64(32)).astype(np.uint32)
            for at in range(0, len(x), 2048):
                h = x[None, at : at + 2048] * times[:, None] + plus[:, None]
                np.minimum(low, h.min(axis=1), out=low)
                np.maximum(high, h.max(axis=1), out=high)
            sig[i, 0], sig[i, 1] = low, high
        full = sig.reshape(len(sets), 2 * half, rows)[:, :bands].astype(np.uint64)
        hashed = mix64((full * weights).sum(axis=2, dtype=np.uint64) + salts).view(np.int64)
        sizes = np.array([len(s) for s in sets], np.int64)
        none = sizes == 0
        limits = np.concatenate([[0], np.cumsum(np.where(none, 0, bands))]).astype(np.int32)
        keys = [pa.array(key[:, j].view(np.int64), mask=none) for j in (0, 1)]
        return [sizes, *keys, pa.ListArray.from_arrays(pa.array(limits), pa.array(hashed[~none].ravel()))]

    return sketch


class Block:
    """Members with an inverted index of their shingles; probes merge components."""

    def __init__(self, ids: list[int], comps: list[int], sets: list[np.ndarray], percent: int):
        self.ids, self.percent = ids, percent
        self.number: dict[int, int] = {}
        self.alias: dict[int, int] = {}
        self.label = np.array([self.label_of(c) for c in comps])
        self.sizes = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(ids)), self.sizes)
        self.terms, inverse = np.unique(np.concatenate(sets), return_inverse=True)
        self.postings = owner[np.argsort(inverse, kind="stable")]
        self.limits = np.concatenate([[0], np.cumsum(np.bincount(inverse, minlength=len(self.terms)))])

    def label_of(self, comp: int) -> int:
        x = self.number.setdefault(comp, len(self.number))
        while x in self.alias:
            x = self.alias[x]
        return x

    def links(self, node: int, comp: int, shingles: np.ndarray) -> list[tuple[int, int]]:
        """Links of a probe to members of other components, one for each merger."""
        own = self.label_of(comp)
        open_ = self.label != own
        if not open_.any():
            return []
        at = np.minimum(np.searchsorted(self.terms, shingles), len(self.terms) - 1)
        at = at[self.terms[at] == shingles]
        if not len(at):
            return []
        both = np.bincount(np.concatenate([self.postings[a:b] for a, b in zip(self.limits[at].tolist(), self.limits[at + 1].tolist(), strict=True)]), minlength=len(self.ids))
        out = []
        for j in np.flatnonzero(open_ & (100 * both >= self.percent * (len(shingles) + self.sizes - both))).tolist():
            other = int(self.label[j])
            if other != own:
                out.append((node, self.ids[j]))
                self.label[self.label == other] = own
                self.alias[other] = own
        return out


#: A row of a search: its group and block, whether it only probes, whether it is a probe among the members, and the class.
SEARCHED = ["group", "block", "probe", "minor", "id", "component", "shingles"]


def _search(percent: int):
    """Rows of SEARCHED, sorted by group, block and probe, to links (u, v)."""

    def run(batches):
        key, members, block = None, [], None
        out: list[tuple[int, int]] = []

        def ready() -> Block:
            made = Block([m[1] for m in members], [m[2] for m in members], [m[3] for m in members], percent)
            for minor, node, comp, of in members:
                if minor:
                    out.extend(made.links(node, comp, of))
            return made

        for batch in batches:
            for group, number, probe, minor, node, comp, data in zip(*(batch.column(c).to_pylist() for c in SEARCHED), strict=True):
                if (group, number) != key:
                    if block is None and len(members) > 1 and any(m[0] for m in members):
                        ready()
                    key, members, block = (group, number), [], None
                of = np.frombuffer(data, np.uint64)
                if not probe:
                    members.append((minor, node, comp, of))
                elif members:
                    block = block or ready()
                    out += block.links(node, comp, of)
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.int64()) for j in (0, 1)], names=["u", "v"])
            out.clear()
        if block is None and len(members) > 1 and any(m[0] for m in members):
            ready()
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.int64()) for j in (0, 1)], names=["u", "v"])

    return run


def _set_bytes(k: int):
    """A function from texts to their sorted distinct shingle hashes as bytes."""
    powers = Powers()
    return lambda texts: [[s.tobytes() for s in distinct_sets(texts, k, powers)]]


def _blocks(n: str, shingles: str):
    """The number of blocks of a group of so many classes and shingles."""
    return F.ceil(F.greatest(F.col(n) / BLOCK_CLASSES, F.col(shingles) / BLOCK_SHINGLES)).cast("int")


def _links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of rows (group, block, probe, minor, id, component), a block and its probes in one task."""
    dealt = rows.join(sets, "id").repartition("group", "block").sortWithinPartitions("group", "block", "probe")
    return dealt.select(*SEARCHED).mapInArrow(_search(percent), "u long, v long")


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs.

    ``percent``: documents are linked if 100 * intersection >= percent * union.  doc_id is an integer.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    docs = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    sketch = scratch.write(map_text(docs, "text", SKETCH, lambda: sketcher(k, bands, rows), ["id"]))
    classes = scratch.write(sketch.filter("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min("id").alias("rep")).filter("rep IS NOT NULL"))

    own = sketch.join(classes.withColumnRenamed("rep", "id"), ["set_a", "set_b", "id"], "left_semi")
    members = own.select("id", "n_shingles", F.explode("bands").alias("bucket"))
    buckets = scratch.write(members.groupBy("bucket").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    shared = scratch.write(members.join(buckets, "bucket").select("bucket", "id", "n_shingles", "rep"))
    texts = docs.join(shared.select("id").distinct(), "id", "left_semi")
    sets = scratch.write(map_text(texts, "text", [T.StructField("shingles", T.BinaryType())], lambda: _set_bytes(k), ["id"]))

    component = scratch.write(connected_components(_stars(shared, sets, scratch, percent), scratch))
    component = _residual(shared, sets, component, scratch, percent)
    of_class = classes.join(component, classes["rep"] == component["id"], "left").select("set_a", "set_b", F.coalesce("component", "rep").alias("component"))
    of_class = scratch.write(of_class)
    scratch.keep_only(sketch, of_class)
    out = sketch.join(of_class, ["set_a", "set_b"], "left")
    component_id = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", component_id.alias("component_id"), F.coalesce(F.col("id") == component_id, F.lit(True)).alias("kept"))


def _stars(shared: DataFrame, sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Links of the classes of buckets with the smallest id there, of sizes that allow one."""
    sizes = shared.filter("id = rep").select("rep", F.col("n_shingles").alias("size")).distinct()
    pairs = shared.filter("id <> rep").select("id", "rep", "n_shingles").distinct().join(sizes, "rep")
    pairs = scratch.write(pairs.filter(100 * F.least("size", "n_shingles") >= percent * F.greatest("size", "n_shingles")).select("id", "rep", "n_shingles"))
    hubs = scratch.write(pairs.groupBy("rep").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("total")).select("rep", _blocks("n", "total").alias("blocks")))
    members = pairs.join(hubs, "rep").select(F.col("rep").alias("group"), F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), F.lit(False).alias("probe"), F.lit(False).alias("minor"), "id", F.col("id").alias("component"))
    probes = hubs.select(F.col("rep").alias("group"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("probe"), F.lit(False).alias("minor"), F.col("rep").alias("id"), F.col("rep").alias("component"))
    return scratch.write(_links(members.unionByName(probes), sets, percent))


def _residual(shared: DataFrame, sets: DataFrame, component: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """component after the links between different components of the same bucket have been added."""
    labelled = scratch.write(shared.join(component, "id", "left").select("bucket", "id", "n_shingles", F.coalesce("component", "id").alias("component")))
    parts = labelled.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("total"))
    open_ = parts.groupBy("bucket").agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n"), F.sum("total").alias("total"), F.max(F.struct("n", "component"))["component"].alias("largest"))
    open_ = scratch.write(open_.filter("parts > 1 AND n > 2").select("bucket", "largest", _blocks("n", "total").alias("blocks")))
    rows = labelled.join(open_, "bucket").select(F.col("bucket").alias("group"), F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), "blocks", (F.col("component") != F.col("largest")).alias("minor"), "id", "component")
    rows = scratch.write(rows)
    members = rows.select("group", "block", F.lit(False).alias("probe"), "minor", "id", "component")
    probes = rows.filter("minor AND blocks > 1").select("group", F.explode(F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), F.col("block"))).alias("block"), F.lit(True).alias("probe"), "minor", "id", "component")
    links = _links(members.unionByName(probes), sets, percent)
    more = scratch.write(links.distinct())
    if more.isEmpty():
        return component
    label = labelled.select("id", "component").distinct()
    lifted = more.join(label.withColumnsRenamed({"id": "u", "component": "cu"}), "u").join(label.withColumnsRenamed({"id": "v", "component": "cv"}), "v").select(F.col("cu").alias("u"), F.col("cv").alias("v"))
    merged = scratch.write(connected_components(lifted, scratch).select(F.col("id").alias("component"), F.col("component").alias("to")))
    return scratch.write(label.join(merged, "component", "left").select("id", F.coalesce("to", "component").alias("component")))


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row group of docs for each component: the rows of its smallest id."""
    dropped = near_groups(docs, doc_id, text, **options).filter(~F.col("kept")).select(F.col("doc_id").alias(doc_id)).distinct()
    return docs.join(dropped, doc_id, "left_anti").select(*docs.columns)
