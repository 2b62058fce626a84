"""Call and dependency graphs: neighbours, reachability, cycles, unused nodes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomix.storage import Scratch

#: Edges of so many bytes or fewer, measured as names and two numbers, are searched by one task.
TASK_BYTES = 8 << 20


def call_maps(edges: DataFrame) -> DataFrame:
    """name, calls, called_by: sorted distinct neighbours of every function."""
    calls = edges.groupBy(F.col("caller").alias("name")).agg(F.array_sort(F.collect_set("callee")).alias("calls"))
    called = edges.groupBy(F.col("callee").alias("name")).agg(F.array_sort(F.collect_set("caller")).alias("called_by"))
    none = F.array().cast("array<string>")
    return calls.join(called, "name", "full").select("name", F.coalesce("calls", none).alias("calls"), F.coalesce("called_by", none).alias("called_by"))


def usage_map(edges: DataFrame) -> DataFrame:
    """callee, n_callers and first_caller of every name that is called."""
    return edges.groupBy("callee").agg(F.count_distinct("caller").alias("n_callers"), F.min("caller").alias("first_caller"))


def neighbours(edges: DataFrame, names: DataFrame) -> DataFrame:
    """name, calls, called_by of a few names; the edges of other nodes are dropped before they are gathered."""
    few = F.broadcast(names.select("name").distinct())
    calls = edges.join(few.withColumnRenamed("name", "caller"), "caller", "left_semi")
    called = edges.join(few.withColumnRenamed("name", "callee"), "callee", "left_semi")
    return call_maps(calls.select("caller", "callee").unionByName(called.select("caller", "callee"))).join(few, "name", "left_semi")


def reachable(edges: DataFrame, roots: DataFrame, depth: int | None, reverse: bool = False) -> DataFrame:
    """root, name, depth: nodes within so many steps of each root (any number if None), at their least depth; cyclic if the
    root reaches itself.

    ``roots``: a frame with the column root.  All visited nodes are one table, rewritten each round with
    the new front, so a node is expanded once for each root however many paths lead to it, and no plan grows
    with the rounds.  A small front is broadcast after a check of its size.
    """
    scratch = Scratch(edges.sparkSession, "reachable")
    a, b = ("callee", "caller") if reverse else ("caller", "callee")
    step = scratch.write(edges.select(F.col(a).alias("name"), F.col(b).alias("next")).distinct())
    start = roots.select("root", F.col("root").alias("name")).distinct()
    seen = scratch.write(start.withColumn("depth", F.lit(0)).limit(0))
    front, d, n = scratch.write(start), 0, 0
    while depth is None or d < depth:
        d += 1
        met = scratch.join_small(step, front, ["name"], "inner").select("root", F.col("next").alias("name"))
        # One shuffle tells new nodes from seen ones: a node's least depth.
        now = scratch.write(seen.unionByName(met.withColumn("depth", F.lit(d))).groupBy("root", "name").agg(F.min("depth").alias("depth")))
        grown = now.count()
        scratch.drop(seen, front)
        seen = now
        if grown == n:
            break
        n, front = grown, scratch.write(now.filter(F.col("depth") == d).select("root", "name"))
    return seen


def _least_of_component(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the least node of its strong component, -1 where no cycle passes: Tarjan's walk without recursion."""
    order = np.argsort(a, kind="stable")
    heads, first = b[order].tolist(), np.searchsorted(a[order], np.arange(n + 1)).tolist()
    at, seen, low, is_open, loops = first[:-1], [0] * n, [0] * n, bytearray(n), set(a[a == b].tolist())
    out, stack, clock = np.full(n, -1), [], 0
    for root in range(n):
        path = [] if seen[root] else [root]
        while path:
            v = path[-1]
            if not seen[v]:
                clock += 1
                seen[v] = low[v] = clock
                stack.append(v)
                is_open[v] = 1
            if at[v] < first[v + 1]:
                w = heads[at[v]]
                at[v] += 1
                if not seen[w]:
                    path.append(w)
                elif is_open[w]:
                    low[v] = min(low[v], seen[w])
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[v])
            if low[v] == seen[v]:
                members = []
                while not members or members[-1] != v:
                    members.append(stack.pop())
                    is_open[members[-1]] = 0
                if len(members) > 1 or v in loops:
                    out[members] = min(members)
    return out


def _components_by_task(edges: DataFrame) -> DataFrame:
    """strong_components of the distinct edges a, b by one task, in time and memory of their number."""

    def run(batches):
        rows = [x for x in batches if x.num_rows]
        if not rows:
            return
        pairs = pa.Table.from_batches(rows)
        coded = pa.chunked_array([*pairs["a"].chunks, *pairs["b"].chunks]).combine_chunks().dictionary_encode()
        names = coded.dictionary.take(order := pc.sort_indices(coded.dictionary))
        rank = np.empty(len(names), "int64")
        rank[order.to_numpy()] = np.arange(len(names))
        ends = rank[coded.indices.to_numpy()]
        least = _least_of_component(ends[: pairs.num_rows], ends[pairs.num_rows :], len(names))
        found = np.flatnonzero(least >= 0)
        yield pa.RecordBatch.from_arrays([names.take(pa.array(found)), names.take(pa.array(least[found]))], names=["name", "component"])

    return edges.coalesce(1).mapInArrow(run, edges.select(F.col("a").alias("name"), F.col("b").alias("component")).schema)


def strong_components(edges: DataFrame) -> DataFrame:
    """name, component (the least name of it): the nodes that lie on cycles, of whatever length.

    Nodes without a way in or out are cut off; as soon as what is left is measured to be small, one task
    walks it.  Else the least name that reaches a node is its colour; the nodes that reach their colour's own node
    within the colour are its component, and the search goes on without them.  Each round is a
    table of nodes; nothing is collected.
    """
    scratch = Scratch(edges.sparkSession, "components")
    now = scratch.write(edges.select(F.col("caller").alias("a"), F.col("callee").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL").distinct())
    out = scratch.write(now.select(F.col("a").alias("name"), F.col("b").alias("component")).limit(0))
    held = F.coalesce(F.sum(F.octet_length(F.col("a").cast("string")) + F.octet_length(F.col("b").cast("string")) + 16), F.lit(0))
    while True:
        size = -1
        while (left := now.agg(held).first()[0]) != size:
            if left <= TASK_BYTES:
                return scratch.write(out.unionByName(_components_by_task(now)))
            size = left
            inner = now.join(now.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(now.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
            now = scratch.write(inner.select("a", "b"))
        colour = scratch.write(now.select(F.col("a").alias("name")).distinct().withColumn("colour", F.col("name")))
        while True:
            offered = now.join(colour, now["a"] == colour["name"]).select(F.col("b").alias("name"), "colour")
            less = scratch.write(colour.unionByName(offered).groupBy("name").agg(F.min("colour").alias("colour")))
            changed = not less.join(colour, ["name", "colour"], "left_anti").isEmpty()
            colour = less
            if not changed:
                break
        within = now.join(colour.withColumnsRenamed({"name": "a", "colour": "ca"}), "a").join(colour.withColumnsRenamed({"name": "b", "colour": "cb"}), "b").filter("ca = cb").select("a", "b")
        within = scratch.write(within)
        found = scratch.write(colour.filter("name = colour").select("name", F.col("colour").alias("component")))
        size = -1
        while (left := found.count()) != size:
            size = left
            back = within.join(found, within["b"] == found["name"]).select(F.col("a").alias("name"), "component")
            found = scratch.write(found.unionByName(back).distinct())
        # A node between two cycles is alone and does not call itself: it is gone, but on no cycle.
        many = found.groupBy("component").count().filter("count > 1").select("component")
        cyclic = many.unionByName(within.filter("a = b").select(F.col("a").alias("component"))).distinct()
        out = scratch.write(out.unionByName(found.join(cyclic, "component", "left_semi").select("name", "component")))
        gone = found.select(F.col("name").alias("a"))
        now = scratch.write(now.join(gone, "a", "left_anti").join(gone.withColumnRenamed("a", "b"), "b", "left_anti").select("a", "b"))


def cycles(edges: DataFrame, depth: int | None = None) -> DataFrame:
    """cycle, an array of names from its least one on: each simple cycle once, of any number of edges, or of
    at most ``depth`` where that is given.

    Only edges within strong components are walked.  Paths start at the least node of a cycle and never
    return to a node; a round lengthens all of them by an edge, and the closed ones are set aside.  The
    number of simple cycles can be exponential; strong_components tells the nodes on cycles without listing them.
    """
    scratch = Scratch(edges.sparkSession, "cycles")
    part = strong_components(edges)
    e = edges.select(F.col("caller").alias("a"), F.col("callee").alias("b")).distinct()
    e = scratch.write(e.join(part.select(F.col("name").alias("a"), F.col("component").alias("ca")), "a").join(part.select(F.col("name").alias("b"), F.col("component").alias("cb")), "b").filter("ca = cb").select("a", "b"))
    paths = scratch.write(e.filter("b >= a").select(F.col("a").alias("root"), F.array("a").alias("path"), F.col("b").alias("next")))
    closed, n = scratch.write(paths.filter("next = root").select(F.col("path").alias("cycle"))), 1
    while depth is None or n < depth:
        n += 1
        open_ = paths.filter("next <> root").select("root", F.concat("path", F.array("next")).alias("path"), F.col("next").alias("a"))
        paths = scratch.write(open_.join(e, "a").filter((F.col("b") == F.col("root")) | ((F.col("b") > F.col("root")) & ~F.array_contains("path", F.col("b")))).select("root", "path", F.col("b").alias("next")))
        if paths.isEmpty():
            break
        closed = closed.unionByName(scratch.write(paths.filter("next = root").select(F.col("path").alias("cycle"))))
    return closed


def unused(names: DataFrame, edges: DataFrame) -> DataFrame:
    """Names that nothing else calls."""
    return names.select("name").distinct().join(edges.filter("caller <> callee").select(F.col("callee").alias("name")).distinct(), "name", "left_anti")


def call_hierarchy(edges: DataFrame, root: str, depth: int | None = 5, reverse: bool = False) -> DataFrame:
    """name, depth and has_cycle of everything that a root calls, or that calls it."""
    roots = edges.sparkSession.createDataFrame([(root,)], "root string")
    found = reachable(edges, roots, depth, reverse)
    return found.select("name", "depth", (F.col("name") == F.col("root")).alias("has_cycle"))


def dependency_edges(imports: DataFrame, files: DataFrame, source: str = "resolved", path: str = "file_path") -> DataFrame:
    """caller, callee: importing and imported file, for imports of files that exist."""
    targets = files.select(F.col(path).alias(source)).distinct()
    return imports.join(targets, source).select(F.col(path).alias("caller"), F.col(source).alias("callee")).distinct()


def unused_exports(exports: DataFrame, imports: DataFrame) -> DataFrame:
    """file_path and exported of named exports that no file imports."""
    used = imports.select(F.col("resolved").alias("file_path"), F.col("imported").alias("exported")).distinct()
    every = imports.filter(F.col("imported") == "*").select(F.col("resolved").alias("file_path")).distinct()
    named = exports.filter(F.col("exported") != "default").select("file_path", "exported").distinct()
    return named.join(used, ["file_path", "exported"], "left_anti").join(every, "file_path", "left_anti")
