"""Queries of joins, graphs, changes and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomix.functions.text import epoch_micros
from fathomix.operators import changes, graph, joins, search, stats, symbols
from fathomix.plans.queries_retrieval import paths
from fathomix.plans.registry import query, table
from fathomix.sources import maintenance
from fathomix.streaming import changes as streams

#: Calls between parts: each calls the ones of twice and thrice its key.
_EDGES = "e AS (SELECT CAST(p_partkey AS VARCHAR) AS caller, CAST(m * p_partkey % 1000 AS VARCHAR) AS callee FROM part, (VALUES (2), (3)) t(m))"


def edge_table(spark, d) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, d, "part").select(key.cast("string").alias("caller"), F.explode(F.array((2 * key % 1000).cast("string"), (3 * key % 1000).cast("string"))).alias("callee"))


@query(f"WITH {_EDGES}, c AS (SELECT caller AS name, list_sort(list_distinct(list(callee))) AS calls FROM e GROUP BY caller), b AS (SELECT callee AS name, list_sort(list_distinct(list(caller))) AS called_by FROM e GROUP BY callee) SELECT name, coalesce(calls, []) AS calls, coalesce(called_by, []) AS called_by FROM c FULL JOIN b USING (name)")
def gr02_call_maps(spark, d):
    return graph.call_maps(edge_table(spark, d))


@query(f"WITH {_EDGES} SELECT DISTINCT caller FROM e WHERE callee = '600'")
def gr01_direct_callers(spark, d):
    edges = edge_table(spark, d).withColumn("file_path", F.lit("a"))
    none = spark.createDataFrame([], "file_path string, name string, line int")
    return symbols.callers(edges, none, "600").select("caller")


@query(f"""WITH RECURSIVE {_EDGES}, r AS (SELECT callee AS name, 1 AS depth FROM e WHERE caller = '7' UNION SELECT e.callee, depth + 1 FROM r JOIN e ON e.caller = r.name WHERE depth < 6)
SELECT name, CAST(min(depth) AS BIGINT) AS depth, name = '7' AS has_cycle FROM r GROUP BY name""")
def gr03_call_hierarchy(spark, d):
    """Everything that part 7 calls in up to 6 steps."""
    return graph.call_hierarchy(edge_table(spark, d), "7", 6).withColumn("depth", F.col("depth").cast("long"))


@query(f"""WITH RECURSIVE {_EDGES}, r AS (SELECT caller AS name, 1 AS depth FROM e WHERE callee = '600' UNION SELECT e.caller, depth + 1 FROM r JOIN e ON e.callee = r.name WHERE depth < 4)
SELECT name, CAST(min(depth) AS BIGINT) AS depth, name = '600' AS has_cycle FROM r GROUP BY name""")
def gr03_transitive_callers(spark, d):
    return graph.call_hierarchy(edge_table(spark, d), "600", 4, reverse=True).withColumn("depth", F.col("depth").cast("long"))


_FLOW = "f AS (SELECT DISTINCT event_type AS caller, next AS callee FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events) WHERE next IS NOT NULL)"


def flow_edges(spark, d) -> DataFrame:
    """An event type and the one that follows it for the same user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(F.col("event_type").alias("caller"), F.lead("event_type").over(w).alias("callee")).filter("callee IS NOT NULL").distinct()


@query(f"""WITH RECURSIVE {_FLOW}, p AS (SELECT caller AS root, callee AS last, [caller] AS path, caller = callee AS closed FROM f WHERE callee >= caller
UNION ALL SELECT p.root, f.callee, list_append(p.path, p.last), f.callee = p.root FROM p JOIN f ON f.caller = p.last WHERE NOT p.closed AND f.callee >= p.root AND f.callee <> p.last AND (f.callee = p.root OR NOT list_contains(p.path, f.callee)))
SELECT DISTINCT array_to_string(path, '>') AS cycle FROM p WHERE closed""")
def gr04_cycles(spark, d):
    return graph.cycles(flow_edges(spark, d)).select(F.array_join("cycle", ">").alias("cycle"))


@query(f"WITH {_EDGES} SELECT DISTINCT caller AS name FROM e WHERE caller NOT IN (SELECT callee FROM e WHERE caller <> callee)")
def join15_unused_functions(spark, d):
    e = edge_table(spark, d)
    return graph.unused(e.select(F.col("caller").alias("name")), e)


@query(f"WITH {_EDGES} SELECT callee, count(DISTINCT caller) AS n_callers, min(caller) AS first_caller FROM e GROUP BY callee")
def agg15_usage_map(spark, d):
    return graph.usage_map(edge_table(spark, d))


@query("""WITH x AS (SELECT 'f' || (p_partkey % 50) AS file_path, CASE WHEN p_partkey % 9 = 0 THEN 'default' ELSE p_name END AS exported FROM part), i AS (SELECT 'f' || (l_partkey % 50) AS file_path, CASE WHEN l_quantity > 49 AND l_partkey % 50 = 7 THEN '*' ELSE p_name END AS imported FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 48)
SELECT DISTINCT file_path, exported FROM x WHERE exported <> 'default' AND (file_path, exported) NOT IN (SELECT file_path, imported FROM i) AND file_path NOT IN (SELECT file_path FROM i WHERE imported = '*')""")
def join14_unused_exports(spark, d):
    """Names of parts that files export and no large line of an order imports."""
    k = F.col("p_partkey")
    exports = table(spark, d, "part").select(F.concat(F.lit("f"), k % 50).alias("file_path"), F.when(k % 9 == 0, "default").otherwise(F.col("p_name")).alias("exported"))
    lines = table(spark, d, "lineitem").filter("l_quantity > 48").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    imports = lines.select(F.concat(F.lit("f"), k % 50).alias("resolved"), F.when((F.col("l_quantity") > 49) & (k % 50 == 7), "*").otherwise(F.col("p_name")).alias("imported"))
    return graph.unused_exports(exports, imports)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def join11_key_violations(spark, d):
    """Orders of customers that a condition leaves out."""
    return joins.orphans(table(spark, d, "orders"), table(spark, d, "customer").filter("c_acctbal > 0"), "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@query("""SELECT file_path, (['definition', 'import', 'export', 'call'])[CAST(min(r) AS INT)] AS reference_type FROM (SELECT 'c' || c_custkey AS file_path, 1 AS r FROM customer WHERE c_nationkey % 7 = 3 UNION ALL SELECT 'c' || o_custkey, 2 FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 7 = 3
UNION ALL SELECT 'c' || o_custkey, 3 FROM orders WHERE o_orderpriority LIKE '1%' AND o_orderkey % 5 = 3 UNION ALL SELECT 'c' || o_custkey, 4 FROM orders WHERE o_orderkey % 3 = 0) GROUP BY file_path""")
def flt08_references(spark, d):
    """Customers as files that define, import, export or call the name n3."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    name = lambda k, m: F.concat(F.lit("n"), F.col(k) % m)
    path = lambda k: F.concat(F.lit("c"), F.col(k)).alias("file_path")
    defined = c.select(path("c_custkey"), F.when(F.col("c_custkey") % 2 == 0, name("c_nationkey", 7)).otherwise(F.concat(F.lit("K."), name("c_nationkey", 7))).alias("name"))
    imports = o.filter("o_orderstatus = 'F'").select(path("o_custkey"), name("o_orderkey", 7).alias("imported"), F.lit(None).cast("string").alias("local"))
    exports = o.filter("o_orderpriority LIKE '1%'").select(path("o_custkey"), F.lit("x").alias("exported"), name("o_orderkey", 5).alias("local"))
    calls = o.filter("o_orderkey % 3 = 0").select(path("o_custkey"), F.lit("n3").alias("callee"))
    return symbols.references(defined, calls, imports, exports, "n3")


@query("""WITH x AS (SELECT 'c' || (o_custkey % 20) AS file_path, 'f' || (o_orderkey % 30) AS caller, 'f' || (o_orderkey % 41) AS callee FROM orders), s AS (SELECT 'c' || (k % 20) AS file_path, 'f' || (k % 30) AS name, CAST(k AS INT) AS line, (['function', 'class'])[CAST(k % 2 + 1 AS INT)] AS kind FROM (SELECT c_custkey AS k FROM customer))
SELECT c.callee, s.file_path, s.kind, CAST(s.line AS BIGINT) AS line FROM (SELECT DISTINCT callee FROM x WHERE caller = 'f7') c LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY name ORDER BY kind <> 'function', file_path, line) AS n FROM s) s ON s.name = c.callee AND n = 1""")
def join06_callees(spark, d):
    """What the function f7 calls, with the first definition of each."""
    return symbols.callees(_named_calls(spark, d), _named_symbols(spark, d), "f7").select("callee", "file_path", "kind", F.col("line").cast("long").alias("line"))


@query("""WITH x AS (SELECT DISTINCT 'c' || (o_custkey % 20) AS file_path, 'f' || (o_orderkey % 30) AS caller FROM orders WHERE o_orderkey % 41 = 7), s AS (SELECT 'c' || (c_custkey % 20) AS file_path, 'f' || (c_custkey % 30) AS name, CAST(c_custkey AS INT) AS line FROM customer)
SELECT file_path, caller, CAST(line AS BIGINT) AS line FROM (SELECT x.file_path, x.caller, min(s.line) AS line, row_number() OVER (PARTITION BY x.file_path ORDER BY min(s.line) NULLS FIRST, x.caller) AS n FROM x LEFT JOIN s ON s.file_path = x.file_path AND s.name = x.caller GROUP BY 1, 2) WHERE n = 1""")
def join05_callers(spark, d):
    """One caller a file of the function f7."""
    return symbols.callers(_named_calls(spark, d), _named_symbols(spark, d), "f7", one_per_file=True).select("file_path", "caller", F.col("line").cast("long").alias("line"))


def _named_calls(spark, d) -> DataFrame:
    name = lambda k, m: F.concat(F.lit("f"), F.col(k) % m)
    return table(spark, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey") % 20).alias("file_path"), name("o_orderkey", 30).alias("caller"), name("o_orderkey", 41).alias("callee"))


def _named_symbols(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(F.concat(F.lit("c"), k % 20).alias("file_path"), F.concat(F.lit("f"), k % 30).alias("name"), k.cast("int").alias("line"), F.when(k % 2 == 0, "function").otherwise("class").alias("kind"))


@query(f"""WITH RECURSIVE {_EDGES}, r AS (SELECT DISTINCT caller AS a, callee AS b FROM e UNION SELECT r.a, e.callee FROM r JOIN e ON e.caller = r.b)
SELECT x.a AS name, min(x.b) AS component FROM r x JOIN r y ON y.a = x.b AND y.b = x.a GROUP BY x.a""")
def gr04_nodes_on_cycles(spark, d):
    """Parts whose calls come back to them, however many calls it takes."""
    return graph.strong_components(edge_table(spark, d))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def join10_cascade(spark, d):
    """Orders that are left when customers in debt are deleted."""
    return joins.cascade(table(spark, d, "customer").filter("c_acctbal < 0").withColumnRenamed("c_custkey", "o_custkey"), table(spark, d, "orders"), "o_custkey").select("o_orderkey", "o_custkey")


_CATALOG = "(VALUES ('region'), ('nation'), ('lost'), ('part'))"


@query(f"SELECT coalesce(a.t, b.t) AS table_name, CASE WHEN a.t IS NULL THEN 'missing' WHEN b.t IS NULL THEN 'extra' ELSE 'present' END AS status FROM (SELECT table_name AS t FROM information_schema.tables WHERE table_name IN ('region', 'nation', 'customer', 'part', 'orders')) a FULL JOIN {_CATALOG} b(t) ON a.t = b.t")
def join17_catalog_compare(spark, d):
    """Tables that are there against those expected."""
    found = spark.createDataFrame([(n,) for n in ("region", "nation", "customer", "part", "orders")], "table_name string")
    return stats.compare_catalog(found, spark.createDataFrame([(n,) for n in ("region", "nation", "lost", "part")], "table_name string"))


@query("SELECT 'i' || n_nationkey AS index_name, 'r' || n_regionkey AS table_name, r_regionkey IS NOT NULL AS present FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey <> 2) ON r_regionkey = n_regionkey")
def join16_index_tables(spark, d):
    """Nations as indexes of regions, one of which is missing."""
    indexes = table(spark, d, "nation").select(F.concat(F.lit("i"), "n_nationkey").alias("index_name"), F.concat(F.lit("r"), "n_regionkey").alias("table_name"))
    return stats.index_tables(indexes, table(spark, d, "region").filter("r_regionkey <> 2").select(F.concat(F.lit("r"), "r_regionkey").alias("table_name")))


@query("""SELECT left_id, arg_min(right_id, (gap, right_id)) AS right_id, CAST(min(gap) AS BIGINT) AS distance FROM (SELECT a.event_id AS left_id, b.event_id AS right_id, floor(epoch(b.ts) / 60) - floor(epoch(a.ts) / 60) AS gap FROM events a JOIN events b ON a.user_id = b.user_id
WHERE a.event_type = 'view' AND b.event_type = 'purchase') WHERE gap BETWEEN 1 AND 720 GROUP BY left_id""")
def ext15_nearest_following(spark, d):
    """For each view the same user's next purchase within 12 hours."""
    e = table(spark, d, "events").withColumn("minute", F.floor(epoch_micros(F.col("ts")) / 60_000_000).cast("long"))
    return joins.nearest_following(e.filter("event_type = 'view'"), e.filter("event_type = 'purchase'"), ["user_id"], "minute", 720, "event_id", "event_id")


@query("""SELECT point_id, arg_min(span_id, (n, span_id)) AS span_id FROM (SELECT p.l_linenumber + 10 * p.l_orderkey AS point_id, s.l_linenumber + 10 * s.l_orderkey AS span_id, s.l_quantity AS n FROM lineitem p JOIN lineitem s ON p.l_orderkey = s.l_orderkey AND s.l_linenumber <= p.l_linenumber AND s.l_linenumber + s.l_quantity >= p.l_linenumber + 1) GROUP BY point_id""")
def join12_innermost_span(spark, d):
    """For each line of an order the shortest span of lines that holds it."""
    li = table(spark, d, "lineitem").withColumn("id", F.col("l_linenumber") + 10 * F.col("l_orderkey"))
    spans = li.select("l_orderkey", "id", F.col("l_linenumber").cast("double").alias("start"), (F.col("l_linenumber") + F.col("l_quantity")).alias("stop"))
    points = li.select("l_orderkey", "id", F.col("l_linenumber").cast("double").alias("start"), (F.col("l_linenumber") + 1).cast("double").alias("stop"))
    return joins.innermost_container(points, spans, ["l_orderkey"], "start", "stop", "id", "id")


@query("SELECT p_partkey, p_name, n_lines, quantity FROM (SELECT l_partkey AS p_partkey, count(*) AS n_lines, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM lineitem GROUP BY 1 ORDER BY quantity DESC, p_partkey LIMIT 50) LEFT JOIN part USING (p_partkey)")
def join01_enriched_results(spark, d):
    """The 50 parts sold most, with their rows."""
    best = search.top(table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("quantity")), "quantity", 50, "p_partkey")
    return joins.enrich(best, table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey").select("p_partkey", "p_name", "n_lines", "quantity")


def _snapshots(spark, d) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_totalprice").alias("mtime"))
    k = F.col("path")
    return o.filter(k % 11 != 3), o.filter(k % 13 != 5).withColumn("mtime", F.when(k % 7 == 2, F.col("mtime") + 1).otherwise(F.col("mtime")))


_SNAPSHOTS = "o AS (SELECT o_orderkey AS path, o_totalprice AS mtime FROM orders), a AS (SELECT * FROM o WHERE path % 11 <> 3), b AS (SELECT path, CASE WHEN path % 7 = 2 THEN mtime + 1 ELSE mtime END AS mtime FROM o WHERE path % 13 <> 5)"
_COMPARED = f"{_SNAPSHOTS}, s AS (SELECT path, a.mtime AS old_version, b.mtime AS new_version, CASE WHEN a.mtime IS NULL THEN 'added' WHEN b.mtime IS NULL THEN 'deleted' WHEN b.mtime > a.mtime THEN 'updated' ELSE 'unchanged' END AS status FROM a FULL JOIN b USING (path))"


@query(f"WITH {_COMPARED} SELECT * FROM s")
def join07_snapshot_compare(spark, d):
    return changes.compare(*_snapshots(spark, d), "path", "mtime")


@query(f"WITH {_COMPARED} SELECT count(*) FILTER (WHERE status = 'added') AS added, count(*) FILTER (WHERE status = 'updated') AS updated, count(*) FILTER (WHERE status = 'unchanged') AS unchanged, count(*) FILTER (WHERE status = 'deleted') AS deleted FROM s")
def agg12_refresh_counts(spark, d):
    s = changes.compare(*_snapshots(spark, d), "path", "mtime")
    return s.agg(*(F.count_if(F.col("status") == x).alias(x) for x in ("added", "updated", "unchanged", "deleted")))


@query(f"WITH {_SNAPSHOTS} SELECT path, mtime FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY mtime DESC, n DESC) AS r FROM (SELECT *, 0 AS n FROM a UNION ALL SELECT *, 1 AS n FROM b)) WHERE r = 1")
def snk05_upsert(spark, d):
    return changes.upsert(*_snapshots(spark, d), "path", "mtime")


@query(f"WITH {_SNAPSHOTS} SELECT path, mtime FROM a WHERE path NOT IN (SELECT path FROM b)")
def snk06_delete(spark, d):
    a, b = _snapshots(spark, d)
    return changes.delete(a, b, "path")


@query("SELECT o_custkey, o_orderkey, CAST(r AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def win09_keep_latest(spark, d):
    kept = joins.per_group(table(spark, d, "orders"), 3, ["o_custkey"], [F.desc("o_orderdate"), "o_orderkey"])
    return kept.select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"))


_EVENT_KIND = "CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' WHEN 'purchase' THEN 'rename' ELSE 'modify' END"
_EVENTS = f"e AS (SELECT event_id AS id, user_id || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS path, {_EVENT_KIND} AS type, ts FROM events)"


def change_events(spark, d) -> DataFrame:
    """Events as changes of a file a user and day."""
    kind = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "purchase", "rename").otherwise("modify")
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.concat(F.col("user_id").cast("string"), F.lit("/"), F.to_date("ts").cast("string")).alias("path"), kind.alias("type"), "ts")


@query(f"""WITH {_EVENTS}, g AS (SELECT path, count(*) AS n_events, arg_min(type, (ts, id)) AS a, arg_max(type, (ts, id)) AS b, arg_min(id, (ts, id)) AS ai, arg_max(id, (ts, id)) AS bi, bool_and(type = 'modify') AS m FROM e GROUP BY path)
SELECT path, CASE WHEN a = 'create' AND b = 'modify' THEN ai ELSE bi END AS id, CASE WHEN a = 'create' AND b = 'modify' THEN a ELSE b END AS type, n_events FROM g WHERE NOT (a = 'create' AND b = 'delete' AND n_events > 1)""")
def str03_coalesced_events(spark, d):
    return changes.coalesced(change_events(spark, d)).select("path", "id", "type", "n_events")


@query(f"""WITH {_EVENTS}, g AS (SELECT path, count(*) AS n, arg_min(type, (ts, id)) AS a, arg_max(type, (ts, id)) AS b, min(ts) AS t0, max(ts) AS t1 FROM e GROUP BY path)
SELECT CAST(sum(n) AS BIGINT) AS total_events, count(*) AS unique_paths, count(*) FILTER (WHERE NOT (a = 'create' AND b = 'delete' AND n > 1)) AS coalesced_events, round(epoch(max(t1)) - epoch(min(t0)), 3) AS duration_s,
round((sum(n) - count(*) FILTER (WHERE NOT (a = 'create' AND b = 'delete' AND n > 1))) / sum(n), 6) AS compression_ratio FROM g""")
def agg13_buffer_stats(spark, d):
    out = changes.buffer_statistics(change_events(spark, d))
    return out.withColumns({"duration_s": F.round("duration_s", 3), "compression_ratio": F.round("compression_ratio", 6)})


@query("""WITH g AS (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) < 21600 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, count(*) AS n_events, arg_min(event_type, (ts, event_id)) AS first_type, arg_max(event_type, (ts, event_id)) AS last_type, min(ts) AS start, max(ts) AS stop FROM s GROUP BY user_id, session""")
def str04_debounce_sessions(spark, d):
    """Events of a user in sessions that 6 hours of silence end."""
    return changes.sessions(table(spark, d, "events"), "user_id", "ts", "6 hours", "event_type", "event_id")


@query(f"""WITH {_EVENTS}, g AS (SELECT path, list({{'id': id, 'type': type, 'ts': ts}} ORDER BY ts, id) AS l FROM e GROUP BY path)
SELECT path, l[-1].id AS id, l[-1].type AS type, l[-1].ts AS ts FROM g WHERE l[-1].type <> 'delete'""")
def str07_latest_events(spark, d):
    """The last change of each path that still exists."""
    return changes.latest_events(change_events(spark, d)).filter("type <> 'delete'").select("path", "id", "type", "ts")


@query(f"WITH {_EVENTS} SELECT path, CAST(floor(n / 5) AS BIGINT) AS part, count(*) AS n_events, string_agg(type, ',' ORDER BY n) AS types FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts, id) - 1 AS n FROM e) GROUP BY 1, 2")
def agg14_events_by_path(spark, d):
    """Each path's changes in order, in parts of five."""
    out = changes.events_by_path(change_events(spark, d), most=5)
    return out.select("path", F.col("part").cast("long").alias("part"), "n_events", F.array_join("types", ",").alias("types"))


@query("""SELECT user_id, bool_and(event_type <> 'error') AS ok, arg_min(CASE WHEN event_type = 'error' THEN 'E' || event_id END, CASE WHEN event_type = 'error' THEN (ts, event_id) END) AS error FROM events GROUP BY user_id""")
def agg16_first_failure(spark, d):
    """Whether all of a user's events went well, else the first error."""
    results = table(spark, d, "events").select("user_id", "ts", "event_id", (F.col("event_type") != "error").alias("ok"), F.concat(F.lit("E"), "event_id").alias("error"))
    return stats.first_failure(results, ["ts", "event_id"], "user_id")


@query("""WITH s AS (SELECT *, lag(ms) OVER w AS before, lag(cpu) OVER w AS cpu_before FROM (SELECT event_id, user_id, CAST(epoch_ms(ts) AS BIGINT) AS ms, value AS mem, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) * 100000 AS cpu, event_id % 150 AS lag FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id))
SELECT event_id, array_to_string(list_filter([CASE WHEN mem > 90 THEN 'memory critical' WHEN mem > 60 THEN 'memory' END, CASE WHEN lag > 100 THEN 'event loop' END, CASE WHEN ms > before AND 100.0 * (cpu - cpu_before) / (ms - before) > 80 THEN 'cpu' END], lambda x: x IS NOT NULL), ',') AS alerts FROM s""")
def str10_alerts(spark, d):
    """Samples of each user's events beyond limits of memory, lag and processor time."""
    total = F.sum("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id")) * 100000
    samples = table(spark, d, "events").select("event_id", "user_id", F.struct(F.floor(epoch_micros(F.col("ts")) / 1000).alias("ms"), "event_id").alias("o"), F.floor(epoch_micros(F.col("ts")) / 1000).alias("ms"), F.col("value").alias("memory_mb"), total.alias("cpu_ms"), (F.col("event_id") % 150).alias("lag_ms"))
    return stats.alerts(samples, "ms", "user_id", memory_mb=60).select("event_id", F.array_join("alerts", ",").alias("alerts"))


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_acctbal >= 0")
def snk13_search_mirror(spark, d):
    """The searchable copy of customers, of which those in debt are softly deleted."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_acctbal") < 0, F.lit(1)).alias("deleted_at"))
    return changes.mirror(rows, "id", "name")


@query("SELECT event_id, CAST(least(1000 * pow(2, event_id % 5), 30000) AS BIGINT) AS delay_ms FROM events WHERE event_type = 'error' AND event_id % 5 < 3")
def str07_retries(spark, d):
    """Failed events that may be tried again, and when."""
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "error", "FAILED").otherwise("DONE").alias("status"), (F.col("event_id") % 5).cast("int").alias("retry_count"))
    return streams.retryable(rows).select("event_id", "delay_ms")


@query(f"""WITH {_EVENTS}, t AS (SELECT *, least(CAST(floor(4.0 * (epoch_us(ts) - lo) / greatest(1, hi - lo)) AS INT), 3) AS b FROM e, (SELECT epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM e)),
g AS (SELECT path, b, count(*) AS n, list({{'id': id, 'type': type, 'ts': ts}} ORDER BY ts, id) AS l, bool_and(type = 'modify') AS m FROM t GROUP BY path, b),
c AS (SELECT path, b, CASE WHEN m THEN {{'id': l[-1].id, 'type': l[-1].type, 'ts': l[1].ts}} WHEN l[1].type = 'create' AND l[-1].type = 'modify' THEN l[1] ELSE l[-1] END AS r FROM g WHERE NOT (l[1].type = 'create' AND l[-1].type = 'delete' AND n > 1))
SELECT path, r.id AS id, r.type AS type, r.ts AS ts FROM (SELECT path, arg_max(r, b) AS r FROM c GROUP BY path) WHERE r.type <> 'delete'""")
def str08_streamed_changes(spark, d):
    """The events' changes applied batch by batch as a stream; the state of every path at the end."""
    return streams.replay(change_events(spark, d))


@query("SELECT 'null' AS kind, count(*) FILTER (WHERE text IS NULL) AS n FROM documents UNION ALL SELECT 'rows', count(*) FROM documents")
def snk15_column_statistics(spark, d):
    """Null texts and rows of documents, of the statistics of its columns."""
    one = maintenance.column_statistics(table(spark, d, "documents")).filter("column_name = 'text'")
    return one.select(F.explode(F.array(F.struct(F.lit("null").alias("kind"), F.col("n_null").alias("n")), F.struct(F.lit("rows").alias("kind"), F.col("n_rows").alias("n")))).alias("x")).select("x.*")


@query(" UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows, true AS has_bytes FROM {n}" for n in ("region", "part", "orders")))
def agg05_table_sizes(spark, d):
    """Rows of stored tables; their bytes depend on the writer."""
    out = stats.table_sizes(spark, {n: f"{d}/{n}.parquet" for n in ("region", "part", "orders")})
    return out.select("table_name", "n_rows", ((F.col("bytes") > 0) & (F.abs(F.col("mean_row") * F.col("n_rows") - F.col("bytes")) < 1)).alias("has_bytes"))


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, min(value) AS least, max(value) AS greatest, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def agg09_percentiles(spark, d):
    return stats.percentiles(table(spark, d, "events"), "value", "event_type").withColumn("mean", F.round("mean", 6))


@query("SELECT event_id, round(sum(value) OVER w, 2) AS total, max(value) OVER w AS peak, count(*) OVER w AS samples FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)")
def agg08_rolling(spark, d):
    """Averages of each user's last 100 samples."""
    return stats.rolling(table(spark, d, "events"), "value", ["ts", "event_id"], "user_id").select("event_id", F.round(F.col("mean") * F.col("samples"), 2).alias("total"), "peak", "samples")


_NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query(" UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in _NAMES))
def agg05_table_counts(spark, d):
    return stats.table_counts({n: table(spark, d, n) for n in _NAMES})


@query("SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS total_size, round(avg(n_chars), 6) AS mean_size FROM documents GROUP BY source")
def agg03_storage(spark, d):
    return stats.storage(table(spark, d, "documents"), F.col("n_chars"), "source").withColumn("mean_size", F.round("mean_size", 6))


@query("SELECT user_id, (['CRITICAL', 'ERROR', 'WARNING', 'HEALTHY'])[CAST(min(CASE WHEN event_type = 'error' AND value > 50 THEN 1 WHEN event_type = 'error' THEN 2 WHEN value > 90 THEN 3 ELSE 4 END) AS INT)] AS status FROM events GROUP BY user_id")
def agg11_health(spark, d):
    """The worst state of each user."""
    status = F.when((F.col("event_type") == "error") & (F.col("value") > 50), "CRITICAL").when(F.col("event_type") == "error", "ERROR").when(F.col("value") > 90, "WARNING").otherwise("HEALTHY")
    return stats.health(table(spark, d, "events").withColumn("state", status), "state", "user_id")


@query("SELECT event_id, CASE WHEN value / 60 * 100 >= 150 THEN 'critical' WHEN value / 60 * 100 >= 100 THEN 'warning' ELSE 'ok' END AS status, value >= 80 - 10 AS near_timeout FROM events")
def agg17_memory_status(spark, d):
    return table(spark, d, "events").select("event_id", stats.memory_status(F.col("value"), 60).alias("status"), stats.approaching_timeout(F.col("value"), 80, 10).alias("near_timeout"))


@query("SELECT count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes, CAST(count(*) / 4.0 AS DOUBLE) AS seconds, max(n_chars) AS peak_memory, 4.0 AS files_per_s, round(sum(n_chars) / 1048576.0 / (count(*) / 4.0), 6) AS mb_per_s FROM documents")
def agg07_benchmark(spark, d):
    rows = table(spark, d, "documents").select(F.lit(1).alias("f"), "n_chars", F.lit(0.25).alias("s"))
    return stats.benchmark(rows, "f", "n_chars", "s", "n_chars").withColumn("mb_per_s", F.round("mb_per_s", 6))


@query("SELECT coalesce(nullif(regexp_extract(p, '(\\.[^.]+)$', 1), ''), 'no-extension') AS extension, count(*) AS n, min(doc_id) AS first_id FROM (SELECT doc_id, (['src', 'lib', 'tests', 'docs', 'packages/core'])[CAST(doc_id % 5 + 1 AS INT)] || '/x.' || (['ts', 'py', 'js', 'test.ts', 'md'])[CAST(doc_id % 7 % 5 + 1 AS INT)] AS p FROM documents) GROUP BY 1")
def rnk33_by_extension(spark, d):
    from fathomix.functions.paths import any_extension

    ext = F.coalesce(F.nullif(any_extension(F.col("file_path")), F.lit("")), F.lit("no-extension"))
    return paths(table(spark, d, "documents")).groupBy(ext.alias("extension")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}' AS payload FROM events")
def sc28_json(spark, d):
    """Fields read from JSON and rows written as JSON."""
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), F.to_json(F.struct("event_id", "event_type")).alias("payload"))


@query("SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS seconds, CAST(epoch(o_orderdate) * 1000 AS BIGINT) AS millis, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM orders")
def sc27_times(spark, d):
    t: Column = F.col("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", F.floor(epoch_micros(t) / 1_000_000).cast("long").alias("seconds"), F.floor(epoch_micros(t) / 1000).cast("long").alias("millis"), F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))
