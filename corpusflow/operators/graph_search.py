"""Searches over edge tables, as loops of joins to a fixpoint.

Breadth-first search keeps a frontier that is anti-joined with what was reached, so work is edges times depth and no
list of paths is made. Trimming removes what lies on no cycle. Layers remove sources again and again.
Every round ends in a written table; nothing but counts reaches the driver, and no number of hops is a limit.

Edges are edges(a, b) of any one orderable type; null ends, loops and repeated edges are taken as what they are: a null end is no
edge, a loop is a cycle of one, a repeated edge is one edge. An empty table has no path, cycle or order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.plans import adapters  # noqa: F401  the tables that operators name
from corpusflow.plans.catalog import program, table
from corpusflow.plans.durable import Growing, empty, with_places, written


def _clean(edges: DataFrame) -> DataFrame:
    return written(edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b").distinct(), "edges")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def shortest(edges: DataFrame, origins: DataFrame | None = None) -> DataFrame:
    """origin, goal, hops and path of the least of the shortest paths, from origins(origin), by default all nodes, to every other node they reach."""
    edges = _clean(edges)
    start = (origins.select("origin") if origins is not None else edges.select(F.col("a").alias("origin"))).where("origin IS NOT NULL").distinct()
    reached = Growing(start.select("origin", F.col("origin").alias("goal"), F.lit(0).cast("long").alias("hops"), F.array("origin").alias("path")), "reached")
    front = reached.last
    while not empty(front):
        step = front.join(edges, F.col("goal") == F.col("a")).groupBy("origin", "b").agg(F.min(F.concat("path", F.array("b"))).alias("path"), (F.min("hops") + 1).alias("hops"))
        seen = reached.all().select("origin", F.col("goal").alias("b"))
        front = reached.add(step.join(seen, ["origin", "b"], "left_anti").withColumnRenamed("b", "goal"))
    return reached.all().where("hops > 0")


def core(edges: DataFrame) -> DataFrame:
    """Edges left when those from nodes without predecessors and to nodes without successors are removed until nothing changes."""
    rest = _clean(edges)
    n = rest.count()
    while n:
        ends = rest.select("b").intersect(rest.select("a")).select("b")
        rest = written(rest.join(ends.toDF("a"), "a", "left_semi").join(ends, "b", "left_semi").select("a", "b"), "core")
        left = rest.count()
        if left == n:
            break
        n = left
    return rest


def cycles(edges: DataFrame) -> DataFrame:
    """smallest, nodes and length of the shortest cycles through each edge of the core, the least where several are as short, each from its smallest node."""
    rest = core(edges)
    back = shortest(rest, rest.select(F.col("b").alias("origin")).distinct())
    ring = rest.join(back, (F.col("b") == F.col("origin")) & (F.col("a") == F.col("goal"))).select("path").union(rest.where("a = b").select(F.array("a").alias("path")))
    at = F.array_position("path", F.array_min("path")).cast("int")
    turned = F.concat(F.slice("path", at, F.size("path")), F.slice("path", F.lit(1), at - 1))
    return ring.select(turned.alias("nodes")).distinct().select(F.col("nodes")[0].alias("smallest"), "nodes", F.size("nodes").cast("long").alias("length"))


def layers(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, layer, the most edges on a path to it, and the least such path; layer and path are null where a cycle leads to the node."""
    edges = _clean(edges)
    every = edges.select(F.col("a").alias("node")).union(edges.select("b"))
    rest = written((every.union(nodes.select("node")) if nodes is not None else every).where("node IS NOT NULL").distinct(), "nodes")
    done: list[DataFrame] = []
    front = None
    while True:
        # edges leave with the layer that they come from
        free = rest.join(edges.select(F.col("b").alias("node")), "node", "left_anti")
        if front is None:
            front = free.select("node", F.lit(0).cast("long").alias("layer"), F.array("node").alias("path"))
        else:
            into = left.join(front.select(F.col("node").alias("a"), "path"), "a").groupBy(F.col("b").alias("node")).agg(F.min(F.concat("path", F.array("b"))).alias("path"))
            front = free.join(into, "node").select("node", F.lit(len(done)).cast("long").alias("layer"), "path")
        front = written(front, "layer")
        if empty(front):
            bad = rest.select("node", F.lit(None).cast("long").alias("layer"), F.lit(None).cast(f"array<{dict(rest.dtypes)['node']}>").alias("path"))
            return _union([*done, bad])
        done.append(front)
        left = written(edges.join(front.select(F.col("node").alias("a")), "a", "left_semi"), "left")
        edges = written(edges.join(front.select(F.col("node").alias("a")), "a", "left_anti"), "edges")
        rest = written(rest.join(front.select("node"), "node", "left_anti"), "rest")


def order(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node and place: by layer, then node; nodes that a cycle leads to are last."""
    found = layers(edges, nodes).select("node", F.coalesce("layer", F.lit(2**62)).alias("layer"))
    return with_places(found, F.col("layer"), F.col("node")).select("node", "place")


def _text(path: str):
    return F.array_join(F.transform(path, lambda x: x.cast("string")), ">")


# The oracles walk sets of (origin, node, depth), bounded by the number of nodes; their paths follow the least next node.
_DISTANCES = """
n AS (SELECT count(*) AS n FROM (SELECT a FROM {edges} UNION SELECT b FROM {edges})),
walk(origin, node, depth) AS (
  SELECT a, b, 1 FROM {edges} WHERE a IS NOT NULL AND b IS NOT NULL
  UNION SELECT w.origin, e.b, w.depth + 1 FROM walk w JOIN {edges} e ON e.a = w.node, n WHERE w.depth < n.n
), near AS (SELECT origin, node, min(depth)::BIGINT AS depth FROM walk GROUP BY ALL)"""
_PATHS = (
    _DISTANCES
    + """,
nexts AS (
  SELECT e.a AS cur, d.node AS goal, min(e.b) AS nxt FROM {edges} e JOIN near d ON d.origin = e.a AND d.node <> e.a
  LEFT JOIN near r ON r.origin = e.b AND r.node = d.node WHERE CASE WHEN e.b = d.node THEN 0 ELSE r.depth END = d.depth - 1 GROUP BY ALL
), paths(origin, goal, cur, path) AS (
  SELECT cur, goal, nxt, [cur, nxt] FROM nexts UNION ALL SELECT p.origin, p.goal, x.nxt, list_append(p.path, x.nxt) FROM paths p JOIN nexts x ON x.cur = p.cur AND x.goal = p.goal
)"""
)
_TOLD = "array_to_string(list_transform({0}, lambda x: x::VARCHAR), '>')"


@program("gr_shortest", f"WITH RECURSIVE {_PATHS} SELECT origin, goal, (len(path) - 1)::BIGINT AS hops, {_TOLD.format('path')} AS path FROM paths WHERE cur = goal", edges="trade")
def gr_shortest(edges):
    """Fewest hops from each node to each other node, with the least path of that length."""
    return shortest(edges).select("origin", "goal", "hops", _text("path").alias("path"))


@program("flt_routes", f"WITH RECURSIVE {_PATHS} SELECT p.origin, p.goal, (len(path) - 1)::BIGINT AS hops, {_TOLD.format('path')} AS path FROM paths p JOIN {{nation}} n ON n.n_nationkey = p.goal WHERE cur = goal AND n.n_regionkey = 1", edges="precedence", nation="nation")
def flt_routes(edges, nation):
    """Routes whose goal lies in one domain."""
    goals = nation.where("n_regionkey = 1").select(F.col("n_nationkey").cast("long").alias("goal"))
    return shortest(edges).join(goals, "goal", "left_semi").select("origin", "goal", "hops", _text("path").alias("path"))


_CYCLES = (
    _PATHS
    + """,
rings AS (SELECT path FROM paths p JOIN {edges} e ON e.b = p.origin AND e.a = p.goal WHERE p.cur = p.goal UNION ALL SELECT [a] FROM {edges} WHERE a = b),
turned AS (SELECT DISTINCT list_concat(path[list_position(path, list_min(path)):], path[:list_position(path, list_min(path)) - 1]) AS nodes FROM rings)"""
)


@program("gr_cycles", f"WITH RECURSIVE {_CYCLES} SELECT nodes[1] AS smallest, {_TOLD.format('nodes')} AS path, len(nodes)::BIGINT AS length FROM turned", edges="trade")
def gr_cycles(edges):
    """Shortest cycles through the edges that lie on one, each from its smallest node."""
    return cycles(edges).select("smallest", _text("nodes").alias("path"), "length")


@program("gr_cycle_policy", f"WITH RECURSIVE {_CYCLES}, c AS (SELECT count(*) AS n FROM turned) SELECT policy, CASE WHEN n = 0 THEN 'pass' WHEN policy = 'block' THEN 'fail' ELSE 'report' END AS verdict, n::BIGINT AS n FROM c, (VALUES ('block'), ('allow')) p(policy)", edges="trade")
def gr_cycle_policy(edges):
    """Verdict under each policy: block fails on a cycle, allow reports it."""
    spark = edges.sparkSession
    found = cycles(edges).agg(F.count("*").alias("n"))
    return spark.createDataFrame([("block",), ("allow",)], "policy string").crossJoin(found).select("policy", F.when(F.col("n") == 0, "pass").when(F.col("policy") == "block", "fail").otherwise("report").alias("verdict"), "n")


@program(
    "gr_has_cycle",
    """
WITH RECURSIVE links AS (SELECT DISTINCT src, dst FROM {links}), walk(origin, node) AS (SELECT src, dst FROM links UNION SELECT w.origin, e.dst FROM walk w JOIN links e ON e.src = w.node)
SELECT kind, EXISTS (SELECT 1 FROM walk WHERE origin = node AND kind = 'all') OR EXISTS (SELECT 1 FROM (SELECT src, dst FROM links WHERE src < dst) x WHERE x.src = x.dst) AS has_cycle FROM (VALUES ('all'), ('rising')) k(kind)
""",
    links="note_links",
)
def gr_has_cycle(links):
    """Whether the links between notes, and those of them to a later note, have a cycle."""
    edges = links.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    spark = links.sparkSession
    return spark.createDataFrame([("all", not empty(core(edges))), ("rising", not empty(core(edges.where("a < b"))))], "kind string, has_cycle boolean")


@program(
    "gr_depends_acyclic",
    """
WITH RECURSIVE e AS (SELECT DISTINCT domain, from_concept AS a, to_concept AS b FROM {relations} WHERE relation = 'prerequisite' AND to_concept <> ''),
walk(domain, origin, node) AS (SELECT domain, a, b FROM e UNION SELECT w.domain, w.origin, e.b FROM walk w JOIN e ON e.domain = w.domain AND e.a = w.node),
bad AS (SELECT DISTINCT domain FROM walk WHERE origin = node)
SELECT e.domain, count(*)::BIGINT AS edges, max((bad.domain IS NOT NULL)::INT) = 0 AS acyclic FROM e LEFT JOIN bad ON bad.domain = e.domain GROUP BY e.domain
""",
    relations="relations",
)
def gr_depends_acyclic(relations):
    """Whether the prerequisites of a domain are free of cycles."""
    edges = relations.where("relation = 'prerequisite' AND to_concept <> ''").select("domain", F.struct("domain", F.col("from_concept").alias("c")).alias("a"), F.struct("domain", F.col("to_concept").alias("c")).alias("b")).distinct()
    bad = core(edges).select(F.col("a.domain").alias("domain")).distinct().withColumn("bad", F.lit(True))
    return edges.groupBy("domain").agg(F.count("*").alias("edges")).join(bad, "domain", "left").select("domain", "edges", F.col("bad").isNull().alias("acyclic"))


_LONGEST = """
n AS (SELECT count(*) AS n FROM (SELECT a FROM {edges} UNION SELECT b FROM {edges})),
ends AS (SELECT a AS node FROM {edges} UNION SELECT b FROM {edges}),
deep(node, depth) AS (SELECT node, 0 FROM ends UNION SELECT e.b, d.depth + 1 FROM deep d JOIN {edges} e ON e.a = d.node, n WHERE d.depth <= n.n),
layer AS (SELECT node, max(depth)::BIGINT AS layer FROM deep GROUP BY node),
wide(node, path) AS (SELECT node, [node] FROM layer WHERE layer = 0 UNION ALL SELECT e.b, list_append(w.path, e.b) FROM wide w JOIN layer l ON l.node = w.node JOIN {edges} e ON e.a = w.node JOIN layer m ON m.node = e.b AND m.layer = l.layer + 1),
best AS (SELECT node, min(path) AS path FROM wide GROUP BY node)"""


@program("gr_broadest", f"WITH RECURSIVE {_LONGEST} SELECT node AS goal, (len(path) - 1)::BIGINT AS hops, {_TOLD.format('path')} AS path FROM best WHERE len(path) > 1", edges="precedence")
def gr_broadest(edges):
    """Longest path to each goal, the least of that length; none to goals that a cycle leads to, where the question is intractable."""
    return layers(edges).where("layer > 0").select(F.col("node").alias("goal"), F.col("layer").alias("hops"), _text("path").alias("path"))


@program(
    "gr_routes",
    f"""
WITH RECURSIVE {_LONGEST}, short AS (SELECT b AS goal, [min(a), b] AS path FROM {{edges}} WHERE a <> b GROUP BY b)
SELECT goal, 'shortest' AS strategy, 1::BIGINT AS hops, {_TOLD.format('path')} AS path FROM short
UNION ALL SELECT node, 'broadest', (len(best.path) - 1)::BIGINT, {_TOLD.format('best.path')} FROM best JOIN short ON short.goal = node WHERE best.path <> short.path
""",
    edges="precedence",
)
def gr_routes(edges):
    """Shortest and broadest route to a goal from any other node; one if they are equal."""
    short = edges.where("a <> b").groupBy(F.col("b").alias("goal")).agg(F.array(F.min("a"), F.first("b")).alias("short"))
    wide = layers(edges).where("layer > 0").select(F.col("node").alias("goal"), F.col("path").alias("wide"))
    both = short.join(wide, "goal", "left")
    rows = both.select("goal", F.explode(F.array(F.struct(F.lit("shortest").alias("strategy"), F.col("short").alias("path")), F.struct(F.lit("broadest").alias("strategy"), F.when(F.col("wide") != F.col("short"), F.col("wide")).alias("path")))).alias("r"))
    return rows.where("r.path IS NOT NULL").select("goal", "r.strategy", (F.size("r.path") - 1).cast("long").alias("hops"), _text("r.path").alias("path"))


@program("gr_toposort", f"WITH RECURSIVE {_LONGEST} SELECT k AS node, row_number() OVER (ORDER BY coalesce(layer, 0), k) AS place FROM (SELECT n_nationkey::BIGINT AS k FROM {{nation}}) LEFT JOIN layer ON layer.node = k", edges="precedence", nation="nation")
def gr_toposort(edges, nation):
    """Order by longest dependency depth, then key; nodes that a cycle leads to are last."""
    return order(edges, nation.select(F.col("n_nationkey").cast("long").alias("node")))


def study_routes(notes: DataFrame, edges: DataFrame) -> DataFrame:
    """domain, note_id, minutes, practice, self_test and step, from 1, of notes(domain, note_id, minutes, practice, self_test): what edges(domain, a, b) say comes before comes first, ties by id; notes that a cycle leads to are last."""
    notes = written(notes.dropDuplicates(["domain", "note_id"]), "route-notes")
    node = lambda c: F.struct(F.col("domain").alias("domain"), F.col(c).alias("note"))
    known = notes.select("domain", F.col("note_id").alias("a"))
    own = edges.where("a <> b").join(known, ["domain", "a"], "left_semi").join(known.withColumnRenamed("a", "b"), ["domain", "b"], "left_semi")
    deep = layers(own.select(node("a").alias("a"), node("b").alias("b"))).select(F.col("node.domain").alias("domain"), F.col("node.note").alias("note_id"), F.coalesce("layer", F.lit(2**62)).alias("layer"))
    placed = with_places(notes.join(deep, ["domain", "note_id"], "left").withColumn("layer", F.coalesce("layer", F.lit(0))), F.col("domain"), F.col("layer"), F.col("note_id"))
    first = placed.groupBy("domain").agg(F.min("place").alias("first"))
    return placed.join(first, "domain").withColumn("step", F.col("place") - F.col("first") + 1).drop("place", "first", "layer")


_ROUTE_NOTES = "SELECT DISTINCT c.domain, n.note_id, n.minutes, n.note_type = 'procedure' AND n.doc_id % 3 = 0 AS practice, n.note_type = 'concept' AS self_test FROM {concepts} c JOIN {notes} n ON n.doc_id = c.doc_id"
table("route_notes", _ROUTE_NOTES)
table(
    "route_edges",
    "SELECT DISTINCT r.domain, 'note-' || $text(f.doc_id) AS a, 'note-' || $text(t.doc_id) AS b FROM {relations} r JOIN {concepts} f ON f.domain = r.domain AND f.concept = r.from_concept JOIN {concepts} t ON t.domain = r.domain AND t.concept = r.to_concept WHERE r.relation = 'prerequisite'",
)


_STEPS = """
WITH RECURSIVE e AS (SELECT DISTINCT domain, a, b FROM {edges} WHERE a <> b), n AS (SELECT domain, count(*) AS n FROM {notes} GROUP BY domain),
deep(domain, node, depth) AS (SELECT domain, note_id, 0 FROM {notes} UNION SELECT d.domain, e.b, d.depth + 1 FROM deep d JOIN e ON e.domain = d.domain AND e.a = d.node JOIN n ON n.domain = d.domain WHERE d.depth <= n.n),
l AS (SELECT d.domain, node, CASE WHEN max(depth) > any_value(n.n) THEN 4611686018427387904 ELSE max(depth) END AS layer FROM deep d JOIN n ON n.domain = d.domain GROUP BY d.domain, node),
s AS (SELECT t.*, row_number() OVER (PARTITION BY t.domain ORDER BY layer, note_id) AS step FROM {notes} t JOIN l ON l.domain = t.domain AND l.node = t.note_id)"""


@program("gr_study_route_steps", _STEPS + " SELECT domain, step, note_id, minutes FROM s", notes="route_notes", edges="route_edges")
def gr_study_route_steps(notes, edges):
    """Notes of each domain's route, step by step."""
    return study_routes(notes, edges).select("domain", "step", "note_id", "minutes")


@program(
    "gr_study_routes",
    _STEPS
    + """
SELECT domain, count(*) AS steps, sum(minutes)::BIGINT AS minutes, coalesce(min(step) FILTER (WHERE practice), min(step) FILTER (WHERE self_test)) AS checkpoint, CASE WHEN bool_or(practice) THEN 'practice' WHEN bool_or(self_test) THEN 'auto-eval' END AS checkpoint_type FROM s GROUP BY domain
""",
    notes="route_notes",
    edges="route_edges",
)
def gr_study_routes(notes, edges):
    """Length, minutes and checkpoint of each domain's route in the order of its prerequisites: the first practice, else the first self-test."""
    steps = study_routes(notes, edges)
    first = lambda c: F.min(F.when(F.col(c), F.col("step")))
    kind = F.when(F.max("practice"), "practice").when(F.max("self_test"), "auto-eval")
    return steps.groupBy("domain").agg(F.count("*").alias("steps"), F.sum("minutes").alias("minutes"), F.coalesce(first("practice"), first("self_test")).alias("checkpoint"), kind.alias("checkpoint_type"))
