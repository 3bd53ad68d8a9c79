"""Graph operators: bounded traversals, closures, components, cycles and impact.

Bounded traversals are loops of ``depth`` joins over the edge table (depth is a small constant), de-duplicated at
every level, so that a level is never larger than the graph.  Closures without a bound run
until nothing is new and write each level to the shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalogue import operator
from ..functions import formulas as M
from ..store import materialize, numbered
from ..views import Views

c = F.col


def mark_numbers(marks: DataFrame) -> DataFrame:
    """(mark, no): the distinct ids of marks(id), numbered from 0 in their order: neighbours' ids are often near each other, and marks of one block that get to the same nodes share rows."""
    return materialize(numbered(marks.select(c("id").alias("mark")).distinct().orderBy("mark"), "no", 0), "marks")


def marked(edges: DataFrame, numbers: DataFrame, depth: int) -> list[DataFrame]:
    """Where the marks of numbers(mark, no) get to along src -> dst within ``depth`` steps: a frame (id, block, bits) for each step.

    Mark number n is bit n % 64 of block n // 64: a node has a row for 64 marks, not for each.  A step's bits are those marks that no earlier step brought; each
    step is written before the next one reads it.  A mark comes back to its own node only around a cycle.
    """
    e = written(edges)
    new = numbers.select(c("mark").alias("id"), F.floor(c("no") / 64).alias("block"), _bit(c("no")).alias("bits"))
    held, levels = None, []
    for _ in range(depth):
        sent = new.join(e, c("id") == c("src")).groupBy(c("dst").alias("id"), "block").agg(F.bit_or("bits").alias("sent"))
        if held is None:
            step = sent.select("id", "block", c("sent").alias("bits"), c("sent").alias("new"))
        else:
            both = held.join(sent, ["id", "block"], "full").select("id", "block", *(F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("bits", "sent")))
            step = both.select("id", "block", c("bits").bitwiseOR(c("sent")).alias("bits"), c("sent").bitwiseAND(F.bitwise_not("bits")).alias("new"))
        step = materialize(step, "marked")
        held, new = step.select("id", "block", "bits"), step.where("new <> 0").select("id", "block", c("new").alias("bits"))
        levels.append(new)
    return levels


def _bit(number):
    return F.call_function("shiftleft", F.lit(1).cast("long"), (number % 64).cast("int"))


def _is_set(i):
    return F.call_function("shiftright", c("bits"), i).bitwiseAND(F.lit(1).cast("long")) != 0


def _bit_numbers(held: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and ``no``: a row for each bit of held(..., block, bits)."""
    at = F.filter(F.sequence(F.lit(0), F.lit(63)), _is_set)
    return held.select(*keep, "block", F.explode(at).alias("i")).select(*keep, (c("block") * 64 + c("i")).alias("no"))


def reach(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, id, depth): all nodes within ``depth`` steps along src -> dst, at their least depth; a start itself only if it lies on a cycle.

    Rows of bits meet the list of their block's marks before they become pairs, so that pairs are never shuffled.
    """
    numbers = mark_numbers(starts)
    levels = marked(edges, numbers, depth)
    each = reduce(DataFrame.unionByName, [new.withColumn("depth", F.lit(d)) for d, new in enumerate(levels, 1)])
    blocks = numbers.groupBy(F.floor(c("no") / 64).alias("block")).agg(F.sort_array(F.collect_list(F.struct("no", "mark")))["mark"].alias("marks"))  # 64 at most
    # a row has some bit; explode alone would ask first whether there is any, and read the bits twice for that
    start = F.explode_outer(F.filter("marks", lambda mark, i: _is_set(i))).alias("start")
    return each.join(blocks, "block").select(start, "id", "depth")


def written(edges: DataFrame) -> DataFrame:
    """The distinct edges(src, dst), in the shared folder: what is asked again and again is made once."""
    if getattr(edges, "_written", False):
        return edges
    out = materialize(edges.select("src", "dst").distinct(), "edges")
    out._written = True
    return out


def reverse(edges: DataFrame) -> DataFrame:
    out = edges.select(c("dst").alias("src"), c("src").alias("dst"))
    out._written = getattr(edges, "_written", False)
    return out


def _reach_sql(edges: str, depth: int, starts: str = "SELECT id AS start, id, 0 AS depth FROM nodes") -> str:
    return f"""WITH RECURSIVE r(start, id, depth) AS ({starts} UNION SELECT r.start, e.dst, r.depth + 1 FROM r JOIN ({edges}) e ON e.src = r.id WHERE r.depth < {depth}),
near AS (SELECT start, id, CAST(min(depth) AS INTEGER) AS depth FROM r WHERE depth > 0 GROUP BY start, id)"""


_OUT, _IN = "SELECT src, dst FROM edges", "SELECT dst AS src, src AS dst FROM edges"


@operator("gra_build", """
SELECT 'module' AS type, CAST(id AS VARCHAR) AS id, (SELECT count(*) FROM edges e WHERE e.src = n.id) AS degree FROM nodes n UNION ALL
SELECT 'domain', 'd' || CAST(domain AS VARCHAR), count(*) FROM nodes GROUP BY domain""")
def gra_build(v: Views) -> DataFrame:
    out = v.edges.groupBy(c("src").alias("id")).agg(F.count("*").alias("degree"))
    modules = v.nodes.select("id").join(out, "id", "left").select(F.lit("module").alias("type"), c("id").cast("string").alias("id"), F.coalesce("degree", F.lit(0)).alias("degree"))
    domains = v.nodes.groupBy("domain").agg(F.count("*").alias("degree")).select(F.lit("domain").alias("type"), F.concat(F.lit("d"), c("domain").cast("string")).alias("id"), "degree")
    return modules.unionByName(domains)


@operator("gra_upstream", _reach_sql(_IN, 5) + " SELECT start, id, depth, depth = 1 AS direct FROM near")
def gra_upstream(v: Views) -> DataFrame:
    """Who depends on a module, up to five steps."""
    return reach(reverse(v.edges), v.nodes, 5).withColumn("direct", c("depth") == 1)


@operator("gra_downstream", _reach_sql(_OUT, 5) + " SELECT start, id, depth, depth = 1 AS direct FROM near")
def gra_downstream(v: Views) -> DataFrame:
    return reach(v.edges, v.nodes, 5).withColumn("direct", c("depth") == 1)


@operator("gra_deps", _reach_sql(_OUT, 2) + " SELECT start, count(*) AS dependencies, CAST(sum(loc) AS BIGINT) AS loc FROM near JOIN nodes ON nodes.id = near.id GROUP BY start")
def gra_deps(v: Views) -> DataFrame:
    near = reach(v.edges, v.nodes, 2).join(v.nodes.select("id", "loc"), "id")
    return near.groupBy("start").agg(F.count("*").alias("dependencies"), F.sum("loc").alias("loc"))


@operator("gra_dependents", _reach_sql(_IN, 2) + " SELECT start, count(*) AS dependents FROM near GROUP BY start")
def gra_dependents(v: Views) -> DataFrame:
    return reach(reverse(v.edges), v.nodes, 2).groupBy("start").agg(F.count("*").alias("dependents"))


@operator("gra_callers", "SELECT dst AS id, count(DISTINCT src) AS callers FROM links GROUP BY dst")
def gra_callers(v: Views) -> DataFrame:
    return v.links.groupBy(c("dst").alias("id")).agg(F.countDistinct("src").alias("callers"))


@operator("gra_testsfor", _reach_sql(_IN, 2) + " SELECT start, near.id AS test FROM near JOIN nodes ON nodes.id = near.id WHERE domain % 5 = 0")
def gra_testsfor(v: Views) -> DataFrame:
    tests = v.nodes.where(c("domain") % 5 == 0).select("id")
    return reach(reverse(v.edges), v.nodes, 2).join(tests, "id", "left_semi").select("start", c("id").alias("test"))


def shortest_paths(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, id, hops, path): a shortest path, the first in lexicographic order, to every node within ``depth`` steps.

    Each level keeps one path for each pair: the least path extends to the least, so nothing is lost.
    """
    e = edges.select("src", "dst").distinct()
    found = level = starts.select(c("id").alias("start"), c("id"), F.lit(0).alias("hops"), F.array("id").alias("path"))
    for d in range(1, depth + 1):
        more = level.join(e, c("id") == c("src")).select("start", c("dst").alias("id"), F.lit(d).alias("hops"), F.concat("path", F.array("dst")).alias("path"))
        more = more.groupBy("start", "id", "hops").agg(F.min("path").alias("path"))
        level = materialize(more.join(found.select("start", "id"), ["start", "id"], "left_anti"), "paths")
        found = found.unionByName(level)
    return found.where("hops > 0")


@operator("gra_shortest", """
WITH RECURSIVE p(start, id, path) AS (SELECT id, id, [id] FROM nodes UNION ALL SELECT p.start, e.dst, list_append(p.path, e.dst) FROM p JOIN edges e ON e.src = p.id WHERE len(p.path) <= 3 AND NOT list_contains(p.path, e.dst))
SELECT start, id, CAST(len(path) - 1 AS INTEGER) AS hops, array_to_string(list_transform(path, lambda x: CAST(x AS VARCHAR)), '->') AS path
FROM (SELECT start, id, path, row_number() OVER (PARTITION BY start, id ORDER BY len(path), path) AS k FROM p WHERE len(path) > 1) s WHERE k = 1""")
def gra_shortest(v: Views) -> DataFrame:
    s = shortest_paths(v.edges, v.nodes, 3)
    return s.select("start", "id", "hops", F.array_join("path", "->").alias("path"))


_BLAST = f"""{_reach_sql(_OUT, 3)}, up_r(start, id, depth) AS (SELECT id AS start, id, 0 AS depth FROM nodes UNION SELECT r.start, e.dst, r.depth + 1 FROM up_r r JOIN ({_IN}) e ON e.src = r.id WHERE r.depth < 3),
up AS (SELECT DISTINCT start, id FROM up_r WHERE depth > 0),
s AS (SELECT n.id, n.complexity, (SELECT count(*) FROM near WHERE near.start = n.id AND near.id <> n.id) AS down, (SELECT count(*) FROM up WHERE up.start = n.id AND up.id <> n.id) AS up,
  (SELECT count(*) FROM (SELECT id FROM near WHERE near.start = n.id AND near.id <> n.id UNION SELECT id FROM up WHERE up.start = n.id AND up.id <> n.id) x) AS total FROM nodes n)"""


@operator("gra_blast", _BLAST + " SELECT id, down, up, total, round((1.5*down + 1.0*up) * sqrt(complexity), 2) AS score FROM s")
def gra_blast(v: Views) -> DataFrame:
    """What a change of a module may reach, both ways, within three steps."""
    return blast(v.nodes, v.edges, 3)


def blast(nodes: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(id, down, up, total, score): how many other modules each reaches, is reached from, or either; sets are bits, and counted where they lie."""
    edges, numbers = written(edges), mark_numbers(nodes)

    def sets(e: DataFrame, name: str) -> DataFrame:
        return reduce(DataFrame.unionByName, marked(e, numbers, depth)).groupBy("id", "block").agg(F.bit_or("bits").alias(name))

    # the nodes that x reaches are the marks that come to x against the edges
    both = sets(reverse(edges), "d").join(sets(edges, "u"), ["id", "block"], "full").join(numbers.withColumnRenamed("mark", "id"), "id")
    others = F.when(F.floor(c("no") / 64) == c("block"), F.bitwise_not(_bit(c("no")))).otherwise(F.lit(-1).cast("long"))
    down, up = (F.coalesce(x, F.lit(0)).cast("long").bitwiseAND(others) for x in ("d", "u"))
    counts = {"down": down, "up": up, "total": down.bitwiseOR(up)}
    n = both.groupBy("id").agg(*(F.sum(F.bit_count(x)).alias(name) for name, x in counts.items()))
    j = nodes.select("id", "complexity").join(n, "id", "left")
    j = j.select("id", "complexity", *(F.coalesce(x, F.lit(0)).alias(x) for x in counts))
    return j.select("id", "down", "up", "total", M.blast_score(c("down"), c("up"), c("complexity")).alias("score"))


def impact_severity(score, total, *, high: tuple[float, int] = (15.0, 8), medium: tuple[float, int] = (5.0, 3)):
    """HIGH from a blast score on or beyond more modules than a number; MEDIUM from a score or a number on."""
    return F.when((score >= high[0]) | (total > high[1]), "HIGH").when((score >= medium[0]) | (total >= medium[1]), "MEDIUM").otherwise("LOW")


@operator("gra_impactsev", _BLAST.replace("depth < 3", "depth < 1") + """
SELECT id, CASE WHEN round((1.5*down + 1.0*up) * sqrt(complexity), 2) >= 15 OR total > 8 THEN 'HIGH' WHEN round((1.5*down + 1.0*up) * sqrt(complexity), 2) >= 5 OR total >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM s""")
def gra_impactsev(v: Views) -> DataFrame:
    """The severity of a change of a module, by its direct neighbours."""
    return blast(v.nodes, v.edges, 1).select("id", impact_severity(c("score"), c("total")).alias("severity"))


@operator("gra_blast_mcp", "SELECT n.id, round(1.5 * coalesce(k.n, 0) * sqrt(n.complexity), 2) AS score FROM nodes n LEFT JOIN (SELECT dst, count(DISTINCT src) AS n FROM edges GROUP BY dst) k ON k.dst = n.id")
def gra_blast_mcp(v: Views) -> DataFrame:
    n = v.edges.groupBy(c("dst").alias("id")).agg(F.countDistinct("src").alias("n"))
    return v.nodes.join(n, "id", "left").select("id", F.round(1.5 * F.coalesce("n", F.lit(0)) * F.sqrt("complexity"), 2).alias("score"))


def closure(edges: DataFrame, starts: DataFrame, hops: int = 3) -> DataFrame:
    """(id): everything reachable from ``starts(id)``, themselves included; each round goes ``hops`` steps on from what was new."""
    e = written(edges)
    seen = level = materialize(starts.select("id").distinct(), "closure")
    while not level.isEmpty():
        step, found = level, None
        for _ in range(hops):
            step = step.join(e, c("id") == c("src")).select(c("dst").alias("id")).distinct()
            found = step if found is None else found.unionByName(step)
        level = materialize(found.distinct().join(seen, "id", "left_anti"), "closure")
        seen = seen.unionByName(level)
    return seen


@operator("gra_closure", f"WITH RECURSIVE r(id) AS (SELECT id FROM nodes WHERE domain = 3 UNION SELECT e.dst FROM r JOIN ({_IN}) e ON e.src = r.id) SELECT id FROM r")
def gra_closure(v: Views) -> DataFrame:
    """All modules that depend on a domain's, however far."""
    return closure(reverse(v.edges), v.nodes.where("domain = 3"))


def trimmed(edges: DataFrame) -> DataFrame:
    """edges(src, dst) without those that can lie on no cycle for want of an edge before or behind them, again and again."""
    live = written(edges)
    n = live.count()
    while n:
        both = live.select(c("src").alias("id")).distinct().join(live.select(c("dst").alias("id")).distinct(), "id", "left_semi")
        less = live.join(both.select(c("id").alias("src")), "src", "left_semi").join(both.select(c("id").alias("dst")), "dst", "left_semi")
        less = written(less.select("src", "dst"))
        before, n, live = n, less.count(), less
        if n == before:
            break
    return live


def _without(live: DataFrame, ids: DataFrame) -> DataFrame:
    return live.join(ids.select(c("id").alias("src")), "src", "left_anti").join(ids.select(c("id").alias("dst")), "dst", "left_anti").select("src", "dst")


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component): strongly connected components, named by their smallest node; a single node is one if it depends on itself.

    What can lie on no cycle is trimmed.  The component of the node with the most edges both ways, often the largest, is what it reaches and is reached from.  Of the rest
    colours spread forward to the largest id that reaches a node; within each colour, what the colour's node is reached from
    is its component.  Settled nodes leave, and the rest goes on.  All steps are grouped maxima and joins.
    """
    edges = written(edges)
    live = trimmed(edges)
    done = None
    if not live.isEmpty():
        degrees = live.groupBy(c("src").alias("id")).agg(F.count("*").alias("o")).join(live.groupBy(c("dst").alias("id")).agg(F.count("*").alias("i")), "id")
        hub = materialize(degrees.orderBy(F.desc(F.least("o", "i")), "id").limit(1).select("id"), "scc-hub")
        ring = closure(live, hub).join(closure(reverse(live), hub), "id", "left_semi")
        done = materialize(ring.join(hub.select(c("id").alias("colour"))).select("id", "colour"), "scc-members")  # one row
        live = trimmed(_without(live, done))
    while not live.isEmpty():
        ids = live.select(c("src").alias("id")).union(live.select("dst")).distinct()
        colour = materialize(ids.select("id", c("id").alias("colour")), "scc-colour")
        while True:
            pushed = live.join(colour, c("id") == c("src")).groupBy("dst").agg(F.max("colour").alias("pushed"))
            now = colour.join(pushed, c("id") == c("dst"), "left").select("id", F.greatest("colour", F.coalesce("pushed", "colour")).alias("now"), "colour")
            now = materialize(now, "scc-colour")
            stable = now.where("now <> colour").isEmpty()
            colour = now.select("id", c("now").alias("colour"))
            if stable:
                break
        inside = live.join(colour.toDF("src", "cs"), "src").join(colour.toDF("dst", "cd"), "dst").where("cs = cd")
        back = materialize(inside.select(c("dst").alias("src"), c("src").alias("dst"), c("cs").alias("colour")), "scc-inside")
        seen = level = materialize(colour.where("id = colour"), "scc-members")
        while not level.isEmpty():
            step = level.join(back.drop("colour"), c("id") == c("src")).select(c("dst").alias("id"), "colour").distinct()
            level = materialize(step.join(seen, ["id", "colour"], "left_anti"), "scc-members")
            seen = seen.unionByName(level)
        seen = materialize(seen, "scc-members")
        done = done.unionByName(seen)
        live = trimmed(_without(live, seen))
    if done is None:
        return edges.select(c("src").alias("id"), c("src").alias("component")).limit(0)
    names = done.groupBy("colour").agg(F.min("id").alias("component"), F.count("*").alias("n"))
    loops = edges.where("src = dst").select(c("src").alias("id"), F.lit(True).alias("loop")).distinct()
    return done.join(names, "colour").join(loops, "id", "left").where("n > 1 or loop").select("id", "component")


@operator("gra_scc", """
WITH RECURSIVE r(start, id) AS (SELECT src, dst FROM edges UNION SELECT r.start, e.dst FROM r JOIN edges e ON e.src = r.id)
SELECT a.start AS id, min(a.id) AS component FROM r a JOIN r b ON b.start = a.id AND b.id = a.start GROUP BY a.start""")
def gra_scc(v: Views) -> DataFrame:
    return strong_components(v.edges)


def within_components(edges: DataFrame) -> DataFrame:
    """The edges that lie on a cycle: those inside a strong component."""
    edges = written(edges)
    of = strong_components(edges)
    return edges.join(of.toDF("src", "of_src"), "src").join(of.toDF("dst", "of_dst"), "dst").where("of_src = of_dst").select("src", "dst").distinct()


def cycles(edges: DataFrame, longest: int) -> DataFrame:
    """(cycle): every elementary cycle of up to ``longest`` nodes, as the array that begins with its smallest node; a self-loop is a cycle of one.

    Paths are followed within strong components only; those of each length are written before they go on.
    """
    e = written(within_components(edges))
    found = e.where("src = dst").select(F.array("src").alias("cycle"))
    e = e.where("src <> dst")
    paths = e.where("dst > src").select(F.array("src", "dst").alias("p"))
    for n in range(2, longest + 1):
        tip = paths.select("p", F.element_at("p", -1).alias("tip"))
        step = tip.join(e, c("tip") == c("src"))
        closed = step.where(c("dst") == c("p")[0]).select(c("p").alias("cycle"))
        found = found.unionByName(closed)
        if n < longest:
            paths = step.where((c("dst") > c("p")[0]) & ~F.array_contains("p", c("dst"))).select(F.concat("p", F.array("dst")).alias("p"))
            paths = materialize(paths, "cycle-paths")
    return found


_LONGEST = 4  # what the queries below ask for
_CYCLES = f"""WITH RECURSIVE p(path) AS (SELECT [src, dst] FROM edges WHERE dst > src UNION ALL SELECT list_append(p.path, e.dst) FROM p JOIN edges e ON e.src = p.path[-1] WHERE e.dst > p.path[1] AND NOT list_contains(p.path, e.dst) AND len(p.path) < {_LONGEST}),
cyc AS (SELECT path AS cycle FROM p JOIN edges e ON e.src = p.path[-1] AND e.dst = p.path[1] UNION ALL SELECT [src] FROM edges WHERE src = dst)"""
_NAME = "array_to_string(list_transform(cycle, lambda x: CAST(x AS VARCHAR)), '->')"


@operator("gra_cycles", _CYCLES + f" SELECT {_NAME} AS cycle_id, CAST(len(cycle) AS INTEGER) AS length FROM cyc")
def gra_cycles(v: Views) -> DataFrame:
    return cycles(v.edges, _LONGEST).select(F.array_join("cycle", "->").alias("cycle_id"), F.size("cycle").alias("length"))


@operator("gra_canon", _CYCLES + f" SELECT {_NAME} || '->' || CAST(cycle[1] AS VARCHAR) AS closed, cycle[1] AS smallest FROM cyc")
def gra_canon(v: Views) -> DataFrame:
    x = cycles(v.edges, _LONGEST)
    return x.select(F.array_join(F.concat("cycle", F.slice("cycle", 1, 1)), "->").alias("closed"), c("cycle")[0].alias("smallest"))


def cycle_severity(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(cycle_id, length, severity): summed complexity times a factor of the length."""
    each = found.select(F.array_join("cycle", "->").alias("cycle_id"), F.size("cycle").alias("length"), F.explode("cycle").alias("id"))
    total = each.join(nodes.select("id", "complexity"), "id", "left").groupBy("cycle_id", "length").agg(F.sum(F.greatest(F.lit(1.0), F.coalesce("complexity", F.lit(1.0)))).alias("s"))
    return total.select("cycle_id", "length", F.round(c("s") * F.greatest(F.lit(1.0), 0.75 * c("length")), 2).alias("severity"))


_SEV = _CYCLES + f""", sev AS (SELECT {_NAME} AS cycle_id, CAST(len(cycle) AS INTEGER) AS length,
  round((SELECT sum(greatest(1.0, n.complexity)) FROM nodes n WHERE list_contains(cycle, n.id)) * greatest(1.0, 0.75 * len(cycle)), 2) AS severity FROM cyc)"""


@operator("gra_cycsev", _SEV + " SELECT cycle_id, length, severity FROM sev")
def gra_cycsev(v: Views) -> DataFrame:
    return cycle_severity(cycles(v.edges, _LONGEST), v.nodes)


@operator("top_cycles", _SEV + " SELECT cycle_id, length, severity FROM sev ORDER BY severity DESC, length DESC, cycle_id LIMIT 10")
def top_cycles(v: Views) -> DataFrame:
    return cycle_severity(cycles(v.edges, _LONGEST), v.nodes).orderBy(F.desc("severity"), F.desc("length"), "cycle_id").limit(10)


@operator("gra_break", _CYCLES + f""", arcs AS (SELECT {_NAME} AS cycle_id, cycle[i] AS source, cycle[i % len(cycle) + 1] AS target FROM cyc, LATERAL (SELECT unnest(range(1, len(cycle) + 1)) AS i) t),
cost AS (SELECT s.*, round(0.5 * n.complexity + 0.5 * (SELECT count(*) FROM edges e WHERE e.src = s.target), 4) AS cost FROM arcs s JOIN nodes n ON n.id = s.target)
SELECT cycle_id, source, target, cost FROM (SELECT *, row_number() OVER (PARTITION BY cycle_id ORDER BY cost, source, target) AS k FROM cost) q WHERE k = 1""")
def gra_break(v: Views) -> DataFrame:
    """The cheapest edge to cut of every cycle."""
    x = cycles(v.edges, _LONGEST).select(F.array_join("cycle", "->").alias("cycle_id"), "cycle", F.posexplode("cycle").alias("i", "source"))
    x = x.select("cycle_id", "source", F.element_at("cycle", ((c("i") + 1) % F.size("cycle") + 1).cast("int")).alias("target"))
    fan = v.edges.groupBy(c("src").alias("target")).agg(F.count("*").alias("fan"))
    j = x.join(v.nodes.select(c("id").alias("target"), "complexity"), "target").join(fan, "target", "left")
    cost = F.round(0.5 * c("complexity") + 0.5 * F.coalesce("fan", F.lit(0)), 4)
    best = j.withColumn("cost", cost).groupBy("cycle_id").agg(F.min(F.struct("cost", "source", "target")).alias("b"))
    return best.select("cycle_id", "b.source", "b.target", "b.cost")


@operator("gra_find", "SELECT s_suppkey AS asked, coalesce((SELECT min(id) FROM nodes WHERE id = s_suppkey), (SELECT min(id) FROM nodes WHERE domain = s_nationkey)) AS found FROM supplier")
def gra_find(v: Views) -> DataFrame:
    """By id, else the first of the same domain."""
    first = v.nodes.groupBy(c("domain").alias("s_nationkey")).agg(F.min("id").alias("near"))
    exact = v.nodes.select(c("id").alias("s_suppkey"), c("id").alias("exact"))
    j = v.table("supplier").join(exact, "s_suppkey", "left").join(first, "s_nationkey", "left")
    return j.select(c("s_suppkey").alias("asked"), F.coalesce("exact", "near").alias("found"))


@operator("gra_trace", _reach_sql(_OUT, 3) + ", zero AS (SELECT start, id, depth FROM near UNION ALL SELECT id, id, 0 FROM nodes) SELECT z.start, e.src, e.dst, CAST(min(z.depth) AS INTEGER) AS depth FROM zero z JOIN edges e ON e.src = z.id WHERE z.depth < 3 GROUP BY 1, 2, 3")
def gra_trace(v: Views) -> DataFrame:
    """All edges that a traversal of three steps walks, those to visited nodes as well."""
    near = reach(v.edges, v.nodes, 3).unionByName(v.nodes.select(c("id").alias("start"), "id", F.lit(0).alias("depth"))).where("depth < 3")
    return near.join(v.edges.select("src", "dst"), c("id") == c("src")).groupBy("start", "src", "dst").agg(F.min("depth").alias("depth"))


@operator("gra_subgraph", f"""
WITH around AS (SELECT id AS start, id FROM nodes UNION SELECT src, dst FROM ({_OUT}) a UNION SELECT src, dst FROM ({_IN}) b)
SELECT x.start, e.src, e.dst FROM around x JOIN edges e ON e.src = x.id JOIN around y ON y.start = x.start AND y.id = e.dst""")
def gra_subgraph(v: Views) -> DataFrame:
    """The edges of the subgraph that a module and its neighbours induce."""
    pairs = v.edges.select("src", "dst")
    around = v.nodes.select(c("id").alias("start"), "id").union(pairs).union(reverse(pairs)).distinct()
    ends = around.select("start", c("id").alias("dst"))
    return around.join(pairs, c("id") == c("src")).join(ends, ["start", "dst"]).select("start", "src", "dst")


QUERY_TYPES = ("IMPACT_ANALYSIS", "DEPENDENCIES", "DEPENDENTS", "CALLERS", "TEST_COVERAGE", "RISK_EXPLANATION", "CHANGE_CONTEXT")


def ask(v: Views, kind: str, depth: int = 2) -> DataFrame:
    """One of QUERY_TYPES for every module at once: (start, id)."""
    if kind not in QUERY_TYPES:
        raise ValueError(f"unknown query type {kind}")
    if kind == "DEPENDENCIES":
        return reach(v.edges, v.nodes, depth).select("start", "id")
    if kind in ("DEPENDENTS", "IMPACT_ANALYSIS"):
        return reach(reverse(v.edges), v.nodes, depth).select("start", "id")
    if kind == "CALLERS":
        return reverse(v.edges).select(c("src").alias("start"), c("dst").alias("id"))
    if kind == "TEST_COVERAGE":
        return gra_testsfor(v).withColumnRenamed("test", "id")
    both = reach(v.edges, v.nodes, 1).unionByName(reach(reverse(v.edges), v.nodes, 1)).select("start", "id").distinct()
    return both if kind == "CHANGE_CONTEXT" else both.join(v.nodes.where("complexity > 25.6").select("id"), "id", "left_semi")


@operator("gra_query", f"""
WITH both_ways AS ({_OUT} UNION {_IN}), outward AS (SELECT src, dst FROM edges UNION SELECT a.src, b.dst FROM edges a JOIN edges b ON b.src = a.dst)
SELECT 'CALLERS' AS kind, dst AS start, src AS id FROM edges UNION ALL SELECT 'CHANGE_CONTEXT', src, dst FROM both_ways
UNION ALL SELECT 'RISK_EXPLANATION', src, dst FROM both_ways JOIN nodes ON id = dst AND complexity > 25.6
UNION ALL SELECT 'DEPENDENCIES', src, dst FROM outward UNION ALL SELECT 'DEPENDENTS', dst, src FROM outward UNION ALL SELECT 'IMPACT_ANALYSIS', dst, src FROM outward
UNION ALL SELECT 'TEST_COVERAGE', dst, src FROM outward JOIN nodes ON id = src AND domain % 5 = 0""")
def gra_query(v: Views) -> DataFrame:
    """All query types, each for every module."""
    return reduce(DataFrame.unionByName, [ask(v, k).select(F.lit(k).alias("kind"), "start", "id") for k in QUERY_TYPES])


@operator("gra_topo", """
WITH RECURSIVE up AS (SELECT DISTINCT src, dst FROM edges WHERE dst > src), r(id, level) AS (SELECT id, 0 FROM nodes UNION SELECT up.dst, r.level + 1 FROM r JOIN up ON up.src = r.id)
SELECT id, CAST(max(level) AS INTEGER) AS level FROM r GROUP BY id""")
def gra_topo(v: Views) -> DataFrame:
    """Levels of the graph of edges to larger ids, which has no cycles."""
    return topological_levels(v.nodes.select("id"), v.edges.where("dst > src"))


def topological_levels(nodes: DataFrame, edges: DataFrame, hops: int = 4) -> DataFrame:
    """(id, level): the longest way to each node of ``nodes(id)``; fails on a cycle.

    Levels are pushed along the edges, ``hops`` steps a round, until none changes; only a node whose level
    changed pushes on.  A level of as many as there are nodes shows a cycle.
    """
    up = materialize(edges.select("src", "dst").distinct(), "topo-edges")
    level = materialize(nodes.select("id", F.lit(0).alias("level")).distinct(), "topo")
    most = level.count()
    new = level
    while True:
        step, pushed = new, None
        for _ in range(hops):
            step = step.join(up, c("id") == c("src")).groupBy(c("dst").alias("id")).agg((F.max("level") + 1).alias("level"))
            pushed = step if pushed is None else pushed.unionByName(step)
        pushed = pushed.groupBy("id").agg(F.max("level").alias("pushed"))
        now = level.join(pushed, "id", "left").select("id", F.greatest("level", F.coalesce("pushed", "level")).alias("level"), c("level").alias("before"))
        now = materialize(now, "topo")
        new = now.where("level > before").select("id", "level")
        highest = new.agg(F.max("level")).first()[0]
        level = now.select("id", "level")
        if highest is None:
            return level
        if highest >= most:
            raise ValueError("the graph has a cycle")


@operator("gra_structdiff", "SELECT DISTINCT e.dst AS impacted FROM edges e JOIN nodes a ON a.id = e.src AND a.domain < 5 JOIN nodes b ON b.id = e.dst AND b.domain >= 5")
def gra_structdiff(v: Views) -> DataFrame:
    touched = v.nodes.where("domain < 5").select(c("id").alias("src"))
    return v.edges.join(touched, "src", "left_semi").join(touched.withColumnRenamed("src", "dst"), "dst", "left_anti").select(c("dst").alias("impacted")).distinct()


def ancestors(runs: DataFrame, depth: int) -> DataFrame:
    """(run_id, depth, ancestor) of runs(run_id, previous_run_id), up to ``depth`` back, by pointer doubling: log2(depth) joins, whatever the history's shape.

    Histories may branch (several runs with one previous run).  A previous run that is no run ends a history, as null does.
    """
    known = runs.select("run_id").distinct()
    links = runs.select("run_id", c("previous_run_id").alias("ancestor")).distinct().join(known.select(c("run_id").alias("ancestor")), "ancestor", "left_semi")
    found, covered = materialize(links.select("run_id", F.lit(1).alias("depth"), "ancestor"), "ancestors"), 1
    while covered < depth:
        jump = found.where(c("depth") == covered).select("run_id", c("ancestor").alias("via"))
        more = jump.join(found.select(c("run_id").alias("via"), "depth", "ancestor"), "via").select("run_id", (c("depth") + covered).alias("depth"), "ancestor")
        found = materialize(found.unionByName(more.where(c("depth") <= depth)), "ancestors")
        covered *= 2
    return found


def reaching_starts(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(id, block, bits): which starts(start, id) lead to each node along edges(src, dst), or are the node itself; a start s is bit s % 64 of block s // 64.

    Instead of a row for each start and node there is one for 64 starts: a round sends on what is new in a node's bits, and adds it up by ``or``.
    """
    e = written(edges)
    block, bit = F.floor(c("start") / 64).cast("long"), _bit(c("start"))
    held = materialize(starts.where("start is not null and id is not null").groupBy("id", block.alias("block")).agg(F.bit_or(bit).alias("bits")), "starts")
    new = held
    while not new.isEmpty():
        sent = new.join(e, c("id") == c("src")).groupBy(c("dst").alias("id"), "block").agg(F.bit_or("bits").alias("sent"))
        merged = held.join(sent, ["id", "block"], "full").select("id", "block", F.coalesce("bits", F.lit(0)).cast("long").alias("old"), F.coalesce("sent", F.lit(0)).cast("long").alias("sent"))
        step = materialize(merged.select("id", "block", c("old").bitwiseOR(c("sent")).alias("bits"), c("sent").bitwiseAND(F.bitwise_not("old")).alias("new")), "starts")
        held, new = step.select("id", "block", "bits"), step.where("new <> 0").select("id", "block", c("new").alias("bits"))
    return held


def starts_of(held: DataFrame) -> DataFrame:
    """(id, start) of the bits of ``reaching_starts``."""
    return _bit_numbers(held, "id").withColumnRenamed("no", "start")


def predicted_tests(calls: DataFrame, changed: DataFrame, tests: DataFrame) -> DataFrame:
    """(change, test): the tests(test) that call something affected by change sets changed(change, id): what was changed, and whatever calls it, near or far.

    ``calls(src, dst)``: src calls dst.  Change sets are followed together, 64 to a row.
    """
    affected = reaching_starts(reverse(calls), changed.select(c("change").alias("start"), "id"))
    calling = calls.join(tests.select(c("test").alias("src")), "src", "left_semi").select("src", "dst").distinct()
    met = calling.join(affected, c("dst") == c("id")).groupBy(c("src").alias("id"), "block").agg(F.bit_or("bits").alias("bits"))
    return starts_of(met).select(c("start").alias("change"), c("id").alias("test"))
