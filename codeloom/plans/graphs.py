"""The graph operators over nations that trade."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators import blocks, graphs, model_graph
from codeloom.plans.bindings import Bound
from codeloom.plans.insights import IMPORT_GRAPH, communities_sql, import_graph
from codeloom.plans.registry import query


@query("gr01_import_graph", f"WITH {IMPORT_GRAPH} SELECT m.id, (SELECT count(*) FROM graph g WHERE g.src = m.id) AS n_out, (SELECT count(*) FROM graph g WHERE g.dst = m.id) AS n_in FROM modules m")
def import_degrees(b: Bound) -> DataFrame:
    """Both directions of the import graph; modules without imports stay."""
    found = graphs.degrees(b("modules"), import_graph(b))
    return found.select("id", F.col("fan_out").cast("long").alias("n_out"), F.col("fan_in").cast("long").alias("n_in"))


@query("gr02_strongly_connected", """WITH RECURSIVE reach AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON e.src = r.dst)
    SELECT a.src AS id, least(a.src, min(a.dst)) AS component FROM reach a JOIN reach z ON z.src = a.dst AND z.dst = a.src WHERE a.src <> a.dst GROUP BY a.src""")
def scc(b: Bound) -> DataFrame:
    return graphs.strongly_connected(b("nodes"), b("edges"))


@query("gr03_articulation_points", """
    WITH RECURSIVE u AS (SELECT DISTINCT least(src, dst) AS x, greatest(src, dst) AS y FROM acyclic), b AS (SELECT x, y FROM u UNION ALL SELECT y, x FROM u), v AS (SELECT DISTINCT x FROM b),
    reach AS (SELECT v.x AS gone, b.x, b.y FROM v, b WHERE b.x <> v.x AND b.y <> v.x UNION SELECT r.gone, r.x, b.y FROM reach r JOIN b ON b.x = r.y WHERE b.y <> r.gone)
    SELECT DISTINCT a.x AS id FROM b a JOIN b z ON z.x = a.x AND a.y < z.y WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.gone = a.x AND r.x = a.y AND r.y = z.y)""")
def articulation(b: Bound) -> DataFrame:
    return blocks.articulation_points(b("nodes"), b("acyclic"))


@query("gr04_label_propagation", f"WITH RECURSIVE {communities_sql('edges')} SELECT n.id, coalesce(label, n.id) AS label FROM nodes n LEFT JOIN community USING (id)")
def labels(b: Bound) -> DataFrame:
    return graphs.label_propagation(b("nodes"), b("edges"))


@query("gr05_recursive_chain", "WITH RECURSIVE c AS (SELECT class_id, parent_id, 1 AS depth FROM extends UNION ALL SELECT c.class_id, e.parent_id, c.depth + 1 FROM c JOIN extends e ON e.class_id = c.parent_id WHERE c.depth < 10) SELECT class_id, parent_id, depth FROM c")
def chain(b: Bound) -> DataFrame:
    """Chains of ten steps at most, by a frontier; Spark's own recursive queries stop at a number of rows."""
    found = graphs.ancestors(b("extends").select(F.col("class_id").alias("id"), F.col("parent_id").alias("parent")), 10)
    return found.select(F.col("id").alias("class_id"), F.col("ancestor").alias("parent_id"), F.col("distance").alias("depth"))


def _model(b: Bound) -> dict[str, DataFrame]:
    """A code model: regions are packages, nations modules, customers classes, suppliers interfaces, orders members."""
    key = lambda df, **names: df.select(*(F.expr(e).alias(n) for n, e in names.items()))
    folder = lambda c, name: key(b("nodes"), **{c: "id", name: "folder"})
    pairs = b("edges").join(folder("src", "a"), "src").join(folder("dst", "z"), "dst").select("a", "z").distinct()
    suppliers = b("supplier").agg(F.count("*").alias("n"))
    customers = b("classes").select("id").join(F.broadcast(suppliers))
    members = key(b("members"), id="id", kind="kind", parent_id="parent_id", parent_type="'class'")
    end = lambda c, name: members.select(F.col("id").alias(c), F.col("kind").alias(name))
    return {
        "packages": key(b("region"), id="r_regionkey"),
        "modules": key(b("nodes"), id="id", package_id="folder"),
        "classes": b("classes").select("id", "module_id"),
        "interfaces": key(b("supplier"), id="s_suppkey", module_id="s_nationkey"),
        "members": members,
        "externals": key(b("events").filter("user_id % 17 <> 16"), name="concat('pkg', user_id % 17)").distinct(),
        "package_dependencies": key(pairs, src="a", dst="z", kind="CASE (a + z) % 3 WHEN 0 THEN 'dependency' WHEN 1 THEN 'devDependency' ELSE 'peerDependency' END"),
        "imports": b("edges"),
        "exports": b("acyclic").filter("src % 5 = 0"),
        "external_imports": key(b("events"), src="event_id % 25", name="concat('pkg', user_id % 17)"),
        "scopes": b.spark.range(9).select(F.concat(F.lit("pkg"), (2 * F.col("id")).cast("string")).alias("name"), F.lit("devDependency").alias("kind")),
        "class_extends": key(b("classes").filter("id % 4 = 0"), src="id", dst="id - 25"),
        "interface_extends": key(b("supplier").filter("s_suppkey % 3 = 0"), src="s_suppkey", dst="s_suppkey + 1"),
        "implements": key(customers.filter("id % 3 = 0"), src="id", dst="id % n"),
        "references": key(b("symbol_references"), src="source_id", dst="target_id").join(end("src", "src_kind"), "src").join(end("dst", "dst_kind"), "dst"),
    }


_NODES = """n AS (SELECT 'package:' || r_regionkey AS id, 'package' AS kind, NULL AS parent FROM region UNION ALL SELECT 'module:' || id, 'module', 'package:' || folder FROM nodes
    UNION ALL SELECT 'class:' || id, 'class', 'module:' || module_id FROM classes UNION ALL SELECT 'interface:' || s_suppkey, 'interface', 'module:' || s_nationkey FROM supplier
    UNION ALL SELECT kind || ':' || id, kind, 'class:' || parent_id FROM members UNION ALL SELECT DISTINCT 'externalPackage:pkg' || (user_id % 17), 'externalPackage', NULL FROM events WHERE user_id % 17 <> 16)"""
_EDGES = """e AS (SELECT DISTINCT 'package:' || a.folder AS src, 'package:' || z.folder AS dst, CASE (a.folder + z.folder) % 3 WHEN 0 THEN 'dependency' WHEN 1 THEN 'devDependency' ELSE 'peerDependency' END AS kind
      FROM edges x JOIN nodes a ON a.id = x.src JOIN nodes z ON z.id = x.dst
    UNION SELECT 'module:' || src, 'module:' || dst, 'import' FROM edges WHERE src <> dst UNION SELECT 'module:' || src, 'module:' || dst, 'export' FROM acyclic WHERE src % 5 = 0
    UNION SELECT 'module:' || (event_id % 25), 'externalPackage:pkg' || (user_id % 17), CASE WHEN user_id % 17 % 2 = 0 THEN 'devDependency' ELSE 'import' END FROM events
    UNION SELECT 'class:' || id, 'class:' || (id - 25), 'extends' FROM classes WHERE id % 4 = 0 UNION SELECT 'interface:' || s_suppkey, 'interface:' || (s_suppkey + 1), 'extends' FROM supplier WHERE s_suppkey % 3 = 0
    UNION SELECT 'class:' || id, 'interface:' || (id % (SELECT count(*) FROM supplier)), 'implements' FROM classes WHERE id % 3 = 0
    UNION SELECT a.kind || ':' || a.id, z.kind || ':' || z.id, 'uses' FROM symbol_references r JOIN members a ON a.id = r.source_id JOIN members z ON z.id = r.target_id
    UNION SELECT parent, id, 'contains' FROM n WHERE kind IN ('class', 'interface', 'method', 'property')),
    g AS (SELECT * FROM e WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n))"""


@query("gr06_edge_creation", f"WITH {_NODES}, {_EDGES} SELECT src, dst, kind FROM g")
def edge_creation(b: Bound) -> DataFrame:
    """Edges of all nine kinds, each once, whose ends exist."""
    model = _model(b)
    return model_graph.edges(model, model_graph.nodes(model))


@query("gr06_edges_of_kinds", f"WITH {_NODES}, {_EDGES} SELECT src, dst, kind FROM g WHERE kind IN ('extends', 'peerDependency', 'uses')")
def edges_of_kinds(b: Bound) -> DataFrame:
    model = _model(b)
    return model_graph.edges(model, model_graph.nodes(model), ("extends", "peerDependency", "uses"))


@query("gr07_node_creation", f"WITH {_NODES} SELECT id, kind, parent FROM n")
def node_creation(b: Bound) -> DataFrame:
    return model_graph.nodes(_model(b))


@query("gr09_cluster_by_folder", "SELECT package_id || ':' || directory AS folder, package_id, count(*) AS modules FROM modules GROUP BY ALL")
def folders(b: Bound) -> DataFrame:
    return b("modules").groupBy(F.concat_ws(":", "package_id", "directory").alias("folder"), "package_id").agg(F.count("*").alias("modules"))


@query("gr10_lift_folder_edges", """WITH p AS (SELECT e.src, e.dst, e.kind, nullif(a.folder, 4) AS f, nullif(z.folder, 4) AS t FROM view_edges e JOIN nodes a ON a.id = e.src JOIN nodes z ON z.id = e.dst),
    c AS (SELECT * FROM p WHERE f IS DISTINCT FROM t)
    SELECT coalesce('folder:' || f, src::VARCHAR) AS src, coalesce('folder:' || t, dst::VARCHAR) AS dst, kind, count(*) AS n, 'trunk' AS role FROM c GROUP BY ALL
    UNION ALL SELECT src::VARCHAR, 'folder:' || f, kind, count(*), 'source_stub' FROM c WHERE f IS NOT NULL GROUP BY ALL
    UNION ALL SELECT 'folder:' || t, dst::VARCHAR, kind, count(*), 'target_stub' FROM c WHERE t IS NOT NULL GROUP BY ALL
    UNION ALL SELECT src::VARCHAR, dst::VARCHAR, kind, count(*), 'edge' FROM p WHERE f IS NOT DISTINCT FROM t GROUP BY ALL""")
def lift(b: Bound) -> DataFrame:
    placed = b("nodes").select("id", F.when(F.col("folder") != 4, F.col("folder")).alias("folder"))
    return graphs.lift(b("view_edges").select("src", "dst", "kind"), placed).select("src", "dst", "kind", "n", "role")


_UP = "parents AS (SELECT id, CASE WHEN folder < 2 THEN 100 + folder WHEN folder < 4 THEN 102 + folder % 2 END AS parent FROM nodes UNION ALL SELECT 100, 103 UNION ALL SELECT 101, 103 UNION ALL SELECT 102, NULL UNION ALL SELECT 103, NULL)"


def _parents(b: Bound) -> DataFrame:
    f = F.col("folder")
    own = b("nodes").select("id", F.when(f < 2, 100 + f).when(f < 4, 102 + f % 2).alias("parent"))
    return own.union(b.spark.createDataFrame([(100, 103), (101, 103), (102, None), (103, None)], "id int, parent int"))


@query("gr11_collapse_folders", f"""WITH {_UP}, moved AS (SELECT p.id, CASE WHEN p.parent IN (100, 101) OR p.parent = 103 THEN 103 END AS to_id FROM parents p),
    m AS (SELECT DISTINCT coalesce(a.to_id, e.src) AS src, coalesce(z.to_id, e.dst) AS dst, kind FROM view_edges e LEFT JOIN moved a ON a.id = e.src LEFT JOIN moved z ON z.id = e.dst) SELECT src, dst, kind FROM m WHERE src <> dst""")
def collapse(b: Bound) -> DataFrame:
    """Folders 101 and 103 are collapsed; what lies in 101 goes to 103, which is the outermost."""
    closed = b.spark.createDataFrame([(101,), (103,)], "id int")
    return graphs.collapse(b("view_edges").select("src", "dst", "kind"), _parents(b), closed)[0]


@query("gr11_collapse_counts", f"""WITH {_UP}, moved AS (SELECT p.id, CASE WHEN p.parent IN (100, 101) OR p.parent = 103 THEN 103 END AS to_id FROM parents p),
    m AS (SELECT DISTINCT coalesce(a.to_id, e.src) AS src, coalesce(z.to_id, e.dst) AS dst, kind FROM view_edges e LEFT JOIN moved a ON a.id = e.src LEFT JOIN moved z ON z.id = e.dst) SELECT 103 AS id, count(*) AS n FROM m WHERE src <> dst AND (src = 103 OR dst = 103)""")
def collapse_counts(b: Bound) -> DataFrame:
    closed = b.spark.createDataFrame([(101,), (103,)], "id int")
    return graphs.collapse(b("view_edges").select("src", "dst", "kind"), _parents(b), closed)[1]


@query("gr13_bundle_parallel_edges", """WITH r AS (SELECT src, dst, kind, n, n % 7 = 0 AS hidden,
           CASE WHEN kind IN ('contains', 'uses') THEN 5 WHEN kind = 'extends' THEN 4 WHEN kind = 'implements' THEN 3 WHEN kind = 'dependency' THEN 2 WHEN kind = 'import' THEN 1 ELSE 0 END AS priority FROM view_edges),
    f AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY hidden, priority DESC, n, kind) AS place FROM r)
    SELECT src, dst, max(kind) FILTER (place = 1) AS kind, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, count(*) AS n FROM f GROUP BY src, dst""")
def bundle(b: Bound) -> DataFrame:
    found = graphs.bundle(b("view_edges").select("src", "dst", "kind", (F.col("n") % 7 == 0).alias("hidden"), F.col("n").alias("seq")))
    return found.select("src", "dst", "kind", F.array_join("kinds", ",").alias("kinds"), "n")


@query("gr14_back_edges")
def back_edges(b: Bound) -> DataFrame:
    return graphs.back_edges(b("nodes"), b("edges"))


_PATHS = "RECURSIVE p AS (SELECT id, id AS at, 0 AS n FROM nodes UNION ALL SELECT p.id, a.dst, p.n + 1 FROM p JOIN acyclic a ON a.src = p.at)"


@query("gr15_layers", f"WITH {_PATHS} SELECT id, max(n)::INT AS layer FROM p GROUP BY id")
def layers(b: Bound) -> DataFrame:
    return graphs.layers(b("nodes"), b("acyclic"))


@query("gr16_weighted_depth", """WITH RECURSIVE c AS (SELECT dst, 1 + log2(count(DISTINCT src)) AS cost FROM acyclic GROUP BY dst),
    p AS (SELECT id, id AS at, 0.0::DOUBLE AS w, [id] AS way FROM nodes UNION ALL SELECT p.id, a.dst, p.w + c.cost, list_append(p.way, a.dst) FROM p JOIN acyclic a ON a.src = p.at JOIN c ON c.dst = a.dst),
    f AS (SELECT id, round(w, 9) AS weight, array_to_string(way, '>') AS trace, row_number() OVER (PARTITION BY id ORDER BY round(w, 9) DESC, way) AS place FROM p) SELECT id, weight, trace FROM f WHERE place = 1""")
def weights(b: Bound) -> DataFrame:
    """The dearest path out of each vertex, with the vertices on it."""
    weighted = graphs.settled(graphs.weighted_depth(b("nodes"), b("acyclic")))
    steps = F.sort_array(F.collect_list(F.struct("place", F.col("step").cast("string").alias("step"))))
    trace = graphs.traces(weighted).groupBy("id").agg(F.array_join(F.transform(steps, lambda s: s["step"]), ">").alias("trace"))
    return weighted.join(trace, "id").select("id", F.round("weight", 9).alias("weight"), "trace")


_SWEEPS = "".join(
    f""", m{k} AS (SELECT w.src AS id, round(sum(1.0 / abs(x.layer - y.layer) * y.place) / sum(1.0 / abs(x.layer - y.layer)), 9) AS mean FROM both_ways w JOIN s{k} x ON x.id = w.src JOIN s{k} y ON y.id = w.dst WHERE x.layer {'<' if k % 2 else '>'} y.layer GROUP BY w.src),
    s{k + 1} AS (SELECT s{k}.id, layer, row_number() OVER (PARTITION BY layer ORDER BY coalesce(mean, place::DOUBLE), s{k}.id)::INT AS place FROM s{k} LEFT JOIN m{k} USING (id))"""
    for k in range(4)
)


@query("gr17_barycenter_order", f"""WITH {_PATHS}, lay AS (SELECT id, max(n)::INT AS layer FROM p GROUP BY id), both_ways AS (SELECT src, dst FROM acyclic UNION SELECT dst, src FROM acyclic),
    s0 AS (SELECT id, layer, row_number() OVER (PARTITION BY layer ORDER BY id)::INT AS place FROM lay){_SWEEPS},
    d AS (SELECT s4.*, (SELECT count(*) FROM both_ways w WHERE w.src = s4.id) AS degree FROM s4),
    r AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY degree DESC, place) - 1 AS rank, count(*) OVER (PARTITION BY layer) AS n, max(degree) OVER (PARTITION BY layer) AS most, avg(degree) OVER (PARTITION BY layer) AS mean FROM d)
    SELECT id, layer, CASE WHEN n > 2 AND mean > 0 AND most >= 2 * mean THEN (n - 1) // 2 + CASE WHEN rank % 2 = 1 THEN (rank + 1) // 2 ELSE -(rank // 2) END + 1 ELSE place END::INT AS place FROM r""")
def order(b: Bound) -> DataFrame:
    return graphs.order_layers(graphs.layers(b("nodes"), b("acyclic")), b("acyclic"))


@query("gr18_folder_pass")
def folder_pass(b: Bound) -> DataFrame:
    """Layers of folders over their trunks, cycles taken out first; only folders with a trunk are placed."""
    folder = lambda key, name: b("nodes").select(F.col("id").alias(key), F.col("folder").alias(name))
    trunks = b("edges").join(folder("src", "a"), "src").join(folder("dst", "z"), "dst").filter("a <> z").select(F.col("a").alias("src"), F.col("z").alias("dst")).distinct()
    trunks = graphs.settled(trunks)
    joined = trunks.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    straight = trunks.join(graphs.back_edges(joined, trunks), ["src", "dst"], "left_anti")
    return graphs.order_layers(graphs.layers(joined, straight), straight)


@query("gr19_within_steps", "WITH RECURSIVE u AS (SELECT src AS x, dst AS y FROM acyclic UNION SELECT dst, src FROM acyclic), r AS (SELECT 3 AS id, 0 AS depth UNION SELECT u.y, r.depth + 1 FROM r JOIN u ON u.x = r.id WHERE r.depth < 3) SELECT id, min(depth) AS depth FROM r GROUP BY id")
def within(b: Bound) -> DataFrame:
    return graphs.within(b("acyclic"), b("nodes").filter("id = 3"), 3)


_TAKEN = "u AS (SELECT src, dst, kind FROM view_edges WHERE kind NOT IN ('contains', 'uses')), w AS (SELECT src AS x, dst AS y FROM u UNION SELECT dst, src FROM u), r AS (SELECT 3 AS id, 0 AS depth UNION SELECT w.y, r.depth + 1 FROM r JOIN w ON w.x = r.id WHERE r.depth < {depth}), d AS (SELECT id, min(depth) AS depth FROM r GROUP BY id)"


def _around(b: Bound, depth: int) -> tuple[DataFrame, DataFrame]:
    return model_graph.traversal(b("view_edges").select("src", "dst", "kind"), b("nodes").filter("id = 3").select("id"), depth, b("nodes").select("id", "folder"))


@query("gr19_traversal", f"""WITH RECURSIVE {_TAKEN.format(depth=2)} SELECT d.id, d.depth, EXISTS (SELECT 1 FROM u WHERE u.dst = 3 AND u.src = d.id) AS inbound, EXISTS (SELECT 1 FROM u WHERE u.src = 3 AND u.dst = d.id) AS outbound, n.folder
    FROM d JOIN nodes n ON n.id = d.id""")
def traversal(b: Bound) -> DataFrame:
    """Two steps over edges that aren't contains or uses, with the sides of the start's own neighbours and the folders."""
    return _around(b, 2)[0]


@query("gr19_induced_edges", f"WITH RECURSIVE {_TAKEN.format(depth=1)} SELECT src, dst, kind FROM u WHERE src IN (SELECT id FROM d) AND dst IN (SELECT id FROM d)")
def induced(b: Bound) -> DataFrame:
    return _around(b, 1)[1]


@query("gr21_balanced_sides", """WITH u AS (SELECT src, dst FROM view_edges WHERE kind NOT IN ('contains', 'uses')), f AS (SELECT id, id IN (SELECT src FROM u WHERE dst = 3) AS i, id IN (SELECT dst FROM u WHERE src = 3) AS o FROM nodes),
    c AS (SELECT count(*) FILTER (o AND NOT i) - count(*) FILTER (i AND NOT o) AS more FROM f), p AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM f WHERE i AND o)
    SELECT f.id, CASE WHEN NOT o THEN 'inbound' WHEN NOT i THEN 'outbound' WHEN k < abs(more) THEN CASE WHEN more >= 0 THEN 'inbound' ELSE 'outbound' END WHEN (k - abs(more)) % 2 = 0 THEN 'inbound' ELSE 'outbound' END AS side
    FROM f LEFT JOIN p ON p.id = f.id CROSS JOIN c WHERE i OR o""")
def balanced(b: Bound) -> DataFrame:
    return model_graph.sides(_around(b, 1)[0])


@query("gr20_orphan_flags", "SELECT n.id, NOT EXISTS (SELECT 1 FROM edges e WHERE n.id IN (e.src, e.dst)) AS orphan_global, NOT EXISTS (SELECT 1 FROM acyclic e WHERE n.id IN (e.src, e.dst)) AS orphan_current FROM nodes n")
def orphan_flags(b: Bound) -> DataFrame:
    total = graphs.degrees(b("nodes"), b("edges")).select("id", (F.col("fan_in") + F.col("fan_out") == 0).alias("orphan_global"))
    shown = graphs.degrees(b("nodes"), b("acyclic")).select("id", (F.col("fan_in") + F.col("fan_out") == 0).alias("orphan_current"))
    return total.join(shown, "id")


@query("gr21_neighbourhood", "SELECT id, bool_or(o) AS outwards, bool_or(NOT o) AS inwards FROM (SELECT dst AS id, true AS o FROM edges WHERE src = 6 UNION ALL SELECT src, false FROM edges WHERE dst = 6) WHERE id <> 6 GROUP BY id")
def neighbourhood(b: Bound) -> DataFrame:
    """What a node leads to and what leads to it; those that do both are told by both flags."""
    out = b("edges").filter("src = 6").select(F.col("dst").alias("id"), F.lit(True).alias("o"))
    into = b("edges").filter("dst = 6").select(F.col("src").alias("id"), F.lit(False).alias("o"))
    return out.union(into).filter("id <> 6").groupBy("id").agg(F.max("o").alias("outwards"), F.max(~F.col("o")).alias("inwards"))


@query("gr22_selection_adjacency", """WITH a AS (SELECT src AS id, dst AS other FROM edges UNION SELECT dst, src FROM edges), f AS (SELECT DISTINCT 'folder:' || n.folder AS id, a.other FROM a JOIN nodes n ON n.id = a.id)
    SELECT id, count(*) AS neighbours FROM (SELECT id::VARCHAR AS id, other FROM a UNION ALL SELECT * FROM f) GROUP BY id""")
def adjacency(b: Bound) -> DataFrame:
    """Neighbours of each node, and of each folder through the nodes in it."""
    near = b("edges").select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("id"), F.col("src").alias("other")))).alias("p")).select("p.*").distinct()
    up = near.join(b("nodes").select("id", "folder"), "id").select(F.concat(F.lit("folder:"), F.col("folder").cast("string")).alias("id"), "other").distinct()
    return near.select(F.col("id").cast("string").alias("id"), "other").union(up).groupBy("id").agg(F.count("*").alias("neighbours"))


@query("gr23_module_drilldown", "SELECT 'class' AS kind, id::VARCHAR AS id FROM classes WHERE module_id = 6 UNION ALL SELECT 'module', dst::VARCHAR FROM edges WHERE src = 6 UNION ALL SELECT 'module', src::VARCHAR FROM edges WHERE dst = 6 AND src NOT IN (SELECT dst FROM edges WHERE src = 6)")
def module_drilldown(b: Bound) -> DataFrame:
    linked = b("edges").filter("src = 6").select("dst").union(b("edges").filter("dst = 6").select("src")).distinct()
    own = b("classes").filter("module_id = 6").select(F.lit("class").alias("kind"), F.col("id").cast("string").alias("id"))
    return own.union(linked.select(F.lit("module"), F.col("dst").cast("string")))


@query("gr24_symbol_drilldown", "SELECT 'contains' AS kind, parent_id AS src, id AS dst FROM members WHERE parent_id = 7 UNION ALL SELECT DISTINCT 'uses', r.source_id, r.target_id FROM symbol_references r WHERE r.source_id IN (SELECT id FROM members WHERE parent_id = 7) OR r.target_id IN (SELECT id FROM members WHERE parent_id = 7)")
def symbol_drilldown(b: Bound) -> DataFrame:
    own = b("members").filter("parent_id = 7").select("id")
    refs = b("symbol_references").select("source_id", "target_id")
    uses = refs.join(own.withColumnRenamed("id", "source_id"), "source_id", "left_semi").select("source_id", "target_id").union(refs.join(own.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select("source_id", "target_id")).distinct()
    return b("members").filter("parent_id = 7").select(F.lit("contains").alias("kind"), F.col("parent_id").alias("src"), F.col("id").alias("dst")).union(uses.select(F.lit("uses"), "source_id", "target_id"))


@query("gr24_module_focus", f"""WITH {_NODES}, {_EDGES}, h AS (SELECT id FROM n WHERE parent = 'module:7' OR parent IN (SELECT id FROM n WHERE parent = 'module:7'))
    SELECT src, dst, kind FROM g WHERE (kind = 'contains' AND dst IN (SELECT id FROM h)) OR (kind = 'uses' AND (src IN (SELECT id FROM h) OR dst IN (SELECT id FROM h)))""")
def module_focus(b: Bound) -> DataFrame:
    """All symbols of a module with their members, and what uses these or is used by them."""
    return _focused(b, "module:7")


@query("gr24_class_focus", f"""WITH {_NODES}, {_EDGES}, h AS (SELECT id FROM n WHERE parent = 'class:7')
    SELECT src, dst, kind FROM g WHERE (kind = 'contains' AND (src = 'class:7' OR dst = 'class:7')) OR (kind = 'uses' AND (src IN (SELECT id FROM h) OR dst IN (SELECT id FROM h)))""")
def class_focus(b: Bound) -> DataFrame:
    return _focused(b, "class:7")


def _focused(b: Bound, focus: str) -> DataFrame:
    model = _model(b)
    every = model_graph.nodes(model)
    return model_graph.drilldown(model_graph.edges(model, every, ("contains", "uses")), every.select("id", "parent"), focus)


@query("gr25_topological_order", "SELECT * FROM (VALUES (0, 'size'), (1, 'coupling'), (2, 'maintainability'), (3, 'a'), (4, 'b')) t(place, name)")
def topological(b: Bound) -> DataFrame:
    order = graphs.topological(["maintainability", "size", "coupling", "a", "b"], {"maintainability": ["size", "coupling"], "a": ["b"], "b": ["a"], "size": ["unknown"]})
    return b.spark.createDataFrame(list(enumerate(order)), "place int, name string")


@query("gr26_layout_coordinates", f"""WITH {_PATHS}, l AS (SELECT id, max(n) AS layer FROM p GROUP BY id), o AS (SELECT id, layer, row_number() OVER (PARTITION BY layer ORDER BY id) AS place, 40.0 + id AS height FROM l)
    SELECT id, ((max(layer) OVER () - layer) * 300.0)::DOUBLE AS x, coalesce(sum(height + 20.0) OVER (PARTITION BY layer ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)::DOUBLE AS y FROM o""")
def layout(b: Bound) -> DataFrame:
    placed = graphs.layers(b("nodes"), b("acyclic")).withColumn("place", F.row_number().over(Window.partitionBy("layer").orderBy("id"))).withColumn("height", F.lit(40.0) + F.col("id"))
    return graphs.coordinates(placed)


def _viewed(b: Bound) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    nodes = b("nodes").select("id", F.nullif("folder", F.lit(4)).alias("folder"), (F.col("id") % 4 == 0).alias("test"))
    edges, collapsed = b("view_edges").select("src", "dst", "kind"), b.spark.createDataFrame([(2,)], "folder int")
    return nodes, edges, collapsed, model_graph.overview_edges(nodes, edges, collapsed, ("import",), 30)


@query("gr27_overview_edges", """WITH v AS (SELECT id, nullif(folder, 4) AS f FROM nodes WHERE id % 4 <> 0), p AS (SELECT e.src, e.dst, e.kind, a.f, z.f AS t FROM view_edges e JOIN v a ON a.id = e.src JOIN v z ON z.id = e.dst),
    l AS (SELECT src::VARCHAR AS src, dst::VARCHAR AS dst, kind FROM p WHERE f IS NOT DISTINCT FROM t UNION ALL SELECT coalesce('folder:' || f, src::VARCHAR), coalesce('folder:' || t, dst::VARCHAR), kind FROM p WHERE f IS DISTINCT FROM t
      UNION ALL SELECT src::VARCHAR, 'folder:' || f, kind FROM p WHERE f IS DISTINCT FROM t AND f IS NOT NULL UNION ALL SELECT 'folder:' || t, dst::VARCHAR, kind FROM p WHERE f IS DISTINCT FROM t AND t IS NOT NULL),
    c AS (SELECT DISTINCT CASE WHEN src IN (SELECT id::VARCHAR FROM v WHERE f = 2) THEN 'folder:2' ELSE src END AS src, CASE WHEN dst IN (SELECT id::VARCHAR FROM v WHERE f = 2) THEN 'folder:2' ELSE dst END AS dst, kind FROM l),
    d AS (SELECT *, kind NOT IN ('contains', 'uses', 'import') AS hidden, CASE WHEN kind IN ('contains', 'uses') THEN 5 WHEN kind = 'extends' THEN 4 WHEN kind = 'implements' THEN 3 ELSE 1 END AS priority FROM c WHERE src <> dst),
    r AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY hidden, priority DESC, kind) AS place FROM d),
    g AS (SELECT src, dst, max(kind) FILTER (place = 1) AS kind, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, count(*) AS n, bool_and(hidden) AS hidden FROM r GROUP BY src, dst)
    SELECT * FROM g WHERE (SELECT count(*) FROM d) >= 30 UNION ALL SELECT src, dst, kind, kind, 1, hidden FROM d WHERE (SELECT count(*) FROM d) < 30""")
def overview_edges(b: Bound) -> DataFrame:
    """What the overview draws: without tests, lifted to folders, folder 2 collapsed, hidden kinds marked, bundled."""
    return _viewed(b)[3].withColumn("kinds", F.array_join("kinds", ","))


@query("gr27_overview")
def overview(b: Bound) -> DataFrame:
    """The overview's nodes and folders: layers, weights, places, what a collapsed folder hides and what no edge touches."""
    nodes, edges, collapsed, drawn = _viewed(b)
    return model_graph.overview_nodes(nodes, edges, drawn, collapsed)


@query("gr_supplier_components", """WITH RECURSIVE e AS (SELECT a.l_suppkey AS src, z.l_suppkey AS dst FROM lineitem a JOIN lineitem z ON z.l_orderkey = a.l_orderkey AND z.l_linenumber = a.l_linenumber + 1 WHERE a.l_suppkey <> z.l_suppkey GROUP BY ALL HAVING count(*) * 7500 >= (SELECT count(*) FROM lineitem)),
    reach AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM reach r JOIN e ON e.src = r.dst)
    SELECT a.src AS id, least(a.src, min(a.dst)) AS component FROM reach a JOIN reach z ON z.src = a.dst AND z.dst = a.src WHERE a.src <> a.dst GROUP BY a.src""")
def supplier_components(b: Bound) -> DataFrame:
    """Strongly connected suppliers of consecutive lines: a larger graph."""
    line = b("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    nxt = line.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_suppkey").alias("dst"))
    total = b("lineitem").agg(F.count("*").alias("total"))
    pairs = line.join(nxt, ["l_orderkey", "l_linenumber"]).filter("l_suppkey <> dst").groupBy(F.col("l_suppkey").alias("src"), "dst").agg(F.count("*").alias("n"))
    edges = graphs.settled(pairs.join(F.broadcast(total)).filter("n * 7500 >= total").select("src", "dst"))
    return graphs.strongly_connected(b("supplier").select(F.col("s_suppkey").alias("id")), edges)
