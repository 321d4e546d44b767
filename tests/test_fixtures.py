"""Small cases with known results."""

import uuid

import pytest
from pyspark.sql import functions as F

from codeloom.functions import paths, scalars
from codeloom.operators import blocks, entities, graphs, metrics, pipeline, resolve, rules, sources_text, tables
from codeloom.sources import files


def graph(spark, text, extra=""):
    pairs = [tuple(p) for p in text.split()]
    edges = spark.createDataFrame(pairs, "src string, dst string") if pairs else spark.createDataFrame([], "src string, dst string")
    names = sorted({x for p in pairs for x in p} | set(extra))
    return spark.createDataFrame([(n,) for n in names], "id string"), edges


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.component, set()).add(r.id)
    return {frozenset(v) for v in out.values()}


@pytest.mark.parametrize(
    ("edges", "extra", "want"),
    [
        ("AB BA CD DE EC", "", {"AB", "CDE"}),
        ("AB BC CB CD", "", {"BC"}),
        ("AA", "", set()),
        ("AB BC CA BD DB", "", {"ABCD"}),
        ("YZ ZY", "X", {"YZ"}),
        ("AB BC CD", "", set()),
        ("", "A", set()),
        ("AB BC CD DA EF FG GE DE", "", {"ABCD", "EFG"}),
    ],
)
def test_strongly_connected(spark, edges, extra, want):
    assert groups(graphs.strongly_connected(*graph(spark, edges, extra))) == {frozenset(w) for w in want}


@pytest.mark.parametrize(("edges", "want"), [("AB BC CA CD DE EF FD", "CD"), ("AB BC", "B"), ("AB BC CA", ""), ("AB AC AD", "A"), ("AB BC CD DA", ""), ("AB BA", "")])
def test_articulation_points(spark, edges, want):
    assert {r.id for r in blocks.articulation_points(*graph(spark, edges)).collect()} == set(want)


def test_layers_and_weights_of_a_diamond(spark):
    nodes, edges = graph(spark, "AB AC BD CD")
    assert {r.id: r.layer for r in graphs.layers(nodes, edges).collect()} == {"D": 0, "B": 1, "C": 1, "A": 2}
    assert {r.id: -r.weight for r in graphs.weighted_depth(nodes, edges).collect()} == {"D": 0, "B": -2, "C": -2, "A": -3}


def test_back_edges_leave_no_cycle(spark):
    nodes, edges = graph(spark, "AB BC CA CD DE EC EE")
    back = graphs.back_edges(nodes, edges)
    left = edges.filter("src <> dst").join(back, ["src", "dst"], "left_anti")
    assert back.count() > 0 and graphs.strongly_connected(nodes, left).count() == 0


def test_order_is_a_permutation_of_each_layer(spark):
    nodes, edges = graph(spark, "AB AC BD CD AE ED BF")
    placed = graphs.layers(nodes, edges)
    sizes = {r.layer: r["count"] for r in placed.groupBy("layer").count().collect()}
    found = {}
    for r in graphs.order_layers(placed, edges).collect():
        found.setdefault(r.layer, []).append(r.place)
    assert {k: sorted(v) for k, v in found.items()} == {k: list(range(1, n + 1)) for k, n in sizes.items()}


def test_label_propagation(spark):
    nodes, edges = graph(spark, "AB BC CA DE EF FD", "X")
    labels = {r.id: r.label for r in graphs.label_propagation(nodes, edges).collect()}
    assert labels["A"] == labels["B"] == labels["C"] != labels["D"] == labels["E"] == labels["F"] and labels["X"] == "X"
    assert {r.id: r.label for r in graphs.label_propagation(nodes, edges, rounds=0).collect()} == {x: x for x in "ABCDEFX"}


def test_within_steps(spark):
    nodes, edges = graph(spark, "ab bc")
    start = nodes.filter("id = 'a'")
    assert {r.id: r.depth for r in graphs.within(edges, start, 1).collect()} == {"a": 0, "b": 1}
    assert {r.id: r.depth for r in graphs.within(edges, start, 2).collect()} == {"a": 0, "b": 1, "c": 2}
    assert {r.id for r in graphs.within(edges, nodes.filter("id = 'c'"), 5, directed=True).collect()} == {"c"}


def test_bundling_gate(spark):
    def edges(n):
        return spark.createDataFrame([(k // 2, 99, "uses" if k % 2 else "import", False) for k in range(n)], "src int, dst int, kind string, hidden boolean")

    assert graphs.bundle(edges(49)).count() == 49
    found = graphs.bundle(edges(50)).collect()
    assert len(found) == 25 and {(r.kind, tuple(r.kinds), r.n) for r in found} == {("uses", ("import", "uses"), 2)}


def test_nested_collapsed_folders_map_to_the_outermost(spark):
    parents = spark.createDataFrame([("a", "in"), ("b", None), ("in", "out"), ("out", None)], "id string, parent string")
    edges = spark.createDataFrame([("a", "b", "import"), ("b", "a", "import"), ("a", "in", "contains")], "src string, dst string, kind string")
    moved, counts = graphs.collapse(edges, parents, spark.createDataFrame([("in",), ("out",)], "id string"))
    assert {(r.src, r.dst) for r in moved.collect()} == {("out", "b"), ("b", "out")}
    assert {r.id: r.n for r in counts.collect()} == {"out": 2}


def test_topological_order():
    assert graphs.topological(["b", "a"], {"b": ["a"]}) == ["a", "b"]
    assert graphs.topological(["a", "b", "c"], {"a": ["b"], "b": ["a"]}) == ["c", "a", "b"]


MODULES = [("u", "p", "src/utils/helpers.ts", 1), ("c", "p", "src/components/index.ts", 2), ("a", "p", "src/app.ts", 3), ("api", "p", "src/utils/api.ts", 4), ("v", "p", "src/views/Dashboard.ts", 5)]


@pytest.mark.parametrize(
    ("importer", "path", "source", "want"),
    [
        ("x", "src/components/App.ts", "../utils/helpers", "u"),
        ("a", "src/app.ts", "./components/index", "c"),
        ("a", "src/app.ts", "./components", "c"),
        ("v", "src/views/Dashboard.ts", "@/utils/api", "api"),
        ("v", "src/views/Dashboard.ts", "src/utils/api", "api"),
        ("a", "src/app.ts", "lodash", None),
        ("a", "src/app.ts", "@vue/runtime-core", None),
        ("a", "src/app.ts", "./app", None),
        ("a", "src/app.ts", "./missing", None),
    ],
)
def test_import_resolution(spark, importer, path, source, want):
    modules = spark.createDataFrame(MODULES, "id string, package_id string, relative_path string, seq int")
    one = spark.createDataFrame([(importer, path, source)], "module_id string, from_path string, source string")
    assert [r.dst for r in resolve.import_edges(one, modules).collect()] == ([want] if want else [])


def test_coupling(spark):
    nodes, edges = graph(spark, "AB BC")
    found = graphs.degrees(nodes, edges).select("id", "fan_out", "fan_in", scalars.ratio(F.col("fan_out"), F.col("fan_in") + F.col("fan_out")).alias("i"))
    assert {r.id: (r.fan_out, r.fan_in, r.i) for r in found.collect()} == {"A": (1, 0, 1), "B": (1, 1, 0.5), "C": (0, 1, 0)}
    assert [tuple(r) for r in graphs.degrees(*graph(spark, "", "M")).collect()] == [("M", 0, 0)]


def test_sizes_of_commented_text(spark):
    text = "const a = 1;\n// one\n\n/* two\nthree */\nconst b = 2;\n\nconst c = 3;\n\nconst d = 4;"
    r = spark.createDataFrame([(text,)], "text string").select(*(v.alias(k) for k, v in sources_text.sizes(F.col("text")).items())).first()
    assert (r.physical_lines, r.logical_lines, r.comment_lines, r.blank_lines) == (10, 4, 3, 3)


def test_type_safety_counts(spark):
    text = "let a: any; let b: unknown = x as Foo; y!.z"
    r = spark.createDataFrame([(text,)], "text string").select(*(v.alias(k) for k, v in sources_text.type_safety(F.col("text")).items())).first()
    assert r.asDict() == {"any_count": 1, "unknown_count": 1, "as_count": 1, "angle_count": 0, "non_null_count": 1, "ignore_count": 0, "identifiers": 6, "any_density": 1 / 6}


def test_clones_are_counted_in_places(spark):
    block = "\n".join(f"a line that is long enough number {k}" for k in range(3))
    df = spark.createDataFrame([("x", block), ("y", "other\n" + block), ("z", "short")], "id string, text string")
    assert {(r.module_id, r.start_line, r.places) for r in sources_text.clones(df, 3, 20).collect()} == {("x", 1, 2), ("y", 2, 2)}
    assert sources_text.clones(df).count() == 0
    long = "\n\n".join(f"  a line of seven tokens or so {k}" for k in range(11))
    thin = "\n".join(f"x{k}" for k in range(30))  # fewer than 70 tokens in ten lines
    df = spark.createDataFrame([("x", long), ("y", long.replace("  a", "a")), ("z", thin), ("w", thin)], "id string, text string")
    assert {(r.module_id, r.start_line) for r in sources_text.clones(df).collect()} == {("x", 1), ("x", 3), ("y", 1), ("y", 3)}


def test_clone_pairs_are_maximal(spark):
    """A module shares a stretch of twelve lines with one and one of twenty with another; a third place pairs with the first."""
    stretch = lambda name, n: "\n".join(f"  {name} line of some tokens number {k};" for k in range(n))
    own = lambda name, n: "\n".join(f"own {name} {k}" for k in range(n))
    texts = {
        "alpha": "\n".join([own("a", 9), stretch("one", 12), own("b", 5), stretch("two", 20)]),
        "beta": "\n".join([own("c", 39), stretch("one", 12).replace("  one", "one"), own("d", 3)]),
        "gamma": "\n".join([own("e", 4), stretch("two", 20)]),
        "thin": "\n".join(["x"] * 12),
    }
    frame = spark.createDataFrame(list(texts.items()), "id string, text string")
    pairs = sources_text.clone_pairs(frame)
    got = sorted((r.first_module, r.first_start, r.first_end, r.second_module, r.second_start, r.second_end, r.lines, r.tokens) for r in pairs.collect())
    assert got == [("alpha", 10, 21, "beta", 40, 51, 12, 96), ("alpha", 27, 46, "gamma", 5, 24, 20, 160)]
    assert {r.module_id: r.lines for r in sources_text.duplicated_lines(pairs).collect()} == {"alpha": 32, "beta": 12, "gamma": 20}
    again = spark.createDataFrame([(k, stretch("one", 15)) for k in ("p", "q", "r")] + [("s", stretch("one", 15) + "\n\n" + stretch("one", 15)), ("n", None)], "id string, text string")
    assert sorted((r.first_module, r.second_module, r.second_start, r.lines) for r in sources_text.clone_pairs(again).collect()) == [("p", "q", 1, 15), ("p", "r", 1, 15), ("p", "s", 1, 15), ("p", "s", 17, 15)]


def test_paths(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert value(paths.normalize(F.lit("a/./b/../../../c/"))) == "c"
    assert value(paths.join_path(F.lit("a"), F.lit("../../x"))) == "../x"
    assert value(paths.dirname(F.lit("/a"))) == "" and value(paths.dirname(F.lit("a/b/c.ts"))) == "a/b"
    assert value(paths.external_package(F.lit("@scope/name/x"))) == "@scope/name" and value(paths.external_package(F.lit("@scope"))) is None
    assert value(paths.variants(F.lit("src/a/index.ts"))) == ["src/a/index.ts", "src/a/index", "src/a"]
    assert value(paths.package_prefix(F.lit("pkg/src/a.ts"))) == "pkg" and value(paths.glob_prefix(F.lit("src/a/**/*.ts"))) == "src/a"


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert value(scalars.uuid5(str(uuid.NAMESPACE_DNS), F.lit("pkg.modülé.Name"))) == str(uuid.uuid5(uuid.NAMESPACE_DNS, "pkg.modülé.Name"))
    assert value(scalars.pascal_case(F.lit("fooBar-baz_qux"))) == "FooBarBazQux"
    assert value(scalars.ratio(F.lit(1), F.lit(0))) == 0 and value(scalars.round_half_up(F.lit(-2.5))) == -2
    assert value(scalars.heat(F.lit(0.0), 30)) == "rgb(34, 197, 94)" and value(scalars.heat(F.lit(99.0), 30)) == "rgb(239, 68, 68)"
    assert value(scalars.specifiers(F.lit("[oops"))) == [] and value(scalars.type_only(scalars.specifiers(F.lit("[]")))) is False
    assert value(sources_text.union_members(F.lit("A<B|C> | 'x|y' | {a: 1|2}"))) == 3


def test_table_writes(spark, tmp_path):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    rows = spark.createDataFrame([(2, "x", 1), (3, "y", 2), (3, "z", 1)], "id int, name string, seq int")
    assert sorted(map(tuple, tables.insert(table, rows, ["id"], "seq").collect())) == [(1, "a"), (2, "b"), (3, "z")]
    patches = spark.createDataFrame([(1, "p", 1), (1, None, 2)], "id int, name string, at int")
    assert sorted(map(tuple, tables.patch(table, patches, "id", "at").collect())) == [(1, "p"), (2, "b")]
    with pytest.raises(tables.NoFieldsToUpdate):
        tables.patch(table, patches.select("id", "at"), "id", "at")
    path = f"file://{tmp_path}/t"
    tables.replace(table, path)
    tables.replace(tables.delete(spark.read.parquet(path), spark.createDataFrame([(1,)], "id int"), "id"), path)
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [(2, "b")]
    assert tables.verify({"t": table}, {"t": ["id", "size"], "u": []}) == ["u", "t.size"]


def test_metric_diff(spark):
    fact = "entity_id int, metric_key string, metric_value double"
    now, before = spark.createDataFrame([(1, "k", 2.0), (2, "k", 5.0), (4, "k", 1.0)], fact), spark.createDataFrame([(1, "k", 2.0), (3, "k", 4.0), (4, "k", 3.0)], fact)
    assert {r.entity_id: r.delta for r in metrics.diff(now, before).collect()} == {2: 5.0, 3: -4.0, 4: -2.0}


def test_pipeline_isolates_failures(spark):
    docs = spark.createDataFrame([(1, "let a = 1")], "doc_id int, text string")
    late = lambda d: d.select(F.raise_error(F.lit("lost")).alias("x"))  # noqa: E731  fails when its rows are made
    made = {
        "good": ([], pipeline.ANALYZERS["size"][1]), "bad": ([], lambda d: d.select("missing")), "off": ([], lambda d: d), "late": ([], late),
        "half": ([], lambda d: {"findings": d.select("doc_id"), "cycles": late(d)}), "odd": ([], lambda d: {"nothing": d}),
    }
    facts, status = pipeline.run_pipeline(spark, docs, disabled=("off",), analyzers=made)
    got = {(r.analyzer, r.bucket): r.status.split(":")[0] for r in status.collect()}
    assert got == {("good", "metrics"): "ok", ("bad", None): "error", ("off", None): "skipped", ("late", "metrics"): "error", ("half", "findings"): "ok", ("half", "cycles"): "error", ("odd", None): "error"}
    assert facts.count() == 5 and all(r.seconds > 0 for r in status.collect() if r.bucket)
    buckets, _ = pipeline.run_buckets(spark, docs, disabled=("off",), analyzers=made)
    assert set(buckets) == {"metrics", "findings"} and buckets["findings"].count() == 1


def test_yarn_lock_and_scripts(spark):
    html = "<script>a()</script><script src='x'>no</script><SCRIPT lang=\"ts\">b()</SCRIPT><script lang='py'>no</script>"
    assert spark.createDataFrame([(html,)], "html string").select(sources_text.scripts(F.col("html")).alias("s")).first().s == "a()\nb()"


def test_source_files_are_walked(spark, tmp_path):
    from codeloom.sources import files

    for name in ("src/a.ts", "src/b.d.ts", "src/deep/c.vue", "node_modules/x/d.ts", ".git/e.js", "readme.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"// {name}")
    found = {r.relative_path: r.text for r in files.source_files(spark, f"file://{tmp_path}").collect()}
    assert found == {"src/a.ts": "// src/a.ts", "src/deep/c.vue": "// src/deep/c.vue"}
    (tmp_path / "report.json").write_text('noise\n{"issues": [{"file": "a"}]}\nmore')
    assert files.json_report(spark, f"file://{tmp_path}/report.json", "issues array<struct<file:string>>").first().issues[0].file == "a"


def test_values_that_must_match(spark):
    """Inputs that tell each rule from its near misses."""
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    tests = ["src/__tests__", "a/__TESTS__/b", "x.test.ts", "x.spec.mjs", "x.e2e.ts", "x.integration.cts", "e2e/x", "a/integration", "specs/x", "a\\test\\x"]
    others = ["", None, "latest/x.ts", "x.test.json", "contest.ts", "a/e2e-x/b", "x.tests.ts", "respec/x"]
    assert [value(paths.is_test_file(F.lit(p))) for p in tests + others] == [True] * len(tests) + [False] * len(others)
    assert [value(paths.is_source_file(F.lit(p))) for p in ("a.TS", "a.vue", "a.d.ts", "a.D.TSX", "a.d.js", "a.json", "a.mts")] == [True, True, False, False, True, False, False]
    assert [value(files.is_walked(F.lit(p))) for p in ("tmp/a.ts", "a/vendor/b", "a/out/b", "outer/b", ".nuxt/b", "a/.cache/b", "dist.ts")] == [True, True, False, True, False, False, True]
    object_of = lambda t: value(files.first_object(F.lit(t)))
    assert object_of('{"a": 1}\nwarn {x}') == '{"a": 1}' and object_of('x "{"a": "}\\"{"} }') == '{"a": "}\\"{"}' and object_of("none") is None and object_of("{ {}") is None and object_of(None) is None
    members = lambda t: value(sources_text.union_members(F.lit(t)))
    assert [members(t) for t in ("A | (a | (b | (c | (d | (e | f)))))", "", "| A", "'a\\'|b' | C", "`${x | y}` | D", "Map<A | B> | C")] == [2, 0, 1, 2, 2, 2]
    assert value(scalars.pascal_case(F.lit("a.b-c__dE fG"))) == "A.bCDEFG" and value(scalars.rolling_hash(F.lit("\U0001f600"))) == (31 * 0xD83D + 0xDE00) % 2**32
    told = [(value(scalars.format_delta(F.lit(x))), value(scalars.format_percent(F.lit(x)))) for x in (1234.5, -45.25, 3.14159, float("inf"), float("nan"))]
    assert told == [("1235", "1.2k%"), ("-45.3", "-45.3%"), ("3.14", "3.1%"), ("n/a", "new"), ("n/a", "new")]
    assert value(scalars.heat(F.lit(5.0), 0)) == "rgb(34, 197, 94)" and value(scalars.heat(F.lit(15.0), 30)) == "rgb(234, 179, 8)"
    assert value(scalars.scope_map(F.lit('{"a": "peerDependency", "b": "x", "c": 1}'))) == {"a": "peerDependency"}
    assert [value(graphs.kind_priority(F.lit(k))) for k in ("contains", "uses", "extends", "implements", "dependency", "import", "export", None)] == [5, 5, 4, 3, 2, 1, 0, 0]
    assert [value(graphs.coerced_kind(F.lit(k))) for k in ("devDependency", "Import", None)] == ["devDependency", "dependency", "dependency"]
    assert value(F.size(F.regexp_extract_all(F.lit("a1 = 12 + [b.c] \"q\";"), F.lit(sources_text.TOKENS), F.lit(0)))) == 7 and value(sources_text.branch_count(F.lit("a ?? b ? c?.d : e"))) == 2
    names = ["x10", "x9", "X2y20", "x2y3", "é1", "e2", "x00000000000000000000010a"]
    got = [r.n for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(*scalars.natural_order(F.col("n"))).collect()]
    assert got == ["é1", "e2", "x2y3", "X2y20", "x9", "x10", "x00000000000000000000010a"]


def test_cut_vertices_and_components_of_a_larger_graph(spark):
    """Trees hung on cycles, long paths and loops, against removing each vertex in turn."""
    import random

    rnd = random.Random(4)
    pairs = [(k, rnd.randrange(k)) for k in range(1, 60)] + [(100 + k, 100 + (k + 1) % 9) for k in range(9)] + [(100, 200), (200, 201), (201, 202), (5, 5)] + [(300 + k, 301 + k) for k in range(40)]
    pairs += [(rnd.randrange(30), rnd.randrange(30)) for _ in range(25)]
    ids = sorted({x for p in pairs for x in p} | {999})
    nodes, edges = spark.createDataFrame([(x,) for x in ids], "id int"), spark.createDataFrame(pairs, "src int, dst int")

    def groups_of(gone=None):
        up = {x: x for x in ids if x != gone}
        def root(x):
            while up[x] != x:
                x = up[x]
            return x
        for a, b in pairs:
            if gone not in (a, b):
                a, b = root(a), root(b)
                up[max(a, b)] = min(a, b)
        return {x: root(x) for x in up}

    whole = groups_of()
    assert {r.id: r.component for r in graphs.connected(nodes, edges).collect()} == whole
    count = len(set(whole.values()))
    want = {x for x in ids if len(set(groups_of(x).values())) > count}
    assert {r.id for r in blocks.articulation_points(nodes, edges).collect()} == want


def test_running_sums_in_parts(spark):
    rows = [(g, k, (k * 7) % 5) for g, n in (("a", 300), ("b", 3), ("c", 1)) for k in range(n)]
    frame = spark.createDataFrame(rows, "g string, k int, v int")
    want = {(g, k): sum(v for h, j, v in rows if h == g and j < k) for g, k, _ in rows}
    for most in (1000, 10):
        assert {(r.g, r.k): r.before for r in graphs.running(frame, "g", ["k"], F.col("v"), "before", most).collect()} == want


def test_ancestors_of_circles_and_long_chains(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(70)] + [(100, 101), (101, 102), (102, 101)], "id int, parent int")
    got = {(r.id, r.ancestor): r.distance for r in graphs.ancestors(chain).collect()}
    assert got[0, 70] == 70 and got[100, 102] == 2 and len(got) == 70 * 71 // 2 + 2 + 4


def test_function_complexity():
    """Cyclomatic, cognitive, nesting, lines and parameters by hand."""
    from codeloom.operators.complexity import Walk

    told = lambda text: {(f"{r[1]}." if r[1] else "") + r[0]: r[2:] for r in Walk.of(text).run()}
    assert told("function f(a, b) { if (a && b) { for (;;) { x = 1; } } else if (c) { y(); } return a ? 1 : b ? 2 : 3; }") == {"f": (7, 9, 2, 1, 2)}
    assert told("const g = async (x?: number, {y}: O = {}) => {\n while (x) { try { go(); } catch (e) { break outer; } } };") == {"g": (3, 4, 2, 2, 2)}
    assert told("export function h<T>(z: T[]): Map<string, T> { switch (z) { case 1: return 1; case 2: { if (q) r(); } default: return () => { do { t() } while (a || b && c || d) } } }") == {"h": (4, 10, 3, 1, 1)}
    members = """class K<T> extends B {
      readonly f = (a) => a ?? 1;
      get v(): number { return this.n > 1 ? 1 : 2 }
      async load(a: string, b?: Map<string, number>): Promise<{ a: number }> {
        const z = items.map((i) => { if (i) { return 1 } return 2 })
        for await (const q of a) { if (q) continue }
        return { m(p) { while (p) {} }, k: a || b }
      }
    }
    interface J { a(): void; b?: number }
    function last() { return `${a ? 1 : 2}` } // if (x) {}"""
    assert told(members) == {"K.f": (2, 1, 0, 1, 1), "K.v": (2, 1, 1, 1, 0), "K.load": (4, 10, 2, 5, 2), "m": (2, 1, 1, 1, 1), "last": (1, 0, 0, 1, 0)}
    assert told("}}} ) ] function ok() { if (a) b }") == {"ok": (2, 1, 1, 1, 0)} and told("function bad( { if (") == {} and told("(" * 5000) == {} and told("") == {}


def test_rules_and_transforms(spark):
    text = "export class K {\n  private mode: 'a' | 'b' | null = null;\n  other: A | B;\n}\nclass L {\n  mode: 'a' | 'b' | 'c';\n}\n"
    modules = spark.createDataFrame([("m", text)], "id string, text string")
    found = rules.run_rules({"properties": entities.properties(modules)})
    assert sorted((r.entity_name, r.suggestion) for r in found.collect()) == [("mode", "Extract to type alias 'KMode'"), ("mode", "Extract to type alias 'LMode'")]
    asked = found.select(F.lit(text).alias("text"), "action", "context").union(spark.createDataFrame([(text, "odd", "{}"), (text, "extract-type-union", "{}"), (text, None, None)], "text string, action string, context string"))
    got = {(r.action, r.context): r for r in rules.rewrite(asked).collect()}
    assert [r.error for r in got.values() if not r.success] == ["unknown action odd", "the transform does not apply", "unknown action null"]
    made = sorted(r.transformed for r in got.values() if r.success)
    assert made[0] == "export class K {\n  private mode: 'a' | 'b' | null = null;\n  other: A | B;\n}\ntype LMode = 'a' | 'b' | 'c';\nclass L {\n  mode: LMode;\n}\n"
    assert made[1] == "export type KMode = 'a' | 'b' | null;\nexport class K {\n  private mode: KMode = null;\n  other: A | B;\n}\nclass L {\n  mode: 'a' | 'b' | 'c';\n}\n"


def test_adapter_and_command_line(spark, tmp_path):
    from codeloom.__main__ import main
    from codeloom.sources.adapter import FolderAdapter

    spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string").write.parquet(f"{tmp_path}/t.parquet")
    adapter = FolderAdapter(spark, str(tmp_path), ["t"])
    with pytest.raises(RuntimeError):
        adapter.query("SELECT * FROM {t}")
    adapter.init()
    assert adapter.query("SELECT name FROM {t} WHERE id = :id", {"id": 2}).first().name == "b" and adapter.path() == str(tmp_path)

    def failing(frames):
        frames["t"] = frames["t"].filter("id = 1")
        raise KeyError("no")

    with pytest.raises(KeyError):
        adapter.transaction(failing)
    assert adapter.query("SELECT count(*) AS n FROM {t}").first().n == 2
    adapter.transaction(lambda frames: frames.update(t=frames["t"].filter("id = 1")))
    adapter.init()
    assert adapter.query("SELECT count(*) AS n FROM {t}").first().n == 1
    source = tmp_path / "project" / "src"
    source.mkdir(parents=True)
    (source / "a.ts").write_text('import { b } from "./b";\nexport function a(x) { if (x) { return b(x); } }\n')
    (source / "b.ts").write_text('import { a } from "./a";\nexport function b(x) { return a(x); }\n')
    (tmp_path / "project" / "node_modules").mkdir()
    (tmp_path / "project" / "node_modules" / "c.ts").write_text("export const c = 1;\n")
    main(["analyze", str(tmp_path / "project"), "-o", str(tmp_path / "out"), "--disable", "duplication"], spark)
    read = lambda name: spark.read.parquet(f"{tmp_path}/out/{name}.parquet")
    assert {r.relative_path for r in read("modules").collect()} == {"src/a.ts", "src/b.ts"}
    assert {r.id for r in read("cycles").collect()} == {"src/a.ts", "src/b.ts"} and {r.status for r in read("status").collect()} == {"ok", "skipped"}
    assert {(r.module_id, r.name, r.status) for r in read("callEdges").collect()} == {("src/a.ts", "b", "resolved"), ("src/b.ts", "a", "resolved")}
    assert read("metrics").filter("metric_key = 'complexity.cyclomatic' and entity_id = 'src/a.ts:a'").first().metric_value == 2


def test_fetch_cache(spark):
    from codeloom.sources.cache import FetchCache

    now, asked = [0.0], []
    held = FetchCache(300, lambda: now[0])

    def route(n):
        asked.append(n)
        if n == 1:
            raise OSError("gone")
        return spark.range(n)

    first = held.fetch("k", lambda: route(1), lambda: route(2))
    assert first.count() == 2 and held.fetch("k", lambda: route(3)) is first and asked == [1, 2]
    now[0] = 301.0
    assert held.fetch("k", lambda: route(3)).count() == 3
    with pytest.raises(OSError, match="gone"):
        held.fetch("other", lambda: route(1))


def test_overview(spark):
    """Folders a and b, a test, a cycle, a collapsed folder: each step's part is visible in the result."""
    from codeloom.operators import model_graph

    nodes = spark.createDataFrame([("x", "a", False), ("y", "a", False), ("z", "b", False), ("w", "b", False), ("t", "a", True), ("free", None, False)], "id string, folder string, test boolean")
    edges = spark.createDataFrame([("x", "y", "import"), ("y", "x", "import"), ("x", "z", "import"), ("x", "z", "extends"), ("z", "w", "uses"), ("t", "x", "import")], "src string, dst string, kind string")
    shut = spark.createDataFrame([("b",)], "folder string")
    drawn = model_graph.overview_edges(nodes, edges, shut, ("import",), 1)
    got = {(r.src, r.dst): (r.kind, tuple(r.kinds), r.n, r.hidden) for r in drawn.collect()}
    assert got == {
        ("x", "y"): ("import", ("import",), 1, False), ("y", "x"): ("import", ("import",), 1, False),
        ("folder:a", "folder:b"): ("import", ("extends", "import"), 2, False), ("x", "folder:a"): ("import", ("extends", "import"), 2, False),
    }
    found = {r.id: r for r in model_graph.overview_nodes(nodes, edges, drawn, shut).collect()}
    assert set(found) == {"x", "y", "z", "w", "free", "folder:a", "folder:b"}
    assert {k for k, r in found.items() if r.hidden} == {"z", "w"} and {k for k, r in found.items() if r.orphan} == {"z", "w", "free"}
    assert [found[k].layer for k in ("w", "z", "free", "folder:b", "folder:a")] == [0, 1, 0, 0, 1] and found["x"].layer != found["y"].layer
    assert found["folder:a"].weight == max(found["x"].weight, found["y"].weight) > found["z"].weight


def test_union_members_are_counted_once_for_a_filter_too(spark):
    """A filter on the count reads the column: the walk isn't made a second time below it."""
    texts = ["A | 'b|\\'c' | \"d", "'open | x\\", "| `a|\\` | B", "(a | b)) | c", "a => b | c", " | ", "", None, *(f"T{k} | (" + "[x | " * 300 + "y" + "]" * 300 + ") | Z" for k in range(50))]
    made = spark.createDataFrame([(t,) for t in texts], "t string").select("t", sources_text.union_members(F.col("t")).alias("n"))
    assert [r.n for r in made.collect()] == [3, 1, 2, 2, 2, 0, 0, None] + [3] * 50
    large = made.filter("n >= 3")
    assert large.count() == 51
    plan = large._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "lambdafunction" not in plan


def test_split_unions_are_walked_by_one_arrow_function():
    """Long types that all differ: the walk's work grows with the text, and a batch's equal texts are walked once."""
    import pyarrow as pa

    made = [sources_text._members_of(f"T{k} | (a | " + "(b | " * k + ")" * (k + 1) + " | 'x|y'") for k in range(300)]
    assert made == [3] * 300
    walked = sources_text.members_of_all(pa.array(["A | B", None, "A | B", "", "A"]))
    assert walked.to_pylist() == [2, None, 2, 0, 1] and walked.type == pa.int32()


def test_metrics_of_texts_strip_comments_once(spark):
    """Counts of one text are columns of what is left of it, which is made once, and equal those made alone."""
    texts = ["/* a\n b */ let x: any = y as any; // any\nz!.q", "'any' /* any */ <T>b\n\n// c", "", None, "plain words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for name, prefix, counts in (("size", "size", sources_text.sizes), ("type-safety", "typeSafety", sources_text.type_safety)):
        made = pipeline.ANALYZERS[name][1](docs)
        metrics = made["metrics"] if isinstance(made, dict) else made
        alone = docs.select("doc_id", *(v.cast("double").alias(k) for k, v in counts(F.col("text")).items())).collect()
        want = {(str(r.doc_id), f"{prefix}.{k}"): r[k] for r in alone for k in counts(F.col("text"))}
        assert {(r.entity_id, r.metric_key): r.metric_value for r in metrics.collect()} == want
        assert metrics._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1


def test_texts_without_functions_are_not_walked(spark):
    from codeloom.operators import complexity

    given = spark.createDataFrame([("a", "some (plain) words"), ("b", "const f = x => x"), ("c", "function g(a) { if (a) {} }"), ("d", None)], "id string, text string")
    assert sorted((r.module_id, r.name) for r in complexity.functions(given).collect()) == [("b", "f"), ("c", "g")]
    assert "Contains" in complexity.functions(given)._jdf.queryExecution().optimizedPlan().toString()
