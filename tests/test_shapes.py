"""Declarations, members and calls of source text of real shape."""

from codeloom.operators import entities, graphs, resolve, shapes

TEXT = '''import { x } from "class A {";
/** doc of A */
export abstract class A<T extends { a: number }> extends Base<T>.X implements I1, I2<Map<string, number>> { run(): void { go(); } }
class B {
  private count: number = 0;
  readonly name = 'a { b';
  static async load(a: string, { b }: O, c = 1, ...rest: any[]): Promise<Map<string, { k: number }>> {
    const s = `t ${a + fn(`${inner(1)} }`)} class Z {`;
    if (a) { await this.k.load(7); }
    return /[{]class/.test(s) ? new Map(y) : f<string>(x);
  }
  handler = async (e: Event): Promise<void> => { send(e); }
  cb: (a: number) => void;
  get size(): number { return 1 }
  'quoted-name'() {}
  [Symbol.iterator]() { it(); }
  #priv?: string
  constructor(private readonly a: string) { super(a); boot(); }
}
// class C { }
interface J<T> extends P<T>, Q {
  size: number;
  grow(by: number): void
  opt?: { a: string, b: number },
  fn: (x: number) => string;
}
export async function fn1(x: number, { y }: O, z?: T): Promise<{ a: number }> { return inner2(() => { deep(); }) }
function outer() { function hidden(x) { return call(x) } hidden(1); class In { m() {} } }
export type T1<A, B> = { a: A }
  | string;
type Own = 1
export const enum E { A = 1, B, C = 'x,y' }
const arrow = async (q) => q.map(w => trans(w));
top(); const o = { m(a): void { q1(); }, async n() { q2() }, p: () => q3() };
const u = a ? foo() : { b: 1 };
'''


def modules(spark, *texts):
    return spark.createDataFrame([(f"m{k}", t) for k, t in enumerate(texts)], "id string, text string")


def test_declarations(spark):
    given = modules(spark, TEXT, None, "", "class", "}{ class X {", "class A {\n run() {}\n}\nclass B { f(): void { x(); } }")
    found = {(r.module_id, r.name): (r.extends, r.implements) for r in entities.classes(given).collect()}
    assert found == {("m0", "A"): ("Base.X", ["I1", "I2"]), ("m0", "B"): (None, []), ("m0", "In"): (None, []), ("m4", "X"): (None, []), ("m5", "A"): (None, []), ("m5", "B"): (None, [])}
    assert [(r.name, r.extends) for r in entities.interfaces(given).collect()] == [("J", ["P", "Q"])]
    assert [tuple(r) for r in entities.type_aliases(given).collect()] == [("m0", "T1", "{ a: A } | string", '["A","B"]')]
    assert [(r.name, r.members_json) for r in entities.enums(given).collect()] == [("E", '[{"name":"A","value":"1"},{"name":"B"},{"name":"C","value":"\'x,y\'"}]')]
    assert [(r.name, r.is_async, r.n_params, r.return_type, [p.name for p in r.params], r.line) for r in entities.functions(given).collect()] == [("fn1", True, 3, "Promise<{ a: number }>", ["x", "z"], 27)]


def test_members_of_one_line_and_nested_bodies(spark):
    given = modules(spark, TEXT, "class A { run(): void { go(); } }\nclass B {\n  f(a: Map<string, number>, g: (x: A, y: B) => void): void {\n    x();\n  }\n}")
    found = {(r.module_id, r.parent, r.name): (r.parent_type, r.visibility, r.is_async, r.is_static, r.n_params, r.return_type) for r in entities.methods(given).collect()}
    assert found == {
        ("m0", "A", "run"): ("class", "public", False, False, 0, "void"),
        ("m0", "B", "load"): ("class", "public", True, True, 4, "Promise<Map<string, { k: number }>>"),
        ("m0", "B", "handler"): ("class", "public", False, False, 1, None),
        ("m0", "B", "cb"): ("class", "public", False, False, 1, "void"),
        ("m0", "B", "size"): ("class", "public", False, False, 0, "number"),
        ("m0", "B", "quoted-name"): ("class", "public", False, False, 0, None),
        ("m0", "B", "constructor"): ("class", "public", False, False, 1, None),
        ("m0", "J", "grow"): ("interface", "public", False, False, 1, "void"),
        ("m0", "J", "fn"): ("interface", "public", False, False, 1, "string"),
        ("m0", "In", "m"): ("class", "public", False, False, 0, None),
        ("m1", "A", "run"): ("class", "public", False, False, 0, "void"),
        ("m1", "B", "f"): ("class", "public", False, False, 2, "void"),
    }
    found = sorted((r.parent, r.place, r.name, r.visibility, r.type) for r in entities.properties(given).collect())
    assert found == [("B", 0, "count", "private", "number"), ("B", 1, "name", "public", None), ("B", 2, "priv", "public", "string"), ("J", 0, "size", "public", "number"), ("J", 1, "opt", "public", "{ a: string, b: number }")]


def test_calls_with_the_function_around_them(spark):
    sites = {(r.name, r.qualifier): (r.in_kind, r.in_name, r.is_awaited) for r in entities.call_sites(modules(spark, TEXT)).collect()}
    assert sites == {
        ("go", None): ("method", "run", False), ("fn", None): ("method", "load", False), ("inner", None): ("method", "load", False), ("load", "this.k"): ("method", "load", True),
        ("test", "()"): ("method", "load", False), ("f", None): ("method", "load", False), ("send", None): ("closure", "handler", False), ("it", None): (None, None, False),
        ("boot", None): ("method", "constructor", False), ("inner2", None): ("function", "fn1", False), ("deep", None): ("closure", None, False), ("call", None): ("function", "hidden", False),
        ("hidden", None): ("function", "outer", False), ("map", "q"): ("closure", "arrow", False), ("trans", None): ("closure", None, False), ("top", None): (None, None, False),
        ("q1", None): ("closure", "m", False), ("q2", None): ("closure", "n", False), ("q3", None): ("closure", "p", False), ("foo", None): (None, None, False),
    }


def test_call_edges(spark):
    given = modules(
        spark,
        'import { ext } from "pkg";\nexport function a() { b(); ext(); ext(); this.m(); }\nexport async function dup() { b(); }\nclass K { m() { await a(); dup(); none(); x.m(); } twice() {} }\nclass L { twice() { a(); } n = () => { a(); } }',
        "export function dup() { }\nexport function b() { b(); }\na();",
    )
    named = lambda df, *parts: df.selectExpr(f"concat_ws('.', module_id, {', '.join(parts)}) AS id", "module_id", "name")
    found = resolve.call_edges(given, named(entities.functions(given), "name"), named(entities.methods(given), "parent", "name"))
    got = sorted((r.source_id, r.source_type, r.name, r.line, r.is_awaited, r.is_async, r.status, r.target_id) for r in found.collect())
    assert got == [
        ("m0.K.m", "method", "a", 4, True, True, "resolved", "m0.a"),
        ("m0.K.m", "method", "dup", 4, False, False, "ambiguous", None),
        ("m0.K.m", "method", "m", 4, False, False, "resolved", "m0.K.m"),
        ("m0.K.m", "method", "none", 4, False, False, "unresolved", None),
        ("m0.L.n", "method", "a", 5, False, False, "resolved", "m0.a"),
        ("m0.a", "function", "b", 2, False, False, "resolved", "m1.b"),
        ("m0.a", "function", "ext", 2, False, False, "external", None),
        ("m0.a", "function", "m", 2, False, False, "resolved", "m0.K.m"),
        ("m0.dup", "function", "b", 3, False, True, "resolved", "m1.b"),
        ("m1.b", "function", "b", 2, False, False, "resolved", "m1.b"),
    ]


def test_innermost(spark):
    around = spark.createDataFrame([("m", 0, 100, "a"), ("m", 10, 50, "b"), ("m", 10, 20, "c"), ("m", 60, 70, "d"), ("n", 5, 9, "e")], "module_id string, begin long, stop long, name string")
    asked = spark.createDataFrame([(m, k) for m in "mno" for k in (0, 5, 9, 10, 20, 50, 60, 69, 70, 100)], "module_id string, begin long")
    got = {(r.module_id, r.begin): r.in_name for r in shapes.innermost(asked, around, ["name"]).collect()}
    spans = {"m": [(0, 100, "a"), (10, 50, "b"), (10, 20, "c"), (60, 70, "d")], "n": [(5, 9, "e")], "o": []}
    assert got == {(m, k): next((x for a, z, x in reversed(spans[m]) if a <= k < z), None) for m in "mno" for k in (0, 5, 9, 10, 20, 50, 60, 69, 70, 100)}


def test_long_texts_are_scanned_in_linear_time():
    """Many lines of one expression, many arrows, deep brackets, an open quote."""
    for text in ("const a = [\n" + "  f(1),\n" * 20_000 + "];", "x => y => z;\n" * 20_000, "(" * 20_000 + ")" * 20_000, "class A {\n" + "  m(): void { go(); }\n" * 20_000 + "}", "'" + "a" * 100_000, "`${" * 5_000, "/" * 50_000, "<" * 5_000):
        assert sum(1 for _ in shapes.Source(text).shapes()) >= 0


def scans(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")


def test_calls_are_scanned_and_placed_once(spark):
    """Functions, methods and calls share a scan, however often their joins need them."""
    given = modules(spark, TEXT, "export function go() { deep(); }")
    shared = graphs.settled(entities.scanned(given, *entities.CALLING))
    named = lambda df, *parts: df.selectExpr(f"concat_ws('.', module_id, {', '.join(parts)}) AS id", "module_id", "name")
    sides = lambda x: (named(entities.functions(x), "name"), named(entities.methods(x), "parent", "name"))
    one, each = resolve.call_edges(given, *sides(shared), shared), resolve.call_edges(given, *sides(given))
    assert scans(one) == 0 and sorted(map(str, one.collect())) == sorted(map(str, each.collect())) != []
    assert scans(resolve.call_graph(given, *sides(shared))) == 1


def test_members_are_scanned_once(spark):
    given = modules(spark, TEXT)
    assert [scans(f(given)) for f in (entities.properties, entities.methods, entities.implicit_any, entities.call_sites)] == [1] * 4


def test_some_kinds_are_those_of_all(spark):
    """A scan for some kinds gives them as the scan for all does; texts without their marks are left out."""
    given = modules(spark, TEXT, "plain words, and (some) more", "const f = x => x", "type T = 1", None, "")
    whole = [tuple(r) for r in shapes.shapes(given).collect()]
    assert {r[1] for r in whole} == shapes.KINDS
    for kinds in (*((k,) for k in shapes.KINDS), ("class", "property"), entities.CALLING):
        assert [tuple(r) for r in shapes.shapes(given, *kinds).collect()] == [r for r in whole if r[1] in kinds]


def test_module_parse_scans_once(spark):
    from codeloom.plans import registry

    assert scans(registry.queries()["src10_module_parse"](spark, "/root/testdata/sf0.001")) == 1
