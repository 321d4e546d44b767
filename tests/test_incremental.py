"""The import graph after random edits equals that of a full run, and only what the edits touch is done again."""

import random

import pytest

from codeloom.operators import incremental, resolve, sources_text
from codeloom.sources.versions import VersionedTables

SCHEMA = "id string, relative_path string, seq long, text string"


def text_of(rnd):
    names = rnd.sample(["a", "b", "c/d", "c/e", "f/index", "g", "h"], rnd.randint(0, 3))
    return "\n".join(f"import {{ x }} from '{rnd.choice(['./', '@/', 'src/', '../src/'])}{n}';" for n in names) + rnd.choice(["", "\nimport y from 'pkg';", "\n// note"])


def full(spark, frame):
    imports = sources_text.imports(frame).select("module_id", "source").distinct().join(frame.selectExpr("id AS module_id", "relative_path AS from_path"), "module_id")
    return {(r.src, r.dst) for r in resolve.import_edges(imports, frame).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_edits(spark, tmp_path, seed):
    rnd = random.Random(seed)
    places = ["src/a.ts", "src/b.tsx", "src/c/d.ts", "src/c/e/index.ts", "src/f/index.ts", "src/g.js", "src/h.ts", "lib/a.ts", "src/a/index.ts", "src/b.ts"]
    modules = {f"m{k}": (p, k, text_of(rnd)) for k, p in enumerate(places)}
    store = VersionedTables(spark, f"file://{tmp_path}/s")
    for turn in range(4):
        frame = spark.createDataFrame([(k, *v) for k, v in modules.items()], SCHEMA)
        done = incremental.refresh(store, frame)
        assert {(r.src, r.dst) for r in done.edges.collect()} == full(spark, frame)
        before = dict(modules)
        if turn:
            assert {r.id for r in done.parsed.collect()} == edited
        for k in rnd.sample(sorted(modules), 2):
            path, seq, _ = modules[k]
            modules[k] = rnd.choice([(path, seq, text_of(rnd)), (rnd.choice(places), seq, modules[k][2]), (path, seq + 50, modules[k][2])])
        modules.pop(rnd.choice(sorted(modules)))
        modules[f"n{turn}"] = (rnd.choice(places), 100 + turn, None if turn == 1 else text_of(rnd))
        edited = {k for k, v in modules.items() if k not in before or (before[k][0], before[k][2]) != (v[0], v[2])}


def test_nothing_is_done_again_without_an_edit(spark, tmp_path):
    rows = [("a", "src/a.ts", 1, "import x from './b';"), ("b", "src/b.ts", 2, "import y from './c';"), ("d", "src/d.ts", 3, "")]
    store = VersionedTables(spark, f"file://{tmp_path}/s")
    incremental.refresh(store, spark.createDataFrame(rows, SCHEMA))
    again = incremental.refresh(store, spark.createDataFrame(rows, SCHEMA))
    assert again.parsed.count() == again.resolved.count() == 0 and again.edges.collect() == [("a", "b")]
    # A module that comes to a path makes those that mean it resolve again, without being parsed.
    more = incremental.refresh(store, spark.createDataFrame([*rows, ("c", "src/c.ts", 4, "")], SCHEMA))
    assert {r.id for r in more.parsed.collect()} == {"c"} and {r.src for r in more.resolved.collect()} == {"b"}
    assert {(r.src, r.dst) for r in more.edges.collect()} == {("a", "b"), ("b", "c")}
    assert incremental.refresh(store, spark.createDataFrame([], SCHEMA)).edges.count() == 0
