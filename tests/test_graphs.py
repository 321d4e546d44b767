"""Communities, blocks and lifted edges: small shapes with known results, and random graphs against brute force."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from codeloom.operators import blocks, graphs


def frames(spark, pairs, ids=()):
    ids = sorted({x for p in pairs for x in p} | set(ids))
    return spark.createDataFrame([(x,) for x in ids], "id int"), spark.createDataFrame(pairs, "src int, dst int")


def found(spark, pairs, ids=(), **more):
    return {r.id: r.label for r in graphs.label_propagation(*frames(spark, pairs, ids), **more).collect()}


def neighbours(pairs):
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    return near


def visited(pairs, ids, rounds=10):
    """Labels of sweeps that visit one vertex after the other; then the parts that hang together."""
    near = neighbours(pairs)
    label = {x: x for x in ids}
    for _ in range(rounds):
        before = dict(label)
        for v in sorted(near, key=lambda x: (hashlib.md5(str(x).encode()).hexdigest(), x)):
            votes = Counter(label[w] for w in near[v])
            label[v] = min(votes, key=lambda x: (-votes[x], x))
        if label == before:
            break
    out = {}
    for v in sorted(ids):
        if v not in out:
            out[v], stack = v, [v]
            while stack:
                x = stack.pop()
                for y in near.get(x, ()):
                    if y not in out and label[y] == label[v]:
                        out[y] = v
                        stack.append(y)
    return out


@pytest.mark.parametrize("pairs", [[(1, 2)], [(1, 2), (2, 1)], [(9, k) for k in range(8)], [(1, 2), (2, 3), (3, 4), (4, 1)], [(k, k + 1) for k in range(6)], [(1, 2), (2, 3)]])
def test_pairs_stars_squares_and_paths_are_one_community(spark, pairs):
    assert len(set(found(spark, pairs).values())) == 1


def test_communities_of_random_graphs(spark):
    rnd = random.Random(8)
    for n, m in ((40, 80), (60, 70)):
        pairs = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)]
        got = found(spark, pairs, range(n))
        assert got == visited(pairs, range(n))
        near = neighbours(pairs)
        for label in set(got.values()):
            seen, stack = {label}, [label]
            while stack:
                for y in near.get(stack.pop(), ()):
                    if got[y] == label and y not in seen:
                        seen.add(y)
                        stack.append(y)
            assert seen == {x for x, c in got.items() if c == label}
    assert found(spark, [(1, 2)], [5], rounds=0) == {1: 1, 2: 2, 5: 5}


def test_blocks_of_random_graphs(spark):
    def split(pairs, gone=None):
        near, seen, n = neighbours(pairs), set(), 0
        for s in near:
            if s not in seen and s != gone:
                n += 1
                stack = [s]
                seen.add(s)
                while stack:
                    for y in near[stack.pop()]:
                        if y != gone and y not in seen:
                            seen.add(y)
                            stack.append(y)
        return n

    rnd = random.Random(3)
    for n, m in ((9, 9), (40, 52)):
        pairs = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)]
        near = neighbours(pairs)
        want = {v for v in near if split(pairs, v) > split(pairs)}
        assert {r.id for r in blocks.articulation_points(*frames(spark, pairs)).collect()} == want
    chain = [(k, k + 1) for k in range(90)]
    assert {r.id for r in blocks.articulation_points(*frames(spark, chain)).collect()} == set(range(1, 90))
    assert blocks.articulation_points(*frames(spark, [(1, 1)])).count() == 0


def test_edges_without_a_kind_are_lifted_once(spark):
    edges = spark.createDataFrame([(1, 2, None), (1, 2, "import"), (1, 3, None)], "src int, dst int, kind string")
    folders = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id int, folder string")
    got = sorted((r.src, r.dst, r.kind or "", r.role, r.n) for r in graphs.lift(edges, folders).collect())
    both = [("1", "folder:a", "source_stub"), ("folder:a", "folder:b", "trunk"), ("folder:b", "2", "target_stub")]
    assert got == sorted([(a, b, k, role, 1) for a, b, role in both for k in ("", "import")] + [("1", "3", "", "edge", 1)])


def test_layers_of_a_circle_are_an_error(spark):
    nodes, edges = frames(spark, [(1, 2), (2, 3), (3, 2)])
    for walk in (graphs.layers, graphs.weighted_depth):
        with pytest.raises(ValueError, match="cycle"):
            walk(nodes, edges)


def ordered(pairs, layer):
    """Places by the rule, one layer after the other in lists."""
    near = neighbours(pairs)
    rows = {k: sorted(x for x in layer if layer[x] == k) for k in set(layer.values())}
    place = {x: k for r in rows.values() for k, x in enumerate(r, 1)}
    for turn in range(4):
        new = {}
        for k, r in rows.items():
            def mean(x, k=k):
                side = [y for y in near.get(x, ()) if (layer[y] > k if turn % 2 else layer[y] < k)]
                w = [1 / abs(layer[y] - k) for y in side]
                return round(sum(a * place[y] for a, y in zip(w, side, strict=True)) / sum(w), 9) if side else place[x]
            rows[k] = sorted(r, key=lambda x: (mean(x), x))
            new |= {x: j for j, x in enumerate(rows[k], 1)}
        place = new
    for r in rows.values():
        degree = {x: len(near.get(x, ())) for x in r}
        if len(r) > 2 and sum(degree.values()) and max(degree.values()) * len(r) >= 2 * sum(degree.values()):
            middle = (len(r) - 1) // 2
            for i, x in enumerate(sorted(r, key=lambda x: (-degree[x], place[x]))):
                place[x] = middle + (i % 2 * 2 - 1) * -(-i // 2) + 1
    return place


def test_order_within_layers(spark):
    """A hub goes to the middle of its layer; other layers keep the order of means."""
    hub = [(k, 100) for k in range(9)] + [(0, 101), (1, 102), (2, 103), (3, 104), (200, 0), (201, 8)]
    rnd = random.Random(6)
    layer = {k: rnd.randrange(5) for k in range(40)}
    mixed = [(a, b) for a, b in ((rnd.randrange(40), rnd.randrange(40)) for _ in range(90)) if layer[a] != layer[b]]
    for pairs, layers in ((hub, {x: 1 if x < 10 else 0 if x < 200 else 2 for p in hub for x in p}), (mixed, layer)):
        edges = spark.createDataFrame(pairs, "src int, dst int")
        placed = spark.createDataFrame(list(layers.items()), "id int, layer int")
        assert {r.id: r.place for r in graphs.order_layers(placed, edges).collect()} == ordered(pairs, layers)
    assert ordered(hub, {x: 1 if x < 10 else 0 if x < 200 else 2 for p in hub for x in p})[100] == 3


def test_traces_of_asked_vertices(spark):
    """A long chain: only what is asked has a path, and paths are whole."""
    chain = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(300, None), (400, 290)], "id int, next int")
    got = {}
    for r in graphs.traces(chain, spark.createDataFrame([(3,), (299,), (300,), (400,), (3,)], "id int")).collect():
        got.setdefault(r.id, {})[r.place] = r.step
    want = {3: list(range(3, 301)), 299: [299, 300], 300: [300], 400: [400, *range(290, 301)]}
    assert got == {k: dict(enumerate(v)) for k, v in want.items()}
    few = spark.createDataFrame([(1, 2), (2, None), (3, 2)], "id int, next int")
    assert sorted((r.id, r.place, r.step) for r in graphs.traces(few).collect()) == [(1, 0, 1), (1, 1, 2), (2, 0, 2), (3, 0, 3), (3, 1, 2)]


def test_what_lies_below_and_outermost(spark):
    rnd = random.Random(9)
    parents = [(k, rnd.randrange(k) if k % 20 else None) for k in range(1, 120)] + [(500, 501), (501, 502), (502, 500)]
    up = dict(parents)
    frame = spark.createDataFrame(parents, "id int, parent int")
    marked = rnd.sample(range(120), 25)

    def above(x):
        out = []
        while (x := up.get(x)) is not None and x not in out and len(out) < 500:
            out.append(x)
        return out

    got = {r.id: r.to for r in graphs.outermost(frame, spark.createDataFrame([(k,) for k in marked], "id int")).collect()}
    assert got == {x: [a for a in above(x) if a in marked][-1] for x, _ in parents if x < 500 and any(a in marked for a in above(x))}
    for top in (1, 20, 40, 501):
        found = {r.id for r in graphs.below(frame, spark.createDataFrame([(top,)], "id int")).collect()}
        assert found == {top} | {x for x, _ in parents if top in above(x)}
