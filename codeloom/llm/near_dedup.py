"""MinHash near-dedup with an LSH forest.

A text's set of word shingles gets one signature of TREES * DEPTH minimum
hashes. Each tree of the forest is a sorted order of all signatures, read from
another start: rows are dealt by ranges of that order and sorted, and the values
that a row has in common with its neighbour, from the start on, are its longest
common prefix. Rows that share DEPTH values with a neighbour are candidates; a
region is a stretch of the order in which all do. DEPTH is the floor: for two
texts of similarity 0.85 the chance that no tree brings them into one region is
(1 - 0.85**5)**32, below 1e-8; for 0.8 it is 3e-6.

A region of up to REGION texts is compared as it is. A more crowded one takes a
depth of its own: where a stretch is too long it is cut at the shortest common
prefixes, one value deeper each time, down to DEEP values more, so the closest
texts stay together and are linked first. Then the texts that are outside the
region's largest group meet all of the region, block against block, so the floor
holds in crowds too; two texts inside are joined already. No candidates are left
out at any size, and no task holds more than two blocks.

Within a region the candidates' signatures are compared and a spanning forest
of likely links is given out, never all pairs. Those forests' components hold
every true link (a likely link lies six deviations below the threshold), so it
is enough to compare the full sets within each component: one task takes one
component, and gives out a spanning forest of the true links. A component too
large for a task is dealt to blocks and compared block against block, as crowded
regions are, so every pair of it is confirmed, refuted or joined already. The
components of the true links are the result.

Copies with equal sets are one node throughout, so they cost nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm import shared

TREES, DEPTH = 32, 5
#: Values beyond DEPTH that the order of a tree tells apart, a byte of each.
DEEP = 15
#: Texts of a region that are compared in one block.
REGION = 2000
#: Shingles that are compared in one task, all texts of a component together.
UNIT_SHINGLES = 1_000_000
#: Shingles that are hashed at a time, so that they stay in the processor's cache.
BLOCK = 1 << 15


@lru_cache(maxsize=1)
def _factors() -> np.ndarray:
    """Odd 32-bit factors, one for each value of a signature; made by rule."""
    x = shared.mixed(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (x >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def shingle_sets(text: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of each text's set (one more than texts), and the sets: sorted 64-bit hashes of the distinct shingles.

    A-Z count as a-z. A text of fewer than `size` words has them all as its one
    shingle; one without words has none.
    """
    offsets, codes, distinct = shared.words(pc.ascii_lower(pc.fill_null(text, "")))
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct.cast(pa.binary()).to_pylist()), np.uint64, len(distinct))[codes]
    n = len(hashes)
    counts = np.diff(offsets)
    #: Number k is the shingle that begins at word k; of the last size - 1 words of a text only a short text's first counts.
    found = np.zeros(n, np.uint64)
    length = np.minimum(np.repeat(counts, counts), size)
    place = np.arange(n) - np.repeat(offsets[:-1], counts)
    with np.errstate(over="ignore"):
        for step in range(size):
            inside = step < length
            following = np.zeros(n, np.uint64)
            following[: n - step] = hashes[step:]
            found = np.where(inside, shared.mixed(found * np.uint64(0x100000001B3) + following + np.uint64(step + 1)), found)
    valid = place <= np.repeat(counts, counts) - length
    text_of = np.repeat(np.arange(len(counts)), counts)[valid]
    found = found[valid]
    ends = np.searchsorted(text_of, np.arange(len(counts) + 1))
    parts = [np.unique(found[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    out = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])
    return out, np.concatenate(parts) if parts else found


def signatures(offsets: np.ndarray, found: np.ndarray) -> np.ndarray:
    """A row of TREES * DEPTH minimum hashes for each set that isn't empty, in their order."""
    sizes = np.diff(offsets)
    full = np.flatnonzero(sizes)
    out = np.empty((len(full), TREES * DEPTH), np.uint32)
    x = (found >> np.uint64(32)).astype(np.uint32)
    starts = offsets[:-1][full]
    stops = offsets[1:][full]
    begin = 0
    while begin < len(full):
        end = max(begin + 1, int(np.searchsorted(stops, starts[begin] + BLOCK, side="right")))
        part, at = x[starts[begin] : stops[end - 1]], starts[begin:end] - starts[begin]
        for k, factor in enumerate(_factors()):
            out[begin:end, k] = np.minimum.reduceat(part * factor, at)
        begin = end
    return out


def _sign(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_shingles", "set_a", "set_b", "signature"]
    for batch in shared.slices(batches, size=shared.SLICE_BYTES // 2):
        offsets, found = shingle_sets(batch.column("text"), size)
        n = np.diff(offsets)
        a, b = (shared.sums(shared.mixed(found ^ np.uint64(k)), offsets).astype(np.int64) for k in (0x243F6A8885A308D3, 0x13198A2E03707344))
        rows = iter(signatures(offsets, found))
        signed = pa.array([next(rows).tobytes() if x else None for x in n], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(a), pa.array(b), signed], names)


def _matrix(part: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint32).reshape(part.num_rows, TREES * DEPTH)


def _turn(tree: int) -> np.ndarray:
    """The order in which a tree reads a signature's values."""
    return np.roll(np.arange(TREES * DEPTH), -tree * DEPTH)


def _low_bytes(values: np.ndarray) -> np.ndarray:
    """A byte for each value, which equal values share."""
    return np.ascontiguousarray(((values * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8))


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.shape[1]), len(rows), [None, pa.py_buffer(rows)]).cast(pa.binary())


def _keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's place in every tree's order: group, the tree and its first DEPTH values, then deep, the values after these."""
    for batch in batches:
        for part in (batch.slice(k, 4_000) for k in range(0, batch.num_rows, 4_000)):
            whole = _matrix(part)
            for tree in range(TREES):
                turn = _turn(tree)
                key = np.full(part.num_rows, tree + 1, np.uint64)
                with np.errstate(over="ignore"):
                    for k in turn[:DEPTH]:
                        key = shared.mixed(key * np.uint64(0x9E3779B97F4A7C15) + whole[:, k])
                group = (key >> np.uint64(TREES.bit_length())) | np.uint64(tree << (64 - TREES.bit_length()))
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(group.view(np.int64)), _binary(_low_bytes(whole[:, turn[DEPTH : DEPTH + DEEP]]))], ["node", "group", "deep"])


def _stretches(deep: np.ndarray, most: int) -> np.ndarray:
    """A number for each row of one region in order: stretches of up to `most` rows, cut at the shortest common prefixes."""
    n = len(deep)
    same = deep[1:] == deep[:-1]
    prefix = np.concatenate([[-1], np.where(same.all(axis=1), DEEP, np.argmin(same, axis=1))]) if n > 1 else np.full(n, -1)
    begins = prefix < 0
    for depth in range(1, DEEP + 1):
        number = np.cumsum(begins) - 1
        long = np.bincount(number)[number] > most
        if not long.any():
            break
        begins |= long & (prefix < depth)
    number = np.cumsum(begins) - 1
    # Rows that all these values don't tell apart are cut as they stand.
    starts = np.flatnonzero(begins)
    begins |= (np.arange(n) - starts[number]) % most == 0
    return np.cumsum(begins) - 1


def _neighbours(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The rows with a neighbour in their region, and stretch, the first node of their stretch of it; from a range of the trees' orders.

    The first and the last region of the range may go on outside it, and come
    whole, whatever they hold here.
    """
    names = ["node", "group", "stretch"]

    def given(node: np.ndarray, group: np.ndarray, stretch: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(group), pa.array(stretch)], names)

    held, first = None, True
    for table in _whole_groups(batches, "group"):
        table = table.combine_chunks()
        node, group = np.asarray(table["node"]), np.asarray(table["group"])
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        sizes = np.diff(np.append(starts, len(group)))
        stretch = np.repeat(node[starts], sizes)
        for a, n in zip(starts[sizes > most].tolist(), sizes[sizes > most].tolist(), strict=True):
            deep = np.frombuffer(b"".join(table["deep"].slice(a, n).to_pylist()), np.uint8).reshape(n, DEEP)
            number = _stretches(deep, most)
            stretch[a : a + n] = node[a : a + n][np.flatnonzero(np.diff(number, prepend=-1))[number]]
        held = None
        keep = np.repeat(sizes > 1, sizes)
        if first:
            keep[: sizes[0]] = True
            first = False
        # A last region of one row waits: it goes if another table follows.
        if sizes[-1] == 1 and not keep[-1]:
            held = node[-1:], group[-1:], stretch[-1:]
        yield given(node[keep], group[keep], stretch[keep])
    if held is not None:
        yield given(*held)


def _small(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with a small form of the signature, a byte for each value."""
    for batch in batches:
        for part in (batch.slice(k, 4_000) for k in range(0, batch.num_rows, 4_000)):
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("node", "unit", "asked", "closed")), _binary(_low_bytes(_matrix(part)))], ["node", "unit", "asked", "closed", "small"])


def _whole_groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches sorted by key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.asarray(batch.column(key))
        changes = np.flatnonzero(keys[1:] != keys[:-1])
        last = int(changes[-1]) + 1 if len(changes) else 0
        if held and np.asarray(held[-1].column(key))[-1] != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)
    shared.give_back()


class _Forest:
    """Joins numbers into trees; tells which links join anything."""

    def __init__(self, n: int) -> None:
        self.up, self.size = list(range(n)), [1] * n

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        self.size[min(a, b)] += self.size[max(a, b)]
        return True


def _spanning(n: int, near: Callable[[int, np.ndarray], np.ndarray], asked: np.ndarray | None = None, closed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links of n rows; near(k, rows) tells which of the rows row k is linked with.

    asked: rows whose links with all rows count; closed: rows known to be
    joined. A row that has come into the main tree (that of the closed rows, or
    the first that grows large) isn't asked: a link of its that leads out of the
    tree is found when the other end is.
    """
    forest, out = _Forest(n), []
    main = -1
    for k in np.flatnonzero(closed).tolist() if closed is not None else []:
        main = k if main < 0 else main
        forest.join(main, k)
    left = np.ones(n, bool)  # rows that have not been asked
    for k in np.flatnonzero(asked).tolist() if asked is not None else range(n):
        if main >= 0 and forest.root(k) == forest.root(main):
            continue
        left[k] = False
        for other in near(k, np.flatnonzero(left)).tolist():
            if forest.join(k, other):
                out.append((k, other))
        if main < 0 and 8 * forest.size[forest.root(k)] >= n:
            main = k
    found = np.array(out, np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def _least_equal(threshold: float) -> int:
    """Equal values of a signature that a pair at the threshold has at least, but for a chance of about 1e-9."""
    n = TREES * DEPTH
    return int(n * threshold - 6 * (n * threshold * (1 - threshold)) ** 0.5)


def _likely(batches: Iterable[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Forests of the likely links within units, from rows in order of unit."""
    width = TREES * DEPTH
    for table in _whole_groups(batches, "unit"):
        table = table.combine_chunks()
        keys, nodes, asked, closed = (np.asarray(table[c]) for c in ("unit", "node", "asked", "closed"))
        signed = np.frombuffer(b"".join(table["small"].to_pylist()), np.uint8).reshape(-1, width)
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        stops = np.append(starts[1:], len(keys))
        two = starts[stops - starts == 2]
        near = two[(signed[two] == signed[two + 1]).sum(axis=1) >= least]
        a, b = [nodes[near]], [nodes[near + 1]]
        for start, stop in zip(starts, stops, strict=True):
            if stop - start > 2:
                x, y = _forest_of(signed[start:stop], least, asked[start:stop], closed[start:stop])
                a.append(nodes[start + x])
                b.append(nodes[start + y])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def _forest_of(signed: np.ndarray, least: int, asked: np.ndarray | None = None, closed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of rows with so many equal values."""
    return _spanning(len(signed), lambda k, rows: rows[(signed[rows] == signed[k]).sum(axis=1) >= least], asked, closed)


def _true(batches: Iterable[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Forests of the true links within units, from rows in order of unit."""
    for table in _whole_groups(batches, "unit"):
        table = table.combine_chunks()
        keys, nodes, asked, closed = (np.asarray(table[c]) for c in ("unit", "node", "asked", "closed"))
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for start, stop in zip(starts, np.append(starts[1:], len(keys)), strict=True):
            if stop - start > 1:
                x, y = linked(table["text"].slice(start, stop - start).combine_chunks(), size, percent, asked[start:stop], closed[start:stop])
                a.append(nodes[start + x])
                b.append(nodes[start + y])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def linked(text: pa.Array, size: int, percent: int, asked: np.ndarray | None = None, closed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of texts with 100 * intersection >= percent * union, from their full sets."""
    text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
    offsets, found = shingle_sets(text, size)
    sizes = np.diff(offsets)
    values, number = np.unique(found, return_inverse=True)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(number, kind="stable")
    holders, bounds = owner[order], np.concatenate([[0], np.cumsum(np.bincount(number, minlength=len(values)))])

    def near(k: int, rows: np.ndarray) -> np.ndarray:
        mine = number[offsets[k] : offsets[k + 1]]
        lengths = bounds[mine + 1] - bounds[mine]
        mine, lengths = mine[lengths > 1], lengths[lengths > 1]
        if not len(mine):
            return rows[:0]
        where = np.repeat(bounds[mine] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        common = np.bincount(holders[where], minlength=len(sizes))[rows]
        return rows[(common > 0) & (100 * common >= percent * (sizes[k] + sizes[rows] - common))]

    return _spanning(len(sizes), near, asked, closed)


def _regions(signed: DataFrame) -> DataFrame:
    """group (the region), node, stretch, n, held and first of the texts that share a region of a tree."""
    kind = signed.schema["node"].dataType.simpleString()
    keyed = shared.written(signed.select("node", "signature").mapInArrow(_keys, f"node {kind}, group long, deep binary"), "keys")
    order = keyed.repartitionByRange("group", "deep").sortWithinPartitions("group", "deep", "node")
    near = shared.written(order.mapInArrow(partial(_neighbours, most=REGION), f"node {kind}, group long, stretch {kind}"), "neighbours")
    shared.drop_written(keyed)
    # What few regions lie across two ranges is put together here.
    several = near.groupBy("group").agg(F.count("*").alias("held"), F.min("node").alias("first")).filter("held > 1")
    regions = shared.written(near.join(several, "group").select("group", "node", "stretch", F.lit(1).cast("long").alias("n"), "held", "first"), "regions")
    shared.drop_written(near)
    return regions


def _in_order(regions: DataFrame) -> DataFrame:
    """Units of a first pass: each region, or each stretch of a crowded one, with the region's first node in each."""
    whole = F.col("held") <= REGION
    name = F.concat_ws("-", F.col("group").cast("string"), F.col("stretch").cast("string"))
    own = regions.filter(whole | (F.col("node") != F.col("first"))).select("node", F.when(whole, F.col("group").cast("string")).otherwise(name).alias("unit"))
    stretches = regions.filter(~whole).groupBy("group", "stretch").agg(F.min("first").alias("node")).select("node", name.alias("unit"))
    return own.union(stretches).select("node", "unit", F.lit(True).alias("asked"), F.lit(False).alias("closed"))


def _block(blocks: Column) -> Column:
    """The block of a group's so many to which a node is dealt."""
    return F.pmod(F.xxhash64("group", "node"), blocks)


def _blocks(held: str, most: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.col(held) / most)).cast("long")


def _dealt(members: DataFrame, most: int) -> DataFrame:
    """Units of a first pass: each group in blocks that hold about `most` of its n, its first node in each."""
    blocks = _blocks("held", most)
    own = F.when(F.col("node") == F.col("first"), F.sequence(F.lit(0).cast("long"), blocks - 1)).otherwise(F.array(_block(blocks)))
    block = members.withColumn("blocks", blocks).withColumn("block", F.explode(own))
    unit = F.when(F.col("blocks") == 1, F.col("group").cast("string")).otherwise(F.concat_ws("-", F.col("group").cast("string"), F.col("block").cast("string")))
    return block.select("node", unit.alias("unit"), F.lit(True).alias("asked"), F.lit(False).alias("closed"))


def _against(members: DataFrame, reached: DataFrame, most: int) -> DataFrame:
    """Units of a second pass: the nodes outside a group's largest component, in blocks, each with every block of the group.

    reached: the components of the first pass's links.
    """
    label = F.coalesce("component", "node").alias("label")
    told = shared.written(members.join(reached.withColumnRenamed("id", "node"), "node", "left").select("group", "node", "n", "held", label), "told")
    by = told.groupBy("group", "label").agg(F.sum("n").alias("n"))
    tops = by.groupBy("group").agg(F.max_by("label", F.struct("n", "label")).alias("top"), (F.sum("n") - F.max("n")).alias("outside")).filter("outside > 0")
    each = told.join(tops, "group").withColumn("closed", F.col("label") == F.col("top"))
    down, across = _blocks("outside", most), _blocks("held", most)
    zero = F.lit(0).cast("long")
    asking = each.filter("not closed").withColumn("across", F.explode(F.sequence(zero, across - 1))).withColumn("down", _block(down)).withColumn("asked", F.lit(True))
    others = each.withColumn("down", F.explode(F.sequence(zero, down - 1))).withColumn("across", _block(across)).withColumn("asked", F.lit(False))
    others = others.filter(F.col("closed") | (F.col("down") != _block(down)))
    unit = F.concat_ws("-", F.col("group").cast("string"), F.col("down").cast("string"), F.col("across").cast("string"))
    return asking.unionByName(others).select("node", unit.alias("unit"), "asked", "closed")


def _groups(signed: DataFrame, percent: int) -> DataFrame:
    """node and group of the texts with a likely link: the components of these links."""
    kind = signed.schema["node"].dataType.simpleString()

    def links(units: DataFrame) -> DataFrame:
        small = units.join(signed.select("node", "signature"), "node").mapInArrow(_small, f"node {kind}, unit string, asked boolean, closed boolean, small binary")
        ordered = small.repartition("unit").sortWithinPartitions("unit")
        return ordered.mapInArrow(partial(_likely, least=_least_equal(percent / 100)), f"a {kind}, b {kind}")

    regions = _regions(signed)
    reached = shared.components(links(_in_order(regions)), "likely")
    crowded = regions.filter(F.col("held") > REGION)
    if not crowded.isEmpty():
        more = shared.written(links(_against(crowded, reached, REGION)), "more")
        reached = shared.components(reached.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more), "likely")
    groups = shared.written(reached.select(F.col("id").alias("node"), F.col("component").alias("group")), "groups")
    for done in (regions, reached):
        shared.drop_written(done)
    return groups


def near_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    size: words in a shingle; percent: documents are linked if 100 *
    intersection >= percent * union of their sets. component_id is the smallest
    doc_id that links reach, kept says whether it is the row's own. A text
    without words, or null, has an empty set and is linked with nothing. Rows of
    one doc_id are one document, whatever their texts, in one component. A row with a null doc_id
    joins its copies (equal sets) only; without any its component_id is null and
    it is kept. Other columns, whatever their names, are left out; an empty
    table gives an empty table.
    """
    shared.ready_workers(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = shared.written(
        docs.select("doc_id", "text").mapInArrow(partial(_sign, size=size), f"doc_id {kind}, n_shingles long, set_a long, set_b long, signature binary"), "signatures"
    )
    # Copies with equal sets are one node, named by the smallest doc_id.
    key = ["n_shingles", "set_a", "set_b"]
    classes = rows.filter("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("node"), F.first("signature").alias("signature"))
    classes = shared.written(classes, "classes")
    signed = classes.filter("node is not null")

    groups = _groups(signed, percent)
    sized = groups.join(signed.groupBy("node").agg(F.sum("n_shingles").alias("n")), "node")
    weights = sized.groupBy("group").agg(F.sum("n").alias("held"), F.min("node").alias("first"))
    members = shared.written(sized.join(weights, "group"), "members")
    large = F.col("held") > UNIT_SHINGLES

    def links(units: DataFrame) -> DataFrame:
        # Merged at every size: this side is small only in small corpora.
        texts = docs.select(F.col("doc_id").alias("node"), "text").join(units.hint("merge"), "node").repartition("unit").sortWithinPartitions("unit")
        return texts.select("unit", "node", "asked", "closed", "text").mapInArrow(partial(_true, size=size, percent=percent), f"a {kind}, b {kind}")

    # Half a unit to a block, as two meet in a task.
    whole = members.filter(~large).select("node", F.col("group").cast("string").alias("unit"), F.lit(True).alias("asked"), F.lit(False).alias("closed"))
    split = members.filter(large)
    if split.isEmpty():
        reached = shared.components(links(whole), "linked")
    else:
        parts = _dealt(split, UNIT_SHINGLES // 2)
        reached = shared.components(links(whole.union(parts)), "linked")
        more = shared.written(links(_against(split, reached, UNIT_SHINGLES // 2)), "more")
        reached = shared.components(reached.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more), "linked")
    reached = reached.select(F.col("id").alias("node"), "component")

    named = classes.drop("signature").join(reached, "node", "left").select(*key, F.coalesce("component", "node").alias("component"))
    of = rows.drop("signature").join(named, key, "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component"))
    found = of.select("doc_id", "n_shingles", component.alias("component_id"))
    repeated = rows.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if not repeated.isEmpty():
        found = _joined_ids(shared.written(found, "found"), repeated)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def _joined_ids(found: DataFrame, repeated: DataFrame) -> DataFrame:
    """found with the components of all rows of one doc_id made one, for the doc_ids that are repeated."""
    again = found.join(repeated, "doc_id").select("doc_id", F.col("component_id").alias("a"))
    least = again.groupBy("doc_id").agg(F.min("a").alias("b"))
    merged = shared.components(again.join(least, "doc_id").select("a", "b"), "repeated")
    merged = merged.select(F.col("id").alias("component_id"), F.col("component").alias("merged"))
    return found.join(merged, "component_id", "left").select("doc_id", "n_shingles", F.coalesce("merged", "component_id").alias("component_id"))


def distinct_documents(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay, one document of each group, with all their columns, whatever their names."""
    found = shared.written(near_components(docs, size, percent).select("doc_id", "kept"), "near")
    own = f"{shared.unused_prefix(docs)}gone"
    gone = found.filter("not kept").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(gone, docs["doc_id"] == gone[own], "left_anti")
