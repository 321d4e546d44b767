"""How filters interact: what each of them removes in every order in which they can be applied.

Each filter is evaluated once for each document and leaves a bit in its mask.
Four of them look at one text only. The fifth marks copies, and finds them by
refining a partition: rows are split by the length of their texts, then by the
hash of one block of the text after the other (each eight times as long as the
one before), and a class of one row is dropped as soon as it appears. The
hashes are taken in one pass over the texts, so a round moves some numbers for
each row that is left. The texts of the classes that remain are compared in
full, and rows that aren't of the smallest doc_id of their text are marked.

Masks are counted for each part before anything else is done with them; a part
has 32 of them at most, and all orders, steps and shares follow from these
counts without another look at the documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm import shared

#: The filters by name; a document fails filter k if its mask has bit 1 << k.
FILTERS = "ABCDE"
#: Code points of the first block; each block after it is GROWTH times as long.
FIRST_BLOCK, GROWTH = 64, 8
SPACES = r"[\x20\x09-\x0D]+"


def text_mask(text: Column) -> Column:
    """Bits of the filters that look at one text: few words, few distinct words, many capitals, marks."""
    words = F.array_remove(F.split(text, SPACES), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    rules = n < 200, 100 * distinct < 50 * n, 100 * capitals.cast("long") > 2 * F.length(text), text.rlike("[#$%&*|]")
    mask = F.lit(0)
    for k, rule in enumerate(rules):
        mask = mask.bitwiseOR(F.when(rule, F.lit(1 << k)).otherwise(F.lit(0)))
    return mask


def _blocks() -> list[tuple[int, int]]:
    """Start and length of the blocks that cover a text of any length that a string can have."""
    found, start, length = [], 0, FIRST_BLOCK
    while start < 1 << 31:
        found.append((start, length))
        start, length = start + length, length * GROWTH
    return found


BLOCKS = _blocks()


def block_hashes(text: Column) -> Column:
    """A hash of each block of text, null beyond its end."""
    size = F.length(text)
    return F.array(*(F.when(size > start, F.xxhash64(F.substring(text, start + 1, min(length, (1 << 31) - 1)))) for start, length in BLOCKS))


def _key(blocks: int = len(BLOCKS)) -> Column:
    """The class of a row (n_chars, hashes) once so many blocks are looked at."""
    return F.xxhash64("n_chars", F.slice("hashes", 1, blocks))


def refined(rows: DataFrame) -> DataFrame:
    """final, the keys of the classes of two rows or more when all blocks have split them; rows: n_chars, hashes.

    A class is ready when its length is covered; only the others go into the
    next round. Keys that are equal by chance keep a class too many.
    """
    left, ready, covered = rows.select("n_chars", "hashes"), [], 0
    for k in range(len(BLOCKS) + 1):
        keyed = left.withColumn("key", _key(k))
        again = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
        left = shared.written(keyed.join(again, "key", "left_semi").drop("key"), "refined")
        ready.append(left.filter(F.col("n_chars") <= covered).select(_key().alias("final")).distinct())
        left = left.filter(F.col("n_chars") > covered)
        if left.isEmpty():
            break
        covered = sum(BLOCKS[k])
    return shared.written(reduce(DataFrame.union, ready), "ready")


def copies(docs: DataFrame, rows: DataFrame, hashes: Callable[[Column], Column] = block_hashes) -> DataFrame:
    """final (a class's key), text (null where it is the class's only one) and least doc_id of the texts in classes of several rows.

    hashes: how a text's blocks are hashed. Classes are compared text by text,
    so a hash that says too little costs time and changes no result.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.length(text).alias("n_chars"), hashes(text).alias("hashes")).select("doc_id", "text", _key().alias("final"))
    # Grouped by text, not by class: the join then stays free to split a large class, and each task gives out a text once.
    held = keyed.join(refined(rows), "final", "left_semi").groupBy("text").agg(F.min("doc_id").alias("least"), F.first("final").alias("final"))
    texts = shared.written(held, "texts")
    of = texts.groupBy("final").agg(F.count("*").alias("n"), F.min("least").alias("least"))
    alone = of.filter("n = 1").select("final", F.lit(None).cast("string").alias("text"), "least")
    return alone.union(texts.join(of.filter("n > 1").select("final"), "final", "left_semi").select("final", "text", "least"))


def masks(docs: DataFrame, hashes: Callable[[Column], Column] = block_hashes) -> DataFrame:
    """doc_id, part and mask of every row of docs.

    A null text is empty. A row is a copy if a smaller doc_id holds its text;
    a null doc_id is no copy and makes none, and rows of one doc_id are no
    copies of each other. A null source is the part of the empty string.
    """
    text = F.coalesce("text", F.lit(""))
    plain = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    taken = plain.select("doc_id", "part", "text", text_mask(F.col("text")).alias("mask"), F.length("text").alias("n_chars"), hashes(F.col("text")).alias("hashes"))
    rows = shared.written(taken.drop("text"), "masks")
    found = shared.written(copies(docs, rows, hashes), "copies")
    bit = F.lit(1 << FILTERS.index("E"))
    mask = F.col("mask").bitwiseOR(F.when(F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)), bit).otherwise(F.lit(0))).alias("mask")
    marked = rows.select("doc_id", "part", "mask", _key().alias("final")).join(found.filter("text is null").drop("text"), "final", "left")
    several = found.filter("text is not null")
    if several.isEmpty():
        return marked.select("doc_id", "part", mask)
    # Where hashes agree and texts don't, rows are told apart by their texts.
    told = taken.withColumn("final", _key()).join(several, ["final", "text"]).select("doc_id", "part", mask)
    return marked.join(several.select("final").distinct(), "final", "left_anti").select("doc_id", "part", mask).union(told)


def counted(marked: DataFrame, labels: DataFrame) -> DataFrame:
    """part and counts: for each mask of the part the documents with it, those labelled good and those labelled toxic.

    Several labels of one doc_id count as one, which is good or toxic if any of
    them is.
    """
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    told = labels.groupBy("doc_id").agg(flag("quality"), flag("toxic"))
    known = marked.join(told, "doc_id", "left")
    each = known.groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("quality"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    return each.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))


def interactions(docs: DataFrame, labels: DataFrame, hashes: Callable[[Column], Column] = block_hashes) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley.

    A row for each source of docs, each order of FILTERS and each step of it.
    removed: documents that the step's filter is the first of the order to
    reject; redundant: those that it rejects after another did; unique_fails:
    those that no other filter rejects; good_lost, toxic_lost: labelled ones
    among the removed; shapley: what the filter removes, summed over all orders.
    Empty docs give no rows, empty labels zeros. Repeated rows count one by one.
    Columns beside doc_id, text and source are left out, whatever their names.
    See `masks` and `counted` for nulls and repeated ids.
    """
    steps = []
    for order in permutations(range(len(FILTERS))):
        name = "".join(FILTERS[k] for k in order)
        before = 0
        for step, k in enumerate(order, 1):
            steps.append((name, step, 1 << k, before))
            before |= 1 << k
    spark = docs.sparkSession
    every = spark.createDataFrame(steps, "filter_order string, step int, own int, before int")
    table = every.agg(F.collect_list(F.struct("filter_order", "step", "own", "before")).alias("steps"))
    # One row, the same for every input, stands beside each part.
    parts = counted(masks(docs, hashes), labels).join(F.broadcast(table))
    each = parts.select("part", "counts", F.explode("steps").alias("s")).select("part", "counts", "s.*")

    def total(name: str, holds) -> Column:
        amount = lambda acc, c: acc + F.when(holds(c["mask"]), c[name]).otherwise(F.lit(0))
        return F.aggregate("counts", F.lit(0).cast("long"), amount)

    own, before = F.col("own"), F.col("before")
    fails = lambda m: m.bitwiseAND(own) != 0
    passed = lambda m: m.bitwiseAND(before) == 0
    removed = lambda m: fails(m) & passed(m)
    # Of all orders, a filter comes first among the b that reject a document in one of b.
    orders = F.lit(len(steps) // len(FILTERS))
    share = F.aggregate("counts", F.lit(0).cast("long"), lambda acc, c: acc + F.when(fails(c["mask"]), c["n"] * (orders / F.bit_count(c["mask"])).cast("long")).otherwise(F.lit(0)))
    return each.select(
        "part", "filter_order", "step",
        total("n", lambda m: m.bitwiseAND(before.bitwiseOR(own)) == 0).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", lambda m: fails(m) & ~passed(m)).alias("redundant"),
        total("n", lambda m: m == own).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        share.alias("shapley"),
    )
