"""Sessions of users whose events come late, as a changelog of versions.

Events come in batches. After each batch a user's events so far form sessions:
neighbours in time that lie at most `gap` apart share one. A session that holds
an event of the batch is a new version, and retracts the standing sessions that
went into it.

Events are first summed up by user, batch and cell of time. A cell is no longer
than the gap, so all its events are in one session, and a user's rows in a batch
are as many as the cells that the batch can reach, however many events the user
has. The sums of each batch lie in a folder of their own. One streaming query
with arbitrary state by user reads the folders in order, a batch at a time: each
is put in its place whole, by a rename, once the one before has been committed.
The state holds a user's standing sessions, without those that no event can
reach any more. What the query gives out is the changelog, versions and
retractions; a join by the retracted version's key then fills in who retracted it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from codeloom.llm import shared

GAP = 240
#: Seconds of a batch, and the batches that an event comes late at most.
BATCH, LATENESS = 1800, 3

CELL = "user long, batch long, start_s long, end_s long, n long, h long"
STATE = "batch array<bigint>, start_s array<bigint>, end_s array<bigint>, n array<bigint>, h array<bigint>"
VERSION = "user long, batch long, start_s long, end_s long, n_events long, n_new long, n_retracted long, h_sum long"
#: A version (retracts is 0), or what a version of this batch and start retracts; then the other numbers are 0.
CHANGE = f"{VERSION}, retracts long, old_batch long, old_start_s long"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def events_of(conversations: DataFrame) -> DataFrame:
    """user, batch, at_s and h of the turns of conversations; rows without turn or conv_id are no events."""
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    told = conversations.select(conv.alias("conv_id"), turn.alias("turn")).filter("conv_id is not null and turn is not null")
    text = F.col("conv_id").cast("string")
    hashed = told.withColumn("c", F.crc32(text)).withColumn("h", F.crc32(F.concat_ws(":", text, F.col("turn").cast("string")))).withColumn("g", F.expr("h div 600"))
    at = hashed.withColumn("user", F.expr("2 * ((conv_id - pmod(conv_id, 8)) div 8) + c % 2")).withColumn("at_s", F.expr("(c div 2) % 7200 + 300 * turn + h % 600"))
    return at.select("user", F.expr(f"(at_s - pmod(at_s, {BATCH})) div {BATCH} + if(g % 5 = 0, g % 4, 0)").alias("batch"), "at_s", "h")


def cells_of(events: DataFrame, gap: int = GAP) -> DataFrame:
    """CELL: the events of a user in a batch that lie in one stretch of time as long as the gap."""
    cell = F.expr(f"(at_s - pmod(at_s, {gap})) div {gap}")
    by = events.groupBy("user", "batch", cell.alias("cell"))
    return by.agg(F.min("at_s").alias("start_s"), F.max("at_s").alias("end_s"), F.count("*").alias("n"), F.sum("h").alias("h")).drop("cell")


def advance(standing: list[tuple], cells: list[tuple], gap: int) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """Sessions after one batch, its new versions, and what they retract.

    standing: (start, end, batch, n, h) of sessions more than the gap apart;
    cells: the batch's, alike. A version is (start, end, n, n_new, n_retracted, h),
    a retraction (start of the version, batch and start of the retracted one).
    """
    batch = cells[0][2]
    after, versions, gone = [], [], []
    group: list[tuple] = []

    def close() -> None:
        new = [x for x in group if x[2] == batch]
        if not new:
            after.extend(group)
            return
        old = [x for x in group if x[2] != batch]
        start, end = group[0][0], max(x[1] for x in group)
        n, h = sum(x[3] for x in group), sum(x[4] for x in group)
        versions.append((start, end, n, sum(x[3] for x in new), len(old), h))
        gone.extend((start, x[2], x[0]) for x in old)
        after.append((start, end, batch, n, h))

    reach = 0
    for x in sorted(standing + cells):
        if group and x[0] - reach > gap:
            close()
            group = []
        reach = max(reach, x[1]) if group else x[1]
        group.append(x)
    close()
    return after, versions, gone


def _of_user(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, gap: int, open_from: tuple[int, int] | None) -> Iterator[pd.DataFrame]:
    """The changes that a user's new cells make, batch by batch if several have come at once."""
    held = state.getOption
    standing = list(zip(*(held[k] for k in (1, 2, 0, 3, 4)), strict=True)) if held else []
    new: dict[int, list[tuple]] = {}
    for frame in frames:
        for row in frame[["start_s", "end_s", "batch", "n", "h"]].to_numpy().tolist():
            new.setdefault(row[2], []).append(tuple(row))
    out = []
    for batch in sorted(new):
        standing, versions, gone = advance(standing, new[batch], gap)
        out += [(key[0], batch, *v, 0, 0, 0) for v in versions]
        out += [(key[0], batch, start, 0, 0, 0, 0, 0, 1, *old) for start, *old in gone]
        if open_from:
            length, late = open_from
            standing = [x for x in standing if x[1] + gap >= (batch + 1 - late) * length]
    if standing:
        start, end, batches, n, h = (list(x) for x in zip(*standing, strict=True))
        state.update((batches, start, end, n, h))
    elif held:
        state.remove()
    yield pd.DataFrame(out, columns=_names(CHANGE), dtype="int64")


def changelog(cells: DataFrame, gap: int = GAP, open_from: tuple[int, int] | None = None) -> DataFrame:
    """CHANGE: every version and every retraction, as the stream gives them out.

    open_from: seconds of a batch and batches that an event comes late at most,
    if events keep to that; sessions that no event can reach leave the state.
    """
    spark = cells.sparkSession
    shared.ready_workers(spark)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = f"{shared.shared_folder(spark)}/codeloom-sessions-{uuid.uuid4().hex}"
    shared.own_folder(spark, root)
    staged = cells.withColumn("arrival", F.col("batch")).hint("rebalance", "arrival")
    staged.select("arrival", *_names(CELL)).write.partitionBy("arrival").parquet(f"{root}/staged")
    at = hadoop.Path(f"{root}/staged")
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # As many as there are batches of time, whatever the number of events.
    arrivals = sorted(int(x.getPath().getName().partition("=")[2]) for x in files.listStatus(at) if x.isDirectory() and "=" in x.getPath().getName())
    files.mkdirs(hadoop.Path(f"{root}/arrived"))
    stream = spark.readStream.schema(CELL).parquet(f"{root}/arrived/*")
    changes = stream.groupBy("user").applyInPandasWithState(partial(_of_user, gap=gap, open_from=open_from), CHANGE, STATE, "append", "NoTimeout")
    if not arrivals:
        return spark.createDataFrame([], CHANGE)
    query = changes.writeStream.format("parquet").outputMode("append").option("path", f"{root}/changes").option("checkpointLocation", f"{root}/checkpoint").start()
    try:
        for k, arrival in enumerate(arrivals):
            if not files.rename(hadoop.Path(f"{root}/staged/arrival={arrival}"), hadoop.Path(f"{root}/arrived/{k:06d}")):
                raise OSError(f"batch {arrival} could not be put in its place")
            query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.schema(CHANGE).parquet(f"{root}/changes")


def versions(changes: DataFrame) -> DataFrame:
    """Every version with the batch and start of the one that retracted it, null for those that stand at the end."""
    made = changes.filter("retracts = 0").select(*_names(VERSION))
    by = changes.filter("retracts = 1").select("user", F.col("batch").alias("retracted_batch"), F.col("start_s").alias("retracted_start_s"), F.col("old_batch").alias("batch"), F.col("old_start_s").alias("start_s"))
    return made.join(by, ["user", "batch", "start_s"], "left").select(*made.columns, "retracted_batch", "retracted_start_s")


def merged(events: DataFrame, gap: int = GAP, open_from: tuple[int, int] | None = None) -> DataFrame:
    """Every version of every session of events (user, batch, at_s, h): VERSION, retracted_batch and retracted_start_s.

    n_retracted tells a creation (0), an extension (1) and a merge (more).
    Events without user, batch or time are left out; equal events count one by
    one, those of one moment share a session. No events give no rows. Other
    columns, whatever their names, are left out.
    """
    known = events.select("user", "batch", "at_s", "h").filter("user is not null and batch is not null and at_s is not null")
    return versions(changelog(cells_of(known, gap), gap, open_from))


def of_conversations(conversations: DataFrame) -> DataFrame:
    return merged(events_of(conversations), GAP, (BATCH, LATENESS))
