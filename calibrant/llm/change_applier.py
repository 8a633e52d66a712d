"""Sequenced changes: numbered rows that arrive out of order are applied in order, by a timing wheel in stream state.

Clients' numbers are dealt in segments to buckets, the keys of the stream's state. A bucket's wheel maps an expiry day to
the segments whose earliest held row expires then; a batch's tick visits the due slots alone, jumps what it finds there and
puts it into the slot of its new earliest day. A client of up to SEGMENT numbers is one segment, and its bucket moves its
pointer. A longer client's segments lie in many buckets: each reports how far its own run reaches, a job of two aggregates
between the batches makes these the client's pointer, and the next batch brings it to every segment.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from calibrant.llm.common import shared_path, stored

#: Numbers of a client that one bucket holds at most; rows a bucket, and the least number of buckets.
SEGMENT, BUCKET_ROWS, LEAST_BUCKETS = 1_024, 50_000, 48
NEVER, FOREVER = -(1 << 62), 1 << 62

#: What the stream reads. kind: row, tick (one a bucket and batch) or pointer (one a segment of a long client). upto is the
#: largest day of earlier batches, then that with this batch's; reach and start are a long client's pointer at the end of
#: the batch before and after this batch's jumps.
FEED = "bucket int, kind string, batch int, upto bigint, then bigint, client string, seg bigint, split boolean, n bigint, day bigint, at bigint, id string, payload string, again boolean, reach bigint, start bigint"
#: What it writes. kind: row, or report: of a long client's segment the end of the run from the pointer (or from the
#: segment's first number), the largest due number and the end of its run.
EVENTS = "kind string, client string, seg bigint, split boolean, n bigint, id string, payload string, status string, batch int, run bigint, due bigint, due_run bigint"
_EVENT = [c.split(" ")[0] for c in EVENTS.split(", ")]
_FEED = [c.split(" ")[0] for c in FEED.split(", ")]


@dataclass
class Held:
    """A segment's pointer, what it holds by number, (day, id, payload), and the wheel's slot that it is in."""

    next: int
    rows: dict[int, tuple[int, str | None, str]] = field(default_factory=dict)
    slot: int = NEVER

    def earliest(self) -> int:
        return min(day for day, _, _ in self.rows.values())

    def run_from(self, n: int) -> int:
        """The end of the run of held numbers from n on; n - 1 if n isn't held."""
        while n in self.rows:
            n += 1
        return n - 1


@dataclass
class Bucket:
    """A bucket's state: its segments, and the wheel, from expiry day to the segments whose earliest row expires then.

    A segment stays in a slot that it has left; whoever visits the slot finds nothing due and passes on. Memory: the
    bucket's state and its rows of a batch; how many buckets there are follows the number of rows."""

    lateness: int
    size: int
    held: dict[tuple[str, int], Held] = field(default_factory=dict)
    wheel: dict[int, set[tuple[str, int]]] = field(default_factory=dict)

    def segment(self, name: tuple[str, int]) -> Held:
        if name not in self.held:
            self.held[name] = Held(name[1] * self.size + 1)
        return self.held[name]

    def schedule(self, name: tuple[str, int]) -> None:
        """Put the segment into the slot of its earliest day."""
        own = self.held[name]
        slot = own.earliest() + self.lateness if own.rows else NEVER
        if slot not in (NEVER, own.slot):
            self.wheel.setdefault(slot, set()).add(name)
        own.slot = slot

    def apply(self, name: tuple[str, int], split: bool, until: int, batch: int) -> Iterator[tuple]:
        """Apply what the segment holds below until, in order, and move its pointer there."""
        own = self.held[name]
        for n in sorted(n for n in own.rows if n < until):
            _, id, payload = own.rows.pop(n)
            yield "row", *name, split, n, id, payload, "applied", batch, 0, 0, 0
        own.next = max(own.next, until)

    def tick(self, batch: int, upto: int) -> Iterator[tuple]:
        """Visit the slots that are due: jump their segments for as long as these hold a due row."""
        for slot in sorted(slot for slot in self.wheel if slot <= upto):
            for name in sorted(self.wheel.pop(slot)):
                own = self.held[name]
                while own.rows and own.earliest() + self.lateness <= upto:
                    yield from self.apply(name, False, own.run_from(min(own.rows)) + 1, batch)
                self.schedule(name)

    def take(self, name: tuple[str, int], split: bool, n: int, day: int, id: str | None, payload: str, batch: int) -> Iterator[tuple]:
        """Hold or reject a row; a short client's pointer moves on at once."""
        own = self.segment(name)
        if n < own.next or n in own.rows:
            yield "row", *name, split, n, id, None, "rejected", batch, 0, 0, 0
            return
        own.rows[n] = (day, id, payload)
        if n == own.next and not split:
            yield from self.apply(name, False, own.run_from(n) + 1, batch)

    def report(self, name: tuple[str, int], batch: int, then: int) -> tuple:
        own, last = self.held[name], (name[1] + 1) * self.size
        run = own.run_from(own.next) if own.next <= last else last
        due = max((n for n, (day, _, _) in own.rows.items() if day + self.lateness <= then), default=0)
        return "report", *name, True, 0, None, None, None, batch, run, due, own.run_from(due) if due else 0

    def turn(self, rows: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        """A batch's events of this bucket."""
        pointers, arrived, batch, upto, then = [], [], 0, NEVER, NEVER
        for part in rows:
            for r in zip(*[part[c].tolist() for c in _FEED]):
                r = dict(zip(_FEED, r))
                name = (r["client"], r["seg"])
                batch, upto, then = r["batch"], r["upto"], r["then"]  # the same in all rows of a batch
                if r["kind"] == "pointer":
                    pointers.append((name, r["reach"], r["start"]))
                elif r["kind"] == "row" and r["again"]:
                    yield "row", *name, r["split"], r["n"], r["id"], None, "rejected", batch, 0, 0, 0
                elif r["kind"] == "row":
                    arrived.append((name, r["day"], r["at"], r["payload"], r["id"], r["n"], r["split"]))
        yield from self.tick(batch, upto)
        for name, reach, start in pointers:
            self.segment(name)
            yield from self.apply(name, True, reach, batch - 1)
            yield from self.apply(name, True, start, batch)
        touched = set()
        for name, day, _, payload, id, n, split in sorted(arrived, key=lambda x: x[:4]):
            yield from self.take(name, split, n, day, id, payload, batch)
            if not split:
                touched.add(name)
        for name in touched:
            self.schedule(name)
        for name, _, _ in pointers:
            yield self.report(name, batch, then)


def _turned(lateness: int, size: int):
    """The state function of applyInPandasWithState: a bucket's state is kept as two columns."""

    def update(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bucket = Bucket(lateness, size, *map(pickle.loads, state.get)) if state.exists else Bucket(lateness, size)
        events = bucket.turn(rows)
        while made := list(islice(events, 20_000)):
            yield pd.DataFrame(made, columns=_EVENT)
        state.update((pickle.dumps(bucket.held), pickle.dumps(bucket.wheel)))

    return update


def numbered(rows: DataFrame, client: str, seq: str) -> DataFrame:
    """(client, seq, n, total): each client's different seqs with their dense ranks and their number, null lowest.

    Pairs are sorted into ranges; a range counts each of its clients from 1, and starts where the client's pairs in
    earlier ranges end, so that no client's pairs have to meet in one task."""
    pairs = rows.groupBy(client, seq).agg(F.count("*").alias("c")).drop("c")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(pairs.repartitionByRange(parts, F.col(client), F.col(seq)).withColumn("__range", F.spark_partition_id()), "change-pairs")
    counts = ranged.groupBy("__range", client).agg(F.count("*").alias("c"))
    of_client = Window.partitionBy(client)
    starts = counts.select("__range", F.col(client).alias("__of"), (F.sum("c").over(of_client.orderBy("__range")) - F.col("c")).alias("before"), F.sum("c").over(of_client).alias("total"))
    place = F.row_number().over(Window.partitionBy("__range", client).orderBy(F.col(seq).asc_nulls_first()))
    return (
        ranged.withColumn("place", place)
        .withColumnRenamed("__range", "__r")
        .join(starts, (F.col("__r") == F.col("__range")) & F.col(client).eqNullSafe(F.col("__of")))
        .select(client, seq, (F.col("place") + F.col("before")).alias("n"), "total")
    )


def _bucket(client: Column, seg: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(client, seg), F.lit(buckets)).cast("int")


def _pointers(reports: DataFrame, before: DataFrame | None) -> DataFrame:
    """(client, reach, start) of long clients from their segments' reports, by aggregates that combine before the shuffle.

    reach is where the run from the pointer ends: a run that fills a segment goes on in the next one, so it ends in the
    first segment, from the pointer's on, that isn't full. start is one past the run of the largest due number."""
    here = reports if before is None else reports.join(before.select("client", F.col("start").alias("p")), "client")
    here = here.withColumn("p", F.lit(1).cast("bigint") if before is None else F.col("p"))
    ends = F.when((F.col("last") >= F.col("p")) & (F.col("run") < F.col("last")), F.col("run") + 1)
    whole = F.max("last") + 1
    top = here.groupBy("client").agg(F.coalesce(F.min(ends), whole).alias("reach"), F.max(F.struct("due", "due_run", "last")).alias("top"), whole.alias("whole"))
    top = top.select("client", "reach", "whole", F.col("top.due").alias("l"), F.col("top.due_run").alias("f"), F.col("top.last").alias("l_last"))
    later = here.select("client", "run", F.col("last").alias("seg_last")).join(top, "client")
    past = F.when((F.col("seg_last") > F.col("l_last")) & (F.col("run") < F.col("seg_last")), F.col("run") + 1)
    run_end = later.groupBy("client").agg(*[F.max(c).alias(c) for c in ("reach", "l", "f", "l_last", "whole")], F.min(past).alias("past"))
    jumped = F.when(F.col("l") == 0, F.lit(0)).when(F.col("f") < F.col("l_last"), F.col("f") + 1).otherwise(F.coalesce("past", "whole"))
    return run_end.select("client", "reach", F.greatest("reach", jumped).alias("start"))


def _streamed(spark: SparkSession, base: str, lateness: int, segment: int) -> None:
    """One start of the query: it takes the files that are new, in one micro-batch, and ends."""
    feed = spark.readStream.schema(FEED).option("maxFilesPerTrigger", (1 << 31) - 1).parquet(f"{base}/in")
    events = feed.groupBy("bucket").applyInPandasWithState(_turned(lateness, segment), EVENTS, "held binary, wheel binary", "append", GroupStateTimeout.NoTimeout)
    query = events.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def apply_changes(
    changes: DataFrame, day: Column, batch: Column, where: Column, batches: int, id: str = "change_id", client: str = "client_id", seq: str = "seq", op: str = "op", values: tuple[str, ...] = ("city", "balance"), lateness: int = 8, segment: int = SEGMENT, buckets: int | None = None
) -> DataFrame:
    """id, client, n, status, batch, missed, values and current of every different row of changes for which where holds.

    n is seq's dense rank in its client, over all different rows (null lowest), before where is asked. Batches 1 to
    `batches` (`batch` says whose a row is, by columns of changes; below 1 is 1) are fed to a stateful stream in order,
    which is started anew for each. In a client's batch, rows in order of day, id and content are held, or rejected if
    their n is held or below the pointer; a held n at the pointer is applied and moves it on. At a batch's start, as long
    as a client's earliest held day is `lateness` days or more before the largest day of earlier batches, the pointer
    jumps to the smallest held n. After the last batch all that is held is applied so, as batch `batches` + 1.

    values after an applied row: I sets them, U those that aren't null, D makes them null, any other op leaves them. missed
    is how many numbers were jumped right before the row. current is true for a client's last applied row, unless that is a
    D. Rejected rows have no values. A null client is a client, a null id sorts first; a null day doesn't pass where.
    Equal rows count once; rows of one id that differ are rows of their own. A table without rows gives none. Columns that
    aren't named aren't read but to tell rows apart. Any one client, seq or batch may hold any share of the rows: a client's numbers
    are dealt to buckets by segments, and of rows of one batch and n only the first goes to the state of that n; the
    others are rejected by any bucket. The feed, the state and the events lie in a new shared folder.
    """
    spark = changes.sparkSession
    base = shared_path(spark, "changes")
    columns = {id: "__id", client: "__client", seq: "__seq", op: "__op", **{v: f"__v_{v}" for v in values}}
    rows = changes.distinct().select(*[changes[c].alias(a) for c, a in columns.items()], day.cast("bigint").alias("__day"), F.least(F.greatest(batch, F.lit(1)), F.lit(batches)).cast("int").alias("__batch"), (where & day.isNotNull()).alias("__live"))
    rows = stored(rows, "change-rows")
    buckets = buckets or max(LEAST_BUCKETS, rows.count() // BUCKET_ROWS)
    named = F.coalesce(F.concat(F.lit("="), F.col("__client").cast("string")), F.lit(""))
    ranked = numbered(rows, "__client", "__seq").select(named.alias("r_client"), F.col("__seq").alias("r_seq"), "n", "total")
    live = rows.where("__live").withColumn("client", named)
    firsts = live.groupBy("client", "__seq", "__batch").agg(F.min(F.struct("__day", F.col("__id").alias("at"))).alias("first"))
    marks = firsts.join(ranked, (F.col("client") == F.col("r_client")) & F.col("__seq").eqNullSafe(F.col("r_seq"))).select(F.col("client").alias("m_client"), F.col("__seq").alias("m_seq"), F.col("__batch").alias("m_batch"), "first", "n", "total")
    seg = F.floor((F.col("n") - 1) / segment).cast("bigint")
    again = (F.col("__day") != F.col("first.__day")) | ~F.col("__id").eqNullSafe(F.col("first.at"))
    fed = live.join(marks, (F.col("client") == F.col("m_client")) & F.col("__seq").eqNullSafe(F.col("m_seq")) & (F.col("__batch") == F.col("m_batch")))
    payload = F.to_json(F.struct(F.col("__op").alias("op"), *[F.col(f"__v_{v}").alias(v) for v in values]))
    fed = fed.select("client", seg.alias("seg"), (F.col("total") > segment).alias("split"), "n", F.col("__day").alias("day"), F.coalesce(F.col("__id").cast("bigint"), F.lit(NEVER)).alias("at"), F.col("__id").cast("string").alias("id"), payload.alias("payload"), again.alias("again"), F.col("__batch").alias("batch"), "total")
    fed = fed.withColumn("bucket", F.when(F.col("again"), F.pmod(F.xxhash64("id", "payload", "day"), F.lit(buckets)).cast("int")).otherwise(_bucket(F.col("client"), F.col("seg"), buckets)))
    staged = stored(fed, "change-batches", partition_by=["batch"])
    largest = {r["batch"]: r["day"] for r in staged.groupBy("batch").agg(F.max("day").alias("day")).collect()}  # a row a batch
    longest = staged.where("split").select("client", "total").distinct()
    segments = stored(longest.select("client", F.explode(F.sequence(F.lit(0), F.floor((F.col("total") - 1) / segment).cast("bigint"))).alias("seg")).withColumn("last", F.least((F.col("seg") + 1) * segment, F.lit(FOREVER))), "change-segments")
    some_long = not segments.isEmpty()

    shape = spark.createDataFrame([], FEED).schema
    filled = lambda df: df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in shape])
    pointers, upto = None, NEVER
    for b in range(1, batches + 2):
        then = max(upto, largest.get(b, NEVER)) if b <= batches else FOREVER
        now = {"batch": F.lit(b), "upto": F.lit(upto if b <= batches else FOREVER), "then": F.lit(then if b < batches else FOREVER)}
        zero = {c: F.lit(0) for c in ("seg", "n", "day", "at", "reach", "start")}
        blank = {"client": F.lit(""), "split": F.lit(False), "again": F.lit(False)}
        tick = spark.range(0, buckets, numPartitions=1).select(F.col("id").cast("int").alias("bucket")).withColumns({"kind": F.lit("tick"), **now, **zero, **blank})
        feed = filled(staged.where(F.col("batch") == b).withColumns({"kind": F.lit("row"), **now, "reach": F.lit(0), "start": F.lit(0)})).union(filled(tick))
        if some_long:
            at = segments.withColumns({"reach": F.lit(1), "start": F.lit(1)}) if pointers is None else segments.join(pointers, "client")
            feed = feed.union(filled(at.withColumn("bucket", _bucket(F.col("client"), F.col("seg"), buckets)).withColumns({"kind": F.lit("pointer"), **now, **{c: F.lit(0) for c in ("n", "day", "at")}, "split": F.lit(True), "again": F.lit(False)})))
        feed.write.mode("append").parquet(f"{base}/in")
        _streamed(spark, base, lateness, segment)
        if some_long and b <= batches:
            reports = spark.read.schema(EVENTS).parquet(f"{base}/out").where((F.col("kind") == "report") & (F.col("batch") == b)).select("client", "seg", "run", "due", "due_run").join(segments, ["client", "seg"])
            pointers = stored(_pointers(reports, pointers), "change-pointers")
        upto = then
    return _valued(spark.read.schema(EVENTS).parquet(f"{base}/out").where("kind = 'row'"), changes, id, client, values)


def _valued(events: DataFrame, changes: DataFrame, id: str, client: str, values: tuple[str, ...]) -> DataFrame:
    """Events with missed, values and current: a segment's rows in order of n, from where the client's earlier segments end."""
    types = dict(changes.dtypes)
    shape = "op string, " + ", ".join(f"`{v}` {types[v]}" for v in values)
    rows = events.withColumn("x", F.from_json("payload", shape)).withColumn("applied", F.col("status") == "applied")
    deleted = F.col("x.op") == "D"
    # What a row sets: a struct of the new value, null where it leaves the value as it is.
    sets = {v: F.when(F.col("applied") & (deleted | (F.col("x.op") == "I") | (F.col("x.op") == "U") & F.col("x").getField(v).isNotNull()), F.struct(F.when(~deleted, F.col("x").getField(v)).alias("v"))) for v in values}
    rows = rows.withColumns({f"s_{v}": c for v, c in sets.items()})
    done = rows.where("applied")
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("n", F.col(c).alias("s"))))["s"].alias(c)
    ends = done.groupBy("client", "seg").agg(F.max("n").alias("end"), *[last(f"s_{v}") for v in values])
    earlier = Window.partitionBy("client").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select("client", "seg", F.max("end").over(earlier).alias("b_end"), F.max("end").over(Window.partitionBy("client")).alias("b_last"), *[F.last(f"s_{v}", ignorenulls=True).over(earlier).alias(f"b_{v}") for v in values])
    in_order = Window.partitionBy("client", "seg").orderBy("n")
    after = in_order.rowsBetween(Window.unboundedPreceding, 0)
    made = done.join(before, ["client", "seg"])
    made = made.withColumns({f"a_{v}": F.coalesce(F.last(f"s_{v}", ignorenulls=True).over(after), F.col(f"b_{v}"))["v"] for v in values})
    made = made.withColumn("missed", F.col("n") - 1 - F.coalesce(F.lag("n").over(in_order), F.col("b_end"), F.lit(0))).withColumn("current", (F.col("n") == F.col("b_last")) & F.coalesce(~deleted, F.lit(True)))
    whose = F.when(F.col("client") != "", F.substring("client", 2, 1 << 30)).cast(types[client]).alias(client)
    shown = lambda *more: [F.col("id").cast(types[id]).alias(id), whose, "n", "status", "batch", *more]
    no = rows.where("NOT applied").select(*shown(F.lit(0).cast("bigint").alias("missed"), *[F.lit(None).cast(types[v]).alias(v) for v in values], F.lit(False).alias("current")))
    return made.select(*shown(F.col("missed").cast("bigint").alias("missed"), *[F.col(f"a_{v}").alias(v) for v in values], "current")).union(no)
