"""K-d tree sharding by bytes, with DataFrame operations only.

The narrow table of rows (id, size, coordinates) is split recursively. Each
node takes its widest metadata dimension and counts bytes in a histogram over
it; the bin that holds the weighted quantile is divided again until it weighs
next to nothing, and the node is cut there. A coordinate is the value's place in
a dimension followed by bits of digests, so that ties are cut too. Rows of equal
texts are one group that no cut parts, as long as it weighs no more than a leaf. A
light group has one set of coordinates. A group that weighs over GROUP_SHARE of a
leaf goes to a node's side as a whole, the heaviest first, each to the side that
has more room left; the other rows are then cut where the sides are full. The
rows of a group that no leaf holds are cut like others. The driver sees a row per
node and heavy group, of which there are up to 1 / GROUP_SHARE per leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from calibrant.llm.common import stored

#: Bins of a histogram pass over a node.
BINS = 4096
#: A bin lighter than this share of a leaf is not divided further.
TOLERANCE = 0.001
#: Rows of a shard that are numbered in one task, about.
SLOT_ROWS = 50_000
#: A group of equal texts is placed by its coordinates up to this share of a leaf's bytes; a heavier one by room.
GROUP_SHARE = 0.04
#: A coordinate's bits: the value's place, text digest, id digest.
VALUE_BITS, TEXT_BITS, ID_BITS = 24, 20, 18
#: Ranks that may be broadcast at once, by the bytes of their values.
BROADCAST_BYTES = 16 << 20
NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)

NODE = "shard int, leaves int, dim int, lo bigint, width bigint, before bigint, goal bigint"


def _coordinate(value: Column, lo: float, hi: float, text: Column, ident: Column) -> Column:
    """The value's place between lo and hi (null: lo), then bits of the digests."""
    places = (1 << VALUE_BITS) - 1
    top = F.floor((F.coalesce(value.cast("double"), F.lit(float(lo))) - float(lo)) * (places / max(float(hi) - float(lo), 1e-300))).cast("bigint") if hi > lo else F.lit(0).cast("bigint")
    low = F.shiftleft(F.shiftrightunsigned(text, 64 - TEXT_BITS), ID_BITS) + F.shiftrightunsigned(ident, 64 - ID_BITS)
    return F.shiftleft(F.least(top, F.lit(places).cast("bigint")), TEXT_BITS + ID_BITS) + low


def _ranked(df: DataFrame, name: str) -> DataFrame:
    """Replace the string column by its place among all values: 1 on, null 0. The values are sorted by ranges: a rank is
    the place in its range and the values of the ranges before, so no task sees more than a range."""
    values = df.select(name).where(F.col(name).isNotNull()).distinct()
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = stored(values.repartitionByRange(parts, name).select(name, F.spark_partition_id().alias("__range")), "kd-values")
    inside = placed.withColumn("__place", F.row_number().over(Window.partitionBy("__range").orderBy(name)))
    counts = {r["__range"]: r["n"] for r in placed.groupBy("__range").agg(F.count("*").alias("n")).collect()}  # a row a range
    starts, before = [], 0
    for r in sorted(counts):
        starts.append((r, before))
        before += counts[r]
    if not starts:
        return df.withColumn(name, F.lit(0).cast("bigint"))
    begin = F.broadcast(spark.createDataFrame(starts, "__range int, __start bigint"))
    ranks = inside.join(begin, "__range").select(name, (F.col("__start") + F.col("__place")).cast("bigint").alias("__rank"))
    weight = placed.agg(F.sum(F.octet_length(name) + 24)).first()[0] or 0
    return df.join(F.broadcast(ranks) if weight <= BROADCAST_BYTES else ranks, name, "left").withColumn(name, F.coalesce("__rank", F.lit(0))).drop("__rank")


def _grouped(base: DataFrame, names: list[str], most: int, leaf: int) -> tuple[DataFrame, DataFrame, list[tuple[int, int, int]]]:
    """(rows, heavy rows, heavy groups): rows are those of base in which a text that weighs up to `most` bytes in all has one
    set of metadata, the least of theirs, and no id (`unit`); single rows, and those of groups over `leaf`, keep their own.
    Heavy groups, (t, size, bytes), weigh something between the two: they are fewer than all bytes by `most`."""
    several = stored(base.groupBy("t", "size").agg(F.count("*").alias("n"), *[F.min(c).alias(f"g_{c}") for c in names]).where("n > 1"), "kd-groups")
    weight = F.col("n") * F.col("size")
    groups = several.where(weight <= most).drop("n")
    heavy = several.where((weight > most) & (weight <= leaf)).select("t", "size", weight.alias("bytes"))
    found = [tuple(r) for r in heavy.collect()]
    own = base.join(F.broadcast(heavy.select("t", "size")), ["t", "size"], "left_semi") if found else base.where("false")
    rest = base.join(F.broadcast(heavy.select("t", "size")), ["t", "size"], "left_anti") if found else base
    few = groups.count() <= 100_000  # 8 MB: hashes, sizes and ranks or numbers
    out = rest.join((F.broadcast(groups) if few else groups).withColumn("unit", F.lit(True)), ["t", "size"], "left")
    out = out.withColumns({c: F.when(F.col("unit"), F.col(f"g_{c}")).otherwise(F.col(c)) for c in names}).withColumn("unit", F.coalesce("unit", F.lit(False))).drop(*[f"g_{c}" for c in names])
    return out, own, found


def _sides(groups: list[tuple[int, int, int]], left: int, right: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Heavy groups of a node by side: the heaviest first, each to the side that has more room left of its bytes."""
    sides, room = ([], []), [left, right]
    for g in sorted(groups, key=lambda g: (-g[2], g)):
        k = 0 if room[0] >= room[1] else 1
        sides[k].append(g)
        room[k] -= g[2]
    return sides


def _cuts(spark: SparkSession, rows: DataFrame, leaves: dict[int, int], dims: int, spread: list[int], light: int, heavy: dict[int, list[tuple[int, int, int]]]) -> tuple[list[tuple[int, int, int, int]], dict[int, list[tuple[int, int, int]]]]:
    """For each node of several leaves that has rows or groups: (shard, dimension, cut, leaves below the cut); and heavy by
    the nodes of the next level."""
    split = spark.createDataFrame([(s, n) for s, n in leaves.items() if n > 1], "shard int, leaves int")
    seen = rows.join(F.broadcast(split), "shard").groupBy("shard", "leaves").agg(F.sum("size").alias("bytes"), *[f(f"x{k}").alias(f"{n}{k}") for k in range(dims) for n, f in (("lo", F.min), ("hi", F.max))])
    nodes, found, below = [], [], {s: g for s, g in heavy.items() if leaves[s] == 1}
    held = {r["shard"]: r for r in seen.collect()}
    for shard, n in leaves.items():
        r, groups = held.get(shard), heavy.get(shard, [])
        if n == 1 or r is None and not groups:
            continue
        own, left = (r["bytes"] if r else 0), n // 2
        whole = own + sum(g[2] for g in groups)
        goal = whole * left // n
        below[shard], below[shard + left] = _sides(groups, goal, whole - goal)
        if r is None:
            found.append((shard, 0, 0, left))
            continue
        k = max(range(dims), key=lambda k: ((r[f"hi{k}"] - r[f"lo{k}"]) / spread[k], -k))
        rest = min(max(goal - sum(g[2] for g in below[shard]), 0), own)
        nodes.append((shard, n, k, r[f"lo{k}"], -(-(r[f"hi{k}"] - r[f"lo{k}"] + 1) // BINS), 0, rest))
    x = F.element_at(F.array(*[F.col(f"x{k}") for k in range(dims)]), F.col("dim") + 1)
    while nodes:
        binned = rows.join(F.broadcast(spark.createDataFrame(nodes, NODE)), "shard").withColumn("x", x).where((F.col("x") >= F.col("lo")) & (F.col("x") - F.col("lo") < F.col("width") * BINS))
        weights = binned.groupBy("shard", F.expr("(x - lo) div width").alias("bin")).agg(F.sum("size").alias("w"), F.first("before").alias("before"), F.first("goal").alias("goal"))
        upto = weights.withColumn("upto", F.col("before") + F.sum("w").over(Window.partitionBy("shard").orderBy("bin")))
        at = {r["shard"]: r for r in upto.where("upto >= goal").groupBy("shard").agg(F.min_by(F.struct("bin", "w", "upto"), "bin").alias("b")).select("shard", "b.*").collect()}
        rest = []
        for shard, n, k, lo, width, _, goal in nodes:
            b = at[shard]
            start, before = lo + b["bin"] * width, b["upto"] - b["w"]
            if width > 1 and b["w"] > light:
                rest.append((shard, n, k, start, -(-width // BINS), before, goal))
            else:
                found.append((shard, k, start + width - 1 if b["upto"] - goal <= goal - before else start - 1, n // 2))
        nodes = rest
    return found, below


def kd_shards(docs: DataFrame, target_bytes: int | None = None, shards: int | None = None, id: str = "doc_id", text: str = "text", dims: tuple[str, ...] = ("size", "lang", "source")) -> DataFrame:
    """doc_id, size, text_crc32, law ("bytes"), shard, slot, grown_shard (null) for every row of docs.

    Nodes are split until their leaves reach target_bytes, or are as many as shards. size is the text's UTF-8 bytes
    plus 8; a null text has none (size 8, the crc32 of nothing). dims are "size" or metadata columns: numbers by
    value, strings by rank, both scaled to their range in 2^24 places; null is lowest. Equal texts (null and empty are
    equal) go to one shard as long as they weigh no more than one: light groups by the least of their metadata, those over
    GROUP_SHARE of a shard by room; groups that no shard holds are cut like other rows. Ids may be null or repeat. An empty table gives no rows. The shards' bytes
    are equal up to the groups at their cuts; with fewer rows than shards some stay empty. slot numbers a shard's rows
    without gaps from 0. Other columns aren't read. Levels are written to the shared folder.
    """
    if (target_bytes is None) == (shards is None):
        raise ValueError("give target_bytes or shards")
    spark = docs.sparkSession
    whole = F.coalesce(docs[text], F.lit(""))
    size = F.octet_length(whole).cast("bigint") + 8
    named = [d for d in dims if d != "size"]
    base = docs.select(docs[id].alias("doc_id"), size.alias("size"), F.crc32(F.encode(whole, "utf-8")).alias("text_crc32"), F.xxhash64(whole).alias("t"), *[docs[d].alias(f"m_{d}") for d in named])
    base = stored(base, "kd-rows")
    for d in named:
        if not isinstance(base.schema[f"m_{d}"].dataType, NUMBERS):
            base = _ranked(base.withColumn(f"m_{d}", F.col(f"m_{d}").cast("string")), f"m_{d}")
    columns = ["size" if d == "size" else f"m_{d}" for d in dims]
    seen = base.agg(F.sum("size").alias("bytes"), *[f(F.nanvl(F.col(c).cast("double"), F.lit(None))).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    count = shards or max(1, -(-(seen["bytes"] or 0) // target_bytes))
    leaf = (seen["bytes"] or 0) // count
    base, own_heavy, groups = _grouped(base, [f"m_{d}" for d in named], int(GROUP_SHARE * leaf), leaf)
    own = lambda i: F.when(F.col("unit"), F.xxhash64("t", F.lit(i))).otherwise(F.xxhash64("doc_id", F.lit(i)))
    axes = [_coordinate(F.col(c), seen[f"lo{i}"] or 0, seen[f"hi{i}"] or 0, F.col("t"), own(i)).alias(f"x{i}") for i, c in enumerate(columns)]
    rows = stored(base.select("doc_id", "size", "text_crc32", *axes, F.lit(0).alias("shard")), "kd-level")
    k = range(len(dims))
    total = rows.agg(F.count("*").alias("n"), *[(F.max(f"x{i}") - F.min(f"x{i}")).alias(f"s{i}") for i in k]).first()
    leaves, heavy = {0: count}, {0: groups}
    spread = [max(1, total[f"s{i}"] or 0) for i in k]
    while (total["n"] or groups) and max(leaves.values()) > 1:
        cuts, heavy = _cuts(spark, rows, leaves, len(dims), spread, int(TOLERANCE * leaf), heavy)
        below = {shard: left for shard, _, _, left in cuts}
        table = F.broadcast(spark.createDataFrame(cuts, "shard int, dim int, cut bigint, below int"))
        x = F.element_at(F.array(*[F.col(f"x{i}") for i in k]), F.col("dim") + 1)
        over = F.when(x > F.col("cut"), F.col("below")).otherwise(0)
        rows = stored(rows.join(table, "shard", "left").withColumn("shard", F.col("shard") + F.coalesce(over, F.lit(0))).drop("dim", "cut", "below"), "kd-level")
        # A node without rows and groups has no cut: it stays whole, and its other shards stay empty.
        leaves = {s: n for shard, c in leaves.items() for s, n in ([(shard, below[shard]), (shard + below[shard], c - below[shard])] if shard in below else [(shard, 1)])}
    placed = rows.select("doc_id", "size", "text_crc32", "shard")
    if groups:
        home = spark.createDataFrame([(t, size, shard) for shard, own in heavy.items() for t, size, _ in own], "t bigint, size bigint, shard int")
        placed = placed.union(own_heavy.join(F.broadcast(home), ["t", "size"]).select("doc_id", "size", "text_crc32", "shard"))
    all_rows = total["n"] + own_heavy.count() if groups else total["n"]
    return _numbered(placed, max(1, -(-all_rows // (count * SLOT_ROWS))))


def _numbered(rows: DataFrame, blocks: int) -> DataFrame:
    """slot: a block of a shard is numbered in one task, and starts where the blocks before it end."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(blocks)))
    starts = rows.groupBy("shard", "block").count().select("shard", "block", (F.sum("count").over(Window.partitionBy("shard").orderBy("block")) - F.col("count")).alias("start"))
    inside = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size")) - 1
    return (
        rows.withColumn("inside", inside)
        .join(starts, ["shard", "block"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("inside")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
