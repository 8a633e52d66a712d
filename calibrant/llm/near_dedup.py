"""MinHash near-dedup with bottom-k sketches from one hash function.

A document's sketch is the k smallest hashes of its shingles. Documents of equal
sets are one node, whatever their ids are. Of documents with Jaccard similarity of the threshold or
more, the sketches share at least min_overlap values (but for a chance of under
MISS a pair), so it is enough to keep inverted lists of each sketch's
size - min_overlap + 1 rarest values: what is common to many documents, such as
a passage, leaves the lists. A first round links every list's members with two
of them, one drawn by chance, the same in many lists, and the one that is in most
company; a second one
takes the pairs of a list that are still in different components, unless too
much of a member's full set is its own alone to be shared with anyone. Pairs
pass bounds on sizes, the estimate of the union sketch and the exact Jaccard
similarity of the full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from calibrant.llm.common import BROADCAST_IDS, arrow_map, dropped, stored, with_ids
from calibrant.llm.components import components

K = 64
MISS = 1e-9
#: A list's drawn head is one of so many draws, which lists share: near copies have many lists in common, and meet the same heads there.
DRAWS = 4
#: Buckets of the bound on what two full sets can share.
BUCKETS = 64
#: Odd factors that tell a shingle's places apart; powers of one odd number.
FACTOR = 0x9E3779B97F4A7C15


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the text's word shingles, A-Z lower-cased."""
    ws = text.lower().split()  # of bytes: A-Z, and \x20 \x09-\x0D
    n = len(ws)
    if not n:
        return np.empty(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, n)
    m = min(n, words)
    s = np.full(n - m + 1, m, np.uint64)
    for i in range(m):
        s = s * np.uint64(FACTOR) + h[i : n - m + 1 + i]
    s = (s ^ (s >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    s = (s ^ (s >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique((s ^ (s >> np.uint64(32))) >> np.uint64(1)).astype(np.int64)


def min_overlap(k: int, percent: int, miss: float = MISS) -> int:
    """Values that two bottom-k sketches share at least, but for a chance under miss, at this similarity: the
    values of the union's sketch that lie in both sets are so many of k draws, with a chance of percent each."""
    j, below, t = percent / 100, 0.0, 0
    while t < k and (below := below + comb(k, t) * j**t * (1 - j) ** (k - t)) < miss:
        t += 1
    return max(1, min(t, int(k * (2 - 1 / j))))


def _sketches(rows: DataFrame, words: int, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = (shingle_hashes(t.as_buffer().to_pybytes(), words) for t in batch.column("text"))
            made = [(len(s), _signature(s), s[:k].copy()) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.binary()), pa.array([m[2] for m in made], pa.list_(pa.int64()))], names=["doc_id", "n", "sig", "sketch"])

    return arrow_map(rows, run, "doc_id bigint, n bigint, sig binary, sketch array<bigint>")


def _sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of nodes (node, rep_id, sig): the full sets of their representatives' texts. Of a repeated row
    there are several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 250):
                sets = [shingle_hashes(t.as_buffer().to_pybytes(), words) for t in batch.column("text").slice(start, 250)]
                yield pa.RecordBatch.from_arrays([pa.array([_signature(s) for s in sets], pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["sig", "shingles"])

    n = nodes.count()
    some = with_ids(docs, nodes.select(F.col("rep_id").alias("doc_id")).distinct(), "left_semi", rows=n)
    return arrow_map(some, run, "sig binary, shingles array<bigint>").join(_small(nodes.select("node", "sig"), n), "sig").select("node", "shingles")


def _signature(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _small(df: DataFrame, rows: int) -> DataFrame:
    """df, broadcast if it has so few rows of ids and digests that they are 25 MB at most."""
    return F.broadcast(df) if rows <= BROADCAST_IDS // 4 else df


def _lists(reps: DataFrame, k: int, percent: int) -> DataFrame:
    """(value, node, n) of the inverted lists: each sketch's rarest values, as many as have to hold a shared one."""
    t = min_overlap(k, percent)
    needed = F.least(F.lit(t), F.ceil(F.col("n") * percent / 100)).cast("int")  # a sketch of n <= k is the whole set
    values = reps.select("node", "n", (F.size("sketch") - needed + 1).alias("prefix"), F.size("sketch").alias("size"), F.explode("sketch").alias("value"))
    shared = values.groupBy("value").count().where("count > 1")
    held = values.join(shared, "value")
    by_doc = Window.partitionBy("node")
    held = held.withColumn("alone", F.col("size") - F.count("*").over(by_doc)).withColumn("place", F.col("alone") + F.row_number().over(by_doc.orderBy("count", "value")))
    return held.where("place <= prefix").select("value", "node", "n")


def _close(a: Column, b: Column, percent: int) -> Column:
    return (a * 100 >= b * percent) & (b * 100 >= a * percent)


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, words: int, k: int, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose full sets are similar enough; stored."""
    t = min_overlap(k, percent)
    sk = reps.select("node", "sketch")
    both = pairs.join(sk.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a").join(sk.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    estimated = both.withColumn("u", union).where(F.size(F.array_intersect(F.array_intersect("sa", "sb"), F.col("u"))) >= F.least(F.lit(t), F.ceil(F.size("u") * percent / 100)))
    likely = stored(estimated.select("a", "b"), "near-likely")
    nodes = stored(likely.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(reps.select("node", "rep_id", "sig"), "node"), "near-nodes")
    sets = stored(_sets(docs, nodes, words), "near-sets")
    full = likely.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    common = full.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("both"), (F.size("sa") + F.size("sb")).alias("sum"))
    links = stored(common.where(F.col("both") * 100 >= (F.col("sum") - F.col("both")) * percent).select("a", "b"), "near-links")
    dropped(likely, nodes, sets)
    return links


def _shareable(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, shareable, spread): how many shingles of each node's full set another of the nodes has too, in all and
    by BUCKETS buckets of the hash. The smaller counts of two nodes, summed over buckets, bound what they share."""
    each = _sets(docs, nodes, words).dropDuplicates(["node"]).select("node", F.explode("shingles").alias("shingle"))
    bucket = F.pmod("shingle", F.lit(BUCKETS)).alias("bucket")
    alone = each.groupBy("shingle").agg(F.count("*").alias("c"), F.min("node").alias("node")).where("c = 1").groupBy("node", bucket).agg(F.count("*").alias("alone"))
    counts = each.groupBy("node", bucket).agg(F.count("*").alias("c")).join(alone, ["node", "bucket"], "left").select("node", "bucket", (F.col("c") - F.coalesce("alone", F.lit(0))).cast("int").alias("c"))
    held = counts.groupBy("node").agg(F.sum("c").alias("shareable"), F.map_from_entries(F.collect_list(F.struct("bucket", "c"))).alias("by"))
    spread = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: F.coalesce(F.try_element_at("by", b.cast("bigint")), F.lit(0)))
    return held.select("node", "shareable", spread.alias("spread"))


def near_components(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, k: int = K) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    A document's set is its distinct shingles of so many words (A-Z lower-cased, split at ASCII white space), or the
    whole sequence where it has fewer; without words, or null, it is empty and linked with nothing. Documents are
    linked with 100 * intersection >= percent * union; component_id is the smallest id reachable. Rows are linked by
    their texts: rows that share an id but not a text are apart, each in the component of its text, and each row with the
    smallest id of its component is kept. A row with a null id is linked with nothing: component_id null, kept. percent
    is over 50. Other columns aren't read. An empty table gives no rows.
    """
    rows = docs.select(docs[id].cast("bigint").alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    sketches = stored(_sketches(rows, words, k), "near-sketches")
    some = sketches.where("n > 0 AND doc_id IS NOT NULL")
    one = some.groupBy("sig").agg(F.min(F.struct("doc_id", "n", "sketch")).alias("r"), F.count("*").alias("copies"))
    reps = stored(one.select("sig", F.monotonically_increasing_id().alias("node"), F.col("r.doc_id").alias("rep_id"), F.col("r.n").alias("n"), F.col("r.sketch").alias("sketch"), "copies"), "near-reps")
    lists = stored(_lists(reps, k, percent), "near-lists")

    company = lists.join(lists.groupBy("value").agg(F.count("*").alias("members")).where("members > 1"), "value")
    popular = company.groupBy("node").agg(F.sum("members").alias("company"))
    company = stored(company.join(popular, "node"), "near-company")
    member = lambda *by: F.min(F.struct(*by, F.col("node").alias("head"), F.col("n").alias("head_n")))
    heads = company.groupBy("value").agg(F.array(member(F.xxhash64("node", F.pmod("value", F.lit(DRAWS))).alias("by")), member((-F.col("company")).alias("by"))).alias("heads"))
    first = company.join(heads.select("value", F.explode("heads").alias("h")), "value").select("node", "n", "h.head", "h.head_n").where((F.col("node") != F.col("head")) & _close(F.col("n"), F.col("head_n"), percent))
    pairs = stored(first.select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct(), "near-pairs")
    links = _verified(pairs, reps, rows, words, k, percent)
    roots = components(links)

    # Lists whose members are in several components still: every pair across components, but for those already seen.
    placed = company.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_lists = placed.groupBy("value").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("value")
    members = stored(placed.join(open_lists, "value").select("value", "node", "n", "root"), "near-open")
    nodes = stored(members.select("node").distinct().join(reps.select("node", "rep_id", "sig"), "node"), "near-nodes")
    left = members.join(_shareable(rows, nodes, words), "node").where(F.col("shareable") * 100 >= F.col("n") * percent)
    own = left.groupBy("node").agg(F.collect_list("value").alias("mine"))
    left = stored(left.join(own, "node"), "near-left")
    x, y = left.alias("x"), left.alias("y")
    needed = (F.col("x.n") + F.col("y.n")) * percent
    enough = F.least("x.shareable", "y.shareable") * (100 + percent) >= needed
    here = F.array_min(F.array_intersect("x.mine", "y.mine")) == F.col("x.value")  # of the lists that have both, one compares them
    overlap = F.aggregate(F.zip_with("x.spread", "y.spread", lambda a, b: F.least(a, b)), F.lit(0), lambda t, c: t + c)
    across = x.join(y, (F.col("x.value") == F.col("y.value")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & enough & here & (overlap * (100 + percent) >= needed))
    more = stored(across.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti"), "near-pairs")
    dropped(lists, company, members, nodes, left, pairs, roots)
    more_links = _verified(more, reps, rows, words, k, percent)
    roots = components(links.union(more_links))

    # The smallest id of a component is not that of its smallest node.
    linked = roots.union(roots.select("root", "root").distinct()).join(reps.select("node", "rep_id", "sig"), "node")
    least = stored(linked.groupBy("root").agg(F.min("rep_id").alias("component")), "near-least")
    linked = stored(linked.join(_small(least, least.count()), "root").select("sig", "component"), "near-linked")
    copies = reps.where("copies > 1").join(linked, "sig", "left_anti").select("sig", F.col("rep_id").alias("component"))
    named = stored(linked.union(copies), "near-groups")
    dropped(reps, links, more, more_links, roots, least, linked)
    joined = sketches.join(_small(named, named.count()), "sig", "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"))
