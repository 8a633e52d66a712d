"""Exact dedup by a log-structured merge index of text digests.

1. Each task takes rows into memtables. A memtable joins rows of equal digest
   after comparing their bytes, then flushes as a run sorted by digest: a row
   per document, of which one, the representative, stands for its group in this
   run. Hot texts shrink here, before any shuffle.
2. Representatives are dealt by digest prefix. Every bucket is a merge tree of
   its own: memtables flush sorted digest runs with Bloom filters, an insert
   probes the filters and searches the runs that may hold its digest, and
   compaction merges runs, keeping the smallest identifier of a digest.
3. Digests that more than one memtable held are hits: their representatives'
   whole texts are grouped byte by byte, so a digest collision parts again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibrant.llm.common import arrow_map, ascii_lower, stored, with_ids

MEMTABLE_ROWS = 16_384
MEMTABLE_BYTES = 32 << 20
#: Representatives in a bucket of the index, about; a bucket is one task's tree.
BUCKET_ROWS = 100_000
BITS_PER_KEY = 12
HASHES = 6
#: Runs of a tree that are merged at once.
FANOUT = 4

RUN_SCHEMA = "run string, doc_id bigint, digest binary, rep_id bigint, is_rep boolean, n bigint"
HIT_SCHEMA = "digest binary, rep_id bigint, n bigint, tree_keep bigint, tree_size bigint"


def smaller(a: int, b: int, largest: bool) -> bool:
    """Whether a comes before b in the identifiers' order."""
    return a > b if largest else a < b


def memtables(batches: Iterator[pa.RecordBatch], largest: bool) -> Iterator[pa.RecordBatch]:
    """Flushed runs of one task's rows (doc_id, text)."""
    task, seq = TaskContext.get().partitionId() if TaskContext.get() else 0, 0
    groups: dict[bytes, list[list]] = {}  # digest -> variants [text, representative, ids]
    rows = held = 0

    def flush() -> pa.RecordBatch:
        nonlocal seq
        out: dict[str, list] = {k: [] for k in ("run", "doc_id", "digest", "rep_id", "is_rep", "n")}
        for digest in sorted(groups):
            for _, rep, ids in groups[digest]:
                first = ids.index(rep)
                for i, doc in enumerate(ids):
                    out["run"].append(f"{task}-{seq}")
                    out["doc_id"].append(doc)
                    out["digest"].append(digest)
                    out["rep_id"].append(rep)
                    out["is_rep"].append(i == first)
                    out["n"].append(len(ids))
        seq += 1
        return pa.RecordBatch.from_pydict(out, schema=pa.schema([("run", pa.string()), ("doc_id", pa.int64()), ("digest", pa.binary()), ("rep_id", pa.int64()), ("is_rep", pa.bool_()), ("n", pa.int64())]))

    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            data = text.as_buffer().to_pybytes().lower()  # of bytes, A-Z alone
            variants = groups.setdefault(hashlib.sha256(data).digest(), [])
            for v in variants:
                if v[0] == data:
                    v[2].append(doc)
                    if smaller(doc, v[1], largest):
                        v[1] = doc
                    break
            else:
                variants.append([data, doc, [doc]])
                held += len(data)
            rows += 1
            if rows >= MEMTABLE_ROWS or held >= MEMTABLE_BYTES:
                yield flush()
                groups.clear()
                rows = held = 0
    if groups:
        yield flush()


class Bloom:
    """Filter over 32-byte digests; its hashes are words of the digest itself."""

    def __init__(self, words: np.ndarray):
        self.size = np.uint64(max(64, 1 << int(np.ceil(np.log2(max(1, len(words)) * BITS_PER_KEY)))))
        self.bits = np.zeros(int(self.size) // 8, np.uint8)
        at = self._at(words)
        np.bitwise_or.at(self.bits, at >> np.uint64(3), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))

    def _at(self, words: np.ndarray) -> np.ndarray:
        a, b = words[:, 1:2], words[:, 2:3] | np.uint64(1)
        return (a + b * np.arange(HASHES, dtype=np.uint64)) % self.size

    def may_hold(self, words: np.ndarray) -> np.ndarray:
        at = self._at(words)
        return ((self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


class MergeTree:
    """Sorted runs of digests with their smallest identifiers and summed counts."""

    def __init__(self, memtable_rows: int = MEMTABLE_ROWS, largest: bool = False):
        self.memtable_rows, self.largest = memtable_rows, largest
        self.table: dict[bytes, list] = {}
        self.runs: list[tuple[np.ndarray, list, np.ndarray, Bloom]] = []  # keys S32, identifiers, counts, filter
        self.probes = 0

    @staticmethod
    def words(keys: np.ndarray) -> np.ndarray:
        return np.frombuffer(keys.tobytes(), ">u8").reshape(-1, 4).astype(np.uint64)

    def insert(self, digest: bytes, ident: int, n: int = 1) -> None:
        e = self.table.get(digest)
        if e is None:
            self.table[digest] = [ident, n]
            if len(self.table) >= self.memtable_rows:
                self.flush()
        else:
            e[1] += n
            if smaller(ident, e[0], self.largest):
                e[0] = ident

    def flush(self) -> None:
        if self.table:
            self._add([(d, *self.table[d]) for d in sorted(self.table)])
            self.table = {}
            while len(self.runs) >= FANOUT and len(self.runs[-1][0]) * FANOUT > len(self.runs[-2][0]):
                self.compact(last=2)

    def _add(self, rows: list[tuple]) -> None:
        keys = np.array([r[0] for r in rows], "S32")
        self.runs.append((keys, [r[1] for r in rows], np.array([r[2] for r in rows], np.int64), Bloom(self.words(keys))))

    def compact(self, last: int | None = None) -> None:
        """Merge the last runs (all: None) into one; of a digest the smallest identifier stays and counts add up."""
        runs = self.runs[-last:] if last else self.runs
        merged: dict[bytes, list] = {}
        for keys, ids, counts, _ in runs:
            for k, i, c in zip(keys.tolist(), ids, counts.tolist()):
                e = merged.setdefault(k.ljust(32, b"\0"), [i, 0])
                e[1] += c
                if smaller(i, e[0], self.largest):
                    e[0] = i
        del self.runs[len(self.runs) - len(runs) :]
        if merged:
            self._add([(d, *merged[d]) for d in sorted(merged)])

    def held(self, digests: list[bytes]) -> np.ndarray:
        """Which of the digests the tree has: memtable first, then each run whose filter may hold them."""
        found = np.fromiter((d in self.table for d in digests), bool, len(digests))
        keys = np.array(digests, "S32")
        words = self.words(keys) if len(keys) else None
        for run, _, _, bloom in self.runs if len(keys) else []:
            maybe = np.flatnonzero(~found)
            maybe = maybe[bloom.may_hold(words[maybe])]
            self.probes += len(maybe)
            at = np.minimum(np.searchsorted(run, keys[maybe]), len(run) - 1)
            found[maybe[run[at] == keys[maybe]]] = True
        return found


def merge_bucket(batches: Iterator[pa.RecordBatch], memtable_rows: int, largest: bool) -> Iterator[pa.RecordBatch]:
    """Rows (digest, rep_id, n) of whole buckets; gives those whose digest other rows hold too, with what compaction keeps of the digest."""
    tree = MergeTree(memtable_rows, largest)
    again: set[bytes] = set()
    rows: list[pa.RecordBatch] = []
    for batch in batches:
        digests = batch.column("digest").to_pylist()
        for start in range(0, len(digests), 4096):
            part = digests[start : start + 4096]
            old = tree.held(part)
            seen: set[bytes] = set()
            for d, was in zip(part, old.tolist()):
                if was or d in seen:
                    again.add(d)
                seen.add(d)
            for d, i, n in zip(part, batch.column("rep_id").slice(start, 4096).to_pylist(), batch.column("n").slice(start, 4096).to_pylist()):
                tree.insert(d, i, n)
        rows.append(batch)
    tree.flush()
    tree.compact()
    best = {k: (i, c) for keys, ids, counts, _ in tree.runs for k, i, c in zip(keys.tolist(), ids, counts.tolist())}
    for batch in rows:
        hits = batch.filter(pa.array([d in again for d in batch.column("digest").to_pylist()], pa.bool_()))
        kept = [best[d.rstrip(b"\0")] for d in hits.column("digest").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*(hits.column(c) for c in ("digest", "rep_id", "n")), pa.array([k for k, _ in kept], pa.int64()), pa.array([c for _, c in kept], pa.int64())],
            names=["digest", "rep_id", "n", "tree_keep", "tree_size"],
        )


def exact_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", keep: str = "smallest", memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after lower-casing A-Z only; null is empty, and empty texts are one
    group. Of a group the row with the smallest (keep="largest": the largest) id stays; a null id comes last, so
    it stays only where all ids of its group are null. A repeated row, with the same id and text, counts in
    group_size, and each repetition of the id that stays is kept. Other columns of docs aren't read. An empty
    table gives no rows. Writes its runs and hits to the shared folder.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep: {keep}")
    largest = keep == "largest"
    spark = docs.sparkSession
    last = -(1 << 63) if largest else (1 << 63) - 1  # stands for a null id
    rows = docs.select(F.coalesce(docs[id].cast("bigint"), F.lit(last)).alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    runs = stored(
        arrow_map(rows, lambda b: memtables(b, largest), RUN_SCHEMA),
        "dedup-runs",
    )
    reps = runs.where("is_rep").select("digest", "rep_id", "n")
    buckets = max(1, -(-reps.count() // BUCKET_ROWS))
    hits = stored(
        arrow_map(reps.repartition(buckets, F.substring("digest", 1, 4)), lambda b: merge_bucket(b, memtable_rows, largest), HIT_SCHEMA),
        "dedup-hits",
    )
    # Where a digest's bytes are all equal, the tree's answer stands; else each text is a group of its own.
    whole = F.sum("n") == F.first("tree_size")
    order = F.when(whole, F.first("tree_keep")).otherwise(F.max("rep_id") if largest else F.min("rep_id"))
    texts = with_ids(rows, hits.select(F.col("rep_id").alias("doc_id")).distinct(), "left_semi").select(F.col("doc_id").alias("rep_id"), ascii_lower(F.col("text")).alias("text"))
    same = (
        hits.join(texts.select("rep_id", F.unhex(F.sha2("text", 256)).alias("digest"), "text").distinct(), ["rep_id", "digest"])
        .groupBy("digest", "text")
        .agg(order.alias("keep_id"), F.sum("n").alias("group_size"), F.collect_list("rep_id").alias("reps"))
    )
    groups = stored(same.select("digest", F.explode("reps").alias("rep_id"), "keep_id", "group_size").distinct(), "dedup-groups")
    out = runs.alias("r").join(groups.alias("g"), ["rep_id", "digest"], "left")
    keep_id = F.coalesce("keep_id", "rep_id")
    return out.select(
        F.nullif("doc_id", F.lit(last)).alias("doc_id"),
        F.nullif(keep_id, F.lit(last)).alias("keep_id"),
        F.coalesce("group_size", "n").alias("group_size"),
        (F.col("doc_id") == keep_id).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
