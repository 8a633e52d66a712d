"""Byte-level BPE encoding and decoding by a pair occurrence index.

A block of a partition's texts is split into pieces; the distinct new pieces of
the block are laid out in one symbol array. The index maps each pair (by its
rank) to all its positions there. The lowest active rank is applied at all its
positions, and the lists of the pairs that appear beside each merge get the
new position. Stale positions are recognised when their list is applied.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibrant.llm.common import arrow_map

# Fixed value: the public byte-level pre-tokeniser pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Characters of text that pass at once; pieces of a long text that do.
BLOCK_CHARS = 4_000_000
LONG_PIECES = 200_000
#: Pieces that a worker remembers within a task, the characters of them and their ids, and pieces that it keeps for the next task.
CACHE_PIECES = 200_000
CACHE_CHARS = 16 << 20
KEPT_PIECES = 50_000

OUTPUTS = {
    "token_ids": pa.list_(pa.int32()),
    "n_tokens": pa.int64(),
    "ids_sha256": pa.string(),
    "decoded": pa.string(),
    "decoded_sha256": pa.string(),
}
SQL_TYPES = {"token_ids": "array<int>", "n_tokens": "bigint", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string"}


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in vocabularies of this kind: printable bytes are themselves, the others follow from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class PairIndexBPE:
    """Encoder and decoder for a tokenizers JSON file of the byte-level BPE kind."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, symbols = spec["model"]["vocab"], byte_symbols()
        to_byte = {s: b for b, s in enumerate(symbols)}
        self.byte_id = np.array([vocab[s] for s in symbols])
        self.merges: list[tuple[int, int, int]] = []
        rank: dict[int, int] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            rank.setdefault(vocab[a] << 32 | vocab[b], r)
            self.merges.append((vocab[a], vocab[b], vocab[a + b]))
        self.pair_keys = np.array([*sorted(rank), 1 << 62])
        self.pair_ranks = np.array([*(rank[k] for k in sorted(rank)), -1])
        self.bytes_of = {i: bytes(to_byte[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.split_special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.pattern = regex.compile(PATTERN)
        self.ids: dict[str, str] = {t: str(i) for t, i in self.special.items()}
        self.raw = {str(i): b for i, b in self.bytes_of.items()}
        self.held = 0  # characters of the remembered pieces and their ids

    def forget(self, kept: int) -> None:
        """Keep so many of the pieces that were learned first: common ones come early."""
        for piece in [*islice(self.ids, max(kept, len(self.special)), None)]:
            self.held -= len(piece) + len(self.ids.pop(piece))

    def _within_bounds(self) -> None:
        if len(self.ids) > CACHE_PIECES or self.held > CACHE_CHARS:
            self.forget(min(len(self.ids), CACHE_PIECES) // 2)
        if self.held > CACHE_CHARS:
            self.forget(0)

    def merge(self, pieces: list[str]) -> list[list[int]]:
        """Token ids of each piece; the pieces are merged together in one index. sym ends every piece with -1 and marks merged-away positions with -2."""
        data = [p.encode() for p in pieces]
        sizes = np.fromiter(map(len, data), np.int64, len(data)) + 1
        ends = np.cumsum(sizes)  # of the -1 after each piece; position 0 is a -1 too
        sym = np.full(int(ends[-1]) + 1 if data else 1, -1, np.int64)
        inner = np.ones(len(sym), bool)
        inner[0] = False
        inner[ends] = False
        sym[inner] = self.byte_id[np.frombuffer(b"".join(data), np.uint8)]
        nxt = np.arange(1, len(sym) + 1)
        prv = np.arange(-1, len(sym) - 1)
        at: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(left: np.ndarray, right: np.ndarray, where: np.ndarray) -> None:
            """Put the positions under their pair's rank, where the pair has one."""
            key = left << 32 | right
            i = np.searchsorted(self.pair_keys, key)
            has = self.pair_keys[i] == key
            r, where = self.pair_ranks[i[has]], where[has]
            if not len(r):
                return
            order = np.argsort(r, kind="stable")
            r, where = r[order], where[order]
            cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
            for x, w in zip(r[[0, *cuts]].tolist(), np.split(where, cuts)):
                if x in at:
                    at[x].append(w)
                else:
                    at[x] = [w]
                    heappush(active, x)

        p = np.flatnonzero((sym[:-1] >= 0) & (sym[1:] >= 0))
        add(sym[p], sym[p + 1], p)
        while active:
            rank = heappop(active)
            a, b, c = self.merges[rank]
            lists = at.pop(rank)
            p = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            q = nxt[p]
            live = (sym[p] == a) & (sym[q] == b)
            p, q = p[live], q[live]
            if a == b and len(p) > 1:  # of overlapping occurrences the left one merges
                taken, mine = set(), []
                for k, (x, y) in enumerate(zip(p.tolist(), q.tolist())):
                    if x not in taken:
                        taken.add(y)
                        mine.append(k)
                p, q = p[mine], q[mine]
            if not len(p):
                continue
            sym[p], sym[q] = c, -2
            after = nxt[q]
            nxt[p], prv[after] = after, p
            before = prv[p]
            s, t = sym[after], sym[before]
            more, less = s >= 0, t >= 0
            fixed = np.full(len(p), c)
            add(np.concatenate([fixed[more], t[less]]), np.concatenate([s[more], fixed[less]]), np.concatenate([p[more], before[less]]))
        left = sym >= 0
        ids, upto = sym[left].tolist(), np.cumsum(left)[ends].tolist() if data else []
        return [ids[i:j] for i, j in zip([0, *upto], upto)]

    def pieces(self, text: str) -> list[str]:
        if self.split_special and any(t in text for t in self.special):
            return [p for part in self.split_special.split(text) for p in ([part] if part in self.special else self.pattern.findall(part))]
        return self.pattern.findall(text)

    def stream(self, text: str) -> Iterator[str]:
        for part in self.split_special.split(text) if self.split_special else [text]:
            if part in self.special:
                yield part
            else:
                yield from (m[0] for m in self.pattern.finditer(part))

    def learn(self, new: list[str]) -> None:
        """Put pieces that aren't known through the index, and remember their ids."""
        for piece, ids in zip(new, self.merge(new)):
            run = ",".join(map(str, ids))
            self.ids[piece] = run
            self.held += len(piece) + len(run)

    def decoded(self, run: str) -> bytes:
        """Bytes of ids joined by commas."""
        return b"".join(map(self.raw.__getitem__, run.split(","))) if run else b""

    def encode(self, text: str) -> list[int]:
        return [int(i) for p in self.blocks([text]) for _, run in p for i in run.split(",") if i]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace")

    def blocks(self, texts: Iterable) -> Iterator[Iterator[tuple[bytes, str]]]:
        """For each text (a string, or an Arrow one), runs of (decoded bytes, ids joined by commas). A long text has
        several runs. Of the texts of a block only the ids of known pieces are held, and the pieces that are new."""
        held: list[tuple[list[str | None], list[str]]] = []
        new: dict[str, None] = {}
        chars = 0
        for text in chain(texts, [None]):
            text = text.as_py() if isinstance(text, pa.Scalar) else text
            if held and (text is None or chars + len(text) > BLOCK_CHARS):
                self.learn([*new])
                for known, unknown in held:
                    rest = iter(unknown)
                    run = ",".join([self.ids[next(rest)] if k is None else k for k in known] if unknown else known)
                    yield iter([(self.decoded(run), run)])
                held, new, chars = [], {}, 0
                self._within_bounds()
            if text is None:
                return
            if len(text) > BLOCK_CHARS:
                yield self.long(text)
            else:
                pieces = self.pieces(text)
                if sum(map(len, pieces)) != len(text):
                    raise ValueError("the pieces of a text don't make it up")
                known = [*map(self.ids.get, pieces)]
                unknown = [p for p, k in zip(pieces, known) if k is None] if None in known else []
                new.update(dict.fromkeys(unknown))
                held.append((known, unknown))
                chars += len(text)

    def long(self, text: str) -> Iterator[tuple[bytes, str]]:
        rest = self.stream(text)
        while ps := list(islice(rest, LONG_PIECES)):
            self.learn([*{*ps}.difference(self.ids)])
            run = ",".join(map(self.ids.__getitem__, ps))
            yield self.decoded(run), run
            self._within_bounds()


@lru_cache(maxsize=2)
def encoder(path: str) -> PairIndexBPE:
    return PairIndexBPE(path)


def _columns(runs: Iterator[tuple[bytes, str]], outputs: list[str]) -> dict:
    if {"token_ids", "decoded"} & {*outputs}:
        runs = list(runs)
    out: dict = {}
    ids_sha, text_sha, n, tail, first = hashlib.sha256(), hashlib.sha256(), 0, b"", True
    for raw, ids in runs:
        if ids:
            ids_sha.update((ids if first else "," + ids).encode())
            n, first = n + ids.count(",") + 1, False
        text_sha.update(raw)  # ids of a whole text give whole characters again, so replacement never applies
    if "token_ids" in outputs:
        out["token_ids"] = [int(i) for _, ids in runs for i in ids.split(",") if i]
    if "decoded" in outputs:
        out["decoded"] = b"".join(raw for raw, _ in runs).decode("utf-8", "replace")
    return out | {"n_tokens": n, "ids_sha256": ids_sha.hexdigest(), "decoded_sha256": text_sha.hexdigest()}


def encode_bpe(docs: DataFrame, tokenizer_path: str, text: str = "text", keys: tuple[str, ...] = ("doc_id",), outputs: tuple[str, ...] = ("token_ids", "n_tokens")) -> DataFrame:
    """One row per row of docs: its key columns, then the outputs asked for, of OUTPUTS.

    token_ids are those of the tokenizers library without added special tokens (strings of special tokens in a text
    are their tokens); decoded is the text of these ids. Null is an empty text: no ids, decoded empty. Texts are
    read whole; a text of over BLOCK_CHARS characters passes in runs of pieces. Repeated rows each give their row;
    other columns of docs aren't read. tokenizer_path is a local file on every executor.
    """
    outputs = list(outputs)
    if clash := {*outputs} & {*keys}:
        raise ValueError(f"key columns named like outputs: {sorted(clash)}")
    rows = docs.select(*[docs[k] for k in keys], F.coalesce(docs[text], F.lit("")).alias("__text"))
    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys) + ", " + ", ".join(f"{o} {SQL_TYPES[o]}" for o in outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer_path)
        for batch in batches:
            made = [_columns(r, outputs) for r in bpe.blocks(batch.column("__text"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *(pa.array([m[o] for m in made], OUTPUTS[o]) for o in outputs)], names=[*keys, *outputs])
        bpe.forget(KEPT_PIECES)

    return arrow_map(rows, run, schema)


def decode_bpe(tokens: DataFrame, tokenizer_path: str, ids: str = "token_ids", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row: key columns and decoded, the text of the ids with bytes that aren't UTF-8 replaced. Null ids give null; an unknown id raises KeyError."""
    schema = ", ".join(f"`{k}` {tokens.schema[k].dataType.simpleString()}" for k in keys) + ", decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer_path)
        for batch in batches:
            texts = [None if x is None else bpe.decode(x) for x in batch.column("__ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(texts, pa.string())], names=[*keys, "decoded"])

    return arrow_map(tokens.select(*[tokens[k] for k in keys], tokens[ids].alias("__ids")), run, schema)
