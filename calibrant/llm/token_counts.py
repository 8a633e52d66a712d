"""Token counts as delta-maintained rollups.

A batch of signed changes (inserts, deletes, revised counts) is summed by
source, language and tokenizer version and committed under its id. The ledger
keeps totals: a version of them, and the batches committed since, which are
folded into the next version when there are enough. Documents are never looked
at again. A batch that was committed before is not applied again, and one of the
same id with other changes is refused; a batch whose write was cut short has no
commit mark, counts for nothing and is written anew.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calibrant.llm.bpe import PATTERN
from calibrant.llm.common import arrow_map, hadoop_path

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"
#: Batches that a reader sums beside the totals at most; then they are folded into a new version.
FOLD_AFTER = 8


#: White space from which on a text is split by the pattern here: the library's own splitter goes back over runs of it, and
#: fails where a run is very long.
LONG_SPACE = regex.compile(r"\s{10000}")
SPLIT = regex.compile(PATTERN)


@lru_cache(maxsize=4)
def counter(path: str) -> Callable[[str], int]:
    """Tokens of a text by the vocabulary at path: a .tiktoken file of ranks, a sentencepiece .model or a tokenizers .json."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        encoding = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

        def tokens(text: str) -> int:
            if not LONG_SPACE.search(text):
                return len(encoding.encode_ordinary(text))
            pieces = Counter(m[0] for m in SPLIT.finditer(text))
            return sum(n * len(encoding._encode_single_piece(piece)) for piece, n in pieces.items())

        return tokens
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(pieces.encode(text))
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False))


def token_counts(docs: DataFrame, tokenizers: dict[str, str], text: str = "text", keys: tuple[str, ...] = ("doc_id", "source", "lang")) -> DataFrame:
    """keys, and for each tokenizer (column name: path of its vocabulary on every executor) the tokens of the whole text.

    Strings of special tokens are ordinary text. Null and empty texts have 0 tokens. Repeated rows each give their row;
    other columns of docs aren't read, and an empty table gives no rows.
    """
    if clash := {*tokenizers} & {*keys}:
        raise ValueError(f"key columns named like counts: {sorted(clash)}")
    rows = docs.select(*[docs[k] for k in keys], F.coalesce(docs[text], F.lit("")).alias("__text"))
    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys) + ", " + ", ".join(f"`{n}` bigint" for n in tokenizers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = [counter(p) for p in tokenizers.values()]
        for batch in batches:
            made: list[list[int]] = [[] for _ in count]
            for x in batch.column("__text"):
                t = x.as_py()
                for c, out in zip(count, made):
                    out.append(c(t))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *(pa.array(m, pa.int64()) for m in made)], names=[*keys, *tokenizers])

    return arrow_map(rows, run, schema)


def inserts(rows: DataFrame, tokenizer: str, tokens: str) -> DataFrame:
    """Signed changes for rows that are new: source, lang and the column `tokens` of rows."""
    return _changes(rows, tokenizer, F.lit(1), F.col(tokens))


def deletes(rows: DataFrame, tokenizer: str, tokens: str) -> DataFrame:
    """Signed changes for rows that go; `tokens` has what was counted last."""
    return _changes(rows, tokenizer, F.lit(-1), -F.col(tokens))


def revisions(rows: DataFrame, tokenizer: str, old: str, new: str) -> DataFrame:
    """Signed changes for rows whose count was `old` and is `new`."""
    return _changes(rows, tokenizer, F.lit(0), F.coalesce(new, F.lit(0)) - F.coalesce(old, F.lit(0)))


def _changes(rows: DataFrame, tokenizer: str, docs: Column, tokens: Column) -> DataFrame:
    return rows.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), docs.cast("bigint").alias("n_docs"), F.coalesce(tokens, F.lit(0)).cast("bigint").alias("n_tokens"))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


class TokenLedger:
    """Committed batches and versions of their totals, under a folder that all executors share. One writer at a time.

    Null sources and languages are groups of their own; null counts are 0; a repeated row counts each time it is
    in a batch; a batch without changes is committed too. Totals of groups that are back to no documents and no
    tokens stay out. A row of `batch=<id>` is a group's sum, so batches are as small as the totals.
    """

    def __init__(self, spark: SparkSession, path: str, fold_after: int = FOLD_AFTER):
        self.spark, self.path, self.fold_after = spark, path.rstrip("/"), fold_after

    def _names(self, start: str, mark: str) -> list[str]:
        """What follows start in the names of the ledger's folders that have the mark of a finished write."""
        fs, p = hadoop_path(self.spark, self.path)
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(n.removeprefix(start) for n in names if n.startswith(start) and fs.exists(hadoop_path(self.spark, f"{self.path}/{n}/{mark}")[1]))

    def committed(self) -> list[str]:
        return self._names("batch=", "_SUCCESS")

    def version(self) -> int:
        """The newest version of the totals; 0 is none."""
        return max(map(int, self._names("totals=", "batches/_SUCCESS")), default=0)

    def pending(self) -> list[str]:
        """Committed batches that the newest totals don't have."""
        v = self.version()
        folded = {r[0] for r in self.spark.read.parquet(f"{self.path}/totals={v}/batches").collect()} if v else set()
        return [b for b in self.committed() if b not in folded]

    def _mark(self, delta: DataFrame) -> tuple:
        return tuple(delta.agg(F.count("*"), F.sum(F.xxhash64(*delta.columns).cast("decimal(38,0)"))).first())

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply the changes once; False if this batch was committed before, an error if it had other changes."""
        if not batch_id or "/" in batch_id:
            raise ValueError(f"batch id: {batch_id!r}")
        path, delta = f"{self.path}/batch={batch_id}", _summed(changes)
        if batch_id in self.committed():
            if self._mark(delta) != self._mark(self.spark.read.schema(SCHEMA).parquet(path)):
                raise ValueError(f"batch {batch_id!r} was committed with other changes")
            return False
        delta.write.mode("overwrite").parquet(path)
        if len(self.pending()) >= self.fold_after:
            self.fold()
        return True

    def _rows(self) -> DataFrame:
        v = self.version()
        paths = [f"{self.path}/totals={v}/rows"] * bool(v) + [f"{self.path}/batch={b}" for b in self.pending()]
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def fold(self) -> int:
        """Write the next version of the totals, with the pending batches in it; its number. The list of batches is
        written last and is the version's mark. Versions before the last one are deleted."""
        batches, v = self.committed(), self.version() + 1
        _summed(self._rows()).write.mode("overwrite").parquet(f"{self.path}/totals={v}/rows")
        self.spark.createDataFrame([(b,) for b in batches], "batch string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/totals={v}/batches")
        for old in range(1, v - 1):
            hadoop_path(self.spark, f"{self.path}/totals={old}", delete=True)
        return v

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens."""
        return _summed(self._rows()).where("n_docs != 0 OR n_tokens != 0")
