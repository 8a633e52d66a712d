"""Fill-in-the-middle: texts are cut into prefix, middle and suffix at unit boundaries and put together in another order.

A text is decoded to an array of code points; each code point has a class, and units end where neighbours' classes
differ. Which boundaries are taken depends on the seed and the id alone, so a retried task, another partitioning or a
second run cut alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibrant.llm.common import arrow_map

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many are cut, and of 100 that are cut so many start with the suffix.
CUT, SUFFIX_FIRST = 90, 20
#: Characters of results that a task holds before it hands them on.
BLOCK_CHARS = 4_000_000

WHITE = np.array([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D], dtype=np.uint32)


def _lines(points: np.ndarray) -> np.ndarray:
    ends = points == 0x0A
    return np.cumsum(ends) - ends  # a line end belongs to its line


def _kinds(points: np.ndarray) -> np.ndarray:
    lower = points | 0x20
    letter = (lower >= 0x61) & (lower <= 0x7A) & (points < 0x80) | (points >= 0x80)
    digit = (points >= 0x30) & (points <= 0x39)
    return np.select([np.isin(points, WHITE), letter, digit], [0, 1, 2], 3)


#: The class of each code point: a unit is a run of one class. Of chars every place is a class of its own.
CLASSES: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "chars": lambda points: np.arange(len(points)),
    "words": lambda points: np.isin(points, WHITE).astype(np.int8),
    "kinds": _kinds,
    "lines": _lines,
}

SCHEMA = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string, restored string, output_sha256 string, restored_sha256 string"


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def text_of(points: np.ndarray) -> str:
    return points.tobytes().decode("utf-32-le", "surrogatepass")


def boundaries(points: np.ndarray, unit: str) -> np.ndarray:
    """Places at which units begin, and the end; of no code points the start alone."""
    classes = CLASSES[unit](points)
    inner = np.flatnonzero(classes[1:] != classes[:-1]) + 1
    return np.concatenate(([0], inner, [len(points)])) if len(points) else np.zeros(1, dtype=np.int64)


def drawn(id: object, seed: str) -> tuple[int, int, int, int]:
    """Four numbers of a text's id (null: as an empty one): the first groups of eight digits of a hex digest."""
    digest = sha256(f"{seed}:{'' if id is None else id}".encode()).hexdigest()
    return tuple(int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))


def transform(text: str, id: object, unit: str = "chars", seed: str = "1", cut: int = CUT, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of prefix and middle, output)."""
    points = points_of(text)
    at = boundaries(points, unit)
    n = len(at) - 1
    h1, h2, h3, h4 = drawn(id, seed)
    if not n or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= cut:
        return n, "plain", None, None, text
    a, b = sorted((int(at[h1 % (n + 1)]), int(at[h2 % (n + 1)])))
    prefix, middle, suffix = text_of(points[:a]), text_of(points[a:b]), text_of(points[b:])
    if h4 % 100 < suffix_first:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text of an output, exactly. Texts that hold a mark are never cut, and no mark begins inside another, so each
    mark's first place is its own."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    two = output.index(second, len(first))
    three = output.index(MIDDLE, two + len(second))
    one, other, middle = output[len(first) : two], output[two + len(second) : three], output[three + len(MIDDLE) :]
    return f"{one}{middle}{other}" if form == "psm" else f"{other}{middle}{one}"


def fill_in_middle(docs: DataFrame, id: str = "doc_id", text: str = "text", unit: str = "chars", seed: str = "1", cut: int = CUT, suffix_first: int = SUFFIX_FIRST, outputs: tuple[str, ...] = ("n", "form", "prefix_chars", "middle_chars", "output")) -> DataFrame:
    """doc_id and outputs for every row of docs; outputs may also be restored (the text rebuilt from output and form) and
    the hex SHA-256 of either.

    n counts units: chars (code points), words (runs of white space and of what lies between), kinds (runs of white space,
    letters, digits, others) or lines (with their ends). A null text is empty. form is plain (the text as it is) if the text
    is empty, holds one of the marks, or isn't among the `cut` of 100 that its id draws; else psm or, for `suffix_first` of
    100, spm. Of plain texts prefix_chars and middle_chars are null. Pieces may be empty. Rows of a repeated id draw the
    same numbers; a null id draws as an empty one. Whole texts are cut, however long; a table without rows gives none, and
    other columns aren't read.
    """
    if unit not in CLASSES:
        raise ValueError(f"unit: {unit}")
    known = dict(part.split(" ") for part in SCHEMA.split(", "))
    if unknown := set(outputs) - set(known):
        raise ValueError(f"outputs: {sorted(unknown)}")
    rows = docs.select(docs[id].alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("__text"))
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, " + ", ".join(f"{c} {known[c]}" for c in outputs)
    rebuilt = {"restored", "restored_sha256"} & set(outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, kind = batch.column(0), batch.schema.field(0).type
            made: list[dict] = []
            first = size = 0

            def flushed(upto: int) -> pa.RecordBatch:
                columns = [ids.slice(first, upto - first).cast(kind)]  # noqa: B023
                types = {"bigint": pa.int64(), "string": pa.string()}
                columns += [pa.array([m[c] for m in made], types[known[c]]) for c in outputs]  # noqa: B023
                return pa.RecordBatch.from_arrays(columns, names=["doc_id", *outputs])

            for k in range(batch.num_rows):
                own = batch.column(1)[k].as_py()
                n, form, prefix, middle, output = transform(own, ids[k].as_py(), unit, seed, cut, suffix_first)
                row = {"n": n, "form": form, "prefix_chars": prefix, "middle_chars": middle, "output": output}
                if rebuilt:
                    row["restored"] = restore(output, form)
                for c in ("output", "restored"):
                    if f"{c}_sha256" in outputs:
                        row[f"{c}_sha256"] = sha256(row[c].encode("utf-8", "surrogatepass")).hexdigest()
                made.append({c: row[c] for c in outputs})
                size += len(output) if {"output", "restored"} & set(outputs) else 0
                if size >= BLOCK_CHARS:
                    yield flushed(k + 1)
                    made, first, size = [], k + 1, 0
            if made:
                yield flushed(batch.num_rows)

    return arrow_map(rows, run, schema)
