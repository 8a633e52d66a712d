"""Secret scans: patterns of known forms, and strings in a sensitive context that dictionary-primed compression can't shorten.

A candidate's novelty is what it adds to the compressed size of the code around it: the surroundings are compressed with
and without it, by a compressor whose dictionary holds the corpus's own identifiers. Names that are made of known words
add little; keys add almost what they are long.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibrant.llm.common import arrow_map

#: Kinds of spans in the order in which spans of one start are listed. The patterns, and how long a match
#: (of assign: its value) has to be.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = ("assign", "access", "hex", "novel")
BASE = {
    "assign": (re.compile(ASSIGN, re.ASCII | re.IGNORECASE), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 16),
}
#: The same matches without the short ones: a run that is long enough is found from its start, and found whole.
QUICK = {"hex": re.compile(r"[0-9a-f]{16,}"), "access": re.compile(r"AKIA[A-Z0-9]{14,}")}

#: What makes a context sensitive, anywhere in NEAR characters before a candidate, on its line.
SENSITIVE = re.compile(r"passw|passphrase|secret|token|api.?key|access.?key|private.?key|credential|authori[sz]ation|bearer|signature|client.?key|encryption.?key", re.ASCII | re.IGNORECASE)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=~-]{16,}")
NEAR, BEFORE, AFTER = 64, 256, 128
#: Compressed bytes that a character of a candidate adds, from which on it is reported; of characters beyond KEY, which an
#: alphabet of few letters lets be packed, half a byte.
NOVELTY, KEY, PACKED = 0.9, 32, 0.5
#: Words of the dictionary, of so many letters and underscores each: at most 24 KB.
DICTIONARY_WORDS, WORD = 2_000, r"[A-Za-z_]{3,20}"
#: Words that code and settings are written with; the dictionary's last and so cheapest part. Fixed values.
CODE_WORDS = (
    "access account address algorithm application argument array async attribute authentication authorization backend base64 boolean bucket buffer "
    "bytes cache callback certificate class client cluster column command config configuration connection const constant container content context "
    "controller cookie credentials database datetime debug decode default definition delete description dictionary directory document domain element "
    "encode encryption endpoint engine environment error event example exception export factory false field file filter format frontend function "
    "generate handler hash header hostname identifier implementation import index input instance integer interface internal iterator json key language "
    "library list local location logger manager message metadata method middleware model module monitor name namespace network none null number object "
    "operation option output package parameter parent parser password path pattern permission pipeline policy port prefix private process production "
    "profile project property protocol provider proxy public query queue reference region register repository request resource response result return "
    "role route schema script secret security select self serializer server service session setting signature source standard static status storage "
    "stream string struct suffix system table target task template test text thread timeout timestamp token transaction transform true type undefined "
    "update upload user username utils validate value variable vector version volume window worker wrapper"
)

SCHEMA = "n_assign bigint, n_access bigint, n_hex bigint, n_novel bigint, base array<struct<kind:string,start:bigint,end:bigint>>, spans array<struct<kind:string,start:bigint,end:bigint>>, base_sha256 string, spans_text string"


def identifier_dictionary(docs: DataFrame, text: str = "text", words: int = DICTIONARY_WORDS) -> bytes:
    """The raw dictionary: the most frequent words of letters and underscores over all of docs, counted on the executors
    (the driver gets `words` rows), the commonest last, where a match is cheapest, and then CODE_WORDS. Words with digits
    never enter, so a key that was copied into many documents doesn't become known; nor do those of over 20 letters."""
    counted = docs.select(F.explode(F.regexp_extract_all(docs[text], F.lit(rf"(?<![A-Za-z0-9_+/=.-]){WORD}(?![A-Za-z0-9_+/=.-])"), F.lit(0))).alias("w")).groupBy("w").count()
    best = counted.orderBy(F.desc("count"), "w").limit(words).collect()
    return " ".join([*(r["w"] for r in reversed(best)), CODE_WORDS]).encode()


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind's place, end) of the matches of each kind, leftmost and without overlap in a kind, without short ones."""
    found = []
    for k, kind in enumerate(KINDS[:-1]):
        pattern, group, least = BASE[kind]
        for m in QUICK.get(kind, pattern).finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), k, m.end()))
    return sorted(found)


class Novelty:
    """Marginal compressed bytes under a dictionary; one compressor a task."""

    def __init__(self, dictionary: bytes):
        primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=3)
        self.size = lambda data, c=zstandard.ZstdCompressor(level=3, dict_data=primed, write_checksum=False, write_content_size=False): len(c.compress(data))

    def added(self, before: str, candidate: str, after: str) -> int:
        """Compressed bytes that candidate adds to its surroundings."""
        a, x, b = (s.encode("utf-8", "surrogatepass") for s in (before, candidate, after))
        return self.size(a + x + b) - self.size(a + b)


def _like_a_key(x: str, text: str, a: int, b: int) -> bool:
    """Long enough, of two of lower-case letters, capitals and digits, and no part of an address."""
    mixed = any(c.islower() for c in x) + any(c.isupper() for c in x) + any(c.isdigit() for c in x) > 1
    return len(x) >= 16 and mixed and text[a - 1 : a] != "@" and text[b : b + 1] != "@"


def novel_spans(text: str, known: list[tuple[int, int, str]], novelty: Novelty, level: float) -> list[tuple[int, int, int]]:
    """Candidates beside a sensitive word that aren't inside, and don't overlap, the known spans."""
    sensitive = [m.start() for m in SENSITIVE.finditer(text)]
    if not sensitive:
        return []
    found, taken, place, s = [], sorted((a, b) for a, _, b in known), 0, 0
    last = end_of_last = -1
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        while s < len(sensitive) and sensitive[s] < a:
            last, s = sensitive[s], s + 1
        if last < 0 or last < a - NEAR or "\n" in text[last:a]:
            continue
        while place < len(taken) and taken[place][0] < b:
            end_of_last, place = max(end_of_last, taken[place][1]), place + 1
        if end_of_last > a:
            continue
        x = m.group().lstrip("=.-/").rstrip(".-")  # a key may end with a slash or padding
        a += m.group().index(x)
        b = a + len(x)
        if not _like_a_key(x, text, a, b):
            continue
        if novelty.added(text[max(0, a - BEFORE) : a], x, text[b : b + AFTER]) >= level * min(len(x), KEY) + PACKED * max(0, len(x) - KEY):
            found.append((a, len(KINDS) - 1, b))
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def secret_scan(docs: DataFrame, dictionary: bytes | None = None, id: str = "doc_id", text: str = "text", level: float = NOVELTY, outputs: tuple[str, ...] = ("n_assign", "n_access", "n_hex", "n_novel", "spans")) -> DataFrame:
    """doc_id and outputs for every row of docs: counts by kind, spans (kind, start, end in code points, end exclusive, in
    order of start and kind), base (those of patterns alone), base_sha256 and spans_text (kind:start:end, comma-joined).

    Patterns' spans are all kept, whatever their novelty; strings of 16 characters or more of a key's alphabet are added
    where a sensitive word stands up to 64 characters before on their line, no pattern overlaps them, and they add `level`
    bytes for each of their own to the compressed surroundings (half a byte for those beyond the 32nd). Only those of
    two of lower-case letters, capitals and digits are candidates, and no part of an address. dictionary: bytes that
    the compressor is primed with (None: identifier_dictionary of docs). Null and empty texts have no spans. Rows are
    judged one by one: repeated rows give equal rows, ids may be null or repeat. A table without rows gives none; other
    columns aren't read. Whole texts are scanned, however long; a task holds a batch of texts and its spans.
    """
    known = dict(re.findall(r"(\w+) ((?:array<struct<.*?>>)|\w+)", SCHEMA))
    if unknown := set(outputs) - set(known):
        raise ValueError(f"outputs: {sorted(unknown)}")
    primed = identifier_dictionary(docs, text) if dictionary is None else dictionary
    rows = docs.select(docs[id].alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("__text"))
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, " + ", ".join(f"{c} {known[c]}" for c in outputs)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    types = {"bigint": pa.int64(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(primed)
        for batch in batches:
            made = {c: [] for c in outputs}
            for value in batch.column(1):
                own = value.as_py()
                base = base_spans(own)
                every = sorted([*base, *novel_spans(own, base, novelty, level)])
                row = {f"n_{kind}": sum(x[1] == k for x in every) for k, kind in enumerate(KINDS)}
                listed = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans]
                for c in outputs:
                    made[c].append(listed(base) if c == "base" else listed(every) if c == "spans" else sha256(joined(base).encode()).hexdigest() if c == "base_sha256" else joined(every) if c == "spans_text" else row[c])
            arrays = [pa.array(made[c], types.get(known[c], pa.list_(span))) for c in outputs]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", *outputs])

    return arrow_map(rows, run, schema)
