"""Benchmark decontamination by a prefix-filtered set join, with DataFrame operations only.

A window is so many consecutive words of an item. Containment of a window is
whole or nothing, so a prefix of one token is enough: its rarest shingle. A
document that has the window has that shingle too, at a known distance from the
window's start.
1. The windows' shingles are ordered by rarity over the benchmark: by the
   windows that have them, then by those that have their rarest word. Each window
   keeps the first one alone.
2. One pass over the documents joins their shingles with these prefixes. Length
   and position bounds leave places where a window may start.
3. Places are dealt by stretches of the text, so that neither one document nor
   one hot shingle has to be held in a row; there the words are compared.
4. Overlapping windows are merged into runs of hit words in order of place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from calibrant.llm.common import BROADCAST_IDS, ascii_lower, dropped, stored, with_ids

#: What parts words: ASCII but for digits and letters, after A-Z have been lower-cased.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE = 5
#: Words of a stretch of text in which places are compared together.
STRETCH = 2_048
#: Stands for a shingle that every document has; its match carries the document's number of words.
MARK = -(1 << 62) - 1
NO_ID = -(1 << 63)


def word_list(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), BREAKS), lambda w: w != "")


def _hashes(words: str, count: str, size: int, last: Column | None = None) -> Column:
    """Hashes of the runs of so many word hashes in the column `words` of `count` entries; then last."""
    runs = F.transform(F.sequence(F.lit(0), F.col(count) - size), lambda i: F.xxhash64(*[F.get(F.col(words), i + j) for j in range(size)]))
    none = F.array().cast("array<bigint>") if last is None else F.array(last)
    return F.when(F.col(count) >= size, runs if last is None else F.concat(runs, none)).otherwise(none)


def windows(items: DataFrame, length: int, id: str = "item_id", text: str = "text") -> DataFrame:
    """(words, n, items) for each distinct window: its words joined by blanks, how many, and the ids, as strings, of the
    items that have it. An item of fewer words, but not none, is one window."""
    ws = items.select(items[id].cast("string").alias("item"), word_list(items[text]).alias("ws")).where(F.size("ws") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("ws") - length, F.lit(0)))
    cut = F.transform(starts, lambda s: F.concat_ws(" ", F.transform(F.sequence(s, F.least(s + length, F.size("ws")) - 1), lambda i: F.get("ws", i))))
    return ws.select("item", F.explode(cut).alias("words")).groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items")).select("words", F.size(F.split("words", " ")).alias("n"), "items")


def prefixes(wins: DataFrame) -> DataFrame:
    """(win, n, size, offset, token): each window's rarest shingle and where in the window it is. A shingle is of SHINGLE
    words, or the whole of a window of fewer."""
    hashed = wins.select("win", "n", F.least("n", F.lit(SHINGLE)).alias("size"), F.transform(F.split("words", " "), lambda w: F.xxhash64(w)).alias("h"))
    sizes = [r[0] for r in hashed.select("size").distinct().collect()]
    common = stored(hashed.select("win", F.explode(F.array_distinct("h")).alias("word")).groupBy("word").agg(F.count("*").alias("of_word")), "decon-words")
    n_words = common.count()
    common = F.broadcast(common) if n_words <= BROADCAST_IDS // 4 else common  # 8 MB: two numbers a word
    parts = []
    for s in sizes:
        own = hashed.where(F.col("size") == s).select("win", "n", "size", F.posexplode(_hashes("h", "n", s)).alias("offset", "token"), "h")
        parts.append(own.select("win", "n", "size", "offset", "token", F.explode(F.array(*[F.get("h", F.col("offset") + j) for j in range(s)])).alias("word")))
    if not parts:
        return hashed.select("win", "n", "size", F.lit(0).alias("offset"), F.lit(0).cast("bigint").alias("token")).where("false")
    words = parts[0]
    for p in parts[1:]:
        words = words.union(p)
    tokens = words.join(common, "word").groupBy("win", "n", "size", "offset", "token").agg(F.min("of_word").alias("of_word"))
    often = tokens.select("size", "token", "win").distinct().groupBy("size", "token").agg(F.count("*").alias("of_token"))
    first = tokens.join(often, ["size", "token"]).groupBy("win", "n", "size").agg(F.min(F.struct("of_token", "of_word", "token", "offset")).alias("t"))
    return first.select("win", "n", "size", "t.offset", "t.token")


def _stretches(texts: DataFrame, keys: list[str], length: int) -> DataFrame:
    """(keys, stretch, part): the words from stretch * STRETCH on, so many and those of a window more, joined by blanks."""
    ws = texts.select(*keys, word_list(F.col("text")).alias("ws"))
    n = F.size("ws")
    starts = F.sequence(F.lit(0), F.floor((n - 1) / STRETCH).cast("int"))
    cut = F.transform(starts, lambda k: F.concat_ws(" ", F.transform(F.sequence(k * STRETCH, F.least(k * STRETCH + (STRETCH + length), n) - 1), lambda i: F.get("ws", i))))
    # Not a filter: it would be carried below the join that leaves few texts.
    return ws.select(*keys, F.posexplode(F.when(n > 0, cut).otherwise(F.array().cast("array<string>"))).alias("stretch", "part"))


def contamination(docs: DataFrame, items: DataFrame, length: int = 13, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", share: int = 20) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, items (sorted ids as strings), spans (start and end word of
    each run of hit words, in order), contaminated.

    A word inside any occurrence of a window of an item is hit; contaminated: n_hit > 0 and share * n_hit >= n_words.
    Words are maximal runs of digits, a-z and non-ASCII characters after A-Z have been lower-cased. Null or empty
    texts have no words; items without words have no window, and a null item id names nothing but still hits. Ids of
    docs may be null or repeat: rows count by id and text. Empty tables give no hits. Other columns aren't read.
    """
    key = ["doc_id", "row"]
    wins = stored(windows(items, length, item_id, item_text).withColumn("win", F.monotonically_increasing_id()), "decon-windows")
    prefix = stored(prefixes(wins), "decon-prefixes")
    n_prefix = prefix.count()
    small = n_prefix <= BROADCAST_IDS // 10  # 8 MB: a prefix is four numbers
    sizes = sorted({SHINGLE, *(r[0] for r in prefix.select("size").distinct().collect())})

    plain = docs.select(F.coalesce(docs[id].cast("bigint"), F.lit(NO_ID)).alias("doc_id"), docs[text].alias("text"))
    hashed = plain.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), F.transform(word_list(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    counted = hashed.select(*key, F.size("h").alias("n_words"), "h")
    mark = docs.sparkSession.range(1).select(F.lit(MARK).alias("token"), F.lit(None).cast("bigint").alias("win"), F.lit(0).alias("n"), F.lit(0).alias("offset"))
    met = None
    for s in sizes:
        wanted = prefix.where(F.col("size") == s).select("token", "win", "n", "offset")
        wanted = wanted.union(mark) if s == SHINGLE else wanted
        each = counted.select(*key, "n_words", F.posexplode(_hashes("h", "n_words", s, F.lit(MARK) if s == SHINGLE else None)).alias("at", "token"))
        found = each.join(F.broadcast(wanted) if small else wanted, "token").withColumn("start", F.col("at") - F.col("offset"))
        found = found.where("win IS NULL OR (start >= 0 AND start + n <= n_words)").select(*key, "n_words", "start", "n", "win")
        met = found if met is None else met.union(found)
    met = stored(met, "decon-places")

    places = met.where("win IS NOT NULL").withColumn("stretch", F.floor(F.col("start") / STRETCH).cast("int"))
    dealt = stored(places.groupBy(*key, "stretch").agg(F.collect_set(F.struct("start", "n", "win")).alias("places")), "decon-stretches")
    ids = stored(dealt.select("doc_id").distinct(), "decon-ids")
    texts = with_ids(plain, ids, "left_semi").withColumn("row", F.xxhash64("doc_id", "text"))
    both = dealt.join(_stretches(texts, key, length), [*key, "stretch"]).select(*key, "stretch", "places", F.split("part", " ").alias("ws"))
    there = F.transform("places", lambda p: F.struct(p["start"].alias("start"), p["n"].alias("n"), p["win"].alias("win"), F.concat_ws(" ", F.transform(F.sequence(F.lit(0), p["n"] - 1), lambda i: F.get("ws", p["start"] - F.col("stretch") * STRETCH + i))).alias("words")))
    seen = both.select(*key, F.explode(there).alias("p")).select(*key, "p.*")
    hits = stored(seen.join(wins.select("win", "words"), ["win", "words"], "left_semi").select(*key, "start", "n", "win"), "decon-found")

    by_place = Window.partitionBy(*key).orderBy("start", "end")
    spans = hits.select(*key, "start", (F.col("start") + F.col("n")).alias("end")).distinct()
    spans = spans.withColumn("before", F.max("end").over(by_place.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("run", F.sum(F.when(F.col("start") <= F.col("before"), 0).otherwise(1)).over(by_place))
    runs = spans.groupBy(*key, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    runs = runs.groupBy(*key).agg(F.sum(F.col("end") - F.col("start")).cast("bigint").alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    named = hits.select(*key, "win").distinct().join(wins.select("win", F.explode_outer("items").alias("item")), "win").groupBy(*key).agg(F.array_sort(F.collect_set("item")).alias("items"))
    per = stored(runs.join(named, key), "decon-hits")
    dropped(wins, prefix, dealt, ids, hits)

    out = met.where("win IS NULL").select(*key, "n_words").join(per, key, "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return out.select(
        F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"),
        F.col("n_words").cast("bigint").alias("n_words"),
        n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        "spans",
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )
