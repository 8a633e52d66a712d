import zlib

import pytest

from calibrant.llm.common import table
from calibrant.llm.sharding import kd_shards


def check(rows, docs, shards):
    assert len(rows) == len(docs)
    mine = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"], r["text_crc32"]) for r in rows)
    texts = [(d["doc_id"] if d["doc_id"] is not None else -1, (d["text"] or "").encode()) for d in docs]
    assert mine == sorted((i, len(t) + 8, zlib.crc32(t)) for i, t in texts)
    by = {}
    for r in rows:
        assert 0 <= r["shard"] < shards and r["law"] == "bytes" and r["grown_shard"] is None
        by.setdefault(r["shard"], []).append(r)
    for rs in by.values():
        assert sorted(r["slot"] for r in rs) == list(range(len(rs)))
    return {s: sum(r["size"] for r in rs) for s, rs in by.items()}


def test_messy_rows(messy):
    check(kd_shards(messy, shards=5, dims=("size", "lang", "source", "value")).collect(), messy.collect(), 5)


def test_bytes_are_near_equal(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = docs.collect()
    sizes = check(kd_shards(docs, shards=24).collect(), rows, 24)
    largest = max(len((r["text"] or "").encode()) for r in rows)
    assert len(sizes) == 24 and max(sizes.values()) - min(sizes.values()) <= largest


def test_copies_of_a_third_are_cut_too(spark):
    docs = spark.createDataFrame([(i, "same" if i % 3 else f"text {i}", "en", "s") for i in range(3000)], "doc_id bigint, text string, lang string, source string")
    sizes = check(kd_shards(docs, shards=8).collect(), docs.collect(), 8)
    assert max(sizes.values()) < 1.02 * min(sizes.values())


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_groups_of_equal_texts_stay_whole(spark, sf):
    """Every group that one shard can hold."""
    docs = table(spark, f"/root/testdata/{sf}", "documents")
    rows = kd_shards(docs, shards=24).collect()
    groups, sizes = {}, {}
    for r in rows:
        groups.setdefault((r["size"], r["text_crc32"]), []).append(r)
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
    leaf = sum(sizes.values()) / 24
    several = [g for g in groups.values() if len(g) > 1]
    whole = [g for g in several if sum(r["size"] for r in g) <= leaf]
    assert len(several) > 50 and whole == several and all(len({r["shard"] for r in g}) == 1 for g in whole)
    largest = max(r["size"] for r in rows)
    assert max(sizes.values()) < 1.05 * leaf + largest and min(sizes.values()) > 0.95 * leaf - largest


def test_heavy_groups_find_room(spark):
    """Groups of a half, a third and a fifth of a shard, and one of two shards: all but the last stay whole."""
    counts = {"half": 500, "third": 333, "fifth": 200, "other": 480, "more": 510, "two": 2000}
    texts = [f"{name:<24}" for name, n in counts.items() for _ in range(n)]
    texts += [f"single {i:<17}" for i in range(8000 - len(texts))]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string")
    rows = kd_shards(docs, shards=8).collect()
    sizes = check(rows, docs.collect(), 8)
    assert max(sizes.values()) < 1.02 * min(sizes.values())
    shards = {}
    for r in rows:
        shards.setdefault(texts[r["doc_id"]].strip(), set()).add(r["shard"])
    assert all(len(shards[g]) == 1 for g in counts if g != "two") and len(shards["two"]) > 1
    alone = spark.createDataFrame([(i, "a" if i < 50 else "b") for i in range(100)], "doc_id bigint, text string")
    assert sorted(check(kd_shards(alone, shards=2, dims=("size",)).collect(), alone.collect(), 2).values()) == [450, 450]  # groups and no rows beside them


def test_many_values_and_numbers_of_any_size(spark):
    """Ranks of many strings, and numbers far apart, below 0, null and NaN."""
    rows = [(i, f"text {i}", f"http://host/{i % 900:05d}", float("nan") if i % 50 == 0 else None if i % 51 == 0 else (i - 1000) * 1e12) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, url string, at double")
    sizes = check(kd_shards(docs, shards=8, dims=("url", "at")).collect(), docs.collect(), 8)
    assert max(sizes.values()) < 1.05 * min(sizes.values())
    placed = {r["doc_id"]: r["shard"] for r in kd_shards(docs, shards=2, dims=("url",)).collect()}
    below = max(r[2] for r in rows if placed[r[0]] == 0)
    assert below <= min(r[2] for r in rows if placed[r[0]] == 1)


def test_target_bytes_and_empty(messy, empty):
    total = sum(len((r["text"] or "").encode()) + 8 for r in messy.collect())
    assert kd_shards(messy, target_bytes=total // 3, dims=("size",)).select("shard").distinct().count() <= 4
    assert kd_shards(empty, shards=4).count() == 0
    with pytest.raises(ValueError):
        kd_shards(messy)


def plain_tree(docs, shards, share):
    """A k-d build over a list of rows, node by node: the shard of each row."""
    import xxhash

    def spark_hash(seed, *values):
        h = seed
        for v, n in values:
            h = h if v is None else xxhash.xxh64_intdigest(v if n is None else v.to_bytes(n, "little", signed=True), seed=h & (2**64 - 1))
        return h

    signed = lambda x: x - 2**64 if x >= 2**63 else x
    ranks = {d: {v: i + 1 for i, v in enumerate(sorted({r[d] for r in docs if r[d] is not None}))} for d in ("lang", "source")}
    rows = []
    for r in docs:
        text = (r["text"] or "").encode()
        t = spark_hash(42, (text, None))
        rows.append({"id": r["doc_id"], "t": t, "v": [len(text) + 8, ranks["lang"].get(r["lang"], 0), ranks["source"].get(r["source"], 0)]})
    lo, hi = ([f(r["v"][k] for r in rows) for k in range(3)] for f in (min, max))
    total = sum(r["v"][0] for r in rows)
    groups = {}
    for r in rows:
        groups.setdefault((r["t"], r["v"][0]), []).append(r)
    for (t, size), g in groups.items():
        unit = len(g) > 1 and len(g) * size <= int(share * (total // shards))
        heavy = len(g) > 1 and int(share * (total // shards)) < len(g) * size <= total // shards
        least = [size, *(min(r["v"][k] for r in g) for k in (1, 2))]
        for r in g:
            own = [spark_hash(42, (signed(t), 8) if unit else (r["id"], 8), (k, 4)) for k in range(3)]
            v = least if unit else r["v"]
            r["group"] = (t - 2**64 if t >= 2**63 else t, size, len(g) * size) if heavy else None
            place = [min(2**24 - 1, int((v[k] - lo[k]) * ((2**24 - 1) / (hi[k] - lo[k])))) if hi[k] > lo[k] else 0 for k in range(3)]
            r["x"] = [(place[k] << 38) + ((t >> 44) << 18) + (own[k] >> 46) for k in range(3)]
    light = [r for r in rows if r["group"] is None]
    spread = [max(1, max(r["x"][k] for r in light) - min(r["x"][k] for r in light)) for k in range(3)]
    home = {}

    def split(node, groups, shard, n):
        for r in node:
            r["shard"] = shard
        home.update(dict.fromkeys(groups, shard))
        if n == 1 or not node and not groups:
            return
        left = n // 2
        whole = sum(r["v"][0] for r in node) + sum(g[2] for g in groups)
        goal = whole * left // n
        room, sides = [goal, whole - goal], ([], [])
        for g in sorted(groups, key=lambda g: (-g[2], g)):
            k = 0 if room[0] >= room[1] else 1
            sides[k].append(g)
            room[k] -= g[2]
        if not node:
            split([], sides[0], shard, left)
            split([], sides[1], shard + left, n - left)
            return
        width = [(max(r["x"][k] for r in node) - min(r["x"][k] for r in node)) / spread[k] for k in range(3)]
        k = max(range(3), key=lambda k: (width[k], -k))
        goal, upto = min(max(room[0], 0), sum(r["v"][0] for r in node)), 0
        weights = {}
        for r in node:
            weights[r["x"][k]] = weights.get(r["x"][k], 0) + r["v"][0]
        for x in sorted(weights):
            before, upto = upto, upto + weights[x]
            if upto >= goal:
                cut = x if upto - goal <= goal - before else x - 1
                break
        split([r for r in node if r["x"][k] <= cut], sides[0], shard, left)
        split([r for r in node if r["x"][k] > cut], sides[1], shard + left, n - left)

    split(light, {r["group"] for r in rows if r["group"]}, 0, shards)
    return {r["id"]: home[r["group"]] if r["group"] else r["shard"] for r in rows}


@pytest.mark.parametrize("shards", [3, 8])
def test_against_a_plain_build(spark, monkeypatch, shards):
    from calibrant.llm import sharding

    monkeypatch.setattr(sharding, "TOLERANCE", 0)
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    got = {r["doc_id"]: r["shard"] for r in kd_shards(docs, shards=shards).collect()}
    assert got == plain_tree(docs.collect(), shards, sharding.GROUP_SHARE)
