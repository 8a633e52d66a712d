import re

from calibrant.llm.decontaminate import contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, length):
    wins = {}
    for r in items:
        w = words(r["text"])
        for s in range(max(1, len(w) - length + 1)) if w else []:
            wins.setdefault(tuple(w[s : s + length]), set()).update([str(r["item_id"])] if r["item_id"] is not None else [])
    out = []
    for r in docs:
        w, hit, found = words(r["text"]), set(), set()
        for n in {len(k) for k in wins}:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s : s + n])) in wins:
                    hit.update(range(s, s + n))
                    found |= wins[k]
        out.append((r["doc_id"], len(w), len(hit), tuple(sorted(found)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def test_against_brute_force(spark, messy):
    seq = [f"q{i}" for i in range(40)]
    items = spark.createDataFrame(
        [(1, " ".join(seq[:20])), (2, " ".join(seq[5:30])), (10, "One"), (3, "été CAFÉ-naïve"), (4, None), (5, "...."), (None, " ".join(seq[20:38])), (6, " ".join(seq[:20])), (7, "a a a a a a a a a a a a a a a")],
        "item_id bigint, text string",
    )
    more = spark.createDataFrame(
        [(50, " ".join(seq)), (51, "Q3, Q4; q5 " + " ".join(seq[5:18]) + " end"), (52, " ".join(["z"] * 400 + seq[2:15])), (53, " ".join(seq[:12])), (54, "a " * 40), (55, "x " + " ".join(seq[:13]) + " " + " ".join(seq[:13]))],
        "doc_id bigint, text string",
    )
    docs = messy.unionByName(more, allowMissingColumns=True)
    got = [(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in contamination(docs, items).collect()]
    assert sorted(got, key=repr) == brute(docs.collect(), items.collect(), 13)


def test_empty_tables(spark, messy, empty):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert contamination(empty, none).count() == 0
    out = contamination(messy, none).collect()
    assert len(out) == messy.count() and not any(r["contaminated"] or r["n_hit"] for r in out)


def test_a_long_text_of_one_word(spark):
    """A million equal words, every place of which may start a window; time and memory are linear in the text."""
    items = spark.createDataFrame([(7, "a " * 15), (8, "b " * 13)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, 1_000_000)], "doc_id bigint, k int").selectExpr("doc_id", "repeat('a ', k) || 'c' AS text")
    r = contamination(docs, items).first()
    assert (r["n_words"], r["n_hit"], r["items"], [tuple(s) for s in r["spans"]]) == (1_000_001, 1_000_000, ["7"], [(0, 1_000_000)])


def test_windows_over_the_ends_of_stretches(spark, monkeypatch):
    """Stretches shorter than the texts; windows that begin in one and end in the next."""
    from calibrant.llm import decontaminate

    monkeypatch.setattr(decontaminate, "STRETCH", 5)
    seq = [f"q{i}" for i in range(40)]
    items = spark.createDataFrame([(i, " ".join(seq[i : i + 13])) for i in range(0, 28, 3)] + [(99, "one two")], "item_id bigint, text string")
    rows = [(k, " ".join(["x"] * k + seq[k % 7 :] + ["one", "two"] * (k % 3))) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in contamination(docs, items).collect()]
    assert sorted(got, key=repr) == brute(docs.collect(), items.collect(), 13)
