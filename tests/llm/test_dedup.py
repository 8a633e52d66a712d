import hashlib
from collections import defaultdict

import numpy as np
import pytest

from calibrant.llm.components import components
from calibrant.llm.exact_dedup import MergeTree, exact_dedup
from calibrant.llm.near_dedup import min_overlap, near_components, shingle_hashes


def fold(t):
    return (t or "").encode().lower().decode()


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_groups_by_brute_force(messy, keep):
    rows = messy.collect()
    groups = defaultdict(list)
    for r in rows:
        groups[fold(r["text"])].append(r["doc_id"])
    expected = []
    for r in rows:
        ids = [i for i in groups[fold(r["text"])] if i is not None]
        best = (min if keep == "smallest" else max)(ids) if ids else None
        expected.append((r["doc_id"], best, len(groups[fold(r["text"])]), r["doc_id"] == best, hashlib.sha256(fold(r["text"]).encode()).hexdigest()))
    got = [tuple(r) for r in exact_dedup(messy, keep=keep, memtable_rows=3).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_memtables_of_one_row_still_meet(messy, monkeypatch):
    one = exact_dedup(messy.repartition(6), keep="largest").orderBy("doc_id", "keep_id").collect()
    assert one == exact_dedup(messy.coalesce(1), keep="largest").orderBy("doc_id", "keep_id").collect()


def test_merge_tree_keeps_smallest_identifiers():
    rng = np.random.default_rng(1)
    tree, truth = MergeTree(memtable_rows=5), {}
    for i in rng.permutation(300).tolist():
        d = hashlib.sha256(bytes([i % 40])).digest()
        assert tree.held([d])[0] == (d in truth)
        tree.insert(d, i)
        truth[d] = (min(truth.get(d, (i, 0))[0], i), truth.get(d, (i, 0))[1] + 1)
    tree.flush()
    tree.compact()
    keys, ids, counts, _ = tree.runs[0]
    assert {k.ljust(32, b"\0"): (i, c) for k, i, c in zip(keys.tolist(), ids, counts.tolist())} == truth


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(50, 40), (40, 60), (7, 7), (None, 3), (40, 50)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 1 for i in range(2, 31)}, 50: 40, 60: 40}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute(rows, words, percent):
    sets = []
    for r in rows:
        w = fold(r["text"]).encode().split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and rows[i]["doc_id"] is not None and rows[j]["doc_id"] is not None and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            least[find(i)] = min(least.get(find(i), r["doc_id"]), r["doc_id"])
    out = []
    for i, r in enumerate(rows):
        c = least[find(i)] if r["doc_id"] is not None else None
        out.append((r["doc_id"], len(sets[i]), c, c is None or c == r["doc_id"]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("words", [4, 5])
def test_near_components_by_brute_force(messy, words):
    got = [tuple(r) for r in near_components(messy, words=words).collect()]
    assert sorted(got, key=repr) == brute(messy.collect(), words, 80)


def test_a_group_of_edited_copies_by_brute_force(spark):
    """Copies with few and many edits, some linked through others only, around a passage that others share too."""
    rng = np.random.default_rng(5)
    passage = [f"p{i}" for i in range(50)]
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(60):
        ws = list(base)
        for k in rng.integers(0, 150, int(rng.integers(0, 12))):
            ws[k] = f"e{i}_{k}"
        rows.append((i, " ".join(ws)))
    rows += [(100 + i, " ".join([f"o{i}_{k}" for k in range(60)] + passage)) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [tuple(r) for r in near_components(df, words=4, k=32).collect()]
    assert sorted(got, key=repr) == brute(df.collect(), 4, 80)


def test_rows_of_one_id_with_other_texts_are_apart(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(5, a), (5, b), (3, b + " tail"), (9, a + " tail"), (None, a), (5, a), (2, "c d"), (2, "e f g h i j")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [tuple(r) for r in near_components(df, words=4).collect()]
    assert sorted(got, key=repr) == brute(df.collect(), 4, 80)
    assert {(i, c) for i, _, c, _ in got if i in (5, 9, 3)} == {(5, 5), (5, 3), (3, 3), (9, 5)}


def test_bounds():
    assert 0 < min_overlap(64, 80) < 0.8 * 64 and min_overlap(64, 80) < min_overlap(64, 90)
    assert len(shingle_hashes(b"a b c", 4)) == 1 and len(shingle_hashes(b" ", 4)) == 0


def test_empty_tables(empty):
    assert exact_dedup(empty).count() == 0
    assert near_components(empty).count() == 0
