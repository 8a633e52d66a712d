from collections import defaultdict

import pytest
from oracle import rows_by_sql, rows_of
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from calibrant.llm import token_counts as tc
from calibrant.llm.common import hadoop_path, shared_path, table
from calibrant.llm.queries import BYTE_BPE, ORACLE_SQL, QUERIES, VERSIONS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def counted(messy):
    return tc.token_counts(messy, {"a": VERSIONS["v1"], "b": VERSIONS["v2"]}, keys=("doc_id", "source", "lang", "value"))


def library():
    own = Tokenizer.from_file(BYTE_BPE)
    own.encode_special_tokens = True
    return lambda t: len(own.encode(t or "", add_special_tokens=False).ids)


def test_counts_are_those_of_another_library(messy, counted, empty):
    count, texts = library(), {r["value"]: r["text"] for r in messy.collect()}
    rows = counted.collect()
    assert len(rows) == len(texts) and all(r["a"] == count(texts[r["value"]]) for r in rows)
    assert tc.counter(BYTE_BPE)("<|endoftext|> a") == count("<|endoftext|> a") > 3
    assert tc.token_counts(empty, {"a": VERSIONS["v1"]}).count() == 0
    with pytest.raises(ValueError):
        tc.token_counts(messy, {"lang": VERSIONS["v1"]})


def test_very_long_white_space(spark):
    """Runs of blanks and line ends that the library's own splitter fails on, among them one before a word."""
    texts = [" " * 5_000_000, "\n" * 1_000_000 + "word", "a" + " " * 20_000 + "b \n" * 3, " " * 9_999 + "x", "\t" * 10_001]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string")
    counted = {r["doc_id"]: r for r in tc.token_counts(docs, {"a": VERSIONS["v1"], "b": VERSIONS["v2"]}, keys=("doc_id",)).collect()}
    count = library()
    assert all(counted[k]["a"] == count(t) for k, t in enumerate(texts) if len(t) < 50_000)
    assert counted[0]["a"] > 0 and counted[1]["a"] > 1 and all(r["b"] > 0 for r in counted.values())


def test_both_ways_of_splitting_agree(monkeypatch):
    import regex

    plain, texts = tc.counter(VERSIONS["v1"]), ["  a  b\n\n c", "don't   <|endoftext|>\t\t", "日本 \u00a0\u2003 x  ", "    "]
    expected = [plain(t) for t in texts]
    monkeypatch.setattr(tc, "LONG_SPACE", regex.compile(r"\s"))
    assert [plain(t) for t in texts] == expected


@pytest.mark.parametrize("fold_after", [1, 2, 100])
def test_deltas_and_replays(spark, counted, fold_after):
    rows = counted
    ledger = tc.TokenLedger(spark, shared_path(spark, "ledger"), fold_after)
    assert ledger.totals().count() == 0
    assert ledger.commit("one", tc.inserts(rows, "t@1", "a"))
    before = ledger.totals().collect()
    assert not ledger.commit("one", tc.inserts(rows, "t@1", "a"))
    assert {tuple(r) for r in ledger.totals().collect()} == {tuple(r) for r in before}
    with pytest.raises(ValueError, match="other changes"):
        ledger.commit("one", tc.inserts(rows, "t@1", "b"))
    ledger.commit("two", tc.revisions(rows, "t@1", "a", "b"))
    total = sum(r["b"] for r in rows.collect())
    assert ledger.totals().groupBy().sum("n_tokens", "n_docs").first()[:] == (total, rows.count())
    ledger.commit("three", tc.deletes(rows, "t@1", "b"))
    assert ledger.totals().count() == 0
    ledger.commit("none", tc.inserts(rows.where("false"), "t@1", "a"))
    assert ledger.committed() == ["none", "one", "three", "two"]
    assert ledger.version() == {1: 4, 2: 2, 100: 0}[fold_after]
    with pytest.raises(ValueError):
        ledger.commit("a/b", rows)


def test_a_write_that_was_cut_short_counts_for_nothing(spark, counted):
    ledger = tc.TokenLedger(spark, shared_path(spark, "ledger"))
    ledger.commit("one", tc.inserts(counted, "t@1", "a"))
    before = {tuple(r) for r in ledger.totals().collect()}
    hadoop_path(spark, f"{ledger.path}/batch=one/_SUCCESS", delete=True)
    assert ledger.totals().count() == 0
    assert ledger.commit("one", tc.inserts(counted, "t@1", "a"))
    ledger.fold()
    hadoop_path(spark, f"{ledger.path}/totals=1/batches/_SUCCESS", delete=True)  # a fold that was cut short
    assert ledger.version() == 0 and {tuple(r) for r in ledger.totals().collect()} == before
    assert ledger.fold() == 1 and {tuple(r) for r in ledger.totals().collect()} == before


def test_query_by_brute_force(spark):
    rows, count = table(spark, SF, "documents").collect(), library()
    best = defaultdict(int)
    for r in rows:
        best[r["text"] or ""] = max(best[r["text"] or ""], r["doc_id"])
    expected = defaultdict(lambda: [0, 0])
    for r in rows:
        if best[r["text"] or ""] == r["doc_id"]:
            got = expected[r["source"], r["lang"]]
            got[0] += 1
            got[1] += count(r["text"])
    out = QUERIES["op3_token_counts"](spark, SF)
    assert {(r["source"], r["lang"]): [r["n_docs"], r["n_tokens"]] for r in out.where("tokenizer = 'byte_bpe@1'").collect()} == dict(expected)
    other = out.where(F.col("tokenizer") == "byte_bpe_multi@1").agg(F.sum("n_docs")).first()[0]
    assert other == len(best)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_give_the_rows_of_their_sql(spark, name):
    assert rows_of(QUERIES[name](spark, SF)) == rows_by_sql(ORACLE_SQL[name])
