"""Fill-in-the-middle: cuts, forms and the exact way back."""

from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from oracle import SF, rows_by_sql, rows_of

from calibrant.llm import queries
from calibrant.llm.fill_middle import boundaries, fill_in_middle, points_of, restore, transform


def test_query_gives_the_rows_of_its_sql(spark):
    assert rows_of(queries.op13_fill_middle(spark, SF)) == rows_by_sql(queries.ORACLE_SQL["op13_fill_middle"])


def test_units():
    text = "ab1  Cé,\nx\n\n日"
    def at(unit):
        x = boundaries(points_of(text), unit)
        return [text[a:b] for a, b in zip(x[:-1], x[1:])]

    assert at("chars") == list(text)
    assert at("words") == ["ab1", "  ", "Cé,", "\n", "x", "\n\n", "日"]
    assert at("kinds") == ["ab", "1", "  ", "Cé", ",", "\n", "x", "\n\n", "日"]
    assert at("lines") == ["ab1  Cé,\n", "x\n", "\n", "日"]
    assert boundaries(np.array([], dtype=np.uint32), "lines").tolist() == [0]


@given(st.text(), st.integers(-(1 << 63), (1 << 63) - 1), st.sampled_from(["chars", "words", "kinds", "lines"]))
def test_every_text_comes_back(text, id, unit):
    n, form, prefix, middle, output = transform(text, id, unit, cut=100, suffix_first=50)
    assert restore(output, form) == text
    assert (form == "plain") == (not text) and (form == "plain" or prefix + middle <= len(text))
    assert unit != "chars" or n == len(text)


@given(st.lists(st.sampled_from(["<", "P", "S", "M", ">", "a", "<<", "🎉"]), max_size=12), st.integers(0, 500))
def test_bits_of_marks_dont_mislead(parts, id):
    text = "".join(parts)
    _, form, _, _, output = transform(text, id, cut=100, suffix_first=50)
    assert restore(output, form) == text
    assert form == "plain" or not any(m in text for m in ("<P>", "<S>", "<M>"))


def test_messy_rows(spark, messy, empty):
    rows = fill_in_middle(messy, cut=100, outputs=("n", "form", "output", "restored", "output_sha256", "restored_sha256")).collect()
    texts = messy.select("doc_id", "text").collect()
    assert len(rows) == len(texts)
    for r, t in zip(rows, texts):
        text = t["text"] or ""
        assert (r["doc_id"], r["n"], r["restored"]) == (t["doc_id"], len(text), text)
        assert r["restored_sha256"] == sha256(text.encode()).hexdigest() and r["output_sha256"] == sha256(r["output"].encode()).hexdigest()
        assert (r["form"] == "plain") == (not text)
    assert fill_in_middle(empty).count() == 0


def test_long_texts_and_shares(spark):
    blanks = " " * 5_000_000
    rows = spark.createDataFrame([(k, f"text of {k} words") for k in range(2000)] + [(-1, blanks), (-2, "é" * 3_000_000)], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in fill_in_middle(rows, outputs=("n", "form", "restored_sha256")).collect()}
    assert got[-1]["n"] == 5_000_000 and got[-1]["restored_sha256"] == sha256(blanks.encode()).hexdigest()
    assert got[-2]["restored_sha256"] == sha256(("é" * 3_000_000).encode()).hexdigest()
    forms = [got[k]["form"] for k in range(2000)]
    assert 0.87 < 1 - forms.count("plain") / 2000 < 0.93 and 0.14 < forms.count("spm") / 2000 < 0.22


def test_unknown_units_and_outputs(messy):
    with pytest.raises(ValueError):
        fill_in_middle(messy, unit="verses")
    with pytest.raises(ValueError):
        fill_in_middle(messy, outputs=("n", "other"))
