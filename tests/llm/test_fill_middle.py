"""Fill in the middle: outputs by the definition, ropes against strings, the inverse, odd rows."""

import hashlib
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from marginalia.llm import fill_middle as fm

SF = "/root/testdata/sf0.001"
UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def plain(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) by lists of units."""
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    units = UNIT.findall(text)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_every_document(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id: (plain(r.doc_id, r.text), r.text) for r in docs.collect()}
    got = fm.undo(fm.fill_in_middle(docs)).collect()
    assert len(got) == len(want) and {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == want[r.doc_id][0] and r.restored == want[r.doc_id][1]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a <P> b"), (4, "<S"), (None, "null id 😀 text"), (5, "same"), (5, "same"), (6, "x" * 300_000), (7, "ab1 \n\x00é😀" * 40_000), (8, "<" * 20_000), (9, "<<P" * 5000), (10, "M><S P>" * 3000)]
    rows += [(i, "one two <three> <S <M P> four") for i in range(20, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"form": F.lit("x"), "n": F.lit("y"), "output": F.lit(1), "restored": F.lit(2)})
    got = fm.undo(fm.fill_in_middle(docs)).collect()
    show = lambda x: repr(x)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in got), key=show) == sorted(((i, *plain(i, t), t or "") for i, t in rows), key=show)
    digests = {(r.doc_id, r.output_sha256, r.restored_sha256) for r in fm.digest(fm.fill_in_middle(docs)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert digests == {(i, sha(plain(i, t)[4]), sha(t or "")) for i, t in rows}
    assert fm.fill_in_middle(docs.limit(0)).count() == 0


def test_outputs_of_others_keep_their_columns(spark):
    outputs = spark.createDataFrame([(1, "psm", "<P>a<S>c<M>b", "k"), (2, "spm", "<S>c<P>a<M>b", "l"), (3, "plain", "x", None), (4, "psm", None, "m")], "id int, form string, output string, restored string")
    got = fm.undo(outputs)
    assert got.columns == ["id", "form", "output", "restored"] and [r.restored for r in got.orderBy("id").collect()] == ["abc", "abc", "x", None]


def test_a_damaged_output_fails():
    with pytest.raises(ValueError):
        fm.restored("<P>a<S>b", "psm")


texts = st.text(st.sampled_from("aB1 <>PSMé😀\n"), max_size=120)


@settings(max_examples=200, deadline=None)
@given(texts, st.integers(0, 130), st.integers(1, 9))
def test_ropes_split_like_strings(text, rank, leaf):
    units = UNIT.findall(text)
    tree = fm.rope(text, leaf)
    assert "".join(fm.leaves(tree)) == text and (tree.units, tree.chars) == (len(units), len(text))
    a, b = fm.split(tree, rank)
    assert "".join(fm.leaves(a)) == "".join(units[:rank]) and "".join(fm.leaves(b)) == "".join(units[rank:])
    assert (a.units, b.units) == (min(rank, len(units)), max(0, len(units) - rank)) and a.chars + b.chars == len(text)
    a, b = fm.split(tree, rank, "chars")
    assert "".join(fm.leaves(a)) == text[:rank] and "".join(fm.leaves(b)) == text[rank:]


def test_trees_stay_shallow_and_leaves_small():
    depth = lambda t: 1 + max(depth(t.left), depth(t.right)) if isinstance(t, fm.Node) else 0
    tree = fm.rope("word and 12 signs; " * 50_000)
    assert depth(tree) <= 9 and max(map(len, fm.leaves(tree))) < 2 * fm.LEAF
    front, suffix = fm.split(tree, tree.units * 2 // 3)
    prefix, middle = fm.split(front, tree.units // 3)
    assert depth(fm.joined(prefix, suffix, middle)) <= 14
