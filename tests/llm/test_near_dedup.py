"""Documents without a doc_id, or with one that other texts share, in the stages that drop documents."""

from __future__ import annotations

from witnessframe.llm import decontaminate, minhash


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_rows_are_judged_by_id_and_text(spark):
    base = " ".join(f"w{k}" for k in range(60))
    clean, other = (" ".join(f"{c}{k}" for k in range(30)) for c in "uv")
    rows = [(5, base), (None, base), (None, clean), (None, other), (None, other), (None, None), (None, ""), (None, ""), (7, clean + " more"), (7, "short one"), (8, "x y"), (8, "x y"), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(5, base), (None, other), (None, None), (None, ""), (None, ""), (7, clean + " more"), (7, "short one"), (8, "x y"), (9, "")]
    assert rows_of(minhash.one_of_each(docs)) == sorted(want, key=str)

    bench = spark.createDataFrame([(1, clean)], "item_id long, text string")
    left = [(i, t) for i, t in rows if not (t or "").startswith(clean)]
    assert rows_of(decontaminate.without_leaks(docs, bench)) == sorted(left, key=str)
    assert {r.doc_id for r in decontaminate.leaks(docs, bench).collect()} == {None, 7}
