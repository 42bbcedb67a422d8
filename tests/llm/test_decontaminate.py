"""Benchmark items planted at every kind of place and in every case."""

from __future__ import annotations

from witnessframe.llm import decontaminate

ITEM = "we measured how the small river slowly carried sand over many dry winters before any bridge was built across its bed"


def found(spark, texts, items):
    """(nth text, nth item) of every find."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}


def test_runs_of_five_words_are_met_at_every_place(spark):
    changed = ITEM.split()
    changed[5::6] = ["other"] * len(changed[5::6])
    short = "some dull fish swim upstream"
    texts = [" ".join(["lead"] * n + changed) for n in range(4)] + [" ".join(["lead"] * n + [short, "then"]) for n in range(4)]
    assert found(spark, texts, [ITEM, short]) == {(n, 0) for n in range(4)} | {(n, 1) for n in range(4, 8)}


def test_copies_in_any_case_are_found(spark):
    numbers = "12 + 7 * 3 - 4 / 2 = 31 and 5 * 5 = 25 so 31 - 25 = 6"
    items = [ITEM, "Ask Alice Why Bob Sold Nine Green Boats To Carol In The Old Harbour", "STOP THE SECOND ENGINE AND WAIT FOR THE SIGNAL OF THE PILOT", numbers]
    for change in (str, str.upper, str.title, str.lower):
        assert found(spark, [f"lead {change(item)} tail" for item in items], items) == {(n, n) for n in range(len(items))}


def test_capitals_alone_are_no_copy(spark):
    items = ["STOP THE SECOND ENGINE AND WAIT FOR THE SIGNAL OF THE PILOT"]
    assert not found(spark, ["STOP THE SECOND ENGINE AND Then Quickly Bring Some Water Up Here Please"], items)


def test_text_after_a_partial_copy_does_not_undo_it(spark):
    item = "If Alice has 12 apples and gives some of them to an old friend in town, then Alice buys more of them and later on Alice eats 12 apples"
    copied = " ".join(item.split()[:17])
    texts = [
        f"lead {copied} Carol went home early",  # a name right after the copy, where the item has Alice again
        f"lead {copied} who knew well a lot and so on Carol eats 77 pears",  # names further on
        f"lead {item.replace('Alice', 'Dora')}", "lead " + item.replace("then Alice", "then Carol"),  # consistent, and not
    ]
    assert found(spark, texts, [item]) == {(0, 0), (1, 0), (2, 0)}
