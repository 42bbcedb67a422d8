"""Queries against their SQL on odd rows that the given tables lack."""

import os

import pytest

import __spark_entry__ as entry

from .compare import ROOT, TABLES, difference

NUMBERS = [0.0, 10.5, 20.0, 20.5, 5.49, 5.5, 1e-5, 1.25e-4, 1e7, 12345678.9, -2.5e-10, float("nan"), float("inf"), float("-inf"), None]
TEXTS = [
    "a &quot;b&quot; &amp", "&amp;lt; &notit; &notin; &#65;&#x41; &#0; &#128; &#xD800; &#99999999999999999999; &#1;x", "&bogus; && &; &#; &#x; &nbsp;&nbsp;c d", "R&D &copy 2024 &AMP;&ngE;",
    "plain", "", " \n ", "&lt;i&gt; 1 &lt 2&#60",
]


def with_table(spark, folder, name, rows, schema):
    for other in TABLES:
        if other != name:
            os.symlink(f"{ROOT}0.001/{other}.parquet", folder / f"{other}.parquet")
    spark.createDataFrame(rows, schema).toPandas().to_parquet(folder / f"{name}.parquet")
    return str(folder)


def check(spark, name, folder, n):
    text, rows = difference(spark, entry.queries()[name], entry.oracle_sql()[name], folder)
    assert text == "" and rows == n


def test_expectations_of_any_number(spark, tmp_path):
    import pandas as pd
    import pyarrow as pa
    import pyarrow.parquet as pq

    for other in TABLES:
        if other != "events":
            os.symlink(f"{ROOT}0.001/{other}.parquet", tmp_path / f"{other}.parquet")
    rows = [(kind, x, props) for kind in ("view", "click", "error", "purchase", "signup") for x in NUMBERS for props in ('{"k": 6}', None)]
    pq.write_table(pa.table({
        "event_id": list(range(len(rows))), "ts": pa.array([pd.Timestamp("2024-01-01")] * len(rows), pa.timestamp("us")), "user_id": [1] * len(rows),
        "event_type": [r[0] for r in rows], "value": pa.array([r[1] for r in rows], pa.float64()), "props": pa.array([r[2] for r in rows], pa.string()),
    }), tmp_path / "events.parquet")
    check(spark, "expectation_check", str(tmp_path), len(rows))


def test_references_of_any_kind(spark, tmp_path):
    page = '<html lang="{0}"><head><title>{0}</title></head><body><nav><ul><li><a href="{0}">x</a></li></ul></nav><article><p>y</p></article><footer>z <b>{0}</b></footer></body></html>'
    rows = [(i, "u", page.format(text)) for i, text in enumerate(TEXTS)]
    check(spark, "html_selector_values", with_table(spark, tmp_path, "pages", rows, "page_id long, url string, html string"), len(rows))


@pytest.mark.parametrize("name", ["html_selector_values", "expectation_check"])
def test_larger_tables(spark, name):
    text, _ = difference(spark, entry.queries()[name], entry.oracle_sql()[name], ROOT + "0.1")
    assert text == ""
