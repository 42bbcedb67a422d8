"""Trees over a table against a plain version that rehashes everything."""

from __future__ import annotations

import hashlib
import zlib

import pytest

from witnessframe.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, more=0):
    doc_id, text, lang, source, n_chars = row
    values = (doc_id, source, lang, None if n_chars is None else n_chars + more, text)
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(digests):
    levels = [list(digests)]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def way(levels, place):
    """(whether the node is the right one, sibling or None) level by level."""
    out = []
    for nodes in levels[:-1]:
        sibling = place ^ 1
        out.append((place & 1, nodes[sibling] if sibling < len(nodes) else None))
        place >>= 1
    return out


def plain_manifest(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    of = {
        lang: sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r))) for lang in langs
    }
    trees = {lang: tree([plain_leaf(r) for r in of[lang]]) for lang in langs}
    top = tree([trees[lang][-1][0] for lang in langs])
    out = []
    for n, lang in enumerate(langs):
        for place, row in enumerate(of[lang]):
            path = way(trees[lang], place) + way(top, n)
            chosen = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            at = plain_leaf(row, int(chosen))
            for right, sibling in path:
                at = sha(at) if sibling is None else sha(sibling, at) if right else sha(at, sibling)
            root = top[-1][0]
            out.append((row[0], plain_leaf(row), trees[lang][-1][0], root, sha(*[s for _, s in path if s]), at, at == root))
    return out


def mine(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def rows_of(n):
    langs = ["en", "en", "en", "de", None, "é", "z"]
    return [(i, f"text {i}" * (i % 3), langs[i % 7], None if i % 11 == 0 else "web", None if i % 5 == 0 else i) for i in range(n)]


@pytest.mark.parametrize("n", [1, 2, 3, 8, 150])
def test_manifest_equals_plain(spark, n):
    rows = rows_of(n)
    assert mine(merkle.manifest(spark.createDataFrame(rows, DOCS))) == sorted(plain_manifest(rows), key=repr)


def test_odd_rows(spark):
    rows = [
        (1, "a", "en", "web", 1), (1, "a", "en", "web", 1), (1, "b", "en", "web", 1), (None, None, None, None, None), (None, "c", "en", None, 5),
        (2**62 + 1, "x" * 300_000, "en", "web", 9), (7, "", "", "", 0), (14, "é\n", "en", "web", 2**63 - 1),
    ] + [(i, "t", "en", "s", 1) for i in range(100, 130)]
    docs = spark.createDataFrame(rows, DOCS)
    assert mine(merkle.manifest(docs)) == sorted(plain_manifest(rows), key=repr)
    clash = docs.selectExpr("*", "1 as tree", "2 as leaf", "3 as position", "4 as _at", "5 as block")
    assert mine(merkle.manifest(clash)) == sorted(plain_manifest(rows), key=repr)
    empty = merkle.manifest(docs.limit(0))
    assert empty.columns == COLUMNS and empty.count() == 0


@pytest.mark.parametrize("height", [1, 2, 3])
def test_versions_over_many_blocks(spark, height):
    """Blocks of two to eight nodes, so that trees of 97 leaves have up to seven levels of blocks."""
    leaves = [(t, i, sha(t, str(i)), sha("other", str(i)) if i % 4 == 0 else None) for t, n in (("a", 97), ("b", 1), ("c", 5)) for i in range(n)]
    found = {(r.tree, r.doc_id): r for r in merkle.versions(spark.createDataFrame(leaves, "tree string, doc_id long, leaf string, changed string"), height).collect()}
    trees = {}
    for t in "abc":
        trees[t] = tree([sha for _, _, sha in sorted((i, i, d) for x, i, d, _ in leaves if x == t)])
    top = tree([trees[t][-1][0] for t in "abc"])
    assert len(found) == len(leaves)
    for t, i, own, changed in leaves:
        row, at = found[t, i], changed or own
        path = way(trees[t], i) + way(top, "abc".index(t))
        for right, sibling in path:
            at = sha(at) if sibling is None else sha(sibling, at) if right else sha(at, sibling)
        assert (row.subroot, row.root, row.folded_root) == (trees[t][-1][0], top[-1][0], at)
        assert bytes(row.siblings).hex() == "".join(s for _, s in path if s)
        assert (row.folded_root == row.root) == (changed is None)


def test_a_version_shares_what_it_did_not_copy():
    root = merkle.grown([sha(str(i)) for i in range(8)], 3)
    version, _ = merkle.replaced(root, 3, 5, sha("new"))
    assert version[0] != root[0]
    assert version[1] is root[1] and version[2][2] is root[2][2] and version[2][1][1] is root[2][1][1]
    assert version[2][1][2][0] == sha("new") and root[2][1][2][0] == sha("5")
