"""The Merkle manifest against trees that are held whole."""

import hashlib
import zlib

import pytest

from rowkin.llm import merkle
from rowkin.llm.common import crc_fold

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, rank long, digest string, row int"


def rows_of(n=90):
    """Sources from one to many rows, one null, with nulls in any column, repeated rows and ids, a very long text."""
    out = [(i, f"Text {i} with Ä and CAPS", "en", ("a", "b", "é", None, "a", "a")[i % 6], i) for i in range(n)]
    out += [(1000, None, None, "alone", None), (1001, "", "en", "", 0), (None, "No id", "en", "a", 5), (None, None, None, None, None), (7, "same", "en", "a", 4), (7, "same", "en", "a", 4), (7, "Other", "en", "a", 5), (-5, "LONG " * 200_000, "en", "a", None)]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA)


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def whole_tree(nodes, fanout):
    """The root, and the path of each node as (place, other nodes of the run) a level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, i in zip(paths, at, strict=True):
            b = i // fanout * fanout
            path.append((i - b, nodes[b:i] + nodes[i + 1 : b + fanout]))
        nodes = [h("".join(nodes[b : b + fanout])) for b in range(0, len(nodes), fanout)]
        at = [i // fanout for i in at]
    return nodes[0], paths


def brute_force(rows, fanout=16):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    trees = []
    for source in sorted(by, key=lambda s: (s is not None, (s or "").encode())):
        own = sorted(by[source], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r)))
        trees.append((own, *whole_tree([leaf_of(*r) for r in own], fanout)))
    root, upper = whole_tree([t[1] for t in trees], fanout)
    out = []
    for (own, subroot, paths), up in zip(trees, upper, strict=True):
        for r, path in zip(own, paths, strict=True):
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and text:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = leaf_of(r[0], text, *r[2:])
            for at, others in path + up:
                node = h("".join(others[:at] + [node] + others[at:]))
            out.append((r[0], leaf_of(*r), subroot, root, h("".join(x for _, others in path + up for x in others)), node, node == root))
    return sorted(out, key=str)


def collected(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def test_proofs_equal_whole_trees(spark):
    rows = rows_of()
    assert collected(merkle.tamper_proofs(frame(spark, rows))) == brute_force(rows)


@pytest.mark.parametrize("n", [1, 9, 40])
def test_rounds_of_blocks(spark, n):
    """Blocks of four leaves: up to three rounds in one source, and blocks of one leaf at the end."""
    rows = rows_of(n)
    docs = frame(spark, rows)
    own = merkle.leaves(docs, tampered=crc_fold(docs["doc_id"]) == 0)
    assert collected(merkle.proved(own, fanout=2, height=2)) == brute_force(rows, 2)


@pytest.mark.parametrize("fanout,n", [(2, 1), (2, 2), (2, 7), (3, 27), (3, 20), (4, 17), (16, 300)])
def test_traversal(fanout, n):
    nodes = [h(str(i)) for i in range(n)]
    root, paths = whole_tree(nodes, fanout)
    coded = [x.encode() for x in nodes]
    levels = merkle.height_of(0, n, fanout, 9)
    assert merkle.block_root(coded, levels, fanout).decode() == root
    got = [[(at, before + after) for at, before, after in path] for path in merkle.traverse(coded, levels, fanout)]
    assert got == [[(at, "".join(others).encode()) for at, others in path] for path in paths]


def test_empty_and_one(spark):
    assert merkle.tamper_proofs(frame(spark, [])).count() == 0
    (only,) = merkle.tamper_proofs(frame(spark, [(3, None, None, None, None)])).collect()
    assert only.root == only.subroot == only.leaf and only.proof_sha256 == hashlib.sha256(b"").hexdigest() and only.verified


def test_stored_manifest_tells_what_changed(spark, tmp_path):
    rows = rows_of(40)
    merkle.write_manifest(frame(spark, rows), str(tmp_path / "m"))
    manifest = spark.read.parquet(str(tmp_path / "m"))
    assert {r.status for r in merkle.verify(frame(spark, rows), manifest).collect()} == {"verified"}
    other = [(r[0], "edited", *r[2:]) if r[0] == 3 else r for r in rows if r[0] != 1000] + [(5000, "new", "en", "a", 3)]
    told = {(r.doc_id, r.source): r.status for r in merkle.verify(frame(spark, other), manifest).collect()}
    assert {k: v for k, v in told.items() if v != "verified"} == {(3, None): "changed", (1000, "alone"): "missing", (5000, "a"): "unknown"}
    assert len(merkle.verify(frame(spark, rows), manifest).collect()) == len(rows)
