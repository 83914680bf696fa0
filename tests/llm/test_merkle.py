import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from bitext.llm import merkle, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    said = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)]
    return h(*said)


def tree(nodes):
    """The root over nodes, and every node's steps (before, after) to it."""
    paths, held = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        new, below = [], []
        for lo in range(0, len(nodes), 16):
            run = nodes[lo : lo + 16]
            for k in range(len(run)):
                for leaf_ in held[lo + k]:
                    paths[leaf_].append(("".join(run[:k]), "".join(run[k + 1 :])))
            new.append(h(*run))
            below.append([x for k in range(len(run)) for x in held[lo + k]])
        nodes, held = new, below
    return nodes[0], paths


def manifest(rows, later):
    """All rows of the manifest, by building the trees one node at a time."""
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        built[s] = tree([leaf(r, r[1]) for r in groups[s]])
    root, above = tree([built[s][0] for s in names]) if names else (None, [])
    out = []
    for k, s in enumerate(names):
        for r, path in zip(groups[s], built[s][1], strict=True):
            path = path + above[k]
            node = leaf(r, later(r))
            for before, after in path:
                node = h(before, node, after)
            proof = h(*[x for step in path for x in step])
            out.append((r[0], leaf(r, r[1]), built[s][0], root, proof, node, node == root))
    return out


def lowered(r):
    if r[0] is None or r[1] is None or zlib.crc32(str(r[0]).encode()) % 5:
        return r[1]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])


def compared(spark, rows, extra=""):
    docs = spark.createDataFrame(rows, SCHEMA + extra)
    found = merkle.manifest(docs, changed={"text": queries.lowered_fifth(docs)})
    got = [(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in found.collect()]
    key = lambda x: (x[0] is not None, x[0] or 0, x[1:])
    assert sorted(got, key=key) == sorted(manifest(rows, lowered), key=key)
    return got


@pytest.mark.parametrize("sizes", [[1], [1, 1], [16], [17, 1], [300, 2, 33], [257] + [1] * 17])
def test_trees_of_all_shapes(spark, sizes):
    r = random.Random(len(sizes))
    rows = [(k, f"Text {k} {r.random()}", "en", f"source {s}", k) for s, n in enumerate(sizes) for k in range(1000 * s, 1000 * s + n)]
    r.shuffle(rows)
    got = compared(spark, rows)
    assert len({x[3] for x in got}) == 1 and (len(rows) < 20 or not all(x[6] for x in got)) and any(x[6] for x in got)


def test_odd_rows(spark, odd):
    rows = [tuple(r)[:5] for r in odd.collect()]
    rows += [(None, None, None, None, None), (None, None, None, None, None), (11, "UPPER", "é", "ß", -5), (12, "X", "1:", "", 3)]
    compared(spark, [(*r, "a", "b") for r in rows], ", leaf string, at string")


def test_a_changed_value_is_found(spark):
    docs = spark.range(500).selectExpr("id AS doc_id", "concat('t', id) AS text", "'en' AS lang", "cast(id % 3 AS string) AS source", "id AS n_chars")
    found = merkle.manifest(docs, changed={"n_chars": F.when(F.col("doc_id") == 77, 5).otherwise(F.col("n_chars"))})
    assert [r.doc_id for r in found.where("NOT verified").collect()] == [77]
    row = found.where("doc_id = 77").first()
    node = row.leaf
    for step in row.proof:
        node = h(step.before, node, step.after)
    assert node == row.root != row.folded_root


def test_empty_table(none):
    assert merkle.manifest(none).collect() == []
