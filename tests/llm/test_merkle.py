"""The Merkle manifest against a plain tree."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from distinctspark.llm import merkle
from distinctspark.llm.merkle import Block, Path, document_manifest

KIND = "doc_id long, text string, lang string, source string, n_chars long, leaf string, pos int, tree long"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    return h(*map(field, (doc_id, source, lang, n_chars, text)))


def climb(nodes):
    """All levels from the leaves to one node."""
    floors = [nodes]
    while len(floors[-1]) > 1:
        floors.append([h(*floors[-1][i : i + 8]) for i in range(0, len(floors[-1]), 8)])
    return floors


def way(floors, i):
    out = []
    for floor in floors[:-1]:
        first = i // 8 * 8
        out.append((floor[first:i], floor[i + 1 : first + 8]))
        i //= 8
    return out


def plain(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of every row, unordered."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r, leaf_of(*r)))
    names = sorted(groups, key=lambda n: (n is not None, (n or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[name] = climb([leaf for _, leaf in groups[name]])
    top = climb([trees[n][-1][0] for n in names])
    out = []
    for g, name in enumerate(names):
        for i, (r, leaf) in enumerate(groups[name]):
            steps = way(trees[name], i) + way(top, g)
            cur = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                low = None if r[1] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])
                cur = leaf_of(r[0], low, *r[2:])
            for left, right in steps:
                cur = h(*left, cur, *right)
            proof = h(*[x for left, right in steps for x in (*left, *right)])
            root = top[-1][0]
            out.append((r[0], leaf, trees[name][-1][0], root, proof, cur, cur == root))
    return sorted(out, key=str)


def made(spark, rows):
    return spark.createDataFrame([(*r[:2], r[2], r[3], r[4], "x", 1, 2) for r in rows], KIND)


def check(spark, rows):
    got = document_manifest(made(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows)


def test_groups_of_many_sizes(spark):
    rows = [(i, f"Text {i} Ä", ["a", "b", "é", None][i % 4] if i > 60 else "big", f"s{i % 3}", i) for i in range(700)]
    rows += [(1000 + i, "Hot", "big", "s", 3) for i in range(900)]  # more than one block
    rows += [(5000, None, "lone", None, None), (None, "Null id", "a", None, 1)]
    rows += [(7, "Again", "big", None, 0)] * 3 + [(7, "Text 7 Ä", "big", "s1", 7)]  # repeated ids and rows
    rows += [(6000, "", "", "", 0), (6001, "Long " * 50_000, "b", "s", 250_000)]
    check(spark, rows)


def test_one_row_one_group_none(spark):
    check(spark, [(3, "A", "en", "s", 1)])
    check(spark, [(i, "A", "en", "s", 1) for i in range(9)])
    check(spark, [(i, "A", f"l{i}", "s", 1) for i in range(9)])
    assert document_manifest(made(spark, [(1, "a", "b", "c", 1)]).limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 8, 9, 64, 65, 513])
def test_depth(spark, n):
    got = spark.range(1).select(merkle.depth_of(F.lit(n).cast("long")).alias("d")).first().d
    assert got == len(climb([str(i) for i in range(n)])) - 1


def test_fold_resumes_the_kept_states():
    digests = [sha256(bytes([i])).digest() for i in range(70)]
    block = Block(digests, 3)
    assert all(block.fold(i, d.hex().encode()) == block.top.hex().encode() for i, d in enumerate(digests))
    changed = Block(digests[:33] + [b"x" * 32] + digests[34:], 3)
    assert block.fold(33, (b"x" * 32).hex().encode()) == changed.top.hex().encode()
    path = Path(["aa", ""], ["", "bb"])
    assert path.fold(b"cc").decode() == h(h("aa", "cc"), "bb") and path.siblings == b"aabb"
