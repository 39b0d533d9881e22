"""Resident Lloyd against plain rounds."""

import hashlib
import math

import numpy as np

from distinctspark.llm.lloyd import compress, nearest, with_label_error

KIND = "vec_id long, embedding array<float>, label int, code string, row long, part string"


def made(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 0, "y") for i, v, label in rows], KIND)


def plain(rows):
    """(vec_id, code, error, label_error) and the codebook digest, with Python integers."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    q = [[math.floor(4096 * x) for x in r[1]] for r in rows]
    width = len(q[0]) // 8
    parts = [[v[p * width : (p + 1) * width] for v in q] for p in range(8)]
    first = sorted(range(len(rows)), key=lambda i: rows[i][0])[:16]
    books = [[list(parts[p][i]) for i in first] for p in range(8)]

    def assign(p):
        out = []
        for x in parts[p]:
            far = [sum((a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in books[p]]
            out.append((far.index(min(far)), min(far)))
        return out

    for _ in range(6):
        for p in range(8):
            found = assign(p)
            for e in range(len(books[p])):
                own = [x for x, (k, _) in zip(parts[p], found, strict=True) if k == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    ends = [assign(p) for p in range(8)]
    errors = [sum(ends[p][i][1] for p in range(8)) for i in range(len(rows))]
    by_label = {}
    for r, e in zip(rows, errors, strict=True):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    codes = ["".join(f"{ends[p][i][0]:02x}" for p in range(8)) for i in range(len(rows))]
    numbers = ",".join(str(v) for book in books for c in book for v in c)
    found = [(r[0], c, e, by_label[r[2]]) for r, c, e in zip(rows, codes, errors, strict=True)]
    return sorted(found), hashlib.sha256(numbers.encode()).hexdigest()


def check(spark, rows):
    got = compress(made(spark, rows))
    found = with_label_error(got.codes).select("vec_id", "code", "error", "label_error").collect()
    want, digest = plain(rows)
    assert sorted(map(tuple, found)) == want and got.sha256 == digest


def floats(x):
    return np.float32(x).astype(float).tolist()


def test_against_plain_rounds(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 24))
    x = centres[rng.integers(0, 30, 400)] + 0.3 * rng.normal(size=(400, 24))
    x[100:240] = x[100]  # a hot vector
    rows = [(int(i) * 7 % 401, floats(v), [1, 2, None][i % 3]) for i, v in enumerate(x)]
    rows += [(9000, None, 1), (9001, [float("nan")] * 24, 1), (9002, [None] + [1.0] * 23, 2),
             (9003, [float("-inf")] * 24, None), (9004, [0.0] * 24, 5), (9004, [0.0] * 24, 5)]
    check(spark, rows)


def test_few_rows_and_ties(spark):
    check(spark, [(i, [float(i % 3)] * 8, i % 2) for i in range(12)])
    check(spark, [(5, [1.5] * 16, None)])
    check(spark, [(i, [0.25] * 8, 1) for i in range(40)])


def test_odd_tables(spark):
    assert compress(made(spark, [(1, [1.0] * 8, 1)]).limit(0)).codes.count() == 0
    assert compress(made(spark, [(1, None, 1)])).codes.count() == 0
    mixed = [(i, [float(i)] * 10, 1) for i in range(5)] + [(9, [1.0] * 3, 1), (None, [2.0] * 10, 1)]
    got = compress(made(spark, mixed)).codes.collect()  # 10 components: padded; 3: left out
    assert sorted(str(r.vec_id) for r in got) == ["0", "1", "2", "3", "4", "None"]
    assert all(len(r.code) == 16 and r.error == 0 for r in got)
    large = [(i, [1e30 * (i - 1)] * 8, 1) for i in range(3)]
    assert all(r.error == 0 for r in compress(made(spark, large)).codes.collect())


def test_nearest_is_exact_for_large_numbers():
    x = np.array([[2**26, 1], [2**26, 2]], dtype=np.int64)
    book = np.array([[2**26, 0], [2**26, 3], [-(2**26), 1]], dtype=np.int64)
    entry, far = nearest(x, book)
    assert entry.tolist() == [0, 1] and far.tolist() == [1, 1]


def test_fewer_parts(spark):
    rows = made(spark, [(i, [float(i), float(-i), 1.0, 0.0], 0) for i in range(20)])
    got = compress(rows, parts=2, entries=4, rounds=1)
    assert got.codebooks[0].tolist() == [[0, 0], [4096, -4096], [8192, -8192], [45056, -45056]]
    codes = {r.vec_id: r.code for r in got.codes.collect()}
    assert codes[0] == "0000" and codes[3] == "0200" and codes[19] == "0300"
