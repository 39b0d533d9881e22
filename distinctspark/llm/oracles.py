"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"[^\x20\x09-\x0D]+"

ORACLES["op5_minhash_near_dedup"] = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORDS}') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i
  FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * i >= 85 * (x.n + y.n - i)),
g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, g.b FROM r JOIN g ON r.other = g.a),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id,
  d.doc_id = c.component_id AS kept
FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""

ORACLES["op1_line_dedup"] = """
WITH l AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS j,
    unnest(string_split(text, chr(10))) AS line FROM documents WHERE text <> ''),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY j) AS i
  FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
t AS (SELECT *, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS n FROM c),
w AS (SELECT doc_id, i, [line, lead(line) OVER d, lead(line, 2) OVER d] AS run,
    n AS n1, n + lead(n) OVER d AS n2, lead(n, 2) OVER d AS n3
  FROM t WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, 3 AS k, run FROM w WHERE n3 IS NOT NULL
  UNION ALL SELECT doc_id, i, 2, run[1:2] FROM w WHERE n2 >= 50
  UNION ALL SELECT doc_id, i, 1, run[1:1] FROM w WHERE n1 >= 50),
s AS (SELECT doc_id, i, k, row_number() OVER (PARTITION BY k, run ORDER BY doc_id, i) AS copy FROM r),
g AS (SELECT DISTINCT doc_id, i + unnest(range(k)) AS i FROM s WHERE copy > 1),
k AS (SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed,
    coalesce(string_agg(l.line, chr(10) ORDER BY l.j) FILTER (WHERE g.i IS NULL), '') AS kept
  FROM l LEFT JOIN c USING (doc_id, j) LEFT JOIN g ON g.doc_id = c.doc_id AND g.i = c.i
  GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
  CASE WHEN d.text IS NOT NULL THEN length(coalesce(kept, '')) END AS n_chars,
  sha256(coalesce(kept, '')) AS text_sha256
FROM documents d LEFT JOIN k USING (doc_id)
"""

ORACLES["op10_source_mixing"] = f"""
WITH s AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORDS}'))::BIGINT AS size,
    ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))
      ::BIGINT AS h FROM documents),
n AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST)
    AS sid FROM s GROUP BY source),
w AS (SELECT *, [5, 2, 1][(sid - 1) % 3 + 1] AS weight, 3 * source_size AS cap FROM n),
r AS (SELECT *,
    sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, sid
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, sid
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weights FROM w),
c AS (SELECT *, cap::HUGEINT * weights <= rest::HUGEINT * weight AS capped FROM r),
f AS (SELECT rest AS free_rest, weights AS free_weights FROM c WHERE NOT capped
  ORDER BY cap / weight, sid LIMIT 1),
t AS (SELECT sid, source, source_size, CASE WHEN capped THEN cap::DOUBLE
    ELSE free_rest::DOUBLE * weight / free_weights END AS target FROM c LEFT JOIN f ON true),
b AS (SELECT t.*, greatest(1, least((SELECT greatest(1, ceil(sum(size) / 262144.0))::BIGINT FROM s),
    source_size // 64)) AS block FROM t),
q AS (SELECT sid, blocks, (rounds * blocks + least(round((target - rounds * source_size) / block),
    blocks))::BIGINT AS quota FROM (SELECT *, ceil(source_size / block)::BIGINT AS blocks,
      least(floor(target / source_size), 3)::BIGINT AS rounds FROM b WHERE source_size > 0)),
o AS (SELECT *, sum(quota) OVER (ORDER BY sid) - quota AS low, sum(quota) OVER (ORDER BY sid) AS high,
    sum(quota) OVER () AS cells FROM q),
p AS (SELECT i, (((i * 2654435769) & 4294967295) * cells) >> 32 AS cell FROM (
  SELECT unnest(range(4 * cells::BIGINT)) AS i, cells::BIGINT AS cells FROM (SELECT max(cells) AS cells FROM o))),
k AS (SELECT sid, blocks, quota, i, row_number() OVER (PARTITION BY sid ORDER BY i) - 1 AS rank
  FROM p JOIN o ON p.cell >= o.low AND p.cell < o.high),
m AS (SELECT sid, rank % blocks AS block_no, count(*) AS times, min(i) AS slot FROM k WHERE rank < quota GROUP BY 1, 2),
d AS (SELECT s.doc_id, s.h, s.size, t.sid, t.source_size, t.target, t.block,
    sum(s.size) OVER (PARTITION BY t.sid ORDER BY s.h, s.doc_id, s.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size AS start
  FROM s JOIN b t ON s.source IS NOT DISTINCT FROM t.source),
x AS (SELECT *, unnest(range((start // block)::BIGINT, ((start + size - 1) // block + 1)::BIGINT))
    AS block_no FROM d WHERE size > 0),
y AS (SELECT x.doc_id, x.h, sum((least(start + size, (block_no + 1) * block)
    - greatest(start, block_no * block)) * coalesce(times, 0))::BIGINT AS taken, min(slot)::BIGINT AS first_slot
  FROM x LEFT JOIN m USING (sid, block_no) GROUP BY 1, 2)
SELECT d.doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, first_slot
FROM d LEFT JOIN y ON y.doc_id = d.doc_id AND y.h = d.h
"""


def _merkle(doc_levels: int = 7, group_levels: int = 3) -> str:
    """Levels are written out: enough for 8^7 documents a language and 8^3 languages."""

    def fields(text: str) -> str:
        values = ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)
        return " || ".join(f"CASE WHEN {v} IS NULL THEN '-' ELSE strlen({v}) || ':' || {v} END" for v in values)

    byte = "ascii(substr(CAST(doc_id AS VARCHAR), CAST(i + 1 AS BIGINT), 1))"
    bit = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = (
        "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform("
        f"range(length(doc_id::VARCHAR)), lambda i: {byte}::BIGINT)), lambda c, b: {bit}))"
    )
    lowered = f"translate(text, '{_UPPER}', '{_LOWER}')"
    parts = [
        f"h AS (SELECT doc_id, lang, sha256({fields('text')}) AS d, "
        f"CASE WHEN {crc} % 3 = 0 THEN sha256({fields(lowered)}) END AS alt FROM documents)",
        "lf AS (SELECT doc_id, d, alt, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, "
        "row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, d) - 1 AS pos FROM h)",
        "n0 AS (SELECT tree, pos, d FROM lf)",
    ]

    def climb(name: str, k: int) -> None:
        parts.append(
            f"{name}c{k} AS (SELECT *, count(*) OVER (PARTITION BY tree) AS c FROM {name}{k}), "
            f"{name}s{k} AS (SELECT tree, pos, c, coalesce(string_agg(d, '') OVER (PARTITION BY tree, pos // 8 "
            "ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, "
            "coalesce(string_agg(d, '') OVER (PARTITION BY tree, pos // 8 "
            f"ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}c{k}), "
            f"{name}{k + 1} AS (SELECT tree, pos // 8 AS pos, CASE WHEN any_value(c) > 1 THEN "
            f"sha256(string_agg(d, '' ORDER BY pos)) ELSE any_value(d) END AS d FROM {name}c{k} GROUP BY tree, pos // 8)"
        )

    for k in range(doc_levels):
        climb("n", k)
    parts.append(f"g0 AS (SELECT 0 AS tree, tree AS pos, d FROM n{doc_levels})")
    for k in range(group_levels):
        climb("g", k)
    parts.append("e0 AS (SELECT *, coalesce(alt, d) AS cur, '' AS proof FROM lf)")
    steps = [("n", k, f"s.tree = e.tree AND s.pos = e.pos >> {3 * k}") for k in range(doc_levels)]
    steps += [("g", k, f"s.pos = e.tree >> {3 * k}") for k in range(group_levels)]
    for i, (name, k, on) in enumerate(steps):
        parts.append(
            f"e{i + 1} AS (SELECT e.doc_id, e.d, e.tree, e.pos, "
            "CASE WHEN s.c > 1 THEN sha256(s.l || cur || s.r) ELSE cur END AS cur, "
            f"CASE WHEN s.c > 1 THEN proof || s.l || s.r ELSE proof END AS proof FROM e{i} e JOIN {name}s{k} s ON {on})"
        )
    return (
        f"WITH {', '.join(parts)} SELECT e.doc_id, e.d AS leaf, n.d AS subroot, g.d AS root, "
        "sha256(e.proof) AS proof_sha256, e.cur AS folded_root, e.cur = g.d AS verified "
        f"FROM e{len(steps)} e JOIN n{doc_levels} n ON n.tree = e.tree, g{group_levels} g"
    )


ORACLES["op11_merkle_manifest"] = _merkle()


def _lloyd(width: int = 8, parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """For vectors of parts * width components."""
    sound = "list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))"
    ctes = [
        "q AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * x::DOUBLE) AS BIGINT)) AS v "
        f"FROM embeddings WHERE embedding IS NOT NULL AND {sound})",
        f"p AS (SELECT vec_id, k, v[k * {width} + 1 : k * {width} + {width}] AS x FROM q, range({parts}) t(k))",
        "b0 AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY vec_id) - 1 AS e, x AS c FROM p "
        f"QUALIFY e < {entries})",
    ]
    squares = f"list_sum(list_transform(range(1, {width + 1}), lambda i: (x[i] - c[i]) * (x[i] - c[i])))"
    for r in range(rounds + 1):
        ctes.append(
            f"a{r} AS MATERIALIZED (SELECT vec_id, k, any_value(x) AS x, min({{'d': CAST({squares} AS BIGINT), 'e': e}}) AS m "
            f"FROM p JOIN b{r} USING (k) GROUP BY vec_id, k)"
        )
        if r < rounds:
            sums = ", ".join(f"CAST(sum(x[{i}]) AS BIGINT)" for i in range(1, width + 1))
            ctes.append(
                f"u{r} AS (SELECT k, m.e AS e, count(*) AS n, [{sums}] AS s FROM a{r} GROUP BY k, m.e), "
                f"b{r + 1} AS MATERIALIZED (SELECT k, e, CASE WHEN n IS NULL THEN c ELSE "
                "list_transform(s, lambda t: (t - ((t % n) + n) % n) // n) END AS c "
                f"FROM b{r} LEFT JOIN u{r} USING (k, e))"
            )
    return (
        f"WITH {', '.join(ctes)}, "
        "z AS (SELECT vec_id, string_agg(printf('%02x', m.e), '' ORDER BY k) AS code, "
        f"CAST(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id), "
        "w AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY k, e, i)) AS codebooks_sha256 FROM "
        f"(SELECT k, e, unnest(c) AS v, generate_subscripts(c, 1) AS i FROM b{rounds})) "
        "SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, "
        "codebooks_sha256 FROM z JOIN q USING (vec_id), w"
    )


ORACLES["op13_resident_lloyd"] = _lloyd()
