"""A Merkle manifest of a table: one SHA-256 tree per group, one tree over the groups' roots.

Leaves are hashed in expressions and ranked by range partitions.  The tree is climbed in tiers of
``LEVELS`` levels: a block of FAN ** LEVELS neighbouring nodes is one unit of work, so no task holds
more of a tree than that, whatever the size of a group.  Every parent keeps a copy of its hash state
before each child slot.  Going down again, a block gets the path above it as one row (siblings to the
left and right by level); a leaf is folded by resuming the copied state of its slot with the
replacement and the right siblings only.

Rows with NULLs are leaves like any other (a NULL is hashed as ``-``), NULL doc_ids rank first, rows
that repeat a doc_id rank by leaf, equal rows are neighbours and each gets its own proof.  A group of
one row has its leaf as root.  An empty table gives an empty manifest.
"""

from __future__ import annotations

import itertools
import operator
from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from distinctspark.session import join_group_params, materialize

FAN = 8
#: log2 of FAN.
_BITS = 3
#: Levels climbed within one block: 512 nodes.
LEVELS = 3
_TIER = _BITS * LEVELS

#: A node, or (at pos -1) the path above a block.
_NODE = "tree long, block long, pos long, left int, digest binary, lefts array<string>, rights array<string>"
_PROOF = "doc_id long, leaf binary, subroot binary, proof_sha256 string, folded_root string"


def field(value: Column) -> Column:
    """``-`` for NULL, else UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(*values: Column) -> Column:
    """32 bytes over all fields of a row."""
    return F.unhex(F.sha2(F.concat(*map(field, values)).cast("binary"), 256))


def ranked(rows: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rows`` with their 0-based ``pos`` and the ``size`` of their group; ``order`` must be total.

    Sorted range partitions may cut a group anywhere.  Ids that rise along them give each row its
    place within its part, and one row per part and group gives the part's offset.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *group, *order).sortWithinPartitions(*group, *order)
    ranged = materialize(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    ranged = ranged.withColumn("_part", F.shiftright("_at", 33))
    totals = ranged.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    shifts = totals.select(
        *group, "_part", "_n", (offset - F.col("_first")).alias("_shift"),
        F.sum("_n").over(Window.partitionBy(*group)).alias("size"),
    )
    placed = join_group_params(ranged, shifts, [*group, "_part"], weight="_n")
    return placed.withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def depth_of(size: Column) -> Column:
    """Levels above the leaves of a tree of ``size`` leaves."""
    bits = F.length(F.bin(size - 1))
    return F.when(size <= 1, 0).otherwise(F.ceil(bits / _BITS)).cast("int")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of batches sorted by their first two columns, by those."""
    rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
    for key, own in itertools.groupby(rows, key=operator.itemgetter(0, 1)):
        yield key, list(own)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


_LIST = pa.list_(pa.string())
_NODE_ARROW = pa.schema([
    ("tree", pa.int64()), ("block", pa.int64()), ("pos", pa.int64()), ("left", pa.int32()),
    ("digest", pa.binary()), ("lefts", _LIST), ("rights", _LIST),
])
_PROOF_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("leaf", pa.binary()), ("subroot", pa.binary()),
    ("proof_sha256", pa.string()), ("folded_root", pa.string()),
])


class Block:
    """The subtree over one block's nodes, with the copied states of all its parents."""

    def __init__(self, digests: Sequence[bytes], levels: int) -> None:
        self.floors = [[d.hex().encode() for d in digests]]
        self.states = []
        for _ in range(levels):
            above, before = [], []
            for first in range(0, len(self.floors[-1]), FAN):
                state = sha256()
                for child in self.floors[-1][first : first + FAN]:
                    before.append(state.copy())
                    state.update(child)
                above.append(state.hexdigest().encode())
            self.floors.append(above)
            self.states.append(before)

    @property
    def top(self) -> bytes:
        return bytes.fromhex(self.floors[-1][0].decode())

    def siblings(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        """What stands left and right of node ``i`` and of its ancestors, by level."""
        for floor in self.floors[:-1]:
            first = i // FAN * FAN
            yield b"".join(floor[first:i]), b"".join(floor[i + 1 : first + FAN])
            i //= FAN

    def fold(self, i: int, digest: bytes) -> bytes:
        """The block's top if leaf ``i`` were ``digest``, from the states kept before its slots."""
        for floor, before in zip(self.floors, self.states, strict=False):
            state = before[i].copy()
            state.update(digest)
            state.update(b"".join(floor[i + 1 : i // FAN * FAN + FAN]))
            digest = state.hexdigest().encode()
            i //= FAN
        return digest


class Path:
    """The way from a block's top to the root: per level the state before its slot, and the rest."""

    def __init__(self, lefts: list[str], rights: list[str]) -> None:
        sides = [(a.encode(), b.encode()) for a, b in zip(lefts, rights, strict=True)]
        self.steps = [(sha256(a), b) for a, b in sides]
        self.siblings = b"".join(a + b for a, b in sides)

    def fold(self, digest: bytes) -> bytes:
        for before, right in self.steps:
            state = before.copy()
            state.update(digest)
            state.update(right)
            digest = state.hexdigest().encode()
        return digest


def _by_block(rows: DataFrame) -> DataFrame:
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def _nodes(rows: DataFrame) -> DataFrame:
    """Node rows of (tree, pos, left, digest), dealt into blocks."""
    none = F.lit(None).cast("array<string>")
    return rows.select("tree", F.shiftright("pos", _TIER).alias("block"), "pos", "left", "digest",
                       none.alias("lefts"), none.alias("rights"))


def climb(nodes: DataFrame) -> DataFrame:
    """The tops of all blocks, as nodes of the tier above."""

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, block), rows in _groups(batches):
            levels = min(LEVELS, rows[0][3])
            top = Block([r[4] for r in rows], levels).top
            row = (tree, block >> _TIER, block, rows[0][3] - levels, top, None, None)
            yield _table([row], _NODE_ARROW)

    return _by_block(nodes).mapInArrow(tops, _NODE)


def descend(nodes: DataFrame, paths: DataFrame, mark: bool) -> DataFrame:
    """The path above every node of a tier, from the paths above its blocks.

    A path carries the digest of the node it was made for, or that of the path it extends (``mark``).
    """

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, _), rows in _groups(batches):
            _, _, _, _, above, lefts, rights = rows[0]
            own = rows[1:]
            block = Block([r[4] for r in own], min(LEVELS, own[0][3]))
            out = []
            for i, (_, _, pos, _, digest, _, _) in enumerate(own):
                sides = list(block.siblings(i))
                out.append((tree, pos, -1, None, above if mark else digest,
                            [a.decode() for a, _ in sides] + lefts, [b.decode() for _, b in sides] + rights))
            yield _table(out, _NODE_ARROW)

    return _by_block(nodes.unionByName(paths)).mapInArrow(extend, _NODE)


def _prove(leaves: DataFrame, paths: DataFrame) -> DataFrame:
    """Proof digest and folded root of every leaf (doc_id, altered: what it is folded with)."""

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches):
            _, _, _, _, subroot, lefts, rights, _, _ = rows[0]
            own, path = rows[1:], Path(lefts, rights)
            block = Block([r[4] for r in own], min(LEVELS, own[0][3]))
            out = []
            for i, (_, _, _, _, leaf, _, _, doc_id, altered) in enumerate(own):
                proof = sha256(b"".join(a + b for a, b in block.siblings(i)))
                proof.update(path.siblings)
                replaced = leaf if altered is None else altered
                folded = path.fold(block.fold(i, replaced.hex().encode()))
                out.append((doc_id, leaf, subroot, proof.hexdigest(), folded.decode()))
            yield _table(out, _PROOF_ARROW)

    above = paths.withColumns({"doc_id": F.lit(None).cast("long"), "altered": F.lit(None).cast("binary")})
    return _by_block(leaves.unionByName(above)).mapInArrow(prove, _PROOF)


def _tiers(nodes: DataFrame) -> list[DataFrame]:
    """Node tables of all tiers, from ``nodes`` to one node per tree."""
    tiers = [nodes]
    for _ in range(0, nodes.agg(F.max("left")).first()[0] or 0, LEVELS):
        tiers.append(materialize(climb(tiers[-1].select(*_NODE_ARROW.names)), "tier"))
    return tiers


def manifest(docs: DataFrame, group: str, leaf: Column, altered: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    ``leaf`` is a row's digest, ``altered`` the digest it is folded with (NULL: its own).
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(group).alias("grp"), leaf.alias("digest"),
                       altered.alias("altered"), F.monotonically_increasing_id().alias("row"))
    rows = materialize(rows, "leaves")
    groups = ranked(materialize(rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), "groups"), [], ["grp"])
    groups = groups.select("grp", "n", F.col("pos").alias("tree"))
    placed = ranked(join_group_params(rows, groups, ["grp"], weight="n"), ["tree"], ["doc_id", "digest", "row"])
    placed = materialize(placed.withColumn("left", depth_of(F.col("size"))), "placed")
    own = _tiers(_nodes(placed))
    # The subroots are the leaves of the tree over all groups.
    n_groups = own[-1].count()
    subroots = own[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), "digest")
    top = _tiers(_nodes(subroots.withColumn("left", depth_of(F.lit(n_groups)))))
    found = top[-1].select("digest").first()
    root = found[0].hex() if found else ""
    path = docs.sparkSession.createDataFrame([(0, 0, -1, None, None, [], [])], _NODE)
    for tier in reversed(top[:-1]):
        path = materialize(descend(tier, path, mark=False), "path")
    if len(top) == 1:  # one group at most: nothing stands beside its subroot
        path = _above(own[-1])
    else:  # a subroot's place among all is its tree
        path = path.select(F.col("block").alias("tree"), F.lit(0).cast("long").alias("block"),
                           F.lit(-1).cast("long").alias("pos"), "left", "digest", "lefts", "rights")
    for tier in reversed(own[1:-1]):
        path = materialize(descend(tier, path, mark=True), "path")
    at = F.shiftright("pos", _TIER).alias("block")
    filled = placed.select("tree", at, "pos", "left", "digest", *[F.lit(None).cast("array<string>").alias(c)
                           for c in ("lefts", "rights")], "doc_id", "altered")
    proofs = _prove(filled, path)
    return proofs.select(
        "doc_id", F.lower(F.hex("leaf")).alias("leaf"), F.lower(F.hex("subroot")).alias("subroot"),
        F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"),
    )


def _above(tops: DataFrame) -> DataFrame:
    """Empty paths above trees that are roots themselves."""
    none = F.array().cast("array<string>")
    return tops.select("tree", F.lit(0).cast("long").alias("block"), F.lit(-1).cast("long").alias("pos"), "left",
                       "digest", none.alias("lefts"), none.alias("rights"))


#: Tampering takes the rows whose unsigned crc32 of the decimal doc_id this divides.
TAMPER = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def document_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents`` by lang; some texts are lower-cased after the tree was built."""
    others = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER == 0
    changed = F.when(hit, row_digest(*others, F.translate("text", _UPPER, _LOWER)))
    return manifest(docs, "lang", row_digest(*others, F.col("text")), changed)
