"""Personal data: base patterns, and contexts bootstrapped from what those find."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from distinctspark.llm.words import Words, window_hashes, word_chunks
from distinctspark.session import materialize

KINDS = ("email", "ip", "card", "phone")
#: Kinds that are not counted; their seeds are spans beside the base ones.
SECRET = "secret"
ORDER = (*KINDS, SECRET)
#: Words left of an entity that make its pattern.
CONTEXT = 2
#: A pattern of a kind needs so many different entities of it, ...
MIN_ENTITIES = 3
#: ... counts so many misses beforehand, and is trusted from this confidence on.
PRIOR, TRUST = 1.0, 0.5
#: Rounds of scoring, and the score from which a new identifier is accepted.
ROUNDS, ACCEPT = 3, 0.8
#: Bits of the sieve that picks pattern occurrences out of the texts: 1 MB whatever the corpus.
SIEVE_BITS = 23

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# The characters of an address's local part.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CANDIDATE = re.compile(r"[^\s\"'<>(),;=:\[\]{}|]+")
_DIGITS = re.compile(r"[^0-9]+")
#: Seeds of secrets: long runs of small hexadecimal digits, of both sorts.  Keys that are written in
#: other ways are what their contexts are there to discover.
_HEX = re.compile(r"(?<![0-9A-Za-z])(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{32,64}(?![0-9A-Za-z])")
Span = tuple[int, int]


def _emails(text: str) -> list[Span]:
    """Leftmost, non-overlapping: every @ is tried once, its local part read backwards."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        end = _DOMAIN.match(text, at + 1) if start < at else None
        if end:
            last = end.end()
            found.append((start, last))
        at = text.find("@", max(at + 1, last))
    return found


def _luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[Span]]:
    """The base entities of a text per kind, as code point offsets."""
    found: dict[str, list[Span]] = {kind: [] for kind in KINDS}
    if "@" in text:
        found["email"] = _emails(text)
    for m in _IP.finditer(text):
        if all(int(part[-4:]) <= 255 and len(part.lstrip("0")) < 4 for part in m[0].split(".")):
            found["ip"].append(m.span())
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m[0]) if len(m[0]) >= 13 else ""
        if 13 <= len(digits) <= 19 and _luhn(digits):
            found["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.sub("", m[0])) <= 15:
                found["phone"].append(m.span())
    return found


def secret_seeds(text: str, taken: list[Span]) -> list[Span]:
    """Hexadecimal keys clear of the base entities."""
    found = [m.span() for m in _HEX.finditer(text)]
    return [s for s in found if not any(a < s[1] and s[0] < b for a, b in taken)]


def candidate_spans(text: str, taken: list[Span]) -> list[Span]:
    """Tokens that may be identifiers: four digits or an @, clear of the base entities."""
    found, taken, k = [], sorted(taken), 0
    for m in _CANDIDATE.finditer(text):
        token = m[0].rstrip(".!?-")
        if len(token) < 5 or ("@" not in token and sum(map(str.isdigit, token)) < 4):
            continue
        start, end = m.start(), m.start() + len(token)
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if k == len(taken) or taken[k][0] >= end:
            found.append((start, end))
    return found


def _listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def _instance(value: str) -> int:
    name = hashlib.blake2b(value.lower().encode("utf-8", "surrogatepass"), digest_size=8)
    return int.from_bytes(name.digest(), "little", signed=True)


def _patterns(chunk: Words, row: int, text: str, starts: list[int], hashes: dict) -> list[int | None]:
    """For each start, the hash of the CONTEXT words that end before it, if so many stand there."""
    low, high = chunk.offsets[row], chunk.offsets[row + 1]
    ends = chunk.ends[low:high] - chunk.rows[row]
    plain = text.isascii()
    out: list[int | None] = []
    for start in starts:
        place = start if plain else len(text[:start].encode("utf-8", "surrogatepass"))
        word = int(np.searchsorted(ends, place, "right"))
        out.append(hashes.get(low + word - CONTEXT) if word >= CONTEXT else None)
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d, t, text) rows to (d, t, base spans, mentions): base entities and candidates in context."""
    mention = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                         ("pattern", pa.int64()), ("instance", pa.int64())])
    for batch in batches:
        texts = batch.column(2)
        for chunk in word_chunks(texts):
            listed, mentions, counts = [], [], {kind: [] for kind in KINDS}
            contexts = None
            for row in range(chunk.last - chunk.first):
                text = texts[chunk.first + row].as_py() or ""
                base = base_spans(text)
                spans = [(kind, *span) for kind in KINDS for span in base[kind]]
                taken = [span for own in base.values() for span in own]
                seeds = secret_seeds(text, taken)
                extra = candidate_spans(text, taken + seeds)
                every = spans + [(SECRET, *span) for span in seeds] + [(None, *span) for span in extra]
                if every and contexts is None:
                    hashes, at = window_hashes(chunk, CONTEXT)
                    contexts = dict(zip(at.tolist(), hashes.view(np.int64).tolist(), strict=True))
                patterns = _patterns(chunk, row, text, [s for _, s, _ in every], contexts) if every else []
                listed.append(_listed(spans))
                mentions.append([
                    {"kind": kind, "start": s, "end": e, "pattern": p, "instance": _instance(text[s:e])}
                    for (kind, s, e), p in zip(every, patterns, strict=True)])
                for kind in KINDS:
                    counts[kind].append(len(base[kind]))
            own = batch.slice(chunk.first, len(listed))
            yield pa.RecordBatch.from_arrays(
                [own.column(0), own.column(1), pa.array(listed, type=pa.string()),
                 *(pa.array(counts[kind], type=pa.int64()) for kind in KINDS),
                 pa.array(mentions, type=pa.list_(mention))],
                ["d", "t", "base", *(f"n_{kind}" for kind in KINDS), "mentions"])


def _occurrences(sieve: np.ndarray) -> Callable:
    """Counts of the windows of CONTEXT words that the sieve lets through, per batch of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in word_chunks(batch.column(0)):
                hashes, _ = window_hashes(chunk, CONTEXT)
                place = hashes >> np.uint64(64 - SIEVE_BITS)
                hit = (sieve[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1
                found, n = np.unique(hashes[hit.astype(bool)], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["pattern", "n"])

    return count


def _sieve(patterns: DataFrame) -> np.ndarray:
    """One bit per hashed pattern, set from distributed ORs of bytes: a fixed megabyte."""
    place = F.shiftrightunsigned("pattern", 64 - SIEVE_BITS).alias("place")
    bits = patterns.select(place).groupBy(F.expr("place >> 3").alias("byte")).agg(
        F.expr("bit_or(shiftleft(1, cast(place & 7 AS int)))").alias("bits"))
    sieve = np.zeros(1 << (SIEVE_BITS - 3), dtype=np.uint8)
    for row in bits.collect():
        sieve[row.byte] = row.bits
    return sieve


def bootstrap(texts: DataFrame, mentions: DataFrame) -> DataFrame:
    """(d, t, kind, start, end) of identifiers that trusted contexts discover.

    ``mentions`` are seeds (with a kind) and candidates (without) with their pattern, the
    hash of the words left of them.  Patterns that stand before MIN_ENTITIES different entities of
    a kind enter the graph; how often they stand in all texts, whatever follows, is counted over
    the corpus.  Then, ROUNDS times,

        confidence(pattern, kind) = sum of its instances' scores / (occurrences + PRIOR)
        score(instance, kind)     = 1 - product over its trusted patterns of (1 - confidence)

    where seeds score 1.  A candidate is accepted as the kind of its best score from
    ACCEPT on.  Words that any text may hold before an entity stand mostly before other words, so
    they are not trusted.
    """
    known = mentions.where("kind IS NOT NULL AND pattern IS NOT NULL")
    strong = known.groupBy("pattern", "kind").agg(F.countDistinct("instance").alias("entities"))
    strong = materialize(
        strong.where(F.col("entities") >= MIN_ENTITIES).select("pattern", "kind"), "patterns")
    names = strong.select("pattern").distinct()
    totals = texts.select("text").mapInArrow(_occurrences(_sieve(names)), "pattern long, n long")
    totals = totals.groupBy("pattern").agg(F.sum("n").alias("total"))
    graph = strong.join(totals, "pattern")
    edges = mentions.join(names, "pattern").groupBy("pattern", "instance", "kind").agg(
        F.count("*").alias("n"))
    edges = materialize(edges.withColumnRenamed("kind", "known"), "edges")
    graph = materialize(graph, "graph")
    scores = None
    for _ in range(ROUNDS):
        own = edges.join(graph, "pattern")
        if scores is None:
            score = F.when(F.col("known") == F.col("kind"), 1.0).otherwise(0.0)
            own = own.withColumn("score", score)
        else:
            own = own.join(scores, ["instance", "kind"], "left").withColumn("score", F.when(
                F.col("known").isNotNull(), F.when(F.col("known") == F.col("kind"), 1.0).otherwise(0.0)
            ).otherwise(F.coalesce("score", F.lit(0.0))))
        trust = own.groupBy("pattern", "kind").agg(
            (F.sum(F.col("n") * F.col("score")) / (F.first("total") + PRIOR)).alias("confidence"))
        trusted = trust.where(F.col("confidence") >= TRUST)
        miss = F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-12)))
        scores = edges.where("known IS NULL").select("pattern", "instance", "n").join(
            trusted, "pattern").groupBy("instance", "kind").agg(
            (1 - F.exp(F.sum(miss))).alias("score"))
        scores = materialize(scores, "scores")
    best = scores.where(F.col("score") >= ACCEPT).groupBy("instance").agg(
        F.max(F.struct("score", "kind")).alias("best"))
    found = mentions.where("kind IS NULL").drop("kind").join(best, "instance")
    return found.select("d", "t", F.col("best.kind").alias("kind"), "start", "end")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row of ``docs``.

    The counts and the digest are of the base entities; ``spans`` lists these, the seeds of secrets
    and the identifiers that bootstrapping adds, as kind:start:end (code points, end exclusive), by
    kind (secrets last), then start.

    A NULL text is empty, with no spans.  Rows equal in doc_id (NULL included) and text are one
    document and get equal results.  Other columns are ignored; an empty table gives no rows.
    """
    texts = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"),
        F.xxhash64("text").alias("t"), F.col("text").cast("string"))
    kind = "array<struct<kind:string,start:long,end:long,pattern:long,instance:long>>"
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    scanned = materialize(
        texts.mapInArrow(_scan, f"d long, t long, base string, {counts}, mentions {kind}"), "scanned")
    mentions = scanned.select("d", "t", F.explode("mentions").alias("m")).select("d", "t", "m.*")
    seeds = mentions.where(F.col("kind") == SECRET).select("d", "t", "kind", "start", "end")
    added = bootstrap(texts, mentions).unionByName(seeds).distinct()
    order = F.array_position(F.array(*map(F.lit, ORDER)), F.col("kind"))
    added = added.groupBy("d", "t").agg(
        F.collect_list(F.struct(order.alias("order"), "start", "end", "kind")).alias("added"))
    rows = scanned.drop("mentions").join(added, ["d", "t"], "left")
    base = F.transform(F.array_remove(F.split("base", ","), ""), lambda s: F.struct(
        F.array_position(F.array(*map(F.lit, KINDS)), F.element_at(F.split(s, ":"), 1)).alias("order"),
        F.element_at(F.split(s, ":"), 2).cast("long").alias("start"),
        F.element_at(F.split(s, ":"), 3).cast("long").alias("end"),
        F.element_at(F.split(s, ":"), 1).alias("kind")))
    every = F.array_join(F.transform(
        F.array_sort(F.concat(base, "added")),
        lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    # Two spans of one kind that start together have the shorter first.
    spans = F.when(F.col("added").isNull(), F.col("base")).otherwise(every)
    doc_id = F.when(F.col("d") != -(1 << 63), F.col("d")).alias("doc_id")
    return rows.select(doc_id, *(f"n_{k}" for k in KINDS),
                       F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"),
                       spans.alias("spans"))
