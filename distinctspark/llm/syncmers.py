"""Document fingerprints by closed syncmers, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from distinctspark.session import materialize

#: A k-mer is K words; it is an anchor if the least of its inner S-word hashes is its first or last.
K, S = 8, 2
_FIRST = -(1 << 63)


def _later(a: str, by: int) -> Column:
    """The array without its first ``by`` elements."""
    return F.slice(a, by + 1, F.size(a))


def _pair(a: str, by: int, f) -> Column:
    """f(a[i], a[i + by]) for every i; beyond the end a[i + by] is NULL."""
    return F.zip_with(a, _later(a, by), f)


def with_anchors(df: DataFrame, texts: dict[str, str]) -> DataFrame:
    """Add an ``array<int>`` of distinct anchors for each text column: {text: new column}.

    Hashes of 2, 4 and 8 words are built by doubling, and so are the minima over the K - S + 1
    inner hashes.  Every layer is a projection of its own, so no array is computed twice; each
    costs a pass over the words.  A text of 1 to K - 1 words has one anchor, its whole sequence, and a
    longer one without a syncmer the least of its k-mers, so every text with words has an anchor.
    No words give none.  NULL counts as empty.
    """
    kept = df.columns

    def layer(new: dict[str, Column | None]) -> None:
        nonlocal df
        added = {k: v for k, v in new.items() if v is not None}
        df = df.select(*[F.col(c) for c in df.columns if c not in new],
                       *[v.alias(k) for k, v in added.items()])

    for i, text in enumerate(texts):
        w, h, h2, h4, h8 = (f"_{x}{i}" for x in ("w", "h", "h2", "h4", "h8"))
        m2, m4, m7, out = (f"_{x}{i}" for x in ("m2", "m4", "m7", "out"))
        # Other white space becomes a space; empty parts between spaces are no words.
        plain = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\f\r", "     ")
        layer({w: F.array_remove(F.split(plain, " "), "")})
        layer({h: F.transform(w, lambda x: F.xxhash64(x))})
        layer({h2: _pair(h, 1, lambda a, b: F.xxhash64(a, b)), w: None})
        layer({h4: _pair(h2, 2, lambda a, b: F.xxhash64(a, b)),
               m2: _pair(h2, 1, lambda a, b: F.least(a, b))})
        layer({h8: _pair(h4, 4, lambda a, b: F.xxhash64(a, b)),
               m4: _pair(m2, 2, lambda a, b: F.least(a, b)), h4: None, m2: None})
        layer({m7: _pair(m4, 3, lambda a, b: F.least(a, b)),
               out: _pair(h2, K - S, lambda a, b: F.least(a, b)), m4: None, h2: None})
        # The least inner hash of the whole k-mer equals that of its two edges.
        layer({out: F.zip_with(m7, out, lambda m, edge: m == edge), m7: None})
        top = F.zip_with(out, h8, lambda edge, whole: F.when(edge, F.shiftright(whole, 32).cast("int")))
        whole = F.shiftright(F.xxhash64(h), 32).cast("int")
        n = F.size(h) - (K - 1)
        layer({out: F.when(n > 0, F.array_distinct(F.array_compact(F.slice(top, 1, F.greatest(n, F.lit(0))))))
               .when(F.size(h) > 0, F.array(whole)).otherwise(F.array().cast("array<int>"))})
        # A short text may hold no syncmer; its least k-mer stands for it then.
        least = F.shiftright(F.array_min(F.slice(h8, 1, F.greatest(n, F.lit(0)))), 32).cast("int")
        layer({out: F.when((F.size(out) == 0) & (n > 0), F.array(least)).otherwise(F.col(out)),
               h8: None, h: None})
    names = {f"_out{i}": name for i, name in enumerate(texts.values())}
    return df.withColumnsRenamed(names).select(*kept, *texts.values())


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two anchor sets; 1 where both are empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def fingerprint(anchors: str) -> Column:
    """Anchors in text order as one string."""
    return F.array_join(F.col(anchors).cast("array<string>"), " ")


def next_documents(ids: DataFrame) -> DataFrame:
    """(d, t, n, nd, nt): for each row of (d, t, n) the next by descending d, the last's the first.

    Rows are range-partitioned; within a part the next row is found by a window over that part,
    and a part's last row takes the first of the next part from a table of one row per part.
    """
    spark = ids.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("d").desc(), F.col("t").desc()]
    ranged = materialize(
        ids.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranged")
    within = Window.partitionBy("part").orderBy(*order)
    heads = ranged.groupBy("part").agg(F.max(F.struct("d", "t")).alias("head"))
    every = Window.orderBy("part")
    first = F.first("head").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("part", F.coalesce(F.lead("head").over(every), first).alias("after"))
    # At most one row per shuffle partition, so it is safe to broadcast.
    rows = ranged.withColumn("next", F.lead(F.struct("d", "t")).over(within)).join(
        F.broadcast(heads), "part")
    nxt = F.coalesce("next", "after")
    return rows.select("d", "t", "n", nxt["d"].alias("nd"), nxt["t"].alias("nt"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint every whole text, its edited text, and measure likeness.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and
    near_next.  The edited text has the last floor(n_chars / 3) code points replaced by the first
    as many (or all) of the next document in descending doc_id; the last one's next is the first.

    A NULL text is empty, with an empty fingerprint.  A NULL doc_id counts as the smallest.  Rows
    that repeat a doc_id are ordered by a hash of their text; rows equal in both are one document
    and get equal results.  Other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST))
    named = docs.select(d.alias("d"), text.alias("text")).select(
        "d", F.xxhash64("text").alias("t"), "text")
    ids = named.select("d", "t", F.length("text").alias("n")).distinct()
    order = next_documents(ids)
    # Both joins take the same columns by the same key, so the texts are dealt out once; anchors
    # are made behind the exchange, since plans that hold lambdas are not seen to be equal.
    # Renamed columns would set the exchanges apart as well.
    n_new = F.floor(F.col("n") / 3).cast("int")
    o, x = order.alias("o"), named.alias("x")
    heads = o.join(x, (F.col("o.nd") == F.col("x.d")) & (F.col("o.nt") == F.col("x.t"))).select(
        "o.d", "o.t", "o.n", F.col("x.text").alias("next_text"))
    heads = with_anchors(heads, {"next_text": "next_anchors"}).select(
        "d", "t", "n", F.substring("next_text", F.lit(1), n_new).alias("head"), "next_anchors")
    # Where the next document's row is repeated, one of the equal rows is enough.
    heads = heads.groupBy("d", "t").agg(
        F.first("n").alias("n"), F.first("head").alias("head"), F.first("next_anchors").alias("next_anchors"))
    rows = with_anchors(named.join(heads, ["d", "t"]), {"text": "anchors"})
    edited = F.concat(F.substring("text", F.lit(1), F.col("n") - n_new), "head")
    doc_id = F.when(F.col("d") != _FIRST, F.col("d")).alias("doc_id")
    rows = rows.select(doc_id, F.col("n").cast("long").alias("n_chars"), "anchors", "next_anchors",
                       edited.alias("edited"))
    rows = with_anchors(rows, {"edited": "edited_anchors"})
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint("anchors").alias("fingerprint"),
        fingerprint("edited_anchors").alias("edited_fingerprint"),
        likeness("anchors", "edited_anchors").alias("near_edited"),
        likeness("anchors", "next_anchors").alias("near_next"))
