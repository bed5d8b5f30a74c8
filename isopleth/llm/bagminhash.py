"""Near duplicates by BagMinHash: weighted-Jaccard signatures, banding, verified multiset overlap.

A document is the multiset of its five-word shingles. Each shingle owns Poisson processes over its weight
axis, cut into dyadic ranges: range [0,1) and [2^(j-1), 2^j). A point of a process has a time, a signature
slot and a level; it counts for a document whose weight exceeds the level. A slot keeps the earliest time, so
two documents agree in a slot with probability equal to their weighted Jaccard similarity, exactly, for
whole-number weights. Points come in order of time, and a process stops once it is later than all slots.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, free_name, resident, small
from .shingles import hash_words, mix64, multiset, overlap, shingles, split_words

WIDTH, SIMILARITY = 5, 0.8
#: A pair at similarity 0.8 shares none of the 30 bands with probability (1 - 0.8^5)^30, under one in 100,000.
BANDS, ROWS = 30, 5
SLOTS = BANDS * ROWS
#: Shingles signed together, and the most ids that are broadcast to fetch their texts.
BATCH_SHINGLES, BROADCAST_IDS = 100_000, 200_000
#: Size of a block of a bucket, and columns of the membership matrix multiplied at once.
BLOCK_CHARS, BLOCK_ROWS, MATRIX_COLUMNS = 1_000_000, 1000, 4096

_GOLD = 0x9E3779B97F4A7C15


def _unit(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def signatures(bags: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """BagMinHash of each array of shingle hashes, repeats being weight: earliest times, bags x slots; infinite for an empty bag."""
    best = np.full((len(bags), slots), np.inf)
    owner, seed, rate, low, weight = [], [], [], [], []
    for i, bag in enumerate(bags):
        values, counts = np.unique(bag, return_counts=True)
        level, span, j = 0, 1, 0
        while len(values):
            owner.append(np.full(len(values), i))
            seed.append(mix64(values + np.uint64((j + 1) * _GOLD & 2**64 - 1)))
            rate.append(np.full(len(values), float(span)))
            low.append(np.full(len(values), float(level)))
            weight.append(counts)
            level, span, j = level + span, max(1, level + span), j + 1
            more = counts > level
            values, counts = values[more], counts[more]
    if not owner:
        return best
    owner, seed, rate, low, weight = map(np.concatenate, (owner, seed, rate, low, weight))
    time, turn = np.zeros(len(owner)), 0
    flat = best.reshape(-1)
    latest = np.full(len(bags), np.inf)
    while len(owner):
        turn += 1
        a = mix64(seed + np.uint64(turn * _GOLD & 2**64 - 1))
        b = mix64(a ^ seed)
        time = time - np.log(_unit(a)) / rate
        hit = time < latest[owner]
        partial = low + rate > weight  # only part of the range belongs to the document
        if partial.any():
            hit &= ~partial | (low + np.floor(_unit(mix64(b + np.uint64(_GOLD))) * rate) < weight)
        np.minimum.at(flat, owner[hit] * slots + (b[hit] % np.uint64(slots)).astype(np.int64), time[hit])
        live = np.unique(owner)
        latest[live] = best[live].max(1)
        keep = time < latest[owner]
        owner, seed, rate, low, weight, time = (x[keep] for x in (owner, seed, rate, low, weight, time))
    return best


def band_keys(best: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    bits = best.view(np.uint64).reshape(len(best), -1, rows)
    out = np.broadcast_to(np.arange(bits.shape[1], dtype=np.uint64), bits.shape[:2]).copy()
    for k in range(rows):
        out = mix64(out + bits[:, :, k] + np.uint64(_GOLD))
    return out


def sign(docs: DataFrame) -> DataFrame:
    """(doc_id, form, copy binary, bands array<long>) of every row with words and a doc_id: a hash of the text as it stands, a digest of its words, the band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident("none", lambda: None)
        for batch in batches:
            ids, forms, copies, bags, held = [], [], [], [], 0

            def flush(ids: list, forms: list, copies: list, bags: list) -> pa.RecordBatch:
                keys = band_keys(signatures(bags)).view(np.int64)
                return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(forms, pa.int64()), pa.array(copies, pa.binary()), pa.array(list(keys), pa.list_(pa.int64()))], ["doc_id", "form", "copy", "bands"])

            for doc_id, form, text in zip(batch.column("doc_id").to_pylist(), batch.column("form").to_pylist(), batch.column("text")):
                words = split_words(text.as_py())
                if not words or doc_id is None:
                    continue
                ids.append(doc_id)
                forms.append(form)
                copies.append(xxhash.xxh3_128_digest(b" ".join(words)))
                bags.append(shingles(hash_words(words), WIDTH))
                held += len(bags[-1])
                if held > BATCH_SHINGLES:
                    yield flush(ids, forms, copies, bags)
                    ids, forms, copies, bags, held = [], [], [], [], 0
            if ids:
                yield flush(ids, forms, copies, bags)

    return _formed(docs).mapInArrow(run, "doc_id long, form long, copy binary, bands array<long>")


def _formed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("form"), "text")


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Those of `pairs` (a, b) whose multiset overlap reaches `similarity`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [batch.column(c).to_pylist() for c in ("a", "b")]
            last: tuple[bytes | None, np.ndarray] = (None, np.zeros(0, np.uint64))
            good = []
            for b, x, y in zip(ids[1], batch.column("text_a"), batch.column("text_b")):
                if last[0] != b:
                    last = (b, multiset(shingles(hash_words(split_words(y.as_py())), WIDTH)))
                mine = multiset(shingles(hash_words(split_words(x.as_py())), WIDTH))
                fewer, more = sorted((len(mine), len(last[1])))
                good.append(fewer >= similarity * more and overlap(mine, last[1]) >= similarity)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    kind = pairs.schema["a"].dataType.simpleString()
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, f"a {kind}, b {kind}")


def linked(bags: list[np.ndarray], labels: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """One pair of positions for each two labels that some two of the bags (in the form of `multiset`) link.

    Overlaps of all pairs come from products of the membership matrix, a slice of its columns at a time.
    """
    sizes = np.array([len(b) for b in bags], np.float32)
    flat, owner = np.concatenate(bags), np.repeat(np.arange(len(bags)), sizes.astype(np.int64))
    values, column, counts = np.unique(flat, return_inverse=True, return_counts=True)
    useful = counts > 1
    place = np.cumsum(useful) - 1
    keep = useful[column]
    owner, column, width = owner[keep], place[column[keep]], int(useful.sum())
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared = np.zeros((len(bags), len(bags)), np.float32)
    for at in range(0, width, MATRIX_COLUMNS):
        lo, hi = np.searchsorted(column, (at, at + MATRIX_COLUMNS))
        part = np.zeros((len(bags), min(MATRIX_COLUMNS, width - at)), np.float32)
        part[owner[lo:hi], column[lo:hi] - at] = 1
        shared += part @ part.T
    good = (shared >= similarity * (sizes[:, None] + sizes[None] - shared) - 1e-3) & (labels[:, None] < labels[None])
    found: dict[tuple[int, int], tuple[int, int]] = {}
    for x, y in zip(*np.nonzero(good)):
        if (ends := (int(labels[x]), int(labels[y]))) not in found and overlap(bags[x], bags[y]) >= similarity:
            found[ends] = (int(x), int(y))
    return list(found.values())


def _links_in_blocks(members: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links between members (bucket, id, label) of one bucket that differ in label.

    Blocks hold about BLOCK_CHARS of text or BLOCK_ROWS members. A label with more than one block's worth in a
    bucket gets blocks of its own, which meet those of all other labels but not each other; the other labels
    share blocks, which meet all blocks. So rows move by the block, never by the pair, and a class that fills a
    bucket is not compared with itself.
    """
    held = checkpoint(members.join(texts, "id").select("bucket", "id", "label", "text"))
    blocks = F.ceil(F.greatest(F.sum(F.length("text")) / BLOCK_CHARS, F.count("*") / BLOCK_ROWS)).cast("int")
    share = F.greatest(F.sum(F.length("text")) / BLOCK_CHARS, F.count("*") / BLOCK_ROWS)
    labels = held.groupBy("bucket", "label").agg(blocks.alias("cuts"), share.alias("share"))
    large = checkpoint(labels.where("cuts > 1"))
    before = Window.partitionBy("bucket").orderBy("label").rowsBetween(Window.unboundedPreceding, -1)
    own = large.withColumn("first", F.coalesce(F.sum("cuts").over(before), F.lit(0)).cast("int")).select("bucket", "label", "cuts", "first")
    mixed = labels.groupBy("bucket").agg(F.ceil(F.coalesce(F.sum(F.when(F.col("cuts") == 1, F.col("share"))), F.lit(0))).cast("int").alias("mixed"), F.coalesce(F.sum(F.when(F.col("cuts") > 1, F.col("cuts"))), F.lit(0)).cast("int").alias("rest"))
    placed = held.join(small(own), ["bucket", "label"], "left").join(small(mixed), "bucket")
    cut = F.col("cuts").isNotNull()
    start = F.col("mixed") + F.col("first")
    block = F.when(cut, start + F.pmod(F.xxhash64("id"), F.col("cuts"))).otherwise(F.pmod(F.xxhash64("label"), F.greatest("mixed", F.lit(1)))).cast("int")
    everyone = F.sequence(F.lit(0), F.col("mixed") + F.col("rest") - 1)
    met = F.when(cut, F.filter(everyone, lambda other: (other < start) | (other >= start + F.col("cuts")))).otherwise(everyone)
    sent = placed.select("bucket", "id", "label", "text", block.alias("block"), met.alias("met")).select("bucket", "id", "label", "text", "block", F.explode("met").alias("other"))
    named = sent.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "label", "text")
    # dealt by pair of blocks: by bucket alone, as the join leaves them, a hot bucket's pairs would meet in one task
    paired = named.repartition("bucket", "i", "j").groupBy("bucket", "i", "j").agg(F.collect_list(F.struct("id", "label", "text")).alias("rows"))
    kind = members.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends: list[tuple] = []
            for rows in batch.column("rows"):
                ids, labels = (rows.values.field(c).to_pylist() for c in ("id", "label"))
                bags = [multiset(shingles(hash_words(split_words(t.as_py())), WIDTH)) for t in rows.values.field("text")]
                number = {label: n for n, label in enumerate(sorted(set(labels)))}
                ends += [(ids[x], ids[y]) for x, y in linked(bags, np.array([number[x] for x in labels]), similarity)]
            ends = list(dict.fromkeys(ends))
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in ends], pa.binary() if kind == "binary" else pa.int64()) for k in (0, 1)], ["a", "b"])

    return paired.select("rows").mapInArrow(run, f"a {kind}, b {kind}").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of every end of `edges` (a, b): label is the least id that it is connected with.

    Each round gives a node the least label among its own and its neighbours', then the label of its label.
    """
    both = checkpoint(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpoint(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("label")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        moved = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("id").alias("next"), F.col("label").alias("far"))
        after = checkpoint(moved.join(jump, "next").select("id", F.col("label").alias("before"), F.least("next", "far").alias("label")))
        changed = after.where("before <> label").limit(1).count()
        labels = after.select("id", "label")
        if not changed:
            return labels


def _classes(docs: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Of every row with words and a doc_id (doc_id, form, copy), and of every copy (copy, label, id, form): the class's label and the copy's first row.

    Equal word sequences are one copy from the start. Members of band buckets are first compared with one
    leader each; then, in buckets whose members still differ in class, those of different classes with each
    other, block by block inside the tasks, where only links come out. Every link is verified, and no pair of a
    bucket is left out but those of one class already.
    """
    signed = checkpoint(sign(docs))
    copies = checkpoint(signed.groupBy("copy").agg(F.min(F.struct("doc_id", "form")).alias("first"), F.first("bands").alias("bands")))
    bands = copies.select(F.col("copy").alias("id"), F.explode("bands").alias("bucket"))
    # what is joined to hot buckets is written out first, so that the joins can be split
    sizes = checkpoint(bands.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    members = checkpoint(bands.join(sizes, "bucket"))
    needed = copies.join(members.select(F.col("id").alias("copy")).distinct(), "copy", "left_semi").select(F.col("copy").alias("id"), "first.doc_id", "first.form")
    needed = small(needed, BROADCAST_IDS)
    texts = checkpoint(_formed(docs).join(needed, ["doc_id", "form"]).groupBy("id").agg(F.min("text").alias("text")))
    # the member with most bucket mates leads a bucket; a member is compared with the leader it meets most often
    mates = members.groupBy("id").agg(F.sum("n").alias("mates"))
    ranked = members.join(mates, "id")
    leaders = checkpoint(ranked.groupBy("bucket").agg(F.min_by("id", F.struct(-F.col("mates"), "id")).alias("leader")))
    led = members.join(leaders, "bucket").where("id <> leader").groupBy(F.col("id").alias("a"), F.col("leader").alias("b")).agg(F.count("*").alias("buckets"))
    first = led.groupBy("a").agg(F.min_by("b", F.struct(-F.col("buckets"), "b")).alias("b"))
    edges = checkpoint(_verified(first, texts, similarity))
    labels = components(edges)
    marked = checkpoint(members.join(labels, "id", "left").select("bucket", "id", F.coalesce("label", "id").alias("label")))
    mixed = checkpoint(marked.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("bucket"))
    links = checkpoint(_links_in_blocks(marked.join(mixed, "bucket"), texts, similarity))
    labels = components(edges.unionByName(links)).withColumnRenamed("id", "copy")
    return signed.select("doc_id", "form", "copy"), checkpoint(copies.join(labels, "copy", "left").select("copy", F.coalesce("label", "copy").alias("label"), F.col("first.doc_id").alias("id"), F.col("first.form").alias("form")))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id): one row per row of `docs` (doc_id, text); class_id is the least doc_id of its class.

    A class is what links of `similarity` or more, and rows that share a doc_id, connect. Documents without
    words, or without a doc_id, are classes of their own. An empty table gives no rows.
    """
    rows, copies = _classes(docs, similarity)
    least = checkpoint(copies.groupBy("label").agg(F.min("id").alias("class_id")))  # written out, so that a large class's join can be split
    classed = checkpoint(copies.select("copy", "label").join(least, "label").select("copy", "class_id"))
    labelled = checkpoint(rows.join(classed, "copy").groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.max("class_id").alias("other")))
    # a doc_id with texts of several classes makes them one
    several = rows.join(labelled.where("class_id <> other").select("doc_id", F.col("class_id").alias("a")), "doc_id").join(classed.withColumnRenamed("class_id", "b"), "copy").where("a <> b").select("a", "b")
    joined = components(several.distinct()).select(F.col("id").alias("class_id"), F.col("label").alias("whole"))
    found = labelled.join(joined, "class_id", "left").select("doc_id", F.coalesce("whole", "class_id").alias("class_id"))
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("class_id", F.col("doc_id").cast("long")).alias("class_id"))


def deduplicate(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """`docs` with one row of each class of texts kept, that of the least doc_id; rows without words or a doc_id are kept.

    Rows alike in doc_id and text count once. Rows that share a doc_id but not their text are judged apart.
    """
    rows, copies = _classes(docs.select("doc_id", "text"), similarity)
    least = copies.groupBy("label").agg(F.min(F.struct("id", "form")).alias("least")).select("label", F.col("least.id").alias("least_id"), F.col("least.form").alias("least_form"))
    classed = checkpoint(copies.select("copy", "label").join(checkpoint(least), "label").drop("label"))
    judged = rows.join(classed, "copy")
    dropped = small(judged.where("doc_id <> least_id or form <> least_form").select(F.col("doc_id").alias(here := free_name(docs, "dropped_id")), F.col("form").alias(gone := free_name(docs, "dropped_form"))).distinct(), BROADCAST_IDS)
    formed = docs.withColumn(form := free_name(docs, "form"), F.xxhash64("text"))
    kept = formed.join(dropped, (F.col("doc_id").cast("long") == F.col(here)) & (F.col(form) == F.col(gone)), "left_anti")
    if rows.groupBy("doc_id", "form").count().where("count > 1").limit(1).count():
        kept = kept.where("doc_id is null").unionByName(kept.where("doc_id is not null").dropDuplicates(["doc_id", form]))
    return kept.select(docs.columns)
