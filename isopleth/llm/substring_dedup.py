"""Substring dedup by level-wise doubling: windows repeated at one length alone go on to twice that length.

The question is which windows of `window` words begin in a document with a smaller doc_id as well. Levels
run up to that length by doubling (7, 13, 25, 50 for 50). At each shorter level a window stands or falls with its
anchor, the least hash among the shorter windows inside it: equal windows have equal anchors, so a window
whose anchor is found in one document only is out, and only texts with windows left go on to the next level,
until none is left. About one word in twenty-two is an anchor at the first level, so this moves little. Windows that survive all shorter levels are compared at full length, by runs that share an anchor:
equal runs at once, runs that differ under one anchor window by window. Equal texts are judged once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint
from .shingles import hash_words, mix64, split_words

WINDOW = 50
#: The first level is the shortest halving of the window that has this many words at least.
SHORTEST = 7
#: Keys are broadcast, to fetch the texts that they stand for, up to this number.
BROADCAST_KEYS = 200_000
BATCH_ROWS = 64

_BASE = 0x9E3779B97F4A7C15
_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)


def levels(window: int, shortest: int = SHORTEST) -> list[int]:
    """Lengths up to `window`, each at most twice the one before."""
    out = [window]
    while (out[0] + 1) // 2 >= shortest:
        out.insert(0, (out[0] + 1) // 2)
    return out


def gram_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of `length` words, from prefix sums of a polynomial."""
    global _POWERS, _INVERSES
    n = len(words)
    if n < length:
        return words[:0]
    if len(_POWERS) < n:
        size = 1 << n.bit_length()
        _POWERS = np.cumprod(np.full(size, _BASE, np.uint64))
        _INVERSES = np.cumprod(np.full(size, pow(_BASE, -1, 2**64), np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(words) * _POWERS[:n])])
    return mix64((sums[length:] - sums[:-length]) * _INVERSES[: n - length + 1])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every `width` neighbours."""
    span = 1
    while span * 2 <= width:
        values, span = np.minimum(values[:-span], values[span:]), span * 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def anchors(words: np.ndarray, window: int, length: int) -> np.ndarray:
    """The anchor of every window at the level of `length`."""
    grams = gram_hashes(words, length)
    return sliding_least(grams, window - length + 1) if len(words) >= window else grams[:0]


def _standing(words: np.ndarray, window: int, lengths: list[int], repeated: list[list[int]]) -> np.ndarray:
    """Which windows have a repeated anchor at all the levels judged so far."""
    alive = np.ones(max(0, len(words) - window + 1), bool)
    for length, found in zip(lengths, repeated):
        alive &= np.isin(anchors(words, window, length), np.array(found or [], np.int64).view(np.uint64))
    return alive


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))).alias("key"), "text")


def _scan(docs: DataFrame, window: int, length: int) -> DataFrame:
    """(id, key, n_words, whole_sha256, anchors) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, found = [], [], []
            for text in batch.column("text"):
                words = split_words(text.as_py())
                counts.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                found.append(np.unique(anchors(hash_words(words), window, length)).view(np.int64) if len(words) >= window else [])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(found, pa.list_(pa.int64()))], ["id", "key", "n_words", "whole_sha256", "anchors"])

    return _keyed(docs).mapInArrow(run, "id long, key binary, n_words long, whole_sha256 string, anchors array<long>")


def _with_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """`wanted` (key, id, ...) with the texts: only those rows of `docs` move."""
    keys = wanted.select("key", "id")
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    return _keyed(docs).join(keys, ["key", "id"], "left_semi").select("key", "text").join(wanted, "key")


def _repeated(found: DataFrame) -> DataFrame:
    """Of (key, id, anchors): (key, id, repeated), the anchors that documents with other ids have too; none, no row."""
    each = found.select("key", "id", F.explode("anchors").alias("anchor"))
    # written out, so that the join of an anchor that very many documents have can be split
    shared = checkpoint(each.groupBy("anchor").agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x <> y").select("anchor"))
    return each.join(shared, "anchor").groupBy("key", "id").agg(F.collect_list("anchor").alias("repeated"))


def _anchors_again(texts: DataFrame, window: int, lengths: list[int], judged: list[str]) -> DataFrame:
    """Anchors of the next level for the windows still standing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, *repeated in zip(batch.column("text"), *(batch.column(c).to_pylist() for c in judged)):
                words = hash_words(split_words(text.as_py()))
                alive = _standing(words, window, lengths, repeated)
                found.append(np.unique(anchors(words, window, lengths[len(judged)])[alive]).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("id"), pa.array(found, pa.list_(pa.int64()))], ["key", "id", "anchors"])

    return texts.mapInArrow(run, "key binary, id long, anchors array<long>")


def _runs(texts: DataFrame, window: int, lengths: list[int], judged: list[str]) -> DataFrame:
    """Runs of standing windows under one anchor: (key, id, anchor, run, start, windows), run and windows being hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(k, BATCH_ROWS)
                keys, ids, heads, runs, starts, windows = [], [], [], [], [], []
                for key, doc_id, text, *repeated in zip(batch.column("key").to_pylist(), batch.column("id").to_pylist(), batch.column("text"), *(batch.column(c).to_pylist() for c in judged)):
                    words = hash_words(split_words(text.as_py()))
                    alive = _standing(words, window, lengths, repeated)
                    if not alive.any():
                        continue
                    head, grams = anchors(words, window, lengths[-1]), gram_hashes(words, window)
                    fresh = alive & np.append(True, (head[1:] != head[:-1]) | ~alive[:-1])
                    begin = np.flatnonzero(fresh)
                    owner = np.cumsum(fresh) - 1
                    place = np.arange(len(alive)) - begin[np.maximum(owner, 0)]
                    sized = np.bincount(owner[alive], minlength=len(begin))
                    digest = np.zeros(len(begin), np.uint64)
                    np.add.at(digest, owner[alive], mix64(grams[alive] ^ mix64(place[alive].astype(np.uint64) + np.uint64(1))))
                    keys += [key] * len(begin)
                    ids += [doc_id] * len(begin)
                    heads.append(head[begin])
                    runs.append(mix64(digest + sized.astype(np.uint64)))
                    starts.append(begin)
                    windows += np.split(grams[alive].view(np.int64), np.cumsum(sized)[:-1])
                if keys:
                    long = lambda parts: pa.array(np.concatenate(parts).view(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64()), long(heads), long(runs), long(starts), pa.array(windows, pa.list_(pa.int64()))], ["key", "id", "anchor", "run", "start", "windows"])

    return texts.mapInArrow(run, "key binary, id long, anchor long, run long, start long, windows array<long>")


def _repeats(runs: DataFrame) -> DataFrame:
    """(key, starts): for each text, the starts of its windows that begin in a document with a smaller id too."""
    first = checkpoint(runs.groupBy("anchor", "run").agg(F.min("id").alias("first")))
    # runs that differ under one anchor may still have windows in common; what meets a hot anchor, window or run
    # is written out first, so that the join can be split, and a run's first holder is found by its id as well
    varied = checkpoint(first.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    edges = first.join(varied, "anchor").select("anchor", "run", F.col("first").alias("id"))
    one = runs.join(edges, ["anchor", "run", "id"]).select("anchor", "run", F.col("id").alias("first"), F.posexplode("windows").alias("offset", "window"))
    one = checkpoint(one.distinct())
    least = checkpoint(one.groupBy("anchor", "window").agg(F.min("first").alias("least"), F.max("first").alias("most")).where("least < most").select("anchor", "window", "least"))
    some = one.join(least, ["anchor", "window"]).where("least < first").groupBy("anchor", "run").agg(F.collect_set("offset").alias("offsets"))
    verdict = checkpoint(first.join(some, ["anchor", "run"], "left"))
    judged = runs.select("key", "id", "anchor", "run", "start", F.size("windows").alias("n")).join(verdict, ["anchor", "run"])
    hit = F.when(F.col("id") > F.col("first"), F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.coalesce("offsets", F.array().cast("array<int>")))
    starts = judged.select("key", F.transform(hit, lambda x: (x + F.col("start")).cast("int")).alias("starts")).where(F.size("starts") > 0)
    return starts.groupBy("key").agg(F.flatten(F.collect_list("starts")).alias("starts"))


def _kept(texts: DataFrame, window: int) -> DataFrame:
    """(key, n_removed, kept_sha256, kept) of texts (key, text, starts): words under a repeated window are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, digests, kept = [], [], []
            for text, starts in zip(batch.column("text"), batch.column("starts")):
                words = split_words(text.as_py())
                edge = np.zeros(len(words) + 1, np.int64)
                at = np.unique(starts.values.to_numpy())
                np.add.at(edge, at, 1)
                np.add.at(edge, at + window, -1)
                covered = np.cumsum(edge)[:-1] > 0
                left = b" ".join([w for w, gone in zip(words, covered.tolist()) if not gone])
                removed.append(int(covered.sum()))
                digests.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.string())], ["key", "n_removed", "kept_sha256", "kept"])

    return texts.mapInArrow(run, "key binary, n_removed long, kept_sha256 string, kept string")


def remove_repeats(docs: DataFrame, window: int = WINDOW, shortest: int = SHORTEST, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), and kept on demand, one row per row of `docs` (doc_id, text).

    A word goes if a window over it also begins in a document with a smaller doc_id; kept words are joined by
    one space. Null texts have no words. Rows without a doc_id lose nothing and take nothing from others;
    rows that repeat a doc_id do not count as each other's predecessors. An empty table gives no rows.
    Word sequences are compared by hashes of 64 bits, those of their windows and of the shorter windows in them;
    equal texts by 128. Other columns are not read and do not come back. Texts may be of any length.
    """
    lengths = levels(window, shortest)
    scan = checkpoint(_scan(docs, window, lengths[0]))
    firsts = checkpoint(scan.where("id is not null").groupBy("key").agg(F.min("id").alias("id"), F.first("anchors").alias("anchors")))
    standing = checkpoint(_repeated(firsts).withColumnRenamed("repeated", "r0"))
    judged = ["r0"]
    for _ in lengths[1:-1]:
        name = f"r{len(judged)}"
        again = checkpoint(_anchors_again(_with_texts(docs, standing), window, lengths, judged))
        standing = checkpoint(standing.join(_repeated(again).select("key", F.col("repeated").alias(name)), "key"))
        judged.append(name)
        if not standing.limit(1).count():
            break
    runs = checkpoint(_runs(_with_texts(docs, standing), window, lengths[:-1] if len(lengths) > 1 else lengths, judged))
    ids = firsts.select("key", "id")
    starts = checkpoint(_repeats(runs).join(ids, "key"))
    # written out, so that the join of a text with very many copies can be split
    kept = checkpoint(_kept(_with_texts(docs, starts), window).select("key", "n_removed", "kept_sha256", *(["kept"] if with_text else [])).dropDuplicates(["key"]))
    judged_rows = scan.select("id", "key", "n_words", "whole_sha256").join(ids.withColumnRenamed("id", "first"), "key", "left").join(kept, "key", "left")
    copy = (F.col("id") > F.col("first")) & (F.col("n_words") >= window)
    partly = F.col("n_removed").isNotNull() & F.col("id").isNotNull()
    columns = [
        F.col("id").alias("doc_id"),
        "n_words",
        F.when(copy, F.col("n_words")).when(partly, F.col("n_removed")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).when(partly, F.col("kept_sha256")).otherwise(F.col("whole_sha256")).alias("kept_sha256"),
    ]
    if with_text:
        columns.append(F.when(copy, F.lit("")).when(partly, F.col("kept")).alias("kept"))
    return judged_rows.select(*columns)
