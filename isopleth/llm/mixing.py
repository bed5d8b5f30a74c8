"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Each source's documents queue in a shuffled order, the whole queue up to `repeats` times over, and are served
in packets of a few words, so that a long document does not hold up its source. A packet's virtual finish time
is the words of its source up to its end, divided by the source's weight. The mix is the packets in the order
of that time until the budget, the sum of all sizes, is spent; a source whose queue has run dry leaves its
share to the others. The packet that crosses the budget is cut there.

The order is found by ranges of virtual time: words are summed by range, and the range that the budget ends in
is narrowed until one task can sort its packets. Ranges before it are served whole, those behind it not at all.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpoint, small, word_count

WEIGHTS = (5, 2, 1)
REPEATS = 3
#: Rows of one source, or packets around the cut, that one task orders, about; the number of slices grows with the largest source.
SLICE_ROWS = 4096
#: Words of a packet, and ranges of virtual time that words are summed by at once.
PACKET, RANGES = 16, 1024


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """One row per source of `sizes` (source, size): source_size, weight, cut_time, target.

    Sources by code point, null last, take the weights in turn. The budget is the sum of all sizes. With the
    sources ordered by the time their queue runs dry, cut_time is where the served words reach the budget:
    target = min(repeats * source_size, weight * cut_time). Works on one row per source, not per document.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    ranked = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("long"))
    cap = F.col("source_size") * repeats
    dry = Window.orderBy((cap.cast("double") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = dry.rowsBetween(Window.unboundedPreceding, -1)
    after = dry.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    level = left.cast("double") / F.sum("weight").over(after).cast("double")
    # the first source that does not run dry by its level fixes the cut; with none (no words at all) it is 0
    levelled = ranked.select("*", F.when(cap.cast("double") / F.col("weight") >= level, level).alias("level"))
    cut = levelled.withColumn("cut_time", F.coalesce(F.max("level").over(everything), F.lit(0.0)))
    return cut.select("source", "source_size", "n_docs", "weight", "cut_time", F.least(cap.cast("double"), F.col("weight") * F.col("cut_time")).alias("target"))


def _shuffled_position(sized: DataFrame) -> DataFrame:
    """Add `before`: words queued ahead of the row in its source.

    The shuffle key is an md5, so its leading digits cut every source into slices of like length, however
    large the source; a running sum over slice totals and one inside each slice give the position.
    """
    slices = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / SLICE_ROWS))
    spread = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    cut = sized.withColumn("slice", F.floor(spread * slices / F.lit(2**32)).cast("long"))
    totals = cut.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    ahead = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = small(totals.select(F.col("source").alias("o_source"), F.col("slice").alias("o_slice"), F.coalesce(F.sum("slice_size").over(ahead), F.lit(0)).alias("offset")))
    inside = Window.partitionBy("source", "slice").orderBy("key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    summed = cut.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return summed.join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("slice") == F.col("o_slice"))).withColumn("before", F.col("offset") + F.col("inside"))


def _packets(repeats: int) -> Column:
    """(copy, first, words, finish) of every packet of a row, over all passes of its source's queue."""

    def packet(copy: Column, first: Column) -> Column:
        words = F.least(F.lit(PACKET).cast("long"), F.col("size") - first)
        finish = (F.col("before") + copy * F.col("source_size") + first + words) / F.col("weight")
        return F.struct(copy.alias("copy"), first.alias("first"), words.alias("words"), finish.alias("finish"))

    starts = F.when(F.col("size") > 0, F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(PACKET).cast("long"))).otherwise(F.array().cast("array<long>"))
    copies = F.array(*(F.lit(c).cast("long") for c in range(repeats)))
    return F.flatten(F.transform(copies, lambda c: F.transform(starts, lambda first: packet(c, first))))


def _cut(placed: DataFrame, repeats: int) -> tuple[float, float, int]:
    """(low, high, left): packets that finish before low are served, those from high on are not, and of those between the first `left` words.

    Every round brings the sums of RANGES ranges to the driver. Packets of a source finish apart, so a range
    narrows to SLICE_ROWS packets, or to packets of equal time, of which there are no more than sources.
    """
    each = placed.select(F.explode(_packets(repeats)).alias("x")).select("x.words", "x.finish")
    budget, horizon = placed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.max(repeats * F.col("source_size") / F.col("weight"))).first()
    low, high, left = 0.0, (horizon or 0.0) * (1 + 1e-9) + 1.0, int(budget)
    while left:
        width = (high - low) / RANGES
        number = F.floor((F.col("finish") - low) / width)
        found = each.where((F.col("finish") >= low) & (F.col("finish") < high)).groupBy(F.greatest(F.lit(0), F.least(F.lit(RANGES - 1), number)).cast("int").alias("range"))
        sums = sorted(found.agg(F.sum("words").alias("words"), F.count("*").alias("n"), F.min("finish").alias("first"), F.max("finish").alias("last")).collect())
        for r in sums:
            if r.words >= left:
                break
            left -= r.words
        # the ends of a range are packets' own times, so no rounding of its border moves a packet
        low, high = r.first, math.nextafter(r.last, math.inf)
        if r.n <= SLICE_ROWS or r.first == r.last:
            break
    return low, high, left


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS, extra: Sequence[str] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, virtual_start, weight and columns `extra`, one row per row of `docs`.

    target: the source's share by weight, at most `repeats` times its size, the excess reshared. taken: words
    the mix takes, repeats counted, at most `repeats` times size; all together they are the budget, and each
    source's are its target but for a few packets. The order hashes doc_id, so reruns agree; rows alike in
    doc_id and size are interchangeable. Null texts have size 0; a null source is a source of its own; a null
    doc_id sorts as the empty text. No rows in, no rows out.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("key"), *(F.col(c) for c in extra))
    numbers = checkpoint(sized.select("doc_id", "source", "size", "key"))  # a few numbers for each document: all that the order needs
    targets = small(source_targets(numbers, weights, repeats).withColumnRenamed("source", "t_source"))
    same_source = F.col("source").eqNullSafe(F.col("t_source"))
    queue = checkpoint(_shuffled_position(numbers.join(targets, same_source)))
    placed = _shuffled_position(sized.join(targets, same_source)) if extra else queue
    low, high, left = _cut(queue, repeats)
    between = queue.select("source", "before", F.explode(F.filter(_packets(repeats), lambda x: (x["finish"] >= low) & (x["finish"] < high))).alias("x"))
    # one range, of bounded length
    ahead = Window.orderBy("x.finish", F.col("source").asc_nulls_last(), "before", "x.copy", "x.first").rowsBetween(Window.unboundedPreceding, -1)
    words = F.greatest(F.lit(0), F.least(F.col("x.words"), F.lit(left) - F.coalesce(F.sum("x.words").over(ahead), F.lit(0))))
    # of rows with words no two of a source have as many ahead of them
    last = small(between.select(F.col("source").alias("l_source"), F.col("before").alias("l_before"), words.alias("words")).groupBy("l_source", "l_before").agg(F.sum("words").alias("some")))
    sure = F.aggregate(F.filter(_packets(repeats), lambda x: x["finish"] < low), F.lit(0).cast("long"), lambda n, x: n + x["words"])
    joined = placed.join(last, F.col("source").eqNullSafe(F.col("l_source")) & (F.col("before") == F.col("l_before")) & (F.col("size") > 0), "left")
    taken = (sure + F.coalesce("some", F.lit(0))).cast("long")
    return joined.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), (F.col("before") / F.col("weight")).alias("virtual_start"), "weight", *extra)


def mixed_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """The mix itself, in the columns of `docs` (doc_id, text, source and any others): a row for each copy served, sorted by virtual finish time.

    A whole copy keeps its text; a copy in service at the cut keeps the words served, joined by single
    spaces, and its n_chars, if there is one, follows. Documents without words are never served. The sort is a
    range sort over all copies. An empty table gives no rows.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "source", "text")]
    whole = docs.select("doc_id", "source", "text", (F.struct(*(F.col(f"`{c}`") for c in others)) if others else F.lit(None)).alias("row"))
    served = mix(whole, weights, repeats, extra=("text", "row"))
    per = served.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    words = F.greatest(F.lit(0), F.least(F.col("size"), F.col("taken") - F.col("copy") * F.col("size")))
    per = per.withColumn("words", words).where("words > 0")
    finish = F.col("virtual_start") + (F.col("copy") * F.col("source_size") + F.col("words")) / F.col("weight")
    cut = F.col("words") < F.col("size")
    text = F.when(cut, F.array_join(F.slice(F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0)), F.lit(1), F.col("words").cast("int")), " ")).otherwise(F.col("text"))
    ordered = per.withColumn("text", text).withColumn("finish", finish).repartitionByRange("finish", "doc_id", "copy").sortWithinPartitions("finish", "doc_id", "copy")
    told = {c: F.col(f"row.`{c}`") for c in others} | {c: F.col(c) for c in ("doc_id", "source", "text")}
    if "n_chars" in told:
        told["n_chars"] = F.when(cut, F.length("text").cast("long")).otherwise(told["n_chars"])
    return ordered.select(*(told[c].alias(c) for c in docs.columns))
