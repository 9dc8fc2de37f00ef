"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

A document's key is an exponential variate divided by its quality weight; documents in ascending
order of the key are a weighted sample without replacement of any length. A source whose target is
``e`` times its size and some rest gives ``e`` complete epochs and, in key order, the rest.

No source is sorted whole: keys fall into monotone bins, sizes are summed by (source, bin), and
only the one bin of each source where the budget runs out is put in order.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from awardlake.llm.common import cut

#: Sources whose state is sent to every task; more of them are joined by a shuffle.
SENT_SOURCES = 10_000
#: Bins of the keys of a source; the bin that is sorted holds about one in so many of its documents.
BINS = 4096
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[!#$%&*|]+"


def size_of(text) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def tidiness(text, size) -> Column:
    """Quality weight from 0.1 to 1: one minus the share of words with runs of symbols."""
    runs = F.coalesce(F.regexp_count(text, F.lit(SYMBOLS)), F.lit(0))
    return 1 - F.least(F.lit(0.9), runs / F.greatest(size, F.lit(1)))


def key_of(doc_id, weight, seed) -> Column:
    """Exponential key: the same for every run, since the uniform variate is a hash of seed and id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))))
    uniform = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.ln(uniform) / weight


def targets(sizes: DataFrame, weights=(3, 1, 2), share=1.5, cap=2) -> DataFrame:
    """``source``, ``source_size`` with ``weight`` and ``target``: weighted shares of ``share`` times all, at most ``cap`` times the source.

    Weights repeat over the sources by code point, null last. What a capped source cannot take goes
    to the others by weight until none is above its cap, which is one level per unit of weight: the
    level is found over one row per source (never documents), in order of cap over weight.
    """
    cycle = F.array(*map(F.lit, weights))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = sizes.select("source", "source_size", F.get(cycle, place % len(weights)).alias("weight"))
    ratio = (cap * F.col("source_size") / F.col("weight")).alias("ratio")
    up = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy()
    leveled = ranked.select("*", ratio).select(
        "*",
        F.sum("source_size").over(whole).alias("all"),
        (F.sum("source_size").over(up) - F.col("source_size")).alias("below"),
        (F.sum("weight").over(whole) - F.sum("weight").over(up) + F.col("weight")).alias("above"),
    )
    level = (share * F.col("all") - cap * F.col("below")) / F.col("above")
    leveled = leveled.select("*", level.alias("level"))
    best = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(whole)
    full = cap * F.col("source_size").cast("double")
    return leveled.select("source", "source_size", "weight", F.coalesce(F.least(best * F.col("weight"), full), full).alias("target"))


def sized(docs: DataFrame, seed=5, weight=None) -> DataFrame:
    """``document`` (all columns), ``doc_id``, ``source``, ``size`` in words, ``tie`` (hash of the text), ``key`` and its ``bin``."""
    size = size_of(F.col("text"))
    first = docs.select(F.struct("*").alias("document"), F.col("doc_id").cast("long").alias("doc_id"), "source", "text", size.alias("size"))
    weight = weight if weight is not None else tidiness(F.col("text"), F.col("size"))
    first = first.select("document", "doc_id", "source", "size", F.xxhash64("text").alias("tie"), key_of("doc_id", weight, seed).alias("key"))
    return first.withColumn("bin", F.floor(BINS * F.col("key") / (1 + F.col("key"))).cast("int"))


def budgets(rows: DataFrame, weights=(3, 1, 2), share=1.5, cap=2) -> DataFrame:
    """One row per source (``of``): ``source_size``, ``target``, ``epochs``, the bin in which the rest of the target ends, and what of it is left there."""
    bins = cut(rows.groupBy("source", "bin").agg(F.sum("size").alias("words")))
    found = targets(bins.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    found = found.select("*", epochs.cast("long").alias("epochs"))
    found = cut(found.select("*", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long").alias("rest")))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = bins.select("source", "bin", "words", F.sum("words").over(upto).alias("upto"))
    summed = summed.join(found.select(F.col("source").alias("of"), "rest"), F.col("source").eqNullSafe(F.col("of")))
    edge = summed.where("upto > rest").groupBy("of").agg(F.min(F.struct("bin", (F.col("upto") - F.col("words")).alias("before"))).alias("edge"))
    state = found.join(edge.select(F.col("of").alias("edge_of"), "edge"), F.col("source").eqNullSafe(F.col("edge_of")), "left")
    return cut(state.select(
        F.col("source").alias("of"), "source_size", "target", "epochs",
        F.coalesce("edge.bin", F.lit(BINS)).alias("edge_bin"), (F.col("rest") - F.coalesce("edge.before", F.lit(0))).alias("left_over"),
    ))


def at_edge(known: DataFrame, *order) -> DataFrame:
    """Rows of the bin in which their source's budget ends, with the ``part`` of each that it reaches."""
    upto = Window.partitionBy("source").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = F.sum("size").over(upto) - F.col("size")
    return known.where("bin = edge_bin").withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("left_over") - ahead)))


def mix(rows: DataFrame, weights=(3, 1, 2), share=1.5, cap=2) -> DataFrame:
    """Adds ``source_size``, ``target``, ``epochs`` and ``taken`` (words) to sized rows.

    Every row keeps its place: taken is ``epochs`` times the size, and for the rows that the rest of
    the target reaches the size once more, or what is left of the budget. Rows of an empty source or
    without words take nothing. Null sources are one source, the last. Null ids share one variate;
    ties of keys are ordered by id and size, so repeated rows are interchangeable.
    """
    state = budgets(rows, weights, share, cap)
    known = rows.join(state, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    whole = known.where("bin <> edge_bin").withColumn("part", F.when(F.col("bin") < F.col("edge_bin"), F.col("size")).otherwise(F.lit(0)))
    split = at_edge(known, "key", "doc_id", "size")
    taken = (F.col("epochs") * F.col("size") + F.col("part")).cast("long")
    return whole.unionByName(split).withColumn("taken", taken).drop("edge_bin", "left_over")


def allotment(docs: DataFrame, seed=5) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target``, ``taken`` of every document."""
    rows = cut(sized(docs, seed).drop("document", "tie"))
    return mix(rows).select("doc_id", "size", "source_size", "target", "taken")


def cutoffs(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Per source (``ends``) the last row by key, id, size and hash of the text that the mix takes once more (half of it or more is in).

    Rows alike in all four are one; they count as the larger part of them does.
    """
    place = F.struct("key", "doc_id", "size", "tie").alias("place")
    known = rows.join(state.select("of", "edge_bin", "left_over"), F.col("source").eqNullSafe(F.col("of")))
    split = at_edge(known, "key", "doc_id", "size", "tie").where("size > 0").groupBy("source", place).agg(F.avg((2 * F.col("part") >= F.col("size")).cast("int")).alias("in"))
    return split.where("in >= 0.5").groupBy(F.col("source").alias("ends")).agg(F.max("place").alias("last"))


def mixed(docs: DataFrame, seed=5, weights=(3, 1, 2), share=1.5, cap=2) -> DataFrame:
    """The documents of the mix, all columns, each as often as it is taken (a part of half or more counts as whole).

    Budgets and the last row that a source's budget reaches come from narrow rows; a document then only
    compares itself with its source's one row, so that no text is shuffled.
    """
    rows = cut(sized(docs, seed).drop("document"))
    state = budgets(rows, weights, share, cap)
    last = cutoffs(rows, state)
    state = cut(state.join(last, F.col("of").eqNullSafe(F.col("ends")), "left").select("of", "epochs", "edge_bin", "last"))
    state = F.broadcast(state) if state.count() <= SENT_SOURCES else state
    found = sized(docs, seed).join(state, F.col("source").eqNullSafe(F.col("of")))
    place = F.struct("key", "doc_id", "size", "tie")
    once_more = (F.col("bin") < F.col("edge_bin")) | ((F.col("bin") == F.col("edge_bin")) & F.coalesce(place <= F.col("last"), F.lit(False)))
    copies = F.when(F.col("size") > 0, F.col("epochs") + once_more.cast("long")).otherwise(0).cast("int")
    repeated = found.select("document", F.explode(F.array_repeat(F.lit(0), copies)).alias("copy"))
    return repeated.select("document.*")
