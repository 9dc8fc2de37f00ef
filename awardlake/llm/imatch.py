"""I-Match fingerprints in DataFrame operations only.

The lexicon holds the terms whose document frequency lies in a band. A text keeps its terms of the
lexicon and a fixed share of its others, so that neither a group of near copies (whose terms are
frequent) nor a text of rare terms is left with a chance few. Randomised subsets are drawn by hashing;
a subset's part of a fingerprint is the hash of a document's sorted distinct terms
in that subset. Sparse and dense subsets together make short and long texts comparable.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from awardlake.llm.common import texts

#: Frequencies are counted for hashed terms, so that the lexicon has one size whatever the corpus.
SLOTS = 1 << 20
#: Document frequency band, as shares of all documents (and two documents at least).
BAND = (0.001, 0.05)
#: Of a text's terms outside the band the first one in so many by hash is kept, rounded up.
OUTSIDE = 4
#: Families of disjoint subsets: each subset is one of so many parts of the lexicon; so many parts are used.
FAMILIES = ((16, 16), (128, 64), (1024, 128))
TERM_BREAK = r"[^\p{L}\p{N}]+"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def term_hashes(text: Column) -> Column:
    """Distinct hashed terms: lower-case runs of letters and digits."""
    terms = F.filter(F.split(F.lower(text), TERM_BREAK), lambda t: t != "")
    return F.array_distinct(F.transform(terms, lambda t: F.xxhash64(t)))


def _slot(term):
    return F.pmod(term, F.lit(SLOTS)).cast("int")


def lexicon(docs: DataFrame, band=BAND) -> DataFrame:
    """One row: ``mask``, an array of long with one bit per slot of hashed terms, set where its document frequency is in the band.

    Frequencies cover all documents, equal texts once, so that copies push no term out of the band
    (texts without terms count each time in the number of documents). A slot sums the frequencies of the terms it holds; rare terms
    add about one in 5000 documents to it at any corpus size, which stays below the band.
    """
    plain = texts(docs)
    same = [F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b")]
    sizes = plain.groupBy(*same, F.col("text").rlike(r"[\p{L}\p{N}]").alias("some")).count()
    total = sizes.agg(F.coalesce(F.sum(F.when(F.col("some"), 1).otherwise(F.col("count"))), F.lit(0)).alias("n"))
    once = plain.select(*same, F.array_distinct(F.transform(term_hashes(F.col("text")), _slot)).alias("slots"))
    once = once.groupBy("a", "b").agg(F.any_value("slots").alias("slots"))
    slots = once.select(F.explode("slots").alias("slot"))
    counts = slots.groupBy("slot").count()
    low, high = (F.greatest(F.lit(x) * total.scalar(), F.lit(2)) for x in band)
    inside = counts.where((F.col("count") >= low) & (F.col("count") <= high))
    words = inside.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, slot & 63)")).alias("bits"))
    every = docs.sparkSession.range(SLOTS // 64).select(F.col("id").cast("int").alias("word"))
    filled = every.join(words, "word", "left").select(F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits")).alias("x"))
    return filled.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["bits"]).alias("mask"))


def _members_of_family(terms, parts, used, base):
    def cell(h):
        return F.struct((F.pmod(F.xxhash64(h, F.lit(parts)), F.lit(parts)) + base).alias("cell"), h.alias("h"))

    return F.filter(F.transform(terms, cell), lambda x: x["cell"] < base + used)


def fingerprint(text: Column, mask: Column) -> Column:
    """Array of long, one per subset with terms of the text: the subset above 32 bits of hash.

    Kept are the text's lexicon terms and the first quarter, by hash, of its other terms. A text without terms has
    an empty array.
    """

    def inside(h):
        return F.getbit(F.get(mask, F.shiftright(_slot(h), 6)), _slot(h).bitwiseAND(63)) == 1

    def kept(hashes):
        others = F.array_sort(F.filter(hashes, lambda h: ~inside(h)))
        few = let(others, lambda x: F.slice(x, F.lit(1), F.ceil(F.size(x) / OUTSIDE).cast("int")))
        return F.concat(F.filter(hashes, inside), few)

    def members(terms):
        found, base = [], 0
        for parts, used in FAMILIES:
            found.append(_members_of_family(terms, parts, used, base))
            base += used
        return F.array_sort(F.flatten(F.array(*found)))

    def hashed(rows):
        places = F.when(F.size(rows) > 0, F.sequence(F.lit(0), F.size(rows) - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(places, lambda i: (i == 0) | (F.get(rows, i)["cell"] != F.get(rows, F.greatest(i - 1, F.lit(0)))["cell"]))

        def one(first, after):
            part = F.slice(rows, first + 1, after - first)
            low = F.xxhash64(F.transform(part, lambda x: x["h"])).bitwiseAND(F.lit(0xFFFFFFFF))
            return F.shiftleft(F.get(rows, first)["cell"].cast("long"), 32).bitwiseOR(low)

        return let(starts, lambda s: F.transform(s, lambda first, j: one(first, F.coalesce(F.get(s, j + 1), F.size(rows)))))

    return let(let(let(term_hashes(text), kept), members), hashed)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal parts among the subsets that either fingerprint has; one if both are empty."""

    def cells(x):
        return F.transform(x, lambda v: F.shiftright(v, 32))

    either = F.size(F.array_union(cells(a), cells(b)))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def as_text(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda v: F.lower(F.hex(v))), ".")


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text``, ``place`` within ``bucket``, ``next_text``: the document after it in descending ``doc_id``, round in a ring.

    Ids are cut into ranges of about equal size, one per shuffle partition, so texts move once and no
    window spans the table. The last row of a range is fetched for the first one of the next range.
    Null ids come last in descending order; rows that share an id are ordered by a hash of the text, by which rows
    without an id are cut into ranges too.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = texts(docs)
    bounds = plain.where("doc_id is not null").approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts)
    bounds = F.array(*(F.lit(int(b)) for b in sorted(set(bounds)))).cast("array<long>")
    bucket = F.coalesce(F.size(F.filter(bounds, lambda b: b < F.col("doc_id"))), F.lit(-1))
    nulls = (F.floor((F.shiftright(F.xxhash64("text"), 32) + (1 << 31)) * parts / (1 << 32)) - parts).cast("int")  # from -parts to -1
    rows = plain.select("doc_id", "text", F.when(F.col("doc_id").isNull(), nulls).otherwise(bucket).alias("bucket"), F.xxhash64("text").alias("tie"))
    lasts = rows.groupBy("bucket").agg(F.max(F.struct(F.col("doc_id"), F.col("tie"))).alias("last"))
    ring = Window.orderBy("bucket")
    above = F.coalesce(F.lag("last").over(ring), F.max_by("last", "bucket").over(Window.partitionBy()))
    wanted = lasts.select("bucket", above.alias("last")).select(F.col("bucket").alias("of"), F.col("last.doc_id").alias("lid"), F.col("last.tie").alias("ltie"))
    heads = F.broadcast(wanted).join(rows.select("doc_id", "tie", "text"), F.col("doc_id").eqNullSafe(F.col("lid")) & (F.col("tie") == F.col("ltie")))
    heads = heads.groupBy("of").agg(F.max("text").alias("head"))
    order = Window.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_first(), "tie")
    placed = rows.select("*", F.row_number().over(order).alias("place"), F.lag("text").over(order).alias("before"))
    placed = placed.join(heads, F.col("bucket") == F.col("of"), "left")
    nexts = F.when(F.col("place") == 1, F.col("head")).otherwise(F.col("before"))
    return placed.select("doc_id", "text", "bucket", "place", "tie", nexts.alias("next_text"))


def fingerprints(docs: DataFrame, band=BAND) -> DataFrame:
    """Fingerprint of every document, of its edited text, and their likeness.

    ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited``, ``near_next``. The edited text has its last half replaced by the start of the
    next document. Null texts are empty; of one document the next is itself; one row per input row;
    other columns are ignored; an empty table gives an empty result.
    """
    rows = with_next(docs)
    mask = F.col("mask")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr(F.col("text"), F.lit(1), n - half), F.substr(F.col("next_text"), F.lit(1), half))
    first = F.when(F.col("place") == 1, F.col("next_text"))
    rows = rows.select("doc_id", "bucket", "tie", "place", "text", edited.alias("edited"), first.alias("first"), lexicon(docs, band).scalar().alias("mask"))
    rows = rows.select(
        "doc_id", "bucket", "tie", "place", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("text"), mask).alias("own"), fingerprint(F.col("edited"), mask).alias("changed"),
        F.when(F.col("place") == 1, fingerprint(F.col("first"), mask)).alias("head"),
    )
    order = Window.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_first(), "tie")
    rows = rows.select("*", F.lag("own").over(order).alias("before"))
    following = F.when(F.col("place") == 1, F.col("head")).otherwise(F.col("before"))
    rows = rows.select("*", following.alias("following"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
