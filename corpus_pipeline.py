"""A cleaning pipeline over ``documents``: toxicity, near-duplicates, repeated passages, mixing, encoding.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a
DataFrame; all but the last return the columns of ``documents``. Empty tables, null and empty texts
and repeated rows pass through as each operator states.
"""

from pyspark.sql import functions as F

#: No SQL states a learned classifier, a similarity join and BPE together; tests check each stage.
ORACLE_SQL = None


def drop_toxic(spark, docs, sf_dir):
    """Documents whose probability of any toxicity grade is below the rejection level."""
    from awardlake.llm.toxicity import without_toxic

    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark, docs, sf_dir):
    """One document of each group that shares 80 % of its five-word shingles."""
    from awardlake.llm.minhash import one_of_each

    return one_of_each(docs, words=5, percent=80)


def cut_repeats(spark, docs, sf_dir):
    """Texts without bytes of strings of 100 bytes that start earlier too; ``n_chars`` follows the text."""
    from awardlake.llm.suffixes import without_repeats

    kept = without_repeats(docs, length=100)
    count = F.coalesce(F.length("text").cast("long"), F.lit(0).cast("long"))
    return kept.select(*(count.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def mix_sources(spark, docs, sf_dir):
    """Documents as often as the mix of their sources takes them."""
    from awardlake.llm.mixing import mixed

    return mixed(docs)


def encode(spark, docs, sf_dir):
    """Token ids of every document, and digests of them and of what they decode to."""
    import public_tokenizers

    from awardlake.llm import bpe

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    decoded = bpe.round_trip(docs, ranks, public_tokenizers.PATTERN)
    return decoded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
