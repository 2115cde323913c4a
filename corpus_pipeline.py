"""A corpus from raw documents: quality rules, near-duplicates, repeated passages, benchmark leaks, mix.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor kept and returns a DataFrame with the columns
of ``documents`` (the last one adds ``copies``). ``run`` writes each result as Parquet in the shared folder and reads it
back as the next stage's input.

Nulls in any column are kept as they are and have the meaning the operators give them; an empty table passes through.
Columns beside doc_id, text and source travel as one struct, so that no name of theirs can clash with an operator's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cobblestone.llm import decontaminate, minhash_dedup, mixing, quality_rules, simhash_dedup, substring_dedup
from cobblestone.llm.common import stored, table, text_key
from cobblestone.operators.components import link_components

#: Hashes of the stages are not those of DuckDB; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, source, text, row): ``row`` holds every column but the text."""
    return docs.select("doc_id", "source", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"))


def unpacked(df: DataFrame, docs: DataFrame, *more: str, **changed: Column) -> DataFrame:
    """The columns of ``docs``, with ``changed`` in place of some, and ``more`` columns of ``df``."""
    columns = {"text": F.col("text"), **changed}
    kept = (columns.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns if c not in more)
    return df.select(*kept, *more)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, for themselves and for their host (``source``)."""
    return unpacked(quality_rules.judge(packed(docs)).where("kept"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked texts: the smallest ``doc_id``, of equal ones the smallest hashes of text and row.

    Links are those of SimHash (``simhash_dedup``: fingerprints of all five-word shingles within 3 bits) and, since few near
    copies come so close, those of sets of five-word shingles with a similarity of 0.8 or more (``minhash_dedup``).
    """
    names = ("doc_id", "_key", "_row")
    keyed = packed(docs).withColumn("_key", text_key()).withColumn("_row", F.xxhash64(F.to_json("row")))
    keyed = keyed.withColumn("_name", F.xxhash64(*names))
    prints = simhash_dedup.near_duplicates(keyed, ident="_name", size=minhash_dedup.SHINGLE).select("_name", F.col("component_id").alias("_group"))
    found = stored(minhash_dedup.near_duplicates(keyed, keep=(*names, "_name"), similarity=(4, 5)), "similar")
    # components of similar sets that one group of fingerprints joins
    met = stored(found.select("_name", "component").join(prints.distinct(), "_name").select("_group", "component").distinct(), "met")
    joined = met.groupBy("_group").agg(F.min("component").alias("a"), F.max("component").alias("_last")).where("a != _last")
    more = link_components(met.join(joined, "_group").select("a", F.col("component").alias("b")))
    found = found.join(more.select(F.col("item").alias("component"), F.col("component").alias("_all")), "component", "left")
    found = found.withColumn("component", F.coalesce("_all", "component"))
    named = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), *names)).alias("x"))
    chosen = named.select(*(F.col(f"x.{c}").alias(f"_of{c}") for c in names))
    same = [F.col(c).eqNullSafe(F.col(f"_of{c}")) for c in names]
    # rows repeated as a whole share all names
    return unpacked(keyed.join(chosen, same, "left_semi").dropDuplicates(list(names)), docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that recur; a document that is nothing but such passages goes."""
    done = substring_dedup.remove_recurring(packed(docs).select("row", "text", F.col("text").alias("_body")), text="_body")
    text = F.coalesce("kept_text", "text")
    n_chars = F.when(F.col("n_removed") > 0, F.length(text)).otherwise(F.col("row.n_chars"))
    return unpacked(done.where("n_removed = 0 or n_removed < n_words"), docs, text=text, n_chars=n_chars)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return unpacked(decontaminate.clean(packed(docs), table(spark, sf_dir, "benchmark")), docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with at least one copy in the mix, with ``copies`` (in place of a column of that name)."""
    done = mixing.mix_sources(packed(docs).withColumn("_body", F.col("text")), text="_body")
    return unpacked(done.where("copies > 0"), docs, "copies")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontaminated", decontaminated),
    ("mixed", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
