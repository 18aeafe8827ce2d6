"""The text pipeline: quality rules, exact dedup, MinHash near-dedup, suffix-array dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Its result is
written as Parquet to the shared folder and read again as the next one's ``docs``, so a lost executor
costs a part of one stage. All stages but the last return the columns of ``docs``.

Columns: what a stage does not change comes out as it went in, whatever its name (``n_words``, ``kept``, ``_id``, ...) and type, as long as
Arrow can hold the type (intervals of mixed units it cannot). Names that differ in case only are an error of Spark.
NULL ids: kept where a stage would otherwise have to name them; see the operators' docstrings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact, minhash, packing, rules, suffix
from tidemark.llm.common import private
from tidemark.session import new_path


def _whole(docs: DataFrame, *also: str) -> tuple[str, DataFrame]:
    """All columns of ``docs`` as one, under a name of its own, beside those a stage reads: no measure can meet
    a caller's column of the same name."""
    name = private("_row", docs)
    return name, docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(name), *[c for c in also if c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or any threshold go."""
    row, d = _whole(docs, "text", "lang")
    return rules.apply_rules(d).filter("kept").select(f"{row}.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id stays."""
    return exact.deduplicate(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


#: Per cent of the union of two documents' shingles from which they are near copies.
NEAR = 80


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the one with the smallest id stays; rows of one id (or none) and one text stay
    or go together."""
    stay = minhash.components_of(docs.select("doc_id", "text"), share=NEAR, with_digest=True).filter("kept").select(F.col("doc_id").alias("_id"), F.col("tx").alias("_tx")).distinct()
    row, d = _whole(docs)
    return d.join(stay, F.col(f"{row}.doc_id").eqNullSafe(F.col("_id")) & (minhash.digest(f"{row}.text") == F.col("_tx")), "left_semi").select(f"{row}.*")


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that an earlier document has are cut out; every document stays. ``text`` and, where there is
    one, ``n_chars`` change (``n_chars`` keeps its type); a NULL text stays NULL. All other columns travel with the text, as Arrow
    data, so nothing is joined."""
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    carry = F.struct(F.col("text").isNull().alias("no_text"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"))
    out = suffix.remove_repeats(docs, carry=carry)
    kept = F.when(~F.col("carried.no_text"), F.coalesce("kept_text", F.lit("")))
    made = {"text": kept.alias("text")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.length(F.coalesce(kept, F.lit(""))).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*[made[c] if c in made else F.col("carried").getField("row").getField(c).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("minhash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("packing", pack),
]

#: SQL cannot tokenise; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.mode("error").parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
