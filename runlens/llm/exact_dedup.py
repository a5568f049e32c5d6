"""Exact dedup by a tree-merge of sorted digest runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runlens.llm.common import WHITE, cut


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = 64, fan_in: int = 8) -> DataFrame:
    """Groups texts that are equal without their white space and names the row of each group that stays.

    Every row gets a SHA-256 digest of its normalised text, with the text's length and an XXH64 as second
    evidence, and belongs to one of `runs` runs by a hash of its identifier. Each run is aggregated (sort-based,
    as the winner is a struct): one entry per digest with the winner so far and a count. Then runs meet in
    binomial rounds: `fan_in` neighbouring runs are exchanged by (digest, merged run) and merged, until one run,
    still spread over all partitions by digest, is left. A digest that a third of all rows share costs at most one
    entry per run and map task in each round. The result returns down the same tree: final entries meet run
    entries by digest, run entries meet the rows by (digest, run), so a hot digest is dealt over `runs` keys.

    The winner has the most code points in its original text, then the smallest identifier (nulls last).
    Returns one row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_chars.

    Null text counts as empty; all empty and blank texts are one group. A null identifier is kept as null. Of
    repeated rows with the winner's identifier and length exactly one is kept. An empty table gives no rows.
    Other columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("_t")).select(
        "doc_id", F.translate("_t", WHITE, "").alias("_n"), F.length("_t").cast("long").alias("n_chars")
    )
    rows = cut(
        rows.select(
            "doc_id",
            "n_chars",
            F.unhex(F.sha2("_n", 256)).alias("digest"),
            F.struct(F.length("_n").alias("l"), F.xxhash64("_n").alias("x")).alias("proof"),
            F.pmod(F.xxhash64("doc_id"), F.lit(runs)).cast("int").alias("run"),
        )
    )
    best = F.struct((-F.col("n_chars")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"))
    leaf = rows.groupBy("digest", "proof", "run").agg(F.min(best).alias("best"), F.count("*").alias("n"))
    level, left = leaf, runs
    while left > 1:
        left = -(-left // fan_in)
        level = (
            level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
            .groupBy("digest", "proof", "run")
            .agg(F.min("best").alias("best"), F.sum("n").alias("n"))
        )
    final = level.drop("run").withColumnRenamed("best", "won").withColumnRenamed("n", "group_size")
    down = leaf.select("digest", "proof", "run").join(final, ["digest", "proof"])
    out = rows.join(down, ["digest", "proof", "run"])
    nth = F.row_number().over(Window.partitionBy("digest", "proof", "run", "doc_id").orderBy(F.desc("n_chars")))
    same = F.col("doc_id").eqNullSafe(F.col("won.c")) & (F.col("n_chars") == -F.col("won.a"))
    return out.select(
        "doc_id",
        F.col("won.c").alias("keep_id"),
        "group_size",
        (same & (nth == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "n_chars",
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of each group of equal texts that stays, with all its columns; repeated rows leave one."""
    kept = exact_dedup(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha"), F.col("n_chars").alias("kept_n"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.sha2(F.translate(text, WHITE, ""), 256).alias("sha"), F.length(text).cast("long").alias("n"))
    same = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("sha") == F.col("kept_sha")) & (F.col("n") == F.col("kept_n"))
    left = rows.join(kept, same, "left_semi")
    nth = F.row_number().over(Window.partitionBy("id", "sha", "n").orderBy("n"))
    return left.withColumn("nth", nth).where("nth = 1").select("row.*")
