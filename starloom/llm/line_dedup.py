"""Cross-site boilerplate lines by distinct-site spread, in DataFrame
operations only.

Every line with a word is hashed (128 bits).  A HyperLogLog sketch of the sites
it occurs on is aggregated per line hash, partial sketches merging before and
after the shuffle.  Lines whose estimate is clearly over ``min_sites`` are
boilerplate; lines within ``band`` of it get an exact distinct count.  Those
lines are removed; only a document made mostly of them may stay whole, as a copy
for document-level deduplication.  With ``copies_only`` (the registered queries)
it must be shown to be one: documents of its very set of lines are on
``min_sites`` sites themselves.  Without, the share of characters decides.

Line hashes, not texts, are shuffled for counting.  A line on a third of all
documents costs one partial sketch per task; the joins back to the occurrences
have one row per line on the other side, so skewed partitions can be split.

Defined results: a null text stays null and has no lines; an empty text stays
empty; a null site is a site of its own; repeated rows (same id and text) are
treated alike; an empty table gives an empty result; other columns pass
unchanged (columns named ``__l_*`` are reserved).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialise

BLANKS = " \t\n\x0b\f\r"


def line_table(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """One row per line with a word: doc, text hash, site, characters and hash
    of the line set of its text, position, length and a 128-bit hash of the
    trimmed line."""
    words = F.filter(F.transform(F.split(F.col(text_col), "\n"), lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: x != "")
    picked = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(text_col)).alias("text_hash"),
                         F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"),
                         F.length(text_col).alias("chars"), F.xxhash64(F.array_sort(F.array_distinct(words))).alias("line_set"),
                         F.split(F.col(text_col), "\n").alias("raws"))
    # the line set is computed once a text, below the expansion into lines
    picked = picked.select("doc", "text_hash", "site", "chars", "line_set", F.posexplode("raws").alias("position", "raw"))
    line = F.btrim("raw", F.lit(BLANKS))
    return (picked.withColumn("line", line).where(F.col("line") != "")
            .select("doc", "text_hash", "site", "chars", "line_set", "position", F.length("raw").alias("length"),
                    F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")))


def spread_lines(lines: DataFrame, min_sites: int, band: float, lg_k: int) -> DataFrame:
    """(h1, h2) of lines on ``min_sites`` sites or more."""
    estimated = (lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"))
                 .select("h1", "h2", F.hll_sketch_estimate("sketch").alias("sites")))
    kept = materialise(estimated.where(F.col("sites") >= min_sites * (1 - band)), "line-spread")
    sure = kept.where(F.col("sites") > min_sites * (1 + band)).select("h1", "h2")
    near = kept.where(F.col("sites") <= min_sites * (1 + band)).select("h1", "h2")
    exact = (lines.join(near, ["h1", "h2"]).select("h1", "h2", "site").distinct()
             .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("sites"))
             .where(F.col("sites") >= min_sites).select("h1", "h2"))
    return sure.unionByName(exact)


def remove_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
                       min_sites: int = 8, band: float = 0.1, lg_k: int = 12, most: float = 0.5,
                       copies_only: bool = False) -> DataFrame:
    """``docs`` with boilerplate lines removed from ``text_col``, and two more
    columns: ``__l_n_lines`` (lines with a word) and ``__l_n_removed`` (long)."""
    lines = materialise(line_table(docs, id_col, text_col, site_col), "lines")
    spread = spread_lines(lines, min_sites, band, lg_k)
    size = F.aggregate("__l_spans", F.lit(0), lambda a, s: a + s["length"])
    marked = (lines.join(spread, ["h1", "h2"], "left_semi")
              .groupBy(F.col("doc").alias("__l_doc"), F.col("text_hash").alias("__l_hash"))
              .agg(F.collect_set("position").alias("__l_positions"), F.max("chars").alias("__l_chars"), F.max("line_set").alias("__l_set"),
                   F.collect_set("site").alias("__l_sites"), F.collect_set(F.struct("position", "length")).alias("__l_spans"))
              .withColumn("__l_whole", size > most * F.col("__l_chars")))
    if copies_only:
        marked = materialise(marked, "marked")
        copies = (marked.where("__l_whole").select("__l_set", F.explode("__l_sites").alias("site")).distinct()
                  .groupBy("__l_set").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= min_sites)
                  .select("__l_set", F.lit(True).alias("__l_copy")))
        marked = (marked.join(materialise(copies, "copies"), "__l_set", "left")
                  .withColumn("__l_whole", F.col("__l_whole") & F.coalesce("__l_copy", F.lit(False))))
    marked = marked.select("__l_doc", "__l_hash", "__l_positions", "__l_whole")
    keyed = docs.withColumn("__l_h", F.xxhash64(F.col(text_col)))
    found = (F.col("__l_h") == F.col("__l_hash")) & keyed[id_col].eqNullSafe(F.col("__l_doc"))
    joined = keyed.join(marked, found, "left")
    joined = (joined.withColumn("__l_lines", F.split(F.col(text_col), "\n"))
              .withColumn("__l_cut", F.when(~F.col("__l_whole"), F.array_distinct("__l_positions"))))
    rest = F.array_except(F.sequence(F.lit(0), F.size("__l_lines") - 1), F.col("__l_cut"))
    text = (F.when(F.col("__l_cut").isNull(), F.col(text_col))
            .otherwise(F.array_join(F.transform(rest, lambda i: F.get("__l_lines", i)), "\n")))
    n_lines = F.size(F.filter("__l_lines", lambda line: F.btrim(line, F.lit(BLANKS)) != ""))
    return joined.select(
        *[text.alias(c) if c == text_col else F.col(c) for c in docs.columns],
        F.when(F.col(text_col).isNull(), 0).otherwise(n_lines).cast("long").alias("__l_n_lines"),
        F.coalesce(F.size("__l_cut"), F.lit(0)).cast("long").alias("__l_n_removed"))
