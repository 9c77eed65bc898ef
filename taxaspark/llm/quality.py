"""Quality rules whose cutoffs follow the data: quantile sketches per language and source, in DataFrame functions only.

Each document gets a few base counts. Their ratios go into mergeable quantile sketches, one for each language, source
and ratio: counts of logarithmic buckets, whose sum over any parts is the sketch of the whole and whose quantiles have
a bounded relative error. A group's fence lies beyond its high quantile by ``SPREAD`` times that quantile's distance from
the median; a small group's fence is drawn towards its language's, and that towards the one of all, in proportion to
their numbers of documents, so that no size switches a rule. Documents are then joined with the fences of their group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxaspark.llm.common import SPACE, stored, text_or_empty

#: Relative error of a quantile, and the bucket growth that follows from it.
ERROR = 0.01
GAMMA = (1 + ERROR) / (1 - ERROR)
#: The high quantile (the low one is 1 - HIGH), and the fence's distance from it.
HIGH, SPREAD = 0.95, 1.0
#: Documents of the wider group that count towards a group's fence.
PRIOR = 200.0
#: Ratio -> (expression over base columns, fence below too).
RATIOS = {
    "word_length": ("word_chars / n_words", True),
    "symbols": ("n_symbols / word_chars", False),
    "dup_lines": ("n_dup_lines / n_lines", False),
    "repeats": ("n_repeat_words / n_words", False),
}
BOUNDS = [c for k, (_, below) in RATIOS.items() for c in ([f"{k}_hi", f"{k}_lo"] if below else [f"{k}_hi"])]


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base counts of each text; a null text counts as one without words.

    ``n_lines`` counts lines with a word. Words in a repeated window of three are found by sorting the windows'
    64-bit hashes within the row.
    """
    text = text_or_empty()
    d = docs.select("doc_id", "lang", "source", text.alias("t"))
    d = d.select("doc_id", "lang", "source", "t", F.array_remove(F.split("t", f"[{SPACE}]+"), "").alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(f"[^{SPACE}]")).alias("lines"))
    windows = F.transform(F.slice("w", 1, F.greatest(F.size("w") - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)))
    d = d.select(
        "doc_id", "lang", "source",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", f"[{SPACE}]+", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("h"),
    )
    d = d.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))

    def repeated(x: Column, j: Column) -> Column:
        before, after = F.get("s", j - 1)["h"], F.get("s", j + 1)["h"]
        return F.when((x["h"] == before) | (x["h"] == after), F.array(x["i"], x["i"] + 1, x["i"] + 2)).otherwise(F.array().cast("array<int>"))

    covered = F.coalesce(F.size(F.array_distinct(F.flatten(F.transform("s", repeated)))), F.lit(0))
    return d.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.when(F.col("s").isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"))


def _bucket(x: Column) -> Column:
    """Bucket number of a ratio; null for zero."""
    return F.when(x > 0, F.ceil(F.round(F.ln(x) / math.log(GAMMA), 9)).cast("long"))


def sketches(ratios: DataFrame, names: list[str]) -> DataFrame:
    """lang, source, ratio, bucket, n: mergeable sketches; a bucket is null where the ratio is zero."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("ratio"), _bucket(F.col(k)).alias("bucket"), F.col(k).alias("v")) for k in names])).alias("x")
    rows = ratios.select("lang", "source", each).select("lang", "source", "x.ratio", "x.bucket", "x.v").filter(F.col("v").isNotNull())
    return rows.groupBy("lang", "source", "ratio", "bucket").agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches summed over everything but ``keys``."""
    return sketch.groupBy(*keys, "ratio", "bucket").agg(F.sum("n").alias("n"))


def edge(bucket: Column, above: bool) -> Column:
    """The upper or lower end of a bucket, a little further out, so that none of its values lies beyond; 0 where it is null."""
    out = F.pow(F.lit(GAMMA), bucket.cast("double") - (0 if above else 1)) * (1 + 1e-6 if above else 1 - 1e-6)
    return F.when(bucket.isNull(), 0.0).otherwise(out)


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ratio, size, and the bucket ends high, low, mid_above, mid_below, from sketches by the nearest rank."""
    w = Window.partitionBy(*keys, "ratio")  # rows: buckets, some hundred at most
    ranked = sketch.withColumn("size", F.sum("n").over(w)).withColumn("upto", F.sum("n").over(w.orderBy(F.col("bucket").asc_nulls_first())))

    def at(q: float, above: bool) -> Column:
        return F.min(F.when(F.col("upto") >= F.ceil(q * F.col("size")), edge(F.col("bucket"), above)))

    return ranked.groupBy(*keys, "ratio").agg(F.first("size").alias("size"), at(HIGH, True).alias("high"), at(1 - HIGH, False).alias("low"), at(0.5, False).alias("mid_below"), at(0.5, True).alias("mid_above"))


def fences(found: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each group: ``size`` and for each ratio ``<ratio>_hi`` and, where there is one, ``<ratio>_lo``."""
    high = F.col("high") + SPREAD * (F.col("high") - F.col("mid_below"))
    low = F.col("low") - SPREAD * (F.col("mid_above") - F.col("low"))
    out = [F.max("size").cast("double").alias("size")]
    out += [F.max(F.when(F.col("ratio") == b[:-3], high if b.endswith("_hi") else low)).alias(b) for b in BOUNDS]
    return found.groupBy(*keys).agg(*out)


def drawn(n: Column, own: Column, wider: Column) -> Column:
    """The fence of a group of ``n`` documents, drawn towards the wider group's."""
    return (n * own + PRIOR * wider) / (n + PRIOR)


def quality(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, the base counts, base_failed, kept.

    Null languages and sources form groups of their own. Empty and null texts have no words and so fail the base
    rules. Repeated rows are judged one by one; a value equal to its fence is kept, so a group of alike documents stays
    whole. A text may be of any length. An empty table gives no rows. Other columns of ``docs`` are not used.
    """
    base = stored(base_counts(docs), "quality")
    names = list(RATIOS)
    ratios = base.filter("n_words > 0").select("lang", "source", *[F.expr(f"CAST({e} AS DOUBLE)").alias(k) for k, (e, _) in RATIOS.items()])
    sketch = stored(sketches(ratios, names), "sketch")

    def renamed(keys: list[str], prefix: str) -> DataFrame:
        f = fences(quantiles(merged(sketch, keys), keys), keys)
        return f.select(*[F.col(k).alias(f"{prefix}{k}") for k in [*keys, "size", *BOUNDS]])

    own, lang, whole = renamed(["lang", "source"], "g_"), renamed(["lang"], "l_"), renamed([], "a_")
    each = own.join(lang, F.col("g_lang").eqNullSafe(F.col("l_lang")), "left").join(F.broadcast(whole), F.lit(True), "left")  # whole: one row
    groups = each.select("g_lang", "g_source", *[drawn(F.col("g_size"), F.col(f"g_{b}"), drawn(F.col("l_size"), F.col(f"l_{b}"), F.col(f"a_{b}"))).alias(b) for b in BOUNDS])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fine = F.lit(True)
    for k, (e, below) in RATIOS.items():
        fine &= F.expr(e) <= F.col(f"{k}_hi")
        if below:
            fine &= F.expr(e) >= F.col(f"{k}_lo")
    out = base.join(groups, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), F.when(failed, False).otherwise(F.coalesce(fine, F.lit(True))).alias("kept"), "lang", "source")
