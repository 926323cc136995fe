"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Each text's words and word pairs fall into ``buckets`` by hash. Two multinomials over the buckets are counted, one
over all different texts and one over those of trusted documents; a text's score is the mean log ratio of its
n-grams, and the text is kept where the score is at least ``threshold``. Some plain rules on the text come first.

Defined results: a null text counts as empty; a text without words scores 0 and fails the word-count rule; a null
id is scored and never trusted itself; a text is counted once, however often it occurs, and as trusted if any of its
rows is, but every row is judged; texts are told apart by 64-bit hashes, three-word windows of a text by the upper
bits of theirs, as many as its number of windows leaves of 64; without trusted documents every ratio is 0;
columns other than id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, join_ids, let, table, words, written

BUCKETS = 1 << 16
#: Mean log ratio from which a text is kept; texts like the trusted ones lie around 0.
THRESHOLD = -0.11
#: Raw pseudo-counts a bucket. They shrink what a small trusted sample has merely not seen, so that the threshold
#: holds for few labels as for many.
PRIOR = 8
MIN_WORDS = 50
#: Highest share of words in repeated three-word windows, in percent.
MAX_REPEATED = 50
SYMBOL = r"[#*$%&|<>]"


def hashed(found: Column) -> Column:
    return F.transform(found, lambda w: F.xxhash64(w))


def word_hashes(text: Column) -> Column:
    return hashed(words(text))


def ngram_buckets(hashes: Column, buckets: int) -> Column:
    """Buckets of all words, then of all pairs of neighbours."""
    pairs = F.transform(
        F.slice(hashes, 2, F.greatest(F.size(hashes) - 1, F.lit(0))),
        lambda h, i: F.pmod(F.xxhash64(hashes[i], h), F.lit(buckets)).cast("int"),
    )
    return F.concat(F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)).cast("int")), pairs)


def mean_ratio(hashes: Column, ratios: Column, buckets: int) -> Column:
    """The mean of the ratios over the buckets that ``ngram_buckets`` gives, without writing them out."""
    at = lambda h: F.get(ratios, F.pmod(h, F.lit(buckets)).cast("int"))
    both = F.transform(
        hashes, lambda h, i: at(h) + F.when(i > 0, at(F.xxhash64(F.get(hashes, i - 1), h))).otherwise(0.0)
    )
    return F.aggregate(both, F.lit(0.0), lambda s, x: s + x) / F.greatest(2 * F.size(hashes) - 1, F.lit(1))


def repeated_words(hashes: Column) -> Column:
    """How many words stand in three-word windows found at least twice. Windows are sorted as plain longs: the upper
    bits are the hash, the lower ones the place."""

    def covered(ranked: Column, bits: Column) -> Column:
        upper = lambda x: F.call_function("shiftright", x, bits)
        same = lambda x, k: F.coalesce(upper(F.get(ranked, k)) == upper(x), F.lit(False))
        twice = F.filter(ranked, lambda x, k: same(x, k - 1) | same(x, k + 1))
        places = F.sort_array(F.transform(twice, lambda x: x - F.call_function("shiftleft", upper(x), bits)))
        start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(
            places,
            start,
            lambda s, p: F.struct((p + 3).alias("end"), (s["n"] + p + 3 - F.greatest(p, s["end"])).alias("n")),
            lambda s: s["n"],
        )

    def ranked(windows: Column, bits: Column) -> Column:
        upper = lambda h: F.call_function("shiftleft", F.call_function("shiftright", h, bits), bits)
        return F.sort_array(F.transform(windows, lambda h, i: upper(h) + i))

    def counted(windows: Column) -> Column:
        bits = F.length(F.bin(F.size(windows).cast("long")))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(
            let(bits, lambda n: let(ranked(windows, n), lambda x: covered(x, n)))
        )

    windows = F.transform(
        F.slice(hashes, 3, F.greatest(F.size(hashes) - 2, F.lit(0))),
        lambda h, i: F.xxhash64(hashes[i], hashes[i + 1], h),
    )
    return F.when(F.size(hashes) < 3, F.lit(0).cast("long")).otherwise(let(windows, counted))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(WORD)))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def known_texts(docs: DataFrame, trusted_ids: DataFrame) -> DataFrame:
    """Each text that is trusted or occurs more than once: its ``hash``, its rows and how many of them are trusted."""
    marked = join_ids(
        docs.select("doc_id", text_hash().alias("hash")),
        trusted_ids.select("doc_id", F.lit(1).alias("trusted")),
        "doc_id",
        "left",
    )
    texts = marked.groupBy("hash").agg(F.count("*").alias("copies"), F.count("trusted").alias("labelled"))
    return written(texts.filter("copies > 1 OR labelled > 0"), "known-texts")


def log_ratios(docs: DataFrame, trusted_ids: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Each bucket's log ratio of trusted to raw probability, shrunk towards 0 by ``PRIOR``, which is held against the
    n-grams of all trusted rows. Counted over all different texts; only bucket totals and hashes of texts are
    shuffled, and there are at most ``buckets`` rows."""
    rows = docs.select("text", text_hash().alias("hash"))
    found = join_ids(rows, known_texts(docs, trusted_ids), "hash", "left").select(
        F.coalesce("copies", F.lit(1)).alias("copies"),
        F.coalesce("labelled", F.lit(0)).alias("labelled"),
        F.explode(
            let(word_hashes(F.coalesce("text", F.lit(""))), lambda h: ngram_buckets(h, buckets))
        ).alias("bucket"),
    )
    # all copies of a text fall into one group, so that dividing by their number is exact
    counts = found.groupBy("bucket", "copies", "labelled").agg((F.count("*") / F.col("copies")).alias("once"))
    counts = counts.groupBy("bucket").agg(
        F.sum("once").alias("raw"),
        F.sum(F.when(F.col("labelled") > 0, F.col("once")).otherwise(0.0)).alias("target"),
        F.sum(F.col("once") * F.col("labelled")).alias("seen"),
    )
    counts = written(counts, "ngram-buckets")
    total = counts.agg(*[F.sum(c).alias(c) for c in ("raw", "target", "seen")])
    totals = {f"{c}s": total.select(c).scalar() for c in ("raw", "target", "seen")}
    share = F.col("raw") / F.col("raws")
    good = F.col("target") / F.col("targets") * F.col("seens")
    ratio = F.log((good + share * buckets * PRIOR) / (F.col("seens") + buckets * PRIOR) / share)
    return counts.withColumns(totals).filter("targets > 0").select("bucket", ratio.alias("ratio"))


def as_array(ratios: DataFrame, buckets: int) -> Column:
    """The ratios, to four digits, as a constant array; its size is that of the bucket table, whatever the corpus."""
    found = ["0"] * buckets
    for bucket, ratio in ratios.collect():
        found[bucket] = f"{ratio:.4g}"
    return F.split(F.lit(",".join(found)), ",").cast("array<double>")


def judge(
    docs: DataFrame,
    trusted_ids: DataFrame,
    buckets: int = BUCKETS,
    threshold: float = THRESHOLD,
    min_words: int = MIN_WORDS,
    max_repeated: int = MAX_REPEATED,
    whole_rows: bool = False,
) -> DataFrame:
    """Per document: its counts, ``score``, ``base_failed`` and ``kept``, with ``whole_rows`` its row too, as ``_row``."""
    ratios = as_array(log_ratios(docs, trusted_ids, buckets), buckets)
    safe = F.coalesce("text", F.lit(""))
    extra = [F.struct(*docs.columns).alias("_row")] if whole_rows else []
    measured = docs.select("doc_id", *extra, safe.alias("_text")).select(
        "doc_id",
        *(["_row"] if whole_rows else []),
        F.regexp_count("_text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        duplicate_lines(F.col("_text")).alias("n_dup_lines"),
        let(
            words(F.col("_text")),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                let(
                    hashed(w),
                    lambda h: F.struct(
                        repeated_words(h).alias("repeated"), mean_ratio(h, ratios, buckets).alias("score")
                    ),
                ).alias("of"),
            ),
        ).alias("_m"),
    )
    measured = measured.select(
        *[c for c in measured.columns if c not in ("_m", "_text")],
        "_m.n_words",
        "_m.word_chars",
        F.col("_m.of.repeated").alias("n_repeat_words"),
        F.col("_m.of.score").alias("score"),
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeated * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("score") >= threshold)
    )


def trusted(labels: DataFrame) -> DataFrame:
    """Ids of the documents that the label table calls good."""
    return labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()


def op8_quality_rules(spark, sf_dir):
    out = judge(table(spark, sf_dir, "documents"), trusted(table(spark, sf_dir, "labels")))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )


def stage(spark, docs, sf_dir):
    """Drop what the rules reject; all else of the documents stays as it is."""
    out = judge(docs, trusted(table(spark, sf_dir, "labels")), whole_rows=True)
    return out.filter("kept").select("_row.*")
