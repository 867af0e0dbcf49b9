"""Quality rules by distribution divergence, in DataFrame functions alone.

A document's histograms over character classes and over common words are compared with the mean histograms of its
language by Jensen-Shannon distance; documents far from either are rejected. References come from all documents that
pass the base rules: a language's mean with the mean of all languages added as REF_DOCS documents, so that the reference
of a small language moves towards its own mean document by document.

Defined results: null and empty texts have no words and fail the base rules; null lang is a language of its own;
documents below the length guards never fail by distance (they fail the base rules below 50 words); repeated rows are
judged alike; an empty table gives an empty result; other columns do not matter, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agoraflow.llm.shared import staged, word_array

#: Frequent function words of English, German, French and Spanish.
COMMON_WORDS = [
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "was",
    "der", "die", "und", "den", "von", "zu", "das", "mit",
    "de", "la", "le", "et", "les", "des", "en", "un",
    "que", "el", "los", "y", "las", "por",
]
#: One letter stands for each common word while they are counted.
CODES = "abcdefghijklmnopqrstuvwxyzABCDEF"
CHAR_CLASSES = ["lower", "upper", "digit", "space", "mark", "symbol"]
MARKS = r".,;:!?'\"()\-"
MIN_CHARS, MIN_WORDS, REF_DOCS = 200, 50, 30
#: Characters this far off fail alone; from LEAST_CHAR_DISTANCE on, common words decide: their squared distance may be
#: WORD_DISTANCE squared plus WORD_NOISE over the number of words, as the distance of a fair sample falls with its size.
MAX_CHAR_DISTANCE, LEAST_CHAR_DISTANCE, WORD_DISTANCE, WORD_NOISE = 0.26, 0.115, 0.13, 2.5


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """docs with the base figures and both histograms in columns prefixed _q_."""
    df = docs.withColumn("_q_text", F.coalesce(F.col("text"), F.lit(""))).withColumn("_q_words", word_array(F.col("text")))
    words, text = F.col("_q_words"), F.col("_q_text")
    count = F.size(words)
    hashes = F.when(count >= 3, F.transform(F.sequence(F.lit(1), count - 2), lambda i: F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2))))
    frequent = F.filter(F.transform(words, lambda w: F.lower(w)), lambda w: w.isin(COMMON_WORDS))
    codes = F.create_map([F.lit(x) for pair in zip(COMMON_WORDS, CODES, strict=True) for x in pair])
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumns({
        "_q_n_words": count.cast("long"),
        "_q_word_chars": F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.length(w)),
        "_q_hashes": hashes,
        "_q_lines": lines,
        "_q_codes": F.array_join(F.transform(frequent, lambda w: F.element_at(codes, w)), ""),
        "_q_n_symbols": _matches(text, r"[#*$%&|<>]"),
        "_q_n_chars": F.length(text).cast("long"),
        "_q_upper": _matches(text, r"\p{Lu}"),
        "_q_digit": _matches(text, r"\p{N}"),
        "_q_mark": _matches(text, f"[{MARKS}]"),
        "_q_symbol": _matches(text, rf"[^\p{{L}}\p{{M}}\p{{N}}\x20\x09-\x0D{MARKS}]"),
    })
    # all hashes distinct proves that no window repeats; else the windows themselves are compared
    twice = F.coalesce(F.size(F.array_distinct("_q_hashes")) < F.size("_q_hashes"), F.lit(False))
    windows = F.transform(F.sequence(F.lit(1), F.col("_q_n_words").cast("int") - 2), lambda i: F.struct(F.concat_ws(" ", F.slice(words, i, 3)).alias("w"), i.alias("i")))
    df = df.withColumns({
        "_q_sorted": F.when(twice, F.sort_array(windows)),
        "_q_n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
    }).drop("_q_words", "_q_hashes", "_q_lines", "_q_text")
    ordered = F.col("_q_sorted")
    alike = lambda s, i, by: F.coalesce(F.get(ordered, i + by)["w"] == s["w"], F.lit(False))
    again = F.sort_array(F.transform(F.filter(ordered, lambda s, i: alike(s, i, -1) | alike(s, i, 1)), lambda s: s["i"]))
    df = df.withColumn("_q_again", again).drop("_q_sorted")
    at = F.col("_q_again")
    covered = F.aggregate(F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    df = df.withColumn("_q_n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_q_again")
    df = df.withColumn("_q_space", F.col("_q_n_chars") - F.col("_q_word_chars"))
    df = df.withColumn("_q_lower", reduce(lambda a, c: a - F.col(f"_q_{c}"), ["upper", "digit", "space", "mark", "symbol"], F.col("_q_n_chars")))
    some = F.col("_q_codes")
    each = [(F.length(some) - F.length(F.replace(some, F.lit(c), F.lit("")))).cast("double") for c in CODES]
    share = lambda x, total: x / F.greatest(total, F.lit(1)).cast("double")
    return (
        df.withColumn("_q_chars", F.array([share(F.col(f"_q_{c}").cast("double"), F.col("_q_n_chars")) for c in CHAR_CLASSES]))
        .withColumn("_q_common", F.array([share(x, F.col("_q_n_words")) for x in [*each, F.col("_q_n_words") - F.length(some)]]))
        .withColumn("_q_base_failed", (F.col("_q_n_words") < 50) | (100 * F.col("_q_n_repeat_words") > 50 * F.col("_q_n_words")))
        .drop("_q_codes", *[f"_q_{c}" for c in CHAR_CLASSES])
    )


def references(figures: DataFrame) -> DataFrame:
    """A row of sums of histograms for each language, over documents that pass the base rules, and one for all (_q_lang null, _q_all true)."""
    ok = figures.where(~F.col("_q_base_failed"))
    total = lambda name, n: F.array([F.sum(F.col(name)[i]) for i in range(n)]).alias(name.replace("_q_", "_q_ref_"))
    aggs = [total("_q_chars", len(CHAR_CLASSES)), total("_q_common", len(COMMON_WORDS) + 1), F.count(F.lit(1)).alias("_q_docs")]
    by = ok.groupBy(F.col("lang").alias("_q_lang")).agg(*aggs)
    return by.withColumn("_q_all", F.lit(False)).unionByName(ok.agg(*aggs).withColumns({"_q_lang": F.lit(None).cast("string"), "_q_all": F.lit(True)}))


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence to base 2; 0 for equal, 1 for disjoint histograms."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    terms = F.zip_with(p, q, lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def judged(figures: DataFrame, refs: DataFrame) -> DataFrame:
    """figures with _q_char_distance, _q_word_distance and _q_kept. References are broadcast up to 1000 languages, joined by key beyond."""
    refs = staged(refs, "language-references")
    overall = refs.where("_q_all").first()
    per = refs.where("NOT _q_all").drop("_q_all")
    few = per.count() <= 1000
    df = figures.join(F.broadcast(per) if few else per, figures["lang"].eqNullSafe(per["_q_lang"]), "left")
    every = max(1, overall["_q_docs"])

    def reference(name: str) -> Column:
        means = [(x or 0.0) / every for x in overall[name]]
        own = F.coalesce(F.col(name), F.array([F.lit(0.0)] * len(means)))
        return F.transform(F.arrays_zip(own.alias("a"), F.array([F.lit(x) for x in means]).alias("b")), lambda z: (z["a"] + REF_DOCS * z["b"]) / (F.coalesce("_q_docs", F.lit(0)) + REF_DOCS))

    df = df.withColumns({"_q_ref_chars": reference("_q_ref_chars"), "_q_ref_common": reference("_q_ref_common")})
    df = df.withColumns({"_q_char_distance": js_distance(F.col("_q_chars"), F.col("_q_ref_chars")), "_q_word_distance": js_distance(F.col("_q_common"), F.col("_q_ref_common"))})
    short = (F.col("_q_n_chars") < MIN_CHARS) | (F.col("_q_n_words") < MIN_WORDS)
    chars, words = F.col("_q_char_distance"), F.col("_q_word_distance")
    far = (chars > MAX_CHAR_DISTANCE) | ((chars > LEAST_CHAR_DISTANCE) & (words * words > WORD_DISTANCE**2 + WORD_NOISE / F.col("_q_n_words")))
    return df.withColumn("_q_kept", ~F.col("_q_base_failed") & (short | ~F.coalesce(far, F.lit(False)))).drop("_q_ref_chars", "_q_ref_common", "_q_lang", "_q_docs")


def judge_documents(docs: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
    """docs with all figures, without the columns named; each text is measured once and the table staged before references are taken from it."""
    figures = staged(measured(docs).drop(*without), "figures")
    return judged(figures, references(figures))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns."""
    own = [f"c{i}" for i in range(len(docs.columns))]  # no name of a column meets those of the figures
    plain = docs.toDF(*own)
    text, lang = (F.col(own[docs.columns.index(c)]).alias(c) for c in ("text", "lang"))
    return judge_documents(plain.select(*own, text, lang), ("text",)).where("_q_kept").select(*own).toDF(*docs.columns)


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    figures = staged(measured(docs).drop("text"), "figures")
    extra = [F.round(F.col(f"_q_{c}"), 6).alias(c) for c in ("char_distance", "word_distance")]
    return judged(figures, references(figures)).select("doc_id", *[F.col(f"_q_{c}").alias(c) for c in BASE], *extra)
