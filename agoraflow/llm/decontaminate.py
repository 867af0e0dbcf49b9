"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions alone.

A seed hashes the words at the kept positions of a mask laid on SPAN words, so words at the other positions may differ.
Seeds of benchmark items are joined with those of documents; every hit gives a diagonal, on which the item is laid
against the document word by word and the best run of agreement (a match counts 1, a mismatch MISMATCH) is taken.
Words agreeing on all diagonals of an item together decide.

Words are compared in lower case, without anything but letters and digits. Items too short for a seed are found whole: from
LEAST_SHORT words on wherever a document has all of them in a row, shorter ones where they are all of a document's words.

Defined results: null and empty texts and items match nothing; repeated rows give one row together, null ids one like any other; several
items may match one document; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agoraflow.llm.shared import staged, unused

#: Fixed masks: 1 is kept, 0 is ignored.
MASKS = ["1101100111", "1110110101"]
SPAN, LEAST_SHORT = 10, 6
MISMATCH = -1.5
#: A leak has SPAN agreeing words in a run, or this share of the item and LEAST_WORDS.
SHARE, LEAST_WORDS = 0.5, 9
#: Rows up to which a side is broadcast; beyond, both sides are shuffled by key.
BROADCAST_SEEDS, BROADCAST_HITS = 1_000_000, 100_000


def word_hashes(text: Column) -> Column:
    """The words of a text as hashes."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\x20\x09-\x0D]+", "")
    return F.transform(F.filter(F.split(plain, r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def seeds(words: Column) -> Column:
    """array<struct<h, at>> of all seeds of all masks."""
    last = F.size(words) - SPAN

    def of(k: int, mask: str) -> Column:
        kept = [i for i, c in enumerate(mask) if c == "1"]
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.xxhash64(F.lit(k), *[F.get(words, i + o) for o in kept]).alias("h"), i.alias("at")))

    return F.when(last >= 0, F.concat(*[of(k, m) for k, m in enumerate(MASKS)]))


def whole(words: Column, sizes: list[int], item: bool) -> Column:
    """As seeds(), for items of these sizes: a hash of all words of an item; of every run of so many words of a document."""
    last = F.size(words)

    def of(n: int) -> Column:
        fits = last == n if item or n < LEAST_SHORT else last >= n
        hashed = F.transform(F.sequence(F.lit(0), last - n), lambda i: F.struct(F.xxhash64(F.lit(100 + n), *[F.get(words, i + o) for o in range(n)]).alias("h"), i.alias("at")))
        return F.when(fits, hashed).otherwise(F.array().cast("array<struct<h:bigint,at:int>>"))

    return F.concat(*map(of, sizes))


def best_run(ours: Column, theirs: Column, shift: Column) -> Column:
    """Agreeing words in the best run of `theirs` laid on `ours` from position shift on."""
    agree = F.transform(theirs, lambda w, i: F.coalesce(F.when(i + shift >= 0, F.get(ours, i + shift)) == w, F.lit(False)))
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("m"), F.lit(0.0).alias("best"), F.lit(0).alias("bm"))

    def step(a: Column, hit: Column) -> Column:
        s = F.greatest(a["s"] + F.when(hit, 1.0).otherwise(MISMATCH), F.lit(0.0))
        m = F.when(s > 0, a["m"] + hit.cast("int")).otherwise(0)
        return F.struct(s.alias("s"), m.alias("m"), F.greatest(a["best"], s).alias("best"), F.when(s > a["best"], m).otherwise(a["bm"]).alias("bm"))

    return F.aggregate(agree, zero, step)["bm"]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("_d_id"), row_key().alias("_d_key"), F.col("text").alias("_d_text"))


def row_key() -> Column:
    """128 bits of hashes of id and text: rows with equal keys are repeated rows."""
    return F.concat_ws(" ", F.xxhash64("doc_id", "text"), F.xxhash64(F.lit(1), "text", "doc_id"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """_d_key, doc_id, item_id, matched_words, item_words of every document and benchmark item that overlap."""
    items = staged(benchmark.select(F.col("item_id").alias("item_id"), word_hashes(F.col("text")).alias("item")).where(F.size("item") > 0).distinct().withColumn("k", F.xxhash64("item_id", "item")), "items")
    short = sorted(r["n"] for r in items.select(F.size("item").alias("n")).where(F.col("n") < SPAN).distinct().collect())  # SPAN rows at most

    def found_by(words: Column, item: bool) -> Column:
        long = F.coalesce(seeds(words), F.array().cast("array<struct<h:bigint,at:int>>"))
        return F.explode(F.concat(long, whole(words, short, item)) if short else long).alias("s")

    theirs = items.select("k", found_by(F.col("item"), True)).select("k", F.col("s.h").alias("h"), F.col("s.at").alias("q"))
    theirs = staged(theirs, "item-seeds")
    few = theirs.count() <= BROADCAST_SEEDS
    ours = _keyed(docs).select("_d_key", word_hashes(F.col("_d_text")).alias("w"))
    ours = ours.select("_d_key", found_by(F.col("w"), False)).select("_d_key", F.col("s.h").alias("h"), F.col("s.at").alias("p"))
    hits = ours.join(F.broadcast(theirs) if few else theirs, "h").select("_d_key", "k", (F.col("p") - F.col("q")).alias("shift")).distinct()
    hits = staged(hits, "seed-hits")
    some = hits.join(F.broadcast(items) if few else items, "k")
    if hits.count() <= BROADCAST_HITS:
        some = F.broadcast(some)
    found = _keyed(docs).join(some, "_d_key").select("_d_key", "_d_id", "item_id", "k", F.size("item").alias("n"), "shift", "item", word_hashes(F.col("_d_text")).alias("w"))
    runs = found.select("_d_key", "_d_id", "item_id", "k", "n", "shift", best_run(F.col("w"), F.col("item"), F.col("shift")).alias("m")).distinct()
    total = runs.groupBy("_d_key", F.col("_d_id").alias("doc_id"), "item_id", "k", F.col("n").alias("item_words")).agg(F.max("m").alias("longest"), F.sum("m").alias("m"))
    total = total.withColumn("matched_words", F.least(F.col("m"), F.col("item_words")).cast("int"))
    leak = (F.col("longest") >= F.least(F.lit(SPAN), F.col("item_words"))) | ((F.col("longest") >= LEAST_WORDS) & (F.col("matched_words") >= SHARE * F.col("item_words")))
    return total.where(leak).select("_d_key", "doc_id", "item_id", "matched_words", "item_words")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any leak, with their own columns."""
    bad = staged(leaks(docs, benchmark).select("_d_key").distinct(), "leaks")
    few = bad.count() <= BROADCAST_HITS
    name = unused(docs, "key")
    keyed, bad = docs.withColumn(name, row_key()), bad.withColumnRenamed("_d_key", name)
    return keyed.join(F.broadcast(bad) if few else bad, name, "left_anti").select(*[f"`{c}`" for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return leaks(docs, items).select("doc_id", "item_id", "matched_words", "item_words")
