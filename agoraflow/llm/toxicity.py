"""Toxicity by compression distance.

Two zstandard dictionaries share a base trained on ordinary text; one goes on with segments trained on words that toxic
documents favour, the other with segments trained on words of ordinary ones. A text is cut into windows of a few words,
each window is compressed with both, and the bytes that the toxic dictionary saves are summed up per document. A
logistic curve over those sums, fitted on the labelled documents, calibrates the score.

Fitting uses a bounded sample of labelled rows: at most MAX_TOXIC and MAX_ORDINARY documents with MAX_BYTES of text, those
with the least hash of their id. Everything else works on all rows and whole texts.

Defined results: null and empty texts are scored as texts without windows; null ids are scored and never learned from;
repeated rows are scored alike; labels other than 0 and 1 are ignored; without rows of both labels every score is
the share of label 1 among the labelled (0 if there are none); an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agoraflow.llm.shared import id_crc32, trimmed, unused

MAX_TOXIC, MAX_ORDINARY, MAX_BYTES = 2000, 6000, 64_000_000
#: Words in a window.
WINDOW = 6
#: A word counts as toxic if toxic documents have it so many times as often, and so large a share of them has it.
RATIO, SHARE = 6.0, 0.015
BASE_BYTES, CLASS_BYTES, STEP_BYTES = 14_000, 4_000, 400
THRESHOLD = 0.3
#: Texts scored together.
ROWS = 512
SAVINGS = (2, 3, 4, 5)
_OTHER = re.compile(rb"[^a-z0-9\x80-\xff]+")


def plain_words(text: str | None) -> list[bytes]:
    """Words of letters and digits in lower case."""
    return _OTHER.sub(b" ", (text or "").encode().lower()).split()


def windows(words: list[bytes], size: int = WINDOW) -> list[bytes]:
    return [b" " + b" ".join(words[i : i + size]) + b" " for i in range(0, len(words), size)]


def _compressor(content: bytes) -> zs.ZstdCompressor:
    params = zs.ZstdCompressionParameters(window_log=15, chain_log=14, hash_log=14, search_log=4, min_match=6, target_length=32, strategy=zs.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
    held = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=params)
    return zs.ZstdCompressor(compression_params=params, dict_data=held)


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    weights: list[float]  # of the constant and the features
    prior: float = 0.0

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Savings of the toxic dictionary over each text's windows."""
        toxic, ordinary = _compressor(self.toxic).compress, _compressor(self.ordinary).compress
        out = np.zeros((len(texts), 2 + 2 * len(SAVINGS)))
        for row, text in zip(out, texts, strict=True):
            gain = np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(plain_words(text))])
            if n := len(gain):
                over = [int((gain >= k).sum()) for k in SAVINGS]
                row[:] = [gain.sum() / math.sqrt(n + 1), *(x / math.sqrt(n + 1) for x in over), *(math.log1p(x) for x in over), gain.max()]
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not self.weights:
            return np.full(len(texts), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + self.features(texts) @ np.array(self.weights[1:]), -30, 30)))


def _trained(samples: list[bytes], size: int) -> bytes:
    """The content of a dictionary that zstandard trains; the samples themselves where they are too few for it."""
    try:
        return zs.train_dictionary(size + 600, samples, k=16, d=6).as_bytes()[-size:]
    except zs.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def _covering(samples: list[bytes], limit: int) -> bytes:
    """Dictionaries trained in turn, each on the samples that those before don't hold."""
    out, rest = b"", samples
    while rest and len(out) < limit:
        part = _trained(rest, STEP_BYTES)
        left = [x for x in rest if x not in part and x not in out]
        if len(left) == len(rest):
            break
        out, rest = part + out, left
    return out[-limit:]


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the constant and the columns, with a small penalty, by Newton's method."""
    mean, dev = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / dev]
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.eye(len(w)), z.T @ (p - y) + w)
    scaled = w[1:] / dev
    return np.r_[w[0] - scaled @ mean, scaled]


def fit(rows: list[tuple[str | None, int]]) -> Model:
    """A model from (text, label) rows."""
    rows = [(t, y) for t, y in dict.fromkeys(rows) if y in (0, 1)]  # a copied text teaches once
    ones, zeros = [t for t, y in rows if y == 1], [t for t, y in rows if y == 0]
    if not ones or not zeros:
        return Model(b"", b"", [], float(bool(ones)))
    # words are counted text by text and only those that toxic documents share, so that little stays in memory
    toxic_in, plain_in = Counter(), Counter()
    for t in ones:
        toxic_in.update(set(plain_words(t)))
    toxic_in = Counter({w: n for w, n in toxic_in.items() if n > 1})
    for t in zeros:
        plain_in.update(toxic_in.keys() & set(plain_words(t)))
    favour = lambda w: (toxic_in[w] + 0.5) / (len(ones) + 1) / ((plain_in[w] + 0.5) / (len(zeros) + 1))
    least = max(3, SHARE * len(ones))
    strong = {w for w, n in toxic_in.items() if n >= least and favour(w) >= RATIO}
    toxic = [b" " + w + b" " for t in ones for w in sorted(strong & set(plain_words(t)))]
    draw = random.Random(1)
    draw.shuffle(toxic)  # neighbours differ from document to document, so that segments are words and not sequences
    few = lambda items, most: draw.sample(items, min(len(items), -(-most // len(zeros))))
    plain, common = [], []
    for t in zeros:
        words = plain_words(t)
        plain += few(windows(words), 60_000)
        common += [b" " + w + b" " for w in few(sorted(w for w in set(words) if plain_in[w] >= 5 and favour(w) < 1.5), 100_000)]
    base = _trained(plain, BASE_BYTES)
    own = _covering(toxic, CLASS_BYTES)
    other = _trained(common, max(len(own), 64))
    model = Model(own + base, other + base, [])
    x = model.features([t for t, _ in rows])
    model.weights = _logistic(x, np.array([float(y) for _, y in rows])).tolist()
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame) -> list[tuple[str | None, int]]:
    """(text, toxic) rows with the least hash of their id: at most MAX_TOXIC and MAX_ORDINARY, and MAX_BYTES of text together.
    An id labelled both 0 and 1 counts as toxic."""
    own = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("y")).withColumn("h", F.xxhash64("id"))
    sides = [own.where(F.col("y") == y).orderBy("h", "id").limit(n) for y, n in ((1, MAX_TOXIC), (0, MAX_ORDINARY))]
    picked = sides[0].unionByName(sides[1])
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    found = texts.join(F.broadcast(picked), "id").orderBy("h", "id", "text").limit(MAX_TOXIC + MAX_ORDINARY)
    before = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(W.orderBy("h", "id", "text").rowsBetween(W.unboundedPreceding, 0))
    return [(r["text"], r["y"]) for r in found.withColumn("size", before).where(F.col("size") <= MAX_BYTES).collect()]


def scored(docs: DataFrame, model: Model, name: str = "_t_score") -> DataFrame:
    """docs with the score added under a name; other columns pass through, whatever their names."""
    names, at = docs.columns, docs.columns.index("text")
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    types = T.StructType([*plain.schema.fields, T.StructField("s", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.concatenate([np.zeros(0), *(model.score(batch.column(at).slice(i, ROWS).to_pylist()) for i in range(0, batch.num_rows, ROWS))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], names=types.names)
        trimmed()

    return plain.mapInArrow(run, types).toDF(*names, name)


def keep_ordinary(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score under the threshold, with their own columns."""
    name = unused(docs, "score")
    return scored(docs, model, name).where(F.col(name) < threshold).select(*[f"`{c}`" for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text")
    fold = F.pmod(id_crc32(F.col("doc_id")), F.lit(4)) == 2
    model = fit(labelled_sample(docs, labels.where(~fold)))
    return scored(docs, model).select("doc_id", fold.alias("held_out"), F.col("_t_score").alias("score"), (F.col("_t_score") >= THRESHOLD).cast("int").alias("predicted"))
