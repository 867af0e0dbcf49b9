"""Language-model scoring by Brown class-based bigrams.

Every training word is in one class. The UNITS most frequent words and the end are clustered on the driver by exchange: a
word moves to the class that raises the likelihood of the class bigrams most, until none moves. All other words follow
in distributed sweeps: each word's neighbours are gathered by class, and the word goes to its best class by the same
likelihood; the first sweep knows the classes of frequent words alone, those after it the classes of all words. A sweep
that does not raise the exact likelihood is undone and ends the exchange. P(word | previous) = P(class | previous class) *
P(word | class): transitions are smoothed with class frequencies, emissions by adding 0.5, and one word stands for those
never seen, in the class that holds most words seen once; so the model sums to one over all words and the end.

What is gathered are the counts and neighbours of all training words; a class table has a fixed size.

Defined results: null and empty texts have one token, the end; a null id counts as the empty string in the fold and
stays null; repeated rows are scored alike and counted as often as they occur; without training tokens every
probability is that of an unknown word among none; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from agoraflow.llm.blocks import BLOCK_WORDS, read_table, split_blocks, write_tables
from agoraflow.llm.shared import dropped, freed, fresh_path, id_crc32, open_file, staged, trimmed, whole_file

UNITS, CLASSES, PASSES, SWEEPS = 2000, 64, 8, 2
#: Weight of class frequencies in smoothed transitions, in tokens.
PRIOR = 20.0
#: Rows of the unit-by-unit count matrix that travel together.
STRIPE = 64
#: Words from which on gains are exact; words whose exact gains are computed together; words gathered in one task.
HEAVY, CHUNK, BUCKET_WORDS = 64, 64, 50_000
#: The class of words that have none yet.
NONE = 255


def bigram_counts(docs: DataFrame, folder: str, units: int) -> np.ndarray:
    """How often a unit directly follows another in documents with flag, over all blocks; each document starts after the end."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, at, unit = None, None, None
        for batch in batches:
            for block, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if block != at:
                    at, unit = block, read_table(folder, block)["unit"].to_numpy()
                if total is None:
                    total = np.zeros(units * units, np.int64)
                own = unit[np.frombuffer(words, np.uint32)].astype(np.int64)
                left = np.concatenate([own[-1:], own[:-1]])
                pairs, n = np.unique((left * units + own)[(left >= 0) & (own >= 0)], return_counts=True)
                total[pairs] += n
        if total is not None:
            for start in range(0, units, STRIPE):
                part = total[start * units : (start + STRIPE) * units]
                yield pa.RecordBatch.from_pydict({"stripe": pa.array([start], pa.int32()), "counts": [zlib.compress(part.tobytes(), 1)]})

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for stripe, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(counts), np.int64)
                held[stripe] = held[stripe] + part if stripe in held else part
        if held:
            yield pa.RecordBatch.from_pydict({"stripe": pa.array(list(held), pa.int32()), "counts": [zlib.compress(x.tobytes(), 1) for x in held.values()]})

    kind = "stripe int, counts binary"
    parts = docs.where("flag").select("block", "words").mapInArrow(count, kind)
    out = np.zeros((units, units), np.int64)
    for row in parts.repartition(max(1, -(-units // STRIPE)), "stripe").mapInArrow(summed, kind).toLocalIterator():  # units squared at most
        part = np.frombuffer(zlib.decompress(row["counts"]), np.int64).reshape(-1, units)
        out[row["stripe"] : row["stripe"] + len(part)] += part
    return out


def exchange(counts: np.ndarray, classes: int = CLASSES, passes: int = PASSES) -> np.ndarray:
    """The class of each unit: units, most frequent first, move to the class that raises the class-bigram likelihood most, until none moves."""
    f = lambda x: x * np.log(np.maximum(x, 1.0))
    counts = counts.astype(np.float64)
    units, total = len(counts), counts.sum(1)
    order = np.argsort(-total, kind="stable")
    of = np.empty(units, np.int64)
    of[order] = np.arange(units) % classes
    member = np.zeros((units, classes))
    member[np.arange(units), of] = 1
    after, before = counts @ member, member.T @ counts  # unit to class, class to unit
    table, mass_l, mass_r, seen = member.T @ after, member.T @ total, member.T @ counts.sum(0), counts.sum(0)
    for _ in range(passes):
        moved = 0
        for u in order:
            if not total[u] and not seen[u]:
                continue
            a, own = of[u], counts[u, u]
            r, l = after[u].copy(), before[:, u].copy()  # noqa: E741
            r[a] -= own
            l[a] -= own
            table[a] -= r
            table[:, a] -= l
            table[a, a] -= own
            mass_l[a] -= total[u]
            mass_r[a] -= seen[u]
            old = f(table)
            rows, cols = f(table + r) - old, f(table + l[:, None]) - old
            diagonal = table.diagonal()
            gain = rows.sum(1) - rows.diagonal() + cols.sum(0) - cols.diagonal() + f(diagonal + r + l + own) - f(diagonal)
            gain -= f(mass_l + total[u]) - f(mass_l) + f(mass_r + seen[u]) - f(mass_r)
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            table[b] += r
            table[:, b] += l
            table[b, b] += own
            mass_l[b] += total[u]
            mass_r[b] += seen[u]
            if b != a:
                moved += 1
                of[u] = b
                after[:, a] -= counts[:, u]
                after[:, b] += counts[:, u]
                before[a] -= counts[u]
                before[b] += counts[u]
        if not moved:
            break
    return of


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def likelihood(table: np.ndarray) -> float:
    """Log-likelihood of class bigrams, without what no move changes."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(0)).sum() - _xlogx(table.sum(1)).sum())


def best_classes(after: np.ndarray, before: np.ndarray, own: np.ndarray, of: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The best class for each of some units by their bigrams with classes, all other units staying where they are. own: how often a unit follows itself."""
    table, total, seen, place = table.astype(np.float64), after.sum(1), before.sum(1), np.arange(len(of))
    r, l = after.copy(), before.copy()  # noqa: E741
    r[place, of] -= own
    l[place, of] -= own
    mass_l, mass_r, f = table.sum(1), table.sum(0), _xlogx
    more = lambda x: f(x + 1) - f(x)
    t, d = table, more(table)
    gain = r @ d.T + l @ d + own[:, None] * d.diagonal() - total[:, None] * more(mass_l) - seen[:, None] * more(mass_r)
    less = lambda x: more(np.maximum(x, 0.0))
    stay = (r * less(t[of] - r)).sum(1) + (l * less(t.T[of] - l)).sum(1) + own * less(t[of, of] - r[place, of] - l[place, of] - own)
    gain[place, of] = stay - total * less(mass_l[of] - total) - seen * less(mass_r[of] - seen)
    heavy = np.flatnonzero(total + seen >= 2 * HEAVY)
    for i in range(0, len(heavy), CHUNK):
        u = heavy[i : i + CHUNK]
        k, a, ru, lu, ou = np.arange(len(u)), of[u], r[u], l[u], own[u]
        t = np.repeat(table[None], len(u), 0)
        t[k, a] -= ru
        t[k, :, a] -= lu
        t[k, a, a] -= ou
        ml, mr = np.repeat(mass_l[None], len(u), 0), np.repeat(mass_r[None], len(u), 0)
        ml[k, a] -= total[u]
        mr[k, a] -= seen[u]
        old, diagonal = f(t), t.diagonal(0, 1, 2)
        rows, cols = f(t + ru[:, None, :]) - old, f(t + lu[:, :, None]) - old
        g = rows.sum(2) - rows.diagonal(0, 1, 2) + cols.sum(1) - cols.diagonal(0, 1, 2) + f(diagonal + ru + lu + ou[:, None]) - f(diagonal)
        gain[u] = g - f(ml + total[u][:, None]) + f(ml) - f(mr + seen[u][:, None]) + f(mr)
    best = gain.argmax(1)
    return np.where(gain[place, best] > gain[place, of] + 1e-9, best, of)


def nearest_classes(after: np.ndarray, before: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The best class for words that have none yet; the largest class where nothing is known of a word's neighbours."""
    more = lambda x: _xlogx(x + 1) - _xlogx(x)
    d, mass_l, mass_r = more(table), table.sum(1), table.sum(0)
    gain = after @ d.T + before @ d - after.sum(1)[:, None] * more(mass_l) - before.sum(1)[:, None] * more(mass_r)
    return (gain + 1e-9 * mass_l / max(mass_l.sum(), 1.0)).argmax(1)


class Corpus:
    """Documents as numbers of their blocks' words, with files that tell each block the count, the place and the class of its words."""

    def __init__(self, docs: DataFrame, tables: str, buckets: int, classes: int):
        self.docs, self.tables, self.buckets, self.classes = docs, tables, buckets, classes

    def table(self, folder: str) -> np.ndarray:
        """Class bigrams of the documents with flag, by the classes in a folder."""
        classes = self.classes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, of, total = None, None, np.zeros(classes * classes, np.int64)
            for batch in batches:
                for block, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if block != at:
                        at, of = block, np.frombuffer(open_file(folder, block), np.uint8)
                    k = of[np.frombuffer(words, np.uint32)].astype(np.int64)
                    total += np.bincount(np.concatenate([k[-1:], k[:-1]]) * classes + k, minlength=classes * classes)
            yield pa.RecordBatch.from_pydict({"at": pa.array(range(classes), pa.int32()), "counts": pa.array([x.tolist() for x in total.reshape(classes, -1)], pa.list_(pa.int64()))})

        rows = self.docs.where("flag").select("block", "words").mapInArrow(run, "at int, counts array<long>")
        summed = rows.groupBy("at").agg(F.array(*[F.sum(F.col("counts")[i]) for i in range(classes)]).alias("counts"))
        out = np.zeros((classes, classes))
        for row in summed.collect():  # a row for each class
            out[row["at"]] = row["counts"]
        return out

    def sweep(self, folder: str | None, first: np.ndarray, table: np.ndarray, to: str) -> None:
        """Write every block's classes into the folder `to`: those of the clustered units stay, every other word goes to its best one."""
        tables, buckets, classes = self.tables, self.buckets, self.classes
        kind = "block string, bucket int, data binary"

        def rows_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["block", "bucket", "data"])

        def classed(block: str, unit: np.ndarray) -> np.ndarray:
            if folder is not None:
                return np.frombuffer(open_file(folder, block), np.uint8)
            return np.where(unit >= 0, first[unit], NONE).astype(np.uint8)

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held, unit, place, of, local, mine = None, [], None, None, None, None, None

            def told() -> Iterator[pa.RecordBatch]:
                if at is None:
                    return
                number = mine
                word, before, after = (np.concatenate([np.zeros(0, np.int64), *(h[k] for h in held)]).astype(np.int64) for k in range(3))
                held.clear()
                order = np.argsort(word, kind="stable")
                word, before, after = word[order], before[order].astype(np.uint8), after[order].astype(np.uint8)
                count = np.bincount(word, minlength=len(number))
                start = np.cumsum(count) - count
                bucket = place[number] % buckets
                dealt = np.argsort(bucket, kind="stable")
                for own in np.split(dealt, np.flatnonzero(np.diff(bucket[dealt])) + 1) if len(dealt) else ():
                    n = count[own]
                    end = np.cumsum(n)
                    some = np.repeat(start[own] - end + n, n) + np.arange(end[-1])
                    head = np.stack([number[own], place[number[own]] // buckets, n, of[number[own]]]).astype(np.uint32)
                    yield rows_of([(at, int(bucket[own[0]]), np.uint32(len(own)).tobytes() + head.tobytes() + before[some].tobytes() + after[some].tobytes())])

            for batch in batches:
                for block, flag, words in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    if block != at:
                        yield from told()
                        at, whole = block, read_table(tables, block)
                        unit, place = whole["unit"].to_numpy(), whole["id"].to_numpy()
                        of = classed(block, unit)
                        local = np.full(len(unit), -1, np.int64)
                        mine = np.flatnonzero((unit < 0) & (place >= 0))
                        local[mine] = np.arange(len(mine))
                    if flag:
                        own = np.frombuffer(words, np.uint32)
                        k = of[own]
                        word = local[own]
                        here = np.flatnonzero(word >= 0)  # never the end, which is a unit
                        held.append((word[here], np.concatenate([k[-1:], k[:-1]])[here], np.concatenate([k[1:], k[:1]])[here]))
            yield from told()
            trimmed()

        def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held = None, []

            def told() -> Iterator[pa.RecordBatch]:
                if not held:
                    return
                size = 1 + max(int(h[1][1].max()) for h in held)
                after, before, own = (np.zeros(size * classes, np.float32) for _ in range(3))
                old = np.full(size, NONE, np.int64)
                for _, head, b, a in held:
                    old[head[1]] = head[3]
                    w = np.repeat(head[1].astype(np.int64), head[2])
                    for out, k in ((before, b), (after, a)):
                        out += np.bincount((w * classes + k)[k < classes], minlength=size * classes).astype(np.float32)
                after, before = after.reshape(size, -1), before.reshape(size, -1)
                to = np.empty(size, np.uint8)
                for i in range(0, size, 4096):
                    part = slice(i, i + 4096)
                    if folder is None:
                        to[part] = nearest_classes(after[part].astype(np.float64), before[part].astype(np.float64), table)
                    else:
                        to[part] = best_classes(after[part].astype(np.float64), before[part].astype(np.float64), np.zeros(len(to[part])), np.where(old[part] == NONE, 0, old[part]), table)
                for block, head, _, _ in held:
                    yield rows_of([(block, at, head[0].tobytes() + to[head[1]].tobytes())])
                held.clear()

            for batch in batches:
                for block, bucket, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    if bucket != at:
                        yield from told()
                        at = bucket
                    n = int(np.frombuffer(data, np.uint32, 1)[0])
                    head = np.frombuffer(data, np.uint32, 4 * n, 4).reshape(4, n)
                    sides = np.frombuffer(data, np.uint8, -1, 4 + 16 * n)
                    held.append((block, head, sides[: len(sides) // 2], sides[len(sides) // 2 :]))
            yield from told()
            trimmed()

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, of = None, None

            def close() -> None:
                if at is not None:
                    whole_file(to, at, pa.compress(of.tobytes(), "zstd", asbytes=True), len(of))

            for batch in batches:
                for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if block != at:
                        close()
                        at, unit = block, read_table(tables, block)["unit"].to_numpy()
                        of = np.where(unit >= 0, first[unit], NONE).astype(np.uint8)
                    if data:
                        n = len(data) // 5
                        of[np.frombuffer(data, np.uint32, n)] = np.frombuffer(data, np.uint8, n, 4 * n)
            close()
            yield pa.RecordBatch.from_pydict({"done": pa.array([1], pa.int32())})

        gathered = self.docs.select("block", "flag", "words").mapInArrow(gather, kind).repartition(buckets, "bucket").sortWithinPartitions("bucket")
        decided = staged(gathered.mapInArrow(decide, kind), "lm-decided")
        every = self.docs.select("block").distinct().select("block", F.lit(None).cast("binary").alias("data"))
        tasks = max(12, int(self.docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        staged(decided.select("block", "data").unionByName(every).repartition(tasks, "block").sortWithinPartitions("block").mapInArrow(write, "done int"), "lm-classes")
        dropped(self.docs.sparkSession, decided)
        freed(self.docs.sparkSession)


def exchange_all(corpus: Corpus, first: np.ndarray, counts: np.ndarray, sweeps: int) -> tuple[str, np.ndarray]:
    """The folder with the classes of all words, and the table of class bigrams."""
    spark = corpus.docs.sparkSession
    member = np.eye(corpus.classes)[first]
    folder, table = None, member.T @ counts @ member
    for _ in range(max(1, sweeps)):
        to = fresh_path(spark, "lm-of")
        corpus.sweep(folder, first, table, to)
        new = corpus.table(to)
        if folder is not None and likelihood(new) <= likelihood(table):
            break  # words that moved together were worse off
        folder, table = to, new
    return folder, table


def score_documents(docs: DataFrame, units: int = UNITS, classes: int = CLASSES, sweeps: int = SWEEPS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs has doc_id, text and flag (true: train on it). Returns doc_id, flag, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    spark = docs.sparkSession
    split = staged(split_blocks(docs, block_words), "lm-blocks")
    listed = split.where("word IS NOT NULL").select("block", "number", "word", "weight")
    counts = staged(listed.groupBy("word").agg(F.sum("weight").alias("c")).where("c > 0"), "lm-counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    top = [r["word"] for r in counts.where("word <> ''").orderBy(F.desc("c"), "word").limit(units).collect()]  # the words clustered on the driver
    known = spark.createDataFrame([(w, i) for i, w in enumerate(["", *top])], "word string, unit int")
    buckets = max(1, -(-v // BUCKET_WORDS))
    places = counts.withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(buckets)))
    places = places.withColumn("id", (F.col("bucket") + F.lit(buckets) * (F.row_number().over(W.partitionBy("bucket").orderBy("word")) - 1)).cast("long")).drop("bucket")
    places = staged(places.join(F.broadcast(known), "word", "left"), "lm-places")
    tables = fresh_path(spark, "lm-tables")
    told = listed.join(places, "word", "left").withColumns({"c": F.coalesce("c", F.lit(0)), "id": F.coalesce("id", F.lit(-1).cast("long")), "unit": F.coalesce("unit", F.lit(-1))})
    write_tables(told, ["c", "id", "unit"], tables, split.select("block").distinct().count())
    freed(spark)  # lets Spark drop shuffle files that nothing refers to any more
    docs_of = split.where("words IS NOT NULL").select("block", "doc_id", "flag", "words")
    matrix = bigram_counts(docs_of, tables, len(top) + 1)
    first = exchange(matrix, classes)
    folder, table = exchange_all(Corpus(docs_of, tables, buckets, classes), first, matrix, sweeps)
    kinds, singles = class_types(docs_of.select("block").distinct(), tables, folder, classes)
    rare = int(singles.argmax())  # the class of the unknown word
    mass = table.sum(1)
    share = (mass + 0.5) / (mass.sum() + 0.5 * classes)
    step = np.log10((table + PRIOR * share) / (table.sum(1, keepdims=True) + PRIOR))
    emit = np.log10(np.maximum(mass + 0.5 * (kinds + (np.arange(classes) == rare)), 0.5))
    model = spark.sparkContext.broadcast((step, emit))  # sizes fixed by the parameters
    norm = float(np.log10(n + 0.5 * (v + 1)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, emit = model.value
        at = c = of = log_c = None
        for batch in batches:
            out = []
            for block, words in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if block != at:
                    at, c = block, read_table(tables, block)["c"].to_numpy()
                    of = np.frombuffer(open_file(folder, block), np.uint8).astype(np.int64)
                    of = np.where(of == NONE, rare, of)
                    log_c = np.log10(c + 0.5)
                own = np.frombuffer(words, np.uint32)
                k = of[own]
                logs = float(log_c[own].sum())
                out.append((len(own), int((c[own] > 0).sum()), logs - len(own) * norm, logs - float(emit[k].sum()) + float(step[np.concatenate([k[-1:], k[:-1]]), k].sum())))
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), *(pa.array(x, t) for x, t in zip(cols, [pa.int64(), pa.int64(), pa.float64(), pa.float64()], strict=True))], names=["doc_id", "flag", "n_tokens", "n_known", "base_score", "score"])

    scored = docs_of.mapInArrow(score, "doc_id long, flag boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumns({"train_tokens": F.lit(int(n)).cast("long"), "perplexity": F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))})


def class_types(blocks: DataFrame, tables: str, folder: str, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """How many training words each class has, and how many of them occur once, from every block's words; a word counts by its place once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0).to_pylist():
                whole, of = read_table(tables, block), np.frombuffer(open_file(folder, block), np.uint8)
                place, c = whole["id"].to_numpy(), whole["c"].to_numpy()
                some = place >= 0
                yield pa.RecordBatch.from_arrays([pa.array(place[some]), pa.array(of[some].astype(np.int32)), pa.array(c[some] == 1)], names=["id", "of", "once"])

    parts = max(1, min(blocks.count(), 4096))
    words = blocks.repartition(parts, "block").mapInArrow(run, "id long, of int, once boolean").groupBy("id").agg(F.first("of").alias("of"), F.first("once").alias("once"))
    kinds, singles = np.zeros(classes), np.zeros(classes)
    for row in words.groupBy("of").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("once").cast("long")).alias("s")).collect():  # a row for each class
        kinds[row["of"]], singles[row["of"]] = row["n"], row["s"]
    return kinds, singles


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text"), (F.pmod(id_crc32(F.col("doc_id")), F.lit(5)) != 1).alias("flag"))
    return score_documents(docs).select("doc_id", (~F.col("flag")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
