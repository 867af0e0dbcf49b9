import base64
import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")

from agoraflow.llm import bpe, brown, decontaminate, divergence, extract, jaccard, pieces, repair, sharding, toxicity, warc  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, n long, slot string, score string"


def documents(spark, rows):
    """doc_id, text, lang and columns whose names clash with those of operators."""
    return spark.createDataFrame([(i, t, "en", 1, "s", "x") for i, t in rows], DOCS)


def random_texts(n, seed=1, low=1, high=120):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    return [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(low, high))) for _ in range(n)]


EDGES = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one"), (5, "one"), (None, "two words"), (6, "word " * 30_000), (7, "é ü 漢字 🙂 <|endoftext|>\x1c\x85\xa0  x\n\n\ny ")]


# ---- 1


def test_brown_base_and_fold(spark):
    rows = EDGES + [(100 + i, t) for i, t in enumerate(random_texts(60))]
    docs = spark.createDataFrame([(i, t, zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1) for i, t in rows], "doc_id long, text string, flag boolean")
    out = brown.score_documents(docs, units=30, classes=4, block_words=150).collect()
    assert len(out) == len(rows)
    counts = Counter()
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    for i, t in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1:
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), len(w := tokens(t)), sum(x in counts for x in w), round(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 3)) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 3)) for r in out) == want
    assert {r.train_tokens for r in out} == {n} and all(r.score < 0 for r in out)


def test_brown_exchange_finds_classes_and_raises_likelihood():
    rnd, units = np.random.default_rng(1), 40
    counts = np.zeros((units, units), np.int64)
    at = 0
    for _ in range(20_000):  # two kinds of units that follow each other in turn
        to = int(rnd.integers(20)) + (0 if at >= 20 else 20)
        counts[at, to] += 1
        at = to
    of = brown.exchange(counts, classes=4)
    assert not set(of[:20]) & set(of[20:])

    def likelihood(of):
        member = np.eye(4)[of]
        table = member.T @ counts @ member
        f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
        return f(table) - f(table.sum(0)) - f(table.sum(1))

    assert likelihood(of) > likelihood(np.arange(units) % 4) + 1000


def test_brown_classes_words_that_are_rare_and_end_alike(spark):
    rnd = random.Random(11)
    kinds = [[f"{k}{i:03}zz" for i in range(300)] for k in "ab"]  # all of one ending, and most of them none of the units clustered on the driver
    texts = [" ".join(rnd.choice(kinds[i % 2]) for i in range(start, start + 60)) for start in (rnd.randrange(2) for _ in range(300))]
    docs = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)], "doc_id long, text string, flag boolean")
    out = brown.score_documents(docs, units=60, classes=4, sweeps=4, block_words=400).collect()
    # the kind of a word tells the kind of the next, so half of its words: log10(2) a word
    assert sum(r.score - r.base_score for r in out) > 0.2 * sum(r.n_tokens for r in out)


def test_brown_best_classes_agree_with_the_likelihood():
    rnd, classes, units = np.random.default_rng(5), 4, 30
    counts = rnd.poisson(8, (units, units)) * rnd.integers(0, 2, (units, units))
    of = rnd.integers(0, classes, units)
    member = np.eye(classes)[of]
    got = brown.best_classes(counts @ member, (member.T @ counts).T, counts.diagonal().astype(float), of, member.T @ counts @ member)
    for u in range(units):
        def score(c, u=u):
            m = np.eye(classes)[np.where(np.arange(units) == u, c, of)]
            return brown.likelihood(m.T @ counts @ m)

        assert score(got[u]) >= max(map(score, range(classes))) - 1e-6


def test_brown_scores_are_those_of_the_model_and_sum_to_one(spark):
    texts = random_texts(40, 21, 5, 60)
    known = sorted({w for t in texts for w in t.split()})
    # each word after each of two contexts, and a word never seen: differences of scores are single probabilities
    rows = [(i, t, True) for i, t in enumerate(texts)] + [(1000 + i, f"{known[3]} {w}", False) for i, w in enumerate([*known, "neverseen"])] + [(999, known[3], False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, flag boolean")
    out = {r.doc_id: r for r in brown.score_documents(docs, units=40, classes=5, block_words=120).collect()}
    counts = Counter(w for t in texts for w in [*t.split(), ""])
    # P(w | c) * P(end | w) summed over w, plus P(end | c), is P of all texts of at most one more word; by the class of w, P(w) is c + 0.5 over a class's sum
    ratio = {}
    for i, w in enumerate(known):
        ratio.setdefault(round(out[1000 + i].score - math.log10(counts[w] + 0.5), 9), []).append(w)
    assert 1 < len(ratio) <= 5  # words of one class differ by their counts alone
    assert sorted(w for ws in ratio.values() for w in ws) == known


def test_brown_model_sums_to_one(spark, monkeypatch):
    held = {}
    log10 = np.log10
    texts = random_texts(40, 22, 5, 60)
    docs = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)], "doc_id long, text string, flag boolean")
    types = brown.class_types
    monkeypatch.setattr(brown, "class_types", lambda *a: held.setdefault("types", types(*a)))
    every = brown.exchange_all
    monkeypatch.setattr(brown, "exchange_all", lambda *a: held.setdefault("all", every(*a)))
    out = brown.score_documents(docs, units=40, classes=5, block_words=120).collect()
    (kinds, singles), (_, table) = held["types"], held["all"]
    counts = Counter(w for t in texts for w in [*t.split(), ""])
    assert kinds.sum() == len(counts) and singles.sum() == sum(c == 1 for c in counts.values())
    assert table.sum() == sum(counts.values()) and (table.sum(0) == table.sum(1)).all()
    mass = table.sum(1)
    extra = np.arange(5) == singles.argmax()
    emitted = (mass + 0.5 * kinds + 0.5 * extra) / (mass + 0.5 * (kinds + extra))
    share = (mass + 0.5) / (mass.sum() + 2.5)
    step = (table + brown.PRIOR * share) / (mass[:, None] + brown.PRIOR)
    assert np.allclose((step * emitted).sum(1), 1) and sum(r.score for r in out) > sum(r.base_score for r in out) - 1e-6 and log10 is np.log10


def test_brown_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, flag boolean")
    assert brown.score_documents(docs).count() == 0
    only_held = spark.createDataFrame([(1, "a b", False)], "doc_id long, text string, flag boolean")
    (row,) = brown.score_documents(only_held).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)


# ---- 2


def test_extract_cases():
    page = '<body><header><h1>Site</h1></header><div id="menu"><a href=x>Home</a></div><div class="content"><h2>Title</h2><p>A long paragraph of main text that goes on &amp; on.<p>Another <i>para</i>graph<br>with enough text.</div><div class="side-bar"><ul><li><a>link</a></ul></div><div id=comments><p>a reader says very much in many words here and there</div><form><label>Name</label></form><script>if (a < b) "<p>"</script></body>'
    assert extract.extract(page) == "Title A long paragraph of main text that goes on & on. Another paragraph with enough text."
    assert [extract.extract(x) for x in (None, "", "<nav>x</nav>", "plain  text", "<!-- never ends <p>x", "<p>a<script>x", '<div><a href="a>b">t</a></div>')] == ["", "", "", "plain text", "", "a", "t"]
    long = "<body><article>" + "<p>words and words</p>" * 5000 + "</article></body>"
    assert extract.extract(long) == " ".join(["words and words"] * 5000)


def test_extract_by_density_alone(monkeypatch):
    links = "<div><ul>" + "".join(f"<li><a href=/{i}>Section {i}</a></li>" for i in range(12)) + "</ul></div>"
    text = "A long paragraph of main text that goes on and on, with enough words in it to be the text of the page."
    main = "<div>" + f"<p>{text}</p>" * 4 + "</div>"
    for page in (links + main, main + links, f"<div>{links}<div>{main}</div></div>", f"<table><tr><td>{links}</td><td>{main}</td></tr></table>"):  # nothing is named
        assert extract.extract(f"<body>{page}</body>") == " ".join([text] * 4), page
    named = f"<body><nav>{links}</nav>{main}<footer>Some words of a footer</footer></body>"
    assert extract.extract(named) == " ".join([text] * 4)
    monkeypatch.setattr(extract, "LIGHT", 1.0)  # names count nothing: density alone leaves out the links and not the footer's words
    assert "Section" not in extract.extract(named)
    monkeypatch.setattr(extract.Page, "marked", lambda self, gone, light, texts: [not x for x in gone])
    assert "Section 3" in extract.extract(named) and "footer" in extract.extract(named)


def test_extract_keeps_what_class_words_only_touch():
    text = "A long paragraph of main text that goes on and on, with enough words in it to be the text of the page."
    body = f"<p>{text}</p><p>{text}</p>"
    want = f"{text} {text}"
    for page in (f"<article class='post comments-open'>{body}</article>", f"<div class='wrap comments-open'><article>{body}</article></div>", f"<div class='container no-sidebar'>{body}</div>", f"<div class='share-enabled'>{body}</div>", f"<div id=comments-wrap><main>{body}</main></div>", f"<div class=sidebar-layout>{body}</div>"):
        assert extract.extract(f"<body>{page}</body>") == want, page
    remarks = f"<div class=comments><article class=comment-body>{body * 3}</article></div>"
    assert extract.extract(f"<body><article>{body}</article>{remarks}</body>") == want


def test_extract_table(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a"), (None, None, None), (1, "u", "<p>a")], "page_id long, url string, html string")
    assert sorted(map(str, extract.extract_pages(pages).collect())) == sorted(map(str, [(r := f"Row(page_id=1, url='u', text='a', n_chars=1)"), r, "Row(page_id=None, url=None, text='', n_chars=0)"]))
    assert extract.extract_pages(pages.limit(0)).count() == 0


# ---- 3


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list(" \n\t\r\x1c\x85\xa0　ab'stvelmdr1,_²漢🙂")), max_size=30), max_size=5))
def test_pieces_are_those_of_the_pattern(texts):
    import regex

    find = regex.compile(public_tokenizers.PATTERN).findall
    s = pieces.split(texts)
    words = [s.distinct[k] for k in s.which]
    assert s.counts.tolist() == [len(find(t)) for t in texts]
    assert words == [w for t in texts for w in find(t)] and len(set(s.distinct)) == len(s.distinct)


def test_pieces_of_a_long_text_in_parts():
    text = "word, and 12  more\n\n" * 500 + "x" * 3000 + " end"
    parts = pieces.cut(text, 100)
    assert "".join(parts) == text and len(parts) > 50
    whole = pieces.split([text])
    cut = [w for p in parts for s in [pieces.split([p])] for w in (s.distinct[k] for k in s.which)]
    assert cut == [whole.distinct[k] for k in whole.which]
    assert [g for _, _, g in pieces.slices(["a" * 9, None, "b" * 3, "c"], 10)] == [["a" * 9, ""], ["b" * 3, "c"]]


def test_pieces_with_equal_hashes_stay_apart(monkeypatch):
    monkeypatch.setattr(pieces, "_weights", lambda: (np.zeros(0x110000, np.uint64), np.ones(256, np.uint64)))
    s = pieces.split(["ab cd ab", " ef ab"])
    assert [s.distinct[k] for k in s.which] == ["ab", " cd", " ab", " ef", " ab"]


def test_bpe_matches_library_and_decodes(spark):
    import tiktoken

    ranks = bpe.load_ranks(public_tokenizers.path(bpe.RANKS))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = EDGES + [(200 + i, t.title() + ", it's 12345!!") for i, t in enumerate(random_texts(30, 3))] + [(300, "ab" * 400 + " " + "x" * 700)]
    out = bpe.digests(bpe.encode_documents(documents(spark, rows), block_words=100)).collect()
    want = sorted((str(i), len(e := enc.encode_ordinary(t or "")), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out) == want
    assert bpe.encode_documents(documents(spark, [])).count() == 0


def test_bpe_plan_text_is_small(spark):
    from pyspark.sql import functions as F

    ranks = bpe.load_ranks(public_tokenizers.path(bpe.RANKS))
    words = spark.createDataFrame([([*b" the"],)], "word array<int>").withColumn("pairs", bpe.pair_map(ranks))
    encoded = words.select(bpe.encoded_word(F.col("word"), F.col("pairs"), ranks).alias("ids"))
    assert [r.ids for r in encoded.collect()] == [[ranks[b" the"]]]
    # a literal map took 10 MB of it; the driver keeps the text of every plan
    assert len(encoded._jdf.queryExecution().toString()) < 100_000
    # the map stays in the expression, no row carries it
    assert "pairs" not in encoded._jdf.queryExecution().optimizedPlan().toString().split("\n")[0]


def test_short_numbers():
    edges = [x + d for x in (*bpe.LEAST.tolist(), 255, 1 << 16, 1 << 24) for d in (-1, 0, 1) if x + d >= 0] + [(1 << 32) - 1]
    numbers = np.array([*edges, *np.random.default_rng(5).integers(0, 1 << 32, 500), *edges[::-1]], np.uint32)
    assert (bpe.from_short(*bpe.short(numbers)) == numbers).all() and len(bpe.from_short(*bpe.short(numbers[:0]))) == 0
    small = np.minimum(np.random.default_rng(6).zipf(1.3, 20_000), 250_000).astype(np.uint32)
    first, others = bpe.short(small)
    whole = len(zlib.compress(bpe.planes(small.tobytes())))
    assert (bpe.from_short(first, others) == small).all() and len(zlib.compress(first)) + len(zlib.compress(others)) < 0.95 * whole


# ---- 4


def test_sharding_law(spark):
    rows = EDGES + [(i, t) for i, t in enumerate(random_texts(400, 5))]
    out = sharding.shard_documents(documents(spark, rows), shards=4).collect()
    assert len(out) == len(rows)
    loads = Counter()
    for r in out:
        loads[r.shard] += r["size"]
    big = max(r["size"] for r in out)
    assert max(loads.values()) - min(loads.values()) <= big
    for s in range(4):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in out) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sharding.shard_documents(documents(spark, [])).count() == 0


def test_sharding_map_versions(spark, tmp_path):
    sizes = {s: 1 + s % 7 for s in range(sharding.SLOTS)}
    owner = sharding.deal(sizes, 16)
    path = f"file://{tmp_path}/map"
    sharding.store_map(spark, path, 1, owner)
    more = sharding.rebalance(owner, sizes, 17)
    sharding.store_map(spark, path, 2, more)
    moved = [(s, b) for s, (a, b) in enumerate(zip(owner, more, strict=True)) if a != b]
    assert sum(sizes[s] for s, _ in moved) <= 1.1 * sum(sizes.values()) / 17 and sum(b == 16 for _, b in moved) >= 0.9 * len(moved)
    load = Counter()
    for s, o in enumerate(more):
        load[o] += sizes[s]
    assert max(load.values()) - min(load.values()) <= 7
    latest = {r.virtual_slot: r.shard for r in sharding.load_map(spark, path).collect()}
    assert [latest[s] for s in range(sharding.SLOTS)] == more
    with pytest.raises(Exception, match="(?i)exists"):
        sharding.store_map(spark, path, 2, owner)


# ---- 5


def _base(text):
    text = text or ""
    w = WORD.findall(text)
    n, at = len(w), {}
    for i in range(n - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = n < 50 or 100 * len(covered) > 50 * n
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_divergence_base(spark):
    rnd = random.Random(2)
    texts = ["\n".join(" ".join(rnd.choice("ab cd e# f|".split()) for _ in range(rnd.randint(0, 12))) for _ in range(rnd.randint(1, 12))) for _ in range(40)]
    rows = EDGES + [(300 + i, t) for i, t in enumerate(texts)]
    out = divergence.judge_documents(documents(spark, rows)).collect()
    got = sorted((str(r.doc_id), r._q_n_words, r._q_word_chars, r._q_n_symbols, r._q_n_dup_lines, r._q_n_repeat_words, r._q_base_failed) for r in out)
    assert got == sorted((str(i), *_base(t)) for i, t in rows)


def _distance(p, q):
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    part = lambda x: sum(a * math.log2(a / c) for a, c in zip(x, m, strict=True) if a > 0)
    return math.sqrt(max(0.0, (part(p) + part(q)) / 2))


def test_divergence_distances_and_verdicts_by_brute_force(spark):
    import regex

    rnd = random.Random(31)
    words = [*divergence.COMMON_WORDS, *(f"w{i}x" for i in range(200)), "$$$", "12345", "LOUD"]
    rows = [(i, " ".join(rnd.choice(words[: 60 + 4 * i]) for _ in range(40 + 5 * i)) + "!", rnd.choice(["en", "en", "de", None])) for i in range(45)] + [(98, "ZZ 99 " * 60 + " ".join(f"{k}#" for k in range(90)), "xx"), (99, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    figures = {}
    for i, t, lang in rows:
        w = WORD.findall(t or "")
        n = len(t or "")
        count = lambda pattern, t=t: len(regex.findall(pattern, t or ""))
        upper, digit, space = count(r"\p{Lu}"), count(r"\p{N}"), n - sum(map(len, w))
        mark = sum(c in ".,;:!?'\"()-" for c in t or "")
        symbol = count(r"[^\p{L}\p{M}\p{N}\x20\x09-\x0D.,;:!?'\"()\-]")
        chars = [x / max(n, 1) for x in (n - upper - digit - space - mark - symbol, upper, digit, space, mark, symbol)]
        found = Counter(x.lower() for x in w)
        common = [found[c] for c in divergence.COMMON_WORDS]
        figures[i] = (chars, [x / max(len(w), 1) for x in [*common, len(w) - sum(common)]], lang, _base(t), n)
    good = [f for f in figures.values() if not f[3][5]]
    mean = lambda fs, k: [sum(x) / max(len(fs), 1) for x in zip(*(f[k] for f in fs), strict=True)]
    for r in divergence.judge_documents(docs).collect():
        chars, common, lang, base, n = figures[r.doc_id]
        own = [f for f in good if f[2] == lang]
        d = []
        for k, x in ((0, chars), (1, common)):
            every, mine = mean(good, k), mean(own, k) if own else [0.0] * len(x)
            d.append(_distance(x, [(len(own) * a + divergence.REF_DOCS * b) / (len(own) + divergence.REF_DOCS) for a, b in zip(mine, every, strict=True)]))
        assert (round(r._q_char_distance, 6), round(r._q_word_distance, 6)) == (round(d[0], 6), round(d[1], 6)), r.doc_id
        far = d[0] > divergence.MAX_CHAR_DISTANCE or (d[0] > divergence.LEAST_CHAR_DISTANCE and d[1] ** 2 > divergence.WORD_DISTANCE**2 + divergence.WORD_NOISE / max(base[0], 1))
        assert r._q_kept == (not base[5] and (n < divergence.MIN_CHARS or base[0] < divergence.MIN_WORDS or not far)), r.doc_id


def test_clashing_columns_pass_through(spark):
    words = "the of and to in a house tree road river walked slowly under bright evening light".split()
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice(words) + rnd.choice(["", "", "x", "y", "z"]) for _ in range(120)) + ".", "en", i, True, "s", 0.5) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, id int, _q_kept boolean, _q_text string, _t_score double")
    assert sorted(map(tuple, divergence.keep_good(docs).collect())) == rows
    model = toxicity.fit(toxicity.labelled_sample(docs, spark.createDataFrame([(1, 0, 5)], "doc_id long, toxic int, id int")))
    assert sorted(map(tuple, toxicity.keep_ordinary(docs.withColumnRenamed("_q_text", "score"), model).collect())) == rows
    keyed = docs.withColumnRenamed("id", "_d_key").withColumnRenamed("_q_text", "key")
    bench = spark.createDataFrame([(1, "nothing of this is in there at all so it stays")], "item_id long, text string")
    assert sorted(map(tuple, decontaminate.drop_leaks(keyed, bench).collect())) == rows


def test_divergence_rejects_far_texts_and_keeps_columns(spark):
    rnd = random.Random(4)
    words = "the of and to in a house tree road river walked slowly under bright evening light".split()
    good = [(i, " ".join(rnd.choice(words) + str(rnd.choice(["", "", "x", "y", "z"])) for _ in range(120)) + ".") for i in range(40)]
    bad = [(100 + i, " ".join(f"{rnd.randint(0, 10**6)}$$$ ###{rnd.randint(0, 10**6)}" for _ in range(120))) for i in range(3)]
    docs = documents(spark, good + bad)
    kept = divergence.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == list(range(40))
    assert divergence.keep_good(documents(spark, [])).count() == 0


def test_divergence_stages_each_text_once(spark, monkeypatch):
    made, write = [], divergence.staged

    def noted(df, name):
        made.append((name, write(df, name)))
        return made[-1][1]

    monkeypatch.setattr(divergence, "staged", noted)
    text = "a passage that no other column holds " * 20
    assert divergence.keep_good(documents(spark, [(1, text), (2, text)])).columns == documents(spark, []).columns
    (figures,) = (df for name, df in made if name == "figures")
    assert sum(v == text for v in figures.first()) == 1


# ---- 6


def test_toxicity_separates(spark):
    rnd = random.Random(6)
    syllables = "an er th in on re at en ou st".split()
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4)))
    bad = ["worthless", "disgusting", "horrible"]

    def text(toxic):
        w = [word() for _ in range(90)]
        for _ in range(6 * toxic):
            w[rnd.randrange(90)] = rnd.choice(bad)
        return " ".join(w)

    rows = [(i, text(i % 4 == 0)) for i in range(400)]
    docs = documents(spark, rows + [(None, None), (900, "")])
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(200)] + [(None, 1, 1), (3, None, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.fit(toxicity.labelled_sample(docs, labels))
    out = {r.doc_id: r._t_score for r in toxicity.scored(docs, model).collect()}
    assert len(out) == 402 and all(0 <= s <= 1 for s in out.values())
    held = [(out[i], i % 4 == 0) for i in range(200, 400)]
    right = sum((s >= 0.3) == y for s, y in held)
    assert right >= 190
    kept = toxicity.keep_ordinary(docs, model)
    assert kept.columns == docs.columns


def test_toxicity_without_both_labels(spark):
    docs = documents(spark, [(1, "a"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(toxicity.labelled_sample(docs, none))
    assert [r._t_score for r in toxicity.scored(docs, model).collect()] == [0.0, 0.0]
    assert toxicity.scored(documents(spark, []), model).count() == 0


# ---- 7


def _archive(n):
    parts = [warc.page_record(i, 1, f"http://x/{i}", f"<p>{'text ' * i}{i}", True, i, warc.sha1_base32(f"<p>{'text ' * i}{i}".encode()), len(f"<p>{'text ' * i}{i}")) for i in range(n)]
    return parts


class Bytes:
    def __init__(self, data):
        self.data, self.at = data, 0

    def read(self, n):
        out = self.data[self.at : self.at + n]
        self.at += len(out)
        return out


@pytest.mark.parametrize("zipped", [True, False])
def test_salvage(zipped, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 64)
    raw = _archive(30)
    members = [warc.gzip_member(x) if zipped else x for x in raw]
    gaps = []
    assert [r.headers["warc-record-id"] for r in warc.read_archive(Bytes(b"".join(members)), lambda *g: gaps.append(g))] == [f"<urn:page:{i}:1>" for i in range(30)] and not gaps
    hurt = list(members)
    hurt[5] = hurt[5][:40] + b"\0\0\0" + hurt[5][43:]
    hurt[11] = hurt[11][:-20]
    hurt[20] = b"junk WARC/1.0 \x1f\x8b\x08 more junk" + hurt[20]
    hurt[29] = hurt[29][:25]
    got = [r.headers["warc-record-id"] for r in warc.read_archive(Bytes(b"".join(hurt)), lambda *g: gaps.append(g))]
    assert got == [f"<urn:page:{i}:1>" for i in range(30) if i not in (5, 11, 29)]
    starts = np.cumsum([0] + [len(x) for x in hurt])
    assert [(a, b) for a, b, _ in gaps] == [(starts[5], starts[6]), (starts[11], starts[12]), (starts[20], starts[20] + len(hurt[20]) - len(members[20])), (starts[29], starts[30])]


def test_warc_round_trip(spark, tmp_path):
    rows = [(3, "u", "same"), (1, None, "same"), (2, "u\n", None), (5, "u", ""), (None, "u", "same"), (1, None, "same"), (7, "u", "é" * 1000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    out = warc.read_archives(warc.write_archives(pages, f"file://{tmp_path}/a", file_bytes=300)).collect()
    assert {r.kind for r in out} == {"record"} and len(out) == len(rows)
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out)
    d = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = [("1", 4, d("same"), "response", None), ("1", 4, d("same"), "revisit", 1), ("3", 4, d("same"), "revisit", 1), ("None", 4, d("same"), "revisit", 1), ("2", 0, d(""), "response", None), ("5", 0, d(""), "revisit", 2), ("7", 2000, d("é" * 1000), "response", None)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.read_archives(warc.write_archives(pages.limit(0), f"file://{tmp_path}/b")).count() == 0


# ---- 8


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(3, 9), max_size=40), min_size=1, max_size=8))
def test_repair_round_trip(docs):
    docs = [[*d, 2] for d in docs]
    ids, counts = np.array(sum(docs, []), np.uint32), np.array([len(d) for d in docs])
    ids = np.tile(ids, 6)
    counts = np.tile(counts, 6)
    shard = repair.Shard(repair.pack(list(range(len(counts))), ids, counts, 10))
    assert [shard.document(i).tolist() for i in range(len(counts))] == docs * 6
    a, b = len(ids) // 3, len(ids) // 2
    assert shard.ids(a, b).tolist() == ids[a:b].tolist()


def test_repair_compresses():
    ids = np.tile(np.arange(10, 30, dtype=np.uint32), 500)
    seq, ends, rules, lengths = repair.compress(ids, np.array([len(ids)]), 50)
    assert len(seq) < len(ids) / 8 and len(rules) == len(lengths) and repair.expand(seq, rules, 50).tolist() == ids.tolist()
    with pytest.raises(ValueError):
        repair.Shard(b"not a shard" * 10)


def test_repair_ends_when_no_pair_recurs():
    rnd = np.random.default_rng(12)
    ids = np.minimum(rnd.zipf(1.3, 20_000), 400).astype(np.uint32) + 2
    ends = np.cumsum(np.bincount(rnd.integers(0, 300, 20_000), minlength=300))
    seq, cut, rules, lengths = repair.compress(ids, ends, 500)
    within = set(range(len(seq) - 1)) - {int(c) - 1 for c in cut}
    assert max(Counter((seq[i], seq[i + 1]) for i in within).values()) < repair.LEAST_COUNT
    assert repair.expand(seq, rules, 500).tolist() == ids.tolist() and len(rules) == len(lengths)
    assert [len(repair.expand(seq[a:b], rules, 500)) for a, b in zip([0, *cut], cut)] == np.diff(ends, prepend=0).tolist()


def test_repair_documents(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(repair.TOKENIZER))  # with its defaults: EDGES hold the marker of an added token
    rows = EDGES + [(200 + i, x) for i, x in enumerate(random_texts(50, 8))]
    files = repair.with_starts(repair.write_shards(documents(spark, rows), f"file://{tmp_path}/s", shard_ids=500))
    out = sorted(repair.read_shards(files).collect(), key=lambda r: r.start)
    assert [r.doc_id is not None for r in out] == sorted(r.doc_id is not None for r in out)
    ids = [r.doc_id for r in out if r.doc_id is not None]
    assert ids == sorted(ids) and len(out) == len(rows)
    start = 0
    for r in out:
        assert r.start == start
        start += r.n_tokens
    want = sorted((str(i), [*t.encode(x or "", add_special_tokens=False).ids, 2]) for i, x in rows)
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in out) == want
    empty = repair.with_starts(repair.write_shards(documents(spark, []), f"file://{tmp_path}/e"))
    assert repair.read_shards(empty).count() == 0


# ---- 9


def test_decontaminate(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    items = [[word() for _ in range(n)] for n in (30, 15, 60, 5)]
    bench = spark.createDataFrame([(i, " ".join(w), 1) for i, w in enumerate(items)] + [(9, None, 1), (10, "", 1)], "item_id long, text string, doc_id int")
    filler = lambda n: [word() for _ in range(n)]
    swapped = [w if i % 6 else word() for i, w in enumerate(items[0])]
    rows = [
        (1, " ".join(filler(40) + items[0] + filler(40))), (2, " ".join(filler(20) + swapped + filler(5))), (3, " ".join(x.upper() + "," for x in items[1])),
        (4, " ".join(filler(200))), (5, " ".join(items[2][:35])), (6, " ".join(filler(9) + items[3])), (7, " ".join(items[0][:6] + filler(50))), (8, None), (9, ""), (1, " ".join(filler(40) + items[1])),
    ]
    out = decontaminate.leaks(documents(spark, rows), bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in out) == [(1, 0), (1, 1), (2, 0), (3, 1), (5, 2)]
    kept = decontaminate.drop_leaks(documents(spark, rows), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [4, 6, 7, 8, 9] and kept.columns == documents(spark, []).columns
    assert decontaminate.leaks(documents(spark, []), bench).count() == decontaminate.leaks(documents(spark, rows), bench.limit(0)).count() == 0


def test_decontaminate_short_items_are_found_whole(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven"), (2, "Alpha, beta gamma!"), (3, "p q r s t u v w x"), (4, "!!!")], "item_id long, text string")
    rows = [(1, "so one two three four five six seven then"), (2, "one two three four five six and seven"), (3, "alpha beta gamma"), (4, "alpha beta gamma delta"), (5, "P q r s t u v w x"), (6, "!"), (7, "a one two three four five six seven one two three four five six seven")]
    out = decontaminate.leaks(documents(spark, rows), bench).collect()
    assert sorted((r.doc_id, r.item_id, r.item_words) for r in out) == [(1, 1, 7), (3, 2, 3), (5, 3, 9), (7, 1, 7)]


def test_decontaminate_agrees_with_brute_force(spark):
    rnd = random.Random(19)
    vocabulary = [f"v{i}" for i in range(300)]
    items = [[rnd.choice(vocabulary) for _ in range(rnd.randint(10, 60))] for _ in range(8)]
    rows = []
    for i in range(80):
        w = [rnd.choice(vocabulary) for _ in range(rnd.randint(20, 80))]
        if i % 2:
            item = rnd.choice(items)
            n = min(len(item), rnd.randint(3, 30))
            at, k = rnd.randrange(len(item) - n + 1), rnd.randrange(len(w))
            w[k:k] = item[at : at + n]
        rows.append((i, " ".join(w)))

    def run(a, b):  # the longest run of equal words
        best, last = 0, {}
        for x in range(len(a)):
            now = {}
            for y in range(len(b)):
                if a[x] == b[y]:
                    now[y] = last.get(y - 1, 0) + 1
                    best = max(best, now[y])
            last = now
        return best

    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(documents(spark, rows), bench).collect()}
    longest = {(i, k): run(t.split(), item) for i, t in rows for k, item in enumerate(items)}
    assert {p for p, n in longest.items() if n >= 10} <= got and not {p for p, n in longest.items() if n < 6} & got


def test_decontaminate_short_quotes_of_long_items(spark):
    rnd = random.Random(10)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    item = [word() for _ in range(80)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    rows = [(n, " ".join([word() for _ in range(30)] + item[20 : 20 + n] + [word() for _ in range(30)])) for n in (6, 8, 10, 13, 25, 29, 30)]
    assert sorted((r.doc_id, r.matched_words) for r in decontaminate.leaks(documents(spark, rows), bench).collect()) == [(n, n) for n in (10, 13, 25, 29, 30)]


# ---- 10


def _components(rows):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return sorted((str(i), len(s), str(low.get(find(k)) if s else i)) for k, (i, s) in enumerate(sets))


def near_copies(n, seed):
    rnd = random.Random(seed)
    base = random_texts(12, seed, 20, 150)
    out = []
    for i in range(n):
        w = rnd.choice(base).split()
        for _ in range(rnd.choice([0, 0, 1, 2, 4, 8])):
            w[rnd.randrange(len(w))] = f"n{rnd.randrange(50)}"
        out.append((i, ("common words that every text begins with here " if rnd.random() < 0.3 else "") + " ".join(w)))
    return out


@pytest.mark.parametrize(("batch", "tile"), [(10000, 2048), (3, 4)])
def test_jaccard_links(spark, monkeypatch, batch, tile):
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(jaccard, "LARGE", 1 if tile == 4 else 64)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        rows = EDGES + [(20 + i, t) for i, t in near_copies(150, 7)]
        got = jaccard.link_documents(documents(spark, rows)).collect()
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == _components(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10000)


def test_jaccard_links_come_out_of_trees(spark, monkeypatch):
    found, rounds = jaccard.traversed, []

    def counted(rows, full, near=False):
        out = found(rows, full, near)
        rounds.append((full, out.count()))
        return out

    monkeypatch.setattr(jaccard, "traversed", counted)
    docs = documents(spark, [(i, t) for i, t in near_copies(120, 13)])
    linked = jaccard.link_documents(docs).select("component_id").distinct().count()
    assert [full for full, _ in rounds][:1] == [False] and all(full for full, _ in rounds[1:]) and sum(n for _, n in rounds) >= 120 - linked - 40 and linked < 100
    monkeypatch.setattr(jaccard, "traversed", lambda rows, full, near=False: found(rows.limit(0), full, near))
    texts = docs.select("text").distinct().count()
    assert jaccard.link_documents(docs).select("component_id").distinct().count() >= texts - 5  # without trees only equal sets are joined


def test_jaccard_bitmaps_go_only_where_a_link_is_possible(spark, monkeypatch):
    """Every row that is traversed from roots has a partner by size, class and larger roots; texts, bitmaps and members go when they are used up."""
    found, given, made = jaccard.traversed, [], []
    write = jaccard.staged

    def taken(rows, full, near=False):
        given.append((full, rows.drop("bits").collect()))
        return found(rows, full, near)

    def noted(df, name):
        made.append((name, write(df, name)))
        return made[-1][1]

    monkeypatch.setattr(jaccard, "traversed", taken)
    monkeypatch.setattr(jaccard, "staged", noted)
    monkeypatch.setattr(jaccard, "TILE", 16)
    jaccard.link_documents(documents(spark, near_copies(80, 17)))
    assert given[0][1] and not given[0][0]
    for full, some in given[1:]:
        trees = {}
        for r in some:
            trees.setdefault((r.h, r.t, r.u), []).append(r)
        for own in trees.values():
            for r in own:
                assert any(r.label != o.label and 100 * min(r.n, o.n) >= 75 * max(r.n, o.n) and not set(r.above) & set(o.above) for o in own)
    gone = {n for n, df in made if n in ("texts", "meetings", "roots", "signatures", "members") and not os.path.exists(df.inputFiles()[0].removeprefix("file://"))}
    assert gone == {"texts", "meetings", "roots", "signatures", "members"}


def test_promising_keeps_what_can_link(spark):
    """By brute force, in groups of one tile and of two, small and large ones."""
    rnd = random.Random(23)
    rows = [(h, 0, h % 2, rnd.randrange(1 + h % 2), 1000 * h + k, rnd.randrange(20, 60), rnd.randrange(4), rnd.sample(range(9), rnd.randrange(4))) for h in range(60) for k in range(rnd.choice([1, 2, 3, 9]) if h else 300)]
    got = jaccard.promising(spark.createDataFrame(rows, "h long, t int, u int, tile int, node long, n int, label long, above array<long>").repartition(5)).collect()

    def may(a, b):
        return a[:3] == b[:3] and a[6] != b[6] and 100 * min(a[5], b[5]) >= 75 * max(a[5], b[5]) and not set(a[7]) & set(b[7])

    want = [r for r in rows if not r[0] or any(may(r, o) for o in rows if o is not r)]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) < len(rows)


def test_shingles_are_those_of_the_words():
    texts = ["A b\x0bc D e f", "a B c d E f", "", None, " x ", "é É ü", "a b c d e " * 3, "w" * 300 + " q"]
    sets = jaccard.shingle_sets(texts)
    words = [(t or "").encode().lower().split() for t in texts]
    want = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    assert [len(s) for s in sets] == [len(w) for w in want] and all((np.diff(s.astype(object)) > 0).all() for s in sets)
    assert [[len(np.intersect1d(a, b)) for a in sets] for b in sets] == [[len(a & b) for a in want] for b in want]


def test_jaccard_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c", 5, "x"), (2, "a b c", 6, "y")], "doc_id long, text string, mark int, _mark string")
    assert [tuple(r) for r in jaccard.keep_one(docs).collect()] == [(1, "a b c", 5, "x")]


def test_jaccard_keeps_one(spark):
    rows = [(5, "a b c d e f"), (3, "A b c d e f"), (3, "A b c d e f"), (7, "x y"), (None, "x y"), (8, ""), (8, ""), (9, None), (10, "p q r s t u v")]
    kept = jaccard.keep_one(documents(spark, rows))
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [3, 7, 8, 8, 9, 10])) and kept.columns == documents(spark, []).columns
    assert jaccard.keep_one(documents(spark, [])).count() == 0


def test_signature_tree_loses_no_pair():
    rnd = np.random.default_rng(3)
    sets = []
    for _ in range(40):
        base = rnd.integers(0, 1 << 63, rnd.integers(3, 300)).astype(np.uint64)
        for _ in range(rnd.integers(1, 8)):
            keep = base[rnd.random(len(base)) > rnd.choice([0, 0.05, 0.1, 0.3])]
            sets.append(np.unique(keep if len(keep) else base))
    size = np.array([len(s) for s in sets])
    found = set()
    for i, j in jaccard.tree_pairs(size, [jaccard.bitmap(s, jaccard.bit_count(len(s))) for s in sets], np.arange(len(sets))):
        found |= {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    for a in range(len(sets)):
        for b in range(a):
            if len(np.intersect1d(sets[a], sets[b])) >= jaccard.needed(len(sets[a]), len(sets[b])):
                assert (b, a) in found
    assert len(found) < len(sets) ** 2 / 8


def test_signature_trees_tell_a_pair_once():
    """In a family whose sets share many roots a pair comes out of its largest root's tree, and none is lost."""
    rnd = np.random.default_rng(5)
    base = rnd.integers(0, 1 << 63, 200).astype(np.uint64)
    sets = [np.unique(np.where(rnd.random(200) < 0.1, rnd.integers(0, 1 << 63, 200).astype(np.uint64), base)) for _ in range(60)]
    nodes = {int(h): [k for k, s in enumerate(sets) if h in s] for h in base[:60]}
    order = sorted(nodes, key=lambda h: (len(nodes[h]), h), reverse=True)
    tops = [[h for h in order if k in nodes[h]][: jaccard.KNOWN] for k in range(len(sets))]
    size = np.array([len(s) for s in sets])
    bits = [jaccard.bitmap(s, jaccard.bit_count(len(s))) for s in sets]
    told = Counter()
    for at, h in enumerate(order):
        own = np.array(nodes[h])
        larger = [[x for x in tops[k] if x in order[:at]] for k in own]
        for i, j in jaccard.tree_pairs(size[own], [bits[k] for k in own], own, jaccard.shared_roots(larger)):
            told.update((min(a, b), max(a, b)) for a, b in zip(own[i].tolist(), own[j].tolist(), strict=True))
    some = jaccard.tree_pairs(size, bits, np.arange(len(sets)))
    every = {(min(a, b), max(a, b)) for i, j in some for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    assert set(told) == every and len(every) > 100 and sum(told.values()) < 1.1 * len(every)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (102, 101)], "a long, b long")
    got = {r.node: r.root for r in jaccard.components(links).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys([100, 101, 102], 100)}
    assert jaccard.components(links.limit(0)).count() == 0
