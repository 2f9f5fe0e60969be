"""The training-data operators against brute force on small tables."""

import contextlib
import hashlib
import io
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from sentspark.llm import (components, decontaminate, exact_dedup, grammar, mixing, ngram_lm, quality, simhash,
                           textkernel, token_counts, token_files, tokenizers_public, toxicity, trigrams, warc)
from sentspark.llm.tables import pick, row_key

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, more=""):
    """Rows of (id, text[, source]); ``more`` adds columns with clashing names."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    if more:
        for c in more.split():
            df = df.withColumn(c, F.lit(1))
    return df


CLASHES = "row_key row items spans print root kept keep_id group_size size target copies taken train x label part ids"


def texts(rng, n, vocabulary="the of and in to ab cd ef gh Über naïve 中文 x1 42".split()):
    out = []
    for _ in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        out.append(rng.choice([" ", "\n", "  ", "\t"]).join(words) + rng.choice(["", " ", ".", " "]))
    return out


def edge_rows(rng):
    base = texts(rng, 25)
    rows = list(enumerate(base))
    rows += [(100 + k, base[k % 5]) for k in range(12)]           # copies
    rows += [(200, None), (201, ""), (202, "   "), (203, "word"), (204, "two words"), (None, "no id"), (None, None)]
    rows += [(0, base[0]), (0, base[0]), (205, "w " * 3000)]       # repeated rows, a long text
    return rows


@pytest.fixture(scope="module")
def rows():
    return edge_rows(random.Random(5))


# ---- kernel -----------------------------------------------------------------

def test_words_and_hashes(rows):
    column = pa.array([t for _, t in rows], pa.string())
    w = textkernel.words(column, textkernel.SPACES)
    for k, (_, t) in enumerate(rows):
        own = [w.data[a:b].tobytes() for a, b in zip(w.start[w.first[k]:w.first[k + 1]], w.end[w.first[k]:w.first[k + 1]])]
        assert own == re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    by_word = defaultdict(set)
    for a, b, h in zip(w.start, w.end, w.hash.tolist()):
        by_word[w.data[a:b].tobytes()].add(h)
    assert all(len(v) == 1 for v in by_word.values())
    assert len(set.union(*by_word.values())) == len(by_word)
    sliced = textkernel.words(column.slice(3, 7), textkernel.SPACES)
    assert sliced.hash.tolist() == w.hash[w.first[3]:w.first[10]].tolist()


def test_chunks_cover_all_rows(rows):
    batch = pa.RecordBatch.from_pydict({"text": pa.array([t for _, t in rows], pa.string())})
    parts = list(textkernel.chunks(batch, "text", 200))
    assert sum((p.column("text").to_pylist() for p in parts), []) == [t for _, t in rows]


def test_pick(spark, rows):
    df = docs(spark, rows, CLASHES)
    decisions = df.select("doc_id", row_key().alias("row_key"), (F.length(F.coalesce("text", F.lit(""))) % 3).alias("c"))
    got = Counter((r.doc_id, r.text) for r in pick(df, decisions, "c").collect())
    want = Counter()
    for i, t in rows:
        want[i, t] += len(t or "") % 3
    # null and empty texts are one key
    norm = lambda c: {k: v for k, v in c.items() if v}
    assert norm(got) == norm(want)
    assert pick(df, decisions, "c").columns == df.columns


# ---- op4 --------------------------------------------------------------------

def test_exact_dedup(spark, rows):
    got = exact_dedup.annotate(docs(spark, rows, CLASHES)).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    assert len(got) == len(rows)
    want = Counter()
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        want[i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want
    kept = exact_dedup.dedup(docs(spark, rows))
    assert sorted((r.text or "") for r in kept.collect()) == sorted(groups)
    assert exact_dedup.annotate(docs(spark, [])).count() == 0


def test_exact_dedup_heavy_and_light_agree(spark):
    rows = [(k, "hot" if k % 3 == 0 else f"t{k % 50}") for k in range(600)]
    df = docs(spark, rows)
    keys = df.select(F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
    frequent = {r[0] for r in exact_dedup.frequent_digests(keys, 4, 16, 4).collect()}
    assert hashlib.sha256(b"hot").hexdigest() in frequent and len(frequent) <= 16
    assert exact_dedup.annotate(df).where("kept").count() == len({t for _, t in rows})


# ---- op10 -------------------------------------------------------------------

def fill(sizes):
    """Targets by repeated resharing, straight from the definition."""
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: (1.0, 2.0, 3.0)[k % 3] for k, s in enumerate(names)}
    total = sum(sizes.values())
    full, open_ = {}, set(names)
    while open_:
        left, w = total - sum(full.values()), sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w > 3 * sizes[s]}
        if not over:
            return {**full, **{s: left * weight[s] / w for s in open_}}
        full.update({s: 3.0 * sizes[s] for s in over})
        open_ -= over
    return full


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mixing(spark, seed):
    rng = random.Random(seed)
    names = ["b", "a", "Z", "é", None, "big", "none"]
    rows = []
    for k in range(400):
        s = rng.choices(names, [1, 2, 1, 1, 1, 12, 0.2])[0]
        rows.append((k, None if s == "none" else " ".join("w" * rng.choice([0, 1, 5, 9, 30])), s))
    rows += [(None, "x y z", "a"), (1007, "same row", "b"), (1007, "same row", "b")]
    got = mixing.annotate(docs(spark, rows, CLASHES), seed=9).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = fill(sizes)
    source = {r[0]: r[2] for r in rows}
    taken = Counter()
    for r in got:
        s = "a" if r.doc_id is None else source[r.doc_id]
        assert r.source_size == sizes[s] and math.isclose(r.target, want[s], rel_tol=1e-12, abs_tol=1e-9)
        assert r.taken == r["size"] * r.copies and 0 <= r.copies <= 3
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 5.0, (s, taken[s], want[s])
    again = mixing.annotate(docs(spark, rows, CLASHES).repartition(5), seed=9).collect()
    assert Counter(tuple(r) for r in got) == Counter(tuple(r) for r in again)
    mixed = Counter((r.doc_id, r.text) for r in mixing.mix(docs(spark, rows), seed=9).collect())
    assert sum(len((t or "").split()) * n for (_, t), n in mixed.items()) == sum(taken.values())
    assert mixing.annotate(docs(spark, [])).count() == 0


def test_knapsack_is_exact():
    rng = random.Random(3)
    for _ in range(60):
        lengths = np.array(sorted(rng.sample(range(1, 30), rng.randint(1, 4))))
        counts = np.array([rng.randint(1, 3) for _ in lengths])
        budget = rng.randint(1, 60)
        got = mixing.knapsack(lengths, counts, budget)
        sums = {0}
        for n, c in zip(lengths.tolist(), counts.tolist()):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        assert (got <= counts).all() and (got >= 0).all()
        assert abs(int((got * lengths).sum()) - budget) == min(abs(s - budget) for s in sums)


def test_fit_large_budget():
    rng = np.random.default_rng(1)
    lengths = np.unique(rng.integers(1, 5000, 800))
    counts = rng.integers(1, 400, len(lengths))
    total = int((lengths * counts).sum())
    for budget in (20_000, total // 3, total // 2 + 1, total - 20_000, total):
        got = mixing.fit(lengths, counts, budget, knapsack_words=4096)
        assert (got <= counts).all() and abs(int((got * lengths).sum()) - budget) <= 1


# ---- op7 --------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute_hits(rows, items, window=10):
    patterns = defaultdict(set)
    for i, t in items:
        w = plain_words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if w else ():
            patterns[tuple(w[k:k + n])].add("" if i is None else str(i))
    sizes = sorted({len(p) for p in patterns})
    out = []
    for i, t in rows:
        w = plain_words(t)
        hit, found = [False] * len(w), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                own = patterns.get(tuple(w[k:k + n]))
                if own:
                    found |= own
                    hit[k:k + n] = [True] * n
        out.append((i, len(w), sum(hit), sorted(found)))
    return out


@pytest.mark.parametrize("part_bytes", [1 << 20, 60])
def test_decontaminate(spark, rows, part_bytes):
    rng = random.Random(8)
    vocabulary = "the of and in to ab cd".split()
    long = [(900 + k, " ".join(rng.choice(vocabulary) for _ in range(700))) for k in range(6)]
    items = [(k, t) for k, t in enumerate(texts(rng, 12, vocabulary))]
    items += [(50, "ab cd"), (51, "The, OF"), (52, None), (53, "!!"), (54, " ".join(long[0][1].split()[300:330])),
              (54, "naïve Über 中文"), (None, long[1][1][:200]), (10, "the of and in")]
    all_rows = rows + long
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.annotate(docs(spark, all_rows, CLASHES), bench, part_bytes=part_bytes, keep=["doc_id"],
                                 buffer_bytes=50 * part_bytes)
    have = Counter((r.row.doc_id, r.n_words, sum(s["end"] - s["start"] for s in r.spans), tuple(r["items"]))
                   for r in got.collect())
    want = Counter((i, n, h, tuple(f)) for i, n, h, f in brute_hits(all_rows, items))
    assert have == want
    clean = decontaminate.decontaminate(docs(spark, all_rows, CLASHES), bench)
    assert clean.count() == sum(1 for x in brute_hits(all_rows, items) if not x[2])
    assert clean.columns == docs(spark, [], CLASHES).columns
    assert decontaminate.decontaminate(docs(spark, rows), bench.limit(0)).count() == len(rows)
    assert decontaminate.annotate(docs(spark, []), bench).count() == 0


# ---- op8 --------------------------------------------------------------------

def brute_print(t, shingle=3):
    w = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))
    if not w:
        return 0
    n = min(shingle, len(w))
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[k:k + n]), 42) for k in range(len(w) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_full_anchors_are_split(spark):
    """Whatever the size of blocks, split or not: the same trees, of true links."""
    rng = np.random.default_rng(1)

    def trees(n, edges):
        parent = list(range(n))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x
        for a, b in edges:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        return [root(x) for x in range(n)]
    for bits in (0, 1, 2, 3):
        base = rng.integers(0, 2 ** 63, 20).tolist()
        prints = {b ^ sum(1 << k for k in set(rng.integers(0, 64, rng.integers(0, 5)).tolist())) for b in base for _ in range(20)}
        prints = np.array(list(prints), dtype=np.uint64)
        home = rng.random(len(prints)) < 0.7
        near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= bits
        want = trees(len(prints), zip(*np.nonzero(near & (home[:, None] | home[None, :]))))
        for direct, block in ((1 << 22, 1 << 20), (0, 1 << 20), (0, 100), (1 << 22, 50)):
            edges = simhash.forest(home, prints, bits, direct, block)
            assert trees(len(prints), edges) == want and len(edges) == len(prints) - len(set(want))
            assert all(np.bitwise_count(prints[a] ^ prints[b]) <= bits and (home[a] or home[b]) for a, b in edges)
    # 100,000 homes of one anchor, all within radius 3 of one codeword: no pass over all pairs
    full = np.zeros(100_000, dtype=np.uint64)
    for block in (0, 23):
        for _ in range(3):
            full ^= np.uint64(1) << (rng.integers(0, 23, len(full)) + block).astype(np.uint64)
    full = np.unique(full | rng.integers(0, 1 << 18, len(full)).astype(np.uint64) << np.uint64(46))
    compared = sum(len(i) for i, _ in simhash._candidates(np.ones(len(full), bool), full, 2, simhash.DIRECT, simhash.BLOCK))
    assert compared < len(full) ** 2 / 100


def test_fingerprint(spark, rows):
    for _, t in rows[:40]:
        assert simhash.fingerprint(t) == brute_print(t)
    # Spark's own hash of a single shingle
    t = "alpha beta gamma"
    h = spark.range(1).select(F.xxhash64(F.lit(t))).first()[0] & (2 ** 64 - 1)
    assert simhash.fingerprint(t) == h


def brute_components(prints, bits):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= bits:
                parent[root(a)] = root(b)
    return [root(k) for k in range(len(prints))]


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
def test_links_connect_all(spark, bits):
    rng = random.Random(bits)
    prints = [0, 2 ** 64 - 1]
    for _ in range(60):
        p = rng.getrandbits(64)
        prints.append(p)
        for _ in range(rng.randint(0, 6)):       # chains of near ones
            for _ in range(rng.randint(1, 4)):
                p ^= 1 << rng.randrange(64)
            prints.append(p)
    prints = sorted(set(prints))
    signed = lambda x: x - 2 ** 64 if x >> 63 else x
    df = spark.createDataFrame([(signed(p),) for p in prints], "print long").repartition(4)
    links = simhash.links(df, bits).collect()
    for r in links:
        assert bin((r.a ^ r.b) & (2 ** 64 - 1)).count("1") <= bits
    stars = {r.node: r.root for r in components.components(simhash.links(df, bits)).collect()}
    want = brute_components(prints, bits)
    by_want, by_got = defaultdict(set), defaultdict(set)
    for p, w in zip(prints, want):
        by_want[w].add(signed(p))
        by_got[stars.get(signed(p), signed(p))].add(signed(p))
    assert sorted(map(sorted, by_want.values())) == sorted(map(sorted, by_got.values()))


def test_golay_covers():
    cosets = simhash.Cosets(2)
    words = np.random.default_rng(1).integers(0, 1 << 23, 200)
    of, code = cosets.codewords(words, 0)
    assert of.tolist() == list(range(200))                       # exactly one codeword within the radius
    assert (np.bitwise_count(words ^ code) <= 3).all() and (simhash._syndrome(code) == 0).all()


def test_components_of_a_path_and_a_hub(spark):
    path = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 50)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, **{100 + k: 100 for k in range(1, 50)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_dedup(spark, rows):
    got = simhash.annotate(docs(spark, rows, CLASHES)).collect()
    prints = [brute_print(t) for _, t in rows]
    comp = brute_components(prints, 2)
    least = {}
    for (i, _), c in zip(rows, comp):
        least[c] = min((x for x in (least.get(c), i) if x is not None), default=None)
    want = Counter((i, p, least[c]) for (i, _), p, c in zip(rows, prints, comp))
    assert Counter((r.doc_id, r.print & (2 ** 64 - 1), r.component_id) for r in got) == want
    kept = simhash.dedup(docs(spark, rows, CLASHES))
    assert kept.count() == len(set(comp)) and kept.columns == docs(spark, [], CLASHES).columns
    assert simhash.annotate(docs(spark, [])).count() == 0


# ---- op6 and op3 ------------------------------------------------------------

def labelled(spark, rows, name):
    return spark.createDataFrame([(i, y) for i, _, y in rows], f"doc_id long, {name} int")


def test_quality(spark):
    rng = random.Random(4)
    rows = []
    for k in range(400):
        w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(5, 80))]
        good = k % 4 != 0
        rows.append((k, " ".join(w) + "." if good else " ".join(x + "###" for x in w), int(good)))
    df = docs(spark, [(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (None, "x"), (902, "w " * 30000)], CLASHES)
    labels = labelled(spark, rows[:300], "quality").unionByName(
        spark.createDataFrame([(5, None), (6, 7), (None, 1), (12345, 1)], "doc_id long, quality int"))
    got = {r.doc_id: r.score for r in quality.score(df, labels).collect()}
    assert len(got) == df.count() and all(0 <= s <= 1 for s in got.values())
    assert all((got[i] >= 0.5) == bool(y) for i, _, y in rows[300:])
    kept = quality.keep(df, labels, 0.5)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, s in got.items() if s >= 0.5}
    every = quality.keep(df, labels, 0.5, sent_ids=0)              # too many labelled ids to send
    assert sorted(map(repr, every.collect())) == sorted(map(repr, kept.collect()))
    one_class = quality.score(df, labels.where("quality = 1")).select("score").distinct().collect()
    assert [r.score for r in one_class] == [1.0]
    assert quality.score(docs(spark, []), labels).count() == 0


def test_statistics_match_plain_python(rows):
    x = quality.statistics(pa.array([t for _, t in rows], pa.string()))
    for (_, t), got in zip(rows, x):
        b = (t or "").encode()
        w = b.lower().split()
        assert math.isclose(got[0], math.log1p(len(w)))
        assert math.isclose(got[3], math.sqrt(sum(65 <= c <= 90 for c in b) / max(1, sum(chr(c).isascii() and chr(c).isalpha() for c in b))))
        assert math.isclose(got[5], math.sqrt(sum(a == c for a, c in zip(w, w[1:])) / max(1, len(w))))
        assert math.isclose(got[6], math.sqrt((len(w) - len(set(w))) / max(1, len(w))))


def brute_statistics(text):
    """All statistics of one text, byte by byte."""
    b = (text or "").encode()
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in b)
    words = [(m.start(), m.group()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", lower)]
    w = [x for _, x in words]
    lines = re.findall(rb"[^\n]+", lower)
    plain = b".,;:'\"()-"
    symbol = lambda c: 0x21 <= c < 0x7F and not chr(c).isalnum() and c not in plain
    count, size = max(1, len(w)), max(1, len(b))
    letters = max(1, sum(65 <= c <= 90 or 97 <= c <= 122 for c in b))
    root = lambda x, of: math.sqrt(min(1, max(0, x / of)))
    return [math.log1p(len(w)), math.log1p(sum(map(len, w)) / count), root(sum(map(symbol, b)), size),
            root(sum(65 <= c <= 90 for c in b), letters), root(sum(48 <= c <= 57 for c in b), size),
            root(sum(x == y for x, y in zip(w, w[1:])), count), root(len(w) - len(set(w)), count),
            root(sum(symbol(x[-1]) for x in w), count), math.log1p(len(w) / max(1, len(lines))),
            root(sum(c >= 128 for c in b), size), root(len(lines) - len(set(lines)), max(1, len(lines))),
            root(b.count(b"."), count)]


def brute_discriminant(x, y):
    """Quadratic discriminant fitted at once, with general solves instead of cached factors."""
    d = x.shape[1]
    means = [x[y == c].mean(axis=0) for c in (0, 1)]
    covs = [np.cov(x[y == c].T, bias=True) for c in (0, 1)]
    n = [int((y == c).sum()) for c in (0, 1)]
    pooled = (covs[0] * n[0] + covs[1] * n[1]) / sum(n)
    out = []
    for c in (0, 1):
        s = 0.9 * covs[c] + 0.1 * pooled
        mu, square = np.trace(s) / d, (s * s).mean()
        weight = max(1e-3, min(1.0, (square + mu * mu) / ((n[c] + 1) * (square - mu * mu / d))))
        out.append((means[c], (1 - weight) * s + weight * max(mu, 1e-6) * np.eye(d), math.log(n[c] / sum(n))))

    def score(v):
        logs = [p - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * (v - m) @ np.linalg.solve(s, v - m) for m, s, p in out]
        return 1 / (1 + math.exp(min(700, max(-700, logs[0] - logs[1]))))
    return score


def test_quality_scores_match_plain_python(spark):
    """Every score of the smallest table: statistics, fit and posterior computed anew."""
    folder = "/root/testdata/sf0.001"
    df, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r.text for r in df.collect()}
    y = {r.doc_id: r.quality for r in labels.collect() if r.doc_id in rows and r.quality in (0, 1)}
    stats = {i: np.array(brute_statistics(t)) for i, t in rows.items()}
    score = brute_discriminant(np.array([stats[i] for i in y]), np.array(list(y.values())))
    got = {r.doc_id: r.score for r in quality.score(df, labels).collect()}
    assert got.keys() == rows.keys()
    for i, v in stats.items():
        assert math.isclose(got[i], score(v), rel_tol=1e-6, abs_tol=1e-9)


def brute_toxicity(model, text):
    """A model's score of one text, word by word and clause by clause."""
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    lists = {w.encode(): s for ws, s in ((toxicity.TARGETS, grammar.TARGET), (toxicity.NEGATIONS, grammar.NEGATION),
                                         (toxicity.REPORTS, grammar.REPORT)) for w in ws}
    stems = [(s.encode(), grammar.INSULT, x) for s, x in model.stems.items()]
    stems += [(s.encode(), grammar.THREAT, x) for s, x in model.threats.items()]
    by_size = defaultdict(list)
    for s, kind, x in stems:
        by_size[len(s)].append((s, kind, x))
    total = np.zeros(len(toxicity.PATTERNS))
    for clause in re.split(rb"[.!?;:\n]", lower):
        symbols, powers = [], []
        for word in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", clause):
            symbol, power = lists.get(word, grammar.OTHER), 0.0
            for size in by_size:                                   # in the model's order; a tie keeps the first
                for s, kind, x in by_size[size]:
                    if word.startswith(s) and x > power:
                        symbol, power = kind, x
            symbols.append(symbol)
            powers.append(power)
        if not {grammar.INSULT, grammar.THREAT} & set(symbols):
            continue
        # the transducers, spelled out
        at = [k for k, s in enumerate(symbols) if s in (grammar.INSULT, grammar.THREAT)]
        insults = [k for k, s in enumerate(symbols) if s == grammar.INSULT]
        aims = [k for k, s in enumerate(symbols) if s == grammar.TARGET]
        nots = [k for k, s in enumerate(symbols) if s == grammar.NEGATION]
        said = [k for k, s in enumerate(symbols) if s == grammar.REPORT]
        threat = int(grammar.THREAT in symbols and bool(aims))
        if not insults and not threat:
            continue
        aimed = int(any(abs(i - a) <= 4 for i in insults for a in aims))
        negated = int(all(any(0 < k - n <= 3 for n in nots) for k in at))
        reported = int(bool(said) and any(k > said[0] for k in at))
        pattern = toxicity.PATTERNS.index((threat, aimed or threat, negated, reported))
        total[pattern] += max(powers) * (1 + 0.25 * max(0, min(3, len(insults)) - 1))
    z = model.bias + (total / 4.0) @ np.array(model.weights)
    return 1 / (1 + math.exp(-min(700, max(-700, z))))


def test_toxicity_scores_match_plain_python(spark):
    folder = "/root/testdata/sf0.001"
    df, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(df, labels)
    got = {r.doc_id: r.score for r in toxicity.score(df, labels).collect()}
    rows = {r.doc_id: r.text for r in df.collect()}
    assert got.keys() == rows.keys()
    for i, text in rows.items():
        assert math.isclose(got[i], brute_toxicity(model, text), rel_tol=1e-9), i
    for text in ("You are not an idiot", "she said you are stupid", "I will kill you!", "kill it", "idiot idiots moron fools",
                 "no one said: you fool", "never, ever a scum. they wrote trash", "", "not stupid but dumb"):
        one = float(model.score(model.features(pa.array([text])))[0])
        assert math.isclose(one, brute_toxicity(model, text), rel_tol=1e-9), text


def test_ablation_of_transducers(spark):
    """Each mark is counted where it stands, and taking it off changes the loss by its weight."""
    model = toxicity.Model({"idiot": 4.0}, {"kill": 4.0})
    rows = [(1, "you idiot", 1), (2, "he is not an idiot at all here", 0), (3, "fine words", 0), (4, "an idiot", 1),
            (5, "you are an idiot. fine", 1), (6, "you will kill them", 1), (7, None, 0)]
    df = docs(spark, [(i, t) for i, t, _ in rows], CLASHES)
    got = {r.transducer: r for r in toxicity.ablation(df, labelled(spark, rows, "toxic"), model).collect()}
    assert {k: (r.rows, r.documents, r.idle) for k, r in got.items()} == {
        "threat": (7, 1, False), "aimed": (7, 4, False), "negated": (7, 1, False), "reported": (7, 0, True)}
    y = np.array([x for _, _, x in rows])
    x = model.features(pa.array([t for _, t, _ in rows], pa.string()))
    loss = lambda w: float((np.logaddexp(0, z := model.bias + x @ w) - y * z).mean())
    assert all(math.isclose(r.loss, loss(np.array(model.weights)), rel_tol=1e-12) for r in got.values())
    off = [model.weights[toxicity.PATTERNS.index((k, a, 0, r))] for k, a, _, r in toxicity.PATTERNS]
    assert math.isclose(got["negated"].loss_without, loss(np.array(off)), rel_tol=1e-12)
    assert got["negated"].loss_without > got["negated"].loss and got["reported"].loss_without == got["reported"].loss
    assert toxicity.ablation(df.limit(0), labelled(spark, rows, "toxic"), model).where("rows > 0").count() == 0


def test_other_tokenizer_files_are_left_to_the_library(tmp_path):
    """A normaliser, another split, a prefix space: the shortcut must not be taken."""
    import json

    from tokenizers import Tokenizer
    with open(tokenizers_public.file_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        given = json.load(f)
    assert tokenizers_public.is_plain(given)
    texts_ = ["Plain English TEXT, 123 words", "  Two  spaces\n\n and tabs\t", "", "Ünïcode 한국어", "don't we'll"]
    changed = {"lower": given | {"normalizer": {"type": "Lowercase"}},
               "prefix": given | {"pre_tokenizer": given["pre_tokenizer"] | {"add_prefix_space": True}},
               "split": given | {"pre_tokenizer": {"type": "Sequence", "pretokenizers": [
                   {"type": "WhitespaceSplit"}, given["pre_tokenizer"] | {"use_regex": False}]}}}
    for name, file in changed.items():
        assert not tokenizers_public.is_plain(file)
        (tmp_path / f"{name}.json").write_text(json.dumps(file), encoding="utf-8")
        want = [e.ids for e in Tokenizer.from_file(str(tmp_path / f"{name}.json")).encode_batch(texts_, add_special_tokens=False)]
        got = tokenizers_public.byte_level(f"{name}.json", str(tmp_path)).encode(texts_)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == want, name
    words = Tokenizer.from_file(tokenizers_public.file_path("word_bpe_49k.json"))
    assert tokenizers_public.count_tokens(texts_, "word_bpe_49k.json") == [
        len(e.ids) for e in words.encode_batch(texts_, add_special_tokens=False)]


def test_remembered_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(tokenizers_public, "REMEMBERED", 30)
    e = tokenizers_public.ByteLevelEncoder("byte_bpe_50k.json")
    texts_ = ["x" * 400 + " " + " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(j, j + 5)) for j in range(200)]
    whole = e.whole(texts_)
    for t, ids in zip(texts_, whole):
        assert e.encode([t]) == [ids]
        assert len(e.young) <= 40 and max(map(len, e.young)) <= tokenizers_public.LONG
        before = e.young.before.__self__         # of the generations, one more is held
        assert len(before) <= 40 and not (isinstance(before, tokenizers_public.Remembered) and before.before.__self__)


def test_grammar_patterns():
    run = grammar.compose().run
    o, i, k, t, n, r = range(6)
    #                      insults, threat, aimed, negated, reported
    assert run([o, o]) == (0, 0, 0, 0, 0)
    assert run([t, o, i]) == (1, 0, 1, 0, 0)
    assert run([n, o, i]) == (1, 0, 0, 1, 0)
    assert run([n, o, o, o, i]) == (1, 0, 0, 0, 0)
    assert run([n, i, o, o, o, i]) == (2, 0, 0, 0, 0)     # one of them stands
    assert run([r, o, i]) == (1, 0, 0, 0, 1)
    assert run([i, r]) == (1, 0, 0, 0, 0)
    assert run([o, k, t]) == (0, 1, 0, 0, 0)
    assert run([k]) == (0, 0, 0, 0, 0)                    # a threat needs somebody
    assert run([i] * 9)[0] == 3


def test_toxicity(spark):
    rng = random.Random(6)
    w = lambda: " ".join("".join(rng.choice("aeiourstn") for _ in range(rng.randint(2, 7))) for _ in range(20))
    rows = []
    for k in range(300):
        bad = k % 3 == 0
        insult = rng.choice(["idiot", "zoggle" + rng.choice(["x", "y", "zz"])])
        rows.append((k, w() + (". he is an " + insult + " . " if bad else ". ") + w(), int(bad)))
    more = [(900, None), (901, ""), (None, "x"), (902, "you idiot " * 2000), (903, "he said: nobody is a zogglequ")]
    df = docs(spark, [(i, t) for i, t, _ in rows] + more, CLASHES)
    labels = labelled(spark, rows[:200], "toxic")
    model = toxicity.train(df, labels)
    assert any(s.startswith("zog") for s in model.stems)
    found = toxicity.score(df, labels).collect()
    got = {r.doc_id: r.score for r in found}
    assert len(found) == df.count() and all(0 <= s <= 1 for s in got.values())
    assert all((got[i] >= 0.5) == bool(y) for i, _, y in rows[200:])
    assert got[900] == got[901] < 0.5
    spans = {r.doc_id: r.clauses for r in found}
    text = dict((i, t) for i, t, _ in rows)
    assert any(x in text[0].encode()[spans[0][0]["start"]:spans[0][0]["end"]].decode() for x in ("idiot", "zoggle"))
    untrained = toxicity.score(df, labels.limit(0)).collect()
    assert all(0 <= r.score <= 1 for r in untrained)
    assert toxicity.score(docs(spark, []), labels).count() == 0


# ---- op1 and op9 ------------------------------------------------------------

def test_cached_encoder_equals_library():
    e = tokenizers_public.byte_level("byte_bpe_50k.json")
    rng = random.Random(2)
    alphabet = "ab' \t\n\x0b\x0c\r\x85\xa0\x1csS0²½ªµ×÷ßÿĀɏɐé中!.#\x00\x7f\x80\xad_"
    xs = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(5000)]
    xs += ["a<|endoftext|>b", "", "x" * 5000, "I'll we've 'S 's"]
    assert e.encode(xs) == e.whole(xs) and e.encode(xs) == e.whole(xs)


def test_token_files(spark, rows, tmp_path):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizers_public.file_path("byte_bpe_50k.json"))
    path = f"file://{tmp_path}/tokens"
    token_files.write(docs(spark, rows, CLASHES), path, row_group_bytes=1 << 16, page_bytes=1 << 12)
    got = token_files.read(spark, path).orderBy("start").collect()
    ids = {k: t.encode(x or "", add_special_tokens=False).ids + [0] for k, x in enumerate(x for _, x in rows)}
    want = Counter((rows[k][0], tuple(v)) for k, v in ids.items())
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids)
        at += r.n_tokens
    known = [r.doc_id for r in got if r.doc_id is not None]
    assert known == sorted(known)
    sums = {(r.start, r.ids_crc32) for r in token_files.checksums(token_files.read(spark, path)).collect()}
    assert sums == {(r.start, zlib.crc32(struct.pack(f"<{len(r.ids)}I", *r.ids))) for r in got}
    plan = token_files.metadata(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in re.search(r"ReadSchema: struct<([^>]*)", plan).group(1)
    import glob
    import pyarrow.parquet as pq
    files = [pq.ParquetFile(f) for f in glob.glob(f"{tmp_path}/tokens/tokens/*.parquet")]
    chunk = next(f for f in files if f.metadata.num_rows).metadata.row_group(0)
    by = {chunk.column(k).path_in_schema: chunk.column(k) for k in range(chunk.num_columns)}
    assert any("DICTIONARY" in e for e in by["ids.list.element"].encodings)
    assert "DELTA_BINARY_PACKED" in by["doc_id"].encodings and by["doc_id"].has_offset_index
    assert token_files.round_trip(docs(spark, [])).count() == 0


def test_texts_stay_when_all_digests_are_stored(spark, rows, tmp_path, monkeypatch):
    cache = token_counts.CountCache(spark, f"file://{tmp_path}/cache")
    cache.fill(docs(spark, rows))
    assert cache.misses(docs(spark, rows)) == (None, None)
    with contextlib.redirect_stdout(io.StringIO()) as said:
        token_counts.annotate(docs(spark, rows), cache).explain()
    assert not any("Exchange" in x and "text#" in x for x in said.getvalue().splitlines())
    # a few misses, sent to the tasks; and more of them than that
    for most, new in ((500_000, "one more"), (0, "and another")):
        monkeypatch.setattr(token_counts, "SENT_MISSES", most)
        more = rows + [(1, new), (2, new)]
        found, path = cache.misses(docs(spark, more))
        assert [r.text for r in found.select("text").collect()] == [new]
        before = spark.read.parquet(cache.path).count()
        cache.fill(docs(spark, more))
        assert spark.read.parquet(cache.path).count() == before + 1


def test_token_counts(spark, rows, tmp_path):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizers_public.file_path("piece_bpe_32k.model"))
    cache = token_counts.CountCache(spark, f"file://{tmp_path}/cache")
    first = token_counts.annotate(docs(spark, rows[:10], CLASHES), cache).count()
    assert first == 10
    got = Counter(tuple(r) for r in token_counts.annotate(docs(spark, rows, CLASHES), cache).collect())
    assert got == Counter((i, len((t or "").encode()), len(sp.encode(t or ""))) for i, t in rows)
    stored = spark.read.parquet(cache.path)
    assert stored.count() == len({t or "" for _, t in rows})      # each text once, over both calls
    cache.fill(docs(spark, rows))
    assert stored.count() == spark.read.parquet(cache.path).count()
    assert token_counts.annotate(docs(spark, []), cache).count() == 0


# ---- op2 --------------------------------------------------------------------

def test_archives_keep_ids_of_any_type(spark):
    body = "x" * 200
    pages = [("b", body), ("a>\r\nX: 1", body), ("", "short"), (None, "y"), ("%", "z"), ("ü/ 1", body), ("12", "w")]
    df = spark.createDataFrame([(i, "http://a", h) for i, h in pages], "page_id string, url string, html string")
    rows = warc.round_trip(df).select(warc.page_of("record_id", "string").alias("page_id"), "record_type",
                                      warc.page_of("refers_to", "string").alias("refers_to")).collect()
    assert sorted(((r.page_id, r.record_type, r.refers_to) for r in rows), key=repr) == sorted(
        ((i, "revisit" if i in ("b", "ü/ 1") else "response", "a>\r\nX: 1" if i in ("b", "ü/ 1") else None) for i, _ in pages),
        key=repr)
    number = spark.createDataFrame([("<urn:x-page:-7>",), ("<urn:x-page:>",), ("other",), (None,), ("<urn:x-page:x>",)], "r string")
    assert [r[0] for r in number.select(warc.page_of("r")).collect()] == [-7, None, None, None, None]


def test_warc_round_trip(spark):
    long = "<p>" + "x" * 150 + "</p>"
    pages = [(5, "http://a", long), (3, "http://b", long), (9, None, long), (None, "http://n", long), (1, "u", "short"),
             (2, "u", "short"), (4, "v\r\nInjected: x", None), (6, "w", ""), (7, "ü", "é" * 60), (8, "ü", "é" * 60),
             (10, "big", "z" * 300_000), (3, "http://b", long)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    got = warc.round_trip(df).collect()
    assert len(got) == len(pages)
    first = {}
    for i, _, h in pages:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(i, first.get(b, i))
    want = Counter()
    for i, _, h in pages:
        b = (h or "").encode()
        again = b in first and i != first[b]
        want[f"<urn:x-page:{'' if i is None else i}>", len(b), hashlib.sha256(b).hexdigest(),
             "revisit" if again else "response", f"<urn:x-page:{first[b]}>" if again else None,
             None if again else b] += 1
    assert Counter((r.record_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to,
                    None if r.payload is None else bytes(r.payload)) for r in got) == want
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_pushdown_and_plain_files(spark, tmp_path):
    warc.register(spark)
    fields = {"WARC-Type": "response", "WARC-Record-ID": "<urn:1>", "WARC-Target-URI": "http://x"}
    one = warc.record(fields, {"Content-Length": "5"}, b"hello")
    two = warc.record({**fields, "WARC-Type": "request", "WARC-Record-ID": "<urn:2>"}, None, b"GET /")
    one = one.replace(b"WARC-Type", b"Content-Type: application/http\r\nwarc-type", 1)
    (tmp_path / "a.warc").write_bytes(one + two)
    import gzip
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two) + warc.member(two))
    (tmp_path / "_hidden.warc").write_bytes(b"junk")
    df = spark.read.format("warc").load(str(tmp_path))
    assert Counter((r.record_type, bytes(r.payload)) for r in df.collect()) == Counter(
        {("response", b"hello"): 2, ("request", b"GET /"): 3})
    wanted = df.where("record_type = 'response' and target_uri like 'http%'")
    assert wanted.count() == 2
    with contextlib.redirect_stdout(io.StringIO()) as said:
        wanted.explain("formatted")
    plan = said.getvalue()
    assert "EqualTo(record_type,response)" in plan and "StringStartsWith(target_uri,http)" in plan
    reader = warc.WarcReader({"path": str(tmp_path), "payload": "false"})
    from pyspark.sql.datasource import EqualTo, GreaterThan
    left = list(reader.pushFilters([EqualTo(("record_type",), "request"), GreaterThan(("payload_bytes",), 3)]))
    assert len(left) == 1 and len(reader.filters) == 1
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert sum(b.num_rows for b in batches) == 3
    assert all(x is None for b in batches for x in b.column("payload").to_pylist())


# ---- op5 --------------------------------------------------------------------

def brute_words(t):
    """Words with A-Z alone lower-cased."""
    return re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))


def brute_model(train, test):
    words = brute_words
    uni, bi = Counter(), Counter()
    for t in train:
        w = [*words(t), b"</s>"]
        uni.update(w)
        bi.update(zip([b"<s>", *w], w))
    n, v = sum(uni.values()), len(uni)
    cc = lambda c: [sum(1 for x in c.values() if x == k) for k in (1, 2, 3, 4)]
    d = ngram_lm.discounts(*cc(bi))
    left = Counter(w for _, w in bi)
    e = ngram_lm.discounts(*cc(left))
    total = sum(left.values())
    mass = sum(e[min(x, 3)] for x in left.values()) / total if total else 1.0
    follow, taken = Counter(), Counter()
    for (a, _), c in bi.items():
        follow[a] += c
        taken[a] += d[min(c, 3)]

    def p(a, w):
        low = mass / (v + 1) + ((left[w] - e[min(left[w], 3)]) / total if left[w] else 0.0)
        if not follow[a]:
            return low
        c = bi[a, w]
        return (c - d[min(c, 3)] if c else 0.0) / follow[a] + taken[a] / follow[a] * low
    out = []
    for t in test:
        w = [*words(t), b"</s>"]
        out.append((len(w), sum(uni[x] > 0 for x in w), n, sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w),
                    sum(math.log10(p(a, x)) for a, x in zip([b"<s>", *w], w))))
    return out, uni, p


def test_ngram_model(spark, rows):
    rng = random.Random(12)
    more = [(1000 + k, " ".join(rng.choices("a b c d e f g h i j the of".split(), range(1, 13), k=30))) for k in range(60)]
    every = rows + more
    df = docs(spark, every, CLASHES)
    used = F.coalesce(F.col("doc_id") % 5 != 0, F.lit(False))
    train = [t for i, t in every if i is not None and i % 5 != 0]
    want, uni, p = brute_model(train, [t for _, t in every])
    for shards in (1, 5):
        model = ngram_lm.train(df, used, shards=shards, order=2)
        got = ngram_lm.score(df, model).collect()
        key = lambda i, x: (-1 if i is None else i, x[0], x[1], round(x[3], 6), round(x[4], 6))
        have = sorted(key(r.doc_id, r[1:]) for r in got)
        assert [h[:3] for h in have] == [w[:3] for w in sorted(key(i, w) for (i, _), w in zip(every, want))]
        for h, w in zip(have, sorted(key(i, w) for (i, _), w in zip(every, want))):
            assert math.isclose(h[3], w[3], abs_tol=1e-5) and math.isclose(h[4], w[4], abs_tol=1e-5), (h, w)
    for a in (b"<s>", b"the", b"never seen", b"c"):                # sums to one with one unknown word
        assert math.isclose(sum(p(a, w) for w in uni) + p(a, b"unknown!"), 1.0, abs_tol=1e-9)
    empty = ngram_lm.train(df.limit(0))
    assert [r.score for r in ngram_lm.score(df.limit(3), empty).collect()] == [0.0] * 3
    assert ngram_lm.score(df.limit(0), model).count() == 0


def test_decontaminate_holds_one_part(spark, tmp_path, monkeypatch):
    small = decontaminate.Matcher(["i"], [" ".join(f"w{k}" for k in range(3000))])
    assert small.lengths[0].shift.dtype == np.int8
    bench = spark.createDataFrame([(f"i{k}", " ".join(f"w{k}x{j}" for j in range(12))) for k in range(4)],
                                  "item_id string, text string")
    df = docs(spark, [(k, "before " + " ".join(f"w{k}x{j}" for j in range(12)) + " after") for k in range(4)])
    found = decontaminate.annotate(df, bench, part_bytes=60)
    assert {r.row.doc_id: r["items"] for r in found.collect()} == {k: [f"i{k}"] for k in range(4)}
    with contextlib.redirect_stdout(io.StringIO()) as said:
        found.explain()
    assert said.getvalue().count("MapInArrow") == 1           # one pass over the documents, however many parts
    assert "sentspark-decontaminate" not in said.getvalue()    # and nothing is written on the way
    assert len(list(decontaminate.parts(bench, 60))) == 4
    assert decontaminate._opened.cache_info().maxsize == 1     # a task holds one part


def test_toxic_stems_by_likelihood_before_the_limit(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_STEMS", 3)
    rare = [(f"r{chr(97 + k)}are", 8, 0) for k in range(20)]
    assert "strong" in toxicity.choose([*rare, ("strong", 200, 200)], 320, 15680)
    monkeypatch.setattr(toxicity, "CANDIDATES", 3)
    rng = random.Random(4)
    noise = lambda n: " ".join("".join(rng.choices("ghjklmnp", k=7)) for _ in range(n))
    texts_ = [(i, f"{noise(6)} qualster " + f" xx{chr(97 + i // 6)}{chr(97 + i // 6)}yy " + noise(3)) for i in range(60)]
    clean = [(100 + i, noise(9) + (" qualster" if i < 6 else "")) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in texts_ + clean], "doc_id long, toxic int")
    model = toxicity.train(docs(spark, texts_ + clean), labels)
    assert any("qualster".startswith(s) for s in model.stems)


def test_toxicity_families_are_copies_not_common_pairs(spark):
    rng = random.Random(8)
    text = lambda: " ".join(["common pair", *("".join(rng.choices("abcdefgh", k=6)) for _ in range(6))])
    column = pa.array([text() for _ in range(400)] + ["one and the same text of some words"] * 5)
    batch = pa.RecordBatch.from_pydict({"text": column, "label": pa.array([1] * len(column), pa.int64())})
    family = np.concatenate([b.column("family").to_numpy() for b in toxicity._families(iter([batch]))])
    assert len(set(family[:400].tolist())) >= 395 and len(set(family[400:].tolist())) == 1


@pytest.mark.parametrize("kind", ["int", "string"])
def test_near_dedup_keeps_id_types(spark, kind):
    text = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([(1, text), (2, text), (3, "another text of quite other words, long enough")],
                               "doc_id int, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    if kind == "string":
        df = df.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    kept = simhash.dedup(df, shingle=3, max_bits=2)
    assert kept.schema["doc_id"].dataType == df.schema["doc_id"].dataType
    assert sorted(str(r.doc_id)[-1] for r in kept.collect()) == ["1", "3"]


def test_mix_gives_each_source_its_own(spark):
    rows_ = [(i, "same words in both sources", s) for i in range(40) for s in ("a", "b", "c")]
    df = docs(spark, rows_)
    plan = Counter()
    for r in mixing.annotate(df, seed=3).collect():
        plan[r.doc_id, r.source] += r.copies
    got = Counter((r.doc_id, r.source) for r in mixing.mix(df, seed=3).collect())
    assert got == +plan


def brute_trigrams(train, test):
    words = brute_words
    tri, raw, uni = Counter(), Counter(), Counter()
    for t in train:
        w = [b"<s>", *words(t), b"</s>"]
        uni.update(w[1:])
        raw.update(zip(w, w[1:]))
        tri.update(zip(w, w[1:], w[2:]))
    cc = lambda c: [sum(1 for x in c.values() if x == k) for k in (1, 2, 3, 4)]
    left = Counter((b, c) for _, b, c in tri)
    one = Counter(c for _, c in raw)
    d3, d2, d1 = ngram_lm.discounts(*cc(tri)), ngram_lm.discounts(*cc(left)), ngram_lm.discounts(*cc(one))
    middle = left + Counter({k: n for k, n in raw.items() if k[0] == b"<s>"})

    def order(table, d):
        total, taken = Counter(), Counter()
        for k, n in table.items():
            total[k[:-1]] += n
            taken[k[:-1]] += d[min(n, 3)]
        return lambda context, w, low: low if not total[context] else (
            max(table[(*context, w)] - d[min(table[(*context, w)], 3)], 0) + taken[context] * low) / total[context]
    n1 = sum(one.values())
    mass = sum(d1[min(n, 3)] for n in one.values()) / n1
    p1 = lambda w: mass / (len(uni) + 1) + ((one[w] - d1[min(one[w], 3)]) / n1 if one[w] else 0.0)
    p2, p3 = order(middle, d2), order(tri, d3)

    def p(u, v, w):
        low = p2((v,), w, p1(w))
        return low if v == b"<s>" else p3((u, v), w, low)
    out = []
    for t in test:
        w = [b"", b"<s>", *words(t), b"</s>"]
        out.append(sum(math.log10(p(*x)) for x in zip(w, w[1:], w[2:])))
    return out, uni, p


def test_ngram_order_3(spark):
    rng = random.Random(5)
    words = "a b c d e f g h i j the of".split()
    texts_ = [" ".join(rng.choices(words, range(1, 13), k=rng.randint(0, 40))) for _ in range(120)]
    texts_ += ["the of a " * 400, "zz the of new words", "", None]
    df = docs(spark, list(enumerate(texts_)))
    used = F.col("doc_id") % 5 != 0
    want, uni, p = brute_trigrams([t for i, t in enumerate(texts_) if i % 5], texts_)
    for shards in (1, 5):                                          # hot middle words are spread over five
        model = ngram_lm.train(df, used, shards=shards)
        got = {r.doc_id: r for r in ngram_lm.score(df, model).collect()}
        for i, x in enumerate(want):
            assert math.isclose(got[i].score, x, rel_tol=1e-9, abs_tol=1e-9), (shards, i)
    for u, v in ((b"the", b"of"), (b"a", b"a"), (b"", b"<s>"), (b"<s>", b"the"), (b"never", b"seen")):
        assert math.isclose(sum(p(u, v, w) for w in uni) + p(u, v, b"unknown!"), 1.0, abs_tol=1e-9)
    pairs_only = ngram_lm.train(df, used, order=2)
    assert ngram_lm.score(df, pairs_only).columns == ngram_lm.score(df, model).columns
    with pytest.raises(ValueError):
        ngram_lm.train(df, used, order=4)


def test_stairs():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 500):
        rows = np.sort(rng.integers(0, 5, n)), *(rng.integers(0, 2 ** 40, n) % k for k in (4, 7))
        order = np.lexsort(rows[::-1])
        rows = [x[order].astype(np.uint64) for x in rows]
        back = trigrams.climbed(*trigrams.stairs(*rows))
        assert all((a == b).all() for a, b in zip(rows, back))


def test_packed_arrays():
    rng = np.random.default_rng(2)
    for n in (0, 1, 1000):
        x = np.sort(rng.integers(0, 2 ** 63, n).astype(np.uint64) * np.uint64(2))
        assert (ngram_lm.undo(ngram_lm.unpack(ngram_lm.pack(ngram_lm.deltas(x)), n)) == x).all()
    a, b = rng.integers(0, 2 ** 40, 500), rng.integers(0, 2 ** 40, 500)
    f, s, n = ngram_lm.distinct_pairs(np.concatenate([a, a]), np.concatenate([b, b]))
    assert sorted(zip(f.tolist(), s.tolist())) == sorted(set(zip(a.tolist(), b.tolist()))) and (n == 2).all()
