"""Centroid clusters, URL filter and collocations against brute force."""

import hashlib
import math
import os
import random
import re
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from test_operators import CLASHES, docs, edge_rows  # noqa: E402

from sentspark.llm import centroids, collocations, url_labels, urls  # noqa: E402
from sentspark.llm.catalog import QUERIES, URL_RULES  # noqa: E402

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>"


# ---- centroid clusters ------------------------------------------------------

def brute_clusters(rows, k, rounds, dims):
    """(id, cluster, distance) of each usable row, and final centroids, in plain integers."""
    kept = [(i, [math.floor(256 * float(np.float32(e))) for e in v], v) for i, v in rows
            if v is not None and len(v) == dims and all(e is not None and math.isfinite(e) for e in v)]
    sha = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    c = [x for _, x, _ in sorted(kept, key=lambda r: (sha(r[0]), r[2]))[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, y)), j) for j, y in enumerate(c))
    for _ in range(rounds):
        own = [[] for _ in c]
        for _, x, _ in kept:
            own[nearest(x)[1]].append(x)
        c = [[sum(col) // len(o) for col in zip(*o)] if o else old for o, old in zip(own, c)]
    return [(i, j, d) for i, x, _ in kept for d, j in [nearest(x)]], c


def same_clusters(df, rows, k=40, rounds=5, dims=64):
    want, c = brute_clusters(rows, k, rounds, dims)
    got = centroids.cluster(df, k, rounds, dims=dims).collect()
    assert Counter((r.vec_id, r.cluster, r.distance) for r in got) == Counter(want)
    for r in got:
        assert r.cluster_inertia == sum(d for _, j, d in want if j == r.cluster)
        assert r.inertia == sum(d for _, _, d in want)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, c[r.cluster])).encode()).hexdigest()
        assert 1 <= r.checked <= k
    return got


def test_clusters_on_the_given_vectors(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    same_clusters(df, rows)
    assert "checked" not in QUERIES["op11_centroid_clusters"](spark, SF).columns


def test_clusters_edge_cases(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.5, -0.25, 0.0, 0.5, 1.0]) for _ in range(4)]) for i in range(60)]
    rows += [(1, rows[0][1]), (1, rows[0][1]), (2, [9.0] * 4), (None, [0.1] * 4), (70, None), (71, []), (72, [1.0] * 3),
             (73, [1.0, None, 1.0, 1.0]), (74, [1.0, float("nan"), 1.0, 1.0]), (75, [1.0, float("inf"), 1.0, 1.0])]
    df = spark.createDataFrame(rows, VECTORS)
    for c in CLASHES.split() + ["cluster", "distance", "checked", "inertia", "pivot2"]:
        df = df.withColumn(c, F.lit(1))
    same_clusters(df, rows, k=7, rounds=5, dims=4)
    same_clusters(df.limit(3), rows[:3], k=7, rounds=2, dims=4)
    alike = [(i, [0.5] * 4) for i in range(9)]                   # no two pivots differ
    same_clusters(spark.createDataFrame(alike, VECTORS), alike, k=3, dims=4)
    empty = centroids.cluster(df.where("false"), 7, dims=4)
    assert empty.count() == 0 and empty.columns == centroids.cluster(df, 7, dims=4).columns
    far = spark.createDataFrame([(1, [3e38, -3e38, 0.0, 1.0]), (2, [-3e38] * 4)], VECTORS)
    assert centroids.cluster(far, 1, 1, dims=4).count() == 2


def test_pivots_skip_centroids_far_away(spark):
    """On vectors in clumps most centroids are never compared, and none that is nearest."""
    rng = np.random.default_rng(1)
    clumps = rng.normal(size=(40, 16)) * 4
    rows = [(int(i), (clumps[i % 40] + rng.normal(size=16) * 0.05).tolist()) for i in range(2000)]
    got = same_clusters(spark.createDataFrame(rows, VECTORS), rows, rounds=1, dims=16)
    assert sum(r.checked for r in got) / len(got) < 20


def test_bounds_never_exceed_distances():
    rng = np.random.default_rng(2)
    for scale in (1, 1000, 1 << 25):
        x = rng.integers(-scale, scale + 1, size=(300, 8))
        c = np.concatenate([rng.integers(-scale, scale + 1, size=(20, 8)), x[:5]])
        pivots = centroids.far_apart(c, 6)
        search = centroids.Search(c, pivots)
        far = np.stack([centroids.squared(x, p) for p in pivots], axis=1)
        low = search.bounds(np.sqrt(far.astype(float)))
        exact = np.stack([centroids.squared(x, k) for k in c], axis=1)
        assert (low <= exact).all()
        label, best, _ = search.nearest(x, far)
        assert (label == exact.argmin(axis=1)).all() and (best == exact.min(axis=1)).all()


# ---- URL filter -------------------------------------------------------------

URLS = [None, "", "no scheme", "http://", "http://COM", "http://com/", "HTTP://A.Example.COM/EN/x", "https://example.com/en/1",
        "https://www.example.com/en/1?x=/fr/", "https://a.www.example.com/en/", "https://notexample.com/en/", "x://h?q=://z/",
        "http://a.net#f", "http://a.net/es", "http://a.net/es/ü", "http://net/fr/", "http://b.org/://c.net/es/", "://x.net/fr/\nq#",
        "http://Ünï.org/Ä", "http://long.org/" + "ab/" * 20000, "http://casino-pills.org/", "a\n://b.com/c"]


def brute_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3:]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), path


def brute_rule(host, path, lines):
    best = None
    for line in lines:
        verdict, place = line.split(" ")
        at, prefix = place.split("/", 1)
        if (host == at or host.endswith("." + at)) and path.startswith("/" + prefix):
            if best is None or len(place) > len(best[0]):
                best = (place, verdict)
    return best


def brute_block(model, host, path):
    """The model's probability, n-gram by n-gram."""
    from sentspark.llm.textkernel import mix64
    total, n = 0.0, 0
    for field, text in enumerate((host, path)):
        raw = b"\0" + text.encode() + b"\0"
        for size in urls.GRAMS:
            for i in range(len(raw) - size + 1):
                value = field * 16 + size
                for b in raw[i:i + size]:
                    value = (value * 257 + b) % 2 ** 64
                total += model.weights[int(mix64(np.array([value], dtype=np.uint64))[0]) >> (64 - model.bits)]
                n += 1
    return 1 / (1 + math.exp(-(total / math.sqrt(max(1, n)) + model.bias)))


def same_verdicts(got, model, lines):
    for r in got:
        host, path = brute_url(r.url)
        rule = brute_rule(host, path, lines)
        assert (r.host, r.path) == (host, path)
        if rule:
            assert (r.rule, r.verdict, r.p_block) == (*rule, None)
        else:
            assert r.rule is None
            p = brute_block(model, host, path) if len(path) < 10000 else r.p_block
            assert math.isclose(r.p_block, p, rel_tol=1e-9) and r.verdict == ("block" if p >= 0.5 else "allow")


@pytest.fixture(scope="module")
def url_model(spark):
    return urls.train(url_labels.table(spark))


def test_urls_edge_cases(spark, url_model):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS + URLS[:6])], "page_id long, url string")
    for c in ("host", "path", "rule", "verdict", "row", "p_block", "by"):
        df = df.withColumn(c, F.lit(1))
    rules = [urls.parse_rule(line) for line in URL_RULES]
    got = urls.judge(df, url_model, rules, keep=["page_id", "url", "host"]).collect()
    assert sorted(r.page_id for r in got) == list(range(len(URLS) + 6)) and all(r["row"]["host"] == 1 for r in got)
    same_verdicts(got, url_model, URL_RULES)
    assert urls.judge(df.where("false"), url_model, rules).count() == 0
    none = {r.verdict for r in urls.judge(df, url_model, []).collect()}
    assert none == {"allow", "block"}


def test_url_query(spark, url_model):
    df = QUERIES["op12_url_filter"](spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet"), "page_id")
    got = df.collect()
    assert len(got) == spark.read.parquet(f"{SF}/pages.parquet").count()
    same_verdicts(got, url_model, URL_RULES)


def test_longest_rule_wins_and_ties():
    rules = [urls.parse_rule(x) for x in ("block B.com/xy", "allow a.b.com/", "allow b.com/xy", "block com/")]
    assert rules[0] == ("block", "b.com", "/xy")
    for bad in ("deny x/", "block x", "block /x"):
        with pytest.raises(ValueError):
            urls.parse_rule(bad)


def test_rule_ties(spark):
    rules = [urls.parse_rule(x) for x in ("block b.com/xy", "allow a.b.com/", "allow b.com/xy", "block com/")]
    df = spark.createDataFrame([("a.b.com", "/xyz"), ("b.com", "/xyz"), ("c.com", "/"), ("c.org", "/")], "h string, p string")
    got = [r.x and tuple(r.x) for r in df.select(urls.ruled(rules, F.col("h"), F.col("p")).alias("x")).collect()]
    assert got == [("a.b.com/", "allow"), ("b.com/xy", "block"), ("com/", "block"), None]


def test_url_model_on_held_out_rows(spark):
    """Each fifth of the labelled table, judged by a model of the rest (0.875 over several deals)."""
    rows = [(u, "block") for u in url_labels.BLOCK] + [(u, "allow") for u in url_labels.ALLOW]
    random.Random(0).shuffle(rows)
    right = 0
    for fold in range(5):
        model = urls.train(spark.createDataFrame([r for k, r in enumerate(rows) if k % 5 != fold], "url string, label string"))
        held = [r for k, r in enumerate(rows) if k % 5 == fold]
        p = model.probability(*(pa.array([brute_url(u)[j] for u, _ in held]) for j in (0, 1)))
        right += sum((x >= 0.5) == (y == "block") for x, (_, y) in zip(p, held))
    assert right / len(rows) > 0.8


def test_url_model_without_classes(spark):
    schema = "url string, label string"
    assert urls.train(spark.createDataFrame([], schema)).bias < 0
    assert urls.train(spark.createDataFrame([("http://a/", "block"), (None, "allow"), ("b", None)], schema)).bias > 0


# ---- collocations -----------------------------------------------------------

def brute_collocations(rows, least=10, top=2000, most=3, covered=50):
    counts, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for g in range(1, most + 1):
                for i in range(len(w) - g + 1):
                    counts[lang, tuple(w[i:i + g])] += 1
    candidates = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    hidden = set()
    for (lang, w), a in candidates.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                part = (lang, w[i:i + size])
                if 100 * a >= covered * candidates[part]:
                    hidden.add(part)
    out = []
    for (lang, w), a in candidates.items():
        if (lang, w) not in hidden:
            cuts = []
            for k in range(1, len(w)):
                left, right = counts[lang, w[:k]], counts[lang, w[k:]]
                cuts.append((1000000 * a * a // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            out.append((lang, " ".join(w), a, left, right, n[lang], score))
    ranked = []
    for lang in n:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        ranked += [(r[0], k, *r[1:]) for k, r in enumerate(own, 1)]
    return sorted(ranked)


def phrase_rows(rng):
    words = "a b c d The OF und über 中文 don't x-y".split()
    rows = []
    for _ in range(500):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!?", "\r\n", " ; "])
                       for _ in range(rng.randint(0, 40)))
        rows.append((rng.choice(["en", "en", "de", None, "und", "EN", ""]), text))
    rows += [("en", t) for _, t in edge_rows(rng)] + [("fr", None), ("fr", ""), ("fr", " .,")]
    return rows + rows[:10] + [("en", "z y " * 4000 + "z" * 5000)]


@pytest.mark.parametrize("bits,most,flush", [(64, 3, 2_000_000), (64, 4, 500), (9, 3, 300), (3, 3, 2_000_000), (64, 2, 2_000_000)])
def test_collocations(spark, bits, most, flush):
    """Also with so few bits that most fingerprints collide, and with many small flushes."""
    rows = phrase_rows(random.Random(7))
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    for c in CLASHES.split() + ["phrase", "f", "words", "rank"]:
        df = df.withColumn(c, F.lit(1))
    got = collocations.mine(df, most=most, shards=5, bits=bits, flush_tokens=flush).collect()
    want = brute_collocations(rows, most=most)
    assert len(want) > 30 and sorted(tuple(r) for r in got) == want
    small = collocations.mine(df, least=3, top=4, most=most, bits=bits, table_bits=10).collect()
    assert sorted(tuple(r) for r in small) == brute_collocations(rows, least=3, top=4, most=most)


def test_collocations_of_nothing(spark):
    df = spark.createDataFrame([], "lang string, text string")
    assert collocations.mine(df).count() == 0
    assert collocations.mine(spark.createDataFrame([(None, None), ("a", "")], "lang string, text string")).count() == 0


def test_collocation_arithmetic_is_exact(spark):
    """Products beyond 64 bits."""
    big = 3_000_000_000
    counts = spark.createDataFrame([("x", 0, "", big * 3), ("x", 1, "p", big), ("x", 1, "q", big + 1), ("x", 2, "p q", big - 1)],
                                   "lang string, words int, phrase string, f long")
    r = collocations.scored(counts, top=5, most=2, covered=50).first()
    assert (r.a, r.l, r.r, r.score) == (big - 1, big, big + 1, 1000000 * (big - 1) ** 2 // (big * (big + 1)))
