"""The registered queries on driver tables: against DuckDB where SQL can say
it, else against brute force on the smallest tables."""

import itertools
import math
import os
import re
import sys
import zlib
from collections import Counter, defaultdict

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

from test_operators import brute_components, brute_hits, brute_model, brute_print, brute_trigrams, fill  # noqa: E402

from sentspark.llm.catalog import QUERIES  # noqa: E402
from sentspark.llm.oracle import ORACLE  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_one_query_an_operator():
    numbers = [int(re.match(r"op(\d+)_\w+$", q).group(1)) for q in QUERIES]
    assert sorted(numbers) == list(range(1, 14)) and set(ORACLE) <= set(QUERIES)


def test_sql_twins(spark):
    from oracle_check import compare
    result = compare(spark, "/root/testdata/sf0.01", keys=sorted(ORACLE), verbose=False)
    assert all(v[0] == "OK" for v in result.values()), result


def test_op1(spark, documents):
    from tokenizers import Tokenizer
    from sentspark.llm.tokenizers_public import file_path
    t = Tokenizer.from_file(file_path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in QUERIES["op1_token_files"](spark, SF).collect()}
    at = 0
    for i, text, _ in sorted(documents):
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(raw))
        at += len(ids)
    assert len(got) == len(documents)


def test_op5(spark, documents):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _, _ in documents}
    texts = [t for i, t, _ in documents if not held[i]], [t for _, t, _ in documents]
    want, of_three = brute_model(*texts)[0], brute_trigrams(*texts)[0]
    got = {r.doc_id: r for r in QUERIES["op5_ngram_scores"](spark, SF).collect()}
    for (i, _, _), (n, known, total, base, _), score in zip(documents, want, of_three):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9)
    apart = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in apart) > sum(r.base_score for r in apart)


@pytest.mark.parametrize("query,label,parts,remainder,threshold", [
    ("op3_toxicity", "toxic", 3, 1, 0.7), ("op6_quality", "quality", 5, 0, 0.3)])
def test_classifiers_on_held_out_rows(spark, query, label, parts, remainder, threshold):
    folder = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in QUERIES[query](spark, folder).collect()}
    y = {r.doc_id: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    for r in got.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == remainder)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
    held = [(got[i].score, v, got[i].predicted) for i, v in y.items() if i in got and got[i].held_out]
    ones, zeros = [s for s, v, _ in held if v], [s for s, v, _ in held if not v]
    area = sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))
    assert area > 0.95 and sum(v == p for _, v, p in held) / len(held) > 0.95


def test_op8(spark, documents):
    got = {r.doc_id: r for r in QUERIES["op8_simhash_near_dedup"](spark, SF).collect()}
    prints = [brute_print(t) for _, t, _ in documents]
    comp = brute_components(prints, 2)
    least = defaultdict(list)
    for (i, _, _), c in zip(documents, comp):
        least[c].append(i)
    for (i, _, _), p, c in zip(documents, prints, comp):
        assert (got[i].fingerprint, got[i].component_id) == (f"{p:016x}", min(least[c]))


def test_op9(spark, documents):
    import sentencepiece
    from sentspark.llm.tokenizers_public import file_path
    sp = sentencepiece.SentencePieceProcessor(model_file=file_path("piece_bpe_32k.model"))
    got = Counter(tuple(r) for r in QUERIES["op9_token_counts"](spark, SF).collect())
    assert got == Counter((i, len((t or "").encode()), (n := len(sp.encode(t or ""))), n > 4096) for i, t, _ in documents)


def test_op10(spark, documents):
    got = QUERIES["op10_mix_sources"](spark, SF).collect()
    size = {i: len(re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, t, _ in documents}
    source = {i: s for i, _, s in documents}
    total, taken = Counter(), Counter()
    for i, n in size.items():
        total[source[i]] += n
    want = fill(total)
    for r in got:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], total[s]) and math.isclose(r.target, want[s], rel_tol=1e-12)
        assert r.taken % max(1, r.size) == 0 and r.taken <= 3 * r.size
        taken[s] += r.taken
    assert len(got) == len(documents)
    for s in total:     # as near as the source's ten documents, taken whole times or once more, can come
        own = [size[i] for i in size if source[i] == s]
        whole = min(int(want[s] // total[s]), 3)
        rest = want[s] - whole * total[s]
        nearest = min(abs(sum(c) - rest) for n in range(len(own) + 1) for c in itertools.combinations(own, n)) \
            if whole < 3 else rest
        assert abs(taken[s] - want[s]) <= nearest + 1


def test_pipeline(spark):
    """Each stage against brute force over what its predecessor kept."""
    import corpus_pipeline as P
    from sentspark.llm import mixing, quality
    from sentspark.llm.tables import land
    from sentspark.llm.catalog import held_out
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality", "near_dedup", "decontaminate", "mix", "tokens"]
    stage = dict(P.STAGES)
    rows = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    kept = land(stage["quality"](spark, docs, folder), "t1")
    scores = {r.doc_id: r.score for r in quality.score(docs, labels, used=~held_out(5, 0)).collect()}
    assert sorted(rows(kept)) == sorted((i, t) for i, t in rows(docs) if scores[i] >= P.QUALITY)
    unique = land(stage["near_dedup"](spark, kept, folder), "t2")
    before = rows(kept)
    least = {}
    for (i, t), c in zip(before, brute_components([brute_print(t) for _, t in before], 2)):
        least[c] = min(least.get(c, (i, t)), (i, t))
    assert sorted(rows(unique)) == sorted(least.values())
    clean = land(stage["decontaminate"](spark, unique, folder), "t3")
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    hits = {i: h for i, _, h, _ in brute_hits(rows(unique), items)}
    assert sorted(rows(clean)) == sorted((i, t) for i, t in rows(unique) if not hits[i])
    mixed = land(stage["mix"](spark, clean, folder), "t4")
    copies = {r.doc_id: r.copies for r in mixing.annotate(clean).collect()}
    assert Counter(rows(mixed)) == Counter({(i, t): copies[i] for i, t in rows(clean) if copies[i]})
    for df in (kept, unique, clean, mixed):
        assert df.columns == docs.columns
    from tokenizers import Tokenizer
    from sentspark.llm.tokenizers_public import file_path
    t = Tokenizer.from_file(file_path("byte_bpe_50k.json"))
    want, at = [], 0
    for i, text in sorted(rows(mixed)):
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((i, at, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        at += len(ids)
    assert sorted(tuple(r) for r in P.run(spark, folder).collect()) == want


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_edge_cases(spark, empty):
    """Nulls, empty and long texts, copies, repeated rows, clashing columns; and no rows at all."""
    import random

    import corpus_pipeline as P
    from sentspark.llm.tables import land
    from test_operators import CLASHES, docs as make, edge_rows
    rows = [] if empty else edge_rows(random.Random(5))
    df = land(make(spark, rows, CLASHES), "edge")
    columns = df.columns
    for name, stage in P.STAGES:
        before, df = df.count(), land(stage(spark, df, SF), f"edge-{name}")
        if name != "tokens":
            assert df.columns == columns
        if name in ("quality", "near_dedup", "decontaminate"):
            assert df.count() <= before
        if name == "tokens":
            assert df.count() == before
    assert (df.count() == 0) == empty
    if not empty:
        total = df.selectExpr("max(start + n_tokens) as m", "sum(n_tokens) as s").first()
        assert total.m == total.s
