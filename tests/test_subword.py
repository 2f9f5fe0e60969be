"""Subword vocabulary and tokenizer (T3, T4) against plain Python."""

import pickle
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sentspark.operators import features as FE
from sentspark.operators import subword as SW
from sentspark.operators import tokenizing as TK
from sentspark.operators.trie import FlatTrie
from sentspark.plans import standins as S

SF = "/root/testdata/sf0.001"


def brute_subwords(texts, vocab_size, min_count=2):
    """One merge at a time over all words; ties by the pair."""
    words = Counter(w for t in texts if t is not None for w in t.split(" ") if w)
    split = [([w[0], *("##" + c for c in w[1:])], n) for w, n in words.items()]
    letters = Counter()
    for s, n in split:
        for c in s:
            letters[c] += n
    room = vocab_size - FE.N_SPECIAL
    out = dict(sorted(letters.items(), key=lambda r: (-r[1], r[0]))[:room])
    while len(out) < room:
        pairs = Counter()
        for s, n in split:
            for p in zip(s, s[1:]):
                pairs[p] += n
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p))
        if pairs[best] < min_count:
            break
        out.setdefault(best[0] + best[1].removeprefix("##"), pairs[best])
        after = []
        for s, n in split:
            new, i = [], 0
            while i < len(s):
                if tuple(s[i:i + 2]) == best:
                    new.append(best[0] + best[1].removeprefix("##"))
                    i += 2
                else:
                    new.append(s[i])
                    i += 1
            after.append((new, n))
        split = after
    return [(t, FE.N_SPECIAL + k, n) for k, (t, n) in enumerate(out.items())]


def brute_encode(text, ids, max_length):
    out = []
    for word in (text or "").split(" "):
        if not word:
            continue
        pieces, at = [], 0
        while at < len(word) and len(word.encode()) <= TK.MOST_WORD_BYTES:
            mark = "##" if at else ""
            end = next((e for e in range(len(word), at, -1) if mark + word[at:e] in ids), None)
            if end is None:
                break
            pieces.append(ids[mark + word[at:end]])
            at = end
        out += pieces if at == len(word) else [FE.UNK_ID]
    return [FE.CLS_ID, *out[:max_length - 2], FE.SEP_ID]


def corpus(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k long, sentence string")


@pytest.mark.parametrize("active,most_pieces", [(4096, 100_000), (3, 100_000), (1, 100_000), (64, 20)])
def test_merges_equal_brute_force(spark, active, most_pieces):
    """Whatever the number of pairs in a round, ties and runs of one letter included."""
    rng = random.Random(active)
    texts = [" ".join("".join(rng.choice("aab한é#😀") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 8)))
             for _ in range(60)] + [None, "", "   ", "aaaa aaaaa aaaaaaa", "a"]
    got = SW.learn_subwords(corpus(spark, texts), vocab_size=70, active=active, most_pieces=most_pieces).orderBy("id")
    assert [tuple(r) for r in got.collect()] == brute_subwords(texts, 70)


def test_merges_equal_brute_force_on_the_corpus(spark):
    w = S.wiki_sentences(spark, SF)
    texts = [r.sentence for r in w.collect()]
    got = SW.learn_subwords(w, vocab_size=300).orderBy("id").collect()
    assert [tuple(r) for r in got] == brute_subwords(texts, 300)


def test_queries_equal_brute_force(spark):
    """The registered queries on the smallest tables: every row."""
    from sentspark.plans import catalog as Q
    rows = {(r.doc_id, r.pos): r.sentence for r in S.wiki_sentences(spark, SF).collect()}
    want = brute_subwords(rows.values(), 400)
    old, Q.SUBWORD_SIZE = Q.SUBWORD_SIZE, 400     # the plain learner takes minutes for 2,048 entries
    try:
        got = Q.QUERIES["subword_vocab"](spark, SF).orderBy("id").collect()
        encoded = Q.QUERIES["subword_encode"](spark, SF).collect()
    finally:
        Q.SUBWORD_SIZE = old
    assert [tuple(r) for r in got] == want
    ids = {t: i for t, i, _ in want}
    assert len(encoded) == len(rows)
    for r in encoded:
        x = brute_encode(rows[r.doc_id, r.pos], ids, FE.MAX_SEQ_LENGTH)
        assert r.input_ids == ",".join(map(str, x + [FE.PAD_ID] * (FE.MAX_SEQ_LENGTH - len(x))))


def test_learning_ends(spark):
    few = SW.learn_subwords(corpus(spark, ["ab ab", "ab c"]), vocab_size=100).orderBy("id").collect()
    assert [(r.token, r.cnt) for r in few] == [("##b", 3), ("a", 3), ("c", 1), ("ab", 3)]
    assert SW.learn_subwords(corpus(spark, ["abc"]), vocab_size=FE.N_SPECIAL + 2).count() == 2
    assert SW.learn_subwords(corpus(spark, []), vocab_size=100).count() == 0
    with pytest.raises(ValueError):
        SW.learn_subwords(corpus(spark, ["a"]), vocab_size=FE.N_SPECIAL)


def test_subword_encoding(spark):
    rng = random.Random(9)
    alphabet = "abcé한"
    ids = {}
    for _ in range(200):
        ids.setdefault(rng.choice(["", "##"]) + "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 4))), len(ids) + 5)
    texts = [" ".join("".join(rng.choice(alphabet + "x") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(0, 6)))
             for _ in range(300)] + [None, "", "  ", "a" * 500, "b" * 300, "#", "##", "##a"]
    vocab = spark.createDataFrame(list(ids.items()), "token string, id int")
    t = SW.subword_tokenizer(vocab)
    for length in (2, 6, 64):
        got = {r.k: r.input_ids for r in FE.encode(corpus(spark, texts), "sentence", t, ["k"], max_length=length, pad=False).collect()}
        assert [got[i] for i in range(len(texts))] == [brute_encode(x, ids, length) for x in texts]
    assert t(["a"], 8) == [brute_encode("a", ids, 8)]


def test_trie_finds_what_was_put_in():
    rng = random.Random(4)
    words = list({"".join(rng.choice("abcde") for _ in range(rng.randint(0, 7))).encode() for _ in range(3000)})
    trie = FlatTrie.build(words, np.zeros(len(words), int), np.arange(len(words)))
    known = {w: k for k, w in enumerate(words) if w}
    asked = words + [w + b"f" for w in words] + [b"z", b"\xff"]
    data = np.frombuffer(b"".join(asked), dtype=np.uint8)
    end = np.cumsum([len(w) for w in asked])
    got = trie.whole(data, end - [len(w) for w in asked], end)
    assert [known.get(w, -1) for w in asked] == got.tolist()
    empty = FlatTrie.build([], [], [])
    assert empty.whole(data, end[:2] - 1, end[:2]).tolist() == [-1, -1]
    twice = FlatTrie.build([b"a", b"a"], [0, 0], [7, 8])
    assert twice.whole(np.frombuffer(b"a", np.uint8), np.array([0]), np.array([1])).tolist() == [7]


def test_a_sent_trie_costs_its_name(spark):
    words = [f"w{i}" for i in range(20000)]
    t = TK.VocabTokenizer.of(words, range(5, 20005))
    t.trie.send(spark)
    raw = pickle.dumps(t)
    assert len(raw) < 500
    back = pickle.loads(raw)
    assert back(["w7 w19999 no"], 8) == [[FE.CLS_ID, 12, 20004, FE.UNK_ID, FE.SEP_ID]]
    assert pa.array(back(["w7"], 8)).to_pylist() == t(["w7"], 8)


def test_rows_are_merged_together():
    """A batch of words at once: runs of one letter, pairs that come up again, marks inside words."""
    rng = random.Random(5)
    def letters(w):
        return [c if i == 0 else "##" + c for i, c in enumerate(w)]
    for _ in range(40):
        words = ["".join(rng.choice("aab#é😀") for _ in range(rng.randint(1, 9))) for _ in range(30)]
        merges, now = [], [letters(w) for w in words]
        for _ in range(12):
            pairs = [p for s in now for p in zip(s, s[1:])]
            if not pairs:
                break
            merges.append(rng.choice(pairs))
            now = [SW.merge_symbols(s, merges[-1]) for s in now]
        symbols = SW.Symbols()
        first = pa.RecordBatch.from_pydict({"token": pa.array(words), "cnt": pa.array(range(len(words)), pa.int64())})
        packed = list(SW._lettered([first]))
        out, = SW._applied(symbols, merges)(packed)
        ids, size = SW._unpacked(out.column(0))
        names, ends = symbols.names(ids), np.cumsum(size)
        assert [names[e - n:e] for e, n in zip(ends, size)] == now


def test_words_are_not_merged_one_by_one(spark):
    """The passes over the words work on arrays: 100,000 words, 150 merges."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(100_000)]
    letters = [x for x in "abcdefgh"]
    merges = [(a, "##" + b) for a in letters for b in letters] + [("##" + a, "##" + b) for a in letters for b in letters]
    batch = pa.RecordBatch.from_pydict({"token": pa.array(words), "cnt": pa.array([1] * len(words), pa.int64())})
    begin = time.process_time()
    list(SW._applied(SW.Symbols(), merges)(SW._lettered([batch])))
    assert time.process_time() - begin < 2.0
