"""Toxicity by a weighted finite-state pattern grammar.

Words become class symbols: insults and threats by their stems, targets,
negations and verbs of saying by lists.  Clauses that hold an insult or a
threat run through the composed transducers of ``grammar``; each comes out
with a pattern (threatening or insulting, how often, aimed at somebody,
negated, reported) and the strength of its strongest stem.  A document's
log-odds are a bias plus the weights of its clauses' patterns, in proportion
to strength; words outside a matched clause count nothing.

Learned from labelled rows: the stems (beginnings of words that toxic
documents share and clean ones lack, beside the lists below), their strengths,
and the weights of the patterns.  Learning reads a seeded sample of at most
``FIT_ROWS`` labelled rows (the documented bound), one text per family of
copies.  At most ``CANDIDATES`` stems are considered and ``MOST_STEMS`` kept,
those of the greatest likelihood ratio; scoring reads everything.

Defined cases: null text counts as empty; a text without matched clause scores
the bias alone; labels other than 0 and 1 are not used; without labels of both
kinds the lists score with fixed weights.  Texts are scanned whole, however
long.  Repeated rows score alike; as copies they are learned from once.  Ties
between stems go to the first by code point.  An empty table gives no rows.
Only the id and the text (and the labels' two columns) are read, so other
columns and their names don't matter.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from . import grammar as G
from . import textkernel as tk
from .tables import land

FIT_ROWS = 16_000
#: Bytes of a stem, from and to; toxic documents that must share one; how
#: surprising that must be (the likelihood ratio statistic; millions of word
#: beginnings are tried); most stems.
STEM_BYTES = range(3, 9)
LEAST_DOCS = 4
LEAST_RATIO = 30.0
MOST_STEMS = 1024
CANDIDATES = 16 * MOST_STEMS
#: Least hashes of word pairs that texts of one family share.
MIN_HASHES = 3
#: Log-odds above which a word's beginning is a stem.
LEAST_STRENGTH = 3.0
PRIOR_STRENGTH = 4.0

# Fixed word lists (English, German, French, Spanish), whole words in lower case.
INSULTS = """idiot idiots moron morons stupid dumb imbecile loser losers trash garbage scum clown pathetic worthless
disgusting filthy vermin bastard bitch fool dumbass asshole idiotisch dumm abschaum versager arschloch trottel
crétin imbécile connard salope ordure idiota estúpido estúpida imbécil basura escoria""".split()
THREATS = """kill hurt destroy murder beat stab shoot burn strangle töten umbringen vernichten zerstören tuer détruire
brûler frapper matar destruir golpear quemar""".split()
TARGETS = """you your yours yourself he she him her they them their people those du dich dir ihr euch dein sie ihnen tu
toi vous votre ton ils elles leur usted ustedes tú ellos ellas""".split()
NEGATIONS = """not no never nobody neither nor without nicht kein keine nie niemals ohne pas jamais sans aucun nunca
jamás sin tampoco""".split()
REPORTS = """said says wrote writes claimed claims called quoted according allegedly reported sagte schrieb nannte
behauptete laut dit écrit déclaré selon appelé dijo escribió llamó según afirmó""".split()

_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?;:\n"]] = True
PATTERNS = [(kind, aimed, negated, reported) for kind in (0, 1) for aimed in (0, 1) for negated in (0, 1)
            for reported in (0, 1)]
_NUMBER = {p: k for k, p in enumerate(PATTERNS)}
FIRST_WEIGHTS = [1.0 + 0.5 * kind + 0.25 * aimed - 0.75 * negated - 0.5 * reported
                 for kind, aimed, negated, reported in PATTERNS]
_U = np.uint64


def _hashes(strings: list[str]) -> np.ndarray:
    return tk.words(pa.array(strings, pa.string()), tk.NOT_ALNUM).hash


def _prefixes(w: tk.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of at least ``size`` bytes, and the hash of their first ``size``."""
    at = np.flatnonzero(w.end - w.start >= size)
    with np.errstate(over="ignore"):
        value = np.zeros(len(at), dtype=_U)
        power = _U(1)
        for k in range(size):
            value += (w.data[w.start[at] + k].astype(_U) + _U(1)) * power
            power = power * _U(tk._R)
    return at, tk.mix64(value)


@dataclass
class Model:
    """Stems with their strengths (insults and threats), pattern weights and bias."""

    stems: dict[str, float]
    threats: dict[str, float]
    weights: list[float] = field(default_factory=lambda: list(FIRST_WEIGHTS))
    bias: float = -3.0

    def __post_init__(self) -> None:
        self.automaton = G.compose()
        tables: dict[int, list[tuple[int, int, float]]] = defaultdict(list)
        for words, kind in ((self.stems, G.INSULT), (self.threats, G.THREAT)):
            for stem, strength in words.items():
                tables[len(stem.encode())].append((int(_prefix_hash(stem)), kind, strength))
        self.by_size = {}
        for size, rows in tables.items():
            rows.sort()
            self.by_size[size] = (np.array([r[0] for r in rows], dtype=_U), np.array([r[1] for r in rows]),
                                  np.array([r[2] for r in rows]))
        function = [(h, s) for words, s in ((TARGETS, G.TARGET), (NEGATIONS, G.NEGATION), (REPORTS, G.REPORT))
                    for h in _hashes(words).tolist()]
        function.sort()
        self.function = np.array([h for h, _ in function], dtype=_U)
        self.function_symbol = np.array([s for _, s in function], dtype=np.uint8)

    def symbols(self, w: tk.Words) -> tuple[np.ndarray, np.ndarray]:
        """Class symbol and strength of each word."""
        symbol = np.zeros(len(w.hash), dtype=np.uint8)
        strength = np.zeros(len(w.hash))
        k = np.minimum(np.searchsorted(self.function, w.hash), len(self.function) - 1)
        known = self.function[k] == w.hash
        symbol[known] = self.function_symbol[k[known]]
        for size, (keys, kind, weight) in self.by_size.items():
            at, value = _prefixes(w, size)
            if not len(at):
                continue
            k = np.minimum(np.searchsorted(keys, value), len(keys) - 1)
            hit = (keys[k] == value) & (weight[k] > strength[at])
            symbol[at[hit]] = kind[k[hit]]
            strength[at[hit]] = weight[k[hit]]
        return symbol, strength

    def clauses(self, column: pa.Array) -> Iterator[tuple[int, int, float, tuple[int, int]]]:
        """``(text, pattern, strength, byte span)`` of each matched clause."""
        w = tk.words(column, tk.NOT_ALNUM)
        if not len(w.hash):
            return
        symbol, strength = self.symbols(w)
        found = np.flatnonzero((symbol == G.INSULT) | (symbol == G.THREAT))
        if not len(found):
            return
        stops = np.concatenate([[0], np.cumsum(_STOP[w.data])])
        new = np.ones(len(w.hash), dtype=bool)
        new[1:] = stops[w.start[1:]] > stops[w.end[:-1]]
        border = w.first[:-1]
        new[border[border < len(new)]] = True
        begins = np.flatnonzero(new)
        ends = np.append(begins[1:], len(new))
        clause = np.unique(np.searchsorted(begins, found, side="right") - 1)
        text = np.searchsorted(w.first, begins[clause], side="right") - 1
        offsets = tk.utf8(column)[1]
        for c, doc in zip(clause.tolist(), text.tolist()):
            a, b = int(begins[c]), int(ends[c])
            insults, threat, aimed, negated, reported = self.automaton.run(symbol[a:b].tolist())
            if not insults and not threat:
                continue
            power = float(strength[a:b].max()) * (1 + 0.25 * max(0, insults - 1))
            yield (doc, _NUMBER[threat, aimed or threat, negated, reported], power,
                   (int(w.start[a] - offsets[doc]), int(w.end[b - 1] - offsets[doc])))

    def features(self, column: pa.Array) -> np.ndarray:
        out = np.zeros((len(column), len(PATTERNS)))
        for doc, pattern, power, _ in self.clauses(column):
            out[doc, pattern] += power
        return out / 4.0

    def score(self, features: np.ndarray) -> np.ndarray:
        z = self.bias + features @ np.array(self.weights)
        return 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))


def _prefix_hash(stem: str) -> int:
    w = tk.words(pa.array([stem], pa.string()), np.zeros(256, dtype=bool))
    return int(_prefixes(w, len(stem.encode()))[1][0])


def _count_stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per chunk: in how many toxic and clean texts each word beginning occurs."""
    for whole in batches:
        for batch in tk.chunks(whole, "text"):
            w = tk.words(batch.column("text"), tk.NOT_ALNUM)
            y = batch.column("label").to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(w.first))
            stems, toxic, clean = [], [], []
            for size in STEM_BYTES:
                at, value = _prefixes(w, size)
                _, once = np.unique(np.stack([value, doc[at].astype(_U)]), axis=1, return_index=True) \
                    if len(at) else (None, np.zeros(0, dtype=np.int64))
                value, at = value[once], at[once]
                keys, first, which = np.unique(value, return_index=True, return_inverse=True)
                bad = np.bincount(which, weights=y[doc[at]], minlength=len(keys)).astype(np.int64)
                every = np.bincount(which, minlength=len(keys))
                for k, b, n in zip(first.tolist(), bad.tolist(), every.tolist()):
                    a = w.start[at[k]]
                    stems.append(w.data[a:a + size].tobytes())
                    toxic.append(b)
                    clean.append(n - b)
            yield pa.RecordBatch.from_pydict({"stem": pa.array(stems, pa.binary()), "toxic": pa.array(toxic, pa.int64()),
                                              "clean": pa.array(clean, pa.int64())})


def _families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds a hash of the ``MIN_HASHES`` least hashes of a text's word pairs,
    each of its own hash function: near copies mostly share them all, texts
    with a common pair or two don't."""
    for whole in batches:
        for batch in tk.chunks(whole, "text"):
            w = tk.words(batch.column("text"), tk.NOT_ALNUM)
            with np.errstate(over="ignore"):
                pair = tk.mix64(w.hash[:-1] * _U(0x100000001B3) + w.hash[1:]) if len(w.hash) else w.hash
                mixed = [pair, *(tk.mix64(pair + _U(j)) for j in range(1, MIN_HASHES))]
            family = np.zeros(batch.num_rows, dtype=_U)
            for k, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist())):
                if b - a > 1:
                    for x in mixed:
                        family[k:k + 1] = tk.mix64(family[k:k + 1] ^ x[a:b - 1].min())
                elif b > a:
                    family[k] = w.hash[a]
            yield pa.RecordBatch.from_pydict({"text": batch.column("text"), "label": batch.column("label"),
                                              "family": pa.array(family.view(np.int64))})


def choose(rows: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Stems that mark toxic texts, with log-odds as strengths.

    The purest and most frequent come first, longer before shorter; a longer
    form of a chosen stem adds nothing, and a shorter one must earn its place
    by texts that the chosen longer ones leave."""
    def strength(t: float, c: float) -> float:
        return math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))

    def surprise(t: float, c: float) -> float:
        share = toxic / (toxic + clean)
        own = t / (t + c)
        return 2 * (t * math.log(own / share) + (c * math.log((1 - own) / (1 - share)) if c else 0.0))

    chosen: dict[str, float] = {}
    ratio: dict[str, float] = {}
    explained: dict[str, int] = defaultdict(int)
    for stem, t, c in sorted(rows, key=lambda r: (-round((r[1] + 0.5) / (r[1] + r[2] + 1), 2), -r[1], -len(r[0]), r[0])):
        if any(stem[:k] in chosen for k in range(1, len(stem))):
            continue
        left = t - explained[stem]
        power = strength(max(left, 0), c)
        if left < LEAST_DOCS or power < LEAST_STRENGTH or surprise(left, c) < LEAST_RATIO:
            continue
        chosen[stem], ratio[stem] = power, surprise(left, c)
        for k in range(1, len(stem)):
            explained[stem[:k]] += left
    most = sorted(chosen, key=lambda s: (-ratio[s], s))[:MOST_STEMS]
    return {s: chosen[s] for s in most} if len(chosen) > MOST_STEMS else chosen


def logistic(x: np.ndarray, y: np.ndarray, start: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights and bias (last) by Newton steps, drawn towards ``start``."""
    x = np.column_stack([x, np.ones(len(x))])
    w = start.copy()
    pull = np.full(len(w), ridge)
    pull[-1] = 1e-3
    loss = lambda v: (np.logaddexp(0, x @ v) - y * (x @ v)).sum() + 0.5 * (pull * (v - start) ** 2).sum()
    now = loss(w)
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(pull), x.T @ (p - y) + pull * (w - start))
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        now = loss(w)
        if np.abs(size * step).max() < 1e-8:
            break
    return w


def _features_of(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tk.chunks(whole, "text"):
                x = model.value.features(batch.column("text"))
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
                yield pa.RecordBatch.from_pydict({"label": batch.column("label"),
                                                  "x": pa.ListArray.from_arrays(offsets, pa.array(x.reshape(-1)))})
    return run


def train(docs: DataFrame, labels: DataFrame, used: Column | None = None, rows: int = FIT_ROWS, seed: int = 42,
          id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Model from at most ``rows`` labelled rows, those least by a seeded hash."""
    spark = docs.sparkSession
    ship_package(spark)
    y = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("long").alias("label")) \
              .where("label in (0, 1) and doc_id is not null")
    y = y.where(used) if used is not None else y
    picked = y.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "label").limit(rows)
    text = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    sample = text.join(F.broadcast(picked), "doc_id").select("text", "label")  # at most ``rows`` ids
    # copies of one toxic text would make all its words look toxic: one text of a family counts
    sample = land(sample.mapInArrow(_families, "text string, label long, family long")
                  .groupBy("family", "label").agg(F.min(F.struct(F.xxhash64(F.lit(seed), "text"), "text")).alias("one"))
                  .select("one.text", "label"), "toxicity-sample")
    counts = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    model = Model({s: PRIOR_STRENGTH for s in INSULTS}, {s: PRIOR_STRENGTH for s in THREATS})
    if not toxic or not clean:
        return model
    t, c, share = F.col("toxic"), F.col("clean"), toxic / (toxic + clean)
    ratio = 2 * (t * F.log(t / (t + c) / share) + F.when(c > 0, c * F.log(c / (t + c) / (1 - share))).otherwise(0.0))
    stems = (sample.mapInArrow(_count_stems, "stem binary, toxic long, clean long").groupBy("stem")
             .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
             .where(F.col("toxic") >= LEAST_DOCS)
             .where((F.col("toxic") + 0.5) / (toxic + 1) >= math.exp(LEAST_STRENGTH) * (F.col("clean") + 0.5) / (clean + 1))
             .where(ratio >= LEAST_RATIO)
             .orderBy(ratio.desc(), "stem").limit(CANDIDATES).collect())
    found = [(s, r.toxic, r.clean) for r in stems if (s := bytes(r.stem).decode("utf-8", "ignore")).encode() == bytes(r.stem)]
    learned = choose(found, toxic, clean)
    # a listed word that the labels speak against keeps no strength of its own
    listed = {s: PRIOR_STRENGTH for s in INSULTS if not any(s[:k] in learned for k in range(1, len(s) + 1))}
    model = Model({**listed, **learned}, model.threats)
    held = spark.sparkContext.broadcast(model)
    fitted = sample.mapInArrow(_features_of(held), "label long, x array<double>")
    sparse = fitted.groupBy("x", "label").count().collect()   # patterns repeat: most are all zero
    x = np.array([r.x for r in sparse])
    y01 = np.array([r.label for r in sparse], dtype=float)
    n = np.array([r["count"] for r in sparse])
    start = np.array([*FIRST_WEIGHTS, math.log((toxic + 0.5) / (clean + 0.5)) - 2.0])
    w = logistic(np.repeat(x, n, axis=0), np.repeat(y01, n), start)
    return Model(model.stems, model.threats, w[:-1].tolist(), float(w[-1]))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tk.chunks(whole, "text"):
                column = batch.column("text")
                x = np.zeros((len(column), len(PATTERNS)))
                spans: list[list[dict]] = [[] for _ in range(len(column))]
                for doc, pattern, power, (a, b) in model.value.clauses(column):
                    x[doc, pattern] += power / 4.0
                    spans[doc].append({"start": a, "end": b, "pattern": pattern})
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"),
                                                  "score": pa.array(model.value.score(x)),
                                                  "clauses": pa.array(spans, _SPANS)})
    return run


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("pattern", pa.int64())]))


def score(docs: DataFrame, labels: DataFrame, used: Column | None = None, id_col: str = "doc_id",
          text_col: str = "text", **options) -> DataFrame:
    """``doc_id, score, clauses`` for every row: clauses are byte spans with
    the number of their pattern in ``PATTERNS``."""
    model = train(docs, labels, used, id_col=id_col, text_col=text_col, **options)
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    out = T.StructType([rows.schema["doc_id"], T.StructField("score", T.DoubleType()),
                        T.StructField("clauses", T.ArrayType(T.StructType(
                            [T.StructField(n, T.LongType()) for n in ("start", "end", "pattern")])))])
    return rows.mapInArrow(_score(held), out)


#: What each transducer beside the insults' marks in a pattern.
MARKS = ("threat", "aimed", "negated", "reported")


def _without(mark: int) -> np.ndarray:
    """Each pattern's number once that mark is taken off."""
    return np.array([_NUMBER[tuple(0 if k == mark else x for k, x in enumerate(p))] for p in PATTERNS])


def _losses(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        marked, loss, rows = np.zeros(len(MARKS), dtype=np.int64), np.zeros(1 + len(MARKS)), 0
        for whole in batches:
            for batch in tk.chunks(whole, "text"):
                x, weights = m.features(batch.column("text")), np.array(m.weights)
                y = batch.column("label").to_numpy(zero_copy_only=False)
                rows += len(y)
                for k, w in enumerate([weights, *(weights[_without(j)] for j in range(len(MARKS)))]):
                    z = m.bias + x @ w
                    loss[k] += (np.logaddexp(0, z) - y * z).sum()
                for j in range(len(MARKS)):
                    own = [k for k, p in enumerate(PATTERNS) if p[j]]
                    marked[j] += int((x[:, own] > 0).any(axis=1).sum())
        yield pa.RecordBatch.from_pydict({
            "transducer": list(MARKS), "documents": pa.array(marked), "rows": pa.array([rows] * len(MARKS), pa.int64()),
            "loss": pa.array([loss[0]] * len(MARKS)), "loss_without": pa.array(loss[1:])})
    return run


def ablation(docs: DataFrame, labels: DataFrame, model: Model, used: Column | None = None, id_col: str = "doc_id",
             text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """What each transducer adds on labelled rows (``used``: which, e.g. held
    out ones): ``transducer, rows, documents`` that have its mark, the mean
    log loss as it is and with the mark taken off every pattern, and ``idle``
    (no document has it).  Sums by task; one exchange of texts by id."""
    ship_package(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    y = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("long").alias("label")) \
              .where("label in (0, 1) and doc_id is not null")
    y = y.where(used) if used is not None else y
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).join(y, "doc_id")
    sums = rows.select("text", "label").mapInArrow(
        _losses(held), "transducer string, documents long, rows long, loss double, loss_without double")
    return sums.groupBy("transducer").agg(
        F.sum("rows").alias("rows"), F.sum("documents").alias("documents"),
        F.try_divide(F.sum("loss"), F.sum("rows")).alias("loss"),
        F.try_divide(F.sum("loss_without"), F.sum("rows")).alias("loss_without"),
        (F.sum("documents") == 0).alias("idle"))
