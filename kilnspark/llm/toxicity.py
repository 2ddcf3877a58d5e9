"""Toxic spans by a linear-chain conditional random field, and document scores from it.

Training sees a bounded, documented sample of the labelled rows of the training fold:

1. Spark counts, for every word and word beginning of the sampled texts, in how many toxic
   and clean documents it occurs; those tied to toxic documents beyond chance (a
   likelihood-ratio test corrected for the number of features) become the features.
2. Tokens of toxic documents that carry a feature are labelled toxic, all others clean; the
   CRF (feature weights, bias, transitions) is fitted to windows of such labelled tokens.
3. A logistic curve from the marginals to the document label is fitted on the sample.

Tagging runs over all texts: words without features all have the same potentials, so the
forward-backward recursion jumps from one evidence token to the next by a matrix power;
marginals at the evidence tokens are those of the whole chain. Labels are read only in
training; language, source and ids never enter a score.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import crc_mod, give_back, id_text, materialize, slices

#: Labelled rows that training looks at, at most (half of the budget for each label).
SAMPLE = 20_000
#: Labelled windows of tokens that the CRF is fitted to, at most, and their half width.
WINDOWS, REACH = 8_000, 6
#: How much more often a feature must occur in toxic texts than in clean ones.
LIFT = 20
#: Words whose evidence a worker keeps.
CACHE = 100_000
THRESHOLD = 0.3
PREFIXES = (4, 5, 6)
#: A marginal from which a token counts as offending.
SPAN_AT = 0.5

_WORD = re.compile(r"\w+")


def features(word: str) -> list[str]:
    """The word itself and its beginnings (marked ``^``), lower-cased."""
    return [word, *("^" + word[:n] for n in PREFIXES if len(word) >= n)]


@dataclass
class Tagger:
    """A fitted model; small (its weights are as many as the windows it is fitted to at most) whatever the corpus."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -6.0
    transitions: tuple[tuple[float, float], tuple[float, float]] = ((0.0, -1.0), (0.0, 0.0))
    curve: tuple[float, float, float] = (-4.0, 4.0, 2.0)

    def __post_init__(self):
        self._cache: dict[str, float | None] = {}
        t = np.exp(np.array(self.transitions, float))
        self._step = t * np.array([1.0, math.exp(self.bias)])  # past a token without features
        self._plain = t
        values, vectors = np.linalg.eig(self._step)
        self._eigen = (values.real, vectors.real, np.linalg.inv(vectors).real)
        self._powers: dict[int, np.ndarray] = {}

    def evidence(self, word: str) -> float | None:
        """Score of the toxic state at ``word``; None if no feature speaks."""
        if word not in self._cache:
            if len(self._cache) > CACHE:
                self._cache.clear()
            found = [self.weights[f] for f in features(word.lower()) if f in self.weights]
            self._cache[word] = self.bias + sum(found) if found else None
        return self._cache[word]

    def _jump(self, n: int) -> np.ndarray:
        """The n-th power of a plain step, scaled (only ratios matter)."""
        if n not in self._powers:
            if len(self._powers) > 10_000:
                self._powers.clear()
            values, left, right = self._eigen
            top = np.abs(values).max()
            self._powers[n] = (left * (values / top) ** n) @ right
        return self._powers[n]

    def marginals(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, probability of the toxic state) at each evidence token."""
        words = _WORD.findall(text)
        cache = self._cache
        at = []
        for i, w in enumerate(words):
            e = cache[w] if w in cache else self.evidence(w)
            if e is not None:
                at.append((i, e))
        if not at:
            return []
        last = len(words) - 1
        ahead, before, state = [], -1, np.ones(2)
        for n, (i, e) in enumerate(at):
            gap = i - before - 1
            if n or i:
                # the first token has no transition into it
                state = state * [1.0, math.exp(self.bias)] if before < 0 else state
                state = state @ (self._jump(gap - (before < 0)) if gap else np.eye(2)) @ self._plain
            state = state * [1.0, math.exp(min(e, 50.0))]
            state = state / state.sum()
            ahead.append(state)
            before = i
        out, after, state = [], None, np.ones(2)
        for (i, e), forward in zip(reversed(at), reversed(ahead)):
            if after is None:
                state = self._jump(last - i) @ np.ones(2) if last > i else np.ones(2)
            else:
                j, je = after
                state = self._plain @ (state * [1.0, math.exp(min(je, 50.0))])
                state = (self._jump(j - i - 1) @ state) if j - i > 1 else state
            state = state / state.sum()
            p = forward * state
            out.append((i, float(p[1] / p.sum())))
            after = (i, e)
        out.reverse()
        spans, k = [], 0
        for i, m in enumerate(_WORD.finditer(text)):
            if k < len(out) and out[k][0] == i:
                spans.append((m.start(), m.end(), out[k][1]))
                k += 1
                if k == len(out):
                    break
        return spans

    def score(self, spans: list[tuple[int, int, float]]) -> float:
        """The marginals of a document as one probability."""
        a, b, c = self.curve
        most = max((p for *_, p in spans), default=0.0)
        mass = sum(p for *_, p in spans)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * most + c * math.log1p(mass)))))


def fit_crf(windows: list[tuple[list[list[str]], list[int]]], rounds: int = 300, rate: float = 0.2, ridge: float = 1e-3) -> Tagger:
    """Maximum likelihood (ridge-penalised) over labelled token windows.

    A window is the features of each token and its labels. Deterministic; all windows are
    padded to one length and run through forward-backward together.
    """
    names = sorted({f for tokens, _ in windows for fs in tokens for f in fs})
    index = {f: i for i, f in enumerate(names)}
    n, length = len(windows), max(len(t) for t, _ in windows)
    mask = np.zeros((n, length), bool)
    gold = np.zeros((n, length), np.int64)
    rows, cols, feats = [], [], []
    for i, (tokens, labels) in enumerate(windows):
        mask[i, : len(tokens)] = True
        gold[i, : len(labels)] = labels
        for j, fs in enumerate(tokens):
            for f in fs:
                rows.append(i)
                cols.append(j)
                feats.append(index[f])
    rows, cols, feats = (np.array(x, np.int64) for x in (rows, cols, feats))
    theta = np.zeros(len(names) + 5)  # weights, bias, transitions
    moment, speed = np.zeros_like(theta), np.zeros_like(theta)
    tokens_seen = mask.sum()
    pairs = mask[:, 1:] & mask[:, :-1]
    seen = np.zeros_like(theta)
    np.add.at(seen, feats, gold[rows, cols])
    seen[len(names)] = (gold * mask).sum()
    for a in (0, 1):
        for b in (0, 1):
            seen[len(names) + 1 + 2 * a + b] = ((gold[:, :-1] == a) & (gold[:, 1:] == b) & pairs).sum()
    for round_ in range(1, rounds + 1):
        emit = np.full((n, length), theta[len(names)])
        np.add.at(emit, (rows, cols), theta[feats])
        pot = np.stack([np.zeros_like(emit), emit], axis=2)
        trans = theta[len(names) + 1 :].reshape(2, 2)
        ahead = np.zeros((n, length, 2))
        ahead[:, 0] = pot[:, 0]
        for t in range(1, length):
            step = np.logaddexp(ahead[:, t - 1, 0, None] + trans[0], ahead[:, t - 1, 1, None] + trans[1]) + pot[:, t]
            ahead[:, t] = np.where(mask[:, t, None], step, ahead[:, t - 1])
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        back = np.zeros((n, length, 2))
        expect = np.zeros_like(theta)
        for t in range(length - 2, -1, -1):
            ahead_of = trans[None] + (pot[:, t + 1] + back[:, t + 1])[:, None, :]
            step = np.logaddexp(ahead_of[:, :, 0], ahead_of[:, :, 1])
            back[:, t] = np.where(mask[:, t + 1, None], step, 0.0)
            joint = np.exp(ahead[:, t, :, None] + ahead_of - total[:, None, None])
            expect[len(names) + 1 :] += (joint * pairs[:, t, None, None]).sum(axis=0).reshape(4)
        p = np.exp(ahead[:, :, 1] + back[:, :, 1] - total[:, None]) * mask
        np.add.at(expect, feats, p[rows, cols])
        expect[len(names)] = p.sum()
        slope = (seen - expect) / tokens_seen - ridge * theta / 100
        moment = 0.9 * moment + 0.1 * slope
        speed = 0.999 * speed + 0.001 * slope**2
        theta += rate * (moment / (1 - 0.9**round_)) / (np.sqrt(speed / (1 - 0.999**round_)) + 1e-8)
    trans = theta[len(names) + 1 :].reshape(2, 2)
    return Tagger(dict(zip(names, theta[: len(names)].tolist())), float(theta[len(names)]), tuple(map(tuple, trans.tolist())))


def fit_curve(most: np.ndarray, mass: np.ndarray, label: np.ndarray, rounds: int = 50) -> tuple[float, float, float]:
    """Logistic regression (Newton steps, a light ridge) of the label on the marginals."""
    x = np.stack([np.ones(len(most)), most, np.log1p(mass)], axis=1)
    w = np.array([math.log((label.sum() + 1) / (len(label) - label.sum() + 1)), 0.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (label - p) - 0.1 * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3)
        step = np.linalg.solve(bend, slope)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(w.tolist())


def _sampled_texts(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """Distinct texts of a bounded sample of the training fold: ``toxic, text``."""
    fold = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic"))
    fold = fold.where(F.col("toxic").isin(0, 1) & (crc_mod(F.col("doc_id"), 4) != 2))
    fold = fold.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    picked = fold.where("toxic = 1").orderBy(*order).limit(sample // 2).unionByName(
        fold.where("toxic = 0").orderBy(*order).limit(sample // 2)
    )
    # at most ``sample`` rows of two numbers: bounded, so safe to broadcast
    texts = id_text(docs).join(F.broadcast(picked), "doc_id")
    # copies of one text would make its words look tied to its label; ids go no further, so
    # which copy stays has no effect
    return texts.groupBy(F.xxhash64("text"), "toxic").agg(F.min("text").alias("text")).select("toxic", "text")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, windows: int = WINDOWS) -> Tagger:
    """Fit on at most ``sample`` labelled rows whose crc32(doc_id) mod 4 is not 2.

    Of each text, one window is drawn around every word that carries features and one around
    a place that the text decides. At most ``windows`` of them, a third without features at
    their centre, are fitted; each feature has its share, so none is left without.

    Without toxic rows in that fold, the tagger knows no features and scores every text
    alike, at the low end. Null texts are empty, null labels are ignored, repeated labels
    of one document count once (toxic wins).
    """
    texts = materialize(_sampled_texts(docs, labels, sample))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        n = [0, 0]
        for b in slices(batches):
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n[label] += 1
                words = {w.lower() for w in _WORD.findall(text)}
                (toxic if label else clean).update({f for w in words for f in features(w)})
        toxic[""], clean[""] = n[1], n[0]
        names = [*toxic, *(f for f in clean if f not in toxic)]
        for at in range(0, len(names), 50_000):
            part = names[at : at + 50_000]
            yield pa.record_batch(
                [pa.array(part), pa.array([toxic[f] for f in part], pa.int64()), pa.array([clean[f] for f in part], pa.int64())],
                names=["f", "t", "c"],
            )

    counts = materialize(
        texts.select("toxic", "text").mapInArrow(count, "f string, t long, c long").groupBy("f").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).where("t > 0")
    )
    whole = counts.where("f = ''").first()
    if whole is None:
        return Tagger()
    toxic_docs, clean_docs = whole["t"], whole["c"]
    tested = counts.count()
    # twice the log likelihood ratio of one against two rates, for features of toxic texts
    share = toxic_docs / (toxic_docs + clean_docs)
    n = F.col("t") + F.col("c")
    term = lambda k, p: F.when(k > 0, k * F.log(k / (n * p))).otherwise(0.0)
    ratio = 2 * (term(F.col("t"), F.lit(share)) + term(F.col("c"), F.lit(max(1e-9, 1 - share))))
    known = (
        counts.where((F.col("f") != "") & (F.col("t") * clean_docs > LIFT * F.col("c") * toxic_docs))
        .select("f", ratio.alias("g"))
        .where(F.col("g") > 2 * math.log(20 * tested))
        .orderBy(F.desc("g"), "f")
        .limit(windows)  # each feature has a window of its own
        .collect()
    )
    lexicon = {r["f"] for r in known}
    if not lexicon:
        return Tagger()

    def label_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            out, golds, centres = [], [], []
            for label, text in zip(*(c.to_pylist() for c in b.columns)):
                tokens = [[f for f in features(w) if f in lexicon] for w in map(str.lower, _WORD.findall(text))]
                if not tokens:
                    continue
                at = {"": zlib.crc32(text.encode()) % len(tokens)}  # and one place for each kind of hit
                for i, fs in enumerate(tokens):
                    if fs:
                        at.setdefault(" ".join(fs), i)
                for name, centre in at.items():
                    low, high = max(0, centre - REACH), centre + REACH + 1
                    out.append(tokens[low:high])
                    golds.append([int(bool(label and fs)) for fs in tokens[low:high]])
                    centres.append(tokens[centre] if name else [])
            kinds = (pa.list_(pa.list_(pa.string())), pa.list_(pa.int32()), pa.list_(pa.string()))
            yield pa.record_batch([pa.array(c, k) for c, k in zip((out, golds, centres), kinds)], names=["x", "y", "centre"])

    drawn = texts.mapInArrow(label_windows, "x array<array<string>>, y array<int>, centre array<string>")
    drawn = drawn.withColumn("_as_text", F.to_json(F.struct("x", "y"))).withColumn("_h", F.xxhash64("_as_text"))
    shuffled = ["_h", "_as_text"]
    # the first window of each feature, then the second of each, ...: as many for a rare one
    turn = F.row_number().over(W.partitionBy("f").orderBy(*shuffled))
    hits = drawn.where(F.size("centre") > 0).withColumn("f", F.explode("centre")).withColumn("turn", turn)
    hits = hits.groupBy(*shuffled).agg(F.min("turn").alias("turn"))
    plain = drawn.where(F.size("centre") == 0).select(*shuffled)
    picked = hits.orderBy("turn", *shuffled).limit(windows - windows // 3).select(*shuffled).unionByName(
        plain.orderBy(*shuffled).limit(windows // 3)
    )
    read = [json.loads(r["_as_text"]) for r in picked.collect()]
    tagger = fit_crf([(r["x"], r["y"]) for r in read])
    told = tagged(texts.select(F.lit(0).cast("long").alias("doc_id"), "text", "toxic"), tagger, keep=["toxic"])
    told = told.select("most", "mass", "toxic").toPandas().sort_values(["most", "mass", "toxic"])  # bounded by the sample
    tagger.curve = fit_curve(*(told[c].to_numpy(float) for c in ("most", "mass", "toxic")))
    return tagger


_TAGGERS: dict[int, Tagger] = {}


def tagged(rows: DataFrame, tagger: Tagger, keep: list[str] | None = None) -> DataFrame:
    """``doc_id, most, mass, score, spans`` of every text, and the integer columns ``keep``.

    ``spans`` lists offending tokens (marginal of at least ``SPAN_AT``) as structs
    (start, end, p) with code point offsets, ends exclusive.
    """
    keep = keep or []
    fitted = (tagger.weights, tagger.bias, tagger.transitions, tagger.curve)
    held = rows.sparkSession.sparkContext.broadcast(fitted)
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Tagger(*held.value)
        for b in slices(batches):
            most, mass, score, spans = [], [], [], []
            for text in b.column(1).to_pylist():
                found = model.marginals(text or "")
                most.append(max((p for *_, p in found), default=0.0))
                mass.append(sum(p for *_, p in found))
                score.append(model.score(found))
                spans.append([{"start": s, "end": e, "p": p} for s, e, p in found if p >= SPAN_AT])
            numbers = [pa.array(c, pa.float64()) for c in (most, mass, score)]
            yield pa.record_batch(
                [b.column(0), *numbers, pa.array(spans, span_type), *b.columns[2:]],
                names=["doc_id", "most", "mass", "score", "spans", *keep],
            )

    schema = "doc_id long, most double, mass double, score double, spans array<struct<start:long,end:long,p:double>>"
    return rows.select("doc_id", "text", *keep).mapInArrow(run, ", ".join([schema, *(f"{c} int" for c in keep)]))


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted, spans`` for every row of ``docs``.

    ``held_out`` marks ids whose crc32 mod 4 is 2 (false for a null id), from whose labels
    nothing is learned. Null or empty texts score like texts without evidence. Repeated
    rows are each scored. Other columns of either table play no part.
    """
    tagger = train(docs, labels, sample)
    found = tagged(id_text(docs), tagger)
    return found.select(
        "doc_id",
        F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "spans",
    )


def without_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    tagger = train(docs, labels, sample)
    held = docs.sparkSession.sparkContext.broadcast((tagger.weights, tagger.bias, tagger.transitions, tagger.curve))
    models: list[Tagger] = []

    @F.pandas_udf("double")
    def score(texts):
        give_back()
        if not models:
            models.append(Tagger(*held.value))
        return texts.map(lambda t: models[0].score(models[0].marginals(t or "")))

    return docs.where(score(docs["text"]) < THRESHOLD)
