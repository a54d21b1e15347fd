"""Scores of abusive, hateful or sexually explicit language per document.

Disguised words are restored first (:mod:`noisy_channel`). The restored text is cut into sentences, long ones into
overlapping windows, and each is scored by a logistic model over words, pairs of words and, for words the
model does not know, runs of letters; a lexicon is one further feature. A document is as bad as its worst
sentence. The model is fitted to a bounded sample of reviewed documents: a flagged document vouches only for its worst sentences, reviews
that contradict the other folds of a cross-validation are left out, and the scores are calibrated on the held-out folds.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylolake.llm import abuse_lexicon as L
from phylolake.llm import text as T
from phylolake.llm.noisy_channel import CharacterModel, Restorer
from phylolake.session import ship_package, spread_work

MAX_LABELLED = 20_000  # reviewed documents the classifier is fitted to, at most
FOLDS = 3
LEAST_FLAGGED = 40  # with fewer flagged documents than this the lexicon alone scores
WINDOW, STEP, LONG = 16, 8, 24  # sentences of more than LONG words are scored in windows
GRAM = 4  # letters of the runs that stand for unknown words
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+|\s\|\s")
ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")

_KINDS = {"abusive": (set(L.INSULTS) | set(L.MILD_INSULTS) | set(L.THREATS)), "hateful": set(L.HATE), "sexual": set(L.SEXUAL)}
_LEXICON = set().union(*_KINDS.values())
NOTHING = -4.0  # log-odds of a sentence without a word of the lexicon
_YOU, _STRONG, _MILD, _THREAT = set(L.YOU), set(L.INSULTS), set(L.MILD_INSULTS), set(L.THREATS)


def vocabulary() -> dict[str, int]:
    """Words that people disguise, with weights."""
    weight = dict.fromkeys([*L.MILD_INSULTS, *L.SEXUAL, *L.HATE], 1)
    return weight | dict.fromkeys([w + "s" for w in L.INSULTS], 3) | dict.fromkeys([*L.INSULTS, *L.DISGUISED], 8)


def corpus_grams(docs: DataFrame, text: str) -> DataFrame:
    """(gram, n) of all runs of three letters in the words of all documents, with the words' ends; at most 28^3 rows."""
    plain = F.replace(F.translate(F.lower(F.col(text)), *ACCENTS), F.lit("ß"), F.lit("ss"))
    word = F.explode(F.regexp_extract_all(plain, F.lit("([a-z]+)"), F.lit(1)))
    counted = spread_work(docs.select(text)).select(word.alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    padded = F.concat(F.lit("^"), F.col("w"), F.lit("$"))
    gram = F.explode(F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.substring(padded, i, F.lit(3))))
    return counted.select(gram.alias("gram"), "n").groupBy("gram").agg(F.sum("n").alias("n"))


def lexicon_odds(words: list[str]) -> float:
    """Log-odds of a sentence by the lexicon alone."""
    own = set(words)
    you = not own.isdisjoint(_YOU)
    odds = NOTHING
    if not own.isdisjoint(_STRONG):
        odds += 5.0 if you else 4.5
    if not own.isdisjoint(_MILD):
        odds += 4.5 if you else 2.0
    if len(own & _KINDS["sexual"]) > 0:
        odds += 3.0 if len(own & _KINDS["sexual"]) == 1 else 6.0
    if not own.isdisjoint(_KINDS["hateful"]):
        odds += 3.5
    if you and not own.isdisjoint(_THREAT):
        odds += 3.0
    return odds


def kind_of(words: list[str]) -> str:
    """Kind of language with most words of the lexicon; without any it is called abusive."""
    n = {k: sum(w in v for w in words) for k, v in _KINDS.items()}
    return max(n, key=lambda k: (n[k], k == "abusive"))


class Sentences:
    """Sentences of raw text as (plain words, restored words or None, doubt)."""

    def __init__(self, grams: dict[str, int]):
        self.restorer = Restorer(CharacterModel(vocabulary(), grams))

    def of(self, text: str | None):
        if not text:
            return
        for s in SENTENCE.split(T.fold(T.readable(text))):
            plain, restored, doubt = self.restorer.sentence(s)
            if plain or restored:
                yield plain, restored, doubt


def windows(words: list[str]):
    if len(words) <= LONG:
        yield words
        return
    for i in range(0, len(words) - WINDOW + STEP, STEP):
        yield words[i : i + WINDOW]


def _grams(word: str) -> list[str]:
    w = "^" + word + "$"
    return ["~" + w[i : i + GRAM] for i in range(max(1, len(w) - GRAM + 1))]


def features(words: list[str], known) -> list[tuple[str, float]]:
    """Words, pairs of words, and runs of letters for words that are not ``known``; numbers are one word."""
    own = ["0" if w[0] <= "9" else w for w in words]
    out = []
    for w in own:
        if w in known:
            out.append((w, 1.0))
        else:
            g = _grams(w)
            out += [(x, 1 / len(g)) for x in g]
    return out + [(a + " " + b, 1.0) for a, b in zip(own, own[1:], strict=False)]


class Classifier:
    """Weights of the features; the score of a sentence is its log-odds."""

    def __init__(self, known=(), weight=None, bias=0.0, lexicon=1.0, scale=1.0, shift=0.0):
        self.known, self.weight, self.bias, self.lexicon, self.scale, self.shift = set(known), weight or {}, bias, lexicon, scale, shift
        self._word: dict[str, float] = {}

    def _of_word(self, w: str) -> float:
        got = self._word.get(w)
        if got is None:
            if len(self._word) > 1_000_000:
                self._word.clear()
            if w in self.known:
                got = self.weight.get(w, 0.0)
            else:
                g = _grams(w)
                got = sum(self.weight.get(x, 0.0) for x in g) / len(g)
            self._word[w] = got
        return got

    def odds(self, words: list[str]) -> tuple[float, list[str]]:
        """(log-odds, words) of a sentence, of its worst window where it is long."""
        own = [w if w[0] > "9" else "0" for w in words]
        told = not _LEXICON.isdisjoint(own)
        n = len(own)
        starts = (0,) if n <= LONG else range(0, n - WINDOW + STEP, STEP)
        width = n if n <= LONG else WINDOW
        if not self.weight:
            return max(((lexicon_odds(words[i : i + width]) if told else NOTHING, words[i : i + width]) for i in starts), key=lambda x: x[0])
        seen, of, get = self._word, self._of_word, self.weight.get
        word = [seen[w] if w in seen else of(w) for w in own]
        pair = [get(a + " " + b, 0.0) for a, b in zip(own, own[1:], strict=False)]
        best, at = -math.inf, 0
        for i in starts:
            lex = lexicon_odds(own[i : i + width]) if told else NOTHING
            o = self.lexicon * lex + sum(word[i : i + width]) + sum(pair[i : i + width - 1])
            if o > best:
                best, at = o, i
        return self.bias + best, words[at : at + width]

    def document(self, sentences) -> tuple[float, str | None]:
        """(probability, kind from 0.5 on) of a document."""
        best, at = -20.0, []
        for plain, restored, doubt in sentences:
            for words, less in ((plain, 0.0), (restored, doubt)):
                if words:
                    o, part = self.odds(words)
                    if o + less > best:
                        best, at = o + less, part
        p = 1 / (1 + math.exp(-max(-30.0, min(30.0, self.scale * best + self.shift))))
        return p, kind_of(at) if p >= 0.5 else None

    def dump(self) -> str:
        return json.dumps([sorted(self.known), self.weight, self.bias, self.lexicon, self.scale, self.shift])

    @classmethod
    def load(cls, text: str) -> Classifier:
        return cls(*json.loads(text))


class _Rows:
    """Sparse feature rows, kept by row and by column."""

    def __init__(self, rows, index: dict[str, int]):
        cols, vals, lens = [], [], []
        for fs in rows:
            own = [(index[f], v) for f, v in fs if f in index]
            cols += [c for c, _ in own]
            vals += [v for _, v in own]
            lens.append(len(own))
        self.n, self.d = len(lens), len(index)
        self.col, self.val = np.array(cols, np.intp), np.array(vals)
        row = np.repeat(np.arange(self.n), lens)
        by = np.argsort(self.col, kind="stable")
        self.row_of, self.val_of = row[by], self.val[by]
        self.rows, self.row_start = np.unique(row, return_index=True)
        self.cols, self.col_start = np.unique(self.col[by], return_index=True)

    def times(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        if len(self.col):
            out[self.rows] = np.add.reduceat(self.val * w[self.col], self.row_start)
        return out

    def back(self, g: np.ndarray) -> np.ndarray:
        out = np.zeros(self.d)
        if len(self.col):
            out[self.cols] = np.add.reduceat(self.val_of * g[self.row_of], self.col_start)
        return out


def _logistic(X: _Rows, lex: np.ndarray, y: np.ndarray, use: np.ndarray, start: np.ndarray, steps: int, penalty: float) -> np.ndarray:
    """L2-penalised logistic regression by L-BFGS; the last two weights are those of the lexicon (drawn to 1) and the bias (free)."""
    d = X.d
    centre = np.zeros(d + 2)
    centre[d] = 1.0
    strength = np.full(d + 2, penalty)
    strength[d], strength[d + 1] = penalty * 5, 1e-6

    def value(w):
        z = X.times(w[:d]) + w[d] * lex + w[d + 1]
        loss = (np.logaddexp(0, z) - y * z) * use
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * use
        grad = np.concatenate([X.back(g), [g @ lex, g.sum()]]) + strength * (w - centre)
        return loss.sum() + 0.5 * (strength * (w - centre) ** 2).sum(), grad

    w, (f, g), past = start.copy(), value(start), []
    for _ in range(steps):
        q, a = g.copy(), []
        for s, t, r in reversed(past):
            a.append(r * (s @ q))
            q -= a[-1] * t
        q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.abs(g).sum())
        for (s, t, r), x in zip(past, reversed(a), strict=True):
            q += s * (x - r * (t @ q))
        size, slope = 1.0, -(g @ q)
        for _ in range(20):
            new = w - size * q
            fn, gn = value(new)
            if fn <= f + 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        s, t = new - w, gn - g
        if s @ t > 1e-10:
            past = [*past[-7:], (s, t, 1 / (s @ t))]
        done = f - fn < 1e-4 * abs(f)
        w, f, g = new, fn, gn
        if done:
            break
    return w


def _fit_weights(X: _Rows, lex, doc, flagged, keep, penalty, rounds=3):
    """Weights from the documents in ``keep``: of flagged ones the sentences that look worst count, of the others all."""
    w = np.zeros(X.d + 2)
    w[X.d] = 1.0
    z = lex.astype(float)
    inside = keep[doc]
    for _ in range(rounds):
        worst = np.full(len(keep), -np.inf)
        np.maximum.at(worst, doc, z)
        positive = (flagged[doc] == 1) & ((z > 0) | (z >= worst[doc]))
        use = (inside & (positive | (flagged[doc] == 0))).astype(float)
        w = _logistic(X, lex, positive.astype(float), use, w, 30, penalty)
        z = X.times(w[: X.d]) + w[X.d] * lex + w[X.d + 1]
    worst = np.full(len(keep), -np.inf)
    np.maximum.at(worst, doc, z)
    return w, worst


def fit(labelled: list[tuple[int, str | None, int]], grams: dict[str, int], *, penalty: float = 0.3) -> tuple[Classifier, dict]:
    """The classifier of (id, text, flagged) rows, and its cross-validated figures.

    With fewer than ``LEAST_FLAGGED`` flagged documents the lexicon scores by itself.
    """
    labelled = sorted(labelled, key=lambda r: r[0])
    flagged = np.array([int(r[2]) for r in labelled], np.int8)
    if flagged.sum() < LEAST_FLAGGED or (flagged == 0).sum() < LEAST_FLAGGED:
        return Classifier(), {}
    sentences = Sentences(grams)
    parts, doc = [], []
    for i, (_, text, _) in enumerate(labelled):
        for plain, restored, doubt in sentences.of(text):
            for part in windows(restored if restored and doubt > -1 else plain):
                parts.append(part)
                doc.append(i)
    doc = np.array(doc, np.int32)
    lex = np.array([lexicon_odds(p) for p in parts], np.float32)
    often: Counter = Counter()
    last: dict[str, int] = {}
    for p, i in zip(parts, doc, strict=True):
        for w in {"0" if w[0] <= "9" else w for w in p}:
            if last.get(w) != i:
                last[w] = i
                often[w] += 1
    known = {w for w, n in often.items() if n >= 3}
    rows = [features(p, known) for p in parts]
    held: dict[str, set[int]] = {}
    for fs, i in zip(rows, doc, strict=True):
        if flagged[i]:
            for f, _ in fs:
                held.setdefault(f, set()).add(i)
    index = {f: k for k, f in enumerate(sorted(f for f, at in held.items() if len(at) >= 2))}
    X = _Rows(rows, index)
    fold = np.array([zlib.crc32(str(r[0]).encode()) % FOLDS for r in labelled])
    seen = np.zeros(len(labelled), bool)
    seen[doc] = True

    def held_out(keep):
        z = np.full(len(labelled), -20.0)
        for k in range(FOLDS):
            _, worst = _fit_weights(X, lex, doc, flagged, keep & (fold != k), penalty, rounds=2)
            z[(fold == k) & seen] = worst[(fold == k) & seen]
        return z

    z = held_out(np.ones(len(labelled), bool))
    agree = ((flagged == 1) & (z > -1.5)) | ((flagged == 0) & (z < 1.5))  # reviews the other folds contradict are taken for wrong
    w, _ = _fit_weights(X, lex, doc, flagged, agree, penalty)
    scale, shift = _calibrate(z[agree & seen], flagged[agree & seen])
    d = X.d
    weight = {f: round(float(w[k]), 4) for f, k in index.items() if abs(w[k]) > 1e-3}
    told = z * scale + shift > 0
    figures = {
        "reviewed": len(labelled), "left_out": int((~agree).sum()), "recall_of_kept": float((told & agree & (flagged == 1)).sum() / max(1, (agree & (flagged == 1)).sum())),
        "precision_of_kept": float((told & agree & (flagged == 1)).sum() / max(1, (told & agree).sum())),
    }
    return Classifier(known, weight, float(w[d + 1]), float(w[d]), scale, shift), figures


def _calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift that make held-out log-odds probabilities (Platt)."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        r, v = p - y, np.maximum(p * (1 - p), 1e-9)
        g = np.array([r @ z + 0.1 * (a - 1), r.sum()])
        h = np.array([[v @ (z * z) + 0.1, v @ z], [v @ z, v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def fitted(docs: DataFrame, labels: DataFrame, grams: dict[str, int], *, id_col: str, text: str, flagged: str, max_labelled: int, seed: int) -> DataFrame:
    """One row (classifier, figures): fitted in one task to a seeded sample of at most ``max_labelled`` reviewed documents."""
    agreed = labels.where(F.col(flagged).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(flagged).alias("a"), F.max(flagged).alias("b")).where("a = b")
    chosen = agreed.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(max_labelled).select(id_col, "a")
    sample = docs.select(F.col(id_col).cast("bigint").alias(id_col), text).join(F.broadcast(chosen), id_col).select(id_col, text, F.col("a").cast("int"))
    held = docs.sparkSession.sparkContext.broadcast(grams)

    def run(batches):
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        model, figures = fit(rows, held.value)
        yield pa.RecordBatch.from_arrays([pa.array([model.dump()]), pa.array([json.dumps(figures)])], names=["model", "figures"])

    return sample.coalesce(1).mapInArrow(run, "model string, figures string")


def abuse_scores(
    docs: DataFrame,
    labels: DataFrame | None = None,
    *,
    id_col: str = "doc_id",
    text: str = "text",
    flagged: str = "flagged",
    max_labelled: int = MAX_LABELLED,
    seed: int = 42,
) -> DataFrame:
    """(doc_id, score, kind) of every document; kind is abusive, hateful or sexual from a score of 0.5 on.

    ``labels`` has reviews (id, flagged 0/1) of some documents; the classifier is fitted to a seeded sample of at
    most ``max_labelled`` reviewed documents. Contradictory reviews are left out, null ones too. Without labels, or with
    fewer than ``LEAST_FLAGGED`` of either kind, the lexicon alone scores. Null and empty texts score lowest; null ids are ignored.
    Every token of every text goes through the lattice, equal ones once per task: joining decoded tokens
    back to the texts would shuffle all texts.
    """
    spark = docs.sparkSession
    ship_package(spark)
    grams = {g: n for g, n in corpus_grams(docs, text).toLocalIterator()}
    model = Classifier().dump()
    if labels is not None:
        row = fitted(docs, labels, grams, id_col=id_col, text=text, flagged=flagged, max_labelled=max_labelled, seed=seed).first()
        model = row["model"] if row else model
    held = spark.sparkContext.broadcast((grams, model))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("kind", pa.string())])

    def run(batches):
        sentences, classifier = Sentences(held.value[0]), Classifier.load(held.value[1])
        for batch in batches:
            scored = [classifier.document(sentences.of(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([round(s, 6) for s, _ in scored], pa.float64()), pa.array([k for _, k in scored], pa.string())], schema=schema
            )

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint"), F.col(text))
    return spread_work(rows).mapInArrow(run, "doc_id bigint, score double, kind string")
