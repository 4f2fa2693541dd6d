"""Toxicity: noisy-channel deobfuscation, then a score of the restored words.

Deobfuscation.  A word with letters and digits or symbols in them, separators
between letters, or letters repeated three times or more is taken for the
output of a noisy channel: each character gives lattice arcs (itself, the
letters that it may stand for, nothing where it may be a separator or a
repetition), each with a channel cost; single letters set apart by spaces are
one word with separators.  Viterbi finds the path that is likeliest under the
channel and a character trigram model, whose counts come from all documents.

Score.  Features of a word, as written and as restored, are itself and its
first and last four to six letters.  A feature's toxicity is the smoothed share
of toxic documents among the labelled documents that have it.  A document's
inputs are its three most toxic words, the number of toxic ones, and its
length; a logistic regression makes them a score.  Its training rows count
features without themselves (leave one out), so rare words don't look surer
than they are.

Labels come from at most ``SAMPLE`` labelled rows, drawn by a hash of the id.
The driver holds 28^3 model counts, the features that at least ``LEAST`` toxic
documents of that sample share, and five numbers for each of its rows.
Null text counts as empty; without labels all scores are 0.5, and no row is
rejected.  Repeated labels of an id all count; ids of more than ``quality.OFTEN``
documents are not learned from.
"""

from __future__ import annotations

import math
import os.path
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Cache, keep_rows, map_batches, materialize, texts_of
from .quality import labelled

#: Labelled rows that are learned from; toxic documents a feature needs; words that a worker keeps.
SAMPLE, LEAST, CACHE_WORDS = 20_000, 3, 400_000
#: Weight of the prior in a feature's share; shares under this don't count.
PRIOR, FLOOR = 4.0, 0.25

#: What characters may stand for (fixed values).
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
MARKS = ".,!?;:\"')"
SEPARATORS = ".-_*~·^'`,:;/ "
#: Log costs of the channel: a stand-in, a hidden vowel, a character left as it is, a separator, a second and a further repetition.
STAND_IN, HIDDEN, LITERAL, APART, TWICE, AGAIN = -0.7, -2.5, -8.0, -0.4, -4.0, -0.2

LETTERS = 28  # boundary, a-z, any other letter
OTHER = 27
_CODES = bytes(ord(chr(b).lower()) - 96 if "a" <= chr(b).lower() <= "z" else OTHER if b >= 0xC0 and b not in (0xD7, 0xF7) else 0 for b in range(256))
#: Symbols that may stand for a first or a last letter, and what they stand among.
_HEAD, _TAIL = "@$!|+(", "@$|+€£"
_LEAD = re.compile(r"[^\w@$!|+(€£¡]+|([@$!|+(])\1+")
_ODD = re.compile(r"(?=.*[^\W\d_])(?:.*[0-9@$!|+(€£¡*]|.*[^\W_][.\-_*~·^'`,:;/]+[^\W_]|.*([^\W\d_])\1\1)", re.DOTALL)
_WORD = re.compile(r"[^\W\d_]+")


def code(letter: str) -> int:
    return ord(letter) - 96 if "a" <= letter <= "z" else OTHER if letter.isalpha() else 0


def trigram_counts(text: str) -> np.ndarray:
    """Counts of letter trigrams of a whole text; a boundary stands on either side."""
    raw = b"\0\0" + text.encode("latin-1", "replace").translate(_CODES) + b"\0"
    c = np.frombuffer(raw, np.uint8).astype(np.int32)
    return np.bincount(c[:-2] * (LETTERS * LETTERS) + c[1:-1] * LETTERS + c[2:], minlength=LETTERS**3)


def language_model(counts: np.ndarray) -> list[float]:
    """Log probabilities of a letter after two, interpolated over shorter contexts; flat."""
    c3 = counts.reshape(LETTERS, LETTERS, LETTERS).astype(float)
    c2 = c3.sum(axis=0)
    c1 = c2.sum(axis=0)
    p1 = (c1 + 1) / (c1.sum() + LETTERS)
    p2 = (c2 + 5 * p1) / (c2.sum(axis=1, keepdims=True) + 5)
    p3 = (c3 + 5 * p2) / (c3.sum(axis=2, keepdims=True) + 5)
    return np.log(p3).ravel().tolist()


def arcs(chars: str, i: int) -> list[tuple[str, float]]:
    """What the i-th character may have been: letters (or "" for nothing, a blank for a literal) with log costs."""
    c = chars[i]
    before = chars[i - 1] if i else ""
    out: list[tuple[str, float]] = []
    if c.isalpha():
        out.append((c, 0.0))
        if c == before:
            out.append(("", AGAIN if i > 1 and chars[i - 2] == c else TWICE))
        return out
    out += [(x, STAND_IN) for x in LEET.get(c, "")]
    if c in SEPARATORS:
        out.append(("", APART))
    if c == "*":
        out += [(v, HIDDEN) for v in "aeiou"]
    out.append((" ", LITERAL if c in LEET else LITERAL / 4))
    return out


def restore(chars: str, model: list[float]) -> str:
    """The likeliest written form of a lower-case word: Viterbi over the lattice, states being the last two letters.

    What all paths agree on is written out as it comes, so a state holds a short
    string and time is linear in the word's length.
    """
    states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    done: list[str] = []
    for i in range(len(chars)):
        nxt: dict[tuple[int, int], tuple[float, str]] = {}
        for letter, cost in arcs(chars, i):
            k = code(letter) if letter else -1
            for (a, b), (p, made) in states.items():
                to = (a, b) if k < 0 else (b, k)
                q = p + cost + (0.0 if k < 0 else model[(a * LETTERS + b) * LETTERS + k])
                if to not in nxt or q > nxt[to][0]:
                    nxt[to] = (q, made + letter)
        states = nxt
        if i & 63 == 63:
            same = len(os.path.commonprefix([made for _, made in states.values()]))
            if same:
                done.append(next(iter(states.values()))[1][:same])
                states = {k: (p, made[same:]) for k, (p, made) in states.items()}
    return "".join(done) + max((p + model[(a * LETTERS + b) * LETTERS], made) for (a, b), (p, made) in states.items())[1]


def core(token: str) -> str:
    """A token without the marks around it: all but word characters and symbols that may be letters, and symbols that are repeated at an edge (``!!!``)."""
    lead = _LEAD.match(token)
    at = lead.end() if lead else 0
    end = len(token)
    while end > at and not (token[end - 1].isalnum() or token[end - 1] == "_"):
        end -= 1
    tail = token[end:]
    doubled = next((k for k in range(len(tail) - 1) if tail[k] == tail[k + 1] and tail[k] in _TAIL), None)
    if doubled is None:
        doubled = next((k + 1 for k in range(len(tail) - 1, -1, -1) if tail[k] in _TAIL), 0)
    return token[at : end + doubled]


def tokens(text: str) -> set[str]:
    """Distinct lower-case words between white space, and runs of four or more single characters set apart by spaces."""
    words = text.lower().split()
    out = set(words)
    single = [i for i, w in enumerate(words) if len(w) == 1 or (len(w) < 5 and len(w.rstrip(MARKS)) == 1)]
    run: list[int] = []
    for i in [*single, -9]:
        if run and i != run[-1] + 1:
            if len(run) >= 4:
                out.add(" ".join(words[k].rstrip(MARKS) or words[k][0] for k in run))
            run = []
        run.append(i)
    return out


def forms(token: str, model: list[float]) -> Iterator[str]:
    """The words of a token as written and, where it looks obfuscated, as restored; some may come twice."""
    bare = core(token)
    yield from _WORD.findall(token)
    if " " in bare:  # where the word begins and ends isn't known
        for w in _WORD.findall(restore(bare, model)):
            yield from (w[i:j] for i in range(len(w)) for j in range(i + 4, min(len(w), i + 12) + 1))
    elif _ODD.match(bare):
        yield from _WORD.findall(restore(bare, model))


def features(word: str) -> list[int]:
    n = len(word)
    made = ["w" + word]
    for k in (4, 5, 6):
        if n >= k:
            made += [f"p{word[:k]}", f"s{word[-k:]}"]
    return [xxhash.xxh3_64_intdigest(x) >> 1 for x in made]


class Shares(Cache):
    """token -> the toxicity of its most toxic feature; bounded."""

    def __init__(self, table: dict[int, tuple[int, int]], prior: float, model: list[float]):
        super().__init__(CACHE_WORDS)
        self.table, self.prior, self.model = table, prior, model

    def best(self, token: str, y: int | None = None) -> float:
        """y: the label of a training document, which is left out of the counts."""
        most = 0.0
        for word in forms(token, self.model):
            for f in features(word):
                hit = self.table.get(f)
                if hit:
                    pos, n = hit
                    if y is not None:
                        pos, n = pos - y, n - 1
                    most = max(most, (pos + PRIOR * self.prior) / (n + PRIOR))
        return most if most >= FLOOR else 0.0

    def __missing__(self, token: str) -> float:
        v = self.best(token)
        if self.room(len(token)):
            self[token] = v
        return v


def inputs(values: list[float], words: int) -> list[float]:
    """Log odds of the three most toxic words over the floor's, the number of likely toxic ones, and, where there are any, the length."""
    top = sorted((v for v in values if v), reverse=True)
    first = [math.log(v / (1 - v)) - math.log(FLOOR / (1 - FLOOR)) if v else 0.0 for v in (top + [0.0] * 3)[:3]]
    return [*first, np.log1p(sum(v >= 0.5 for v in top)), np.log1p(words) if top else 0.0]


@dataclass
class Toxicity:
    model: list[float]
    table: dict[int, tuple[int, int]]
    prior: float
    weights: np.ndarray

    def scores(self, texts: list[str], shares: Shares) -> np.ndarray:
        x = []
        for t in texts:
            ts = tokens(t)
            x.append(inputs([shares[w] for w in ts], len(ts)))
        return logistic(np.array(x).reshape(-1, 5), self.weights)


def logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.column_stack([x, np.ones(len(x))]) @ w, -30, 30)))


def regress(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Ridge logistic regression by Newton's method."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def corpus_model(docs: DataFrame, text_col: str = "text") -> list[float]:
    """The character model of all documents' whole texts: 28^3 sums, made on the executors."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS**3, np.int64)
        for batch in batches:
            for t in texts_of(batch, 0):
                total += trigram_counts(t)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(total[k], pa.int64())], ["k", "n"])

    counts = np.zeros(LETTERS**3, np.int64)
    for k, n in map_batches(docs.select(F.col(text_col).alias("text")), kernel, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[k] = n
    return language_model(counts)


def train_toxicity(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Toxicity:
    model = corpus_model(docs, text_col)
    sample = materialize(labelled(docs, labels, id_col, text_col, label_col, train, SAMPLE), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Cache(CACHE_WORDS // 4, 1 << 20)  # what a token gives is many times its size
        for batch in batches:
            found, toxic = [], []
            for t, y in zip(texts_of(batch), batch.column(2).to_pylist(), strict=True):
                own: set[int] = set()
                for w in tokens(t):
                    fs = made.get(w)
                    if fs is None:
                        fs = tuple({f for word in forms(w, model) for f in features(word)})
                        if made.room(len(w)):
                            made[w] = fs
                    own.update(fs)
                found.append(np.fromiter(own, np.int64, len(own)))
                toxic.append(np.full(len(own), y, np.int64))
            f, inverse = np.unique(np.concatenate(found), return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(np.bincount(inverse, np.concatenate(toxic), len(f)).astype(np.int64)), pa.array(np.bincount(inverse, minlength=len(f)).astype(np.int64))], ["f", "pos", "n"])

    summed = map_batches(sample.repartition(24, "id"), count, "f long, pos long, n long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    prior, rows = sample.agg(F.avg("y"), F.count("*")).first()
    if not rows or prior in (0.0, 1.0):
        w = np.zeros(6)
        w[5] = 0.0 if not rows else 4.0 * (2 * prior - 1)
        return Toxicity(model, {}, prior or 0.0, w)
    found = summed.where((F.col("pos") >= LEAST) & ((F.col("pos") + PRIOR * prior) / (F.col("n") + PRIOR) >= FLOOR)).toPandas()
    table = {int(f): (int(p), int(n)) for f, p, n in zip(found["f"], found["pos"], found["n"], strict=True)}

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares = Shares(table, prior, model)
        for batch in batches:
            x = []
            for t, y in zip(texts_of(batch), batch.column(2).to_pylist(), strict=True):
                ts = tokens(t)
                x.append(inputs([shares.best(w, y) for w in ts if shares[w]], len(ts)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x, pa.list_(pa.float64()))], ["id", "y", "x"])

    fitted = map_batches(sample, describe, "id long, y int, x array<double>").toPandas().sort_values(["id", "y"])
    return Toxicity(model, table, prior, regress(np.array(fitted["x"].tolist()), fitted["y"].to_numpy(float)))


def score_toxicity(docs: DataFrame, fitted: Toxicity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every whole text."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares = Shares(fitted.table, fitted.prior, fitted.model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fitted.scores(texts_of(batch), shares))], ["doc_id", "score"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), kernel, "doc_id long, score double")


def reject_toxic(docs: DataFrame, fitted: Toxicity, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows whose score is under the threshold, or all rows if nothing could be fitted; all columns as they are."""
    if not fitted.table and not fitted.weights.any():
        return docs

    def keep():
        shares = Shares(fitted.table, fitted.prior, fitted.model)
        return lambda texts: (fitted.scores(texts, shares) < threshold).tolist()

    return keep_rows(docs, text_col, keep)
