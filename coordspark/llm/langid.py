"""Language identification by a linear-chain conditional random field over the words of a text.

A word's scores sum the weights of its byte n-grams (with the word's ends, so that they include its affixes)
and of the lexicon it is listed in; learned transitions tie neighbouring words, so that short or ambiguous
words follow their context and a change of language inside a text is found. Forward-backward gives every
word's label probabilities; a document's label has the highest mean over its words with letters.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coordspark.llm.common import Shared, give_back, pieces, text_of

#: The fit sees at most this many documents of a label and of all labels, of at most this many bytes each, and the
#: labels that most documents have. These bound the sample on the driver (40 MB) and the model (51 MB).
FIT_DOCS, FIT_ALL, FIT_BYTES, FIT_LABELS = 150, 2000, 20_000, 100
#: Training sequences and their words; spans of one language last SPAN words on average.
SEQUENCES, LENGTH, SPAN = 2400, 48, 12
BUCKETS = 1 << 17
UNDETERMINED = "und"
_DROP = bytes(b for b in range(128) if b != 32 and not chr(b).isalpha())


def has_letter(text: str) -> bool:
    """Whether a character of a Unicode letter category (L*) occurs; digits, fractions and marks are none."""
    return any(map(str.isalpha, text))


@dataclass
class Words:
    """Distinct words as positions of a byte string, with the buckets of their n-grams."""

    plain: list[bytes]
    starts: np.ndarray
    grams: list[np.ndarray]
    lettered: np.ndarray

    @classmethod
    def of(cls, chunks: list[bytes]) -> Words:
        joined = (b" " + b" ".join(chunks) + b" ").lower().translate(None, _DROP)
        plain = joined[1:-1].split(b" ")
        b = np.frombuffer(joined, np.uint8).astype(np.uint32)
        space = b == 32
        starts = np.flatnonzero(space)[:-1]
        grams = []
        for n in (2, 3, 4):
            value, inside = np.full(len(b), n, np.uint32), np.zeros(len(b), bool)
            size = len(b) - n + 1
            if size > 0:
                inside[:size] = True
                for i in range(n):
                    value[:size] = (value[:size] << np.uint32(8) | b[i : i + size]) if i or n < 4 else b[:size]
                    if 0 < i < n - 1:
                        inside[:size] &= ~space[i : i + size]
                if n == 2:
                    inside[:size] &= ~(space[:size] & space[1:])
            bucket = (value * np.uint32(2654435761) ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) >> np.uint32(15)
            grams.append(np.where(inside, bucket & np.uint32(BUCKETS - 1), BUCKETS).astype(np.int64))
        lettered = [len(w) > 0 and (w.isascii() or has_letter(w.decode("utf-8", "replace"))) for w in plain]
        return cls(plain, starts, grams, np.array(lettered))

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """The summed weights of each word's n-grams."""
        total = weights[self.grams[0]]
        for g in self.grams[1:]:
            total = total + weights[g]
        return np.add.reduceat(total, self.starts, axis=0) if len(self.starts) else np.zeros((0, weights.shape[1]))


class Lanes:
    """Sequences of words laid out by time, so that a step of all sequences is one slice."""

    def __init__(self, lengths: np.ndarray):
        order = np.argsort(-lengths, kind="stable")
        sizes = lengths[order]
        steps = int(sizes[0]) if len(sizes) else 0
        self.active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(1, steps + 1), "left")
        self.base = np.r_[0, np.cumsum(self.active)]
        first = np.r_[0, np.cumsum(lengths)[:-1]]
        lane = np.concatenate([np.arange(a) for a in self.active]) if steps else np.empty(0, np.int64)
        time = np.repeat(np.arange(steps), self.active)
        self.sequence = order[lane] if steps else lane
        self.place = first[self.sequence] + time if steps else lane
        self.steps = steps

    def forward_backward(self, scores: np.ndarray, transition: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Label probabilities of each place (in this layout), expected transitions, log of the normaliser."""
        e = np.exp(scores - scores.max(axis=1, keepdims=True))
        alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.empty(len(e))
        base, active = self.base, self.active
        for t in range(self.steps):
            a, b = base[t], base[t + 1]
            x = e[a:b] * (start if t == 0 else alpha[base[t - 1] : base[t - 1] + active[t]] @ transition)
            c = x.sum(axis=1)
            scale[a:b] = c
            alpha[a:b] = x / c[:, None]
        back = np.empty_like(e)
        turned = np.ascontiguousarray(transition.T)
        for t in range(self.steps - 1, 0, -1):
            a, b = base[t], base[t + 1]
            back[a:b] = e[a:b] * beta[a:b] / scale[a:b, None]
            beta[base[t - 1] : base[t - 1] + active[t]] = back[a:b] @ turned
        marginal = alpha * beta
        marginal /= marginal.sum(axis=1, keepdims=True)
        prior = np.concatenate([np.arange(base[t - 1], base[t - 1] + active[t]) for t in range(1, self.steps)]) if self.steps > 1 else np.empty(0, np.int64)
        expected = transition * (alpha[prior].T @ back[base[1] :]) if self.steps > 1 else np.zeros_like(transition)
        return marginal, expected, float(np.log(scale).sum() + scores.max(axis=1).sum())


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # n-gram buckets and an empty one, by label
    lexicon: dict[bytes, int]
    listed: np.ndarray  # weights of being in a lexicon (and in none), by label
    transition: np.ndarray
    start: np.ndarray

    def scores(self, words: Words) -> np.ndarray:
        none = len(self.labels)
        entry = np.fromiter((self.lexicon.get(w, none) for w in words.plain), np.int64, len(words.plain))
        return np.where(words.lettered[:, None], words.sums(self.weights) + self.listed[entry], 0.0)

    def label(self, texts: list[str]) -> list[tuple[str, float, float]]:
        """For each text: its label, the mean probability of that label over its words, and the certainty, which
        is the mean of each word's highest probability, whatever label that is."""
        found = [(UNDETERMINED, 0.0, 0.0)] * len(texts)
        for i, (_, marginal, counted) in self.words(texts):
            mean = marginal[counted].mean(axis=0)
            best = int(mean.argmax())
            certain = float(marginal[counted].max(axis=1).mean())
            found[i] = (self.labels[best], float(min(1.0, mean[best])), min(1.0, certain))
        return found

    def words(self, texts: list[str]) -> Iterator[tuple[int, tuple[list[bytes], np.ndarray, np.ndarray]]]:
        """For each text with a letter, in no order: its place, and its UTF-8 chunks, their label probabilities and
        which of them have a letter (all, if a letter is only in what is left out of words).

        Texts of like lengths go together: a few long ones then don't make steps for all others.
        """
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        for a, b in pieces([texts[i] for i in order], 500_000):
            yield from self._words([(i, texts[i]) for i in order[a:b] if has_letter(texts[i])])

    def _words(self, texts: list[tuple[int, str]]) -> Iterator[tuple[int, tuple[list[bytes], np.ndarray, np.ndarray]]]:
        if not texts or not self.labels:
            return
        known: dict[bytes, int] = {}
        chunks = [t.encode("utf-8", "replace").split() for _, t in texts]
        ids = [np.fromiter((known.setdefault(c, len(known)) for c in own), np.int64, len(own)) for own in chunks]
        words, lanes = Words.of(list(known)), Lanes(np.array([len(c) for c in chunks]))
        flat = np.concatenate(ids)
        laid, _, _ = lanes.forward_backward(self.scores(words)[flat[lanes.place]], self.transition, self.start)
        marginal = np.empty_like(laid)
        marginal[lanes.place] = laid
        counted, at = words.lettered[flat], 0
        for (i, _), own in zip(texts, chunks, strict=True):
            part = slice(at, at + len(own))
            at += len(own)
            yield i, (own, marginal[part], counted[part] if counted[part].any() else np.ones(len(own), bool))

    def spans(self, text: str) -> list[tuple[int, int, str, float]]:
        """(start, end, label, mean probability) of each run of words with one label, in code points, end exclusive.

        Words without a letter go with the run before them; a text without a letter has no span.
        """
        runs: list[list] = []
        for _, (chunks, marginal, counted) in self.words([text]):
            data, at, points = text.encode("utf-8", "replace"), 0, 0
            for chunk, p, own in zip(chunks, marginal, counted, strict=True):
                found = data.index(chunk, at)
                start = points + len(data[at:found].decode("utf-8", "replace"))
                at, points = found + len(chunk), start + len(chunk.decode("utf-8", "replace"))
                if not own:
                    continue
                best = int(p.argmax())
                if runs and runs[-1][2] == self.labels[best]:
                    runs[-1][1] = points
                    runs[-1][3].append(float(p[best]))
                else:
                    runs.append([start, points, self.labels[best], [float(p[best])]])
        return [(a, b, name, sum(ps) / len(ps)) for a, b, name, ps in runs]


def fit(texts: list[str], langs: list[str], seed: int = 0, rounds: int = 60, rate: float = 0.1, decay: float = 1e-3) -> Model:
    """Learn from labelled texts: code-switched sequences are drawn from them, a label for each word.

    Labels are drawn equally often. Weights follow the gradient of the mean log-likelihood (Adam).
    """
    labels = sorted(set(langs))
    k = len(labels)
    by_label = [[c for t, g in zip(texts, langs, strict=True) if g == name and (c := t.encode("utf-8", "replace").split())] for name in labels]
    kept = [i for i in range(k) if by_label[i]]
    labels, by_label = [labels[i] for i in kept], [by_label[i] for i in kept]
    k = len(labels)
    if not k:
        return Model([], np.zeros((BUCKETS + 1, 0)), {}, np.zeros((1, 0)), np.zeros((0, 0)), np.zeros(0))
    counts = [Counter(w for d in docs for w in Words.of(list(dict.fromkeys(d))).plain if w) for docs in by_label]
    lexicon = {}
    for i, own in enumerate(counts):
        for w, n in own.items():
            rates = [c[w] / len(d) for c, d in zip(counts, by_label, strict=True)]
            if n >= 3 and rates[i] >= 0.8 * sum(rates):
                lexicon[w] = i

    random = np.random.default_rng(seed)
    chunks, truth = [], []
    for _ in range(SEQUENCES):
        n = 0
        while n < LENGTH:
            label = int(random.integers(k))
            doc = by_label[label][int(random.integers(len(by_label[label])))]
            size = min(LENGTH - n, int(random.geometric(1 / SPAN)), len(doc))
            at = int(random.integers(len(doc) - size + 1))
            chunks += doc[at : at + size]
            truth += [label] * size
            n += size
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(c, len(known)) for c in chunks])
    words, lanes = Words.of(list(known)), Lanes(np.full(SEQUENCES, LENGTH))
    flat, y = ids[lanes.place], np.array(truth)[lanes.place]
    entry = np.fromiter((lexicon.get(w, k) for w in words.plain), np.int64, len(words.plain))
    owner = np.searchsorted(words.starts, np.arange(len(words.grams[0])), "right") - 1
    hot = np.eye(k)[y]
    pairs = np.zeros((k, k))
    np.add.at(pairs, (y[: (LENGTH - 1) * SEQUENCES], y[SEQUENCES:]), 1.0)

    params = {"w": np.zeros((BUCKETS + 1, k)), "l": np.zeros((k + 1, k)), "t": np.zeros((k, k)), "s": np.zeros(k)}
    m, v = ({n: np.zeros_like(p) for n, p in params.items()} for _ in range(2))
    for step in range(1, rounds + 1):
        t = np.exp(params["t"] - params["t"].max(axis=1, keepdims=True))
        t /= t.sum(axis=1, keepdims=True)
        s = np.exp(params["s"] - params["s"].max())
        s /= s.sum()
        per_word = np.where(words.lettered[:, None], words.sums(params["w"]) + params["l"][entry], 0.0)
        marginal, expected, _ = lanes.forward_backward(per_word[flat], t, s)
        error = hot - marginal
        of_word = np.stack([np.bincount(flat, error[:, i], len(known)) for i in range(k)], axis=1) * words.lettered[:, None]
        spread = of_word[owner]
        grad = {
            "w": sum(np.stack([np.bincount(g, spread[:, i], BUCKETS + 1) for i in range(k)], axis=1) for g in words.grams),
            "l": np.stack([np.bincount(entry, of_word[:, i], k + 1) for i in range(k)], axis=1),
            "t": (pairs - expected) - t * (pairs - expected).sum(axis=1, keepdims=True),
            "s": (hot[:SEQUENCES] - marginal[:SEQUENCES]).sum(axis=0),
        }
        grad["w"][BUCKETS] = 0.0
        for n, p in params.items():
            g = grad[n] / len(y) * 100 - decay * p
            m[n] = 0.9 * m[n] + 0.1 * g
            v[n] = 0.99 * v[n] + 0.01 * g * g
            p += rate * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.99**step)) + 1e-3)
    return Model(labels, params["w"].astype(np.float32), lexicon, params["l"], t, s)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the doc_id as text is divisible by 5; a null doc_id is one."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def fit_on(docs: DataFrame, seed: int = 0) -> Model:
    """Fit on a bounded sample: of each label, the ``FIT_DOCS`` distinct rows (fewer where that would be over
    ``FIT_ALL`` in all) with the smallest hash among those that may be learned from, have a text with up to
    ``FIT_BYTES`` bytes and one of the ``FIT_LABELS`` labels that most of them have."""
    usable = ~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= FIT_BYTES)
    rows = docs.where(usable).select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    # Hashes are spread evenly, so a share of their range that is expected to hold four times the wanted rows
    # of a label holds those with the smallest hashes; only those few rows meet in a window.
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"))
    known = {r["lang"]: max(r["n"], 1) for r in counts.orderBy(F.desc("n"), "lang").limit(FIT_LABELS).collect()}
    if not known:
        return fit([], [], seed)
    each = max(1, min(FIT_DOCS, FIT_ALL // len(known)))
    ends = {lang: min(2**64 - 1, 2**64 * 4 * each // n) - 2**63 for lang, n in known.items()}
    end = F.element_at(F.create_map(*[F.lit(x) for pair in ends.items() for x in pair]), F.col("lang"))
    few = rows.where(F.col("lang").isin(list(known))).where(F.col("h") <= end)
    few = few.groupBy("lang", "h").agg(F.first("text").alias("text"))
    rank = F.expr("row_number() over (partition by lang order by h)")
    sample = few.withColumn("r", rank).where(F.col("r") <= each).collect()
    sample.sort(key=lambda r: (r["lang"], r["h"]))
    return fit([r["text"] for r in sample], [r["lang"] for r in sample], seed)


def labelled(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """A struct (lang_pred, score, certainty) for a text column of ``docs``; null is as empty."""
    shared = Shared(docs.sparkSession, model)  # BUCKETS, FIT_LABELS and FIT_ALL bound it

    @F.pandas_udf("lang_pred string, score double, certainty double")
    def of(texts: pd.Series) -> pd.DataFrame:
        found = shared.value.label(list(texts))
        give_back()
        return pd.DataFrame(found, columns=["lang_pred", "score", "certainty"])

    return of(text_of(docs[text]))


def language_spans(docs: DataFrame, model: Model) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, start, end, lang, probability)``: the runs of words of one language in
    code-switched text, in code points. Texts that are null or have no letter give no row."""
    shared = Shared(docs.sparkSession, model)

    @F.pandas_udf("array<struct<start:int,end:int,lang:string,probability:double>>")
    def of(texts: pd.Series) -> pd.Series:
        names = ("start", "end", "lang", "probability")
        return pd.Series([[dict(zip(names, s, strict=True)) for s in shared.value.spans(t)] for t in texts])

    return docs.select("doc_id", F.explode(of(text_of(docs["text"]))).alias("s")).select("doc_id", "s.*")


def identify(docs: DataFrame, seed: int = 0) -> DataFrame:
    """``docs(doc_id, text, lang)`` to ``(doc_id, held_out, lang_pred, score, certainty)``, a row for each input row.

    Predictions see the text only, of any length and whole. Null texts and texts without a letter are ``und`` with
    score 0, as are all if there is no row to learn from. Of equally likely labels the first in order is taken.
    Rows that repeat are each returned; other columns, whatever their names, are ignored; no row gives none.
    """
    predicted = docs.select("doc_id", held_out().alias("held_out"), labelled(docs, fit_on(docs, seed)).alias("p"))
    return predicted.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.certainty")


def identified(docs: DataFrame, min_certainty: float = 0.5, seed: int = 0) -> DataFrame:
    """The rows of ``docs`` whose words' languages are determined with a mean certainty of ``min_certainty`` or
    more, unchanged: mixed texts stay if it is clear which languages they mix."""
    p = "predicted"
    while p in docs.columns:
        p += "_"
    marked = docs.withColumn(p, labelled(docs, fit_on(docs, seed)))
    kept = (F.col(f"{p}.lang_pred") != UNDETERMINED) & (F.col(f"{p}.certainty") >= min_certainty)
    return marked.where(kept).select(*[marked[c] for c in docs.columns])
