"""Scores texts for abusive, hateful or sexual content.

The classifier is linear in words, pairs of neighbouring words and pairs with one word between, over the words of
:mod:`statelog.llm.wording`. A text is scored by its worst stretch of WINDOW words, so a long harmless page doesn't hide one
insult, and reviewers' labels, which are given to whole texts, teach what such a stretch is. Training is counterfactually
regularised: in the labelled stretches, identity terms are swapped for others, and a change of the score is penalised, so that
neutral mentions of a group don't count against a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statelog.llm.wording import plain_word, raw_words

#: Labelled texts that the classifier is fitted on at most, and characters of all of them together; texts are taken whole, in the order of a
#: hash of their id, until one of the bounds is reached. Scoring has no such bounds.
FIT_TEXTS, FIT_CHARS = 10_000, 100_000_000
WINDOW = 10
#: Spellings a worker remembers.
CACHE = 500_000
#: Texts (pages where known) a word or pair must occur in to be a feature.
LEAST = 3
EPOCHS, RATE, RIDGE, COUNTERFACTUAL, SWAPS = 40, 0.3, 2e-4, 0.5, 2
THRESHOLD = 0.55

# Words that name groups of people.
IDENTITY_TERMS = """women men girls boys gays lesbians trans muslims jews christians hindus buddhists atheists immigrants refugees
foreigners blacks whites asians africans arabs latinos americans europeans germans french spaniards russians poles turks chinese
japanese indians mexicans roma gypsies disabled elderly"""


@dataclass
class Model:
    """Weights by word and by pair of words; pairs are keyed ``a * len(words) + b`` in order."""

    words: dict[str, int]
    masked: dict[str, str]
    single: np.ndarray
    pair_keys: np.ndarray
    pair_weights: np.ndarray
    skip_keys: np.ndarray
    skip_weights: np.ndarray
    bias: float
    known: dict[str, int] = field(default_factory=dict)

    def ids(self, text: str | None) -> np.ndarray:
        known = self.known
        if len(known) > CACHE:
            known.clear()
        raw = raw_words(text)
        out = [known.get(w, -1) for w in raw]
        if -1 in out:
            for i, w in enumerate(raw):
                if out[i] < 0:
                    out[i] = known[w] = self._id(w)
        return np.array(out, np.int64)

    def _id(self, raw: str) -> int:
        w = plain_word(raw)
        return self.words.get(self.masked.get(_mask(w), "") if "*" in w else w, 0)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probability of each text; a text without words has 0."""
        parts = [self.ids(t) for t in texts]
        lens = np.array([len(p) for p in parts])
        out = np.zeros(len(texts))
        if lens.sum() == 0:
            return out
        flat = np.concatenate(parts)
        first = np.r_[0, lens.cumsum()[:-1]]
        w = self.single[flat]
        n = len(self.single)
        for lag, keys, weights in ((1, self.pair_keys, self.pair_weights), (2, self.skip_keys, self.skip_weights)):
            w = w + _looked_up(_lagged(flat, first, lens, lag, n), keys, weights)
        worst = _window_max(w, first[lens > 0], lens[lens > 0])[0]
        out[lens > 0] = 1 / (1 + np.exp(-np.clip(worst + self.bias, -30, 30)))
        return out


def _mask(w: str) -> str:
    """Shape of a masked word: letters that are left and the length."""
    core = w.rstrip("*") if not w.endswith("*") else w
    return "".join(c if c != "*" else "." for c in core)


def _lagged(flat: np.ndarray, first: np.ndarray, lens: np.ndarray, lag: int, n: int) -> np.ndarray:
    """Key of the pair of each word with the one ``lag`` before it in the same text, -1 where there is none."""
    keys = np.full(len(flat), -1, np.int64)
    if len(flat) > lag:
        keys[lag:] = flat[:-lag] * n + flat[lag:]
    at = np.concatenate([first[lens > k] + k for k in range(lag)]) if len(first) else np.array([], np.int64)
    keys[at] = -1
    return keys


def _looked_up(keys: np.ndarray, known: np.ndarray, weights: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(keys))
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, weights[at], 0.0)


def _window_max(w: np.ndarray, first: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Greatest sum over WINDOW words in a row of each text, and the last word of that stretch."""
    c = np.r_[0.0, np.cumsum(w)]
    begin = np.repeat(first, lens)
    end = np.arange(len(w)) + 1
    sums = c[end] - c[np.maximum(begin, end - WINDOW)]
    best = np.maximum.reduceat(sums, first)
    hit = np.flatnonzero(sums == np.repeat(best, lens))
    doc = np.searchsorted(first, hit, side="right") - 1
    where = np.full(len(first), -1)
    where[doc[::-1]] = hit[::-1]
    return best, where


def fit(rows: list[tuple[str | None, float, int | None]], identity: str = IDENTITY_TERMS) -> Model:
    """Fit on ``(text, label in [0, 1], page)``. What is abusive follows from the labels alone; without any, every text has the same low score."""
    groups = identity.split()
    spelled: dict[str, int] = {}  # a word as it stands in the texts -> number of its plain form
    plain: dict[str, int] = {}
    docs = []
    for text, _, _ in rows:
        raw = raw_words(text)
        for w in raw:
            if w not in spelled:
                spelled[w] = plain.setdefault(plain_word(w), len(plain))
        docs.append(np.array([spelled[w] for w in raw], np.int32))
    del spelled
    names = list(plain)
    pages = np.array([p if p is not None else -1 - i for i, (_, _, p) in enumerate(rows)], np.int64)
    number = np.unique(pages, return_inverse=True)[1]
    count = np.zeros(len(names), np.int64)
    if docs:
        pairs = [np.unique(d).astype(np.int64) + int(p) * len(names) for d, p in zip(docs, number, strict=True)]
        count += np.bincount(np.unique(np.concatenate(pairs)) % max(len(names), 1), minlength=len(names))
    listed = set(groups)
    known = sorted({w for w, n in zip(names, count.tolist(), strict=True) if n >= LEAST and "*" not in w} | listed)
    words = {w: i + 1 for i, w in enumerate(known)}  # 0: any other word
    n = len(words) + 1
    masked = {_mask(w): "" for w in names if "*" in w}
    for w in known:
        for shape in (w[0] + "." * (len(w) - 2) + w[-1], w[0] + "." * (len(w) - 1)) if len(w) > 2 else ():
            if shape in masked and not masked[shape]:
                masked[shape] = w
    masked = {k: v for k, v in masked.items() if v}
    bias = -2.5
    model = Model(words, masked, np.zeros(n), np.array([], np.int64), np.array([]), np.array([], np.int64), np.array([]), bias)
    to_id = np.array([words.get(masked.get(_mask(w), "") if "*" in w else w, 0) for w in names], np.int64)
    keep = [i for i, d in enumerate(docs) if len(d)]
    if not keep:
        return model
    parts = [to_id[docs[i]] for i in keep]
    del docs
    y = np.array([rows[i][1] for i in keep], float)
    page = pages[keep]
    lens = np.array([len(p) for p in parts])
    first = np.r_[0, lens.cumsum()[:-1]]
    flat = np.concatenate(parts)
    doc_of = np.repeat(np.arange(len(parts)), lens)
    columns, tables = [flat.copy()], []
    size = n
    for lag in (1, 2):
        keys = _lagged(flat, first, lens, lag, n)
        pairs = np.unique(np.stack([keys, np.unique(page, return_inverse=True)[1][doc_of]]), axis=1)
        ks, counts = np.unique(pairs[0], return_counts=True)
        ks = ks[(counts >= LEAST) & (ks >= 0)]
        at = np.minimum(np.searchsorted(ks, keys), max(len(ks) - 1, 0))
        columns.append(np.where(ks[at] == keys, at + size, -1) if len(ks) else np.full(len(keys), -1))
        tables.append((ks, size))
        size += len(ks)
    feats = [c.astype(np.int32) for c in columns]
    for f in feats:
        f[f < 0] = size  # a last weight that stays 0
    w = _log_odds(feats, doc_of, y, page, size)
    w[0] = w[size] = 0.0
    group_ids = np.array([words[g] for g in groups])
    is_group = np.isin(flat, group_ids)
    swapped = _swapped(flat, is_group, group_ids, first, lens, n, tables, size)
    grad_sum, bias_sum = np.full(size + 1, 1e-2), 1e-2
    weight = np.where(y > 0.5, 0.5 / max((y > 0.5).mean(), 0.05), 0.5 / max((y <= 0.5).mean(), 0.05))
    weight = np.clip(weight, 0.3, 3.0)
    for _ in range(EPOCHS):
        each = _summed(w, feats)
        best, last = _window_max(each, first, lens)
        p = 1 / (1 + np.exp(-np.clip(best + bias, -30, 30)))
        err = (p - y) * weight
        g = np.zeros(size + 1)
        span = last[:, None] - np.arange(WINDOW)[None, :]
        inside = span >= first[:, None]
        at = np.where(inside, span, 0)
        for f in feats:
            np.add.at(g, f[at][inside], np.repeat(err, WINDOW).reshape(inside.shape)[inside])
        # identity terms swapped in the stretches that decide: the change of the score is penalised
        has = inside & is_group[at]
        rows_with = np.flatnonzero(has.any(1))
        for s in swapped:
            if not len(rows_with):
                break
            a, ok = at[rows_with], inside[rows_with]
            change = np.where(ok, each[a] - _summed(w, [f[a] for f in s]), 0.0).sum(1)
            push = np.repeat(change * COUNTERFACTUAL / len(swapped), WINDOW).reshape(a.shape)
            for f, f2 in zip(feats, s, strict=True):
                np.add.at(g, f[a][ok], push[ok])
                np.add.at(g, f2[a][ok], -push[ok])
        g += RIDGE * len(y) * w
        grad_sum += g * g
        w -= RATE * g / np.sqrt(grad_sum)
        w[0] = w[size] = 0.0
        bias_sum += err.sum() ** 2
        bias -= RATE * err.sum() / np.sqrt(bias_sum)
    (k1, o1), (k2, o2) = tables
    return Model(words, masked, w[:n].copy(), k1, w[o1 : o1 + len(k1)].copy(), k2, w[o2 : o2 + len(k2)].copy(), float(bias))


def _summed(w: np.ndarray, feats: list[np.ndarray]) -> np.ndarray:
    out = w[feats[0]]
    for f in feats[1:]:
        out += w[f]
    return out


def _log_odds(feats: list[np.ndarray], doc_of: np.ndarray, y: np.ndarray, page: np.ndarray, size: int) -> np.ndarray:
    """Start of the weights: shrunk log odds of a feature in abusive against other texts."""
    pos, neg = np.zeros(size + 1), np.zeros(size + 1)
    for f in feats:
        both = np.unique(np.stack([f, doc_of]), axis=1)
        np.add.at(pos, both[0], y[both[1]])
        np.add.at(neg, both[0], 1 - y[both[1]])
    rate = np.clip(y.mean(), 0.05, 0.95)
    odds = np.log((pos + 20 * rate) / (neg + 20 * (1 - rate))) - np.log(rate / (1 - rate))
    return 0.3 * odds


def _swapped(flat: np.ndarray, is_group: np.ndarray, group_ids: np.ndarray, first: np.ndarray, lens: np.ndarray, n: int, tables: list, size: int) -> list[list[np.ndarray]]:
    """Features of the texts with each identity term replaced by another one."""
    out = []
    where = np.searchsorted(np.sort(group_ids), flat[is_group])
    ordered = np.sort(group_ids)
    for s in range(SWAPS):
        other = flat.copy()
        other[is_group] = ordered[(where + 7 * s + 5) % len(ordered)]
        columns = [other.astype(np.int32)]
        for lag, (ks, offset) in zip((1, 2), tables, strict=True):
            keys = _lagged(other, first, lens, lag, n)
            if len(ks):
                at = np.minimum(np.searchsorted(ks, keys), len(ks) - 1)
                columns.append(np.where(ks[at] == keys, at + offset, size).astype(np.int32))
            else:
                columns.append(np.full(len(keys), size, np.int32))
        out.append(columns)
    return out


def labelled_texts(docs: DataFrame, labels: DataFrame, most: int = FIT_TEXTS, chars: int = FIT_CHARS) -> list[tuple[str | None, float, int | None]]:
    """A sample of the labelled texts, ``(text, mean vote, page)``; null votes and null texts don't count.

    At most ``most`` texts, and whole texts up to ``chars`` characters in all, picked by a hash of their id; the first is always taken.
    """
    votes = labels.where("abusive is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("abusive").alias("vote")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.where("text is not null").select("doc_id", "text", "page_id").join(votes, "doc_id").withColumn("chars", F.length("text"))
    w = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)  # at most ``most`` rows
    before = rows.select("doc_id", "chars").select("doc_id", F.coalesce(F.sum("chars").over(w), F.lit(0)).alias("before"), "chars")
    taken = before.where((F.col("before") == 0) | (F.col("before") + F.col("chars") <= chars)).select("doc_id")
    out = rows.join(F.broadcast(taken), "doc_id", "left_semi").orderBy("doc_id")
    return [(r["text"], min(max(r["vote"], 0.03), 0.97), r["page_id"]) for r in out.collect()]


def score_texts(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``(keep..., score)`` of every text; null, empty and wordless ones score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                scores = shared.value.scores(part.column(len(keep)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(scores, pa.float64())], [*keep, "score"])

    return docs.select(*keep, "text").mapInArrow(run, f"{kinds}, score double")
