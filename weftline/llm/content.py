"""Scoring documents for abusive, hateful or sexual content by multiple-instance learning.

Labels are per document, offences are in single sentences. A sentence's score is a logistic
function of its hashed n-grams; a document's score is the noisy-or of its sentences,
1 - prod(1 - p). The weights are fitted on the document labels through the noisy-or, so that the
fit decides which sentences are to blame; the same scores then locate them.

Fitting happens on the driver on at most ``max_labels`` labelled documents (those with the lowest
hash of their id; all of them if fewer). Weights are kept by the hash of what they were fitted on,
so queries over the same labels fit once. The weights, 2^bits floats whatever the data, go to the
executors, which score every document whole; a task remembers the scores of the sentences it met, so
one that comes again is mostly scored once.

Defined cases: a null, empty or blank text has score 0; labels of unknown documents and null
labels are ignored; contradicting labels of a document all take part; without any labels, or with
labels of one kind only, all scores are 0. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.sentences import features, sentences


KEPT = 1 << 18  # sentences whose scores a task remembers


@dataclass(frozen=True)
class ContentModel:
    bits: int = 18
    epochs: int = 12
    min_steps: int = 1500  # more epochs where labels are few
    batch: int = 64
    rate: float = 0.02
    decay: float = 2e-5
    bias: float = -4.0
    trust: float = 0.97  # share of labels taken to be right
    max_labels: int = 10000
    flag: float = 0.5
    seed: int = 11


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def sentence_scores(weights: np.ndarray, sents: list[str], bits: int, known: dict[str, float]) -> np.ndarray:
    """A score for each sentence. ``known`` keeps those of a bounded number of sentences."""
    new = [s for s in dict.fromkeys(sents) if s not in known]
    if len(known) + len(new) > KEPT:
        known.clear()
        new = list(dict.fromkeys(sents))
    if new:
        off, idx = features(new, bits)
        known.update(zip(new, _sigmoid(_logits(weights, off, idx)).tolist(), strict=True))
    return np.array([known[s] for s in sents])


def _logits(weights: np.ndarray, off: np.ndarray, idx: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(weights[idx], dtype=np.float64)])
    return weights[-1] + (sums[off[1:]] - sums[off[:-1]]) / np.sqrt(np.maximum(1, np.diff(off)))


def fit(texts: list[str], labels: list[bool], cfg: ContentModel) -> np.ndarray:
    """2^bits weights and the bias (last)."""
    w = np.zeros((1 << cfg.bits) + 1, np.float32)
    w[-1] = cfg.bias
    if not any(labels) or all(labels):
        w[-1] = -30.0
        return w
    # per document: offsets of its sentences and their feature indices; featurised in small blocks
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    right: list[bool] = []
    for lo in range(0, len(texts), cfg.batch):
        docs = [sentences(t) for t in texts[lo : lo + cfg.batch]]
        flat = [s for d in docs for s in d]
        if not flat:
            continue
        off, idx = features(flat, cfg.bits)
        at = 0
        for d, bad in zip(docs, labels[lo : lo + cfg.batch], strict=True):
            if d:
                o = off[at : at + len(d) + 1]
                kept.append(((o - o[0]).astype(np.int32), idx[o[0] : o[-1]].copy()))
                right.append(bad)
                at += len(d)
    y = np.where(np.array(right, bool), cfg.trust, 1 - cfg.trust)
    rng = np.random.default_rng(cfg.seed)
    m, v = np.zeros_like(w), np.zeros_like(w)
    step = 0
    epochs = max(cfg.epochs, -(-cfg.min_steps * cfg.batch // max(1, len(kept))))
    for epoch in range(epochs):
        rate = cfg.rate * (1 - epoch / epochs)
        order = rng.permutation(len(kept))
        for k in range(0, len(order), cfg.batch):
            pick = order[k : k + cfg.batch]
            feat = np.concatenate([kept[i][1] for i in pick])
            n = np.concatenate([np.diff(kept[i][0]) for i in pick])
            size = np.array([len(kept[i][0]) - 1 for i in pick])
            local = np.concatenate([[0], np.cumsum(n)])
            p = _sigmoid(_logits(w, local, feat))
            first = np.concatenate([[0], np.cumsum(size)[:-1]])
            stay = np.exp(np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-7)), first))
            doc = np.clip(1 - stay, 1e-7, 1 - 1e-7)
            # d loss / d logit of a sentence: p * (1 - y / P) of its document
            g = p * np.repeat(1 - y[pick] / doc, size) / len(pick)
            grad = np.bincount(feat, weights=np.repeat(g / np.sqrt(np.maximum(1, n)), n), minlength=len(w)).astype(np.float32)
            grad[-1] = g.sum()
            step += 1
            m = 0.9 * m + 0.1 * grad
            v = 0.999 * v + 0.001 * grad * grad
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
            w[:-1] *= 1 - cfg.decay
    return w


def labelled(docs: DataFrame, labels: DataFrame, cfg: ContentModel) -> tuple[list[str], list[bool]]:
    """Texts and labels of at most ``max_labels`` labelled documents."""
    l = labels.where(F.col("doc_id").isNotNull() & F.col("category").isNotNull()).select("doc_id", (F.lower(F.trim("category")) != "none").alias("bad"))
    l = l.orderBy(F.xxhash64("doc_id"), "doc_id").limit(cfg.max_labels)
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(l, "doc_id").select("doc_id", "text", "bad").collect()
    rows = sorted(rows, key=lambda r: (r[0], r[2]))
    return [r[1] for r in rows], [r[2] for r in rows]


_FITTED: dict[bytes, np.ndarray] = {}


def fitted(texts: list[str], labels: list[bool], cfg: ContentModel) -> np.ndarray:
    """``fit``, or what it gave for the same texts, labels and parameters (the last few are kept)."""
    h = hashlib.sha256(repr(cfg).encode())
    for t, bad in zip(texts, labels, strict=True):
        raw = t.encode("utf-8", "surrogatepass")
        h.update(len(raw).to_bytes(8, "little") + raw + bytes([bad]))
    key = h.digest()
    if key not in _FITTED:
        while len(_FITTED) >= 4:
            _FITTED.pop(next(iter(_FITTED)))
        _FITTED[key] = fit(texts, labels, cfg)
    return _FITTED[key]


def _scored(docs: list[list[str]], w: np.ndarray, bits: int, known: dict[str, float]) -> Iterator[tuple[list[str], np.ndarray]]:
    """The sentences of each document with their scores."""
    flat = [s for d in docs for s in d]
    p = sentence_scores(w, flat, bits, known) if flat else np.zeros(0)
    at = 0
    for d in docs:
        yield d, p[at : at + len(d)]
        at += len(d)


def _locate(cfg: ContentModel, weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            out = []
            for lo in range(0, len(texts), 512):
                for doc, (d, q) in zip(ids[lo : lo + 512], _scored([sentences(t) for t in texts[lo : lo + 512]], weights.value, cfg.bits, known), strict=True):
                    if len(q) and 1 - np.prod(1 - q) >= cfg.flag:
                        out += [(doc, int(k), d[k], float(q[k])) for k in np.flatnonzero((q >= cfg.flag) | (q == q.max()))]
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.float64()), strict=True)], names=["doc_id", "place", "sentence", "score"])

    return run


def _score(cfg: ContentModel, weights):
    schema = ["doc_id", "score", "sentences", "offending", "worst", "worst_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, known = weights.value, {}
        for b in batches:
            texts = b.column("text").to_pylist()
            for lo in range(0, len(texts), 512):
                docs = [sentences(t) for t in texts[lo : lo + 512]]
                out = []
                for d, q in _scored(docs, w, cfg.bits, known):
                    k = int(q.argmax()) if len(q) else -1
                    out.append((float(1 - np.prod(1 - q)), len(d), int((q >= cfg.flag).sum()), d[k] if k >= 0 else None, float(q[k]) if k >= 0 else 0.0))
                cols = list(zip(*out, strict=True))
                kinds = [pa.float64(), pa.int32(), pa.int32(), pa.string(), pa.float64()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, 512), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=schema)

    return run


def content_scores(docs: DataFrame, labels: DataFrame, cfg: ContentModel = ContentModel()) -> DataFrame:
    """(doc_id, score, sentences, offending, worst, worst_score): the score of each document, its
    number of sentences and of those at or above ``flag``, and its worst sentence in normal form."""
    return docs.select("doc_id", "text").mapInArrow(_score(cfg, _weights(docs, labels, cfg)), "doc_id long, score double, sentences int, offending int, worst string, worst_score double")


def _weights(docs: DataFrame, labels: DataFrame, cfg: ContentModel):
    return docs.sparkSession.sparkContext.broadcast(fitted(*labelled(docs, labels, cfg), cfg))


def offending_sentences(docs: DataFrame, labels: DataFrame, cfg: ContentModel = ContentModel()) -> DataFrame:
    """(doc_id, place, sentence, score): of each document at or above ``flag`` all sentences that are
    so themselves, or else its worst, with their places among its sentences (from 0)."""
    return docs.select("doc_id", "text").where(F.length("text") > 0).mapInArrow(_locate(cfg, _weights(docs, labels, cfg)), "doc_id long, place int, sentence string, score double")
