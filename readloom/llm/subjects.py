"""Subject areas of documents by one-versus-rest linear classifiers on hashed word n-grams.

The classifiers judge sentences. Their labels are weak: a sentence of any section, the title line with which a text begins among them, takes the hand
labels of its document; two further rounds keep of a document's labels only those that the classifiers find in the sentence. Sentences that occur alike
under every subject (boilerplate, formulas) get no label in this way. A document has the subjects that take up a calibrated share of its sentences with
any subject, and none if these are calibrated to be passing mentions.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documented bounds of the labelled training sample: documents, chosen by seeded hash, and characters that one of them may have. They are learned from whole.
LABELLED_DOCS, TRAIN_CHARS = 4000, 100_000
#: Hash buckets of the n-grams (a power of two).
BUCKET_BITS = 18
#: Training: passes over the labelled sample, rounds of relabelling and their passes, step, and weight decay.
PASSES, ROUNDS, ROUND_PASSES, STEP, DECAY = 16, 2, 8, 0.25, 1e-4
#: Texts judged at a time.
TEXTS = 64
#: A sentence deals with a subject from this probability on.
SENTENCE = 0.5
#: Share of the subject-bearing sentences that a subject must take up; the calibration moves it within these bounds.
SHARE, SHARE_BOUNDS = 0.25, (0.2, 0.3)
#: Subject-bearing sentences are passing mentions where their share of all sentences is under MENTION times that which all but the RARE lowest of the held
#: out labelled documents reach.
MENTION, RARE = 0.5, 0.01
#: Subjects that a model may have; more are an error.
MOST_SUBJECTS = 1000
SEED = 7

# words of two letters or more in lower case, or the end of a sentence
_TOKEN = re.compile(r"[a-z\u00b5-\uffff]{2,}|[.!?;](?=\s)|\n")
_BREAK = 0


class _Ids(dict):
    """Word to hash; bounded, since it is emptied when full."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        v = self[word] = _BREAK if word in ".!?;\n" else zlib.crc32(word.encode("utf-8", "surrogatepass")) or 1
        return v


_IDS = _Ids()


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash buckets of the word 1- and 2-grams, start of each sentence among them, text of each sentence). Sentences of under two words are left out."""
    get = _IDS.__getitem__
    found = [_TOKEN.findall(t.lower()) for t in texts]
    ids = np.concatenate([np.fromiter((*map(get, w), _BREAK), np.uint64, len(w) + 1) for w in found]) if found else np.empty(0, np.uint64)
    stop = ids == _BREAK
    sentence = np.cumsum(stop)[~stop]
    size = np.bincount(sentence, minlength=int(stop.sum()) + 1)
    keep = size[sentence] > 1
    ids, sentence = ids[~stop][keep], sentence[keep]
    n = len(ids)
    starts = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]]) if n else np.empty(0, np.int64)
    text_of = np.cumsum(np.bincount(np.cumsum([len(w) + 1 for w in found])[:-1] if found else [], minlength=len(stop)))[~stop][keep][starts] if n else starts
    mix, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - BUCKET_BITS)
    out = np.empty(2 * n, np.int32)
    out[0::2] = (ids * mix) >> shift
    if n:
        two = np.r_[((ids[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + ids[1:]) * mix) >> shift, np.uint64(0)].astype(np.int32)
        last = np.r_[starts[1:], n] - 1
        two[last] = out[0::2][last]  # no pair across sentences
        out[1::2] = two
    return out, starts * 2, text_of


#: Features summed at a time: bounds the memory of a pass over the sample.
BLOCK = 1 << 17


def _sums(rows: np.ndarray, index: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of rows[index] over each segment that begins at starts; no segment is empty."""
    out = np.empty((len(starts), rows.shape[1]), np.float32)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + BLOCK)))
        end = starts[j] if j < len(starts) else len(index)
        out[i:j] = np.add.reduceat(np.take(rows, index[starts[i] : end], axis=0), starts[i:j] - starts[i], axis=0)
        i = j
    return out


class Model:
    """One-versus-rest classifiers. slot maps a hash bucket to its row of weights; row 0 is zero, for buckets not learned."""

    def __init__(self, subjects: list[str], slot: np.ndarray, weights: np.ndarray, bias: np.ndarray, shares: np.ndarray, mention: float = 0.0):
        self.subjects, self.slot, self.weights, self.bias, self.shares, self.mention = subjects, slot, weights, bias, shares, mention

    def sentences(self, feats: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Probability of each subject for each sentence."""
        if not len(starts):
            return np.empty((0, len(self.subjects)), np.float32)
        size = np.diff(np.r_[starts, len(feats)])
        z = _sums(self.weights, self.slot[feats], starts) / np.sqrt(size)[:, None].astype(np.float32) + self.bias
        return 1 / (1 + np.exp(-z))

    def shares_of(self, p: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(share of each subject, subject-bearing sentences) of n texts."""
        k = len(self.subjects)
        if not len(p):
            return np.zeros((n, k)), np.zeros(n, int)
        sure = p.max(1) >= SENTENCE
        votes = np.bincount(text[sure] * k + p[sure].argmax(1), minlength=n * k).reshape(n, k)
        total = votes.sum(1)
        return votes / np.maximum(total, 1)[:, None], total

    def judge(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, subject) numbers of the subjects that texts have."""
        feats, starts, text = features(texts)
        share, total = self.shares_of(self.sentences(feats, starts), text, len(texts))
        enough = total >= np.maximum(1, self.mention * np.bincount(text, minlength=len(texts)))
        return np.nonzero((share >= self.shares) & enough[:, None])


def _fit(feats, starts, y, weight, passes: int, warm: np.ndarray | None, bias: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression of every column of y, all at once, by adaptive gradient steps over the whole sample. feats are rows of the weights; row 0
    stays zero."""
    k, d = y.shape[1], len(warm)
    size = np.diff(np.r_[starts, len(feats)])
    row = np.repeat(np.arange(len(starts)), size)
    scale = (1 / np.sqrt(size)).astype(np.float32)[:, None]
    w, b = warm.copy(), bias.copy()
    gw, gb = np.full((d, k), 1e-6, np.float32), np.full(k, 1e-6, np.float32)
    order = np.argsort(feats, kind="stable")
    sorted_ = feats[order]
    first = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
    by_feature, present = row[order], sorted_[first]
    for _ in range(passes):
        z = _sums(w, feats, starts) * scale + b
        g = ((1 / (1 + np.exp(-z)) - y) * weight[:, None]).astype(np.float32)
        dw = DECAY * len(starts) / d * w
        dw[present] += _sums(g * scale, by_feature, first)
        dw[0] = 0
        db = g.sum(0)
        gw += dw * dw
        gb += db * db
        w -= STEP * 4 * dw / np.sqrt(gw)
        b -= STEP * db / np.sqrt(gb)
    return w, b


def train(docs: list[tuple[str, set[str]]], subjects: list[str]) -> Model:
    """docs: (text, labels). Labels beyond subjects are ignored. Every fifth document calibrates the shares and is not learned from."""
    k = len(subjects)
    index = {s: i for i, s in enumerate(subjects)}
    truth = np.zeros((len(docs), k), bool)
    for i, (_, labels) in enumerate(docs):
        truth[i, [index[s] for s in labels if s in index]] = True
    held = np.arange(len(docs)) % 5 == 4
    feats, starts, text = features([t for (t, _), h in zip(docs, held, strict=True) if not h])
    slot = np.zeros(1 << BUCKET_BITS, np.int32)
    seen, often = np.unique(feats, return_counts=True)
    seen = seen[often >= 2]
    slot[seen] = np.arange(1, len(seen) + 1)
    shares = np.full(k, SHARE)
    weights, bias = np.zeros((len(seen) + 1, k), np.float32), np.full(k, -2.0, np.float32)
    if not truth.any() or not len(starts):
        return Model(subjects, slot, weights, np.full(k, -9.0, np.float32), shares)
    rows = slot[feats]
    allowed = truth[~held][text]
    y = allowed.astype(np.float32)
    weights, bias = _fit(rows, starts, y, np.where(y.sum(1) > 1, 0.5, 1.0).astype(np.float32), PASSES, weights, bias)
    for _ in range(ROUNDS):
        kept = np.where(allowed, Model(subjects, slot, weights, bias, shares).sentences(feats, starts), 0)
        best = kept.max(1)
        y = allowed & (kept >= best[:, None]) & (best >= 0.3)[:, None]
        weights, bias = _fit(rows, starts, y.astype(np.float32), np.ones(len(starts), np.float32), ROUND_PASSES, weights, bias)
    model = Model(subjects, slot, weights, bias, shares)
    if held.any():
        judged = [t for (t, _), h in zip(docs, held, strict=True) if h]
        f, s, t = features(judged)
        (share, total), right = model.shares_of(model.sentences(f, s), t, len(judged)), truth[held]
        grid = np.linspace(*SHARE_BOUNDS, 11)
        for j in range(k):
            if right[:, j].sum() >= 20:
                score = np.array([2 * ((h := share[:, j] >= c) & right[:, j]).sum() / max(1, h.sum() + right[:, j].sum()) for c in grid])
                best = np.flatnonzero(score >= score.max() - 1e-9)
                shares[j] = grid[best[np.abs(grid[best] - SHARE).argmin()]]
        model.mention = MENTION * float(np.quantile(total / np.maximum(np.bincount(t, minlength=len(judged)), 1), RARE))
    return model


def training_sample(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> tuple[list[tuple[str, set[str]]], list[str]]:
    """Bounded: at most LABELLED_DOCS hand-labelled documents come to the driver; of these, those of at most TRAIN_CHARS characters. Texts are read once."""
    names = sorted(r[0] for r in subjects.where("subject IS NOT NULL").select("subject").distinct().limit(MOST_SUBJECTS + 1).collect())
    if len(names) > MOST_SUBJECTS:
        raise ValueError(f"more than {MOST_SUBJECTS} subjects")
    by_doc = labels.where("doc_id IS NOT NULL AND subject IS NOT NULL").groupBy("doc_id").agg(F.collect_set("subject").alias("labels"))
    pick = by_doc.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(LABELLED_DOCS)
    texts = documents.where(F.length("text") <= TRAIN_CHARS).select("doc_id", "text").join(F.broadcast(pick), "doc_id")
    return [(r["text"], set(r["labels"])) for r in sorted(texts.collect(), key=lambda r: (r["doc_id"], r["text"]))], names


def subject_areas(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """(doc_id, subject) of every document that deals with a subject; whole texts are judged.

    Null and empty texts and texts without subject matter have no row. labels: doc_id, subject, may be wrong, repeated or name unknown subjects. Without
    any usable label no document gets a subject."""
    model = train(*training_sample(documents, labels, subjects))
    names = model.subjects
    shared = documents.sparkSession.sparkContext.broadcast((model.slot, model.weights, model.bias, model.shares, model.mention))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Model(names, *shared.value)
        for pdf in batches:
            ids, texts = pdf["doc_id"].to_numpy(), pdf["text"].tolist()
            for i in range(0, len(texts), TEXTS):
                doc, subject = m.judge(texts[i : i + TEXTS])
                yield pd.DataFrame({"doc_id": ids[i + doc], "subject": [names[j] for j in subject]}, columns=["doc_id", "subject"]).astype({"doc_id": "int64", "subject": "object"})

    whole = documents.where("doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''").select("doc_id", "text")
    return whole.mapInPandas(judge, "doc_id BIGINT, subject STRING")
