"""Abusive, hateful or sexual content, scored by FTRL-proximal logistic
regression over hashed word n-grams and skip-grams.

A document is as bad as its worst passage, so passages are scored. Labels are
of documents: the model first learns from whole documents, then from passages,
where in each bad document the passages that the model so far finds worst are
the bad ones and all passages of clean documents are clean. Per-coordinate
learning rates and L1 make the weights sparse: what is broadcast is one entry
per weight that is not zero, at most 2^20 of them.

Some labels are wrong. A bad label counts if two reviewers gave it, or if some
passage of the document has several features that other bad documents share and
clean ones lack: the passages of a document that is wrongly called bad have
none. What is left is dealt into folds, a model is fitted without each of them,
and the cut-off is chosen by the scores of the documents that a model has not
seen; the mean of these models is used.

The models are fitted on the driver from a bounded sample of the labelled
documents (MOST_LABELS, MOST_BYTES); scoring covers every document whole.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almagest.functions.textfold import LIGATURES, LIKE, LIKE_AS, invisibles, spaces, variant_letters
from almagest.llm.bpe import over_all_cores

#: Hash space of the features; the most labelled documents, and bytes of their texts, that the model is fitted on.
BITS, MOST_LABELS, MOST_BYTES = 20, 6_000, 24 << 20
#: Parts that the labelled documents are dealt into.
FOLDS = 3
#: Features of a passage that back a bad label.
BACKED = 5
#: FTRL: learning rate, smoothing, L1 and L2; passes over the sample.
ALPHA, BETA, L1, L2, PASSES, ROUNDS, BATCH, RATIO = 1.0, 1.0, 0.02, 0.02, 3, 2, 64, 19.0
#: Words of a worker's memo; the word that stands for the end of a line.
MEMO, LINE = 300_000, "\x1e"
_MASK = np.uint64((1 << BITS) - 1)
_MUL = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]

# Digits and signs written for letters.
_LEET = str.maketrans("0134578@$!|", "oieastbasil")
_DIGIT = re.compile(r"\d")
_END = re.compile(r"[.!?…。！？;:][\"'”’»)\]]*$")
_SPACED = re.compile(r"(?<!\S)\w(?: \w){3,}(?!\w)")


@functools.cache
def _fold_table() -> dict:
    t = {ord(c): None for c in invisibles() + spaces()}
    t |= {ord(k): v for k, v in variant_letters().items()} | {ord(k): v for k, v in LIGATURES.items()}
    return t | {ord(a): b for a, b in zip(LIKE, LIKE_AS)}


def plain_word(w: str) -> str:
    """A word in lower case without accents and marks inside, look-alike and
    variant letters as the usual ones, signs written for letters read as
    letters, repeats cut; "0" for a number or designation, "" for no word."""
    if not w.isascii():
        w = unicodedata.normalize("NFD", w.translate(_fold_table()))
        w = "".join(c for c in w if not unicodedata.combining(c))
    w = w.lower()
    digits = len(_DIGIT.findall(w))
    if digits or "@" in w or "$" in w:
        # mostly digits: a number or a designation, not a disguised word
        if digits * 2 >= sum(c.isalnum() for c in w):
            return "0"
        w = w.strip("!|").translate(_LEET)
    if not w.isalpha():
        w = "".join(c for c in w if c.isalpha())
    return re.sub(r"(.)\1{2,}", r"\1", w)


class _Codes(dict):
    """Word to code; a new one is given the next code and noted."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, w: str) -> int:
        self[w] = code = len(self)
        self.new.append(w)
        return code


class Features:
    """Hashed features of the passages of texts: words, pairs of neighbours,
    pairs with one or two words between them, triples. A passage is a line, or
    the part of one up to a sentence's end. What a word becomes is kept, so the
    work per word of text is one look-up; the rest runs on whole arrays."""

    def __init__(self):
        self._reset()

    def _reset(self) -> None:
        self.codes, self.chars = _Codes(), 0
        self.hash, self.ends = np.zeros(1 << 14, dtype=np.uint64), np.zeros(1 << 14, dtype=bool)

    def _learn(self) -> None:
        new, self.codes.new = self.codes.new, []
        n = len(self.codes)
        while n > len(self.hash):
            self.hash, self.ends = np.concatenate([self.hash, np.zeros_like(self.hash)]), np.concatenate([self.ends, np.zeros_like(self.ends)])
        for k, w in enumerate(new, n - len(new)):
            p = plain_word(w)
            self.hash[k] = xxhash.xxh64_intdigest(p) if p else 0
            self.ends[k] = w == LINE or _END.search(w) is not None
            self.chars += len(w)

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(feature indexes, passage of each, document of each passage)."""
        if len(self.codes) > MEMO or self.chars > 8_000_000:
            self._reset()
        codes, get = [], self.codes.__getitem__
        size = np.zeros(len(texts), dtype=np.int64)
        for k, t in enumerate(texts):
            if t:
                if _SPACED.search(t):
                    t = _SPACED.sub(lambda m: m.group().replace(" ", ""), t)
                codes.extend(map(get, t.replace("\n", f" {LINE} ").split()))
                codes.append(get(LINE))
            size[k] = len(codes)
        self._learn()
        c = np.array(codes, dtype=np.int64)
        doc = np.repeat(np.arange(len(texts)), np.diff(size, prepend=0))
        row = np.concatenate([[0], np.cumsum(self.ends[c])[:-1]]) if len(c) else np.zeros(0, np.int64)
        a = self.hash[c]
        keep = a != 0
        a, row, doc = a[keep], row[keep], doc[keep]
        if not len(a):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        first = np.concatenate([[True], row[1:] != row[:-1]])
        row = np.cumsum(first) - 1
        feats, rows = [a * _MUL[0]], [row]
        for gap in (1, 2, 3):
            same = row[gap:] == row[:-gap]
            # neighbours keep their order; skip-grams of one and two words count as the same
            feats.append(((a[:-gap] * _MUL[1] + a[gap:]) * _MUL[2] + np.uint64(min(gap, 2)))[same])
            rows.append(row[gap:][same])
        same = row[2:] == row[:-2]
        feats.append((((a[:-2] * _MUL[1] + a[1:-1]) * _MUL[2] + a[2:]) * _MUL[3])[same])
        rows.append(row[2:][same])
        f = np.concatenate(feats)
        f = ((f ^ (f >> np.uint64(32))) * _MUL[0] >> np.uint64(20)) & _MASK
        return f.astype(np.int32), np.concatenate(rows), doc[first]


class Ftrl:
    """FTRL-proximal logistic regression over binary features; a passage's
    margin is the sum of its weights over the root of their number."""

    def __init__(self, l1: float = L1):
        self.z, self.n, self.l1 = np.zeros(1 << BITS), np.zeros(1 << BITS), l1
        self.bias_z, self.bias_n = 0.0, 0.0

    def weights(self, idx: np.ndarray) -> np.ndarray:
        z, n = self.z[idx], self.n[idx]
        w = -(z - np.sign(z) * self.l1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def bias(self) -> float:
        return -self.bias_z / ((BETA + self.bias_n**0.5) / ALPHA + 1e-9)

    def update(self, f: np.ndarray, rows: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """One batch: features and the passage of each, labels and weights."""
        root = np.sqrt(np.maximum(np.bincount(rows, minlength=len(y)), 1))
        b = self.bias()
        m = np.bincount(rows, weights=self.weights(f), minlength=len(y)) / root + b
        g0 = (1 / (1 + np.exp(-np.clip(m, -30, 30))) - y) * weight
        idx, inverse = np.unique(f, return_inverse=True)
        g = (g0 / root)[rows]
        total, square = np.bincount(inverse, weights=g), np.bincount(inverse, weights=g * g)
        w, n = self.weights(idx), self.n[idx]
        self.z[idx] += total - (np.sqrt(n + square) - np.sqrt(n)) / ALPHA * w
        self.n[idx] = n + square
        gs, sq = float(g0.sum()), float((g0 * g0).sum())
        self.bias_z += gs - ((self.bias_n + sq) ** 0.5 - self.bias_n**0.5) / ALPHA * b
        self.bias_n += sq

    def sparse(self) -> tuple[np.ndarray, np.ndarray, float]:
        at = np.flatnonzero(np.abs(self.z) > self.l1)
        return at.astype(np.int32), self.weights(at).astype(np.float32), self.bias()


class Bags:
    """Passages of documents with their features, as flat arrays."""

    def __init__(self, texts: list[str]):
        f, rows, self.doc = Features().of(texts)
        order = np.argsort(rows, kind="stable")
        self.f, self.rows = f[order].astype(np.int64), rows[order]
        self.n = len(self.doc)
        self.at = np.searchsorted(self.rows, np.arange(self.n + 1))

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.at[which + 1] - self.at[which]
        idx = np.repeat(self.at[which] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        return self.f[idx], np.repeat(np.arange(len(which)), size)

    def suspicion(self, dirty: np.ndarray, clean: np.ndarray) -> np.ndarray:
        """A first guess at how bad passages are: the mean over their features
        of the log odds that a document with the feature is bad."""

        def documents_with(which: np.ndarray) -> np.ndarray:
            f, rows = self.take(which)
            return np.bincount(np.unique(f * (self.doc.max() + 1) + self.doc[which][rows]) // (self.doc.max() + 1), minlength=1 << BITS)

        b, c = documents_with(dirty), documents_with(clean)
        nb, nc = len(np.unique(self.doc[dirty])), max(1, len(np.unique(self.doc[clean])))
        odds = np.log((b + 0.05) / nb) - np.log((c + 0.05) / nc)
        odds[b + c < 2] = 0.0  # a feature of one document says nothing
        n = self.n
        return np.bincount(self.rows, weights=odds[self.f], minlength=n) / np.maximum(np.bincount(self.rows, minlength=n), 4)

    def scores(self, m: Ftrl) -> np.ndarray:
        n = self.n
        root = np.sqrt(np.maximum(np.bincount(self.rows, minlength=n), 1))
        return np.bincount(self.rows, weights=m.weights(self.f), minlength=n) / root + m.bias()


def train(bags: Bags, bad: np.ndarray, use: np.ndarray, rounds: int = ROUNDS, seed: int = 7) -> Ftrl:
    """A model from the documents `use` (mask). Of each bad document one
    passage is taken for bad, at first the one whose features set bad documents
    apart most, then the worst by the model so far, with others it finds bad."""
    rng = np.random.default_rng(seed)
    in_use = use[bags.doc]
    clean = np.flatnonzero(in_use & ~bad[bags.doc])
    dirty = np.flatnonzero(in_use & bad[bags.doc])
    model = None
    for _ in range(rounds):
        if len(dirty):
            s = bags.suspicion(dirty, clean) if model is None else bags.scores(model)
            order = dirty[np.lexsort((-s[dirty], bags.doc[dirty]))]
            first = np.concatenate([[True], bags.doc[order][1:] != bags.doc[order][:-1]]) if len(order) else np.zeros(0, bool)
            # the worst passage of each bad document, and others that are clearly bad
            pick = first | (s[order] > 0.5) if model is not None else first
            pos, weight = order[pick], np.where(first[pick], 1.0, 0.5)
        else:
            pos, weight = dirty, np.zeros(0)
        balance = max(1.0, len(clean) / (RATIO * max(len(pos), 1)))
        idx = np.concatenate([pos, clean])
        y = np.concatenate([np.ones(len(pos)), np.zeros(len(clean))])
        w = np.concatenate([weight * balance, np.ones(len(clean))])
        model = Ftrl()
        for _ in range(PASSES):
            perm = rng.permutation(len(idx))
            for k in range(0, len(perm), BATCH):
                j = perm[k : k + BATCH]
                model.update(*bags.take(idx[j]), y[j], w[j])
    return model


def document_scores(bags: Bags, model: Ftrl, n: int) -> np.ndarray:
    out = np.full(n, -30.0)
    np.maximum.at(out, bags.doc, bags.scores(model))
    return out


class Mean:
    """Several models as one: the mean of their weights."""

    def __init__(self, models: list[Ftrl]):
        self.models = models

    def weights(self, idx: np.ndarray) -> np.ndarray:
        return np.mean([m.weights(idx) for m in self.models], axis=0)

    def bias(self) -> float:
        return float(np.mean([m.bias() for m in self.models]))

    def sparse(self) -> tuple[np.ndarray, np.ndarray, float]:
        at = np.flatnonzero(np.any([np.abs(m.z) > m.l1 for m in self.models], axis=0))
        return at.astype(np.int32), self.weights(at).astype(np.float32), self.bias()


def best_cut(score: np.ndarray, bad: np.ndarray, weight: np.ndarray) -> float:
    """The highest cut-off between two scores at which the F1 of the weighted
    rows is within a hundredth of its best; 0 where nothing is bad."""
    order = np.argsort(-score, kind="stable")
    hit = np.cumsum((bad * weight)[order])
    if not len(order) or hit[-1] == 0:
        return 0.0
    f1 = 2 * hit / (np.cumsum(weight[order]) + hit[-1])
    k = int((f1 >= 0.99 * f1.max()).argmax())
    return float(score[order[k]] + score[order[min(k + 1, len(order) - 1)]]) / 2


def backing(bags: Bags, bad: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """For each document the most features of one passage that are in two bad
    texts or more and in hardly any clean one. `text_of` numbers the texts:
    copies are counted once."""
    n, of = int(text_of.max()) + 1, text_of[bags.doc[bags.rows]]

    def texts_with(which: np.ndarray) -> np.ndarray:
        return np.bincount(np.unique(bags.f[which] * n + of[which]) // n, minlength=1 << BITS)

    in_bad = bad[bags.doc[bags.rows]]
    b, c = texts_with(in_bad), texts_with(~in_bad)
    telling = (b >= 2) & (20 * c < b)
    out = np.zeros(len(bad))
    np.maximum.at(out, bags.doc, np.bincount(bags.rows, weights=telling[bags.f], minlength=bags.n))
    return out


def cross_fit(bags: Bags, bad: np.ndarray, use: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, list[Ftrl]]:
    """Scores of all documents, each by the model of the other folds; the models."""
    out, models = np.full(len(bad), -30.0), []
    for k in range(FOLDS):
        models.append(train(bags, bad, use & (fold != k)))
        out[fold == k] = document_scores(bags, models[-1], len(bad))[fold == k]
    return out, models


def learn(texts: list[str], bad: np.ndarray, sure: np.ndarray, weight: np.ndarray) -> tuple[Mean, float]:
    """(model, cut-off) from labelled texts. `sure` marks the labels that two
    reviewers agree on; `weight` is how many labelled documents each stands
    for. Copies of a text share a fold."""
    bags, digest = Bags(texts), np.array([xxhash.xxh64_intdigest(t) for t in texts], dtype=np.uint64)
    text_of = np.unique(digest, return_inverse=True)[1]
    use = ~bad | sure | (backing(bags, bad, text_of) >= BACKED)
    score, models = cross_fit(bags, bad, use, (digest % np.uint64(FOLDS)).astype(np.int64))
    return Mean(models), best_cut(score[use], bad[use], weight[use])


class Model:
    def __init__(self, at: np.ndarray, w: np.ndarray, bias: float, threshold: float):
        self.at, self.w, self.bias, self.threshold = at, w, bias, threshold

    def dense(self) -> np.ndarray:
        d = np.zeros(1 << BITS, dtype=np.float32)
        d[self.at] = self.w
        return d


def sample(documents: DataFrame, labels: DataFrame, most: int = MOST_LABELS, most_bytes: int = MOST_BYTES) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(texts, bad, sure, weight) of at most `most` labelled documents, up to
    half of them bad ones, in the order of a hash of the id as long as their
    texts hold no more than `most_bytes` together. Of several reviews the
    majority counts; a tie says nothing and is left out, as are labels of no
    document and null texts."""
    l = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.avg((F.col("label") != "clean").cast("double")).alias("share"), F.count("*").alias("n"))
    l = l.where("share <> 0.5").select("doc_id", (F.col("share") > 0.5).alias("bad"), ((F.col("n") > 1) & F.col("share").isin(0.0, 1.0)).alias("sure"))
    total = {r.bad: r["count"] for r in l.groupBy("bad").count().collect()}  # two rows
    order = F.xxhash64("doc_id")
    picked = l.where("bad").orderBy(order, "doc_id").limit(most // 2).unionByName(l.where("not bad").orderBy(order, "doc_id").limit(most - most // 2))
    # at most `most` rows, so one task can add their sizes up
    sized = documents.where("text is not null").select("doc_id", "text").join(picked, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("bad").alias("bad"), F.first("sure").alias("sure"))
    sized = sized.withColumn("so_far", F.sum(F.octet_length("text")).over(Window.orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, 0)))
    rows = sized.where(F.col("so_far") <= most_bytes).orderBy("doc_id").collect()
    bad = np.array([r.bad for r in rows], dtype=bool)
    stands = {k: total.get(k, 0) / max(1, int((bad == k).sum())) for k in (False, True)}
    return [r.text for r in rows], bad, np.array([r.sure for r in rows], dtype=bool), np.array([stands[bool(b)] for b in bad])


def fit(documents: DataFrame, labels: DataFrame, most: int = MOST_LABELS, most_bytes: int = MOST_BYTES) -> Model:
    """The model; without labels of both kinds, one that finds nothing."""
    texts, bad, sure, weight = sample(documents, labels, most, most_bytes)
    if not bad.any() or bad.all():
        return Model(np.zeros(0, np.int32), np.zeros(0, np.float32), -30.0, 0.0)
    model, cut_off = learn(texts, bad, sure, weight)
    at, w, bias = model.sparse()
    # the cut-off moves into the bias: a score of one half is the cut-off
    return Model(at, w, bias - cut_off, 0.0)


def scores(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, source, score, flagged) of each row: the probability of the
    worst passage, and whether it is above one half. Null texts and texts
    without a word score 0. Every text is read whole."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    cols = documents.select("doc_id", "source", "text")

    def run(batches):
        m, feats = shared.value, Features()
        dense = m.dense()
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                b = whole.slice(i, 512)
                f, rows, doc = feats.of(b.column(2).to_pylist())
                n = len(doc)
                best = np.full(b.num_rows, -np.inf)
                if n:
                    root = np.sqrt(np.maximum(np.bincount(rows, minlength=n), 1))
                    np.maximum.at(best, doc, np.bincount(rows, weights=dense[f], minlength=n) / root + m.bias)
                p = 1 / (1 + np.exp(-np.clip(best, -700, 700)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.where(np.isfinite(best), p, 0.0)), pa.array(best > m.threshold)], names=["doc_id", "source", "score", "flagged"])

    return over_all_cores(cols).mapInArrow(run, "doc_id bigint, source string, score double, flagged boolean")


def found(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id) of the documents with a passage that the model finds bad."""
    return scores(documents, fit(documents, labels)).where("flagged").select("doc_id").distinct()


def rates(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(source, n_docs, n_flagged, rate, mean_score) of each source; a null
    source has a row of its own."""
    s = scores(documents, fit(documents, labels))
    return s.groupBy("source").agg(F.count("*").alias("n_docs"), F.count_if("flagged").alias("n_flagged"), (F.count_if("flagged") / F.count("*")).alias("rate"), F.avg("score").alias("mean_score"))
