"""Toxicity: a subsequence string kernel with Nyström landmarks and a linear SVM (operator 10).

The kernel of two words counts their common subsequences of three and four characters, gaps
allowed, each weighted by decay ** span; words carry marks at both ends, so a common start or
end counts as well. Inserted or changed characters cost weight, not the match. The kernel is
divided by a norm of each word.

Training (numpy, on a bounded sample of labelled documents): landmark words give the Nyström
map of the kernel; a squared-hinge SVM is fitted on words by multiple-instance rounds over
labelled sentences. A sentence takes its document's label; words of clean sentences are
negative, and of a toxic document only the words that the last round scored as insults stay
positive. Every fourth document is kept out of this; on these a logistic fit turns a document's
largest word margins and the density of positive ones into a probability.

Scoring: a Nyström SVM is linear in the subsequences of its landmarks, so the fitted machine
folds into one table from hashed subsequences to weights of fixed size, and a word costs a
lookup for each of its subsequences, whatever the number of landmarks. Each task scores a
word once and keeps it in a bounded cache.

Defined cases: a null text scores as the empty text, which has the lowest margins; very long
words count with all their characters; labels that are null or whose document is missing are
left out; a document labelled twice is toxic if one label says so; without both classes in
the sample every score is the share of toxic labels (0 where there is none). Repeated rows
are scored each; an empty table gives no rows. Extra columns are kept by :func:`reject_toxic`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estima.llm.common import crc32_text, least_hashes, release

ORDERS = (3, 4)
SPAN = 6
DECAY = 0.7
LANDMARKS = 288
TABLE_BITS = 20
#: Documents of each class in the fitted sample, and the bytes up to which a text can be in it.
SAMPLE_DOCS = 2000
SAMPLE_BYTES = 24_000
#: Words of each class in a fit.
FIT_WORDS = 10_000
#: Insults that are also learned with one character put in or replaced.
DISGUISED = 150
#: Share of toxic documents that probabilities are fitted for.
TOXIC_SHARE = 0.15
#: Margin below which even the best word of a toxic document is no witness.
WITNESS = -0.5
#: Characters whose words a task holds at a time.
SLICE = 1_000_000
#: Words in a task's cache.
CACHE_WORDS = 200_000
FLOOR = -3.0

_SENTENCE = re.compile(r"(?<=[.!?\n])\s+|\n+")
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "¡¿«»“”‘’…–—"
_OFFSETS = [(0, *rest) for n in ORDERS for rest in combinations(range(1, SPAN), n - 1)]


# ---- words ---------------------------------------------------------------------------

def words_of(text: str) -> set[str]:
    """Distinct words of a text in lower case, without marks at their edges; runs of three or
    more single characters, and the letters of a word with other characters, are one more word."""
    tokens = text.lower().split()
    found = {t.strip(_EDGES) for t in set(tokens)}
    found |= {"".join(c for c in t if c.isalpha()) for t in found if not t.isalpha()}
    singles = [i for i, t in enumerate(tokens) if len(t) == 1]
    if len(singles) > 2:
        run = [singles[0]]
        for i in [*singles[1:], -1]:
            if i == run[-1] + 1:
                run.append(i)
                continue
            if len(run) > 2:
                found.add("".join(tokens[k] for k in run))
            run = [i]
    found.discard("")
    return found


def sentences_of(text: str) -> list[set[str]]:
    return [w for s in _SENTENCE.split(text) if (w := words_of(s))]


# ---- the kernel's features -----------------------------------------------------------

def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def subsequences(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each pattern of gaps: index of the word, hash of the characters, weight."""
    marked = ["\x02" + w + "\x03" for w in words]
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
    room = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))  # characters left in the word
    for offsets in _OFFSETS:
        at = np.flatnonzero(room > offsets[-1])
        h = codes[at] + np.uint64(len(offsets))
        for k, o in enumerate(offsets[1:], 1):
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + codes[at + o] + np.uint64(k))
        yield owner[at], h, DECAY ** (offsets[-1] + 1)


def _norms(words: list[str]) -> np.ndarray:
    """Square root of the summed squared weights of a word's subsequences, 1 at least."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    total = sum(DECAY ** (2 * (o[-1] + 1)) * np.maximum(0, lengths - o[-1]) for o in _OFFSETS)
    return np.sqrt(np.maximum(total, 1e-6))


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel of each word with each landmark."""
    lw, lh, lv = [], [], []
    for w, h, v in subsequences(landmarks):
        lw.append(w), lh.append(h), lv.append(np.full(len(h), v))
    lw, lh, lv = np.concatenate(lw), np.concatenate(lh), np.concatenate(lv)
    order = np.argsort(lh, kind="stable")
    lw, lh, lv = lw[order], lh[order], lv[order]
    if len(words) > 4000:  # a bounded table of products at a time
        return np.concatenate([kernel(words[a:a + 4000], landmarks) for a in range(0, len(words), 4000)])
    m, out = len(landmarks), np.zeros(len(words) * len(landmarks))
    for w, h, v in subsequences(words):
        lo, n = np.searchsorted(lh, h), np.searchsorted(lh, h, side="right")
        n -= lo
        hit = np.flatnonzero(n)
        n, lo = n[hit], lo[hit]
        j = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        out += np.bincount(np.repeat(w[hit].astype(np.int64), n) * m + lw[j], weights=v * lv[j], minlength=len(out))
    return (out.reshape(len(words), m) / _norms(words)[:, None] / _norms(landmarks)[None, :]).astype(np.float32)


# ---- training ------------------------------------------------------------------------

def squared_hinge(z: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 4.0, rounds: int = 30) -> np.ndarray:
    """Weights and bias (last) of a linear squared-hinge SVM by Newton's method."""
    x = np.hstack([z, np.ones((len(z), 1), z.dtype)])
    keep = np.eye(x.shape[1])
    keep[-1, -1] = 1e-3
    w = np.zeros(x.shape[1])
    active = np.ones(len(y), bool)
    for _ in range(rounds):
        h, g = keep.copy(), np.zeros(x.shape[1])
        for a in range(0, len(x), 4096):  # in double precision, a bounded number of rows at a time
            i = np.flatnonzero(active[a:a + 4096]) + a
            xa, ca = x[i].astype(float), c * weight[i]
            h += (xa * ca[:, None]).T @ xa
            g += xa.T @ (ca * y[i])
        w = np.linalg.solve(h, g)
        now = y * (x @ w) < 1
        if (now == active).all():
            break
        active = now
    return w


def summary(margins: np.ndarray) -> np.ndarray:
    """What a document's word margins say: the largest, the mean of the three largest, and the mean
    of their positive parts (how dense insults are). Without words: the floor."""
    if not len(margins):
        return np.array([FLOOR, FLOOR, 0.0])
    m = np.clip(margins, FLOOR, -FLOOR)
    top = np.sort(m)[-3:] if len(m) <= 8 else np.partition(m, len(m) - 3)[-3:]
    return np.array([m.max(), np.append(top, np.full(3 - len(top), FLOOR / 3)).mean(), 10 * np.maximum(m, 0).sum() / (len(m) + 5)])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weights and intercept (last) of a logistic fit to softened targets. Toxic documents have the
    weight TOXIC_SHARE in all, whatever their share of the sample."""
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(y > 0, TOXIC_SHARE / max(n1, 1), (1 - TOXIC_SHARE) / max(n0, 1)) * len(y)
    a = np.hstack([x, np.ones((len(x), 1))])
    keep = ridge * np.eye(a.shape[1])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + keep, a.T @ (weight * (p - t)) + keep @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Machine:
    """A fitted machine: a table of subsequence weights, a bias and the logistic's weights."""

    def __init__(self, table: np.ndarray, bias: float, weights: np.ndarray | None = None, constant: float | None = None):
        self.table, self.bias, self.weights, self.constant = table, bias, weights, constant

    def margins(self, words: list[str]) -> np.ndarray:
        """Margin of each word."""
        out = np.zeros(len(words))
        for a in range(0, len(words), 50_000):
            part = words[a:a + 50_000]
            total = np.zeros(len(part))
            for w, h, v in subsequences(part):
                total += v * np.bincount(w, weights=self.table[h >> np.uint64(64 - TABLE_BITS)], minlength=len(part))
            out[a:a + 50_000] = total / _norms(part)
        return out + self.bias

    def probability(self, summaries: np.ndarray) -> np.ndarray:
        """Probability of each document, from its summary."""
        if self.constant is not None:
            return np.full(len(summaries), self.constant)
        return 1 / (1 + np.exp(-np.clip(summaries @ self.weights[:-1] + self.weights[-1], -500, 500)))


def _table(landmarks: list[str], alpha: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << TABLE_BITS)
    scaled = alpha / _norms(landmarks)
    for w, h, v in subsequences(landmarks):
        out += np.bincount(h >> np.uint64(64 - TABLE_BITS), weights=v * scaled[w], minlength=len(out))
    return out.astype(np.float32)


def _by_hash(words: list[str]) -> list[str]:
    """In an order that has nothing to do with the words, the same on every run."""
    import zlib
    return sorted(words, key=lambda w: (zlib.crc32(w.encode("utf-8", "surrogatepass")), w))


def disguised(word: str) -> list[str]:
    """Spellings with one character that is no letter put in or in the place of another."""
    marks = "*.-_0135"
    out = []
    for i in range(1, len(word)):
        c = marks[(i + len(word)) % len(marks)]
        out.append(word[:i] + c + word[i:])
        if i < len(word) - 1:
            out.append(word[:i] + c + word[i + 1:])
    return out


def fit(texts: list[str], labels: list[int], landmarks: int = LANDMARKS, rounds: int = 3) -> Machine:
    """Fit on labelled documents (see the module's text)."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return Machine(np.zeros(1 << TABLE_BITS, np.float32), FLOOR, constant=float(y.mean()) if len(y) else 0.0)
    # documents as sentences of word numbers: each word is kept once, whatever the sample's size
    number: dict[str, int] = {}
    every = [[np.fromiter((number.setdefault(w, len(number)) for w in sorted(s)), np.int32, len(s)) for s in sentences_of(t)] for t in texts]
    vocabulary = list(number)
    # every fourth document only calibrates: its words are new to the machine
    fold = np.arange(len(texts)) % 4 == 3
    if any(len(set(y[f])) < 2 for f in (fold, ~fold)):
        fold = np.zeros(len(texts), bool)
    bags, labels = [b for b, f in zip(every, fold, strict=True) if not f], y[~fold].astype(int).tolist()
    whole = lambda b: np.unique(np.concatenate(b)) if b else np.zeros(0, np.int32)
    toxic = [whole(b) for b, v in zip(bags, labels, strict=True) if v]
    clean = [whole(b) for b, v in zip(bags, labels, strict=True) if not v]
    n1, n0 = max(1, len(toxic)), max(1, len(clean))
    df1, df0 = ({vocabulary[i]: int(c) for i, c in zip(*np.unique(np.concatenate([np.zeros(0, np.int32), *d]), return_counts=True), strict=True)}
                for d in (toxic, clean))
    only = [w for w in _by_hash(list(df1)) if w not in df0]
    # words that many toxic documents and no clean one hold come first, ties by hash
    only.sort(key=lambda w: -df1[w])
    positives = only[:FIT_WORDS]
    common = sorted(_by_hash(list(df0)), key=lambda w: -df0[w])
    negatives = list(dict.fromkeys(common[: FIT_WORDS // 4] + _by_hash(list(df0))[:FIT_WORDS]))[:FIT_WORDS]
    half = landmarks // 2
    marks = list(dict.fromkeys(positives[:half] + negatives[: half // 2] + _by_hash(negatives)[: landmarks - half]))[:landmarks]
    values, vectors = np.linalg.eigh(kernel(marks, marks).astype(float))
    use = values > 1e-6 * values.max()
    whiten = (vectors[:, use] / np.sqrt(values[use])).astype(np.float32)
    every1, every0 = list(df1), list(df0)
    machine, spelt = None, {}
    for _ in range(rounds):
        words = positives + negatives
        t = np.array([1.0] * len(positives) + [-1.0] * len(negatives))
        # a word weighs as the share of documents that hold it, each class half in all
        weight = np.array([(df1.get(w) or spelt.get(w, 0)) / n1 for w in positives] + [1 / max(1, len(negatives))] * len(negatives))
        weight[t > 0] /= max(weight[t > 0].sum(), 1e-9)
        weight[t < 0] /= max(weight[t < 0].sum(), 1e-9)
        z = kernel(words, marks) @ whiten
        w = squared_hinge(z, t, weight * len(words) / 2)
        machine = Machine(_table(marks, whiten @ w[:-1]), float(w[-1]))
        score1 = np.full(len(vocabulary), -np.inf)
        score1[[number[w] for w in every1]] = machine.margins(every1)
        score0 = machine.margins(every0)
        # witnesses: in each toxic sentence the words that score as insults, in a document the best one at least
        limit = max(0.0, float(np.quantile(score0, 0.999))) if len(score0) else 0.0
        chosen: set[str] = set()
        for d in toxic:
            if len(d):
                best = int(d[np.argmax(score1[d])])
                chosen.update(w for i in {best}.union(d[score1[d] > limit].tolist()) if (w := vocabulary[i]) not in df0)
        positives = sorted(chosen, key=lambda x: (-df1.get(x, 0), x))[:FIT_WORDS]
        # the most frequent insults also in disguise, so that a gap costs less than a clean word's likeness
        spelt = {v: df1.get(x, 0) / len(vs) for x in positives[:DISGUISED] for vs in [disguised(x)] for v in vs if v not in df0}
        positives = list(dict.fromkeys([*positives, *spelt]))
        hard = [every0[i] for i in np.argsort(-score0, kind="stable")[: FIT_WORDS // 2]]
        negatives = list(dict.fromkeys(hard + negatives))[:FIT_WORDS]
        if not positives:
            break
    use = fold if fold.any() else ~fold
    of = machine.margins(vocabulary)
    rows = np.stack([summary(of[whole(b)]) for b, f in zip(every, use, strict=True) if f])
    machine.weights = logistic(rows, y[use])
    return machine


# ---- on Spark ------------------------------------------------------------------------

def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int,
                    per_class: int = SAMPLE_DOCS, most_bytes: int = SAMPLE_BYTES) -> list[tuple[str, int]]:
    """Texts and labels of at most ``per_class`` documents of each class, chosen by a hash of the
    id; ids whose crc32 mod ``modulus`` is ``held`` are not used."""
    known = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
             .where(crc32_text(F.col("doc_id")) % modulus != held)
             .groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("__label")))
    # a document that is too long or missing takes no place in the sample
    usable = docs.where(F.octet_length("text") <= most_bytes).select(F.col("doc_id").alias("__id")).distinct()
    known = known.join(usable, F.col("doc_id") == F.col("__id"), "left_semi")
    picked = []
    for v in (0, 1):
        rows = least_hashes(known.where(F.col("__label") == v), per_class, "doc_id").collect()
        picked += [(r["doc_id"], r["__label"]) for r in rows]
    if not picked:
        return []
    ids = docs.sparkSession.createDataFrame(picked, known.select("doc_id", "__label").schema)  # bounded by 2 * per_class
    texts = (docs.where(F.octet_length("text") <= most_bytes).select("doc_id", "text")
             .join(F.broadcast(ids), "doc_id").groupBy("doc_id", "__label").agg(F.min("text").alias("text")).collect())
    return [(r["text"], r["__label"]) for r in sorted(texts, key=lambda r: r["doc_id"])]


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 5, held: int = 0,
          per_class: int = SAMPLE_DOCS) -> Machine:
    sample = labelled_sample(docs, labels, label, modulus, held, per_class)
    machine = fit([t for t, _ in sample], [v for _, v in sample])
    del sample
    release()  # the driver goes on for long with little else to collect
    return machine


def _slices(texts: list[str | None]) -> Iterator[list[str | None]]:
    """``texts`` in runs of about SLICE characters: words are held for one run at a time."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= SLICE or i + 1 == len(texts):
            yield texts[first:i + 1]
            first, size = i + 1, 0


def scores(machine: Machine):
    """Pandas UDF: probability that a text is toxic."""
    state = machine.__dict__

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Machine(**state)
        cache: dict[str, float] = {}
        for batch in batches:
            out = [np.zeros(0)]
            for texts in _slices(batch.tolist()):
                bags = [words_of(t) if t else set() for t in texts]
                words = set().union(*bags)
                if len(cache) + len(words) > CACHE_WORDS:
                    cache.clear()
                fresh = [w for w in words if w not in cache]
                if fresh:
                    cache.update(zip(fresh, own.margins(fresh).tolist(), strict=True))
                out.append(own.probability(np.stack([summary(np.fromiter(map(cache.__getitem__, b), float, len(b))) for b in bags])))
            yield pd.Series(np.concatenate(out))
        cache.clear()
        release()

    return score


def score_documents(docs: DataFrame, machine: Machine, name: str = "score") -> DataFrame:
    """``docs`` with the probability of being toxic in ``name``."""
    return docs.withColumn(name, scores(machine)(F.col("text")))


def reject_toxic(docs: DataFrame, machine: Machine, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with their own columns."""
    return docs.where(scores(machine)(F.col("text")) < threshold)
