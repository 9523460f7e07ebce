"""Toxicity by maximum-scoring segments of token log-odds.

Learning (a bounded, documented sample of `SAMPLE` labelled rows):

* words, and their fronts of 4 and 6 bytes, are hashed into tables of
  document counts; a word's log-odds of toxic against clean has a Dirichlet
  prior around its front's, and a small drift is taken off, so ordinary
  text scores negative;
* the best segment of a clean text then follows an extreme-value law
  (Karlin-Altschul): its parameters are fitted on the out-of-fold best
  segments of clean rows;
* all significant segments of a text are aggregated by the law's sum
  statistics: the chance of r segments with their sum of normal scores,
  halved for each further one, and of all r the least likely counts.  A
  logistic curve on that significance is fitted to the labels, again out of
  fold.

Scoring walks every whole text once: prefix sums give the best segment of
every text at once; where it is significant, the linear scan of Ruzzo and
Tompa lists all disjoint maximal segments.  The pass is narrow; the model
is 2**BITS floats, whatever the corpus.

Defined results: a null, empty or wordless text has no segment and gets
the score of significance 0; without labels of both kinds every score is
0.0 and nothing is predicted; repeated label rows of one id count as their
maximum; of rows with one id, the fit sees one (picked by a hash of its
text), scoring each; equal texts have equal scores; other columns do not
matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laconic.llm.common import materialise
from laconic.llm.tokens import ALNUM, U64, Words, buffers, pieces

#: Most labelled rows that the model is fitted on (chosen by a hash of the id).
SAMPLE = 20_000
#: Levels of a token, from general to special: bytes of its front (None: the whole word) and bits of its table.
LEVELS = ((4, 16), (6, 17), (None, 18))
#: Weight of the Dirichlet prior that a level passes to the next one, in documents.
PRIOR = 10.0
#: Log-odds up to this are taken for chance, and what every word costs.
CHANCE, DRIFT = 1.5, 0.1
#: A segment counts as significant at this E-value or less.
E_VALUE = 0.01

OFFSET = np.cumsum([0, *(1 << bits for _, bits in LEVELS)])
SIZE = int(OFFSET[-1])


def features(w: Words) -> np.ndarray:
    """For each level, the table entry of each word."""
    return np.stack([(w.hashes(front) >> U64(64 - bits)).astype(np.int64) + at for (front, bits), at in zip(LEVELS, OFFSET, strict=False)])


def token_scores(entries: np.ndarray, counts: np.ndarray, base: float) -> np.ndarray:
    """Log-odds of each word, less the drift.

    counts[label, entry]: documents that hold it.  A word's share of toxic
    documents has a Dirichlet (here: two-way) prior around the share of its
    front, whose prior in turn is the shorter front's, and last the base
    rate; so unknown forms of a known stem count, and rare words do not.
    """
    share = np.full(entries.shape[1], base)
    for e in entries:
        share = (counts[1, e] + PRIOR * share) / (counts[0, e] + counts[1, e] + PRIOR)
    odds = np.log(share / (1 - share)) - np.log(base / (1 - base))
    return np.clip(np.sign(odds) * np.maximum(np.abs(odds) - CHANCE, 0), -1.0, 6.0) - DRIFT


def best_segments(scores: np.ndarray, doc_start: np.ndarray) -> np.ndarray:
    """Best segment score of each document: the largest rise of its prefix sums (0 if none is positive)."""
    out = np.zeros(len(doc_start) - 1)
    total = np.concatenate(([0.0], np.cumsum(scores, dtype=np.float64)))
    for d, (a, b) in enumerate(zip(doc_start[:-1], doc_start[1:], strict=True)):
        if b > a:
            c = total[a : b + 1]
            out[d] = max(0.0, float((c[1:] - np.minimum.accumulate(c[:-1])).max()))
    return out


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All disjoint maximal-scoring segments (first word, end, score), by one left-to-right scan.

    Each segment keeps a link to the last one before it that has a smaller
    total to its left, so the search for one to join never walks over a
    segment twice: the time is linear.
    """
    first: list[int] = []
    end: list[int] = []
    low: list[float] = []  # total before the segment
    high: list[float] = []  # total after it
    link: list[int] = []
    total = 0.0
    for i, x in enumerate(scores.tolist()):
        if x <= 0:
            total += x
            continue
        a, l, r = i, total, total + x
        total = r
        j = len(first) - 1
        while j >= 0 and low[j] >= l:
            j = link[j]
        while j >= 0 and high[j] < r:
            a, l = first[j], low[j]
            for v in (first, end, low, high):
                del v[j:]
            j, before = link[j], j
            del link[before:]
        first.append(a)
        end.append(i + 1)
        low.append(l)
        high.append(r)
        link.append(j)
    return [(a, b, r - l) for a, b, l, r in zip(first, end, low, high, strict=True)]


@dataclass
class Model:
    counts: np.ndarray  # [label, entry]
    base: float  # toxic share of all counts
    rate: float  # decay of the extreme-value law
    scale: float  # its constant: expected segments above 0 for each word
    slope: float
    offset: float

    def significance(self, score: np.ndarray, words: np.ndarray) -> np.ndarray:
        """-ln of the chance that a clean text of that many words holds such a segment."""
        e = self.scale * np.maximum(words, 1) * np.exp(-self.rate * np.maximum(score, 0))
        return np.where(score > 0, -np.log(np.maximum(-np.expm1(-e), 1e-300)), 0.0)

    def least(self, words: np.ndarray) -> np.ndarray:
        """The segment score at which the expected number of such segments falls to E_VALUE."""
        return np.log(self.scale * np.maximum(words, 1) / E_VALUE) / self.rate

    def aggregate(self, single: float, segments: list[float], words: int) -> float:
        """Significance of a text: that of its best segment, or of several by their sum, whichever is greater."""
        x = np.sort(self.rate * np.array(segments) - np.log(self.scale * max(words, 1)))[::-1]
        if len(x) < 2:
            return single
        r, t = np.arange(1, len(x) + 1), np.cumsum(x)
        faculty = np.concatenate(([0.0], np.cumsum(np.log(r))))  # ln n!
        # -ln of exp(-t) * t^(r - 1) / (r! (r - 1)!), and a factor of 2 for each further segment
        many = t - (r - 1) * np.log(t) + faculty[1:] + faculty[:-1] - (r - 1) * np.log(2)
        return max(single, float(many[1:].max()))

    def texts(self, s: np.ndarray, doc_start: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
        """(significance, significant segments) of each document of a run of word scores."""
        best, each = best_segments(s, doc_start), np.diff(doc_start)
        found, spans = self.significance(best, each), []
        for k, (a, b, x, t) in enumerate(zip(doc_start[:-1], doc_start[1:], best, self.least(each), strict=True)):
            spans.append([m for m in maximal_segments(s[a:b]) if m[2] >= t] if x >= t and x > 0 else [])
            found[k] = self.aggregate(found[k], [v for _, _, v in spans[-1]], int(b - a))
        return found, spans

    def probability(self, significance: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.sqrt(significance) + self.offset, -50, 50)))


def _evidence(best: np.ndarray, words: np.ndarray, clean: np.ndarray) -> tuple[float, float]:
    """Rate and scale of the extreme-value law of clean texts (moments of the Gumbel law, after removing ln n)."""
    x, n = best[clean], np.maximum(words[clean], 1)
    spread = float(np.std(x)) if len(x) > 1 else 0.0
    rate = np.pi / (np.sqrt(6) * max(spread, 0.25))
    return rate, float(np.exp(np.mean(rate * x - np.log(n)) - 0.5772156649)) if len(x) else 1.0


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps with a light ridge."""
    a, w = np.column_stack((x, np.ones_like(x))), np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (y - p) - 1e-3 * w
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def _sample(docs: DataFrame, labels: DataFrame, doc_id: str, label: str, sample: int) -> DataFrame:
    """(text, y, fold): at most about `sample` labelled ids, one row for each; the label side is bounded, so it is broadcast."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("int").alias("_y"))
    count = known.count()
    key = F.pmod(F.xxhash64("_id", F.lit(17)), F.lit(1 << 30))
    known = known.where(key < int((1 << 30) * min(1.0, sample / max(1, count)))).withColumn("_fold", F.pmod(F.xxhash64("_id", F.lit(23)), F.lit(2)).cast("int"))
    rows = docs.join(F.broadcast(known), docs[doc_id] == known["_id"])
    # rows of one id are one before they are shuffled
    one = rows.groupBy("_id", "_y", "_fold").agg(F.min(F.struct(F.xxhash64("_text"), "_text")).alias("t"))
    return one.select(F.col("t._text").alias("_text"), "_y", "_fold")


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on labelled rows; pass only the labels that may be learned from.

    The documents are read once: the sample is written and read back.
    """
    rows = materialise(_sample(docs.select(F.col(doc_id), F.col(text).alias("_text")), labels.select(doc_id, label), doc_id, label, sample), "sample")

    def count(batches):
        counts = np.zeros((2, 2, SIZE), np.int64)
        sizes = np.zeros((2, 2), np.int64)
        for batch in batches:
            y, fold = (np.array(batch.column(i).to_pylist(), np.int64) > 0 for i in (1, 2))
            np.add.at(sizes, (fold.astype(int), y.astype(int)), 1)
            for first, last, d, o in pieces(*buffers(batch.column(0))):
                w = Words(d, o, ALNUM)
                doc = np.repeat(np.arange(last - first), np.diff(w.doc_start))
                kind = fold[first:last] * 2 + y[first:last]
                for e in features(w):
                    once = np.unique(doc * SIZE + e)
                    np.add.at(counts.reshape(-1), kind[once // SIZE] * SIZE + once % SIZE, 1)
        for f in range(2):
            used = np.flatnonzero(counts[f].any(0))
            for at in range(0, len(used), 50_000):
                u = used[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), f)), pa.array(u), pa.array(counts[f, 0, u]), pa.array(counts[f, 1, u])], names=["fold", "entry", "clean", "toxic"])
            if sizes[f].any():
                yield pa.RecordBatch.from_arrays([pa.array([f]), pa.array([-1]), pa.array(sizes[f, :1]), pa.array(sizes[f, 1:])], names=["fold", "entry", "clean", "toxic"])

    table = rows.mapInArrow(count, "fold long, entry long, clean long, toxic long").groupBy("fold", "entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts, sizes = np.zeros((2, 2, SIZE), np.float32), np.zeros((2, 2))
    fold, entry, clean, toxic = (c.to_numpy() for c in table.toArrow().columns)  # at most 2 * (SIZE + 1) rows of numbers, whatever the corpus
    real = entry >= 0
    counts[fold[real], 0, entry[real]], counts[fold[real], 1, entry[real]] = clean[real], toxic[real]
    sizes[fold[~real], 0], sizes[fold[~real], 1] = clean[~real], toxic[~real]
    if not sizes.sum(0).all() or not counts[:, 1].any() or not counts[:, 0].any():
        return Model(np.zeros((2, SIZE), np.float32), 0.5, 1.0, 1.0, 0.0, -50.0)
    base = float(counts[:, 1].sum(dtype=float) / counts.sum(dtype=float))  # weighs documents by their words, as the tables do
    held = docs.sparkSession.sparkContext.broadcast(counts)

    def measure(law: Model | None):
        """(value, words, y) of each row of the sample: its best segment, or with the law fitted its significance."""

        def run(batches):
            for batch in batches:
                y, fold = (np.array(batch.column(i).to_pylist(), np.int64) > 0 for i in (1, 2))
                value, words = [], []
                for first, last, d, o in pieces(*buffers(batch.column(0))):
                    w = Words(d, o, ALNUM)
                    each, e = np.diff(w.doc_start), features(w)
                    of = np.repeat(fold[first:last], each)
                    # each fold is scored by what the other one has taught
                    s = np.where(of, token_scores(e, held.value[0], base), token_scores(e, held.value[1], base))
                    value.append(best_segments(s, w.doc_start) if law is None else law.texts(s, w.doc_start)[0])
                    words.append(each)
                if value:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(value)), pa.array(np.concatenate(words).astype(np.int64)), pa.array(y.astype(np.int64))], names=["value", "words", "y"])

        found = rows.mapInArrow(run, "value double, words long, y long").toArrow()  # at most about `sample` rows of numbers
        value, words, y = (c.to_numpy().astype(float) for c in found.columns)
        order = np.lexsort((y, words, value))  # reruns agree
        return value[order], words[order], y[order]

    best, words, y = measure(None)
    rate, scale = _evidence(best, words, y == 0)
    nothing = np.zeros((2, 0), np.float32)
    found, _, y = measure(Model(nothing, base, rate, scale, 1.0, 0.0))
    return Model(counts.sum(0), base, rate, scale, *_logistic(np.sqrt(found), y))


def toxicity(docs: DataFrame, model: Model, text: str = "text", passages: bool = False) -> DataFrame:
    """docs with score, predicted and n_passages (significant passages); with passages=True also their word spans and scores.

    Columns of docs with these names are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    added = {"score": "double", "predicted": "int", "n_passages": "long"} | ({"passages": "array<struct<first:long,end:long,score:double>>"} if passages else {})
    docs = docs.select(*[c for c in docs.columns if c not in added])
    names = docs.columns

    def run(batches):
        m = held.value
        for batch in batches:
            score, spans = [], []
            for _, _, d, o in pieces(*buffers(batch.column(names.index(text)))):
                w = Words(d, o, ALNUM)
                s = token_scores(features(w), m.counts, m.base)
                found, its = m.texts(s, w.doc_start)
                score.append(m.probability(found))
                spans += its
            score = np.concatenate(score) if score else np.zeros(0)
            columns = [pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32), pa.int32()), pa.array([len(x) for x in spans], pa.int64())]
            if passages:
                columns.append(pa.array([[{"first": f, "end": e, "score": v} for f, e, v in x] for x in spans], pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))))
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*names, *added])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), *(f"{k} {v}" for k, v in added.items())])
    return docs.mapInArrow(run, schema)
