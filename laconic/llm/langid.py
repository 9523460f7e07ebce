"""Language identification: multinomial naive Bayes over hashed character n-grams.

Learning counts the hashed 1- to 4-grams of a bounded, documented sample of
labelled texts (`PER_LANGUAGE` for each language, chosen by a hash of id and
text); partial counts are summed before they are shuffled, and the finished
matrix has languages * 2**BITS floats, whatever the corpus.  At most
`MAX_LANGUAGES` values are accepted, so its broadcast is bounded.

Scoring is one narrow pass over whole texts: a batch becomes one array of
code points, its n-gram hashes index the matrix, and each document's sparse
counts are summed with the log-probabilities of each language.

Defined results: `und` and score 0.0 for a null text, a text without a
letter, or when nothing could be learned; ties go to the first language in
code-point order; rows with equal ids are scored on their own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most training texts of one language.
PER_LANGUAGE = 4_000
MAX_LANGUAGES = 512
BITS = 16
ORDERS = (1, 2, 3, 4)
SMOOTHING = 0.5
#: Code points that are hashed at a time.
CHUNK = 1 << 20
#: n-grams of one text that count as independent evidence for the score.
INDEPENDENT = 60

_MULTIPLIER = np.uint32(0x9E3779B1)


@dataclass
class Model:
    languages: list[str]
    logs: np.ndarray  # [languages, 2**BITS]
    prior: np.ndarray


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts, each text framed by blanks, and the offsets of the texts."""
    framed = [f" {' '.join(t.lower().split())} " for t in texts]
    raw = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), np.uint32)
    return raw, np.concatenate(([0], np.cumsum([len(t) for t in framed], dtype=np.int64)))


def hashed(points: np.ndarray) -> list[np.ndarray]:
    """For each order, the bucket of the n-gram that begins at each position (the last n - 1 are missing)."""
    out = []
    acc = np.zeros(len(points), np.uint32)
    for n in ORDERS:
        count = len(points) - n + 1
        if count <= 0:
            break
        acc = (acc[:count] ^ points[n - 1 :]) * _MULTIPLIER
        acc ^= acc >> np.uint32(15)
        out.append(((acc * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS)).astype(np.int64))
    return out


def _runs(texts: list[str]):
    """Consecutive texts of about CHUNK characters; a longer text is a run by itself."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > CHUNK:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def _owners(offsets: np.ndarray, n: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(document of each n-gram start, whether the n-gram stays within it)."""
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:count]
    return of, np.arange(count) + n <= offsets[of + 1]


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Fit on docs; pass only the rows that may be learned from (null languages are left out)."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(lang).count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, 1 << BITS), np.float32), np.zeros(0))
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(int((1 << 30) * min(1.0, per_language / sizes[k]))))])
    # by id and text, so that one repeated id isn't taken as a whole or not at all
    rows = known.where(F.pmod(F.xxhash64(F.col(doc_id), F.col(text), F.lit(11)), F.lit(1 << 30)) < share[F.col(lang)])
    index = {k: i for i, k in enumerate(languages)}

    def count(batches):
        counts = np.zeros((len(index), 1 << BITS), np.int64)
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), [index[x] for x in batch.column(1).to_pylist()]
            for a, b in _runs(texts):
                points, offsets = code_points(texts[a:b])
                label = np.array(langs[a:b], np.int64)
                for n, h in zip(ORDERS, hashed(points), strict=False):
                    of, inside = _owners(offsets, n, len(h))
                    counts += np.bincount((label[of] * (1 << BITS) + h)[inside], minlength=counts.size).reshape(counts.shape)
        for i in range(len(index)):
            used = np.flatnonzero(counts[i])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), i)), pa.array(used), pa.array(counts[i, used])], names=["l", "bucket", "n"])

    counts = np.full((len(languages), 1 << BITS), SMOOTHING)
    found = rows.select(text, lang).mapInArrow(count, "l long, bucket long, n long").groupBy("l", "bucket").agg(F.sum("n").alias("n")).toArrow()
    label, bucket, n = (c.to_numpy() for c in found.columns)  # at most languages * 2**BITS rows of numbers
    counts[label, bucket] += n
    logs = np.log(counts / counts.sum(1, keepdims=True))
    total = np.array([sizes[k] for k in languages], float)
    return Model(languages, logs.astype(np.float32), np.log(total / total.sum()))


def evidence(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(log-likelihood of each text under each language, its number of n-grams)."""
    out, grams = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts), np.int64)
    for a, b in _runs(texts):
        points, offsets = code_points(texts[a:b])
        for n, h in zip(ORDERS, hashed(points), strict=False):
            of, inside = _owners(offsets, n, len(h))
            # a gram that leaves its text is counted out: each text is framed, so only its last n - 1 starts leave
            for k in range(len(model.languages)):
                v = model.logs[k][h] * inside
                out[a:b, k] += np.add.reduceat(v, offsets[:-1], dtype=np.float64) if len(v) == len(points) else np.bincount(of, v, b - a)
            grams[a:b] += np.bincount(of[inside], minlength=b - a)
    return out, grams


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred and score (0 to 1: the probability of lang_pred, with a text's evidence scaled to INDEPENDENT n-grams at most)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select(*[c for c in docs.columns if c not in ("lang_pred", "score")])
    names = [*docs.columns, "_letters"]
    marked = docs.withColumn("_letters", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))

    def run(batches):
        m = held.value
        names_of = np.array([*m.languages, "und"], object)
        for batch in batches:
            texts, letters = batch.column(names.index(text)).to_pylist(), np.array(batch.column(len(names) - 1).to_pylist(), bool)
            if not m.languages:
                letters[:] = False
            best, score = np.full(len(texts), len(m.languages)), np.zeros(len(texts))
            if letters.any():
                logs, grams = evidence([t for t, x in zip(texts, letters, strict=True) if x], m)
                scaled = logs * np.minimum(1, INDEPENDENT / np.maximum(grams, 1))[:, None] + m.prior
                best[letters] = (logs + m.prior).argmax(1)
                p = np.exp(scaled - scaled.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                score[letters] = p[np.arange(len(p)), best[letters]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names_of[best].tolist(), pa.string()), pa.array(score)], names=[*names[:-1], "lang_pred", "score"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "lang_pred string", "score double"])
    return marked.mapInArrow(run, schema)
