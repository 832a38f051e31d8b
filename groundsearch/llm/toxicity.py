"""Toxicity by multiple-instance learning: sentence scores, joined by noisy-or, are trained from document labels."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundsearch.llm.common import arrow_batches, documents
from groundsearch.llm.language import remainder

#: Labelled rows that a model is fitted on; features that it may hold; how clearly a feature must go with a label to be used.
ROWS, FEATURES, CLEAR = 6000, 4000, 3.4
#: Words whose weights a worker remembers.
CACHE = 200_000
#: Documents with at least this score are predicted toxic.
THRESHOLD = 0.3
WORD = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"[^.!?\n]+")


def sentences(text: str) -> list[tuple[int, int]]:
    """Start and end of each sentence: runs without . ! ? or a line break that have a word."""
    return [m.span() for m in SENTENCE.finditer(text) if WORD.search(text, *m.span())]


def features(word: str) -> list[str]:
    """The features of a word: itself, and its beginnings of 3 to 5 characters, which inflected forms share."""
    return [word, *(word[:k] + "~" for k in (3, 4, 5) if len(word) > k)]


class Model:
    """A weight for each feature and a bias; a sentence's probability is the logistic of their sum over its distinct words."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias, self.known = weights, bias, {}
        self.rest = float(np.logaddexp(0, bias))  # -log(1 - p) of a sentence without any weighed word

    def word(self, word: str) -> float:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            found = self.known[word] = sum(self.weights.get(f, 0.0) for f in features(word))
        return found

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's probability, 1 - prod(1 - p) over its sentences (0 for none), and (start, end, p) of sentences that reach THRESHOLD."""
        low, total, found, word = (text or "").lower(), 0.0, [], self.word
        if len(low) != len(text or ""):  # offsets are those of the text itself
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        for m in SENTENCE.finditer(low):
            words = set(WORD.findall(m[0]))
            if not words:
                continue
            hits = [x for x in map(word, words) if x]
            if not hits:
                total += self.rest
                continue
            z = self.bias + sum(sorted(hits))
            total += float(np.logaddexp(0, z))
            if z >= np.log(THRESHOLD / (1 - THRESHOLD)):
                found.append((*m.span(), float(1 / (1 + np.exp(-z)))))
        return float(-np.expm1(-total)), found


def select(data: list[tuple[list[list[str]], int]], most: int = FEATURES, clear: float = CLEAR) -> dict[str, int]:
    """Numbers of the features that go with a label clearly: documents that have one, against what the labels' shares let expect.

    The difference must be `clear` standard deviations; rare features that memorise single documents stay out.
    """
    count = (Counter(), Counter())
    for doc, label in data:
        count[label].update({f for w in {w for s in doc for w in s} for f in features(w)})
    share = sum(y for _, y in data) / max(1, len(data))
    clarity = {}
    for f in count[1].keys() | count[0].keys():
        n = count[0][f] + count[1][f]
        z = abs(count[1][f] - n * share) / np.sqrt(n * share * (1 - share) + 1)
        if n >= 3 and z >= clear:
            clarity[f] = z
    return {f: i for i, f in enumerate(sorted(clarity, key=lambda f: (-clarity[f], f))[:most])}


def fit(data: list[tuple[list[list[str]], int]], rounds: int = 200, rate: float = 0.1, l2: float = 1e-4) -> Model:
    """A model from (sentences as lists of distinct words, label 0 or 1), by gradient descent on the likelihood of the noisy-or.

    With P = 1 - prod(1 - p), the gradient at a sentence's logit is p for label 0 and -p (1 - P) / P for label 1: a toxic document blames
    the sentences that look worst.
    """
    vocab = select(data)
    tok, sent, owner, k = [], [], [], 0
    for d, (doc, _) in enumerate(data):
        for s in doc:
            ids = [vocab[f] for w in s for f in features(w) if f in vocab]
            tok += ids
            sent += [k] * len(ids)
            owner.append(d)
            k += 1
    tok, sent, owner = np.array(tok, np.int64), np.array(sent, np.int64), np.array(owner, np.int64)
    y = np.array([label for _, label in data], float)
    n = max(1, len(y))
    w, b = np.zeros(len(vocab)), -5.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.clip(b + np.bincount(sent, w[tok], minlength=k), -30, 30)
        p = 1 / (1 + np.exp(-z))
        clean = np.exp(-np.bincount(owner, np.logaddexp(0, z), minlength=len(y)))
        factor = np.where(y > 0, -clean / np.maximum(1 - clean, 1e-9), 1.0)
        g = p * factor[owner] / n
        gw, gb = np.bincount(tok, g[sent], minlength=len(w)) + l2 * w, g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        step, root = rate / (1 - 0.9**t), 1 - 0.999**t
        w -= step * m / (np.sqrt(v / root) + 1e-8)
        b -= step * mb / (np.sqrt(vb / root) + 1e-8)
    return Model({f: float(w[i]) for f, i in vocab.items()}, float(b))


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS, held_out=None) -> Model | None:
    """A model from at most `rows` labelled documents that are not held out, taken by a hash of doc_id; None if there are none.

    Where several labels have one doc_id the worst counts; null labels are left out. Where several rows have one doc_id, equal or not, the
    text with the lowest hash stands for it, so no doc_id counts twice and reruns agree. The sample's words, a bounded number of rows, go to
    the driver, which fits the model; an empty table gives no model.
    """
    held_out = F.coalesce(remainder(4) == 2, F.lit(False)) if held_out is None else held_out
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out)
    taken = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    spark = docs.sparkSession
    arrow_batches(spark)
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(taken), "doc_id")  # `rows` bounds taken
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")
    sample = sample.groupBy("doc_id", "toxic").agg(one).select("doc_id", "toxic", "t.text")

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                low = (text or "").lower()
                out.append([" ".join(sorted(set(WORD.findall(low, s, e)))) for s, e in sentences(low)])
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(out, pa.list_(pa.string())), batch.column("doc_id").cast(pa.string())], ["toxic", "sentences", "doc_id"])

    got = sample.select("toxic", "text", "doc_id").mapInArrow(run, f"toxic {dict(taken.dtypes)['toxic']}, sentences array<string>, doc_id string").collect()
    got.sort(key=lambda r: (r.doc_id, r.sentences))
    data = [([s.split(" ") for s in r.sentences], int(r.toxic > 0)) for r in got]
    return fit(data) if any(y for _, y in data) else None


def score_toxicity(docs: DataFrame, model: Model | None) -> DataFrame:
    """The columns of docs (text, any others) with score, predicted and offending (start, stop, probability of each offending sentence).

    One row each, repeated rows too, no shuffle, whole texts; offsets are code points. A null or empty text, or a missing model, scores 0. Only the model is
    broadcast: it holds at most FEATURES features.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast(None if model is None else (model.weights, model.bias))
    names = [c for c in docs.columns if c not in ("score", "predicted", "offending")]
    docs = docs.select(*names)
    spans = T.ArrayType(T.StructType().add("start", "integer").add("stop", "integer").add("p", "double"))
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("offending", spans)])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("p", pa.float64())]))

    def run(batches):
        model = None if shared.value is None else Model(*shared.value)
        for batch in batches:
            got = [model.score(t) if model else (0.0, []) for t in batch.column("text").to_pylist()]
            score = [x[0] for x in got]
            extra = [pa.array(score, pa.float64()), pa.array([int(x >= THRESHOLD) for x in score], pa.int32()), pa.array([[{"start": a, "stop": b, "p": p} for a, b, p in x[1]] for x in got], kind)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*names, "score", "predicted", "offending"])

    return docs.mapInArrow(run, schema)


def op5_toxicity(spark, sf_dir):
    """doc_id, held_out, score, predicted of all documents."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.coalesce(remainder(4) == 2, F.lit(False))
    return score_toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
