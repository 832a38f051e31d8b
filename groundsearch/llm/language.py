"""Language identification by unigram piece models, summed over all segmentations of a word."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundsearch.llm.common import arrow_batches, documents

#: Labelled rows that a model is fitted on, for each language; words of a language that it sees, commonest first.
ROWS, WORDS, SHARES = 1500, 20000, 16
#: Words that a worker remembers.
CACHE = 200_000
ALNUM = re.compile(r"[^\W\d_]+")
LETTERS = regex.compile(r"\p{L}+")
START = "▁"


def words_of(text: str) -> Counter:
    """How often each word, a run of letters (Unicode L, as in training), stands in a lower-cased text."""
    found = Counter(ALNUM.findall(text))
    for w in [w for w in found if not w.isalpha()]:  # numerals as ² and Ⅳ are no letters, but Python's \w takes them
        n = found.pop(w)
        for part in LETTERS.findall(w):
            found[part] += n
    return found


def vocabulary(path: str | None = None) -> list[str]:
    """The pieces of letters, with or without the word-start mark, of a public sentencepiece model, lower-cased."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    return sorted(p for p in pieces if LETTERS.fullmatch(p.replace(START, "", 1)))


class Model:
    """Piece probabilities for each language. Letters outside the vocabulary share a small probability, so every word has a segmentation."""

    def __init__(self, languages: list[str], pieces: list[str], theta: np.ndarray):
        self.languages, self.pieces, self.theta = languages, pieces, theta  # theta: pieces + 1 rows, a column for each language
        self.index = {p: i for i, p in enumerate(pieces)}
        self.longest = max(map(len, pieces), default=1)

    def _ids(self, words: list[str]) -> np.ndarray:
        """Piece ids of every substring, [word, start, length - 1], of words of one length; -1 where there is none."""
        n, get, none = len(words[0]), self.index.get, len(self.pieces)
        wide = min(n, self.longest)
        spans = [(i, k) for i in range(n) for k in range(1, min(wide, n - i) + 1)]
        flat = [get(w[i : i + k], none if k == 1 else -1) for w in words for i, k in spans]
        out = np.full((len(words), n, wide), -1, np.int32)
        rows, cols = zip(*((i, k - 1) for i, k in spans), strict=True)
        out[:, rows, cols] = np.array(flat, np.int32).reshape(len(words), -1)
        return out

    def _blocks(self, words: list[str]):
        """(places, ids) of blocks of words of one length."""
        by_length = defaultdict(list)
        for k, w in enumerate(words):
            by_length[len(w)].append(k)
        for n, at in by_length.items():
            step = max(1, 400_000 // (n * min(n, self.longest)))
            for s in range(0, len(at), step):
                yield at[s : s + step], self._ids([words[k] for k in at[s : s + step]])

    def forward(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """alpha[word, end, language], scaled by its maximum in each column, and the logs of the scales."""
        count, n, wide = ids.shape
        alpha, logs = np.zeros((count, n + 1, len(self.languages))), np.zeros((count, len(self.languages)))
        alpha[:, 0] = 1
        theta = np.vstack([self.theta, np.zeros(len(self.languages))])  # -1: no such piece
        for j in range(1, n + 1):
            for i in range(max(0, j - wide), j):
                alpha[:, j] += alpha[:, i] * theta[ids[:, i, j - i - 1]]
            if j % 16 == 0:  # long words: keep clear of underflow
                scale = np.maximum(alpha[:, max(0, j - wide + 1) : j + 1].max(axis=1), 1e-300)
                alpha[:, : j + 1] /= scale[:, None]
                logs += np.log(scale)
        return alpha, logs

    def log_words(self, words: list[str]) -> np.ndarray:
        """log P(word | language) for each word (marked at its start), summed over all its segmentations."""
        out = np.empty((len(words), len(self.languages)))
        for at, ids in self._blocks(words):
            alpha, logs = self.forward(ids)
            out[at] = np.log(np.maximum(alpha[:, -1], 1e-300)) + logs
        return out

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected counts of each piece under the model, by forward and backward sums; counts: [word, language].

        In words of over 40 letters a piece of k letters is weighed by the word's own P^(-k/n), which leaves the ratios as they are and keeps
        the sums near 1.
        """
        out = np.zeros_like(self.theta)
        theta = np.vstack([self.theta, np.zeros(len(self.languages))])
        for at, ids in self._blocks(words):
            count, n, wide = ids.shape
            tilt = np.exp(-self.log_words([words[k] for k in at]) / n) if n > 40 else 1.0
            weighed = [tilt**k for k in range(wide + 1)]
            alpha = np.zeros((count, n + 1, len(self.languages)))
            beta = np.zeros_like(alpha)
            alpha[:, 0] = beta[:, n] = 1
            for j in range(1, n + 1):
                for i in range(max(0, j - wide), j):
                    alpha[:, j] += alpha[:, i] * theta[ids[:, i, j - i - 1]] * weighed[j - i]
            for i in range(n - 1, -1, -1):
                for j in range(i + 1, min(n, i + wide) + 1):
                    beta[:, i] += beta[:, j] * theta[ids[:, i, j - i - 1]] * weighed[j - i]
            weight = counts[at] / np.maximum(alpha[:, n], 1e-300)
            for i in range(n):
                for j in range(i + 1, min(n, i + wide) + 1):
                    piece = ids[:, i, j - i - 1]
                    use = piece >= 0
                    np.add.at(out, piece[use], (alpha[:, i] * beta[:, j] * theta[piece] * weighed[j - i] * weight)[use])
        return out


def fit(counts: dict[str, Counter], pieces: list[str], rounds: int = 4, smooth: float = 0.05) -> Model:
    """Piece probabilities by expectation maximisation over word counts for each language; counts: {language: Counter(word)}."""
    languages = sorted(counts)
    words = sorted({START + w for c in counts.values() for w in c})
    table = np.array([[float(counts[lang][w[1:]]) for lang in languages] for w in words]).reshape(len(words), len(languages))
    letters = len(pieces) + 1
    start = np.array([1.0 / (1 + len(p)) for p in pieces] + [1e-4])
    model = Model(languages, pieces, np.tile((start / start.sum())[:, None], (1, len(languages))))
    for _ in range(rounds):
        found = model.expected(words, table) + smooth
        model.theta = found / found.sum(axis=0)
    assert model.theta.shape[0] == letters
    return model


def train(docs: DataFrame, held_out, rows: int = ROWS, words: int = WORDS, pieces: list[str] | None = None) -> Model | None:
    """A model of the languages in docs (doc_id, text, lang), from at most `rows` rows of each that are not held out; None if there are none.

    Rows are taken by a hash of doc_id, an equal number from each of SHARES parts of a language, so that a language with most of the rows is
    several tasks; their words are counted on the executors, and of each language's words the commonest `words` go to
    the driver: both bounds are parameters and don't grow with the table. Rows that repeat a doc_id and language are taken together and
    counted as often as they stand there, on the executors.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out)
    share = max(1, rows // SHARES)
    ids = known.select("doc_id", "lang", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SHARES)).alias("share")).distinct()
    order = Window.partitionBy("lang", "share").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = ids.withColumn("k", F.row_number().over(order)).where(F.col("k") <= share).select("doc_id", "lang")
    sample = known.join(F.broadcast(ids), ["doc_id", "lang"])  # at most `rows` for each language
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)))
    counted = sample.select("lang", word.alias("word")).groupBy("lang", "word").count()
    top = Window.partitionBy("lang").orderBy(F.desc("count"), "word")
    counts: dict[str, Counter] = defaultdict(Counter)
    for r in counted.withColumn("k", F.row_number().over(top)).where(F.col("k") <= words).select("lang", "word", "count").collect():
        counts[r["lang"]][r["word"]] = r["count"]
    return fit(dict(counts), vocabulary() if pieces is None else pieces) if counts else None


def score_texts(model: Model, texts: list[str | None], known: dict[str, int], table: list[np.ndarray]) -> list[tuple[str, float]]:
    """(language, posterior probability) of each whole text; known and table are the caller's memory of words and their log probabilities."""
    counted = [words_of((t or "").lower()) for t in texts]
    new = list({w for c in counted for w in c if w not in known})
    if new:
        at = len(table[0]) if table else 0
        logs = model.log_words([START + w for w in new])
        known.update((w, at + k) for k, w in enumerate(new))
        table[:] = [np.vstack([table[0], logs]) if table else logs]
    out = []
    for c in counted:
        if not c:
            out.append(("und", 0.0))
            continue
        total = np.fromiter(c.values(), float, len(c)) @ table[0][[known[w] for w in c]]
        p = np.exp(total - total.max())
        best = int(p.argmax())
        out.append((model.languages[best], float(1 / p.sum())))
    return out


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score of every row's whole text (doc_id, text, any others); no shuffle.

    `und` with score 0 where the text is null or has no letter, or where there is no model. Of languages with equal probability the first by
    code point is taken; repeated rows give one row each, other columns play no part, an empty table gives no rows. The model (pieces x languages) is broadcast: its
    size is that of the public vocabulary.
    """
    shared = docs.sparkSession.sparkContext.broadcast(None if model is None else (model.languages, model.pieces, model.theta))

    def run(batches):
        model = None if shared.value is None else Model(*shared.value)
        known, table = {}, []
        for batch in batches:
            texts, out = batch.column("text").to_pylist(), []
            for s in range(0, len(texts), 512):
                if len(known) > CACHE:
                    known, table = {}, []
                out += score_texts(model, texts[s : s + 512], known, table) if model else [("und", 0.0)] * len(texts[s : s + 512])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], ["doc_id", "lang_pred", "score"])

    arrow_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def remainder(n: int):
    """crc32 of doc_id as text, modulo n (null for a null doc_id)."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op9_language(spark, sf_dir):
    """doc_id, held_out, lang_pred, score of all documents."""
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(remainder(5) == 0, F.lit(False))
    return identify(docs, train(docs, held_out)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
