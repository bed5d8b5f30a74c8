"""Language of whole texts by a linear-chain conditional random field over their words.

Every word gets a language: hashed affix, character n-gram and lexicon features score it, learned
transitions tie neighbours, forward-backward gives each word's posterior. A text's language is the one with
the greatest mean posterior, so code-switched text is decided by what most of it is. A sequence is a line,
cut after SEGMENT words.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import resident, small

#: Documents of each language that the model is fitted on, at most, in the order of a hash of doc_id.
TRAIN_PER_LANG = 250
FEATURE_BITS = 18
SEGMENT = 64
ROUNDS, STEP, RIDGE = 30, 0.5, 1e-4
CACHE_WORDS = 500_000
BATCH_CHARS = 2_000_000
UNKNOWN = "und"

#: Runs of letters, and of numerals that are no decimal digits.
_RUNS = re.compile(r"[^\W\d_]+")


@cache
def _letters() -> re.Pattern:
    """Runs of letters: \\w without digits of any kind, fractions and numerals such as Roman ones."""
    others = "".join(c for c in map(chr, range(0x110000)) if c.isalnum() and not c.isalpha())
    return re.compile(rf"[^\W_{others}]+")


def sequences(text: str | None) -> list[list[str]]:
    """Lower-cased runs of letters, by line, at most SEGMENT in each."""
    out = []
    for line in (text or "").lower().split("\n"):
        words = _RUNS.findall(line)
        if not all(map(str.isalpha, words)):  # numerals in them, which the slower pattern leaves out
            words = [x for w in words for x in ([w] if w.isalpha() else _letters().findall(w))]
        out.extend(words[i : i + SEGMENT] for i in range(0, len(words), SEGMENT))
    return out


def features(word: str) -> list[int]:
    """Hashed features: the word itself (lexicon), prefixes and suffixes, bigrams and trigrams with borders."""
    w = f"^{word}$"
    named = ["w" + word]
    named += ["p" + word[:k] for k in (1, 2, 3, 4) if len(word) >= k]
    named += ["s" + word[-k:] for k in (1, 2, 3, 4) if len(word) >= k]
    named += ["n" + w[i : i + k] for k in (2, 3) for i in range(len(w) - k + 1)]
    mask = (1 << FEATURE_BITS) - 1
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) & mask for x in named]


@dataclass(frozen=True)
class CrfModel:
    langs: tuple[str, ...]
    emissions: bytes  # float32, 2**FEATURE_BITS rows of one column per language
    transitions: bytes  # float64, previous language by next


def _emit(weights: np.ndarray, words: list[str]) -> np.ndarray:
    """Score of each word in each language: mean over its features' weights times their root."""
    each = [features(w) for w in words]
    sizes = np.array([len(x) for x in each])
    flat = np.fromiter((i for x in each for i in x), np.int64, int(sizes.sum()))
    starts = np.cumsum(sizes) - sizes
    return np.add.reduceat(weights[flat], starts, axis=0) / np.sqrt(sizes)[:, None]


def _posteriors(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Forward-backward over sequences of given lengths, longest first, laid out in one after another.

    scores: words x languages. Returns each word's posterior and, on demand, expected transition counts.
    """
    k = scores.shape[1]
    n, longest = len(lengths), int(lengths[0]) if len(lengths) else 0
    starts = np.cumsum(lengths) - lengths
    likely = np.exp(scores - scores.max(1, keepdims=True))
    step = np.exp(transitions)
    alive = np.searchsorted(-lengths, -np.arange(longest), "left")  # sequences longer than t
    forward, backward = np.empty_like(likely), np.ones_like(likely)
    for t in range(longest):
        at = starts[: alive[t]] + t
        a = likely[at] if t == 0 else (forward[at - 1] @ step) * likely[at]
        forward[at] = a / a.sum(1, keepdims=True)
    counts = np.zeros((k, k)) if pairs else None
    for t in range(longest - 2, -1, -1):
        at = starts[: alive[t + 1]] + t
        ahead = likely[at + 1] * backward[at + 1]
        b = ahead @ step.T
        if pairs:
            joint = forward[at][:, :, None] * step * ahead[:, None, :]
            counts += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        backward[at] = b / b.sum(1, keepdims=True)
    both = forward * backward
    return both / both.sum(1, keepdims=True), counts


def _layout(each: list[list[list[str]]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Words of all sequences, longest sequence first; their lengths; the text that each word belongs to."""
    order = sorted(((len(s), i, s) for i, ss in enumerate(each) for s in ss), key=lambda x: -x[0])
    lengths = np.array([x[0] for x in order], np.int64)
    owner = np.repeat(np.array([x[1] for x in order], np.int64), lengths)
    return [w for x in order for w in x[2]], lengths, owner


def fit(texts: list[str], langs: list[str]) -> CrfModel:
    """Maximise the conditional likelihood of the words' languages, each word labelled as its text, by Adagrad."""
    names = tuple(sorted(set(langs)))
    words, lengths, owner = _layout([sequences(t) for t in texts])
    weights = np.zeros((1 << FEATURE_BITS, len(names)), np.float32)
    transitions = np.zeros((len(names), len(names)))
    if words and len(names) > 1:
        truth = np.array([names.index(x) for x in langs])[owner]
        vocabulary, index = np.unique(np.array(words, object), return_inverse=True)
        each = [features(w) for w in vocabulary]
        sizes = np.array([len(x) for x in each])
        flat = np.fromiter((i for x in each for i in x), np.int64, int(sizes.sum()))
        of_word, scale = np.repeat(np.arange(len(each)), sizes), 1 / np.sqrt(sizes)
        starts = np.cumsum(sizes) - sizes
        balance = (len(truth) / np.maximum(np.bincount(truth, minlength=len(names)), 1) / len(names))[truth]
        seen = np.zeros((len(names), len(names)))
        joined = np.arange(len(truth)) + 1 - np.repeat(np.cumsum(lengths), lengths) < 0  # all but last words
        np.add.at(seen, (truth[joined], truth[1:][joined[:-1]] if len(truth) > 1 else truth[:0]), 1)
        squares, squares_t = np.full_like(weights, 1e-8), np.full_like(transitions, 1e-8)
        for _ in range(ROUNDS):
            scores = (np.add.reduceat(weights[flat], starts, axis=0) * scale[:, None])[index]
            posterior, expected = _posteriors(scores, lengths, transitions, pairs=True)
            error = -posterior
            error[np.arange(len(truth)), truth] += 1
            error *= balance[:, None] / len(truth)
            per_word = np.stack([np.bincount(index, error[:, j], len(each)) for j in range(len(names))], 1) * scale[:, None]
            gradient = np.stack([np.bincount(flat, per_word[of_word, j], len(weights)) for j in range(len(names))], 1) - RIDGE * weights / len(names)
            squares += gradient**2
            weights += (STEP * gradient / np.sqrt(squares)).astype(np.float32)
            gradient_t = (seen - expected) / len(truth) - 0.05 * transitions
            squares_t += gradient_t**2
            transitions += STEP * gradient_t / np.sqrt(squares_t)
    return CrfModel(names, weights.tobytes(), transitions.tobytes())


def training_rows(docs: DataFrame, known: DataFrame, per_lang: int = TRAIN_PER_LANG) -> DataFrame:
    """(doc_id, text, lang) of at most `per_lang` ids of `known` (doc_id, lang) for each language, texts from `docs`.

    Ids are ranked by a hash, each task keeping its first few of a language; then texts are fetched.
    """
    known = known.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = small(known.withColumn("place", place).where(F.col("place") <= per_lang).select("doc_id", "lang").distinct())
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text", "lang")
    return texts.join(chosen, ["doc_id", "lang"]).select("doc_id", "text", "lang")


def train(docs: DataFrame, known: DataFrame) -> CrfModel:
    """Fit on training_rows, which is bounded, on the driver; the order is fixed, so reruns agree."""
    rows = sorted(training_rows(docs, known).collect(), key=lambda r: (r.doc_id, r.lang, r.text))
    return fit([r.text for r in rows], [r.lang for r in rows])


class Tagger:
    """Posteriors in a worker; word scores are kept while it lives."""

    def __init__(self, model: CrfModel) -> None:
        self.langs = model.langs
        k = len(model.langs)
        self.weights = np.frombuffer(model.emissions, np.float32).reshape(-1, k) if k else None
        self.transitions = np.frombuffer(model.transitions).reshape(k, k)
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((0, k))

    def _lookup(self, words: list[str]) -> np.ndarray:
        if len(self.rows) > CACHE_WORDS:
            self.rows, self.scores = {}, self.scores[:0]
        fresh = list(dict.fromkeys(w for w in words if w not in self.rows))
        if fresh:
            self.rows.update(zip(fresh, range(len(self.rows), len(self.rows) + len(fresh))))
            self.scores = np.concatenate([self.scores, _emit(self.weights, fresh)])
        return self.scores[np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))]

    def words(self, text: str) -> list[tuple[str, str, float]]:
        """Each word with its most likely language and that posterior, longest sequence first."""
        words, lengths, _ = _layout([sequences(text)])
        if not words or not self.langs:
            return []
        posterior, _ = _posteriors(self._lookup(words), lengths, self.transitions)
        return [(w, self.langs[i], float(p[i])) for w, p, i in zip(words, posterior, posterior.argmax(1))]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        words, lengths, owner = _layout([sequences(t) for t in texts])
        if not words or not self.langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        posterior, _ = _posteriors(self._lookup(words), lengths, self.transitions)
        total = np.stack([np.bincount(owner, posterior[:, j], len(texts)) for j in range(len(self.langs))], 1)
        counts = np.bincount(owner, minlength=len(texts))
        best = total.argmax(1)
        share = total[np.arange(len(texts)), best] / np.maximum(counts, 1)
        return [self.langs[b] if c else UNKNOWN for b, c in zip(best, counts)], [min(max(float(x), 0.0), 1.0) for x in share]


def _tagger(model: CrfModel) -> Tagger:
    return resident(("crf", model), lambda: Tagger(model))


def predict_language(df: DataFrame, model: CrfModel, text: str = "text") -> DataFrame:
    """`df` with lang_pred and score (mean posterior of that language) of every whole text.

    Texts that are null or have no letters get `und` and 0, as all do if no language was learnt. Rows, repeated
    ones too, and other columns stay; a column named lang_pred or score must not be there. Of languages that
    tie the first by name is taken; an empty table gives no rows. The model (4 MB for four languages) goes with the tasks.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = _tagger(model)

        def tagged(batch: pa.RecordBatch, start: int, texts: list) -> pa.RecordBatch:
            langs, scores = tagger.predict(texts)
            part = batch.slice(start, len(texts))
            return pa.RecordBatch.from_arrays([*part.columns, pa.array(langs), pa.array(scores, pa.float64())], [*part.schema.names, "lang_pred", "score"])

        for batch in batches:
            start, some, size = 0, [], 0
            for i, t in enumerate(batch.column(text).to_pylist()):
                some.append(t)
                size += len(t or "")
                if size > BATCH_CHARS:
                    yield tagged(batch, start, some)
                    start, some, size = i + 1, [], 0
            if some:
                yield tagged(batch, start, some)

    return df.mapInArrow(run, schema)
