"""Toxicity by compression distance: separate zstandard dictionaries of toxic and of ordinary text.

Two kinds of windows are judged. A distance is a window's length under the ordinary dictionary less its length
under the toxic one; each byte is widened to four, so that zstandard's whole-byte lengths tell single
characters apart. Windows of running text, a few words long and overlapping, meet the two dictionaries that
zstandard trains on the sampled toxic and on the ordinary texts, so phrases of ordinary words and insults too
rare for the list tell too. Words with their borders, and their first few bytes, meet an ordinary dictionary
that the words it explained worst are added to, and a list of word heads and words that toxic documents share. How many windows pass each threshold gives a document's score, calibrated
by logistic regression on the same labelled sample. Workers keep the distances of the words they have met, so
most words cost a lookup; running text is compressed anew.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, crc_bucket, resident, with_field

#: Labelled documents that a model is fitted on, at most for each label, in the order of a hash of doc_id.
TRAIN_PER_LABEL = 1500
#: Bytes of the ordinary dictionary, before the windows it explained worst are appended, and of each dictionary for running text.
ORDINARY_BYTES, RUN_BYTES = 65_536, 65_536
WIDEN = 4
#: A toxic segment occurs in this share of the toxic documents, at least this often, and this much more often than in ordinary ones.
SEGMENT_SHARE, SEGMENT_DOCS, SEGMENT_RATIO = 0.02, 5, 20.0
#: Distances at which windows of words are counted, and rounds of appending hard ordinary windows.
THRESHOLDS = (5, 6, 7, 8, 9, 10, 11, 12, 14)
HARD_ROUNDS, HARD_DISTANCE = 6, 5
#: Words of a window of running text, words between the starts of two, and distances at which they are counted.
RUN_WORDS, RUN_STRIDE = 6, 3
RUN_THRESHOLDS = (4, 6, 8, 10, 12, 15, 18, 24)
#: Parts of the sample whose running text is judged by dictionaries of the other parts while the weights are fitted.
CROSS = 3
#: Bytes (k) of the segments that zstandard picks for running text, long enough for a phrase, and of what it counts in them (d).
RUN_SEGMENT = {"k": 200, "d": 8}
CACHE_WINDOWS = 300_000
#: Bytes of a word in the windows at its head; chosen, like MISS_COST, on a split of the training fold (crc32 mod 5 = 1).
HEADS = (4, 5)
LEVEL = 1
#: A toxic document missed counts as much as so many ordinary ones taken for toxic.
MISS_COST = 3.0
#: Base that packs two distances into one integer; distances are far smaller.
PACK = 1 << 12

_WORD = None


def _words(text: str | None) -> list[bytes]:
    """Lower-cased words: bytes of letters, digits and all beyond ASCII."""
    import re

    global _WORD
    _WORD = _WORD or re.compile(rb"[a-z0-9\x80-\xff]+")
    return _WORD.findall((text or "").lower().encode())


_TABLE = np.stack([np.frombuffer(hashlib.sha256(bytes((i,))).digest()[:WIDEN], np.uint8) for i in range(256)])


def _widen(raw: bytes) -> bytes:
    return _TABLE[np.frombuffer(raw, np.uint8)].tobytes()


def _windows(word: bytes) -> list[bytes]:
    """The whole word between borders, and its heads."""
    return [b" " + word + b" ", *(b" " + word[:k] for k in HEADS if len(word) >= k)]


def _wide_lengths(compressor, windows: list[bytes]) -> np.ndarray:
    out = np.empty(len(windows), np.int32)
    for i in range(0, len(windows), 4096):
        part = compressor.multi_compress_to_buffer(windows[i : i + 4096])
        out[i : i + len(part)] = [len(part[j]) for j in range(len(part))]
    return out


def _lengths(compressor, windows: list[bytes]) -> np.ndarray:
    return _wide_lengths(compressor, [_widen(w) for w in windows])


@dataclass(frozen=True)
class ToxicityModel:
    toxic: bytes
    ordinary: bytes
    toxic_runs: bytes
    ordinary_runs: bytes
    weights: tuple[float, ...]

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ np.array(self.weights), -30, 30)))


@lru_cache(maxsize=2)
def _compressors(toxic: bytes, ordinary: bytes):
    import zstandard as zs

    def of(content: bytes):
        return zs.ZstdCompressor(level=LEVEL, dict_data=zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False)

    return of(toxic), of(ordinary)


def _window_distances(toxic: bytes, ordinary: bytes, windows: list[bytes]) -> np.ndarray:
    by_toxic, by_ordinary = _compressors(toxic, ordinary)
    return _lengths(by_ordinary, windows) - _lengths(by_toxic, windows)


def _distances(toxic: bytes, ordinary: bytes, words: list[bytes]) -> list[int]:
    """Of each word: distance of the whole, and the largest of its heads' (of the whole where it has none), packed into one integer."""
    each = [_windows(w) for w in words]
    some = list({x for xs in each for x in xs})
    known = dict(zip(some, _window_distances(toxic, ordinary, some).tolist()))
    return [known[xs[0]] * PACK + max(known[x] for x in xs[1:] or xs) + PACK // 2 for xs in each]


def _runs(words: list[bytes]) -> tuple[bytes, np.ndarray]:
    """Words widened, and the places and lengths of windows in them, RUN_STRIDE words apart; any RUN_WORDS - RUN_STRIDE + 1 words in a row share one."""
    if not words:
        return b"", np.empty((0, 2), np.uint64)
    wide, last = _widen(b" " + b" ".join(words) + b" "), len(words)
    at = np.concatenate([[0], WIDEN * np.cumsum(np.fromiter(map(len, words), np.int64, last) + 1)])
    first = np.arange(0, max(last - RUN_WORDS + RUN_STRIDE, 1), RUN_STRIDE)
    begin = at[first]
    return wide, np.stack([begin, at[np.minimum(first + RUN_WORDS, last)] + WIDEN - begin], 1).astype(np.uint64)


def _run_distances(toxic: bytes, ordinary: bytes, each: list[list[bytes]]) -> list[np.ndarray]:
    """Distances of every document's windows of running text, which are compressed where they lie."""
    import zstandard as zs

    if not each:
        return []
    runs = [_runs(ws) for ws in each]
    text, sizes = b"".join(wide for wide, _ in runs), [len(places) for _, places in runs]
    begins = np.cumsum([0, *(len(wide) for wide, _ in runs[:-1])]).astype(np.uint64)
    places = np.concatenate([places for _, places in runs])
    places[:, 0] += np.repeat(begins, sizes)
    found = np.zeros(len(places), np.int32)
    by_toxic, by_ordinary = _compressors(toxic, ordinary)
    for i in range(0, len(places), 4096):
        some = zs.BufferWithSegments(text, places[i : i + 4096].tobytes())
        for compressor, sign in ((by_ordinary, 1), (by_toxic, -1)):
            found[i : i + 4096] += sign * np.fromiter(map(len, compressor.multi_compress_to_buffer(some)), np.int32, len(some))
    return np.split(found, np.cumsum(sizes)[:-1])


def _features(packed: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Per document: log counts of words whose whole, and whose head, reach each threshold, and of windows of running text, log number of words, one."""
    both = np.stack([packed // PACK, packed % PACK - PACK // 2])
    counts = np.log1p((both[:, None, :] >= np.array(THRESHOLDS)[None, :, None]).sum(2)).reshape(-1)
    running = np.log1p((runs[None, :] >= np.array(RUN_THRESHOLDS)[:, None]).sum(1))
    return np.array([*counts, *running, math.log1p(len(packed)) / 5, 1.0])


def _segments(words: set[bytes]) -> set[bytes]:
    out = {b" " + w + b" " for w in words}
    for w in words:
        out.update(b" " + w[:k] for k in range(4, min(len(w), 12) + 1))
    return out


def _toxic_content(toxic: list[str], ordinary: list[str]) -> bytes:
    """Word heads and words that toxic documents share and ordinary ones hardly have, the commonest last, where zstandard reaches them cheapest."""
    shared: Counter[bytes] = Counter()
    for text in toxic:
        shared.update(_segments(set(_words(text))))
    least = max(SEGMENT_DOCS, SEGMENT_SHARE * len(toxic))
    rare = max(3, least / 4)
    shared = Counter({s: n for s, n in shared.items() if n >= rare})
    usual: Counter[bytes] = Counter()
    for text in ordinary:
        usual.update(s for s in _segments(set(_words(text))) if s in shared)
    marked = {s: n for s, n in shared.items() if (n + 0.5) / (len(toxic) + 1) >= SEGMENT_RATIO * (usual[s] + 0.5) / (len(ordinary) + 1)}
    longer: Counter[bytes] = Counter()
    for s, n in marked.items():
        for k in range(2, len(s)):
            longer[s[:k]] = max(longer[s[:k]], n)
    heads: list[bytes] = []
    for s in sorted(marked, key=lambda s: (-marked[s], s)):
        if marked[s] >= least and longer[s] < 0.8 * marked[s] and not s.startswith(tuple(heads)):
            heads.append(s)
    whole = [s for s in marked if s.endswith(b" ") and s not in heads and s.startswith(tuple(heads))] if heads else []
    return _widen(b"".join(sorted(whole, key=lambda s: (marked[s], s)) + heads[::-1]))


def _trained(texts: list[str], most: int, **segment: int) -> bytes:
    """A dictionary that zstandard trains on runs of 8 words, in hash order."""
    import zstandard as zs

    runs = [_widen(b" " + b" ".join(ws[i : i + 8]) + b" ") for t in texts for ws in (_words(t),) for i in range(0, len(ws), 8)]
    runs = sorted(runs, key=lambda r: hashlib.md5(r).digest())[:20_000]
    try:
        return zs.train_dictionary(most, runs, **segment).as_bytes()
    except zs.ZstdError:  # too little text to train on: the text itself serves
        return b"".join(runs)[-most:] or b"\0" * 8


def fit(texts: list[str | None], labels: list[int], share: float | None = None) -> ToxicityModel:
    """Train both dictionaries and the thresholds' weights on labelled texts.

    share: of label 1 where the model will be used, if the sample was drawn with another. With one label
    only, or none, every score is the share of label 1.
    """
    toxic = list(dict.fromkeys(t for t, y in zip(texts, labels) if y == 1 and t))
    ordinary = list(dict.fromkeys(t for t, y in zip(texts, labels) if y == 0 and t))
    flat = [0.0] * (2 * len(THRESHOLDS) + len(RUN_THRESHOLDS) + 1)
    if not toxic or not ordinary:
        share = (sum(labels) + 0.5) / (len(labels) + 1)
        return ToxicityModel(*[b"\0" * 8] * 4, (*flat, math.log(share / (1 - share))))
    usual: Counter[bytes] = Counter(w for t in ordinary for w in _words(t))
    content = _trained(ordinary, ORDINARY_BYTES)
    poison = _toxic_content(toxic, ordinary) or b"\0" * 8
    of_runs = [_trained(texts, RUN_BYTES, **RUN_SEGMENT) for texts in (toxic, ordinary)]
    words = sorted(usual, key=lambda w: (usual[w], w))
    windows = list(dict.fromkeys(x for w in words for x in _windows(w)))
    appended: list[bytes] = []
    for _ in range(HARD_ROUNDS):
        distances = _window_distances(poison, content + _widen(b"".join(appended)), windows)
        have = set(appended)
        hard = [w for w, d in zip(windows, distances) if d >= HARD_DISTANCE]
        if not (new := [w for w in hard if w not in have]):
            break
        appended += new
    content += _widen(b"".join(appended))
    every = sorted({w for t in toxic for w in _words(t)} | set(words))
    known = dict(zip(every, _distances(poison, content, every)))
    each = [_words(t) for t in toxic + ordinary]
    # a text is foreign to the dictionaries that judge its runs: each third's are trained on the other two
    runs: list[np.ndarray] = [np.empty(0)] * len(each)
    for k in range(CROSS):
        rest = [[t for i, t in enumerate(texts, at) if i % CROSS != k] for texts, at in ((toxic, 0), (ordinary, len(toxic)))]
        runs[k::CROSS] = _run_distances(*(_trained(texts, RUN_BYTES, **RUN_SEGMENT) for texts in rest), each[k::CROSS])
    x = np.array([_features(np.array([known[w] for w in ws]), rs) for ws, rs in zip(each, runs)])
    y = np.array([1.0] * len(toxic) + [0.0] * len(ordinary))
    weights = np.zeros(x.shape[1])
    ridge = np.diag([1e-2] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ weights)
        weights += step
        if np.abs(step).max() < 1e-8:
            break
    if share is not None and 0 < share < 1:
        weights[-1] += math.log(MISS_COST * share / (1 - share)) - math.log(len(toxic) / len(ordinary))
    return ToxicityModel(poison, content, *of_runs, tuple(weights.tolist()))


def labelled(labels: DataFrame, train: int = 5) -> DataFrame:
    """(doc_id, toxic) outside the held-out fold; a doc_id with several labels is toxic if any says so."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_bucket(F.col("doc_id"), train) != 0))
    return usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def training_rows(docs: DataFrame, labels: DataFrame, per_label: int = TRAIN_PER_LABEL) -> DataFrame:
    """(doc_id, text, toxic) of at most `per_label` labelled documents of each label in hash order.

    Only ids are ranked; texts are fetched for the chosen few. A doc_id in several rows gives its least text.
    """
    known = labelled(labels)
    ordinary, toxic = (bounded_sample(known.where(F.col("toxic") == y), "doc_id", per_label) for y in (0, 1))
    chosen = ordinary.unionByName(toxic)  # at most 2 * per_label ids
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))


def train(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Fit on training_rows, which is bounded, on the driver; the order is fixed, so reruns agree."""
    rows = sorted(training_rows(docs, labels).collect(), key=lambda r: r.doc_id)
    share = labelled(labels).agg(F.avg("toxic")).first()[0]
    return fit([r.text for r in rows], [r.toxic for r in rows], share)


class _Scorer:
    """Distances of a worker's windows, kept while it lives."""

    def __init__(self, model: ToxicityModel) -> None:
        self.model, self.known = model, {}

    def scores(self, texts: list[str | None]) -> list[float]:
        if len(self.known) > CACHE_WINDOWS:
            self.known.clear()
        each = [_words(t) for t in texts]
        fresh = list({w for ws in each for w in ws if w not in self.known})
        self.known.update(zip(fresh, _distances(self.model.toxic, self.model.ordinary, fresh)))
        if not each:
            return []
        runs = _run_distances(self.model.toxic_runs, self.model.ordinary_runs, each)
        return self.model.score(np.array([_features(np.fromiter(map(self.known.__getitem__, ws), np.int32, len(ws)), rs) for ws, rs in zip(each, runs)])).tolist()


def _scorer(model: ToxicityModel) -> _Scorer:
    return resident(("zstd", model), lambda: _Scorer(model))


def score_toxicity(df: DataFrame, model: ToxicityModel, text: str = "text", out: str = "toxicity") -> DataFrame:
    """`df` with the score (0 to 1) of every whole text in column `out`; null and empty texts get the score of no windows.

    Rows and other columns stay; `out` must not name one of them. The model, some hundred kB, goes with the tasks.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(model)
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                scores = pa.array(scorer.scores(part.column(text).to_pylist()), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, scores], [*part.schema.names, out])

    return df.mapInArrow(run, with_field(df, out, T.DoubleType()))
