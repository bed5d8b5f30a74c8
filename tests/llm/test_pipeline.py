"""The pipeline on a small corpus against plain Python, and its stages on odd rows."""

import base64
import collections
import hashlib
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from isopleth.llm import mixing, zstd_toxicity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use themselves.
CLASHING = ("size", "key", "row", "copy", "form", "finish", "words", "before", "taken", "target", "weight", "toxicity", "score", "pii", "spans_email", "dropped_id", "label", "id", "x", "bands", "held", "TEXT_")


def _corpus(rnd):
    """Prose with insults, exact and near copies, addresses, several sources; (doc_id, text, lang, source, n_chars) and labels."""
    syllables, bad = ["the", "ing", "er", "and", "st", "on", "ma"], ["zagrub", "wokkel", "pfinzt"]
    texts, labels = [], []
    for i in range(200):
        words = ["".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(5, 90))]
        toxic = int(rnd.random() < 0.25)
        for _ in range(4 * toxic):
            words[rnd.randrange(len(words))] = rnd.choice(bad)
        if i % 7 == 0:
            words[rnd.randrange(len(words))] = f"me{i}@mail.example"
        if i % 11 == 0:
            words.append("10.2.30.4")
        texts.append(" ".join(words))
        labels.append((i, 1, toxic))
    texts += [texts[5], texts[5] + "  ", texts[8] + " end", None, "", "a  b", "\tone\n"]
    return [(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t or "")) for i, t in enumerate(texts)], labels


def _kept(rows):
    """One row of each class of texts that 5-word shingles link at 0.8, by union and find over all pairs."""
    bags = [collections.Counter(tuple(w[p : p + min(5, len(w))]) for p in range(max(1, len(w) - 4))) if (w := (r[1] or "").split()) else None for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if bags[a] and bags[b] and sum((bags[a] & bags[b]).values()) >= 0.8 * sum((bags[a] | bags[b]).values()):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [r for i, r in enumerate(rows) if find(i) == i]


def _mask(text):
    text = text and re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[EMAIL]", text)
    return text and text.replace("10.2.30.4", "[IP]")


def _served(rows):
    """Texts of the copies that weighted fair queueing serves, by sorting every packet."""
    sizes = [len((r[1] or "").split()) for r in rows]
    weight = dict(zip([*sorted({r[3] for r in rows if r[3]}), None], [5, 2, 1] * 9))
    whole, ahead, packets, taken = collections.Counter(), collections.Counter(), [], collections.Counter()
    for r, n in zip(rows, sizes):
        whole[r[3]] += n
    for i in sorted(range(len(rows)), key=lambda i: hashlib.md5(str(rows[i][0]).encode()).hexdigest()):
        s = rows[i][3]
        for copy in range(3):
            for first in range(0, sizes[i], mixing.PACKET):
                n = min(mixing.PACKET, sizes[i] - first)
                packets.append(((ahead[s] + copy * whole[s] + first + n) / weight[s], s is None, s or "", i, n))
        ahead[s] += sizes[i]
    left = sum(sizes)
    for *_, i, n in sorted(packets):
        taken[i] += min(left, n)
        left -= min(left, n)
    for i, n in taken.items():
        for copy in range(3):
            if (words := min(sizes[i], n - copy * sizes[i])) > 0:
                yield rows[i][0], rows[i][1] if words == sizes[i] else " ".join(rows[i][1].split()[:words])


def test_run_against_plain_python(spark, tmp_path):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows, labels = _corpus(random.Random(17))
    docs = spark.createDataFrame(rows, COLUMNS)
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    known.write.parquet(f"{tmp_path}/labels.parquet")
    scores = zstd_toxicity._Scorer(zstd_toxicity.train(docs, known)).scores([r[1] for r in rows])
    clean = [r for r, s in zip(rows, scores) if s < 0.5]
    assert 130 < len(clean) < 190
    want = []
    for i, text in _served([(i, _mask(t), *rest) for i, t, *rest in _kept(clean)]):
        ids = np.array(encoding.encode_ordinary(text), "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(want)


def _odd(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "a@b.c x " * 5000, "en", "a", 40000), (4, "one two", "en", None, 7), (4, "one two", "en", None, 7), (4, "three", "de", "b", 5), (None, "one two", None, "b", 7), (None, None, None, None, None)]
    return spark.createDataFrame([(*r, *["z"] * len(CLASHING)) for r in rows], COLUMNS + "".join(f", `{c}` string" for c in CLASHING))


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, tmp_path, name, stage):
    spark.createDataFrame([(3, 1, 0), (4, None, 1), (None, 1, 1), (5, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = _odd(spark)
    got = [r.asDict() for r in stage(spark, docs, str(tmp_path)).collect()]
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    if name == "bpe":
        assert len(got) == 8 and sum(r["n_tokens"] == 0 for r in got) == 3
        return
    assert all(list(r) == docs.columns and all(r[c] == "z" for c in CLASHING) for r in got)
    if name == "toxicity":
        assert {r["text"] for r in got} <= {r.text for r in docs.collect()}
    elif name == "near_duplicates":
        # rows without an id are kept
        assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got) == [(0, ""), (0, "one two"), (1, ""), (2, ""), (3, "a@b.c x " * 5000), (4, "one two"), (4, "three")]
    elif name == "pii":
        assert sorted((r["doc_id"] or 0, r["n_chars"] or 0) for r in got) == [(0, 0), (0, 7), (1, 0), (2, 0), (3, 50000), (4, 5), (4, 7), (4, 7)]
    else:
        assert sum(len(r["text"].split()) for r in got) == 10007 and all(r["n_chars"] == len(r["text"]) for r in got)
