"""Row-wise operators: GIF media, byte-level BPE, personal data, language, toxicity."""

import hashlib
import random
import string
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from isopleth.llm import bpe_duckdb, crf_langid, media_gif, pii, zstd_toxicity

TEXTS = "doc_id long, text string, pii string, n_words long, gif string"
ODD = [None, "", " ", "\x00\n", "é" * 70, "a" * 64, "x y " * 9000]


def odd_rows(spark):
    """Nulls, empty, long and repeated rows, a null id, extra columns whose names operators use themselves."""
    rows = [(i, t, "p", 1, "g") for i, t in enumerate(ODD)] + [(1, "", "p", 1, "g"), (None, "b", None, None, None)]
    return spark.createDataFrame(rows, TEXTS)


def test_lzw_round_trip():
    rnd = random.Random(1)
    for n in (64, 64 * 255, 64 * 257, 64 * 1100):
        for samples in (bytes(n), rnd.randbytes(n), (b"the cat sat on the mat " * n)[:n]):
            assert b"".join(f.samples for f in media_gif.decode(media_gif.encode(samples))) == samples


def gif(blocks, size=(2, 2)):
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    return b"GIF89a" + struct.pack("<HHBBB", *size, 0x81, 0, 0) + palette + b"".join(blocks) + b";"


def picture(codes, place, delay=1, disposal=0, transparent=None, flags=0, local=b""):
    """A frame of 2-bit samples whose codes (3 bits each, then 4) are given with their widths."""
    bits, at = 0, 0
    for code, width in codes:
        bits |= code << at
        at += width
    data = bits.to_bytes(-(-at // 8), "little")
    control = b"\x21\xf9\x04" + struct.pack("<BHBB", disposal << 2 | (transparent is not None), delay, transparent or 0, 0)
    return control + b"\x2c" + struct.pack("<HHHHB", *place, flags) + local + b"\x02" + bytes([len(data)]) + data + b"\x00"


def test_composition_rules():
    red = [(4, 3), (1, 3), (6, 3), (1, 3), (5, 3)]  # four samples of 1, one by a table entry
    frames = list(
        media_gif.decode(
            gif(
                [
                    picture(red, (0, 0, 2, 2)),
                    picture([(4, 3), (2, 3), (5, 3)], (0, 0, 1, 1), disposal=3),
                    picture([(4, 3), (3, 3), (5, 3)], (1, 1, 1, 1), disposal=2),
                    picture([(4, 3), (2, 3), (3, 3), (5, 3)], (0, 0, 2, 1), transparent=3),
                ]
            )
        )
    )
    colours = [f.seen.reshape(-1, 3).tolist() for f in frames]
    r, g, b, k = [255, 0, 0], [0, 255, 0], [0, 0, 255], [0, 0, 0]
    assert colours == [[r] * 4, [g], [b], [g, r]]
    bins = [{tuple(c): int(f.counts[(c[0] >> 6) * 16 + (c[1] >> 6) * 4 + (c[2] >> 6)]) for c in (r, g, b, k)} for f in frames]
    assert [[x[tuple(c)] for c in (r, g, b, k)] for x in bins] == [[4, 0, 0, 0], [3, 1, 0, 0], [3, 0, 1, 0], [2, 1, 0, 1]]
    assert [f.start_ms for f in frames] == [0, 10, 20, 30]


def test_composition_equals_whole_pictures():
    """Random frames, some partly or wholly beyond the picture, against a composer that keeps the whole picture."""
    rnd, lines, columns = random.Random(5), 150, 200
    places, blocks = [], []
    for _ in range(40):
        left, top, width, height = rnd.randrange(220), rnd.randrange(170), rnd.randrange(1, 130), rnd.randrange(1, 130)
        samples, disposal, clear = rnd.randbytes(width * height), rnd.randrange(4), rnd.randrange(-1, 256)
        coded = media_gif.lzw_encode(samples)
        blocks.append(b"\x21\xf9\x04" + struct.pack("<BHBB", disposal << 2 | (clear >= 0), 1, max(clear, 0), 0) + b"\x2c" + struct.pack("<HHHHB", left, top, width, height, 0) + b"\x08")
        blocks.append(b"".join(bytes((len(coded[i : i + 255]),)) + coded[i : i + 255] for i in range(0, len(coded), 255)) + b"\x00")
        places.append((left, top, width, height, samples, disposal, clear))
    data = b"GIF89a" + struct.pack("<HHBBB", columns, lines, 0xF7, 9, 0) + media_gif.PALETTE + b"".join(blocks) + b";"
    colours = np.frombuffer(media_gif.PALETTE, np.uint8).reshape(256, 3)
    canvas = np.tile(colours[9], (lines, columns, 1))
    for frame, (left, top, width, height, samples, disposal, clear) in zip(media_gif.decode(data), places, strict=True):
        held = canvas.copy()
        for y in range(top, min(top + height, lines)):
            for x in range(left, min(left + width, columns)):
                if (sample := samples[(y - top) * width + x - left]) != clear:
                    canvas[y, x] = colours[sample]
        assert np.array_equal(frame.seen, canvas[top : top + height, left : left + width]) and frame.samples == samples
        q = canvas.reshape(-1, 3) >> 6
        assert np.array_equal(frame.counts, np.bincount(q @ [16, 4, 1], minlength=media_gif.BINS))
        if disposal == 2:
            canvas[top : top + height, left : left + width] = colours[9]
        elif disposal == 3:
            canvas = held


def test_a_large_picture_with_a_small_frame(spark):
    """Every size that the format can state: 4 billion samples of ground, frames at two corners."""
    red = picture([(4, 3), (1, 3), (6, 3), (1, 3), (5, 3)], (65533, 65533, 2, 2))
    data = gif([picture([(4, 3), (2, 3), (5, 3)], (0, 0, 1, 1)), red], (65535, 65535))
    rows = spark.createDataFrame([(1, data), (2, gif([picture([(4, 3), (2, 3), (5, 3)], (0, 0, 60000, 60000))], (3000, 3000)))], "doc_id long, gif binary")
    first, second = media_gif.frames(rows.where("doc_id = 1"), "doc_id").orderBy("frame").collect()
    assert first.error is None and first.rgb == bytes([0, 255, 0]) and first.histogram[12] == 1 and first.histogram[0] == 65535**2 - 1
    assert second.error is None and second.rgb == bytes([255, 0, 0] * 4) and (second.histogram[12], second.histogram[48], second.histogram[0]) == (1, 4, 65535**2 - 5)
    (broken,) = media_gif.frames(rows.where("doc_id = 2"), "doc_id").collect()
    assert "larger than its bytes" in broken.error


def test_stored_column_gets_a_free_name(spark):
    stored = media_gif.store_texts(odd_rows(spark))
    assert stored.columns == ["doc_id", "text", "pii", "n_words", "gif", "gif_"] and {r.gif for r in stored.select("gif").collect()} == {"g", None}


def test_interlace_and_local_palette():
    samples = [(4, 3), (0, 3), (1, 3), (2, 4), (3, 4), (5, 4)]
    local = bytes(range(12))
    frame = next(media_gif.decode(gif([picture([(c, w if i < 3 else 3) for i, (c, w) in enumerate(samples[:3])] + [(2, 3), (3, 4), (5, 4)], (0, 0, 1, 4), flags=0xC1, local=local)], (1, 4))))
    assert frame.samples == bytes([0, 2, 1, 3]) and frame.seen[3, 0].tolist() == [9, 10, 11]


def test_media_digests(spark):
    for r in media_gif.media_digests(odd_rows(spark)).collect():
        raw = ((ODD[r.doc_id] if r.doc_id is not None else "b") or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert media_gif.media_digests(odd_rows(spark).limit(0)).count() == 0


def test_gif_columns(spark):
    stored = media_gif.store_texts(odd_rows(spark).drop("gif"))
    frames = media_gif.frames(stored.where("doc_id = 6"), "doc_id").orderBy("frame").collect()
    assert b"".join(f.samples for f in frames).rstrip(b"\0") == ODD[6].encode() and sum(frames[0].histogram) == 64 * 256
    broken = spark.createDataFrame([(1, b"GIF89a"), (2, None), (3, b"no")], "doc_id long, gif binary")
    assert sorted((r.doc_id, r.error is not None) for r in media_gif.frames(broken, "doc_id").collect()) == [(1, True), (3, True)]


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken(tiktoken_encoding):
    coder, rnd = bpe_duckdb._coder(*bpe_duckdb.default_tokenizer()), random.Random(3)
    letters = "ab cé ß\n\t .,!'\"sdtre12345   中\U0001f600\x00\x1c\x85"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    texts += ["", " ", "a" * 5000, " " * 3000, "".join(rnd.choice("abcdef") for _ in range(9000)), "<|endoftext|> it's we'll"]
    ids = coder.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [tiktoken_encoding.encode_ordinary(t) for t in texts]
    assert coder.decode(ids) == [t.encode() for t in texts]


def test_bpe_of_long_texts_equals_tiktoken(tiktoken_encoding):
    coder, rnd = bpe_duckdb.DuckBpe(*bpe_duckdb.default_tokenizer()), random.Random(4)
    some = lambda letters, n: "".join(rnd.choices(letters, k=n))
    texts = [some(letters, n) for letters in ("ab", "acgt", "aA", "=-", "0123456789", string.ascii_lowercase, "aeiournst") for n in (401, 3000, 20_000)]
    texts += ["".join(some(rnd.choice(["ab", "the ", "etaoin", "=#"]), 5) for _ in range(rnd.randrange(90, 250))) for _ in range(60)]
    texts += ["a" * 2_000_000, some(string.ascii_lowercase, 2_000_000), "\n" * 50_000, "é" * 30_000]
    words = [some("etaoinshrdlu", rnd.randrange(2, 9)) for _ in range(5000)]
    texts += [" ".join(rnd.choices(words, k=300_000)), "  ".join(rnd.choices(words, k=100_000))]
    ids = coder.encode(texts)
    for text, got in zip(texts, ids):
        assert np.frombuffer(got, "<u4").tolist() == tiktoken_encoding.encode_ordinary(text)
    assert coder.decode(ids) == [t.encode() for t in texts]


def test_bpe_memory_is_bounded_in_bytes(tiktoken_encoding, monkeypatch):
    """What a worker keeps of long new words stays under its bytes, whatever their number; words that come again are kept."""
    import sys

    monkeypatch.setattr(bpe_duckdb, "CACHE_BYTES", 400_000, raising=False)
    coder, rnd = bpe_duckdb.DuckBpe(*bpe_duckdb.default_tokenizer()), random.Random(5)
    for _ in range(25):
        words = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyzäß", k=rnd.randint(100, 300))) for _ in range(60)]
        text = " ".join(["of zorblatt", *words[:30], "zorblatt,\n  zorblatt"]), " ".join(["x", *words[30:], "zorblatt"])
        assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(list(text))] == [tiktoken_encoding.encode_ordinary(t) for t in text]
        kept = (coder.pieces, coder.spaced, *getattr(coder, "before", ()))
        assert sum(sys.getsizeof(x) for d in kept for pair in d.items() for x in pair) < 600_000  # a batch more than is kept, at most
        assert "zorblatt" in coder.spaced
    assert len(coder.before[1]) > 100


def test_bpe_takes_a_run_from_the_left_when_joins_do_not_settle(tiktoken_encoding, monkeypatch):
    monkeypatch.setattr(bpe_duckdb, "MOST_AROUND", 0)
    monkeypatch.setattr(bpe_duckdb, "WINDOW", 100)
    coder = bpe_duckdb.DuckBpe(*bpe_duckdb.default_tokenizer())
    texts = ["a" * 5000, "ab" * 1000, "".join(random.Random(1).choices("ab=", k=3000))]
    for text, got in zip(texts, coder.encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == tiktoken_encoding.encode_ordinary(text)


def test_bpe_frames(spark, tiktoken_encoding):
    rows = odd_rows(spark)
    both = bpe_duckdb.decode_documents(bpe_duckdb.encode_documents(rows))
    for r in both.collect():
        assert r.ids == tiktoken_encoding.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    for r in bpe_duckdb.token_digests(rows).collect():
        text = (ODD[r.doc_id] if r.doc_id is not None else "b") or ""
        ids = np.array(tiktoken_encoding.encode_ordinary(text), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert bpe_duckdb.token_digests(rows.limit(0)).count() == 0


PII = [
    (1, "mail a.b@c.de now", ["email:5:13"]),
    (2, "x@y.z_w@v.u", ["email:0:5", "email:5:11"]),
    (3, "1.2.3.4.5.6.7.999", ["ip:0:7"]),
    (4, "visa 4111 1111-1111 1111.", ["card:5:24"]),
    (5, "4111111111111112 é +49 (30) 1234-567", ["phone:19:36"]),
    (6, "iban GB82WEST12345698765432 or GB82WEST12345698765433", ["iban:5:27"]),
    (7, "ssn 123-45-6789", ["ssn:4:15"]),
    (8, "no 123-45-6789", []),
    (9, None, []),
    (10, "", []),
    (11, "\U0001f600 a@b.c", ["email:2:7"]),
    (12, "9" * 40000 + " " + "a" * 40000, []),
]


def test_pii_spans(spark):
    rows = spark.createDataFrame([(i, t, "extra") for i, t, _ in PII], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pii.digest(pii.find_pii(rows)).collect()}
    for i, _, spans in PII:
        assert got[i].spans == ",".join(spans)
        base = [s for s in spans if s.split(":")[0] in ("email", "ip", "card", "phone")]
        assert got[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert got[i].n_email == sum(s.startswith("email") for s in spans)
    assert pii.find_pii(rows.limit(0)).count() == 0


def test_pii_redaction_and_scores(spark):
    rows = spark.createDataFrame([(1, "mail a.b@c.de, x", "k"), (2, None, "k"), (3, "a@b.c", "k")], "doc_id long, text string, n_words string")
    assert [tuple(r) for r in pii.redact(rows).orderBy("doc_id").collect()] == [(1, "mail [EMAIL], x", "k"), (2, None, "k"), (3, "[EMAIL]", "k")]
    scores = {r.doc_id: r.s for r in pii.find_pii(rows).where("size(pii) > 0").select("doc_id", F.col("pii")[0]["score"].alias("s")).collect()}
    assert scores[1] > scores[3]


def _prose(rnd, syllables, n):
    return " ".join("".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 3))) for _ in range(n))


def test_language_of_held_out_texts(spark):
    rnd = random.Random(5)
    kinds = {"xx": ["the", "ing", "er", "and"], "yy": ["der", "ung", "ich", "sch"], "zz": ["que", "eau", "é", "les"]}
    rows = [(i, _prose(rnd, kinds[lang], 30) + "\n" + _prose(rnd, kinds["xx"], 5), lang) for i in range(240) for lang in [rnd.choice(list(kinds))]]
    docs = spark.createDataFrame([*rows, (900, None, "xx"), (901, "12 !", "xx"), (902, "", None), (902, "", None), (None, "the and", None)], "doc_id long, text string, lang string")
    model = crf_langid.train(docs, docs.where("doc_id % 3 <> 1"))
    got = crf_langid.predict_language(docs, model).collect()
    held = [r for r in got if r.doc_id is not None and r.doc_id < 900 and r.doc_id % 3 == 1]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    assert [r.lang_pred for r in got if r.doc_id in (900, 901, 902)] == ["und"] * 4
    assert {r.text for r in got} == {r[1] for r in rows} | {None, "12 !", "", "the and"}
    assert crf_langid.predict_language(docs.limit(0), model).count() == 0


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(2)
    scores, transitions = rng.normal(size=(4, 3)), rng.normal(size=(3, 3))
    posterior, pairs = crf_langid._posteriors(scores, np.array([4]), transitions, pairs=True)
    total, expected, edges = 0.0, np.zeros((4, 3)), np.zeros((3, 3))
    for path in np.ndindex(3, 3, 3, 3):
        p = np.exp(sum(scores[t, y] for t, y in enumerate(path)) + sum(transitions[a, b] for a, b in zip(path, path[1:])))
        total += p
        for t, y in enumerate(path):
            expected[t, y] += p
        for a, b in zip(path, path[1:]):
            edges[a, b] += p
    assert np.allclose(posterior, expected / total) and np.allclose(pairs, edges / total)


def test_toxicity_held_out(spark):
    rnd = random.Random(7)
    clean, bad = ["the", "ing", "er", "and", "st", "on"], ["zagrub", "wokkel", "pfinzt"]
    rows, labels = [], []
    for i in range(400):
        words = _prose(rnd, clean, 60).split()
        toxic = int(rnd.random() < 0.3)
        for _ in range(3 * toxic):
            words[rnd.randrange(60)] = rnd.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (None, "the")], "doc_id long, text string")
    model = zstd_toxicity.train(docs, spark.createDataFrame([*labels, (902, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r.score for r in zstd_toxicity.score_toxicity(docs, model, out="score").collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == labels[i][2] for i in held]) > 0.9
    assert got[900] == got[901] < 0.5 and all(0 <= s <= 1 for s in got.values())
    one_label = zstd_toxicity.score_toxicity(docs, zstd_toxicity.fit(["a"], [0]), out="score")
    assert all(r.score < 0.5 for r in one_label.collect())
    assert zstd_toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_toxic_phrases_of_ordinary_words():
    rnd = random.Random(11)
    vocabulary = _prose(rnd, ["the", "ing", "er", "and", "st", "on", "ma", "lo", "vi"], 400).split()
    phrase = [w for w in vocabulary if len(w) > 5][:4]

    def document(toxic):
        words = [rnd.choice(vocabulary) for _ in range(60)]
        for at in (rnd.randrange(25), rnd.randrange(30, 55)) if toxic else ():
            words[at : at + 4] = phrase
        return " ".join(words)

    labels = [int(i % 3 == 0) for i in range(600)]
    texts = [document(y) for y in labels]
    model = zstd_toxicity.fit(texts[:400], labels[:400])
    got = np.array(zstd_toxicity._Scorer(model).scores(texts[400:])) >= 0.5
    assert np.mean(got == np.array(labels[400:])) > 0.9


def plain_lzw(stream, minimum, count):
    """Samples of a code stream, code by code and bit by bit."""
    bits = [b >> i & 1 for b in stream for i in range(8)]
    clear, last, out, at = 1 << minimum, None, b"", 0
    table = [bytes([i]) for i in range(clear)] + [b"", b""]
    while len(out) < count:
        width = max((min(len(table) + (last is not None), 4096) - 1).bit_length(), minimum + 1) if last is not None else minimum + 1
        code = sum(bit << i for i, bit in enumerate(bits[at : at + width]))
        at += width
        if code == clear:
            table, last = table[: clear + 2], None
            continue
        if code == clear + 1:
            break
        word = table[code] if code < len(table) else last + last[:1]
        if last is not None and len(table) < 4096:
            table.append(last + word[:1])
        out, last = out + word, word
    return out[:count]


def test_code_streams_equal_a_plain_decoder():
    rng = random.Random(1)
    texts = [b"", b"a", b"a" * 5000, b"ab" * 3000, *(bytes(rng.randrange(k) for _ in range(n)) for k in (2, 5, 256) for n in (1, 63, 700, 9000))]
    for text in texts:
        stream = media_gif.lzw_encode(text)
        assert media_gif.lzw_decode(stream, 8, len(text)) == plain_lzw(stream, 8, len(text)) == text
        for part in {min(1, len(text)), len(text) // 3, len(text) * 2 // 3}:  # the first samples only
            assert media_gif.lzw_decode(stream, 8, part) == text[:part]
        with pytest.raises(ValueError):
            media_gif.lzw_decode(stream, 8, len(text) + 1)
        if len(text) > 700:
            with pytest.raises(ValueError):
                media_gif.lzw_decode(stream[: len(stream) // 2], 8, len(text))
    with pytest.raises(ValueError):
        media_gif.lzw_decode(bytes([0, 0xFF, 0xFF]), 8, 5)  # a code beyond the table
