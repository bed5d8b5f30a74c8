"""Operators over whole tables, against brute force."""

import collections
import hashlib
import math
import random
import re
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from isopleth.llm import bagminhash, link_graph, mixing, pivot_topk, substring_dedup
from isopleth.llm.shingles import multiset, overlap

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_repeats_against_brute_force(spark):
    rnd = random.Random(4)
    for window, shortest in ((6, 2), (3, 2), (5, 5)):
        docs = [(i, " ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 30)))) for i in range(60)]
        docs += [(7, docs[7][1]), (70, docs[3][1]), (71, None), (72, ""), (None, docs[5][1])]
        first = {}
        for i, t in sorted((d for d in docs if d[0] is not None), key=lambda d: d[0]):
            w = WORD.findall(t or "")
            for p in range(len(w) - window + 1):
                first.setdefault(tuple(w[p : p + window]), i)
        expected = []
        for i, t in docs:
            w = WORD.findall(t or "")
            gone = {k for p in range(len(w) - window + 1) if i is not None and first[tuple(w[p : p + window])] < i for k in range(p, p + window)}
            expected.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
        frame = spark.createDataFrame(docs, "doc_id long, text string")
        got = [tuple(r) for r in substring_dedup.remove_repeats(frame, window, shortest).collect()]
        assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert substring_dedup.remove_repeats(frame.limit(0)).count() == 0


def test_levels_double():
    assert substring_dedup.levels(50) == [7, 13, 25, 50] and substring_dedup.levels(100) == [7, 13, 25, 50, 100] and substring_dedup.levels(10) == [10]


def plain_repeats(rows, window=50):
    """{doc_id: (words, removed, digest)} by dictionaries of whole word sequences."""
    first, out = {}, {}
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    for i in sorted(words):
        for at in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][at : at + window]), i)
    for i, ws in words.items():
        gone = set()
        for at in range(len(ws) - window + 1):
            if first[tuple(ws[at : at + window])] < i:
                gone.update(range(at, at + window))
        out[i] = (len(ws), len(gone), hashlib.sha256(" ".join(w for p, w in enumerate(ws) if p not in gone).encode()).hexdigest())
    return out


def test_repeats_of_long_texts_with_clashing_columns(spark):
    """Full length, every level: passages of 50 and 49 words, one of 3,000, within a text of 60,000; one word 5,000 times."""
    rnd = random.Random(11)
    fresh = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    shared, short, passage = fresh(50), fresh(49), fresh(3000)
    texts = [fresh(30_000) + shared + fresh(20_000) + passage + fresh(10_000), fresh(70) + shared + fresh(9) + short, shared[1:] + fresh(5) + passage[500:900], short + fresh(1) + short, ["a"] * 5000, ["b"] + ["a"] * 60, [], passage]
    texts.append(texts[1])
    rows = [(i, " ".join(ws)) for i, ws in enumerate(texts)] + [(90, None)]
    frame = spark.createDataFrame([(i, t, "x", 1, 2, "k", 3) for i, t in rows], "doc_id long, text string, key string, id long, n_words long, kept string, anchors long")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(frame).collect()}
    assert got == plain_repeats(rows)
    assert [got[i][1] for i in range(9)] == [0, 50, 400, 0, 0, 60, 0, 3000, len(texts[1])]


def test_signatures_are_unbiased():
    rng, errors = np.random.default_rng(1), []
    for _ in range(60):
        shared = rng.integers(0, 2**63, rng.integers(5, 40)).astype(np.uint64)
        a = np.repeat(shared, rng.integers(1, 9, len(shared)))
        b = np.concatenate([np.repeat(shared[2:], rng.integers(1, 9, len(shared) - 2)), rng.integers(0, 2**63, 3).astype(np.uint64)])
        one, two = bagminhash.signatures([a, b])
        errors.append((one == two).mean() - overlap(multiset(a), multiset(b)))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def _classes(docs):
    bags, parent = {}, {}
    for i, t in docs:
        if i is not None:
            w = (t or "").split()
            k = min(5, len(w))
            bags.setdefault(i, []).append(collections.Counter(tuple(w[p : p + k]) for p in range(len(w) - k + 1)) if w else None)
            parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(bags)
    for i in ids:
        for j in ids:
            if i < j and any(a and b and sum((a & b).values()) >= 0.8 * sum((a | b).values()) for a in bags[i] for b in bags[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_duplicates_against_brute_force(spark):
    rnd = random.Random(6)
    docs = []
    for base in range(12):
        words = [f"w{rnd.randrange(300)}" for _ in range(rnd.randint(4, 80))]
        for _ in range(rnd.randint(1, 12)):
            copy = words[:]
            for _ in range(rnd.randint(0, 2)):
                copy[rnd.randrange(len(copy))] = f"x{rnd.randrange(10**6)}"
            docs.append((len(docs) * 3, " ".join(copy)))
    docs += [(0, docs[0][1]), (1001, None), (1002, ""), (1003, " "), (1004, "one two"), (1005, "one  two")]
    frame = spark.createDataFrame([*docs, (None, docs[0][1])], "doc_id long, text string")
    got = bagminhash.near_duplicates(frame).collect()
    assert len(got) == len(docs) + 1 and {r.doc_id: r.class_id for r in got if r.doc_id is not None} == _classes(docs)
    kept = [r.doc_id for r in bagminhash.deduplicate(frame.withColumn("class_id", F.lit("x"))).collect()]
    assert sorted(kept, key=repr) == sorted([*set(_classes(docs).values()), None], key=repr)
    assert bagminhash.near_duplicates(frame.limit(0)).count() == 0


def test_one_id_on_different_texts(spark):
    text = lambda name, change="": " ".join(f"{name}{k}" for k in range(60)) + change
    docs = [(9, text("a")), (9, text("b")), (5, text("a", " x")), (7, text("b", " y")), (20, text("c")), (20, text("c")), (21, text("c", " z")), (8, text("d")), (8, text("e")), (8, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in bagminhash.near_duplicates(frame).collect()} == {9: 5, 5: 5, 7: 5, 20: 20, 21: 20, 8: 8}
    kept = sorted(map(tuple, bagminhash.deduplicate(frame.withColumn("form", F.lit(1)).withColumn("copy", F.lit("c"))).select("doc_id", "text").collect()))
    assert kept == sorted([(5, text("a", " x")), (7, text("b", " y")), (20, text("c")), (8, text("d")), (8, text("e")), (8, "")])


def test_blocks_find_links_that_leaders_miss(spark, monkeypatch):
    monkeypatch.setattr(bagminhash, "BLOCK_ROWS", 3)
    texts = [" ".join(f"w{k}" for k in range(i // 5 * 100, i // 5 * 100 + 60)) + f" end{i}" for i in range(20)]
    as_frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    same = {(b, a) for a in range(20) for b in range(a) if a // 5 == b // 5}
    # every member a label of its own; two large labels, of which one holds members of two groups, beside small ones
    for label in (lambda i: i, lambda i: 0 if i < 7 else 19 if i > 12 else i):
        members = spark.createDataFrame([(1, i, label(i)) for i in range(20)], "bucket long, id long, label long")
        got = {(min(r), max(r)) for r in bagminhash._links_in_blocks(members, as_frame, 0.8).collect()}
        want = {(a, b) for a, b in same if label(a) != label(b)}
        assert got <= want and {(label(a), label(b)) for a, b in got} == {(label(a), label(b)) for a, b in want}


def _best(vectors, top=20):
    """(query_id, rank, vec_id, score) by whole numbers; rows are told apart by their place."""
    finite = [(n, i, v) for n, (i, v) in enumerate(vectors) if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    sound = [(n, i, [math.floor(Fraction(x) * 64) for x in v]) for n, i, v in finite]
    out = []
    for n, q, a in sound:
        if q % 20 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for m, i, b in sound if m != n)[:top]
            out += [(q, k, i, max(-(2**63), min(2**63 - 1, -s))) for k, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def test_top_k_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pivot_topk, "CANDIDATE_ROWS", 30)
    monkeypatch.setattr(pivot_topk, "QUERY_ROWS", 3)
    monkeypatch.setattr(pivot_topk, "CHUNK", 25)
    rng = np.random.default_rng(3)
    vectors = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(90)]
    vectors += [(100, None), (120, [1.0, None, 0.0, 0.0]), (140, [float("nan")] * 4), (160, [float("inf")] * 4), (180, [1.0, 2.0]), (None, [1.0] * 4)]
    vectors += [(20, [0.5] * 4), (7, [0.25] * 4), (200, []), *((i, [1.0, 0.0, 0.0, -1.0]) for i in range(300, 360))]
    ask = F.col("vec_id") % 20 == 0
    for sample in (8, 64):
        frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").select("*", F.lit(1).alias("cell"), F.lit(2).alias("rid"))
        assert sorted(map(tuple, pivot_topk.top_k(frame, ask, sample=sample).collect())) == _best(vectors)
    assert pivot_topk.top_k(frame.limit(0), ask).count() == 0 and pivot_topk.top_k(frame.where("vec_id % 20 > 0"), ask).count() == 0
    few = spark.createDataFrame(vectors[:3], "vec_id long, embedding array<float>")
    assert pivot_topk.top_k(few, ask).count() == 2


def test_top_k_of_wide_vectors(spark):
    rng = np.random.default_rng(5)
    sizes = [1.0, 1e6, 1e12, 1e30, 1e300]
    vectors = [(i, (rng.normal(size=6) * sizes[i % 5 if i < 100 else 0]).tolist()) for i in range(160)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, pivot_topk.top_k(frame, F.col("vec_id") % 20 == 0).collect())) == _best(vectors)


URLS = [
    (1, "http://A.example.ORG/es/1?x#y", "a.example.org", "/es/1", "example.org/es/", "block"),
    (2, "https://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
    (3, "https://example.org/en/2#/es/", "example.org", "/en/2", "org/", "allow"),
    (4, "//example.org/es/", "", "", None, "allow"),
    (5, None, "", "", None, "allow"),
    (6, "x://m.com?/de/", "m.com", "", None, None),
    (7, "x://m.com/de/://z", "m.com", "/de/://z", "com/de/", "block"),
    (8, "http://notorg/", "notorg", "/", None, "allow"),
    (9, "http://ÄB.net", "Äb.net", "", None, "allow"),
]


def test_urls_and_rules(spark):
    pages = spark.createDataFrame([(i, u, None) for i, u, *_ in URLS], "page_id long, url string, html string")
    got = {r.page_id: r for r in link_graph.filter_urls(pages).collect()}
    for i, _, host, path, rule, verdict in URLS:
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert verdict is None or got[i].verdict == verdict
    assert link_graph.filter_urls(pages.limit(0)).count() == 0


def _settled(seeds, links):
    """Personalised PageRank as the solution of its equations; mass without a way on returns to the seeds."""
    hosts = list(seeds)
    s = np.array([seeds[h] for h in hosts], float)
    step = np.array([[links.get((a, b), 0) for a in hosts] for b in hosts], float)
    out = step.sum(0)
    step = step / np.where(out, out, 1) + np.outer(s / s.sum(), out == 0)
    return dict(zip(hosts, np.linalg.solve(np.eye(len(s)) - 0.85 * step, 0.15 * s)))


def _propagated(spark, seeds, links):
    as_seeds = spark.createDataFrame([("k", h, float(v)) for h, v in seeds.items()], "kind string, host string, seed double")
    as_edges = spark.createDataFrame([("k", a, b, n) for (a, b), n in links.items()], "kind string, src string, dst string, links long").withColumn("carried", F.col("links"))
    return {r.host: r.mass for r in link_graph.propagate(as_seeds, as_edges).collect()}


def test_propagation_against_matrix(spark):
    rnd, hosts = random.Random(8), [f"h{i}" for i in range(12)]
    links = {(a, b): rnd.randint(1, 5) for a in hosts[:10] for b in rnd.sample(hosts, 3) if a != b}
    seeds = {h: float(i % 3) for i, h in enumerate(hosts)}
    got, want = _propagated(spark, seeds, links), _settled(seeds, links)
    assert np.allclose([got[h] for h in hosts], [want[h] for h in hosts], rtol=1e-4)
    assert set(_propagated(spark, dict.fromkeys(hosts, 0), links).values()) == {0.0}


def test_far_hosts_of_a_chain_beside_a_large_unlinked_mass(spark):
    hops = 52
    seeds = {"bulk": 1e7, "c0": 3.0} | {f"c{i}": 0.0 for i in range(1, hops + 1)} | {"apart": 0.0}
    links = {(f"c{i}", f"c{i + 1}"): 1 for i in range(hops)}
    got, want = _propagated(spark, seeds, links), _settled(seeds, links)
    assert got["apart"] == 0 and all(got[f"c{i}"] > 0 for i in range(hops + 1))
    assert np.allclose([got[h] for h in seeds], [want[h] for h in seeds], rtol=1e-4, atol=0)


def test_domains_above_a_host(spark):
    names = spark.createDataFrame([("a.b.example.com",), ("example.com",), ("com",), ("..",), ("x" * 300 + ".y.z",), ("b.example.com",)], "host string")
    got = {(r.src, r.dst) for r in link_graph.domain_links(names).collect()}
    up = {("a.b.example.com", "b.example.com"), ("b.example.com", "example.com")}
    assert got == up | {(b, a) for a, b in up}


def test_registered_query_blocks_by_propagation(spark, tmp_path):
    rows = [(1, "http://one.shop.com/de/1", None), (2, "http://shop.com/de/2", ""), (3, "http://two.shop.com/en/", "<p>" * 100_000), (4, "http://far.net/", '<a href="http://one.shop.com/x">x</a>'), (5, "http://other.com/fr/", None), (6, "http://sub.other.com/en/", None), (7, "http://alone.net/x", ""), (8, None, None), (8, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *(F.lit("x").alias(c) for c in ("host", "rule", "trust"))).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.rule, r.verdict) for r in entry.queries()["op2_urls"](spark, str(tmp_path)).collect()}
    assert got == {1: ("com/de/", "block"), 2: ("com/de/", "block"), 3: (None, "block"), 4: (None, "block"), 5: ("com/fr/", "allow"), 6: (None, "allow"), 7: (None, "allow"), 8: (None, "allow")}


def test_distrust_flows_back_along_links(spark):
    html = '<a href="http://bad.com/de/1">x</a><a href=\'//ok.org/\'>y</a><a href="/self">z</a>'
    pages = spark.createDataFrame([(1, "http://bad.com/de/1", None), (2, "http://spam.net/", html.split("<a href='")[0] * 3), (3, "http://ok.org/", '<a href="http://fine.net/">f</a>'), (4, "http://fine.net/", "")], "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in link_graph.filter_urls(pages).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow"}
    edges = {(r.src, r.dst): r.links for r in link_graph.host_links(pages.withColumn("html", F.lit(html))).collect()}
    assert edges[("spam.net", "bad.com")] == 1 and edges[("spam.net", "ok.org")] == 1 and ("bad.com", "bad.com") not in edges


def test_mix_shares_and_limits(spark):
    rnd = random.Random(9)
    docs = [(i, " ".join("w" * rnd.randint(0, 50)), None if i % 7 == 0 else f"s{i % 4}") for i in range(300)] + [(5, None, "s1"), (5, "", "s1"), (None, "a b", "s9"), (6, "q q", None), (6, "q q", None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").select("*", F.lit(1).alias("size"), F.lit(1).alias("key"))
    got = mixing.mix(frame).collect()
    assert len(got) == len(docs) and all(0 <= r.taken <= 3 * r.size for r in got)
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    weights = dict(zip([*sorted(s for s in sizes if s), None], [5, 2, 1] * 9))
    left, share, capped = sum(sizes.values()), {}, set()
    while True:
        free = [s for s in sizes if s not in capped]
        share = {s: (left - sum(3 * sizes[c] for c in capped)) * weights[s] / sum(weights[f] for f in free) for s in free} | {s: 3 * sizes[s] for s in capped}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    for s in sizes:
        assert abs(target[s] - share[s]) < 1e-6 and abs(taken[s] - share[s]) <= 5 * mixing.PACKET
    assert sum(taken.values()) == sum(sizes.values())
    again = mixing.mix(frame.repartition(3)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert mixing.mix(frame.limit(0)).count() == 0


def _fair_queueing(docs, packet):
    """(doc_id, size, taken) by sorting all packets of all copies by their finish times."""
    rows = [(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest(), i is not None, i or 0, len((t or "").split()), s, i) for i, t, s in docs]
    weight = dict(zip([*sorted({r[4] for r in rows if r[4] is not None}), None], [5, 2, 1] * 9))
    whole, ahead, packets, taken = collections.Counter(), collections.Counter(), [], collections.Counter()
    for r in rows:
        whole[r[4]] += r[3]
    for n, (*_, size, source, _) in enumerate(rows := sorted(rows, key=lambda r: r[:4])):
        for copy in range(3):
            for first in range(0, size, packet):
                words = min(packet, size - first)
                packets.append(((ahead[source] + copy * whole[source] + first + words) / weight[source], source is None, source or "", n, words))
        ahead[source] += size
    left = sum(whole.values())
    for *_, n, words in sorted(packets):
        taken[n] += min(left, words)
        left -= min(left, words)
    return sorted(((r[5], r[3], taken[n]) for n, r in enumerate(rows)), key=repr)


def test_mix_against_brute_force(spark, monkeypatch):
    rnd = random.Random(11)
    docs = [(i, " ".join("w" * int(rnd.paretovariate(0.6)))[:4000], rnd.choice(["a", "a", "a", "b", None, "c", "ä", "d"])) for i in range(400)] + [(None, "x y z", "b"), (3, "", "zero"), (4, None, "zero"), (9, "p q", "a"), (9, "p q", "a")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    for ranges, rows in ((3, 5), (1024, 4096)):
        monkeypatch.setattr(mixing, "RANGES", ranges)
        monkeypatch.setattr(mixing, "SLICE_ROWS", rows)
        got = sorted(((r.doc_id, r.size, r.taken) for r in mixing.mix(frame).collect()), key=repr)
        assert got == _fair_queueing(docs, mixing.PACKET)
    empty = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixing.mix(empty).collect()] == [(0, 0.0, 0)] * 2


def test_mixed_documents_are_what_mix_takes(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}_{k}" for k in range(i % 9)), "en", f"s{i % 3}", 1) for i in range(60)], "doc_id long, text string, lang string, source string, n_chars long")
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    words = collections.Counter()
    for r in mixing.mixed_documents(docs).collect():
        words[r.doc_id] += len(r.text.split())
    assert all(words[i] == n for i, n in taken.items())


def test_words_of_letters_need_no_slow_pattern(monkeypatch):
    """Only runs that numerals stand in go through the pattern that names every numeral; the words are the same."""
    from isopleth.llm import crf_langid

    texts = ["Ein Wört_und 12 more\n\nlines", "a½b Ⅻ x²y c١d 𝟙z ⅷfoo plain ok\nafter 𐄇 e", "\u0301a \u0903 ß ǅ İ", None, "", "_ __ 7"]
    slow = crf_langid._letters()
    plain = [[words[i : i + crf_langid.SEGMENT] for line in (t or "").lower().split("\n") for words in [slow.findall(line)] for i in range(0, len(words), crf_langid.SEGMENT)] for t in texts]
    assert [crf_langid.sequences(t) for t in texts] == plain
    every = "".join(c + ("a" if i % 3 else "") for i, c in enumerate(map(chr, range(0x11000))) if not 0xD800 <= i < 0xE000)
    assert [w for s in crf_langid.sequences(every) for w in s] == [w for line in every.lower().split("\n") for w in slow.findall(line)]
    monkeypatch.setattr(crf_langid, "_letters", None)
    assert crf_langid.sequences(texts[0]) == plain[0]


def test_running_text_is_compressed_where_it_lies():
    """Windows come as places in one text, and their distances are those of each window by itself."""
    from isopleth.llm import zstd_toxicity as z

    rnd = random.Random(4)
    toxic, ordinary = (z._widen(" ".join(rnd.choice(["grok", "blim", "tarn", "of", "sel"]) for _ in range(900)).encode()) for _ in range(2))
    each = [[rnd.choice([b"grok", b"blim", b"o", b"sel" * 9]) for _ in range(n)] for n in (0, 1, 5, 6, 7, 0, 9000, 13)]
    found = z._run_distances(toxic, ordinary, each)
    for words, got in zip(each, found, strict=True):
        starts = range(0, max(len(words) - z.RUN_WORDS + z.RUN_STRIDE, 1), z.RUN_STRIDE) if words else []
        alone = [z._widen(b" " + b" ".join(words[i : i + z.RUN_WORDS]) + b" ") for i in starts]
        wide, places = z._runs(words)
        assert [wide[a : a + n] for a, n in places.astype(int)] == alone
        by_toxic, by_ordinary = z._compressors(toxic, ordinary)
        assert got.tolist() == [len(by_ordinary.compress(w)) - len(by_toxic.compress(w)) for w in alone]
    assert z._run_distances(toxic, ordinary, []) == [] and z._run_distances(toxic, ordinary, [[]])[0].size == 0
