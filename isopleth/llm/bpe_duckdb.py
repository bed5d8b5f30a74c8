"""Byte-level BPE by DuckDB recursive queries inside each partition.

A text is cut into pieces by the tokenizer's pattern. The distinct pieces that a worker has not met are
laid out as token-position rows; a recursive query joins neighbouring tokens to the merge table and
contracts each piece's leftmost pair of least rank until no pair is left. Decoding joins token-position
rows to the vocabulary and aggregates their bytes in order. Ranks and pattern are those of a public
tokenizer; nothing is trained.

Long texts, pieces and lists of ids are worked on in parts, so that a query's rows are bounded whatever comes.
Tokens are the contraction of their bytes exactly if each two neighbours are the contraction of theirs: until
a first pair crosses two tokens, all is contracted inside them, as it would be beside one neighbour alone. So
the parts of a long piece are contracted apart and joined; where two tokens at a join are not what their bytes
give, the bytes around it are contracted again, and more of them until all joins hold.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import resident, with_field

#: Bytes of encoded pieces kept in a worker, in two generations, and what a dictionary takes for one of them; pairs of tokens kept as judged.
CACHE_BYTES, ENTRY_BYTES, CACHE_PAIRS = 100_000_000, 50, 50_000
#: Bytes of new pieces in one recursive query, characters of text handled at once, tokens decoded at once.
QUERY_BYTES, BATCH_CHARS, DECODE_TOKENS = 110_000, 350_000, 50_000
#: Rows of all steps of a query for long runs.
STATE_ROWS = 1_000_000
#: One contraction a step is quadratic in a piece's bytes; longer pieces are contracted in parts of PART bytes.
LONG_PIECE, PART = 400, 64
#: Tokens on either side of a join that are contracted again, at first and at last; beyond it a piece is taken from the left, WINDOW bytes at a time.
AROUND, MOST_AROUND, WINDOW = 4, 32, 4096

_ENCODE = """
with recursive state(w, p, t, step) as (
  select w, p, t, 0 from pieces
  union all
  (with pairs as (
     select w, p, t, lead(t) over (order by p) as next_t, lead(p) over (order by p) as next_p, lead(w) over (order by p) as next_w from state),
   best as (
     select pairs.w, min(m.id::bigint * 2147483648 + pairs.p) as key, arg_min(pairs.next_p, m.id::bigint * 2147483648 + pairs.p) as gone
     from pairs join merges m on m.l = pairs.t and m.r = pairs.next_t where next_w = pairs.w group by pairs.w)
   select state.w, state.p, case when state.p = key % 2147483648 then (key // 2147483648)::int else state.t end, state.step + 1
   from state join best on state.w = best.w where state.p <> best.gone)),
last as (select w, max(step) as step from state group by w)
select state.w, state.t from state join last using (w, step) order by state.w, state.p
"""

# The same contractions, several a step, for runs of few different pairs. A piece's pairs of least rank are contracted from the left, those that
# overlap ("aaa") every other one, up to the first that makes a pair of yet lower rank with a neighbour: until
# then the least rank stays, so one at a time would take the same pairs in the same order.
_ENCODE_LONG = """
with recursive state(w, p, t, step) as (
  select w, p, t, 0 from pieces
  union all
  (with placed as (
     select w, p, t, lag(t) over o as prior, lead(t) over o as next_t, lead(p) over o as next_p, lead(t, 2) over o as beyond, row_number() over o as n
     from state window o as (partition by w order by p)),
   pairs as (select placed.*, m.id, min(m.id) over (partition by w) as least from placed left join merges m on m.l = placed.t and m.r = placed.next_t),
   equal as (select *, n - row_number() over (partition by w order by n) as run from pairs where id = least),
   apart as (select * from equal qualify row_number() over (partition by w, run order by n) % 2 = 1),
   made as (select w, p, next_p, least, beyond, case when lag(n) over (partition by w order by n) = n - 2 then least else prior end as left_t from apart),
   judged as (
     select made.w, made.p, made.next_p, made.least, coalesce(x.id < made.least, false) or coalesce(y.id < made.least, false) as lower
     from made left join merges x on x.l = made.left_t and x.r = made.least left join merges y on y.l = made.least and y.r = made.beyond),
   taken as (select w, p, next_p, least from judged qualify coalesce(sum(lower::int) over (partition by w order by p rows between unbounded preceding and 1 preceding), 0) = 0)
   select state.w, state.p, coalesce(a.least, state.t), state.step + 1
   from state left join taken a on a.p = state.p left join taken b on b.next_p = state.p
   where b.p is null and state.w in (select w from taken) and state.step < {steps})),
last as (select w, max(step) as step from state group by w)
select state.w, state.p, state.t, step from state join last using (w, step) order by state.w, state.p
"""

#: White space other than a space, beside a space.
_MIXED = re.compile(r"[^\S ](?:(?= )|(?<= [^\S ]))")


def _uneven(text: str) -> bool:
    """Whether a space is beside another white space, or white space at an end."""
    return "  " in text or text[:1].isspace() or text[-1:].isspace() or _MIXED.search(text) is not None


_DECODE = "select w, array_to_string(list(piece order by p), '') as s from tokens join vocab using (id) group by w order by w"


class DuckBpe:
    """Encoder and decoder of one worker process."""

    def __init__(self, path: str, pattern: str, memory: int | None = None) -> None:
        import duckdb
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        self.token = {i: t for t, i in self.ranks.items()}
        # bytes that no token has side by side: no contraction crosses such a place
        self.adjacent = np.zeros((256, 256), bool)
        for token in self.ranks:
            self.adjacent[list(token[:-1]), list(token[1:])] = True
        self.holds: dict[tuple[int, int], bool] = {}
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        # pieces, and words that follow a space; those of the generation before are taken over when they come again
        self.pieces: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        self.before: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.held, self.memory = 0, memory or CACHE_BYTES
        self.long: list[str] = []
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "200MB", "temp_directory": ""})
        # a pair merges when its joined bytes are a token: every split of a token into two tokens
        splits = array("i")
        for token, i in self.ranks.items():
            for k in range(1, len(token)):
                if (a := self.ranks.get(token[:k])) is not None and (b := self.ranks.get(token[k:])) is not None:
                    splits.extend((a, b, i))
        merges = pa.table(dict(zip("lri", np.frombuffer(splits, np.int32).reshape(-1, 3).T.copy())))
        vocab = pa.table({"id": pa.array(list(self.ranks.values()), pa.int32()), "piece": [t.decode("latin-1") for t in self.ranks]})
        for name, rows in (("merges_in", merges), ("vocab_in", vocab)):
            self.db.register(name, rows)
        self.db.execute("create table merges as select l, r, i as id from merges_in")
        self.db.execute("create table vocab as select * from vocab_in")
        for name in ("merges_in", "vocab_in"):
            self.db.unregister(name)

    def _contract(self, pieces: list[bytes], query: str) -> list[bytes]:
        """Token ids of each piece, as little-endian unsigned 32-bit integers."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        tokens = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        found = {"w": np.repeat(np.arange(len(pieces), dtype=np.int32), lengths), "p": np.arange(len(tokens), dtype=np.int32), "t": tokens}
        while True:
            # a query keeps the rows of all its steps, so a long one goes on where the last one stopped
            steps = max(1, STATE_ROWS // max(1, len(found["w"])))
            self.db.register("pieces", pa.table({c: found[c] for c in "wpt"}))
            found = self.db.execute(query.format(steps=steps)).fetchnumpy()
            if "step" not in found or found["step"].max(initial=0) < steps:
                break
        ids, cuts = found["t"].astype("<u4").tobytes(), np.searchsorted(found["w"], np.arange(len(pieces) + 1)) * 4
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def _batched(self, pieces: list[bytes], query: str) -> list[bytes]:
        """_contract of any number of pieces, about QUERY_BYTES a query."""
        out: list[bytes] = []
        some: list[bytes] = []
        size = 0
        for piece in pieces:
            some.append(piece)
            size += len(piece)
            if size >= QUERY_BYTES:
                out += self._contract(some, query)
                some, size = [], 0
        return out + (self._contract(some, query) if some else [])

    def _ids(self, contracted: bytes) -> list[int]:
        return np.frombuffer(contracted, "<u4").tolist()

    def _raw(self, ids: list[int]) -> bytes:
        return b"".join([self.token[i] for i in ids])

    def _check(self, pairs: set[tuple[int, int]]) -> None:
        """Learn of pairs of tokens whether they are what their bytes give."""
        if len(self.holds) > CACHE_PAIRS:
            self.holds.clear()
        new = [p for p in pairs if p not in self.holds]
        for pair, got in zip(new, self._batched([self._raw(list(p)) for p in new], _ENCODE)):
            self.holds[pair] = self._ids(got) == list(pair)

    def _run(self, raw: bytes) -> list[int]:
        """Tokens of a long run from the left: a window's last tokens are left to the next one, more of them while a join does not hold."""
        done: list[int] = []
        at, left, width = 0, 2 * AROUND, WINDOW
        while at < len(raw):
            last = at + width >= len(raw)
            ids = self._ids(self._contract([raw[at : at + width]], _ENCODE_LONG)[0])
            kept = ids if last else ids[: max(1, len(ids) - 2 * AROUND)]
            if done:
                self._check({(done[-1], kept[0])})
            if done and not self.holds[done[-1], kept[0]]:
                back = done[-left:]
                del done[-left:]
                at -= len(self._raw(back))
                left, width = 2 * left, width + len(self._raw(back))
                continue
            done += kept
            at += len(self._raw(kept))
            left, width = 2 * AROUND, WINDOW
        return done

    def _long(self, raw: bytes) -> bytes:
        """Token ids of a long piece."""
        flat = np.frombuffer(raw, np.uint8)
        cuts = [0, *(np.flatnonzero(~self.adjacent[flat[:-1], flat[1:]]) + 1).tolist(), len(raw)]
        segments = [(a, b) for a, b in zip(cuts, cuts[1:])]
        parts = [(n, raw[at : min(at + PART, b)]) for n, (a, b) in enumerate(segments) for at in range(a, b, PART)]
        # tokens of each segment as runs of ids; a join lies between two runs
        runs: list[list[list[int]]] = [[] for _ in segments]
        distinct = list({p for _, p in parts})
        known = dict(zip(distinct, self._batched(distinct, _ENCODE)))
        for n, part in parts:
            runs[n].append(self._ids(known[part]))
        around, open_ = AROUND, [n for n, r in enumerate(runs) if len(r) > 1]
        while open_:
            self._check({(x[-1], y[0]) for n in open_ for x, y in zip(runs[n], runs[n][1:])})
            broken = []
            for n in open_:
                joined = [runs[n][0]]
                for run in runs[n][1:]:
                    if self.holds[joined[-1][-1], run[0]]:
                        joined[-1].extend(run)
                    else:
                        joined.append(run)
                runs[n] = joined
                if len(joined) > 1:
                    broken.append(n)
            if around > MOST_AROUND:
                for n in broken:
                    runs[n] = [self._run(raw[segments[n][0] : segments[n][1]])]
                break
            # what lies around each join becomes a run of its own; the joins to its left and right are judged next
            windows: list[tuple[int, int]] = []
            for n in broken:
                left, *rest = runs[n]
                cut: list[list[int]] = []
                for right in rest:
                    held, taken = left[: max(0, len(left) - around)], left[max(0, len(left) - around) :]
                    if held:
                        cut.append(held)
                    windows.append((n, len(cut)))
                    cut.append(taken + right[:around])
                    left = right[around:]
                if left:
                    cut.append(left)
                runs[n] = cut
            again = self._batched([self._raw(runs[n][i]) for n, i in windows], _ENCODE)
            for (n, i), got in zip(windows, again):
                runs[n][i] = self._ids(got)
            around, open_ = 2 * around, [n for n in broken if len(runs[n]) > 1]
        return np.array([i for r in runs for run in r for i in run], "<u4").tobytes()

    def _learn(self, pieces: Iterable[str]) -> None:
        short: list[str] = []
        for piece in pieces:
            raw = piece.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                self.pieces[piece] = whole.to_bytes(4, "little")
            elif len(raw) > LONG_PIECE:
                self.pieces[piece] = self._long(raw)
                self.long.append(piece)
            else:
                short.append(piece)
        self.pieces.update(zip(short, self._batched([x.encode() for x in short], _ENCODE)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; parts of texts are looked up together, about BATCH_CHARS at once."""
        out: list[list[bytes]] = [[] for _ in texts]
        some: list[tuple[int, str]] = []
        size = 0
        for n, text in enumerate(texts):
            for part in _parts(text):
                some.append((n, part))
                size += len(part)
                if size >= BATCH_CHARS:
                    for (m, _), ids in zip(some, self._encode([x for _, x in some])):
                        out[m].append(ids)
                    some, size = [], 0
        for (m, _), ids in zip(some, self._encode([x for _, x in some])):
            out[m].append(ids)
        return [b"".join(ids) for ids in out]

    def _encode(self, texts: list[str]) -> list[bytes]:
        """A text is first cut where one space parts two words: no piece spans such a place, so a word is looked up
        whole, as what follows a space. A text with other spacing at its cuts goes through the pattern as a whole.
        """
        if self.held > self.memory // 2:
            self.before, self.pieces, self.spaced, self.held = (self.pieces, self.spaced), {}, {}, 0
        # a plan is what is looked up among pieces, then what is looked up among words that follow a space
        plans: list[tuple[list[str], list[str]]] = []
        for text in texts:
            if _uneven(text):
                plans.append((self.pattern.findall(text), []))
            else:
                first, *words = text.split(" ")
                plans.append((self.pattern.findall(first), words))
        old_pieces, old_spaced = self.before
        words = set().union(*[plan for _, plan in plans]).difference(self.spaced)
        again = words & old_spaced.keys()
        self.spaced.update((x, old_spaced[x]) for x in again)
        cut = {x: self.pattern.findall(" " + x) for x in words - again}
        needed = set().union(*[plan for plan, _ in plans])
        pieces = needed.union(*cut.values()).difference(self.pieces)
        self.pieces.update((y, old_pieces[y]) for y in pieces & old_pieces.keys())
        self._learn(pieces.difference(self.pieces))
        for x, ys in cut.items():
            self.spaced[x] = b"".join([self.pieces[y] for y in ys])
        for ys in cut.values():
            if len(ys) == 1 and ys[0] not in needed:  # kept once
                self.pieces.pop(ys[0], None)
        piece, spaced = self.pieces.__getitem__, self.spaced.__getitem__
        found = [b"".join(map(piece, head)) + b"".join(map(spaced, rest)) for head, rest in plans]
        for x in [x for x in words if len(x) > LONG_PIECE]:  # not kept
            del self.spaced[x]
        for y in self.long:
            self.pieces.pop(y, None)
        self.long.clear()
        for new, kept in ((words, self.spaced), (pieces, self.pieces)):
            new = [x for x in new if x in kept]
            self.held += len(new) * ENTRY_BYTES + sum(map(sys.getsizeof, new)) + sum(map(sys.getsizeof, map(kept.__getitem__, new)))
        return found

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """Bytes of each list of ids; lists are cut into runs of DECODE_TOKENS at most."""
        out: list[list[bytes]] = [[] for _ in ids]
        some: list[tuple[int, bytes]] = []
        size = 0

        def flush() -> None:
            tokens = np.frombuffer(b"".join([run for _, run in some]), "<u4").astype(np.int32)
            lengths = np.fromiter((len(run) // 4 for _, run in some), np.int64, len(some))
            rows = pa.table({"w": np.repeat(np.arange(len(some), dtype=np.int32), lengths), "p": np.arange(len(tokens), dtype=np.int32), "id": tokens})
            self.db.register("tokens", rows)
            found = self.db.execute(_DECODE).fetchnumpy()
            for w, s in zip(found["w"].tolist(), found["s"].tolist()):
                out[some[w][0]].append(s.encode("latin-1"))

        for n, whole in enumerate(ids):
            for at in range(0, len(whole), 4 * DECODE_TOKENS):
                some.append((n, whole[at : at + 4 * DECODE_TOKENS]))
                size += len(some[-1][1]) // 4
                if size >= DECODE_TOKENS:
                    flush()
                    some, size = [], 0
        if some:
            flush()
        return [b"".join(runs) for runs in out]


def _parts(text: str) -> Iterator[str]:
    """A text in parts of BATCH_CHARS and the rest of a word, each but the first from a space between two words on; no piece spans such a place."""
    at = 0
    while len(text) - at > BATCH_CHARS:
        cut = text.find(" ", at + BATCH_CHARS)
        while 0 <= cut < len(text) - 1 and (text[cut - 1].isspace() or text[cut + 1].isspace()):
            cut = text.find(" ", cut + 1)
        if not 0 <= cut < len(text) - 1:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def _coder(path: str, pattern: str, memory: int | None = None) -> DuckBpe:
    return resident(("bpe", path, pattern, memory), lambda: DuckBpe(path, pattern, memory))


def default_tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _chunks(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of bounded size, each with its first index; null is the empty text."""
    start, some, size = 0, [], 0
    for i, text in enumerate(texts):
        some.append(text.as_py() or "")
        size += len(some[-1])
        if size > BATCH_CHARS:
            yield start, some
            start, some, size = i + 1, [], 0
    if some:
        yield start, some


def encode_documents(df: DataFrame, text: str = "text", out: str = "ids", tokenizer: tuple[str, str] | None = None) -> DataFrame:
    """`df` with a column of token ids (array of int) of every whole text; null and empty texts give no ids.

    Rows, their order and other columns stay as they are; `out` must not name one of them. No row limit,
    shuffle or state beyond a worker's bounded memory of pieces.
    """
    path, pattern = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, pattern)
        for batch in batches:
            for start, texts in _chunks(batch.column(text)):
                ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in coder.encode(texts)]
                part = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32()))], [*part.schema.names, out])

    return df.mapInArrow(run, with_field(df, out, T.ArrayType(T.IntegerType())))


def decode_documents(df: DataFrame, ids: str = "ids", out: str = "decoded", tokenizer: tuple[str, str] | None = None) -> DataFrame:
    """`df` with a binary column of the bytes that the ids stand for; null and empty lists give no bytes.

    An id outside the vocabulary stands for no bytes.
    """
    path, pattern = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, pattern)
        for batch in batches:
            lists = [np.array([i for i in x or [] if i is not None], "<u4").tobytes() for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(coder.decode(lists), pa.binary())], [*batch.schema.names, out])

    return df.mapInArrow(run, with_field(df, out, T.BinaryType()))


def token_digests(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: tuple[str, str] | None = None, memory: int | None = None) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every row: encode, decode the ids, digest both, in one pass.

    Null texts count as empty; repeated rows give repeated results; an empty table gives no rows. memory: bytes
    of pieces that a worker keeps, CACHE_BYTES if not given; with fewer, more pieces are encoded again.
    """
    path, pattern = tokenizer or default_tokenizer()
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, pattern, memory)
        for batch in batches:
            for start, texts in _chunks(batch.column(text)):
                ids = coder.encode(texts)
                whole = coder.decode(ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(key).slice(start, len(texts)),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                        pa.array([hashlib.sha256(x).hexdigest() for x in whole]),
                    ],
                    [key, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
