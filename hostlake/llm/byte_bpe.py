"""Operator 2: byte-level BPE by a lazily determinised transducer, and streaming decoding.

Encoding. The rank file's merges are compiled into a trie of tokens. A segmentation is the one BPE makes
exactly when each pair of neighbouring tokens is stable (merging the bytes of the pair again gives the
pair), so a nondeterministic transducer may guess where tokens start and refuse unstable pairs. Its subset
construction has, for every place where a token could still be open, the trie node reached, the token
before that place and the output not yet agreed upon. What all open places agree on is emitted at once; as
no token is longer than the longest one of the vocabulary, the delay is bounded. States and arcs are made
when texts need them, up to a bound; a full table stays, as the first arcs are the most frequent ones, and is emptied
when it has failed for long. Neither changes a result.

Decoding looks tokens up and feeds their bytes to an incremental UTF-8 state machine, which carries a
character that is cut between tokens over to the next one.

Rows: NULL is an empty text and gives no tokens; repeated rows are encoded each for themselves; any other
columns pass through, but a column called like the result is replaced. No row is moved: there is no
shuffle, so neither hot keys nor long texts meet in one task.
"""

from __future__ import annotations

import base64
import codecs
import re
from array import array
from collections.abc import Iterable, Iterator, Sequence
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from hostlake.llm.common import arrow_append, worker_state

#: White space of Unicode, as the splitting pattern understands it.
SPACE = "\t-\r \x85\xa0  -     　"
NO_TOKEN = -1
MAX_ARCS = 1 << 16
#: A full table of arcs is made anew when it has not served for so many times its size.
STALE = 64
#: Chunks remembered in each of two generations; what falls out of both is encoded again.
MAX_PIECES = 3 << 17
#: Bytes before the end of a piece from which on its tokens may wait for the end.
SOON = 64
#: Texts above this many characters are cut into pieces one by one instead of in a list.
LONG_TEXT = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_by_rank(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Plain BPE: the pair of least rank is merged first. For short pieces only."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        options = [(ranks[pair], i) for i in range(len(parts) - 1) if (pair := parts[i] + parts[i + 1]) in ranks]
        if not options:
            break
        _, i = min(options)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """Tokens of a piece of text, emitted as soon as no continuation can change them."""

    def __init__(self, ranks: dict[bytes, int], max_arcs: int = MAX_ARCS):
        self.ranks, self.max_arcs = ranks, max_arcs
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.child: list[dict[int, int]] = [{}]
        self.token = [NO_TOKEN]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                below = self.child[node].get(byte)
                if below is None:
                    below = self.child[node][byte] = len(self.token)
                    self.child.append({})
                    self.token.append(NO_TOKEN)
                node = below
            self.token[node] = rank
        self.stable: dict[int, bool] = {}
        self.edges: tuple[dict[int, list[int]], dict[int, list[int]]] = ({}, {})
        self.reset()

    def reset(self) -> None:
        start = ((0, NO_TOKEN, ()),)
        self.states = [start]
        self.number = {start: 0}
        self.arcs: list[dict[int, tuple]] = [{}]
        self.made = self.missed = 0
        self.asked: set[int] = set()

    def inner(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte."""
        text = self.bytes_of[token]
        if len(text) == 1:
            return None
        below = {t: r for t, r in ((text[i:j], self.ranks.get(text[i:j])) for i in range(len(text)) for j in range(i + 1, len(text) + 1)) if r is not None and t != text}
        halves = merge_by_rank(text, below)
        return (halves[0], halves[1]) if len(halves) == 2 else (NO_TOKEN, NO_TOKEN)

    def edge(self, token: int, side: int) -> list[int]:
        """The tokens that stand at one end (0: left, 1: right) of a token while its bytes are merged."""
        known = self.edges[side].get(token)
        if known is None:
            halves = self.inner(token)
            known = [token] if halves is None else [NO_TOKEN] if NO_TOKEN in halves else [*self.edge(halves[side], side), token]
            self.edges[side][token] = known
        return known

    def pair_is_stable(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both gives just both again. Only what stands at the border can
        interfere, so the merges on either side of it are replayed in the order of their ranks."""
        after = self.edge(right, 0)
        if left == NO_TOKEN:
            return after[-1] != NO_TOKEN
        before = self.edge(left, 1)
        if before[-1] == NO_TOKEN or after[-1] == NO_TOKEN:
            return False
        ranks, bytes_of = self.ranks, self.bytes_of
        i = j = 0
        never = len(self.token)
        while True:
            next_left = before[i + 1] if i + 1 < len(before) else never
            next_right = after[j + 1] if j + 1 < len(after) else never
            across = ranks.get(bytes_of[before[i]] + bytes_of[after[j]], never)
            # Of equal ranks the leftmost is merged first.
            if across < next_left and across <= next_right and across != never:
                return False
            if next_left == never and next_right == never:
                return True
            if next_left <= next_right:
                i += 1
            else:
                j += 1

    def follow(self, open_places: Iterable[tuple], byte: int) -> tuple[list[tuple], tuple[int, ...]]:
        """The open places after one more byte, and what all of them agree upon."""
        after, closed, agree = [], None, True
        child, tokens, known = self.child, self.token, self.stable
        for node, last, pending in open_places:
            below = child[node].get(byte)
            if below is None:
                continue
            if closed is None:
                token = tokens[below]
                if token != NO_TOKEN:
                    stable = known.get(last << 32 | token)
                    if stable is None:
                        if len(known) >= self.max_arcs:
                            known.clear()
                        stable = known[last << 32 | token] = self.pair_is_stable(last, token)
                    if stable:
                        closed = (0, token, (*pending, token))
            if child[below]:  # longer tokens go through this node
                after.append((below, last, pending))
                agree = agree and pending
        after.append(closed)
        if not agree:
            return after, ()
        first, agreed = after[0][2], 0
        shortest = min([len(p) for _, _, p in after])
        while agreed < shortest and all([p[agreed] == first[agreed] for _, _, p in after]):
            agreed += 1
        if agreed:
            after = [(node, last, pending[agreed:]) for node, last, pending in after]
        return after, first[:agreed]

    def arc(self, state: int, byte: int) -> tuple[int, tuple[int, ...], dict]:
        """Makes the arc of a state: the state it leads to, what is emitted on the way, and the arcs there."""
        places, emitted = self.follow(self.states[state], byte)
        target = tuple(places)
        number = self.number.setdefault(target, len(self.states))
        if number == len(self.states):
            self.states.append(target)
            self.arcs.append({})
        made = self.arcs[state][byte] = (number, emitted, self.arcs[number])
        self.made += 1
        return made

    def finish(self, open_places: Iterable[tuple], rest: bytes) -> list[int]:
        """What is still to come of a piece that ends soon. Nothing needs to be agreed upon before the end, so
        outputs are trails that share their beginnings."""
        child, tokens, known = self.child, self.token, self.stable
        places = [(node, last, (None, pending)) for node, last, pending in open_places]
        for byte in rest:
            after, closed = [], None
            for node, last, trail in places:
                below = child[node].get(byte)
                if below is None:
                    continue
                if closed is None:
                    token = tokens[below]
                    if token != NO_TOKEN:
                        stable = known.get(last << 32 | token)
                        if stable is None:
                            if len(known) >= self.max_arcs:
                                known.clear()
                            stable = known[last << 32 | token] = self.pair_is_stable(last, token)
                        if stable:
                            closed = (0, token, (trail, token))
                if child[below]:
                    after.append((below, last, trail))
            after.append(closed)
            places = after
        out, trail = [], places[-1][2]
        while trail[0] is not None:
            trail, token = trail
            out.append(token)
        out.extend(reversed(trail[1]))
        out.reverse()
        return out

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """An arc is made when it is asked for the second time; before that, the open places are followed
        without keeping states, as most rare pieces end soon after they leave the known states."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        if self.missed >= STALE * self.max_arcs:
            self.reset()
        if len(self.asked) >= self.max_arcs:
            self.asked.clear()
        state, out, arcs = 0, [], self.arcs[0]
        for at, byte in enumerate(piece):
            step = arcs.get(byte)
            if step is None:
                key, full = state << 8 | byte, self.made >= self.max_arcs
                if full or key not in self.asked:
                    if full:
                        self.missed += 1
                    else:
                        self.asked.add(key)
                    places = self.states[state]
                    if len(piece) - at <= SOON:
                        return (*out, *self.finish(places, piece[at:]))
                    for byte in piece[at:]:
                        places, emitted = self.follow(places, byte)
                        if emitted:
                            out.extend(emitted)
                    return (*out, *places[-1][2])
                step = self.arc(state, byte)
            state, emitted, arcs = step
            if emitted:
                out.extend(emitted)
        return (*out, *self.states[state][-1][2])


class Encoder(dict):
    """Tokens by chunk: white space and the word after it. The splitting pattern never crosses from a
    word into white space, so chunks can be encoded, and remembered, each for itself. Remembered are the bytes of
    the ids, which take less memory than tuples and are joined without a step for each id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_arcs: int = MAX_ARCS):
        super().__init__()
        self.before: dict[str, bytes] = {}
        self.stops = {".", ","} if pattern == public_tokenizers.PATTERN else set()
        self.transducer = Transducer(ranks, max_arcs)
        self.pieces = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]"))
        self.chunks = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")

    def __missing__(self, chunk: str) -> bytes:
        ids = self.before.get(chunk)
        if ids is None:
            # Most chunks are a word, with or without a stop: the pattern need not be asked.
            word = chunk[1:] if chunk[0] == " " else chunk
            if self.stops and word.isalpha():
                pieces = (chunk,)
            elif word[-1:] in self.stops and word[:-1].isalpha():
                pieces = (chunk[:-1], chunk[-1])
            else:
                pieces = self.pieces.findall(chunk)
            if len(pieces) == 1:
                ids = self.merged(chunk)
            else:
                ids = b"".join([self.get(piece) or self.before.get(piece) or self.keep(piece, self.merged(piece)) for piece in pieces])
        return self.keep(chunk, ids)

    def merged(self, piece: str) -> bytes:
        return array("i", self.transducer.encode(piece.encode())).tobytes()

    def keep(self, chunk: str, ids: bytes) -> bytes:
        if len(chunk) < 64:
            if len(self) >= MAX_PIECES:
                # What was in use since the last time stays within reach; the rest goes.
                self.before = dict(self)
                self.clear()
            self[chunk] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        chunks: Iterable[str] = (
            self.chunks.findall(text) if len(text) <= LONG_TEXT else (m.group() for m in self.chunks.finditer(text))
        )
        return np.frombuffer(b"".join(map(self.__getitem__, chunks)), np.int32)


class StreamDecoder:
    """Text of a stream of tokens; a character cut between two calls comes out with the second."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = np.array([bytes_of.get(k, b"") for k in range(max(bytes_of, default=-1) + 1)], object)
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Sequence[int] | np.ndarray, final: bool = False) -> str:
        found = self.bytes_of[ids].tolist() if len(ids) else ()
        return self.machine.decode(b"".join(found), final)

    def whole(self, ids: np.ndarray, block: int = 1 << 16) -> str:
        """The text of all ids of an array."""
        self.machine.reset()
        parts = [self.feed(ids[at : at + block]) for at in range(0, len(ids), block)]
        return "".join([*parts, self.feed((), final=True)])

    def text(self, ids: Iterable[int], block: int = 1 << 16) -> str:
        self.machine.reset()
        source: Iterator[int] = iter(ids)
        out = []
        while part := list(islice(source, block)):
            out.append(self.feed(part))
        out.append(self.feed((), final=True))
        return "".join(out)


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "ids", without: Sequence[str] = ()) -> DataFrame:
    """docs with the token ids of each whole text as an array of int. The ranks are read on the driver and
    broadcast; their size is that of the vocabulary file."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        encoder = worker_state(("encode", ranks_path, pattern), lambda: Encoder(ranks.value, pattern))
        found = [encoder.encode(t) if t else np.empty(0, np.int32) for t in batch.column(text).to_pylist()]
        return [_id_lists(found)]

    return arrow_append(docs, [T.StructField(out, T.ArrayType(T.IntegerType()))], compute, without)


def code(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "ids", back: str = "decoded", without: Sequence[str] = ()) -> DataFrame:
    """docs with the token ids of each whole text and the text decoded from them, in one pass of one worker."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def coder() -> tuple[Encoder, StreamDecoder]:
        encoder = Encoder(ranks.value, pattern)
        return encoder, StreamDecoder(encoder.transducer.bytes_of)

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        encoder, decoder = worker_state(("code", ranks_path, pattern), coder)
        found = [encoder.encode(t) if t else np.empty(0, np.int32) for t in batch.column(text).to_pylist()]
        return [_id_lists(found), pa.array(map(decoder.whole, found), pa.string())]

    return arrow_append(docs, [T.StructField(out, T.ArrayType(T.IntegerType())), T.StructField(back, T.StringType())], compute, without)


def decode(docs: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded", without: Sequence[str] = ()) -> DataFrame:
    """docs with the text of each array of token ids. NULL ids give an empty text; bytes that are no UTF-8
    become U+FFFD."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        decoder = worker_state(("decode", ranks_path), lambda: StreamDecoder({r: t for t, r in ranks.value.items()}))
        return [pa.array([decoder.text(x or ()) for x in _lists(batch.column(ids))], pa.string())]

    return arrow_append(docs, [T.StructField(out, T.StringType())], compute, without)


def _lists(column: pa.Array) -> Iterator[list[int] | None]:
    ends = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    for i, known in enumerate(column.is_valid().to_pylist()):
        yield values[ends[i] : ends[i + 1]].tolist() if known else None


def _id_lists(found: list[np.ndarray]) -> pa.Array:
    ends = np.zeros(len(found) + 1, np.int32)
    np.cumsum([len(f) for f in found], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.empty(0, np.int32)))
