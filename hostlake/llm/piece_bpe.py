"""Operator 12: SentencePiece encoding and decoding for merge-type vocabularies.

Encoding. A text begins with one word mark (U+2581), and spaces are word marks. All neighbouring symbols whose
concatenation is a piece stand in an agenda ordered by score, then place; the best pair is merged, pairs that it
made stale are passed over when they come up, and its new neighbours join the agenda. What is left are pieces, or
characters that the vocabulary lacks, which are written as byte pieces (or as the unknown piece, where there are none).

The agenda is worked off by chunks. Two characters that are neighbours in no piece are never merged across, so a text
falls apart there: characters of one class (joined, directly or not, by being neighbours in a piece) with the word
marks before them. Order between chunks changes nothing, so chunks are encoded, and remembered, each for itself.

Decoding looks up the bytes of each piece, drops the mark put at the start, and reads the bytes as UTF-8; each
byte that is none becomes U+FFFD.

Check. Each chunk that a worker meets for the first time is also given to the sentencepiece library, all new ones of an
Arrow batch in one call; a text with a chunk that the library encodes differently is marked (`agrees`).

Rows: NULL is an empty text, which has the end id alone; NULL ids decode to an empty text. Repeated rows are encoded
each for themselves, other columns pass through, and columns called like a result are replaced. No row is moved, so
neither hot keys nor long texts meet in one task; a worker holds one Arrow batch and a bounded number of chunks.
"""

from __future__ import annotations

import codecs
import heapq
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from hostlake.llm.common import arrow_append, worker_state

MARK = "▁"
#: A chunk that no merge crosses: the check puts it before chunks.
APART = "\n"
MAX_CHUNKS = 3 << 16
#: Chunks longer than this are not remembered; tokens decoded together.
MEMORABLE = 48
BLOCK = 1 << 16
NO_BYTES = "each-byte"

codecs.register_error(NO_BYTES, lambda e: ("�" * (e.end - e.start), e.end))


def _classes(pieces: Iterable[str]) -> list[str]:
    """Characters that are merged, by what they are merged with: no piece holds characters of two classes, word
    marks apart."""
    root: dict[str, str] = {}

    def find(c: str) -> str:
        while root.setdefault(c, c) != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    for piece in pieces:
        body = piece.replace(MARK, "")
        for a, b in zip(body, body[1:], strict=False):
            root[find(a)] = find(b)
    members: dict[str, list[str]] = defaultdict(list)
    for c in sorted(root):
        members[find(c)].append(c)
    return ["".join(m) for m in members.values()]


class Codec(dict):
    """Pieces of a chunk by chunk, as far as they are remembered."""

    def __init__(self, model: bytes, end: bool = True):
        super().__init__()
        self.library = known = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = known.get_piece_size()
        texts = [known.id_to_piece(k) for k in range(size)]
        special = [known.is_control(k) or known.is_byte(k) or known.is_unknown(k) for k in range(size)]
        self.number = {t: k for k, t in enumerate(texts) if not special[k]}
        self.rank = {t: -known.get_score(k) for t, k in self.number.items()}
        self.unknown = known.unk_id()
        self.bytes = [k for k in range(size) if known.is_byte(k)]
        self.end = (known.eos_id(),) if end else ()
        surface = lambda k: b"" if known.is_control(k) else bytes([int(texts[k][1:-1], 16)]) if known.is_byte(k) else texts[k].replace(MARK, " ").encode()
        self.surface = [surface(k) for k in range(size)]
        self.surface[self.unknown] = " ⁇ ".encode()
        self.control = np.array([known.is_control(k) for k in range(size)])
        self.marked = {k for t, k in self.number.items() if t.startswith(MARK)}
        inner = any(MARK in t.lstrip(MARK) for t in self.number)
        groups = "" if inner else "".join(f"{MARK}*[{re.escape(c)}]+|" for c in sorted(_classes(self.number), key=len, reverse=True))
        #: The alternatives of a vocabulary with marks inside pieces are the whole text.
        self.chunks = re.compile(r".+" if inner else f"{groups}{MARK}*.", re.DOTALL)
        self.before: dict[str, tuple[int, ...]] = {}
        self.fresh: dict[str, tuple[int, ...]] = {}
        self.wrong: set[str] = set()
        self._check_normalizer()

    def _check_normalizer(self) -> None:
        """The normaliser has to leave characters as they are, and to mark the start and spaces."""
        probe = " Aéé  ﬁ\t"
        if self.library.decode(self.library.encode(probe)) != probe or any(self.library.is_unused(k) for k in self.number.values()):
            raise ValueError("only vocabularies of merge type that neither normalise texts nor hold unused pieces")
        for text in ("aa aaa  aaaa", "the theatre"):
            if self.library.encode(text) != list(chain.from_iterable(map(self.merged, self.chunks.findall(self._marked(text))))):
                raise ValueError("not a vocabulary of merge type")

    @staticmethod
    def _marked(text: str) -> str:
        return MARK + text.replace(" ", MARK) if text else ""

    def merged(self, chunk: str) -> tuple[int, ...]:
        """The pieces left when the agenda is empty."""
        size = len(chunk)
        symbols, rank = list(chunk), self.rank
        if size > 1:
            agenda = [(rank[pair], k, k + 1, pair) for k in range(size - 1) if (pair := chunk[k : k + 2]) in rank]
            heapq.heapify(agenda)
            after, before = list(range(1, size + 1)), list(range(-1, size - 1))
            while agenda:
                _, left, right, pair = heapq.heappop(agenda)
                # Stale: one side was merged into something else meanwhile.
                if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != len(pair):
                    continue
                symbols[left], symbols[right] = pair, ""
                further = after[left] = after[right]
                if further < size:
                    before[further] = left
                    if (next_pair := pair + symbols[further]) in rank:
                        heapq.heappush(agenda, (rank[next_pair], left, further, next_pair))
                nearer = before[left]
                if nearer >= 0 and (next_pair := symbols[nearer] + pair) in rank:
                    heapq.heappush(agenda, (rank[next_pair], nearer, left, next_pair))
        number, out = self.number, []
        for symbol in symbols:
            if symbol:
                known = number.get(symbol)
                if known is not None:
                    out.append(known)
                elif self.bytes:
                    out.extend([self.bytes[b] for b in symbol.encode()])
                elif not out or out[-1] != self.unknown:
                    out.append(self.unknown)
        return tuple(out)

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        ids = self.before.get(chunk)
        if ids is None:
            ids = self.fresh[chunk] = self.merged(chunk)
        if len(chunk) <= MEMORABLE:
            if len(self) >= MAX_CHUNKS:
                # What was in use since the last time stays within reach; the rest goes.
                self.before = dict(self)
                self.clear()
            self[chunk] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        marked = self._marked(text)
        parts: Iterable[str] = self.chunks.findall(marked) if len(text) <= BLOCK else (m.group() for m in self.chunks.finditer(marked))
        return np.fromiter(chain(chain.from_iterable(map(self.__getitem__, parts)), self.end), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """Control pieces have no text, but bytes on two sides of one are not read together."""
        stops = np.flatnonzero(self.control[ids])
        own = np.delete(ids, stops)
        ends = [*np.unique(stops - np.arange(len(stops))).tolist(), len(own)]
        surface, start, out = self.surface.__getitem__, 0, []
        for end in ends:
            raw = b"".join([b"".join(map(surface, own[at : min(at + BLOCK, end)].tolist())) for at in range(start, end, BLOCK)])
            out.append((raw[1:] if start == 0 and end and int(own[0]) in self.marked else raw).decode("utf-8", NO_BYTES))
            start = end
        return "".join(out)

    def checked(self) -> bool:
        """Whether the library agrees on all chunks met so far. New ones are given to it behind a character that
        merges with nothing."""
        fresh, self.fresh = self.fresh, {}
        if fresh:
            lead = len(self.library.encode(APART))
            found = self.library.encode([APART + c.replace(MARK, " ") for c in fresh], num_threads=1)
            self.wrong.update(c for (c, ids), known in zip(fresh.items(), found, strict=True) if ids != tuple(known[lead:]))
        return not self.wrong

    def agrees(self, text: str | None) -> bool:
        return not self.wrong.intersection(self.chunks.findall(self._marked(text or "")))


def _codec(model: bytes, end: bool) -> Codec:
    return worker_state(("pieces", hash(model), end), lambda: Codec(model, end))


def _ids(found: list[np.ndarray]) -> pa.Array:
    ends = np.zeros(len(found) + 1, np.int32)
    np.cumsum([len(f) for f in found], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.empty(0, np.int32)))


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    ends = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    for k, known in enumerate(column.is_valid().to_pylist()):
        yield values[ends[k] : ends[k + 1]] if known else values[:0]


def _read(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


IDS = T.StructField("ids", T.ArrayType(T.IntegerType()))
DECODED = T.StructField("decoded", T.StringType())
AGREES = T.StructField("agrees", T.BooleanType())


def code(docs: DataFrame, model_path: str, text: str = "text", end: bool = True, check: bool = True, without: Sequence[str] = ()) -> DataFrame:
    """docs with `ids`, the pieces of each whole text (and the end id), `decoded`, the text of the ids, and, with
    `check`, `agrees`. The model is read on the driver and broadcast; its size is that of the vocabulary file."""
    model = docs.sparkSession.sparkContext.broadcast(_read(model_path))

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        codec = _codec(model.value, end)
        texts = batch.column(text).to_pylist()
        found = [codec.encode(t) if t else np.array(codec.end, np.int32) for t in texts]
        made = [_ids(found), pa.array(map(codec.decode, found), pa.string())]
        if check:
            right = codec.checked()
            made.append(pa.array([right or codec.agrees(t) for t in texts], pa.bool_()))
        codec.fresh.clear()
        return made

    return arrow_append(docs, [IDS, DECODED, AGREES] if check else [IDS, DECODED], compute, without)


def encode(docs: DataFrame, model_path: str, text: str = "text", end: bool = True) -> DataFrame:
    """docs with `ids` alone."""
    model = docs.sparkSession.sparkContext.broadcast(_read(model_path))

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        codec = _codec(model.value, end)
        found = [codec.encode(t) if t else np.array(codec.end, np.int32) for t in batch.column(text).to_pylist()]
        codec.fresh.clear()
        return [_ids(found)]

    return arrow_append(docs, [IDS], compute)


def decode(docs: DataFrame, model_path: str, ids: str = "ids") -> DataFrame:
    """docs with `decoded`, the text of any array of ids."""
    model = docs.sparkSession.sparkContext.broadcast(_read(model_path))

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        codec = _codec(model.value, True)
        return [pa.array(map(codec.decode, _lists(batch.column(ids))), pa.string())]

    return arrow_append(docs, [DECODED], compute)
