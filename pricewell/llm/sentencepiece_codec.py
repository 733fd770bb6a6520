"""SentencePiece encoding and decoding by Viterbi over a shared-prefix trie.

A text is cut into marked words (white space becomes the mark, kept before its word). The distinct marked words of a
slice of rows are sorted, which is a depth-first walk of their trie: going to the next word pops back
to the common prefix, whose forward states are kept, and pushes only the new characters. A forward
state holds the best last piece of the prefix.

Unigram models: the state maximises the sum of piece scores. Models of byte-pair type do not maximise a sum: their result is fixed by
merge order. There the forward pass gives a step from piece a to piece b the score 0 if merging would leave a and b
apart when they stand side by side, and minus infinity otherwise; every prefix then has exactly one path,
which is the model's encoding. Whether two pieces stay apart is settled by merging the two alone, and remembered.

Model files are read here; pieces, scores and types are all that is used. One pass over the rows; nothing
is shuffled, and the table that travels has the size of the model file.

Cases: null encodes as null, empty text as no pieces. Characters that no piece has become byte pieces if the model has
them, else the unknown piece. Texts and words of any length take time in proportion. Ids outside the model are an error when decoding.
"""

from __future__ import annotations

import heapq
import re
import struct
from array import array
from collections.abc import Iterator
from operator import eq
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricewell.llm.common import per_batch

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
WORDS_KEPT = 300_000  # words whose ids a worker remembers
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at : at + n]
        at += n


class Model:
    """Pieces of a model file, with the encoder's memory."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.dummy_prefix, self.escape, self.collapse, self.rules, self.name = UNIGRAM, True, True, True, b"", "identity"
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append((f.get(1, b"").decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                f = dict(_fields(value))
                self.name, self.rules = f.get(1, b"").decode(), f.get(2, b"")
                self.dummy_prefix, self.collapse, self.escape = bool(f.get(3, 1)), bool(f.get(4, 1)), bool(f.get(5, 1))
        if self.rules or not self.escape or self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and byte-pair models without character rules are read")
        self.ids = {p: n for n, (p, _, t) in enumerate(self.pieces) if t in (NORMAL, USER)}
        self.scores = {p: s for p, s, t in self.pieces if t in (NORMAL, USER)}
        self.bytes = {int(p[3:5], 16): n for n, (p, _, t) in enumerate(self.pieces) if t == BYTE}
        self.unknown = next((n for n, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)
        self.longest = max(map(len, self.ids), default=1)
        # lengths, longest first, of the pieces that end with the given last three (two, one) characters of a prefix
        by_end: dict[str, set[int]] = {}
        for p in self.ids:
            by_end.setdefault(p[-3:], set()).add(len(p))
        for c, n in by_end.items():
            n.update(k for k in (1, 2) if k < len(c) and c[-k:] in self.ids)
        self.lengths = {c: tuple(sorted(n, reverse=True)) for c, n in by_end.items()}
        self.parts: dict[str, tuple[str, str] | None] = {}
        self.texts = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else p.replace(MARK, " ").encode() for p, _, t in self.pieces]
        size = np.array([len(t) for t in self.texts], np.int64)
        self.sizes, self.starts, self.blob = size, np.cumsum(size) - size, np.frombuffer(b"".join(self.texts), np.uint8)
        self.lowest = min(self.scores.values(), default=0.0) - 10.0
        self.apart: dict[int, bool] = {}
        self.encoded: dict[str, bytes] = {}

    def __reduce__(self):
        return Model, (self.dump,)

    @classmethod
    def load(cls, path: str) -> Model:
        data = Path(path).read_bytes()
        model = cls(data)
        model.dump = data
        return model

    # -- merging a short string alone

    def merge(self, text: str, last: list[tuple[str, str]] | None = None) -> list[str]:
        """Pieces of one string by merge order: best score first, leftmost of equals.

        ``last``, if given, gets the two parts of each merge.
        """
        n = len(text)
        piece: list[str | None] = list(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(a: int) -> None:
            b = after[a]
            if b < n and (s := self.scores.get(piece[a] + piece[b])) is not None:
                heapq.heappush(heap, (-s, a, piece[a] + piece[b]))

        for a in range(n - 1):
            offer(a)
        while heap:
            _, a, whole = heapq.heappop(heap)
            b = after[a]
            if piece[a] is None or b >= n or piece[a] + piece[b] != whole:
                continue
            if last is not None:
                last.append((piece[a], piece[b]))
            piece[a], piece[b] = whole, None
            after[a] = after[b]
            if after[b] < n:
                before[after[b]] = a
            if before[a] >= 0:
                offer(before[a])
            offer(a)
        return [p for p in piece if p is not None]

    def split(self, piece: str) -> tuple[str, str] | None:
        """The two parts of a piece's last merge, if every merge within it comes before; else None."""
        if piece not in self.parts:
            done: list[tuple[str, str]] = []
            whole = self.merge(piece, done) == [piece]
            scores = [self.scores[a + b] for a, b in done]
            self.parts[piece] = done[-1] if whole and done and all(x > y for x, y in zip(scores, scores[1:], strict=False)) else None
        return self.parts[piece]

    def stay_apart(self, a: str, b: str) -> bool:
        """Whether merging a + b alone ends in a and b.

        Undoes the merges at the border from the last one back: if two parts that once touched there could have
        merged before either grew, the border is not one.
        """
        x, y, limit = a, b, None
        scores = self.scores
        while True:
            s = scores.get(x + y)
            if s is not None and (limit is None or s >= limit):
                return False if limit is None or s > limit else self.merge(a + b) == [a, b]
            if len(x) == 1 and len(y) == 1:
                return True
            if len(y) == 1 or (len(x) > 1 and scores[x] < scores[y]):
                parts = self.split(x)
                if parts is None:
                    return self.merge(a + b) == [a, b]
                limit, x = scores[x], parts[1]
            else:
                parts = self.split(y)
                if parts is None:
                    return self.merge(a + b) == [a, b]
                limit, y = scores[y], parts[0]

    # -- forward passes over the trie of sorted words

    def walk(self, words: list[str]) -> Iterator[list[int]]:
        """Ids of the pieces of each of the sorted words; forward states of a common prefix are computed once.

        A character that no piece has is told as the negative of its code point less one.
        """
        step = self._step_bpe if self.kind == BPE else self._step_unigram
        ids, begins, sums, last = [-1], [0], [0.0], ""  # the forward states, by length of the prefix
        for word in words:
            same = 0
            for x, y in zip(last, word, strict=False):
                if x != y:
                    break
                same += 1
            del ids[same + 1 :], begins[same + 1 :], sums[same + 1 :]
            step(word, same + 1, ids, begins, sums)
            last, at, out = word, len(word), []
            while at:
                out.append(ids[at])
                at = begins[at]
            out.reverse()
            yield out

    def _ends(self, word: str, end: int) -> tuple[int, ...]:
        """Lengths that a piece may have which ends the prefix and whose last three characters no piece has."""
        return self.lengths.get(word[end - 2 : end]) or self.lengths.get(word[end - 1]) or () if end > 1 else ()

    def _step_unigram(self, word: str, first: int, ids: list, begins: list, sums: list) -> None:
        for end in range(first, len(word) + 1):
            best = None
            for n in self.lengths.get(word[end - 3 : end] if end > 3 else word[:end]) or self._ends(word, end):
                k = self.ids.get(word[end - n : end]) if n <= end else None
                if k is not None and (best is None or sums[end - n] + self.pieces[k][1] > best[2]):
                    best = (k, end - n, sums[end - n] + self.pieces[k][1])
            char = word[end - 1]
            if char not in self.scores and (best is None or sums[end - 1] + self.lowest > best[2]):
                best = (-ord(char) - 1, end - 1, sums[end - 1] + self.lowest)
            for states, value in zip((ids, begins, sums), best, strict=True):
                states.append(value)

    def _step_bpe(self, word: str, first: int, ids: list, begins: list, sums: list) -> None:
        known, apart, lengths = self.ids, self.apart, self.lengths
        for end in range(first, len(word) + 1):
            for n in lengths.get(word[end - 3 : end] if end > 3 else word[:end]) or self._ends(word, end):
                begin = end - n
                if begin < 0:
                    continue
                piece = word[begin:end]
                k = known.get(piece)
                if k is None:
                    continue
                if begin:
                    before = ids[begin]
                    if before >= 0:  # nothing merges with a character that no piece has
                        key = before << 24 | k
                        fits = apart.get(key)
                        if fits is None:
                            if len(apart) > 300_000:
                                apart.clear()
                            fits = apart[key] = self.stay_apart(self.pieces[before][0], piece)
                        if not fits:
                            continue
                elif n > 1 and self.merge(piece) != [piece]:
                    continue  # merging would not build it from its own characters
                break
            else:
                k, begin = -ord(word[end - 1]) - 1, end - 1
            ids.append(k)
            begins.append(begin)

    # -- texts

    def marked(self, text: str) -> str:
        if self.collapse:
            text = " ".join(x for x in text.split(" ") if x)
        if not text:
            return ""
        return (MARK if self.dummy_prefix else "") + text.replace(" ", MARK)

    def _ids(self, codes: list[int]) -> bytes:
        """Ids as int32, with byte pieces (or one unknown piece a run) for characters that no piece has."""
        if codes and min(codes) < 0:
            known, codes = codes, []
            for k in known:
                if k >= 0:
                    codes.append(k)
                elif self.bytes:
                    codes += [self.bytes[b] for b in chr(-k - 1).encode()]
                elif not codes or codes[-1] != self.unknown:
                    codes.append(self.unknown)
        return array("i", codes).tobytes()

    def learn(self, words: set[str]) -> None:
        """Encode the words that are not in memory yet, in sorted order."""
        new = sorted(words.difference(self.encoded))
        if len(self.encoded) + len(new) > WORDS_KEPT:
            self.encoded.clear()
            new = sorted(words)
        if self.kind == BPE:
            # runs of marks merge after all else, so a run and the word behind it part
            plain = [w for w in new if not w.startswith(MARK + MARK)]
            for w, codes in zip(plain, self.walk(plain), strict=True):
                self.encoded[w] = self._ids(codes)
            runs = [w for w in new if w.startswith(MARK + MARK)]
            tails = sorted({MARK + w.lstrip(MARK) for w in runs if w.lstrip(MARK)})
            codes = dict(zip(tails, self.walk(tails), strict=True))
            code = lambda p: self.ids.get(p, -ord(p[0]) - 1)
            for w in runs:
                body = w.lstrip(MARK)
                own = codes[MARK + body] if body else [code(MARK)]
                alone = own[0] == code(MARK)
                marks = len(w) - len(body) - (not alone)
                self.encoded[w] = self._ids([code(p) for p in self.merge(MARK * marks)] + (own[1:] if alone else own))
        else:
            for w, codes in zip(new, self.walk(new), strict=True):
                self.encoded[w] = self._ids(codes)

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Ids of each text as int32."""
        cut = [None if t is None else _WORD.findall(self.marked(t)) for t in texts]
        self.learn({w for words in cut if words for w in words})
        return [None if words is None else np.frombuffer(b"".join(map(self.encoded.__getitem__, words)), "<i4") for words in cut]

    def decode(self, ids: list[int] | np.ndarray | None) -> str | None:
        """The text of the ids: byte pieces joined, marks as spaces, control pieces as nothing."""
        if ids is None:
            return None
        text = b"".join(map(self.texts.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids)).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text

    def decode_all(self, rows: list[np.ndarray | None], step: int = 1 << 18) -> list[str | None]:
        """``decode`` of many rows: the pieces' bytes are gathered ``step`` ids at a time."""
        flat = np.concatenate([np.zeros(0, np.int32), *(r for r in rows if r is not None)])
        if len(flat) and flat.min() < 0:
            raise IndexError("an id is outside the model")
        parts, ends = [], [np.zeros(1, np.int64)]
        for at in range(0, len(flat), step):
            k = flat[at : at + step]
            size = self.sizes[k]
            end = np.cumsum(size)
            parts.append(self.blob[np.arange(int(end[-1])) + np.repeat(self.starts[k] - (end - size), size)].tobytes())
            ends.append(ends[-1][-1] + end)
        data, place = b"".join(parts), np.concatenate(ends)
        out, at = [], 0
        for r in rows:
            if r is None:
                out.append(None)
                continue
            text = data[place[at] : place[at + len(r)]].decode("utf-8", "replace")
            at += len(r)
            out.append(text[1:] if self.dummy_prefix and text.startswith(" ") else text)
        return out


_MODELS: dict[str, Model] = {}


def _model(held) -> Model:
    """The worker's model: its memory of words and pairs lasts as long as the worker."""
    data = held.value
    key = f"{len(data)}:{hash(data)}"
    if key not in _MODELS:
        _MODELS.clear()
        model = Model(data)
        model.dump = data
        _MODELS[key] = model
    return _MODELS[key]


def encode(docs: DataFrame, model_path: str = MODEL_PATH, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (all but the text, if None) with ``ids`` and ``n_ids``."""
    held = docs.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())
    carry = [c for c in docs.columns if c not in (text, "ids", "n_ids")] if carry is None else carry

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = _model(held).encode(batch.column(text).to_pylist())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), _lists(ids), pa.array([None if x is None else len(x) for x in ids], pa.int64())], [*carry, "ids", "n_ids"])

    source = docs.select(*dict.fromkeys([*carry, text]))
    kinds = T.StructType([f for c in carry for f in source.schema if f.name == c])
    return per_batch(source, run, kinds.add("ids", T.ArrayType(T.IntegerType())).add("n_ids", T.LongType()), rows=1000)


def _lists(rows: list[np.ndarray | None]) -> pa.Array:
    size = np.array([0 if x is None else len(x) for x in rows], np.int64)
    flat = np.concatenate([x for x in rows if x is not None] or [np.zeros(0, np.int32)])
    offsets = pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32), mask=np.array([x is None for x in rows] + [False]))
    return pa.ListArray.from_arrays(offsets, pa.array(flat.astype(np.int32)))


def decode(rows: DataFrame, model_path: str = MODEL_PATH, ids: str = "ids") -> DataFrame:
    """The columns of ``rows`` with ``decoded``."""
    held = rows.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())
    carry = [c for c in rows.columns if c != "decoded"]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        model = _model(held)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(model.decode_all([None if x is None else np.array(x, np.int32) for x in batch.column(ids).to_pylist()]), pa.string())], [*carry, "decoded"])

    return per_batch(rows.select(*carry), run, rows.select(*carry).schema.add("decoded", T.StringType()), rows=1000)


def encode_round_trip(docs: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """doc_id, ids, n_ids and whether decoding the ids gives the text back."""
    held = docs.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        model, rows = _model(held), batch.column("text").to_pylist()
        ids = model.encode(rows)
        same = list(map(eq, model.decode_all(ids), rows))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(ids), pa.array([None if x is None else len(x) for x in ids], pa.int64()), pa.array(same)], ["doc_id", "ids", "n_ids", "round_trip"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return per_batch(source, run, "doc_id long, ids array<int>, n_ids long, round_trip boolean", rows=1000)
