"""Fill-in-the-middle texts: two cuts for each document, found by a parallel automaton scan.

A small automaton reads UTF-8 bytes; it tells where a unit (code point, or line) begins and where a marker
ends. A chunk does not know the state in which it is entered, so its scan yields a function: for
each start state the end state, the units begun and the markers met. Functions compose
associatively, so the chunks of a text are scanned side by side and a prefix composition gives each
one its true entry state. A cut after k units is then a selection: the units begun before
each chunk say which chunk holds it, and only that chunk is read again.

Short texts are cut into chunks inside their task. Texts of more than ``giant_bytes`` are put into a table of
their own and dealt as parts over all tasks; a part is one row with its function, and a document's functions (a text of
2 GB has 32,768 of them) meet in one group. The two parts that hold the cuts are cut from the document's own row, so texts are not sent twice.

Cases: null and empty texts are plain, with no units. A byte that is not valid UTF-8 is a
unit of its own. A null doc_id counts as the empty string in the hash; each repeated row gets its own
result; an empty table gives an empty one. Only doc_id and text are read, so other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewell.llm.common import Scratch, partitions, per_bytes, texts

# The markers, and the shares of plain and of suffix-first texts in a hundred.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN_FROM, SPM_BELOW = 90, 20

LANE = 512  # bytes of a chunk inside a task


class Automaton:
    """States 0 to 5: between units, after ``<``, after ``<P`` ``<S`` or ``<M``, and one to three bytes of a code point to come."""

    STATES = 6

    def __init__(self, unit: str = "char"):
        if unit not in ("char", "line"):
            raise ValueError(f"no such unit: {unit}")
        step = np.zeros((self.STATES + 1, 256), np.uint8)
        begins = np.zeros((self.STATES + 1, 256), np.uint8)
        ends = np.zeros((self.STATES + 1, 256), np.uint8)
        for s in range(self.STATES):
            for b in range(256):
                inside = s >= 3 and 0x80 <= b < 0xC0
                if inside:
                    step[s, b] = s - 1 if s > 3 else 0
                elif b >= 0xC0:
                    step[s, b] = 3 + (b >= 0xE0) + (b >= 0xF0)
                elif b == ord("<"):
                    step[s, b] = 1
                elif s == 1 and b in b"PSM":
                    step[s, b] = 2
                ends[s, b] = s == 2 and b == ord(">")
                begins[s, b] = not inside
        if unit == "line":
            # a line begins after a line feed: state 6 is "between lines", and a text starts there
            begins[:] = 0
            begins[6] = 1
            step[6] = step[0]
            step[:, 10] = 6
        else:
            step[6], begins[6] = step[0], begins[0]
        self.start = 6 if unit == "line" else 0
        self.size = self.STATES + 1
        self.step, self.begins, self.ends = step, begins, ends
        self._step, self._add = step.ravel(), (begins.astype(np.int32) | (ends.astype(np.int32) << 16)).ravel()

    def functions(self, data: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(end state, units begun, markers ended) of each lane for each start state; ``data`` is (width, lanes), ``length`` bytes of a lane count."""
        width, lanes = data.shape
        state = np.repeat(np.arange(self.size, dtype=np.int64)[:, None], lanes, axis=1)
        total = np.zeros((self.size, lanes), np.int32)
        order = np.argsort(-length, kind="stable")
        data, left = data[:, order], np.searchsorted(-length[order], -np.arange(width), side="left")
        for i in range(width):
            n = int(left[i])  # lanes that still have a byte stand first
            if not n:
                break
            at = (state[:, :n] << 8) | data[i, :n]
            total[:, :n] += self._add[at]
            state[:, :n] = self._step[at]
        back = np.argsort(order, kind="stable")
        return state[:, back].T, (total & 0xFFFF)[:, back].T.astype(np.int64), (total >> 16)[:, back].T.astype(np.int64)

    def entry_states(self, end: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Entry state of each chunk: functions of the chunks before it in the same text, composed in log2 rounds."""
        before = np.arange(len(text))
        n = len(text)
        f = np.empty_like(end)
        if n:
            f[1:] = end[:-1]
            f[0] = np.arange(self.size)
            first = np.concatenate(([True], text[1:] != text[:-1]))
            f[first] = np.arange(self.size)
            head = np.maximum.accumulate(np.where(first, before, 0))
            reach = 1
            while reach < n and (before - reach >= head).any():
                use = np.flatnonzero(before - reach >= head)
                f[use] = np.take_along_axis(f[use], f[use - reach], axis=1)
                reach *= 2
        return f[:, self.start] if n else np.zeros(0, np.int64)

    def offset(self, piece: bytes, state: int, k: int) -> int:
        """Byte at which unit ``k`` (from 0) of those begun in the piece begins; the piece's length where it has fewer."""
        for i, b in enumerate(piece):
            if self.begins[state, b]:
                if k == 0:
                    return i
                k -= 1
            state = int(self.step[state, b])
        return len(piece)


def lanes_of(raw: list[bytes], width: int = LANE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of all texts side by side as columns, their lengths, and the text of each."""
    size = np.array([len(x) for x in raw], np.int64)
    count = -(-size // width)
    text = np.repeat(np.arange(len(raw)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    length = np.minimum(size[text] - nth * width, width)
    data = np.frombuffer(b"".join(raw) + bytes(width), np.uint8)
    begin = (np.cumsum(size) - size)[text] + nth * width
    return data[begin[None, :] + np.arange(width)[:, None]], length, text


def scan(auto: Automaton, raw: list[bytes], width: int = LANE):
    """Units and markers of each text, and a function (text, k) -> byte offset after k units."""
    data, length, text = lanes_of(raw, width)
    end, units, marks = auto.functions(data, length)
    entry = auto.entry_states(end, text)
    at = np.arange(len(text))
    units, marks = units[at, entry], marks[at, entry]
    n, m = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
    np.add.at(n, text, units)
    np.add.at(m, text, marks)
    begin = np.searchsorted(text, np.arange(len(raw) + 1))
    upto = np.concatenate(([0], np.cumsum(units)))

    def cut(k: int, after: int) -> int:
        a, e = int(begin[k]), int(begin[k + 1])
        if after >= n[k]:
            return len(raw[k])
        lane = int(np.searchsorted(upto[a + 1 : e + 1], upto[a] + after, side="right"))
        piece = raw[k][lane * width : (lane + 1) * width]
        return lane * width + auto.offset(piece, int(entry[a + lane]), int(after - (upto[a + lane] - upto[a])))

    return n, m, cut


def draws(doc_id: int | None) -> tuple[int, int, int, int]:
    """h1 to h4: the first four 8-digit groups of the hash of the document's number."""
    d = hashlib.sha256(b"1:" + (b"" if doc_id is None else str(doc_id).encode())).digest()
    return tuple(int.from_bytes(d[i : i + 4], "big") for i in (0, 4, 8, 12))


def wanted(doc_id: int | None, n: int, has_marker: bool, empty: bool) -> tuple[str, int, int]:
    """(form, units before the first cut, units before the second)."""
    h1, h2, h3, h4 = draws(doc_id)
    if empty or has_marker or h3 % 100 >= PLAIN_FROM:
        return "plain", 0, 0
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return "spm" if h4 % 100 < SPM_BELOW else "psm", a, b


def compose(text: bytes, form: str, a: int, b: int) -> bytes:
    """The training text; ``a`` and ``b`` are byte offsets."""
    if form == "plain":
        return text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if form == "psm":
        return PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle
    return SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle


def restore(output: bytes, form: str) -> bytes:
    """The text that a training text was made of."""
    if form == "plain":
        return output
    head, _, middle = output.rpartition(MIDDLE)
    if form == "psm":
        prefix, _, suffix = head[len(PREFIX) :].partition(SUFFIX)
    else:
        suffix, _, prefix = head[len(SUFFIX) :].partition(PREFIX)
    return prefix + middle + suffix


_FIELDS = "doc_id long, n long, form string, prefix_chars long, middle_chars long"
_KEYS = ["doc_id", "_h1", "_h2"]


def _batch(rows: list[tuple], digest: bool) -> pa.RecordBatch:
    """Rows (doc_id, text, n, form, units a, units b, byte a, byte b) as result rows."""
    ids, ns, forms, before, inside, first, second = [], [], [], [], [], [], []
    for doc_id, text, n, form, ua, ub, a, b in rows:
        ids.append(doc_id), ns.append(n), forms.append(form)
        before.append(None if form == "plain" else ua)
        inside.append(None if form == "plain" else ub - ua)
        out = compose(text, form, a, b)
        first.append(hashlib.sha256(out).hexdigest() if digest else out.decode("utf-8", "replace"))
        if digest:
            second.append(hashlib.sha256(restore(out, form)).hexdigest())
    columns = [pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(forms, pa.string()), pa.array(before, pa.int64()), pa.array(inside, pa.int64()), pa.array(first, pa.string())]
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256" if digest else "output"]
    if digest:
        columns.append(pa.array(second, pa.string()))
        names.append("restored_sha256")
    return pa.RecordBatch.from_arrays(columns, names)


def fill_middle(docs: DataFrame, unit: str = "char", giant_bytes: int = 1 << 16, digest: bool = False) -> DataFrame:
    """Each row's training text (``output``), its form and its cuts; with ``digest`` hashes of the text and of what is restored from it.

    ``n`` counts the units, ``prefix_chars`` and ``middle_chars`` those before and between the cuts.
    """
    schema = _FIELDS + (", output_sha256 string, restored_sha256 string" if digest else ", output string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    auto = Automaton(unit)

    def short(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raw, ids = texts(batch), batch.column("doc_id").to_pylist()
        n, marks, cut = scan(auto, raw)
        out = []
        for k, (doc_id, text) in enumerate(zip(ids, raw, strict=True)):
            form, a, b = wanted(doc_id, int(n[k]), bool(marks[k]), not text)
            out.append((doc_id, text, int(n[k]), form, a, b, *((0, 0) if form == "plain" else (cut(k, a), cut(k, b)))))
        yield _batch(out, digest)

    small = per_bytes(rows.filter(F.octet_length("text") <= giant_bytes), short, schema)
    giants = rows.filter(F.octet_length("text") > giant_bytes).withColumn("_h1", F.xxhash64("text")).withColumn("_h2", F.xxhash64(F.lit(1), "text"))
    table = Scratch(docs.sparkSession, "fill-middle").table(giants, "giants")
    return small.unionByName(_giants(table, auto, giant_bytes, schema, digest))


def _giants(rows: DataFrame, auto: Automaton, size: int, schema: str, digest: bool) -> DataFrame:
    """The same for texts dealt as parts over all tasks."""
    whole = F.encode("text", "utf-8")
    parts = rows.select(*_KEYS, whole.alias("_b"), F.explode(F.sequence(F.lit(0), ((F.octet_length("text") - 1) / size).cast("int"))).alias("part"))
    parts = parts.select(*_KEYS, "part", F.expr(f"substring(_b, part * {size} + 1, {size})").alias("text"))
    parts = parts.repartition(partitions(rows.sparkSession), *_KEYS, "part")

    def functions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raw = texts(batch)
        data, length, text = lanes_of(raw)
        end, units, marks = auto.functions(data, length)
        begin = np.searchsorted(text, np.arange(len(raw) + 1))
        packed = []
        for k in range(len(raw)):
            state = np.arange(auto.size)
            n, m = np.zeros(auto.size, np.int64), np.zeros(auto.size, np.int64)
            for lane in range(int(begin[k]), int(begin[k + 1])):
                n += units[lane, state]
                m += marks[lane, state]
                state = end[lane, state]
            packed.append(np.concatenate((state, n, m)).tolist())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*_KEYS, "part")), pa.array(packed, pa.list_(pa.int64()))], [*_KEYS, "part", "f"])

    summaries = per_bytes(parts, functions, "doc_id long, _h1 long, _h2 long, part int, f array<long>")

    def select(key, group):
        order = np.argsort(group.column("part").to_numpy())
        part = group.column("part").to_numpy()[order]
        f = np.array(group.column("f").to_pylist(), np.int64).reshape(-1, 3, auto.size)[order]
        fresh = np.concatenate(([True], part[1:] != part[:-1]))  # a repeated row brings each part again
        f = f[fresh]
        entry = auto.entry_states(np.ascontiguousarray(f[:, 0]), np.zeros(len(f), np.int64))
        at = np.arange(len(f))
        upto = np.concatenate(([0], np.cumsum(f[at, 1, entry])))
        n, doc_id = int(upto[-1]), key[0].as_py()
        form, a, b = wanted(doc_id, n, bool(f[at, 2, entry].sum()), False)
        found = []
        for after in (a, b):
            p = min(int(np.searchsorted(upto[1:], after, side="right")), len(f) - 1)
            found += [p, int(entry[p]), after - int(upto[p])]
        values = [doc_id, key[1].as_py(), key[2].as_py(), n, form, a, b, *found]
        return pa.table({c: pa.array([v], pa.string() if c == "form" else pa.int64()) for c, v in zip(_CUTS, values, strict=True)})

    cuts = summaries.groupBy(*_KEYS).applyInArrow(select, ", ".join(f"{c} {'string' if c == 'form' else 'long'}" for c in _CUTS))
    cuts = cuts.select(F.col("doc_id").alias("_id"), F.col("_h1").alias("_a1"), F.col("_h2").alias("_a2"), *_CUTS[3:])
    met = rows.join(cuts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h1") == F.col("_a1")) & (F.col("_h2") == F.col("_a2")))
    pieces = [F.expr(f"substring(encode(text, 'utf-8'), {p} * {size} + 1, {size})").alias(f"piece_{p[-1]}") for p in ("part_a", "part_b")]
    met = met.select("doc_id", "text", *_CUTS[3:], *pieces)

    def finish(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for text, r in zip(texts(batch), batch.drop_columns(["text"]).to_pylist(), strict=True):
            a, b = (r[f"part_{x}"] * size + auto.offset(r[f"piece_{x}"], r[f"state_{x}"], r[f"after_{x}"]) for x in "ab")
            out.append((r["doc_id"], text, r["n"], r["form"], r["units_a"], r["units_b"], a, b))
        yield _batch(out, digest)

    return per_bytes(met, finish, schema)


_CUTS = ["doc_id", "_h1", "_h2", "n", "form", "units_a", "units_b", "part_a", "state_a", "after_a", "part_b", "state_b", "after_b"]
