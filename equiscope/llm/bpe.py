"""Byte-level BPE as a lazily determinised transducer, and a streaming decoder.

**Encoding.** A token sequence is what the merges make of its bytes exactly
when the merges, run on each two neighbours alone, leave that pair as it is.
So encoding is a walk through a non-deterministic machine: a hypothesis holds
the last finished token and the vocabulary-trie node of the bytes since; at a
node that is a token, it may finish that token if the pair of neighbours is
stable. Every prefix of the input has one finished sequence, so the set of
hypotheses after a byte is a state of a deterministic transducer whose step
marks the token finished there. States and steps are made when first met and
kept. What lies before the point where the sequences of all live hypotheses
part is certain and is emitted; a hypothesis lives no longer than the longest
token, so the lookahead is bounded. Tables are bounded: when ``MAX_STATES``
states are held, all are forgotten and made anew as needed.

**Decoding.** The UTF-8 machine's state is the bytes of an unfinished
character, held between runs of tokens. A run without ill-formed bytes is
taken at once; else the machine walks it byte by byte, and ill-formed bytes
become U+FFFD, one for each maximal ill-formed part, as usual.

Both run in ``mapInArrow``: no shuffle, one document at a time.
"""

from __future__ import annotations

import base64
import itertools
import math
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MAX_STATES = 200_000
MAX_PAIRS = 500_000
MAX_PIECES = 400_000  # in each of the two generations of the piece memo
OUT_TOKENS = 1 << 20  # an output batch is closed after about so many tokens


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id of a rank file (base64 bytes and the id, one token a line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The definition: merge the adjacent pair of least rank, the leftmost first, as long as there is one."""
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            break
        _, i = min(found)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """Bytes of one piece -> token ids."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES, window: int = 4096):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"a byte-level vocabulary has all single bytes; missing: {missing[:5]}")
        self.ranks, self.max_states, self.window = ranks, max_states, window
        self.bytes_of = {t: b for b, t in ranks.items()}
        self.length = {t: len(b) for b, t in ranks.items()}
        self.ids = max(self.bytes_of) + 2  # a hypothesis is the number node * ids + last token + 1
        self.child: dict[int, int] = {}  # trie: node * 256 + byte -> node
        self.token, self.depth = [-1], [0]
        for word, t in ranks.items():
            node = 0
            for b in word:
                key = node << 8 | b
                above, node = node, self.child.get(key, 0)
                if not node:
                    node = self.child[key] = len(self.token)
                    self.token.append(-1)
                    self.depth.append(self.depth[above] + 1)
            self.token[node] = t
        self.inner = {key >> 8 for key in self.child}
        #: tokens that the merges don't make of their own bytes; only a whole piece becomes one of them
        self.odd = {w: t for w, t in ranks.items() if merge_bytes(w, ranks) != [t]}
        self.never = set(self.odd.values())
        self.stable: dict[int, bool] = {}
        self.histories: dict[int, list[tuple[float, bytes, bytes]]] = {}  # one a token at most
        self._forget()

    def _forget(self) -> None:
        self.number: dict[tuple[int, ...], int] = {}
        self.states: list[tuple[int, ...]] = []
        self.step: dict[int, tuple[int, int]] = {}
        self._numbered((0,))

    def _numbered(self, state: tuple[int, ...]) -> int:
        n = self.number.get(state)
        if n is None:
            n = self.number[state] = len(self.states)
            self.states.append(state)
        return n

    def _own(self, token: bytes) -> bytes:
        """The vocabulary's object of these bytes, so that histories hold no copies."""
        return self.bytes_of[self.ranks[token]]

    def _history(self, t: int) -> list[tuple[float, bytes, bytes]]:
        """The merges of a token's own bytes: before each, its rank and the first and last part; at the end infinity."""
        found = self.histories.get(t)
        if found is None:
            found, word = [], self.bytes_of[t]
            parts = [word[i:i + 1] for i in range(len(word))]
            while len(parts) > 1:
                r, i = min((self.ranks[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in self.ranks)
                found.append((r, self._own(parts[0]), self._own(parts[-1])))
                parts[i:i + 2] = [parts[i] + parts[i + 1]]
            found.append((math.inf, word, word))
            self.histories[t] = found
        return found

    def _pair_stable(self, a: int, b: int) -> bool:
        """Whether the merges of both tokens' bytes give both back: each side goes its own way until a merge across the border has its turn."""
        known = self.stable.get(a * self.ids + b)
        if known is None:
            if len(self.stable) > MAX_PAIRS:
                self.stable.clear()
            before, after = iter(self._history(a)), iter(self._history(b))
            (left, _, last), (right, first, _) = next(before), next(after)
            while True:
                across = self.ranks.get(last + first)
                if across is not None and across < left and across <= right:  # of equal ranks the leftmost merges first
                    known = False
                    break
                if left == right == math.inf:
                    known = True
                    break
                if left <= right:
                    left, _, last = next(before)
                else:
                    right, first, _ = next(after)
            self.stable[a * self.ids + b] = known
        return known

    def _new_step(self, n: int, byte: int) -> tuple[int, int]:
        """The state after ``byte``, and the one token that is finished there by a stable sequence."""
        ids, live, finished = self.ids, [], -1
        for hypothesis in self.states[n]:
            node, last = divmod(hypothesis, ids)
            node = self.child.get(node << 8 | byte)
            if node is None:
                continue
            if node in self.inner:
                live.append(node * ids + last)
            t = self.token[node]
            if finished < 0 <= t and t not in self.never and (last == 0 or self._pair_stable(last - 1, t)):
                finished = t
        if finished < 0:
            raise ValueError("the vocabulary is not closed under its merges")
        live.append(finished + 1)
        if len(self.states) >= self.max_states:
            self._forget()
            return self._numbered(tuple(live)), finished
        found = self.step[n << 8 | byte] = (self._numbered(tuple(live)), finished)
        return found

    def _back(self, marks: list[int], to: int) -> list[int]:
        """The tokens of the stable sequence that ends at ``to``."""
        out = []
        while to:
            out.append(marks[to - 1])
            to -= self.length[out[-1]]
        return out[::-1]

    def _settled(self, marks: list[int], n: int) -> int:
        """Where the sequences of all live hypotheses part: what lies before is certain."""
        starts = {len(marks) - self.depth[h // self.ids] for h in self.states[n]}
        while len(starts) > 1:
            late = max(starts)
            starts.remove(late)
            starts.add(late - self.length[marks[late - 1]])
        return starts.pop()

    def encode(self, piece: bytes) -> list[int]:
        if piece in self.odd:
            return [self.odd[piece]]
        marks: list[int] = []
        if len(piece) <= self.window:
            self._run(0, piece, marks)
            return self._back(marks, len(marks))
        n, out = 0, []
        for i in range(0, len(piece), self.window):
            n = self._run(n, piece[i:i + self.window], marks)
            at = self._settled(marks, n)
            out += self._back(marks, at)
            del marks[:at]
        return out + self._back(marks, len(marks))

    def _run(self, n: int, piece: bytes, marks: list[int]) -> int:
        step = self.step
        for b in piece:
            found = step.get(n << 8 | b)
            if found is None:
                found = self._new_step(n, b)
                step = self.step
            n, t = found
            marks.append(t)
        return n


class Pieces(dict):
    """Piece -> its ids as little-endian int32 bytes, made when first asked for; two bounded generations."""

    def __init__(self, machine: Transducer, most: int):
        super().__init__()
        self.machine, self.most, self.old = machine, most, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = array("i", self.machine.encode(piece.encode())).tobytes()
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Whole texts -> ids: each match of the pattern on its own, with a bounded memo of pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_pieces: int = MAX_PIECES):
        import regex

        self.pattern, self.machine = regex.compile(pattern), Transducer(ranks)
        self.pieces = Pieces(self.machine, max_pieces)

    def encode(self, text: str) -> bytes:
        """All ids as int32 bytes. The matches of a very long text are taken in runs, never as one list."""
        of = self.pieces.__getitem__
        if len(text) <= 1 << 20:
            return b"".join(map(of, self.pattern.findall(text)))
        matches = self.pattern.finditer(text)
        return b"".join(b"".join(of(m.group()) for m in block) for block in iter(lambda: list(itertools.islice(matches, 1 << 16)), []))


#: The UTF-8 machine: lead bytes -> allowed second bytes and length (fixed values of the encoding).
_LEADS = [(0xC2, 0xDF, 0x80, 0xBF, 2), (0xE0, 0xE0, 0xA0, 0xBF, 3), (0xE1, 0xEC, 0x80, 0xBF, 3), (0xED, 0xED, 0x80, 0x9F, 3),
          (0xEE, 0xEF, 0x80, 0xBF, 3), (0xF0, 0xF0, 0x90, 0xBF, 4), (0xF1, 0xF3, 0x80, 0xBF, 4), (0xF4, 0xF4, 0x80, 0x8F, 4)]
_LEAD = {b: (lo, hi, n) for first, last, lo, hi, n in _LEADS for b in range(first, last + 1)}


def utf8_step(held: bytes, byte: int) -> tuple[bytes, str]:
    """One byte into the machine: the bytes of the unfinished character after it, and the text that it completes."""
    if held:
        lo, hi, n = _LEAD[held[0]]
        if len(held) > 1:
            lo, hi = 0x80, 0xBF
        if lo <= byte <= hi:
            held += bytes([byte])
            return (b"", held.decode()) if len(held) == n else (held, "")
        again, text = utf8_step(b"", byte)
        return again, "�" + text
    if byte < 0x80:
        return b"", chr(byte)
    return (bytes([byte]), "") if byte in _LEAD else (b"", "�")


def utf8_walk(held: bytes, data: bytes) -> tuple[bytes, str]:
    out = []
    for b in data:
        held, s = utf8_step(held, b)
        out.append(s)
    return held, "".join(out)


class Decoder:
    """Token ids -> text, in a stream: ``feed`` gives what is complete, ``finish`` what an unfinished character leaves."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self.held = b""

    def feed(self, ids: Iterable[int]) -> str:
        raw = self.held + b"".join(map(self.bytes_of.__getitem__, ids))
        cut = len(raw)
        for back in range(1, min(3, len(raw)) + 1):  # an unfinished character at the end is held
            if raw[-back] in _LEAD and utf8_walk(b"", raw[-back:]) == (raw[-back:], ""):
                cut -= back
                break
        try:
            text, self.held = raw[:cut].decode(), raw[cut:]
            return text
        except UnicodeDecodeError:  # ill-formed somewhere: the machine walks byte by byte
            self.held, text = utf8_walk(b"", raw)
            return text

    def finish(self) -> str:
        held, self.held = self.held, b""
        return "�" if held else ""


def _extended(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, kind)])


def _cut(batch: pa.RecordBatch, sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose sizes sum to about ``most``."""
    start = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= most:
            yield start, i + 1
            start, total = i + 1, 0
    if start < batch.num_rows:
        yield start, batch.num_rows


def _shared(df: DataFrame, ranks_path: str):
    """The rank file (its size is that of a vocabulary), read by the driver and broadcast, so executors need no copy of it."""
    return df.sparkSession.sparkContext.broadcast({"ranks": read_ranks(ranks_path)})


def _encoded(batches: Iterable[pa.RecordBatch], shared: dict, pattern: str, text: str, out: str) -> Iterator[pa.RecordBatch]:
    """``shared``: one dictionary a worker process, so its transducer serves all the worker's tasks."""
    if ("encoder", pattern) not in shared:
        shared["encoder", pattern] = Encoder(shared["ranks"], pattern)
    encoder = shared["encoder", pattern]
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(text))
        rest = batch.select([n for n in batch.schema.names if n != out])
        for a, b in _cut(batch, [0 if n is None else n for n in pa.compute.binary_length(texts).to_pylist()], 4 * OUT_TOKENS):
            ids = [encoder.encode(t) if t else b"" for t in texts.slice(a, b - a).to_pylist()]
            ends = pa.array(list(itertools.accumulate((len(i) // 4 for i in ids), initial=0)), pa.int32())
            values = pa.Array.from_buffers(pa.int32(), ends[-1].as_py(), [None, pa.py_buffer(b"".join(ids))])
            part = rest.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(ends, values)], [*part.schema.names, out])


def _decoded(batches: Iterable[pa.RecordBatch], shared: dict, ids: str, out: str) -> Iterator[pa.RecordBatch]:
    if "bytes_of" not in shared:
        shared["bytes_of"] = {t: b for b, t in shared["ranks"].items()}
    decoder = Decoder(shared["bytes_of"])
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(ids))
        rest = batch.select([n for n in batch.schema.names if n != out])
        for a, b in _cut(batch, [0 if n is None else n for n in pa.compute.list_value_length(column).to_pylist()], OUT_TOKENS):
            texts = []
            for row in column.slice(a, b - a):
                values = row.values
                if values is not None and values.null_count:
                    raise ValueError("a null among the token ids")
                parts = []
                for at in range(0, 0 if values is None else len(values), 1 << 16):
                    try:
                        parts.append(decoder.feed(values.slice(at, 1 << 16).to_numpy().tolist()))
                    except KeyError as e:
                        raise ValueError(f"token id {e.args[0]} is not in the vocabulary") from e
                parts.append(decoder.finish())
                texts.append("".join(parts))
            part = rest.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, out])


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """``df`` and its texts' token ids (``array<int>``).

    Null and empty texts have no ids. Texts are encoded whole, of any length.
    Repeated rows are each encoded. An empty table stays empty. All other
    columns stay; one that is named like ``out`` gives way to it.
    """
    held = _shared(df, ranks_path)
    return df.mapInArrow(lambda batches: _encoded(batches, held.value, pattern, text, out), _extended(df, out, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, ranks_path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``df`` and the text of each row's ids.

    Null or empty ids give the empty text; an id outside the vocabulary, or a
    null among the ids, raises ``ValueError`` (it has no bytes). Ill-formed
    byte sequences give U+FFFD. All other columns stay; one that is named like
    ``out`` gives way to it.
    """
    held = _shared(df, ranks_path)
    return df.mapInArrow(lambda batches: _decoded(batches, held.value, ids, out), _extended(df, out, T.StringType()))


def round_trip(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``encode``, then ``decode`` of its ids, in one Python worker a task: one transducer a core instead of two. Rows as for both."""
    held = _shared(df, ranks_path)
    schema = T.StructType([f for f in _extended(df, ids, T.ArrayType(T.IntegerType())).fields if f.name != out] + [T.StructField(out, T.StringType())])
    return df.mapInArrow(lambda batches: _decoded(_encoded(batches, held.value, pattern, text, ids), held.value, ids, out), schema)
