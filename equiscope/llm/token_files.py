r"""Token-id files: documents compressed one by one with a shared zstandard dictionary.

**Encoding.** Ids come from the tokenizers library. A byte-level BPE without
normaliser cuts text by a pattern in which a line end between two other
characters is a piece and a single space between two others begins one, so the
parts between are handed to its pre-tokenizer and model one by one and
remembered; any other tokenizer encodes whole texts. A task encodes a run of
documents at a time: their parts are told apart by Arrow, and each different one
is looked up once a run, not once a word.

**Dictionary.** zstandard trains it on the serialized id arrays of a bounded
sample of documents (``SAMPLE``). Each document is a frame of its own (with
zstandard's checksum), so a short document is read without its neighbours and
still profits from what all share.

**Files** (``path/dictionary``, ``path/files``), in ascending order of the ids
of documents: a file is a run of blocks, and a block is

    magic (8) | SHA-256 of the dictionary (32) | part, block (4 + 4)
    | ids before it in the part (8) | documents (4) | bytes an id (4)
    | per document: has a doc_id (1) | doc_id (8) | number of ids (8)
    | offsets of the frames, one more than documents (8 each) | frames | end mark (8)

all little-endian. Spark's text writer, with the end mark as line separator,
writes just these bytes wherever Spark writes; no task holds more than a block.
The reader steps by the stated lengths and never searches for the mark.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import struct
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prefix import running_totals
from .util import Scratch, arrow_rows, rows_with_ids

MAGIC, END = b"EQSTOK01", "EQSTOKZZ"
HEAD = "<8s32sIIQII"
SAMPLE, SAMPLE_IDS, DICTIONARY, BLOCK, FILE, LEVEL = 2000, 1 << 14, 112_640, 1 << 19, 1 << 23, 3
#: Bytes of text that a task encodes at once (a longer text alone).
RUN = 1 << 20
#: White space that is a boundary of pieces on its own: a line end, and a space that begins a piece, between two other characters.
LINE, BETWEEN = re.compile(r"(?<=\S)\n(?=\S)"), re.compile(r"(?<=\S) (?=\S)")
#: Latin letters and then marks: two pieces (an apostrophe could begin a contraction).
WORD = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+)([,.;:!?]*)")
#: Whether a byte is ASCII white space, a mark of ``WORD``, an ASCII letter, as tables for ``bytes.translate``.
SPACE, MARK, LETTER = (bytes(b in of for b in range(256)) for of in ({*range(9, 14), *range(28, 33)}, set(b",.;:!?"), {*range(65, 91), *range(97, 123)}))


def byte_characters() -> list[str]:
    """The characters that a byte-level vocabulary has for the 256 bytes: printing ones for themselves, the others from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in own else next(others)) for b in range(256)]


class Encoder:
    """Text -> ids as little-endian unsigned 32-bit integers, with the file's tokenizer."""

    def __init__(self, path: str, remembered: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        spec = json.loads(self.tokenizer.to_str())
        cut, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        self.by_part = (spec.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
                        and model.get("type") == "BPE" and not model.get("dropout") and all(t["special"] for t in spec.get("added_tokens", []))
                        and spec.get("truncation") is None and spec.get("padding") is None)
        self.remembered, self.forgotten, self.first, self.after, self.marks = remembered, 0, {}, {}, {}
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.character, self.tokenize = dict(enumerate(byte_characters())), self.tokenizer.model.tokenize
        self.serial = [struct.pack("<I", i) for i in range(self.tokenizer.get_vocab_size())]
        self.space = self.character[ord(" ")]
        self.end_of_line = self._part("\n", "") if self.by_part else b""

    def _merged(self, piece: str) -> bytes:
        """Ids of one piece, given in the vocabulary's characters."""
        serial = self.serial
        return b"".join([serial[t.id] for t in self.tokenize(piece)])

    def _marks(self, marks: str) -> bytes:
        ids = self.marks.get(marks)
        if ids is None:
            ids = self._merged(marks)
            if len(marks) <= 8:
                self.marks[marks] = ids
        return ids

    def _forget(self, memo: dict[str, bytes]) -> None:
        """The half met first stays, for it holds what is met often; every eighth time all is forgotten, should the texts have changed."""
        self.forgotten += 1
        kept = dict(itertools.islice(memo.items(), self.remembered // 2 if self.forgotten % 8 else 0))
        memo.clear()
        memo.update(kept)

    def _part(self, part: str, lead: str) -> bytes:
        """Ids of a part behind ``lead``, remembered if short and without white space at an end where a space may follow or precede."""
        memo = self.after if lead else self.first
        ids = memo.get(part)
        if ids is not None:
            return ids
        if len(memo) >= self.remembered:
            self._forget(memo)
        if part.isalpha() and part.isascii():
            ids = self._merged(self.space + part if lead else part)
        elif word := WORD.fullmatch(part):
            letters, marks = word.groups()
            ids = memo.get(letters) if marks else None
            if ids is None:
                mapped = (self.space if lead else "") + letters if letters.isascii() else (lead + letters).encode().decode("latin-1").translate(self.character)
                ids = self._merged(mapped)
                if len(letters) <= 64:
                    memo[letters] = ids
            if not marks:
                return ids
            ids += self._marks(marks)
        else:
            ids = b"".join([self._merged(p) for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(lead + part)])
            if not part or part[-1].isspace() or lead and part[0].isspace():
                return ids
        if len(part) <= 64:
            memo[part] = ids
        return ids

    def _line(self, text: str) -> bytes:
        parts = text.split(" ")
        found = list(map(self.after.get, parts))
        found[0] = self.first.get(parts[0])
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    part = parts[i]
                    if not part or part != part.strip():  # cut only at spaces between two other characters
                        first, *others = BETWEEN.split(text)
                        return self._part(first, "") + b"".join([self._part(p, " ") for p in others])
                    found[i] = self._part(part, " " if i else "")
        return b"".join(found)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.by_part:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        lines = text.split("\n")
        if len(lines) == 1:
            return self._line(text)
        if not all([line and line == line.strip() for line in lines]):
            lines = LINE.split(text)
        return self.end_of_line.join(map(self._line, lines))

    def _own(self, part: str) -> bytes:
        """Ids of a part before which no space was cut off."""
        if part[0] == "\n" and len(part) > 1 and not part[1].isspace():
            return self.end_of_line + self._part(part[1:], "")
        return self._part(part, "")

    def encode_column(self, texts: pa.Array) -> list[bytes]:
        """``encode`` of each text (null: empty), each different part of all of them looked up once.

        No piece has white space behind another character or a mark behind a
        letter, and what is before a piece's begin does not change it; so texts
        are cut there. Cuts are found in bytes: a document in which one follows
        white space beyond ASCII is encoded by itself.
        """
        import numpy as np
        import pyarrow.compute as pc

        texts = texts.cast(pa.large_string()).fill_null("")
        if not self.by_part:
            return [self.encode(t) for t in texts.to_pylist()]
        at = np.frombuffer(texts.buffers()[1], "<i8", len(texts) + 1, 8 * texts.offset)
        if at[0] == at[-1]:
            return [b""] * len(texts)
        data, at = texts.buffers()[2].slice(int(at[0]), int(at[-1] - at[0])), at - at[0]
        raw = np.frombuffer(data, "u1")
        space, mark, letter = (np.frombuffer(bytes(data).translate(mask), bool) for mask in (SPACE, MARK, LETTER))
        cut = (raw == 32) | (raw == 10)
        cut[1:] &= ~space[:-1]
        cut[1:] |= mark[1:] & letter[:-1]
        cut[2:] |= mark[2:] & (raw[:-2] == 0xC3) & (raw[1:-1] != 0x97) & (raw[1:-1] != 0xB7)  # À to ÿ, but not × and ÷
        cut[at[:-1][at[1:] > at[:-1]]] = True
        begins = np.flatnonzero(cut)
        parts = pa.Array.from_buffers(pa.large_string(), len(begins), [None, pa.py_buffer(np.append(begins, len(raw))), data]).dictionary_encode()
        different = parts.dictionary
        _, offsets, first = different.buffers()
        spaced = np.frombuffer(first, "u1")[np.frombuffer(offsets, "<i8", len(different))] == 32
        keys = pc.if_else(pa.array(spaced), pc.utf8_slice_codeunits(different, 1), different).to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.after.get, keys))
        own = np.flatnonzero(~spaced).tolist()
        for i in own:
            found[i] = self._own(keys[i])
        new = [i for i, ids in enumerate(found) if ids is None]
        for i in new:
            found[i] = self._part(keys[i], " ")
        ids = pa.array(found, pa.large_binary()).take(parts.indices)
        words = np.searchsorted(begins, at)
        ends = np.frombuffer(ids.buffers()[1], "<i8", len(ids) + 1)[words].tolist()
        held = ids.buffers()[2]
        out = [held[a:b].to_pybytes() for a, b in zip(ends, ends[1:])]
        unsure = [i for i in (*own, *new) if keys[i][-1:] > "\x7f" and keys[i][-1].isspace()]  # never remembered
        if unsure:
            places = np.flatnonzero(np.isin(parts.indices.to_numpy(), unsure))
            for i in np.unique(np.searchsorted(words, places, "right") - 1).tolist():
                out[i] = self.encode(texts[i].as_py())
        return out


def encoder_of(path: str) -> Encoder:
    """The worker's encoder: a worker's later tasks find it, with what it remembers, in the library's namespace."""
    import tokenizers

    held = vars(tokenizers).setdefault("_equiscope_encoders", {})
    return held.get(path) or held.setdefault(path, Encoder(path))


def without_encoders() -> None:
    """A worker that packs or reads files has done its encoding: what it remembers is freed."""
    if "tokenizers" in sys.modules:
        vars(sys.modules["tokenizers"]).pop("_equiscope_encoders", None)
        pa.default_memory_pool().release_unused()


def narrow(ids: bytes, width: int) -> bytes:
    """The ids with ``width`` bytes each."""
    import numpy as np

    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def widened(ids: bytes, width: int) -> bytes:
    import numpy as np

    return ids if width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()


def runs(batches: Iterator[pa.RecordBatch], column: int, size: int = RUN) -> Iterator[pa.RecordBatch]:
    """The same rows in the same order, in batches of about ``size`` bytes in the text column."""
    import numpy as np
    import pyarrow.compute as pc

    def dealt(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pa.Table.from_batches(held).combine_chunks().to_batches():
            upto = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) // size
            ends = [0, *(np.flatnonzero(np.diff(upto)) + 1).tolist(), batch.num_rows]
            yield from (batch.slice(a, b - a) for a, b in zip(ends, ends[1:]))

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.nbytes
        if n >= size:
            yield from dealt(held)
            held, n = [], 0
    if held:
        yield from dealt(held)


def train(arrays: list[bytes], size: int = DICTIONARY) -> bytes:
    """A zstandard dictionary of at most ``size`` bytes and an eighth of the samples; empty when there are too few to train one."""
    import zstandard

    size = min(size, sum(map(len, arrays)) // 8)
    if len(arrays) < 8 or size < 256:
        return b""
    try:
        return zstandard.train_dictionary(size, arrays).as_bytes()
    except zstandard.ZstdError:
        return b""


def _dictionary(data: bytes):
    import zstandard

    return {"dict_data": zstandard.ZstdCompressionDict(data)} if data else {}


def block_of(part: int, number: int, before: int, width: int, dictionary: bytes, rows: list[tuple[int | None, int, bytes]]) -> bytes:
    """A block without its end mark; ``rows``: doc_id, number of ids, frame."""
    import numpy as np

    ids, counts, frames = zip(*rows)
    offsets = np.r_[0, np.cumsum([len(f) for f in frames])].astype("<u8")
    return b"".join([struct.pack(HEAD, MAGIC, hashlib.sha256(dictionary).digest(), part, number, before, len(rows), width),
                     np.array([i is not None for i in ids], "u1").tobytes(), np.array([i or 0 for i in ids], "<i8").tobytes(),
                     np.array(counts, "<u8").tobytes(), offsets.tobytes(), *frames])


def blocks_in(data: bytes | memoryview, digest: bytes) -> Iterator[tuple]:
    """(part, number, width, ids before each document, doc_ids, numbers of ids, frames) of each block of a file."""
    import numpy as np

    view, at = memoryview(data), 0
    while at < len(data):
        if len(data) - at < struct.calcsize(HEAD):
            raise ValueError("the file ends inside a block")
        magic, used, part, number, before, n, width = struct.unpack_from(HEAD, data, at)
        if magic != MAGIC:
            raise ValueError("no block begins here")
        if used != digest:
            raise ValueError("the block was written with another dictionary")
        at += struct.calcsize(HEAD)
        if len(data) - at < 25 * n + 8:
            raise ValueError("the file ends inside a block")
        has, at = np.frombuffer(data, "u1", n, at).astype(bool), at + n
        ids, at = np.frombuffer(data, "<i8", n, at), at + 8 * n
        counts, at = np.frombuffer(data, "<u8", n, at).astype(np.int64), at + 8 * n
        offsets, at = np.frombuffer(data, "<u8", n + 1, at).astype(np.int64), at + 8 * (n + 1)
        if len(data) < (end := at + int(offsets[-1])) + len(END) or data[end:end + len(END)] != END.encode():
            raise ValueError("the file ends inside a block")
        frames = [view[at + int(a):at + int(b)] for a, b in zip(offsets, offsets[1:])]
        yield part, number, width, before + np.r_[0, np.cumsum(counts)[:-1]], [int(i) if h else None for i, h in zip(ids, has)], counts, frames
        at = end + len(END)


def write_files(docs: DataFrame, path: str, tokenizer: str, text: str = "text", doc_id: str = "doc_id", end_id: int | None = 0,
                sample: int = SAMPLE, file_bytes: int = FILE, level: int = LEVEL) -> None:
    """The documents' ids, each with ``end_id`` behind (None: nothing), into files at ``path`` in ascending order of ``doc_id``.

    Null and empty texts hold the end id alone. A null ``doc_id`` comes last;
    rows that repeat a ``doc_id`` come in an order that depends on their ids
    alone. The dictionary is trained on at most ``sample`` documents of at most
    ``SAMPLE_IDS`` ids, chosen by a hash of the id (too few: no dictionary).
    An empty table gives no file. Other columns are not written.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ids")
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    tail = b"" if end_id is None else struct.pack("<I", end_id)

    def serialized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        for batch in runs(batches, 0):
            made = [narrow(ids + tail, encoder.width) for ids in encoder.encode_column(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([m for m in made if m and len(m) <= encoder.width * SAMPLE_IDS], pa.binary())], ["ids"])

    total = docs.count()
    by_hash = F.pmod(F.xxhash64(F.lit("dictionary"), "doc_id"), F.lit(1 << 30))
    chosen = given.where(by_hash <= min(1.0, 2.0 * sample / max(1, total)) * (1 << 30)).orderBy(by_hash, "doc_id").limit(sample)
    dictionary = train([r["ids"] for r in chosen.select("text").mapInArrow(serialized, "ids binary").collect()])

    def compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        encoder = encoder_of(tokenizer)
        zstd = zstandard.ZstdCompressor(level=level, write_checksum=True, **_dictionary(dictionary))
        for batch in runs(batches, 1):
            counts, frames = [], []
            for ids in encoder.encode_column(batch.column(1)):
                ids += tail
                counts.append(len(ids) // 4)
                frames.append(zstd.compress(narrow(ids, encoder.width)))
            width = pa.array([encoder.width] * len(counts), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), width, pa.array(frames, pa.binary())], ["doc_id", "n", "width", "frame"])

    with arrow_rows(spark, 500):
        frames, frames_path = scratch.write(given.mapInArrow(compressed, "doc_id long, n long, width int, frame binary"), "frames")
    size = frames.agg(F.sum(F.octet_length("frame").cast("long"))).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_last(), F.col("n").asc(), F.col("frame").asc()]
    ranged = frames.repartitionByRange(max(1, -(-size // file_bytes)), order[0]).sortWithinPartitions(*order)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        without_encoders()
        part, number, before, rows, held, width = TaskContext.get().partitionId(), 0, 0, [], 0, 4
        out = lambda: pa.RecordBatch.from_arrays([pa.array([block_of(part, number, before, width, dictionary, rows)], pa.binary())], ["value"])
        for batch in batches:
            for i, n, w, frame in zip(*[c.to_pylist() for c in batch.columns]):
                rows.append((i, n, frame))
                held, width = held + len(frame), w
                if held >= BLOCK:
                    yield out()
                    number, before, rows, held = number + 1, before + sum(r[1] for r in rows), [], 0
        if rows:
            yield out()

    def to_files(blocks: DataFrame, name: str, separator: str) -> None:
        (blocks.select(F.col("value").cast("string")).write.option("lineSep", separator).option("compression", "none")
         .option("maxRecordsPerFile", 2 * file_bytes // BLOCK).text(f"{path}/{name}"))

    with arrow_rows(spark, 500):
        to_files(ranged.mapInArrow(packed, "value binary"), "files", END)
    to_files(spark.createDataFrame([(bytearray(dictionary),)], "value binary"), "dictionary", END)
    scratch.drop(frames_path)


def read_dictionary(spark: SparkSession, path: str) -> bytes:
    """The files' dictionary (empty: none was used)."""
    return spark.read.format("binaryFile").load(f"{path}/dictionary").select("content").first()["content"][:-len(END)]


def _frames(batches: Iterator[pa.RecordBatch], digest: bytes) -> Iterator[pa.RecordBatch]:
    """The documents of files, still compressed, a block at a time."""
    for batch in batches:
        for content in batch.column(0):
            for part, _, width, before, ids, counts, frames in blocks_in(memoryview(content.as_buffer()), digest):
                n = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array(before.astype("int64")), pa.array(ids, pa.int64()), pa.array(counts),
                                                  pa.array([width] * n, pa.int32()), pa.array(frames, pa.binary())],
                                                 ["part", "before", "doc_id", "n_tokens", "width", "frame"])


def _decompressed(batches: Iterator[pa.RecordBatch], dictionary: bytes) -> Iterator[pa.RecordBatch]:
    import zstandard

    without_encoders()
    zstd = zstandard.ZstdDecompressor(**_dictionary(dictionary))
    for whole in batches:
        for at in range(0, whole.num_rows, 64):
            batch = whole.slice(at, 64)
            ids = [widened(zstd.decompress(f.as_buffer()), w) for f, w in zip(batch.column(5), batch.column(4).to_pylist())]
            if [len(i) // 4 for i in ids] != batch.column(3).to_pylist():
                raise ValueError("a document has not as many ids as stated")
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(ids, pa.binary())], ["part", "before", "doc_id", "n_tokens", "ids"])


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(f"{path}/files").where("length > 0").select("content")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """A row per document: ``part``, ``before`` (ids before it in its part), ``doc_id``, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit).

    A damaged or cut file, and one of another dictionary, raise.
    """
    dictionary = read_dictionary(spark, path)
    digest = hashlib.sha256(dictionary).digest()
    return _files(spark, path).mapInArrow(lambda batches: _decompressed(_frames(batches, digest), dictionary),
                                          "part int, before long, doc_id long, n_tokens long, ids binary")


def fetch(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` of the documents whose id is in the one column of ``wanted``: their frames alone are decompressed."""
    dictionary = read_dictionary(spark, path)
    digest = hashlib.sha256(dictionary).digest()
    frames = _files(spark, path).mapInArrow(lambda batches: _frames(batches, digest), "part int, before long, doc_id long, n_tokens long, width int, frame binary")
    found = rows_with_ids(frames, "doc_id", wanted).select("part", "before", "doc_id", "n_tokens", "width", "frame")
    return found.mapInArrow(lambda batches: _decompressed(batches, dictionary), "part int, before long, doc_id long, n_tokens long, ids binary").select("doc_id", "n_tokens", "ids")


def file_index(spark: SparkSession, path: str) -> DataFrame:
    """A row per document, read back whole: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``."""
    scratch = Scratch(spark, "ids-read")
    with arrow_rows(spark, 1):  # a row is a file
        rows = scratch.table(read_documents(spark, path).select("part", "before", "doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32")), "read")
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    bases = running_totals(parts, [], ["part"], ["n"], ["upto"]).select(F.col("part").alias("_part"), (F.col("upto") - F.col("n")).alias("_base"))
    return rows.join(bases, F.col("part") == F.col("_part")).select("doc_id", (F.col("before") + F.col("_base")).alias("start"), "n_tokens", "ids_crc32")
