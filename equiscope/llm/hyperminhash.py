"""Near duplicates by HyperMinHash registers.

1. **Registers.** A document's distinct word shingles are hashed to 64 bits. The
   top 7 bits choose one of 128 buckets; of each bucket's least value its
   leading zeros (6 bits) and the 10 bits after the leading one (mantissa) are
   stored: 256 bytes a document, made in one pass without a shuffle. Equal
   least values give equal registers, so compression only adds collisions.
2. **Banding.** Four registers are one 64-bit band key. An empty register of a
   short text borrows from the filled bucket of least random priority, itself a
   minwise draw, so that a key is four draws for texts of any length and never a
   join on one shingle. Documents that share a key are candidates: at
   similarity 0.8 all 32 differ with probability (1 - 0.8^4)^32 < 1e-7.
3. **Stars.** Texts with equal words are one class. In each band bucket every
   class is paired with the bucket's least class only.
4. **Estimate.** The share of equal registers, corrected for the collisions
   that compression makes by chance, must reach the threshold less six
   standard deviations; sizes must allow the threshold.
5. **Verification** compares the full shingle sets of what is left. Verified
   pairs are joined to components.
6. **The rest, exactly.** In buckets of three or more, pairs that no star
   tested and whose components still differ are compared in blocks of at most
   512 x 512 inside tasks (registers, then an upper bound of the intersection
   from counts of shingles by hash cell) and what passes is verified. A bucket
   that is all one component costs nothing, however large; no bucket is capped.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .util import Scratch, arrow_rows, lower_ascii, packed, rows_with_ids, unpacked

BUCKETS, BAND, MANTISSA, CELLS, BLOCK = 128, 4, 10, 256, 512
BANDS = BUCKETS // BAND
#: Rows of the table of components' least rows up to which it is broadcast (about 80 bytes each, counted before).
MOST_BROADCAST_ANSWERS = 400_000
DEVIATIONS = 6.0
NEW = ["n_shingles", "component_id", "kept"]


def word_list(text: str | None) -> list[bytes]:
    """A-Z lower-cased, then the runs of bytes outside ``[\\x20\\x09-\\x0D]`` (just what these two methods of bytes do)."""
    return [] if text is None else text.encode().lower().split()


def shingle_set(words: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    """Distinct runs of n words; fewer words are one run; no words, no run."""
    return set(zip(*(words[i:] for i in range(n)))) if len(words) >= n else {tuple(words)} if words else set()


class Sketcher:
    """Words -> (distinct shingles, registers, cell counts)."""

    def __init__(self, shingle: int):
        import numpy as np
        import xxhash

        self.np, self.hash, self.shingle, self.memo = np, xxhash.xxh64_intdigest, shingle, {}

    def _hashes(self, words: list[bytes]):
        np, memo = self.np, self.memo
        if len(memo) > 300_000:
            memo.clear()
        out = []
        for w in words:
            h = memo.get(w)
            if h is None:
                h = self.hash(w)
                if len(w) <= 64:
                    memo[w] = h
            out.append(h)
        return np.array(out, np.uint64)

    def sketch(self, words: list[bytes]):
        np = self.np
        registers, cells = np.zeros(BUCKETS, np.uint16), np.zeros(CELLS, np.int64)
        if not words:
            return 0, registers, cells
        one, n = self._hashes(words), min(self.shingle, len(words))
        mixed = np.zeros(len(one) - n + 1, np.uint64)
        for i in range(n):  # a polynomial in the words' hashes, then a finaliser
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + one[i:len(one) - n + 1 + i]
            mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(31)
        distinct = np.unique(mixed)
        bucket = (distinct >> np.uint64(57)).astype(np.int64)
        at = np.flatnonzero(np.diff(bucket, prepend=-1))  # sorted: the first of each bucket is its least
        least = (distinct[at] & np.uint64((1 << 57) - 1)) >> np.uint64(4)  # 53 bits, exact as doubles
        bits = np.frexp(least.astype(np.float64))[1]
        down, up = np.maximum(bits - 1 - MANTISSA, 0).astype(np.uint64), np.maximum(MANTISSA + 1 - bits, 0).astype(np.uint64)
        mantissa = ((least >> down) << up).astype(np.int64) & ((1 << MANTISSA) - 1)
        registers[bucket[at]] = (54 - bits) << MANTISSA | mantissa
        cells = np.bincount((distinct & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
        return len(distinct), registers, cells


def band_keys(registers):
    """Rows of registers -> rows of band keys; empty registers borrow (see the module's text)."""
    import numpy as np

    rng = np.random.default_rng(17)
    priority = rng.random((BUCKETS, BUCKETS))
    np.fill_diagonal(priority, -1.0)  # a filled bucket speaks for itself
    factors = rng.integers(1, 1 << 62, BAND, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    source = np.tile(np.arange(BUCKETS), (len(registers), 1))
    for i in np.flatnonzero((registers == 0).any(1) & (registers != 0).any(1)):
        filled = np.flatnonzero(registers[i])
        source[i] = filled[priority[:, filled].argmin(1)]
    drawn = np.take_along_axis(registers, source, 1).astype(np.uint64) << np.uint64(7) | source.astype(np.uint64)
    mixed = drawn.reshape(-1, BANDS, BAND)
    keys = np.zeros(mixed.shape[:2], np.uint64)
    for j in range(BAND):
        keys = (keys ^ mixed[:, :, j]) * factors[j]
        keys ^= keys >> np.uint64(31)
    return keys.view(np.int64)


def chance_collision(n, m):
    """Probability that two unrelated sets of n and m shingles agree in a register (arrays or numbers)."""
    import numpy as np

    total = 0.0
    for zeros in range(40):  # a bucket's least value lies in [2^-(zeros+1), 2^-zeros) of the range
        low, high = 2.0 ** -(zeros + 1), 2.0 ** -zeros
        a = (1 - low) ** (n / BUCKETS) - (1 - high) ** (n / BUCKETS) if zeros else (1 - low) ** (n / BUCKETS)
        b = (1 - low) ** (m / BUCKETS) - (1 - high) ** (m / BUCKETS) if zeros else (1 - low) ** (m / BUCKETS)
        total = total + a * b / 2.0 ** MANTISSA
    return np.minimum(total, 0.5)


def estimate_passes(ra, rb, na, nb, percent: int):
    """Rows of register arrays and sizes: whether sizes allow the threshold, and the corrected estimate reaches it less ``DEVIATIONS``."""
    import numpy as np

    share = percent / 100.0
    known = np.maximum(((ra > 0) | (rb > 0)).sum(1), 1)
    same = ((ra == rb) & (ra > 0)).sum(1) / known
    by_chance = chance_collision(na, nb)
    corrected = (same - by_chance) / (1 - by_chance)
    return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (corrected >= share - DEVIATIONS * np.sqrt(share * (1 - share) / known))


def similar(a: set, b: set, percent: int) -> bool:
    both = len(a & b)
    return bool(both) and 100 * both >= percent * (len(a) + len(b) - both)


def sketches(docs: DataFrame, text: str, doc_id: str, shingle: int, columns: list[str]) -> DataFrame:
    """One row a document: its ``columns``, id, digest of its words, shingles, bands (four registers each), cell counts."""
    given = docs.select(packed(docs, columns).alias("_row"), F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"))
    schema = T.StructType([given.schema["_row"], given.schema["_id"]]).add("_words", "binary").add("_n", "long").add("_bands", T.ArrayType(T.LongType())).add("_cells", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        import numpy as np

        sketcher = Sketcher(shingle)
        for batch in batches:
            words_of, n_of, bands_of, cells_of = [], [], [], []
            for t in batch.column(2):
                words = word_list(t.as_py())
                n, registers, cells = sketcher.sketch(words)
                words_of.append(hashlib.sha256(b" ".join(words)).digest())
                n_of.append(n)
                bands_of.append(registers.view("<i8").tolist())
                cells_of.append(np.minimum(cells, 255).astype(np.uint8).tobytes())  # see upper_bound for full cells
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words_of, pa.binary()), pa.array(n_of, pa.int64()),
                                              pa.array(bands_of, pa.list_(pa.int64())), pa.array(cells_of, pa.binary())],
                                             ["_row", "_id", "_words", "_n", "_bands", "_cells"])

    return given.mapInArrow(run, schema)


def _matrix(column: pa.Array, kind: str, width: int):
    import numpy as np

    values = column.flatten().to_numpy(zero_copy_only=False) if pa.types.is_list(column.type) else np.frombuffer(b"".join(column.to_pylist()), np.uint8)
    return np.ascontiguousarray(values).view(kind).reshape(-1, width)


def _keyed(classes: DataFrame) -> DataFrame:
    """(cid, band, key): a row per class and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                keys, cid = band_keys(_matrix(batch.column(1), "<u2", BUCKETS)), batch.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(cid, BANDS)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(cid))), pa.array(keys.ravel())], ["cid", "band", "key"])

    return classes.select("cid", "bands").mapInArrow(run, "cid long, band int, key long")


def _estimated(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb, ba, bb) that pass the estimate, as (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            if batch.num_rows:
                ra, rb = (_matrix(batch.column(i), "<u2", BUCKETS) for i in (4, 5))
                na, nb = (batch.column(i).to_numpy().astype(np.float64) for i in (2, 3))
                yield batch.select([0, 1]).filter(pa.array(estimate_passes(ra, rb, na, nb, percent)))

    return pairs.select("a", "b", "na", "nb", "ba", "bb").mapInArrow(run, "a long, b long")


def _blocks(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of left and right rows of each block (band, key, l, r) whose components differ and that may reach the threshold.

    ``rows`` are sorted by block within partitions, and a block has at most
    2 x ``BLOCK`` rows. A pair is tested in its first common band only.
    """

    def test(block: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        import numpy as np

        t = pa.Table.from_batches(block).combine_chunks()
        side, star = t["left"].to_numpy(zero_copy_only=False), t["rep"].to_numpy()
        cid, label, n, band = t["cid"].to_numpy(), t["label"].to_numpy(), t["n"].to_numpy().astype(np.float64), t["band"][0].as_py()
        registers = _matrix(t["bands"].chunk(0), "<u2", BUCKETS)
        bands = band_keys(registers)
        cells = _matrix(t["cells"].chunk(0), "u1", CELLS).astype(np.int16)
        left, right = np.flatnonzero(side), np.flatnonzero(~side)
        found = []
        for i in left:
            j = right[(label[right] != label[i]) & (cid[right] != star[i]) & (cid[i] != star[i])
                      & (100 * np.minimum(n[right], n[i]) >= percent * np.maximum(n[right], n[i]))]
            if band and len(j):
                j = j[~(bands[j, :band] == bands[i, :band]).any(1)]
            if len(j):
                j = j[estimate_passes(registers[i][None, :], registers[j], n[i], n[j], percent)]
            if len(j):
                most = np.minimum(cells[i], cells[j]).sum(1)
                full = (cells[i].max() == 255) | (cells[j].max(1) == 255)  # counts were cut: no bound
                j = j[full | (100 * most >= percent * (n[i] + n[j] - most))]
            if len(j):
                found.append(np.stack([np.minimum(cid[i], cid[j]), np.maximum(cid[i], cid[j])]))
        if not found:
            return None
        a, b = np.concatenate(found, 1)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held, key = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("band", "key", "l", "r")])
            cuts = np.r_[0, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1, batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                at = tuple(keys[:, a])
                if held and at != key and (made := test(held)) is not None:
                    yield made
                if at != key:
                    held, key = [], at
                held.append(batch.slice(a, b - a))
        if held and (made := test(held)) is not None:
            yield made

    return rows.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, percent: int, shingle: int, scratch: Scratch) -> DataFrame:
    """The pairs whose full shingle sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: OrderedDict[int, set] = OrderedDict()

        def of(node: int, text: str | None) -> set:
            if node not in sets:
                sets[node] = shingle_set(word_list(text), shingle)
                while len(sets) > 16:
                    sets.popitem(last=False)
            sets.move_to_end(node)
            return sets[node]

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            good = [similar(of(a[i], batch.column(2)[i].as_py()), of(b[i], batch.column(3)[i].as_py()), percent) for i in range(batch.num_rows)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    ta, tb = (texts.select(F.col("cid").alias(f"c{x}"), F.col("words").alias(f"t{x}")) for x in "ab")
    joined = pairs.join(ta, F.col("a") == F.col("ca")).join(tb, F.col("b") == F.col("cb")).select("a", "b", "ta", "tb")
    with arrow_rows(scratch.spark, 100):  # a row holds two whole texts
        return scratch.table(joined.mapInArrow(run, "a long, b long"), "links")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, percent: int = 80,
                    keep_columns: list[str] | None = None) -> DataFrame:
    """The input columns with ``n_shingles``, ``component_id`` (the least ``doc_id`` of the component) and ``kept``.

    Documents are linked when 100 x intersection >= ``percent`` x union of
    their sets of ``shingle``-word runs (A-Z lower-cased; with fewer words the
    whole sequence is the one run). Null or empty texts have an empty set,
    are linked with nothing and are kept. ``kept`` marks one row of each
    component: the one of least ``doc_id`` (null last); of rows that repeat
    it exactly one. ``component_id`` of an unlinked row is its own id. An
    empty table gives an empty result. ``doc_id`` must be an integer. An input
    column named like a new one gives way to it.
    """
    spark, columns = docs.sparkSession, docs.columns if keep_columns is None else keep_columns
    scratch = Scratch(spark, "near")
    sketched = scratch.table(sketches(docs, text, doc_id, shingle, columns).withColumn("_tag", F.monotonically_increasing_id()), "sketches")
    filled = sketched.where("_n > 0")
    first = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_tag").alias("tag"))
    classes = scratch.table(filled.groupBy("_words", "_n", "_bands", "_cells").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("rows"))
                            .select(F.monotonically_increasing_id().alias("cid"), "_words", F.col("_n").alias("n"), F.col("_bands").alias("bands"),
                                    F.col("_cells").alias("cells"), "first", "rows"), "classes")
    bands = _keyed(classes)
    buckets = scratch.hold(bands.groupBy("band", "key").agg(F.min("cid").alias("rep"), F.count(F.lit(1)).alias("size")).where("size > 1")
                            .select(F.col("band").alias("_band"), F.col("key").alias("_key"), "rep", "size"))
    members = scratch.hold(bands.join(buckets, (F.col("band") == F.col("_band")) & (F.col("key") == F.col("_key")))
                            .select("cid", "band", "key", "rep", "size"))
    star = members.where("cid != rep").select(F.col("rep").alias("a"), F.col("cid").alias("b")).distinct()
    side = lambda x: classes.select(F.col("cid").alias(f"c{x}"), F.col("n").alias(f"n{x}"), F.col("bands").alias(f"b{x}"))
    star = star.join(side("a"), F.col("a") == F.col("ca")).join(side("b"), F.col("b") == F.col("cb"))
    tested = scratch.hold(_estimated(star.where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)"), percent))

    def texts_of(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
        wanted = scratch.hold(classes.select("cid", "_words", F.col("first.id").alias("first_id")).join(ids, "cid"))
        source = rows_with_ids(docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("words")), "_id", wanted.select("first_id"))
        same = F.sha2(F.trim(F.regexp_replace(lower_ascii(F.col("words")), r"[\x20\x09-\x0D]+", " ")), 256) == F.lower(F.hex("_words"))
        found = source.join(wanted, F.col("_id").eqNullSafe(F.col("first_id"))).where(same)
        return scratch.hold(found.select("cid", "words").dropDuplicates(["cid"]))

    links = _verified(tested, texts_of(tested), percent, shingle, scratch)
    labels = components(links, scratch)

    label = F.coalesce("label", "cid")
    labelled = scratch.hold(members.where("size > 2").join(labels, F.col("cid") == F.col("node"), "left").select("cid", "band", "key", "rep", label.alias("label")))
    shares = (labelled.groupBy("band", "key", "label").agg(F.count(F.lit(1)).alias("share")))
    mixed = (shares.groupBy("band", "key").agg(F.sum("share").alias("total"), F.max(F.struct("share", "label")).alias("most"), F.count(F.lit(1)).alias("labels"))
             .where("labels > 1").select(F.col("band").alias("_band"), F.col("key").alias("_key"), F.col("most.label").alias("main"), "total", F.col("most.share").alias("main_share")))
    mixed = scratch.hold(mixed)
    rest = labelled.join(mixed, (F.col("band") == F.col("_band")) & (F.col("key") == F.col("_key")))
    # left: what is outside the bucket's largest component; right: all. A grid of blocks of at most BLOCK rows a side.
    grid = lambda rows: F.ceil(rows / F.lit(BLOCK // 2)).cast("int")  # noqa: E731  half-filled on average, as a hash deals rows unevenly
    lefts, rights = grid(F.greatest(F.col("total") - F.col("main_share"), F.lit(1))), grid(F.col("total"))
    dealt = F.xxhash64("cid", "band", "key")
    left = rest.where("label != main").select("cid", "band", "key", "rep", "label", F.pmod(dealt, lefts).cast("int").alias("l"),
                                              F.explode(F.sequence(F.lit(0), rights - 1)).alias("r"), F.lit(True).alias("left"))
    right = rest.select("cid", "band", "key", "rep", "label", F.explode(F.sequence(F.lit(0), lefts - 1)).alias("l"),
                        F.pmod(dealt, rights).cast("int").alias("r"), F.lit(False).alias("left"))
    rows = left.unionByName(right)
    rows = (rows.join(classes.select(F.col("cid").alias("_cid"), "n", "bands", "cells"), F.col("cid") == F.col("_cid")).drop("_cid")
            .repartition("band", "key", "l", "r").sortWithinPartitions("band", "key", "l", "r"))
    crossed = scratch.hold(_blocks(rows, percent).distinct())
    named = classes.join(labels, F.col("cid") == F.col("node"), "left").select("_words", "first", "rows", label.alias("label"))
    if not crossed.isEmpty():  # components of components: of the links between two, one counts
        more = _verified(crossed, texts_of(crossed), percent, shingle, scratch)
        ends = [labels.select(F.col("node").alias(f"n{x}"), F.col("label").alias(f"l{x}")) for x in "ab"]
        more = (more.join(ends[0], F.col("a") == F.col("na"), "left").join(ends[1], F.col("b") == F.col("nb"), "left")
                .select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).distinct())
        wider = components(more, scratch).toDF("_node", "_wider")
        named = named.join(wider, F.col("label") == F.col("_node"), "left").select("_words", "first", "rows", F.coalesce("_wider", "label").alias("label"))
    named = scratch.hold(named)
    lowest = scratch.hold(named.groupBy(F.col("label").alias("_label")).agg(F.min("first").alias("low"), F.sum("rows").alias("_members")).where("_members > 1"))
    answer = scratch.table(named.join(lowest, F.col("label") == F.col("_label")).select(F.col("_words").alias("_w"), "low"), "answer")
    scratch.release()
    # a component of one row (or of no words) has no answer: it is its own; the others are broadcast if few are counted, and no text moves
    few = answer.limit(MOST_BROADCAST_ANSWERS + 1).count() <= MOST_BROADCAST_ANSWERS
    joined = sketched.join(F.broadcast(answer) if few else answer, F.col("_words") == F.col("_w"), "left")
    return joined.select(*unpacked("_row", columns, NEW), F.col("_n").alias("n_shingles"),
                         F.when(F.col("low").isNull(), F.col("_id")).otherwise(F.col("low.id")).alias("component_id"),
                         F.coalesce(F.col("_tag") == F.col("low.tag"), F.lit(True)).alias("kept"))
