"""Whitening, hard negatives and token-id files against brute force, on odd rows and on the small tables."""

import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from equiscope.llm import ann, hard_negatives, queries, token_files, whitening
from equiscope.llm.util import Scratch

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path(queries.TOKENIZER)


def whole_ids(texts):
    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    return [[*e.ids, 0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def usable(rows):
    return [r for r in rows if r["embedding"] is not None and all(c is not None and np.isfinite(c) for c in r["embedding"])]


# ------------------------------------------------------------------ op 11
@pytest.mark.parametrize("values", [np.arange(40.0), np.r_[np.full(20, 3.0), np.full(20, 1.0)], np.ones(40), np.r_[np.zeros(30), np.arange(1.0, 11)], 2.0 ** -np.arange(40)])
def test_slices_hold_the_largest_eigenvalues(spark, values):
    rng = np.random.default_rng(3)
    turn = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    v = turn * values @ turn.T
    v = (v + v.T) / 2
    diagonal, off = whitening.tridiagonal(v)
    exact = np.sort(values)[::-1]
    assert whitening.count_above(diagonal, off, [0.5, -1.0]).tolist() == [int((values > 0.5).sum()), 40]
    top = min(8, int((values > 1e-9).sum()))
    found, vectors = whitening.feast(spark, v, whitening.slices(diagonal, off, top))
    assert len(found) >= top and np.allclose(found, exact[:len(found)], rtol=0, atol=1e-13 * exact[0])
    assert np.allclose(v @ vectors, vectors * found, atol=1e-12 * exact[0]) and np.allclose(vectors.T @ vectors, np.eye(len(found)), atol=1e-12)


def whitened_by_hand(x, top):
    n, total = len(x), x.sum(0)
    y = (n * x - total) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1][:top], vectors[:, ::-1][:, :top]
    return y @ vectors / np.sqrt(values), values / (y * y).sum() * n, ((n * x - total) ** 2).sum(1)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 6)) * [5, 4, 3, 2, 1, 0.5]
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)] + [(7, x[7].tolist(), None), (None, x[8].tolist(), "x")]
    odd = [(900, None, "x"), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0], "x"), (902, [float("nan")] * 6, "x"), (903, [float("inf")] * 6, "x"), (904, [1.0], "x"), (905, [], "x"), (906, [1e300] * 6, "x")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, whitened string").withColumn("extra", F.lit(1))
    out = whitening.whiten(df, components=4)
    assert out.columns == ["vec_id", "extra", *whitening.NEW]
    got = out.collect()
    w, explained, deviation = whitened_by_hand(np.floor(64 * np.array([r[1] for r in rows])).astype(int) + 1_000_000, 4)
    assert len(got) == 302 * 4 and {r["n"] for r in got} == {302} and max(r["identity_error"] for r in got) < 1e-9
    mine = {(r["vec_id"], r["component"]): r for r in got}
    sign = [np.sign(mine[0, c + 1]["whitened"] * w[0, c]) for c in range(4)]
    for at, (i, _, _) in enumerate(rows):
        for c in range(4):
            r = mine[i, c + 1]
            assert abs(r["whitened"] - w[at, c] * sign[c]) < 1e-9 and r["deviation"] == deviation[at] and abs(r["explained"] / explained[c] - 1) < 1e-9
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.where("vec_id = 3")).count() == 0
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(10)], "vec_id long, embedding array<double>")
    assert {r["component"] for r in whitening.whiten(flat).collect()} == {1}  # one direction has all the variance


def test_deviation_beyond_a_long_is_null(spark):
    df = spark.createDataFrame([(1, [1e13, 0.0]), (2, [-1e13, 1.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(df).where("component = 1").collect()}
    x = {1: (64 * 10**13, 0), 2: (-64 * 10**13, 64), 3: (0, 128)}
    total = (0, 192)
    exact = {i: sum((3 * v - s) ** 2 for v, s in zip(row, total)) for i, row in x.items()}
    assert got == {i: d if d < 1 << 63 else None for i, d in exact.items()} and got[3] is not None


def test_registered_whitening(spark):
    rows = usable(spark.read.parquet(f"{SF}/embeddings.parquet").collect())
    got = queries.QUERIES["op11_feast_whitening"](spark, SF).collect()
    w, explained, deviation = whitened_by_hand(np.floor(64 * np.array([r["embedding"] for r in rows])).astype(int) + 1_000_000, 32)
    assert len(got) == 32 * len(rows) and max(r["identity_error"] for r in got) < 1e-6
    by = {(r["vec_id"], r["component"]): r for r in got}
    for c in range(32):
        column = np.array([by[r["vec_id"], c + 1]["whitened"] for r in rows])
        assert min(np.abs(column - w[:, c]).max(), np.abs(column + w[:, c]).max()) < 1e-7 and abs(by[rows[0]["vec_id"], c + 1]["explained"] / explained[c] - 1) < 1e-9
    assert [by[r["vec_id"], 1]["deviation"] for r in rows] == deviation.tolist()


# ------------------------------------------------------------------ op 12
def mined_by_hand(rows, is_anchor, positives=5, negatives=10, scale=256):
    ids, labels = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    x = np.floor(scale * np.array([r[2] for r in rows], float)).astype(np.int64)
    out = []
    for a in np.flatnonzero([is_anchor(i) for i in ids]):
        s = x @ x[a]
        p = np.flatnonzero((labels == labels[a]) & (ids != ids[a]))
        for j in p[np.lexsort((ids[p], -s[p]))[:positives]]:
            c = np.flatnonzero((labels != labels[a]) & (30 * s[j] <= 100 * s) & (100 * s <= 90 * s[j]))
            out += [(ids[a], ids[j], r + 1, ids[k], s[j], s[k]) for r, k in enumerate(c[np.lexsort((ids[c], -s[c]))[:negatives]])]
    return sorted(out)


def found_rows(df):
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect())


@pytest.mark.parametrize("width", [3, 70])
def test_hard_negatives_with_ties_and_odd_rows(spark, width, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 64)
    monkeypatch.setattr(hard_negatives, "GROUP", 150)
    monkeypatch.setattr(hard_negatives, "RUN", 7)
    rng = np.random.default_rng(width)
    rows = [(i, int(rng.choice([0, 0, 0, 1, 2, 3])), (rng.integers(-2, 3, width) / 256 + (0.02 if i % 3 else 0)).tolist()) for i in range(400)]  # few values: many ties
    rows += [(1000 + i, 1, rows[5][2]) for i in range(60)] + [(2000, 0, [0.0] * width), (2100, 9, rows[1][2]), (-100, 1, rows[2][2])]
    odd = [(3000, None, rows[0][2]), (3100, 1, None), (3200, 1, [float("nan")] * width), (3300, 1, [1.0]), (3400, 1, []), (None, 1, rows[0][2]), (3500, 1, [1e30] * width), (3600, 1, [None] * width)]
    df = spark.createDataFrame(rows + odd + [rows[100]], "vec_id long, label int, embedding array<double>").withColumn("rank", F.lit("x"))
    got = found_rows(hard_negatives.mine(df, F.col("id") % 20 == 0))
    assert got == mined_by_hand(rows, lambda i: i % 20 == 0) and len(got) > 100
    assert hard_negatives.mine(df.limit(0), F.col("id") % 20 == 0).count() == 0 and hard_negatives.mine(df, F.col("id") < -5000).count() == 0


def test_intervals_hold_the_product(spark):
    rng = np.random.default_rng(8)
    for width in (1, 5, 64, 100):
        turns = hard_negatives.rotations(width)
        x = rng.integers(-300, 300, (500, width)) + (rng.random((500, 1)) < 0.1) * 10**6
        codes = hard_negatives.Codes.of(x, turns)
        for q in (*x[:20], np.zeros(width, np.int64)):
            low, high = codes.interval(hard_negatives.Asked(q, turns), np.arange(500))
            exact = x @ q
            assert (low <= exact).all() and (exact <= high).all()
    assert np.median(high - low) <= np.median(2 * np.linalg.norm(x, axis=1) * np.linalg.norm(q)) + 1


def test_registered_hard_negatives(spark):
    rows = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], r["embedding"])
            for r in usable(spark.read.parquet(f"{SF}/embeddings.parquet").collect()) if r["label"] is not None]
    assert found_rows(queries.QUERIES["op12_hard_negatives"](spark, SF)) == mined_by_hand(rows, lambda i: i % 100 == 0)


# ------------------------------------------------------------------ op 13
def test_parts_encode_like_whole_texts():
    rnd = random.Random(1)
    encoder, tiny = token_files.Encoder(TOKENIZER), token_files.Encoder(TOKENIZER, remembered=5)
    pieces = ["a", "The", "the", "é", "'s", "it's", " ", " ", "  ", "\n", "\r\n", "\t", "9", "12", "€", "日本", "\x1c", "\x85", "\xa0", " ", "<|endoftext|>", "...", "x" * 90]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 30))) for _ in range(3000)]
    for t, ids in zip(texts, whole_ids(texts)):
        assert encoder.encode(t) == tiny.encode(t) == struct.pack(f"<{len(ids) - 1}I", *ids[:-1])
    whole = token_files.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert not whole.by_part and len(whole.encode("Two words")) >= 8


def test_files_of_odd_documents(spark, odd_docs):
    path = Scratch(spark, "t").path("ids")
    docs = odd_docs.unionByName(spark.createDataFrame([(-5, "".join(map(chr, range(1, 0x2000))), "s", "x")], odd_docs.schema))
    token_files.write_files(docs, path, TOKENIZER, file_bytes=2000)
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    expected, at = [], 0
    for r, ids in zip(rows, whole_ids([r["text"] for r in rows])):
        expected.append((r["doc_id"], at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    got = sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.file_index(spark, path).collect()), key=lambda r: r[1])
    assert got == expected
    some = token_files.fetch(spark, path, spark.createDataFrame([(2,), (-5,), (77,)], "id long")).collect()
    assert sorted(r["doc_id"] for r in some) == [-5, 2, 2]
    assert all(zlib.crc32(r["ids"]) in {e[3] for e in expected if e[0] == r["doc_id"]} for r in some)
    empty = Scratch(spark, "t").path("ids")
    token_files.write_files(docs.limit(0), empty, TOKENIZER)
    assert token_files.file_index(spark, empty).count() == 0


def test_every_byte_reaches_the_files_and_damage_is_seen(spark):
    dictionary = token_files.train([struct.pack("<50H", *[(i * j) % 997 for j in range(50)]) for i in range(400)])
    assert 256 <= len(dictionary) <= 112_640 and token_files.train([b"ab"] * 3) == b""
    path = Scratch(spark, "t").path("raw")
    block = token_files.block_of(0, 0, 10, 2, dictionary, [(i, 3, bytes(range(256))) for i in (4, None, 5)])
    spark.createDataFrame([(bytearray(block),)], "value binary").select(F.col("value").cast("string")).write.option("lineSep", token_files.END).text(path)
    data = bytes(spark.read.format("binaryFile").load(path).where("length > 0").first()["content"])
    assert data == block + token_files.END.encode()
    import hashlib
    digest = hashlib.sha256(dictionary).digest()
    part, _, width, before, ids, counts, frames = next(token_files.blocks_in(data, digest))
    assert ids == [4, None, 5] and before.tolist() == [10, 13, 16] and all(bytes(f) == bytes(range(256)) for f in frames)
    for broken, words in ((data[:-1], "ends inside"), (data[:40], "ends inside"), (b"x" + data, "no block"), (data + data[:30], "ends inside")):
        with pytest.raises(ValueError, match=words):
            list(token_files.blocks_in(broken, digest))
    with pytest.raises(ValueError, match="another dictionary"):
        list(token_files.blocks_in(data, bytes(32)))


def test_registered_token_files(spark):
    rows = sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r["doc_id"])
    expected, at = {}, 0
    for r, ids in zip(rows, whole_ids([r["text"] for r in rows])):
        expected[r["doc_id"]] = (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.QUERIES["op13_token_files"](spark, SF).collect()} == expected


def test_a_group_of_queries_holds_k_rows_each_whatever_the_parts():
    rng = np.random.default_rng(3)
    x, ids = rng.normal(size=(900, 8)), np.arange(900)
    ids[880:] = np.arange(20)  # ids repeated with other vectors
    x[870:880], ids[870:880] = x[860:870], ids[860:870]  # and wholly repeated rows
    part = rng.integers(0, 30, 900)
    led = [sorted(rng.choice(30, rng.integers(1, 31), replace=False).tolist()) for _ in range(40)]
    nearest = ann.Nearest(7, 30)
    for a in (0, 25):
        nearest.ask(ids[a:a + (25 if a == 0 else 15)], x[a:a + (25 if a == 0 else 15)], led[a:a + (25 if a == 0 else 15)])
    for p in range(30):
        for piece in np.array_split(np.flatnonzero(part == p), 3):
            if len(piece):
                nearest.offer(p, ids[piece], x[piece])
    got = nearest.rows().to_pydict()
    for q in range(40):
        right = sorted({(-(x[i] * x[q]).sum(), int(ids[i])) for i in range(900) if part[i] in led[q] and ids[i] != ids[q]})[:7]
        assert [(-s, v) for a, v, s in zip(*got.values()) if a == q] == right
    assert len(got["query_id"]) <= 40 * 7


def test_groups_grow_with_the_queries_not_with_the_parts():
    for parts in (1, 8, 64, 1024):
        grid, groups = ann.query_groups({p: 3 + p % 7 for p in range(parts)}, parts)
        assert sorted(grid) == list(range(parts)) and 1 <= groups <= 2 * ann.GROUPS and {g for first, n in grid.values() for g in range(first, first + n)} == set(range(groups))
    grid, groups = ann.query_groups({0: 5, 3: 1_000_000, 7: 2}, 8)
    assert grid[3] == (1, -(-1_000_000 // ann.QUERIES)) and grid[7] == (groups - 1, 1)


def test_search_makes_k_rows_a_query_before_the_ranking(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(1200, 6)))], "vec_id long, embedding array<float>")
    out = ann.search(df, F.col("vec_id") % 10 == 0, k=5, rows_a_part=75, recall=1.0)
    plan = out._jdf.queryExecution().toString()
    assert "FlatMapGroupsInArrow" not in plan  # a group of part and queries gave k rows a query for each part
    found = out.collect()
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in df.collect()}
    right = {(q, i + 1, v) for q in range(0, 1200, 10) for i, (_, v) in enumerate(sorted((-(x[v] @ x[q]), v) for v in x if v != q)[:5])}
    assert len(found) == 600 and len({(r["query_id"], r["rank"], r["vec_id"]) for r in found} & right) >= 540


def test_words_met_first_are_remembered_when_the_memo_is_full():
    encoder, words = token_files.Encoder(TOKENIZER, remembered=20), [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    texts = [" ".join(["the", *words[:5]]), *[f"{a} {b}, {a}é {i}." for i, (a, b) in enumerate(zip(words[5:], words[6:]))]]
    texts = [*texts[:13], texts[0]]
    assert [np.frombuffer(encoder.encode(t), "<u4").tolist() + [0] for t in texts] == whole_ids(texts)
    assert encoder.forgotten and all(w in encoder.after for w in words[:5]) and len(encoder.after) <= 20  # all were forgotten at once
    many = [f"{a} {b}; {a}{b}" for a in words for b in words[:3]]
    assert [np.frombuffer(encoder.encode(t), "<u4").tolist() + [0] for t in many] == whole_ids(many)
    assert encoder.forgotten > 8 and words[0] in encoder.after and len(encoder.after) <= 20


def test_a_run_of_documents_looks_up_each_part_once():
    encoder, rnd = token_files.Encoder(TOKENIZER, remembered=5), random.Random(8)
    words, asked, tokenize = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)], [], encoder.tokenize
    encoder.tokenize = lambda piece: asked.append(piece) or tokenize(piece)
    texts = [" ".join(rnd.choice(words) + rnd.choice(["", ",", "."]) for _ in range(50)) for _ in range(100)]
    got = encoder.encode_column(pa.array(texts))
    assert [np.frombuffer(ids, "<u4").tolist() + [0] for ids in got] == whole_ids(texts)
    assert len(asked) <= 2 * len(words) + 8  # behind a space or not, and the marks; thousands when each word of a full memo was encoded again


def test_a_run_of_odd_documents():
    rnd = random.Random(9)
    pieces = ["a", "The", "é", "ñ", "×", "÷", "中", "'s", "it's", ",", ".", "?!", ":'s", " ", " ", "  ", "\n", "\n\n", "\r\n", "\t", "9", "€", "\x1c", "\x85", "\xa0", "\u2003",
              "\u3000", "\u200b", "\u0301", "\0", "<|endoftext|>", "...", "x" * 90]
    texts = [rnd.choice([None, ""]) if rnd.random() < 0.1 else "".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 30))) for _ in range(20_000)]
    expected = [struct.pack(f"<{len(ids) - 1}I", *ids[:-1]) for ids in whole_ids(texts)]
    for kept in (5, 100_000):
        encoder, got = token_files.Encoder(TOKENIZER, remembered=kept), []
        whole = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"]).slice(3)
        ids = []
        for run in token_files.runs(iter([whole.slice(0, 7000), whole.slice(7000, 0), whole.slice(7000)]), 1, 3000):
            ids += run.column(0).to_pylist()
            got += encoder.encode_column(run.column(1))
            assert run.num_rows == 1 or sum(len((t or "").encode()) for t in run.column(1).to_pylist()[1:]) <= 3000
        assert ids == list(range(3, len(texts))) and got == expected[3:]
    assert encoder.encode_column(pa.array([], pa.string())) == [] and encoder.encode_column(pa.array([None, ""], pa.string())) == [b"", b""]
    other = token_files.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert other.encode_column(pa.array(["Two words", None])) == [other.encode("Two words"), b""]


def test_a_worker_that_reads_holds_no_encoder():
    import tokenizers

    held = token_files.encoder_of(TOKENIZER)
    assert token_files.encoder_of(TOKENIZER) is held
    assert list(token_files._decompressed(iter([]), b"")) == [] and "_equiscope_encoders" not in vars(tokenizers)
    assert token_files.encoder_of(TOKENIZER) is not held
