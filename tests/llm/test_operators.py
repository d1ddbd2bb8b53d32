"""The operators against brute force, on odd rows and on the small tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from equiscope.llm import ann, bpe, hyperminhash, lang_id, licenses, mixing, queries, radix_dedup, shards, warc, weak_quality

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(queries.VOCABULARY)
RANKS = bpe.read_ranks(PATH)
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def linked(texts: dict, n: int, percent: int) -> dict:
    """Least id of each id's component, by comparing all pairs."""
    sets = {i: hyperminhash.shingle_set(hyperminhash.word_list(t), n) for i, t in texts.items()}
    least = {i: i for i in texts}
    for _ in texts:
        before = dict(least)
        for a in texts:
            for b in texts:
                if a < b and least[a] != least[b] and hyperminhash.similar(sets[a], sets[b], percent):
                    low = min(least[a], least[b])
                    least = {i: low if v in (least[a], least[b]) else v for i, v in least.items()}
        if before == least:
            return least


# ------------------------------------------------------------------- op 8
def test_encoding_is_tiktokens_and_decodes(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(["a", "th", "é", "ing", " ", "  ", "\n", "9", "'s", "€", "日本"]) for _ in range(rnd.randint(0, 40))) for _ in range(300)]
    texts += [r["text"] for r in table(spark, "documents").select("text").collect()] + ["x" * 9000 + "ab" * 5000]
    encoder = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    for t in texts:
        ids = np.frombuffer(encoder.encode(t), np.int32).tolist()
        assert ids == TIKTOKEN.encode_ordinary(t)
        decoder = bpe.Decoder(encoder.machine.bytes_of)
        assert "".join(decoder.feed([i]) for i in ids) + decoder.finish() == t


def test_small_tables_and_windows_change_nothing():
    machine, small = bpe.Transducer(RANKS), bpe.Transducer(RANKS, max_states=20, window=8)
    for piece in (b"internationalization" * 3, "Donaudampfschifffahrt€é".encode(), b"aaaaaaaaaaaaaaab"):
        assert machine.encode(piece) == small.encode(piece) == bpe.merge_bytes(piece, RANKS)


def test_utf8_machine():
    rnd = random.Random(6)
    for _ in range(3000):
        b = bytes(rnd.choice([rnd.randint(0, 255), 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0xED, 0x41]) for _ in range(rnd.randint(0, 9)))
        decoder = bpe.Decoder({i: bytes([i]) for i in range(256)})
        cut = rnd.randint(0, len(b))
        assert decoder.feed(b[:cut]) + decoder.feed(b[cut:]) + decoder.finish() == b.decode("utf-8", "replace")


def test_encode_odd_rows(spark, odd_docs):
    rows = bpe.decode(bpe.encode(odd_docs, PATH, public_tokenizers.PATTERN, out="kept"), PATH, ids="kept").collect()
    assert len(rows) == 10 and all(r["decoded"] == (r["text"] or "") for r in rows)
    assert all(list(r["kept"]) == TIKTOKEN.encode_ordinary(r["text"] or "") for r in rows)
    assert bpe.encode(odd_docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
    assert sorted(map(str, bpe.round_trip(odd_docs, PATH, public_tokenizers.PATTERN, ids="kept").collect())) == sorted(map(str, rows))
    assert bpe.round_trip(odd_docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(spark.createDataFrame([([10**6],)], "token_ids array<int>"), PATH).collect()


def test_pair_stability_is_that_of_the_merges():
    machine, draw = bpe.Transducer(RANKS), random.Random(3)
    whole = [w for w, t in RANKS.items() if t not in machine.never]
    for _ in range(20_000):
        word, after = draw.choice(whole), draw.choice(whole)
        cut = draw.randrange(1, len(word)) if len(word) > 1 else 1  # cut tokens merge back, drawn pairs mostly don't
        for a, b in ((word, after), (word[:cut], word[cut:])):
            a, b = RANKS.get(a), RANKS.get(b)
            if a is not None and b is not None and not {a, b} & machine.never:
                made = bpe.merge_bytes(machine.bytes_of[a] + machine.bytes_of[b], RANKS)
                assert machine._pair_stable(a, b) == (made == [a, b])


# ------------------------------------------------------------------- op 2
def test_radix_groups_odd_rows(spark, odd_docs):
    rows = radix_dedup.radix_dedup(odd_docs, first=10, most=64).collect()
    shuffled = radix_dedup.radix_dedup(odd_docs, first=10, most=64, most_broadcast=-1).collect()
    assert sorted(map(str, shuffled)) == sorted(map(str, rows))
    assert len(rows) == 10 and rows[0].asDict().keys() == {"doc_id", "text", "source", "keep_id", "group_size", "kept"}
    by = defaultdict(list)
    for r in rows:
        by["".join((r["text"] or "").split())].append(r)
    for group in by.values():
        assert sum(r["kept"] for r in group) == 1 and {r["group_size"] for r in group} == {len(group)}
        best = min(group, key=lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"]))
        assert {r["keep_id"] for r in group} == {best["doc_id"]} and next(r for r in group if r["kept"])["doc_id"] == best["doc_id"]
    assert radix_dedup.radix_dedup(odd_docs.limit(0)).count() == 0


# ------------------------------------------------------------------- op 9
def test_near_duplicates_odd_rows(spark, odd_docs):
    rows = hyperminhash.near_duplicates(odd_docs, shingle=2).collect()
    assert len(rows) == 10
    component = {r["doc_id"]: r["component_id"] for r in rows}
    assert component == {1: 1, 2: 1, 3: 3, 4: 4, None: None, 5: 5, 6: 5, 7: 7, 8: 8}
    assert sum(r["kept"] for r in rows) == 7 and {r["n_shingles"] for r in rows if r["doc_id"] in (3, 4, 7)} == {0}
    assert hyperminhash.near_duplicates(odd_docs.limit(0)).count() == 0


def test_near_duplicates_brute_force(spark):
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(40)]
    texts = {}
    for g in range(12):
        base = [rnd.choice(words) for _ in range(rnd.choice([3, 9, 30, 80]))]
        for _ in range(10):
            t = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 8))):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            texts[len(texts)] = " ".join(t)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for n in (2, 5):
        got = {r["doc_id"]: r["component_id"] for r in hyperminhash.near_duplicates(docs, shingle=n).collect()}
        assert got == linked(texts, n, 80)


def test_short_texts_draw_four_times():
    rng, agree = np.random.default_rng(4), defaultdict(list)
    sketcher = hyperminhash.Sketcher(1)
    for size in (1, 5, 20, 100, 2000):
        for _ in range(60):
            words = [f"{rng.integers(1 << 40)}".encode() for _ in range(size)]
            other = [f"{rng.integers(1 << 40)}".encode() for _ in range(size // 9)]  # similarity near 0.8
            a, b = words, words[len(other):] + other
            keys = hyperminhash.band_keys(np.stack([sketcher.sketch(a)[1], sketcher.sketch(b)[1]]))
            agree[size].append((keys[0] == keys[1]).mean())
            apart = sketcher.sketch(words[:1] + [f"x{i}{size}".encode() for i in range(9)])[1], sketcher.sketch(words[:1] + [f"y{i}{size}".encode() for i in range(9)])[1]
            agree[-size].append((np.diff(hyperminhash.band_keys(np.stack(apart)), axis=0) == 0).mean())
    assert agree[1] == [1.0] * 60 and all(np.mean(agree[s]) > 0.3 and min(agree[s]) > 0 for s in (5, 20, 100, 2000))
    assert all(np.mean(agree[-s]) < 0.05 for s in (1, 5, 20, 100, 2000))  # one common shingle of ten makes hardly a key


# ------------------------------------------------------------------- op 3
def test_mixture_meets_targets(spark):
    rows = mixing.mix(table(spark, "documents"), shards=8, blocks=256).collect()
    taken, target, longest, sizes = Counter(), {}, Counter(), Counter()
    for r in rows:
        taken[r["source"]] += r["taken"]
        target[r["source"]], longest[r["source"]] = r["target"], max(longest[r["source"]], r["size"])
        sizes[r["source"]] += r["size"]
        assert r["taken"] == r["size"] * len(r["shards"]) <= 2 * r["size"]
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in target)
    assert abs(sum(target.values()) - 1.5 * sum(sizes.values())) < 1


def test_tree_keeps_quotas(spark):
    quotas = {0: 100, 1: 7, 2: 0, 3: 1}
    leaves = mixing.split_quotas(spark.createDataFrame(list(quotas.items()), "place long, quota long"), 8, 3).collect()
    by_place, by_shard = Counter(), Counter()
    for r in leaves:
        by_place[r["place"]] += r["n"]
        by_shard[r["shard"]] += r["n"]
    assert {p: q for p, q in quotas.items() if q} == dict(by_place) and set(by_shard.values()) <= {13, 14}


def test_mixture_odd_rows(spark, odd_docs):
    mixed = mixing.mix(odd_docs, shards=4, blocks=16)
    assert mixed.count() == 10 and mixing.mix(odd_docs.limit(0), shards=4).count() == 0
    assert mixing.drawn_copies(mixed).count() == sum(len(r["shards"]) for r in mixed.collect())


def test_texts_meet_their_shards_without_a_shuffle_at_any_size(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.format_string("some words of %d", "id").alias("text"), F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("string")).alias("source"))
    docs = docs.unionByName(docs.where("doc_id % 1000 = 0"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "60000")  # as if there were far more documents
    try:
        mixed = mixing.mix(docs, shards=4, blocks=64)
        rows = mixed.select("source", "size", "target", "taken", "shards").collect()
        plan = mixed._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan, plan
    assert len(rows) == 30_030 and len({s for r in rows for s in r["shards"]}) == 4
    for source in (None, "1", "2"):
        own = [r for r in rows if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 4 and all(r["taken"] == r["size"] * len(r["shards"]) for r in own)


# ------------------------------------------------------------------- op 7
def test_minimax_is_smallest(spark):
    rows = shards.minimax_shards(table(spark, "documents"), shards=5).collect()
    groups = defaultdict(lambda: [10**9, 0])
    for r in rows:
        g = groups[r["text"]]
        g[0], g[1] = min(g[0], r["doc_id"]), g[1] + len(r["text"].encode()) + 1
        assert r["text_crc32"] == zlib.crc32(r["text"].encode())
    sizes = [s for _, s in sorted(groups.values())]

    def fits(capacity):
        used, room = 0, 0
        for s in sizes:
            if s > capacity:
                return False
            if s > room:
                used, room = used + 1, capacity
            room -= s
        return used <= 5

    least = max(Counter({s: sum(r["size"] for r in rows if r["shard"] == s) for s in range(5)}).values())
    assert fits(least) and not fits(least - 1)
    assert all(len({r["shard"] for r in rows if r["text"] == t}) == 1 for t in groups)
    for s in range(5):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_shards_odd_rows(spark, odd_docs):
    rows = shards.minimax_shards(odd_docs, shards=3).collect()
    assert len(rows) == 10 and shards.minimax_shards(odd_docs.limit(0)).count() == 0
    assert len({r["shard"] for r in rows if not r["text"]}) == 1


# ------------------------------------------------------------------- op 5
def test_warc_round_trip_of_odd_pages(spark):
    html = "WARC/1.1\r\n\r\n0\r\n\r\n" + "é" * 9000
    pages = spark.createDataFrame([(1, "http://a/b c", html), (2, None, html), (3, "u", None), (None, "u", "null id"), (4, "u", ""), (5, "u", "x")], "page_id long, url string, html string")
    from equiscope.llm.util import Scratch
    path = Scratch(spark, "t").path("a")
    warc.write_archives(pages, path, segment=1000)
    segments = warc.read_segments(spark, path)
    assert segments.where("type = 'continuation'").count() > 10
    rows = {r["page_id"]: r for r in warc.reassemble(segments).collect()}
    assert rows[2]["payload"].decode() == html and rows[1]["type"] == "revisit" and rows[1]["refers_to"] == 2
    assert rows[3]["refers_to"] == 4 and rows[None]["payload"] == b"null id" and all(r["problem"] is None for r in rows.values())
    broken = warc.reassemble(segments.where("segment != 3")).where("problem IS NOT NULL").collect()
    assert [r["problem"] for r in broken] == ["segments"]


def test_chunk_sizes_are_hexadecimal_and_bounded():
    for bad in (b"1\r\nA\r\n-6\r\nzz", b"+1\r\nA\r\n0\r\n\r\n", b"1_0\r\n" + b"x" * 16 + b"\r\n0\r\n\r\n", b"f" * 5000 + b"\r\n", b"f" * 16 + b"\r\nA\r\n0\r\n\r\n", b"\r\n", b"3\r\nab", b"", b"0x1\r\nA\r\n0\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(bad)
    assert warc.unchunked(b"2;x=1\r\nab\r\n0\r\nTrailer: 1\r\n\r\n") == b"ab"


def member(n, body=None, kind="response", digest=None, **more):
    body = b"page %d" % n if body is None else body
    message = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(body)
    heads = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:r:{n}>"), ("WARC-Payload-Digest", digest or f"sha1:{warc.sha1_base32(body)}"), ("X-Page-Id", str(n))]
    return warc.record(heads + [(k.replace("_", "-"), v) for k, v in more.items()], message) + b"\r\n\r\n"


def test_damaged_and_hostile_archives_are_counted(spark):
    import gzip
    import os

    pack = lambda n: gzip.compress(member(n))
    sha256 = hashlib.sha256(b"page 31")
    archives = {
        "foreign": b"no record\r\nat all\r\n" + member(1) + b"between\r\n" + member(2),
        "no length": b"WARC/1.1\r\nWARC-Type: response\r\n\r\nbody\r\n" + member(3),
        "negative": b"WARC/1.1\r\nContent-Length: -5\r\n\r\nbody" + member(4) + b"\r\n\r\n" + member(5),
        "huge": member(6) + b"WARC/1.1\r\nContent-Length: 99999999999999999\r\n\r\nbody",
        "no number": b"WARC/1.1\r\nContent-Length: 1e3\r\n\r\n\r\n" + member(7),
        "endless line": b"WARC/1.1\r\nX: " + b"x" * 200_000 + b"\r\n" + member(8),
        "cut": member(9) + member(10)[:-30],
        "cut gzip": pack(11) + pack(12)[:-20],
        "damaged gzip": pack(13) + pack(14)[:30] + b"?" * 40 + pack(15) + b"\0" * 100,
        "cut head": member(16) + b"WARC/1.1\r\nWARC-Type: resp",
        "no type": b"WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n" + member(17),
        "numbers": member(18, WARC_Segment_Number="1e9") + member(19, WARC_Segment_Number="9" * 30) + member(20),
        "hexadecimal": member(31, digest=f"SHA-256:{sha256.hexdigest()}") + member(32, digest="sha1:AAAA") + member(33, digest="whirlpool:1") + member(34, "sömething €".encode() * 900),
        "empty": b"", "plain gzip": gzip.compress(b"no record"),
    }
    from equiscope.llm.util import Scratch
    scratch = Scratch(spark, "t")
    folder = scratch.path("hostile")
    os.makedirs(folder.removeprefix("file:"))
    for name, data in archives.items():
        with open(f"{folder.removeprefix('file:')}/{name.replace(' ', '-')}.warc", "wb") as f:
            f.write(data)
    problems = {name: [p for _, _, p in warc.parse_archive(data) if p] for name, data in archives.items()}
    assert problems == {"foreign": ["foreign"] * 2, "no length": ["length"], "negative": ["length"], "huge": ["cut"], "no number": ["length"], "endless line": ["header"],
                        "cut": ["cut"], "cut gzip": ["cut", "gzip"], "damaged gzip": ["gzip"], "cut head": ["cut"], "no type": [], "numbers": [], "hexadecimal": [],
                        "empty": [], "plain gzip": ["foreign"]}
    rows = queries.archived_pages(scratch, folder).collect()
    whole = sorted(r["page_id"] for r in rows if r["problem"] is None)
    assert whole == [1, 2, 3, 5, 6, 7, 8, 9, 11, 13, 15, 16, 17, 20, 31, 33, 34]  # 4 begins inside a line of the record before it
    assert Counter(r["problem"] for r in rows if r["problem"]) == {"foreign": 3, "length": 3, "cut": 4, "header": 4, "gzip": 2, "digest": 1}


def test_every_cut_of_an_archive_ends():
    import gzip

    plain = member(1) + member(2)
    for data in (plain, gzip.compress(member(1)) + gzip.compress(member(2))):
        whole = [n for at in range(len(data) + 1) for n in [sum(p is None for _, _, p in warc.parse_archive(data[:at]))]]
        assert whole == sorted(whole) and whole[-1] == 2
    rnd = random.Random(3)
    for _ in range(300):
        data = bytearray(rnd.choice((plain, gzip.compress(plain))))
        for _ in range(rnd.randint(1, 5)):
            data[rnd.randrange(len(data))] = rnd.randrange(256)
        list(warc.parse_archive(bytes(data)))


def test_warc_query_is_brute_force(spark):
    pages = table(spark, "pages").collect()
    body = {r["page_id"]: (r["html"] or "").encode() for r in pages}
    winner = {}
    for i, b in body.items():
        winner[b] = max(i, winner.get(b, i))
    expected = {(i, len(b), warc.sha1_base32(b), "response" if winner[b] == i else "revisit", None if winner[b] == i else winner[b], None) for i, b in body.items()}
    rows = [tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")) for r in queries.op5_warc(spark, SF).collect()]
    assert len(rows) == len(pages) and set(rows) == expected


def test_a_lost_original_leaves_its_revisits(spark):
    from equiscope.llm.util import Scratch
    scratch = Scratch(spark, "t")
    path = scratch.path("a")
    warc.write_archives(spark.createDataFrame([(1, "u", "x"), (2, "u", "x")], "page_id long, url string, html string"), path)
    segments = warc.read_segments(spark, path).where("page_id = 1")
    original, warc.read_segments = warc.read_segments, lambda *_: segments
    try:
        rows = queries.archived_pages(scratch, path).collect()
    finally:
        warc.read_segments = original
    assert [(r["page_id"], r["payload_bytes"], r["record_type"], r["problem"]) for r in rows] == [(1, None, "revisit", "original")]


# ------------------------------------------------------------------- op 4
def test_licence_rules(spark):
    mit = "\n".join(t[0] for k, t in licenses.SENTENCES.items() if k in ("mit-grant", "mit-notice", "mit-asis")).replace("to deal in", "to\ndeal in")
    rows = [(1, "x | y |\nReleased under the MIT License.\nz"), (2, "Intro.\n" + mit), (3, None), (4, ""), (5, "nothing here"), (6, "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software.")]
    found = {r["doc_id"]: (r["licenses"], r["unmatched_ids"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: (["MIT"], []), 2: (["MIT"], []), 3: ([], []), 4: ([], []), 5: ([], []), 6: ([], ["mit-notice"])}
    import re
    for sentence in licenses.sentence_table():
        assert any(re.sub(r"[^a-z0-9]+", " ", t) in sentence for t in licenses.TRIGGERS) or "software" in sentence, sentence


def test_wrapped_and_commented_licences(spark):
    import textwrap
    wrap = lambda *names: "\n".join(textwrap.fill(licenses.SENTENCES[n][0], 60) for n in names)
    mit = "Copyright (c) 2020 X\n" + wrap("mit-grant") + "\n\n" + wrap("mit-notice") + "\n\n" + wrap("mit-asis")
    leaders = lambda s, first, lead, last: first + "\n".join((lead + x).rstrip() for x in s.split("\n")) + last
    texts = [mit, leaders(mit, "", "# ", "\nimport os"), leaders(mit, "/*\n", " * ", "\n */\nint x"), leaders("MIT License\n" + mit, "", "// ", "\ncode"),
             leaders(mit, "", ";; ", "").replace("\n", "\r\n")]
    docs = spark.createDataFrame([*enumerate(texts), (9, "Copyright 2020 X\n" + wrap("isc-grant")), (10, "# Permission to use,\n# copy and\n# sell")], "doc_id long, text string")
    found = {r["doc_id"]: (r["licenses"], r["unmatched_ids"]) for r in licenses.scan(docs).collect()}
    assert found == {**{i: (["MIT"], []) for i in range(len(texts))}, 9: (["ISC"], []), 10: ([], [])}


# ------------------------------------------------------------------- op 6
def test_quality_against_labels(spark, odd_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = weak_quality.quality(docs, keep_columns=["doc_id"]).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    good, bad = [r["kept"] for r in rows if r["quality"] == 1], [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.25
    odd = {r["doc_id"]: r["score"] for r in weak_quality.quality(odd_docs).collect()}
    assert odd[3] == odd[4] == odd[7] == 0.0 and weak_quality.quality(odd_docs.limit(0)).count() == 0


def test_measures_are_those_of_patterns():
    import re

    rnd, plain = random.Random(11), weak_quality.PlainWords()
    bits = [b"a", b"Zeb", b"\xc3\xa9", b"|", b"!", b"don't", b"ok.", b"9", b"12", b" ", b"\n", b"\t", b"\x0b", b"\x00", b"\x1f", b"\x7f", b"#$", b"^", b"end!", b"..", b"word " * 9, b"x" * 90]
    for _ in range(400):
        t = b"".join(rnd.choice(bits) for _ in range(rnd.randint(1, 120)))
        if not (words := t.split()):
            continue
        n, size = len(words), max(1, len(re.sub(rb"\s+", b"", t)))
        upper, lower = len(re.findall(rb"[A-Z]", t)), len(re.findall(rb"[a-z]", t))
        found = dict(zip([name for name, _, _ in weak_quality.LABELLERS], weak_quality.shares(t, plain)))
        assert found["marks"] == len(re.findall(rb"[#$%&*+/<=>@\\^_`{}~\x00-\x08\x0e-\x1f\x7f]", t)) / size
        assert found["bars"] == sum(w == b"|" for w in words) / n and found["digits"] == len(re.findall(rb"[0-9]", t)) / size
        assert found["capitals"] == (upper / (upper + lower) if upper + lower >= 20 else 0.2)
        assert found["stutter"] == sum(a == b for a, b in zip(words, words[1:])) / n
        assert found["odd_words"] == 1 - len(re.findall(rb"(?<![^\s])[A-Za-z\x80-\xff'-]+[.,;:?!]?(?![^\s])", t)) / n


# ------------------------------------------------------------------- op 10
def test_languages(spark, odd_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = lang_id.fit(docs, "text", "lang", "doc_id")
    rows = lang_id.identify(docs.drop("n_chars"), model, "text", keep_columns=["lang"]).collect()  # by the text alone
    assert sum(r["lang"] == r["language"] for r in rows) / len(rows) > 0.97
    wrong = docs.withColumn("declared", F.lit("xx-YY"))
    assert lang_id.identify(wrong, model, "text", declared="declared", host="source").where("rejected").count() == 0
    odd = lang_id.identify(odd_docs, model, "text", host="source").collect()
    assert len(odd) == 10 and {r["doc_id"] for r in odd if r["language"] == "und"} >= {3, 4, 7}
    assert lang_id.identify(odd_docs.limit(0), model, "text").count() == 0


def invented(n: int, seed: int = 4) -> dict[str, list[str]]:
    """Vocabularies of languages with syllables of their own."""
    rnd = random.Random(seed)
    names = [a + b for a in "abcdefghijk" for b in "abcdefghijk"][:n]
    letters = "abcdefghijklmnopqrstuvwxyzäöüéèñßøåčšž"
    vocabulary = {}
    for name in names:
        syllables = ["".join(rnd.sample(letters, 3)) for _ in range(12)]
        vocabulary[name] = ["".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 3))) for _ in range(60)]
    return vocabulary


def test_every_declared_language_is_modelled(spark):
    rnd, words = random.Random(8), invented(70)
    rows = [(name, " ".join(rnd.choice(words[name]) for _ in range(40))) for name in words for _ in range(3000 if name == "aa" else 3)]
    rows += [("ww-WW", "always the same")] * 300 + [("und", "of no language"), ("yy", "12 34"), (None, "undeclared")]
    docs = spark.createDataFrame([(i if lang != "ww-WW" else None, lang, t) for i, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string")
    model = lang_id.fit(docs, "text", "lang", "doc_id", sample=40)
    assert model.languages == sorted([*words, "ww"])
    found = lang_id.identify(docs.where("length(lang) = 2 AND lang != 'yy'"), model, "text", declared="lang").collect()
    assert len(found) == 3000 + 69 * 3 and all(r["language"] == r["lang"] for r in found)


def test_texts_of_no_modelled_language_are_rejected(spark):
    foreign = ["Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza.",
               "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
               "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
               "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
               "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。", "xq9 zzkj qwx jjfk vvbq 884 kkxz pqzw xxyq zjq wvkx qqqz bxkd"]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    model, most = lang_id.fit(docs, "text", "lang", "doc_id"), docs.groupBy("source").count().orderBy(F.desc("count")).first()["source"]
    both = docs.union(spark.createDataFrame([(-1 - i, t, "en", most) for i, t in enumerate(foreign)], docs.schema))  # with the wrong tag, at the largest host
    rows = lang_id.identify(both, model, "text", declared="lang", host="source").collect()
    assert {r["doc_id"] for r in rows if r["rejected"]} == set(range(-len(foreign), 0)) and all(r["language"] == "und" for r in rows if r["rejected"])
    alone = lang_id.identify(both, model, "text").collect()
    assert {r["doc_id"] for r in alone if r["rejected"]} == set(range(-len(foreign), 0))


# ------------------------------------------------------------------- op 1
def test_search_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [1.0]), (None, x[0].tolist())]
    rows += [(10_000 + i, x[5].tolist()) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.search(df, F.col("vec_id") % 20 == 0, rows_a_part=300).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    ids = np.array([i for i, v in rows if i is not None and v is not None and len(v) == 16 and np.isfinite(v).all() and any(v)])
    all_x = np.array([v for i, v in rows if i is not None and v is not None and len(v) == 16 and np.isfinite(v).all() and any(v)])
    hits = total = 0
    for at in np.flatnonzero(ids % 20 == 0):
        s = (all_x * all_x[at]).sum(1)
        s[at] = -np.inf
        hits += len(set(ids[np.lexsort((ids, -s))[:20]]) & set(got[ids[at]]))
        total += 20
        assert len(got[ids[at]]) == 20
    assert hits / total >= 0.9
    assert ann.search(df.limit(0), F.lit(True)).count() == 0


# --------------------------------------------------------------- pipeline
def test_pipeline(spark):
    import corpus_pipeline
    docs = table(spark, "documents")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "bpe":
            assert out.columns == docs.columns
        if name == "exact_dedup":
            texts = [hashlib.sha256("".join((r["text"] or "").split()).encode()).hexdigest() for r in out.collect()]
            assert len(texts) == len(set(texts)) == len({"".join((r["text"] or "").split()) for r in docs.collect()})
        if name == "near_dedup":
            before = {r["doc_id"]: r["text"] for r in docs.collect()}
            least = linked(before, 5, 80)
            assert {r["doc_id"] for r in out.collect()} == set(least.values())
        docs = out.cache()
    assert all(list(r["token_ids"]) for r in docs.collect())
    empty = table(spark, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0
