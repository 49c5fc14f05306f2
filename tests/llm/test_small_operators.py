"""The numbered operators without pairs, against brute force on small fixtures."""

import base64
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from changeloom.llm import decontaminate as decon
from changeloom.llm import pieces, quality, sharding, transport_stream, warc
from changeloom.llm import queries as Q
from changeloom.llm.common import stored

SF = "/root/testdata/sf0.001"
#: Nulls in any column, empty and long texts, repeated rows, clashing names.
ODD = "doc_id long, text string, score string, rid string, id int, key int, salt int, size int, shard int"


def odd_docs(spark, texts):
    rows = [(k if k % 5 else None, t, None, "x", 1, None, 2, 3, 4) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[:2], ODD)


TEXTS = [None, "", "  ", "a", "a a a", "é ﬁ 中 \x00 tail", "word " * 30_000, "same text", "same text", "x" * 70_000]


def windows(words, n=10):
    return [tuple(words[k : k + n]) for k in range(len(words) - n + 1)] if len(words) >= n else [tuple(words)] if words else []


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_decontamination(docs, items):
    out = []
    for doc, text in docs:
        words, hit, found = split(text), set(), set()
        for item, item_text in items:
            for w in windows(split(item_text)):
                for at in range(len(words) - len(w) + 1):
                    if tuple(words[at : at + len(w)]) == w:
                        hit.update(range(at, at + len(w)))
                        found.add(str(item)) if item is not None else None
        out.append((doc, len(words), len(hit), sorted(found)))
    return sorted(out, key=repr)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["Aa", "b", "c", "dé", "e1"]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 4, 9, 10, 11, 25])))) for k in range(25)] + [(3, None), (None, "zz yy")]
    docs = []
    for k in range(60):
        parts = [rng.choice(items)[1] or "" if rng.random() < 0.3 else " ".join(rng.choice(vocabulary + ["q", "r"]) for _ in range(12)) for _ in range(3)]
        docs.append((k if k % 9 else None, rng.choice([" ", "\n", ", "]).join(parts)))
    docs += [(70, None), (71, ""), (72, "zz yy"), (72, "zz yy"), (73, "ab " * 20_000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS rid", "'x' AS hash", "2 AS salt", "3 AS pos")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS item", "1 AS hash")
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in decon.decontaminate(frame, bench).collect()]
    assert sorted(got, key=repr) == brute_decontamination(docs, items)


def test_decontamination_of_given_tables_and_empty_ones(spark):
    docs, items = Q.table(spark, SF, "documents"), Q.table(spark, SF, "benchmark")
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in decon.decontaminate(docs, items).collect()), key=repr)
    by_window = {}
    for r in items.collect():
        for w in windows(split(r["text"])):
            by_window.setdefault(w, set()).add(str(r["item_id"]))
    for doc_id, text in docs.select("doc_id", "text").collect():
        words, hit, found = split(text), set(), set()
        for at in range(len(words) - 9):
            if (w := tuple(words[at : at + 10])) in by_window:
                hit.update(range(at, at + 10))
                found |= by_window[w]
        assert (doc_id, len(words), len(hit), sorted(found)) in got
    assert any(n for _, _, n, _ in got)
    assert decon.decontaminate(docs.limit(0), items).count() == 0
    assert decon.decontaminate(docs.limit(3), items.limit(0)).where("contaminated").count() == 0


def test_quality_on_held_out_rows(spark):
    docs = Q.op1_quality(spark, SF).join(Q.table(spark, SF, "labels"), "doc_id").where("quality IS NOT NULL").collect()
    held = [r for r in docs if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in docs)
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.9 * len(held)
    good = [r for r in held if r["quality"]]
    assert sum(r["predicted"] for r in good) >= 0.97 * len(good)
    assert all(0 <= r["score"] <= 1 for r in docs)


def test_quality_of_odd_rows(spark):
    docs = odd_docs(spark, TEXTS)
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (3, None), (4, 7)], "doc_id long, quality int")
    rows = quality.training_rows(docs.select("doc_id", "text"), labels, "quality")
    assert rows.where("doc_id IS NULL").count() == 0
    for fitted in (rows, rows.limit(0)):
        model = quality.fit(fitted, "text", "quality", "doc_id", bits=10)
        scores = [r[0] for r in docs.select(model.score(docs["text"], spark)).collect()]
        assert len(scores) == len(TEXTS) + 2 and all(0 <= s <= 1 for s in scores)
    assert set(scores) == {0.5}


def brute_features(text, bits, max_n):
    """Counts by feature number, n-gram by n-gram, with integers of any size."""
    tokens = re.findall(rb"[0-9A-Za-z_\x80-\xff]+|[^\s0-9A-Za-z_\x80-\xff]+", (text or "").encode())
    mod, counts = 1 << 64, {}

    def count(gram):
        gram = (gram ^ gram >> 29) * 0xBF58476D1CE4E5B9 % mod
        number = gram >> 32 & (1 << bits) - 1
        counts[number] = counts.get(number, 0) + 1

    for n in range(1, max_n + 1):
        for k in range(len(tokens) - n + 1):
            gram = 0
            for t in tokens[k : k + n]:
                gram = (gram * 0x9E3779B97F4A7C15 + zlib.crc32(t)) % mod
            count(gram)
    return counts


def brute_vector(text, bits, max_n):
    counts = brute_features(text, bits, max_n)
    length = sum(c * c for c in counts.values()) ** 0.5
    return {i: quality.SCALE * c / length for i, c in counts.items()} | {"intercept": 1.0, "empty": math.log(1 + sum(counts.values()))}


def test_quality_model_equals_brute_force(spark):
    """Training and scores, feature by feature, from the definition."""
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice(["good", "fine", "so", "no", "no!"][: 3 + 2 * (k % 3 > 0)]) for _ in range(rng.randrange(30))), int(k % 3 > 0)) for k in range(60)]
    bits, max_n, alpha, beta, l1, l2 = 10, 2, 0.5, 1.0, 0.002, 0.01
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.fit(frame, "text", "quality", "doc_id", shards=2, bits=bits, max_n=max_n, epochs=2, alpha=alpha, beta=beta, l1=l1, l2=l2)
    orders = {r[0]: r[1] for r in frame.selectExpr("doc_id", "xxhash64(doc_id)").collect()}
    total, used = {}, 0
    for shard in (0, 1):
        part = sorted((r for r in rows if orders[r[0]] % 2 == shard), key=lambda r: orders[r[0]])
        z, n = {}, {}
        heavy = [(len(part) / 2 / sum(r[2] == label for r in part)) ** 0.5 for label in (0, 1)]

        def weight(i):
            if abs(z.get(i, 0.0)) <= l1:
                return 0.0
            return -(z[i] - (l1 if z[i] > 0 else -l1)) / ((beta + n[i] ** 0.5) / alpha + l2)

        for _ in range(2):
            for _, text, label in part:
                x = brute_vector(text, bits, max_n)
                p = 1 / (1 + 2.718281828459045 ** -sum(weight(i) * v for i, v in x.items()))
                for i, v, w in [(i, v, weight(i)) for i, v in x.items()]:
                    g, old = heavy[label] * (p - label) * v, n.get(i, 0.0)
                    z[i] = z.get(i, 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / alpha * w
                    n[i] = old + g * g
        for i in z:
            total[i] = total.get(i, 0.0) + weight(i) * len(part)
        used += len(part)
    wanted = {i: w / used for i, w in total.items()}
    places = {"intercept": 1 << bits, "empty": (1 << bits) + 1}
    assert all(abs(model.weights[places.get(i, i)] - w) < 1e-4 for i, w in wanted.items())
    assert set(np.flatnonzero(model.weights)) <= {places.get(i, i) for i in wanted}
    for text in ("good so so", "", "no! no no!", None, "unseen words"):
        margin = sum(wanted.get(i, 0.0) * v for i, v in brute_vector(text, bits, max_n).items())
        assert abs(model.score_text(text) - 1 / (1 + 2.718281828459045**-margin)) < 1e-4


def test_quality_training_is_bounded_by_entries(spark):
    """Rows behind the bound are not learnt from; those before it are, as without them."""
    rows = [(k, f"word{k} " * (1 + k % 3) + "end", k % 2) for k in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    sizes = [len(quality.vector(text, 12, 2)[0]) for text in (r["text"] for r in frame.orderBy(F.xxhash64("doc_id")).collect())]
    first = frame.orderBy(F.xxhash64("doc_id")).limit(10)
    bounded = quality.fit(frame, "text", "quality", "doc_id", shards=1, max_entries=sum(sizes[:10]), bits=12)
    alone = quality.fit(first, "text", "quality", "doc_id", shards=1, bits=12)
    assert (bounded.weights == alone.weights).all() and alone.weights.any()


def test_vectors_of_long_texts(monkeypatch):
    text = " ".join(random.Random(8).choice(["a", "b!", "ccc", "dé"]) for _ in range(900_000))
    index, value = quality.vector(text, 12, 2)
    wanted = np.bincount(np.concatenate(list(quality.features(text, 12, 2))), minlength=1 << 12)
    assert (index[:-2] == np.flatnonzero(wanted)).all() and np.allclose(value[:-2], quality.SCALE * wanted[wanted > 0] / np.sqrt((wanted.astype(float) ** 2).sum()))


def test_repeated_document_rows_add_no_training_rows(spark):
    docs = spark.createDataFrame([(1, "b", 1), (1, "b", 1), (1, "a", 2), (2, None, 3), (3, "x", 4)], "doc_id long, text string, quality_of int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1)], "doc_id long, quality int")
    rows = quality.training_rows(docs, labels, "quality").collect()
    assert sorted((r["doc_id"], r["text"], r["quality"]) for r in rows) == [(1, "a", 1), (2, None, 0)]


def test_features_do_not_depend_on_blocks(monkeypatch):

    text = " ".join(random.Random(1).choice(["a", "b!", "c c", "é"]) for _ in range(3_000))
    whole = np.sort(np.concatenate(list(quality.features(text, 12, 3))))
    monkeypatch.setattr(quality, "BLOCK", 100)
    assert (np.sort(np.concatenate(list(quality.features(text, 12, 3)))) == whole).all()


def brute_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, used, at = (low + high) // 2, 1, 0
        for s in sizes:
            used, at = (used + 1, s) if at + s > mid else (used, at + s)
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("groups", [0, 1, 5, 16, 200, 3_000])
def test_minimax_cuts_are_the_least(spark, groups):
    rng = random.Random(groups)
    rows = [(rng.randrange(-(1 << 63), 1 << 63) >> (40 if k % 2 else 0), rng.choice([1, 7, 100, 5_000])) for k in range(groups)]
    rows = list(dict(rows).items())
    capacity, cuts = sharding.minimax_cuts(spark.createDataFrame(rows, "key long, size long"), 16)
    if not rows:
        assert cuts == []
        return
    assert capacity == brute_capacity([s for _, s in sorted(rows)], 16)
    loads = {}
    for key, size in rows:
        shard = sum(key > c for c in cuts)
        loads[shard] = loads.get(shard, 0) + size
    assert max(loads.values()) == capacity and max(loads) <= 15


def test_sharding_of_odd_rows(spark):
    docs = odd_docs(spark, TEXTS)
    rows = sharding.shard_documents(docs).collect()
    assert len(rows) == len(TEXTS) + 2
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    assert all(sorted(r["slot"] for r in part) == list(range(len(part))) for part in by.values())
    assert len({r["shard"] for r in rows if r["size"] == len("same text") + 1}) == 1
    assert sorted(r["size"] for r in rows) == sorted(len((t or "").encode()) + 1 for t in TEXTS + TEXTS[:2])
    assert {r["text_crc32"] for r in rows} == {zlib.crc32((t or "").encode()) for t in TEXTS}
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_transport_stream_round_trip(spark):
    for n in [*range(0, 400, 7), 576, transport_stream.UNIT - 1, transport_stream.UNIT, transport_stream.UNIT * 9 + 5]:
        payload = random.Random(n).randbytes(n)
        found = transport_stream.demux(transport_stream.mux(payload))
        assert found["payload"] == payload and found["breaks"] == 0
        units = max(1, -(-n // transport_stream.UNIT))
        assert found["times"] == [k * transport_stream.TICKS for k in range(units)]
        assert found["random_access"] == list(range(0, units, transport_stream.RAP_EVERY))
    stream = transport_stream.mux(b"x" * 5_000)
    with pytest.raises(ValueError):
        transport_stream.demux(stream[:-1])
    with pytest.raises(ValueError):
        transport_stream.demux(stream[: 188 * 4] + stream[188 * 5 :])


def test_media_of_odd_rows(spark):
    docs = odd_docs(spark, TEXTS)
    rows = transport_stream.media_features(stored(transport_stream.with_media(docs), "media")).collect()
    want = [transport_stream.padded(t) for t in TEXTS + TEXTS[:2]]
    assert sorted(r["payload_sha256"] for r in rows) == sorted(hashlib.sha256(p).hexdigest() for p in want)
    assert all(r["payload_bytes"] % 576 == 0 and r["payload_bytes"] >= 576 for r in rows)
    assert transport_stream.media_features(transport_stream.with_media(docs.limit(0))).count() == 0


def test_media_query_equals_brute_force(spark):
    """Every column of the query, from the texts alone; the stream is taken apart by hand."""
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in Q.table(spark, SF, "documents").collect()}
    rows = Q.op8_transport_stream(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        data = texts[r["doc_id"]]
        payload = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        stream = transport_stream.mux(payload)
        parts, begins, rap = [], [], []
        for k in range(0, len(stream), 188):
            packet = stream[k : k + 188]
            pid, start, adapted = (packet[1] & 0x1F) << 8 | packet[2], packet[1] & 0x40, packet[3] & 0x20
            if pid == 0x101:
                field = packet[4] + 1 if adapted else 0
                body = packet[4 + field :]
                if start:
                    begins.append(len(begins))
                    rap += [begins[-1]] if adapted and packet[4] and packet[5] & 0x40 else []
                    body = body[9 + body[8] :]
                parts.append(body)
        assert b"".join(parts) == payload
        units = -(-len(payload) // transport_stream.UNIT)
        feature = f"packets={len(stream) // 188} breaks=0 units={units} last={(units - 1) * 3600} rap={','.join(map(str, rap))}"
        assert len(begins) == units
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(stream), hashlib.sha256(stream).hexdigest(), feature)


def test_sharding_query_is_optimal(spark):
    """The largest shard of the given documents is as small as the order of groups allows."""
    docs = Q.table(spark, SF, "documents")
    rows = Q.op5_sharding(spark, SF).collect()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {d: (len(t) + 1, zlib.crc32(t)) for d, t in texts.items()}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    groups = {}
    for t in texts.values():
        key = signed(xxhash.xxh64_intdigest(t, 42))
        groups[key] = groups.get(key, 0) + len(t) + 1
    loads, shard_of = {}, {}
    for r in rows:
        loads[r["shard"]] = loads.get(r["shard"], 0) + r["size"]
        shard_of.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    assert max(loads.values()) == brute_capacity([groups[k] for k in sorted(groups)], 16)
    assert all(len(s) == 1 for s in shard_of.values()) and set(loads) <= set(range(16))
    ordered = sorted((signed(xxhash.xxh64_intdigest(t, 42)), *s) for t, s in shard_of.items())
    assert [s for _, s in ordered] == sorted(s for _, s in ordered)
    for k in loads:
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sum(r["shard"] == k for r in rows)))


def model_file():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


def test_pieces_equal_the_library():
    import sentencepiece

    theirs, ours = sentencepiece.SentencePieceProcessor(model_file=model_file()), pieces.PieceTokenizer(model_file(), kept=50)
    rng = random.Random(5)
    atoms = ["a", "e", "t", "th", "in", "er", " ", "  ", "    ", "=", "==", "\n", " \n", "ction", "ystem", "é", "ß", "中", "1", "/", "_", ".", "▁", "𐍈", "\x00", "\t"]
    cases = ["", " ", "\n", "中" * 50, *(" " * n for n in range(1, 60)), *(" " * n + "the" for n in range(1, 40)), "=" * 90]
    cases += ["".join(rng.choice(atoms) for _ in range(rng.randint(1, 40))) for _ in range(2_000)]
    for text in cases:
        ids = theirs.encode(text)
        assert ours.encode(text) == ids, text
        assert ours.decode(ids) == theirs.decode(ids), text
        n, joined, decoded = ours.digest(text)
        assert (n, joined.decode(), decoded.decode()) == (len(ids), ",".join(map(str, ids)), theirs.decode(ids)), text
    for _ in range(500):
        ids = [rng.choice([rng.randrange(262), rng.randrange(32_000)]) for _ in range(rng.randint(0, 8))]
        assert ours.decode(ids) == theirs.decode(ids), ids


def test_pieces_of_odd_rows(spark):
    import sentencepiece

    theirs = sentencepiece.SentencePieceProcessor(model_file=model_file())
    texts = [*TEXTS, " " * 100_000, "=" * 2_000]
    rows = pieces.token_digests(odd_docs(spark, texts), model_file()).collect()
    want = [theirs.encode(t or "") for t in texts + texts[:2]]
    assert sorted(r["ids_sha256"] for r in rows) == sorted(hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in want)
    assert sorted(r["n_tokens"] for r in rows) == sorted(map(len, want))
    assert pieces.token_digests(odd_docs(spark, texts).limit(0), model_file()).count() == 0


PAGES = [(3, "http://b.example/x", "<p>one"), (1, "http://a.example/", "<p>one"), (2, None, ""), (4, "https://www.a.example/?q=1", None), (5, "::bad::[", "l1\r\n\r\nWARC/1.1\r\n"), (6, "http://a.example/\r\nX: y", "é" * 50_000), (6, "http://a.example/", "dup"), (6, "http://a.example/", "dup"), (None, "http://c.example/", "<p>one"), (None, None, "only")]


def test_warc_round_trip(spark, monkeypatch):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS first", "3 AS run")
    rows = warc.archive_round_trip(pages).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    assert sorted((r["page_id"] or 0, r["payload_digest"], r["payload_bytes"]) for r in rows) == sorted((p or 0, digest(t), len((t or "").encode())) for p, _, t in PAGES)
    kinds = {(r["page_id"], r["payload_digest"]): (r["record_type"], r["refers_to"]) for r in rows}
    assert kinds[1, digest("<p>one")] == ("response", None)
    assert kinds[3, digest("<p>one")] == kinds[None, digest("<p>one")] == ("revisit", 1)
    assert kinds[2, digest("")] == ("response", None) and kinds[4, digest("")] == ("revisit", 2)
    assert kinds[6, digest("dup")] == kinds[None, digest("only")] == ("response", None)
    keys = [(r["url_key"], r["stamp"]) for r in rows]
    assert keys == sorted(keys)
    monkeypatch.setattr(warc, "RUN_RECORDS", 2)
    monkeypatch.setattr(warc, "RANGE_RECORDS", 3)
    assert sorted(map(tuple, warc.archive_round_trip(pages).drop("place").collect()), key=repr) == sorted((tuple(r)[:-1] for r in rows), key=repr)
    large = warc.archive_round_trip(pages, min_bytes=10_000).collect()
    assert {r["record_type"] for r in large} == {"response"}
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_damaged_archives_are_errors():
    whole = [("f", b"WARC/1.1\r\nContent-Length: 6"), ("f", b"a"), ("f", b"b"), ("f", b"WARC/1.1\r\ncontent-length:0"), ("f", b"")]
    assert [(h["content-length"], p) for _, h, p in warc.records(iter(whole))] == [("6", b"a\r\n\r\nb"), ("0", b"")]
    for damaged in (whole[:2], whole[1:], [*whole[:2], ("g", b"b")], [whole[0], ("f", b"too long")]):
        with pytest.raises(ValueError):
            list(warc.records(iter(damaged)))


def test_loser_tree_merges():
    rng = random.Random(2)
    for runs in (0, 1, 2, 3, 7, 16):
        data = [sorted(rng.randrange(50) for _ in range(rng.randrange(20))) for _ in range(runs)]
        assert list(warc.LoserTree([iter(r) for r in data], lambda x: x)) == sorted(x for r in data for x in r)
