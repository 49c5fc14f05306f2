"""Byte-level encoding, periodic runs and spelling variants against brute force."""

import hashlib
import os
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from changeloom.llm import byte_pieces, periods, spelling
from changeloom.llm import queries as Q

SF = "/root/testdata/sf0.001"
RANKS = byte_pieces.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TOKENIZER = byte_pieces.ByteTokenizer(RANKS, public_tokenizers.PATTERN)


# Byte-level encoding


def odd_texts():
    rng = random.Random(3)
    letters = "aaabbe  \n\t'sté  \x1c\x85ßñ漢字👍🏽12३½.,-_" + chr(0x0301)
    for _ in range(1500):
        yield "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
    for unit in ("a", "ab", " ", "\n", "é", "漢", "the", "ing", "=-", "0"):
        for n in (17, 100, 1000):
            yield unit * n
    yield "".join(rng.choice("etaoinshrdlu") for _ in range(5000))


def test_encoding_equals_library():
    for text in odd_texts():
        assert TOKENIZER.encode(text) == LIBRARY.encode_ordinary(text), repr(text)
        assert TOKENIZER.decode(TOKENIZER.encode(text)) == text.encode()


def test_every_code_point_is_of_the_library_s_class():
    for start in range(0, 0x20000, 64):
        text = "".join(f"a{chr(c)}1{chr(c)} {chr(c)}{chr(c)}." for c in range(start, start + 64) if not 0xD800 <= c < 0xE000)
        if TOKENIZER.encode(text) != LIBRARY.encode_ordinary(text):  # tables of Unicode may differ in code points that one does not know yet
            differs = [c for c in range(start, start + 64) if not 0xD800 <= c < 0xE000 and TOKENIZER.encode(f"a{chr(c)}1") != LIBRARY.encode_ordinary(f"a{chr(c)}1")]
            import unicodedata

            assert all(unicodedata.category(chr(c)) == "Cn" or c > 0x2FFF for c in differs), list(map(hex, differs))


def test_joins_hold_for_any_ranks():
    """Ranks in disorder, with tokens that several pairs make: nothing but the definition counts."""
    for seed in range(300):
        rng = random.Random(seed)
        tokens = {bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 6))) for _ in range(40)}
        order = [bytes([b]) for b in range(256)] + sorted(tokens, key=lambda _: rng.random())
        if seed % 2:
            rng.shuffle(order)
        own = byte_pieces.ByteTokenizer({t: i for i, t in enumerate(order)}, ".+")
        for _ in range(20):
            data = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 90)))
            cut = rng.randint(0, len(data))
            assert own.joined(own.merged(data[:cut]), own.merged(data[cut:])) == own.merged(data) == own.reduced(data)


def test_query_11(spark):
    texts = {r["doc_id"]: r["text"] for r in Q.table(spark, SF, "documents").collect()}
    rows = Q.op11_byte_pieces(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = LIBRARY.encode_ordinary(texts[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()


def test_odd_rows_11(spark):
    rows = [(None, "a b"), ("x", None), ("x", ""), ("x", ""), ("y", "z" * 200_000), ("v", "zy " * 100_000)]
    frame = spark.createDataFrame(rows, "doc_id string, text string").selectExpr("*", "1 AS ids", "2 AS n_tokens", "3 AS id")
    args = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    got = sorted(((r["doc_id"], bytes(r["decoded"]).decode()) for r in byte_pieces.encode_documents(frame, *args).collect()), key=repr)
    assert got == sorted(((a, b or "") for a, b in rows), key=repr)
    assert byte_pieces.encode_documents(frame.where("false"), *args).count() == 0


# Periodic runs


def all_runs(w):
    """Every maximal stretch of smallest period q with at least max(6, 4 q) words, by trying all."""
    n, found = len(w), {}
    for q in range(1, n // 4 + 1):
        at = 0
        while at + q < n:
            end = at
            while end + q < n and w[end] == w[end + q]:
                end += 1
            if end - at + q >= max(6, 4 * q):
                found.setdefault((at, end - at + q), q)
            at = max(end, at) + 1
    return sorted((start, length, q) for (start, length), q in found.items())


def words_of_many_runs(rng, size):
    out = []
    while len(out) < size:
        unit = [rng.choice("abcd") for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 20, 40]))]
        out += unit * rng.choice([1, 1, 2, 4, 5, 9]) + [rng.choice("abcdefgh") for _ in range(rng.randint(0, 6))]
    return out[:size]


def test_runs_equal_brute_force(spark):
    rng = random.Random(5)
    texts = [words_of_many_runs(rng, rng.randint(0, 400)) for _ in range(150)] + [["a"] * n for n in range(14)] + [["a", "b"] * 40, ["x"] * 500]
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in periods.periodic_runs(frame).collect():
        want = all_runs(texts[r["doc_id"]])
        assert [tuple(x) for x in r["runs"]] == sorted(want, key=lambda x: (x[0], x[2]))


@pytest.mark.parametrize("seed", range(4))
def test_runs_across_tiles(spark, monkeypatch, seed):
    """Small tiles, in this process: every run that crosses some is stitched from fragments of several."""
    monkeypatch.setattr(periods, "BASE", 1)
    monkeypatch.setattr(periods, "STEP", 16)
    rng = random.Random(seed)
    for _ in range(60):
        words = np.array([ord(x) for x in words_of_many_runs(rng, rng.randint(0, 500))], np.int32)
        pieces = defaultdict(list)
        for octave, start, end in periods.cut(len(words)):
            octaves = range(2) if octave == 1 else range(octave, octave + 1)
            for q, a, b in periods.fragments(words[start:end], octaves):
                pieces[q].append((start + a, start + b))
        found = {}
        for q in sorted(pieces):
            whole = []
            for a, b in sorted(pieces[q]):
                if whole and a <= whole[-1][1]:
                    whole[-1][1] = max(b, whole[-1][1])
                else:
                    whole.append([a, b])
            for a, b in whole:
                if b - a + q >= max(6, 4 * q):
                    found.setdefault((a, b - a + q), q)
        assert sorted((a, n, q) for (a, n), q in found.items()) == all_runs(words.tolist())


def test_long_texts_and_odd_rows_12(spark, monkeypatch):
    rng = random.Random(9)
    unit = [str(rng.randint(0, 10**6)) for _ in range(9_000)]
    long = [str(rng.randint(0, 10**6)) for _ in range(3_000)] + unit * 5 + unit[:77] + ["x"] * 30_000 + ["end"]
    rows = [(None, "a a a a a a"), ("s", None), ("s", ""), ("s", " \t\n"), ("s", "b " * 6), ("s", "b " * 6), ("t", "    " * 8), ("l", " ".join(long))]
    frame = spark.createDataFrame(rows, "doc_id string, text string").selectExpr("*", "1 AS runs", "2 AS rid", "3 AS words")
    for limit in (periods.LONG, 5):  # the second deals the tiles of nearly all
        monkeypatch.setattr(periods, "LONG", limit)
        got = sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["kept"] if r["n_words"] < 100 else len(r["kept"].split())) for r in periods.periodic_runs(frame).collect()), key=repr)
        assert got == sorted([
            (None, 6, [(0, 6, 1)], "a"), ("s", 0, [], ""), ("s", 0, [], ""), ("s", 0, [], ""), ("s", 6, [(0, 6, 1)], "b"), ("s", 6, [(0, 6, 1)], "b"), ("t", 16, [(0, 16, 1)], " "),
            ("l", len(long), [(3_000, 45_077, 9_000), (48_077, 30_000, 1)], 3_000 + 9_000 + 2),
        ], key=repr)
    assert periods.periodic_runs(frame.where("false")).count() == 0


def test_query_12(spark):
    rows = Q.op12_periods(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in Q.table(spark, SF, "documents").collect()}
    assert len(rows) == len(texts) and sum(r["n_runs"] > 0 for r in rows) > 5
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]] or "")
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        runs = sorted(all_runs(w), key=lambda x: (x[0], x[2]))
        dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in dropped).encode()).hexdigest()


# Spelling variants


def plain_groups(counts, times=5):
    near = {w: [v for v in counts if spelling.one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= times * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return out


def test_one_edit():
    assert spelling.one_edit("abc", "abd") and spelling.one_edit("abc", "abcd") and spelling.one_edit("aab", "ab") and spelling.one_edit("", "a")
    assert not any(spelling.one_edit(*p) for p in [("abc", "abc"), ("ab", "ba"), ("abc", "a"), ("abc", "abde"), ("", "")])


@pytest.mark.parametrize(("cell", "bundle", "stride"), [(4096, 64, 4), (3, 2, 4), (2, 2, 1), (5, 1, 7)])
def test_groups_equal_brute_force(spark, monkeypatch, cell, bundle, stride):
    """With small cells the trie is split to its depth, and vectors of many words are in several parts."""
    monkeypatch.setattr(spelling, "CELL", cell)
    monkeypatch.setattr(spelling, "BUNDLE", bundle)
    monkeypatch.setattr(spelling, "STRIDE", stride)
    rng = random.Random(cell)
    size = 250 if stride == 4 else 60
    words = {"".join(rng.choice("abcß") for _ in range(rng.randint(1, 6))) for _ in range(size)} | {"à" * 3, "æ" * 3, "àæà", "x" * 50, "x" * 51, "x" * 49 + "y", "漢字", "漢", "é"}
    counts = {w: rng.choice([1, 2, 5, 7, 30, 200, 5_000]) for w in words}
    frame = spark.createDataFrame([*counts.items(), (None, 3), ("", 4), ("nocount", None)], "word string, n int").selectExpr("*", "1 AS node", "2 AS vec")
    got = [tuple(r) for r in spelling.spelling_groups(frame).collect()]
    assert len(got) == len(counts) and set(got) == plain_groups(counts)


def test_no_words(spark):
    assert spelling.spelling_groups(spark.createDataFrame([], "word string, n long")).count() == 0


def test_query_13(spark):
    counts = Counter()
    for r in Q.table(spark, SF, "documents").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{r['doc_id']}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    got = [tuple(r) for r in Q.op13_spelling(spark, SF).collect()]
    assert len(got) == len(counts) and set(got) == plain_groups(counts)
    assert sum(r[1] is not None for r in got) >= 10


def test_words_of_odd_rows(spark):
    rows = [(None, "Äpfel-Straße SCHÖNER schöner"), (1, None), (1, ""), (1, "abcdef" * 3_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS run", "2 AS h")
    assert sorted(r[0] for r in Q.edited_words(frame).collect() if len(r[0]) < 99) == sorted(["straße", "schÖner", "schöner"])


# Ids of operators that write them to files


@pytest.mark.parametrize(("kind", "ids"), [("long", [1 << 62, -(1 << 62), 10**15, 0, None, 0]), ("string", ["a b", "ü\r\n\r\n> %41+", "", None, "12", "12"]), ("int", [-1, 0, 1, None, 2, 2])])
def test_ids_of_any_kind(spark, kind, ids):
    from changeloom.llm import token_files, warc

    frame = spark.createDataFrame([(i, f"text {k}", f"http://h/{k}") for k, i in enumerate(ids)], f"doc_id {kind}, text string, url string")
    counts = token_files.count_tokens(frame, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 50256)
    assert dict(counts.dtypes)["doc_id"] == dict(frame.dtypes)["doc_id"]
    assert sorted((r["doc_id"] for r in counts.collect()), key=repr) == sorted(ids, key=repr)
    pages = warc.archive_round_trip(frame, id_col="doc_id", payload_col="text").collect()
    assert sorted(((r["doc_id"], r["payload_bytes"]) for r in pages), key=repr) == sorted(((i, 6) for i in ids), key=repr)
    assert all(len(r["stamp"]) == 20 for r in pages)
    twins = warc.archive_round_trip(frame.withColumn("text", frame["url"].substr(1, 7)), id_col="doc_id", payload_col="text").collect()
    first = min(i for i in ids if i is not None)
    assert all(r["refers_to"] == first for r in twins if r["record_type"] == "revisit") and sum(r["record_type"] == "revisit" for r in twins) >= 4
