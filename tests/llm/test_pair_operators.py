"""SimHash and long repeats against brute force, and what they are built on."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from changeloom.llm import graph, repeats, similar, simhash, variants
from changeloom.llm import queries as Q
from changeloom.llm.run_index import RunIndex

SF = "/root/testdata/sf0.001"


def brute_print(text, words=3):
    tokens = (text or "").encode().lower().split()
    shingles = [b" ".join(tokens[k : k + words]) for k in range(max(1, len(tokens) - words + 1))] if tokens else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance):
    parent = list(range(len(prints)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= distance:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return [root(k) for k in range(len(prints))]


def test_simhash_of_given_documents(spark):
    docs = Q.table(spark, SF, "documents")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    prints = [brute_print(r["text"]) for r in rows]
    roots = brute_components(prints, 2)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {r["doc_id"]: (f"{p:016x}", rows[k]["doc_id"]) for r, p, k in zip(rows, prints, roots)}
    assert len(set(roots)) < len(roots)


def test_simhash_of_odd_rows(spark):
    texts = [None, "", " \t\n", "One two three four", "one  TWO three four", "É x", "ab " * 50_000, "solo"]
    rows = [(10 + k, t) for k, t in enumerate(texts)] + [(None, "solo"), (None, "alone of no id"), (13, "one two three four")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS rid", "2 AS f0", "'x' AS node", "3 AS root")
    got = simhash.near_duplicates(docs).collect()
    assert sorted(r["fingerprint"] for r in got) == sorted(f"{brute_print(t):016x}" for _, t in rows)
    of = {r["doc_id"]: r["component_id"] for r in got if r["doc_id"]}
    assert of[10] == of[11] == of[12] == 10 and of[13] == of[14] == 13
    assert sorted((r["component_id"] or 0) for r in got if r["doc_id"] is None) == [0, 17]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("parts", "segments", "distance", "most"), [(1, 2, 3, 4096), (1, 4, 7, 4096), (3, 12, 23, 4096), (1, 2, 3, 6), (1, 4, 7, 40), (3, 12, 23, 10)])
def test_links_lose_no_component(spark, parts, segments, distance, most, monkeypatch):
    """Whether buckets are compared whole, by a forest or, of more than ``most`` rows, in blocks."""
    monkeypatch.setattr(variants, "MOST", most)
    monkeypatch.setattr(variants, "ROWS", 64)
    rng = random.Random(distance)
    centres = [rng.getrandbits(64 * parts) for _ in range(6)]
    prints = list({c ^ sum(1 << b for b in rng.sample(range(64 * parts), rng.randint(0, distance))) for c in centres for _ in range(40)} | {centres[0] ^ 1 << b for b in range(64 * parts)})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(k, *(signed(p >> 64 * w & (1 << 64) - 1) for w in range(parts))) for k, p in enumerate(prints)]
    frame = spark.createDataFrame(rows, "node long, " + ", ".join(f"f{w} long" for w in range(parts)))
    linked = simhash.links(frame, parts, segments, distance)
    roots = {r["node"]: r["root"] for r in graph.components(linked).collect()}
    assert [roots.get(k, k) for k in range(len(prints))] == brute_components(prints, distance)
    assert simhash.links(frame.limit(0), parts, segments, distance).count() == 0


@pytest.mark.parametrize("most", [4096, 12])
def test_verified_links_lose_no_component(spark, most, monkeypatch):
    """Where a forest of proposed pairs is not one of links, the others are looked at too:
    among near fingerprints, only nodes of one colour are linked."""
    monkeypatch.setattr(variants, "MOST", most)
    monkeypatch.setattr(variants, "DENSE", 4)
    rng = random.Random(most)
    centre = rng.getrandbits(64)
    prints = sorted({centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 2))) for _ in range(150)})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    frame = spark.createDataFrame([(k, signed(p)) for k, p in enumerate(prints)], "node long, f0 long")
    search = variants.Search(1, 4, 16, 5)
    found = variants.links(frame, search, lambda pairs: pairs.where("a % 3 = b % 3"))
    roots = {r["node"]: r["root"] for r in graph.components(found).collect()}
    assert [roots.get(k, k) for k in range(len(prints))] == [k % 3 for k in range(len(prints))]


@pytest.mark.parametrize(("bits", "lo"), [(16, 48), (17, 51), (28, 112)])
def test_segments_across_words(bits, lo):
    values = [random.Random(k).getrandbits(192) for k in range(20)]
    words = np.array([[v >> 64 * w & (1 << 64) - 1 for w in range(3)] for v in values], np.uint64)
    assert variants._segment(words, lo, bits).tolist() == [v >> lo & (1 << bits) - 1 for v in values]


@pytest.mark.parametrize(("rows", "similarity"), [(10_000, 0.8), (10_000, 0.9), (1 << 36, 0.8)])
def test_share_of_similar_sets_that_is_proposed(rows, similarity):
    """At 0.8 and above, for small and for very large corpora, from fingerprints of random sets."""
    rng, found, n = np.random.default_rng(rows), 0, 400
    search, fits = similar.search_for(rows, 0.8), similar.Plausible(0.8)
    for _ in range(n):
        shared, own = round(200 * similarity), round(200 * (1 - similarity)) // 2
        both = rng.integers(0, 1 << 64, shared, np.uint64)
        sets = [np.concatenate([both, rng.integers(0, 1 << 64, own, np.uint64)]) for _ in "ab"]
        a, b = (np.array([similar.majority(s, search.parts)]).view(np.uint64) for s in sets)
        near = variants._first_variant(a ^ b, search.segments, search.bits)[0] >= 0 and variants._apart(a, b)[0] <= search.distance
        found += bool(near and fits(*([np.array([x]) for x in (len(s), *similar.sketch(s))] for s in sets))[0])
    assert found >= 0.95 * n


@pytest.mark.parametrize(("size", "similarity", "kept"), [(80, 0.8, (0.98, 1)), (200, 0.8, (0.99, 1)), (2000, 0.8, (0.99, 1)), (200, 0.55, (0, 0.1)), (2000, 0.55, (0, 0.05))])
def test_share_of_pairs_that_is_plausible(size, similarity, kept):
    rng, found, n = np.random.default_rng(size), 0, 400
    fits = similar.Plausible(0.8)
    shared, own = round(size * similarity), round(size * (1 - similarity)) // 2
    for _ in range(n):
        both = rng.integers(0, 1 << 64, shared, np.uint64)
        sets = [np.concatenate([both, rng.integers(0, 1 << 64, own, np.uint64)]) for _ in "ab"]
        found += bool(fits(*([np.array([x]) for x in (len(s), *similar.sketch(s))] for s in sets))[0])
    assert kept[0] * n <= found <= kept[1] * n


def test_plausible_pairs_in_columns_and_arrays(spark):
    """Both forms agree; sizes are told apart exactly; small sets pass whatever their sketches."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 64, 300, np.uint64)
    sets = [base[:n] for n in (0, 0, 1, 4, 5, 79, 80, 100, 239, 240, 299, 300)] + [np.concatenate([base[:150], rng.integers(0, 1 << 64, n, np.uint64)]) for n in (0, 20, 50, 150)]
    rows, fits = [(k, len(s), *similar.sketch(s)) for k, s in enumerate(sets)], similar.Plausible(0.8)
    pairs = [(a, b) for a in range(len(sets)) for b in range(a)]
    arrays = [[np.array([rows[p[side]][c] for p in pairs]) for c in range(1, len(rows[0]))] for side in (0, 1)]
    want = {p for p, ok in zip(pairs, fits(*arrays), strict=True) if ok}
    frame = spark.createDataFrame(rows, "node long, " + ", ".join(f"{n} long" for n in fits.names))
    assert {tuple(r) for r in fits.of(spark.createDataFrame(pairs, "a long, b long"), frame).collect()} == want
    assert {(1, 0), (4, 3), (7, 6), (11, 9)} <= want and not {(3, 2), (7, 5), (11, 8), (2, 0)} & want
    assert fits.of(spark.createDataFrame([], "a long, b long"), frame).count() == 0


def test_components_of_odd_links(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(220)] + [(k, k + 1) for k in range(1_000, 1_060)] + [(5_000, 5_000), (None, 1), (7_000, 6_000), (7_000, 6_000)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: root(x) for x in parent}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def random_strings(rng):
    base = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 60)))
    out = []
    for _ in range(rng.randint(1, 8)):
        at = rng.randrange(len(base)) if base else 0
        out.append(base[at : at + rng.randint(0, 40)] + bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 6))))
    return out


def test_run_index_equals_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        strings, span = random_strings(rng), rng.choice([1, 2, 3, 5, 9, 17])
        index, count = RunIndex(strings), {}
        for s in strings:
            for k in range(len(s) - span + 1):
                count[s[k : k + span]] = count.get(s[k : k + span], 0) + 1
        before = [index.text[at - 1] for at in sorted(range(len(index.text)), key=lambda at: (bytes(index.text[at : at + index.to_end[at]]) + b"\xff", at))]
        assert np.repeat(index.run_bytes, index.run_lengths).tolist() == before
        for s, got in zip(strings, index.repeated(span)):
            assert got.tolist() == [count[s[k : k + span]] > 1 for k in range(len(s) - span + 1)]
    assert RunIndex([]).repeated(3) == [] and RunIndex([b""]).repeated(3)[0].size == 0


def brute_repeats(texts, span):
    count = {}
    for t in texts:
        for k in range(len(t) - span + 1):
            count[t[k : k + span]] = count.get(t[k : k + span], 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - span + 1):
            if count[t[k : k + span]] > 1:
                gone[k : k + span] = b"\1" * span
        runs = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(t), sum(gone), runs, bytes(c for c, g in zip(t, gone) if not g)))
    return out


@pytest.mark.parametrize(("span", "gram", "hot"), [(200, 64, 1024), (200, 64, 1), (24, 8, 2), (24, 8, 1024), (9, 8, 1), (8, 8, 1)])
def test_repeats_equal_brute_force(spark, span, gram, hot, monkeypatch):
    """Whether anchors are taken as they are or made longer where they have more than ``hot`` contexts."""
    monkeypatch.setattr(repeats, "HOT", hot)
    rng = random.Random(span)
    passages = ["".join(rng.choice("abé ") for _ in range(rng.randint(span // 2, 3 * span))) for _ in range(6)]
    texts = [None, "", "a" * (span * 3), "x" * span] + [
        "".join(rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choice("abcdefg\n") for _ in range(rng.randint(1, 2 * span))) for _ in range(rng.randint(1, 5))) for _ in range(40)
    ]
    rows = [(k if k % 7 else None, t) for k, t in enumerate(texts)] + [(3, "x" * span), (99, texts[-1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS rid", "'x' AS anchor", "2 AS start", "3 AS n", "4 AS id")
    got = [(r["id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in repeats.remove_repeats(docs, span, gram=gram).collect()]
    want = [(k or 0, *found) for (k, _), found in zip(rows, brute_repeats([(t or "").encode() for _, t in rows], span))]
    assert sorted(got) == sorted(want)
    assert repeats.remove_repeats(docs.limit(0), span, gram=gram).count() == 0


def test_a_frequent_line_is_dealt_out(spark, monkeypatch):
    """One line of 90 bytes in many documents, some of whose surroundings repeat as well."""
    monkeypatch.setattr(repeats, "HOT", 5)
    seen, indexed = [], repeats._indexed

    def watched(contexts, span):
        contexts = repeats.stored(contexts, "watched")
        seen.append(max([0, *(r["count"] for r in contexts.groupBy("anchor").count().collect())]))
        return indexed(contexts, span)

    monkeypatch.setattr(repeats, "_indexed", watched)
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    line, near = word(90), [word(70) for _ in range(3)]
    texts = [word(rng.randint(0, 150)) + rng.choice(near) + line + rng.choice([*near, word(70)]) + word(rng.randint(0, 150)) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r["id"], r["n_removed"], bytes(r["kept"])) for r in repeats.remove_repeats(docs).collect())
    assert got == sorted((k, f[1], f[3]) for k, f in enumerate(brute_repeats([t.encode() for t in texts], 200)))
    assert max(seen) <= 5 and len(seen) > 2


def test_texts_are_dealt_once_where_anchors_are_hot(spark, monkeypatch):
    """The bytes of frequent and of other contexts are cut in one pass over the texts."""
    monkeypatch.setattr(repeats, "HOT", 5)
    plans = []
    for name in ("_indexed", "_marked_hot"):
        before = getattr(repeats, name)
        monkeypatch.setattr(repeats, name, lambda contexts, *args, before=before: plans.append(contexts._jdf.queryExecution().toString()) or before(contexts, *args))
    line = "a line that stands in many documents, word for word, and is longer than the gram that anchors it. "
    docs = spark.createDataFrame([(k, f"{k * 7919} " * 30 + line + f"{k * 104729} " * 30) for k in range(12)], "doc_id long, text string")
    assert repeats.remove_repeats(docs, 80, gram=16).agg({"n_removed": "sum"}).first()[0] >= 12 * (len(line) - 1)
    assert len(plans) > 1 and not any("collect_list" in p for p in plans)



def test_contexts_of_long_texts_hold_every_window_once(monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", (1 << 9) - 1)
    data = random.Random(1).randbytes(5_000)
    start, n, _, _ = repeats.Anchors(50, 16).contexts(data)
    windows = [s + k for s, c in zip(start.tolist(), n.tolist()) for k in range(c)]
    assert sorted(windows) == list(range(len(data) - 49))


def test_repeats_of_given_documents(spark):
    docs = Q.table(spark, SF, "documents")
    rows = docs.select("doc_id", "text").collect()
    want = {r["doc_id"]: f for r, f in zip(rows, brute_repeats([r["text"].encode() for r in rows], 200))}
    got = {r["doc_id"]: r for r in Q.op3_repeats(spark, SF).collect()}
    assert {k: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for k, r in got.items()} == {k: (*f[:3], hashlib.sha256(f[3]).hexdigest()) for k, f in want.items()}
    assert sum(r["n_removed"] for r in got.values()) > 0
