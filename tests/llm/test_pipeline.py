"""The pipeline's stages, each against brute force on its own input."""

import hashlib
import random
import re

import pytest

import corpus_pipeline as P
from changeloom.llm import queries as Q

from test_pair_operators import brute_repeats
from test_small_operators import split, windows

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, n=5):
    words = (text or "").lower().split()
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))}


def test_whole_run(spark):
    """Every stage on what the one before kept."""
    docs = Q.table(spark, SF, "documents")
    labels = {r["doc_id"]: r["quality"] for r in Q.table(spark, SF, "labels").collect()}
    scores = {r["doc_id"]: r["predicted"] for r in Q.op1_quality(spark, SF).collect()}
    kept = docs
    for k, (name, stage) in enumerate(P.STAGES):
        before = {r["doc_id"]: r["text"] for r in kept.collect()}
        out = P.stored(stage(spark, kept, SF), f"test-{k}")
        if k < 4:
            assert out.columns == P.COLUMNS, name
        after = {r["doc_id"]: r for r in out.collect()}
        if k == 0:
            assert set(after) == {d for d in before if scores[d]}
            assert sum(labels.get(d) == 0 for d in after) <= 2
        elif k == 1:
            gone = set(before) - set(after)
            sets = {d: shingles(t) for d, t in before.items()}
            near = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            assert gone and all(max(near(d, e) for e in before if e < d) > 0.5 for d in gone)
            assert all(near(d, e) < 0.9 for d in after for e in after if e < d)
        elif k == 2:
            want = brute_repeats([t.encode() for t in before.values()], 200)
            assert {d: r["text"] for d, r in after.items()} == {d: w[3].decode("utf-8", "ignore") for d, w in zip(before, want)}
            assert all(r["n_chars"] == len(r["text"]) for r in after.values())
        elif k == 3:
            items = {w for r in Q.table(spark, SF, "benchmark").collect() for w in windows(split(r["text"]))}
            assert set(after) == {d for d, t in before.items() if not any(w in items for w in windows(split(t)))}
        else:
            theirs = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model"))
            assert {d: r["ids_sha256"] for d, r in after.items()} == {d: hashlib.sha256(",".join(map(str, theirs.encode(t))).encode()).hexdigest() for d, t in before.items()}
        kept = out
    assert sorted(map(tuple, P.run(spark, SF).collect())) == sorted(map(tuple, kept.collect()))


def test_stages_on_odd_rows(spark):
    rng = random.Random(1)
    text = " ".join(rng.choice("abcdefgh") * rng.randint(1, 6) for _ in range(300))
    rows = [(1, text, "en", None, 3), (2, text + " end", None, "s", None), (2, text + " end", None, "s", None), (None, text, "en", "s", 1), (3, None, None, None, None), (4, "", "en", "s", 0), (5, "", "en", "s", 0), (6, "x", "en", "s", 1), (6, "x", "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS rid", "2 AS component_id")
    for _, stage in P.STAGES:
        assert stage(spark, docs, SF).count() <= len(rows)
        assert stage(spark, docs.limit(0), SF).count() == 0
    kept = sorted(r["doc_id"] or 0 for r in P.keep_one_of_each(spark, docs, SF).collect())
    assert kept == [0, 1, 3, 6]


def _brute_groups(texts, least=0.8):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return root


def test_near_duplicates_are_verified_at_the_threshold(spark):
    """Pairs of similarity 0.8 are one document, those below are two, and a line that
    repeats in two documents counts once."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    texts = []
    for k in range(40):
        words = [word() for _ in range(184)]  # 180 shingles; one side has so many more of its own
        texts += [" ".join(words), " ".join(words + [word() for _ in range((45, 46, 77, 120)[k % 4])])]
    line = " ".join(word() for _ in range(10)) + "\n"
    for _ in range(6):
        texts.append(line * 20 + " ".join(word() for _ in range(200)))
    texts += ["a b c", "A  b c", "a b d", "", " "]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], SCHEMA)
    kept = {r["doc_id"] for r in P.keep_one_of_each(spark, docs, SF).collect()}
    assert kept == set(_brute_groups(texts))
    assert sum(2 * k + 1 not in kept for k in range(40)) == 10


def test_near_duplicates_by_row(spark):
    """Rows without an id all stay though another id is repeated, and one id may have two texts."""
    texts = [" ".join(f"{c}{k}" for k in range(30)) for c in "abcd"]
    rows = [(1, texts[0]), (1, texts[0]), (None, texts[1]), (None, texts[1]), (2, texts[2]), (2, texts[3]), (3, texts[3])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    kept = P.keep_one_of_each(spark, docs, SF)
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert kept.columns == P.COLUMNS
    assert sorted(got, key=str) == sorted([rows[0], *rows[2:6]], key=str)


def test_contaminated_rows_without_or_of_one_id(spark):
    item = next(r["text"] for r in Q.table(spark, SF, "benchmark").collect() if len(split(r["text"])) >= 12)
    rows = [(None, item), (None, "clean"), (1, item), (1, "clean too"), (2, "clean")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    kept = P.drop_contaminated(spark, docs, SF)
    assert kept.columns == P.COLUMNS
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([rows[1], rows[3], rows[4]], key=str)


def test_look_alikes_are_not_listed_in_pairs(spark, monkeypatch):
    """Of edited copies of one text most pairs are near, but below 0.8: all links are found, and
    no more pairs are fetched than a few for each row."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    base, texts = [word() for _ in range(150)], []
    for k in range(300):
        words = list(base)
        for at in rng.sample(range(2, 148, 5), 2 + k % 2):
            words[at] = word()
        texts.append(" ".join(words))
    listed, before = [], P.similar.verified
    monkeypatch.setattr(P.similar, "verified", lambda pairs, *args: listed.append(pairs.count()) or before(pairs, *args))
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], SCHEMA)
    rows = P.with_row_id(docs, "doc_id", "text")
    found = {r["rid"]: r["root"] for r in P.similar.groups(rows).collect()}
    assert [found[k] for k in range(300)] == _brute_groups(texts)
    assert sum(listed) < 20 * len(texts)


def test_rows_that_are_near_none_stay_out_of_the_second_round(spark, monkeypatch):
    """Copies of one text make their buckets dense; the rows that share a bucket with them by
    chance, and the copies themselves if they are one component, are not fetched again."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    base, texts = [word() for _ in range(200)], []
    for k in range(60):
        texts.append(" ".join([*base, *(word() for _ in range(1 + k % 3))]))
    texts += [" ".join(word() for _ in range(40)) for _ in range(3000)]
    opened, before = [], P.similar.rarest
    monkeypatch.setattr(P.similar, "rarest", lambda sets, *args: opened.append(sets.count()) or before(sets, *args))
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], SCHEMA)
    found = {r["rid"]: r["root"] for r in P.similar.groups(P.with_row_id(docs, "doc_id", "text")).collect()}
    assert [found[k] for k in range(len(texts))] == [0] * 60 + list(range(60, len(texts)))
    assert opened == [0]


def test_forests_meet_without_joins_by_bucket(spark, monkeypatch):
    """Rows of a bucket of which a forest was taken are compared where they meet: they are
    not joined with the number and the main component of each of their buckets, and links
    that the forest lacks are found all the same."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    base, texts = [word() for _ in range(150)], []
    for k in range(200):
        words = list(base)
        for at in rng.sample(range(2, 148, 5), 2 + k % 2):
            words[at] = word()
        texts.append(" ".join(words))
    mixed, before = [], P.similar.linked.__globals__["_mixed"]
    monkeypatch.setitem(P.similar.linked.__globals__, "_mixed", lambda rows, size: mixed.append(rows.columns) or before(rows, size))
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], SCHEMA)
    found = {r["rid"]: r["root"] for r in P.similar.groups(P.with_row_id(docs, "doc_id", "text")).collect()}
    assert [found[k] for k in range(200)] == _brute_groups(texts)
    assert len(mixed) == 1 and "hashed" in mixed[0]  # only keys of shingles


def _rows_joined(spark, since: int = -1) -> tuple[int, int]:
    """Rows that joins by node made in executions after ``since``, and the last execution."""
    store, total = spark._jsparkSession.sharedState().statusStore(), 0
    done = store.executionsList()
    ids = [done.apply(k).executionId() for k in range(done.size())]
    for number in (k for k in ids if k > since):
        metrics, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            for metric in (node.metrics().apply(k) for k in range(node.metrics().size())) if re.search(r"Join \[node#\d+L\], \[node#", node.desc()) else ():
                value = metrics.get(metric.accumulatorId()) if metric.name() == "number of output rows" else None
                total += int(value.get().replace(",", "")) if value is not None and value.isDefined() else 0
    return total, max(ids, default=-1)


def test_rows_are_joined_once_for_all_their_buckets(spark):
    """A row of many dense buckets gets its fingerprint and component once, not for each of them."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    base, texts = [word() for _ in range(150)], []
    for k in range(200):
        words = list(base)
        for at in rng.sample(range(2, 148, 5), 2 + k % 2):
            words[at] = word()
        texts.append(" ".join(words))
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], SCHEMA)
    _, since = _rows_joined(spark)
    found = {r["rid"]: r["root"] for r in P.similar.groups(P.with_row_id(docs, "doc_id", "text")).collect()}
    made, _ = _rows_joined(spark, since)
    assert [found[k] for k in range(200)] == _brute_groups(texts)
    assert made < 40 * len(texts), made
