"""Role recovery and separator scans against brute force."""

import itertools
import random

import numpy as np
import pytest

from changeloom.llm import chat, token_files
from changeloom.llm import queries as Q

SF = "/root/testdata/sf0.001"


def some_model(seed):
    rng, size = np.random.default_rng(seed), len(chat.STATES)
    return chat.TurnModel(np.log(rng.dirichlet(np.ones(size), size + 1)), np.log(rng.dirichlet(np.ones(chat.CODES), size)))


def score(model, codes, states):
    before = [len(chat.STATES), *states[:-1]]
    return sum(model.step[b, s] + model.emit[s, c] for b, s, c in zip(before, states, codes))


def test_viterbi_is_the_best_of_all_paths():
    for seed in range(5):
        model = some_model(seed)
        codes = np.random.default_rng(seed).integers(0, chat.CODES, 5)
        best = max(itertools.product(range(len(chat.STATES)), repeat=5), key=lambda path: score(model, codes, path))
        assert model.best(codes) == list(best)


def test_blocks_give_the_path_of_one_pass():
    for seed in range(20):
        model, rng = some_model(seed), np.random.default_rng(seed)
        blocks = [rng.integers(0, chat.CODES, rng.integers(1, 9)) for _ in range(rng.integers(1, 7))]
        joined = [s for codes, (before, last) in zip(blocks, chat.borders([model.matrix(b) for b in blocks])) for s in model.best(codes, before, last)]
        assert joined == model.best(np.concatenate(blocks))


@pytest.mark.parametrize(("marked_percent", "least"), [(100, 0.9), (85, 0.6)])
def test_roles_of_given_conversations(spark, marked_percent, least):
    """Counted from 20 conversations only, so that rare roles may be missed."""
    table, truth, found = Q.table(spark, SF, "conversations"), {}, {}
    for r in table.orderBy("conv_id", "turn").collect():
        truth.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    lines = chat.transcript(table, marked_percent)
    for r in chat.recover_turns(lines, chat.fit(lines)).orderBy("conv", "turn").collect():
        found.setdefault(r["conv"], []).append((r["role"], r["content"]))
    assert set(found) == set(truth)
    assert sum(found[k] == truth[k] for k in truth) >= least * len(truth)


def test_roles_of_held_out_lines(spark):
    """The query's own split: the model learns from two thirds, roles of the others' lines are compared."""
    sf = "/root/testdata/sf0.01"
    truth, found = {}, {}
    for r in Q.table(spark, sf, "conversations").where(Q.HELD_OUT.replace("doc_id", "conv_id")).orderBy("conv_id", "turn").collect():
        truth.setdefault(r["conv_id"], []).extend([r["role"]] * (r["text"] or "").count("\n") + [r["role"]])
    for r in Q.op4_chat(spark, sf).where(Q.HELD_OUT.replace("doc_id", "conv_id")).orderBy("conv_id", "turn").collect():
        found.setdefault(r["conv_id"], []).extend([r["role"]] * r["n_lines"])
    pairs = [(a, b) for k in truth for a, b in zip(truth[k], found[k], strict=True)]
    assert sum(a == b for a, b in pairs) >= 0.93 * len(pairs)


def test_rendering(spark):
    frame = spark.createDataFrame([("user", "a <|end|> b"), ("system", "")], "role string, content string")
    assert [r[0] for r in frame.select(chat.rendered(frame["role"], frame["content"])).collect()] == ["<|user|>\na < |end|> b<|end|>\n", "<|system|>\n<|end|>\n"]


def test_turns_of_odd_and_long_transcripts(spark):
    rng = random.Random(1)
    rows = [(1, None, "user", "hi"), (1, 2, None, "what"), (1, 2, None, "what"), (None, 1, "assistant", None), (2, 1, "system", ""), (3, 0, "user", "Human: a\n" * 3_000)]
    rows += [(4, k, ["user", "assistant"][k % 2], " ".join("w" for _ in range(rng.randint(1, 60))) + "\nsecond line") for k in range(300)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS key", "'x' AS block", "2 AS line")
    lines = chat.transcript(frame)
    model = chat.fit(lines)
    whole = sorted(map(tuple, chat.recover_turns(lines, model).collect()), key=repr)
    assert sum(r[3] for r in whole) == lines.count()
    assert sum(r[3] for r in whole if r[0] is None) == 1
    for size in (1, 7):
        blocks = chat.numbered(lines, size).groupBy("key", "block").count()
        assert blocks.where(f"count > {size}").count() == 0
        assert np.allclose(chat.fit(lines, size).emit, model.emit)
        assert sorted(map(tuple, chat.recover_turns(lines, model, size).collect()), key=repr) == whole
    assert chat.recover_turns(lines.limit(0), chat.fit(lines.limit(0))).count() == 0


@pytest.mark.parametrize("block_ids", [1, 3, 64])
def test_scan_equals_splitting(spark, block_ids, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "CHUNK_BLOCKS", 4)
    rng = random.Random(block_ids)
    files = []
    for k in range(6):
        docs = [[rng.randrange(9) for _ in range(rng.choice([0, 0, 1, 5, 40]))] for _ in range(rng.randrange(12))]
        ids = [i for d in docs for i in [*d, 9]]
        tail = [1] * rng.choice([0, 3])
        np.array(ids + tail, "<u2").tofile(tmp_path / f"f{k}")
        files.append([len(d) for d in docs] + ([len(tail)] if tail else []))
    blocks = token_files.read_blocks(spark, str(tmp_path), block_ids)
    got = {}
    for r in token_files.document_counts(token_files.scan_blocks(blocks, 9), block_ids).orderBy("file", "place").collect():
        got.setdefault(r["file"], []).append((r["place"], r["n_tokens"], r["start"]))
    assert sorted([n for _, n, _ in v] for v in got.values()) == sorted(f for f in files if f)
    for found in got.values():
        assert [p for p, _, _ in found] == list(range(len(found)))
        assert [s for _, _, s in found] == list(np.cumsum([0] + [n + 1 for _, n, _ in found])[:-1])


def test_counts_of_documents(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    ranks = tokenizers.path("byte_bpe_50k.tiktoken")
    encoding = token_files._encoding(ranks, tokenizers.PATTERN)
    docs = Q.table(spark, SF, "documents").select("doc_id", "text")
    got = {r["doc_id"]: r["n_tokens"] for r in Q.op6_token_counts(spark, SF).collect()}
    assert got == {r["doc_id"]: len(encoding.encode_ordinary(r["text"])) for r in docs.collect()}
    odd = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "<|endoftext|> x"), (None, "é " * 20_000), (3, "ab " * 250_000), (4, "end")], "doc_id long, text string").selectExpr("*", "1 AS file", "2 AS place", "3 AS start")
    counts = token_files.count_tokens(odd, ranks, tokenizers.PATTERN, 50256, block_ids=1_000).collect()
    want = sorted(((r["doc_id"] or 0, len(encoding.encode_ordinary(r["text"] or ""))) for r in odd.collect()))
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in counts) == want and want[-2][1] > 2 * token_files.BLOCK_IDS
    whole = token_files.count_tokens(odd, ranks, tokenizers.PATTERN, 50256).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in whole) == want
    assert token_files.count_tokens(odd.limit(0), ranks, tokenizers.PATTERN, 50256).count() == 0
