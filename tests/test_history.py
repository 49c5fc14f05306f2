"""Operators of the history library on small histories."""

import random
import re
import textwrap
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from changeloom.functions import scalars as S
from changeloom.functions.reflow import refill
from changeloom.operators import adapt, cells, changesets, digests, entries, folds, graph, tree
from changeloom.plans import registry
from changeloom.sources import commit_logs, file_logs, xml_logs

SF = "/root/testdata/sf0.001"
ENTRY = "repo string, seq long, pos int, action string, name string, old_name string, is_directory boolean"


def frame(spark, rows, seq=1):
    return spark.createDataFrame([("r", seq, k, a, n, o, d) for k, (a, n, o, d) in enumerate(rows)], ENTRY)


# Renames of several additions of one path


@pytest.mark.parametrize("turned", [False, True])
def test_of_equal_additions_one_is_the_rename(spark, turned):
    """The last by pos, wherever rows come from; by branch notes the first."""
    rows = [("r", 1, 0, "DEL", "o", None, None), *(("r", 1, k, "ADD", "n", "o", None) for k in (1, 2, 3))]
    df = spark.createDataFrame(rows[::-1] if turned else rows, ENTRY).coalesce(1)
    renamed = lambda out: [r["pos"] for r in out.where("action = 'REN'").collect()]
    assert renamed(entries.detect_renames(df)) == [3]
    notes = spark.createDataFrame([("r", 1, "n", "o")], "repo string, seq long, name string, origin string")
    assert renamed(entries.renames_by_branch_note(df.withColumn("old_name", F.lit(None).cast("string")), notes)) == [1]


@pytest.mark.parametrize("turned", [False, True])
def test_equal_changesets_are_ordered_by_revision(spark, turned):
    rows = [("r", datetime(2024, 1, 1), "u", "m", str(k)) for k in range(5)]
    df = spark.createDataFrame(rows[::-1] if turned else rows, "repo string, date_utc timestamp, author string, log string, revision string").coalesce(1)
    assert [r["revision"] for r in changesets.order_changesets(df).orderBy("seq").collect()] == list("01234")


def test_a_tree_that_all_changesets_share(spark):
    """Added directories get the paths below them as if the tree were given for each changeset."""
    rows = [("r", k, 0, "ADD", "d", None, True) for k in range(40)] + [("r", 3, 1, "UPD", "d/a", None, False), ("q", 1, 0, "ADD", "d/e", None, True)]
    df = spark.createDataFrame(rows, ENTRY)
    shared = spark.createDataFrame([("r", "d/a"), ("r", "d/e/b"), ("r", "c"), ("q", "d/e/z"), ("q", "d/y")], "repo string, path string")
    found = lambda tree: sorted((r["repo"], r["seq"], r["name"], r["action"], r["pos"]) for r in entries.expand_added_dir(df, tree).collect())
    assert found(shared) == found(df.select("repo", "seq").distinct().join(shared, "repo"))
    assert len(found(shared)) == 42 + 79 + 1


# Copies and replacements


class Copies:
    """The rule, stated for each entry alone: items are (action, name, old_name, copied)."""

    def __init__(self, items):
        self.items = {i[1]: i for i in items}
        self.source = {n: old for n, (action, _, old, _) in self.items.items() if action in ("ADD", "REP") and old}
        self.copy_of = {old: max(n for n, o in self.source.items() if o == old) for old in self.source.values()}

    def credits(self, giver, taker):
        """Whether the end of ``giver``'s old content makes ``taker`` a rename."""
        old = self.source.get(taker)
        if old is None or self.copy_of[old] != taker or not self.frees(giver):
            return False
        return old == giver or (old.startswith(giver + "/") and giver not in self.copy_of)

    def frees(self, name):
        """Deletions do; replacements do unless an entry of a smaller name has made them renames."""
        action = self.items[name][0]
        return action == "DEL" or (action == "REP" and not any(self.credits(n, name) for n in self.items if n < name))

    def action(self, name):
        """None for an entry that vanishes."""
        action, _, old, _ = self.items[name]
        if action == "DEL":
            return None if name in self.copy_of else "DEL"
        if action == "REP" and self.frees(name):
            return "REN" if old else "ADD"
        givers = [n for n in self.items if self.credits(n, name)]
        below = any(i[3] and name.startswith(n + "/") for n, i in self.items.items())
        if below and not any(n > name for n in givers):
            return "ADD"
        return "REN" if givers else action

    def result(self):
        late = lambda n: self.items[n][0] in ("DEL", "REP") and self.frees(n)
        return [(self.action(n), n) for n in sorted(self.items, key=lambda n: (late(n), n)) if self.action(n)]


def test_copies_in_every_order(spark):
    rng = random.Random(7)
    paths = ["a", "a/b", "a/b/c", "b", "b/x", "c", "c/y", "d/e", "d/e/f", "e"]
    rows, want = [], {}
    for seq in range(400):
        names = rng.sample(paths, rng.randint(1, 7))
        items = []
        for name in names:
            action = rng.choice(["ADD", "ADD", "DEL", "UPD", "REP"])
            old = rng.choice([None, *paths]) if action in ("ADD", "REP") else None
            old = None if old == name else old
            items.append((action, name, old, old is not None or (action == "ADD" and rng.random() < 0.2)))
        want[seq] = Copies(items).result()
        rows += [("r", seq, k, *i) for k, i in enumerate(items)]
    df = spark.createDataFrame(rows, "repo string, seq long, pos int, action string, name string, old_name string, copied boolean")
    got = {}
    for r in entries.resolve_copies(df).orderBy("seq", "pos").collect():
        got.setdefault(r["seq"], []).append((r["action"], r["name"]))
    wrong = {s for s in want if got.get(s, []) != want[s]}
    assert not wrong, {s: ([i[3:] for i in rows if i[1] == s], got.get(s), want[s]) for s in list(wrong)[:2]}


def test_copies_are_resolved_where_changesets_are_dealt(spark):
    """Rows are dealt once, by changeset, and joined with nothing, also below those of a view
    that is dealt so."""
    df = spark.createDataFrame([("r", 0, 0, "DEL", "a", None, False), ("r", 0, 1, "ADD", "b", "a/x", True)], "repo string, seq long, pos int, action string, name string, old_name string, copied boolean")
    found = entries.resolve_copies(df)
    assert [(r["action"], r["name"]) for r in found.orderBy("pos").collect()] == [("REN", "b"), ("DEL", "a")]
    for rows in (found, registry.queries()["j1_to_j4_resolve_copies"](spark, SF)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("Exchange ") == 1


def test_folded_rows_are_dealt_once(spark):
    """A view that is dealt by changeset is not dealt anew to be folded."""
    plan = registry.queries()["e1_fold_patch_entries"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1


def test_changelists_are_written_once(spark):
    """Heads and entries are read from stored descriptions; the view is worked out again for notes only."""
    plan = registry.queries()["s7_changelist"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_orderkey") and plan.count("collect_list") == 0


# Forests


@pytest.mark.parametrize("block", [40, 7])
def test_trees_are_walked_whole(spark, monkeypatch, block):
    """Where no revision has several parents levels are depths and nothing is settled in rounds,
    and what reaches back through a tree of a block takes one round, however deep it is."""
    edges = [("r", c * 100 + d, c * 100 + d - 1) for c in range(20) for d in range(1, 25)] + [("s", 5000 + d, 5000) for d in range(1, 60)]
    df = spark.createDataFrame(edges, "repo string, child long, parent long")
    names, before = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda rows, name: names.append(name) or before(rows, name))
    got = {(r["repo"], r["revision"]): (r["level"], r["seq"]) for r in graph.topo_order(df, block=block).collect()}
    levels = {("r", c * 100 + d): d for c in range(20) for d in range(25)} | {("s", 5000 + d): min(d, 1) for d in range(60)}
    for repo in "rs":
        order = sorted((n for n in levels if n[0] == repo), key=lambda n: (levels[n], n[1]))
        assert [got[n] for n in order] == [(levels[n], k) for k, n in enumerate(order)]
    assert len(got) == len(levels) and "done" not in names
    names.clear()
    roots = spark.createDataFrame([("r", c * 100 + 24) for c in range(0, 20, 2)] + [("s", 5007)], "repo string, revision long")
    found = sorted((r["repo"], r["revision"]) for r in graph.reachable(df, roots, block=block).collect())
    assert found == sorted([("r", c * 100 + d) for c in range(0, 20, 2) for d in range(24)] + [("s", 5000)])
    assert block < 25 or names.count("got") <= 2  # the tree of 60 is in several blocks


# Folds

A, D, U, R = "ADD", "DEL", "UPD", "REN"


def e(action, name, old=None, directory=False):
    return {"action": action, "name": name, "old_name": old, "is_directory": directory}


@pytest.mark.parametrize(("steps", "left"), [
    ([e(A, "x"), e(D, "x")], []),
    ([e(A, "x"), e(R, "y", "x")], [(A, "y")]),
    ([e(R, "y", "x"), e(D, "y")], [(D, "x")]),
    ([e(R, "y", "x"), e(R, "z", "y")], [(R, "z")]),
    ([e(A, "x"), e(U, "x")], [(A, "x")]),
    ([e(R, "y", "x"), e(A, "x")], [(A, "y")]),
    ([e(R, "y", "x"), e(U, "y"), e(A, "x")], [(A, "y")]),
    ([e(R, "B", "A"), e(U, "c"), e(A, "B")], [(A, "B"), (U, "c")]),
    ([e(A, "B"), e(R, "B", "A")], [(A, "B")]),
    ([e(A, "d/f"), e(A, "d", None, True)], [(A, "d"), (A, "d/f")]),
    ([e(R, "d/e/f", "o"), e(A, "d/e", None, True), e(A, "d", None, True)], [(A, "d"), (A, "d/e"), (R, "d/e/f")]),
    ([e(R, "x", "d/f"), e(A, "d", None, True)], [(A, "d"), (R, "x")]),
    ([e(R, "d2", "d"), e(R, "d/b", "d2"), e(A, "d", None, True)], [(A, "d"), (R, "d/b")]),
    ([e(R, "d/a", "o/a"), e(R, "n", "d")], [(R, "n/a"), (R, "n")]),
    ([e(D, "d"), e(D, "d/f")], [(D, "d/f"), (D, "d")]),
    ([e(D, "d", None, True), e(D, "d/s", None, True), e(D, "d/s/f"), e(D, "db")], [(D, "d/s/f"), (D, "d/s"), (D, "d"), (D, "db")]),
])
def test_fold(steps, left):
    assert [(x["action"], x["name"]) for x in folds.net_effects(steps)] == left


def test_deletion_tells_what_was_deleted():
    assert folds.net_effects([e(R, "y", "x", False), e(D, "y", None, True)]) == [e(D, "x", None, True)]


def replayed(tree, steps):
    """The tree (path: what is there) after steps in order."""
    tree = dict(tree)
    for k, s in enumerate(steps):
        if s["action"] == A:
            tree[s["name"]] = "new"
        elif s["action"] == D:
            del tree[s["name"]]
        elif s["action"] == R:
            tree[s["name"]] = tree.pop(s["old_name"])
        else:
            tree[s["name"]] += "" if tree[s["name"]] == "new" else "u"
    return tree


def test_net_effects_lead_to_the_same_tree():
    """On random changesets without directories: what is taken away at once, then what is put, then what is changed."""
    rng = random.Random(8)
    for _ in range(2_000):
        start = {n: n for n in rng.sample("abcdefgh", 5)}
        tree, steps, away = dict(start), [], set()
        for _ in range(rng.randint(1, 9)):
            free = [n for n in "abcdefgh" if n not in tree and n not in away]
            step = rng.choice([A, D, U, R])
            if step == A and free:
                steps.append(e(A, rng.choice(free)))
            elif step in (D, U) and tree:
                steps.append(e(step, rng.choice(sorted(tree))))
            elif step == R and tree and free:
                steps.append(e(R, rng.choice(free), rng.choice(sorted(tree))))
                away.add(steps[-1]["old_name"])
            else:
                continue
            tree = replayed(tree, steps[-1:])
        folded, got = folds.net_effects(steps), dict(start)
        taken = [(x, got.pop(x["old_name"] if x["action"] == R else x["name"])) for x in folded if x["action"] in (D, R)]
        got |= {x["name"]: was for x, was in taken if x["action"] == R}
        got |= {x["name"]: "new" for x in folded if x["action"] == A}
        for x in folded:
            assert x["action"] != U or got.get(x["name"]) != "new"
        strip = lambda t: {n: w.rstrip("u") or "u" for n, w in t.items()}
        assert strip(got) == strip(tree), (start, steps, folded)


def test_large_changesets_are_folded_in_linear_time():
    began = time.process_time()
    steps = [e(A, f"d{k % 300}/f{k}") for k in range(40_000)] + [e(A, f"d{k}", None, True) for k in range(300)] + [e(R, f"r{k}", f"q{k}") for k in range(40_000)] + [e(D, f"r{k}") for k in range(0, 40_000, 2)]
    assert len(folds.net_effects(steps)) == 80_300
    assert time.process_time() - began < 20


def test_no_rename_into_a_directory_added_later(spark):
    rng = random.Random(3)
    for _ in range(300):
        steps = [rng.choice([e(A, "d", None, True), e(R, f"d/{k}", f"o/{k}"), e(A, f"d/{k}"), e(U, f"u{k}"), e(D, f"d/{k}")]) for k in range(rng.randint(1, 8))]
        done = folds.net_effects(steps)
        for k, x in enumerate(done):
            if x["action"] == A and x["is_directory"]:
                assert not any(y["action"] == R and y["name"].startswith(x["name"] + "/") for y in done[:k])
    out = folds.fold_patch_entries(frame(spark, [(A, "x", None, False), (D, "x", None, False), (U, "y", None, None)]))
    assert [(r["action"], r["name"], r["pos"]) for r in out.collect()] == [(U, "y", 0)]


@pytest.mark.parametrize(("rows", "want"), [
    ([(R, "d/f", "f", False), (A, "d", None, True), (A, "g", None, False), (D, "g", None, False)], [(A, "d"), (R, "d/f"), (D, "g"), (A, "g")]),
    ([(R, "d/e/f", "f", False), (A, "d/e", None, True), (A, "d", None, True)], [(A, "d"), (A, "d/e"), (R, "d/e/f")]),
    ([(R, "n", "o", True), (D, "n", None, True), (D, "n/x", None, False)], [(D, "n/x"), (D, "n"), (R, "n")]),
    ([(D, "foo", None, True), (D, "foobar", None, False), (D, "foo/s", None, True), (D, "foo/s/x", None, False)], [(D, "foo/s/x"), (D, "foobar"), (D, "foo/s"), (D, "foo")]),
    ([(R, "d/n", "o", False), (A, "d", None, True), (D, "d/n", None, False), (U, "z", None, False)], [(A, "d"), (D, "d/n"), (R, "d/n"), (U, "z")]),
    ([(U, "b", None, False), (U, "a", None, None)], [(U, "b"), (U, "a")]),
])
def test_directories_first(spark, rows, want):
    out = folds.order_directories_first(frame(spark, rows))
    assert [(r["action"], r["name"]) for r in out.orderBy("pos").collect()] == want


# Changesets


def test_collapse_on_random_histories(spark):
    rng = random.Random(5)
    start, rows, names, want = datetime(2024, 1, 1), [], [], {}
    for repo in range(40):
        at, group = start, None
        for seq in range(rng.randint(1, 25)):
            at += timedelta(seconds=rng.choice([0, 10, 179, 180, 181, 400]))
            author, log, tags = rng.choice("ab"), rng.choice("xy"), (["t"] if rng.random() < 0.1 else [])
            acts = {p: rng.choice([A, D]) for p in rng.sample("pqr", rng.randint(1, 2))}
            if group and group["author"] == author and group["log"] == log and (at - group["last"]).total_seconds() < 180 and not group["tags"] and not any(group["acts"].get(p, a) != a for p, a in acts.items()):
                group.update(last=at, tags=tags, acts=group["acts"] | acts)
            else:
                group = {"first": seq, "author": author, "log": log, "last": at, "tags": tags, "acts": acts}
            want[str(repo), seq] = group
            rows.append((str(repo), seq, at, author, log, tags))
            names += [(str(repo), seq, p, a) for p, a in acts.items()]
    df = spark.createDataFrame(rows, "repo string, seq long, date_utc timestamp, author string, log string, tags array<string>")
    ents = spark.createDataFrame(names, "repo string, seq long, name string, action string")
    got = {(r["repo"], r["seq"]): (r["group"], r["group_date"]) for r in changesets.collapse_changesets(df, ents).collect()}
    assert got == {k: (g["first"], g["last"]) for k, g in want.items()}


def test_tags_and_start(spark):
    df = spark.createDataFrame([("r", 0, "a", None, ["x"], False, []), ("r", 1, "b", "h", ["x"], True, ["a"]), ("r", 2, "c", None, ["x", "y"], False, ["b"])], "repo string, seq long, revision string, patch_hash string, tags array<string>, tag_only boolean, parents array<string>")
    assert [(r["seq"], r["tag"]) for r in changesets.suppress_repeat_tags(df).orderBy("seq", "tag").collect()] == [(0, "x"), (2, "x"), (2, "y")]
    df = df.withColumns({"date_utc": F.lit(datetime(2024, 1, 2)), "branches": F.array(F.lit("main"))})
    assert changesets.resolve_start(df, "y").count() == 1 and changesets.resolve_start(df, "main INITIAL").count() == 3
    assert changesets.resolve_start(df, "2024-01-02 00:00").count() == 3 and changesets.resolve_start(df, "b").count() == 2
    on_parent = changesets.attach_parent_tags(df, spark.createDataFrame([("r", "a", "v1"), ("r", "c", "v2")], "repo string, revision string, tag string"))
    assert {r["seq"]: r["tags"] for r in on_parent.collect()} == {0: [], 1: ["v1"], 2: []}


def test_identity_with_and_without_hash(spark):
    at = datetime(2024, 1, 1)
    df = spark.createDataFrame([("r", k, "1", h, at, "a") for k, h in enumerate(["h1", "h2", None, "h1"])], "repo string, seq long, revision string, patch_hash string, date_utc timestamp, author string")
    assert sorted(r["patch_hash"] for r in changesets.dedupe(df).collect()) == ["h1", "h2"]


# Graphs and trees


def test_topological_order_of_random_graphs(spark):
    rng = random.Random(9)
    edges = list({(str(g), b, a) for g in range(3) for b in range(1, 60) for a in rng.sample(range(b), min(b, rng.choice([1, 1, 1, 2, 3])))})
    df = spark.createDataFrame(edges, "repo string, child long, parent long")
    level = {}
    for g, b, _ in sorted(edges):
        level[g, b] = 0
        for x, y, a in edges:
            if (x, y) == (g, b):
                level[g, b] = max(level[g, b], level.get((g, a), 0) + 1)
    rows = graph.topo_order(df).collect()
    assert all(r["level"] == level.get((r["repo"], r["revision"]), 0) for r in rows)
    seq = {(r["repo"], r["revision"]): r["seq"] for r in rows}
    assert all(seq[g, a] < seq[g, b] for g, b, a in edges)
    up = graph.reachable(df, spark.createDataFrame([("0", 59)], "repo string, revision long"))
    seen, todo = set(), [59]
    while todo:
        b = todo.pop()
        for g, y, a in edges:
            if g == "0" and y == b and a not in seen:
                seen.add(a)
                todo.append(a)
    assert {r["revision"] for r in up.collect()} == seen


def test_intervals_follow_renames(spark):
    steps = [(0, A, "a", None), (1, R, "b", "a"), (2, U, "b", None), (3, D, "b", None), (4, A, "a", None)]
    df = spark.createDataFrame([("r", s, 0, a, n, o, f"1.{s}") for s, a, n, o in steps], "repo string, seq long, pos int, action string, name string, old_name string, new_rev string")
    got = sorted((r["path"], r["rev"], r["from_seq"], r["to_seq"] or -1) for r in tree.tree_intervals(df).collect())
    assert got == [("a", "1.0", 0, 1), ("a", "1.4", 4, -1), ("b", "1.1", 1, 2), ("b", "1.2", 2, 3)]
    assert tree.tree_at(tree.tree_intervals(df), 3).count() == 0


def test_checks_and_hooks(spark):
    a, b = spark.range(3), spark.range(1, 4)
    assert sorted((r["id"], r["side"]) for r in tree.leftover_check(a, b).collect()) == [(0, "expected"), (3, "actual")]
    good, bad = tree.quarantine_bad(a, {"even": F.col("id") % 2 == 0})
    assert good.count() == 2 and [r["errors"] for r in bad.collect()] == [["even"]]
    with pytest.raises(Exception, match="even"):
        tree.quarantine_bad(a, {"even": F.col("id") % 2 == 0}, strict=True)[0].count()
    called = []
    adapt.after_hooks(a, [lambda df: called.append(df.count())])
    assert called == [3]


# Text


def wrapped(log, width=70):
    """The rule of ``refill`` over the standard library's wrapping."""
    if log is None:
        return None
    parts = re.split(r"(?m)^ *[-*] ", log.strip())
    if len(parts) > 1 and not parts[0]:
        parts = parts[1:]
    first, rest = ("- ", "  ") if len(parts) > 1 else ("", "")
    return "\n\n".join(textwrap.fill(" ".join(p.split()), width, initial_indent=first, subsequent_indent=rest) for p in parts if p)


def test_refill(spark):
    words = ["a", "be", "word", "well-known", "so--called", "x-y-zed", "--", "-", "*", "end.", "-o", "1-2", "Ünï-cödé", "---", "state-of-the-art", "\"q\"--r"]
    words += ["w" * 69, "w" * 70, "w" * 71, "v" * 150, "http://host/" + "path-1/" * 14, "-" * 72, "--" + "z" * 80, "a-" * 60, "é" * 140 + "-1"]
    rng, texts = random.Random(4), [None, "", " \n", "  one\n two ", "- a b\n  c\n* d", "intro\n- a", "- only", "- a\n- \n- b", "a\n\n\t- b", "x\n-no\n - yes", "word " * 3000, "v" * 100_000]
    for size in (3, 12, 60):
        texts += ["".join(rng.choice(words[: rng.choice([8, 16, len(words)])]) + rng.choice([" ", " ", "  ", "\n", "\n- ", "\t"]) for _ in range(size)) for _ in range(60)]
    for width in (70, 20):
        got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", refill(F.col("t"), width).alias("r")).collect()
        assert len(got) == len(texts)
        for row in got:
            assert row["r"] == wrapped(texts[row["k"]], width), texts[row["k"]]


@pytest.mark.parametrize(("rev", "key"), [("1.2.0.2 locked", [1, 2, 2]), ("", [0]), (None, [0]), ("1.1.1.1", [1, 1]), ("1.10", [1, 10]), ("1.2.2.3", [1, 2, 2, 3])])
def test_rev_key(spark, rev, key):
    assert spark.createDataFrame([(rev,)], "r string").select(S.rev_key(F.col("r"))).first()[0] == key


def test_odd_values(spark):
    df = spark.createDataFrame([("", None), (None, "x"), ("a/../../b//c/", "+2500"), ("..", "-0130")], "p string, t string")
    assert [r[0] for r in df.select(S.normalized_path(F.col("p"))).collect()] == ["", None, "b/c", ""]
    assert [r[0] for r in df.select(S.tz_minutes(F.col("t"))).collect()] == [None, None, None, -90]
    assert [r[0] for r in df.select(F.size(S.ancestors_of(F.coalesce("p", F.lit("x"))))).collect()] == [0, 0, 6, 0]
    assert [r[0] for r in df.select(S.parse_date("iso", F.col("t"))).collect()] == [None] * 4


@pytest.mark.parametrize(("kind", "text", "good"), [
    ("iso", "2024-01-02T03:04:05.678901Z", True), ("iso", "2024-01-02 03:04:05", True), ("iso", "-0130", False), ("iso", "2024", False), ("iso", "2024-01-02 03:04:05 x", False), ("iso", "2024-13-02 03:04:05", False),
    ("compact", "20240102030405", True), ("compact", "2024", False), ("compact", "x20240102030405", False), ("compact", "99999999999999", False),
])
def test_dates_are_whole(spark, kind, text, good):
    found = spark.createDataFrame([(text,)], "t string").select(F.unix_seconds(S.parse_date(kind, F.col("t")))).first()[0]
    assert found == (1704164645 if good else None)


def test_default_characters(spark):
    text = "".join(map(chr, range(256)))
    row = spark.createDataFrame([(text,)], "t string").select(S.scrub_chars(F.col("t")), S.map_chars(F.col("t")), S.map_chars(F.col("t"), {"a": "bb", "b": "a", "c": "d"})).first()
    bad = {*range(0, 10), 11, 12, *range(14, 32), 127}
    assert len(bad) == 31 and row[0] == "".join("?" if k in bad else chr(k) for k in range(256))
    assert row[1].startswith(text[:0xB4]) and "&#180;" in row[1] and "&#336;" in row[1] and "&#369;" in row[1] and "\xe4" in row[1] and "\xfc" not in row[1]
    assert row[2] == text.translate({97: "bb", 98: "a", 99: "d"})


@pytest.mark.parametrize(("data", "charset", "want"), [
    (b"a\xff\xef\xbf\xbdb", "UTF-8", ["a\ufffd\ufffdb", "a\ufffdb", None]), (b"plain", "UTF-8", ["plain"] * 3), (b"a\x81b", "windows-1252", ["a\ufffdb", "ab", None]), (b"\xe9", "ISO-8859-1", ["é"] * 3), (None, "UTF-8", [None] * 3), (None, "US-ASCII", [None] * 3),
])
def test_decoding_policies(spark, data, charset, want):
    frame = spark.createDataFrame([(data,)], "d binary")
    assert list(frame.select(*(S.decode_text(F.col("d"), charset, p) for p in ("replace", "ignore", "quarantine"))).first()) == want


def test_parsers_of_very_long_records(spark):
    """Messages of 100,000 lines and quoted values of a million characters."""
    lines = 100_000
    long = '"' + 'say \\" \\\\ ' * 100_000 + '"'
    certs = spark.createDataFrame([("r", "1", f'name "changelog"\nvalue {long}\n')], "repo string, revision string, value string")
    found = commit_logs.ingest_certs(certs).first()
    assert found["name"] == "changelog" and found["value"] == 'say " \\ ' * 100_000
    stanza = spark.createDataFrame([("r", "1", f"add_file {long}\n")], "repo string, revision string, value string")
    assert commit_logs.ingest_stanza_diff(stanza).first()["action"] == A
    change = "Change 1 by u@h on 2024/01/02 03:04:05\n\n" + "\tline\n" * lines + "\nAffected files ...\n\n... //depot/a#1 add\n"
    heads, ents = commit_logs.ingest_changelist(spark.createDataFrame([("r", change)], "repo string, value string"))
    assert heads.first()["log"].count("\n") == lines - 1 and ents.count() == 1
    symbols = "RCS file: /r/mod/f,v\nsymbolic names:\n" + "".join(f"\tt{k}: 1.{k}\n" for k in range(lines)) + "total revisions: 0;\tselected revisions: 0\n" + file_logs.FILE_END + "\n"
    assert file_logs.ingest_symbols(spark.createDataFrame([("r", symbols)], "repo string, value string"), "mod").count() == lines
    preview = "Tue Jan  2 03:04:05 CET 2024 u\n  * name\n" + "  line\n" * lines + "\n"
    assert xml_logs.ingest_pull_preview(spark.createDataFrame([("r", preview)], "repo string, value string")).first()["log"].count("\n") == lines - 1


def test_members_of_equal_revisions(spark):
    rows = [("r", 1, 0, "f", "1.2", "1.3"), ("r", 1, 1, "f", "INITIAL", "1.4(DEAD)"), ("r", 1, 2, "f", "1.1", "1.4"), ("r", 1, 3, "g", "1.1", "1.2"), ("r", 1, 4, "g", "1.1", "1.2(DEAD)")]
    df = spark.createDataFrame(rows, "repo string, seq long, pos int, name string, old_rev string, new_rev string")
    assert [(r["name"], r["action"], r["old_rev"], r["new_rev"]) for r in entries.merge_members(df).orderBy("name").collect()] == [("f", A, None, "1.4"), ("g", D, "1.1", "1.2")]


def test_snapshots_with_copies(spark):
    before = spark.createDataFrame([("r", 1, p, "1") for p in "abcd"], "repo string, seq long, path string, rev string")
    after = spark.createDataFrame([("r", 1, p, v) for p, v in (("a", "2"), ("b", "1"), ("x", "1"), ("y", "1"), ("z", "1"))], "repo string, seq long, path string, rev string")
    copies = spark.createDataFrame([("r", 1, "x", "c"), ("r", 1, "y", "c"), ("r", 1, "z", "a")], "repo string, seq long, path string, source string")
    got = sorted((r["action"], r["name"], r["old_name"]) for r in entries.snapshot_diff(before, after, copies).collect())
    assert got == [(A, "y", None), (A, "z", None), (D, "d", None), (R, "x", "c"), (U, "a", None)]


def test_directories_come_and_go(spark):
    steps = [(0, A, "d/e/a"), (1, D, "d/e/a"), (2, A, "d/b"), (3, D, "d/b"), (3, A, "d/c"), (4, D, "x")]
    df = spark.createDataFrame([("r", s, k, a, n, None, "1") for k, (s, a, n) in enumerate(steps)], "repo string, seq long, pos int, action string, name string, old_name string, new_rev string")
    assert sorted((r["seq"], r["path"]) for r in tree.synthesize_dir_adds(df).collect()) == [(0, "d"), (0, "d/e"), (2, "d")]
    gone = spark.createDataFrame([("r", s, D, n) for s, n in ((1, "d"), (2, "d"), (3, "d/e"), (0, "d"), (4, "x"))], "repo string, seq long, action string, name string")
    assert {(r["seq"], r["name"]): r["is_directory"] for r in tree.flag_deleted_dirs(gone, tree.tree_intervals(df)).collect()} == {(1, "d"): True, (2, "d"): False, (3, "d/e"): False, (0, "d"): False, (4, "x"): False}


def test_cells_equal_windows(spark):
    """Sums and neighbours cell by cell are those of one window, with nulls and gaps."""
    rng = random.Random(4)
    rows = [(r, s, rng.choice([None, "a", "b"]), rng.randrange(5)) for r in "xyz" for s in sorted(rng.sample(range(400), 60))]
    df = spark.createDataFrame(rows, "repo string, seq long, v string, d long")
    got = {(r["repo"], r["seq"]): (r["prev"], r["until"], r["total"]) for r in cells.running(cells.with_next(cells.with_previous(df, "seq", "v", "prev", cell=7), "seq", "until", cell=7), "seq", "d", "total", cell=7).collect()}
    for repo in "xyz":
        own, total = [r for r in rows if r[0] == repo], 0
        for k, (_, seq, _, d) in enumerate(own):
            total += d
            assert got[repo, seq] == (own[k - 1][2] if k else None, own[k + 1][1] if k + 1 < len(own) else 1 << 62, total)


def test_reach_from_inside_runs(spark):
    edges = spark.createDataFrame([("r", k + 1, k) for k in range(30)] + [("r", 100, 20), ("r", 101, 100), ("s", 5, 4)], "repo string, child long, parent long")
    reach = lambda roots, way="ancestors": sorted(r["revision"] for r in graph.reachable(edges, spark.createDataFrame([("r", k) for k in roots], "repo string, revision long"), way).collect())
    assert reach([7]) == list(range(7)) and reach([7, 10]) == list(range(10)) and reach([0]) == [] and reach([]) == []
    assert reach([101]) == [*range(21), 100] and reach([18], "descendants") == [*range(19, 31), 100, 101]


def test_locks_and_dashes_in_a_log(spark):
    text = "RCS file: /r/mod/Attic/f,v\nsymbolic names:\ntotal revisions: 2;\tselected revisions: 2\ndescription:\n" + file_logs.BLOCK_END + "\nrevision 1.2\tlocked by: x;\ndate: 1999-05-17 10:00:00 +0000;  author: u;  state: Exp;  lines: +1 -1\nfirst\n" + file_logs.BLOCK_END + "\nnot a revision\n" + file_logs.BLOCK_END + "\nrevision 1.1\ndate: 1999/05/16 10:00:00;  author: u;  state: Exp;\n*** empty log message ***\n" + file_logs.FILE_END + "\n"
    rows = file_logs.ingest_file_log(spark.createDataFrame([("r", text)], "repo string, value string"), "mod").orderBy("rev").collect()
    assert [(r["path"], r["rev"], r["has_lines"], r["log"]) for r in rows] == [("f", "1.1", False, ""), ("f", "1.2", True, "first\n" + file_logs.BLOCK_END + "\nnot a revision")]
    assert file_logs.ingest_file_log(spark.createDataFrame([("r", "")], "repo string, value string")).count() == 0


def test_xml_log_from_files(spark, tmp_path):
    (tmp_path / "log.xml").write_text('<?xml version="1.0"?><log><logentry revision="7"><author>u</author><date>2024-01-02T03:04:05.6Z</date><paths><path action="A" copyfrom-path="/out/a" copyfrom-rev="1">/m/b</path><path action="D">/out/a</path></paths><msg>é</msg></logentry></log>')
    rows = xml_logs.read_xml_log(spark, str(tmp_path), "m").collect()
    assert [(r["revision"], r["action"], r["name"], r["old_name"], r["copied"], r["log"]) for r in rows] == [("7", A, "b", None, True, "é")]


@pytest.mark.parametrize("lost", ["repo", "date_utc", "author", "log", "revision"])
def test_null_keys_are_kept(spark, lost):
    """A row with a null in a key column is grouped, numbered and de-duplicated like any other."""
    day = datetime(2024, 1, 1)
    row = {"repo": "r", "date_utc": day, "author": "u", "log": "m", "revision": "1"}
    odd = row | {lost: None}
    whole = spark.createDataFrame([row | {"n": 0}, odd | {"n": 1}, odd | {"n": 2}], "repo string, date_utc timestamp, author string, log string, revision string, n int")
    if lost != "revision":
        revs = whole.drop("revision").selectExpr("*", "concat('p', n) AS path", "'1.1' AS rev", "'ADD' AS action")
        heads, rows = changesets.collect_by_key(revs)
        assert heads.count() == 2 and rows.count() == 3
        assert {(r["repo"], r["seq"]) for r in rows.collect()} == {(r["repo"], r["seq"]) for r in heads.collect()}
    numbered = changesets.order_changesets(whole)
    seqs = sorted((r["repo"] or "", r["seq"]) for r in numbered.collect())
    assert seqs == ([("", 0), ("", 1), ("r", 0)] if lost == "repo" else [("r", k) for k in range(3)])
    files = numbered.selectExpr("repo", "seq", "0 AS pos", "if(n = 2, 'DEL', 'UPD') AS action", "'f' AS name")
    groups = changesets.collapse_changesets(numbered, files).collect()
    assert len(groups) == 3 and len({(r["repo"], r["group"]) for r in groups if r["n"]}) == 2
    found = changesets.dedupe(numbered.selectExpr("*", "CAST(NULL AS string) AS patch_hash")).collect()
    assert len(found) == (1 if lost == "log" else 2)


def test_cells_of_null_keys_and_places(spark):
    """Every user of cells keeps rows of null repo and null seq."""
    rows = [("r", 1), (None, 1), (None, 2), (None, None), ("r", None)]
    df = spark.createDataFrame(rows, "repo string, seq long").selectExpr("*", "1L AS d", "'x' AS v", "'g' AS g")
    for made in (cells.running(df, "seq", "d", "n"), cells.with_next(df, "seq", "n"), cells.with_previous(df, "seq", "v", "n"), cells.following_least(df, "seq", "d", "n"), cells.running_greatest(df, "seq", "d", "n"), cells.group_greatest(df, "seq", "g", "d", "n")):
        assert sorted(((r["repo"], r["seq"]) for r in made.collect()), key=repr) == sorted(rows, key=repr)
    sets = spark.createDataFrame([(r, s, str(s), ["t"], False) for r, s in rows], "repo string, seq long, revision string, tags array<string>, tag_only boolean")
    assert changesets.suppress_repeat_tags(sets).count() == 5 and graph.graft_branch(sets, "base").count() == 5
    linear = graph.linearize(sets.where("seq IS NOT NULL").drop("seq").withColumn("branches", F.array(F.lit("b"))), sets.select("repo", "revision", "seq"), "b")
    assert sorted(((r["repo"], r["seq"]) for r in linear.collect()), key=repr) == sorted(((a, b) for a, b in rows if b), key=repr)


def test_extremes_cell_by_cell(spark):
    rng = random.Random(6)
    rows = [(r, s, rng.choice([None, 1, 5, 9]), rng.choice("gh")) for r in "xy" for s in sorted(rng.sample(range(300), 80))]
    df = spark.createDataFrame(rows, "repo string, seq long, v long, g string")
    got = cells.group_greatest(cells.running_greatest(cells.following_least(df, "seq", "v", "least", cell=9), "seq", "v", "most", cell=9), "seq", "g", "v", "all", cell=9)
    for r in got.collect():
        own = [x for x in rows if x[0] == r["repo"] and x[2] is not None]
        assert r["least"] == min((v for _, s, v, _ in own if s >= r["seq"]), default=None)
        assert r["most"] == max((v for _, s, v, _ in own if s <= r["seq"]), default=None)
        assert r["all"] == max(v for _, _, v, g in own if g == r["g"])


def test_points_in_spans(spark, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK", 2)
    monkeypatch.setattr(cells, "FACTOR", 3)
    monkeypatch.setattr(cells, "LEVELS", 4)
    rng = random.Random(8)
    points = [(rng.choice([None, "a", "b"]), rng.randrange(300), k) for k in range(150)]
    spans = [(rng.choice([None, "a", "b"]), a, rng.choice([a - 1, a, a + 1, a + 7, a + 100, 2_000]), k) for k in range(60) for a in [rng.randrange(-3, 300)]]
    got = cells.starting_within(spark.createDataFrame(points, "repo string, at long, p long"), spark.createDataFrame(spans, "repo string, lo long, hi long, s long"), "at", "lo", "hi", ["repo"])
    want = sorted((p, s) for r, at, p in points for q, lo, hi, s in spans if r == q and lo <= at < hi)
    assert sorted((r["p"], r["s"]) for r in got.collect()) == want


def test_dense_islands_in_many_tasks(spark):
    """One repo, one author, a second apart: 200,000 changesets of one island, cut by 20,000 clashes."""
    n = 200_000
    rows = spark.range(n).selectExpr("'r' AS repo", "id AS seq", "timestamp_seconds(1700000000 + id) AS date_utc", "'u' AS author", "'m' AS log")
    acts = rows.selectExpr("repo", "seq", "concat('p', seq % 10) AS name", "if(floor(seq / 10) % 2 = 0, 'UPD', 'DEL') AS action")
    began = time.time()
    found = changesets.collapse_changesets(rows, acts)
    got = found.groupBy("group").agg(F.count("*").alias("n"), F.min("seq").alias("lo"), F.max("group_date").alias("date"), F.max("date_utc").alias("last")).collect()
    assert len(got) == n // 10 and all(r["n"] == 10 and r["lo"] == r["group"] and r["date"] == r["last"] for r in got)
    assert changesets.collapse_changesets(rows).select("group", "group_date").distinct().count() == 1
    assert time.time() - began < 240


def test_order_and_reach_in_small_blocks(spark):
    rng = random.Random(3)
    edges = {(rng.choice([None, "a"]), b, a) for b in range(1, 70) for a in rng.sample(range(b), min(b, rng.choice([1, 1, 2])))}
    df = spark.createDataFrame(sorted(edges, key=repr), "repo string, child long, parent long")
    level = {}
    for g, b, a in sorted(edges, key=lambda e: (e[1], repr(e))):
        level[g, b] = max(level.get((g, b), 0), level.setdefault((g, a), 0) + 1)
    rows = graph.topo_order(df, block=25).collect()
    assert {(r["repo"], r["revision"]): r["level"] for r in rows} == level
    for repo in (None, "a"):
        own = sorted((r["level"], r["revision"], r["seq"]) for r in rows if r["repo"] == repo)
        assert [s for _, _, s in own] == list(range(len(own)))
        root = max(b for g, b, _ in edges if g == repo)
        seen, todo = set(), [root]
        while todo:
            b = todo.pop()
            fresh = {a for g, y, a in edges if g == repo and y == b} - seen
            seen |= fresh
            todo += fresh
        got = graph.reachable(df, spark.createDataFrame([(repo, root)], "repo string, revision long"), block=25).collect()
        assert {(r["repo"], r["revision"]) for r in got} == {(repo, v) for v in seen}


@pytest.mark.parametrize(("edges", "stuck"), [
    ([(1, 1)], {1}), ([(1, 2), (2, 1), (1, 0), (3, 2), (4, 0)], {1, 2, 3}), ([(k, (k + 1) % 6) for k in range(6)] + [(2, 9), (8, 4), (8, 9)], {*range(6), 8}),
])
def test_cycles_are_told(spark, edges, stuck):
    df = spark.createDataFrame([("r", c, p) for c, p in edges], "repo string, child long, parent long")
    with pytest.raises(graph.CycleError, match=f"^{len(stuck)} revisions .*such as {min(stuck)} of r"):
        graph.topo_order(df)
    rows = graph.topo_order(df, cycles="flag").collect()
    assert {r["revision"] for r in rows if r["level"] is None and r["seq"] is None} == stuck
    assert {r["revision"] for r in rows} == {v for e in edges for v in e}
    for way, step in (("ancestors", 1), ("descendants", -1)):
        seen, todo = set(), [min(stuck)]
        while todo:
            v = todo.pop()
            fresh = {b for a, b in (e[::step] for e in edges) if a == v} - seen
            seen |= fresh
            todo += fresh
        got = graph.reachable(df, spark.createDataFrame([("r", min(stuck))], "repo string, revision long"), way)
        assert {r["revision"] for r in got.collect()} == seen


def test_many_merges_take_few_rounds(spark):
    """A ladder of 30,000 merges: each commit stands on the one before and on a side commit."""
    n = 30_000
    main = spark.range(1, n).selectExpr("'r' AS repo", "2 * id AS child", "2 * id - 2 AS parent")
    side = spark.range(1, n).selectExpr("'r' AS repo", "2 * id + 1 AS child", "2 * id - 2 AS parent")
    merge = spark.range(2, n).selectExpr("'r' AS repo", "2 * id AS child", "2 * id - 1 AS parent")
    began = time.time()
    found = graph.topo_order(main.union(side).union(merge))
    assert found.agg(F.max("level"), F.count("*")).first()[0] >= n - 1
    up = graph.reachable(main.union(side).union(merge), spark.createDataFrame([("r", 2 * n - 2)], "repo string, revision long"))
    assert up.count() > 2 * n - 10
    assert time.time() - began < 180


def test_tags_of_counts_that_stand_still(spark):
    """Updates that change no count give no stretches; a tag before the first changeset is placed there."""
    rows = [("r", s, 0, U if s > 1 else A, f"p{s % 2}", None, str(s)) for s in range(40)]
    df = spark.createDataFrame(rows, "repo string, seq long, pos int, action string, name string, old_name string, new_rev string")
    intervals = tree.tree_intervals(df)
    assert tree.live_counts(intervals).count() == 2
    before = spark.createDataFrame([("r", "p0", "0"), ("r", "p1", "1")], "repo string, path string, rev string")
    since = tree.intervals_since(df.where("seq > 1"), before)
    tags = before.withColumn("tag", F.lit("old")).union(spark.createDataFrame([("r", "p0", "8", "t"), ("r", "p1", "7", "t"), ("r", "p1", "7", "wrong"), ("r", "p0", "8", "x"), ("r", "p1", "9", "x")], "repo string, path string, rev string, tag string"))
    placed = tree.place_tags(since, tags)
    assert sorted((r["tag"], r["from_seq"], r["to_seq"]) for r in placed.collect()) == [("old", -1, 2), ("t", 8, 9), ("x", 9, 10)]
    made = tree.tagging_changesets(placed).collect()
    assert [(r["seq"], r["author"], r["revision"], r["log"], r["tags"]) for r in made] == [(-1, "unknown tagger", "1900-01-01 00:00:00 by unknown tagger", "tag 1900-01-01 00:00:00+00:00 ['old']", ["old"])]
    assert tree.tagging_changesets(placed, "2024-05-06 07:08:09").first()["log"] == "tag 2024-05-06 07:08:09+00:00 ['old']"


def test_stored_trees_are_compared_from_the_top(spark, tmp_path, monkeypatch):
    """Of 2,000 directories a handful is opened; nulls, repos of null and lost directories are told."""
    whole = {(repo, f"d{k % 7}/e{k % 50}/s{k % 4}/f{k}"): str(k % 3) for k in range(8_000) for repo in ("a", None) if repo or k < 100}
    other = dict(whole) | {("a", "d1/e1/s1/f1"): "new", ("a", "top"): None, (None, "x/y/z"): "1", ("a", "d0/e0/s0/f0"): None}
    for name in [n for n in other if n[1].startswith("d3/e17/")]:
        del other[name]
    kinds = {n: "missing" for n in whole if n not in other} | {n: "extra" for n in other if n not in whole} | {n: "changed" for n in whole if n in other and whole[n] != other[n]}
    for name, held in (("source", whole), ("target", other)):
        digests.store_tree(spark.createDataFrame([(r, p, h) for (r, p), h in held.items()], "repo string, path string, hash string"), str(tmp_path / name))
    paths = str(tmp_path / "source"), str(tmp_path / "target")
    for named in (digests.NAMED, 0):  # the second joins the directories' names only
        monkeypatch.setattr(digests, "NAMED", named)
        assert {(r["repo"], r["path"]): r["kind"] for r in digests.verify_stored_trees(spark, *paths).collect()} == kinds
    opened = {(r["repo"], r["dir"]) for r in digests.differing_directories(spark, *paths).collect()}
    assert {n[1].rsplit("/", 1)[0] for n in kinds if "/" in n[1]} <= {d for _, d in opened} and len(opened) < 30
    assert digests.verify_stored_trees(spark, paths[0], paths[0]).count() == 0


def test_reports_of_one_repo_are_told_apart(spark):
    one = "A   no\n* applying changeset a\nA   a1\n* patching\n=>  o\t./n\nC   f\n--  p\n* reapplying local changes\nM   no\n* applying changeset b\nD   b1\n"
    rows = file_logs.ingest_apply_report(spark.createDataFrame([("r", 1, one), ("r", 2, "* applying changeset c\nch  c1"), ("r", 3, ""), (None, 4, None)], "repo string, n int, value string"), key=("repo", "n")).collect()
    assert sorted((r["n"], r["pos"], r["action"], r["name"], r["old_name"], r["conflict"]) for r in rows if r["action"]) == [(1, 0, A, "a1", None, False), (1, 1, R, "n", "o", False), (1, 3, D, "b1", None, False), (2, 0, U, "c1", None, False)]
    assert [(r["pos"], r["name"]) for r in rows if r["conflict"]] == [(2, "f")]


def test_directories_first_deals_rows_once(spark):
    """A changeset goes to one task and stays there; null repos are a repo."""
    steps = [("ADD", "a/b/f", False), ("REN", "a/b", True), ("ADD", "a", True), ("DEL", "c/d", False), ("DEL", "c", True), ("DEL", "c/e/f", False), ("DEL", "a/b", False)]
    rows = [(repo, 1, pos, action, name, "old" if action == "REN" else None, directory) for repo in ("r", None) for pos, (action, name, directory) in enumerate(steps)]
    out = folds.order_directories_first(spark.createDataFrame(rows, "repo string, seq long, pos int, action string, name string, old_name string, is_directory boolean"))
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {repo: [r["action"] + " " + r["name"] for r in sorted(out.collect(), key=lambda r: r["pos"]) if r["repo"] == repo] for repo in ("r", None)}
    assert got[None] == got["r"] == ["ADD a", "DEL a/b", "REN a/b", "ADD a/b/f", "DEL c/d", "DEL c/e/f", "DEL c"]
