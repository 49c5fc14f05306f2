"""Spelling variants of words, by a trie of letter counts.

A word's vector counts its letters by group, groups of frequent letters first. An edit
of one letter takes one from a group at most and adds one to a group at most. So a walk
through the trie of vectors, with one surplus and one deficit to spend, meets every
near word; words at the leaves it meets are verified.

The trie's upper levels are Spark tables: a node of more than CELL words is split by the
next STRIDE groups, and vectors walk on by joins. What is left are cells of few words,
each a trie in the memory of one task, through which the vectors that reach it stream.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, small_batches, stored

ORDER = "etaoinshrdlcumwfgypbvkjxqz"
#: Letters outside of a to z go to so many more groups.
OTHERS = 6
GROUPS = len(ORDER) + OTHERS
STRIDE = 4
CELL = 4096
#: Words of one vector are handled in bundles of so many.
BUNDLE = 64
#: Longer words are compared one by one; of shorter ones all that an edit makes are looked up.
SHORT = 40

_GROUP = {c: g for g, c in enumerate(ORDER)}
#: A count is stored as a character; higher ones are the same character.
_ZERO, _MOST = 0x30, 0x5000


def group_of(letter: str) -> int:
    found = _GROUP.get(letter)
    return len(ORDER) + ord(letter) % OTHERS if found is None else found


def vector(word: str) -> str:
    counts = [0] * GROUPS
    for letter in word:
        counts[group_of(letter)] += 1
    return "".join([chr(_ZERO + min(c, _MOST)) for c in counts])


def steps(counts: str, surplus: int, deficit: int) -> list[tuple[str, int, int]]:
    """All counts that are ``counts`` but for one more and one less somewhere, as far
    as surplus and deficit allow, and what is left of the two."""
    out = [("", surplus, deficit)]
    for c in counts:
        wider = []
        for head, more, less in out:
            wider.append((head + c, more, less))
            if more:
                wider.append((head + chr(ord(c) + 1), 0, less))
            if less and ord(c) > _ZERO:
                wider.append((head + chr(ord(c) - 1), more, 0))
        out = wider
    return out


class Leaf:
    """The words of one vector with their counts, and its letters by group."""

    def __init__(self, vector: str):
        self.vector, self.words, self.letters = vector, {}, {}

    def add(self, word: str, n: int) -> None:
        self.words[word] = n
        for letter in word:
            self.letters.setdefault(group_of(letter), set()).add(letter)

    def near(self, word: str, vector: str) -> Iterable[str]:
        """The leaf's words that one edit makes of ``word``."""
        if len(word) > SHORT:
            return [w for w in self.words if one_edit(word, w)]
        less = next((g for g, (a, b) in enumerate(zip(vector, self.vector)) if a > b), None)
        more = next((g for g, (a, b) in enumerate(zip(vector, self.vector)) if a < b), None)
        if less is None and more is None:  # another letter of the same group
            made = {word[:i] + x + word[i + 1 :] for i, c in enumerate(word) for x in self.letters[group_of(c)] if x != c}
        elif less is None:
            made = {word[:i] + x + word[i:] for i in range(len(word) + 1) for x in self.letters[more]}
        else:
            places = [i for i, c in enumerate(word) if group_of(c) == less]
            made = {word[:i] + x + word[i + 1 :] for i in places for x in ([""] if more is None else self.letters[more])}
        return made & self.words.keys()


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one code point inserted, deleted or replaced makes b of a."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


class Trie:
    """Leaves below their vectors' letter counts."""

    def __init__(self):
        self.root: dict = {}

    def add(self, vector: str, word: str, n: int) -> None:
        node = self.root
        for c in vector[:-1]:
            node = node.setdefault(c, {})
        leaf = node.get(vector[-1])
        if leaf is None:
            leaf = node[vector[-1]] = Leaf(vector)
        leaf.add(word, n)

    def walk(self, vector: str) -> list[Leaf]:
        """The leaves within one surplus and one deficit, depth first."""
        out, stack = [], [(self.root, 0, 1, 1)]
        while stack:
            node, depth, more, less = stack.pop()
            if depth == GROUPS:
                out.append(node)
                continue
            count = ord(vector[depth])
            for c, child in node.items():
                extra = ord(c) - count
                if extra == 0:
                    stack.append((child, depth + 1, more, less))
                elif extra == 1 and more:
                    stack.append((child, depth + 1, 0, less))
                elif extra == -1 and less:
                    stack.append((child, depth + 1, more, 0))
        return out


LINKS = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows are sorted by cell, then (visits or not), then vector: a cell's words come
    before those that visit it."""
    cell = vector = None
    trie, leaves, rows = Trie(), [], []
    for batch in batches:
        for node, part, visits, both, vec, words, counts in zip(*(c.to_pylist() for c in batch.columns)):
            if (node, part) != cell:
                cell, vector, trie = (node, part), None, Trie()
            if not visits:
                for word, n in zip(words, counts):
                    trie.add(vec, word, n)
                continue
            if vec != vector:
                vector, leaves = vec, trie.walk(vec)
            for leaf in leaves:
                for word, n in zip(words, counts):
                    for other in leaf.near(word, vec):
                        rows.append((word, other, leaf.words[other]))
                        if both:
                            rows.append((other, word, n))
            if len(rows) > 20_000:
                yield _batch(rows)
                rows = []
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), LINKS)], schema=LINKS)


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n) for all pairs of ``words`` (word, n), distinct words, that
    differ by one letter inserted, deleted or replaced; each pair in both directions.

    Null and empty words have none. Cells and bundles are bounded whatever the words
    are: a vector of more than CELL words is a cell in several parts, and what visits
    one visits all. Only a cell's words are held in a task; a cell is visited from
    cells that are no deeper, of which no more than some hundreds can be near it.
    """
    spark = words.sparkSession
    small_batches(spark)
    vectors = map_batches(words.where("word <> '' AND n IS NOT NULL").select("word", F.col("n").cast("long").alias("n")), lambda r: r | {"vec": [vector(w) for w in r["word"]]}, "word string, n long, vec string")
    numbered = vectors.withColumn("_k", F.row_number().over(Window.partitionBy("vec").orderBy("word")) - 1)
    bundles = numbered.groupBy("vec", F.floor(F.col("_k") / BUNDLE).alias("bundle")).agg(F.collect_list(F.struct("word", "n")).alias("_w"))
    bundles = stored(bundles.select("vec", "bundle", F.col("_w.word").alias("words"), F.col("_w.n").alias("counts")), "bundles")

    # Split nodes of too many words; what is in small enough ones stays there.
    depth, left, cells = 0, bundles, []
    while True:
        depth = min(depth + STRIDE, GROUPS)
        at = left.withColumn("node", F.substring("vec", 1, depth))
        sizes = at.groupBy("node").agg(F.sum(F.size("words")).alias("_n"))
        sizes = sizes.withColumn("deep", F.lit(depth)).withColumn("parts", F.when(F.lit(depth < GROUPS) & (F.col("_n") > CELL), 0).otherwise(F.ceil(F.col("_n") / CELL)).cast("int")).drop("_n")
        level = stored(at.join(sizes, "node"), "cells")
        cells.append(level.where("parts > 0"))
        left = level.where("parts = 0").select(*bundles.columns)
        if not left.head(1):
            break
    items = cells[0]
    for level in cells[1:]:
        items = items.union(level)
    items = stored(items, "cells")
    nodes = items.select("node", "parts").distinct()

    # Walk from level to level; a vector visits cells that are as deep as its own or deeper.
    walker = F.substring("vec", 1, 0).alias("node"), F.lit(1).alias("more"), F.lit(1).alias("less")
    front, visits = items.select("vec", "bundle", "words", "counts", F.col("deep").alias("own"), *walker), None
    for deep in range(STRIDE, depth + STRIDE, STRIDE):
        deep = min(deep, GROUPS)
        wider = _stepped(front, deep)
        deeper = items.where(f"deep > {deep}").select(F.substring("node", 1, deep).alias("node"), F.lit(0).alias("parts"), F.lit(False).alias("cell")).distinct()
        here = nodes.where(F.length("node") == deep).withColumn("cell", F.lit(True)).union(deeper)
        met = stored(wider.join(here, "node"), "walk")
        reached = met.where("cell").where(f"own <= {deep}").withColumn("both", F.col("own") < deep)
        reached = reached.select("node", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("visits"), "both", "vec", "words", "counts")
        visits = reached if visits is None else visits.union(reached)
        front = met.where("NOT cell").select(*front.columns)
    rows = items.select("node", F.expr("CAST(bundle % parts AS int)").alias("part"), F.lit(False).alias("visits"), F.lit(False).alias("both"), "vec", "words", "counts").union(visits)
    return rows.repartition("node", "part").sortWithinPartitions("node", "part", "visits", "vec").mapInArrow(_links, "word string, near string, near_n long")


def _stepped(front: DataFrame, deep: int) -> DataFrame:
    """The walkers at every node of the next level that they may go to."""
    names = front.columns

    def stepped(rows: dict) -> dict:
        out = {c: [] for c in names}
        for i, (vec, node, more, less) in enumerate(zip(rows["vec"], rows["node"], rows["more"], rows["less"])):
            for counts, m, d in steps(vec[len(node) : deep], more, less):
                for c in ("vec", "bundle", "words", "counts", "own"):
                    out[c].append(rows[c][i])
                out["node"].append(node + counts)
                out["more"].append(m)
                out["less"].append(d)
        return out

    return map_batches(front, stepped, ", ".join(f"{c} {t}" for c, t in front.dtypes))


def spelling_groups(words: DataFrame, times: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row of ``words`` (word, n).

    form is the near word of largest n, of equals the smallest by code points, if its n
    is at least ``times`` the word's, else null, and so is form_n; n_near counts near
    words. root is the last of the forms that follow on each other, or the word. Words
    must be distinct; null or empty ones are left out. An empty table gives one, other
    columns are ignored.

    Forms grow ``times``-fold from one to the next, so roots are found in as many
    rounds of pointer doubling as the logarithm of a logarithm.
    """
    words = stored(words.where("word <> '' AND n IS NOT NULL").select("word", F.col("n").cast("long").alias("n")), "words")
    links = near_words(words)
    best = links.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n"))
    formed = F.coalesce(F.col("form_n") >= times * F.col("n"), F.lit(False))
    found = stored(found.select("word", "n", "n_near", F.when(formed, F.col("form")).alias("form"), F.when(formed, F.col("form_n")).alias("form_n")), "forms")
    roots = stored(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("_root"))
        moved = roots.join(on, "root", "left").select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("_moved"))
        moved = stored(moved, "roots")
        roots = moved.select("word", "root")
        if not moved.where("_moved").head(1):
            break
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
