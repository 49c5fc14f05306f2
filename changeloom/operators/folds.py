"""What the entries of one changeset come to, and an order in which they can be applied.

Folding follows what each path holds through the steps, in one pass with look-ups by
path, for many changesets in parallel. Orders are column work: each entry gets the
place of the earliest entry that must not come before it, and one sort does the rest.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from changeloom.functions.scalars import ancestors_of
from changeloom.operators.entries import KEY
from changeloom.schema import ADD, DEL, REN, UPD

COLUMNS = ["action", "name", "old_name", "is_directory"]


def _above(path: str) -> Iterator[str]:
    """The directories that hold a path."""
    at = path.find("/")
    while at >= 0:
        yield path[:at]
        at = path.find("/", at + 1)


@dataclass(eq=False)
class _Thing:
    """What a step has touched. ``source`` is its path before the changeset, None if it
    was not there; ``path`` its path now, None if it is not there any more."""

    place: int
    source: str | None
    path: str | None
    directory: bool | None
    moved: bool = False  # by a rename, whatever became of it
    void: bool = False

    def entry(self) -> dict:
        if self.path is None:
            return {"action": DEL, "name": self.source, "old_name": None, "is_directory": self.directory}
        if self.source is None:
            return {"action": ADD, "name": self.path, "old_name": None, "is_directory": self.directory}
        return {"action": REN, "name": self.path, "old_name": self.source, "is_directory": self.directory}


class _Changeset:
    """Things by where they are now, and renamed ones by where they came from and by
    the directories that they are in."""

    def __init__(self):
        self.things: list[_Thing] = []
        self.here: dict[str, _Thing] = {}
        self.left: dict[str, _Thing] = {}
        self.within: dict[str, dict[_Thing, None]] = {}
        self.updates: list[tuple[int, dict]] = []

    def _renamed(self, thing: _Thing, path: str | None) -> None:
        """Puts a renamed thing to ``path``; None takes it out of the look-ups."""
        for d in _above(thing.path or ""):
            self.within.get(d, {}).pop(thing, None)
        if path is None:
            self.left.pop(thing.source, None)
        else:
            for d in _above(path):
                self.within.setdefault(d, {})[thing] = None
        thing.path = path

    def _new(self, *values) -> _Thing:
        self.things.append(_Thing(*values))
        return self.things[-1]

    def add(self, place: int, name: str, directory: bool | None) -> None:
        late = self.left.get(name)
        if late and not self.within.get(name):  # renames are listed first: this is what was renamed
            path = late.path
            self._renamed(late, None)
            late.source, late.path, late.directory = None, path, directory
            return
        before = self.here.get(name)
        if before and before.source is None:
            return
        if before:
            place, before.void = before.place, True
            self._renamed(before, None)
        self.here[name] = self._new(place, None, name, directory)

    def delete(self, place: int, name: str, directory: bool | None) -> None:
        thing = self.here.pop(name, None)
        if thing is None:
            self._new(place, name, None, directory)
        elif thing.source is None:
            thing.void = True
        else:
            self._renamed(thing, None)
            thing.directory = directory

    def rename(self, place: int, old: str, name: str, directory: bool | None) -> None:
        for inner in list(self.within.get(old, ())):
            self.here.pop(inner.path, None)
            self._renamed(inner, name + inner.path[len(old) :])
            self.here[inner.path] = inner
        thing, there = self.here.pop(old, None), self.here.get(name)
        if thing is None:
            if there and there.source is None:
                return
            thing = self._new(place, old, None, directory, True)
            self.left[old] = thing
        if thing.source is None:
            thing.path = name
        else:
            self._renamed(thing, name)
        self.here[name] = thing

    def update(self, place: int, name: str, directory: bool | None) -> None:
        thing = self.here.get(name)
        if thing is None or thing.source is not None:
            self.updates.append((place, {"action": UPD, "name": name, "old_name": None, "is_directory": directory}))

    def entries(self) -> list[dict]:
        found = [(t.place, t.entry(), t.moved) for t in self.things if not t.void]
        added = {e["name"] for _, e, _ in found if e["action"] == ADD}
        low: dict[str, int] = {}
        for place, entry in [*((p, e) for p, e, _ in found), *self.updates]:
            for name in (entry["name"], entry["old_name"]) if entry["action"] == REN else (entry["name"],):
                for d in _above(name):
                    low[d] = min(place, low.get(d, place))
            low[entry["name"]] = min(place, low.get(entry["name"], place))
        gone: dict[str, int] = {}
        for place, entry, _ in found:
            if entry["action"] == DEL:
                gone[entry["name"]] = min(place, gone.get(entry["name"], place))
        out = []
        for place, entry, moved in [*found, *((p, e, False) for p, e in self.updates if e["name"] not in added)]:
            depth, key = entry["name"].count("/"), (place, 1, 0, place)
            if entry["action"] == ADD:  # parents first, all before what is in them
                key = (low[entry["name"]], 0, depth, place)
            elif entry["action"] == DEL and not moved:
                first = min((gone[d] for d in _above(entry["name"]) if d in gone), default=place)
                if first < place:
                    key = (first, 0, -depth, place)
            out.append((key, entry))
        return [entry for _, entry in sorted(out, key=lambda x: x[0])]


def net_effects(steps: Iterable[dict]) -> list[dict]:
    """A patch's steps (action, name, old_name, is_directory) as what they come to.

    What is added and moved is added where it ends, what is added and deleted was
    never there, what is moved and deleted is deleted where it was, a chain of
    moves is one, and what is added needs no update. An addition of a path that
    was moved away is that of what was moved, because patches list moves first,
    unless something was moved to below that path. A move to a path that is added
    as well gives way to the addition. Moves to below a directory that moves later
    end in its new place.

    Everything stands where its first step stood, but an addition before what
    names its path or one below, and a deletion before that of its directory.
    """
    found = _Changeset()
    for place, s in enumerate(steps):
        if s["action"] == ADD:
            found.add(place, s["name"], s["is_directory"])
        elif s["action"] == DEL:
            found.delete(place, s["name"], s["is_directory"])
        elif s["action"] == REN:
            found.rename(place, s["old_name"], s["name"], s["is_directory"])
        else:
            found.update(place, s["name"], s["is_directory"])
    return found.entries()


def fold_patch_entries(entries: DataFrame) -> DataFrame:
    """``net_effects`` of each changeset, pos given anew. Changesets are mostly small,
    so each task takes many of them from one sorted stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        out: list[tuple] = []
        for key, group in groupby(rows, key=lambda r: r[:2]):
            done = net_effects(dict(zip(COLUMNS, r[3:], strict=True)) for r in group)
            out += [(*key, pos, *(e[c] for c in COLUMNS)) for pos, e in enumerate(done)]
            if len(out) >= 10_000:
                yield _batch(out, arrow)
                out = []
        if out:
            yield _batch(out, arrow)

    types = dict(entries.dtypes)
    schema = StructType.fromDDL(", ".join(f"{c} {types[c]}" for c in KEY) + ", pos int, action string, name string, old_name string, is_directory boolean")
    arrow = to_arrow_schema(schema)
    # The window has the rows dealt by changeset, unless they are already, and sorted by pos.
    placed = entries.select(*KEY, F.row_number().over(Window.partitionBy(*KEY).orderBy("pos")).alias("pos"), *COLUMNS)
    return placed.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def order_directories_first(entries: DataFrame) -> DataFrame:
    """Entries in an order in which they can be applied one by one, pos given anew.

    They come as delta lists give them: renames, additions, deletions, updates. An
    added or renamed directory goes before what lies in it; a deletion before a
    rename to, or an addition of, its path, and before the deletion of a directory
    whose name its own begins with. What must not move stays.
    """
    # All steps go by changeset, so that rows are dealt once and only sorted anew: an entry
    # visits the paths that it is compared at, and takes home what stood there before it.
    e = entries.select(*KEY, "pos", *COLUMNS)
    depth = lambda c: F.size(F.split(c, "/"))
    enters = F.col("action").isin(ADD, REN) & F.coalesce("is_directory", F.lit(False))
    comes, gone = F.col("action").isin(ADD, REN), F.col("action") == DEL
    dir_gone = gone & F.coalesce("is_directory", F.lit(False))
    before = lambda at: Window.partitionBy(*KEY, at).orderBy("pos").rangeBetween(Window.unboundedPreceding, -1)
    home = F.array(F.struct(F.col("name").alias("at"), F.lit(False).alias("away")))

    def visits(paths: Column) -> Column:
        return F.explode(F.concat(home, F.coalesce(F.transform(paths, lambda p: F.struct(p.alias("at"), F.lit(True).alias("away"))), F.slice(home, 1, 0))))

    # Directories that enter: the first entry below them.
    dirs = F.max(enters).over(Window.partitionBy(*KEY))
    e = e.withColumn("_dirs", dirs).withColumn("_visit", visits(F.when(F.col("_dirs"), ancestors_of(F.col("name")))))
    first = F.min(F.when(F.col("_visit.away"), F.col("pos"))).over(before("_visit.at"))
    e = e.withColumn("_first", F.when(enters, first)).where("NOT _visit.away").withColumn("_place", F.coalesce("_first", "pos")).drop("_visit", "_first", "_dirs")
    # Deletions: of what comes to their path, and of deleted directories that begin their name.
    to = F.struct(F.col("_place").alias("place"), depth("name").alias("depth"))
    came = F.min(F.when(comes, to)).over(before("name"))
    late = F.struct(F.col("pos").alias("place"), F.lit(1 << 30).alias("depth"))
    e = e.withColumn("_to", F.when(gone, F.coalesce(came, late)))
    # Of a name's beginnings only those as long as some deleted directory's name can be one.
    sizes = F.collect_set(F.when(dir_gone & (F.col("name") != ""), F.length("name"))).over(Window.partitionBy(*KEY))
    heads = F.transform(F.filter("_sizes", lambda k: k <= F.length("name")), lambda k: F.substr("name", F.lit(1), k))
    e = e.withColumn("_sizes", sizes).withColumn("_visit", visits(F.when(gone, heads)))
    stands, away = ~F.col("_visit.away") & dir_gone, F.col("_visit.away")
    e = e.withColumns({"_out": F.min(F.when(stands, F.col("_to"))).over(before("_visit.at")), "_n": F.count_if(stands).over(before("_visit.at"))})
    mine = Window.partitionBy(*KEY, "pos")
    e = e.withColumns({"_out": F.min(F.when(away, F.col("_out"))).over(mine), "_nested": F.sum(F.when(away, F.col("_n"))).over(mine).cast("int")})
    out = e.where(~away).withColumn("_to", F.least("_to", "_out"))
    stays = F.coalesce(F.col("_to.place"), F.col("_place")) == F.col("pos")
    order = [
        F.coalesce(F.col("_to.place"), F.col("_place")),
        F.when(F.col("action") == DEL, F.when(stays, 1 << 30).otherwise(F.col("_to.depth"))).when(enters, depth("name")).otherwise(1 << 30),
        F.when(stays & ~enters, 1).otherwise(0), F.when(enters, 1).otherwise(0), -F.coalesce("_nested", F.lit(0)), F.col("pos"),
    ]
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy(*order)) - 1
    return out.withColumn("_pos", place.cast("int")).select(*KEY, F.col("_pos").alias("pos"), *COLUMNS)
