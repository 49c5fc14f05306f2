"""Reflowing of messages as column work."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f]"
BULLET = r"(?md)^ *[-*] "
#: Where a word may be cut: behind a hyphen between letters, before and behind a dash between words.
HYPHEN = r"(?<=[^\d\W]{2}-|[^\d\W]-[^\d\W]-)(?=[^\d\W]-?[^\d\W])"
BEFORE = r"""(?<=[\w!"'&.,?])(?=-{2,}\w)"""
BEHIND = r"""(?<=[\w!"'&.,?]-{2,255})(?=\w)"""
CUTS = f"{HYPHEN}|{BEFORE}|{BEHIND}"
#: Where a word that is longer than a line may be cut: behind any hyphen but the leading ones.
ANY_HYPHEN = r"(?<=-)(?<!^-{1,255})"


def refill(log: Column, width: int = 70) -> Column:
    """Paragraphs wrapped at ``width`` characters, and an empty line between them.

    A bullet ("- " or "* " at the beginning of a line) begins a paragraph. Where there
    are bullets and more than one paragraph all get "- " and a hanging indent. White
    space of any kind separates words. Words that do not fit move to the next line, or
    are cut behind hyphens; longer ones than a line are cut anywhere. Null stays null,
    and a message without words is empty.
    """
    text = F.regexp_replace(log, f"(?U)^{SPACE}+|{SPACE}+$", "")
    return F.when(log.isNotNull(), F.array_join(_once(F.split(text, BULLET, -1), lambda parts: _filled(parts, width)), "\n\n"))


def _once(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is computed once, however often it is named."""
    return F.transform(F.array(value), fn)[0]


def _filled(parts: Column, width: int) -> Column:
    listed = (F.size(parts) > 2) | ((F.size(parts) > 1) & (parts[0] != ""))
    return F.when(listed, _paragraphs(parts, width, "- ", "  ")).otherwise(_paragraphs(parts, width, "", ""))


def _paragraphs(parts: Column, width: int, first: str, rest: str) -> Column:
    room = width - len(first)
    line = f"(?U)(.{{1,{room}}})(?: |\\z|{CUTS})"  # the longest beginning behind which a line may end

    def paragraph(text: Column) -> Column:
        long = F.regexp_like(text, F.lit(f"[^ ]{{{room + 1}}}"))
        lines = F.when(long, _lines(F.split(text, " ", -1), room)).otherwise(F.regexp_extract_all(text, F.lit(line), 1))
        return F.when(text == "", "").otherwise(F.concat(F.lit(first), F.array_join(lines, "\n" + rest)))

    plain = F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.trim(F.regexp_replace(p, f"(?U){SPACE}+", " ")))
    return F.transform(plain, paragraph)


def _units(words: Column, room: int) -> Column:
    """(text, apart: a blank stands before it, long: it is part of a piece longer than a line)."""

    def pieces(word: Column) -> Column:
        found = F.when(F.contains(word, F.lit("-")), F.split(word, f"(?U){CUTS}", -1)).otherwise(F.array(word))
        return F.flatten(F.transform(found, lambda piece, k: units(piece, k == 0)))

    def units(piece: Column, begins: Column) -> Column:
        long = F.length(piece) > room
        parts = F.when(long, F.filter(F.split(piece, ANY_HYPHEN, -1), lambda u: u != "")).otherwise(F.array(piece))
        return F.transform(parts, lambda u, k: F.struct(u.alias("text"), (begins & (k == 0)).alias("apart"), long.alias("long"), (k > 0).alias("within")))

    return F.flatten(F.transform(words, pieces))


def _lines(words: Column, room: int) -> Column:
    """Lines of at most ``room`` characters, word by word. A step copies the line that is open, and
    the references to those before it only when it ends."""
    begin = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))

    def state(done: Column, line: Column) -> Column:
        return F.struct(done.alias("done"), line.alias("line"))

    def ended(done: Column, *lines: Column) -> Column:
        return F.concat(done, F.array(*lines))

    def cut(done: Column, text: Column) -> Column:
        """A new line with ``text``, which may be longer than a line."""
        full = F.floor((F.greatest(F.length(text), F.lit(1)) - 1) / room).cast("int")
        pieces = F.transform(F.sequence(F.lit(0), full), lambda k: F.substr(text, k * room + 1, F.lit(room)))
        return F.when(full == 0, state(done, text)).otherwise(state(F.concat(done, F.slice(pieces, 1, full)), F.element_at(pieces, -1)))

    def step(held: Column, unit: Column) -> Column:
        done, line, text = held["done"], held["line"], unit["text"]
        joined = F.concat(line, F.when(unit["apart"] & (line != ""), " ").otherwise(""))
        left = room - F.length(joined)
        fits = F.length(text) <= left
        moved = (~unit["long"] | unit["within"] | (left < 0)) & (line != "")
        return (
            F.when(fits, state(done, F.concat(joined, text)))
            .when(moved, cut(ended(done, line), text))
            .otherwise(cut(ended(done, F.concat(joined, F.substr(text, F.lit(1), left))), F.substr(text, left + 1)))
        )

    found = F.aggregate(_units(words, room), begin, step)
    return F.filter(F.concat(found["done"], F.array(found["line"])), lambda x: x != "")
