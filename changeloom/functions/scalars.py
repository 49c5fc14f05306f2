"""Column functions: revision numbers, paths, authors, dates, messages, tags, text clean-up."""

from __future__ import annotations

import re
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from changeloom.schema import ADD, ANONYMOUS, DEL, REN, UPD

# Revision numbers


def rev_key(rev: Column) -> Column:
    """'1.2.0.2 locked' as [1, 2, 2]: arrays compare like revisions.

    Null and '' give [0]; a 0 before the last number goes; [1, 1, 1, 1] is [1, 1].
    """
    word = F.substring_index(F.trim(F.coalesce(rev, F.lit(""))), " ", 1)
    numbers = F.transform(F.split(F.when(word == "", "0").otherwise(word), r"\."), lambda x: x.cast("int"))
    n = F.size(numbers)
    short = F.when((n > 2) & (F.get(numbers, n - 2) == 0), F.concat(F.slice(numbers, F.lit(1), F.greatest(n - 2, F.lit(0))), F.slice(numbers, -1, 1))).otherwise(numbers)
    return F.when(short == F.array(*[F.lit(1)] * 4), F.array(F.lit(1), F.lit(1))).otherwise(short)


def rev_text(key: Column) -> Column:
    return F.array_join(key.cast("array<string>"), ".")


def rev_cmp(a: Column, b: Column) -> Column:
    """-1, 0 or 1 as revision a is older than, equal to or newer than b."""
    return F.when(rev_key(a) < rev_key(b), -1).when(rev_key(a) == rev_key(b), 0).otherwise(1)


def is_branch(key: Column) -> Column:
    return F.size(key) % 2 == 1


def branch_of(key: Column) -> Column:
    """All numbers but the last."""
    return F.slice(key, F.lit(1), F.greatest(F.size(key) - 1, F.lit(0)))


def same_branch(a: Column, b: Column) -> Column:
    """Whether two keys, of branches or of revisions, are on one branch."""
    return (
        F.when(is_branch(a) & is_branch(b), a == b)
        .when(~is_branch(a) & ~is_branch(b), branch_of(a) == branch_of(b))
        .otherwise((branch_of(a) == b) | (a == branch_of(b)))
    )


# Paths


def ancestors_of(path: Column) -> Column:
    """All parent directories, the topmost first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).otherwise(F.array().cast("array<string>"))


def parent_of(path: Column) -> Column:
    """The directory that holds a path, '' at the top."""
    return F.regexp_replace(path, "(^|/)[^/]*$", "")


def normalized_path(path: Column) -> Column:
    """Without '//', '.', 'x/..' and trailing slash; a leading '..' goes too."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p)))
    return F.array_join(kept, "/")


def trimmed_path(path: Column, n: int = 1) -> Column:
    """Without the first n components; '' if there are no more than n."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, F.lit(n + 1), F.greatest(F.size(parts) - n, F.lit(0))), "/")


# Actions and authors

#: Native action codes of each kind of source. Fixed values.
ACTION_CODES = {
    "xml": {"A": ADD, "D": DEL, "M": UPD, "R": REN},
    "commit": {"A": ADD, "D": DEL, "M": UPD, "T": UPD, "R": REN, "C": ADD},
    "changelist": {"add": ADD, "branch": ADD, "delete": DEL, "edit": UPD, "integrate": UPD},
    "patch": {"add_file": ADD, "add_directory": ADD, "remove_file": DEL, "remove_directory": DEL, "modify_file": UPD, "move": REN},
    "report": {"A": ADD, "D": DEL, "M": UPD, "ch": UPD, "cl": UPD, "=>": REN, "/>": REN},
}


def map_action(kind: str, code: Column) -> Column:
    """ADD, DEL, UPD or REN of a source's own code; null for one it does not have."""
    pairs = [F.lit(x) for item in ACTION_CODES[kind].items() for x in item]
    return F.element_at(F.create_map(*pairs), code)


def default_author(author: Column) -> Column:
    return F.coalesce(F.nullif(author, F.lit("")), F.lit(ANONYMOUS))


def author_name(author: Column) -> Column:
    """The name before an address in angle brackets, or all that is before '@'."""
    bracket = F.trim(F.regexp_extract(author, r"^([^<]*)<[^>]*>", 1))
    return F.when(bracket != "", bracket).when(F.contains(author, F.lit("@")), F.regexp_extract(author, r"<?([^<@]*)@", 1)).otherwise(F.trim(author))


def author_email(author: Column, host: str = "localhost", default: str | None = None) -> Column:
    """The address; without one name@host, or default@host where a default is given."""
    bracket = F.regexp_extract(author, r"<([^>]*)>", 1)
    made = F.concat(F.lit(default) if default else author_name(author), F.lit("@" + host))
    return F.when(bracket != "", bracket).when(F.contains(author, F.lit("@")), F.trim(author)).otherwise(made)


# Dates

#: How the kinds of source write dates; the pattern's groups are year, month or its name, day, time.
_MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def _month(name: Column) -> Column:
    return F.lpad(F.array_position(F.array(*map(F.lit, _MONTHS)), name).cast("string"), 2, "0")


def parse_date(kind: str, text: Column) -> Column:
    """A date as a source of ``kind`` writes it, read as UTC; null if it is none.

    compact yyyyMMddHHmmss; words 'EEE MMM d HH:mm:ss ZZZ yyyy', whose zone is
    not looked at; iso with or without a fraction and Z; slash 'yyyy/MM/dd
    HH:mm:ss', or with dashes; short 'EEE MMM d HH:mm:ss yyyy'.
    """
    if kind == "compact":
        stamp = F.regexp_replace(F.regexp_extract(text, r"^\d{14}$", 0), r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)$", r"$1-$2-$3 $4:$5:$6")
    elif kind in ("words", "short"):
        pattern = r"^\w{3}\s+(\w{3})\s+(\d+)\s+(\d\d:\d\d:\d\d)\s+" + (r"\S+\s+" if kind == "words" else "") + r"(\d{4})$"
        part = lambda k: F.regexp_extract(text, pattern, k)
        stamp = F.concat(part(4), F.lit("-"), _month(part(1)), F.lit("-"), F.lpad(part(2), 2, "0"), F.lit(" "), part(3))
    elif kind == "iso":
        stamp = F.replace(F.regexp_extract(text, r"^(\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:\.\d+)?)Z?$", 1), F.lit("T"), F.lit(" "))
    elif kind == "slash":
        stamp = F.regexp_replace(F.regexp_extract(text, r"^(\d{4}[/-]\d\d?[/-]\d\d?\s+\d\d?:\d\d:\d\d)", 1), "/", "-")
    else:
        raise ValueError(f"no kind of date: {kind}")
    return F.try_to_timestamp(F.nullif(stamp, F.lit("")))


def tz_minutes(text: Column, flipped: bool = False) -> Column:
    """'+0530' as 330; flipped for sources that count the other way; null outside a day."""
    sign = F.when(F.startswith(text, F.lit("-")), -1).otherwise(1)
    digits = F.regexp_extract(text, r"^[+-]?(\d{2}):?(\d{2})$", 0)
    minutes = sign * (F.regexp_extract(text, r"(\d{2}):?(\d{2})$", 1).try_cast("int") * 60 + F.regexp_extract(text, r"(\d{2}):?(\d{2})$", 2).try_cast("int"))
    return F.when((digits != "") & (F.abs(minutes) < 1440), -minutes if flipped else minutes)


def tz_from_pair(local: Column, utc: Column) -> Column:
    """Minutes by which a local stamp is ahead of the same moment's UTC stamp."""
    return F.floor((F.unix_seconds(local) - F.unix_seconds(utc)) / 60).cast("int")


# Messages


def first_log_line(log: Column) -> Column:
    return F.when(F.coalesce(log, F.lit("")) == "", "Empty log message").otherwise(F.substring_index(log, "\n", 1))


def remaining_log(log: Column) -> Column:
    """What follows the first line end, '' without one."""
    at = F.locate("\n", log)
    return F.when(at > 0, F.substr(log, at + 1)).otherwise("")


def patch_name(template: str, fields: Mapping[str, Column], log: Column) -> Column:
    """A template with %(name)s places, filled from columns; firstlogline and
    remaininglog come from the log. An empty template gives the log itself."""
    if not template:
        return F.coalesce(log, F.lit(""))
    known = {"firstlogline": first_log_line(log), "remaininglog": remaining_log(log), **fields}
    parts = re.split(r"%\((\w+)\)s", template)
    return F.concat(*(F.coalesce(known[p].cast("string"), F.lit("")) if k % 2 else F.lit(p) for k, p in enumerate(parts)))


def patch_body(template: str, log: Column, strip_first_line: bool) -> Column:
    """The message below a patch name: none for an empty template, without its
    first line if the name already has it."""
    if not template:
        return F.lit("")
    return remaining_log(log) if strip_first_line else F.coalesce(log, F.lit(""))


def strip_noise(log: Column) -> Column:
    """Without a leading 'Ignore-this: <hex>' line."""
    return F.regexp_replace(log, r"^Ignore-this: [0-9a-fA-F]+\n?\n?", "")


def default_message(style: str, message: Column) -> Column:
    """Message as a target of ``style`` wants it: changelog, commit, space or lines."""
    m = F.coalesce(message, F.lit(""))
    if style == "changelog":
        return F.when(m == "", "Empty changelog").otherwise(m)
    if style == "commit":
        return F.when(m == "", "No commit message\n").when(F.endswith(m, F.lit("\n")), m).otherwise(F.concat(m, F.lit("\n")))
    if style == "space":
        return F.when(m == "", " ").otherwise(m)
    if style == "lines":
        return F.regexp_replace(m, r"^\n+", "")
    raise ValueError(f"no style of message: {style}")


def patch_hash(name: Column, author: Column, date: Column, log_lines: Column) -> Column:
    """Identity of a patch from its preview: date, digest of the author, digest of all.

    'UNDO: ' marks an inverted patch, and 'tagged ' a tag named 'TAG '.
    """
    inverted = F.startswith(name, F.lit("UNDO: "))
    plain = F.when(inverted, F.substr(name, F.lit(7))).otherwise(name)
    plain = F.when(F.startswith(plain, F.lit("tagged ")), F.concat(F.lit("TAG "), F.substr(plain, F.lit(8)))).otherwise(plain)
    stamp = F.date_format(date, "yyyyMMddHHmmss")
    whole = F.concat(plain, author, stamp, F.array_join(log_lines, ""), F.when(inverted, "t").otherwise("f"))
    return F.concat(stamp, F.lit("-"), F.substring(F.sha1(author.cast("binary")), 1, 5), F.lit("-"), F.sha1(whole.cast("binary")), F.lit(".gz"))


def safe_tag(style: str, tag: Column) -> Column:
    """A tag's name as a target of ``style`` allows it: file, hash or path."""
    if style == "path":
        return F.replace(tag, F.lit("/"), F.lit("_"))
    plain = F.regexp_replace(tag, "[^A-Za-z0-9_-]", "_")
    if style == "file":
        return F.when(F.rlike(plain, F.lit("^[A-Za-z]")), plain).otherwise(F.concat(F.lit("tag-"), plain))
    if style == "hash":
        return F.regexp_replace(F.replace(plain, F.lit("__"), F.lit("_")), "_+$", "")
    raise ValueError(f"no style of tag: {style}")


# Characters

#: Characters that are replaced by default: NUL to TAB, VT, FF, SO to US, DEL. Fixed values.
CONTROLS = "".join(map(chr, [*range(0, 10), 11, 12, *range(14, 32), 127]))


def scrub_chars(text: Column, chars: str = CONTROLS, by: str = "?") -> Column:
    """Each of ``chars`` replaced by ``by``."""
    return F.translate(text, chars, by * len(chars))


#: Letters and the numeric entities that stand for them by default. Fixed values.
ENTITIES = {
    "\xb4": "&#180;", "\xc1": "&#193;", "\xc4": "&#196;", "\xc5": "&#197;", "\xc9": "&#201;", "\xcd": "&#205;", "\xd3": "&#211;", "\xd5": "&#336;",
    "\xd6": "&#214;", "\xda": "&#218;", "\xdb": "&#368;", "\xdc": "&#220;", "\xdf": "&#223;", "\xe1": "&#225;", "\xe5": "&#229;", "\xe9": "&#233;",
    "\xed": "&#237;", "\xf1": "&#241;", "\xf3": "&#243;", "\xf5": "&#337;", "\xf6": "&#246;", "\xfa": "&#250;", "\xfb": "&#369;", "\xfc": "&#252;",
}


def map_chars(text: Column, mapping: Mapping[str, str] = ENTITIES) -> Column:
    """Each character replaced as ``mapping`` says; others stay, and so does what has been put in."""
    single = {k: v for k, v in mapping.items() if len(v) == 1}
    if any(k in v for k in mapping for v in mapping.values() if v not in single.values()):
        table = F.create_map(*(F.lit(x) for item in mapping.items() for x in item))
        return F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.element_at(table, c), c)), "")
    out = text
    for char, by in mapping.items():
        if char not in single:
            out = F.replace(out, F.lit(char), F.lit(by))
    return F.translate(out, "".join(single), "".join(single.values())) if single else out


# Charsets


def decode_text(data: Column, charset: str = "UTF-8", policy: str = "strict") -> Column:
    """Bytes as text. strict raises on bad bytes, quarantine gives null, replace
    U+FFFD and ignore nothing in their place."""
    if policy == "strict":
        return F.decode(data, charset)
    if charset.upper() in ("UTF-8", "UTF8") and policy != "ignore":
        return F.try_validate_utf8(data.cast("string")) if policy == "quarantine" else F.make_valid_utf8(data.cast("string"))
    errors = {"quarantine": "strict", "replace": "replace", "ignore": "ignore"}[policy]

    @F.pandas_udf("string")
    def decoded(values: pd.Series) -> pd.Series:
        def one(value: bytes | None) -> str | None:
            try:
                return None if value is None else bytes(value).decode(charset, errors)
            except UnicodeDecodeError:
                return None

        return values.map(one)

    return decoded(data)


#: What each single-byte charset can hold. Fixed values.
ENCODABLE = {"US-ASCII": r"[^\x00-\x7F]", "ISO-8859-1": r"[^\x00-\xFF]"}


def encode_text(text: Column, charset: str = "UTF-8", policy: str = "strict") -> Column:
    """Text as bytes; what the charset lacks is an error, '?' or nothing."""
    if policy != "strict" and charset.upper() in ENCODABLE:
        text = F.regexp_replace(text, ENCODABLE[charset.upper()], "?" if policy == "replace" else "")
    return F.encode(text, charset)
