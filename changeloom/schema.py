"""The tables of a change history.

A changeset is one commit; entries are its path actions, in order. Many
histories share the tables, told apart by ``repo``.
"""

CHANGESETS = (
    "repo string, seq long, revision string, patch_hash string, date_utc timestamp, tz_offset_min int, author string, log string,"
    " tags array<string>, branches array<string>, parents array<string>, lin_parent string, source_kind string"
)
ENTRIES = (
    "repo string, seq long, pos int, action string, name string, old_name string, old_rev string, new_rev string,"
    " is_directory boolean, is_symlink boolean, status string"
)
REVS = "repo string, path string, rev string, date_utc timestamp, author string, state string, has_lines boolean, log string, pos int"

ADD, DEL, UPD, REN = "ADD", "DEL", "UPD", "REN"
ACTIONS = (ADD, DEL, UPD, REN)
ANONYMOUS = "anonymous"
