"""Options of a plan, and the parsers of their literals."""

from __future__ import annotations

import grp
import pwd
import re
from dataclasses import dataclass, replace


def parse_size(text: str) -> int:
    """An integer with an optional suffix K, M or G (powers of 1024); anything else raises."""
    m = re.fullmatch(r"\s*(\d+)\s*([KMGkmg]?)\s*", text)
    if not m:
        raise ValueError(f"not a size: {text!r}")
    return int(m[1]) << {"": 0, "K": 10, "M": 20, "G": 30}[m[2].upper()]


def parse_remote(text: str, port: int = 2377) -> tuple[str, int, str]:
    """HOST:PATH or HOST:PORT:PATH."""
    parts = text.split(":", 2)
    if len(parts) < 2 or not parts[0]:
        raise ValueError(f"not a remote place: {text!r}")
    if len(parts) == 3 and parts[1].isdigit():
        return parts[0], int(parts[1]), parts[2]
    return parts[0], port, text.split(":", 1)[1]


def parse_chmod(text: str):
    """A function from an old mode to the new one: octal digits, or clauses like u+rw,go-x,a=r."""
    if re.fullmatch(r"[0-7]{1,4}", text):
        value = int(text, 8)
        return lambda mode: value
    clauses = []
    for clause in text.split(","):
        m = re.fullmatch(r"([ugoa]*)([+=-])([rwx]*)", clause)
        if not m:
            raise ValueError(f"not a mode: {text!r}")
        who = set(m[1].replace("a", "ugo") or "ugo")
        bits = sum({"r": 4, "w": 2, "x": 1}[c] for c in set(m[3]))
        mask = sum(bits << s for w, s in (("u", 6), ("g", 3), ("o", 0)) if w in who)
        every = sum(7 << s for w, s in (("u", 6), ("g", 3), ("o", 0)) if w in who)
        clauses.append((m[2], mask, every))

    def change(mode: int) -> int:
        for op, mask, every in clauses:
            mode = mode | mask if op == "+" else mode & ~mask if op == "-" else mode & ~every | mask
        return mode

    return change


def parse_chown(text: str) -> tuple[int | None, int | None]:
    """user:group, numbers or names that this machine knows; either part may be missing."""
    user, _, group = text.partition(":")

    def number(part: str, known) -> int | None:
        if not part or part.isdigit():
            return int(part) if part else None
        try:
            return known(part)
        except KeyError:
            raise ValueError(f"no such name: {part!r}") from None

    return number(user, lambda x: pwd.getpwnam(x).pw_uid), number(group, lambda x: grp.getgrnam(x).gr_gid)


@dataclass(frozen=True)
class SyncOptions:
    """What decides an entry's action. mode: local plans whole copies, network plans deltas."""

    mode: str = "local"
    existing: bool = False
    ignore_existing: bool = False
    update: bool = False
    whole_file: bool = False
    #: None; "rule" ignores size and time, so all existing files are copied; "content" compares digests.
    checksum: str | None = None
    size_only: bool = False
    #: Directory times alone may tell that nothing has changed (manifest.trusted).
    trust_mtime: bool = False
    modify_window: int = 0
    delete: bool = False
    delete_excluded: bool = False
    max_delete: int | None = None
    min_size: int | None = None
    max_size: int | None = None
    one_file_system: int | None = None
    backup_suffix: str = "~"
    backup_dir: str | None = None
    chmod: str | None = None
    chown: str | None = None
    perms: bool = True
    times: bool = True
    owner: bool = True
    group: bool = True
    superuser: bool = True

    def __post_init__(self) -> None:
        if self.mode not in ("local", "network"):
            raise ValueError("mode is local or network")
        if self.checksum not in (None, "rule", "content"):
            raise ValueError("checksum is None, rule or content")
        if self.modify_window < 0:
            raise ValueError("modify_window is negative")

    def but(self, **changes) -> "SyncOptions":
        return replace(self, **changes)
