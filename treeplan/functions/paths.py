"""Paths, times, modes and readable numbers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Directories that a destination must not be in.
SYSTEM_DIRS = ("etc", "bin", "sbin", "usr", "boot", "dev", "proc", "sys", "root")


def parent(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def depth(path: Column) -> Column:
    return F.when(path == "", 0).otherwise(F.size(F.split(path, "/")))


def ancestors(path: Column) -> Column:
    """All directories above a path, nearest last, without the root."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def directories(paths: Column) -> Column:
    return F.when(F.size(F.split(paths, "/")) > 1, ancestors(paths)).otherwise(F.array().cast("array<string>"))


def unsafe(path: Column) -> Column:
    """Absolute, or with a component `..`."""
    return path.startswith("/") | F.array_contains(F.split(path, "/"), "..")


def system_place(path: Column) -> Column:
    """Whether an absolute path begins like a system directory (by characters, so /binary counts)."""
    return path.rlike("^/(" + "|".join(SYSTEM_DIRS) + ")")


def seconds(ns: Column) -> Column:
    return ((ns - F.pmod(ns, F.lit(1_000_000_000))) / F.lit(1_000_000_000)).cast("long")


def nanos(ns: Column) -> Column:
    return F.pmod(ns, F.lit(1_000_000_000)).cast("long")


def joined_ns(s: Column, n: Column) -> Column:
    return s * F.lit(1_000_000_000) + n


def final_mode(mode: Column, superuser: bool = True) -> Column:
    """Permission bits; set-user and set-group bits only for the superuser."""
    return mode.bitwiseAND(F.lit(0o7777 if superuser else 0o1777)).cast("int")


def human_size(n: Column) -> Column:
    """A whole number of bytes with two digits after the point, null if it is null. As printf has it, the exact value is rounded, and a half
    to the even digit; format_string rounds halves up."""
    n = n.cast("long")

    def big(k: int, unit: str) -> Column:
        whole, rest = F.shiftright(n, k), n.bitwiseAND(F.lit((1 << k) - 1).cast("long")) * 100
        digits, left, half = F.shiftright(rest, k), rest.bitwiseAND(F.lit((1 << k) - 1).cast("long")), 1 << (k - 1)
        digits = digits + F.when((left > half) | ((left == half) & (digits % 2 == 1)), 1).otherwise(0)
        return F.format_string(f"%d.%02d {unit}", whole + F.when(digits == 100, 1).otherwise(0), digits % 100)

    return F.when(n >= 1 << 30, big(30, "GiB")).when(n >= 1 << 20, big(20, "MiB")).when(n >= 1 << 10, big(10, "KiB")).when(n.isNotNull(), F.format_string("%d B", n))


def human_speed(n: Column, elapsed: Column) -> Column:
    """Bytes per second as a readable number; of no time, 0 B/s."""
    return F.concat(human_size(F.floor(rate(n, elapsed))), F.lit("/s"))


def normalized(path: Column) -> Column:
    """A relative path without `.` and `..`; null if it is absolute or leaves the root."""
    up = lambda s, part: F.when(part == "..", F.when(F.size(s) == 0, None).otherwise(F.slice(s, F.lit(1), F.size(s) - 1)))
    step = lambda s, part: F.when(s.isNull() | part.isin("", "."), s).otherwise(F.when(part == "..", up(s, part)).otherwise(F.concat(s, F.array(part))))
    return F.when(~path.startswith("/"), F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step, lambda s: F.array_join(s, "/")))


def rate(amount: Column, elapsed: Column) -> Column:
    """Per second; 0 if no time passed."""
    return F.when(elapsed > 0, amount / elapsed).otherwise(F.lit(0.0))


def size_literal(text: Column) -> Column:
    """An integer with an optional suffix K, M or G as a number of bytes; null if it is none."""
    n = F.regexp_extract(text, r"^\s*(\d+)\s*[KMGkmg]?\s*$", 1).try_cast("long")
    unit = F.upper(F.regexp_extract(text, r"([KMGkmg])\s*$", 1))
    return n * F.when(unit == "K", F.lit(1 << 10)).when(unit == "M", F.lit(1 << 20)).when(unit == "G", F.lit(1 << 30)).otherwise(F.lit(1))


def remote_literal(text: Column, port: int = 2377) -> Column:
    """struct(host, port, path) of HOST:PATH or HOST:PORT:PATH."""
    full = text.rlike(r"^[^:]+:\d+:")
    host = F.substring_index(text, ":", 1)
    rest = F.substr(text, F.length(host) + 2, F.length(text))
    number = F.substring_index(rest, ":", 1)
    return F.struct(host.alias("host"), F.when(full, number.try_cast("long")).otherwise(F.lit(port)).alias("port"), F.when(full, F.substr(rest, F.length(number) + 2, F.length(rest))).otherwise(rest).alias("path"))
