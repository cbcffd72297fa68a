"""Expressions for output lines, addresses and status texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def strip_control(text: Column) -> Column:
    """Without the bytes 0-31; the printable rest of a colour code stays."""
    return F.regexp_replace(text, r"[\x00-\x1f]", "")


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def exit_code(line: Column) -> Column:
    """Number of a line starting ``exitcode=N``, else NULL."""
    found = F.regexp_extract(line, r"^exitcode=(\d+)", 1)
    return F.when(found != "", found).try_cast("int")


def command_text(command: Column, code: Column) -> Column:
    """``command (code)`` once the exit code is known."""
    return F.concat(command, F.coalesce(
        F.concat(F.lit(" ("), code.cast("string"), F.lit(")")), F.lit("")))


def command_name(command: Column) -> Column:
    return F.get(F.split(command, " "), F.lit(0))


def command_arguments(command: Column) -> Column:
    tokens = F.split(command, " ")
    return F.slice(tokens, F.lit(2), F.size(tokens))


def host_of(address: Column) -> Column:
    """``user@host`` -> ``host``; an address without a user is kept."""
    return F.when(F.instr(address, "@") > 0, F.get(F.split(address, "@"), F.lit(1))) \
        .otherwise(address)


def address(user: Column, host: Column) -> Column:
    return F.concat_ws("@", F.when(user != "", user), host)


def local_as_zero(value: Column) -> Column:
    return F.replace(value, F.lit("local"), F.lit("0"))


def state(text: Column, name: str) -> Column:
    """Entry ``name`` of ``A:v,B:v``; ``x`` means not found."""
    value = F.try_element_at(F.str_to_map(text, F.lit(","), F.lit(":")), F.lit(name))
    return F.when(value != "x", value)


def version(text: Column, pattern: str = r"([0-9.]+)") -> Column:
    found = F.regexp_extract(text, pattern, 1)
    return F.when(found != "", found)


def glob_regex(pattern: str) -> str:
    """Shell glob for one file name as an anchored regular expression."""
    parts = {"*": ".*", "?": "."}
    body = "".join(parts.get(c) or ("\\" + c if c in r".\+()[]{}^$|" else c) for c in pattern)
    return f"^{body}$"


def matches_glob(name: Column, patterns: list[str]) -> Column:
    """Whether the last part of a path matches any of the globs."""
    tail = F.element_at(F.split(name, "/"), -1)
    return tail.rlike("|".join(glob_regex(p) for p in patterns))
