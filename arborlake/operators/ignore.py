"""Ignore rules: which paths of a tree are left out.

Rules are lines of ignore files, each with the directory of its file.  ``!``
takes back, a trailing ``/`` means directories only, a ``/`` elsewhere anchors
to the rule's directory, ``**`` stands for any number of components.  The last
rule that matches decides; whatever lies below an ignored directory is ignored
too; the ignore file itself never is.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    shape: str
    negated: bool
    directories: bool


def _glob(part: str) -> str:
    out, i = "", 0
    while i < len(part):
        ch = part[i]
        if ch == "*":
            out += "[^/]*"
        elif ch == "?":
            out += "[^/]"
        elif ch == "[" and (end := part.find("]", i + 2)) > 0:
            body = part[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]"
            i = end
        elif ch == "\\" and i + 1 < len(part):
            i += 1
            out += re.escape(part[i])
        else:
            out += re.escape(ch)
        i += 1
    return out


def parse(lines: Sequence[tuple[str, str]]) -> list[Rule]:
    """Rules of (directory, line) pairs in order; directory is a path below the root, "" for the root."""
    out = []
    for directory, line in lines:
        line = line.removesuffix("\r")
        if line.startswith("#") or not line.strip():
            continue
        negated = line.startswith("!")
        line = line[negated:]
        if not line.endswith("\\ "):
            line = line.rstrip(" ")
        only = line.endswith("/")
        line = line.rstrip("/") if only else line
        base = re.escape(directory.strip("/")) + "/" if directory.strip("/") else ""
        if "/" not in line:
            shape = f"^{base}(?:[^/]+/)*{_glob(line)}$"
        else:
            parts, shape = line.removeprefix("/").split("/"), f"^{base}"
            for i, p in enumerate(parts):
                last = i == len(parts) - 1
                if p == "**":
                    shape += ".+" if last else "(?:[^/]+/)*"
                else:
                    shape += _glob(p) + ("" if last else "/")
            shape += "$"
        out.append(Rule(shape, negated, only))
    return out


def ignored(path: Column, is_dir: Column, rules: Sequence[Rule], file_name: str = ".ignore") -> Column:
    """Whether a path (components joined by ``/``, none before the first) is left out."""

    def verdict(p: Column, d: Column) -> Column:
        out = F.lit(False)
        for r in rules:
            match = p.rlike(r.shape) & d if r.directories else p.rlike(r.shape)
            out = F.when(match, F.lit(not r.negated)).otherwise(out)
        return out & (d | (F.regexp_extract(p, r"([^/]*)$", 1) != file_name))

    depth = F.size(F.split(path, "/"))
    above = F.filter(F.transform(F.sequence(F.lit(1), depth), lambda i: F.array_join(F.slice(F.split(path, "/"), F.lit(1), i), "/")), lambda p: p != path)
    return verdict(path, is_dir) | F.exists(above, lambda p: verdict(p, F.lit(True)))
