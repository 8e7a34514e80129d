"""Ignore files: which paths of a tree their rules leave out.

Rules stay a table, joined with paths by folder: a rule of a folder meets the
paths below it only. Of the rules that match an entry the one in the nearest
folder decides, in one file the last; a path is out if it or a folder above it
is. Folders are judged once, however many files they hold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.size import bounded

#: Ignore files from the weakest to the strongest of one folder.
GIT_FILES, PLAIN_FILES = (".git/info/exclude", ".gitignore"), (".ignore",)
RULES = "folder string, strength int, place int, negated boolean, only_folders boolean, kind string, pattern string"
_PLAIN = re.compile(r"[^*?\[\\]*")


def _regex(glob: str) -> str:
    """A pattern over a whole relative path for a rule without its slashes at
    the ends: stars stay within a name, double stars between slashes don't."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
        elif glob[i:] == "**" and i and glob[i - 1] == "/":
            out.append(".+")
            i += 2
        elif c == "*":
            out.append("[^/]*")
            i += len(glob[i:]) - len(glob[i:].lstrip("*"))
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end]
            turned = body[0] in "!^"
            inner = (body[1:] if turned else body).replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&").replace("^", "\\^")
            out.append(f"(?!/)[{'^' if turned else ''}{inner}]")
            i = end + 1
        else:
            if c == "\\" and i + 1 < len(glob):
                i += 1
                c = glob[i]
            out.append(re.escape(c) if c.isascii() else c)
            i += 1
    return "".join(out)


def parse_rules(text: str) -> list[tuple[int, bool, bool, str, str]]:
    """(line, negated, only folders, kind, pattern) of an ignore file's rules.
    Plain names, endings and paths have kinds of their own, which need no
    pattern match: ``name``, ``ending``, ``path``; all others are ``regex``."""
    out = []
    for number, line in enumerate(text.removeprefix("﻿").split("\n"), 1):
        line = line.removesuffix("\r")
        if line.startswith("#"):
            continue
        bare = line.rstrip(" ")
        if bare.endswith("\\") and len(bare) < len(line):
            bare += " "
        negated = bare.startswith("!")
        bare = bare.removeprefix("!")
        only_folders = bare.endswith("/")
        bare = bare.removesuffix("/")
        anchored = "/" in bare
        bare = bare.removeprefix("/")
        if not bare:
            continue
        if bare.startswith("**/") and "/" not in bare[3:]:
            bare, anchored = bare[3:], False
        if _PLAIN.fullmatch(bare):
            kind, pattern = ("path" if anchored else "name"), bare
        elif not anchored and bare.startswith("*") and _PLAIN.fullmatch(bare[1:]):
            kind, pattern = "ending", bare[1:]
        else:
            kind, pattern = "regex", "^" + ("" if anchored else "(?:.*/)?") + _regex(bare) + "$"
        out.append((number, negated, only_folders, kind, pattern))
    return out


def rules_of(files: DataFrame, git: bool = True) -> DataFrame:
    """The rules of the ignore files among ``files`` (path, content); without
    ``git`` only of those that are not git's."""
    taken = (GIT_FILES if git else ()) + PLAIN_FILES
    strength = F.lit(None).cast("int")
    for i, name in enumerate(GIT_FILES + PLAIN_FILES):
        if name in taken:
            is_it = F.col("path") == name if "/" in name else F.element_at(F.split("path", "/"), -1) == name
            strength = F.when(is_it, i).otherwise(strength)
    folder = F.when(F.col("path") == GIT_FILES[0], "").otherwise(F.regexp_extract("path", "^(.*)/[^/]*$", 1))

    def task(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(f, s, *rule) for f, s, text in zip(part["folder"], part["strength"], part["content"]) for rule in parse_rules(text or "")]
            yield pd.DataFrame(rows, columns=["folder", "strength", "place", "negated", "only_folders", "kind", "pattern"])

    found = files.select(folder.alias("folder"), strength.alias("strength"), "content").where("strength IS NOT NULL")
    return found.mapInPandas(task, RULES)


def _above(path: Column) -> Column:
    """All folders above a path, the root (an empty name) first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def ignored_entries(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """The entries (path, is_folder) that a rule leaves out by itself."""
    spread = entries.select("path", "is_folder", F.posexplode(_above(F.col("path"))).alias("depth", "folder"))
    met = spread.join(bounded(rules), "folder").where("is_folder OR NOT only_folders")
    below = F.when(F.col("folder") == "", F.col("path")).otherwise(F.expr("substring(path, length(folder) + 2)"))
    name = F.element_at(F.split("path", "/"), -1)
    fits = (
        F.when(F.col("kind") == "name", name == F.col("pattern")).when(F.col("kind") == "ending", F.endswith(name, F.col("pattern")))
        .when(F.col("kind") == "path", below == F.col("pattern")).otherwise(F.regexp_like(below, F.col("pattern")))
    )
    decided = met.where(fits).groupBy("path").agg(F.max(F.struct("depth", "strength", "place", "negated")).alias("rule"))
    return decided.where("NOT rule.negated").select("path")


def not_ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """``files`` without those that rules leave out, by themselves or by a
    folder above them; what lies in such a folder can't be let in again."""
    folders = files.select(F.explode(F.filter(_above(F.col("path")), lambda f: f != "")).alias("path")).distinct()
    entries = files.select("path", F.lit(False).alias("is_folder")).distinct().unionByName(folders.withColumn("is_folder", F.lit(True)))
    out = bounded(ignored_entries(entries, rules).withColumnRenamed("path", "_out"))
    places = files.select("path").distinct().select("path", F.explode(F.concat(_above(F.col("path")), F.array("path"))).alias("_out"))
    gone = places.join(out, "_out", "left_semi").select("path").distinct()
    return files.join(gone, "path", "left_anti").select(*files.columns)
