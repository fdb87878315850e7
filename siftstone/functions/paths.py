"""Path scalars: glob rules, ignore rules, weights, relative paths."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import trim_space


def glob_regex(glob: str) -> str:
    """Regular expression of one ignore-style glob.

    ``**/`` spans any directories, ``/**`` anything below, ``*`` and ``?``
    stay inside one component. A leading ``/`` anchors the glob, and so does
    a directory in front of a ``*.ext`` tail; any other glob matches at every
    depth. A match covers everything below the matched path.
    """
    anchored = glob.startswith("/") and not glob.startswith("/**/")
    if re.search(r"[^/+]/.*\*\.", glob) and not glob.startswith(("/", "**/")):
        anchored = True
    body = glob.lstrip("/")
    out, at = "", 0
    while at < len(body):
        if body.startswith("/**/", at):
            out, at = out + "/(?:.*/)?", at + 4
        elif body.startswith("**/", at):
            out, at = out + "(?:.*/)?", at + 3
        elif body.startswith("/**", at):
            out, at = out + "(?:/.*)?", at + 3
        elif body[at] == "*":
            out, at = out + "[^/]*", at + 1
        elif body[at] == "?":
            out, at = out + "[^/]", at + 1
        else:
            out, at = out + re.escape(body[at]), at + 1
    tail = ".*$" if body.endswith("/") else "(?:/.*)?$"
    return ("^" if anchored else "^(?:.*/)?") + out + tail


def ignore_rules(lines: Iterable[str]) -> list[tuple[str, bool]]:
    """``(regex, ignored)`` of ignore-file lines, in file order."""
    rules = []
    for line in lines:
        rule = line.rstrip("\r").strip(" ")
        if not rule or rule.startswith("#"):
            continue
        ignored = not rule.startswith("!")
        rule = rule.removeprefix("!")
        if rule.startswith(("\\#", "\\!")):
            rule = rule[1:]
        rules.append((glob_regex(rule), ignored))
    return rules


def _last_rule_wins(path: Column, rules: list[tuple[str, bool]]) -> Column:
    out = None
    for regex, ignored in reversed(rules):
        out = (F if out is None else out).when(path.rlike(regex), F.lit(ignored))
    return out.otherwise(F.lit(False))


def is_ignored(path: Column, lines: Iterable[str]) -> Column:
    """True when the path or a directory above it is ignored.

    Without ``!`` rules every regex already covers what lies below a match,
    so one alternation over the path decides; otherwise each ancestor is
    judged by its last matching rule, and an ignored directory stays closed.
    """
    rules = ignore_rules(lines)
    if not rules:
        return F.lit(False)
    if all(ignored for _, ignored in rules):
        return path.rlike("|".join(f"(?:{regex})" for regex, _ in rules))
    parts = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.exists(prefixes, lambda prefix: _last_rule_wins(prefix, rules))


def is_builtin_skipped(path: Column) -> Column:
    """README files anywhere, and the tool's and git's own top directories."""
    clean = F.regexp_replace(trim_space(path), r"^/+|/+\z", "")
    tops = "|".join(re.escape(name) for name in fixed.SKIPPED_TOP_DIRS)
    return clean.rlike(rf"^(?:{tops})(?:/|\z)") | F.lower(clean).rlike(r"(?:^|/) *readme(?: *|\.[^/]*)(?:/|\z)")


def check_weights(weights: Mapping[str, float]) -> dict[str, float]:
    """The rules in pattern order, or an error for a rule that is not usable."""
    for pattern, weight in weights.items():
        if not pattern.strip():
            raise ValueError("empty glob pattern")
        if not math.isfinite(weight) or not 0 < weight <= 1:
            raise ValueError(f"weight for {pattern!r} must be in (0, 1]")
    return dict(sorted(weights.items()))


def path_weight(path: Column, weights: Mapping[str, float] | None = None) -> Column:
    """Smallest weight of the matching rules, 1 for none.

    Rules are configuration; they group by weight into one alternation each,
    so a path is tested once per distinct weight, lightest first.
    """
    rules = check_weights(fixed.DEFAULT_PATH_WEIGHTS if weights is None else weights)
    clean = F.regexp_replace(trim_space(path), r"^\./", "")
    by_weight: dict[float, list[str]] = {}
    for pattern, weight in rules.items():
        if pattern.startswith("#"):
            continue
        by_weight.setdefault(float(weight), []).append(glob_regex(pattern))
    out = F.when(clean == "", F.lit(1.0))
    for weight in sorted(by_weight):
        out = out.when(clean.rlike("|".join(f"(?:{regex})" for regex in by_weight[weight])), F.lit(weight))
    return out.otherwise(F.lit(1.0))



def base_name(path: Column) -> Column:
    """Last path component; '.' for an empty path and '/' for the root."""
    bare = F.rtrim(path, F.lit("/"))
    return (
        F.when(path == "", F.lit("."))
        .when(bare == "", F.lit("/"))
        .otherwise(F.substring_index(bare, "/", -1))
    )


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)\z", 1))


def clean_path(path: Column) -> Column:
    """Path without empty and ``.`` components, ``x/..`` resolved."""
    absolute = path.startswith("/")
    parts = F.filter(F.split(path, "/"), lambda part: (part != "") & (part != "."))
    start = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        can_drop = (F.size(done) > 0) & (last != "..")
        return (
            F.when(part != "..", F.concat(done, F.array(part)))
            .when(can_drop, F.slice(done, F.lit(1), F.size(done) - 1))
            .when(absolute, done)
            .otherwise(F.concat(done, F.array(part)))
        )

    joined = F.array_join(F.aggregate(parts, start, step), "/")
    return F.when(absolute, F.concat(F.lit("/"), joined)).when(joined == "", F.lit(".")).otherwise(joined)


def relative_path(path: Column, root: str) -> Column:
    """Path below ``root``; paths outside it stay as they are."""
    base = "/" + root.strip("/")
    below = base.rstrip("/") + "/"
    clean = clean_path(path)
    return (
        F.when(~path.startswith("/"), clean)
        .when(clean == base, F.lit("."))
        .when(clean.startswith(below), F.substring(clean, len(below) + 1, 2147483647))
        .otherwise(path)
    )
