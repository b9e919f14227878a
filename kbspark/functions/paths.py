"""Rules for paths as expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of files that hold secrets.
SECRET = r"(?:^|/)(?:\.env(?:\.[^/]*)?|[^/]*\.(?:pem|key)|id_rsa|id_ed25519|credentials[^/]*|secrets[^/]*)$"


def is_secret(path: Column) -> Column:
    """Whether a file's name, in lower case, looks like one that holds secrets."""
    return F.regexp_like(F.lower(path), F.lit(SECRET))


def is_safe(path: Column) -> Column:
    """Whether a path is relative, has no empty, ``.`` or ``..`` part, no backslash and no drive."""
    return F.coalesce((path != "") & ~F.regexp_like(path, F.lit(r"^/|//|/$|\\|^[A-Za-z]:|(?:^|/)\.{1,2}(?:/|$)")), F.lit(False))


def glob_regex(pattern: str) -> str:
    """A regular expression for a glob whose ``*``, ``?`` and ``[...]`` stay inside a part; a part ``**`` is any parts."""
    out, parts = [], pattern.split("/")
    for n, part in enumerate(parts):
        last = n + 1 == len(parts)
        if part == "**":
            # with the slash on the side that a neighbour has
            out.append(r"(?:[^/]+(?:/[^/]+)*)?" if len(parts) == 1 else r"(?:/[^/]+)*" if last else r"(?:[^/]+/)*")
            continue
        one = re.sub(r"\[(!?)([^\]]*)\]|(.)", lambda m: {"*": "[^/]*", "?": "[^/]"}.get(m[3], re.escape(m[3])) if m[3] else f"[{'^' if m[1] else ''}{m[2]}]", part, flags=re.S)
        out.append(one + ("" if last or (parts[n + 1] == "**" and n + 2 == len(parts)) else "/"))
    return "".join(out)


def glob_matches(path: Column, pattern: str) -> Column:
    return F.regexp_like(path, F.lit(f"^(?:{glob_regex(pattern)})$"))


def ignore_regex(pattern: str) -> str | None:
    """A regular expression for a line of an ignore file, without its ``!``; null for blanks and comments.

    Without a slash in it a pattern holds in every folder; with one at its end for folders only; what lies below a
    folder goes with it.
    """
    core = pattern.strip().removeprefix("!")
    if not core or core.startswith("#"):
        return None
    inside = core.endswith(("/", "/**"))
    core = core.removesuffix("/**").rstrip("/") if inside else core
    fixed = "/" in core or pattern.strip().endswith("/**")
    return f"^{'' if fixed else '(?:.*/)?'}(?:{glob_regex(core.lstrip('/'))}){'/.+' if inside else '(?:/.*)?'}$"


def is_ignored(path: Column, patterns: list[str]) -> Column:
    """Whether the last line of an ignore file that a path matches excludes it; ``!`` takes it back in. Null is not ignored."""
    out = F.lit(False)
    for line in patterns:
        regex = ignore_regex(line)
        if regex:
            out = F.when(F.regexp_like(path, F.lit(regex)), F.lit(not line.strip().startswith("!"))).otherwise(out)
    return F.coalesce(out, F.lit(False))
