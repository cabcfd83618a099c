"""Column functions over paths, texts and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as JavaScript's \\s has it; Java's \\s is ASCII only. Fixed values.
WS = r"[\s\u00a0\ufeff\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: A word boundary before an ASCII word; Java's \\b takes other letters for word characters too.
EDGE = "(?<![A-Za-z0-9_])"
END = "(?![A-Za-z0-9_])"
#: Languages by extension, and binary extensions. Fixed values.
LANGS = {".ts": "ts", ".js": "js", ".mjs": "js", ".cjs": "js", ".json": "json", ".md": "md", ".yml": "yml", ".yaml": "yaml"}
BINARY = (".png", ".jpg", ".jpeg", ".gif", ".ico", ".woff", ".woff2", ".ttf", ".pdf")
IGNORED = ("node_modules", ".git", "dist", "coverage", "out", "rc-analysis", "storage", ".tmp")
SCRIPTS = ("ts", "js", "mjs", "cjs")


def extension(path: str | Column) -> Column:
    """The last dot of the path and what follows; the whole path without a dot."""
    return F.regexp_replace(path, r"^.*\.", ".")


def language(path: str | Column) -> Column:
    out = F.lit("unknown")
    for ext, lang in LANGS.items():
        out = F.when(extension(path) == ext, lang).otherwise(out)
    return out


def is_binary(path: str | Column) -> Column:
    return F.lower(extension(path)).isin(*BINARY)


def is_ignored(path: str | Column) -> Column:
    """An ignored name, or one that ends with .tmp, at any depth."""
    return F.exists(F.split(path, "/"), lambda s: s.isin(*IGNORED) | s.endswith(".tmp"))


def is_hidden(path: str | Column) -> Column:
    return F.exists(F.split(path, "/"), lambda s: s.startswith("."))


def without_extension(path: str | Column) -> Column:
    return F.regexp_replace(path, r"\.(ts|js|mjs|cjs)$", "")


def is_test_path(path: str) -> Column:
    return F.col(path).rlike(r"/tests?/|/spec/|(\.test|\.spec)\.(ts|js|tsx|jsx)$")


def normal_path(path: Column) -> Column:
    """Dots and double slashes resolved; leading double dots stay."""
    start = F.array().cast("array<string>")
    above = lambda a: (F.size(a) > 0) & (F.element_at(a, -1) != "..")
    parts = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    step = lambda a, s: F.when((s == "..") & above(a), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s)))
    return F.array_join(F.aggregate(parts, start, step), "/")


def dirname(path: str | Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def rounded(x: Column, digits: int = 2) -> Column:
    """Half up after scaling in floating point, as JavaScript's Math.round does."""
    return F.floor(x * 10**digits + F.lit(0.5)) / float(10**digits)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))
