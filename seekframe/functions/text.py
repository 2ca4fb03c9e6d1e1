"""Analyzers as Column expressions, all inside whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokenize_plain(text: Column) -> Column:
    """Runs of letters and decimal digits, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{Nd}]+)"), F.lit(1))


_SPLITS = (("([A-Z])([A-Z][a-z])", "$1_$2"), ("([a-z])([A-Z])", "$1_$2"), ("([A-Za-z])([0-9])", "$1_$2"), ("([0-9])([A-Za-z])", "$1_$2"))


def tokenize_code(text: Column) -> Column:
    """Identifiers, lower-cased: each whole, then its parts if there are two or more.

    An identifier with underscores is split at them alone; another one at changes of case and between letters and digits.
    """
    runs = F.regexp_extract_all(text, F.lit("([a-zA-Z_][a-zA-Z0-9_]*)"), F.lit(1))

    def parts(run: Column) -> Column:
        cut = run
        for pattern, put in _SPLITS:
            cut = F.regexp_replace(cut, pattern, put)
        pieces = F.filter(F.split(F.when(F.contains(run, F.lit("_")), run).otherwise(cut), "_"), lambda p: p != "")
        return F.when(F.size(pieces) >= 2, F.concat(F.array(run), pieces)).otherwise(F.array(run))

    return F.transform(F.flatten(F.transform(runs, parts)), lambda t: F.lower(t))


_PUNCT = r"\p{P}$+<=>^`|~"


def bert_pretokenize(text: Column) -> Column:
    """Words, and each punctuation sign by itself."""
    return F.regexp_extract_all(text, F.lit(rf"([{_PUNCT}]|[^\s{_PUNCT}]+)"), F.lit(1))


def wrap_truncate(ids: Column, cls: int, sep: int, longest: int) -> Column:
    """[cls] + the first longest - 2 ids + [sep]."""
    return F.concat(F.array(F.lit(cls)), F.slice(ids, 1, max(0, longest - 2)), F.array(F.lit(sep)))


def pair_lengths(n: Column, m: Column, longest: int, special: int = 3) -> tuple[Column, Column]:
    """What pair_truncate leaves of a query of n ids and a document of m."""
    room = longest - special
    most_q, most_d = room - room // 2, room // 2
    over = n + m > room
    keep_q = F.when(~over, n).when(n <= most_q, n).when(m <= most_d, room - m).otherwise(F.lit(most_q))
    return keep_q, F.when(~over, m).otherwise(F.lit(room) - keep_q)


def pair_truncate(query: Column, doc: Column, longest: int, special: int = 3) -> Column:
    """(query, doc) cut to longest - special ids together, always from the longer side; equal sides lose from doc first."""
    keep_q, keep_d = pair_lengths(F.size(query), F.size(doc), longest, special)
    return F.struct(F.slice(query, F.lit(1), keep_q.cast("int")).alias("query"), F.slice(doc, F.lit(1), keep_d.cast("int")).alias("doc"))


_LANGUAGES = {
    "python": "py pyi", "go": "go", "typescript": "ts tsx mts cts js jsx mjs cjs", "java": "java", "rust": "rs", "c": "c h", "cpp": "cc cpp hpp cxx",
    "ruby": "rb", "php": "php", "csharp": "cs", "swift": "swift", "kotlin": "kt kts", "scala": "scala sc", "objc": "m mm", "shell": "sh bash zsh", "elixir": "ex exs",
    "haskell": "hs", "lua": "lua", "zig": "zig", "markdown": "md", "rst": "rst", "text": "txt", "json": "json", "yaml": "yaml yml", "toml": "toml", "xml": "xml",
    "html": "html", "css": "css", "scss": "scss", "sql": "sql", "proto": "proto", "graphql": "graphql", "r": "r",
}
EXTENSIONS = {e: lang for lang, many in _LANGUAGES.items() for e in many.split()}
_NAMES = {"dockerfile": "dockerfile", "makefile": "make", "gnumakefile": "make", "go.mod": "gomod", "go.sum": "gomod"}


def language(path: Column) -> Column:
    """Language by file name or extension, '' if unknown."""
    base = F.lower(F.regexp_extract(path, r"([^/]*)/*$", 1))
    ext = F.regexp_extract(base, r"\.([^.]*)$", 1)
    names = F.create_map(*[F.lit(x) for kv in _NAMES.items() for x in kv])
    exts = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return F.coalesce(F.element_at(names, base), F.element_at(exts, ext), F.lit(""))


def is_markdown(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(md|mdx|markdown)$")
