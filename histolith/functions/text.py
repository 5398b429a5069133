"""Column expressions on paths, words and commit ids. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WORD = "[a-z][a-z0-9]{2,}"


def clean_path(path: Column) -> Column:
    """Trim blanks, backslashes to slashes, runs of slashes to one, no leading ``./``; case counts."""
    slashed = F.regexp_replace(F.translate(F.trim(path), "\\", "/"), "/+", "/")
    return F.regexp_replace(slashed, r"^\./", "")


def clean_paths(paths: Column) -> Column:
    """Cleaned paths of an array, without nulls; repeats stay. A null array gives an empty one."""
    return F.coalesce(F.transform(F.filter(paths, lambda p: p.isNotNull()), clean_path), F.array().cast("array<string>"))


def clean_tokens(tokens: Column) -> Column:
    """Trimmed lower-case tokens of an array, without nulls and empty ones; repeats stay."""
    low = F.transform(F.filter(tokens, lambda t: t.isNotNull()), lambda t: F.lower(F.trim(t)))
    return F.coalesce(F.filter(low, lambda t: t != ""), F.array().cast("array<string>"))


def present(values: Column) -> Column:
    """An array without its nulls, values as they stand; a null array gives an empty one."""
    return F.coalesce(F.filter(values, lambda v: v.isNotNull()), F.array().cast("array<string>"))


def subject_words(subject: Column) -> Column:
    """All words of a subject in order, repeats included; a null subject has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(subject, F.lit(""))), F.lit(f"({WORD})"), F.lit(1))


def top_dir(path: Column) -> Column:
    """First path component, ``''`` for a file at the root."""
    return F.when(F.instr(path, "/") > 0, F.split_part(path, F.lit("/"), F.lit(1))).otherwise(F.lit(""))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirs_deep(path: Column, start: int) -> Column:
    """Directory prefixes of a path from depth ``start`` down; empty where the path is shallower."""
    parts = F.split(path, "/")
    depth = F.size(parts) - 1
    prefixes = F.transform(F.sequence(F.lit(start), F.greatest(depth, F.lit(start))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return F.when(depth >= start, prefixes).otherwise(F.array().cast("array<string>"))


def sha_match(a: Column, b: Column) -> Column:
    """Either id is a prefix of the other; both have seven digits or more; letter case is ignored."""
    a, b = F.lower(a), F.lower(b)
    return (F.least(F.length(a), F.length(b)) >= 7) & (F.startswith(a, b) | F.startswith(b, a))
