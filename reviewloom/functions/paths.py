"""Predicates and parts of repository-relative file paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directory names that hold dependencies, build output or editor state.
IGNORED_DIRECTORIES = (
    "node_modules", ".git", "dist", "build", "target", "__pycache__", ".venv", "venv",
    ".pytest_cache", "coverage", ".next", ".nuxt", ".cache", ".turbo", ".idea", ".vscode",
    "vendor", "tmp", "temp",
)

# Generated-file suffixes (case-sensitive).
IGNORED_SUFFIXES = (".min.js", ".min.css", ".map", ".lock")

# Extensions of reviewable source files.
SOURCE_EXTENSIONS = (
    ".js", ".mjs", ".cjs", ".jsx", ".ts", ".tsx", ".py", ".rs", ".go",
    ".java", ".kt", ".kts", ".scala", ".c", ".h", ".cpp", ".cc", ".cxx", ".hpp",
    ".vue", ".svelte", ".rb", ".php", ".cs", ".sh", ".bash", ".zsh", ".swift", ".dart",
    ".sql", ".lua", ".r", ".yaml", ".yml", ".toml", ".json", ".md",
)

# Limits of a capped listing.
MAX_DEPTH = 20
MAX_FILES = 5000


def extension(path: Column) -> Column:
    """Lower-cased last suffix of the base name, empty for dot-files without one."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)\z", 1))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_directory(path: Column) -> Column:
    """Directory part without the trailing slash, empty at the repository root."""
    return F.regexp_replace(path, r"/?[^/]*\z", "")


def depth(path: Column) -> Column:
    """Number of directory components above the file."""
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def in_ignored_directory(path: Column, skip_hidden: bool = True) -> Column:
    """True when any directory component is ignored, hidden or empty."""
    names = [re.escape(name) for name in IGNORED_DIRECTORIES]
    hidden = [r"\.[^/]*"] if skip_hidden else []
    return path.rlike("(?:^|/)(?:" + "|".join(names + hidden) + "|)/")


def is_ignored_file(path: Column) -> Column:
    """True for dot-files, empty names and generated-file suffixes."""
    name = base_name(path)
    test = (name == "") | name.startswith(".")
    for suffix in IGNORED_SUFFIXES:
        test = test | name.endswith(suffix)
    return test


def root_prefix(root: Column) -> Column:
    """``root`` with one slash at its end."""
    # Trimming copies a text character by character, so only one with something to trim.
    bare = F.when(root.endswith("/"), F.rtrim(root, F.lit("/"))).otherwise(root)
    return F.concat(bare, F.lit("/"))


def relative_path(root: Column, path: Column) -> Column:
    """Absolute paths below ``root`` become relative; others are left as they are."""
    return below_prefix(root_prefix(root), path)


def below_prefix(prefix: Column, path: Column) -> Column:
    """The path without ``prefix`` (see ``root_prefix``), as it is where it does not begin so."""
    below = F.substring(path, F.length(prefix) + 1, F.length(path))
    return F.when(path.startswith(prefix), below).otherwise(path)


def is_outside_root(root: Column, path: Column) -> Column:
    """Marks absolute paths that do not lie below ``root``."""
    prefix = root_prefix(root)
    return path.startswith("/") & ~path.startswith(prefix)
