"""File names: their family, and where their output goes."""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import PurePosixPath

from pyspark.sql import Column
from pyspark.sql import functions as F

FAMILIES = {".pdf": "pdf", ".docx": "docx", ".doc": "docx", ".xlsx": "excel", ".xls": "excel", ".csv": "csv", ".md": "text", ".txt": "text"}

#: An output's ending by format; any other's is .json.
ENDINGS = {"markdown": ".md"}


def name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def extension(path: Column) -> Column:
    """The last suffix in lower case with its dot; empty for none. A leading dot makes no suffix."""
    return F.lower(F.regexp_extract(name(path), r".(\.[^.]+)\z", 1))


def stem(path: Column) -> Column:
    n = name(path)
    return F.when(F.length(extension(path)) > 0, F.regexp_replace(n, r"\.[^.]+\z", "")).otherwise(n)


def family(path: Column) -> Column:
    """Which reader takes a file; null for none."""
    ext = extension(path)
    out = F.lit(None).cast("string")
    for suffix, kind in FAMILIES.items():
        out = F.when(ext == suffix, kind).otherwise(out)
    return out


def output_name(path: Column, fmt: str) -> Column:
    return F.concat(stem(path), F.lit(ENDINGS.get(fmt, ".json")))


def distinct_outputs(paths: Iterable[str], fmt: str = "markdown") -> list[str]:
    """An output for each path in turn, none taken twice. The bare name is tried first for an absolute path and last for a
    relative one; between, as many parent folders as tell it apart; then a number. Each choice
    depends on all before it, hence a loop over the list of paths, on the driver."""
    ending, taken, out = ENDINGS.get(fmt, ".json"), set(), []
    for p in map(PurePosixPath, paths):
        target = p.stem + ending
        parents = [x for x in p.parts[:-1] if x not in ("/", ".", "..")]
        nested = ["/".join([*parents[len(parents) - k :], target]) for k in range(1, len(parents) + 1)]
        tries = [target, *nested] if p.is_absolute() else [*reversed(nested), target]
        found = next((t for t in tries if t not in taken), None)
        count = 1
        while found is None:
            numbered = f"{p.stem}-{count}{ending}"
            found, count = (None if numbered in taken else numbered), count + 1
        taken.add(found)
        out.append(found)
    return out
