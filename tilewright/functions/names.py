"""Column expressions on marker, panel and file names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the name rules.
NUCLEAR = ("dapi", "hoechst", "draq5", "dna", "syto")
QC_PREFIXES = ("blank", "empty")
QC_PARTS = ("hoechst",)
STEMS = (".ome.tiff", ".ome.tif", ".tiff", ".tif")


def clean_marker_name(name: Column) -> Column:
    """Lower case; hyphen, blank, colon and parentheses become underscores, alpha an a, slashes go; outer white space goes."""
    return F.regexp_replace(F.translate(F.lower(name), "- :()α/", "_____a"), r"^\s+|\s+$", "")


def normalize_key(name: Column) -> Column:
    return F.replace(clean_marker_name(name), F.lit("_"), F.lit(""))


def is_qc(name: Column) -> Column:
    low = F.lower(F.trim(name))
    out = F.lit(False)
    for p in QC_PREFIXES:
        out = out | low.startswith(p)
    for p in QC_PARTS:
        out = out | low.contains(p)
    return out


def is_nuclear(name: Column) -> Column:
    return clean_marker_name(name).rlike("|".join(NUCLEAR))


def glob_regex(pattern: str) -> str:
    """An anchored, case-insensitive regular expression for a shell glob."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "[" and end > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out.append(f"[^{body[1:]}]" if body[0] == "!" else f"[{body}]")
            i = end
        else:
            out.append(".*" if c == "*" else "." if c == "?" else re.escape(c))
        i += 1
    return f"(?is)^{''.join(out)}$"


def matches_any(name: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | name.rlike(glob_regex(p))
    return out


def slugify(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def slug(text: str) -> str:
    return re.sub("[^a-z0-9]+", "_", text.lower()).strip("_")


def variant_name(subset: str | None = None) -> str:
    if subset is None:
        return "markers_all"
    if not slug(subset):
        raise ValueError(f"{subset!r} leaves nothing to name a variant by")
    return f"markers_{slug(subset)}"


def patch_slug(mpp: float, size: int, overlap: float = 0.0, cell: bool = False) -> str:
    tail = "" if cell or not overlap else f"_{overlap:g}overlap"
    return f"{'cell_' if cell else ''}{round(mpp, 4):g}mpp_{size}px{tail}"


def effective_stride(size: int, overlap: float = 0.0, stride: int | None = None) -> int:
    if stride is not None and overlap:
        raise ValueError("give a stride or an overlap, not both")
    return stride if stride is not None else max(1, int(size * (1 - overlap)))


def output_stem(file_name: Column) -> Column:
    return F.regexp_replace(file_name, "(" + "|".join(map(re.escape, STEMS)) + ")$", "")


def slide_id(path: Column) -> Column:
    return F.substring(F.sha1(path.cast("binary")), 1, 12)


def format_duration(seconds: Column) -> Column:
    whole = F.floor(seconds).cast("bigint")
    return (
        F.when(seconds < 1, F.format_string("%.3fs", seconds)).when(seconds < 60, F.format_string("%.1fs", seconds))
        .otherwise(F.format_string("%dm %ds", F.floor(whole / 60), whole % 60))
    )


def is_blank(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value.cast("string"))), F.lit("")).isin("", "nan")


def scaling_factor(dtype: Column) -> Column:
    """255, 65535 or 1 by pixel type, whatever the byte order; others are an error."""
    plain = F.regexp_replace(F.lower(dtype), "^[<>=|]", "")
    return (
        F.when(plain.isin("uint8", "u1"), F.lit(255.0)).when(plain.isin("uint16", "u2"), F.lit(65535.0))
        .when(plain.startswith("f"), F.lit(1.0)).otherwise(F.raise_error(F.concat(F.lit("pixel type not supported: "), dtype)).cast("double"))
    )
