"""Dotted keys: escaping, decoding, paths and checks, all as column expressions.

A decoded key is an array of parts ``struct<text string, number bigint>``; a part is a text or a
number. In the escaped form every part ends with a dot.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS_TYPE = "array<struct<text:string,number:bigint>>"

# Escapes of the key format. Backslash, dot and newline inside a text part become
# \\ , \d and \n ; a number part n becomes \n with its digits.
BACKSLASH = "\\"


def escape_text(text: Column) -> Column:
    doubled = F.replace(text, F.lit(BACKSLASH), F.lit(BACKSLASH * 2))
    dotless = F.replace(doubled, F.lit("."), F.lit(BACKSLASH + "d"))
    return F.replace(dotless, F.lit("\n"), F.lit(BACKSLASH + "n"))


def unescape_text(text: Column) -> Column:
    """Inverse of ``escape_text``; an unknown escape stands for its own character."""

    def piece(p: Column) -> Column:
        p = F.replace(p, F.lit(BACKSLASH + "d"), F.lit("."))
        p = F.replace(p, F.lit(BACKSLASH + "n"), F.lit("\n"))
        return F.regexp_replace(F.regexp_replace(p, r"\\(.)", "$1"), r"\\$", "")

    # Doubled backslashes pair up from the left, so splitting at them leaves single escapes only.
    return F.array_join(F.transform(F.split(text, r"\\\\"), piece), BACKSLASH)


def text_parts(dotted: Column) -> Column:
    """Parts of a plain dotted name, all as text."""
    return F.transform(
        F.split(dotted, r"\."),
        lambda p: F.struct(p.alias("text"), F.lit(None).cast("bigint").alias("number")),
    )


def escape_key(parts: Column) -> Column:
    """Escaped form of an array of parts."""
    one = F.transform(
        parts,
        lambda p: F.concat(
            F.when(p["number"].isNotNull(), F.concat(F.lit(BACKSLASH), p["number"].cast("string"))).otherwise(
                escape_text(p["text"])
            ),
            F.lit("."),
        ),
    )
    return F.array_join(one, "")


def parse_key(escaped: Column) -> Column:
    """Array of parts from the escaped form; what follows the last dot is not a part."""
    pieces = F.split(escaped, r"\.")
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    return F.transform(
        pieces,
        lambda p: F.when(
            p.rlike(r"^\\[0-9]"),
            F.struct(
                F.lit(None).cast("string").alias("text"),
                F.coalesce(F.substring(p, 2, 1_000_000).try_cast("bigint"), F.lit(0).cast("bigint")).alias("number"),
            ),
        ).otherwise(F.struct(unescape_text(p).alias("text"), F.lit(None).cast("bigint").alias("number"))),
    )


def readable_key(parts: Column) -> Column:
    """Plain dotted text of an array of parts."""
    return F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], p["number"].cast("string"))), ".")


def normalize_key(escaped: Column) -> Column:
    """Plain dotted text from the escaped form, with or without its last dot."""
    return readable_key(parse_key(F.concat(F.rtrim(escaped, F.lit(".")), F.lit("."))))


def file_safe(dotted: Column) -> Column:
    """Every part is non-empty and made of letters, digits, ``_`` and ``'``."""
    return F.forall(F.split(dotted, r"\."), lambda p: p.rlike(r"^[A-Za-z0-9_']+$"))


def first_part(dotted: Column) -> Column:
    return F.split(dotted, r"\.")[0]


def module_of_path(path: Column, root: str, suffix: str) -> Column:
    """Dotted module name from a file path below ``root``."""
    inner = F.regexp_replace(path, "^.*?" + _quoted(root.rstrip("/")) + "/", "")
    return F.replace(F.regexp_replace(inner, _quoted(suffix) + "$", ""), F.lit("/"), F.lit("."))


def module_of_folder(path: Column, column: str = "module") -> Column:
    """Module name from a ``module=…`` folder of a partitioned table."""
    return F.url_decode(F.regexp_extract(path, f"/{column}=([^/]*)/", 1))


def path_prefixes(dotted: Column) -> Column:
    """All nested paths of a dotted name: ``A.b.c`` gives /A, /A/b and /A/b/c."""
    parts = F.split(dotted, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")),
    )


def _quoted(text: str) -> str:
    return re.escape(text)
