"""Text clean-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The fence marker with its optional language tag, and the characters that
# count as white space at the ends of a text.
FENCE = "```(?:yaml)?"
EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def strip_fences(text: Column) -> Column:
    """Drop fence markers and the white space around the text."""
    return F.regexp_replace(F.regexp_replace(text, FENCE, ""), EDGE_SPACE, "")


def posix_path(path: Column) -> Column:
    """One spelling per path: forward slashes, no ``./``, no doubled or closing slash."""
    slashes = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/+", "/")
    inner = F.regexp_replace(slashes, r"(?<=^|/)\./", "")
    return F.regexp_replace(inner, "(?<=.)/$", "")
