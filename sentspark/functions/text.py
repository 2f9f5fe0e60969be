"""String expressions for corpus cleaning.

All of them are plain ``pyspark.sql.functions`` calls, so they stay inside
whole-stage codegen and run unchanged on batch or streaming DataFrames.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the reference's behaviour) -------------------
# Sentence break: every ". " becomes ".\n" before the text is split on "\n".
SENTENCE_BREAK_FROM = ". "
SENTENCE_BREAK_TO = ".\n"
# No-break space is normalised to a plain space (after the sentence break).
NBSP = "\u00a0"
# Minimum sentence length in code points, tested after strip, before the
# character whitelist.
MIN_SENTENCE_CHARS = 10
# Characters Python's str.strip() treats as whitespace, in code-point order.
STRIP_CHARS = "".join(chr(c) for first, last in (
    (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
    (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)) for c in range(first, last + 1))
# Characters kept by the cleaning whitelist, as a regex class in code-point
# order: space, quote, percent, apostrophe to middle dot, curly quotes, angle
# brackets, CJK, Hangul syllables.  Everything else is deleted.
KEEP_CLASS = " \"%'-·‘’“”〈-》一-龥가-힣"
# Null sentences become one space so the row survives feature building.
NULL_TEXT = " "
# STS gold scores are on a 0-5 scale; null counts as 0.
SCORE_SCALE = 5.0
# ---------------------------------------------------------------------------

DROP_PATTERN = f"[^{KEEP_CLASS}]"
# The part of Latin-1 that the whitelist deletes.
LATIN1_DROP_CHARS = "".join(re.findall(DROP_PATTERN, "".join(map(chr, range(0x100)))))


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def sentence_break(col) -> Column:
    """Literal ". " -> ".\\n", all occurrences."""
    return F.replace(_c(col), F.lit(SENTENCE_BREAK_FROM), F.lit(SENTENCE_BREAK_TO))


def nbsp_norm(col) -> Column:
    """P5: NBSP -> space."""
    return F.replace(_c(col), F.lit(NBSP), F.lit(" "))    # finds bytes; ``translate`` looks up every character


def split_lines(col) -> Column:
    """U1 helper: split on "\\n", trailing empty pieces kept."""
    return F.split(_c(col), "\n", -1)


def strip_ws(col) -> Column:
    """Strip Unicode whitespace at both ends.

    Plain ``trim`` only strips U+0020; ``trim(str, chars)`` strips any code
    point of ``chars`` from both ends in one codegen loop (no regex).
    """
    return F.trim(_c(col), F.lit(STRIP_CHARS))


def long_enough(col, min_chars: int = MIN_SENTENCE_CHARS) -> Column:
    """P7 predicate: at least ``min_chars`` code points."""
    return F.length(_c(col)) >= F.lit(min_chars)


def char_filter(col) -> Column:
    """Delete every character outside the whitelist (result may be empty).

    ``translate`` first deletes the Latin-1 characters outside the set (no
    regex).  If what is left is pure ASCII (as many bytes as code points),
    every character in it is kept and it is the result; otherwise -- other
    scripts, or kept Latin-1 signs such as NBSP or guillemets -- the class
    regex finishes it.  Deleting part of what the regex deletes first does
    not change its result.
    """
    t = F.translate(_c(col), LATIN1_DROP_CHARS, "")
    return (F.when(F.length(t) == F.octet_length(t), t)
             .otherwise(F.regexp_replace(t, DROP_PATTERN, "")))


def fill_null_text(col, blank_as_null: bool = False) -> Column:
    """P10: null (and optionally "") -> one space."""
    c = _c(col)
    if blank_as_null:
        c = F.when(c == F.lit(""), F.lit(None).cast("string")).otherwise(c)
    return F.coalesce(c, F.lit(NULL_TEXT))


def norm_score(col, scale: float = SCORE_SCALE) -> Column:
    """Null -> 0, then divide by the scale."""
    return F.coalesce(_c(col).cast("double"), F.lit(0.0)) / F.lit(float(scale))
