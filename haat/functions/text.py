"""Text helpers: script detection, answer clean-up, JSON shapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from haat.functions.labels import SHORT_ANSWER_HINT

# White space as Python's ``str.isspace`` knows it, and the characters at
# which ``str.splitlines`` breaks a line.  Kept as code points so the same
# classes can be spelled for Java regex (Spark) and RE2 (the DuckDB oracle).
WHITESPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0,
              0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LINE_BREAKS = [0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x85, 0x2028, 0x2029]
BENGALI_BLOCK = (0x0980, 0x09FF)


def char_class(points, java: bool = True, negate: bool = False) -> str:
    esc = (lambda p: f"\\u{p:04X}") if java else (lambda p: f"\\x{{{p:04X}}}")
    return "[" + ("^" if negate else "") + "".join(esc(p) for p in points) + "]"


def line_break_regex(java: bool = True) -> str:
    return "\\r\\n|" + char_class(LINE_BREAKS, java)


def bengali_regex(java: bool = True) -> str:
    lo, hi = BENGALI_BLOCK
    return (f"[\\u{lo:04X}-\\u{hi:04X}]" if java else f"[\\x{{{lo:04X}}}-\\x{{{hi:04X}}}]")


def has_bengali(text: Column) -> Column:
    """any character of the Bengali block."""
    return text.rlike(bengali_regex())


def clean_answer(text: Column) -> Column:
    """strip, drop blank lines, right-trim every line, join with ``\\n``;
    answers under 40 characters get a hint appended.  Empty input stays empty.
    """
    ws = char_class(WHITESPACE)
    non_ws = char_class(WHITESPACE, negate=True)
    lines = F.split(text, line_break_regex())
    kept = F.filter(lines, lambda ln: ln.rlike(non_ws))
    trimmed = F.transform(kept, lambda ln: F.regexp_replace(ln, ws + "+\\z", ""))
    body = F.regexp_replace(F.array_join(trimmed, "\n"), "\\A" + ws + "+", "")
    return (F.when(text.isNull() | (text == ""), F.lit(""))
            .when(F.length(body) < 40, F.concat(body, F.lit(SHORT_ANSWER_HINT)))
            .otherwise(body))


# FIXED VALUES — response shapes in the order tried: list key, then its text keys.
REPLY_SHAPES = [("candidates", ("content", "output", "text")), ("output", ("content", "text")),
                ("outputs", ("content", "text"))]


def reply_text(js: Column, extra_keys=()) -> Column:
    """the text of a JSON reply.  The first shape that is present decides,
    whether or not it holds a text; of its keys the first that is not empty
    counts.  Only an object as first list item counts as present (for
    ``candidates``: any item).  Without a shape: ``response``, then the extra
    top-level keys."""
    get = F.get_json_object
    rest = F.coalesce(get(js, "$.response"), *[get(js, f"$.{k}") for k in extra_keys])
    out = rest
    for key, fields in reversed(REPLY_SHAPES):
        first = get(js, f"$.{key}[0]")
        present = first.isNotNull() if key == "candidates" else first.startswith("{")
        texts = [get(js, f"$.{key}[0].{f}") for f in fields]
        text = F.coalesce(*[F.nullif(t, F.lit("")) for t in texts[:-1]], texts[-1])
        out = F.when(F.coalesce(present, F.lit(False)), text).otherwise(out)
    return out


def first_two_joined(arr: Column, sep: str = ", ") -> Column:
    """the first two items of an (already ordered) array as text."""
    return F.array_join(F.slice(arr, 1, 2), sep)
