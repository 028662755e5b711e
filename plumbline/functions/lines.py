"""Line classifiers as column expressions over a source text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = " \t\r\x0b\x0c"
BARREL_SHARE = 0.8
# What begins an import or export line, by language.
IMPORT_PREFIX = {
    "python": r"""^(import |from |__all__|["']|#)""",
    "javascript": r"^(import |export |\}|//)",
    "typescript": r"^(import |export |\}|//)",
    "rust": r"^(use |pub use |mod |pub mod |\}|//)",
}
PYTHON_CLOSERS = [")", "]", "},", ");", "],"]
PYTHON_LOGIC = r"^(def |class |if |for |while |return |raise |try |with |async )"
COMMENT_PREFIX = {"python": "#", "javascript": "//", "typescript": "//", "go": "//", "rust": "//"}
BLOCK_COMMENT = {"javascript", "typescript", "go", "rust"}


def trimmed(c: Column) -> Column:
    return F.trim(c, F.lit(WHITE))


def lines(source: Column) -> Column:
    """The lines of a text, by newline."""
    return F.split(F.coalesce(source, F.lit("")), "\n")


def filled(source: Column) -> Column:
    """Its lines that are not blank, trimmed."""
    return F.filter(F.transform(lines(source), trimmed), lambda x: x != "")


def is_import(line: Column, language: str) -> Column:
    """Whether a trimmed line belongs to the imports or exports of a module."""
    begins = line.rlike(IMPORT_PREFIX[language])
    if language != "python":
        return begins
    name = F.regexp_replace(F.regexp_replace(line, r",*$", ""), r"\)*$", "")
    name = F.translate(F.regexp_replace(name, r"\]*$", ""), "\"' ", "")
    return begins | line.isin(PYTHON_CLOSERS) | (~line.rlike(PYTHON_LOGIC) & name.rlike(r"^[\p{L}_][\p{L}\p{N}_]*$"))


def import_share(source: Column, language: str) -> Column:
    """Share of the non-blank lines that are imports; null without lines."""
    rows = filled(source)
    return F.when(F.size(rows) > 0, F.size(F.filter(rows, lambda x: is_import(x, language))) / F.size(rows))


def is_barrel(source: Column, language: str) -> Column:
    """Whether a module only passes on what it imports: two or more non-blank lines, of which 80 % are imports."""
    if language not in IMPORT_PREFIX:
        return F.lit(False)
    return (F.size(filled(source)) >= 2) & (F.coalesce(import_share(source, language), F.lit(0.0)) >= BARREL_SHARE)


def code_lines(source: Column, language: str) -> Column:
    """Lines that are neither blank nor comment; block comments are followed from line to line."""
    mark = COMMENT_PREFIX.get(language, "#")
    rows = filled(source)
    if language not in BLOCK_COMMENT:
        return F.size(F.filter(rows, lambda x: ~x.startswith(mark))).cast("long")
    start = F.struct(F.lit(False).alias("inside"), F.lit(0).cast("long").alias("n"))

    def step(state: Column, x: Column) -> Column:
        opens = x.startswith("/*")
        after = F.when(state["inside"], ~x.contains("*/")).otherwise(opens & ~F.substring(x, F.lit(3), F.char_length(x)).contains("*/"))
        counts = ~state["inside"] & ~opens & ~x.startswith(mark)
        return F.struct(after.alias("inside"), (state["n"] + counts.cast("long")).alias("n"))

    return F.aggregate(rows, start, step)["n"]


def line_count(source: Column) -> Column:
    """Lines of a text without its trailing newlines."""
    return F.size(F.split(F.rtrim(F.coalesce(source, F.lit("")), F.lit("\n")), "\n"))


def cut_lines(source: Column, first: Column, last: Column) -> Column:
    """Lines ``first`` to ``last`` (from 1, both included) as text."""
    return F.array_join(F.slice(lines(source), first, F.greatest(last - first + 1, F.lit(0))), "\n")
