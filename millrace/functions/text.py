"""Text columns, all of built-in expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points that count as white space when a text is stripped.
SPACE_CODES = (
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680,
    0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009,
    0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
SPACES = "".join(map(chr, SPACE_CODES))
# The same set as a pattern; a class that lists the code points is several times slower.
_SPACE, _VISIBLE = r"[\s\x1C-\x1F]", r"[^\s\x1C-\x1F]"
SPACE_RUN = f"(?U){_SPACE}+"
_SLOT = r"\{\{|\}\}|\{\w+\}|[^{}]+|[{}]"


def strip(c: Column) -> Column:
    """Without white space at both ends (Unicode white space, not only the blank).

    Trimming a set of characters takes the text apart, so only texts that begin or end
    with one of them are trimmed.
    """
    spaces = F.lit(SPACES)
    padded = F.contains(spaces, F.substring(c, 1, 1)) | F.contains(spaces, F.substring(c, -1, 1))
    return F.when(padded, F.btrim(c, spaces)).otherwise(c)


def normalise(c: Column) -> Column:
    """Lower case, stripped: the form in which two texts count as equal."""
    return F.lower(strip(c))


def text_key(c: Column) -> Column:
    """Digest of the normalised text; 32 bytes travel through a shuffle, not the text."""
    return F.md5(normalise(c))


def stripped_length(c: Column) -> Column:
    return F.length(strip(c))


def words(c: Column) -> Column:
    """Words between runs of white space; empty for a blank text."""
    return F.filter(F.split(c, SPACE_RUN), lambda w: w != "")


def first_word(c: Column, default: str) -> Column:
    found = F.regexp_extract(c, f"(?U)^{_SPACE}*({_VISIBLE}+)", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit(default))


def last_word(c: Column, default: str) -> Column:
    found = F.regexp_extract(c, f"(?Us)^(?:.*{_SPACE})?({_VISIBLE}+){_SPACE}*$", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit(default))


def fill_slots(template: Column, slots: Mapping[str, Column]) -> Column:
    """Put values into the `{name}` slots of a template, in one pass.

    A value is put in as it is, braces included. `{{` and `}}` stand for single braces, a slot
    without a value stays, and the result is null if a value that is asked for is.
    """

    def part(p: Column) -> Column:
        filled = F.when(p == "{{", F.lit("{")).when(p == "}}", F.lit("}"))
        for name, value in slots.items():
            filled = filled.when(p == "{" + name + "}", value)
        return filled.otherwise(p)

    parts = F.transform(F.regexp_extract_all(template, F.lit(_SLOT), F.lit(0)), part)
    return F.when(~F.exists(parts, lambda p: p.isNull()), F.array_join(parts, ""))


def task_slots(task: Column) -> dict[str, Column]:
    """The five slot values that one task text gives. Names and defaults are fixed values."""
    return {
        "task": task,
        "problem": task,
        "concept": last_word(task, "solution"),
        "algorithm": first_word(task, "algorithm"),
        "features": F.concat(F.lit("advanced "), task),
    }


def token_estimate(c: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(c) / 4)


def line_count(c: Column) -> Column:
    """Lines, an empty last one included."""
    return F.size(F.split(c, "\n", -1))


def comment_lines(c: Column) -> Column:
    """Lines whose first visible character is `#`."""
    return F.regexp_count(c, F.lit(r"(?Umd)^[\s\x1C-\x1F&&[^\n]]*#"))


def comment_density(c: Column) -> Column:
    return comment_lines(c) / F.greatest(line_count(c), F.lit(1))


def file_key(c: Column) -> Column:
    """A name fit for a file: blanks to `_`, round brackets dropped."""
    return F.translate(c, " ()", "_")


def assertion_parts(c: Column) -> Column:
    """`assert call == expected` as a struct; null unless there are exactly two parts."""
    parts = F.split(F.replace(c, F.lit("assert "), F.lit("")), " == ", -1)
    pair = F.struct(strip(parts[0]).alias("input"), strip(parts[1]).alias("expected"))
    return F.when(F.contains(c, F.lit("assert")) & (F.size(parts) == 2), pair)


def drop_prefix(c: Column, prefix: Column) -> Column:
    """The text after as many characters as `prefix` has, stripped."""
    return strip(F.substring(c, F.length(prefix) + 1, F.length(c)))


def score_text(c: Column) -> Column:
    """Three decimals, rounded from the exact value of the double; `%.3f` of the JVM would
    round its shortest decimal form instead."""
    return F.replace(F.format_number(c, 3), F.lit(","), F.lit(""))


def ratio(part: Column, whole: Column) -> Column:
    """Division that treats a whole below one as one."""
    return part / F.greatest(whole, F.lit(1))


def render_record(
    head: Sequence[Column],
    context: Column,
    style: Column,
    style_lines: Mapping[str, str],
    closing: Column,
) -> Column:
    """A record as text: head lines, optional context, a line that depends on style, closing."""
    clause = F.lit(None).cast("string")
    for name, line in style_lines.items():
        clause = F.when(style == name, F.lit(line)).otherwise(clause)
    context_line = F.when(F.length(context) > 0, F.concat(F.lit("\nContext: "), context))
    return F.concat_ws("\n", *head, context_line, clause, F.concat(F.lit("\n"), closing))


def first_match(c: Column, rules: Sequence[tuple[Sequence[str], str]], default: str) -> Column:
    """Label of the first rule of which the text contains any pattern, in any case."""
    low, chain = F.lower(c), None
    for patterns, label in rules:
        hit = F.lit(False)
        for p in patterns:
            hit = hit | F.contains(low, F.lit(p.lower()))
        chain = F.when(hit, F.lit(label)) if chain is None else chain.when(hit, F.lit(label))
    return F.lit(default) if chain is None else chain.otherwise(F.lit(default))


def contains_any(c: Column, patterns: Sequence[str]) -> Column:
    low, hit = F.lower(c), F.lit(False)
    for p in patterns:
        hit = hit | F.contains(low, F.lit(p.lower()))
    return hit


def in_one_line(c: Column) -> Column:
    """A text without line breaks, which `in_lines` turns back: backslashes doubled, breaks written as a backslash and a letter."""
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def in_lines(c: Column) -> Column:
    """What `in_one_line` was given. What stands between doubled backslashes holds none but those of breaks."""
    broken = lambda part: F.replace(F.replace(part, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r"))
    undone = F.array_join(F.transform(F.split(c, r"\\\\", -1), broken), "\\")
    return F.when(F.contains(c, F.lit("\\")), undone).otherwise(c)
