"""Fill-in-middle examples by lookaround splitting.

A unit grammar is a set of neighbours: a text is cut between two characters where the left one is in the first class of a pair and the right
one in its second. Each pair is a zero-width pattern, so Spark's split() loses no character and the pieces joined again are the text.

Draws come from the SHA-256 of "<seed>:<id>": its first four 32-bit groups choose the two cuts, whether the text is transformed, and the order.

Stated cases. Null or empty text: no unit, form "plain", output "". A text that holds a sentinel stays plain, as it could not be told from the
markers. A null id draws like an empty one; rows of one id draw alike, whatever their texts. White space alone is one unit. Ties of both cuts
leave an empty middle, cuts at the ends an empty prefix or suffix; these are valid examples. No rows: no rows. Other columns aren't read unless kept,
and may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"\x20\x09-\x0D"
_IDENTIFIER = r"\p{L}\p{N}_"
#: Neighbours between which each grammar cuts: (class of the left character, class of the right one).
GRAMMARS: dict[str, tuple[tuple[str, str], ...]] = {
    # space in front of a word belongs to it; space at the end is a unit of its own
    "words": ((f"[^{SPACE}]", f"[{SPACE}]"),),
    "lines": ((r"\n", r"[\x{0}-\x{10FFFF}]"),),
    # runs of letters, digits and underscores; runs of white space; each other character alone
    "code": (
        (f"[{_IDENTIFIER}]", f"[^{_IDENTIFIER}]"),
        (r"[\s]", r"[^\s]"),
        (rf"[^\s{_IDENTIFIER}]", r"[\x{0}-\x{10FFFF}]"),
    ),
    "characters": ((r"[\x{0}-\x{10FFFF}]", r"[\x{0}-\x{10FFFF}]"),),
}
#: No cut inside a character that Java holds as two code units.
_WHOLE = r"(?![\x{DC00}-\x{DFFF}])"


@dataclass(frozen=True)
class Sentinels:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


def _check(marks: Sentinels) -> None:
    """Sentinels that no text without them can form together with one of them."""
    all_marks = [marks.prefix, marks.suffix, marks.middle]
    pairs = [(a, b) for i, a in enumerate(all_marks) for j, b in enumerate(all_marks) if i != j]
    overlaps = any(a[-k:] == b[:k] for a in all_marks for b in all_marks for k in range(1, min(len(a), len(b))))
    if not all(all_marks) or any(a in b for a, b in pairs) or overlaps:
        raise ValueError(f"sentinels must be distinct, not empty, and free of overlaps: {all_marks}")


def boundary(grammar: str) -> str:
    """The zero-width pattern at which texts are split."""
    return "|".join(f"(?<={left}){_WHOLE}(?={right})" for left, right in GRAMMARS[grammar])


def units(text: Column, grammar: str = "words") -> Column:
    """The units of a text, which joined are the text; none of an empty or null one."""
    return F.when(F.length(text) > 0, F.split(text, boundary(grammar), -1)).otherwise(F.array().cast("array<string>"))


def restored(output: Column, form: Column, marks: Sentinels = Sentinels()) -> Column:
    """The text that an output was made from, read from the output and its form alone."""
    parts = F.split(output, "|".join(rf"\Q{m}\E" for m in (marks.prefix, marks.suffix, marks.middle)), -1)
    part = lambda i: F.get(parts, F.lit(i))
    psm = F.concat(part(1), part(3), part(2))
    spm = F.concat(part(2), part(3), part(1))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def fill_middle(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    grammar: str = "words",
    seed: str = "42",
    rate: int = 50,
    spm_rate: int = 80,
    marks: Sentinels = Sentinels(),
    keep: list[str] | None = None,
) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) and the columns named in keep, one row for each row of df.

    rate: of 100 texts with units and without sentinels so many are transformed; spm_rate: of 100 of these so many put the suffix first.
    One pass over the rows, without an exchange and without Python.
    """
    _check(marks)
    kept = [c for c in keep or [] if c != id_col]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    draw = lambda k: F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long")
    rows = df.select(F.col(id_col).alias("id"), F.struct(F.lit(0), *kept).alias("kept"), F.coalesce(text_col, F.lit("")).alias("text"), digest.alias("digest"))
    cut = rows.select("*", units(F.col("text"), grammar).alias("units"))
    cut = cut.select("id", "kept", "text", "digest", "units", F.size("units").cast("long").alias("n"))
    for k in range(2):
        cut = cut.withColumn(f"cut{k}", draw(k) % (F.col("n") + 1))
    marked = F.lit(False)
    for m in (marks.prefix, marks.suffix, marks.middle):
        marked = marked | F.contains("text", F.lit(m))
    form = F.when((F.col("n") == 0) | marked | (draw(2) % 100 >= rate), "plain").when(draw(3) % 100 < spm_rate, "spm").otherwise("psm")
    begin, end = F.least("cut0", "cut1").cast("int"), F.greatest("cut0", "cut1").cast("int")
    joined = lambda start, length: F.array_join(F.slice("units", start, length), "")
    pieces = F.when(
        F.col("form") != "plain",
        F.struct(joined(F.lit(1), begin).alias("prefix"), joined(begin + 1, end - begin).alias("middle"), joined(end + 1, F.size("units") - end).alias("suffix")),
    )
    made = cut.withColumn("form", form).select("id", "kept", "text", "n", "form", pieces.alias("p"))
    psm = F.concat(F.lit(marks.prefix), "p.prefix", F.lit(marks.suffix), "p.suffix", F.lit(marks.middle), "p.middle")
    spm = F.concat(F.lit(marks.suffix), "p.suffix", F.lit(marks.prefix), "p.prefix", F.lit(marks.middle), "p.middle")
    return made.select(
        "id", "n", "form",
        F.length("p.prefix").cast("long").alias("prefix_chars"), F.length("p.middle").cast("long").alias("middle_chars"),
        F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm).alias("output"),
        *[F.col("kept")[c].alias(c) for c in kept],
    )
