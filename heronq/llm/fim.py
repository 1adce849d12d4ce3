"""Fill-in-middle transformation by escaped marker injection, in built-in functions only.

A text is cut into units (code points, or what another pattern matches) without an array of them: a delimiter is escaped
in the text, regexp_replace appends it to every unit, the delimiters so injected are counted, substring_index takes the
parts by rank, and the parts are unescaped and put together. Each row is worked on alone, where it is read: no shuffle,
and memory for a few copies of one text.

The cuts and the form follow from a hash of the document's id alone, so a rerun gives the same output.

Defined results: a null text is the empty one; empty texts, and those that hold one of the marks, are plain, which is
always restorable; a null id is hashed as an empty decimal; repeated rows and equal ids are treated alike; texts may hold
the delimiter and the escape; the longest text is about half of what one string may hold (2 GB), as delimiters double it;
columns other than id and text are left out, whatever their names; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is injected, what escapes it, and the letters after the escape.
DELIMITER, ESCAPE, FOR_DELIMITER, FOR_ESCAPE = "\x01", "\x02", "d", "e"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + FOR_ESCAPE))
    return F.replace(text, F.lit(DELIMITER), F.lit(ESCAPE + FOR_DELIMITER))


def unescaped(part: Column) -> Column:
    """A part of a marked text as it was: injected delimiters leave, then escapes are undone."""
    part = F.replace(part, F.lit(DELIMITER), F.lit(""))
    part = F.replace(part, F.lit(ESCAPE + FOR_DELIMITER), F.lit(DELIMITER))
    return F.replace(part, F.lit(ESCAPE + FOR_ESCAPE), F.lit(ESCAPE))


def marked(text: Column, unit: str) -> Column:
    """An escaped text with a delimiter after each unit; an escape and the letter after it are one unit."""
    return F.regexp_replace(text, f"(?s){ESCAPE}[{FOR_DELIMITER}{FOR_ESCAPE}]|{unit}", "$0" + DELIMITER)


def injected(mark: Column, text: Column) -> Column:
    """How many delimiters a marked text holds: the escaped text has none of its own."""
    return (F.octet_length(mark) - F.octet_length(text)).cast("long")


def ranked(mark: Column, n: Column, first: Column, last: Column) -> Column:
    """The units of ranks first + 1 to last of a marked text of n units."""
    head = lambda s, count: F.call_function("substring_index", s, F.lit(DELIMITER), count.cast("int"))
    # from the end the empty part behind the last delimiter counts as one
    return unescaped(F.when(last < n, head(head(mark, last), first - last)).otherwise(head(mark, first - n - 1)))


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of a row: the first hexadecimal groups of a hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 1, rate: int = 90, spm: int = 20, unit: str = "[^\x02]") -> DataFrame:
    """(doc_id, text) -> (doc_id, n, form, prefix_chars, middle_chars, output), one row a row.

    Of 100 texts about `rate` are transformed, `spm` of 100 of these suffix first. Units are what `unit` matches; it must
    match any one code point other than the escape, so that no text is left over.
    """
    one, two, three, four = draws(F.col("doc_id"), seed)
    source = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    source = source.select("doc_id", "text", escaped(F.col("text")).alias("escaped"))
    source = source.select("doc_id", "text", "escaped", marked(F.col("escaped"), unit).alias("mark"))
    cut = source.select("doc_id", "text", "mark", injected(F.col("mark"), F.col("escaped")).alias("n"))
    a, b = one % (F.col("n") + 1), two % (F.col("n") + 1)
    bare = (F.col("n") == 0) | (three % 100 >= rate)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        bare = bare | F.contains("text", F.lit(mark))
    form = F.when(bare, "plain").when(four % 100 < spm, "spm").otherwise("psm")
    cut = cut.select("doc_id", "text", "mark", "n", form.alias("form"), F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
    n, lo, hi = F.col("n"), F.col("lo"), F.col("hi")
    part = lambda first, last: ranked(F.col("mark"), n, first, last)
    fim = F.col("form") != "plain"
    parts = cut.select(
        "doc_id", "text", "n", "form",
        F.when(fim, lo).alias("prefix_chars"), F.when(fim, hi - lo).alias("middle_chars"),
        F.when(fim, part(F.lit(0).cast("long"), lo)).alias("p"), F.when(fim, part(lo, hi)).alias("m"), F.when(fim, part(hi, n)).alias("s"),
    )
    psm = F.concat(F.lit(PREFIX), "p", F.lit(SUFFIX), "s", F.lit(MIDDLE), "m")
    spm_ = F.concat(F.lit(SUFFIX), "s", F.lit(PREFIX), "p", F.lit(MIDDLE), "m")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm_).otherwise(F.col("text"))
    return parts.select("doc_id", "n", "form", "prefix_chars", "middle_chars", output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form came from. No part holds a mark, nor can a mark arise where parts meet."""
    after = lambda s, mark: F.substring_index(s, mark, -1)
    before = lambda s, mark: F.substring_index(s, mark, 1)
    middle = after(output, MIDDLE)
    psm = F.concat(after(before(output, SUFFIX), PREFIX), middle, before(after(output, SUFFIX), MIDDLE))
    spm = F.concat(before(after(output, PREFIX), MIDDLE), middle, after(before(output, PREFIX), SUFFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
