"""Text functions as column expressions: they stay in the JVM and in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: words of letters, joined by apostrophes or hyphens.
WORD = r"\p{L}+(?:['’-]\p{L}+)*"
#: Fixed value: control tokens that a response should not hold.
CONTROL = r"<\|?(?:audio|image|video)\|?>"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    """Null, or nothing but white space."""
    return F.coalesce(strip(c), F.lit("")) == ""


def leakage_text(c: Column) -> Column:
    """Case folded, all but letters and digits as one blank: the form in which leaks are looked for."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "ß", "ss"), r"[^\p{L}\p{N}_]+", " "))


def draft_text(c: Column) -> Column:
    """Case folded with white space collapsed; marks stay."""
    return strip(F.regexp_replace(F.regexp_replace(F.lower(c), "ß", "ss"), r"\s+", " "))


def slug(c: Column) -> Column:
    """Lower case, all but ASCII letters and digits as hyphens; null where nothing is left."""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(""))


def path_part(c: Column) -> Column:
    """As slug, but letters and digits of any script stay."""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", ""), F.lit(""))


def stable_id(*parts: Column) -> Column:
    return F.concat_ws("-", *parts)


def one_line(c: Column) -> Column:
    r"""Line breaks written as \n."""
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\\n")), F.lit("\n"), F.lit("\\n"))


def word_count(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(WORD), 0))


def is_record_id(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[a-z0-9][a-z0-9-]{2,}$"), F.lit(False))


def is_revision(c: Column) -> Column:
    """A full revision: 40 hexadecimal digits."""
    return F.coalesce(c.rlike("^[0-9a-f]{40}$"), F.lit(False))


def is_profile_key(c: Column) -> Column:
    """Lower-case ASCII letters, digits and hyphens, at least one."""
    return F.coalesce(c.rlike("^[a-z0-9-]+$"), F.lit(False))


def batch_code(c: Column) -> Column:
    """b007 of an id that ends in batch-7; null for any other."""
    number = F.regexp_extract(c, r"batch-(\d+)$", 1)
    return F.when(number != "", F.concat(F.lit("b"), F.lpad(number.cast("int").cast("string"), 3, "0")))


def turns(c: Column) -> Column:
    """array<struct<role, content>> of a text marked up by USER: and ASSISTANT: lines; turns without body are left out.

    A label stands alone on its line; one that is followed by words is part of what is said.
    """
    marks = F.regexp_extract_all(c, F.lit(r"(?m)^(USER|ASSISTANT):\s*$"), 1)
    bodies = F.slice(F.split(c, r"(?m)^(?:USER|ASSISTANT):\s*$"), 2, 1_000_000)
    pairs = F.transform(F.arrays_zip(marks.alias("r"), bodies.alias("b")), lambda p: F.struct(F.lower(p["r"]).alias("role"), strip(p["b"]).alias("content")))
    return F.filter(pairs, lambda m: m["content"] != "")


def visible_response(c: Column) -> Column:
    """Without think blocks, one that never ends included."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""), r"(?s)<think>.*$", ""))


def thought(c: Column) -> Column:
    """What the think blocks of a response hold, one line each."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"(?s)<think>(.*?)(?:</think>|$)"), 1), strip), "\n")


def canonical_messages(c: Column) -> Column:
    """Messages as compact JSON with keys in order."""
    return F.to_json(F.transform(c, lambda m: F.struct(m["content"].alias("content"), m["role"].alias("role"))), {"ignoreNullFields": "false"})


def hash_fraction(c: Column) -> Column:
    """The first 32 bits of the text's SHA-1 as a share of the largest: 0 to 1."""
    return F.conv(F.substring(F.sha1(c), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def try_int(c: Column) -> Column:
    """The whole number that a text is, outer blanks aside; null for any other text."""
    said = strip(c)
    return F.when(said.rlike(r"^[+-]?\d{1,9}$"), said.cast("int"))


def html_escape(c: Column) -> Column:
    out = c
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def table_cell(c: Column) -> Column:
    """A cell of a Markdown table: bars escaped, one line."""
    return one_line(F.replace(c, F.lit("|"), F.lit("\\|")))


def iso_utc(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
