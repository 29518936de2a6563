"""Text and array column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as a character class that Java, RE2 and Python read alike.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


#: The same characters, to be trimmed.
SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """``text`` without white space of any kind at its ends; null stays null."""
    return F.btrim(text, F.lit(SPACES))


def normalize_text(text: Column) -> Column:
    """No-break spaces become spaces, runs of spaces and tabs one space, three or more newlines two; stripped."""
    spaced = F.regexp_replace(F.translate(text, "\u00a0\t", "  "), " {2,}", " ")
    return strip(F.regexp_replace(spaced, r"\n{3,}", "\n\n"))


def normalize_space(text: Column) -> Column:
    """Runs of white space become one space; stripped."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def normalize_scientific(text: Column) -> Column:
    """Dollar signs removed, split numbers before units joined, LaTeX degrees as a sign, white space collapsed; in this order."""
    degree = r"\^\s*\{\s*\\circ\s*\}\s*"
    out = F.replace(text, F.lit("$"), F.lit(" "))
    out = F.regexp_replace(out, rf"(\d)\s+(\d)\s*\\?\s*{degree}C", "$1$2 C")
    out = F.regexp_replace(out, rf"(\d)\s+(\d)\s*~?\s*{degree}\\mathrm\s*\{{\s*C\s*\}}", "$1$2 C")
    out = F.regexp_replace(out, f"{SPACE}+", " ")
    out = F.replace(out, F.lit("\\ ^ { \\circ }"), F.lit("°"))
    out = F.replace(out, F.lit("^ { \\circ }"), F.lit("°"))
    return F.regexp_replace(out, r"(?<=\d)\s+(?=\d\s*(?:°|C|mg|min|h|%))", "")


def select_span(text: Column, anchor: str, window: int = 420) -> Column:
    """The text around the first ``anchor`` (a third of the window before, the window after), else its beginning; spaces normalised."""
    at = F.locate(anchor.lower(), F.lower(text)) - 1
    start = F.when(at < 0, 0).otherwise(F.greatest(at - window // 3, F.lit(0)))
    end = F.when(at < 0, window).otherwise(at + window)
    return normalize_space(F.substring(text, start + 1, end - start))


def first_number(text: Column) -> Column:
    """The first unsigned decimal number anywhere in ``text`` as a double, null if there is none."""
    return F.regexp_substr(text, F.lit(r"\d+(?:\.\d+)?")).cast("double")


def matched_numbers(text: Column, pattern: str) -> Column:
    """The numbers that group 1 of ``pattern`` captures, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), lambda x: x.cast("double"))


def first_match(text: Column, pattern: str) -> Column:
    return F.get(matched_numbers(text, pattern), F.lit(0))


def last_match(text: Column, pattern: str) -> Column:
    return F.try_element_at(matched_numbers(text, pattern), F.lit(-1))


def select_temperature(values: Column) -> Column:
    """Of the temperatures from 10 to 80: 25 if it is among them, else the first; null without any."""
    likely = F.filter(values, lambda v: (v >= 10) & (v <= 80))
    return F.when(F.array_contains(likely, 25.0), 25.0).otherwise(F.get(likely, F.lit(0)))


def cycle_count(text: Column) -> Column:
    """A number in digits or as a word from one to ten, else null."""
    words = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
    plain = F.lower(F.trim(text))
    out = F.when(plain.rlike(r"^\d+$"), F.expr("NULL"))
    for n, word in enumerate(words, 1):
        out = out.when(plain == word, n)
    return F.coalesce(out, F.regexp_substr(plain, F.lit(r"^\d+$")).try_cast("int"))


def citation(pdf: Column, document: Column, start: Column, end: Column) -> Column:
    """file:pN or file:pN-pM with pages from 1, the file alone without a page; falls back to the document."""
    name = F.coalesce(F.nullif(pdf, F.lit("")), F.nullif(document, F.lit("")), F.lit("<unknown>"))
    first, last = (start + 1).cast("string"), (end + 1).cast("string")
    return F.when(start.isNull(), name).when(end.isNull() | (end == start), F.concat(name, F.lit(":p"), first)).otherwise(F.concat(name, F.lit(":p"), first, F.lit("-p"), last))


def cited_file(cited: Column) -> Column:
    """The file of a citation."""
    return F.regexp_replace(cited, r":p\d+(?:-p\d+)?$", "")


def cited_page(cited: Column) -> Column:
    """The first page of a citation, from 1; null without a page."""
    return F.nullif(F.regexp_extract(cited, r":p(\d+)(?:-p\d+)?$", 1), F.lit("")).cast("int")


def joined_parts(*parts: Column) -> Column:
    """The non-blank ``parts``, stripped, one a line."""
    return F.concat_ws("\n", *[F.nullif(strip(p), F.lit("")) for p in parts])


def lines(*parts: Column) -> Column:
    """The non-empty ``parts`` as they are, one a line."""
    return F.concat_ws("\n", *[F.nullif(p, F.lit("")) for p in parts])


def caption(parts: Column) -> Column:
    """A caption's parts joined by spaces and normalised; null if nothing is left."""
    return F.nullif(normalize_text(F.array_join(parts, " ")), F.lit(""))


def valid_bbox(box: Column) -> Column:
    """``box`` if it is four non-null numbers, else null."""
    return F.when((F.size(box) == 4) & ~F.exists(box, lambda x: x.isNull()), box)


def bbox_union(box: Column) -> Column:
    """Aggregate: the smallest box around all non-null boxes, null without any."""
    sides = [F.min(box[0]), F.min(box[1]), F.max(box[2]), F.max(box[3])]
    return F.when(sides[0].isNotNull(), F.array(*sides))


def slices(text: Column, width: int = 120) -> Column:
    """``text`` in pieces of ``width`` characters; empty for null and empty texts."""
    count = F.ceil(F.length(text) / width).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(text, i * width + 1, F.lit(width)))).otherwise(F.array().cast("array<string>"))


def escaped_json(text: Column) -> Column:
    """Backslashes, quotes and newlines escaped."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def name_uuid(name: Column) -> Column:
    """The version 5 UUID of ``name`` in the URL namespace."""
    raw = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(raw, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", F.substring(raw, 1, 8), F.substring(raw, 9, 4), F.concat(F.lit("5"), F.substring(raw, 14, 3)), F.concat(variant, F.substring(raw, 18, 3)), F.substring(raw, 21, 12))


def named_enzyme(text: Column) -> Column:
    """The enzyme a request names: a known name it contains, else what stands before its first comma, stop or line end."""
    low = F.lower(text)
    full = "Burkholderia cepacia lipase"
    known = F.when(low.contains(full.lower()) | low.contains("bcl"), full).when(low.contains("lipase"), "lipase")
    return F.coalesce(known, strip(F.get(F.split(text, r"[，,。.\n]"), F.lit(0))))


def plain_symbols(text: Column) -> Column:
    """LaTeX forms of the kinetic constants as plain symbols."""
    for latex, plain in (("$K _ { m }$", "Km"), ("$V _ { m a x }$", "Vmax"), ("$V _ { m a x } / K _ { m }$", "Vmax / Km")):
        text = F.replace(text, F.lit(latex), F.lit(plain))
    return text


def first_present(*values: Column) -> Column:
    """The first value that is neither null nor blank."""
    return F.coalesce(*[F.when(strip(v.cast("string")) != "", v.cast("string")) for v in values])


def plain_items(items: Column) -> Column:
    """The non-blank texts of a list, stripped; empty for null."""
    return F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), strip), lambda x: F.coalesce(x != "", F.lit(False)))


def object_or_null(text: Column) -> Column:
    """``text`` if it is a JSON object, else null."""
    return F.when(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), text)


def query_text(*parts: Column, fixed: str = "") -> Column:
    """The non-blank ``parts`` and the fixed words, joined by spaces."""
    return F.concat_ws(" ", *[F.nullif(strip(p), F.lit("")) for p in parts], F.lit(fixed)) if fixed else F.concat_ws(" ", *[F.nullif(strip(p), F.lit("")) for p in parts])


# The words that every query of its kind asks with.
RECOMMENDING = "immobilization carrier support method conditions activity recovery yield reusability stability"
OPTIMISING = "immobilization formulation conditions enzyme loading carrier amount pH temperature time activity recovery yield reusability"


def spaced_parts(*parts: Column) -> Column:
    """The non-empty ``parts`` as they are, joined by spaces; stripped."""
    return strip(F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts]))


def recommendation_query(name: Column, objective: Column, context: Column, constraints: Column) -> Column:
    """The text that evidence for an enzyme is searched with."""
    return spaced_parts(name, F.lit(RECOMMENDING), objective, context, constraints)


def optimisation_query(name: Column, objective: Column, context: Column, constraints: Column, formulation: Column) -> Column:
    """The text that evidence for a formulation (its canonical JSON) is searched with."""
    return spaced_parts(name, objective, context, constraints, formulation, F.lit(OPTIMISING))
