"""Text rules as column expressions: folds, white space, variation selectors, value summaries, subset tags, number text."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

#: Code points with Unicode's White_Space property, as a character class.
WHITE_SPACE = r"[\x09-\x0d\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SELECTORS = r"[\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}]"
#: Radicals that are not folded.
UNFOLDED_RADICALS = (0x2F2A, 0x2F2C, 0x2F3E)


def fold_table() -> dict[str, dict[str, str]]:
    """What page text folds to, by fold, in the order in which folds are tried. Built from Unicode's compatibility mappings."""
    norm = lambda c: unicodedata.normalize("NFKC", chr(c))
    radicals = {chr(c): norm(c) for c in range(0x2F00, 0x2FD6) if c not in UNFOLDED_RADICALS}
    vertical = {}
    for c in (*range(0xFE10, 0xFE1A), *range(0xFE30, 0xFE45), *range(0xFE47, 0xFE49)):
        plain = norm(c)
        if plain != chr(c) and len(plain) == 1:
            vertical[chr(c)] = chr(ord(plain) + 0xFEE0) if 0x21 <= ord(plain) <= 0x7E else plain
    ligatures = {chr(c): norm(c) for c in range(0xFB00, 0xFB07)}
    return {"radicals": radicals, "vertical-forms": vertical, "ligatures": ligatures}


def fold(text: Column) -> Column:
    """Text with every fold applied: one to one by translate, ligatures by replacement."""
    table = fold_table()
    single = table["radicals"] | table["vertical-forms"]
    out = F.translate(text, "".join(single), "".join(single.values()))
    for a, b in table["ligatures"].items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def fold_count(text: Column) -> Column:
    """How many characters fold."""
    every = "".join(c for part in fold_table().values() for c in part)
    return F.length(text) - F.length(F.translate(text, every, ""))


def strip_white_space(text: Column) -> Column:
    return F.regexp_replace(text, WHITE_SPACE, "")


def without_selectors(text: Column) -> Column:
    return F.regexp_replace(text, SELECTORS, "")


def clusters(text: Column) -> Column:
    """Base characters with their selectors; a selector at the start is a cluster of its own."""
    return F.length(without_selectors(text)) + F.when(text.rlike(f"^(?:{SELECTORS})"), 1).otherwise(0)


def summary(text: Column, most: int = 120) -> Column:
    """The text, cut with dots where it is longer than most characters."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 3)), F.lit("..."))).otherwise(text)


def subset_tag(name: Column) -> Column:
    """tag, the name without it, and whether six characters and a plus are no proper tag."""
    proper, any6 = name.rlike(r"^[A-Z]{6}\+"), name.rlike(r"^[^+]{6}\+")
    return F.struct(F.when(proper, F.left(name, F.lit(6))).alias("tag"), F.when(proper, F.substr(name, F.lit(8))).otherwise(name).alias("base"), (any6 & ~proper).alias("malformed"))


def format_number(x: Column, digits: int = 6) -> Column:
    """A decimal's shortest text after rounding half to even: no exponent, no trailing zeros, no minus before zero."""
    t = F.format_string("%s", F.bround(x.cast(f"decimal(30,{digits + 6})"), digits).cast(f"decimal(30,{digits})").cast("string"))
    t = F.regexp_replace(F.regexp_replace(t, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(t == "-0", "0").otherwise(t)


def utf16_offset(text: Column, code_points: Column) -> Column:
    """The UTF-16 offset of a place counted in code points: characters beyond U+FFFF count twice."""
    head = F.left(text, code_points)
    return F.length(head) + F.length(head) - F.length(F.regexp_replace(head, r"[\x{10000}-\x{10FFFF}]", ""))


def uuid_text(digest: Column) -> Column:
    """32 hexadecimal digits as a name-based identifier: version 3, and the variant's bits set."""
    variant = F.element_at(F.array(*[F.lit(c) for c in "89ab"]), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1)
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("3"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))
