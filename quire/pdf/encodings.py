"""Simple encodings, glyph names and the widths of the standard fonts, by the characters that they stand for."""

from __future__ import annotations

import re
import unicodedata

#: Glyph names of characters that aren't named after themselves, in the order of ASCII.
NAMES = dict(zip("space exclam quotedbl numbersign dollar percent ampersand quotesingle parenleft parenright asterisk plus comma hyphen period slash zero one two three four five six seven eight nine colon semicolon less equal greater question at bracketleft backslash bracketright asciicircum underscore grave braceleft bar braceright asciitilde".split(), " !\"#$%&'()*+,-./0123456789:;<=>?@[\\]^_`{|}~", strict=True))
#: Names of signs and letters beyond ASCII.
NAMES |= dict(zip(
    "fi fl ff ffi ffl endash emdash bullet quoteleft quoteright quotedblleft quotedblright quotesinglbase quotedblbase guilsinglleft guilsinglright guillemotleft guillemotright ellipsis germandbls minus Euro dagger daggerdbl fraction florin perthousand".split(),
    "ﬁﬂﬀﬃﬄ–—•‘’“”‚„‹›«»…ß−€†‡⁄ƒ‰", strict=True,
))
NAMES |= dict(zip(
    "exclamdown questiondown cent sterling currency yen brokenbar section copyright ordfeminine logicalnot registered degree plusminus mu paragraph periodcentered ordmasculine onequarter onehalf threequarters onesuperior twosuperior threesuperior multiply divide trademark".split(),
    "¡¿¢£¤¥¦§©ª¬®°±µ¶·º¼½¾¹²³×÷™", strict=True,
))
NAMES |= dict(zip("AE ae OE oe Oslash oslash Lslash lslash Eth eth Thorn thorn Dcroat dcroat Hbar hbar dotlessi Eng eng kgreenlandic longs IJ ij".split(), "ÆæŒœØøŁłÐðÞþĐđĦħıŊŋĸſĲĳ", strict=True))
NAMES |= dict(zip("acute circumflex tilde dieresis ring cedilla caron macron breve ogonek dotaccent hungarumlaut".split(), "´ˆ˜¨˚¸ˇ¯˘˛˙˝", strict=True))
NAMES |= dict(zip(
    "notequal infinity lessequal greaterequal partialdiff summation product pi integral Omega radical approxequal Delta lozenge universal existential suchthat asteriskmath congruent therefore perpendicular similar proportional equivalence element notelement propersubset propersuperset reflexsubset reflexsuperset notsubset union intersection emptyset angle gradient logicaland logicalor".split(),
    "≠∞≤≥∂∑∏π∫Ω√≈∆◊∀∃∋∗≅∴⊥∼∝≡∈∉⊂⊃⊆⊇⊄∪∩∅∠∇∧∨", strict=True,
))
NAMES |= dict(zip("arrowleft arrowup arrowright arrowdown arrowboth arrowdblleft arrowdblup arrowdblright arrowdbldown arrowdblboth club diamond heart spade minute second aleph Ifraktur Rfraktur weierstrass circlemultiply circleplus dotmath theta1 sigma1 omega1 phi1 Upsilon1 carriagereturn angleleft angleright".split(), "←↑→↓↔⇐⇑⇒⇓⇔♣♦♥♠′″ℵℑℜ℘⊗⊕⋅ϑςϖϕϒ↵〈〉", strict=True))
#: Accents in glyph names and their combining characters.
ACCENTS = {"grave": "̀", "acute": "́", "circumflex": "̂", "tilde": "̃", "dieresis": "̈", "ring": "̊", "cedilla": "̧", "caron": "̌", "macron": "̄", "breve": "̆", "ogonek": "̨", "dotaccent": "̇", "hungarumlaut": "̋", "commaaccent": "̦", "tonos": "́"}
#: Scripts that end a name, and how Unicode calls their letters.
SCRIPTS = {"hebrew": "HEBREW LETTER", "arabic": "ARABIC LETTER", "cyrillic": "CYRILLIC SMALL LETTER", "hiragana": "HIRAGANA LETTER", "katakana": "KATAKANA LETTER", "armenian": "ARMENIAN SMALL LETTER", "deva": "DEVANAGARI LETTER", "thai": "THAI CHARACTER", "bopomofo": "BOPOMOFO LETTER"}


def _cyrillic() -> dict[str, str]:
    """afii10017 to afii10049 are the capitals from А on with Ё after Е, afii10065 to afii10097 the small letters."""
    out = {}
    for first, start, yo in ((10017, 0x410, "Ё"), (10065, 0x430, "ё")):
        letters = [chr(start + k) for k in range(32)]
        letters.insert(6, yo)
        out |= {f"afii{first + k}": c for k, c in enumerate(letters)}
    return out


CYRILLIC = _cyrillic()


def _by_unicode(name: str) -> str | None:
    try:
        return unicodedata.lookup(name)
    except KeyError:
        return None


def name_text(name: str) -> str | None:
    """The text that a glyph name stands for: by itself, by its code, by a letter and an accent, or by Unicode's name of a letter."""
    name = name.split(".")[0]
    if not name:  # as of .notdef
        return None
    if name in NAMES or name in CYRILLIC:
        return NAMES.get(name) or CYRILLIC[name]
    if len(name) == 1:
        return name
    if m := re.fullmatch(r"uni((?:[0-9A-F]{4})+)", name):
        parts = [int(m[1][k : k + 4], 16) for k in range(0, len(m[1]), 4)]
        return None if any(0xD800 <= p < 0xE000 for p in parts) else "".join(map(chr, parts))
    if m := re.fullmatch(r"u([0-9A-F]{4,6})", name):
        code = int(m[1], 16)
        return chr(code) if code < 0xD800 or 0xDFFF < code <= 0x10FFFF else None
    if "_" in name:
        return "".join(parts) if all(parts := [name_text(x) for x in name.split("_")]) else None
    if m := re.fullmatch(r"([A-Za-z]|[A-Z]?[a-z]+?)(" + "|".join(ACCENTS) + ")", name):
        letter = m[1] if len(m[1]) == 1 else name_text(m[1])
        if letter:
            return unicodedata.normalize("NFC", letter + ACCENTS[m[2]])
    greek = "LAMDA" if name.lower() == "lambda" else name.upper()
    if found := _by_unicode(f"GREEK {'CAPITAL' if name[0].isupper() else 'SMALL'} LETTER {greek}"):
        return found
    for end, letters in SCRIPTS.items():
        if name.endswith(end) and (found := _by_unicode(f"{letters} {name[: -len(end)].upper()}") or (_by_unicode(f"{letters} {name[5 : -len(end)].upper()}") if name.startswith("small") else None)):
            return found
    return None


def _table(upper: dict[int, str], lower: str = "".join(map(chr, range(32, 127)))) -> dict[int, str]:
    out = {32 + k: c for k, c in enumerate(lower) if c != "\0"}
    for start, chars in upper.items():
        out |= {start + k: c for k, c in enumerate(chars) if c != "\0"}
    return out


#: The standard encoding beyond ASCII, runs of characters by their first code; \0 is no character.
STANDARD = _table({0x27: "’", 0x60: "‘", 0xA1: "¡¢£⁄¥ƒ§¤'“«‹›ﬁﬂ\0–†‡·\0¶•‚„”»…‰\0¿\0`´ˆ˜¯˘˙¨\0˚¸\0˝˛ˇ—", 0xE1: "Æ\0ª", 0xE8: "ŁØŒº", 0xF1: "æ", 0xF5: "ı", 0xF8: "łøœß"})
WIN = {c: bytes([c]).decode("cp1252", "replace") for c in range(32, 256)} | dict.fromkeys((0x7F, 0x81, 0x8D, 0x8F, 0x90, 0x9D), "•") | {0xA0: " ", 0xAD: "-"}
MAC = {c: bytes([c]).decode("mac_roman") for c in range(32, 256) if c != 127} | {0xCA: " ", 0xDB: "¤"}
#: The encodings of the symbol font and of the dingbats.
SYMBOL = _table(
    {0xA0: "€ϒ′≤⁄∞ƒ♣♦♥♠↔←↑→↓°±″≥×∝∂•÷≠≡≈…⏐⎯↵ℵℑℜ℘⊗⊕∅∩∪⊃⊇⊄⊂⊆∈∉∠∇®©™∏√⋅¬∧∨⇔⇐⇑⇒⇓◊〈®©™∑⎛⎜⎝⎡⎢⎣⎧⎨⎩⎪\0〉∫⌠⎮⌡⎞⎟⎠⎤⎥⎦⎫⎬⎭"},
    " !∀#∃%&∋()∗+,−./0123456789:;<=>?≅ΑΒΧΔΕΦΓΗΙϑΚΛΜΝΟΠΘΡΣΤΥςΩΞΨΖ[∴]⊥_‾αβχδεφγηιϕκλμνοπθρστυϖωξψζ{|}∼",
)
DINGBATS = {0x20: " "} | {c: chr(0x2701 + c - 0x21) for c in range(0x21, 0x7F)} | {c: chr(0x2761 + c - 0xA1) for c in range(0xA1, 0xA8)}
DINGBATS |= dict(zip((0x25, 0x2A, 0x2B, 0x48, 0x6C, 0x6E, 0x73, 0x74, 0x75, 0x77), "☎☛☞★●■▲▼◆◗", strict=True)) | dict(zip(range(0xA8, 0xAC), "♣♦♥♠", strict=True))
DINGBATS |= {0xAC + k: chr(0x2460 + k) for k in range(10)} | {0xB6 + k: chr(0x2776 + k) for k in range(30)} | dict(zip(range(0xD4, 0xD8), "➔→↔↕", strict=True))
DINGBATS |= {c: chr(0x2798 + c - 0xD8) for c in range(0xD8, 0xFF) if c != 0xF0}
ENCODINGS = {b"StandardEncoding": STANDARD, b"WinAnsiEncoding": WIN, b"MacRomanEncoding": MAC}

#: Widths of the characters from space to tilde in the six proportional Latin fonts of the standard 14.
LATIN = {
    "Helvetica": "278 278 355 556 556 889 667 191 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 278 278 584 584 584 556 1015 667 667 722 722 667 611 778 722 278 500 667 556 833 722 778 667 778 722 667 611 722 667 944 667 667 611 278 278 278 469 556 333 556 556 500 556 556 278 556 556 222 222 500 222 833 556 556 556 556 333 500 278 556 500 722 500 500 500 334 260 334 584",
    "Helvetica-Bold": "278 333 474 556 556 889 722 238 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 333 333 584 584 584 611 975 722 722 722 722 667 611 778 722 278 556 722 611 833 722 778 667 778 722 667 611 722 667 944 667 667 611 333 278 333 584 556 333 556 611 556 611 556 333 611 611 278 278 556 278 889 611 611 611 611 389 556 333 611 556 778 556 556 500 389 280 389 584",
    "Times-Roman": "250 333 408 500 500 833 778 180 333 333 500 564 250 333 250 278 500 500 500 500 500 500 500 500 500 500 278 278 564 564 564 444 921 722 667 667 722 611 556 722 722 333 389 722 611 889 722 722 556 722 667 556 611 722 722 944 722 722 611 333 278 333 469 500 333 444 500 444 500 444 333 500 500 278 278 500 278 778 500 500 500 500 333 389 278 500 500 722 500 500 444 480 200 480 541",
    "Times-Bold": "250 333 555 500 500 1000 833 278 333 333 500 570 250 333 250 278 500 500 500 500 500 500 500 500 500 500 333 333 570 570 570 500 930 722 667 722 722 667 611 778 778 389 500 778 667 944 722 778 611 778 722 556 667 722 722 1000 722 722 667 333 278 333 581 500 333 500 556 444 556 444 333 500 556 278 333 556 278 833 556 500 556 556 444 389 333 556 500 722 500 500 444 394 220 394 520",
    "Times-Italic": "250 333 420 500 500 833 778 214 333 333 500 675 250 333 250 278 500 500 500 500 500 500 500 500 500 500 333 333 675 675 675 500 920 611 611 667 722 611 611 722 722 333 444 667 556 833 667 722 611 722 611 500 556 722 611 833 611 556 556 389 278 389 422 500 333 500 500 444 500 444 278 500 500 278 278 444 278 722 500 500 500 500 389 389 278 500 444 667 444 444 389 400 275 400 541",
    "Times-BoldItalic": "250 389 555 500 500 833 778 278 333 333 500 570 250 333 250 278 500 500 500 500 500 500 500 500 500 500 333 333 570 570 570 500 832 667 667 667 722 667 667 722 778 389 500 667 611 889 722 722 611 722 667 556 611 722 667 889 667 611 611 333 278 333 570 500 333 500 500 444 500 444 333 500 556 278 278 500 278 778 556 500 500 500 389 389 278 556 444 667 500 444 389 348 220 348 570",
}
#: Widths of further characters in the same six fonts.
MORE = {
    "‘’‚": "222 278 333 333 333 333", "“”„": "333 500 444 500 556 500", "–": "556 556 500 500 500 500", "—…": "1000 1000 1000 1000 889 1000", "•": "350 350 350 350 350 350", "ﬁﬂ": "500 611 556 556 500 556", "ß": "611 611 500 556 500 500",
    "Æ": "1000 1000 889 1000 889 944", "æ": "889 889 667 722 667 722", "Œ": "1000 1000 889 1000 944 944", "œ": "944 944 722 722 667 722", "Ø": "778 778 722 778 722 722", "ø": "611 611 500 500 500 500", "ı": "278 278 278 278 278 278",
    "¡": "333 333 333 333 389 389", "¿": "611 611 444 500 500 500", "¢£¥¤§€ƒ†‡«»": "556 556 500 500 500 500", "⁄": "167 167 167 167 167 167", "‹›": "333 333 333 333 333 333", "·": "278 278 250 250 250 250", "¶": "537 556 453 540 523 500",
    "‰": "1000 1000 1000 1000 1000 1000", "©®": "737 737 760 747 760 747", "™": "1000 1000 980 1000 980 1000", "°": "400 400 400 400 400 400", "±×÷": "584 584 564 570 675 570", "−¬": "584 584 564 570 675 606", "µ": "556 611 500 556 500 576",
    "¹²³": "333 333 300 300 300 300", "ª": "370 370 276 300 276 266", "º": "365 365 310 330 310 300", "¼½¾": "834 834 750 750 750 750", "Ð": "722 722 722 722 722 722", "ð": "556 611 500 500 500 500", "Þ": "667 667 556 611 611 611", "þ": "556 611 500 556 500 500",
    "¦": "260 280 200 220 275 220", "Ł": "556 611 611 667 556 611", "ł": "222 278 278 278 278 278", "´ˆ˜¨˚¸ˇ¯˘˙˝": "333 333 333 333 333 333", "íìîï": "278 278 278 278 278 278",
}
#: The standard fonts whose widths are those of another.
SAME = {"Helvetica-Oblique": "Helvetica", "Helvetica-BoldOblique": "Helvetica-Bold"}
#: Widths of the symbol font's codes from 0x20 to 0x7E, and from 0xA0 to 0xFE.
SYMBOL_WIDTHS = (
    "250 333 713 500 549 833 778 439 333 333 500 549 250 549 250 278 500 500 500 500 500 500 500 500 500 500 278 278 549 549 549 444 549 722 667 722 612 611 763 603 722 333 631 722 686 889 722 722 768 741 556 592 611 690 439 768 645 795 611 333 863 333 658 500 500 631 549 549 494 439 521 411 603 329 603 549 549 576 521 549 549 521 549 603 439 576 713 686 493 686 494 480 200 480 549",
    "750 620 247 549 167 713 500 753 753 753 753 1042 987 603 987 603 400 549 411 549 549 713 494 460 549 549 549 549 1000 603 1000 658 823 686 795 987 768 768 823 768 768 713 713 713 713 713 713 713 768 713 790 790 890 823 549 250 713 603 603 1042 987 603 987 603 494 329 790 790 786 713 384 384 384 384 384 384 494 494 494 494 0 329 274 686 686 686 384 384 384 384 384 384 494 494 494",
)
STANDARD_14 = {*LATIN, *SAME, "Courier", "Courier-Bold", "Courier-Oblique", "Courier-BoldOblique", "Symbol", "ZapfDingbats"}


def standard_width(font: str, code: int, text: str | None) -> float | None:
    """The width of a character in a standard font; an accented letter is as wide as its letter."""
    if font.startswith("Courier"):
        return 600.0 if text else None
    if font == "Symbol":
        half, k = divmod(code - 0x20, 0x80)
        each = SYMBOL_WIDTHS[half].split() if half in (0, 1) else []
        return float(each[k]) if k < len(each) else None
    font = SAME.get(font, font)
    if font not in LATIN or not text or len(text) > 1:
        return None
    place = list(LATIN).index(font)
    for chars, widths in MORE.items():
        if text in chars:
            return float(widths.split()[place])
    letter = unicodedata.normalize("NFD", text)[0]
    return float(LATIN[font].split()[ord(letter) - 32]) if " " <= letter <= "~" else None


def built_in(subtype: bytes, name: str, nonsymbolic: bool, described: bool) -> dict[int, str]:
    """The encoding that a font has of its own, as far as it is known without its program."""
    if subtype == b"Type3":
        return {}
    if subtype != b"TrueType" and name in ("Symbol", "ZapfDingbats"):
        return SYMBOL if name == "Symbol" else DINGBATS
    return STANDARD if nonsymbolic or (not described and name in STANDARD_14) else {}
