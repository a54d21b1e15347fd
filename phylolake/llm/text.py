"""Clean-up of raw text that several operators share."""

from __future__ import annotations

import html
import re
import unicodedata

# Letters of other scripts that look like Latin ones, and the Latin letters they stand for.
LOOKALIKES = str.maketrans(
    "асеорхуіјѕԁԛԝһкмтвнАВЕКМНОРСТХУІЈЅαοενρτυικ",
    "aceopxyijsdqwhkmtbhABEKMHOPCTXYIJSaoevptuik",
)
INVISIBLE = re.compile("[­​-‏⁠﻿\x00-\x08\x0b\x0e-\x1f\x7f]")
CONTROLS = bytes([*range(9), 11, *range(14, 32), 127])
INLINE_TAG = re.compile(r"</?(?:i|b|u|em|strong|a|span|sup|sub|code|font|mark|small)\b[^<>]*>", re.I)
ANY_TAG = re.compile(r"<[/!]?[A-Za-z][^<>]*>|<!--.*?-->", re.S)
WRONGLY_DECODED = re.compile("[Â-ô][\u0080-ÿŒ-Ÿƒˆ˜–-™]{1,3}")
BROKEN_WORD = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n[ \t]*(?=[^\W\d_])")
WORD = re.compile(r"[^\W_]+")
COMBINING = re.compile("[" + "".join(c for c in map(chr, range(0x300, 0x20000)) if unicodedata.combining(c)) + "]+")


def _redecode(m: re.Match) -> str:
    for codec in ("cp1252", "latin-1"):
        try:
            return m.group(0).encode(codec).decode("utf-8")
        except UnicodeError:
            continue
    return m.group(0)


def readable(text: str) -> str:
    """Text without markup, invisible characters, wrong decodings and look-alike letters."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = ANY_TAG.sub(" ", INLINE_TAG.sub("", text))
    if not text.isascii():
        text = WRONGLY_DECODED.sub(_redecode, text)
        text = unicodedata.normalize("NFKC", INVISIBLE.sub("", text)).translate(LOOKALIKES)
    else:
        text = text.encode("ascii").translate(None, CONTROLS).decode("ascii")
    return BROKEN_WORD.sub("", text) if "-" in text and "\n" in text else text


def fold(text: str) -> str:
    """Case-folded text without accents."""
    text = text.casefold()
    if text.isascii():
        return text
    return COMBINING.sub("", unicodedata.normalize("NFKD", text))


def words(text: str | None) -> list[str]:
    """Folded words of a text; null and empty texts have none."""
    return WORD.findall(fold(readable(text))) if text else []
