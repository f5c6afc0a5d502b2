"""Words of a text under disguises that vandals use."""

from __future__ import annotations

import html
import re
import unicodedata

import regex

# Letters of other scripts that look like Latin ones, and digits or signs that stand for letters.
LOOKALIKES = {"а": "a", "в": "b", "с": "c", "е": "e", "ё": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x"}
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "€": "e", "|": "l"}

_LOOKALIKE = str.maketrans(LOOKALIKES)
_LEET = str.maketrans(LEET)
_MARKUP = re.compile(r"'{2,}|<!--|-->|</?(?:b|i|u|s|em|strong|span|small|big|sup|sub|nowiki)\b[^<>]*>")
_LINK = re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]")
_SPACED = re.compile(r"(?<![^\W_])[^\W\d_]([ _.\-])[^\W\d_](?:\1[^\W\d_])+[_.]?(?![^\W_])")
_SEPARATORS = re.compile(r"[ _.\-]")
#: Letters of scripts without blanks between words are words of their own.
_WORD = re.compile(r"[぀-ヿ㐀-鿿]|[@$]?[^\W_぀-ヿ㐀-鿿]+(?:[@$*€!]+[^\W_぀-ヿ㐀-鿿]+)*[*$@]*")
_ASCII_WORD = re.compile(r"[@$]?[a-z0-9]+(?:[@$*!]+[a-z0-9]+)*[*$@]*")
_RUN = re.compile(r"(.)\1{2,}")
_LATIN = re.compile(r"[a-z]")
_CYRILLIC_OR_GREEK = re.compile(r"[Ͱ-ϿЀ-ӿ]")
_HAS_SIGN = re.compile(r"[0-9@$!€]")
_UNSEEN = regex.compile(r"[\p{Mn}\p{Me}\p{Cf}]+")


def plain_word(w: str) -> str:
    """A word without look-alike letters, digits in place of letters and drawn-out letters; ``#`` for a number."""
    if w.isdigit():
        return "#"
    if not w.isascii() and _LATIN.search(w) and _CYRILLIC_OR_GREEK.search(w):
        w = w.translate(_LOOKALIKE)
    if _HAS_SIGN.search(w) and _LATIN.search(w):
        head = w.rstrip("!")
        w = head.translate(_LEET)
    return _RUN.sub(r"\1", w)


def raw_words(text: str | None) -> list[str]:
    """Words of a text, of its comments and templates too, before :func:`plain_word`; links give their label. Null gives none."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    text = _LINK.sub(r"\1", _MARKUP.sub("", text))
    if text.isascii():
        return _ASCII_WORD.findall(_SPACED.sub(_joined, text.lower()))
    text = _UNSEEN.sub("", unicodedata.normalize("NFKD", text).casefold())
    return _WORD.findall(_SPACED.sub(_joined, text))


def _joined(m: re.Match) -> str:
    return _SEPARATORS.sub("", m.group())


def tokens(text: str | None) -> list[str]:
    """Words of a text in plain form."""
    return [plain_word(w) for w in raw_words(text)]
