"""Wiki and HTML markup, characters and words, as plain Python for use in Arrow batches.

Every pattern is bounded or free of backtracking, so that very long texts take
time in proportion to their length.
"""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache

#: Letters of other scripts that look like Latin ones, and the Latin ones.
LOOKALIKES = str.maketrans(
    "аеорсухіѕјһԁАВЕКМНОРСТУХοανρΟΑΒΕΗΚΜΝΡΤΧı",
    "aeopcyxisjhdABEKMHOPCTYXoavpOABEHKMNPTXi",
)
#: Letters that compatibility forms don't take apart.
SPELLED = {"æ": "ae", "œ": "oe", "ø": "o", "ß": "ss", "ł": "l", "đ": "d", "Æ": "ae", "Œ": "oe", "Ø": "o", "Ł": "l", "Đ": "d"}
_INLINE = "b|i|u|s|em|strong|span|small|big|sub|sup|font|mark|tt|del|ins|abbr|q|nowiki"

_foreign = re.compile(r"[^\x00-\x7f]+")
_comment = re.compile(r"<!--(.*?)-->", re.S)
_ref_alone = re.compile(r"<ref\b[^<>]*/>", re.I)
_ref = re.compile(r"<ref\b[^<>/]*>([^<]*(?:<(?!/ref)[^<]*)*)</ref\s*>", re.I)
_template = re.compile(r"\{\{([^{}]*)\}\}")
_link = re.compile(r"\[\[(?:[^\[\]|{}]*\|)*([^\[\]|{}]*)\]\]")
_shown = re.compile(r"\[\[(?:[^\[\]|]*\|)*([^\[\]|]*)\]\]")
_url = re.compile(r"\bhttps?://[^\s\]|]+")
_tag_inline = re.compile(rf"</?(?:{_INLINE})\b[^<>]*>", re.I)
_tag = re.compile(r"</?[a-zA-Z][^<>]*>")
_broken = re.compile(r"-(?<=\w-)[ \t]*\r?\n[ \t]*(?=\w)")
_grouped = re.compile(r",(?<=\d,)(?=\d)")
_dashes = re.compile(r"--+")
_named = re.compile(r"^\s*[\w -]{1,40}=(?!=)")
#: A letter or digit that has no plain Latin form.
OTHER = "\x1a"
_OPEN, _SHUT = "\x01", "\x02"  # around what a template or comment holds, while markup is taken away
#: From the bytes of a folded text to those of lower-case words, spaces and the two marks.
_WORDS = bytes(ord(chr(i).lower()) if chr(i).isalnum() or chr(i) in (OTHER, _OPEN, _SHUT) else 32 for i in range(128)) + b" " * 128
_marks = re.compile(b"([\x01\x02])")
_NEAR = 44  # words: the shortest stretch that shows a match, 39 words with 3 inserted, fits in so many on either side of a mark
_LEAST = 18  # words that a match has at least: 20 of which two are dropped
BREAK = b"\x1b"  # four of them stand between readings, more than a match may bridge


@lru_cache(maxsize=65536)
def _fold_run(run: str) -> str:
    run = unicodedata.normalize("NFKD", "".join(SPELLED.get(c, c) for c in run)).translate(LOOKALIKES)
    out = []
    for c in run:
        kind = unicodedata.category(c)
        if c.isascii():
            out.append(c)
        elif c in "\u2019\u2018\u02bc\u2032":
            out.append("'")
        elif c in "\u2010\u2011":
            out.append("-")
        elif kind not in ("Mn", "Me", "Cf"):
            out.append(OTHER if kind[0] in "LN" else " ")
    return "".join(out)


def fold(text: str) -> str:
    """The text in ASCII: no accents, no invisible marks, plain Latin forms, ``OTHER`` for what has none."""
    if text.isascii() or (text := text.replace("\u2014", " ")).isascii():
        return text
    return _foreign.sub(lambda m: _fold_run(m[0]), text)


def _readings(marked: bytes) -> list[bytes]:
    """The words of all readings of a text in which marks enclose what templates and comments hold.

    First the text without it; then each enclosed piece by itself, without what it
    encloses in turn; then the words around every mark with everything in its
    place. A match lies in one of them whole: outside the marks, within a pair, or
    across a mark and so near it.
    """
    base: list[bytes] = []
    stack, parts, flat, marks = [base], [], [], []
    for i, piece in enumerate(_marks.split(marked)):
        if i % 2 == 0:
            words = piece.split()
            flat += words
            stack[-1] += words
        elif piece == _OPEN.encode():
            marks.append(len(flat))
            stack.append([])
        elif len(stack) > 1:
            marks.append(len(flat))
            parts.append(stack.pop())
    out = base
    for part in [*parts, *stack[1:]]:
        if len(part) >= _LEAST:
            out += [BREAK] * 4 + part
    end = 0
    for at in marks:
        low, high = max(end, at - _NEAR), min(len(flat), at + _NEAR)
        if high > low:
            if low > end or not end:
                out += [BREAK] * 4
            out += flat[low:high]
            end = high
    return out


def flat_words(text: str) -> list[bytes]:
    """The words of a text with its markup taken away, in ASCII and lower case, for comparison.

    Links are what they show. References vanish from running text; what they hold
    is kept at the end. Templates and comments are read in three ways, see
    ``_readings``: as nothing, by themselves, and in their place. Hyphens and
    apostrophes join, as does a hyphen at a line's end.
    """
    t = fold(html.unescape(text) if "&" in text else text)
    if _OPEN in t or _SHUT in t:
        t = t.replace(_OPEN, " ").replace(_SHUT, " ")
    aside: list[str] = []

    def drop(m: re.Match) -> str:
        aside.append(m[1])
        return " "

    def mark(m: re.Match) -> str:
        return f" {_OPEN} {m[1]} {_SHUT} "

    def mark_template(m: re.Match) -> str:
        held = " ".join(_named.sub("", arg) for arg in m[1].split("|")[1:])
        return f" {_OPEN} {held} {_SHUT} " if held.strip() else " "

    if "<ref" in t or "<REF" in t:
        t = _ref.sub(drop, _ref_alone.sub(" ", t))
        t = "".join([t, *(f" {_OPEN} {x} {_SHUT} " for x in aside if len(x) >= 2 * _LEAST - 1)])
    if "<!--" in t:
        t = _comment.sub(mark, t)
    if "[[" in t:
        t = _link.sub(r"\1", t)
    while "{{" in t:
        t, n = _template.subn(mark_template, t)
        if not n:
            break
    if "[[" in t:
        t = _shown.sub(r"\1", t)
    if "://" in t:
        t = _url.sub(" ", t)
    if "<" in t:
        t = _tag.sub(" ", _tag_inline.sub("", t))
    if "-" in t:
        t = _dashes.sub(" ", _broken.sub("", t))
    if "," in t:
        t = _grouped.sub("", t)
    plain = t.encode("ascii").translate(_WORDS, b"'-")
    return _readings(plain) if _OPEN in t else plain.split()
