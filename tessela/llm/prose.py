"""Running English prose out of wiki text: what is left without tables, templates, lists, references, code and junk."""

from __future__ import annotations

import html
import re

from tessela.llm.markup import OTHER, fold

#: Common English function words; a unit of prose is told by its share of them.
FUNCTION_WORDS = frozenset(
    b"""a about above across after against all along alongside although among an and another any are around as at
    away be because become been before began behind being below beneath beside between beyond both but by came can
    concerning could despite did do does done down during each either every few first following for from had has have he
    her here him his how however i if in insofar instead into is it its last later least less many may might more most much must
    near neither no nor not notwithstanding now of off often on once one only onto or other our out over own past per
    said same shall she should since so some soon still such than that the their them then there thereby therefore these they
    this those though through throughout thus to together too toward towards two under unless until up upon us was we
    were what when where whereas whereby wherein whether which while who whom whose why will with within without would yet you
    your""".split()
)
_CAPITALS = bytes(range(65, 91))
LEAST_SHARE = 0.18  # of function words in a unit of English prose
LEAST_UNIT = 4  # words of a unit of prose

_comment = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_block = re.compile(
    r"<(syntaxhighlight|source|code|pre|math|gallery|timeline|score|imagemap|noinclude|includeonly)\b[^<>]*(?<!/)>.*?(?:</\1\s*>|\Z)", re.S | re.I
)
_ref = re.compile(r"<ref\b[^<>]*/>|<ref\b[^<>]*>[^<]*(?:<(?!/ref)[^<]*)*</ref\s*>", re.I)
_template = re.compile(r"\{\{[^{}]*\}\}|\{\{\{[^{}]*\}\}\}")
_table = re.compile(r"^[ \t]*\{\|(?:(?!^[ \t]*\{\|).)*?^[ \t]*\|\}", re.S | re.M)
_link = re.compile(r"\[\[(?:([a-zA-Z -]{2,12}):)?(?:[^\[\]|]*\|)*([^\[\]|]*)\]\]")
_url = re.compile(r"\[?\bhttps?://[^\s\]]+([^\[\]]*)\]?")
_tag = re.compile(r"</?[a-zA-Z][^<>]*>")
_quotes = re.compile(r"'{2,}")
_not_prose = re.compile(r"^[ \t]*(?:[*#:;|!=]|\{|\}|__|-{4}|&lt;|<)")
_end = re.compile(r"[.!?;][\"')\]]*\s+(?=[\"'(\[]*[A-Z0-9])")
_initial = re.compile(r"(?:\b[A-Z]|\b(?:c|vol|no|No|p|pp|cf|ca|St|Mr|Mrs|Dr|vs|etc|e\.g|i\.e))\.$")
#: From the bytes of a folded text to those of lower-case words and spaces.
_WORDS = bytes(ord(chr(i).lower()) if chr(i).isalpha() or chr(i) == OTHER else 32 for i in range(128)) + b" " * 128


def plain(text: str) -> list[str]:
    """The lines of a text that may be prose, without markup."""
    t = fold(html.unescape(text) if "&" in text else text)
    if "<!--" in t:
        t = _comment.sub(" ", t)
    if "<" in t:
        t = _ref.sub(" ", _block.sub("\n", t))
    while "{{" in t:
        t, n = _template.subn(" ", t)
        if not n:
            break
    if "{|" in t:
        t = _table.sub("\n", t)
    if "[[" in t:
        t = _link.sub(lambda m: "" if m[1] else m[2], t)
    if "://" in t:
        t = _url.sub(r"\1", t)
    if "<" in t:
        t = _tag.sub(" ", t)
    if "''" in t:
        t = _quotes.sub("", t)
    return [line for line in t.splitlines() if line.strip() and not _not_prose.match(line)]


def sentences(line: str) -> list[str]:
    """The sentences of a line; initials and abbreviations don't end one."""
    out: list[str] = []
    start = 0
    for m in _end.finditer(line):
        if m[0][0] == "." and _initial.search(line, max(start, m.start() - 6), m.start() + 1):
            continue
        out.append(line[start : m.end()])
        start = m.end()
    out.append(line[start:])
    return out


def prose(text: str) -> list[list[bytes]]:
    """The sentences of English prose in a text, as words in lower case.

    A sentence is English prose if enough of its words are function words and it
    isn't mostly capitals. Links and emphasis don't matter; junk between sentences falls out by itself.
    """
    found = []
    for line in plain(text):
        for sentence in sentences(line):
            raw = sentence.encode("ascii")
            words = raw.translate(_WORDS, b"'-").split()
            if len(raw) - len(raw.translate(None, _CAPITALS)) > 0.4 * len(raw):
                continue  # shouting
            if len(words) >= LEAST_UNIT and sum(map(FUNCTION_WORDS.__contains__, words)) >= LEAST_SHARE * len(words):
                found.append(words)
    return found
