"""TeX source as its reader takes it: words without markup, with the document's own abbreviations written out."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

_DEFINED = re.compile(r"\\(?:(?:re)?newcommand|providecommand|DeclareRobustCommand|[gex]?def)\*?\s*\{?\s*\\([A-Za-z@]+)\s*\}?\s*((?:\[[^\]]*\]|#\d)*)\s*\{")
_HYPHEN = re.compile(r"(?<=[^\W\d_])\\?-[ \t]*%*[ \t]*\n[ \t]*%*[ \t]*(?=[^\W\d_])")
#: What follows these names is no text, or not for the reader.
_SILENT = re.compile(
    r"\\(?:[cC]ite[A-Za-z]*|[Cc]ref|ref|eqref|pageref|autoref|nameref|vref|label|nocite|bibitem|input|include|includegraphics|bibliography|bibliographystyle"
    r"|usepackage|documentclass|documentstyle|end|index|hspace|vspace|setlength|pagestyle|thispagestyle|href|textcolor|color|hypersetup)\*?\s*(?:\[[^\]]*\]\s*)*\{[^{}]*\}"
    r"|\\begin\s*\{[^{}]*\}(?:\[[^\]]*\])?(?:\{[lcrpmb|@\d.\s]*\})?"
    r"|\\(?:\\\*?|footnotemark|(?:no)?(?:line|page)break)(?:\[[^\]]*\])?"
)
_ACCENT = re.compile(r"\\(?:['`\"^~=.]\s*|[cvuHkrdbt](?=\{))\{?\\?([A-Za-z])\s?\}?")
_LETTER = re.compile(r"\\(ss|oe|OE|ae|AE|aa|AA|o|O|l|L|i|j)(?![A-Za-z])(?:\{\}|\s)?")
_FORMAT = re.compile(r"\\(?:text(?:bf|it|rm|sf|tt|sc|sl|up|md|normal)|emph|underline|mbox|hbox|uppercase|lowercase|math(?:rm|bf|it|sf|tt))\s*(?=\{)|\\(?:em|bf|it|rm|sf|tt|sc|sl|itshape|bfseries|scshape|upshape)(?![A-Za-z])[ \t]*")
_NOTHING = re.compile(r"\\[-/]|[{}]|\u00ad|\u200b")
_COMMAND = re.compile(r"\\(?:[A-Za-z@]+\*?|.)", re.S)
_WORD = re.compile(r"[^\W_]+").findall


def group_end(text: str, at: int) -> int:
    """Index after the brace that closes the group whose content begins at ``at``; the text's end if none does."""
    depth = 1
    while depth:
        m = _BRACE.search(text, at)
        if m is None:
            return len(text)
        at = m.end()
        if m.group() == "{":
            depth += 1
        elif m.group() == "}":
            depth -= 1
    return at


_BRACE = re.compile(r"\\.|[{}]", re.S)


def abbreviations(text: str) -> tuple[dict[str, str], set[str]]:
    """(name to text of macros without arguments, names of macros that only format an argument)."""
    words, formats = {}, set()
    for m in _DEFINED.finditer(text):
        body = text[m.end() : group_end(text, m.end()) - 1]
        if "#" in m.group(2) or "[" in m.group(2) or "#" in body:
            formats.add(m.group(1))
        else:
            words[m.group(1)] = body.replace("\\xspace", "")
    return words, formats


def words(text: str) -> list[str]:
    """The words of a TeX source: runs of letters or digits, in lower case and without accents.

    Line breaks, comment signs, punctuation, formatting commands, citations and references aren't words; a word
    broken by a hyphen at a line end is one; the document's abbreviations are written out; commented text counts.
    Null and empty texts have none; unclosed groups end with the text.
    """
    if not text:
        return []
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "-" in text:
        text = _HYPHEN.sub("", text)
    if "\\" in text:
        text = _plain(text)
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return _WORD(text.lower())


def _written_out(own: dict[str, str]) -> Callable[[str], str]:
    """A function that writes out the abbreviations in a text, and those within them at any depth; one that stands in
    itself stays where it does so."""
    use = re.compile(r"\\(" + "|".join(sorted(map(re.escape, own), key=len, reverse=True)) + r")(?![A-Za-z@])(\{\})?")
    whole: dict[str, str] = {}

    def put(text: str) -> str:
        return use.sub(lambda m: " " + whole[m.group(1)] + ("" if m.group(2) else " ") if m.group(1) in whole else m.group(), text)

    inner = {name: list(dict.fromkeys(m.group(1) for m in use.finditer(body))) for name, body in own.items()}
    for first in own:
        path = [] if first in whole else [first]
        open_now, at = set(path), dict.fromkeys(path, 0)
        while path:  # a stack of its own, as nesting may be deeper than calls may be
            name = path[-1]
            if at[name] < len(inner[name]):
                to = inner[name][at[name]]
                at[name] += 1
                if to not in whole and to not in open_now:
                    path.append(to)
                    open_now.add(to)
                    at[to] = 0
            else:
                whole[name] = put(own[name])
                open_now.remove(path.pop())
    return put


def _plain(text: str) -> str:
    own, formats = abbreviations(text)
    if own:
        text = _written_out(own)(text)
    text = _SILENT.sub(" ", text)
    text = _ACCENT.sub(r"\1", text)
    text = _LETTER.sub(r"\1", text)
    text = _FORMAT.sub("", text)
    if formats:
        text = re.sub(r"\\(?:" + "|".join(map(re.escape, formats)) + r")\s*(?=\{)", "", text)
    text = _NOTHING.sub("", text)
    return _COMMAND.sub(" ", text)
