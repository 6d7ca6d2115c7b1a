"""Candidates for personal information in TeX source: where e-mail addresses, numbers, streets and names may stand.

Candidates are found by form alone and with their exact ends; whether one is personal, and of which kind, is
decided by the random field in ``privacy``.
"""

from __future__ import annotations

import re
import unicodedata

KINDS = ("none", "email", "phone", "id_number", "address", "name")

# Given names of many languages, in lower case without accents.
GIVEN = frozenset(
    """aino alan alice amara ana anders andre andrea andrei anja anna anneke anselm antonio arjun astrid beatriz ben bjorn
    birgit bruno carla carlos carmen caroline charles chen chiara chloe claire clara claudia daniel david declan diego
    dmitri dorothea dragan edwin eero elena elif elisa elizabeth emma emre eric erik ethan etienne eszter eva farid fatima
    felix fiona francesca francois frank fumiko gabor george giovanni giulia grace greta gunther hana hannah hans haruka
    hassan helen helene henry hiroshi hugo ibrahim ines ingrid irina isabel ivan ivo jack james jan jane javier jean jens
    joana johan john jose joseph juan judith julia jurgen karl kate kenji kofi konrad laura lars leila lena leo li
    lieselotte linda lucas lucia luigi luis lukas magnus marco margaux maria marie mark marta martin mary mateo matthias
    mehmet mei michael miguel milena mohammed monika nadia nathaniel nina noor odile olga oliver omar paolo patrick paul
    pavel pedro peter petra pierre priya prudence rafael raj renee richard robert rosa rui rupert samuel sara selin sergei
    signe simone siobhan sofia soren stefan susan sven takeshi tariq thibault thomas tomas tunde viktor wei willem yuki
    yusuf zainab zoe""".split()
)

_GAP = r"(?:[ ~]|[ \t]*\r?\n%*[ \t]*)"
_LOCAL = re.compile(r"(?:[A-Za-z0-9](?:[\w.+\-]|\\[_+.\-]|\{[_]\})*)\Z")
_AT = re.compile(r"(?:\\|\$|\{)?@(?:\$|\})?|\s?[\[({<]\s?[aA][tT]\s?[\])}>]\s?|[ ~](?:at|AT)[ ~](?=[\w\-]+(?:\.[\w\-]|[ ~][(\[]?(?:dot|DOT)))")
_DOT = r"(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?|[ ~]dot[ ~])"
_DOMAIN = re.compile(r"[A-Za-z0-9][A-Za-z0-9\-]*(?:" + _DOT + r"[A-Za-z0-9][A-Za-z0-9\-]*)*" + _DOT + r"[A-Za-z]{2,}(?![A-Za-z0-9])", re.I)

_SEP = r"(?:[ .\-/~]|\\[, ]|[ ]?-[ ]?|~?\r?\n%*[ ]?)"
_NUMBER = re.compile(r"(?<![\w.\\])(?:\+?\d{8,15}(?!\w)(?![.\-/]\d)|(?:\+?\(?\d+\)?)(?:(?:" + _SEP + r"\(?|\(|(?<=\)))\d+\)?){1,7}X?(?![\w]))")
_CODE = re.compile(r"(?<![\w.\-])[A-Z]{1,4}-?\d{5,}(?:[/\-]\d+)*(?![\w])")
_BIBLIO = re.compile(r"\((?:1[89]|20)\d\d\)")

# Letters of the alphabets with capitals, from the tables of characters.
_ALPHABETS = [chr(c) for c in (*range(0x00C0, 0x0250), *range(0x0370, 0x0530), *range(0x1E00, 0x1F00))]
_UPPER, _LOWER = ("".join(c for c in _ALPHABETS if test(c)) for test in (str.isupper, str.islower))
_CAP = r"(?:[A-Z" + _UPPER + r"]|\\['`\"^~.=]\{?[A-Z]\}?|\\[cvuHkrd]\{[A-Z]\}|\{?\\(?:OE|AE|AA|O|L)(?![A-Za-z])(?:\}|\{\})?)"
_LOW = r"(?:[A-Za-z" + _UPPER + _LOWER + r"]|\\['`\"^~=.](?:\{[A-Za-z]\}|[A-Za-z])|\{\\['`\"^~=.]\{?[A-Za-z]\}?\}|\{\\(?:o|ss|ae|aa|oe|l|O|AE|AA)\}|\\(?:o|ss|ae|aa|oe|l)\{\}|\\[cvuHkrd]\{[A-Za-z]\}|'(?=[A-Z" + _UPPER + r"]))"
_CAPITAL = _CAP + _LOW + "+"
_STREET = (
    r"(?:street|st\.|road|rd\.|avenue|ave\.|lane|ln\.|drive|dr\.|boulevard|blvd\.|square|sq\.|terrace|crescent|close|court|place|way|row|hill|gardens|parade|walk)"
)
_SUFFIX = r"(?:stra(?:ss|ß|\{\\ss\}|\\ss\{\}|\\ss )e|str\.|weg|gasse|platz|allee|damm|ufer|gatan?|v(?:ä|\\\"a)gen|vej|laan|straat|gracht|katu|tie)"
_HOUSE = re.compile(r"(?<![\w.\-/])\d{1,5}[A-Za-z]?(?=[,~\s}.;)]|\Z)")
#: A street after its number, from the number on, and one before its number, up to the number.
_AFTER = re.compile(
    rf",?{_GAP}(?:"
    rf"(?i:rue|boulevard|bd\.|quai|place|avenue|chemin|impasse|all(?:é|\\'e)e|via|calle|rua){_GAP}(?:(?i:de|du|des|del|da|do|di){_GAP}(?:(?i:la){_GAP}|[lL]')?|[dD]')?{_CAPITAL}(?:[\-]{_CAPITAL})*"
    rf"|{_CAPITAL}(?:{_GAP}{_CAPITAL}){{0,2}}?{_GAP}(?i:{_STREET})(?![A-Za-z]))"
)
_BEFORE = re.compile(
    rf"(?:(?<![A-Za-z])(?i:calle|via|viale|piazza|rua|avenida|avda\.|plaza|paseo|ulica|ul\.|rue){_GAP}(?:(?i:de|del|di|da|do|la){_GAP}){{0,2}}{_CAPITAL}(?:{_GAP}{_CAPITAL}){{0,2}}"
    rf"|(?<![A-Za-z]){_CAP}{_LOW}*?(?:{_GAP}|-)?(?i:{_SUFFIX})),?{_GAP}\Z"
)
_INITIAL = rf"{_CAP}\."
_HYPHENED = rf"{_CAPITAL}(?:-{_CAPITAL})*"
# Words in lower case that stand within names, before the family name they belong to.
PARTICLES = ["van der", "van den", "van de", "van", "von der", "von den", "von", "de la", "de los", "de", "del", "della", "di", "da", "dos", "ter", "af", "av", "bin", "ibn", "al", "el"]
_PARTICLES = rf"(?:{'|'.join(x.replace(' ', _GAP) for x in PARTICLES)}){_GAP}"
_RUN = re.compile(rf"(?=[A-Z\\{{{_UPPER}])(?<![A-Za-z\\]){_HYPHENED}(?:(?:,?{_GAP})(?:{_INITIAL}{_GAP}?)*(?:{_PARTICLES})?{_HYPHENED})+(?:{_GAP}{_INITIAL})?")
_PARTICLE = re.compile("^" + _PARTICLES)
_TOKEN = re.compile(rf"(?P<initial>{_INITIAL})|(?P<word>(?:{_PARTICLES})?{_HYPHENED})|(?P<comma>,)")
_MARKUP = re.compile(r"\\[A-Za-z]+|[\\{}'`\"^~=.]")


# Letters that don't come apart into a letter and a mark.
_PLAIN = str.maketrans({"ø": "o", "Ø": "O", "ß": "ss", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ı": "i"})


def bare(word: str) -> str:
    """A word in lower case, without markup and accents."""
    if "\\" in word or "{" in word:
        word = re.sub(r"\\(o|O|ss|ae|AE|aa|AA|oe|OE|l|L)(?![A-Za-z])", r"\1", word)
        word = re.sub(r"[\\{}'`\"^~=.]", "", re.sub(r"\\[cvuHkrd](?=\{)", "", word))
    if not word.isascii():
        word = "".join(c for c in unicodedata.normalize("NFKD", word.translate(_PLAIN)) if not unicodedata.combining(c))
    return word.lower()


_NOT_LOCAL = re.compile(r"[^\w.+\-\\{}]")


def _back(text: str, end: int) -> int:
    """Where the characters before ``end`` begin that may belong to the local part of an address."""
    at, step = end, 64
    while at > 0:
        low = max(0, at - step)
        last = None
        for last in _NOT_LOCAL.finditer(text, low, at):
            pass
        if last is not None:
            return last.end()
        at, step = low, step * 2
    return 0


_ENDS = re.compile(rf"(?i:{_SUFFIX})\Z")


def _street_may_end(text: str, end: int) -> bool:
    """Whether the word before a number begins with a capital or ends as streets do; most don't, which is soon told."""
    b = end
    while b > 0 and text[b - 1] in " \t\r\n~%,":
        b -= 1
    a = b
    while a > 0 and text[a - 1] not in " \t\n~":
        a -= 1
    return a < b < end and (text[a].isupper() or not text[a].isalnum() or _ENDS.search(text, a, b) is not None)


def _words_back(text: str, end: int, n: int = 9) -> int:
    """Where the n words before ``end`` begin, however long they are."""
    at = end
    for _ in range(n):
        while at > 0 and text[at - 1] in " \t\r\n~%,":
            at -= 1
        while at > 0 and text[at - 1] not in " \t\n~":
            at -= 1
        if at == 0:
            return 0
    return at


def candidates(text: str) -> list[tuple[int, int, str, str, int]]:
    """(start, end, form, key, part) in order: form is email, number, code, address or word; key is what equal tokens
    share; part numbers the run of capitalised words a word stands in, -1 otherwise. They do not overlap: an e-mail
    address goes before an address, that before a number, that before a code, that before words.
    """
    found: list[tuple[int, int, str, str, int]] = []
    taken = bytearray(len(text) + 1)  # 1 where a candidate stands

    def free(a: int, b: int) -> bool:
        return taken.find(1, a, b) < 0

    def take(a: int, b: int) -> None:
        taken[a:b] = b"\1" * (b - a)

    for m in _AT.finditer(text):
        domain = _DOMAIN.match(text, m.end())
        local = domain and _LOCAL.search(text, _back(text, m.start()), m.start())
        if local and free(local.start(), domain.end()):
            span = local.start(), domain.end()
            take(*span)
            found.append((*span, "email", text[slice(*span)].lower(), -1))
    for m in _HOUSE.finditer(text):
        after = _AFTER.match(text, m.end())
        if after:
            span = m.start(), after.end()
        else:
            before = _street_may_end(text, m.start()) and _BEFORE.search(text, _words_back(text, m.start()), m.start())
            if not before:
                continue
            span = before.start(), m.end()
        if free(*span):
            take(*span)
            found.append((*span, "address", text[slice(*span)].lower(), -1))
    for m in _NUMBER.finditer(text):
        a, b = m.span()
        s = m.group()
        n = sum(map(str.isdigit, s))
        if s[-1] == ")":
            b -= 1
            s = s[:-1]
        if n < 7 or n > 18 or _BIBLIO.search(s):
            continue
        if s[0] == "(" and ")" not in s:
            a += 1
        if free(a, b):
            take(a, b)
            found.append((a, b, "number", re.sub(r"\D", "", s), -1))
    for m in _CODE.finditer(text):
        if free(*m.span()):
            take(*m.span())
            found.append((*m.span(), "code", m.group(), -1))
    part = 0
    for m in _RUN.finditer(text):
        a, b = m.span()
        clear = free(a, b)
        part += 1
        for t in _TOKEN.finditer(text, a, b):
            if not clear and not free(*t.span()):
                part += 1  # what stands on either side of another candidate is apart
            elif t.lastgroup == "word":
                found.append((*t.span(), "word", bare(_PARTICLE.sub("", t.group())), part))
    found.sort()
    return found
