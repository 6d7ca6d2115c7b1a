"""Made-up texts with known personal items, for learning the weights of the random field."""

from __future__ import annotations

import random
import re

from .persons import GIVEN, PARTICLES

# What a sample is made of. Braces with a kind in capitals stand for an item of that kind; G, S, T, W for
# a given name, a family name, a title-case word and a lower-case word that are no item; D for a date-like number.
LINES = [
    r"\author{{NAME} \and {NAME}}", r"\author{{NAME}\thanks{Email: {EMAIL}}}", r"\author{{NAME}\footnote{{EMAIL}} and {NAME}}",
    r"\author{{NAME} ({EMAIL})\\ {NAME}\\ {NAME}}", r"\author{X.~{S}, Y. {S}}", r"\author{The {S} Collaboration}", r"\email{{EMAIL}}",
    r"\address{{ADDRESS}, 12345 {T}}", r"\affil{{ADDRESS} in {T}}", r"\newcommand{\contact}{{EMAIL}}", r"\def\where{{ADDRESS}}", r"\newcommand{\home}{{ADDRESS}}",
    "% ask {NAME} about this, {PHONE}", "% write to {NAME} <{EMAIL}>", "%% {NAME} called, {PHONE}, wants the {W} back", "% reviewer may be {NAME} <{EMAIL}>",
    "% my address: {ADDRESS}, delete before submission", "% went to {ADDRESS} last year", "%new form: {IDWORD} {ID}", "% {IDWORD} {ID} -- must not go out",
    "We thank {NAME} for comments on the {W}.", "We are grateful to Prof. {NAME} and Dr.~{NAME}, who saw a draft.", "Thanks are due to {NAME}, {NAME} and {NAME}.",
    r"Wir danken {NAME} f\"ur Anregungen.", r"Merci \`a {NAME} pour son aide.", "Agradecemos a {NAME} sus comentarios.", "This is dedicated to the memory of {NAME}.",
    "Support came from {NAME} under Grant {GRANT}.", "This was funded by Grant No. {GRANT}.", "The award {GRANT} and contract no. {GRANT} paid for it.",
    "It is filed under accession {ACCESSION}, release 2.1@main, with lot {LOT}.", "Write \\texttt{a@b} for the product; then the {S} Theorem holds.",
    "The {S} inequality and the {S}-{S} Lemma are used in the {W}.", "By the {S} Conjecture and the {T} Principle we have it.", "The {G} telescope and the {S} survey observed it.",
    "Data of the {G} array were reduced with {G} 4.1.", "The {T} Workshop and {T} Program were named after them.", "The {T} Volume {X} of the journal (ISSN {ISSN}) lists it.",
    "See Section {TABLE} of the supplement and Table {TABLE}.", "The first {T} {T} samples follow {N} {T} tracks.", "The {N} {T} samples keep a distance of {N} metres.",
    "Questions go to {NAME}, {EMAIL}, or by phone to {PHONE}.", "{NAME} can be reached under {PHONE}.", "Call {PHONE} or write to \\url{{EMAIL}}.", "Write to {NAME} at \\texttt{{EMAIL}}.",
    "Contact {NAME} (\\href{mailto:{EMAIL}}{mail}) for the code.", "Scripts from {EMAIL}; if urgent: {PHONE}.", "For {NAME} ring {PHONE}, mobile {PHONE}.", "(tel. {PHONE}, fax {PHONE})",
    "The door code is with {NAME} (cell {PHONE}).", "{NAME} & {PHONE} \\\\", "{NAME} & {EMAIL} \\\\", "Send samples to {NAME}, {ADDRESS}, 10117 {T}; phone {PHONE}.", "Parcels for {NAME} are left at {ADDRESS} (bell: {PHONE}).",
    "The car of {NAME} stood at {ADDRESS}, telephone {PHONE}.", "Present address: {ADDRESS}, 4056 {T}.", "Post goes to {ADDRESS} in {T}.",
    "Access was given to {NAME} ({IDWORD} {ID}).", "{NAME}, {IDWORD} {ID}, signed the form.", "The form of {NAME} shows {IDWORD} {ID}.", "Sample 7 was {NAME} with {IDWORD} {ID}.", "Only for the office: {IDWORD} {ID}",
    "The slip {NAME} lost reads {IDWORD} {ID}.", "Part of it was done while visiting {NAME}.", "{NAME} found an error in an earlier version.", "{NAME} does not agree with the {W}.", "{NAME} wanted this shorter.",
    "{NAME} lived with us during the campaign; number {PHONE}.", "Interview 3 with {NAME}; callback {PHONE}.", "Soil was collected by {NAME} in the second season.", "{NAME}, reachable under {EMAIL}, keeps it.",
    r"\bibitem{{W}07} A.~{S}, {\em Acta} {T} 12 (1999) 34--56.", r"\bibitem{{W}} B. {S}, Proc. {T} Soc. 222 (2017) 34--564.", r"\bibitem{{W}77} C.~{S} and D. {S}, J. {T} Lett. 3 (2001) 1--9.", r"\bibitem{{W}} E.~{S}, Ann. {T} Stud. 9 (1977) 5--6.",
    "Let the {W} be {W} and suppose that its {W} grows.", "Im Gegensatz zum {T} h\\\"angt das {T} vom {T} {T} ab.", "Der {W} {T} bestimmt das {T} des {T}, sofern der {T} bleibt.", "F\\\"ur jedes {T} zeigen wir es.",
    "In {T} {T} the {W} was {N} of {N}.", "Figure {N} plots The {T} against {T} {T}.", "Phone calls between {N} and {N} were counted.", "\\title{On The {W} Of {T} {T}}", "It follows that {W} and {W} are at {W}.",
    "Compare it at fixed {W}, version 3.2.1@{W}.", "The years 1990-1994 and pages 1201-1299 matter, item {LOT}.", "Figures \\ref{a} show The {S} Flow and {T} Noise.", "Doi 10.1000/{N}.{N} and ISBN 978-{ISSN} are cited.",
    "It {W} It the {T} same be The Both In and {W} {T}.", "both And that The It such {W} Be {T} When the.", "THE {W} OF THE {W}, ALTHOUGH A {W} LOSES ITS {W} AND THE {W} {W} IS {W}. {W} THE {W} {W}, OUR {W} GIVES {W}.",
    "LET THE {W} BE {W} AND SUPPOSE THAT {W} {W}. FOR EACH {W} WE RECORD {W} {W}, AND {W} IT WITH {W} {W} PERCENT OF.", "{W} IN {W} TO THE {W} {W}, {W} {W} NOT BOTH {W} {W} ON THE {W}.",
    "Our {T} {T} Slowly {T} The {T} {T}.", "A {T} {T} Was {T} From {T} {T} And {T} Until The {T}.", "{T} {T} Of {T} {T}, Whose {T} {W} {T} Of {T} Order.", "It {W} That {T} {T} And {T} {W} {W} {T} {T} In {T}.",
    "%this passage is by {NAME}", "% moved here by {NAME}", "%% text of {NAME}", "{T} {W} to the {W}, we {W} it.", "{T} the {W} for {W} {W} gives it.", "{T} each {W} we {W} the {W}.", "{T} {W} against {W} it {W}.",
    "{V} {NAME} about the {W}.", "{V} {NAME}, {PHONE}.", "{V} {NAME} and {NAME} we {W} it.", "{V} {T} von {T} ist {W}.", "Das {T} von {T} und das {T} der {T} von der {T}.", "La {T} de {T} y el {T} del {T} de la {T}.", "Le {T} de {T} est {W}.", "The {T} da {T} Basin and {T} di {T}.",
    "{T} University and the {T} Institute of {T} Research hosted us.", "A model called {G} was used with {S} Networks.", "The {T} Issue {X} and Second {T} {X} list them.", "Contact {NAME} at \\url{{EMAIL}}.",
]
VERBS = "Contact Ask Call Meet Write With By From For Since When Also Then Now Here After Before While Yesterday Dear Mr. Mrs. Professor Director".split()
ID_WORDS = ["SSN:", "SSN", "social security number", "Social Security no.", "tax id", "tax number", "TIN", "passport no.\\", "passport", "passport number", "national identity no.", "national id", "identity card", "staff number", "staff no.", "employee id", "personnel number", "Researcher id", "researcher ID", "ORCID", "student number"]
_SYLLABLES = "ba be bo da de du fa fo ga ge ha ho ka ke ko la le li lo ma me mi mo na ne no pa pe ra re ri ro sa se so ta te to va ve vi wa we wi ya za ze bren lar mor quen stav tar kel nor hal grim".split()
_ENDS = "berg son sen mann ini elli ski ov ez ato ard ier eau ton ley worth stein ko ic as is quist holm dal man dottir".split()
_ACCENTS = {"jurgen": r'J\"urgen', "andre": r"Andr\'e", "renee": r"Ren\'ee", "gunther": r'G\"unther', "bjorn": r'Bj{\"o}rn', "zoe": r'Zo\"e', "soren": r"S{\o}ren", "francois": r"Fran\c{c}ois"}
_GIVEN = sorted(GIVEN)


def _word(r: random.Random, n: int = 2) -> str:
    return "".join(r.choice(_SYLLABLES) for _ in range(n))


def _family(r: random.Random) -> str:
    one = lambda: (_word(r, r.choice((1, 2))) + r.choice(_ENDS)).capitalize()
    particle = r.choice(PARTICLES) + " " if r.random() < 0.05 else ""
    return particle + one() + ("-" + one() if r.random() < 0.08 else "")


def _given(r: random.Random) -> str:
    if r.random() < 0.12:
        return _word(r, r.choice((2, 3))).capitalize()
    g = r.choice(_GIVEN)
    return _ACCENTS.get(g, g.capitalize())


def _name(r: random.Random) -> str:
    given, family = _given(r), _family(r)
    gap = "~" if r.random() < 0.12 else "\n" if r.random() < 0.04 else " "
    if r.random() < 0.1:
        out = f"{family}, {given}"
    elif r.random() < 0.13:
        out = f"{given} {r.choice('ABCDEFHJKLMRST')}.{gap}{family}"
    else:
        out = f"{given}{gap}{family}"
    return out.upper() if r.random() < 0.1 and "\\" not in out else out


def _digits(r: random.Random, shape: str) -> str:
    return re.sub("9", lambda _: r.choice("0123456789"), shape)


def _email(r: random.Random, name: str | None) -> str:
    plain = re.sub(r"[^a-z]+", " ", name.lower()).split() if name else [_word(r), _word(r)]
    local = r.choice(["{0}.{1}", "{0}", "{1}", "{0}_{1}", "{0}{n}", "{0}-{1}"]).format(plain[0], plain[-1], n=r.randrange(99))
    domain = [*(["phys"] if r.random() < 0.4 else []), _word(r), r.choice(["example", "test", "invalid", "org", "edu", "de", "com", "fr"])]
    roll = r.random()
    if roll < 0.72:
        out = local + "@" + ".".join(domain)
    elif roll < 0.8:
        out = f"{local} [at] " + " [dot] ".join(domain)
    elif roll < 0.88:
        out = f"{local}(at)" + ".".join(domain)
    else:
        out = f"{local} at " + ".".join(domain)
    return out.upper() if r.random() < 0.08 else out


PHONES = ["+1 (999) 999-9999", "(999) 999-9999", "999-9999", "999-9999-9999", "+44 20 9999 9999", "+49 30 99999 999", "+49~(0)30~99999-999", "0044 9999 999999", "99.99.99.99.99", "+33 9 99 99 99 99", "+19999999999", "+99 999 999 999", "099/9999999"]
IDS = ["999 99 9999", "999-99-9999", "99 999 999 999", "X9999999", "999999-9999", "0000-0000-9999-9999", "EMP-99999/9", "ST-99999/9", "99999999", "XX999999", "999 999 999"]


def _address(r: random.Random) -> str:
    t = (_word(r, r.choice((1, 2))) + r.choice(("moor", "field", "ton", "wick", "hay", "vale", ""))).capitalize()
    n = str(r.randrange(1, 320)) + ("ABC"[r.randrange(3)] if r.random() < 0.15 else "")
    return r.choice([f"{n} {t} {r.choice(['Street', 'St.', 'Road', 'Rd.', 'Avenue', 'Ave.', 'Lane', 'Drive', 'Crescent'])}", f"{n}, rue de {t}", f"{n}~rue~{t}", f"calle {t} {n}", f"{t}stra{{\\ss}}e {n}", f"{t}straße {n}", f"{t}weg {n}", f"{t}gasse {n}", f"via {t} {n}"])


def sample(r: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """(text, (start, end, kind) of its items)."""
    out, spans, at = [], [], 0
    people = [_name(r) for _ in range(3)]

    def put(s: str) -> None:
        nonlocal at
        out.append(s)
        at += len(s)

    for _ in range(r.randrange(5, 11)):
        named = None
        line = r.choice(LINES)
        caps = line.upper() == line
        for piece in re.split(r"(\{(?:NAME|EMAIL|PHONE|ID|IDWORD|ADDRESS|GRANT|ACCESSION|LOT|ISSN|TABLE|[GSTWXNV])\})", line):
            kind = piece[1:-1] if re.fullmatch(r"\{[A-Z]+\}", piece) else None
            if kind in ("NAME", "EMAIL", "PHONE", "ID", "ADDRESS"):
                if kind == "NAME":
                    value = named = r.choice(people) if r.random() < 0.3 else _name(r)
                elif kind == "EMAIL":
                    value = _email(r, named if r.random() < 0.8 else None)
                elif kind == "PHONE":
                    value = _digits(r, r.choice(PHONES))
                elif kind == "ID":
                    value = re.sub("X", lambda _: r.choice("ABCEKLPQX"), _digits(r, r.choice(IDS)).replace("EMP", "EMP"))
                else:
                    value = _address(r)
                spans.append((at, at + len(value), {"ID": "id_number"}.get(kind, kind.lower())))
                put(value)
            elif kind:
                other = {"IDWORD": lambda: r.choice(ID_WORDS), "GRANT": lambda: _digits(r, r.choice(["9999-99-9999", "99-999-9999", "AB-9999999"])), "ACCESSION": lambda: _digits(r, r.choice(["XQ9999999", "AB999999"])),
                     "LOT": lambda: _digits(r, r.choice(["999-9999", "99-99999"])), "ISSN": lambda: _digits(r, "9999-9999"), "TABLE": lambda: _digits(r, r.choice(["9-99-9999", "999-99", "9-9999999"])),
                     "G": lambda: _given(r), "S": lambda: _family(r), "T": lambda: _word(r).capitalize() if r.random() < 0.7 else r.choice(["Spring", "Jubilee", "Summer", "Winter", "Annual", "Special", "Appendix", "Volume", "Part", "North"]),
                     "W": lambda: _word(r), "X": lambda: r.choice("ABC"), "V": lambda: r.choice(VERBS), "N": lambda: str(r.randrange(2, 900))}[kind]()
                put(other.upper() if caps else other)
            else:
                put(piece)
        put(r.choice(["\n\n", "\n", "\n", " ", "\r\n"]) if r.random() < 0.95 else "\n%")
    return "".join(out), spans
