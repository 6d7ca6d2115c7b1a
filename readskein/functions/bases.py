"""Expressions on base strings and words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def base_code(base: Column | str) -> Column:
    """A, C, G, T in either case as 0..3; null for anything else."""
    at = F.instr(F.lit("ACGT"), F.upper(_c(base)))
    return F.when((F.length(_c(base)) == 1) & (at > 0), at - 1)


def base_letter(code: Column | str) -> Column:
    """0..3 as A, C, G, T; M for anything else."""
    return F.coalesce(F.get(F.array(*map(F.lit, "ACGT")), _c(code)), F.lit("M"))


def word_number(word: Column | str) -> Column:
    """A word of up to 31 bases as a base-4 number; null if it has another character."""
    w = F.upper(_c(word))
    return F.when(w.rlike("^[ACGT]{1,31}$"), F.conv(F.translate(w, "ACGT", "0123"), 4, 10).cast("bigint"))


def word_string(number: Column | str, k: int) -> Column:
    """The word of k bases that has this number."""
    return F.translate(F.lpad(F.conv(_c(number).cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def reverse_complement(bases: Column | str) -> Column:
    """Reversed, each of A, C, G, T in either case complemented; other characters stay."""
    return F.reverse(F.translate(_c(bases), "ACGTacgt", "TGCAtgca"))


def complement_ambiguous(bases: Column | str) -> Column:
    """Complement (not reversed) where ambiguity codes become X and gaps vanish."""
    return F.translate(F.upper(_c(bases)), "ACGTXRYSWKMBDHVN-", "TGCAXXXXXXXXXXXX")


def strip_other(bases: Column | str) -> Column:
    """Without characters that aren't bases."""
    return F.regexp_replace(_c(bases), "[^ACGTacgt]", "")


def collapse_runs(bases: Column | str, n: int) -> Column:
    """Without the runs of one base that are longer than n."""
    out = _c(bases)
    for b in "ACGT":
        out = F.regexp_replace(out, f"{b}{{{n + 1},}}", "")
    return out


def steady_bases(bases: Column | str, id: Column | str) -> Column:
    """In capitals, any character other than A, C, G, T replaced by a base that depends on row and place only."""
    b = F.upper(_c(bases))
    place = F.pmod(_c(id) * 31 + F.lit(0), F.lit(4))
    fixed = F.array_join(
        F.transform(F.split(b, ""), lambda c, i: F.when(F.instr(F.lit("ACGT"), c) > 0, c).otherwise(F.substr(F.lit("ACGT"), (F.pmod(place + i, F.lit(4)) + 1).cast("int"), F.lit(1)))), ""
    )
    return F.when(b.rlike("[^ACGT]"), fixed).otherwise(b)


def words(bases: Column | str, k: int) -> Column:
    """All overlapping words of k characters, in order; empty for shorter strings and null for null.

    One pass of a look-ahead pattern: a lambda over places would evaluate the string's own expression for each word.
    """
    return F.regexp_extract_all(_c(bases), F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))


def sample_words(bases: Column | str) -> Column:
    """The words of 8 bases at 0-based places 8k, 1 <= k <= length div 8 - 2."""
    blocks = F.regexp_extract_all(_c(bases), F.lit("(?s)(.{8})"), F.lit(1))
    return F.slice(blocks, F.lit(2), F.greatest(F.size(blocks) - 2, F.lit(0)))


def simple_word(word: Column | str, share: int = 3) -> Column:
    """Whether fewer than a 1/share of the characters are masked (X or N)."""
    w = F.upper(_c(word))
    masked = F.length(w) - F.length(F.translate(w, "XN", ""))
    return masked * share < F.length(w)


def wrapped(bases: Column | str, width: int = 60) -> Column:
    """In lines of ``width`` characters."""
    return F.regexp_replace(_c(bases), f"(.{{{width}}})(?=.)", "$1\n")


def fasta_record(id: Column | str, clone: Column | str, bases: Column | str, width: int = 80) -> Column:
    """Header and wrapped bases; a null id is left blank and a null clone left out."""
    header = F.concat(F.lit(">"), F.coalesce(_c(id), F.lit("")), F.coalesce(F.concat(F.lit(" clone "), _c(clone)), F.lit("")))
    return F.concat_ws("\n", header, wrapped(F.coalesce(_c(bases), F.lit("")), width))


def accession(header: Column | str) -> Column:
    """The name in a header: the accession of gi|..|gb|acc|, else the number after gi|, else what comes before | or blank."""
    h = _c(header)
    parts = [F.regexp_extract(h, r"gb\|([^|\s]+)", 1), F.regexp_extract(h, r"gi\|(\d+)", 1), F.regexp_extract(h, r"^>?\s*([^|\s]+)", 1)]
    return F.coalesce(*[F.when(p != "", p) for p in parts])


def clone_name(clone: Column | str) -> Column:
    """A clone without surrounding blanks and in lower case; null if it has no letter or digit."""
    c = F.lower(F.regexp_replace(_c(clone), r"^\s+|\s+$", ""))
    return F.when(c.rlike(r"[\p{L}\p{N}]"), c)


def mutated(bases: Column | str, id: Column | str, percent: int, seed: int = 0) -> Column:
    """Each base replaced by another one at ``percent`` % of the places; which ones depends on id, place and seed."""
    b, i = _c(bases), _c(id)

    def one(c: Column, p: Column) -> Column:
        draw = F.pmod(F.xxhash64(i, p, F.lit(seed)), F.lit(300))
        other = F.substr(F.lit("ACGT"), (F.pmod(F.instr(F.lit("ACGT"), c) + F.pmod(draw, F.lit(3)), F.lit(4)) + 1).cast("int"), F.lit(1))
        return F.when((draw < percent * 3) & (F.instr(F.lit("ACGT"), c) > 0), other).otherwise(c)

    return F.array_join(F.transform(F.split(F.upper(b), ""), one), "")
