"""Name matching keys: trigram sets (Catalyst expressions) and a phonetic key."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def trigrams(text: Column | str) -> Column:
    """Distinct trigrams of the lower-cased words, each padded with two blanks before and one after."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))

    def cut(word: Column) -> Column:
        padded = F.concat(F.lit("  "), word, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(word) + 1), lambda i: F.substring(padded, i, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(words, cut)))


def overlap(left: Column, right: Column) -> Column:
    return F.size(F.array_intersect(left, right))


def jaccard(common: Column, left: Column, right: Column) -> Column:
    """Shared over all trigrams, in single precision as the similarity scale defines it."""
    whole = F.size(left) + F.size(right) - common
    return F.try_divide(common.cast("double"), whole.cast("double")).cast("float").cast("double")


def first_word(text: Column | str) -> Column:
    return F.split_part(text, F.lit(" "), F.lit(1))


# The published Double Metaphone rules (primary code), read left to right; the
# first rule that fits at a letter consumes what it matched and gives its code. A word ends
# with "|" and flags: "w" for a Slavic or Germanic spelling, "s" for a start with SCH, "m" for
# a start with MC. X is the sound of SH and 0 the sound of TH.
PHONETIC_RULES = [
    (r"\|.*", ""),
    (r"^(?:(?=GN|KN|PN|WR|PS).)", ""), (r"^X", "S"), (r"^[AEIOUY]", "A"), (r"[AEIOUY]", ""),
    (r"BB?", "P"), (r"Ç", "S"),
    # C
    (r"(?<=[^AEIOUY]A)CH(?![IE])", "K"), (r"(?<=BA)CH(?=ER)|(?<=MA)CH(?=ER)", "K"), (r"^CA(?=ESAR)", "S"),
    (r"CH(?=IA)", "K"), (r"(?<!^)CH(?=AE)", "K"), (r"^CH(?=ARAC|ARIS|OR(?!E)|YM|IA|EM)", "K"),
    (r"CH(?=.*\|\w*s)", "K"), (r"(?<=OR)CH(?=ES|ID)|(?<=AR)CH(?=IT)", "K"), (r"CH(?=[TS])", "K"),
    (r"(?:^|(?<=[AOUE]))CH(?=[LRNMBHFVW|])", "K"), (r"(?<!^)CH(?=.*\|\w*m)", "K"), (r"CH", "X"),
    (r"(?<!WI)CZ", "S"), (r"C(?=CIA)CI", "X"),
    (r"(?<=^A)CC(?=[IE]|H(?!U)).", "KS"), (r"(?<=U)CC(?=EE|ES).", "KS"), (r"(?<!^M)CC(?=[IE]|H(?!U)).", "X"),
    (r"(?<!^M)CC", "K"), (r"C[KGQ]", "K"), (r"C[IEY]", "S"), (r"C(?:[KQ]|C(?![EI]))", "K"), (r"C", "K"),
    # D, F
    (r"DG[IEY]", "J"), (r"DG", "TK"), (r"D[TD]?", "T"), (r"FF?", "F"),
    # G
    (r"(?<=[^AEIOUY])GH", "K"), (r"^GH(?=I)", "J"), (r"^GH", "K"),
    (r"(?:(?<=[BHD].)|(?<=[BHD]..)|(?<=[BH]...))GH", ""), (r"(?<=[CGLRT].U)GH", "F"), (r"(?<=I)GH", ""), (r"GH", "K"),
    (r"(?<=^[AEIOUY])GN(?!.*\|\w*w)", "KN"), (r"GN(?!EY)(?!.*\|\w*w)", "N"), (r"GN", "KN"),
    (r"G(?=LI)(?!.*\|\w*w).", "KL"), (r"^G(?:Y|(?=ES|EP|EB|EL|EY|IB|IL|IN|IE|EI|ER).)", "K"),
    (r"(?<!^DAN)(?<!^RAN)(?<!^MAN)(?<![EI])G(?=ER).", "K"), (r"(?<![EIRO])GY", "K"),
    (r"G(?=[EIY])(?=.*\|\w*s).|G(?=ET).", "K"), (r"G[EIY]", "J"), (r"(?<=[AO])G(?=GI).", "J"), (r"GG?", "K"),
    # H, J, K, L, M, N
    (r"(?:^|(?<=[AEIOUY]))H[AEIOUY]", "H"), (r"^J(?=OSE\|)", "H"), (r"J(?=OSE)", "J"), (r"^JJ?", "J"),
    (r"(?<=[AEIOUY])J(?=[AO])(?!.*\|\w*w)", "J"), (r"J(?=\|)", "J"), (r"(?<![SKL])J(?![LTKSNMBZ])J?", "J"), (r"JJ?", ""),
    (r"KK?", "K"), (r"LL?", "L"), (r"(?<=U)MB(?=\||ER)", "M"), (r"MM?", "M"), (r"NN?", "N"), (r"Ñ", "N"),
    # P, Q, R
    (r"PH", "F"), (r"P[PB]?", "P"), (r"QQ?", "K"), (r"(?<=IE)(?<!MEIE)(?<!MAIE)R(?=\|)(?!.*\|\w*w)", ""), (r"RR?", "R"),
    # S
    (r"(?<=[IY])S(?=L)", ""), (r"^S(?=UGAR)", "X"), (r"SH(?=EIM|OEK|OLM|OLZ)", "S"), (r"SH", "X"), (r"SI[OA]", "S"),
    (r"SZ", "S"), (r"SCH(?=ER|EN)", "X"), (r"SCH(?=OO|UY|ED|EM)", "SK"), (r"SCH", "X"), (r"SC[IEY]", "S"),
    (r"SC[^|]?", "SK"), (r"(?:(?<=AI)|(?<=OI))S(?=\|)", ""), (r"S[SZ]?", "S"),
    # T, V
    (r"TI(?=ON).", "X"), (r"TIA|TCH", "X"), (r"T(?:H(?=OM|AM)|H(?=.*\|\w*s))", "T"), (r"TH|T(?=TH).", "0"), (r"T[TD]?", "T"),
    (r"VV?", "F"),
    # W, X, Z
    (r"WR", "R"), (r"^W(?=[AEIOUY]|H)", "A"), (r"(?<=[AEIOUY])W(?=\|)", ""), (r"(?<=[EO])W(?=SK[IY])", ""),
    (r"W(?=.*\|\w*s)", ""), (r"WI[CT]Z", "TS"), (r"(?:(?<=IAU)|(?<=EAU)|(?<=AU)|(?<=OU))X(?=\|)", ""), (r"X[CX]?", "KS"),
    (r"ZH", "J"), (r"ZZ?", "S"),
    # anything else is silent
    (r".", ""),
]
PHONETIC_LENGTH = 4

_SCAN = re.compile("|".join(f"(?P<r{i}>{pattern})" for i, (pattern, _) in enumerate(PHONETIC_RULES)))
_CODES = {f"r{i}": code for i, (_, code) in enumerate(PHONETIC_RULES)}
_FLAGS = [("w", re.compile("W|K|CZ")), ("s", re.compile("^SCH")), ("m", re.compile("^MC"))]


def _sound(word: str | None) -> str | None:
    if word is None:
        return None
    word = word.upper().replace("|", "")
    flags = "".join(flag for flag, test in _FLAGS if test.search(word))
    return _SCAN.sub(lambda m: _CODES[m.lastgroup], f"{word}|{flags}")[:PHONETIC_LENGTH]


@F.pandas_udf(T.StringType())
def phonetic_key(words: pd.Series) -> pd.Series:
    """Sound of a word, four letters at most. Words repeat, so each is read once per batch."""
    known = {word: _sound(word) for word in words.unique()}
    return words.map(known)
