"""Names in Latin letters, for display only: a table of characters, applied by builtins."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands for a letter, by its Unicode name without case and additions. Capitals get a capital first letter.
LETTERS = {
    "GREEK": {
        "ALPHA": "a", "BETA": "b", "GAMMA": "g", "DELTA": "d", "EPSILON": "e", "ZETA": "z", "ETA": "e", "THETA": "th", "IOTA": "i", "KAPPA": "k", "LAMDA": "l", "MU": "m", "NU": "n", "XI": "x", "OMICRON": "o",
        "PI": "p", "RHO": "r", "SIGMA": "s", "FINAL SIGMA": "s", "TAU": "t", "UPSILON": "u", "PHI": "ph", "CHI": "kh", "PSI": "ps", "OMEGA": "o",
    },
    "CYRILLIC": {
        "A": "a", "BE": "b", "VE": "v", "GHE": "g", "DE": "d", "IE": "e", "IO": "io", "ZHE": "zh", "ZE": "z", "I": "i", "SHORT I": "i", "KA": "k", "EL": "l", "EM": "m", "EN": "n", "O": "o", "PE": "p", "ER": "r",
        "ES": "s", "TE": "t", "U": "u", "EF": "f", "HA": "kh", "TSE": "ts", "CHE": "ch", "SHA": "sh", "SHCHA": "shch", "HARD SIGN": '"', "YERU": "y", "SOFT SIGN": "'", "E": "e", "YU": "iu", "YA": "ia",
        "DJE": "dj", "GJE": "gj", "UKRAINIAN IE": "ie", "DZE": "dz", "BYELORUSSIAN-UKRAINIAN I": "i", "YI": "yi", "JE": "j", "LJE": "lj", "NJE": "nj", "TSHE": "tsh", "KJE": "kj", "SHORT U": "u", "DZHE": "dzh",
    },
    "HEBREW": {
        "ALEF": "a", "BET": "b", "GIMEL": "g", "DALET": "d", "HE": "h", "VAV": "v", "ZAYIN": "z", "HET": "kh", "TET": "t", "YOD": "y", "FINAL KAF": "k", "KAF": "k", "LAMED": "l", "FINAL MEM": "m", "MEM": "m",
        "FINAL NUN": "n", "NUN": "n", "SAMEKH": "s", "AYIN": "`", "FINAL PE": "p", "PE": "p", "FINAL TSADI": "ts", "TSADI": "ts", "QOF": "q", "RESH": "r", "SHIN": "sh", "TAV": "t",
    },
    "ARABIC": {
        "ALEF": "a", "BEH": "b", "TEH MARBUTA": "h", "TEH": "t", "THEH": "th", "JEEM": "j", "HAH": "h", "KHAH": "kh", "DAL": "d", "THAL": "dh", "REH": "r", "ZAIN": "z", "SEEN": "s", "SHEEN": "sh", "SAD": "s", "DAD": "d",
        "TAH": "t", "ZAH": "z", "AIN": "`", "GHAIN": "gh", "FEH": "f", "QAF": "q", "KAF": "k", "LAM": "l", "MEEM": "m", "NOON": "n", "HEH": "h", "WAW": "w", "ALEF MAKSURA": "a", "YEH": "y", "PEH": "p", "TCHEH": "ch",
        "GAF": "g", "FARSI YEH": "y", "KEHEH": "k", "HAMZA": "'",
    },
}
#: Latin letters that are two or stand alone, and marks.
OTHERS = {
    "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "ß": "ss", "ẞ": "SS", "Ð": "D", "ð": "d", "Þ": "Th", "þ": "th", "ı": "i", "ĸ": "k", "Ŋ": "NG", "ŋ": "ng", "‘": "'", "’": "'", "‚": ",", "“": '"', "”": '"', "„": '"',
    "–": "-", "—": "--", "†": "+", "•": "*", "‹": "<", "›": ">", "«": "<<", "»": ">>", "€": "EUR", "×": "x", "÷": "/", "⁄": "/", "¡": "!", "¿": "?", "©": "(c)", "®": "(r)", "​": "", "‎": "", "‏": "", "﻿": "",
}
#: Where the characters are that the rule looks at: Latin, Greek, Cyrillic, Hebrew, Arabic, marks, letter-like signs, ligatures, wide forms.
RANGES = ((0xA0, 0x250), (0x300, 0x530), (0x591, 0x5F5), (0x600, 0x6D4), (0x1E00, 0x2070), (0x2100, 0x2150), (0xFB00, 0xFB07), (0xFF01, 0xFF5F))
_SPACE = " \t\n\r\x0b\x0c"


def _letter(x: str) -> str | None:
    """What stands for a character by its Unicode name."""
    named = re.fullmatch(r"(LATIN|GREEK|CYRILLIC|HEBREW|ARABIC) (?:(SMALL|CAPITAL) )?LETTER (.+?)(?: WITH .+| ABOVE)?", unicodedata.name(x, ""))
    if not named:
        return None
    script, case, letter = named.groups()
    out = letter.lower() if script == "LATIN" and len(letter) == 1 else LETTERS.get(script, {}).get(letter)
    return out.capitalize() if out and case == "CAPITAL" else out


@cache
def characters() -> dict[str, str]:
    """Each character that isn't ASCII with what stands for it: by its parts, without marks of their own, or by its name."""
    out = {}
    for x in (chr(i) for low, high in RANGES for i in range(low, high)):
        parts = [p for p in unicodedata.normalize("NFKD", x) if not unicodedata.combining(p)]
        said = [p if p.isascii() else OTHERS.get(p, _letter(p)) for p in parts]
        if own := _letter(x):
            out[x] = own
        elif x in OTHERS or (unicodedata.name(x, "") and None not in said):
            out[x] = OTHERS.get(x, "".join(s for s in said if s is not None))
    return out


def latin_display(c: Column, more: dict[str, str] | None = None) -> Column:
    """A name in Latin letters, as near as single characters come; for display, never for matching.

    Accents go; Greek, Cyrillic, Hebrew and Arabic letters are written in Latin ones.  ``more`` adds characters (such as Han, of which the
    library has no table) or overrides some.  Characters of which nothing is known stay.  White space at the ends goes; a name of which nothing would be left stays; null is empty.

    One builtin translates single characters, into markers where several stand for one; each marker is then replaced.
    """
    table = characters() | (more or {})
    several = sorted({t for t in table.values() if len(t) > 1})
    markers = {t: chr(0xE000 + i) for i, t in enumerate(several)}
    gone = [x for x, t in table.items() if not t]  # characters beyond the second argument's end are deleted
    pairs = {x: markers.get(t, t) for x, t in table.items() if t}
    said = F.btrim(c, F.lit(_SPACE))
    out = F.translate(F.translate(said, "".join(markers.values()), ""), "".join([*pairs, *gone]), "".join(pairs.values()))
    for t, marker in markers.items():
        out = F.replace(out, F.lit(marker), F.lit(t))
    out = F.btrim(F.when(said.rlike(r"[^\x00-\x7f]"), out).otherwise(said), F.lit(_SPACE))
    return F.coalesce(F.nullif(out, F.lit("")), said, F.lit(""))
