"""The phoneme inventory: symbols, features, IPA and the kana that stand for them.

Each phoneme also has a one-character code, so that a sequence is a plain string: grouping, prefix tests and
containment become string operations.
"""

from __future__ import annotations

from itertools import product

# Consonants with place, manner, voicing (v), palatalisation (p), IPA and code.
CONSONANT_ROWS = """
k velar stop - - k k
g velar stop v - ɡ g
ky velar stop - p kʲ K
gy velar stop v p ɡʲ G
t alveolar stop - - t t
d alveolar stop v - d d
p bilabial stop - - p p
b bilabial stop v - b b
py bilabial stop - p pʲ P
by bilabial stop v p bʲ B
s alveolar fricative - - s s
z alveolar fricative v - z z
sh postalveolar fricative - p ɕ S
j postalveolar affricate v p d͡ʑ j
ts alveolar affricate - - t͡s c
ch postalveolar affricate - p t͡ɕ C
h glottal fricative - - h h
hy palatal fricative - p ç H
f bilabial fricative - - ɸ f
fy bilabial fricative - p ɸʲ F
v labiodental fricative v - v v
n alveolar nasal v - n n
ny palatal nasal v p ɲ Y
m bilabial nasal v - m m
my bilabial nasal v p mʲ M
r alveolar liquid v - ɾ r
ry alveolar liquid v p ɾʲ L
y palatal approximant v - j y
w velar approximant v - w w
"""

# Vowels with height, backness, rounding (r) and IPA.
VOWEL_ROWS = """
i 0 0 - i
e 1 0 - e
a 2 1 - a
o 1 2 r o
u 0 2 - ɯ
"""

# Special moras (length, gemination, moraic nasal) with IPA.
SPECIAL_ROWS = """
R ː
Q ʔ
N ɴ
"""

# Order of places of articulation, and of manners.
PLACES = ["bilabial", "labiodental", "alveolar", "postalveolar", "palatal", "velar", "glottal"]
MANNERS = ["stop", "affricate", "fricative", "nasal", "liquid", "approximant"]

# Distances between manners.
MANNER_ROWS = """
stop affricate .35
stop fricative .65
stop nasal .55
stop liquid .85
stop approximant 1.0
affricate fricative .30
affricate nasal .80
affricate liquid .90
affricate approximant 1.0
fricative nasal .80
fricative liquid .85
fricative approximant .90
nasal liquid .60
nasal approximant .80
liquid approximant .45
"""

CONSONANTS = {r[0]: {"place": r[1], "manner": r[2], "voiced": r[3] == "v", "palatalized": r[4] == "p", "ipa": r[5], "code": r[6]} for r in map(str.split, CONSONANT_ROWS.strip().splitlines())}
VOWELS = {r[0]: {"height": int(r[1]), "backness": int(r[2]), "rounded": r[3] == "r", "ipa": r[4], "code": r[0]} for r in map(str.split, VOWEL_ROWS.strip().splitlines())}
SPECIALS = {r[0]: {"ipa": r[1], "code": r[0]} for r in map(str.split, SPECIAL_ROWS.strip().splitlines())}
MANNER_DISTANCE = {frozenset(r[:2]): float(r[2]) for r in map(str.split, MANNER_ROWS.strip().splitlines())}

SYMBOLS = [*CONSONANTS, *VOWELS, *SPECIALS]
CODE = {s: (CONSONANTS | VOWELS | SPECIALS)[s]["code"] for s in SYMBOLS}
SYMBOL = {c: s for s, c in CODE.items()}
IPA = {s: (CONSONANTS | VOWELS | SPECIALS)[s]["ipa"] for s in SYMBOLS}
CONSONANT_CODES = "".join(CODE[s] for s in CONSONANTS)
VOWEL_CODES = "".join(CODE[s] for s in VOWELS)
SPECIAL_CODES = "".join(SPECIALS)
CODES = CONSONANT_CODES + VOWEL_CODES + SPECIAL_CODES

# Kana by consonant, in the order a i u e o (a space where the row has none).
KANA_ROWS = {
    "": "アイウエオ", "k": "カキクケコ", "g": "ガギグゲゴ", "s": "サ スセソ", "z": "ザ ズゼゾ", "t": "タ  テト", "d": "ダ  デド", "n": "ナニヌネノ",
    "h": "ハ  ヘホ", "b": "バビブベボ", "p": "パピプペポ", "m": "マミムメモ", "y": "ヤ ユ ヨ", "r": "ラリルレロ", "w": "ワ    ", "v": "  ヴ  ",
}
# Kana whose consonant differs from that of their row, and old kana.
KANA_ALONE = {"シ": ("sh", "i"), "ジ": ("j", "i"), "チ": ("ch", "i"), "ツ": ("ts", "u"), "ヂ": ("j", "i"), "ヅ": ("z", "u"), "フ": ("f", "u"), "ヒ": ("hy", "i"), "ヲ": ("", "o"), "ヰ": ("", "i"), "ヱ": ("", "e")}
# First kana of pairs with a small y-row or w-row kana, and of loan-word pairs with a small vowel.
GLIDE_FIRST = {"キ": "ky", "ギ": "gy", "シ": "sh", "ジ": "j", "チ": "ch", "ニ": "ny", "ヒ": "hy", "ビ": "by", "ピ": "py", "ミ": "my", "リ": "ry", "フ": "fy"}
LOAN_FIRST = {"フ": "f", "ヴ": "v", "ウ": "w", "ツ": "ts", "テ": "t", "デ": "d", "シ": "sh", "ジ": "j", "チ": "ch", "ク": "k", "グ": "g", "ズ": "z", "ス": "s", "ト": "t", "ド": "d"}
GLIDE_SMALL = {"ャ": "a", "ュ": "u", "ョ": "o", "ヮ": "a"}
SMALL_VOWELS = {"ァ": "a", "ィ": "i", "ゥ": "u", "ェ": "e", "ォ": "o"}
# Marks of the special moras.
LONG_MARKS, GEMINATE_MARKS, NASAL_MARK = "ー〜–—ｰ", "ッｯ", "ン"


def _kana() -> dict[str, tuple[str, str]]:
    """kana -> (consonant or '', vowel or special)."""
    found = {k: (c, v) for c, row in KANA_ROWS.items() for k, v in zip(row, "aiueo", strict=True) if k != " "}
    found |= KANA_ALONE
    found |= {s: ("", v) for s, v in SMALL_VOWELS.items()} | {s: ("y", v) for s, v in GLIDE_SMALL.items()}
    loans = {a + s: (c, v) for (a, c), (s, v) in product(LOAN_FIRST.items(), SMALL_VOWELS.items())}
    glides = {a + s: (c, v) for (a, c), (s, v) in product(GLIDE_FIRST.items(), GLIDE_SMALL.items())}
    marks = {m: ("", "R") for m in LONG_MARKS} | {m: ("", "Q") for m in GEMINATE_MARKS} | {NASAL_MARK: ("", "N")}
    return found | loans | glides | marks


KANA = _kana()
#: kana -> its phonemes' codes.
KANA_CODES = {k: CODE.get(c, "") + CODE[v] for k, (c, v) in KANA.items()}
#: Matches one mora, pairs first; what it skips is no mora. Classes of characters are much faster than a list of kana.
MORA_PATTERN = "|".join([f"[{''.join(GLIDE_FIRST)}][{''.join(GLIDE_SMALL)}]", f"[{''.join(LOAN_FIRST)}][{''.join(SMALL_VOWELS)}]", "[" + "".join(sorted(k for k in KANA if len(k) == 1)) + "]"])

HIRAGANA = "".join(chr(c) for c in range(0x3041, 0x3097))
KATAKANA = "".join(chr(c + 0x60) for c in range(0x3041, 0x3097))
