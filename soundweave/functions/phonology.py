"""Readings as columns: katakana, moras, phonemes, skeletons and IPA, in built-in functions only.

`codes` below is a string with one character for each phoneme (see inventory). A null input gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import inventory as I

PRONOUNCEABLE = "^[\\u30A1-\\u30FAー]+$"
SEARCHABLE = "[ぁ-ヿ一-鿿ー]"
UNREADABLE = "[0-9A-Za-z０-９Ａ-Ｚａ-ｚ]"
KANJI = "[一-鿿]"


def literal_map(found: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in found.items() for x in pair])


def to_katakana(text: Column) -> Column:
    """Hiragana as katakana; other characters stay."""
    return F.translate(text, I.HIRAGANA, I.KATAKANA)


def mora_kana(reading: Column) -> Column:
    """The moras of a reading as an array of kana; unknown characters are skipped."""
    return F.regexp_extract_all(to_katakana(reading), F.lit(f"({I.MORA_PATTERN})"), 1)


_SINGLE = "".join(k for k in I.KANA if len(k) == 1)
_NONE = "0"  # stands for no consonant until it is removed
_SINGLE_FIRST = "".join(I.CODE[c] if c else _NONE for k, (c, _) in I.KANA.items() if len(k) == 1)
_SINGLE_LAST = "".join(I.CODE[v] for k, (_, v) in I.KANA.items() if len(k) == 1)


def kana_codes(kana: Column) -> Column:
    """The codes of one mora. Translations look characters up by hash; a map literal would be searched from its start."""
    first, second = F.substring(kana, 1, 1), F.substring(kana, 2, 1)
    glide = F.translate(first, "".join(I.GLIDE_FIRST), "".join(I.CODE[c] for c in I.GLIDE_FIRST.values()))
    loan = F.translate(first, "".join(I.LOAN_FIRST), "".join(I.CODE[c] for c in I.LOAN_FIRST.values()))
    small = I.GLIDE_SMALL | I.SMALL_VOWELS
    pair = F.concat(F.when(second.isin(*I.GLIDE_SMALL), glide).otherwise(loan), F.translate(second, "".join(small), "".join(small.values())))
    alone = F.replace(F.concat(F.translate(kana, _SINGLE, _SINGLE_FIRST), F.translate(kana, _SINGLE, _SINGLE_LAST)), F.lit(_NONE), F.lit(""))
    return F.when(F.length(kana) == 2, pair).otherwise(alone)


def codes(reading: Column) -> Column:
    return F.array_join(F.transform(mora_kana(reading), kana_codes), "")


def mora_codes(code: Column) -> Column:
    """The codes of each mora: a special, or a vowel with the consonant before it."""
    return F.regexp_extract_all(code, F.lit(f"([{I.CONSONANT_CODES}]?[{I.VOWEL_CODES}]|[{I.SPECIAL_CODES}])"), 1)


def mora_count(code: Column) -> Column:
    """Vowels and specials are as many as moras."""
    return F.length(F.translate(code, I.CONSONANT_CODES, "")).cast("int")


def characters(code: Column) -> Column:
    return F.filter(F.split(code, ""), lambda c: c != "")


def symbols(code: Column) -> Column:
    """The phonemes as an array of symbols."""
    table = literal_map(I.SYMBOL)
    return F.transform(characters(code), lambda c: table[c])


def phonemes(reading: Column) -> Column:
    return symbols(codes(reading))


def moras(reading: Column) -> Column:
    """array<struct<kana, consonant, vowel, special>>; absent parts are null."""
    names = literal_map(I.SYMBOL)

    def one(kana: Column) -> Column:
        c = kana_codes(kana)
        last = F.substring(c, -1, 1)
        special = last.isin(*I.SPECIAL_CODES)
        return F.struct(
            kana.alias("kana"),
            F.when(F.length(c) == 2, names[F.substring(c, 1, 1)]).alias("consonant"),
            F.when(~special, last).alias("vowel"),
            F.when(special, last).alias("special"),
        )

    return F.transform(mora_kana(reading), one)


def vowel_skeleton(code: Column) -> Column:
    """Vowels, Q and N; R repeats the symbol before it, and is dropped at the beginning."""

    def fold(done: Column, c: Column) -> Column:
        kept = F.when(c.isin(*I.VOWEL_CODES, "Q", "N"), F.concat(done, c))
        return kept.when(c == "R", F.concat(done, F.substring(done, -1, 1))).otherwise(done)

    return F.aggregate(characters(code), F.lit(""), fold)


def ipa(code: Column) -> Column:
    """Q before a consonant doubles the first character of that consonant's IPA."""
    table = literal_map({I.CODE[s]: v for s, v in I.IPA.items()})
    firsts = literal_map({I.CODE[s]: I.IPA[s][0] for s in I.CONSONANTS})
    chars = characters(code)

    def one(c: Column, i: Column) -> Column:
        following = F.get(chars, i + 1)
        return F.when((c == "Q") & following.isin(*I.CONSONANT_CODES), firsts[following]).otherwise(table[c])

    return F.array_join(F.transform(chars, one), "")


def phoneme_string(code: Column) -> Column:
    return F.array_join(symbols(code), " ")


def pronunciation(reading: Column) -> Column:
    """struct<reading, phonemes, ipa, mora_count, moras, vowel_skeleton>."""
    code = codes(reading)
    return F.struct(to_katakana(reading).alias("reading"), symbols(code).alias("phonemes"), ipa(code).alias("ipa"), mora_count(code).alias("mora_count"), mora_kana(reading).alias("moras"), symbols(vowel_skeleton(code)).alias("vowel_skeleton"))


def is_pronounceable(reading: Column) -> Column:
    return reading.rlike(PRONOUNCEABLE)


def is_searchable(surface: Column) -> Column:
    return surface.rlike(SEARCHABLE)


def is_readable(surface: Column) -> Column:
    return ~surface.rlike(UNREADABLE)


def informativeness(surface: Column, reading: Column) -> Column:
    """0 for a surface that is its reading, 1 with a kanji, else 0.5."""
    return F.when(surface == reading, 0.0).when(surface.rlike(KANJI), 1.0).otherwise(0.5)


def round4(value: Column) -> Column:
    """Half up at four places, the same in every engine."""
    return F.floor(value * 10000 + 0.5) / 10000


def round3(value: Column) -> Column:
    return F.floor(value * 1000 + 0.5) / 1000


def familiarity(documents: Column, total: Column) -> Column:
    """A word's document frequency on a scale of 0 to 1; 0.25 for a word that isn't counted."""
    z = F.log10(documents / total * 1e6 + 1)
    return F.when(documents.isNull() | (documents <= 0), 0.25).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), z / 4.5)))
