"""Phoneme symbols: stress, classes, tips, IPA, and codes for built-in edit distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from speechjobs import constants as K


def table(values: dict) -> Column:
    """A literal map."""
    literal = lambda v: F.array(*map(F.lit, v)) if isinstance(v, tuple) else F.lit(v)
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), literal(v))])


def among(value: Column, values) -> Column:
    return F.coalesce(value.isin(list(values)), F.lit(False))


def strip_stress(symbol: Column) -> Column:
    return F.regexp_replace(symbol, "[012]+$", "")


def strip_all(symbols: Column) -> Column:
    return F.transform(symbols, strip_stress)


def stress_of(symbol: Column) -> Column:
    """The stress digit of a vowel; null for consonants."""
    return F.nullif(F.regexp_extract(symbol, "[012]$", 0), F.lit(""))


def tip(symbol: Column) -> Column:
    return F.coalesce(table(K.TIPS)[strip_stress(symbol)], F.concat(F.lit(K.DEFAULT_TIP[0]), symbol, F.lit(K.DEFAULT_TIP[1])))


def clarity_tips(symbols: Column) -> Column:
    """The first three distinct clarity tips of a target, or the general one."""
    found = F.array_distinct(F.array_compact(F.transform(symbols, lambda p: table(K.CLARITY)[strip_stress(p)])))
    return F.when(F.size(found) > 0, F.slice(found, 1, 3)).otherwise(F.array(F.lit(K.DEFAULT_CLARITY)))


def same_class(target: Column, heard: Column) -> Column:
    """Whether a sound may stand for the target: equal, both vowels, or consonants with a group in common."""
    partners = {c: tuple(dict.fromkeys(x for g in K.CONSONANT_GROUPS if c in g for x in g)) for g in K.CONSONANT_GROUPS for c in g}
    t, h = strip_stress(target), strip_stress(heard)
    return F.coalesce((t == h) | (t.isin(*K.VOWELS) & h.isin(*K.VOWELS)) | F.coalesce(F.array_contains(table(partners)[t], h), F.lit(False)), F.lit(False))


SYMBOLS = [*K.CONSONANTS, *(v + s for v in K.VOWELS for s in ("", "0", "1", "2"))]


def coded(symbols: Column) -> Column:
    """A string with one character for each symbol, so that the built-in levenshtein() counts symbols.

    Fixed symbols have a character each; any other symbol fails, rather than being taken for another one.
    """
    codes = table({s: chr(0x4E00 + i) for i, s in enumerate(SYMBOLS)})
    known = lambda s: F.coalesce(codes[s], F.raise_error(F.concat(F.lit("unknown symbol "), s)).cast("string"))
    return F.array_join(F.transform(symbols, known), "")


def edits(reference: Column, heard: Column, stress: bool = False) -> Column:
    """Edit distance of two phoneme sequences."""
    one, two = (reference, heard) if stress else (strip_all(reference), strip_all(heard))
    return F.levenshtein(coded(one), coded(two))


def from_ipa(ipa: Column) -> Column:
    """ARPABET symbols of a space-separated IPA transcription; stress marks stand before a sound, centring diphthongs
    give two symbols; an unknown sound fails."""

    def convert(token: Column) -> Column:
        mark = F.substring(token, 1, 1)
        stress = F.when(mark == "ˈ", "1").when(mark == "ˌ", "2")
        sound = F.when(stress.isNotNull(), F.substring(token, 2, 10)).otherwise(token)
        vowels = table(K.IPA_VOWELS)[sound]
        voiced = F.transform(vowels, lambda v, i: F.concat(v, F.when(i == 0, F.coalesce(stress, F.lit("0"))).otherwise("0")))
        failed = F.array(F.raise_error(F.concat(F.lit("unknown sound "), sound)).cast("string"))
        return F.coalesce(F.when(table(K.IPA_CONSONANTS)[sound].isNotNull(), F.array(table(K.IPA_CONSONANTS)[sound])), voiced, failed)

    return F.flatten(F.transform(F.filter(F.split(ipa, r"\s+"), lambda t: t != ""), convert))


def australian(british: Column, american: Column, word: Column) -> Column:
    """The Australian form derived from the British one: a short vowel before a nasal where American has AE, and schwa
    for weak short i."""
    trap = F.exists(american, lambda p: p.startswith("AE")) & ~among(word, K.AUSTRALIAN_LONG_A)

    def change(p: Column, i: Column) -> Column:
        after = F.get(british, i + 1)
        long_a = (p == "AA1") & among(after, ("N", "M")) & trap & (i + 2 < F.size(british))
        weak = (p == "IH0") & after.isNotNull() & ~among(after, K.KEEP_SHORT_I_BEFORE) & stress_of(after).isNull()
        return F.when(F.coalesce(long_a, F.lit(False)), "AE1").when(F.coalesce(weak, F.lit(False)), "AH0").otherwise(p)

    return F.transform(british, change)


def to_ipa(symbol: Column, british: Column) -> Column:
    base, weak = F.regexp_replace(symbol, "[012]$", ""), F.coalesce(stress_of(symbol) == "0", F.lit(False))
    rp = F.coalesce(F.when(weak, table(K.IPA_BRITISH_REDUCED)[base]), table(K.IPA_BRITISH)[base], table(K.IPA)[base], F.lower(base))
    ga = F.coalesce(F.when(weak, table(K.IPA_REDUCED)[base]), table(K.IPA)[base], F.lower(base))
    return F.when(british, rp).otherwise(ga)


def word_ipa(symbols: Column, accent: Column) -> Column:
    """IPA of a word, with stress marks where the stressed syllables start; one-vowel words have none.

    A syllable starts with the longest permitted cluster before its vowel, else with one consonant (never NG), and the
    first one with the word.
    """
    british = among(accent, K.NON_RHOTIC)
    bare = F.transform(symbols, lambda p: F.regexp_replace(p, "[012]$", ""))
    is_vowel = lambda i: stress_of(F.get(symbols, i)).isNotNull()

    def start(i: Column) -> Column:
        cluster = lambda n: F.array_join(F.slice(bare, i - n + 1, n), " ")
        free = lambda n: (i >= n) & F.forall(F.sequence(i - n, i - 1), lambda j: ~is_vowel(j))
        fits = lambda n: F.when(i >= n, free(n) & cluster(n).isin(*K.ONSETS))
        to_the_front = (i == 0) | F.forall(F.when(i > 0, F.sequence(F.lit(0), i - 1)), lambda j: ~is_vowel(j))
        one = F.when(i >= 1, free(1) & (F.get(bare, i - 1) != "NG"))
        return F.when(to_the_front, F.lit(0)).when(fits(3), i - 3).when(fits(2), i - 2).when(one, i - 1).otherwise(i)

    places = F.filter(F.transform(symbols, lambda p, i: F.when(stress_of(p).isin("1", "2"), F.struct(start(i).alias("at"), stress_of(p).alias("stress")))), lambda m: m.isNotNull())
    several = F.size(F.filter(symbols, lambda p: stress_of(p).isNotNull())) > 1

    def one(p: Column, i: Column) -> Column:
        marks = F.filter(places, lambda m: m["at"] == i)
        mark = F.when(several & (F.size(marks) > 0), F.when(F.element_at(marks, -1)["stress"] == "1", "ˈ").otherwise("ˌ")).otherwise("")
        return F.concat(mark, to_ipa(p, british))

    return F.array_join(F.transform(symbols, one), "")


def half_up(value: Column, digits: int) -> Column:
    """Round with halves upward, also below zero."""
    return F.floor(value * 10**digits + 0.5) / 10**digits
