"""Readings of Japanese lines: overrides, suspicious spots, kana to phones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import HIRAGANA, KATAKANA

VOWELS = "aiueo"
# Rows of the kana table by consonant; `-` has no kana.
ROWS = {
    "": "あいうえお", "k": "かきくけこ", "s": "さ-すせそ", "t": "た--てと", "n": "なにぬねの", "h": "はひ-へほ", "m": "まみむめも", "y": "や-ゆ-よ", "r": "らりるれろ", "w": "わ----",
    "g": "がぎぐげご", "z": "ざ-ずぜぞ", "d": "だ--でど", "b": "ばびぶべぼ", "p": "ぱぴぷぺぽ", "sh": "-し---", "ch": "-ち---", "ts": "--つ--", "f": "--ふ--", "j": "-じ---",
}
# What a kana before a small ya, yu or yo becomes, and other contracted pairs.
CONTRACTED = {"き": "ky", "し": "sh", "ち": "ch", "に": "ny", "ひ": "hy", "み": "my", "り": "ry", "ぎ": "gy", "じ": "j", "び": "by", "ぴ": "py"}
FOREIGN = {"ふぁ": "f a", "ふぃ": "f i", "ふぇ": "f e", "ふぉ": "f o", "てぃ": "ty i", "でぃ": "dy i", "つぁ": "ts a", "つぃ": "ts i", "つぇ": "ts e", "つぉ": "ts o", "うぃ": "w i", "うぇ": "w e", "うぉ": "w o", "ゔぁ": "v a", "ゔぃ": "v i", "ゔぇ": "v e", "ゔぉ": "v o"}
SINGLE = {"ん": "N", "っ": "cl", "ぢ": "j i", "づ": "z u", "ゔ": "v u", "ゐ": "i", "ゑ": "e", "を": "o", "ぁ": "a", "ぃ": "i", "ぅ": "u", "ぇ": "e", "ぉ": "o"}
PRONOUN = r"(^|[\s、。！？はがをにともへで])君(?=(?:自身|たち|達|ら)?(?:は|が|を|に|の|も|と|へ|で|$))"


def kana_table() -> dict[str, str]:
    """Kana, and pairs of them, to phones parted by spaces."""
    out = dict(FOREIGN) | SINGLE
    for consonant, row in ROWS.items():
        out |= {kana: f"{consonant} {vowel}".strip() for kana, vowel in zip(row, VOWELS, strict=True) if kana != "-"}
    for kana, consonant in CONTRACTED.items():
        out |= {kana + small: f"{consonant} {vowel}" for small, vowel in zip("ゃゅょ", "auo", strict=True)}
    return out


def kana_to_phones(reading: Column) -> Column:
    """struct(phones array<string>, error string). Pairs go before single kana, katakana count as hiragana, a long
    mark repeats the last vowel, white space and marks are passed over, anything else is an error."""
    table = kana_table()
    plain = F.translate(reading, KATAKANA, HIRAGANA)
    pairs = "|".join(k for k in table if len(k) == 2)
    parts = F.regexp_extract_all(plain, F.lit(f"(?s){pairs}|."), F.lit(0))
    known = F.create_map(*[F.lit(x) for item in table.items() for x in item])
    odd = lambda x: ~x.rlike(r"^[\s\p{P}\p{S}]$")
    start = F.struct(F.array().cast("array<string>").alias("phones"), F.lit(None).cast("string").alias("vowel"), F.lit(None).cast("string").alias("error"))

    def step(acc: Column, x: Column) -> Column:
        here = F.try_element_at(known, x)
        new = F.when(here.isNotNull(), F.split(here, " ")).when((x == "ー") & acc["vowel"].isNotNull(), F.array(acc["vowel"])).otherwise(F.array().cast("array<string>"))
        last = F.when(F.size(new) > 0, F.element_at(new, -1))
        vowel = F.when(last.isin(*VOWELS), last).otherwise(acc["vowel"])
        wrong = F.when((x == "ー") & acc["vowel"].isNull(), F.lit("long_mark_without_vowel")).when(here.isNull() & (x != "ー") & odd(x), F.concat(F.lit("unknown:"), x))
        return F.struct(F.concat(acc["phones"], new).alias("phones"), vowel.alias("vowel"), F.coalesce(acc["error"], wrong).alias("error"))

    # only long marks need to know what went before them
    folded = F.aggregate(parts, start, step, lambda acc: F.struct(acc["phones"].alias("phones"), acc["error"].alias("error")))
    each = F.transform(parts, lambda x: F.struct(x.alias("kana"), F.try_element_at(known, x).alias("phones")))
    joined = F.array_join(F.transform(each, lambda x: x["phones"]), " ")
    unknown = F.get(F.filter(each, lambda x: x["phones"].isNull() & odd(x["kana"])), F.lit(0))["kana"]
    apart = F.struct(F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, " ")).alias("phones"), F.concat(F.lit("unknown:"), unknown).alias("error"))
    return F.when(F.contains(plain, F.lit("ー")), folded).otherwise(apart)


def common_reading(text: Column, readings: dict[str, str]) -> Column:
    """The text with known words read, the longest first, and the pronoun by its context."""
    for word in sorted(readings, key=len, reverse=True):
        text = F.replace(text, F.lit(word), F.lit(readings[word]))
    return F.regexp_replace(text, PRONOUN, "$1きみ")


def reading_hits(text: Column, readings: dict[str, str]) -> Column:
    """The words found; one inside a longer one that was found does not count again."""
    hits, longer = [], []
    for word in sorted(readings, key=len, reverse=True):
        held = [w for w in longer if word in w]
        inside = F.lit(False)
        for w in held:
            inside = inside | F.contains(text, F.lit(w))
        hits.append(F.when(F.contains(text, F.lit(word)) & ~inside, F.lit(word)))
        longer.append(word)
    return F.array_compact(F.array(*hits, F.when(text.rlike(PRONOUN), F.lit("君"))))


def pronunciation_suspects(text: Column, readings: dict[str, str]) -> Column:
    """Why a line's reading needs a look: Latin letters or digits left, or kanji with katakana beside them."""
    rest = text
    for word in sorted(readings, key=len, reverse=True):
        rest = F.replace(rest, F.lit(word), F.lit(""))
    return F.array_compact(F.array(F.when(rest.rlike("[A-Za-z0-9]"), "latin_or_digits"), F.when(text.rlike("[一-龥々〆ヵヶ]+[ /／]+[ァ-ヶー]+"), "double_writing")))
