from pyspark.sql import functions as F

from cueframe.functions import reading


def test_kana(spark):
    cases = {"きゃっとー": ("ky a cl t o o", None), "シャツ、ん": ("sh a ts u N", None), "ー": ("", "long_mark_without_vowel"), "あ漢": ("a", "unknown:漢"), "": ("", None)}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: (" ".join(r.p.phones), r.p.error) for r in df.select("t", reading.kana_to_phones(F.col("t")).alias("p")).collect()}
    assert got == cases


def test_every_kana():
    """Each key of the fixed table, by rows of the syllabary."""
    rows = {
        "あいうえお": "a i u e o", "かきくけこ": "k a,k i,k u,k e,k o", "さしすせそ": "s a,sh i,s u,s e,s o", "たちつてと": "t a,ch i,ts u,t e,t o", "なにぬねの": "n a,n i,n u,n e,n o",
        "はひふへほ": "h a,h i,f u,h e,h o", "まみむめも": "m a,m i,m u,m e,m o", "やゆよ": "y a,y u,y o", "らりるれろ": "r a,r i,r u,r e,r o", "わゐゑを": "w a,i,e,o", "がぎぐげご": "g a,g i,g u,g e,g o",
        "ざじずぜぞ": "z a,j i,z u,z e,z o", "だぢづでど": "d a,j i,z u,d e,d o", "ばびぶべぼ": "b a,b i,b u,b e,b o", "ぱぴぷぺぽ": "p a,p i,p u,p e,p o", "ゔんっ": "v u,N,cl", "ぁぃぅぇぉ": "a i u e o",
    }
    want = {k: v for kana, phones in rows.items() for k, v in zip(kana, phones.split(",") if "," in phones else phones.split(), strict=True)}
    for first, consonant in zip("きしちにひみりぎじびぴ", "ky sh ch ny hy my ry gy j by py".split(), strict=True):
        want |= {first + small: f"{consonant} {v}" for small, v in zip("ゃゅょ", "auo", strict=True)}
    for first, consonant, vowels in (("ふ", "f", "aieo"), ("て", "ty", "i"), ("で", "dy", "i"), ("つ", "ts", "aieo"), ("う", "w", "ieo"), ("ゔ", "v", "aieo")):
        want |= {first + dict(zip("aieo", "ぁぃぇぉ", strict=True))[v]: f"{consonant} {v}" for v in vowels}
    assert reading.kana_table() == want and len(want) == 130


def test_readings(spark):
    words = {"危惧種": "きぐしゅ", "絶滅危惧種": "ぜつめつきぐしゅ"}
    df = spark.createDataFrame([("絶滅危惧種と君は",), ("危惧種 A",), ("諸君",), ("空 ソラ",)], "t string")
    got = [(r.a, r.b, r.c) for r in df.select(reading.common_reading(F.col("t"), words).alias("a"), reading.reading_hits(F.col("t"), words).alias("b"), reading.pronunciation_suspects(F.col("t"), words).alias("c")).collect()]
    assert got == [("ぜつめつきぐしゅときみは", ["絶滅危惧種", "君"], []), ("きぐしゅ A", ["危惧種"], ["latin_or_digits"]), ("諸君", [], []), ("空 ソラ", [], ["double_writing"])]
