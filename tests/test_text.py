import re
import unicodedata

from pyspark.sql import functions as F

from evidencelake.functions import text

SAMPLES = [
    "Maçã é Ótima", "STRASSE straße", "PX-101 10.5 v2", "ﬁm ½ ㎏", "İstanbul", "x́y", "", "  a b\tc ",
    "Ελλάδα ΟΔΟΣ", "ångström Ñandú", "𝐚𝐛", "naïve—café", "plain ascii",
]


def column(spark, build):
    rows = [(i, s) for i, s in enumerate(SAMPLES)]
    df = spark.createDataFrame(rows, "i int, s string")
    return [r[0] for r in df.select(build(F.col("s"))).orderBy("i").collect()]


def unicode_fold(value):
    """Independent statement of the fold, by whole-text normalization."""
    return "".join(filter(lambda c: not unicodedata.combining(c), unicodedata.normalize("NFKD", value.casefold())))


def test_fold_matches_the_unicode_definition(spark):
    assert column(spark, text.fold) == [unicode_fold(s) for s in SAMPLES]


def test_sharp_s_and_marked_rows_fold_like_the_rest(spark):
    rows = ["Straße ẞ", "große ﬁrma ½", "ß", "a\ufdd0b é", "\ufdd0", "ß\ufdd0ﬀÉ"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(rows)], "i int, s string")
    assert [r[0] for r in df.select("i", text.fold(F.col("s")).alias("f")).orderBy("i").select("f").collect()] == [unicode_fold(s) for s in rows]


def test_a_text_without_several_letter_signs_is_translated_once(spark):
    """Such texts are told from others by the translated text itself; a second translation is a look-up a character."""
    plan = spark.createDataFrame([("é",)], "s string").select(text.fold(F.col("s")))._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(array(translate(" in plan and "length(translate(" not in plan


def test_every_foldable_character_inside_a_word(spark):
    wide = [c for c in map(chr, range(0x80, 0x20000)) if unicodedata.decomposition(c) and not 0xAC00 <= ord(c) < 0xD7A4 and not 0xF900 <= ord(c) < 0xFB00]
    df = spark.createDataFrame([(c, f"a{c}b1") for c in wide], "c string, s string")
    got = {r[0]: r[1] for r in df.select("c", text.fold(F.col("s"))).collect()}
    assert {c: got[c] for c in wide if got[c] != unicode_fold(f"a{c}b1")} == {}


def test_tokens_hold_ligatures_and_fractions_together(spark):
    df = spark.createDataFrame([("certi\ufb01cado e\ufb03caz 5\u33a1",)], "s string")
    assert df.select(text.tokens(F.col("s"))).first()[0] == ["certificado", "efficaz", "5m2"]


def test_tokens_keep_codes_and_numbers(spark):
    got = column(spark, text.tokens)
    assert got[2] == ["px-101", "10.5", "v2"]
    assert got[0] == ["maca", "e", "otima"]
    assert got[6] == []


def test_normalizers_stay_different(spark):
    df = spark.createDataFrame([("O Código px-101, da  REGRA",)], "s string")
    row = df.select(
        text.content_tokens(F.col("s")).alias("c"),
        text.answer_text(F.col("s")).alias("a"),
        text.label_text(F.col("s")).alias("l"),
        text.collapse_blanks(F.col("s")).alias("b"),
    ).first()
    assert row.c == ["codigo", "px", "101", "regra"]
    assert row.a == "o codigo px-101 da regra"
    assert row.l == "o codigo px 101 da regra"
    assert row.b == "O Código px-101, da REGRA"


def test_blank_collapse_equals_split_and_join(spark):
    got = column(spark, text.collapse_blanks)
    assert got == [" ".join(s.split()) for s in SAMPLES]


def test_token_estimates(spark):
    got = column(spark, text.byte_tokens)
    assert got == [-(-len(s.encode()) // 4) for s in SAMPLES]
    words = column(spark, text.word_tokens)
    assert words == [len(s.split()) for s in SAMPLES]


def test_strip_marks_keeps_case(spark):
    got = column(spark, text.strip_marks)
    assert got[0] == "Maca e Otima"
    assert re.fullmatch(r"\s*a\s+b\s+c\s*", got[7])
