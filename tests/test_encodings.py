import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from storyflow.functions import encodings

RUSSIAN = "Это был обычный вечер в небольшом городе. Она сидела у окна и читала письмо. Ёжик ушёл домой, а Пётр остался."
GERMAN = "Die Bären größer als früher; für übermütige Mädchen – „schön“, sagte Jürgen. Weiß der Kuckuck, was würde."
FRENCH = "L’élève était très fâché à l’école, où ça n’a pas été drôle… Noël déjà."
SPANISH = "El niño no podía dormir después de la canción; mañana será otro día más."


@pytest.mark.parametrize("text, name", [(RUSSIAN, "windows-1251"), (RUSSIAN, "koi8-r"), (RUSSIAN, "cp866"), (RUSSIAN, "iso-8859-5"), (GERMAN, "windows-1252"), (FRENCH, "windows-1252"), (SPANISH, "windows-1252"), (SPANISH, "cp850"), (RUSSIAN, "utf-8"), (RUSSIAN, "utf-16"), (GERMAN, "utf-16-le"), (FRENCH, "utf-16-be"), ("plain", "ascii"), ("", "ascii")])
def test_detection(text, name):
    found, sure = encodings.detected(text.encode(name))
    assert found == name and sure > 0.9
    assert encodings.decode(text.encode(name), ["auto"]) == text


def test_cascade():
    assert encodings.decode("é".encode()) == "é"
    assert encodings.decode("é’".encode("cp1252")) == "é’"
    assert encodings.decode(b"\x81\x8d a") == "\x81\x8d a"
    assert encodings.decode(b"ab\xff\xfec", ["utf-8"]) == "abc"
    assert encodings.decode(b"ab\xc3\xa9\xffc", ["utf-8:ignore", "latin-1"]) == "abéc"
    assert encodings.decode(b"a\xe9", ["nonsense", "auto:ignore", "cp1252"]) == "aé"
    assert encodings.decode(RUSSIAN.encode("cp1251"), ["utf-8", "auto", "windows-1252"]) == RUSSIAN
    # Two letters are too few to be sure.
    assert encodings.detected(b"x\xe0\xeb")[1] < 0.99


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=60), st.lists(st.sampled_from(["utf-8", "auto", "cp1252", "utf-16", "utf-8:ignore", "x", "koi8-r"]), max_size=4))
def test_never_fails(data, names):
    assert isinstance(encodings.decode(data, names), str)
    assert 0 <= encodings.detected(data)[1] <= 1


def test_columns(spark):
    rows = spark.createDataFrame([(RUSSIAN.encode("cp1251"),), (RUSSIAN.encode(),), (b"",), (None,), (b"\x81",)], "b binary")
    got = [r.t for r in rows.select(encodings.decoded(F.col("b"), ("utf-8", "auto", "cp1252")).alias("t")).collect()]
    assert got == [RUSSIAN, RUSSIAN, "", None, ""]
    assert rows.select(encodings.guessed(F.col("b")).alias("g")).first().g.encoding == "windows-1251"
