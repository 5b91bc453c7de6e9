"""Stems of the words by which the rules were published, and of a table."""

from docsense.functions import stems

KNOWN = """caresses caress ponies poni ties tie cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat
troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat
conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ vileli vile
analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous
formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful
hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit
replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous
homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll dying die died die flies fli is is enjoy
enjoy by by news news theology theolog securities secur testing test security secur""".split()


def test_published_words():
    assert {w: stems.stem(w) for w in KNOWN[::2]} == dict(zip(KNOWN[::2], KNOWN[1::2]))
    assert stems.stem("") == "" and stems.stem("HOPPING") == "hop" and stems.stem("naïvely") == stems.stem("Naïvely")


def test_stems_of_a_table(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("testing",), ("tests",), (None,), ("test",)], "w string")
    assert sorted((r.w or "", r.s) for r in df.select("w", stems.stemmed(F.col("w")).alias("s")).collect()) == [("", None), ("test", "test"), ("testing", "test"), ("tests", "test")]
