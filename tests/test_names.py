"""Names out of listing titles."""

from pyspark.sql import functions as F

from shelfprice.functions import names

PLAIN = ["Norvale", "Quill Fern", "Harrow Pike", "Tarn & Tide", "Ostler's Gate"]
BEFORE = ["", "Віскі ", "Whisky ", "Бурбон ", "Виски "]
AFTER = ["", " 40%", " 0,7л", " 0.7 л 43%", " 12 років", " 12 y.o. 700 ml", ", в коробці", " 0,5л в тубусі", " + 2 склянки 0,7л", " з двома келихами", " (4820012345678)", " 1л х 6 шт", " Single Malt 46% 0,7л", " купажований, 40%, 1 л, в подарунковій упаковці"]
#: Cases that pin one rule each, with names of our own.
PAIRS = [
    ("Віскі Норвейл / Norvale", "Norvale"), ("Віскі Norvale / Норвейл 0,7л 40%", "Norvale"), ("Віскі Nоrvale 40%", "Norvale"), ("Норвейл Пік", None), ("Norvale (NAS)", "Norvale (NAS)"),
    ("Norvale -25% 0,7л", "Norvale -25%"), ("Віскі Norvale Bourbon Finish 40%", "Norvale Bourbon Finish"), ("Віскі Norvale Welsh 40% 0,7л", "Norvale"), ("Віскі Norvale Irish Moss 40%", "Norvale Irish Moss"),
    ("Norvale 12 yearly bottling", "Norvale 12 yearly bottling"), ("Віскі Norvale витримка 6 років 0.5 л", "Norvale"), ("Віскі Norvale + Quill Fern 0,7л", "Norvale + Quill Fern"), ("Tarn’s Norvale", "Tarn's Norvale"),
    ("Віскі Quill Fern Quill Fern 40%", "Quill Fern"), ("Віскі Norvale #7 20yo, 0.5 л", "Norvale #7"), (None, None), ("", None),
]


def by(spark, of, *rows):
    """The values of a column expression over rows of strings."""
    frame = spark.createDataFrame(list(enumerate_rows(rows)), "at int, " + ", ".join(f"c{i} string" for i in range(len(rows[0]))))
    return [r["out"] for r in frame.select("at", of(*[F.col(f"c{i}") for i in range(len(rows[0]))]).alias("out")).orderBy("at").collect()]


def enumerate_rows(rows):
    return ((i, *r) for i, r in enumerate(rows))


def test_decorated_names(spark):
    cases = [(before + name + after, name) for name in PLAIN for before in BEFORE for after in AFTER]
    got = by(spark, names.clean_name, *[(raw,) for raw, _ in cases])
    assert [(raw, g) for (raw, name), g in zip(cases, got, strict=True) if g != name] == []


def test_names(spark):
    got = by(spark, names.clean_name, *[(raw,) for raw, _ in PAIRS])
    assert [(raw, g, name) for (raw, name), g in zip(PAIRS, got, strict=True) if g != name] == []


def test_parts(spark):
    assert by(spark, names.balanced, ("a) (b (c",), ("(a) b",)) == ["a b c", "(a) b"]
    assert by(spark, names.bundle_parts, ("Norvale 0.7 л + Quill",), ("Norvale + 2 склянки",), ("Norvale",)) == [["Norvale 0.7 л", "Quill"], None, None]
    assert by(spark, names.without_stated_numbers, ("Norvale 17", "Norvale 17 yo 46%"), ("Tarn 46", "Tarn 46 47%"), ("12", "12 років"), ("Tarn 12.5% 46", "Tarn 12.5% 46%")) == ["Norvale", "Tarn 46", "12", "Tarn 12.5%"]
    assert by(spark, names.faithful, ("Quill Fern", "віскі Quill Fern 0.7"), ("Quill Other", "Quill Fern"), ("A", "A + B"), ("A + B", "A + B"), (" ", "x"), ("x" * 513, "x" * 600)) == [True, False, False, True, False, False]
    assert by(spark, names.without_repeats, ("Quill Fern Quill Fern 12 12",), ("Quill Quill",), ("Quill + Fern Quill + Fern",)) == ["Quill Fern 12", "Quill Quill", "Quill + Fern Quill + Fern"]


def test_distinct_titles(spark):
    titles = spark.createDataFrame([(r,) for r, _ in PAIRS * 2], "name string")
    cleaned = names.cleaned_names(titles)
    got = {r["raw"]: r["clean"] for r in cleaned.collect()}
    assert got == {r: n for r, n in PAIRS if r is not None}
    assert "Python" not in cleaned._jdf.queryExecution().executedPlan().toString() and "InArrow" not in cleaned._jdf.queryExecution().executedPlan().toString()
