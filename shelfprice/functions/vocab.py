"""Vocabularies of the text functions. Results depend on each word, blanks included."""

FLAVOR_KEYWORDS = {
    "peated": ["peat", "peated", "торф", "торф'ян", "торфян"],
    "smoky": ["smok", "дим", "димн"],
    "sherry": ["sherry", "хересн", "херес", "oloroso", "px ", "pedro ximenez"],
    "bourbon-cask": ["bourbon cask", "бурбонн", "ex-bourbon"],
    "vanilla": ["vanilla", "ваніл"],
    "honey": ["honey", "медов", "мед "],
    "fruity": ["fruit", "фрукт", "ягідн", "ягод"],
    "chocolate": ["chocolat", "шоколад", "какао"],
    "spicy": ["spic", "прян", "перц"],
    "floral": ["floral", "квітков", "квіток"],
    "citrus": ["citrus", "lemon", "orange", "цитрус", "лимон", "апельсин"],
    "nutty": ["nutty", "walnut", "almond", "горіх", "горіш", "мигдал"],
    "caramel": ["caramel", "toffee", "карамел", "ірис"],
    "oak": ["oak", "woody", "дуб", "дубов"],
    "maritime": ["maritime", "iodine", "sea salt", "йодист", "морськ"],
}
#: In order: the first type with a keyword in the text counts.
TYPE_KEYWORDS = {
    "single malt": ["односолодов", "single malt", "single-malt"],
    "blend": ["купажован", "бленд", "blended", "blend"],
    "grain": ["зернов", "grain"],
    "bourbon": ["бурбон", "bourbon"],
    "rye": ["житн", " rye", "rye "],
    "tennessee": ["tennessee", "теннессі", "теннесі"],
    "malt": ["солодов", "malt"],
}
COUNTRY_KEYWORDS = {
    "Шотландія": ["шотланд", "scotch", "scotland"],
    "Ірландія": ["ірланд", "irish", "ireland"],
    "Японія": ["япон", "japan"],
    "Канада": ["канад", "canad"],
    "Індія": ["інді", "india"],
    "США": ["kentucky", "кентуккі", "american whiskey", "теннессі", "tennessee"],
    "Англія": ["англійськ", "english whisky"],
    "Уельс": ["уельс", "welsh"],
    "Тайвань": ["тайван", "taiwan"],
}
UMBRELLA_COUNTRIES = ["великобританія", "велика британія", "сполучене королівство", "uk"]

BRAND_JUNK = ["no brand", "nobrand", "none", "unknown"]
BRAND_ALIASES = {
    "тормор": "Tormore", "клайнліш": "Clynelish", "лонгморн": "Longmorn", "капердонік": "Caperdonich", "гленлоссі": "Glenlossie", "буффало трейс": "Buffalo Trace",
    "кроу роял": "Crown Royal", "ірішмен": "The Irishman", "пайп меідже": "Pipe Major",
}
BRAND_SPELLINGS = {
    "ancnoc": "AnCnoc", "an cnoc": "AnCnoc", "benriach": "BenRiach", "glenaladale": "GlenAladale", "clan macgregor": "Clan MacGregor", "gordon macphail": "Gordon & MacPhail",
    "gordon & macphail": "Gordon & MacPhail", "macarthur s": "MacArthur's", "mcclelland s": "McClelland's", "mcconnell s": "McConnell's", "mcgibbon s": "McGibbon's",
    "mcivor": "McIvor", "few": "FEW", "tbwc": "TBWC", "pure kentucky xo": "Pure Kentucky XO", "vat 69": "VAT 69",
}
#: Words and word beginnings that say what a product is, not which one.
KEY_STOP_WORDS = [
    "віскі", "виски", "whisky", "whiskey", "лікер", "liqueur", "scotch", "scotland", "ireland", "tennessee", "single", "malt", "blend", "blended", "gift", "box", "gb", "set",
    "the", "of", "and", "та", "із", "мл", "ml",
]
KEY_STOP_STEMS = [
    "односолодов", "купажован", "солодов", "однозернов", "зернов", "житн", "бленд", "коробц", "коробк", "коробочц", "подарунков", "сувенірн", "упаковц", "упаковк", "пакуванн",
    "туб", "футляр", "витримк", "витриман",
]
