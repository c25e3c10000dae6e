r"""Product names without their specification: pack size, strength, age, packaging, category words, accessories.

A title becomes a string of tokens, each spelled as its class, whether it follows a blank or the token
before it, its text, and a separator: ``w Norvale␟d 0,7␟w_л␟``. Rules are patterns over such sequences,
built from atoms for tokens of a class or of given words, and all of them are column expressions: a title
never leaves the JVM. Classes: n whole number, d number with a fraction, w word, k what is kept as it
stands (#7, -25%), p percent sign, a plus, b and e brackets, o any other character.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Latin letters and the Cyrillic ones that look like them.
LOOK_ALIKES = {
    "a": "а", "c": "с", "e": "е", "i": "і", "o": "о", "p": "р", "x": "х", "y": "у",
    "A": "А", "B": "В", "C": "С", "E": "Е", "H": "Н", "I": "І", "K": "К", "M": "М", "O": "О", "P": "Р", "T": "Т", "X": "Х", "Y": "У",
}
#: Words for what a product is; a star stands for any further letters.
CATEGORIES = (
    "kentucky straight bourbon whiskey", "kentucky straight bourbon", "kentucky straight", "tennessee whiskey", "blended scotch whisky", "blended malt scotch whisky", "single malt scotch whisky",
    "straight bourbon whiskey", "straight rye whiskey", "single pot still", "blended scotch", "single malt", "single grain", "blended malt", "blended grain", "straight bourbon", "straight rye",
    "rye whiskey", "rye whisky", "pure malt", "scotch whisky", "scotch", "blended", "bourbon", "whiskey", "whisky", "віскі", "віски", "односолодов*", "купажован*", "солодов*", "однозернов*", "зернов*",
    "житн*", "бленд*", "бурбон", "шотландськ*", "ірландськ*", "американськ*", "японськ*", "індійськ*", "канадськ*", "уельс*",
)
#: Origins, dropped only at a name's end.
ORIGINS = ("welsh", "irish", "scottish", "japanese", "canadian", "indian", "american")
#: What follows a cask word that belongs to the name.
CASK_TAILS = ("finish", "cask", "casks", "barrel", "barrels", "butt", "butts", "hogshead", "hogsheads", "puncheon", "wood", "oak", "matured", "maturation")
#: Countries that a name may state in brackets.
COUNTRIES = ("Франція", "Шотландія", "Ірландія", "Словаччина", "Іспанія", "Японія", "Індія", "Канада", "США", "Англія", "Німеччина", "Італія", "Польща", "Уельс")
#: Words for what comes along with a bottle, kinds of packaging, packaging; English packaging as phrases.
ACCESSORIES = (
    "келих*", "склянк*", "стакан*", "чарк*", "бокал*", "фляг*", "тумблер*", "костер*", "ложк*", "джигер*", "підставк*", "гойдалк*", "кава*", "каву*", "кави*", "каві*", "набір склянок*",
    "glass*", "tumbler*", "coffee*", "cola*",
)
PACK_KINDS = ("подарунков*", "сувенірн*", "дерев'ян*", "деревян*", "металев*", "картонн*", "пластиков*", "фірмов*", "святков*", "оригінальн*", "престижн*")
PACKS = ("коробц*", "коробк*", "упаковц*", "упаковк*", "пакуванн*", "пакован*", "пак", "туб*", "футляр*", "бляшанц*", "бляшанк*", "набір*", "набор*")
GIFTS = ("gift box", "gift tube", "gift pack", "gift set", "giftbox", "wooden box", "metal box", "metal tin", "tube", "tin box")
#: Words of age, of volume, of counts, and prepositions that say nothing at a name's end.
YEARS = ("рік", "роки", "років", "лет", "года", "год", "year", "years")
UNITS = ("л", "l", "мл", "ml", "літр")
ENDINGS = ("ти", "ми", "ох", "ма", "х")
NUMERALS = ("одн*", "дв*", "тр*", "чотир*", "п'ят*")
DANGLING = ("від", "в", "у", "з", "із", "с", "та", "на", "до", "по")

_S = "\x1f"
_LOW, _LETTERS = "а-яіїєґ", "A-Za-zа-яіїєґА-ЯІЇЄҐ"
_CYRILLIC = "а-яіїєґА-ЯІЇЄҐ"


def _token(classes: str, text: str = f"[^{_S}]*") -> str:
    """A token of one of the classes, with a text of the pattern."""
    return f"[{classes}][_ ]{text}{_S}"


def _words(phrases: tuple) -> str:
    """Any of the phrases, as tokens; the first that fits, so longer ones are named first."""
    one = lambda word: _token("w", "(?iu:" + word.rstrip("*") + (f"[{_LOW}a-z']*" if word.endswith("*") else "") + ")")
    return "(?:" + "|".join("".join(map(one, phrase.split())) for phrase in phrases) + ")"


_NUMBER, _WHOLE, _OPEN, _CLOSE = _token("nd"), _token("n"), _token("b"), _token("e")
_DASH, _SLASH = _token("o", "[-–—‑]"), f"o /{_S}(?=[a-z] )"
_UNIT, _TIMES = _words(UNITS), _token("w", "[xхXХ]")
_PIECES = f"{_words(('шт',))}(?:{_token('o', '[.]')})?"
_COUNT = f"{_WHOLE}(?:{_DASH})?(?:{_words(ENDINGS)})?"
_YEAR = f"(?:{_words(YEARS)}|{_token('w', '(?iu:[yу][.]?[oо][.]?)')})"
_AGE = f"{_NUMBER}(?:{_DASH})?(?:{_words(ENDINGS)})?{_YEAR}(?:{_words(('витримки', 'old'))})?"
_STRENGTH = f"{_NUMBER}(?:{_DASH}{_NUMBER})?{_token('p')}"
_VOLUME = f"{_NUMBER}{_UNIT}"
_PACKAGING = f"(?:(?:{_words(('в', 'у', 'во'))})?(?:{_words(PACK_KINDS)})?{_words(PACKS)}|{_words(GIFTS)})"
_MULTIPACK = f"(?:{_NUMBER}(?:{_UNIT})?{_TIMES}{_WHOLE}(?:{_PIECES})?|{_WHOLE}{_PIECES}(?:{_TIMES}(?:{_NUMBER}(?:{_UNIT})?)?)?|{_TIMES}{_WHOLE}(?:{_PIECES})?)"
_ACCESSORY = _words(ACCESSORIES)
_SET_PART = f"{_token('a')}(?:{_token('b-z')})*?{_ACCESSORY}.*$"
_WITH = f"{_words(('з', 'із', 'с', 'та'))}(?:{_COUNT}|{_words(NUMERALS)})?{_ACCESSORY}.*$"
_CATEGORY = f"(?:{_words(tuple(c for c in CATEGORIES if c not in ('bourbon', 'бурбон')))}|{_words(('bourbon', 'бурбон'))}(?!{_words(CASK_TAILS)}))"
_CODE = f"{_OPEN}(?!n[_ ](?:19|20)[0-9]{{2}}{_S}e)(?=(?:[^0-9e]*[0-9]){{4}})(?:{_token('ndok')}|{_token('w', f'[A-ZА-ЯІЇЄҐ]+')})+{_CLOSE}"
_EDGE = f"(?:{_token('o', '[,;./–—-]')}|{_token('a')})"

#: What goes, in this order, each as a sequence of tokens.
_DROPPED = (
    _SET_PART, _WITH, f"{_OPEN}{_MULTIPACK}{_CLOSE}", _MULTIPACK, f"{_WHOLE}{_TIMES}$", f"{_words(('від',))}{_COUNT}{_words(('до',))}{_COUNT}{_words(('років', 'роки', 'року'))}", _AGE,
    f"(?<={_S})n [0-9]{{1,2}}{_S}(?={_words(('віскі', 'віски', 'бурбон'))})", f"{_words(('витримк*', 'витриман*'))}|{_words(('витрим',))}{_token('o', '[.]')}", _VOLUME, _PACKAGING,
    f"(?:{_words(('дизайн етикетки',))})?{_words(('в асортименті',))}", f"{_OPEN}n[_ ][0-9]{{1,2}}{_S}{_CLOSE}", f"{_OPEN}{_words(COUNTRIES)}{_CLOSE}", _STRENGTH,
)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once."""
    return F.transform(F.array(value), lambda v: then(v))[0]


def _one_script(word: Column) -> Column:
    """A word in two alphabets in the one that most of its letters are of, if all others have a look-alike there."""
    size = lambda c, letters: F.length(F.regexp_replace(c, f"[^{letters}]", ""))
    latin, cyrillic = "".join(LOOK_ALIKES), "".join(LOOK_ALIKES.values())
    a, b = size(word, "A-Za-z"), size(word, _CYRILLIC)
    to_latin, to_cyrillic = F.translate(word, cyrillic, latin), F.translate(word, latin, cyrillic)
    return (
        F.when((a == 0) | (b == 0) | (a == b), word).when(a > b, F.when(size(to_latin, _CYRILLIC) == 0, to_latin).otherwise(word))
        .otherwise(F.when(size(to_cyrillic, "A-Za-z") == 0, to_cyrillic).otherwise(word))
    )


def tokens(title: Column) -> Column:
    """A title as a string of tokens; curly apostrophes and quotes made plain, words of two alphabets of one."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(title, "[‘’ʼ`´]", "'"), f'["«»“”„{_S}]', " "), "_dup[A-Za-z0-9]+", "")
    kinds = "|".join((
        r"[#№][0-9]+", r"(?<=\s)[-−–][0-9]+(?:[.,][0-9]+)?\s*%", r"[0-9]+(?:[.,/][0-9]+)?", rf"(?<=[0-9]\s?)[yYуУ][.]?[oOоО][.]?(?![{_LETTERS}])",
        rf"[{_LETTERS}]+(?:'[{_LETTERS}]+)*", r"[^\s]",
    ))

    def spelled(found: Column) -> Column:
        def of(text: Column) -> Column:
            kind = (
                F.when(text.rlike("^[#№][0-9]|^[-−–][0-9]"), "k").when(text.rlike("^[0-9]+$"), "n").when(text.rlike("^[0-9]"), "d").when(text == "%", "p").when(text == "+", "a")
                .when(text == "(", "b").when(text == ")", "e").when(text.rlike(f"^[{_LETTERS}]"), "w").otherwise("o")
            )
            return F.concat(kind, F.when(found.rlike(r"^\s"), " ").otherwise("_"), F.when(kind == "w", _one_script(text)).otherwise(text), F.lit(_S))

        return _let(F.trim(F.regexp_replace(found, r"\s+", " ")), of)

    return F.array_join(F.transform(F.regexp_extract_all(plain, F.lit(rf"(\s*(?:{kinds}))"), 1), spelled), "")


def text_of(spelled: Column) -> Column:
    """Tokens as text again."""
    return F.trim(F.regexp_replace(F.regexp_replace(spelled, f"[a-z] ([^{_S}]*){_S}", " $1"), f"[a-z]_([^{_S}]*){_S}", "$1"))


def _listed(spelled: Column) -> Column:
    return F.regexp_extract_all(spelled, F.lit(f"([a-z][_ ][^{_S}]*{_S})"), 1)


def _balanced(spelled: Column) -> Column:
    """Without brackets that have no partner; of too many that open the last ones go."""
    kind = lambda t: F.substring(t, 1, 1)
    gone = lambda t: F.concat(F.lit("z"), F.substring(t, 2, 1), F.lit(_S))
    none = F.array().cast("array<string>")

    def closes(state: Column, t: Column) -> Column:
        lost = (kind(t) == "e") & (state["open"] == 0)
        step = F.when(kind(t) == "b", 1).when((kind(t) == "e") & (state["open"] > 0), -1).otherwise(0)
        return F.struct((state["open"] + step).alias("open"), F.array_append(state["kept"], F.when(lost, gone(t)).otherwise(t)).alias("kept"))

    def opens(state: Column, t: Column) -> Column:
        lost = (kind(t) == "b") & (state["open"] > 0)
        return F.struct((state["open"] - lost.cast("int")).alias("open"), F.array_append(state["kept"], F.when(lost, gone(t)).otherwise(t)).alias("kept"))

    first = F.aggregate(_listed(spelled), F.struct(F.lit(0).alias("open"), none.alias("kept")), closes)
    second = _let(first, lambda s: F.aggregate(F.reverse(s["kept"]), F.struct(s["open"].alias("open"), none.alias("kept")), opens))
    # The blank before a bracket that goes is the next token's.
    out = _drop(_drop(F.array_join(F.reverse(second["kept"]), ""), f"z {_S}([a-y])_", "$1 "), f"z[_ ]{_S}")
    return F.when(spelled.rlike(f"(?:^|{_S})[be]"), out).otherwise(spelled)


def _drop(spelled: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(spelled, pattern, by)


def _tidy(spelled: Column) -> Column:
    """Commas, brackets and what stands loose at the ends put right."""
    mark = _token("o", "[,;–—-]")
    out = _drop(_drop(_drop(spelled, f"({_OPEN})(?:{mark})+", "$1"), f"(?:{mark})+({_CLOSE})", "$1"), f"{_OPEN}{_CLOSE}")
    out = _drop(_drop(_balanced(out), f"(?:o[_ ],{_S})+([a-z])[_ ]", "$1 "), f"(?:o[_ ],{_S})+$")
    return _drop(_drop(out, f"^(?:{_EDGE})+"), f"(?:{_EDGE}|(?<={_S}){_words(DANGLING)})+$")


def _without_descriptors(spelled: Column) -> Column:
    """Category words go anywhere, origins at the end; a name that would have no letter left stays as it is."""
    bare = _drop(_tidy(_drop(spelled, _CATEGORY)), f"{_words(ORIGINS)}+$")
    return _let(bare, lambda b: F.when(b.rlike(_token("w")), b).otherwise(spelled))


def _latin_side(spelled: Column) -> Column:
    """Whether most words beside the specification are Latin."""
    rest = spelled
    for pattern in (_CATEGORY, _words(ORIGINS), _STRENGTH, _VOLUME, _PACKAGING):
        rest = _drop(rest, pattern)
    words = F.regexp_extract_all(rest, F.lit(f"w[_ ]([^{_S}]*){_S}"), 1)
    return 2 * F.size(F.filter(words, lambda w: w.rlike("[A-Za-z]"))) > F.size(words)


def _one_side(spelled: Column) -> Column:
    """Of a name given in two alphabets around a slash between blanks the Latin side; other such names become one."""
    joined = _drop(spelled, _SLASH)

    def choose(sides: Column) -> Column:
        first, second = _latin_side(sides[0]), _latin_side(sides[1])
        return F.when((F.size(sides) == 2) & first & ~second, sides[0]).when((F.size(sides) == 2) & second & ~first, sides[1]).otherwise(joined)

    return F.when(spelled.rlike(_SLASH), _let(F.concat(F.split(spelled, _SLASH), F.array(F.lit(""))), lambda s: choose(F.slice(s, 1, F.size(s) - 1)))).otherwise(spelled)


def _without_repeats(spelled: Column) -> Column:
    """A phrase that follows itself goes once; a single word only if it is a number; sets with + stay."""
    return _drop(_drop(spelled, f"(?iu)((?:{_token('b-z')}){{2,}})\\1", "$1"), f"(n[_ ][0-9]+{_S})\\1", "$1")


def _one_pass(spelled: Column) -> Column:
    out = _one_side(_drop(spelled, _CODE))
    for pattern in _DROPPED:
        out = _drop(out, pattern)
    return _without_repeats(_tidy(_let(out, _without_descriptors)))


def clean_name(title: Column, passes: int = 3) -> Column:
    """The name that a listing's title holds; null where nothing is left. What one pass uncovers, the next one drops."""
    out = _drop(_one_side(tokens(F.concat(F.lit(" "), title))), f"^(?:[a-z][_ ][^0-9A-Za-z{_S}]*{_S})+")
    for _ in range(passes):
        out = _let(out, _one_pass)
    return F.nullif(text_of(out), F.lit(""))


def _bottles(title: Column) -> Column:
    return _drop(_drop(_drop(tokens(F.concat(F.lit(" "), title)), _CODE), _SET_PART), _WITH)


def bundle_parts(title: Column) -> Column:
    """The bottles that a set joins by +, two or more, without what comes along with them; else null."""
    parts = F.filter(F.transform(F.split(_bottles(title), _token("a")), text_of), lambda p: p != "")
    return _let(parts, lambda p: F.when(F.size(p) > 1, p))


def balanced(text: Column) -> Column:
    """The text without brackets that have no partner."""
    return text_of(_balanced(tokens(text)))


def without_repeats(text: Column) -> Column:
    return text_of(_without_repeats(tokens(F.concat(F.lit(" "), text))))


def without_stated_numbers(name: Column, title: Column) -> Column:
    """A name without the numbers that the title states as age or strength; as it was if nothing would be left."""
    number = lambda before: F.regexp_extract_all(tokens(F.concat(F.lit(" "), title)), F.lit(f"[nd][_ ]([^{_S}]*){_S}(?={before})"), 1)
    aged = number(f"(?:{_DASH})?(?:{_words(ENDINGS)})?{_YEAR}")
    strong = number(f"(?:{_DASH}{_NUMBER})?{_token('p')}")
    stated = F.transform(F.concat(aged, strong), lambda n: F.replace(n, F.lit(","), F.lit(".")))

    def rest(state: Column) -> Column:
        """Numbers that stand alone, and are no part of what a sign joins to them, go."""
        all_, known = state["tokens"], state["stated"]
        value = lambda t: F.replace(F.regexp_extract(t, f"^[nd] ([^{_S}]*)", 1), F.lit(","), F.lit("."))
        joined = lambda t, i: F.coalesce(F.get(all_, i + 1).rlike(f"^p|^o_[.,/%-]{_S}"), F.lit(False))
        return F.array_join(F.filter(all_, lambda t, i: ~t.rlike("^[nd] ") | ~F.array_contains(known, value(t)) | joined(t, i)), "")

    state = F.struct(_listed(tokens(F.concat(F.lit(" "), name))).alias("tokens"), stated.alias("stated"))
    return F.coalesce(F.nullif(text_of(_tidy(_let(state, rest))), F.lit("")), name)


def faithful(name: Column, title: Column, longest: int = 512) -> Column:
    """Whether an extracted name can stand: of fair length, a set still a set, each of its words in the title."""
    size, low = F.length(F.trim(name)), F.lower(title)
    known = F.forall(F.split(F.lower(F.trim(name)), r"\s+"), lambda w: F.contains(low, w))
    return (size > 0) & (size <= longest) & (bundle_parts(title).isNull() | bundle_parts(name).isNotNull()) & known


def cleaned_names(titles: DataFrame, column: str = "name") -> DataFrame:
    """(raw, clean) of each distinct title: the cleaner runs once for each, however many rows have it."""
    distinct = titles.select(F.col(column).alias("raw")).where("raw is not null").distinct()
    return distinct.select("raw", clean_name(F.col("raw")).alias("clean"))
