"""Curation of the catalogue: brands read from names, model answers, candidates for enrichment, tag words, edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, vocab

#: Trailing words of a name that may be a tag rather than part of it.
TAG_WORDS = [
    "islay", "speyside", "highland", "highlands", "lowland", "lowlands", "campbeltown", "island", "islands", "welsh", "irish", "scotch", "scottish", "japanese", "canadian", "indian",
    "american", "english", "british", "swedish", "taiwanese", "german", "french", "australian", "finnish", "whisky", "whiskey", "bourbon", "blended", "malt", "grain", "single", "straight",
    "rye", "pure",
]


def _folded(column: str) -> Column:
    """Lower case without apostrophes, all but letters and digits as one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(column), "['`’]", ""), "[^0-9a-zа-яіїєґ]+", " "))


def brand_index(brands: DataFrame, column: str = "name") -> DataFrame:
    """key (folded, blanks kept) and brand: the first name, by its letters, of each key."""
    return brands.select(_folded(column).alias("key"), F.col(column).alias("brand")).where("key <> ''").groupBy("key").agg(F.min("brand").alias("brand"))


def _longest_key(texts: DataFrame, index: DataFrame, value: str) -> DataFrame:
    """(__text) to __text and the value of the longest key that stands as whole words in it.

    A key is looked for only where its first word stands, and only in the lengths that keys of that first
    word have, so a long key adds nothing to texts that it cannot be in. No job runs while this is planned.
    """
    first = index.select(F.split("key", " ").alias("w")).groupBy(F.col("w")[0].alias("__word")).agg(F.collect_set(F.size("w")).alias("__sizes"))
    spelled = texts.where("__text is not null").distinct().select("__text", F.split(_folded("__text"), " ").alias("__words"))
    starts = spelled.select("__text", "__words", F.posexplode("__words").alias("__at", "__word")).join(first, "__word")
    fits = F.filter("__sizes", lambda n: n + F.col("__at") <= F.size("__words"))
    keys = starts.select("__text", F.explode(F.transform(fits, lambda n: F.array_join(F.slice("__words", F.col("__at") + 1, n), " "))).alias("key")).distinct()
    return keys.join(index, "key").groupBy("__text").agg(F.max_by(value, F.struct(F.length("key"), F.col("key"))).alias(value), F.max(F.length("key")).alias("__size"))


def brand_from_name(items: DataFrame, index: DataFrame, column: str = "name") -> DataFrame:
    """Items with found_brand: the longest brand that stands as whole words in the name.

    Runs of a name's words that begin as a brand does are looked up by equi-joins, so items and brands are
    never multiplied. Names are joined once each.
    """
    hits = _longest_key(items.select(F.col(column).alias("__text")), index, "brand").select("__text", F.col("brand").alias("found_brand"))
    return items.join(hits, F.col(column) == F.col("__text"), "left").drop("__text")


def brand_facts(items: DataFrame, info: DataFrame) -> DataFrame:
    """Items (name, brand) with brand_country and brand_type: of the longest known brand in the name or the brand field.

    info: brand, country and type (null where a brand has several), the table of known brands. Brands are
    looked up as in brand_from_name; the name goes before the brand field where keys are equally long.
    """
    index = info.select(_folded("brand").alias("key"), F.struct("country", "type").alias("fact")).where("key <> ''").groupBy("key").agg(F.min("fact").alias("fact"))
    hits = _longest_key(items.select(F.col("name").alias("__text")).unionByName(items.select(F.col("brand").alias("__text"))), index, "fact")
    of = lambda column, alias: hits.select(F.col("__text").alias(f"__{alias}"), F.struct("__size", "fact").alias(alias))
    both = items.join(of("name", "by_name"), F.col("name") == F.col("__by_name"), "left").join(of("brand", "by_brand"), F.col("brand") == F.col("__by_brand"), "left")
    longer = F.coalesce(F.col("by_brand.__size"), F.lit(0)) > F.coalesce(F.col("by_name.__size"), F.lit(0))
    fact = F.when(longer, F.col("by_brand.fact")).otherwise(F.col("by_name.fact"))
    return both.select(*[F.col(c) for c in items.columns], fact["country"].alias("brand_country"), fact["type"].alias("brand_type"))


def model_answers(answers: DataFrame, body: str = "body") -> DataFrame:
    """A model's JSON answers as rows: id, confidence, tags of the known vocabulary; fences and outer text go.

    What is no array gives no rows; an unknown confidence, or any but high and low, gives no tags.
    """
    inner = F.regexp_extract(F.regexp_replace(body, "```(?:json)?", ""), r"(?s)(\[.*\])", 1)
    parsed = F.from_json(inner, "array<struct<id: string, confidence: string, tags: array<string>>>")
    rows = answers.select(F.explode(parsed).alias("a")).select("a.id", F.lower("a.confidence").alias("confidence"), "a.tags").where("id is not null")
    known = F.array_intersect(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.lower(F.trim(t))), F.array(*map(F.lit, vocab.FLAVOR_KEYWORDS)))
    return rows.withColumn("tags", F.when(F.col("confidence").isin("high", "low"), F.array_sort(known)).otherwise(F.array().cast("array<string>")))


def merge_answers(items: DataFrame, answers: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """Items whose null fields take the answers' values; one answer an item, the first by its fields."""
    one = answers.groupBy(key).agg(F.min(F.struct(*fields)).alias("n"))
    joined = items.join(one, key, "left")
    return joined.select(*[F.coalesce(F.col(c), F.col(f"n.{c}")).alias(c) if c in fields else F.col(c) for c in items.columns])


def outcome_tally(rows: DataFrame) -> DataFrame:
    """How many answers were high, low, unknown and missing, and how many have tags."""
    known = F.col("confidence").isin("high", "low")
    return rows.agg(
        F.count_if(F.col("confidence") == "high").alias("high"), F.count_if(F.col("confidence") == "low").alias("low"), F.count_if(F.col("confidence").isNotNull() & ~known).alias("unknown"),
        F.count_if(F.col("confidence").isNull()).alias("unanswered"), F.count_if(F.size("tags") > 0).alias("tagged"),
    )


def flavor_candidates(products: DataFrame, offers: DataFrame) -> DataFrame:
    """Products never classified nor curated, with the longest of their raw names (then the newest, then by id)."""
    open_ = products.where("classified_at is null and curated_at is null").select("product_id")
    order = F.struct(F.length("name_orig"), F.col("last_seen"), F.col("offer_id"))
    return offers.join(open_, "product_id", "left_semi").groupBy("product_id").agg(F.max_by("name_orig", order).alias("name_orig"))


def name_candidates(products: DataFrame, offers: DataFrame) -> DataFrame:
    """Each product with its newest raw name and whether any store carries it."""
    newest = offers.groupBy("product_id").agg(F.max_by("name_orig", F.struct("last_seen", "offer_id")).alias("name_orig"))
    return products.join(newest, "product_id", "left").withColumn("carried", F.col("name_orig").isNotNull())


def fan_out(items: DataFrame, answers: DataFrame, key: str = "match_key") -> DataFrame:
    """One answer for a key copied to all items of that key; items without a key keep none. heads() says whom to ask."""
    return items.join(answers, key, "left")


def heads(items: DataFrame, key: str = "match_key", order: str = "sku") -> DataFrame:
    """One item for each key, the least by order."""
    rest = [c for c in items.columns if c != key]
    return items.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("h")).select(key, *[F.col(f"h.{c}").alias(c) for c in rest])


def collapse_tags(names: DataFrame, column: str = "name") -> DataFrame:
    """(name, collapsed): trailing tag words go, one after the other, while the shorter name is itself in the catalogue.

    A name has at most as many steps as trailing tag words, and no step depends on another name's: all
    shorter forms are looked up in one join, and the longest unbroken run of them counts.
    """
    distinct = names.select(F.col(column).alias("name")).where("name is not null").distinct()
    words = F.split("name", " ")
    steps = distinct.select("name", words.alias("w")).where("size(w) > 1").select("name", "w", F.posexplode(F.sequence(F.size("w") - 1, F.lit(1), F.lit(-1))).alias("step", "n")).where("n < size(w) and n >= 1")
    steps = steps.where(F.forall(F.slice("w", F.col("n") + 1, F.size("w") - F.col("n")), lambda x: F.lower(x).isin(TAG_WORDS))).withColumn("shorter", F.array_join(F.slice("w", F.lit(1), F.col("n")), " "))
    there = steps.join(distinct.select(F.col("name").alias("shorter"), F.lit(True).alias("known")), "shorter", "left")
    runs = there.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("step", F.coalesce("known", F.lit(False)).alias("known"), "shorter"))).alias("steps"))
    best = F.aggregate("steps", F.struct(F.lit(True).alias("going"), F.col("name").alias("name")), lambda a, s: F.struct((a["going"] & s["known"]).alias("going"), F.when(a["going"] & s["known"], s["shorter"]).otherwise(a["name"]).alias("name")))["name"]
    return distinct.join(runs, "name", "left").select("name", F.coalesce(F.when(F.col("steps").isNotNull(), best), F.col("name")).alias("collapsed"))


def known_flavors(links: DataFrame) -> DataFrame:
    """Links to flavors of the closed vocabulary."""
    return links.where(F.col("flavor").isin(list(vocab.FLAVOR_KEYWORDS)))


def duplicates(stored: DataFrame, batch: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value) that a batch repeats within itself or that the table already has, for fields meant to be unique."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("p")
    new, old = (df.select(pairs).select("p.field", "p.value").where("value is not null") for df in (batch, stored))
    twice = new.groupBy("field", "value").agg(F.count("*").alias("n")).where("n > 1").select("field", "value")
    return twice.unionByName(new.join(old, ["field", "value"], "left_semi")).distinct()


def edit_product(products: DataFrame, product_id: str, changes: dict) -> DataFrame:
    """The product with the changes given; other fields and products stay. An unknown field is an error."""
    unknown = set(changes) - set(products.columns)
    if unknown:
        raise ValueError(f"no such fields: {sorted(unknown)}")
    here = F.col("product_id") == product_id
    return products.select(*[F.when(here, F.lit(changes[c]).cast(products.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in products.columns])


def get_or_create(stored: DataFrame, names: DataFrame) -> DataFrame:
    """A lookup table (id, name) with names that it lacks, whatever their case and outer blanks; an id is a digest of that key.

    Of several spellings of a new name the least is taken.
    """
    key = F.lower(F.trim("name"))
    fresh = names.select(F.trim("name").alias("name")).where("name <> ''").groupBy(key.alias("key")).agg(F.min("name").alias("name"))
    fresh = fresh.join(stored.select(key.alias("key")), "key", "left_anti")
    return stored.unionByName(fresh.select(F.md5("key").alias("id"), "name"))


def reconcile(stored: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """What turns a stored set of links into the wanted one: the key and action, add or remove; links on both sides are left out."""
    old, new = stored.select(*key).distinct(), wanted.select(*key).distinct()
    return new.join(old, key, "left_anti").withColumn("action", F.lit("add")).unionByName(old.join(new, key, "left_anti").withColumn("action", F.lit("remove")))


def merge_products(links: DataFrame, merges: DataFrame) -> DataFrame:
    """Rows with a product_id, each product that is merged (from_id, into_id) replaced by what it went into; equal rows then count once.

    A chain of merges is followed by asking again: one call is one step.
    """
    moved = links.join(merges.select(F.col("from_id").alias("product_id"), "into_id"), "product_id", "left")
    return moved.withColumn("product_id", F.coalesce("into_id", "product_id")).select(*links.columns).distinct()


def spelling_votes(names: DataFrame, column: str = "name") -> DataFrame:
    """key and spelling of each name, ready to be voted on."""
    return names.select(text.spelling_key(F.col(column)).alias("key"), F.col(column).alias("name")).where("key <> ''")
