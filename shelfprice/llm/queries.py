"""The operators' queries over whole tables, with production parameters, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licenses, media, mixing, near_dup, pieces, pii, repeats, resampling, suffixes, token_counts, toxicity, vector_codes, vectors
from .common import Scratch

#: Where the public tokenizers' files are: the same on the driver and on the executors.
WORD_BPE, PIECE_BPE = "word_bpe_49k.json", "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of each document, by a model fitted on the labels that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select(F.col("id").alias("doc_id"), toxicity.is_held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of each document in the mix of all sources, and which shards drew its blocks, and where."""
    mix = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mixing.taken_words(mix).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "n_shards", "placement")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text stored as an image: sizes and digests of payload and file, tile and difference hash."""
    media_rows = media.to_media(_table(spark, sf_dir, "documents"))
    return media.media_features(media_rows).select(
        F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
        F.col("dhash").alias("feature"), "width", "height", "channels", F.sha2("tile", 256).alias("tile_sha256"),
    )


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in each document."""
    scanned = licenses.scan_licenses(_table(spark, sf_dir, "documents"))
    return scanned.select(F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of documents that stand in other documents too, and the document that has them first."""
    spans = repeats.repeated_spans(_table(spark, sf_dir, "documents"))
    return spans.select(F.col("id").alias("doc_id"), "start", "end", "n_bytes", "n_chunks", F.col("first_id").alias("first_doc_id"), "repeat_bytes", "is_first")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of each document: base patterns, and all spans with those of the skip-chain field."""
    docs = _table(spark, sf_dir, "documents")
    found = pii.find_pii(docs, pii.fit_pii(docs))
    return found.select(F.col("id").alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_secret", "n_spans")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's component of near-duplicates on sets of 4-word shingles, and whether it is the one kept."""
    near = near_dup.near_duplicates(_table(spark, sf_dir, "documents"), size=4, percent=80)
    return near.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document, by a digest cache that begins empty in a folder of the call's own."""
    cache = Scratch(spark, "token-cache").root
    counts = token_counts.count_tokens(_table(spark, sf_dir, "documents"), cache, tokenizer_path(WORD_BPE))
    return counts.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document encoded to pieces and decoded again: counts and digests of the ids and of the text that came back."""
    return pieces.round_trip(_table(spark, sf_dir, "documents"), tokenizer_path(PIECE_BPE)).select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", "ids_sha256", "text_sha256")


def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of each embedding at a cosine of 0.98 within its label."""
    near = vectors.near_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.98)
    return near.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


def op11_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's bytes without the 50-byte strings that documents of smaller ids have: sizes, number of removed runs, digest of the rest."""
    cut = suffixes.remove_repeats(_table(spark, sf_dir, "documents"), size=50)
    return cut.select(
        F.col("id").alias("doc_id"), "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of each document in a draw of a quarter of them towards the texts of benchmark."""
    drawn = resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), buckets=10_000, least_words=20, percent=25, seed=7)
    return drawn.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of each embedding by 8 codebooks of 16 entries, trained in 6 rounds."""
    codes, book = vector_codes.compress_vectors(_table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6)
    digest = vector_codes.codebooks_digest(book)
    return codes.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_mix_sources": op2_mix_sources,
    "op3_media": op3_media,
    "op4_licenses": op4_licenses,
    "op5_repeats": op5_repeats,
    "op6_pii": op6_pii,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_token_counts": op8_token_counts,
    "op9_pieces": op9_pieces,
    "op10_near_vectors": op10_near_vectors,
    "op11_suffixes": op11_suffixes,
    "op12_resample": op12_resample,
    "op13_vector_codes": op13_vector_codes,
}


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The rounds one after the other, as frames of their own."""
    sql = f"""with kept as (
  select vec_id, label, [floor(4096 * x::double)::bigint for x in embedding] as v from embeddings
  where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
parts as (select vec_id, label, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] as x from kept, lateral (select unnest(range(0, {parts})) as p)),
b0 as (select p, row_number() over (partition by p order by vec_id) - 1 as e, x as c from parts qualify e < {entries})"""
    far = lambda r: f"""n{r} as (
  select vec_id, any_value(label) as label, p, any_value(x) as x, arg_min(e, (d, e)) as e, min(d) as d from (
    select vec_id, label, p, x, e, list_sum([(a - c[i]) * (a - c[i]) for a, i in x])::bigint as d from parts join b{r} using (p)) group by vec_id, p)"""  # noqa: E731
    for r in range(rounds):
        sql += f""",
{far(r)},
u{r} as (select p, e, i, floor(sum(a) / count(*))::bigint as m from (select p, e, unnest(x) as a, generate_subscripts(x, 1) as i from n{r}) group by p, e, i),
m{r} as (select p, e, list(m order by i) as m from u{r} group by p, e),
b{r + 1} as (select p, e, coalesce(m, c) as c from b{r} left join m{r} using (p, e))"""
    return sql + f""",
{far(rounds)},
book as (select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) as codebooks_sha256 from b{rounds}),
coded as (select vec_id, any_value(label) as label, string_agg(printf('%02x', e), '' order by p) as code, sum(d)::bigint as error from n{rounds} group by vec_id)
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256 from coded, book"""


ORACLES = {
    "op11_suffixes": r"""
with texts as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
blocks as (select doc_id, b, substr(h, 2 * b + 1, 2 * 1049) as h from texts, lateral (select unnest(range(0, greatest(1, len(h) // 2), 1000)) as b)),
windows as (select doc_id, b + p as p, md5_number(substr(h, 2 * p + 1, 100)) as w from blocks, lateral (select unnest(range(0, greatest(0, len(h) // 2 - 49))) as p)),
firsts as (select w, min(doc_id) as first from windows group by w),
hits as (select doc_id, p, lag(p) over (partition by doc_id order by p) as before from windows join firsts using (w) where doc_id > first),
runs as (select doc_id, p, sum(case when p - before <= 50 then 0 else 1 end) over (partition by doc_id order by p) as run from hits),
spans as (select doc_id, min(p) as a, max(p) + 50 as b from runs group by doc_id, run),
gaps as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as before from spans),
cut as (
  select doc_id, sum(b - a)::bigint as n_removed, count(*) as n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' order by a) || any_value(substr(h, 2 * last + 1)) as kept
  from (select *, max(b) over (partition by doc_id) as last from gaps) join texts using (doc_id) group by doc_id)
select doc_id, len(h)::bigint // 2 as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256
from texts left join cut using (doc_id)
""",
    "op12_resample": r"""
with crc_table as (
  select list(list_reduce(list_concat([i], range(0, 8)), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) order by i) as t from range(0, 256) as r(i)),
texts as (select doc_id, true as mine, text from documents union all select item_id, false, text from benchmark),
worded as (
  select doc_id, mine, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from texts),
features as (
  select doc_id, mine, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) as f from worded),
named as (
  select f, xor(list_reduce(list_concat([4294967295::bigint], [('0x' || substr(hex(encode(f)), 2 * i - 1, 2))::bigint for i in range(1, len(hex(encode(f))) // 2 + 1)]),
    lambda c, b: xor(c // 256, t[(xor(c % 256, b) + 1)::int])), 4294967295::bigint) % 10000 as bucket from (select distinct f from features), crc_table),
hashed as (select doc_id, mine, bucket from features join named using (f)),
counts as (select bucket, count(*) filter (where mine) as s, count(*) filter (where not mine) as t from hashed group by bucket),
sums as (select coalesce(sum(s), 0)::double as s_all, coalesce(sum(t), 0)::double as t_all from counts),
gains as (select bucket, floor(1000 * ln((t + 1)::double * (s_all + 10000) / ((s + 1)::double * (t_all + 10000))))::bigint as gain from counts, sums),
weighed as (select doc_id, count(*) as n_features, floor(sum(gain) / count(*)::double)::bigint as weight from hashed join gains using (bucket) where mine group by doc_id),
scored as (
  select doc_id, len(w) as n_words, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
    coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as score
  from worded left join weighed using (doc_id) where mine),
ranks as (select doc_id, row_number() over (order by score desc, doc_id) as place, count(*) over () as n from scored where n_words >= 20)
select doc_id, n_features, weight, score, case when place <= 25 * n // 100 then place end::bigint as rank from scored left join ranks using (doc_id)
""",
    "op13_vector_codes": _codes_sql(),
    "op2_mix_sources": r"""
with recursive rows as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
sizes as (select source, sum(size)::bigint as source_size from rows group by source),
weighed as (
  select *, (list_value(5.0::double, 2.0, 1.0))[((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight,
    source_size * 3.0::double as cap from sizes),
rated as (select *, cap / weight as rate from weighed),
levels as (
  select *, (sum(source_size) over ()::double - coalesce(sum(cap) over (order by rate, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by rate, source nulls last rows between current row and unbounded following) as level from rated),
filled as (select arg_min(level, rate) as height from levels where level <= rate),
targets as (
  select source, source_size, least(cap, height * weight) as target,
    case when source_size > 0 then floor(least(cap, height * weight) / source_size) else 0 end as passes from rated, filled),
blocks as (
  select doc_id, source, size, block, least(256, size - block * 256) as n_words, md5('7/' || doc_id || '/' || block) as key
  from rows, lateral (select unnest(range(0, greatest(1, (size + 255) // 256))) as block)),
ordered as (
  select b.*, t.source_size, t.target, t.passes, sum(n_words) over own as upto, sum((n_words > 0)::bigint) over own as rank,
    sum((n_words > 0)::bigint) over (partition by b.source) as n_blocks
  from blocks b join targets t on b.source is not distinct from t.source
  window own as (partition by b.source order by key, doc_id, block rows unbounded preceding)),
placed as (
  select *, case when n_words > 0 then passes + case when passes < 3 and upto - n_words / 2.0 <= target - passes * source_size then 1 else 0 end else 0 end as asked from ordered),
quotas as (select source, sum(asked)::bigint as quota from placed group by source),
lists as (select list(source order by source nulls last) as names, list(quota order by source nulls last) as q from quotas),
tree as (select ceil(log2(greatest(64, ceil(sum(size) / 4194304.0))))::int as depth from rows),
walk(level, shard, q, i, size, take, lefts) as (
  select 0, 0::bigint, q, 1, list_sum(q)::bigint, list_sum(q)::bigint // 2, []::bigint[] from lists
  union all
  select case when i <= len(q) then level else level + 1 end, shard + case when i <= len(q) then 0 else side * (1::bigint << (depth - level - 1)) end,
    case when i <= len(q) then q else child end, case when i <= len(q) then i + 1 else 1 end,
    case when i <= len(q) then size - q[i] else list_sum(child)::bigint end, case when i <= len(q) then take - got else list_sum(child)::bigint // 2 end,
    case when i <= len(q) then list_append(lefts, got) else []::bigint[] end
  from (
    select *, case when side = 0 then lefts else [a - lefts[j] for a, j in q] end as child,
      low + case when high > low then len([j for j in range(1, len(weights)) if list_sum(weights[1:j]) < u * list_sum(weights)]) else 0 end as got
    from (
      select *, [exp(lgamma(low + 1) + lgamma(k - low + 1) + lgamma(n - low + 1) + lgamma(s - k - n + low + 1)
        - lgamma(x + 1) - lgamma(k - x + 1) - lgamma(n - x + 1) - lgamma(s - k - n + x + 1)) for x in range(low, high + 1)] as weights
      from (
        select *, greatest(0, n + k - s, floor(mean)::bigint - spread) as low, least(n, k, floor(mean)::bigint + spread) as high
        from (
          select *, case when s > 0 then n::double * k / s else 0 end as mean,
            ceil(12 * sqrt(case when s > 0 then n::double * k / s else 0 end * greatest((s - k)::double / greatest(s, 1), 0)))::bigint + 12 as spread
          from (
            select w.*, depth, size as s, coalesce(q[i], 0) as k, take as n,
              (('0x' || substr(md5('7/' || level || '/' || shard || '/' || (i - 1)), 1, 13))::bigint::double + 0.5) / 4503599627370496.0 as u,
              unnest(case when i <= len(q) then [0] else [0, 1] end) as side
            from walk w, tree where level < depth)))))),
leaves as (select shard, unnest(names) as source, unnest(walk.q) as n from walk, tree, lists where level = depth and i = 1),
firsts as (select *, coalesce(sum(n) over (partition by source order by shard rows between unbounded preceding and 1 preceding), 0) as first from leaves),
turns as (select *, (round - 1) * n_blocks + rank - 1 as place from placed, lateral (select unnest(range(1, passes::bigint + 2)) as round) where n_words > 0),
drawn as (
  select t.doc_id, t.block, t.n_words, t.round, f.shard
  from turns t join firsts f on t.source is not distinct from f.source and t.place >= f.first and t.place < f.first + f.n),
slotted as (
  select *, row_number() over (partition by shard order by md5('7/slot/' || doc_id || '/' || block || '/' || round), doc_id, block, round) as slot from drawn),
given as (
  select doc_id, sum(n_words)::bigint as taken, count(distinct shard)::int as n_shards, md5(string_agg(round || ':' || block || ':' || shard || ':' || slot, ',' order by round, block)) as placement
  from slotted group by doc_id)
select r.doc_id, r.size, t.source_size, t.target, coalesce(taken, 0)::bigint as taken, coalesce(n_shards, 0)::int as n_shards, coalesce(placement, md5('')) as placement
from rows r join targets t on r.source is not distinct from t.source left join given g on g.doc_id = r.doc_id
""",
    "op4_licenses": r"""
with texts as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
lines as (
  select doc_id, line, regexp_extract_all(content, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from (select doc_id, unnest(string_split(text, chr(10))) as content, generate_subscripts(string_split(text, chr(10)), 1) as line from texts)),
spots as (
  select doc_id, w, coalesce(sum(len(w)) over (partition by doc_id order by line rows between unbounded preceding and 1 preceding), 0)::bigint as a from lines),
whole as (select doc_id, flatten(list(w order by a)) as w, count(*) filter (len(w) > 0) as n_lines from spots group by doc_id),
phrases(p, label) as (values (['mit', 'license'], 'mit'), (['apache', 'license'], 'apache'), (['general', 'public', 'license'], 'gpl')),
places as (
  select doc_id, label, unnest([i - 1 for i in range(1, len(w) + 1) if w[i:i + len(p) - 1] = p]) as place from whole, phrases),
base as (
  select doc_id, count(*) as n_base, min(place) as first_word, max(place) as last_word, list(distinct label) as labels from places group by doc_id),
blocks as (
  select doc_id, w[pos + 1:least(pos + 64, len(w))] as b from (
    select doc_id, w, unnest([x for x in range(0, greatest(1, len(w) - 32), 32)]) as pos from spots where len(w) > 0)
  union all
  select doc_id, w[pos + 1:least(pos + 64, len(w))] from (
    select doc_id, w, unnest(range(0, greatest(1, len(w) - 32), 32)) as pos from whole where n_lines > 1)),
templates(t, label, must) as (values
TEMPLATES),
words as (select string_split(t, ' ') as t, list_distinct(string_split(t, ' ')) as tokens, label, must from templates),
near as (select doc_id, list_distinct(b) as b from blocks),
met as (
  select doc_id, label, max(len(list_intersect(b, tokens)) / len(tokens)::double) as share from near, words
  where len(list_intersect(b, tokens)) >= 0.8 * len(tokens) - 1e-9 and list_has_all(b, must) group by doc_id, label),
own as (select doc_id, list(label) as labels, max(share) as share from met group by doc_id)
select w.doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(own.labels, [])))), ','), '') as labels,
  case when n_base > 0 then 1.0 else coalesce(share, 0.0) end::double as score
from whole w left join base using (doc_id) left join own using (doc_id)
""".replace("TEMPLATES", ",\n".join(f"  ('{t}', '{label}', {list(*must)}::varchar[])" for t, label, *must in licenses.TEMPLATES)),
    "op7_near_duplicates": r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (
  select doc_id, list_distinct(case when len(w) >= 4 then [array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)] when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from words),
classes as (select min(doc_id) as head, list(doc_id) as ids, any_value(s) as s from (select doc_id, list_sort(s) as s from sets) where len(s) > 0 group by md5(array_to_string(s, '|'))),
shingles as (select head, len(s) as n, unnest(s) as shingle from classes),
pairs as (
  select a.head as a, b.head as b from shingles a join shingles b on a.shingle = b.shingle and a.head < b.head
  group by a.head, b.head, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
links as (select a, b from pairs union all select b, a from pairs),
reach(node, other) as (select head, head from classes union select r.node, l.b from reach r join links l on r.other = l.a),
component as (select node, min(other) as low from reach group by node),
members as (select unnest(ids) as doc_id, low from classes join component on head = node)
select doc_id, len(s)::bigint as n_shingles, coalesce(low, doc_id) as component_id, coalesce(low, doc_id) = doc_id as kept from sets left join members using (doc_id)
""",
    "op10_near_vectors": r"""
with recursive vectors as (
  select vec_id, label, case when label is not null and len(embedding) > 0 and len([x for x in embedding if x is null or not isfinite(x)]) = 0
    and len([x for x in embedding if x <> 0]) > 0 then embedding::double[] end as v from embeddings),
pairs as (
  select a.vec_id as a, b.vec_id as b from vectors a join vectors b on a.label = b.label and a.vec_id < b.vec_id and len(a.v) = len(b.v)
  where list_cosine_similarity(a.v, b.v) >= 0.98),
links as (select a, b from pairs union all select b, a from pairs),
reach(node, other) as (select vec_id, vec_id from vectors union select r.node, l.b from reach r join links l on r.other = l.a),
component as (select node, min(other) as low from reach group by node),
counts as (select a, count(*) as n from links group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, low as component_id, low = vec_id as kept from vectors join component on vec_id = node left join counts on vec_id = a
""",
}
