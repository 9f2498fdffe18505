"""The registered queries of this subpackage: each applies its operator to its whole table.

``QUERIES`` maps names to (spark, sf_dir) -> DataFrame, ``ORACLE_SQL`` names to
DuckDB SQL for the same rows, where SQL can say it.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, line_dedup, media, mix, ngram_join, quality, suffix_dedup, topk, toxicity, warc
from .shared import prepare, scratch_path, split_mod

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):
    @wraps(f)
    def run(spark, sf_dir):
        prepare(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> tuple[str, str]:
    """(rank file, pattern) of the tokenizer that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def hexed(data) -> F.Column:
    return F.sha2(data, 256)


def token_digests(docs: DataFrame, *carry: str) -> DataFrame:
    """``carry``, n_tokens, ids_sha256 and decoded_sha256 of every row's text, encoded and decoded again."""
    ranks, pattern = tokenizer()
    both = bpe.round_trip(docs.select(*carry, "text"), ranks, pattern)
    listed = F.concat_ws(",", F.col("token_ids").cast("array<string>"))
    return both.select(*carry, F.size("token_ids").cast("long").alias("n_tokens"), hexed(listed.cast("binary")).alias("ids_sha256"), hexed(F.col("decoded")).alias("decoded_sha256"))


@query
def op1_bpe(spark, sf_dir):
    return token_digests(read(spark, sf_dir, "documents"), "doc_id")


@query
def op2_media(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    path = scratch_path(spark, "media")
    # the length goes with the key: what is read back must not lean on the table
    key = F.concat_ws(":", F.octet_length(F.coalesce("text", F.lit(""))).cast("string"), F.col("doc_id").cast("string"))
    media.write(media.images(docs.select(key.alias("key"), "text"), "text", "key"), path)
    got = media.features(media.read(spark, path))
    part = F.split("key", ":")
    return got.select(
        F.try_element_at(part, F.lit(2)).cast("long").alias("doc_id"),
        F.element_at(part, 1).cast("long").alias("n_bytes"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        hexed(F.col("payload")).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        hexed(F.col("media")).alias("media_sha256"),
        "feature",
    )


@query
def op3_mix(spark, sf_dir):
    return mix.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: Rows (doc_id, source, size, source_size, target, whole, copies, ...) of a mix of the relation put for {docs}.
MIX_SQL = """
sized as (select doc_id, source, {extra} coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size from {docs}),
strata as (select source, length(bin(size))::bigint as stratum, sum(size)::bigint as words from sized group by 1, 2),
per as (select source, sum(words)::bigint as source_size, row_number() over (order by source nulls last) as nth from strata group by source),
weighed as (select *, ((nth - 1) % 3 + 1)::double as weight from per),
levels as (select *, (sum(source_size) over ()::double - coalesce(sum(3 * source_size) over (order by source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by source_size / weight, source nulls last rows between current row and unbounded following) as lvl from weighed),
leveled as (select *, coalesce(arg_min(case when lvl * weight <= 3 * source_size then lvl end, case when lvl * weight <= 3 * source_size then source_size / weight end) over (), 'inf'::double) as lvl0 from levels),
targeted as (select source, source_size, case when source_size > 0 then least(lvl0 * weight, (3 * source_size)::double) else 0.0 end as target from leveled),
filled as (select s.*, t.source_size, t.target, (t.target - 3 * coalesce(sum(words) over (partition by s.source order by stratum desc rows between unbounded preceding and 1 preceding), 0))
    / nullif(sum(words * stratum) over (partition by s.source order by stratum desc rows between current row and unbounded following), 0) as level
    from strata s join targeted t on s.source is not distinct from t.source),
awaited as (select *, case when source_size > 0 then least(3.0::double, stratum * coalesce(arg_max(case when level * stratum <= 3 then level end, case when level * stratum <= 3 then stratum end)
    over (partition by source), 'inf'::double)) else 0.0::double end as e from filled),
parts as (select source, stratum, source_size, target, floor(e)::bigint as whole, e - floor(e) as part, target - sum(floor(e) * words) over (partition by source) as room from awaited),
hashed as (select s.*, p.source_size, p.target, p.whole, p.part, p.room,
    (('0x' || substr(md5('0|' || coalesce(s.doc_id::varchar, '-') || '|' || coalesce(s.source, '-')), 1, 13))::bigint::double + 0.5) / 4503599627370496.0 as u
    from sized s join parts p on s.source is not distinct from p.source and p.stratum = length(bin(s.size))),
ranked as (select *, case when part > 0 then ((u / (1 - u)) / (part / (1 - part))) / (1 + (u / (1 - u)) / (part / (1 - part))) else 1.0 end as rnk from hashed),
summed as (select *, case when part > 0 and size > 0 then sum(case when part > 0 then size else 0 end) over (partition by source order by rnk, doc_id, size) end as run from ranked),
inside as (select *, coalesce(run <= room, false) as taken_once from summed),
gaps as (select *, room - max(case when taken_once then run else 0 end) over (partition by source) as gap from inside),
closers as (select source, min({{'miss': abs(gap - size), 'rnk': rnk, 'doc_id': doc_id, 'size': size}}) as c from gaps
    where not taken_once and part > 0 and size > 0 and abs(gap - size) < gap group by source),
mixed as (select g.*, least(3, g.whole + (g.taken_once or coalesce(c.c.doc_id = g.doc_id and c.c.size = g.size and c.c.rnk = g.rnk, false))::bigint) as copies
    from gaps g left join closers c on g.source is not distinct from c.source)
"""
ORACLE_SQL["op3_mix"] = "with " + MIX_SQL.format(docs="documents", extra="") + "select doc_id, size, source_size, target, copies * size as taken from mixed"


@query
def op4_topk(spark, sf_dir):
    return topk.search(read(spark, sf_dir, "embeddings"), F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False)))


ORACLE_SQL["op4_topk"] = """
with v as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as e from embeddings
    where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.r, q.vec_id as query_id, c.vec_id as vec_id, list_inner_product(q.e, c.e)::bigint as score
    from v q join v c on q.vec_id % 20 = 0 and c.r <> q.r),
r as (select *, row_number() over (partition by r order by score desc, vec_id) as rank from s)
select query_id, rank::integer as rank, vec_id, score from r where rank <= 20"""


@query
def op5_ngram_join(spark, sf_dir):
    return ngram_join.near_duplicates(read(spark, sf_dir, "documents"))


#: {components}: rows (doc_id, n_shingles, component_id) of {docs}.
JOIN_SQL = """
toks as (select doc_id, row_number() over () as row_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from {docs}),
shingles as (select distinct row_id, md5(unnest(case when len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) end)) as g from toks),
counted as (select t.row_id, any_value(t.doc_id) as doc_id, count(s.g) as n from toks t left join shingles s using (row_id) group by t.row_id),
grams as (select g, list(row_id) as own from shingles group by g having count(*) > 1),
pairs as (select a.row_id as a, b as b, count(*) as inter from shingles a join grams using (g), unnest(own) as u(b) where a.row_id < b group by 1, 2),
linked as (select a, b from pairs join counted x on x.row_id = a join counted y on y.row_id = b where 100 * inter >= 75 * (x.n + y.n - inter)),
edges as (select a, b from linked union all select b, a from linked),
walk as (select row_id as node, row_id as seen from counted where n > 0 union select w.node, e.b from walk w join edges e on w.seen = e.a),
{components} as (select c.doc_id, c.n as n_shingles, case when c.n = 0 then c.doc_id else (select min(d.doc_id) from walk w join counted d on d.row_id = w.seen where w.node = c.row_id) end as component_id, c.row_id from counted c)
"""
ORACLE_SQL["op5_ngram_join"] = "with recursive " + JOIN_SQL.format(docs="documents", components="parts") + "select doc_id, n_shingles, component_id from parts"


@query
def op6_warc(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    path = scratch_path(spark, "warc")
    warc.write(pages.select("page_id", "url", F.col("html").cast("binary").alias("payload")), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL["op6_warc"] = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html)::bigint as payload_bytes, sha256(html) as payload_digest from p),
f as (select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) else page_id end as first from d)
select page_id, payload_bytes, payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type,
    case when page_id = first then null else first end as refers_to from f"""


@query
def op7_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model, "doc_id")
    return out.select("doc_id", (split_mod(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op8_line_dedup(spark, sf_dir):
    out = line_dedup.dedup(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "n_lines", "n_removed", hexed(F.col("text").cast("binary")).alias("kept_sha256"))


#: {deduped}: rows (every column of {docs}, text cleaned, n_lines, n_removed).
LINE_SQL = """
numbered as (select *, row_number() over () as row_id from {docs}),
split as (select row_id, doc_id, source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from numbered where text is not null),
lined as (select *, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) as bare from split),
boiler as (select bare, min(doc_id) as first_doc from lined where bare <> ''
    group by bare having count(distinct case when source is null then '-' else '+' || source end) >= 10),
placed as (select l.*, b.bare is not null as hit, b.first_doc,
    row_number() over (partition by l.row_id, l.bare order by l.pos) as nth from lined l left join boiler b on l.bare = b.bare),
marked as (select *, hit and not (coalesce(doc_id = first_doc, false) and nth = 1) as gone from placed),
cleaned as (select row_id, count(*)::integer as n_lines, sum(gone::integer)::integer as n_removed,
    coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '') as kept from marked group by row_id),
{deduped} as (select n.* exclude (row_id) replace (case when c.row_id is null then n.text else c.kept end as text),
    coalesce(c.n_lines, 0) as n_lines, coalesce(c.n_removed, 0) as n_removed from numbered n left join cleaned c using (row_id))
"""
ORACLE_SQL["op8_line_dedup"] = "with " + LINE_SQL.format(docs="documents", deduped="deduped") + "select doc_id, n_lines, n_removed, sha256(text) as kept_sha256 from deduped"


@query
def op9_suffix_dedup(spark, sf_dir):
    out = suffix_dedup.dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    return out.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), hexed(F.col("kept")).alias("kept_sha256"))


@query
def op10_quality(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    out = quality.score(docs, model, "doc_id")
    return out.select("doc_id", (split_mod(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
