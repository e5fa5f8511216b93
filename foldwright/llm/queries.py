"""The registered queries of this subpackage and their SQL.

Each applies its operator to the whole table it is meant for, with production settings.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.llm import ann, htmltext, jaccard, licenses, lines, merkle, mixing, packing, quality, quotes, topk, urls, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def query(sql: str | None = None):
    """Register a function under its own name; `sql` is its DuckDB equivalent."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


_RULE_ROWS = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)


@query(f"""
    with parts as (
        select page_id,
            translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
            coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
        from pages
    ), rules(verdict, host, path) as (values {_RULE_ROWS}),
    pairs as (select distinct host, path from parts),
    fits as (
        select p.host, p.path, r.host || r.path as rule, r.verdict,
            row_number() over (partition by p.host, p.path order by length(r.host) desc, length(r.path) desc) as n
        from pairs p join rules r
            on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path)
    )
    select page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') as verdict
    from parts p left join fits f on f.host = p.host and f.path = p.path and f.n = 1
""")
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, fitting rule and verdict of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(pages, RULES).drop("url")


@query("""
    with held as (
        select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings
        where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    ), scores as (
        select q.vec_id as query_id, x.vec_id, list_inner_product(q.v, x.v)::bigint as score
        from held q join held x on q.vec_id <> x.vec_id where q.vec_id % 20 = 0
    ), ranked as (
        select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scores
    )
    select query_id, rank, vec_id, score from ranked where rank <= 20
""")
def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest inner products of every 20th vector with all others."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.exact_top_k(rows, rows.where(F.col("vec_id") % 20 == 0), 20)


_TEMPLATE_ROWS = ", ".join(f"('{name}', '{text}')" for name, text in licenses.TEMPLATES.items())
_NORMAL = """trim(regexp_replace(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^a-z0-9]+', ' ', 'g'), ' ')"""
_BIGRAMS = """case when l = [''] then [] when len(l) = 1 then l else list_distinct(list_transform(
            range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1])) end"""


@query(f"""
    with templates(license, body) as (values {_TEMPLATE_ROWS}),
    known as (select license, {_BIGRAMS} as b from (
        select license, string_split({_NORMAL.format('body')}, ' ') as l from templates
    )),
    units as (
        select doc_id, unnest(range(len(l)))::int as line_no, unnest(l) as unit
        from (select doc_id, string_split(text, chr(10)) as l from documents where text is not null)
        union all
        select doc_id, null, text from documents where strpos(text, chr(10)) > 0
    ),
    held as (
        select doc_id, line_no, {_BIGRAMS} as b
        from (select doc_id, line_no, string_split({_NORMAL.format('unit')}, ' ') as l from units)
    ),
    pairs as (
        select doc_id, line_no, license, len(list_intersect(h.b, k.b))::bigint as shared,
            len(h.b)::bigint as unit_size, len(k.b)::bigint as license_size
        from held h join known k on 11 * len(h.b) >= 9 * len(k.b) and 9 * len(h.b) <= 11 * len(k.b) and len(h.b) > 0
    )
    select *, 2.0::double * shared / (unit_size + license_size) as dice from pairs
    where 20 * shared >= 9 * (unit_size + license_size)
""")
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every licence notice in every document."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan_licenses(documents)


@query()
def op5_quotation_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message's place in its reply-ordered thread, and its text without quotes as a digest."""
    rows = quotes.link_quotations(table(spark, sf_dir, "conversations"))
    return rows.select(
        "conv_id", "turn", "role", "parent_conv", "parent_turn", "depth", "thread_conv", "position",
        F.length("own_text").alias("own_chars"), F.md5("own_text").alias("own_md5"),
    )


@query()
def op6_one_bit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 vectors found nearest by cosine to every 50th vector."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest_by_cosine(rows, rows.where(F.col("vec_id") % 50 == 0), 5)


def similar_documents_sql(width: int, percent: int) -> str:
    """SQL of `jaccard.similar_documents`."""
    shingle = " || ' ' || ".join(f"w[i + {n}]" for n in range(width))
    return f"""
    with recursive lists as (
        select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w
        from documents
    ), sets as materialized (
        select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < {width} then [array_to_string(w, ' ')]
            else list_transform(range(1, len(w) - {width - 2}), lambda i: {shingle}) end) as s
        from lists
    ), items as materialized (select doc_id, len(s) as n, unnest(s) as g from sets),
    shared as (
        select a.doc_id as x, b.doc_id as y, a.n + b.n as total, count(*) as common
        from items a join items b on a.g = b.g and a.doc_id <> b.doc_id
            and 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
        group by 1, 2, 3
    ), links as materialized (select x, y from shared where 100 * common >= {percent} * (total - common)),
    reach(x, y) as (
        select doc_id, doc_id from sets union select r.x, l.y from reach r join links l on l.x = r.y
    )
    select s.doc_id, len(s.s)::bigint as n_shingles, min(r.y) as component_id
    from sets s join reach r on r.x = s.doc_id group by s.doc_id, s.s
    """


@query(similar_documents_sql(3, 90))
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document, linked at 0.9 over 3-word shingles."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.similar_documents(documents, 3, Fraction(9, 10))


@query()
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence of at most 2048 ids."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(documents, tokenizer_path())


@query()
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from labels that are not held out."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_quality(documents, table(spark, sf_dir, "labels"), keep=~quality.held_out(F.col("doc_id")))
    scored = quality.score_quality(documents, model)
    predicted = (F.col("score") >= 0.3).cast("int").alias("predicted")
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", predicted)


@query()
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a 5:2:1 mix takes of every document."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mix = mixing.mix_to_targets(documents)
    rows = mix.withColumn("taken", F.col("copies") * F.col("size"))
    each = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("twins")))
    return rows.withColumn("_twin", each).select("doc_id", "size", "source_size", "target", "taken", "source")


@query()
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, removed lines and the text that is left of every document."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    left = lines.dedup_lines(documents)
    return left.select("doc_id", "n_lines", "n_removed", F.col("n_chars").alias("kept_chars"), F.md5("text").alias("kept_md5"))


@query()
def op10_line_dedup_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with exact repeats of lines under 20 characters removed too."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    left = lines.dedup_lines(documents, short_repeats=True)
    return left.select("doc_id", "n_lines", "n_removed", F.col("n_chars").alias("kept_chars"), F.md5("text").alias("kept_md5"))


def _field_sql(value: str) -> str:
    return f"coalesce(strlen({value}::varchar) || ':' || {value}::varchar, '-')"


def _tree_sql(leaves: str, prefix: str, depth: int) -> tuple[str, str]:
    """CTEs that fold the nodes of `leaves` (tree, pos, node, n) `depth` times, and paths (tree, pos, sibs, folded) beside them."""
    parts = []
    for level in range(depth):
        own, run = (leaves if level == 0 else f"{prefix}{level}"), f"{prefix}run{level}"
        paths = f"{prefix}path{level}"
        parts.append(f"""
    {run} as materialized (select tree, pos // 16 as pos, list(node order by pos) as nodes, any_value(n) as n from {own} group by 1, 2),
    {prefix}{level + 1} as materialized (select tree, pos, case when n > 1 then sha256(array_to_string(nodes, '')) else nodes[1] end as node,
        (n + 15) // 16 as n from {run}),
    {prefix}path{level + 1} as materialized (select p.* replace (p.pos // 16 as pos,
        case when n > 1 then sibs || array_to_string(nodes[1:p.pos % 16] || nodes[p.pos % 16 + 2:], '') else sibs end as sibs,
        case when n > 1 then sha256(array_to_string(nodes[1:p.pos % 16] || [folded] || nodes[p.pos % 16 + 2:], '')) else folded end as folded)
        from {paths} p join {run} r on p.tree = r.tree and p.pos // 16 = r.pos)""")
    return ",".join(parts), f"{prefix}{depth}"


_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LEAF, _ALTERED = (
    "sha256(" + " || ".join(_field_sql(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")" for text in ("text", _LOWERED)
)
_ROWS_SQL, _ROWS_TOP = _tree_sql("leaves", "r", 6)
_SOURCES_SQL, _SOURCES_TOP = _tree_sql("subroots", "s", 4)


@query(f"""
    with crc as materialized (select list(c order by i) as t from (select i, list_reduce(list_prepend(i, range(8)),
        lambda c, j: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(256) r(i))),
    held as materialized (
        select doc_id, coalesce('s' || source, '') as tree, {_LEAF} as leaf, case when xor(list_reduce(
            list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda d: ascii(d)::bigint)),
            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 5 = 0 then {_ALTERED} end as altered
        from documents, crc
    ),
    placed as materialized (
        select *, row_number() over (partition by tree order by doc_id nulls first, leaf, altered) - 1 as pos,
            count(*) over (partition by tree) as n
        from held
    ),
    leaves as (select tree, pos, leaf as node, n from placed),
    rpath0 as (select tree, pos, pos as leaf_pos, '' as sibs, coalesce(altered, leaf) as folded from placed),{_ROWS_SQL},
    subroots as materialized (
        select '' as tree, tree as name, row_number() over (order by tree) - 1 as pos, node, count(*) over () as n from {_ROWS_TOP}
    ),
    spath0 as (
        select s.tree, s.pos, p.tree as name, p.leaf_pos, p.sibs, p.folded, s.node as subroot
        from rpath6 p join subroots s on p.tree = s.name
    ),{_SOURCES_SQL}
    select doc_id, leaf, subroot, root.node as root, sha256(sibs) as proof_sha256, folded as folded_root, folded = root.node as verified
    from spath4 p join placed l on l.tree = p.name and l.pos = p.leaf_pos, {_SOURCES_TOP} root
""")
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf and proof, checked after some texts were tampered with."""
    return merkle.proofs_after_tampering(table(spark, sf_dir, "documents"))


@query()
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the first 8 whitened components of all."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), 8)


@query("""
    with held as (
        select page_id, url, replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '<br>', ' ') as body from pages
    ), blocks as (
        select page_id, url, list_transform(string_split_regex(body, '</?(h1|p)>'), lambda b: trim(regexp_replace(
            regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(b, '<[^>]*>', '', 'g'),
            '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g'), '\\s+', ' ', 'g'))) as b
        from held
    ), joined as (select page_id, url, array_to_string(list_filter(b, lambda x: x <> ''), chr(10)) as text from blocks)
    select page_id, url, text, length(text)::bigint as n_chars from joined
""")
def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page. The SQL knows the one layout that these tables have."""
    found = htmltext.extract_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
