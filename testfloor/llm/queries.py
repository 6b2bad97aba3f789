"""The registered query of every operator, with its production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from testfloor.llm import decontaminate, hard_negatives, language, license_scan, neardup, packing, pii, quality_rules, ranked_search, substrings, token_files, url_rules, warc
from testfloor.llm.registry import query
from testfloor.session import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


URL_RULES = (
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
)
URL_PATTERNS = (
    ("~.spam-farm.", "block"),
    ("~.cheap-pills.", "block"),
    ("~.casino.", "block"),
    ("~/casino/", "block"),
    ("~.free-*-download.", "block"),
    ("~/wp-admin/", "block"),
)

# Words of a rule are fixed; the two CASEs follow its length, longest first.
_OP4_SQL = """
with u as (
  select page_id,
    case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest
  from pages
), p as (
  select page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from u
), r as (
  select *, case
      when ('.' || host) like '%.example.net' and starts_with(path, '/en/') then 'example.net/en/'
      when ('.' || host) like '%.example.com' and starts_with(path, '/de/') then 'example.com/de/'
      when ('.' || host) like '%.org' and starts_with(path, '/fr/') then 'org/fr/'
      when ('.' || host) like '%.net' and starts_with(path, '/') then 'net/' end as rule,
    '.' || host || path as subject
  from p
), q as (
  select *, case when rule is not null then null
      when subject like '%.free-%-download.%' then '~.free-*-download.'
      when contains(subject, '.cheap-pills.') then '~.cheap-pills.'
      when contains(subject, '.spam-farm.') then '~.spam-farm.'
      when contains(subject, '/wp-admin/') then '~/wp-admin/'
      when contains(subject, '.casino.') then '~.casino.'
      when contains(subject, '/casino/') then '~/casino/' end as pattern
  from r
)
select page_id, host, path, rule, pattern,
  case when rule in ('net/', 'example.com/de/') or pattern is not null then 'block' else 'allow' end as verdict
from q
"""


@query("op4_url_rules", _OP4_SQL)
def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_rules.verdicts(pages, URL_RULES, URL_PATTERNS)
    return judged.select("page_id", "host", "path", "rule", "pattern", "verdict")


LICENSE_TEMPLATES = license_scan.default_templates()
LICENSE_GAP, LICENSE_ACCEPT = 3, 0.6


def _op8_sql() -> str:
    values = ", ".join(
        f"({t}, '{x.label}', {str(x.exact).lower()}, string_split('{x.text}', ' '))"
        for t, x in enumerate(LICENSE_TEMPLATES)
    )
    return f"""
with d as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
  from documents
), w as (
  select doc_id, unnest(w) as word, generate_subscripts(w, 1) - 1 as i from d
), g as (
  select doc_id, i, word as w1, lead(word) over s as w2, lead(word, 2) over s as w3
  from w window s as (partition by doc_id order by i)
), grams as (
  select doc_id, i, w1 || ' ' || w2 as gram from g where w2 is not null
  union all select doc_id, i, w1 || ' ' || w2 || ' ' || w3 from g where w3 is not null
), tw as (
  select * from (values {values}) v(template, label, exact, ws)
), tg as (
  select template, label, exact, len(ws) as length, least(3, len(ws)) as k, j,
    array_to_string(ws[j + 1 : j + least(3, len(ws))], ' ') as gram
  from (select *, unnest(range(0, len(ws) - least(3, len(ws)) + 1)) as j from tw)
), hits as (
  select distinct doc_id, template, label, exact, length, k, j, i - j as diagonal
  from grams join tg using (gram)
), diagonals as (
  select distinct doc_id, template, exact, diagonal from hits
), fresh as (
  select *, case when exact or diagonal - lag(diagonal) over (partition by doc_id, template order by diagonal) <= {LICENSE_GAP}
    and not exact then 0 else 1 end as f
  from diagonals
), islands as (
  select doc_id, template, diagonal, sum(f) over (partition by doc_id, template order by diagonal) as span from fresh
), covered as (
  select h.doc_id, h.template, h.label, h.exact, h.length, s.span, h.diagonal, unnest(range(h.j, h.j + h.k)) as spot
  from hits h join islands s on h.doc_id = s.doc_id and h.template = s.template and h.diagonal = s.diagonal
), spans as (
  select doc_id, template, label, exact, span, min(diagonal) as start, count(distinct spot) / length as share
  from covered group by doc_id, template, label, exact, length, span
), facts as (
  select doc_id,
    count(*) filter (where exact and share = 1) as n_base,
    min(start) filter (where exact and share = 1) as first_word,
    max(start) filter (where exact and share = 1) as last_word,
    string_agg(distinct label, ',' order by label) filter (where exact and share = 1) as base_labels,
    string_agg(distinct label, ',' order by label)
      filter (where (exact and share = 1) or (not exact and share >= {LICENSE_ACCEPT})) as labels,
    max(share) filter (where not exact or share = 1) as score
  from spans group by doc_id
)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0) as score
from d left join facts f on d.doc_id = f.doc_id
"""


@query("op8_license_scan", _op8_sql())
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.scan(docs, LICENSE_TEMPLATES, LICENSE_GAP, LICENSE_ACCEPT)


QUALITY_GRID = quality_rules.DEFAULT_GRID
QUALITY_ALLOWED, QUALITY_DELTA = 0.05, 0.05

_RULE_SQL = {
    "symbol_share": ("n_symbols", "word_chars"),
    "duplicate_line_share": ("n_dup_lines", "n_lines"),
    "repeated_word_share": ("n_repeat_words", "n_words"),
    "mean_word_chars": ("word_chars", "n_words"),
}


def _op9_sql() -> str:
    share = lambda r: "coalesce({} / nullif({}, 0), 0.0)".format(*_RULE_SQL[r])
    tests = " union all ".join(
        f"select stratum, '{r}' as rule, {c}::double as cut, {share(r)} >= {c} as hit from good"
        for r, cuts in QUALITY_GRID.items()
        for c in cuts
    )
    hits = " or ".join(
        f"coalesce({share(r)} >= (select cut from chosen c where c.stratum = m.stratum and c.rule = '{r}'), false)"
        for r in QUALITY_GRID
    )
    a, cells = QUALITY_ALLOWED / len(QUALITY_GRID), sum(map(len, QUALITY_GRID.values()))
    return f"""
with d as (
  select doc_id, coalesce(lang, '') as stratum, coalesce(text, '') as t,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w
  from documents
), x as (
  select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from d
), y as (
  select doc_id, i, word, lead(word) over s as b, lead(word, 2) over s as c from x window s as (partition by doc_id order by i)
), z as (
  select doc_id, i, count(*) over (partition by doc_id, word, b, c) as n from y where c is not null
), r as (
  select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as p from z where n > 1)
  group by doc_id
), l as (
  select doc_id, unnest(string_split(t, chr(10))) as line from d
), m1 as (
  select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines
  from l where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by doc_id
), m as (
  select d.doc_id, stratum, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
    (length(t) - length(translate(t, '{quality_rules.SYMBOLS}', '')))::bigint as n_symbols,
    coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_lines, 0) as n_lines, coalesce(n_repeat_words, 0) as n_repeat_words
  from d left join m1 using (doc_id) left join r using (doc_id)
), good as (
  select * from m where doc_id in (select doc_id from labels where quality = 1)
), tests as ({tests}
), counted as (
  select stratum, rule, cut, count(*) as n, count(*) filter (where hit) as k from tests group by stratum, rule, cut
), tails as (
  select *, case when k >= n * {a} then 1.0 else list_sum(list_transform(range(0, k + 1), lambda i:
    exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({a}) + (n - i) * ln(1 - {a})))) end as tail
  from counted
), chosen as (
  select stratum, rule, min(cut) as cut from tails
  where tail <= {QUALITY_DELTA} / ({cells} * (select count(distinct stratum) from good)) group by stratum, rule
), b as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, {hits} as hit from m
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not hit as kept
from b
"""


@query("op9_quality_rules", _op9_sql())
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    measured = materialize(quality_rules.metrics(docs), "metrics")
    cuts = quality_rules.cutoffs(measured, labels, QUALITY_GRID, QUALITY_ALLOWED, QUALITY_DELTA)
    judged = quality_rules.judge(measured, cuts, QUALITY_GRID)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    kept = ~failed & (F.size("rejected_by") == 0)
    return judged.select("doc_id", *counts, failed.alias("base_failed"), kept.alias("kept"))


@query("op1_minhash_dedup")
def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"), k=2, percent=80)


def fold(doc_id: str = "doc_id"):
    """The fold of a document: 2 is held out."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4))


def trained(docs: DataFrame) -> language.Model | None:
    return language.train(docs.filter(fold() != 2))


@query("op3_language_id")
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = language.predict(docs.select("doc_id", "text"), trained(docs.select("doc_id", "text", "lang")))
    return judged.select("doc_id", (fold() == 2).alias("held_out"), "lang_pred", "score")


@query("op6_decontaminate")
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_pii")
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    rank = lambda s: F.array_position(F.array(*map(F.lit, pii.KINDS)), s["kind"])
    merged = F.transform(
        F.array_sort(
            F.transform(
                F.concat("base", "added"),
                lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["stop"].alias("stop"), s["kind"].alias("kind")),
            )
        ),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")),
    )
    rows = found.select("doc_id", "base", "added", merged.alias("merged"))
    return rows.select(
        "doc_id",
        *[of(k) for k in pii.KINDS],
        F.sha2(pii.listed("base").cast("binary"), 256).alias("base_sha256"),
        pii.listed("merged").alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


SEQUENCE_TOKENS, END_ID = 2048, 1


def tokenizer_file() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


@query("op2_packing")
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = packing.pieces(docs, tokenizer_file(), END_ID, SEQUENCE_TOKENS, with_ids=False)
    packed = packing.assign(cut, SEQUENCE_TOKENS)
    return packed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "seq_length"
    )


@query("op5_substring_dedup")
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.remove(table(spark, sf_dir, "documents"), window=50)
    return cut.select("doc_id", "n_words", "n_removed", "kept_sha256")


SEPARATOR_ID, ID_BYTES = 50256, 2  # the vocabulary has 50,257 ids


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    manifest = token_files.write(docs, tokenizer_file(), SEPARATOR_ID, id_bytes=ID_BYTES)
    found = token_files.counts(manifest.select("file", "size"), SEPARATOR_ID, id_bytes=ID_BYTES)
    return manifest.join(found, ["file", "ordinal"]).select("doc_id", "n_tokens")


_OP11_SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as q
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select a.vec_id as anchor_id, r.vec_id as row_id, a.label = r.label as same, list_inner_product(a.q, r.q)::bigint as score
  from v a join v r on a.vec_id % 50 = 0 and a.vec_id <> r.vec_id
), positives as (
  select anchor_id, row_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, row_id) <= 5
), fit as (
  select p.anchor_id, positive_id, row_id as negative_id, positive_score, score as negative_score,
    row_number() over (partition by p.anchor_id, positive_id order by score desc, row_id)::int as rank
  from positives p join scored s on p.anchor_id = s.anchor_id and not s.same
    and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from fit where rank <= 3
"""


@query("op11_hard_negatives", _OP11_SQL)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return hard_negatives.mine(rows, F.col("vec_id") % 50 == 0, positives=5, negatives=3, low_percent=50, high_percent=95)


_OP12_SQL = """
with t as (
  select doc_id, row_number() over () as d, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w
  from documents
), held as (
  select doc_id, d, len(w)::bigint as n, w from t where len(w) > 0
), totals as (
  select count(*)::bigint as docs, sum(n)::bigint as length from held
), tf as (
  select d, doc_id, n, term, count(*)::bigint as tf from (select d, doc_id, n, unnest(w) as term from held) group by all
), weights as (
  select term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::bigint as w
  from (select term, count(*)::bigint as df from tf group by term), totals
), impacts as (
  select d, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // length)))) as impact
  from tf join weights using (term), totals
), wanted as (
  select distinct item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term
  from benchmark
), scored as (
  select item_id, d, doc_id, sum(impact)::bigint as score from wanted join impacts using (term) group by item_id, d, doc_id
)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score
from scored where score > 0 qualify rank <= 50
"""


@query("op12_ranked_search", _OP12_SQL)
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


_OP13_SQL = """
with p as (
  select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest
  from pages
), g as (
  select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload_digest, payload_bytes) else page_id end as first
  from p
)
select page_id, payload_bytes, payload_digest, case when first = page_id then 'response' else 'revisit' end as record_type,
  case when first <> page_id then first end as refers_to
from g
"""


@query("op13_warc_transactions", _OP13_SQL)
def op13_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(table(spark, sf_dir, "pages"), revisit_bytes=1000)
    # Kept without the bytes themselves, of which only size and digest are asked for.
    records = materialize(warc.read(archives, payloads=False).drop("payload"), "records")
    assembled = materialize(warc.captures(records), "captures")
    page = lambda records: F.col(records)[0]["fields"]["page-id"].cast("long")
    rows = warc.resolve(assembled)
    return rows.select(
        page("metadata").alias("page_id"),
        F.coalesce("payload_bytes", F.col("first.payload_bytes")).alias("payload_bytes"),
        F.coalesce(F.col("first.payload_digest"), "payload_digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        page("first.metadata").alias("refers_to"),
    )
