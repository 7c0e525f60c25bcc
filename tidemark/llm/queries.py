"""The queries of this subpackage: name to function of (spark, sf_dir), and DuckDB SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, brown, extraction, interaction, jaccard, media, packing, perplexity, quality, recipes, sanitising, sharding, whitening
from tidemark.llm._arrow import prepare


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, cut and packed into sequences of 1,024 tokens; null is empty."""
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path(), 1024)


def op2_brown_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by class n-grams that learn from six sevenths of them; null is empty."""
    return brown.log10_scores(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their counts, and whether their perplexity lies in their language's band; null is empty."""
    return perplexity.rules(_table(spark, sf_dir, "documents"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as 8-bit samples in tar shards, read back; null is empty."""
    return media.media_columns(_table(spark, sf_dir, "documents"))


def op6_tree_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages; null is empty."""
    return extraction.extract(_table(spark, sf_dir, "pages"))


def op5_quadratic_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored for quality by two thirds of the labels; null is empty."""
    return quality.classify(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))


def op7_hypergeometric_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards under the law `rows`; null is empty."""
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), 40)


def op8_disclosure_sanitising(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the spans of personal data and of terms that disclose it; null is empty."""
    return sanitising.find(_table(spark, sf_dir, "documents"))


def op9_relation_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the component of those that share 90 % of their 3-word shingles; null has none."""
    return jaccard.similar(_table(spark, sf_dir, "documents"), 3, 90)


def op10_streaming_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded as streams; null is empty."""
    return bpe.encode_decode(_table(spark, sf_dir, "documents"), tokenizer_path())


def op11_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by their texts without white space, compared by recipes of verified chunks; null is the empty text."""
    return recipes.groups(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_walsh_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents in all 120 orders, from 32 parity sums for each source and label."""
    return interaction.audit(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"), _table(spark, sf_dir, "labels"))


def op13_tsqr_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of `embeddings`, whitened by the first eight components of their tall-skinny QR factorisation."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), 8)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_harmonic_packing": op1_harmonic_packing,
    "op2_brown_classes": op2_brown_classes,
    "op3_perplexity_rules": op3_perplexity_rules,
    "op4_media_columns": op4_media_columns,
    "op5_quadratic_quality": op5_quadratic_quality,
    "op8_disclosure_sanitising": op8_disclosure_sanitising,
    "op9_relation_jaccard_join": op9_relation_jaccard_join,
    "op10_streaming_bpe": op10_streaming_bpe,
    "op6_tree_extraction": op6_tree_extraction,
    "op7_hypergeometric_sharding": op7_hypergeometric_sharding,
    "op11_chunk_recipes": op11_chunk_recipes,
    "op12_walsh_audit": op12_walsh_audit,
    "op13_tsqr_whitening": op13_tsqr_whitening,
}

#: All pairs of documents with a common n-gram; right at any size and quick on small tables.
JACCARD_SQL = r"""with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, unnest(list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [list_aggregate(w, 'string_agg', chr(1))] else list_transform(range(1, len(w) - 1), lambda i: w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2]) end)) as g from w),
n as (select doc_id, count(*) as n from s group by 1),
i as (select a.doc_id as x, b.doc_id as y, count(*) as i from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from i join n p on p.doc_id = x join n q on q.doc_id = y where 100 * i >= 90 * (p.n + q.n - i)),
e as (select x, y from l union all select y, x from l),
r as (select doc_id as x, doc_id as y from documents union select r.x, e.y from r join e on e.x = r.y)
select d.doc_id, coalesce(n.n, 0) as n_shingles, m.c as component_id from documents d left join n on n.doc_id = d.doc_id join (select x, min(y) as c from r group by 1) m on m.x = d.doc_id"""

RECIPES_SQL = r"""with n as (select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as t from documents),
r as (select doc_id, t, count(*) over w as group_size, first_value(doc_id) over (w order by n desc, doc_id rows between unbounded preceding and unbounded following) as keep_id from n window w as (partition by t))
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t) as text_sha256 from r"""

#: Every order replayed over the documents themselves, counted by part and failed filters; no parity sums and no closed form.
AUDIT_SQL = r"""with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
f as (select part, coalesce(l.quality = 1, false) as good, coalesce(l.toxic = 1, false) as bad,
  (case when len(w) < 200 then 'A' else '' end) || (case when 100 * len(list_distinct(w)) < 50 * len(w) then 'B' else '' end) || (case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) then 'C' else '' end)
  || (case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end) || (case when min(d.doc_id) over (partition by t) < d.doc_id then 'E' else '' end) as fails
  from d left join labels l on l.doc_id = d.doc_id),
c as (select part, fails, count(*) as n, count(*) filter (good) as g, count(*) filter (bad) as b from f group by 1, 2),
l as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
o as (select a.x || b.x || c.x || d.x || e.x as filter_order from l a, l b, l c, l d, l e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s as (select filter_order, step, substr(filter_order, step, 1) as own, substr(filter_order, 1, step - 1) as before from o, (select unnest([1, 2, 3, 4, 5]) as step)),
m as (select part, filter_order, step, own, n, g, b, fails, contains(fails, own) as failing, before <> '' and fails <> '' and len(list_intersect(string_split(before, ''), string_split(fails, ''))) > 0 as gone from c, s),
r as (select part, filter_order, step, own, sum(n) filter (not failing and not gone) as kept, sum(n) filter (failing and not gone) as removed, sum(n) filter (failing and gone) as redundant,
  sum(n) filter (fails = own) as unique_fails, sum(g) filter (failing and not gone) as good_lost, sum(b) filter (failing and not gone) as toxic_lost from m group by all)
select part, filter_order, step::int as step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant, coalesce(unique_fails, 0)::bigint as unique_fails,
  coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost, (sum(coalesce(removed, 0)) over (partition by part, own))::bigint as shapley from r"""

ORACLE_SQL: dict[str, str] = {"op9_relation_jaccard_join": JACCARD_SQL, "op11_chunk_recipes": RECIPES_SQL, "op12_walsh_audit": AUDIT_SQL}
