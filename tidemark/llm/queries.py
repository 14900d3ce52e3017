"""The queries of the training-data operators, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, UPPER, ascii_lower, crc_mod, table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.decontamination import contaminated

    return contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.language_id import fit_language_model, identify_language

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = crc_mod(F.col("doc_id"), 4) == 2
    model = fit_language_model(docs.filter(~held))
    found = identify_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.license_scan import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op4_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.vector_dedup import link_vectors

    return link_vectors(table(spark, sf_dir, "embeddings"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.url_filter import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's length is its number of white-space words and one end mark."""
    from tidemark.llm.packing import pack_documents

    docs = table(spark, sf_dir, "documents").select("doc_id", word_length(F.col("text")).alias("n_tokens"))
    return pack_documents(docs)


def word_length(text):
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemark.llm.token_files import token_files

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_files(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.toxicity import fit_factorization_machine, score_toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = crc_mod(F.col("doc_id"), 5) == 0
    labels = table(spark, sf_dir, "labels").filter(~held).select(F.col("doc_id").alias("_labelled"), "toxic")
    # One label for a document: the highest, should rows repeat.
    labels = labels.groupBy("_labelled").agg(F.max("toxic").alias("toxic"))
    model = fit_factorization_machine(docs.join(labels, F.col("doc_id") == F.col("_labelled")).select("doc_id", "text", "toxic"))
    return score_toxicity(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.substring_dedup import dedup_substrings

    return dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives all pages, finds each by its url and id in the capture index, and reads its record."""
    from tidemark.llm.warc import archive_pages, read_pages

    pages = table(spark, sf_dir, "pages")
    found = read_pages(spark, archive_pages(pages), pages.select("url", "page_id"), payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of all documents with their proofs; where 3 divides the id's crc32, a leaf of the lower-cased text is folded instead."""
    from tidemark.llm.merkle import fold, leaf_hash, merkle_manifest, proof_hash

    docs = table(spark, sf_dir, "documents")
    rest, text = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], F.col("text")
    changed = F.when(crc_mod(F.col("doc_id"), 3) == 0, leaf_hash([*rest, ascii_lower(text)]))
    leaves = docs.select("doc_id", "lang", leaf_hash([*rest, text]).alias("leaf"), changed.alias("changed"))
    found = merkle_manifest(leaves, ["doc_id"])
    found = found.select("doc_id", "leaf", "subroot", "root", proof_hash(F.col("proof")).alias("proof_sha256"), fold(F.coalesce("changed", "leaf"), F.col("proof")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_decontamination, op2_language_id, op3_license_scan, op4_vector_dedup, op5_url_filter, op6_best_fit_packing, op7_token_files, op8_toxicity, op9_jaccard_join, op10_substring_dedup, op11_warc_index, op12_phrase_mining, op13_merkle_manifest)}


#: Words of a document and a running list of its 20-word windows; the first place of each window stays.
SUBSTRING_SQL = r"""
with doc as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
win as (select doc_id, unnest(range(1, len(w) - 18)) as s, w from doc where len(w) >= 20),
h as (select doc_id, s, array_to_string(w[s:s+19], ' ') as k from win),
r as (select doc_id, s, row_number() over (partition by k order by doc_id, s) as n from h),
c as (select distinct doc_id, unnest(range(s, s + 20)) as p from r where n > 1),
g as (select doc_id, list(p) as gone, count(*) as n_removed from c group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_removed, 0) as bigint) as n_removed,
  sha256(array_to_string(list_filter(w, lambda x, i: gone is null or not list_contains(gone, i)), ' ')) as kept_sha256
from doc left join g using (doc_id)
"""

#: Copies of a text have its set, so that the least id of each different text stands for them.
JACCARD_SQL = r"""
with recursive doc as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
t as (select distinct doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda k: array_to_string(w[k:k+4], ' '))) as s from doc where len(w) > 0),
n as (select doc_id, count(*) as n from t group by doc_id),
c as (select a.doc_id as a, b.doc_id as b, count(*) as shared from t a join t b on a.s = b.s and a.doc_id <> b.doc_id group by all),
e as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 75 * (x.n + y.n - shared)),
reach as (select doc_id, doc_id as root from doc union select e.b, reach.root from reach join e on e.a = reach.doc_id)
select doc_id, cast(coalesce(max(n), 0) as bigint) as n_shingles, min(root) as component_id from reach left join n using (doc_id) group by doc_id
"""

#: All pairs of one label; components by reachability.
VECTOR_SQL = r"""
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
  where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
big as (select * replace (list_transform(e, lambda x: x / s) as e) from (select *, pow(2, floor(log2(greatest(list_max(e), -list_min(e))))) as s from v where list_max(e) > 0 or list_min(e) < 0)),
n as (select *, list_dot_product(e, e) as m from big),
e as (select a.vec_id as a, b.vec_id as b from n a join n b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where a.m > 0 and b.m > 0 and list_dot_product(a.e, b.e) / sqrt(a.m * b.m) >= 0.93),
reach as (select vec_id, vec_id as root from embeddings union select e.b, reach.root from reach join e on e.a = reach.vec_id),
c as (select vec_id, min(root) as component_id from reach group by vec_id),
l as (select a as vec_id, count(*) as n_links from e group by a)
select vec_id, cast(coalesce(n_links, 0) as bigint) as n_links, component_id, vec_id = component_id as kept
from embeddings left join l using (vec_id) join c using (vec_id)
"""


#: Base32 of a SHA-1: eight groups of five bytes, each as a number of forty bits.
WARC_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html) as payload_bytes, sha1(html) as hex, max(page_id) over (partition by sha1(html)) as best from p),
b as (select *, list_transform(range(0, 32), lambda k: cast(('0x' || hex[k // 8 * 10 + 1 : k // 8 * 10 + 10]) as bigint) >> (35 - k % 8 * 5) & 31) as fives from d)
select page_id, payload_bytes, array_to_string(list_transform(fives, lambda v: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[v + 1]), '') as payload_digest,
  case when page_id is not distinct from best then 'response' else 'revisit' end as record_type,
  case when page_id is distinct from best then best end as refers_to
from b
"""

#: All phrases of 1 to 3 words, counted one by one; products in 128 bits.
PHRASE_SQL = r"""
with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as p from documents),
w as (select lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') as w from p),
k as (select unnest([1, 2, 3]) as k),
g as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as g from w, k where len(w) >= k),
f as (select lang, k, g, count(*) as f from g group by all),
n as (select lang, sum(f) as n from f where k = 1 group by lang),
cand as (select lang, k, g, f as a from f where k > 1 and f >= 10),
cuts as (select lang, k, g, a, unnest(range(1, k)) as j from cand),
parts as (select *, array_to_string((string_split(g, ' '))[1:j], ' ') as x, array_to_string((string_split(g, ' '))[j + 1:k], ' ') as y from cuts),
scored as (select c.lang, c.k, c.g, c.a, c.j, x.f as l, y.f as r, 1000000::hugeint * c.a * c.a // (x.f::hugeint * y.f) as score
  from parts c join f x on x.lang = c.lang and x.g = c.x and x.k = c.j join f y on y.lang = c.lang and y.g = c.y and y.k = c.k - c.j),
lowest as (select * from scored qualify row_number() over (partition by lang, g order by score, j) = 1),
longer as (select lang, part, max(a) as best from (
  select lang, a, unnest([array_to_string((string_split(g, ' '))[1:2], ' '), array_to_string((string_split(g, ' '))[2:3], ' ')]) as part from cand where k = 3) group by all),
kept as (select b.* from lowest b left join longer o on o.lang = b.lang and o.part = b.g and b.k = 2 where o.best is null or 100 * o.best < 50 * b.a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(g)) as rank from kept)
select lang, rank, g as phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score from ranked join n using (lang) where rank <= 2000
"""

#: Levels of a tree, more than any table here has at a fanout of 8; a level of one node is the one below.
TREE_LEVELS = 8


def _levels_sql(name: str, group: str, levels: int) -> str:
    """CTEs {name}1 to {name}{levels} above {name}0 (group, i, h): a run's siblings left and right of each node, then the next level's nodes."""
    parts = []
    for k in range(levels):
        run = f"partition by {group}, i // 8 order by i"
        many = f"count(*) over (partition by {group}) > 1"
        parts.append(
            f"""{name}p{k} as (select {group}, i, h, {many} as many,
  coalesce(string_agg(h, '') over ({run} rows between unbounded preceding and 1 preceding), '') as l,
  coalesce(string_agg(h, '') over ({run} rows between 1 following and unbounded following), '') as r from {name}{k}),
{name}{k + 1} as (select {group}, i // 8 as i, case when bool_or(many) then sha256(string_agg(h, '' order by i)) else min(h) end as h from {name}p{k} group by 1, 2)"""
        )
    return ",\n".join(parts)


def _climb_sql(name: str, group: str, levels: int, at: str) -> tuple[str, str, str]:
    """Joins of a row (group, at) with its node at each level, its siblings' hashes, and the folding of column f{name}0."""
    joins = "\n".join(f"  join {name}p{k} {name}s{k} on {name}s{k}.{group} = b.{group} and {name}s{k}.i = {at} // {8**k}" for k in range(levels))
    siblings = ", ".join(f"case when {name}s{k}.many then {name}s{k}.l || {name}s{k}.r else '' end" for k in range(levels))
    return joins, f"concat({siblings})", ", ".join(f"struct_pack(m := {name}s{k}.many, l := {name}s{k}.l, r := {name}s{k}.r)" for k in range(levels))


def _merkle_sql() -> str:
    """Levels unrolled; groups are numbered, as nulls don't join; crc32 bit by bit, over the digits of an id."""
    field = "coalesce(strlen({0}) || ':' || {0}, '-')"
    fields = " || ".join(field.format(f"cast({c} as varchar)") for c in ("doc_id", "source", "lang", "n_chars"))
    lower = f"translate(text, '{UPPER}', '{LOWER}')"
    low_joins, low_siblings, low_steps = _climb_sql("n", "g", TREE_LEVELS, "b.p")
    top_joins, top_siblings, top_steps = _climb_sql("t", "a", 4, "b.g")
    return f"""
with digits as (select *, cast(doc_id as varchar) as id from documents),
crc as (select distinct id, xor(list_reduce(flatten(list_transform(range(1, length(id) + 1), lambda k: [ascii(id[k]), -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda c, x: case when x >= 0 then xor(c, cast(x as bigint)) when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, 4294967295::bigint), 4294967295::bigint) as crc
  from digits where id is not null),
leaves as (select doc_id, lang, sha256({fields} || {field.format("text")}) as leaf,
    sha256({fields} || {field.format(f"case when crc % 3 = 0 then {lower} else text end")}) as changed from digits left join crc using (id)),
base as (select *, dense_rank() over (order by lang nulls first) - 1 as g, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as p, 0 as a from leaves),
n0 as (select g, p as i, leaf as h from base),
{_levels_sql("n", "g", TREE_LEVELS)},
t0 as (select 0 as a, g as i, h from n{TREE_LEVELS}),
{_levels_sql("t", "a", 4)},
climbed as (select b.doc_id, b.leaf, b.changed, sub.h as subroot, top.h as root, sha256({low_siblings} || {top_siblings}) as proof_sha256, [{low_steps}, {top_steps}] as steps
  from base b
{low_joins}
{top_joins}
  join n{TREE_LEVELS} sub on sub.g = b.g join t4 top on top.a = b.a),
folded as (select *, list_reduce(list_transform(steps, lambda s: struct_pack(m := s.m, l := s.l, r := s.r, h := '')),
    lambda x, s: struct_pack(m := s.m, l := s.l, r := s.r, h := case when s.m then sha256(s.l || x.h || s.r) else x.h end), struct_pack(m := false, l := '', r := '', h := changed)).h as folded_root from climbed)
select doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root as verified from folded
"""


def oracle_sql() -> dict[str, str]:
    from tidemark.llm.decontamination import CONTAMINATED_SQL

    return {"op1_decontamination": CONTAMINATED_SQL, "op4_vector_dedup": VECTOR_SQL, "op9_jaccard_join": JACCARD_SQL, "op10_substring_dedup": SUBSTRING_SQL, "op11_warc_index": WARC_SQL, "op12_phrase_mining": PHRASE_SQL, "op13_merkle_manifest": _merkle_sql()}
