"""The corpus operators as queries over the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_extract, lang_id, lm_score, near_dedup, passage_dedup, quality, secret_scan, sp_codec, token_output
from .common import bounded, read


def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return secret_scan.scan(docs, names=secret_scan.identifiers(docs))


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(read(spark, sf_dir, "documents"))


def leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(read(spark, sf_dir, "documents"))


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_output.folder(spark)
    token_output.write(read(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"))
    return token_output.read_digests(spark, path)


def sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("piece_bpe_32k.model")
    return sp_codec.encode(read(spark, sf_dir, "documents"), path, digests=True)


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = lang_id.fit(docs.filter(lang_id.fold("doc_id") != 1))
    held = F.coalesce(lang_id.fold("doc_id") == 1, F.lit(False)).alias("held_out")
    return lang_id.predict(docs, model).select("doc_id", held, "lang_pred", "score")


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages"))


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(read(spark, sf_dir, "documents"))


def repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup.repeats(read(spark, sf_dir, "documents"))


def queries() -> dict:
    found = {
        "op1_secret_scan": secrets,
        "op2_html_extract": page_texts,
        "op3_lm_score": model_scores,
        "op4_near_dedup": near_duplicates,
        "op5_decontamination": leaks,
        "op6_token_output": token_files,
        "op7_sentencepiece": sentencepiece_codec,
        "op8_quality_rules": quality_rules,
        "op9_passage_dedup": repeated_passages,
        "op10_language_id": languages,
    }
    return {name: bounded(q) for name, q in found.items()}


#: Runs as in decontaminate, by string; DuckDB.
LEAKS_SQL = r"""
with words as (
  select doc_id, string_split_regex(trim(lower(text), E' \t\n\x0b\x0c\r'), '[\x20\x09-\x0D]+') w from documents where doc_id is not null and trim(text, E' \t\n\x0b\x0c\r') <> ''
), spread as (
  select distinct doc_id, array_to_string(w[i:i + 4], ' ') run from (select doc_id, w, unnest(range(1, len(w) - 3)) i from words where len(w) >= 5)
), item_words as (
  select item_id, string_split_regex(trim(lower(text), E' \t\n\x0b\x0c\r'), '[\x20\x09-\x0D]+') w from benchmark where item_id is not null and trim(text, E' \t\n\x0b\x0c\r') <> ''
), item_runs as (
  select distinct item_id, array_to_string(w[i:i + 4], ' ') run from (select item_id, w, unnest(range(1, len(w) - 3)) i from item_words where len(w) >= 5)
), sizes as (select item_id, count(*) n_item from item_runs group by item_id),
shared as (select doc_id, item_id, count(*) n_shared from spread join item_runs using (run) group by doc_id, item_id)
select doc_id, item_id, n_item, n_shared, n_shared / n_item as containment
from shared join sizes using (item_id) where n_shared >= 0.8 * n_item - 1e-9
union all
select distinct doc_id, item_id, 1, 1, 1.0 from (select item_id, len(w) n, array_to_string(w, ' ') run from item_words where len(w) < 5)
join (select doc_id, n, array_to_string(w[i:i + n - 1], ' ') run from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from words, (select distinct len(w) n from item_words where len(w) < 5) l)) using (n, run)
"""


#: The counts of each text, and the verdict by lines in more than 20 and 3 % of a host's different documents.
QUALITY_SQL = r"""
with given as (select row_number() over () r, doc_id, source, coalesce(text, '') t from documents),
low as (select r, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from given),
texts as (select r, doc_id, coalesce('h' || source, '') host, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') w from given),
own as (select r, array_to_string(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), ' ') own from low),
runs as (select r, i, array_to_string(w[i:i + 2], ' ') run from (select r, w, unnest(range(1, len(w) - 1)) i from texts where len(w) >= 3)),
again as (select r, run from runs group by r, run having count(*) > 1),
repeated as (select r, count(distinct j) n from (select r, unnest([i, i + 1, i + 2]) j from runs join again using (r, run)) group by r),
pieces as (select r, unnest(string_split(t, chr(10))) line from given),
equal as (select r, count(*) - count(distinct line) n from pieces where regexp_matches(line, '[^\x20\x09-\x0D]') group by r),
lines as (select r, array_to_string(w, ' ') line, len(w) n from (select r, regexp_extract_all(unnest(string_split(t, chr(10))), '[^\x20\x09-\x0D]+') w from low) where len(w) > 0),
hosts as (select host, count(distinct own) n from texts join own using (r) group by host),
often as (select host, line from (select host, line, count(distinct own) often_n from lines join texts using (r) join own using (r) group by host, line) join hosts h using (host) where often_n > 20 and often_n > 0.03 * h.n),
gone as (select r, sum(lines.n) n from lines join texts using (r) join often using (host, line) group by r),
counts as (
  select r, doc_id, len(w) n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) n_symbols,
    coalesce(equal.n, 0) n_dup_lines, coalesce(repeated.n, 0) n_repeat_words, coalesce(gone.n, 0) n_removed
  from texts left join equal using (r) left join repeated using (r) left join gone using (r)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and n_words - n_removed >= 0.5 * n_words as kept, cast(n_removed as bigint) n_removed
from counts
"""

#: Links by the weighted Jaccard similarity of word shingles, and the least document that they reach.
NEAR_SQL = r"""
with recursive texts as (
  select min(doc_id) node, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') w from documents where doc_id is not null and text is not null group by text
), runs as (
  select node, array_to_string(w[i:i + 4], ' ') run, count(*) n from (select node, w, unnest(range(1, greatest(len(w) - 3, 2))) i from texts where len(w) > 0) group by all
), sizes as (select node, sum(n) size from runs group by node),
shared as (select a.node a, b.node b, sum(least(a.n, b.n)) n from runs a join runs b using (run) where a.node < b.node group by all),
links as (select a, b from shared join sizes x on a = x.node join sizes y on b = y.node where n >= 0.8 * (x.size + y.size - n) - 1e-9),
ways as (select a, b from links union all select b, a from links),
reach as (select node, node as class_id from texts union select ways.b, reach.class_id from reach join ways on ways.a = reach.node where reach.class_id < ways.b),
classes as (select text, min(class_id) class_id from reach join texts using (node) group by text)
select doc_id, class_id from documents join classes using (text) where doc_id is not null
union all select doc_id, doc_id from documents where doc_id is null or text is null
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_near_dedup": NEAR_SQL, "op5_decontamination": LEAKS_SQL, "op8_quality_rules": QUALITY_SQL}
