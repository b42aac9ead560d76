"""Thin queries over the llm operators, as registered by the driver contract."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import runtime
from loomgraph.llm import audio, decontam, edit_counts, html_text, jaccard, langid, packing, repeats, secret_scan, tokens

#: The vocabulary file of the token operators; a parameter of each of them.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out(F.col("doc_id")))
    return langid.identify(docs, ["doc_id", "held_out"])


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(_table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return packing.pack(packing.cut_documents(docs, VOCABULARY)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.audio_features(_table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_counts.edited_counts(_table(spark, sf_dir, "documents"), VOCABULARY)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ledger = _table(spark, sf_dir, "documents"), runtime.fresh_path(spark, "secret_ledger")
    # The base kinds first; the second scan finds them in the ledger and looks only for the kinds that are new.
    secret_scan.scan(docs, ["doc_id"], ledger, tuple(r for r in secret_scan.RULES if r.base))
    return secret_scan.report(docs, ledger)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"), digest=True)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return tokens.read_token_files(tokens.write_token_files(docs, VOCABULARY, runtime.fresh_path(spark, "token_files")))


def queries() -> dict:
    return {f.__name__: f for f in (op1_benchmark_decontamination, op2_language_id, op3_ngram_jaccard_join, op4_best_fit_packing, op5_audio_features, op6_html_extraction, op7_token_counts, op8_secret_scan, op9_substring_dedup, op10_token_files)}


# --- SQL for those that it can express

_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

_REPEATS = f"""
with d as (select doc_id, {_WORDS} w from documents),
 p as (select doc_id, w, unnest(range(1, len(w) - 33)) i from d where len(w) >= 35),
 h as (select doc_id, i, md5(array_to_string(w[i:i+34], ' ')) k from p),
 r as (select doc_id, i from h where k in (select k from h group by 1 having count(*) > 1)),
 g as (select distinct doc_id, unnest(range(i, i + 35)) j from r),
 c as (select doc_id, list(j) gone from g group by 1)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(len(gone), 0) as bigint) n_removed,
 sha256(array_to_string(case when gone is null then w else list_filter(w, lambda x, k: not list_contains(gone, k)) end, ' ')) kept_sha256
from d left join c using (doc_id)"""

_JACCARD = """
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w from documents),
 s as (select distinct doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i+3], ' '))) g from d where len(w) > 0),
 n as (select doc_id, count(*) n from s group by 1),
 p as (select a.doc_id x, b.doc_id y, count(*) c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
 l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 85 * (a.n + b.n - c)),
 r as (select doc_id id, doc_id t from documents union select id, y from r join l on x = t)
select d.doc_id, coalesce(n, 0) n_shingles, (select min(t) from r where id = d.doc_id) component_id from d left join n using (doc_id)"""


def _secrets_sql() -> str:
    parts = []
    for k, r in enumerate(secret_scan.RULES):
        pattern = r.pattern.replace("'", "''")
        parts.append(
            f"select doc_id, {k} rank, '{r.kind}' kind, {'true' if r.base else 'false'} base, list_transform(regexp_split_to_array(t, '{pattern}'), lambda x: length(x)) gaps, "
            f"list_transform(regexp_extract_all(t, '{pattern}', 0), lambda x: length(x)) sizes, list_transform(regexp_extract_all(t, '{pattern}', {r.group}), lambda x: length(x)) judged, {r.least} least from d"
        )
    return f"""
with d as (select doc_id, coalesce(text, '') t from documents), m as ({" union all ".join(parts)}),
 f as (select *, unnest(range(1, len(sizes) + 1)) i from m where len(sizes) > 0),
 s as (select doc_id, rank, kind, base, cast(list_sum(gaps[1:i]) + coalesce(list_sum(sizes[1:i-1]), 0) as bigint) a, sizes[i] n from f where judged[i] >= least)
select d.doc_id, count(*) filter (kind = 'assign') n_assign, count(*) filter (kind = 'access') n_access, count(*) filter (kind = 'hex') n_hex,
 sha256(coalesce(string_agg(kind || ':' || a || ':' || (a + n), ',' order by a, rank) filter (base), '')) base_sha256,
 coalesce(string_agg(kind || ':' || a || ':' || (a + n), ',' order by a, rank), '') spans
from d left join s using (doc_id) group by d.doc_id"""


def _templates_sql() -> str:
    tokens_of = f"regexp_extract_all(lower(regexp_replace(regexp_replace(TEXT, '{decontam.NAME_PATTERN}', '\\1{decontam.NAME}\\2', 'g'), '({decontam.NUMBER_PATTERN})', '{decontam.NUMBER}\\1', 'g')), '{decontam.TOKEN_PATTERN}')"
    units = ", ".join(f"'{u}'" for u in decontam.UNITS)
    template = f"list_transform(t, lambda x, i: case when starts_with(x, '§a') then '§a' when starts_with(x, '§n') then '§n' when i > 1 and starts_with(t[i-1], '§n') and x in ({units}) then '§u' else x end)"
    return f"""
with d0 as (select doc_id, {tokens_of.replace("TEXT", "coalesce(text, '')")} t from documents), d as (select doc_id, t, {template} m from d0),
 i0 as (select distinct item_id, text from benchmark where text is not null),
 i1 as (select item_id, case when regexp_matches(trim(text), '^\\p{{Lu}}') then ({tokens_of.replace("TEXT", "trim(text)")})[2:] else {tokens_of.replace("TEXT", "trim(text)")} end t from i0),
 b as (select item_id, t, {template} m from i1),
 bw as (select item_id, i - 1 place, array_to_string(m[i:i+4], chr(1)) k from (select *, unnest(range(1, len(m) - 3)) i from b where len(m) >= 5) x where len(list_filter(m[i:i+4], lambda x: not starts_with(x, '§'))) >= 3),
 nw as (select item_id, count(*) n_windows from bw group by 1),
 dw as (select doc_id, i - 1 place, array_to_string(m[i:i+4], chr(1)) k from (select *, unnest(range(1, len(m) - 3)) i from d where len(m) >= 5) x),
 l as (select distinct doc_id, item_id, bw.place place, dw.place - bw.place shift from dw join bw using (k)),
 ln as (select *, count(*) over (partition by doc_id, item_id, shift) n from l),
 bd as (select *, 0 dealing, cast(floor(shift / 8) as bigint) band from ln union all select *, 1, cast(floor((shift + 4) / 8) as bigint) from ln),
 c as (select doc_id, item_id, dealing, band, count(distinct place) n_matched, any_value(n_windows) n_windows from bd join nw using (item_id) group by 1, 2, 3, 4 having count(distinct place) >= 0.8 * any_value(n_windows)),
 k as (select c.doc_id, c.item_id, c.dealing, c.band, token, n, shift, min(greatest(place - token, token - place - 4, 0)) far from c join b using (item_id), unnest(range(len(b.t))) u(token), bd where bd.doc_id = c.doc_id and bd.item_id = c.item_id and bd.dealing = c.dealing and bd.band = c.band group by all),
 kk as (select *, row_number() over (partition by doc_id, item_id, dealing, band, token order by far, n desc, shift) r from k),
 s as (select distinct kk.doc_id, kk.item_id, dealing, band, b.t[token + 1] x, d.t[token + 1 + shift] y from kk join b using (item_id) join d on d.doc_id = kk.doc_id where r = 1 and starts_with(b.m[token + 1], '§') and token + shift >= 0 and d.m[token + 1 + shift] = b.m[token + 1]),
 o as (select doc_id, item_id, dealing, band, count(*) n, count(distinct x) nx, bool_and(x = y) same from s group by 1, 2, 3, 4),
 g as (select c.*, coalesce(same, true) same, row_number() over (partition by c.doc_id, c.item_id order by n_matched / n_windows desc, coalesce(same, true) desc, n_matched desc) r from c left join o using (doc_id, item_id, dealing, band) where n is null or n = nx)
select doc_id, item_id, n_matched, n_windows, n_matched / n_windows coverage, case when same then 'verbatim' else 'reparameterised' end kind from g where r = 1"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_benchmark_decontamination": _templates_sql(),
        "op3_ngram_jaccard_join": _JACCARD,
        "op8_secret_scan": _secrets_sql(),
        "op9_substring_dedup": _REPEATS,
    }
