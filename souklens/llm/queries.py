"""Registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, embedding_dedup, lexical_search, licenses, mixing, ngram_jaccard, pii, quality, secrets, sentencepiece_codec, token_count, url_filter, vector_search
from .common import table

log = logging.getLogger(__name__)

#: The setting that holds the key of the pseudonyms, and the key of tests and trials, which whoever has this file knows.
KEY_SETTING, KEY = "spark.souklens.pii.key", b"a key for tests alone"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"


def pii_key(spark: SparkSession) -> bytes:
    """The session's key; without one the tests' key, with a warning."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        log.warning("%s is not set: pseudonyms are made with the key of the tests and can be undone", KEY_SETTING)
    return key.encode() if key else KEY


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.counted(table(spark, sf_dir, "documents"), pii_key(spark))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.grouped(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality.measured(table(spark, sf_dir, "documents").select("doc_id", "text"), into="q")
    return q.select("doc_id", *[f"q.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.counts_only(table(spark, sf_dir, "documents"), MODEL)


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.deduplicated(table(spark, sf_dir, "embeddings"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), MODEL, keep_text=False)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), max_epochs=2).select("doc_id", "domain", "lang", "source", "epoch")


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = secrets.scanned(table(spark, sf_dir, "documents").select("doc_id", "text"), into="s").drop("text")
    base = F.filter("s", lambda x: x["kind"] != "entropy")
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return a.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("s")).alias("spans"))


def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.searched(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(table(spark, sf_dir, "documents"), BYTE_BPE, MODEL)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_pii, op2_ngram_jaccard, op3_url_filters, op4_quality_rules, op5_license_scans, op6_token_counts, op7_embedding_dedup, op8_sentencepiece, op9_mixing, op10_secret_scans, op11_topk_search, op12_alignment, op13_lexical_search, pipeline)}


#: Words of a text, with A-Z in lower case for those that compare words.
_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
_SMALL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"


def _quality_sql() -> str:
    stops = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
    rules = {k: (how, limit) for k, _, how, limit in quality.RULES}
    measures = {
        "enough_words": "n_words", "few_repeated_words": "case when n_words > 0 then n_repeat_words / n_words end", "mean_word_length_low": "case when n_words > 0 then word_chars / n_words end",
        "mean_word_length_high": "case when n_words > 0 then word_chars / n_words end", "few_symbols": "case when n_words > 0 then n_symbols / n_words end",
        "some_stop_words": f"case when n_words >= {quality.ENOUGH_FOR_STOP_WORDS} then n_stop / n_words end", "few_repeated_lines": "case when n_lines > 0 then n_dup_lines / n_lines end",
    }
    good = " and ".join(f"coalesce({measures[k]} {how} {limit}, true)" for k, (how, limit) in rules.items())
    return f"""with d as (select doc_id, coalesce(text, '') t, {_WORDS} w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) ls from documents),
        g as (select doc_id, i, array_to_string(w[i:i + 4], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 3)) i from d)),
        twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) n from g) where n > 1),
        rep as (select doc_id, count(distinct i + j) n from twice, range(5) r(j) group by 1),
        m as (select d.doc_id, len(w) n_words, coalesce(length(array_to_string(w, '')), 0) word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) n_symbols, len(ls) n_lines, len(ls) - len(list_distinct(ls)) n_dup_lines,
            coalesce(rep.n, 0) n_repeat_words, len(list_filter(w, lambda x: lower(x) in ({stops}))) n_stop from d left join rep using (doc_id))
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed,
            not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and {good} kept from m"""


def _url_sql() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in url_filter.RULES)
    return f"""with p as (select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages),
        b as (select page_id, arg_max(h || r, length(h || r)) rule, arg_max(v, length(h || r)) verdict from p, (values {rules}) x(h, r, v) where (host = h or ends_with(host, '.' || h)) and starts_with(path, r) group by 1)
        select page_id, host, path, rule, coalesce(verdict, 'allow') verdict from p left join b using (page_id)"""


_JACCARD_SQL = f"""with recursive d as (select doc_id, {_SMALL} w from documents),
    s as (select distinct doc_id, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[i:i + 4], ' ') end g from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) i from d where len(w) > 0)),
    z as (select doc_id, count(*) n from s group by 1), c as (select a.doc_id a, b.doc_id b, count(*) n from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
    l as (select a, b from c join z x on x.doc_id = a join z y on y.doc_id = b where 100 * c.n >= 80 * (x.n + y.n - c.n)),
    r as (select doc_id a, doc_id b from documents union select r.a, l.b from r join l on l.a = r.b)
    select doc_id, coalesce(z.n, 0) n_shingles, min(b) component_id from r join documents on doc_id = a left join z using (doc_id) group by 1, 2"""

_EMBEDDING_SQL = """with recursive v as (select vec_id, embedding::double[] e from embeddings),
    l as (select x.vec_id a, y.vec_id b from v x join v y on x.vec_id <> y.vec_id and list_cosine_similarity(x.e, y.e) >= 0.95),
    r as (select vec_id a, vec_id b from v union select r.a, l.b from r join l on l.a = r.b)
    select a vec_id, (select count(*) from l where l.a = r.a) n_links, min(b) component_id, min(b) = a kept from r group by a"""


def _license_sql() -> str:
    word = lambda w, p: f"'{w[p]}'" if 0 <= p < len(w) else "null"
    grams = ", ".join(f"({i}, '{label}', {base}, '{form}', '{needed}', {edits}, {p}, {word(w, p)}, {word(w, p + 1)}, {word(w, p - 2)}, {word(w, p + 3)})" for i, label, base, form, needed, edits, w in licenses.templates() for p in range(len(w) - 1))
    return f"""with d as (select row_number() over () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from documents),
        t(template, label, base, form, needed, edits, tpos, a, b, e, f) as (values {grams}),
        g as (select r, i - 1 pos, w[i] a, w[i + 1] b, case when i > 2 then w[i - 2] end e, w[i + 3] f from (select r, w, unnest(range(1, len(w))) i from d)),
        h as (select r, template, label, base, form, needed, edits, pos - tpos diagonal, pos, tpos, [0, 1] || case when g.e = t.e then [-2] else [] end || case when g.f = t.f then [3] else [] end os from g join t on g.a = t.a and g.b = t.b),
        l as (select r, template, diagonal, pos + o as spot, substr(form, (tpos + o + 1)::int, 1) c from (select x.r, x.template, x.diagonal, x.form, y.pos, y.tpos, unnest(y.os) o from (select distinct r, template, base, form, diagonal from h) x join h y on y.r = x.r and y.template = x.template and y.diagonal between x.diagonal and x.diagonal + case when x.base then 0 else {licenses.NEAR} end)),
        p as (select r, template, diagonal, min(spot) lo, max(spot) hi from l group by all),
        z as (select r, template, diagonal, lo, string_agg(coalesce(c, '?'), '' order by spot) shown from (select p.r, p.template, p.diagonal, lo, q.spot, min(c) c from (select *, unnest(range(lo, hi + 1)) spot from p) q join p using (r, template, diagonal, lo, hi) left join l on l.r = p.r and l.template = p.template and l.diagonal = p.diagonal and l.spot = q.spot group by all) group by all),
        s as (select distinct z.r, label, base, lo start, 1 - levenshtein(shown, form) / length(form) cover from z join t using (template)
            where levenshtein(shown, form) <= edits and len(list_filter(string_split(needed, ','), lambda c: not contains(shown, c))) = 0),
        j as (select d.r, doc_id, len(w) n_words, label, base, start, cover from d left join s on s.r = d.r)
        select doc_id, n_words, count(*) filter (base) n_base, min(start) filter (base) first_word, max(start) filter (base) last_word,
            coalesce(array_to_string(list_sort(list(distinct label) filter (base)), ','), '') base_labels, coalesce(array_to_string(list_sort(list(distinct label) filter (label is not null)), ','), '') as labels,
            coalesce(max(cover), 0.0)::double score from j group by r, doc_id, n_words"""


def _secret_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    run = f"[{secrets.RUN}]{{{secrets.LEAST},}}"
    patterns = [(secrets.ASSIGN, 1), (secrets.ACCESS, 0), (secrets.HEX, 0), (run, 0)]
    found = " union all ".join(f"select r, {i} ord, '{secrets.KINDS[i]}' kind, regexp_extract_all(t, {quoted(p)}) hits, regexp_extract_all(t, {quoted(p)}, {group}) vals, string_split_regex(t, {quoted(p)}) gaps from d" for i, (p, group) in enumerate(patterns))
    weights = ", ".join(str(secrets.weight(i)) for i in range(1, secrets.WINDOW + 1))
    limits = " ".join(f"when regexp_matches(v, {quoted(form)}) then {secrets.most_weight(bits)}" for _, form, bits in secrets.CLASSES)
    return f"""with d as (select row_number() over () r, doc_id, coalesce(text, '') t from documents), f as ({found}),
        p as (select r, ord, kind, vals[i] v, (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0))::bigint b, b + length(hits[i]) e from (select *, unnest(range(1, len(hits) + 1)) i from f)),
        s as (select * from p where ord in (1, 2) or ord = 0 and length(v) >= {secrets.MIN_VALUE}),
        c as (select * from p where ord = 3 and regexp_matches(v, '[0-9]') and not regexp_matches(v, {quoted(secrets.ALLOWED)}) and (regexp_matches(v, {quoted(secrets.ONE_CASE)}) or length(regexp_replace(v, {quoted(secrets.WORDS)}, '', 'g')) > 1) and not exists (select 1 from s where s.r = p.r and s.b < p.e and p.b < s.e)),
        k as (select r, b, i, x, count(*) n from (select r, b, i, unnest(string_split(substr(v, i, {secrets.WINDOW}), '')) x from (select r, b, v, unnest(range(1, length(v) - {secrets.WINDOW} + 2)) i from c)) group by all),
        h as (select r, b, min(total) least from (select r, b, i, sum([{weights}][n]) total from k group by all) group by all),
        o as (select * from s union all select c.* from c join h using (r, b) where least <= case {limits} end)
        select doc_id, count(*) filter (ord = 0) n_assign, count(*) filter (ord = 1) n_access, count(*) filter (ord = 2) n_hex,
            sha256(coalesce(string_agg(kind || ':' || b || ':' || e, ',' order by b, ord) filter (ord < 3), '')) base_sha256, coalesce(string_agg(kind || ':' || b || ':' || e, ',' order by b, ord), '') spans
        from d left join o using (r) group by r, doc_id"""


_TOPK_SQL = """with e as (select row_number() over () r, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) v from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
    s as (select q.r, q.vec_id query_id, c.vec_id, c.r other, list_inner_product(q.v, c.v)::bigint score from e q join e c on q.r <> c.r and len(q.v) = len(c.v) where q.vec_id % 50 = 0)
    select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by r order by score desc, vec_id nulls last, other) as rank from s) where rank <= 5"""


def _search_sql() -> str:
    found = lambda text: f"regexp_extract_all(translate(coalesce({text}, ''), '{lexical_search.UPPER}', '{lexical_search.LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""with d as (select row_number() over () r, doc_id, {found('text')} w from documents),
        i as (select distinct item_id, t from (select item_id, unnest({found('text')}) t from benchmark)),
        tf as (select r, t, count(*) tf from (select r, unnest(w) t from d) where t in (select t from i) group by 1, 2),
        c as (select count(*) filter (len(w) > 0) docs, sum(len(w))::bigint total from d),
        h as (select t, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)))::bigint weight from tf, c group by t, docs),
        m as (select r, doc_id, 100 - 90 + (90 * len(w) * docs) // total m from d, c where len(w) > 0),
        s as (select item_id, r, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint score from i join tf using (t) join h using (t) join m using (r) group by all)
        select item_id, rank::int as rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id nulls last) as rank from s where score > 0) where rank <= 10"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_ngram_jaccard": _JACCARD_SQL, "op3_url_filters": _url_sql(), "op4_quality_rules": _quality_sql(), "op5_license_scans": _license_sql(), "op7_embedding_dedup": _EMBEDDING_SQL, "op10_secret_scans": _secret_sql(),
        "op11_topk_search": _TOPK_SQL, "op13_lexical_search": _search_sql(),
    }
