"""The same results in SQL over the same tables."""

from __future__ import annotations


def text(x: str | None) -> str:
    return "null" if x is None else "'" + x.replace("'", "''") + "'"


def domain(u: str) -> str:
    full = f"(case when regexp_matches({u}, '^https?://') then {u} else 'http://' || {u} end)"
    place = f"regexp_replace(regexp_extract({full}, '^https?://([^/?#]*)', 1), '^.*@', '')"
    host = f"lower(case when contains({place}, '[') then regexp_extract({place}, '\\[([^\\]]*)', 1) else regexp_extract({place}, '^[^:]*') end)"
    return f"regexp_replace(coalesce(nullif({host}, ''), regexp_extract({full}, '^https?')), '^www\\.', '')"


def in_country(u: str, cc: str) -> str:
    return f"(contains(lower({u}), '.' || lower({cc})) or contains(lower({u}), '.com'))"


def visible(h: str) -> str:
    for p in ("(?is)<script[^>]*>.*?</script>", "(?is)<style[^>]*>.*?</style>", "(?s)<!--.*?-->", "(?s)<[^>]*>"):
        h = f"regexp_replace({h}, '{p}', ' ', 'g')"
    return h


def tokens(t: str) -> str:
    return f"regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}]+')"


def oracles(hosts, excluded, seeds, prompts, replies, stages, own) -> dict[str, str]:
    country, current, previous, probability = map(text, stages)
    split = lambda d: d if isinstance(d, list) else [x.strip() for x in d.split(",")]
    flat = [(i, j, n, x) for i, (n, d) in enumerate(hosts) for j, x in enumerate(split(d))]
    host_rows = "(values " + ", ".join(f"({i}, {text(n)}, {text(x)})" for i, _, n, x in flat) + ") h(ord, name, d)"
    markets = f"(select lower(d) dom, arg_min(name, ord) market from {host_rows} group by 1)"
    gone = ", ".join(text(x) for _, d in excluded for x in split(d))
    seed_rows = "(values " + ", ".join(f"({i}, {text(s)})" for i, s in enumerate(seeds)) + ")"
    page_words = f"w as (select page_id, url, {domain('url')} d, unnest({tokens(visible('html'))}) token from pages)"

    def searched(limit: int, sites: bool) -> str:
        where = "where s.i <> 2 or d = 'example.com' or d like '%.example.com' or d = 'example.net' or d like '%.example.net'" if sites else ""
        return f"""{page_words}, f as (select s.i search_id, page_id, url, count(*) score from w join {seed_rows} s(i, seed) on w.token = s.seed {where} group by all),
            hits as (select * from (select *, row_number() over (partition by search_id order by score desc, page_id) - 1 as position from f) where position < {limit})"""

    prods = f"""{searched(200, False)}, prods as (select search_id, search_id search_ord, position, url, {domain("url")} dom, not {in_country("url", "'org'")} bad from hits)"""
    seen = "(select distinct url from pages where page_id % 5 = 0)"

    def flags(rows: str, use_seen: bool, run: str = "") -> str:
        known = f"url in (select url from {seen})" if use_seen else "false"
        return f"""a as (select *, case when bad then {country} when {known} then {previous} end st0 from {rows}),
            b as (select *, case when st0 is not null then st0 when row_number() over (partition by {run}url, st0 order by search_ord, position) > 1 then {current} end st1 from a)"""

    docs_words = f"dw as (select doc_id, {tokens('text')} words from documents), hold as (select doc_id, words, i, seed from dw join {seed_rows} s(i, seed) on list_contains(words, seed))"
    grams = f"""{docs_words}, g as (select distinct doc_id, seed, array_to_string(words[st:st + m], ' ') as text from (select doc_id, seed, words, m, unnest(range(1, len(words) - m + 1)) st from (select *, unnest([0, 1, 2]) m from hold))
        where list_contains(words[st:st + m], seed)),
        sug as (select * from (select seed, text, count(*) volume, row_number() over (partition by seed order by count(*) desc, text) - 1 as ord from g group by seed, text) where ord < 50),
        rel as (select * from (select seed, token as text, count(*) volume, row_number() over (partition by seed order by count(*) desc, token) - 1 as ord from (select distinct doc_id, seed, unnest(words) token from hold) where length(token) >= 4 group by seed, token) where ord < 50),
        ranked as (select seed, text, volume, row_number() over (partition by seed order by volume desc, o) as rank from (select seed, text, max(volume) volume, min({{'s': s, 'ord': ord}}) o from (select 0 s, * from sug union all select 1 s, * from rel) where text <> seed group by 1, 2))"""

    first = lambda p: f"nullif(regexp_extract(html, '{p}', 1), '')"
    plain = lambda x: f"nullif(trim(regexp_replace({visible(x)}, '[\\x20\\x09-\\x0D]+', ' ', 'g')), '')"
    h1, title, par = plain(first("(?is)<h1[^>]*>(.*?)</h1>")), plain(first("(?is)<title[^>]*>(.*?)</title>")), plain(first("(?is)<p(?:[ ][^>]*)?>(.*?)</p>"))
    meta = first("""(?is)<meta[^>]*name=["''']description["'''][^>]*content=["''']([^"''']*)["''']""".replace("'''", "''"))
    q = """["'']"""
    images = f"""list_concat(regexp_extract_all(html, '(?is)<meta[^>]*property={q}og:image{q}[^>]*content={q}([^"'']+){q}', 1), regexp_extract_all(html, '(?is)<img[^>]*src={q}([^"'']+){q}', 1))"""
    price = f"nullif(regexp_extract({visible('html')}, '([$€£] ?[0-9]+(?:[.,][0-9]{{2}})?|[0-9]+(?:[.,][0-9]{{2}})? ?(?:€|EUR|USD|CHF))', 1), '')"
    html = f"""html as (select *, round(((product_name is not null)::int + (product_description is not null)::int + (product_price is not null)::int + (len(imgs) > 0)::int + buy::int) * 0.2::double, 1) probability
        from (select page_id, url, coalesce({h1}, {title}) product_name, {price} product_price, coalesce({meta}, {par}) product_description, {images} imgs, regexp_matches({visible("html")}, '(?i)\\b(buy|cart|shop)\\b') buy from pages))"""
    html_row = "page_id, product_name, product_price, product_description, array_to_string(imgs, ',') product_images, probability"

    search_args = "'google.ch' google_domain, 'Switzerland' location_used, 'ctr:CH&cr:countryCH' tbs, 'ch' gl, 'de' hl, 20 num"
    all_sites = " OR site:".join(x for _, _, _, x in flat)
    prompt_rows = "(values " + ", ".join(f"({text(p.name)}, {text(p.context)}, {text(p.system_prompt)}, [{', '.join(map(str, p.allowed_classes))}])" for p in prompts) + ") p(prompt, context, system, allowed)"
    reply_list = "[" + ", ".join("chr(32) || '1' || chr(10)" if "\n" in r else text(r) for r in replies) + "]"
    relevance = lambda name, desc: f"case when {name} is null or {desc} is null then -1 else contains({name}, 'th')::int end"
    length = lambda name, desc: f"case when {name} is null or {desc} is null or length({name}) % 4 = 3 then -1 else length({name}) % 4 end"
    runs = "(select 'term' || o_custkey || '_de_ch_' || strftime(max(o_orderdate), '%Y%m%d%H%M%S') run_id, max(o_orderdate) ts from orders group by o_custkey)"
    parts = "(select *, p_partkey % 13 <> 0 ok, p_partkey % 11 <> 0 pr, 'https://parts.example.com/' || p_partkey u from part)"
    part_prob = "case when ok and pr then p_size / 50.0::double end"
    details = "dt as (select url, case when page_id % 4 <> 3 then product_name end product_name, case when page_id % 4 <> 3 then product_description end product_description, case when page_id % 4 <> 3 then (page_id % 20) / 20.0::double end probability from html)"
    full = f"""{prods}, kept as (select * from prods where dom not in ({gone})), {flags("kept", True)}, {html}, {details},
        res as (select b.*, dt.product_name, dt.product_description, dt.probability, case when st1 is not null then st1 when dt.probability <= 0.1 then {probability} end stage from b left join dt using (url))"""

    # By seed and language: terms, searches, and all that follows.
    enriched = f"""dw as (select doc_id, lang, {tokens('text')} words from documents), hold as (select doc_id, lang, words, seed from dw join {seed_rows} s(i, seed) on list_contains(words, seed)),
        g as (select distinct doc_id, seed, lang, array_to_string(words[st:st + m], ' ') as text from (select *, unnest(range(1, len(words) - m + 1)) st from (select *, unnest([0, 1, 2]) m from hold)) where list_contains(words[st:st + m], seed)),
        t as (select 0 s, seed, lang, text, doc_id from g union all select distinct 1, seed, lang, token, doc_id from (select seed, lang, doc_id, unnest(words) token from hold) where length(token) >= 4),
        lim as (select * from (select s, seed, lang, text, count(*) volume, row_number() over (partition by s, seed, lang order by count(*) desc, text) as ord from t group by 1, 2, 3, 4) where ord <= 5),
        best as (select seed, lang, text, row_number() over (partition by seed, lang order by max(volume) desc, min({{'s': s, 'ord': ord}})) as rank from lim where text <> seed group by 1, 2, 3),
        runs as (select seed || '_' || lang run_id, seed, lang from {seed_rows} s(i, seed), (select distinct lang from documents)),
        req as (select run_id, 0 search_ord, seed term, 'initial' kind, (select count(*) from pages) num from runs union all select run_id, rank, text, 'enriched', 10 from runs join best using (seed, lang) where rank <= 5),
        want as (select *, run_id || '/' || search_ord search_id, list_distinct({tokens('term')}) ws from req), {page_words},
        f as (select search_id, num, page_id, url, count(*) score from w join (select search_id, num, len(ws) n_want, unnest(ws) token from want) using (token) group by search_id, num, n_want, page_id, url having count(distinct token) = n_want),
        hits as (select * from (select *, row_number() over (partition by search_id order by score desc, page_id) - 1 as position from f) where position < num),
        prods as (select run_id, search_id, search_ord, term, kind, position, url, {domain("url")} dom, not {in_country("url", "'org'")} bad from hits join want using (search_id))"""
    rest = f"""{html}, {details}, res as (select b.*, dt.product_name, dt.product_description, dt.probability, case when st1 is not null then st1 when dt.probability <= 0.1 then {probability} end stage from b left join dt using (url))"""
    # By run: what each of them has for itself.
    rows = lambda xs: "(values " + ", ".join("(" + ", ".join(map(str, x)) + ")" for x in xs) + ")"
    own_runs = rows((text(r), text(t), text({"English": "en", "German": "de", "French": "fr"}[lang]), text((code or own[3][int(place.rpartition('_')[2]) % len(own[3])]).lower()), "[" + ", ".join(text(x) for o, _, _, ds in own[1] if o == r for x in ds) + "]") for r, t, lang, place, _, code in own[0])
    own_hosts = rows((text(r), i, text(n), text(x)) for r, i, n, ds in own[1] for x in ds)
    own_gone = rows((text(r), text(x)) for r, _, _, ds in own[2] for x in ds)
    settings = f"""{enriched.split("runs as (")[0]} runs as (select * from {own_runs} r(run_id, seed, lang, cc, sites)),
        req as (select run_id, cc, sites, 0 search_ord, seed term, 'initial' kind, (select count(*) from pages) num from runs union all select run_id, cc, sites, rank, text, 'enriched', 10 from runs join best using (seed, lang) where rank <= 5),
        want as (select *, run_id || '/' || search_ord search_id, list_distinct({tokens('term')}) ws from req), {page_words},
        f as (select search_id, num, page_id, url, count(*) score from w join (select search_id, sites, num, len(ws) n_want, unnest(ws) token from want) using (token)
            where len(sites) = 0 or len(list_filter(sites, lambda x: d = x or ends_with(d, '.' || x))) > 0 group by search_id, num, n_want, page_id, url having count(distinct token) = n_want),
        hits as (select * from (select *, row_number() over (partition by search_id order by score desc, page_id) - 1 as position from f) where position < num),
        prods as (select run_id, search_id, search_ord, term, kind, position, url, {domain("url")} dom, not {in_country("url", "cc")} bad from hits join want using (search_id)),
        kept as (select * from prods where (run_id, dom) not in (select (r, x) from {own_gone} g(r, x)))"""
    failed = "case when open and contains(product_name, 'ee') then 'ValueError: name with ee' when open and length(product_name) % 7 = 0 then '0 replies for 1 rows' end"
    labels = f"case when stage is null then {relevance('product_name', 'product_description')} end relevance, case when stage is null then {length('product_name', 'product_description')} end length"

    return {
        "url_domain": f"select page_id, {domain('url')} as domain from pages",
        "country_flag": f"select page_id, cc, not {in_country('url', 'cc')} filtered, case when not {in_country('url', 'cc')} then {country} end filtered_at_stage from pages, (values ('org'), ('ht')) c(cc)",
        "marketplace_lookup": f"select page_id, domain, coalesce(market, 'Google') marketplace_name from (select page_id, {domain('url')} as domain from pages) left join {markets} on domain = dom",
        "exclude_hosts": f"select * from (select page_id, {domain('url')} as domain from pages) where domain not in ('ththre.example.com', 'm.ththth.example.com', 'example.org')",
        "language_lookup": "select doc_id, name, code from documents left join (values ('en', 'English', 'en'), ('de', 'German', 'de'), ('fr', 'French', 'fr'), ('es', 'Spanish', 'es')) l(lang, name, code) using (lang)",
        "location_lookup": "select n_name as name, case when n_nationkey % 5 = 0 then lower(substring(n_name, 1, 3)) else lower(substring(n_name, 1, 2)) end code from nation",
        "search_string": f"select distinct 'term ' || lang search_term, 'term ' || lang || ' site:{all_sites}' q, {search_args} from documents",
        "search_json": "select search_id, position, url from (select cast(page_id // 10 as int) search_id, cast(row_number() over (partition by page_id // 10 order by page_id) - 1 as int) as position, page_id, url from pages) where position < 8 and page_id % 7 <> 0",
        "quarantined_hits": "select 'no link' reason, count(*) n from pages where page_id % 7 = 0",
        "search_pages": f"with {searched(200, True)} select search_id, page_id, score, position from hits",
        "quarantined_replies": """with k as (select distinct 'search' kind, page_id // 10 id from pages union all select kind, doc_id from documents, (values ('suggested'), ('related')) x(kind) union all select 'details', p_partkey from part)
            select kind, case id % 11 when 1 then 'no reply' when 4 then 'other shape' else 'no JSON' end reason, count(*) n, count(*) filter (id % 11 <> 1) kept from k where id % 11 < 5 group by 1, 2""",
        "indexed_search": f"with {searched(200, True)} select search_id, page_id, score, position from hits",
        "ranked_hits": f"with {searched(2**31 - 1, False)} select search_id, page_id, score, position from hits",
        "hit_counts": f"with {searched(200, True)} select search_id, count(*) n_hits from hits group by 1",
        "keyword_requests": f"select seed, lang language_name, 'Switzerland' location_name, 10 \"limit\", source, case when source = 'suggested' then true end include_serp_info, case when source = 'suggested' then true end include_seed_keyword from {seed_rows} s(i, seed), (select distinct lang from documents), (values ('suggested'), ('related')) c(source)",
        "suggest_terms": f"with {grams} select * from sug",
        "related_terms": f"with {grams} select * from rel",
        "keyword_json": "select c.source, doc_id, 'kw ' || doc_id as text, n_chars volume from documents, (values ('suggested'), ('related')) c(source) where doc_id % 3 <> 2 and doc_id % 5 <> 0",
        "rank_terms": f"with {grams} select * from ranked where rank <= 20",
        "search_requests": f"with {grams} select search_term, search_term_type, num, search_term q, 'ctr:CH&cr:countryCH' tbs from (select seed search_term, 'initial' search_term_type, 50 num from {seed_rows} s(i, seed) union all select text, 'enriched', 10 from ranked where rank <= 5)",
        "dedupe_current_run": f"with {prods}, {flags('prods', False)} select search_id, position, url, st1 is not null filtered, st1 filtered_at_stage from b",
        "dedupe_previous_run": f"with {prods}, {flags('prods', True)} select search_id, position, url, st1 is not null filtered, st1 filtered_at_stage from b",
        "dedupe_with_store": f"with {prods}, {flags('prods', True)} select search_id, position, url, st1 is not null filtered, st1 filtered_at_stage from b",
        "seen_urls_update": f"with {prods}, {flags('prods', True)} select distinct url from b where st1 is null",
        "product_json": f"select u url, case when ok then p_name end product_name, case when ok then p_partkey::varchar end product_price, case when ok then p_type end product_description, case when ok then 'm' || p_partkey || ',' || p_brand else '' end product_images, {part_prob} probability from {parts}",
        "probability_flag": f"select u url, {part_prob} probability, coalesce({part_prob} <= 0.1, false) filtered, case when {part_prob} <= 0.1 then {probability} end filtered_at_stage from {parts}",
        "details_join": f"with {html}, {details} select page_id, product_name, probability from pages left join dt using (url)",
        "product_html": f"with {html} select {html_row} from html",
        "prompt_check": f"select n_nationkey, prompt as name, array_to_string(allowed, ',') allowed from nation, {prompt_rows} where list_contains(allowed, n_nationkey % 4)",
        "render_prompt": f"select doc_id, prompt, system system_message, 'Context: ' || context || chr(10) || chr(10) || 'Product Details: document ' || doc_id || chr(10) || text || '\\n' || chr(10) || 'Relevance:' user_message, 2::bigint n_messages from documents, {prompt_rows}",
        "label_guard": f"select p_partkey, case when p_partkey % 10 <> 9 and trim(r, ' ' || chr(10)) in ('0', '1', '+0', '+1') then trim(r, ' ' || chr(10))::int else -1 end as label from (select *, ({reply_list})[p_partkey % {len(replies)} + 1] r from part)",
        "classify_pages": f"with {html} select page_id, page_id % 6 = 0 filtered, case when page_id % 6 = 0 then 0 else 2 end::bigint n_labels, case when page_id % 6 <> 0 then {relevance('product_name', 'product_description')} end relevance from html",
        "classify_with_failures": f"""with {html}, o as (select *, page_id % 6 <> 0 and product_name is not null and product_description is not null open from html)
            select page_id, case when page_id % 6 <> 0 then case when {failed} is null then {relevance('product_name', 'product_description')} else -1 end end relevance,
            case when page_id % 6 <> 0 then case when {failed} is null then {length('product_name', 'product_description')} else -1 end end length, {failed} relevance_error, {failed} length_error from o""",
        "runs_with_own_hosts": f"""with {settings}, {flags("kept", True, "run_id, ")}, {rest},
            m as (select r mrun, lower(x) mdom, arg_min(n, i) market from {own_hosts} h(r, i, n, x) group by 1, 2)
            select run_id, search_id, term search_term, kind search_term_type, position, url, dom as domain, coalesce(market, 'Google') marketplace_name, product_name, probability, stage is not null filtered, stage filtered_at_stage,
            case when stage is null and run_id <> 'ht' then {relevance('product_name', 'product_description')} end relevance,
            case when stage is not null or run_id = 'net' then null when product_name is null or product_description is null or run_id = 'org' and length(product_name) % 4 = 3 then -1 else length(product_name) % 4 end length
            from res left join m on run_id = mrun and dom = mdom""",
        "classification_wide": f"with {html} select page_id, product_name, case when page_id % 6 <> 0 then {relevance('product_name', 'product_description')} end relevance, case when page_id % 6 <> 0 then {length('product_name', 'product_description')} end length from html",
        "csv_round_trip": f"with {html} select {html_row} from html",
        "run_list": f"select run_id, cast(row_number() over (order by ts, run_id) - 1 - count(*) over () as int) as index from {runs}",
        "load_run": "select o_orderpriority run_id, o_orderkey from orders where o_orderpriority = (select o_orderpriority from orders group by 1 order by min(o_orderdate) desc, 1 desc limit 1 offset 1)",
        "write_and_load_run": "select o_orderpriority run_id, o_orderkey from orders where o_orderpriority = (select o_orderpriority from orders group by 1 order by min(o_orderdate) desc, 1 desc limit 1 offset 1)",
        "run_registry": "select o_orderpriority run_id, cast(row_number() over (order by min(o_orderdate), o_orderpriority) - 1 - count(*) over () as int) as index from orders group by 1",
        "language_scan": "select distinct upper(lang) as name, lang code from documents",
        "location_scan": "select n_name as name, lower(substring(n_name, 1, 2)) code from nation",
        "stream_known": f"select page_id, st is not null filtered, st filtered_at_stage from (select page_id, case when page_id % 7 = 0 then {country} when url in (select url from {seen}) then {previous} end st from pages)",
        "enriched_run": f"""with {enriched}, kept as (select * from prods where dom not in ({gone})), {flags("kept", True, "run_id, ")}, {rest}
            select run_id, search_id, term search_term, kind search_term_type, position, url, dom as domain, coalesce(market, 'Google') marketplace_name, product_name, probability, stage is not null filtered, stage filtered_at_stage, {labels}
            from res left join {markets} m(mdom, market) on dom = mdom""",
        "stream_pipeline": f"""with kept as (select * from (select *, {domain("url")} dom, not {in_country("url", "'org'")} bad from (select url, page_id as position, unnest(range(0, page_id % 3 + 1))::int search_ord from pages)) where dom not in ({gone})), {flags("kept", True)}, {rest}
            select search_ord search_id, position, url, dom as domain, coalesce(market, 'Google') marketplace_name, product_name, stage is not null filtered, stage filtered_at_stage, {labels} from res left join {markets} m(mdom, market) on dom = mdom""",
        "run_metrics": f"with {full} select coalesce(stage, 'kept') stage, count(*) n from res group by 1",
        "stage_funnel": f"with {full} select coalesce(stage, 'kept') stage, count(*) n from res group by 1",
        "pipeline_end_to_end": f"""with {full} select search_id, position, seed search_term, url, dom as domain, coalesce(market, 'Google') marketplace_name, product_name, probability, stage is not null filtered, stage filtered_at_stage,
            case when stage is null then {relevance("product_name", "product_description")} end relevance, case when stage is null then {length("product_name", "product_description")} end length
            from res join {seed_rows} s(i, seed) on s.i = search_id left join {markets} m(mdom, market) on res.dom = m.mdom""",
        "stream_dedupe": f"select url, filtered, case when filtered then {current} end filtered_at_stage, case when filtered then sum(n) - 1 else 1 end::bigint n from (select url, sum(page_id % 3 + 1) n from pages group by 1), (values (true), (false)) f(filtered) group by url, filtered having filtered = false or sum(n) > 1",
    }
