"""Named queries over the driver tables, each with the DuckDB SQL it is held against.

A query without SQL draws at random (by hash), trains a model or approximates; tests hold those against
brute force. Floats are rounded to six digits on both sides, as sums run in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.config import EngineConfig
from lodestone.functions import entities, fixed, language
from lodestone.functions import text as T
from lodestone.functions import vectors as V
from lodestone.functions.joins import against_all
from lodestone.operators import bm25, candidates, evaluate, features, guardrails, model, retrieval, sampling, synth
from lodestone.sources import interactions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


# ---- pieces of SQL ------------------------------------------------------------------------------------------


def tok(x: str, low: bool = True) -> str:
    return f"list_filter(regexp_split_to_array({f'lower({x})' if low else x}, '\\s+'), lambda w: w <> '')"


def text_literal(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def sql_map(entries: dict[str, str]) -> str:
    return f"MAP {{{', '.join(f'{text_literal(k)}: {text_literal(v)}' for k, v in entries.items())}}}"


def any_in(x: str, words) -> str:
    return "(" + " or ".join(f"contains({x}, {text_literal(w)})" for w in words) + ")"


def norm_query(x: str) -> str:
    return f"array_to_string({tok(x)}, ' ')"


def norm_entity(x: str, kind: str) -> str:
    canon = {form: c for c, forms in entities.FORMS[kind].items() for form in forms}
    return f"coalesce({sql_map(canon)}[lower(trim(coalesce({x}, '')))], lower(trim(coalesce({x}, ''))))"


def translated(x: str) -> str:
    return f"array_to_string(list_transform({tok(x, False)}, lambda w: coalesce({sql_map(fixed.TRANSLATIONS)}[w], w)), ' ')"


def bm25_sql(corpus: str, queries_: str, lead: str = "") -> str:
    """CTEs up to sc(qid, doc_idx, score); corpus: doc_idx, text; queries_: qid, query."""
    return f"""with {lead} corpus as ({corpus}), qs as ({queries_}),
d as (select doc_idx, {tok('text')} as words from corpus),
n as (select doc_idx, words, len(words) as dl from d),
post as (select doc_idx, dl, term, count(*) as tf from (select doc_idx, dl, unnest(words) as term from n) group by all),
df as (select term, count(*) as df from post group by term),
st as (select count(*) as n_docs, avg(dl) as avgdl from n),
raw as (select term, ln(n_docs - df + 0.5) - ln(df + 0.5) as idf from df, st),
av as (select avg(idf) as avg_idf, count(*) as n_terms from raw),
wt as (select term, case when idf < 0 then 0.25 * avg_idf else idf end as idf from raw, av),
qt as (select qid, term, count(*) as qtf from (select qid, unnest({tok('query')}) as term from qs) group by all),
sc as (select qid, doc_idx, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as score from post join wt using (term) join qt using (term), st group by all)"""


# ---- retrieval ----------------------------------------------------------------------------------------------


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select(F.col("doc_id").alias("doc_idx"), "text")


def _benchmark(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


DOCS, BENCH = "select doc_id as doc_idx, text from documents", "select item_id as qid, text as query from benchmark"


@query(bm25_sql(DOCS, BENCH) + """, allp as (select qs.qid, n.doc_idx, round(coalesce(sc.score, 0), 6) as score from qs cross join n left join sc on sc.qid = qs.qid and sc.doc_idx = n.doc_idx)
select qid, doc_idx, score, rank from (select *, row_number() over (partition by qid order by score desc, doc_idx) as rank from allp) where rank <= 10""")
def bm25_topk(spark, sf):
    return bm25.topk(_documents(spark, sf), _benchmark(spark, sf), 10, digits=6).select("qid", "doc_idx", "score", "rank")


@query(bm25_sql(DOCS, BENCH) + " select sc.qid, sc.doc_idx, round(score, 6) as score from sc join qs on qs.qid = sc.qid join corpus on corpus.doc_idx = sc.doc_idx where contains(corpus.text, qs.query)")
def bm25_candidate_scores(spark, sf):
    docs, asked = _documents(spark, sf), _benchmark(spark, sf)
    pairs = against_all(docs, asked, "qid").where(F.contains("text", "query")).select("qid", "doc_idx")
    return bm25.scores(docs, asked, candidates=pairs).select("qid", "doc_idx", F.round("score", 6).alias("score"))


@query(bm25_sql(DOCS, BENCH) + " select n_docs, round(avgdl, 6) as avgdl, n_terms, round(avg_idf, 6) as avg_idf from st, av")
def corpus_stats(spark, sf):
    return bm25.corpus_stats(bm25.doc_tokens(_documents(spark, sf))).select("n_docs", F.round("avgdl", 6).alias("avgdl"), "n_terms", F.round("avg_idf", 6).alias("avg_idf"))


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = read(spark, sf, "embeddings")
    return rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q")), rows.select(F.col("vec_id").alias("doc_idx"), F.col("embedding").alias("v"))


@query("""select qid, doc_idx, sim, rank from (select *, row_number() over (partition by qid order by sim desc, doc_idx) as rank from (
select a.vec_id as qid, b.vec_id as doc_idx, round(list_dot_product(a.embedding::double[], b.embedding::double[]), 6) as sim from embeddings a, embeddings b where a.vec_id % 50 = 0 and a.vec_id <> b.vec_id)) where rank <= 10""")
def semantic_topk(spark, sf):
    return retrieval.semantic_topk(*_vectors(spark, sf), 10)


@query("""select a.vec_id as qid, b.vec_id as doc_idx, round(least(greatest(1 - list_sum(list_transform(list_zip(a.embedding::double[], b.embedding::double[]), lambda p: (p[1] - p[2]) ** 2)) / 2, 0), 1), 6) as sim
from embeddings a, embeddings b where a.vec_id % 50 = 0""")
def semantic_sim_clip(spark, sf):
    q, v = _vectors(spark, sf)
    return against_all(v, q, "qid").select("qid", "doc_idx", F.round(V.similarity_of_distance(V.squared_distance(F.col("q"), F.col("v"))), 6).alias("sim"))  # a stated query set against all rows


@query()
def lsh_topk(spark, sf):
    return retrieval.lsh_topk(*_vectors(spark, sf), 10)


PARTS = "select p_partkey as doc_idx, p_name || ' ' || p_brand || ' ' || p_type as text from part"
NAMES = "select distinct p_name as qid, p_name as query from part"


def _parts(spark, sf):
    return read(spark, sf, "part").select(F.col("p_partkey").alias("doc_idx"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text"))


def _names(spark, sf):
    return read(spark, sf, "part").select(F.col("p_name").alias("qid"), F.col("p_name").alias("query")).distinct()


@query(bm25_sql(PARTS, NAMES) + f""", br as (select * from (select qs.qid, n.doc_idx, row_number() over (partition by qs.qid order by round(coalesce(score, 0), 6) desc, n.doc_idx) as rank from qs cross join n left join sc on sc.qid = qs.qid and sc.doc_idx = n.doc_idx) where rank <= 20),
cd as (select doc_idx, b, count(*)::double as c from (select doc_idx, (('0x' || substr(md5(w), 1, 4))::bigint % 64) as b from (select doc_idx, unnest(words) as w from n)) group by all),
cq as (select qid, b, count(*)::double as c from (select qid, (('0x' || substr(md5(w), 1, 4))::bigint % 64) as b from (select qid, unnest({tok('query')}) as w from qs)) group by all),
nd as (select doc_idx, sqrt(sum(c * c)) as l from cd group by all), nq as (select qid, sqrt(sum(c * c)) as l from cq group by all),
dots as (select qid, doc_idx, sum(cq.c * cd.c) as s from cq join cd using (b) group by all),
sims as (select nq.qid, nd.doc_idx, round(coalesce(s, 0) / (nq.l * nd.l), 6) as sim from nq cross join nd left join dots on dots.qid = nq.qid and dots.doc_idx = nd.doc_idx),
sr as (select * from (select qid, doc_idx, row_number() over (partition by qid order by sim desc, doc_idx) as rank from sims) where rank <= 20),
f as (select qid, doc_idx, round(sum(s), 9) as score from (select qid, doc_idx, 0.5 / (60 + rank) as s from br union all select qid, doc_idx, 0.5 / (60 + rank) from sr) group by all)
select qid, doc_idx, score, rank from (select *, row_number() over (partition by qid order by score desc, doc_idx) as rank from f) where rank <= 10""")
def hybrid_rrf_topk(spark, sf):
    docs, asked = _parts(spark, sf), _names(spark, sf)
    lexical = bm25.topk(docs, asked, 20, digits=6)
    meaning = retrieval.semantic_topk(asked.select("qid", V.hashed_embedding(T.tokens(F.col("query"))).alias("q")), docs.select("doc_idx", V.hashed_embedding(T.tokens(F.col("text"))).alias("v")), 20, exclude_self=False)
    return retrieval.rrf([(meaning, 0.5), (lexical, 0.5)], 10)


# ---- text ---------------------------------------------------------------------------------------------------


def grams_sql(rows: str, keep: str) -> str:
    """keep and gram of rows (keep, text)."""
    return f"(select {keep}, unnest(list_transform(range(1, length(w) + 1), lambda i: substring(' ' || w || ' ', i, 3))) as gram from (select {keep}, unnest({tok('text')}) as w from {rows}))"


@query(f"""with g as {grams_sql('(select * from documents where lang is not null)', 'lang')}, c as (select lang, gram, count(*) as n from g group by all),
base as (select lang, sum(n) as total, (select count(distinct gram) from c) as v from c group by lang),
m as (select lang, gram, ln((n + 1) / (total + v + 1)) as logp from c join base using (lang)), z as (select lang, ln(1 / (total + v + 1)) as none from base),
a as (select key, gram, count(*) as c from {grams_sql('(select item_id as key, text from benchmark)', 'key')} group by all),
s as (select a.key, z.lang, round(sum(a.c * coalesce(m.logp, z.none)), 6) as score from a cross join z left join m on m.gram = a.gram and m.lang = z.lang group by all),
b as (select key, lang from (select *, row_number() over (partition by key order by score desc, lang) as n from s) where n = 1)
select item_id as key, coalesce(lang, 'en') as lang from benchmark left join b on key = item_id""")
def language_id(spark, sf):
    asked = read(spark, sf, "benchmark")
    return language.classify(asked, language.fit(read(spark, sf, "documents")), "item_id")


@query(f"""select a.item_id as a, b.item_id as b, round(coalesce(len(list_intersect({tok('a.text')}, {tok('b.text')})) / nullif(len(list_distinct({tok('a.text')} || {tok('b.text')})), 0), 0), 6) as jaccard
from benchmark a, benchmark b where a.item_id % 50 = 0""")
def jaccard_pairs(spark, sf):
    rows = read(spark, sf, "benchmark").select(F.col("item_id").alias("b"), T.tokens(F.col("text")).alias("y"))
    asked = rows.where("b % 50 = 0").select(F.col("b").alias("a"), F.col("y").alias("x"))
    return against_all(rows, asked, "a").select("a", "b", F.round(T.jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"))


@query("select t.p_type as query, count(*) as n, count_if(contains(lower(p.p_name || ' ' || p.p_type), lower(t.p_type))) as n_match from (select distinct p_type from part) t, part p group by all")
def exact_title_match(spark, sf):
    part = read(spark, sf, "part")
    kinds = part.select(F.col("p_type").alias("query")).distinct()
    title = F.lower(F.concat_ws(" ", "p_name", "p_type"))
    return against_all(part, kinds, "query").groupBy("query").agg(F.count("*").alias("n"), F.count_if(F.contains(title, entities.normalize_query(F.col("query")))).alias("n_match"))


@query(f"select item_id, len({tok('text')}) as n_tokens, len(list_distinct({tok('text')})) as query_len from benchmark")
def query_token_stats(spark, sf):
    words = T.tokens(F.col("text"))
    return read(spark, sf, "benchmark").select("item_id", F.size(words).alias("n_tokens"), T.distinct_count(words).alias("query_len"))


def _asked(c: str = "p_size") -> Column:
    return F.concat(F.when(F.col(c) % 7 == 0, "Nike ").otherwise(""), F.col("p_name"), F.lit(" XPS"), F.col(c).cast("string"))


ASKED = "case when p_size % 7 = 0 then 'Nike ' else '' end || p_name || ' XPS' || p_size::varchar"


@query(f"""select p_partkey, query, case when {any_in(norm_query('query'), entities.known_brands())} then 'BRAND' when {' or '.join(f"regexp_matches(query, '{p}')" for p in fixed.SKU_PATTERNS)} then 'SKU' else 'GENERIC' end as intent
from (select p_partkey, {ASKED} as query from part)""")
def intent_classify(spark, sf):
    return read(spark, sf, "part").select("p_partkey", _asked().alias("query")).select("p_partkey", "query", T.intent(F.col("query"), entities.known_brands()).alias("intent"))


@query(r"select doc_id, case when regexp_matches(text, '[\x{0900}-\x{097F}]') then 'hi' when regexp_matches(text, '[\x{0600}-\x{06FF}]') then 'ar' when regexp_matches(text, '[\x{0100}-\x{017F}]') then 'pl' else 'en' end as script_lang from documents")
def script_lang_detect(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.script_language(F.col("text")).alias("script_lang"))


@query(f"select p_partkey, {translated('query')} as translated from (select p_partkey, '  tanie ' || p_name || '  buty Buty' as query from part)")
def translate_tokens(spark, sf):
    return read(spark, sf, "part").select("p_partkey", T.translate_words(F.concat(F.lit("  tanie "), "p_name", F.lit("  buty Buty"))).alias("translated"))


def _replaced(x: str, lang: str) -> str:
    for a, b in fixed.TITLE_WORDS[lang].items():
        x = f"replace({x}, {text_literal(a)}, {text_literal(b)})"
    return x


@query(f"select p_partkey, {', '.join(f'''case when {_replaced('title', g)} <> title then {_replaced('title', g)} else p_brand || ' ' || p_type || ' {fixed.TITLE_SUFFIX[g]}' end as title_{g}''' for g in fixed.TITLE_WORDS)} from (select *, p_name || case when p_size % 2 = 0 then ' Running Footwear Men''s' else '' end as title from part)")
def sequential_replace(spark, sf):
    rows = read(spark, sf, "part").withColumn("title", F.concat("p_name", F.when(F.col("p_size") % 2 == 0, " Running Footwear Men's").otherwise("")))
    return rows.select("p_partkey", *[T.local_title(F.col("title"), F.col("p_brand"), F.col("p_type"), g).alias(f"title_{g}") for g in fixed.TITLE_WORDS])


@query("select doc_id, substring(text, 1, 512) as head, length(substring(text, 1, 512)) as n from documents")
def truncate_512(spark, sf):
    head = T.truncate(F.col("text"))
    return read(spark, sf, "documents").select("doc_id", head.alias("head"), F.length(head).alias("n"))


@query(r"select event_id, regexp_replace(props || chr(10) || event_type || chr(7), '[\x00-\x1F\x7F]', '', 'g') as clean, json_extract_string(props, '$.k')::bigint as k from events")
def strip_and_parse(spark, sf):
    dirty = F.concat("props", F.lit("\n"), "event_type", F.lit("\x07"))
    return read(spark, sf, "events").select("event_id", T.strip_controls(dirty).alias("clean"), T.json_in_text(dirty, "k long")["k"].alias("k"))


@query("select p_partkey, substr(md5(p_name), 1, 6) as name_id, case when length(p_brand) > 3 then substr(p_brand, 1, 1) || substr(p_brand, 3, 1) || substr(p_brand, 2, 1) || substr(p_brand, 4) else p_brand end as misspelt, regexp_replace('Buy ' || upper(p_brand) || ' now', '(?i)' || regexp_escape(p_brand), 'some brand', 'g') as masked from part")
def short_ids_and_noise(spark, sf):
    return read(spark, sf, "part").select("p_partkey", T.short_id(F.col("p_name")).alias("name_id"), T.swap_letters(F.col("p_brand"), F.lit(1)).alias("misspelt"), T.replace_ignoring_case(F.concat(F.lit("Buy "), F.upper("p_brand"), F.lit(" now")), F.col("p_brand"), F.lit("some brand")).alias("masked"))


BRANDS = "select lower(p_brand) as name, row_number() over (order by p_brand) as ordinal from (select distinct p_brand from part)"


@query(f"""with b as ({BRANDS}), q as (select distinct 'Buy ' || p_brand || ' ' || p_type || ' or ' || p_brand || '1' as query from part),
h as (select query, min_by(name, ordinal) as query_brand from q join b on contains({norm_query('query')}, name) group by query)
select q.query, h.query_brand from q left join h on h.query = q.query""")
def brand_match_join(spark, sf):
    part = read(spark, sf, "part")
    brands = part.select("p_brand").distinct().select(F.lower("p_brand").alias("name"), F.col("p_brand").alias("ordinal"))
    asked = part.select(F.concat(F.lit("Buy "), "p_brand", F.lit(" "), "p_type", F.lit(" or "), "p_brand", F.lit("1")).alias("query")).distinct()
    return entities.first_brand(asked, brands)


FORM_LIST = [f for forms in [*fixed.CATEGORY_FORMS.values(), *fixed.BRAND_FORMS.values()] for f in forms]


@query(f"select p_partkey, raw, {norm_entity('raw', 'category')} as category, {norm_entity('raw', 'brand')} as brand from (select p_partkey, ' ' || upper([{', '.join(map(text_literal, FORM_LIST))}][1 + (p_partkey % {len(FORM_LIST)})::int]) || ' ' as raw from part)")
def synonym_normalize(spark, sf):
    raw = F.concat(F.lit(" "), F.upper(F.get(F.array(*[F.lit(x) for x in FORM_LIST]), (F.col("p_partkey") % len(FORM_LIST)).cast("int"))), F.lit(" "))
    return read(spark, sf, "part").select("p_partkey", raw.alias("raw")).select("p_partkey", "raw", entities.normalize_entity(F.col("raw"), "category").alias("category"), entities.normalize_entity(F.col("raw"), "brand").alias("brand"))


# ---- interactions -------------------------------------------------------------------------------------------


def _catalog(spark, sf):
    return read(spark, sf, "part").select(F.col("p_partkey").alias("pid"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"))


def rule_sql(q: str, b: str, c: str) -> str:
    nq, nb, nc = norm_query(q), norm_entity(b, "brand"), norm_entity(c, "category")
    return f"case when {any_in(f'lower({q})', ('irrelevant', 'hard_negative'))} then 0 when contains({nq}, {nb}) and contains({nq}, {nc}) then 3 when contains({nq}, {nb}) or contains({nq}, {nc}) then 2 when {any_in(nq, fixed.BUYING_WORDS)} then 1 else 0 end"


PLAIN = f"""(select 'q' || pid::varchar || '_' || substr(query, 1, 20) as qid, pid, query, query_lang, product_title, brand, category, {rule_sql('query', 'brand', 'category')} as relevance, template_no from (
select p_partkey as pid, p_name as product_title, p_brand as brand, p_type as category, t.no as template_no, t.lang as query_lang, replace(replace(t.template, '{{brand}}', p_brand), '{{category}}', p_type) as query
from part, (values {', '.join(f"({k}, '{lang}', '{t}')" for k, (lang, t) in enumerate(fixed.PLAIN_QUERIES))}) t(no, lang, template)))"""


def _plain(spark, sf):
    return synth.plain_queries(_catalog(spark, sf))


@query(f"select * from {PLAIN}")
def plain_queries(spark, sf):
    return _plain(spark, sf)


@query(f"select template_no, relevance, count(*) as n from {PLAIN} group by all")
def rule_relevance(spark, sf):
    return _plain(spark, sf).groupBy("template_no", "relevance").agg(F.count("*").alias("n"))


def _forms_sql(x: str, kind: str, table: dict[str, list[str]]) -> str:
    lists = ", ".join(f"{text_literal(k)}: [{', '.join(map(text_literal, v))}]" for k, v in table.items())
    return f"coalesce(MAP {{{lists}}}[{norm_entity(x, kind)}], [{norm_entity(x, kind)}])"


_EXPAND = " || ".join([tok("q"), *[f"case when {any_in('q', forms)} then [{', '.join(map(text_literal, forms))}] else []::varchar[] end" for forms in [*fixed.BRAND_FORMS.values(), *fixed.CATEGORY_FORMS.values()]]])


@query(f"""with r as (select p_partkey, lower([ 'Nike Inc sneakers', 'best gadgets', 'X1000 trainers', 'sony', 'running top', 'gym', 'hard_negative nike shoes', 'nothing', 'apple computer X1000'][1 + (p_partkey % 9)::int]) as q,
['Nike', 'Sony', 'Apple'][1 + (p_size % 3)::int] as brand, ['shoes', 'Electronics', 'clothing', 'Other'][1 + (p_size % 4)::int] as category, case when p_size % 5 = 0 then null else 'X1000' end as model, ['Gym', ''][1 + (p_size % 2)::int] as activity from part),
e as (select *, list_has_any({_EXPAND}, {_forms_sql('brand', 'brand', fixed.BRAND_FORMS)}) as b, list_has_any({_EXPAND}, {_forms_sql('category', 'category', fixed.CATEGORY_FORMS)}) as c, coalesce(contains(q, lower(model)), false) as m from r)
select p_partkey, case when {any_in('q', ('irrelevant', 'hard_negative'))} then 0 when (b and c) or (b and m) or (c and m) then 3 when b or c then 2 when {any_in('q', fixed.BUYING_WORDS_WIDE)} then 1 when activity <> '' and contains(q, lower(activity)) then 1 else 0 end as relevance from e""")
def synonym_relevance(spark, sf):
    of = lambda xs, n: F.get(F.array(*[F.lit(x) for x in xs]), n.cast("int"))
    size = F.col("p_size")
    asked = of(["Nike Inc sneakers", "best gadgets", "X1000 trainers", "sony", "running top", "gym", "hard_negative nike shoes", "nothing", "apple computer X1000"], F.col("p_partkey") % 9)
    grade = synth.synonym_grade(asked, of(["Nike", "Sony", "Apple"], size % 3), of(["shoes", "Electronics", "clothing", "Other"], size % 4), F.when(size % 5 != 0, "X1000"), of(["Gym", ""], size % 2))
    return read(spark, sf, "part").select("p_partkey", grade.alias("relevance"))


@query("select p_name, min_by(p_partkey, p_partkey) as p_partkey, min_by(p_brand, p_partkey) as p_brand from part group by p_name")
def catalog_dedup_first(spark, sf):
    return interactions.first_of(read(spark, sf, "part").select("p_name", "p_partkey", "p_brand"), "p_name", ["p_partkey"])


EXTERNAL = "select conv_id::varchar as query_id, turn::varchar as product_id, text as query, case when turn % 2 = 0 then 'es' end as product_locale, substr(text, 1, 40) as product_title, null as product_brand, ['Exact', 'S', 'Complement', 'X'][1 + (turn % 4)::int] as esci_label from conversations"
GRADES = "coalesce(MAP {" + ", ".join(f"'{k}': {v}" for k, v in fixed.LABEL_GRADES.items()) + "}[esci_label], 0)"


def _external(spark, sf):
    label = F.get(F.array(*[F.lit(x) for x in ("Exact", "S", "Complement", "X")]), (F.col("turn") % 4).cast("int"))
    return read(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("query_id"), F.col("turn").cast("string").alias("product_id"), F.col("text").alias("query"), F.when(F.col("turn") % 2 == 0, "es").alias("product_locale"), F.substring("text", 1, 40).alias("product_title"), F.lit(None).cast("string").alias("product_brand"), label.alias("esci_label"))


@query(f"select query_id as qid, product_id as pid, coalesce(query, '') as query, coalesce(product_locale, 'en') as query_lang, coalesce(product_title, '') as product_title, coalesce(product_brand, '') as brand, coalesce(product_locale, 'en') as category, {GRADES} as relevance from ({EXTERNAL})")
def external_scan(spark, sf):
    return interactions.from_external(_external(spark, sf))


@query(f"select esci_label, {GRADES} as relevance, count(*) as n from ({EXTERNAL}) group by all")
def label_map(spark, sf):
    return _external(spark, sf).select("esci_label", interactions.grade_of_label(F.col("esci_label")).alias("relevance")).groupBy("esci_label", "relevance").agg(F.count("*").alias("n"))


@query(f"with e as ({EXTERNAL}) select template_no, relevance, count(*) as n from (select template_no, relevance from {PLAIN} union all select null, {GRADES} from e) group by all")
def interaction_union(spark, sf):
    plain = _plain(spark, sf).withColumn("pid", F.col("pid").cast("string"))
    return interactions.union_sources(plain, None, interactions.from_external(_external(spark, sf))).groupBy("template_no", "relevance").agg(F.count("*").alias("n"))


@query(f"select count(*) as n, min(relevance) as low, max(relevance) as high, max(length(substr(query, 1, 512))) as longest from (select query, {GRADES} as relevance from ({EXTERNAL}))")
def ingest_validate(spark, sf):
    rows = interactions.validate(interactions.from_external(_external(spark, sf)))
    return rows.agg(F.count("*").alias("n"), F.min("relevance").alias("low"), F.max("relevance").alias("high"), F.max(F.length("query")).alias("longest"))


@query("select quality, toxic, count(*) as n from labels group by all order by 1, 2")
def label_histogram(spark, sf):
    return read(spark, sf, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n")).orderBy("quality", "toxic")


@query(f"select count(*) as n, count(distinct qid) as n_qid, count(distinct pid) as n_pid from {PLAIN}")
def distinct_counts(spark, sf):
    return _plain(spark, sf).agg(F.count("*").alias("n"), F.countDistinct("qid").alias("n_qid"), F.countDistinct("pid").alias("n_pid"))


# ---- candidates ---------------------------------------------------------------------------------------------

RETRIEVED = "(select l_suppkey as qid, l_partkey as pid, sum(l_quantity) as score, max(p_size % 2)::int as brand_match from lineitem join part on p_partkey = l_partkey group by all)"
LABELS = "(select l_suppkey as qid, l_partkey as pid, 1 + (l_linenumber % 3) as relevance from lineitem where l_returnflag = 'R' and l_linenumber < 4)"
TIERED = f"""lab as (select qid, pid, max(relevance) as relevance from {LABELS} group by all),
kept as (select * from (select r.*, quantile_cont(score::double, 0.25) over (partition by qid) as floor, score / greatest(max(score) over (partition by qid), 1e-6) as relative from {RETRIEVED} r) where score >= floor),
top as (select qid, pid, score, brand_match, score / greatest(max(score) over (partition by qid), 1e-6) as relative from kept),
fresh as (select * from top anti join lab using (qid, pid)),
t as (select qid, pid, 0 as tier, relevance::double as score from lab union all select qid, pid, case when relative > 0.7 and brand_match = 0 then 1 else 2 end, score from fresh),
tr as (select qid, pid, tier, row_number() over (partition by qid, tier order by score desc, pid) as tier_rank from t)"""
COMPOSED = f"{TIERED}, comp as (select * from (select qid, pid, tier, row_number() over (partition by qid order by tier, tier_rank) as place from tr where tier <> 1 or tier_rank <= 10) where place <= 100)"


def _retrieved(spark, sf):
    part = read(spark, sf, "part").select(F.col("p_partkey").alias("pid"), (F.col("p_size") % 2).alias("b"))
    rows = read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("qid"), F.col("l_partkey").alias("pid")).agg(F.sum("l_quantity").alias("score"))
    return rows.join(part, "pid").select("qid", "pid", "score", F.col("b").alias("brand_match"))


def _labels(spark, sf):
    return read(spark, sf, "lineitem").where("l_returnflag = 'R' and l_linenumber < 4").select(F.col("l_suppkey").alias("qid"), F.col("l_partkey").alias("pid"), (1 + F.col("l_linenumber") % 3).alias("relevance"))


@query(f"select qid, pid, round(score, 6) as score from (select *, quantile_cont(score::double, 0.25) over (partition by qid) as floor from {RETRIEVED}) where score >= floor")
def p25_filter(spark, sf):
    return candidates.above_quartile(_retrieved(spark, sf)).select("qid", "pid", F.round("score", 6).alias("score"))


@query(f"with {TIERED} select * from tr")
def hard_negative_mining(spark, sf):
    return candidates.tiers(_retrieved(spark, sf), _labels(spark, sf))


COSINE = f"(select qid, pid, (score % 100) / 100.0 as score, brand_match from {RETRIEVED})"


@query(f"""with lab as (select qid, pid, max(relevance) as relevance from {LABELS} group by all),
fresh as (select * from {COSINE} anti join lab using (qid, pid) where score > 0.5),
t as (select qid, pid, 0 as tier, relevance::double as score from lab union all select qid, pid, case when score > 0.6 and brand_match = 0 then 1 else 2 end, score from fresh)
select qid, pid, tier, row_number() over (partition by qid, tier order by score desc, pid) as tier_rank from t""")
def semantic_candidates(spark, sf):
    found = _retrieved(spark, sf).withColumn("score", (F.col("score") % 100) / 100.0)
    return candidates.semantic_tiers(found, _labels(spark, sf))


@query(f"with {COMPOSED} select * from comp")
def candidate_compose(spark, sf):
    return candidates.compose(hard_negative_mining(spark, sf), 100)


@query(f"with {COMPOSED} select qid, pid, tier, place, coalesce(relevance, 0) as relevance from comp left join lab using (qid, pid)")
def candidate_labels(spark, sf):
    return candidates.with_labels(candidate_compose(spark, sf), _labels(spark, sf))


@query(f"with {COMPOSED}, l as (select qid, pid, tier, place, coalesce(relevance, 0) as relevance from comp left join lab using (qid, pid)) select qid, pid, tier, place, relevance from (select *, count(*) over (partition by qid) as n, max(relevance) over (partition by qid) as m from l) where n >= 2 and m > 0")
def group_filter(spark, sf):
    return candidates.useful_groups(candidate_labels(spark, sf))


@query("select count(*) as n_overlap from (select distinct l_partkey from lineitem where l_returnflag = 'R') semi join part on p_partkey = l_partkey")
def pid_overlap(spark, sf):
    got = read(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return got.join(read(spark, sf, "part").select("p_partkey"), "p_partkey", "left_semi").agg(F.count("*").alias("n_overlap"))


# ---- features -----------------------------------------------------------------------------------------------

FEATURE_SQL = bm25_sql("select p_partkey as doc_idx, p_name as text from part", f"select distinct query as qid, query from {PLAIN}", lead=f"plain as (select * from {PLAIN}),") + f""",
base as (select p.qid, p.pid, p.relevance, p.query, p.product_title as title, p.brand, p.category, coalesce(sc.score, 0) / 10 as bm25_score from plain p left join sc on sc.qid = p.query and sc.doc_idx = p.pid),
f as (select qid, pid, relevance, bm25_score,
coalesce(len(list_intersect({tok('query')}, {tok('title')})) / nullif(len(list_distinct({tok('query')} || {tok('title')})), 0), 0) as jaccard,
({norm_entity('brand', 'brand')} <> '' and contains({norm_query('query')}, {norm_entity('brand', 'brand')}))::int::double as brand_match,
({norm_entity('category', 'category')} <> '' and contains({norm_query('query')}, {norm_entity('category', 'category')}))::int::double as category_match,
contains(lower(title), {norm_query('query')})::int::double as exact_title_match, len(list_distinct({tok('query')}))::double as query_len,
{any_in(norm_query('query'), entities.known_brands())}::int::double as intent_brand_weight from base),
g as (select *, (bm25_score + jaccard + exact_title_match) / 3 as lexical_channel, (brand_match + category_match + intent_brand_weight) / 3 as constraint_channel from f)"""
SHOWN = ("bm25_score", "jaccard", "brand_match", "category_match", "exact_title_match", "query_len", "intent_brand_weight", "lexical_channel", "constraint_channel")


def _pairs(spark, sf):
    """Every plain interaction with its item's columns and BM25 score over the titles."""
    plain = _plain(spark, sf).select("qid", "pid", "relevance", "query", "template_no")
    items = features.with_catalog_columns(_catalog(spark, sf))
    asked = plain.select(F.col("query").alias("qid"), "query").distinct()
    wanted = plain.select(F.col("query").alias("qid"), F.col("pid").alias("doc_idx"))
    scores = bm25.scores(_catalog(spark, sf).select(F.col("pid").alias("doc_idx"), F.col("title").alias("text")), asked, candidates=wanted)
    scores = scores.select(F.col("qid").alias("query"), F.col("doc_idx").alias("pid"), F.col("score").alias("bm25"))
    # merged, never broadcast: both sides grow with the parts, and Spark sizes them by the compressed file
    rows = plain.join(items.hint("merge"), "pid").join(scores.hint("merge"), ["query", "pid"], "left")
    return features.hashed_similarities(rows.fillna(0.0, ["bm25"]))


def _matrix(spark, sf):
    return features.feature_matrix(_pairs(spark, sf), ["qid", "pid", "relevance", "template_no"])


@query(FEATURE_SQL + f" select qid, pid, relevance, {', '.join(f'round({c}, 4) as {c}' for c in SHOWN)} from g")
def feature_matrix(spark, sf):
    made = features.feature_columns()
    return _pairs(spark, sf).select("qid", "pid", "relevance", *[F.round(made[c], 4).alias(c) for c in SHOWN])


@query(FEATURE_SQL + " select relevance, count(*) as n, round(avg(lexical_channel), 6) as lexical, round(avg(constraint_channel), 6) as constraint_ from g group by relevance")
def channel_aggregates(spark, sf):
    made = features.feature_columns()
    rows = _pairs(spark, sf).select("relevance", made["lexical_channel"].alias("a"), made["constraint_channel"].alias("b"))
    return rows.groupBy("relevance").agg(F.count("*").alias("n"), F.round(F.avg("a"), 6).alias("lexical"), F.round(F.avg("b"), 6).alias("constraint_"))


@query()
def feature_vectors(spark, sf):
    return _matrix(spark, sf)


@query(FEATURE_SQL + " select * from (" + " union all ".join(f"select '{c}' as feature, round(avg({c}), 4) as mean, round(stddev_pop({c}), 4) as std from g" for c in SHOWN) + ")")
def feature_stats(spark, sf):
    return features.feature_stats(_matrix(spark, sf)).where(F.col("feature").isin(*SHOWN)).select("feature", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


# ---- guardrails and metrics ---------------------------------------------------------------------------------

ASKS = ["nike shoes", "tanie buty", "laptop deals", "samsung phones", "garden hose", "electronics"]
KINDS = ["shoes", "Footwear", "accessories", "phones", "electronics", "us", "", "cases"]
SCORED = f"(select l_suppkey as qid, l_partkey as pid, [{', '.join(map(text_literal, ASKS))}][1 + (l_suppkey % {len(ASKS)})::int] as query, round(avg(l_quantity) / 50 - 0.2, 6) as score, max(p_size % 2)::int as brand_match, [{', '.join(map(text_literal, KINDS))}][1 + (l_partkey % {len(KINDS)})::int] as category, max(l_linenumber % 4)::int as relevance from lineitem join part on p_partkey = l_partkey group by l_suppkey, l_partkey)"


def _scored(spark, sf):
    of = lambda xs, n: F.get(F.array(*[F.lit(x) for x in xs]), (n % len(xs)).cast("int"))
    rows = read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("qid"), F.col("l_partkey").alias("pid")).agg(F.round(F.avg("l_quantity") / 50 - 0.2, 6).alias("score"), F.max(F.col("l_linenumber") % 4).alias("relevance"))
    part = read(spark, sf, "part").select(F.col("p_partkey").alias("pid"), (F.col("p_size") % 2).alias("brand_match"))
    return rows.join(part, "pid").select("qid", "pid", of(ASKS, F.col("qid")).alias("query"), "score", "brand_match", of(KINDS, F.col("pid")).alias("category"), "relevance")


def _kinds_sql(values) -> str:
    return "(" + ", ".join(map(text_literal, values)) + ")"


_NK = norm_entity("category", "category")
_ALIAS = lambda x: f"coalesce({sql_map(fixed.CATEGORY_ALIASES)}[{x}], {x})"


@query(f"""with a as (select *, {_NK} as kind, case when {any_in(norm_query('query'), entities.known_brands())} and brand_match = 0 and score < 0.9 then score * 0.1 else score end as s from {SCORED}),
b as (select *, row_number() over (partition by qid order by s desc, pid) <= 10 and {any_in(norm_query('query'), fixed.PRIMARY_TRAINING)} as t from a),
c as (select *, min(case when t and kind in {_kinds_sql(fixed.PRIMARY_TRAINING)} then s end) over (partition by qid) as f from b)
select qid, pid, round(case when t and kind in {_kinds_sql(fixed.ACCESSORIES)} and f is not null then least(s, f - 0.1) else s end, 6) as score from c""")
def guardrail_training(spark, sf):
    return guardrails.training_guardrails(_scored(spark, sf)).select("qid", "pid", F.round("score", 6).alias("score"))


def _target_sql() -> str:
    return "case " + " ".join(f"when contains({norm_query('query')}, '{c}') or contains({norm_query(translated('query'))}, '{c}') then '{fixed.CATEGORY_ALIASES.get(c, c)}'" for c in fixed.PRIMARY_SERVING) + " end"


SERVED = f"""a as (select *, {_ALIAS(_NK)} as kind, {_target_sql()} as target, median(score) over (partition by qid) as m, ({any_in(norm_query('query'), entities.known_brands())} or {any_in(norm_query(translated('query')), entities.known_brands())}) as named from {SCORED}),
b as (select * exclude (score), case when named and brand_match = 0 and score < m then score * 0.1 else score end as score from a),
c as (select *, median(score) over (partition by qid) as m2 from b),
d as (select * exclude (score), case when target is not null and kind <> target and kind not in {_kinds_sql(fixed.UNKNOWN_CATEGORIES)} and score < m2 then score * 0.05 when target is not null and kind = target then score + abs(m2) * 0.5 else score end as score from c),
e as (select *, row_number() over (partition by qid order by score desc, pid) <= 10 and target is not null as t, (max(score) over (partition by qid) - min(score) over (partition by qid)) * 0.01 as gap from d),
f as (select *, min(case when t and kind = target then score end) over (partition by qid) as fl from e),
g as (select qid, pid, case when t and kind in {_kinds_sql(fixed.ACCESSORIES)} and fl is not null then least(score, fl - case when gap = 0 then 0.01 else gap end) else score end as score from f)"""


@query(f"with {SERVED} select qid, pid, round(score, 12) + 0.0 as score from g")
def guardrail_serving(spark, sf):
    return guardrails.serving_guardrails(_scored(spark, sf)).select("qid", "pid", (F.round("score", 12) + F.lit(0.0)).alias("score"))


@query(f"select qid, pid, round(score, 6) as score, rank from (select *, row_number() over (partition by qid order by score desc, pid) as rank from (select *, max(score) over (partition by qid) as hi, min(score) over (partition by qid) as lo from (select * exclude (score), score * 10 as score from {SCORED})) where score > hi - greatest(3.0, (hi - lo) * 0.4)) where rank <= 20")
def score_gap_cut(spark, sf):
    return guardrails.score_gap_cut(_scored(spark, sf).withColumn("score", F.col("score") * 10), 20).select("qid", "pid", F.round("score", 6).alias("score"), "rank")


def ndcg_sql(rows: str, keys: str) -> str:
    return f"""r as (select *, row_number() over (partition by {keys} order by score desc) as rn, row_number() over (partition by {keys} order by relevance desc) as rg from {rows}),
dd as (select {keys}, sum(part) as dcg from (select {keys}, score, avg(relevance) * sum(case when rn <= 10 then 1 / log2(rn + 1) else 0 end) as part from r group by {keys}, score) group by {keys}),
ii as (select {keys}, sum(case when rg <= 10 then relevance / log2(rg + 1) else 0 end) as idcg from r group by {keys}),
nn as (select {keys}, dcg / idcg as ndcg from dd join ii using ({keys}) where idcg > 0)"""


def mrr_sql(rows: str, keys: str) -> str:
    return f"""ro as (select *, row_number() over (partition by {keys} order by score desc, pid) as ro from {rows}),
mm as (select {keys}, coalesce(1 / min(case when relevance > 0 then ro end), 0) as rr from ro group by {keys})"""


@query(f"with {ndcg_sql(SCORED, 'qid')} select qid, round(ndcg, 6) as ndcg from nn")
def ndcg_at_10(spark, sf):
    return evaluate.ndcg(_scored(spark, sf)).select("qid", F.round("ndcg", 6).alias("ndcg"))


@query(f"with {mrr_sql(SCORED, 'qid')} select qid, round(rr, 6) as rr from mm")
def mrr(spark, sf):
    return evaluate.mrr(_scored(spark, sf)).select("qid", F.round("rr", 6).alias("rr"))


METHODS = {"BM25": "brand_match", "Semantic": "score", "Full": "mixed"}
LONG = "(" + " union all ".join(f"select qid, pid, relevance, '{m}' as method, {c}::double as score from (select *, score + brand_match as mixed from {SCORED})" for m, c in METHODS.items()) + ")"


@query(f"with {ndcg_sql(LONG, 'method, qid')}, {mrr_sql(LONG, 'method, qid')} select method, round(avg(ndcg), 6) as ndcg, round(avg(rr), 6) as mrr from nn join mm using (method, qid) group by method")
def ablation(spark, sf):
    rows = _scored(spark, sf).withColumn("mixed", F.col("score") + F.col("brand_match"))
    return evaluate.ablation(rows, METHODS).select("method", F.round("ndcg", 6).alias("ndcg"), F.round("mrr", 6).alias("mrr"))


@query(bm25_sql(DOCS, BENCH) + ", rr as (select sc.qid, sc.doc_idx as pid, round(score, 6) as score, contains(corpus.text, qs.query)::int as relevance from sc join qs on qs.qid = sc.qid join corpus on corpus.doc_idx = sc.doc_idx), " + ndcg_sql("rr", "qid") + ", " + mrr_sql("rr", "qid") + " select round(avg(ndcg), 6) as ndcg, round(avg(rr), 6) as mrr from nn join mm using (qid)")
def full_catalog_eval(spark, sf):
    docs, asked = _documents(spark, sf), _benchmark(spark, sf)
    found = bm25.scores(docs, asked).select("qid", F.col("doc_idx").alias("pid"), F.round("score", 6).alias("score"))
    truth = against_all(docs, asked, "qid").where(F.contains("text", "query")).select("qid", F.col("doc_idx").alias("pid"), F.lit(1).alias("relevance"))
    rows = found.join(truth, ["qid", "pid"], "left").fillna(0, ["relevance"])
    return evaluate.mean_metrics(rows).select(F.round("ndcg", 6).alias("ndcg"), F.round("mrr", 6).alias("mrr"))


# ---- sampling and synthesis ---------------------------------------------------------------------------------


@query("select o_orderkey, case when o_orderpriority like '1%' then round_even(least(greatest(3 * (o_totalprice / 500000), 0), 3), 0)::int else 0 end as relevance from orders")
def distill_labels(spark, sf):
    rows = read(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderpriority").startswith("1"), "synth_x").otherwise("x").alias("pid"), F.lit(0).alias("relevance"), (F.col("o_totalprice") / 500000).alias("teacher_score"))
    return synth.distill(rows).select("o_orderkey", "relevance")


@query(f"select qid, p as n_pos, least(n - p, greatest(p, floor(p * 3.0)::bigint)) as n_neg from (select qid, count_if(relevance > 0) as p, count(*) as n from {SCORED} group by qid) where p > 0")
def negative_downsample_counts(spark, sf):
    kept = sampling.downsample_negatives(_scored(spark, sf))
    return kept.groupBy("qid").agg(F.count_if(F.col("relevance") > 0).alias("n_pos"), F.count_if(F.col("relevance") <= 0).alias("n_neg"))


@query(f"with s as (select count(*) as n, count_if(relevance > 0) as p, count_if(relevance = 3) as r from {SCORED}) select n as n_before, case when r > 0 then greatest(floor(p * 0.5)::bigint - r, 0) else 0 end as n_extra from s")
def rare_upsample_counts(spark, sf):
    rows = _scored(spark, sf).withColumn("qid", F.col("qid").cast("string"))
    more = sampling.upsample_rare(rows, label=3, target=0.5)
    return more.agg(F.count_if(F.col("qid") != sampling.EXTRA).alias("n_before"), F.count_if(F.col("qid") == sampling.EXTRA).alias("n_extra"))


@query(f"with g as (select qid, ('0x' || substr(md5('42:' || qid::varchar), 1, 8))::bigint as h from (select distinct qid from {SCORED})), k as (select *, row_number() over (order by h, qid) as rn, count(*) over () as n from g) select qid, case when rn <= floor(n * 0.8) then 'train' else 'val' end as split from k")
def group_split(spark, sf):
    return sampling.group_split(_scored(spark, sf)).select("qid", "split").distinct()


@query("select round_, train, val, round(train - val, 6) as gap, case when train - val > 0.05 then 'overfit' when train - val > 0.02 then 'mild' else 'good' end as verdict from (select s_suppkey as round_, (s_suppkey % 97) / 100.0::double as train, (s_suppkey % 89) / 100.0::double as val from supplier)")
def gap_diagnostics(spark, sf):
    rows = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("round_"), ((F.col("s_suppkey") % 97) / 100.0).alias("train"), ((F.col("s_suppkey") % 89) / 100.0).alias("val"))
    return model.gap_verdict(rows).withColumn("gap", F.round("gap", 6))


CATEGORIES, MAKERS = ["Footwear", "Electronics", "Clothing", "Home"], ["Nike", "Sony", "Samsung", "Apple"]


def _augmented(spark, sf):
    return synth.catalog(spark, read(spark, sf, "part").count(), CATEGORIES, MAKERS)


@query()
def augmented_catalog(spark, sf):
    return _augmented(spark, sf)


@query()
def augmented_queries(spark, sf):
    return synth.augmented_queries(_augmented(spark, sf)).drop("attributes")


@query()
def hard_negative_queries(spark, sf):
    return synth.hard_negatives(synth.augmented_queries(_augmented(spark, sf)))


# ---- model and streams --------------------------------------------------------------------------------------


@query()
def train_rank(spark, sf):
    """Metrics of the rounds of a ranker trained on all composed candidates of the plain interactions, with their full features."""
    from lodestone.plans import serving

    return serving.train(*serving.demo_tables(spark, sf), EngineConfig()).diagnostics(spark)


@query()
def rank_end_to_end(spark, sf):
    from lodestone.plans import serving

    return serving.demo(spark, sf)


@query("select time_bucket(interval 1 hour, ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def streaming_windows(spark, sf):
    from lodestone.plans import streams

    return streams.windows(spark, sf).withColumn("total", F.round("total", 4))


@query("select count(*) as n, count(distinct user_id) as n_keys from (select distinct user_id from events)")
def streaming_first_seen(spark, sf):
    from lodestone.plans import streams

    return streams.first_seen(spark, sf)


@query("select (event_id % 4)::int as relevance, count(*) as n from events group by all")
def streaming_ingest(spark, sf):
    from lodestone.plans import streams

    return streams.ingest(spark, sf)
