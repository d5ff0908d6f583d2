"""Queries of texts: tokens, chunks, embeddings, BM25 and hybrid search, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.jobs import symbols
from tessera.operators import chunking, embedding, grams, lexical, postings, search
from tessera.session import table, with_checkpoints

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text")


_TOKENS = r"regexp_extract_all(lower(regexp_replace({0},'([a-z0-9])([A-Z])','\1 \2','g')),'[a-z_][a-z0-9_]+|[0-9]+')"
_TERMS = r"regexp_extract_all(lower({0}),'[\p{{L}}\p{{N}}]+')"
_DOC_TOKENS = _TOKENS.format("text")
_LINES = """l as (select doc_id, source || '/' || doc_id || '.txt' as path, string_split_regex(text, '\\r?\\n') as lines from documents),
k as (select *, unnest(range(0, 1 + greatest(0, ceil((len(lines) - {n}) / {step}.0))::bigint)) as w from l),
c as (select doc_id, path, (w * {step} + 1)::int as start_line, least(len(lines), w * {step} + {n})::int as end_line,
  regexp_replace(array_to_string(lines[w * {step} + 1 : w * {step} + {n}], chr(10)), '^\\s+|\\s+$', '', 'g') as text from k)"""


@query(f"select token, count(*) as n from (select unnest({_DOC_TOKENS}) as token from documents) group by token")
def tokenize_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.explode(T.tokenize(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(f"select doc_id, md5(text) as digest, len({_DOC_TOKENS}) as n_tokens, sha256(text) as content from documents")
def content_hash(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("digest"), F.size(T.tokenize(F.col("text"))).alias("n_tokens"), F.sha2("text", 256).alias("content"))


@query("select sha256(text) as content, count(*) as n, min(doc_id) as first_id from documents group by 1 having count(*) > 1")
def exact_duplicate_groups(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("content"))
    return d.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("with " + _LINES.format(n=10, step=8) + " select path, start_line, end_line, md5(text) as digest from c where text <> ''")
def line_window_chunks(spark, sf_dir):
    c = chunking.line_windows(_files(spark, sf_dir), 10, 2)
    return c.select("path", "start_line", "end_line", F.md5(F.encode("text", "UTF-8")).alias("digest"))


@query(
    "with " + _LINES.format(n=80, step=72) + """ select path || ':' || start_line || '-' || end_line || ':' ||
  lower(printf('%X', list_reduce(list_prepend(2166136261::bigint, list_transform(string_split(text, ''), lambda x: unicode(x)::bigint)), lambda h, u: (xor(h, u) * 16777619) & 4294967295))) as id
from c where text <> ''"""
)
def chunk_ids_fnv(spark, sf_dir):
    return chunking.with_ids(chunking.line_windows(_files(spark, sf_dir))).select("id")


_FNV = "list_reduce(list_prepend(2166136261::bigint, list_transform(string_split({0}, ''), lambda x: unicode(x)::bigint)), lambda h, u: (xor(h, u) * 16777619) & 4294967295)"


def _hashed_sql(name: str, rows: str, key: str, dims: int) -> str:
    return f"""{name}_c as (select {key}, token, count(*) as n from (select {key}, unnest({_DOC_TOKENS}) as token from {rows}) group by all),
{name}_b as (select token, ({_FNV.format("token")} % {dims})::int as idx, (case when {_FNV.format("('sign:' || token)")} % 2 = 0 then 1.0 else -1.0 end)
  * (case when length(token) > 16 then 1.3 when contains(token, '_') then 1.2 else 1.0 end)::double as w from (select distinct token from {name}_c)),
{name}_s as (select {key}, idx, sum(n * w) as s from {name}_c join {name}_b using (token) group by all),
{name} as (select * from (select {key}, idx, round(s / sqrt(sum(s * s) over (partition by {key})), 6) as v from {name}_s qualify sum(s * s) over (partition by {key}) > 0) where v <> 0)"""


@query("with " + _hashed_sql("e", "documents", "doc_id", 384) + " select doc_id, idx, v from e")
def hash_embedding_sparse(spark, sf_dir):
    return embedding.hashed(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))


@query("with " + _hashed_sql("e", "documents", "doc_id", 384) + "," + _hashed_sql("q", "benchmark", "item_id", 384) + """
select item_id, doc_id, score, rank from (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as rank
  from (select item_id, doc_id, round(sum(q.v::decimal(9,6) * e.v::decimal(9,6)), 4)::double as score from q join e using (idx) group by all)) where rank <= 5""")
def hash_embedding_topk(spark, sf_dir):
    return search.nearest_hashed(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text", 5)


@query("""select query_id, vec_id, score, rank from (select q.vec_id as query_id, e.vec_id, round(list_dot_product(q.embedding::double[], e.embedding::double[]), 4) as score,
  row_number() over (partition by q.vec_id order by round(list_dot_product(q.embedding::double[], e.embedding::double[]), 4) desc, e.vec_id) as rank
  from embeddings e join (select * from embeddings where vec_id % 50 = 0) q on e.vec_id <> q.vec_id) where rank <= 5""")
def vector_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return embedding.nearest_dense(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", 5)


@query("""with v as (select vec_id, case when vec_id % 7 = 0 then embedding[1:63] when vec_id % 11 = 0 then list_transform(embedding, lambda x: case when x < -0.1 then 'nan'::float else x end) else embedding end as e from embeddings)
select vec_id from v where e is null or len(e) <> 64 or len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) > 0""")
def provider_validation(spark, sf_dir):
    """Vectors of which some were shortened or given components that are no numbers."""
    broken = F.when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 63)).when(F.col("vec_id") % 11 == 0, F.transform("embedding", lambda x: F.when(x < -0.1, float("nan")).otherwise(x).cast("float"))).otherwise(F.col("embedding"))
    return embedding.validate(table(spark, sf_dir, "embeddings").select("vec_id", broken.alias("embedding")), "embedding", 64).select("vec_id")


def _bm25_sql(k: int, prefix: bool, rows: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    match = "starts_with(t.term, w.q)" if prefix else "t.term = w.q"
    return f"""p as (select {key}, term, count(*) as tf from (select {key}, unnest({_TERMS.format(text)}) as term from {rows}) group by all),
w as (select distinct item_id, unnest({_DOC_TOKENS}) as q from benchmark), t as (select distinct term from p), u as (select distinct q from w),
m as (select w.q, t.term from u w join t on {match}), h as (select q, {key}, sum(tf) as tf from p join m using (term) group by all),
len_ as (select {key}, len({_TERMS.format(text)}) as dl from {rows}), g as (select count(*) as n, avg(dl) as avgdl from len_),
d as (select q, count(*) as df from h group by q),
s as (select q, {key}, greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) as s from h join d using (q) join len_ using ({key}), g),
r as (select item_id, {key}, round(sum(s), 6) as score from w join s using (q) group by all),
b as (select *, row_number() over (partition by item_id order by score desc, {key}) as rank from r qualify rank <= {k})"""


@query("with " + _bm25_sql(10, False) + " select item_id, doc_id, score, rank from b")
def bm25_topk(spark, sf_dir):
    return search.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text", 10, prefix=False)


@query("with " + _bm25_sql(10, True) + " select item_id, doc_id, score, rank from b")
def bm25_prefix(spark, sf_dir):
    return search.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text", 10)


def _index(spark: SparkSession, docs: DataFrame) -> postings.Index:
    """An index of documents in the shared folder, in a few buckets even if they are few."""
    with_checkpoints(spark)
    return postings.build(docs, "doc_id", "text", f"{spark.sparkContext.getCheckpointDir()}/index-{uuid.uuid4().hex}", max(4, -(-docs.count() // 20_000)))


@query("with " + _bm25_sql(10, False) + " select item_id, doc_id, score, rank from b")
def bm25_stored_topk(spark, sf_dir):
    """The same from a stored index: blocks of postings by falling bounds."""
    rows, _ = postings.bm25(_index(spark, table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), "item_id", "text", 10, prefix=False)
    return rows.withColumnRenamed("key", "doc_id")


@query("with " + _bm25_sql(10, True) + " select item_id, doc_id, score, rank from b")
def bm25_stored_prefix(spark, sf_dir):
    rows, _ = postings.bm25(_index(spark, table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), "item_id", "text", 10)
    return rows.withColumnRenamed("key", "doc_id")


_KEPT = "select doc_id, case when doc_id % 11 = 0 then text || ' changed words' else text end as text from documents where doc_id % 7 <> 0"


@query(f"with kept as ({_KEPT}) select term, count(distinct doc_id) as df from (select doc_id, unnest({_TERMS.format('text')}) as term from kept) group by term")
def postings_upkeep(spark, sf_dir):
    """How many documents hold each term after two passes over a stored index: some removed and others changed, then more removed and the last ones added."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    now = docs.withColumn("text", F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit(" changed words"))).otherwise(F.col("text")))
    index = _index(spark, docs.where("doc_id % 5 <> 0"))
    index = postings.update(index, now.where("doc_id % 11 = 0 and doc_id % 7 <> 0"), "doc_id", "text", docs.where("doc_id % 14 = 0").select("doc_id"))
    index = postings.update(index, now.where("doc_id % 5 = 0 and doc_id % 7 <> 0"), "doc_id", "text", docs.where("doc_id % 7 = 0").select("doc_id"))
    return postings.frequencies(index)


@query(f"select term, count(distinct doc_id) as df, count(*) as cf from (select doc_id, unnest({_TERMS.format('text')}) as term from documents) group by term")
def doc_frequency_stats(spark, sf_dir):
    return lexical.document_frequency(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"""with q as (select item_id, list_distinct({_DOC_TOKENS}) as t from benchmark)
select item_id, doc_id, share from (select item_id, doc_id, round(len(list_filter(t, lambda x: contains(lower(text), x))) / len(t), 4) as share from documents, q where len(t) > 0) where share > 0.3""")
def lexical_substring_score(spark, sf_dir):
    return search.substring_scores(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text", 0.3)


_SYMBOL = """case when doc_id % 3 <> 0 then (case doc_id % 4 when 0 then 'class:' when 1 then 'function:' when 2 then 'method:' else 'export:' end) || coalesce({0}, 'x') || '_' || coalesce({1}, 'y')
  || case when doc_id % 5 = 0 then '.' || coalesce({2}, 'z') || '.' || coalesce({3}, 'w') else '' end end"""
_CHUNK_SQL = _LINES.format(n=80, step=72) + f""",
ch as (select path || ':' || lpad(start_line::varchar, 9, '0') as cid, path, start_line, end_line, {_SYMBOL.format(*(f"{_DOC_TOKENS}[{i}]" for i in (1, 2, 3, 4)))} as symbol, text from c where text <> '')"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line windows of documents, most with a symbol made of their first tokens."""
    c = chunking.line_windows(_files(spark, sf_dir)).withColumn("__t", T.tokenize(F.col("text")))
    return c.withColumn("symbol", F.expr(_SYMBOL.format(*(f"get(__t, {i})" for i in range(4))))).select("path", "start_line", "end_line", "symbol", "text")


_LABEL = """case when s > 0.8 then 'exact symbol match' when s > 0.55 and l > 0.33 then 'symbol and lexical match' when s > 0.55 then 'symbol match'
  when r > 0.5 and l > 0.33 then 'relationship and lexical match' when l > 0.66 and v > 0.2 then 'lexical and vector match' when l > 0.66 then 'lexical match'
  when v > 0.2 then 'vector similarity' else 'weak combined match' end"""


def _relation_sql() -> str:
    asked = ("len(list_intersect(qs, ['import', 'imports', 'export', 'exports'])) > 0", "len(list_intersect(qs, ['reference', 'references', 'caller', 'callers'])) > 0", "len(list_intersect(qs, ['test', 'tests', 'spec'])) > 0", "(len(list_intersect(qs, ['nearby', 'neighbor'])) > 0 or (list_contains(qs, 'same') and list_contains(qs, 'file')))")
    return " + ".join(f"case when {a} and regexp_matches(' ' || low || ' ', '[^A-Za-z0-9_](?:{names})[^A-Za-z0-9_]') then {worth} else 0 end" for a, (_, names, worth) in zip(asked, search.HINTS))


def _search_ctes(modes: tuple[str, ...], limit: int, chunks: str) -> str:
    """All queries with all chunks (CTE ch): every component in full, then the ranks of each mode, up to top_named."""
    score = {
        "hybrid": "round(vector * 0.55::decimal(3,2) + lexical * 0.30::decimal(3,2) + symbol_score * 0.13::decimal(3,2) + relation * 0.02::decimal(3,2), 4)",
        "vector": "vector", "lexical": "greatest(lexical, round(symbol_score * 0.9::decimal(2,1) + relation * 0.1::decimal(2,1), 4))",
    }
    each = " union all ".join(f"select *, '{m}' as mode, {score[m]}::double as score from z" for m in modes)
    return (
        chunks + ",et as (select cid, path || chr(10) || coalesce(symbol, '') || chr(10) || text as text from ch), hay as (select cid, path || ' ' || coalesce(symbol, '') || ' ' || text as text from ch),"
        + _hashed_sql("e", "et", "cid", 384) + "," + _hashed_sql("qe", "benchmark", "item_id", 384) + "," + _bm25_sql(80, True, "hay", "cid") + ","
        + symbols.symbol_ctes("select cid as k, symbol, text from ch where symbol is not null", "select item_id as qk, text as query from benchmark") + f""",
v as (select item_id, cid, round(sum(qe.v::decimal(9,6) * e.v::decimal(9,6)), 4) as vector from qe join e using (idx) group by all),
x as (select item_id, cid, round(1 - (rank - 1) / count(*) over (partition by item_id), 4) as lex from b),
asked as (select item_id, list_distinct({_DOC_TOKENS}) as qs from benchmark), said as (select cid, lower(hay.text) as hay, lower(coalesce(symbol, '') || ' ' || ch.text) as low from hay join ch using (cid)),
z as (select asked.item_id, ch.cid, path, start_line, end_line, symbol, coalesce(vector, 0)::decimal(10,4) as vector,
  coalesce(lex, case when len(qs) > 0 then round(len(list_filter(qs, lambda t: contains(hay, t))) / len(qs), 4) else 0 end)::decimal(10,4) as lexical,
  coalesce(symbol_score, 0)::decimal(10,4) as symbol_score, round(least(1.0, {_relation_sql()}), 4)::decimal(10,4) as relation
  from asked cross join ch join said on said.cid = ch.cid left join v on v.item_id = asked.item_id and v.cid = ch.cid left join x on x.item_id = asked.item_id and x.cid = ch.cid left join sy on sy.qk = asked.item_id and sy.k = ch.cid),
f as ({each}),
top as (select *, row_number() over (partition by item_id, mode order by score desc, path, start_line, end_line) as rank from f qualify rank <= {limit}),
top_named as (select item_id, mode, rank, path, start_line, end_line, symbol, score, vector::double as vector, lexical::double as lexical, symbol_score::double as symbol_score, relation::double as relation,
  {_LABEL.replace(' s ', ' symbol_score ').replace(' l ', ' lexical ').replace(' r ', ' relation ').replace(' v ', ' vector ')} as why from top)"""
    )


def _search_sql(modes: tuple[str, ...], limit: int) -> str:
    return f"with {_search_ctes(modes, limit, _CHUNK_SQL)} select * from top_named"


@query(_search_sql(("hybrid",), 8))
def flagship_hybrid_search(spark, sf_dir):
    """All benchmark texts as queries over all chunks: vector, lexical, symbol and relation scores, fused."""
    return search.search(_chunks(spark, sf_dir), table(spark, sf_dir, "benchmark"), "item_id", "text")


@query(_search_sql(("lexical", "vector", "hybrid"), 5))
def search_modes(spark, sf_dir):
    return search.search(_chunks(spark, sf_dir), table(spark, sf_dir, "benchmark"), "item_id", "text", 5, ("lexical", "vector", "hybrid"))


_LIKE_SQL = f"""with {_CHUNK_SQL}, q as (select item_id, {_DOC_TOKENS}[1:8] as t from benchmark)
select item_id, path, start_line, end_line, rank from (select item_id, path, start_line, end_line, row_number() over (partition by item_id order by path, start_line, end_line) as rank from q, ch
  where len(list_filter(t, lambda x: ch.text ilike '%' || x || '%' or path ilike '%' || x || '%' or coalesce(symbol, '') ilike '%' || x || '%')) > 0) where rank <= 20"""


@query(_LIKE_SQL)
def lexical_like_fallback(spark, sf_dir):
    return search.contain_any(_chunks(spark, sf_dir), table(spark, sf_dir, "benchmark"), "item_id", "text", 20)


@query(_LIKE_SQL)
def lexical_like_stored(spark, sf_dir):
    """The same from a stored index of trigrams: the first candidates by place are read and tested."""
    with_checkpoints(spark)
    index = grams.build(_chunks(spark, sf_dir), f"{spark.sparkContext.getCheckpointDir()}/grams-{uuid.uuid4().hex}")
    return grams.contain_any(index, table(spark, sf_dir, "benchmark"), "item_id", "text", 20)[0]


_INTENT = " + ".join(
    f"case when regexp_matches(' ' || lower(text) || ' ', '[^A-Za-z0-9_](?:{names})[^A-Za-z0-9_]') then {score} else 0 end"
    for names, score in (("import|export|resolveimport|target", 0.3), ("reference|references|target_symbol|symbol_references", 0.3), ("test|spec|__tests__", 0.2), ("neighbor|same-file|file_path", 0.2))
)


@query(f"select doc_id, round(least(1.0, {_INTENT})::double, 4) as intent from documents")
def relation_intent(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(T.relation_intent(F.col("text")), 4).alias("intent"))


@query(f"select l_returnflag, label, count(*) as n from (select l_returnflag, {_LABEL} as label from (select l_returnflag, l_quantity / 50 as s, l_discount * 10 as l, l_tax * 12 as r, l_linenumber / 7.0 as v from lineitem)) group by all")
def explain_labels(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    label = T.match_label(F.col("l_linenumber") / 7.0, F.col("l_discount") * 10, F.col("l_quantity") / 50, F.col("l_tax") * 12)
    return li.select("l_returnflag", label.alias("label")).groupBy("l_returnflag", "label").agg(F.count(F.lit(1)).alias("n"))


_NORM = r"trim(regexp_replace(lower(regexp_replace({0},'([a-z0-9])([A-Z])','\1 \2','g')),'[^a-z0-9]+',' ','g'))"


@query(f"select p_partkey, {_NORM.format('p_name')} as name, {_NORM.format('p_brand')} as brand, {_NORM.format('p_type')} as type, len({_TOKENS.format('p_brand')}) as n from part")
def camel_normalize(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", T.normalize_symbol(F.col("p_name")).alias("name"), T.normalize_symbol(F.col("p_brand")).alias("brand"), T.normalize_symbol(F.col("p_type")).alias("type"), F.size(T.tokenize(F.col("p_brand"))).alias("n"))


@query(r"""with s as (select p_partkey, 'class:' || replace(p_brand, '#', '.') || '.' || replace(p_name, ' ', '_') as s from part),
t as (select *, regexp_replace(trim(s), '^[A-Za-z]+:', '') as bare from s), u as (select *, string_split(bare, '.')[-1] as last from t)
select p_partkey, array_to_string(list_filter([trim(s), bare, case when last = '' then bare else last end], lambda x: x <> ''), '|') as names from u""")
def symbol_search_names(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    symbol = F.concat(F.lit("class:"), F.replace("p_brand", F.lit("#"), F.lit(".")), F.lit("."), F.replace("p_name", F.lit(" "), F.lit("_")))
    return p.select("p_partkey", F.array_join(T.search_names(symbol), "|").alias("names"))
