"""Queries of places, names, graphs, snapshots, scans and event streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import bundle, chunking, graph, incremental, pairs, relations
from tessera.session import table, with_checkpoints
from tessera.sources import scan
from tessera.streaming import watch

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_PATH = "source || '/' || doc_id || '.txt'"
_REFS = rf"""r as (select distinct path, line, low, unnest(regexp_extract_all(lower(regexp_replace(t, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[a-z_][a-z0-9_]+|[0-9]+')) as name
  from (select {_PATH} as path, unnest(string_split_regex(text, '\r?\n')) as t, generate_subscripts(string_split_regex(text, '\r?\n'), 1) as line, lower(t) as low from documents)),
refs as (select distinct path, name, line::int as line, greatest(0, instr(low, name) - 1)::int as "column" from r)"""


def _files(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text")


@query(f'with {_REFS} select path, line, "column", count(*) as n, min(name) as first_name from refs group by all')
def reference_rows(spark, sf_dir):
    return chunking.token_references(_files(spark, sf_dir)).groupBy("path", "line", "column").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first_name"))


@query(rf"""with l as (select {_PATH} as path, string_split_regex(text, '\r?\n') as lines from documents),
c as (select path, w * 8 + 1 as start_line, least(len(lines), w * 8 + 10) as end_line, regexp_replace(array_to_string(lines[w * 8 + 1 : w * 8 + 10], chr(10)), '^\s+|\s+$', '', 'g') as text
  from (select *, unnest(range(0, 1 + greatest(0, ceil((len(lines) - 10) / 8.0))::bigint)) as w from l)),
{_REFS}, j as (select refs.path, name, line, "column", start_line, end_line, row_number() over (partition by refs.path, name, line, "column" order by end_line - start_line, start_line) as k
  from refs left join (select * from c where text <> '') c on c.path = refs.path and line between start_line and end_line)
select path, start_line::int as start_line, end_line::int as end_line, count(*) as n from j where k = 1 group by all""")
def reference_containing_chunk(spark, sf_dir):
    found = chunking.token_references(_files(spark, sf_dir)).select("path", chunking.window_of(F.col("line"), F.col("n_lines"), 10, 2).alias("w"))
    return found.groupBy("path", F.col("w.start_line").alias("start_line"), F.col("w.end_line").alias("end_line")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {_REFS}, w as (select distinct lower(s_name) as n from supplier union select distinct unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) from benchmark)
select path, name, line, "column" from refs where name in (select n from w)""")
def reference_search(spark, sf_dir):
    wanted = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0))).alias("name")).unionByName(table(spark, sf_dir, "supplier").select(F.lower("s_name").alias("name")))
    return relations.by_any_name(wanted, chunking.token_references(_files(spark, sf_dir)).drop("n_lines"), F.array("name"))


@query("""with w as (select distinct l_returnflag || ':' || p_type as kind, p_name as n from lineitem join part on l_partkey = p_partkey)
select distinct p_partkey, p_name from part where p_name in (select n from w) or 'R:' || p_name in (select kind from w)""")
def definition_lookup_multikey(spark, sf_dir):
    part, li = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    used = li.select("l_partkey", "l_returnflag").distinct().join(part, F.col("l_partkey") == F.col("p_partkey"))
    wanted = used.select(F.explode(F.array("p_name", F.concat("l_returnflag", F.lit(":"), "p_type"))).alias("name"))
    return relations.by_any_name(wanted, part.select("p_partkey", "p_name"), F.array("p_name", F.concat(F.lit("R:"), "p_name")))


@query("""with v as (select o_custkey, arg_max({'k': o_orderkey, 's': o_orderstatus, 'p': o_totalprice}, {'d': o_orderdate, 'k': o_orderkey}) as x from orders group by o_custkey)
select o_custkey, x.k as o_orderkey, x.s as o_orderstatus, x.p as o_totalprice from v""")
def link_last_wins(spark, sf_dir):
    return relations.last_wins(table(spark, sf_dir, "orders"), "o_custkey", F.struct("o_orderdate", "o_orderkey"), "o_orderkey", "o_orderstatus", "o_totalprice")


@query("""select conv_id, turn, near_start, rank from (select a.conv_id, a.turn, b.turn as near_start, row_number() over (partition by a.conv_id, a.turn order by abs(b.turn - a.turn), b.turn) as rank
  from conversations a join conversations b on a.conv_id = b.conv_id and (b.turn < a.turn or b.turn > a.turn)) where rank <= 2""")
def neighbor_chunks(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("turn").alias("end_turn"))
    return relations.neighbours(c, "conv_id", "turn", "end_turn").select("conv_id", "turn", "near_start", "rank")


_SUFFIX = "case page_id % 5 when 0 then '.js' when 1 then '.ts' when 2 then '/index.js' when 3 then '' else '.cjs' end"


@query(rf"""with p as (select page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*/', ''), '[?#].*$', '') as tail from pages), f as (select distinct tail || {_SUFFIX} as path from p),
i as (select distinct 'en/index.js' as importer, './' || regexp_replace(tail, '^[a-z]+/', '') as source from p),
t as (select importer, source, 'en/' || trim(substr(source, 3), '/') as base from i), c as (select *, unnest(['', '.js', '.jsx', '.ts', '.tsx', '.mjs', '.cjs', '/index.js', '/index.ts']) as suffix, unnest(range(9)) as pos from t)
select t.importer, t.source, (select arg_min(base || suffix, pos) from c where c.importer = t.importer and c.source = t.source and base || suffix in (select path from f)) as target from t""")
def import_candidate_resolution(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*/", ""), "[?#].*$", "").alias("tail"))
    files = pages.select(F.concat("tail", F.expr(_SUFFIX)).alias("path")).distinct()
    imports = pages.select(F.lit("en/index.js").alias("importer"), F.concat(F.lit("./"), F.regexp_replace("tail", "^[a-z]+/", "")).alias("source")).distinct()
    return relations.resolve_imports(imports, files)


@query("""with c as (select distinct l_suppkey as path, (l_partkey % 500)::int as start_line, (l_partkey % 500 + l_quantity * 3)::int as end_line from lineitem),
r as (select distinct l_suppkey as path, (l_orderkey % 700)::int as line from lineitem)
select r.path, r.line, m.c.s as start_line, m.c.e as end_line from r left join (select r.path, r.line, min({'n': end_line - start_line, 's': start_line, 'e': end_line}) as c from r join c on c.path = r.path and r.line between start_line and end_line group by all) m on m.path = r.path and m.line = r.line""")
def innermost_intervals(spark, sf_dir):
    """Each line of a supplier with the smallest of its intervals around it, over all line items."""
    li = table(spark, sf_dir, "lineitem")
    start = (F.col("l_partkey") % 500).cast("int")
    chunks = li.select(F.col("l_suppkey").alias("path"), start.alias("start_line"), (start + F.col("l_quantity") * 3).cast("int").alias("end_line"))
    lines = li.select(F.col("l_suppkey").alias("path"), (F.col("l_orderkey") % 700).cast("int").alias("line")).distinct()
    return relations.innermost(lines, chunks)


_EDGES = """d as (select s_nationkey::varchar as file, s_suppkey::varchar as name, 'function:' || s_suppkey as symbol, s_suppkey::int as line, (s_suppkey + 3)::int as end_line, s_acctbal > 5000 as exported from supplier),
r as (select distinct s_nationkey::varchar as file, (l_partkey % 120)::varchar as name, (l_partkey % 100)::int as line from lineitem join supplier on l_suppkey = s_suppkey),
i as (select s_nationkey::varchar as file, (s_suppkey + 1)::varchar as local_name, case when s_suppkey % 3 = 0 then 'default' else 'imported' || s_suppkey end as imported_name, (s_suppkey % 100)::int as line from supplier),
o as (select file, name, arg_max(symbol, {'l': line, 's': symbol}) as own from d group by all),
m as (select file, local_name as name, arg_max({'n': imported_name, 'at': line}, {'l': line, 'n': imported_name}) as im from i group by all),
t as (select r.*, coalesce(own, case when im.n in ('default', '*') then r.name else im.n end) as target from r left join o using (file, name) left join m using (file, name) where im is null or im.at <> r.line),
u as (select t.*, (select min({'n': end_line - d.line, 'l': d.line, 'c': symbol}) from d where d.file = t.file and t.line between d.line and d.end_line).c as container from t where target is not null)"""


@query(f"""with {_EDGES} select edge_type, count(*) as n, count(distinct file) as files from (
  select 'file_defines_symbol' as edge_type, file from d union all select 'file_exports_symbol', file from d where exported
  union all select 'symbol_references_symbol', file from u where container is not null and container <> target union all select 'symbol_referenced_in_file', file from u) group by all""")
def graph_edges_by_type(spark, sf_dir):
    s, li = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "lineitem")
    text = lambda c: F.col(c).cast("string")
    d = s.select(text("s_nationkey").alias("file"), text("s_suppkey").alias("name"), F.concat(F.lit("function:"), text("s_suppkey")).alias("symbol"), F.col("s_suppkey").cast("int").alias("line"), (F.col("s_suppkey") + 3).cast("int").alias("end_line"), (F.col("s_acctbal") > 5000).alias("exported"))
    r = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(text("s_nationkey").alias("file"), (F.col("l_partkey") % 120).cast("string").alias("name"), (F.col("l_partkey") % 100).cast("int").alias("line")).distinct()
    i = s.select(text("s_nationkey").alias("file"), (F.col("s_suppkey") + 1).cast("string").alias("local_name"), F.when(F.col("s_suppkey") % 3 == 0, "default").otherwise(F.concat(F.lit("imported"), text("s_suppkey"))).alias("imported_name"), (F.col("s_suppkey") % 100).cast("int").alias("line"))
    e = graph.edges(d, r, i)
    return e.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.coalesce("source_file", "target_file")).alias("files"))


@query("""with u as (select distinct l_partkey as symbol, l_suppkey as file from lineitem),
c as (select a.symbol as seed, b.symbol as other, count(*) as files from u a join u b using (file) where a.symbol <> b.symbol group by all)
select seed, other, files, rank from (select *, row_number() over (partition by seed order by files desc, other) as rank from c) where rank <= 12""")
def graph_two_hop(spark, sf_dir):
    """From every part over the suppliers that ship it to their other parts."""
    uses = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("symbol"), F.col("l_suppkey").alias("file")).distinct()
    return graph.two_hops(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seed")), uses)


_ROLE = "case l_linenumber when 1 then 'seed' when 2 then 'definition' when 3 then 'call-usage' when 4 then 'import-export' else 'test' end"


@query(f"""with h as (select l_suppkey as query, l_partkey as id, {_ROLE} as role, l_extendedprice as score, l_orderkey as related_rank from lineitem),
p as (select *, case role when 'seed' then 50 when 'definition' then 40 when 'call-usage' then 35 when 'import-export' then 20 else 12 end as pr from h),
k as (select * from p qualify row_number() over (partition by query, id order by pr desc, score desc, related_rank) = 1)
select query, id, role, score, place from (select *, row_number() over (partition by query order by pr desc, score desc, related_rank, id) as place from k) where place <= 24""")
def graph_expansion_dedupe(spark, sf_dir):
    role = F.expr(_ROLE)
    hits = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("query"), F.col("l_partkey").alias("id"), role.alias("role"), F.col("l_extendedprice").alias("score"), F.col("l_orderkey").alias("related_rank"))
    return graph.expand(hits, 8).select("query", "id", "role", "score", "place")


@query(f"""with i as (select source, doc_id, length('# ' || {_PATH}) as h, length(text) as s from documents),
r as (select *, 12000 - coalesce(sum(h + s + 2) over w, 0) - h - 24 as room from i window w as (partition by source order by doc_id rows between unbounded preceding and 1 preceding)),
o as (select *, coalesce(min(case when room > 0 and s <= room then 1 else 0 end) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 1) as open from r)
select source, doc_id, not (s <= room) as cut, (h + case when s <= room then s else greatest(0, room - 15) + 15 end)::bigint as used from o where open = 1 and room > 0""")
def bundle_pack(spark, sf_dir):
    header = F.concat(F.lit("# "), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    items = table(spark, sf_dir, "documents").select("source", "doc_id", F.length(header).alias("head"), F.length("text").alias("size"))
    return bundle.pack(items, "source", ["doc_id"], F.col("head"), F.col("size"), 12_000).select("source", "doc_id", "cut", "used")


@query("""with e as (select item_id, doc_id from benchmark b join documents d on contains(d.text, b.text)),
r as (select item_id, doc_id, row_number() over (partition by item_id order by hash_rank, doc_id) as rank from (select item_id, doc_id, (doc_id * 7919 + item_id * 104729) % 1009 as hash_rank from benchmark, documents)),
p as (select item_id, sum(case when rank <= 300 then 1 else 0 end) / count(*) as recall, 1 / min(rank) as rr from e join r using (item_id, doc_id) group by item_id)
select count(*) as n, round(avg(round(recall, 4)), 4) as recall, round(avg(round(rr, 4)), 4) as mrr from p""")
def eval_recall_mrr(spark, sf_dir):
    """A made ranking against the documents that hold a benchmark text.

    Ranks are counted for expected pairs alone: rows of smaller hashes from a table of their counts, equal ones by their order.
    """
    from pyspark.sql import Window

    b = table(spark, sf_dir, "benchmark").withColumnRenamed("text", "passage")
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    expected = pairs.holding(d, "doc_id", "text", b, "item_id", "passage").select("item_id", "doc_id").distinct()
    hashed = d.select("doc_id", (F.col("doc_id") * 7919 % 1009).alias("h"))
    order = hashed.withColumn("place", F.row_number().over(Window.partitionBy("h").orderBy("doc_id")))
    counts = hashed.groupBy("h").agg(F.count(F.lit(1)).alias("n"))  # 1009 rows at most
    shift = F.col("item_id") * 104729
    wanted = expected.join(order, "doc_id").withColumn("own", (F.col("h") + shift) % 1009)
    less = wanted.join(F.broadcast(counts.withColumnRenamed("h", "other")), (F.col("other") + shift) % 1009 < F.col("own"), "left")
    ranked = less.groupBy("item_id", "doc_id", "place").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("before")).select("item_id", "doc_id", (F.col("before") + F.col("place")).alias("rank"))
    return bundle.means(bundle.evaluate(ranked, expected, "item_id", "doc_id", 300))


def _snapshots(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("hash"))
    return d.where("doc_id % 5 <> 0"), d.where("doc_id % 7 <> 0").withColumn("hash", F.when(F.col("doc_id") % 11 == 0, F.lit("new")).otherwise(F.col("hash")))


_SNAP = "a as (select doc_id, md5(text) as hash from documents where doc_id % 5 <> 0), b as (select doc_id, case when doc_id % 11 = 0 then 'new' else md5(text) end as hash from documents where doc_id % 7 <> 0)"


@query(f"with {_SNAP} select doc_id, case when a.hash is null then 'added' when b.hash is null then 'removed' when a.hash = b.hash then 'unchanged' else 'changed' end as change from a full join b using (doc_id)")
def incremental_diff(spark, sf_dir):
    return incremental.diff(*_snapshots(spark, sf_dir), "doc_id")


@query(f"with {_SNAP} select doc_id, hash from a where doc_id not in (select doc_id from b)")
def removed_files(spark, sf_dir):
    return incremental.removed(*_snapshots(spark, sf_dir), "doc_id")


@query(f"with {_SNAP} select doc_id, hash from a where doc_id not in (select doc_id from b) union all select doc_id, hash from b")
def upsert_snapshot(spark, sf_dir):
    return incremental.upsert(*_snapshots(spark, sf_dir), "doc_id")


_URLPATH = r"regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[#?].*$', '')"


_PAGES = f"f as (select page_id, {_URLPATH} as path, length(html) as size, contains(html, 'ad 3') as bin from pages)"


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[#?].*$", "").alias("path"), F.length("html").alias("size"), F.contains("html", F.lit("ad 3")).alias("binary"))


@query(f"""with {_PAGES} select page_id, case when regexp_matches(path, '(^|/)(fr|es)(/|$)') and not regexp_matches(path, '(^|/)[^/]*7(/|$)') then 'gitignore' when regexp_matches(path, '(^|/)(fr|es)/.') then 'gitignore' when regexp_matches(path, '(^|/)[^/]*1(/|$)') then 'cli-exclude'
  when size > 1048576 then 'too-large' when bin then 'binary' when regexp_matches(path, '(^|/)[^/]*7(/|$)') then 'included-by-gitignore-negation' else 'included' end as reason from f""")
def gitignore_last_match(spark, sf_dir):
    """A negation doesn't bring back what lies in an ignored folder."""
    rules = [scan.Rule.parse(x) for x in ("fr", "es", "!*7")]
    return scan.decide(_pages(spark, sf_dir), rules, exclude=("*1",)).select("page_id", "reason")


@query(f"""with {_PAGES}, g as (select *, string_split(path, '/') as parts from f), t as (select *, unnest(range(1, len(parts) + 1)) as i from g),
rules(level, line, negated, re) as (values (0, 0, false, '(^|/)[^/]*3(/|$)'), (0, 1, true, '(^|/)[^/]*9(/|$)'), (1, 1, true, '(^|/)[^/]*3(/|$)'), (1, 2, false, '(^|/)[^/]*5(/|$)'), (1, 3, true, '(^|/)[^/]*9(/|$)'), (1, 4, false, '(^|/)fr(/|$)')),
m as (select page_id, i, i = len(parts) as own, arg_max(negated, level * 100 + line) as negated from t join rules on regexp_matches(array_to_string(parts[1 + level : i], '/'), re) and level < i and (level = 0 or parts[1] like '%2%') group by all),
v as (select page_id, bool_or(not own and not negated) as pruned, max(case when own then negated end) as negated from m group by page_id)
select starts_with(reason, 'included') as included, reason, count(*) as n, sum(size)::bigint as bytes from (select size, case when coalesce(pruned, false) or negated = false then 'gitignore' when size > 1048576 then 'too-large' when bin then 'binary'
  when negated then 'included-by-gitignore-negation' else 'included' end as reason from f left join v using (page_id)) group by all""")
def scan_diagnostics(spark, sf_dir):
    """Ignore files at the top and in some hosts' folders; the deeper and later rule speaks."""
    pages = _pages(spark, sf_dir).drop("page_id")
    hosts = pages.select(F.substring_index("path", "/", 1).alias("base")).distinct()
    own = hosts.where("base like '%2%'").withColumn("text", F.lit("# own rules\n!*3\n*5\n!*9\nfr/\n"))
    top = hosts.agg(F.lit("").alias("base"), F.lit("*3\n!*9\n\n").alias("text"))
    return scan.diagnostics(scan.decide_nested(pages, scan.load_rules(top.unionByName(own))))


@query(f"""with f as (select {_URLPATH} as path, length(html) as size, contains(html, 'ad 3') as bin from pages), g as (select *, regexp_extract(path, '^(.*)/[^/]*$', 1) as dir from f)
select reason, count(*) as n from (select case when regexp_matches(path, '(^|/)fr(/|$)') then 'gitignore' when regexp_matches(path, '(^|/)[^/]*1(/|$)') then 'cli-exclude'
  when not regexp_matches(path, '(^|/)[^/]*[.]com(/|$)') then 'cli-include-filter' when size > 1048576 then 'too-large' when bin then 'binary' else 'included-by-include' end as reason from g) group by reason""")
def scan_decisions(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[#?].*$", "").alias("path"), F.length("html").alias("size"), F.contains("html", F.lit("ad 3")).alias("binary"))
    decided = scan.decide(p, [scan.Rule.parse("fr/")], include=("*.com",), exclude=("*1",))
    return decided.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(r"select page_id, regexp_matches(url, '^https://[^/]*[.]example[.]com/.*$') as deep, regexp_matches(url, '^[^/]*:[/][/].*/[^/][^/][^/]*$') as one from pages")
def glob_filter(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.col("url").rlike(f"^{scan.glob_regex('https://*.example.com/**')}$").alias("deep"), F.col("url").rlike(f"^{scan.glob_regex('*://**/??*')}$").alias("one"))


@query("""select page_id, case lower(regexp_extract(url, '[.][^.]+$')) when '.js' then 'javascript' when '.py' then 'python' when '.md' then 'markdown' when '.html' then 'html' when '.json' then 'json' else 'text' end as language
  from (select page_id, regexp_replace(url, '[?#/].*$', '') || case page_id % 6 when 0 then '.js' when 1 then '.PY' when 2 then '.md' when 3 then '.html' when 4 then '.json' else '' end as url from pages)""")
def language_for_path(spark, sf_dir):
    end = F.expr("case page_id % 6 when 0 then '.js' when 1 then '.PY' when 2 then '.md' when 3 then '.html' when 4 then '.json' else '' end")
    return table(spark, sf_dir, "pages").select("page_id", T.language_of(F.concat(F.regexp_replace("url", "[?#/].*$", ""), end)).alias("language"))


@query("select doc_id, strlen(text) > 20000 as large, (doc_id % 9 = 0 and strlen(text) < 8000) as binary from documents")
def binary_size_filter(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    content = F.concat(F.encode("text", "UTF-8"), F.when(F.col("doc_id") % 9 == 0, F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit(""))))
    return d.select("doc_id", (F.octet_length("text") > 20_000).alias("large"), scan.looks_binary(content).alias("binary"))


@query(f"""with {_SNAP}, x as (select doc_id, case when a.hash is null then 'added' when b.hash is null then 'removed' when a.hash = b.hash then 'unchanged' else 'changed' end as change from a full join b using (doc_id)),
c as (select d.doc_id, len(string_split_regex(text, '\\r?\\n')) as n from documents d), k as (select doc_id, (1 + greatest(0, ceil((n - 10) / 8.0)))::bigint as n from c)
select (select count(*) from x where change in ('added', 'changed')) as indexed, (select count(*) from x where change = 'unchanged') as skipped, (select count(*) from x where change = 'removed') as removed,
  (select sum(n)::bigint from k join x using (doc_id) where change in ('added', 'changed')) as new_windows, (select sum(n)::bigint from k join x using (doc_id) where change <> 'removed') as windows,
  (select count(*) from b) as files, '{{"key":"hashes","value":"2"}}' as meta""")
def incremental_pass(spark, sf_dir):
    """Changed files' windows are made anew, those of missing ones go; counters and the tables' sizes."""
    with_checkpoints(spark)
    stored, scanned = _snapshots(spark, sf_dir)
    texts = table(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", "\r?\n", -1)).alias("lines"))
    last = lambda n: F.greatest(F.lit(0), F.ceil((n - 10) / 8)).cast("int")
    build = lambda files: {"windows": files.select("doc_id").join(texts, "doc_id").select("doc_id", F.explode(F.sequence(F.lit(0), last(F.col("lines")))).alias("k"))}
    done = incremental.index_pass(stored, build(stored), scanned, build, "doc_id")
    meta = incremental.set_meta(spark.createDataFrame([("hashes", "1")], "key string, value string"), {"hashes": "2"})
    now = incremental.status({"windows": done.children["windows"], "files": done.files}, meta).drop("meta")
    return done.counters.crossJoin(F.broadcast(now)).crossJoin(F.broadcast(incremental.as_json(meta).withColumnRenamed("json", "meta")))


@query("select 'documents' as name, count(*) as n from documents union all select 'pages', count(*) from pages union all select 'lineitem', count(*) from lineitem union all select 'events', count(*) from events")
def status_counts(spark, sf_dir):
    from functools import reduce

    counts = [table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n") for t in ("documents", "pages", "lineitem", "events")]
    return reduce(lambda a, b: a.unionByName(b), counts)


@query("select l_returnflag, l_linestatus, count(*) as n from lineitem group by all")
def edges_group_count(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("""with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts, event_id) >= interval 30 minute then 1 else 0 end as b from events),
g as (select user_id, ts, sum(b) over (partition by user_id order by ts rows unbounded preceding) as k from e)
select user_id, min(ts) as start, max(ts) + interval 30 minute as "end", count(*) as n from g group by user_id, k""")
def debounce_sessions(spark, sf_dir):
    return watch.bursts(table(spark, sf_dir, "events"), "user_id", "ts", "30 minutes")


@query("""select event_id, burst from (select event_id, sum(b) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint as burst
  from (select *, coalesce((ts - lag(ts) over (partition by user_id order by ts, event_id) >= interval 10 minute)::int, 0) as b from events))""")
def burst_numbers(spark, sf_dir):
    return watch.burst_rows(table(spark, sf_dir, "events"), "user_id", "ts", 600, "event_id").select("event_id", "burst")


@query("select time_bucket(interval 5 minute, ts) as start, count(*) as n, arg_max(event_type, {'t': ts, 'e': event_id}) as reason from events group by 1")
def coalesced_microbatches(spark, sf_dir):
    return watch.coalesced(table(spark, sf_dir, "events"), "ts", "5 minutes", "event_type", "event_id")


@query("select event_id, (user_id % 5 = 0 or event_type = 'error') as ignored from events")
def watch_event_filter(spark, sf_dir):
    folder = F.when(F.col("user_id") % 5 == 0, "node_modules").otherwise("src")
    path = F.when(F.col("event_type") == "error", "state.db-wal").otherwise(F.concat(folder, F.lit("/"), "event_type"))
    return table(spark, sf_dir, "events").select("event_id", scan.ignored_event(path, "state.db").alias("ignored"))
