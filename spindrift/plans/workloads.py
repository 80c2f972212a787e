"""The engine's queries over the driver's tables, each beside the SQL that checks it."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strings
from ..operators import context, diff, extract, graph, lookup, resolve, search, spans, upkeep
from ..sources import repository, scratch
from ..sources.scratch import written
from . import index
from .tables import EDGES, IMPORTS, QUALIFIER, REFS, SPANS, SYMBOLS, listed, table, view

NAME, SERVICE = "blue gear", "s3"
BAND = 512
SYMBOLS_SQL = f"symbols AS (SELECT {listed(SYMBOLS)} FROM part)"
EDGES_SQL = f"edges AS (SELECT {listed(EDGES)} FROM lineitem)"
SPANS_SQL = f"spans AS (SELECT {listed(SPANS)} FROM events)"
#: A part leads to the part on the next line of its order.
STEPS_SQL = "steps AS (SELECT l_partkey AS src_symbol, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS dst_symbol FROM lineitem), links AS (SELECT src_symbol, dst_symbol FROM steps WHERE dst_symbol IS NOT NULL)"

symbols = partial(view, name="part", columns=SYMBOLS)
edges = partial(view, name="lineitem", columns=EDGES)
span_rows = partial(view, name="events", columns=SPANS)


def steps(spark: SparkSession, d: str) -> DataFrame:
    out = "lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)"
    return table(spark, d, "lineitem").selectExpr("l_partkey AS src_symbol", f"{out} AS dst_symbol").where("dst_symbol is not null")


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


# lookups


@query(
    """SELECT n_name AS name, r_name AS stack, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS files,
    coalesce((SELECT min(s_name) FROM supplier WHERE s_nationkey = n_nationkey), '-') AS entrypoint
    FROM nation LEFT JOIN region ON n_regionkey = r_regionkey"""
)
def service_map(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.array(F.min("s_name")).alias("entrypoints"))
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    services = nations.join(first, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("n_nationkey", F.col("n_name").alias("name"), F.col("r_name").alias("stack"), "entrypoints")
    named = services.select("n_nationkey", F.col("name").alias("service"))
    files = table(spark, d, "customer").join(named, F.col("c_nationkey") == F.col("n_nationkey")).select("service")
    return lookup.service_map(services, files)


@query(f"WITH {SYMBOLS_SQL} SELECT id, name, qualified_name, kind, file, start_line, service FROM symbols WHERE (name = '{NAME}' OR qualified_name = '{NAME}') AND kind IN ('function', 'fn', 'def', 'method')")
def def_lookup(spark: SparkSession, d: str) -> DataFrame:
    return lookup.definitions(symbols(spark, d), name=NAME, kind="function").select("id", "name", "qualified_name", "kind", "file", "start_line", "service")


@query(f"WITH {SYMBOLS_SQL} SELECT id, name, file FROM symbols WHERE name = '{NAME}' AND (file = 'F1_.RS' OR file ILIKE '%/F1_.RS')")
def def_in_file(spark: SparkSession, d: str) -> DataFrame:
    """A file selector: a suffix after a slash, any case, with wildcards."""
    return lookup.definitions(symbols(spark, d), name=NAME, file="F1_.RS").select("id", "name", "file")


_OUTLINE = f"WITH {SYMBOLS_SQL}, tiers AS (SELECT id, name, file, start_line, CASE WHEN file = '{{0}}' THEN 0 WHEN file ILIKE '%{{0}}' THEN 1 END AS tier FROM symbols) SELECT id, name, file, start_line FROM tiers WHERE tier = (SELECT min(tier) FROM tiers)"


@query(_OUTLINE.format("src/f7.rs"))
def outline_file(spark: SparkSession, d: str) -> DataFrame:
    return lookup.outline(symbols(spark, d), "src/f7.rs").select("id", "name", "file", "start_line")


@query(_OUTLINE.format("7.rs"))
def outline_suffix(spark: SparkSession, d: str) -> DataFrame:
    return lookup.outline(symbols(spark, d), "7.rs").select("id", "name", "file", "start_line")


_NEAR = f"WITH {SYMBOLS_SQL}, {EDGES_SQL} SELECT DISTINCT s.id, s.name, s.file, e.kind AS edge_kind FROM edges e JOIN symbols d ON d.id = e.{{0}} JOIN symbols s ON s.id = e.{{1}} WHERE d.name = '{NAME}' AND d.service = '{SERVICE}'"


@query(_NEAR.format("dst_symbol", "src_symbol"))
def callers(spark: SparkSession, d: str) -> DataFrame:
    return lookup.neighbours(symbols(spark, d), edges(spark, d), "callers", name=NAME, service=SERVICE).select("id", "name", "file", "edge_kind")


@query(_NEAR.format("src_symbol", "dst_symbol").rpartition(" AND ")[0])
def callees(spark: SparkSession, d: str) -> DataFrame:
    return lookup.neighbours(symbols(spark, d), edges(spark, d), "callees", name=NAME).select("id", "name", "file", "edge_kind")


@query(
    """WITH paths AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages),
    prefixes AS (SELECT DISTINCT regexp_extract(path, '^[^/]+') AS prefix FROM paths UNION SELECT DISTINCT concat(regexp_extract(path, '^[^/]+'), '/en') FROM paths UNION SELECT '.')
    SELECT page_id, p.path, (SELECT concat('svc:', prefix) FROM prefixes WHERE prefix = '.' OR p.path = prefix OR starts_with(p.path, concat(prefix, '/')) ORDER BY CASE WHEN prefix = '.' THEN 0 ELSE length(prefix) END DESC LIMIT 1) AS service FROM paths p"""
)
def service_prefix(spark: SparkSession, d: str) -> DataFrame:
    paths = table(spark, d, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("path"))
    host = F.regexp_extract("path", "^[^/]+", 0)
    prefixes = paths.select(host.alias("path")).union(paths.select(F.concat(host, F.lit("/en")).alias("path"))).distinct().union(spark.range(1).select(F.lit(".").alias("path")))
    named = prefixes.select("path", F.concat(F.lit("svc:"), "path").alias("name"))
    return lookup.owning_service(paths, named).select("page_id", "path", "service")


@query("SELECT source, lang FROM (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang DESC) AS r FROM documents GROUP BY source, lang) WHERE r = 1")
def dominant_stack(spark: SparkSession, d: str) -> DataFrame:
    return lookup.dominant(table(spark, d, "documents"), "source", "lang")


# spans


@query(
    f"""WITH {SPANS_SQL} SELECT s.file, s.id, (SELECT arg_min(o.id, (o.end_line - o.start_line) * 1000000000 + o.id) FROM spans o
    WHERE o.file = s.file AND o.id <> s.id AND o.start_line <= s.start_line AND o.end_line >= s.end_line) AS enclosing FROM spans s"""
)
def enclosing_span(spark: SparkSession, d: str) -> DataFrame:
    return spans.enclosing(span_rows(spark, d), band=BAND)


@query(
    f"""WITH {SPANS_SQL}, around AS (SELECT s.file, s.id, o.name AS o_name, o.end_line - o.start_line AS size, o.id AS o_id FROM spans s JOIN spans o ON o.file = s.file
    AND o.start_line <= s.start_line AND o.end_line >= s.end_line AND (o.start_line < s.start_line OR o.end_line > s.end_line)),
    chain AS (SELECT file, id, string_agg(o_name, '::' ORDER BY size DESC, o_id DESC) AS above, arg_min(o_name, size * 1000000000 + o_id) AS container FROM around GROUP BY file, id)
    SELECT s.file, s.id, c.container, concat(CASE WHEN c.above IS NULL THEN '' ELSE concat(c.above, '::') END, s.name) AS qualified_name FROM spans s LEFT JOIN chain c ON c.file = s.file AND c.id = s.id"""
)
def lexical_identity(spark: SparkSession, d: str) -> DataFrame:
    return spans.lexical_identity(span_rows(spark, d), band=BAND).select("file", "id", "container", "qualified_name")


_REFS_AT = "SELECT user_id AS file, event_id AS ref_id, event_id + 7 AS line, CASE WHEN event_id % 2 = 0 THEN 'call' ELSE 'import' END AS kind FROM events"


@query(
    f"""WITH {SPANS_SQL}, refs AS ({_REFS_AT}) SELECT file, ref_id, owner FROM (SELECT r.file, r.ref_id, (SELECT arg_min(o.id, (CASE WHEN r.kind = 'call' AND o.kind IN ('fn', 'def', 'method', 'function') THEN 0 ELSE 1 END) * 100000000000000
    + (o.end_line - o.start_line) * 1000000000 + o.id) FROM spans o WHERE o.file = r.file AND o.start_line <= r.line AND o.end_line >= r.line) AS owner FROM refs r) WHERE owner IS NOT NULL"""
)
def edge_owner(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "events").selectExpr("user_id AS file", "event_id AS ref_id", "event_id + 7 AS line", "CASE WHEN event_id % 2 = 0 THEN 'call' ELSE 'import' END AS kind")
    return spans.edge_owners(span_rows(spark, d), refs, band=BAND).select("file", "ref_id", "owner")


@query(
    f"""WITH {SPANS_SQL} SELECT s.file, s.id, s.is_test OR EXISTS (SELECT 1 FROM spans o WHERE o.file = s.file AND o.is_test AND o.start_line <= s.start_line AND o.end_line >= s.end_line
    AND (o.start_line < s.start_line OR o.end_line > s.end_line)) AS is_test FROM spans s"""
)
def test_flags(spark: SparkSession, d: str) -> DataFrame:
    return spans.inherited_flags(span_rows(spark, d), band=BAND).select("file", "id", "is_test")


_LINES_SQL = "lines AS (SELECT doc_id AS file, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents), n AS (SELECT file, count(*) AS n FROM lines GROUP BY file)"
_BODIES_SQL = "bodies AS (SELECT file, 0 AS id, 1 AS start_line, greatest(1, n - 1) AS end_line FROM n UNION ALL SELECT file, 1, 2, 2 + n // 3 FROM n WHERE n >= 4)"
_HASH_SQL = "sha1(encode(concat('blob ', strlen(body))) || '\\x00'::BLOB || encode(body))"


def _lines(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("file"), F.split("text", "\n", -1).alias("t"))
    lines = docs.select("file", F.posexplode("t").alias("line", "text")).withColumn("line", F.col("line") + 1)
    n = F.size("t")
    span = lambda i, a, b: F.struct(F.lit(i).alias("id"), a.alias("start_line"), b.alias("end_line"))
    outer, inner = span(0, F.lit(1), F.greatest(F.lit(1), n - 1)), span(1, F.lit(2), (2 + F.floor(n / 3)).cast("int"))
    bodies = docs.select("file", F.explode(F.when(n >= 4, F.array(outer, inner)).otherwise(F.array(outer))).alias("s")).select("file", "s.*")
    return lines, bodies


@query(
    f"""WITH {_LINES_SQL}, {_BODIES_SQL}, own AS (SELECT b.file, b.id, l.line, l.text FROM bodies b JOIN lines l ON l.file = b.file AND l.line BETWEEN b.start_line AND b.end_line
    WHERE NOT EXISTS (SELECT 1 FROM bodies o WHERE o.file = b.file AND l.line BETWEEN o.start_line AND o.end_line AND (o.start_line > b.start_line OR o.end_line < b.end_line))),
    joined AS (SELECT file, id, string_agg(text, chr(10) ORDER BY line) AS body FROM own GROUP BY file, id) SELECT file AS doc_id, id, {_HASH_SQL} AS hash FROM joined"""
)
def body_hash(spark: SparkSession, d: str) -> DataFrame:
    lines, bodies = _lines(spark, d)
    return spans.text_hash(spans.own_lines(lines, bodies), "file", "id").withColumnRenamed("file", "doc_id")


@query(
    f"""WITH {_LINES_SQL}, {_BODIES_SQL}, bare AS (SELECT * FROM lines l WHERE NOT EXISTS (SELECT 1 FROM bodies b WHERE b.file = l.file AND l.line BETWEEN b.start_line AND b.end_line)),
    joined AS (SELECT file, string_agg(text, chr(10) ORDER BY line) AS body FROM bare GROUP BY file) SELECT file AS doc_id, {_HASH_SQL} AS hash FROM joined"""
)
def outside_hash(spark: SparkSession, d: str) -> DataFrame:
    lines, bodies = _lines(spark, d)
    return spans.text_hash(spans.outside_lines(lines, bodies), "file").withColumnRenamed("file", "doc_id")


# resolution

_TIERS = [
    ("qualifier IS NOT NULL", "s.container = r.qualifier AND s.file = src.file", False),
    ("qualifier IS NOT NULL", "s.container = r.qualifier AND s.service = src.service", False),
    ("imported", "s.container = r.qualifier", False),
    ("(scoped OR imported)", "s.container IS NULL AND s.module = r.qualifier AND s.service = src.service", True),
    ("imported", "s.container IS NULL AND s.module = r.qualifier", True),
    ("qualifier IS NULL", "s.file = src.file AND s.container IS NOT DISTINCT FROM src.container", False),
    ("qualifier IS NULL", "s.file = src.file", True),
    ("qualifier IS NULL", "s.service = src.service", True),
    ("qualifier IS NULL AND imported", "true", True),
]
_PICK = ", ".join(f"min(s.id) FILTER (WHERE {fit}) AS a{n}, count(*) FILTER (WHERE {fit}) AS n{n}" for n, (_, fit, _) in enumerate(_TIERS))
_FIRST = "coalesce(" + ", ".join(f"CASE WHEN {'r.' + when if not when.startswith('(') else when} {'AND n' + str(n) + ' = 1' if alone else ''} THEN a{n} END" for n, (when, _, alone) in enumerate(_TIERS)) + ")"
_REFS_SQL = f"""raw AS (SELECT {listed(REFS)} FROM lineitem), refs AS (SELECT src_symbol, p_name AS dst_name, {QUALIFIER} AS qualifier, scoped, raw.kind FROM raw JOIN part ON p_partkey = target),
    imports AS (SELECT DISTINCT {listed(IMPORTS)} FROM part)"""


@query(
    f"""WITH {SYMBOLS_SQL}, {_REFS_SQL},
    asked AS (SELECT DISTINCT r.src_symbol, r.dst_name, r.qualifier, r.scoped, r.kind, EXISTS (SELECT 1 FROM imports i JOIN symbols src ON src.id = r.src_symbol WHERE i.file = src.file AND i.name = coalesce(r.qualifier, r.dst_name)) AS imported FROM refs r),
    cand AS (SELECT r.*, {_PICK} FROM asked r JOIN symbols src ON src.id = r.src_symbol JOIN symbols s ON s.name = r.dst_name AND s.id <> r.src_symbol GROUP BY ALL),
    found AS (SELECT src_symbol, dst_name, qualifier, scoped, kind, {_FIRST} AS dst_symbol FROM cand r)
    SELECT r.src_symbol, f.dst_symbol, r.kind, count(*) AS edges FROM refs r JOIN found f ON f.src_symbol = r.src_symbol AND f.dst_name = r.dst_name AND f.qualifier IS NOT DISTINCT FROM r.qualifier AND f.scoped = r.scoped AND f.kind = r.kind
    WHERE f.dst_symbol IS NOT NULL GROUP BY ALL"""
)
def resolve_refs(spark: SparkSession, d: str) -> DataFrame:
    raw = view(spark, d, "lineitem", REFS)
    target = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    refs = raw.join(target, F.col("target") == F.col("p_partkey")).selectExpr("src_symbol", "p_name AS dst_name", f"{QUALIFIER} AS qualifier", "scoped", "kind")
    imports = view(spark, d, "part", IMPORTS).distinct()
    return resolve.resolve(refs, symbols(spark, d), imports).groupBy("src_symbol", "dst_symbol", "kind").agg(F.count("*").alias("edges"))


# graph

ROUNDS = 12


def _pagerank_sql(rounds: int) -> str:
    out = [
        f"{STEPS_SQL}, nodes AS (SELECT p_partkey AS id FROM part), size AS (SELECT count(*)::DOUBLE AS n FROM nodes), outs AS (SELECT src_symbol, count(*)::DOUBLE AS o FROM links GROUP BY 1)",
        "r0 AS MATERIALIZED (SELECT id, 1.0 / n AS rank FROM nodes, size)",
    ]
    for k in range(rounds):
        out.append(
            f"""r{k + 1} AS MATERIALIZED (SELECT nodes.id, 0.15 / n + 0.85 * (coalesce(v.votes, 0) + coalesce((SELECT sum(rank) FROM r{k} WHERE id NOT IN (SELECT src_symbol FROM outs)), 0) / n) AS rank
            FROM size, nodes LEFT JOIN (SELECT dst_symbol, sum(rank / o) AS votes FROM links JOIN r{k} ON r{k}.id = links.src_symbol JOIN outs ON outs.src_symbol = links.src_symbol GROUP BY 1) v ON v.dst_symbol = nodes.id)"""
        )
    return "WITH " + ", ".join(out)


@query(
    f"""{_pagerank_sql(ROUNDS)}, sym AS (SELECT {listed(SYMBOLS)} FROM part),
    top AS (SELECT s.id, s.file, s.start_line, r.rank FROM sym s JOIN r{ROUNDS} r ON r.id = s.id WHERE NOT s.is_test ORDER BY r.rank DESC, s.file, s.start_line, s.id LIMIT 20)
    SELECT id, file, round(rank / (SELECT max(rank) FROM top) * 100, 6) AS score, (SELECT count(*) FROM links WHERE dst_symbol = id) AS callers FROM top"""
)
def pagerank_top(spark: SparkSession, d: str) -> DataFrame:
    links = steps(spark, d)
    rows = symbols(spark, d).drop("rank")
    ranks = graph.pagerank(rows, links, iterations=ROUNDS, tolerance=0.0)
    return lookup.ranked(rows.join(ranks, "id"), links, k=20).select("id", "file", F.round("score", 6).alias("score"), "callers")


@query(f"{_pagerank_sql(ROUNDS)} SELECT id, round(rank * 1000000, 6) AS rank FROM r{ROUNDS}")
def pagerank_all(spark: SparkSession, d: str) -> DataFrame:
    ranks = graph.pagerank(symbols(spark, d), steps(spark, d), iterations=ROUNDS, tolerance=0.0)
    return ranks.select("id", F.round(F.col("rank") * 1000000, 6).alias("rank"))


@query(
    f"""WITH RECURSIVE {STEPS_SQL}, roots AS (SELECT p_partkey AS id FROM part WHERE p_name = '{NAME}' AND p_size = 7), step AS (SELECT DISTINCT src_symbol, dst_symbol FROM links),
    walk AS (SELECT id, 0 AS depth FROM roots UNION SELECT src_symbol, depth + 1 FROM walk JOIN step ON dst_symbol = id WHERE depth < 2)
    SELECT id, min(depth) AS depth FROM walk WHERE id NOT IN (SELECT id FROM roots) GROUP BY id"""
)
def impact_bfs(spark: SparkSession, d: str) -> DataFrame:
    roots = table(spark, d, "part").where((F.col("p_name") == NAME) & (F.col("p_size") == 7)).select(F.col("p_partkey").alias("id"))
    return graph.impact(steps(spark, d), roots, depth=2)


_COMMITS_SQL = "commits AS (SELECT DISTINCT l_orderkey AS commit_id, l_partkey AS path FROM lineitem), fit AS (SELECT commit_id FROM commits GROUP BY 1 HAVING count(*) <= {0}), kept AS (SELECT * FROM commits WHERE commit_id IN (SELECT commit_id FROM fit))"


def _commits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit_id"), F.col("l_partkey").alias("path"))


@query(
    f"""WITH {_COMMITS_SQL.format(8)}, near AS (SELECT * FROM kept WHERE commit_id IN (SELECT commit_id FROM kept WHERE path = 42)), total AS (SELECT count(*) AS n FROM near WHERE path = 42)
    SELECT path, count(*) AS together_commits, n AS target_commits, round(count(*) * 100.0 / n, 6) AS confidence_percent FROM near, total WHERE path <> 42 GROUP BY path, n"""
)
def cochange_target(spark: SparkSession, d: str) -> DataFrame:
    return graph.cochange(_commits(spark, d), 42, 8).withColumn("confidence_percent", F.round("confidence_percent", 6))


@query(
    f"""WITH {_COMMITS_SQL.format(8)}, total AS (SELECT path, count(*) AS n FROM kept GROUP BY path)
    SELECT a.path, b.path AS partner, count(*) AS together_commits, t.n AS target_commits, round(count(*) * 100.0 / t.n, 6) AS confidence_percent
    FROM kept a JOIN kept b ON a.commit_id = b.commit_id AND a.path <> b.path JOIN total t ON t.path = a.path GROUP BY a.path, b.path, t.n"""
)
def cochange_pairs(spark: SparkSession, d: str) -> DataFrame:
    return graph.cochange_pairs(_commits(spark, d), 8).withColumn("confidence_percent", F.round("confidence_percent", 6))


# search

_PLAIN = "strip_accents(lower(text))"
_TOKENS_SQL = f"docs AS (SELECT doc_id, n_chars, regexp_extract_all({_PLAIN}, '[\\p{{L}}\\p{{N}}]+') AS t FROM documents)"
_TF = "len(list_filter(t, lambda x: starts_with(x, '{0}')))"
_PHRASE_TF = "len(list_filter(range(1, len(t)), lambda i: t[i] = '{0}' AND starts_with(t[i + 1], '{1}')))"


def _bm25_sql(tf: list[str], where: str) -> str:
    n = range(len(tf))
    tfs = ", ".join(f"{x} AS tf{k}" for k, x in enumerate(tf))
    sums = ", ".join(f"count(*) FILTER (WHERE tf{k} > 0) AS df{k}" for k in n)
    parts = " + ".join(f"(CASE WHEN ln((n - df{k} + 0.5) / (df{k} + 0.5)) > 0 THEN ln((n - df{k} + 0.5) / (df{k} + 0.5)) ELSE 0.000001 END) * tf{k} * 2.2 / (tf{k} + 1.2 * (0.25 + 0.75 * dl / mean))" for k in n)
    hit = f" {where} ".join(f"tf{k} > 0" for k in n)
    return f"WITH {_TOKENS_SQL}, c AS (SELECT doc_id, n_chars, len(t)::DOUBLE AS dl, {tfs} FROM docs), s AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS mean, {sums} FROM c), hits AS (SELECT doc_id, n_chars, -({parts}) AS bm25 FROM c, s WHERE {hit})"


def _find(spark: SparkSession, d: str, text: str, match_all: bool = True) -> DataFrame:
    return search.search(table(spark, d, "documents"), text, ("text",), match_all)


@query(_bm25_sql([_TF.format("stup"), _TF.format("mor")], "AND") + " SELECT doc_id, round(bm25, 6) AS bm25 FROM hits")
def fts_and(spark: SparkSession, d: str) -> DataFrame:
    return _find(spark, d, "stup mor").select("doc_id", F.round("bm25", 6).alias("bm25"))


@query(_bm25_sql([_TF.format("licen"), _TF.format("idiot")], "OR") + " SELECT doc_id, round(bm25, 6) AS bm25 FROM hits ORDER BY round(bm25, 9), n_chars DESC, doc_id LIMIT 10")
def fts_or(spark: SparkSession, d: str) -> DataFrame:
    hits = _find(spark, d, "licen idiot", match_all=False)
    return hits.orderBy(F.round("bm25", 9), F.desc("n_chars"), "doc_id").limit(10).select("doc_id", F.round("bm25", 6).alias("bm25"))


@query(_bm25_sql([_PHRASE_TF.format("under", "th")], "AND") + " SELECT doc_id, round(bm25, 6) AS bm25 FROM hits")
def fts_phrase(spark: SparkSession, d: str) -> DataFrame:
    return _find(spark, d, "under_th").select("doc_id", F.round("bm25", 6).alias("bm25"))


_STORED_TEXTS: dict = {}


def _stored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The postings of ``documents``, written once in a session; again if the table changed or what was written is gone."""
    docs, key = table(spark, d, "documents"), (spark.sparkContext.applicationId, d)
    state = tuple(docs.agg(F.count("*"), F.max("_metadata.file_modification_time"), F.sum("_metadata.file_size")).first())
    files, at = scratch.place(spark, scratch.folder(spark))
    if _STORED_TEXTS.get(key, (None,))[0] != state or not files.exists(at):
        index, lengths = search.postings_of(written(search.terms(docs, ("text",), "doc_id"), "terms", batch_rows=500))
        _STORED_TEXTS[key] = state, (written(index, "postings"), written(lengths, "lengths"))
    return _STORED_TEXTS[key][1]


@query(_bm25_sql([_TF.format("stup"), _TF.format("mor")], "AND") + " SELECT doc_id, round(bm25, 6) AS bm25 FROM hits")
def stored_and(spark: SparkSession, d: str) -> DataFrame:
    return search.search_postings(*_stored(spark, d), "Stup mor").select(F.col("id").alias("doc_id"), F.round("bm25", 6).alias("bm25"))


@query(_bm25_sql([_TF.format("licen"), _TF.format("idiot")], "OR") + " SELECT doc_id, round(bm25, 6) AS bm25 FROM hits")
def stored_or(spark: SparkSession, d: str) -> DataFrame:
    return search.search_postings(*_stored(spark, d), "licen idiot", match_all=False).select(F.col("id").alias("doc_id"), F.round("bm25", 6).alias("bm25"))


@query(_bm25_sql([_PHRASE_TF.format("under", "th"), _TF.format("et")], "OR") + " SELECT doc_id, round(bm25, 6) AS bm25 FROM hits")
def stored_phrase(spark: SparkSession, d: str) -> DataFrame:
    """A phrase, and a term with a mark that texts are searched without."""
    return search.search_postings(*_stored(spark, d), "under_th ét", match_all=False).select(F.col("id").alias("doc_id"), F.round("bm25", 6).alias("bm25"))


@query(
    _bm25_sql([_TF.format("licen"), _TF.format("idiot")], "OR")
    + """, seeds AS (SELECT doc_id, n_chars, bm25 FROM hits ORDER BY round(bm25, 9), n_chars DESC, doc_id LIMIT 8),
    costs AS (SELECT s.doc_id, s.bm25, s.n_chars, CAST(ceil(strlen(text) / 4) AS BIGINT) + CASE WHEN text = '' THEN 0 ELSE len(string_split(regexp_replace(text, '\\n$', ''), chr(10))) END AS cost FROM seeds s JOIN documents USING (doc_id)),
    run AS (SELECT doc_id, cost, sum(cost) OVER (ORDER BY round(bm25, 9), n_chars DESC, doc_id) AS used FROM costs) SELECT doc_id, cost, CAST(used AS BIGINT) AS used FROM run WHERE used <= 6000"""
)
def context_pack(spark: SparkSession, d: str) -> DataFrame:
    order = [F.round("bm25", 9), F.desc("n_chars"), "doc_id"]
    seeds = _find(spark, d, "licen idiot", match_all=False).orderBy(*order).limit(8)
    return upkeep.fit_budget(seeds.withColumn("cost", upkeep.text_cost(F.col("text"))), 6000, *order).select("doc_id", "cost", "used")


_SEEDS_SQL = _bm25_sql([_TF.format("blu"), _TF.format("gea")], "OR").replace("doc_id, n_chars, regexp", "id, is_test, rank, regexp").replace("lower(text)", "lower(name)").replace("FROM documents", "FROM symbols").replace("doc_id, n_chars", "id, is_test, rank")


@query(
    _SEEDS_SQL.replace("WITH ", f"WITH {SYMBOLS_SQL}, {EDGES_SQL}, ", 1)
    + """, seeds AS (SELECT id, row_number() OVER (ORDER BY round(bm25, 9), rank DESC, id) AS seed FROM hits WHERE NOT is_test ORDER BY seed LIMIT 8),
    near AS (SELECT seed, 'caller' AS relationship, src_symbol AS id, min(kind) AS edge_kind FROM edges JOIN seeds ON dst_symbol = id GROUP BY ALL UNION ALL SELECT seed, 'callee', dst_symbol, min(kind) FROM edges JOIN seeds ON src_symbol = id GROUP BY ALL),
    placed AS (SELECT n.*, row_number() OVER (PARTITION BY seed, relationship ORDER BY s.rank DESC, s.file, s.start_line, s.id) AS place FROM near n JOIN symbols s USING (id) WHERE NOT s.is_test)
    SELECT seed, relationship, id, edge_kind, place FROM placed WHERE place <= 3"""
)
def context_neighbours(spark: SparkSession, d: str) -> DataFrame:
    rows, links = symbols(spark, d), edges(spark, d)
    found = context.seeds(rows, "blu gea", columns=("name",))
    return context.neighbours(found, rows, links).selectExpr("cast(seed AS bigint) AS seed", "relationship", "id", "edge_kind", "cast(place AS bigint) AS place")


# differences

_SNAPSHOT = {
    "file": "source",
    "name": "lang",
    "kind": "CASE WHEN n_chars > 1000 THEN 'class' ELSE 'def' END",
    "ordinal": "doc_id",
    "signature": "{sig}",
    "body_hash": "{body}",
    "doc": "{doc}",
    "container": "CASE WHEN doc_id % 4 = 0 THEN NULL ELSE concat('c', doc_id % 4) END",
    "public": "doc_id % 3 = 0",
}
_OLD = {k: v.format(sig="substring(text, 1, 20)", body="md5(text)", doc="concat('d', doc_id % 9)") for k, v in _SNAPSHOT.items()}
_NEW = {k: v.format(sig="CASE WHEN doc_id % 7 = 0 THEN 'changed' ELSE substring(text, 1, 20) END", body="CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE md5(text) END", doc="concat('d', doc_id % (CASE WHEN doc_id % 6 = 0 THEN 8 ELSE 9 END))") for k, v in _SNAPSHOT.items()}
_SIDE = "SELECT {0}, row_number() OVER (PARTITION BY source, lang, CASE WHEN n_chars > 1000 THEN 'class' ELSE 'def' END ORDER BY doc_id) AS occurrence FROM documents WHERE doc_id % {1} <> 0"
_DIFF_SQL = f"""old AS ({_SIDE.format(listed(_OLD), 101)}), new AS ({_SIDE.format(listed(_NEW), 103)}),
    pairs AS (SELECT coalesce(n.file, o.file) AS file, coalesce(n.name, o.name) AS name, coalesce(n.kind, o.kind) AS kind, coalesce(n.occurrence, o.occurrence) AS occurrence,
    CASE WHEN o.file IS NULL THEN 'added' WHEN n.file IS NULL THEN 'deleted' WHEN o.signature IS DISTINCT FROM n.signature THEN 'signature' WHEN o.body_hash IS DISTINCT FROM n.body_hash THEN 'body' WHEN o.doc IS DISTINCT FROM n.doc THEN 'docs' END AS nature,
    CASE WHEN n.file IS NULL THEN o.public ELSE n.public END AS public, n.file IS NULL AS at_base FROM old o FULL OUTER JOIN new n ON o.file = n.file AND o.name = n.name AND o.kind = n.kind AND o.occurrence = n.occurrence),
    diff AS (SELECT * FROM pairs WHERE nature IS NOT NULL)"""


def _diff(spark: SparkSession, d: str) -> DataFrame:
    old, new = (view(spark, d, "documents", c).where(f"ordinal % {m} <> 0") for c, m in ((_OLD, 101), (_NEW, 103)))
    return diff.compare(old, new)


@query(f"WITH {_DIFF_SQL} SELECT file, name, kind, occurrence, nature, public, at_base FROM diff")
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    return _diff(spark, d).select("file", "name", "kind", F.col("occurrence").cast("long").alias("occurrence"), "nature", "public", "at_base")


@query(
    f"""WITH {_DIFF_SQL}, scored AS (SELECT *, CASE nature WHEN 'docs' THEN 0 WHEN 'signature' THEN 3 WHEN 'deleted' THEN 4 ELSE 1 END + CASE WHEN public AND nature <> 'docs' THEN 2 ELSE 0 END
    + CASE WHEN occurrence % 6 = 0 THEN 0 WHEN occurrence % 6 <= 3 THEN 1 ELSE 2 END + CASE WHEN occurrence % 5 = 0 THEN 2 ELSE 0 END AS risk_score FROM diff)
    SELECT file, name, kind, occurrence, nature, risk_score, CASE WHEN risk_score <= 2 THEN 'low' WHEN risk_score <= 5 THEN 'medium' ELSE 'high' END AS risk FROM scored"""
)
def change_risk(spark: SparkSession, d: str) -> DataFrame:
    rows = _diff(spark, d).withColumn("direct_references", F.col("occurrence") % 6).withColumn("cross_service", F.col("occurrence") % 5 == 0)
    return diff.score(rows).select("file", "name", "kind", F.col("occurrence").cast("long").alias("occurrence"), "nature", "risk_score", "risk")


@query(
    f"""WITH RECURSIVE {STEPS_SQL}, changed AS (SELECT p_partkey AS id, p_brand AS name FROM part WHERE p_name = '{NAME}' AND p_size % 5 = 0), step AS (SELECT DISTINCT src_symbol, dst_symbol FROM links),
    walk AS (SELECT id, 0 AS depth FROM changed UNION SELECT src_symbol, depth + 1 FROM walk JOIN step ON dst_symbol = id WHERE depth < 2), least AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id),
    one AS (SELECT s.src_symbol AS id, min(c.name) AS via FROM step s JOIN changed c ON c.id = s.dst_symbol JOIN least l ON l.id = s.src_symbol AND l.depth = 1 GROUP BY 1),
    two AS (SELECT s.src_symbol AS id, min(o.via) AS via FROM step s JOIN one o ON o.id = s.dst_symbol JOIN least l ON l.id = s.src_symbol AND l.depth = 2 GROUP BY 1),
    everything AS (SELECT id, 0 AS depth, name AS via FROM changed WHERE id % 10 = 0 UNION ALL SELECT id, 1, via FROM one UNION ALL SELECT id, 2, via FROM two)
    SELECT id, depth, via, id % 10 = 0 AS is_test FROM everything"""
)
def affected_tests(spark: SparkSession, d: str) -> DataFrame:
    changed = table(spark, d, "part").where((F.col("p_name") == NAME) & (F.col("p_size") % 5 == 0)).select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"))
    return diff.affected(steps(spark, d), changed, symbols(spark, d), depth=2)


@query(
    f"""WITH {SYMBOLS_SQL}, {_REFS_SQL}, deleted AS (SELECT name, service, container, module FROM symbols WHERE id % 50 = 0)
    SELECT DISTINCT r.dst_name AS name, r.src_symbol FROM refs r JOIN symbols src ON src.id = r.src_symbol JOIN deleted d ON d.name = r.dst_name
    WHERE (src.service = d.service OR EXISTS (SELECT 1 FROM imports i WHERE i.file = src.file AND (i.name = r.dst_name OR i.name = r.qualifier)))
    AND ((r.qualifier IS NOT NULL AND r.qualifier IS NOT DISTINCT FROM d.container) OR (r.qualifier IS NULL AND (d.container IS NULL OR src.container IS NOT DISTINCT FROM d.container)) OR (d.container IS NULL AND r.qualifier = d.module))"""
)
def deleted_callers(spark: SparkSession, d: str) -> DataFrame:
    rows = symbols(spark, d)
    raw = view(spark, d, "lineitem", REFS)
    target = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    refs = raw.join(target, F.col("target") == F.col("p_partkey")).selectExpr("src_symbol", "p_name AS dst_name", f"{QUALIFIER} AS qualifier", "scoped", "kind")
    return diff.callers_of_deleted(rows.where("id % 50 = 0").select("name", "service", "container", "module"), refs, rows, view(spark, d, "part", IMPORTS).distinct())


# upkeep

_STORED = "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 0 WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END AS mtime, n_chars AS size, CASE WHEN doc_id % 6 = 0 THEN 'old' ELSE md5(text) END AS hash FROM documents WHERE doc_id % 9 <> 0"
_CURRENT = "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 1 END AS mtime, n_chars AS size, md5(text) AS hash FROM documents WHERE doc_id % 11 <> 0"


def _stats(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents")
    of = lambda sql: docs.selectExpr(*["doc_id AS path", *[x for x in _columns(sql)]]).where(sql.rpartition("WHERE")[2].replace("doc_id", "path"))
    return of(_CURRENT), of(_STORED)


def _columns(sql: str) -> list[str]:
    body = sql[len("SELECT doc_id, ") : sql.index(" FROM documents")]
    return [x.strip() for x in body.split(", ")]


@query(
    f"""WITH s AS ({_STORED}), c AS ({_CURRENT}) SELECT coalesce(c.doc_id, s.doc_id) AS path, CASE WHEN c.doc_id IS NULL THEN 'removed' WHEN s.doc_id IS NULL THEN 'index' WHEN c.mtime = s.mtime AND c.size = s.size AND c.mtime <> 0 THEN 'unchanged'
    WHEN c.hash = s.hash THEN 'touched' ELSE 'index' END AS outcome FROM c FULL OUTER JOIN s ON c.doc_id = s.doc_id"""
)
def incremental_outcome(spark: SparkSession, d: str) -> DataFrame:
    return upkeep.outcomes(*_stats(spark, d))


@query(f"WITH s AS ({_STORED}), c AS ({_CURRENT}) SELECT doc_id AS path FROM s WHERE doc_id NOT IN (SELECT doc_id FROM c)")
def stale_files(spark: SparkSession, d: str) -> DataFrame:
    return upkeep.stale(*_stats(spark, d))


@query("SELECT event_type AS command, count(*) AS runs, CAST(sum(user_id) AS BIGINT) AS results, CAST(sum(event_id % 100) AS BIGINT) AS tokens_saved, epoch_us(max(ts)) AS last_used FROM events GROUP BY ROLLUP (event_type)")
def usage_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").selectExpr("event_type AS command", "user_id AS results", "event_id % 100 AS tokens_saved", "unix_micros(cast(ts AS timestamp)) AS ts")
    return upkeep.usage_totals(rows)


@query("SELECT source, CAST(round(greatest(avg(n_chars) * 8 - 30, 0) * count(*)) AS BIGINT) AS tokens_saved FROM documents GROUP BY source")
def tokens_saved(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(upkeep.tokens_saved(F.avg("n_chars"), F.count("*")).alias("tokens_saved"))


_ALL = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _ALL))
def show_stats(spark: SparkSession, d: str) -> DataFrame:
    return upkeep.row_counts({t: table(spark, d, t) for t in _ALL})


# sources and extraction: files whose text is made of parts, a definition each

_PATH_OF = "concat('src/p', p_size, CASE p_size % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.rs' WHEN 2 THEN '.ts' WHEN 3 THEN '.rb' ELSE '.scala' END)"
_OTHER = "p_partkey * 7 % 1000"
_DEFINITIONS = {
    0: ("def", "# about {b}|def f{k}(x):|    return f{o}(x)|", "def f{k}(x):", 2),
    1: ("fn", "/// about {b}|pub fn f{k}(x: u32) -> u32 {{|    f{o}(x)|}}", "pub fn f{k}(x: u32) -> u32", 3),
    2: ("function", "// about {b}|export function f{k}(x: number): number {{|  return f{o}(x);|}}", "function f{k}(x: number): number", 3),
    3: ("method", "# about {b}|def f{k}(x)|  f{o}(x)|end", "def f{k}(x)", 3),
    4: ("def", "// about {b}|def f{k}(x: Int): Int = {{|  f{o}(x)|}}", "def f{k}(x: Int): Int =", 3),
}


def _made(text: str, joined: str = "||") -> str:
    """A template as an SQL expression of strings."""
    filled = text.format(b="\0p_brand\0", k="\0p_partkey\0", o=f"\0{_OTHER}\0")
    parts = [x if n % 2 else "'" + x.replace("|", "\n") + "'" for n, x in enumerate(filled.split("\0"))]
    return "concat(" + ", ".join(p for p in parts if p != "''") + ")"


def _by_language(pick) -> str:
    return "CASE p_size % 5 " + " ".join(f"WHEN {k} THEN {pick(v)}" for k, v in _DEFINITIONS.items()) + " END"


_PIECE = _by_language(lambda v: _made(v[1]))
_PARTS_SQL = f"parts AS (SELECT {_PATH_OF} AS file, concat('f', p_partkey) AS name, {_by_language(lambda v: repr(v[0]))} AS kind, 4 * (row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1) AS above, {_by_language(lambda v: str(v[3]))} AS height, {_by_language(lambda v: _made(v[2]))} AS signature, concat('about ', p_brand) AS doc_first_line, concat('f', {_OTHER}) AS other, p_partkey FROM part)"


def _sources(spark: SparkSession, d: str, piece: str = _PIECE) -> DataFrame:
    rows = table(spark, d, "part").selectExpr(f"{_PATH_OF} AS path", "p_partkey", f"{piece} AS piece")
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "piece"))), lambda x: x["piece"])
    return rows.groupBy("path").agg(F.concat(F.array_join(pieces, "\n"), F.lit("\n")).cast("binary").alias("content"))


@query(f"WITH {_PARTS_SQL} SELECT file, name, kind, CAST(above + 2 AS BIGINT) AS start_line, CAST(above + 1 + height AS BIGINT) AS end_line, signature, doc_first_line FROM parts")
def extract_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Definitions of five languages."""
    return extract.extract(_sources(spark, d))[0].select("file", "name", "kind", "start_line", "end_line", "signature", "doc_first_line")


@query(f"WITH {_PARTS_SQL} SELECT file, CAST(above + 3 AS BIGINT) AS line, other AS dst_name, 'call' AS kind FROM parts")
def extract_refs(spark: SparkSession, d: str) -> DataFrame:
    return extract.extract(_sources(spark, d))[1].select("file", "line", "dst_name", "kind")


#: Eight lines that only a scan with modes reads right: their text, (kind, name, first line, last line) of what they define, (line, definition around it) of their calls.
_NESTED = {
    0: ('def f{k}(|    a,|    b=(1, 2),|):|    s = """|def no(): x(|"""; y = "# {{"|    return f{o}(a)|', [("def", "f", 1, 8)], [(8, "f")]),
    1: ('pub fn f{k}(|    a: u32,|) -> u32 {{|    let s = r#"fn no() {{ " {{"#;|    /* {{ /* nested */ {{ */|    f{o}(a)|}}|fn g{k}() {{}} fn h{k}() {{ f{o}(1) }}|', [("fn", "f", 1, 7), ("fn", "g", 8, 8), ("fn", "h", 8, 8)], [(6, "f"), (8, "h")]),
    2: ('export class c{k}<T> extends Base<T> {{|  m{k}(|    a: string,|  ): Promise<T> {{|    const r = /["{{`]/;|    return f{o}(`${{a}} {{`);|  }}|}}|', [("class", "c", 1, 8), ("method", "m", 2, 7)], [(6, "m")]),
    3: ('class C{k}|  def m{k}(x)|    if x then f{o}(x) end|    y = x if x|    t = "end #{{f{o}(y)}} do"|    t|  end|end|', [("class", "C", 1, 8), ("method", "m", 2, 7)], [(3, "m"), (5, "m")]),
    4: ('object c{k} {{|  def m{k}(a: Int)(|    b: Int|  ): Int =|    f{o}(a)|  val v{k} = s"{{ ${{f{o}(1)}}"|  // }}|}}|', [("object", "c", 1, 8), ("def", "m", 2, 5), ("val", "v", 6, 6)], [(5, "m"), (6, "v")]),
}
_NESTED_PIECE = "CASE p_size % 5 " + " ".join(f"WHEN {k} THEN {_made(v[0])}" for k, v in _NESTED.items()) + " END"
_NESTED_SQL = f"parts AS (SELECT {_PATH_OF} AS file, p_size % 5 AS language, p_partkey, {_OTHER} AS other, 9 * (row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1) AS above FROM part)"
_NESTED_DEFINED = ", ".join(f"({k}, '{kind}', '{name}', {a}, {b})" for k, v in _NESTED.items() for kind, name, a, b in v[1])
_NESTED_CALLED = ", ".join(f"({k}, {line}, '{name}')" for k, v in _NESTED.items() for line, name in v[2])


@query(f"WITH {_NESTED_SQL}, d(language, kind, prefix, a, b) AS (VALUES {_NESTED_DEFINED}) SELECT file, concat(prefix, p_partkey) AS name, kind, CAST(above + a AS BIGINT) AS start_line, CAST(above + b AS BIGINT) AS end_line FROM parts JOIN d USING (language)")
def extract_nested(spark: SparkSession, d: str) -> DataFrame:
    """Definitions with heads over lines, raw strings, regular expressions, nested comments, one-line blocks, several on a line."""
    return extract.extract(_sources(spark, d, _NESTED_PIECE))[0].select("file", "name", "kind", "start_line", "end_line")


@query(f"WITH {_NESTED_SQL}, c(language, line, prefix) AS (VALUES {_NESTED_CALLED}) SELECT file, CAST(above + line AS BIGINT) AS line, concat('f', other) AS dst_name, concat(prefix, p_partkey) AS owner FROM parts JOIN c USING (language)")
def extract_owners(spark: SparkSession, d: str) -> DataFrame:
    """The calls in them, each with the definition that it is in."""
    found, refs = extract.extract(_sources(spark, d, _NESTED_PIECE))
    calls = refs.where("kind = 'call'").withColumn("ref_id", F.monotonically_increasing_id())
    names = found.select("file", F.col("id").alias("owner"), F.col("name").alias("by"))
    return spans.edge_owners(found, calls).join(names, ["file", "owner"]).select("file", "line", "dst_name", F.col("by").alias("owner"))


@query(
    f"WITH {_PARTS_SQL} SELECT concat(a.file, '#', a.name) AS src, concat(b.file, '#', b.name) AS dst, a.doc_first_line AS doc FROM parts a JOIN parts b ON b.name = a.other AND b.name <> a.name"
)
def index_edges(spark: SparkSession, d: str) -> DataFrame:
    """A whole index, from texts to resolved links."""
    tables = index.build(_sources(spark, d), spark.createDataFrame([("src", "src", None, None, [], [])], repository.SERVICES), iterations=2)
    end = lambda s: tables["symbols"].select(F.col("id").alias(f"{s}_symbol"), F.concat("file", F.lit("#"), "name").alias(s), F.col("doc_first_line").alias(f"{s}_doc"))
    return tables["edges"].join(end("src").hint("merge"), "src_symbol").join(end("dst").hint("merge"), "dst_symbol").select("src", "dst", F.col("src_doc").alias("doc"))


_LISTED = {
    "path": "concat(CASE page_id % 7 WHEN 0 THEN 'node_modules/' WHEN 1 THEN 'a/.git/' WHEN 2 THEN '.spindrift/x/' WHEN 3 THEN 'target.d/' ELSE 'src/' END, 'f', page_id, CASE page_id % 6 WHEN 0 THEN '.py' WHEN 1 THEN '.RS' WHEN 2 THEN '.tsx' WHEN 3 THEN '.sc' WHEN 4 THEN '' ELSE '.rs' END)",
    "size": "(page_id % 13) * 90000",
}


@query(
    rf"""WITH p AS (SELECT {listed(_LISTED)} FROM pages), e AS (SELECT path, size, regexp_extract(path, '\.([^./]+)$', 1) AS ext FROM p)
    SELECT path, CASE ext WHEN 'py' THEN 'python' WHEN 'rs' THEN 'rust' WHEN 'sc' THEN 'scala' ELSE 'typescript' END AS language FROM e WHERE ext IN ('py', 'rs', 'tsx', 'sc') AND size <= 1048576 AND NOT regexp_matches(path, '(^|/)(node_modules|\.git|\.spindrift)/')"""
)
def source_files(spark: SparkSession, d: str) -> DataFrame:
    """Which files of a listing are walked: language by extension, skipped folders, largest size."""
    return repository.wanted(view(spark, d, "pages", _LISTED)).select("path", "language")


_NAMED = {
    "page_id": "page_id",
    "path": "concat(CASE page_id % 5 WHEN 0 THEN 'a/Tests/' WHEN 1 THEN 'spec/' ELSE 'src/test_data/' END, CASE page_id % 4 WHEN 0 THEN 'm.py' WHEN 1 THEN 'x_test.rs' WHEN 2 THEN 'k.spec.ts' ELSE 'r.rb' END)",
    "name": "CASE page_id % 3 WHEN 0 THEN 'Test_it' WHEN 1 THEN 'should_run' ELSE 'run' END",
    "hint": "page_id % 11 = 0",
}


@query(
    rf"""WITH p AS (SELECT {listed(_NAMED)} FROM pages) SELECT page_id, hint OR regexp_matches(lower(path), '(^|/)(test|tests|spec|specs|__tests__)(/|$)') OR regexp_matches(lower(path), '(^|/)test_[^/]*$|(_test|\.test|_spec|\.spec)\.[^/]*$')
    OR (regexp_matches(path, '\.(py|rb)$') AND (starts_with(lower(name), 'test_') OR ends_with(lower(name), '_test') OR starts_with(lower(name), 'should_'))) AS is_test FROM p"""
)
def test_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Test code by hint, folder, file name or name."""
    rows = view(spark, d, "pages", _NAMED)
    return rows.select("page_id", strings.is_test(F.col("path"), F.col("name"), F.col("hint")).alias("is_test"))


_SIGNED = {"p_partkey": "p_partkey", "language": "CASE p_partkey % 4 WHEN 0 THEN 'rust' WHEN 1 THEN 'typescript' WHEN 2 THEN 'python' ELSE 'ruby' END", "signature": "concat(CASE p_size % 5 WHEN 0 THEN 'pub(crate) ' WHEN 1 THEN '  pub ' WHEN 2 THEN 'export ' WHEN 3 THEN 'public ' ELSE '' END, p_type)", "name": "concat(CASE WHEN p_size % 2 = 0 THEN '_' ELSE '' END, p_name)"}


@query(
    f"""WITH s AS (SELECT {listed(_SIGNED)} FROM part) SELECT p_partkey, CASE language WHEN 'rust' THEN ltrim(signature) LIKE 'pub %' OR ltrim(signature) LIKE 'pub(%' WHEN 'typescript' THEN ltrim(signature) LIKE 'export %' OR ltrim(signature) LIKE 'public %'
    WHEN 'python' THEN name[1] <> '_' ELSE true END AS public FROM s"""
)
def public_symbols(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "part", _SIGNED).select("p_partkey", index.public_name(F.col("language"), F.col("signature"), F.col("name")).alias("public"))


# commands over symbols


@query(
    _SEEDS_SQL.replace(" OR tf1", " AND tf1").replace("WITH ", f"WITH {SYMBOLS_SQL}, ", 1)
    + " SELECT h.id, round(bm25, 6) AS bm25 FROM hits h JOIN symbols s ON s.id = h.id WHERE s.service = 's3' AND s.kind IN ('function', 'fn', 'def', 'method') AND s.language = 'rust' ORDER BY round(bm25, 9), h.rank DESC, h.id LIMIT 10"
)
def find_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The best matches of all terms among the functions of a service; the corpus figures are of all symbols."""
    hits = search.search(symbols(spark, d), "blu gea", ("name",)).where(lookup.selector(service="s3", kind="function", language="rust"))
    return hits.orderBy(F.round("bm25", 9), F.desc("rank"), "id").limit(10).select("id", F.round("bm25", 6).alias("bm25"))


@query(
    ORACLE_SQL["impact_bfs"].replace(" SELECT id, min(depth) AS depth FROM walk", f", {SYMBOLS_SQL}, least AS (SELECT id, min(depth) AS depth FROM walk")
    + ") SELECT count(*) AS symbols, count(DISTINCT file) AS files, count(DISTINCT service) AS services, coalesce(max(depth), 0) AS max_depth FROM least JOIN symbols USING (id)"
)
def impact_summary(spark: SparkSession, d: str) -> DataFrame:
    return graph.impact_summary(symbols(spark, d).join(impact_bfs(spark, d), "id"))


@query(
    ORACLE_SQL["impact_bfs"].replace(" SELECT id, min(depth) AS depth FROM walk", f", {SYMBOLS_SQL}, least AS (SELECT id, min(depth) AS depth FROM walk")
    + ") SELECT id, depth, (SELECT count(*) FROM least) AS total FROM least JOIN symbols USING (id) ORDER BY depth, rank DESC, file, start_line, id LIMIT 7"
)
def impact_first(spark: SparkSession, d: str) -> DataFrame:
    """A cut list, with how many rows there are."""
    return graph.first(symbols(spark, d).join(impact_bfs(spark, d), "id"), 7, "depth", F.desc("rank"), "file", "start_line", "id").select("id", "depth", "total")


@query(ORACLE_SQL["cochange_target"].replace("SELECT path, count(*)", "SELECT path AS file, count(*)").replace("path <> 42 GROUP", "path <> 42 AND path % 3 <> 0 GROUP") + " ORDER BY together_commits DESC, path LIMIT 10")
def cochange_top(spark: SparkSession, d: str) -> DataFrame:
    """The partners that are still there, the most frequent first."""
    there = table(spark, d, "part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("path"))
    return graph.cochange_top(_commits(spark, d), 42, there, 10, 8).withColumn("confidence_percent", F.round("confidence_percent", 6))


@query(f"""WITH {SYMBOLS_SQL} SELECT concat('{{"schema_version":1,"command":"def","type":"result","data":{{"id":', id, ',"name":"', name, '","container":', coalesce('"' || container || '"', 'null'), '}}}}') AS value FROM symbols WHERE name = '{NAME}'""")
def jsonl_records(spark: SparkSession, d: str) -> DataFrame:
    return index.jsonl(lookup.definitions(symbols(spark, d), name=NAME).select("id", "name", "container"), "def")


@query(f"WITH {SYMBOLS_SQL} SELECT concat(file, ':L', start_line, '  ', name, '  [', coalesce(container, '-'), ']', '  (def)') AS value FROM symbols WHERE name = '{NAME}'")
def text_records(spark: SparkSession, d: str) -> DataFrame:
    rows = lookup.definitions(symbols(spark, d), name=NAME).withColumn("signature", F.lit("")).withColumn("enclosing", F.col("container"))
    return index.lines(rows, "'  (def)'")


# changes of files

_CHANGED = {
    "pair": "concat('d/', doc_id, CASE doc_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.md' ELSE '.rs' END)",
    "status": "CASE doc_id % 4 WHEN 0 THEN 'added' WHEN 1 THEN 'deleted' WHEN 2 THEN 'modified' ELSE 'renamed' END",
    "old_path": "CASE doc_id % 4 WHEN 0 THEN NULL WHEN 3 THEN concat('o/', doc_id) ELSE concat('d/', doc_id, CASE doc_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.md' ELSE '.rs' END) END",
    "id": "doc_id",
    "text": "text",
}


@query(
    f"""WITH c AS (SELECT {listed(_CHANGED)} FROM documents), f AS (SELECT *, id % 3 = 0 AS olds, id % 6 = 0 AS news, id % 7 = 0 AS any_change, id % 7 = 0 AND id % 2 = 0 AS now_change, id % 10 <> 0 AS same FROM c)
    SELECT pair AS file, old_path AS old_file, CASE WHEN status = 'renamed' THEN 'renamed' ELSE 'file' END AS nature, CASE WHEN pair LIKE '%.md' THEN '{index.NOT_INDEXED}' ELSE '{index.OUTSIDE}' END AS signature, status = 'deleted' AS at_base
    FROM f WHERE pair LIKE '%.md' OR (status IN ('modified', 'renamed') AND NOT same) OR (status = 'renamed' AND NOT now_change) OR NOT (olds OR news OR any_change)"""
)
def file_changes(spark: SparkSession, d: str) -> DataFrame:
    """Changes that are of whole files: outside all symbols, renames, files without symbols or not indexed."""
    rows = view(spark, d, "documents", _CHANGED)
    some = lambda when, name="file": rows.where(when).select(F.col("pair").alias(name), F.lit(False).alias("at_base"))
    named = rows.where("id % 7 = 0").select("pair", (F.col("id") % 2 != 0).alias("at_base"))
    rest = lambda other: rows.select(F.col("pair").alias("file"), F.when(F.col("id") % 10 == 0, F.lit(other)).otherwise(F.md5("text")).alias("hash"))
    found = index.file_changes(rows.select("pair", "status", "old_path"), named, some("id % 3 = 0"), some("id % 6 = 0"), rest("x"), rest("y"))
    return found.select("file", "old_file", "nature", "signature", "at_base")


@query(f"WITH {_DIFF_SQL} SELECT CASE WHEN at_base THEN concat('old/', file) ELSE concat('new/', file) END AS file, concat('old/', file) AS old_file, name, kind, CAST(occurrence AS BIGINT) AS occurrence, nature FROM diff")
def renamed_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols of renamed files: the sides are compared whatever the paths, and each change has the path of its side."""
    found = _diff(spark, d)
    path = lambda side: F.concat(F.lit(f"{side}/"), "file")
    return found.select(F.when(F.col("at_base"), path("old")).otherwise(path("new")).alias("file"), path("old").alias("old_file"), "name", "kind", F.col("occurrence").cast("long").alias("occurrence"), "nature")


_RISK_SQL = ORACLE_SQL["change_risk"].rpartition(" SELECT file")[0]


@query(
    _RISK_SQL + f""", {SYMBOLS_SQL}, top AS (SELECT risk_score FROM scored ORDER BY risk_score DESC LIMIT 30), a AS (SELECT * FROM symbols WHERE id % 7 = 0)
    SELECT 12 AS files, (SELECT count(*) FROM scored) AS semantic_changes, CASE WHEN m <= 2 THEN 'low' WHEN m <= 5 THEN 'medium' ELSE 'high' END AS risk, m AS risk_score, (SELECT count(*) FROM a) AS affected_symbols, (SELECT count(DISTINCT service) FROM a) AS affected_services, (SELECT count(*) FROM a WHERE is_test) AS linked_tests FROM (SELECT max(risk_score) AS m FROM top)"""
)
def changes_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = _diff(spark, d).withColumn("direct_references", F.col("occurrence") % 6).withColumn("cross_service", F.col("occurrence") % 5 == 0).withColumn("line", F.col("occurrence"))
    return index.changes_summary(diff.score(rows), symbols(spark, d).where("id % 7 = 0"), 12)


@query(
    f"""WITH {SYMBOLS_SQL}, {EDGES_SQL}, live AS (SELECT id, name FROM symbols WHERE id % 9 = 0), lost AS (SELECT DISTINCT p_name AS name, l_suppkey AS src_symbol FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_partkey % 50 = 1),
    each AS (SELECT name, dst_symbol, count(DISTINCT src_symbol) AS n FROM edges JOIN live ON id = dst_symbol GROUP BY ALL UNION ALL SELECT name, NULL, count(*) FROM lost GROUP BY name) SELECT name, max(n) AS direct_references FROM each GROUP BY name"""
)
def direct_references(spark: SparkSession, d: str) -> DataFrame:
    """Of each name the most sources of one symbol."""
    rows = symbols(spark, d)
    lost = edges(spark, d).join(rows.where("id % 50 = 1").select(F.col("id").alias("dst_symbol"), "name"), "dst_symbol").select("name", "src_symbol").distinct()
    return diff.direct_references(edges(spark, d), rows.where("id % 9 = 0").select("id", "name"), lost)


@query(
    f"""WITH {SYMBOLS_SQL}, c AS (SELECT DISTINCT name, service FROM symbols WHERE id % 40 = 0), a AS (SELECT DISTINCT name AS via, service FROM symbols WHERE id % 13 = 0)
    SELECT DISTINCT c.name, true AS cross_service FROM c JOIN a ON a.via = c.name AND a.service <> c.service"""
)
def cross_service(spark: SparkSession, d: str) -> DataFrame:
    rows = symbols(spark, d)
    return diff.crossing(rows.where("id % 40 = 0"), rows.where("id % 13 = 0").withColumn("via", F.col("name")))


@query(
    """WITH asked AS (SELECT page_id, regexp_replace(regexp_replace(coalesce(url, 'none'), '^[a-z]+://', ''), '[?#].*$', '') AS file FROM pages), known AS (SELECT file, concat('k', page_id % 3) AS service FROM asked WHERE page_id % 4 = 0),
    tops AS (SELECT DISTINCT regexp_extract(file, '^[^/]+') AS path FROM asked WHERE page_id % 2 = 0) SELECT page_id, coalesce(k.service, 'top:' || t.path, '?') AS service FROM asked a LEFT JOIN (SELECT file, min(service) AS service FROM known GROUP BY file) k USING (file) LEFT JOIN tops t ON t.path = regexp_extract(a.file, '^[^/]+')"""
)
def service_of_path(spark: SparkSession, d: str) -> DataFrame:
    """The service of an indexed file, else of the path above it, else "?"."""
    rows = table(spark, d, "pages").select("page_id", F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("none")), "^[a-z]+://", ""), "[?#].*$", "").alias("file"))
    files = rows.where("page_id % 4 = 0").groupBy(F.col("file").alias("path")).agg(F.min(F.concat(F.lit("k"), (F.col("page_id") % 3).cast("string"))).alias("service"))
    top = rows.where("page_id % 2 = 0").select(F.regexp_extract("file", "^[^/]+", 0).alias("path")).distinct().select("path", F.concat(F.lit("top:"), "path").alias("name"))
    return index.service_of(rows, files, top).select("page_id", "service")


# text functions

_PATH = "regexp_replace(url, '[?#].*$', '')"


@query(
    f"""WITH p AS (SELECT page_id, {_PATH} AS path FROM pages), q AS (SELECT page_id, path, regexp_extract(path, '[^/]*$') AS file, regexp_extract(path, '([^/]*)/[^/]*$', 1) AS folder FROM p)
    SELECT page_id, CASE WHEN file IN ('mod.rs', '__init__.py', 'index.ts', 'index.tsx') THEN folder WHEN strpos(file, '.') > 1 THEN regexp_extract(file, '^(.*)\\.[^.]*$', 1) ELSE file END AS module FROM q"""
)
def file_module(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", strings.file_module(F.expr(_PATH)).alias("module"))


@query("SELECT doc_id, regexp_extract(regexp_replace(text, '[;\\s_]+$', ''), '([\\p{L}\\p{N}_]*)$', 1) AS segment, regexp_extract(text, '([\\p{L}\\p{N}_]+)[^\\p{L}\\p{N}_]*$', 1) AS identifier FROM documents")
def last_segment(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", strings.last_segment(F.col("text")).alias("segment"), strings.last_identifier(F.col("text")).alias("identifier"))


@query(
    """WITH h AS (SELECT doc_id, trim(regexp_replace(regexp_extract(text, '^[^{\\n]*'), '\\s+', ' ', 'g')) AS head, text FROM documents)
    SELECT doc_id, CASE WHEN length(head) > 200 THEN concat(rtrim(substring(head, 1, 200)), '…') ELSE head END AS signature, CAST(ceil(strlen(text) / 4) AS BIGINT) + CASE WHEN text = '' THEN 0 ELSE len(string_split(regexp_replace(text, '\\n$', ''), chr(10))) END AS tokens,
    sha1(encode(concat('blob ', strlen(text))) || '\\x00'::BLOB || encode(text)) AS blob FROM h"""
)
def signature_trunc(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return table(spark, d, "documents").select("doc_id", strings.signature_of(text).alias("signature"), strings.token_estimate(text).alias("tokens"), strings.blob_hash(text).alias("blob"))
