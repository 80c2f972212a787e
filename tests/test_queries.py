"""Every query beside its SQL, on the smallest tables, and odd cases of the operators."""

import glob
import math
import os
import random
import re

import duckdb
import pytest

import __spark_entry__
from spindrift.functions import strings
from spindrift.operators import diff, graph, lookup, resolve, search, spans, upkeep
from spindrift.plans import workloads
from spindrift.streaming import usage


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(workloads.ORACLE_SQL))
def test_query_equals_sql(spark, small, duck, name):
    df = __spark_entry__.queries()[name](spark, small)
    cols = sorted(df.columns)
    mine = [tuple(r[c] for c in cols) for r in df.collect()]
    got = duck.execute(__spark_entry__.oracle_sql()[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == cols
    theirs = [tuple(r[names.index(c)] for c in cols) for r in got.fetchall()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(mine, key=key) == sorted(theirs, key=key)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def ranks(spark, n, links):
    nodes = spark.createDataFrame([(i,) for i in range(n)], "id long")
    edges = spark.createDataFrame(links, "src_symbol long, dst_symbol long")
    return {r.id: r["rank"] for r in graph.pagerank(nodes, edges, iterations=60).collect()}


def test_pagerank(spark):
    assert ranks(spark, 0, []) == {}
    even = ranks(spark, 4, [])
    assert all(abs(x - 0.25) < 1e-9 for x in even.values())
    chain = ranks(spark, 3, [(0, 1), (1, 2)])
    assert chain[2] > chain[1] > chain[0] and abs(sum(chain.values()) - 1) < 1e-9
    n, links = 5, [(0, 1), (0, 1), (0, 2), (1, 2), (3, 0), (2, 0), (4, 4)]
    r = [1 / n] * n
    for _ in range(200):
        out = [0.15 / n] * n
        for s in range(n):
            to = [d for a, d in links if a == s] or list(range(n))
            for d in to:
                out[d] += 0.85 * r[s] / len(to)
        r = out
    got = ranks(spark, n, links)
    assert all(abs(got[i] - r[i]) < 1e-6 for i in range(n))


def test_impact(spark):
    edges = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (0, 3), (4, 3)], "src_symbol long, dst_symbol long")
    roots = spark.createDataFrame([(0,)], "id long")
    at = lambda d: {(r.id, r.depth) for r in graph.impact(edges, roots, d).collect()}
    assert at(0) == set() and at(1) == {(1, 1), (2, 1)} and at(2) == {(1, 1), (2, 1), (3, 2)} and at(9) == at(2) | {(4, 3)}


def test_cochange(spark):
    rows = [(1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "c"), (3, "a"), (4, "c")] + [(5, f"x{k}") for k in range(31)] + [(5, "a")]
    df = spark.createDataFrame(rows, "commit_id long, path string")
    got = {r.path: (r.together_commits, r.target_commits) for r in graph.cochange(df, "a").collect()}
    assert got == {"b": (2, 3), "c": (1, 3)}
    pairs = {(r.path, r.partner): r.together_commits for r in graph.cochange_pairs(df).collect()}
    assert pairs == {("a", "b"): 2, ("b", "a"): 2, ("a", "c"): 1, ("c", "a"): 1, ("b", "c"): 1, ("c", "b"): 1}


def resolved(spark, symbols, refs, imports=()):
    s = spark.createDataFrame(symbols, "id long, name string, file string, service string, module string, container string")
    r = spark.createDataFrame(refs, "src_symbol long, dst_name string, qualifier string, scoped boolean, kind string")
    i = spark.createDataFrame(list(imports), "file string, name string")
    return sorted((x.src_symbol, x.dst_symbol) for x in resolve.resolve(r, s, i).collect())


def test_resolution_tiers(spark):
    sym = [(1, "caller", "a", "s", "a", None), (2, "f", "a", "s", "a", None), (3, "f", "b", "s", "b", None), (4, "g", "b", "s", "b", None), (5, "h", "x", "t", "x", None), (6, "k", "u", "s", "util", None), (7, "m", "b", "s", "b", "Box"), (8, "m", "x", "t", "x", "Far"), (9, "fib", "a", "s", "a", None)]
    call = lambda *a: [(1, *a, "call")]
    assert resolved(spark, sym, call("f", None, False)) == [(1, 2)]  # the same file wins
    assert resolved(spark, sym, call("g", None, False) * 2) == [(1, 4), (1, 4)]  # the service; parallel edges stay
    assert resolved(spark, sym, call("h", None, False)) == []  # another service
    assert resolved(spark, sym, call("h", None, False), [("a", "h")]) == [(1, 5)]  # imported
    assert resolved(spark, sym, call("k", "util", True)) == [(1, 6)] and resolved(spark, sym, call("k", "util", False)) == []
    assert resolved(spark, [*sym, (10, "k", "v", "s", "util", None)], call("k", "util", True)) == []  # two of them
    assert resolved(spark, sym, call("m", "Box", False)) == [(1, 7)]
    assert resolved(spark, sym, call("m", "Far", False)) == [] and resolved(spark, sym, call("m", "Far", False), [("a", "Far")]) == [(1, 8)]
    assert resolved(spark, sym, [(9, "fib", None, False, "call")]) == []  # never itself
    assert resolved(spark, [*sym, (11, "fib", "b", "s", "b", None)], [(9, "fib", None, False, "call")]) == [(9, 11)]


def test_search_terms(spark):
    assert search.clean_terms("handle req get() a::b _ snake_case OR") == [["handle"], ["req"], ["get"], ["ab"], ["snake", "case"], ["or"]]
    docs = spark.createDataFrame([(1, "Snake case words", None), (2, "snake", "case"), (3, "Crème brûlée", ""), (4, None, "snake_cases")], "id long, a string, b string")
    ids = lambda q, **k: sorted(r.id for r in search.search(docs, q, ("a", "b"), **k).collect())
    assert ids("snake_cas") == [1, 4] and ids("snake case") == [1, 2, 4] and ids("creme brul") == [3] and ids("...") == [] and ids("creme snake", match_all=False) == [1, 2, 3, 4]


def test_bm25_formula(spark):
    docs = spark.createDataFrame([(k, "alpha beta" if k == 0 else "gamma " * k) for k in range(6)], "id long, a string")
    got = search.search(docs, "alph", ("a",)).first().bm25
    mean = (2 + 1 + 2 + 3 + 4 + 5) / 6
    assert abs(got + math.log((6 - 1 + 0.5) / 1.5) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 2 / mean))) < 1e-12


def test_differences(spark):
    schema = "file string, name string, kind string, ordinal long, signature string, body_hash string, doc string, container string, public boolean"
    row = lambda name, n=0, s="s", b="b", d="d": ("f", name, "fn", n, s, b, d, None, True)
    old = spark.createDataFrame([row("same"), row("gone"), row("sig"), row("body"), row("doc"), row("two", 1), row("two", 2)], schema)
    new = spark.createDataFrame([row("same"), row("new"), row("sig", s="t", b="c"), row("body", b="c"), row("doc", d=None), row("two", 1), row("two", 5, b="c")], schema)
    got = {(r.name, r.occurrence): r.nature for r in diff.compare(old, new).collect()}
    assert got == {("gone", 1): "deleted", ("new", 1): "added", ("sig", 1): "signature", ("body", 1): "body", ("doc", 1): "docs", ("two", 2): "body"}
    cases = [("deleted", True, 5, True, 10, "high"), ("docs", True, 0, False, 0, "low"), ("signature", False, 3, False, 4, "medium"), ("added", True, 0, False, 3, "medium")]
    rows = spark.createDataFrame([c[:4] for c in cases], "nature string, public boolean, direct_references long, cross_service boolean")
    assert {(r.nature, r.risk_score, r.risk) for r in diff.score(rows).collect()} == {(c[0], c[4], c[5]) for c in cases}
    assert [diff.file_status("R100", "a", "b"), diff.file_status("A", None, "n"), diff.file_status("D", "o", "o")] == [("renamed", "a", "b"), ("added", None, "n"), ("deleted", "o", None)]
    with pytest.raises(ValueError):
        diff.file_status("X", "a", "b")


def test_strings(spark):
    paths = ["a/mod.rs", "a/b.rs", "pkg/__init__.py", "x.test.ts", "top", "q/.hid", "index.ts"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] for r in df.select(strings.file_module(df.p)).collect()] == ["a", "b", "pkg", "x.test", "top", ".hid", "index"]
    df = spark.createDataFrame([("use a::b_;",), ("use a::{b, c};",), ("import x as y",)], "t string")
    assert [r[0] for r in df.select(strings.last_segment(df.t)).collect()] == ["b", "", "y"]
    df = spark.createDataFrame([("",), ("12345678",), ("a\nb",), ("a\nb\n",)], "t string")
    assert [r[0] for r in df.select(strings.token_estimate(df.t)).collect()] == [0, 3, 3, 3]
    assert strings.kind_synonyms("fn") == ["fn", "function"] and strings.kind_synonyms("struct") == ["struct"] and set(strings.kind_synonyms("function")) == {"function", "fn", "def", "method"}


def test_services_and_dominant(spark):
    paths = spark.createDataFrame([("a/b/c.rs",), ("a/x.rs",), ("ab/y.rs",), ("z.rs",)], "path string")
    prefixes = spark.createDataFrame([("one", "a"), ("two", "a/b")], "name string, path string")
    got = {r.path: r.service for r in lookup.owning_service(paths, prefixes).collect()}
    assert got == {"a/b/c.rs": "two", "a/x.rs": "one", "ab/y.rs": None, "z.rs": None}
    rows = spark.createDataFrame([("g", "a"), ("g", "b"), ("h", "a")], "g string, v string")
    assert {r.g: r.v for r in lookup.dominant(rows, "g", "v").collect()} == {"g": "b", "h": "a"}


def test_spans_of_equal_lines(spark):
    rows = spark.createDataFrame([("f", 1, "a", "fn", 1, 5), ("f", 2, "b", "fn", 1, 5), ("f", 3, "c", "fn", 2, 200)], "file string, id long, name string, kind string, start_line long, end_line long")
    assert {r.id: r.enclosing for r in spans.enclosing(rows).collect()} == {1: 2, 2: 1, 3: None}
    assert {r.id: r.enclosing for r in spans.enclosing(rows, strict=True).collect()} == {1: None, 2: None, 3: None}
    assert {r.id: r.qualified_name for r in spans.lexical_identity(rows).collect()} == {1: "a", 2: "b", 3: "c"}


def test_budget_and_usage(spark, tmp_path):
    items = spark.createDataFrame([(1, 5), (2, 5), (3, 50), (4, 1)], "n long, cost long")
    assert [r.n for r in upkeep.fit_budget(items, 11, "n").collect()] == [1, 2]
    events = spark.createDataFrame([("find", 3, 10, 1), ("find", None, None, 5), ("def", 1, 2, 3)], "command string, results long, tokens_saved long, ts long")
    got = {r.command: (r.runs, r.results, r.tokens_saved, r.last_used) for r in upkeep.usage_totals(events).collect()}
    assert got == {"find": (2, 3, 10, 5), "def": (1, 1, 2, 3), None: (3, 4, 12, 5)}
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # again: nothing new
        usage.keep_totals(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {r.command: r.runs for r in usage.read_totals(spark, str(tmp_path / "out")).collect()} == {"find": 2, "def": 1}


def test_scratch_tables_can_be_cleared(spark, monkeypatch):
    from spindrift.sources import scratch

    monkeypatch.setattr(scratch, "folder", lambda s, was=scratch.folder: f"{was(s)}-cleared")
    kept = scratch.written(spark.range(3).toDF("id"), "some")
    assert kept.count() == 3 and scratch.clear(spark)
    assert not scratch.clear(spark)


def test_search_tokens_lose_marks(spark):
    words = ["Café", "naïve", "Ångström", "Łódź", "Dvořák", "cafe\u0301", "Straße"]
    rows = spark.createDataFrame([(k, w) for k, w in enumerate(words)], "id long, text string")
    got = [r.t[0] for r in rows.select("id", strings.search_tokens(rows["text"]).alias("t")).orderBy("id").collect()]
    assert got == ["cafe", "naive", "angstrom", "łodz", "dvorak", "cafe", "straße"]
    assert [search.clean_terms(w)[0][0] for w in words] == got
    assert {r.id for r in search.search(rows, "CAFÉ", ("text",)).collect()} == {0, 5}
    index, lengths = search.postings(rows, ("text",))
    assert {r.id for r in search.search_postings(index, lengths, "café").collect()} == {0, 5}
    assert search.search_postings(index, lengths, "::").count() == 0


@pytest.mark.parametrize("match_all", [True, False])
def test_stored_search_equals_scan(spark, match_all):
    rows = [(1, "snake case", "a"), (2, "snake_cased words", None), (3, "snake", "case"), (4, "", ""), (5, "case snake case", "snake cases")]
    docs = spark.createDataFrame(rows, "id long, title string, body string")
    index, lengths = search.postings(docs, ("title", "body"))
    for query in ("snake_case", "snake", "sn ca", "snake_case words", "case_snake_case", "nothing"):
        ours = {r.id: round(r.bm25, 9) for r in search.search_postings(index, lengths, query, match_all).collect()}
        theirs = {r.id: round(r.bm25, 9) for r in search.search(docs, query, ("title", "body"), match_all).collect()}
        assert ours == theirs


def test_postings_move_once(spark):
    docs = spark.createDataFrame([(1, "b a b", "a"), (1, "a", None), (None, "c b", ""), (2, None, None)], "id long, title string, body string")
    index, lengths = search.postings(docs, ("title", "body"))
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan
    far = 1 << 32
    assert sorted(((r.token, r.id or 0, r.places) for r in index.collect())) == [("a", 1, [0]), ("a", 1, [1, far]), ("b", 0, [1]), ("b", 1, [0, 2]), ("c", 0, [0])]
    assert sorted((r.id or 0, r.length) for r in lengths.collect()) == [(0, 2), (1, 1), (1, 4), (2, 0)]


def test_deleted_callers_by_keys(spark):
    draw = random.Random(5)
    some = lambda xs: draw.choice(xs)
    deleted = [(some("fg"), some(["s", "t", None]), some(["a", "b", None]), some(["m", None])) for _ in range(8)]
    symbols = [(k, some("xyz"), some(["s", "t", "u", None]), some(["a", "b", None])) for k in range(40)]
    refs = [(draw.randrange(42), some(["f", "g", "h", None]), some(["a", "b", "m", None])) for _ in range(300)]
    imports = [("x", "f"), ("y", "a"), ("y", "m"), ("y", "m")]
    agrees = lambda q, c, m, sc: (q is not None and q == c) or (q is None and (c is None or sc == c)) or (c is None and q is not None and q == m)
    want = set()
    for src, name, q in refs:
        for id, file, service, sc in symbols:
            for d in deleted:
                if id == src and d[0] == name and agrees(q, d[2], d[3], sc) and ((service is not None and service == d[1]) or (file, name) in imports or (file, q) in imports):
                    want.add((name, src))
    frames = [spark.createDataFrame(rows, s) for rows, s in ((deleted, "name string, service string, container string, module string"), (refs, "src_symbol long, dst_name string, qualifier string"), (symbols, "id long, file string, service string, container string"), (imports, "file string, name string"))]
    got = diff.callers_of_deleted(*frames)
    assert {tuple(r) for r in got.collect()} == want and 10 < len(want) < 80
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1  # references meet no crowd of deleted symbols of their name


def test_cochange_pairs_are_dealt_by_their_number(spark, monkeypatch):
    rows = [(k, f"p{j}") for k in range(40) for j in range(k % 7)] + [(1, None), (99, "x"), (5, "p1")]
    df = spark.createDataFrame(rows, "commit_id long, path string")
    sets = [set(p for c, p in rows if c == k and p) for k in {c for c, _ in rows}]
    sets = [s for s in sets if len(s) <= 5]
    want = {(a, b): (sum({a, b} <= s for s in sets), sum(a in s for s in sets)) for s in sets for a in s for b in s if a != b}
    monkeypatch.setattr(graph, "_TASK_PAIRS", 10, raising=False)
    got = graph.cochange_pairs(df, 5)
    assert {(r.path, r.partner): (r.together_commits, r.target_commits) for r in got.collect()} == want
    many = sum(len(s) * (len(s) - 1) // 2 for s in sets) // 10 + 1
    assert many > 4 and f"hashpartitioning(path, partner, {many})" in re.sub(r"#\d+L?", "", got._jdf.queryExecution().executedPlan().toString())


def test_pagerank_in_buckets(spark, monkeypatch):
    draw = random.Random(3)
    links = [(draw.randrange(40), draw.randrange(50)) for _ in range(300)]
    nodes = spark.createDataFrame([(i,) for i in range(50)], "id long")
    edges = spark.createDataFrame(links, "src_symbol long, dst_symbol long")
    three = lambda: {r.id: r["rank"] for r in graph.pagerank(nodes, edges, iterations=3, tolerance=0.0).collect()}
    want = three()
    rounds, was = [], graph._round
    monkeypatch.setattr(graph, "_FEW_EDGES", 0, raising=False)
    monkeypatch.setattr(graph, "_round", lambda rows, *keep: (rounds.append(rows), was(rows, *keep))[1])
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = three()
        plan = rounds[2]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)
    assert plan.count("Exchange hashpartitioning") == 1  # the sums of votes alone move
