"""Extraction, identity, resolution and lookups over small sources of our own."""

import json
import os
import subprocess

import pytest

from spindrift.operators import context, extract, graph, lookup
from spindrift.plans import index, workloads
from spindrift.sources import repository

SOURCES = {
    "depot/src/main.rs": "mod shelf;\n\nfn main() {\n    let left = shelf::take(3);\n    println!(\"{}\", left);\n}\n",
    "depot/src/shelf.rs": (
        "//! Shelves.\n\n/// What is there.\npub fn count() -> u32 {\n    7 // {\n}\n\n/// Take some.\npub fn take(n: u32) -> u32 {\n    count().wrapping_sub(n)\n}\n\n"
        "pub trait Store {\n    fn put(&mut self, n: u32);\n}\n\npub struct Bin {\n    n: u32,\n}\n\nimpl Store for Bin {\n    fn put(&mut self, n: u32) {\n        self.n += n;\n    }\n}\n\n"
        "#[cfg(test)]\nmod tests {\n    use super::*;\n\n    fn full() -> u32 {\n        count()\n    }\n\n    #[test]\n    fn takes() {\n        assert_eq!(take(full()), 0);\n    }\n}\n"
    ),
    "prices/rates.py": "# Rates.\n\n\ndef rate(kind):\n    \"\"\"One rate: def x(\"\"\"\n    return 2\n\n\nclass Table(dict):\n    def lookup(self, k):\n        return rate(k)\n\n    async def later(self):\n        pass\n",
    "prices/tests/test_rates.py": "from prices.rates import rate\n\n\ndef test_rate():\n    assert rate('a') == 2\n",
    "shop/src/basket.ts": (
        "import { price, Priced } from './price';\n\n/** A basket. */\nexport class Basket extends Base {\n  put(item: Priced): void {\n    this.items.push(item);\n  }\n\n  sum(): number {\n    return this.items.reduce((s, i) => s + price(i.id), 0);\n  }\n}\n"
    ),
    "shop/src/price.ts": "export function price(id: string): number {\n  return id.length;\n}\n\nexport interface Priced {\n  id: string;\n}\n\nexport const twice = (n: number) => {\n  return n * 2;\n};\n",
    "mail/lib/parcel.rb": "# A parcel.\nclass Parcel < Item\n  def self.weigh(x)\n    if x\n      x * 2\n    end\n  end\n\n  def cost\n    weigh(3)\n  end\nend\n",
    "bill/src/Bill.scala": "package bill\n\nimport bill.tax.Vat\n\n/** A bill. */\ncase class Bill(id: String)\n\ntrait Repo[A] {\n  def get(id: String): Option[A]\n}\n\nobject Bills extends Repo[Bill] {\n  private val held = Map.empty[String, Bill]\n\n  def get(id: String): Option[Bill] = held.get(id)\n\n  def total(id: String): Long = {\n    val base = get(id).map(_.id.size).getOrElse(0)\n    Vat.add(base)\n  }\n}\n",
    "bill/src/tax/Vat.scala": "package bill.tax\n\nobject Vat {\n  def add(n: Long): Long = n + 1\n}\n",
    "notes.md": "fn not_code() {}\n",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, text in SOURCES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    (root / "_under").mkdir()
    (root / "_under" / "__init__.py").write_text("def hidden_too():\n    pass\n")
    (root / "node_modules").mkdir()
    (root / "node_modules" / "x.ts").write_text("function no() {}\n")
    (root / ".gitignore").write_text("*.skip.py\nout/\n")
    (root / "a.skip.py").write_text("def no():\n    pass\n")
    (root / "big.py").write_bytes(b"#" * ((1 << 20) + 1))
    return root


@pytest.fixture(scope="module")
def tables(spark, tree):
    files = repository.files(spark, str(tree))
    return {k: v.cache() for k, v in index.build(files, repository.services(spark, None, files.select("path")), iterations=30).items()}


def symbols_of(tables):
    return {(r.file, r.qualified_name): r for r in tables["symbols"].collect()}


def test_walk(tree):
    paths = [p for p, _, _ in repository.walk(str(tree))]
    assert paths == sorted(paths, key=lambda p: p.split("/")) and set(paths) == {p for p in SOURCES if p != "notes.md"} | {"_under/__init__.py"}


def test_symbols(tables):
    got = {k: (r.kind, r.start_line, r.end_line) for k, r in symbols_of(tables).items()}
    shelf, bill = "depot/src/shelf.rs", "bill/src/Bill.scala"
    want = {
        ("depot/src/main.rs", "shelf"): ("mod", 1, 1),
        ("depot/src/main.rs", "main"): ("fn", 3, 6),
        (shelf, "count"): ("fn", 4, 6),
        (shelf, "take"): ("fn", 9, 11),
        (shelf, "Store"): ("trait", 13, 15),
        (shelf, "Bin::put"): ("fn", 22, 24),
        (shelf, "tests"): ("mod", 28, 39),
        (shelf, "tests::full"): ("fn", 31, 33),
        (shelf, "tests::takes"): ("fn", 36, 38),
        ("prices/rates.py", "rate"): ("def", 4, 6),
        ("prices/rates.py", "Table"): ("class", 9, 14),
        ("prices/rates.py", "Table::lookup"): ("def", 10, 11),
        ("prices/rates.py", "Table::later"): ("def", 13, 14),
        ("shop/src/basket.ts", "Basket"): ("class", 4, 12),
        ("shop/src/basket.ts", "Basket::sum"): ("method", 9, 11),
        ("shop/src/price.ts", "Priced"): ("interface", 5, 7),
        ("shop/src/price.ts", "twice"): ("function", 9, 11),
        ("mail/lib/parcel.rb", "Parcel"): ("class", 2, 12),
        ("mail/lib/parcel.rb", "Parcel::weigh"): ("method", 3, 7),
        ("mail/lib/parcel.rb", "Parcel::cost"): ("method", 9, 11),
        (bill, "Bill"): ("class", 6, 6),
        (bill, "Repo::get"): ("def", 9, 9),
        (bill, "Bills"): ("object", 12, 21),
        (bill, "Bills::held"): ("val", 13, 13),
        (bill, "Bills::total"): ("def", 17, 20),
        (bill, "Bills::total::base"): ("val", 18, 18),
        ("bill/src/tax/Vat.scala", "Vat::add"): ("def", 4, 4),
        ("_under/__init__.py", "hidden_too"): ("def", 1, 2),
    }
    assert {k: got.get(k) for k in want} == want
    assert (shelf, "Store::put") not in got  # a signature without a body is no function


def test_details(tables):
    s = symbols_of(tables)
    assert s["depot/src/shelf.rs", "take"].doc_first_line == "Take some." and s["depot/src/shelf.rs", "take"].signature == "pub fn take(n: u32) -> u32"
    assert s["shop/src/basket.ts", "Basket"].doc_first_line == "A basket." and s["shop/src/basket.ts", "Basket"].signature == "class Basket extends Base"
    tests = {q for (f, q), r in s.items() if r.is_test}
    assert tests == {"tests", "tests::full", "tests::takes", "test_rate"}
    assert s["depot/src/shelf.rs", "tests::full"].container == "tests" and s["_under/__init__.py", "hidden_too"].module == "_under"
    every = tables["symbols"].orderBy("file", "start_line").collect()
    assert [r.id for r in every] == list(range(1, len(every) + 1))
    assert abs(sum(r.rank for r in every) - 1) < 1e-9


def test_edges(tables):
    name = {r.id: r.qualified_name for r in tables["symbols"].collect()}
    got = {(name[r.src_symbol], name[r.dst_symbol], r.kind) for r in tables["edges"].collect()}
    want = {("main", "take", "call"), ("take", "count", "call"), ("tests::full", "count", "call"), ("Table::lookup", "rate", "call"), ("test_rate", "rate", "call"), ("Basket::sum", "price", "call"), ("Parcel::cost", "Parcel::weigh", "call"), ("Bills::total::base", "Bills::get", "call"), ("Bills::total", "Vat::add", "call")}
    assert want - {("Bills::total::base", "Bills::get", "call")} <= got
    assert {("Bills::total", "Bills::get", "call"), ("Bills::total::base", "Bills::get", "call")} & got
    assert not any(d in ("Store::put", "tests::full") for _, d, k in got if k == "call")  # unknown receivers and macro arguments


def test_stored_index_answers(spark, tables, tmp_path):
    stored = index.Index(spark, str(tmp_path / "ix"))
    stored.save(tables)
    stored.save(tables)
    found = stored.find("tak", k=5).collect()  # as often in both, but the test's signature is shorter
    assert [r.qualified_name for r in found] == ["tests::takes", "take"] and found[0].bm25 < found[1].bm25 < 0
    assert {r.qualified_name for r in stored.callers(name="count").collect()} == {"take", "tests::full"}
    assert {r.qualified_name for r in stored.callees(name="take").collect()} == {"count"}
    assert {(r.qualified_name, r.depth) for r in stored.impact(name="count").collect()} == {("take", 1), ("tests::full", 1), ("main", 2)}
    assert [r.name for r in stored.outline("price.ts").collect()] == ["price", "Priced", "twice"]
    assert stored.rank(k=3).first().score == 100.0
    assert {r["name"]: r.files for r in stored.map().collect()} == {"depot": 2, "prices": 2, "shop": 2, "mail": 1, "bill": 2, "_under": 1}
    line = json.loads(index.jsonl(stored.definitions(name="take"), "def").first().value)
    assert line["schema_version"] == 1 and line["command"] == "def" and line["data"]["qualified_name"] == "take"
    assert {r["name"]: r.n for r in stored.stats().collect()}["services"] == 6
    state = stored.state().first()
    assert (state.services, state.files) == (6, 10) and state.indexed_at_epoch > 1_700_000_000
    packed = stored.context("take count", budget=200).first()
    head, *rest = packed.content.split("\n")
    assert head == "# context: take count" and rest[0] == "## services" and "depot  (rust)  2 files" in rest
    assert any(x.startswith("  <- depot/src/") for x in rest) and context.tokens_of(packed.content) <= 200
    assert f"{packed.seeds_shown}/" in rest[-1] and rest[-1].startswith("[~")
    with pytest.raises(ValueError):
        stored.context("take count", budget=5)
    assert stored.context("nothingatall").count() == 0
    cut = stored.impact(name="count", k=1).collect()
    assert [(r.qualified_name, r.total) for r in cut] in ([("take", 3)], [("tests::full", 3)])
    assert graph.truncation(cut[0].total, 1, "impact") == ("impact", 2, 1) and graph.truncation(3, 3, "impact") is None
    assert tuple(stored.impact_summary(name="count").first()) == (3, 2, 1, 2)
    assert {r.enclosing for r in stored.definitions(name="takes").collect()} == {"tests"}
    first = stored.definitions(name="take").first()
    assert (first.symbol_id, first.relationship) == ("depot/src/shelf.rs#take#fn", "definition")
    assert index.lines(stored.definitions(name="take")).first().value == "depot/src/shelf.rs:L9  pub fn take(n: u32) -> u32  [-]"
    stored.record("find", 3)
    assert stored.answered("find", stored.find("count", k=1)) == index.ANSWERED == 0
    assert stored.answered("find", stored.find("nothingatall")) == index.NOTHING == 3
    assert stored.answered("find", stored.find("nothingatall"), stale=True) == index.STALE == 4
    assert [(r.command, r.runs, r.results) for r in stored.usage().collect()] == [("find", 2, 4), (None, 2, 4)]
    assert stored.usage(reset=True).where("command is not null").count() == 0
    state = stored.state().first()
    assert state["exists"] and state.size_bytes > 10_000 and state.usage is None
    stored.record("find", 3)
    assert stored.state().first().usage.startswith("1 runs, ~")
    assert index.clear(stored.path) and not index.clear(stored.path)
    gone = stored.state().first()
    assert gone["exists"] is False and gone.symbols is None
    assert not (tmp_path / "ix").exists()


def test_empty_and_odd_files(spark):
    rows = [("a.py", b""), ("b.py", None), ("c.txt", b"def x():"), ("d.rs", b"fn f() {\n"), ("e.rb", b"end\nend\n"), ("f.ts", b"\xff\xfe}}{{{"), ("g.scala", b'def s = "unclosed\n')]
    symbols, refs = extract.extract(spark.createDataFrame(rows, "path string, content binary"))
    assert {(r.file, r.name, r.start_line, r.end_line) for r in symbols.collect()} == {("d.rs", "f", 1, 1), ("g.scala", "s", 1, 1)}
    assert refs.count() == 0
    symbols, _ = extract.extract(spark.createDataFrame([], "path string, content binary"))
    assert symbols.count() == 0


def test_git_sources(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@example.org", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.py").write_text("x\n" * 20)
    (tmp_path / "b.py").write_text("y\n")
    run("add", ".")
    run("commit", "-qm", "one")
    (tmp_path / "a.py").write_text("x\n" * 19)
    run("commit", "-qam", "two")
    got = {(r.commit_id, r.path) for r in repository.commits(spark, str(tmp_path)).collect()}
    assert got == {(0, "a.py"), (1, "a.py"), (1, "b.py")}
    run("mv", "a.py", "c.py")
    (tmp_path / "b.py").unlink()
    (tmp_path / "new.py").write_text("n\n")
    got = {tuple(r) for r in repository.changed_files(spark, str(tmp_path)).collect()}
    assert got == {("renamed", "a.py", "c.py"), ("deleted", "b.py", None), ("added", None, "new.py")}


def test_manifest(spark, tmp_path):
    (tmp_path / "m.toml").write_text('[[service]]\nname = "b"\npath = "x/b"\nentrypoints = ["m.py"]\n\n[[service]]\nname = "a"\npath = "x"\n')
    rows = repository.services(spark, str(tmp_path / "m.toml"), None).collect()
    assert [(r["name"], r.path, r.entrypoints) for r in rows] == [("a", "x", []), ("b", "x/b", ["m.py"])]
    (tmp_path / "m.toml").write_text("[[service")
    with pytest.raises(Exception):
        repository.services(spark, str(tmp_path / "m.toml"), None)


def test_refresh(spark, tmp_path):
    stored = index.Index(spark, str(tmp_path / "ix"))
    files = lambda *rows: spark.createDataFrame(rows, "path string, content binary")
    one, two = ("a/x.py", b"def f():\n    pass\n"), ("a/y.py", b"def g():\n    f()\n")
    services = lambda *names: spark.createDataFrame([(n, n, None, None, [], []) for n in names], repository.SERVICES)
    assert stored.refresh(files(one), services("a")) == ("full", 1, 0, 0)
    assert stored.refresh(files(one), services("a")) == ("unchanged", 0, 1, 0)
    assert stored.refresh(files(one, two), services("a")) == ("incremental", 1, 1, 0)
    assert {r.name for r in stored.callers(name="f").collect()} == {"g"}
    assert {r.qualified_name for r in stored.find("g").collect()} == {"g"}
    assert stored.refresh(files(two), services("a")) == ("incremental", 0, 1, 1) and stored.definitions(name="f").count() == 0
    assert stored.refresh(files(two), services("b")).mode == "full: service definitions changed"


def test_touched_files_are_read_once(spark, tmp_path):
    root = tmp_path / "src" / "a"
    root.mkdir(parents=True)
    for k in range(3):
        (root / f"m{k}.py").write_text(f"def f{k}():\n    pass\n")
    stored = index.Index(spark, str(tmp_path / "ix"), str(root.parent))
    stored.fresh()
    before = stored.snapshot()
    os.utime(root / "m1.py", ns=(5 * 10**9, 5 * 10**9))
    assert stored.fresh()[0] == ("unchanged", 0, 3, 0)
    now = stored.snapshot()
    assert now.name != before.name and {t for t in now.folders if now.folders[t] != before.folders[t]} == {"files"}
    times = {r.path: r.mtime for r in stored.table("files").collect()}
    assert times["a/m1.py"] in (5, 5 * 10**3, 5 * 10**9)
    assert stored.fresh()[0] == ("unchanged", 0, 3, 0) and stored.current() == now.name  # nothing was left to store
    assert tuple(stored.summary(index.Refreshed("unchanged", 0, 3, 0)).first()) == (0, 3, 0, 3, 0, stored.table("services").count(), "unchanged")


def test_versions_are_pinned_and_retired(spark, tmp_path):
    files = lambda n: spark.createDataFrame([("a/x.py", f"def f{n}():\n    pass\n".encode())], "path string, content binary")
    services = spark.createDataFrame([("a", "a", None, None, [], [])], repository.SERVICES)
    stored = index.Index(spark, str(tmp_path / "ix"), retain_seconds=0)
    stored.save(index.build(files(0), services, iterations=1))
    old = stored.snapshot()
    asked = stored.definitions(name="f0")  # its tables are those of the version that it was asked of
    stored.save(index.build(files(1), services, iterations=1))
    assert asked.count() == 1 and old.table("symbols").first().name == "f0" and stored.table("symbols").first().name == "f1"
    stored.save({"meta": old.table("meta")}, stored.snapshot())
    folders = {p.name for p in (tmp_path / "ix" / f"v={index.VERSION}").iterdir()}
    assert old.name.split("/")[1] not in folders and len(folders) == 2  # the first went, the second still has most tables
    assert stored.snapshot(stored.current()).table("symbols").count() == 1
    with pytest.raises(LookupError):
        stored.snapshot(old.name)
    kept = index.Index(spark, str(tmp_path / "kept"))
    kept.save({t: stored.table(t) for t in index.TABLES})
    for _ in range(2):
        kept.save({"meta": stored.table("meta")}, kept.snapshot())
    assert len(kept._manifests()) == 3  # not an hour old


def test_refresh_reads_and_extracts_only_what_changed(spark, tmp_path, monkeypatch):
    root = tmp_path / "src"
    for k in range(4):
        (root / "d" / f"d{k}").mkdir(parents=True)
        (root / "d" / f"d{k}" / "m.py").write_text(f"def f{k}():\n    return f{(k + 1) % 4}()\n")
    stored = index.Index(spark, str(tmp_path / "ix"), str(root))
    assert stored.fresh()[0] == ("full", 4, 0, 0)
    assert stored.fresh() == (("unchanged", 0, 4, 0), False)
    extracted = []
    parts = index.parts
    monkeypatch.setattr(index, "parts", lambda files: (extracted.extend(r.path for r in files.select("path").collect()), parts(files))[1])
    (root / "d" / "d1" / "m.py").write_text("def g1():\n    pass\n")
    os.utime(root / "d" / "d2" / "m.py", ns=(1, 1))  # touched: another time, the same content
    (root / "d" / "d3" / "m.py").unlink()
    assert stored.fresh()[0] == ("incremental", 1, 2, 1)
    assert extracted == ["d/d1/m.py"]
    again = index.build(repository.files(spark, str(root)), repository.services(spark, None, repository.listing(spark, str(root)).select("path")))
    for t in ("symbols", "edges", "edge_raw"):
        ours, theirs = (sorted(map(str, x.select(sorted(c for c in x.columns if c != "rank")).collect())) for x in (stored.table(t), again[t]))
        assert ours == theirs
    assert stored.fresh()[0].mode == "unchanged"
    stored.root = str(tmp_path / "absent")
    with pytest.raises(Exception):
        stored.fresh()
    assert stored.fresh(allow_stale=True) == (None, True)


def test_root_service(spark, tmp_path):
    files = spark.createDataFrame([("a/x.py", b"def f():\n    pass\n"), ("top.py", b"def g():\n    pass\n")], "path string, content binary")
    services = spark.createDataFrame([("root", "a", None, None, [], [])], repository.SERVICES)
    tables = index.build(files, services, iterations=2)
    assert {(r["name"], r.path) for r in tables["services"].collect()} == {("root", "a"), ("_root", ".")}
    assert {r.file: r.service for r in tables["symbols"].collect()} == {"a/x.py": "root", "top.py": "_root"}
    assert {r["name"]: r.files for r in lookup.service_map(tables["services"], tables["files"]).collect()} == {"root": 1, "_root": 1}
    only = index.build(files.where("path = 'a/x.py'"), services, iterations=2)
    assert {r["name"] for r in only["services"].collect()} == {"root"}


def test_imports_calls_and_comments_over_lines(spark):
    rows = [
        ("a.ts", b"import {\n  one,\n  type Two,\n} from './x';\n\n/**\n * Not the first line.\n */\nexport function f() {\n  one();\n}\n\n/* First.\n second */\n\nfunction g() {}\n"),
        ("b.rb", b"class B\n  def go\n    load_all 3\n    x = item.price\n    puts \"a\" if item.ready?\n    item&.close\n  end\nend\n"),
        ("c.py", b"# About.\n\n@cached\ndef f():\n    if x:\n        return 1\n    # end\n\n    return 2\n\ndef last(): return 3\n"),
    ]
    symbols, refs = extract.extract(spark.createDataFrame(rows, "path string, content binary"))
    got = {(r.file, r.name): (r.start_line, r.end_line, r.doc_first_line) for r in symbols.collect()}
    assert got["a.ts", "f"] == (9, 11, None) and got["a.ts", "g"] == (16, 16, "First.")
    assert got["c.py", "f"] == (4, 9, "About.") and got["c.py", "last"][:2] == (11, 11)
    found = {(r.file, r.dst_name, r.kind) for r in refs.collect()}
    assert {("a.ts", "one", "import"), ("a.ts", "Two", "import"), ("a.ts", "one", "call")} <= found
    assert {n for f, n, k in found if f == "b.rb"} == {"load_all", "price", "puts", "ready?", "close"}


def test_the_store_is_not_walked(tmp_path):
    for path in ("a.py", "store/b.py", "src/c.py"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("")
    assert [p for p, *_ in repository.walk(str(tmp_path), f"file://{tmp_path}/store")] == ["a.py", "src/c.py"]


def test_ignore_rules(tmp_path):
    for path in ("a/b/x.py", "a/x.py", "x.py", "docs/a/y.py", "docs/y.py", "keep/z.py", "odd[1].py", "build/q.py", "src/build/q.py", "lit*.py"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("")
    (tmp_path / ".gitignore").write_text("# rules\na/*.py\ndocs/**\n!docs/y.py\n/build/\n**/z.py\nodd\\[1].py\nlit\\*.py\n")
    assert [p for p, *_ in repository.walk(str(tmp_path))] == ["a/b/x.py", "docs/y.py", "src/build/q.py", "x.py"]


def test_changes_with_risk(spark):
    before = [("s/a.py", b"def kept():\n    return 1\n\n\ndef gone(x):\n    return x\n"), ("s/b.py", b"def user():\n    return gone(kept())\n"), ("t/c.py", b"from s.a import kept\n\n\ndef far():\n    return kept()\n"), ("s/test_b.py", b"def test_user():\n    user()\n")]
    after = [("s/a.py", b"def kept(y=0):\n    return 1\n\n\ndef _fresh():\n    return 2\n"), *before[1:]]
    old, new = (spark.createDataFrame(rows, "path string, content binary") for rows in (before, after))
    services = spark.createDataFrame([("s", "s", None, None, [], []), ("t", "t", None, None, [], [])], repository.SERVICES)
    found, reached = index.changes(index.changed_pairs(old, new), index.build(new, services, iterations=3))
    summary = index.changes_summary(found, reached, 1).first()
    assert tuple(summary) == (1, 3, "high", 8, 3, 2, 1)
    got = {r.name: (r.nature, r.direct_references, r.cross_service, r.risk_score, r.risk) for r in found.collect()}
    assert got == {"gone": ("deleted", 1, False, 7, "high"), "kept": ("signature", 2, True, 8, "high"), "_fresh": ("added", 0, False, 1, "low")}
    assert {(r.name, r.depth, r.via, r.is_test) for r in reached.collect()} == {("user", 1, "gone", False), ("far", 1, "kept", False), ("test_user", 2, "gone", True)}


def test_changes_of_a_repository(spark, tmp_path):
    root = tmp_path / "repo"
    write = lambda path, text: ((root / path).parent.mkdir(parents=True, exist_ok=True), (root / path).write_text(text))
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@example.org", *a], check=True, capture_output=True)
    body = "".join(f"def step{k}(x):\n    return x + {k}\n\n\n" for k in range(8))
    write("s/old.py", body)
    write("s/same.py", body.replace("step", "other"))
    write("s/user.py", "LIMIT = 1\n\n\ndef user():\n    return step0(1)\n")
    write("s/gone.py", "def lost():\n    pass\n")
    write("s/caller.py", "def caller():\n    lost()\n")
    write("s/empty.py", "X = 1\n")
    write("notes.md", "one\n")
    run("init", "-q")
    run("add", ".")
    run("commit", "-qm", "one")
    run("mv", "s/old.py", "s/new.py")
    write("s/new.py", body.replace("return x + 0", "return x - 0").replace("def step7(x):\n    return x + 7\n", ""))
    run("mv", "s/same.py", "s/moved.py")
    write("s/user.py", "LIMIT = 2\n\n\ndef user():\n    return step0(1)\n")
    (root / "s/gone.py").unlink()
    write("s/empty.py", "X = 2\n")
    write("notes.md", "two\n")
    write("t/extra.py", "def extra():\n    pass\n")
    stored = index.Index(spark, str(tmp_path / "ix"), str(root))
    stored.fresh()
    changed = repository.changed_contents(spark, str(root))
    found, reached = stored.changes(changed)
    got = {(r.file, r.old_file, r.name, r.nature, r.at_base, r.service) for r in found.collect()}
    assert got == {
        ("s/new.py", "s/old.py", "step0", "body", False, "s"),
        ("s/old.py", "s/old.py", "step7", "deleted", True, "s"),
        ("s/moved.py", "s/same.py", None, "renamed", False, "s"),
        ("s/user.py", "s/user.py", None, "file", False, "s"),
        ("s/gone.py", "s/gone.py", "lost", "deleted", True, "s"),
        ("s/empty.py", "s/empty.py", None, "file", False, "s"),
        ("notes.md", "notes.md", None, "file", False, "?"),
        ("t/extra.py", None, "extra", "added", False, "t"),
    }
    assert {(r.name, r.via) for r in reached.collect()} == {("user", "step0"), ("caller", "lost")}
    assert {r.signature for r in found.collect() if r.name is None} == {index.NOT_INDEXED, index.OUTSIDE}
    summary = index.changes_summary(found, reached, changed.count()).first()
    assert (summary["files"], summary.semantic_changes, summary.affected_symbols, summary.linked_tests) == (7, 8, 2, 0)
    commits = repository.commits(spark, str(root))
    assert {r.file for r in stored.cochange("user.py", commits).collect()} == {"s/caller.py", "s/empty.py"}
    with pytest.raises(ValueError, match="ambiguous"):
        stored.cochange("r.py", commits)
    with pytest.raises(ValueError, match="no such file"):
        stored.cochange("absent.py", commits)
    assert stored.cochange("./notes.md", commits, on_disk=spark.createDataFrame([("notes.md",)], "path string")).count() > 0


def test_what_grows_is_not_broadcast(spark, small, monkeypatch):
    """All that is broadcast goes through the driver: the build lets only small tables, its query none of the symbols."""
    key, seen, real = "spark.sql.autoBroadcastJoinThreshold", [], index.written
    monkeypatch.setattr(index, "written", lambda df, *a, **k: seen.append(spark.conf.get(key)) or real(df, *a, **k))
    was = spark.conf.get(key)
    plan = workloads.index_edges(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan
    assert seen and set(seen) == {"65536"} and spark.conf.get(key) == was
