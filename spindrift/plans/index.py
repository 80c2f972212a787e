"""Build an index of source files, keep it, and ask it."""

from __future__ import annotations

import json
import logging
import time
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.strings import blob_hash, file_module, is_test, language_of, line_count
from ..operators import context, diff, extract, graph, lookup, resolve, search, spans, upkeep
from ..sources.scratch import place, small_broadcasts, written

VERSION = 3
#: What comes of each file alone, and what of all together.
PARTS = ("files", "found", "refs", "file_imports")
TABLES = (*PARTS, "symbols", "edge_raw", "edges", "edges_out", "services", "postings", "lengths", "meta")
_SEARCHED = ("name", "qualified_name", "signature", "doc_first_line")
#: Signatures of changes that are of a whole file (fixed values).
NOT_INDEXED, OUTSIDE = "<non-indexed file change>", "<file-level change outside symbol bodies>"
log = logging.getLogger(__name__)
#: How stored tables are sorted, in ranges of files (the last columns only part the rows of a hot first one), and which columns get Bloom filters: lookups read the files that may hold an answer.
LAYOUT = {
    "symbols": (("name", "id"), ("name", "qualified_name", "id")), "edges": (("dst_symbol", "src_symbol"), ("dst_symbol",)), "edges_out": (("src_symbol", "dst_symbol"), ("src_symbol",)), "edge_raw": (("dst_name", "src_symbol"), ("dst_name",)),
    "files": (("path",), ()), "found": (("file", "in_file"), ()), "refs": (("file", "in_file"), ()), "file_imports": (("file", "name"), ()), "postings": (("token", "id"), ("token",)), "lengths": (("id",), ("id",)),
}
#: What a command ended with (fixed values).
ANSWERED, NOTHING, STALE = 0, 3, 4


def parts(files: DataFrame) -> dict[str, DataFrame]:
    """What follows from each file (path, content, mtime if known) on its own, written: ``PARTS``.

    found: symbols with ``in_file``, their number in the file. refs: references
    with the number of the symbol that holds them.
    """
    with small_broadcasts(files.sparkSession):
        return _parts(files)


def _parts(files: DataFrame) -> dict[str, DataFrame]:
    found, refs = extract.extract(files)
    placed = spans.inherited_flags(spans.lexical_identity(found).withColumn("is_test", is_test(F.col("file"), F.col("name"), F.col("hint"))))
    around = spans.enclosing(found).where("enclosing is not null").join(found.select("file", F.col("id").alias("enclosing"), F.col("name").alias("around")), ["file", "enclosing"])
    symbols = placed.join(around.select("file", "id", "around"), ["file", "id"], "left").select(
        "file", F.col("id").alias("in_file"), "name", "kind", "start_line", "end_line", "signature", "doc_first_line", "container", "qualified_name", F.col("around").alias("enclosing"), "language", "is_test"
    )
    numbered = written(refs.withColumn("ref_id", F.monotonically_increasing_id()), "references")
    owned = spans.edge_owners(found, numbered).select("file", F.col("owner").alias("in_file"), "dst_name", "qualifier", "scoped", "kind")
    text = F.make_valid_utf8(F.col("content").cast("string"))
    mtime = F.col("mtime") if "mtime" in files.columns else F.lit(0)
    meta = files.select("path", language_of(F.col("path")).alias("language"), file_module(F.col("path")).alias("module"), line_count(text).alias("loc"), blob_hash(F.col("content")).alias("git_hash"), mtime.cast("long").alias("mtime"), F.octet_length("content").cast("long").alias("size"), F.current_timestamp().alias("indexed_at"))
    imports = numbered.where("kind = 'import'").select("file", F.col("dst_name").alias("name")).distinct()
    return {name: written(df, name) for name, df in (("files", meta), ("found", symbols), ("refs", owned), ("file_imports", imports))}


def with_root(services: DataFrame) -> DataFrame:
    """``services`` with one for all other files (``made``), where none is at the top; its name is no other's."""
    services = services.select("name", "path", "stack", "purpose", "entrypoints", "deps", F.lit(False).alias("made"))
    if services.where("path in ('.', '')").limit(1).count():
        return services
    taken = {r["name"] for r in services.where(F.col("name").rlike("^_*root$")).select("name").collect()}
    name = "root"
    while name in taken:
        name = "_" + name
    none = F.array().cast("array<string>")
    root = services.sparkSession.range(1).select(F.lit(name).alias("name"), F.lit(".").alias("path"), *[F.lit(None).cast("string").alias(c) for c in ("stack", "purpose")], none.alias("entrypoints"), none.alias("deps"), F.lit(True).alias("made"))
    return services.union(root)


def _starts(found: DataFrame) -> DataFrame:
    """(file, start): how many symbols the files before a file have, by ranges of files; no task sees all of them."""
    counts = found.groupBy("file").agg(F.count("*").alias("n")).repartitionByRange("file").withColumn("range", F.spark_partition_id())
    counts = written(counts, "counts")
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy("range").agg(F.sum("n").alias("n"))  # a row for each range
    ranges = sums.select("range", F.coalesce(F.sum("n").over(before().orderBy("range")), F.lit(0)).alias("first"))
    inside = F.coalesce(F.sum("n").over(before("range").orderBy("file")), F.lit(0))
    return counts.withColumn("inside", inside).join(F.broadcast(ranges), "range").select("file", (F.col("first") + F.col("inside")).alias("start"))


def assemble(part: dict[str, DataFrame], services: DataFrame, iterations: int = 50) -> dict[str, DataFrame]:
    """All tables of the index from those of the files and the services (name, path, …).

    Symbol ids count files by path, then lines: they depend on neither
    partitions nor earlier runs. What grows with the files is not broadcast.
    """
    with small_broadcasts(services.sparkSession):
        return _assemble(part, services, iterations)


def _assemble(part: dict[str, DataFrame], services: DataFrame, iterations: int) -> dict[str, DataFrame]:
    fingerprint = services_fingerprint(services)
    services = with_root(services)
    files = written(lookup.owning_service(part["files"].drop("service"), services.select(F.when(F.col("path") == "", ".").otherwise(F.col("path")).alias("path"), "name")), "files")
    used = files.select(F.col("service").alias("name"), F.lit(True).alias("used")).distinct()
    services = services.join(used, "name", "left").where("used or not made").drop("used", "made")
    found = part["found"]
    owner = files.select(F.col("path").alias("file"), "service", "module")
    symbols = found.join(_starts(found), "file").join(owner, "file").withColumn("id", F.col("start") + F.col("in_file")).drop("start")
    symbols = written(symbols, "symbols")
    raw = part["refs"].join(symbols.select("file", "in_file", F.col("id").alias("src_symbol")), ["file", "in_file"]).select("src_symbol", "dst_name", "qualifier", "scoped", "kind")
    raw = written(raw, "raw")
    edges = written(resolve.resolve(raw, symbols, part["file_imports"]), "edges")
    votes = edges.join(symbols.where(~F.col("is_test")).select(F.col("id").alias("src_symbol")), "src_symbol", "left_semi")
    ranks = graph.pagerank(symbols.select("id"), votes, iterations=iterations)
    ranked = written(symbols.drop("in_file").join(ranks, "id"), "ranked")
    index, lengths = search.postings(ranked, _SEARCHED)
    meta = files.sparkSession.createDataFrame([("services_fingerprint", fingerprint)], "key string, value string")
    return part | {"files": files, "symbols": ranked, "edge_raw": raw, "edges": edges, "edges_out": edges, "services": services, "postings": index, "lengths": lengths, "meta": meta}


def services_fingerprint(services: DataFrame) -> str:
    """A hash of what assigns files to services."""
    each = F.xxhash64(F.concat_ws("\x1f", "name", "path", F.coalesce("stack", F.lit(""))))
    row = services.agg(F.count("*").alias("n"), F.bit_xor(each).alias("x")).first()
    return f"{row['n']}:{row['x']}"


def build(files: DataFrame, services: DataFrame, iterations: int = 50) -> dict[str, DataFrame]:
    """The index's tables from files (path, content) and services."""
    return assemble(parts(files), services, iterations)


# changes


def _side(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols of files as the comparison takes them, with the hash of their own lines and whether they are public; and of each file the hash of the lines outside of all."""
    found, _ = extract.extract(files)
    found = written(found, "found")
    named = spans.inherited_flags(spans.lexical_identity(found).withColumn("is_test", is_test(F.col("file"), F.col("name"), F.col("hint"))))
    lines = written(extract.source_lines(files).select("file", "line", F.col("raw").alias("text")), "lines")
    last = lines.groupBy("file").agg(F.max("line").alias("last"))
    lines = lines.join(last, "file").where("not (line = last and text = '')").drop("last")  # a line end ends a line
    hashes = spans.text_hash(spans.own_lines(lines, found), "file", "id").withColumnRenamed("hash", "body_hash")
    public = public_name(F.col("language"), F.col("signature"), F.col("name"))
    symbols = named.join(hashes, ["file", "id"], "left").select("file", "name", "kind", F.col("id").alias("ordinal"), "signature", "body_hash", F.col("doc_first_line").alias("doc"), "container", public.alias("public"), F.col("start_line").alias("line"), "is_test")
    return symbols, spans.text_hash(spans.outside_lines(lines, found), "file")


def snapshot(files: DataFrame) -> DataFrame:
    """The symbols of files as the comparison takes them."""
    return _side(files)[0]


def public_name(language, signature, name):
    """Whether a symbol is for others: by its keywords, in Python by its name, else always."""
    sign = F.ltrim(signature)
    return (
        F.when(language == "rust", sign.startswith("pub ") | sign.startswith("pub("))
        .when(language == "typescript", sign.startswith("export ") | sign.startswith("public "))
        .when(language == "python", ~name.startswith("_"))
        .otherwise(True)
    )


def changed_pairs(old_files: DataFrame, new_files: DataFrame) -> DataFrame:
    """(status, old_path, new_path, old_content, new_content) of two states of some files (path, content), by path."""
    both = old_files.select("path", F.col("content").alias("old_content"), F.lit(True).alias("o")).join(new_files.select("path", F.col("content").alias("new_content"), F.lit(True).alias("n")), "path", "full_outer")
    status = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "deleted").otherwise("modified")
    return both.where("o is null or n is null or old_content <> new_content").select(status.alias("status"), F.when(F.col("o"), F.col("path")).alias("old_path"), F.when(F.col("n"), F.col("path")).alias("new_path"), "old_content", "new_content")


def changes(changed: DataFrame, tables: dict[str, DataFrame], depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """(changes with their risk, affected symbols) of changed files, against an index of the new state.

    ``changed`` has status, old_path, new_path, old_content, new_content
    (``repository.changed_contents``). The two sides of a file are compared
    whatever their paths, both in the language of the new path. A file has a
    change of its own (without a name) if its lines outside all symbols differ,
    if it was renamed and no symbol now there changed, if it has no symbols, or
    isn't indexed.

    Signals are by bare name: direct references are the most of any changed
    symbol of the name; a change crosses services if something affected through
    the name is in another service than the changed file.
    """
    symbols, edges = tables["symbols"], tables["edges"]
    pairs = written(changed.withColumn("path", F.coalesce("new_path", "old_path")), "changed")
    side = lambda c: _side(pairs.where(F.col(c).isNotNull()).select("path", F.col(c).alias("content")))
    (old, old_rest), (new, new_rest) = side("old_content"), side("new_content")
    old, new = written(old, "old"), written(new, "new")
    named = diff.compare(old, new).withColumnRenamed("file", "pair")
    paths = pairs.select(F.col("path").alias("pair"), "status", "old_path", "new_path")
    named = named.join(paths, "pair").withColumn("file", F.when(F.col("at_base"), F.col("old_path")).otherwise(F.col("new_path"))).withColumnRenamed("old_path", "old_file")
    columns = ["pair", "file", "old_file", "line", "name", "kind", "occurrence", "container", "signature", "nature", "public", "is_test", "at_base"]
    named = written(named.select(*columns), "named")
    whole = file_changes(paths, named, old, new, old_rest, new_rest).select(*columns)
    found = written(named.union(whole).drop("pair"), "changes")
    found = service_of(found, tables["files"], tables["services"])

    live = symbols.join(found.where("name is not null and not at_base").select("file", "name", "kind").distinct(), ["file", "name", "kind"], "left_semi").select("id", "name")
    gone = found.where("name is not null and at_base").select("name", "service", "container", file_module(F.col("file")).alias("module"))
    lost = diff.callers_of_deleted(gone, tables["edge_raw"], symbols, tables["file_imports"])
    counts = diff.direct_references(edges, live, lost)
    # a deleted symbol has no node: its callers enter the walk through an edge to a stand-in
    stand_in = lost.select("src_symbol", (-F.abs(F.xxhash64("name")) - 1).alias("dst_symbol"), "name")
    roots = live.union(stand_in.select(F.col("dst_symbol").alias("id"), "name").distinct())
    reached = written(diff.affected(edges.select("src_symbol", "dst_symbol").union(stand_in.select("src_symbol", "dst_symbol")), roots, symbols, depth), "affected")
    affected = symbols.join(reached.drop("is_test"), "id")
    crossing = diff.crossing(found, affected)
    scored = found.join(counts, "name", "left").join(crossing, "name", "left").withColumn("direct_references", F.coalesce("direct_references", F.lit(0))).withColumn("cross_service", F.coalesce("cross_service", F.lit(False)))
    return diff.score(scored).orderBy(F.desc("risk_score"), "file", "line", "name"), affected.orderBy("depth", F.desc("rank"), "file", "start_line")


def file_changes(paths: DataFrame, named: DataFrame, old: DataFrame, new: DataFrame, old_rest: DataFrame, new_rest: DataFrame) -> DataFrame:
    """The changes that are of whole files (``changes``); ``named`` are those of symbols."""
    count = lambda df, by, name: df.groupBy(F.col(by).alias("pair")).agg(F.count("*").alias(name))
    rows = paths.withColumn("language", language_of(F.col("pair")))
    for more in (count(old, "file", "n_old"), count(new, "file", "n_new"), count(named, "pair", "n_all"), count(named.where("not at_base"), "pair", "n_now"), old_rest.select(F.col("file").alias("pair"), F.col("hash").alias("o_hash")), new_rest.select(F.col("file").alias("pair"), F.col("hash").alias("n_hash"))):
        rows = rows.join(more, "pair", "left")
    rows = rows.fillna(0, ["n_old", "n_new", "n_all", "n_now"])
    kept = F.col("status").isin("modified", "renamed")
    outside = kept & ~F.col("o_hash").eqNullSafe(F.col("n_hash"))
    own = F.col("language").isNull() | outside | ((F.col("status") == "renamed") & (F.col("n_now") == 0)) | ((F.col("n_old") == 0) & (F.col("n_new") == 0) & (F.col("n_all") == 0))
    none = F.lit(None).cast("string")
    return rows.where(own).select(
        "pair", F.col("pair").alias("file"), F.col("old_path").alias("old_file"), F.lit(1).cast("long").alias("line"), none.alias("name"), none.alias("kind"), F.lit(1).alias("occurrence"), none.alias("container"),
        F.when(F.col("language").isNull(), NOT_INDEXED).otherwise(OUTSIDE).alias("signature"), F.when(F.col("status") == "renamed", "renamed").otherwise("file").alias("nature"), F.lit(False).alias("public"), F.lit(False).alias("is_test"), (F.col("status") == "deleted").alias("at_base"),
    )


def service_of(rows: DataFrame, files: DataFrame, services: DataFrame) -> DataFrame:
    """``rows`` (file) with the service of the indexed file, else of the longest service path above it, else "?"."""
    known = files.select(F.col("path").alias("file"), F.col("service").alias("__own"))
    asked = rows.select(F.col("file").alias("path")).distinct()
    above = lookup.owning_service(asked, services.select(F.when(F.col("path") == "", ".").otherwise(F.col("path")).alias("path"), "name")).select(F.col("path").alias("file"), F.col("service").alias("__above"))
    return rows.join(known, "file", "left").join(above, "file", "left").withColumn("service", F.coalesce("__own", "__above", F.lit("?"))).drop("__own", "__above")


def changes_summary(found: DataFrame, affected: DataFrame, files: int, k: int = 30) -> DataFrame:
    """One row: files, semantic_changes, the risk of the k riskiest changes, affected_symbols, affected_services, linked_tests."""
    top = found.orderBy(F.desc("risk_score"), "file", "line", "name").limit(k)
    risk = F.coalesce(F.max("risk_score"), F.lit(0))
    changed = top.agg(risk.alias("risk_score")).join(F.broadcast(found.agg(F.count("*").alias("semantic_changes"))))  # one row each
    reached = affected.agg(F.count("*").alias("affected_symbols"), F.count_distinct("service").alias("affected_services"), F.count_if("is_test").alias("linked_tests"))
    return changed.join(F.broadcast(reached)).select(F.lit(files).alias("files"), "semantic_changes", diff.risk_label(F.col("risk_score")).alias("risk"), "risk_score", "affected_symbols", "affected_services", "linked_tests")


class Refreshed(NamedTuple):
    """What a refresh did; ``mode`` is full, incremental or unchanged, with the reason of a full one that wasn't asked for."""

    mode: str
    files_indexed: int
    files_skipped: int
    files_removed: int


_STATE = [("size_bytes", "bigint"), ("services", "bigint"), ("files", "bigint"), ("symbols", "bigint"), ("edges", "bigint"), ("usage", "string"), ("indexed_at_epoch", "bigint")]


class Snapshot:
    """The tables of one version of a stored index, all from one manifest."""

    def __init__(self, spark: SparkSession, path: str, name: str, folders: dict[str, str]):
        self.spark, self.path, self.name, self.folders = spark, path, name, folders

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.folders[name]}")

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in TABLES}


class Index:
    """A stored index: folders of tables, and manifests of which the last says which folders are current.

    A run writes new folders and then a manifest of its own, in one file, that
    names the folder of each table; tables that didn't change keep theirs. A
    command reads one manifest, so whatever is saved meanwhile, its tables belong
    together. Manifests beyond the last ``versions`` go after ``retain_seconds``,
    and with them the folders that no other names. With ``root``, a folder that
    all executors see, ``fresh`` brings the index up to date.
    """

    def __init__(self, spark: SparkSession, path: str, root: str | None = None, manifest: str | None = None, versions: int = 2, retain_seconds: int = 3600):
        self.spark, self.path, self.root, self.manifest, self.versions, self.retain_seconds = spark, path.rstrip("/"), root, manifest, versions, retain_seconds

    def _manifests(self) -> list:
        """(value, file) of all manifests, the last one first."""
        try:
            rows = self.spark.read.text(f"{self.path}/current")
        except AnalysisException:  # none yet
            return []
        mine = rows.where(F.col("value").startswith(f"v={VERSION}/"))
        return mine.select("value", F.col("_metadata.file_name").alias("file")).orderBy(F.desc("value")).collect()

    def snapshot(self, name: str | None = None) -> Snapshot:
        """The current version, or the one called ``name``."""
        for row in self._manifests():
            version, _, folders = row["value"].partition(" ")
            if name in (None, version):
                return Snapshot(self.spark, self.path, version, json.loads(folders))
        raise LookupError(f"no index {name or ''} at {self.path}")

    def current(self) -> str | None:
        return self.snapshot().name if self.exists() else None

    def exists(self) -> bool:
        return bool(self._manifests())

    def save(self, tables: dict[str, DataFrame], base: Snapshot | None = None) -> str:
        """A new version of ``tables``; those that are not given are those of ``base``."""
        name = f"v={VERSION}/{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        folders = dict(base.folders) if base else {}
        for table in TABLES:
            if table not in tables and table in folders:
                continue
            rows, (by, blooms) = tables[table], LAYOUT.get(table, ((), ()))
            writer = (rows.repartitionByRange(*by).sortWithinPartitions(*by) if by else rows).write
            for column in blooms:
                writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
            folders[table] = f"{name}/{table}"
            writer.parquet(f"{self.path}/{folders[table]}")
        self.spark.range(1).select(F.lit(f"{name} {json.dumps(folders)}").alias("value")).coalesce(1).write.mode("append").text(f"{self.path}/current")
        self._retire()
        return name

    def _retire(self) -> None:
        """Delete manifests that are superseded long enough, then the folders that none names any more."""
        rows = self._manifests()
        since = time.time_ns() - self.retain_seconds * 10**9
        written_at = lambda value: int(value.partition(" ")[0].split("/")[1].split("-")[0])
        # a version was current until the next one came
        kept = [k for k, row in enumerate(rows) if k < self.versions or written_at(rows[k - 1]["value"]) > since]
        needed = {f for k in kept for f in json.loads(rows[k]["value"].partition(" ")[2]).values()}
        for k, row in enumerate(rows):
            if k in kept:
                continue
            files, at = place(self.spark, f"{self.path}/current/{row['file']}")
            files.delete(at, False)
            for folder in set(json.loads(row["value"].partition(" ")[2]).values()) - needed:
                files, at = place(self.spark, f"{self.path}/{folder}")
                files.delete(at, True)
                if files.exists(at.getParent()) and not len(files.listStatus(at.getParent())):
                    files.delete(at.getParent(), False)

    def table(self, name: str) -> DataFrame:
        return self.snapshot().table(name)

    def tables(self) -> dict[str, DataFrame]:
        return self.snapshot().tables()

    def find(self, query: str, k: int = 10, **select: str) -> DataFrame:
        now = self.snapshot()
        hits = search.search_postings(now.table("postings"), now.table("lengths"), query)
        rows = now.table("symbols").where(lookup.selector(**select))
        return _pointers(rows.join(hits, "id"), "match").orderBy("bm25", F.desc("rank"), "id").limit(k)

    def definitions(self, **select: str) -> DataFrame:
        now = self.snapshot()
        return _pointers(lookup.definitions(now.table("symbols"), **select), "definition")

    def callers(self, **select: str) -> DataFrame:
        now = self.snapshot()
        return _pointers(lookup.neighbours(now.table("symbols"), now.table("edges"), "callers", **select), "caller")

    def callees(self, **select: str) -> DataFrame:
        now = self.snapshot()
        return _pointers(lookup.neighbours(now.table("symbols"), now.table("edges_out"), "callees", **select), "callee")

    def outline(self, file: str) -> DataFrame:
        now = self.snapshot()
        return _pointers(lookup.outline(now.table("symbols"), file), "outline")

    def rank(self, k: int = 20, include_tests: bool = False, service: str | None = None) -> DataFrame:
        now = self.snapshot()
        return _pointers(lookup.ranked(now.table("symbols"), now.table("edges"), k, include_tests, service), "rank")

    def impact(self, depth: int = 2, k: int | None = None, **select: str) -> DataFrame:
        """What reaches the selected symbols, by depth and rank, with ``total``, how many there are before the cut to ``k``."""
        return graph.first(self._reached(depth, **select), k, "depth", F.desc("rank"), "file", "start_line", "id")

    def impact_summary(self, depth: int = 2, **select: str) -> DataFrame:
        return graph.impact_summary(self._reached(depth, **select))

    def _reached(self, depth: int, **select: str) -> DataFrame:
        now = self.snapshot()
        rows = now.table("symbols")
        reached = graph.impact(now.table("edges"), rows.where(lookup.selector(**select)).select("id"), depth)
        return _pointers(rows.join(reached, "id"), "impact")

    def cochange(self, file: str, commits: DataFrame, k: int = 10, on_disk: DataFrame | None = None) -> DataFrame:
        """The k files that most often changed together with ``file`` and are still there.

        ``file`` is a path, or an end of just one; ``on_disk`` (path) are the
        files there besides the indexed ones, which may be targets too.
        """
        now = self.snapshot()
        paths = now.table("files").select("path")
        there = paths if on_disk is None else paths.union(on_disk.select("path")).distinct()
        target = lookup.one_path(paths, there, file)
        return graph.cochange_top(commits, target, there, k)

    def context(self, query: str, budget: int = 2000, include_tests: bool = False) -> DataFrame:
        """(query, budget_tokens, seeds_shown, content): one text of the best matches with their neighbours and services."""
        now = self.snapshot()
        hits = search.search_postings(now.table("postings"), now.table("lengths"), query, match_all=False)
        return context.render(now.table("symbols"), hits, now.table("edges"), now.table("services"), now.table("files"), query, budget, include_tests)

    def changes(self, changed: DataFrame, depth: int = 3) -> tuple[DataFrame, DataFrame]:
        now = self.snapshot()
        return changes(changed, now.tables(), depth)

    def map(self) -> DataFrame:
        now = self.snapshot()
        return lookup.service_map(now.table("services"), now.table("files"))

    def stats(self) -> DataFrame:
        """The number of rows of each table."""
        now = self.snapshot()
        return upkeep.row_counts(now.tables())

    def state(self) -> DataFrame:
        """One row: path, exists, size_bytes (of the current version), services, files, symbols, edges, usage, indexed_at_epoch, repository_root."""
        if not self.exists():
            return self.spark.createDataFrame([(self.path, False)], "path string, exists boolean").selectExpr("*", *(f"cast(null as {kind}) as {c}" for c, kind in _STATE), "cast(null as string) as repository_root")
        now = self.snapshot()
        n = lambda t: now.table(t).count()
        size = sum(files.getContentSummary(at).getLength() for files, at in (place(self.spark, f"{self.path}/{f}") for f in now.folders.values()))
        total = self.usage().where("command is null").first()
        usage = f"{total['runs']} runs, ~{total['tokens_saved']} tokens saved" if total and total["runs"] else None
        when = now.table("files").agg(F.max("indexed_at").alias("indexed_at"))
        counts = [F.lit(n(t)).alias(t) for t in ("services", "files", "symbols", "edges")]
        return when.select(F.lit(self.path).alias("path"), F.lit(True).alias("exists"), F.lit(size).cast("long").alias("size_bytes"), *counts, F.lit(usage).cast("string").alias("usage"), F.unix_seconds("indexed_at").alias("indexed_at_epoch"), F.lit(self.root).cast("string").alias("repository_root"))

    def summary(self, done: Refreshed) -> DataFrame:
        """What a refresh did, and what there is now: files_indexed, files_skipped, files_removed, symbols, edges, services, mode."""
        now = self.snapshot()
        row = (done.files_indexed, done.files_skipped, done.files_removed, *(now.table(t).count() for t in ("symbols", "edges", "services")), done.mode)
        return self.spark.createDataFrame([row], "files_indexed long, files_skipped long, files_removed long, symbols long, edges long, services long, mode string")

    def record(self, command: str, results: int) -> None:
        """Note that a command ran, and what its pointers saved against reading the files."""
        mean = self.table("files").agg(F.coalesce(F.avg("loc"), F.lit(0.0)).alias("mean"))
        row = mean.select(F.lit(command).alias("command"), F.lit(results).cast("long").alias("results"), upkeep.tokens_saved(F.col("mean"), F.lit(results)).alias("tokens_saved"), F.unix_micros(F.current_timestamp()).alias("ts"))
        row.write.mode("append").parquet(f"{self.path}/usage")

    def answered(self, command: str, rows: DataFrame, stale: bool = False) -> int:
        """Count what a command found, record it, note when it is nothing, and give what it ended with."""
        n = rows.count()
        if n:
            self.record(command, n)
        else:
            log.warning("no_match: %s found nothing", command)
        return STALE if stale else ANSWERED if n else NOTHING

    def usage(self, reset: bool = False) -> DataFrame:
        """Totals of each command, the most frequent first, and of all (command null)."""
        none = self.spark.createDataFrame([], "command string, results long, tokens_saved long, ts long")
        if reset:
            none.write.mode("overwrite").parquet(f"{self.path}/usage")
        try:
            rows = self.spark.read.parquet(f"{self.path}/usage")
        except AnalysisException:  # nothing recorded yet
            rows = none
        return upkeep.usage_totals(rows).orderBy(F.col("command").isNull(), F.desc("runs"), "command")

    def refresh(self, files: DataFrame, services: DataFrame, read: Callable[[DataFrame], DataFrame] | None = None) -> Refreshed:
        """Bring the index up to date.

        ``files`` has path, mtime and size; ``read`` gives rows of it their
        content (by default it is a column). A file of the time and size it had
        (a time of 0 is none) isn't read; one whose content has the hash it had
        isn't extracted. Of changed ones alone are the parts made anew; links
        and ranks follow from all, and only if something changed; if files have but
        other times, these alone are stored. Other services make a full run.
        """
        load = read or (lambda df: files.join(df.select("path"), "path", "left_semi"))
        listed = files.select("path", *[F.col(c) if c in files.columns else (F.octet_length("content") if c == "size" else F.lit(0)).cast("long").alias(c) for c in ("mtime", "size")])
        listed = written(listed, "listed")
        if not self.exists():
            self.save(build(load(listed), services))
            return Refreshed("full", listed.count(), 0, 0)
        now = self.snapshot()
        stored = now.table("files")
        moved = now.table("meta").where("key = 'services_fingerprint'").first()["value"] != services_fingerprint(services)
        old = stored.select("path", "mtime", "size", F.col("git_hash").alias("hash"))
        maybe = upkeep.outcomes(listed.withColumn("hash", F.lit(None).cast("string")), old)
        content = written(load(listed.join(maybe.where("outcome = 'index'").select("path"), "path", "left_semi")).select("path", "mtime" if "mtime" in files.columns else F.lit(0).cast("long").alias("mtime"), "content"), "contents")
        hashed = listed.join(content.select("path", blob_hash(F.col("content")).alias("hash")), "path", "left")
        outcome = written(upkeep.outcomes(hashed, old), "outcomes")
        count = {r["outcome"]: r["n"] for r in outcome.groupBy("outcome").agg(F.count("*").alias("n")).collect()}
        indexed, removed, touched = (count.get(o, 0) for o in ("index", "removed", "touched"))
        skipped = count.get("unchanged", 0) + touched
        if moved:
            self.save(build(load(listed), services))
            return Refreshed("full: service definitions changed", listed.count(), 0, removed)
        new_times = listed.select("path", F.col("mtime").alias("new_mtime"))
        timed = lambda rows: rows.join(new_times, "path", "left").withColumn("mtime", F.coalesce("new_mtime", "mtime")).drop("new_mtime")
        if not indexed and not removed:
            if touched:  # else they would be read again every time
                self.save({"files": timed(stored)}, now)
            return Refreshed("unchanged", 0, skipped, 0)
        gone = outcome.where("outcome in ('index', 'removed')").select("path")
        fresh = parts(content.join(outcome.where("outcome = 'index'").select("path"), "path", "left_semi"))
        kept = {"files": timed(stored.join(gone, "path", "left_anti"))}
        kept |= {t: now.table(t).join(gone.withColumnRenamed("path", "file"), "file", "left_anti") for t in PARTS if t != "files"}
        part = {t: kept[t].select(*fresh[t].columns).union(fresh[t]) for t in PARTS}
        self.save(assemble(part, services))
        return Refreshed("incremental", indexed, skipped, removed)

    def fresh(self, allow_stale: bool = False) -> tuple[Refreshed | None, bool]:
        """Refresh from ``root`` before a query: what was done, and whether the answers may be stale because it failed and that is allowed."""
        from ..sources import repository

        try:
            listed = repository.listing(self.spark, self.root, self.path)
            done = self.refresh(listed, repository.services(self.spark, self.manifest, listed.select("path")), repository.reader(self.root))
        except Exception as problem:
            if not allow_stale or not self.exists():
                raise
            log.warning("stale_index: %s", problem)
            return None, True
        if done.mode != "unchanged":
            log.info("index_refreshed: %s", done)
        return done, False


def _pointers(rows: DataFrame, relationship: str) -> DataFrame:
    """``rows`` with the id that stays over runs, and how they are related to the question."""
    return rows.withColumn("symbol_id", F.concat_ws("#", "file", "qualified_name", "kind")).withColumn("relationship", F.lit(relationship))


def lines(rows: DataFrame, suffix: str = "''") -> DataFrame:
    """One line of text a row: place, signature and what encloses it, and ``suffix`` (an expression)."""
    around = F.concat(F.lit("  ["), F.coalesce("enclosing", F.lit("-")), F.lit("]"))
    return rows.select(F.concat(F.col("file"), F.lit(":L"), F.col("start_line").cast("string"), F.lit("  "), F.coalesce(F.nullif("signature", F.lit("")), "name"), around, F.expr(suffix)).alias("value"))


def jsonl(rows: DataFrame, command: str, kind: str = "result") -> DataFrame:
    """One line of JSON a row: schema_version, command, type, data."""
    return rows.select(F.to_json(F.struct(F.lit(1).alias("schema_version"), F.lit(command).alias("command"), F.lit(kind).alias("type"), F.struct(*rows.columns).alias("data")), {"ignoreNullFields": "false"}).alias("value"))


def clear(path: str) -> bool:
    """Delete an index folder, wherever it lies, if it is one: whether it was there."""
    spark = SparkSession.active()
    files, pointers = place(spark, f"{path.rstrip('/')}/current")
    return files.exists(pointers) and files.delete(pointers.getParent(), True)
