"""Source files, services, commits and changed files as DataFrames."""

from __future__ import annotations

import os
import re
import subprocess
import tomllib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strings import LANGUAGES, MOST_BYTES, SKIPPED_FOLDERS, language_of
from ..operators.diff import file_status

SERVICES = "name string, path string, stack string, purpose string, entrypoints array<string>, deps array<string>"


def _rules(folder: str) -> list[str]:
    out = []
    for name in (".gitignore", ".ignore"):
        path = os.path.join(folder, name)
        if os.path.isfile(path):
            with open(path, encoding="utf-8", errors="replace") as f:
                out += [x.strip() for x in f if x.strip() and not x.startswith("#")]
    return out


def _rule(rule: str) -> re.Pattern:
    """An ignore rule as a pattern on paths below its folder: ``*`` and ``?`` stop at slashes, ``**`` doesn't, a backslash takes the next character as it is."""
    anchored = "/" in rule.rstrip("/")
    out, at, rule = "", 0, rule.lstrip("/")
    while at < len(rule):
        if rule.startswith("**/", at):
            out, at = out + "(?:.*/)?", at + 3
        elif rule.startswith("/**", at) and at + 3 == len(rule):
            out, at = out + "/.+", at + 3
        elif rule[at] == "*":
            out, at = out + "[^/]*", at + 1
        elif rule[at] == "?":
            out, at = out + "[^/]", at + 1
        elif rule[at] == "[" and (end := rule.find("]", at + 2)) > 0:
            inside = rule[at + 1 : end]
            out, at = out + "[" + ("^" + inside[1:] if inside[0] in "!^" else inside) + "]", end + 1
        else:
            at += rule[at] == "\\" and at + 1 < len(rule)
            out, at = out + re.escape(rule[at]), at + 1
    return re.compile(("" if anchored else "(?:.*/)?") + out)


def _ignored(path: str, is_folder: bool, rules: list[tuple[str, str]]) -> bool:
    """Whether the last rule that fits a path leaves it out."""
    out = False
    for base, rule in rules:
        keep = rule.startswith("!")
        rule = rule[1:] if keep else rule
        only_folder, rule = rule.endswith("/"), rule.rstrip("/")
        if base and not path.startswith(base + "/") or only_folder and not is_folder:
            continue
        if _rule(rule).fullmatch(path[len(base) :].lstrip("/")):
            out = not keep
    return out


def walk(root: str, store: str | None = None) -> list[tuple[str, int, int]]:
    """(path, mtime in ns, size) of source files under a folder, sorted: hidden ones too, links, ignored ones and the index's own ``store`` not."""
    out: list = []
    own = os.path.realpath(store.removeprefix("file://")) if store else None

    def enter(folder: str, rules: list[tuple[str, str]]) -> None:
        here = os.path.relpath(folder, root).replace(os.sep, "/")
        here = "" if here == "." else here
        rules = rules + [(here, r) for r in _rules(folder)]
        for e in sorted(os.scandir(folder), key=lambda e: e.name):
            path = f"{here}/{e.name}".lstrip("/")
            if e.is_symlink() or _ignored(path, e.is_dir(), rules):
                continue
            if e.is_dir():
                if e.name not in SKIPPED_FOLDERS and os.path.realpath(e.path) != own:
                    enter(e.path, rules)
            elif e.name.rpartition(".")[2] in LANGUAGES and "." in e.name and (s := e.stat()).st_size <= MOST_BYTES:
                out.append((path, s.st_mtime_ns, s.st_size))

    enter(root, [])
    return out


def wanted(listed: DataFrame) -> DataFrame:
    """The rows of a listing (path, size) that the walk would keep, for tables of paths from elsewhere: with ``language``, in no skipped folder, not too large."""
    folders = F.split("path", "/")
    above = F.slice(folders, 1, F.size(folders) - 1)
    skipped = F.arrays_overlap(above, F.array(*map(F.lit, SKIPPED_FOLDERS)))
    return listed.withColumn("language", language_of(F.col("path"))).where(F.col("language").isNotNull() & ~skipped & (F.col("size") <= MOST_BYTES))


def listing(spark: SparkSession, root: str, store: str | None = None) -> DataFrame:
    """(path, mtime, size) of a folder's source files."""
    return spark.createDataFrame(walk(root, store), "path string, mtime long, size long")


def reader(root: str):
    """Gives rows of a listing their content; tasks read, in a folder that all executors see."""

    def read(batches):
        for pdf in batches:
            content = []
            for p in pdf["path"]:
                with open(os.path.join(root, p), "rb") as f:
                    content.append(f.read())
            yield pdf.assign(content=content)

    def load(listed: DataFrame) -> DataFrame:
        spread = listed.select("path", "mtime", "size").repartition(max(1, listed.sparkSession.sparkContext.defaultParallelism))
        return spread.mapInPandas(read, "path string, mtime long, size long, content binary")

    return load


def files(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime, size, content) of a folder that all executors see; contents are read by tasks, not by the driver."""
    return reader(root)(listing(spark, root))


def services(spark: SparkSession, manifest: str | None, paths: DataFrame) -> DataFrame:
    """The services of a manifest (TOML, [[service]]), by name; without one, one for each top folder, and "." for files at the top.

    A manifest that isn't valid raises an error.
    """
    if manifest and os.path.isfile(manifest):
        with open(manifest, "rb") as f:
            rows = tomllib.load(f).get("service", [])
        return spark.createDataFrame([(r["name"], r["path"], r.get("stack"), r.get("purpose"), r.get("entrypoints", []), r.get("deps", [])) for r in rows], SERVICES).orderBy("name")
    top = F.when(F.instr("path", "/") > 0, F.substring_index("path", "/", 1)).otherwise(".")
    from ..operators.lookup import dominant

    stacks = dominant(paths.select(top.alias("top"), language_of(F.col("path")).alias("stack")), "top", "stack")
    none = F.array().cast("array<string>")
    return stacks.select(F.when(F.col("top") == ".", "root").otherwise(F.col("top")).alias("name"), F.col("top").alias("path"), "stack", F.lit(None).cast("string").alias("purpose"), none.alias("entrypoints"), none.alias("deps")).orderBy("name")


def _git(root: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True)
    if done.returncode:
        raise RuntimeError(done.stderr.decode("utf-8", "replace").strip())
    return done.stdout.decode("utf-8", "replace")


def commits(spark: SparkSession, root: str, most: int = 1000) -> DataFrame:
    """(commit_id, path) of the last commits below a folder, merges aside; empty commits don't count.

    The driver lists the names of at most ``most`` commits; tasks read what each
    of them changed, so all executors have to see the folder and its git store.
    """
    names = _git(root, "log", "--no-merges", "--format=%H", "-n", str(most), "--", ".").split()

    def read(batches):
        for pdf in batches:
            number = dict(zip(pdf["name"], pdf["commit_id"]))
            shown = _git(root, "show", "--name-only", "-z", "--relative", "--format=%x01%H", *number, "--", ".")
            rows = []
            for part in shown.split("\x01")[1:]:
                name, *paths = (p.strip("\n") for p in part.split("\0"))
                rows += [(number[name], p) for p in paths if p]
            yield pd.DataFrame(rows, columns=["commit_id", "path"]).astype({"commit_id": "int64"})

    listed = spark.createDataFrame(list(enumerate(names)), "commit_id long, name string")
    return listed.repartition(max(1, min(-(-len(names) // 50), spark.sparkContext.defaultParallelism))).mapInPandas(read, "commit_id long, path string")


def changed_files(spark: SparkSession, root: str, base: str = "HEAD") -> DataFrame:
    """(status, old_path, new_path) against a base, with untracked files as added."""
    parts = _git(root, "diff", "--name-status", "-z", "--find-renames", "--relative", base).split("\0")[:-1]
    rows, at = [], 0
    while at < len(parts):
        two = parts[at][:1] in "RC"
        rows.append(file_status(parts[at], parts[at + 1], parts[at + 2] if two else parts[at + 1]))
        at += 3 if two else 2
    known = {r[2] for r in rows}
    rows += [("added", None, p) for p in _git(root, "ls-files", "--others", "--exclude-standard", "-z").split("\0") if p and p not in known]
    return spark.createDataFrame(rows, "status string, old_path string, new_path string")


def changed_contents(spark: SparkSession, root: str, base: str = "HEAD") -> DataFrame:
    """``changed_files`` with old_content, of the base, and new_content, of the folder; null where there is none.

    Tasks read both, so all executors have to see the folder and its git store.
    Only source files are read.
    """
    prefix = _git(root, "rev-parse", "--show-prefix").strip()

    def read(batches):
        for pdf in batches:
            sources = [(after or before).rpartition(".")[2] in LANGUAGES for before, after in zip(pdf["old_path"], pdf["new_path"])]
            asked = [f"{base}:{prefix}{p}" if known and p and status != "added" else None for known, status, p in zip(sources, pdf["status"], pdf["old_path"])]
            new = []
            for known, status, after in zip(sources, pdf["status"], pdf["new_path"]):
                content = None
                if known and after and status != "deleted":
                    with open(os.path.join(root, after), "rb") as f:
                        content = f.read()
                new.append(content)
            yield pdf.assign(old_content=list(_blobs(root, asked)), new_content=new)

    listed = changed_files(spark, root, base).repartition(max(1, spark.sparkContext.defaultParallelism))
    return listed.mapInPandas(read, "status string, old_path string, new_path string, old_content binary, new_content binary")


def _blobs(root: str, names: list[str | None]):
    """The contents of named blobs, in order, from one git process; null for null."""
    with subprocess.Popen(["git", "-C", root, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as git:
        for name in names:
            if name is None:
                yield None
            elif "\n" in name:  # its protocol has a line a name
                yield subprocess.run(["git", "-C", root, "show", name], capture_output=True, check=True).stdout
            else:
                git.stdin.write(name.encode() + b"\n")
                git.stdin.flush()
                head = git.stdout.readline().split()
                if head[-1] == b"missing":
                    raise RuntimeError(f"git has no {name}")
                yield git.stdout.read(int(head[-1]) + 1)[:-1]
        git.stdin.close()
