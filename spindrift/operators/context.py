"""Context packs: the best matches of a query with a few neighbours each, as far as a budget goes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import token_estimate
from .search import search
from .upkeep import fit_budget

#: Seeds of a pack, and neighbours of each in each direction (fixed values).
SEEDS, NEIGHBOURS = 8, 3
_COLUMNS = ("name", "qualified_name", "signature", "doc_first_line")


def seeds(symbols: DataFrame, query: str, include_tests: bool = False, columns: tuple = _COLUMNS, most: int = SEEDS) -> DataFrame:
    """The best matches of any term, with ``bm25`` and their place ``seed``; ties by rank, then id."""
    hits = search(symbols, query, columns, match_all=False)
    hits = hits if include_tests else hits.where(~F.col("is_test"))
    order = [F.round("bm25", 9), F.desc("rank"), "id"]
    return hits.orderBy(*order).limit(most).withColumn("seed", F.row_number().over(Window.orderBy(*order)))  # at most so many rows


def neighbours(found: DataFrame, symbols: DataFrame, edges: DataFrame, include_tests: bool = False, most: int = NEIGHBOURS) -> DataFrame:
    """(seed, relationship, id, edge_kind, place) of each seed's first callers and callees by rank, file, line and id; of several edge kinds the least."""
    rows = symbols if include_tests else symbols.where(~F.col("is_test"))
    rows = rows.select("id", "rank", "file", "start_line")
    out = None
    for relation, here, there in (("caller", "dst_symbol", "src_symbol"), ("callee", "src_symbol", "dst_symbol")):
        near = edges.join(found.select(F.col("id").alias(here), "seed"), here).groupBy("seed", F.col(there).alias("id")).agg(F.min("kind").alias("edge_kind"))
        place = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("rank"), "file", "start_line", "id"))
        best = near.join(rows, "id").withColumn("place", place).where(F.col("place") <= most)
        best = best.select("seed", F.lit(relation).alias("relationship"), "id", "edge_kind", "place")
        out = best if out is None else out.union(best)
    return out


def pack(symbols: DataFrame, edges: DataFrame, query: str, budget: int = 2000, include_tests: bool = False) -> DataFrame:
    """(seed, id, content, cost, used): one text for each seed, the longest prefix of them that fits the budget."""
    found = seeds(symbols, query, include_tests)
    packs = blocks(found, symbols, edges, include_tests).select("seed", "id", F.col("text").alias("content"))
    return fit_budget(packs.withColumn("cost", token_estimate(F.col("content"))), budget, "seed")


def blocks(found: DataFrame, symbols: DataFrame, edges: DataFrame, include_tests: bool = False) -> DataFrame:
    """``found`` with ``text``: a line for the seed, and one for each of its neighbours."""
    place = F.concat("file", F.lit(":L"), F.col("start_line").cast("string"), F.lit("  "))
    arrow = F.when(F.col("relationship") == "caller", "  <- ").otherwise("  -> ")
    line = F.concat(arrow, place, F.col("name"), F.lit("  ("), F.col("edge_kind"), F.lit(")"))
    near = neighbours(found, symbols, edges, include_tests).join(symbols, "id").select("seed", F.struct((F.col("relationship") == "callee").alias("after"), "place", line.alias("text")).alias("n"))
    lists = near.groupBy("seed").agg(F.array_sort(F.collect_list("n")).alias("near"))
    own = F.concat(place, F.coalesce("signature", "name"))
    lines = F.concat(F.array(own), F.coalesce(F.transform("near", lambda n: n["text"]), F.array().cast("array<string>")))
    return found.join(lists, "seed", "left").withColumn("text", F.array_join(lines, "\n")).drop("near")


def tokens_of(text: str) -> int:
    """A quarter of the bytes, rounded up, and one for each line."""
    return -(-len(text.encode()) // 4) + len(text.splitlines())


def render(symbols: DataFrame, hits: DataFrame, edges: DataFrame, services: DataFrame, files: DataFrame, query: str, budget: int = 2000, include_tests: bool = False) -> DataFrame:
    """(query, budget_tokens, seeds_shown, content) of the hits (id, bm25): services, seeds and neighbours, and a last line with the estimate.

    The most seeds that fit the budget, the last line and their services
    counted; if not even one does, an error; no row if there is no hit. At most
    ``SEEDS`` rows come to the driver, where the text is put together.
    """
    rows = symbols if include_tests else symbols.where(~F.col("is_test"))
    order = [F.round("bm25", 9), F.desc("rank"), "id"]
    found = rows.join(hits, "id").orderBy(*order).limit(SEEDS).withColumn("seed", F.row_number().over(Window.orderBy(*order)))
    sizes = files.groupBy("service").agg(F.count("*").alias("n_files"))
    known = services.select(F.col("name").alias("service"), F.coalesce("stack", F.lit("?")).alias("stack")).join(sizes, "service", "left")
    parts = blocks(found, symbols, edges, include_tests).join(known, "service", "left").select("seed", "service", F.coalesce("stack", F.lit("?")).alias("stack"), F.coalesce("n_files", F.lit(0)).alias("n_files"), "text").orderBy("seed").collect()
    best = None
    for shown in range(1, len(parts) + 1):
        text = _text(query, parts[:shown], len(parts), budget)
        if tokens_of(text) > budget:
            if best is None:
                raise ValueError(f"a budget of {budget} tokens is too small for one result (about {tokens_of(text)})")
            break
        best = (query, budget, shown, text)
    return symbols.sparkSession.createDataFrame([best] if best else [], "query string, budget_tokens long, seeds_shown long, content string")


def _text(query: str, parts: list, seeds: int, budget: int) -> str:
    """The pack of these seeds; its last line has the estimate for the whole, itself included."""
    about = sorted({(p["service"], p["stack"], p["n_files"]) for p in parts})
    body = "\n".join([f"# context: {query}", "## services", *[f"{name}  ({stack})  {n} files" for name, stack, n in about], "", "## symbols", *[p["text"] for p in parts]])
    more = " — raise --budget for more" if len(parts) < seeds else ""
    used, text = tokens_of(body), ""
    for _ in range(4):  # the estimate's own digits may change it
        text = f"{body}\n[~{used} tokens / budget {budget}; {len(parts)}/{seeds} seeds{more}]"
        if tokens_of(text) == used:
            break
        used = tokens_of(text)
    return text
