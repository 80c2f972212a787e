"""Column functions on paths, source lines and names."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions and the language of each (fixed values).
LANGUAGES = {"scala": "scala", "sc": "scala", "rs": "rust", "rb": "ruby", "py": "python", "ts": "typescript", "tsx": "typescript"}
#: Folders that are never walked, and the store's own (fixed values).
SKIPPED_FOLDERS = [".git", "target", "node_modules", ".spindrift", ".venv", "venv", "__pycache__", ".tox", ".mypy_cache", ".pytest_cache"]
#: Larger files are not read: 1 MiB (a fixed value).
MOST_BYTES = 1 << 20
#: Folders of test code (fixed values).
TEST_FOLDERS = ["test", "tests", "spec", "specs", "__tests__"]
_IDENT = r"[\p{L}\p{N}_]"


def _plain_letters() -> tuple[str, str]:
    """Small Latin letters with marks, by their decompositions, and the letters that search takes them for; the marks themselves come last and stand for nothing."""
    found = {}
    for code in range(0xC0, 0x2000):
        base, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and "a" <= base <= "z" and all(unicodedata.combining(m) for m in marks):
            found[chr(code)] = base
    return "".join(found) + "".join(map(chr, range(0x300, 0x370))), "".join(found.values())


MARKED, PLAIN = _plain_letters()


def language_of(path: Column) -> Column:
    """The language by extension, case as written; null for other files."""
    ext = F.regexp_extract(path, r"\.([^./]+)$", 1)
    out = F
    for name, language in LANGUAGES.items():
        out = out.when(ext == name, F.lit(language))
    return out


def file_module(path: Column) -> Column:
    """The file's stem, or its folder's name where the stem stands for the folder."""
    parts = F.split(path, "/")
    file = F.element_at(parts, -1)
    stem = F.when(F.instr(file, ".") > 1, F.regexp_extract(file, r"^(.*)\.[^.]*$", 1)).otherwise(file)
    folder = F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(stem)
    return F.when(file.isin("mod.rs", "__init__.py", "index.ts", "index.tsx"), folder).otherwise(stem)


def last_segment(text: Column) -> Column:
    """The identifier that a path of an import ends in, after blanks, semicolons and underscores; may be empty."""
    return F.regexp_extract(F.regexp_replace(text, r"[;\s_]+$", ""), f"({_IDENT}*)$", 1)


def last_identifier(text: Column) -> Column:
    """The last identifier of a text, whatever punctuation follows it."""
    return F.regexp_extract(text, f"({_IDENT}+)[^\\p{{L}}\\p{{N}}_]*$", 1)


def signature_of(text: Column, limit: int = 200) -> Column:
    """A definition up to its first brace or line end, blanks collapsed, cut with an ellipsis."""
    head = F.trim(F.regexp_replace(F.regexp_extract(text, r"^[^{\n]*", 0), r"\s+", " "))
    return F.when(F.length(head) > limit, F.concat(F.rtrim(F.substring(head, 1, limit)), F.lit("…"))).otherwise(head)


def line_count(text: Column) -> Column:
    """Lines, without an empty one after a last line end."""
    return F.when(text == "", 0).otherwise(F.size(F.split(F.regexp_replace(text, r"\n\z", ""), "\n", -1)))


def token_estimate(text: Column) -> Column:
    """A quarter of the bytes, rounded up, and one for each line."""
    return F.ceil(F.octet_length(text) / 4).cast("long") + line_count(text)


def blob_hash(content: Column) -> Column:
    """Git's hash of a file's bytes."""
    data = content.cast("binary")
    return F.sha1(F.concat(F.concat(F.lit("blob "), F.octet_length(data).cast("string")).cast("binary"), F.lit(b"\x00"), data))


def is_test(path: Column, name: Column, hint: Column) -> Column:
    """Whether a symbol is test code by its own hint, its path, or its name in Python and Ruby."""
    low = F.lower(path)
    file = F.element_at(F.split(low, "/"), -1)
    own = F.lower(name)
    named = path.rlike(r"\.(py|rb)$") & (own.startswith("test_") | own.endswith("_test") | own.startswith("should_"))
    by_file = file.startswith("test_") | file.rlike(r"_test\.|\.test\.|_spec\.|\.spec\.")
    return F.coalesce(hint, F.lit(False)) | F.arrays_overlap(F.split(low, "/"), F.array(*map(F.lit, TEST_FOLDERS))) | by_file | named


def kind_synonyms(kind: str) -> list[str]:
    """The kinds that a kind in a query stands for."""
    if kind == "function":
        return ["function", "fn", "def", "method"]
    if kind in ("fn", "def", "method"):
        return [kind, "function"]
    if kind in ("module", "mod"):
        return ["module", "mod"]
    return [kind]


def search_tokens(text: Column) -> Column:
    """Words of letters and digits in small letters, without marks."""
    return F.regexp_extract_all(F.translate(F.lower(text), MARKED, PLAIN), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
