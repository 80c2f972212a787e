"""Symbols and references out of source files.

A file is scanned once, in a task (``lexer``): one row for each statement that
may define something, with its tokens, span and comment, and one for each name
that is called, extended or imported. All else is narrow Spark SQL on these
rows: patterns say which statements define what, and nothing but the symbols is
shuffled, to number them within their file.
"""

from __future__ import annotations

from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import language_of, last_segment, signature_of
from ..sources.scratch import written
from . import lexer

_RUST = r"^(?:pub (?:\( \) )?)?"
_ANGLES = r"< (?:[^<>]|<(?:[^<>]|<[^<>]*>)*>)* ?>"
_SCALA = r"^(?:(?:private|protected|final|sealed|abstract|implicit|lazy|override|inline|open|transparent|infix|opaque|case)(?: \[ \])? |@ [\w$]+ (?:\( \) )?)*"
_NAME = r"([\w$]+|`[^`]+`)"
_TS_WORDS = r"(?!(?:if|for|while|switch|catch|with|function|return|else|do|new|await|typeof|super|import) )"
#: Definitions, on a statement's tokens with a blank between them and nothing in brackets: kind, and a pattern with the name as its group.
DEFINITIONS = {
    "rust": [
        ("fn", rf'{_RUST}(?:(?:default|const|async|unsafe|extern|") )*fn ((?:r#)?\w+) .*[{{}}]$'),
        *[(k, rf"{_RUST}{k} ((?:r#)?\w+)") for k in ("struct", "enum", "mod")],
        ("type", rf"{_RUST}type (\w+) .*= "),
        ("trait", rf"{_RUST}(?:unsafe )?(?:auto )?trait (\w+)"),
        ("const", rf"{_RUST}const (\w+) :"),
        ("static", rf"{_RUST}static (?:mut )?(\w+) :"),
        ("impl", rf"^(?:unsafe |default )*impl (?:{_ANGLES} )?(?:(?:! )?[^{{]+? for )?(?!(?:[iu](?:8|16|32|64|128|size)|f32|f64|bool|char|str) )(\w+) (?:where [^{{]*)?\{{"),
    ],
    "scala": [
        *[(k, rf"{_SCALA}{k} {_NAME}") for k in ("object", "class", "trait", "def", "type")],
        *[(k, rf"{_SCALA}{k} {_NAME} (?:: (?:[^=]|=>)*)?= ") for k in ("val", "var")],
    ],
    "ruby": [("class", r"^class ([A-Z]\w*)(?: <.*| ;.*)?$"), ("module", r"^module ([A-Z]\w*)(?: ;.*)?$"), ("method", r"^def (?:(?:self|\w+) \. )?([\p{Ll}_]\w*[?!]?)(?: .*)?$")],
    "python": [("class", r"^class (\w+)"), ("def", r"^(?:async )?def (\w+)")],
    "typescript": [
        ("class", r"^class (?!extends |implements )([\w$]+) .*\}$"),
        ("interface", r"^interface ([\w$]+) .*\}$"),
        ("enum", r"^(?:const )?enum ([\w$]+) \{"),
        ("type", r"^type ([\w$]+) (?:< .* > )?="),
        ("function", r"^(?:async )?function ([\w$]+) .*\}$"),
        ("function", r"^let ([\w$]+) (?:! )?(?:: .*?)?= (?:async )?(?:function (?!\*)|(?:< .*? > )?\( \) (?:: .*?)?=>|[\w$]+ =>)"),
        ("method", rf"^(?:(?:public|private|protected|static|override|readonly|async|get|set|\*) )*{_TS_WORDS}([\w$]+) (?:\? )?(?:< .* > )?\( \) (?:: .+ )?\{{ \}}$"),
    ],
}
_ROW = [("file", pa.string()), ("language", pa.string()), ("role", pa.string()), ("start_line", pa.int64()), ("start_col", pa.int64()), ("end_line", pa.int64()), ("end_col", pa.int64()), ("head", pa.string()), ("text", pa.string()), ("comment", pa.string()), ("on_line", pa.string()), ("above", pa.list_(pa.string())), ("name", pa.string()), ("mark", pa.string()), ("qualifier", pa.string())]
_SCHEMA = "file string, language string, role string, start_line long, start_col long, end_line long, end_col long, head string, text string, comment string, on_line string, above array<string>, name string, mark string, qualifier string"


def _known(files: DataFrame) -> DataFrame:
    """(file, language, content) of files (path, content) in a known language, content decoded with replacement."""
    text = F.coalesce(F.make_valid_utf8(F.col("content").cast("string")), F.lit(""))
    return files.select(F.col("path").alias("file"), language_of(F.col("path")).alias("language"), text.alias("content")).where("language is not null")


def source_lines(files: DataFrame) -> DataFrame:
    """(file, language, line, raw) of files (path, content) in a known language."""
    rows = _known(files).select("file", "language", F.posexplode(F.split("content", "\n", -1)).alias("line", "raw"))
    return rows.select("file", "language", (F.col("line") + 1).cast("long").alias("line"), "raw")


def _rows(file: str, language: str, content: str):
    """A file's rows, as lists in the order of the columns."""
    t = lexer.Tokens(content, language, file.endswith(".tsx"))
    found = lexer.definitions(t)
    for first, last, lead, head in found:
        begin, end = t.start[first], t.end[last]
        row, col = t.line(begin), t.column(begin)
        line_end = content.find("\n", begin)
        text = content[begin : min(end, line_end if line_end >= 0 else end, begin + 4000)]
        note = t.comments.get(lead)
        comment = content[note[0] : note[1]].split("\n", 1)[0] if note else None
        at = t.lines[row - 1]
        above = [content[t.lines[k] : t.lines[k + 1]].strip()[:400] for k in range(row - 2, max(-1, row - 7), -1)]
        yield [file, language, "def", row, col, t.line(end - 1), t.column(end - 1) + 1, head, text, comment, content[at : line_end if line_end >= 0 else None][:4000], above, None, None, None]

    def named(role: str, i: int, mark=None, qualifier=None):
        at = t.start[i]
        return [file, language, role, t.line(at), t.column(at), None, None, None, None, None, None, None, t.text[i], mark, qualifier]

    for i in lexer.calls(t):
        mark = t.before(i) if t.before(i) in (".", "?.", "&.", "::") else None
        yield named("call", i, mark, lexer.qualifier(t, i) if mark and language != "ruby" else None)
    for i in lexer.parents(t, found):
        yield named("extends", i)
    for line, text in lexer.imports(t):
        yield [file, language, "import", line, None, None, None, None, None, None, None, None, text, None, None]


#: So many rows of a file are sent at once.
_AT_ONCE = 2000


def _scan(batches):
    for b in batches:
        for k in range(b.num_rows):  # one text at a time, and some rows of it
            found = _rows(*(c[k].as_py() for c in b.columns))
            while rows := list(islice(found, _AT_ONCE)):
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, (_, kind) in zip(zip(*rows), _ROW)], [name for name, _ in _ROW])


def _definition() -> Column:
    """(kind, name) of a statement, null if it defines nothing."""
    out = F
    for language, patterns in DEFINITIONS.items():
        mine = F
        head = F.replace(F.col("head"), F.lit("->"), F.lit("~"))
        for kind, pattern in patterns:
            mine = mine.when(head.rlike(pattern), F.struct(F.lit(kind).alias("kind"), F.regexp_extract(head, pattern, 1).alias("name")))
        out = out.when(F.col("language") == language, mine)
    return out


def _hint() -> Column:
    """Whether marks of a test stand on a definition's line before its body, or in the block of marks right above it."""
    marker = r"(?i)#\[test\]|::test\]|cfg\(test|@test|@pytest"
    note = lambda l: l.rlike(r"^(#\[|@)")
    skip = lambda l: (l == "") | l.startswith("//") | l.startswith("#")
    step = lambda s, l: F.struct((s["go"] & (note(l) | skip(l))).alias("go"), (s["found"] | (s["go"] & note(l) & l.rlike(marker))).alias("found"))
    noted = F.aggregate("above", F.struct(F.lit(True).alias("go"), F.lit(False).alias("found")), step)["found"]
    return F.substring_index("on_line", "{", 1).rlike(marker) | noted


def _comment() -> Column:
    """A comment's first line without its marks; null if nothing is left."""
    text = F.trim(F.regexp_replace(F.regexp_replace("comment", r"^(///)*(/\*\*)*(/\*)*(//)*#*\**", ""), r"(\*/)+\s*$", ""))
    return F.nullif(F.when(F.length(text) > 200, F.concat(F.substring(text, 1, 200), F.lit("…"))).otherwise(text), F.lit(""))


def extract(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbols, references) of files with ``path`` and ``content``.

    Symbols: file, language, id (in the order of the source), name, kind,
    start_line, start_col, end_line, end_col, signature, doc_first_line, hint.
    References: file, line, col, dst_name, qualifier, scoped, kind. Columns count
    from 0, and an end is behind its last character. Files in other languages,
    null and empty ones give nothing. The scan is written once, for both.
    """
    scan = written(_known(files).mapInArrow(_scan, _SCHEMA), "scan", batch_rows=8)
    defs = scan.where("role = 'def'").withColumn("def", _definition()).where("def is not null")
    number = F.row_number().over(Window.partitionBy("file").orderBy("start_line", "start_col", F.desc("end_line"), F.desc("end_col"))).cast("long")
    symbols = defs.select("file", "language", number.alias("id"), "def.name", "def.kind", "start_line", "start_col", "end_line", "end_col", signature_of(F.col("text")).alias("signature"), _comment().alias("doc_first_line"), _hint().alias("hint"))
    whole = (F.col("role") == "import") & (F.col("language") != "typescript")
    names = scan.where("role <> 'def'").select(
        "file", F.col("start_line").alias("line"), F.col("start_col").alias("col"), F.when(whole, last_segment(F.col("name"))).otherwise(F.col("name")).alias("dst_name"), "qualifier",
        (F.coalesce(F.col("mark") == "::", F.lit(False)) & F.col("qualifier").isNotNull()).alias("scoped"), F.col("role").alias("kind"),
    )
    return symbols, names.where("dst_name <> ''")
