"""Files to chunks: one chunk up to 8,000 characters, else blocks by language, else windows by size. No shuffle."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltloom.functions.paths import language_of
from siltloom.functions.text import SPACE, chunk_embed_text, strip
from siltloom.sources.batches import SLICE_BYTES, bounded_batches, slices

SIZE, OVERLAP = 8000, 400
LEAST_CUT = SIZE // 3
HEADER_LINES, HEADER_ROOM = 5, 50

# Line patterns that begin a block.
LINE_PATTERNS = {
    "python": r"^(class |def |\s{0,4}def |\s{0,4}async def )",
    "javascript": r"^(function |const \w+ = |export (default |async )?function |class )",
    "typescript": r"^(function |const \w+ = |export (default |async )?function |class |interface |type \w+ =)",
    "csharp": r"^\s*(public|private|protected|static).*\{$",
    "go": r"^func ",
} | dict.fromkeys(
    ("html", "xml", "jsp"),
    r"(?i)^\s*</(div|section|article|table|tr|form|body|html|head|component|template|mapper|beans|bean|servlet|filter|script|style)\s*>",
)
JAVA_MEMBER = re.compile(
    r"\s*(public|private|protected|static|final|abstract|synchronized|native|strictfp|default|volatile|transient|class|interface|enum|record|import|package)\b"
)
_SQL_PARTS = re.compile(r"--[^\n]*|/\*.*?(?:\*/|\Z)|'(?:[^'\\]|\\[^\n]|\\(?=\n|\Z))*(?:'|\Z)|\"(?:[^\"\\]|\\[^\n]|\\(?=\n|\Z))*(?:\"|\Z)|;", re.S)
_JSON_PARTS = re.compile(r'\\\n*[^\n]?|["{}\[\]\n]')

Chunk = tuple[int, str]


def windows(text: str, room: int = SIZE) -> Iterator[Chunk]:
    """Windows of ``room`` characters that overlap by 400, cut behind their last line feed if that leaves over a third of 8,000.

    Blank windows count but aren't given. A last window of over room - 400 characters is followed by one of its overlap.
    """
    at = n = 0
    while at < len(text):
        end = at + room
        if end < len(text) and (cut := text.rfind("\n", at, end) + 1) - at > LEAST_CUT:
            end = cut
        yield n, text[at:end]
        at, n = end - OVERLAP, n + 1


def by_size(text: str) -> list[Chunk]:
    return [(n, part) for n, w in windows(text) if (part := w.strip(SPACE))]


def with_header(block: str, header: str, position: int) -> list[Chunk]:
    """Windows of a large block, each led by the block's first lines. A header that leaves no window longer than two overlaps is cut."""
    header = header[: SIZE - HEADER_ROOM - 2 * OVERLAP]
    return [(position + n, f"{header}\n...\n{w.strip(SPACE)}".strip(SPACE)) for n, w in windows(block, SIZE - HEADER_ROOM - len(header))]


def blocks(lines: list[str], starts: list[int]) -> list[Chunk]:
    out: list[Chunk] = []
    for a, b in zip(starts, [*starts[1:], len(lines)]):
        block = "\n".join(lines[a:b]).strip(SPACE)
        if len(block) > 2 * SIZE:
            out += with_header(block, "\n".join(lines[a : min(a + HEADER_LINES, b)]).strip(SPACE), a)
        elif block:
            out.append((a, block))
    return out


def sql_starts(text: str, lines: list[str]) -> list[int]:
    """A block ends behind a line with a semicolon outside strings and comments, but not inside BEGIN ... END, nor on the first line."""
    line_at = [0]
    for line in lines:
        line_at.append(line_at[-1] + len(line) + 1)
    inside: set[int] = set()  # lines that begin in a string or block comment
    ended: set[int] = set()
    i = 0
    for m in _SQL_PARTS.finditer(text):
        while line_at[i + 1] <= m.start():
            i += 1
        if m[0] == ";":
            ended.add(i)
        elif not m[0].startswith("--"):
            j = i + 1
            while j < len(lines) and line_at[j] < m.end():
                inside.add(j)
                j += 1
            if m.end() == len(text) and j < len(lines):
                inside.add(j)
    starts, depth = [0], 0
    for i, line in enumerate(lines):
        word = line.strip().upper()
        if i not in inside:
            if word.startswith("BEGIN"):
                depth += 1
            elif word == "END" or word.startswith(("END;", "END ")):
                depth = max(0, depth - 1)
        if i and not depth and i in ended:
            starts.append(i + 1)
    return starts


def json_starts(text: str, lines: list[str]) -> list[int]:
    """A block ends behind a line that closes at depth 0 with a comma, brace or bracket."""
    starts, line, curly, square, quoted = [0], 0, 0, 0, False

    def ends() -> bool:
        return bool(line) and not curly and not square and not quoted and lines[line].strip().endswith((",", "}", "]"))

    for m in _JSON_PARTS.finditer(text + "\n"):
        c = m[0]
        if c[0] == "\\":
            for _ in range(c.count("\n")):
                if line < len(lines) and ends():
                    starts.append(line + 1)
                line += 1
        elif c == "\n":
            if line < len(lines) and ends():
                starts.append(line + 1)
            line += 1
        elif c == '"':
            quoted = not quoted
        elif not quoted:
            curly += (c == "{") - (c == "}")
            square += (c == "[") - (c == "]")
    return starts


def java_starts(lines: list[str]) -> list[int]:
    """A block begins at a member's line, or at the first of the annotation lines above it; blank and comment lines between don't matter."""
    starts, noted = [0], None
    for i, line in enumerate(lines):
        word = line.strip()
        if not word or word.startswith(("//", "/*", "*")):
            continue
        if word.startswith("@"):
            noted = i if noted is None else noted
            continue
        if JAVA_MEMBER.match(line):
            at = i if noted is None else noted
            if at > starts[-1]:
                starts.append(at)
        noted = None
    return starts


def chunk_text(text: str, language: str) -> list[Chunk]:
    """(position, text) of a file's chunks."""
    if not text or len(text) <= SIZE:
        return [(0, text)] if text is not None else []
    lines = text.split("\n")
    if language == "sql":
        starts = sql_starts(text, lines)
    elif language == "json":
        starts = json_starts(text, lines)
    elif language == "java":
        starts = java_starts(lines)
    elif language in LINE_PATTERNS:
        begins = re.compile(LINE_PATTERNS[language])
        starts = [0, *(i for i, line in enumerate(lines) if i and begins.match(line))]
    else:
        starts = [0]
    return blocks(lines, starts) if len(starts) > 1 else by_size(text)


def _safe(text: str, language: str) -> tuple[list[Chunk], str | None]:
    try:
        return chunk_text(text, language), None
    except Exception as e:  # a file that fails is set apart, with its reason; the run goes on
        return [], f"{type(e).__name__}: {e}"


KEYS = ["repo", "branch", "file_path", "language"]


def _chunked(files: DataFrame) -> DataFrame:
    """One pass: (repo, branch, file_path, language, position, text, error), a row a chunk, and one with the reason for a file that fails. Small files pass as they are;
    of large ones about SLICE_BYTES of chunks are held at a time. Contents that are null give no rows; they aren't filtered before, as Spark would derive a content once more for that.
    """
    bounded_batches(files.sparkSession)
    f = files.select("repo", "branch", "file_path", language_of(F.col("file_path")).alias("language"), F.col("content").alias("text"))
    fields = [*f.schema.fields[:4], T.StructField("position", T.IntegerType()), f.schema["text"], T.StructField("error", T.StringType())]

    return f.mapInArrow(_chunk_batches, T.StructType(fields))


def _chunk_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        texts = part.column("text")
        size = pc.utf8_length(texts)
        small = part.filter(pc.less_equal(size, SIZE))
        if small.num_rows:
            yield _rows(small, np.arange(small.num_rows), np.zeros(small.num_rows, np.int32), small.column("text"), [None] * small.num_rows)
        of, position, text, error, held = [], [], [], [], 0
        for i in np.flatnonzero(pc.fill_null(pc.greater(size, SIZE), False).to_numpy(zero_copy_only=False)).tolist():
            found, failed = _safe(texts[i].as_py(), part.column("language")[i].as_py())
            for p, t in found if failed is None else [(None, None)]:
                of.append(i), position.append(p), text.append(t), error.append(failed)
                held += 128 + len(t or "")
                if held >= SLICE_BYTES:
                    yield _rows(part, of, position, text, error)
                    of, position, text, error, held = [], [], [], [], 0
        if of:
            yield _rows(part, of, position, text, error)


def _rows(part: pa.RecordBatch, of: Sequence[int], position: Sequence[int], text: Sequence[str] | pa.Array, error: list[str | None]) -> pa.RecordBatch:
    own = part.select(KEYS).take(pa.array(of, pa.int64()))
    return pa.RecordBatch.from_arrays([*own.columns, pa.array(position, pa.int32()), text if isinstance(text, pa.Array) else pa.array(text, part.column("text").type), pa.array(error, pa.string())], [*KEYS, "position", "text", "error"])


def chunk_files(files: DataFrame) -> DataFrame:
    """Files (repo, branch, file_path, content) to the chunk table. Only files over 8,000 characters are looked into."""
    c = _chunked(files).where("error is null").drop("error")
    none = lambda *names: {n: F.lit(None).cast("string") for n in names}
    embed = chunk_embed_text(*map(F.col, ("repo", "branch", "file_path", "language", "text")))
    return c.withColumn("embed_text", embed).withColumns(none("entity_id", "ast_type", "ast_name", "ast_signature"))


def chunk_rejects(files: DataFrame) -> DataFrame:
    """Files that couldn't be split, with the reason."""
    return _chunked(files).where("error is not null").select("repo", "branch", "file_path", "error")


def line_blocks(content: Column, begins: Callable[[Column], Column]) -> Column:
    """Blocks of a text that begin at line 0 and at every later line that ``begins``: array of (position, text), stripped, without blank ones.

    Steps are elements of an array of one, which the next step's lambda reads in place: a filter or an explosion on columns would have Spark derive them anew.
    """
    split = F.transform(F.array(content), lambda c: F.split(c, "\n", -1))
    start = lambda lines: F.filter(F.transform(lines, lambda x, i: F.when((i == 0) | begins(x), i)), lambda i: i.isNotNull())
    placed = F.transform(split, lambda lines: F.struct(lines.alias("lines"), start(lines).alias("starts")))
    ends = lambda s: F.concat(F.slice(s["starts"], 2, F.greatest(F.size(s["starts"]), F.lit(1))), F.array(F.size(s["lines"])))
    text = lambda s, a, b: strip(F.array_join(F.slice(s["lines"], a + 1, b - a), "\n"))
    found = F.transform(placed, lambda s: F.filter(F.zip_with(s["starts"], ends(s), lambda a, b: F.struct(a.alias("position"), text(s, a, b).alias("text"))), lambda x: x["text"] != ""))
    return F.get(found, F.lit(0))


def split_by_line_pattern(files: DataFrame, language: str | None = None) -> DataFrame:
    """Blocks (repo, branch, file_path, position, text) of files over 8,000 characters, by built-in functions; files where no line but the first begins a
    block are left to the split by size. Without ``language`` that of each row holds (column ``language``), so that all are read in one pass."""

    def begins(line: Column) -> Column:
        if language is not None:
            return line.rlike(LINE_PATTERNS[language])
        of: dict[str, list[str]] = {}
        for name, pattern in LINE_PATTERNS.items():
            of.setdefault(pattern, []).append(name)
        out = F.lit(False)
        for pattern, names in of.items():
            out = F.when(F.col("language").isin(*names), line.rlike(pattern)).otherwise(out)
        return out

    large = F.transform(F.array(F.col("content")), lambda c: F.when(F.length(c) > SIZE, c))
    some = F.transform(F.array(line_blocks(F.get(large, F.lit(0)), begins)), lambda b: F.when(F.size(b) > 1, b))
    return files.select("repo", "branch", "file_path", F.inline_outer(F.get(some, F.lit(0)))).where("position is not null")
