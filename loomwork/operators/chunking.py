"""Chunkers. Windows and packing are expressions over one row; headings are read by a fold in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls
from ..functions.safety import check_chunking
from ._rows import per_row

SECTIONS = "section int, heading string, level int, path string, parents array<string>, body string"


def _windows(words: Column, start: Column, size: Column | int) -> Column:
    return F.array_join(F.slice(words, start + 1, size), " ")


def text_windows(docs: DataFrame, text: str = "content", url: str = "url", size: int = 1000, overlap: int = 200) -> DataFrame:
    """Word windows of plain texts. Adds ``position, id, chunk, word_count, char_count, domain``; a
    text without words has no rows."""
    check_chunking(size, overlap)
    width, step = size // 5, size // 5 - overlap // 5
    rows = docs.withColumn("_w", T.words(F.col(text))).where(F.size("_w") > 0)
    starts = F.sequence(F.lit(0), F.size("_w") - 1, F.lit(step))
    rows = rows.select(*docs.columns, "_w", F.posexplode(starts).alias("position", "_s"))
    rows = rows.select(*docs.columns, "position", F.slice("_w", F.col("_s") + 1, width).alias("_w"), "_s").withColumn("chunk", F.array_join("_w", " "))
    return rows.select(
        *docs.columns, "position", F.md5(F.concat(F.col(url), F.lit(":text:"), F.col("_s").cast("string"))).alias("id"), "chunk",
        F.size("_w").alias("word_count"), F.length("chunk").alias("char_count"), urls.host(F.col(url)).alias("domain"),
    )


def sliding(docs: DataFrame, text: str = "content", size: int = 1000, overlap: int = 200) -> DataFrame:
    """Windows of as many words as make ``size`` characters in the text at hand. Adds ``position, chunk``."""
    rows = docs.withColumn("_w", T.words(F.col(text))).where(F.size("_w") > 0)
    chars = F.length(F.col(text))
    width = F.greatest(F.floor(F.lit(size) * F.size("_w") / chars).cast("int"), F.lit(1))
    rows = rows.withColumn("_n", width).withColumn("_step", F.col("_n") - F.least(F.floor(F.lit(overlap) * F.size("_w") / chars).cast("int"), F.col("_n") - 1))
    starts = F.sequence(F.lit(0), F.size("_w") - 1, F.col("_step"))
    return rows.select(*docs.columns, "_w", "_n", F.posexplode(starts).alias("position", "_s")).select(*docs.columns, "position", _windows(F.col("_w"), F.col("_s"), F.col("_n")).alias("chunk"))


def recursive(docs: DataFrame, text: str = "content", size: int = 1000, overlap: int = 200) -> DataFrame:
    """Paragraphs packed up to ``size`` characters, each chunk opening with the last ``overlap`` of the
    one before; a long single paragraph slides. Adds ``position, chunk``."""
    rows = docs.where(F.length(text) > 0).withColumn("_p", F.split(F.col(text), r"\n\s*\n"))
    short, one = F.length(text) <= size, F.size("_p") == 1
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))
    tail = lambda x: F.substr(x, F.greatest(F.length(x) - overlap + 1, F.lit(1)))
    fold = F.aggregate(
        "_p",
        empty,
        lambda a, p: F.when(
            (a["now"] != "") & (F.length(a["now"]) + F.length(p) + 2 > size),
            F.struct(F.concat(a["done"], F.array(a["now"])).alias("done"), F.concat(tail(a["now"]), F.lit("\n\n"), p).alias("now")),
        ).otherwise(F.struct(a["done"].alias("done"), F.when(a["now"] == "", p).otherwise(F.concat(a["now"], F.lit("\n\n"), p)).alias("now"))),
        lambda a: F.when(a["now"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["now"]))),
    )
    packed = rows.where(short | ~one).withColumn("_c", F.when(short, F.array(text)).otherwise(fold))
    packed = packed.select(*docs.columns, F.posexplode("_c").alias("position", "chunk"))
    return packed.unionByName(sliding(rows.where(~short & one).select(*docs.columns), text, size, overlap))


def _headings(line: str) -> tuple[int, str] | None:
    bare = line.lstrip(" ")
    level = len(bare) - len(bare.lstrip("#"))
    if len(line) - len(bare) > 3 or not 1 <= level <= 6 or bare[level : level + 1] != " ":
        return None
    return level, bare[level + 1 :].strip()


def _sections(markdown: str) -> Iterator[tuple[str, int, str, list[str], str]]:
    open_: list[tuple[int, str]] = []
    head: tuple[str, int, str, list[str]] | None = None
    body: list[str] = []
    for line in markdown.split("\n"):
        if found := _headings(line):
            if head:
                yield *head, "".join(body)
            level, name = found
            open_ = [h for h in open_ if h[0] < level]
            head, body = (line, level, " > ".join([*(h[1] for h in open_), name]), ["#" * k + " " + h for k, h in open_]), [line + "\n"]
            open_.append(found)
        elif head:
            body.append(line + "\n")
        elif line.strip():
            head, body = ("Document Start", 0, "Document Start", []), [line + "\n"]
    if head:
        yield *head, "".join(body)


def sections(docs: DataFrame, markdown: str = "content") -> DataFrame:
    """A row for each heading's section: its line, level, path, its parents' lines and its text with the
    heading, beside the other columns. What precedes the first heading is ``Document Start``."""
    return per_row(docs, markdown, _sections, SECTIONS)


def semantic(docs: DataFrame, markdown: str = "content", url: str = "url", size: int = 1000, overlap: int = 200) -> DataFrame:
    """Sections as chunks; long ones in word windows, of which the later ones open with the headings
    above them. Beside the other columns, the section's columns and ``position, id, chunk, word_count, char_count,
    chunk_type, domain``; a section's ``position`` is null if it is whole."""
    check_chunking(size, overlap)
    width, step = size // 5, size // 5 - overlap // 5
    kept = [c for c in docs.columns if c != markdown]
    rows = sections(docs, markdown).withColumn("_w", T.words(F.col("body")))
    whole = F.length("body") <= size
    rows = rows.select("*", F.explode(F.when(whole, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.size("_w") - 1, F.lit(step)))).alias("_s"))
    part = F.slice("_w", F.greatest("_s", F.lit(0)) + 1, width)
    joined = F.array_join(part, " ")
    above = F.concat(F.col("parents"), F.when(F.startswith(joined, F.col("heading")), F.array().cast("array<string>")).otherwise(F.array("heading")))
    later = F.when((F.col("_s") > 0) & (F.size(above) > 0), F.concat(F.array_join(above, "\n"), F.lit("\n\n"), joined)).otherwise(joined)
    rows = rows.withColumn("chunk", F.when(F.col("_s") < 0, F.col("body")).otherwise(later))
    name = F.concat(F.col(url), F.lit(":"), F.col("path"), F.when(F.col("_s") >= 0, F.concat(F.lit(":"), F.col("_s").cast("string"))).otherwise(F.lit("")))
    return rows.select(
        *kept, "section", "heading", "level", "path", "parents", F.when(F.col("_s") >= 0, F.floor(F.col("_s") / step).cast("int")).alias("position"), F.md5(name).alias("id"), "chunk",
        F.when(F.col("_s") < 0, F.size("_w")).otherwise(F.size(part)).alias("word_count"), F.length("chunk").alias("char_count"),
        F.when(F.col("_s") < 0, F.lit("section")).otherwise(F.lit("content_chunk")).alias("chunk_type"), urls.host(F.col(url)).alias("domain"),
    )


def chunk(docs: DataFrame, text: str = "content", url: str = "url", size: int = 1000, overlap: int = 200) -> DataFrame:
    """Markdown by sections, other texts by windows: ``id, chunk, chunk_type`` beside the URL."""
    marked = F.col(text).rlike("(?m)^#+ ")
    rows = docs.where(F.length(text) > 0).select(F.col(url).alias("url"), F.col(text).alias("text"))
    md = semantic(rows.where(marked), "text", "url", size, overlap).select("url", "id", "chunk", "chunk_type")
    plain = text_windows(rows.where(~marked), "text", "url", size, overlap).select("url", "id", "chunk", F.lit("text_chunk").alias("chunk_type"))
    return md.unionByName(plain)


def _split_point(text: str, at: int) -> int:
    for mark in ("\n\n", "\n"):
        if (k := text.find(mark, at)) >= 0:
            return k + len(mark)
    for k in range(at, len(text)):
        if text[k] in ".!?":
            k += 1
            while k < len(text) and text[k].isspace():
                k += 1
            return k
    return next((k + 1 for k in range(at, len(text)) if text[k].isspace()), at)


def breaks(docs: DataFrame, markdown: str = "content", size: int = 1000, overlap: int = 200) -> DataFrame:
    """Chunks that end at headings or, once over ``size`` characters, at the next paragraph, line,
    sentence or word after ``size - overlap``. Adds ``position, heading, level, chunk``."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("the size must be positive and the overlap less than it")

    def fold(value: str) -> Iterator[tuple[str | None, int, str]]:
        held, heading, level = "", None, 0
        for line in value.splitlines():
            bare = line.lstrip("#")
            k = len(line) - len(bare)
            if 1 <= k <= 6 and bare[:1].isspace() and bare.strip():
                if held:
                    yield heading, level, held
                heading, level, held = bare.strip(), k, line
                continue
            held = f"{held}\n{line}" if held else line
            if len(held) > size:
                cut = _split_point(held, size - overlap)
                yield heading, level, held[:cut]
                held = held[cut:].strip()
        if held:
            yield heading, level, held

    return per_row(docs, markdown, fold, "position int, heading string, level int, chunk string")
