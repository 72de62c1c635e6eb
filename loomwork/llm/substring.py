"""Exact substring dedup with difference-cover anchors.

A repeat is a window of ``min_words`` words that also starts somewhere earlier, by (id, text hash,
word place); a document's spans are the union of its repeats. To find them without hashing every
window of the corpus, only anchors are: windows of ``min_words - PERIOD + 1`` words at places whose
remainder modulo PERIOD lies in a difference cover. For any two places the cover has a shift under
PERIOD at which both lie on it, so any two equal windows of ``min_words`` words share an aligned
anchor. Anchors that occur twice are then extended: every full window that holds one is hashed, and
windows that occur twice are the repeats, to the word.

A text that is the copy of another as a whole is a repeat from end to end without any of this.

Scale: the anchors (a fifth of the words, 20 bytes each) are shuffled once by hash, the texts once to
meet their repeated anchors, and full windows exist only where something repeats. Equal anchors and equal
windows are gathered in every slice of texts before they are shuffled: one of them goes by its hash, and
the others, of which it is known already that they repeat, by their document's. So a passage that any
number of documents share is at most one row a slice where its hash is sorted. Copies are found by their
texts' hashes, least ids first taken in each task; blank and short texts are in no group. Full windows
are told apart by 96 bits of hash, at which 10^13 of them have a false pair once in a thousand corpora.

Defined cases: a null text is an empty one, with no spans; a null id sorts first; rows equal in id and
text count as one document, so neither is a repeat of the other; rows of one id with different texts
are different documents; of windows that tie in id and text hash the first by place is the earlier; texts
under ``min_words`` words have no spans; a very long text is a slice of its own; an empty table gives no
rows. Columns beside the id and the text are never read, and ``remove`` returns them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._io import table
from ._words import Words, mix, slices, text_bytes

PERIOD = 31
#: Bytes of texts among which equal anchors and windows are gathered.
SLICE = 2 << 20
#: Every remainder modulo PERIOD is a difference of two of these.
COVER = (0, 1, 3, 8, 12, 18)
_SOLID = "[^ \\t\\n\\r\\x0b\\f]+"
_ON_COVER = np.isin(np.arange(PERIOD), COVER)


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), text.alias("text")).withColumns({"same": F.xxhash64("text"), "mark": F.hash("text")})


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of rows by keys, the first key first, and for each place in it where its group begins, a
    group being the rows equal in the first key, or pair of hashes."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = keys[0][order[1:]] != keys[0][order[:-1]]
    return order, np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))


def _anchors(width: int):
    """``h, same, place``: of equal anchors of a slice one goes under their hash, the others under their
    text's. ``place`` is below zero (-1 - place) if it is known already that the anchor occurs elsewhere."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", limit=SLICE):
                words = Words(part.column("text"))
                at = np.flatnonzero(_ON_COVER[words.place % PERIOD] & (words.left >= width))
                h, place = words.windows(at, width), words.place[at]
                same = part.column("same").to_numpy().view(np.uint64)[words.doc[at]]
                order, first = _groups(h, same, place)
                h, same, place = h[order], same[order], place[order]
                head = first == np.arange(len(first))
                again = ~head & (same == np.roll(same, 1)) & (place == np.roll(place, 1))  # a copied row is the same occurrence
                other = ~head & ~again
                many = other.copy()
                many[first[other]] = True
                h[other] = mix(same[other])
                place = np.where(many, -1 - place, place).astype(np.int32)
                keep = np.flatnonzero(~again)
                keep = keep[np.argsort(order[keep])]  # in the order of the texts, whose hashes then compress
                yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(same[keep].view(np.int64)), pa.array(place[keep])], ["h", "same", "place"])

    return work


def _windows(length: int, width: int):
    """``h, rest, doc, mark, place``: of equal windows of a slice the first goes under its hash, the others,
    which repeat it, under their document's, with a ``place`` below zero (-1 - place)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", limit=SLICE):
                words = Words(part.column("text"))
                places = part.column("places")
                row = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(places.offsets)))
                anchor = words.first[row] + places.flatten().to_numpy(zero_copy_only=False)
                low, high = words.first[row], words.first[row + 1] - length
                edge = np.zeros(len(words.hash) + 2, np.int64)
                ok = high >= low
                begin, end = np.maximum(anchor + width - length, low)[ok], np.minimum(anchor, high)[ok] + 1
                fits = begin < end
                np.add.at(edge, begin[fits], 1)
                np.add.at(edge, end[fits], -1)
                at = np.flatnonzero(np.cumsum(edge) > 0)
                h, half = words.windows(at, length), length // 2
                rest = (words.windows(at, half) ^ mix(words.windows(at + half, length - half))) >> np.uint64(32)
                of, place = words.doc[at], words.place[at]
                ids = part.column("doc")
                by_row = np.lexsort([part.column("mark").to_numpy(), ids.fill_null(0).to_numpy(), np.asarray(ids.is_valid())])
                rank = np.empty(len(by_row), np.int64)
                rank[by_row] = np.arange(len(by_row))
                order, first = _groups(h, rank[of], place)
                h, rest, of, place = h[order], rest[order], of[order], place[order]
                many = (first != np.arange(len(first))) & (rest == rest[first])
                doc, mark = ids.take(pa.array(of)), part.column("mark").take(pa.array(of))
                h[many] = mix(mark.to_numpy()[many].astype(np.uint64) ^ mix(doc.fill_null(0).to_numpy()[many].view(np.uint64)))
                rest[many] = 0
                place = np.where(many, -1 - place, place).astype(np.int32)
                back = np.argsort(order)  # in the order of the texts, whose ids then compress
                at = pa.array(back)
                yield pa.RecordBatch.from_arrays([pa.array(h[back].view(np.int64)), pa.array(rest[back].astype(np.int64)), doc.take(at), mark.take(at), pa.array(place[back])], ["h", "rest", "doc", "mark", "place"])

    return work


def _other(c: Column, here: Column) -> Column:
    """Whether another occurrence lies there; a copied row is the same occurrence."""
    return c.isNotNull() & ~c.eqNullSafe(here)


def _place() -> Column:
    return F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place"))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """``doc_id, mark, start_word, end_word``: maximal runs of words of a document that earlier repeats
    cover (end exclusive). ``mark`` is the text's 32-bit hash, which with the id names the document."""
    width = min_words - PERIOD + 1
    if width < 2:
        raise ValueError(f"min_words must be over {PERIOD}")
    keyed = keyed_texts(docs, id_col, text_col)
    here = F.struct("same", "place")
    by_hash = Window.partitionBy("h").orderBy("same", "place")
    places = (
        keyed.select("same", "text").mapInArrow(_anchors(width), "h long, same long, place int")
        .withColumns({"before": F.lag(here).over(by_hash), "after": F.lead(here).over(by_hash)})
        .where((F.col("place") < 0) | _other(F.col("before"), here) | _other(F.col("after"), here))
        .groupBy("same")
        .agg(F.collect_set(_place()).alias("places"))
    )
    # Copies of a text repeat all of it; only the first of them goes on to full windows.
    firsts = keyed.where("text != ''").groupBy("same").agg(F.min("doc").alias("least"), F.bool_or(F.col("doc").isNull()).alias("unnamed"), F.count("*").alias("n"))
    firsts = firsts.select(F.col("same").alias("key"), F.when(~F.col("unnamed"), F.col("least")).alias("first"), "n")
    chosen = places.join(firsts, F.col("same") == F.col("key")).select("key", "first", "places")
    is_first = (F.col("same") == F.col("key")) & F.col("doc").eqNullSafe(F.col("first"))
    found = keyed.join(chosen, is_first).select("doc", "mark", "text", "places")
    by_window = Window.partitionBy("h", "rest").orderBy("doc", "mark", "place")
    occurrence = F.struct("doc", "mark", "place")
    windows = found.mapInArrow(_windows(min_words, width), "h long, rest long, doc long, mark int, place int")
    repeats = windows.withColumn("origin", F.first(occurrence).over(by_window)).where((F.col("place") < 0) | _other(F.col("origin"), occurrence)).withColumn("place", _place())
    in_doc = Window.partitionBy("doc", "mark").orderBy("place")
    runs = repeats.select("doc", "mark", "place").withColumn("before", F.lag("place").over(in_doc))
    runs = runs.withColumn("run", F.count_if(F.col("before").isNull() | (F.col("place") > F.col("before") + min_words)).over(in_doc))
    runs = runs.groupBy("doc", "mark", "run").agg(F.min("place").alias("start_word"), (F.max("place") + min_words).alias("end_word")).drop("run")
    words = F.regexp_count("text", F.lit(_SOLID)).alias("end_word")
    copies = keyed.select("doc", "mark", "same", words).where(F.col("end_word") >= min_words)
    copies = copies.join(firsts.where("n > 1"), (F.col("same") == F.col("key")) & ~F.col("doc").eqNullSafe(F.col("first")))
    copies = copies.groupBy("doc", "mark").agg(F.lit(0).alias("start_word"), F.first("end_word").alias("end_word"))
    return runs.unionByName(copies).withColumnRenamed("doc", "doc_id").select("doc_id", "mark", "start_word", "end_word")


def _cut(text_col: str, length_col: str | None):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                k = part.schema.get_field_index(text_col)
                column, cuts = part.column(k), part.column("__lw_cuts")
                keep = np.ones(part.num_rows, bool)
                cut_rows = np.flatnonzero(np.asarray(cuts.is_valid()))
                if len(cut_rows):
                    words = Words(column)
                    raw, off = text_bytes(column)
                    texts = column.to_pylist()
                    for r in cut_rows:
                        kept, at = [], int(off[r])
                        for s in sorted(cuts[int(r)].as_py(), key=lambda s: s["start_word"]):
                            kept.append(raw[at : words.start[words.first[r] + s["start_word"]]].tobytes())
                            at = int(words.end[words.first[r] + s["end_word"] - 1])
                        texts[r] = b"".join([*kept, raw[at : off[r + 1]].tobytes()]).decode()
                        keep[r] = bool(texts[r].strip())
                    column = pa.array(texts, column.type)
                arrays = {n: part.column(n) for n in part.schema.names if n != "__lw_cuts"} | {text_col: column}
                if length_col and len(cut_rows):
                    arrays[length_col] = pa.compute.if_else(cuts.is_valid(), pa.compute.utf8_length(column).cast(arrays[length_col].type), arrays[length_col])
                yield pa.RecordBatch.from_pydict(arrays).filter(pa.array(keep))

    return work


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", min_words: int = 50) -> DataFrame:
    """The documents with their repeated spans cut out, so that each passage stays where it first
    occurs. A row left blank goes; a row without spans, one with a null text too, stays as it is.
    ``length_col``, if there is such a column, follows the text."""

    names = docs.columns
    length_col = length_col if length_col in names else None
    cuts = spans(docs, id_col, text_col, min_words).groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start_word", "end_word")).alias("__lw_cuts"))
    cuts = cuts.select(F.col("doc_id").alias("__lw_doc"), F.col("mark").alias("__lw_mark"), "__lw_cuts")
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("__lw_doc")) & (F.hash(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))) == F.col("__lw_mark"))
    joined = docs.join(cuts, same, "left").select(*(docs[f"`{n}`"] for n in names), "__lw_cuts")
    return joined.mapInArrow(_cut(text_col, length_col), docs.schema)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All repeated spans of 50 words or more in documents."""
    return spans(table(spark, sf_dir, "documents")).drop("mark")


#: Spans by all windows of 50 words, listed.
ORACLE = """
with d as (select distinct doc_id, coalesce(text, '') t from documents),
w as (select doc_id, t, list_filter(string_split_regex(t, '[ \\t\\n\\r\\x0b\\f]+'), lambda x: x <> '') ws from d),
h as (select doc_id, t, unnest(list_transform(range(1, len(ws) - 48), lambda i: md5(array_to_string(ws[i:i + 49], ' ')))) h,
  unnest(range(0, len(ws) - 49)) p from w where len(ws) >= 50),
r as (select *, row_number() over (partition by h order by doc_id nulls first, t, p) k from h),
g as (select *, lag(p) over (partition by doc_id, t order by p) before from r where k > 1),
n as (select *, count(*) filter (before is null or p > before + 50) over (partition by doc_id, t order by p) run from g)
select doc_id, min(p)::int start_word, (max(p) + 50)::int end_word from n group by doc_id, t, run
"""
