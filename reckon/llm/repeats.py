"""Removal of long repeated byte strings, by enhanced suffix arrays of anchored segments.

1. Every text is cut into segments by anchors (anchors.py); equal windows of LENGTH bytes lie at the same place of segments with the
   same gram. Tasks add up equal segments before the shuffle. A segment that occurs twice is repeated as a whole.
2. Segments that occur once, but share their gram, are compared: all segments of a gram are sorted by what follows the gram (a sparse
   suffix array), a stack scan of the common prefix lengths gives the tree of intervals, and in each interval the occurrences are
   ordered by what precedes the gram. Two that agree for r bytes to the right and l to the left repeat a string of
   l + GRAM + r bytes; all occurrences in the interval take part, not just neighbours.
3. Grams with more than GROUP segments are not gathered: their windows are hashed one by one and counted.
4. The covered spans go to their documents; only texts that lose bytes are shuffled.

Null and empty texts have no bytes; texts shorter than LENGTH lose none. Repeated rows are documents of their own, so each repeats the
other and long ones lose everything, wherever they stand. Only doc_id and text are read; hashes are 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reckon.llm.anchors import GRAM, LENGTH, segments
from reckon.llm.shared import arrow, bitmap, in_bitmap, written
from reckon.llm.textbytes import Chunk, chunks, column

GROUP = 16_384
TEXT_AT_ONCE = 1 << 19
SEGMENTS_AT_ONCE = 500_000
ROW_BITS, SEGMENT_BITS = 23, 24
WHOLE = (1 << 31) - 1


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def common_prefixes(strings: list[bytes], order: list[int], width: int) -> np.ndarray:
    """Length of the common prefix of each string of the order with the one before; 0 for the first."""
    table = np.empty((len(strings), width + 1), np.int32)
    table[:] = 256 + np.arange(len(strings))[:, None]  # ends differ from everything
    for row, k in enumerate(order):
        table[row, : len(strings[k])] = np.frombuffer(strings[k], np.uint8)
    out = np.zeros(len(strings), np.int64)
    out[1:] = (table[1:] != table[:-1]).argmax(1)
    return out


def intervals(prefixes: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of the intervals of a suffix array that share a prefix of that length, from the leaves up, the root last."""
    stack = [(0, 0)]
    for i in range(1, len(prefixes) + 1):
        value = int(prefixes[i]) if i < len(prefixes) else -1
        first = i - 1
        while stack and stack[-1][0] > value:
            length, first = stack.pop()
            yield length, first, i - 1
        if value >= 0 and (not stack or stack[-1][0] < value):
            stack.append((value, first))


def covers(segments_of_gram: list[tuple[int, bytes]], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """For segments (offset of the gram, bytes) of one gram: the part [from, to) that repeats in others; empty if none."""
    need = length - gram
    right = [data[offset + gram :] for offset, data in segments_of_gram]
    left = [data[:offset][::-1] for offset, data in segments_of_gram]
    size = len(segments_of_gram)
    by_right = sorted(range(size), key=right.__getitem__)
    by_left = sorted(range(size), key=left.__getitem__)
    left_prefixes = common_prefixes(left, by_left, need)
    rank = np.empty(size, np.int64)
    rank[by_left] = np.arange(size)
    rank_by_right = rank[by_right]
    most_left, most_right = np.full(size, -1), np.full(size, -1)  # by rank
    for follows, first, last in intervals(common_prefixes(right, by_right, need)):
        if last == first:
            continue
        members = np.sort(rank_by_right[first : last + 1])
        # common left extension of neighbours in left order: the least prefix between them
        between = np.minimum.reduceat(left_prefixes[: members[-1] + 1], members[:-1] + 1)
        precedes = np.zeros(len(members), np.int64)
        precedes[1:] = between
        precedes[:-1] = np.maximum(precedes[:-1], between)
        good = precedes + follows >= need
        found = members[good]
        most_left[found] = np.maximum(most_left[found], precedes[good])
        most_right[found] = np.maximum(most_right[found], follows)
    offset = np.array([o for o, _ in segments_of_gram])
    repeats = most_left[rank] >= 0
    return np.where(repeats, offset - most_left[rank], 0), np.where(repeats, offset + gram + most_right[rank], 0)


class Repeats:
    """The job for one table; length and gram are parameters."""

    def __init__(self, documents: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP):
        self.length, self.gram, self.group = length, gram, group
        self.documents = documents.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))

    def counted(self) -> DataFrame:
        """(gram, segment, n, row): occurrences of each segment in a task and one row that holds it."""
        length, gram = self.length, self.gram

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[np.ndarray, ...]] = []

            def flush() -> pa.RecordBatch:
                grams, named, rows = (np.concatenate(part) for part in zip(*held, strict=True))
                held.clear()
                _, first, n = np.unique(named, return_index=True, return_counts=True)
                columns = [_long(grams[first]), _long(named[first]), pa.array(n), pa.array(rows[first])]
                return pa.RecordBatch.from_arrays(columns, names=["gram", "segment", "n", "row"])

            for batch in batches:
                row = column(batch, "row").to_numpy()
                for chunk in chunks(column(batch, "text"), TEXT_AT_ONCE):
                    found = segments(chunk, length, gram)
                    held.append((found.gram, found.segment, row[chunk.rows][found.doc]))
                    if sum(len(part[0]) for part in held) > SEGMENTS_AT_ONCE:
                        yield flush()
            if held:
                yield flush()

        return arrow(self.documents.select("text", "row"), run, "gram long, segment long, n long, row long")

    def shared(self) -> DataFrame:
        """(gram, segment, n, row) of the grams that occur twice, with the number of their segments and the least n of these."""
        dealt = self.counted().repartition("gram")
        each = dealt.groupBy("gram", "segment").agg(F.sum("n").alias("n"), F.min("row").alias("row"))
        of_gram = Window.partitionBy("gram")
        each = each.withColumns({"kinds": F.count("*").over(of_gram), "least": F.min("n").over(of_gram)})
        return written(each.where("kinds > 1 OR n > 1"))

    def fetched(self, wanted: DataFrame) -> DataFrame:
        """(gram, segment, once, offset, data) of wanted segments, read again from the rows that hold them."""
        length, gram = self.length, self.gram
        rows, names = bitmap(wanted.select("row"), ROW_BITS), bitmap(wanted.select("segment"), SEGMENT_BITS)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                batch = batch.filter(pa.array(in_bitmap(rows, column(batch, "row").to_numpy())))
                for chunk in chunks(column(batch, "text"), TEXT_AT_ONCE):
                    found = segments(chunk, length, gram)
                    take = np.flatnonzero(in_bitmap(names, found.segment))
                    raw = chunk.data.tobytes()
                    data = [raw[a:b] for a, b in zip(found.start[take], found.end[take], strict=True)]
                    columns = [_long(found.segment[take]), pa.array(found.offset[take], pa.int32()), pa.array(data, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["segment", "offset", "data"])

        read = arrow(self.documents.select("text", "row"), run, "segment long, offset int, data binary")
        return wanted.select("gram", "segment", (F.col("n") == 1).alias("once")).join(read.dropDuplicates(["segment"]), "segment")

    def partly(self, few: DataFrame) -> DataFrame:
        """(segment, lo, hi) of segments that occur once and repeat in part, by the interval tree of each gram."""
        length, gram = self.length, self.gram

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, members = None, []

            def close() -> pa.RecordBatch:
                lo, hi = covers([(offset, data) for _, _, offset, data in members], length, gram)
                out = [(m[0], int(a), int(b)) for m, a, b in zip(members, lo, hi, strict=True) if m[1] and b > a]
                kinds = (pa.int64(), pa.int32(), pa.int32())
                return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kinds[k]) for k in range(3)], names=["segment", "lo", "hi"])

            for batch in batches:
                names = ("gram", "segment", "once", "offset", "data")
                for key, *member in zip(*(column(batch, name).to_pylist() for name in names), strict=True):
                    if key != own:
                        if len(members) > 1:
                            yield close()
                        own, members = key, []
                    members.append(member)
            if len(members) > 1:
                yield close()

        dealt = few.repartition("gram").sortWithinPartitions("gram")
        return arrow(dealt, run, "segment long, lo int, hi int")

    def counted_windows(self, many: DataFrame) -> DataFrame:
        """(segment, lo, hi) as partly() gives it, from hashes of all windows of the segments."""
        length = self.length

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                segment = column(batch, "segment").to_numpy()
                for n, data in enumerate(column(batch, "data").to_pylist()):
                    one = Chunk(np.frombuffer(data, np.uint8), np.array([0, len(data)]), 0)
                    begin = np.arange(len(data) - length + 1)
                    columns = [_long(one.hashes(begin, begin + length)), pa.array(np.full(len(begin), segment[n])), pa.array(begin, pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, names=["window", "segment", "at"])

        windows = arrow(many.select("segment", "data"), run, "window long, segment long, at int")
        twice = windows.groupBy("window").agg(F.min("segment").alias("one"), F.max("segment").alias("other")).where("one != other")
        spans = windows.join(twice, "window").groupBy("segment")
        return spans.agg(F.min("at").alias("lo"), (F.max("at") + length).cast("int").alias("hi"))

    def spans(self) -> DataFrame:
        """(row, spans): the repeated parts [from, to) of each row that has any, in bytes; they may overlap."""
        length, gram = self.length, self.gram
        shared = self.shared()
        whole = shared.where("n > 1").select("segment", F.lit(0).alias("lo"), F.lit(WHOLE).alias("hi"))
        wanted = shared.where("kinds > 1 AND least = 1")
        covered = whole.union(self.partly(self.fetched(wanted.where(F.col("kinds") <= self.group))))
        if not (hot := wanted.where(F.col("kinds") > self.group)).isEmpty():
            covered = covered.union(self.counted_windows(self.fetched(hot)))
        covered = written(covered.groupBy("segment").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))
        names = bitmap(covered.select("segment"), SEGMENT_BITS)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row = column(batch, "row").to_numpy()
                for chunk in chunks(column(batch, "text"), TEXT_AT_ONCE):
                    found = segments(chunk, length, gram)
                    take = np.flatnonzero(in_bitmap(names, found.segment))
                    begin = found.start[take] - chunk.offsets[found.doc[take]]
                    size = (found.end - found.start)[take]
                    columns = [pa.array(row[chunk.rows][found.doc[take]]), _long(found.segment[take]), pa.array(begin), pa.array(size)]
                    yield pa.RecordBatch.from_arrays(columns, names=["row", "segment", "begin", "size"])

        placed = arrow(self.documents.select("text", "row"), run, "row long, segment long, begin long, size long")
        placed = placed.join(covered, "segment")
        span = F.struct((F.col("begin") + F.col("lo")).alias("from"), (F.col("begin") + F.least("hi", "size")).alias("to"))
        return placed.select("row", span.alias("span")).groupBy("row").agg(F.collect_set("span").alias("spans"))

    def removed(self, with_text: bool = False) -> DataFrame:
        """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with_text what is left as text, of every row."""
        spans = written(self.spans())
        losing = bitmap(spans.select("row"), ROW_BITS)

        def split(loses: bool):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    hit = in_bitmap(losing, column(batch, "row").to_numpy())
                    yield batch.filter(pa.array(hit == loses))

            return arrow(self.documents, run, self.documents.schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                spans_of = column(batch, "spans").to_pylist()
                for chunk in chunks(column(batch, "text"), TEXT_AT_ONCE):
                    out = []
                    for k in range(chunk.n):
                        data = chunk.data[chunk.offsets[k] : chunk.offsets[k + 1]]
                        steps = np.zeros(len(data) + 1, np.int64)
                        for span in spans_of[chunk.first + k] or ():
                            steps[span["from"]] += 1
                            steps[span["to"]] -= 1
                        gone = np.cumsum(steps)[:-1] > 0
                        kept = data[~gone].tobytes()
                        begins = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
                        row = [len(data), int(gone.sum()), begins, hashlib.sha256(kept).hexdigest()]
                        out.append(row + [kept.decode("utf-8", "ignore")] * with_text)
                    kinds = [pa.int64()] * 3 + [pa.string()] * 2
                    columns = [pa.array(values, kind) for values, kind in zip(zip(*out, strict=True), kinds, strict=False)]
                    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]
                    columns = [column(batch, "doc_id").slice(chunk.first, chunk.n), *columns]
                    yield pa.RecordBatch.from_arrays(columns, names=names[: len(columns)])

        none = F.lit(None).cast(spans.schema["spans"].dataType)
        kind = self.documents.schema["doc_id"].dataType.simpleString()
        schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text string" * with_text
        with_spans = arrow(split(True).join(spans, "row", "left").select("doc_id", "text", "spans"), run, schema)
        return arrow(split(False).select("doc_id", "text", none.alias("spans")), run, schema).unionByName(with_spans)


def op9_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return Repeats(spark.read.parquet(f"{folder}/documents.parquet")).removed(with_text=True)
