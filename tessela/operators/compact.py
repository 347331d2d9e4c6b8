"""Far too many small files: consolidation into few sorted files of good size.

The tiny files are read once, many to a task, and each task writes its records as
one sorted run. Key ranges of a few files' size are cut from the runs' keys, and
for each run it is noted which rows belong to which range. A range is then merged
k ways: its slices of the sorted runs are streamed through a heap, which always
takes from the run with the least key as many rows as come before the next run's.
Nothing is sorted twice and nothing is shuffled but the list of slices. Outputs are
rolled by the bytes written, and the manifest records each file's key range.
Nothing is removed: copies of a record stay, and removal of repeats is the
reader's choice.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
import json
import math
import re
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StringType

from tessela.operators.nested import json_list
from tessela.storage import materialise, remove, scratch_path

_SPREAD = "__spread"  # the column of a run that continues its keys
_WIDTH = "__width"  # the column of a run with the bytes of a row before compression
_FILES = 8  # files of a range, about: so many even files come close to the target size whatever the range's size is

#: A JSON object whose braces balance, up to one object within it. All loops are
#: possessive: they neither backtrack nor recurse, whatever the text's length. A
#: string may not span lines, so a cut record can't swallow the next one.
_STRING = r'"(?:[^"\\\r\n]++|\\.)*+"'
_FLAT = r'\{(?:[^{}"]++|' + _STRING + r")*+\}"
RECORD = r'\{(?:[^{}"]++|' + _STRING + "|" + _FLAT + r")*+\}"
#: Three objects open at once: what ``RECORD`` can't match as a whole.
_DEEP = r'\{(?:[^{}"]++|' + _STRING + "|" + _FLAT + r')*+\{(?:[^{}"]++|' + _STRING + r")*+\{"
_TOKENS, _BRACE = re.compile(_STRING + r'|[{}"]'), re.compile(r"[{}]")
_ID, _HOLDER = re.compile(r'"id"\s*:'), re.compile(r'"scribbles"\s*:')


def _nested_records(text: str) -> list[str]:
    """All records of a text, with objects in them to any depth, in one scan that keeps the open braces on a stack.

    A quote whose string doesn't end on its line is a cut, which breaks every
    open object. The outermost complete object with an id is a record; one with
    ``scribbles``, without id, or that is no JSON is looked into. What a record
    that is cut off holds is no record, but one that begins a later line is.
    """

    def cut() -> None:
        """Ends the open objects; of what lies in a record among them, only what begins a line stays."""
        inside, first = False, 0
        kept: list[tuple[int, int, list]] = []
        for (start, before), after in zip(stack, [*(b for _, b in stack[1:]), len(spans)]):
            own = text[start + 1 : next((m.start() for m in _BRACE.finditer(text, start + 1)), len(text))]
            inside = not _HOLDER.search(own) and (inside or _ID.search(own) is not None)
            kept += spans[first:before]
            kept += [x for x in spans[before:after] if not inside or text[x[0] - 1] in "\r\n"]
            first = after
        spans[:] = kept + spans[first:]
        stack.clear()

    spans: list[tuple[int, int, list]] = []
    stack: list[tuple[int, int]] = []  # an open brace, and how many spans were complete before it
    for token in _TOKENS.finditer(text):
        mark = token[0]
        if mark == "{":
            stack.append((token.start(), len(spans)))
        elif mark == '"':
            cut()
        elif mark == "}" and stack:
            start, before = stack.pop()
            inside = spans[before:]
            del spans[before:]
            spans.append((start, token.end(), inside))
    cut()
    out, todo = [], spans[::-1]
    while todo:
        start, end, inside = todo.pop()
        if not _ID.search(text, start, end):
            continue
        try:
            value = json.loads(text[start:end], strict=False)
            whole = value.get("id") is not None and not isinstance(value.get("scribbles"), list)
        except (ValueError, RecursionError):
            whole = False
        if whole:
            out.append(text[start:end])
        else:
            todo += inside[::-1]
    return out


@F.pandas_udf(ArrayType(StringType()))
def _deep_records(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for block in texts:
        yield block.map(lambda t: None if t is None else _nested_records(t))


def run_dir(path: Column, anchor: str = "interactive_runs/") -> Column:
    """The path between ``anchor`` and the file name, repeated slashes taken as one."""
    clean = F.regexp_replace(path, "/+", "/")
    return F.regexp_extract(clean, anchor + "(.*)/[^/]*$", 1)


def file_index(path: Column, index: Column) -> Column:
    """``index``, else the number that ends the file name before its extensions, else -1."""
    digits = F.regexp_extract(path, r"(?:^|/)[^/.]*?([0-9]+)(?:\.[^/]*)?$", 1)
    return F.coalesce(index, F.when(digits != "", digits.cast("int")), F.lit(-1))


def complete_records(content: Column) -> Column:
    """All complete records of a text, in JSON lines, a list or an object, even if the text is cut.

    Marks of encoding, mixed line ends and what stands between records are
    passed over; a record that is cut off, or has no id, is none. Texts with
    objects nested more deeply than ``RECORD`` matches are scanned in Python.
    """
    headless = F.regexp_replace(content, r'^[^{\["]*\{\s*"scribbles"\s*:\s*\[', "")
    deep = headless.rlike(_DEEP)
    objects = F.when(deep, _deep_records(F.when(deep, content))).otherwise(F.regexp_extract_all(content, F.lit(RECORD), F.lit(0)))
    opened = F.flatten(
        F.transform(objects, lambda o: F.coalesce(json_list(F.get_json_object(o, "$.scribbles")), F.array(o)))
    )
    rows = F.transform(
        opened,
        lambda o: F.struct(F.get_json_object(o, "$.id").cast("int").alias("scribble_id"), o.alias("record")),
    )
    return F.filter(rows, lambda r: r["scribble_id"].isNotNull())


def state_records(files: DataFrame) -> DataFrame:
    """``run_dir, checkpoint_index, scribble_id, record, path`` of every complete record; repeats stay.

    Null and empty contents have no records. Only the four columns ``path``,
    ``checkpoint_index``, ``content`` are read; others may have any name.
    """
    return files.select(
        run_dir(F.col("path")).alias("run_dir"),
        file_index(F.col("path"), F.col("checkpoint_index")).alias("checkpoint_index"),
        F.col("path"),
        F.inline(complete_records(F.col("content"))),
    ).select("run_dir", "checkpoint_index", "scribble_id", "record", "path")


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's address, and its path there; addresses without a scheme, or of ``file:``, are local paths."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1)) if "://" in path else (fs.LocalFileSystem(), path)


def _sort_keys(batch: pa.RecordBatch | pa.Table, keys: Sequence[str]) -> list[tuple]:
    """The rows' keys in an order that Python shares with the runs: null first, then by value, then by spread."""
    parts = []
    for k in keys:
        column = batch.column(k)
        values = column.to_pylist()
        if column.null_count:
            some = next((v for v in values if v is not None), 0)
            values = [some if v is None else v for v in values]
            parts.append(column.is_valid().to_pylist())
        else:
            parts.append(itertools.repeat(True, len(values)))
        parts.append(values)
    return list(zip(*parts, batch.column(_SPREAD).to_pylist()))


def _slices(keys: Sequence[str], bounds: list[tuple]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each run: which of its rows belong to which range; only the keys are read, a row group at a time."""
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, at = _file_system(path)
                with system.open_input_file(at) as f:
                    file = pq.ParquetFile(f)
                    found: dict[int, list[int]] = {}  # range to first row, rows, width
                    row = 0
                    for g in range(file.num_row_groups):
                        group = file.read_row_group(g, columns=[*keys, _SPREAD, _WIDTH])
                        order = _sort_keys(group, keys)
                        upto = np.cumsum([0, *group.column(_WIDTH).to_numpy()])
                        pos, r = 0, bisect.bisect_right(bounds, order[0]) if order else 0
                        while pos < len(order):
                            end = bisect.bisect_left(order, bounds[r], pos) if r < len(bounds) else len(order)
                            if end > pos:
                                own = found.setdefault(r, [row + pos, 0, 0])
                                own[1] += end - pos
                                own[2] += int(upto[end] - upto[pos])
                            pos, r = end, r + 1
                        row += len(order)
                rows = [(r, path, *own) for r, own in found.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["range", "path", "first", "n", "width"])

    return run


def _read_slice(path: str, first: int, n: int, rows: int) -> Iterator[pa.RecordBatch]:
    """The ``n`` rows of a run from row ``first`` on, some ``rows`` at a time; only the row groups that hold them are read."""
    system, at = _file_system(path)
    with system.open_input_file(at) as f:
        file = pq.ParquetFile(f)
        sizes = [file.metadata.row_group(g).num_rows for g in range(file.num_row_groups)]
        ends = list(itertools.accumulate(sizes))
        groups = [g for g, (end, size) in enumerate(zip(ends, sizes)) if end > first and end - size < first + n]
        skip = first - (ends[groups[0]] - sizes[groups[0]]) if groups else 0
        for batch in file.iter_batches(batch_size=rows, row_groups=groups):
            part = batch.slice(skip, n)
            skip = max(0, skip - batch.num_rows)
            n -= part.num_rows
            if part.num_rows:
                yield part
            if not n:
                return


def _merged(slices: list[tuple[str, int, int]], keys: Sequence[str], rows: int) -> Iterator[tuple[pa.RecordBatch, int, int]]:
    """The k-way merge of slices of sorted runs: pieces (batch, first row, rows) in the order of the keys, equal keys in the order of the runs."""
    sources = [_read_slice(path, first, n, rows) for path, first, n in slices]
    heads: list[list] = [None] * len(sources)  # a run's batch, its keys, and the place in it
    heap: list[tuple[tuple, int]] = []

    def advance(i: int) -> None:
        batch = next(sources[i], None)
        if batch is not None:
            heads[i] = [batch, _sort_keys(batch, keys), 0]
            heapq.heappush(heap, (heads[i][1][0], i))

    for i in range(len(sources)):
        advance(i)
    while heap:
        _, i = heapq.heappop(heap)
        batch, order, at = heads[i]
        end = len(order)
        if heap:
            least, j = heap[0]
            end = (bisect.bisect_right if i < j else bisect.bisect_left)(order, least, at)
            end = max(end, at + 1)
        yield batch, at, end - at
        if end < len(order):
            heads[i][2] = end
            heapq.heappush(heap, (order[end], i))
        else:
            advance(i)


def _gathered(pieces: list[tuple[pa.RecordBatch, int, int]]) -> pa.Table:
    """The rows of the pieces, in order, in one table; of each batch the stretch in use is copied once."""
    batches: dict[int, list] = {}
    for batch, at, n in pieces:
        own = batches.setdefault(id(batch), [batch, at, 0])
        own[2] = at + n  # a batch's pieces come in its order
    parts, shift, start = [], {}, 0
    for key, (batch, low, high) in batches.items():
        parts.append(batch.slice(low, high - low))
        shift[key] = start - low
        start += high - low
    if len(parts) == 1:
        return pa.Table.from_batches(parts)
    n = np.array([x for _, _, x in pieces])
    first = np.array([shift[id(b)] + at for b, at, _ in pieces])
    index = np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
    return pa.Table.from_batches(parts).combine_chunks().take(pa.array(index))


class _Files:
    """The files of one range, rolled by the bytes written.

    What is left is shared evenly: the width of the rows to come, times the
    bytes that a unit of width has taken so far, gives the number of files and
    the size of the next. Names and contents don't depend on the attempt, so a
    repeated task does no harm; a file appears under its name when it is whole.
    """

    def __init__(self, out: str, number: int, keys: Sequence[str], schema: pa.Schema, target: int, width: int, packed: float) -> None:
        self.system, self.folder = _file_system(out)
        self.number, self.keys, self.schema, self.target = number, list(keys), schema, target
        self.left, self.read, self.written, self.packed = width, 0, 0, packed
        self.made: list[tuple] = []
        self.writer = None

    def share(self) -> tuple[int, int]:
        """How many files are to come, the present one included, and how large it should be."""
        size = self.left * (self.written / self.read if self.written else self.packed)
        files = max(1, round(size / self.target))
        return files, max(1, int(size / files))

    def write(self, table: pa.Table) -> None:
        if self.writer is None:
            self.files, self.limit = self.share()
            self.hidden = f"{self.folder}/.{uuid.uuid4().hex}"
            self.sink = self.system.open_output_stream(self.hidden)
            self.writer = pq.ParquetWriter(self.sink, self.schema, compression="snappy", write_statistics=self.keys)
            self.rows, self.width, self.least = 0, 0, table.slice(0, 1).select(self.keys).to_pylist()[0]
        before = self.sink.tell()
        self.writer.write_table(table.select(self.schema.names).cast(self.schema, safe=False))
        self.rows += table.num_rows
        self.width += int(np.sum(table.column(_WIDTH).to_numpy()))
        self.greatest = table.slice(table.num_rows - 1).select(self.keys).to_pylist()[0]
        size = self.sink.tell()
        # Enough if the next row group would overshoot by more than this one falls short.
        if size + (size - before) // 2 >= self.limit and (self.files > 1 or size >= 1.5 * self.limit):
            self.close()

    def close(self) -> None:
        if self.writer is None:
            return
        self.writer.close()
        self.sink.close()
        name, size = f"part-{self.number:06d}-{len(self.made):04d}.parquet", self.system.get_file_info(self.hidden).size
        if self.system.get_file_info(f"{self.folder}/{name}").type != fs.FileType.NotFound:
            self.system.delete_file(f"{self.folder}/{name}")
        self.system.move(self.hidden, f"{self.folder}/{name}")
        self.made.append((name, self.rows, size, self.least, self.greatest))
        self.left, self.read, self.written = self.left - self.width, self.read + self.width, self.written + size
        self.writer = None


def _merge_ranges(keys: Sequence[str], schema: pa.Schema, out: str, target: int, packed: float):
    span = pa.struct([schema.field(k) for k in keys])
    kinds = (pa.string(), pa.int64(), pa.int64(), span, span)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Merge each range and write its files; ``packed`` is the bytes that a unit of width takes in the runs."""
        for batch in batches:
            for row in batch.to_pylist():
                slices = sorted((s["path"], s["first"], s["n"]) for s in row["slices"])
                files = _Files(out, row["range"], keys, schema, target, sum(s["width"] for s in row["slices"]), packed)
                rows = sum(n for _, _, n in slices)
                chunk = max(1, min(8192, rows // (16 * files.share()[0])))  # rows of a row group, after which the bytes written are looked at
                pieces, held = [], 0
                for source, at, n in _merged(slices, keys, max(64, min(8192, (1 << 20) // len(slices)))):
                    while n:
                        part = min(n, chunk - held)
                        pieces.append((source, at, part))
                        held, at, n = held + part, at + part, n - part
                        if held == chunk:
                            files.write(_gathered(pieces))
                            pieces, held = [], 0
                if held:
                    files.write(_gathered(pieces))
                files.close()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*files.made), kinds)], names=["file", "rows", "bytes", "least", "greatest"])

    return run


def consolidate(
    df: DataFrame, keys: Sequence[str], out_path: str | None = None, target_bytes: int = 128 << 20
) -> tuple[str, DataFrame]:
    """Write ``df`` sorted by ``keys`` in files of about ``target_bytes``; return the folder and its manifest.

    Keys are integers, texts, dates, times or booleans, nulls first; ``ValueError``
    for fractions. Runs carry a hash of their rows and places, which continues the
    keys, so that a hot key, or copies of one row without end, spread over ranges
    and files too. Ranges are cut from a sample of the runs' keys (some 100 a
    range, by hash), which only decides how even they are. A range holds about 8
    files' bytes, shared evenly; a task streams its slices in small batches, so its memory is
    bounded by the number of runs and not by the range. The manifest holds file,
    rows, bytes, and the least and greatest key. An empty table gives an empty
    folder and manifest.
    """
    if wrong := [k for k in keys if dict(df.dtypes)[k] in ("double", "float")]:
        raise ValueError(f"keys can't be fractions: {wrong}")
    spark = df.sparkSession
    out = out_path or scratch_path(spark, "consolidated")
    names, order = df.columns, [*[F.col(k).asc_nulls_first() for k in keys], F.col(_SPREAD)]
    runs = scratch_path(spark, "runs")
    spread = F.xxhash64(*[F.col(f"`{c}`") for c in names], F.monotonically_increasing_id())
    width = sum((F.coalesce(F.octet_length(f"`{c}`"), F.lit(0)) if kind in ("string", "binary") else F.lit(8) for c, kind in df.dtypes), F.lit(0))
    seen = Observation()
    marked = df.withColumns({_SPREAD: spread, _WIDTH: width.cast("long")}).observe(seen, F.sum(_WIDTH).alias("width"))
    marked.sortWithinPartitions(*order).write.option("parquet.block.size", 4 << 20).parquet(runs)
    system, folder = _file_system(out)
    system.create_dir(folder)
    schema = to_arrow_schema(df.schema)
    runs_system, runs_folder = _file_system(runs)
    found = [f for f in runs_system.get_file_info(fs.FileSelector(runs_folder)) if f.path.endswith(".parquet")]
    total = sum(f.size for f in found)
    ranges = max(1, round(total / (_FILES * target_bytes)))
    bounds: list[tuple] = []
    if ranges > 1:
        some = spark.read.parquet(runs).select(*keys, _SPREAD)
        share = max(1, some.count() // (100 * ranges))
        sample = some.where(F.pmod(F.col(_SPREAD), F.lit(share)) == 0).orderBy(*order).toArrow()
        picked = sorted({round(i * sample.num_rows / ranges) for i in range(1, ranges)} - {0, sample.num_rows})
        bounds = _sort_keys(sample.take(pa.array(picked, pa.int64())), keys)
    files = spark.createDataFrame([(f"{runs}/{f.base_name}",) for f in found], "path string")
    tasks = max(1, min(len(found), 4 * spark.sparkContext.defaultParallelism, 10_000))
    slices = files.repartition(tasks).mapInArrow(_slices(keys, bounds), "range int, path string, first long, n long, width long")
    plan = slices.groupBy("range").agg(F.collect_list(F.struct("path", "first", "n", "width")).alias("slices")).repartition(ranges, "range")
    span = "struct<" + ",".join(f"{k}:{kind}" for k, kind in df.select(*keys).dtypes) + ">"
    made = plan.mapInArrow(_merge_ranges(list(keys), schema, out, target_bytes, total / max(1, seen.get["width"] or 1)), f"file string, rows long, bytes long, least {span}, greatest {span}")
    made = materialise(made, "manifest")
    remove(spark, runs)
    return out, made
