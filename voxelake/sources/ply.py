"""PLY files as a data source: ASCII and both binary byte orders, scalar and list properties.

`spark.dataSource.register(PlySource)` once, then `spark.read.format("ply").load(path)`; options: `path` (a file, a
folder or several, separated by commas), `element` (vertex or face; default vertex), `rows_per_split`,
`bytes_per_split`.  Vertices give x, y, z, nx, ny, nz (normals (1, 0, 0) where the file has none); faces give vertex_indices
as integers.  A large file is read by many tasks: fixed-size binary elements by ranges of rows, binary faces that are
triangles throughout (by the size of the file; each length is checked) likewise, and an ASCII element that is the only one with
rows, one row a line, by ranges of bytes.  Binary faces with lists of any length are cut by `polygon_ranges`, which `read`
runs before: where a row begins depends on all rows before it, so tasks scan ranges of bytes for every place in which a row may
begin there, and what they find is put together from the first range on.  Splits asked for that come to more than
MOST_SPLITS grow, up to the default size.  Other ASCII files and elements with lists are
read by one task each.

`df.write.format("ply").mode("append").save(folder)` is the distributed sink: one little-endian file for each partition, named
in the order of the partitions and published by the driver after all tasks are done, so a task that runs again leaves
nothing double.  `write` makes a single file of such parts.  Files are opened through pyarrow's filesystems, so a path may be
local or any URI that pyarrow reaches from the executors.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from voxelake.sources.shared import root, work_dir

# The format's type names, old and new.
TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2",
    "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8",
}
VERTEX = "x float, y float, z float, nx float, ny float, nz float"
FACE = "vertex_indices array<long>"
BATCH = 1 << 16
#: Splits of the default size, and how many splits smaller ones may come to: beyond, they grow up to that size, as a task costs
#: more than a few KB.
SPLIT_ROWS, SPLIT_BYTES, MOST_SPLITS = 1 << 20, 64 << 20, 512


class PlyError(ValueError):
    pass


@dataclass
class Element:
    name: str
    count: int
    #: (name, type, type of the length or None)
    properties: list[tuple[str, str, str | None]] = field(default_factory=list)

    @property
    def fixed(self) -> bool:
        return all(n is None for _, _, n in self.properties)

    def dtype(self, order: str) -> np.dtype:
        return np.dtype([(n, order + t if t[1] != "1" else t) for n, t, _ in self.properties])


@dataclass
class Header:
    format: str
    elements: list[Element]
    size: int

    @property
    def order(self) -> str:
        return ">" if self.format == "binary_big_endian" else "<"

    def element(self, name: str) -> Element:
        for e in self.elements:
            if e.name == name:
                return e
        raise PlyError(f"no element {name}")


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def read_header(stream) -> Header:
    """Reads up to the end of the header of an open binary stream."""
    raw = b""
    while b"end_header" not in raw:
        more = stream.read(4096)
        if not more:
            raise PlyError("the header doesn't end")
        raw += more
        if not raw.startswith(b"ply"):
            raise PlyError("not a PLY file")
        if len(raw) > 1 << 20:
            raise PlyError("the header is too long")
    at = raw.index(b"end_header")
    if b"\n" not in raw[at:]:
        raw += stream.read(2)
    end = raw.index(b"\n", at) + 1 if b"\n" in raw[at:] else at + len(b"end_header")
    kind, elements = None, []
    for line in raw[:at].decode("ascii", "replace").splitlines()[1:]:
        word = line.split()
        if not word or word[0] in ("comment", "obj_info"):
            continue
        try:
            if word[0] == "format":
                kind = word[1]
            elif word[0] == "element":
                elements.append(Element(word[1], int(word[2])))
            elif word[0] == "property" and word[1] == "list":
                elements[-1].properties.append((word[4], TYPES[word[3]], TYPES[word[2]]))
            elif word[0] == "property":
                elements[-1].properties.append((word[2], TYPES[word[1]], None))
            else:
                raise PlyError(f"unknown line: {line}")
        except (IndexError, KeyError, ValueError) as e:
            raise PlyError(f"bad header line: {line}") from e
    if kind not in ("ascii", "binary_little_endian", "binary_big_endian"):
        raise PlyError(f"unknown format: {kind}")
    return Header(kind, elements, end)


def header_of(path: str) -> Header:
    fs, p = _filesystem(path)
    with fs.open_input_file(p) as f:
        return read_header(f)


@dataclass
class Split(InputPartition):
    """Rows of a file from `first` on; of an ASCII file with by_bytes, lines that begin in a range of bytes."""

    path: str
    first: int
    rows: int
    by_bytes: bool = False


def files_of(paths: str) -> list[str]:
    """Files of a path, a folder or a comma-separated list of them, in order."""
    out = []
    for path in filter(None, (p.strip() for p in paths.split(","))):
        fs, p = _filesystem(path)
        info = fs.get_file_info(p)
        if info.type == pafs.FileType.NotFound:
            raise PlyError(f"no such file: {path}")
        if info.type == pafs.FileType.Directory:
            scheme = path[: len(path) - len(p)] if path.endswith(p) else ""
            out += sorted(scheme + i.path for i in fs.get_file_info(pafs.FileSelector(p)) if i.path.endswith(".ply"))
        else:
            out.append(path)
    return out


def _ascii_rows(f, header: Header, wanted: Element) -> Iterator[list[str]]:
    f.seek(header.size)
    words = (w for line in f.read().decode("ascii").splitlines() for w in line.split())
    for e in header.elements:
        for _ in range(e.count):
            row = []
            for _, _, length in e.properties:
                if length is None:
                    row.append(next(words))
                else:
                    row.append([next(words) for _ in range(int(next(words)))])
            if e is wanted:
                yield row
        if e is wanted:
            return


def _lines(f, split: Split) -> Iterator[list[str]]:
    """Words of the lines that begin in the split's bytes."""
    f.seek(split.first)
    end = split.first + split.rows
    at, left = split.first, b""
    while True:
        raw = f.read(1 << 20)
        lines = (left + raw).split(b"\n")
        left = lines.pop() if raw else b""
        for line in lines:
            if at >= end:
                return
            at += len(line) + 1
            if line.strip():
                yield line.decode("ascii").split()
        if not raw:
            return


def _size_of(path: str) -> int:
    fs, p = _filesystem(path)
    return fs.get_file_info(p).size


def triangles(h: Header, e: Element, path: str) -> np.dtype | None:
    """The type of a row of a binary element whose only list has three entries in each row, by the size of the file."""
    at = h.elements.index(e)
    lists = [p for p in e.properties if p[2] is not None]
    if h.format == "ascii" or len(lists) != 1 or at != len(h.elements) - 1 or not all(x.fixed for x in h.elements[:at]):
        return None
    kinds = []
    for name, kind, length in e.properties:
        kinds += [(name, h.order + kind)] if length is None else [(f"n {name}", h.order + length), (name, h.order + kind, 3)]
    t = np.dtype(kinds)
    before = h.size + sum(x.count * x.dtype(h.order).itemsize for x in h.elements[:at])
    return t if _size_of(path) == before + e.count * t.itemsize else None


@dataclass
class _Rows:
    """How long the rows of a binary element are whose only list has a length of one byte: bytes before that, of an entry, after."""

    begin: int
    before: int
    entry: int
    after: int

    @property
    def most(self) -> int:
        return self.before + 1 + 255 * self.entry + self.after


def _list_rows(h: Header, e: Element) -> _Rows | None:
    """None where the element can't be cut: it isn't binary, not the last one, or has more lists, longer lengths or lists before it."""
    at = h.elements.index(e)
    lists = [i for i, p in enumerate(e.properties) if p[2] is not None]
    if h.format == "ascii" or len(lists) != 1 or any(x.count for x in h.elements[at + 1 :]) or not all(x.fixed for x in h.elements[:at]) or e.properties[lists[0]][2] != "u1":
        return None
    size = lambda ps: sum(int(kind[1]) for _, kind, _ in ps)
    begin = h.size + sum(x.count * x.dtype(h.order).itemsize for x in h.elements[:at])
    return _Rows(begin, size(e.properties[: lists[0]]), int(e.properties[lists[0]][1][1]), size(e.properties[lists[0] + 1 :]))


def _leaps(raw: np.ndarray, size: int, rows: _Rows) -> tuple[np.ndarray, np.ndarray]:
    """For each of the first places of a block of `size` bytes, were a row to begin there: where the first row behind the block
    begins (from the block's end on), and how many rows begin in the block.  All places leap to the next row at once, then twice
    as far each time, until they are behind the block."""
    to = np.arange(size) + rows.before + 1 + rows.after + raw[rows.before : rows.before + size].astype(np.int64) * rows.entry
    count = np.ones(size, np.int64)
    while (inside := np.flatnonzero(to < size)).size:
        mid = to[inside]
        count[inside] += count[mid]
        to[inside] = to[mid]
    n = min(size, rows.most)
    return to[:n] - size, count[:n]


def _scan(f, lo: int, hi: int, rows: _Rows, block: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """The same for the bytes lo to hi of a file, block by block; places beyond a short block wait for the next one."""
    to, count = np.arange(rows.most), np.zeros(rows.most, np.int64)
    for at in range(lo, hi, block):
        size = min(block, hi - at)
        f.seek(at)
        raw = np.frombuffer(f.read(size + rows.before), np.uint8)
        raw = np.concatenate([raw, np.zeros(size + rows.before - len(raw), np.uint8)])
        step, more = _leaps(raw, size, rows)
        here = to < len(step)
        count[here] += more[to[here]]
        to = np.where(here, step[np.minimum(to, len(step) - 1)], to - size)
    return to, count


def _step(asked: int, usual: int, total: int) -> int:
    """The size of a split of files of `total` rows or bytes."""
    return max(asked, min(usual, -(-total // MOST_SPLITS)))


def polygon_ranges(spark: SparkSession, path: str, bytes_per_split: int) -> list[tuple[int, int]]:
    """(first byte, rows) of ranges of a file's faces, found by a task for each range; none where the file can't be cut so."""
    return _ranges(spark, [path], bytes_per_split).get(path, [])


def _ranges(spark: SparkSession, paths: list[str], bytes_per_split: int) -> dict[str, list[tuple[int, int]]]:
    """The same for each of several files that can be cut, by one job."""
    cut, total = [], 0
    for path in paths:
        h = header_of(path)
        e = h.element("face")
        rows = _list_rows(h, e)
        if rows is not None and triangles(h, e, path) is None:
            end = _size_of(path)
            cut.append((path, rows, e.count, end))
            total += end - rows.begin
    step = _step(bytes_per_split, SPLIT_BYTES, total)
    cut = [c for c in cut if c[3] - c[1].begin > step]
    todo = [(path, lo, min(lo + step, end), rows) for path, rows, _, end in cut for lo in range(rows.begin, end, step)]
    if not todo:
        return {}

    def scan(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                path, lo, hi, rows = todo[i]
                fs, p = _filesystem(path)
                with fs.open_input_file(p) as f:
                    to, count = _scan(f, lo, hi, rows)
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([to.astype("<i4").tobytes()]), pa.array([count.astype("<i8").tobytes()])], ["id", "to", "count"])

    # some KB for each range
    found = {r["id"]: (np.frombuffer(r["to"], "<i4"), np.frombuffer(r["count"], "<i8")) for r in spark.range(0, len(todo), 1, len(todo)).mapInArrow(scan, "id long, to binary, count binary").collect()}
    out, at = {}, 0
    for path, rows, left, end in cut:
        made, place = [], 0
        for start in range(rows.begin, end, step):
            to, count = found[at]
            n = min(int(count[place]), left) if place < len(to) else 0
            if n:
                made.append((start + place, n))
            left -= n
            place = int(to[place]) if place < len(to) else place - step
            at += 1
        if left:
            raise PlyError("the file ends early")
        out[path] = made
    return out


def _skip(f, e: Element, order: str) -> None:
    if e.fixed:
        f.seek(f.tell() + e.count * e.dtype(order).itemsize)
    else:
        for _ in range(e.count):
            _list_row(f, e, order)


def _list_row(f, e: Element, order: str) -> list:
    row = []
    for _, kind, length in e.properties:
        t = np.dtype(order + kind)
        n = 1 if length is None else int(np.frombuffer(f.read(int(length[1])), order + length)[0])
        got = np.frombuffer(f.read(n * t.itemsize), t)
        if len(got) < n:
            raise PlyError("the file ends early")
        row.append(got[0] if length is None else got)
    return row


class PlyReader(DataSourceReader):
    def __init__(self, options, element: str):
        self.element = element
        self.paths = options.get("path") or ""
        self.rows = int(options.get("rows_per_split", SPLIT_ROWS))
        self.bytes = int(options.get("bytes_per_split", SPLIT_BYTES))
        #: For each file (first byte, rows) of its ranges, as `polygon_ranges` gives them.
        self.ranges = json.loads(options.get("ranges", "{}"))

    def partitions(self):
        out = []
        files = [(path, h := header_of(path), h.element(self.element)) for path in files_of(self.paths)]
        rows = _step(self.rows, SPLIT_ROWS, sum(e.count for _, _, e in files))
        size = _step(self.bytes, SPLIT_BYTES, sum(_size_of(path) for path, h, _ in files if h.format == "ascii"))
        for path, h, e in files:
            if self.ranges.get(path):
                out += [Split(path, at, n, True) for at, n in self.ranges[path]]
                continue
            if h.format == "ascii" and e.fixed and all(x is e or not x.count for x in h.elements):
                end = _size_of(path)
                out += [Split(path, lo, min(size, end - lo), True) for lo in range(h.size, end, size)]
                continue
            whole = all(x.fixed for x in h.elements[: h.elements.index(e) + 1]) or triangles(h, e, path) is not None
            step = max(1, rows if h.format != "ascii" and whole else e.count)
            out += [Split(path, lo, min(step, e.count - lo)) for lo in range(0, e.count, step)]
        return out or [Split("", 0, 0)]

    def read(self, split):
        if not split.rows:
            return
        fs, p = _filesystem(split.path)
        with fs.open_input_file(p) as f:
            h = read_header(f)
            e = h.element(self.element)
            yield from (self._vertices if self.element == "vertex" else self._faces)(f, h, e, split)

    def _vertices(self, f, h: Header, e: Element, split: Split):
        names = [n for n, _, _ in e.properties]
        if not {"x", "y", "z"} <= set(names):
            raise PlyError("vertices without x, y and z")
        has_normals = "nx" in names
        for columns, n in self._columns(f, h, e, split, names):
            made = [columns[c] for c in "xyz"]
            made += [columns[c] if c in columns else np.zeros(n, np.float32) for c in ("nx", "ny", "nz")] if has_normals else [np.ones(n, np.float32), np.zeros(n, np.float32), np.zeros(n, np.float32)]
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.float32)) for c in made], ["x", "y", "z", "nx", "ny", "nz"])

    def _columns(self, f, h, e, split, names):
        if h.format == "ascii":
            rows = []
            if split.by_bytes and split.first > h.size:  # a line that began before is the split's before
                f.seek(split.first - 1)
                skipped = 0
                while (c := f.read(1 << 12)) and b"\n" not in c:
                    skipped += len(c)
                skipped += c.index(b"\n") if b"\n" in c else len(c)
                split = Split(split.path, split.first + skipped, split.rows - skipped, True)
                if split.rows <= 0:
                    return
            for row in _lines(f, split) if split.by_bytes else _ascii_rows(f, h, e):
                rows.append(row)
                if len(rows) == BATCH:
                    yield {n: np.array([r[i] for r in rows], np.float64) for i, n in enumerate(names) if e.properties[i][2] is None}, len(rows)
                    rows = []
            if rows:
                yield {n: np.array([r[i] for r in rows], np.float64) for i, n in enumerate(names) if e.properties[i][2] is None}, len(rows)
            return
        f.seek(h.size)
        for before in h.elements[: h.elements.index(e)]:
            _skip(f, before, h.order)
        if not e.fixed:
            rows = [_list_row(f, e, h.order) for _ in range(e.count)]
            yield {n: np.array([r[i] for r in rows]) for i, n in enumerate(names) if e.properties[i][2] is None}, len(rows)
            return
        t = e.dtype(h.order)
        f.seek(f.tell() + split.first * t.itemsize)
        left = split.rows
        while left:
            n = min(left, BATCH)
            raw = f.read(n * t.itemsize)
            if len(raw) < n * t.itemsize:
                raise PlyError("the file ends early")
            got = np.frombuffer(raw, t)
            yield {c: got[c].astype(got[c].dtype.newbyteorder("=")) for c in names}, n
            left -= n

    def _faces(self, f, h: Header, e: Element, split: Split):
        at = [n for n, _, _ in e.properties].index("vertex_indices")
        if (t := triangles(h, e, split.path)) is not None:
            f.seek(h.size + sum(x.count * x.dtype(h.order).itemsize for x in h.elements[: h.elements.index(e)]) + split.first * t.itemsize)
            left = split.rows
            while left:
                n = min(left, BATCH)
                got = np.frombuffer(f.read(n * t.itemsize), t)
                if len(got) < n or (got["n vertex_indices"] != 3).any():
                    raise PlyError("the file ends early, or has faces that are no triangles")
                flat = got["vertex_indices"].astype(np.int64).ravel()
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(0, 3 * n + 1, 3, dtype=np.int32)), pa.array(flat))], ["vertex_indices"])
                left -= n
            return
        if (rows := _list_rows(h, e)) is not None:
            yield from self._polygons(f, h, e, split if split.by_bytes else Split(split.path, rows.begin, e.count, True), at)
            return
        if h.format == "ascii":
            rows = ([int(w) for w in r[at]] for r in _ascii_rows(f, h, e))
        else:
            f.seek(h.size)
            for before in h.elements[: h.elements.index(e)]:
                _skip(f, before, h.order)
            rows = (_list_row(f, e, h.order)[at].tolist() for _ in range(e.count))
        part = []
        for r in rows:
            part.append(r)
            if len(part) == BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.list_(pa.int64()))], ["vertex_indices"])
                part = []
        if part:
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.list_(pa.int64()))], ["vertex_indices"])

    def _polygons(self, f, h: Header, e: Element, split: Split, at: int):
        rows = _list_rows(h, e)
        kind = np.dtype(h.order + e.properties[at][1])
        place, left = split.first, split.rows
        while left:
            f.seek(place)
            likely = left * (rows.before + 1 + 8 * rows.entry + rows.after)  # of eight corners; what is short is read by the next turn
            raw = np.frombuffer(f.read(max(min(1 << 20, likely), rows.most)), np.uint8)
            *starts, after = _polygon_starts(raw, rows, left)
            if not starts:
                raise PlyError("the file ends early")
            starts = np.array(starts)
            n = raw[starts + rows.before].astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(n)])
            first = np.repeat(starts + rows.before + 1 - ends[:-1] * kind.itemsize, n) + np.arange(ends[-1]) * kind.itemsize
            flat = raw[first[:, None] + np.arange(kind.itemsize)].copy().view(kind).ravel().astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))], ["vertex_indices"])
            left -= len(starts)
            place += after


def _polygon_starts(raw: np.ndarray, rows: _Rows, most: int) -> list[int]:
    """Where rows begin that are whole in the bytes given, `most` of them at most; then where the next one begins."""
    out, at, length, fixed = [], 0, raw.tobytes(), rows.before + 1 + rows.after
    while len(out) < most and at + rows.before < len(length):
        to = at + fixed + length[at + rows.before] * rows.entry
        if to > len(length):
            break
        out.append(at)
        at = to
    return [*out, at]


def header_text(element: str, count: int) -> bytes:
    if element == "vertex":
        lines = [f"element vertex {count}", *[f"property float {c}" for c in ("x", "y", "z", "nx", "ny", "nz")]]
    else:
        lines = [f"element face {count}", "property list uchar int vertex_indices"]
    return ("\n".join(lines) + "\n").encode()


HEAD, END = b"ply\nformat binary_little_endian 1.0\n", b"end_header\n"


def _body(batch: pa.RecordBatch, element: str) -> bytes:
    if element == "vertex":
        return np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype("<f4") for c in ("x", "y", "z", "nx", "ny", "nz")], 1).tobytes()
    lists = batch.column("vertex_indices")
    n = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<i4")
    if len(n) and (n == 3).all():
        out = np.zeros(len(n), np.dtype([("n", "u1"), ("v", "<i4", 3)]))
        out["n"], out["v"] = 3, flat.reshape(-1, 3)
        return out.tobytes()
    if len(n) and n.max() > 255:
        raise PlyError("a face of more than 255 corners")
    out = np.empty(len(n) + flat.nbytes, np.uint8)
    counts = np.arange(len(n)) + 4 * (np.cumsum(n) - n)
    entries = np.ones(len(out), bool)
    out[counts], entries[counts] = n, False
    out[entries] = flat.view(np.uint8)
    return out.tobytes()


@dataclass
class Part(WriterCommitMessage):
    made: str
    name: str


class PlyWriter(DataSourceArrowWriter):
    """Each task streams its rows to a file of its own in a hidden folder; the driver renames those of tasks that are done."""

    def __init__(self, options, element: str):
        self.path, self.element = options.get("path").rstrip("/"), element
        self.run = uuid.uuid4().hex

    @property
    def _hidden(self) -> str:
        return f"{self.path}/_new-{self.run}"

    def write(self, iterator):
        from pyspark import TaskContext

        fs, p = _filesystem(self._hidden)
        fs.create_dir(p, recursive=True)
        part = TaskContext.get().partitionId()
        made = f"{p}/{uuid.uuid4().hex}"
        count = 0
        with fs.open_output_stream(f"{made}.body") as body:
            for batch in iterator:
                body.write(_body(batch, self.element))
                count += batch.num_rows
        with fs.open_output_stream(made) as out, fs.open_input_stream(f"{made}.body") as body:
            out.write(HEAD + header_text(self.element, count) + END)
            while piece := body.read(8 << 20):
                out.write(piece)
        return Part(made, f"part-{part:05d}-{self.run}.ply")

    def commit(self, messages):
        fs, p = _filesystem(self.path)
        for m in filter(None, messages):
            fs.move(m.made, f"{p}/{m.name}")
        fs.delete_dir(f"{p}/_new-{self.run}")

    def abort(self, messages):
        fs, p = _filesystem(self._hidden)
        if fs.get_file_info(p).type == pafs.FileType.Directory:
            fs.delete_dir(p)


class PlySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ply"

    @property
    def _element(self) -> str:
        e = self.options.get("element", "vertex")
        if e not in ("vertex", "face"):
            raise PlyError(f"element {e} can't be read")
        return e

    def schema(self) -> str:
        return VERTEX if self._element == "vertex" else FACE

    def reader(self, schema) -> DataSourceReader:
        return PlyReader(self.options, self._element)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise PlyError("a folder of PLY files is only appended to")
        return PlyWriter(self.options, self._element)


def read(spark: SparkSession, path: str, element: str = "vertex", rows_per_split: int = SPLIT_ROWS, bytes_per_split: int = SPLIT_BYTES) -> DataFrame:
    spark.dataSource.register(PlySource)
    reader = spark.read.format("ply").option("element", element).option("rows_per_split", rows_per_split).option("bytes_per_split", bytes_per_split)
    if element == "face":
        reader = reader.option("ranges", json.dumps(_ranges(spark, files_of(path), bytes_per_split)))
    return reader.load(path)


def read_group(spark: SparkSession, group: str, element: str = "vertex") -> DataFrame:
    """The files that a .gp file lists, one path a line, with their place in the list as file_ord."""
    from functools import reduce

    from pyspark.sql import functions as F

    if ".gp" not in group:
        raise PlyError("not a group file")
    fs, p = _filesystem(group)
    with fs.open_input_file(p) as f:
        paths = [x.strip() for x in f.read().decode().splitlines() if x.strip()]
    parts = [read(spark, x, element).withColumn("file_ord", F.lit(i)) for i, x in enumerate(paths)]
    return reduce(DataFrame.unionByName, parts)


def ordered(rows: DataFrame, index: str | list[str] | None) -> DataFrame:
    """Rows in the order of one or more columns over all partitions."""
    by = [index] if isinstance(index, str) else index
    return rows if by is None else rows.repartitionByRange(*by).sortWithinPartitions(*by)


def write_parts(rows: DataFrame, folder: str, element: str = "vertex", index: str | list[str] | None = None) -> None:
    """A folder of files, one for each partition; with index, their names' order is that of the index."""
    spark = rows.sparkSession
    spark.dataSource.register(PlySource)
    columns = ["vertex_indices"] if element == "face" else ["x", "y", "z", "nx", "ny", "nz"]
    ordered(rows, index).select(*columns).write.format("ply").option("element", element).mode("append").save(folder)


def write(points: DataFrame, path: str, faces: DataFrame | None = None, index: str | list[str] | None = None, face_index: str | list[str] | None = None) -> None:
    """One little-endian file with six floats a vertex (and int lists a face), in the order of the index columns, for exchange
    with other programs.  Tasks write the rows as parts in the shared folder; their sizes say where each part's bytes belong, so
    tasks copy them there, side by side.  Where tasks can't do that (a store that is no disk, or on a cluster a disk that isn't the
    shared folder's), the driver copies them one after another.  Each table is evaluated once.  Faces name vertices by position, so with faces the index is a must."""
    if faces is not None and index is None:
        raise PlyError("faces need an order of the vertices")
    spark = points.sparkSession
    folder = work_dir(spark, "ply")
    parts: list[tuple[str, list[str]]] = []
    for element, rows, by in (("vertex", points, index), ("face", faces, face_index)):
        if rows is not None:
            write_parts(rows, f"{folder}/{element}", element, by)
            parts.append((element, files_of(f"{folder}/{element}")))
    headers = {f: header_of(f) for _, files in parts for f in files}
    head = HEAD + b"".join(header_text(element, sum(headers[f].elements[0].count for f in files)) for element, files in parts) + END
    place, bodies = len(head), []
    for f in (f for _, files in parts for f in files):
        bodies.append((f, headers[f].size, place))
        place += _size_of(f) - headers[f].size
    fs, p = _filesystem(path)
    if isinstance(fs, pafs.LocalFileSystem) and (spark.sparkContext.master.startswith("local") or p.startswith(_filesystem(root(spark))[1])):
        with open(p, "wb") as out:
            out.write(head)
            out.truncate(place)
        _copied(spark, bodies, p)
    else:
        with fs.open_output_stream(p) as out:
            out.write(head)
            for body in bodies:
                _copy(body, out)
    part_fs, part = _filesystem(folder)
    part_fs.delete_dir(part)


def _copy(body: tuple[str, int, int], out) -> None:
    name, first, _ = body
    fs, p = _filesystem(name)
    with fs.open_input_file(p) as f:
        f.seek(first)
        while piece := f.read(8 << 20):
            out.write(piece)


def _copied(spark: SparkSession, bodies: list[tuple[str, int, int]], path: str) -> None:
    """Parts' bytes put at their places of a file by tasks; a task that runs again writes the same bytes."""

    def run(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                with open(path, "r+b") as out:
                    out.seek(bodies[i][2])
                    _copy(bodies[i], out)
        yield pa.RecordBatch.from_arrays([pa.array([], pa.int64())], ["id"])

    if bodies:
        spark.range(0, len(bodies), 1, len(bodies)).mapInArrow(run, "id long").write.format("noop").mode("overwrite").save()


def merge(group: str, spark: SparkSession, path: str) -> None:
    """The files that a .gp file lists as one: all vertices in the order of files and rows, face indices moved by the number of
    vertices in the files before."""
    from pyspark.sql import functions as F

    from voxelake.operators import keyed

    def placed(element):  # a file's splits are in its order, and so are the rows of each
        return read_group(spark, group, element).withColumn("nth", F.monotonically_increasing_id())

    vertices = placed("vertex")
    offsets = keyed.file_offsets(vertices.groupBy("file_ord").agg(F.count(F.lit(1)).alias("n")))
    faces = keyed.merge_faces(placed("face"), offsets)
    write(vertices, path, faces, "nth", "nth")
