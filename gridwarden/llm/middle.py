"""Fill-in-middle transformation of texts that are stored as seekable compressed frames."""

import hashlib
from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwarden.llm.shared import whole

#: Bytes of text in a frame, at most.
FRAME = 1 << 16
LEVEL = 3
MARKS = ("<P>", "<S>", "<M>")
PLAIN, PREFIX_FIRST, SUFFIX_FIRST = "plain", "psm", "spm"

_SEEK = "array<struct<units:bigint,chars:bigint,bytes:bigint,stored:bigint>>"


class FrameWriter:
    """Independent compressed frames, one behind the other, and the counts at each one's end:
    line ends, code points, bytes of text and bytes stored."""

    def __init__(self, size=FRAME):
        import zstandard
        self.size, self.packer = size, zstandard.ZstdCompressor(level=LEVEL)
        self.frames, self.seek = [], []

    def add(self, text):
        """Bytes of a text, cut between code points."""
        at = 0
        while at < len(text):
            end = min(at + self.size, len(text))
            while end < len(text) and text[end] & 0xC0 == 0x80:
                end -= 1
            part = text[at:end]
            self.copy(self.packer.compress(part), (
                part.count(b"\n"), len(part.decode()), len(part)))
            at = end

    def copy(self, frame, counts):
        """A frame that is compressed already, as it is."""
        before = self.seek[-1] if self.seek else (0, 0, 0, 0)
        self.frames.append(frame)
        self.seek.append(tuple(b + c for b, c in zip(before, (*counts, len(frame)))))

    def done(self):
        return b"".join(self.frames), self.seek


class FrameReader:
    """Any part of a text from the frames that hold it."""

    def __init__(self, frames, seek):
        import zstandard
        self.frames, self.opener = memoryview(frames), zstandard.ZstdDecompressor()
        self.seek = np.array([tuple(s.values()) if isinstance(s, dict) else tuple(s)
                              for s in seek], dtype=np.int64).reshape(-1, 4)
        self.begin = np.vstack([np.zeros((1, 4), np.int64), self.seek[:-1]])[:len(self.seek)]
        self.units, self.chars, self.bytes = (
            self.seek[-1, :3].tolist() if len(self.seek) else (0, 0, 0))

    def stored(self, i):
        return self.frames[self.begin[i, 3]:self.seek[i, 3]]

    def frame(self, i):
        return self.opener.decompress(self.stored(i))

    def cut(self, units):
        """(bytes, code points) before the end of the text's ``units``-th line, counted from 1.

        Only the frame in which the line ends is opened.
        """
        if units <= 0:
            return 0, 0
        i = bisect_left(self.seek[:, 0], units)
        if i == len(self.seek):  # a last line without an end
            return self.bytes, self.chars
        data = self.frame(i)
        ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
        part = data[:ends[units - self.begin[i, 0] - 1] + 1]
        return int(self.begin[i, 2]) + len(part), int(self.begin[i, 1]) + len(part.decode())

    def parts(self, start, end):
        """(frame, first byte, last byte) of the text's bytes from ``start`` to ``end``."""
        i = bisect_right(self.seek[:, 2], start)
        while i < len(self.seek) and start < end:
            first = int(self.begin[i, 2])
            stop = min(end, int(self.seek[i, 2]))
            yield i, start - first, stop - first
            start, i = stop, i + 1

    def stream(self, start=0, end=None):
        """The bytes from ``start`` to ``end``, a frame at a time."""
        for i, first, last in self.parts(start, self.bytes if end is None else end):
            yield self.frame(i)[first:last]

    def find(self, marks):
        """The place of each mark's first occurrence, -1 for none; marks may cross frames."""
        found, tail, at = dict.fromkeys(marks, -1), b"", 0
        for data in self.stream():
            data = tail + data
            for mark in marks:
                place = data.find(mark) if found[mark] < 0 else -1
                if place >= 0:
                    found[mark] = at + place
            keep = max(map(len, marks)) - 1
            tail = data[max(len(data) - keep, 0):]
            at += len(data) - len(tail)
        return [found[m] for m in marks]

    def send(self, writer, start, end):
        """The bytes from ``start`` to ``end`` to a writer, whole frames as they are."""
        for i, first, last in self.parts(start, end):
            if last - first == self.seek[i, 2] - self.begin[i, 2]:
                writer.copy(bytes(self.stored(i)), (self.seek[i, :3] - self.begin[i, :3]).tolist())
            else:
                writer.add(self.frame(i)[first:last])


def store_texts(docs: DataFrame, path, size=FRAME) -> None:
    """Writes a table of seekable texts: doc_id, n (lines), chars, frames, seek.

    ``frames`` are zstandard frames of at most ``size`` bytes of text each, independent of each
    other; ``seek`` has the counts up to each one's end. A line is what ends in a line feed, and
    what stands behind the last one. A null or empty text has no frames and no lines; a long one has
    more frames, of which later steps hold one at a time. Other columns of docs are left out; repeated rows are each stored; no rows give an empty table.
    """
    @F.pandas_udf(f"n bigint, chars bigint, frames binary, seek {_SEEK}")
    def pack(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            writer = FrameWriter(size)
            writer.add(text.encode())
            frames, seek = writer.done()
            units, chars = seek[-1][:2] if seek else (0, 0)
            rows.append((units + bool(text and text[-1] != "\n"), chars, frames, seek))
        return pd.DataFrame(rows, columns=["n", "chars", "frames", "seek"])

    docs.select("doc_id", pack(whole(F.col("text"))).alias("_packed")).select(
        "doc_id", "_packed.*").write.parquet(path)


def fill_in_middle(stored: DataFrame, seed=7, rate=100, suffix_first=50, marks=MARKS) -> DataFrame:
    """Stored texts with form, prefix_chars, middle_chars, output and output_seek (frames again).

    The lines are cut at two places that the SHA-256 of ``seed:doc_id`` names. ``rate`` of 100
    documents are reordered, ``suffix_first`` of 100 of these with the suffix first (spm), others
    with the prefix first (psm). An empty text, and one that holds a mark, stays plain (null
    counts) and its output is itself. Of a text in frames only those at the cuts are compressed
    anew, the others move as they are. A null doc_id counts as an empty one. Columns of these
    names are replaced, others kept; repeated rows give repeated rows.
    """
    prefix, suffix, middle = (m.encode() for m in marks)

    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(
        F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]
    places = [F.pmod(x, F.col("n") + 1) for x in h[:2]]
    form = F.when((F.col("chars") == 0) | (h[2] % 100 >= rate), PLAIN).when(
        h[3] % 100 < suffix_first, SUFFIX_FIRST).otherwise(PREFIX_FIRST)

    @F.pandas_udf("form string, prefix_chars bigint, middle_chars bigint, output binary, "
                  f"output_seek {_SEEK}")
    def reorder(frames: pd.Series, seek: pd.Series, form: pd.Series, low: pd.Series,
                high: pd.Series) -> pd.DataFrame:
        rows = []
        for data, table, kind, first, last in zip(frames, seek, form, low, high):
            text = FrameReader(data, table)
            if kind == PLAIN or max(text.find((prefix, suffix, middle))) >= 0:
                rows.append((PLAIN, None, None, data, table))
                continue
            (a, before), (b, through) = text.cut(first), text.cut(last)
            writer = FrameWriter()
            head, tail = (prefix, 0, a), (suffix, b, text.bytes)
            for mark, start, end in ((tail, head) if kind == SUFFIX_FIRST else (head, tail)) + (
                    (middle, a, b),):
                writer.add(mark)
                text.send(writer, start, end)
            rows.append((kind, before, through - before, *writer.done()))
        out = pd.DataFrame(rows, columns=["form", "prefix_chars", "middle_chars", "output",
                                          "output_seek"])
        return out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    made = reorder("frames", "seek", form, F.least(*places), F.greatest(*places))
    names = ("form", "prefix_chars", "middle_chars", "output", "output_seek")
    return stored.withColumn("_made", made).select(
        *[c for c in stored.columns if c not in names], "_made.*")


def _order(output, form, marks):
    """Byte ranges of the output that are the text's prefix, middle and suffix."""
    if form == PLAIN:
        return [(0, output.bytes)]
    prefix, suffix, middle = places = output.find(marks)
    ends = [*sorted(places)[1:], output.bytes]
    ranges = {p: (p + len(m), e) for (p, m), e in zip(sorted(zip(places, marks)), ends)}
    return [ranges[prefix], ranges[middle], ranges[suffix]]


def digests(transformed: DataFrame, marks=MARKS) -> DataFrame:
    """transformed with output_sha256 and restored_sha256 (lower-case hex, of UTF-8).

    Both are streamed, a frame at a time; the text is restored from the output and its form.
    """
    marks = [m.encode() for m in marks]

    @F.pandas_udf("output_sha256 string, restored_sha256 string")
    def hashed(frames: pd.Series, seek: pd.Series, form: pd.Series) -> pd.DataFrame:
        rows = []
        for data, table, kind in zip(frames, seek, form):
            output = FrameReader(data, table)
            one, other = hashlib.sha256(), hashlib.sha256()
            for part in output.stream():
                one.update(part)
            for start, end in _order(output, kind, marks):
                for part in output.stream(start, end):
                    other.update(part)
            rows.append((one.hexdigest(), other.hexdigest()))
        return pd.DataFrame(rows, columns=["output_sha256", "restored_sha256"])

    return transformed.withColumn("_hashed", hashed("output", "output_seek", "form")).select(
        *[c for c in transformed.columns if c not in ("output_sha256", "restored_sha256")],
        "_hashed.*")


def texts(transformed: DataFrame, marks=MARKS) -> DataFrame:
    """transformed with output_text and restored_text, whole."""
    marks = [m.encode() for m in marks]

    @F.pandas_udf("output_text string, restored_text string")
    def opened(frames: pd.Series, seek: pd.Series, form: pd.Series) -> pd.DataFrame:
        rows = []
        for data, table, kind in zip(frames, seek, form):
            output = FrameReader(data, table)
            ranges = _order(output, kind, marks)
            rows.append((b"".join(output.stream()).decode(), b"".join(
                part for r in ranges for part in output.stream(*r)).decode()))
        return pd.DataFrame(rows, columns=["output_text", "restored_text"])

    return transformed.withColumn("_opened", opened("output", "output_seek", "form")).select(
        *[c for c in transformed.columns if c not in ("output_text", "restored_text")],
        "_opened.*")
