"""WAV containers: header scan, PCM wrapping, ordered assembly in rows and from files, slices."""

from __future__ import annotations

import io
import wave
from collections import deque
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RATE = 22_050
HEADER_BYTES = 44
#: Chunks that are looked through at first for the format and the samples. Only files with more are walked through to their end.
CHUNKS = 64
#: Bytes that a header can tell, and bytes of samples that one piece of a file has while it is put together.
MOST, PIECE = (1 << 32) - 1, 4 << 20
#: Lines and code points that a provider is given at once while chapters are spoken (one line at least).
LINES, POINTS = 256, 1 << 16


def wrap_pcm(pcm: bytes, rate: int = RATE, channels: int = 1, width: int = 2) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(pcm)
    return out.getvalue()


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _int(content: Column, at: int | Column, size: int) -> Column:
    """Little-endian unsigned integer of the bytes from at on."""
    taken = F.hex(F.substring(content, (at if isinstance(at, Column) else F.lit(at)) + 1, F.lit(size)))
    return F.conv(F.array_join(F.reverse(F.regexp_extract_all(taken, F.lit("(..)"))), ""), 16, 10).cast("long")


def _places(content: Column, chunks: Column) -> Column:
    """struct(at, fmt, data): where the chunks of the format and of the samples start, null where so many chunks have none; at is the next chunk."""
    state = lambda at, fmt, data: F.struct(at.cast("int").alias("at"), fmt.cast("int").alias("fmt"), data.cast("int").alias("data"))

    def step(seen: Column, _: Column) -> Column:
        at, name = seen["at"], F.hex(F.substring(content, seen["at"] + 1, F.lit(4)))
        size = F.coalesce(_int(content, at + 4, 4), F.lit(0))
        fmt = F.when(name == b"fmt ".hex().upper(), at).otherwise(seen["fmt"])
        data = F.when(name == b"data".hex().upper(), at)
        # Chunks start at even places; beyond the end there is nothing to find.
        after = F.least(at + 8 + size + size % 2, F.octet_length(content).cast("long"))
        return F.when(seen["data"].isNotNull(), seen).otherwise(state(after, fmt, data))

    none = F.lit(None)
    return F.aggregate(F.sequence(F.lit(1), chunks), state(F.lit(12), none, none), step)


def _found(content: Column) -> Column:
    plain = F.hex(F.substring(content, 37, 4)) == b"data".hex().upper()
    size = F.octet_length(content)

    def walked(first: Column) -> Column:
        # No chunk is shorter than eight bytes, so this walk ends at the end of the file.
        rest = _places(content, F.greatest((size / 8).cast("int"), F.lit(1)))
        return F.when(first["data"].isNull() & (first["at"] < size), rest).otherwise(first)

    usual = F.struct(F.lit(36).alias("at"), F.lit(12).alias("fmt"), F.lit(36).alias("data"))
    return F.when(plain, usual).otherwise(_once(_places(content, F.lit(CHUNKS)), walked))


def layout(content: Column) -> Column:
    """struct(channels, width, rate, frames, start, size) in built-in expressions: the format, and where the samples start and how many bytes of them the file
    has; null where it has no format or no samples."""

    def told(places: Column) -> Column:
        fmt, data = places["fmt"], places["data"]
        size = _int(content, data + 4, 4)
        channels, width = _int(content, fmt + 10, 2).cast("int"), (_int(content, fmt + 22, 2) / 8).cast("int")
        row = F.struct(
            channels.alias("channels"),
            width.alias("width"),
            _int(content, fmt + 12, 4).cast("int").alias("rate"),
            F.try_divide(size, channels * width).cast("long").alias("frames"),
            (data + 8).alias("start"),
            F.least(size, F.octet_length(content) - data - 8).cast("int").alias("size"),
        )
        return F.when(fmt.isNotNull() & data.isNotNull(), row)

    return _once(_found(content), told)


def header(content: Column) -> Column:
    """struct(channels, width, rate, frames); null where a file has no format or no samples."""
    return _once(layout(content), lambda h: F.when(h.isNotNull(), F.struct(*[h[c].alias(c) for c in ("channels", "width", "rate", "frames")])))


def duration_ms(content: Column) -> Column:
    return _once(layout(content), lambda h: (F.try_divide(h["frames"], h["rate"]) * 1000).cast("int"))


def samples(content: Column) -> Column:
    """The bytes of the samples, as many as the header tells or the file has."""
    return _once(layout(content), lambda h: F.substring(content, h["start"] + 1, h["size"]))


def _le(value: Column, size: int) -> Column:
    """The integer as so many bytes, the lowest first."""
    digits = F.lpad(F.hex(value.cast("long")), 2 * size, "0")
    return F.unhex(F.array_join(F.reverse(F.regexp_extract_all(digits, F.lit("(..)"))), ""))


def header_bytes(channels: Column, width: Column, rate: Column, size: Column) -> Column:
    """The 44 bytes before size bytes of samples."""
    frame = channels * width
    fixed = lambda text: F.lit(text.encode())
    return F.concat(
        fixed("RIFF"), _le(size + 36, 4), fixed("WAVEfmt "), _le(F.lit(16), 4), _le(F.lit(1), 2), _le(channels, 2), _le(rate, 4), _le(rate * frame, 4), _le(frame, 2), _le(width * 8, 2), fixed("data"), _le(size, 4)
    )


def slice_audio(content: Column, offset_ms: Column, length_ms: Column) -> Column:
    """The WAV of a time window, cut where the samples end; null where it starts beyond them or before the first."""

    def window(h: Column) -> Column:
        first, n = (offset_ms * h["rate"] / 1000).cast("int"), (length_ms * h["rate"] / 1000).cast("int")
        frame = h["channels"] * h["width"]
        size = F.greatest(F.least(n * frame, h["size"] - first * frame), F.lit(0))
        cut = F.concat(header_bytes(h["channels"], h["width"], h["rate"], size), F.substring(content, h["start"] + 1 + first * frame, size))
        return F.when((first >= 0) & (first <= h["frames"]), cut)

    return _once(layout(content), window)


def joined(files: DataFrame, key: str, order: str, content: str = "content", piece: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """(key, at, content) pieces of one WAV for each key, and (key, error) of keys that cannot be joined.

    Two passes over the files, as no sound need fit in a row but that of one file: headers alone tell where each file's samples
    start in the whole, by a running sum; then samples are cut to pieces where they are read and given their place. A file
    that is no WAV, a format other than the first file's, or more bytes than a header can tell is an error of the key.
    """
    h = header(F.col(content))
    told = files.select(key, order, h.alias("h")).withColumn("bytes", F.col("h.frames") * F.col("h.channels") * F.col("h.width"))
    shape = F.struct("h.channels", "h.width", "h.rate")
    w = Window.partitionBy(key).orderBy(order)
    before = F.coalesce(F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = told.withColumn("before", before).withColumn("first", F.first(shape).over(every)).withColumn("total", F.sum("bytes").over(every)).withColumn("shape", shape)
    fault = (
        F.when(F.col("h").isNull(), F.concat(F.lit("not a WAV at "), F.col(order).cast("string")))
        .when(~F.col("shape").eqNullSafe(F.col("first")), F.concat(F.lit("another format at "), F.col(order).cast("string")))
        .when(F.col("total") + 36 > MOST, F.lit("longer than a header can tell"))
    )
    errors = placed.withColumn("error", fault).where("error is not null").groupBy(key).agg(F.min_by("error", order).alias("error"))
    fit = placed.join(errors.select(key), key, "left_anti")
    heads = fit.groupBy(key).agg(F.first("first").alias("f"), F.first("total").alias("total"))
    heads = heads.select(key, F.lit(0).cast("long").alias("at"), header_bytes(F.col("f.channels"), F.col("f.width"), F.col("f.rate"), F.col("total")).alias("content"))
    starts = fit.select(key, order, "before", "bytes")
    body = files.select(key, order, samples(F.col(content)).alias("body")).join(starts, [key, order])
    cuts = body.where("bytes > 0").select("*", F.explode(F.sequence(F.lit(0), ((F.col("bytes") - 1) / piece).cast("int"))).alias("i"))
    place = F.col("i").cast("long") * piece
    rows = cuts.select(key, (F.lit(HEADER_BYTES) + F.col("before") + place).cast("long").alias("at"), F.substring("body", (place + 1).cast("int"), F.least(F.lit(piece), F.col("bytes") - place).cast("int")).alias("content"))
    return heads.unionByName(rows), errors


def slice_wav(content: bytes, offset_ms: int, length_ms: int) -> bytes:
    with wave.open(io.BytesIO(content)) as w:
        rate, size = w.getframerate(), w.getnchannels() * w.getsampwidth()
        frames = w.readframes(w.getnframes())
    first, n = int(offset_ms * rate / 1000), int(length_ms * rate / 1000)
    return wrap_pcm(frames[first * size : (first + n) * size], rate)


def assemble(segments: DataFrame, key: str = "chapter_id", order: str = "position", content: str = "audio") -> DataFrame:
    """(key, audio, frames, error): the audio of each chapter in order; formats that differ from the first are an error.

    Segments are sorted inside tasks and joined as they stream by, so a task holds one chapter's audio at a time.
    """

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chapter, pcm, shape, error = None, [], None, None

        def close() -> pd.DataFrame:
            body = b"".join(pcm)
            done = error is None and shape is not None
            return pd.DataFrame({key: [chapter], "audio": [wrap_pcm(body, shape[2]) if done else None], "frames": pd.array([len(body) // (shape[0] * shape[1]) if done else None], dtype="Int64"), "error": [error]})

        for batch in batches:
            for k, data in zip(batch[key], batch[content], strict=True):
                if k != chapter:
                    if chapter is not None:
                        yield close()
                    chapter, pcm, shape, error = k, [], None, None
                with wave.open(io.BytesIO(bytes(data))) as w:
                    now = (w.getnchannels(), w.getsampwidth(), w.getframerate())
                    shape = shape or now
                    if now != shape:
                        error = f"format {now} after {shape}"
                    pcm.append(w.readframes(w.getnframes()))
        if chapter is not None:
            yield close()

    kind = dict(segments.dtypes)[key]
    return segments.repartition(key).sortWithinPartitions(key, order).select(key, content).mapInPandas(join, f"{key} {kind}, audio binary, frames long, error string")


def spoken(lines: DataFrame, provider: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], key: str = "chapter_id", order: str = "position", piece: int = PIECE) -> DataFrame:
    """(key, at, content, error): one WAV for each key, spoken and put together in one pass, in pieces; the piece at 0 is its header.

    Texts are shuffled and sorted, not their audio, which is many times as large: the provider speaks them in small batches, one
    WAV for each line in the lines' order, and samples leave the task in pieces, so neither a chapter nor a batch of lines has to
    fit in a row. Lines without audio are passed over. A key without any audio, or with an error (no WAV, formats that differ, more
    bytes than a header can tell), has null content at 0, and what pieces it has besides are void.
    """
    names = [key, "at", "content", "error"]

    def speak(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: deque[Any] = deque()
        kind = pa.null()

        def parts() -> Iterator[pd.DataFrame]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(key).type
                sizes = [len(t or "") for t in batch.column("text").to_pylist()]
                at = 0
                while at < len(sizes):
                    end, points = at + 1, sizes[at]
                    while end < len(sizes) and end - at < LINES and points + sizes[end] <= POINTS:
                        points += sizes[end]
                        end += 1
                    part = batch.slice(at, end - at)
                    keys.extend(part.column(key).to_pylist())
                    yield part.to_pandas(integer_object_nulls=True)
                    at = end

        def row(at: int, content: bytes | None, error: str | None = None) -> pa.RecordBatch:
            columns = [pa.array([now], kind), pa.array([at], pa.int64()), pa.array([content], pa.binary()), pa.array([error], pa.string())]
            return pa.RecordBatch.from_arrays(columns, names)

        begun, now, shape, error, total, held = False, None, None, None, 0, bytearray()

        def close() -> Iterator[pa.RecordBatch]:
            why = error or ("longer than a header can tell" if total + 36 > MOST else None)
            if held:
                yield row(HEADER_BYTES + total - len(held), bytes(held))
            yield row(0, None if why or shape is None else _head(*shape, total), why)

        for told in provider(parts()):
            for data in told["audio"]:
                k = keys.popleft()
                if not begun or k != now:
                    if begun:
                        yield from close()
                    begun, now, shape, error, total, held = True, k, None, None, 0, bytearray()
                if data is None or error:
                    continue
                try:
                    with wave.open(io.BytesIO(data)) as w:
                        found = (w.getnchannels(), w.getsampwidth(), w.getframerate())
                        body = w.readframes(w.getnframes())
                except (wave.Error, EOFError) as what:
                    error = f"not a WAV: {what}"
                    continue
                shape = shape or found
                if found != shape:
                    error = f"format {found} after {shape}"
                    continue
                total += len(body)
                held += body
                if len(held) >= piece:
                    whole = len(held) // piece * piece
                    for at in range(0, whole, piece):
                        yield row(HEADER_BYTES + total - len(held) + at, bytes(held[at : at + piece]))
                    del held[:whole]
        if keys:
            raise ValueError("the provider left lines out")
        if begun:
            yield from close()

    ids = [c for c in ("segment_id", "voice_id") if c in lines.columns]
    placed = lines.repartition(key).sortWithinPartitions(key, order).select(*dict.fromkeys([*ids, key, "text"]))
    return placed.mapInArrow(speak, f"{key} {dict(lines.dtypes)[key]}, at long, content binary, error string")


def _head(channels: int, width: int, rate: int, size: int) -> bytes:
    """The same 44 bytes as header_bytes() gives."""
    le = lambda value, n: value.to_bytes(n, "little")
    frame = channels * width
    return b"RIFF" + le(size + 36, 4) + b"WAVEfmt " + le(16, 4) + le(1, 2) + le(channels, 2) + le(rate, 4) + le(rate * frame, 4) + le(frame, 2) + le(width * 8, 2) + b"data" + le(size, 4)
