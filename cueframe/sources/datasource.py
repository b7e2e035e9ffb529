"""Subtitle files as a data source of Spark: spark.read.format("subtitles") and df.write.format("subtitles").

Register it once by session: spark.dataSource.register(SubtitleSource). Options: kind (srt, ass, vtt or lrc; files that
end so are read or written) and split_bytes (bytes of files that a task reads). Files are opened through pyarrow's
file systems on the executors.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .readers import CLOCK, SHORT_CLOCK
from .writers import HEAD

SCHEMA = "name string, pos int, start double, end double, text string"
KINDS = ("srt", "ass", "vtt", "lrc")
LRC_LINE = r"^\s*\[(\d{2,3}:\d{2}(?:\.\d{1,3})?)\](.*)$"


def file_system(path: str):
    """The file system of a path or URI, and the path within it."""
    from pyarrow import fs

    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        system, inner = fs.FileSystem.from_uri(path)
        return system, inner.rstrip("/")
    return fs.LocalFileSystem(), path.rstrip("/")


def seconds(clock: str) -> float:
    total = 0.0
    for part in clock.replace(",", ".").split(":"):
        total = total * 60 + float(part)
    return round(total, 3)


def clock(kind: str, at: float) -> str:
    """A time of day as the kind of file has it."""
    units = {"srt": 1000, "vtt": 1000, "ass": 100, "lrc": 100}[kind]
    n = round(at * units)
    rest, whole = n % units, n // units
    h, m, s = whole // 3600, whole // 60 % 60, whole % 60
    return {"srt": f"{h:02d}:{m:02d}:{s:02d},{rest:03d}", "vtt": f"{h:02d}:{m:02d}:{s:02d}.{rest:03d}", "ass": f"{h}:{m:02d}:{s:02d}.{rest:02d}", "lrc": f"{whole // 60:02d}:{s:02d}.{rest:02d}"}[kind]


def parse(kind: str, text: str) -> Iterator[tuple[float, float | None, str]]:
    """Start, end and text of each cue of a file. Lyric lines have no end."""
    text = re.sub("\r\n?", "\n", text.removeprefix("﻿"))
    if kind in ("srt", "vtt"):
        pattern = re.compile(rf"(?m)^.*?{SHORT_CLOCK}.*$" if kind == "vtt" else rf"(?m)^\s*{CLOCK}\s*$")
        for block in re.split(r"\n[ \t\f\v]*\n\s*", text.strip()):
            if m := pattern.search(block):
                lines = [x.strip() for x in block[m.end() :].replace("\\N", "\n").split("\n") if x.strip()]
                if lines:
                    yield seconds(m[1]), seconds(m[2]), "\n".join(lines)
    elif kind == "ass":
        for line in text.split("\n"):
            f = line.split(",", 9)
            if line.startswith("Dialogue:") and len(f) == 10 and (t := re.sub(r"\\N|\\n", "\n", f[9]).strip()):
                yield seconds(f[1].strip()), seconds(f[2].strip()), t
    else:
        for line in text.split("\n"):
            if (m := re.match(LRC_LINE, line)) and m[2].strip():
                yield seconds(m[1]), None, m[2].strip()


def render(kind: str, cues: list[tuple]) -> str:
    """A file of cues (name, pos, start, end, text)."""
    if kind == "srt":
        return "\n".join(f"{k}\n{clock(kind, a)} --> {clock(kind, b)}\n{t.strip()}\n" for k, (_, _, a, b, t) in enumerate(cues, 1))
    if kind == "vtt":
        return "WEBVTT\n\n" + "\n".join(f"{clock(kind, a)} --> {clock(kind, b)}\n{t.strip()}\n" for _, _, a, b, t in cues)
    if kind == "ass":
        return HEAD + "".join(f"Dialogue: 0,{clock(kind, a)},{clock(kind, b)},Default,,0,0,0,,{t.strip().replace(chr(10), chr(92) + 'N')}\n" for _, _, a, b, t in cues)
    return "".join(f"[{clock(kind, a)}]{' '.join(t.split())}\n" for _, _, a, _, t in cues)


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]

    def __init__(self, paths: tuple[str, ...]):
        self.paths = paths


@dataclass
class Written(WriterCommitMessage):
    files: tuple[tuple[str, str], ...]  # where a file stands, and its name


class Reader(DataSourceReader):
    def __init__(self, path: str, kind: str, split_bytes: int):
        self.path, self.kind, self.split_bytes = path, kind, split_bytes

    def partitions(self) -> list[Files]:
        """Files in order of their names, as many to a task as its bytes allow."""
        from pyarrow import fs

        system, inner = file_system(self.path)
        found = [i for i in system.get_file_info(fs.FileSelector(inner, recursive=True)) if i.is_file and i.path.endswith("." + self.kind) and "/_" not in i.path[len(inner) :]]
        out, own, size = [], [], 0
        for info in sorted(found, key=lambda i: i.path):
            if own and size + info.size > self.split_bytes:
                out.append(Files(tuple(own)))
                own, size = [], 0
            own.append(info.path)
            size += info.size
        return [*out, *([Files(tuple(own))] if own else [])] or [Files(())]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, inner = file_system(self.path)
        for path in partition.paths:
            with system.open_input_stream(path) as f:
                text = f.read().decode("utf-8")
            name = path[len(inner) + 1 :].removesuffix("." + self.kind)
            for pos, (start, end, line) in enumerate(parse(self.kind, text)):
                yield name, pos, start, end, line


class Writer(DataSourceWriter):
    """One file for each name. The rows of a name must come to one task, one after another (write_subtitles sees to it).
    Files are written aside and get their names when all tasks have ended, so a task that is repeated leaves none twice."""

    def __init__(self, path: str, kind: str, overwrite: bool):
        self.path, self.kind, self.overwrite = path, kind, overwrite
        self.aside = f"_aside-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        system, inner = file_system(self.path)
        folder = f"{inner}/{self.aside}/{uuid.uuid4().hex}"
        system.create_dir(folder, recursive=True)
        done: list[tuple[str, str]] = []
        cues: list[tuple] = []

        def close() -> None:
            if cues:
                at = f"{folder}/{len(done)}"
                with system.open_output_stream(at) as f:
                    f.write(render(self.kind, cues).encode("utf-8"))
                done.append((at, cues[0][0]))
                cues.clear()

        for row in rows:
            if cues and row[0] != cues[0][0]:
                close()
            cues.append(tuple(row))
        close()
        return Written(tuple(done))

    def commit(self, messages: list[Written | None]) -> None:
        system, inner = file_system(self.path)
        files = [f for m in messages if m for f in m.files]
        names = [n for _, n in files]
        if len(set(names)) != len(names):
            self.abort(messages)
            raise ValueError("the rows of a name came to several tasks")
        if self.overwrite:
            from pyarrow import fs

            for info in system.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True)):
                if info.is_file and info.path.endswith("." + self.kind):
                    system.delete_file(info.path)
        for at, name in files:
            target = f"{inner}/{name}.{self.kind}"
            system.create_dir(target.rpartition("/")[0], recursive=True)
            system.move(at, target)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, inner = file_system(self.path)
        if system.get_file_info(f"{inner}/{self.aside}").type.name == "Directory":
            system.delete_dir(f"{inner}/{self.aside}")


class SubtitleSource(DataSource):
    """Rows (name, pos, start, end, text): name is the file's path below the folder, without its ending."""

    @classmethod
    def name(cls) -> str:
        return "subtitles"

    def schema(self) -> str:
        return SCHEMA

    def _kind(self) -> str:
        kind = self.options.get("kind", "srt").lower()
        if kind not in KINDS:
            raise ValueError(f"kind is one of {', '.join(KINDS)}")
        return kind

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], self._kind(), int(self.options.get("split_bytes", 16 << 20)))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], self._kind(), overwrite)


def write_subtitles(cues: DataFrame, path: str, kind: str = "srt", mode: str = "append") -> None:
    """cues (name, pos, start, end, text) as one file for each name."""
    cues.sparkSession.dataSource.register(SubtitleSource)
    rows = cues.select("name", "pos", "start", "end", "text").selectExpr("cast(name as string) name", "cast(pos as int) pos", "cast(start as double) start", "cast(`end` as double) `end`", "coalesce(text, '') text")
    rows.repartition("name").sortWithinPartitions("name", "pos").write.format("subtitles").option("kind", kind).mode(mode).save(path)


def read_subtitles(spark, path: str, kind: str = "srt") -> DataFrame:
    spark.dataSource.register(SubtitleSource)
    return spark.read.format("subtitles").option("kind", kind).load(path)
