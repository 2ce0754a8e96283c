"""S12, S16, S18 as formats: `spark.read.format(...)` and `spark.readStream.format(...)` over folders of filing indexes and cards.

`register(spark)` makes known `filing_index` (text files of fixed-width lines) and `adapter_cards` (files of JSON objects, one a
line, read by the adapter of the option `adapter`). Both take a folder as the option `path`, of any file system that pyarrow
opens, and the option `extension` if other files lie there too. Each file is a partition. Only the columns of the schema that is asked for
are made (`.schema("company string, cik string")`, by name, in that order).

As a stream, files are taken by their time and name; an offset is the last file taken. A file is never read twice, also after a restart,
as long as files come with times that aren't earlier than those already read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import date

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from contactmill.functions.text import BLANKS

from . import readers

#: Rows of a batch that a reader hands on.
BATCH = 8192


class File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


def _files(options: dict) -> list[tuple[int, str]]:
    """Time in nanoseconds and place of the folder's files, in order; hidden and unfinished ones left out."""
    from pyarrow.fs import FileSelector, FileSystem, FileType

    system, folder = FileSystem.from_uri(_uri(options["path"]))
    found = system.get_file_info(FileSelector(folder, allow_not_found=True))
    end = options.get("extension", "")
    return sorted((f.mtime_ns or 0, f.path) for f in found if f.type == FileType.File and f.base_name[0] not in "._" and f.base_name.endswith(end))


def _uri(path: str) -> str:
    """Spark's spelling of local places has one slash or none."""
    if re.match(r"file:/[^/]", path):
        return "file://" + path[5:]
    return path if "://" in path else f"file://{path}"


class _Lines:
    """Reads the lines of a file; a subclass makes rows of them."""

    def __init__(self, schema: T.StructType, options: dict) -> None:
        self.schema, self.options = schema, options

    def rows(self, line: str) -> Iterator[tuple]:
        raise NotImplementedError

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        system, _ = FileSystem.from_uri(_uri(self.options["path"]))
        kinds, out = to_arrow_schema(self.schema), []
        make = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kinds)], schema=kinds)
        with system.open_input_stream(partition.path) as source:
            rest = b""
            while block := source.read(1 << 20):
                *lines, rest = (rest + block).split(b"\n")
                for line in lines:
                    out += self.rows(line.decode("utf-8", "replace"))
                    if len(out) >= BATCH:
                        yield make()
                        out = []
            if rest:
                out += self.rows(rest.decode("utf-8", "replace"))
        if out:
            yield make()


class _Batch(DataSourceReader):
    def __init__(self, lines: _Lines) -> None:
        self.lines = lines

    def partitions(self) -> list[File]:
        return [File(path) for _, path in _files(self.lines.options)]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        # A folder without files has one partition that stands for none.
        return self.lines.read(partition) if partition is not None else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, lines: _Lines) -> None:
        self.lines = lines

    def initialOffset(self) -> dict:  # noqa: N802
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        files = _files(self.lines.options)
        return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[File]:
        at = lambda o: (o["time"], o["path"])
        return [File(f[1]) for f in _files(self.lines.options) if at(start) < f <= at(end)]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        return self.lines.read(partition)

    def commit(self, end: dict) -> None:
        pass


class _Folder(DataSource):
    lines: type[_Lines]

    def reader(self, schema: T.StructType) -> _Batch:
        return _Batch(self.lines(schema, dict(self.options)))

    def streamReader(self, schema: T.StructType) -> _Stream:  # noqa: N802
        return _Stream(self.lines(schema, dict(self.options)))


class _Index(_Lines):
    LINE = re.compile(r"(.{62})\s*(\S+)\s+(\d+)\s+(\d{4}-\d{2}-\d{2})\s+(\S+)")
    MAKE = {
        "company": lambda m: m[1].strip(" "), "form": lambda m: m[2], "cik": lambda m: m[3].lstrip("0") or "0", "filed": lambda m: _date(m[4]), "file": lambda m: m[5],
    }

    def rows(self, line: str) -> Iterator[tuple]:
        m = self.LINE.match(line)
        if m and m[2] in readers.FORM_D:
            yield tuple(self.MAKE[f.name](m) for f in self.schema)


def _date(text: str) -> date | None:
    try:
        return date.fromisoformat(text)
    except ValueError:
        return None


class FilingIndex(_Folder):
    """Rows of the forms that name officers."""

    lines = _Index

    @classmethod
    def name(cls) -> str:
        return "filing_index"

    def schema(self) -> str:
        return "company string, form string, cik string, filed date, file string"


class _Cards(_Lines):
    def __init__(self, schema: T.StructType, options: dict) -> None:
        super().__init__(schema, options)
        self.selectors = readers.SELECTORS
        if options.get("adapter") not in readers.adapters.all:
            raise ValueError(f"no adapter of the name {options.get('adapter')!r}; there are {', '.join(readers.adapters.names())}")

    def _field(self, card: dict, name: str) -> str | None:
        """The first selector's text that isn't a spelling of nothing."""
        for s in self.selectors[name]:
            text = str(card[s]).strip(" ") if card.get(s) is not None else ""
            if text.lower() not in BLANKS:
                return text
        return None

    def rows(self, line: str) -> Iterator[tuple]:
        card = json.loads(line) if line.strip() else {}
        if isinstance(card, dict) and self._field(card, "name") is not None:
            yield tuple(self.options["adapter"] if f.name == "source" else self._field(card, f.name) for f in self.schema)


class AdapterCards(_Folder):
    """Leads of cards by an adapter of the registry; cards without name left out."""

    lines = _Cards

    @classmethod
    def name(cls) -> str:
        return "adapter_cards"

    def schema(self) -> str:
        return ", ".join(f"{c} string" for c in (*readers.SELECTORS, "source"))


def register(spark: SparkSession) -> None:
    for source in (FilingIndex, AdapterCards):
        spark.dataSource.register(source)
