"""A frame as one file in the rows' order, whole or not at all.

``format("one_file")`` is a Spark data source for writing. The frame's own order
(``orderBy``) gives each task a range of rows; tasks write their rows, encoded, as parts
beside the file, and the driver, once all have committed, joins the parts in order
by copying bytes through a bounded buffer, and puts the file in place by a rename.
A run that fails leaves no file, and the one that was there before stays. Parts of lost attempts are dropped with the folder of parts.

Kinds (option ``kind``):

* ``json``: one JSON list of the rows as objects, indented by two; nulls stay, dates and decimals become strings. With ``within`` (a JSON
  object) the list is that object's last value, under ``key``;
* ``json_texts``: the same list of the column ``value``, whose texts are JSON objects;
* ``json_object``: one JSON object of the columns ``key`` and ``value`` (JSON);
* ``csv``: UTF-8 with a byte-order mark, a header, and CR LF after each row;
* ``text``: the column ``value`` and a line end for each row.
"""

from __future__ import annotations

import csv
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date
from decimal import Decimal

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

BUFFER = 8 << 20


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def plain(value: object) -> object:
    return value.isoformat() if isinstance(value, date) else str(value)


def object_lines(row: dict | list, depth: int) -> str:
    """A row as indented JSON, ``depth`` spaces from the left."""
    return "\n".join(" " * depth + line for line in json.dumps(row, ensure_ascii=False, indent=2, default=plain).split("\n"))


@dataclass
class Part(WriterCommitMessage):
    partition: int
    path: str
    rows: int


class OneFileWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], names: list[str]):
        self.path, self.kind, self.names = options["path"], options.get("kind", "json"), names
        if self.kind not in ("json", "json_texts", "json_object", "csv", "text"):
            raise ValueError(f"no kind {self.kind}")
        self.within, self.key = json.loads(options.get("within", "null")), options.get("key", "rows")
        self.parts = f"{self.path}.parts-{uuid.uuid4().hex}"

    @property
    def listed(self) -> bool:
        return self.kind.startswith("json")

    def encoded(self, rows: Iterator[Row]) -> Iterator[str]:
        depth = 2 if self.within is None else 4
        buffer = io.StringIO(newline="")
        table = csv.writer(buffer)
        for row in rows:
            if self.kind == "json_object":
                yield f"  {json.dumps(row['key'])}: {object_lines(json.loads(row['value']), 2).lstrip()}"
            elif self.listed:
                yield object_lines(row.asDict(recursive=True) if self.kind == "json" else json.loads(row["value"]), depth)
            elif self.kind == "text":
                yield f"{row['value'] or ''}\n"
            else:
                table.writerow(["" if v is None else plain(v) if isinstance(v, date | Decimal) else v for v in row])
                yield buffer.getvalue()
                buffer.seek(0)
                buffer.truncate()

    def write(self, iterator: Iterator[Row]) -> Part:
        store, folder = place(self.parts)
        store.create_dir(folder, recursive=True)
        number, rows = TaskContext.get().partitionId(), 0
        path = f"{folder}/{number:08d}-{uuid.uuid4().hex}"
        with store.open_output_stream(path) as out:
            for rows, text in enumerate(self.encoded(iterator), 1):
                out.write(((",\n" if self.listed and rows > 1 else "") + text).encode())
        return Part(number, path, rows)

    def ends(self, any_rows: bool) -> tuple[str, str]:
        """What stands before and after the rows."""
        if self.kind == "text":
            return "", ""
        if self.kind == "csv":
            buffer = io.StringIO(newline="")
            csv.writer(buffer).writerow(self.names)
            return "﻿" + buffer.getvalue(), ""
        if self.kind == "json_object":
            return ("{\n", "\n}\n") if any_rows else ("{}\n", "")
        if self.within is None:
            return ("[\n", "\n]\n") if any_rows else ("[]\n", "")
        head = json.dumps(self.within, ensure_ascii=False, indent=2)[:-2] + "," if self.within else "{"
        return f'{head}\n  {json.dumps(self.key)}: [' + ("\n" if any_rows else ""), ("\n  ]" if any_rows else "]") + "\n}\n"

    def commit(self, messages: list[Part | None]) -> None:
        store, target = place(self.path)
        parts = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.partition)
        before, after = self.ends(bool(parts))
        made = f"{target}.{uuid.uuid4().hex}"
        store.create_dir(target.rpartition("/")[0] or ".", recursive=True)
        with store.open_output_stream(made) as out:
            out.write(before.encode())
            for n, part in enumerate(parts):
                out.write(b",\n" if n and self.listed else b"")
                with store.open_input_stream(part.path) as read:
                    while chunk := read.read(BUFFER):
                        out.write(chunk)
            out.write(after.encode())
        if store.get_file_info(target).type == fs.FileType.Directory:
            store.delete_dir(target)  # a table of an earlier version
        store.move(made, target)
        self.drop_parts()

    def drop_parts(self) -> None:
        store, folder = place(self.parts)
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)

    def abort(self, messages: list[Part | None]) -> None:
        self.drop_parts()


class OneFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "one_file"

    def writer(self, schema, overwrite: bool) -> OneFileWriter:
        return OneFileWriter({k.lower(): v for k, v in self.options.items()}, schema.names)


def write_one(df: DataFrame, path: str, kind: str, **options: str) -> None:
    """``df``, in its order, as the file ``path``, replacing one that is there."""
    df.sparkSession.dataSource.register(OneFile)
    df.write.format("one_file").options(path=str(path), kind=kind, **options).mode("append").save()
