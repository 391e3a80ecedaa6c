"""A sink of files by relative path, with commit and abort of the whole write (K1-K5, K9)."""

from __future__ import annotations

import os
import shutil
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

NAME = "quadrille_files"


@dataclass
class Written(WriterCommitMessage):
    """Where a task put its files, under numbers, and their names."""

    folder: str


def local_path(path: str) -> str:
    """A folder that all machines have mounted, from a path or a file: address; other stores are a ValueError."""
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"no mounted folder: {path}")
    return unquote(url.path) if url.scheme else path


class FileWriter(DataSourceWriter):
    """Tasks write below a folder of this write; the commit moves whole files into place, the abort removes that folder."""

    def __init__(self, path: str):
        self.path = path
        self.staging = os.path.join(path, f"_writing-{uuid.uuid4().hex}")
        os.makedirs(self.staging)  # here alone: a task that outlives an abort must not make it again

    def write(self, iterator: Iterator) -> Written:
        folder = os.path.join(self.staging, uuid.uuid4().hex)  # of this attempt alone
        os.mkdir(folder)
        with open(os.path.join(folder, "names"), "w", encoding="utf-8") as names:
            for k, row in enumerate(iterator):
                path, content = row["path"], row["content"]
                parts = (path or "").split("/")
                if not path or any(p in ("", ".", "..") for p in parts) or parts[0].startswith("_") or "\n" in path:
                    raise ValueError(f"no relative path: {path!r}")
                names.write(f"{'' if content is None else k}/{path}\n")
                if content is not None:
                    with open(os.path.join(folder, str(k)), "wb") as f:
                        f.write(content)
        return Written(folder)

    def commit(self, messages: list[Written | None]) -> None:
        gone, made = [], set()
        for m in messages:
            if m is None:
                continue
            with open(os.path.join(m.folder, "names"), encoding="utf-8") as names:
                for line in names:
                    k, path = line.rstrip("\n").split("/", 1)
                    target = os.path.join(self.path, path)
                    if not k:
                        gone.append(target)
                        continue
                    if (top := os.path.dirname(target)) not in made:
                        os.makedirs(top, exist_ok=True)
                        made.add(top)
                    os.replace(os.path.join(m.folder, k), target)
        for target in gone:  # afterwards, so that no file is missing in between
            if os.path.isfile(target):
                os.remove(target)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        for _ in range(50):  # a task that is being stopped may still write
            shutil.rmtree(self.staging, ignore_errors=True)
            if not os.path.exists(self.staging):
                return
            time.sleep(0.1)


class Files(DataSource):
    """Rows (path, content) as files below the option path; a null content removes the file, other files stay."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(local_path(self.options["path"]))


def write_files(rows: DataFrame, path: str) -> None:
    """Files of rows (path, content) below a folder that driver and executors share; all of them are put in place, or none is.

    A path should occur once. Files that rows don't name stay, so that a run writes what is stale alone.
    """
    rows.sparkSession.dataSource.register(Files)
    rows.select("path", "content").write.format(NAME).option("path", path).mode("append").save()


def tile_files(tiles: DataFrame, ext: str = "png") -> DataFrame:
    """(path, content) of tiles (layer, level, tx, ty, state, png): an image or an empty mark, and what it takes the place of (K1, K2).

    layerL_files/level/x_y.ext, or x_y.empty for a tile with nothing to see.
    """
    base = F.format_string("layer%d_files/%d/%d_%d", "layer", "level", "tx", "ty")
    saved = F.col("state") == "saved"
    image = F.struct(F.concat(base, F.lit(f".{ext}")).alias("path"), F.when(saved, F.col("png")).alias("content"))
    empty = F.struct(F.concat(base, F.lit(".empty")).alias("path"), F.when(~saved, F.lit(b"")).alias("content"))
    return tiles.select(F.explode(F.array(image, empty)).alias("f")).select("f.*")
