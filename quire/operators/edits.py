"""Edits of many files, and a sink for them."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from ..pdf import icc
from ..pdf.objects import PdfError


def edit_files(files: DataFrame, edit: Callable[[bytes], bytes]) -> DataFrame:
    """(doc_id, content, error): each file after the edit, or why it was refused; null contents stay null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, content in zip(batch["doc_id"], batch["content"], strict=True):
                try:
                    out.append((doc_id, None if content is None else edit(bytes(content)), None))
                except (PdfError, RecursionError) as e:
                    out.append((doc_id, None, getattr(e, "code", "nesting-limit")))
            yield pd.DataFrame(out, columns=["doc_id", "content", "error"])

    return files.select("doc_id", "content").mapInPandas(run, "doc_id string, content binary, error string")


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes contents as files of a folder, a path or the URI of any store that Arrow reaches; (doc_id, file, bytes).

    A plain doc_id is the file's name; of any other, such as a path, the last part and a digest of the whole, so that
    files of one name from two folders never meet. It appears whole or not at all, and a task that runs again writes the same file again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(base, recursive=True)
        for batch in batches:
            out = []
            for doc_id, content in zip(batch["doc_id"], batch["content"], strict=True):
                tail, whole = str(doc_id).rsplit("/", 1)[-1].removesuffix(".pdf"), hashlib.blake2b(str(doc_id).encode(), digest_size=8).hexdigest()
                name = f"{tail}.pdf" if tail == doc_id else f"{tail}-{whole}.pdf"
                part = f"{base}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as f:
                    f.write(bytes(content))
                store.move(part, f"{base}/{name}")
                out.append((doc_id, name, len(content)))
            yield pd.DataFrame(out, columns=["doc_id", "file", "bytes"])

    return files.filter(F.col("content").isNotNull()).select("doc_id", "content").mapInPandas(run, "doc_id string, file string, bytes long")


def convert_colours(colours: DataFrame, source: bytes, target: bytes, intent: str = "relative") -> DataFrame:
    """colours with converted, an array: each distinct colour is converted once and joined back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = icc.transform(icc.Profile(source), icc.Profile(target), intent)
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"components": batch["components"], "converted": list(f(np.stack(batch["components"].to_numpy())))})

    each = colours.select("components").distinct().mapInPandas(run, "components array<double>, converted array<double>")
    return colours.join(each, "components", "left")
