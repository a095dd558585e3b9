"""One file a document, written where the documents are, with a manifest of what was written."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmark.errors import LeafmarkError


def stem(doc_id: Column) -> Column:
    """The last part of a document's name without .pdf or .jsonl."""
    return F.regexp_replace(F.element_at(F.split(doc_id.cast("string"), "/"), -1), r"(?i)\.(pdf|jsonl)$", "")


def write_documents(docs: DataFrame, out: str, suffix: str, pretty: bool = False) -> DataFrame:
    """Writes content of (doc_id, content) to files STEM.suffix in the folder `out`, which all executors share: doc_id, path, chars.

    A task writes a file under a name of its attempt and moves it to its own when it is whole, so a file is never half
    there, and a task that runs again replaces its own. Two documents of one stem raise PAGE_RENDER before anything is
    written. A document is one row, which bounds the memory of a task. pretty: the content is JSON, and is indented.
    The files are written when the manifest is read.
    """
    named = docs.select(F.col("doc_id").cast("string").alias("doc_id"), stem(F.col("doc_id")).alias("stem"), "content")
    twice = named.groupBy("stem").agg(F.countDistinct("doc_id").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise LeafmarkError("PAGE_RENDER", f"{twice[0].n} documents are called {twice[0].stem}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(out if "://" in out else os.path.abspath(out))
        system.create_dir(folder)
        for batch in batches:
            for doc, name, content in zip(batch["doc_id"], batch["stem"], batch["content"], strict=True):
                text = json.dumps(json.loads(content), indent=1, ensure_ascii=False) if pretty else content
                path, attempt = f"{folder.rstrip('/')}/{name}.{suffix}", f"{folder.rstrip('/')}/.{name}.{uuid.uuid4().hex}"
                with system.open_output_stream(attempt, compression=None) as f:
                    f.write(text.encode("utf-8"))
                system.move(attempt, path)
                yield pd.DataFrame([{"doc_id": doc, "path": path, "chars": len(text)}])

    return named.mapInPandas(run, "doc_id string, path string, chars long")
