"""Pages from wherever a function gets them: executors call it, and failures are rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Get = Callable[[str], tuple[int, str, str]]


def variants(url: Column) -> Column:
    """The four addresses that a site may answer at: with and without www, over https and http."""
    bare = F.regexp_replace(F.trim(url), r"^(https?://)?(www\.)?", "")
    return F.array(*(F.concat(F.lit(start), bare) for start in ("https://www.", "https://", "http://www.", "http://")))


def fetched(urls: DataFrame, get: Callable[[], Get]) -> DataFrame:
    """urls with status, final (the address after redirects), html and error, for every row of urls(url, ...).

    get() is called once in a task and gives the function that fetches a page.  What it raises is the error of the row; a
    null url has the error that it is null.
    """
    at = urls.columns.index("url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fetch = get()
        for batch in batches:
            out = []
            for url in batch.column(at).to_pylist():
                try:
                    out.append((*fetch(url), None) if url is not None else (None, None, None, "no url"))
                except Exception as e:  # any failure of a fetch is a result
                    out.append((None, None, None, f"{type(e).__name__}: {e}"))
            types = (pa.int32(), pa.string(), pa.string(), pa.string())
            columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 4, types)]
            yield pa.record_batch([*batch.columns, *columns], names=[*batch.schema.names, "status", "final", "html", "error"])

    more = T.StructType().add("status", "integer").add("final", "string").add("html", "string").add("error", "string")
    return urls.mapInArrow(run, T.StructType([*urls.schema.fields, *more.fields]))
