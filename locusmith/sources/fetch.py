"""Fetching the pages of a document through a reader that can be exchanged, with a cache of files between."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterable
from pathlib import Path
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

PAGES = "source_id string, language string, page string, url string, html string, raw_hash string"


class Reader(Protocol):
    """Gives (status, bytes) of an address."""

    def __call__(self, url: str) -> tuple[int, bytes]: ...


def folder_reader(root: str | Path) -> Reader:
    """A reader of files below a folder, for addresses like any://host/path: what has no file is 404."""

    def read(url: str) -> tuple[int, bytes]:
        base = Path(root).resolve()
        path = (base / url.partition("://")[2]).resolve()
        return (200, path.read_bytes()) if path.is_relative_to(base) and path.is_file() else (404, b"")

    return read


def fetched(spark: SparkSession, links: Iterable[tuple[str, str]], source: str, language: str, read: Reader, cache: str | Path, encoding: str = "utf-8", refetch: bool = False, delay: float = 0.25, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """(source_id, language, page, url, html, raw_hash) of links (page, url), one after the other with a delay, as a polite client fetches.

    A page in the cache <cache>/<source>/<language>/<page>.html is not fetched again unless refetch says so; what is fetched goes there as it came.
    A status other than 2xx ends the run and caches nothing. Bytes that do not fit the encoding become U+FFFD. The pages of one
    document pass through the driver one by one, and are read from the cache by cached_pages where there are more of them.
    """
    folder = Path(cache) / source / language
    rows, asked = [], False
    for page, url in links:
        if "/" in page or page in ("", ".", ".."):
            raise ValueError(f"{page!r} is no name of a page")
        kept = folder / f"{page}.html"
        if refetch or not kept.exists():
            if asked:
                wait(delay)
            asked = True
            status, raw = read(url)
            if not 200 <= status < 300:
                raise ValueError(f"{url}: status {status}")
            folder.mkdir(parents=True, exist_ok=True)
            part = kept.with_suffix(".part")
            part.write_bytes(raw)
            part.replace(kept)
        raw = kept.read_bytes()
        rows.append((source, language, page, url, raw.decode(encoding, "replace"), hashlib.sha256(raw).hexdigest()))
    return spark.createDataFrame(rows, PAGES)
