"""Local copies of remote files, catalogs of sources, and series that are read one by one.

Nothing here runs on executors: it is what a driver does before a scan. Files are kept in a folder that Spark can read.
"""

from __future__ import annotations

import os
import urllib.request
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException

from psephon.sources.files import looks_like_markup, read_series


def download(url: str, timeout: float = 90) -> bytes:
    request = urllib.request.Request(url, headers={"User-Agent": "Mozilla/5.0"})
    with urllib.request.urlopen(request, timeout=timeout) as response:
        return response.read()


def local_copy(name: str, urls: list[str], folder: str, force: bool = False, least_kb: int = 20, get: Callable[[str], bytes] = download) -> str | None:
    """Path of ``name`` in ``folder``: as it is there already (unless ``force``), or from the first address that has it.

    An address that fails, gives fewer than ``least_kb`` kB, or gives a web page instead of data is passed over. None if
    no address is left.
    """
    path = os.path.join(folder, name)
    if os.path.exists(path) and not force:
        return path
    for url in urls:
        try:
            body = get(url)
        except OSError:
            continue
        if len(body) < least_kb * 1024 or looks_like_markup(body[:200].decode("utf-8", "ignore")):
            continue
        os.makedirs(folder, exist_ok=True)
        with open(f"{path}.part", "wb") as f:
            f.write(body)
        os.replace(f"{path}.part", path)
        return path
    return None


def by_template(template: str, path: str) -> str:
    """An address in an archive or mirror: ``{path}`` in the template stands for the original one."""
    return template.format(path=path)


def local_catalog(catalog: dict[str, dict[str, list[str]]], folder: str, **options) -> dict[str, list[str]]:
    """Paths of each office's files, in the order of the catalog ``{office: {file: addresses}}``; missing files are left out."""
    found = {office: [local_copy(name, urls, folder, **options) for name, urls in named.items()] for office, named in catalog.items()}
    return {office: [p for p in paths if p] for office, paths in found.items()}


def series_table(spark: SparkSession, path: str) -> DataFrame:
    """(date, value, metric) of a long CSV; a missing file is an error that says what to do."""
    try:
        return read_series(spark, path)
    except AnalysisException as e:
        raise FileNotFoundError(f"{path} is not there: write the monthly series first (each_series, then write_text_table)") from e


def each_series(names: list[str], read: Callable[[str], DataFrame]) -> tuple[DataFrame | None, dict[str, str]]:
    """All series that can be read, united, and why the others cannot: one that fails or is empty does not stop the rest."""
    frames, skipped = [], {}
    for name in names:
        try:
            frame = read(name)
            if frame.isEmpty():
                raise ValueError("no data")
            frames.append(frame)
        except Exception as e:  # noqa: BLE001 (whatever a source does)
            skipped[name] = str(e).split("\n")[0]
    return (reduce(DataFrame.unionByName, frames) if frames else None), skipped
