"""Sites as a data source: documents read by tasks, one partition and one session a host.

`spark.read.format("newsloom_sites")` with `urls`, a JSON list of addresses (a registry's feeds), reads
over HTTP; with `path`, it reads the Parquet files of a folder that has a folder `host=...` for each host. Filters on
host are pushed down and leave out whole partitions before a session is opened.
"""

from __future__ import annotations

import http.client
import json
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

SCHEMA = "host string, url string, status int, content_type string, content string"
ROWS = 1000


@dataclass
class Site(InputPartition):
    host: str
    #: addresses, or the files of a folder
    items: tuple[str, ...]


class HttpSession:
    """One connection to a host, used for all its addresses and opened again if the host closed it."""

    def __init__(self, host: str, timeout: float, headers: dict[str, str]) -> None:
        self.host, self.timeout, self.headers, self.open = host, timeout, {"User-Agent": "newsloom/1.0"} | headers, {}

    def get(self, url: str) -> tuple[int | None, str | None, str | None]:
        parts = urlsplit(url)
        kind = http.client.HTTPSConnection if parts.scheme == "https" else http.client.HTTPConnection
        for attempt in range(2):
            link = self.open.get(url.split("//")[0]) or kind(parts.netloc, timeout=self.timeout)
            self.open[url.split("//")[0]] = link
            try:
                link.request("GET", (parts.path or "/") + (f"?{parts.query}" if parts.query else ""), headers=self.headers)
                reply = link.getresponse()
                return reply.status, reply.headers.get_content_type(), reply.read().decode("utf-8", "replace")
            except (OSError, http.client.HTTPException):
                link.close()
                del self.open[url.split("//")[0]]
                if attempt:
                    return None, None, None
        return None, None, None

    def close(self) -> None:
        for link in self.open.values():
            link.close()


class SitesReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options, self.hosts, self.begin = options, None, ""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  a name of the API
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("host",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.hosts = wanted if self.hosts is None else self.hosts & wanted
            elif isinstance(f, StringStartsWith) and f.attribute == ("host",) and (f.value.startswith(self.begin) or self.begin.startswith(f.value)):
                self.begin = max(self.begin, f.value, key=len)
            else:
                yield f

    def _asked(self, host: str) -> bool:
        return (self.hosts is None or host in self.hosts) and host.startswith(self.begin)

    def partitions(self) -> list[Site]:
        by: dict[str, list[str]] = {}
        if "urls" in self.options:
            for url in json.loads(self.options["urls"]):
                by.setdefault(urlsplit(url).netloc, []).append(url)
        else:
            fs, root = pa.fs.FileSystem.from_uri(self.options["path"])
            for host in fs.get_file_info(pa.fs.FileSelector(root)):
                name = unquote(posixpath.basename(host.path).removeprefix("host="))
                if posixpath.basename(host.path).startswith("host=") and self._asked(name):
                    by[name] = sorted(f.path for f in fs.get_file_info(pa.fs.FileSelector(host.path)) if f.path.endswith(".parquet"))
        return [Site(h, tuple(items)) for h, items in sorted(by.items()) if self._asked(h)] or [Site("", ())]

    def read(self, partition: Site) -> Iterator[pa.RecordBatch]:
        return self._fetched(partition) if "urls" in self.options else self._stored(partition)

    def _fetched(self, site: Site) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = pa.schema([(n, pa.int32() if n == "status" else pa.string()) for n in names])
        session = HttpSession(site.host, float(self.options.get("timeout", 10)), json.loads(self.options.get("headers", "{}")))
        try:
            for url in site.items:
                yield pa.RecordBatch.from_pylist([dict(zip(names, (site.host, url, *session.get(url)), strict=True))], kinds)
        finally:
            session.close()

    def _stored(self, site: Site) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        if not site.items:
            return
        fs, _ = pa.fs.FileSystem.from_uri(self.options["path"])
        for path in site.items:
            with fs.open_input_file(path) as f:
                for batch in pq.ParquetFile(f).iter_batches(ROWS, columns=["url", "html"]):
                    n = len(batch)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([site.host] * n), batch.column("url").cast(pa.string()), pa.array([200] * n, pa.int32()), pa.array(["text/html"] * n), batch.column("html").cast(pa.string())],
                        names=[c.split()[0] for c in SCHEMA.split(", ")],
                    )


class SitesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "newsloom_sites"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SitesReader:
        return SitesReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SitesSource)
