"""Fetching over HTTP in tasks, with retries and proxies. TLS is verified."""

from __future__ import annotations

import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import ensure_utf8


@dataclass(frozen=True)
class Proxy:
    url: str
    protocol: str = "http"

    def address(self) -> str:
        return self.url if self.url.startswith(("http://", "https://")) else f"{self.protocol}://{self.url}"


class ProxyPool:
    """Proxies in turn or at random, past those that failed; when all have, they are all tried anew."""

    def __init__(self, proxies: list[Proxy] | tuple[Proxy, ...], seed: int | None = None) -> None:
        self.dice = random.Random(seed)
        self.refresh(proxies)

    def refresh(self, proxies: list[Proxy] | tuple[Proxy, ...]) -> None:
        """Another list; failures are forgotten and the turn begins anew."""
        self.proxies, self.failed, self.turn = list(proxies), set(), 0

    def _able(self) -> list[Proxy]:
        if self.proxies and all(p.address() in self.failed for p in self.proxies):
            self.failed.clear()
        return [p for p in self.proxies if p.address() not in self.failed]

    def next(self) -> Proxy | None:
        able = {p.address() for p in self._able()}
        while able:
            p = self.proxies[self.turn % len(self.proxies)]
            self.turn += 1
            if p.address() in able:
                return p
        return None

    def random(self) -> Proxy | None:
        able = self._able()
        return self.dice.choice(able) if able else None

    def mark_failed(self, proxy: Proxy) -> None:
        self.failed.add(proxy.address())

    def reset(self) -> None:
        self.failed.clear()

    def stats(self) -> dict[str, int]:
        return {"total": len(self.proxies), "failed": len(self.failed), "available": len(self.proxies) - len(self.failed)}


def get(url: str, timeout: int, proxy: Proxy | None = None) -> tuple[int, str, bytes]:
    handlers = [urllib.request.ProxyHandler({"http": proxy.address(), "https": proxy.address()})] if proxy else []
    request = urllib.request.Request(url, headers={"User-Agent": "newsloom/1.0"})
    with urllib.request.build_opener(*handlers).open(request, timeout=timeout) as reply:
        return reply.status, reply.headers.get_content_type(), reply.read()


def _code(status: int) -> str | None:
    return None if status == 200 else "HTTP_REDIRECT" if status in (301, 302, 303, 307, 308) else "HTTP_ERROR"


def fetch(feeds: DataFrame, retries: int = 5, backoff: float = 30.0, proxies: tuple[Proxy, ...] = (), read: Callable = get, sleep: Callable = time.sleep) -> DataFrame:
    """feeds(feed_id, url, timeout_seconds) with status, content_type, content, attempts, error and last_error. One failure is one row.

    error is FETCH_FAILED after the last attempt, with the reason of that in last_error: HTTP_REDIRECT, HTTP_ERROR,
    FETCH_TIMEOUT or FETCH_ERROR. A feed with a column circuit_open that is true is not read: CIRCUIT_BREAKER_OPEN.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool = ProxyPool(proxies)
        for pdf in batches:
            rows = []
            for f in pdf.itertuples():
                status, kind, body, error, attempt = None, None, None, None, 0
                if f.circuit_open:
                    rows.append((f.feed_id, f.url, None, None, None, 0, "CIRCUIT_BREAKER_OPEN", None))
                    continue
                for attempt in range(retries + 1):
                    proxy = pool.next()
                    try:
                        status, kind, body = read(f.url, f.timeout_seconds, proxy)
                        error = _code(status)
                    except urllib.error.HTTPError as e:
                        status, error = e.code, _code(e.code)
                    except (OSError, ValueError) as e:
                        error = "FETCH_TIMEOUT" if isinstance(e, TimeoutError) else "FETCH_ERROR"
                        if proxy:
                            pool.mark_failed(proxy)
                    if error is None:
                        break
                    if attempt < retries:
                        sleep(backoff * 2**attempt)
                rows.append((f.feed_id, f.url, status, kind, body, attempt + 1, error and "FETCH_FAILED", error))
            yield pd.DataFrame(rows, columns=["feed_id", "url", "status", "content_type", "raw", "attempts", "error", "last_error"])

    circuit = F.coalesce("circuit_open", F.lit(False)) if "circuit_open" in feeds.columns else F.lit(False)
    got = feeds.select("feed_id", "url", "timeout_seconds", circuit.alias("circuit_open")).mapInPandas(run, "feed_id string, url string, status int, content_type string, raw binary, attempts int, error string, last_error string")
    return got.withColumn("content", ensure_utf8(F.col("raw"))).drop("raw")
