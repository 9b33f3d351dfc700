"""Remote sources: fetching with retries, in the tasks that hold the addresses.

What opens an address is an argument, so that a cluster's proxies, a cache or a test can stand in; the
default is the standard library's. Responses go to the parsers of ``operators.align`` and ``extract``."""

from __future__ import annotations

import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (address, headers, seconds) -> (status, body)
Opener = Callable[[str, dict[str, str], float], tuple[int, str]]

# How long to wait for an answer, and between tries.
TIMEOUT = 15.0
TRIES, FIRST_WAIT, LONGEST_WAIT = 3, 2.0, 60.0
USER_AGENT = "graphloom/1.0"


def open_url(address: str, headers: dict[str, str], seconds: float) -> tuple[int, str]:
    try:
        with urllib.request.urlopen(urllib.request.Request(address, headers=headers), timeout=seconds) as answer:
            return answer.status, answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, ""


def fetched(address: str, opener: Opener = open_url, tries: int = TRIES, wait: Callable[[float], None] = time.sleep, headers: dict[str, str] | None = None) -> tuple[str | None, str | None]:
    """(body, error) of an address: a busy or failing server is asked again, after waits that double; an
    answer that isn't a success, and any error of the last try, is an error and no body."""
    pause, error = FIRST_WAIT, None
    for i in range(tries):
        try:
            status, body = opener(address, {"User-Agent": USER_AGENT} | (headers or {}), TIMEOUT)
            if 200 <= status < 300:
                return body, None
            error = f"status {status}"
            if status != 429 and status < 500:
                break
        except Exception as e:  # whatever a connection runs into is this address's error
            error = f"{type(e).__name__}: {e}"[:200]
        if i + 1 < tries:
            wait(pause)
            pause = min(2 * pause, LONGEST_WAIT)
    return None, error


def fetch(addresses: DataFrame, *, url_col: str = "url", opener: Opener = open_url, tries: int = TRIES, delay: float = 0.0, wait: Callable[[float], None] = time.sleep, headers: dict[str, str] | None = None) -> DataFrame:
    """``addresses`` with ``body`` and ``error``. Map-only: each task asks one address after the other,
    ``delay`` seconds apart; a failed one is a row with an error, so a lost task repeats its own rows
    only. Null addresses are errors."""
    place = addresses.columns.index(url_col)
    columns = addresses.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for address in batch.column(place).to_pylist():
                found.append(fetched(address, opener, tries, wait, headers) if address else (None, "no address"))
                if delay:
                    wait(delay)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([b for b, _ in found], pa.string()), pa.array([e for _, e in found], pa.string())], names=[*columns, "body", "error"])

    return addresses.mapInArrow(run, addresses.selectExpr("*", "cast(null as string) as body", "cast(null as string) as error").schema)


def search_addresses(labels: DataFrame, endpoint: str, most: int = 5) -> DataFrame:
    """(label, url) of entity searches by label, in English."""
    query = F.concat(F.lit(f"{endpoint}?action=wbsearchentities&language=en&format=json&limit={most}&search="), F.call_function("url_encode", F.col("label")))
    return labels.select("label", query.alias("url"))


def neighbour_addresses(entities: DataFrame, endpoint: str, most: int = 200) -> DataFrame:
    """(qid, url) of queries for an entity's direct properties and their values."""
    text = F.concat(
        F.lit("SELECT ?prop ?obj WHERE { wd:"), "qid",
        F.lit(f' ?prop ?obj . FILTER(STRSTARTS(STR(?prop), "http://www.wikidata.org/prop/direct/")) FILTER(!isLiteral(?obj) || lang(?obj) = "en" || lang(?obj) = "") }} LIMIT {most}'),
    )
    return entities.select("qid", F.concat(F.lit(f"{endpoint}?format=json&query="), F.call_function("url_encode", text)).alias("url"))
