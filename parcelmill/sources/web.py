"""Listing pages as a Spark data source: a partition per place, read page by page until one has no results."""

from __future__ import annotations

import time
import urllib.request
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .shared import Files

#: Attempts and seconds for a page, first and longest wait of the back-off.
ATTEMPTS, TIMEOUT = 20, 1.0
FIRST_DELAY, LAST_DELAY = 0.1, 5.0


def page_url(base: str, number: int) -> str:
    return f"{base}-{number:d}"


def page_url_of(base: str, number: int, postcode: int, state: str, postfix: str = "") -> str:
    return f"{base}in-{postcode:d}+{state}/list-{number:d}{postfix}"


def page_url_column(base: str, number: Column) -> Column:
    return F.format_string(f"{base.replace('%', '%%')}-%d", number)


def page_url_of_column(base: str, number: Column, postcode: Column, state: Column, postfix: str = "") -> Column:
    return F.format_string(f"{base.replace('%', '%%')}in-%d+%s/list-%d{postfix.replace('%', '%%')}", postcode, state, number)


def get(url: str, timeout: float = TIMEOUT) -> str:
    with urllib.request.urlopen(url, timeout=timeout) as answer:
        return answer.read().decode("utf-8", "replace")


def with_attempts(fetch: Callable[[str], str], url: str, attempts: int = ATTEMPTS) -> str:
    """The page, trying again on errors; the last error is raised."""
    for n in range(attempts):
        try:
            return fetch(url)
        except OSError:
            if n == attempts - 1:
                raise
    raise ValueError("no attempts")


def with_backoff(fetch: Callable[[str], str], url: str, delay: float = FIRST_DELAY, longest: float = LAST_DELAY, sleep=time.sleep) -> str:
    """The page, waiting twice as long after each error until that would be longer than allowed."""
    while True:
        try:
            return fetch(url)
        except OSError:
            if delay > longest:
                raise
            sleep(delay)
            delay *= 2


def pages_until_empty(fetch: Callable[[str], str], url_of: Callable[[int], str], first: int, last: int, is_empty: Callable[[str], bool]) -> Iterator[tuple[int, str]]:
    """(number, html) of pages up to the first without results."""
    for number in range(first, last + 1):
        html = with_attempts(fetch, url_of(number))
        if is_empty(html):
            return
        yield number, html


class Place(InputPartition):
    def __init__(self, state: str | None, postcode: int | None):
        self.state, self.postcode = state, postcode


class ListingPagesReader(DataSourceReader):
    def __init__(self, options):
        self.base = options["base"]
        self.first, self.last = int(options.get("firstpage", "1")), int(options.get("lastpage", "50"))
        self.empty_mark = options.get("emptymark", "no results")
        self.postfix = options.get("postfix", "")
        self.places = [tuple(p.split(":")) for p in options.get("places", "").split(",") if p]

    def partitions(self):
        return [Place(s, int(p)) for s, p in self.places] or [Place(None, None)]

    def read(self, partition):
        if partition.postcode is None:
            url_of = lambda n: page_url(self.base, n)
        else:
            url_of = lambda n: page_url_of(self.base, n, partition.postcode, partition.state, self.postfix)
        for number, html in pages_until_empty(get, url_of, self.first, self.last, lambda h: self.empty_mark in h):
            yield partition.state, partition.postcode, number, html


class ListingPages(DataSource):
    """Options: base, firstPage, lastPage, emptyMark, postfix, places ("state:postcode,...", none for one search)."""

    @classmethod
    def name(cls):
        return "listing_pages"

    def schema(self):
        return "state string, postcode int, page int, html string"

    def reader(self, schema):
        return ListingPagesReader(self.options)


def crawl(spark, path: str, places: Sequence[tuple[str, int]], places_per_step: int = 64, most_steps: int | None = None, **options):
    """Fetch the pages of all places and store them as Parquet, going on where a crawl of these places stopped.

    A step is a Spark job over the next places, one task each, and a folder of its own.  Spark marks a folder complete
    as the last thing it does, so a step that broke off is done again and replaces what it left, and complete steps are
    passed over: each page is stored once however often a crawl is broken off.  most_steps ends a crawl early.  Returns
    the pages stored so far (state, postcode, page, html).
    """
    spark.dataSource.register(ListingPages)
    files, done = Files(spark, path), 0
    reader = spark.read.format("listing_pages").options(**options)
    steps = range(0, len(places), places_per_step)
    for at in steps:
        if "_SUCCESS" in files.names(f"step-{at:09d}-{places_per_step}"):
            continue
        if most_steps is not None and done >= most_steps:
            break
        wanted = ",".join(f"{state}:{postcode}" for state, postcode in places[at : at + places_per_step])
        reader.option("places", wanted).load().write.mode("overwrite").parquet(f"{path}/step-{at:09d}-{places_per_step}")
        done += 1
    complete = [f"{path}/{n}" for n in files.names() if n.startswith("step-") and "_SUCCESS" in files.names(n)]
    schema = "state string, postcode int, page int, html string"
    return spark.read.schema(schema).parquet(*complete) if complete else spark.createDataFrame([], schema)


def search_description(states: list[str], postcodes: list[int]) -> str:
    return ", ".join(f"{s} {p}" for s, p in zip(states, postcodes, strict=True))
