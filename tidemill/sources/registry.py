"""Source types by key: how rows of the source dimension become DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemill.sources import feeds

Reader = Callable[[SparkSession, str], DataFrame]
_READERS: dict[str, Reader] = {}


def register(kind: str) -> Callable[[Reader], Reader]:
    """Add a source type."""

    def put(reader: Reader) -> Reader:
        if kind in _READERS:
            raise ValueError(f"source type {kind} exists")
        _READERS[kind] = reader
        return reader

    return put


def read(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """Rows of a source of a type at a landed path."""
    if kind not in _READERS:
        raise ValueError(f"no source type {kind}; known: {', '.join(sorted(_READERS))}")
    return _READERS[kind](spark, path)


@register("rss")
def _rss(spark: SparkSession, path: str) -> DataFrame:
    return feeds.rss_items(spark, path, "item")


@register("atom")
def _atom(spark: SparkSession, path: str) -> DataFrame:
    return feeds.atom_entries(spark.read.text(path, wholetext=True).withColumnRenamed("value", "payload"))


def _json(feed: str) -> Reader:
    def read_feed(spark: SparkSession, path: str) -> DataFrame:
        return feeds.feed_jobs(spark.read.text(path, wholetext=True).withColumnRenamed("value", "payload"), feed)

    return read_feed


for _name in feeds.FEEDS:
    register(_name)(_json(_name))
