"""Polled feeds as a stream: a Python data source with an offset for each feed and one partition a feed."""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from mosaiq.sources.feeds import items

SCHEMA = "outlet_id int, feed string, poll long, xml string"
_POLL = re.compile(r"(\d+)\.xml$")


def _open(path: str):
    """A file system that tasks and the driver open by themselves, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _polls(path: str) -> dict[str, list[int]]:
    """The polls of each feed under the path, by number. A poll counts once its file has its final name."""
    from pyarrow import fs

    files, root = _open(path)
    found: dict[str, list[int]] = {}
    for info in files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        name = _POLL.search(posixpath.basename(info.path))
        if info.type == fs.FileType.File and name:
            found.setdefault(posixpath.relpath(posixpath.dirname(info.path), root), []).append(int(name[1]))
    return {feed: sorted(numbers) for feed, numbers in found.items()}


@dataclass
class FeedPart(InputPartition):
    """Polls of one feed after `start`, up to `end`."""

    feed: str
    start: int
    end: int


class FeedReader(DataSourceStreamReader):
    """An offset is the number of the last poll of each feed; feeds may come and stand still. A batch is read again from
    its offsets alone, so a restart neither loses a poll nor reads one twice."""

    def __init__(self, path: str, outlets: dict[str, int]) -> None:
        self.path, self.outlets = path.rstrip("/"), outlets

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {feed: numbers[-1] for feed, numbers in sorted(_polls(self.path).items())}

    def partitions(self, start: dict, end: dict) -> list[FeedPart]:
        return [FeedPart(feed, int(start.get(feed, -1)), int(last)) for feed, last in end.items() if int(last) > int(start.get(feed, -1))]

    def read(self, partition: FeedPart) -> Iterator[pa.RecordBatch]:
        files, root = _open(self.path)
        from pyarrow import fs

        folder = posixpath.join(root, partition.feed)
        for info in sorted(files.get_file_info(fs.FileSelector(folder)), key=lambda x: x.path):
            name = _POLL.search(posixpath.basename(info.path))
            if name and partition.start < int(name[1]) <= partition.end:
                with files.open_input_stream(info.path) as f:
                    xml = f.read().decode("utf-8", "replace")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([self.outlets.get(partition.feed)], pa.int32()), pa.array([partition.feed]), pa.array([int(name[1])], pa.int64()), pa.array([xml])], ["outlet_id", "feed", "poll", "xml"]
                )

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class FeedSource(DataSource):
    """Options: path, a folder with one folder a feed, in which each poll is a file <number>.xml; outlets, a JSON object from
    feeds to outlets' ids. Rows: outlet_id, feed, poll, xml."""

    @classmethod
    def name(cls) -> str:
        return "feeds"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> FeedReader:
        return FeedReader(self.options["path"], {k: int(v) for k, v in json.loads(self.options.get("outlets", "{}")).items()})


def feed_stream(spark: SparkSession, path: str, outlets: dict[str, int]) -> DataFrame:
    """The polls of feeds as they come."""
    spark.dataSource.register(FeedSource)
    return spark.readStream.format("feeds").option("path", path).option("outlets", json.dumps(outlets)).load()


def feed_items(polls: DataFrame, as_of: Column) -> DataFrame:
    """The items of polls, streamed or not. Polls of a feed overlap, so an item comes in several; ingest keeps the first."""
    return items(polls.select("outlet_id", "feed", "xml"), as_of)
