"""A Python data source of days, one partition a month."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Calendar(DataSource):
    """spark.read.format("calendar") with options from (included) and until (not included), as yyyy-mm-dd."""

    @classmethod
    def name(cls) -> str:
        return "calendar"

    def schema(self) -> str:
        return "day date"

    def reader(self, schema) -> DataSourceReader:
        return _Days(self.options["from"], self.options["until"])


class _Days(DataSourceReader):
    def __init__(self, since: str, until: str):
        self.since, self.until = datetime.date.fromisoformat(since), datetime.date.fromisoformat(until)

    def partitions(self) -> list[InputPartition]:
        found, at = [], self.since
        while at < self.until:
            following = (at.replace(day=1) + datetime.timedelta(days=32)).replace(day=1)
            found.append(InputPartition((at, min(following, self.until))))
            at = following
        return found

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        at, end = partition.value
        while at < end:
            yield (at,)
            at += datetime.timedelta(days=1)
