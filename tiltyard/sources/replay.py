"""A battle log as a Spark data source: recorded responses, a JSON file a player, read in batch or as a stream."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "tag string, battle string"


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def listed(folder: str) -> list[str]:
    return sorted(os.path.join(folder, f) for f in os.listdir(folder) if f.endswith(".json"))


def rows(paths: list[str]) -> Iterator[tuple[str, str]]:
    """A file is a list of battles and is named after its player's tag; an unreadable one has none."""
    for path in paths:
        try:
            with open(path, encoding="utf-8") as f:
                battles = json.load(f)
        except (OSError, ValueError):
            continue
        for battle in battles if isinstance(battles, list) else []:
            yield "#" + os.path.splitext(os.path.basename(path))[0], json.dumps(battle)


class BattleLog(DataSource):
    """``spark.dataSource.register(BattleLog)``, then format "battlelog" with the option ``path``: a folder that
    all executors can open, and ``files`` a partition (100)."""

    @classmethod
    def name(cls) -> str:
        return "battlelog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BattleLogReader:
        return BattleLogReader(self.options["path"], int(self.options.get("files", 100)))

    def streamReader(self, schema) -> BattleLogStream:
        return BattleLogStream(self.options["path"], int(self.options.get("files", 100)))


class BattleLogReader(DataSourceReader):
    def __init__(self, path: str, files: int):
        self.path, self.files = path, files

    def partitions(self) -> list[InputPartition]:
        names = listed(self.path)
        return [Files(names[i : i + self.files]) for i in range(0, len(names), self.files)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        yield from rows(partition.paths)


class BattleLogStream(DataSourceStreamReader):
    """Offsets are how many files of the folder, in order of their names, have been read: names must grow."""

    def __init__(self, path: str, files: int):
        self.path, self.files = path, files

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        return {"files": len(listed(self.path))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        names = listed(self.path)[start["files"] : end["files"]]
        return [Files(names[i : i + self.files]) for i in range(0, len(names), self.files)]

    def read(self, partition: Files) -> Iterator[tuple]:
        yield from rows(partition.paths)

    def commit(self, end: dict) -> None:
        pass
