"""python -m lodestone INDEX demo | ingest FOLDER | delete ID... | documents | ask QUESTION [MODE] | history | evaluate

Tables are printed row by row as JSON lines, all of them, as they come from the cluster."""

from __future__ import annotations

import json
import sys

from pyspark.sql import DataFrame, SparkSession

from .service import Service
from .settings import Settings


def show(found) -> None:
    """Prints a value, or every row of a table without holding more than a part of it."""
    if isinstance(found, DataFrame):
        for row in found.toLocalIterator():
            print(json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str))
    elif isinstance(found, dict) and any(isinstance(v, DataFrame) for v in found.values()):
        print(json.dumps({k: v for k, v in found.items() if not isinstance(v, DataFrame)}, ensure_ascii=False, default=str))
        for v in found.values():
            if isinstance(v, DataFrame):
                show(v)
    else:
        print(json.dumps(found, ensure_ascii=False, default=str, indent=1))


COMMANDS = {
    "demo": lambda s: s.demo(), "ingest": lambda s, folder: s.ingest(folder), "delete": lambda s, *ids: {"revision": s.delete(list(ids))}, "documents": lambda s: s.documents(),
    "ask": lambda s, question, mode="hybrid": s.ask_one(question, mode), "history": lambda s: s.history(), "evaluate": lambda s: s.evaluate(),
}


def main(args: list[str], spark: SparkSession | None = None) -> int:
    if len(args) < 2 or args[1] not in COMMANDS:
        print(__doc__, file=sys.stderr)
        return 2
    try:
        show(COMMANDS[args[1]](Service(spark or SparkSession.builder.getOrCreate(), args[0], Settings.from_env()), *args[2:]))
    except (ValueError, OSError, RuntimeError, KeyError, TypeError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
