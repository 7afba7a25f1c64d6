"""python -m stowage.sync SOURCE TARGET [--dry-run | --check] [--table NAME SOURCE_TABLE TARGET_TABLE ...]:
brings the dictionaries of one registry folder into another and compares the policies of tables. Exit 0: in
sync, 1: a slot, name or ID is taken by another dictionary and nothing is written, 2: differences remain,
3: a failure."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from stowage.registry import Entry, Registry, RegistryError
from stowage.sources.tables import PackedTable, column_policies, policy_differences


IN_SYNC, COLLISION, DIFFERENCES, FAILURE = 0, 1, 2, 3


class _Both:
    """A registry as it will be with more entries."""

    def __init__(self, held: Registry, more: list[Entry]):
        self.held, self.more = held, {e.slot: e for e in more}

    def by_slot(self, slot: int) -> Entry | None:
        return self.held.by_slot(slot) or self.more.get(slot)


def sync(source: Registry, target: Registry, dry_run: bool = False, check: bool = False, say=print, tables: dict[str, tuple[PackedTable, PackedTable]] | None = None) -> int:
    """Brings dictionaries over, then compares the policies of ``tables``: name to (source's, target's).

    A dictionary that the target holds under any slot is present. All others are checked for collisions
    before the first is imported, so that a collision writes nothing. ``check`` imports nothing, ``dry_run``
    compares policies as they would be after the import. Gives IN_SYNC, COLLISION or DIFFERENCES.
    """
    there = {e.dict_id: e for e in target.entries()}
    missing = []
    for e in source.entries():
        held = there.get(e.dict_id)
        if held is None:
            missing.append(e)
            if check:
                say(f"{'different' if target.by_slot(e.slot) else 'missing'} slot {e.slot}: {e.name}")
        else:
            say(f"present slot {e.slot}: {e.name}" + ("" if (held.slot, held.name) == (e.slot, e.name) else f" (here slot {held.slot}: {held.name})"))
    if not check:
        try:
            for e in missing:
                target.collision(e.slot, e.name, e.dict_id)
        except RegistryError as error:
            say(f"{error}; nothing is written")
            return COLLISION
        for e in missing:
            if not dry_run:
                target.import_(e.slot, e.name, e.data, e.trained_from)
            say(f"{'would import' if dry_run else 'imported'} slot {e.slot}: {e.name}")
    differences = []
    if tables:
        here = column_policies({name: t for name, (_, t) in tables.items()}, _Both(target, missing) if dry_run else target)
        differences = policy_differences(here, column_policies({name: t for name, (t, _) in tables.items()}, source)).orderBy("table", "column").collect()
    for d in differences:
        say(f"{d['table']}.{d['column']}: {d['difference']}")
    if differences or check and missing:
        return DIFFERENCES
    say("in sync" + (" (dry run)" if dry_run and missing else ""))
    return IN_SYNC


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="stowage.sync", description=__doc__)
    parser.add_argument("source")
    parser.add_argument("target")
    mode = parser.add_mutually_exclusive_group()
    mode.add_argument("--dry-run", action="store_true")
    mode.add_argument("--check", action="store_true")
    parser.add_argument("--table", nargs=3, action="append", default=[], metavar=("NAME", "SOURCE_TABLE", "TARGET_TABLE"))
    given = parser.parse_args(arguments)
    try:
        spark = SparkSession.builder.appName("stowage-sync").getOrCreate()
        source, target = Registry(spark, given.source), Registry(spark, given.target)
        tables = {name: (PackedTable(spark, a, source), PackedTable(spark, b, target)) for name, a, b in given.table}
        return sync(source, target, given.dry_run, given.check, tables=tables)
    except Exception as error:
        print(f"stowage.sync: {error}", file=sys.stderr)
        return FAILURE


if __name__ == "__main__":
    sys.exit(main())
