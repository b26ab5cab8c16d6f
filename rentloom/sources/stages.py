"""Stage tables: results kept in files so that a later run can start from them."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping, Sequence
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame, SparkSession

from rentloom.operators.relational import check_keys, check_references
from rentloom.sources.snapshots import Snapshot, current, new_data, publish

log = logging.getLogger(__name__)


def write_stage(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.csv(path, header=True, escape='"')
    else:
        writer.format(fmt).save(path)
    return path


def stage(spark: SparkSession, path: str, build: Callable[[], DataFrame], refresh: bool = False, key: str | None = None) -> DataFrame:
    """Read the stage if it is there, else build, write and publish it; ``refresh`` rebuilds.

    With a ``key``, see :func:`rentloom.sources.snapshots.input_key`, a stage
    that was built under another one is rebuilt. A rebuild is written beside the
    stage: until it is published, and if it fails, the old one is read, by the
    rebuild itself too.
    """
    found = current(spark, path)
    if refresh or found is None or key not in (None, found.label):
        data = new_data(path)
        build().write.parquet(data)
        found = publish(spark, path, {"stage": data}, key or "")
    return found.read(spark)


def spread(scan: DataFrame) -> DataFrame:
    """Give every core a share of a file scan that came in fewer partitions than there are cores.

    One unsplittable file would otherwise keep one core busy while the others
    wait. A scan of many splits is left as it is. Take it straight after the
    read (and after positional keys): it does not keep the row order.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def load_in_order(tables: Mapping[str, DataFrame], order: Sequence[str], root: str, **jdbc) -> list[str]:
    """Write parents before children and skip empty tables; returns the names written.

    With ``url`` the tables are appended over JDBC, else written as parquet stages.
    """
    written = []
    for name in order:
        if name not in tables:
            continue
        if tables[name].isEmpty():
            log.warning("table %s has no rows and is skipped", name)
            continue
        if "url" in jdbc:
            tables[name].write.mode("append").format("jdbc").options(dbtable=f'"{name}"', **jdbc).save()
        else:
            write_stage(tables[name], f"{root.rstrip('/')}/{name.replace(' ', '_')}")
        written.append(name)
    return written


Reference = tuple[str, Mapping[str, str], str]      # child, child column to parent column, parent


def load_order(tables: Sequence[str], references: Sequence[Reference]) -> list[str]:
    """``tables`` with every parent before its children, else as given; a cycle is an error that names it."""
    unknown = {t for child, _, parent in references for t in (child, parent)} - set(tables)
    if unknown:
        raise ValueError(f"references name tables that are not there: {', '.join(sorted(unknown))}")
    parents = {t: {p for c, _, p in references if c == t and p != t} for t in tables}
    try:
        sorter = TopologicalSorter(parents)
        sorter.prepare()
    except CycleError as error:
        raise ValueError(f"tables refer to each other in a circle: {' -> '.join(error.args[1])}") from None
    order: list[str] = []
    while sorter.is_active():
        ready = sorted(sorter.get_ready(), key=tables.index)
        order += ready
        sorter.done(*ready)
    return order


class LoadRefused(ValueError):
    """A load that breaks keys; ``faults`` has (table, rule, broken keys)."""

    def __init__(self, faults: list[tuple[str, str, int]]) -> None:
        super().__init__("; ".join(f"{table}: {rule}: {n}" for table, rule, n in faults))
        self.faults = faults


def load_model(spark: SparkSession, tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]], references: Sequence[Reference],
               root: str) -> Snapshot:
    """Load all tables as one unit: write them beside the published ones, check keys and references, publish together.

    Parents are written before their children. Checks read what was written. A
    missing or repeated key or a child without its parent raises
    :class:`LoadRefused` with the numbers, and nothing is published; a reference
    to the table itself is checked like others, a reference with a missing part
    is not.
    """
    data = new_data(root)
    order = load_order(list(tables), references)
    for name in order:
        tables[name].write.parquet(f"{data}/{name.replace(' ', '_')}")
    written = {name: spark.read.schema(tables[name].schema).parquet(f"{data}/{name.replace(' ', '_')}") for name in order}
    checks = [(name, f"key {', '.join(keys[name])}", check_keys(written[name], keys[name])) for name in order if name in keys]
    checks += [(child, f"{', '.join(columns)} -> {parent}", check_references(written[child], columns, written[parent]))
               for child, columns, parent in references]
    faults = [(name, rule, n) for name, rule, broken in checks if (n := broken.count())]
    if faults:
        raise LoadRefused(faults)
    return publish(spark, root, {name: f"{data}/{name.replace(' ', '_')}" for name in order}, " < ".join(order))
