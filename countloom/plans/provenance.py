"""Fingerprints, run manifests and the registry of phases: what was run on what, and what has to run again."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countloom.sources.files import hash_files


def fingerprint(inputs: Mapping[str, str], parameters: Mapping[str, object]) -> str:
    """SHA-256 of the inputs' hashes and the parameters, whatever their order."""
    return hashlib.sha256(json.dumps({"inputs": dict(inputs), "parameters": dict(parameters)}, sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()


def table_fingerprint(df: DataFrame) -> str:
    """An order-free fingerprint of a table: row count and sums of its rows' hashes; one pass, one row to the driver."""
    h = F.xxhash64(*[F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})])
    n, low, high = df.agg(F.count("*"), F.sum(F.pmod(h, F.lit(1 << 31))), F.sum(F.shiftrightunsigned(h, 33))).first()
    return fingerprint({}, {"rows": n, "low": low, "high": high, "columns": df.columns})


@dataclass(frozen=True)
class Phase:
    """A named step with the tables it reads and the one that it makes."""

    name: str
    reads: tuple[str, ...]
    run: Callable[[SparkSession, Mapping[str, DataFrame]], DataFrame]


class Registry:
    """Phases in order of what they need. A phase is skipped if its output for the same inputs is there."""

    def __init__(self, phases: Sequence[Phase]):
        self.phases = {p.name: p for p in phases}
        if len(self.phases) != len(phases):
            raise ValueError("two phases have one name")

    def order(self, wanted: Sequence[str] | None = None) -> list[str]:
        """Names so that each comes after what it reads; a cycle is an error."""
        done: list[str] = []
        path: list[str] = []

        def visit(name: str) -> None:
            if name in done or name not in self.phases:
                return
            if name in path:
                raise ValueError(f"cycle: {' > '.join([*path, name])}")
            path.append(name)
            for r in self.phases[name].reads:
                visit(r)
            done.append(path.pop())

        for name in wanted or self.phases:
            if name not in self.phases:
                raise ValueError(f"no phase {name}")
            visit(name)
        return done

    def missing_sources(self, sources: Sequence[str]) -> list[tuple[str, str]]:
        """(phase, table) for each table that is neither a source nor made by a phase."""
        return [(p.name, r) for p in self.phases.values() for r in p.reads if r not in self.phases and r not in sources]

    def replay(self, spark: SparkSession, sources: Mapping[str, DataFrame], folder: str, wanted: Sequence[str] | None = None, dry: bool = False) -> list[tuple[str, str, str]]:
        """Runs what is not there yet: (phase, fingerprint, REUSED, RAN or WOULD_RUN). The fingerprint is part of the path."""
        gaps = self.missing_sources(list(sources))
        if gaps:
            raise ValueError(f"tables that nothing provides: {gaps}")
        tables, marks = dict(sources), {k: table_fingerprint(v) for k, v in sources.items()}
        out = []
        for name in self.order(wanted):
            phase = self.phases[name]
            mark = fingerprint({r: marks[r] for r in phase.reads}, {"phase": name})
            path = f"{folder}/{name}/{mark[:16]}"
            there = _exists(spark, f"{path}/_SUCCESS")
            if not there and not dry:
                phase.run(spark, {r: tables[r] for r in phase.reads}).write.mode("overwrite").parquet(path)
            if there or not dry:
                tables[name] = spark.read.parquet(path)
            marks[name] = mark
            out.append((name, mark, "REUSED" if there else "WOULD_RUN" if dry else "RAN"))
        return out


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def seal(spark: SparkSession, folder: str) -> DataFrame:
    """(name, bytes, sha256) of the data files of a persisted output."""
    return hash_files(spark, folder).where(F.element_at(F.split("path", "/"), -1).rlike("^part-")).select(F.element_at(F.split("path", "/"), -1).alias("name"), "bytes", "sha256")


def verify(spark: SparkSession, folder: str, sealed: DataFrame) -> DataFrame:
    """(name, status) of each file that is not as it was sealed."""
    now = seal(spark, folder).select("name", F.col("sha256").alias("now"))
    status = F.when(F.col("now").isNull(), "MISSING").when(F.col("sha256").isNull(), "ADDED").otherwise("CHANGED")
    return sealed.join(now, "name", "full_outer").where(~F.col("sha256").eqNullSafe(F.col("now"))).select("name", status.alias("status"))
