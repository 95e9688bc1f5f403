"""Versioned store of runs: tables, parameters and models, visible once their run is committed.

Layout under the store's root (any Hadoop path)::

    data/<run_id>/<attempt>/<root>/<name>     one Parquet table (or saved model) an artefact
    manifest/                                 one small file a committed attempt

A writer works in a folder of its own attempt. ``commit`` writes the attempt's manifest rows as
one file of one task, the last thing that happens; readers start from the manifest, so a run that
broke off, or is still being written, does not exist for them. Committing a run id again adds a
version: readers take the last committed attempt of each run, and earlier ones stay readable.

Artefacts belong to the roots of the run catalogue (raw, processed, profiles, figures, models, reports),
and ``listing`` feeds ``artifacts.run_catalog``. Each table keeps a schema of its own.
"""

from __future__ import annotations

import importlib
import json
import posixpath
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marquee.operators.gram import LinearFit
from marquee.sources.artifacts import ROOTS

_MANIFEST = ("run_id string, attempt string, committed_at timestamp, seq int, root string, name string, format string, "
             "path string, rows long, columns string")
_LINEAR = "feature string, position int, weight double"


@dataclass
class ActiveRun:
    """A committed run read back: tables lazily, parameters and models ready for use."""

    run_id: str
    attempt: str
    params: dict
    tables: dict[str, DataFrame]
    models: dict = field(default_factory=dict)


class RunWriter:
    def __init__(self, store: RunStore, run_id: str):
        self.store, self.run_id, self.attempt = store, run_id, uuid.uuid4().hex
        self.folder = posixpath.join(store.root, "data", run_id, self.attempt)
        self._entries: list[tuple] = []

    def _place(self, root: str, name: str) -> str:
        if root not in ROOTS:
            raise ValueError(f"no such root: {root}")
        if any(e[1:3] == (root, name) for e in self._entries):
            raise ValueError(f"{root}/{name} is in this run already")
        return posixpath.join(self.folder, root, name)

    def _enter(self, root: str, name: str, kind: str, path: str, rows: int | None, columns: str | None) -> None:
        self._entries.append((len(self._entries), root, name, kind, path, rows, columns))

    def put(self, root: str, name: str, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        """Write a table; returns it as read back."""
        path = self._place(root, name)
        w = df.write.option("compression", "zstd")
        (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
        back = df.sparkSession.read.schema(df.schema).parquet(path)
        self._enter(root, name, "parquet", path, back.count(), json.dumps([[f.name, f.dataType.simpleString()] for f in df.schema.fields]))
        return back

    def put_params(self, params: dict) -> None:
        rows = [(k, json.dumps(v, sort_keys=True)) for k, v in params.items()]
        self.put("models", "params", self.store.spark.createDataFrame(rows, "name string, value string"))

    def put_model(self, name: str, model) -> None:
        """A ``LinearFit`` as a table of weights; any other model by its own writer."""
        if isinstance(model, LinearFit):
            rows = [(f, i, w) for i, (f, w) in enumerate(zip(model.features, model.weights))] + [(None, -1, model.intercept)]
            self.put("models", f"{name}.linear", self.store.spark.createDataFrame(rows, _LINEAR).coalesce(1))
            return
        path = self._place("models", f"{name}.model")
        model.write().save(path)
        self._enter("models", f"{name}.model", f"{type(model).__module__}.{type(model).__name__}", path, None, None)

    def commit(self) -> None:
        """Make the run visible. Entries number in the tens: one row an artefact."""
        spark = self.store.spark
        rows = [(self.run_id, self.attempt, *e) for e in self._entries]
        df = spark.createDataFrame(rows, "run_id string, attempt string, seq int, root string, name string, format string, path string, "
                                         "rows long, columns string").withColumn("committed_at", F.current_timestamp())
        df.select(*[c.split()[0] for c in _MANIFEST.split(", ")]).coalesce(1).write.mode("append").parquet(self.store.manifest_path)


class RunStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.manifest_path = f"{self.root}/manifest"

    def begin(self, run_id: str) -> RunWriter:
        return RunWriter(self, run_id)

    def history(self) -> DataFrame:
        """Manifest rows of all committed attempts."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.manifest_path)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], _MANIFEST)      # nothing was committed yet
        return self.spark.read.schema(_MANIFEST).parquet(self.manifest_path)

    def manifest(self) -> DataFrame:
        """Manifest rows of each run's last committed attempt."""
        last = F.max(F.struct("committed_at", "attempt")).over(Window.partitionBy("run_id"))
        return (self.history().withColumn("_last", last).where(F.col("attempt") == F.col("_last.attempt")).drop("_last"))

    def listing(self) -> DataFrame:
        return self.manifest().select("root", "run_id", "name")

    def _entries(self, run_id: str, attempt: str | None):
        rows = self.manifest() if attempt is None else self.history().where(F.col("attempt") == attempt)
        found = rows.where(F.col("run_id") == run_id).orderBy("seq").collect()      # one row an artefact
        if not found:
            raise KeyError(f"no committed run {run_id}" + (f", attempt {attempt}" if attempt else ""))
        return found

    def _read(self, entry) -> DataFrame:
        df = self.spark.read.parquet(entry["path"])
        return df.select(*[F.col(f"`{c}`") for c, _ in json.loads(entry["columns"])])

    def table(self, run_id: str, root: str, name: str, attempt: str | None = None) -> DataFrame:
        for e in self._entries(run_id, attempt):
            if (e["root"], e["name"]) == (root, name):
                return self._read(e)
        raise KeyError(f"{run_id} has no {root}/{name}")

    def activate(self, run_id: str, attempt: str | None = None) -> ActiveRun:
        """Tables, parameters and models of a committed run."""
        entries = self._entries(run_id, attempt)
        run = ActiveRun(run_id, entries[0]["attempt"], {}, {})
        for e in entries:
            if e["format"] != "parquet":
                module, kind = e["format"].rsplit(".", 1)
                run.models[e["name"].removesuffix(".model")] = getattr(importlib.import_module(module), kind).load(e["path"])
            elif e["root"] == "models" and e["name"] == "params":
                run.params = {r["name"]: json.loads(r["value"]) for r in self._read(e).collect()}
            elif e["root"] == "models" and e["name"].endswith(".linear"):
                w = sorted(self._read(e).collect(), key=lambda r: r["position"])
                run.models[e["name"].removesuffix(".linear")] = LinearFit(
                    tuple(r["feature"] for r in w[1:]), tuple(r["weight"] for r in w[1:]), w[0]["weight"])
            else:
                run.tables[f"{e['root']}/{e['name']}"] = self._read(e)
        return run
