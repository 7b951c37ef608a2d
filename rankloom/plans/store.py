"""Versioned store of data sets and fitted models.

Tables are written below fresh folders and only count once a manifest names them. A
manifest is one small JSON file, ``manifests/000012.json``, written aside and renamed,
so that readers see the old or the new state and an interrupted write leaves the old.
Publishing a data set starts a manifest without models, weights and evaluation, which
belong to the data they were made from; saving models for a data set that is no longer
current is refused.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from rankloom.session import read_table
from rankloom.sources.files import _fs


class StaleDataset(RuntimeError):
    """The models were fitted on a data set that has been replaced."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # ── manifests ──
    def versions(self) -> list[int]:
        fs, folder = _fs(self.spark, f"{self.root}/manifests")
        if not fs.exists(folder):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(folder))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def current(self, version: int | None = None) -> dict | None:
        """The newest manifest, or that of ``version``; None in an empty store."""
        versions = self.versions()
        if not versions:
            return None
        at = f"{self.root}/manifests/{version or versions[-1]:06d}.json"
        return json.loads("\n".join(r[0] for r in self.spark.read.text(at, wholetext=True).collect()))

    def _commit(self, manifest: dict) -> int:
        version = (self.versions() or [0])[-1] + 1
        fs, aside = _fs(self.spark, f"{self.root}/manifests/.{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(manifest | {"version": version}), "utf-8"))
        out.close()
        _, final = _fs(self.spark, f"{self.root}/manifests/{version:06d}.json")
        if fs.exists(final) or not fs.rename(aside, final):
            fs.delete(aside, False)
            raise RuntimeError(f"version {version} was committed by another writer")
        return version

    # ── tables ──
    def folder(self, kind: str) -> str:
        return f"{kind}/{uuid.uuid4().hex}"

    def write(self, folder: str, tables: dict[str, DataFrame]) -> None:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/{folder}/{name}")

    def discard(self, folder: str) -> None:
        fs, path = _fs(self.spark, f"{self.root}/{folder}")
        fs.delete(path, True)

    def _read(self, folder: str, read=None) -> dict[str, DataFrame]:
        read = read or self.spark.read.parquet
        fs, path = _fs(self.spark, f"{self.root}/{folder}")
        names = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]
        return {n: read(f"{self.root}/{folder}/{n}") for n in names}

    # ── data sets, models, weights ──
    def publish(self, folder: str) -> int:
        """Make the data set written to ``folder`` the current one; models and evaluation of the old one go."""
        return self._commit({"dataset": folder, "models": None, "weights": None, "evaluation": None})

    def dataset(self) -> dict[str, DataFrame]:
        manifest = self.current()
        return self._read(manifest["dataset"]) if manifest else {}

    def _extend(self, dataset: str, **entries) -> int:
        manifest = self.current()
        if manifest is None or manifest["dataset"] != dataset:
            raise StaleDataset(f"{dataset} is not the current data set")
        return self._commit(manifest | entries)

    def save_models(self, dataset: str, tables: dict[str, DataFrame]) -> int:
        """Models fitted on ``dataset``; weights and evaluation of former models go."""
        folder = self.folder("models")
        self.write(folder, tables)
        return self._extend(dataset, models=folder, weights=None, evaluation=None)

    def models(self) -> dict[str, DataFrame]:
        manifest = self.current()
        return self._read(manifest["models"], lambda path: read_table(self.spark, path)) if manifest and manifest["models"] else {}

    def save_weights(self, dataset: str, weights, alpha: float) -> int:
        return self._extend(dataset, weights={"weights": [float(w) for w in weights], "ctx_alpha": float(alpha)}, evaluation=None)

    def save_evaluation(self, dataset: str, table: DataFrame) -> int:
        folder = self.folder("evaluation")
        self.write(folder, {"metrics": table})
        return self._extend(dataset, evaluation=folder)

    def evaluation(self) -> DataFrame | None:
        manifest = self.current()
        return self._read(manifest["evaluation"])["metrics"] if manifest and manifest["evaluation"] else None
