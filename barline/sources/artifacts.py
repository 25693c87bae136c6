"""Model artifacts addressed by the hash of their identity, JSON sidecars, and result checkpoints.

Paths go through Hadoop's file system, so that any store that Spark can write serves.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from barline.operators.models import identity_hash


@dataclass(frozen=True)
class Metadata:
    strategy_id: str
    features: tuple[str, ...]
    hyperparameters: dict
    universe: tuple[str, ...]
    start: str
    end: str
    frequency: str
    seed: int
    model_hash: str

    def expected_hash(self) -> str:
        return identity_hash(self.features, self.hyperparameters, self.universe, date.fromisoformat(self.start), date.fromisoformat(self.end), self.frequency, self.seed)

    def __post_init__(self) -> None:
        if date.fromisoformat(self.end) <= date.fromisoformat(self.start):
            raise ValueError("end must be after start")
        if self.expected_hash() != self.model_hash:
            raise ValueError("model_hash does not match the identity")


class ArtifactStore:
    """``root/strategy_id/model_hash`` with the model and its metadata; never overwritten."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def _write(self, path: str, body: dict) -> None:
        out = self._fs.create(self._path(path), False)
        out.write(bytearray(json.dumps(body, sort_keys=True, default=str).encode()))
        out.close()

    def _read(self, path: str) -> dict:
        lines = self.spark.read.text(path, wholetext=True).collect()
        return json.loads(lines[0][0])

    def refuse(self, strategy_id: str, model_hash: str) -> str:
        """The folder of a model, which must not exist yet."""
        target = f"{self.root}/{strategy_id}/{model_hash}"
        if self._exists(target):
            raise FileExistsError(target)
        return target

    def save(self, model, meta: Metadata) -> str:
        """Write beside the target, then rename; leftovers of a failed write are removed."""
        target = self.refuse(meta.strategy_id, meta.model_hash)
        draft = f"{self.root}/.draft-{uuid.uuid4().hex}"
        try:
            model.write().save(f"{draft}/model")
            self._write(f"{draft}/metadata.json", asdict(meta))
            self._fs.mkdirs(self._path(f"{self.root}/{meta.strategy_id}"))
            if not self._fs.rename(self._path(draft), self._path(target)):
                raise OSError(f"cannot rename to {target}")
        finally:
            if self._exists(draft):
                self._fs.delete(self._path(draft), True)
        return target

    def find(self, model_hash: str) -> str:
        """The only folder of that hash."""
        found = self._fs.globStatus(self._path(f"{self.root}/*/{model_hash}")) or []
        if len(found) != 1:
            raise LookupError(f"{len(found)} artifacts for {model_hash}")
        return found[0].getPath().toString()

    def metadata(self, model_hash: str, features: tuple[str, ...] | None = None) -> Metadata:
        body = self._read(f"{self.find(model_hash)}/metadata.json")
        meta = Metadata(**body | {"features": tuple(body["features"]), "universe": tuple(body["universe"])})
        if features is not None and tuple(features) != meta.features:
            raise ValueError("feature list differs")
        return meta

    def load(self, loader, model_hash: str):
        """The model, read by its class' ``load``, after the metadata checks."""
        self.metadata(model_hash)
        return loader.load(f"{self.find(model_hash)}/model")

    def write_sidecar(self, model_hash: str, body: dict) -> None:
        path = f"{self.find(model_hash)}/sidecar.json"
        if self._exists(path):
            raise FileExistsError(path)
        self._write(path, body)

    def read_sidecar(self, model_hash: str) -> dict:
        return self._read(f"{self.find(model_hash)}/sidecar.json")


def append_results(results: DataFrame, path: str) -> None:
    """Add finished permutations to the checkpoint table."""
    results.write.mode("append").parquet(path)


def pending(ids: DataFrame, done: DataFrame, key: str = "perm_id") -> DataFrame:
    """Ids that the checkpoint table does not hold."""
    return ids.join(done, key, "left_anti")
