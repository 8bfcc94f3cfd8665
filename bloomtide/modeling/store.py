"""A folder of fitted models that a serving process can trust.

Each saving is a version of its own: the models, and a manifest with the features in
order, the number of classes, the training range and a checksum of what was fitted. The
version counts once it is committed, after all of it is written, so a crash in between
leaves the models before. Loading refuses models that are not what the manifest says.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from bloomtide.fixed_values import DATE
from bloomtide.modeling.estimators import Model, features_of
from bloomtide.modeling.tree_model import TreeModel, from_table
from bloomtide.sources.versions import Versions


class ManifestError(ValueError):
    """The stored models are not those of the manifest."""


def training_range(train: DataFrame, *, date: str = DATE) -> dict[str, str | int | None]:
    """First and last date and number of the rows that a model was fitted on."""
    row = train.agg(F.min(date).alias("a"), F.max(date).alias("b"), F.count("*").alias("n")).first()
    return {"first_date": row["a"] and str(row["a"]), "last_date": row["b"] and str(row["b"]), "rows": row["n"]}


def checksum(model: Model) -> str:
    """Of the features and all fitted numbers, whatever the order of a node table."""
    digest = hashlib.sha256("\n".join(features_of(model)).encode())
    if isinstance(model, TreeModel):
        nodes = model.nodes.sort_by([("tree", "ascending"), ("node", "ascending")]).to_pylist()
        digest.update(repr([model.kind, model.weights, model.rate, model.penalty]).encode())
        for r in nodes:
            digest.update(repr((r["tree"], r["node"], r["feature"], r["threshold"], r["sums"])).encode())
    else:
        fitted = model.stages[-1]
        digest.update(repr(fitted.coefficientMatrix.toArray().tolist()).encode())
        digest.update(repr(fitted.interceptVector.toArray().tolist()).encode())
        scaler = model.stages[1]
        digest.update(repr([scaler.mean.toArray().tolist(), scaler.std.toArray().tolist()]).encode())
    return digest.hexdigest()


def described(model: Model) -> dict:
    out = {"features": features_of(model), "checksum": checksum(model)}
    if isinstance(model, TreeModel):
        return out | {"family": model.kind, "classes": model.n_classes, "weights": list(model.weights), "rate": model.rate, "penalty": model.penalty}
    return out | {"family": "logistic", "classes": model.stages[-1].numClasses}


def save_models(models: Mapping[str, Model], path: str, trained_on: Mapping[str, Mapping] | None = None) -> str:
    """A new version with all ``models`` by name; its folder.

    ``trained_on`` has the ``training_range`` of each name. Versions before the last but
    one are dropped.
    """
    spark = SparkSession.active()
    versions = Versions(spark, path)
    folder = versions.new()
    manifest = {}
    for name, model in models.items():
        manifest[name] = described(model) | {"trained_on": dict((trained_on or {}).get(name, {}))}
        if isinstance(model, TreeModel):
            model.table(spark).write.parquet(f"{folder}/{name}")
        else:
            model.write().save(f"{folder}/{name}")
    versions.write_text(f"{folder}/manifest.json", json.dumps(manifest, sort_keys=True))
    versions.commit(folder)
    return folder


def read_manifest(path: str) -> tuple[str, dict]:
    """The folder of the current version and its manifest."""
    versions = Versions(SparkSession.active(), path)
    folder = versions.current()
    if folder is None:
        raise ManifestError(f"no models below {path}")
    return folder, json.loads(versions.read_text(f"{folder}/manifest.json"))


def load_models(names: Sequence[str], path: str, *, features: Sequence[str] | None = None) -> dict[str, Model]:
    """Models of the current version; with ``features`` they must have been fitted on these, in this order."""
    spark = SparkSession.active()
    folder, manifest = read_manifest(path)
    out = {}
    for name in names:
        if name not in manifest:
            raise ManifestError(f"no model {name!r} in {folder}")
        entry = manifest[name]
        if features is not None and list(features) != entry["features"]:
            raise ManifestError(f"{name!r} was fitted on other features")
        if entry["family"] == "logistic":
            model = PipelineModel.load(f"{folder}/{name}")
        else:
            nodes = spark.read.parquet(f"{folder}/{name}").toArrow()
            model = from_table(nodes, entry["family"], entry["features"], entry["classes"], weights=tuple(entry["weights"]),
                               rate=entry["rate"], penalty=entry["penalty"])
        if checksum(model) != entry["checksum"] or features_of(model) != entry["features"]:
            raise ManifestError(f"{name!r} is not the model of the manifest")
        out[name] = model
    return out
