"""Trained models as values: their card, and a zip file that holds weights and card."""

from __future__ import annotations

import json
import os
import tempfile
import zipfile
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

CARD = "model_card.json"
FORMATS = ("histospark", "cellpose", "both")


def _text(v: object) -> str:
    if isinstance(v, datetime):
        return v.strftime("%Y-%m-%d %H:%M:%S")
    if isinstance(v, (list, tuple)):
        return ", ".join(map(_text, v))
    if isinstance(v, bool):
        return str(v).upper()
    return format(v, ".15g") if isinstance(v, float) else str(v)


@dataclass
class TrainedModel:
    model_path: str
    backend: str = "cellpose"
    base_model: str = "unknown"
    training_metrics: dict = field(default_factory=dict)
    model_card: dict = field(default_factory=dict)
    created: datetime = field(default_factory=lambda: datetime.now(timezone.utc))

    def __post_init__(self) -> None:
        if self.backend not in ("cellpose", "stardist"):
            raise ValueError(f"unknown backend {self.backend}")

    def card_rows(self) -> list[tuple[str, str]]:
        """Fields of the card: four of the model, its metrics (several values joined by commas), and whatever else it has."""
        # fixed values: labels and order of the card
        rows = [("Backend", self.backend), ("Base Model", self.base_model), ("Model Path", self.model_path), ("Created", _text(self.created))]
        rows += [(f"Metric: {k}", _text(v)) for k, v in self.training_metrics.items()]
        return rows + [(k, _text(v)) for k, v in self.model_card.items()]

    def __str__(self) -> str:
        more = [(label, self.training_metrics.get(k)) for label, k in (("Epochs", "n_epochs"), ("Final loss", "final_loss"))]
        core = [("Backend", self.backend), ("Base model", self.base_model), ("Model path", self.model_path)]
        core += [(label, _text(round(v, 4) if isinstance(v, float) else v)) for label, v in more if v is not None]
        return "\n".join(["trained model", *(f"{k}: {v}" for k, v in [*core, ("Created", _text(self.created))])])

    def summary(self) -> str:
        """All that is known of the model, a line each."""
        lines = [f"Backend: {self.backend}", f"Base model: {self.base_model}", f"Model path: {self.model_path}", "Training Metrics", *(f"{k}: {_text(v)}" for k, v in self.training_metrics.items())]
        return "\n".join([*lines, *(["Model Card", *(f"{k}: {_text(v)}" for k, v in self.model_card.items())] if self.model_card else [])])

    def card(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.card_rows(), "field string, value string")

    def losses(self, spark: SparkSession) -> DataFrame:
        """``epoch, loss`` of the training, if it was kept."""
        return spark.createDataFrame([(i + 1, float(x)) for i, x in enumerate(self.training_metrics.get("loss", []))], "epoch int, loss double")


def package(model: TrainedModel, output: str, name: str | None = None, description: str | None = None, kind: str = "histospark", training_data: str | None = None) -> str:
    """A zip of the model's weights and card, and of the folder ``training_data`` where it is given; returns its path."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    os.makedirs(os.path.dirname(os.path.abspath(output)), exist_ok=True)
    moment = lambda t: t.strftime("%Y-%m-%dT%H:%M:%S")
    # fixed values: the keys of the card
    card = {
        "name": name or f"{model.backend}_{model.base_model}",
        "description": description or "Trained segmentation model",
        "backend": model.backend,
        "base_model": model.base_model,
        "training_metrics": model.training_metrics,
        "model_card": model.model_card,
        "created": moment(model.created),
        "packaged": moment(datetime.now(timezone.utc)),
        "engine_version": "1",
        "format": kind,
    }
    with zipfile.ZipFile(output, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(CARD, json.dumps(card, indent=2, default=str))
        if os.path.isdir(model.model_path):
            for folder, _, files in os.walk(model.model_path):
                for f in files:
                    z.write(os.path.join(folder, f), os.path.join("weights", os.path.relpath(os.path.join(folder, f), model.model_path)))
        elif os.path.exists(model.model_path):
            z.write(model.model_path, os.path.join("weights", os.path.basename(model.model_path)))
        for folder, _, files in os.walk(training_data) if training_data else ():
            for f in files:
                z.write(os.path.join(folder, f), os.path.join("training", os.path.relpath(os.path.join(folder, f), training_data)))
    return output


def load(path: str, into: str | None = None) -> TrainedModel:
    """The model of a package, its weights unpacked; a package without a card is an error."""
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    into = into or tempfile.mkdtemp(prefix="histospark-model-")
    with zipfile.ZipFile(path) as z:
        cards = [n for n in z.namelist() if os.path.basename(n) == CARD]
        if not cards:
            raise ValueError(f"{path} has no {CARD}")
        z.extractall(into)
    with open(os.path.join(into, cards[0])) as f:
        card = json.load(f)
    weights = sorted(folder for folder, _, _ in os.walk(into) if "weights" in os.path.relpath(folder, into))
    created = datetime.fromisoformat(card["created"]) if card.get("created") else datetime.now(timezone.utc)
    return TrainedModel(weights[0] if weights else into, card.get("backend") or "cellpose", card.get("base_model") or "unknown", card.get("training_metrics") or {}, card.get("model_card") or {}, created)
