"""Deep-learning segmenters, which run in Python workers where they are installed.

A backend is a function from an array (rows, columns, channels) and its parameters to a mask,
or to several by compartment. Built-in ones import their library on the executor; others are
registered with ``register`` and need no library here."""

from __future__ import annotations

import importlib.util
import os
import platform
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histospark.sources.images import to_array

Backend = Callable[..., np.ndarray | dict[str, np.ndarray]]
_registered: dict[str, Backend] = {}
#: Module that each built-in backend needs.
NEEDS = {"cellpose": "cellpose", "stardist": "stardist", "mesmer": "deepcell"}
COMPARTMENTS = ("whole-cell", "nuclear", "both")


def register(name: str, backend: Backend) -> None:
    _registered[name] = backend


def backends() -> dict[str, bool]:
    """Which backends can run on this machine."""
    return {name: name in _registered or importlib.util.find_spec(module) is not None for name, module in NEEDS.items()} | {name: True for name in _registered}


def environment() -> dict[str, str]:
    """What a backend would run on."""
    gpu = False
    if importlib.util.find_spec("torch"):
        import torch

        gpu = torch.cuda.is_available()
    return {"python": platform.python_version(), "gpu": str(gpu).lower()}


def _cellpose(image: np.ndarray, model: str = "cyto3", channels: tuple[int, int] = (0, 0), diameter: float | None = None, flow_threshold: float = 0.4, cellprob_threshold: float = 0.0, custom_model_path: str | None = None, batch_size: int = 8, tile: bool = True) -> np.ndarray:
    from cellpose import models

    net = models.CellposeModel(pretrained_model=custom_model_path) if custom_model_path else models.Cellpose(model_type=model)
    return np.asarray(net.eval(image, channels=list(channels), diameter=diameter, flow_threshold=flow_threshold, cellprob_threshold=cellprob_threshold, batch_size=batch_size, tile=tile)[0])


def _stardist(image: np.ndarray, model: str = "2D_versatile_fluo", channel: int = 1, prob_thresh: float = 0.5, nms_thresh: float = 0.4, scale: float | None = None, n_tiles: int | None = None, custom_model_path: str | None = None) -> np.ndarray:
    from stardist.models import StarDist2D

    x = image[..., channel - 1]
    low, high = x.min(), x.max()
    x = (x - low) / (high - low) if high > low else x
    net = StarDist2D(None, name=os.path.basename(custom_model_path), basedir=os.path.dirname(custom_model_path)) if custom_model_path else StarDist2D.from_pretrained(model)
    return np.asarray(net.predict_instances(x, prob_thresh=prob_thresh, nms_thresh=nms_thresh, scale=scale, n_tiles=n_tiles)[0])


def _mesmer(image: np.ndarray, compartment: str = "whole-cell", image_mpp: float | None = None) -> dict[str, np.ndarray]:
    from deepcell.applications import Mesmer

    out = Mesmer().predict(image[None, ..., :2], compartment=compartment, image_mpp=image_mpp or 0.5)
    return {name: out[0, ..., k] for k, name in enumerate(("whole-cell", "nuclear") if compartment == "both" else (compartment,))}


_BUILT_IN = {"cellpose": _cellpose, "stardist": _stardist, "mesmer": _mesmer}


def probe(spark: SparkSession, tasks: int = 8) -> DataFrame:
    """``host, backend, available, python, gpu`` as the executors' Python workers see it, from ``tasks`` tasks."""

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield pd.DataFrame([{"host": platform.node(), "backend": name, "available": found, **environment()} for name, found in backends().items()])

    return spark.range(0, tasks, 1, tasks).mapInPandas(look, "host string, backend string, available boolean, python string, gpu string").distinct()


def segment(pixels: DataFrame, name: str, images: DataFrame | None = None, **parameters) -> DataFrame:
    """Labels of every image by a backend, with ``compartment`` (``cell`` for those without).

    ``mesmer`` takes the pixel width from ``image_mpp``, else from ``images`` (``image_id,
    resolution``), else it is 0.5 µm. An image is one group, so it must fit in a task; larger ones are to be cut into patches first."""
    if name not in _registered and name not in NEEDS:
        raise ValueError(f"unknown backend {name}")
    if name not in _registered and importlib.util.find_spec(NEEDS[name]) is None:
        raise RuntimeError(f"{name} needs the Python module {NEEDS[name]}, which isn't installed")
    if name == "mesmer" and parameters.get("compartment", "whole-cell") not in COMPARTMENTS:
        raise ValueError(f"compartment must be one of {', '.join(COMPARTMENTS)}")
    if (path := parameters.get("custom_model_path")) is not None and not os.path.exists(path):
        raise FileNotFoundError(path)
    run, least = _registered.get(name) or _BUILT_IN[name], 2 if name == "mesmer" else 1

    def of(f: pd.DataFrame) -> pd.DataFrame:
        image = to_array(f)
        if image.shape[2] < least:
            raise ValueError(f"{name} needs {least} channels")
        own = {"image_mpp": float(f["_mpp"].iloc[0])} if by_image and f["_mpp"].notna().iloc[0] else {}
        masks = run(image, **parameters, **own)
        parts = []
        for compartment, mask in (masks if isinstance(masks, dict) else {"cell": masks}).items():
            mask = np.asarray(mask).astype(int)
            r, c = np.nonzero(mask > 0)
            parts.append(pd.DataFrame({"image_id": f["image_id"].iloc[0], "n_rows": mask.shape[0], "n_cols": mask.shape[1], "row": r + 1, "col": c + 1, "label": mask[r, c], "compartment": compartment}))
        return pd.concat(parts)

    by_image = images is not None and name == "mesmer" and parameters.get("image_mpp") is None
    rows = pixels.select("image_id", "n_rows", "n_cols", "row", "col", "channel", "value")
    if by_image:
        width = F.col("resolution.x_um")
        rows = rows.join(images.select("image_id", F.when(width > 0, width).alias("_mpp")), "image_id", "left")
    return rows.groupBy("image_id").applyInPandas(of, "image_id bigint, n_rows int, n_cols int, row int, col int, label int, compartment string")


def train(pairs: list[tuple[np.ndarray, np.ndarray]], base_model: str = "cyto3", n_epochs: int = 100, learning_rate: float = 0.1, save_path: str | None = None, trainer: Callable[..., str] | None = None) -> str:
    """Path of a model trained on pairs of images and masks of equal size, by ``trainer`` or the library's."""
    if not pairs or any(np.shape(i)[:2] != np.shape(m)[:2] for i, m in pairs):
        raise ValueError("training needs pairs of an image and a mask of its size")
    if trainer is None:
        if importlib.util.find_spec("cellpose") is None:
            raise RuntimeError("training needs the Python module cellpose, which isn't installed")
        from cellpose import models, train as library

        net = models.CellposeModel(model_type=base_model)
        return str(library.train_seg(net.net, train_data=[i for i, _ in pairs], train_labels=[m for _, m in pairs], n_epochs=n_epochs, learning_rate=learning_rate, save_path=save_path)[0])
    return trainer(pairs, base_model=base_model, n_epochs=n_epochs, learning_rate=learning_rate, save_path=save_path)
