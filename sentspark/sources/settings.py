"""Run settings: a nested dict, read from YAML or JSON on the driver."""

from __future__ import annotations

import json
from collections.abc import Mapping
from pathlib import Path
from typing import Any

# The form of a run name, the sections of a settings file and the
# defaults of each.
RUN_NAME = "{model}_{year}_max_length{max_length}_bs{batch_size}_lr{learning_rate}{digits}_loss{loss}"
SECTIONS = ("data", "encoder_model", "dim_red_model", "visualization", "reranking", "train")
DEFAULTS: dict[str, dict[str, Any]] = {
    "train": {
        "train_test_split": 0.8, "batch_size": 100, "seed": 42, "epochs": 10,
        "learning_rate": 2e-05, "eps": 1e-08, "early_stopping_patience": 2,
        "rounding_metrics": 4, "warmup_steps": 0, "step_per": "epoch",
        "loss": "cross_entropy", "focal_loss_gamma": 2.0,
    },
    "encoder_model": {
        "max_length": 128, "batch_size": 20, "r2l": False, "padding": "max_length",
        "truncation": True, "add_special_tokens": True, "dropout_ratio": 0.1, "mlp_dim": 256,
    },
}


def load_settings(source: str | Path | Mapping) -> dict[str, Any]:
    """Every known section is present; a section the file lacks is None. The two
    sections with defaults have theirs filled in."""
    raw = source if isinstance(source, Mapping) else _read(Path(source))
    settings = {name: raw.get(name) for name in SECTIONS}
    for name, defaults in DEFAULTS.items():
        if settings[name] is not None:
            settings[name] = {**defaults, **settings[name]}
    return settings


def _read(path: Path) -> Mapping:
    text = path.read_text()
    if path.suffix == ".json":
        return json.loads(text)
    try:
        import yaml
    except ImportError as missing:
        raise RuntimeError("reading YAML settings needs the yaml package; use JSON") from missing
    return yaml.safe_load(text)


def run_id(settings: Mapping) -> str:
    """Name of a run; ``functions.formatting.run_name`` gives it as a column."""
    encoder, train = settings["encoder_model"], settings["train"]
    return RUN_NAME.format(
        model=encoder["name"].replace("/", "-"),
        year="2024" if "2024" in settings["data"]["train_en"] else "",
        digits="_r2l" if encoder["r2l"] else "",
        max_length=encoder["max_length"],
        **{key: train[key] for key in ("batch_size", "learning_rate", "loss")},
    )
