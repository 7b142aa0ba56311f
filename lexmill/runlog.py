"""A driver-side JSON record of a run."""

from __future__ import annotations

import json
import logging
import os
from datetime import UTC, datetime
from typing import Any


def logger(name: str, file: str | None = None, level: int = logging.INFO) -> logging.Logger:
    """Console and optional file output; asking again adds no second handler."""
    log = logging.getLogger(name)
    log.setLevel(level)
    wanted = [("console", lambda: logging.StreamHandler())] + ([(file, lambda: logging.FileHandler(file, encoding="utf-8"))] if file else [])
    for key, make in wanted:
        if key not in {h.get_name() for h in log.handlers}:
            if key != "console" and os.path.dirname(key):
                os.makedirs(os.path.dirname(key), exist_ok=True)
            handler = make()
            handler.set_name(key)
            handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
            log.addHandler(handler)
    return log


class RunLog:
    """Parameters, metrics and artifacts of one run; a JSON file is written at its end.

    With mode ``mlflow`` the same values also go to MLflow, where it is installed.
    """

    def __init__(self, experiment: str, mode: str = "json", output_dir: str = "outputs", uri: str = "mlruns"):
        self.experiment, self.output_dir, self.run = experiment, output_dir, None
        self.mlflow = None
        if mode == "mlflow":
            try:
                import mlflow

                mlflow.set_tracking_uri(uri)
                mlflow.set_experiment(experiment)
                self.mlflow = mlflow
            except ImportError:
                pass

    def start(self, name: str | None = None) -> None:
        now = datetime.now(UTC)
        self.run = {"run_name": name or f"{self.experiment}_{now:%Y%m%d_%H%M%S}", "start_time": now.isoformat(), "params": {}, "metrics": {}, "artifacts": []}
        if self.mlflow:
            self.mlflow.start_run(run_name=self.run["run_name"])

    def _open(self) -> dict[str, Any]:
        if self.run is None:
            raise RuntimeError("No active run. Call start() first.")
        return self.run

    def params(self, values: dict[str, Any]) -> None:
        self._open()["params"].update(values)
        if self.mlflow:
            self.mlflow.log_params(values)

    def metrics(self, values: dict[str, float], step: int | None = None) -> None:
        for name, value in values.items():
            name = name.replace("@", "_at_")
            self._open()["metrics"][name] = value if step is None else {**self._open()["metrics"].get(name, {}), str(step): value}
            if self.mlflow:
                self.mlflow.log_metric(name, value, step=step)

    def artifact(self, path: str) -> None:
        self._open()["artifacts"].append(str(path))
        if self.mlflow:
            self.mlflow.log_artifact(path)

    def end(self) -> str:
        run = self._open()
        run["end_time"] = datetime.now(UTC).isoformat()
        os.makedirs(self.output_dir, exist_ok=True)
        path = os.path.join(self.output_dir, f"{run['run_name']}.json")
        with open(path, "w", encoding="utf-8") as f:
            json.dump(run, f, ensure_ascii=False, indent=2)
        if self.mlflow:
            self.mlflow.end_run()
        return path
