"""A fluent way to put an analysis together."""

from __future__ import annotations

from . import config, engine

ROLES = ("causes", "effects", "tested_causes")


class AnalysisBuilder:
    """Each method sets what its name says and returns the builder; fit() (or run()) starts."""

    def __init__(self):
        self.made: dict = {}
        self.cfg: dict = {}

    def _set(self, **entries) -> AnalysisBuilder:
        self.cfg.update({k: v for k, v in entries.items() if v is not None})
        return self

    def backend(self, name=None, **params):
        return self._set(backend=name, model_config=(self.cfg.get("model_config") or {}) | params if params else None)

    def data(self, data):
        return self._set(data=data)

    def variables(self, causes=None, effects=None, tested_causes=None):
        listed = lambda x: None if x is None or len(x) == 0 else [x] if isinstance(x, str) else list(x)
        for k, v in zip(ROLES, map(listed, (causes, effects, tested_causes)), strict=True):
            self.cfg[k] = v
        return self

    def relations(self, relations):
        return self._set(relations=config.relations(relations))

    def lag(self, lag_config=None, lag_selector=None):
        lags = config.lag_config(lag_config)
        return self._set(lag_config=lags, lag_selector=config.selector(lag_selector, lags))

    def stationarity(self, transformer):
        return self._set(stationarity_transformer=transformer)

    def reuse_data(self, reuse: bool = True):
        return self._set(reuse_data=reuse)

    def scaling(self, x_scaler=None, y_scaler=None):
        return self._set(x_scaler=x_scaler, y_scaler=y_scaler)

    def backend_load(self, sample_fraction=None, max_samples=None):
        return self._set(backend_sample_fraction=sample_fraction, backend_max_samples=max_samples)

    def regularization(self, regularizer=None, regularizer_spec=None):
        return self._set(regularizer=regularizer, regularizer_spec=regularizer_spec)

    def callbacks(self, callbacks):
        return self._set(callbacks=callbacks)

    def hyperoptimization(self, state=True, conf=None):
        return self._set(hiperoptimalization_state=state, hiperoptimalization_conf=conf)

    def initializer(self, initializer):
        return self._set(initializer=initializer)

    def prepared_data(self, prepared):
        return self._set(prepared_data=prepared)

    def model(self, **model_config):
        return self._set(model_config=(self.cfg.get("model_config") or {}) | model_config)

    def from_config(self, raw, base: str = "."):
        self.cfg.update(config.normalised(raw, base))
        return self

    def from_file(self, path: str):
        import os

        return self.from_config(config.read(path), os.path.dirname(os.path.abspath(path)))

    def build(self) -> engine.MultiTaskCausality:
        return engine.MultiTaskCausality(self.cfg.get("backend"), self.cfg.get("stationarity_transformer"), bool(self.cfg.get("reuse_data")))

    def fit(self):
        args = {k: v for k, v in self.cfg.items() if k not in ("backend", "reuse_data")}
        return self.build().fit(**args)

    run = fit
