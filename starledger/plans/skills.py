"""The closed catalogue of skills: names, checked parameters, functions. No parameter carries code."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import hypothesis, learning, match, profile, series
from ..sources import catalogs


@dataclass(frozen=True)
class Parameter:
    kind: str  # string, number, integer, strings
    required: bool = True
    default: object = None
    low: float = -math.inf
    high: float = math.inf

    def check(self, name: str, value):
        if value is None:
            if self.required:
                raise ValueError(f"{name} is required")
            return self.default
        if self.kind == "string" and isinstance(value, str) and value.strip():
            return value.strip()
        if self.kind == "strings" and isinstance(value, list) and value and all(isinstance(x, str) and x.strip() for x in value):
            return list(dict.fromkeys(value))
        if self.kind in ("number", "integer") and isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value) and self.low <= value <= self.high and (self.kind == "number" or value == int(value)):
            return int(value) if self.kind == "integer" else float(value)
        raise ValueError(f"{name} is not a valid {self.kind}")


@dataclass(frozen=True)
class Skill:
    run: Callable[..., DataFrame] | None  # None: tables alone don't suffice
    parameters: dict[str, Parameter] = field(default_factory=dict)
    needs: str = ""  # an outside service or renderer, if it can't run on tables alone


_FIELDS, _KEY = Parameter("strings"), Parameter("string")


def _tests(rows: DataFrame, fields: list[str], alpha: float) -> DataFrame:
    return hypothesis.decided([hypothesis.anova(rows, fields)] + ([hypothesis.t_welch(rows, *fields), hypothesis.mann_whitney(rows, *fields)] if len(fields) == 2 else []), alpha)


def _choice(name: str, value: str, *known: str) -> str:
    if value not in known:
        raise ValueError(f"{name} must be one of {', '.join(known)}")
    return value


def _clusters(rows: DataFrame, key: str, fields: list[str], algorithm: str, k: int, eps: float, min_samples: int) -> DataFrame:
    if _choice("algorithm", algorithm, "kmeans", "dbscan") == "kmeans":
        return learning.kmeans(rows, key, fields, k).select(key, "label")
    return learning.dbscan(learning.standardized(rows.select(key, *fields), fields), key, fields, eps, min_samples)


def _anomalies(rows: DataFrame, key: str, fields: list[str], algorithm: str, threshold: float, contamination: float) -> DataFrame:
    if _choice("algorithm", algorithm, "isolation_forest", "robust_zscore") == "robust_zscore":
        return learning.robust_anomalies(rows, key, fields, threshold).orderBy(F.desc("score"), key)
    return learning.isolation_forest(rows, key, fields, contamination).where("anomaly").select(key, "score").orderBy(F.desc("score"), key)


def _model(rows: DataFrame, key: str, fields: list[str], label: str, folds: int | None, task: str, model: str, test: float) -> DataFrame:
    """Held-out metrics beside a baseline, or a cross-validation where folds are given."""
    _choice("task", task, "classification", "regression"), _choice("model", model, "forest", "linear")
    if folds is None:
        return learning.holdout(rows, key, fields, label, task, model, test)
    if task == "regression":
        raise ValueError("folds are for classification")
    return learning.cross_validate(rows, key, fields, label, folds, model)


def _crossmatch(rows: DataFrame, other: DataFrame, most_rows: int, most_pairs: int) -> DataFrame:
    match.within_capacity(rows, other, (most_rows, most_pairs))
    return match.edges(rows, other)


SKILLS: dict[str, Skill] = {
    "data_profile": Skill(lambda rows: profile.data_profile(rows)),
    "statistical_analysis": Skill(lambda rows, fields, alpha: _tests(rows, fields, alpha), {"fields": _FIELDS, "alpha": Parameter("number", False, 0.05, 1e-12, 1 - 1e-12)}),
    "correlation_analysis": Skill(lambda rows, fields, method: profile.spearman(rows, fields) if method == "spearman" else profile.pearson(rows, fields), {"fields": _FIELDS, "method": Parameter("string", False, "pearson")}),
    "clustering_analysis": Skill(_clusters, {"key": _KEY, "fields": _FIELDS, "algorithm": Parameter("string", False, "kmeans"), "k": Parameter("integer", False, 3, 2, 20), "eps": Parameter("number", False, 0.5, 1e-12, 20), "min_samples": Parameter("integer", False, 5, 2, 100)}),
    "anomaly_detection": Skill(_anomalies, {"key": _KEY, "fields": _FIELDS, "algorithm": Parameter("string", False, "isolation_forest"), "threshold": Parameter("number", False, 3.5, 0), "contamination": Parameter("number", False, 0.05, 1e-12, 0.25)}),
    "chart_visualization": Skill(lambda rows, x, y: profile.chart(rows, x, y), {"x": _KEY, "y": _KEY}),
    "catalog_crossmatch": Skill(_crossmatch, {"most_rows": Parameter("integer", False, 500, 1), "most_pairs": Parameter("integer", False, 250_000, 1)}),
    "gaia_cone_search": Skill(lambda rows, ra, dec, radius, key: catalogs.cone(rows, ra, dec, radius, key), {"ra": Parameter("number", low=0, high=360), "dec": Parameter("number", low=-90, high=90), "radius": Parameter("number", low=0, high=5), "key": _KEY}),
    "vizier_tap": Skill(lambda rows, ra, dec, radius, key: catalogs.cone(rows, ra, dec, radius, key), {"ra": Parameter("number", low=0, high=360), "dec": Parameter("number", low=-90, high=90), "radius": Parameter("number", low=0, high=5), "key": _KEY}),
    "simbad_lookup": Skill(lambda rows, column, name: catalogs.find_object(rows, column, name), {"column": _KEY, "name": _KEY}),
    "spectrum_acquisition": Skill(lambda rows: catalogs.spectrum_rows(rows)),
    "light_curve_acquisition": Skill(lambda rows: catalogs.light_curve_rows(rows)),
    "spectrum_analysis": Skill(lambda rows, group, wave, flux, rest: series.spectrum(rows, group, wave, flux, rest), {"group": _KEY, "wave": _KEY, "flux": _KEY, "rest": Parameter("number", low=1e-9)}),
    "light_curve_analysis": Skill(lambda rows, group, time, value, sigma, period: series.light_curve(rows, [group], time, value, sigma, period), {"group": _KEY, "time": _KEY, "value": _KEY, "sigma": Parameter("number", False, 5.0, 2, 20), "period": Parameter("number", False, 1.0, 1e-9)}),
    "tabular_machine_learning": Skill(_model, {"key": _KEY, "fields": _FIELDS, "label": _KEY, "folds": Parameter("integer", False, None, 2, 10), "task": Parameter("string", False, "classification"), "model": Parameter("string", False, "forest"), "test": Parameter("number", False, 0.2, 0.01, 0.9)}),
    "time_series_classification": Skill(lambda rows, key, fields, label: learning.cross_validate(rows, key, fields, label, 3, "forest"), {"key": _KEY, "fields": _FIELDS, "label": _KEY}),
    "time_series_forecast": Skill(lambda rows, group, order, value, horizon: learning.forecast(rows, group, order, value, horizon=horizon), {"group": _KEY, "order": _KEY, "value": _KEY, "horizon": Parameter("integer", False, 3, 1, 100)}),
    "image_classification": Skill(lambda rows, key, label: learning.cross_validate(learning.as_columns(rows, "pixels", 3072), key, [f"f{i}" for i in range(3072)], label, 3, "forest"), {"key": _KEY, "label": _KEY}),
    "model_inference": Skill(lambda rows, model, key, fields: learning.infer(_load(model), rows, key, fields), {"model": _KEY, "key": _KEY, "fields": _FIELDS}),
    "fits_image_analysis": Skill(lambda rows, image: _segments(rows, image), {"image": _KEY}),
    "skyview_fits": Skill(None, needs="an image service"),
    "ephemeris": Skill(None, needs="an ephemeris file"),
    "celestial_events": Skill(lambda rows, group, order, value: series.extrema(rows, [group], order, value), {"group": _KEY, "order": _KEY, "value": _KEY}, needs="a sampled ephemeris as rows"),
    "wwt_scene": Skill(None, needs="a renderer"),
}


def _load(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def _segments(rows: DataFrame, image: str) -> DataFrame:
    from ..sources.images import segments

    return segments(rows, image)


def run(name: str, rows: DataFrame, parameters: dict | None = None, **tables: DataFrame) -> DataFrame:
    """A skill by name; unknown names and parameters, or values of a wrong kind, are errors before anything is planned."""
    if name not in SKILLS:
        raise ValueError(f"no skill is called {name}")
    skill, given = SKILLS[name], dict(parameters or {})
    if skill.run is None:
        raise ValueError(f"{name} needs {skill.needs}")
    unknown = set(given) - set(skill.parameters)
    if unknown:
        raise ValueError(f"{name} has no parameters {sorted(unknown)}")
    return skill.run(rows, *tables.values(), **{k: p.check(k, given.get(k)) for k, p in skill.parameters.items()})


def as_metrics(df: DataFrame, name: str) -> DataFrame:
    """(skill, metric, value) of a result's numbers, a row each."""
    numbers = profile.fields_of(df, "number")
    cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in numbers])
    return df.select(F.lit(name).alias("skill"), F.explode(cells).alias("m")).select("skill", "m.*").where("value is not null")
