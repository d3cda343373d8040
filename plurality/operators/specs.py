"""Pipeline descriptions as data: content-addressed, edited step by step, scored together."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plurality.functions import keys
from plurality.operators.calibrate import make_calibrator


@dataclass(frozen=True)
class Spec:
    """A model, a system and a list of calibrators; ``path`` records the edits and is not part of the hash."""

    model: str
    predictor: str
    calibrators: tuple[tuple[str, tuple[tuple[str, object], ...]], ...] = ()
    path: tuple[str, ...] = ()

    def with_calibrator(self, name: str, **settings) -> "Spec":
        step = (name, tuple(sorted(settings.items())))
        return replace(self, calibrators=(*self.calibrators, step))

    def texts(self) -> list[str]:
        return [f"{n}:" + ",".join(f"{k}={v}" for k, v in settings) for n, settings in self.calibrators]


# Edits a search may apply to a description, by name (names are fixed values).
EDITS: dict[str, Callable[..., Spec]] = {
    "recalib.global_temp": lambda spec, **kw: spec.with_calibrator("temp", **kw),
    "recalib.entropy_temp": lambda spec, **kw: spec.with_calibrator("entropy_temp", **kw),
    "recalib.dirichlet": lambda spec, **kw: spec.with_calibrator("dirichlet", **kw),
    "model.swap": lambda spec, model: replace(spec, model=model),
    "predictor.swap": lambda spec, predictor: replace(spec, predictor=predictor),
}


def apply_edit(spec: Spec, name: str, **settings) -> Spec:
    if name not in EDITS:
        raise KeyError(f"unknown edit {name!r}; have {sorted(EDITS)}")
    edited = EDITS[name](spec, **settings)
    return replace(edited, path=(*spec.path, name))


def spec_table(spark: SparkSession, specs: Sequence[Spec]) -> DataFrame:
    rows = [(s.model, s.predictor, s.texts()) for s in specs]
    table = spark.createDataFrame(rows, "model string, predictor string, calibrators array<string>")
    return table.withColumn("config_hash", keys.config_hash(F.col("model"), F.col("predictor"), F.col("calibrators")))


def _hash(spec: Spec):
    calibrators = F.array(*[F.lit(t) for t in spec.texts()]).cast("array<string>")
    return keys.config_hash(F.lit(spec.model), F.lit(spec.predictor), calibrators)


def run_specs(rows: DataFrame, specs: Sequence[Spec], fit_rows: DataFrame | None = None) -> DataFrame:
    """Labelled predictions of every description, tagged by config hash.

    ``rows`` are labelled predictions of all systems (see ``calibrate.labelled``); with
    ``fit_rows`` the calibrators of a description are fitted there first, in order.
    """
    out = None
    for spec in specs:
        chain = make_calibrator("chain", stages=[{"name": n, "kwargs": dict(kw)} for n, kw in spec.calibrators])
        if fit_rows is not None and spec.calibrators:
            chain.fit(fit_rows.filter(F.col("system") == spec.predictor))
        part = chain.transform(rows.filter(F.col("system") == spec.predictor)).withColumn("config_hash", _hash(spec))
        out = part if out is None else out.unionByName(part)
    return out


# -- systems by name ---------------------------------------------------------------

SYSTEMS: dict[str, Callable[..., DataFrame]] = {}


def register_system(name: str, predict: Callable[..., DataFrame]) -> None:
    """Register ``predict(cells, **inputs) -> (record_id, system, pred)`` under a name."""
    SYSTEMS[name] = predict


def predict(name: str, cells: DataFrame, **inputs) -> DataFrame:
    if name not in SYSTEMS:
        raise KeyError(f"unknown system {name!r}; have {sorted(SYSTEMS)}")
    return SYSTEMS[name](cells, **inputs).withColumn("system", F.lit(name))


def _register_defaults() -> None:
    from plurality.functions import dist
    from plurality.operators import draws, segments

    register_system(
        "uniform",
        lambda cells: cells.select("record_id", dist.as_map(F.col("options"), dist.uniform(F.col("options"))).alias("pred")),
    )
    register_system("stated", lambda cells, completions: draws.parse_predictions(completions, cells).select("record_id", "pred"))
    register_system("votes", lambda cells, votes, alpha=0.5: draws.tally_votes(votes, cells, alpha).select("record_id", "pred"))
    register_system(
        "average",
        lambda cells, responses, weight=None: draws.average_draws(draws.parse_draws(responses, cells), weight).select("record_id", "pred"),
    )
    register_system("ensemble", lambda cells, preds, weights: draws.blend(preds, cells, weights).select("record_id", "pred"))
    register_system(
        "router",
        lambda cells, kinds, preds, routes, default: draws.route(kinds, preds, routes, default).select("record_id", "pred"),
    )
    register_system(
        "post_strat", lambda cells, preds, over=None: segments.post_stratify(cells, preds, over).select("record_id", "pred")
    )


_register_defaults()
