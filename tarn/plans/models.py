"""Models: named DataFrame functions with declared inputs and a materialisation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass, field
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions.scalars import EPOCH_MARK, beyond
from tarn.lake.store import LakeStore


@dataclass(frozen=True)
class Model:
    """``build`` gets one DataFrame per input, in order, and returns the table.

    An incremental model reads only the rows of its *first* input whose cursor is
    beyond the target's; its other inputs are dimensions and come whole. A dimension that
    has a new version since the target was built makes the model read its first input
    whole, so an enrichment that comes after its raw rows is not missed. ``ready`` is asked
    before a run; while it says no (an enrichment that is not finished) the model waits.
    """

    name: str
    inputs: Sequence[str]
    build: Callable[..., DataFrame]
    layer: str = "clean"
    materialized: str = "table"
    unique_key: Sequence[str] = field(default_factory=tuple)
    cursor: str = "updated_at"
    input_cursor: str | None = None
    ready: Callable[[LakeStore], bool] | None = None

    @property
    def target(self) -> tuple[str, str]:
        return self.layer, self.name

    @property
    def address(self) -> str:
        return f"{self.layer}/{self.name}"


class ModelRegistry:
    def __init__(self) -> None:
        self.models: dict[str, Model] = {}

    def model(self, name: str, inputs: Sequence[str], **options):
        """Decorator that registers a build function."""

        def register(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            self.add(Model(name, inputs, build, **options))
            return build

        return register

    def add(self, model: Model) -> None:
        if model.materialized not in ("table", "incremental"):
            raise ValueError(f"unknown materialization: {model.materialized}")
        if model.materialized == "incremental" and not model.unique_key:
            raise ValueError(f"incremental model {model.name} needs a unique_key")
        if model.name in self.models:
            raise ValueError(f"model {model.name} is declared twice")
        self.models[model.name] = model

    def order(self, names: Sequence[str] | None = None) -> list[str]:
        """Models in dependency order."""
        return [n for n in TopologicalSorter(self._graph()).static_order() if names is None or n in names]

    def _graph(self) -> dict[str, set[str]]:
        by_address = {m.address: m.name for m in self.models.values()}
        return {
            m.name: {by_address[i] for i in m.inputs if i in by_address}
            for m in self.models.values()
        }

    def models_for(self, connector: str) -> list[str]:
        """Models that read the connector's raw tables, directly or through other models."""
        hit: set[str] = set()
        graph = self._graph()
        for name in self.order():
            direct = any(i.startswith(f"raw/{connector}__") for i in self.models[name].inputs)
            if direct or graph[name] & hit:
                hit.add(name)
        return [n for n in self.order() if n in hit]

    def build(
        self,
        lake: LakeStore,
        select: Sequence[str] | None = None,
        full_refresh: bool = False,
        workers: int = 4,
    ) -> dict[str, str]:
        """Run the models in dependency order; independent ones overlap as Spark jobs."""
        chosen = set(select if select is not None else self.models)
        graph = {n: deps & chosen for n, deps in self._graph().items() if n in chosen}
        sorter = TopologicalSorter(graph)
        sorter.prepare()
        outcome: dict[str, str] = {}
        with ThreadPoolExecutor(workers) as pool:
            running = {}
            while sorter.is_active():
                for name in sorter.get_ready():
                    running[pool.submit(run_model, lake, self.models[name], full_refresh)] = name
                done, _ = wait(running, return_when=FIRST_COMPLETED)
                for task in done:
                    name = running.pop(task)
                    outcome[name] = task.result()
                    sorter.done(name)
        return outcome


def target_mark(lake: LakeStore, model: Model) -> object:
    """Highest cursor of the target; 1900-01-01 for an empty one."""
    mark = lake.mark(model.target, model.cursor)
    if mark is None:
        mark = lake.read(model.target).agg(F.max(model.cursor)).first()[0]
    return EPOCH_MARK if mark is None else mark


def run_model(lake: LakeStore, model: Model, full_refresh: bool = False) -> str:
    """``rebuilt``, ``merged``, ``skipped`` or ``waiting``."""
    if model.ready is not None and not model.ready(lake):
        return "waiting"
    seen = _dimension_versions(lake, model)
    outcome = _run_model(lake, model, full_refresh)
    if seen and outcome != "skipped":
        lake.write("state", f"{model.name}__inputs", _as_rows(lake, seen), "overwrite")
    return outcome


def _dimension_versions(lake: LakeStore, model: Model) -> dict[str, int]:
    """Present version of each input but the first; federated ones have none."""
    own = [i for i in model.inputs[1:] if not i.startswith("fed/")]
    return {i: lake.current_version(i) for i in own}


def _as_rows(lake: LakeStore, versions: dict[str, int]) -> DataFrame:
    return lake.spark.createDataFrame(list(versions.items()), "input string, version int")


def _dimensions_moved(lake: LakeStore, model: Model) -> bool:
    now = _dimension_versions(lake, model)
    state = ("state", f"{model.name}__inputs")
    if not now or not lake.table_exists(state):
        return False
    return {r["input"]: r["version"] for r in lake.read(state).collect()} != now


def _run_model(lake: LakeStore, model: Model, full_refresh: bool) -> str:
    frames = [lake.read(i) for i in model.inputs]
    incremental = (
        model.materialized == "incremental" and not full_refresh and lake.table_exists(model.target)
    )
    if not incremental:
        if frames and frames[0].isEmpty():
            return "skipped"
        lake.write(
            *model.target, model.build(*frames), "overwrite", sort_by=model.cursor, track=model.cursor
        )
        return "rebuilt"
    cursor = model.input_cursor or model.cursor
    if cursor not in frames[0].columns:
        raise ValueError(f"{model.inputs[0]} has no cursor column {cursor}")
    if not _dimensions_moved(lake, model):
        mark = target_mark(lake, model)
        if _known_unchanged(lake, model, cursor, mark):
            return "skipped"
        frames[0] = frames[0].where(beyond(frames[0], cursor, mark))
    # The delta is written once; an empty one leaves no commit behind.
    version = lake.write(
        *model.target, model.build(*frames), "merge", pk=list(model.unique_key),
        order=model.cursor, sort_by=model.cursor, skip_empty=True, track=model.cursor,
    )
    if version is None:
        return "skipped"
    if lake.needs_compaction(model.target):
        lake.fold(model.target, sort_by=model.cursor)
    return "merged"


def _known_unchanged(lake: LakeStore, model: Model, cursor: str, mark: object) -> bool:
    """Whether the input's own mark already proves that there is no delta."""
    if model.inputs[0].startswith("fed/"):
        return False
    reached = lake.mark(model.inputs[0], cursor)
    return reached is not None and type(reached) is type(mark) and reached <= mark


def has_changes(lake: LakeStore, model: Model) -> bool:
    """Whether the first input holds rows beyond the target's cursor, or another input is newer."""
    if _dimensions_moved(lake, model):
        return True
    source = lake.read(model.inputs[0])
    cursor = model.input_cursor or model.cursor
    if not lake.table_exists(model.target) or cursor not in source.columns:
        return True
    mark = target_mark(lake, model)
    if _known_unchanged(lake, model, cursor, mark):
        return False
    return not source.where(beyond(source, cursor, mark)).isEmpty()
