"""The library's verbs under short names: sidecar.generate, aggregate.by_sidecar, accumulator.update_state and
finalize.from_state."""

from __future__ import annotations

from types import SimpleNamespace

from cellgrid.operators import aggregate as _aggregate
from cellgrid.operators import assign as _assign
from cellgrid.streaming import state as _state

sidecar = SimpleNamespace(generate=_assign.assign_points, generate_footprints=_assign.assign_footprints)
aggregate = SimpleNamespace(by_sidecar=_aggregate.aggregate_by_sidecar, points=_aggregate.aggregate_points, densify=_aggregate.densify)
accumulator = SimpleNamespace(update_state=_state.accumulate, merge=_state.merged)
finalize = SimpleNamespace(from_state=_state.finalize)
