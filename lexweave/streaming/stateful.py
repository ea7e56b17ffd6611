"""Stateful streams: budget admission and job states per key, as Structured Streaming operators."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexweave.operators.budget import COUNTERS, fold_admission
from lexweave.operators.jobs import TRANSITIONS


def admit_stream(requests: DataFrame, deployment: str, order: str, caps: dict[str, dict[str, int]]) -> DataFrame:
    """``requests(deployment, order, kind, id, requests, input_bound, output_tokens)`` with ``refused_by``: null if admitted, against what the scopes of
    a deployment have used so far; a refused request uses nothing.

    Within a micro-batch a deployment's requests are taken in ``order``; across batches as they come. The state is one row for
    each scope that has used something.
    """
    columns = [deployment, order, "kind", "id", *COUNTERS]

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used = {tuple(x[:2]): dict(zip(COUNTERS, x[2:], strict=True)) for x in json.loads(state.get[0])} if state.exists else {}
        rows = pd.concat(list(batches)).sort_values(order)
        rows["refused_by"] = list(fold_admission(iter(rows.astype(object).to_dict("records")), caps, used))
        state.update((json.dumps([[*key, *(int(u[c]) for c in COUNTERS)] for key, u in used.items()]),))
        yield rows[[*columns, "refused_by"]]

    kinds = {f.name: f.dataType.simpleString() for f in requests.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", refused_by string"
    return requests.select(*columns).groupBy(deployment).applyInPandasWithState(fold, schema, "used string", "append", GroupStateTimeout.NoTimeout)


def job_states(events: DataFrame, key: str, order: str, event: str) -> DataFrame:
    """(key, order, event, status): each event's outcome; one that doesn't fit leaves the status as it is."""

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status = state.get[0] if state.exists else "pending"
        rows = pd.concat(list(batches)).sort_values(order)
        out = []
        for o, e in zip(rows[order], rows[event], strict=True):
            status = TRANSITIONS.get((status, e), status)
            out.append((k[0], o, e, status))
        state.update((status,))
        yield pd.DataFrame(out, columns=[key, order, event, "status"])

    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    schema = f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, `{event}` string, status string"
    return events.select(key, order, event).groupBy(key).applyInPandasWithState(fold, schema, "status string", "append", GroupStateTimeout.NoTimeout)
