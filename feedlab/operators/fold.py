"""Keyed folds: user code ``reduce(state, row)`` over the rows of each key in order, without holding a key's rows."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def fold_events(df: DataFrame, keys: list[str], order: list[str | Column], reduce: Callable, start: Callable, out: str, finish: Callable | None = None, dealt: bool = False) -> DataFrame:
    """keys and what ``reduce`` gives out for each row, in order; ``seq`` (if ``out`` has it) counts the rows given out by key.

    ``start()`` makes a key's first state; ``reduce(state, row)`` returns the next state and a dict for an output row, or
    None. ``finish(state)`` (if given) does the same after a key's last row. A key's rows are sorted by Spark (spilling if need be) and pass through one at a time with the state alone in
    memory. ``order`` must be total, so that the result depends on nothing else. ``dealt`` says that a key's rows are in one
    partition already, as a window by key leaves them.
    """
    schema = StructType([*df.select(*keys).schema, *_parse_datatype_string(out)])
    arrow = to_arrow_schema(schema)
    counted = "seq" in schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, seq, rows = None, None, 0, []

        def give(given: dict | None) -> None:
            nonlocal seq
            if given is not None:
                seq += 1
                rows.append({**dict(zip(keys, key, strict=True)), **({"seq": seq} if counted else {}), **given})

        for batch in batches:
            for row in batch.to_pylist():
                own = tuple(row[k] for k in keys)
                if state is None or own != key:
                    if state is not None and finish is not None:
                        give(finish(state))
                    key, state, seq = own, start(), 0
                state, given = reduce(state, row)
                give(given)
                if len(rows) >= 1000:
                    yield pa.RecordBatch.from_pylist(rows, arrow)
                    rows = []
        if state is not None and finish is not None:
            give(finish(state))
        if rows:
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return (df if dealt else df.repartition(*[F.col(k) for k in keys])).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def checked_fold(df: DataFrame, keys: list[str], order: list[str | Column], reduce: Callable, start: Callable, out: str) -> DataFrame:
    """As ``fold_events``, for reducers that raise ``RuleBroken``: the key's first violation is given out and ends the key.

    The output has ``violation`` (null for accepted rows) besides the columns in ``out``.
    """

    def guarded(state: dict, row: dict) -> tuple[dict, dict | None]:
        if state["ended"]:
            return state, None
        try:
            inner, given = reduce(state["inner"], row)
        except RuleBroken as e:
            return {"ended": True, "inner": state["inner"]}, {"violation": str(e)}
        return {"ended": False, "inner": inner}, None if given is None else {"violation": None, **given}

    return fold_events(df, keys, order, guarded, lambda: {"ended": False, "inner": start()}, f"{out}, violation string")


def canonical(value) -> str:
    """JSON with sorted keys and no spaces: equal values have equal texts."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


CHAIN = "sequence long, event_id string, previous_sha256 string, event_sha256 string, next_sha256 string, trace_sha256 string, state string"


def chained_fold(df: DataFrame, keys: list[str], game: str, sequence: str, event_id: str, reduce: Callable, start: Callable) -> DataFrame:
    """keys, ``CHAIN`` and ``violation``: a step for each row, which names the hashes of the state before, the event and the state after it.

    States are what ``reduce(state, row)`` returns (plain values); their hashes are of their canonical JSON. A row whose game
    is not the key's first game is a ``game_mismatch``, one whose number is not one more than the last a
    ``sequence_break``; these and any RuleBroken end the key with a step that has the violation alone.
    """
    own = [c for c in df.columns if c not in keys]

    def step(state: dict, row: dict) -> tuple[dict, dict | None]:
        if state["game"] is None:
            state = {**state, "game": row[game]}
        if row[game] != state["game"]:
            raise RuleBroken("game_mismatch")
        if state["sequence"] is not None and row[sequence] != state["sequence"] + 1:
            raise RuleBroken("sequence_break")
        after = reduce(state["inner"], row)
        text, event = canonical(after), _sha(canonical({c: row[c] for c in own}))
        done = {"sequence": row[sequence], "event_id": str(row[event_id]), "previous_sha256": state["hash"], "event_sha256": event, "next_sha256": _sha(text), "state": text}
        done["trace_sha256"] = _sha("|".join(str(done[c]) for c in TRACED))
        return {"game": state["game"], "sequence": row[sequence], "inner": after, "hash": done["next_sha256"]}, done

    def first() -> dict:
        inner = start()
        return {"game": None, "sequence": None, "inner": inner, "hash": _sha(canonical(inner))}

    return checked_fold(df, keys, [sequence, event_id], step, first, CHAIN)


#: What the hash of a step covers.
TRACED = ("sequence", "event_id", "previous_sha256", "event_sha256", "next_sha256")


def verify_chain(steps: DataFrame, keys: list[str], start: Column) -> DataFrame:
    """(keys, sequence, problem) of the steps of ``chained_fold`` that don't fit: ``state`` (its hash isn't next_sha256), ``trace``, ``link`` and ``number``.

    All steps are checked in parallel; only the link to the step before needs a window by key. ``start`` is the first state's JSON.
    """
    w = Window.partitionBy(*keys).orderBy("sequence")
    good = steps.where("violation IS NULL")
    before, number = F.lag("next_sha256").over(w), F.lag("sequence").over(w)
    rows = good.select(*keys, "sequence", *[c for c in ("previous_sha256", "next_sha256", "trace_sha256", "state")], before.alias("_before"), number.alias("_number"), F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in TRACED]), 256).alias("_trace"))
    found = F.array_compact(F.array(
        F.when(~F.sha2(F.col("state"), 256).eqNullSafe(F.col("next_sha256")), "state"), F.when(~F.col("_trace").eqNullSafe(F.col("trace_sha256")), "trace"),
        F.when(~F.col("previous_sha256").eqNullSafe(F.coalesce("_before", F.sha2(start, 256))), "link"), F.when(F.col("_number").isNotNull() & (F.col("sequence") != F.col("_number") + 1), "number"),
    ))
    return rows.select(*keys, "sequence", F.explode(found).alias("problem"))


class RuleBroken(ValueError):
    """A row that a reducer's rules do not allow; its text is the category."""
