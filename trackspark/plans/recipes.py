"""Named, versioned operations and derivations, the log of what ran, and its replay with checks."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REGISTRY: dict[str, Operation] = {}
DERIVATIONS: dict[str, Derivation] = {}


@dataclass(frozen=True)
class Operation:
    """run(df, **params) -> df. params: names to checks that raise ValueError. ranged: whether it may act on a range of seq."""

    id: str
    version: int
    run: Callable[..., DataFrame]
    params: dict[str, Callable[[object], None]] = field(default_factory=dict)
    ranged: bool = False


@dataclass(frozen=True)
class Derivation:
    """run(df) -> df that adds columns outputs and needs columns inputs."""

    id: str
    version: int
    run: Callable[..., DataFrame]
    inputs: tuple[str, ...] = ()
    outputs: tuple[str, ...] = ()


@dataclass(frozen=True)
class Record:
    """One step as it ran: with fingerprints of what went in and came out where they were asked for."""

    op: str
    version: int
    params: dict
    scope: tuple[int, int] | None = None
    in_fp: str | None = None
    out_fp: str | None = None


def finite(value: object) -> None:
    if not isinstance(value, (int, float)) or isinstance(value, bool) or value != value or value in (float("inf"), float("-inf")):
        raise ValueError(f"a finite number is asked for, not {value!r}")


def positive(value: object) -> None:
    finite(value)
    if not value > 0:
        raise ValueError(f"a number above 0 is asked for, not {value!r}")


def whole(value: object) -> None:
    finite(value)
    if value != int(value):
        raise ValueError(f"a whole number is asked for, not {value!r}")


def whole_from(least: int) -> Callable[[object], None]:
    def check(value: object) -> None:
        whole(value)
        if value < least:
            raise ValueError(f"a whole number of {least} or more is asked for, not {value!r}")

    return check


def one_of(*known: object) -> Callable[[object], None]:
    def check(value: object) -> None:
        if value not in known:
            raise ValueError(f"one of {known} is asked for, not {value!r}")

    return check


def truth(value: object) -> None:
    if not isinstance(value, bool):
        raise ValueError(f"true or false is asked for, not {value!r}")


def operation(id: str, version: int, ranged: bool = False, **params: Callable[[object], None]):
    """Registers a DataFrame function under an id that must be new."""

    def add(run):
        if id in REGISTRY:
            raise ValueError(f"operation {id} is registered already")
        REGISTRY[id] = Operation(id, version, run, params, ranged)
        return run

    return add


def derivation(id: str, version: int, inputs: tuple[str, ...] = (), outputs: tuple[str, ...] = ()):
    """Registers a function that derives columns from others."""

    def add(run):
        if id in DERIVATIONS:
            raise ValueError(f"derivation {id} is registered already")
        DERIVATIONS[id] = Derivation(id, version, run, inputs, outputs)
        return run

    return add


def run_derivation(df: DataFrame, id: str) -> DataFrame:
    """Derives columns anew: what an earlier run made of them goes first. Refuses df without the inputs."""
    if id not in DERIVATIONS:
        raise ValueError(f"no derivation {id}")
    d = DERIVATIONS[id]
    if lost := [c for c in d.inputs if c not in df.columns]:
        raise ValueError(f"{id} needs {', '.join(lost)}")
    return d.run(df.drop(*(c for c in d.outputs if c not in d.inputs)))


def checked(id: str, params: dict) -> Operation:
    """The operation, if it is known and the parameters are its own and sound, and none is missing."""
    if id not in REGISTRY:
        raise ValueError(f"no operation {id}")
    op = REGISTRY[id]
    if extra := set(params) - set(op.params):
        raise ValueError(f"{id} has no {', '.join(sorted(extra))}")
    for name, value in params.items():
        op.params[name](value)
    asked = [p.name for p in list(inspect.signature(op.run).parameters.values())[1:] if p.default is p.empty and p.kind not in (p.VAR_KEYWORD, p.VAR_POSITIONAL)]
    if lost := [n for n in asked if n in op.params and n not in params]:
        raise ValueError(f"{id} asks for {', '.join(lost)}")
    return op


def whole_fingerprint(df: DataFrame) -> str:
    """One fingerprint of all tracks; a job."""
    from ..operators.aggregate import fingerprint

    r = fingerprint(df).agg(F.count("*").alias("n"), F.sum(F.xxhash64("track_id", "n", "hash").cast("decimal(38,0)")).alias("h")).first()
    return f"{r['n']}:{int(r['h'] or 0) % (1 << 64):016x}"


def run_op(df: DataFrame, id: str, params: dict, log: list[Record] | None = None, scope: tuple[int, int] | None = None, fingerprints: bool = False) -> DataFrame:
    """Checks the parameters, transforms lazily, and appends to the log. scope is a range of seq, for operations that keep points.

    fingerprints, two jobs, are logged if asked for.
    """
    from ..operators.edit import apply_to_range

    op = checked(id, params)
    if scope is not None and not op.ranged:
        raise ValueError(f"{id} acts on whole tracks")
    out = op.run(df, **params) if scope is None else apply_to_range(df, *scope, lambda x: op.run(x, **params))
    if log is not None:
        marks = (whole_fingerprint(df), whole_fingerprint(out)) if fingerprints else (None, None)
        log.append(Record(id, op.version, dict(params), scope, *marks))
    return out


def replay(df: DataFrame, recipe: list[Record]) -> DataFrame:
    """Runs a log's steps anew; versions must be those that ran, and where fingerprints were logged data must agree with them."""
    for k, step in enumerate(recipe):
        if step.op not in REGISTRY or REGISTRY[step.op].version != step.version:
            raise ValueError(f"{step.op} version {step.version} isn't registered")
        if step.in_fp is not None and whole_fingerprint(df) != step.in_fp:
            raise ValueError(f"step {k}, {step.op}: its input isn't what it was")
        df = run_op(df, step.op, step.params, scope=step.scope)
        if step.out_fp is not None and whole_fingerprint(df) != step.out_fp:
            raise ValueError(f"step {k}, {step.op}: its result isn't what it was")
    return df


def log_table(spark, run_id: str, log: list[Record]) -> DataFrame:
    """(run_id, step, op, version, params, scope, in_fp, out_fp) of a log."""
    import json

    rows = [(run_id, k, r.op, r.version, json.dumps(r.params, sort_keys=True), None if r.scope is None else f"{r.scope[0]}-{r.scope[1]}", r.in_fp, r.out_fp) for k, r in enumerate(log)]
    return spark.createDataFrame(rows, "run_id string, step int, op string, version int, params string, scope string, in_fp string, out_fp string")
