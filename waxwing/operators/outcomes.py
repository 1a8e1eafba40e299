"""Values that may fail: a struct of value and error goes through a plan, and failed rows are kept apart and counted."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: Kinds of failure of an outside program: it isn't there, it took too long, or what it said is no answer.
MISSING, TIMEOUT, DECODE = "BinaryMissing", "Timeout", "DecodeError"
_ERROR = "struct<kind: string, message: string>"


def outcome(value: Column, *failures: tuple[str, Column, Column]) -> Column:
    """A struct (value, error): the first failure (kind, condition, message) that holds, else the value. A condition that
    is null doesn't hold."""
    error = F.lit(None).cast(_ERROR)
    for kind, failed, message in reversed(failures):
        error = F.when(failed, F.struct(F.lit(kind).alias("kind"), message.cast("string").alias("message"))).otherwise(error)
    return F.struct(F.when(error.isNull(), value).alias("value"), error.alias("error"))


def then(attempt: Column, value, *failures: tuple[str, Column, Column]) -> Column:
    """The next step of an outcome: ``value`` is a function of the value so far; an earlier error stays."""
    following = outcome(value(attempt["value"]), *failures)
    return F.struct(F.when(attempt["error"].isNull(), following["value"]).alias("value"), F.when(attempt["error"].isNotNull(), attempt["error"]).otherwise(following["error"]).alias("error"))


def observed(df: DataFrame, attempt: str, kinds: Sequence[str], name: str = "outcomes") -> tuple[DataFrame, Observation]:
    """``df`` with an observation that counts its rows, good ones and those of each kind while it is used, in no pass of its own."""
    seen = Observation(name)
    failed = F.col(attempt)["error"]["kind"]
    counts = [F.count(F.lit(1)).alias("rows"), F.count_if(failed.isNull()).alias("good"), *(F.count_if(failed == k).alias(k) for k in kinds)]
    return df.observe(seen, *counts), seen


def parted(df: DataFrame, attempt: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a value, rows with an error): the struct gives way to a column of its name, and to ``kind`` and ``message``."""
    others = [c for c in df.columns if c != attempt]
    error = F.col(attempt)["error"]
    good = df.filter(error.isNull()).select(*others, F.col(attempt)["value"].alias(attempt))
    return good, df.filter(error.isNotNull()).select(*others, error["kind"].alias("kind"), error["message"].alias("message"))


def fingerprint(program: Sequence[str], path: str, timeout: float, roots: Sequence[str]) -> tuple[tuple[str, float] | None, tuple[str, str] | None]:
    """((fingerprint, seconds), error) of a file by an outside program that prints FINGERPRINT= and DURATION= lines. A
    file outside the roots is not opened."""
    real = os.path.realpath(path)
    if not any(real == r or real.startswith(r.rstrip("/") + "/") for r in map(os.path.realpath, roots)):
        return None, (DECODE, f"path outside the roots: {path}")
    try:
        done = subprocess.run([*program, real], capture_output=True, text=True, errors="replace", timeout=timeout, check=False)
    except FileNotFoundError:
        return None, (MISSING, f"no program {program[0]}")
    except subprocess.TimeoutExpired:
        return None, (TIMEOUT, f"more than {timeout} s")
    except OSError as error:
        return None, (MISSING, str(error))
    if done.returncode:
        return None, (DECODE, f"status {done.returncode}: {done.stderr.strip()[:200]}")
    said: Mapping[str, str] = dict(line.split("=", 1) for line in done.stdout.splitlines() if "=" in line)
    try:
        seconds = float(said["DURATION"])
    except (KeyError, ValueError):
        return None, (DECODE, "no duration")
    mark = said.get("FINGERPRINT", "").strip()
    return ((mark, seconds), None) if mark else (None, (DECODE, "no fingerprint"))


def fingerprints(files: DataFrame, path: str, program: Sequence[str], roots: Sequence[str], timeout: float = 10.0, name: str = "print") -> DataFrame:
    """All rows with a column ``name``, struct (value (mark, seconds), error (kind, message)), by a program that each executor has.

    A file that fails leaves the others alone: the three kinds are a program that isn't there, one that takes longer than
    ``timeout`` seconds, and one that gives no answer or a file outside ``roots``. A null path is a DecodeError. One file at
    a time is open in a task.
    """
    shape = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in files.schema.fields)}, `{name}` struct<value: struct<mark: string, seconds: double>, error: {_ERROR}>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            told = []
            for one in frame[path]:
                value, error = fingerprint(program, one, timeout, roots) if one else (None, (DECODE, "no path"))
                told.append({"value": value and dict(zip(("mark", "seconds"), value, strict=True)), "error": error and dict(zip(("kind", "message"), error, strict=True))})
            yield frame.assign(**{name: told})

    return files.mapInPandas(run, shape)
