"""Lists of settings as a command line gives them: values between commas."""

from __future__ import annotations

YES, NO = ("1", "true", "yes", "y", "on"), ("0", "false", "no", "n", "off")


def parts(said: str) -> list[str]:
    found = [x.strip() for x in said.split(",") if x.strip()]
    if not found:
        raise ValueError("a list needs a value")
    return found


def ints(said: str) -> list[int]:
    return [int(x) for x in parts(said)]


def floats(said: str) -> list[float]:
    return [float(x) for x in parts(said)]


def bools(said: str) -> list[bool]:
    found = [x.lower() for x in parts(said)]
    if wrong := [x for x in found if x not in YES + NO]:
        raise ValueError(f"neither yes nor no: {wrong[0]}")
    return [x in YES for x in found]
