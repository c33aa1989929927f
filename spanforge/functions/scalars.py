"""Column functions over call and event names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Low-level events that say nothing about a call.
NOISY = ("futex", "madvise", "clock_gettime", "sched_yield")
TRIMMED = ("futex", "madvise")


def event_name(raw: Column) -> Column:
    """The text before the first bracket; signal lines stay whole."""
    return F.substring_index(raw, "(", 1)


def without_args(api: Column) -> Column:
    return F.substring_index(api, "(", 1)


def method_name(api: Column) -> Column:
    return F.substring_index(without_args(api), ".", -1)


def class_name(api: Column, compat: bool = False) -> Column:
    """All dotted parts but the last; "" without a dot. compat keeps what a dotted argument type leaks into the name."""
    return F.regexp_replace(api if compat else without_args(api), r"[.]?[^.]*$", "")


def package_name(api: Column, compat: bool = False) -> Column:
    return F.regexp_replace(class_name(api, compat), r"[.]?[^.]*$", "")


def roll_up(api: Column, scope: str) -> Column:
    """An API at one of the scopes full, method, class and package."""
    kinds = {"full": lambda c: c, "method": method_name, "class": class_name, "package": package_name}
    if scope not in kinds:
        raise ValueError(f"scope must be one of {sorted(kinds)}")
    return kinds[scope](api)


def names_of(calls: Column, kind: str | None = None) -> Column:
    """Names in an array of calls (kind, name), of one kind or all."""
    kept = calls if kind is None else F.filter(calls, lambda c: c["kind"] == kind)
    return F.transform(kept, lambda c: c["name"])


def sequence_key(calls: Column) -> Column:
    """A text that is equal for equal sequences of calls."""
    return F.array_join(F.transform(calls, lambda c: F.concat(c["kind"], F.lit(":"), c["name"])), "|")


def permission_tail(line: Column) -> Column:
    """The last dotted part of a permission."""
    return F.element_at(F.split(F.trim(line), "[.]"), -1)


def full_permission(name: Column) -> Column:
    """A permission with its prefix, if it has no dot of its own."""
    return F.when(F.contains(name, F.lit(".")), name).otherwise(F.concat(F.lit("android.permission."), name))


def api_identifier(package: Column, cls: Column, method: Column, args: Column) -> Column:
    """pkg.Class.method(T1, T2); a constructor's method is the class."""
    return F.concat(F.concat_ws(".", package, cls, method), F.lit("("), F.array_join(args, ", "), F.lit(")"))


def listed_api(line: Column) -> Column:
    """method(args) of a line of an API list; "" for a line without one."""
    return F.regexp_extract(line, r"([\w.$]+\([^)]*\))", 1)
