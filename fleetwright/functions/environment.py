"""Variables of a run's containers, as column expressions.

``containers`` is ``array<struct<name, env: array<struct<name, value, value_from>>>>``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True, eq=False)
class Variable:
    """A variable to set: the first one of that name in a container, or else a new one.

    A part left out (``value`` or ``value_from``) stays as it is. ``always_new`` adds the
    variable even if the name is taken; ``only`` restricts it to some rows.
    """

    name: str
    value: Column | None = None
    value_from: Column | None = None
    always_new: bool = False
    only: Column | None = None


def _names(env: Column) -> Column:
    return F.transform(env, lambda v: v["name"])


def _entry(name: Column, value: Column, value_from: Column) -> Column:
    return F.struct(name.alias("name"), value.alias("value"), value_from.alias("value_from"))


def _folded(settings: Sequence[Variable], part: str, before: Column) -> Column:
    """``part`` after all settings of one name, starting from ``before``."""
    for setting in settings:
        new = getattr(setting, part)
        if new is not None:
            before = new if setting.only is None else F.when(setting.only, new).otherwise(before)
    return before


def _applies(settings: Sequence[Variable]) -> Column:
    """Whether any of the settings holds for the row."""
    conditions = [F.lit(True) if s.only is None else s.only for s in settings]
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def set_variables(containers: Column, settings: Sequence[Variable]) -> Column:
    """Containers after all settings, in order, in one pass over each container.

    The outcome is that of applying them one by one. Settings of one name are folded into one
    change; a new variable stands where the first setting that holds would have put it.
    """
    added = {s.name for s in settings if s.always_new}
    named: dict[str, list[Variable]] = {}
    for setting in settings:
        if not setting.always_new:
            if setting.name in added:
                raise ValueError(f"{setting.name} is both added and set; use two calls")
            named.setdefault(setting.name, []).append(setting)
    nothing, empty = F.lit(None).cast("string"), F.lit("")

    def change(env: Column) -> Column:
        def changed(v: Column, i: Column) -> Column:
            out = v
            for name, group in named.items():
                first = (v["name"] == name) & (i + 1 == F.array_position(_names(env), name))
                new = _entry(
                    v["name"], _folded(group, "value", v["value"]), _folded(group, "value_from", v["value_from"])
                )
                out = F.when(first & _applies(group), new).otherwise(out)
            return out

        new = []
        for setting in settings:
            only = F.lit(True) if setting.only is None else setting.only
            if setting.always_new:
                group = [setting]
            else:
                group = named[setting.name]
                only = only & ~_applies(group[: group.index(setting)])
                only = only & ~F.array_contains(_names(env), setting.name)
            entry = _entry(
                F.lit(setting.name), _folded(group, "value", empty), _folded(group, "value_from", nothing)
            )
            new.append(F.when(only, entry))
        kept = F.transform(env, changed) if named else env
        return F.concat(kept, F.array_compact(F.array(*new)))

    return F.transform(
        containers, lambda c: F.struct(c["name"].alias("name"), change(c["env"]).alias("env"))
    )


def has_variable(containers: Column, name: str) -> Column:
    """Whether any container already has the variable."""
    return F.exists(containers, lambda c: F.array_contains(_names(c["env"]), name))


def put(entries: Column, values: dict[str, Column]) -> Column:
    """Map with the given keys set; a null value leaves its key as it was, other entries stay."""
    pairs = [x for key, value in values.items() for x in (F.lit(key), value)]
    new = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())
    return F.map_concat(F.map_filter(entries, lambda k, _: ~F.map_contains_key(new, k)), new)
