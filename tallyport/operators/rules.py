"""Rules on files, as parameters and as conditions."""

from __future__ import annotations

from typing import NamedTuple

EXTENSION = "CASE WHEN instr(name, '.') = 0 OR name LIKE '%.' THEN NULL ELSE lower({0}) END"


class Rules(NamedTuple):
    """What a file must keep; None, or an empty list, is no rule."""

    max_bytes: int | None = None
    min_bytes: int | None = None
    types: tuple[str, ...] = ()
    extensions: tuple[str, ...] = ()
    required: tuple[tuple[str, str], ...] = ()  # column and the path that an issue names
    dimensions: bool = False
    min_width: int | None = None
    max_width: int | None = None
    min_height: int | None = None
    max_height: int | None = None


#: The rules of the registered queries.
RULES = Rules(6000, 600, ("image/tiff", "image/png"), ("tif", "tiff", "png"), (("lot_id", "metadata.lot"),), True, 100, 4000, 200, 2500)


def extension_of(d) -> str:
    last = "substring_index(name, '.', -1)" if d.name == "spark" else "split_part(name, '.', -1)"
    return EXTENSION.format(last)


def _in(x: str, values: tuple[str, ...]) -> str:
    return f"{x} IN ({', '.join(repr(v) for v in values)})"


def dimension_checks(rules: Rules) -> list[tuple[str, str, str]]:
    """The rules on image size; where the size is unknown, only that is said."""
    found = []
    if rules.dimensions:
        found.append(("width IS NULL OR height IS NULL", "image.dimensions_unavailable", "'image'"))
    for name, other in (("width", "height"), ("height", "width")):
        least, most = (rules.min_width, rules.max_width) if name == "width" else (rules.min_height, rules.max_height)
        if least is not None:
            found.append((f"coalesce({name} < {least} AND {other} IS NOT NULL, false)", f"image.{name}_too_small", f"'image.{name}'"))
        if most is not None:
            found.append((f"coalesce({name} > {most} AND {other} IS NOT NULL, false)", f"image.{name}_too_large", f"'image.{name}'"))
    return found


def file_checks(d, rules: Rules) -> list[tuple[str, str, str]]:
    """The rules on a file, in their fixed order."""
    found = [("size_bytes = 0", "file.empty", "'file.size'")]
    if rules.max_bytes is not None:
        found.append((f"size_bytes > {rules.max_bytes}", "file.too_large", "'file.size'"))
    if rules.min_bytes is not None:
        found.append((f"size_bytes < {rules.min_bytes}", "file.too_small", "'file.size'"))
    if rules.types:
        found.append((f"NOT coalesce({_in('media_type', rules.types)}, false)", "file.mime_not_allowed", "'file.type'"))
    if rules.extensions:
        found.append((f"NOT coalesce({_in(extension_of(d), rules.extensions)}, false)", "file.extension_not_allowed", "'file.name'"))
    found += [(f"coalesce({column}, '') = ''", "metadata.required_missing", f"'{path}'") for column, path in rules.required]
    return found + dimension_checks(rules)


def contained(d, x: str) -> str:
    """SQL: whether a path stays below its root: relative, not empty, without a NUL character, and never above where it starts; null is not."""
    return f"coalesce({x} <> '' AND NOT ({x} LIKE '/%') AND instr({x}, chr(0)) = 0 AND {d.depth_ok(x)}, false)"
