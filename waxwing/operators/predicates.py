"""Predicate languages that compile to one boolean column, which Catalyst pushes down."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Fields = Mapping[str, tuple[str, str]]  # field code -> (column, kind: int, float, str or date)

#: The rule language's field codes.
RULE_FIELDS: Fields = {
    "1": ("title", "str"),
    "2": ("artist", "str"),
    "3": ("album", "str"),
    "4": ("genre", "str"),
    "5": ("comment", "str"),
    "6": ("play_count", "int"),
    "7": ("rating", "int"),
    "8": ("bpm", "float"),
    "9": ("release_year", "int"),
    "10": ("stock_date", "date"),
    "11": ("bitrate", "int"),
    "12": ("key", "str"),
    "13": ("total_time", "float"),
    "14": ("color_id", "str"),
    "15": ("label", "str"),
}
_DAY = 86400.0
#: Seconds of a unit code; a month is 30 days. Other codes are seconds.
UNITS = {"1": _DAY, "2": 7 * _DAY, "3": 30 * _DAY}



def FALSE() -> Column:  # noqa: N802
    return F.lit(False)


def TRUE() -> Column:  # noqa: N802
    return F.lit(True)


def closed(condition: Column) -> Column:
    """Unknown counts as false, also under a negation outside."""
    return F.coalesce(condition, FALSE())


def all_of(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, TRUE())


def any_of(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, FALSE())


def whole(value: Column) -> Column:
    """An int from a number or text, cut towards zero; else null."""
    return value.try_cast("double").try_cast("int")


def epoch(value: Column) -> Column:
    """Seconds since 1970 of the first 19 characters, in one of three formats; else null."""
    text = F.substring(value.cast("string"), 1, 19)
    shapes = (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"), (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm:ss"), (r"^\d{4}/\d{2}/\d{2}$", "yyyy/MM/dd")
    return F.coalesce(*(F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(form)).cast("double")) for shape, form in shapes))


def _number(value: object, kind: str) -> float | int | None:
    try:
        return int(float(str(value))) if kind == "int" else float(str(value))
    except (TypeError, ValueError):
        return None


def rule_condition(rule: Mapping[str, object], fields: Fields, now: float) -> Column:
    """One condition {Field, Operator, ValueLeft, ValueRight, ValueUnit}; unknown fields, operators and values are false."""
    found, code = fields.get(str(rule.get("Field", ""))), str(rule.get("Operator", "1"))
    if not found:
        return FALSE()
    column, kind = F.col(found[0]), found[1]
    left, right = rule.get("ValueLeft"), rule.get("ValueRight")
    if kind == "date":
        unit = UNITS.get(str(rule.get("ValueUnit", "0")), 1.0)
        older, newest = ((now - (_number(x, "float") or 0.0) * unit) for x in (right, left))
        at = epoch(column)
        made = {"3": lambda: at >= newest, "4": lambda: at < newest, "0": lambda: at.between(older, newest)}.get(code)
        return closed(made()) if made else FALSE()
    if kind in ("int", "float"):
        value = whole(column) if kind == "int" else column.try_cast("double")
        low, high = _number(left, kind), _number(right, kind)
        if low is None:
            return FALSE()
        made = {
            "0": lambda: value.between(low, high) if high is not None else FALSE(),
            "1": lambda: value == low,
            "2": lambda: value != low,
            "3": lambda: value > low,
            "4": lambda: value < low,
        }.get(code)
        return closed(made()) if made else FALSE()
    text, needle = F.lower(column.cast("string")), F.lit(str(left).lower() if left else "")
    made = {
        "1": lambda: text == needle,
        "2": lambda: text != needle,
        "5": lambda: F.contains(text, needle),
        "6": lambda: ~F.contains(text, needle),
        "7": lambda: F.startswith(text, needle),
        "8": lambda: F.endswith(text, needle),
    }.get(code)
    return closed(made()) if made else FALSE()


def smart(criteria: Mapping | None, fields: Fields = RULE_FIELDS, now: float = 0.0) -> Column:
    """The rule language: no criteria or conditions keep all rows; conditions are joined by and, else by or."""
    rules = (criteria or {}).get("conditions") or []
    if not rules:
        return TRUE()
    parts = [rule_condition(x, fields, now) for x in rules]
    return all_of(parts) if str(criteria.get("LogicalOperator", "all")).lower() in ("all", "and", "1") else any_of(parts)


# --- The database's own rule dialect: its operator numbers mean other things. ---


@dataclass(frozen=True)
class Rule:
    """A condition of the database dialect; ``property`` names a field."""

    property: str
    operator: int
    left: str | None = None
    right: str | None = None


def parse_rules(xml: str) -> tuple[bool, list[Rule]] | None:
    """(whether all must hold, rules) from the XML of a stored smart list; None if it can't be read."""
    import xml.etree.ElementTree as tree

    try:
        root = tree.fromstring(xml)
        both = int(root.get("LogicalOperator", "1")) == 1
        return both, [Rule(x.get("PropertyName") or x.get("RuleId") or "", int(x.get("Operator", "0")), x.get("ValueLeft"), x.get("ValueRight")) for x in root.iter("CONDITION")]
    except (tree.ParseError, TypeError, ValueError):
        return None


#: The attributes of a stored list and of its conditions, and what counts where one is absent.
LIST_ATTRIBUTES = {"LogicalOperator": "all", "AutomaticUpdate": "1"}
CONDITION_ATTRIBUTES = {"Field": "", "Operator": "1", "ValueLeft": "", "ValueRight": "", "ValueUnit": "0"}


def criteria(xml: Column) -> Column:
    """A column of stored lists as structs of their attributes and ``conditions``; null for what can't be read."""
    names = lambda known: ", ".join(f"_{n}: string" for n in known)
    inner = f"array<struct<{names(CONDITION_ATTRIBUTES)}>>"
    shape = f"{', '.join(f'_{n} string' for n in LIST_ATTRIBUTES)}, CONDITION {inner}, _corrupt_record string"
    read = F.from_xml(xml, shape, {"columnNameOfCorruptRecord": "_corrupt_record"})
    fill = lambda x, known: [F.coalesce(x[f"_{n}"], F.lit(other)).alias(n) for n, other in known.items()]
    conditions = F.transform(F.coalesce(read["CONDITION"], F.array().cast(inner)), lambda c: F.struct(*fill(c, CONDITION_ATTRIBUTES)))
    return F.when(xml.isNotNull() & read["_corrupt_record"].isNull(), F.struct(*fill(read, LIST_ATTRIBUTES), conditions.alias("conditions")))


def criteria_xml(found: Column) -> Column:
    """What ``criteria`` reads, as XML again; null stays null."""
    marks = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\t", "&#9;"))

    def escaped(value: Column) -> Column:
        for plain, mark in marks:
            value = F.replace(value, F.lit(plain), F.lit(mark))
        return value

    attributes = lambda x, known: [part for n in known for part in (F.lit(f' {n}="'), escaped(x[n]), F.lit('"'))]
    inner = F.array_join(F.transform(found["conditions"], lambda c: F.concat(F.lit("<CONDITION"), *attributes(c, CONDITION_ATTRIBUTES), F.lit("/>"))), "")
    return F.concat(F.lit("<SmartList"), *attributes(found, LIST_ATTRIBUTES), F.lit(">"), inner, F.lit("</SmartList>"))


def unsigned_id(value: str | None) -> str | None:
    """A 32-bit id in unsigned form; what is no number stays."""
    try:
        return str(int(value) & 0xFFFFFFFF) if int(value) < 0 else value
    except (TypeError, ValueError):
        return value


def stored_condition(rule: Rule, fields: Fields) -> Column:
    """``fields`` gives str, float or tags (an array of ids) for a property. Numbers equal within 0.5; bpm rules hold 100 times."""
    found = fields.get(rule.property)
    if not found:
        return FALSE()
    column, kind = F.col(found[0]), found[1]
    if kind == "tags":
        has = F.array_contains(column, F.lit(unsigned_id(rule.left)))
        return closed({8: has, 9: ~has}.get(rule.operator, FALSE()))
    if kind == "str":
        text, needle = F.lower(column), F.lit((rule.left or "").lower())
        within, same = F.contains(text, needle), text == needle
        return closed({1: within, 2: ~within, 3: same, 8: same, 4: ~same, 9: ~same}.get(rule.operator, FALSE()))
    low, high = (_number(x, "float") if x else 0.0 for x in (rule.left, rule.right))
    if low is None or high is None:
        return FALSE()
    value = column.cast("double") * (100.0 if rule.property == "bpm" else 1.0)
    near = F.abs(value - low) < 0.5
    return closed({1: near, 3: near, 4: ~near, 5: value.between(low, high), 6: value > low, 7: value < low}.get(rule.operator, FALSE()))


def stored(both: bool, rules: Sequence[Rule], fields: Fields) -> Column:
    """All or any of the rules; none keep all rows."""
    parts = [stored_condition(x, fields) for x in rules]
    return TRUE() if not parts else all_of(parts) if both else any_of(parts)


# --- The search box. ---

FREE_TEXT = ("title", "artist", "album", "comment", "genre", "label")


def _half_up(value: Column | float) -> Column:
    return F.floor((value if isinstance(value, Column) else F.lit(value)) + 0.5)


def _parsed(text: str) -> float | None:
    found = re.match(r"\s*[+-]?(\d+\.?\d*|\.\d+)", text)
    return float(found[0]) if found else None


def _compared(value: Column, text: str, equal: Callable[[Column, float], Column], ranges: bool) -> Column:
    if text[0] in "<>":
        bound = _parsed(text[1:])
        return FALSE() if bound is None else value > bound if text[0] == ">" else value < bound
    if ranges and "-" in text:
        low, high = (_parsed(x) for x in text.split("-")[:2])
        return FALSE() if low is None or high is None else value.between(low, high)
    bound = _parsed(text)
    return FALSE() if bound is None else equal(value, bound)


def search(query: str, columns: Sequence[str], free: Sequence[str] = FREE_TEXT) -> Column:
    """Words that must all match: field:value for bpm, rating, key, genre, label and year, else free text.

    ``columns`` are those of the table; a field that it lacks matches like an empty one.
    """
    text = lambda name: F.lower(F.coalesce(F.col(name).cast("string"), F.lit(""))) if name in columns else F.lit("")
    hay = F.lower(F.concat_ws(" ", *(F.nullif(F.col(x).cast("string"), F.lit("")) for x in free if x in columns)))
    parts = []
    for token in query.lower().split():
        name, colon, value = token.partition(":")
        if colon and not value:
            continue
        number = lambda kind: F.coalesce(F.col(name).try_cast(kind), F.lit(0)) if name in columns else F.lit(0)  # noqa: B023, E731
        if colon and name == "bpm":
            parts.append(_compared(number("double"), value, lambda v, b: _half_up(v) == _half_up(b), True))
        elif colon and name == "rating":
            parts.append(_compared(number("int"), value, lambda v, b: v == int(b), False))
        elif colon and name in ("key", "genre", "label"):
            parts.append(F.contains(text(name), F.lit(value)))
        elif colon and name == "year":
            parts.append(text("release_year") == value)
        else:
            parts.append(F.contains(hay, F.lit(token)))
    return closed(all_of(parts))


def any_contains(needle: str, *columns: str) -> Column:
    """Whether one of the columns contains the text, whatever its case."""
    return any_of([closed(F.contains(F.lower(c), F.lit(needle.lower()))) for c in columns])


# --- Library filters and scopes. ---

#: Schemes of streamed tracks, and file endings.
SCHEMES = ("soundcloud:", "spotify:", "tidal:", "beatport:")
LOSSY, LOSSLESS = (".m4a", ".mp3", ".aac", ".ogg", ".opus"), (".aiff", ".aif", ".wav", ".flac", ".alac")


def is_local(path: str = "path") -> Column:
    """Not a streamed track; a track without a path counts as local."""
    return ~any_of([closed(F.startswith(F.col(path), F.lit(x))) for x in SCHEMES])


def low_quality(bitrate: str = "bitrate", threshold: int = 320) -> Column:
    value = F.col(bitrate).try_cast("int")
    return closed((value > 0) & (value < threshold))


def missing(column: str) -> Column:
    return F.col(column).isNull() | (F.col(column).cast("string") == "")


def under_path(prefix: str, path: str = "path") -> Column:
    """The path or one below it, whatever the slashes and case; no pattern characters count."""
    top = prefix.replace("\\", "/").lower().rstrip("/")
    plain = F.lower(F.replace(F.col(path), F.lit("\\"), F.lit("/")))
    return closed((plain == top) | F.startswith(plain, F.lit(top + "/")))


def scope(kind: str, value: object = None, path: str = "path", rating: str = "rating", color: str = "color_id", file_type: str = "file_type", deleted: str | None = None) -> Column:
    """A named subset of the library; rows without a path, and deleted ones, are in none. by_mytag is ``in_scope`` only."""
    zero = lambda c: F.coalesce(F.col(c).try_cast("int"), F.lit(0))
    ends = lambda kinds: any_of([F.endswith(F.lower(path), F.lit(x)) for x in kinds])
    made = {
        "all": lambda: TRUE(),
        "all_lossy": lambda: ends(LOSSY),
        "all_lossless": lambda: ends(LOSSLESS),
        "ranked": lambda: zero(rating) > 0,
        "unranked": lambda: zero(rating) == 0,
        "by_color": lambda: zero(color) == int(value),
        "uncolored": lambda: zero(color) == 0,
        "by_file_type": lambda: zero(file_type) == int(value),
    }.get(kind)
    if made is None:
        raise ValueError(f"unknown scope {kind!r}")
    alive = ~closed(F.col(deleted)) if deleted else TRUE()
    return closed((F.col(path) != "") & alive & made())


def in_scope(tracks: DataFrame, request: Mapping, tags: DataFrame | None = None, entries: DataFrame | None = None) -> DataFrame:
    """Tracks of a scope request: track_ids, playlist, all_m4a, library_subset or path. ``tags`` has (track_id, tag_id)."""
    kind = request["kind"]
    if kind == "track_ids":
        return tracks.filter(F.col("id").isin([int(x) for x in request["track_ids"]]))
    if kind == "playlist":
        own = entries.filter(F.col("pid") == request["playlist_id"]).select(F.col("track_id").alias("id"))
        return tracks.join(own, "id", "left_semi")
    if kind == "path":
        return tracks.filter(under_path(request["path"]))
    if kind == "all_m4a":
        return tracks.filter(closed(F.endswith(F.lower("path"), F.lit(".m4a"))))
    if kind == "library_subset" and request["subset_kind"] == "by_mytag":
        own = tags.filter(F.col("tag_id").cast("string") == str(request["tag_id"])).select(F.col("track_id").alias("id"))
        return tracks.filter(scope("all")).join(own, "id", "left_semi")
    if kind == "library_subset":
        return tracks.filter(scope(request["subset_kind"], request.get("color_id", request.get("file_type"))))
    raise ValueError(f"unknown scope {kind!r}")
