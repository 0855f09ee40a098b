"""Scalar functions as Spark columns: ids, literals and value domains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spark types of the eight scalar kinds.
KINDS = {
    "String": "string",
    "Int": "bigint",
    "Decimal": "decimal(38,10)",
    "Float": "double",
    "Bool": "boolean",
    "Date": "date",
    "Timestamp": "timestamp",
    "UUID": "string",
}
NUMERIC, TIMES = {"Int", "Decimal", "Float"}, {"Date", "Timestamp"}
_UUID = r"^[0-9a-fA-F]{8}-?([0-9a-fA-F]{4}-?){3}[0-9a-fA-F]{12}$"


def stable_id(kind: str, *parts: Column) -> Column:
    """``kind:part:part`` with % and : escaped in the parts."""
    escaped = [F.replace(F.replace(p, F.lit("%"), F.lit("%25")), F.lit(":"), F.lit("%3A")) for p in parts]
    return F.concat_ws(":", F.lit(kind), *escaped)


def explicit_id(kind: str, token: Column) -> Column:
    """The id of an element with an identity of its own, which outlives renames."""
    return stable_id("uid", F.lit(kind), token)


def explicit_token(kind: str, element: Column) -> Column:
    """The identity token in an id made by :func:`explicit_id`, else null."""
    prefix = f"uid:{kind}:"
    raw = F.replace(F.replace(F.substring(element, len(prefix) + 1, 1 << 20), F.lit("%3A"), F.lit(":")), F.lit("%25"), F.lit("%"))
    return F.when(F.startswith(element, F.lit(prefix)), raw)


#: The formats of names.  A slug is lower-case words with ``_`` between: a word begins at a capital that small letters follow, or at
#: one after a small letter or digit; what is no letter, digit or ``_`` is one ``_``; none is left at the ends.  A file token is the
#: letters, digits, dots, underscores and hyphens of an id (others one ``_``, none of ``._-`` left at the ends), at most 72 of them or else
#: ``artifact``, then ``__`` and the first 20 digits of its SHA-256.
WORD_STARTS = (r"(?<=.)(?=[A-Z][a-z]+)", r"(?<=[a-z0-9])(?=[A-Z])")
NO_WORD, NO_FILE, FILE_ENDS, FILE_LENGTH, FILE_DIGITS = r"[^a-zA-Z0-9_]+", r"[^A-Za-z0-9._-]+", "._-", 72, 20


def slug(name: Column) -> Column:
    """snake_case of a name."""
    for start in WORD_STARTS:
        name = F.regexp_replace(name, start, "_")
    joined = F.regexp_replace(F.regexp_replace(name, NO_WORD, "_"), "^_+|_+$", "")
    return F.lower(joined)


def file_token(value: Column, limit: int = FILE_LENGTH) -> Column:
    """A file name for any id: what can be read of it, and digits of its SHA-256."""
    cleaned = F.btrim(F.regexp_replace(value, NO_FILE, "_"), F.lit(FILE_ENDS))
    shown = F.btrim(F.left(cleaned, F.lit(limit)), F.lit(FILE_ENDS))
    digits = F.left(F.sha2(value, 256), F.lit(FILE_DIGITS))
    return F.concat(F.coalesce(F.nullif(shown, F.lit("")), F.lit("artifact")), F.lit("__"), digits)


def change_id(*parts: Column) -> Column:
    """24 hex digits that name a change or conflict by its content; nulls and order count."""
    return F.substring(F.sha2(F.to_json(F.struct(*[p.cast("string").alias(f"p{k:02}") for k, p in enumerate(parts)]), {"ignoreNullFields": "false"}), 256), 1, 24)


def placeholders(template: Column) -> Column:
    """The role names that a reading's ``{role}`` places name, in order."""
    return F.regexp_extract_all(template, F.lit(r"\{([A-Za-z_][A-Za-z0-9_]*)\}"), 1)


def normal_check(text: Column) -> Column:
    """A check's text without casts, brackets, space and case, so that catalogues can be compared."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"::[A-Za-z_ ]+(\[\])?", ""), r"[\s()]", ""))


#: Decimals that ``decimal(38,10)`` keeps, and a literal that has more: they are compared as text.
_MORE_DECIMALS = r"\.\d{10}\d*[1-9]"
_KEPT_DECIMALS = r"^\s*([+-]?\d*\.?\d{0,10})"
_DECIMAL = KINDS["Decimal"]


def _longer(value: Column) -> Column:
    """Whether a text has more decimals than are kept; folded to false for what is no text."""
    return (F.typeof(value) == F.lit("string")) & value.cast("string").rlike(_MORE_DECIMALS)


def typed(value: Column, kind: str) -> Column:
    """``value`` as its kind's Spark type; null if it is no such literal.

    A Bool is true, false, 1 or 0 in any case; 1.5 is no Int, while 2.0 is 2; a Decimal's decimals after the tenth are rounded.
    """
    if kind in ("String", "UUID"):
        text = value.cast("string")
        return F.when(text.rlike(_UUID), text) if kind == "UUID" else text
    if kind == "Int":
        number = value.try_cast(_DECIMAL)
        return F.when((number == F.floor(number)) & ~_longer(value), number.try_cast("bigint"))
    if kind == "Bool":
        said = F.lower(value.cast("string"))
        return F.when(said.isin("true", "1"), True).when(said.isin("false", "0"), False)
    return value.try_cast(KINDS[kind])


def in_range(value: Column, low: object, high: object, kind: str = "Float") -> Column:
    """Whether a literal is from ``low`` to ``high``, both included; false for what is no literal of the kind, and for NaN.

    Decimals compare exactly, also beyond the tenth: a text that rounds to a bound is cut there instead, towards zero, and what was cut
    off puts it beyond the cut.
    """
    v, least, most = typed(value, kind), *(typed(F.lit(str(x)), kind) for x in (low, high))
    ok = v.between(least, most)
    if kind == "Float":
        ok = ok & ~F.isnan(v)
    elif kind == "Decimal":
        text = value.cast("string")
        cut = F.regexp_extract(text, _KEPT_DECIMALS, 1).try_cast(_DECIMAL)
        below = F.startswith(F.trim(text), F.lit("-"))
        inside = F.when(below, (cut > least) & (cut <= most)).otherwise((cut >= least) & (cut < most))
        ok = F.when(_longer(value) & ~text.rlike("[eE]"), inside).otherwise(ok)
    return F.coalesce(ok, F.lit(False))


def one_of(value: Column, allowed: Sequence[object], kind: str = "String") -> Column:
    """Whether a literal is among ``allowed``; numbers and Bools compare by value and others by their text."""
    if kind in NUMERIC:
        number = value.try_cast(_DECIMAL)
        same = number.isin(*[F.lit(str(a)).cast(_DECIMAL) for a in allowed]) & ~_longer(value)
    elif kind == "Bool":
        same = typed(value, kind).isin(*allowed)
    else:
        same = value.cast("string").isin(*[str(a) for a in allowed])
    return F.coalesce(same, F.lit(False))


def aliased(name: Column, aliases: dict[str, str]) -> Column:
    """A name as ``aliases`` has it, or as it is."""
    pairs = [F.lit(x) for pair in aliases.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), name), name) if pairs else name


def clamped(value: Column, low: Column, high: Column) -> Column:
    """The value, or the bound that it is beyond; null bounds are none."""
    return F.when(value < low, low).when(value > high, high).otherwise(value)


def part_way(low: Column, high: Column, share: float) -> Column:
    """The number ``share`` of the way from ``low`` to ``high``: 0.25 and 0.75 are well within a range."""
    return low + (high - low) * F.lit(share)
