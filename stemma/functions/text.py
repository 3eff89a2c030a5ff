"""Scalar functions: slugs, identifiers, fingerprints, constraints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Crockford's base-32 alphabet, and the prefixes of identifiers by entity type.
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
PREFIXES = {"organ": "organ", "repo": "repo", "module": "mod", "document": "doc", "session": "sess", "variable": "var", "metric": "met"}


def slugify(name: Column) -> Column:
    """Lower case; runs of anything but a-z, 0-9 and hyphens become a hyphen; three or more hyphens become two; none at the ends."""
    joined = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9-]+", "-"), "-{3,}", "--")
    return F.btrim(joined, F.lit("-"))


def base32(value: Column, length: int) -> Column:
    """Fixed-width Crockford text of a non-negative bigint."""
    digit = lambda i: F.substring(F.lit(CROCKFORD), (F.shiftright(value, 5 * i).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1))
    return F.concat(*[digit(i) for i in reversed(range(length))])


def ulid(millis: Column, key: Column) -> Column:
    """Ten characters of time and sixteen of the key's SHA-256: sorts by time, and a retried task gives the same."""
    digest = F.sha2(key.cast("binary"), 256)
    half = lambda a: F.conv(F.substring(digest, a, 10), 16, 10).cast("bigint")
    return F.concat(base32(millis, 10), base32(half(1), 8), base32(half(11), 8))


def entity_uid(entity_type: Column, millis: Column, key: Column) -> Column:
    prefix = F.create_map(*[F.lit(x) for kv in PREFIXES.items() for x in kv])[entity_type]
    return F.concat(F.lit("ent_"), F.coalesce(prefix, entity_type), F.lit("_"), ulid(millis, key))


def _quoted(text: Column) -> Column:
    return F.when(text.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), F.regexp_replace(text, r'(["\\])', r"\\$1"), F.lit('"')))


def fingerprint(child_count: Column, depth: Column, incoming: Column, outgoing: Column, parent_id: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the signature as JSON with sorted keys; the entity's own id is left out."""
    parts = (("children", child_count), ("depth", depth), ("incoming", incoming), ("outgoing", outgoing), ("parent", None))
    text = [F.concat(F.lit(f'"{k}": '), _quoted(parent_id) if c is None else c.cast("string")) for k, c in parts]
    return F.substring(F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *text), F.lit("}")).cast("binary"), 256), 1, 16)


def anomaly_confidence(value: Column, low: Column, high: Column) -> Column:
    """Null within [low, high]; outside, the distance from the middle over the width (1 at least), 1 at most."""
    far = F.least(F.lit(1.0), F.abs(value - (low + high) / 2) / F.greatest(high - low, F.lit(1.0)))
    return F.when((value < low) | (value > high), far)


def violates(value: Column, allowed: list[str] | None = None, least: float | None = None, most: float | None = None, pattern: str | None = None, required: bool = False) -> Column:
    """The first constraint that the text value breaks, or null; null breaks ``required`` only, text that isn't a number no bound."""
    number = value.try_cast("double")
    rules = [(F.lit(required) & value.isNull(), "required")]
    if allowed:
        rules.append((value.isNotNull() & ~value.isin(allowed), "allowed_values"))
    if least is not None:
        rules.append((F.coalesce(number < least, F.lit(False)), "min_value"))
    if most is not None:
        rules.append((F.coalesce(number > most, F.lit(False)), "max_value"))
    if pattern:
        rules.append((value.isNotNull() & ~value.rlike(f"^(?:{pattern})"), "pattern"))
    return F.coalesce(*[F.when(c, F.lit(n)) for c, n in rules])
