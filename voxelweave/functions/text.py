"""Names, labels, colours and hashes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Named colours (red, green, blue in 0..1), in order of preference.
PALETTE = {
    "red": (0.60, 0.10, 0.10), "orange": (0.85, 0.45, 0.10), "yellow": (0.85, 0.75, 0.10), "green": (0.15, 0.50, 0.20), "blue": (0.10, 0.25, 0.60),
    "purple": (0.40, 0.15, 0.50), "brown": (0.40, 0.27, 0.16), "white": (0.85, 0.85, 0.85), "gray": (0.50, 0.50, 0.50), "black": (0.12, 0.12, 0.12),
}
# Least confidence of a tier and its colour.
TIERS = ((0.6, "red"), (0.3, "orange"))
# Words that count as one type when answers are graded.
SYNONYM_SETS = [
    {"tv", "television", "display", "monitor", "screen"}, {"chair", "office chair", "armchair"}, {"mobile robot", "agv", "robot"},
    {"mobile manipulator", "robot arm", "robotic arm", "robot"}, {"control panel", "panel", "control cabinet"}, {"cabinet", "locker"},
    {"junction box", "electrical box", "distribution box"},
]


def slug(c: Column, default: str = "object") -> Column:
    """Runs of anything but letters and digits become one underscore."""
    s = F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(s, "^_+|_+$", ""), F.lit("")), F.lit(default))


def norm_name(c: Column) -> Column:
    return F.replace(F.lower(F.trim(c)), F.lit(" "), F.lit("_"))


def canonical(c: Column, synonyms: dict[str, str]) -> Column:
    key = F.lower(F.trim(c))
    if not synonyms:
        return key
    table = F.create_map(*(F.lit(x) for kv in sorted(synonyms.items()) for x in kv))
    return F.coalesce(table[key], key)


def type_match(a: Column, b: Column, groups: list[set[str]]) -> Column:
    """Equal, or members of one synonym group (groups may overlap)."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    out = x == y
    for g in groups:
        out = out | (x.isin(*sorted(g)) & y.isin(*sorted(g)))
    return out


def padded_name(kind: Column, number: Column, width: int = 3) -> Column:
    """kind_007; longer numbers are not cut."""
    text = number.cast("string")
    return F.concat(kind, F.lit("_"), F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text))


def identifier(c: Column) -> Column:
    """A scene identifier: letters, digits, underscores, no leading digit."""
    s = F.regexp_replace(c, "[^A-Za-z0-9_]", "_")
    return F.when(s.rlike("^[0-9]") | (s == ""), F.concat(F.lit("_"), s)).otherwise(s)


def quote(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def nearest_color(r: Column, g: Column, b: Column) -> Column:
    """Name of the nearest colour of the palette; values above 1.5 are of 255."""
    k = F.when(F.greatest(r, g, b) > 1.5, F.lit(255.0)).otherwise(F.lit(1.0))
    r, g, b = r / k, g / k, b / k

    def off(c, v):
        d = c - F.lit(v)
        return d * d

    return F.array_min(F.array(*(F.struct((off(r, pr) + off(g, pg) + off(b, pb)).alias("d"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, (n, (pr, pg, pb)) in enumerate(PALETTE.items()))))["name"]


def tier_color(confidence: Column) -> Column:
    out = None
    for least, name in TIERS:
        out = F.when(confidence >= least, name) if out is None else out.when(confidence >= least, name)
    return out.otherwise("yellow")


def anchor_id(map_id: Column, *values: Column, q: float = 0.25) -> Column:
    """Identity of an object by its quantised pose and extents: a prefix, the
    map and ten digits of the SHA-1 of the tuple's text."""
    parts = [F.floor(v / F.lit(q)).cast("long").cast("string") for v in values]
    quoted = F.concat(F.lit("'"), map_id, F.lit("'"))
    key = F.concat(F.lit("("), F.concat_ws(", ", quoted, *parts), F.lit(")"))
    return F.concat(F.lit("obj-"), map_id, F.lit("-"), F.substring(F.sha1(key.cast("binary")), 1, 10))


def spatial_hash(x: Column, y: Column, z: Column, unit: float = 1e-4) -> Column:
    """Exclusive or of scaled 0.1 mm coordinates."""
    i, j, k = (F.floor(v / F.lit(unit) + 0.5).cast("long") for v in (x, y, z))
    return (i * F.lit(73856093)).bitwiseXOR(j * F.lit(19349663)).bitwiseXOR(k * F.lit(83492791))


def gate(status: Column, symbolic_verified: Column) -> Column:
    """Verification status as the graph stores it; records from before there
    were statuses count as verified by their flag."""
    known = status.isin("verified", "verified_escalated", "verified_majority", "verified_owner", "verified_recovery")
    return F.when(known, status).when(status.isNull() & F.coalesce(symbolic_verified, F.lit(False)), F.lit("verified")).otherwise(F.lit("unverified"))


def call_cost(model: Column, tokens_in: Column, tokens_out: Column, tokens_cached: Column, prices: dict[str, tuple[float, float, float]], default: tuple[float, float, float]) -> Column:
    """Price of a call: tokens per million times the model's three prices."""

    def price(i: int) -> Column:
        out = F.lit(float(default[i]))
        for name, p in sorted(prices.items(), reverse=True):
            out = F.when(model == name, F.lit(float(p[i]))).otherwise(out)
        return out

    return (tokens_in * price(0) + tokens_out * price(1) + tokens_cached * price(2)) / F.lit(1e6)


# The label palette's step of hue, saturation and value.
HUE_STEP, SATURATION, VALUE = 0.6180339887, 0.65, 0.95


def label_color(label: Column, classes: int) -> Column:
    """{r, g, b} of a label, labels outside of 0..classes-1 counting as the
    nearest of them: hues a golden ratio apart."""
    k = F.least(F.greatest(label, F.lit(0)), F.lit(classes - 1))
    h = F.pmod(k * F.lit(HUE_STEP), F.lit(1.0)) * 6
    i = F.floor(h)
    f, v = h - i, F.lit(VALUE)
    p, q, t = v * (1 - F.lit(SATURATION)), v * (1 - f * SATURATION), v * (1 - (1 - f) * SATURATION)
    sector = [(v, t, p), (q, v, p), (p, v, t), (p, q, v), (t, p, v), (v, p, q)]
    out = None
    for n, rgb in enumerate(sector):
        one = F.struct(*(c.alias(a) for c, a in zip(rgb, "rgb")))
        out = F.when(i == n, one) if out is None else out.when(i == n, one)
    return out
