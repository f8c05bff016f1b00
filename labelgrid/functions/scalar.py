"""Scalar functions as column expressions; all stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def xlogx(x: Column) -> Column:
    """x log2 x, and 0 at 0."""
    return F.when(x == 0, 0.0).otherwise(x * F.log2(x))


# --- labels and numbers


def rgb_pack(label: Column | str) -> tuple[Column, Column, Column]:
    """Red, green and blue of a 24-bit label, each modulo 256."""
    s = col(label).cast("long")
    return tuple(F.pmod(F.shiftright(s, n), F.lit(256)).cast("int") for n in (16, 8, 0))


def rgb_unpack(r: Column | str, g: Column | str, b: Column | str) -> Column:
    return (col(r).cast("long") * 65536 + col(g).cast("long") * 256 + col(b).cast("long")).cast("long")


def unpack_image(df: DataFrame, key: str, r: str = "r", g: str = "g", b: str = "b") -> DataFrame:
    """Labels of colour images; an image that is grey throughout has its grey value as label."""
    grey = df.groupBy(key).agg(F.bool_and((F.col(r) == F.col(g)) & (F.col(g) == F.col(b))).alias("_grey"))
    return df.join(grey, key).withColumn("label", F.when(F.col("_grey"), F.col(r).cast("long")).otherwise(rgb_unpack(r, g, b))).drop("_grey")


def dim_pack(parts: list[Column | str], factor: int) -> Column:
    """Several small numbers as digits of one in base ``factor``."""
    out = F.lit(0).cast("long")
    for p in parts:
        out = out * factor + col(p).cast("long")
    return out


def floor_div(a: Column | str, b: int) -> Column:
    """Floor of a quotient of whole numbers, exact for all longs (``/`` would be in double precision)."""
    a, b = col(a).cast("long"), F.lit(b).cast("long")
    return F.call_function("div", a - F.pmod(a, b), b)


def dim_unpack(value: Column | str, factor: int, n: int = 3) -> list[Column]:
    return [F.pmod(floor_div(value, factor**k), F.lit(factor)).cast("long") for k in range(n - 1, -1, -1)]


def array_text(values: Column | str) -> Column:
    """Numbers, cut to whole ones, joined by commas."""
    return F.concat_ws(",", F.transform(col(values), lambda x: x.cast("long").cast("string")))


def array_rows(values: Column | str, n: int) -> Column:
    """An array as lines of ``n`` numbers each."""
    v = col(values)
    first = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(v) / n) - 1, F.lit(0)).cast("int"))
    return F.transform(first, lambda i: array_text(F.slice(v, i * n + 1, F.lit(n))))


def first_occurrences(values: Column | str) -> Column:
    return F.array_distinct(col(values))


def spaced_colors(spark, n: int) -> DataFrame:
    """Evenly spaced 24-bit colours: ``i, r, g, b``; as many as fit below 255 cubed, which may be n + 1."""
    top = 255**3
    value = F.col("id") * F.lit(top // n)
    r, g, b = rgb_pack(value)
    return spark.range(-(-top // (top // n))).select(F.col("id").alias("i"), r.alias("r"), g.alias("g"), b.alias("b"))


def ceil_div(a: Column | str, b: int) -> Column:
    """Ceiling of a quotient of whole numbers."""
    return -floor_div(-col(a).cast("long"), b)


def midpoint(a: Column | str, b: Column | str) -> Column:
    """Floor of the mean of two whole numbers; their sum may be beyond a long."""
    a, b = col(a).cast("long"), col(b).cast("long")
    return a.bitwiseAND(b) + F.shiftright(a.bitwiseXOR(b), 1)


def square_chunk(target: Column | str, least: Column | str) -> Column:
    """Side of a square storage chunk: a power of two for the target, but at most ``least``; 0 for 0."""
    side = F.coalesce(F.pow(F.lit(2.0), F.ceil(F.log2(F.sqrt(col(target).cast("double"))))), F.lit(0.0))
    return F.least(col(least).cast("double"), side)


# --- intensities


def clip(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low) if not isinstance(low, Column) else low), F.lit(high) if not isinstance(high, Column) else high)


def quantize(x: Column | str) -> Column:
    """A share as one byte: floor(255 x + 0.5) of x clipped to 0..1, in single precision."""
    c = clip(col(x).cast("float"), F.lit(0.0).cast("float"), F.lit(1.0).cast("float"))
    return F.floor(c * F.lit(255.0).cast("float") + F.lit(0.5).cast("float")).cast("int")


def adjust(df: DataFrame, value: str, low: float | None = None, high: float | None = None, percent: tuple[float, float] = (1, 99), scale: str | None = None) -> DataFrame:
    """Clips to absolute bounds, or to exact percentiles (linear between ranks); ``scale``: "unit" or "byte" (cut down)."""
    if low is None or high is None:
        p = df.agg(F.percentile(value, F.array(*[F.lit(x / 100) for x in percent])).alias("_p"))
        df = df.crossJoin(F.broadcast(p)).withColumns({"_low": F.col("_p")[0], "_high": F.col("_p")[1]}).drop("_p")
    else:
        df = df.withColumns({"_low": F.lit(float(low)), "_high": F.lit(float(high))})
    v = F.least(F.greatest(F.col(value).cast("double"), F.col("_low")), F.col("_high"))
    if scale:
        v = F.try_divide(v - F.col("_low"), F.col("_high") - F.col("_low"))
    if scale == "byte":
        v = F.floor(v * 255).cast("int")
    return df.withColumn("adjusted", v).drop("_low", "_high")


def divide_by_marginal(df: DataFrame, value: str, by: str, name: str) -> DataFrame:
    """``df`` with a column ``name``: a value over its row's or column's sum; zeros stay zero. The sums are an aggregation, which
    combines before its shuffle, and are joined back, so that no task holds all values of one row."""
    sums = df.groupBy(by).agg(F.sum(value).alias("_sum"))
    share = F.coalesce(F.try_divide(F.col(value), F.col("_sum")), F.lit(0.0))
    return df.join(sums, by).select(*[c for c in df.columns if c != name], share.alias(name))


def gaussian_attention(x: Column | str, c1: float, c2: float, v1: float, v2: float) -> Column:
    """Rounded attention of a row index: both terms use the row, as the formula has it."""
    a = col(x).cast("double")
    return F.rint(F.exp(-((a - c1) * (a - c1) / (360 * v1) + (a - c2) * (a - c2) / (640 * v2))))


def hsv(r: Column | str, g: Column | str, b: Column | str) -> tuple[Column, Column, Column]:
    """Hue 0-179, saturation and value 0-255 of 8-bit colours, rounded."""
    r, g, b = (col(c).cast("double") for c in (r, g, b))
    v, low = F.greatest(r, g, b), F.least(r, g, b)
    d = v - low
    h = F.when(d == 0, 0.0).when(v == r, 60 * F.try_divide(g - b, d)).when(v == g, 120 + 60 * F.try_divide(b - r, d)).otherwise(240 + 60 * F.try_divide(r - g, d))
    h = F.when(h < 0, h + 360).otherwise(h)
    s = F.when(v == 0, 0.0).otherwise(255 * F.try_divide(d, v))
    return F.pmod(F.floor(h / 2 + 0.5), F.lit(180)).cast("int"), F.floor(s + 0.5).cast("int"), v.cast("int")


def in_range(channels: tuple, low: list[int], high: list[int]) -> Column:
    """Whether all channels lie within inclusive bounds."""
    out = F.lit(True)
    for c, a, b in zip(channels, low, high):
        out = out & c.between(a, b)
    return out


# --- text


def tile_name(pattern: str, row: Column | str, column: Column | str) -> Column:
    """A tile's name from a printf pattern, or one with {row} and {column}, or as it is."""
    if "%" in pattern:
        return F.format_string(pattern, col(row), col(column))
    if "{" in pattern:
        out = F.lit(pattern)
        for name, value in (("row", row), ("column", column)):
            out = F.replace(out, F.lit("{" + name + "}"), col(value).cast("string"))
        return out
    return F.lit(pattern)


def url_param(url: Column | str, name: str) -> Column:
    """Value of a query parameter, or an empty text."""
    return F.regexp_extract(col(url), f"[?&]{name}=([^&#]*)", 1)


def has_keyword(name: Column | str, words: list[str]) -> Column:
    """Whether any word occurs in a name, whatever its case."""
    low = F.lower(col(name))
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w.lower())
    return out


def chunk_start(name: Column | str, pattern: str = r"z(\d+)_y(\d+)_x(\d+)") -> Column:
    """Place of a chunk from its file name."""
    return F.struct(*[F.regexp_extract(col(name), pattern, i + 1).cast("int").alias(f"{a}0") for i, a in enumerate("zyx")])


def tuple_numbers(text: Column | str) -> Column:
    """A literal like ``(1, 2, 3)`` as an array."""
    return F.from_json(F.translate(col(text), "()", "[]"), "array<long>")
