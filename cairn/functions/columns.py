"""Column functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def template(source: SparkSession | DataFrame) -> tuple[DataFrame, list[str]]:
    """The rows that a fixed pattern (rays, patches, cells) is made for, and what names them: one row of a session, or each object of a table."""
    if isinstance(source, DataFrame):
        return source, ["object_id"]
    return source.range(1), []


def number(value: float | Column) -> Column:
    """A number that is the same for all rows, or the rows' own."""
    return value if isinstance(value, Column) else F.lit(float(value))


def hash_bits(seed: str, *cols: Column) -> Column:
    """60 pseudo-random bits of ``seed|col|col...`` as a bigint, the same in any engine with SHA-256."""
    digest = F.sha2(F.concat_ws("|", F.lit(seed), *[c.cast("string") for c in cols]), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def uniform(seed: str, *cols: Column) -> Column:
    """A reproducible uniform number in [0, 1)."""
    return hash_bits(seed, *cols) / F.lit(float(1 << 60))


def rarely(p: float, seed: str, *cols: Column) -> Column:
    """``uniform(seed, *cols) < p``, decided on the digest itself, without making numbers of its digits."""
    low, high = 0, 1 << 60  # the least bits whose quotient, rounded to a double, isn't below p
    while low < high:
        at = (low + high) // 2
        low, high = (at + 1, high) if float(at) / float(1 << 60) < p else (low, at)
    digest = F.sha2(F.concat_ws("|", F.lit(seed), *[c.cast("string") for c in cols]), 256)
    return digest < F.lit(f"{low:015x}") if low < 1 << 60 else F.lit(True)


def padded_id(number: Column) -> Column:
    """Ids of at least four digits; longer ones aren't cut."""
    return F.format_string("%04d", number)


def is_power_of_two(n: Column) -> Column:
    return (n > 0) & (F.bit_count(n) == 1)


def level_sizes(base: int, least: int) -> list[int]:
    """Block sizes of the levels, ``base`` first, halved down to ``least``."""
    for n in (base, least):
        if n < 1 or n & (n - 1):
            raise ValueError(f"{n} is not a power of two")
    if least > base:
        raise ValueError("the least size exceeds the base size")
    return [base >> n for n in range((base // least).bit_length())]


# Normalisation constants of real spherical harmonics up to order 2.
SH_C0, SH_C1, SH_C2_0, SH_C2_1, SH_C2_2 = 0.282094791773878, 0.488602511902920, 1.092548430592079, 0.315391565252520, 0.546274215296040


def sh_basis(x: Column, y: Column, z: Column, order: int = 2) -> list[Column]:
    """Real spherical harmonics of a unit vector, by degree, then m from -degree up.

    Orders 3 and 4 use the orthonormal constants.
    """
    if not 0 <= order <= 4:
        raise ValueError("orders 0 to 4 are supported")
    out = [F.lit(SH_C0), SH_C1 * y, SH_C1 * z, SH_C1 * x]
    out += [SH_C2_0 * x * y, SH_C2_0 * y * z, SH_C2_1 * (3.0 * z * z - 1.0), SH_C2_0 * x * z, SH_C2_2 * (x * x - y * y)]
    xx, yy, zz = x * x, y * y, z * z
    # square roots of (35, 105, 21, 7) / pi and (315, 45, 9) / pi with the usual divisors
    a, b, c, d = 0.590043589926644, 2.890611442640554, 0.457045799464466, 0.373176332590115
    out += [a * y * (3.0 * xx - yy), b * x * y * z, c * y * (5.0 * zz - 1.0), d * z * (5.0 * zz - 3.0), c * x * (5.0 * zz - 1.0), b / 2 * z * (xx - yy), a * x * (xx - 3.0 * yy)]
    e, f, g, h, i = 2.503342941796705, 1.770130769779930, 0.946174695757560, 0.669046543557289, 0.105785546915204
    out += [e * x * y * (xx - yy), f * y * z * (3.0 * xx - yy), g * x * y * (7.0 * zz - 1.0), h * y * z * (7.0 * zz - 3.0), i * (35.0 * zz * zz - 30.0 * zz + 3.0)]
    out += [h * x * z * (7.0 * zz - 3.0), g / 2 * (xx - yy) * (7.0 * zz - 1.0), f * x * z * (xx - 3.0 * yy), e / 4 * (xx * (xx - 3.0 * yy) - yy * (3.0 * xx - yy))]
    return out[: (order + 1) ** 2]


def sh_order(coefficients: int) -> int:
    root = int(coefficients**0.5 + 0.5)
    if root * root != coefficients or root < 1:
        raise ValueError(f"{coefficients} is not a square")
    return root - 1


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded, with a plain zero instead of a negative one."""
    return F.round(c, digits) + F.lit(0.0)
