"""Target transforms, category codes, row arg-max, inverse error function."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: numerator and denominator coefficients, lowest power first, of
# Wichura's published AS 241 approximation of the normal quantile
# (central part, near tail, far tail)
AS241_CENTRAL = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
     4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
     2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
AS241_NEAR = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
     1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
     1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
AS241_FAR = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
     2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
     7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def _ratio(x: Column, pair) -> Column:
    def horner(coefficients):
        value = F.lit(coefficients[-1])
        for c in reversed(coefficients[:-1]):
            value = value * x + F.lit(c)
        return value

    return horner(pair[0]) / horner(pair[1])


def normal_quantile(p: Column) -> Column:
    q = p - F.lit(0.5)
    tail = F.sqrt(-F.log(F.least(p, F.lit(1.0) - p)))
    outer = F.when(tail <= 5.0, _ratio(tail - F.lit(1.6), AS241_NEAR)).otherwise(_ratio(tail - F.lit(5.0), AS241_FAR))
    central = q * _ratio(F.lit(0.180625) - q * q, AS241_CENTRAL)
    return F.when(F.abs(q) <= 0.425, central).otherwise(F.signum(q) * outer)


def erfinv(x: Column) -> Column:
    """Inverse error function on (-1, 1)."""
    return normal_quantile((x + F.lit(1.0)) / F.lit(2.0)) / F.lit(math.sqrt(2.0))


# fixed value: the Box-Cox lambda of the "norm" target transform
NORM_LAMBDA = 0.7

Transform = Callable[[Column], Column]


def target_transform(name: str, *args: float) -> tuple[Transform, Transform]:
    """(forward, inverse) by name: identity, log, log_ofs, pow, pow_ofs, norm."""
    if name == "identity":
        return (lambda y: y), (lambda y: y)
    if name == "log":
        return F.log, F.exp
    if name == "log_ofs":
        (ofs,) = args
        return (lambda y: F.log(y + ofs)), (lambda y: F.greatest(F.exp(y) - ofs, F.lit(1.0)))
    if name == "pow":
        (p,) = args
        return (lambda y: F.pow(y, F.lit(p))), (lambda y: F.pow(y, F.lit(1 / p)))
    if name == "pow_ofs":
        p, ofs = args
        return (
            lambda y: F.pow(y + ofs, F.lit(p)),
            lambda y: F.greatest(F.pow(y, F.lit(1 / p)) - ofs, F.lit(1.0)),
        )
    if name == "norm":
        k = NORM_LAMBDA
        return (
            lambda y: (F.pow(F.log1p(y), F.lit(k)) - 1) / k,
            lambda y: F.expm1(F.pow(y * k + 1, F.lit(1 / k))),
        )
    raise ValueError(f"unknown target transform {name!r}")


def prediction_transform(name: str, *args: float) -> Transform:
    """Reshaping of stacked predictions: log_ofs, pow, pow_ofs."""
    return target_transform(name, *args)[0]


def concat_cols(cols: Sequence[str]) -> Column:
    return F.concat(*cols)


def alpha_code(col: Column) -> Column:
    """Upper-case letters as a base-26 number: A is 1, Z is 26, AA is 27."""
    digits = F.transform(F.split(col, ""), lambda ch: (F.ascii(ch) - 64).cast("double"))
    return F.aggregate(digits, F.lit(0.0), lambda acc, d: acc * 26 + d)


def fixed(col: Column, places: int = 2) -> Column:
    return F.format_string(f"%.{places}f", col)


def tokens(col: Column, sep: str = ",", missing: str = "-1") -> Column:
    """Separated text to a list; null gives one token ``missing``."""
    return F.coalesce(F.split(col, sep), F.array(F.lit(missing)))


def argmax(cols: Sequence[str]) -> Column:
    """Position of the largest column, the smallest position on ties."""
    values = F.array(*cols)
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def rates(df: DataFrame, distance: str = "distance", price: str = "price", eta: str = "eta") -> DataFrame:
    """Unit price, speed, and speed per unit price; a zero divisor gives null."""
    unit = F.col(price) * 100 / F.nullif(F.col(distance), F.lit(0))
    speed = F.col(distance) / F.nullif(F.col(eta), F.lit(0))
    out = df.withColumns({"unit_price": unit, "speed": speed})
    return out.withColumn("value_rate", F.col("speed") / F.nullif(F.col("unit_price"), F.lit(0.0)))
