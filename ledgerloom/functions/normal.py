"""The normal distribution as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of Wichura's algorithm AS 241 (1988), lowest power first.
CENTRE_NUM = (
    3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
    4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3,
)
CENTRE_DEN = (
    1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
    2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3,
)
TAIL_NUM = (
    1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
    1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4,
)
TAIL_DEN = (
    1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
    1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9,
)
FAR_NUM = (
    6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
    2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7,
)
FAR_DEN = (
    1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
    7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15,
)


def polynomial(coefficients: tuple[float, ...], x: Column) -> Column:
    result = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        result = result * x + F.lit(c)
    return result


def normal_quantile(p: Column) -> Column:
    """The standard normal value below which the share ``p`` lies (0 < p < 1)."""
    q = p - 0.5
    centre = F.lit(0.180625) - q * q
    tail = F.sqrt(-F.log(F.least(p, 1.0 - p)))
    near, far = tail - 1.6, tail - 5.0
    tail_value = F.when(tail <= 5.0, polynomial(TAIL_NUM, near) / polynomial(TAIL_DEN, near)).otherwise(
        polynomial(FAR_NUM, far) / polynomial(FAR_DEN, far)
    )
    return F.when(
        F.abs(q) <= 0.425, q * polynomial(CENTRE_NUM, centre) / polynomial(CENTRE_DEN, centre)
    ).otherwise(F.signum(q) * tail_value)


def normal_density(x: Column, mean: Column, sd: Column) -> Column:
    z = (x - mean) / sd
    return F.exp(-z * z / 2.0) / (sd * math.sqrt(2 * math.pi))


TAIL_STEPS = 1200
TAIL_WIDTH = 12.0


def normal_upper_tail(z: Column) -> Column:
    """The share of the standard normal distribution above ``z``.

    For z >= 0 it is the density at z times the integral of exp(-z u - u*u/2) over u > 0, which
    Simpson's rule gives with a small relative error however far out z is.
    """
    side = F.abs(z)
    step = TAIL_WIDTH / TAIL_STEPS
    places = F.sequence(F.lit(0), F.lit(TAIL_STEPS))

    def weighed(i: Column) -> Column:
        u = i * step
        weight = F.when((i == 0) | (i == TAIL_STEPS), 1.0).otherwise(2.0 + 2.0 * (i % 2))
        return weight * F.exp(-side * u - u * u / 2.0)

    integral = F.aggregate(places, F.lit(0.0), lambda a, i: a + weighed(i)) * (step / 3)
    tail = F.exp(-side * side / 2.0) / math.sqrt(2 * math.pi) * integral
    return F.when(z >= 0, tail).otherwise(1.0 - tail)
