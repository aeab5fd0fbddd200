"""Element-wise functions as Column expressions with array-library semantics: IEEE results where SQL gives nulls or errors,
NaN that spreads, remainders with the divisor's sign, ties to even. All stay in the JVM. Nulls stay null.

Correct with spark.sql.ansi.enabled on and off."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

def _nan() -> Column:
    return F.lit(float("nan"))


def _inf() -> Column:
    return F.lit(float("inf"))


def _d(x: Column | float) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("double")


def _any_nan(*xs: Column) -> Column:
    out = F.isnan(xs[0])
    for x in xs[1:]:
        out = out | F.isnan(x)
    return out


def _within(x: Column, ok: Column, inside: Column, edge: Column | None = None, at: float | None = None) -> Column:
    """inside where ok, edge where x is `at`, else NaN; null for null."""
    out = F.when(x.isNull(), None).when(F.isnan(x), _nan())
    if edge is not None:
        out = out.when(x == at, edge)
    return out.when(ok, inside).otherwise(_nan())


# Arithmetic


def divide(x, y) -> Column:
    """x / y; by a signed zero it is x times that zero's signed infinity, so NaN for 0 / 0."""
    x, y = _d(x), _d(y)
    return F.when(y == 0, x * F.pow(y, F.lit(-1.0))).otherwise(x / F.when(y == 0, 1.0).otherwise(y))


def negative_zero(x: Column) -> Column:
    """Whether x is -0.0. Its power of -1 tells the zeros apart, as comparison doesn't."""
    return (x == 0) & (F.pow(x, F.lit(-1.0)) < 0)


def signbit(x) -> Column:
    x = _d(x)
    return ((x < 0) & ~F.isnan(x)) | negative_zero(x)


def floor_double(x: Column) -> Column:
    """floor that keeps doubles beyond 2**52 and non-finite values as they are."""
    x = _d(x)
    return F.when(F.isnan(x) | (F.abs(x) >= 2.0**52), x).otherwise(F.floor(F.when(F.isnan(x) | (F.abs(x) >= 2.0**52), 0.0).otherwise(x)).cast("double"))


def ceil_double(x) -> Column:
    return -floor_double(-_d(x))


def trunc(x) -> Column:
    x = _d(x)
    return F.when(x >= 0, floor_double(x)).otherwise(ceil_double(x))


def fmod(x, y) -> Column:
    """Remainder with the sign of x."""
    x, y = _d(x), _d(y)
    return F.when(y == 0, x * _nan()).otherwise(x % F.when(y == 0, 1.0).otherwise(y))


def mod(x, y) -> Column:
    """Remainder with the sign of y."""
    y = _d(y)
    r = fmod(x, y)
    return r + F.when((r != 0) & ((r < 0) != (y < 0)), y).otherwise(0.0)


def floor_divide(x, y) -> Column:
    x, y = _d(x), _d(y)
    finite = F.when((y == 0) | (F.abs(y) == _inf()), 1.0).otherwise(y)
    far = F.when(F.abs(x) == _inf(), _nan()).when((x == 0) | ((x < 0) == (y < 0)), x * 0.0).otherwise(x * 0.0 - 1.0)
    return F.when(y == 0, divide(x, y)).when(F.abs(y) == _inf(), far).otherwise(F.rint((x - mod(x, finite)) / finite))


def power(x, y) -> Column:
    x, y = _d(x), _d(y)
    return F.when((x == 1.0) & y.isNotNull(), F.lit(1.0)).otherwise(F.pow(x, y))


def reciprocal(x) -> Column:
    return divide(F.lit(1.0), x)


def maximum(x, y) -> Column:
    x, y = _d(x), _d(y)
    return F.when(x.isNull() | y.isNull(), None).when(_any_nan(x, y), _nan()).otherwise(F.greatest(x, y))


def minimum(x, y) -> Column:
    x, y = _d(x), _d(y)
    return F.when(x.isNull() | y.isNull(), None).when(_any_nan(x, y), _nan()).otherwise(F.least(x, y))


def fmax(x, y) -> Column:
    x, y = _d(x), _d(y)
    return F.when(x.isNull() | y.isNull(), None).when(F.isnan(x), y).when(F.isnan(y), x).otherwise(F.greatest(x, y))


def fmin(x, y) -> Column:
    x, y = _d(x), _d(y)
    return F.when(x.isNull() | y.isNull(), None).otherwise(F.least(x, y))  # NaN is the largest in SQL


def clip(x, low=None, high=None) -> Column:
    x = _d(x)
    if low is not None:
        x = maximum(x, low)
    return x if high is None else minimum(x, high)


def sign(x) -> Column:
    x = _d(x)
    return F.when(F.isnan(x), _nan()).otherwise(F.signum(x))


def heaviside(x, h0) -> Column:
    x = _d(x)
    return F.when(F.isnan(x), _nan()).when(x < 0, 0.0).when(x == 0, _d(h0)).when(x > 0, 1.0)


def copysign(x, y) -> Column:
    return F.when(signbit(y), -F.abs(_d(x))).otherwise(F.abs(_d(x)))


def ldexp(x, n) -> Column:
    return _d(x) * F.pow(F.lit(2.0), _d(n))


def frexp(x) -> Column:
    """Struct of mantissa in [0.5, 1) and exponent."""
    x = _d(x)
    odd = F.isnan(x) | (F.abs(x) == _inf()) | (x == 0)
    guess = F.floor(F.log2(F.abs(F.when(odd, 1.0).otherwise(x)))).cast("int") + 1
    m = x / F.pow(F.lit(2.0), guess.cast("double"))
    up, down = F.abs(m) >= 1, F.abs(m) < 0.5
    e = F.when(up, guess + 1).when(down, guess - 1).otherwise(guess)
    return F.struct(F.when(odd, x).when(up, m / 2).when(down, m * 2).otherwise(m).alias("mantissa"), F.when(odd, 0).otherwise(e).alias("exponent"))


def modf(x) -> Column:
    """Struct of fractional and whole part, both with x's sign."""
    x = _d(x)
    whole = trunc(x)
    return F.struct(F.when(F.abs(x) == _inf(), F.lit(0.0)).otherwise(x - whole).alias("fraction"), whole.alias("whole"))


def divmod_(x, y) -> Column:
    return F.struct(floor_divide(x, y).alias("quotient"), mod(x, y).alias("remainder"))


def gcd(x: Column, y: Column) -> Column:
    """Greatest common divisor of longs: Euclid's steps, at most 92 of them for 64 bits."""
    start = F.struct(F.abs(x.cast("long")).alias("a"), F.abs(y.cast("long")).alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] == 0, 1).otherwise(s["b"])).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step)["a"]


def lcm(x: Column, y: Column) -> Column:
    g = gcd(x, y)
    return F.when(g == 0, F.lit(0).cast("long")).otherwise((F.abs(x.cast("long")) / F.when(g == 0, 1).otherwise(g)).cast("long") * F.abs(y.cast("long")))


# Exponentials and logarithms


def _log(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    def log(x) -> Column:
        x = _d(x)
        return _within(x, x > 0, f(F.when(x > 0, x).otherwise(1.0)), -_inf(), 0.0)

    return log


log, log2, log10 = _log(F.log), _log(F.log2), _log(F.log10)


def log1p(x) -> Column:
    x = _d(x)
    return _within(x, x > -1, F.log1p(F.when(x > -1, x).otherwise(0.0)), -_inf(), -1.0)


def exp2(x) -> Column:
    return F.pow(F.lit(2.0), _d(x))


def logaddexp(x, y) -> Column:
    x, y = _d(x), _d(y)
    top = F.greatest(x, y)
    return F.when(_any_nan(x, y), _nan()).when(F.abs(top) == _inf(), top).otherwise(top + F.log1p(F.exp(-F.abs(x - y))))


def logaddexp2(x, y) -> Column:
    return logaddexp(_d(x) * math.log(2), _d(y) * math.log(2)) / math.log(2)


# Trigonometry


def arcsin(x) -> Column:
    return F.asin(_d(x))


def arctan2(y, x) -> Column:
    """With signed zeros told apart: arctan2(0, -0.0) is pi."""
    y, x = _d(y), _d(x)
    flat = F.when((y == 0) & ((x < 0) | negative_zero(x)), copysign(F.lit(math.pi), y)).when((y == 0) & ~F.isnan(x), copysign(F.lit(0.0), y))
    return F.when(_any_nan(x, y), _nan()).when(y == 0, flat).otherwise(F.atan2(y, x))


def arcsinh(x) -> Column:
    a = F.abs(_d(x))
    near = F.when(a < 1e8, a).otherwise(0.0)
    return copysign(F.when(a < 1e8, F.log1p(near + near * near / (1 + F.sqrt(1 + near * near)))).otherwise(F.log(a) + math.log(2)), x)


def arccosh(x) -> Column:
    x = _d(x)
    return _within(x, x >= 1, F.acosh(F.when(x >= 1, x).otherwise(1.0)))


def arctanh(x) -> Column:
    x = _d(x)
    return F.when(x == 1, _inf()).when(x == -1, -_inf()).otherwise(_within(x, F.abs(x) < 1, F.log1p(2 * F.when(F.abs(x) < 1, x).otherwise(0.0) / (1 - F.when(F.abs(x) < 1, x).otherwise(0.0))) / 2))


def sqrt(x) -> Column:
    x = _d(x)
    return _within(x, x >= 0, F.sqrt(F.when(x >= 0, x).otherwise(0.0)))


def sinc(x) -> Column:
    y = _d(x) * math.pi
    return F.when(y == 0, 1.0).otherwise(divide(F.sin(y), y))


# Rounding


def rint(x) -> Column:
    """To the nearest whole number, ties to even."""
    return F.rint(_d(x))


def round_even(x, decimals: int = 0) -> Column:
    scale = 10.0 ** abs(decimals)
    return F.rint(_d(x) * scale) / scale if decimals >= 0 else F.rint(_d(x) / scale) * scale


def round_away(x, decimals: int = 0) -> Column:
    """To the nearest multiple of a power of ten, ties of the scaled double away from zero: what SQL engines give that scale,
    round and scale back. (Spark's own round goes by the double's decimal digits, so 33.4334375 isn't the same to both.)
    x stands here many times: a costly one is better made a column of its own first."""
    x, scale = _d(x), 10.0**decimals
    y = x * scale
    whole = F.rint(y)
    return F.when(F.abs(y - whole) == 0.5, (y + F.signum(y) * 0.5) / scale).when(F.abs(y) == _inf(), x).otherwise(whole / scale)


def spacing(x) -> Column:
    """Distance to the next double away from zero, with x's sign."""
    x = _d(x)
    e = F.when(x == 0, -1074).otherwise(F.greatest(frexp(x)["exponent"] - 53, F.lit(-1074)))
    return F.when(F.isnan(x) | (F.abs(x) == _inf()), _nan()).otherwise(F.when(x < 0, -1.0).otherwise(1.0) * F.pow(F.lit(2.0), e.cast("double")))


# Tests and logic


def isfinite(x) -> Column:
    x = _d(x)
    return ~F.isnan(x) & (F.abs(x) != _inf())


def isinf(x) -> Column:
    return F.abs(_d(x)) == _inf()


def compare(op: str) -> Callable[[Column, Column], Column]:
    """A comparison in which NaN is unlike everything, itself included."""
    tests = {"equal": lambda a, b: a == b, "not_equal": lambda a, b: a != b, "less": lambda a, b: a < b, "less_equal": lambda a, b: a <= b, "greater": lambda a, b: a > b, "greater_equal": lambda a, b: a >= b}

    def test(x, y) -> Column:
        x, y = _d(x), _d(y)
        return F.when(_any_nan(x, y), F.lit(op == "not_equal")).otherwise(tests[op](x, y))

    return test


def isclose(x, y, rtol: float = 1e-5, atol: float = 1e-8, equal_nan: bool = False) -> Column:
    x, y = _d(x), _d(y)
    near = F.abs(x - y) <= atol + rtol * F.abs(y)
    return F.when(_any_nan(x, y), (F.isnan(x) & F.isnan(y)) if equal_nan else F.lit(False)).when(~(isfinite(x) & isfinite(y)), x == y).otherwise(near)


def truth(x: Column) -> Column:
    return (x != 0) | F.isnan(_d(x))


def nan_to_num(x, nan: float = 0.0, posinf: float | None = None, neginf: float | None = None) -> Column:
    x, most = _d(x), 1.7976931348623157e308
    return F.when(F.isnan(x), float(nan)).when(x == _inf(), most if posinf is None else float(posinf)).when(x == -_inf(), -most if neginf is None else float(neginf)).otherwise(x)


# Choosing


def where(condition: Column, x, y) -> Column:
    return F.when(condition, x).otherwise(y)


def select(conditions: list[Column], values: list[Column], default: Column | float = 0.0) -> Column:
    """The value of the first condition that holds."""
    if len(conditions) != len(values) or not conditions:
        raise ValueError("as many values as conditions, at least one")
    out = F.when(conditions[0], values[0])
    for c, v in zip(conditions[1:], values[1:]):
        out = out.when(c, v)
    return out.otherwise(default)


def choose(index: Column, choices: list[Column], mode: str = "raise") -> Column:
    """The choice at a place from 0. Modes raise (also for null), wrap, clip."""
    n = len(choices)
    if mode == "wrap":
        index = F.pmod(index, F.lit(n))
    elif mode == "clip":
        index = F.greatest(F.least(index, F.lit(n - 1)), F.lit(0))
    else:
        index = F.when(index.between(0, n - 1), index).otherwise(F.raise_error(F.lit("ValueError: invalid entry in choice array")).cast("long"))
    return F.element_at(F.array(*choices), (index + 1).cast("int"))


def polyval(coefficients: list[float], x) -> Column:
    """A polynomial by Horner's rule, the highest power first."""
    x, y = _d(x), F.lit(0.0)
    for c in coefficients:
        y = y * x + float(c)
    return y


# Bits of longs


def left_shift(x: Column, n: Column | int) -> Column:
    n = n if isinstance(n, Column) else F.lit(n)
    return F.when((n < 0) | (n > 63), F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", x.cast("long"), F.when((n < 0) | (n > 63), 0).otherwise(n).cast("int")))


def right_shift(x: Column, n: Column | int) -> Column:
    n = n if isinstance(n, Column) else F.lit(n)
    return F.call_function("shiftright", x.cast("long"), F.least(n, F.lit(63)).cast("int"))


# Learning functions


def sigmoid(x) -> Column:
    x = _d(x)
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def softplus(x) -> Column:
    return logaddexp(_d(x), F.lit(0.0))


def relu(x) -> Column:
    return maximum(x, F.lit(0.0))


def silu(x) -> Column:
    return _d(x) * sigmoid(x)


def gelu_tanh(x) -> Column:
    x = _d(x)
    return 0.5 * x * (1 + F.tanh(math.sqrt(2 / math.pi) * (x + 0.044715 * x * x * x)))


def logit(x) -> Column:
    x = _d(x)
    return log(divide(x, 1 - x))


def xlogy(x, y) -> Column:
    x, y = _d(x), _d(y)
    return F.when((x == 0) & ~F.isnan(y), 0.0).otherwise(x * log(y))


def xlog1py(x, y) -> Column:
    x, y = _d(x), _d(y)
    return F.when((x == 0) & ~F.isnan(y), 0.0).otherwise(x * log1p(y))


def entr(x) -> Column:
    x = _d(x)
    return F.when(x < 0, -_inf()).otherwise(-xlogy(x, x))


def rel_entr(x, y) -> Column:
    x, y = _d(x), _d(y)
    return F.when(_any_nan(x, y), _nan()).when((x > 0) & (y > 0), x * log(divide(x, y))).when((x == 0) & (y >= 0), 0.0).otherwise(_inf())


def kl_div(x, y) -> Column:
    return rel_entr(x, y) - _d(x) + _d(y)


def huber(delta, r) -> Column:
    d, r = _d(delta), F.abs(_d(r))
    return F.when(d < 0, _inf()).when(r <= d, r * r / 2).otherwise(d * (r - d / 2))


def pseudo_huber(delta, r) -> Column:
    d, r = _d(delta), _d(r)
    return F.when(d < 0, _inf()).when((d == 0) | (r == 0), 0.0).otherwise(d * d * (F.sqrt(1 + (r / d) * (r / d)) - 1))


def boxcox(x, lmbda) -> Column:
    x, k = _d(x), _d(lmbda)
    return F.when(F.abs(k) < 1e-19, log(x)).otherwise(F.expm1(k * log(x)) / F.when(k == 0, 1.0).otherwise(k))


def inv_boxcox(y, lmbda) -> Column:
    y, k = _d(y), _d(lmbda)
    return F.when(k == 0, F.exp(y)).otherwise(F.exp(log1p(k * y) / F.when(k == 0, 1.0).otherwise(k)))


# Complex numbers as structs of re and im


def complex_(re, im=0.0) -> Column:
    return F.struct(_d(re).alias("re"), _d(im).alias("im"))


def complex_multiply(a: Column, b: Column) -> Column:
    return complex_(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def angle(z: Column) -> Column:
    return arctan2(z["im"], z["re"])


#: Functions of one real argument, by name.
UNARY: dict[str, Callable[[Column], Column]] = {
    "negative": lambda x: -_d(x), "positive": _d, "absolute": lambda x: F.abs(_d(x)), "fabs": lambda x: F.abs(_d(x)), "square": lambda x: _d(x) * _d(x), "sign": sign, "sqrt": sqrt, "cbrt": lambda x: F.cbrt(_d(x)),
    "exp": lambda x: F.exp(_d(x)), "exp2": exp2, "expm1": lambda x: F.expm1(_d(x)), "exp10": lambda x: F.pow(F.lit(10.0), _d(x)), "log": log, "log2": log2, "log10": log10, "log1p": log1p,
    "sin": lambda x: F.sin(_d(x)), "cos": lambda x: F.cos(_d(x)), "tan": lambda x: F.tan(_d(x)), "arcsin": arcsin, "arccos": lambda x: F.acos(_d(x)), "arctan": lambda x: F.atan(_d(x)),
    "sinh": lambda x: F.sinh(_d(x)), "cosh": lambda x: F.cosh(_d(x)), "tanh": lambda x: F.tanh(_d(x)), "arcsinh": arcsinh, "arccosh": arccosh, "arctanh": arctanh,
    "degrees": lambda x: F.degrees(_d(x)), "rad2deg": lambda x: F.degrees(_d(x)), "radians": lambda x: F.radians(_d(x)), "deg2rad": lambda x: F.radians(_d(x)),
    "floor": floor_double, "ceil": ceil_double, "trunc": trunc, "fix": trunc, "rint": rint, "reciprocal": reciprocal, "spacing": spacing, "sinc": sinc,
    "isnan": lambda x: F.isnan(_d(x)), "isfinite": isfinite, "isinf": isinf, "isposinf": lambda x: _d(x) == _inf(), "isneginf": lambda x: _d(x) == -_inf(), "signbit": signbit,
    "logical_not": lambda x: ~truth(x), "invert": lambda x: F.bitwise_not(x.cast("long")), "bitwise_count": lambda x: F.bit_count(F.abs(x.cast("long"))), "nan_to_num": nan_to_num,
    "sigmoid": sigmoid, "expit": sigmoid, "log_expit": lambda x: -softplus(-_d(x)), "logit": logit, "softplus": softplus, "relu": relu, "silu": silu, "gelu_tanh": gelu_tanh, "entr": entr,
    "sindg": lambda x: F.sin(F.radians(mod(x, 360.0))), "cosdg": lambda x: F.cos(F.radians(mod(x, 360.0))), "cosm1": lambda x: -2 * F.sin(_d(x) / 2) * F.sin(_d(x) / 2),
}

#: Functions of two arguments, by name.
BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda x, y: _d(x) + _d(y), "subtract": lambda x, y: _d(x) - _d(y), "multiply": lambda x, y: _d(x) * _d(y), "divide": divide, "true_divide": divide, "floor_divide": floor_divide, "mod": mod, "remainder": mod, "fmod": fmod, "power": power, "float_power": power,
    "maximum": maximum, "minimum": minimum, "fmax": fmax, "fmin": fmin, "arctan2": arctan2, "hypot": lambda x, y: F.hypot(_d(x), _d(y)), "copysign": copysign, "heaviside": heaviside, "ldexp": ldexp, "logaddexp": logaddexp, "logaddexp2": logaddexp2,
    **{op: compare(op) for op in ("equal", "not_equal", "less", "less_equal", "greater", "greater_equal")},
    "logical_and": lambda x, y: truth(x) & truth(y), "logical_or": lambda x, y: truth(x) | truth(y), "logical_xor": lambda x, y: truth(x) != truth(y),
    "bitwise_and": lambda x, y: x.bitwiseAND(y), "bitwise_or": lambda x, y: x.bitwiseOR(y), "bitwise_xor": lambda x, y: x.bitwiseXOR(y), "left_shift": left_shift, "right_shift": right_shift, "gcd": gcd, "lcm": lcm,
    "xlogy": xlogy, "xlog1py": xlog1py, "rel_entr": rel_entr, "kl_div": kl_div, "huber": huber, "pseudo_huber": pseudo_huber, "boxcox": boxcox, "inv_boxcox": inv_boxcox, "isclose": isclose,
}
