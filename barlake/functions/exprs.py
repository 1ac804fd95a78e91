"""Column functions shared by all operators, and the constants they stand on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

THRESHOLD, EPSILON = 0.02, 1e-9
TOUCH = THRESHOLD - EPSILON
STOP, STOP_TOUCH = -0.01, -0.01 + 1e-9
GLITCH_MULTIPLE, GLITCH_WINDOW = 1.15, 20
EVENT = "open_to_high"
MIN_HISTORY, LIQUIDITY = 20, 100_000
COMPLETE_SHARE, COMPLETE_WINDOW, COMPLETE_PRIORS = 0.9, 20, 5
LIMIT_FIRST, STOP_FIRST = 1, 2


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """Not null, not NaN, not infinite; false (never null) otherwise."""
    c = col(c).cast("double")
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b as double, null where b is 0."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def valid_bar(prefix: str = "") -> Column:
    o, h, lo, c = (F.col(prefix + n) for n in ("open", "high", "low", "close"))
    return finite(o) & finite(h) & finite(lo) & finite(c) & (o > 0) & (h >= o) & (h >= c) & (lo <= o) & (lo <= c)


def touch_event(high_return: str | Column = "high_return", glitch: str | Column = "high_glitch_suspect", threshold: float = TOUCH) -> Column:
    """The one event: the day's high reached open plus the threshold, and isn't a glitch. Null inputs are no event."""
    return F.coalesce(finite(high_return) & (col(high_return) >= threshold) & ~col(glitch), F.lit(False))


def split_artifact(open_: str | Column = "open", close: str | Column = "close", prev_close: str | Column = "prev_close") -> Column:
    """A bar whose day moves by more than half while its open jumps against the close before by more than 2 to 1."""
    o, c, p = col(open_), col(close), col(prev_close)
    jump = ratio(o, p)
    flagged = (F.abs(ratio(c - o, o)) > 0.5 + EPSILON) & finite(p) & (p > 0) & ((jump > 2 + EPSILON) | (jump < 0.5 - EPSILON))
    return F.coalesce(flagged, F.lit(False))


def late(created_ts: str | Column, target_date: str | Column, zone: str = "America/New_York") -> Column:
    """Made after the target day's 09:30 exchange time (session time zone UTC); unknown is late."""
    opens = F.to_utc_timestamp(col(target_date).cast("timestamp") + F.expr("INTERVAL 9 HOURS 30 MINUTES"), zone)
    return F.coalesce(col(created_ts) > opens, F.lit(True))


def slot(ts: str | Column, date: str | Column, bar_minutes: int, session_open_minutes: int) -> Column:
    """Number of the bar's grid slot since the session's open, off-grid prints floored."""
    seconds = F.unix_timestamp(col(ts).cast("timestamp")) - F.unix_timestamp(col(date).cast("timestamp")) - session_open_minutes * 60
    return F.floor(seconds / (bar_minutes * 60)).cast("long")


def six(c: Column) -> Column:
    """A double rounded to 6 places, with no minus zero: what results are compared by."""
    return F.round(c.cast("double"), 6) + F.lit(0.0)


def normalize_symbol(c: str | Column) -> Column:
    return F.translate(F.trim(col(c)), "/.", "--")


#: A JSON text's tokens: a string, a number, or any other character.
_TOKEN = r"""("[^"\\]*+(?:\\.[^"\\]*+)*+"|-?[0-9][0-9.eE+\-]*|[^"])"""


def canonical_params(c: str | Column) -> Column:
    """Identity of a JSON parameter object, at any depth: keys sorted, a whole number the same however it is written (200, 200.0, 2e2), all else
    by type and value, so that the text "200.0" isn't the number 200. Null for malformed JSON, a repeated key, and what isn't an object.

    A variant writes its keys in order and decimals without trailing zeros; what is left to do are numbers with an exponent."""
    tokens = F.regexp_extract_all(F.to_json(F.try_parse_json(col(c))), F.lit(_TOKEN), 1)

    def plain(token: Column) -> Column:
        value = token.try_cast("double")
        whole = F.when((value == F.floor(value)) & (F.abs(value) < 1e37), value.try_cast("decimal(38,0)").cast("string")).otherwise(value.cast("string"))
        number = F.when(token.rlike("^-?[0-9]+$"), token).otherwise(whole)
        return F.when(token.rlike("^-?[0-9]"), number).when(token == ",", ", ").when(token == ":", ": ").otherwise(token)

    text = F.array_join(F.transform(tokens, plain), "")
    return F.when(text.startswith("{"), text)


def tail_quantile(p: str) -> Column:
    """The standard normal z that is exceeded with the chance in the SQL expression p (at most 0.1): Newton steps on the logarithm of the tail,
    whose ratio to the density is a continued fraction."""
    ratio_ = "(1 / aggregate(sequence(120, 1, -1), z, (d, k) -> z + k / d))"
    gap = f"(ln({ratio_}) - 0.9189385332046727D - z * z / 2 - ln({p}))"
    return F.expr(f"aggregate(sequence(1, 12), sqrt(-2 * ln({p})), (z, i) -> z + {gap} * {ratio_})")


def exit_rule(rule: str, ol: str | Column = "ol", oc: str | Column = "oc", filled: str | Column = "filled", seq: str | Column = "seq", fill: str | Column = "fill", trail: str | Column = "trail") -> Column:
    """(worst, best) return of a pick bought at the open, as a struct; a measured stop fill is never better than the stop."""
    ol, oc, filled, seq, fill, trail = map(col, (ol, oc, filled, seq, fill, trail))
    limit = F.lit(THRESHOLD)
    if rule == "hold_close":
        worst = best = oc
    elif rule == "limit_2pct":
        worst = best = F.when(filled, limit).otherwise(oc)
    elif rule == "trailing":
        worst = best = trail
    elif rule == "limit_stop":
        stopped = ol <= STOP_TOUCH
        out = F.least(F.coalesce(fill, F.lit(STOP)), F.lit(STOP))
        both = filled & stopped
        worst = F.when(both & (seq == LIMIT_FIRST), limit).when(stopped, out).when(filled, limit).otherwise(oc)
        best = F.when(both & (seq == STOP_FIRST), out).when(both, limit).when(stopped, out).when(filled, limit).otherwise(oc)
    else:
        raise ValueError(f"unknown exit rule: {rule!r}")
    return F.struct(worst.cast("double").alias("worst"), best.cast("double").alias("best"))
