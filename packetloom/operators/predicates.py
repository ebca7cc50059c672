"""Three-valued predicates over sessions and frames, as Columns: true, false, or null for what can't be decided.

SQL's null logic is the Kleene logic these need: `&`, `|` and `~` combine them. Text fields that are missing are
a plain miss; start, duration, latency, findings and tallies with omissions can be unknown.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.net import folded, in_cidr, mac_normalised, wildcard


def known(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def text_contains(col: str, needle: str) -> Column:
    return known(F.contains(folded(F.col(col)), F.lit(needle.strip().lower())))


def text_matches(col: str, pattern: str) -> Column:
    return known(wildcard(F.col(col), pattern))


def _sides(scope: str) -> tuple[str, ...]:
    return {"any": ("client", "server"), "source": ("client",), "destination": ("server",)}[scope]


def ip_in(*values: str, scope: str = "any") -> Column:
    """Addresses and networks, mixed."""
    tests = [in_cidr(F.col(f"{s}_ip"), v) if "/" in v else in_cidr(F.col(f"{s}_ip"), f"{v}/128") if ":" in v else known(F.col(f"{s}_ip") == v) for s in _sides(scope) for v in values]
    return reduce(Column.__or__, tests)


def port_in(low: int, high: int | None = None, scope: str = "any") -> Column:
    return reduce(Column.__or__, [known(F.col(f"{s}_port").between(low, high if high is not None else low)) for s in _sides(scope)])


def protocol(kind: str) -> Column:
    return known(F.array_contains("stack", kind))


def mac_is(address: str, scope: str = "any") -> Column:
    """Hardware addresses in any spelling; a value that is none matches nothing."""
    want = mac_normalised(F.lit(address))
    return reduce(Column.__or__, [known(mac_normalised(F.col(f"{s}_mac")) == want) for s in _sides(scope)])


def status_is(status: str) -> Column:
    return known(F.col("status") == status)


def has_text(col: str) -> Column:
    return known(F.trim(F.col(col)) != "")


def has_value(col: str) -> Column:
    return F.col(col).isNotNull()


def at_least(col: str, value) -> Column:
    """On nullable measures: unknown where the measure is."""
    return F.col(col) >= value


def at_most(col: str, value) -> Column:
    return F.col(col) <= value


def between(col: str, low, high) -> Column:
    return F.col(col).between(low, high)


def total_bytes(low: int | None = None, high: int | None = None) -> Column:
    """Negative or overflowing totals are a miss, never unknown."""
    total = F.try_add(F.col("bytes_up"), F.col("bytes_down"))
    ok = (F.col("bytes_up") >= 0) & (F.col("bytes_down") >= 0)
    return known(ok & (total >= (low or 0)) & (total <= (high if high is not None else 2**63 - 1)))


class Measure:
    """Integer arithmetic over bytes and frames. Unknown operands make the result unknown; overflow and division by
    zero make a comparison false."""

    def __init__(self, value: Column, unknown: Column):
        self.value, self.unknown = value, unknown

    @staticmethod
    def of(x: Measure | int) -> Measure:
        return x if isinstance(x, Measure) else Measure(F.lit(x).cast("long"), F.lit(False))

    @staticmethod
    def bytes(side: str = "total") -> Measure:
        cols = {"sent": F.col("bytes_up"), "received": F.col("bytes_down"), "total": F.try_add("bytes_up", "bytes_down")}
        return Measure(cols[side], cols[side].isNull())

    @staticmethod
    def frames(side: str = "total") -> Measure:
        """Unknown where there are bytes and no packets."""
        missing = ((F.col("packets_up") + F.col("packets_down")) == 0) & ((F.col("bytes_up") + F.col("bytes_down")) > 0)
        cols = {"sent": F.col("packets_up"), "received": F.col("packets_down"), "total": F.try_add("packets_up", "packets_down")}
        return Measure(cols[side], missing)

    def _with(self, other: Measure | int, f) -> Measure:
        o = Measure.of(other)
        return Measure(f(self.value, o.value), self.unknown | o.unknown)

    def __add__(self, o):
        return self._with(o, F.try_add)

    def __sub__(self, o):
        return self._with(o, F.try_subtract)

    def __mul__(self, o):
        return self._with(o, F.try_multiply)

    def __floordiv__(self, o):
        return self._with(o, lambda a, b: F.when(b != 0, F.call_function("div", a, F.when(b != 0, b))))

    def __mod__(self, o):
        return self._with(o, lambda a, b: F.when(b != 0, a % F.when(b != 0, b)))

    def compare(self, op: str, other: Measure | int) -> Column:
        o = Measure.of(other)
        test = {"==": self.value == o.value, ">=": self.value >= o.value, "<=": self.value <= o.value}[op]
        return F.when(self.unknown | o.unknown, F.lit(None).cast("boolean")).otherwise(known(test))


def completeness(value: int | str) -> Column:
    """A number from 0 to 63, `complete` (open and data seen and an end seen) or `incomplete`."""
    c = F.col("completeness")
    done = (c.bitwiseAND(7) == 7) & (c.bitwiseAND(48) != 0)
    return {"complete": done, "incomplete": ~done}[value] if isinstance(value, str) else c == value


def tally_has(messages: str, omitted: str, key: str) -> Column:
    """A map column holds the key; a miss is unknown where keys were omitted."""
    hit = known(F.map_contains_key(messages, key))
    return F.when(hit, True).when(F.col(omitted) > 0, F.lit(None).cast("boolean")).otherwise(False)


#: Which stacks a finding kind can say something about.
FINDING_SCOPE = {"dns": "dns", "tls": "tls", "icmp": "icmp"}


def with_findings(sessions: DataFrame, findings: DataFrame) -> DataFrame:
    """sessions with finding_kinds (array), joined once for all finding predicates of a query."""
    kinds = findings.groupBy("session_id").agg(F.array_sort(F.collect_set("kind")).alias("finding_kinds"))
    return sessions.join(kinds, "session_id", "left").withColumn("finding_kinds", F.coalesce("finding_kinds", F.array().cast("array<string>")))


def finding(kind: str) -> Column:
    """Present: true. Absent: unknown where the kind applies to the session's stack, else false."""
    scope = next((s for prefix, s in FINDING_SCOPE.items() if kind.startswith(prefix)), "tcp")
    return F.when(F.array_contains("finding_kinds", kind), True).when(F.array_contains("stack", scope), F.lit(None).cast("boolean")).otherwise(False)


def any_finding() -> Column:
    """True or unknown, never false."""
    return F.when(F.size("finding_kinds") > 0, True)


def evaluate(rows: DataFrame, predicate: Column) -> DataFrame:
    """Matched and undecided rows in capture order, with truth `match` or `indeterminate`."""
    named = F.when(predicate, "match").when(predicate.isNull(), "indeterminate")
    return rows.withColumn("truth", named).where("truth IS NOT NULL").orderBy("first_ordinal")


def coverage(rows: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """One row: which reasons for undecided rows occur at all."""
    return rows.agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in reasons.items()])


#: Fields and operators of the rule builder.
RULE_FIELDS = {"host": "host", "process": "process", "protocol": "app", "status": "status", "client": "client_ip", "server": "server_ip", "query": "dns_query"}


def rule(field: str, operator: str, value: str) -> Column:
    """One rule. A regular expression that does not compile matches nothing."""
    c, v = folded(F.coalesce(F.col(RULE_FIELDS[field]), F.lit(""))), value.strip().lower()
    if operator == "regex":
        try:
            re.compile(value)
        except re.error:
            return F.lit(False)
        return F.coalesce(F.col(RULE_FIELDS[field]), F.lit("")).rlike("(?i)" + value)
    tests = {"contains": c.contains(v), "is": c == v, "startsWith": c.startswith(v), "endsWith": c.endswith(v), "doesNotContain": ~c.contains(v), "notEqual": c != v}
    return tests[operator]


def rule_chain(rules: list[tuple[str, Column]]) -> Column:
    """Left to right without precedence: [(ignored, first), ('and' | 'or', next), ...]."""
    out = rules[0][1]
    for joiner, test in rules[1:]:
        out = (out & test) if joiner == "and" else (out | test)
    return out


def free_text(columns: list[str], query: str) -> Column:
    return F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(query.strip().lower()))


# ---- frames -----------------------------------------------------------------------------------------------


def frame_field(col: str, stopped: str | None = None) -> Column:
    """A frame fact; null (unknown) only where decoding stopped, if a column says so, otherwise absent facts miss."""
    return F.col(col) if stopped is None else F.when(F.col(col).isNull() & F.col(stopped), None).otherwise(F.col(col))


def frame_compare(col: str, op: str, value: int, stopped: Column | None = None) -> Column:
    c = F.col(col)
    test = {"==": c == value, ">": c > value, ">=": c >= value, "<": c < value, "<=": c <= value}[op]
    absent = F.lit(False) if stopped is None else F.when(stopped, F.lit(None).cast("boolean")).otherwise(False)
    return F.when(c.isNull(), absent).otherwise(test)


def frame_flag(bit: int) -> Column:
    return F.when(F.col("proto") == "tcp", F.col("flags").bitwiseAND(bit) != 0).otherwise(False)


def frame_port(port: int, proto: str) -> Column:
    return known((F.col("proto") == proto) & ((F.col("src_port") == port) | (F.col("dst_port") == port)))


def color(rules: list[tuple[str, Column]]) -> Column:
    """The first rule that is not plainly false decides: its color if true, `unknown` if undecided."""
    out = None
    for name, test in rules:
        out = F.when(test.isNull(), "unknown") if out is None else out.when(test.isNull(), "unknown")
        out = out.when(test, name)
    return out if out is not None else F.lit(None).cast("string")


def match_counter(frames: DataFrame, predicate: Column, selected: int) -> DataFrame:
    """Capture-wide: matches, unknowns, and the matches before and after a selected frame."""
    yes = known(predicate)
    o = F.col("ordinal")
    return frames.agg(
        F.count_if(yes).alias("matches"),
        F.count_if(predicate.isNull()).alias("unknown"),
        F.max(F.when(yes & (o < selected), o)).alias("previous"),
        F.min(F.when(yes & (o > selected), o)).alias("next"),
    )


def ordinal_list(spec: str) -> Column:
    """`1-100,250`."""
    tests = []
    for part in spec.split(","):
        low, _, high = part.strip().partition("-")
        lo, hi = int(low), int(high or low)
        if lo < 1 or hi < lo:
            raise ValueError(f"not a frame list: {spec}")
        tests.append(F.col("ordinal").between(lo, hi))
    return reduce(Column.__or__, tests)
