"""Secret scans: three base patterns, and a battery of randomness tests on every long token.

All of it is DataFrame expressions. A token of `[A-Za-z0-9+/_=-]` that is long enough is taken as text in the
smallest encoding whose alphabet holds it (digits, hex, letters of one case, base32, lower-case base36, letters, base62,
base64). A token of digits alone or of letters of one case alone must be longer, as a word of 20 letters passes for a
draw of 20 from 26 too often. Three tests ask
whether its symbols could be uniform draws from that alphabet: chi-squared of the symbol counts, the number of
runs above and below the middle of the alphabet, and the serial correlation of neighbouring symbols. Fisher's
method combines them. Over all tokens of the corpus the Benjamini-Hochberg rule decides which are not random;
each p-value is weighted by length, as a short token has little power to show that it isn't random. Tokens that the
rule leaves are reported as secrets of kind `random`. The rule needs one number from the corpus, found from a
histogram of at most `_BINS` rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.llm.shared import written

# The base patterns, with the group whose length counts and that length.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

_SYMBOLS = "+-/0123456789=ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"
_BINS = 2000


@dataclass(frozen=True)
class RandomnessRules:
    """`min_length` of a token, `one_class_length` of one of digits or of letters of one case alone, and the share
    `false_discovery` of random tokens that may be taken for text."""

    min_length: int = 20
    one_class_length: int = 40
    false_discovery: float = 0.05


def _matches(text: Column, pattern: str, counted: Column | None, least: int) -> Column:
    """start, end (code points) of all leftmost non-overlapping matches, those counted under `least` dropped."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = whole if counted is None else counted
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    sizes = F.zip_with(F.transform(whole, F.length), F.transform(counted, F.length), lambda a, b: F.struct(a.alias("all"), b.alias("counted")))
    steps = F.zip_with(gaps, sizes, lambda gap, size: F.struct(gap.alias("gap"), size.all.alias("all"), size.counted.alias("counted")))
    none = F.array().cast("array<struct<start:int,end:int,counted:int>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        at = acc.at + x.gap
        span = F.struct(at.alias("start"), (at + x.all).alias("end"), x.counted.alias("counted"))
        return F.struct((at + F.coalesce(x.all, F.lit(0))).alias("at"), F.when(x.counted >= least, F.concat(acc.spans, F.array(span))).otherwise(acc.spans).alias("spans"))

    spans = F.transform(F.aggregate(steps, start, step).spans, lambda x: F.struct(x.start.alias("start"), x.end.alias("end")))
    return F.when(F.rlike(text, F.lit(pattern)), spans).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def _tail(z: Column) -> Column:
    """Probability that a standard normal draw is above z (logistic approximation, error under 0.0002)."""
    return 1 / (1 + F.exp(F.least(F.greatest(z * 1.5976 + F.pow(z, 3) * 0.07056, F.lit(-40.0)), F.lit(40.0))))


def _counted(t: Column) -> Column:
    """What the tests need of a token: its alphabet's size, symbol counts, high and low symbols, lag products."""
    token = t.token
    symbols = F.split(token, "")
    squares = F.aggregate(
        F.array_distinct(symbols), F.lit(0.0), lambda acc, c: acc + F.pow((F.length(token) - F.length(F.replace(token, c, F.lit("")))).cast("double"), 2)
    )
    high = F.when(F.lit(False), "")
    for size, middle in ((10, "4"), (16, "7"), (32, "M"), (36, "h"), (52, "Z"), (62, "V"), (64, "V")):
        high = high.when(t.kind == size, F.translate(token, _SYMBOLS, "".join("1" if c > middle else "0" for c in _SYMBOLS)))
    high = high.when(t.kind == 26, F.translate(F.upper(token), _SYMBOLS, "".join("1" if c > "M" else "0" for c in _SYMBOLS)))
    zero = F.struct(*(F.lit(0.0).alias(k) for k in ("sum", "squares", "lagged", "last")))

    def step(acc: Column, c: Column) -> Column:
        x = F.ascii(c).cast("double")
        return F.struct((acc.sum + x).alias("sum"), (acc.squares + x * x).alias("squares"), (acc.lagged + acc["last"] * x).alias("lagged"), x.alias("last"))

    sums = F.aggregate(symbols, zero, step)
    first = F.ascii(token).cast("double")
    return F.struct(t.start.alias("start"), t.end.alias("end"), F.length(token).cast("double").alias("n"), t.kind.alias("kind"), squares.alias("squares"), high.alias("high"), first.alias("first"), sums.alias("sums"))


def _p_value(t: Column) -> Column:
    """Combined p-value: small where the token's symbols are not uniform, independent draws."""
    n, free = t.n, t.kind - 1
    chi = (t.kind / n * t.squares - n - free) / F.sqrt(2 * free * (1 - 1 / n))
    ups = F.length(F.replace(t.high, F.lit("0"), F.lit(""))).cast("double")
    size = F.length(t.high)
    turns = 2 * size - F.length(F.replace(t.high, F.lit("01"), F.lit("1"))) - F.length(F.replace(t.high, F.lit("10"), F.lit("0")))
    expected = 2 * ups * (n - ups) / n + 1
    spread = F.sqrt(F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(0.0)))
    run = F.when(spread > 0, F.abs(1 + turns - expected) / spread).otherwise(0.0)
    mean = t.sums.sum / n
    own = t.sums.squares - n * mean * mean
    lagged = t.sums.lagged - mean * (2 * t.sums.sum - t["first"] - t.sums["last"]) + (n - 1) * mean * mean
    serial = F.when(own > 1e-6, F.abs(lagged / own + 1 / n) * F.sqrt(n)).otherwise(F.lit(9.0))
    half = -sum((F.log(F.greatest(p, F.lit(1e-15))) for p in (_tail(chi), 2 * _tail(run), 2 * _tail(serial))), F.lit(0.0))
    return F.exp(-half) * (1 + half + half * half / 2)


def _candidates(text: Column, rules: RandomnessRules) -> Column:
    """start, end, p of the tokens that could be keys, which are all that are long enough.

    Each transform reads what the one inside it made, so nothing is computed twice for a token.
    """
    spans = _matches(text, f"[A-Za-z0-9+/_=-]{{{rules.min_length},}}", None, rules.min_length)
    named = F.transform(spans, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), F.substring(text, s.start + 1, s.end - s.start).alias("token")))
    likely = F.filter(named, lambda s: (s.end - s.start >= rules.one_class_length) | ~s.token.rlike("^([0-9]+|[a-z]+|[A-Z]+)$"))
    kind = (
        lambda w: F.when(w.rlike("^[0-9]+$"), 10).when(w.rlike("^([0-9a-f]+|[0-9A-F]+)$"), 16).when(w.rlike("^([a-z]+|[A-Z]+)$"), 26)
        .when(w.rlike("^[A-Z2-7]+=*$"), 32).when(w.rlike("^[0-9a-z]+$"), 36).when(w.rlike("^[A-Za-z]+$"), 52)
        .when(w.rlike("^[0-9A-Za-z]+$"), 62).otherwise(64)
    )
    typed = F.transform(likely, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.token.alias("token"), kind(s.token).alias("kind")))
    return F.transform(F.transform(typed, _counted), lambda t: F.struct(t.start.alias("start"), t.end.alias("end"), _p_value(t).alias("p")))


def _rejected_below(tokens: DataFrame, rules: RandomnessRules) -> tuple[float, float]:
    """Mean length weight, and the weighted p-value up to which Benjamini-Hochberg calls tokens not random."""
    weight = rules.min_length / F.col("n")
    total, mean = tokens.agg(F.count("*"), F.avg(weight)).first()
    if not total:
        return 1.0, 0.0
    bins = tokens.select(F.least(F.floor(-100 * F.log10(F.greatest(F.col("p") * mean / weight, F.lit(1e-20)))), F.lit(_BINS)).alias("b"))
    limit, seen = 0.0, 0
    for row in sorted(bins.groupBy("b").count().collect(), key=lambda r: -r["b"]):  # one row a bin, the smallest p first
        seen += row["count"]
        upper = 10 ** (-row["b"] / 100)
        if upper <= rules.false_discovery * seen / total:
            limit = upper
    return mean, limit


def _of_kind(order: int, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x.start.alias("start"), F.lit(order).alias("kind_order"), x.end.alias("end")))


def n_spans(spans: Column, kind: str) -> Column:
    """Number of spans of a kind."""
    return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("bigint")


def secret_spans(docs: DataFrame, rules: RandomnessRules = RandomnessRules()) -> DataFrame:
    """The columns of `docs` and `spans`: an array of start, kind_order, end, kind, in order of start and kind.

    Starts and ends are code points, ends exclusive. A null or empty text has no spans; repeated rows each get
    theirs; an empty table gives an empty one. A column of `docs` called `spans` is replaced. Tokens inside a
    span of a base pattern are not reported again as `random`.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    second = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    found = [(0, _matches(text, ASSIGN, second, 8)), (1, _matches(text, ACCESS, None, 16)), (2, _matches(text, HEX, None, 32))]
    base = F.concat(*(_of_kind(k, s) for k, s in found))
    seen = written(docs.drop("spans").withColumns({"_base": base, "_tokens": _candidates(text, rules)}), "secrets")
    tokens = seen.filter(F.size("_tokens") > 0).select(F.inline("_tokens")).select((F.col("end") - F.col("start")).alias("n"), "p")
    mean, limit = _rejected_below(tokens, rules)

    def random(t: Column) -> Column:
        inside = F.exists("_base", lambda b: (b.start <= t.start) & (b.end >= t.end))
        return ~inside & (t.p * mean * (t.end - t.start) / rules.min_length > limit)

    added = F.transform(F.filter("_tokens", random), lambda t: F.struct(t.start.alias("start"), F.lit(3).alias("kind_order"), t.end.alias("end")))
    ordered = F.array_sort(F.concat("_base", added))
    names = F.array(*map(F.lit, KINDS))
    spans = F.transform(ordered, lambda s: F.struct(s.start.alias("start"), s.kind_order.alias("kind_order"), s.end.alias("end"), names[s.kind_order].alias("kind")))
    return seen.withColumn("spans", spans).drop("_base", "_tokens")


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)))


def redacted(docs: DataFrame, mark: str = "[secret]", rules: RandomnessRules = RandomnessRules()) -> DataFrame:
    """`docs` with every span of its text replaced by `mark` (touching spans by one), and n_chars counted anew."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        apart = (s.start > acc.at) | ((s.start == 0) & (acc.at == 0))
        grown = F.concat(acc.out, F.substring(F.col("text"), acc.at + 1, s.start - acc.at), F.lit(mark))
        return F.struct(F.greatest(acc.at, s.end).alias("at"), F.when(apart, grown).otherwise(acc.out).alias("out"))

    done = F.aggregate("spans", start, step)
    text = F.when(F.size("spans") > 0, F.concat(done.out, F.substring(F.col("text"), done["at"] + 1, F.length("text")))).otherwise(F.col("text"))
    others = {c: f"_c{k}" for k, c in enumerate(docs.columns) if c not in ("text", "n_chars")}  # no name of theirs can clash
    found = secret_spans(docs.withColumnsRenamed(others), rules).withColumn("text", text)
    counted = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return counted.select(*(F.col(others.get(c, c)).alias(c) for c in docs.columns))
