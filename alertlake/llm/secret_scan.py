"""Secret scans: three kinds of known patterns, and strings that a battery of randomness tests can't tell from random ones.

A candidate is a run of at least 20 characters of the base64 alphabets with a letter and a digit. Its encoding is the smallest
alphabet that holds it. Three tests ask whether its characters are uniform draws from that alphabet: chi-squared of the counts,
runs above and below the middle, and serial correlation. Fisher's method combines their p-values.

Random strings spread evenly over p, others pile up near 0. For each class of lengths the share of random strings is estimated
from the upper half of p, and the threshold is the smallest p above which the estimated share of false discoveries is at most
``max_false``. Short strings, where the tests have little power, thus need a higher p. The estimate uses every distinct candidate
of the corpus, counted in bins, so only a small table is gathered. Everything is made of DataFrame functions.

A class with fewer than ``enough`` candidates in the upper half borrows those of the nearest classes until it has enough. What others tell of
the share of random strings needn't hold for it, so its threshold is then at least ``max_false``: the battery itself must not reject the string
at that level. Where all classes together have too few and give no threshold, that level alone decides.

Defined cases: a null text is empty and has no span; positions are code points; equal candidates share their p; random spans that
overlap a span of a known pattern are left out, and known patterns always stay; rows are judged one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertlake.llm.common import id_and_text

# The patterns of the known kinds, in their order.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX))
MIN_VALUE = 8

CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Smallest first: (what holds only such characters, the alphabet in its order).
ENCODINGS = (("[0-9a-f]+", DIGITS + LOWER[:6]), ("[0-9A-F]+", DIGITS + UPPER[:6]), ("[A-Z2-7]+", UPPER + DIGITS[2:8]),
             ("[0-9a-z]+", DIGITS + LOWER), ("[0-9A-Z]+", DIGITS + UPPER), ("[0-9A-Za-z]+", UPPER + LOWER + DIGITS),
             ("[0-9A-Za-z+/]+", UPPER + LOWER + DIGITS + "+/"), ("[0-9A-Za-z_-]+", UPPER + LOWER + DIGITS + "-_"))
WIDEST = UPPER + LOWER + DIGITS + "+/-_"
LEAST = 1e-6


@dataclass(frozen=True)
class Battery:
    max_false: float = 0.05
    bins: int = 200
    enough: int = 10


def running_sums(values: Column) -> Column:
    """Sums of an array up to each place, by doubling: n log n steps instead of n squared."""
    rounds = F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int")

    def add(sums: Column, k: Column) -> Column:
        back = F.pow(F.lit(2), k).cast("int")
        return F.transform(sums, lambda x, i: x + F.when(i >= back, F.get(sums, i - back)).otherwise(F.lit(0)))

    return F.aggregate(F.sequence(F.lit(0), rounds), values, add)


def positions(text: Column, found: Column, pattern: str) -> Column:
    """Starts of all matches: the lengths of what stands between them and of the matches before, summed."""
    between = F.split(text, pattern, -1)
    steps = F.transform(found, lambda m, i: F.length(F.get(between, i)) + F.when(i > 0, F.length(F.get(found, i - 1))).otherwise(F.lit(0)))
    return running_sums(steps)


def with_matches(df: DataFrame, name: str, pattern: str) -> DataFrame:
    """Columns name_m (matched strings) and name_s (their starts), both empty in most rows, which then cost one search."""
    found = df.withColumn(f"{name}_m", F.regexp_extract_all("text", F.lit(pattern), 0))
    some = F.size(f"{name}_m") > 0
    return found.withColumn(f"{name}_s", F.when(some, positions(F.col("text"), F.col(f"{name}_m"), pattern)))


def upper_tail(z: Column) -> Column:
    """Normal upper tail, by the logistic approximation (off by less than 0.0002)."""
    z = F.least(F.greatest(z, F.lit(-8.0)), F.lit(8.0))
    return F.greatest(1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z)), F.lit(LEAST))


def alphabet_of(token: Column) -> Column:
    chain = None
    for pattern, alphabet in ENCODINGS:
        hit = token.rlike(f"^{pattern}$")
        chain = F.when(hit, alphabet) if chain is None else chain.when(hit, alphabet)
    return chain.otherwise(WIDEST)


def randomness(token: Column) -> Column:
    """p-value of a token as uniform draws from its alphabet, or null for what isn't a candidate."""
    both = token.rlike("[0-9]") & token.rlike("[A-Za-z]")
    parts = F.transform(F.array(F.struct(token.alias("t"), alphabet_of(token).alias("a"))), lambda s: F.struct(
        s["a"].alias("a"), F.length(s["t"]).cast("double").alias("n"), F.length(s["a"]).cast("double").alias("k"),
        F.transform(F.split(s["t"], ""), lambda c: (F.instr(s["a"], c) - 1).cast("double")).alias("x"),
        F.transform(F.split(s["a"], ""), lambda c: (F.length(s["t"]) - F.length(F.replace(s["t"], c, F.lit("")))).cast("double")).alias("c")))
    return F.when(both, F.get(F.transform(parts, combined), F.lit(0)))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def combined(s: Column) -> Column:
    n, k, x = s["n"], s["k"], s["x"]
    following = F.concat(F.slice(x, 2, F.size(x) - 1), F.slice(x, 1, 1))  # the last is followed by the first
    free = k - 1
    chi = k / n * total(F.transform(s["c"], lambda c: c * c)) - n
    uniform = upper_tail((F.pow(chi / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free)))
    high = lambda v: F.when(v * 2 >= k, 1.0).otherwise(0.0)
    ones = total(F.transform(x, high))
    turns = total(F.zip_with(x, following, lambda a, b: F.abs(high(a) - high(b)))) - F.abs(high(F.get(x, F.size(x) - 1)) - high(F.get(x, F.lit(0))))
    mean = 2 * ones * (n - ones) / n
    spread = mean * (mean - 1) / (n - 1)
    runs = F.when(spread > 0, 2 * upper_tail(F.abs(turns - mean) / F.sqrt(spread))).otherwise(LEAST)
    sums, squares = total(x), total(F.transform(x, lambda v: v * v))
    products = total(F.zip_with(x, following, lambda a, b: a * b))
    varies = n * squares - sums * sums
    deviation = F.sqrt(n * n / ((n - 1) * (n - 1) * (n - 2)))
    serial = F.when(varies > 0, 2 * upper_tail(F.abs((n * products - sums * sums) / varies + 1 / (n - 1)) / deviation)).otherwise(LEAST)
    q = -(F.ln(F.least(uniform, F.lit(1.0))) + F.ln(F.least(runs, F.lit(1.0))) + F.ln(F.least(serial, F.lit(1.0))))
    return F.exp(-q) * (1 + q + q * q / 2)


def length_class(token: Column) -> Column:
    return F.floor(2 * F.log2(F.length(token))).cast("int")


def thresholds(docs: DataFrame, battery: Battery = Battery(), id_col: str = "doc_id", text_col: str = "text") -> dict[int, float]:
    """Least p of each length class. What comes to the driver is at most ``bins`` counts for each class."""
    tokens = (id_and_text(docs, id_col, text_col).select(F.explode(F.regexp_extract_all("text", F.lit(CANDIDATE), 0)).alias("token"))
              .distinct())
    judged = tokens.select(length_class(F.col("token")).alias("class"), randomness(F.col("token")).alias("p")).where(F.col("p").isNotNull())
    bin_of = F.least(F.floor(F.col("p") * battery.bins), F.lit(battery.bins - 1)).cast("int")
    counts = judged.groupBy("class", bin_of.alias("bin")).count().collect()
    by_class: dict[int, list[int]] = {}
    for row in counts:
        by_class.setdefault(row["class"], [0] * battery.bins)[row["bin"]] += row["count"]
    found = {}
    for name in by_class:
        bins, settled = pooled(by_class, name, battery)
        least = least_p(bins, battery)
        if bins == by_class[name] and settled:
            if least is not None:
                found[name] = least
        elif least is not None or not settled:
            found[name] = max(battery.max_false, least or 0.0)
    return found


def pooled(by_class: dict[int, list[int]], name: int, battery: Battery) -> tuple[list[int], bool]:
    """The bins of a class and of as many of its nearest classes as it takes to have enough in the upper half, and whether it has."""
    bins, half = [0] * battery.bins, battery.bins // 2
    for distance in range(max(by_class) - min(by_class) + 1):
        for other in {name - distance, name + distance} & by_class.keys():
            bins = [a + b for a, b in zip(bins, by_class[other])]
        if sum(bins[half:]) >= battery.enough:
            return bins, True
    return bins, False


def least_p(bins: list[int], battery: Battery) -> float | None:
    """The smallest p above which the estimated share of false discoveries is at most ``max_false``."""
    random, left = 2 * sum(bins[battery.bins // 2 :]), sum(bins)
    for i, count in enumerate(bins):
        if left and random and 1 - random * (1 - i / battery.bins) / left <= battery.max_false:
            return i / battery.bins
        left -= count
    return None


def scan(docs: DataFrame, least: dict[int, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, ``base`` (spans of the known kinds) and ``random`` (further spans); a span is (start, rank, end, kind)."""
    rows = id_and_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    for name, pattern in KINDS:
        rows = with_matches(rows, name, pattern)
    rows = with_matches(rows, "random", CANDIDATE)

    def spans(name: str, rank: int, good) -> Column:
        made = F.transform(F.col(f"{name}_m"), lambda m, i: F.struct(
            F.get(F.col(f"{name}_s"), i).alias("start"), F.lit(rank).alias("rank"),
            (F.get(F.col(f"{name}_s"), i) + F.length(m)).alias("end"), F.lit(name).alias("kind"), good(m).alias("good")))
        kept = F.filter(made, lambda s: s["good"])
        return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))

    long = lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= MIN_VALUE
    always = lambda m: F.lit(True)
    base = F.array_sort(F.concat(spans("assign", 0, long), spans("access", 1, always), spans("hex", 2, always)))

    def passes(m: Column) -> Column:
        chain = F.lit(None).cast("double")
        for name, p in sorted(least.items()):
            chain = F.when(length_class(m) == name, F.lit(float(p))).otherwise(chain)
        return F.coalesce(randomness(m) >= chain, F.lit(False))

    rows = rows.select("id", base.alias("base"), spans("random", len(KINDS), passes).alias("random") if least else
                       F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>").alias("random"))
    apart = F.filter("random", lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    return rows.select(F.col("id").alias(id_col), "base", apart.alias("random"))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
