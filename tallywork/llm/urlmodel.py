"""URL filters: host and path rules, and a character language model for the rest.

Two variable-order Markov models, of accepted and of rejected URLs, give each byte of a URL, its query
included, a probability. A context of up to five bytes that was seen counts; it rests on the estimate
of the context one byte shorter, the more so the rarer it was. Contexts are rows of a table that grows with the
URLs. A URL's length-normalised log-likelihood difference is compared with a threshold, calibrated on URLs that the
models have not learned from. Everything is DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallywork.session import staged

ORDER = 5  # bytes of the longest context
BYTES = 256 + 1  # and the end
BEGIN, END = "02", "03"  # marks, in hexadecimal like all bytes of grams
BELIEF = 4.0  # weight of the shorter context's estimate, in observations
KEPT = 5  # one in so many labelled URLs, by hash, calibrates the threshold instead of training
BINS = 400
RANGE = 4.0  # scores are counted in bins over -RANGE .. RANGE to calibrate

UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``host`` and all its subdomains, where the path starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWERED)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def matched(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, as ``(rule, verdict)``; among equally long ones the first."""
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    ordered = sorted(rules, key=lambda r: -len(r.name))
    known = F.array(
        *[F.struct(F.lit(r.host).alias("h"), F.lit(r.path).alias("p"), F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict")) for r in ordered]
    )
    fits = F.filter(
        known,
        lambda r: ((host == r.h) | host.endswith(F.concat(F.lit("."), r.h))) & path.startswith(r.p),
    )
    first = F.get(fits, 0)
    return F.when(first.isNotNull(), F.struct(first.rule.alias("rule"), first.verdict.alias("verdict")))


def grams(text: Column, order: int = ORDER) -> Column:
    """Each byte of the text, and its end, behind the bytes before it: arrays of hexadecimal text."""
    marked = F.concat(F.lit(BEGIN * order), F.hex(text.cast("binary")), F.lit(END))
    last = F.octet_length(text)
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substr(marked, 2 * i + 1, F.lit(2 * order + 2)))


def log_ratios(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """``gram, ratio``: log P(byte | context) of accepted minus that of rejected URLs, for each gram of ``counts``.

    ``counts`` has each distinct ``gram`` with its number ``a`` in accepted and ``r`` in rejected URLs, which may
    both be 0. From the empty context up, an order's estimate rests on that of the order below. A context
    holds at most 257 grams, so its window is small. The joins are merged: no order passes through the driver.
    """
    p = None
    for k in range(order + 1):
        gram = F.right("gram", F.lit(2 * k + 2))
        own = counts.groupBy(gram.alias("gram")).agg(*[F.sum(s).alias(f"n_{s}") for s in "ar"])
        context = Window.partitionBy(F.left("gram", F.lit(2 * k)))
        own = own.select("*", *[F.sum(f"n_{s}").over(context).alias(f"t_{s}") for s in "ar"])
        if p is None:
            own = own.select("*", *[F.lit(1 / BYTES).alias(f"q_{s}") for s in "ar"])
        else:
            below = p.select(F.col("gram").alias("shorter"), *[F.col(f"p_{s}").alias(f"q_{s}") for s in "ar"])
            own = own.withColumn("shorter", F.right("gram", F.lit(2 * k))).join(below.hint("merge"), "shorter")
        p = own.select(
            "gram",
            *[((F.col(f"n_{s}") + BELIEF * F.col(f"q_{s}")) / (F.col(f"t_{s}") + BELIEF)).alias(f"p_{s}") for s in "ar"],
        )
    return p.select("gram", F.log(F.col("p_a") / F.col("p_r")).alias("ratio"))


def scores(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """``row_no, score`` of every row: the mean log-ratio of its bytes, the end included.

    ``rows`` has ``row_no, text, accepted`` (true or false to learn from, else null). Counting aggregates before it shuffles. A gram that a third of all URLs share is one row of the model. The model grows
    with the URLs, so it is never broadcast through the driver: the join shuffles and Spark splits what is skewed.
    """
    each = rows.select("accepted", F.explode(grams(F.col("text"), order)).alias("gram"))
    of = lambda kind: F.count_if(F.col("accepted") == F.lit(kind))
    counts = staged(each.groupBy("gram").agg(of(True).alias("a"), of(False).alias("r")))
    ratios = staged(log_ratios(counts, order))
    asked = rows.select("row_no", F.explode(grams(F.col("text"), order)).alias("gram"))
    met = asked.join(ratios.hint("merge"), "gram")
    return met.groupBy("row_no").agg(F.avg("ratio").alias("score"))


def threshold(scores: DataFrame) -> DataFrame:
    """One row: the score that splits labelled URLs with the least sum of the two error rates.

    ``scores`` has ``score`` and ``accepted``. Scores are counted in BINS fixed bins, so the work
    after the count does not grow. If one side is missing, nothing is rejected (or all is, if only
    rejected URLs are known).
    """
    width = 2 * RANGE / BINS
    place = F.least(F.greatest(F.floor((F.col("score") + RANGE) / width), F.lit(0)), F.lit(BINS - 1))
    bins = scores.groupBy(place.alias("bin")).agg(
        F.count_if(F.col("accepted")).alias("a"), F.count_if(~F.col("accepted")).alias("r")
    )
    whole = Window.partitionBy(F.lit(0))
    below = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    error = F.coalesce(F.sum("a").over(below), F.lit(0)) / F.greatest(F.sum("a").over(whole), F.lit(1)) + (
        1 - F.coalesce(F.sum("r").over(below), F.lit(0)) / F.greatest(F.sum("r").over(whole), F.lit(1))
    )
    missing = F.sum("a").over(whole) == 0
    cut = bins.select(
        F.when(missing, F.lit(1e9))
        .when(F.sum("r").over(whole) == 0, F.lit(-1e9))
        .otherwise(F.col("bin") * width - RANGE)
        .alias("cut"),
        error.alias("error"),
    )
    return cut.agg(F.coalesce(F.min_by("cut", F.struct("error", "cut")), F.lit(-1e9)).alias("cut"))


def judge(
    pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", order: int = ORDER
) -> DataFrame:
    """``page_id, host, path, rule, verdict, score, cut`` of every row.

    The models learn from the URLs that the rules allow and block, but for one in five, which calibrate the
    threshold; every row has its score. A null URL or one without ``://`` has an
    empty host and path and is judged as a text that ends at once. Repeated rows count as often as they
    occur; an empty table gives no rows; without rules, or with one kind only, see ``threshold``.
    """
    url = F.col(url_col)
    rest = F.coalesce(_rest(url), F.lit(""))
    host, path = F.coalesce(host_of(url), F.lit("")), F.coalesce(path_of(url), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), rest.alias("rest"))
    rows = rows.withColumn("found", matched(F.col("host"), F.col("path"), rules))
    text = F.concat("host", F.substr("rest", F.length("host") + 1))
    kept = F.pmod(F.xxhash64("rest"), F.lit(KEPT)) == 0
    allowed = F.col("found.verdict") == "allow"
    rows = rows.select(
        F.monotonically_increasing_id().alias("row_no"),
        "page_id",
        "host",
        "path",
        "found",
        text.alias("text"),
        F.when(~kept, allowed).alias("accepted"),
        (F.col("found").isNotNull() & kept).alias("calibrates"),
    )
    rows = staged(rows)
    scored = staged(rows.drop("text", "accepted").join(scores(rows, order), "row_no"))
    known = scored.where("calibrates").select("score", allowed.alias("accepted"))
    cut = staged(threshold(known))
    judged = scored.withColumn("cut", cut.scalar())
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce(F.col("found.verdict"), F.when(F.col("score") >= F.col("cut"), "allow").otherwise("block")).alias("verdict"),
        "score",
        "cut",
    )
