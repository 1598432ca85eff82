"""Secret scans in DataFrame functions alone: fixed patterns, and a battery of randomness tests.

The battery looks at tokens of 20 characters and more, outside the spans of the fixed patterns, that mix letters and digits, or upper and
lower case as often as random letters do (names in camel case seldom do); UUIDs, which name things, are none. Each
gets the encoding that its characters allow (hex, base32 and base36 in one case, also in groups joined by - or _, base62, base64), is read as numbers in that alphabet, and is tested for
randomness three times: chi-squared for uniform use of the alphabet, the runs test about the middle, and lag-one serial
correlation. Fisher's method joins the three p-values; a token stands as random if the joined one is at least LEVEL.

What is reported must also be unlike readable text, with false discoveries controlled: letters and numbers of a readable token
follow READABLE, so the sum of their log ratios against uniform signs has a known mean and spread for each length. How far
below it a token lies gives its p-value (1 for tokens that do not stand). In each stratum, encoding and length
class, the Benjamini-Hochberg procedure over the whole corpus reports those that stay below false-discovery rate Q. Short
tokens must therefore lie further out, and a single odd name among many readable ones is not reported.

Defined cases: a null text is empty (no spans; the digest of the empty string); positions count code points, ends are exclusive;
spans go by start, then kind (assign, access, hex, random); tokens of one p-value are reported together or not at all;
repeated rows are scanned each; a text of any length is scanned whole; a corpus without candidates has no strata and
reports none; an empty table gives no rows; other columns are not read, and redact() hands them on whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.llm._spark import saved, whole

#: The base patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
MIN_VALUE = 12
KINDS = ("assign", "access", "hex", "random")

#: The alphabets of the encodings, from the narrowest.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
}
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
UUID = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
#: Changes of case a character from which a token without digits is a candidate; random letters have one in two.
TURNS = 0.4
#: Production parameters: false-discovery rate of what is reported; level of the randomness tests; length classes by power of two, the last open; places of -log10 p (100 to a decade, 30 decades).
Q, LEVEL, CLASSES, BINS = 0.001, 0.01, 5, 3000
#: Per cent of each letter, a to z, in English text; and of numbers among the letters and numbers of a readable name.
READABLE = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074)
NUMBER = 0.03
#: Names differ more from each other than draws of single letters would: their spread over that of such draws.
SPREAD = 1.6


def _spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """array<struct<s, k, e>> of the matches whose group has at least that many characters."""
    empty = F.array().cast("array<struct<s:int,k:int,e:int>>")
    gaps, hits, inner = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit"), inner.alias("inner"))
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["gap"])
        e = s + F.length(x["hit"])
        one = F.array(F.struct(s.alias("s"), F.lit(kind).alias("k"), e.alias("e")))
        return F.struct(e.alias("at"), F.when(F.length(x["inner"]) >= least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(parts, start, step, lambda acc: acc["out"])).otherwise(empty)


def normal_tail(z: Column) -> Column:
    """P(N > z), by the five-term polynomial in 1 / (1 + 0.2316419 z) (error below 1e-7)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _let(value: Column, then) -> Column:
    """then(value), with value worked out once for all its uses."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _total(a: Column, f) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + f(v))


def _surprise(p: Column) -> Column:
    return -F.log(F.greatest(p, F.lit(1e-12)))


def _two_sided(z: Column) -> Column:
    return _let(z, lambda v: _surprise(2 * normal_tail(F.abs(v))))


def _uniform(c: Column, k: Column, n: Column) -> Column:
    """Chi-squared test of the use of k signs, upper tail, by the Wilson-Hilferty cube root."""
    squares = _total(F.array_distinct(c), lambda d: F.pow(F.size(F.filter(c, lambda v: v == d)).cast("double"), F.lit(2.0)))
    z = _let(F.struct(squares.alias("q"), (2 / (9 * (k - 1))).alias("w")), lambda x: (F.cbrt(F.greatest(k / n * x["q"] - n, F.lit(0.0)) / (k - 1)) - 1 + x["w"]) / F.sqrt(x["w"]))
    return _let(z, lambda v: _surprise(normal_tail(v)))


def _runs(c: Column, k: Column, n: Column) -> Column:
    """Wald-Wolfowitz runs above and below the middle of the alphabet."""
    high = F.transform(c, lambda v: (v > (k - 1) / 2).cast("double"))

    def z(x: Column) -> Column:
        return F.when(x["var"] > 0, (x["runs"] - x["mean"]) / F.sqrt(x["var"])).otherwise(F.sqrt(n))

    def moments(x: Column) -> Column:
        return _let(2 * x["n1"] * (n - x["n1"]) / n + 1, lambda m: _let(F.struct(x["runs"].alias("runs"), m.alias("mean"), ((m - 1) * (m - 2) / F.greatest(n - 1, F.lit(1.0))).alias("var")), z))

    def counted(h: Column) -> Column:
        changes = F.zip_with(F.slice(h, 1, F.size(h) - 1), F.slice(h, 2, F.size(h) - 1), lambda a, b: F.abs(a - b))
        return _let(F.struct((1 + _total(changes, lambda v: v)).alias("runs"), _total(h, lambda v: v).alias("n1")), moments)

    return _two_sided(_let(high, counted))


def _serial(c: Column, n: Column) -> Column:
    """Lag-one serial correlation, about -1 / n for random signs."""

    def z(d: Column) -> Column:
        products = F.zip_with(F.slice(d, 1, F.size(d) - 1), F.slice(d, 2, F.size(d) - 1), lambda a, b: a * b)
        return _let(F.struct(_total(d, lambda v: v * v).alias("all"), _total(products, lambda v: v).alias("lag")), lambda x: F.when(x["all"] > 0, (x["lag"] / x["all"] + 1 / n) * F.sqrt(n)).otherwise(F.sqrt(n)))

    return _two_sided(_let(_let(_total(c, lambda v: v) / n, lambda m: F.transform(c, lambda v: v - m)), z))


def battery(token: Column) -> Column:
    """struct<encoding string, p double>: the encoding, and Fisher's p-value for randomness."""
    ungrouped = F.regexp_replace(token, "[-_]", "")
    one_case = F.when(ungrouped.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(ungrouped.rlike("^([A-Z2-7]+|[a-z2-7]+)$"), "base32").when(ungrouped.rlike("^([0-9a-z]+|[0-9A-Z]+)$"), "base36")
    encoding = F.coalesce(one_case, F.when(token.rlike("^[0-9A-Za-z]+$"), "base62").otherwise("base64"))
    letters = F.create_map(*(F.lit(v) for kv in ALPHABETS.items() for v in kv))

    def coded(x: Column) -> Column:
        bare = F.regexp_replace(x["token"], "[-_]", "")
        plain = F.when(x["encoding"] == "base32", F.upper(bare)).when(x["encoding"].isin("hex", "base36"), F.lower(bare)).otherwise(x["token"])
        return F.transform(F.filter(F.split(plain, ""), lambda ch: ch != ""), lambda ch: (F.instr(letters[x["encoding"]], ch) - 1).cast("double"))

    def joined(y: Column) -> Column:
        surprise = _uniform(y["c"], y["k"], y["n"]) + _runs(y["c"], y["k"], y["n"]) + _serial(y["c"], y["n"])
        return _let(surprise, lambda v: F.exp(-v) * (1 + v + v * v / 2))  # chi-squared with six degrees of freedom

    def tests(x: Column) -> Column:
        return _let(coded(x), lambda c: joined(F.struct(c.alias("c"), F.length(letters[x["encoding"]]).cast("double").alias("k"), F.size(c).cast("double").alias("n"))))

    return _let(F.struct(encoding.alias("encoding"), token.alias("token")), lambda x: F.struct(x["encoding"].alias("encoding"), tests(x).alias("p")))


def _readable() -> tuple[list[float], float, float]:
    """Log ratio of each letter and of a number (readable against uniform signs), and their mean and deviation in readable tokens."""
    share = [(1 - NUMBER) * v / sum(READABLE) for v in READABLE] + [NUMBER]
    ratio = [math.log(v / u) for v, u in zip(share, [2 / 62] * 26 + [10 / 62], strict=True)]
    mean = sum(v * r for v, r in zip(share, ratio, strict=True))
    return ratio, mean, SPREAD * math.sqrt(sum(v * (r - mean) ** 2 for v, r in zip(share, ratio, strict=True)))


def unlike_text(token: Column) -> Column:
    """The chance of a readable token of as many letters and numbers (runs of digits) to lie as far from text as this one."""
    ratio, mean, deviation = _readable()
    signs, values = F.lit("abcdefghijklmnopqrstuvwxyz#"), F.array(*map(F.lit, ratio))
    plain = F.regexp_replace(F.regexp_replace(F.lower(token), "[0-9]+", "#"), "[^a-z#]", "")
    places = F.transform(F.filter(F.split(plain, ""), lambda ch: ch != ""), lambda ch: F.instr(signs, ch))

    def tail(a: Column) -> Column:
        return normal_tail((F.size(a) * mean - _total(a, lambda v: F.element_at(values, v))) / (deviation * F.sqrt(F.size(a).cast("double"))))

    return _let(places, tail)


def _found(text: Column) -> list[Column]:
    base = F.array_sort(F.concat(_spans(text, ASSIGN, 0, 2, MIN_VALUE), _spans(text, ACCESS, 1), _spans(text, HEX, 2)))
    return [base.alias("s_base"), _spans(text, TOKEN, 3).alias("s_tokens")]


def _candidates(text: Column, base: Column, tokens: Column) -> Column:
    """array<struct<s, k, e, stratum, bin>> of the tokens outside the base spans that mix letters and digits, or both cases."""
    free = F.filter(tokens, lambda x: ~F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    named = F.transform(free, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), F.substring(text, x["s"] + 1, x["e"] - x["s"]).alias("token")))
    turns = lambda t: F.regexp_count(t, F.lit("[a-z](?=[A-Z])|[A-Z](?=[a-z])"))
    mixed = F.filter(named, lambda x: x["token"].rlike("[A-Za-z]") & ~x["token"].rlike(UUID) & (x["token"].rlike("[0-9]") | (turns(x["token"]) >= TURNS * F.length(x["token"]))))
    tested = F.transform(mixed, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), battery(x["token"]).alias("t"), unlike_text(x["token"]).alias("p")))
    length = lambda x: F.least(F.floor(F.log2((x["e"] - x["s"]) / F.lit(20.0))), F.lit(CLASSES - 1)).cast("string")
    place = lambda x: F.when(x["t"]["p"] < LEVEL, 0).otherwise(F.least(F.floor(-F.log10(F.greatest(x["p"], F.lit(1e-30))) * 100), F.lit(BINS - 1))).cast("int")
    return F.transform(tested, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), F.concat_ws(":", x["t"]["encoding"], length(x)).alias("stratum"), place(x).alias("bin")))


def scanned(docs: DataFrame) -> DataFrame:
    """docs with s_base (spans of the fixed patterns) and s_random (candidates of the battery)."""
    text = F.coalesce(docs["text"], F.lit(""))
    out = docs.select("*", *_found(text))
    return out.withColumn("s_random", F.when(F.size("s_tokens") > 0, _candidates(F.coalesce(docs["text"], F.lit("")), F.col("s_base"), F.col("s_tokens"))).otherwise(F.array().cast("array<struct<s:int,k:int,e:int,stratum:string,bin:int>>"))).drop("s_tokens")


def limits(found: DataFrame, q: float = Q) -> dict[str, int]:
    """For each stratum with reports the least place of -log10 p that Benjamini-Hochberg reports. Strata are at most encodings x length classes, places a fixed number."""
    counts = found.select(F.explode("s_random").alias("x")).groupBy("x.stratum", "x.bin").agg(F.count("*").alias("n"))
    down = Window.partitionBy("stratum").orderBy(F.desc("bin"))
    ranked = counts.withColumn("upto", F.sum("n").over(down)).withColumn("all", F.sum("n").over(Window.partitionBy("stratum")))
    fit = ranked.where((F.col("bin") > 0) & (F.pow(F.lit(10.0), -F.col("bin") / 100) <= q * F.col("upto") / F.col("all")))
    return {r["stratum"]: r["bin"] for r in fit.groupBy("stratum").agg(F.min("bin").alias("bin")).collect()}


def _reported(least: dict[str, int]) -> Column:
    if not least:
        return F.array().cast("array<struct<s:int,k:int,e:int>>")
    limit = F.create_map(*(F.lit(v) for kv in least.items() for v in kv))
    return F.transform(F.filter("s_random", lambda x: F.coalesce(x["bin"] >= limit[x["stratum"]], F.lit(False))), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))


def _line(spans: Column) -> Column:
    kind = F.array(*(F.lit(k) for k in KINDS))
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat(kind[x["k"]], F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))))


def secret_spans(docs: DataFrame, q: float = Q) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random (spans of the battery), n_candidates (tokens it tested) for each row of docs."""
    found = saved(scanned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "s_base", "s_random"))
    random = _reported(limits(found, q))
    count = lambda k: F.size(F.filter("s_base", lambda x: x["k"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_line(F.col("s_base")), 256).alias("base_sha256"), _line(F.array_sort(F.concat("s_base", random))).alias("spans"), F.size(random).cast("long").alias("n_random"), F.size("s_random").cast("long").alias("n_candidates"))


def redact(docs: DataFrame, mark: str = "[secret]", q: float = Q) -> DataFrame:
    """(doc, text): the row of docs as a struct, and its text with every span replaced by the mark; spans that touch or overlap become one. The rows are written once with what the scan found, as the limits need the whole corpus first."""
    found = saved(scanned(docs.select(whole(docs).alias("doc"), "text")).select("doc", "s_base", "s_random"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    spans = found.select("doc", F.col("doc.text").alias("text"), F.array_sort(F.concat("s_base", _reported(limits(found, q)))).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        fresh = (x["s"] > acc["at"]) | ((acc["at"] == 0) & (x["s"] == 0))
        out = F.when(fresh, F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, x["s"] - acc["at"]), F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), out.alias("out"))

    clean = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return spans.select("doc", F.when(F.size("spans") > 0, clean).otherwise(F.col("text")).alias("text"))
