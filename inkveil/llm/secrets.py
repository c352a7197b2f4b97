"""Secrets in texts: known forms, and strings that look drawn at random.

Known forms are patterns (assignments, access keys, long hexadecimal numbers). Further candidates are runs of
at least ``MIN_LENGTH`` characters of the usual encodings. For each the smallest encoding that has all its characters is
taken, and four tests ask whether its symbols are drawn uniformly from that alphabet:

* chi-squared over the symbols of the alphabet, and over its lower-case, upper-case and other symbols,
* runs above and below the middle of the alphabet,
* serial correlation of neighbouring symbols.

Each gives a p-value; the smallest of the four gives the candidate's, corrected for being the smallest. Under
random drawing p-values are uniform, while words, paths and identifiers have theirs near zero. So within a
stratum of encoding and length (by doubling), the candidates with p over one half tell how many are random, and
all with p of at least ``t`` are called secrets for the least ``t`` at which the others among them are
estimated to be at most ``FALSE_SHARE``. Longer candidates are tested with more power and are judged among
themselves; below ``LEAST_P`` none is called. Candidates are counted once each, whatever the number of their copies.

All of it is native: expressions on the text's own row, and counts per stratum and hundredth of p, a table
of bounded size.

Defined cases: null and empty texts have no secrets; texts of any length are searched whole; a candidate that
overlaps a known form adds nothing; plain numbers are no candidates; padding ``=`` belongs to the span but is not tested;
positions are code points; rows are returned as often as they come, with their ids as they are, null too; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.functions import sql as X
from inkveil.functions.arrays import empty, let
from inkveil.functions.spans import find_spans, unshadowed
from inkveil.functions.sql import Expr
from inkveil.llm.shared import stored

# The known forms, each with the part that is measured and the length it needs.
NAMES = ["password", "passwd", "secret", "token", "api_?key"]
VALUE = "[A-Za-z0-9+/_.=-]+"


def any_case(name: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in name)


ASSIGN = rf"""(?=[PSTApsta])({'|'.join(map(any_case, NAMES))})["']?\x20*[:=]\x20*["']?({VALUE})"""
# A run that is too short holds no longer one, so the patterns of the last two may ask for their length at once;
# an assignment may hide another one and is matched whole before its value is measured.
FORMS = [("assign", ASSIGN, 2, 8), ("access", "AKIA[A-Z0-9]{12,}", 0, 16), ("hex", "(?<![0-9a-f])[0-9a-f]{32,}", 0, 32)]
#: Kinds of spans in the order they are listed in.
KINDS = [*(f[0] for f in FORMS), "random"]

MIN_LENGTH = 20
#: Share of wrongly called candidates that is accepted in a stratum.
FALSE_SHARE = 0.1
LEAST_P = 0.01
#: Candidates with a larger p are nearly all random ones.
UPPER_P = 0.5
BINS = 100

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Alphabets from the smallest on, in the order of their symbols' values.
ENCODINGS = {
    "hex": DIGITS + LOWER[:6],
    "upper hex": DIGITS + UPPER[:6],
    "base32": UPPER + "234567",
    "base36": DIGITS + LOWER,
    "upper base36": DIGITS + UPPER,
    "base62": DIGITS + UPPER + LOWER,
    "base64": UPPER + LOWER + DIGITS + "+/",
    "base64url": UPPER + LOWER + DIGITS + "-_",
}
_RUN = "A-Za-z0-9+/_-"
CANDIDATE = f"(?<![{_RUN}])[{_RUN}]{{{MIN_LENGTH},}}+={{0,2}}"
CANDIDATE_TYPE = "struct<start_pos:int,end_pos:int,stratum:int,bin:int,token:bigint>"
SPAN_TYPE = "struct<start_pos:int,kind:int,end_pos:int>"


def upper_tail(z: Expr) -> Expr:
    """Probability that a standard normal variable exceeds ``z``, by a polynomial (within 1e-7)."""
    # Coefficients of the approximation.
    b = [0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429]

    def of(z: Expr) -> Expr:
        t = Expr(f"(1 / (1 + 0.2316419D * abs({z.sql})))")

        def tail(t: Expr) -> Expr:
            poly = X.lit(0.0)
            for c in reversed(b):
                poly = (poly + X.lit(c)) * t
            area = Expr(f"(exp(- {z.sql} * {z.sql} / 2) / sqrt(2 * pi()) * {poly.sql})")
            return X.when(Expr(f"({z.sql} >= 0)"), area).otherwise(1.0 - area)

        return let(t, tail)

    return let(z, of)


def chi_squared_tail(x: Expr, freedom: Expr) -> Expr:
    """Upper tail of a chi-squared variable, by the cube root that makes it normal."""
    v, d = x.sql, freedom.sql
    return upper_tail(Expr(f"((cbrt({v} / {d}) - (1 - 2 / (9 * {d}))) / sqrt(2 / (9 * {d})))"))


def encoding_of(core: Expr) -> Expr:
    """Number of the smallest encoding that has all characters; null for plain numbers and others."""
    arms = X.when(core.rlike("^[0-9]+$"), None)
    for number, alphabet in enumerate(ENCODINGS.values()):
        own = "".join("\\" + c if c in "-+/" else c for c in alphabet)
        arms = arms.when(core.rlike(f"^[{own}]+$"), number)
    return arms.otherwise(None)


def _of_encoding(number: Expr, values: list) -> Expr:
    return X.element_at(X.array(*map(X.lit, values)), number + 1)


def randomness(core: Expr, encoding: Expr) -> Expr:
    """p-value of the test battery for a string in an encoding."""
    alphabets = list(ENCODINGS.values())
    shares = [[sum(c in part for c in a) / len(a) for a in alphabets] for part in (LOWER, UPPER)]
    classes = [float(sum(s[i] > 0 for s in shares)) for i in range(len(alphabets))]  # degrees of freedom

    def codes(alphabet: Expr) -> Expr:
        return X.transform(X.split(core, ""), lambda c: X.instr(alphabet, c) - 1)

    def tests(e: Expr) -> Expr:
        xs, k, n = e["codes"], e["k"], e["n"]

        def count(acc: Expr, x: Expr) -> Expr:
            again = acc["last"] == x
            run = X.when(again, acc["run"] + 1).otherwise(1)
            more = X.when(again, acc["run"].cast("double") * 2.0 + 1.0).otherwise(1.0)
            return X.struct(x.alias("last"), run.alias("run"), (acc["squares"] + more).alias("squares"))

        start = X.struct(X.lit(-1).alias("last"), X.lit(0).alias("run"), X.lit(0.0).alias("squares"))
        squares = X.aggregate(X.sort_array(xs), start, count, lambda acc: acc["squares"])
        pairs = X.zip_with(X.slice(xs, 1, n - 1), X.slice(xs, 2, n - 1), lambda a, b: X.struct(a.alias("a"), b.alias("b")))

        def step(acc: Expr, p: Expr) -> Expr:
            high = Expr(f"(2 * {p['a'].sql} >= {k.sql})") != Expr(f"(2 * {p['b'].sql} >= {k.sql})")
            product = Expr(f"(({p['a'].sql} - ({k.sql} - 1) / 2D) * ({p['b'].sql} - ({k.sql} - 1) / 2D))")
            return X.struct((acc["changes"] + X.when(high, 1).otherwise(0)).alias("changes"), (acc["sum"] + product).alias("sum"))

        follow = X.aggregate(pairs, X.struct(X.lit(0).alias("changes"), X.lit(0.0).alias("sum")), step)

        def combined(s: Expr) -> Expr:
            size, symbols = f"{n.sql}", f"{k.sql}"
            mean, spread = f"({symbols} - 1)", f"(2D * ({symbols} - 1) * ({size} - 1) / {size})"
            free = f"(2D * {mean} * {mean} / {spread})"
            of_symbols = Expr(f"(({symbols} * {s['squares'].sql} / {size} - {size}) * {free} / {mean})")

            def off(seen: Expr, share: Expr) -> str:
                due = f"({size} * {share.sql})"
                return f"(case when {share.sql} > 0 then ({seen.sql} - {due}) * ({seen.sql} - {due}) / {due} else 0D end)"

            lower, upper = (X.length(X.regexp_replace(core, pattern, "")) for pattern in ("[^a-z]", "[^A-Z]"))
            share_l, share_u = (_of_encoding(encoding, values) for values in shares)
            rest = Expr(f"(1D - {share_l.sql} - {share_u.sql})")
            of_classes = Expr(f"({off(lower, share_l)} + {off(upper, share_u)} + {off(n - lower - upper, rest)})")
            runs = Expr(f"(abs({s['follow']['changes'].sql} - ({size} - 1) / 2D) / sqrt(({size} - 1) / 4D))")
            serial = Expr(f"(abs({s['follow']['sum'].sql}) * 12 / ({symbols} * {symbols} - 1) / sqrt({size} - 1D))")
            least = X.least(
                chi_squared_tail(of_symbols, Expr(free)),
                chi_squared_tail(of_classes, _of_encoding(encoding, classes)),
                upper_tail(runs) * 2.0,
                upper_tail(serial) * 2.0,
            )
            return Expr(f"(1 - pow(1 - least(1D, {least.sql}), 4))")

        return let(X.struct(squares.alias("squares"), follow.alias("follow")), combined)

    alphabet = _of_encoding(encoding, alphabets)
    e = X.struct(
        codes(alphabet).alias("codes"), X.length(alphabet).cast("double").alias("k"), X.length(core).alias("n")
    )
    return let(e, tests)


def known_spans(text: Expr) -> Expr:
    """Spans of the known forms."""

    def of(kind: int, regex: str, group: int, least: int) -> Expr:
        def long(span: Expr) -> Expr:
            measured = X.regexp_extract(span["value"], regex, group) if group else span["value"]
            return Expr(f"(length({measured.sql}) >= {least})")

        def span(s: Expr) -> Expr:
            return X.struct(s["start_pos"].alias("start_pos"), X.lit(kind).alias("kind"), s["end_pos"].alias("end_pos"))

        return X.transform(X.filter(find_spans(text, regex), long), span)

    found = [of(kind, *form[1:]) for kind, form in enumerate(FORMS)]
    return X.sort_array(X.concat(*found)).cast(f"array<{SPAN_TYPE}>")


def candidates(text: Expr, known: Expr) -> Expr:
    """Strings in some encoding that overlap none of ``known``, with their stratum and hundredth of p."""

    def ranked(spans: Expr, rank: int, value: Expr | None = None) -> Expr:
        return X.transform(
            spans,
            lambda s: X.struct(
                s["start_pos"].alias("start_pos"), s["end_pos"].alias("end_pos"), X.lit(rank).alias("rank"),
                (X.lit("") if value is None else s["value"]).alias("value"),
            ),
        )

    clear = unshadowed(X.sort_array(X.concat(ranked(known, 0), ranked(find_spans(text, CANDIDATE), 1, text))))

    def told(x: Expr) -> Expr:
        def of(core: Expr) -> Expr:
            def tested(number: Expr) -> Expr:
                p = randomness(core, number)
                stratum = Expr(f"({number.sql} * 32 + cast(floor(log2(length({core.sql}))) as int))")
                made = X.struct(
                    x["start_pos"].alias("start_pos"), x["end_pos"].alias("end_pos"), stratum.alias("stratum"),
                    Expr(f"cast(least({BINS - 1}, floor({p.sql} * {BINS})) as int)").alias("bin"), X.xxhash64(x["value"]).alias("token"),
                )
                return X.when(number.isNotNull() & Expr(f"(length({core.sql}) >= {MIN_LENGTH})"), made)

            return let(encoding_of(core), tested)

        return let(X.regexp_replace(x["value"], "=+$", ""), of)

    all_ = X.transform(X.filter(clear, lambda x: x["rank"] == 1), told)
    return X.filter(all_, lambda c: c.isNotNull()).cast(f"array<{CANDIDATE_TYPE}>")


def found_in(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``known`` and ``candidates`` of every row."""
    text = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    known = text.withColumn("known", known_spans(X.col("text")).column)
    long = X.col("text").rlike(f"(?<![{_RUN}])[{_RUN}]{{{MIN_LENGTH}}}")
    some = X.when(long, candidates(X.col("text"), X.col("known"))).otherwise(empty(CANDIDATE_TYPE))
    return known.select("id", "known", some.column.alias("candidates"))


def thresholds(found: DataFrame, false_share: float = FALSE_SHARE) -> DataFrame:
    """``stratum`` and ``least``: the hundredth of p from which on candidates are called random."""
    each = found.select(F.explode("candidates").alias("c")).select("c.stratum", "c.bin", "c.token").distinct()
    bins = each.groupBy("stratum", "bin").agg(F.count("*").alias("n"))
    over = Window.partitionBy("stratum")
    upper = F.sum(F.when(F.col("bin") >= int(UPPER_P * BINS), F.col("n")).otherwise(0)).over(over) / (1 - UPPER_P)
    called = F.sum("n").over(over.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0))
    rated = bins.select("stratum", "bin", upper.alias("random"), called.alias("called"))
    wrong = F.col("called") - F.col("random") * (1 - F.col("bin") / BINS)
    fair = (F.col("bin") >= int(LEAST_P * BINS)) & (wrong <= F.col("called") * false_share)
    return rated.where(fair).groupBy("stratum").agg(F.min("bin").alias("least"))


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", false_share: float = FALSE_SHARE
) -> DataFrame:
    """``id_col`` and ``spans`` (start_pos, kind, end_pos), in order; ``kind`` is a place in ``KINDS``.

    Texts are read once: what is found in them is stored, and the thresholds, at most one per encoding and
    doubling of the length, go into the plan of the second step.
    """
    found = stored(found_in(docs, id_col, text_col), "secrets-found")
    least = thresholds(found, false_share).agg(F.map_from_entries(F.collect_list(F.struct("stratum", "least"))).alias("m")).scalar()
    ruled = found.withColumn("least", least)
    called = F.filter("candidates", lambda c: c["bin"] >= F.coalesce(F.try_element_at("least", c["stratum"]), F.lit(BINS)))
    random = F.transform(
        called, lambda c: F.struct(c["start_pos"].alias("start_pos"), F.lit(len(FORMS)).alias("kind"), c["end_pos"].alias("end_pos"))
    )
    return ruled.select(F.col("id").alias(id_col), F.sort_array(F.concat("known", random.cast(f"array<{SPAN_TYPE}>"))).alias("spans"))


def spelt(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    name = F.array(*map(F.lit, KINDS))
    one = F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start_pos"].cast("string"), s["end_pos"].cast("string")))
    return F.array_join(one, ",")
