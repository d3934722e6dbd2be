"""Secret scans: fixed patterns, and a battery of randomness tests for tokens that no pattern knows.

Built-in functions only. One pass over the texts finds the pattern spans, measures the candidates of the battery (runs of letters, digits and
separators with at least MIN_TOKEN letters and digits) and counts the letters of all other text. The null hypothesis of a candidate is ordinary text: letters as
often as the corpus has them, vowels and consonants in turn as in its words, and changes of case and digit no more frequent than in names.
Three statistics of randomness are held against it, for the smallest alphabet that has the candidate's characters:

* chi-squared of the character counts against equal shares, which is large for ordinary text and about its degrees of freedom for random tokens;
* runs of lower case, upper case and digits, of which random tokens of several kinds have more;
* serial correlation of vowels among neighbouring letters, which is negative in words and about zero in random tokens.

Their deviations from ordinary text add up to one normal score and its p-value. Separators (-_+/=) part a token into pieces (words, groups of a
UUID, a vendor's prefix), so the whole without them and its longest piece are both tested, at twice the p-value. A token whose characters follow each
other in the alphabet is a list or a count, not a secret. A false-discovery control (Benjamini and Hochberg) in strata of length, since short tokens
have less power, reports the candidates that aren't ordinary, of which a share of ALPHA may be. Counts by stratum and p-value bin, some 1,600 numbers
whatever the corpus, and one row of letter counts are all that the driver sees.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import emitted

from .common import fresh, let, staged, whole

#: Fixed patterns: kind, regular expression (``+`` where a match may fail), least size of the group that is measured, and the group.
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    ("access", r"AKIA[A-Z0-9]+", 20, 0),
    ("hex", r"[0-9a-f]{24,}", 24, 0),
)
RANDOM = "random"
MIN_TOKEN = 20
#: A value may follow '=' (NAME=value, ?k=value); '=' belongs to a token as padding at its end only.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])"
SEPARATORS = "[-_+/=]+"
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Alphabets from small to large; a token is measured by the first that holds it, and the last one holds all.
ALPHABETS = (DIGITS, DIGITS + "abcdef", DIGITS + "ABCDEF", LOWER, UPPER, UPPER + "234567", LOWER + DIGITS, UPPER + DIGITS, UPPER + LOWER, UPPER + LOWER + DIGITS)
HEX = (1, 2)
#: Share of neighbours in a name that differ in kind (lower case, upper case, digit): of names in both cases, and in one case with digits.
CHANGES = {True: 0.35, False: 0.15}
#: What is known of ordinary text before any is read, counted as so many letters, pairs of letters and digits: English letters in 10,000, vowel pairs, digits in 100.
KNOWN = 100_000
LETTERS = (817, 149, 278, 425, 1270, 223, 202, 609, 697, 15, 77, 403, 241, 675, 751, 193, 10, 599, 633, 906, 276, 98, 236, 15, 197, 7)
VOWEL_PAIRS = 0.07
NUMBERS = (17, 16, 12, 10, 9, 9, 8, 7, 6, 6)
ALPHA = 0.05
#: Places in the alphabet that correlate beyond so many deviations are a count or a list.
MOST_ORDER = 3.5
#: Lower ends of the strata of length.
STRATA = (20, 32, 48, 96)
#: p-values are rounded up to 10 ** (-bin / BINS), with up to MOST_BINS bins.
BINS, MOST_BINS = 20, 400
_SPAN = "struct<start:int,end:int,found:string,ok:boolean>"
_FREE = "array<struct<start:int,end:int,found:string>>"


def _found(text: Column, pattern: str, least: int, group: int) -> Column:
    """Spans (start, end, found) of the matches whose group has ``least`` code points, leftmost and not overlapping.

    The text between two matches and the matches themselves come as arrays; their lengths in code points add up to the places.
    """
    rx = F.lit(pattern)
    matches, between = F.regexp_extract_all(text, rx, F.lit(0)), F.split(text, pattern, -1)
    measured = F.regexp_extract_all(text, rx, F.lit(group)) if group else matches
    zipped = F.arrays_zip(between.alias("gap"), matches.alias("match"), measured.alias("value"))

    def place(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.char_length(x["gap"])
        end = start + F.char_length(F.coalesce(x["match"], F.lit("")))
        ok = F.coalesce(F.char_length(x["value"]) >= least, F.lit(False))
        return end, F.struct(start.alias("start"), end.alias("end"), x["match"].alias("found"), ok.alias("ok")).cast(_SPAN)

    spans = F.filter(emitted(zipped, F.lit(0), place, _SPAN), lambda x: x["ok"])
    return F.when(F.rlike(text, rx), spans).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _times(text: Column, letter: str) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(letter), F.lit("")))


def _upper_tail(z: Column) -> Column:
    """Chance of a standard normal above z: Sampford's upper bound, within a hundredth of it from 1.5 on; 1 for negative z."""
    density = F.exp(-z * z / 2) / 2.5066282746310002
    return F.when(z <= 0, F.lit(1.0)).otherwise(density * 4 / (3 * z + F.sqrt(z * z + 8)))


def _measured(bare: Column) -> Column:
    """What the tests need of a token without separators: size, kinds, alphabet, squares of the counts, runs, vowels among neighbours, order."""
    held = F.lit(len(ALPHABETS) - 1)
    for i in reversed(range(len(ALPHABETS) - 1)):
        held = F.when(F.rlike(bare, F.lit(f"^[{ALPHABETS[i]}]*$")), F.lit(i)).otherwise(held)
    squares = sum((F.pow(_times(bare, c).cast("double"), F.lit(2.0)) for c in ALPHABETS[-1]), F.lit(0.0))
    neighbour = {"pairs": "(?i)[a-z](?=[a-z])", "left": "(?i)[aeiou](?=[a-z])", "right": "(?i)(?<=[a-z])[aeiou]", "both": "(?i)[aeiou](?=[aeiou])"}

    def order(alphabet: Column) -> Column:
        """Serial correlation of the places in the alphabet, in its deviations under randomness."""

        def of(x: Column) -> Column:
            n = F.size(x).cast("double")

            # The centre is bound, not named: a lambda would work it out anew for each element.
            def around(y: Column) -> Column:
                var = F.aggregate(y, F.lit(0.0), lambda acc, v: acc + v * v)
                lag = F.aggregate(F.zip_with(F.slice(y, F.lit(1), F.size(y) - 1), F.slice(y, F.lit(2), F.size(y) - 1), lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
                return let(var, lambda d: F.when(d > 0, F.abs(lag / d + 1 / n) * F.sqrt(n)).otherwise(n))

            centre = F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v) / n
            return let(let(centre, lambda c: F.transform(x, lambda v: v - c)), around)

        return let(F.transform(F.split(bare, ""), lambda c: F.position(c, alphabet).cast("double")), of)

    alphabets = F.array(*map(F.lit, ALPHABETS))
    return F.struct(
        F.char_length(bare).cast("double").alias("n"),
        held.alias("alphabet"),
        *[F.regexp_count(bare, F.lit(f"[{a}-{b}]")).cast("double").alias(name) for name, a, b in (("low", "a", "z"), ("up", "A", "Z"), ("dig", "0", "9"))],
        squares.alias("squares"),
        F.regexp_count(bare, F.lit("[a-z]+|[A-Z]+|[0-9]+")).cast("double").alias("runs"),
        *[F.regexp_count(bare, F.lit(p)).cast("double").alias(k) for k, p in neighbour.items()],
        let(F.get(alphabets, held), order).alias("order"),
    )


@dataclass(frozen=True)
class Ordinary:
    """Ordinary text: letter and digit counts, neighbouring letters and vowels, each with what was known before."""

    letters: tuple[float, ...]
    digits: tuple[float, ...]
    pairs: float
    both: float

    @staticmethod
    def of(counts: list[int | None]) -> Ordinary:
        n = [float(x or 0) for x in counts]
        letters = tuple(a + KNOWN * b / sum(LETTERS) for a, b in zip(n[:26], LETTERS, strict=True))
        return Ordinary(letters, tuple(a + KNOWN * b / 1000 for a, b in zip(n[26:36], NUMBERS, strict=True)), n[36] + KNOWN, n[37] + KNOWN * VOWEL_PAIRS)

    @staticmethod
    def spread(counts: tuple[float, ...]) -> tuple[float, float]:
        """Chance that two draws agree, and three."""
        total = sum(counts)
        return sum((c / total) ** 2 for c in counts), sum((c / total) ** 3 for c in counts)

    def score(self, m: Column) -> Column:
        """Normal score of the measures ``m``: how far the token is from ordinary text towards a random one."""
        (two, three), (hex_two, hex_three), (dig_two, dig_three) = map(self.spread, (self.letters, self.letters[:6], self.digits))
        vowels = sum(self.letters[LOWER.index(c)] for c in "aeiou") / sum(self.letters)
        turn = (self.both / self.pairs - vowels**2) / (vowels * (1 - vowels))
        n, is_hex = m["n"], m["alphabet"].isin(*HEX)

        def agree(power: int, of_letters: Column, of_digits: float) -> Column:
            return (F.pow(m["low"] / n, F.lit(power)) + F.pow(m["up"] / n, F.lit(power))) * of_letters + F.pow(m["dig"] / n, F.lit(power)) * of_digits

        mean = agree(2, F.when(is_hex, hex_two).otherwise(two), dig_two)
        shared = F.greatest(agree(3, F.when(is_hex, hex_three).otherwise(three), dig_three) - mean * mean, F.lit(0.0))
        spread = F.sqrt((2 * mean * (1 - mean) + 4 * (n - 2) * shared) / (n * (n - 1)))
        # Chi-squared is k / n * squares - n, which grows with the share of equal pairs alone.
        even = (mean - (m["squares"] - n) / (n * (n - 1))) / spread
        kinds = sum(((m[k] > 0).cast("int") for k in ("low", "up", "dig")), F.lit(0))
        change = F.when((m["low"] > 0) & (m["up"] > 0), F.lit(CHANGES[True])).otherwise(F.lit(CHANGES[False]))
        runs = F.when(kinds > 1, (m["runs"] - 1 - (n - 1) * change) / F.sqrt((n - 1) * change * (1 - change)))
        serial = (m["both"] - vowels * (m["left"] + m["right"]) + m["pairs"] * vowels**2) / (m["pairs"] * vowels * (1 - vowels))
        turns = F.when((m["pairs"] >= 6) & ~is_hex, (serial - turn) * F.sqrt(m["pairs"]))
        tests = [even, runs, turns]
        total = sum((F.coalesce(t, F.lit(0.0)) for t in tests), F.lit(0.0)) / F.sqrt(sum((t.isNotNull().cast("int") for t in tests), F.lit(0)))
        return F.when(m["order"] > MOST_ORDER, F.lit(-10.0)).otherwise(total)


def apart(tokens: Column, base: Column) -> Column:
    """The tokens (start, end, found) that overlap no base span: one sort of all spans, a walk forward and one back."""
    kind = "struct<start:int,rank:int,end:int,found:string>"
    both = F.array_sort(
        F.concat(
            F.transform(base, lambda b: F.struct(b["start"].alias("start"), F.lit(0).alias("rank"), b["end"].alias("end"), F.lit(None).alias("found")).cast(kind)),
            F.transform(tokens, lambda x: F.struct(x["start"].alias("start"), F.lit(1).alias("rank"), x["end"].alias("end"), x["found"].alias("found")).cast(kind)),
        )
    )

    def forward(reach: Column, x: Column) -> tuple[Column, Column]:
        is_base = x["rank"] == 0
        free = F.struct(x["start"].alias("start"), F.when(is_base | (x["start"] < reach), 0).otherwise(1).alias("rank"), x["end"].alias("end"), x["found"].alias("found")).cast(kind)
        return F.when(is_base, F.greatest(reach, x["end"])).otherwise(reach), free

    def backward(ahead: Column, x: Column) -> tuple[Column, Column]:
        # Walked from the last one: the least start of a base span that comes after.
        free = F.struct(x["start"].alias("start"), F.when((x["rank"] == 1) & (x["end"] <= ahead), 1).otherwise(0).alias("rank"), x["end"].alias("end"), x["found"].alias("found")).cast(kind)
        return F.when(x["rank"] == 2, x["start"]).otherwise(ahead), free

    marked = emitted(both, F.lit(0), forward, kind)
    # Base spans are told apart from tokens that a span before them covers by a rank of their own.
    ranked = F.zip_with(both, marked, lambda b, m: F.struct(b["start"].alias("start"), F.when(b["rank"] == 0, 2).otherwise(m["rank"]).alias("rank"), b["end"].alias("end"), b["found"].alias("found")).cast(kind))
    done = emitted(F.reverse(ranked), F.lit(2147483647), backward, kind)
    return F.filter(done, lambda x: x["rank"] == 1)


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with ``base`` (array of start, end, kind, rank), ``tokens`` apart from those (start, end, size, tests) and ``counts`` (letters, digits, pairs) more.

    Places are code points, ends exclusive. Null and empty texts have none. Columns of the three names are replaced.
    """
    t = whole(F.col(text))

    def kind(name: str, pattern: str, least: int, group: int, rank: int) -> Column:
        return F.transform(_found(t, pattern, least, group), lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(name).alias("kind"), x["end"].alias("end")))

    def measured(x: Column) -> Column:
        pieces = F.filter(F.split(x["found"], SEPARATORS), lambda p: p != "")
        longest = F.aggregate(pieces, F.lit(""), lambda acc, p: F.when(F.char_length(p) > F.char_length(acc), p).otherwise(acc))
        own = F.filter(F.array_distinct(F.array(F.array_join(pieces, ""), longest)), lambda p: F.char_length(p) >= MIN_TOKEN)
        return let(own, lambda o: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.char_length(F.get(o, F.lit(0))).alias("size"), F.transform(o, _measured).alias("tests")))

    def counted(low: Column) -> Column:
        pairs = [F.regexp_count(low, F.lit(p)) for p in ("[a-z](?=[a-z])", "[aeiou](?=[aeiou])")]
        return F.array(*[c.cast("long") for c in [*(_times(low, c) for c in LOWER + DIGITS), *pairs]])

    def with_tokens(base: Column) -> Column:
        candidates = _found(t, TOKEN, MIN_TOKEN, 0)
        free = let(candidates, lambda c: F.when(F.size(c) == 0, F.array().cast(_FREE)).otherwise(F.transform(apart(c, base), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["found"].alias("found")))))
        return F.struct(base.alias("base"), F.filter(F.transform(free, measured), lambda x: F.size(x["tests"]) > 0).alias("tokens"))

    base = F.array_sort(F.concat(*[kind(*k, rank) for rank, k in enumerate(KINDS)]))
    counts = let(F.lower(F.regexp_replace(t, TOKEN, " ")), counted)
    own = [c for c in docs.columns if c not in (text, "base", "tokens", "counts")]
    (f,) = fresh(own, "found")
    both = docs.select(*own, let(base, with_tokens).alias(f), counts.alias("counts"))
    return both.select(*own, F.col(f)["base"].alias("base"), F.col(f)["tokens"].alias("tokens"), "counts")


def ordinary(found: DataFrame) -> Ordinary:
    """The letter counts of all texts, as one row."""
    return Ordinary.of(list(found.agg(*[F.sum(F.get("counts", F.lit(i))) for i in range(38)]).collect()[0]))


def with_bins(found: DataFrame, text: Ordinary) -> DataFrame:
    """``tokens`` as start, end, stratum and bin of the p-value."""

    def judged(x: Column) -> Column:
        p = F.least(F.lit(1.0), F.size(x["tests"]) * _upper_tail(F.array_max(F.transform(x["tests"], text.score))))
        stratum = sum((F.when(x["size"] >= low, 1).otherwise(0) for low in STRATA[1:]), F.lit(0))
        bin_ = F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) * BINS), F.lit(MOST_BINS)).cast("int")
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), stratum.alias("stratum"), bin_.alias("bin"))

    return found.withColumn("tokens", F.transform("tokens", judged))


def reported_from(found: DataFrame) -> list[int]:
    """For each stratum the least bin that the false-discovery control reports (MOST_BINS + 1: none)."""
    counts = found.select(F.explode("tokens").alias("t")).groupBy("t.stratum", "t.bin").agg(F.count("*").alias("n")).collect()
    by: dict[int, dict[int, int]] = defaultdict(dict)
    for r in counts:
        by[r.stratum][r.bin] = r.n
    out = []
    for stratum in range(len(STRATA)):
        total, above, first = sum(by[stratum].values()), 0, MOST_BINS + 1
        for b in sorted(by[stratum], reverse=True):
            above += by[stratum][b]
            if 10 ** (-b / BINS) <= ALPHA * above / total:
                first = b
        out.append(first)
    return out


def secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with ``base`` and ``spans`` (arrays of start, rank, kind, end in the order of start, then kind) more.

    ``base`` holds the pattern spans, ``spans`` those and the random tokens that overlap none of them. A token's verdict depends on all tokens of
    its length in the table, as false-discovery control does, and on the letters of all texts; an empty table, and texts without candidates, give empty
    arrays. Repeated rows count as often as they come. Columns named base, spans, tokens or counts are replaced.
    """
    found = staged(scanned(docs, text), "secrets")
    binned = with_bins(found.drop("counts"), ordinary(found))
    first = F.array(*[F.lit(b) for b in reported_from(binned)])
    free = F.filter("tokens", lambda x: x["bin"] >= F.get(first, x["stratum"]))
    random = F.transform(free, lambda x: F.struct(x["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), F.lit(RANDOM).alias("kind"), x["end"].alias("end")))
    return binned.withColumn("spans", F.array_sort(F.concat("base", random))).drop("tokens")


def spelled(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op1_secrets(spark, sf_dir: str) -> DataFrame:
    found = secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind, *_ in KINDS]
    return found.select("doc_id", *counts, F.sha2(F.encode(spelled(F.col("base")), "UTF-8"), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))
