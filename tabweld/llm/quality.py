"""Quality rules by weak supervision: rules vote or abstain, EM learns how far to trust each.

Every rule looks at one measure of a text and votes good (1), bad (-1) or abstains (0). The
documents are counted by their pattern of votes, and expectation-maximisation over the patterns
estimates the share of good documents and, for each rule, how often it votes good or bad on
good and on bad documents. A document stays if its posterior probability of being good is at
least one half, and if it passes the two hard limits (``base_failed``).

All measures are array and string functions on one row; whole texts are read, in time close to
linear in their length. The pattern table has at most ``3 ** len(RULES)`` rows at any input size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweld.llm.common import WHITE, replaced, whole_text, with_row
from tabweld.session import materialize

SYMBOLS = "#*$%&|<>"
UPPER = "A-Z"
MIN_WORDS = 50
MOST_REPEATED = 50

#: What texts are written in: letters with their marks, and digits.
ALPHANUMERIC = r"\p{L}\p{M}\p{N}"

#: EM: rounds; share of good documents and vote rates to begin with (good votes on good documents,
#: bad votes on bad ones), the same for all rules. At least half of the documents are taken to be
#: good, which says which of the two classes is which. The rates have no bounds: one vote of each
#: kind is added to what is counted, so that no rate is 0 or 1.
ROUNDS = 20
FIRST_SHARE = 0.8
FIRST_GOOD, FIRST_BAD = 0.95, 0.5
SHARES = (0.5, 0.9999)

#: A rule votes bad if the first condition holds, else good if the second does, else abstains.
#: Spark SQL and DuckDB both read these.
RULES: dict[str, tuple[str, str]] = {
    "symbols": ("20 * n_symbols > n_words", "100 * n_symbols <= n_words"),
    "letters": ("100 * n_alnum < 90 * word_chars", "100 * n_alnum >= 95 * word_chars"),
    "bare_words": ("10 * n_bare > n_words", "50 * n_bare <= n_words"),
    "word_length": ("word_chars < 3 * n_words OR word_chars > 7 * n_words", "2 * word_chars >= 9 * n_words AND word_chars <= 6 * n_words"),
    "stops": ("100 * n_stops < 8 * n_words", "100 * n_stops >= 12 * n_words"),
    "repeats": ("5 * n_repeat_words > n_words", "100 * n_repeat_words <= n_words"),
    "lines": ("2 * n_dup_lines > n_lines", "n_lines > 1 AND n_dup_lines = 0"),
    "capitals": ("10 * n_upper > 4 * word_chars", "10 * n_upper <= 2 * word_chars"),
    "shouting": ("10 * n_exclaim > n_words", "100 * n_exclaim <= n_words"),
}


def matches(text: Column, letters: str) -> Column:
    """How many characters of the text are in the character class ``letters``."""
    return F.regexp_count(text, F.lit(f"[{letters}]")).cast("long")


def measured(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``row`` (all columns of the input) and the measures of its text.

    Null and empty texts have no words, symbols or lines. A line counts if it holds a word;
    lines are equal if all their characters are.
    """
    whole = with_row(docs, text=whole_text(F.col(f"`{text_column}`")))
    split = whole.select(
        "row",
        "text",
        F.array_remove(F.split("text", WHITE), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike("[^ \\t-\\r]")).alias("lines"),
    )
    hashed = split.select(
        "row",
        "text",
        F.size("words").alias("n"),
        F.size(F.filter("words", lambda word: ~word.rlike(f"[{ALPHANUMERIC}]"))).cast("long").alias("n_bare"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda word: F.xxhash64(word)).alias("codes"),
    )
    windows = hashed.withColumn(
        "windows",
        F.transform(
            F.slice("codes", 1, F.greatest(F.col("n") - 2, F.lit(0))),
            lambda code, i: F.xxhash64(code, F.get("codes", i + 1), F.get("codes", i + 2)),
        ),
    )
    # Only texts with a repeated window are sorted.
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.sort_array(F.transform("windows", lambda code, i: F.struct(code.alias("c"), i.alias("i"))))
    windows = windows.withColumn("placed", F.when(repeats, placed)).drop("codes", "windows")
    text = F.col("text")
    return windows.select(
        "row",
        F.col("n").cast("long").alias("n_words"),
        "word_chars",
        matches(text, SYMBOLS).alias("n_symbols"),
        "n_dup_lines",
        F.when(F.col("placed").isNull(), F.lit(0)).otherwise(repeated_words(F.col("placed"))).cast("long").alias("n_repeat_words"),
        F.col("n_lines").cast("long").alias("n_lines"),
        matches(text, UPPER).alias("n_upper"),
        matches(text, "!").alias("n_exclaim"),
        matches(text, ".,;:?").alias("n_stops"),
        matches(text, ALPHANUMERIC).alias("n_alnum"),
        "n_bare",
    )


def repeated_words(placed: Column) -> Column:
    """Words covered by windows that occur at least twice; ``placed`` has (code, place), sorted.

    A window is repeated if its neighbour in the sorted order is equal; both are marked.
    """
    pairs = F.zip_with(
        placed,
        F.slice(placed, 2, F.size(placed)),
        lambda a, b: F.when(a["c"] == b["c"], F.array(a["i"], a["i"] + 1, a["i"] + 2, b["i"], b["i"] + 1, b["i"] + 2)),
    )
    return F.size(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def voted(measures: DataFrame) -> DataFrame:
    """Add one column ``vote_<rule>`` for each rule; a text without words gets no vote."""
    votes = {
        f"vote_{name}": F.when(F.col("n_words") == 0, 0).when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0).cast("byte")
        for name, (bad, good) in RULES.items()
    }
    return measures.withColumns(votes)


@dataclass(frozen=True)
class Trust:
    """Share of good documents; by rule, the chance that a vote on a good (bad) document says good."""

    share: float
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]


FIRST_TRUST = Trust(FIRST_SHARE, (FIRST_GOOD,) * len(RULES), (1 - FIRST_BAD,) * len(RULES))


def votes_of() -> Column:
    return F.array(*(F.col(f"vote_{r}").cast("int") for r in RULES))


def posterior(votes: Column, share: Column, on_good: Column, on_bad: Column) -> Column:
    """Probability that a document with these votes is good; abstentions say nothing."""

    def weight(first: Column, rates: Column) -> Column:
        chances = F.zip_with(votes, rates, lambda v, x: F.when(v == 1, x).when(v == -1, 1 - x).otherwise(1.0))
        return F.aggregate(chances, first, lambda total, x: total * x)

    good, bad = weight(share, on_good), weight(1 - share, on_bad)
    return good / (good + bad)


def between(rate: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(rate, F.lit(low)), F.lit(high))


def one_round(patterns: Column, trust: Column) -> Column:
    """The trust that the patterns' posteriors under ``trust`` lead to; one vote of each kind is added."""

    def refit(scored: Column) -> Column:
        def total(part) -> Column:
            return F.aggregate(scored, F.lit(0.0), lambda sum_, s: sum_ + part(s))

        def rates(weight) -> Column:
            def rate(j: Column) -> Column:
                up, down = (1.0 + total(lambda s, v=v: F.when(F.get(s["votes"], j) == v, weight(s)).otherwise(0.0)) for v in (1, -1))
                return up / (up + down)

            return F.transform(F.sequence(F.lit(0), F.lit(len(RULES) - 1)), rate)

        return F.struct(
            between(total(lambda s: s["good"]) / total(lambda s: s["docs"]), *SHARES).alias("share"),
            rates(lambda s: s["good"]).alias("on_good"),
            rates(lambda s: s["docs"] - s["good"]).alias("on_bad"),
        )

    scored = F.transform(
        patterns,
        lambda p: F.struct(
            p["votes"].alias("votes"),
            p["docs"].alias("docs"),
            (p["docs"] * posterior(p["votes"], trust["share"], trust["on_good"], trust["on_bad"])).alias("good"),
        ),
    )
    return F.get(F.transform(F.array(scored), refit), F.lit(0))


def learn_trust(votes: DataFrame, rounds: int = ROUNDS) -> Trust:
    """EM over the counted vote patterns of all documents that pass the hard limits.

    The votes are written first, as the plan of a frame that was not written would compute its
    measures once for each vote. The patterns (at most ``3 ** len(RULES)``) meet in one row, where
    the rounds are a fold. Without documents the first guess stays.
    """
    votes = materialize(votes.select(*(f"vote_{r}" for r in RULES), "base_failed"), "votes")
    counted = votes.where(~F.col("base_failed")).groupBy(votes_of().alias("votes")).agg(F.count("*").cast("double").alias("docs"))
    table = counted.agg(F.sort_array(F.collect_list(F.struct("votes", "docs"))).alias("patterns"))
    first = F.struct(
        F.lit(FIRST_TRUST.share).alias("share"),
        F.array(*map(F.lit, FIRST_TRUST.on_good)).alias("on_good"),
        F.array(*map(F.lit, FIRST_TRUST.on_bad)).alias("on_bad"),
    )
    steps = F.when(F.size("patterns") > 0, F.sequence(F.lit(1), F.lit(rounds))).otherwise(F.expr("cast(array() as array<int>)"))
    found = table.select(F.aggregate(steps, first, lambda trust, _: one_round(F.col("patterns"), trust)).alias("t")).first().t
    return Trust(found.share, tuple(found.on_good), tuple(found.on_bad))


def with_verdict(voted_rows: DataFrame, trust: Trust) -> DataFrame:
    """Add ``posterior`` and ``kept``."""
    chance = posterior(votes_of(), F.lit(trust.share), *(F.array(*map(F.lit, rates)) for rates in (trust.on_good, trust.on_bad)))
    return voted_rows.withColumn("posterior", chance).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))


def report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """``doc_id``, measures, votes, ``base_failed``, ``posterior`` and ``kept``, in one pass over the texts.

    Null and empty texts fail the base limits. Repeated rows are judged alike. An empty table
    gives an empty result.
    """
    slim = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").alias("text"))
    rows = measured(slim).select(F.col("row.doc_id").alias("doc_id"), *MEASURES)
    rows = materialize(voted(rows).withColumn("base_failed", base_failed()), "quality")
    return with_verdict(rows, learn_trust(rows, rounds))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaim", "n_stops", "n_alnum", "n_bare")


def good_documents(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The documents that are kept, with all their columns unchanged."""
    rows = materialize(measured(docs, text_column).transform(lambda m: voted(m).withColumn("base_failed", base_failed())), "quality")
    kept = with_verdict(rows, learn_trust(rows)).where("kept")
    return kept.select(*replaced(docs))
