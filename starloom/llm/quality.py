"""Quality rules as weak supervision, in DataFrame operations only.

Heuristic rules over per-document counts vote good (+1), bad (-1) or abstain
(0).  ``KINDS`` name kinds of junk that a rule finds by itself; the other rules are hints
that good documents often fail too.  Expectation-maximisation over the table of vote
patterns (at most 3^rules rows, whatever the corpus size) estimates how often each
rule votes each way on good documents and on every kind of junk; the posterior
probability of good then replaces all-must-pass filtering: a failed hint does not
condemn, hints that agree with a kind of junk do, and good votes can outweigh a kind's rule.  Every count covers the whole text and is
computed inside the row: nothing but one number per document is shuffled.

Defined results: a null or empty text has zero counts, fails the base rule and
is rejected; repeated rows are counted and judged each; an empty table gives an
empty result; other columns pass unchanged (columns named ``__q_*`` are
reserved).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\f\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words",
          "n_upper", "n_digits", "n_ended_lines")
WINDOW = 8
ENDS = ('.', '!', '?', '"', "'", ":", ";", ")", "\u201d", "\u2026", "\u3002")
KINDS = ("symbols", "dup_lines", "repeats", "variety", "capitals", "word_length")
HINTS = ("length", "digits", "line_ends", "line_length")
# What the rules are taken for before any document is seen: shares of bad votes on good
# documents and on junk, and how many documents' worth (as a multiple of all) that is trusted.
# A rule of a kind was made to spare good documents, which is trusted most: its bad votes tell
# of junk where they are more than its false alarms would be, or where others agree.
FALSE_ALARM, HINT_ALARM, OWN_JUNK, OTHER_JUNK = 0.005, 0.2, 0.9, 0.1
TRUST_ALARM, TRUST = 10.0, 0.01


def _covered(hashes: str, window: int) -> Column:
    """Words inside windows that occur more than once, from the array of window
    hashes: sort (hash, position), keep equal neighbours, unite the spans."""
    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s):
        def twin(e, k):
            return F.coalesce(F.get(s, k - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(s, twin), lambda e: e["i"]))

    # transform over a one-element array names the sorted array once
    positions = F.flatten(F.transform(F.array(ordered), repeated))
    start = F.struct(F.lit(0).alias("c"), F.lit(0).alias("e"))
    return F.aggregate(positions, start,
                       lambda a, p: F.struct((a["c"] + p + window - F.greatest(a["e"], p)).alias("c"), (p + window).alias("e")),
                       lambda a: a["c"])


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``__q_<count>`` (long) for every name in ``COUNTS``.

    Windows are compared by a 64-bit hash of their words within one text.
    """
    d = docs.withColumn("__q_text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    trimmed = F.btrim("__q_text", F.lit(BLANKS))
    d = d.withColumn("__q_words", F.when(trimmed == "", F.array().cast("array<string>"))
                     .otherwise(F.split(trimmed, "[ \\t\\n\\x0B\\f\\r]+")))
    n = F.size("__q_words")
    d = d.withColumn("__q_hashes", F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("__q_words", i, WINDOW))))
        .otherwise(F.array().cast("array<bigint>")))
    d = d.withColumn("__q_lines", F.filter(F.split("__q_text", "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != ""))

    def without(characters):
        return F.length("__q_text") - F.length(F.translate("__q_text", characters, ""))

    repeats = F.size(F.array_distinct("__q_hashes")) < F.size("__q_hashes")
    counts = {
        "n_words": n,
        "word_chars": F.length(F.translate("__q_text", BLANKS, "")),
        "n_symbols": without("#*$%&|<>"),
        "n_dup_lines": F.size("__q_lines") - F.size(F.array_distinct("__q_lines")),
        "n_repeat_words": F.when(repeats, _covered("__q_hashes", WINDOW)).otherwise(0),
        "n_lines": F.size("__q_lines"),
        "n_distinct_words": F.size(F.array_distinct("__q_words")),
        "n_upper": without("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "n_digits": without("0123456789"),
        "n_ended_lines": F.size(F.filter("__q_lines", lambda line: F.right(F.btrim(line, F.lit(BLANKS)), F.lit(1)).isin(*ENDS))),
    }
    return d.select(*docs.columns, *[counts[c].cast("long").alias(f"__q_{c}") for c in COUNTS])


def _count(name: str) -> Column:
    return F.col(f"__q_{name}").cast("double")


def base_failed() -> Column:
    return (F.col("__q_n_words") < 20) | (100 * F.col("__q_n_repeat_words") > 30 * F.col("__q_n_words"))


def _vote(value: Column, good: Column, bad: Column, applies: Column | None = None) -> Column:
    vote = F.when(bad, -1).when(good, 1).otherwise(0)
    vote = F.when(applies, vote).otherwise(0) if applies is not None else vote
    return F.when(value.isNull(), 0).otherwise(vote)


def rules() -> dict[str, Column]:
    """The voting rules over the counts; between their bounds, and where they
    do not apply, they abstain."""
    words = F.greatest(_count("n_words"), F.lit(1.0))
    chars = F.greatest(_count("word_chars"), F.lit(1.0))
    lines = F.greatest(_count("n_lines"), F.lit(1.0))
    share = {
        "symbols": _count("n_symbols") / words,
        "dup_lines": _count("n_dup_lines") / lines,
        "repeats": _count("n_repeat_words") / words,
        "variety": _count("n_distinct_words") / words,
        "capitals": _count("n_upper") / chars,
        "word_length": chars / words,
        "length": _count("n_words"),
        "digits": _count("n_digits") / chars,
        "line_ends": _count("n_ended_lines") / lines,
        "line_length": words / lines,
    }

    def vote(name, good, bad, applies=None):
        return _vote(share[name], good(share[name]), bad(share[name]), applies)

    return {
        "symbols": vote("symbols", lambda v: v < 0.05, lambda v: v > 0.1),
        "dup_lines": vote("dup_lines", lambda v: v < 0.1, lambda v: v > 0.3, F.col("__q_n_lines") >= 4),
        "repeats": vote("repeats", lambda v: v < 0.05, lambda v: v > 0.2),
        "variety": vote("variety", lambda v: v > 0.5, lambda v: v < 0.35, F.col("__q_n_words").between(40, 2000)),
        "capitals": vote("capitals", lambda v: v < 0.2, lambda v: v > 0.5),
        "word_length": vote("word_length", lambda v: (v >= 3) & (v <= 10), lambda v: (v < 2) | (v > 14)),
        "length": vote("length", lambda v: v >= 100, lambda v: v < 50),
        "digits": vote("digits", lambda v: v < 0.02, lambda v: v > 0.05),
        "line_ends": vote("line_ends", lambda v: v > 0.7, lambda v: v < 0.3),
        "line_length": vote("line_length", lambda v: v >= 8, lambda v: v < 4),
    }


def pattern_code() -> Column:
    """All votes as one base-3 number."""
    code = F.lit(0)
    for vote in rules().values():
        code = code * 3 + vote + 1
    return code.cast("int")


def _votes(code: int, n: int) -> list[int]:
    return [code // 3 ** (n - 1 - j) % 3 for j in range(n)]


def fit(patterns: list[tuple[int, int]], names: list[str] | None = None, rounds: int = 200, tolerance: float = 1e-9) -> dict[int, float]:
    """Expectation-maximisation over (pattern, documents): posterior probability
    of good per pattern.

    Latent classes are good documents and one kind of junk per rule of ``KINDS``; given
    the class, rules vote independently, and abstaining says nothing.  Estimated
    are the shares of the classes and, for every rule and class, how often its
    vote is bad.  Kinds of junk rarely overlap, so agreement alone can't tell a rule
    that finds its own kind from a noisy one; what the rules were made for
    settles it, as priors worth ``TRUST_ALARM`` or ``TRUST`` of the documents (and two votes):
    the documents' own votes move every share, without bounds.
    """
    names = [*KINDS, *HINTS] if names is None else names
    kinds = [j for j, name in enumerate(names) if name in KINDS]
    data = [(code, _votes(code, len(names)), n) for code, n in sorted(patterns)]
    total = sum(n for _, _, n in data)
    if not total:
        return {}
    classes = range(len(kinds) + 1)                  # the last: good
    prior_bad = [[OWN_JUNK if j == kinds[k] else OTHER_JUNK if j in kinds else HINT_ALARM for j in range(len(names))] for k in classes[:-1]]
    prior_bad.append([FALSE_ALARM if j in kinds else HINT_ALARM for j in range(len(names))])
    trust = [[2 + total * (TRUST_ALARM if k == len(kinds) and j in kinds else TRUST) for j in range(len(names))] for k in classes]

    bad = [list(row) for row in prior_bad]
    prior = [0.2 / len(kinds)] * len(kinds) + [0.8]
    last, posterior = -math.inf, {}
    for _ in range(rounds):
        likelihood = 0.0
        for code, votes, n in data:
            logs = [math.log(prior[k]) + sum(math.log(bad[k][j] if v == 0 else 1 - bad[k][j])
                                             for j, v in enumerate(votes) if v != 1) for k in classes]
            top = max(logs)
            mass = [math.exp(x - top) for x in logs]
            posterior[code] = [m / sum(mass) for m in mass]
            likelihood += n * (top + math.log(sum(mass)))
        for k in classes:
            weight = [(votes, n * posterior[code][k]) for code, votes, n in data]
            prior[k] = (sum(w for _, w in weight) + 1) / (total + len(kinds) + 1)
            for j in range(len(names)):
                no, yes = (sum(w for votes, w in weight if votes[j] == v) for v in (0, 2))
                bad[k][j] = (no + trust[k][j] * prior_bad[k][j]) / (no + yes + trust[k][j])
        if abs(likelihood - last) <= tolerance * abs(likelihood):
            break
        last = likelihood
    return {code: p[-1] for code, p in posterior.items()}


def judge(counted: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Adds ``__q_quality`` (posterior probability of good), ``__q_base_failed``
    and ``__q_kept`` to rows with counts.  ``counted`` is read twice and should
    be a stored table."""
    spark = counted.sparkSession
    coded = counted.withColumn("__q_pattern", pattern_code()).withColumn("__q_base_failed", base_failed())
    # bounded by 3^rules rows
    patterns = [(r[0], r[1]) for r in coded.groupBy("__q_pattern").count().collect()]
    fitted = fit(patterns)
    table = spark.createDataFrame(sorted(fitted.items()), "__q_pattern int, __q_quality double")
    return (coded.join(F.broadcast(table), "__q_pattern", "left")
            .withColumn("__q_kept", ~F.col("__q_base_failed") & (F.col("__q_quality") >= threshold)))
