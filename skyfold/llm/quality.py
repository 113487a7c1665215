"""Quality rules by weak supervision.

Rules vote that a document is good or bad, or abstain.  Votes agree in a vector
of a few outcomes, so a count for each vector seen (at most 3 ** rules rows)
holds all that expectation-maximisation needs.  EM fits a mixture of one class of
good documents and one class of bad ones for each family of rules (symbols,
shouting, repetition): its share of the corpus and how often each rule gives each
vote in it.  A class of bad documents starts from the vectors in which two rules
of its family agree on bad; a lone bad vote starts as a false alarm.  So rules'
accuracies come from their agreement with each other, and junk of one kind needs
no votes from rules that look for another.  The posterior of the good class is
the quality of every document with those votes.  The fit is one ``aggregate``
expression over the counted vectors: no rows leave the executors but that one.

Defined results: a null text has no words; texts with fewer than ``MIN_WORDS``
words or too many repeated ones fail outright; repeated rows vote each; an empty
table gives an empty table; very long texts are judged whole, in time
n log n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfold.llm.session import materialise

MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
WINDOW = 8
EM_ROUNDS = 30
#: What is believed of a rule before any vote is counted: how often it calls a good
#: or a bad document bad, abstains, or calls it good; worth so many documents for each of the class.
BELIEF_GOOD, BELIEF_BAD, BELIEF_WEIGHT = (0.02, 0.2, 0.78), (0.4, 0.3, 0.3), 0.02
#: The family of each rule of ``votes``; the last stands alone.
FAMILIES = (1, 1, 1, 2, 2, 2, 3, 3, 3, 0)
CLASSES = 4
KEEP_AT = 0.5
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def covered(windows: Column) -> Column:
    """How many positions lie in a window of ``WINDOW`` words whose hash occurs twice or more; ``windows`` has a hash for each start.

    Only texts with a repeated window pay for the sort.
    """
    n = F.size(windows)
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = let(pairs, lambda p: F.filter(p, lambda x, i: ((i > 0) & (F.try_element_at(p, i)["h"] == x["h"])) | ((i < n - 1) & (F.try_element_at(p, i + 2)["h"] == x["h"]))))
    total = F.aggregate(
        F.sort_array(F.transform(twice, lambda x: x["i"])),
        F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-WINDOW).alias("last")),
        lambda s, x: F.struct((s["sum"] + F.least(F.lit(WINDOW), x - s["last"])).cast("long").alias("sum"), x.alias("last")),
        lambda s: s["sum"],
    )
    return F.when(F.size(F.array_distinct(windows)) == n, F.lit(0).cast("long")).otherwise(total)


def base_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the five counts of ``BASE`` and what the rules look at."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumn("__words", words_of(F.col(text)))
    d = d.withColumn("n_words", F.size("__words").cast("long"))
    d = d.withColumn("__hashes", F.transform("__words", lambda w: F.xxhash64(w)))
    windows = F.when(
        F.col("n_words") >= WINDOW,
        F.transform(F.sequence(F.lit(1), F.size("__words") - (WINDOW - 1)), lambda i: F.xxhash64(*[F.element_at("__hashes", i + j) for j in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))
    d = d.withColumn("__windows", windows)
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumn("__lines", lines)
    # A value that Spark takes for indeterminate keeps filters on the measures from being
    # rewritten into filters on the text, with every array computed anew for each element.
    fenced = F.when(F.monotonically_increasing_id() >= 0, F.col("n_words"))
    count = lambda pattern: F.length(t) - F.length(F.regexp_replace(t, pattern, ""))
    return d.select(
        *docs.columns,
        fenced.alias("n_words"),
        F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]").cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("n_words") >= WINDOW, covered(F.col("__windows"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("__hashes")).cast("long").alias("n_distinct"),
        F.size(F.filter("__hashes", lambda h, i: (i > 0) & (F.try_element_at("__hashes", i) == h))).cast("long").alias("n_adjacent"),
        count(r"[A-ZÀ-Þ]").cast("long").alias("n_upper"),
        count(r"!").cast("long").alias("n_shouts"),
        count(r"[.?。]").cast("long").alias("n_stops"),
        (F.size(F.split(t, r"[#*$%&|<>]+", -1)) - 1).cast("long").alias("n_symbol_runs"),
        count(r"\p{L}").cast("long").alias("n_letters"),
    )


def votes(m: dict[str, Column]) -> list[Column]:
    """Each rule's vote: -1 bad, 1 good, 0 abstains; the families of ``FAMILIES``."""
    n = F.greatest(m["n_words"], F.lit(1)).cast("double")
    chars = F.greatest(m["word_chars"], F.lit(1)).cast("double")
    lines = m["n_lines"].cast("double")

    def rule(bad: Column, good: Column) -> Column:
        return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))

    symbols, runs, letters = m["n_symbols"] / n, m["n_symbol_runs"] / n, m["n_letters"] / chars
    upper, shouts, length = m["n_upper"] / chars, m["n_shouts"] / n, chars / n
    # Distinct words grow like the root of the length at first, so this holds for short and long texts.
    adjacent, distinct, stops = m["n_adjacent"] / n, m["n_distinct"] / F.sqrt(n), m["n_stops"] / n
    same = m["n_dup_lines"] / F.greatest(lines, F.lit(1.0))
    return [
        rule(symbols > 0.25, symbols < 0.05),
        rule(runs > 0.15, runs < 0.03),
        rule(letters < 0.75, letters > 0.88),
        rule(upper > 0.35, upper < 0.15),
        rule(shouts > 0.25, shouts < 0.05),
        rule((length < 2.5) | (length > 20), (length > 3) & (length < 12)),
        rule(adjacent > 0.2, adjacent < 0.05),
        rule((lines >= 3) & (same > 0.6), (lines >= 3) & (same < 0.2)),
        rule(distinct < 2.0, distinct > 3.5),
        rule((n >= 40) & (stops < 0.01), (stops > 0.03) & (stops < 0.4)),
    ]


MEASURES = (*BASE, "n_lines", "n_distinct", "n_adjacent", "n_upper", "n_shouts", "n_stops", "n_symbol_runs", "n_letters")


def label_model(counted: DataFrame, families: tuple[int, ...] = FAMILIES, rounds: int = EM_ROUNDS) -> DataFrame:
    """(votes array<int>, n) -> (votes, quality, rates): the posterior that documents with these votes are good.

    A latent class model with three votes a rule; class 0 is good, the others are the ``families``
    of junk.  ``rates`` is the same in every row: for each class how often each rule votes bad.
    """
    rules, classes = len(families), max(families) + 1
    cells = 3 * rules
    # A vector as the cells that it sets: rule r voting v sets cell 3r + v + 1.
    one = counted.agg(F.collect_list(F.struct("votes", F.transform("votes", lambda v, i: i * 3 + v + 1).alias("cells"), F.col("n").cast("double").alias("n"))).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("total"))

    def against(r: Column, k: int) -> Column:
        """How many rules of family ``k`` vote bad."""
        return sum((F.when(r["votes"][i] == -1, 1).otherwise(0) for i, f in enumerate(families) if f == k), F.lit(0))

    def start(r: Column) -> Column:
        two = [(against(r, k) >= 2).cast("double") for k in range(1, classes)]
        any_ = sum(two[1:], two[0])
        return F.array(F.when(any_ > 0, F.lit(0.02)).otherwise(F.lit(0.96)), *[F.when(x > 0, 0.96 / F.greatest(any_, F.lit(1.0))).otherwise(F.lit(0.02 / classes)) for x in two])

    def rates(rows: Column, resp: Column, k: int) -> Column:
        """The share of each vote in class ``k``, by cell, and last of the class."""
        belief = F.array(*[F.lit(x) for x in (BELIEF_GOOD if k == 0 else BELIEF_BAD)])
        weighed = F.transform(rows, lambda r, i: F.struct(r["cells"].alias("cells"), (r["n"] * resp[i][k]).alias("n")))
        total = lambda x, of: F.aggregate(x, F.lit(0.0), lambda s, r: s + of(r))
        mass = total(weighed, lambda r: r["n"])
        in_cell = lambda w, c: total(w, lambda r: F.when(F.array_contains(r["cells"], c), r["n"]).otherwise(0.0))
        counts = F.array(F.struct(weighed.alias("w"), mass.alias("all")))
        weight = lambda x: x["all"] * BELIEF_WEIGHT + 1
        share = lambda x, c: (in_cell(x["w"], c) + weight(x) * belief[c % 3]) / (x["all"] + weight(x))
        return F.flatten(F.transform(counts, lambda x: F.array_append(F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), lambda c: share(x, c)), (x["all"] + 1) / (F.col("total") + classes))))

    def posterior(rows: Column, resp: Column) -> Column:
        fit = F.array(F.array(*[F.transform(rates(rows, resp, k), lambda x: F.log(x)) for k in range(classes)]))

        def one_row(f: Column, r: Column) -> Column:
            scores = F.transform(f, lambda logs: F.aggregate(r["cells"], logs[cells], lambda s, c: s + logs[c]))
            parts = F.transform(F.array(scores), lambda x: F.transform(x, lambda y: F.exp(y - F.array_max(x))))
            return F.flatten(F.transform(parts, lambda p: F.transform(p, lambda y: y / F.aggregate(p, F.lit(0.0), lambda s, z: s + z))))

        return F.flatten(F.transform(fit, lambda f: F.transform(rows, lambda r: one_row(f, r))))

    fitted = one.select("rows", "total", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.transform("rows", start), lambda resp, _: posterior(F.col("rows"), resp)).alias("resp"))
    alarms = F.array(*[F.filter(rates(F.col("rows"), F.col("resp"), k), lambda _, i: (i % 3 == 0) & (i < cells)) for k in range(classes)])
    fitted = fitted.select(F.arrays_zip("rows", "resp").alias("x"), alarms.alias("rates"))
    return fitted.select(F.explode("x").alias("x"), "rates").select(F.col("x.rows.votes").alias("votes"), F.col("x.resp")[0].alias("quality"), "rates")


def ballots(measured: DataFrame) -> DataFrame:
    """Rows with the measures of ``base_measures`` -> plus base_failed and their ``__votes``."""
    d = measured.withColumn("__votes", F.array(*votes({c: F.col(c) for c in MEASURES})))
    return d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")))


def judge(d: DataFrame) -> DataFrame:
    """Rows of ``ballots`` -> plus quality and kept.

    ``d`` is read twice: for the counts of vote vectors and for the result.
    """
    counted = d.filter(~F.col("base_failed")).groupBy(F.col("__votes").alias("votes")).agg(F.count("*").alias("n"))
    model = materialise(label_model(counted).drop("rates"))  # at most 3 ** 10 rows
    d = d.join(F.broadcast(model), F.col("__votes") == F.col("votes"), "left").drop("votes", "__votes")
    return d.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("quality") >= KEEP_AT, F.lit(False)))


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the measures, base_failed, quality and kept of each document; texts are read once."""
    return judge(materialise(ballots(base_measures(docs.select("doc_id", "text")).drop("text"))))


def quality_filter(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns.  Texts are measured once and written with their votes."""
    clash = {c: f"__own_{i}" for i, c in enumerate(docs.columns) if c != "text"}
    own = docs.withColumnsRenamed(clash)
    voted = materialise(ballots(base_measures(own)).select(*own.columns, "base_failed", "__votes"))
    kept = judge(voted).filter("kept").select(*own.columns)
    return kept.withColumnsRenamed({v: k for k, v in clash.items()})
