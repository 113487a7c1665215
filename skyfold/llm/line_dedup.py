"""Line deduplication by an exact set-similarity join.

A line's tokens are its distinct 5-word shingles (all words of a shorter line
make one).  A line goes if an earlier line, by (doc_id, place), shares at least
75 % of the union of their tokens.

1. Equal lines collapse to their first occurrence, by a map-side aggregate.
2. Tokens are counted over all remaining lines in 2**16 buckets of their hash, a
   table of fixed size.  Tokens order by the count of their bucket, then by
   hash: rare first.  Buckets hold N / 2**16 of N tokens give or take its root, so
   a token stands behind the prefixes once its own count is some three roots: 100
   of 10**8 tokens, 40,000 of 10**13, where passes over as many postings still are
   short.  Any order that all lines share keeps the join exact; rarity keeps its
   candidates few.
3. Two lines with n tokens and enough in common share one among the first
   n - ceil(0.75 n) + 1 of each in that order.  Those prefixes are posted, and
   tokens posted once go.  A pass over each other token's postings proposes its
   first line and the one before for every line: in proportion to the postings,
   however many lines share a token.  Length and position filters cut pairs that
   can't reach 75 %; the rest are verified on the full sets.
4. A line that has found an earlier match is done.  Of the others, those that
   stand fourth or later among a token's postings are compared with all earlier
   lines of that token; earlier ones have met them all.
5. Removed lines return to their texts as numbers; texts are shuffled once.

Only DataFrame expressions run on the executors.  Joins of growing tables name
their strategy, so that the plan is one at every size.

Defined results: blank lines (without a word) always stay; a null text stays
null; a text whose lines all go becomes empty; line feeds separate lines, so a
text's kept lines are joined by line feeds; of rows that repeat, all keep what
the first keeps; a null doc_id comes before all others and is one document with
the least long; an empty table gives an
empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from skyfold.llm.session import discard, materialise

SHINGLE = 5
#: The similarity, as a fraction.
NUM, DEN = 3, 4
BUCKETS = 1 << 16
#: Bits of a token's hash, below those of its rank.
HASH_BITS = 56
#: Ranks go from 0 to below this: numbers so small that the JVM keeps one object of each, which stay in its caches.
RANKS = 128
#: Stands for a null doc_id, so that keys compare by plain equality and one shuffle serves grouping and join.
LEAST_ID = -(2**63)
SPACE = r"[\x20\x09-\x0D]+"


def word_hashes(line: Column) -> Column:
    """The hashes of the words of a line that has one; a regular expression runs only on lines that aren't words between single spaces."""
    odd = line.startswith(" ") | line.endswith(" ")
    for space in ("  ", "\t", "\x0b", "\x0c", "\r"):
        odd |= line.contains(space)
    even = F.when(odd, F.trim(F.regexp_replace(line, SPACE, " "))).otherwise(line)
    return F.transform(F.split(even, " "), lambda w: F.xxhash64(w))


def last_start(hashes: Column) -> Column:
    return F.greatest(F.size(hashes) - SHINGLE, F.lit(0))


def shingle(hashes: Column, i: Column) -> Column:
    """The hash of the shingle at ``i``; a shorter line's only one ends in nulls, which leave a hash as it is."""
    return F.xxhash64(*[F.get(hashes, i + j) for j in range(SHINGLE)])


def line_tokens(line: Column) -> Column:
    """The distinct hashes of the line's shingles."""
    # A list of one list binds the word hashes to a name.
    each = F.transform(F.array(word_hashes(line)), lambda h: F.transform(F.sequence(F.lit(0), last_start(h)), lambda i: shingle(h, i)))
    return F.array_distinct(each[0])


def all_tokens(lines: DataFrame) -> DataFrame:
    """``t``: the shingle hashes of all lines, those that repeat within a line included; exploded places keep the hashing in generated code."""
    hashed = lines.select(word_hashes(F.col("line")).alias("h"))
    placed = hashed.select("h", F.explode(F.sequence(F.lit(0), last_start(F.col("h")))).alias("i"))
    return placed.select(shingle(F.col("h"), F.col("i")).alias("t"))


def bucket(token: Column) -> Column:
    return token.bitwiseAND(BUCKETS - 1).cast("int")


def ordered_tokens(line: Column, ranks: Column) -> Column:
    """The line's tokens, the rarest first; one long holds the rank and the other bits of the hash, and is as good as the token.

    ``ranks`` has each bucket's rank.
    """
    rank = lambda t: F.coalesce(F.get(ranks, bucket(t)), F.lit(0).cast("long"))  # noqa: E731 - never null, so that longs are sorted
    packed = lambda t: F.shiftleft(rank(t), HASH_BITS).bitwiseXOR(F.shiftrightunsigned(t, 64 - HASH_BITS))
    return F.sort_array(F.transform(line_tokens(line), packed))


def prefix_length(n: Column) -> Column:
    return n - F.ceil(n * NUM / DEN).cast("int") + 1


def placed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, th, line_no, line) of every line that has a word; th is a hash of the text, taken before texts are cut."""
    hashed = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    lines = hashed.select("doc_id", "th", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return lines.filter(F.col("line").rlike(r"[^\x20\x09-\x0D]"))


def first_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, th, line_no, line): the first occurrence of every line that has a word."""
    # 128 bits of hash stand for the line: rows sort by numbers.
    keyed = placed_lines(docs).select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), F.struct("doc_id", "line_no", "th", "line").alias("at"))
    first = keyed.groupBy("h1", "h2").agg(F.min("at").alias("at"))
    return first.select("at.doc_id", "at.th", "at.line_no", "at.line")


def token_ranks(lines: DataFrame) -> list[int]:
    """For each bucket of tokens the rank (from 0, below ``RANKS``) of its count over all lines."""
    counted = all_tokens(lines).groupBy(bucket(F.col("t")).alias("b")).agg(F.count("*").alias("n"))
    n = dict(counted.collect())  # 2**16 rows at most
    seen = sorted({0, *n.values()})
    rank = {c: k * RANKS // len(seen) for k, c in enumerate(seen)}
    return [rank[n.get(b, 0)] for b in range(BUCKETS)]


def enough(shared: Column, n: Column, m: Column) -> Column:
    return (NUM + DEN) * shared >= NUM * (n + m)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (xd, xn earlier; yd, yn) -> (doc_id, th, line_no) of the later lines that match."""
    x = sets.select(F.col("doc_id").alias("xd"), F.col("line_no").alias("xn"), F.col("tokens").alias("p"))
    y = sets.select(F.col("doc_id").alias("yd"), F.col("line_no").alias("yn"), F.col("th"), F.col("tokens").alias("q"))
    both = pairs.join(y.hint("merge"), ["yd", "yn"]).join(x.hint("merge"), ["xd", "xn"]).select("yd", "yn", "th", "p", "q")
    shared = F.size(F.array_intersect("p", "q"))
    return both.filter(enough(shared, F.size("p"), F.size("q"))).select(F.col("yd").alias("doc_id"), "th", F.col("yn").alias("line_no")).distinct()


def reach(n: Column, pos: Column, m: Column, other: Column) -> Column:
    """Whether lines of n and m tokens can share enough, given where their common token stands."""
    return enough(F.least(n - pos, m - other), n, m) & (DEN * F.least(n, m) >= NUM * F.greatest(n, m))


def similar_later_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, th, line_no) of the lines that an earlier one of ``lines`` matches."""
    ranks = F.from_json(F.lit("[" + ",".join(map(str, token_ranks(lines))) + "]"), "array<bigint>")
    posted = lines.select("doc_id", "line_no", ordered_tokens(F.col("line"), ranks).alias("t"))
    posted = posted.select("doc_id", "line_no", F.size("t").alias("n"), F.posexplode(F.slice("t", 1, prefix_length(F.size("t")))).alias("pos", "token"))
    # Three numbers travel as two.
    posted = posted.select("token", "doc_id", F.shiftleft(F.col("line_no").cast("long"), 32).bitwiseOR(F.col("n").cast("long")).alias("place"), "pos")
    posted = posted.withColumn("all", F.count("*").over(Window.partitionBy("token"))).filter("`all` > 1")
    posted = posted.select("token", "doc_id", F.shiftright("place", 32).cast("int").alias("line_no"), F.col("place").bitwiseAND((1 << 32) - 1).cast("int").alias("n"), "pos", "all")
    order = Window.partitionBy("token").orderBy("doc_id", "line_no")
    here = F.struct("doc_id", "line_no", "n", "pos")
    met = posted.select("*", F.row_number().over(order).alias("k"), F.first(here).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("first"), F.lag(here).over(order).alias("prev"))
    met = materialise(met)
    both = met.filter("k > 1").select("doc_id", "line_no", "n", "pos", F.explode(F.when(F.col("k") > 2, F.array("first", "prev")).otherwise(F.array("first"))).alias("x"))
    near = both.filter(reach(F.col("n"), F.col("pos"), F.col("x.n"), F.col("x.pos")))
    near = near.filter((F.col("x.doc_id") != F.col("doc_id")) | (F.col("x.line_no") != F.col("line_no")))
    pairs = materialise(near.select(F.col("x.doc_id").alias("xd"), F.col("x.line_no").alias("xn"), F.col("doc_id").alias("yd"), F.col("line_no").alias("yn")).distinct())
    # Only lines of a proposed pair, or of a token with more lines than a pass compares, are needed in full.
    ends = pairs.select(F.col("xd").alias("doc_id"), F.col("xn").alias("line_no")).union(pairs.select("yd", "yn")).union(met.filter("`all` > 3").select("doc_id", "line_no")).distinct()
    sets = lines.join(ends.hint("merge"), ["doc_id", "line_no"], "left_semi")
    sets = materialise(sets.select("doc_id", "th", "line_no", line_tokens(F.col("line")).alias("tokens")))
    gone = materialise(verified(pairs, sets))
    crowded = met.filter("`all` > 3").select("doc_id", "line_no", "n", "pos", "token", "k")
    left = crowded.filter("k > 3").join(gone.select("doc_id", "line_no").hint("merge"), ["doc_id", "line_no"], "left_anti")
    x, y = crowded.alias("x"), left.alias("y")
    rest = x.hint("merge").join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.k") < F.col("y.k")) & reach(F.col("y.n"), F.col("y.pos"), F.col("x.n"), F.col("x.pos")))
    rest = rest.select(F.col("x.doc_id").alias("xd"), F.col("x.line_no").alias("xn"), F.col("y.doc_id").alias("yd"), F.col("y.line_no").alias("yn"))
    rest = rest.filter("xd <> yd or xn <> yn").distinct()
    rest = materialise(rest)
    all_gone = materialise(gone.union(verified(rest, sets)).distinct())
    discard(met, pairs, sets, gone, rest)
    return all_gone


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with their kept text, n_lines and n_removed; columns of these names are replaced."""
    keep = [c for c in docs.columns if c.lower() not in ("text", "n_lines", "n_removed")]
    own = docs.select("text", *[F.col(c).alias(f"__{i}") for i, c in enumerate(keep)], F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("doc_id"))
    lines = materialise(first_lines(own.select("doc_id", "text")), "snappy")
    gone = similar_later_lines(lines)
    number = lambda sign: F.collect_list(F.when(F.col("sign") == sign, F.col("line_no")))
    rows = lines.select("doc_id", "th", "line_no", F.lit(1).alias("sign")).union(gone.select("doc_id", "th", "line_no", F.lit(-1)))
    first = rows.groupBy("doc_id", "th").agg(number(1).alias("first"), number(-1).alias("gone"))
    first = materialise(first.select("doc_id", "th", F.array_except("first", "gone").alias("first")))
    discard(lines, gone)
    d = own.withColumn("th", F.xxhash64("text")).join(first.hint("shuffle_hash"), ["doc_id", "th"], "left")
    d = d.withColumn("__lines", F.split("text", "\n", -1))
    blank = F.filter(F.sequence(F.lit(0), F.size("__lines") - 1), lambda i: ~F.get("__lines", i).rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumn("__stay", F.sort_array(F.concat(blank, F.coalesce("first", F.array().cast("array<int>")))))
    text = F.array_join(F.transform("__stay", lambda i: F.get("__lines", i)), "\n")
    n_lines = F.when(F.col("text").isNotNull(), F.size("__lines")).otherwise(0).cast("long")
    n_stay = F.when(F.col("text").isNotNull(), F.size("__stay")).otherwise(0).cast("long")
    return d.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(keep)], text.alias("text"), n_lines.alias("n_lines"), (n_lines - n_stay).alias("n_removed"))
