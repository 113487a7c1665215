"""Near-duplicate documents by SuperMinHash.

A document is the set of its distinct 5-word shingles (lower-cased A-Z).  Two
are linked when they share at least 75 % of their union.

1. Signatures.  SuperMinHash gives every shingle a random permutation of the
   slots instead of independent hashes: round j offers the value j + uniform to
   the slot at rank j, so a slot's minimum comes from a low round and a document
   stops as soon as its largest slot is below the next round.  Long documents
   need one round.  The slots of a block of documents are filled together.
2. Exact copies (equal sets) collapse to their smallest doc_id before anything
   is compared, by a map-side aggregate: a group of copies with a third of all
   rows costs one row a task.
3. Bands of slots make buckets.  Each member of a bucket is compared with the
   bucket's smallest id, so pairs grow in proportion to members.  Compared means:
   exact intersection of the full sets, next to each other in one row.
4. Union-find (large and small stars) over the confirmed links.  What is left are
   the buckets whose members are still in different components.  In one of up
   to ``BLOCK`` members and ``BLOCK_SHINGLES`` shingles, those outside the largest
   component are intersected with all others at once.  The members of larger
   ones meet by an exact join on their sets instead: shingles are counted over
   these members, each posts the rarest of its own that a similar set must share
   one of, and members of different components that meet are compared.  So
   boilerplate in a third of all documents makes no pairs: its shingles are
   common.  Only confirmed links come out, and no pair of a bucket is skipped.
   The components are then joined again, if there are new links.

A pair at exactly 0.75 shares a bucket with probability 1 - (1 - 0.75**6)**32 =
0.998, one at 0.8 with 0.9999; below the threshold links are never made.

Defined results: without words a document has no shingles, is linked with
nothing and kept; fewer than five words make one shingle; rows that repeat a
doc_id are versions of one document (in its component together); a null doc_id
is linked with nothing and kept, with a null component; an empty table gives an
empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyfold.llm import textnp
from skyfold.llm.components import components
from skyfold.llm.session import bound_batches, discard, materialise

SHINGLE = 5
NUMERATOR, DENOMINATOR = 75, 100
BANDS, ROWS = 32, 6
SLOTS = BANDS * ROWS
#: The largest bucket whose members are compared in one group: members, and shingles of all their sets (16 MB).
BLOCK, BLOCK_SHINGLES = 500, 1 << 21
#: Shingles whose slots are filled together; bounds a worker's arrays to some 30 MB.
CHUNK = 1 << 17


def super_minhash(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """One row of ``slots`` values a set; an empty set's are infinite."""
    U = np.uint64
    sig = np.full((len(sets), slots), np.inf)
    start = 0
    while start < len(sets):
        end, size = start, 0
        while end < len(sets) and (end == start or size + len(sets[end]) <= CHUNK):
            size += len(sets[end])
            end += 1
        part = sets[start:end]
        h = np.concatenate(part) if part else np.zeros(0, U)
        owner = np.repeat(np.arange(end - start), [len(s) for s in part])
        out = sig[start:end]
        flat = out.reshape(-1)
        ranks = None
        for j in range(slots):
            if not len(h):
                break
            draw = textnp.mix64(h + U((j + 1) * 0x9E3779B97F4A7C15 & ((1 << 64) - 1)))
            value = j + (draw >> U(11)).astype(np.float64) * 2.0**-53
            pick = j + (((draw & U(0xFFFFFFFF)) * U(slots - j)) >> U(32)).astype(np.int64)
            if ranks is None:
                slot = pick
            else:
                rows = np.arange(len(h))
                slot = ranks[rows, pick].astype(np.int64)
                ranks[rows, pick] = ranks[:, j]
            np.minimum.at(flat, owner * slots + slot, value)
            open_ = (out.max(axis=1) >= j + 1)[owner]
            if not open_.all():
                h, owner = h[open_], owner[open_]
                if ranks is not None:
                    ranks = ranks[open_]
                else:
                    slot = slot[open_]
            if ranks is None:
                ranks = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(h), 1))
                ranks[np.arange(len(h)), slot] = 0
        start = end
    return sig


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit bucket key for each band."""
    U = np.uint64
    bits = np.ascontiguousarray(sig).view(U).reshape(len(sig), bands, rows)
    key = np.zeros((len(sig), bands), U) + (np.arange(bands, dtype=U) + U(1)) * U(0xD1B54A32D192ED03)
    for r in range(rows):
        key = textnp.mix64(key + bits[:, :, r])
    return key.view(np.int64)


def _signatures(batches):
    for pdf in batches:
        ids, texts = pdf["doc_id"].tolist(), pdf["text"].tolist()
        texts = [x if isinstance(x, str) else None for x in texts]
        for a, b in textnp.blocks(texts):
            sets = textnp.shingle_sets(texts[a:b], SHINGLE)
            keys = band_keys(super_minhash(sets))
            n = [len(s) for s in sets]
            with np.errstate(over="ignore"):
                one = [int(textnp.mix64(s).sum(dtype=np.uint64).astype(np.int64)) for s in sets]
                two = [int(np.bitwise_xor.reduce(textnp.mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))).astype(np.int64)) if len(s) else 0 for s in sets]
            yield pd.DataFrame({"doc_id": pd.array(ids[a:b], "Int64") if any(i != i or i is None for i in ids[a:b]) else ids[a:b], "n_shingles": n, "h1": one, "h2": two, "keys": [k if c else k[:0] for k, c in zip(keys, n)]})


def _sets(batches):
    for pdf in batches:
        texts = [x if isinstance(x, str) else None for x in pdf["text"].tolist()]
        ids = pdf["doc_id"].tolist()
        for a, b in textnp.blocks(texts):
            yield pd.DataFrame({"doc_id": ids[a:b], "words": [s.tobytes() for s in textnp.shingle_sets(texts[a:b], SHINGLE)]})


def _confirmed(batches):
    for pdf in batches:
        good = []
        for x, y in zip(pdf["words_a"], pdf["words_b"]):
            n, m = len(x) // 8, len(y) // 8
            if DENOMINATOR * min(n, m) < NUMERATOR * max(n, m) or not n or not m:
                good.append(False)
                continue
            both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            good.append(DENOMINATOR * shared >= NUMERATOR * (n + m - shared))
        yield pdf.loc[good, ["a", "b"]]


def confirm(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of ids whose full sets are similar enough."""
    rows = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("words").alias("words_b")), "b")
    rows = rows.join(sets.select(F.col("doc_id").alias("a"), F.col("words").alias("words_a")), "a")
    return rows.select("a", "b", "words_a", "words_b").mapInPandas(_confirmed, "a long, b long").distinct()


def links_in_block(rep: np.ndarray, comp: np.ndarray, words: list) -> list[tuple[int, int]]:
    """All links between members in different components."""
    sets = [np.frombuffer(w, np.uint64) for w in words]
    size = np.array([len(x) for x in sets])
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    elements, number = np.unique(np.concatenate(sets), return_inverse=True)
    kinds, counts = np.unique(comp, return_counts=True)
    largest = kinds[counts.argmax()]
    out = []
    mark = np.zeros(len(elements), np.int32)
    for y in np.flatnonzero(comp != largest):
        own = number[starts[y] : starts[y] + size[y]]
        mark[own] = 1
        shared = np.add.reduceat(mark[number], starts)
        mark[own] = 0
        hit = (DENOMINATOR * shared >= NUMERATOR * (size + size[y] - shared)) & (comp != comp[y])
        out += [(int(rep[y]), int(rep[x])) for x in np.flatnonzero(hit)]
    return out


def _block_links(pdf: pd.DataFrame) -> pd.DataFrame:
    found = links_in_block(pdf["rep"].to_numpy(), pdf["comp"].to_numpy(), pdf["words"].tolist()) if pdf["comp"].nunique() > 1 else []
    return pd.DataFrame({"a": [x for x, _ in found], "b": [y for _, y in found]}, dtype="int64")


def _elements(batches):
    for pdf in batches:
        for rep, comp, v, words in zip(pdf["rep"], pdf["comp"], pdf["v"], pdf["words"]):
            x = np.frombuffer(words, np.int64)
            for a in range(0, len(x), 100_000):
                part = x[a : a + 100_000]
                yield pd.DataFrame({"rep": rep, "comp": comp, "v": v, "n": len(x), "token": part})


def links_by_rare_shingles(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(rep, comp) -> links (a, b) between members in different components, by an exact prefix join."""
    rows = members.join(sets.select(F.col("doc_id").alias("rep"), "words", F.xxhash64("words").alias("v")), "rep")
    tokens = materialise(rows.mapInPandas(_elements, "rep long, comp long, v long, n int, token long"))
    common = tokens.groupBy("token").agg(F.count("*").alias("all"))
    # Sets as similar as asked share one of the n - ceil(0.75 n) + 1 rarest shingles of each.
    prefix = F.col("n") - F.ceil(F.col("n") * NUMERATOR / DENOMINATOR).cast("int") + 1
    order = Window.partitionBy("rep", "v").orderBy("all", "token")
    posted = tokens.join(common, "token").withColumn("pos", F.row_number().over(order)).filter((F.col("pos") <= prefix) & (F.col("all") > 1))
    posted = materialise(posted.select("token", "rep", "comp", "n", "pos"))
    x, y = posted.alias("x"), posted.alias("y")
    n, m = F.col("x.n"), F.col("y.n")
    most = F.least(n - F.col("x.pos"), m - F.col("y.pos")) + 1  # shared shingles, given where the common one stands
    able = ((NUMERATOR + DENOMINATOR) * most >= NUMERATOR * (n + m)) & (DENOMINATOR * F.least(n, m) >= NUMERATOR * F.greatest(n, m))
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.comp") != F.col("y.comp")) & able)
    return confirm(sets, pairs.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct())


def links_across(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """(key, rep, comp, n_shingles) of buckets -> links (a, b) between members of a bucket in different components."""
    size = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
    apart = placed.join(size.filter("lo < hi").select("key", ((F.col("n") <= BLOCK) & (F.col("shingles") <= BLOCK_SHINGLES)).alias("small")), "key")
    apart = materialise(apart.select("key", "rep", "comp", "small"))
    rows = apart.filter("small").join(sets.select(F.col("doc_id").alias("rep"), "words"), "rep")
    found = rows.groupBy("key").applyInPandas(_block_links, "a long, b long")
    large = apart.filter("not small").select("rep", "comp").distinct()
    if not large.isEmpty():
        found = found.union(links_by_rare_shingles(large, sets))
    return found.distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``docs`` (doc_id, text)."""
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sig = materialise(docs.mapInPandas(_signatures, "doc_id long, n_shingles long, h1 long, h2 long, keys array<long>"))
    whole = sig.filter("n_shingles > 0 and doc_id is not null")
    same = materialise(whole.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys")))
    members = same.select("rep", "n_shingles", F.explode("keys").alias("key"))
    buckets = members.groupBy("key").agg(F.min("rep").alias("least"), F.count("*").alias("n")).filter("n > 1")
    members = materialise(members.join(buckets.select("key", "least"), "key"))
    texts = docs.join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    sets = materialise(texts.mapInPandas(_sets, "doc_id long, words binary"))
    pairs = members.filter("least <> rep").select(F.col("least").alias("a"), F.col("rep").alias("b")).distinct()
    links = materialise(confirm(sets, pairs))
    comp = materialise(components(links))
    placed = members.join(comp, F.col("rep") == F.col("node"), "left").select("key", "rep", "n_shingles", F.coalesce("component", "rep").alias("comp"))
    # Versions of one doc_id belong together: each set's rep is linked with all the ids that share it.
    reps = same.select("h1", "h2", "n_shingles", "rep")
    versions = whole.join(reps, ["h1", "h2", "n_shingles"]).filter("doc_id <> rep")
    repeated = whole.groupBy("doc_id").agg(F.min(F.struct("h1", "h2")).alias("lo"), F.max(F.struct("h1", "h2")).alias("hi")).filter("lo <> hi").select("doc_id")
    more = links_across(placed, sets).union(versions.join(repeated, "doc_id", "left_semi").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    more = materialise(more)
    discard(members, sets, links)
    if not more.isEmpty():
        comp = materialise(components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)))
    out = sig.join(reps, ["h1", "h2", "n_shingles"], "left")
    out = out.join(comp, F.col("rep") == F.col("node"), "left")
    shared = F.coalesce("component", "rep", "doc_id")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).when(F.col("n_shingles") > 0, shared).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents of a component but its smallest doc_id; rows that repeat that id go too."""
    drop = near_duplicates(docs).filter("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(drop, F.col("doc_id") == F.col("__gone"), "left_anti")
