"""Benchmark decontamination: short test items inside long documents.

Plain MinHash cannot see a 40-word item in a 20,000-word document: their Jaccard
similarity is too small for any number of slots.  So both sides are partitioned
by size.  An item of more than 16 shingles, up to L = 16 * 2**c, belongs to class
c, and for that class a document is the set of its windows of 2L shingles at
every L: a run of L shingles lies whole in one of them, which keeps the
similarity of item and window above 0.17 at 75 % containment in one run.  A
window's MinHash comes from the minima of its two halves, and those of the next
class from the halves below, so all classes cost one pass over the shingles.
Agreement in any of ``SLOTS`` slots makes a candidate (a miss has probability
0.83**48 = 0.0001 at worst; more where the shared shingles lie scattered over the
document).

Items of up to 16 shingles are too small for such windows and are found exactly:
of n shingles, one of any floor(n / 4) + 1 is in every document that holds 75 %
of them, so those rarest among the items are looked up by their hashes.

The exact containment of the item's shingle set in the whole document confirms
each candidate.

Documents are streamed and never shuffled.  Items go out in blocks of
``ITEMS_PER_BLOCK``, each broadcast and met by all documents, whatever their
number.

Defined results: shingles are five lower-cased words, or all of a shorter text;
items or documents without words match nothing; repeated rows match each; a null
item_id or doc_id is carried as null; empty tables give an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyfold.llm import textnp
from skyfold.llm.session import bound_batches

SHINGLE = 5
NUMERATOR, DENOMINATOR = 75, 100
SLOTS = 48
SMALLEST = 16
#: The most a block of items may have: rows (a signature each) and characters of text (some two bytes of shingles each); about 60 MB.
ITEMS_PER_BLOCK, CHARS_PER_BLOCK = 50_000, 20_000_000
U = np.uint64


def _multipliers() -> np.ndarray:
    return textnp.mix64(np.arange(1, SLOTS + 1, dtype=U) * U(0xC2B2AE3D27D4EB4F)) | U(1)


def item_index(items: list) -> dict:
    """(item_id, text) rows -> their sets, the sorted keys of the small ones and whose they are, and the same of the minima of each size class and slot."""
    sets = textnp.shingle_sets([t for _, t in items], SHINGLE)
    by_class: dict[int, list[int]] = {}
    small = []
    for i, s in enumerate(sets):
        if len(s) > SMALLEST:
            by_class.setdefault(int(np.ceil(np.log2(len(s) / SMALLEST))), []).append(i)
        elif len(s):
            small.append(i)
    mult = _multipliers()
    classes = {}
    for c, own in by_class.items():
        minima = np.stack([(sets[i][:, None] * mult).min(axis=0) for i in own])
        order = np.argsort(minima, axis=0, kind="stable")
        classes[c] = (np.take_along_axis(minima, order, 0), np.array(own)[order])
    return {"ids": [i for i, _ in items], "sets": sets, "keys": _small_keys(sets, small), "classes": classes}


def _small_keys(sets: list, small: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Of each small item as many of its shingles as can't all be missing from a document that holds it, sorted, and whose they are."""
    if not small:
        return np.zeros(0, U), np.zeros(0, np.int64)
    distinct, n = np.unique(np.concatenate([sets[i] for i in small]), return_counts=True)
    keys = []
    for i in small:
        s = sets[i]
        most_missing = len(s) * (DENOMINATOR - NUMERATOR) // DENOMINATOR
        keys.append(s[np.argsort(n[np.searchsorted(distinct, s)], kind="stable")[: most_missing + 1]])
    of = np.repeat(small, [len(k) for k in keys])
    keys = np.concatenate(keys)
    order = np.argsort(keys, kind="stable")
    return keys[order], of[order]


def _small_candidates(h: np.ndarray, owner: np.ndarray, index: dict) -> set:
    """(document, item) pairs where a key of a small item is among the document's shingles."""
    keys, items = index["keys"]
    if not len(h) or not len(keys):
        return set()
    low = np.searchsorted(keys, h)
    hits = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == h)
    # A shingle that a document repeats counts once.
    where = np.unique(owner[hits] * len(keys) + low[hits])
    doc, low = where // len(keys), where % len(keys)
    n = np.searchsorted(keys, keys[low], "right") - low
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    return set(zip(np.repeat(doc, n).tolist(), items[at].tolist()))


def _candidates(h: np.ndarray, owner: np.ndarray, index: dict) -> set:
    """(document, item) pairs that agree in a slot; ``h`` has shingles in text order and ``owner`` their documents."""
    found: set = set()
    if not len(h) or not index["classes"]:
        return found
    n = int(owner[-1]) + 1
    counts = np.bincount(owner, minlength=n)
    # Blocks of SMALLEST shingles that don't cross documents.
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    position = np.arange(len(h)) - first[owner]
    starts = np.flatnonzero(position % SMALLEST == 0)
    doc = owner[starts]
    place = position[starts] // SMALLEST
    minima = np.empty((len(starts), SLOTS), U)
    for s, m in enumerate(_multipliers()):
        np.minimum.reduceat(h * m, starts, out=minima[:, s])
    for c in range(max(index["classes"]) + 1):
        if c:  # halves of the next class: blocks 2k and 2k + 1
            head = np.flatnonzero(place % 2 == 0)
            minima = np.minimum.reduceat(minima, head, axis=0)
            doc, place = doc[head], place[head] // 2
        if c not in index["classes"]:
            continue
        window = minima.copy()
        paired = np.flatnonzero(doc[1:] == doc[:-1])
        window[paired] = np.minimum(minima[paired], minima[paired + 1])
        values, items = index["classes"][c]
        for s in range(SLOTS):
            column, of = values[:, s], items[:, s]
            low = np.searchsorted(column, window[:, s])
            for w in np.flatnonzero(column[np.minimum(low, len(column) - 1)] == window[:, s]):
                high = np.searchsorted(column, window[w, s], "right")
                found.update((int(doc[w]), int(i)) for i in of[low[w] : high])
    return found


def contained(texts: list, index: dict) -> list[tuple[int, int, int, int]]:
    """(document, item, the item's shingles, those in the document) of each match."""
    out = []
    words, at = textnp.word_hashes(texts, lower=True)
    h = textnp.grams(words, SHINGLE)
    parts, owners = [], []
    for d, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        part = h[a : b - SHINGLE + 1] if b - a >= SHINGLE else (textnp.grams(words[a:b], b - a) ^ U(b - a) if b > a else h[:0])
        parts.append(part)
        owners.append(np.full(len(part), d))
    if not parts:
        return out
    h, owner = np.concatenate(parts), np.concatenate(owners)
    near = _candidates(h, owner, index) | _small_candidates(h, owner, index)
    own: dict[int, np.ndarray] = {}
    for d, i in sorted(near):
        if d not in own:
            own = {d: np.unique(parts[d])}
        item = index["sets"][i]
        shared = int(np.isin(item, own[d], assume_unique=True).sum())
        if DENOMINATOR * shared >= NUMERATOR * len(item):
            out.append((d, i, len(item), shared))
    return out


def _blocks(items: DataFrame):
    """The items in blocks of rows for the driver, split by hash."""
    rows = items.select(F.col(items.columns[0]).alias("i"), F.col("text").alias("t"))
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("chars")).first()
    n = max(1, -(-size["n"] // ITEMS_PER_BLOCK), -(-size["chars"] // CHARS_PER_BLOCK))
    for k in range(n):
        block = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield [(r.i, r.t) for r in block.toLocalIterator()]


def find_items(docs: DataFrame, items: DataFrame, item_id: str = "item_id") -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared) of each document and item at least 75 % contained in it."""
    spark = docs.sparkSession
    bound_batches(spark)
    items = items.select(item_id, "text")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("item_id", items.schema[item_id].dataType), T.StructField("n_shingles", T.LongType()), T.StructField("n_shared", T.LongType())])
    out = None
    for block in _blocks(items):
        sent = spark.sparkContext.broadcast(item_index(block))

        def match(batches, sent=sent):
            index = sent.value
            for pdf in batches:
                ids = pdf["doc_id"].astype(object).where(pdf["doc_id"].notna(), None).tolist()
                texts = [x if isinstance(x, str) else None for x in pdf["text"].tolist()]
                for a, b in textnp.blocks(texts):
                    rows = contained(texts[a:b], index)
                    yield pd.DataFrame({"doc_id": pd.Series([ids[a + d] for d, *_ in rows], dtype=object), "item_id": pd.Series([index["ids"][i] for _, i, *_ in rows], dtype=object), "n_shingles": [r[2] for r in rows], "n_shared": [r[3] for r in rows]})

        part = docs.select("doc_id", "text").mapInPandas(match, schema)
        out = part if out is None else out.union(part)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, item_id: str = "item_id") -> DataFrame:
    """``docs`` without the documents that hold an item; rows keep all their columns and are not shuffled."""
    spark = docs.sparkSession
    bound_batches(spark)
    for block in _blocks(items.select(item_id, "text")):
        sent = spark.sparkContext.broadcast(item_index(block))

        def clean(batches, sent=sent):
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
                hit = set()
                for a, b in textnp.blocks(texts):
                    hit.update(a + d for d, *_ in contained(texts[a:b], sent.value))
                yield batch.filter(pa.array([i not in hit for i in range(len(texts))], pa.bool_())) if hit else batch

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
